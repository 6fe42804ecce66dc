"""Read-only guard of the free-form SQL."""

import pytest

from airmetrics.operators.sqlgate import SqlRefused, check_read_only, run_select


@pytest.mark.parametrize("sql", [
    "DELETE FROM flights", "drop table flights", "select reflect('java.lang.System', 'exit', '0')",
    "select java_method('java.lang.Math', 'random')", "select * from csv.`/etc/passwd`",
    "insert into flights select * from flights"])
def test_refused(sql):
    with pytest.raises(SqlRefused):
        check_read_only(sql)


def test_accepted_forms():
    assert check_read_only("   SELECT 1;") == "SELECT 1"
    assert check_read_only("with a as (select 1) select * from a")
    assert check_read_only("DELETE FROM x", admin=True) == "DELETE FROM x"


def test_errors_propagate(spark):
    from pyspark.errors import AnalysisException
    with pytest.raises(AnalysisException):
        run_select(spark, {"t": spark.range(3)}, "select no_such_column from t").collect()


def test_second_statement_refused_by_parser(spark):
    from pyspark.errors import ParseException
    with pytest.raises(ParseException):
        run_select(spark, {"t": spark.range(3)}, "select 1; select 2").collect()


def test_file_reads_refused_by_spark_too(spark, tmp_path):
    from pyspark.errors import AnalysisException
    spark.range(3).write.parquet(str(tmp_path / "p"))
    # refused by the text guard (and Spark has file reads switched off while resolving)
    with pytest.raises((AnalysisException, SqlRefused)):
        run_select(spark, {}, f"select * from parquet.`{tmp_path / 'p'}`").collect()
    assert spark.conf.get("spark.sql.runSQLOnFiles") == "true"
