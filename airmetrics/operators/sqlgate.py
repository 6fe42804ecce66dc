"""Free-form SQL over the flight tables (Q1-Q4).

The text goes to ``spark.sql`` unchanged: Spark parses, analyses, optimises and
plans it, and errors (``AnalysisException``, ``ParseException``) reach the caller.
The guard only decides whether a text may run.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_READ_PREFIXES = ("select", "with")
# Functions that would let a SELECT call into the JVM.
_FORBIDDEN = re.compile(r"\b(reflect|java_method|try_reflect)\s*\(", re.IGNORECASE)
# ``SELECT * FROM csv.`/path``` style direct file reads.
_FILE_READ = re.compile(r"\b(csv|json|parquet|orc|text|avro|binaryfile)\s*\.\s*`", re.IGNORECASE)


class SqlRefused(ValueError):
    """The text is not a read-only query."""


def check_read_only(sql: str, admin: bool = False) -> str:
    """Q2: a non-admin text must start with SELECT (or WITH) and must not call
    reflection functions or read files directly. Returns the text without a
    trailing ';' (a second statement is refused by Spark's parser)."""
    text = sql.strip()
    while text.endswith(";"):
        text = text[:-1].rstrip()
    if admin:
        return text
    if not text.lower().startswith(_READ_PREFIXES):
        raise SqlRefused("only SELECT queries are allowed")
    if _FORBIDDEN.search(text):
        raise SqlRefused("reflection functions are not allowed")
    if _FILE_READ.search(text):
        raise SqlRefused("direct file reads are not allowed")
    return text


_WRITES = re.compile(r"'?(?:InsertInto|CreateTable|ReplaceTable|CreateView|DropTable|Merge|Delete|Update|Cache|SetCommand|AddJar)\w*")
_CALLS = re.compile(r"'?`?\b(?:reflect|java_method|try_reflect)\b`?\s*\(", re.IGNORECASE)


def check_plan(spark: SparkSession, text: str) -> None:
    """Q2 on the parsed plan: no node that writes or commands, no reflection call, however the text
    spells them (comments and back quotes are gone after parsing)."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    for line in plan.treeString().splitlines():
        node = line.lstrip(" :+-")
        if _WRITES.match(node):
            raise SqlRefused("only SELECT queries are allowed")
        if _CALLS.search(line):
            raise SqlRefused("reflection functions are not allowed")


def register_tables(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def run_select(spark: SparkSession, tables: dict[str, DataFrame], sql: str, admin: bool = False) -> DataFrame:
    """Q1/Q3: run one guarded query over the given tables; errors propagate."""
    text = check_read_only(sql, admin)
    register_tables(spark, tables)
    if admin:
        return spark.sql(text)
    # ``spark.sql`` resolves the text right away, so direct file reads only need
    # to be off while it does; the caller's setting is restored afterwards.
    check_plan(spark, text)
    previous = spark.conf.get("spark.sql.runSQLOnFiles", "true")
    spark.conf.set("spark.sql.runSQLOnFiles", "false")
    try:
        return spark.sql(text)
    finally:
        spark.conf.set("spark.sql.runSQLOnFiles", previous)


def select_to_csv(spark: SparkSession, tables: dict[str, DataFrame], sql: str, path: str,
                  admin: bool = False, single: bool = False) -> None:
    """Q4: query result to CSV with a header (see sources.files.write_csv)."""
    from airmetrics.sources.files import write_csv

    write_csv(run_select(spark, tables, sql, admin), path, single=single)
