"""Tables of parts that are replaced or added to, with a manifest.

Rows lie below ``<path>/rows/version=<v>/part=<p>``; ``<path>/manifest`` has one line per version and part:
its kind (``replace`` or ``add``), its number of rows and the token the writer gave (the state of the
data it stands for). The lines of a version are written last, as one file, so a writer that dies leaves nothing a
reader sees; the next writer takes the same number and removes what was left. Files are never
changed: a part that a version does not touch keeps its files.

A part consists of its last ``replace`` and all its later ``add`` versions. The manifest is small
(versions times touched parts) and is what the driver reads; ``vacuum`` removes rows no reader needs.
One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "version long, part string, kind string, n_rows long, token string"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def manifest(spark: SparkSession, path: str) -> DataFrame:
    fs, at = _fs(spark, f"{path}/manifest")
    return spark.read.schema(MANIFEST).parquet(str(at)) if fs.exists(at) else spark.createDataFrame([], MANIFEST)


def token(spark: SparkSession, path: str) -> str | None:
    """The token of the last finished version (None: nothing stored)."""
    last = manifest(spark, path).agg(F.max_by("token", "version")).first()
    return last[0]


def live(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """The (version, part) pairs that make up the table now."""
    m = manifest(spark, path)
    base = m.groupBy("part").agg(F.max(F.when(F.col("kind") == "replace", F.col("version"))).alias("base"))
    now = m.join(base, "part").where("n_rows > 0 and version >= coalesce(base, 0)").select("version", "part")
    return sorted((r["version"], r["part"]) for r in now.collect())


def read(spark: SparkSession, path: str, schema: StructType, parts=None) -> DataFrame:
    """The rows of the table, or of some ``parts``: only their folders are listed and read. Has the column ``part``."""
    wanted = None if parts is None else {str(p) for p in parts}
    folders = [f"{path}/rows/version={v}/part={p}" for v, p in live(spark, path) if wanted is None or p in wanted]
    full = StructType([f for f in schema.fields if f.name not in ("part", "version")]).add("part", "string")
    if not folders:
        return spark.createDataFrame([], full)
    return spark.read.schema(full).option("basePath", f"{path}/rows").parquet(*folders).select(full.names)


def write(rows: DataFrame, path: str, kind: str = "replace", token: str | None = None, touched=None) -> int:
    """Store ``rows`` (with a column ``part``) as a new version; returns its number.

    ``touched``: the parts that a ``replace`` stands for, also those that hold no rows any more;
    without it the parts found in ``rows``.
    """
    spark = rows.sparkSession
    version = (manifest(spark, path).agg(F.max("version")).first()[0] or 0) + 1
    fs, at = _fs(spark, f"{path}/rows/version={version}")
    fs.delete(at, True)
    # a large part is split over several tasks, small ones are merged
    rows.withColumn("part", F.col("part").cast("string")).hint("rebalance", "part").write.partitionBy("part").parquet(str(at))
    found = {}
    if fs.globStatus(_fs(spark, f"{at}/part=*")[1]):
        stored = spark.read.schema("part string").parquet(str(at))
        found = {r["part"]: r["n"] for r in stored.groupBy("part").agg(F.count("*").alias("n")).collect()}
    parts = sorted(found.keys() | {str(p) for p in touched or []})
    lines = [(version, p, kind, found.get(p, 0), token) for p in parts] or [(version, "", "add", 0, token)]
    spark.createDataFrame(lines, MANIFEST).repartition(1).write.mode("append").parquet(f"{path}/manifest")
    return version


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete the folders that are not part of the table now; returns how many. Not while a reader of an older state runs."""
    keep = {f"version={v}/part={p}" for v, p in live(spark, path)}
    fs, pattern = _fs(spark, f"{path}/rows/version=*/part=*")
    gone = [s.getPath() for s in fs.globStatus(pattern) or []
            if f"{s.getPath().getParent().getName()}/{s.getPath().getName()}" not in keep]
    for at in gone:
        fs.delete(at, True)
    return len(gone)
