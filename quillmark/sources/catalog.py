"""Reading and writing the stored tables with their declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column

from quillmark.functions.shared import materialise
from quillmark.schemas import TABLES

PAPER_BUCKETS = 1024


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table with its declared schema: no inference, no footer merge."""
    return spark.read.schema(TABLES[name].schema).parquet(f"{root}/{name}")


def with_bucket(df: DataFrame, buckets: int = PAPER_BUCKETS) -> DataFrame:
    return df.withColumn("paper_bucket", F.pmod(F.xxhash64("paper_id"), buckets).cast("int"))


def write_table(df: DataFrame, root: str, name: str, mode: str = "append") -> None:
    """Write in declared column order, partitioned as the table declares."""
    table = TABLES[name]
    present = set(df.columns)
    cols = [
        (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in table.schema
    ]
    out = df.select(*cols)
    if table.partition:
        # one shuffle so each partition folder gets few files, split when it is large
        out = out.repartition(table.partition, F.pmod(F.xxhash64(*table.key), F.lit(8)))
        out.write.mode(mode).partitionBy(table.partition).parquet(f"{root}/{name}")
    else:
        out.write.mode(mode).parquet(f"{root}/{name}")


def replace_papers(
    spark: SparkSession, path: str, rows: DataFrame, paper_ids: DataFrame,
    buckets: int = PAPER_BUCKETS,
) -> None:
    """Swap the rows of some papers in a table laid out by ``paper_bucket``.

    Only the buckets those papers fall into are read and rewritten. Running it
    twice leaves the same table.
    """
    rows = with_bucket(rows, buckets)
    gone = with_bucket(paper_ids.select("paper_id"), buckets).distinct()
    touched = gone.select("paper_bucket").distinct()
    stored = spark.read.parquet(path)
    kept = stored.join(touched, "paper_bucket", "left_semi").join(
        gone, ["paper_bucket", "paper_id"], "left_anti"
    )
    merged = kept.unionByName(rows.select(*stored.columns))
    # read fully before the folders it came from are rewritten
    staged = materialise(merged, "replace")
    plain = [c for c, t in staged.dtypes if "map<" not in t]
    spread = F.pmod(F.xxhash64(*plain), F.lit(8))  # a large bucket is written by eight tasks
    staged.repartition("paper_bucket", spread).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("paper_bucket").parquet(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Raw uploads as (path, content, page_count), empty files included.

    Spark's file reader leaves zero-length files out of its splits, but its file index, which is listed in parallel,
    has them. All its names become one array column in a single call; those that no split holds are the empty files.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    )
    empty = _indexed(files).join(files.select("path"), "path", "left_anti").select("path", F.lit(b"").alias("content"))
    return files.select("path", "content").unionByName(empty).withColumn(
        "page_count", F.lit(None).cast("int"))


def _indexed(files: DataFrame) -> DataFrame:
    """The names in the file index of a frame, written as the reader writes them."""
    spark = files.sparkSession
    names = Column(spark._jvm.org.apache.spark.sql.functions.lit(files._jdf.inputFiles()))
    plain = F.url_decode(F.replace(F.col("uri"), F.lit("+"), F.lit("%2B")))  # an index has URIs
    return spark.range(1).select(F.explode(names).alias("uri")).select(
        F.regexp_replace(plain, "^file:///", "file:/").alias("path"))
