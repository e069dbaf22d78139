"""Helpers that several training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the word operators: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = b" \t\n\x0b\x0c\r"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def tune(spark: SparkSession, rows: int = 2000, mb: int = 8) -> SparkSession:
    """Bounds what one Arrow batch holds, so that very long texts don't fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for files that all executors must see, under spark.checkpoint.dir (set here only where it is unset)."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        # One process is driver and executor alike: its own temporary folder is shared by all there are.
        top = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df through Parquet in the shared folder: cuts the lineage, and a lost executor costs only its own tasks.

    Its attribute `folder` is where it lies; `forget` deletes that.
    """
    spark = df.sparkSession
    path, before = scratch(spark, name), spark.conf.get(CLEANUP, None)
    # Only for this job, whose plan nobody runs again: its shuffle files go when it ends.
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def forget(spark: SparkSession, *frames: DataFrame | str) -> None:
    """Deletes folders of the shared folder, or those of frames that `written` gave, once nothing reads them any more."""
    for f in frames:
        path = spark._jvm.org.apache.hadoop.fs.Path(f if isinstance(f, str) else f.folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows of consecutive Arrow batches as one, of at least `size` bytes where there are so many."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(x.nbytes for x in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_texts(df: DataFrame, fn: Callable[[list, list], dict], schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """fn(ids, texts) -> columns, over Arrow batches of (id, text) only; other columns never reach Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield from as_batches(fn(b.column(0).to_pylist(), b.column(1).to_pylist()))

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def as_batches(columns: dict) -> Iterator[pa.RecordBatch]:
    names = list(columns)
    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=names)


def exact_rank(df: DataFrame, part: list[str], bucket: str, order: list[Column], rank: str, total: str | None = None) -> DataFrame:
    """1-based row number of each row in its group `part`, by (bucket, *order), without one task for a group.

    bucket is a column whose order agrees with `order`. Rows are counted for each (part, bucket), the small
    table of counts gets running sums, and rows are only numbered within their (part, bucket).
    """
    keys = [*part, bucket]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__cnt"))
    w = Window.partitionBy(*part).orderBy(bucket) if part else Window.orderBy(bucket)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if total:
        counts = counts.withColumn(total, F.sum("__cnt").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    counts = counts.drop("__cnt")
    numbered = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.join(counts, keys).withColumn(rank, F.col("__before") + F.col("__rn")).drop("__before", "__rn")
