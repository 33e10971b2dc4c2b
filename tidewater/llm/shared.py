"""Helpers shared by the training-data operators.

Everything here works through Spark's own readers and writers, so the inputs
and the scratch tables may live in any store that Spark reaches.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The six ASCII white-space characters that separate words.
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, found by exact spelling first.

    Further columns, also ones that differ from a wanted one in case or repeat
    it, can't make a reference ambiguous: the columns are taken by position.
    """
    have = df.columns
    lowered = [c.lower() for c in have]
    spots = [have.index(n) if n in have else lowered.index(n.lower()) for n in names]
    plain = df.toDF(*(f"__in{i}" for i in range(len(have))))
    return plain.select(*(F.col(f"__in{i}").alias(n) for i, n in zip(spots, names, strict=True)))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where it is unset, a session with a local master gets a fresh folder of this machine; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidewater-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives a lost executor."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, *tables: DataFrame | None) -> None:
    """Deletes tables that `materialise` wrote; nothing may read them any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for df in tables:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()} if df is not None else ():
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)


#: Rows of a batch that Python gets: texts differ in length by four orders, and Spark bounds batches by rows alone.
BATCH_ROWS = 128
#: Bytes of text that Python works on at once.
RUN_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lets the session hand Python at most BATCH_ROWS rows at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def byte_runs(batches: Iterator[pa.RecordBatch], column: int, most: int = RUN_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in runs whose texts (a string or binary column) have `most` bytes together, one row at least."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)) if batch.num_rows else ()
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def guarded(df: DataFrame) -> DataFrame:
    """Adds `__row`, on which a filter above must also ask.

    Otherwise Spark moves the filter below the projections that compute its
    columns and writes them all out in its condition, where arrays that took one
    step each are computed anew for every element.
    """
    return df.withColumn("__row", F.monotonically_increasing_id())


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_total(df: DataFrame, order: list[str | Column], value: Column, out: str, group: str | None = None) -> DataFrame:
    """Adds `out`: the sum of `value` over all earlier rows in `order` (within `group`), the row itself left out.

    Two levels, so no task sees more than its range of rows: rows are dealt by
    range of (group, order), summed within each range, and each range's offset
    is the sum of the ranges before it: one small row per range and group, joined
    back as Spark sees fit.  Rows with equal order keys may take either order, so pass a
    total order where that matters.
    """
    spark = df.sparkSession
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    lead = [F.col(group).asc_nulls_last()] if group else []
    staged = materialise(
        df.withColumn("__v", value)
        .repartitionByRange(width(spark), *lead, *keys)
        .withColumn("__p", F.spark_partition_id()),
        "ranges",
    )
    part = [F.col("__p")] + ([F.col(group)] if group else [])
    sums = staged.groupBy(*part).agg(F.sum("__v").alias("__s"))
    over = Window.partitionBy(*([F.col(group)] if group else [F.lit(0)])).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("__o", F.coalesce(F.sum("__s").over(over), F.lit(0).cast(sums.schema["__s"].dataType))).drop("__s")
    names = ["__p2"] + (["__g2"] if group else [])
    offsets = offsets.select(F.col("__p").alias("__p2"), *([F.col(group).alias("__g2")] if group else []), "__o")
    on = staged["__p"] == offsets["__p2"]
    if group:
        on = on & staged[group].eqNullSafe(offsets["__g2"])
    joined = staged.join(offsets, on, "left").drop(*names)
    inner = Window.partitionBy(*part).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    local = F.coalesce(F.sum("__v").over(inner), F.lit(0).cast(sums.schema["__s"].dataType))
    return joined.withColumn(out, F.col("__o") + local).drop("__v", "__p", "__o")
