"""What several corpus operators need from Spark: shared storage and ordered chunks of documents."""

from __future__ import annotations

import ctypes
import gc
import inspect
import json
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cells of the key from which ranges are made.
_CELLS = 2048


#: Rows of an Arrow batch where the session has Spark's default; texts may be long, so a batch is kept to a few MB.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to BATCH_ROWS rows, unless someone has set their size."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where the session names none and is one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{os.path.join(tempfile.gettempdir(), 'quillon-checkpoints')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write df into the shared folder and read it back: a cut in lineage that outlives any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quillon-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillon_path = path
    return out


#: The columns of documents that stages know by name.
_KNOWN = ("doc_id", "text", "lang", "source", "n_chars")


def shielded(stage):
    """A pipeline stage whose further columns, whatever they are called, travel under names of their own."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {c: c if c in _KNOWN else f"further_column_{i}" for i, c in enumerate(docs.columns)}
        quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
        out = stage(spark, docs.select(*[quoted(c).alias(n) for c, n in names.items()]), sf_dir)
        return out.select(*[F.col(n).alias(c) for c, n in names.items()])

    run.__doc__ = stage.__doc__
    return run


def give_back() -> None:
    """Give the memory that a worker holds but does not use back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def released(run):
    """run, for mapInArrow, giving memory back when a task's rows are at an end."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def freed(run):
    """run, for applyInArrow, giving memory back after each group."""
    if len(inspect.signature(run).parameters) == 2:

        def both(left, right):
            try:
                return run(left, right)
            finally:
                give_back()

        return both

    def one(rows):
        try:
            return run(rows)
        finally:
            give_back()

    return one


def forget(df: DataFrame) -> None:
    """Delete what written() wrote, once nothing reads it any more."""
    path = getattr(df, "_quillon_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def ranges(df: DataFrame, key: str, text: str, target_bytes: int) -> Column:
    """A column that numbers contiguous ranges of ``key``, each holding about target_bytes of ``text``.

    At most ``_CELLS`` quantiles of the key reach the driver, with the bytes between
    them; light cells are joined, and heavy ones cut into equal steps of the key, so a
    plan's constants do not grow with the data. Rows of one key stay together; rows
    without a key come first, dealt by their texts to as many ranges as they fill.
    """
    k = F.col(key).cast("bigint")
    size = F.coalesce(F.octet_length(text), F.lit(0)) + 16
    probs = [i / _CELLS for i in range(1, _CELLS)]
    stat = df.agg(F.sum(F.when(k.isNull(), size)).alias("none"), F.min(k).alias("lo"), F.max(k).alias("hi"), F.percentile_approx(k, probs, 4 * _CELLS).alias("cuts")).first()
    first = -(-(stat["none"] or 0) // target_bytes)  # ranges of rows without a key
    free = F.pmod(F.xxhash64(text), F.lit(max(first, 1))).cast("int")
    if stat["lo"] is None or stat["lo"] == stat["hi"]:
        return F.when(k.isNull(), free).otherwise(F.lit(first)).cast("int")
    lo, hi = stat["lo"], stat["hi"]
    starts = np.unique(np.array([lo, *[c for c in stat["cuts"] if c > lo]], dtype=np.int64))
    # the cell of a key: that of its even step of the whole span, and the quantiles inside that step
    width = max((float(hi) - float(lo)) / _CELLS, 1e-300)
    step_of = np.minimum(np.floor((starts.astype(float) - float(lo)) / width).astype(np.int64), _CELLS - 1)
    before = np.searchsorted(step_of, np.arange(_CELLS)).tolist()
    inside = [[] for _ in range(_CELLS)]
    for c, at in zip(starts.tolist(), step_of.tolist(), strict=True):
        inside[at].append(c)
    constant = lambda x, kind: F.from_json(F.lit(json.dumps(x)), kind)
    step = F.least(F.floor((k.cast("double") - F.lit(float(lo))) / F.lit(width)).cast("int"), F.lit(_CELLS - 1))
    cell = F.get(constant(before, "array<int>"), step) + F.size(F.filter(F.get(constant(inside, "array<array<bigint>>"), step), lambda b: b <= k)) - 1
    held = {r["cell"]: r["b"] for r in df.where(k.isNotNull()).groupBy(cell.alias("cell")).agg(F.sum(size).alias("b")).collect()}  # _CELLS rows
    base, steps = [], []
    at, filled = first, 0
    for i, start in enumerate(starts.tolist()):
        n = held.get(i, 0)
        if filled and filled + n > target_bytes:
            at, filled = at + 1, 0
        base.append(at)
        end = int(starts[i + 1]) if i + 1 < len(starts) else hi + 1
        parts = max(1, min(-(-n // target_bytes), end - start))
        steps.append(-(-(end - start) // parts))
        if parts > 1:
            at, filled = at + parts, 0
        else:
            filled += n
    at = F.get(constant(starts.tolist(), "array<bigint>"), cell)
    inner = ((k.cast("decimal(20,0)") - at.cast("decimal(20,0)")) / F.get(constant([str(s) for s in steps], "array<decimal(20,0)>"), cell)) if hi - lo >= 2**62 else F.call_function("div", k - at, F.get(constant(steps, "array<bigint>"), cell))
    return F.when(k.isNull(), free).otherwise(F.get(constant(base, "array<int>"), cell) + F.floor(inner)).cast("int")
