"""Shared scratch tables that survive lost executors, and small table helpers.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``, the folder all
executors and the driver share. Where a session has no such setting (tests on a
local master) a temporary folder is set once for that session. Tables that a result still
reads stay there; ``clear`` removes all once results are written.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, or a fresh local one where none is set."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    found = conf or spark.conf.get("mailgauge.scratch.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="mailgauge-")
        spark.conf.set("mailgauge.scratch.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/mailgauge/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """Write ``df`` below the shared folder; return it as read back, and its path."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def saved(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    return save(df, name, codec)[0]


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that nothing reads any more."""
    jvm = spark._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clear(spark: SparkSession) -> None:
    """Delete all scratch tables of this and earlier runs: results that still read them must be written before."""
    drop(spark, f"{shared_dir(spark)}/mailgauge")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def slices(batch, size: int = 2_000_000):
    """An Arrow batch in slices of about so many bytes, so that few texts are in hand at once."""
    rows = max(1, int(batch.num_rows * size / max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def release() -> None:
    """Give back what a Python worker's earlier tasks left: workers serve all stages."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


_KEPT: list = []


def kept(make):
    """What a Python worker keeps from task to task, the last one made; it is made where no other function's is left.

    Workers serve all stages, and one stage's words are of no use to the next.
    """

    @wraps(make)
    def anew(*args):
        for other in _KEPT:
            if other is not own:
                other.cache_clear()
        release()
        return make(*args)

    own = lru_cache(maxsize=1)(anew)
    _KEPT.append(own)
    return own


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it: a name that no column of ``df`` has in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
