"""Session helpers: reading tables, and cutting lineage in the shared checkpoint folder."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; ``name.parquet`` may be a file or a folder of part files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. The cluster names it in spark.checkpoint.dir; only where that is unset and all
    runs in one process (tests) a temporary folder is made and set. On a cluster its absence is an error: a folder of one
    machine would lose rows."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        named = "file://" + tempfile.mkdtemp(prefix="lexweave-")
        spark.conf.set("spark.checkpoint.dir", named)
        _made.append((spark, named))
    return named.rstrip("/")


def materialize(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write a frame once to the shared folder and read it back: lineage ends there, and a lost executor costs nothing
    that is already written. The files are removed when the driver ends, or by :func:`release`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A scanned frame over at least as many partitions as there are cores, for work that is heavy per row. Only an input
    of fewer files and splits than cores is dealt out anew; a larger one stays where it was read."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def in_sets(rows: DataFrame, key: str, size: int) -> Iterator[list[Row]]:
    """The rows of a stated query set, sorted by key, in sets of about ``size`` by hash of the key; none is empty."""
    n = rows.count()
    sets = max(1, -(-n // size))
    for b in range(sets):
        own = rows if sets == 1 else rows.where(F.pmod(F.xxhash64(key), F.lit(sets)) == b)
        if got := sorted(own.collect(), key=lambda r: r[key]):
            yield got


def release(spark: SparkSession) -> None:
    """Remove every folder that :func:`materialize` made in this session."""
    keep = []
    for owner, path in _made:
        if owner is not spark:
            keep.append((owner, path))
            continue
        with contextlib.suppress(Exception):
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _made[:] = keep


@atexit.register
def _end() -> None:
    for spark in {id(s): s for s, _ in _made}.values():
        with contextlib.suppress(Exception):
            release(spark)
