"""Helpers shared by the text operators."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that no other column of the input can clash.

    An exact spelling wins over one that differs in case only.
    """
    cols = df.columns
    low = [c.lower() for c in cols]
    if len(set(low)) == len(cols):
        return df.select(*names)
    keep = df.toDF(*[f"_{i}" for i in range(len(cols))])
    at = {n: cols.index(n) if n in cols else low.index(n.lower()) for n in names}
    return keep.select(*[F.col(f"_{i}").alias(n) for n, i in at.items()])


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of df is spelled so in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where none is set, a local master, as in tests, gets a temporary one, removed at its end; a cluster raises."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir is not set: the executors of {master} need a folder that all of them share")
        folder = tempfile.mkdtemp(prefix="framesift-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _write(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, what: str) -> DataFrame:
    """df, written as Parquet to the shared folder, under this application's own, and read back: lineage ends here.

    The table stays for as long as results may read it; what only steps in between read is a ``Scratch``'s.
    """
    return _write(df, what)[0]


class Scratch:
    """Tables in the shared folder that only steps in between read: ``clear`` removes them once a later one has been written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, what: str) -> DataFrame:
        out, path = _write(df, what)
        self.paths.append(path)
        return out

    def clear(self, keep: int = 0) -> None:
        """Removes all of them but the last ``keep``."""
        gone, self.paths = self.paths[: len(self.paths) - keep], self.paths[len(self.paths) - keep :]
        conf, at = self.spark.sparkContext._jsc.hadoopConfiguration(), self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for path in map(at, gone):
            path.getFileSystem(conf).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of results that were written and are no longer held."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release() -> None:
    """Gives back to the system what this process has freed: a Python worker outlives its task, and what it keeps counts beside the tasks that follow on its executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only where the C library has it
    if trim:
        trim(0)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; after the last one, or where the reader stops, freed memory is given back."""
    try:
        yield from batches
    finally:
        release()


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once per row, also where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def connected_components(edges: DataFrame, rounds: int = 60, into: Scratch | None = None) -> DataFrame:
    """(node, component) for the undirected edges (a, b): component is the smallest node reachable.

    Alternates large-star and small-star, each a shuffle with a map-side minimum,
    and writes the edges to the shared folder after each pair, so nothing of the
    graph reaches the driver but two sums that tell whether the edges changed. The number
    of edges never grows. Loops are ignored; no edges give no rows. Raises where ``rounds`` do not suffice.
    The last table of edges, which the result reads, becomes one of ``into``.
    """
    scratch = Scratch(edges.sparkSession)
    cur = scratch.written(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        # large star: each node's larger neighbours are linked to its smallest one
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        big = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        big = big.distinct()
        # small star: each node and its smaller neighbours are linked to the smallest one
        least = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        new = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        cur = scratch.written(new, "edges")
        scratch.clear(keep=1)
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    if into:
        into.paths += scratch.paths
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
