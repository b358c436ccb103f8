"""Helpers that the corpus operators share: shared scratch tables, word splitting and connected components."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but space and the ASCII controls tab..carriage return.
WORD_PATTERN = r"[^ \t-\r]+"
_MADE: list[str] = []
#: Tables registered over scratch folders.
_TABLES: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.  Where that is unset, a temporary one in local mode (tests); on a
    cluster each executor would have its own, so that raises."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = os.environ.get("MARLPIT_SCRATCH")
        if not root:
            root = os.environ["MARLPIT_SCRATCH"] = tempfile.mkdtemp(prefix="marlpit-scratch-")
        root = root if "://" in root else f"file://{root}"
    return root.rstrip("/")


def materialise(df: DataFrame, tag: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared scratch folder and read it back.

    This cuts the lineage and survives the loss of any executor.  The files stay until :func:`discard` or :func:`sweep`, or until
    whoever owns the checkpoint folder clears it, because the returned frame is lazy.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/marlpit/{tag}-{uuid.uuid4().hex}"
    _MADE.append(path)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._marlpit_path = path
    return out


def bucketed(df: DataFrame, tag: str, buckets: int, key: str) -> DataFrame:
    """Like :func:`materialise`, but hash-bucketed by ``key``: a later join on it moves only the other side."""
    spark = df.sparkSession
    name = f"{tag}_{uuid.uuid4().hex}"
    path = f"{scratch_root(spark)}/marlpit/{name}"
    _MADE.append(path)
    _TABLES.append(name)
    df.write.bucketBy(buckets, key).option("path", path).format("parquet").saveAsTable(name)
    out = spark.table(name)
    out._marlpit_path = path
    return out


def sweep(spark: SparkSession) -> int:
    """Delete all scratch tables that this driver has made.  For callers, once what they wanted is written elsewhere."""
    n = 0
    while _TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop()}")
    while _MADE:
        path = _MADE.pop()
        with contextlib.suppress(Exception):
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            n += bool(hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True))
    return n


def discard(*frames: DataFrame) -> None:
    """Delete the scratch files behind frames made by :func:`materialise` that no later plan reads."""
    for df in frames:
        path = getattr(df, "_marlpit_path", None)
        if path:
            with contextlib.suppress(Exception):
                jvm = df.sparkSession.sparkContext._jvm
                hadoop = jvm.org.apache.hadoop.fs.Path(path)
                hadoop.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def small(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """``df``, a narrow frame, marked for broadcast if it has at most ``most_rows`` rows; else left to a shuffle join."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def join_first(left: DataFrame, first: DataFrame, key: str, total: int, share: int = 50_000) -> DataFrame:
    """``left`` joined with ``first``, one row a ``key`` with its number of occurrences ``df`` in ``left``.

    A key with more than ``total / share`` of the ``total`` rows of ``left`` is hot; fewer than ``share`` keys can be, so
    these are broadcast and their rows stay where they are, the others are joined by a shuffle.
    """
    limit = max(200, total // share)
    hot = materialise(first.where(F.col("df") > limit), "hot")
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(first.where(F.col("df") <= limit), key)
    return left.join(F.broadcast(hot), key).unionByName(rest)


def word_hashes(text: bytes | None) -> np.ndarray:
    """64-bit hashes of the words of a text, A-Z lower-cased."""
    words = (text or b"").lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Smallest node reachable from every node of ``edges(a long, b long)``: rows ``(node, component)``.

    Alternating large-star and small-star steps (Kiveris et al., 2014).  Every step is a grouped minimum with map-side
    combine and an equi-join, so the driver sees two sums a round and no task holds a whole component.  Nodes without an
    edge to another node don't appear.  Raises if the rounds don't suffice, rather than return split components.
    """
    spark = edges.sparkSession

    def both(e: DataFrame) -> DataFrame:
        return e.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")

    cur = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    sig = None
    for _ in range(max_rounds):
        sym = both(cur)
        low = sym.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = sym.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialise(large, "cc")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        nxt = materialise(small, "cc")
        discard(cur, large)
        cur = nxt
        row = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (row[0], row[1]) == sig:
            return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        sig = (row[0], row[1])
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
