"""Sinks: the append log, versioned rewrites, index tables and batch pushes."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators.catalog import number_rows
from .readers import exists


def append_records(records: DataFrame, path: str) -> None:
    """Append to the Parquet log.  New rows continue the ingest sequence; one writer at a time."""
    spark = records.sparkSession
    top = spark.read.parquet(path).agg(F.max("_ingest_seq")).first()[0] if exists(spark, path) else None
    base = -1 if top is None else int(top)
    numbered = records.withColumn("_ingest_seq", F.monotonically_increasing_id() + base + 1)
    numbered.write.mode("append").parquet(path)


def rewrite(df: DataFrame, root: str) -> str:
    """Write a whole new version beside the old ones and return its path; what is being read is never overwritten."""
    path = f"{root.rstrip('/')}/v{time.time_ns()}"
    df.write.parquet(path)
    return path


def write_index(rows: DataFrame, postings: DataFrame, superseded: DataFrame, path: str) -> None:
    """Index tables.  Postings are range-partitioned and sorted by term, so that a prefix reads few row groups."""
    rows.write.mode("errorifexists").parquet(f"{path}/rows")
    postings.repartitionByRange("term").sortWithinPartitions("term", "row").write.mode("errorifexists").parquet(f"{path}/postings")
    superseded.write.mode("errorifexists").parquet(f"{path}/superseded")
    rows.sparkSession.createDataFrame([(schema.INDEX_FORMAT_VERSION,)], "format_version int").coalesce(1).write.mode("errorifexists").json(f"{path}/format")


def open_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    got = spark.read.schema("format_version int").json(f"{path}/format").first()
    if got is None or got[0] != schema.INDEX_FORMAT_VERSION:
        raise ValueError(f"index format {got[0] if got else None}, not {schema.INDEX_FORMAT_VERSION}: {path}")
    return tuple(spark.read.parquet(f"{path}/{t}") for t in ("rows", "postings", "superseded"))


def write_entity_map(entity_map: DataFrame, path: str) -> None:
    entity_map.repartition("lang").sortWithinPartitions("lang", "stable_key").write.partitionBy("lang").mode("errorifexists").parquet(path)


def write_views(sample: DataFrame, meta: dict, path: str) -> None:
    sample.write.mode("errorifexists").json(f"{path}/views")
    sample.sparkSession.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/meta")


def push_batches(items: DataFrame, order: list, push: Callable[[int, list], None], size: int = 250, done: int = -1) -> int:
    """Hand ``items`` to ``push(batch, rows)`` on the executors, ``size`` at a time in a total order (its first column
    numeric and ascending), batches up to ``done`` skipped; returns the number of batches.  ``push`` must be idempotent per batch: tasks may run again."""
    numbered = number_rows(items, order, "_batch").withColumn("_batch", F.floor(F.col("_batch") / size).cast("int"))
    last = numbered.agg(F.max("_batch")).first()[0]

    def each(rows) -> None:
        batch, held = None, []
        for r in rows:
            if r["_batch"] != batch and held:
                push(batch, held)
                held = []
            batch = r["_batch"]
            held.append(r)
        if held:
            push(batch, held)

    numbered.where(F.col("_batch") > done).repartition("_batch").sortWithinPartitions("_batch").foreachPartition(each)
    return 0 if last is None else last + 1


def fingerprint_of(items: DataFrame) -> str:
    """Tells one set of items from another: their number and the sum of their hashes."""
    n, total = items.agg(F.count("*"), F.sum(F.xxhash64(*items.columns).cast("decimal(38,0)"))).first()
    return f"{n}:{total}"


def resume_point(spark: SparkSession, path: str, fingerprint: str) -> int:
    """The last batch that was pushed of the items with this fingerprint; -1 if none, or if the items are others now."""
    from .readers import document

    got = document(spark, path) or {}
    return int(got["done"]) if got.get("fingerprint") == fingerprint else -1


def mark_pushed(spark: SparkSession, path: str, fingerprint: str, done: int) -> None:
    spark.createDataFrame([(json.dumps({"fingerprint": fingerprint, "done": done}),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_sampled(records: DataFrame, dropped: DataFrame, sampled: dict, root: str) -> str:
    """A new version of the sampled store with its sidecars: what went since the last one, and what was sampled."""
    path = rewrite(records, f"{root}/store")
    dropped.write.parquet(f"{path}-dropped")
    records.sparkSession.createDataFrame([(json.dumps(sampled),)], "value string").coalesce(1).write.text(f"{path}-sampled")
    return path
