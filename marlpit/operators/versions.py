"""Base and delta chains: resolution at query time, materialised snapshots, manifests and sync plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import number_rows


def unsuperseded(rows: DataFrame, superseded: DataFrame, key: str = "stable_key") -> DataFrame:
    """Rows ``(key, seq, ...)`` that no later index of the chain retires, by the last sequence number that retires a key.

    With several corpora, ``key`` must carry the corpus: keys are only unique within one.
    """
    last = superseded.groupBy(key).agg(F.max("seq").alias("_last"))
    return rows.join(last, key, "left").where(F.col("_last").isNull() | (F.col("seq") >= F.col("_last"))).drop("_last")


def newest(rows: DataFrame, key: str = "stable_key") -> DataFrame:
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("seq", "row") if "row" in rest else F.col("seq")).alias("_r")).select(key, *[F.col("_r")[c].alias(c) for c in rest])


def resolve(rows: DataFrame, superseded: DataFrame, key: str = "stable_key") -> DataFrame:
    """The current row of each key of a chain."""
    return newest(unsuperseded(rows, superseded, key), key)


def snapshot(rows: DataFrame, superseded: DataFrame, key: str = "stable_key") -> DataFrame:
    """The chain folded in order: each delta deletes what it supersedes, then puts its rows.  Per key the event of the
    highest sequence number decides; a row beats a tombstone of the same delta."""
    rest = [c for c in rows.columns if c != key]
    events = rows.select(key, F.struct(*rest).alias("_r"), F.col("seq").alias("_s"), F.lit(1).alias("_row"))
    events = events.unionByName(superseded.select(key, F.lit(None).cast(events.schema["_r"].dataType).alias("_r"), F.col("seq").alias("_s"), F.lit(0).alias("_row")))
    last = events.groupBy(key).agg(F.max_by(F.struct("_r", "_row"), F.struct("_s", "_row")).alias("_e"))
    return last.where("_e._row = 1").select(key, *[F.col("_e._r")[c].alias(c) for c in rest])


def sync_plan(desired: DataFrame, indexed: DataFrame, changed: DataFrame, removed: DataFrame, rebuild: bool = False, key: str = "stable_key") -> DataFrame:
    """``key, action``: delete what is indexed and no longer wanted, or was removed; put all when rebuilding, else what
    changed or isn't indexed yet."""
    gone = indexed.select(key).join(desired.select(key), key, "left_anti").unionByName(removed.select(key).join(indexed.select(key), key, "left_semi")).distinct()
    put = desired.select(key)
    if not rebuild:
        put = put.join(changed.select(key), key, "left_semi").unionByName(put.join(indexed.select(key), key, "left_anti")).distinct()
    return gone.withColumn("action", F.lit("delete")).unionByName(put.withColumn("action", F.lit("put")))


def top_by_votes(rows: DataFrame, limit: int) -> DataFrame:
    """The order in which a bounded index takes rows: votes, popularity, title, key."""
    return rows.orderBy(F.col("vote_count").desc(), F.col("popularity").desc(), F.collate("title", "UNICODE"), "stable_key").limit(limit)


def batches(items: DataFrame, order: list, size: int = 250) -> DataFrame:
    """``items`` with their batch in a total order whose first column is numeric and ascending."""
    return number_rows(items, order, "batch").withColumn("batch", F.floor(F.col("batch") / size).cast("long"))


def assets(manifest: DataFrame) -> DataFrame:
    """``version, role, position, name, bytes, sha256`` of a manifest's base, deltas and bundle."""
    one = lambda role, c: manifest.where(F.col(c).isNotNull()).select("version", F.lit(role).alias("role"), F.lit(0).alias("position"), f"{c}.*")
    many = manifest.select("version", F.lit("delta").alias("role"), F.posexplode("deltas").alias("position", "_a")).select("version", "role", F.col("position") + 1, "_a.*")
    return one("base", "base").union(many).union(one("bundle", "bundle"))


def downloads(wanted: DataFrame, installed: DataFrame) -> DataFrame:
    """Assets whose name and hash aren't installed."""
    return wanted.join(installed.select("name", "sha256"), ["name", "sha256"], "left_anti")


def prunable(installed: DataFrame, wanted: DataFrame, own_prefix: str) -> DataFrame:
    """Installed files of ours that the manifest doesn't name; files of others stay."""
    return installed.where(F.col("name").startswith(own_prefix)).join(wanted.select("name"), "name", "left_anti")


def unreferenced(listing: DataFrame, reachable: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(stray, missing)``: published files that no manifest reaches, and named ones that aren't there."""
    named = F.regexp_replace("name", r"\.gz$", "")
    a, b = listing.withColumn("_n", named), reachable.withColumn("_n", named)
    return a.join(b.select("_n"), "_n", "left_anti").drop("_n"), b.join(a.select("_n"), "_n", "left_anti").drop("_n")


def next_chain(chain: DataFrame, adding: DataFrame, is_base: bool) -> DataFrame:
    """The delta chain after publishing: a base resets it, a name that is there already is replaced at the end."""
    if is_base:
        return chain.limit(0)
    top = chain.agg(F.coalesce(F.max("position"), F.lit(-1))).first()[0]
    added = adding.select(*[F.lit(top + 1).cast(chain.schema[c].dataType).alias(c) if c == "position" else F.col(c) for c in chain.columns])
    return chain.join(adding.select("name"), "name", "left_anti").select(*chain.columns).unionByName(added)


def build_manifest(files: DataFrame, version: int, generated_at: str) -> DataFrame:
    """One manifest row from ``files(name, role, position, content)``: names only, never paths."""
    a = files.select("role", "position", F.struct(F.element_at(F.split("name", "/"), -1).alias("name"), F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256")).alias("a"))
    pick = lambda role: F.max_by(F.when(F.col("role") == role, F.col("a")), F.when(F.col("role") == role, F.col("position")))
    deltas = F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == "delta", F.struct("position", "a")))), lambda x: x["a"])
    return a.agg(F.lit(version).cast("long").alias("version"), F.lit(generated_at).alias("generatedAt"), pick("base").alias("base"), deltas.alias("deltas"), pick("bundle").alias("bundle"))


def install_is_fresh(checked_at, now_ms, max_age_ms, files_there):
    """Whether an install may be used without a check: checked before, not too long ago, all files there."""
    return (checked_at > 0) & (now_ms - checked_at <= max_age_ms) & files_there


def last_superseded(superseded: DataFrame) -> DataFrame:
    """``stable_key, last_seq``: up to which part of a chain each retired key is void."""
    return superseded.groupBy("stable_key").agg(F.max("seq").alias("last_seq"))
