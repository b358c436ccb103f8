"""Whole builds: base and delta indexes, encyclopedia bands, entity maps, publishing and installing."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .. import schema
from ..functions import records as R
from ..operators import catalog, versions, wiki
from ..sources import files, readers, sinks


def build_base(log: DataFrame, export: DataFrame | None, path: str, least_votes: int = 5) -> DataFrame:
    """Latest records, live ones, the band, indexed and written to ``path``; returns the index rows."""
    spark = log.sparkSession
    rows = catalog.index_rows(catalog.band(catalog.live(catalog.latest(log), export), least_votes))
    sinks.write_index(rows, catalog.postings(rows), spark.createDataFrame([], "stable_key long"), path)
    return sinks.open_index(spark, path)[0]


def build_delta(log: DataFrame, export: DataFrame | None, since: int, path: str, least_votes: int = 5) -> DataFrame:
    rows, gone = catalog.delta(catalog.latest(log), export, since, least_votes)
    rows = catalog.index_rows(rows)
    sinks.write_index(rows, catalog.postings(rows), gone, path)
    return sinks.open_index(log.sparkSession, path)[0]


def build_band(records: DataFrame, path: str, budget: int, start: int = 150_000) -> int:
    """Index at ``path/index`` as many of the most popular records as fill ``budget`` bytes of Parquet; returns how many.
    What was built on the way is deleted."""
    spark = records.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    built: dict[int, str] = {}

    def measure(n: int) -> int:
        at = f"{path}/try-{len(built)}-{n}"
        built[n] = at
        top = records.orderBy(F.col("popularity").desc(), "id").limit(n).withColumn("first_position", -F.col("popularity"))
        rows = catalog.index_rows(top)
        sinks.write_index(rows, catalog.postings(rows), spark.createDataFrame([], "stable_key long"), at)
        p = hadoop(at)
        return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()

    n = wiki.fit_budget(records, measure, budget, start)
    if n not in built:
        measure(n)
    files.rename(spark, built.pop(n), f"{path}/index")
    for other in built.values():
        files.delete(spark, other)
    return n


def build_wiki_delta(records: DataFrame, dropped: DataFrame, since: str, path: str) -> DataFrame:
    rows, gone = wiki.wiki_delta(records, dropped, since)
    rows = catalog.index_rows(wiki.shipping(rows).withColumn("first_position", F.monotonically_increasing_id()))
    sinks.write_index(rows, catalog.postings(rows), gone, path)
    return sinks.open_index(records.sparkSession, path)[0]


def build_entity_map(bands: DataFrame, bindings: DataFrame, head: int, path: str) -> DataFrame:
    """Groups of the ``head`` most read pages of each language's band, as ``lang, stable_key, group_id, title``."""
    top = wiki.top_per_language(bands.withColumn("views", F.col("vote_count")), head)
    groups = wiki.entity_groups(bindings, top.select("lang", "title", "stable_key"))
    sinks.write_entity_map(groups.select("lang", "stable_key", "group_id", "title"), path)
    return bands.sparkSession.read.parquet(path)


def chain_tables(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(rows, postings, superseded)`` of a base and its deltas, in order, with ``seq``; row numbers made unique."""
    out = None
    for seq, path in enumerate(paths):
        rows, post, gone = sinks.open_index(spark, path)
        shift = F.lit(seq << 40)
        part = (rows.withColumn("seq", F.lit(seq)).withColumn("row", F.col("row") + shift), post.withColumn("row", F.col("row") + shift), gone.withColumn("seq", F.lit(seq)))
        out = part if out is None else tuple(a.unionByName(b, allowMissingColumns=True) for a, b in zip(out, part, strict=True))
    if out is None:
        raise ValueError("a chain needs a base")
    return out


def read_marker(spark: SparkSession, path: str) -> int | str | None:
    got = readers.document(spark, path)
    return None if got is None else got.get("since")


def advance_marker(spark: SparkSession, path: str, since: int | str) -> None:
    """Move the high-water mark; to be called only after the publication it stands for is complete."""
    spark.createDataFrame([(json.dumps({"since": since}),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def publish_version(spark: SparkSession, root: str, files: DataFrame, version: int, generated_at: str) -> tuple[DataFrame, DataFrame]:
    """Publish ``files(name, role, position, content)`` that lie under ``root``: the manifest is written last and names
    only what is there.  Returns ``(manifest, stray)``; raises, after writing the trimmed manifest, if anything is missing."""
    listing = spark.read.format("binaryFile").load(f"{root}/assets").select(F.element_at(F.split("path", "/"), -1).alias("name"))
    stray, missing = versions.unreferenced(listing, files.select(F.element_at(F.split("name", "/"), -1).alias("name")))
    lost = [r.name for r in missing.collect()]
    there = files.where(~F.element_at(F.split("name", "/"), -1).isin(lost)) if lost else files
    versions.build_manifest(there, version, generated_at).coalesce(1).write.mode("overwrite").json(f"{root}/manifest")
    if lost:
        raise RuntimeError(f"not published: {', '.join(sorted(lost))}")
    return spark.read.schema(schema.MANIFEST).json(f"{root}/manifest"), stray


def install_plan(manifest: DataFrame, installed: DataFrame, own_prefix: str) -> tuple[DataFrame, DataFrame]:
    """``(downloads, prunable)`` of a client against a manifest; a delta that is named but not there is skipped by the
    caller, a missing base is fatal."""
    wanted = versions.assets(manifest).where("role <> 'bundle'")
    return versions.downloads(wanted, installed), versions.prunable(installed, wanted, own_prefix)


def snapshot_of(spark: SparkSession, paths: list[str], limit: int | None = None) -> DataFrame:
    """The chain folded into current rows, the most voted ``limit`` of them."""
    rows, _, gone = chain_tables(spark, paths)
    current = versions.snapshot(rows, gone.select("stable_key", "seq"))
    return versions.top_by_votes(current, limit) if limit else current


def stable_keys(records: DataFrame) -> DataFrame:
    return records.select(R.stable_key(F.col("media_type"), F.col("id")).alias("stable_key"))


def local_manifest(spark: SparkSession, paths: str, version: int, generated_at: str) -> DataFrame:
    """A manifest of index files that lie in ``paths`` (a glob): the first by name is the base, the others its deltas."""
    there = spark.read.format("binaryFile").load(paths).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    position = (F.row_number().over(W.orderBy("name")) - 1).cast("int")  # a row a file
    listed = there.withColumn("position", position).withColumn("role", F.when(F.col("position") == 0, "base").otherwise("delta"))
    return versions.build_manifest(listed, version, generated_at)


def install(spark: SparkSession, manifest: DataFrame, source: str, target: str, own_prefix: str, now_ms: int) -> dict[str, str]:
    """Bring the folder ``target`` to what ``manifest`` names: changed files are copied from ``source`` under temporary
    names, their hashes are checked, own files that are no longer named go, and a record of all is written last.

    A delta that isn't there is skipped; a missing base, or a wrong hash, raises and leaves the files as they were, but for
    those that are complete.  Returns the names and hashes installed.
    """
    before = (readers.document(spark, f"{target}/installed.json") or {}).get("files", {})
    wanted = {r.name: r for r in versions.assets(manifest).where("role <> 'bundle'").collect()}  # a row a file of a release
    have = spark.createDataFrame(list(before.items()), "name string, sha256 string")
    new, old = install_plan(manifest, have, own_prefix)
    now = {n: h for n, h in before.items() if n in wanted and wanted[n].sha256 == h}
    for r in sorted(new.collect(), key=lambda r: r.name):
        if not readers.exists(spark, f"{source}/{r.name}"):
            if wanted[r.name].role == "base":
                raise FileNotFoundError(r.name)
            continue
        part = f"{target}/{r.name}.new"
        files.copy(spark, f"{source}/{r.name}", part)
        got = spark.read.format("binaryFile").load(part).select(F.sha2("content", 256)).first()[0]
        if got != r.sha256:
            files.delete(spark, part)
            raise ValueError(f"{r.name} has another hash than the manifest says")
        files.rename(spark, part, f"{target}/{r.name}")
        now[r.name] = r.sha256
    for r in old.collect():
        files.delete(spark, f"{target}/{r.name}")
    files.write_bytes(spark, f"{target}/installed.json", json.dumps({"files": now, "checkedAt": now_ms}).encode())
    return now


def save_snapshot(rows: DataFrame, seq: int, root: str) -> None:
    """Current rows of a chain, and up to which part of it they go; the control row is written last."""
    path = sinks.rewrite(rows, f"{root}/rows")
    files.write_bytes(rows.sparkSession, f"{root}/snapshot.json", json.dumps({"path": path, "seq": seq}).encode())


def load_snapshot(spark: SparkSession, root: str) -> tuple[DataFrame, int] | None:
    """What :func:`save_snapshot` last completed, or nothing."""
    got = readers.document(spark, f"{root}/snapshot.json")
    return None if got is None else (spark.read.parquet(got["path"]), int(got["seq"]))
