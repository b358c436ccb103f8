"""Cross-language merge: rows of one entity, or of one title, become one result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import starts_capitalised
from . import search


def group_keys(rows: DataFrame, entity_map: DataFrame) -> DataFrame:
    """``rows(qid, pos, lang, stable_key, title, ...)`` with ``group_key``: the entity if mapped, else the key that the same
    title, lower-cased, had last among earlier rows of the query, else the title itself."""
    r = rows.join(entity_map.select("lang", "stable_key", "group_id"), ["lang", "stable_key"], "left")
    low = F.lower("title")
    before = W.partitionBy("qid", low).orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    inherited = F.last("group_id", ignorenulls=True).over(before)
    entity = F.coalesce("group_id", inherited)
    return r.withColumn("group_key", F.when(entity.isNotNull(), F.concat(F.lit("entity:"), entity.cast("string"))).otherwise(F.concat(F.lit("title:"), low))).drop("group_id")


def best_per_language(keyed: DataFrame) -> DataFrame:
    """The best row of each query, group and language: score, votes, a capitalised title, the earlier one."""
    order = [F.coalesce("score", F.lit(0.0)).desc(), F.coalesce("vote_count", F.lit(0)).desc(), starts_capitalised(F.col("title")).desc(), F.col("pos")]
    return keyed.withColumn("_n", F.row_number().over(W.partitionBy("qid", "group_key", "lang").orderBy(*order))).where("_n = 1").drop("_n")


def merge_languages(rows: DataFrame, entity_map: DataFrame, siblings: DataFrame, languages: Sequence[str], labels: dict[str, str], limit: int = 10) -> DataFrame:
    """One row per group: the best row, all languages' titles, score, actions and subtitle; ``limit`` by score.

    ``siblings(lang, group_id, title)`` gives titles of languages that the query didn't match.
    """
    best = best_per_language(group_keys(rows, entity_map))
    order = [F.coalesce("score", F.lit(0.0)).desc(), F.coalesce("vote_count", F.lit(0)).desc(), starts_capitalised(F.col("title")).desc(), F.col("pos")]
    own = best.withColumn("_n", F.row_number().over(W.partitionBy("qid", "group_key").orderBy(*order)))
    g = own.groupBy("qid", "group_key").agg(
        F.max_by(F.struct("stable_key", "lang", "title", "pos"), -F.col("_n")).alias("primary"), F.max(F.coalesce("score", F.lit(0.0))).alias("score"), F.map_from_entries(F.collect_list(F.struct("lang", "title"))).alias("titles"),
    )
    g = g.withColumn("_g", F.when(F.startswith("group_key", F.lit("entity:")), F.substring("group_key", 8, 30).cast("long")))
    more = siblings.where(F.col("lang").isin(*languages)).groupBy("group_id").agg(F.map_from_entries(F.collect_list(F.struct("lang", "title"))).alias("_more"))
    g = g.join(more, g["_g"] == more["group_id"], "left").drop("group_id")
    full = F.when(F.col("_more").isNull(), F.col("titles")).otherwise(F.map_concat(F.map_filter("_more", lambda k, v: ~F.map_contains_key("titles", k)), "titles"))
    g = g.withColumn("titles", full)
    others = F.filter(F.array(*[F.lit(x) for x in languages]), lambda x: F.map_contains_key("titles", x) & (x != F.col("primary.lang")))
    names = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]) if labels else None
    label = lambda x: x if names is None else F.coalesce(names[x], x)
    order_all = F.concat(F.array(F.col("primary.lang")), others)
    g = g.withColumn("subtitle", F.array_join(F.transform(order_all, label), " · ")).withColumn("actions", F.transform(order_all, lambda x: F.concat(F.lit("open:"), x)))
    rank = F.row_number().over(W.partitionBy("qid").orderBy(F.col("score").desc(), "primary.pos"))
    return g.withColumn("rank", rank).where(F.col("rank") <= limit).select("qid", "rank", "group_key", F.col("primary.stable_key").alias("stable_key"), F.col("primary.title").alias("title"), F.col("primary.lang").alias("lang"), "titles", "score", "actions", "subtitle")


def pool_size(limit: int) -> int:
    """How many rows each language gives to a merge of ``limit``, and how many candidates it looks at."""
    return max(limit * 3 * 2, 25)


def search_languages(bands: dict[str, tuple[DataFrame, DataFrame]], query: str, entity_map: DataFrame, siblings: DataFrame, labels: dict[str, str], *, now_year: int, limit: int = 10) -> DataFrame:
    """One query over the indexes of several languages, ``bands[lang] = (rows, postings)``, merged to ``limit`` groups.

    Each language gives its best :func:`pool_size` rows out of as many candidates; rows come by score, then by language in
    the order of ``bands``, then by stable key.
    """
    pool, parts = pool_size(limit), []
    for n, (lang, (rows, postings)) in enumerate(bands.items()):
        got = search.search(rows, postings, query, now_year=now_year, limit=pool, candidate_pool=pool)
        parts.append(got.select(F.lit(0).alias("qid"), F.lit(n).alias("_l"), F.lit(lang).alias("lang"), "stable_key", "title", "vote_count", "score"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    # At most the pool of each language: a few hundred rows meet here.
    pos = (F.row_number().over(W.orderBy(F.col("score").desc(), "_l", "stable_key")) - 1).cast("long")
    return merge_languages(every.withColumn("pos", pos).drop("_l"), entity_map, siblings, list(bands), labels, limit)
