"""Encyclopedia bands: daily view samples, decayed popularity, deltas, byte budgets, entity groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import records as R
from ..functions.text import fnv31
from .catalog import in_ranges, number_rows

#: Namespaces whose pages count as articles.
CONTENT_NAMESPACES = ("Anexo:", "Appendix:")


def articles(views: DataFrame, namespaces: DataFrame) -> DataFrame:
    """Views without the pages of other namespaces; ``namespaces(lang, prefix)`` has prefixes with their colon."""
    other = namespaces.where(~F.col("prefix").isin(*CONTENT_NAMESPACES)).select("lang", F.col("prefix").alias("_ns"))
    return views.withColumn("_ns", R.namespace_of(F.col("title"))).join(other, ["lang", "_ns"], "left_anti").drop("_ns")


def sum_views(views: DataFrame) -> DataFrame:
    return views.groupBy("lang", "title").agg(F.sum("views").alias("views"))


def top_per_language(sums: DataFrame, keep: int) -> DataFrame:
    """The most read titles of each language with their rank; ties by title.

    Window top-k prunes groups on the map side (WindowGroupLimit), so a hot language doesn't sort in full in one task.
    """
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.col("views").desc(), "title"))
    return sums.withColumn("rank", rank).where(F.col("rank") <= keep)


def floor_histogram(sums: DataFrame, floors: Sequence[int] = (1, 2, 5, 20, 100)) -> DataFrame:
    return sums.groupBy("lang").agg(*[F.count_if(F.col("views") >= f).alias(f"at_least_{f}") for f in floors])


def hourly_counters(views: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows sampled and excluded by hour."""
    a = views.groupBy("hour_file").agg(F.count("*").alias("sampled"))
    b = kept.groupBy("hour_file").agg(F.count("*").alias("kept"))
    return a.join(b, "hour_file", "left").select("hour_file", "sampled", (F.col("sampled") - F.coalesce("kept", F.lit(0))).alias("excluded"))


def fold_day(store: DataFrame, sample: DataFrame, keys: DataFrame, date: str, previous_date: str | None) -> tuple[DataFrame, DataFrame]:
    """``(store, dropped)`` after a day: ``sample(lang, title, views)`` against ``store`` of wiki records.

    Popularity decays over the gap; a record is changed if it is new, its id moved or its octave differs.  Titles outside
    the sample are dropped, not carried.
    """
    old = store.select("lang", "title", F.col("id").alias("_id"), F.col("popularity").alias("_pop"), F.col("changed_on").alias("_on"))
    s = sample.select("lang", F.translate("title", "_", " ").alias("title"), "views").join(keys.select("lang", "title", "qid"), ["lang", "title"], "left")
    s = s.withColumn("id", F.coalesce("qid", fnv31(F.concat_ws(":", "lang", "title")))).join(old, ["lang", "title"], "left")
    days = R.gap_days(F.lit(previous_date), F.lit(date))
    pop = R.decay(F.col("_pop"), F.col("views"), days)
    changed = F.col("_id").isNull() | (F.col("_id") != F.col("id")) | (R.strength(F.col("_pop")) != R.strength(pop))
    out = s.select(
        F.lit("movie").alias("media_type"), "id", "lang", "title", F.concat("lang", F.lit(".wikipedia.org")).alias("original_title"), F.lit(0).alias("year"), pop.alias("popularity"), F.ceil(pop).cast("long").alias("vote_count"),
        F.when(F.col("_id").isNotNull() & (F.col("_id") != F.col("id")), F.col("_id")).alias("prev_id"), F.when(changed, F.lit(date)).otherwise(F.coalesce("_on", F.lit(""))).alias("changed_on"),
    )
    dropped = store.select("lang", "title", "id").join(out.select("lang", "title"), ["lang", "title"], "left_anti")
    return out, dropped


def id_collisions(records: DataFrame) -> DataFrame:
    return records.groupBy("lang").agg((F.count("*") - F.count_distinct("id")).alias("collisions"))


def shipping(records: DataFrame) -> DataFrame:
    """What is published of popularity: its octave, in both columns."""
    level = R.strength(F.col("popularity"))
    return records.withColumns({"popularity": level.cast("double"), "vote_count": level})


def wiki_delta(records: DataFrame, dropped: DataFrame, since: str) -> tuple[DataFrame, DataFrame]:
    """``(rows, superseded)`` since a date marker ('' takes all with a change date)."""
    touched = records.where((F.coalesce("changed_on", F.lit("")) != "") & (F.col("changed_on") > since))
    key = lambda c: (F.col(c).cast("long") * 2).alias("stable_key")
    gone = touched.select(key("id")).union(touched.where("prev_id is not null").select(key("prev_id"))).union(dropped.select(key("id"))).distinct()
    return touched, gone


def budget_prefix(records: DataFrame, size: str, budget: int) -> DataFrame:
    """The most popular records that fit a byte budget, in popularity order (ties by id).

    Running sums by ranges of that order: range totals first, then a window within each range, so no task orders everything.
    """
    r = in_ranges(records, [F.col("popularity").desc(), F.col("id")])
    totals = r.groupBy("_p").agg(F.sum(size).alias("_t"))
    before = totals.select("_p", F.coalesce(F.sum("_t").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_b"))  # a row a range
    run = F.sum(size).over(W.partitionBy("_p").orderBy("_at").rowsBetween(W.unboundedPreceding, 0))
    return r.withColumn("_run", run).join(F.broadcast(before), "_p").withColumn("running_bytes", F.col("_b") + F.col("_run")).where(F.col("running_bytes") <= budget).drop("_p", "_at", "_run", "_b")


def fit_budget(records: DataFrame, measure, budget: int, start: int = 150_000, tolerance: float = 0.03, tries: int = 5) -> int:
    """How many of the most popular records fill ``budget`` bytes as ``measure(n)`` finds them: build, measure, rescale."""
    n, total = start, records.count()
    for _ in range(tries):
        n = max(1, min(n, total))
        got = measure(n)
        if abs(got - budget) <= tolerance * budget or (n == total and got <= budget):
            break
        n = int(n * budget / max(got, 1))
    return min(n, total)


def entity_groups(bindings: DataFrame, bands: DataFrame) -> DataFrame:
    """``group_id, item, lang, stable_key, title``: items whose pages at least two languages' bands hold, numbered in the
    order in which they are first seen."""
    hit = bindings.join(bands, ["lang", "title"])
    per = hit.groupBy("item").agg(F.count_distinct("lang").alias("_n"), F.min("position").alias("_first")).where("_n >= 2")
    ids = number_rows(per, [F.col("_first"), F.col("item")], "n").select("item", (F.col("n") + 1).alias("group_id"))
    return hit.join(ids, "item").select("group_id", "item", "lang", "stable_key", "title")


def entity_stats(groups: DataFrame) -> DataFrame:
    """Number of groups, of groups named alike and differently, and of rows in them."""
    per = groups.groupBy("group_id").agg(F.count_distinct(F.lower("title")).alias("names"), F.count("*").alias("rows"))
    return per.agg(F.count("*").alias("groups"), F.count_if(F.col("names") == 1).alias("same_title"), F.count_if(F.col("names") > 1).alias("other_title"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))


def coverage(bands: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, coverage``: the share of each band's rows that have an entity."""
    g = groups.select("lang", "stable_key").distinct().withColumn("_has", F.lit(1.0))
    return bands.join(g, ["lang", "stable_key"], "left").groupBy("lang").agg(F.avg(F.coalesce("_has", F.lit(0.0))).alias("coverage"))


def outcomes(events: DataFrame) -> DataFrame:
    """``kind, outcome, n``."""
    return events.groupBy("kind", "outcome").agg(F.count("*").alias("n"))


def latencies(samples: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Number, percentiles and maximum of ``value``: the element at ``floor(share * n)`` of the sorted values of a group.

    Equal values are counted first, so that a group is as many rows as it has different values.
    """
    counts = samples.groupBy(by, value).agg(F.count("*").alias("_c"))
    n = counts.groupBy(by).agg(F.sum("_c").alias("n"), F.max(value).alias("top"))
    upto = F.sum("_c").over(W.partitionBy(by).orderBy(value))
    at = counts.withColumn("_upto", upto).join(F.broadcast(n), by)
    pick = lambda p: F.min(F.when(F.col("_upto") > F.floor(F.lit(p) * F.col("n")), F.col(value)))
    return at.groupBy(by).agg(F.first("n").alias("n"), *[pick(p).alias(c) for c, p in shares.items()], F.first("top").alias("top"))


def pending_keys(titles: DataFrame, asked: DataFrame, chunk: int = 1000, limit: int = 0) -> DataFrame:
    """Titles not asked for yet, most read first, with the chunk each is asked in."""
    p = titles.join(asked.select("lang", "title"), ["lang", "title"], "left_anti").orderBy(F.col("views").desc(), "lang", "title")
    p = p.limit(limit) if limit else p
    return number_rows(p, [-F.col("views"), F.col("lang"), F.col("title")], "chunk").withColumn("chunk", F.floor(F.col("chunk") / chunk).cast("long"))


def churn(levels: DataFrame) -> DataFrame:
    """Share of days on which a title's published level differs from the day before: ``levels(title, day, level)``."""
    prev = F.lag("level").over(W.partitionBy("title").orderBy("day"))
    return levels.withColumn("_p", prev).where("_p is not null").groupBy("day").agg(F.avg((F.col("level") != F.col("_p")).cast("double")).alias("churn"))


def level_history(daily: DataFrame) -> DataFrame:
    """``title, day, popularity, level`` from ``daily(title, day, views)``: the decay recurrence folded over each title's
    days in order, inside the engine (an array per title, bounded by the number of days)."""
    seq = daily.groupBy("title").agg(F.sort_array(F.collect_list(F.struct("day", "views"))).alias("d"))

    def step(acc, x):
        last = F.element_at(acc, -1)
        gap = F.coalesce(F.when(F.datediff(x["day"], last["day"]) > 0, F.datediff(x["day"], last["day"])), F.lit(1))
        pop = F.when(F.size(acc) == 0, F.greatest(F.lit(0.0), x["views"].cast("double"))).otherwise(R.decay(last["popularity"], x["views"].cast("double"), gap))
        return F.concat(acc, F.array(F.struct(x["day"].alias("day"), pop.alias("popularity"))))

    empty = F.array().cast("array<struct<day:date,popularity:double>>")
    out = seq.select("title", F.explode(F.aggregate("d", empty, step)).alias("x")).select("title", "x.day", "x.popularity")
    return out.withColumn("level", R.strength(F.col("popularity")))
