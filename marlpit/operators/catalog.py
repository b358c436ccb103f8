"""Catalogue state: latest record per key, content band, liveness, delta selection, work queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions import records as R
from ..functions.text import fold_text, tokenize
from ..sources import files

KEY = ["media_type", "id"]


def latest(log: DataFrame, key: list[str] | None = None, seq: str = "_ingest_seq") -> DataFrame:
    """The last record of each key, with ``first_position`` (the sequence number at which the key first came).

    One shuffle: ``max_by`` and ``min`` combine on the map side, so that a key with many versions moves one row a task.
    """
    key = key or KEY
    rest = [c for c in log.columns if c not in key]
    agg = log.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_r"), F.min(seq).alias("first_position"))
    return agg.select(*key, *[F.col("_r")[c].alias(c) for c in rest], "first_position")


def in_band(votes: Column, rt: Column, imdb: Column, least_votes: int = 5) -> Column:
    """Whether a record is worth indexing: votes enough, or a critics' or audience score, be it zero."""
    return (votes >= least_votes) | rt.isNotNull() | imdb.isNotNull()


def band(records: DataFrame, least_votes: int = 5) -> DataFrame:
    return records.where(in_band(F.col("vote_count"), F.col("rt_score"), F.col("imdb_rating"), least_votes))


def band_counts(records: DataFrame, least_votes: int = 5) -> DataFrame:
    inside = F.coalesce(in_band(F.col("vote_count"), F.col("rt_score"), F.col("imdb_rating"), least_votes), F.lit(False))
    return records.groupBy("media_type").agg(F.count_if(inside).alias("kept"), F.count_if(~inside).alias("dropped"))


def live(records: DataFrame, export: DataFrame | None, key: list[str] | None = None) -> DataFrame:
    """Records whose key the export lists, adult titles left out; without an export, all."""
    return records if export is None else records.join(export.where(~F.col("adult")).select(*(key or KEY)), key or KEY, "left_semi")


def unseen(export: DataFrame, records: DataFrame, key: list[str] | None = None) -> DataFrame:
    return export.where(~F.col("adult")).join(records.select(*(key or KEY)), key or KEY, "left_anti")


def retitled(export: DataFrame, records: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Keys whose original title in the export is there, once trimmed, and differs from the stored one."""
    key = key or KEY
    new = export.select(*key, F.trim("original_title").alias("new_title")).where("new_title <> ''")
    return new.join(records.select(*key, "original_title"), key).where(~F.col("new_title").eqNullSafe(F.trim("original_title")))


def stalest(records: DataFrame, n: int, but: DataFrame | None = None, key: list[str] | None = None) -> DataFrame:
    """The ``n`` records fetched longest ago (never counts as zero); ties by key."""
    key = key or KEY
    pool = records if but is None else records.join(but.select(*key), key, "left_anti")
    return pool.orderBy(F.coalesce("fetched_at", F.lit(0)), *key).limit(n)


def plan_daily_update(records: DataFrame, export: DataFrame, refetch: int = 5000, max_new: int = 0) -> DataFrame:
    """``media_type, id, reason``: what to fetch today: new ids, retitled ones and the stalest of the rest.

    Adult rows of the export are left out row by row: one whose key another row lists as not adult retitles nothing.
    """
    new = unseen(export, records).orderBy(F.col("popularity").desc(), *KEY)
    new = new.limit(max_new) if max_new else new
    renamed = retitled(export.where(~F.col("adult")), records)
    stale = stalest(live(records, export), refetch, renamed)
    parts = [(new, "new"), (renamed, "retitled"), (stale, "stale")]
    out = None
    for df, why in parts:
        df = df.select(*KEY, F.lit(why).alias("reason"))
        out = df if out is None else out.unionByName(df)
    return out


def delta(records: DataFrame, export: DataFrame | None, since: int, least_votes: int = 5) -> tuple[DataFrame, DataFrame]:
    """``(rows, superseded)``: what a delta since a marker ships and which stable keys it retires.

    A record that isn't live any more is retired only; one touched since is retired and, if in the band, shipped anew.
    """
    keyed = records.withColumn("stable_key", R.stable_key(F.col("media_type"), F.col("id")))
    touched = F.coalesce("fetched_at", F.lit(0)) > since
    if export is None:
        alive = keyed.withColumn("_live", F.lit(True))
    else:
        alive = keyed.join(export.where(~F.col("adult")).select(*KEY).distinct().withColumn("_in", F.lit(True)), KEY, "left").withColumn("_live", F.col("_in").isNotNull()).drop("_in")
    superseded = alive.where(~F.col("_live") | touched).select("stable_key").distinct()
    rows = alive.where(F.col("_live") & touched & in_band(F.col("vote_count"), F.col("rt_score"), F.col("imdb_rating"), least_votes)).drop("_live")
    return rows, superseded


def next_mode(marker: Column, requested_base: Column, chain: Column, longest: int = 30) -> Column:
    """Whether to build a base or a delta: base without a marker, on request, or when the chain is long."""
    return F.when(marker.isNull() | F.coalesce(requested_base, F.lit(False)) | (chain >= longest), F.lit("base")).otherwise(F.lit("delta"))


def api_record(payload: DataFrame) -> DataFrame:
    """API answers (struct columns as delivered) as records: names fall back, years are cut from dates, numbers default to 0."""
    return payload.select(
        "media_type",
        "id",
        F.coalesce("title", "name").alias("title"),
        F.coalesce("original_title", "original_name").alias("original_title"),
        R.year_of(F.coalesce("release_date", "first_air_date")).alias("year"),
        F.coalesce(F.col("popularity").cast("double"), F.lit(0.0)).alias("popularity"),
        F.coalesce(F.col("vote_count").cast("long"), F.lit(0)).alias("vote_count"),
        F.coalesce("poster_path", F.lit("")).alias("poster_path"),
        F.coalesce("imdb_id", F.lit("")).alias("imdb_id"),
    )


def missing_id_queue(records: DataFrame, limit: int = 0) -> DataFrame:
    """Series without an external id, most voted first."""
    q = records.where((F.col("media_type") == "tv") & (F.coalesce(F.trim("imdb_id"), F.lit("")) == "")).orderBy(F.col("vote_count").desc(), "id")
    return q.limit(limit) if limit else q


def rating_queue(records: DataFrame, now_ms: int, this_year: int, refresh_days: int = 30, top: int = 5000, budget: int = 1000, least_votes: int = 5) -> DataFrame:
    """Records to ask ratings for: never asked first by votes, then stale ones, oldest first; cut to ``top`` and ``budget``.

    Only what can still change goes stale: it has a critics' score or is recent; the window is a quarter for the last years.
    """
    rated = F.col("rt_score").isNotNull() | F.col("metacritic_score").isNotNull()
    window = F.when(F.col("year") >= this_year - 2, F.lit(max(1.0, refresh_days / 4))).otherwise(F.lit(float(refresh_days)))
    changes = rated | (F.col("year") >= this_year - 1)
    fresh = F.col("ratings_at").isNull()
    stale = changes & ((F.lit(now_ms) - F.col("ratings_at")) > window * 86_400_000)
    able = (in_band(F.col("vote_count"), F.col("rt_score"), F.col("imdb_rating"), least_votes) | (F.col("year") >= this_year - 1)) & (F.trim("imdb_id") != "")
    order = [fresh.desc(), F.when(fresh, F.col("vote_count")).desc_nulls_last(), F.col("ratings_at"), F.col("media_type"), F.col("id")]
    return records.where(able & (fresh | stale)).orderBy(*order).limit(min(top, budget))


def rating_changes(records: DataFrame, ratings: DataFrame, now_ms: int) -> DataFrame:
    """Records whose audience rating the dump changes, stamped so that the next delta takes them up."""
    r = ratings.select("imdb_id", F.col("imdb_rating").alias("_new"))
    return records.join(r, "imdb_id").where(~F.col("imdb_rating").eqNullSafe(F.col("_new"))).withColumn("imdb_rating", F.col("_new")).withColumn("fetched_at", F.lit(now_ms)).select(*records.columns)


def index_rows(records: DataFrame, order: str = "first_position") -> DataFrame:
    """Index rows: titles fall back to original titles, untitled records go, rows are numbered from 0 in ``order``.

    Numbers come from a range-partitioned sort and per-partition offsets, not from one task.
    """
    title = F.coalesce(F.nullif("title", F.lit("")), F.nullif("original_title", F.lit("")))
    titled = records.withColumn("title", title).where("title is not null").withColumn("stable_key", R.stable_key(F.col("media_type"), F.col("id")))
    # Folded once here, so that a search compares and never folds.
    titled = titled.withColumns({"title_folded": fold_text(F.col("title")), "original_folded": fold_text(F.col("original_title"))})
    return number_rows(titled, [F.col(order), F.col("stable_key")], "row")


def number_rows(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with a gapless number from 0 in a total order, without sorting it in one task: ranges are sorted and counted,
    and a row's number is its place behind the ranges before."""
    kept = in_ranges(df, order)
    sizes = kept.groupBy("_p").agg(F.count("*").alias("_n"))
    starts = sizes.select("_p", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_s"))  # a row a range
    return kept.join(F.broadcast(starts), "_p").withColumn(name, (F.col("_s") + F.col("_at")).cast("long")).drop("_p", "_at", "_s")


def in_ranges(df: DataFrame, order: list) -> DataFrame:
    """``df`` sorted by ranges of all of ``order``, as many as there are shuffle partitions: ``_p`` is a row's range, ``_at``
    its place there from 0.  Written once, as the bounds are drawn anew whenever such a plan runs."""
    spark = df.sparkSession
    at = files.scratch(spark, "ranges")
    n = F.monotonically_increasing_id()
    df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range_at", n).write.parquet(at)
    kept = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("_range_at", T.LongType())])).parquet(at)
    return kept.withColumn("_p", F.shiftright("_range_at", 33)).withColumn("_at", F.col("_range_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_range_at")


def postings(rows: DataFrame) -> DataFrame:
    """``term, row``, distinct: folded tokens of title and original title, and the year if known."""
    terms = F.concat(tokenize(folded(rows, "title")), tokenize(folded(rows, "original")), F.when(F.col("year") > 0, F.array(F.col("year").cast("string"))).otherwise(F.array().cast("array<string>")))
    return rows.select(F.explode(F.array_distinct(terms)).alias("term"), "row")


def folded(rows: DataFrame, which: str) -> Column:
    """The folded ``title`` or ``original`` title: stored with the index, else folded here."""
    name = f"{which}_folded"
    return F.col(name) if name in rows.columns else fold_text(F.col("title" if which == "title" else "original_title"))


def term_frequencies(posts: DataFrame) -> DataFrame:
    """``term, df, offset``: how many rows hold a term, and where its postings begin in term order."""
    df = posts.groupBy("term").agg(F.count("*").alias("df")).withColumn("_p", F.left("term", F.lit(2)))
    # Running sums by the first two characters, then within them: no task orders the whole vocabulary.
    heads = df.groupBy("_p").agg(F.sum("df").alias("_n"))
    before = heads.select("_p", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    within = F.coalesce(F.sum("df").over(W.partitionBy("_p").orderBy("term").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("_w", within).join(before, "_p").select("term", "df", (F.col("_b") + F.col("_w")).cast("long").alias("offset"))
