"""Addresses: the image allow-list, date stamps of dumps, the native item projection and the fallback row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def thumbnail_request(url: Column, origin: str = "https://image.tmdb.org", prefix: str = "/t/p/w185/", path: str = "/v1/poster") -> Column:
    """Verdict on a thumbnail request, as struct<status int, filename string, size string>.

    200 only for ``path`` with one ``url`` and at most ``size`` (square or portrait) whose source is https at ``origin``
    under ``prefix``, a bare image file name without user, port, query or fragment.
    """
    query = F.coalesce(F.parse_url(url, F.lit("QUERY")), F.lit(""))
    keys = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.split(p, "=")[0])
    arg = lambda k: F.try_url_decode(F.nullif(F.regexp_extract(query, rf"(?:^|&){k}=([^&]*)", 1), F.lit("")))
    count = F.size(F.filter(keys, lambda k: k == "url"))
    source, size = arg("url"), F.coalesce(arg("size"), F.lit("square"))
    shape = F.regexp_like(source, F.lit(r"^https://[^/@:?#\s]+/[^?#\s]*$"))
    name = F.substring(source, len(origin + prefix) + 1, 2000)
    status = (
        F.when((F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit("")) != path) | (count != 1) | F.exists(keys, lambda k: ~k.isin("url", "size")), 404)
        .when(~size.isin("square", "portrait"), 400)
        .when(source.isNull() | ~F.coalesce(shape, F.lit(False)), 400)
        .when(~F.startswith(source, F.lit(origin + prefix)), 403)
        .when(~F.regexp_like(name, F.lit(r"(?i)^[a-z0-9_-]+\.(?:jpg|jpeg|png|webp)$")), 400)
        .otherwise(200)
    )
    return F.struct(status.alias("status"), F.when(status == 200, name).alias("filename"), F.when(status == 200, size).alias("size"))


def pageview_stamp(ts: Column) -> Column:
    """``YYYYMMDD-HH0000`` of an hourly dump."""
    return F.date_format(ts, "yyyyMMdd-HH'0000'")


def export_stamp(date: Column) -> Column:
    """``MM_DD_YYYY`` of a daily id export."""
    return F.date_format(date, "MM_dd_yyyy")


def search_items(rows: DataFrame, link: str, source: str = "catalogue") -> DataFrame:
    """Rows as items of a device's own search index: description, keywords, rating out of ten, link, kind."""
    tv = F.col("media_type") == "tv"
    kind = F.when(tv, "TV series").otherwise("Movie")
    original = F.nullif("original_title", F.lit(""))
    rt = F.when(F.col("rt_score").isNotNull(), F.concat(F.when(F.col("rt_score") >= 60, F.lit("\U0001f345")).otherwise(F.lit("\U0001f4a5")), F.lit(" "), F.col("rt_score").cast("string"), F.lit("% Rotten Tomatoes")))
    parts = F.array(kind, F.when(F.col("year") > 0, F.col("year").cast("string")), F.when(original != F.col("title"), F.concat(F.lit("Original title: "), original)), rt)
    return rows.select(
        "stable_key", "title", F.array_join(F.filter(parts, lambda p: p.isNotNull()), " · ").alias("description"), F.filter(F.array(kind, F.lit(source), original), lambda k: k.isNotNull()).alias("keywords"), (F.col("rt_score") / 10).alias("rating"),
        F.concat(F.lit(link), F.when(tv, F.lit("tv_show/")).otherwise(F.lit("movie/")), F.col("id").cast("string")).alias("url"), F.when(tv, "public.tv-show").otherwise("public.movie").alias("content_type"),
    )


def with_fallback(merged: DataFrame, queries: DataFrame, languages: dict[str, str]) -> DataFrame:
    """``qid, id, title, subtitle, actions``: merged results, and for each of ``queries(qid, query)`` without any a row
    that offers an online search in each language."""
    found = merged.select("qid", F.concat_ws(":", F.lit("page"), "lang", F.col("stable_key").cast("string")).alias("id"), "title", "subtitle", "actions")
    none = queries.join(merged.select("qid").distinct(), "qid", "left_anti")
    actions = F.array(*[F.lit(f"search:{x}") for x in languages])
    return found.unionByName(none.select("qid", F.concat(F.lit("search:"), "query").alias("id"), F.concat(F.lit('Search online for "'), "query", F.lit('"')).alias("title"), F.lit("Not in the offline index").alias("subtitle"), actions.alias("actions")))
