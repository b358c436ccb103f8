"""Sources.  All declare their schema, read compressed files as they are and treat a missing path as no rows."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .. import schema
from ..functions import records as R


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed, non-blank lines; no file gives no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], "value string")
    return spark.read.text(path).select(F.trim("value").alias("value")).where(F.length("value") > 0)


def in_line_order(raw: DataFrame, name: str) -> DataFrame:
    """``raw``, read from files, with a number that grows by file path, and within a file by line.  Partitions don't tell:
    they hold splits of several files, larger ones first.  A split's lines lie in one partition, in order."""
    at = raw.select("*", F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start")).alias("_split"), F.monotonically_increasing_id().alias("_line"))
    splits = raw.select(F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start")).alias("_split")).distinct()
    ranks = splits.select("_split", (F.row_number().over(W.orderBy("_split")) - 1).cast("long").alias("_rank"))  # a row a split
    line = F.shiftleft(F.col("_rank"), 33) + F.col("_line").bitwiseAND(F.lit((1 << 33) - 1))
    return at.join(F.broadcast(ranks), "_split").withColumn(name, line).drop("_split", "_line", "_rank")


def store_log(spark: SparkSession, path: str) -> DataFrame:
    """The append-only log as records.  A distributed read loses line order, so the log carries ``_ingest_seq`` where it
    was appended by us; for foreign files it is rebuilt from the file's name and the place of its rows in the file."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema.RECORD)
    with_seq = T.StructType([*schema.STORE_LINE.fields, T.StructField("_ingest_seq", T.LongType())])
    raw = spark.read.schema(with_seq).json(path)
    if not raw.where("_ingest_seq is null").isEmpty():
        raw = in_line_order(raw, "_order").withColumn("_ingest_seq", F.coalesce("_ingest_seq", "_order"))
    raw = raw.where("id is not null")
    return raw.select(
        F.coalesce("mediaType", F.lit("movie")).alias("media_type"), "id", "title", F.col("originalTitle").alias("original_title"), F.coalesce("year", F.lit(0)).alias("year"), F.coalesce("popularity", F.lit(0.0)).alias("popularity"),
        F.coalesce("voteCount", F.lit(0)).cast("long").alias("vote_count"), F.col("posterPath").alias("poster_path"), F.col("imdbID").alias("imdb_id"), F.col("rtScore").alias("rt_score"), F.col("metacriticScore").alias("metacritic_score"), F.col("imdbRating").alias("imdb_rating"),
        F.col("firstSeen").alias("first_seen"), F.col("fetchedAt").alias("fetched_at"), F.col("ratingsAt").alias("ratings_at"), "lang", F.col("prevId").alias("prev_id"), F.col("changedOn").alias("changed_on"), "_ingest_seq",
    )


def id_export(spark: SparkSession, movies: str | None, tv: str | None) -> DataFrame:
    """Live ids of both kinds: media_type, id, original_title, popularity, adult.  An export that is there but empty is
    taken for a broken download and raises; one that isn't there means that nothing is filtered."""
    parts = []
    for kind, path in (("movie", movies), ("tv", tv)):
        if path and exists(spark, path):
            df = spark.read.schema(schema.EXPORT).json(path).where("id is not null")
            if df.isEmpty():
                raise ValueError(f"empty export: {path}")
            parts.append(df.select(F.lit(kind).alias("media_type"), "id", F.coalesce("original_title", "original_name").alias("original_title"), "popularity", F.coalesce("adult", F.lit(False)).alias("adult")))
    if not parts:
        return spark.createDataFrame([], "media_type string, id long, original_title string, popularity double, adult boolean")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def ratings_tsv(spark: SparkSession, path: str) -> DataFrame:
    """``imdb_id, imdb_rating (0..100), votes`` of a tab-separated ratings dump; header and garbage lines go."""
    raw = spark.read.schema(schema.RATINGS).option("sep", "\t").csv(path)
    return raw.where(F.col("imdb_id").startswith("tt") & F.col("average").try_cast("double").isNotNull()).select("imdb_id", R.imdb100(F.col("average")).alias("imdb_rating"), F.col("votes").try_cast("bigint").alias("votes"))


def pageviews(spark: SparkSession, paths: str | Sequence[str], langs: Sequence[str], min_views: int = 1) -> DataFrame:
    """``hour_file, lang, title, views`` of hourly dumps (``code title views ...``).  A broken file shortens its hour only."""
    raw = spark.read.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").text(paths)
    part = F.split("value", " ")
    rows = raw.select(F.input_file_name().alias("hour_file"), F.split(F.get(part, F.lit(0)), r"\.")[0].alias("lang"), F.get(part, F.lit(1)).alias("title"), F.get(part, F.lit(2)).try_cast("bigint").alias("views"))
    return rows.where(F.col("lang").isin(*langs) & F.col("title").isNotNull() & (F.col("views") >= min_views))


def view_sample(spark: SparkSession, path: str, min_views: int = 1) -> DataFrame:
    return spark.read.schema(schema.VIEWS).json(path).where(F.col("views") >= min_views)


def entity_keys(spark: SparkSession, path: str) -> DataFrame:
    """``title, qid``: resolved keys; the last line of a title wins, null and over-long numbers go."""
    raw = in_line_order(spark.read.schema("title string, qid long").json(path), "_at")
    return raw.where("qid is not null and qid < 2147483648").groupBy("title").agg(F.max_by("qid", "_at").alias("qid"))


def document(spark: SparkSession, path: str, fallback: dict | None = None) -> dict | None:
    """A small JSON document, or ``fallback`` if it is missing or isn't an object.  A store that can't be read raises."""
    if not exists(spark, path):
        return fallback
    text = "\n".join(r.value for r in spark.read.option("wholetext", True).text(path).collect())
    try:
        got = json.loads(text)
    except ValueError:
        return fallback
    return got if isinstance(got, dict) else fallback
