"""Canonical schemas.  Readers declare them; nothing is inferred, so that optional fields never vanish."""

from pyspark.sql import types as T

RECORD = T.StructType(
    [
        T.StructField("media_type", T.StringType()),
        T.StructField("id", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("original_title", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("popularity", T.DoubleType()),
        T.StructField("vote_count", T.LongType()),
        T.StructField("poster_path", T.StringType()),
        T.StructField("imdb_id", T.StringType()),
        T.StructField("rt_score", T.IntegerType()),
        T.StructField("metacritic_score", T.IntegerType()),
        T.StructField("imdb_rating", T.IntegerType()),
        T.StructField("first_seen", T.LongType()),
        T.StructField("fetched_at", T.LongType()),
        T.StructField("ratings_at", T.LongType()),
        T.StructField("lang", T.StringType()),
        T.StructField("prev_id", T.LongType()),
        T.StructField("changed_on", T.StringType()),
        T.StructField("_ingest_seq", T.LongType()),
    ]
)

#: A line of the append-only JSON log as written by other tools (camel case), with the ingest position that we add.
STORE_LINE = T.StructType(
    [
        T.StructField("mediaType", T.StringType()),
        T.StructField("id", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("originalTitle", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("popularity", T.DoubleType()),
        T.StructField("voteCount", T.LongType()),
        T.StructField("posterPath", T.StringType()),
        T.StructField("imdbID", T.StringType()),
        T.StructField("rtScore", T.IntegerType()),
        T.StructField("metacriticScore", T.IntegerType()),
        T.StructField("imdbRating", T.IntegerType()),
        T.StructField("firstSeen", T.LongType()),
        T.StructField("fetchedAt", T.LongType()),
        T.StructField("ratingsAt", T.LongType()),
        T.StructField("lang", T.StringType()),
        T.StructField("prevId", T.LongType()),
        T.StructField("changedOn", T.StringType()),
    ]
)

EXPORT = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("original_title", T.StringType()),
        T.StructField("original_name", T.StringType()),
        T.StructField("popularity", T.DoubleType()),
        T.StructField("adult", T.BooleanType()),
    ]
)
RATINGS = T.StructType([T.StructField("imdb_id", T.StringType()), T.StructField("average", T.StringType()), T.StructField("votes", T.StringType())])
VIEWS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("title", T.StringType()), T.StructField("views", T.LongType())])
ASSET = T.StructType([T.StructField("name", T.StringType()), T.StructField("bytes", T.LongType()), T.StructField("sha256", T.StringType())])
MANIFEST = T.StructType(
    [
        T.StructField("version", T.LongType()),
        T.StructField("generatedAt", T.StringType()),
        T.StructField("base", ASSET),
        T.StructField("deltas", T.ArrayType(ASSET)),
        T.StructField("bundle", ASSET),
    ]
)
INDEX_FORMAT_VERSION = 5
