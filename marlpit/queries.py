"""The operators applied to the driver's tables, each with the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import links
from .functions import records as R
from .functions.text import all_terms_match, fnv31, fold_text, is_subsequence, starts_capitalised, tokenize
from .operators import catalog, versions, wiki
from .plans import merge as merging
from .plans import search as searching
from .sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
NOW_YEAR = 2024


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return put


# --- adapters from the driver's tables to the canonical record, in both languages ---


def catalogue(spark: SparkSession, d: str) -> DataFrame:
    """``part`` as a title catalogue; votes are line items, fetched_at the last shipment."""
    votes = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("vote_count"), (F.max(F.datediff("l_shipdate", F.lit("1970-01-01").cast("date"))).cast("long") * 86_400_000).alias("fetched_at"))
    p = table(spark, d, "part").join(votes, F.col("p_partkey") == F.col("l_partkey"), "left")
    return p.select(
        F.when(F.col("p_type").isin("PROMO", "STANDARD"), "tv").otherwise("movie").alias("media_type"), F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("original_title"), (F.lit(1990) + F.col("p_size") % 35).cast("int").alias("year"), F.col("p_retailprice").alias("popularity"),
        F.coalesce("vote_count", F.lit(0)).alias("vote_count"), F.lit("/p.jpg").alias("poster_path"), F.when(F.col("p_partkey") % 4 > 0, F.concat(F.lit("tt"), F.col("p_partkey").cast("string"))).otherwise(F.lit("")).alias("imdb_id"),
        F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") * 2).cast("int").alias("rt_score"), F.when(F.col("p_partkey") % 7 == 0, F.col("p_size")).cast("int").alias("metacritic_score"), F.when(F.col("p_partkey") % 5 == 0, F.col("p_size") + 50).cast("int").alias("imdb_rating"),
        F.coalesce("fetched_at", F.lit(0)).alias("fetched_at"), F.when(F.col("p_partkey") % 6 > 1, F.col("fetched_at")).alias("ratings_at"), F.col("p_partkey").alias("first_position"),
    )


CAT = """cat AS (
  SELECT CASE WHEN p_type IN ('PROMO', 'STANDARD') THEN 'tv' ELSE 'movie' END AS media_type, p_partkey AS id, p_name AS title, p_brand AS original_title,
    CAST(1990 + p_size % 35 AS INTEGER) AS year, p_retailprice AS popularity, coalesce(v.votes, 0) AS vote_count, '/p.jpg' AS poster_path,
    CASE WHEN p_partkey % 4 > 0 THEN 'tt' || p_partkey ELSE '' END AS imdb_id, CASE WHEN p_partkey % 3 = 0 THEN p_size * 2 END AS rt_score,
    CASE WHEN p_partkey % 7 = 0 THEN p_size END AS metacritic_score, CASE WHEN p_partkey % 5 = 0 THEN p_size + 50 END AS imdb_rating,
    coalesce(v.at, 0) AS fetched_at, CASE WHEN p_partkey % 6 > 1 THEN v.at END AS ratings_at,
    p_partkey * 2 + CASE WHEN p_type IN ('PROMO', 'STANDARD') THEN 1 ELSE 0 END AS stable_key
  FROM part LEFT JOIN (SELECT l_partkey, count(*) AS votes, max(epoch_ms(CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP))) AS at FROM lineitem GROUP BY 1) v ON p_partkey = l_partkey)"""
BAND = "(vote_count >= 5 OR rt_score IS NOT NULL OR imdb_rating IS NOT NULL)"


def export(spark: SparkSession, d: str) -> DataFrame:
    """Live ids: most of the catalogue, some adult, some with new names, and ids that the catalogue lacks."""
    c = catalogue(spark, d).where("id % 11 <> 0")
    have = c.select("media_type", "id", F.when(F.col("id") % 13 == 0, F.concat(F.lit(" New "), "original_title")).otherwise(F.col("original_title")).alias("original_title"), "popularity", (F.col("id") % 17 == 0).alias("adult"))
    new = c.where("id % 10 = 1").select("media_type", (F.col("id") + 1_000_000).alias("id"), "original_title", "popularity", F.lit(False).alias("adult"))
    return have.unionByName(new)


EXP = f"""{CAT}, exp AS (
  SELECT media_type, id, CASE WHEN id % 13 = 0 THEN ' New ' || original_title ELSE original_title END AS original_title, popularity, id % 17 = 0 AS adult FROM cat WHERE id % 11 <> 0
  UNION ALL SELECT media_type, id + 1000000, original_title, popularity, false FROM cat WHERE id % 11 <> 0 AND id % 10 = 1)"""


def event_log(spark: SparkSession, d: str) -> DataFrame:
    """``events`` as an append-only log keyed by user."""
    return table(spark, d, "events").select("user_id", "event_type", "value", F.col("event_id").alias("_ingest_seq"))


def daily(spark: SparkSession, d: str) -> DataFrame:
    """``events`` as daily view samples of titles (users) in languages (types)."""
    return table(spark, d, "events").groupBy(F.col("event_type").alias("lang"), F.col("user_id").cast("string").alias("title"), F.to_date("ts").alias("day")).agg(F.count("*").alias("views"))


DAILY = "daily AS (SELECT event_type AS lang, CAST(user_id AS VARCHAR) AS title, CAST(ts AS DATE) AS day, count(*) AS views FROM events GROUP BY 1, 2, 3)"


def articles(spark: SparkSession, d: str) -> DataFrame:
    """``documents`` as encyclopedia rows: the title is the folded first line, votes the length."""
    title = fold_text(F.split("text", "\n")[0])
    return table(spark, d, "documents").select("doc_id", "lang", title.alias("title"), F.col("n_chars").alias("vote_count"), "text")


def kept(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once, for plans that read it several times."""
    at = files.scratch(df.sparkSession, tag)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


#: The fold in SQL.
FOLD = "trim(regexp_replace(lower(strip_accents({0})), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
ART = f"art AS (SELECT doc_id, lang, {FOLD.format('string_split(text, chr(10))[1]')} AS title, n_chars AS vote_count FROM documents)"


# --- store ---


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, max(event_id) AS last_seq, min(event_id) AS first_position FROM events GROUP BY 1")
def store_latest(spark, d):
    return catalog.latest(event_log(spark, d), ["user_id"]).select("user_id", "event_type", "value", F.col("_ingest_seq").alias("last_seq"), "first_position")


@query("SELECT user_id, CAST(row_number() OVER (ORDER BY f) - 1 AS BIGINT) AS \"row\" FROM (SELECT user_id, min(event_id) AS f FROM events GROUP BY 1)")
def store_first_position(spark, d):
    return catalog.number_rows(catalog.latest(event_log(spark, d), ["user_id"]), [F.col("first_position")], "row").select("user_id", "row")


@query(f"WITH {CAT} SELECT media_type, id, vote_count FROM cat WHERE vote_count >= 40 OR rt_score IS NOT NULL OR imdb_rating IS NOT NULL")
def band_filter(spark, d):
    return catalog.band(catalogue(spark, d), 40).select("media_type", "id", "vote_count")


@query(f"WITH {CAT} SELECT media_type, count(*) FILTER (WHERE vote_count >= 30 OR rt_score IS NOT NULL OR imdb_rating IS NOT NULL) AS kept, count(*) FILTER (WHERE NOT (vote_count >= 30 OR rt_score IS NOT NULL OR imdb_rating IS NOT NULL)) AS dropped FROM cat GROUP BY 1")
def band_counts(spark, d):
    return catalog.band_counts(catalogue(spark, d), 30)


@query(f"WITH {EXP} SELECT cat.media_type, cat.id FROM cat WHERE EXISTS (SELECT 1 FROM exp WHERE exp.media_type = cat.media_type AND exp.id = cat.id AND NOT adult)")
def live_semi(spark, d):
    return catalog.live(catalogue(spark, d), export(spark, d)).select("media_type", "id")


@query(f"WITH {EXP} SELECT exp.media_type, exp.id FROM exp WHERE NOT adult AND NOT EXISTS (SELECT 1 FROM cat WHERE exp.media_type = cat.media_type AND exp.id = cat.id)")
def new_anti(spark, d):
    return catalog.unseen(export(spark, d), catalogue(spark, d)).select("media_type", "id")


@query(f"WITH {EXP} SELECT exp.media_type, exp.id, trim(exp.original_title) AS new_title, cat.original_title FROM exp JOIN cat USING (media_type, id) WHERE trim(exp.original_title) <> '' AND trim(exp.original_title) <> trim(cat.original_title)")
def retitled_inner(spark, d):
    return catalog.retitled(export(spark, d), catalogue(spark, d)).select("media_type", "id", "new_title", "original_title")


@query(f"WITH {CAT} SELECT media_type, id, fetched_at FROM cat ORDER BY fetched_at, media_type, id LIMIT 50")
def stalest_n(spark, d):
    return catalog.stalest(catalogue(spark, d), 50).select("media_type", "id", "fetched_at")


@query(
    f"""WITH {EXP}, ren AS (SELECT e.media_type, e.id FROM exp e JOIN cat USING (media_type, id) WHERE NOT adult AND trim(e.original_title) <> '' AND trim(e.original_title) <> trim(cat.original_title)),
    livecat AS (SELECT cat.* FROM cat WHERE EXISTS (SELECT 1 FROM exp WHERE exp.media_type = cat.media_type AND exp.id = cat.id AND NOT adult))
    SELECT media_type, id, 'new' AS reason FROM exp WHERE NOT adult AND NOT EXISTS (SELECT 1 FROM cat WHERE exp.media_type = cat.media_type AND exp.id = cat.id)
    UNION ALL SELECT media_type, id, 'retitled' FROM ren
    UNION ALL (SELECT media_type, id, 'stale' FROM livecat WHERE NOT EXISTS (SELECT 1 FROM ren WHERE ren.media_type = livecat.media_type AND ren.id = livecat.id) ORDER BY fetched_at, media_type, id LIMIT 30)"""
)
def daily_update_plan(spark, d):
    return catalog.plan_daily_update(catalogue(spark, d), export(spark, d), refetch=30)


SINCE = 946684800000


@query(f"WITH {EXP} SELECT media_type, id, stable_key, vote_count FROM cat WHERE EXISTS (SELECT 1 FROM exp WHERE exp.media_type = cat.media_type AND exp.id = cat.id AND NOT adult) AND fetched_at > {SINCE} AND {BAND}")
def delta_select(spark, d):
    return catalog.delta(catalogue(spark, d), export(spark, d), SINCE)[0].select("media_type", "id", "stable_key", "vote_count")


@query(f"WITH {EXP} SELECT DISTINCT stable_key FROM cat WHERE fetched_at > {SINCE} OR NOT EXISTS (SELECT 1 FROM exp WHERE exp.media_type = cat.media_type AND exp.id = cat.id AND NOT adult)")
def superseded_set(spark, d):
    return catalog.delta(catalogue(spark, d), export(spark, d), SINCE)[1]


def chain(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Events of each third of the month as base and deltas, with a tombstone for some users."""
    e = table(spark, d, "events").select(F.col("user_id").alias("stable_key"), F.floor((F.dayofmonth("ts") - 1) / 8).cast("int").alias("seq"), F.col("event_id").alias("row"), "value")
    rows = e.where("row % 3 <> 0")
    gone = e.where("row % 29 = 0").select("stable_key", "seq").distinct()
    return rows, gone


CHAIN = """ev AS (SELECT user_id AS stable_key, CAST(floor((day(ts) - 1) / 8.0) AS INTEGER) AS seq, event_id AS "row", value FROM events),
  rws AS (SELECT * FROM ev WHERE "row" % 3 <> 0), gone AS (SELECT DISTINCT stable_key, seq FROM ev WHERE "row" % 29 = 0)"""


@query(f"""WITH {CHAIN}, ok AS (SELECT r.* FROM rws r WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.stable_key = r.stable_key AND g.seq > r.seq))
  SELECT stable_key, seq, "row", value FROM (SELECT *, row_number() OVER (PARTITION BY stable_key ORDER BY seq DESC, "row" DESC) AS n FROM ok) WHERE n = 1""")
def base_delta_resolve(spark, d):
    rows, gone = chain(spark, d)
    return versions.resolve(rows, gone).select("stable_key", "seq", "row", "value")


@query(f"""WITH {CHAIN}, one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stable_key, seq ORDER BY "row" DESC) AS n FROM rws) WHERE n = 1),
  events2 AS (SELECT stable_key, seq, 1 AS is_row, value FROM one UNION ALL SELECT stable_key, seq, 0, NULL FROM gone)
  SELECT stable_key, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY stable_key ORDER BY seq DESC, is_row DESC) AS n FROM events2) WHERE n = 1 AND is_row = 1""")
def snapshot_fold(spark, d):
    rows, gone = chain(spark, d)
    rest = ["row", "value"]
    one = rows.groupBy("stable_key", "seq").agg(F.max_by(F.struct(*rest), "row").alias("r")).select("stable_key", "seq", "r.*")
    return versions.snapshot(one, gone).select("stable_key", "seq", "value")


@query(f"WITH {CHAIN} SELECT stable_key, max(seq) AS last_seq FROM gone GROUP BY 1")
def superseded_last(spark, d):
    return versions.last_superseded(chain(spark, d)[1])


# --- folding and the inverted index ---


@query(f"SELECT doc_id, {FOLD.format('text')} AS folded FROM documents")
def fold_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", fold_text(F.col("text")).alias("folded"))


@query(f"WITH {ART} SELECT doc_id, array_to_string(list_filter(string_split({FOLD.format('title')}, ' '), lambda x: x <> ''), '|') AS tokens FROM art")
def fold_tokens(spark, d):
    return articles(spark, d).select("doc_id", F.array_join(tokenize(fold_text(F.col("title"))), "|").alias("tokens"))


POST = f"""{CAT}, idx AS (SELECT *, row_number() OVER (ORDER BY id, stable_key) - 1 AS "row" FROM cat WHERE coalesce(nullif(title, ''), nullif(original_title, '')) IS NOT NULL),
  post AS (SELECT DISTINCT term, "row" FROM (SELECT "row", unnest(list_concat(string_split({FOLD.format('title')}, ' '), list_concat(string_split({FOLD.format('original_title')}, ' '), [CAST(year AS VARCHAR)]))) AS term FROM idx) WHERE term <> '')"""


def index(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = catalog.index_rows(catalogue(spark, d))
    return rows, catalog.postings(rows)


@query(f'WITH {POST} SELECT term, CAST("row" AS BIGINT) AS "row" FROM post')
def postings_distinct(spark, d):
    return index(spark, d)[1]


@query(f"WITH {POST} SELECT term, count(*) AS df FROM post GROUP BY 1")
def term_df(spark, d):
    return catalog.term_frequencies(index(spark, d)[1]).select("term", "df")


@query(f'WITH {POST}, t AS (SELECT term, count(*) AS df FROM post GROUP BY 1) SELECT term, df, CAST(coalesce(sum(df) OVER (ORDER BY term ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM t')
def posting_offsets(spark, d):
    return catalog.term_frequencies(index(spark, d)[1])


@query(f"""WITH {POST} SELECT DISTINCT CAST("row" AS BIGINT) AS "row" FROM post WHERE term LIKE 'bo%'""")
def prefix_range(spark, d):
    return searching.candidates(index(spark, d)[1], ["bo"])


@query(f"""WITH {POST} SELECT CAST("row" AS BIGINT) AS "row" FROM post WHERE term LIKE 're%' INTERSECT SELECT CAST("row" AS BIGINT) FROM post WHERE term LIKE 'brand%' INTERSECT SELECT CAST("row" AS BIGINT) FROM post WHERE term LIKE '2%'""")
def multi_term_intersect(spark, d):
    return searching.candidates(index(spark, d)[1], ["re", "brand", "2"])


@query(f"""WITH {POST} SELECT CAST("row" AS BIGINT) AS "row" FROM (SELECT "row", min(term) AS term FROM post WHERE term LIKE 'b%' GROUP BY 1) ORDER BY term, "row" LIMIT 25""")
def candidate_pool(spark, d):
    return searching.candidates(index(spark, d)[1], ["b"], cap=25)


@query(f"WITH {CAT} SELECT media_type, id FROM cat WHERE {FOLD.format('title')} LIKE '%wid%' AND {FOLD.format('title')} LIKE '%re%'")
def text_match(spark, d):
    return catalogue(spark, d).where(all_terms_match(fold_text(F.col("title")), F.array(F.lit("wid"), F.lit("re")))).select("media_type", "id")


# --- search ---

WITHIN_SQL = f"""least(3071.0, CASE WHEN year <= 0 OR greatest(0, {NOW_YEAR} - year) > 5 THEN 0.0 ELSE round(3000 * (1 - greatest(0, {NOW_YEAR} - year) / 5.0)) END
  + CASE WHEN vote_count <= 0 THEN 0.0 ELSE least(2500.0, ln(1.0 + vote_count) * 260) END)"""


def single_sql(q: str) -> str:
    words, owords = "string_split(t, ' ')", "string_split(o, ' ')"
    return f"""(CASE WHEN t = '{q}' THEN 1048576 ELSE 0 END + CASE WHEN starts_with(t, '{q}') THEN 262144 ELSE 0 END
      + CASE WHEN len(list_filter({words}, lambda w: w <> t AND starts_with(w, '{q}'))) > 0 THEN 65536 ELSE 0 END
      + CASE WHEN {len(q)} >= 2 AND len(list_filter({words}, lambda w: w <> '{q}' AND contains(w, '{q}'))) > 0 THEN 16384 ELSE 0 END
      + CASE WHEN {len(q)} >= 3 AND regexp_matches(t, '{'.*'.join(q)}') THEN 4096 ELSE 0 END
      + CASE WHEN o = '' OR o = t THEN 0 WHEN o = '{q}' THEN 1024 WHEN starts_with(o, '{q}') THEN 512 WHEN len(list_filter({owords}, lambda w: starts_with(w, '{q}'))) > 0 THEN 256 ELSE 0 END)"""


def several_sql(q: str) -> str:
    return f"""(CASE WHEN t = '{q}' THEN 1048576 ELSE 0 END + CASE WHEN starts_with(t, '{q}') THEN 262144 ELSE 0 END
      + CASE WHEN {len(q)} >= 4 AND contains(t, '{q}') THEN 16384 ELSE 0 END + CASE WHEN o = '{q}' AND o <> t THEN 1024 ELSE 0 END)"""


def year_sql(q: str) -> str:
    years = [t for t in q.split() if len(t) == 4 and t.isdigit()]
    return f"CASE WHEN year IN ({', '.join(years)}) THEN 32 ELSE 0 END" if years else "0"


def search_sql(q: str, limit: int = 10) -> str:
    terms = q.split()
    hit = " INTERSECT ".join(f'SELECT "row" FROM post WHERE term LIKE \'{t}%\'' for t in terms)
    text = single_sql(q) if len(terms) == 1 else several_sql(q)
    return f"""SELECT stable_key, title, year, vote_count, round({text} + {year_sql(q)} + {WITHIN_SQL}, 4) AS score FROM (SELECT *, {FOLD.format('title')} AS t, {FOLD.format('original_title')} AS o FROM idx WHERE "row" IN ({hit}))
      ORDER BY {text} + {year_sql(q)} + {WITHIN_SQL} DESC, stable_key LIMIT {limit}"""


def found(spark, d, q, limit=10):
    rows, post = index(spark, d)
    return searching.search(rows, post, q, now_year=NOW_YEAR, limit=limit)


def brief(df: DataFrame) -> DataFrame:
    return df.select("stable_key", "title", "year", "vote_count", F.round("score", 4).alias("score"))


@query(f"WITH {POST} {search_sql('plate')}")
def search_single(spark, d):
    return brief(found(spark, d, "Plate"))


@query(f"WITH {POST} {search_sql('red')}")
def search_prefix(spark, d):
    return brief(found(spark, d, "red"))


@query(f"WITH {POST} {search_sql('red wid')}")
def search_multi(spark, d):
    return brief(found(spark, d, "red wid"))


@query(f"WITH {POST} {search_sql('bolt 2020')}")
def search_year(spark, d):
    return brief(found(spark, d, "bolt 2020"))


@query(f"WITH {POST} {search_sql('brand 7', 25)}")
def search_original(spark, d):
    return brief(found(spark, d, "brand 7", 25))


BATCH = ["plate", "red", "pla", "bolt", "hot", "wid", "zzz", "small ring", "blue b", "ring 2021", "brand 12"]


def _batch_sql() -> str:
    parts = [f"SELECT {i} AS qid, * FROM ({search_sql(q, 5)})" for i, q in enumerate(BATCH)]
    return f"WITH {POST} SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, stable_key) AS INTEGER) AS rank, stable_key, title, score FROM ({' UNION ALL '.join(parts)})"


@query(_batch_sql())
def search_batch(spark, d):
    rows, post = index(spark, d)
    qs = spark.createDataFrame(list(enumerate(BATCH)), "qid int, query string")
    return searching.search_batch(rows, post, qs, now_year=NOW_YEAR, limit=5).select("qid", "rank", "stable_key", "title", F.round("score", 4).alias("score"))


@query(f"WITH {CAT} SELECT id, true AS matched FROM cat WHERE contains({FOLD.format('original_title')}, 'brand') AND contains({FOLD.format('original_title')}, '7') AND {FOLD.format('original_title')} <> {FOLD.format('title')} AND NOT (contains({FOLD.format('title')}, 'brand') AND contains({FOLD.format('title')}, '7'))")
def matched_original(spark, d):
    m = searching.matched_original(fold_text(F.col("title")), fold_text(F.col("original_title")), F.array(F.lit("brand"), F.lit("7")))
    return catalogue(spark, d).where(m).select("id", F.lit(True).alias("matched"))


@query(f"WITH {CAT} SELECT id, t FROM (SELECT id, {FOLD.format('title')} AS t FROM cat) WHERE regexp_matches(t, 'r.*d.*w')")
def subsequence(spark, d):
    return catalogue(spark, d).select("id", fold_text(F.col("title")).alias("t")).where(is_subsequence(F.lit("rdw"), F.col("t")))


TEXTS_SQL = "CASE WHEN rt_score IS NOT NULL THEN CASE WHEN rt_score >= 60 THEN '🍅 ' ELSE '💥 ' END || rt_score || '%' WHEN imdb_rating IS NOT NULL THEN '⭐ ' || printf('%.1f', imdb_rating / 10.0) END"


@query(f"""WITH {CAT} SELECT media_type || ':' || id AS id, title, concat_ws(' · ', CASE WHEN {FOLD.format('original_title')} <> {FOLD.format('title')} THEN original_title END, CAST(year AS VARCHAR), {TEXTS_SQL}) AS subtitle,
  CASE WHEN {FOLD.format('original_title')} <> {FOLD.format('title')} THEN original_title ELSE '' END AS keywords, 'https://image.tmdb.org/t/p/w92/p.jpg' AS poster_url, CASE WHEN media_type = 'tv' THEN 'TV Show' ELSE 'Movie' END AS label, round(vote_count / max(vote_count) OVER (), 6) AS score FROM cat""")
def candidates_view(spark, d):
    c = catalogue(spark, d).withColumns({"matched_original": F.lit(False), "score": F.col("vote_count").cast("double"), "poster_url": R.poster_url(F.col("poster_path"))})
    out = searching.to_candidates(c, R.rating_preference(None))
    return out.withColumn("keywords", F.array_join("keywords", "|")).withColumn("score", F.round("score", 6))


# --- scalar functions ---


@query(f"WITH {CAT} SELECT id, media_type, stable_key, media_type || ':' || id AS text_key FROM cat")
def stable_key(spark, d):
    c = catalogue(spark, d)
    return c.select("id", "media_type", R.stable_key(F.col("media_type"), F.col("id")).alias("stable_key"), R.text_key(F.col("media_type"), F.col("id")).alias("text_key"))


@query("SELECT p_partkey AS id, p_partkey * 97 AS num, CASE WHEN p_partkey > 0 THEN 'tt' || CASE WHEN length(CAST(p_partkey * 97 AS VARCHAR)) < 7 THEN lpad(CAST(p_partkey * 97 AS VARCHAR), 7, '0') ELSE CAST(p_partkey * 97 AS VARCHAR) END END AS imdb FROM part")
def imdb_format(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), R.imdb_num(F.concat(F.lit(" tt"), (F.col("p_partkey") * 97).cast("string"), F.lit(" "))).alias("num"))
    return p.withColumn("imdb", R.imdb_format(F.col("num")))


@query("SELECT p_partkey AS id, CAST(least(100, greatest(0, floor(p_retailprice / 10 + 0.5))) AS INTEGER) AS score, CAST(least(100, greatest(0, floor((p_size / 4.0) * 10 + 0.5))) AS INTEGER) AS rating, CASE WHEN p_size * 3 <= 100 THEN CAST(p_size * 3 AS INTEGER) ELSE -1 END AS byte FROM part")
def rating_norm(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), R.score100(F.concat((F.col("p_retailprice") / 10).cast("string"), F.lit("%"))).alias("score"), R.imdb100((F.col("p_size") / 4).cast("string")).alias("rating"), F.coalesce(R.rating_or_null(F.col("p_size") * 3), F.lit(-1)).alias("byte"))


@query("""SELECT event_id, CAST(value AS VARCHAR) AS rating, 'A=' || (event_id % 90) || '%;B=' || (event_id % 100) || '/100' AS ratings FROM events""")
def omdb_extract(spark, d):
    body = F.concat(F.lit('{"x":"bad \\ escape","imdbRating":"'), F.col("value").cast("string"), F.lit('","Ratings":[{"Source":"A","Value":"'), (F.col("event_id") % 90).cast("string"), F.lit('%"},{"Source":"B","Value":"'), (F.col("event_id") % 100).cast("string"), F.lit('/100"}]'))
    pairs = F.array_join(F.transform(R.response_ratings(F.col("body")), lambda x: F.concat(x["source"], F.lit("="), x["value"])), ";")
    return table(spark, d, "events").select("event_id", body.alias("body")).select("event_id", R.response_field(F.col("body"), "imdbRating").alias("rating"), pairs.alias("ratings"))


@query("SELECT page_id, regexp_extract(url, '^([^:]+:)', 1) AS ns, CASE WHEN upper(left(url, 1)) = left(url, 1) THEN true ELSE false END AS cap FROM pages")
def title_scalars(spark, d):
    return table(spark, d, "pages").select("page_id", R.namespace_of(F.col("url")).alias("ns"), starts_capitalised(F.col("url")).alias("cap"))


@query("SELECT doc_id, CASE WHEN split_part(lang || '.example', '.', 1) = '' THEN 'en' ELSE split_part(lang || '.example', '.', 1) END AS lang FROM documents")
def language_of(spark, d):
    return table(spark, d, "documents").select("doc_id", R.language_of(F.concat("lang", F.lit(".example"))).alias("lang"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders")
def year_from_date(spark, d):
    return table(spark, d, "orders").select("o_orderkey", R.year_of(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("year"))


@query("SELECT event_id, sha256(event_type || '|' || user_id) AS fp, regexp_replace(event_type || '.gz', '\\.gz$', '') AS asset FROM events")
def fingerprints(spark, d):
    return table(spark, d, "events").select("event_id", R.fingerprint(F.col("event_type"), F.col("user_id").cast("string")).alias("fp"), R.asset_name(F.concat("event_type", F.lit(".gz"))).alias("asset"))


@query("SELECT n_nationkey, 'https://en.wikipedia.org/wiki/' || n_name || '_%28x%29!' AS escaped, replace(n_name, '_', ' ') || ' (x)!' AS title FROM nation")
def page_links(spark, d):
    t = F.concat("n_name", F.lit(" (x)!"))
    url = R.page_url(F.lit("en"), t)
    return table(spark, d, "nation").select("n_nationkey", F.replace(F.replace(url, F.lit("("), F.lit("%28")), F.lit(")"), F.lit("%29")).alias("escaped"), R.page_title(url).alias("title"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey * 1000 ELSE -1 END AS qid FROM nation")
def entity_number(spark, d):
    uri = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("http://e/Q"), (F.col("n_nationkey").cast("long") * 1000).cast("string"))).otherwise(F.lit("http://e/Q99999999999"))
    return table(spark, d, "nation").select("n_nationkey", F.coalesce(R.entity_number(uri), F.lit(-1)).alias("qid"))


UNITS = "list_transform(string_split(lang || ':' || title, ''), lambda c: CAST(unicode(c) AS BIGINT))"


@query(f"""WITH {ART}, u AS (SELECT doc_id, list_prepend(CAST(2166136261 AS BIGINT), flatten(list_transform({UNITS}, lambda c: CASE WHEN c < 65536 THEN [c] ELSE [55296 + ((c - 65536) >> 10), 56320 + ((c - 65536) & 1023)] END))) AS units FROM art)
  SELECT doc_id, list_reduce(units, lambda h, c: (xor(h, c) * 16777619) & 4294967295) & 2147483647 AS id FROM u""")
def article_id(spark, d):
    return articles(spark, d).select("doc_id", fnv31(F.concat_ws(":", "lang", "title")).alias("id"))


# --- encyclopedia ---


@query(f"WITH {DAILY} SELECT lang, title, CAST(sum(views) AS BIGINT) AS views FROM daily GROUP BY 1, 2")
def views_sum(spark, d):
    return wiki.sum_views(daily(spark, d))


TOP = f"{DAILY}, sums AS (SELECT lang, title, CAST(sum(views) AS BIGINT) AS views FROM daily GROUP BY 1, 2), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY views DESC, title) AS INTEGER) AS rank FROM sums)"


@query(f"WITH {TOP} SELECT lang, title, views, rank FROM ranked WHERE rank <= 20")
def views_topn_lang(spark, d):
    return wiki.top_per_language(wiki.sum_views(daily(spark, d)), 20)


@query(f"WITH {TOP} SELECT lang, count(*) FILTER (WHERE views >= 1) AS at_least_1, count(*) FILTER (WHERE views >= 2) AS at_least_2, count(*) FILTER (WHERE views >= 5) AS at_least_5, count(*) FILTER (WHERE views >= 20) AS at_least_20, count(*) FILTER (WHERE views >= 100) AS at_least_100 FROM sums GROUP BY 1")
def views_floor_hist(spark, d):
    return wiki.floor_histogram(wiki.sum_views(daily(spark, d)))


@query("SELECT page_id, url FROM pages WHERE NOT (regexp_extract(url, '^([^:]+:)', 1) = 'http:')")
def namespace_anti(spark, d):
    ns = spark.createDataFrame([("en", "http:"), ("en", "Anexo:")], "lang string, prefix string")
    v = table(spark, d, "pages").select(F.lit("en").alias("lang"), F.col("url").alias("title"), "page_id")
    return wiki.articles(v, ns).select("page_id", F.col("title").alias("url"))


HISTORY = f"""{DAILY}, perday AS (SELECT title, day, sum(views) AS views FROM daily GROUP BY 1, 2), numbered AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY day) AS n FROM perday),
  hist AS (SELECT title, day, CAST(views AS DOUBLE) AS pop, n FROM numbered WHERE n = 1
    UNION ALL SELECT x.title, x.day, (1 - pow(0.5, CAST(date_diff('day', h.day, x.day) AS DOUBLE) / 14)) * x.views + (1 - (1 - pow(0.5, CAST(date_diff('day', h.day, x.day) AS DOUBLE) / 14))) * h.pop, x.n FROM hist h JOIN numbered x ON x.title = h.title AND x.n = h.n + 1)"""


def per_day(spark, d):
    return daily(spark, d).groupBy("title", "day").agg(F.sum("views").alias("views"))


@query(f"WITH RECURSIVE {HISTORY} SELECT title, CAST(CAST(day AS DATE) AS VARCHAR) AS day, round(pop, 6) AS popularity FROM hist")
def decay_daily(spark, d):
    return wiki.level_history(per_day(spark, d)).select("title", F.col("day").cast("string").alias("day"), F.round("popularity", 6).alias("popularity"))


@query(f"WITH {TOP} SELECT lang, title, CAST(greatest(0, floor(log2(views + 1.0))) AS BIGINT) AS level FROM sums")
def octave(spark, d):
    return wiki.shipping(wiki.sum_views(daily(spark, d)).withColumns({"popularity": F.col("views").cast("double"), "vote_count": F.col("views")})).select("lang", "title", F.col("vote_count").alias("level"))


DAY1, DAY2 = "2024-01-10", "2024-01-13"


def two_days(spark: SparkSession, d: str):
    """A store after one day and the sample of a later one; some titles have keys, some keys moved."""
    v = daily(spark, d)
    on = lambda day: v.where(F.col("day") == F.lit(day).cast("date")).select("lang", "title", "views")
    store = on(DAY1).select("lang", "title", (F.col("title").cast("long") + F.when(F.col("title").cast("long") % 5 == 0, 7).otherwise(0)).alias("id"), F.col("views").cast("double").alias("popularity"), F.lit(DAY1).alias("changed_on"))
    keys = v.select("lang", "title", F.col("title").cast("long").alias("qid")).distinct()
    return store, on(DAY2), keys


FOLDED = f"""{DAILY}, st AS (SELECT lang, title, CAST(title AS BIGINT) + CASE WHEN CAST(title AS BIGINT) % 5 = 0 THEN 7 ELSE 0 END AS id, CAST(views AS DOUBLE) AS popularity FROM daily WHERE day = DATE '{DAY1}'),
  sm AS (SELECT lang, title, views FROM daily WHERE day = DATE '{DAY2}'),
  f AS (SELECT sm.lang, sm.title, CAST(sm.title AS BIGINT) AS id, st.id AS old, CASE WHEN coalesce(st.popularity, 0) <= 0 THEN CAST(sm.views AS DOUBLE) ELSE (1 - pow(0.5, 3.0 / 14)) * sm.views + (1 - (1 - pow(0.5, 3.0 / 14))) * st.popularity END AS pop, st.popularity AS oldpop FROM sm LEFT JOIN st USING (lang, title))"""


@query(f"""WITH {FOLDED} SELECT lang, title, id, round(pop, 6) AS popularity, CASE WHEN old <> id THEN old ELSE -1 END AS prev_id, CASE WHEN old IS NULL OR old <> id OR floor(log2(oldpop + 1)) <> floor(log2(pop + 1)) THEN '{DAY2}' ELSE '{DAY1}' END AS changed_on FROM f""")
def changed_rows(spark, d):
    store, sample, keys = two_days(spark, d)
    return wiki.fold_day(store, sample, keys, DAY2, DAY1)[0].select("lang", "title", "id", F.round("popularity", 6).alias("popularity"), F.coalesce("prev_id", F.lit(-1)).alias("prev_id"), "changed_on")


@query(f"WITH {FOLDED} SELECT lang, title, id FROM st WHERE NOT EXISTS (SELECT 1 FROM sm WHERE sm.lang = st.lang AND sm.title = st.title)")
def dropped_rows(spark, d):
    store, sample, keys = two_days(spark, d)
    return wiki.fold_day(store, sample, keys, DAY2, DAY1)[1]


@query(f"""WITH {FOLDED}, ch AS (SELECT * FROM f WHERE old IS NULL OR old <> id OR floor(log2(oldpop + 1)) <> floor(log2(pop + 1)))
  SELECT DISTINCT k * 2 AS stable_key FROM (SELECT id AS k FROM ch UNION ALL SELECT old FROM ch WHERE old <> id UNION ALL SELECT id FROM st WHERE NOT EXISTS (SELECT 1 FROM sm WHERE sm.lang = st.lang AND sm.title = st.title))""")
def wiki_superseded(spark, d):
    store, sample, keys = two_days(spark, d)
    rows, dropped = wiki.fold_day(store, sample, keys, DAY2, DAY1)
    return wiki.wiki_delta(rows, dropped, DAY1)[1]


@query(f"WITH {DAILY} SELECT lang, count(*) - count(DISTINCT CAST(title AS BIGINT) % 100) AS collisions FROM (SELECT DISTINCT lang, title FROM daily) GROUP BY 1")
def id_collisions(spark, d):
    return wiki.id_collisions(daily(spark, d).select("lang", (F.col("title").cast("long") % 100).alias("id"), "title").distinct())


@query("SELECT doc_id AS id, n_chars AS popularity, CAST(run AS BIGINT) AS running_bytes FROM (SELECT *, sum(octet_length(encode(text))) OVER (ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING) AS run FROM documents) WHERE run <= 200000")
def budget_prefix(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("popularity"), F.octet_length("text").cast("long").alias("size"))
    return wiki.budget_prefix(docs, "size", 200_000).select("id", "popularity", "running_bytes")


@query(f"WITH {TOP}, mid AS (SELECT lang, title, views FROM ranked WHERE rank <= 30) SELECT lang, title, views, CAST(floor((row_number() OVER (ORDER BY views DESC, lang, title) - 1) / 25) AS BIGINT) AS chunk FROM (SELECT * FROM mid WHERE CAST(title AS BIGINT) % 4 <> 0 ORDER BY views DESC, lang, title LIMIT 60)")
def pending_keys(spark, d):
    titles = wiki.top_per_language(wiki.sum_views(daily(spark, d)), 30).select("lang", "title", "views")
    return wiki.pending_keys(titles, titles.where(F.col("title").cast("long") % 4 == 0), 25, 60)


@query(f"WITH RECURSIVE {HISTORY}, lv AS (SELECT title, day, greatest(0, floor(log2(pop + 1))) AS level FROM hist), pr AS (SELECT *, lag(level) OVER (PARTITION BY title ORDER BY day) AS p FROM lv) SELECT CAST(CAST(day AS DATE) AS VARCHAR) AS day, round(avg(CASE WHEN level <> p THEN 1.0 ELSE 0.0 END), 6) AS churn FROM pr WHERE p IS NOT NULL GROUP BY 1")
def churn(spark, d):
    return wiki.churn(wiki.level_history(per_day(spark, d)).select("title", "day", "level")).select(F.col("day").cast("string").alias("day"), F.round("churn", 6).alias("churn"))


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def daily_tumbling(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.to_date("w.start").cast("string").alias("day"), "event_type", "n", "total")


# --- entities and the language merge ---


def bands(spark: SparkSession, d: str) -> DataFrame:
    rows = articles(spark, d).groupBy("lang", "title").agg(F.min("doc_id").alias("doc_id"), F.max("vote_count").alias("vote_count"))
    return kept(rows.withColumn("stable_key", F.col("doc_id") * 2), "bands")


BANDS = f"{ART}, bands AS (SELECT lang, title, min(doc_id) AS doc_id, max(vote_count) AS vote_count, min(doc_id) * 2 AS stable_key FROM art GROUP BY 1, 2)"


def bindings(band: DataFrame) -> DataFrame:
    return band.select((F.col("doc_id") % 60).alias("item"), "lang", "title", F.col("doc_id").alias("position"))


GROUPS = f"""{BANDS}, bind AS (SELECT doc_id % 60 AS item, lang, title, doc_id AS position FROM bands),
  hit AS (SELECT item, lang, title, position, stable_key FROM bind JOIN bands USING (lang, title)),
  ok AS (SELECT item, row_number() OVER (ORDER BY f, item) AS group_id FROM (SELECT item, min(position) AS f FROM hit GROUP BY 1 HAVING count(DISTINCT lang) >= 2)),
  grp AS (SELECT group_id, item, lang, stable_key, title FROM hit JOIN ok USING (item))"""


@query(f"WITH {GROUPS} SELECT group_id, item, lang, stable_key, title FROM grp")
def entity_groups(spark, d):
    band = bands(spark, d)
    return wiki.entity_groups(bindings(band), band)


@query(f'WITH {GROUPS}, per AS (SELECT group_id, count(DISTINCT lower(title)) AS names, count(*) AS n FROM grp GROUP BY 1) SELECT count(*) AS "groups", count(*) FILTER (WHERE names = 1) AS same_title, count(*) FILTER (WHERE names > 1) AS other_title, CAST(sum(n) AS BIGINT) AS "rows" FROM per')
def entity_stats(spark, d):
    band = bands(spark, d)
    return wiki.entity_stats(wiki.entity_groups(bindings(band), band))


@query(f"WITH {GROUPS} SELECT lang, round(avg(CASE WHEN g.stable_key IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM bands LEFT JOIN (SELECT DISTINCT lang, stable_key FROM grp) g USING (lang, stable_key) GROUP BY 1")
def coverage(spark, d):
    band = bands(spark, d)
    return wiki.coverage(band, wiki.entity_groups(bindings(band), band)).withColumn("coverage", F.round("coverage", 6))


def merge_input(spark: SparkSession, d: str) -> DataFrame:
    """Twenty queries of result rows: some titles occur in several rows, some rows have an entity."""
    a = articles(spark, d).select((F.col("doc_id") % 20).alias("qid"), F.col("doc_id").alias("pos"), "lang", (F.col("doc_id") * 2).alias("stable_key"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.upper(F.left("title", F.lit(1))), F.substring("title", 2, 1 << 30))).otherwise(F.col("title")).alias("title"), "vote_count")
    return a.withColumn("score", (F.col("pos") % 7).cast("double"))


def merge_map(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("doc_id % 3 = 0").select("lang", (F.col("doc_id") * 2).alias("stable_key"), (F.col("doc_id") % 9).alias("group_id"))


MERGE = f"""{ART}, inp AS (SELECT doc_id % 20 AS qid, doc_id AS pos, lang, doc_id * 2 AS stable_key, CASE WHEN doc_id % 2 = 0 THEN upper(left(title, 1)) || substring(title, 2) ELSE title END AS title, vote_count, CAST(doc_id % 7 AS DOUBLE) AS score FROM art),
  mapped AS (SELECT *, CASE WHEN pos % 3 = 0 THEN pos % 9 END AS e FROM inp),
  keyed AS (SELECT *, coalesce('entity:' || coalesce(e, last_value(e IGNORE NULLS) OVER (PARTITION BY qid, lower(title) ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 'title:' || lower(title)) AS group_key FROM mapped),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, group_key, lang ORDER BY score DESC, vote_count DESC, (upper(left(title, 1)) = left(title, 1)) DESC, pos) AS n FROM keyed) WHERE n = 1)"""


@query(f"WITH {MERGE} SELECT qid, pos, group_key FROM keyed")
def group_key_inherit(spark, d):
    return merging.group_keys(merge_input(spark, d), merge_map(spark, d)).select("qid", "pos", "group_key")


@query(f"WITH {MERGE} SELECT qid, group_key, lang, pos, title FROM best")
def best_per_lang(spark, d):
    return merging.best_per_language(merging.group_keys(merge_input(spark, d), merge_map(spark, d))).select("qid", "group_key", "lang", "pos", "title")


@query(f"""WITH {MERGE}, own AS (SELECT *, row_number() OVER (PARTITION BY qid, group_key ORDER BY score DESC, vote_count DESC, (upper(left(title, 1)) = left(title, 1)) DESC, pos) AS m FROM best),
  g AS (SELECT qid, group_key, max(CASE WHEN m = 1 THEN stable_key END) AS stable_key, max(CASE WHEN m = 1 THEN lang END) AS lang, max(CASE WHEN m = 1 THEN pos END) AS pos, max(score) AS score, string_agg(lang || '=' || title, ',' ORDER BY lang) AS titles FROM own GROUP BY 1, 2),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, pos) AS INTEGER) AS rank FROM g) SELECT qid, rank, group_key, stable_key, lang, score, titles FROM r WHERE rank <= 8""")
def merge_languages(spark, d):
    none = spark.createDataFrame([], "lang string, group_id long, title string")
    m = merging.merge_languages(merge_input(spark, d), merge_map(spark, d), none, ["en", "de", "es", "fr"], {"en": "English", "de": "Deutsch"}, 8)
    titles = F.array_join(F.array_sort(F.transform(F.map_entries("titles"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return m.select("qid", "rank", "group_key", "stable_key", "lang", "score", titles.alias("titles"))


# --- ratings ---

NOW_MS = 1_100_000_000_000


@query(
    f"""WITH {CAT}, q AS (SELECT *, ratings_at IS NULL AS fresh, CASE WHEN year >= 2022 - 2 THEN 10.0 ELSE 40.0 END * 86400000 AS win FROM cat)
    SELECT media_type, id, vote_count, CAST(coalesce(ratings_at, 0) AS BIGINT) AS ratings_at FROM q WHERE ({BAND} OR year >= 2021) AND trim(imdb_id) <> '' AND (fresh OR ((rt_score IS NOT NULL OR metacritic_score IS NOT NULL OR year >= 2021) AND {NOW_MS} - ratings_at > win))
    ORDER BY fresh DESC, CASE WHEN fresh THEN vote_count END DESC NULLS LAST, q.ratings_at, media_type, id LIMIT 200"""
)
def rating_queue(spark, d):
    return catalog.rating_queue(catalogue(spark, d), NOW_MS, 2022, 40, top=200).select("media_type", "id", "vote_count", F.coalesce("ratings_at", F.lit(0)).alias("ratings_at"))


@query(f"WITH {CAT} SELECT media_type, id, CAST((id * 7) % 101 AS INTEGER) AS imdb_rating FROM cat WHERE imdb_id <> '' AND id % 2 = 0 AND imdb_rating IS DISTINCT FROM (id * 7) % 101")
def rating_upsert(spark, d):
    c = catalogue(spark, d)
    dump = c.where("imdb_id <> '' and id % 2 = 0").select("imdb_id", ((F.col("id") * 7) % 101).cast("int").alias("imdb_rating"))
    return catalog.rating_changes(c, dump, NOW_MS).select("media_type", "id", "imdb_rating")


@query(f"WITH {CAT} SELECT id, vote_count FROM cat WHERE media_type = 'tv' AND imdb_id = '' ORDER BY vote_count DESC, id LIMIT 40")
def missing_ids(spark, d):
    return catalog.missing_id_queue(catalogue(spark, d), 40).select("id", "vote_count")


# --- releases ---


def releases(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Assets of a manifest (suppliers) and what is installed (some stale, some of others)."""
    s = table(spark, d, "supplier")
    wanted = s.where("s_suppkey % 4 <> 0").select(F.concat(F.lit("own-"), "s_suppkey").alias("name"), F.sha2("s_name", 256).alias("sha256"))
    have = s.where("s_suppkey % 3 <> 0").select(F.concat(F.when(F.col("s_suppkey") % 5 == 0, "their-").otherwise("own-"), "s_suppkey").alias("name"), F.sha2(F.when(F.col("s_suppkey") % 7 == 0, F.lit("old")).otherwise(F.col("s_name")), 256).alias("sha256"))
    return wanted, have


REL = """want AS (SELECT 'own-' || s_suppkey AS name, sha256(s_name) AS sha256 FROM supplier WHERE s_suppkey % 4 <> 0),
  have AS (SELECT CASE WHEN s_suppkey % 5 = 0 THEN 'their-' ELSE 'own-' END || s_suppkey AS name, sha256(CASE WHEN s_suppkey % 7 = 0 THEN 'old' ELSE s_name END) AS sha256 FROM supplier WHERE s_suppkey % 3 <> 0)"""


@query(f"WITH {REL} SELECT name, sha256 FROM want EXCEPT SELECT name, sha256 FROM have")
def manifest_diff(spark, d):
    return versions.downloads(*releases(spark, d))


@query(f"WITH {REL} SELECT name, sha256 FROM have WHERE starts_with(name, 'own-') AND name NOT IN (SELECT name FROM want)")
def prune_list(spark, d):
    wanted, have = releases(spark, d)
    return versions.prunable(have, wanted, "own-").select("name", "sha256")


@query("SELECT r_name AS name, CAST(r_regionkey AS INTEGER) AS position FROM region WHERE r_regionkey <> 2 UNION ALL SELECT r_name, 5 FROM region WHERE r_regionkey = 2")
def chain_next(spark, d):
    c = table(spark, d, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").cast("int").alias("position"))
    return versions.next_chain(c, c.where("position = 2"), False)


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 OR n_nationkey % 4 = 0 OR n_nationkey * 2 >= 30 THEN 'base' ELSE 'delta' END AS mode FROM nation")
def decide_mode(spark, d):
    n = table(spark, d, "nation")
    return n.select("n_nationkey", catalog.next_mode(F.when(F.col("n_nationkey") % 3 != 0, F.col("n_nationkey")), F.col("n_nationkey") % 4 == 0, F.col("n_nationkey") * 2).alias("mode"))


@query(f"""WITH {CAT}, want AS (SELECT stable_key FROM cat WHERE id % 5 <> 0), had AS (SELECT stable_key FROM cat WHERE id % 7 <> 0), chg AS (SELECT stable_key FROM cat WHERE id % 3 = 0), rem AS (SELECT stable_key FROM cat WHERE id % 31 = 0)
  SELECT stable_key, 'delete' AS action FROM (SELECT stable_key FROM had EXCEPT SELECT stable_key FROM want UNION (SELECT stable_key FROM rem INTERSECT SELECT stable_key FROM had))
  UNION ALL SELECT stable_key, 'put' FROM want WHERE stable_key IN (SELECT stable_key FROM chg) OR stable_key NOT IN (SELECT stable_key FROM had)""")
def sync_plan(spark, d):
    c = catalogue(spark, d).withColumn("stable_key", R.stable_key(F.col("media_type"), F.col("id"))).select("stable_key", "id")
    return versions.sync_plan(c.where("id % 5 <> 0"), c.where("id % 7 <> 0"), c.where("id % 3 = 0"), c.where("id % 31 = 0"))


@query(f"WITH {CAT} SELECT stable_key, CAST(floor((row_number() OVER (ORDER BY vote_count DESC, popularity DESC, stable_key) - 1) / 250) AS BIGINT) AS batch FROM cat")
def push_batches(spark, d):
    c = catalogue(spark, d).withColumn("stable_key", R.stable_key(F.col("media_type"), F.col("id")))
    return versions.batches(c, [-F.col("vote_count"), F.col("popularity").desc(), F.col("stable_key")]).select("stable_key", "batch")


@query("SELECT event_type, count(*) AS n, list_sort(list(value))[CAST(floor(0.5 * count(*)) AS INTEGER) + 1] AS p50, list_sort(list(value))[CAST(floor(0.95 * count(*)) AS INTEGER) + 1] AS p95, list_sort(list(value))[CAST(floor(0.99 * count(*)) AS INTEGER) + 1] AS p99, max(value) AS top FROM events GROUP BY 1")
def latency_pctl(spark, d):
    return wiki.latencies(table(spark, d, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("SELECT event_type AS kind, CASE WHEN value >= 50 THEN 'high' ELSE 'low' END AS outcome, count(*) AS n FROM events GROUP BY 1, 2")
def outcome_counters(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("kind"), F.when(F.col("value") >= 50, "high").otherwise("low").alias("outcome"))
    return wiki.outcomes(e)


# --- projections and predicates at the edges ---


@query("SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 404 WHEN page_id % 5 = 1 THEN 403 WHEN page_id % 5 = 2 THEN 400 ELSE 200 END AS status FROM pages")
def image_allow_list(spark, d):
    p = F.col("page_id")
    source = F.when(p % 5 == 1, F.lit("https://other.example/t/p/w185/a.jpg")).when(p % 5 == 2, F.lit("https://image.tmdb.org/t/p/w185/x/a.jpg")).otherwise(F.concat(F.lit("https://image.tmdb.org/t/p/w185/a"), p.cast("string"), F.lit(".webp")))
    url = F.concat(F.when(p % 5 == 0, F.lit("https://h.example/v2/poster?url=")).otherwise(F.lit("https://h.example/v1/poster?url=")), source, F.when(p % 2 == 0, F.lit("&size=portrait")).otherwise(F.lit("")))
    return table(spark, d, "pages").select("page_id", links.thumbnail_request(url)["status"].alias("status"))


@query(f"""WITH {CAT} SELECT stable_key, CASE WHEN media_type = 'tv' THEN 'TV series' ELSE 'Movie' END || ' · ' || year || ' · Original title: ' || original_title || CASE WHEN rt_score IS NOT NULL THEN ' · ' || CASE WHEN rt_score >= 60 THEN '🍅 ' ELSE '💥 ' END || rt_score || '% Rotten Tomatoes' ELSE '' END AS description,
  CASE WHEN media_type = 'tv' THEN 'TV series' ELSE 'Movie' END || '|catalogue|' || original_title AS keywords, coalesce(rt_score / 10.0, -1) AS rating, 'https://x.example/' || CASE WHEN media_type = 'tv' THEN 'tv_show/' ELSE 'movie/' END || id AS url FROM cat""")
def item_attributes(spark, d):
    rows = catalogue(spark, d).withColumn("stable_key", R.stable_key(F.col("media_type"), F.col("id")))
    items = links.search_items(rows, "https://x.example/")
    return items.select("stable_key", "description", F.array_join("keywords", "|").alias("keywords"), F.coalesce("rating", F.lit(-1.0)).alias("rating"), "url")


@query("SELECT r_regionkey AS qid, CASE WHEN r_regionkey % 2 = 0 THEN 'page:en:' || r_regionkey ELSE 'search:' || r_name END AS id, CASE WHEN r_regionkey % 2 = 0 THEN r_name ELSE 'Search online for \"' || r_name || '\"' END AS title FROM region")
def fallback_row(spark, d):
    r = table(spark, d, "region")
    merged = r.where("r_regionkey % 2 = 0").select(F.col("r_regionkey").alias("qid"), F.lit("en").alias("lang"), F.col("r_regionkey").alias("stable_key"), F.col("r_name").alias("title"), F.lit("English").alias("subtitle"), F.array(F.lit("open:en")).alias("actions"))
    return links.with_fallback(merged, r.select(F.col("r_regionkey").alias("qid"), F.col("r_name").alias("query")), {"en": "English"}).select("qid", "id", "title")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d-%H0000') AS hour, strftime(o_orderdate, '%m_%d_%Y') AS export FROM orders")
def date_stamps(spark, d):
    return table(spark, d, "orders").select("o_orderkey", links.pageview_stamp(F.col("o_orderdate")).alias("hour"), links.export_stamp(F.col("o_orderdate")).alias("export"))


@query("SELECT doc_id, sha256(to_base64(encode(text))) AS b64, text = decode(from_base64(to_base64(encode(text)))) AS same FROM documents")
def text_codecs(spark, d):
    b64 = R.to_base64(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.sha2(b64, 256).alias("b64"), (R.from_base64(b64) == F.col("text")).alias("same"))


@query("SELECT o_orderkey, o_orderkey % 4 > 0 AND 500000 - (o_orderkey % 1000) * 1000 <= 300000 AND o_orderkey % 3 > 0 AS fresh FROM orders")
def install_fresh(spark, d):
    k = F.col("o_orderkey")
    at = F.when(k % 4 > 0, (k % 1000) * 1000 + 1).otherwise(F.lit(0))
    return table(spark, d, "orders").select("o_orderkey", versions.install_is_fresh(at, F.lit(500_001), F.lit(300_000), k % 3 > 0).alias("fresh"))


@query("SELECT s_suppkey AS id, s_name AS title, CAST(1990 + s_nationkey AS INTEGER) AS year, greatest(s_acctbal, 0.0) AS popularity, CAST(CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey ELSE 0 END AS BIGINT) AS vote_count FROM supplier")
def api_projection(spark, d):
    k = F.col("s_suppkey")
    none = F.lit(None).cast("string")
    p = table(spark, d, "supplier").select(
        F.lit("tv").alias("media_type"), k.alias("id"), F.when(k % 2 == 0, F.col("s_name")).alias("title"), F.col("s_name").alias("name"), none.alias("original_title"), none.alias("original_name"), none.alias("release_date"), F.concat((F.lit(1990) + F.col("s_nationkey")).cast("string"), F.lit("-05-01")).alias("first_air_date"),
        F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("popularity"), F.when(k % 2 == 0, F.col("s_nationkey")).alias("vote_count"), none.alias("poster_path"), none.alias("imdb_id"),
    )
    return catalog.api_record(p).select("id", "title", "year", "popularity", "vote_count")


@query(f"WITH {CAT} SELECT stable_key FROM cat ORDER BY vote_count DESC, popularity DESC, title, stable_key LIMIT 100")
def top_by_votes(spark, d):
    rows = catalogue(spark, d).withColumn("stable_key", R.stable_key(F.col("media_type"), F.col("id")))
    return versions.top_by_votes(rows, 100).select("stable_key")


@query("SELECT strftime(ts, '%H') AS hour_file, count(*) AS sampled, count(*) FILTER (WHERE event_type = 'error') AS excluded FROM events GROUP BY 1")
def hourly_counters(spark, d):
    v = table(spark, d, "events").select(F.date_format("ts", "HH").alias("hour_file"), "event_type")
    return wiki.hourly_counters(v, v.where("event_type <> 'error'"))


from . import file_queries  # noqa: E402, F401  registers what is written and read back
