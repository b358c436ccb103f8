"""Search over an index of rows and postings: candidates by term prefix, tiered score, top k.

One query is a plan with literal prefixes, pushed down to the sorted postings.  A table of queries is one job: query terms
meet index terms by an equi-join on prefixes of just those lengths that the queries have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import records as R
from ..functions.text import all_terms_match, fold_text, is_subsequence, tokenize
from ..operators import versions
from ..operators.catalog import folded

#: Points of the score's tiers.
EXACT, PREFIX, TOKEN_PREFIX, TOKEN_INSIDE, SUBSEQUENCE = 1048576, 262144, 65536, 16384, 4096
ORIGINAL_EXACT, ORIGINAL_PREFIX, ORIGINAL_TOKEN, YEAR, WITHIN = 1024, 512, 256, 32, 3071


def within_tier(year: Column, votes: Column, now_year: int) -> Column:
    """Recency and votes, capped so that they only order what the text scores alike."""
    age = F.greatest(F.lit(0), F.lit(now_year) - year)
    recency = F.when((F.coalesce(year, F.lit(0)) <= 0) | (age > 5), F.lit(0.0)).otherwise(F.round(3000 * (1 - age / 5)))
    by_votes = F.when(F.coalesce(votes, F.lit(0)) <= 0, F.lit(0.0)).otherwise(F.least(F.lit(2500.0), F.log(1 + votes.cast("double")) * 260))
    return F.least(F.lit(float(WITHIN)), recency + by_votes)


def score(title: Column, original: Column, query: Column, terms: Column, year: Column, votes: Column, now_year: int) -> Column:
    """Points of a folded title and original title for a folded query and its terms."""
    words, owords = tokenize(title), tokenize(original)
    pts = lambda cond, n: F.when(cond, F.lit(n)).otherwise(F.lit(0))
    length = F.length(query)
    other = (original != "") & (original != title)
    single = (
        pts(title == query, EXACT)
        + pts(F.startswith(title, query), PREFIX)
        + pts(F.exists(words, lambda w: (w != title) & F.startswith(w, query)), TOKEN_PREFIX)
        + pts((length >= 2) & F.exists(words, lambda w: (w != query) & F.contains(w, query)), TOKEN_INSIDE)
        + pts((length >= 3) & is_subsequence(query, title), SUBSEQUENCE)
        + F.when(~other, F.lit(0)).when(original == query, F.lit(ORIGINAL_EXACT)).when(F.startswith(original, query), F.lit(ORIGINAL_PREFIX)).when(F.exists(owords, lambda w: F.startswith(w, query)), F.lit(ORIGINAL_TOKEN)).otherwise(F.lit(0))
    )
    several = pts(title == query, EXACT) + pts(F.startswith(title, query), PREFIX) + pts((length >= 4) & F.contains(title, query), TOKEN_INSIDE) + pts((original == query) & (original != title), ORIGINAL_EXACT)
    in_year = pts(F.exists(terms, lambda t: F.regexp_like(t, F.lit("^[0-9]{4}$")) & (t.try_cast("int") == year)), YEAR)
    return F.when(F.size(terms) == 1, single).otherwise(several) + in_year + within_tier(year, votes, now_year)


def fold_query(spark: SparkSession, query: str) -> tuple[str, list[str]]:
    """The folded query and its terms, folded by the same expression as the index; evaluated on the driver, without a job."""
    got = _FOLDED.get(query)
    if got is None:
        # A projection of a local row is evaluated by the optimizer.
        row = spark.sql("SELECT q FROM VALUES (:q) AS t(q)", args={"q": query}).select(fold_text(F.col("q")).alias("q")).select("q", tokenize(F.col("q")).alias("t")).first()
        if len(_FOLDED) >= 10_000:
            _FOLDED.clear()
        got = _FOLDED[query] = (row.q, list(row.t))
    return got


_FOLDED: dict[str, tuple[str, list[str]]] = {}


def candidates(postings: DataFrame, terms: list[str], cap: int | None = None) -> DataFrame:
    """Rows that have every term as the beginning of some indexed token.  ``cap`` keeps the first candidates in term and
    row order, as an index with a candidate pool would; without it the result is exact."""
    if not terms:
        return postings.select("row").limit(0)
    terms = [t for t in set(terms) if not any(o != t and o.startswith(t) for o in terms)]
    hit = postings.where(F.col("term").startswith(terms[0]))
    out = hit.groupBy("row").agg(F.min("term").alias("term"))
    for t in terms[1:]:
        out = out.join(postings.where(F.col("term").startswith(t)).select("row"), "row", "left_semi")
    return (out.orderBy("term", "row").limit(cap) if cap else out).select("row")


def search(rows: DataFrame, postings: DataFrame, query: str, *, now_year: int, limit: int = 10, candidate_pool: int | None = None, superseded: DataFrame | None = None) -> DataFrame:
    """The best ``limit`` rows for one query, score descending, ties by stable key.

    ``rows`` may be a chain (column ``seq``) with ``superseded(seq, stable_key)``; ``row`` must then be unique over it.
    """
    q, terms = fold_query(rows.sparkSession, query)
    if not terms:
        return _result(rows.limit(0).withColumns({"score": F.lit(0.0), "matched_original": F.lit(False)}))
    got = rows.join(candidates(postings, terms, candidate_pool), "row", "left_semi")
    if superseded is not None:
        got = versions.resolve(got, superseded)
    got = got.withColumns({"_t": folded(got, "title"), "_o": folded(got, "original")})
    term_array = F.array(*[F.lit(t) for t in terms])
    got = got.withColumn("score", score(F.col("_t"), F.col("_o"), F.lit(q), term_array, F.col("year"), F.col("vote_count"), now_year))
    got = got.withColumn("matched_original", matched_original(F.col("_t"), F.col("_o"), term_array))
    return _result(got.orderBy(F.col("score").desc(), "stable_key").limit(limit))


def matched_original(title: Column, original: Column, terms: Column) -> Column:
    """Whether the query is about the original title: that matches in full and the title doesn't."""
    return (original != "") & (original != title) & all_terms_match(original, terms) & ~all_terms_match(title, terms)


def _result(got: DataFrame) -> DataFrame:
    return got.select(
        "stable_key", "media_type", "id", R.imdb_format(R.imdb_num(F.col("imdb_id"))).alias("imdb_id"), "title", "original_title", F.nullif("year", F.lit(0)).alias("year"), "vote_count", R.poster_url(F.col("poster_path")).alias("poster_url"),
        "matched_original", "rt_score", "metacritic_score", "imdb_rating", "score",
    )


def search_batch(rows: DataFrame, postings: DataFrame, queries: DataFrame, *, now_year: int, limit: int = 10) -> DataFrame:
    """``qid, rank, stable_key, title, score`` for a table ``queries(qid, query)``, in one job.

    The prefix join is an equi-join: the index's distinct terms are cut to the lengths that query terms have.  Query terms
    of one length that nobody asked for cost nothing, and no side is assumed small.
    """
    q = queries.select("qid", fold_text(F.col("query")).alias("q")).withColumn("terms", tokenize(F.col("q"))).where(F.size("terms") > 0)
    asked = q.select("qid", F.explode(F.array_distinct("terms")).alias("prefix"))
    lengths = sorted(r[0] for r in asked.select(F.length("prefix")).distinct().collect())  # as many as a term has lengths
    if not lengths:
        return rows.limit(0).select(F.lit(0).alias("qid"), F.lit(1).alias("rank"), "stable_key", "title", F.lit(0.0).alias("score"))
    prefixes = asked.select("prefix").distinct()
    edges = postings.select("term").distinct().select("term", F.explode(F.array(*[F.when(F.length("term") >= n, F.left("term", F.lit(n))) for n in lengths])).alias("prefix")).where("prefix is not null")
    of_prefix = edges.join(prefixes, "prefix").join(postings, "term").select("prefix", "row").distinct()
    need = q.select("qid", F.size(F.array_distinct("terms")).alias("need"))
    hit = asked.join(of_prefix, "prefix").groupBy("qid", "row").agg(F.count("*").alias("n")).join(need, "qid").where("n = need").select("qid", "row")
    got = hit.join(rows, "row").join(q, "qid")
    got = got.withColumn("score", score(folded(got, "title"), folded(got, "original"), F.col("q"), F.col("terms"), F.col("year"), F.col("vote_count"), now_year))
    rank = F.row_number().over(W.partitionBy("qid").orderBy(F.col("score").desc(), "stable_key"))
    return got.withColumn("rank", rank).where(F.col("rank") <= limit).select("qid", "rank", "stable_key", "title", "score")


def to_candidates(results: DataFrame, preference: dict) -> DataFrame:
    """Search results as list rows: the title that matched leads, the other follows with year and scores; scores relative
    to the best (null where that is not above 0)."""
    leads = F.col("matched_original") & (F.coalesce("original_title", F.lit("")) != "")
    name = F.when(leads, F.col("original_title")).otherwise(F.col("title"))
    alt = F.when(leads, F.col("title")).otherwise(F.col("original_title"))
    differs = (F.coalesce(alt, F.lit("")) != "") & (fold_text(alt) != fold_text(name))
    texts = R.rating_texts(F.col("media_type"), preference, {s: F.col(c) for s, c in R.RATING_COLUMNS.items()})
    parts = F.concat(F.array(F.when(differs, alt), F.col("year").cast("string")), texts)
    results = results.crossJoin(F.broadcast(results.agg(F.max("score").alias("_top"))))  # one row
    top = F.col("_top")
    return results.select(
        R.text_key(F.col("media_type"), F.col("id")).alias("id"), name.alias("title"), F.nullif(F.array_join(F.filter(parts, lambda p: p.isNotNull()), " · "), F.lit("")).alias("subtitle"), F.when(differs, F.array(alt)).otherwise(F.array().cast("array<string>")).alias("keywords"),
        "poster_url", F.when(F.col("media_type") == "tv", "TV Show").otherwise("Movie").alias("label"), F.when(top > 0, F.col("score") / top).alias("score"),
    )


def activation_url(result_id: Column, base: str) -> Column:
    """Where a result opens: routed by the kind in its id; null without an id."""
    kind, key = F.split(result_id, ":")[0], F.get(F.split(result_id, ":"), F.lit(1))
    return F.when(F.coalesce(key, F.lit("")) != "", F.concat(F.lit(base), F.when(kind == "tv", F.lit("tv_show/")).otherwise(F.lit("movie/")), key))


class SearchSession:
    """An open index, reopened when the manifest's version moves; the last good one serves if that fails."""

    def __init__(self, spark: SparkSession, resolve_path, refresh_s: float = 6 * 3600) -> None:
        self.spark, self.resolve_path, self.refresh_s = spark, resolve_path, refresh_s
        self.path, self.tables, self.checked = None, None, 0.0
        self.failure: Exception | None = None

    def _ensure(self, now: float):
        from ..sources.sinks import open_index

        if self.tables is None or now - self.checked > self.refresh_s:
            try:
                path = self.resolve_path()
                if path != self.path:
                    self.tables, self.path = open_index(self.spark, path), path
                self.checked = now
            except Exception as e:  # whatever it is: the last good index serves, and the caller can see why
                if self.tables is None:
                    raise
                self.failure = e
        return self.tables

    def search(self, query: str, *, now: float, now_year: int, limit: int = 10, preference: dict | None = None) -> DataFrame:
        rows, postings, _ = self._ensure(now)
        return to_candidates(search(rows, postings, query, now_year=now_year, limit=limit), R.rating_preference(preference))
