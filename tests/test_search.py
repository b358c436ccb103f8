from helpers import records
from pyspark.sql import functions as F

from marlpit.operators import catalog as C
from marlpit.operators import versions as V
from marlpit.plans import search as S

SMOKE = [
    {"id": 603, "title": "The Matrix", "year": 1999, "vote_count": 24500, "imdb_id": "tt0133093"}, {"id": 604, "title": "The Matrix Reloaded", "year": 2003, "vote_count": 10000, "imdb_id": "tt0234215"},
    {"id": 27205, "title": "Inception", "year": 2010, "vote_count": 34000, "imdb_id": "tt1375666"}, {"id": 1399, "media_type": "tv", "title": "Game of Thrones", "year": 2011, "vote_count": 22000}, {"id": 94605, "media_type": "tv", "title": "Arcane", "year": 2021, "vote_count": 4500},
]


def build(spark, rows):
    r = C.index_rows(C.latest(records(spark, *rows))).cache()
    return r, C.postings(r).cache()


def test_smoke(spark):
    rows, post = build(spark, SMOKE)
    run = lambda q: S.search(rows, post, q, now_year=2026).collect()
    assert rows.count() == 5
    assert run("matrix")[0].title == "The Matrix" and run("matrix")[0].imdb_id == "tt0133093"
    assert [run(q)[0].title for q in ("inception", "game of thrones", "arcane")] == ["Inception", "Game of Thrones", "Arcane"]
    assert run("arcane")[0].media_type == "tv"
    assert run("zzzqqq") == [] and run("  !!") == []
    assert [r.title for r in run("matrix 2003")] == ["The Matrix Reloaded"]


def test_original_title(spark):
    rows, post = build(spark, [{"id": 129, "title": "Spirited Away", "original_title": "千と千尋の神隠し", "year": 2001}, {"id": 1, "title": "Alpha"}])
    got = S.search(rows, post, "千と千尋", now_year=2026).collect()
    assert [(r.id, r.matched_original) for r in got] == [(129, True)]


def test_absent_and_zero_ratings(spark):
    rows, post = build(spark, [{"id": 1, "title": "A one", "rt_score": 88, "metacritic_score": 74, "imdb_rating": 87}, {"id": 2, "title": "A two"}, {"id": 3, "title": "A three", "rt_score": 0, "metacritic_score": 0, "imdb_rating": 0}])
    got = {r.id: (r.rt_score, r.metacritic_score, r.imdb_rating) for r in S.search(rows, post, "a", now_year=2026).collect()}
    assert got == {1: (88, 74, 87), 2: (None, None, None), 3: (0, 0, 0)}


def test_recency_and_votes(spark):
    f = lambda y, v: spark.range(1).select(S.within_tier(F.lit(y), F.lit(v), 2026).alias("x")).first().x
    assert [f(2026 - a, 0) for a in range(7)] == [3000, 2400, 1800, 1200, 600, 0, 0]
    assert f(0, 0) == 0 and f(2027, 0) == 3000 and f(2026, 10**9) == 3071


def test_batch_agrees_with_single(spark):
    rows, post = build(spark, SMOKE)
    qs = ["matrix", "the", "game thrones", "arc", "nothing", ""]
    got = S.search_batch(rows, post, spark.createDataFrame(list(enumerate(qs)), "qid int, query string"), now_year=2026).collect()
    for i, q in enumerate(qs):
        want = [(r.stable_key, round(r.score, 6)) for r in S.search(rows, post, q, now_year=2026).collect()]
        assert [(r.stable_key, round(r.score, 6)) for r in sorted(got, key=lambda r: r["rank"]) if r.qid == i] == want


def test_no_candidate_is_missed(spark):
    rows, post = build(spark, SMOKE)
    data = {r.row: {p.term for p in post.collect() if p.row == r.row} for r in rows.collect()}
    for q in (["m"], ["the", "m"], ["20"], ["re", "ma"], ["t"]):
        want = {r for r, terms in data.items() if all(any(t.startswith(x) for t in terms) for x in q)}
        assert {r.row for r in S.candidates(post, q).collect()} == want
    assert S.candidates(post, ["t"], cap=1).count() == 1


def test_chain(spark):
    rows, _ = build(spark, [{"id": 1, "title": "Old Title"}, {"id": 2, "title": "Keep"}, {"id": 3, "title": "Gone"}])
    new, _ = build(spark, [{"id": 1, "title": "New Title"}])
    all_rows = rows.withColumn("seq", F.lit(0)).unionByName(new.withColumn("seq", F.lit(1)).withColumn("row", F.col("row") + 100))
    gone = spark.createDataFrame([(1, 2), (1, 6)], "seq int, stable_key long")
    post = C.postings(all_rows)
    find = lambda q: [r.title for r in S.search(all_rows, post, q, now_year=2026, superseded=gone).collect()]
    assert find("title") == ["New Title"] and find("old") == [] and find("gone") == [] and find("keep") == ["Keep"]
    assert {r.title for r in V.snapshot(all_rows.select("stable_key", "seq", "title"), gone).collect()} == {"New Title", "Keep"}


PROVIDER = [
    {"id": 603, "title": "The Matrix Resurrections", "year": 2021, "poster_path": "/matrix2.jpg"}, {"id": 1399, "media_type": "tv", "title": "Game of Thrones", "year": 2011, "imdb_rating": 93},
    {"id": 140, "title": "Bad Education", "original_title": "La mala educación", "year": 2004, "rt_score": 86, "metacritic_score": 78, "imdb_rating": 76}, {"id": 700, "title": "Alpha", "year": 2001}, {"id": 701, "title": "Alphabet Soup", "year": 2002},
]


def test_candidate_rows(spark):
    rows, post = build(spark, PROVIDER)

    def top(q, pref=None):
        from marlpit.functions.records import rating_preference

        return S.to_candidates(S.search(rows, post, q, now_year=2026), rating_preference(pref)).orderBy(F.col("score").desc()).collect()

    m = top("matrix")[0]
    assert (m.id, m.title, m.subtitle, m.label, m.poster_url, m.keywords) == ("movie:603", "The Matrix Resurrections", "2021", "Movie", "https://image.tmdb.org/t/p/w92/matrix2.jpg", [])
    m = top("mala educación")[0]
    assert (m.title, m.subtitle, m.keywords) == ("La mala educación", "Bad Education · 2004 · 🍅 86%", ["Bad Education"])
    m = top("bad education")[0]
    assert (m.title, m.subtitle) == ("Bad Education", "La mala educación · 2004 · 🍅 86%")
    assert top("bad education", {"ratings": {"movie": "metacritic"}})[0].subtitle == "La mala educación · 2004 · 🟢 78"
    assert top("bad education", {"ratings": {"movie": ["metacritic", "rt"]}})[0].subtitle == "La mala educación · 2004 · 🟢 78 · 🍅 86%"
    g = top("game of thrones")[0]
    assert (g.subtitle, g.label) == ("2011 · ⭐ 9.3", "TV Show")
    scores = [r.score for r in top("alpha")]
    assert scores[0] == 1 and scores == sorted(scores, reverse=True) and all(0 < s <= 1 for s in scores)


def test_activation(spark):
    got = [spark.range(1).select(S.activation_url(F.lit(x), "https://x.example/").alias("u")).first().u for x in ("movie:1", "tv:2", "movie:", "")]
    assert got == ["https://x.example/movie/1", "https://x.example/tv_show/2", None, None]


def test_session(spark, tmp_path):
    from marlpit.sources.sinks import write_index

    rows, post = build(spark, SMOKE)
    for v in ("a", "b"):
        write_index(rows, post, spark.createDataFrame([], "seq int, stable_key long"), f"{tmp_path}/{v}")
    at = [f"{tmp_path}/a"]
    s = S.SearchSession(spark, lambda: at[0], refresh_s=10)
    assert s.search("matrix", now=0, now_year=2026).first().id == "movie:603"
    at[0] = f"{tmp_path}/nope"
    assert s.search("matrix", now=99, now_year=2026).first().id == "movie:603" and s.path.endswith("/a")
    at[0] = f"{tmp_path}/b"
    s.search("matrix", now=199, now_year=2026)
    assert s.path.endswith("/b")
