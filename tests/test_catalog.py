"""Record fixtures: stores, bands, deltas, queues."""

from helpers import records
from pyspark.sql import functions as F

from marlpit.operators import catalog as C


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def exp(spark, *rows):
    return spark.createDataFrame([("movie", i, "", 1.0, adult) for i, adult in rows], "media_type string, id long, original_title string, popularity double, adult boolean")


def test_latest_keeps_position(spark):
    log = records(spark, {"id": 1, "title": "Amélie"}, {"id": 2, "media_type": "tv", "title": "千と千尋の神隠し"}, {"id": 3, "title": "Ночной дозор"}, {"id": 1, "title": "Amélie (updated)"})
    got = C.latest(log).orderBy("first_position").collect()
    assert [(r.id, r.title) for r in got] == [(1, "Amélie (updated)"), (2, "千と千尋の神隠し"), (3, "Ночной дозор")]


def test_band(spark):
    r = records(spark, {"id": 1, "vote_count": 500}, {"id": 2, "vote_count": 1, "rt_score": 65}, {"id": 3, "vote_count": 2}, {"id": 4, "vote_count": 5}, {"id": 5, "vote_count": 4}, {"id": 6, "vote_count": 0, "rt_score": 0}, {"id": 7, "vote_count": 0, "metacritic_score": 90})
    assert ids(C.band(r)) == [1, 2, 4, 6]
    assert tuple(C.band_counts(r).select("kept", "dropped").first()) == (4, 3)


def test_delta(spark):
    log = records(spark, {"id": 1, "title": "Old Title One"}, {"id": 2, "title": "Keep Two"}, {"id": 3, "title": "Gone Three"}, {"id": 1, "title": "New Title One", "fetched_at": 2000}, {"id": 4, "title": "Brand New Four", "fetched_at": 2000})
    rows, gone = C.delta(C.latest(log), exp(spark, (1, False), (2, False), (4, False)), 1500)
    assert sorted((r.id, r.title) for r in rows.collect()) == [(1, "New Title One"), (4, "Brand New Four")]
    assert sorted(r.stable_key for r in gone.collect()) == [2, 6, 8]
    rows, gone = C.delta(C.latest(log), None, 1500)
    assert sorted(r.stable_key for r in gone.collect()) == [2, 8]


def test_live_and_new(spark):
    r = records(spark, {"id": 1}, {"id": 2}, {"id": 3})
    e = exp(spark, (1, False), (2, True), (9, False), (8, True))
    assert ids(C.live(r, e)) == [1] and ids(C.live(r, None)) == [1, 2, 3]
    assert ids(C.unseen(e, r)) == [9]


def test_retitled(spark):
    r = records(spark, {"id": 1, "original_title": "A"}, {"id": 2, "original_title": "B"}, {"id": 3, "original_title": "C"})
    e = spark.createDataFrame([("movie", 1, " A "), ("movie", 2, "X"), ("movie", 3, "  ")], "media_type string, id long, original_title string")
    assert [(x.id, x.new_title) for x in C.retitled(e, r).collect()] == [(2, "X")]


def test_daily_update_leaves_adult_rows_out_one_by_one(spark):
    """An adult row retitles nothing, even where another row of the export lists its key as not adult."""
    r = records(spark, {"id": 1, "original_title": "A"}, {"id": 2, "original_title": "B"}, {"id": 3, "original_title": "C"})
    rows = [(1, "A", False), (1, "X", True), (2, "Y", False), (2, "B", True), (3, "Z", True), (9, "N", False)]
    e = spark.createDataFrame([("movie", i, t, 1.0, a) for i, t, a in rows], "media_type string, id long, original_title string, popularity double, adult boolean")
    assert sorted((x.id, x.reason) for x in C.plan_daily_update(r, e).collect()) == [(1, "stale"), (2, "retitled"), (9, "new")]


def test_rating_queue(spark):
    day = 86_400_000
    now = 1000 * day
    r = records(
        spark,
        {"id": 1, "vote_count": 50, "imdb_id": "tt1"}, {"id": 2, "vote_count": 900, "imdb_id": "tt2"}, {"id": 3, "vote_count": 900, "imdb_id": " "},
        {"id": 4, "imdb_id": "tt4", "rt_score": 50, "ratings_at": now - 40 * day}, {"id": 5, "imdb_id": "tt5", "rt_score": 50, "ratings_at": now - 90 * day},
        {"id": 6, "imdb_id": "tt6", "ratings_at": now - 90 * day}, {"id": 7, "imdb_id": "tt7", "rt_score": 50, "ratings_at": now - 10 * day}, {"id": 8, "vote_count": 1, "imdb_id": "tt8"},
        {"id": 9, "vote_count": 1, "year": 2026, "imdb_id": "tt9"},
    )
    assert [x.id for x in C.rating_queue(r, now, 2026, 30).collect()] == [2, 1, 9, 5, 4]


def test_rating_changes(spark):
    r = records(spark, {"id": 1, "imdb_id": "tt1", "imdb_rating": 50}, {"id": 2, "imdb_id": "tt2"}, {"id": 3, "imdb_id": "tt3", "imdb_rating": 70})
    d = spark.createDataFrame([("tt1", 50), ("tt2", 61), ("tt3", 71)], "imdb_id string, imdb_rating int")
    assert sorted((x.id, x.imdb_rating, x.fetched_at) for x in C.rating_changes(r, d, 77).collect()) == [(2, 61, 77), (3, 71, 77)]


def test_next_mode(spark):
    rows = [(None, False, 0), (5, True, 0), (5, False, 29), (5, False, 30), (5, None, 0)]
    df = spark.createDataFrame(rows, "m int, r boolean, n int").select(C.next_mode(F.col("m"), F.col("r"), F.col("n")).alias("x"))
    assert [r.x for r in df.collect()] == ["base", "base", "delta", "base", "delta"]


def test_number_rows_is_gapless(spark):
    df = spark.range(1000).withColumn("k", (F.col("id") * 7919) % 1000 % 37)
    got = C.number_rows(df, [F.col("k"), F.col("id")], "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(1000))
    assert [(r.k, r.id) for r in got] == sorted((r.k, r.id) for r in got)


def test_index_rows_skip_untitled(spark):
    r = C.latest(records(spark, {"id": 1, "title": "A"}, {"id": 2, "original_title": "B"}, {"id": 3}))
    rows = C.index_rows(r)
    assert [(x.row, x.title) for x in rows.orderBy("row").collect()] == [(0, "A"), (1, "B")]
    assert {(p.term, p.row) for p in C.postings(rows).collect()} == {("a", 0), ("2000", 0), ("b", 1), ("2000", 1)}


def test_queues(spark):
    r = records(spark, {"id": 1, "media_type": "tv", "vote_count": 3}, {"id": 2, "media_type": "tv", "vote_count": 9}, {"id": 3, "media_type": "tv", "imdb_id": "tt3"}, {"id": 4})
    assert [x.id for x in C.missing_id_queue(r).collect()] == [2, 1]
    p = spark.createDataFrame([("movie", 1, None, "N", None, "O", "1999-05-01", None, None, 3, "/p", "tt1")], "media_type string, id long, title string, name string, original_title string, original_name string, release_date string, first_air_date string, popularity double, vote_count int, poster_path string, imdb_id string")
    x = C.api_record(p).first()
    assert (x.title, x.original_title, x.year, x.popularity, x.vote_count) == ("N", "O", 1999, 0.0, 3)
