import pytest
from helpers import records
from pyspark.sql import functions as F

from marlpit.functions import links as L
from marlpit.operators import catalog as C
from marlpit.plans import build as B
from marlpit.plans import search as S
from marlpit.sources import binary_index as X
from marlpit.sources import lookup as K

LOG = [{"id": 1, "title": "Old Title One"}, {"id": 2, "title": "Keep Two"}, {"id": 3, "title": "Gone Three"}]
LATER = [*LOG, {"id": 1, "title": "New Title One", "fetched_at": 2000}, {"id": 4, "title": "Brand New Four", "fetched_at": 2000}]


def exp(spark, *ids):
    return spark.createDataFrame([("movie", i, "", 1.0, False) for i in ids], "media_type string, id long, original_title string, popularity double, adult boolean")


def test_base_and_delta(spark, tmp_path):
    assert B.build_base(records(spark, *LOG), exp(spark, 1, 2, 3), f"{tmp_path}/base").count() == 3
    assert B.build_base(records(spark, *LOG), exp(spark, 1, 2), f"{tmp_path}/filtered").count() == 2
    assert B.build_delta(records(spark, *LATER), exp(spark, 1, 2, 4), 1500, f"{tmp_path}/d1").count() == 2
    rows, post, gone = B.chain_tables(spark, [f"{tmp_path}/base", f"{tmp_path}/d1"])
    assert gone.count() == 3
    find = lambda q: [r.title for r in S.search(rows, post, q, now_year=2026, superseded=gone).collect()]
    assert find("old title") == [] and find("new title") == ["New Title One"] and find("gone three") == [] and find("keep") == ["Keep Two"] and find("brand") == ["Brand New Four"]
    snap = B.snapshot_of(spark, [f"{tmp_path}/base", f"{tmp_path}/d1"])
    assert sorted(r.title for r in snap.collect()) == ["Brand New Four", "Keep Two", "New Title One"]
    assert B.snapshot_of(spark, [f"{tmp_path}/base", f"{tmp_path}/d1"], 1).count() == 1


def test_marker(spark, tmp_path):
    assert B.read_marker(spark, f"{tmp_path}/m") is None
    B.advance_marker(spark, f"{tmp_path}/m", 1500)
    assert B.read_marker(spark, f"{tmp_path}/m") == 1500


def test_band_and_entities(spark, tmp_path):
    r = C.latest(records(spark, *[{"id": k, "title": f"Title {k}", "popularity": float(k)} for k in range(300)]))
    assert 1 <= B.build_band(r, f"{tmp_path}/band", 60_000, start=50) <= 300
    bands = spark.createDataFrame([("en", "X", 2, 9), ("de", "X", 4, 9), ("en", "Y", 6, 1)], "lang string, title string, stable_key long, vote_count long")
    bind = spark.createDataFrame([(1, "en", "X", 0), (1, "de", "X", 1), (2, "en", "Y", 2)], "item long, lang string, title string, position long")
    assert sorted((r.lang, r.stable_key, r.group_id) for r in B.build_entity_map(bands, bind, 1, f"{tmp_path}/map").collect()) == [("de", 4, 1), ("en", 2, 1)]
    w = spark.createDataFrame([("movie", 5, "A", "en.wikipedia.org", 0, 6.4, 7, "2026-09-25", None)], "media_type string, id long, title string, original_title string, year int, popularity double, vote_count long, changed_on string, prev_id long")
    got = B.build_wiki_delta(w, spark.createDataFrame([], "id long"), "", f"{tmp_path}/wd").first()
    assert (got.popularity, got.vote_count) == (2.0, 2)


def test_publish(spark, tmp_path):
    (tmp_path / "assets").mkdir()
    (tmp_path / "assets" / "base.idx.gz").write_bytes(b"x")
    (tmp_path / "assets" / "stale").write_bytes(b"y")
    files = spark.createDataFrame([("base.idx", "base", 0, b"abc")], "name string, role string, position int, content binary")
    m, stray = B.publish_version(spark, str(tmp_path), files, 3, "now")
    assert m.first().base.name == "base.idx" and [r.name for r in stray.collect()] == ["stale"]
    more = files.unionByName(spark.createDataFrame([("d1", "delta", 0, b"d")], files.schema))
    with pytest.raises(RuntimeError):
        B.publish_version(spark, str(tmp_path), more, 4, "now")
    assert spark.read.json(f"{tmp_path}/manifest").first().version == 4


def test_binary_round_trip(spark, tmp_path):
    rows = C.index_rows(C.latest(records(spark, {"id": 603, "title": "The Matrix", "year": 1999, "rt_score": 0, "poster_path": "/a.jpg"}, {"id": 129, "media_type": "tv", "title": "Spirited Away", "original_title": "千と千尋の神隠し", "imdb_rating": 86, "popularity": 2.5})))
    rows = rows.withColumn("imdb_num", F.lit(133093)).withColumn("band", F.lit("en"))
    post = C.postings(rows).withColumn("band", F.lit("en"))
    gone = spark.createDataFrame([("en", 8), ("en", 6)], "band string, stable_key long")
    content = X.index_files(rows, post, gone, "band").first().content
    (tmp_path / "i.idx").write_bytes(content)
    got = {r.id: r for r in X.read_rows(spark, f"{tmp_path}/i.idx").collect()}
    assert (got[603].title, got[603].rt_score, got[603].imdb_rating, got[603].stable_key, got[603].poster_path) == ("The Matrix", 0, None, 1206, "/a.jpg")
    assert (got[129].original_title, got[129].media_type, got[129].popularity, got[129].imdb_rating) == ("千と千尋の神隠し", "tv", 2.5, 86)
    assert {(r.term, r.row) for r in X.read_postings(spark, f"{tmp_path}/i.idx").collect()} == {(r.term, r.row) for r in post.collect()}
    assert [r.stable_key for r in X.read_superseded(spark, f"{tmp_path}/i.idx").collect()] == [6, 8]
    for bad in (b"", b"XX" + content[2:], content[:8] + b"\4" + content[9:], content[:200]):
        with pytest.raises(ValueError):
            X.header(bad)
    assert X.header(X.encode_index([], []))["rows"] == 0


def test_groups_round_trip(spark, tmp_path):
    by_row, by_group = [(1206, 7), (2208, 4), (4022, 9), (9010, 12)], [(4, 11), (7, 3), (9, 40), (12, 90)]
    content = X.encode_groups(3, by_row[::-1], by_group)
    (tmp_path / "g").write_bytes(content)
    got = X.read_groups(spark, f"{tmp_path}/g").collect()
    assert {(r.key, r.value) for r in got if r.direction == "by_row"} == set(by_row) and {(r.key, r.value) for r in got if r.direction == "by_group"} == set(by_group)
    for bad in (b"", b"TCWG0001" + content[8:], content[:-1]):
        with pytest.raises(ValueError):
            X._groups(bad)


def test_lookup(spark):
    def fetch(key):
        return {"a": (200, "A", None), "b": (404, None, None)}.get(key, (403, None, None))

    got = {r.key: (r.status, r.body, r.outcome) for r in K.lookup(spark.createDataFrame([("a",), ("b",), ("c",)], "key string"), fetch, per_second=1000, partitions=2).collect()}
    assert got == {"a": (200, "A", "ok"), "b": (404, None, "gone"), "c": (403, None, "error")}
    waits, answers = [], iter([(429, None, 3.0), (500, None, None), (200, "x", None)])
    assert K.one("k", lambda _: next(answers), sleep=waits.append) == (200, "x", 3) and waits == [3.0, 2.0]
    assert K.one("k", lambda _: (503, None, None), retries=1, sleep=waits.append)[0] == 503
    assert K.chunked(list("abcde"), 2) == [["a", "b"], ["c", "d"], ["e"]]


@pytest.mark.parametrize(
    "url,status",
    [
        ("https://h/v1/poster?url=https%3A%2F%2Fimage.tmdb.org%2Ft%2Fp%2Fw185%2Fa_b-1.JPG", 200), ("https://h/v1/poster?url=https://image.tmdb.org/t/p/w185/a.png&size=portrait", 200), ("https://h/v1/poster?url=https://image.tmdb.org/t/p/w185/a.png&size=big", 400),
        ("https://h/v1/other?url=https://image.tmdb.org/t/p/w185/a.png", 404), ("https://h/v1/poster", 404), ("https://h/v1/poster?url=x&url=y", 404), ("https://h/v1/poster?url=x&z=1", 404), ("https://h/v1/poster?url=http://image.tmdb.org/t/p/w185/a.png", 400),
        ("https://h/v1/poster?url=https://u@image.tmdb.org/t/p/w185/a.png", 400), ("https://h/v1/poster?url=https://image.tmdb.org:444/t/p/w185/a.png", 400), ("https://h/v1/poster?url=https://evil.example/t/p/w185/a.png", 403), ("https://h/v1/poster?url=https://image.tmdb.org/t/p/w185/../a.png", 400),
        ("https://h/v1/poster?url=https://image.tmdb.org/t/p/w185/a.svg", 400), ("https://h/v1/poster?url=https%3A%2F%2Fimage.tmdb.org%2Ft%2Fp%2Fw185%2Fa.png%3Fq", 400),
    ],
)
def test_thumbnail_request(spark, url, status):
    assert spark.range(1).select(L.thumbnail_request(F.lit(url)).alias("r")).first().r.status == status


def test_links(spark):
    r = spark.range(1).select(L.pageview_stamp(F.lit("2026-09-24 07:00:00").cast("timestamp")).alias("p"), L.export_stamp(F.lit("2026-09-04").cast("date")).alias("e")).first()
    assert tuple(r) == ("20260924-070000", "09_04_2026")
    rows = C.index_rows(C.latest(records(spark, {"id": 3, "media_type": "tv", "title": "A", "original_title": "B", "rt_score": 59})))
    i = L.search_items(rows, "https://x.example/").first()
    assert (i.description, i.keywords, i.rating, i.url, i.content_type) == ("TV series · 2000 · Original title: B · 💥 59% Rotten Tomatoes", ["TV series", "catalogue", "B"], 5.9, "https://x.example/tv_show/3", "public.tv-show")
    merged = spark.createDataFrame([(1, "en", 4, "T", "English", ["open:en"])], "qid int, lang string, stable_key long, title string, subtitle string, actions array<string>")
    got = {r.qid: r for r in L.with_fallback(merged, spark.createDataFrame([(1, "t"), (2, "zz")], "qid int, query string"), {"en": "English", "de": "German"}).collect()}
    assert got[1].id == "page:en:4" and got[2].id == "search:zz" and got[2].actions == ["search:en", "search:de"]


def test_log_of_several_files(spark, tmp_path):
    """The last line of the last file by name wins, whatever the sizes of the files."""
    import json

    from marlpit.sources import readers

    small = [{"id": 1, "title": "old"}, {"id": 2, "title": "only here"}]
    large = [{"id": k, "title": f"filler {k} " * 40} for k in range(100, 3000)] + [{"id": 1, "title": "newer"}, {"id": 1, "title": "newest"}]
    for name, lines in (("a.ndjson", small), ("b.ndjson", large), ("c.ndjson", [{"id": 7, "title": "last"}])):
        (tmp_path / name).write_text("\n".join(map(json.dumps, lines)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        log = readers.store_log(spark, f"{tmp_path}/*.ndjson")
        got = {r.id: r.title for r in C.latest(log).where("id < 10").collect()}
        order = [r.title for r in log.where("id < 10").orderBy("_ingest_seq").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {1: "newest", 2: "only here", 7: "last"} and order == ["old", "only here", "newer", "newest", "last"]
    with pytest.raises(ValueError):
        readers.id_export(spark, _empty(tmp_path), None)


def _empty(tmp_path):
    (tmp_path / "empty.json").write_text("")
    return f"{tmp_path}/empty.json"


def test_places(spark, tmp_path):
    from marlpit.sources.files import Places

    (tmp_path / "f").write_bytes(bytes(range(250)) * 100)
    f = Places(spark, f"{tmp_path}/f", gap=100)
    want = [(20_000, 5), (0, 3), (50, 10), (140, 2), (9_000, 0), (2, 300)]
    assert f.spans(want) == [(bytes(range(250)) * 100)[a : a + n] for a, n in want] and f.reads == 3
    with pytest.raises(ValueError):
        f.read(24_990, 11)
    f.close()


def test_install_refuses(spark, tmp_path):
    """A missing base and a wrong hash raise and leave no part; a missing delta is skipped."""
    from marlpit.operators import versions
    from marlpit.sources import files

    rows = [("own-0", "base", 0, b"base"), ("own-1", "delta", 1, b"delta")]
    m = versions.build_manifest(spark.createDataFrame(rows, "name string, role string, position int, content binary"), 1, "now")
    source, target = f"{tmp_path}/s", f"{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        B.install(spark, m, source, target, "own-", 1)
    files.write_bytes(spark, f"{source}/own-0", b"changed")
    with pytest.raises(ValueError):
        B.install(spark, m, source, target, "own-", 1)
    assert files.names(spark, target) == []
    files.write_bytes(spark, f"{source}/own-0", b"base")
    assert set(B.install(spark, m, source, target, "own-", 1)) == {"own-0"}
    assert files.names(spark, target) == ["installed.json", "own-0"]


def test_chunks_are_asked_again(spark):
    keys = spark.createDataFrame([(f"http://x.example/{k}",) for k in range(7)], "key string")
    waits = []
    with pytest.raises(Exception, match="no answer"):
        K.lookup_chunks(keys, lambda request: (503, None), "page string", size=3, attempts=2, wait=0.0).collect()
    assert K.values_request(["a b", "c"], "p") == "VALUES ?p { <a%20b> <c> }" and not waits
