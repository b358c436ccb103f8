from pyspark.sql import functions as F

from marlpit.operators import versions as V
from marlpit.operators import wiki as K
from marlpit.plans import merge as M


def wiki(spark, rows):
    return spark.createDataFrame(rows, "lang string, title string, id long, popularity double, changed_on string, prev_id long")


def test_wiki_delta(spark):
    r = wiki(spark, [("en", "a", 1, 6.4, "2026-09-24", None), ("en", "b", 2, 6.4, "2026-09-25", None), ("en", "c", 3, 6.4, "2026-09-25", 99), ("en", "d", 4, 6.4, "", None)])
    gone = spark.createDataFrame([(7,)], "id long")
    rows, keys = K.wiki_delta(r, gone, "2026-09-24")
    assert sorted(x.id for x in rows.collect()) == [2, 3] and sorted(x.stable_key for x in keys.collect()) == [4, 6, 14, 198]
    assert K.wiki_delta(r, gone, "2026-09-25")[0].count() == 0
    assert sorted(x.id for x in K.wiki_delta(r, gone, "")[0].collect()) == [1, 2, 3]
    s = K.shipping(r.withColumn("vote_count", F.lit(6))).first()
    assert (s.popularity, s.vote_count) == (2.0, 2)


def test_fold_day(spark):
    store = wiki(spark, [("en", "A b", 5, 8.0, "2026-09-20", None), ("en", "Gone", 6, 3.0, "2026-09-20", None), ("en", "Moved", 7, 4.0, "2026-09-20", None)])
    sample = spark.createDataFrame([("en", "A_b", 8), ("en", "Moved", 4), ("en", "New", 2)], "lang string, title string, views long")
    keys = spark.createDataFrame([("en", "A b", 5), ("en", "Moved", 70)], "lang string, title string, qid long")
    out, dropped = K.fold_day(store, sample, keys, "2026-09-24", "2026-09-23")
    got = {r.title: r for r in out.collect()}
    assert got["A b"].changed_on == "2026-09-20" and abs(got["A b"].popularity - 8) < 1e-9
    assert (got["Moved"].id, got["Moved"].prev_id, got["Moved"].changed_on) == (70, 7, "2026-09-24")
    assert got["New"].changed_on == "2026-09-24" and got["New"].id < 2**31 and got["New"].original_title == "en.wikipedia.org"
    assert [r.title for r in dropped.collect()] == ["Gone"]


def test_namespaces_and_tops(spark):
    v = spark.createDataFrame([("es", "Anexo:Lista", 5, "h"), ("es", "Usuario:X", 9, "h"), ("es", "Star Trek: TNG", 3, "h"), ("es", ":x", 1, "h")], "lang string, title string, views long, hour_file string")
    ns = spark.createDataFrame([("es", "Usuario:"), ("es", "Anexo:")], "lang string, prefix string")
    kept = K.articles(v, ns)
    assert sorted(r.title for r in kept.collect()) == [":x", "Anexo:Lista", "Star Trek: TNG"]
    assert tuple(K.hourly_counters(v, kept).first()) == ("h", 4, 1)
    assert [r.title for r in K.top_per_language(K.sum_views(kept), 2).orderBy("rank").collect()] == ["Anexo:Lista", "Star Trek: TNG"]


def test_fit_budget(spark):
    df = spark.range(1000)
    assert abs(K.fit_budget(df, lambda n: n * 10, 5000, start=100) - 500) <= 15
    assert K.fit_budget(df, lambda n: n * 10, 10**9) == 1000


def test_entity_groups(spark):
    bands = spark.createDataFrame([("en", "X", 2), ("de", "X", 4), ("en", "Y", 6), ("es", "Z", 8), ("de", "W", 10)], "lang string, title string, stable_key long")
    bind = spark.createDataFrame([(1, "en", "X", 0), (1, "de", "X", 1), (2, "en", "Y", 2), (3, "es", "Z", 3), (3, "de", "W", 4)], "item long, lang string, title string, position long")
    g = K.entity_groups(bind, bands)
    assert {(r.group_id, r.item) for r in g.collect()} == {(1, 1), (2, 3)}
    assert tuple(K.entity_stats(g).first()) == (2, 1, 1, 4)


def test_merge(spark):
    rows = spark.createDataFrame([(0, 0, "en", 1000000, "New York City", 9, 5.0), (0, 1, "es", 800000, "Nueva York", 4, 3.0), (0, 2, "es", 200, "Otro", 1, 1.0), (0, 3, "en", 77, "otro", 3, 1.0), (0, 4, "en", 78, "new york city", 1, 9.0)], "qid int, pos int, lang string, stable_key long, title string, vote_count long, score double")
    emap = spark.createDataFrame([("en", 1000000, 7), ("es", 800000, 7)], "lang string, stable_key long, group_id long")
    sib = spark.createDataFrame([("de", 7, "New York")], "lang string, group_id long, title string")
    got = M.merge_languages(rows, emap, sib, ["en", "de", "es"], {"en": "English", "es": "Español", "de": "Deutsch"}).orderBy("rank").collect()
    assert [r.group_key for r in got] == ["entity:7", "title:otro"]
    assert got[0].titles == {"en": "new york city", "es": "Nueva York", "de": "New York"} and got[0].score == 9.0
    assert got[0].subtitle == "English · Deutsch · Español" and got[0].actions == ["open:en", "open:de", "open:es"]
    assert got[1].titles == {"es": "Otro", "en": "otro"} and got[1].lang == "en"


def test_chain_and_manifest(spark):
    c = spark.createDataFrame([("a", 0), ("b", 1)], "name string, position int")
    add = spark.createDataFrame([("a", 9)], "name string, position int")
    assert sorted(map(tuple, V.next_chain(c, add, False).collect())) == [("a", 2), ("b", 1)]
    assert V.next_chain(c, add, True).count() == 0
    files = spark.createDataFrame([("/x/base.idx", "base", 0, b"abc"), ("/x/d1", "delta", 1, b"d"), ("/x/d0", "delta", 0, b"")], "name string, role string, position int, content binary")
    m = V.build_manifest(files, 5, "now")
    r = m.first()
    assert (r.version, r.base.name, r.base.bytes, [d.name for d in r.deltas], r.bundle) == (5, "base.idx", 3, ["d0", "d1"], None)
    assert [(x.role, x.name) for x in V.assets(m).orderBy("role", "position").collect()] == [("base", "base.idx"), ("delta", "d0"), ("delta", "d1")]
    listing = spark.createDataFrame([("base.idx.gz",), ("old",)], "name string")
    stray, missing = V.unreferenced(listing, V.assets(m).select("name"))
    assert [x.name for x in stray.collect()] == ["old"] and sorted(x.name for x in missing.collect()) == ["d0", "d1"]


def test_sync(spark):
    f = lambda *k: spark.createDataFrame([(x,) for x in k], "stable_key long")
    plan = lambda rebuild: sorted(map(tuple, V.sync_plan(f(1, 2, 3), f(2, 3, 4, 5), f(3), f(2), rebuild).collect()))
    assert plan(False) == [(1, "put"), (2, "delete"), (3, "put"), (4, "delete"), (5, "delete")]
    assert [k for k, a in plan(True) if a == "put"] == [1, 2, 3]
    t = spark.createDataFrame([(3, 1.0, "b", 1), (3, 1.0, "a", 2), (9, 0.0, "z", 3)], "vote_count long, popularity double, title string, stable_key long")
    assert [r.stable_key for r in V.top_by_votes(t, 2).collect()] == [3, 2]
