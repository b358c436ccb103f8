import gzip
import json

import pytest
from helpers import records
from pyspark.sql import functions as F

from marlpit.sources import readers as S
from marlpit.sources import sinks as K
from marlpit.streaming import views as V


def test_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("  x \n\n\ty\n   \n千と\n")
    assert sorted(r.value for r in S.text_lines(spark, f"{tmp_path}/a.txt").collect()) == sorted(["x", "\ty", "千と"])
    assert S.text_lines(spark, f"{tmp_path}/none").count() == 0


def test_store(spark, tmp_path):
    from marlpit.operators.catalog import latest

    (tmp_path / "s.json").write_text('{"mediaType":"movie","id":7,"title":"Before"}\n{"mediaType":"tv","id":7,"title":"T","rtScore":0}\n{"mediaType":"movie","id":7,"title":"After"}\n')
    got = {(r.media_type, r.id): (r.title, r.rt_score) for r in latest(S.store_log(spark, f"{tmp_path}/s.json")).collect()}
    assert got == {("movie", 7): ("After", None), ("tv", 7): ("T", 0)}
    assert S.store_log(spark, f"{tmp_path}/none").count() == 0


def test_append_continues_sequence(spark, tmp_path):
    from marlpit.operators.catalog import latest

    p = f"{tmp_path}/log"
    K.append_records(records(spark, {"id": 1, "title": "A"}, {"id": 2, "title": "B"}), p)
    K.append_records(records(spark, {"id": 1, "title": "C"}), p)
    assert {r.id: r.title for r in latest(spark.read.parquet(p)).collect()} == {1: "C", 2: "B"}
    assert K.rewrite(spark.range(3), f"{tmp_path}/v") != K.rewrite(spark.range(2), f"{tmp_path}/v")


def test_export(spark, tmp_path):
    with gzip.open(tmp_path / "m.json.gz", "wt") as f:
        f.write('{"adult":true,"id":1,"original_title":"A","popularity":2.5}\n{"id":2,"original_title":"B"}\n')
    with gzip.open(tmp_path / "t.json.gz", "wt") as f:
        f.write('{"id":1,"original_name":"N","popularity":1}\n')
    (tmp_path / "e.json").write_text("")
    got = sorted((r.media_type, r.id, r.original_title, r.adult) for r in S.id_export(spark, f"{tmp_path}/m.json.gz", f"{tmp_path}/t.json.gz").collect())
    assert got == [("movie", 1, "A", True), ("movie", 2, "B", False), ("tv", 1, "N", False)]
    assert S.id_export(spark, f"{tmp_path}/none", None).count() == 0
    with pytest.raises(ValueError):
        S.id_export(spark, f"{tmp_path}/e.json", None)


def test_ratings(spark, tmp_path):
    with gzip.open(tmp_path / "r.tsv.gz", "wt") as f:
        f.write("tconst\taverageRating\tnumVotes\ntt1\t8.7\t10\ntt2\tx\t3\nnm3\t5.0\t1\n")
    assert [tuple(r) for r in S.ratings_tsv(spark, f"{tmp_path}/r.tsv.gz").collect()] == [("tt1", 87, 10)]


def test_pageviews(spark, tmp_path):
    for h in (0, 1):
        with gzip.open(tmp_path / f"h{h}.gz", "wt") as f:
            f.write("en Main 5 0\nen.m Main 2 0\nfr X 9 0\nen Low 0 0\nbroken\nde A:B x 0\n")
    (tmp_path / "h2.gz").write_bytes(gzip.compress(b"en Main 5 0\n" * 9999)[:60])
    v = S.pageviews(spark, f"{tmp_path}/*.gz", ["en", "de"])
    from marlpit.operators.wiki import sum_views

    got = {(r.lang, r.title): r.views for r in sum_views(v.where(~F.col("hour_file").endswith("h2.gz"))).collect()}
    assert got == {("en", "Main"): 14}


def test_keys_views_documents(spark, tmp_path):
    (tmp_path / "k.json").write_text('{"title":"A","qid":1}\n{"title":"A","qid":2}\n{"title":"B","qid":null}\n{"title":"C","qid":3000000000}\n')
    assert [tuple(r) for r in S.entity_keys(spark, f"{tmp_path}/k.json").collect()] == [("A", 2)]
    K.write_views(spark.createDataFrame([("en", "A", 3), ("en", "B", 1)], "lang string, title string, views long"), {"date": "d"}, f"{tmp_path}/v")
    assert S.view_sample(spark, f"{tmp_path}/v/views", 2).count() == 1
    (tmp_path / "c.json").write_text(json.dumps({"a": 1}))
    (tmp_path / "bad.json").write_text("{")
    assert S.document(spark, f"{tmp_path}/c.json") == {"a": 1}
    assert S.document(spark, f"{tmp_path}/bad.json", {}) == {} and S.document(spark, f"{tmp_path}/none", None) is None


def test_index_version(spark, tmp_path):
    rows = spark.createDataFrame([(0, 2, "a")], "row long, stable_key long, title string")
    K.write_index(rows, spark.createDataFrame([("a", 0)], "term string, row long"), spark.createDataFrame([], "seq int, stable_key long"), f"{tmp_path}/i")
    assert K.open_index(spark, f"{tmp_path}/i")[0].count() == 1
    spark.createDataFrame([(4,)], "format_version int").coalesce(1).write.mode("overwrite").json(f"{tmp_path}/i/format")
    with pytest.raises(ValueError):
        K.open_index(spark, f"{tmp_path}/i")


def test_push(spark, tmp_path):
    out = str(tmp_path)

    def push(batch, rows):
        with open(f"{out}/{batch}", "w") as f:
            f.write(",".join(str(r.id) for r in rows))

    assert K.push_batches(spark.range(7), [-F.col("id")], push, size=3, done=0) == 3
    assert sorted(p.name for p in tmp_path.iterdir()) == ["1", "2"] and sorted((tmp_path / "1").read_text().split(",")) == ["1", "2", "3"]


def test_daily_stream(spark, tmp_path):
    src = f"{tmp_path}/in"
    rows = [("2024-01-01 01:00:00", "en", "A", 2), ("2024-01-01 23:00:00", "en", "A", 3), ("2024-01-02 01:00:00", "en", "A", 4), ("2024-02-02 01:00:00", "en", "Z", 1)]
    df = spark.createDataFrame(rows, "t string, lang string, title string, views long").select(F.to_timestamp("t").alias("ts"), "lang", "title", "views")
    df.write.parquet(src)
    stream = V.daily_views(spark.readStream.schema(df.schema).parquet(src))
    q = stream.writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {(str(r.day), r.title): r.views for r in spark.table("days").collect()}
    assert got[("2024-01-01", "A")] == 5 and got[("2024-01-02", "A")] == 4


def test_decay_stream(spark, tmp_path):
    src = f"{tmp_path}/in"
    spark.createDataFrame([("en", "A", "2024-01-01", 10), ("en", "A", "2024-01-03", 20)], "lang string, title string, d string, views long").select("lang", "title", F.to_date("d").alias("day"), "views").write.parquet(src)
    schema = spark.read.parquet(src).schema
    q = V.decayed(spark.readStream.schema(schema).parquet(src)).writeStream.format("memory").queryName("decay").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(90)
    got = {str(r.day): r.popularity for r in spark.table("decay").collect()}
    w = 1 - 0.5 ** (2 / 14)
    assert got["2024-01-01"] == 10 and abs(got["2024-01-03"] - (w * 20 + (1 - w) * 10)) < 1e-9
