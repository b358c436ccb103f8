"""Every pipeline stage on hard tables: nulls, repeats, ties, long and empty texts, clashing columns, nothing at all."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from marlpit.llm import common

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["_id", "_crc", "_n", "size", "h", "rep", "key", "score", "component_id", "taken", "copies", "th", "edits", "start", "label"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(1, 1, 1), (2, 1, 0), (None, None, None), (5, 0, None), (77, 0, 7)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog again and again until night"), (2, None), (None, "x"), (4, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def rows():
    long = "word " * 60_000
    return [
        (None, None, None, None, None), (None, None, None, None, None), (1, "", None, None, 0), (2, " \n\t ", "en", "a", None), (3, long, "en", "a", 1), (3, long, "en", "a", 1), (4, long + "x", None, "b", 2),
        (5, "same", "en", "b", 4), (5, "same", "en", "b", 4), (5, "other text", "en", "b", 4), (6, "\x00\x1c\x85  é \U0001f600", "fr", "ü", 3), (7, "A B C D", "en", None, 7), (-8, "a b c d", "en", None, 7), (9, "!!! 123 ???", None, "", 0),
    ]


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
@pytest.mark.parametrize("kind", ["hard", "empty", "one"])
def test_stage(spark, folder, name, kind):
    data = {"hard": rows(), "empty": [], "one": rows()[:1]}[kind]
    docs = spark.createDataFrame(data, DOCS).select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)])
    docs = common.materialise(docs, "edge")
    out = dict(P.STAGES)[name](spark, docs, folder)
    want = docs.columns + (["shard", "slot"] if name == "sharding" else [])
    assert out.columns == want
    got = common.materialise(out, "edge-out")
    n = got.count()
    if name == "sharding":
        assert n == len(data) and got.select("shard", "slot").distinct().count() == n
    if name == "mixing":
        assert n <= 3 * len(data)
    if name in ("toxicity", "decontamination"):
        assert n == len(data)
    if name == "simhash" and kind == "hard":
        ids = [r.doc_id for r in got.collect()]
        assert ids.count(5) == 2 and ids.count(3) <= 1  # two different texts share the id 5 and ids.count(7) == 0 and -8 in ids
    same = got.select(docs.columns).exceptAll(docs.crossJoin(spark.range(4)).drop(spark.range(4).id).select(docs.columns))
    assert same.count() == 0
