import unicodedata

import pytest
from pyspark.sql import functions as F

from marlpit.functions import text as X

FOLDS = [
    ("café", "cafe"), ("Zoë", "zoe"), ("déjà-vu", "deja vu"), ("Léon: The Professional", "leon the professional"), ("a  —  b", "a b"), ("  (2001)  ", "2001"),
    ("8 Mile (2002)", "8 mile 2002"), ("千と千尋の神隠し", "千と千尋の神隠し"), ("Ночной дозор", "ночнои дозор"), ("Ο Νονός", "ο νονος"), ("لعبة الحبار", "لعبة الحبار"), ("Amélie 🎬  (2001)", "amelie 2001"),
    ("!!! ???", ""), (None, ""), ("éa", "ea"), ("İI", "ii"),
]


@pytest.mark.parametrize("fold", [X.fold_text, X.fold_text_exact])
def test_fold(spark, fold):
    got = spark.createDataFrame(FOLDS, "a string, b string").select(fold(F.col("a")).alias("f"), "b").collect()
    assert [r.f for r in got] == [r.b for r in got]


def test_hangul(spark):
    """Syllables are taken apart as canonical decomposition does, so that a beginning of one is a beginning of the word."""
    words = ["한글", "기생충 (2019)", "값 Film É", "가", "힣", "x"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", X.fold_text(F.col("w")).alias("f"), X.fold_text_exact(F.col("w")).alias("e")).collect()
    assert all(r.f == r.e for r in rows) and {r.w: r.f for r in rows}["한글"].startswith(unicodedata.normalize("NFD", "하"))


def test_tokens(spark):
    r = spark.range(1).select(X.tokenize(X.fold_text(F.lit("Where's Wanda"))).alias("t"), X.tokenize(F.lit("")).alias("e")).first()
    assert (r.t, r.e) == (["where", "s", "wanda"], [])


def fnv(s):
    h = 2166136261
    data = s.encode("utf-16-le")
    for i in range(0, len(data), 2):
        h = ((h ^ int.from_bytes(data[i : i + 2], "little")) * 16777619) & 0xFFFFFFFF
    return h & 0x7FFFFFFF


def test_fnv31(spark):
    words = ["", "a", "New York City", "千と千尋", "🎬x", "Straße"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", X.fnv31(F.col("w")).alias("h")).collect()
    assert {r.w: r.h for r in got} == {w: fnv(w) for w in words}


def test_fnv31_spreads(spark):
    df = spark.range(20_000).select(X.fnv31(F.concat(F.lit("en:Title "), F.col("id").cast("string"))).alias("h"))
    assert df.distinct().count() == 20_000 and df.agg(F.max("h")).first()[0] < 2**31


@pytest.mark.parametrize("q,t,want", [("mlhld", "mulholland drive", True), ("", "x", True), ("aa", "a", False), ("ba", "ab", False), ("a.b", "axb", False), ("abc", "aabbcc", True)])
def test_subsequence(spark, q, t, want):
    assert spark.range(1).select(X.is_subsequence(F.lit(q), F.lit(t)).alias("x")).first().x is want


def test_capitalised(spark):
    r = spark.range(1).select(X.starts_capitalised(F.lit("Ab")).alias("a"), X.starts_capitalised(F.lit("ab")).alias("b"), X.starts_capitalised(F.lit("1b")).alias("c")).first()
    assert tuple(r) == (True, False, True)
