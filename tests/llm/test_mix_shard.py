import numpy as np
import pytest
from pyspark.sql import functions as F

from marlpit.llm import mixing, sharding

SCHEMA = "doc_id long, text string, source string"


def water_fill(sizes, weights, share=1.5, cap=2.0):
    """Share by weight, stop at the cap, share the excess again, until none is above."""
    names = sorted((k for k in sizes if k is not None)) + ([None] if None in sizes else [])
    w = {k: weights[i % len(weights)] for i, k in enumerate(names)}
    out, free, left = dict.fromkeys(names, 0.0), set(names), share * sum(sizes.values())
    while free and left > 1e-9:
        total = sum(w[k] for k in free)
        over = {k for k in free if out[k] + left * w[k] / total >= cap * sizes[k] - 1e-12}
        if not over:
            for k in free:
                out[k] += left * w[k] / total
            break
        spent = {k: left * w[k] / total for k in free}
        left = 0.0
        for k in list(free):
            room = cap * sizes[k] - out[k]
            out[k] += min(room, spent[k])
            left += max(0.0, spent[k] - room)
            if k in over:
                free.discard(k)
    return out


def make_rows():
    rng = np.random.default_rng(5)
    rows = []
    for i in range(600):
        src = [None, "a", "b", "ü", "c0", "z"][min(int(rng.geometric(0.5)) - 1, 5)]
        n = int(rng.integers(0, 40)) if i % 50 else 3000
        rows.append((i, " \t".join(f"w{rng.integers(99)}" for _ in range(n)) if i % 17 else None, src))
    return [*rows, (7, "same text twice", "a"), (7, "same text twice", "a"), (None, "no id", "b")]


ROWS = make_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_mix(spark, docs):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS)
    sizes = {}
    for _, t, s in ROWS:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = water_fill(sizes, (5, 2, 1))
    for s, n in sizes.items():
        part = [r for r in got if r.source == s]
        assert sum(r["size"] for r in part) == n and {r.source_size for r in part} == {n}
        assert abs(part[0].target - want[s]) < 1e-6 * max(1, want[s])
        assert abs(sum(r.taken for r in part) - want[s]) <= 1
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    key = lambda rows: sorted(str((r.doc_id, r["size"], r.taken, r.copies, r.crc)) for r in rows)
    assert key(got) == key(mixing.mix(docs.repartition(7)).collect())


def test_shard_contents(spark, docs):
    """Shards hold just what is taken, every word of a document at most as often as the mix repeats it, in mixed order."""
    taken = {}
    for r in mixing.mix(docs).collect():
        taken[r.doc_id, r.crc] = taken.get((r.doc_id, r.crc), 0) + r.taken
    held, words, sizes = {}, {}, {(r.doc_id, r.crc): r["size"] for r in mixing.mix(docs).collect()}
    rows = mixing.shard_contents(docs).collect()
    for r in rows:
        k = (r.doc_id, r.crc)
        held[k] = held.get(k, 0) + r.words
        words[r.shard] = words.get(r.shard, 0) + r.words
        assert 0 <= r.start and r.start + r.words <= sizes[k]
    assert held == {k: v for k, v in taken.items() if v}
    assert max(words.values()) < 1.1 * min(words.values()) and len(words) == 8
    for s in range(8):
        places = [r.place for r in rows if r.shard == s]
        assert places == sorted(places)


def test_tree_splits_exactly(spark):
    q = [5, 0, 17, 3, 1000]
    df = spark.createDataFrame([(q,)], "q array<long>")
    got = mixing.splitting_tree(df, 6, 1).toPandas()
    by_source = got.groupby("idx").n.sum()
    assert [int(by_source[i]) for i in range(5)] == q
    per = got.groupby("shard").n.sum()
    assert per.max() - per.min() <= 3 and (got.n >= 0).all()


def test_tree_is_hypergeometric(spark):
    """Over many seeds the left half's draw of one source has the mean and variance of the hypergeometric law."""
    df = spark.createDataFrame([([30, 70],)], "q array<long>")
    x = np.array([mixing.splitting_tree(df, 2, s).where("shard = 0 and idx = 0").first().n for s in range(60)])
    assert abs(x.mean() - 15) < 4 * np.sqrt(5.3 / 60) and 2 < x.var() < 11


def test_mixed_documents(spark, docs):
    wide = docs.withColumn("n_chars", F.length("text")).withColumn("size", F.lit("clash")).withColumn("shard", F.lit(1))
    out = mixing.mixed_documents(wide)
    assert out.columns == wide.columns
    n = out.groupBy("doc_id").count().toPandas()
    assert n["count"].max() <= 6
    assert out.where("text is not null and doc_id is not null").join(docs, ["doc_id", "text"], "left_anti").count() == 0


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "", "a"), (2, " \n", "a")]])
def test_mix_edges(spark, rows):
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows) and all(r.taken == 0 and r.target == 0 for r in got)


def test_pack_balances():
    rng = np.random.default_rng(0)
    size = rng.gamma(1.0, 1.0, (3000, 3))
    s = sharding.pack(size, 40)
    sums = np.stack([np.bincount(s, weights=size[:, d], minlength=40) for d in range(3)])
    assert (np.abs(sums / sums.mean(1, keepdims=True) - 1) < 0.05).all()
    assert (sharding.pack(np.zeros((0, 3)), 4) == np.zeros(0)).all()
    assert len(sharding.pack(np.zeros((5, 3)), 4)) == 5


def check_shards(spark, df, shards=40):
    got = sharding.shard(df, shards).toPandas()
    assert len(got) == df.count()
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert got.shard.between(0, shards - 1).all() if len(got) else True
    return got


def test_shard(spark, docs):
    import zlib

    got = check_shards(spark, docs)
    text = docs.toPandas()
    want = sorted((len(t.encode()) + 16 if t is not None else 16) for t in text.text)
    assert sorted(got["size"]) == want
    crc = {zlib.crc32(t.encode()) for t in text.text if t is not None}
    assert set(got.text_crc32.dropna().astype(int)) == crc
    same = got[got.doc_id == 7]
    assert same[same["size"] == 16 + len("same text twice")].shard.nunique() == 1


def test_shard_hot_group(spark):
    df = spark.createDataFrame([(i, "copy " * 20 if i % 3 == 0 else f"text {i} " * (i % 50), "s") for i in range(6000)], SCHEMA)
    got = check_shards(spark, df)
    b, n = got.groupby("shard")["size"].sum(), got.groupby("shard").size()
    assert b.max() / b.mean() < 1.03 and n.max() / n.mean() < 1.3


@pytest.mark.parametrize("rows", [[], [(None, None, None)], [(1, "", "a")] * 3])
def test_shard_edges(spark, rows):
    check_shards(spark, spark.createDataFrame(rows, SCHEMA))


def test_sharded_documents(spark, docs):
    wide = docs.withColumn("slot", F.lit("old")).withColumn("n_chars", F.lit(1))
    out = sharding.sharded_documents(wide, 8)
    assert out.columns == ["doc_id", "text", "source", "n_chars", "shard", "slot"]
    assert out.count() == docs.count() == out.select("shard", "slot").distinct().count()


def test_equal_rows_are_parted(spark):
    """Thousands of rows that agree in id and text are a group that is cut like any other large one."""
    df = spark.createDataFrame([(None, "the same text of some words", "s")] * 4000 + [(i, f"text {i} of some words too", "s") for i in range(4000)], SCHEMA).repartition(6)
    runs = [check_shards(spark, df) for _ in range(2)]
    b, n = runs[0].groupby("shard")["size"].sum(), runs[0].groupby("shard").size()
    assert len(b) == 40 and b.max() / b.mean() < 1.05 and n.max() / n.mean() < 1.1
    key = lambda t: sorted(map(str, t[["doc_id", "size", "text_crc32", "shard", "slot"]].values.tolist()))
    assert key(runs[0]) == key(runs[1])


def test_cells_stay_even(spark):
    """Groups that are packed in many cells are about as even as those of one."""
    df = spark.createDataFrame([(i, f"w{i} " + "w " * (i * 37 % 400), "s") for i in range(9000)], SCHEMA).withColumn("g", F.lit("clash")).withColumn("k", F.lit(0))
    got = sharding.shard(df, 8, groups_per_cell=500).toPandas()
    for sums in (got.groupby("shard")["size"].sum(), got.groupby("shard")["tokens"].sum(), got.groupby("shard").size()):
        assert sums.max() / sums.mean() < 1.02


def test_shard_contents_of_nothing(spark):
    assert mixing.shard_contents(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mixing.shard_contents(spark.createDataFrame([(1, None, "a"), (2, " ", None)], SCHEMA)).count() == 0
    assert mixing.mixed_documents(spark.createDataFrame([], SCHEMA)).count() == 0
