import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from marlpit.llm import common, embeddings, simhash

DOCS = "doc_id long, text string"


def plain_fingerprint(text):
    words = [w for w in __import__("re").split(r"[ \t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or ""))) if w]
    if not words:
        return 0
    sh = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(fp, ids, radius=4):
    lab = list(range(len(fp)))

    def root(i):
        while lab[i] != i:
            i = lab[i]
        return i

    for i in range(len(fp)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                lab[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(fp)):
        groups.setdefault(root(i), []).append(ids[i])
    return {i: min((x for x in groups[root(i)] if x is not None), default=None) for i in range(len(fp))}


def texts():
    rng = np.random.default_rng(3)
    rows = []
    for i in range(150):
        words = [f"w{rng.integers(500)}" for _ in range(int(rng.integers(1, 120)))]
        rows.append((i * 3, " ".join(words)))
        if i % 4 == 0:
            for k in range(3):
                w = list(words)
                w[int(rng.integers(len(w)))] = "CHANGED"
                rows.append((1000 + i * 5 + k, "\n".join(w)))
    rows += [(9000, None), (9001, ""), (9002, " \t\r\n"), (9003, "Ä É a\xa0b"), (9004, "ä é A\xa0B"), (9005, rows[0][1]), (9005, rows[0][1]), (None, rows[1][1]), (9006, "x " * 3000)]
    return rows


def test_fingerprint_and_components(spark):
    rows = texts()
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    fp = [plain_fingerprint(t) for _, t in rows]
    want = brute(fp, [i for i, _ in rows])
    expect = sorted((str(i), f"{f:016x}", str(want[k])) for k, ((i, _), f) in enumerate(zip(rows, fp, strict=True)))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == expect


def test_long_text_votes():
    t = " ".join(f"w{i % 977}" for i in range(140_000))
    words = t.split()
    h = np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(len(words) - 3)], dtype=np.uint64)
    bits = sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))
    assert simhash.fingerprint(t.encode()) == bits


def test_links_with_small_tiles(spark):
    """Clusters larger than a tile, and chains, lose no link."""
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 2**63, 40)]
    fps = set(base)
    for b in base[:3]:
        x = b
        for _ in range(120):
            x ^= 1 << int(rng.integers(64))
            fps.add(x)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    comp = {r.node: r.component for r in common.connected_components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), tile=16)).collect()}
    want = brute(fps, list(range(len(fps))))
    ours = {}
    for k, f in enumerate(signed):
        ours.setdefault(comp.get(f, f), []).append(k)
    assert sorted(sorted(v) for v in ours.values()) == sorted(sorted(k for k in want if want[k] == m) for m in set(want.values()))


@pytest.mark.parametrize("n", [10, 10**5, 10**8])
def test_thresholds_cover_radius(n):
    both = np.full((64, 64), n / 4)
    np.fill_diagonal(both, n / 2)
    parts = simhash.plan_parts(n, both, 4)
    assert sum(t + 1 for _, t in parts) == 5
    bits = [b for p, _ in parts for b in p]
    assert len(bits) == len(set(bits))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "a"), (1, "a")]])
def test_simhash_edges(spark, rows):
    assert simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).count() == len(rows)


def test_keep_one(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "other words than these are"), (3, "other words than these are"), (None, "zz yy xx")]
    df = spark.createDataFrame(rows, DOCS).withColumn("component_id", F.lit("clash"))
    out = simhash.keep_one(df)
    assert out.columns == df.columns and sorted(str(r.doc_id) for r in out.collect()) == ["1", "3", "None"]


def test_keep_one_loses_no_distinct_text(spark):
    """Texts that share an id are judged each: only copies and near copies go."""
    rows = [(5, "one two three four five"), (5, "six seven eight nine ten"), (5, "six seven eight nine ten"), (None, "six seven eight nine ten"), (None, "null id alone here"), (None, "null id alone here"), (7, "one two three four five"), (9, None), (8, " ")]
    df = spark.createDataFrame(rows, DOCS).withColumn("th", F.monotonically_increasing_id()).withColumn("first", F.lit("clash"))
    kept = [sorted((str(r.doc_id), r.text) for r in simhash.keep_one(df.repartition(n)).collect()) for n in (1, 5)]
    assert kept[0] == kept[1] == sorted([("5", rows[0][1]), ("5", rows[1][1]), ("None", rows[4][1]), ("8", " ")])


def test_hot_labels(spark):
    """Hundreds of fingerprints in one component, and hundreds of rows of one fingerprint."""
    base = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join([*base[:k], "x", *base[k + 1 :]])) for k in range(300)] + [(1000 + k, "same text for all of these") for k in range(600)]
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    want = brute([plain_fingerprint(t) for _, t in rows[:301]], [i for i, _ in rows[:301]])
    assert all(got[k].component_id == want[k] for k in range(300)) and {got[1000 + k].component_id for k in range(600)} == {1000}


def test_components(spark):
    e = [(i, i + 1) for i in range(0, 30)] + [(100, 200), (200, 300), (5, 5), (7, 7)] + [(500, 500 + k) for k in range(1, 60)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[100] == got[200] == got[300] == 100 and {got[500 + k] for k in range(60)} == {500}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


VEC = "vec_id long, embedding array<float>, label int"


def brute_vectors(rows, cosine=0.93):
    ok = [r for r in rows if r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    links, lab = {id(r): 0 for r in rows}, {id(r): r[0] for r in rows}
    adj = {id(r): [] for r in rows}
    for i, a in enumerate(ok):
        for b in ok[:i]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = (np.array(v, dtype=np.float32).astype(np.float64) for v in (a[1], b[1]))
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                    links[id(a)] += 1
                    links[id(b)] += 1
                    adj[id(a)].append(id(b))
                    adj[id(b)].append(id(a))
    done = set()
    for r in rows:
        if id(r) in done:
            continue
        stack, seen = [id(r)], {id(r)}
        while stack:
            for k in adj[stack.pop()]:
                if k not in seen:
                    seen.add(k)
                    stack.append(k)
        done |= seen
        low = min(lab[k] for k in seen)
        for k in seen:
            lab[k] = low
    return sorted((r[0], links[id(r)], lab[id(r)]) for r in rows)


def vectors():
    rng = np.random.default_rng(2)
    rows, k = [], 0
    for lab in (0, 1):
        for _ in range(60):
            c = rng.normal(size=16)
            for _ in range(int(rng.integers(1, 5))):
                rows.append([k, [float(np.float32(v)) for v in c + rng.normal(size=16) * 0.2], lab])
                k += 1
    hot = rows[0][1]
    rows += [[k + i, list(hot), 0] for i in range(40)]
    k += 40
    rows += [[k, None, 0], [k + 1, [], 0], [k + 2, [0.0] * 16, 0], [k + 3, [1.0, None] + [0.0] * 14, 0], [k + 4, [float("nan")] * 16, 0], [k + 5, [float("inf")] + [0.0] * 15, 0], [k + 6, list(hot), None], [k + 7, [2 * v for v in hot], 0], [k + 8, [1.0, 2.0], 0], [k + 9, [1.0, 2.0], 0], [k + 10, [1e30] * 16, 1], [k + 11, [1e-30] * 16, 1]]
    return rows


@pytest.mark.parametrize("setting", [{}, {"list_size": 8, "tile": 8, "probes": 64}])
def test_vectors(spark, setting):
    rows = vectors()
    got = embeddings.near_duplicates(spark.createDataFrame([tuple(r) for r in rows], VEC), **setting).collect()
    want = brute_vectors(rows)
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [1.0, 0.0], 1)]])
def test_vector_edges(spark, rows):
    got = embeddings.near_duplicates(spark.createDataFrame(rows, VEC)).collect()
    assert [(r.vec_id, r.n_links, r.component_id, r.kept) for r in got] == [(r[0], 0, r[0], True) for r in rows]


def test_vectors_that_share_an_id(spark):
    """Each vector has its own links, whoever shares its id."""
    rows = [(5, [1.0, 0.0], 1), (5, [0.0, 1.0], 1), (7, [1.0, 0.001], 1), (8, [-1.0, 0.0], 2), (8, [-1.0, 0.0], 2)]
    df = spark.createDataFrame(rows, VEC).withColumn("cid", F.lit(3)).withColumn("n", F.lit("clash"))
    got = embeddings.near_duplicates(df).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(5, 0, 5), (5, 1, 5), (7, 1, 5), (8, 1, 8), (8, 1, 8)]


def test_recall_with_more_lists_than_probes(spark):
    """Thousands of vectors in sixty lists, twelve of them probed: nearly all links of brute force, and none else."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 24))
    x = np.vstack([x, *(x + rng.normal(size=x.shape) * s for s in (0.15, 0.25, 0.32))]).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in row], 1) for i, row in enumerate(x)], VEC)
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(df, list_size=60).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = (u @ u.T >= 0.93).sum(1) - 1
    assert all(got[i] <= want[i] for i in range(len(x))) and sum(got.values()) >= 0.98 * want.sum() > 1000
