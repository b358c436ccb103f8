import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlpit.llm import decontam, langid, linededup, lm, passages, toxicity

DOCS = "doc_id long, text string"
rnd = random.Random(4)
SYL = "an er on re th nd ha es at en in ou to or st is it ea hi as te et ng of al de se le sa si ar".split()


def word(r=rnd):
    return "".join(r.choice(SYL) for _ in range(r.randint(1, 4)))


def prose(n, r=rnd):
    return " ".join(word(r) for _ in range(n))


# --- decontamination ---


def plain_edits(a, b):
    """Least edits from b to any piece of a."""
    prev = [0] * (len(a) + 1)
    for j in range(1, len(b) + 1):
        cur = [j] + [0] * len(a)
        for i in range(1, len(a) + 1):
            cur[i] = min(prev[i - 1] + (a[i - 1] != b[j - 1]), prev[i] + 1, cur[i - 1] + 1)
        prev = cur
    return min(prev)


def test_banded_alignment():
    r = random.Random(1)
    for _ in range(150):
        b = [r.randint(0, 3) for _ in range(r.randint(5, 30))]
        c = list(b)
        for _ in range(r.randint(0, 3)):
            k = r.randrange(len(c))
            if r.random() < 0.4:
                c[k] = 9
            elif r.random() < 0.5:
                del c[k]
            else:
                c.insert(k, 8)
        pre = [r.randint(4, 7) for _ in range(r.randint(0, 9))]
        a = pre + c + [r.randint(4, 7) for _ in range(r.randint(0, 9))]
        edits, s, e = decontam.banded(np.array(a), np.array(b), len(pre), 8)
        assert edits == plain_edits(a, b) and 0 <= s <= e <= len(a)


def test_normal_form():
    n = lambda t: decontam.normal(t).tobytes().decode("utf-32-le")
    assert [n(x) for x in ("  Ab--c!! Ü1 ", "", None, "...", "a")] == ["ab c ü1", "", "", "", "a"]


def test_decontamination(spark):
    r = random.Random(9)
    items = [(k, prose(40, r)) for k in range(12)]

    def noisy(t, rate):
        return "".join(ch if r.random() > rate else r.choice("abcdefgh") for ch in t)

    docs = [(k, prose(200, r) + " " + items[k][1].upper().replace(" ", "\n") + ". " + prose(50, r)) for k in range(8)]
    docs += [(20, prose(30, r) + " " + noisy(items[8][1], 0.03) + " " + prose(900, r)), (21, prose(40, r) + " " + " ".join(items[9][1].split()[10:34]) + " " + prose(40, r))]
    docs += [(k, prose(300, r)) for k in range(100, 130)] + [(30, None), (31, ""), (32, "x"), (33, prose(20_000, r) + items[10][1])]
    bench = spark.createDataFrame([*items, (90, None), (91, ""), (92, "to be"), (None, prose(30, r))], "item_id long, text string")
    df = spark.createDataFrame(docs, DOCS)
    want = {(k, k) for k in range(8)} | {(20, 8), (21, 9), (33, 10)}
    for block in (8_000_000, 500):
        got = decontam.contaminated(df, bench, block_chars=block).collect()
        assert {(x.doc_id, x.item_id) for x in got} == want
    assert all(x.edits == 0 for x in got if x.doc_id < 8)
    wide = df.withColumn("edits", F.lit("clash"))
    kept = decontam.clean(wide, bench)
    assert kept.columns == wide.columns and {x.doc_id for x in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert decontam.contaminated(df, bench.limit(0)).count() == 0 and decontam.contaminated(df.limit(0), bench).count() == 0


def test_long_benchmark_item_in_part(spark):
    """A passage of a long item counts even if most of the item is missing."""
    r = random.Random(2)
    item = prose(600, r)
    part = " ".join(item.split()[200:260])
    got = decontam.contaminated(spark.createDataFrame([(1, prose(50, r) + " " + part + " " + prose(50, r)), (2, prose(500, r))], DOCS), spark.createDataFrame([(5, item)], "item_id long, text string"))
    assert {(x.doc_id, x.item_id) for x in got.collect()} == {(1, 5)}


# --- line dedup ---


def test_patience_is_common_and_increasing():
    r = random.Random(3)
    for _ in range(200):
        a, b = ([r.randint(0, 9) for _ in range(r.randint(0, 14))] for _ in range(2))
        m = linededup.patience(a, b)
        assert all(a[i] == b[j] for i, j in m) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(m, m[1:], strict=False))
    assert linededup.patience([1, 2, 3, 4, 5], [9, 2, 3, 8, 4, 5, 7]) == [(1, 1), (2, 2), (3, 4), (4, 5)]


def test_line_dedup(spark):
    r = random.Random(5)
    ls = [prose(12, r) for _ in range(60)]
    docs = [(1, "\n".join(ls[:10])), (2, "\n".join([ls[20], *ls[3:7], ls[21]])), (3, "\n".join([ls[30], " " + ls[20] + " ", ls[31]])), (4, "\n".join(ls[:10])), (5, "\n".join(ls[40:45])), (6, "ok\nyes"), (7, "ok\nyes two"), (8, None), (9, ""), (10, "\n\n"), (11, "\n\n"), (None, ls[0])]
    df = spark.createDataFrame(docs, DOCS)
    got = {x.doc_id: x for x in linededup.find_repeats(df).collect()}
    cut = {k: list(v.removed) for k, v in got.items() if v.n_removed}
    assert cut == {2: [1, 2, 3, 4], 3: [1], 4: list(range(10))}
    assert got[2].sources == [1] and got[3].sources == [2] and got[4].sources == [1] and got[8].n_lines == -1 or got[8].n_lines in (0, -1)
    out = {x.doc_id: x.text for x in linededup.strip_repeats(df.withColumn("cut", F.lit(1))).collect()}
    assert out[2] == ls[20] + "\n" + ls[21] and out[4] == "" and out[6] == "ok\nyes" and out[8] is None and out[10] == "\n\n"
    assert linededup.find_repeats(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, ls[50] + "\n" + ls[51]), (2, ls[50] + "\n" + ls[52]), (2, ls[53] + "\n" + ls[54]), (2, ls[53] + "\n" + ls[54])], DOCS)
    assert linededup.strip_repeats(twice).count() == 4 and {ls[53] + "\n" + ls[54]} <= {x.text for x in linededup.strip_repeats(twice).collect()}


def test_line_dedup_hot_groups(spark):
    """A line in every document, and hundreds of near copies, each but the first lose what they share."""
    r = random.Random(6)
    body, lic = [prose(10, r) for _ in range(6)], prose(15, r)
    docs = [(k, "\n".join([*body[:3], prose(10, r), *body[3:]])) for k in range(300)] + [(1000 + k, prose(20, r) + "\n" + lic) for k in range(300)]
    got = {x.doc_id: list(x.removed) for x in linededup.find_repeats(spark.createDataFrame(docs, DOCS), rare=5).collect()}
    assert got[0] == [] and all(got[k] == [0, 1, 2, 4, 5, 6] for k in range(1, 300))
    assert got[1000] == [] and all(got[1000 + k] == [1] for k in range(1, 300))


# --- substring dedup ---


def test_minimisers_cover_windows():
    rng = np.random.default_rng(0)
    for h in (rng.integers(0, 2**62, 400).astype(np.uint64), np.repeat(np.uint64(7), 300), rng.integers(0, 3, 500).astype(np.uint64)):
        _, p = passages.minimisers(h, 6, 12)
        assert p[0] < 12 and len(h) - 5 - p[-1] <= 12 and (np.diff(p) <= 12).all()
    assert len(passages.minimisers(np.zeros(5, dtype=np.uint64), 6, 12)[0]) == 0
    assert len(passages.minimisers(np.arange(6, dtype=np.uint64), 6, 12)[0]) == 1


def test_chains_against_quadratic():
    r = random.Random(8)
    for _ in range(60):
        pts = sorted({(r.randint(0, 60), r.randint(0, 60)) for _ in range(r.randint(1, 25))})
        x, y = (np.array(v) for v in zip(*pts, strict=True))
        best = []
        for i, (a, b) in enumerate(pts):
            f = 6.0
            for j, (c, d) in enumerate(pts):
                if c < a and d < b:
                    f = max(f, 6 + best[j] - 0.15 * (a - c + b - d))
            best.append(f)
        got = passages.chains(x, y, 6, 0.15, 10**6)
        assert sorted(k for c in got for k in c) == list(range(len(pts)))
        c = got[0]
        score = 6 + sum(6 - 0.15 * (x[q] - x[p] + y[q] - y[p]) for p, q in zip(c, c[1:], strict=False))
        assert abs(score - max(best)) < 1e-9 and all(x[p] < x[q] and y[p] < y[q] for p, q in zip(c, c[1:], strict=False))


def test_edit_words():
    r = random.Random(1)
    for _ in range(100):
        a, b = ([r.randint(0, 3) for _ in range(r.randint(0, 9))] for _ in range(2))
        row = list(range(len(a) + 1))
        for j in b:
            new = [row[0] + 1]
            for i, v in enumerate(a):
                new.append(min(row[i] + (v != j), row[i + 1] + 1, new[i] + 1))
            row = new
        assert passages.edit_words(np.array(a), np.array(b)) == row[-1]


def test_passages(spark):
    r = random.Random(12)
    p, q2 = prose(80, r), prose(70, r)
    fuzzy = p.split()
    for k in (10, 33, 34, 60):
        fuzzy[k] = "CHANGED"
    del fuzzy[45]
    docs = [(1, prose(40, r) + " " + p + " " + prose(30, r)), (2, prose(90, r) + "\n" + p.upper().replace(" ", "\n") + " " + prose(10, r)), (3, " ".join(fuzzy) + " " + prose(100, r) + " " + q2), (4, q2 + " " + prose(20, r)), (5, prose(30, r) + " " + " ".join(p.split()[:30])), (6, prose(200, r)), (8, None), (9, ""), (10, "a b"), (11, "a b"), (None, p)]
    docs += [(7, docs[5][1]), (7, docs[5][1])]
    df = spark.createDataFrame(docs, DOCS)
    got = passages.repeated_passages(df).collect()
    pairs = {(x.doc_id, x.of_doc_id): x for x in got if x.kind == "passage"}
    assert set(pairs) == {(2, 1), (3, 1), (3, 2), (4, 3)}
    assert (pairs[2, 1].start, pairs[2, 1].end, pairs[2, 1].of_start, pairs[2, 1].of_end, pairs[2, 1].edits) == (90, 170, 40, 120, 0)
    assert pairs[3, 1].edits == 5 and pairs[3, 1].end - pairs[3, 1].start >= 70
    assert {(x.doc_id, x.of_doc_id) for x in got if x.kind == "copy"} == {(7, 6), (11, 10)}
    assert passages.repeated_passages(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, p), (2, prose(70, r)), (2, prose(70, r) + " " + p), (3, p + " x")], DOCS)
    assert {(x.doc_id, x.of_doc_id) for x in passages.repeated_passages(twice).collect()} >= {(3, 1)}


def test_passages_hot(spark):
    """A passage in hundreds of documents gives a row each, not their pairs."""
    r = random.Random(13)
    p = prose(60, r)
    docs = [(k, prose(20 + k % 7, r) + " " + p + " " + prose(20, r)) for k in range(400)]
    got = passages.repeated_passages(spark.createDataFrame(docs, DOCS)).collect()
    assert {x.doc_id for x in got} == set(range(1, 400)) and len(got) < 450


def test_passage_whose_halves_came_first_elsewhere(spark):
    r = random.Random(14)
    w = prose(70, r).split()
    docs = [(1, prose(20, r) + " " + " ".join(w[:35])), (2, " ".join(w[35:]) + " " + prose(20, r)), (3, prose(9, r) + " " + " ".join(w)), (4, " ".join(w) + " " + prose(9, r))]
    got = passages.repeated_passages(spark.createDataFrame(docs, DOCS)).collect()
    assert {(x.doc_id, x.of_doc_id) for x in got} == {(4, 3)}


def test_block_whose_lines_came_first_elsewhere(spark):
    """Two short lines, each common and first seen in a document of its own, are cut where the block was seen before."""
    one, two = "alpha beta gamma delta", "kappa lambda omega sigma"
    docs = [(1, f"{one}\nx1"), (2, f"{two}\nx2"), (3, f"y3\n{one}\n{two}\nz3")]
    docs += [(k, f"{(one, two)[k % 2]}\nx{k}") for k in range(4, 130)] + [(200, f"u\n{one}\n{two}\nv")]
    got = {x.doc_id: x.removed for x in linededup.find_repeats(spark.createDataFrame(docs, DOCS)).collect()}
    assert got[200] == [1, 2] and not any(v for d, v in got.items() if d != 200)


def test_passages_far_apart(spark):
    """A second long passage behind an insertion that no link spans is found like the first."""
    r = random.Random(15)
    docs, want = [], set()
    for k, (one, gap, two) in enumerate([(200, 80, 100), (400, 100, 400), (800, 150, 800)]):
        a, b = prose(one, r).split(), prose(two, r).split()
        docs += [(10 * k, " ".join(a + b)), (10 * k + 1, " ".join(a + prose(gap, r).split() + b))]
        want |= {(10 * k + 1, 0, one), (10 * k + 1, one + gap, one + gap + two)}
    got = passages.repeated_passages(spark.createDataFrame(docs, DOCS)).collect()
    assert {(x.doc_id, x.start, x.end) for x in got} == want


def test_passages_with_edits(spark):
    """One word in eleven is changed, inserted or left out in turn, and two passages have a stretch of their own between."""
    r = random.Random(16)
    docs, want = [], set()
    for k in range(12):
        w = prose(110, r).split()
        v = [x for i, y in enumerate(w) for x in ([y] if i % 11 != 5 else [[prose(1, r)], [y, prose(1, r)], []][i // 11 % 3])]
        docs += [(2 * k, " ".join([prose(60, r), *w, prose(60, r)])), (2 * k + 1, " ".join([prose(50, r), *v, prose(70, r)]))]
        want.add((2 * k + 1, 2 * k))
    a, b = prose(55, r), prose(55, r)
    docs += [(100, f"{a} {b}"), (101, f"{a} {prose(45, r)} {b}")]
    got = passages.repeated_passages(spark.createDataFrame(docs, DOCS)).collect()
    assert {(x.doc_id, x.of_doc_id) for x in got if x.doc_id < 100} == want
    assert all(x.end - x.start >= 95 for x in got if x.doc_id < 100)
    assert {(x.start, x.end) for x in got if x.doc_id == 101} == {(0, 55), (100, 155)}


def test_extend_against_table():
    r = random.Random(17)
    for _ in range(200):
        a = [r.randrange(4) for _ in range(r.randrange(14))]
        b = [x for x in a if r.random() < 0.8] + [r.randrange(4) for _ in range(r.randrange(3))]
        for cost in (2, 4):
            best = {}
            for i in range(len(a) + 1):
                for j in range(len(b) + 1):
                    ways = [best[i - 1, j] - cost] if i else []
                    ways += [best[i, j - 1] - cost] if j else []
                    ways += [best[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -cost)] if i and j else []
                    best[i, j] = max(ways, default=0)
            x, y, edits = passages.extend(np.array(a), np.array(b), cost, 10**5)
            assert best[x, y] == max(best.values()) and passages.edit_words(np.array(a[:x]), np.array(b[:y])) <= edits


def local_passage(a, b, least=50, worst=0.2):
    """By brute force: whether some stretches of both, of ``least`` words at least, are within ``worst`` edits a word."""
    for i in range(len(a) - least + 1):
        row, best = [0] * (len(b) + 1), list(range(len(b) + 1))  # least edits of a[i:i+n] against b[s:j], and the s of it
        for n, v in enumerate(a[i:], 1):
            new, at = [n], [0]
            for j, w in enumerate(b, 1):
                c, s = min((row[j - 1] + (v != w), best[j - 1]), (row[j] + 1, best[j]), (new[-1] + 1, at[-1]))
                new.append(c)
                at.append(s)
            row, best = new, at
            if any(j - s >= least and n >= least and c <= worst * max(n, j - s) for j, (c, s) in enumerate(zip(row, best, strict=True))):
                return True
    return False


def test_passages_against_brute_force(spark):
    """Pairs with up to two passages of 60 to 90 words, up to one word in five edited: nearly all that brute force finds are
    found, by the operator's own settings, and every row holds what it says."""
    r = random.Random(21)

    def edited(w, rate):
        w = list(w)
        for _ in range(int(rate * len(w))):
            i = r.randrange(len(w))
            kind = r.randrange(3)
            if kind == 0:
                w[i] = word(r) + "q"
            elif kind == 1:
                w.insert(i, word(r) + "q")
            else:
                del w[i]
        return w

    docs, want = {}, set()
    for k in range(60):
        parts = [prose(r.randint(60, 90), r).split() for _ in range(1 + k % 2)]
        rate = (0.0, 0.05, 0.1, 0.15, 0.2)[k % 5]
        one, two = prose(20, r).split(), prose(30, r).split()
        for p in parts:
            one += p + prose(70, r).split()
            two += edited(p, rate) + prose(r.randint(0, 90), r).split()
        docs[2 * k], docs[2 * k + 1] = one, two
        if rate < 0.2 or (len(parts) == 1 and local_passage(two[20:130], one[10:120])):
            want.add((2 * k + 1, 2 * k))
    got = passages.repeated_passages(spark.createDataFrame([(k, " ".join(v)) for k, v in docs.items()], DOCS)).collect()
    found = {(x.doc_id, x.of_doc_id) for x in got}
    assert len(found & want) >= 0.95 * len(want) and len(want) >= 50
    code = {}
    for x in got:
        a, b = docs[x.doc_id][x.start : x.end], docs[x.of_doc_id][x.of_start : x.of_end]
        edits = passages.edit_words(*(np.array([code.setdefault(w, len(code)) for w in v]) for v in (a, b)))
        assert min(len(a), len(b)) >= 50 and edits <= x.edits <= 0.2 * max(len(a), len(b))


def test_passages_stutter(spark):
    """Texts that repeat one word, or themselves, are matched too."""
    docs = [(1, prose(30) + " of" * 120), (2, "of " * 90 + prose(30))]
    assert {(x.doc_id, x.of_doc_id) for x in passages.repeated_passages(spark.createDataFrame(docs, DOCS)).collect()} == {(2, 1)}


# --- language model ---


def test_lm(spark):
    r = random.Random(7)
    vocab = [word(r) for _ in range(60)]
    docs = [(k, " ".join(r.choice(vocab[:20]) + ("X" if r.random() < 0.2 else "") for _ in range(r.randint(0, 80)))) for k in range(400)]
    docs += [(1000, None), (1001, ""), (1002, "unseen words only here"), (1003, docs[0][1].upper()), (None, docs[1][1])]
    df = spark.createDataFrame(docs, DOCS)
    learn = F.col("doc_id") % 10 != 0
    runs = [{x.doc_id: x for x in lm.score(df, learn, most_tokens=m).collect()} for m in (1_000_000, 700)]
    a, b = runs
    assert all(abs(a[k].score - b[k].score) < 1e-6 * (1 + abs(a[k].score)) and a[k].n_known == b[k].n_known for k in a)
    count, toks = {}, {i: [*(t or "").lower().split(), None] for i, t in docs}
    for i, ws in toks.items():
        if i is not None and i % 10:
            for w in ws:
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    for i, ws in toks.items():
        base = sum(math.log10((count.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert abs(a[i].base_score - base) < 1e-8 * (1 + abs(base))
        assert (a[i].n_tokens, a[i].n_known, a[i].train_tokens) == (len(ws), sum(w in count for w in ws), n)
        assert math.isfinite(a[i].score) and a[i].score < 0
    assert lm.score(df.limit(0), learn).count() == 0
    alone = lm.score(spark.createDataFrame([(1, "a b")], DOCS), F.lit(False)).first()
    assert (alone.train_tokens, alone.n_known, alone.base_score, alone.score) == (0, 0, 0.0, 0.0)


def test_lm_is_a_distribution(spark):
    """Given a context, the probabilities of all words, the end and one unseen word add up to one."""
    docs = [(k, "a b a c b a"[: 2 * (k % 6) + 1]) for k in range(1, 60)]
    train = spark.createDataFrame(docs, DOCS)
    probe = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(["", "a", "b", "c", "zz", "a a", "a b", "a c", "a zz"])], DOCS)
    got = {x.doc_id: 10**x.score for x in lm.score(train.unionByName(probe), F.col("doc_id") < 1000).collect()}
    # P("") = P(end | start); P("a") = P(a | start) P(end | a) and so on: texts' probabilities are prefix products
    assert all(0 < got[1000 + i] < 1 for i in range(9)) and sum(got[1000 + i] for i in range(5)) < 1


def plain_counts(docs, taught):
    """Counts of words, bigrams and trigrams of training texts, each behind a start, with an end."""
    count = {}
    for (_, t), learned in zip(docs, taught, strict=True):
        w = [None, "<s>", *(t or "").lower().split(), "</s>"]
        for i in range(2, len(w)) if learned else []:
            for key in ((w[i],), (w[i - 1], w[i]), (w[i - 2], w[i - 1], w[i])):
                count[key] = count.get(key, 0) + 1
            if w[i - 1] == "<s>":
                count["<s>",] = count.get(("<s>",), 0) + 1
    return count


def plain_terms(t, count, less=0):
    """Of each token: counts of its trigram, the pair before it, its bigram, the word before it and itself, ``less`` that."""
    w = [None, "<s>", *(t or "").lower().split(), "</s>"]
    for i in range(2, len(w)):
        pair = count.get((w[i - 2], w[i - 1]), 0) if i > 2 else count.get(("<s>",), 0)
        keys = ((w[i - 2], w[i - 1], w[i]), None, (w[i - 1], w[i]), (w[i - 1],), (w[i],))
        yield [(pair if k is None else count.get(k, 0)) - less for k in keys]


@pytest.mark.parametrize("setting", [{}, {"most_tokens": 300, "bucket_tokens": 40, "fan": 3}])
def test_lm_against_brute_force(spark, setting):
    """Scores, with repeated rows and null ids over many partitions; with small ranges the questions go through a tree."""
    r = random.Random(30)
    vocab = [word(r) for _ in range(40)]
    docs = [(k, " ".join(r.choice(vocab[: 5 + k % 30]) for _ in range(r.randint(0, 40)))) for k in range(300)]
    docs += [(None, "a b c")] * 6 + [(7, docs[7][1])] * 3 + [(8, "other words"), (500, None), (501, "never seen words at all")] + docs[:40]
    df = spark.createDataFrame(docs, DOCS).repartition(5).withColumn("chunk", F.lit("clash")).withColumn("train", F.lit(1))
    got = lm.score(df, F.col("doc_id") % 10 != 0, **setting).collect()
    taught = [i is not None and i % 10 != 0 for i, _ in docs]
    count = plain_counts(docs, taught)
    n, v = sum(c for k, c in count.items() if len(k) == 1 and k != ("<s>",)), sum(len(k) == 1 for k in count) - 1
    hist = np.zeros((lm.BUCKETS, lm.RANGE, lm.RANGE, lm.RANGE), dtype=np.int64)
    for (_, t), learned in zip(docs, taught, strict=True):
        for c3, cuv, c2, cv, cw in plain_terms(t, count, 1) if learned else []:
            one = lambda x, steps=lm.STEPS: int(lm.bins(np.array([x]), steps)[0])
            hist[int(lm.context_bucket(np.array([cuv]), np.array([cv]))[0]), one(c3 / max(cuv, 1)), one(c2 / max(cv, 1)), one(cw / (n - 1), 1)] += 1
    weights = lm.learn_weights(hist, 1 / (v + 1))
    want = []
    for i, t in docs:
        total = 0.0
        for c3, cuv, c2, cv, cw in plain_terms(t, count):
            w = weights[int(lm.context_bucket(np.array([cuv]), np.array([cv]))[0])] * np.array([cuv > 0, cv > 0, 1, 1])
            total += math.log10(w @ np.array([c3 / max(cuv, 1), c2 / max(cv, 1), cw / n, 1 / (v + 1)]) / w.sum())
        want.append((str(i), len((t or "").split()) + 1, round(total, 6)))
    assert sorted((str(x.doc_id), x.n_tokens, round(x.score, 6)) for x in got) == sorted(want)
    assert {x.train_tokens for x in got} == {n}


def test_lm_sums_to_one(spark):
    """After any two words, the probabilities of all known words, the end and one unseen word add up to one."""
    train = [(k, "a b a c b a b c c a"[: 2 * (k % 9) + 1]) for k in range(1, 80)]
    ends = ["a", "b", "c", "zz"]
    probe = {(u, w, x): f"{u} {w} {x}".strip() for u in ["", *ends] for w in (ends if u else ["", *ends]) for x in ["", *ends]}
    rows = train + [(1000 + k, t) for k, t in enumerate(dict.fromkeys(probe.values()))]
    got = {x.doc_id: 10**x.score for x in lm.score(spark.createDataFrame(rows, DOCS), F.col("doc_id") < 1000).collect()}
    p = {t: got[1000 + k] for k, t in enumerate(dict.fromkeys(probe.values()))}
    # P(text) = P(words) P(end | last two): what ends here, and what goes on by one word and ends after it, shares P(words)
    for c in ("", "a", "a b", "c a", "zz a", "zz zz"):
        assert all(0 < p[f"{c} {x}".strip()] < 1 for x in ends if f"{c} {x}".strip() in p)
    taught = lm.mixture(np.tile([0.4, 0.3, 0.2, 0.1], (lm.BUCKETS, 1)), np.array([0, 0, 3]), np.array([0, 2, 5]))
    assert np.allclose(taught.sum(1), 1) and (taught[0, :2] == 0).all() and taught[1, 0] == 0
    count = plain_counts(train, [True] * len(train))
    n, vocab = sum(c for k, c in count.items() if len(k) == 1 and k != ("<s>",)), ["a", "b", "c", "</s>"]
    for u, w in (("a", "b"), ("b", "a"), ("zz", "a"), ("a", "zz"), ("zz", "zz")):
        cuv, cv = count.get((u, w), 0), count.get((w,), 0)
        m = lm.mixture(np.random.default_rng(1).dirichlet(np.ones(4), lm.BUCKETS), np.array([cuv]), np.array([cv]))[0]
        total = sum(m @ np.array([count.get((u, w, x), 0) / max(cuv, 1), count.get((w, x), 0) / max(cv, 1), count.get((x,), 0) / n, 1 / (len(vocab) + 1)]) for x in [*vocab, "unseen"])
        assert abs(total - 1) < 1e-12


def test_em_finds_weights():
    rng = np.random.default_rng(0)
    hist = np.zeros((lm.BUCKETS, lm.RANGE, lm.RANGE), dtype=np.int64)
    hist[3, 4, 30], hist[3, 0, 30] = 700, 300
    w = lm.learn_weights(hist, 1e-4)
    assert abs(w.sum(1) - 1).max() < 1e-6 and 0.6 < w[3, 0] < 0.75 and (w[5] == w[9]).all()
    assert (lm.bins(np.array([0.0, 1.0, 1e-30])) == [0, 1, lm.RANGE - 1]).all() and rng is not None


def test_packing():
    rng = np.random.default_rng(1)
    h = np.sort(rng.integers(0, 2**64 - 1, 1000, dtype=np.uint64))
    assert (lm.unpack_sorted(lm.pack_sorted(h)) == h).all() and len(lm.unpack(lm.pack(h[:0]), np.uint64)) == 0


# --- language identification ---

ALPHABETS = {"aa": "an er on re th nd".split(), "bb": "ich sch ung keit ü ä".split(), "cc": "que ción ado ñ os ll".split()}


def speak(lang, n, r):
    return " ".join("".join(r.choice(ALPHABETS[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))


def test_language_id(spark):
    r = random.Random(3)
    rows = [(k, speak(lang, r.randint(3, 60), r), lang) for k in range(300) for lang in [r.choice(list(ALPHABETS))]]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 !? ٣", "bb"), (1003, speak("bb", 5000, r), None), (None, speak("cc", 20, r), "cc")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    learn = df.where("doc_id % 4 <> 2")
    got = {x.doc_id: x for x in langid.identify(df, learn=learn).collect()}
    right = [got[k].lang_pred == lang for k, _, lang in rows[:300] if k % 4 == 2]
    assert np.mean(right) > 0.97
    assert [got[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3 and got[1003].lang_pred == "bb" and got[None].lang_pred == "cc"
    assert all(0 <= x.score <= 1 for x in got.values())
    assert {x.lang_pred for x in langid.identify(df, learn=learn.limit(0)).collect()} == {"und"}
    assert langid.identify(df.limit(0), learn=learn).count() == 0


def test_kernel_is_presence():
    a, b = langid.weigh(np.stack([langid.presence("abab"), langid.presence("abababab")]))
    assert abs(a @ b - 1) < 1e-5 and abs(a @ a - 1) < 1e-5
    c = langid.weigh(langid.presence("xyz")[None])[0]
    assert a @ c < 0.3


# --- toxicity ---


def toxic_docs(r, n=500):
    bad = ["grumblord", "snorfle", "wretchkin", "blunderpig"]
    rows = []
    for k in range(n):
        y = int(k % 5 == 0)
        w = prose(60, r).split()
        if y:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(bad))
        rows.append((k, " ".join(w), y))
    return rows, bad


def test_toxicity(spark):
    r = random.Random(21)
    rows, bad = toxic_docs(r)
    hidden = ["gr0mbl0rd".replace("0mb", "umb"), "s n o r f l e", "w-r-e-t-c-h-k-1-n", "blunnnnderp1g", "sn0rfle grumb1ord", "wretchkin! SNORFLE."]
    # toxic texts hold several such words
    docs = rows + [(2000 + i, prose(20, r) + f" {h} {prose(3, r)} {bad[i % 4]}x {h} " + prose(20, r), None) for i, h in enumerate(hidden)] + [(3000, None, 1), (3001, "", 1), (3002, prose(30_000, r), None), (None, prose(5, r), None)]
    df = spark.createDataFrame([d[:2] for d in docs], DOCS).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(d[0], d[2]) for d in rows] + [(None, 1), (9999, 0), (3000, 1)], "doc_id long, toxic int")
    model = toxicity.train(toxicity.labelled_rows(df, labels))
    assert set(bad) <= set(model.weight)
    got = {x.doc_id: x.score for x in toxicity.score(df, model).collect()}
    held = [(got[k] >= 0.7) == bool(y) for k, _, y in rows if zlib.crc32(str(k).encode()) % 3 == 1]
    assert np.mean(held) > 0.97
    assert all(0 <= s <= 1 for s in got.values()) and got[3000] == got[3001] and got[3002] < 0.7
    clean = got[3000]
    assert all(got[2000 + i] > clean + 0.2 for i in range(len(hidden)))
    kept = toxicity.reject(df, model)
    assert kept.columns == df.columns and all(got[x.doc_id] < 0.7 for x in kept.collect())
    assert toxicity.score(df.limit(0), model).count() == 0


@pytest.mark.parametrize("token,word", [("1d10t", "idiot"), ("i d i o t", "idiot"), ("looooser", "loser"), ("l.o.s.e.r", "loser"), ("tr@sh", "trash"), ("$tupid", "stupid"), ("st*pid", "stupid"), ("plain", "plain")])
def test_restoration(token, word):
    text = "this loser idiot trash stupid plain word list of the and more trees street rash tree strong plan plane".split()
    assert toxicity.restore(token, toxicity.CharModel.learn([(w, 3.0) for w in text])) == word


@pytest.mark.parametrize("labels", [[], [(1, 0), (2, 0)], [(1, 1)]])
def test_toxicity_without_both_labels(spark, labels):
    df = spark.createDataFrame([(1, "a b"), (2, "c d"), (3, None)], DOCS)
    m = toxicity.train(df.join(spark.createDataFrame(labels, "doc_id long, toxic int"), "doc_id"))
    assert len({x.score for x in toxicity.score(df, m).collect()}) == 1


def test_every_verbatim_piece_is_found(spark):
    """Whatever of an item, a window long, stands in a document, wherever it begins there or in the item."""
    r = random.Random(40)
    items = [(k, prose(120, r)) for k in range(6)]
    docs, want = [], set()
    for k in range(80):
        i = r.randrange(len(items))
        t = passages_text(items[i][1])
        n = r.randint(100, 160)
        at = r.randrange(len(t) - n)
        docs.append((k, f"{prose(30, r)} {t[at:at + n]} {prose(30, r)}"))
        want.add((k, i))
    docs += [(1000 + k, prose(100, r)) for k in range(40)]
    got = decontam.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id) for x in got} == want
    assert all(x.end - x.start >= 100 for x in got if x.edits == 0)
    some = decontam.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"), block_chars=900)
    assert {(x.doc_id, x.item_id) for x in some.collect()} == want
    left = decontam.clean(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"), block_chars=900)
    assert {x.doc_id for x in left.collect()} == {k for k, _ in docs if k >= 1000}


def passages_text(t):
    return "".join(map(chr, decontam.normal(t)))


def test_restoration_is_the_cheapest():
    """Against all ways to read a token."""
    r = random.Random(41)
    lm_ = toxicity.CharModel.learn([(word(r), 1.0 + k % 3) for k in range(200)])

    def ways(token, out, cost, last):
        if not token:
            two = ("^^" + out)[-2:]
            yield cost + lm_.cost(two, "$"), out
            return
        ch, rest = token[0], token[1:]
        two = ("^^" + out)[-2:]
        if ch.isalpha():
            yield from ways(rest, out + ch, cost + lm_.cost(two, ch), ch)
        for c in toxicity.LEET.get(ch, ""):
            yield from ways(rest, out + c, cost + 0.4 + lm_.cost(two, c), ch)
        if ch in toxicity.FILLER or not ch.isalnum():
            yield from ways(rest, out, cost + (0.3 if ch in toxicity.FILLER else 2.5), ch)
        if ch == last and (ch.isalpha() or ch in toxicity.LEET):
            yield from ways(rest, out, cost + 0.5, ch)

    for _ in range(200):
        token = "".join(r.choice("abno013@$*-. eei") for _ in range(r.randint(1, 8)))
        want = min(ways(token, "", 0.0, ""))
        got = toxicity.restore(token, lm_)
        assert got == want[1] or abs(min(c for c, o in ways(token, "", 0.0, "") if o == got) - want[0]) < 1e-9


def test_long_disguises():
    """Letters joined by signs, and letters drawn out, are seen in tokens of any length."""
    seen = list(toxicity.disguised("x " + "-".join("nastyword" * 9) + " b" + "a" * 90 + "d"))
    assert len(seen) > 1 and any("n-a-s-t-y-w-o-r-d" in s for s in seen) and "baaad" in seen


def test_hidden_words_in_tokens_of_any_length():
    """What a token hides is restored whatever its length: with few signs in it, with drawn-out letters, with letters far apart."""
    r = random.Random(52)
    lm_ = toxicity.CharModel.learn([(word(r), 1.0) for _ in range(200)] + [("nastyword", 50.0)])
    m = toxicity.Model({"nastyword": 3.0, "nasty-": 2.0}, -3.0, lm_)

    def junk(n):
        return "".join(r.choice("bcdfghjk7") for _ in range(n))

    assert "nastyword" in m.values(f"so {junk(50)}-n4styw0rd-{junk(50)} it is")
    assert "nastyword" in m.values(f"{junk(100_000)}/n4styw0rd")
    assert "nasty-" in m.values("nnnastyword" + "bcdfghjk" * 8)
    assert "nasty-" in m.values("n4styw0rd" + junk(60))
    assert "nastyword" in m.values("b-" * 18 + "-----".join("nastyword") + "-b" * 20)
    assert m.values(f"{junk(50)}-{junk(50)} {junk(200)} {'bcdfghjkkk' * 8}") == {}


def test_line_dedup_against_all_pairs(spark):
    """What aligning every pair of documents would cut, and nothing else; one text is very long."""
    r = random.Random(50)
    pool = [prose(r.randint(3, 14), r) for _ in range(60)]
    docs = []
    for k in range(120):
        ls = [prose(r.randint(2, 10), r) for _ in range(r.randint(2, 8))]
        for _ in range(r.randint(0, 2)):
            at, n = r.randrange(len(pool) - 3), r.randint(1, 3)
            i = r.randrange(len(ls) + 1)
            ls[i:i] = pool[at : at + n]
        docs.append((k, ls))
    docs.append((200, [prose(5, r) for _ in range(30_000)] + pool[3:6] + [prose(5, r)]))
    code = {}
    coded = {k: ([code.setdefault(x, len(code)) for x in ls], [len(x.split()) for x in ls]) for k, ls in docs}
    want = set()
    for k, (b, w) in coded.items():
        for j, (a, _) in coded.items():
            if j < k:
                want |= {(k, i) for i in linededup.repeated(a, b, w, 8)}
    df = spark.createDataFrame([(k, "\n".join(ls)) for k, ls in docs], DOCS).withColumn("lines", F.lit("clash")).withColumn("df", F.lit(1))
    got = {(x.doc_id, i) for x in linededup.find_repeats(df).collect() for i in x.removed}
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) > 100


def test_passage_in_very_long_texts(spark):
    """Texts of a hundred thousand words with one passage in common, and columns with names of the operator's own."""
    r = random.Random(51)
    p = prose(80, r)
    docs = [(1, prose(60_000, r) + " " + p + " " + prose(40_000, r)), (2, prose(90_000, r) + " " + p + " " + prose(10_000, r)), (3, "x " + p)]
    df = spark.createDataFrame(docs, DOCS).withColumn("g", F.lit("clash")).withColumn("a", F.lit(1)).withColumn("th", F.lit(None).cast("long"))
    got = passages.repeated_passages(df).collect()
    assert {(2, 1), (3, 1)} <= {(x.doc_id, x.of_doc_id) for x in got if x.end - x.start >= 80 and x.edits == 0}


def test_toxicity_of_repeats(spark):
    """Equal rows have equal scores, whatever their ids; an empty table has none."""
    train = spark.createDataFrame([(k, "you are a nastyword" if k % 4 == 0 else f"a quiet day number {k} by the sea", int(k % 4 == 0)) for k in range(200)], "doc_id long, text string, toxic int")
    model = toxicity.train(train)
    rows = [(1, "you nastyword"), (1, "you nastyword"), (None, "you nastyword"), (2, None), (3, "")]
    df = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash"))
    got = toxicity.score(df, model).collect()
    assert len(got) == 5 and len({x.score for x in got if x.doc_id not in (2, 3)}) == 1 and len({x.score for x in got if x.doc_id in (2, 3)}) == 1
    assert toxicity.score(df.limit(0), model).count() == 0 and toxicity.reject(df.limit(0), model).count() == 0
