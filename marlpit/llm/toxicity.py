"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

Words written in disguise (digits and signs for letters, letters spaced out or joined by signs, letters repeated) are
restored first.  A disguised token is a lattice: each character may stand for itself, for the letters it is used for, or
for nothing.  A Viterbi search over the last two letters finds the likeliest ones under a channel model and a character trigram
model learned from the corpus and the lexicon.  The lexicon itself, words and word beginnings that tell toxic texts, is
counted over all labelled training documents, one document for each group of near copies; a logistic regression on a
bounded sample of them weighs its entries.
"""

from __future__ import annotations

import math
import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: What signs are commonly written for which letters.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "*": "aeiou", "#": "h"}
#: Characters that may be dropped between letters.
FILLER = set(" .-_*~'\"`^,:;/\\|+=#")
#: Label rows (16 bytes each) up to which they are broadcast rather than joined by a shuffle.
BROADCAST_ROWS = 2_000_000
EDGE = "\"'`.,:;?!()[]{}<>&%*#~^=+-_/\\|“”‘’«»…"
#: Lengths of word beginnings that are features of their own, marked with a trailing dash.
STEMS = (3, 4, 5, 6, 7, 8)
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
_RUN = re.compile(r"([^\W\d_])\1{3,}")
_SPACED = re.compile(r"(?:(?<=\s)|^)\S(?:\s\S){2,}(?=\s|$)")


@dataclass
class CharModel:
    """Interpolated character trigrams with ends of words."""

    tri: dict[str, float] = field(default_factory=dict)
    bi: dict[str, float] = field(default_factory=dict)
    uni: dict[str, float] = field(default_factory=dict)
    floor: float = -9.0
    memo: dict[str, float] = field(default_factory=dict)

    @staticmethod
    def learn(words: Iterable[tuple[str, float]]) -> CharModel:
        t, b, u, ct, cb = Counter(), Counter(), Counter(), Counter(), Counter()
        total = 0.0
        for word, n in words:
            s = f"^^{word}$"
            for i in range(2, len(s)):
                t[s[i - 2 : i + 1]] += n
                ct[s[i - 2 : i]] += n
                b[s[i - 1 : i + 1]] += n
                cb[s[i - 1]] += n
                u[s[i]] += n
                total += n
        m = CharModel()
        m.tri = {k: v / ct[k[:2]] for k, v in t.items()}
        m.bi = {k: v / cb[k[0]] for k, v in b.items()}
        m.uni = {k: v / total for k, v in u.items()}
        return m

    def cost(self, two: str, c: str) -> float:
        got = self.memo.get(two + c)
        if got is None:
            p = 0.7 * self.tri.get(two + c, 0.0) + 0.2 * self.bi.get(two[1] + c, 0.0) + 0.1 * self.uni.get(c, 0.0)
            got = -math.log(p) if p > 0 else -self.floor
            if len(self.memo) >= 200_000:
                self.memo.clear()
            self.memo[two + c] = got
        return got


def restore(token: str, lm: CharModel) -> str:
    """The likeliest letters behind ``token`` (lower case); its own letters where nothing is disguised.

    Exact: of all ways to the same last two letters only the cheapest can be part of the best, as costs to come depend on
    those alone.  Ties go to the smaller word.  Letters that all ways left agree on are set aside, so that time grows with
    the length of a token, however long.
    """
    best: dict[str, tuple[float, str]] = {"^^": (0.0, "")}  # last two letters -> cost and letters since those set aside
    last, sure = "", []
    for at, ch in enumerate(token, 1):
        new: dict[str, tuple[float, str]] = {}
        letters = [(ch, 0.0)] if ch.isalpha() else []
        letters += [(c, 0.4) for c in LEET.get(ch, "")]
        skip = 0.3 if ch in FILLER else 2.5 if not ch.isalnum() else math.inf
        if ch == last and (ch.isalpha() or ch in LEET):
            skip = min(skip, 0.5)  # one more of a repeated letter
        if not letters and skip == math.inf:
            skip = 6.0
        for two, (cost, out) in best.items():
            for c, extra in letters:
                way = (cost + extra + lm.cost(two, c), out + c)
                key = two[1] + c
                if key not in new or way < new[key]:
                    new[key] = way
            if skip < math.inf and (two not in new or (cost + skip, out) < new[two]):
                new[two] = (cost + skip, out)
        best, last = new, ch
        if at % 64 == 0:
            sure.append(os.path.commonprefix([out for _, out in best.values()]))
            best = {two: (cost, out[len(sure[-1]) :]) for two, (cost, out) in best.items()}
    return "".join(sure) + min((cost + lm.cost(two, "$"), out) for two, (cost, out) in best.items())[1]


def cut_at(z: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """The middle of the widest range of cuts on ``z`` that call the fewest of ``n`` rows wrongly."""
    order = np.argsort(z, kind="stable")
    z, y, n = z[order], y[order], n[order]
    wrong = np.concatenate(([0.0], np.cumsum(n * y))) + np.concatenate((np.cumsum((n * (1 - y))[::-1])[::-1], [0.0]))
    edge = np.concatenate(([z[0] - 1.0], z, [z[-1] + 1.0]))
    width = np.diff(edge)
    best = np.flatnonzero((wrong <= wrong[width > 1e-6].min() + 1e-9) & (width > 1e-6))
    k = int(best[np.argmax(width[best])])
    return float((edge[k] + edge[k + 1]) / 2)


def bare(raw: set[str]) -> set[str]:
    """Words of a set of lower-cased tokens, without signs at their edges."""
    return {w if w.isalpha() else w.strip(EDGE) for w in raw}


def disguised(text: str, raw: set[str] | None = None) -> Iterator[str]:
    """Tokens of a lower-cased text that may hide a word: inner digits or signs, tripled letters, letters spaced out.

    Whole and of any length; in long ones runs of more than three of a letter are written as three.
    """
    raw = set(text.split()) if raw is None else raw
    for w in raw:
        if not w.isalpha() and len(w) > 2:
            core = w.strip("\"'.,:;?&%()[]{}")
            core = core if len(core) <= 40 else _RUN.sub(r"\1\1\1", core)
            if len(core) >= 3 and not core.strip(EDGE).isalpha() and any(map(str.isalpha, core)):
                yield core
    if _TRIPLE.search(text):
        for w in raw:
            if _TRIPLE.search(w):
                w = w if len(w) <= 60 else _RUN.sub(r"\1\1\1", w)
                yield w.strip(EDGE)
    if sum(len(w) == 1 for w in raw) > 1:
        for m in _SPACED.finditer(text):
            yield m[0]


@dataclass
class Model:
    weight: dict[str, float]
    bias: float
    lm: CharModel
    memo: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.full = {w for w in self.weight if not w.endswith("-")}
        self.stems = {n: {w[:-1] for w in self.weight if w.endswith("-") and len(w) == n + 1} for n in STEMS}
        self.starts = {s[:3] for stems in self.stems.values() for s in stems}
        self.long = sorted(w for w in self.full if len(w) >= 4)

    def hidden(self, token: str) -> tuple[str, ...]:
        """Features of what ``token`` hides: the restored word, and lexicon words inside it if its letters were split."""
        got = self.memo.get(token)
        if got is None:
            word = restore(token, self.lm)
            hits = self.features({word}) if word and word != token else set()
            if any(c in FILLER for c in token):
                hits |= self.features({w for w in self.long if w in word})
            got = tuple(sorted(hits))
            if len(self.memo) >= 50_000:
                self.memo.clear()
            if len(token) <= 80:
                self.memo[token] = got
        return got

    def features(self, words: set[str]) -> set[str]:
        hits = words & self.full
        starts = self.starts
        able = {w for w in words if w[:3] in starts}
        if able:
            for n, stems in self.stems.items():
                hits |= {s + "-" for s in {w[:n] for w in able if len(w) > n} & stems}
        return hits

    def values(self, text: str) -> dict[str, float]:
        """Features of a text with their values: the root of how often the text has them, 2 at most."""
        low = text.lower()
        tokens = low.split()
        raw = set(tokens)
        hits = self.features(bare(raw))
        for token in disguised(low, raw):
            hits.update(self.hidden(token))
        if not hits:
            return {}
        words = Counter(w.strip(EDGE) for w in tokens)
        count = {h: sum(n for w, n in words.items() if len(w) >= len(h) and w.startswith(h[:-1])) if h.endswith("-") else words[h] for h in hits}
        return {h: min(max(count[h], 1), 4) ** 0.5 for h in hits}

    def score(self, text: str | None) -> float:
        z = self.bias
        if text:
            z += sum(v * self.weight[h] for h, v in sorted(self.values(text).items()))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def regress(x: np.ndarray, y: np.ndarray, n: np.ndarray, start: np.ndarray, ridge: float = 0.003, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression by Nesterov steps; rows weigh ``n``.  Weights stay at 0 or above, as every feature tells for toxic."""
    w, b = start.copy(), float(np.log((n * y).sum() / (n * (1 - y)).sum()))
    step = 4.0 / float((n * (x**2).sum(1)).sum() / n.sum() + 1.0)
    vw, vb = w.copy(), b
    for k in range(rounds):
        g = n * (1 / (1 + np.exp(-np.clip(x @ vw + vb, -30, 30))) - y) / n.sum()
        nw, nb = np.maximum(vw - step * (x.T @ g + ridge * vw / len(start) ** 0.5), 0), vb - step * g.sum()
        vw, vb = nw + k / (k + 3) * (nw - w), nb + k / (k + 3) * (nb - b)
        w, b = nw, nb
    return w, b


def features(text: str) -> set[str]:
    """All features that a training text may teach: its words and their beginnings."""
    words = {w for w in bare(set(text.split())) if 2 <= len(w) <= 40}
    return words | {w[:n] + "-" for n in STEMS for w in words if len(w) > n and w[:n].isalpha()}


def sketch(text: str) -> int:
    """Smallest hash of the 5-word shingles: equal for most near copies."""
    w = text.lower().split()
    return min((xxhash.xxh64_intdigest(" ".join(w[i : i + 5])) for i in range(max(1, len(w) - 4))), default=0) - (1 << 63)


def train(labelled: DataFrame, *, least: int = 3, strength: float = 1.2, most_features: int = 1000, fit_rows: int = 12_000, lm_words: int = 20_000) -> Model:
    """Learn from ``labelled(doc_id, text, toxic)``: rows with null text, or a label other than 0 and 1, teach nothing.

    All labelled rows are counted, one row a sketch (so that copies don't teach chance words).  A feature stays if at
    least ``least`` toxic texts (and a hundredth of them) have it and the lower end of its log-odds is above ``strength``.  ``most_features`` and
    ``lm_words`` bound the model, not the counting; the regression sees about ``fit_rows`` rows, drawn by a keyed hash.  Without both a toxic and a clean text every text scores 0.5.
    """
    rows = labelled.where("text is not null and toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([sketch(t) for t in b.column(2).to_pylist()], type=pa.int64())], names=["doc_id", "toxic", "sketch"])

    marks = common.materialise(rows.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic", "text").mapInArrow(mark, "doc_id long, toxic int, sketch long").groupBy("sketch").agg(F.min_by("doc_id", "doc_id").alias("doc_id"), F.min_by("toxic", "doc_id").alias("toxic")), "tox-marks")
    n = {r.toxic: r.n for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    if not pos or not neg:
        return Model({}, 0.0, CharModel())
    few = marks.select("doc_id").distinct()
    teach = rows.join(F.broadcast(few) if pos + neg <= BROADCAST_ROWS else few, "doc_id", "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: dict[int, Counter] = {0: Counter(), 1: Counter()}

        def flush() -> Iterator[pa.RecordBatch]:
            keys = list({*part[0], *part[1]})
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, type=pa.string()), pa.array([part[1][k] for k in keys], type=pa.int64()), pa.array([part[0][k] for k in keys], type=pa.int64())], names=["feature", "pos", "neg"])
            part[0].clear()
            part[1].clear()

        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part[y].update(features(t.lower()))
                if len(part[0]) > 400_000:
                    yield from flush()
        yield from flush()

    counts = teach.select("toxic", "text").mapInArrow(count, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    a, c = F.col("pos") + 0.5, F.col("neg") + 0.5
    low = F.log(a / (pos + 1.0)) - F.log(c / (neg + 1.0)) - 1.64 * F.sqrt(1 / a + 1 / c)
    counts = common.materialise(counts.where("pos + neg >= 2").withColumn("low", low), "tox-counts")
    least = max(least, pos // 100)  # chance words come with the size of the corpus
    kept = counts.where((F.col("pos") >= least) & (F.col("low") >= strength)).orderBy(F.desc("low"), F.desc("pos"), "feature").limit(most_features).collect()
    weight = {r.feature: float(r.low) for r in kept}
    common_words = counts.where("feature not like '%-' and feature rlike '^[\\\\p{L}]+$'").orderBy((F.col("pos") + F.col("neg")).desc(), "feature").limit(lm_words)
    common_words = common.materialise(common_words, "tox-words").collect()
    lexicon = [w for w in weight if not w.endswith("-") and w.isalpha()]
    mass = sum(math.log1p(r.pos + r.neg) for r in common_words)
    lm = CharModel.learn([(r.feature, math.log1p(r.pos + r.neg)) for r in common_words] + [(w, 0.3 * mass / len(lexicon)) for w in lexicon])
    draft = labelled.sparkSession.sparkContext.broadcast((weight, 0.0, lm))

    def value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*draft.value)
        for b in batches:
            v = [m.values(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([list(x) for x in v], type=pa.list_(pa.string())), pa.array([list(x.values()) for x in v], type=pa.list_(pa.float64()))], names=["toxic", "features", "values"])

    share = F.lit(min(1.0, fit_rows / (pos + neg)))
    drawn = teach.where(F.pmod(F.xxhash64(F.lit(51), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30)) < share)
    got = drawn.select("toxic", "text").mapInArrow(value, "toxic int, features array<string>, values array<double>").groupBy("toxic", "features", "values").agg(F.count("*").alias("n")).orderBy("toxic", "features", "values").collect()
    names = sorted(weight)
    if not names or {r.toxic for r in got} != {0, 1}:
        return Model(weight, math.log(pos / neg), lm)
    at = {w: i for i, w in enumerate(names)}
    x = np.zeros((len(got), len(names)), dtype=np.float32)
    for i, r in enumerate(got):
        for f, v in zip(r.features, r["values"], strict=True):
            x[i, at[f]] = v
    y, n_of = np.array([r.toxic for r in got], dtype=np.float32), np.array([r.n for r in got], dtype=np.float32)
    w, b = regress(x, y, n_of * np.where(y > 0, 3, 1), np.array([weight[k] for k in names], dtype=np.float32))
    # What the training rows are best cut at becomes the score 0.7.
    b += math.log(0.7 / 0.3) - cut_at(x @ w + b, y, n_of)
    return Model({k: float(v) for k, v in zip(names, w, strict=True) if v > 1e-4}, float(b), lm)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, score)``: 0 to 1, higher is likelier toxic; null and empty texts get the prior.

    Rows that repeat are scored each; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    held = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias, model.lm))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*held.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.score(x.as_py()) for x in b.column(1)], type=pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def reject(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``, all columns unchanged, whatever their names.  Null and
    empty texts have the prior's score; rows that repeat stay or go together; an empty table stays empty."""
    held = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias, model.lm))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*held.value)
        for b in batches:
            yield b.filter(pa.array([m.score(x.as_py()) < threshold for x in b.column(at)], type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def labelled_rows(docs: DataFrame, labels: DataFrame, most_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Training rows: those whose crc32(doc_id as text) mod 3 is not 1.  Labels are broadcast only if few by count."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    y = labels.where((crc != 1) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    y = F.broadcast(y) if labels.count() <= most_rows else y
    return docs.where(crc != 1).select("doc_id", "text").join(y, "doc_id")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``; a null doc_id is neither learned from nor held out; nulls and repeats as in :func:`score`."""
    docs = common.table(spark, sf_dir, "documents")
    model = train(labelled_rows(docs, common.table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
