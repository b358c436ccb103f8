"""Language identification by string kernels.

The kernel of two texts blends, over n = 1..3, the share of character n-grams that both contain (presence, not counts):
|A and B| / sqrt(|A| |B|).  N-grams are hashed into a fixed number of cells a length, so a text is a sparse presence
vector and the kernel its dot product.  A Nystrom map over landmark texts gives kernel ridge regression, one language
against the rest, in closed form.  Because the kernel is linear in presence vectors, landmark and ridge weights fold into
one matrix, and a batch of texts is scored by a single matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Cells for n-grams of length 1, 2 and 3, powers of two.
CELLS = (1 << 10, 1 << 13, 1 << 15)
BLEND = (0.2, 0.4, 0.4)


def presence(text: str) -> np.ndarray:
    """Which cells the n-grams of ``text``, lower-cased, fall into; the whole text counts."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = np.zeros(sum(CELLS), dtype=bool)
    at, h = 0, None
    for n, cells in enumerate(CELLS, 1):
        if len(c) >= n:
            h = c.copy() if h is None else h[:-1] * np.uint32(0x01000193) + c[n - 1 :]
            bits = np.uint32(32 - cells.bit_length() + 1)
            out[at + (c & np.uint32(cells - 1) if n == 1 else (h * np.uint32(0x9E3779B1)) >> bits)] = True
        at += cells
    return out


def weigh(rows: np.ndarray) -> np.ndarray:
    """Presence rows as float32, each length's part scaled to its share of the blended kernel."""
    out = rows.astype(np.float32)
    at = 0
    for share, cells in zip(BLEND, CELLS, strict=True):
        part = out[:, at : at + cells]
        part *= np.sqrt(share / np.maximum(part.sum(1, keepdims=True), 1)).astype(np.float32)
        at += cells
    return out


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # (cells, languages)
    sharpness: float

    def predict(self, texts: list[str | None], batch: int = 64) -> tuple[list[str], list[float]]:
        """Language and score in 0..1; ``und`` and 0 for null, texts without a letter, or when nothing was learned."""
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        todo = [i for i, t in enumerate(texts) if t and self.langs and any(map(str.isalpha, t))]
        for at in range(0, len(todo), batch):
            ids = todo[at : at + batch]
            f = weigh(np.stack([presence(texts[i]) for i in ids])) @ self.weights
            z = np.exp(self.sharpness * (f - f.max(1, keepdims=True)).astype(np.float64))
            z /= z.sum(1, keepdims=True)
            for i, k, p in zip(ids, z.argmax(1).tolist(), z.max(1).tolist(), strict=True):
                langs[i], scores[i] = self.langs[k], min(1.0, p)
        return langs, scores


def fit(texts: list[str], langs: list[str], landmarks: int = 512, ridge: float = 1e-3, sharpness: float = 8.0, seed: int = 10) -> Model:
    """Nystrom kernel ridge regression on the given texts; landmarks are drawn from them, in turn by language."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((sum(CELLS), 0), dtype=np.float32), sharpness)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    nth: dict[str, int] = {}
    rank = []
    for i in order:
        nth[langs[i]] = nth.get(langs[i], 0) + 1
        rank.append((nth[langs[i]], int(i)))
    marks = weigh(np.stack([presence(texts[i]) for _, i in sorted(rank)[:landmarks]]))
    w, v = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = w > 1e-6 * w.max()
    root = v[:, keep] / np.sqrt(w[keep])
    phi = np.vstack([(weigh(np.stack([presence(t) for t in texts[a : a + 256]])) @ marks.T).astype(np.float64) @ root for a in range(0, len(texts), 256)])
    y = np.where(np.array(langs)[:, None] == np.array(names)[None], 1.0, -1.0)
    share = 1.0 / np.maximum((y > 0).sum(0), 1)  # every language weighs the same
    row = share[np.array([names.index(x) for x in langs])]
    row /= row.mean()
    beta = np.linalg.solve(phi.T @ (row[:, None] * phi) + ridge * len(texts) * np.eye(phi.shape[1]), phi.T @ (row[:, None] * y))
    return Model(names, (marks.T @ (root @ beta)).astype(np.float32), sharpness)


def training_sample(docs: DataFrame, per_lang: int, seed: int = 101) -> list:
    """About ``per_lang`` rows a language, by a keyed hash of doc_id; languages with fewer give all they have."""
    spark = docs.sparkSession
    counts = docs.groupBy("lang").agg(F.count("*").alias("n")).collect()
    share = spark.createDataFrame([(r.lang, min(1.0, per_lang / r.n)) for r in counts], "_l string, _share double")
    u = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return docs.join(F.broadcast(share), F.col("lang") == F.col("_l")).where(u < F.col("_share")).select("doc_id", "lang", "text").collect()


def identify(docs: DataFrame, *, learn: DataFrame | None = None, per_lang: int = 600, landmarks: int = 512) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, lang_pred, score)``, learned from ``learn(doc_id, text, lang)``.

    Null texts and texts without a letter (Unicode L) get ``und`` and score 0, and aren't learned from; nor are rows
    with null lang.  The classifier is fitted on about ``per_lang`` documents a language, a documented bound; scoring
    covers whole texts of any length.  With nothing to learn from, every row is ``und``.  Repeated rows keep a row each; an
    empty table gives no rows; other columns are ignored, whatever their names.
    """
    learn = docs if learn is None else learn
    rows = training_sample(learn.where("lang is not null and text rlike '\\\\p{L}'").select("doc_id", "lang", "text"), per_lang)
    rows = sorted(rows, key=lambda r: (r.lang, r.doc_id is None, r.doc_id or 0, r.text))
    model = docs.sparkSession.sparkContext.broadcast(fit([r.text for r in rows], [r.lang for r in rows], landmarks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                langs, scores = model.value.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, type=pa.string()), pa.array(scores, type=pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``; a null doc_id is neither learned from nor held out; nulls and repeats as in :func:`identify`."""
    docs = common.table(spark, sf_dir, "documents")
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    return identify(docs, learn=docs.where(rest != 2)).select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
