"""LM scoring by deleted interpolation.

A word trigram model: the maximum-likelihood estimates of the trigram, the bigram, the unigram and the uniform word are
mixed with weights that depend on the bucket of the context's frequency: that of the two words before or, where they were
never seen together, of the one word before.  The weights are learned by expectation-maximisation on deleted counts, each
training token held out in turn from the counts that predict it (Jelinek and Mercer).  What is counted is every training
document; the counts live in hash-partitioned shuffles and are never on the driver.

Shuffling one row a token would move several times the corpus.  Instead documents are worked on in chunks; a chunk sends
each of its distinct words, bigrams and trigrams once, packed by ranges of hashes, and gets their corpus counts back:

1. every chunk keeps its tokens as indices into its sorted distinct words (``tok``), and sends packed, sorted hashes with
   its own counts to the ranges: first its words, then those bigrams and trigrams whose words others have too;
2. a range adds up the counts over the chunks that asked, and answers each in the order of its question.  A chunk sends to
   ``fan`` ranges at most, so that rows grow as the corpus does; where more are needed, the questions to a range are put
   together to larger ones and go on to ``fan`` parts of it, and the answers come back the same way;
3. tokens and answers meet again by chunk.  One pass collects the histogram that the mixture weights are learned from (its
   size is fixed), a second scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MULT = np.uint64(0x9E3779B97F4A7C15)
#: Token hashes that no word has: the start before each text, and its end, which is a token.
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
#: Stands for the pair before a text's first word.
OPEN = np.uint64(0x4F50454E)
#: Kinds of what is counted: words, bigrams, trigrams.  Hashes of the latter two are cut to 56 bits.
WORD, PAIR, TRIPLE = 1, 2, 3
HASH_BITS = {WORD: 64, PAIR: 56, TRIPLE: 56}
#: Context frequencies are bucketed by doubling, half of the buckets for single words; for learning, estimates are binned
#: by half octaves, those of unigrams by octaves.
BUCKETS, STEPS, RANGE = 64, 2, 40
#: Buckets that a table is written in; Spark allows 100,000.
MOST_BUCKETS = 50_000


def pack(a: np.ndarray) -> bytes:
    """Byte planes of an integer array, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"")


def unpack(b: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel() if len(raw) else np.zeros(0, dtype=dtype)


def pack_sorted(h: np.ndarray) -> bytes:
    return pack(np.diff(h, prepend=np.uint64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b, np.uint64), dtype=np.uint64)


def tokens(text: bytes | None) -> np.ndarray:
    """Hashes of the words of a text, A-Z lower-cased, then the end."""
    return np.append(common.word_hashes(text), END)


def bigrams(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    h = (v * MULT) ^ (w + np.uint64(0x632BE59BD9B4E019))
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def layout(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of texts of ``sizes`` tokens laid end to end, each behind a start: places of the starts, places of the tokens."""
    begins = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    follows = np.ones(int((sizes + 1).sum()), dtype=bool)
    follows[begins] = False
    return begins, np.flatnonzero(follows)


def grams_of(words: np.ndarray, at: np.ndarray, sizes: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct bigrams, sorted, and the place of each token's among them; the same of trigrams.  ``i``: places of the tokens."""
    two = bigrams(words[at[i - 1]], words[at[i]])
    before = np.concatenate((np.array([OPEN], dtype=np.uint64), two[:-1]))
    before[np.concatenate(([0], np.cumsum(sizes)[:-1]))] = OPEN
    pairs, in_pairs = np.unique(two >> np.uint64(8), return_inverse=True)
    triples, in_triples = np.unique(bigrams(before, words[at[i]]) >> np.uint64(8), return_inverse=True)
    return pairs, in_pairs, triples, in_triples


def chunks(batches: Iterator[pa.RecordBatch], most_tokens: int) -> Iterator[tuple[list, np.ndarray, list[np.ndarray]]]:
    """(ids, training flags, tokens) of documents in a row, up to about ``most_tokens`` tokens together."""
    ids, train, docs, n = [], [], [], 0
    for b in batches:
        flags = b.column(2).to_pylist()
        for i in range(b.num_rows):
            t = tokens(b.column(1)[i].as_py())
            if docs and n + len(t) > most_tokens:
                yield ids, np.array(train), docs
                ids, train, docs, n = [], [], [], 0
            ids.append(b.column(0)[i].as_py())
            train.append(flags[i])
            docs.append(t)
            n += len(t)
    if docs:
        yield ids, np.array(train), docs


def bins(f: np.ndarray, steps: float = STEPS) -> np.ndarray:
    """Bin of an estimate: 0 for zero, then by falling size, ``steps`` an octave."""
    return np.where(f > 0, 1 + np.clip(np.rint(-np.log2(np.where(f > 0, f, 1)) * steps).astype(np.int64), 0, RANGE - 2), 0)


def context_bucket(cuv: np.ndarray, cv: np.ndarray) -> np.ndarray:
    """By doublings of the frequency of the two words before; where they were never seen together, of the one word before
    (0: nor was that)."""
    half = BUCKETS // 2
    doublings = lambda c: np.minimum(np.log2(np.maximum(c, 1)).astype(np.int64), half - 2)
    return np.where(cuv > 0, half + doublings(cuv), np.where(cv > 0, 1 + doublings(cv), 0))


def learn_weights(hist: np.ndarray, uniform: float, rounds: int = 60) -> np.ndarray:
    """EM on deleted counts: ``hist[bucket, bins of the estimates, longest first]`` tokens -> weights (bucket, estimates
    and uniform).  A bucket of fewer than 50 tokens takes the weights of all tokens together."""
    orders = hist.ndim - 1
    grids = [np.append(0.0, 2.0 ** (-np.arange(RANGE - 1) / (1 if k == orders - 1 else STEPS))) for k in range(orders)]

    def em(c: np.ndarray) -> np.ndarray:
        at = np.nonzero(c)
        n = c[at].astype(np.float64)
        f = np.stack([*(g[a] for g, a in zip(grids, at, strict=True)), np.full(len(n), uniform)])
        w = np.array([0.8 / orders] * orders + [0.2])
        for _ in range(rounds if len(n) else 0):
            part = w[:, None] * f
            w = (n * part / part.sum(0)).sum(1) / n.sum()
            w = np.maximum(w, 1e-9)
            w /= w.sum()
        return w

    every = em(hist.sum(0))
    return np.stack([em(c) if c.sum() >= 50 else every for c in hist])


def mixture(weights: np.ndarray, cuv: np.ndarray, cv: np.ndarray) -> np.ndarray:
    """Weights of each token: a context never seen gives its share to the others, so that they stay a distribution."""
    w = weights[context_bucket(cuv, cv)].copy()
    w[:, 0] *= cuv > 0
    w[:, 1] *= cv > 0
    return w / w.sum(1, keepdims=True)


def inner_edges(kind: int, part: int, parts: int, fan: int) -> np.ndarray:
    """Where the ``fan`` ranges that range ``part`` of ``parts`` is cut into begin, but for the first."""
    return np.array([((part * fan + k) << HASH_BITS[kind]) // (parts * fan) for k in range(1, fan)], dtype=np.uint64)


def questions(key: int, kind: int, h: np.ndarray, n: np.ndarray, part: int, parts: int, fan: int) -> list[tuple]:
    """Rows (chunk, kind, part, h, n) of sorted hashes and their counts, one for each of ``fan`` ranges that has some."""
    cut = np.searchsorted(h, inner_edges(kind, part, parts, fan)).tolist()
    return [(key, kind, part * fan + b, pack_sorted(h[lo:hi]), pack(n[lo:hi])) for b, (lo, hi) in enumerate(zip([0, *cut], [*cut, len(h)], strict=True)) if hi > lo]


ASK = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("part", pa.int64()), ("h", pa.binary()), ("n", pa.binary())])


def _batch(rows: list[tuple], schema: pa.Schema = ASK) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=f.type) for k, f in enumerate(schema)], schema=schema)


def _by_key(batches: Iterator[pa.RecordBatch], keys: slice) -> Iterator[list[tuple]]:
    """Rows that follow one another and agree in ``keys``."""
    held: list[tuple] = []
    for t in batches:
        for row in zip(*(c.to_pylist() for c in t.columns), strict=True):
            if held and held[-1][keys] != row[keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _added(hs: list[np.ndarray], ns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, the place of each among them, and the sums of their counts."""
    keys, place = np.unique(np.concatenate(hs), return_inverse=True)
    return keys, place, np.bincount(place, weights=np.concatenate(ns), minlength=len(keys)).astype(np.uint64)


def _joined(t: pa.RecordBatch, r: int, kind: int, which: str = "") -> np.ndarray:
    """The answers of one kind to a chunk, part after part."""
    kinds, ns = t.column(f"kind{which}")[r].as_py() or [], t.column(f"n{which}")[r].as_py() or []
    return np.concatenate([np.zeros(0, dtype=np.uint64), *(unpack(n, np.uint64) for n, k in zip(ns, kinds, strict=True) if k == kind)])


def corpus_counts(asked: DataFrame, n_chunks: int, fans: list[int], most_tasks: int = 20_000) -> DataFrame:
    """``asked(chunk, kind, part, h, n)`` by the first of ``fans`` -> ``(chunk, kind, part, n)``: the sums of ``n`` over all
    chunks for each of ``h``, in its order.  Rows of kind 0 hold sums over words: of all counts, and of words counted."""
    tasks = min(most_tasks, 3 * math.prod(fans))
    schema = "chunk long, kind int, part long, n binary"

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sums = pa.schema([ASK.field(c) for c in ("chunk", "kind", "part", "n")]), np.zeros(2, dtype=np.uint64)
        for rows in _by_key(batches, slice(0, 2)):
            kind, part = rows[0][:2]
            hs = [unpack_sorted(r[3]) for r in rows]
            keys, place, total = _added(hs, [unpack(r[4], np.uint64) for r in rows])
            out = [(r[2], kind, part, pack(n)) for r, n in zip(rows, np.split(total[place], np.cumsum([len(h) for h in hs])[:-1]), strict=True)]
            if kind == WORD:
                real = total[keys != START]
                sums += np.array([real.sum(), (real > 0).sum()], dtype=np.uint64)
            yield _batch(out, names)
        if sums.any():
            yield _batch([(-1, 0, 0, pack(sums))], names)

    by_part = lambda df: df.repartition(tasks, "kind", "part")
    if len(fans) == 1:
        return by_part(asked).select("kind", "part", "chunk", "h", "n").sortWithinPartitions("kind", "part", "chunk").mapInArrow(answer, schema)
    # Questions to one range are put together, as many as make a chunk again, and go on to its parts.
    done, fan = fans[0], fans[1]
    groups = max(1, -(-n_chunks // done))
    asked = common.materialise(asked.withColumn("gid", F.pmod(F.xxhash64(F.lit(81), "chunk"), F.lit(groups))), "lm-asked")

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_key(batches, slice(0, 3)):
            kind, part, gid = rows[0][:3]
            keys, _, total = _added([unpack_sorted(r[4]) for r in rows], [unpack(r[5], np.uint64) for r in rows])
            yield _batch(questions(gid, kind, keys, total, part, done, fan))

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_key(batches, slice(0, 3)):
            kind, part = rows[0][:2]
            total = np.concatenate([unpack(r[5], np.uint64) for r in rows if r[3] < 0])
            hs = [(r[3], unpack_sorted(r[4])) for r in rows if r[3] >= 0]
            keys = np.unique(np.concatenate([h for _, h in hs]))
            yield _batch([(chunk, kind, part, pack(total[np.searchsorted(keys, h)])) for chunk, h in hs], pa.schema([ASK.field(c) for c in ("chunk", "kind", "part", "n")]))

    met = asked.repartition(min(most_tasks, 3 * done * groups), "kind", "part", "gid").select("kind", "part", "gid", "chunk", "h", "n").sortWithinPartitions("kind", "part", "gid", "chunk")
    below = corpus_counts(met.mapInArrow(together, "chunk long, kind int, part long, h binary, n binary"), groups, [done * fan, *fans[2:]], most_tasks)
    below = common.materialise(below, "lm-below")
    # Answers come first among a question's rows, in the order of their parts.
    one = below.where("kind > 0").select("kind", F.floor(F.col("part") / fan).cast("long").alias("part"), F.col("chunk").alias("gid"), (F.col("part") - (1 << 62)).alias("chunk"), F.lit(None).cast("binary").alias("h"), "n")
    two = asked.select("kind", "part", "gid", "chunk", "h", F.lit(None).cast("binary").alias("n"))
    back = one.unionByName(two).repartition(min(most_tasks, 3 * done * groups), "kind", "part", "gid").sortWithinPartitions("kind", "part", "gid", "chunk")
    return back.mapInArrow(apart, schema).unionByName(below.where("kind = 0"))


def score(docs: DataFrame, learn: Column, *, most_tokens: int = 1_000_000, bucket_tokens: int = 2_000_000, fan: int = 1024) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n_tokens, n_known, train_tokens, base_score, score)``.

    Null text is empty; an empty text has one token, its end.  ``learn`` is a condition on rows of ``docs`` (null: no).
    ``base_score`` is the unigram model with 0.1 added to each count, ``score`` the interpolated model, both log10 of the
    text's probability.  Without any training token both are those of one unknown word: 0 a token.  Rows that repeat, also
    with a null doc_id, are scored each, and counted each if they are training rows.  An empty table gives no rows; other
    columns are ignored, whatever their names.

    ``most_tokens`` bounds a chunk, ``bucket_tokens`` is about what meets in one range of hashes, ``fan`` bounds the ranges
    that one chunk sends to; none of them changes the result.
    """
    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "UTF-8").alias("text"), F.coalesce(learn, F.lit(False)).alias("train"))
    # Ranges follow the corpus: about as many tokens meet in one whatever its size.
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(12, int(size / 6 // bucket_tokens))
    levels = 1
    while fan**levels < ranges:
        levels += 1
    fans = [fan] * (levels - 1) + [-(-ranges // fan ** (levels - 1))]

    def remember(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for n, (ids, train, ds) in enumerate(chunks(batches, most_tokens)):
            sizes = np.array([len(d) for d in ds], dtype=np.int64)
            words, at = np.unique(np.concatenate([x for d in ds for x in (np.array([START]), d)]), return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([task + n]), pa.array([ids], type=pa.list_(pa.int64())), pa.array([train.tolist()], type=pa.list_(pa.bool_())), pa.array([sizes.tolist()], type=pa.list_(pa.int32())), pa.array([pack(at.astype(np.uint32))], type=pa.binary()), pa.array([pack_sorted(words)], type=pa.binary())],
                names=["chunk", "ids", "train", "sizes", "at", "words"],
            )

    # Both sides are bucketed by chunk, so that neither is shuffled when they meet, twice (fewer buckets than shuffle
    # partitions and Spark would move them).  A chunk's number is its task's and its place there.
    buckets = min(MOST_BUCKETS, max(-(-int(size) // (6 * most_tokens)), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    tok = common.bucketed(src.mapInArrow(remember, "chunk long, ids array<long>, train array<boolean>, sizes array<int>, at binary, words binary"), "lm_tok", buckets, "chunk")
    n_chunks = tok.select("chunk").count()

    def own(t: pa.RecordBatch, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of a chunk: which places teach, sizes, words, places' words, and the chunk's own counts of the words."""
        train, sizes = np.array(t.column("train")[r].as_py()), np.array(t.column("sizes")[r].as_py(), dtype=np.int64)
        at, words = unpack(t.column("at")[r].as_py(), np.uint32), unpack_sorted(t.column("words")[r].as_py())
        taught = np.repeat(train, sizes + 1)
        return taught, sizes, words, at, np.bincount(at, weights=taught, minlength=len(words)).astype(np.uint64)

    def grams(t: pa.RecordBatch, r: int, c1: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Bigrams and trigrams of a chunk: kind, hashes, places among them, own counts, and which of them others may have.
        Where a word occurs nowhere else, all that holds it is the chunk's alone, and its own count is the corpus's."""
        taught, sizes, words, at, n = own(t, r)
        _, i = layout(sizes)
        pairs, in_pairs, triples, in_triples = grams_of(words, at, sizes, i)
        alone = (c1 == n)[at]
        two = alone[i] | alone[i - 1]
        before = np.concatenate(([False], two[:-1]))
        before[np.concatenate(([0], np.cumsum(sizes)[:-1]))] = False
        out = []
        for kind, h, place, here in ((PAIR, pairs, in_pairs, two), (TRIPLE, triples, in_triples, two | before)):
            out.append((kind, h, place, np.bincount(place, weights=taught[i], minlength=len(h)).astype(np.uint64), np.bincount(place, weights=~here, minlength=len(h)) > 0))
        return out

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for r in range(t.num_rows):
                _, _, words, _, n = own(t, r)
                yield _batch(questions(t.column("chunk")[r].as_py(), WORD, words, n, 0, 1, fans[0]))

    def ask_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for r in range(t.num_rows):
                out = []
                for kind, h, _, n, shared in grams(t, r, _joined(t, r, WORD)):
                    out += questions(t.column("chunk")[r].as_py(), kind, h[shared], n[shared], 0, 1, fans[0])
                if out:
                    yield _batch(out)

    def answered(asked: DataFrame, tag: str) -> DataFrame:
        back = corpus_counts(asked, n_chunks, fans).groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("kind", "part", "n"))).alias("answers"))
        return common.bucketed(back, tag, buckets, "chunk")

    ask_schema = "chunk long, kind int, part long, h binary, n binary"
    of_words = answered(tok.select("chunk", "train", "sizes", "at", "words").mapInArrow(ask_words, ask_schema), "lm_words")
    sums = np.zeros(2, dtype=np.uint64)
    for row in of_words.where("chunk = -1").select(F.explode("answers.n").alias("n")).collect():  # one row a task that counted words
        sums += unpack(row.n, np.uint64)
    n_tokens, n_kinds = (int(x) for x in sums)
    uniform = 1.0 / (n_kinds + 1)
    known = tok.join(of_words, "chunk").select("chunk", "ids", "train", "sizes", "at", "words", F.col("answers.kind").alias("kind"), F.col("answers.n").alias("n"))
    of_grams = answered(known.mapInArrow(ask_grams, ask_schema), "lm_grams")
    # A chunk that shares nothing has asked nothing.
    more = of_grams.select("chunk", F.col("answers.kind").alias("kind2"), F.col("answers.n").alias("n2"))
    ready = known.join(more, "chunk", "left")

    def counts(t: pa.RecordBatch, r: int) -> tuple[list, np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
        """Ids, sizes, and of each token: whether it was learned; the counts of its trigram, the pair before it, its
        bigram, the word before it and itself."""
        c1, got = _joined(t, r, WORD), {}
        for kind, _, place, n, shared in grams(t, r, c1):
            answers = _joined(t, r, kind, "2")
            if len(answers) != shared.sum():
                raise RuntimeError("the answers to a chunk don't fit its questions")
            n[shared] = answers
            got[kind] = n.astype(np.float64)[place]
        ids, train, sizes = t.column("ids")[r].as_py(), np.array(t.column("train")[r].as_py()), np.array(t.column("sizes")[r].as_py(), dtype=np.int64)
        at, c1 = unpack(t.column("at")[r].as_py(), np.uint32), c1.astype(np.float64)
        _, i = layout(sizes)
        two, cv = got[PAIR], c1[at[i - 1]]
        cuv = np.concatenate(([0.0], two[:-1]))
        first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        cuv[first] = cv[first]  # nothing but starts is before a text's first word
        return ids, sizes, np.repeat(train, sizes), (got[TRIPLE], cuv, two, cv, c1[at[i]])

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, ns = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for t in batches:
            for r in range(t.num_rows):
                _, _, k, c = counts(t, r)
                c3, cuv, c2, cv, cw = (x[k] - 1 for x in c)  # the token itself is deleted from what predicts it
                cell = context_bucket(cuv, cv)
                for f, steps in ((c3 / np.maximum(cuv, 1), STEPS), (c2 / np.maximum(cv, 1), STEPS), (cw / max(n_tokens - 1, 1), 1)):
                    cell = cell * RANGE + bins(f, steps)
                new, n = np.unique(cell, return_counts=True)
                cells, place = np.unique(np.concatenate((cells, new)), return_inverse=True)
                ns = np.bincount(place, weights=np.concatenate((ns, n)), minlength=len(cells)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(ns)], names=["cell", "n"])

    hist = np.zeros(BUCKETS * RANGE**3, dtype=np.int64)
    for row in ready.mapInArrow(histogram, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # the cells are fixed in number
        hist[row.cell] = row.n
    weights = learn_weights(hist.reshape(BUCKETS, RANGE, RANGE, RANGE), uniform)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for r in range(t.num_rows):
                ids, sizes, _, (c3, cuv, c2, cv, cw) = counts(t, r)
                w = mixture(weights, cuv, cv)
                p = w[:, 0] * c3 / np.maximum(cuv, 1) + w[:, 1] * c2 / np.maximum(cv, 1) + w[:, 2] * cw / max(n_tokens, 1) + w[:, 3] * uniform
                base = np.log10((cw + 0.1) / (n_tokens + 0.1 * (n_kinds + 1)))
                first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, type=pa.int64()), pa.array(sizes), pa.array(np.add.reduceat((cw > 0).astype(np.int64), first)), pa.array(np.full(len(ids), n_tokens)), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(np.log10(p if n_tokens else np.ones(len(p))), first))],
                    names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return ready.mapInArrow(judge, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, learned from those whose crc32(doc_id as text) mod 10 is not 0 (a null doc_id: not learned from);
    null texts, repeats and an empty table as in :func:`score`."""
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10
    scored = score(common.table(spark, sf_dir, "documents"), rest != 0)
    return scored.select("doc_id", F.coalesce(rest == 0, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
