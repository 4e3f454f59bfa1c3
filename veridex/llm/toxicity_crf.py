"""Toxic spans by a linear-chain conditional random field with two labels.

Only documents are labelled, so tokens are labelled first: a word of a toxic document is toxic if it, or one of
its first or last letters' features, occurs in significantly more toxic than clean documents of the sample, and
much less often in clean ones. The field is trained on these labelled tokens. Forward-backward marginals of whole
texts give the offending offsets; their expected number and their noisy-or, calibrated on the sample's document
labels, give the score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridex.llm.common import Words, kept_rows, lists, mapped, mix, ship, shingles, slices

#: At most so many labelled documents of each class are read for training, those of the least md5(doc_id).
SAMPLE_TOXIC, SAMPLE_CLEAN = 2000, 3000
#: Of these, in the same order, as many as hold so many bytes together; what a driver needs is in proportion.
SAMPLE_BYTES = 8 << 20
#: Sentences end at these bytes; longer runs are cut into sequences of CHAIN words.
_END = np.isin(np.arange(256), [ord(c) for c in ".!?\n"])
CHAIN = 128
BUCKETS = 1 << 20
#: The word itself, its first bytes (so many), and its last four.
PREFIXES = (4, 5, 6, 7, 9)
TEMPLATES = len(PREFIXES) + 2
EPOCHS, RATE, BATCH_WORDS, CLEAN_CHAINS = 3, 0.5, 60_000, 120_000
#: Times that a feature must be more frequent in toxic than in clean documents to mark a word.
LEAST_RATIO = 6
SPAN_CHANCE, LEAST_CHANCE = 0.5, 0.25
MADE = ["toxicity", "toxic_words", "toxic_spans"]


class Sequences(Words):
    """Words with their features and the chains they form."""

    def __init__(self, column: pa.Array):
        super().__init__(column)
        s, e = self.start, self.end
        n = e - s
        lead = self.data & 0xC0 != 0x80 if len(self.data) else np.zeros(0, bool)
        self.points = np.concatenate([[0], np.cumsum(lead)])  # code points before each byte
        feats = np.empty((TEMPLATES, len(s)), np.uint64)
        feats[0] = self.hash
        for k, m in enumerate(PREFIXES, 1):
            feats[k] = self.span(s, s + np.minimum(n, m))
        feats[-1] = self.span(e - np.minimum(n, 4), e)
        salt = mix(np.arange(1, TEMPLATES + 1, dtype=np.uint64))
        self.feats = feats
        self.slots = (mix(feats ^ salt[:, None]) & np.uint64(BUCKETS - 1)).astype(np.int32)
        ends = np.concatenate([[0], np.cumsum(_END[self.data])])
        new = np.zeros(len(s) + 1, bool)
        new[self.first] = True
        if len(s) > 1:
            new[1:-1] |= ends[s[1:]] > ends[e[:-1]]
        heads = np.flatnonzero(new)
        size = np.diff(heads)
        if len(size) and size.max() > CHAIN:
            cut = [h + np.arange(CHAIN, k, CHAIN) for h, k in zip(heads[:-1][size > CHAIN].tolist(), size[size > CHAIN].tolist())]
            heads = np.sort(np.concatenate([heads, *cut]))
        self.heads = heads  # of chains, and the total


@dataclass
class Field:
    weights: np.ndarray  # emission score of label 1 over label 0, by feature slot
    bias: float
    moves: np.ndarray  # transition scores, 2 x 2
    scale: np.ndarray  # of the document score

    def odds(self, x: Sequences | Sample) -> np.ndarray:
        e = np.full(x.slots.shape[1], self.bias)
        for s in x.slots:
            e += self.weights[s]
        return np.exp(np.clip(e, -30, 30))


def _walk(heads: np.ndarray):
    """For each place within a chain: the positions of the words there, longest chains first."""
    size = np.diff(heads)
    order = np.argsort(-size, kind="stable")
    size, start = size[order], heads[:-1][order]
    for t in range(int(size[0]) if len(size) else 0):
        yield start[: np.searchsorted(-size, -t, side="left")] + t


def forward_backward(odds: np.ndarray, heads: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward odds (with the word's own emission) and backward odds of label 1 for every word."""
    (m00, m01), (m10, m11) = np.exp(moves)
    r, q = odds.copy(), np.ones(len(odds))
    steps = list(_walk(heads))
    for at in steps[1:]:
        prev = r[at - 1]
        r[at] = np.clip(odds[at] * (m01 + prev * m11) / (m00 + prev * m10), 1e-30, 1e30)
    for at in steps[:0:-1]:
        ahead = odds[at] * q[at]
        q[at - 1] = (m10 + m11 * ahead) / (m00 + m01 * ahead)
    return r, q


def marginals(f: Field, x: Sequences | Sample) -> np.ndarray:
    r, q = forward_backward(f.odds(x), x.heads, f.moves)
    return r * q / (1 + r * q)


class Sample:
    """The sequences of many texts, made slice by slice; `feats` goes once tokens are labelled."""

    def __init__(self, column: pa.Array, bands: int = 4, rows: int = 2):
        rng = np.random.default_rng(11)
        factors = rng.integers(0, 1 << 63, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        feats, slots, heads, counts, marks = [], [], [np.zeros(1, np.int64)], [], []
        for b in slices(iter([pa.RecordBatch.from_arrays([column], names=["text"])]), "text"):
            x = Sequences(b.column("text"))
            feats.append(x.feats)
            slots.append(x.slots)
            heads.append(x.heads[1:] + heads[-1][-1])
            counts.append(x.counts)
            h, n = shingles(x)
            starts = np.cumsum(n) - n
            marks.append(np.stack([np.bitwise_xor.reduce([mix(np.minimum.reduceat(h * f, starts) + np.uint64(j)) for j, f in enumerate(band)]) for band in factors]))
        self.feats, self.slots = np.concatenate(feats, axis=1), np.concatenate(slots, axis=1)
        self.heads, self.counts = np.concatenate(heads), np.concatenate(counts)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.group = _grouped(np.concatenate(marks, axis=1))


def _grouped(marks: np.ndarray) -> np.ndarray:
    """A group for each column; columns with an equal mark in one of the rows share it."""
    root = np.arange(marks.shape[1])
    for band in marks:
        order = np.argsort(band, kind="stable")
        same = band[order[1:]] == band[order[:-1]]
        for a, b in zip(order[:-1][same].tolist(), order[1:][same].tolist()):
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            root[max(a, b)] = min(a, b)
    while (root[root] != root).any():
        root = root[root]
    return root


def token_labels(x: Sample, toxic: np.ndarray) -> np.ndarray:
    """Label 1 for words of toxic documents with a feature that marks toxic documents significantly.

    Near copies (x.group) count as one document, else each of its words would mark its kind.
    """
    own = np.repeat(np.arange(len(toxic)), x.counts)
    doc = x.group[own]
    n1, n0 = max(1, toxic.sum()), max(1, (~toxic).sum())
    out = np.zeros(len(doc), bool)
    for f in x.feats:
        order = np.lexsort((doc, f))
        g, d = f[order], doc[order]
        fresh = np.ones(len(g), bool)
        fresh[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
        g, d = g[fresh], d[fresh]
        names, at = np.unique(g, return_inverse=True)
        df1 = np.bincount(at, toxic[d], len(names))
        df0 = np.bincount(at, ~toxic[d], len(names))
        share = n1 / (n1 + n0)
        all_ = df1 + df0
        gain = df1 * np.log(np.maximum(df1, 1e-9) / (all_ * share)) + df0 * np.log(np.maximum(df0, 1e-9) / (all_ * (1 - share)))  # log likelihood ratio
        marks = names[(gain >= 14) & (df1 / n1 >= LEAST_RATIO * df0 / n0)]
        out |= np.isin(f, marks)
    return out & toxic[own]


def trained(x: Sample, y: np.ndarray, seed: int = 7) -> Field:
    """Minimise the negative log likelihood of the labelled tokens by AdaGrad over batches of chains."""
    rng = np.random.default_rng(seed)
    f = Field(np.zeros(BUCKETS, np.float64), -4.0, np.zeros((2, 2)), np.zeros(3))
    size = np.diff(x.heads)
    has = np.add.reduceat(y, x.heads[:-1]) > 0 if len(size) else np.zeros(0, bool)
    has &= size > 0
    rest = np.flatnonzero(~has & (size > 0))
    grown, grown_m, grown_b = np.ones(BUCKETS), np.ones((2, 2)), 1.0
    for _ in range(EPOCHS):
        chains = np.concatenate([np.flatnonzero(has), rng.permutation(rest)[:CLEAN_CHAINS]])
        chains = rng.permutation(chains)
        cuts = np.flatnonzero(np.diff(np.cumsum(size[chains]) // BATCH_WORDS)) + 1
        for part in np.split(chains, cuts):
            if not len(part):
                continue
            k = size[part]
            heads = np.concatenate([[0], np.cumsum(k)])
            at = np.arange(heads[-1]) - np.repeat(heads[:-1], k) + np.repeat(x.heads[part], k)
            slots, gold = x.slots[:, at], y[at]
            e = np.exp(np.clip(f.weights[slots].sum(axis=0) + f.bias, -30, 30))
            r, q = forward_backward(e, heads, f.moves)
            p = r * q / (1 + r * q)
            g = p - gold
            grad = np.bincount(slots.ravel(), np.tile(g, TEMPLATES), BUCKETS) + 1e-4 * f.weights
            inner = np.ones(len(at), bool)
            inner[heads[1:] - 1] = False
            i = np.flatnonzero(inner)
            ahead = e[i + 1] * q[i + 1]
            m = np.exp(f.moves)
            joint = np.stack([np.full(len(i), m[0, 0]), m[0, 1] * ahead, m[1, 0] * r[i], m[1, 1] * r[i] * ahead])
            joint /= joint.sum(axis=0)
            seen = np.bincount(gold[i] * 2 + gold[i + 1], minlength=4)
            grad_m = (joint.sum(axis=1) - seen).reshape(2, 2)
            grown += grad**2
            grown_m += grad_m**2
            grown_b += g.sum() ** 2
            f.weights -= RATE * grad / np.sqrt(grown)
            f.moves -= 0.1 * RATE * grad_m / np.sqrt(grown_m)
            f.bias -= RATE * g.sum() / np.sqrt(grown_b)
    f.weights = f.weights.astype(np.float32)
    return f


def _evidence(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each document: log of one plus the expected number of toxic words, and their noisy-or.

    Words under LEAST_CHANCE are left out, else their sum would grow with the length of clean texts.
    """
    p = np.where(p >= LEAST_CHANCE, p, 0.0)
    sums = np.concatenate([[0], np.cumsum(p)])
    none = np.concatenate([[0], np.cumsum(np.log1p(-np.minimum(p, 1 - 1e-12)))])
    return np.stack([np.ones(len(first) - 1), np.log1p(np.maximum(0, sums[first[1:]] - sums[first[:-1]])), 1 - np.exp(np.minimum(0, none[first[1:]] - none[first[:-1]]))], axis=1)


def _calibrated(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge."""
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(w))
        w += np.linalg.solve(h, z.T @ (y - p) - 1e-2 * w)
    return w


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _fitting(sizes: list[tuple], most: int) -> list:
    """Ids of the texts that fit, in the given order, into `most` bytes together; longer ones are passed over.

    If none fits, the shortest is taken, so that a kind of label is never lost.
    """
    out, left = [], most
    for doc_id, size in sizes:
        if size <= left:
            out.append(doc_id)
            left -= size
    return out or [i for i, _ in sorted(sizes, key=lambda r: r[1])[:1]]


def fitted(docs: DataFrame, labels: DataFrame) -> Field | None:
    """The field learned from labelled rows outside the held-out fold; None without labelled texts of both kinds.

    The sample is bounded by SAMPLE_TOXIC, SAMPLE_CLEAN and SAMPLE_BYTES, which the kinds share as they share rows.
    Of several labels for one document the highest counts, of several texts the shortest. Rows without doc_id or
    label teach nothing.
    """
    some = labels.filter("doc_id is not null and toxic is not null").filter(~held_out()).groupBy("doc_id").agg((F.max("toxic") > 0).alias("_toxic"))
    order = (F.md5(F.col("doc_id").cast("string").cast("binary")), F.col("doc_id"))
    pick = lambda kind, n: some.filter(F.col("_toxic") == kind).orderBy(*order).limit(n)
    chosen = F.broadcast(pick(True, SAMPLE_TOXIC).unionAll(pick(False, SAMPLE_CLEAN)))
    text = F.coalesce("text", F.lit(""))
    sizes = docs.select("doc_id", F.octet_length(text).alias("n")).join(chosen, "doc_id").groupBy("doc_id", "_toxic").agg(F.min("n")).orderBy(*order).collect()
    toxic_bytes = SAMPLE_BYTES * SAMPLE_TOXIC // (SAMPLE_TOXIC + SAMPLE_CLEAN)
    ids = [(i, y) for y, most in ((True, toxic_bytes), (False, SAMPLE_BYTES - toxic_bytes)) for i in _fitting([(r[0], r[2]) for r in sizes if r[1] == y], most)]
    if len({y for _, y in ids}) < 2:
        return None
    kept = F.broadcast(docs.sparkSession.createDataFrame(ids, T.StructType([docs.schema["doc_id"], T.StructField("_toxic", T.BooleanType())])))
    least = F.min(F.struct(F.octet_length("text").alias("n"), "text"))
    rows = docs.select("doc_id", text.alias("text")).join(kept, "doc_id").groupBy("doc_id", "_toxic").agg(least.alias("t")).select("doc_id", "_toxic", "t.text").toArrow()
    order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")  # the same model however rows arrive
    toxic = np.asarray(rows.column("_toxic").to_numpy(), bool)[order]
    x = Sample(rows.column("text").combine_chunks().take(pa.array(order)))
    y = token_labels(x, toxic).astype(np.int64)
    x.feats = None
    f = trained(x, y)
    f.scale = _calibrated(_evidence(marginals(f, x), x.first), toxic.astype(float))
    return f


def scored(docs: DataFrame, field: Field | None) -> DataFrame:
    """docs with toxicity (0 to 1), toxic_words (expected number) and toxic_spans (start, length in code points).

    Null and empty texts get the score of a text without words. Without a field all scores are 0.
    """
    spark = docs.sparkSession
    ship(spark)
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType())])
    extra = T.StructType([T.StructField(n, k) for n, k in zip(MADE, (T.DoubleType(), T.DoubleType(), T.ArrayType(span)))])
    if field is None:
        return docs.drop(*MADE).select("*", *[F.lit(0.0).alias(n) for n in MADE[:2]], F.array().cast(extra[2].dataType).alias(MADE[2]))
    shared = spark.sparkContext.broadcast(field)

    def fn(b):
        f = shared.value
        x = Sequences(b.column("text"))
        p = marginals(f, x)
        z = _evidence(p, x.first)
        hit = np.flatnonzero(p >= SPAN_CHANCE)
        start, end = x.points[x.start[hit]], x.points[x.end[hit]]
        doc = np.searchsorted(x.first, hit, side="right") - 1
        base = x.points[x.off[doc]]
        spans = pa.StructArray.from_arrays([pa.array((start - base).astype(np.int32)), pa.array((end - start).astype(np.int32))], names=["start", "length"])
        return [pa.array(1 / (1 + np.exp(-np.clip(z @ f.scale, -30, 30)))), pa.array(np.expm1(z[:, 1])), lists(spans, np.bincount(doc, minlength=b.num_rows))]

    return mapped(docs, fn, extra, "text")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs whose score is under 0.5; all columns stay as they are, also those named like a score's."""
    field = fitted(docs, labels)
    if field is None:
        return docs
    return kept_rows(docs, lambda d: scored(d, field), "toxicity < 0.5", MADE)
