"""Quality rules with n-gram perplexity: a modified Kneser-Ney model of word pairs, counted over all documents.

Words are runs without white space; every language has its own contexts, vocabulary and discounts. All counts are
kept in sorted arrays of hashes, and so is everything that is shuffled:

1. Documents are read once and packed into blocks of some two million words (the words' hashes, sorted, and each
   word as its rank by frequency), which are written as a table bucketed by block.
2. A block sends its distinct pairs, sorted by hash and cut into ranges, with their counts. Whoever gets a range of
   all blocks sums it and answers every block with the total of each of its pairs, in the same order, so that no
   hash travels back. A pair is in a block once, however often it occurs: frequent pairs make no hot range.
3. With the totals, blocks send for each word how often and before how many words it stands, and after how many, each
   distinct pair being counted by one block only; the answers come in the same way.
4. A block then has all it needs to score its documents, each without itself and its exact copies: what they added
   to the counts is taken off again, so that neither long nor copied texts are known by heart. Discounts come from
   counts of counts by language.

What is sent grows with the corpus; nothing of it goes to the driver but 10 sums for each of at most 65,536 languages.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StringType, StructField, StructType

from veridex.llm.common import Words, fresh_path, lists, mix, partitions, removed, ship, slices, written

BLOCK_WORDS = 1 << 21
#: Words that are scored at a time.
STEP_WORDS = 1 << 17
#: Bytes of text for each range of hashes, of which one task holds what all blocks have.
RANGE_BYTES = 24 << 20
WINDOW = 5
LEAST_WORDS, MOST_REPEATED = 10, 20
#: Bands: quartiles of bits a word by language, widened by WIDTH quartile distances and at least so many bits below and above.
#: Near copies of a text make it predictable, which is no fault of its quality: only what is far below is rejected.
WIDTH, LEAST_BELOW, LEAST_ABOVE = 3.0, 8.0, 1.0
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

_ODD = np.uint64(0x9E3779B97F4A7C15)
_START = np.uint64(0xD1B54A32D192ED03)
_INSIDE = np.array([b not in b" \t\n\x0b\x0c\r" for b in range(256)])
_SYMBOL = np.array([chr(b) in "#*$%&|<>" for b in range(256)])


# --- sorted hash arrays ------------------------------------------------------------------------


def shrunk(values: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes: the planes that small numbers leave empty cost nothing."""
    v = np.ascontiguousarray(values, dtype="<u8")
    return len(v).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def grown(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = pa.decompress(data[8:], decompressed_size=8 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, n).T).view("<u8").reshape(n).astype(np.uint64)


def shrunk_sorted(keys: np.ndarray) -> bytes:
    return shrunk(np.diff(keys, prepend=np.uint64(0)))


def grown_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(grown(data), dtype=np.uint64)


def _bounds(bits: int, ranges: int) -> np.ndarray:
    """The least hash of each of so many even ranges of hashes of so many bits."""
    return np.array([-(-(k << bits) // ranges) for k in range(ranges)], np.uint64)


def _pieces(keys: np.ndarray, bits: int, ranges: int) -> Iterator[tuple[int, slice]]:
    """The ranges that sorted keys fall into, and the part of them in each."""
    cuts = np.append(np.searchsorted(keys, _bounds(bits, ranges)), len(keys)).tolist()
    return ((r, slice(cuts[r], cuts[r + 1])) for r in range(ranges) if cuts[r] < cuts[r + 1])


# --- rules -------------------------------------------------------------------------------------


def _twice(owner: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """How many equal hashes the same owner has, for each."""
    with np.errstate(over="ignore"):
        _, at, n = np.unique(mix(hashes + owner.astype(np.uint64) * _ODD), return_inverse=True, return_counts=True)
    return n[at]


def rules(w: Words) -> np.ndarray:
    """FEATURES of each text, a row each."""
    n, docs = w.counts, len(w.counts)
    upto = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    of = lambda mask: upto(mask)[w.off[1:]] - upto(mask)[w.off[:-1]]
    chars = of(w.is_word & ((w.data & 0xC0) != 0x80))
    # a line runs from its text's begin, or from after a line feed, to the next line feed or its text's end
    feed = np.flatnonzero(w.data == 10)
    have = 1 + np.bincount(np.searchsorted(w.off, feed, side="right") - 1, minlength=docs)
    owner, last = np.repeat(np.arange(docs), have), np.cumsum(have) - 1
    start, end = np.empty(len(owner), np.int64), np.empty(len(owner), np.int64)
    opens, closes = np.zeros(len(owner), bool), np.zeros(len(owner), bool)
    opens[last - have + 1] = closes[last] = True
    start[opens], start[~opens], end[closes], end[~closes] = w.off[:-1], feed + 1, w.off[1:], feed
    inside = upto(w.is_word)
    some = inside[end] > inside[start]
    start, end, owner = start[some], end[some], owner[some]
    with np.errstate(over="ignore"):
        _, first = np.unique(mix(w.span(start, end) + owner.astype(np.uint64) * _ODD), return_index=True)
    lines = np.bincount(owner, minlength=docs) - np.bincount(owner[first], minlength=docs)
    # windows of five words
    doc = np.repeat(np.arange(docs), n)
    total = len(w.hash)
    covered = np.zeros(total + WINDOW + 1, np.int64)
    if total >= WINDOW:
        run = np.zeros(total - WINDOW + 1, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(WINDOW):
                run = run * _START + w.hash[j : total - WINDOW + 1 + j]
        at = np.flatnonzero(doc[: total - WINDOW + 1] == doc[WINDOW - 1 :])
        at = at[_twice(doc[at], run[at]) > 1]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + WINDOW, -1)
    repeated = np.bincount(doc, weights=np.cumsum(covered)[:total] > 0, minlength=docs)
    return np.stack([n, chars, of(_SYMBOL[w.data]), lines, repeated], axis=1).astype(np.int64)


# --- blocks ------------------------------------------------------------------------------------


def _seeded(hashes: np.ndarray, slots: np.ndarray, bits: int) -> np.ndarray:
    """Keys of words of so many bits, apart for every language."""
    with np.errstate(over="ignore"):
        return mix(hashes + slots.astype(np.uint64) * _START) >> np.uint64(64 - bits)


def _packed(docs: DataFrame, word_bits: int, block_words: int) -> DataFrame:
    """Blocks of documents: their ids, languages and rules, and their words as ranks in sorted keys.

    Each text begins with a mark of its language, which is a word of the block.
    """
    id_type = docs.schema["doc_id"].dataType
    schema = StructType([
        StructField("block", LongType()), StructField("ids", ArrayType(id_type)), StructField("langs", ArrayType(StringType())), StructField("rules", ArrayType(LongType())),
        *[StructField(c, BinaryType()) for c in ("keys", "counts", "slots", "order", "texts")],
    ])

    def row(block: int, parts: list) -> pa.RecordBatch:
        ids, langs, found, keys, slots, texts = zip(*parts)
        n = sum(map(len, ids))
        keys, slots, found = np.concatenate(keys), np.concatenate(slots), np.concatenate(found)
        vocabulary, first, at, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        rank = np.empty(len(counts), np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
        one = np.array([n])
        columns = [
            pa.array([block]), lists(pa.concat_arrays(ids), one), lists(pa.concat_arrays(langs), one), lists(pa.array(found.ravel()), np.array([found.size])),
            *[pa.array([x], pa.binary()) for x in (shrunk_sorted(vocabulary), shrunk(counts), shrunk(slots[first]), shrunk(rank[at]), np.concatenate(texts).astype("<u8").tobytes())],
        ]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, have = TaskContext.get().partitionId() << 32, [], 0
        for b in slices(batches, "text"):
            w = Words(b.column("text"), lower=False, inside=_INSIDE)
            langs = pc.fill_null(b.column("lang"), "")
            slot = np.array([zlib.crc32(x.encode()) % 65536 for x in langs.to_pylist()], np.int64)
            of = np.repeat(slot, w.counts)
            keys = np.insert(_seeded(w.hash, of, word_bits), w.first[:-1], _seeded(np.full(len(slot), _ODD), slot, word_bits))
            whole = _seeded(w.span(w.off[:-1], w.off[1:]), slot, 64)
            parts.append((b.column("doc_id"), langs, rules(w), keys, np.insert(of, w.first[:-1], slot).astype(np.uint16), whole))
            have += len(keys)
            if have >= block_words:
                yield row(block, parts)
                block, parts, have = block + 1, [], 0
        if parts:
            yield row(block, parts)

    return docs.mapInArrow(run, schema)


class Block:
    """A block taken apart: its words, and the pairs of each word with the one before it.

    keys, slots: of distinct words. before, word: places in keys of each pair in the order of the texts. counted:
    sorted distinct hashes of pairs and of whole texts, and first their first occurrences; at, text: the place in
    them of each pair and of each text.
    """

    def __init__(self, row: dict, bits: int):
        self.id, self.ids, self.langs = row["block"], row["ids"], row["langs"]
        self.rules = np.array(row["rules"], np.int64).reshape(len(self.ids), len(FEATURES))
        self.keys, self.slots = grown_sorted(row["keys"]), grown(row["slots"]).astype(np.int64)
        words = np.argsort(-grown(row["counts"]).astype(np.int64), kind="stable")[grown(row["order"]).astype(np.int64)]
        n = self.rules[:, 0]
        inner = np.ones(len(words), bool)
        inner[np.cumsum(n + 1) - n - 1] = False  # the marks
        words = words.astype(np.int32)
        self.word, self.before = words[inner], words[:-1][inner[1:]]
        with np.errstate(over="ignore"):
            pair = mix(self.keys[self.before] * _ODD + self.keys[self.word]) >> np.uint64(64 - bits)
        texts = np.frombuffer(row["texts"], "<u8").astype(np.uint64) >> np.uint64(64 - bits)
        self.counted, self.first, at = np.unique(np.concatenate([pair, texts]), return_index=True, return_inverse=True)
        at = at.astype(np.int32)
        self.at, self.text = at[: len(pair)], at[len(pair) :]


def _messages(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (range, block, keys, a, b) on their way to the ranges."""
    columns = list(zip(*rows)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), *[pa.array(c, pa.binary()) for c in columns[2:]]], names=["range", "block", "keys", "a", "b"])


MESSAGE = "range int, block bigint, keys binary, a binary, b binary"
ANSWER = "kind int, range int, block bigint, a binary, b binary, slot int, sums array<bigint>"


def _answers(kind: int, table: pa.Table, parts: list[tuple[bytes, bytes]], sums: dict[int, list[int]]) -> pa.Table:
    n = len(parts)
    return pa.table({
        "kind": pa.array([kind] * (n + len(sums)), pa.int32()), "range": pa.array(table["range"].to_pylist() + [None] * len(sums), pa.int32()), "block": pa.array(table["block"].to_pylist() + [None] * len(sums), pa.int64()),
        "a": pa.array([p[0] for p in parts] + [None] * len(sums), pa.binary()), "b": pa.array([p[1] for p in parts] + [None] * len(sums), pa.binary()),
        "slot": pa.array([None] * n + list(sums), pa.int32()), "sums": pa.array([None] * n + list(sums.values()), pa.list_(pa.int64())),
    })


def _joined(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Of a range's messages: each one's keys, and over all of them the distinct keys, their first place and every key's place among them."""
    keys = [grown_sorted(k) for k in table["keys"].to_pylist()]
    distinct, first, at = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    return keys, distinct, first, at


def _pair_totals(table: pa.Table) -> pa.Table:
    """For each block the totals of its pairs, and which of them it is to count as distinct."""
    keys, distinct, first, at = _joined(table)
    total = np.bincount(at, weights=np.concatenate([grown(a) for a in table["a"].to_pylist()]).astype(np.float64), minlength=len(distinct)).astype(np.int64)
    mine = np.zeros(len(at), np.int64)
    mine[first] = 1
    ends = np.cumsum([len(k) for k in keys])
    return _answers(0, table, [(shrunk(total[at[e - len(k) : e]]), shrunk(mine[e - len(k) : e])) for k, e in zip(keys, ends)], {})


#: Of a word: occurrences before a word; distinct pairs that it begins and that occur 1, 2, 3, 4 and more times; distinct words before it.
STATS = 7


def _word_totals(table: pa.Table) -> pa.Table:
    """For each block the totals of its words; and for each language its counts of counts of pairs and words, continuations and vocabulary."""
    keys, distinct, first, at = _joined(table)
    stats = np.concatenate([grown(a).astype(np.int64).reshape(STATS, -1) for a in table["a"].to_pylist()], axis=1)
    slot = np.concatenate([grown(b) for b in table["b"].to_pylist()]).astype(np.int64)[first]
    total = np.stack([np.bincount(at, weights=s, minlength=len(distinct)) for s in stats]).astype(np.int64)
    sums = {}
    for x in np.unique(slot).tolist():
        t = total[:, slot == x]
        sums[x] = [*t[1:5].sum(axis=1).tolist(), *[int((t[6] == k).sum()) for k in (1, 2, 3, 4)], int(t[6].sum()), int((t[6] > 0).sum())]
    total = np.stack([total[0], total[1], total[2], total[3:6].sum(axis=0), total[6]])
    ends = np.cumsum([len(k) for k in keys])
    return _answers(1, table, [(shrunk(total[:, at[e - len(k) : e]].ravel()), b"") for k, e in zip(keys, ends)], sums)


def _told(table: pa.Table, kind: int, column: str, rows: int = 1) -> np.ndarray:
    """A block's answers in the order of the ranges: (rows, keys)."""
    got = sorted((r["range"], r[column]) for r in table.select(["kind", "range", column]).to_pylist() if r["kind"] == kind)
    return np.concatenate([grown(x).astype(np.int64).reshape(rows, -1) for _, x in got], axis=1) if got else np.zeros((rows, 0), np.int64)


# --- the model ---------------------------------------------------------------------------------


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney: what is taken from counts of 1, 2, and 3 or more; 0.5, 1 and 1.5 where a count of counts is 0."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.05), k) for k, d in zip((1, 2, 3), (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)))


def _taken(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The discount of each count, given those of its language: (n, 3)."""
    k = np.minimum(counts, 3) - 1
    return np.where(counts > 0, np.take_along_axis(d, np.maximum(k, 0)[:, None], axis=1)[:, 0], 0.0)


def _within(docs: np.ndarray, things: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, thing): first place, each one's place among them, and how often."""
    _, first, at, n = np.unique(docs.astype(np.int64) * (int(things.max(initial=0)) + 1) + things, return_index=True, return_inverse=True, return_counts=True)
    return first, at, n


def bits_of(b: Block, total: np.ndarray, words: np.ndarray, model: dict[int, list[int]]) -> np.ndarray:
    """-log2 of the probability of each word of a block after the word before it, by all texts but its own and copies of it.

    The shares that discounts and the uniform distribution have are those of the whole corpus.
    """
    here, place = np.unique(b.slots, return_inverse=True)
    sums = np.array([model[int(s)] for s in here], np.float64).reshape(len(here), 10)
    high = np.array([discounts(*model[int(s)][:4]) for s in here]).reshape(len(here), 3)[place]
    low = np.array([discounts(*model[int(s)][4:8]) for s in here]).reshape(len(here), 3)
    rest = (low * np.stack([sums[:, 4], sums[:, 5], sums[:, 9] - sums[:, 4] - sums[:, 5]], axis=1)).sum(axis=1) / np.maximum(sums[:, 8], 1)
    continuations, vocabulary, rest, low = sums[place, 8], sums[place, 9], rest[place], low[place]
    ends = np.cumsum(b.rules[:, 0])
    out = np.empty(len(b.word))
    cuts = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(STEP_WORDS, len(b.word), STEP_WORDS), side="right"), [len(ends)]])).tolist()
    for low_doc, high_doc in zip(cuts[:-1], cuts[1:]):  # documents of some hundred thousand words at a time
        s = slice(int(ends[low_doc - 1]) if low_doc else 0, int(ends[high_doc - 1]))
        doc = np.repeat(np.arange(high_doc - low_doc), b.rules[low_doc:high_doc, 0])
        out[s] = _step_bits(b.at[s], b.before[s], b.word[s], doc, total[b.text[low_doc:high_doc]], total, words, (high, low, continuations, vocabulary, rest))
    return out


def _step_bits(pairs: np.ndarray, befores: np.ndarray, followers: np.ndarray, doc: np.ndarray, copies: np.ndarray, total: np.ndarray, words: np.ndarray, shares: tuple) -> np.ndarray:
    high, low, continuations, vocabulary, rest = shares
    before, one, two, more, after = words
    # distinct pairs of each document, what it and its copies add to them, and what is left of them without it
    pair, at, n = _within(doc, pairs)
    u, v, d = befores[pair], followers[pair], doc[pair]
    have = total[pairs[pair]]
    own = n * copies[d]
    left = have - own
    gone = left == 0
    # its contexts
    context, of, _ = _within(d, u)
    off = lambda which: np.bincount(of, weights=which.astype(np.float64), minlength=len(context))
    uc = u[context]
    stands = before[uc] - off(own)
    taken = high[uc, 0] * (one[uc] - off(have == 1) + off(left == 1)) + high[uc, 1] * (two[uc] - off(have == 2) + off(left == 2)) + high[uc, 2] * (more[uc] - off(have > 2) + off(left > 2))
    weight = np.where(stands > 0, np.clip(taken / np.maximum(stands, 1), 1e-4, 1), 1.0)  # hashes that meet could make it 0
    # its words
    follower, at_word, _ = _within(d, v)
    vw = v[follower]
    known = (after[vw] - np.bincount(at_word, weights=gone, minlength=len(follower))).astype(np.int64)
    all_left = np.maximum(continuations[vw] - np.bincount(d, weights=gone, minlength=len(copies))[d[follower]], 1)
    lower = np.maximum(known - _taken(known, low[vw]), 0) / all_left + rest[vw] / np.maximum(vocabulary[vw], 1)
    p = np.where(stands[of] > 0, np.maximum(left - _taken(left, high[u]), 0) / np.maximum(stands[of], 1), 0.0) + weight[of] * lower[at_word]
    return -np.log2(p)[at]


def _bucketed(df: DataFrame, name: str) -> str:
    """Write a table bucketed by block, so that no later step shuffles it."""
    spark = df.sparkSession
    path = fresh_path(spark, "ngram-blocks")
    df.write.bucketBy(partitions(spark), "block").option("path", path).saveAsTable(name)
    return path


def scored(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, lang, FEATURES and bits (mean -log2 probability of a word, null without words) of each row of docs (doc_id, text, lang).

    Perplexity is 2 ** bits. The model is of all rows. Null texts are empty, a null lang is a language of its own
    (the empty one); ids may be null or repeated. The n-grams are pairs of words, with single words and a uniform
    share below them. Tables are written in the shared folder and removed again, but the one that is returned.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits, word_bits = min(62, max(40, size.bit_length() + 10)), min(62, max(44, size.bit_length() + 12))
    ranges = max(partitions(spark), size // RANGE_BYTES)
    tidy = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # a shuffle's files go with the query that made them
    before = spark.conf.get(tidy, None)
    spark.conf.set(tidy, "true")
    name = f"veridex_blocks_{uuid.uuid4().hex}"
    path = _bucketed(_packed(docs, word_bits, block_words), name)
    table = spark.table(name)

    def pairs(batches):
        for batch in batches:
            for r in batch.to_pylist():
                b = Block(r, bits)
                n = np.bincount(np.concatenate([b.at, b.text]), minlength=len(b.counted))
                yield _messages([(k, b.id, shrunk_sorted(b.counted[s]), shrunk(n[s]), b"") for k, s in _pieces(b.counted, bits, ranges)])

    def words(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for r in left.to_pylist():
            b = Block(r, bits)
            mine = (_told(right, 0, "b")[0] > 0) & (b.first < len(b.at))  # pairs, not texts
            n, u, v = np.minimum(_told(right, 0, "a")[0], 5)[mine], b.before[b.first[mine]], b.word[b.first[mine]]
            count = lambda at: np.bincount(at, minlength=len(b.keys))
            stats = np.stack([count(b.before), *[count(u[n == k]) for k in range(1, 6)], count(v)])
            out += [(k, b.id, shrunk_sorted(b.keys[s]), shrunk(stats[:, s].ravel()), shrunk(b.slots[s])) for k, s in _pieces(b.keys, word_bits, ranges)]
        return pa.Table.from_batches([_messages(out)])

    first = written(table.mapInArrow(pairs, MESSAGE).groupBy("range").applyInArrow(_pair_totals, ANSWER), "pair-totals")
    asked = table.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(words, MESSAGE)
    second = written(asked.groupBy("range").applyInArrow(_word_totals, ANSWER), "word-totals")
    by_language = second.filter("block is null").groupBy("slot").agg(F.array(*[F.sum(F.col("sums")[k]) for k in range(10)]).alias("sums"))
    model = {r["slot"]: list(r["sums"]) for r in by_language.collect()}
    id_type = docs.schema["doc_id"].dataType
    schema = StructType([StructField("doc_id", id_type), StructField("lang", StringType()), *[StructField(c, LongType()) for c in FEATURES], StructField("bits", DoubleType())])

    def scores(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for i, r in enumerate(left.to_pylist()):
            b = Block(r, bits)
            each = bits_of(b, _told(right, 0, "a")[0], _told(right, 1, "a", 5), model)
            n = b.rules[:, 0]
            total = np.bincount(np.repeat(np.arange(len(n)), n), weights=each, minlength=len(n))
            ids = left["ids"].combine_chunks().slice(i, 1).flatten()
            out.append(pa.RecordBatch.from_arrays([ids, pa.array(b.langs, pa.string()), *[pa.array(c) for c in b.rules.T], pa.array(total / np.maximum(n, 1), mask=n == 0)], names=schema.names))
        return pa.Table.from_batches(out)

    told = first.unionByName(second.filter("block is not null"))
    done = written(table.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(scores, schema), "ngram-scores")
    for old in (first, second, spark.read.schema(table.schema).parquet(path)):
        removed(spark, old)
    spark.sql(f"DROP TABLE {name}")
    spark.conf.unset(tidy) if before is None else spark.conf.set(tidy, before)
    return done


def judged(scores: DataFrame, width: float = WIDTH, least_below: float = LEAST_BELOW, least_above: float = LEAST_ABOVE) -> DataFrame:
    """scores with base_failed, lower, upper and kept: the rules first, then the band of bits of the row's language.

    A text fails the rules with fewer than ten words, or with more than a fifth of them in repeated runs of five.
    The band reaches from the lower quartile less, to the upper quartile plus, `width` quartile distances, and at
    least the given bits, over the language's texts that pass the rules; bits are rounded to thousandths, so
    quartiles are exact with a bounded number of distinct values. Both ends of the band are kept.
    """
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    slot = F.pmod(F.crc32(F.coalesce("lang", F.lit("")).cast("binary")), F.lit(65536))
    scores = scores.withColumns({"base_failed": failed, "slot": slot, "bits": F.round("bits", 3)})
    q = F.percentile("bits", F.array(F.lit(0.25), F.lit(0.75)))
    bands = scores.filter(~F.col("base_failed")).groupBy("slot").agg(q.alias("q"))
    wide = lambda least: F.greatest((F.col("q")[1] - F.col("q")[0]) * width, F.lit(least))
    bands = bands.select("slot", (F.col("q")[0] - wide(least_below)).alias("lower"), (F.col("q")[1] + wide(least_above)).alias("upper"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("bits").between(F.col("lower"), F.col("upper")), F.lit(False))
    return scores.join(F.broadcast(bands), "slot", "left").withColumn("kept", kept).drop("slot")  # at most 65,536 rows
