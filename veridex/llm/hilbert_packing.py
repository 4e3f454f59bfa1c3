"""Packing along a space-filling curve: neighbours in content share training sequences.

Each document's token ids are hashed to signed directions and averaged, which projects its hashed bag of tokens
to DIMS dimensions; the cell of that point on a Hilbert curve is its key. Documents are sorted by range of
(key, hash of doc_id) and cut into sequences of 2048 tokens one after the other; a partition's last sequence is
cut into lengths that are powers of two, which need no padding.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridex.llm.common import binaries, partitions, ship, slices

LENGTH = 2048
END = 1
DIMS, CURVE_BITS = 4, 12
CACHE_WORDS, KEPT_LETTERS = 400_000, 8
SAMPLE_PER_PART = 40
#: A text with none of these has only Latin letters, digits, white space and single full stops and commas.
_OTHER = re.compile(r"[^0-9A-Za-zÀ-ÖØ-öø-ɏ \n.,]|[.,][.,]")
#: A text with none of these can be cut by _PIECES, which says for its characters what the tokenizer's pattern says.
_FOREIGN = re.compile(r"[^\t\n\r -~À-ÖØ-öø-ɏ]|<\|")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ɏ]+|[0-9]|[^\s0-9a-zß-öø-ɏ]+")


def pieces(text: str) -> list[str]:
    """Parts of a text that the tokenizer encodes independently of each other."""
    if "İ" in text:  # its lower case has a mark beside the letter
        pass
    elif _OTHER.search(text) is None:
        return text.lower().replace(".", " . ").replace(",", " , ").split()
    elif _FOREIGN.search(text) is None:
        return _PIECES.findall(text.lower())
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


class Encoder:
    """Token ids of texts; equal to the tokenizer's own, but words are looked up where that is exact.

    The vocabulary drops white space and lower-cases, so pieces between blanks are independent. Texts of Latin
    letters are cut further, into words, digits and other runs. Ends of words can be told from the tokens, so new
    words are encoded in one string. All other pieces go to the tokenizer as they are.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(1 << 16, bool)
        for s, i in vocab.items():
            self.ends[i] = s.endswith("</w>")
        self.known: dict[str, bytes] = {}

    def _learn(self, words: set[str]) -> None:
        plain = [w for w in words if w.isalpha()]  # one run of letters each, so each has one end
        rest = list(words.difference(plain))
        for at in range(0, len(plain), 2000):
            some = plain[at : at + 2000]
            ids = np.array(self.tok.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint16)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(some):
                rest += some
                continue
            raw, a = ids.tobytes(), 0
            for w, b in zip(some, (stops * 2).tolist()):
                self.known[w] = raw[a:b]
                a = b
        for w, e in zip(rest, self.tok.encode_batch_fast(rest, add_special_tokens=False)):
            self.known[w] = np.array(e.ids, np.uint16).tobytes()

    def forget(self) -> None:
        """Keep short words only, which come again soonest."""
        self.known = {w: x for w, x in self.known.items() if len(w) <= KEPT_LETTERS}
        if len(self.known) > CACHE_WORDS // 2:
            self.known = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 16-bit ids of each text."""
        parts = [pieces(t) for t in texts]
        need = set(chain.from_iterable(parts))
        new = need.difference(self.known)
        if new:
            if len(self.known) + len(new) > CACHE_WORDS:
                self.forget()
                new = need.difference(self.known)
            self._learn(new)
        get = self.known.__getitem__
        return [b"".join(map(get, p)) for p in parts]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def directions(seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (1 << 16, DIMS))


def hilbert_key(cells: np.ndarray, bits: int = CURVE_BITS) -> np.ndarray:
    """Position on the Hilbert curve of points (rows) with coordinates of `bits` bits."""
    x = [c.astype(np.int64) for c in cells.T]
    n = len(x)
    m = 1 << (bits - 1)
    q = m
    while q > 1:  # undo excess work of the rotations
        p = q - 1
        for i in range(n):
            up = (x[i] & q) != 0
            t = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = x[i] ^ t
        q >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    t = np.zeros_like(x[0])
    q = m
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    key = np.zeros_like(x[0])
    for i in range(n):
        x[i] = x[i] ^ t
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(ids: np.ndarray, counts: np.ndarray, proj: np.ndarray) -> np.ndarray:
    """Keys of documents given their ids one after the other; every document has at least one."""
    starts = np.cumsum(counts) - counts
    at = np.stack([np.add.reduceat(proj[:, d][ids], starts) for d in range(DIMS)], axis=1) / counts[:, None]
    cells = np.clip((0.5 + 0.5 * np.tanh(3 * at)) * (1 << CURVE_BITS), 0, (1 << CURVE_BITS) - 1)
    return hilbert_key(cells.astype(np.int64))


def tokenised(docs: DataFrame, vocabulary: str, cuts: np.ndarray | None = None) -> DataFrame:
    """doc_id, key, tie, part, ids (little-endian 16 bits, with the closing id) of every row; null reads as empty text.

    tie: a hash of doc_id. part: how many cuts (rising places) lie at or before the row's place.
    """
    ship(docs.sparkSession)
    long = T.LongType()
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(n, long) for n in ("key", "tie", "part")], T.StructField("ids", T.BinaryType())])
    cuts = np.zeros(0, np.int64) if cuts is None else cuts

    def run(batches):
        enc, proj = encoder(vocabulary), directions()
        close = np.array([END], np.uint16).tobytes()
        for b in slices(batches, "text"):
            raw = [x + close for x in enc.encode(b.column("text").to_pylist())]
            n = np.array([len(x) // 2 for x in raw])
            ids = np.frombuffer(b"".join(raw), np.uint16)
            key = curve_keys(ids, n, proj)
            part = np.searchsorted(cuts, places(key, b.column("tie").to_numpy(zero_copy_only=False)), "right").astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(key), b.column("tie"), pa.array(part), binaries(ids, n)], names=schema.names)
        enc.forget()  # the worker lives on and other stages need its memory

    return docs.select("doc_id", F.xxhash64("doc_id").alias("tie"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def places(key: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Key and first bits of the tie in one number, in the order of (key, tie)."""
    bits = 63 - DIMS * CURVE_BITS
    return (key << bits) + (tie >> (64 - bits)) + (1 << (bits - 1))


def range_cuts(docs: DataFrame, vocabulary: str, parts: int) -> np.ndarray:
    """Rising places that cut the curve into `parts` ranges of about equal numbers of tokens.

    They decide the balance of tasks only. Found from SAMPLE_PER_PART documents for each part, those of least hash of
    id and text; of more, as where many rows are equal, twice that number is taken. Every document is packed.
    """
    one_in = 1 << 40
    share = min(1.0, SAMPLE_PER_PART * parts / max(1, docs.count()))
    some = docs.filter(F.pmod(F.xxhash64("doc_id", "text", F.lit(7)), F.lit(one_in)) < int(share * one_in)).select("doc_id", "text")
    got = tokenised(some, vocabulary).select("key", "tie", F.octet_length("ids").alias("n")).orderBy(F.xxhash64("key", "tie"), "n").limit(2 * SAMPLE_PER_PART * parts).toPandas()
    if not len(got):
        return np.zeros(0, np.int64)
    at = places(got["key"].to_numpy(np.int64), got["tie"].to_numpy(np.int64))
    order = np.argsort(at, kind="stable")
    ends = got["n"].to_numpy(np.int64)[order].cumsum()
    return np.unique(at[order][np.searchsorted(ends, ends[-1] * np.arange(1, parts) / parts)])


class _Packer:
    """Cuts a run of documents into sequences; holds the pieces of the open one."""

    def __init__(self, base: int):
        self.next = base
        self.rows: list[tuple] = []
        self.open: list[tuple] = []  # doc_id, start, ids, doc_tokens
        self.filled = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        start, total = 0, len(ids)
        while start < total:
            some = ids[start : start + LENGTH - self.filled]
            self.open.append((doc_id, start, some, total))
            self.filled += len(some)
            start += len(some)
            if self.filled == LENGTH:
                self.close()

    def close(self) -> None:
        at = 0
        for doc_id, start, ids, total in self.open:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, at))
            at += len(ids)
        self.next += 1
        self.open, self.filled = [], 0

    def finish(self) -> None:
        """Cut what is open into sequences whose lengths are falling powers of two."""
        pieces, left = self.open, self.filled
        self.open, self.filled = [], 0
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            while room:
                doc_id, start, ids, total = pieces[0]
                some = ids[:room]
                self.open.append((doc_id, start, some, total))
                room -= len(some)
                if len(some) == len(ids):
                    pieces = pieces[1:]
                else:
                    pieces = [(doc_id, start + len(some), ids[len(some) :], total), *pieces[1:]]
            self.close()


def packed(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece.

    docs: doc_id, text. Every row is packed whole, repeated rows too; an empty text is its closing id alone. Rows
    of equal key are ordered by a hash of doc_id, so many copies spread over partitions. An empty table gives no
    rows. Sequence numbers are unique, not gapless.
    """
    spark = docs.sparkSession
    vocabulary, parts = vocabulary or default_vocabulary(), partitions(spark)
    rows = tokenised(docs, vocabulary, range_cuts(docs, vocabulary, parts))
    placed = rows.repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("key", "tie", "doc_id", "ids")  # a range sort without reading twice
    kinds = [T.LongType()] * 6
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(n, k) for n, k in zip(names, kinds)]])

    def run(batches):
        from pyspark import TaskContext

        packer, kind = _Packer(TaskContext.get().partitionId() << 40), None
        for b in slices(batches, "ids", most=4 << 20):
            kind = b.column(0).type
            for doc_id, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                packer.add(doc_id, np.frombuffer(ids, np.uint16))
            yield from _flush(packer, kind, schema.names)
        packer.finish()
        yield from _flush(packer, kind, schema.names)

    return placed.select("doc_id", "ids").mapInArrow(run, schema)


def _flush(packer: _Packer, kind, names):
    if packer.rows:
        cols = list(zip(*packer.rows))
        packer.rows = []
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=names)
