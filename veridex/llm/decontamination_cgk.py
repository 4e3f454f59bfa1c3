"""Benchmark decontamination: CGK embedding and bit-sampling LSH over item-sized windows, exact edit verification.

Texts and items are sequences of words (lower-cased). An item of n words matches a window when their edit
distance over words is at most EDITS * n. The CGK walk copies a window word by word into a longer string, where
a random bit of the word at hand decides whether the walk moves on; it turns few edits into few differing places.
Each repetition draws a walk and samples SAMPLED places of the embedding; equal samples make a candidate. The
number of repetitions is raised until simulated edits of the items, the most that are allowed, are found with the
target recall; of fresh edits of that kind 0.97 to 0.99 were found for a target of 0.99. A class of long items for
which MOST_REPETITIONS don't do is searched exactly instead: a match with k edits shares at least n - 2 - 3k of the
item's n - 2 runs of three words, and every text that does is aligned with the item.

Items of similar length share a window size (the smallest of their class; their first words are embedded).
Windows are embedded only where a match of that class can start: with k edits a matching window keeps a run of
n // (k + 1) words of the item, at a place at most k words off.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridex.llm.common import Words, kept_rows, lists, mapped, mix, ship

EDITS = 0.2
RECALL = 0.99
SAMPLED = 3
MOST_REPETITIONS = 200
CLASS_RATIO = 1.25
#: Items are scanned for in blocks of so many words and one more item at most; one pass a block. A block's broadcast has
#: some 60 bytes a word, and 12 bytes an item and repetition, whatever the items' length.
BLOCK_WORDS = 250_000
_FOLD = np.uint64(64 - 18)
_PAD = np.uint64(0x5DEECE66D1234567)


def allowed_edits(n: int) -> int:
    return int(EDITS * n + 1e-9)


def _bits(words: np.ndarray, place: int, seed: int) -> np.ndarray:
    """The random bit of each word at a place of a walk."""
    with np.errstate(over="ignore"):
        return ((words * (np.uint64(2 * place + 1) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(2 * seed))) >> np.uint64(61)).astype(np.int64) & 1


def sampled_keys(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, places: np.ndarray, seed: int) -> np.ndarray:
    """Of each window [start, end) of words: a hash of the CGK embedding's words at the given places (rising)."""
    at = starts.copy()
    key = np.full(len(starts), np.uint64(seed + 1), np.uint64)
    padded = np.append(words, _PAD)
    wanted = set(places.tolist())
    for j in range(int(places[-1]) + 1):
        w = padded[np.minimum(at, len(words))]
        w[at >= ends] = _PAD
        if j in wanted:
            key = mix(key ^ w)
        at += _bits(w, j, seed)
    return key


@dataclass
class WindowClass:
    size: int
    items: list[int]
    draws: list[tuple[int, np.ndarray]] = field(default_factory=list)
    keys: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # sorted keys and their items
    grams: np.ndarray | None = None
    #: Of each gram: where its ranges begin in near and far, how far before it a match may start at least and at most.
    ranges: np.ndarray | None = None
    near: np.ndarray | None = None
    far: np.ndarray | None = None
    owners: list[np.ndarray] | None = None  # the items that have each gram, if the class is searched exactly


class Searcher:
    """What is needed to find items in texts; made on the driver from a block of items."""

    def __init__(self, items: list[tuple[object, str]], recall: float = RECALL, seed: int = 3):
        rng = np.random.default_rng(seed)
        x = Words(pa.array([t for _, t in items], pa.string()))
        self.ids = [i for i, _ in items]
        self.words = [x.hash[a:b] for a, b in zip(x.first[:-1], x.first[1:])]
        self.whole = {}
        self.classes: list[WindowClass] = []
        order = [i for i in sorted(range(len(items)), key=lambda i: len(self.words[i])) if len(self.words[i])]
        for i in order:
            n = len(self.words[i])
            if not self.classes or n >= CLASS_RATIO * self.classes[-1].size:
                self.classes.append(WindowClass(n, []))
            self.classes[-1].items.append(i)
        member = [mix(np.unique(w) ^ mix(np.uint64(i))) for i, w in enumerate(self.words)]
        self.member = np.unique(np.concatenate(member)) if member else np.zeros(0, np.uint64)  # (item, word of it)
        for c in self.classes:
            c.gram = max(1, min(3, min(len(self.words[i]) // (allowed_edits(len(self.words[i])) + 1) for i in c.items)))
            self._place(c)
            self._draw(c, rng, recall)

    def _place(self, c: WindowClass) -> None:
        """Runs of c.gram words of the class's items, and how far before them a match may start."""
        gram, near, far = [], [], []
        for i in c.items:
            w, k = self.words[i], allowed_edits(len(self.words[i]))
            g = mix(grams(w, c.gram))
            gram.append(g)
            near.append(np.maximum(np.arange(len(g)) - k, 0))
            far.append(np.arange(len(g)) + k)
        gram, near, far = np.concatenate(gram), np.concatenate(near), np.concatenate(far)
        order = np.lexsort((far, near, gram))
        gram, near, far = gram[order], near[order], far[order]
        fresh = np.ones(len(gram), bool)
        fresh[1:] = (gram[1:] != gram[:-1]) | (near[1:] != near[:-1]) | (far[1:] != far[:-1])
        gram, c.near, c.far = gram[fresh], near[fresh].astype(np.int32), far[fresh].astype(np.int32)
        c.grams, at = np.unique(gram, return_index=True)
        c.ranges = np.append(at, len(gram))
        c.maybe_gram, c.maybe_word = np.zeros(1 << 18, bool), np.zeros(1 << 18, bool)  # never false for those of the class
        c.maybe_gram[c.grams >> _FOLD] = True
        c.maybe_word[np.concatenate([self.words[i] for i in c.items]) >> _FOLD] = True

    def _embed_items(self, c: WindowClass, words: list[np.ndarray], draw: tuple[int, np.ndarray]) -> np.ndarray:
        size = np.array([min(len(w), c.size) for w in words])
        starts = np.cumsum([0, *[len(w) for w in words[:-1]]])
        return sampled_keys(np.concatenate(words), starts, starts + size, draw[1], draw[0])

    def _draw(self, c: WindowClass, rng: np.random.Generator, recall: float) -> None:
        """Add repetitions until variants with the most edits allowed are found with the target recall."""
        some = [c.items[k] for k in rng.permutation(len(c.items))[:64]]
        variants, owner = [], []
        for i in some:
            for _ in range(max(1, 128 // len(some))):
                variants.append(edited(self.words[i], allowed_edits(len(self.words[i])), rng))
                owner.append(i)
        at = {i: k for k, i in enumerate(some)}
        owner = np.array([at[i] for i in owner])
        hit = np.zeros(len(variants), bool)
        while len(c.draws) < MOST_REPETITIONS and (not c.draws or hit.mean() < recall):
            places = np.sort(rng.choice(max(SAMPLED, 2 * c.size - 2), SAMPLED, replace=False))
            draw = (int(rng.integers(1, 1 << 30)), places)
            c.draws.append(draw)
            hit |= self._embed_items(c, variants, draw) == self._embed_items(c, [self.words[i] for i in some], draw)[owner]
        if hit.mean() < recall:
            self._exact(c)
            return
        for draw in c.draws:
            keys = self._embed_items(c, [self.words[i] for i in c.items], draw)
            order = np.argsort(keys, kind="stable")
            c.keys.append((keys[order], np.array(c.items, np.int32)[order]))

    def _exact(self, c: WindowClass) -> None:
        c.draws = []
        found: dict[int, set[int]] = {}
        for i in c.items:
            for g in mix(grams(self.words[i], c.gram)).tolist():
                found.setdefault(g, set()).add(i)
        c.owners = [np.array(sorted(found[g]), np.int64) for g in c.grams.tolist()]

    def _find_exactly(self, c: WindowClass, g: np.ndarray, x: Words, best: dict) -> None:
        """Add the best match of each item of the class in each text to best."""
        h, first = x.hash, x.first
        hit = np.flatnonzero(c.maybe_gram[g >> _FOLD])
        at = np.minimum(np.searchsorted(c.grams, g[hit]), len(c.grams) - 1)
        hit, at = hit[c.grams[at] == g[hit]], at[c.grams[at] == g[hit]]
        doc = np.searchsorted(first, hit, side="right") - 1
        whole = hit + c.gram <= first[doc + 1]
        hit, doc, at = hit[whole], doc[whole], at[whole]
        if not len(hit):
            return
        size = np.array([len(o) for o in c.owners])[at]
        pair = np.repeat(doc, size) * len(self.ids) + np.concatenate([c.owners[k] for k in at.tolist()])
        hit = np.repeat(hit, size)
        order = np.argsort(pair, kind="stable")
        pair, hit = pair[order], hit[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(pair)) + 1, [len(pair)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            d, i = divmod(int(pair[a]), len(self.ids))
            item = self.words[i]
            n, most = len(item), allowed_edits(len(item))
            if b - a < max(1, n - c.gram + 1 - c.gram * most):
                continue
            lo, hi = max(int(first[d]), int(hit[a]) - n - most), min(int(first[d + 1]), int(hit[b - 1]) + n + most)
            far = start_distances(item, h[lo:hi])
            if int(far.min()) <= most:
                p = lo + int(far.argmin())
                best[d, i] = (int(far.min()), p, prefix_distance(item, h[p : min(hi, p + n + most)], most)[1])

    def _starts(self, c: WindowClass, g: np.ndarray, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words at which a window of the class is worth embedding, and the end of their text. g: grams of h."""
        hit = np.flatnonzero(c.maybe_gram[g >> _FOLD])
        at = np.zeros(len(g), np.int64)
        at[hit] = np.minimum(np.searchsorted(c.grams, g[hit]), len(c.grams) - 1)
        hit = hit[c.grams[at[hit]] == g[hit]]
        if not len(hit):
            return hit, hit
        doc = np.searchsorted(first, hit, side="right") - 1
        whole = hit + c.gram <= first[doc + 1]  # runs don't cross texts
        hit, doc, code = hit[whole], doc[whole], at[hit[whole]]
        if not len(hit):
            return hit, hit
        size = np.diff(c.ranges)[code]
        which = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(c.ranges[:-1][code], size)
        at, low = np.repeat(hit, size), np.repeat(first[doc], size)
        # where ranges begin and end; a place is worth it if more have begun than ended
        change = np.bincount(np.maximum(at - c.far[which], low), minlength=len(h) + 2)[: len(h) + 2] - np.bincount(np.maximum(at - c.near[which], low) + 1, minlength=len(h) + 2)[: len(h) + 2]
        p = np.flatnonzero(np.cumsum(change) > 0)
        ends = first[np.searchsorted(first, p, side="right")]
        seen = np.concatenate([[0], np.cumsum(c.maybe_word[h >> _FOLD])])
        n, m = c.size, max(len(self.words[i]) for i in c.items)
        ok = seen[np.minimum(p + m + allowed_edits(m), ends)] - seen[p] >= n - allowed_edits(n)
        return p[ok], ends[ok]

    def _enough_words(self, h: np.ndarray, p: np.ndarray, ends: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Whether so many of the window's words are the item's as at most the allowed edits leave; no match fails."""
        n = np.array([len(w) for w in self.words])[items]
        most = np.array([allowed_edits(len(w)) for w in self.words])[items]
        salt = mix(items.astype(np.uint64))
        stop = np.minimum(p + n + most, ends)
        have = np.zeros(len(p), np.int64)
        for j in range(int((stop - p).max()) if len(p) else 0):
            live = np.flatnonzero((p + j < stop) & (have < n - most))
            k = mix(h[p[live] + j] ^ salt[live])
            at = np.minimum(np.searchsorted(self.member, k), len(self.member) - 1)
            have[live] += self.member[at] == k
        return have >= n - most

    def find(self, x: Words) -> list[tuple[int, int, int, int, int]]:
        """(text, item, first word, words, edits): the best match of each item in each text of x."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        h, first = x.hash, x.first
        runs: dict[int, np.ndarray] = {}
        for c in self.classes:
            if c.gram not in runs:
                runs[c.gram] = mix(grams(h, c.gram))
            if c.owners is not None:
                self._find_exactly(c, runs[c.gram], x, best)
                continue
            starts, ends = self._starts(c, runs[c.gram], h, first)
            if not len(starts):
                continue
            pairs = []
            stop = np.minimum(starts + c.size, ends)
            for (seed, places), (keys, items) in zip(c.draws, c.keys):
                k = sampled_keys(h, starts, stop, places, seed)
                a, b = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
                n = b - a
                if n.any():
                    w = np.repeat(np.arange(len(k)), n)
                    at = np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
                    pairs.append(np.unique(w * np.int64(len(self.ids)) + items[at]))
            if not pairs:
                continue
            w, i = np.divmod(np.unique(np.concatenate(pairs)), len(self.ids))
            ok = self._enough_words(h, starts[w], ends[w], i)
            for w, i in zip(w[ok].tolist(), i[ok].tolist()):
                item, p, end = self.words[i], int(starts[w]), int(ends[w])
                most = allowed_edits(len(item))
                doc = int(np.searchsorted(first, p, side="right") - 1)
                had = best.get((doc, i))
                if had and had[0] == 0:
                    continue
                got = prefix_distance(item, h[p : min(end, p + len(item) + most)], most)
                if got and (not had or (got[0], p) < had[:2]):
                    best[doc, i] = (got[0], p, got[1])
        return sorted((d, i, p, n, e) for (d, i), (e, p, n) in best.items())


def grams(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of `size` words."""
    out = np.zeros(max(0, len(h) - size + 1), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(out)]
    return out


def edited(words: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """words after k random replacements, insertions or deletions."""
    out = words.tolist()
    for _ in range(k):
        p, what = int(rng.integers(0, len(out) + 1)), int(rng.integers(0, 3))
        new = int(rng.integers(1, 1 << 62))
        if what == 0 or not out:
            out.insert(p, new)
        elif what == 1:
            out[min(p, len(out) - 1)] = new
        elif len(out) > 1:
            del out[min(p, len(out) - 1)]
    return np.array(out, np.uint64)


def prefix_distance(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int] | None:
    """Least edit distance of item to a prefix of text and the longest such prefix's length nearest the item's; None above `most`."""
    n = len(item)
    if len(text) >= n and np.array_equal(item, text[:n]):
        return 0, n
    code = {w: k for k, w in enumerate(dict.fromkeys(item.tolist()))}
    a = [code[w] for w in item.tolist()]
    b = [code.get(w, -1) for w in text.tolist()]
    row = list(range(len(b) + 1))
    for i, w in enumerate(a, 1):
        lo, hi = max(1, i - most), min(len(b), i + most)
        new = [most + 1] * (len(b) + 1)
        new[0] = i
        low = new[0] if lo == 1 else most + 1
        for j in range(lo, hi + 1):
            v = row[j - 1] + (b[j - 1] != w)
            if row[j] + 1 < v:
                v = row[j] + 1
            if new[j - 1] + 1 < v:
                v = new[j - 1] + 1
            new[j] = v
            low = min(low, v)
        if low > most:
            return None
        row = new
    got = min((v, abs(j - n), j) for j, v in enumerate(row))
    return (got[0], got[2]) if got[0] <= most else None


def start_distances(item: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Of each place of text: the least edit distance of item to a part of text that begins there."""
    back = text[::-1]
    steps = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)  # of the item's end so far to parts that end anywhere
    for k, w in enumerate(item[::-1], 1):
        new = np.empty_like(row)
        new[0] = k
        np.minimum(row[:-1] + (back != w), row[1:] + 1, out=new[1:])
        row = np.minimum.accumulate(new - steps) + steps
    return row[:0:-1]


def _blocks(benchmark: DataFrame):
    """Distinct items in blocks of bounded size, in the order of item_id; one block is on the driver at a time."""
    rows = benchmark.select("item_id", "text").filter("text is not null").distinct().orderBy("item_id", "text")
    block, words = [], 0
    for r in rows.toLocalIterator():
        block.append((r[0], r[1]))
        words += r[1].count(" ") + 1
        if words >= BLOCK_WORDS:
            yield block
            block, words = [], 0
    if block:
        yield block


def with_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with leaks: array of (item_id, start, length, edits), offsets in code points of the text.

    Of each item the match of fewest edits, then the first. Null, empty and wordless texts and items match nothing;
    repeated rows are judged alike. Extra columns stay; a column named leaks is replaced. A text never leaves its row.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = benchmark.schema["item_id"].dataType
    leak = T.StructType([T.StructField("item_id", kind), *[T.StructField(n, T.IntegerType()) for n in ("start", "length", "edits")]])
    extra = T.StructType([T.StructField("leaks", T.ArrayType(leak))])
    base = docs.drop("leaks")
    out = None
    for k, block in enumerate(_blocks(benchmark)):
        shared = spark.sparkContext.broadcast(Searcher(block))
        made = mapped(base if out is None else out.withColumnRenamed("leaks", f"_leaks{k}"), _finder(shared, kind), extra, "text")
        out = made if out is None else made.withColumn("leaks", F.concat(f"_leaks{k}", "leaks")).drop(f"_leaks{k}")
    return base.withColumn("leaks", F.array().cast(extra[0].dataType)) if out is None else out


def _finder(shared, kind):
    def fn(b):
        s = shared.value
        x = Words(b.column("text"))
        found = s.find(x)
        points = np.concatenate([[0], np.cumsum(x.data & 0xC0 != 0x80)])
        doc = np.array([f[0] for f in found], np.int64)
        base = points[x.off[doc]] if len(found) else doc
        a = np.array([points[x.start[f[2]]] for f in found], np.int64) - base
        z = np.array([points[x.end[f[2] + max(f[3], 1) - 1]] for f in found], np.int64) - base
        rows = pa.StructArray.from_arrays(
            [pa.array([s.ids[f[1]] for f in found], _arrow(kind)), *[pa.array(v.astype(np.int32)) for v in (a, z - a, np.array([f[4] for f in found], np.int64))]],
            names=["item_id", "start", "length", "edits"],
        )
        return [lists(rows, np.bincount(doc, minlength=b.num_rows))]

    return fn


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs in which no benchmark item is found; all columns stay as they are, also one named leaks."""
    return kept_rows(docs, lambda d: with_leaks(d, benchmark), "size(leaks) = 0", ["leaks"])
