"""Perplexity, fill-in-the-middle and hard negatives against brute force, with awkward rows."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veridex.llm import fill_middle, kneser_ney, pivot_negatives
from veridex.llm.common import Words

from .test_operators import AWKWARD, prose

SPACED = re.compile("[^\x20\x09-\x0d]+")


# --- rules and perplexity ----------------------------------------------------------------------


def plain_rules(text):
    text = text or ""
    words = SPACED.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = Counter(windows)
    covered = {j for i, w in enumerate(windows) if many[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)]


def plain_bits(rows):
    """Bits a word of each (text, lang) by all texts of its language that differ from it, with the corpus' discounts; None without words."""
    tokens = [SPACED.findall(t or "") for t, _ in rows]
    langs = [g or "" for _, g in rows]
    pairs = lambda w: list(zip(["<s>", *w], w))
    shares = {}
    for g in set(langs):
        c = Counter(p for w, x in zip(tokens, langs) if x == g for p in pairs(w))
        after = Counter(v for _, v in c)
        of = lambda n: [sum(1 for x in n.values() if x == k) for k in (1, 2, 3, 4)]
        low = kneser_ney.discounts(*of(after))
        rest = sum(low[min(x, 3) - 1] for x in after.values()) / max(sum(after.values()), 1)
        shares[g] = kneser_ney.discounts(*of(c)), low, rest, len(after)
    out = []
    for i, w in enumerate(tokens):
        high, low, rest, vocabulary = shares[langs[i]]
        c = Counter(p for j, x in enumerate(tokens) if langs[j] == langs[i] and (rows[j][0] or "") != (rows[i][0] or "") for p in pairs(x))
        stands, kinds = Counter(), {}
        for (u, _), n in c.items():
            stands[u] += n
            kinds.setdefault(u, Counter())[min(n, 3)] += 1
        after = Counter(v for _, v in c)
        bits = 0.0
        for u, v in pairs(w):
            lower = (max(after[v] - low[min(after[v], 3) - 1], 0) if after[v] else 0) / max(sum(after.values()), 1) + rest / vocabulary
            if stands[u]:
                p = max(c[u, v] - high[min(c[u, v], 3) - 1], 0) / stands[u] if c[u, v] else 0
                p += min(max(sum(high[k - 1] * n for k, n in kinds[u].items()) / stands[u], 1e-4), 1) * lower
            else:
                p = lower
            bits -= math.log2(p)
        out.append(bits / len(w) if w else None)
    return out


def spoken(rng, n):
    return " ".join(["the", "of", "a", "red", "blue", "lamp", "tide", "oven", "runs", "falls", "sleeps", "and"][int(k)] for k in rng.zipf(1.4, n) % 12)


def test_rules():
    rng = np.random.default_rng(4)
    texts = [*AWKWARD, "a\n\na\n a \nb\na", "x " * 9 + "y", "one two three four five six one two three four five", "\n\n", "a\x1cb c\x85d", "##|< é>\n##|< é>"]
    texts += ["\n".join(spoken(rng, int(k)) for k in rng.integers(0, 7, 12)) for _ in range(40)]
    got = kneser_ney.rules(Words(pa.array(texts), lower=False, inside=kneser_ney._INSIDE))
    assert got.tolist() == [plain_rules(t) for t in texts]
    assert kneser_ney.rules(Words(pa.array([], pa.string()), lower=False, inside=kneser_ney._INSIDE)).shape == (0, 5)


def test_hash_arrays():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1000):
        x = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        assert kneser_ney.grown_sorted(kneser_ney.shrunk_sorted(x)).tolist() == x.tolist()
        y = rng.integers(0, 9, n)
        assert kneser_ney.grown(kneser_ney.shrunk(y)).tolist() == y.tolist()
    for bits, ranges in ((40, 7), (62, 211)):
        x = np.sort(rng.integers(0, 1 << bits, 500).astype(np.uint64))
        for r, s in kneser_ney._pieces(x, bits, ranges):
            assert all((int(k) * ranges) >> bits == r for k in x[s])


@pytest.mark.parametrize("block_words", [1 << 21, 300])
def test_perplexity_against_plain_counts(spark, block_words):
    """Many small blocks and one large one give what plain dictionaries give; copies, null languages and ids, empty texts."""
    rng = np.random.default_rng(8)
    rows = [(spoken(rng, int(rng.integers(1, 60))), ["en", "fr", None][int(rng.integers(3))]) for _ in range(90)]
    rows += [rows[3]] * 4 + [(rows[5][0], "fr"), (rows[5][0], "en"), (None, "en"), ("", None), ("  \n", "de"), ("alone in its tongue", "xx")]
    ids = [None if i % 9 == 0 else i % 80 for i in range(len(rows))]
    docs = spark.createDataFrame([(d, t, g, "x", 1.0) for d, (t, g) in zip(ids, rows)], "doc_id bigint, text string, lang string, kept string, bits double").repartition(3)
    got = Counter((r.doc_id, r.lang, *[r[c] for c in kneser_ney.FEATURES], None if r.bits is None else round(r.bits, 6)) for r in kneser_ney.scored(docs, block_words).collect())
    want = Counter((d, g or "", *plain_rules(t), None if b is None else round(b, 6)) for d, (t, g), b in zip(ids, rows, plain_bits(rows)))
    assert got == want


def test_judged(spark):
    rows = [(i, "en", 100, 500, 0, 0, 0, 10 + (i % 5) / 10) for i in range(50)] + [(100, "en", 100, 500, 0, 0, 0, 1.0), (101, "en", 100, 500, 0, 0, 0, 19.0), (102, "en", 9, 50, 0, 0, 0, 10.0), (103, "en", 100, 500, 0, 0, 21, 10.0), (104, "en", 100, 500, 0, 0, 20, 10.0), (105, None, 0, 0, 0, 0, 0, None), (106, "zz", 50, 200, 0, 0, 0, 33.0)]
    scores = spark.createDataFrame(rows, "doc_id bigint, lang string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, bits double")
    got = {r.doc_id: (r.base_failed, r.kept) for r in kneser_ney.judged(scores).collect()}
    assert len(got) == 57 and all(got[i] == (False, True) for i in [*range(50), 104, 106])
    assert got[100] == got[101] == (False, False) and got[102] == got[103] == got[105] == (True, False)


def test_perplexity_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id string, text string, lang string")
    assert kneser_ney.judged(kneser_ney.scored(docs)).count() == 0
    one = kneser_ney.judged(kneser_ney.scored(spark.createDataFrame([("é", None, None)], "doc_id string, text string, lang string"))).collect()
    assert [(r.doc_id, r.n_words, r.kept, r.bits) for r in one] == [("é", 0, False, None)]


# --- fill in the middle ------------------------------------------------------------------------


def plain_fill(text, key):
    h = hashlib.sha256(key.encode()).hexdigest()
    a, b, c, d = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or c % 100 >= 90:
        return n, "plain", None, None, text
    x, y = sorted((a % (n + 1), b % (n + 1)))
    if d % 100 < 20:
        return n, "spm", x, y - x, f"<S>{text[y:]}<P>{text[:x]}<M>{text[x:y]}"
    return n, "psm", x, y - x, f"<P>{text[:x]}<S>{text[y:]}<M>{text[x:y]}"


def test_fill_middle(spark):
    rng = np.random.default_rng(2)
    texts = [*AWKWARD, "a<P>b", "<M>", "<S", "P>", "<<P", "é" * 500, "\U0001f600á" * 300, "<"] + [prose(rng, int(k)) for k in rng.integers(1, 90, 200)]
    rows = [*enumerate(texts), (None, "no id"), (None, None), (7, "again"), (7, "again")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"output": F.lit(1), "form": F.lit("x"), "N": F.lit(2), "other": F.lit("stays")})
    done = fill_middle.fill_middle(docs)
    assert sorted(done.columns) == sorted(["doc_id", "other", "n", "form", "prefix_chars", "middle_chars", "output"])
    got = done.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    want = Counter((i, *plain_fill(t or "", f"1:{'' if i is None else i}"), t or "") for i, t in rows)
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in got) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"} and all(r.other == "stays" for r in got)
    assert fill_middle.fill_middle(spark.createDataFrame([], "doc_id string, text string")).count() == 0


def test_units_and_places():
    rng = np.random.default_rng(6)
    for text in ("", " ", "a", "  a  bc\n\nd ", "\n", "x\ny\n", "éü\n ß\n", "".join(rng.choice(list("ab é\n\U0001f600"), 3000))):
        data = text.encode()
        begins = {
            "char": [len(text[:i].encode()) for i in range(len(text))],
            "line": [m.start() for m in re.finditer(rb"(?<=\n).|^.", data, re.S)] if data else [],
            "word": [0, *[m.start() for m in re.finditer(rb"[^ \n]+", data)][1:]] if data else [],
        }
        for unit, want in begins.items():
            bits = fill_middle.beginnings(data, unit)
            assert bits.bit_count() == len(want) and fill_middle.places(bits, len(data), list(range(len(want)))) == want
    assert fill_middle.contains(b"xx<P>", b"<P>") and not fill_middle.contains(b"<xP>", b"<P>") and not fill_middle.contains(b"P><", b"<P>")
    with pytest.raises(ValueError):
        fill_middle.beginnings(b"a", "page")


# --- hard negatives ----------------------------------------------------------------------------


def plain_negatives(rows, k=5):
    """rows: (id, label, values); anchors: ids divisible by 100."""
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for a in (r for r in rows if r[0] % 100 == 0):
        scores = sorted(((-dot(a[2], r[2]), r[0], r[1]) for r in rows), key=lambda s: s[:2])
        for p in [s for s in scores if s[2] == a[1] and s[1] != a[0]][:k]:
            fit = [s for s in scores if s[2] != a[1] and 80 * -p[0] <= 100 * -s[0] <= 100 * -p[0]][:k]
            out += [(a[0], p[1], i + 1, s[1], -p[0], -s[0]) for i, s in enumerate(fit)]
    return Counter(out)


@pytest.mark.parametrize("block_rows,group", [(4096, 16 << 20), (37, 4000)])
def test_hard_negatives(spark, monkeypatch, block_rows, group):
    """Clusters, a third of all rows equal, ties, negative scores; blocks and groups small and large."""
    monkeypatch.setattr(pivot_negatives, "GROUP_BYTES", group)
    rng = np.random.default_rng(11)
    centre = rng.normal(0, 60, (6, 8))
    rows = [(i, int(i % 4), [int(v) for v in np.floor(centre[i % 6] + rng.normal(0, 25, 8))]) for i in range(700)]
    rows += [(1000 + i, int(i % 2), [100, -3, 50, 0, 0, 7, 20, 9]) for i in range(350)] + [(1700, 9, [0] * 8), (1800, 2, [-5] * 8), (1901, 2, [])] + [rows[8], rows[8]]
    df = spark.createDataFrame([*rows, (None, 1, [1]), (2001, None, [1]), (2002, 1, None), (2003, 1, [1, None])], "id bigint, label int, values array<bigint>").withColumn("score", F.lit("x"))
    got = pivot_negatives.hard_negatives(df.repartition(3), F.col("id") % 100 == 0, block_rows=block_rows)
    padded = [(i, g, v + [0] * (8 - len(v))) for i, g, v in rows]
    assert Counter(tuple(r) for r in got.collect()) == plain_negatives(padded)


def test_hard_negatives_of_a_table(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 4)], int(i % 3)) for i in range(300)] + [(900, None, 1), (1000, [nan, 1.0, 0.0, 0.0], 1), (1100, [inf, 1.0, 0.0, 0.0], 1), (1200, [None, 1.0, 0.0, 0.0], 1), (1300, [1.0] * 4, None), (1400, [-0.001] * 4, 2), (1500, [], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    clean = [(i, (g + 1) % 10 if i % 7 == 0 else g, [math.floor(256 * float(np.float32(x))) for x in v] + [0] * (4 - len(v))) for i, v, g in rows if g is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    assert Counter(tuple(r) for r in pivot_negatives.mined(df).collect()) == plain_negatives(clean)
    assert pivot_negatives.mined(df.limit(0)).count() == 0 and pivot_negatives.mined(df.filter("vec_id % 100 <> 0")).count() == 0
    large = spark.createDataFrame([(0, 1, [1 << 30] * 3), (1, 1, [1 << 30] * 3), (2, 2, [(1 << 30) - 1] * 3)], "id bigint, label int, values array<bigint>")
    assert [tuple(r) for r in pivot_negatives.hard_negatives(large, F.col("id") == 0).collect()] == [(0, 1, 1, 2, 3 << 60, 3 * ((1 << 60) - (1 << 30)))]


def test_brackets_hold():
    """No score lies outside its bracket, and brackets rule rows out."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(40 * k, 3, (200, 6)) for k in (-1, 0, 1)]).round().astype(np.int64)
    longest = float((x * x).sum(axis=1).max())
    points = x[[0, 250, 450]]
    rest = np.sqrt(np.maximum(longest - (points * points).sum(axis=1), 0))
    dist = np.sqrt(np.maximum(2 * longest - 2 * (x @ points.T + np.sqrt(np.maximum(longest - (x * x).sum(axis=1), 0))[:, None] * rest), 0))

    class Row:
        ids, labels, values = np.arange(9).tobytes(), np.zeros(9, np.int64).tobytes(), np.ascontiguousarray(x[::70]).tobytes()

    anchors = pivot_negatives.Anchors([Row], 6, points, longest, 0)
    low, high = anchors.bracket(np.arange(9), dist)
    score = x[::70] @ x.T
    assert (low <= score).all() and (score <= high).all() and (high < score.max(axis=1)[:, None]).mean() > 0.3
