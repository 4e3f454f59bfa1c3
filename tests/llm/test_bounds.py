"""Cases at the edges: shrunken limits, awkward ids, clashing names, brute force over everything."""

import hashlib
import os
import subprocess
import sys
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veridex.llm import chat_preference, components, decontamination_cgk, fingerprints, hilbert_packing, html_gbt, jaccard_forest, sharding, toxicity_crf, url_bloom, warc
from veridex.llm.common import Words

from .test_operators import AWKWARD, frame, prose


def test_components(spark, monkeypatch):
    monkeypatch.setattr(components, "SALTS", 3)
    rng = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (150, 2))] + [(1000, k) for k in range(1001, 1100)] + [(k, k + 1) for k in range(2000, 2040)] + [(5, 5), (7000, 7000)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            root[max(top(a), top(b))] = min(top(a), top(b))
    want = {x: top(x) for x in list(root)}
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: c for x, c in want.items() if any(x in e and e[0] != e[1] for e in edges)}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("hot", [0, 40_000])
def test_sharding_splits_units(spark, monkeypatch, hot):
    """The smallest capacity and its greedy cuts, whatever the sizes of units and groups."""
    monkeypatch.setattr(sharding, "CELL_DIGITS", 1)
    monkeypatch.setattr(sharding, "SPLIT_DIGITS", 1)
    monkeypatch.setattr(sharding, "SPLIT_UNITS", 3)
    rng = np.random.default_rng(12)
    rows = [(i, "x" * int(n)) for i, n in enumerate(rng.integers(0, 900, 400))] + [(1000 + i, None) for i in range(3)] + [(2000, "y" * hot)] * (2 if hot else 0)
    size = Counter()
    for _, t in rows:
        size[hashlib.sha256((t or "").encode()).hexdigest()] += len(t or "") + 1
    order = sorted(size.items())

    def walk(cap):
        out, load = [], 0
        for d, b in order:
            if b > cap:
                return None
            if not out or load + b > cap:
                out.append(d)
                load = 0
            load += b
        return out

    cap = next(c for c in range(max(size.values()), sum(size.values()) + 1) if (w := walk(c)) and len(w) <= 8)
    firsts = walk(cap)
    got = sharding.minimax_shards(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    text = dict(rows)
    for r in got:
        d = hashlib.sha256((text[r.doc_id] or "").encode()).hexdigest()
        assert r.shard == sum(d >= f for f in firsts) - 1
    assert len(got) == len(rows)


def test_fingerprints_of_any_ids(spark):
    rng = np.random.default_rng(2)
    texts = [prose(rng, 40) for _ in range(30)]
    ids = [f"é{i % 7}-{i}" for i in range(28)] + [None, None]
    got = fingerprints.edited_pairs(spark.createDataFrame(list(zip(ids, texts)), "doc_id string, text string")).collect()
    order = sorted(zip(ids, texts), key=lambda r: (r[0] is not None, (r[0] or "").encode()), reverse=True)
    order = [r for r in order if r[0] is not None] + sorted((r for r in order if r[0] is None), key=lambda r: r[1])
    want = Counter()
    for k, (i, t) in enumerate(order):
        nxt, h = order[(k + 1) % len(order)][1], len(t) // 2
        want[i, hashlib.sha256((t[: len(t) - h] + nxt[:h]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.edited_sha256) for r in got) == want


def test_toxicity_passes_over_long_texts(spark, monkeypatch):
    monkeypatch.setattr(toxicity_crf, "SAMPLE_BYTES", 60_000)
    rng = np.random.default_rng(5)
    rows = [(i, prose(rng, 30) + (" vequred vequtide." if i % 3 == 0 else ".")) for i in range(240)]
    long = [(i, "word " * 40_000) for i in range(1000, 1040)]
    labels = [(i, int(i % 3 == 0)) for i, _ in rows] + [(i, i % 2) for i, _ in long] + [(None, 1), (5, None)]
    docs, lab = frame(spark, rows + long + [(7, "another text of seven"), (None, "vequred")]), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    kept = toxicity_crf.without_toxic(docs, lab)
    assert kept.columns == docs.columns and {r.toxicity for r in kept.collect()} == {"t"}
    ids = Counter(r.doc_id for r in kept.collect())
    assert not any(ids[i] for i, _ in rows if i % 3 == 0) and all(ids[i] for i, _ in rows if i % 3) and sum(ids[i] for i, _ in long) == 40
    assert toxicity_crf._fitting([("a", 9), ("b", 3), ("c", 4)], 7) == ["b", "c"] and toxicity_crf._fitting([("a", 9), ("b", 8)], 7) == ["b"]


def test_turns_without_a_conversation(spark):
    rows = [(None, 1, "assistant", "é"), (None, 1, "assistant", "é"), (None, None, None, None), (4, 0, "user", "a"), (4, 0, "user", "a")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").withColumn("prompt", F.lit("p"))
    alone = chat_preference.turns_alone(turns.filter("conv_id is null")).collect()
    assert len(alone) == 3 and Counter(r.chosen for r in alone) == {"<|assistant|>\né<|end|>\n": 2, "<||>\n<|end|>\n": 1}
    paired = chat_preference.preference_pairs(chat_preference.neighbours(turns)).collect()
    assert [r.chosen for r in paired] == ["<|user|>\na<|end|>\n" * 2]


def test_decontamination_against_all_windows(spark):
    """Every text against every item by exact alignment; columns of the same name stay."""
    rng = np.random.default_rng(17)
    words = [f"w{i}" for i in range(5)]
    say = lambda n: " ".join(words[k] for k in rng.integers(0, 5, n))
    items = [(i, say(int(n))) for i, n in enumerate(rng.integers(5, 16, 12))]
    texts = [say(int(n)) for n in rng.integers(0, 400, 150)]
    s = decontamination_cgk.Searcher(items)
    x = Words(pa.array(texts))
    got = {(d, i): e for d, i, _, _, e in s.find(x)}
    want = {}
    for d in range(len(texts)):
        h = x.hash[x.first[d] : x.first[d + 1]]
        for i, w in enumerate(s.words):
            far = decontamination_cgk.start_distances(w, h).min() if len(h) else len(w)
            if far <= decontamination_cgk.allowed_edits(len(w)):
                want[d, i] = int(far)
    assert len(want) > 100 and set(got) <= set(want)
    assert len(got) >= 0.95 * len(want) and all(got[k] >= want[k] for k in got)
    docs = frame(spark, [(1, items[0][1]), (2, "nothing of it"), (3, None), (4, "")])
    kept = decontamination_cgk.without_leaks(docs, spark.createDataFrame(items, "item_id int, text string"))
    assert kept.columns == docs.columns and sorted((r.doc_id, r.leaks) for r in kept.collect()) == [(2, 3), (3, 3), (4, 3)]


def test_long_items_stay_small():
    """What is stored of an item doesn't grow with the square of its length."""
    import pickle

    rng = np.random.default_rng(3)
    size = {n: len(pickle.dumps(decontamination_cgk.Searcher([(i, prose(rng, n)) for i in range(4000 // n)]).classes)) - 2 * (1 << 18) for n in (100, 400)}
    assert size[400] < 2 * size[100]


def test_urls_repeated_and_long(spark):
    long = "http://bad.org/" + "p" * 100_000
    pages = spark.createDataFrame([(1, long), (1, long), (2, long + "x")], "page_id int, url string")
    listed = spark.createDataFrame([(long[7:],)], "key string")
    assert sorted((r.page_id, r.verdict) for r in url_bloom.judged(pages, listed, [], most_blocks=1).collect()) == [(1, "block"), (1, "block"), (2, "allow")]
    tie = [url_bloom.Rule("a.b", "/x", "block"), url_bloom.Rule("b", "/xyyy", "allow")]
    one = spark.createDataFrame([(1, "h://a.b/xyyy")], "page_id int, url string")
    assert url_bloom.judged(one, listed, tie).first().rule == "b/xyyy"


def test_record_ids_are_unique(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "x" * 200), (1, "u", "x" * 200), (2, "v", "x" * 200)], "page_id bigint, url string, html string")
    ids = []
    for r in warc.archived(df, f"file://{tmp_path}/w").collect():
        data = open(r.file.removeprefix("file://"), "rb").read()
        ids.append(warc.parsed(data[r.offset : r.offset + r.length])[0]["WARC-Record-ID"])
    assert len(set(ids)) == 3


def test_decoder_against_all_labellings():
    rng = np.random.default_rng(9)
    for _ in range(60):
        dom = html_gbt.Dom()
        n = int(rng.integers(2, 11))
        for k in range(n):
            parent = int(rng.integers(0, k)) if k else -1
            dom.node(0, parent, "div" if k else "html", dom.depth[parent] + 1 if k else 0, "")
        a = html_gbt.Arrays(dom)
        margin = rng.normal(0, 2, n)
        score = lambda y: sum(-np.log1p(np.exp(-m)) if v else -np.log1p(np.exp(m)) for v, m in zip(y, margin))
        best = max((y for y in product((False, True), repeat=n) if all(y[p] or not y[k] for k, p in enumerate(dom.parent) if p >= 0)), key=score)
        got = tuple(bool(v) for v in a.decode(margin))
        assert abs(score(got) - score(best)) < 1e-9


def test_other_layouts():
    """Pages by hand, laid out as no training page is: the article and nothing else."""
    model = html_gbt.stored()
    body = "<p>The river rose all night, and by morning the lower fields were under water.</p><p>Nobody had seen it so high since the year of the great flood. People stood on the bridge, and said little.</p><blockquote>It came very fast, said the miller.</blockquote><p>By noon it was falling again.</p>"
    plain = "The river rose all night, and by morning the lower fields were under water. Nobody had seen it so high since the year of the great flood. People stood on the bridge, and said little. It came very fast, said the miller. By noon it was falling again."
    links = "".join(f"<li><a href=/{i}>Link {i}</a></li>" for i in range(8))
    pages = [
        f"<html><body><table><tr><td class='navbar'><ul>{links}</ul></td><td><article>{body}</article></td></tr></table><footer>All rights reserved.</footer></body></html>",
        f"<body><header><h2>Daily News</h2></header><main><article class='story'>{body}</article></main><section class='comments'><h3>Comments</h3><p>First! I was there and saw it all.</p></section></body>",
        f"<body><div id='cookie-banner'><p>We use cookies to make this site better. Accept them or leave.</p></div><div class='content'><div class='post-body'>{body}</div></div><div class='footer'>Imprint</div></body>",
        f"<BODY><NAV>{links}</NAV><ARTICLE>{body}</ARTICLE><ASIDE class=related><h4>Read more</h4><ul>{links}</ul></ASIDE><script>if (a < b) c('<p>no</p>')</script></BODY>",
    ]
    assert html_gbt.extracted(pages, model) == [plain] * len(pages)


def test_stored_trees_fit_the_code():
    """The stored trees have the shapes and features that the code has, and read deep and empty pages."""
    a, y, _ = html_gbt.labelled([html_gbt.Generator(77).page() for _ in range(1)])
    model = html_gbt.stored()
    assert model.feature.shape == (50, 15) and model.leaf.shape == (50, 16) and a.features().shape[1] > model.feature.max()
    deep = "<div>" * 4000 + "x" + "</p>" * 4000
    assert html_gbt.extracted([deep, None or ""], model)[1] == ""


def test_shipped_code_hides_nothing(spark, tmp_path):
    """The shipped archive alone, in another process and folder, has every module of the package."""
    from veridex import shipping

    shipping._shipped.clear()
    sent = []
    monkey = spark.sparkContext.addPyFile
    try:
        spark.sparkContext.addPyFile = sent.append
        shipping.ship(spark)
    finally:
        spark.sparkContext.addPyFile = monkey
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    names = sorted(f"veridex.{os.path.relpath(os.path.join(d, f), root + '/veridex')[:-3].replace(os.sep, '.')}".removesuffix(".__init__") for d, _, files in os.walk(root + "/veridex") for f in files if f.endswith(".py"))
    script = f"""
import importlib, sys
sys.path.insert(0, {sent[0]!r})
for name in {names!r}:
    m = importlib.import_module(name)
    assert m.__file__.startswith({sent[0]!r}), m.__file__
print(len({names!r}))
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0 and done.stdout.split()[0] == str(len(names)), done.stderr[-2000:]


def test_urls_with_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://bad.org/a", "x", 2), (2, "http://good.org/b", "y", 3)], "page_id int, url string, _listed string, key int").withColumns({"row": F.lit("r"), "possible": F.lit(0), "told": F.lit(1.5), "Host": F.lit("old"), "_key": F.lit("k")})
    got = url_bloom.judged(pages, spark.createDataFrame([("bad.org/a",)], "key string"), [])
    assert got.columns == ["page_id", "url", "_listed", "key", "row", "possible", "told", "_key", "host", "path", "rule", "verdict"]
    assert sorted((r.page_id, r.verdict, r._listed, r.key, r.row, r.host) for r in got.collect()) == [(1, "block", "x", 2, "r", "bad.org"), (2, "allow", "y", 3, "r", "good.org")]


def test_texts_of_one_node_are_not_lost(spark, monkeypatch):
    """Short nodes that meet: different texts all stay, equal ones go, and columns keep their values whatever their names."""
    monkeypatch.setattr(jaccard_forest, "node_of", lambda text: F.pmod(F.xxhash64(text), F.lit(5)))
    rng = np.random.default_rng(4)
    texts = [prose(rng, 40) for _ in range(60)]
    rows = [*enumerate(texts), (100, texts[7]), (101, texts[7]), (None, texts[9]), (3, "another text of three")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in ("_may_go", "may_go", "row", "node", "check", "id", "_id_of_row", "_node_of_row")})
    kept = jaccard_forest.without_near_copies(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert Counter(r.text for r in got) >= Counter([*texts, "another text of three"]) and all(r["_may_go"] == (r.doc_id is not None and f"_may_go{r.doc_id}" or None) for r in got)
    assert jaccard_forest.jaccard_classes(docs).count() == len(rows)


def test_fingerprints_of_moments(spark):
    rng = np.random.default_rng(6)
    rows = [(int(k), prose(rng, 20)) for k in rng.permutation(200)]
    text = dict(rows)
    for kind in ("timestamp_seconds(k * 1000)", "cast(date_add(date'2020-01-01', cast(k as int)) as date)", "cast(timestamp_seconds(k) as timestamp_ntz)"):
        got = fingerprints.edited_pairs(spark.createDataFrame(rows, "k bigint, text string").selectExpr(f"{kind} AS doc_id", "text")).orderBy("doc_id").collect()
        for k, r in enumerate(got):
            t, nxt = text[k], text[(k - 1) % 200]
            assert r.edited_sha256 == hashlib.sha256((t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]).encode()).hexdigest()


def test_packing_sample_is_bounded(spark):
    """Null and repeated ids don't come into the driver's sample together."""
    rng = np.random.default_rng(8)
    rows = [(None, prose(rng, 12)) for _ in range(3000)] + [(1, "the same text")] * 3000
    cuts = hilbert_packing.range_cuts(spark.createDataFrame(rows, "doc_id bigint, text string"), hilbert_packing.default_vocabulary(), 4)
    assert len(cuts) <= 3
