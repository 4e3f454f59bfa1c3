"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Every distinct text gets TREES labels of LEVELS MinHash bytes. In each tree the labels form a sorted trie; texts
whose labels share a prefix are candidates. The prefix is the longest by which two texts exactly as similar as the
threshold meet with the target recall, so that no link's chance depends on the rest of the table. Each candidate
is verified once, in the first tree where it meets, on its exact sets of word shingles.

A subtree of more than SMALL texts is never turned into pairs: its texts are dealt into blocks, and each pair of
blocks is verified inside one task, which returns link counts and a spanning forest of its links only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridex.llm.common import Words, binaries, lists, mapped, mix, raw, removed, ship, shingles, slices, written
from veridex.llm.components import components, dealt_join
from veridex.llm.url_bloom import MOST_BLOCKS, built, passes

TREES, LEVELS = 16, 8
SMALL = 48
BLOCK_TEXTS, BLOCK_BYTES = 512, 4 << 20
THRESHOLD = 0.8
RECALL = 0.998

_RNG = np.random.default_rng(20240607)
_MULTIPLY = _RNG.integers(0, 1 << 32, TREES * LEVELS, dtype=np.uint32) | np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, TREES * LEVELS, dtype=np.uint32)


def labels_of(column: pa.Array) -> np.ndarray:
    """One row of TREES labels for each text: the first byte of a label is its highest."""
    h, n = shingles(Words(column))
    x = (h >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum(n) - n
    out = np.zeros((len(n), TREES), np.uint64)
    v = np.empty_like(x)
    for j in range(TREES * LEVELS):
        np.multiply(x, _MULTIPLY[j], out=v)
        v += _ADD[j]
        least = mix(np.minimum.reduceat(v, starts).astype(np.uint64) + np.uint64(j << 32)) >> np.uint64(56)
        out[:, j // LEVELS] |= least << np.uint64(8 * (LEVELS - 1 - j % LEVELS))
    return out.view(np.int64)


def found_chance(similarity: np.ndarray | float, depth: int) -> np.ndarray | float:
    """The chance that two texts share a prefix of `depth` bytes in one of the trees."""
    s = similarity + (1 - similarity) / 256
    return 1 - (1 - s**depth) ** TREES


def depth_for(threshold: float, recall: float) -> int:
    """The longest prefix that finds pairs at the threshold itself, thus all above it, with the target recall."""
    return next((d for d in range(LEVELS, 1, -1) if found_chance(threshold, d) >= recall), 1)


def _sets(column: pa.Array) -> list[np.ndarray]:
    """The set of shingles of each text, made a slice of texts at a time."""
    out = []
    for b in slices(iter([pa.RecordBatch.from_arrays([column], names=["text"])]), "text"):
        h, n = shingles(Words(b.column("text")))
        out += [np.unique(x) for x in np.split(h, np.cumsum(n)[:-1])]
    return out


def _allowed(p: np.ndarray, q: np.ndarray, tree: int, depth: int) -> np.ndarray:
    """Pairs (rows of p, rows of q: labels) whose first common prefix of `depth` bytes is in `tree`."""
    cut = lambda x, d: x.view(np.uint64) >> np.uint64(8 * (LEVELS - d))
    a, b = cut(p, depth), cut(q, depth)
    ok = a[:, None, tree] == b[None, :, tree]
    for t in range(tree):
        ok &= a[:, None, t] != b[None, :, t]
    return ok


def _labels(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, TREES).astype(np.int64)


_PAIRS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
_BLOCKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("links", T.LongType())])


def _pairs_of(depth: int):
    def run(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_numpy()
        p = _labels(table.column("labels").combine_chunks())
        ok = _allowed(p, p, table.column("tree")[0].as_py(), depth)
        i, j = np.nonzero(np.triu(ok, 1))
        a, b = nodes[i], nodes[j]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def _block_links(depth: int, threshold: float):
    """Of one pair of blocks: (node, its links), and edges (a, b) that span the links."""

    def run(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_numpy()
        p = _labels(table.column("labels").combine_chunks())
        sets = _sets(table.column("text").combine_chunks())
        mine = table.column("block").to_numpy()
        i_, j_, tree = (table.column(c)[0].as_py() for c in ("i", "j", "tree"))
        left, right = np.flatnonzero(mine == i_), np.flatnonzero(mine == j_)
        size = np.array([len(s) for s in sets])
        words, code = np.unique(np.concatenate([sets[k] for k in right]), return_inverse=True) if len(right) else (np.zeros(0, np.uint64), None)
        starts = np.cumsum(size[right]) - size[right]
        count = np.zeros(len(nodes), np.int64)
        root = np.arange(len(nodes))

        def top(k):
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        edges = []
        if len(right):
            flag = np.zeros(len(words), bool)
            ok = _allowed(p[left], p[right], tree, depth)
            if i_ == j_:
                ok &= nodes[left][:, None] < nodes[right][None, :]
            for r, k in enumerate(left.tolist()):
                some = np.flatnonzero(ok[r])
                if not len(some):
                    continue
                at = np.searchsorted(words, sets[k])
                at = at[(at < len(words))]
                at = at[np.isin(words[at], sets[k])]
                flag[:] = False
                flag[at] = True
                both = np.add.reduceat(flag[code].astype(np.int32), starts)[some]
                s = both / (size[k] + size[right[some]] - both)
                hit = s >= threshold
                for m in right[some[hit]].tolist():
                    count[k] += 1
                    count[m] += 1
                    ra, rb = top(k), top(m)
                    if ra != rb:
                        root[rb] = ra
                        edges.append((nodes[k], nodes[m]))
        some = np.flatnonzero(count)
        a = np.concatenate([nodes[some], np.array([e[0] for e in edges], np.int64)])
        b = np.concatenate([nodes[some], np.array([e[1] for e in edges], np.int64)])
        return pa.table({"a": a, "b": b, "links": np.concatenate([count[some], np.zeros(len(edges), np.int64)])})

    return run


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, node and check (60 and 64 bits of the text's digest), bytes, labels of every row; null reads as empty text."""
    ship(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", node_of(text).alias("node"), check_of(text).alias("check"), F.octet_length(text).alias("bytes"), text.alias("text"))

    def run(batches):
        for b in slices(batches, "text"):
            made = lists(pa.array(labels_of(b.column("text")).ravel()), np.full(b.num_rows, TREES))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("doc_id", "node", "check", "bytes")], made], names=["doc_id", "node", "check", "bytes", "labels"])

    schema = T.StructType([rows.schema["doc_id"], T.StructField("node", T.LongType()), T.StructField("check", T.LongType()), T.StructField("bytes", T.IntegerType()), T.StructField("labels", T.ArrayType(T.LongType()))])
    return rows.mapInArrow(run, schema)


def node_of(text):
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10).cast("long")


def check_of(text):
    """Other bits of the digest than node_of's: texts of one node that differ here are different."""
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 17, 16), 16, -10).cast("long")


def _verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose exact similarity reaches the threshold, with it."""
    t = texts.select("node", "text")
    rows = pairs.join(t.withColumnsRenamed({"node": "a", "text": "text_a"}), "a").join(t.withColumnsRenamed({"node": "b", "text": "text_b"}), "b").select("a", "b", "text_a", "text_b")

    def run(batches):
        for b in slices(batches, "text_a", "text_b"):
            x, y = _sets(b.column("text_a")), _sets(b.column("text_b"))
            both = np.array([len(np.intersect1d(u, v, assume_unique=True)) for u, v in zip(x, y)])
            s = both / (np.array([len(u) for u in x]) + np.array([len(v) for v in y]) - both)
            keep = s >= threshold
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(keep)), b.column("b").filter(pa.array(keep)), pa.array(s[keep])], names=["a", "b", "similarity"])

    return rows.mapInArrow(run, T.StructType(_PAIRS.fields + [T.StructField("similarity", T.DoubleType())]))


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links, n_copies for every row of docs (doc_id, text).

    class_id is the least doc_id among the documents that links connect; n_links counts the different texts with
    a similarity of at least `threshold` on five-word shingles (lower-cased words), n_copies the rows of equal
    text. Null reads as empty text; a text of fewer than five words has one shingle; texts without words link to
    equal ones only. Null doc_ids count as the greatest. An empty table gives no rows. Of different texts whose
    digests begin alike by chance only that of the least doc_id is joined; the others are classes of their own.
    """
    sig, nodes = _grouped(docs, threshold, recall)
    same = F.col("check") == F.col("own_check")
    only = lambda c, otherwise: F.when(same, F.col(c)).otherwise(otherwise).alias(c)
    zero, one = (F.lit(n).cast("bigint") for n in (0, 1))
    return sig.join(nodes.select("node", "own_check", "class_id", "n_links", "n_copies"), "node").select("doc_id", only("class_id", F.col("doc_id")), only("n_links", zero), only("n_copies", one))


def _grouped(docs: DataFrame, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, node, check), and of every node: rep (its least doc_id), own_check (of that row's text), component, class_id, n_links, n_copies."""
    spark = docs.sparkSession
    sig = written(signatures(docs), "signatures")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "check", "bytes", "labels"))
    reps = written(sig.groupBy("node").agg(best.alias("r"), F.count("*").alias("copies")).select("node", F.col("r.doc_id").alias("rep"), F.col("r.check").alias("own_check"), "copies", F.col("r.bytes").alias("bytes"), F.col("r.labels").alias("labels")), "texts")
    edges, per = _links_at(docs, reps, depth_for(threshold, recall), threshold)
    labels = components(edges)
    per = per.groupBy("node").agg(F.sum("links").alias("n_links"))
    nodes = reps.select("node", "rep", "own_check", "copies").join(labels, "node", "left").join(per, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = nodes.filter("n_links > 0").groupBy("component").agg(F.min("rep").alias("class_id"))
    nodes = dealt_join(nodes, "component", least, F.col("node"), "left").select("node", "rep", "own_check", "component", F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("copies").alias("n_copies"))
    return sig.select("doc_id", "node", "check"), nodes


def _links_at(docs: DataFrame, reps: DataFrame, depth: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) that span the links, and (node, links), to be summed."""
    spark = docs.sparkSession
    prefix = F.shiftrightunsigned("label", 8 * (LEVELS - depth))
    entries = reps.select("node", "bytes", F.posexplode("labels").alias("tree", "label")).select("node", "bytes", "tree", prefix.alias("prefix"))
    full = entries.groupBy("tree", "prefix").agg(F.count("*").alias("n"), F.sum("bytes").alias("mass")).filter("n > 1")
    members = written(entries.drop("bytes").join(full, ["tree", "prefix"]), "members")  # few of the entries

    involved = members.select("node").distinct()
    some_reps = written(reps.join(involved, "node", "left_semi").select("node", "rep", "own_check", "labels"), "involved")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").alias("rep"), node_of(text).alias("node"), check_of(text).alias("own_check"), text.alias("text"))
    some = rows.alias("x").join(some_reps.select("node", "rep", "own_check").alias("y"), (F.col("x.node") == F.col("y.node")) & (F.col("x.own_check") == F.col("y.own_check")) & F.col("x.rep").eqNullSafe(F.col("y.rep")), "left_semi")
    texts = written(some.groupBy("node").agg(F.first("text").alias("text")), "texts")
    labels = some_reps.select("node", "labels")

    pairs = written(members.filter(F.col("n") <= SMALL).select("tree", "prefix", "node").join(labels, "node").groupBy("tree", "prefix").applyInArrow(_pairs_of(depth), _PAIRS), "pairs")  # written: one Python step a stage bounds memory
    small = written(_verify(pairs, texts, threshold), "links")

    blocks = F.ceil(F.greatest(F.col("n") / BLOCK_TEXTS, F.col("mass") / BLOCK_BYTES)).cast("int")
    large = members.filter(F.col("n") > SMALL).select("tree", "prefix", "node", blocks.alias("blocks")).withColumn("block", F.pmod(F.xxhash64("node", F.lit(depth)), F.col("blocks")).cast("int"))
    large = large.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select("tree", "prefix", "node", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    cells = large.join(texts.join(labels, "node"), "node").groupBy("tree", "prefix", "i", "j").applyInArrow(_block_links(depth, threshold), _BLOCKS)
    hot = written(cells, "blocks")

    ends = F.explode(F.array("a", "b"))
    counts = small.select(ends.alias("node"), F.lit(1).cast("long").alias("links")).union(hot.filter("links > 0").select(F.col("a").alias("node"), "links"))
    edges = small.select("a", "b").union(hot.filter("links = 0").select("a", "b"))
    removed(spark, members)
    removed(spark, pairs)
    removed(spark, some_reps)
    removed(spark, texts)
    return edges, counts


def without_near_copies(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each class: that of its least doc_id (null last), then of the least digest.

    Ids may be null or repeated over different texts; of rows equal in doc_id and text the least in the other
    columns stays. All columns stay as they are. A blocked Bloom filter tells rows that surely stay from those that
    may go; only the latter are shuffled with their texts, to an exact join.
    """
    spark = docs.sparkSession
    sig, nodes = _grouped(docs.select("doc_id", "text"), threshold, RECALL)
    first = nodes.groupBy("component").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "node")).alias("first"))
    alone = F.col("check") != F.col("own_check")  # another text, whatever its node says: it stays
    stays = alone | (F.col("node").eqNullSafe(F.col("first.node")) & F.col("doc_id").eqNullSafe(F.col("first.rep")))
    rows = sig.join(nodes.select("node", "own_check", "component", "n_copies").join(first, "component"), "node").select("doc_id", "node", "check", "n_copies", stays.alias("stays"))
    found = written(rows.filter("not stays or n_copies > 1").groupBy("doc_id", "node", "check").agg(F.bool_and("stays").alias("stays"), F.count("*").alias("n")).filter("not stays or n > 1"), "classes")
    removed(spark, rows)
    bloom = built(found.select(F.xxhash64("doc_id", "node", "check").alias("row")), "row", MOST_BLOCKS)
    text = F.coalesce("text", F.lit(""))
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])  # one column, so that no name of theirs meets one of ours
    order = F.struct(F.lit(0), *[F.col(f"`{f.name}`") for f in docs.schema.fields if f.name != "text" and not isinstance(f.dataType, (T.MapType, T.VariantType))])
    named = docs.select(own.alias("row"), order.alias("order"), F.col("doc_id").alias("id"), node_of(text).alias("node"), check_of(text).alias("check"))
    named = named.withColumn("may_go", passes(spark, bloom, F.xxhash64("id", "node", "check")))
    gone = found.filter("not stays").select(F.col("doc_id").alias("gone_id"), F.col("node").alias("gone_node"), F.col("check").alias("gone_check"))
    same = F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("node") == F.col("gone_node")) & (F.col("check") == F.col("gone_check"))
    left = named.filter("may_go").join(gone.hint("shuffle_hash"), same, "left_anti")
    once = left.groupBy("id", "node", "check").agg(F.min_by("row", "order").alias("row"))
    return named.filter("not may_go").select("row").unionAll(once.select("row")).select(*[F.col(f"row.`{c}`") for c in docs.columns])
