"""Hard-negative mining with a pivot table: brackets of scores from stored distances, exact products for what is left.

A row x becomes (x, sqrt(M - |x|^2)), M being the largest squared norm, and an anchor q becomes (q, 0). Then the
squared distance is |q|^2 + M - 2 q.x: the larger the product, the nearer. The table stores each row's distances
to a few pivots p. By the triangle inequality |d(q,p) - d(x,p)| <= d(q,x) <= d(q,p) + d(x,p), which brackets the
score of every pair; rows whose bracket can't reach an anchor's k best so far are left, the others are multiplied.

Rows are packed into blocks that are written once. Anchors go to the tasks in bounded groups, each of which is one
pass over the blocks; a task keeps the k best of an anchor and sends only those, so no pair is ever a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridex.llm.common import fresh_path, removed, ship, written

PIVOTS = 16
BLOCK_ROWS = 4096
#: Bytes of anchors that are sent to all tasks at a time.
GROUP_BYTES = 16 << 20
#: Matrix cells of one step inside a task.
CELLS = 1 << 21
BLOCKS = "ids binary, labels binary, values binary, dist binary"
SCORED = "anchor_no bigint, anchor_id bigint, part int, positive_id bigint, positive_score bigint, id bigint, score bigint"


def _squares(values: np.ndarray) -> np.ndarray:
    v = values.astype(np.float64)
    return np.einsum("ij,ij->i", v, v)


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros."""
    lengths = np.diff(np.asarray(column.offsets)).astype(np.int64)
    out = np.zeros((len(column), width), np.int64)
    out[np.repeat(np.arange(len(column)), lengths), np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = np.asarray(column.flatten())
    return out


def packed(rows: DataFrame, width: int, pivots: np.ndarray, longest: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The pivot table: blocks of rows (id, label, values) with their distances to the pivots."""
    own, rest = np.ascontiguousarray(pivots, np.float64), np.sqrt(np.maximum(longest - _squares(pivots), 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, block_rows):
                part = b.slice(k, block_rows)
                x = _matrix(part.column("values"), width)
                square = 2 * longest - 2 * (x @ own.T + np.sqrt(np.maximum(longest - _squares(x), 0))[:, None] * rest)
                near = np.argmin(square, axis=1) if len(own) else np.zeros(len(x), np.int64)
                order = np.argsort(near, kind="stable")  # neighbours are bracketed alike
                kept = [np.asarray(part.column(c)).astype(t)[order] for c, t in (("id", np.int64), ("label", np.int64))] + [x[order], np.sqrt(np.maximum(square, 0))[order]]
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in kept], names=["ids", "labels", "values", "dist"])

    return rows.mapInArrow(run, BLOCKS)


class Anchors:
    """A group of anchors: ids, labels, vectors, and their distances to the pivots."""

    def __init__(self, blocks: list, width: int, pivots: np.ndarray, longest: float, first: int):
        self.ids = np.concatenate([np.frombuffer(b.ids, np.int64) for b in blocks])
        self.labels = np.concatenate([np.frombuffer(b.labels, np.int64) for b in blocks])
        self.values = np.concatenate([np.frombuffer(b.values, np.int64).reshape(len(b.ids) // 8, width) for b in blocks])
        self.first, self.longest, self.reach = first, longest, _squares(self.values) + longest
        self.dist = np.sqrt(np.maximum(self.reach[:, None] - 2.0 * (self.values.astype(np.float64) @ pivots.T.astype(np.float64)), 0))
        self.slack = 1e-6 * np.maximum(self.reach, 1.0)  # distances are rounded
        self.largest = float(np.abs(self.values).max(initial=0))

    def bracket(self, which: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest possible score of the chosen anchors with rows of these distances."""
        near = np.zeros((len(which), len(dist)))
        far = np.full((len(which), len(dist)), np.inf)
        for p in range(dist.shape[1]):
            q, x = self.dist[which, p][:, None], dist[:, p][None, :]
            np.maximum(near, np.abs(q - x), out=near)
            np.minimum(far, q + x, out=far)
        reach, slack = self.reach[which][:, None] / 2, self.slack[which][:, None]
        return reach - far * far / 2 - slack, reach - near * near / 2 + slack

    def products(self, which: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchor places, rows and exact scores of the wanted pairs."""
        a, r = np.nonzero(wanted)
        if not len(a):
            return a, r, np.zeros(0, np.int64)
        safe = self.largest * float(np.abs(values).max(initial=0)) * max(values.shape[1], 1) < 2**53
        if safe and len(a) * 8 > wanted.size:  # most are wanted: one matrix product
            return a, r, (self.values[which].astype(np.float64) @ values.T.astype(np.float64))[a, r].astype(np.int64)
        out = np.empty(len(a), np.int64)
        for k in range(0, len(a), 1 << 16):
            s = slice(k, k + (1 << 16))
            out[s] = np.einsum("ij,ij->i", self.values[which[a[s]]], values[r[s]])
        return a, r, out


class Best:
    """The k best (score, then least id) of each of n searches so far."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, -np.inf)
        self.at, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        at, score, ids = (np.concatenate(x) for x in ((self.at, at), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, at))
        at, score, ids = at[order], score[order], ids[order]
        new = np.concatenate([[True], at[1:] != at[:-1]]) if len(at) else np.zeros(0, bool)
        rank = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        keep = rank < self.k
        self.at, self.score, self.id = at[keep], score[keep], ids[keep]
        full = rank == self.k - 1
        self.least[at[full]] = score[full]


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, -inf where there are fewer."""
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k] if values.shape[1] >= k else np.full(len(values), -np.inf)


def _rows(block: dict, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(block["ids"], np.int64)
    return ids, np.frombuffer(block["labels"], np.int64), np.frombuffer(block["values"], np.int64).reshape(len(ids), width), np.frombuffer(block["dist"], np.float64).reshape(len(ids), -1)


def _steps(batches: Iterator[pa.RecordBatch], width: int):
    for b in batches:
        for row in b.to_pylist():
            yield _rows(row, width)


def _sent(best: Best, anchors: Anchors, part: np.ndarray, owner: np.ndarray, positive: tuple[np.ndarray, np.ndarray] | None) -> pa.RecordBatch:
    who = owner[best.at]
    nothing = pa.nulls(len(who), pa.int64())
    columns = [
        pa.array(anchors.first + who), pa.array(anchors.ids[who]), pa.array(part[best.at].astype(np.int32)),
        pa.array(positive[0][best.at]) if positive else nothing, pa.array(positive[1][best.at]) if positive else nothing, pa.array(best.id), pa.array(best.score),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCORED.split(", ")])


def _positives(table: DataFrame, anchors: Anchors, width: int, k: int) -> DataFrame:
    """The k best rows of the anchor's label other than the anchor, of each task."""

    def run(batches):
        best, everyone = Best(len(anchors.ids), k), np.arange(len(anchors.ids))
        for ids, labels, values, dist in _steps(batches, width):
            for label in np.unique(labels):
                r, who = np.flatnonzero(labels == label), np.flatnonzero(anchors.labels == label)
                for c in range(0, len(who), max(1, CELLS // len(r))):
                    which = who[c : c + max(1, CELLS // len(r))]
                    low, high = anchors.bracket(which, dist[r])
                    other = ids[r][None, :] != anchors.ids[which][:, None]
                    bar = np.maximum(best.least[which], _kth(np.where(other, low, -np.inf), k))
                    a, x, score = anchors.products(which, values[r], other & (high >= bar[:, None]))
                    best.add(which[a], score, ids[r][x])
        yield _sent(best, anchors, np.zeros(len(everyone)), everyone, None)

    return table.mapInArrow(run, SCORED)


def _negatives(table: DataFrame, anchors: Anchors, width: int, k: int, positives: np.ndarray, low_percent: int, high_percent: int) -> DataFrame:
    """For each anchor and positive (anchor's place, rank, id, score), the k best rows of other labels within the band of scores, of each task."""
    owner, part, pid, score_of = positives
    by = np.argsort(owner, kind="stable")
    begin, end = np.searchsorted(owner[by], np.arange(len(anchors.ids))), np.searchsorted(owner[by], np.arange(len(anchors.ids)), side="right")
    most = int((end - begin).max(initial=0))
    whole = lambda values: np.array([min(max(v, -(2**63)), 2**63 - 1) for v in values], np.int64)
    from_, to = whole(-(-low_percent * int(s) // 100) for s in score_of), whole(high_percent * int(s) // 100 for s in score_of)

    def run(batches):
        best = Best(len(owner), k)
        for ids, labels, values, dist in _steps(batches, width):
            for c in range(0, len(anchors.ids), max(1, CELLS // len(ids))):
                which = np.arange(c, min(len(anchors.ids), c + max(1, CELLS // len(ids))))
                low, high = anchors.bracket(which, dist)
                other = labels[None, :] != anchors.labels[which][:, None]
                wanted, open_to = np.zeros(other.shape, bool), []
                for j in range(most):
                    has = np.flatnonzero(begin[which] + j < end[which])
                    q = by[begin[which[has]] + j]
                    sure = other[has] & (high[has] <= to[q, None]) & (low[has] >= from_[q, None])
                    bar = np.maximum(np.maximum(best.least[q], from_[q]), _kth(np.where(sure, low[has], -np.inf), k))
                    wanted[has] |= other[has] & (high[has] >= bar[:, None]) & (low[has] <= to[q, None])
                    open_to.append((has, q))
                a, x, score = anchors.products(which, values, wanted)
                for has, q in open_to:
                    place = np.full(len(which), -1)
                    place[has] = q
                    s = place[a]
                    ok = s >= 0
                    ok[ok] = (from_[s[ok]] <= score[ok]) & (score[ok] <= to[s[ok]]) & (score[ok] >= best.least[s[ok]])
                    best.add(s[ok], score[ok], ids[x[ok]])
        yield _sent(best, anchors, part, owner, (pid, score_of))

    return table.mapInArrow(run, SCORED)


def _ranked(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low_percent: int = 80, high_percent: int = 100, pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for each row that `anchor` holds for.

    rows: id bigint, label int, values array<bigint>. Scores are inner products, which must fit in a bigint;
    shorter vectors end in zeros. Rows with a null in id, label or values take no part. A row with the anchor's
    own id is not its positive. Repeated rows count one by one, an anchor that is there twice is searched twice. Equal
    scores go by id. Anchors without positives or negatives give no rows. Positives of an anchor number some few
    (the parameter), so each group's positives, like its anchors, are bounded by GROUP_BYTES.
    """
    spark = rows.sparkSession
    ship(spark)
    rows = rows.select(F.col("id").cast("bigint").alias("id"), F.col("label").cast("bigint").alias("label"), "values", F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = rows.filter("id is not null and label is not null and values is not null and not exists(values, v -> v is null)")
    square = F.aggregate("values", F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double"))
    longest, width = rows.agg(F.max(square), F.max(F.size("values"))).first()
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if longest is None:
        return spark.createDataFrame([], schema)
    digest = F.xxhash64("values")  # a pivot for each class of digests, so that pivots differ
    chosen = rows.groupBy(F.pmod(digest, F.lit(pivots)).alias("k")).agg(F.min_by("values", digest).alias("values")).orderBy("k").collect()
    points = np.array([list(r["values"]) + [0] * (width - len(r["values"])) for r in chosen], np.int64).reshape(len(chosen), width)
    table = written(packed(rows, width, points, longest, block_rows), "pivot-table")
    asked = written(packed(rows.filter("anchor"), width, points, longest, block_rows).select(F.monotonically_increasing_id().alias("block"), "*"), "anchors")
    sizes = asked.select("block", (F.octet_length("ids") / 8).cast("bigint").alias("n")).orderBy("block").collect()
    done, group, first = [], [], 0
    path = fresh_path(spark, "hard-negatives")
    for i, (block, n) in enumerate(sizes):
        group.append((block, n))
        together = sum(m for _, m in group) * (width + pivots + 8) * 8
        if i + 1 < len(sizes) and together + sizes[i + 1].n * (width + pivots + 8) * 8 <= GROUP_BYTES:
            continue
        anchors = Anchors(asked.filter(F.col("block").isin([b for b, _ in group])).orderBy("block").collect(), width, points, longest, first)
        found = _ranked(_positives(table, anchors, width, positives), ["anchor_no"], positives).select("anchor_no", "rank", "id", "score").toPandas()
        given = tuple(found[c].to_numpy(np.int64) - (first if c == "anchor_no" else 0) for c in ("anchor_no", "rank", "id", "score"))
        best = _ranked(_negatives(table, anchors, width, negatives, given, low_percent, high_percent), ["anchor_no", "part"], negatives)
        out = f"{path}/group={len(done)}"
        best.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.parquet(out)
        done.append(out)
        first += sum(m for _, m in group)
        group = []
    removed(spark, table)
    removed(spark, asked)
    return spark.read.schema(schema).parquet(*done) if done else spark.createDataFrame([], schema)


def mined(embeddings: DataFrame) -> DataFrame:
    """hard_negatives of a table (vec_id, embedding, label) as op13 wants it.

    Each component x is floor(256 x); rows with a null or non-finite component, or without label or vector, take
    no part; labels of ids divisible by 7 are shifted by one, so that some are wrong. Anchors: ids divisible by 100.
    """
    finite = "label is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("bigint"))
    return hard_negatives(embeddings.filter(finite).select(F.col("vec_id").alias("id"), label.alias("label"), whole.alias("values")), F.col("id") % 100 == 0)
