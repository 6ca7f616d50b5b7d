"""Hard negatives by a vertical scan: rows of another label whose score is near a positive's, without most of their products.

Vectors of whole numbers are stored in slabs by dimension. An anchor reads a slab's
dimensions in the order of its own components' size, some at a time. What the
dimensions left can add lies between two bounds, from their least and greatest
value in the slab; rows whose bounds leave every wanted window drop out of a bitmap,
and only the rest is read on. Two scans: the first finds an anchor's positives
(the window is open above, and its lower end rises with what was found); the second
finds, for each positive, rows of another label with a score from 80 % of the
positive's up to it. Bounds only ever drop rows that can't be in the result, so
this is exact.

Anchors go in blocks of ``ANCHORS`` rows, each of which meets all slabs; only a block
with its positives is on the driver, so its size doesn't grow with the data. A task
keeps the best few of each window over all of its slabs before it sends them, and
what tasks send is put in order by anchor and positive: as many rows as there are
tasks, times the few asked for.

Equal scores go by smaller id. A row is never held against rows of its own id.
Repeated rows are rows of their own, as positives, negatives and anchors. Shorter
vectors count as if zeros followed. Scores that 64 bits can't hold become the
greatest or least long. An anchor without positives, or a positive without a row in
its window, gives no row, and an empty table an empty one. Rows with null ids or labels
take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shared_dir

#: Positives of an anchor, negatives of a positive; percent of the positive's score that a negative has at least.
POSITIVES = 5
NEGATIVES = 5
LEAST_PERCENT = 80
#: Rows of a slab, anchors of a block, dimensions that are read between two prunings.
SLAB = 16_384
ANCHORS = 4_096
STEP = 8


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def _dense(vectors: pa.Array, dims: int) -> np.ndarray:
    """Rows of equal length from lists, with zeros behind short ones."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    size = pa.compute.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(size), dims), np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def slabs(rows: DataFrame) -> DataFrame:
    """Written table of slabs of ``rows`` (id, vector, label): ids, labels, and the dimensions one after the other, in longs or, where they fit, half of that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), SLAB):
                part = batch[a : a + SLAB]
                dims = pa.compute.max(pa.compute.list_value_length(part.column(1))).as_py()
                by_dim = np.ascontiguousarray(_dense(part.column(1), dims).T)
                small = not by_dim.size or (int(by_dim.max()) < 1 << 31 and int(by_dim.min()) >= -(1 << 31))
                made = [part.column(k).to_numpy(zero_copy_only=False).astype("<i8").tobytes() for k in (0, 2)]
                made.append(by_dim.astype("<i4" if small else "<i8").tobytes())
                yield pa.RecordBatch.from_arrays([*[pa.array([m], pa.binary()) for m in made], pa.array([dims], pa.int32()), pa.array([small])], names=["ids", "labels", "values", "dims", "small"])

    return materialize(rows.select("id", "vector", F.col("label").cast("long")).mapInArrow(run, "ids binary, labels binary, values binary, dims int, small boolean"))


class Slab(NamedTuple):
    """Rows by dimension, and each dimension's least and greatest value, all in the kind of number that products are exact in."""

    ids: np.ndarray
    labels: np.ndarray
    values: np.ndarray
    least: np.ndarray
    most: np.ndarray

    @staticmethod
    def read(ids: bytes, labels: bytes, values: bytes, dims: int, small: bool, reach: list[int]) -> Slab:
        """``reach``: greatest size of the queries' components. Floats while they hold the sums, else longs, else Python's numbers."""
        n = np.frombuffer(ids, "<i8")
        v = np.frombuffer(values, "<i4" if small else "<i8").reshape(dims, len(n))
        ends = [(int(x.min()), int(x.max())) for x in v] if len(n) else [(0, 0)] * dims
        bound = sum(r * max(-a, b) for r, (a, b) in zip(reach, ends, strict=False))
        kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 62 else object
        return Slab(n, np.frombuffer(labels, "<i8"), v.astype(kind), np.array([a for a, _ in ends], kind), np.array([b for _, b in ends], kind))


def scan(slab: Slab, query: np.ndarray, alive: np.ndarray, windows: list[tuple[float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the rows of bitmap ``alive`` whose score lies in one of ``windows`` (low, high)."""
    dims = min(len(query), len(slab.values))
    order = np.argsort(-np.abs(query[:dims].astype(np.float64)), kind="stable")
    q = query[order].astype(slab.values.dtype)
    a, b = q * slab.least[order], q * slab.most[order]
    least, most = _left(np.minimum(a, b)), _left(np.maximum(a, b))
    at = np.flatnonzero(alive)
    score = np.zeros(len(at), slab.values.dtype)
    read = 0
    for d in (*range(0, dims, STEP), dims):
        if read < d:
            use = order[read:d]
            part = slab.values[use] if len(at) == len(slab.ids) else slab.values[np.ix_(use, at)]
            score, read = score + q[read:d] @ part, d
        inside = np.zeros(len(at), bool)
        for low, high in windows:
            inside |= (score + most[d] >= low) & (score + least[d] <= high)
        at, score = at[inside], score[inside]
        if not len(at):
            break
    return at, score


def _left(x: np.ndarray) -> np.ndarray:
    """Sums from each place on, and 0 behind the last."""
    return np.append(np.cumsum(x[::-1])[::-1], np.zeros(1, x.dtype)).astype(x.dtype)


class Best(NamedTuple):
    """The first ``n`` by score and id of what has come so far."""

    n: int
    ids: list[int]
    scores: list[int]

    @property
    def floor(self) -> float:
        """A lower score than this can't come in."""
        return self.scores[-1] if len(self.scores) == self.n else -np.inf

    def add(self, ids: np.ndarray, scores: np.ndarray) -> Best:
        if not len(ids):
            return self
        if len(ids) > 4 * self.n and scores.dtype != object:
            some = scores >= np.partition(scores, len(scores) - self.n)[len(scores) - self.n]
            ids, scores = ids[some], scores[some]
        both = sorted([*zip([-s for s in self.scores], self.ids, strict=True), *zip([-int(s) for s in scores], ids.tolist(), strict=True)])[: self.n]
        return Best(self.n, [i for _, i in both], [-s for s, _ in both])


class Anchor(NamedTuple):
    """An anchor, and ids and scores of the positives that are known, best first."""

    id: int
    label: int
    vector: np.ndarray
    positives: tuple[tuple[int, int], ...] = ()


def _near(slab: Slab, anchor: Anchor, best: list[Best]) -> list[Best]:
    """First scan: one window, open above."""
    at, score = scan(slab, anchor.vector, (slab.labels == anchor.label) & (slab.ids != anchor.id), [(best[0].floor, np.inf)])
    return [best[0].add(slab.ids[at], score)]


def _hard(slab: Slab, anchor: Anchor, best: list[Best]) -> list[Best]:
    """Second scan: a window for each positive."""
    windows = [(max(-(-LEAST_PERCENT * s // 100), b.floor), s) for (_, s), b in zip(anchor.positives, best, strict=True)]
    if all(low > high for low, high in windows):
        return best
    at, score = scan(slab, anchor.vector, (slab.labels != anchor.label) & (slab.ids != anchor.id), [w for w in windows if w[0] <= w[1]])
    ids = slab.ids[at]
    inside = [(score >= low) & (score <= high) for low, high in windows]
    return [b.add(ids[i], score[i]) for b, i in zip(best, inside, strict=True)]


def _scanned(table: DataFrame, anchors: list[Anchor], step: Callable[[Slab, Anchor, list[Best]], list[Best]], n: int) -> DataFrame:
    """at (number of the anchor), place (number of its positive), id, score: the first ``n`` of each window that each task finds by ``step`` over all its slabs."""
    shared = table.sparkSession.sparkContext.broadcast(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        reach = [0] * max((len(a.vector) for a in block), default=0)
        for a in block:
            for d, x in enumerate(np.abs(a.vector.astype(object))):
                reach[d] = max(reach[d], x)
        best = [[Best(n, [], []) for _ in a.positives or (0,)] for a in block]
        for batch in batches:
            for i in range(len(batch)):
                slab = Slab.read(*[batch.column(k)[i].as_py() for k in range(5)], reach)
                for k, anchor in enumerate(block):
                    best[k] = step(slab, anchor, best[k])
        rows = [(k, p, i, max(-(1 << 63), min((1 << 63) - 1, s))) for k, windows in enumerate(best) for p, b in enumerate(windows) for i, s in zip(b.ids, b.scores, strict=True)]
        columns = zip(*rows, strict=True) if rows else [()] * 4
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["at", "place", "id", "score"])

    found = table.mapInArrow(run, "at int, place int, id long, score long")
    rank = F.row_number().over(Window.partitionBy("at", "place").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= n)


MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mined(rows: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of ``rows`` (id, vector of longs, label, anchor: whether it is one)."""
    spark = rows.sparkSession
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull()).select("id", "vector", F.col("label").cast("long").alias("label"), "anchor")
    table, path = slabs(rows), shared_dir(spark)
    spark.createDataFrame([], MINED).write.parquet(path)
    for block in _blocks(materialize(rows.filter("anchor"))):
        positives: dict[int, list[tuple[int, int]]] = {}
        near = _scanned(table, block, _near, POSITIVES).select("at", "rank", "id", "score").collect()  # POSITIVES rows for each anchor of the block
        for r in sorted(near):
            positives.setdefault(r["at"], []).append((r["id"], r["score"]))
        known = [a._replace(positives=tuple(positives[k])) for k, a in enumerate(block) if k in positives]
        pairs = spark.createDataFrame([(k, p, a.id, i, s) for k, a in enumerate(known) for p, (i, s) in enumerate(a.positives)], "at int, place int, anchor_id long, positive_id long, positive_score long")
        hard = _scanned(table, known, _hard, NEGATIVES).join(F.broadcast(pairs), ["at", "place"])  # as bounded as the block
        hard.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(path)
    return spark.read.schema(MINED).parquet(path)


def _blocks(anchors: DataFrame) -> Iterator[list[Anchor]]:
    """Anchors in blocks, one at a time on the driver."""
    block: list[Anchor] = []
    for r in anchors.toLocalIterator():
        block.append(Anchor(r["id"], r["label"], np.array(r["vector"], np.int64)))
        if len(block) == ANCHORS:
            yield block
            block = []
    if block:
        yield block
