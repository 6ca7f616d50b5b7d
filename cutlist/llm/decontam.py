"""Benchmark decontamination over suffix arrays of the training text.

Each batch of documents is a shard. Its words are coded by the benchmark's
vocabulary (0 for a word that no benchmark text has), and the suffixes that can
match - those whose first words all have a code - are sorted by their first
``WINDOW`` words into a suffix array. Every benchmark suffix is then looked up
by binary search; the range of equal suffixes gives all its occurrences. From
these come the hit words and the items of a document, each once, so repeated
words make no product of occurrences and benchmark places. Longest verbatim
matches are read off a suffix array of the benchmark's windows: from the first
hit of a stretch the longest match is taken, then from its end on the next.

Only documents are partitioned; no row is shuffled. The benchmark is read to
the driver in blocks of at most ``BLOCK_WORDS`` words. Each block is indexed once,
as sorted arrays, and sent to all executors, so what is broadcast is bounded;
further blocks are further passes over written rows.

Defined results: null and wordless documents have no words and no hits; a
benchmark item with no words has no window; rows are judged one by one, so
repeated rows get equal results; items with equal ids count once for a document;
null item ids are left out of ``items``, though their windows count as hits; of
several places of the benchmark that match equally long one is named; a text of
any length is taken whole, as a shard of its own if it is long; an empty table
of documents gives an empty table, an empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, sha256_hex, wrapped

WINDOW = 10
#: Words of benchmark text that one block holds: under 200 bytes each in its index, and as much again for each different word.
BLOCK_WORDS = 1_000_000
#: Words of training text in one shard, unless a single document has more.
SHARD_WORDS = 400_000
#: Bytes of words stay (upper case to lower), all others are blanks.
_TABLE = bytes(b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def suffix_array(values: np.ndarray) -> np.ndarray:
    """Places of the suffixes of ``values`` in order, by doubling the length that ranks tell apart."""
    rank = np.unique(values, return_inverse=True)[1].astype(np.int64)
    n, step = len(values), 1
    order = np.argsort(rank, kind="stable")
    while n and rank.max() < n - 1 and step < n:
        then = np.zeros(n, np.int64)
        then[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + then
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        step *= 2
    return order


class Windows:
    """The windows of one block of benchmark items, coded by a vocabulary of their own, as sorted arrays."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.vocabulary: dict[bytes, int] = {}
        self.item_ids = [item for item, _ in items]
        coded = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in split_words(t)], np.int32) for _, t in items]
        parts, owner, offset = [np.zeros((0, WINDOW), np.int32)], [], []
        for k, codes in enumerate(coded):
            if len(codes) >= WINDOW:
                rows = np.lib.stride_tricks.sliding_window_view(codes, WINDOW)
            elif len(codes):
                rows = np.pad(codes, (0, WINDOW - len(codes)))[None]
            else:
                continue
            parts.append(rows)
            owner.append(np.full(len(rows), k, np.int32))
            offset.append(np.arange(len(rows), dtype=np.int32))
        rows, of = np.unique(np.concatenate(parts), axis=0, return_inverse=True)
        of = of.reshape(-1)
        self.sizes = (rows > 0).sum(axis=1)
        self.shortest = int(self.sizes.min()) if len(rows) else WINDOW
        self.width = max(1, 63 // max(1, int(len(self.vocabulary) + 1).bit_length()))
        self.low = self._packed(rows.astype(np.int64))
        self.high = self._packed(np.where(rows > 0, rows, len(self.vocabulary) + 1).astype(np.int64))
        # items of each window, and the windows of each item in a row, parted by -1
        owners = np.concatenate(owner) if owner else np.zeros(0, np.int32)
        pairs = np.unique(np.stack([of, owners], axis=1), axis=0) if len(of) else np.zeros((0, 2), np.int64)
        self.item_begin = np.searchsorted(pairs[:, 0], np.arange(len(rows) + 1))
        self.item_of = pairs[:, 1].astype(np.int32)
        ends = np.cumsum([len(o) for o in owner])[:-1] if owner else []
        self.places = np.insert(of.astype(np.int32), ends, -1) if len(of) else np.zeros(0, np.int32)
        self.place_item = np.insert(owners, ends, -1) if len(of) else owners
        self.place_offset = np.insert(np.concatenate(offset), ends, -1) if len(of) else owners
        self.order = suffix_array(self.places).astype(np.int32)

    def __len__(self) -> int:
        return len(self.sizes)

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window numbers and start positions of all occurrences in one shard, by position; documents are parted by a 0."""
        none = np.zeros(0, np.int64)
        if not len(self):
            return none, none
        # known[i]: how many words from i on have a code, as far as the next 0
        stops = np.flatnonzero(codes == 0)
        ends = np.append(stops, len(codes))
        known = ends[np.searchsorted(stops, np.arange(len(codes)))] - np.arange(len(codes))
        at = np.flatnonzero(known >= self.shortest)
        if not len(at):
            return none, none
        padded = np.concatenate([codes, np.zeros(WINDOW, codes.dtype)])
        keys = self._packed(self._cut(padded[at[:, None] + np.arange(WINDOW)]))
        order = np.lexsort(keys[::-1])
        array, keys = at[order], [k[order] for k in keys]
        first, last = self._bound(keys, self.low, "left"), self._bound(keys, self.high, "right")
        count = last - first
        window = np.repeat(np.arange(len(self)), count)
        where = array[np.repeat(first - np.cumsum(count) + count, count) + np.arange(len(window))]
        order = np.argsort(where, kind="stable")
        return window[order], where[order]

    @staticmethod
    def _cut(columns: np.ndarray) -> np.ndarray:
        """Nothing after a document's end or an unknown word is compared."""
        return columns * np.logical_and.accumulate(columns > 0, axis=1)

    def _packed(self, columns: np.ndarray) -> list[np.ndarray]:
        bits = int(len(self.vocabulary) + 1).bit_length()
        keys = []
        for i in range(0, WINDOW, self.width):
            key = np.zeros(len(columns), np.int64)
            for j in range(i, min(WINDOW, i + self.width)):
                key = (key << bits) | columns[:, j]
            keys.append(key)
        return keys

    @staticmethod
    def _bound(keys: list[np.ndarray], query: list[np.ndarray], side: str) -> np.ndarray:
        lo = np.zeros(len(query[0]), np.int64)
        hi = np.full(len(query[0]), len(keys[0]), np.int64)
        while (open_ := lo < hi).any():
            mid = np.where(open_, (lo + hi) // 2, 0)
            less, same = np.zeros(len(lo), bool), np.ones(len(lo), bool)
            for k, q in zip(keys, query, strict=True):
                v = k[mid]
                less |= same & (v < q)
                same &= v == q
            go = less | same if side == "right" else less
            lo, hi = np.where(open_ & go, mid + 1, lo), np.where(open_ & ~go, mid, hi)
        return lo

    def longest(self, run: np.ndarray, at: int) -> tuple[int, int]:
        """How many of the windows of ``run`` from ``at`` on some item has in a row at most, and the place there."""
        lo, hi, best = 0, len(self.order), (0, 0)
        while lo < hi:
            mid = (lo + hi) // 2
            place = int(self.order[mid])
            n = _common(run, at, self.places, place)
            best = max(best, (n, place), key=lambda b: b[0])
            x = run[at + n] if at + n < len(run) else -2
            y = self.places[place + n] if place + n < len(self.places) else -2
            lo, hi = (mid + 1, hi) if x > y else (lo, mid)
        return best


def _common(a: np.ndarray, i: int, b: np.ndarray, j: int) -> int:
    """Length of the common beginning of a[i:] and b[j:]."""
    n, step = 0, 16
    while True:
        x, y = a[i + n : i + n + step], b[j + n : j + n + step]
        k = min(len(x), len(y))
        differ = np.flatnonzero(x[:k] != y[:k])
        if len(differ):
            return n + int(differ[0])
        n += k
        if k < step:
            return n
        step *= 2


def _judged(windows: Windows, window: np.ndarray, where: np.ndarray) -> tuple[list[dict], list[int], list[dict]]:
    """Hit word ranges, item ids and longest matches of one document, from its occurrences by position."""
    end = where + windows.sizes[window]
    reach = np.maximum.accumulate(end)
    new = np.flatnonzero(np.append(True, where[1:] > reach[:-1]))
    spans = [{"start": int(where[i]), "end": int(reach[j])} for i, j in zip(new, np.append(new[1:], len(where)) - 1, strict=True)]
    seen = np.unique(window)
    begin, count = windows.item_begin[seen], windows.item_begin[seen + 1] - windows.item_begin[seen]
    items = np.unique(windows.item_of[np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())])
    ids = sorted({windows.item_ids[i] for i in items} - {None})
    whole = windows.sizes[window] == WINDOW
    found = [(int(p), int(e), int(windows.item_of[windows.item_begin[w]]), 0) for p, e, w in zip(where[~whole], end[~whole], window[~whole], strict=True)]
    run, places = window[whole].astype(np.int32), where[whole]
    cuts = np.flatnonzero(np.diff(places) != 1) + 1
    for part, begin_ in zip(np.split(run, cuts), np.split(places, cuts), strict=True):
        at = 0
        while at < len(part):
            n, place = windows.longest(part, at)
            start = int(begin_[at])
            found.append((start, start + n + WINDOW - 1, int(windows.place_item[place]), int(windows.place_offset[place])))
            at += n
    matches = [{"start": a, "end": b, "item_id": windows.item_ids[i], "item_start": o} for a, b, i, o in sorted(found)]
    return spans, ids, matches


def _marked(windows: Windows, texts: list[str | None]) -> Iterator[tuple[int, list, list, list]]:
    """For each text: word count, hit ranges, item ids and longest matches."""
    get = windows.vocabulary.get
    coded = [np.array([get(w, 0) for w in split_words(t)], np.int32) for t in texts]
    begin = 0
    while begin < len(coded):
        end, n = begin, 0
        while end < len(coded) and (end == begin or n + len(coded[end]) <= SHARD_WORDS):
            n += len(coded[end])
            end += 1
        shard = coded[begin:end]
        starts = np.cumsum([0, *[len(c) + 1 for c in shard]])
        codes = np.concatenate([np.append(c, 0) for c in shard]).astype(np.int64)
        window, where = windows.find(codes)
        bounds = np.searchsorted(where, starts)
        for d, c in enumerate(shard):
            lo, hi = bounds[d], bounds[d + 1]
            yield (len(c), *(_judged(windows, window[lo:hi], where[lo:hi] - starts[d]) if hi > lo else ([], [], [])))
        begin = end


RANGE = "array<struct<start:int,end:int>>"
ITEMS = "array<bigint>"
MATCH = "array<struct<start:int,end:int,item_id:bigint,item_start:int>>"


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str | None]]]:
    block, n = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        size = len(split_words(row["text"]))
        if block and n + size > BLOCK_WORDS:
            yield block
            block, n = [], 0
        block.append((row["item_id"], row["text"]))
        n += size
    if block:
        yield block


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with ``_n_words``, ``_hits`` (ranges of hit words), ``_items`` (ids) and ``_matches``: the longest verbatim matches of benchmark text, by word position."""
    out = docs.withColumn("_n_words", F.lit(None).cast("long"))
    for name, kind in (("_hits", RANGE), ("_items", ITEMS), ("_matches", MATCH)):
        out = out.withColumn(name, F.expr(f"cast(array() as {kind})"))
    blocks = _blocks(benchmark)
    block: list | None = next(blocks, [])
    while True:
        out = _pass(out, block)
        block = next(blocks, None)
        if block is None:
            return out
        out = materialize(out)


def _pass(docs: DataFrame, block: list) -> DataFrame:
    """What one block finds, added to the columns. Other columns stay in Arrow as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(Windows(block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        for batch in batches:
            names = batch.schema.names
            found = list(_marked(windows, batch.column(names.index("text")).to_pylist()))
            put = {"_n_words": [f[0] for f in found]}
            for k, name in enumerate(("_hits", "_items", "_matches"), 1):
                put[name] = [b + f[k] for b, f in zip(batch.column(names.index(name)).to_pylist(), found, strict=True)]
            columns = [pa.array(put[f.name], f.type) if f.name in put else batch.column(i) for i, f in enumerate(batch.schema)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def judged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and the matches, a row for each row of ``docs``."""
    found = matches(docs.select("doc_id", "text"), benchmark)
    hit = F.expr(
        "aggregate(array_sort(transform(_hits, m -> struct(m.start as s, m.end as e))), struct(0 as upto, 0L as n),"
        " (a, m) -> struct(greatest(a.upto, m.e) as upto, a.n + greatest(0, m.e - greatest(a.upto, m.s)) as n), a -> a.n)"
    )
    items = F.expr("array_sort(transform(array_distinct(_items), i -> cast(i as string)))")
    return found.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        sha256_hex(F.array_join(items, ",")).alias("items_sha256"),
        (F.size("_hits") > 0).alias("contaminated"),
        F.col("_matches").alias("matches"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` that hold no benchmark window, with all their columns."""
    return matches(wrapped(docs, "text"), benchmark).filter(F.size("_hits") == 0).select("_row.*")
