"""Importance resampling: documents drawn by how much their word runs resemble a target's.

Each run of one to three words falls into one of ``BUCKETS`` by its CRC. An
Aho-Corasick automaton over a dictionary of distinct words, each between
delimiters and with its CRC and length as payload, scans the texts; the CRC of a
run is put together from the payloads of adjacent words, without its bytes
(appending n bytes to a text multiplies its CRC by x^8n over GF(2)). Words outside
of the dictionary get their payload from their bytes, so the dictionary, which is
taken from a bounded sample, changes the time needed and never a result.

Texts are scanned once: buckets are written, two bytes for each run, and counts
and weights read those. Counts are summed in each task before they meet. Ranks
come from a sort over ranges and the number of rows in each, so no task sees all
rows.

Null, empty and blank texts have no run, weight 0, and are not drawn. Equal scores
go by id, nulls last; a null id is drawn as the empty one. Repeated rows are rows
of their own, and count as often as they stand there. A text is held whole by its
task, with some 20 times its bytes while it is scanned. Without documents the
result is empty; without a target all of its counts are 0. Other columns, of
whatever name, are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, materialize, wrapped

#: Fixed values of the rule: buckets, longest run, fewest words of a document that may be drawn, percent of these, seed.
BUCKETS = 10_000
RUN = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
#: Rows whose words make the dictionary, about; words that it holds, and bytes of each, at most.
DICTIONARY_ROWS = 5_000
DICTIONARY_WORDS = 50_000
DICTIONARY_BYTES = 48
#: Bytes of text that are scanned together; a longer text is by itself.
CHUNK = 2 << 20
#: Fixed value: words, as a regular expression over lower-cased text.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Lengths in bytes up to this have a table of their own.
SHORT = 64

#: A-Z to lower case, ASCII other than letters and digits to a blank.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def _byte_table() -> np.ndarray:
    """What the CRC's register becomes for each low byte, by its polynomial in reversed bits."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


def _apply(tables: np.ndarray, c: np.ndarray) -> np.ndarray:
    """A linear map of ``c``, given by the images of each of its four bytes."""
    return tables[0][c & 255] ^ tables[1][(c >> 8) & 255] ^ tables[2][(c >> 16) & 255] ^ tables[3][c >> 24]


class Shift:
    """CRCs after a number of zero bytes: the map is linear, so tables by length for short ones and by powers of two for all others."""

    def __init__(self) -> None:
        step, c = _byte_table(), np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
        by_length = [c]
        for _ in range(SHORT):
            c = (c >> 8) ^ step[c & 255]
            by_length.append(c)
        self.by_length = np.stack(by_length)
        self.powers = [self.by_length[1]]
        for _ in range(31):
            last = self.powers[-1]
            self.powers.append(np.stack([_apply(last, last[k]) for k in range(4)]))

    def __call__(self, crc: np.ndarray, n: np.ndarray) -> np.ndarray:
        short = np.minimum(n, SHORT)
        t = self.by_length
        out = t[short, 0, crc & 255] ^ t[short, 1, (crc >> 8) & 255] ^ t[short, 2, (crc >> 16) & 255] ^ t[short, 3, crc >> 24]
        for i in np.flatnonzero(n > SHORT):
            c, left = crc[i : i + 1], int(n[i])
            for k in range(left.bit_length()):
                if left >> k & 1:
                    c = _apply(self.powers[k], c)
            out[i] = c[0]
        return out


class Scanner:
    """Words and runs of texts, by an automaton over ``words`` (bytes, of word characters alone)."""

    def __init__(self, words: list[bytes]) -> None:
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, w in enumerate(words):
            self.automaton.add_word(f" {w.decode('latin-1')} ", k)
        if words:
            self.automaton.make_automaton()
        self.crc = np.array([zlib.crc32(w) for w in words], np.uint32)
        self.shift = Shift()

    def payloads(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, length and CRC of each word of ``text``: plain, and with a blank at both ends."""
        inside = np.frombuffer(text, np.uint8) != 32
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        begin, end = edges[::2], edges[1::2]
        crc, known = np.zeros(len(begin), np.uint32), np.zeros(len(begin), bool)
        if len(self.crc) and len(begin):
            hits = np.fromiter(chain.from_iterable(self.automaton.iter(text.decode("latin-1"))), np.int64).reshape(-1, 2)
            at = np.searchsorted(end, hits[:, 0])  # a hit ends at the blank behind its word
            crc[at], known[at] = self.crc[hits[:, 1]], True
        other = np.flatnonzero(~known)
        crc[other] = [zlib.crc32(text[a:b]) for a, b in zip(begin[other].tolist(), end[other].tolist(), strict=True)]
        return begin, end - begin, crc

    def buckets(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words and runs of each text, and the buckets of all runs, text by text."""
        joined = b" " + b" ".join(texts) + b" "
        begin, size, crc = self.payloads(joined.translate(_PLAIN))
        first = 1 + np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
        text_of = np.searchsorted(first, begin, side="right") - 1
        n_words = np.bincount(text_of, minlength=len(texts))
        # a word behind a blank: the blank's CRC moved on by the word's length, and the word's own
        behind = self.shift(np.full(len(crc), zlib.crc32(b" "), np.uint32), size) ^ crc
        runs, there = np.zeros((len(crc), RUN), np.uint32), np.zeros((len(crc), RUN), bool)
        runs[:, 0], there[:, 0] = crc, True
        for k in range(1, RUN):
            runs[:-k, k] = self.shift(runs[:-k, k - 1], size[k:] + 1) ^ behind[k:]
            there[:-k, k] = text_of[k:] == text_of[:-k]
        return n_words, np.bincount(text_of, weights=there.sum(axis=1), minlength=len(texts)).astype(np.int64), (runs % BUCKETS).astype("<u2")[there]


def dictionary(docs: DataFrame) -> list[bytes]:
    """The most frequent words of about ``DICTIONARY_ROWS`` rows of ``docs`` (text), picked by hash."""
    share = min(1.0, DICTIONARY_ROWS / max(1, docs.count()))
    some = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.lit(math.ceil(share * (1 << 20))))
    words = some.select(F.explode(F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(WORD), F.lit(0))).alias("w")).filter(F.octet_length("w") <= DICTIONARY_BYTES)
    top = words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(DICTIONARY_WORDS)
    return [r["w"].encode() for r in top.select("w").collect()]


def bucketed(docs: DataFrame, words: list[bytes]) -> DataFrame:
    """``docs`` with ``_n_words``, ``_n_features`` and ``_buckets`` (two bytes for each run, low byte first) in place of ``_bytes``, its text as binary."""
    shared = docs.sparkSession.sparkContext.broadcast(words)
    kept = [c for c in docs.columns if c != "_bytes"]
    out = docs.select(*kept, F.lit(0).cast("long").alias("_n_words"), F.lit(0).cast("long").alias("_n_features"), F.lit(b"").alias("_buckets")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value)
        for batch in batches:
            texts, place = batch.column(batch.schema.names.index("_bytes")), [batch.schema.names.index(c) for c in kept]
            sizes = [s or 0 for s in pa.compute.binary_length(texts).to_pylist()]
            begin = 0
            while begin < len(texts):
                end, n = begin, 0
                while end < len(texts) and (end == begin or n + sizes[end] <= CHUNK):
                    n += sizes[end]
                    end += 1
                n_words, n_features, found = scanner.buckets([t or b"" for t in texts[begin:end].to_pylist()])
                cuts = np.append(0, 2 * np.cumsum(n_features))
                raw = found.tobytes()
                made = [pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), pa.array([raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())]
                yield pa.RecordBatch.from_arrays([*[batch.column(i)[begin:end] for i in place], *made], names=out.names)
                begin = end

    return docs.mapInArrow(run, out)


def _counts(rows: DataFrame) -> np.ndarray:
    """Runs in each bucket; every task sends one number for each bucket that it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for b in batch.column(0):
                total += np.bincount(np.frombuffer(b.as_py(), "<u2"), minlength=BUCKETS)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met], pa.int64())], names=["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in rows.select("_buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed shares in target and source, floored."""
    s_all, t_all = int(source.sum()), int(target.sum())
    ratios = zip(source.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + BUCKETS) / ((s + 1) * (t_all + BUCKETS)))) for s, t in ratios], np.int64)


def _weighed(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """``rows`` with ``_weight`` in place of the buckets."""
    shared = rows.sparkSession.sparkContext.broadcast(gain)
    kept = [c for c in rows.columns if c != "_buckets"]
    out = rows.select(*kept, F.lit(0).cast("long").alias("_weight")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = [batch.schema.names.index(c) for c in kept]
            weight = [int(shared.value[np.frombuffer(b.as_py(), "<u2")].sum()) for b in batch.column(batch.schema.names.index("_buckets"))]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in place], pa.array(weight, pa.int64())], names=out.names)

    return rows.mapInArrow(run, out)


def _gumbel(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variate, from the hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _scored(docs: DataFrame, target: DataFrame, keep: tuple[str, ...], seed: int) -> DataFrame:
    """Columns ``keep`` (doc_id among them) of ``docs``, _n_words, _n_features, _weight, _score, as a written table."""
    words = dictionary(docs)
    rows = materialize(bucketed(docs.select(*keep, F.col("text").cast("binary").alias("_bytes")), words))
    aims = materialize(bucketed(target.select(F.col("text").cast("binary").alias("_bytes")), words))
    weighed = _weighed(rows, gains(_counts(rows), _counts(aims)))
    return materialize(weighed.withColumn("_score", F.col("_weight") + _gumbel(F.col("doc_id"), seed)))


def _placed(scored: DataFrame, percent: int) -> tuple[DataFrame, int]:
    """doc_id, _n_features, _weight, _score and _rank (from 1, best first) of all rows, and how many of these are drawn.

    Rows are sorted over ranges once; a row's rank is its place in its range
    after the rows of the ranges before.
    """
    may = F.col("_n_words") >= LEAST_WORDS
    draws = percent * scored.filter(may).count() // 100
    placed = scored.select("doc_id", "_n_features", "_weight", "_score", may.alias("_may")).orderBy(F.desc("_may"), F.desc("_score"), F.asc_nulls_last("doc_id"))
    placed = materialize(placed.drop("_may").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)  # number of the range; the place within stands in the bits below
    before, offsets = 0, []
    for p, n in sorted(tuple(r) for r in placed.groupBy(part.alias("p")).count().collect()):  # a row for each range
        offsets.append((p, before))
        before += n
    known = scored.sparkSession.createDataFrame(offsets, "_p long, _before long")
    rank = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.join(F.broadcast(known), part == F.col("_p")).withColumn("_rank", rank), draws


def ranked(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank: one row for each row of ``docs`` (doc_id, text), ranks for the ``percent`` that are drawn; ``target`` has text."""
    rows, draws = _placed(_scored(docs, target, ("doc_id",), seed), percent)
    names = {"_n_features": "n_features", "_weight": "weight", "_score": "score"}
    return rows.select("doc_id", *[F.col(a).alias(b) for a, b in names.items()], F.when(F.col("_rank") <= draws, F.col("_rank")).alias("rank"))


def drawn(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns.

    Texts stay in place: the last draw's score and id are found among narrow rows,
    and bound the others. Rows that equal it in both are drawn with it.
    """
    scored = _scored(wrapped(docs, "text", "doc_id"), target, ("_row", "doc_id"), seed)
    rows, draws = _placed(scored, percent)
    last = rows.filter(F.col("_rank") == draws).first()
    if last is None:
        return scored.filter(F.lit(False)).select("_row.*")
    by_id = F.lit(True) if last["doc_id"] is None else F.col("doc_id") <= F.lit(last["doc_id"])
    reached = (F.col("_score") > last["_score"]) | ((F.col("_score") == last["_score"]) & by_id)
    return scored.filter((F.col("_n_words") >= LEAST_WORDS) & reached).select("_row.*")
