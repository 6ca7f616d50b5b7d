"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

Voters come from word lists and patterns; each votes toxic, clean, or not at
all. Words and
beginnings of words are listed by labelled rows, or stand in a short fixed list. The label model knows no labels: it estimates, by expectation
maximisation, how often each voter votes what for either class, then how far
voters agree beyond that, and lets each speak with the weight of its independent
part. The linear classifier is trained on the posterior labels,
over the words and beginnings of words of a text; two numbers then calibrate its scores on labels.

Training reads at most about ``TRAIN_ROWS`` labelled rows, by hash of their id;
rows held out by ``held_out`` are never among them. The score of a text depends
on its words alone.

Defined results: null and empty texts get the score of the bias; labels that are
null, or whose id is, are left out; an id with several labels counts as toxic if
one says so; with labels of one class alone every score is near that class, and
without any near 0; texts of any length are read whole, and train by the distinct words
they have, not by how often; of labelled rows that share an id the least text trains;
repeated rows get equal scores; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .decontam import split_words

TRAIN_ROWS = 6_000
THRESHOLD = 0.3
LIST_WORDS = 96
FEATURES = 300
#: Tokens that features are chosen among, at most; only their counts and rows come to the driver.
CANDIDATES = 5_000
#: Log ratio of rates that a listed token has at least.
PURE = 2.0
#: Lengths of word beginnings that are tokens.
PREFIXES = range(3, 8)
#: Residual correlation below which two voters count as independent.
CORRELATED = 0.2
#: The same before the classes are known, when all voters of one class agree somewhat.
ALIKE = 0.8
#: Common insults, for tables whose labels name none.
INSULTS = frozenset(b"idiot moron stupid loser pathetic worthless disgusting trash scum clown dumb fool ugly vermin filth creep bastard jerk imbecile degenerate".split())
_MASKED = re.compile(r"[A-Za-z][*#@$!]{2,}[A-Za-z]")
_SHOUT = re.compile(r"[A-Z]{3,}!{1,}")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def tokens(text: str | None) -> set[bytes]:
    """Distinct words, their beginnings (``^``), and beginnings that two or four distinct words have (``2^``, ``4^``)."""
    words = set(split_words(text))
    starts: Counter = Counter()
    for w in words:
        word = w.decode("utf-8", "replace")
        starts.update(word[:k] for k in PREFIXES if len(word) >= k)
    out = set(words)
    for p, n in starts.items():
        mark = p.encode()
        out.add(b"^" + mark)
        if n > 1:
            out.add(b"2^" + mark)
        if n > 3:
            out.add(b"4^" + mark)
    return out


def _low(c, rest, n_pos: int, n_neg: int, log, sqrt):
    """Lower bound of the log ratio of a token's rates in toxic and other rows, of numbers or columns: rare tokens need a purer record."""
    return log((c + 0.5) / (n_pos + 1)) - log((rest + 0.5) / (n_neg + 1)) - 1.3 * sqrt(1 / (c + 0.5) + 1 / (rest + 0.5))


def _tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, toxic, token for each distinct token of each row (doc_id, toxic, text)."""
    for batch in batches:
        found = [sorted(tokens(t)) for t in batch.column(2).to_pylist()]
        at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
        flat = pa.array([w for f in found for w in f], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), flat], names=["doc_id", "toxic", "token"])


def candidates(rows: DataFrame, n_pos: int, n_neg: int) -> list[tuple[bytes, list[int], int]]:
    """Tokens that stand in toxic rows far more often, with the ids of the toxic rows that have them and the number of others.

    Counted by Spark over whole texts; of those beyond ``CANDIDATES`` the strongest come to the driver.
    """
    each = rows.select("doc_id", "toxic", "text").mapInArrow(_tokens_of, "doc_id bigint, toxic boolean, token binary")
    count = each.groupBy("token").agg(F.count_if("toxic").alias("c"), F.count_if(~F.col("toxic")).alias("rest")).filter("c > 2")
    count = count.withColumn("low", _low(F.col("c"), F.col("rest"), n_pos, n_neg, F.log, F.sqrt)).filter(F.col("low") > PURE)
    able = materialize(count.orderBy(F.desc(F.col("low") * F.col("c")), "token").limit(CANDIDATES).select("token", "rest"))
    held = each.filter("toxic").join(F.broadcast(able), "token").groupBy("token", "rest").agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))
    return sorted((bytes(r["token"]), r["ids"], r["rest"]) for r in held.collect())


def listed_tokens(found: list[tuple[bytes, list[int], int]], n_pos: int, n_neg: int) -> tuple[list[bytes], list[bytes]]:
    """Of the ``candidates``, the strongest as voters, and all that may be features."""
    lows = {w: _low(len(ids), rest, n_pos, n_neg, np.log, np.sqrt) for w, ids, rest in found}
    place = {i: k for k, i in enumerate(sorted({i for _, ids, _ in found for i in ids}))}
    holders = {w: [place[i] for i in ids] for w, ids, _ in found}
    rows: list[set[bytes]] = [set() for _ in place]
    for w, h in holders.items():
        for i in h:
            rows[i].add(w)
    # greedily, by what a token adds: rows count the less the more of the chosen tokens they have
    worth: Counter = Counter()
    seen = np.zeros(len(rows))
    alike: dict[tuple[int, ...], bytes] = {}
    for w, h in holders.items():  # of tokens in the same rows, the longest word stands for all
        alike[tuple(h)] = max(alike.get(tuple(h), b"^"), w, key=lambda v: (b"^" not in v, len(v), v))
    for h, w in alike.items():
        worth[w] = len(h)
    chosen: list[bytes] = []
    while worth and len(chosen) < FEATURES:
        w = max(worth, key=lambda w: (lows[w] * worth[w], len(w), w))
        if worth[w] < 1:
            break
        chosen.append(w)
        del worth[w]
        for i in holders[w]:
            lost = 0.3 * 0.7 ** seen[i]
            seen[i] += 1
            for v in rows[i] & worth.keys():
                worth[v] -= lost
    return chosen[:LIST_WORDS], chosen


def votes(rows: list[set[bytes]], listed: list[bytes], masked: list[bool], shouts: list[bool]) -> np.ndarray:
    """Votes of all voters on each row, known by its tokens of interest and two patterns: 1 toxic, 0 clean, -1 none.

    A voter for each listed token, then lists (insults; two, three or none of
    the listed), and patterns (masked words; shouting beside a listed token).
    """
    lists = frozenset(listed)
    out = np.full((len(rows), len(listed) + 7), -1, np.int8)
    for i, have in enumerate(rows):
        hits, insults = lists & have, INSULTS & have
        for j, w in enumerate(listed):
            if w in hits:
                out[i, j] = 1
        out[i, len(listed) :] = [
            1 if insults else -1,
            1 if len(hits) > 1 else -1,
            1 if len(hits) > 2 else -1,
            -1 if hits else 0,
            -1 if insults or hits else 0,
            1 if masked[i] and hits else -1,
            1 if shouts[i] and hits else -1,
        ]
    return out


def posterior(vote: np.ndarray, share: float, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Probability of the toxic class for each row, and each voter's weight, by expectation maximisation.

    A voter's table holds the chances of its three votes for either class. The
    start takes it that voters are better than chance.
    """
    n, m = vote.shape
    table = np.empty((m, 3, 2))
    for j in range(m):
        seen = np.array([np.mean(vote[:, j] == v) for v in (-1, 0, 1)]) + 1e-3
        table[j, :, 0] = table[j, :, 1] = seen
        table[j, 2] *= (0.5, 2.0)
        table[j, 1] *= (1.2, 0.4)
    table /= table.sum(axis=1, keepdims=True)
    weight, p = np.ones(m), np.full(n, share)
    index = vote.astype(int) + 1
    for k in range(rounds):
        logs = np.log(table)
        margin = np.log(share / (1 - share)) + sum(weight[j] * (logs[j, index[:, j], 1] - logs[j, index[:, j], 0]) for j in range(m))
        p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        for j in range(m):
            for v in range(3):
                at = index[:, j] == v
                table[j, v, 1] = (p[at].sum() + 0.1) / (p.sum() + 0.3)
                table[j, v, 0] = ((1 - p[at]).sum() + 0.1) / ((1 - p).sum() + 0.3)
        share = float(np.clip(p.mean(), 0.005, 0.6))
        if k in (0, rounds // 2):  # at first only voters that say nearly the same, which would else pass for the class itself
            weight = _independent(vote, table, p, CORRELATED if k else ALIKE)
    return p, weight


def _independent(vote: np.ndarray, table: np.ndarray, p: np.ndarray, least: float) -> np.ndarray:
    """The independent part of each voter: one over the sum of its correlations with all voters, given the class.

    Correlations are of what is left of the votes once each class' expectation
    is taken off; those below ``least`` count as chance.
    """
    said = (vote >= 0).astype(float)
    expect = (1 - table[:, 0, 1])[None] * p[:, None] + (1 - table[:, 0, 0])[None] * (1 - p)[:, None]
    rest = said - expect
    scale = np.sqrt((rest**2).mean(axis=0)) + 1e-6
    corr = np.abs((rest.T @ rest) / len(rest) / np.outer(scale, scale))
    np.fill_diagonal(corr, 1.0)
    return 1 / np.where(corr > least, corr, 0).sum(axis=1)


@dataclass
class Model:
    weights: dict[bytes, float]
    bias: float
    scale: float = 1.0
    shift: float = 0.0

    def scores(self, texts: list[str | None]) -> list[float]:
        words = {w for w in self.weights if b"^" not in w}
        starts = {w.split(b"^")[1].decode() for w in self.weights if b"^" in w}
        heads = {p.encode()[:3] for p in starts}
        lengths = sorted({len(p) for p in starts})
        margins = []
        for text in texts:
            have = set(split_words(text))
            total = self.bias + sum(self.weights[w] for w in words & have)
            seen: Counter = Counter()
            for w in have:
                if w[:3] in heads:
                    word = w.decode("utf-8", "replace")
                    seen.update(p for k in lengths if len(word) >= k and (p := word[:k]) in starts)
            for p, n in seen.items():
                mark = p.encode()
                for least, sign in ((1, b"^"), (2, b"2^"), (4, b"4^")):
                    if n >= least:
                        total += self.weights.get(sign + mark, 0.0)
            margins.append(total)
        return (1 / (1 + np.exp(-np.clip(self.scale * np.array(margins) + self.shift, -30, 30)))).tolist() if margins else []


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int = 25) -> np.ndarray:
    """Weights of ridge logistic regression on soft labels by Newton's method; the last column of ``x`` is the bias."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    return w


def train(chosen: list[bytes], listed: list[bytes], rows: list[tuple[bool, bool, bool, list[int]]]) -> Model:
    """A model from rows of toxic, masked, shouts and the places of the tokens in ``chosen`` that a text has."""
    toxic = np.array([r[0] for r in rows], bool)
    have = [{chosen[j] for j in r[3]} for r in rows]
    vote = votes(have, listed, [r[1] for r in rows], [r[2] for r in rows])
    soft, _ = posterior(vote, float(toxic.mean()))
    x = np.zeros((len(rows), len(chosen) + 1))
    x[:, -1] = 1
    for i, r in enumerate(rows):
        x[i, r[3]] = 1
    w = _logistic(x, soft, ridge=1.0)
    margin = x @ w
    scale, shift = _logistic(np.stack([margin, np.ones(len(margin))], axis=1), toxic.astype(float), ridge=1e-3)
    weights = {word: float(w[j]) for j, word in enumerate(chosen) if abs(w[j]) > 1e-4}
    return Model(weights, float(w[-1]), float(max(scale, 1e-3)), float(shift))


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    """A model for ``docs`` (doc_id, text) from ``labels`` (doc_id, toxic).

    Ids are picked first, so that only the picked rows' texts move, one for each
    id: the least, if several share it. Texts stay with Spark: what comes to the
    driver is the candidates' rows, then for each row which of the chosen tokens
    it has.
    """
    usable = labels.select("doc_id", "toxic").dropna().filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = usable.count()
    bound = int(min(1.0, TRAIN_ROWS / max(1, n)) * (1 << 63))
    picked = usable.filter(F.shiftrightunsigned(F.xxhash64("doc_id"), 1) <= F.lit(min(bound, (1 << 63) - 1)))
    # TRAIN_ROWS bounds what is sent
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = materialize(rows.select("doc_id", (F.col("toxic") != 0).alias("toxic"), "text"))
    share = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_pos, n_neg = share.get(True, 0), share.get(False, 0)
    if not n_pos or not n_neg:
        return Model({}, 30.0 if n_pos else -30.0)
    listed, chosen = listed_tokens(candidates(rows, n_pos, n_neg), n_pos, n_neg)
    chosen = sorted({*chosen, *INSULTS})
    place = {w: j for j, w in enumerate(chosen)}

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            have = pa.array([sorted(place[w] for w in place.keys() & tokens(t)) for t in texts], pa.list_(pa.int32()))
            flags = [pa.array([bool(p.search(t or "")) for t in texts], pa.bool_()) for p in (_MASKED, _SHOUT)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *flags, have], names=["doc_id", "toxic", "masked", "shouts", "have"])

    out = rows.select("doc_id", "toxic", "text").mapInArrow(seen, "doc_id bigint, toxic boolean, masked boolean, shouts boolean, have array<int>").collect()
    return train(chosen, listed, [tuple(r)[1:] for r in sorted(out, key=lambda r: r["doc_id"])])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = pa.array(shared.value.scores(batch.column(1).to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), score], names=["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
