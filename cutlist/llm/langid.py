"""Language of texts by rank-order profiles.

A profile is a language's ``TOP`` most frequent runs of one to three letters, in
order. Letters are lower-cased; all else between letters is one boundary, which
counts as a character of runs of two and three at the edge of a word. A text's
own ``TOP`` runs are held against each profile: each adds how far out of place it
is there, or ``TOP`` if the profile lacks it. The nearest profile gives the
language.

Profiles are learned from all rows that have text and language; runs are counted in
each task before they meet, so a language that holds most rows is many small
counts. Equal counts go by the runs' code points, equal distances by the name of the
language. What goes to the driver and to all tasks are ``TOP`` runs for each
distinct language.

Null texts and texts without a letter are ``und`` with score 0, as is every text if
nothing could be learned. Null languages and texts are not learned from; a repeated
row is learned from each time. Long texts are counted in blocks, with exact sums. Rows
stay as many as they were; an empty table gives an empty one. Other columns, of
whatever name but ``lang_pred`` and ``score``, are passed through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Runs of a profile; the longest run.
TOP = 300
LONGEST = 3
UNKNOWN = "und"
#: Letters that are counted at once, and distinct runs that a task holds before it sends them on.
BLOCK = 1 << 20
HELD = 1 << 20
#: A boundary's code (no letter has it), and bits of a code.
EDGE, BITS = 1, 21


class Profiles(NamedTuple):
    """Languages by name; all their runs, sorted; and each run's place in each language, ``TOP`` where it has none."""

    languages: list[str]
    runs: np.ndarray
    places: np.ndarray


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of ``text``, as sorted numbers, and how often each stands there."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = np.concatenate([[False], _letters()[codes], [False]])
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # of each stretch between letters the first place stays
    kept[0] = letter.any()
    line = np.where(letter, np.concatenate([[EDGE], codes, [EDGE]]), EDGE)[kept].astype(np.int64)
    found: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    if len(line) > 1 and line[1] == EDGE:  # the text begins with other than a letter
        line = line[1:]
    for a in range(0, len(line), BLOCK):
        at = line[a : a + BLOCK + LONGEST - 1]
        n = min(BLOCK, len(line) - a)
        one, two, three = at[:n], at[: n + 1], at[: n + 2]
        pairs = two[:-1] << BITS | two[1:]
        triples = (three[:-2] << 2 * BITS | three[1:-1] << BITS | three[2:])[three[1:-1] != EDGE]
        runs, n_runs = np.unique(np.concatenate([one[one != EDGE], pairs, triples]), return_counts=True)
        found = (runs, n_runs) if not a else _added([found, (runs, n_runs)])
    return found


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts by run."""
    runs, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    total = np.zeros(len(runs), np.int64)
    np.add.at(total, at, np.concatenate([p[1] for p in parts]))
    return runs, total


def _most_frequent(runs: np.ndarray, n: np.ndarray) -> np.ndarray:
    return runs[np.argsort(-n, kind="stable")[:TOP]]


def learned(docs: DataFrame) -> Profiles:
    """Profiles of the languages of ``docs`` (text, lang)."""
    known = docs.select("lang", "text").dropna()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def sent() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                runs, n = _added(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(runs), pa.string()), pa.array(runs, pa.int64()), pa.array(n, pa.int64())], names=["lang", "run", "n"])

        for batch in batches:
            waiting: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                waiting.setdefault(lang.as_py(), []).append(text.as_py())
            for lang, texts in waiting.items():
                begin = 0
                while begin < len(texts):  # short texts are counted together; the line break between them is a boundary
                    end, n = begin, 0
                    while end < len(texts) and (end == begin or n + len(texts[end]) <= BLOCK):
                        n += len(texts[end])
                        end += 1
                    part = counted("\n".join(texts[begin:end]))
                    held.setdefault(lang, []).append(part)
                    size += len(part[0])
                    begin = end
                    if size > HELD:
                        held = {k: [_added(parts)] for k, parts in held.items()}
                        size = sum(len(p[0][0]) for p in held.values())
                        if size > HELD:
                            yield from sent()
                            held, size = {}, 0
        yield from sent()

    counts = known.mapInArrow(run, "lang string, run long, n long").groupBy("lang", "run").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "run")) - 1
    rows = counts.withColumn("place", place).filter(F.col("place") < TOP).select("lang", "run", "place").collect()
    languages = sorted({r["lang"] for r in rows})
    runs = np.unique(np.array([r["run"] for r in rows], np.int64))
    places = np.full((len(languages), len(runs)), TOP, np.int32)
    number = {lang: i for i, lang in enumerate(languages)}
    for r in rows:
        places[number[r["lang"]], np.searchsorted(runs, r["run"])] = r["place"]
    return Profiles(languages, runs, places)


def nearest(profiles: Profiles, text: str | None) -> tuple[str, float]:
    """Language of ``text``, and one less its distance as a share of the greatest there can be."""
    runs, n = counted(text or "")
    if not len(runs) or not profiles.languages:
        return UNKNOWN, 0.0
    own = _most_frequent(runs, n)
    at = np.minimum(np.searchsorted(profiles.runs, own), len(profiles.runs) - 1)
    known = profiles.runs[at] == own
    there = profiles.places[:, at]
    away = np.where(known & (there < TOP), np.abs(there - np.arange(len(own))), TOP).sum(axis=1)
    best = int(away.argmin())
    return profiles.languages[best], float(1 - away[best] / (TOP * len(own)))


def identified(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """``docs`` with lang_pred and score in place of text."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    kept = [c for c in docs.columns if c != "text"]
    out = docs.select(*[F.col(f"`{c}`") for c in kept], F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            found = [nearest(shared.value, t.as_py()) for t in batch.column(names.index("text"))]
            made = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*[batch.column(names.index(c)) for c in kept], *made], names=[*kept, "lang_pred", "score"])

    return docs.mapInArrow(run, out)
