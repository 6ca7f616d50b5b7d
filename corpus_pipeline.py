"""The corpus pipeline: quality rules, near duplicates, decontamination, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept. ``run`` writes what each stage returns to the shared folder
and reads it again, so that a lost executor costs tasks of one stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cutlist.llm import decontam, mixing, neardup, pii, quality
from cutlist.llm.common import shared_dir, table, write_table
from cutlist.sources.shared import remove, scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; the others lose their frequent lines.

    Null and empty texts have no words and go; null sources are one host; rows
    that repeat id, source and text share one verdict and all stay or go; of
    texts that hold a frequent line the one with the smallest content key keeps
    it; an empty table stays empty.
    """
    return quality.accepted(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, 0.8) the smallest id stays.

    Null, empty and wordless texts are in no group and stay, as do rows without
    an id; rows that repeat an id share its fate; an empty table stays empty.
    """
    return neardup.one_of_each(docs, k=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go.

    Null and wordless texts have none and stay; repeated rows share one verdict;
    an empty benchmark takes nothing away.
    """
    return decontam.clean(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets; n_chars follows.

    Null texts stay null, and empty ones empty; overlapping spans give way as one,
    under the kind that begins first; equal texts stay equal.
    """
    return pii.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says; repeats are rows.

    Null sources are one source; texts without words have size 0 and are drawn
    like others; rows that repeat an id are drawn alike, rows without an id by
    their text; an empty table stays empty.
    """
    return mixing.mix(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
]

#: SQL can't express trained taggers and permutation sketches; tests hold the stages' operators against brute force, and run all stages once.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage wrote on its way, and the stage before, is removed once it is written itself."""
    docs, before = table(spark, sf_dir, "documents", *COLUMNS), None
    for _, stage in STAGES[:-1]:
        path = shared_dir(spark)
        with scratch(spark):
            docs = write_table(stage(spark, docs, sf_dir), path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
