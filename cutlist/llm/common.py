"""What the operators of this subpackage share: reading tables, joins on skewed keys, word rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cutlist.sources.shared import materialize, shared_base, shared_dir, write_table  # noqa: F401  (one place for all operators)

#: The white space of the word rules, as a regular-expression class, and its complement.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Letters that are lower-cased. Others keep their case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Named columns of one of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


#: A key is hot if it has more than one in so many of all rows. There can't be more hot keys than this, whatever the data.
HOT = 1_000


def join_counted(rows: DataFrame, table: DataFrame, on: dict[str, str], count: str, total: int, how: str = "left", by: tuple[str, ...] = (), hint: str | None = None) -> DataFrame:
    """``rows`` with the columns of ``table`` beside its keys and ``count``; null where it has no row for them (or, ``inner``, without these).

    ``table`` has one row for each key, with the number of rows that bear it;
    ``total`` is the number of all rows. ``on`` maps columns of ``rows`` to the
    keys; nulls are equal. A key may hold a third of all rows: a hot one is
    repeated in the table, once for each share of one in ``HOT`` of the rows, and
    its rows are dealt to these by a hash of ``by``, or of all columns. That adds
    at most ``HOT`` rows to the table. Hashes of the hot keys, fewer than ``HOT``,
    come to the driver and go into the plan; both sides go by these hashes, so two
    keys with one hash still meet. ``hint`` is for tables that grow with the rows,
    and are joined alike at every size.
    """
    keys = list(on.values())
    values = [c for c in table.columns if c not in keys and c != count]
    share = F.floor(F.col(count) * HOT / F.lit(max(1, total))) + 1
    hot = table.select(F.xxhash64(*keys).alias("h"), share.cast("int").alias("n")).filter("n > 1").collect()

    def shares(columns: list[str]) -> Column:
        if not hot:
            return F.lit(1)
        known = {r["h"]: r["n"] for r in sorted(hot, key=lambda r: r["n"])}
        return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in known.items() for v in kv]), F.xxhash64(*columns)), F.lit(1))

    side = table.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.struct(F.lit(True).alias("_"), *values).alias("_v"))
    same = F.lit(True)
    for i, c in enumerate(on):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    dealt = rows
    if hot:
        dealt = rows.withColumn("_s", F.pmod(F.xxhash64(*(by or rows.columns)), shares(list(on))).cast("int"))
        side = side.withColumn("_t", F.explode(F.sequence(F.lit(0), shares([f"_k{i}" for i in range(len(keys))]) - 1)))
        same = same & (F.col("_s") == F.col("_t"))
    both = dealt.join(side.hint(hint) if hint else side, same, how)
    return both.select(*[F.col(f"`{c}`") for c in rows.columns], *[F.col("_v")[v].alias(v) for v in values])


def wrapped(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns of ``docs``, and all of them as ``_row``, so that no name of theirs can clash with others."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *columns)


def let(value: Column, body) -> Column:
    """``body`` of ``value``, with ``value`` computed once for each row."""
    return F.transform(F.array(value), body)[0]


def lower_ascii(text: Column) -> Column:
    """A-Z to lower case, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Array of the words of ``text``; null has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
