"""Secret scans over an incremental blob ledger, in DataFrame functions alone.

Every version of a text is addressed by its SHA-256. The ledger is a folder of
Parquet tables: one row for each blob and batch of rule versions that has been
scanned, with the findings. A scan takes the distinct blobs, leaves out the
pairs of blob and rule version that the ledger has, searches the rest, adds them
to the ledger, and joins all findings of the present rules back to every path.

A rule is versioned; a changed pattern gets a new version, and only that rule is
then run again over the blobs that are known.

Positions are code points: a text is split at the matches, and the lengths of
the pieces and matches are summed within the blob.

Defined results: null text is the empty blob; blobs without findings are in the
ledger too; repeated rows get equal results; texts and tokens of any length are
searched whole; of findings at one place the kinds go in their order; an empty
table leaves the ledger as it was.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_counted, materialize, sha256_hex, shared_dir


class Rule(NamedTuple):
    kind: str
    version: int
    pattern: str
    #: The group whose length counts (0: the whole match), and its least length. Shorter matches are dropped, not tried again.
    group: int
    least: int

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base rules in their order, then the method's own.
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", 1, r"[0-9a-f]+", 0, 16),
    Rule("github", 2, r"gh[pousr]_[A-Za-z0-9]{36,}+", 0, 40),
    Rule("jwt", 2, r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{16,}+", 0, 40),
    # up to the END line where one comes before any other line of five hyphens
    Rule("pem", 2, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[^-]*+(?:-{1,4}+[^-]++)*+-----END [A-Z ]{0,40}PRIVATE KEY-----)?+", 0, 20),
)
BASE = 3
#: A text without a match of this holds no match of the rule; it spares the search, not the text.
NEEDS = {"hex": r"[0-9a-f]{16}", "access": r"AKIA[A-Z0-9]{14}"}
FINDING = "array<struct<start:bigint,kind:int,end:bigint>>"


def new_ledger(spark: SparkSession) -> str:
    return shared_dir(spark)


def ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """blob, rules, findings of all scans so far; None before the first."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema(f"blob binary, rules array<string>, findings {FINDING}").parquet(path)


def _blob(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _hits(text: Column, rule: Rule, number: int) -> Column:
    """The rule's matches in order: kind, place in the order, code points since the last match, length, and whether it counts."""
    pieces = F.split(text, rule.pattern, -1)
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    # the pieces are one more than the matches; null padding is cut off
    zipped = F.slice(F.arrays_zip(pieces.alias("p"), found.alias("f"), value.alias("v")), F.lit(1), F.size(found))
    each = F.transform(
        zipped,
        lambda x, i: F.struct(
            F.lit(number).alias("kind"), i.alias("i"), F.length(x["p"]).alias("gap"), F.length(x["f"]).alias("len"), (F.length(x["v"]) >= rule.least).alias("ok")
        ),
    )
    none = F.expr("cast(array() as array<struct<kind:int,i:int,gap:int,len:int,ok:boolean>>)")
    todo = F.array_contains("todo", rule.key) & text.rlike(NEEDS.get(rule.kind, rule.pattern))
    return F.when(todo, each).otherwise(none)


def _searched(blobs: DataFrame) -> DataFrame:
    """blob, rules, findings for rows of blob, text and todo (rule keys)."""
    text = F.col("text")
    hits = F.concat(*[_hits(text, r, k) for k, r in enumerate(RULES)])
    rows = blobs.select("blob", "todo", F.explode_outer(hits).alias("h")).select("blob", "todo", "h.*")
    # sums within one blob and kind: no more rows than that text has matches
    end = F.expr("sum(gap + len) over (partition by blob, kind order by i rows between unbounded preceding and current row)")
    placed = rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("len"))
    finding = F.when(F.col("ok"), F.struct("start", "kind", "end"))
    return placed.groupBy("blob").agg(F.first("todo").alias("rules"), F.array_sort(F.collect_list(finding)).cast(FINDING).alias("findings"))


def unseen(versions: DataFrame, known: DataFrame | None) -> DataFrame:
    """blob, todo, held: the distinct blobs of ``versions`` (blob), the rule versions that the ledger lacks for them, and how many rows bear them."""
    blobs = versions.groupBy("blob").agg(F.count("*").alias("held"))
    every = F.array(*[F.lit(r.key) for r in RULES])
    if known is None:
        return blobs.withColumn("todo", every)
    seen = known.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
    left = F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))
    return blobs.join(seen, "blob", "left").select("blob", left.alias("todo"), "held").filter(F.size("todo") > 0)


def scan(versions: DataFrame, path: str) -> DataFrame:
    """Add the unseen blobs of ``versions`` (text) to the ledger at ``path``; returns the ledger.

    What is unseen is told by addresses alone; only texts of unseen blobs go on,
    one for each. An unseen blob may be that of a third of all rows.
    """
    spark = versions.sparkSession
    known = ledger(spark, path)
    texts = versions.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", _blob(F.col("text")))
    if known is None:
        todo = texts.dropDuplicates(["blob"]).withColumn("todo", F.array(*[F.lit(r.key) for r in RULES]))
    else:
        new = materialize(unseen(texts.select("blob"), known))
        # a hot blob's rows are alike, so which task gets which of them is drawn
        dealt = texts.withColumn("row", F.monotonically_increasing_id())
        todo = join_counted(dealt, new, {"blob": "blob"}, "held", texts.count(), "inner", by=("row",)).drop("row").dropDuplicates(["blob"])
    _searched(todo).write.mode("append").parquet(path)
    return ledger(spark, path)


def findings(known: DataFrame) -> DataFrame:
    """blob, findings of the present rules, for blobs that have any; one row for each blob."""
    current = F.array(*[F.lit(r.key) for r in RULES])
    kinds = F.array(*[F.lit(r.kind) for r in RULES])
    rows = known.filter(F.size("findings") > 0)
    valid = F.filter("findings", lambda x: F.exists("rules", lambda r: F.array_contains(current, r) & (F.substring_index(r, "@", 1) == F.element_at(kinds, x["kind"] + 1))))
    # a blob has a row for each scan that added rules to it, few by nature
    return rows.select("blob", valid.alias("f")).groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("f")))).alias("findings"))


def report(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, counts and digest of base findings, and all findings, for each row of ``docs`` (doc_id, text)."""
    paths = materialize(docs.select("doc_id", _blob(F.coalesce("text", F.lit(""))).alias("blob")))
    bears = paths.groupBy("blob").agg(F.count("*").alias("paths"))
    known = materialize(findings(scan(docs, path)).join(bears, "blob"))
    # a blob may be that of a third of all paths
    found = join_counted(paths, known, {"blob": "blob"}, "paths", paths.count())
    every = F.coalesce("findings", F.expr(f"cast(array() as {FINDING})"))
    kinds = F.array(*[F.lit(r.kind) for r in RULES])

    def text(spans: Column) -> Column:
        each = F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string")))
        return F.array_join(each, ",")

    def count(k: int) -> Column:
        return F.size(F.filter(every, lambda x: x["kind"] == k)).cast("long").alias(f"n_{RULES[k].kind}")

    counts = [count(k) for k in range(BASE)]
    base = F.filter(every, lambda x: x["kind"] < BASE)
    return found.select("doc_id", *counts, sha256_hex(text(base)).alias("base_sha256"), text(every).alias("spans"))
