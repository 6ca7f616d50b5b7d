"""Quality rules with cross-document line frequency, in DataFrame functions alone.

A document fails outright when it has fewer than 50 words, or when over half of
its words stand in 3-word windows that occur at least twice in it. Of the rest,
the line rule decides: lines are normalised and hashed, the distinct documents
that hold a line are counted per host, and a line above the host's limit is
removed from all documents but one. A document that loses more than half of its
words so is depleted, and rejected.

Two rows with the same text are one document to the count, so plain copies do
not make a line frequent; and each frequent line stays in one text, the one
with the smallest content key, so that a group of near copies never goes as a
whole.

Defined results: null text counts as empty; a document without words has zeros
and fails; null hosts form one host; repeated rows and repeated ids are judged
row by row; texts of any length are measured whole; an empty table gives an
empty table; other columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, UPPER, WORD, join_counted, materialize, wrapped

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line is frequent on a host when more distinct texts hold it than this, however large the host is.
LINE_DOCUMENTS = 20
#: On small hosts the limit is this share of the host's distinct texts, but no less than the second number.
SMALL_SHARE, SMALL_DOCUMENTS = 0.08, 4
#: Share of its words, in percent, beyond which a document is depleted.
MAX_REMOVED_PERCENT = 50

#: Words in 3-word windows that occur twice or more. Most texts repeat no window,
#: which their distinct hashes tell. Of the others the hashes are sorted, equal
#: neighbours give positions, and the union of the windows there is counted.
#: 64-bit hashes are compared within one document only.
_REPEATED = """
case when size(w) < 4 then 0L else transform(array(transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2]))), hs ->
  case when size(array_distinct(hs)) = size(hs) then 0L else transform(array(sort_array(transform(hs, (h, i) -> struct(h as h, i as p)))), s ->
    aggregate(
      sort_array(transform(filter(sequence(0, size(s) - 1), k -> s[k].h = get(s, k - 1).h or s[k].h = get(s, k + 1).h), k -> s[k].p)),
      struct(-9 as last, 0L as n),
      (a, p) -> struct(p as last, a.n + least(3, p - a.last) as n),
      a -> a.n))[0] end)[0] end
"""

_METRICS = f"""
transform(array(regexp_extract_all(text, r'{WORD}', 0)), w -> struct(
  cast(size(w) as bigint) as n_words,
  cast(length(array_join(w, '')) as bigint) as word_chars,
  {_REPEATED} as n_repeat_words))[0]
"""

#: A line as it is compared.
_KEY = f"trim(regexp_replace(translate(l, '{UPPER}', '{LOWER}'), r'{SPACE}', ' '))"

#: Lines with a word: raw for the count of repeats, then key and word count.
_LINES = f"""
transform(array(filter(split(text, '\\n', -1), l -> l rlike r'{WORD}')), ls -> struct(
  cast(size(ls) - size(array_distinct(ls)) as bigint) as n_dup_lines,
  transform(transform(ls, l -> {_KEY}),
    l -> struct(xxhash64(l) as line, length(l) - length(replace(l, ' ', '')) + 1 as n))as lines))[0]
"""

#: The text without the lines whose keys are in removed; a text without any stays as it is.
_WITHOUT = f"""
case when size(removed) > 0 then array_join(filter(split(_row.text, '\\n', -1),
  l -> not (l rlike r'{WORD}' and array_contains(removed, xxhash64({_KEY})))), '\\n') else _row.text end
"""


def measured(docs: DataFrame) -> DataFrame:
    """Columns of ``docs`` (doc_id, text, source) as base measures, line keys and content key."""
    text = docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    symbols = F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))
    return text.select(
        "doc_id",
        F.col("source").alias("host"),
        F.conv(F.substring(F.md5(F.col("text").cast("binary")), 1, 15), 16, 10).cast("long").alias("content"),
        F.expr(_METRICS).alias("m"),
        symbols.cast("long").alias("n_symbols"),
        F.expr(_LINES).alias("l"),
    ).select("doc_id", "host", "content", "m.*", "n_symbols", "l.n_dup_lines", "l.lines")


def frequent_lines(narrow: DataFrame) -> DataFrame:
    """host, line, keeper, rows: lines above their host's limit, the content that keeps them, and how many rows hold them.

    The limit never grows with the host beyond ``LINE_DOCUMENTS``, so a line that
    thousands of texts of a large host hold can't pass as rare; on a host that has
    few texts a line may be in many of them with less. Most lines may be on one
    host, so the sizes of hosts go to them by ``join_counted``.
    """
    line = narrow.select("host", "content", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"))
    counts = line.groupBy("host", "line").agg(F.count_distinct("content").alias("n"), F.count("*").alias("rows"), F.min("content").alias("keeper"))
    counts = materialize(counts.filter(F.col("n") > SMALL_DOCUMENTS))
    few = counts.filter(F.col("n") <= LINE_DOCUMENTS)
    sizes = narrow.groupBy("host").agg(F.count_distinct("content").alias("of"))
    lines = few.groupBy(F.col("host").alias("h")).agg(F.count("*").alias("held"))
    hosts = materialize(lines.join(sizes, F.col("h").eqNullSafe(F.col("host"))).select("host", "of", "held"))
    limit = F.greatest(F.lit(float(SMALL_DOCUMENTS)), SMALL_SHARE * F.col("of"))
    few = join_counted(few, hosts, {"host": "host"}, "held", few.count(), "inner").filter(F.col("n") > limit)
    return counts.filter(F.col("n") > LINE_DOCUMENTS).unionByName(few.drop("of")).drop("n")


def judge(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: the measures, base_failed, n_removed_words, removed (keys of its lines that go) and kept.

    The measures are written once, so that neither a second pass nor a lost
    executor has the texts read and measured again. A line that a third of all
    rows hold is no skew: frequent lines go by ``join_counted``.
    """
    narrow = materialize(measured(docs).withColumn("row", F.monotonically_increasing_id()))
    frequent = materialize(frequent_lines(narrow))
    held = narrow.select("row", "host", "content", F.explode("lines").alias("x")).select("row", "host", "content", "x.*").withColumnRenamed("n", "words")
    total = narrow.agg(F.sum(F.size("lines"))).first()[0] or 0
    removed = (
        join_counted(held, frequent, {"host": "host", "line": "line"}, "rows", total)
        .filter(F.col("content") != F.col("keeper"))
        .groupBy("row")
        .agg(F.sum("words").cast("long").alias("gone"), F.collect_set("line").alias("removed"))
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    depleted = 100 * F.col("n_removed_words") > MAX_REMOVED_PERCENT * F.col("n_words")
    return (
        narrow.drop("lines")
        .join(removed, "row", "left")
        .withColumn("n_removed_words", F.coalesce("gone", F.lit(0)).cast("long"))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & ~depleted)
        .drop("gone")
    )


def accepted(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that the rules keep, with all their columns, without their frequent lines; ``n_chars``, if there, is counted anew.

    Equal ids with equal texts and hosts get equal verdicts, so the verdict is
    joined by these.
    """
    content = F.conv(F.substring(F.md5(F.coalesce("text", F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")
    verdict = judge(docs).filter("kept").select(F.col("doc_id").alias("_id"), F.col("host").alias("_host"), F.col("content").alias("_content"), "removed")
    verdict = verdict.dropDuplicates(["_id", "_host", "_content"])
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_host")) & (content == F.col("_content"))
    row = F.col("_row").withField("text", F.expr(_WITHOUT))
    out = wrapped(docs, "doc_id", "source", "text").join(verdict, same).select(row.alias("_row"))
    if "n_chars" in docs.columns:
        count = F.length("_row.text").cast(docs.schema["n_chars"].dataType)
        out = out.select(F.when(F.col("_row.text").isNull(), F.col("_row")).otherwise(F.col("_row").withField("n_chars", count)).alias("_row"))
    return out.select("_row.*")
