"""Near-duplicate groups by SuperMinHash, banding, exact checks and union-find.

1. A document's set is its distinct ``k``-word shingles (64-bit hashes; the key
   of a whole set has 128 bits). Documents with equal sets form a class; all
   later work is on classes, so plain copies cost one aggregated row.
2. Each class gets a SuperMinHash signature: every element walks a random
   permutation of the registers, step j offers j plus a fraction to the j-th
   register of its walk, and the walk stops once no register can still fall.
   Signatures are cut into bands; classes that agree in a band are candidates.
   A pair at the threshold is missed with probability (1 - 0.8^4)^32 < 1e-7.
3. In each bucket the class that meets most others is its centre. All members
   are checked against the centre on full sets: work and rows grow with the
   bucket, not with its square.
4. Members outside their centre's component are then held against the other
   members of that centre. Similar sets share four fifths of each; so either they
   share shingles that the centre lacks, or both have so much in common with the
   centre already. The former meet by the rarest of the shingles that the centre
   lacks. The latter are held by their differences from the centre, in both
   directions: the distance of two sets is the sum of their differences less twice
   what these share, so a member that is not linked with the centre shares some of
   its differences with every set that it is linked to. They meet by the rarest of
   these, in either case as many as must hold a common one: unlike parts of one long
   text, and copies with changes in unlike places, never meet. Places among
   the shared shingles and histograms bound what a pair can share; what the bounds
   leave open is checked on full sets. Members that meet by one shingle are dealt to
   tasks in pairs of blocks of ids alone.
5. Links are joined to components by rounds of contraction.

A class, a bucket, a centre or a component may hold a third of all rows: joins on
these go by ``join_counted``.

Defined results: null, empty and wordless texts have no shingles, are linked
with nothing and form their own component; a text of fewer than ``k`` words has
its whole sequence as its one shingle; texts of any length are taken whole; rows
that repeat an id keep their own set and may be in several components; rows with
a null id take part, and show the smallest non-null id of their component; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_counted, let, lower_ascii, materialize, words, wrapped

REGISTERS = 128
BAND_ROWS = 4
#: Links need 100 * intersection >= SIMILARITY * union.
SIMILARITY = 80
#: Shingles that one step of the signature code holds (about 200 bytes each).
CHUNK = 200_000
#: Cells of the histograms that bound what two sets can share.
CELLS = 512
#: Members of one centre with one item that are held against each other in one task.
MEMBERS = 10_000
#: Members of one centre with about as many differences from it are a class: the largest count over the least, at most.
CLASS_RATIO = 1.15


def shingles(text: Column, k: int) -> Column:
    """Sorted distinct hashes of the ``k``-word shingles."""

    def each(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - (k - 1)))
        return F.when(F.size(w) > 0, F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, k)))).otherwise(F.expr("cast(array() as array<bigint>)"))

    return F.sort_array(F.array_distinct(let(words(lower_ascii(text)), each)))


def _mixed(x: np.ndarray, step: int) -> np.ndarray:
    """64 fresh random bits for each element and step."""
    z = x + np.uint64((0x9E3779B97F4A7C15 * (step + 1)) % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def signatures(values: np.ndarray, lengths: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """SuperMinHash of consecutive sets. A register holds step * 2^24 + fraction; an empty set keeps the largest value.

    All elements take their j-th step together; sets whose registers can no
    longer fall leave the loop.
    """
    n = len(lengths)
    out = np.full((n, m), np.iinfo(np.uint32).max, np.uint32)
    doc = np.repeat(np.arange(n), lengths)
    x = values.astype(np.uint64)
    walk = None
    for j in range(m):
        bits = _mixed(x, j)
        low = (bits & np.uint64(0xFFFFFF)).astype(np.int64)
        k = j + ((low * (m - j)) >> 24)
        offer = (j << 24) + (bits >> np.uint64(40)).astype(np.uint32)
        if walk is None:
            register = k
        else:
            rows = np.arange(len(x))
            register = walk[rows, k]
            walk[rows, k] = walk[:, j]
        np.minimum.at(out.reshape(-1), doc * m + register, offer)
        open_ = out.max(axis=1) > ((j + 1) << 24)
        stay = open_[doc]
        if not stay.any():
            break
        if walk is None:
            x, doc, k = x[stay], doc[stay], k[stay]
            walk = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(x), 1))
            walk[np.arange(len(x)), k] = 0
        elif not stay.all():
            x, doc, walk = x[stay], doc[stay], walk[stay]
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature; the band's number is part of it."""
    rows = signature.astype(np.uint64).reshape(len(signature), -1, BAND_ROWS)
    key = np.broadcast_to(np.arange(rows.shape[1], dtype=np.uint64), rows.shape[:2]).copy()
    for i in range(BAND_ROWS):
        key = _mixed(key * np.uint64(0x100000001B3) ^ rows[:, :, i], i)
    return key.view(np.int64)


def _with_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        sets = batch.column(names.index("sh"))
        lengths = np.diff(sets.offsets.to_numpy()).astype(np.int64)
        values = sets.flatten().to_numpy()
        ends = np.cumsum(lengths)
        keys, begin = [], 0
        while begin < len(lengths):
            done = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + CHUNK, side="right")))
            keys.append(bands(signatures(values[done : ends[end - 1]], lengths[begin:end])))
            begin = end
        per = REGISTERS // BAND_ROWS
        flat = np.concatenate(keys).reshape(-1) if keys else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(lengths) + 1, dtype=np.int32) * per), pa.array(flat))
        kept = [batch.column(names.index(c)) for c in ("doc_id", "n", "k1", "k2")]
        yield pa.RecordBatch.from_arrays([*kept, lists], names=["doc_id", "n", "k1", "k2", "bands"])


def _keyed(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, sh, n and the 128-bit key of the set."""
    sets = docs.select("doc_id", shingles(F.col("text"), k).alias("sh"))
    return sets.select("doc_id", "sh", F.size("sh").cast("long").alias("n"), F.xxhash64("sh").alias("k1"), F.xxhash64(F.lit(7), "sh").alias("k2"))


def components(edges: DataFrame) -> DataFrame:
    """node, label: one label for all nodes of a component of undirected edges a - b.

    Union-find by contraction: in each round every node moves to that of its
    neighbours and itself which is first in an order hashed anew; links between
    nodes that moved to one place vanish, so each round holds a fraction of the
    links of the one before. The moves of all rounds give the labels. They pass
    through written tables, never through the driver. Rows here are two numbers,
    so a component that holds a third of them is left to Spark's own splitting of
    skewed joins.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    moves: list[DataFrame] = []
    while not moves or not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        turn = F.lit(len(moves))
        first = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", turn).alias("h"), F.col("b").alias("to"))).alias("f"))
        to = F.when(F.col("f.h") < F.xxhash64("a", turn), F.col("f.to")).otherwise(F.col("a"))
        move = materialize(first.select(F.col("a").alias("node"), to.alias("label")))
        moves.append(move)
        x, y = (move.select(F.col("node").alias(c), F.col("label").alias(f"{c}2")) for c in "ab")
        moved = edges.join(x, "a").join(y, "b").filter("a2 <> b2")
        edges = materialize(moved.select(F.greatest("a2", "b2").alias("a"), F.least("a2", "b2").alias("b")).distinct())
    label = moves[0]
    for move in moves[1:]:
        then = move.select(F.col("node").alias("label"), F.col("label").alias("then"))
        label = label.join(then, "label", "left").select("node", F.coalesce("then", "label").alias("label"))
    return materialize(label) if len(moves) > 1 else label


def _sets_of(docs: DataFrame, classes: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """cid, sh of the wanted classes: their first documents' texts are read once more."""
    need = materialize(classes.select("cid", "first_id", "k1", "k2").join(wanted, "cid", "left_semi"))
    ids = need.select(F.col("first_id").alias("doc_id")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("i"))
    # ids grow with the rows, so texts move to them, alike at every size
    texts = docs.join(ids.withColumnRenamed("doc_id", "i").hint("shuffle_hash"), same, "left_semi")
    sets = _keyed(texts, k).select("sh", "k1", "k2").join(need.select("cid", "k1", "k2").hint("merge"), ["k1", "k2"])
    return materialize(sets.select("cid", "sh").dropDuplicates(["cid"]))


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cid, cells: how many shingles of each set fall into each cell."""
    for batch in batches:
        sets = batch.column(1)
        lengths = np.diff(sets.offsets.to_numpy())
        cell = _mixed(sets.flatten().to_numpy().astype(np.uint64), 99) % np.uint64(CELLS)
        at = np.repeat(np.arange(len(lengths)), lengths) * CELLS + cell.astype(np.int64)
        counts = np.bincount(at, minlength=len(lengths) * CELLS).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(lengths) + 1, dtype=np.int32) * CELLS), pa.array(counts))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["cid", "cells"])


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs a, b (written) with na, nb, o (size of the intersection), own (shingles of a that b hasn't) and lost (those of b that a hasn't; null where a can't be ``near``)."""
    met = pairs.groupBy(F.col("b").alias("cid")).agg(F.count("*").alias("n"))
    x = sets.select(F.col("cid").alias("a"), F.col("sh").alias("xa"))
    # pairs grow with the rows, so sets move to them at every size
    y = sets.join(met.hint("merge"), "cid").select("cid", F.col("sh").alias("xb"), "n")
    both = join_counted(pairs.hint("merge").join(x, "a"), y, {"b": "cid"}, "n", pairs.count(), "inner", hint="merge")
    own = F.array_except("xa", "xb")
    out = both.select("a", "b", F.size("xa").alias("na"), F.size("xb").alias("nb"), own.alias("own"), "xa", "xb")
    out = out.withColumn("o", F.col("na") - F.size("own"))
    lost = F.when(_least_shared(F.col("na")) <= F.col("o"), F.array_except("xb", "xa"))
    return out.withColumn("lost", lost).drop("xa", "xb")


def _linked(o: Column, n: Column) -> Column:
    """100 o >= SIMILARITY (n - o), where n is the sum of both sizes."""
    return (100 + SIMILARITY) * o.cast("long") >= SIMILARITY * n.cast("long")


def grouped(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    schema = "doc_id bigint, n bigint, k1 bigint, k2 bigint, bands array<bigint>"
    rows = materialize(_keyed(docs, k).mapInArrow(_with_bands, schema))
    first = rows.filter("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    classes = materialize(first.withColumn("cid", F.monotonically_increasing_id()))

    band = classes.select("cid", F.explode("bands").alias("bkey"))
    shared = band.groupBy("bkey").agg(F.count("*").alias("size")).filter("size > 1")
    shared = materialize(shared)
    n = (REGISTERS // BAND_ROWS) * classes.count()
    members = materialize(join_counted(band, shared.withColumn("held", F.col("size")), {"bkey": "bkey"}, "held", n, "inner", hint="merge"))
    score = members.groupBy("cid").agg(F.sum("size").alias("score"))
    scored = members.join(score.hint("merge"), "cid")
    centre = materialize(scored.groupBy("bkey").agg(F.max(F.struct("score", "cid"))["cid"].alias("c"), F.count("*").alias("held")))
    pairs = join_counted(members.select("cid", "bkey"), centre, {"bkey": "bkey"}, "held", members.count(), "inner", hint="merge")
    pairs = pairs.filter("cid <> c").select(F.col("cid").alias("a"), F.col("c").alias("b")).distinct()
    pairs = materialize(pairs)
    sets = _sets_of(docs, classes, pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid"))).distinct(), k)

    stars = materialize(_compared(pairs, sets))
    edges = stars.filter(_linked(F.col("o"), F.col("na") + F.col("nb"))).select("a", "b")
    label = components(edges)
    rest = materialize(_compared(materialize(_open_pairs(stars, label, sets)), sets).drop("own", "lost"))
    further = rest.filter(_linked(F.col("o"), F.col("na") + F.col("nb"))).select("a", "b")
    label = components(label.select(F.col("node").alias("a"), F.col("label").alias("b")).union(further))

    named = classes.select("k1", "k2", "cid", "first_id", "copies").join(label, F.col("cid") == F.col("node"), "left")
    named = materialize(named.withColumn("label", F.coalesce("label", "cid")).drop("node"))
    least = named.groupBy("label").agg(F.min("first_id").alias("component_id"), F.count("*").alias("held"))
    of = join_counted(named, least, {"label": "label"}, "held", named.count(), hint="merge").select("k1", "k2", F.lit(True).alias("some"), "component_id", "copies")
    of = materialize(of)
    every = rows.select("doc_id", "n", "k1", "k2", (F.col("n") > 0).alias("any"))
    out = join_counted(every, of, {"k1": "k1", "k2": "k2", "any": "some"}, "copies", rows.count(), hint="merge")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _least_shared(n: Column) -> Column:
    """What a set of ``n`` shares at least with any set that it is linked to."""
    return F.ceil(n.cast("long") * SIMILARITY / 100).cast("int")


def _open_pairs(stars: DataFrame, label: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs a, b of one centre, in different components, that the bounds do not rule out.

    ``o`` of a member is what it shares with the centre, ``own`` what the centre
    lacks, ``lost`` what it lacks of the centre, ``must`` how many of its own
    shingles a linked set shares with it at least. It is near if that may be none.

    Two near members with ``d`` and ``e`` differences from the centre, ``m`` of them
    the same, have a distance of d + e - 2m. It is at most r (na + yna) where they
    are linked, with r = (100 - SIMILARITY) / (100 + SIMILARITY). As e is no less
    than the difference in size from the centre, nor than d - r (na + yna), m is at
    least (d - r (na + nb)) / (1 + r) for every size of the other: above zero for a
    member that is not linked with the centre. For the others of one class of ``d``
    the least of their differences and the largest of their sizes say more.
    """
    met = stars.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("n"))
    of = label.select("node", "label")
    named = stars.join(of.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left").withColumnRenamed("b", "c")
    met = met.join(of, "node", "left").select("node", F.col("label").alias("lc"), "n")
    named = join_counted(named, met, {"c": "node"}, "n", stars.count())
    named = named.withColumn("la", F.coalesce("la", "a")).withColumn("lc", F.coalesce("lc", "c"))
    named = materialize(named.withColumn("open", F.col("la") != F.col("lc")).withColumn("must", _least_shared(F.col("na")) - F.col("o")).drop("lc"))
    centres = named.groupBy("c").agg(F.count("*").alias("held"), F.count_if("open").alias("n_open")).filter("n_open > 0")
    named = materialize(join_counted(named, centres, {"c": "c"}, "held", named.count(), "inner"))
    cells = materialize(sets.select("cid", "sh").mapInArrow(_histograms, "cid bigint, cells array<int>"))

    # those that must share shingles which the centre lacks meet by the rarest of these
    narrow = named.select("c", "a", "na", "la", "o", F.lit(0).alias("twice"), "open", (F.col("must") <= 0).alias("near"), F.greatest("must", F.lit(1)).alias("must"), F.lit(0).alias("k"), F.lit(0).alias("t"))
    met = _meeting(narrow, named.select("c", "a", "open", F.col("own").alias("items")))

    # those that may share enough of the centre alone meet by the rarest of their differences from it
    near = named.filter("must <= 0")
    some = near.groupBy("c").agg(F.count("*").alias("held"), F.count_if("open").alias("n_open")).filter("n_open > 0 and held > 1")
    near = join_counted(near.select("c", "a", "na", "nb", "la", "open", F.concat("own", "lost").alias("items")), some.select("c", "held"), {"c": "c"}, "held", named.count(), "inner")
    near = materialize(near.withColumn("d", F.size("items")))
    near = near.withColumn("k", F.floor(F.log("d") / F.log(F.lit(CLASS_RATIO))).cast("int"))
    kinds = near.groupBy("c", "k").agg(F.count("*").alias("n"), F.min("d").alias("d"), F.max("na").alias("na"), F.max("open").alias("open"))
    kinds = materialize(kinds.groupBy("c").agg(F.sum("n").alias("n"), F.collect_list(F.struct(F.col("k").alias("t"), "d", "na", "open")).alias("kinds")))
    dealt = join_counted(near.select("c", "a", "na", "nb", "la", "open", "d", "k"), kinds, {"c": "c"}, "n", near.count(), "inner")
    dealt = dealt.withColumn("other", F.explode("kinds")).drop("kinds").filter(F.col("open") | F.col("other.open"))
    long = lambda name: F.col(name).cast("long")
    any_ = F.ceil(((100 + SIMILARITY) * long("d") - (100 - SIMILARITY) * (long("na") + long("nb"))) / 200)
    of_class = F.ceil(((100 + SIMILARITY) * (long("d") + long("other.d")) - (100 - SIMILARITY) * (long("na") + long("other.na"))) / (2 * (100 + SIMILARITY)))
    must = F.greatest(any_, of_class, F.lit(1)).cast("int")
    by_difference = dealt.select("c", "a", "na", "la", F.lit(0).alias("o"), (F.col("na") - F.col("d")).alias("twice"), "open", F.lit(False).alias("near"), must.alias("must"), "k", F.col("other.t").alias("t"))
    met = materialize(met.union(_meeting(by_difference, near.select("c", "a", "open", "items"))).distinct())

    x, y = (cells.select(F.col("cid").alias(a), F.col("cells").alias(c)) for a, c in (("a", "x"), ("ya", "y")))
    met = met.join(x.hint("merge"), "a").join(y.hint("merge"), "ya").filter(_linked(_shared("x", "y"), F.col("na") + F.col("yna")))
    return met.select(F.greatest("a", "ya").alias("a"), F.least("a", "ya").alias("b")).distinct()


def _meeting(rows: DataFrame, items: DataFrame) -> DataFrame:
    """a, na, ya, yna: members of one centre, in different components and one of them open, that share one of their rarest items and that bounds leave open.

    ``rows`` holds c, a, na, la, open, what a member may share with others beside its
    items (of o the lesser of two members' counts, and of twice half of their sum), near
    (two of these don't meet here), and for the others of one class t, where its own is
    k, must (how many items it shares at least with a set of these that it is linked to);
    ``items`` holds c, a, open and the items, as an array. Items are ranked by how many members of the centre have them. Those of one
    member alone, or of no open one, are never shared; of the rest, so many of the rarest
    are kept that a set which shares ``must`` of all has one of them. Members with one item
    that are more than ``MEMBERS`` are cut into blocks, and each pair of blocks may be
    another task's.
    """
    held = materialize(items.select("c", "a", "open", F.explode("items").alias("e")))
    often = held.groupBy("c", "e").agg(F.count("*").alias("often"), F.count_if("open").alias("n_open")).filter("often > 1 and n_open > 0")
    often = materialize(often.select("c", "e", "often", F.col("often").alias("n")))
    common = join_counted(held.select("c", "a", "e"), often, {"c": "c", "e": "e"}, "n", held.count(), "inner", hint="merge")
    by = Window.partitionBy("c", "a")
    placed = common.withColumn("place", F.row_number().over(by.orderBy("often", "e"))).withColumn("s", F.count("*").over(by).cast("int"))
    # in the ranking the items that nobody shares come before these
    first = placed.drop("often").join(rows.hint("merge"), ["c", "a"]).filter(F.col("place") <= F.col("s") - F.col("must") + 1)
    first = materialize(first.select("c", "e", "a", "na", "la", "o", "twice", "s", "place", "open", "near", "k", "t"))
    large = first.groupBy("c", "e").agg(F.count("*").alias("n")).filter(F.col("n") > MEMBERS)
    large = large.select("c", "e", "n", (F.floor(F.col("n") / MEMBERS) + 1).cast("int").alias("blocks"))
    first = join_counted(first, materialize(large), {"c": "c", "e": "e"}, "n", first.count()).fillna(1, ["blocks"])
    first = first.withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = first.filter("open").withColumn("other", every)
    right = first.select("c", "e", F.col("k").alias("t"), F.col("t").alias("k"), F.col("block").alias("other"), every.alias("block"), *[F.col(v).alias(f"y{v}") for v in ("a", "na", "la", "o", "twice", "s", "place", "open", "near")])
    # common items stand before this one, behind it, or are it
    most = F.least("o", "yo") + F.least("place", "yplace") + F.least(F.col("s") - F.col("place"), F.col("ys") - F.col("yplace"))
    most = 2 * most + F.col("twice") + F.col("ytwice")
    # one of the two is open; where both are, they meet once
    apart = (F.col("la") != F.col("yla")) & (~F.col("yopen") | (F.col("a") < F.col("ya"))) & ~(F.col("near") & F.col("ynear"))
    both = left.join(right.hint("merge"), ["c", "e", "k", "t", "block", "other"]).filter(apart & _linked(most, 2 * (F.col("na") + F.col("yna"))))
    return both.select("a", "na", "ya", "yna").distinct()


def _shared(x: str, y: str) -> Column:
    """What two sets share at most: over the cells of both histograms, the sum of the lesser count."""
    return F.aggregate(F.zip_with(x, y, lambda u, v: F.least(u, v)), F.lit(0), lambda t, v: t + v)


def one_of_each(docs: DataFrame, k: int = 5) -> DataFrame:
    """Rows of ``docs`` that are the smallest id of their component, with all their columns.

    Rows that share an id share its fate: they stay if one of their texts makes
    it the smallest of a component. So do rows without an id.
    """
    group = grouped(docs, k).filter("kept").select(F.col("doc_id").alias("_id")).distinct()
    return wrapped(docs, "doc_id").join(group, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("_row.*")
