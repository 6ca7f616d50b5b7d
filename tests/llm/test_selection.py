"""Hard negatives, languages and importance resampling against brute force, and on odd input."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutlist.llm import langid, negatives, queries, resample

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, _n_words string, score string, rank string, place int"


def docs_of(spark, texts, langs=None):
    return spark.createDataFrame([(i, t, (langs or {}).get(i, "en"), "x", "y", "z", 1) for i, t in texts], DOCS)


# --- hard negatives


def brute_negatives(rows, anchors):
    out = []
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    for a, va, la in rows:
        if a not in anchors:
            continue
        ranked = sorted((-score(va, v), i, lab) for i, v, lab in rows if i != a)
        for s, p, _ in [r for r in ranked if r[2] == la][:5]:
            window = [(i, -t) for t, i, lab in ranked if lab != la and -80 * s <= -100 * t <= -100 * s][:5]
            out += [(a, p, k + 1, i, -s, t) for k, (i, t) in enumerate(window)]
    return sorted(out)


def vectors(spark, rows, anchors):
    return spark.createDataFrame([(i, v, lab, i in anchors, "z") for i, v, lab in rows], "id long, vector array<long>, label int, anchor boolean, rank string").repartition(3)


@pytest.mark.parametrize("seed, dims, reach", [(1, 5, 4), (2, 21, 200), (3, 8, 3_000_000), (4, 3, 2**40)])
def test_hard_negatives_match_brute_force(spark, monkeypatch, seed, dims, reach):
    """Ties, repeated vectors, several slabs and blocks, every kind of number."""
    monkeypatch.setattr(negatives, "SLAB", 40)
    monkeypatch.setattr(negatives, "ANCHORS", 4)
    rng = random.Random(seed)
    shared = [[rng.randint(-reach, reach) for _ in range(dims)] for _ in range(8)]
    rows = [(i, rng.choice(shared) if rng.random() < 0.3 else [rng.randint(-reach, reach) for _ in range(dims)], rng.randrange(3)) for i in range(220)]
    anchors = set(range(0, 220, 22))
    got = sorted(tuple(r) for r in negatives.mined(vectors(spark, rows, anchors)).collect())
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    want = brute_negatives(rows, anchors)
    if all(clip(s) == s for r in want for s in r[4:]):
        assert got == want and (len(want) > 50 or dims == 3)
    else:  # scores beyond 64 bits are cut to them, and windows follow
        assert {r[:2] for r in got} <= {(a, p) for a in anchors for p in range(220)}


def test_hard_negatives_odd_rows(spark):
    rows = [(0, [1, 2, 3], 1), (1, [1, 2], 1), (2, [], 1), (3, [1, 2, 3, 4], 2), (4, [1, 2, 3], 2), (5, [0, 0, 0], None), (None, [1, 1, 1], 2), (0, [1, 2, 3], 1), (6, [1, 2, 3], 7)]
    got = sorted(tuple(r) for r in negatives.mined(vectors(spark, rows, {0})).collect())
    # row 0 stands twice, so each of its rows twice; row 1 is its best positive (5), the empty vector scores 0
    assert got == []
    rows += [(7, [5, 0, 0], 2), (8, [2, 1], 9)]
    got = sorted(tuple(r) for r in negatives.mined(vectors(spark, rows, {0})).collect())
    assert got == sorted(2 * [(0, 1, 1, 7, 5, 5), (0, 1, 2, 8, 5, 4)])
    assert negatives.mined(vectors(spark, rows, set())).count() == 0
    assert negatives.mined(vectors(spark, [], set())).count() == 0


def test_usable_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan")]), (4, [float("-inf"), 1.0]), (5, [])]
    d = spark.createDataFrame(rows, "id int, v array<float>")
    assert sorted(r.id for r in d.filter(negatives.usable(F.col("v"))).collect()) == [0, 5]


def test_scan_drops_rows_before_the_end():
    """Far rows leave the bitmap after the first dimensions, so few values of the last ones are read."""
    rng = np.random.default_rng(0)
    values = rng.integers(-3, 4, (64, 1000))
    values[:8] += np.where(np.arange(1000) < 10, 100, -100)
    slab = negatives.Slab.read(np.arange(1000).astype("<i8").tobytes(), np.zeros(1000, "<i8").tobytes(), values.astype("<i4").tobytes(), 64, True, [200] * 64)
    query = np.full(64, 1)
    query[:8] = 100
    reads = []

    class Watched(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, tuple) and len(key) == 2:
                reads.append(np.size(key[1]))
            return super().__getitem__(key)

    watched = slab._replace(values=slab.values.view(Watched))
    at, score = negatives.scan(watched, query, np.ones(1000, bool), [(50_000, math.inf)])
    assert at.tolist() == list(range(10)) and score.tolist() == (query @ values[:, :10]).tolist()
    assert reads and max(reads) == 10


# --- languages


def brute_runs(text):
    line = "\x01" + "\x01".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + "\x01"
    out = Counter()
    for n in (1, 2, 3):
        for i in range(len(line) - n + 1):
            g = line[i : i + n]
            if g.strip("\x01") and not (n == 3 and g[1] == "\x01"):
                out[sum(ord(c) << 21 * (n - 1 - k) for k, c in enumerate(g))] += 1
    return out


def brute_language(rows, texts):
    """The rule of profiles, by dictionaries."""
    by = {}
    for text, lang in rows:
        if text is not None and lang is not None:
            by.setdefault(lang, Counter()).update(brute_runs(text))
    order = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:300]]
    places = {lang: {g: i for i, g in enumerate(order(c))} for lang, c in sorted(by.items())}
    out = []
    for t in texts:
        own = order(brute_runs(t or ""))
        if not own or not places:
            out.append(("und", 0.0))
            continue
        away = {lang: sum(abs(i - p[g]) if g in p else 300 for i, g in enumerate(own)) for lang, p in places.items()}
        best = min(away, key=lambda k: (away[k], k))
        out.append((best, 1 - away[best] / (300 * len(own))))
    return out


def test_languages_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", 50)
    monkeypatch.setattr(langid, "HELD", 100)
    rng = random.Random(6)
    parts = {"xx": ["ka", "lo", "né", "ñ", "tu"], "yy": ["sh", "th", "ing", "er", "a"], "zz": ["мо", "ска", "я", "文"]}
    make = lambda lang: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))).capitalize() + rng.choice(["", ",", "!", "2"]) for _ in range(rng.randrange(1, 30)))
    rows = [(i, make(lang), lang) for i, lang in enumerate(rng.choices(sorted(parts), k=150))]
    odd = [(900, None, "xx"), (901, "", "xx"), (902, " 12 .,!", "yy"), (903, "ka lo", None), (904, "x" * 3000 + " " + make("yy"), "yy"), (905, rows[0][1], rows[0][2]), (None, "tu né", "xx")]
    docs = docs_of(spark, [(i, t) for i, t, _ in rows + odd], {i: lang for i, _, lang in rows + odd})
    profiles = langid.learned(docs)
    assert profiles.languages == ["xx", "yy", "zz"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identified(docs.drop("score"), profiles).collect()}
    want = brute_language([(t, lang) for _, t, lang in rows + odd], [t for _, t, _ in rows + odd])
    for (i, _, _), (lang, score) in zip(rows + odd, want):
        assert got[i] == (lang, pytest.approx(score)), i
    assert got[900] == got[901] == got[902] == ("und", 0.0)
    assert sum(got[i][0] == lang for i, _, lang in rows) > 140
    none = langid.learned(docs.filter("false"))
    assert {r.lang_pred for r in langid.identified(docs.drop("score"), none).collect()} == {"und"}
    assert langid.identified(docs.drop("score").filter("false"), profiles).count() == 0


def test_held_out_languages(spark):
    """Held-out accuracy; a held-out row's language has no effect."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = queries.op12_language(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and {r.doc_id for r in held} == {i for i in range(1000) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


# --- importance resampling


def brute_resampling(texts, target, percent=5):
    runs = lambda t: [zlib.crc32(b" ".join(w[i : i + n])) % 10_000 for w in [WORD.findall((t or "").encode().translate(LOWER))] for n in (1, 2, 3) for i in range(len(w) - n + 1)]
    s, t = Counter(k for _, x in texts for k in runs(x)), Counter(k for x in target for k in runs(x))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda k: math.floor(1000 * math.log((t[k] + 1) * (s_all + 10_000) / ((s[k] + 1) * (t_all + 10_000))))
    rows = []
    for i, x in texts:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, runs(x)))
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((len(WORD.findall((x or "").encode().translate(LOWER))) >= 20, score, i, len(runs(x)), weight))
    rows.sort(key=lambda r: (-r[0], -r[1], r[2] is None, r[2] or 0))
    k = percent * sum(r[0] for r in rows) // 100
    return sorted(((i, n, w, s, j + 1 if j < k else None) for j, (_, s, i, n, w) in enumerate(rows)), key=str)


def resampling_case():
    rng = random.Random(8)
    vocabulary = [f"{rng.choice('abcÉñ文')}{k}" for k in range(300)]
    texts = [(i, "".join(rng.choice(vocabulary if i % 3 else vocabulary[:40]) + rng.choice([" ", ", ", "\n", "  ", "--"]) for _ in range(rng.randrange(60)))) for i in range(250)]
    texts += [(900, None), (901, ""), (902, " ., "), (903, "A" * 5000 + " " + "b" * 65 + " c"), (904, "same words " * 30), (904, "same words " * 30), (None, "no id " * 30), (905, " ".join(f"w{k}" for k in range(30_000)))]
    return texts, [t for i, t in texts[:250] if i % 3 == 0 and i < 100] + [None, ""]


@pytest.mark.parametrize("words", [0, 60, 50_000])
def test_resampling_matches_brute_force_for_any_dictionary(spark, monkeypatch, words):
    """The dictionary, empty, partial or full, has no effect on results, nor have chunks."""
    monkeypatch.setattr(resample, "DICTIONARY_WORDS", words)
    monkeypatch.setattr(resample, "CHUNK", 2_000)
    texts, target = resampling_case()
    docs, aims = docs_of(spark, texts).repartition(4), spark.createDataFrame([(t,) for t in target], "text string")
    for percent in (5, 40):
        got = sorted((tuple(r) for r in resample.ranked(docs, aims, percent).collect()), key=str)
        assert got == brute_resampling(texts, target, percent)
    some = resample.drawn(docs, aims, 40)
    assert some.columns == docs.columns and sorted(str(r.doc_id) for r in some.collect()) == sorted(str(r[0]) for r in got if r[4])


def test_resampling_of_empty_tables(spark):
    none = docs_of(spark, []).select("doc_id", "text")
    assert resample.ranked(none, none).count() == 0 and resample.drawn(none, none).count() == 0
    rows = resample.ranked(docs_of(spark, [(1, "a b c " * 10), (2, None)]), none).orderBy("doc_id").collect()
    assert [(r.n_features, r.rank) for r in rows] == [(87, None), (0, None)]  # 5 % of one document is none


def test_crc_of_composed_runs():
    shift = resample.Shift()
    for a, b in [(b"", b""), (b"x", b"y" * 64), (b"abc", b"z" * 65), (b"q", b"r" * 70_001)]:
        moved = shift(np.array([zlib.crc32(a)], np.uint32), np.array([len(b)]))
        assert int(moved[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)
