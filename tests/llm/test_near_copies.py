"""Copies of one text with changes in unlike places, around the limit of a link."""

import random

from cutlist.llm import neardup


def components(texts, k=2):
    """Smallest id of each component, by all pairs."""
    sets = {i: {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} for i, w in texts}
    found = {i: i for i in sets}

    def root(i):
        while found[i] != i:
            i = found[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                found[y] = x
    return {i: root(i) for i in sets}


def test_unlike_copies_of_one_text_are_not_paired(spark, monkeypatch):
    """Of 800 copies with 1 to 14 words changed about a third do not link with the text; some are copies of such a one, of unlike sizes."""
    rng = random.Random(11)
    text = [f"c{i}" for i in range(150)]
    texts = [(0, text)]
    for i in range(1, 801):
        copy = list(text)
        for at in rng.sample(range(150), rng.randrange(1, 15)):
            copy[at] = f"u{i}x{at}"
        texts.append((i, copy))
        if i % 20 == 0:  # a copy of this copy, changed once more or cut
            texts.append((1000 + i, [*copy[: rng.randrange(140, 150)], f"v{i}"]))
    paired = []
    meeting = neardup._meeting

    def counted(rows, items):
        met = neardup.materialize(meeting(rows, items))
        paired.append(met.count())
        return met

    monkeypatch.setattr(neardup, "_meeting", counted)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in neardup.grouped(docs, 2).collect()}
    assert got == components(texts)
    assert len(set(got.values())) > 100
    assert sum(paired) < 3 * len(texts)  # 3080 where near members met by the rarest of all their shingles
