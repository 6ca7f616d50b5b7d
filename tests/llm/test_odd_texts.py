"""Numbers of any length in texts and pages, and alignments of any size."""

import random

import pytest

from cutlist.llm import html, pii


def test_address_parts_of_any_length():
    zeros = "0" * 5000
    assert pii.base_spans(zeros + ".1.1.1") == [(0, 1, 5006)]
    assert pii.base_spans(f"1.{zeros}255.1.1") == [(0, 1, 5009)]
    assert pii.base_spans("9" * 5000 + ".1.1.1") == pii.base_spans(f"1.{zeros}256.1.1") == []


@pytest.mark.parametrize(
    "written, read",
    [("&#65;&#065;&#x41;", "AAA"), ("a&#" + "9" * 5000 + ";b", "a�b"), ("&#" + "0" * 5000 + "65;", "A"), ("&#x" + "f" * 5000 + ";", "�"), ("&amp;#65;&#;&#a", "&#65;&#;&#a"), ("&#" + "0" * 5000, "�"), ("&#1114112;", "�")],
)
def test_character_references_of_any_length(written, read):
    assert html.decoded(written) == read
    assert "".join(t[1] for t in html.stream(f"<p>{written}</p>") if t[0] == "#") == read


def table_walk(a, b):
    """The walk by the whole table of lengths."""
    length = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            length[i][j] = 1 + length[i + 1][j + 1] if a[i] == b[j] else max(length[i + 1][j], length[i][j + 1])
    i = j = 0
    while i < len(a) and j < len(b):
        same, first = a[i] == b[j], length[i + 1][j] >= length[i][j + 1]
        yield (True, True) if same else (False, first)
        i, j = i + (same or first), j + (same or not first)


def test_alignment_is_that_of_the_table():
    rng = random.Random(2)
    for _ in range(400):
        names = "abcdefgh"[: rng.choice([1, 2, 3, 8])]
        a, b = ([rng.choice(names) for _ in range(rng.randrange(1, 50))] for _ in range(2))
        assert list(html._steps(a, b)) == list(table_walk(a, b))


def test_alignment_of_long_unlike_streams():
    """Over 20 000 places each: exact, as a subsequence hidden in both is found whole."""
    rng = random.Random(3)
    hidden = [f"h{i}" for i in range(5000)]
    a, b = ([*hidden, *(f"{side}{i}" for i in range(15_000))] for side in "ab")
    order = lambda x: [n for _, n in sorted((i / 5000 if n[0] == "h" else rng.random(), n) for i, n in enumerate(x))]  # noqa: E731  hidden names stay in their order
    assert sum(same for same, _ in html._steps(order(a), order(b))) == 5000
