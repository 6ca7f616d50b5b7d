"""Main text of pages by wrappers: union-free regular expressions inferred from the pages of a host.

A page is a stream of tags and texts; a tag is an element's name with the first
word of its class. Texts that most pages of the host hold at one place are
anchors; they are counted first. The streams of a host are then aligned: equal
tags match and are aligned inside, texts that differ become a slot, adjacent
repeats of a tag or of a short group of tags become one repeated group (but
nothing that holds an anchor), and what only some pages have becomes optional. A
node of the resulting expression knows how many pages have it and how many words
its slots took.

The wrapper tells the main text. Anchors are template. The region of the main
text is the article or main element if it holds a quarter of the words in slots;
else the expression is followed from the root to the child that holds most of
them, as long as one child does, is not itself a repeated group, and hardly any
words stand beside it. Of the page,
the region's slots are kept, and a first-level heading on the way to it. Inside
the region, elements for menus, headers, footers, asides and forms go, and so do
parts whose class, id or role hints at adverts, notices or comments, if the
wrapper shows that they hold the lesser part of its words. Where a page lacks
its host's region, all but elements of that sort and hinted parts is kept.

Pages with equal expressions are counted together. Different ones meet in a
fixed order, by their text, in groups of a bounded number of pages and in as
many rounds as the largest host needs; so the result depends on the pages alone,
not on how they are partitioned.

Defined results: null and empty html give an empty text; unclosed and stray tags
are read as browsers do, as far as blocks go, at any depth and in time linear in
the page; a wrapper of few pages has no template, but a region; pages without a
host in their url share one; repeated rows get equal texts; of children with
equal words the first counts; an empty table gives an empty table; nothing is
cut or capped.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_counted, materialize

#: Elements without main text, elements without markup, lone elements, and elements that part blocks.
BOILERPLATE = frozenset("nav header footer aside form menu dialog svg select button object canvas head".split())
RAW = frozenset("script style noscript textarea title template iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
MAIN = frozenset(("article", "main"))
#: What ends when such an element begins, up to the nearest of the others.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"})}
#: Words of a class, id or role that hint at a part without main text, and words that may stand beside them in one name.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner banners promo promos promotion sponsor sponsored comment comments commentlist disqus reply replies respond sidebar widget widgets nav navbar navigation menu menus breadcrumb breadcrumbs footer masthead topbar toolbar notice notices cookie cookies cookiebar consent gdpr newsletter subscribe signup login share sharing social related recommended recommendations popup modal overlay pagination pager skip complementary contentinfo".split()
)
BESIDE = frozenset("list box bar block body links link posts articles button buttons section area container wrapper wrap form item items left right top bottom main site page global header inner outer side primary secondary text content reader readers user users".split())
_HEADER = frozenset("site-header page-header top-header main-header global-header header".split())
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: Numbers at the end of a name, which tell parts of one sort apart, and signs that a tag's form has a meaning for.
_NUMBER = re.compile(r"[-_]?[0-9]+$|[.!~=#]")
_NAMED = re.compile("class|id|role|hidden|style", re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_SPACE = re.compile("[\\s​﻿]+")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in RAW}

#: Pages that a template text needs at least, and the share of the host's pages.
EVIDENCE, EVIDENCE_SHARE = 4, 0.5
#: Shares of a host's words in slots: of an article that is the region, of a child that is followed, and of the region's words that a hinted part stays below.
ARTICLE_SHARE, FOLLOW_SHARE, HINT_SHARE = 0.25, 0.6, 1 / 3
#: Share of a host's words beside the children that are followed, above which the region is reached.
OWN_SHARE = 0.02
#: Pages of a host whose expressions meet in one group, and groups that meet in the next.
GROUP_PAGES, GROUP_FAN = 5_000, 64
#: Host expressions that one task holds before it passes them on.
HELD = 5_000

_ZEROS, _TOO_LARGE = re.compile("&#0+(?=[0-9])"), re.compile("&#[1-9][0-9]{7,};?")

Token = tuple[str, str, bool]  # "<" tag, ">" or "#" text; for texts: whether it is in boilerplate


def _hinted(value: str, main: bool) -> bool:
    for name in value.split():
        parts = [p for p in re.split(r"[-_]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if p]
        if any(p in HINTS for p in parts) and all(p in HINTS or p in BESIDE or p.isdigit() for p in parts):
            return True
        if not main and "-".join(parts) in _HEADER:
            return True
    return False


def _tag(name: str, attributes: str, main: bool) -> tuple[str, bool, bool]:
    """The tag's form in the stream, whether it hints at a part without main text, and whether it is hidden."""
    first = hint = ""
    hidden = False
    for a in _ATTRIBUTE.finditer(attributes):
        key, value = a.group(1).lower(), a.group(2) or a.group(3) or a.group(4) or ""
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            hidden = True
        elif key in ("class", "id", "role"):
            if key != "role" and value.strip() and (not first or key == "class"):
                first = _NUMBER.sub("", value.split()[0].lower())
            if name not in ("html", "body", "main") and _hinted(value, main):
                hint = "!"
    return name + ("." + first if first else "") + hint, bool(hint), hidden


def decoded(text: str) -> str:
    """``text`` with its character references decoded. Numbers of any length: zeros in front go, and what no character can have becomes U+FFFD."""
    if "&#" in text:
        text = _TOO_LARGE.sub("\ufffd", _ZEROS.sub("&#", text))
    return entities.unescape(text)


def stream(source: str) -> list[Token]:
    """Tags and texts of one page in order; elements without text are left out. Tags of boilerplate end in ``~``, hinted ones in ``!``."""
    out: list[Token] = []
    stack: list[tuple[str, str, bool]] = []  # name, tag, whether outside of it is boilerplate
    open_: Counter = Counter()
    bad = False
    sent = mains = 0  # elements of the stack that are in the stream, and article or main elements
    text: list[str] = []

    def block() -> None:
        nonlocal sent
        joined = "".join(text)
        text.clear()
        if joined and not joined.isspace() and (joined := _SPACE.sub(" ", decoded(joined)).strip()):
            for s in stack[sent:]:
                out.append(("<", s[1], False))
            sent = len(stack)
            out.append(("#", joined, bad))

    def close(upto: int) -> None:
        nonlocal sent, bad, mains
        bad = stack[upto][2]
        for name, *_ in stack[upto:]:
            open_[name] -= 1
            mains -= name in MAIN
        while sent > upto:
            out.append((">", "", False))
            sent -= 1
        del stack[upto:]

    def nearest(names) -> int:
        if not any(open_[n] > 0 for n in names):
            return -1
        return next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in names)

    at, n, form = 0, len(source), _TAG
    while (less := source.find("<", at)) >= 0:
        text.append(source[at:less])
        mark = source[less + 1 : less + 2]
        if mark in ("!", "?"):
            begin, end = ("<!--", "-->") if source.startswith("<!--", less) else ("<![CDATA[", "]]>") if source.startswith("<![CDATA[", less) else ("<!", ">")
            stop = source.find(end, less + len(begin))
            if begin == "<![CDATA[":
                text.append(entities.escape(source[less + len(begin) : n if stop < 0 else stop]))
            at = n if stop < 0 else stop + len(end)
            continue
        letter = source[less + 2 : less + 3] if mark == "/" else mark
        if not (letter.isascii() and letter.isalpha()):
            text.append("<")
            at = less + 1
            continue
        m = form.match(source, less)
        if not m and form is _TAG:  # a quote never ends: from here on a tag ends at the next sign of its end
            form = _LOOSE
            m = form.match(source, less)
        if not m:  # the page ends inside of a tag
            at = n
            break
        at = m.end()
        name = m.group(2).lower()
        if name in VOID:
            if name == "hr":
                block()
            text.append(" ")
            continue
        if m.group(1):
            if name in BLOCK:
                block()
            if open_[name] > 0:
                end = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name or name not in BLOCK and stack[i][0] in BLOCK)
                if stack[end][0] == name:
                    if end < sent or stack[end][1][-1] in "!~":
                        block()
                    close(end)
            continue
        if name in RAW:
            end_tag = _RAW_END[name].search(source, at)
            at = end_tag.end() if end_tag else n
            continue
        attributes = m.group(3)
        tag, hint, hidden = _tag(name, attributes, mains > 0) if attributes and _NAMED.search(attributes) else (name, False, False)
        if name in BLOCK:
            block()
            ends, within = IMPLIED.get(name, (frozenset(), frozenset()))
            i = nearest(ends | within) if ends else -1
            if i < 0 or stack[i][0] not in ends:
                i = len(stack) - 1
                while i >= 0 and stack[i][0] not in BLOCK:
                    i -= 1
                i = i if i >= 0 and stack[i][0] == "p" else -1
            if i >= 0:
                close(i)
        elif not (hint or hidden or name in BOILERPLATE or stack and stack[-1][0] == name):
            continue  # plain inline markup
        elif (hint or hidden or name in BOILERPLATE) and not bad:
            block()
        out_of = hidden or name in BOILERPLATE and not (mains and name == "header")
        stack.append((name, tag + "~" * out_of, bad))
        open_[name] += 1
        mains += name in MAIN
        bad = bad or out_of
    text.append(source[at:])
    block()
    if stack:
        close(0)
    return out


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=6).digest(), "big") or 1


@lru_cache(1 << 16)
def _step(path: int, tag: str) -> int:
    """The place of an element, from that of its parent."""
    return _hash(f"{path} {tag}")


def _key(path: int, text: int) -> int:
    """A text at its place."""
    return _hash(f"{path}:{text}")


class Node:
    """A node of an expression: an element, or a text (``#``: a slot; ``#=`` and its hash: an anchor).

    An element that holds an anchor has ``=`` in its name, and behind it the
    hashes if it holds anchors alone; such nodes are aligned only with their like.
    """

    __slots__ = ("children", "name", "pages", "repeated", "words")

    def __init__(self, name: str, pages: int = 0, repeated: int = 0, words: int = 0):
        self.name, self.pages, self.repeated, self.words, self.children = name, pages, repeated, words, []

    @property
    def tag(self) -> str:
        return self.name.split("=")[0]

    @property
    def element(self) -> str:
        return re.split(r"[.!~=]", self.name, maxsplit=1)[0]


def expression(tokens: list[str], texts: list[int], words: list[int], keys: list[int], anchors: frozenset[int]) -> Node:
    """The folded expression of one page."""
    root = Node("", 1)
    path, k = [root], 0
    for token in tokens:
        if token == "#":
            path[-1].children.append(Node(f"#={texts[k]}", 1, 0, 0) if keys[k] in anchors else Node("#", 1, 0, words[k]))
            k += 1
        elif token == ">":
            done = path.pop()
            if any("=" in c.name for c in done.children):
                alone = all(c.name.startswith("#=") for c in done.children)
                done.name += "=" + (".".join(c.name[2:] for c in done.children) if alone else "")
        else:
            node = Node(token[1:], 1)
            path[-1].children.append(node)
            path.append(node)
    return merged([root])


Slot = tuple[str, int, list[tuple[int, Node]]]  # name, whether repeated, the nodes that it holds and whose they are


def _folded(slots: list[Slot]) -> list[Slot]:
    """Adjacent repeats of up to three slots with equal names become one repeated group; what holds an anchor stays as it is."""
    for period in (1, 2, 3):
        out: list[Slot] = []
        for slot in slots:
            out.append(slot)
            if len(out) >= 2 * period and all(out[-i][0] == out[-i - period][0] and "=" not in out[-i][0] for i in range(1, period + 1)):
                again, out = out[-period:], out[:-period]
                for i, (name, _, members) in enumerate(again, len(out) - period):
                    out[i][2].extend(members)
                    out[i] = (name, 1, out[i][2])
        slots = out
    return slots


def _steps(a: list[str], b: list[str]) -> Iterator[tuple[bool, bool]]:
    """A walk along a longest common subsequence of ``a`` and ``b`` until one ends: whether both move, or else whether ``a`` does; ``a`` does if nothing is lost by it.

    Row i has a bit for each place j of ``b`` at which the greatest length left,
    of a[i:] and b[j:], is one more than at j + 1. A row follows from the next by a
    few operations on whole numbers of len(b) bits. Every ``gap``-th row is kept,
    the rest are made again from these, so what is held grows with the root of
    len(a), and sizes have no effect on the walk.
    """
    full = (1 << len(b)) - 1
    where: dict[str, int] = {}
    for j, name in enumerate(reversed(b)):  # bit 0 is the last place of b
        where[name] = where.get(name, 0) | 1 << j

    def rows(upto: int, down: int, row: int) -> list[int]:
        """Rows ``upto`` - 1 to ``down``, from row ``upto``; zeros are the places where the length grows."""
        out = []
        for i in range(upto - 1, down - 1, -1):
            u = row & where.get(a[i], 0)
            row = ((row + u) | (row - u)) & full
            out.append(row)
        return out

    gap = max(1, math.isqrt(len(a)))
    kept = {len(a): full}
    for upto in range(len(a), 0, -gap):
        down = max(0, upto - gap)
        kept[down] = rows(upto, down, kept[upto])[-1]
    stops = sorted(kept)
    i = j = at = 0
    held: list[int] = []  # rows of the stretch from stops[at], in order
    while i < len(a) and j < len(b):
        if i >= stops[at]:
            upto = stops[at + 1]
            held = [*reversed(rows(upto, stops[at], kept[upto])), kept[upto]]
            base, at = stops[at], at + 1
        if a[i] == b[j]:
            yield True, True
            i, j = i + 1, j + 1
            continue
        left = (1 << (len(b) - j)) - 1
        first = (~held[i - base] & left).bit_count() == (~held[i + 1 - base] & left).bit_count()
        yield False, first
        i, j = i + first, j + (not first)


def _aligned(x: list[Slot], y: list[Slot]) -> list[Slot]:
    """Slots of two streams by a longest common subsequence of names; what is beside it stays as it is, optional by its pages."""

    def both(p: Slot, q: Slot) -> Slot:
        return p[0], p[1] | q[1], p[2] + q[2]

    head = 0
    while head < min(len(x), len(y)) and x[head][0] == y[head][0]:
        head += 1
    tail = 0
    while tail < min(len(x), len(y)) - head and x[-1 - tail][0] == y[-1 - tail][0]:
        tail += 1
    before = [both(p, q) for p, q in zip(x[:head], y[:head], strict=True)]
    after = [both(p, q) for p, q in zip(x[len(x) - tail :], y[len(y) - tail :], strict=True)]
    a, b = x[head : len(x) - tail], y[head : len(y) - tail]
    if not a or not b:
        return [*before, *a, *b, *after]
    middle, i, j = [], 0, 0
    for same, first in _steps([p[0] for p in a], [q[0] for q in b]):
        middle.append(both(a[i], b[j]) if same else a[i] if first else b[j])
        i, j = i + (same or first), j + (same or not first)
    return [*before, *middle, *a[i:], *b[j:], *after]


def merged(nodes: list[Node]) -> Node:
    """One expression that generates what all of ``nodes``, of one name, do. Levels wait in a list, so depth is no matter."""
    out = Node(nodes[0].name)
    todo: list[tuple[Node, list[tuple[int, Node]]]] = [(out, list(enumerate(nodes)))]
    while todo:
        node, members = todo.pop()
        pages: dict[int, int] = {}
        for whose, m in members:
            pages[whose] = max(pages.get(whose, 0), m.pages)
            node.words += m.words
            node.repeated |= m.repeated
        node.pages = sum(pages.values())
        slots: list[Slot] = []
        for whose, m in members:
            own = _folded([(c.name, c.repeated, [(whose, c)]) for c in m.children])
            slots = _aligned(slots, own) if slots else own
        for name, repeated, held in _folded(slots) if len(members) > 1 else slots:
            child = Node(name, repeated=repeated)
            node.children.append(child)
            todo.append((child, held))
    return out


def _flat(root: Node) -> Iterator[tuple[int, Node]]:
    """Nodes with their depths, parents first."""
    todo = [(0, root)]
    while todo:
        depth, node = todo.pop()
        yield depth, node
        todo.extend((depth + 1, c) for c in reversed(node.children))


def dumped(root: Node) -> tuple[str, list[int], list[int]]:
    """An expression as the text of its form, and the pages and words of its nodes."""
    rows = list(_flat(root))
    return json.dumps([[d, n.name, n.repeated] for d, n in rows], separators=(",", ":")), [n.pages for _, n in rows], [n.words for _, n in rows]


def loaded(form: str, pages: list[int], words: list[int]) -> Node:
    path: list[Node] = []
    for (depth, name, repeated), p, w in zip(json.loads(form), pages, words, strict=True):
        node = Node(name, p, repeated, w)
        del path[depth:]
        if path:
            path[-1].children.append(node)
        path.append(node)
    return path[0]


class Rule(NamedTuple):
    """What a wrapper says of its pages: keys of template texts, places of the region, of headings before it, and of parts that go; whether article and main elements are the region."""

    template: frozenset[int] = frozenset()
    region: frozenset[int] = frozenset()
    heads: frozenset[int] = frozenset()
    drop: frozenset[int] = frozenset()
    article: bool = False


def rule_of(wrapper: Node) -> Rule:
    rows = list(_flat(wrapper))
    place: dict[int, int] = {id(wrapper): 0}
    mass: dict[int, int] = {}
    inside: dict[int, bool] = {id(wrapper): False}
    template: set[int] = set()
    slots = 0
    for _, node in rows:
        mass[id(node)] = 0 if node.name.startswith("#=") else node.words
        for child in node.children:
            if child.name.startswith("#"):
                if child.name == "#":
                    slots += 1
                else:
                    template.add(_key(place[id(node)], int(child.name[2:])))
            else:
                place[id(child)] = _step(place[id(node)], child.tag)
                inside[id(child)] = inside[id(node)] or child.element in MAIN and "!" not in child.tag
    for _, node in reversed(rows):
        mass[id(node)] += sum(mass[id(c)] for c in node.children if "~" not in c.tag)
    elements = [n for _, n in rows if not n.name.startswith("#")]
    outer = [n for n in elements if n.element in MAIN and "!" not in n.tag and mass[id(n)]]
    heads: set[int] = set()
    tops = {id(c) for n in elements if not inside[id(n)] for c in n.children if not c.name.startswith("#") and inside[id(c)]}
    article = sum(mass[id(n)] for n in outer if id(n) in tops) >= ARTICLE_SHARE * mass[id(wrapper)] and bool(outer)
    if article:
        region = [n for n in outer if id(n) in tops]
    else:
        node, beside = wrapper, 0
        while True:
            kids = [c for c in node.children if not c.name.startswith("#") and "~" not in c.tag]
            best = max(kids, key=lambda c: mass[id(c)], default=None)
            beside += sum(c.words for c in node.children if c.name == "#")
            if best is None or best.repeated or beside > OWN_SHARE * mass[id(wrapper)] or mass[id(best)] < FOLLOW_SHARE * mass[id(wrapper)] or all(c.name.startswith("#") for c in best.children):
                break
            heads.add(place[id(node)])
            node = best
        region = [node]
    total = max(1, sum(mass[id(n)] for n in region))
    drop = {place[id(n)] for n in elements if "!" in n.tag and n not in region and mass[id(n)] < HINT_SHARE * total}
    return Rule(frozenset(template) if slots else frozenset(), frozenset(place[id(n)] for n in region), frozenset(heads), frozenset(drop), article)


def main_text(source: str | None, rule: Rule | None = None) -> str:
    """Blocks of the main part, joined by two line breaks. Without a rule the page is its own wrapper."""
    tokens = stream(source or "")
    if rule is None:
        rule = rule_of(expression(*_coded(tokens)[:4], frozenset()))
    kept, other = [], []
    # for each open element: its place, whether it is in the region, goes by the wrapper, or goes by its tag alone
    path = [(0, 0 in rule.region, False, False, "")]
    for kind, value, bad in tokens:
        at, region, gone, hinted, element = path[-1]
        if kind == "<":
            place = _step(at, value)
            name = re.split(r"[.!~]", value, maxsplit=1)[0]
            inside = region or place in rule.region or rule.article and name in MAIN and "!" not in value
            path.append((place, inside, gone or "~" in value or place in rule.drop, hinted or "~" in value or "!" in value, name))
        elif kind == ">":
            path.pop()
        elif _key(at, _hash(value)) not in rule.template:
            head = element == "h1" and len(path) > 1 and path[-2][0] in rule.heads
            if (region or head) and not gone:
                kept.append(value)
            if not hinted and not bad:
                other.append(value)
    return "\n\n".join(kept or other)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _coded(tokens: list[Token]) -> tuple[list[str], list[int], list[int], list[int], list[int]]:
    """Tokens without texts, hashes and words of the texts, their keys, and the distinct keys outside of boilerplate."""
    names, texts, words, keys, main = [], [], [], [], set()
    path = [0]
    for kind, value, bad in tokens:
        if kind == "<":
            path.append(_step(path[-1], value))
            names.append("<" + value)
        elif kind == ">":
            path.pop()
            names.append(">")
        else:
            names.append("#")
            texts.append(_hash(value))
            words.append(value.count(" ") + 1)
            keys.append(_key(path[-1], texts[-1]))
            if not bad:
                main.add(keys[-1])
    return names, texts, words, keys, sorted(main)


_PARSED = "host string, tokens array<string>, texts array<bigint>, words array<bigint>, keys array<bigint>, main array<bigint>"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        coded = [_coded(stream(source or "")) for source in batch.column(1).to_pylist()]
        columns = list(zip(*coded, strict=True)) or [[]] * 5
        kinds = [pa.string(), *[pa.int64()] * 4]
        arrays = [batch.column(0), *[pa.array(list(c), pa.list_(k)) for c, k in zip(columns, kinds, strict=True)]]
        yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in _PARSED.split(", ")])


_FORMS = "host string, groups bigint, form string, pages array<bigint>, words array<bigint>"


def _added(held: dict, key: tuple, pages: list[int], words: list[int]) -> None:
    if key in held:
        p, w = held[key]
        held[key] = [a + b for a, b in zip(p, pages, strict=True)], [a + b for a, b in zip(w, words, strict=True)]
    else:
        held[key] = pages, words


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Expressions of single pages; those of equal form are counted together."""
    held: dict[tuple, tuple[list[int], list[int]]] = {}

    def rows() -> pa.RecordBatch:
        keys = list(held)
        columns = [[k[i] for k in keys] for i in range(3)] + [[v[i] for v in held.values()] for i in range(2)]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in _FORMS.split(", ")])

    for batch in batches:
        for name, tokens, texts, words, keys, anchors, groups in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            form, pages, n = dumped(expression(tokens, texts, words, keys, frozenset(anchors or ())))
            _added(held, (name, groups, form), pages, n)
            if len(held) >= HELD:
                yield rows()
    yield rows()


def _met(part: pd.DataFrame) -> pd.DataFrame:
    """One expression for all of a group: equal forms are added up, and the rest meet in the order of their texts."""
    held: dict[str, tuple[list[int], list[int]]] = {}
    for form, pages, words in zip(part["form"], part["pages"], part["words"], strict=True):
        _added(held, form, list(map(int, pages)), list(map(int, words)))
    nodes = [loaded(form, *held[form]) for form in sorted(held)]
    while len(nodes) > 1:  # a few at a time, so that no one expression meets all others
        nodes = [merged(nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
    form, pages, words = dumped(nodes[0])
    return pd.DataFrame({"host": part["host"].iloc[:1], "groups": part["groups"].iloc[:1], "g": part["g"].iloc[:1], "form": [form], "pages": [pages], "words": [words]})


def anchors(parsed: DataFrame, hosts: DataFrame, total: int) -> DataFrame:
    """host, anchors: keys that most pages of a host hold, at least ``EVIDENCE`` of them; about two for each block of a page at most."""
    held = parsed.select("host", F.explode("main").alias("key")).groupBy("host", "key").agg(F.count("*").alias("n")).filter(F.col("n") >= EVIDENCE)
    sizes = hosts.select(F.col("host").alias("_host"), "of", F.col("of").alias("size"))
    often = join_counted(held, sizes, {"host": "_host"}, "of", total).filter(F.col("n") >= EVIDENCE_SHARE * F.col("size"))
    return often.groupBy("host").agg(F.collect_list("key").alias("anchors"))


def wrappers(pages: DataFrame) -> tuple[DataFrame, int]:
    """host, of (its pages), form, pages, words: one expression for each host, aligned over all its pages (url, html); and the number of all pages.

    Pages are read once, and their streams written with hashes in place of texts:
    for the anchors, and then for the expressions.
    """
    parsed = materialize(pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(_parsed, _PARSED))
    total = parsed.count()
    hosts = materialize(parsed.groupBy("host").agg(F.count("*").alias("of")))
    known = hosts.join(anchors(parsed, hosts, total), "host", "left").select(F.col("host").alias("_host"), "of", "anchors", F.ceil(F.col("of") / GROUP_PAGES).alias("groups"))
    anchored = join_counted(parsed.drop("main"), materialize(known), {"host": "_host"}, "of", total)
    schema = "host string, groups bigint, g bigint, form string, pages array<bigint>, words array<bigint>"
    forms = anchored.select("host", "tokens", "texts", "words", "keys", "anchors", "groups").mapInArrow(_forms, _FORMS)
    forms = materialize(forms.withColumn("g", F.pmod(F.xxhash64("form"), F.col("groups"))).select(*[c.split()[0] for c in schema.split(", ")]))
    most = hosts.agg(F.max("of")).first()[0] or 0
    groups = -(-most // GROUP_PAGES)
    while True:
        forms = forms.groupBy("host", "g").applyInPandas(_met, schema)
        if groups <= 1:
            break
        groups = -(-groups // GROUP_FAN)
        forms = materialize(forms).withColumn("g", F.floor(F.col("g") / GROUP_FAN))
    return forms.select("host", "form", "pages", "words").join(hosts, "host"), total


_RULE = "template array<bigint>, region array<bigint>, heads array<bigint>, drop array<bigint>, article boolean"


def _rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rules = [rule_of(loaded(f, p, w)) for f, p, w in zip(*[batch.column(i).to_pylist() for i in (2, 3, 4)], strict=True)]
        lists = [pa.array([sorted(r[i]) for r in rules], pa.list_(pa.int64())) for i in range(4)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists, pa.array([r.article for r in rules], pa.bool_())], names=["_host", "of", *Rule._fields])


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row for each row of ``pages`` (page_id, url, html)."""
    pages = pages.select("page_id", "url", "html")
    found, total = wrappers(pages)
    rules = materialize(found.select("host", "of", "form", "pages", "words").mapInArrow(_rules, f"_host string, of bigint, {_RULE}"))
    joined = join_counted(pages.withColumn("host", host(F.col("url"))), rules, {"host": "_host"}, "of", total, by=("page_id", "url")).drop("host")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[tuple, Rule] = {}
        for batch in batches:
            texts = []
            for source, *lists, article in zip(*[c.to_pylist() for c in batch.columns[2:]], strict=True):
                key = (*[tuple(x or ()) for x in lists], bool(article))
                if key not in made:
                    if len(made) >= HELD:
                        made.clear()
                    made[key] = Rule(*[frozenset(x) for x in key[:4]], key[4])
                texts.append(main_text(source, made[key]))
            n = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), n], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
