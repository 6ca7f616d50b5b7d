"""Personal data: base patterns, and a character BiLSTM with CRF transitions that adds spans.

The tagger is trained in numpy, on the driver, from at most ``TRAIN_WINDOWS``
labelled windows: windows around base matches, taken from all documents in hash
order, and the same windows with the match rewritten into another form of its
kind. It reads a text in overlapping windows. Every character's scores are
averaged over the windows that cover it, and one Viterbi pass over each covered
stretch gives spans, so the windows never contradict each other.

A span of any kind holds a digit or an at sign, so only windows with one are
read; no other window could yield a span. Tagged spans that overlap a base match
are dropped, as base matches stay as they are.

Defined results: null and empty texts have no spans; rows are judged one by one,
so repeated rows get equal results; texts of any length are read whole, window by
window; spans at one place go in the order of their kinds; a table without any
match, or without rows, trains on written examples alone.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Kinds in their order, and the base patterns.
KINDS = ("email", "ip", "card", "phone")
_AT = re.compile(r"([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")

TRAIN_WINDOWS = 1200
WINDOW, STRIDE = 64, 32
HIDDEN = 16
CLASSES = 130  # ASCII, one for all else, one beside the text
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
EPOCHS, LEAST_STEPS = 4, 150

Span = tuple[int, int, int]  # start, kind, end


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: a local part reaches back to its run's start or the last match's end."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _AT.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)


def _at_most_255(digits: str) -> bool:
    """By the digits behind leading zeros, so a part may be of any length."""
    rest = digits.lstrip("0")
    return len(rest) < 4 and int(rest or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """Matches of the base patterns by start, then kind; failing matches are dropped and not tried again."""
    if not _TRIGGER.search(text):
        return []
    found = [(a, 0, b) for a, b in _emails(text)]
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(_at_most_255(p) for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        if 14 <= len(d) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return sorted(found)


def _codes(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.minimum(c, 128).astype(np.int16)


@dataclass
class Tagger:
    """Weights: per direction the gates' inputs by character and by state; scores by states; transitions."""

    by_char: np.ndarray  # 2, CLASSES, 4 * HIDDEN
    by_state: np.ndarray  # 2, HIDDEN, 4 * HIDDEN
    to_tag: np.ndarray  # 2 * HIDDEN, TAGS
    tag_bias: np.ndarray  # TAGS
    transition: np.ndarray  # TAGS, TAGS

    @staticmethod
    def new(rng: np.random.Generator) -> Tagger:
        def some(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) * 0.2).astype(np.float32)

        chars = some(2, CLASSES, 4 * HIDDEN)
        chars[:, :, HIDDEN : 2 * HIDDEN] += 1  # forget gates start open
        return Tagger(chars, some(2, HIDDEN, 4 * HIDDEN), some(2 * HIDDEN, TAGS), np.zeros(TAGS, np.float32), some(TAGS, TAGS))

    def parts(self) -> list[np.ndarray]:
        return [self.by_char, self.by_state, self.to_tag, self.tag_bias, self.transition]

    def states(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states of both directions, n x steps x 2 HIDDEN, for character classes n x steps."""
        n, steps = x.shape
        out = np.empty((n, steps, 2 * HIDDEN), np.float32)
        for way in (0, 1):
            h = np.zeros((n, HIDDEN), np.float32)
            c = np.zeros_like(h)
            for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
                z = self.by_char[way][x[:, t]] + h @ self.by_state[way]
                gate = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
                g = np.tanh(z[:, 3 * HIDDEN :])
                i, f, o = gate[:, :HIDDEN], gate[:, HIDDEN : 2 * HIDDEN], gate[:, 2 * HIDDEN :]
                before, h_before = c, h
                c = f * c + i * g
                s = np.tanh(c)
                h = o * s
                if keep is not None:
                    keep.append((way, t, i, f, o, g, before, s, h_before))
                out[:, t, way * HIDDEN : (way + 1) * HIDDEN] = h
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.states(x) @ self.to_tag + self.tag_bias


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _crf_gradient(score: np.ndarray, tags: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the mean negative log-likelihood, by forward and backward sums."""
    n, steps, k = score.shape
    alpha, beta = np.empty_like(score), np.zeros_like(score)
    alpha[:, 0] = score[:, 0]
    for t in range(1, steps):
        alpha[:, t] = score[:, t] + _log_sum(alpha[:, t - 1, :, None] + transition, 1)
    for t in range(steps - 2, -1, -1):
        beta[:, t] = _log_sum(transition + (score[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
    total = _log_sum(alpha[:, -1], 1)
    by_score = np.exp(alpha + beta - total[:, None, None])
    pair = alpha[:, :-1, :, None] + transition + (score[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]
    by_transition = np.exp(pair).sum(axis=(0, 1))
    rows = np.arange(n)[:, None]
    by_score[rows, np.arange(steps), tags] -= 1
    np.add.at(by_transition, (tags[:, :-1], tags[:, 1:]), -1)
    return by_score / n, by_transition / n


def _gradients(model: Tagger, x: np.ndarray, tags: np.ndarray) -> list[np.ndarray]:
    keep: list = []
    states = model.states(x, keep)
    by_score, by_transition = _crf_gradient(states @ model.to_tag + model.tag_bias, tags, model.transition)
    flat = states.reshape(-1, states.shape[2])
    d_to_tag, d_bias = flat.T @ by_score.reshape(-1, TAGS), by_score.sum(axis=(0, 1))
    d_states = by_score @ model.to_tag.T
    d_char, d_state = np.zeros_like(model.by_char), np.zeros_like(model.by_state)
    for way in (0, 1):
        dh = np.zeros((len(x), HIDDEN), np.float32)
        dc = np.zeros_like(dh)
        for w, t, i, f, o, g, before, s, h_before in reversed(keep):
            if w != way:
                continue
            dh = dh + d_states[:, t, way * HIDDEN : (way + 1) * HIDDEN]
            dc = dc + dh * o * (1 - s * s)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * s * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            np.add.at(d_char[way], x[:, t], dz)
            d_state[way] += h_before.T @ dz
            dh, dc = dz @ model.by_state[way].T, dc * f
    return [d_char, d_state, d_to_tag, d_bias, by_transition]


def train(windows: list[tuple[str, list[Span]]], seed: int = 7) -> Tagger:
    """A tagger fitted to labelled windows by Adam; equal input gives an equal tagger."""
    rng = np.random.default_rng(seed)
    model = Tagger.new(rng)
    x = np.full((len(windows), WINDOW), CLASSES - 1, np.int16)
    y = np.zeros((len(windows), WINDOW), np.int64)
    for k, (text, spans) in enumerate(windows):
        x[k, : min(WINDOW, len(text))] = _codes(text[:WINDOW])
        for start, kind, end in spans:
            y[k, start:end] = 2 + 2 * kind
            if start < WINDOW:
                y[k, start] = 1 + 2 * kind
    first = [np.zeros_like(p) for p in model.parts()]
    second = [np.zeros_like(p) for p in model.parts()]
    step = 0
    for _ in range(max(EPOCHS, -(-LEAST_STEPS * 64 // len(x)))):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 64):
            pick = order[at : at + 64]
            step += 1
            rate = 0.02 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for p, g, m, v in zip(model.parts(), _gradients(model, x[pick], y[pick]), first, second, strict=True):
                m += 0.1 * (np.clip(g, -5, 5) - m)
                v += 0.001 * (g * g - v)
                p -= (rate * m / (np.sqrt(v) + 1e-8)).astype(p.dtype)
    return model


def _viterbi(score: list[np.ndarray], transition: np.ndarray) -> list[np.ndarray]:
    """Best tags of stretches of any lengths, longest first; all stretches advance together."""
    lengths = np.array([len(s) for s in score])
    offset = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    flat = np.concatenate(score)
    best, back = flat[offset].copy(), []
    for t in range(1, lengths[0]):
        n = int(np.searchsorted(-lengths, -t, side="left"))
        step = best[:n, :, None] + transition
        back.append(step.argmax(axis=1).astype(np.uint8))
        best[:n] = step.max(axis=1) + flat[offset[:n] + t]
    tag = best.argmax(axis=1)
    out = np.empty(len(flat), np.uint8)
    for t in range(lengths[0] - 1, -1, -1):
        n = int(np.searchsorted(-lengths, -t, side="left"))
        out[offset[:n] + t] = tag[:n]
        if t:
            tag[:n] = back[t - 1][np.arange(n), tag[:n]]
    return np.split(out, offset[1:])


def _plausible(kind: int, text: str, a: int, b: int) -> bool:
    """The form fits the kind, and no letter or digit continues it."""
    s, d = text[a:b], _digits(text[a:b])
    if text[a - 1 : a].isalnum() or text[b : b + 1].isalnum():
        return False
    if kind == 0:
        return "@" in s and not re.search(r"\s", s) and len(s) >= 5
    if kind == 1:
        parts = s.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2 and not luhn(d):
        return False
    return (13 <= len(d) <= 19 if kind == 2 else 7 <= len(d) <= 15) and not re.search(r"[^0-9\x20().+/-]", s)


def tagged_spans(model: Tagger, texts: list[str], batch: int = 2048) -> list[list[Span]]:
    """Spans that the tagger finds in each text."""
    where: list[tuple[int, int]] = []
    for k, text in enumerate(texts):
        seen = -1
        for m in _TRIGGER.finditer(text):
            last = m.start() // STRIDE
            for w in range(max(seen + 1, last - WINDOW // STRIDE + 1, 0), last + 1):
                where.append((k, w))
            seen = last
    if not where:
        return [[] for _ in texts]
    sums: dict[int, dict[int, np.ndarray]] = {}
    for at in range(0, len(where), batch):
        part = where[at : at + batch]
        x = np.full((len(part), WINDOW), CLASSES - 1, np.int16)
        for r, (k, w) in enumerate(part):
            code = _codes(texts[k][w * STRIDE : w * STRIDE + WINDOW])
            x[r, : len(code)] = code
        for (k, w), s in zip(part, model.scores(x), strict=True):
            blocks = sums.setdefault(k, {})
            for j in range(WINDOW // STRIDE):
                piece = s[j * STRIDE : (j + 1) * STRIDE]
                old = blocks.get(w + j)
                blocks[w + j] = piece if old is None else (old + piece) / 2
    stretches: list[tuple[int, int, np.ndarray]] = []
    for k, blocks in sums.items():
        run: list[int] = []
        for b in [*sorted(blocks), -1]:
            if run and b != run[-1] + 1:
                score = np.concatenate([blocks[i] for i in run])
                start = run[0] * STRIDE
                stretches.append((k, start, score[: len(texts[k]) - start]))
                run = []
            run.append(b)
    stretches = sorted((s for s in stretches if len(s[2])), key=lambda s: -len(s[2]))
    out: list[list[Span]] = [[] for _ in texts]
    for (k, start, _), tags in zip(stretches, _viterbi([s[2] for s in stretches], model.transition), strict=True):
        i = 0
        while i < len(tags):
            if tags[i] and tags[i] % 2:
                kind, j = (int(tags[i]) - 1) // 2, i + 1
                while j < len(tags) and tags[j] == tags[i] + 1:
                    j += 1
                if _plausible(kind, texts[k], start + i, start + j):
                    out[k].append((start + i, kind, start + j))
                i = j
            else:
                i += 1
    return out


def all_spans(model: Tagger, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """For each text the base spans, and these with the tagger's spans that meet none of them."""
    out = []
    for text, tagged in zip(texts, tagged_spans(model, texts), strict=True):
        base = base_spans(text)
        free = [s for s in tagged if not any(s[0] < b[2] and b[0] < s[2] for b in base)] if base else tagged
        out.append((base, sorted(base + free)))
    return out


def _rewritten(kind: int, s: str, rng: random.Random) -> str:
    """Another form of the same kind."""
    d = _digits(s)
    if kind == 0:
        return rng.choice(["{0}@{1}", "{0}.{0}@{1}", "{0}_{0}@mail.{1}", "{0}+x@{1}"]).format("".join(rng.choices("abcdefghiklmnorstu", k=5)), rng.choice(["example.org", "post.example.net", "example.co"]))
    if kind == 1:
        return ".".join(str(rng.randrange(256)) for _ in range(4))
    if kind == 2:
        sep = rng.choice([" ", "-", ""])
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))
    return rng.choice(["({0}) {1}-{2}", "00{3} {0} {1}{2}", "{0}-{1}-{2}", "+{3} {0} {1} {2}", "0{0}/{1}{2}"]).format(d[-10:-7], d[-7:-4], d[-4:], d[:-10] or "1")


def _examples(rng: random.Random) -> list[tuple[str, list[Span]]]:
    """Written examples, so that every kind is labelled whatever the table holds."""
    out = []
    for k, seedling in enumerate(["a.b@example.com", "192.0.2.1", "4111111111111111", "+1 (555) 010-9999"]):
        for _ in range(60):
            word = "".join(rng.choices("abcdefghijklmnoprstuvwxyz ", k=rng.randrange(4, 24))) + " "
            s = _rewritten(k, seedling, rng)
            out.append((word + s + rng.choice([" and so on", ".", ", or"]), [(len(word), k, len(word) + len(s))]))
    for _ in range(60):
        word = "".join(rng.choices("abcdefghijklmnoprstuvwxyz ", k=30))
        out.append((word + rng.choice(["2.0", "1999", "page 12", "v3.1.4", "10:30", "@home"]) + word[:9], []))
    return out


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One window for each digit or at sign that starts a stretch of them, cut from the text with its base spans."""
    for batch in batches:
        keys, windows, spans = [], [], []
        for text in batch.column(0).to_pylist():
            if not text or not _TRIGGER.search(text):
                continue
            base, done = base_spans(text), -1
            for m in _TRIGGER.finditer(text):
                if m.start() < done:
                    continue
                a = max(0, m.start() - WINDOW // 2)
                b = a + WINDOW
                done = m.start() + WINDOW // 2
                piece = text[a:b]
                windows.append(piece)
                spans.append([v for s, k, e in base if s < b and e > a for v in (max(s, a) - a, k, min(e, b) - a)])
                keys.append(int.from_bytes(hashlib.blake2b(piece.encode("utf-8", "surrogatepass"), digest_size=7).digest(), "big"))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(windows, pa.string()), pa.array(spans, pa.list_(pa.int32()))], names=["key", "window", "spans"])


def fitted(docs: DataFrame) -> Tagger:
    """A tagger for these documents: all their windows are counted, and about ``TRAIN_WINDOWS`` picked by hash are labelled rows to train on.

    The hash is uniform, so a bound on it picks that many, and no task sends
    the driver more than its share.
    """
    found = materialize(docs.select("text").mapInArrow(_labelled, "key bigint, window string, spans array<int>"))
    bound = min(1.0, TRAIN_WINDOWS / max(1, found.count())) * float(1 << 56)
    rows = sorted(found.filter(F.col("key") <= int(bound)).distinct().collect())
    rng = random.Random(11)
    windows = _examples(rng)
    for row in rows:
        s = row["spans"]
        spans = [(s[i], s[i + 1], s[i + 2]) for i in range(0, len(s), 3)]
        windows.append((row["window"], spans))
        if len(spans) == 1:
            a, kind, b = spans[0]
            new = _rewritten(kind, row["window"][a:b], rng)
            windows.append((row["window"][:a] + new + row["window"][b:], [(a, kind, min(WINDOW, a + len(new)))]))
    return train(windows)


def joined_spans(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of base spans, and all spans, one row for each row of ``docs`` (doc_id, text)."""
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = all_spans(model.value, [t or "" for t in batch.column(1).to_pylist()])
            counts = [[sum(s[1] == k for s in base) for base, _ in found] for k in range(len(KINDS))]
            digest = [hashlib.sha256(joined_spans(base).encode()).hexdigest() for base, _ in found]
            every = [joined_spans(s) for _, s in found]
            columns = [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digest, pa.string()), pa.array(every, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    schema = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in brackets, and ``n_chars``, if there, counted anew.

    Overlapping spans are replaced as one, under the kind of the first.
    """
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            new = [t if not t else _without(t, spans) for t, (_, spans) in zip(texts, all_spans(model.value, [t or "" for t in texts]), strict=True)]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)
    return out


def _without(text: str, spans: list[Span]) -> str:
    out, done = [], 0
    for a, kind, b in spans:
        if a >= done:
            out += [text[done:a], f"[{KINDS[kind].upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])
