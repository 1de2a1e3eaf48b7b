"""Personal data: exact base patterns, and a semi-Markov conditional random field for what they miss.

The field scores whole spans of tokens: a span's digits, separators, shape, neighbours and length are
seen at once. A dynamic programme over (token, kind of the last span) chooses boundaries and kinds
together, with spans of at most LONGEST tokens. It is trained here, on generated lines.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import text_chunks

KINDS = ("email", "ip", "card", "phone")
LONGEST = 6
#: Tokens around a trigger that the field reads, and tokens of one lattice.
AROUND, LATTICE = 3, 48
LABELS = ("", *KINDS)
# The base patterns.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is entered at its beginning only: from its middle a match could only be a part of one that failed.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TRIGGER = re.compile(r"[0-9]{2}|@|[\[({]at[\])}]|[\x20\[({]dot[\x20\])}]", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the email pattern: each @ is tried once, with all that may stand before it."""
    free, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > free and text[a - 1] in LOCAL:
            a -= 1
        m = DOMAIN.match(text, at + 1) if a < at else None
        if m:
            yield a, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all base matches, by kind."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        if "." in text:
            out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


TOKEN = re.compile(r"[^\s,;]+")
CUES = {"email": ("mail", "e-mail", "email", "contact", "write", "reach"), "phone": ("tel", "tel.", "phone", "call", "mobile", "fax"), "card": ("card", "visa", "cc", "credit"), "ip": ("ip", "host", "server", "address")}
#: Words before numbers that are no one's.
OTHERS = ("order", "number", "no", "id", "invoice", "ref", "case", "version", "part", "model", "ticket", "item", "page", "isbn", "serial")
CUE_OF = {w: k for k, ws in CUES.items() for w in ws} | dict.fromkeys(OTHERS, "other")
#: Last labels of addresses that are spelled out.
ENDINGS = frozenset("com org net edu gov info biz io co de fr es it uk eu us ch at nl pl ru jp cn br ca au".split())


def span_features(tokens: list[str], a: int, b: int) -> list[str]:
    """Whole-span features of tokens[a:b] as one entity."""
    inner = " ".join(tokens[a:b])
    text = inner.strip(".,:!?\"'")
    digits = re.sub(r"\D", "", text)
    shape = re.sub(r"[A-Za-zÀ-ÿ]+", "a", re.sub(r"[0-9]+", lambda m: "9" * min(5, len(m[0])), text))
    signs = "".join(sorted(set(re.sub(r"[A-Za-zÀ-ÿ0-9]", "", text))))
    at = len(re.findall(r"@|[\[({]at[\])}]|\bat\b", text, re.I))
    dot = len(re.findall(r"\.[A-Za-z]|[\[({]dot[\])}]|\bdot\b", text, re.I))
    letters = bool(re.search(r"[A-Za-zÀ-ÿ]", text))
    before = tokens[a - 1].lower().strip(":().#") if a else ""
    out = [
        "bias",
        f"tokens={b - a}",
        f"digits={min(20, len(digits))},letters={letters}",
        f"shape={shape[:24]}" if len(shape) <= 24 else "shape=long",
        f"signs={signs[:6]}",
        f"address={at == 1 and dot >= 1},{bool(re.fullmatch(r'[^ ]+ *(?:@|[^A-Za-z0-9]?at[^A-Za-z0-9]?) *[^ ]+(?: *(?:[.]|[^A-Za-z0-9]?dot[^A-Za-z0-9]?) *[A-Za-z]+)+', text, re.I))}",
        f"luhn={12 <= len(digits) <= 19 and luhn(digits)},letters={letters}",
        f"cue={CUE_OF.get(before, '')},letters={letters}",
        f"spelled={at == 1 and dot >= 1},{(m[0].lower() in ENDINGS) if (m := re.search(r'[A-Za-z]+$', text)) else None}",
        f"grouped={bool(re.fullmatch(r'[(]?[0-9]{2,4}[)]?[ .-]+[0-9]{2,4}(?:[ .-]+[0-9]{2,4}){1,3}', text))}",
        f"quad={bool(re.fullmatch(r'[0-9]{1,3}(?:[.][0-9]{1,3}){3}', text))}",
    ]
    return out


def _example(r: random.Random) -> list[tuple[list[str], str]]:
    """A generated line as (tokens, kind) segments; plain words are single tokens."""
    word = lambda: "".join(r.choice("abcdefghilmnoprstuvz") for _ in range(r.randint(2, 9)))
    number = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    plain = lambda: next(w for w in iter(word, None) if w not in ENDINGS)
    other = lambda: r.choice(OTHERS) + r.choice(["", "", ":", "."])

    def card() -> str:
        body = "4" + number(14)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def entity(kind: str) -> list[str]:
        if kind == "email":
            at, dot = r.choice([(" at ", " dot "), ("[at]", "."), (" (at) ", " (dot) "), ("@", "."), (" [at] ", " [dot] ")])
            return f"{word()}{at}{word()}{dot}{r.choice(['com', 'org', 'net', 'de'])}".split()
        if kind == "ip":
            return [".".join(str(r.randint(0, 255)) for _ in range(4))]
        if kind == "card":
            c = card()
            s = r.choice(["", " ", "-", "."])
            return s.join(c[i : i + 4] for i in range(0, 16, 4)).split()
        a, b, c, s = number(3), number(3), number(4), r.choice(["-", " ", "."])
        return r.choice([f"({a}) {b}-{c}", f"{a}{s}{b}{s}{c}", f"+1 {a} {b} {c}", f"00{number(2)} {number(3)} {number(3)} {number(3)}"]).split()

    def noise() -> str:
        return r.choice([number(r.randint(1, 8)), number(4) + "-" + number(2) + "-" + number(2), "".join(r.choice("0123456789abcdef") for _ in range(r.randint(8, 40))), f"{number(1)}.{number(2)}", f"password={number(3)}{word()}{number(9)}", f"{number(2)}%", f"v{number(1)}.{number(1)}", number(16), "AKIA" + number(8), f"{word()}@", "at", "dot", f"{number(2)}:{number(2)}", f"{other()} {number(3)}-{number(3)}-{number(4)}", f"{other()} {number(3)} {number(3)} {number(4)}", f"{other()} {card()}", f"{word()} at {plain()} dot {plain()}", f"{plain()} at {plain()} dot {plain()} {plain()}", f"{number(4)} - {number(4)}", f"{number(1)} {number(3)} {number(3)}"])

    out: list[tuple[list[str], str]] = []
    for _ in range(r.randint(3, 7)):
        x = r.random()
        if x < 0.3:
            kind = r.choice(KINDS)
            if r.random() < 0.4:
                out.append(([r.choice(CUES[kind])], ""))
            out.append((entity(kind), kind))
        elif x < 0.55:
            out += [([w], "") for w in noise().split()]
        else:
            out.append(([word() + r.choice(["", "", ".", ","])], ""))
    return out


class Field:
    """Semi-Markov CRF with one weight for each feature and kind, and one for each pair of kinds."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, step: np.ndarray):
        self.names, self.weights, self.step = names, weights, step

    def codes(self, tokens: list[str]) -> dict[tuple[int, int], list[int]]:
        get = self.names.get
        return {(a, b): [i for f in span_features(tokens, a, b) if (i := get(f)) is not None] for a in range(len(tokens)) for b in range(a + 1, min(len(tokens), a + LONGEST) + 1)}

    def scores(self, codes: dict[tuple[int, int], list[int]]) -> dict[tuple[int, int], np.ndarray]:
        """The score of every span as each kind; only single tokens may be of no kind."""
        out = {}
        for (a, b), c in codes.items():
            s = self.weights[c].sum(axis=0) if c else np.zeros(len(LABELS))
            if b - a > 1:
                s = s.copy()
                s[0] = -1e9
            out[a, b] = s
        return out

    def best(self, tokens: list[str]) -> list[tuple[int, int, str]]:
        """The entities of the best segmentation."""
        n, scores = len(tokens), self.scores(self.codes(tokens))
        top = np.full((n + 1, len(LABELS)), -1e18)
        top[0, 0] = 0
        back: dict[tuple[int, int], tuple[int, int]] = {}
        for b in range(1, n + 1):
            for a in range(max(0, b - LONGEST), b):
                through = top[a][:, None] + self.step
                who = through.argmax(axis=0)
                value = through.max(axis=0) + scores[a, b]
                for y in np.flatnonzero(value > top[b]):
                    top[b, y] = value[y]
                    back[b, int(y)] = (a, int(who[y]))
        out, at, y = [], n, int(top[n].argmax())
        while at:
            a, before = back[at, y]
            if y:
                out.append((a, at, LABELS[y]))
            at, y = a, before
        return out[::-1]

    def gradient(self, codes: dict, gold: list[tuple[int, int, int]], n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the log-likelihood: what is observed less what is expected, by forward and backward sums."""
        scores, k = self.scores(codes), len(LABELS)
        f, b = np.full((n + 1, k), -1e18), np.full((n + 1, k), -1e18)
        f[0, 0], b[n] = 0, 0
        for e in range(1, n + 1):
            rows = [np.logaddexp.reduce(f[a][:, None] + self.step, axis=0) + scores[a, e] for a in range(max(0, e - LONGEST), e)]
            f[e] = np.logaddexp.reduce(rows, axis=0)
        for a in range(n - 1, -1, -1):
            rows = [np.logaddexp.reduce(self.step + (scores[a, e] + b[e])[None, :], axis=1) for e in range(a + 1, min(n, a + LONGEST) + 1)]
            b[a] = np.logaddexp.reduce(rows, axis=0)
        total = np.logaddexp.reduce(f[n])
        gw, gs = np.zeros_like(self.weights), np.zeros_like(self.step)
        for (a, e), c in codes.items():
            joint = np.exp(np.minimum(0, f[a][:, None] + self.step + (scores[a, e] + b[e])[None, :] - total))
            gs -= joint
            gw[c] -= joint.sum(axis=0)
        last = 0
        for a, e, y in gold:
            gw[codes[a, e], y] += 1
            gs[last, y] += 1
            last = y
        return gw, gs


def train(lines: int = 250, rounds: int = 6, seed: int = 11) -> Field:
    """A field fitted by AdaGrad on generated lines; deterministic."""
    r = random.Random(seed)
    data = []
    names: dict[str, int] = {}
    for _ in range(lines):
        parts = _example(r)
        tokens, gold = [], []
        for words, kind in parts:
            gold.append((len(tokens), len(tokens) + len(words), LABELS.index(kind)))
            tokens += words
        spans = {(a, b): span_features(tokens, a, b) for a in range(len(tokens)) for b in range(a + 1, min(len(tokens), a + LONGEST) + 1)}
        for fs in spans.values():
            for f in fs:
                names.setdefault(f, len(names))
        data.append((tokens, gold, {ab: [names[f] for f in fs] for ab, fs in spans.items()}))
    field = Field(names, np.zeros((len(names), len(LABELS))), np.zeros((len(LABELS), len(LABELS))))
    qw, qs = np.full_like(field.weights, 1e-6), np.full_like(field.step, 1e-6)
    for _ in range(rounds):
        r.shuffle(data)
        for tokens, gold, codes in data:
            gw, gs = field.gradient(codes, gold, len(tokens))
            gw -= 1e-3 * field.weights
            qw += gw * gw
            qs += gs * gs
            field.weights += 0.25 * gw / np.sqrt(qw)
            field.step += 0.25 * gs / np.sqrt(qs)
    return field


@cache
def trained() -> Field:
    return train()


def added_spans(text: str, base: list[tuple[str, int, int]], field: Field) -> list[tuple[str, int, int]]:
    """Entities that the field finds around triggers outside of base spans."""
    taken = sorted((a, b) for _, a, b in base)
    hits = []
    k = 0
    for m in TRIGGER.finditer(text):
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if k == len(taken) or m.end() <= taken[k][0]:
            hits.append(m.start())
    if not hits:
        return []
    out = []
    done = covered = 0  # the end of the last entity, and of the last trigger that was read with what follows it
    for n, h in enumerate(hits):
        if h < covered:
            continue
        low = max(done, h)
        for _ in range(AROUND):  # the token of the trigger and some before it
            p = max(text.rfind(" ", done, max(done, low - 1)), text.rfind("\n", done, max(done, low - 1)))
            low = p + 1 if p >= done else done
            if low == done:
                break
        spots, after, due = [], 0, n
        for m in TOKEN.finditer(text, low):
            if len(spots) == LATTICE or after > AROUND or (spots and "\n" in text[spots[-1][1] : m.start()]):
                break
            if m.end() - m.start() > 80:
                if m.start() > h:
                    break
                spots, after = [], 0
                if h < m.end():  # the other triggers in it would find the same
                    covered = m.end()
                continue
            spots.append((m.start(), m.end()))
            triggers = False
            while due < len(hits) and hits[due] < m.end():
                triggers, due = True, due + 1
            after = 0 if triggers or m.start() <= h else after + 1
            if triggers:
                covered = m.end()
        covered = max(covered, h + 1)
        tokens = [text[a:b] for a, b in spots]
        for a, b, kind in field.best(tokens) if tokens else []:
            start, end = spots[a][0], spots[b - 1][1]
            while end > start and text[end - 1] in ".,:!?\"'":
                end -= 1
            while start < end and text[start] in "\"'":
                start += 1
            if start < end and all(end <= x or start >= y for x, y in taken):
                out.append((kind, start, end))
                done = max(done, end)
    return out


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))))


def personal_data(documents: DataFrame, field: Field | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), a row for each row of documents(doc_id, text).

    Counts and base_sha256 are of the base patterns; spans holds those and the field's, as
    kind:start:end in code points, by start and then kind. Added spans never overlap base ones. Null is
    the empty text, without spans. Repeated rows and rows without doc_id are read like any other, and
    texts are read whole. The field looks where two digits, an @ or a spelled-out at or dot stand outside of
    base spans; a span it adds has at most LONGEST tokens, lies within AROUND tokens of such a place (in
    LATTICE tokens at once, which follow one another) and holds no token of over 80 characters and no newline.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(field or trained())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in text_chunks(batches):
            counts: list[list[int]] = [[] for _ in KINDS]
            digest, spans = [], []
            for text in batch.column("text").to_pylist():
                base = base_spans(text) if text else []
                for column, kind in zip(counts, KINDS, strict=True):
                    column.append(sum(k == kind for k, _, _ in base))
                digest.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(base + added_spans(text, base, model)) if text else "")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()), pa.array(spans, pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    source = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    return source.mapInArrow(read, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")
