"""Personal data: base patterns, then a skip-chain conditional random field that carries their labels to
repeated or similar tokens of the same document.

Nodes are the tokens of a document that look like identifiers, and all tokens that share a key with one of
those. Labels are other (0) and private (1). Potentials:

* a token inside a base span is observed as private; others score by shape (trained, see ``fit``);
* neighbouring nodes share a chain potential;
* nodes with a common key share a skip potential, however far apart they are. Keys are the token without
  case and outer punctuation, its digits (7 or more), and the name part of an address. The words of a base
  span also share the key of all its digits (of a phone number also without its country, the last
  ``NATIONAL``), as do words in a row that together write those digits elsewhere in whatever spacing. Each occurrence is
  linked to the next one with the key and to the first one inside a base span, so that many plain repeats do
  not outvote what is certain; a token that occurs n times costs at most 2 n links and not n * n.

Loopy message passing (sum-product over log-odds) gives each node a belief; nodes that no base span covers
and whose belief is above one half are reported as kind ``entity``.

The weights of shapes are fitted by logistic regression on a bounded sample of documents (``TRAIN_DOCS``, the first
by a hash of their ids), labelled by the base patterns. How often linked tokens agree there gives chain and skip,
but only within bounds that decide in practice: a chain of at most 1, as neighbours of a private token are mostly
plain, and a skip from 8 to 12, as the base patterns never label the plain repeats that the links are for.

Messages are passed until none changes by more than ``SETTLED`` (they are damped, and no potential pushes tokens
apart), at most ``ROUNDS`` times.
"""

from __future__ import annotations

import math
import re
from itertools import pairwise
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendery.llm.common import map_rows, sha256, spans_text, table

KINDS = ("email", "ip", "card", "phone", "entity")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NAME_BEFORE = re.compile(r"[A-Za-z0-9._%+-]+")
# A run of digits is entered at its first digit only: a match from inside it could not be leftmost.
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = "\"'`.,;:!?()[]{}<>#*$%&|~^=/\\-_+"
_NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Bounds of the training sample.
TRAIN_DOCS = 600
TRAIN_TOKENS = 400
ROUNDS = 200
SETTLED = 0.001
NATIONAL = 10  # digits of a phone number without its country
RUN_WORDS = 6  # words in a row that may write one number
_OBSERVED = 30.0

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """Around each ``@``: the run of name characters before it and the domain after it."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _NAME_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            out.append((start, done, "email"))
        else:
            done = max(done, at + 1)
        at = text.find("@", done if domain else at + 1)
    return out


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches per kind, failing ones dropped, by start and kind."""
    if not _HINT.search(text):
        return []
    out = _emails(text)
    out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.groups())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=_order)


def _order(span: Span) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


class Token(NamedTuple):
    start: int
    end: int
    place: int  # number of the word in the text
    keys: tuple[str, ...]
    shape: tuple[float, ...]
    observed: bool


SHAPE = ("bias", "digits", "many digits", "at sign", "inner marks", "letters", "length", "fails its check")


class Weights(NamedTuple):
    shape: tuple[float, ...]
    chain: float
    skip: float


FIXED = Weights((-4.0, 0.1, 1.0, 2.0, 0.3, -0.3, 0.0, -6.0), 0.1, 8.0)


def _keys(core: str) -> tuple[str, ...]:
    low = core.lower()
    keys = [low] if len(low) >= 5 else []
    digits = "".join(c for c in core if c in "0123456789")
    if len(digits) >= 7:
        keys.append("#" + digits)
    name, at, _ = low.partition("@")
    if at and len(name) >= 5 and not name.isalpha():
        keys.append(name)
    return tuple(dict.fromkeys(keys))


def _number_keys(text: str, span: Span) -> tuple[str, ...]:
    """Keys of all digits of a base span that is a card or phone number."""
    start, end, kind = span
    if kind not in ("card", "phone"):
        return ()
    digits = "".join(c for c in text[start:end] if c in "0123456789")
    if kind == "phone" and len(digits) > NATIONAL:
        return "#" + digits, "#" + digits[-NATIONAL:]
    return ("#" + digits,)


def _written_numbers(words: list[tuple], wanted: set[str]) -> dict[int, tuple[str, ...]]:
    """Keys among ``wanted`` that words in a row write together, by the number of the word."""
    found: dict[int, tuple[str, ...]] = {}
    if not wanted:
        return found
    longest = max(map(len, wanted))
    digits = ["".join(c for c in w[3] if c in "0123456789") if not any(c.isalpha() for c in w[3]) else "" for w in words]
    for i, first in enumerate(digits):
        whole = "#"
        for j in range(i, min(i + RUN_WORDS, len(words))) if first else ():
            if not digits[j] or words[j][2] - words[i][2] != j - i:
                break
            whole += digits[j]
            if len(whole) > longest:
                break
            if whole in wanted:
                for k in range(i, j + 1):
                    found[k] = (*found.get(k, ()), whole)
    return found


def _fails(core: str, digits: int) -> bool:
    """A number as long as a card's without its check digit, or an address with a part over 255."""
    parts = core.split(".")
    if len(parts) == 4 and all(p.isdecimal() for p in parts):
        return any(len(p) > 3 or int(p) > 255 for p in parts)
    return digits >= 12 and not luhn("".join(c for c in core if c in "0123456789"))


def _shape(core: str) -> tuple[float, ...]:
    digits = sum(c in "0123456789" for c in core)
    letters = sum(c.isalpha() for c in core)
    marks = len(core) - digits - letters
    return (
        1.0, min(digits, 20) / 5, float(digits >= 7), float("@" in core), min(marks, 5) / 2,
        letters / max(len(core), 1), min(len(core), 40) / 10, float(_fails(core, digits)),
    )


def tokens(text: str, base: list[Span]) -> list[Token]:
    """Identifier-like tokens, and the tokens that share a key with one."""
    spans = sorted((s, e, kind) for s, e, kind in base)
    numbers = {span: _number_keys(text, span) for span in spans}
    words, at = [], 0
    looks: set[str] = set()
    for place, m in enumerate(_TOKEN.finditer(text)):
        while at < len(spans) and spans[at][1] <= m.start():
            at += 1
        over = [x for x in spans[at : at + 8] if x[0] < m.end() and x[1] > m.start()]
        word = m[0]
        like = bool(over) or ("@" in word) or sum(c in "0123456789" for c in word) >= 5
        core = word.strip(_EDGE)
        if not core:
            continue
        start = m.start() + word.index(core)
        if like:
            looks.update(_keys(core))
        extra = tuple(k for x in over for k in numbers[x])
        words.append((start, start + len(core), place, core, bool(over), like, extra))
    written = _written_numbers(words, {k for keys in numbers.values() for k in keys})
    out = []
    for i, (start, end, place, core, observed, like, extra) in enumerate(words):
        extra += written.get(i, ())
        if like or extra or core.lower() in looks:
            keys = tuple(dict.fromkeys((*_keys(core), *extra)))
            out.append(Token(start, end, place, keys, _shape(core), observed))
    return out


def links(nodes: list[Token]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain links between neighbours; skip links between successive tokens with a common key, and from each
    of them to the first observed one."""
    chain = [(i, i + 1) for i, (a, b) in enumerate(pairwise(nodes)) if b.place == a.place + 1]
    last: dict[str, int] = {}
    sure: dict[str, int] = {}
    for i, node in enumerate(nodes):
        for key in node.keys if node.observed else ():
            sure.setdefault(key, i)
    skip = set()
    for i, node in enumerate(nodes):
        for key in node.keys:
            if key in last:
                skip.add((last[key], i))
            if not node.observed and key in sure:
                skip.add((min(sure[key], i), max(sure[key], i)))
            last[key] = i
    return chain, sorted(skip)


def beliefs(nodes: list[Token], weights: Weights) -> np.ndarray:
    """Log-odds of private per node after loopy message passing."""
    own = np.array([_OBSERVED if n.observed else math.fsum(a * b for a, b in zip(weights.shape, n.shape, strict=True)) for n in nodes])
    chain, skip = links(nodes)
    edges = [(i, j, weights.chain) for i, j in chain] + [(i, j, weights.skip) for i, j in skip]
    if not edges:
        return own
    a = np.array([e[0] for e in edges] + [e[1] for e in edges])
    b = np.array([e[1] for e in edges] + [e[0] for e in edges])
    pull = np.tanh(np.array([e[2] for e in edges] * 2) / 2)
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    message = np.zeros(len(a))
    for _ in range(ROUNDS):
        total = own + np.bincount(b, message, len(nodes))
        rest = np.clip(total[a] - message[back], -30, 30)
        sent = 0.5 * message + 0.5 * 2 * np.arctanh(np.clip(pull * np.tanh(rest / 2), -0.999999, 0.999999))
        change = np.abs(sent - message).max()
        message = sent
        if change <= SETTLED:
            break
    return own + np.bincount(b, message, len(nodes))


def find_private(text: str, weights: Weights) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans."""
    base = base_spans(text)
    if not base and not _HINT.search(text):
        return base, base
    nodes = tokens(text, base)
    if not nodes:
        return base, base
    found = [
        (n.start, n.end, "entity")
        for n, odds in zip(nodes, beliefs(nodes, weights), strict=True)
        if not n.observed and odds > 0
    ]
    return base, sorted(base + found, key=_order)


def train(samples: list[tuple[np.ndarray, np.ndarray, int, int, int, int]]) -> Weights:
    """Weights from (shapes, labels, agreeing and all chain links, agreeing and all skip links) per document."""
    samples = [s for s in samples if len(s[1])]
    if not samples:
        return FIXED
    x = np.concatenate([s[0] for s in samples])
    y = np.concatenate([s[1] for s in samples]).astype(float)
    if not 0 < y.sum() < len(y):
        return FIXED
    w = np.zeros(x.shape[1])
    for _ in range(50):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w = w + np.clip(np.linalg.solve(h, x.T @ (y - p) - 0.1 * w), -2, 2)
    chain_agree, chain_all, skip_agree, skip_all = (sum(s[k] for s in samples) for k in (2, 3, 4, 5))
    # half a count on either side keeps the odds finite; a potential never pushes linked tokens apart
    odds = lambda agree, total: max(0.0, math.log((agree + 0.5) / (total - agree + 0.5)))
    return Weights(
        tuple(w.tolist()),
        min(odds(chain_agree, chain_all), 1.0),
        min(max(odds(skip_agree, skip_all), FIXED.skip), 12.0),
    )


def fit(documents: DataFrame) -> Weights:
    """Weights from the sample; at most TRAIN_DOCS documents and TRAIN_TOKENS tokens of each."""
    ids = documents.filter("doc_id IS NOT NULL").select("doc_id").distinct()
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS).withColumnRenamed("doc_id", "of")
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("of"))
    # one text of an id, the smallest: neither a task nor the driver holds an id's repeats
    texts = texts.groupBy("of").agg(F.min("text").alias("text")).select("text")

    def make():
        def rows(texts):
            out = []
            for raw in texts:
                text = (raw or b"").decode("utf-8", "replace")
                nodes = tokens(text, base_spans(text))[:TRAIN_TOKENS]
                chain, skip = links(nodes)
                same = lambda pairs: sum(nodes[i].observed == nodes[j].observed for i, j in pairs)  # noqa: E731,B023
                out.append(([v for n in nodes for v in n.shape], [n.observed for n in nodes], same(chain), len(chain), same(skip), len(skip)))
            return out

        return rows

    schema = "shape array<double>, label array<boolean>, chain_agree bigint, chain_all bigint, skip_agree bigint, skip_all bigint"
    found = sorted(map_rows(texts, schema, make).collect())
    return train([(np.array(r[0]).reshape(-1, len(SHAPE)), np.array(r[1]), *r[2:]) for r in found])


SCHEMA = (
    "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, "
    "spans string, n_entity bigint"
)


def digest(text: bytes | None, weights: Weights) -> tuple:
    base, spans = find_private((text or b"").decode("utf-8", "replace"), weights)
    counts = [sum(k == kind for *_, k in base) for kind in KINDS[:4]]
    return (*counts, sha256(spans_text(base)), spans_text(spans), len(spans) - len(base))


def private_spans(documents: DataFrame, weights: Weights) -> DataFrame:
    """One row per document with the digest columns of its personal data.

    A null text counts as empty (no spans, checksum of the empty text). Rows are judged by themselves, so
    repeated rows give repeated results; an empty table gives none; other columns are not looked at. Texts
    are read whole whatever their length.
    """

    def make():
        return lambda ids, texts: [(i, *digest(t, weights)) for i, t in zip(ids, texts, strict=True)]

    return map_rows(documents.select(F.col("doc_id").cast("bigint"), "text"), SCHEMA, make)


def op8_skip_chain_private(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return private_spans(documents, fit(documents))
