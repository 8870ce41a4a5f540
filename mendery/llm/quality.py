"""Quality rules: a linear-chain conditional random field labels the lines of a document as content or
boilerplate; the share of words in content lines decides whether the document is kept.

The weights are trained here, on a bounded sample of labelled documents (``TRAIN_PER_CLASS`` of each class,
the first by a hash of their ids). Labels are per document, so the lines of a good document are content and
those of a bad one boilerplate at first; then lines of bad documents that the field reads as content are
relabelled and it is trained once more. Without labelled documents of both classes ``FIXED`` is used.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendery.llm.common import filter_rows, map_rows, table

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_CONTENT_SHARE = 0.5

# Bounds of the training sample: documents per class, and lines of one document (spread evenly over it).
TRAIN_PER_CLASS = 400
TRAIN_LINES = 60
_STEPS = 200
_RATE = 0.5
_PENALTY = 1e-3

SYMBOLS = b"#*$%&|<>"
FEATURES = (
    "bias",
    "symbols", "upper", "digits", "marks", "blanks",
    "short line", "repeated line", "closed sentence", "word length",
)


class Field(NamedTuple):
    """Score of label content (1) against boilerplate (0) per feature, and of each pair of labels."""

    line: np.ndarray
    pair: np.ndarray


FIXED = Field(
    np.array([2.0, -12.0, -6.0, -6.0, -6.0, 0.0, -0.5, -2.0, 0.5, 0.0]),
    np.array([[0.5, -0.5], [-0.5, 0.5]]),
)

_BITS = np.zeros(256, np.uint8)
for _c in range(256):
    _BITS[_c] = (
        (chr(_c).encode("latin-1") in [bytes([s]) for s in SYMBOLS]) * 1
        + (65 <= _c <= 90) * 2
        + (48 <= _c <= 57) * 4
        + (_c in b"!?@=_~^{}[]\\/+") * 8
        + (_c == 32 or 9 <= _c <= 13) * 16
        + ((_c & 0xC0) != 0x80) * 32
    )
_START = np.uint8(32)


class Lines(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    features: np.ndarray  # a row for each line with a word
    words: np.ndarray  # words of these lines


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[bytes, int] = {}
    codes = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    runs = codes[:-2] * len(known) + codes[1:-1]
    if len(known) > 1_000_000:
        runs = np.unique(runs, return_inverse=True)[1]
    runs = runs * len(known) + codes[2:]
    order = np.argsort(runs, kind="stable")
    sorted_runs = runs[order]
    same = sorted_runs[1:] == sorted_runs[:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def read_lines(text: bytes) -> Lines:
    words = text.split()
    lines = text.split(b"\n")
    seen: set[bytes] = set()
    repeated, counts, filled = [], [], []
    for i, line in enumerate(lines):
        n = len(line.split())
        if n:
            filled.append(i)
            counts.append(n)
            repeated.append(line in seen)
            seen.add(line)
    if not filled:
        return Lines(0, 0, _symbols(text), 0, 0, np.zeros((0, len(FEATURES))), np.zeros(0))
    bits = _BITS[np.frombuffer(text + b"\n", np.uint8)]
    lengths = np.fromiter(map(len, lines), np.int64, len(lines)) + 1
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    of_line = [np.add.reduceat((bits >> k) & 1, starts, dtype=np.int64)[filled] for k in range(6)]
    symbols, upper, digits, marks, blanks, chars = (x.astype(float) for x in of_line)
    n = np.array(counts, float)
    solid = np.maximum(chars - blanks, 1)
    closed = np.array([lines[i].rstrip()[-1:] in b".!?:;\"')" for i in filled], float)
    features = np.stack(
        [
            np.ones(len(filled)),
            symbols / solid, upper / solid, digits / solid, marks / solid, blanks / np.maximum(chars, 1),
            (n < 4).astype(float), np.array(repeated, float), closed, np.minimum(solid / n, 20) / 10,
        ],
        axis=1,
    )
    is_word = (bits & 48) == _START
    return Lines(
        len(words), int(is_word.sum()), _symbols(text), sum(repeated), repeat_words(words), features, n
    )


def _symbols(text: bytes) -> int:
    return sum(text.count(bytes([c])) for c in SYMBOLS)


def viterbi(field: Field, features: np.ndarray) -> np.ndarray:
    """Best labels of a line sequence; of equal paths, content."""
    scores = (features @ field.line).tolist()
    (bb, bc), (cb, cc) = field.pair.tolist()
    b, c = 0.0, scores[0]
    back = []
    for s in scores[1:]:
        to_b, to_c = (c + cb >= b + bb), (c + cc >= b + bc)
        back.append((to_b, to_c))
        b, c = max(c + cb, b + bb), max(c + cc, b + bc) + s
    labels = [c >= b]
    for to_b, to_c in reversed(back):
        labels.append(to_c if labels[-1] else to_b)
    return np.array(labels[::-1])


def content_share(field: Field, lines: Lines) -> float:
    return float(lines.words[viterbi(field, lines.features)].sum() / lines.words.sum()) if len(lines.words) else 0.0


def train(documents: list[tuple[np.ndarray, bool]]) -> Field:
    """Conditional likelihood of the labels by gradient ascent; all sequences advance together."""
    documents = [(x, y) for x, y in documents if len(x)]
    if len({y for _, y in documents}) < 2:
        return FIXED
    longest = max(len(x) for x, _ in documents)
    n, k = len(documents), len(FEATURES)
    x = np.zeros((n, longest, k))
    live = np.zeros((n, longest), bool)
    gold = np.zeros((n, longest), int)
    good = np.array([y for _, y in documents])
    for i, (f, y) in enumerate(documents):
        x[i, : len(f)], live[i, : len(f)], gold[i, : len(f)] = f, True, int(y)
    # both classes weigh the same, whatever their numbers
    weight = np.where(good, 0.5 / good.sum(), 0.5 / (~good).sum())[:, None] / live.sum(1)[:, None] * live
    field = FIXED
    for _ in range(2):
        field = _ascend(x, live, gold, weight)
        for i in np.flatnonzero(~good):
            m = live[i].sum()
            found = viterbi(field, x[i, :m]).astype(int)
            gold[i, :m] = found if not found.all() else 0
    return field


def _ascend(x: np.ndarray, live: np.ndarray, gold: np.ndarray, weight: np.ndarray) -> Field:
    line, pair = np.zeros(x.shape[2]), np.zeros((2, 2))
    steps_line, steps_pair = np.full_like(line, 1e-8), np.full_like(pair, 1e-8)
    both = live[:, 1:] & live[:, :-1]
    w_pair = weight[:, 1:] * both
    true_line = np.einsum("nt,ntk->k", weight * gold, x)
    true_pair = np.array([[(w_pair * (gold[:, :-1] == a) * (gold[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)])
    t_max = x.shape[1]
    for _ in range(_STEPS):
        s = np.stack([np.zeros(live.shape), x @ line], axis=2)
        alpha, beta = s.copy(), np.zeros_like(s)
        for t in range(1, t_max):
            step = np.logaddexp(alpha[:, t - 1, 0, None] + pair[0], alpha[:, t - 1, 1, None] + pair[1])
            alpha[:, t] = np.where(live[:, t, None], step + s[:, t], alpha[:, t])
        for t in range(t_max - 2, -1, -1):
            after = beta[:, t + 1] + s[:, t + 1]
            step = np.logaddexp(after[:, 0, None] + pair[:, 0], after[:, 1, None] + pair[:, 1])
            beta[:, t] = np.where(both[:, t, None], step, 0)
        total = np.logaddexp(alpha[:, 0, 0] + beta[:, 0, 0], alpha[:, 0, 1] + beta[:, 0, 1])[:, None]
        p = np.exp(np.minimum(alpha[:, :, 1] + beta[:, :, 1] - total, 0))
        grad_line = true_line - np.einsum("nt,ntk->k", weight * p, x) - _PENALTY * line
        grad_pair = np.empty((2, 2))
        for a in (0, 1):
            for b in (0, 1):
                q = np.exp(np.minimum(alpha[:, :-1, a] + pair[a, b] + s[:, 1:, b] + beta[:, 1:, b] - total, 0))
                grad_pair[a, b] = true_pair[a, b] - (w_pair * q).sum() - _PENALTY * pair[a, b]
        steps_line += grad_line**2
        steps_pair += grad_pair**2
        line = line + _RATE * grad_line / np.sqrt(steps_line)
        pair = pair + _RATE * grad_pair / np.sqrt(steps_pair)
    return Field(line, pair)


def fit(documents: DataFrame, labels: DataFrame) -> Field:
    """Train on the sample: at most 2 * TRAIN_PER_CLASS texts, one of each labelled id, read where they lie.

    Of several texts under one id the smallest counts, so neither a task nor the driver holds an id's repeats.
    """
    marked = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").alias("of"), (F.col("quality") == 1).alias("good")
    ).distinct()
    order = [F.xxhash64("of"), F.col("of")]
    chosen = marked.filter("good").orderBy(*order).limit(TRAIN_PER_CLASS).union(
        marked.filter("NOT good").orderBy(*order).limit(TRAIN_PER_CLASS)
    )
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("of"))
    texts = texts.groupBy("of", "good").agg(F.min("text").alias("text")).select("text", "good")

    def make():
        def rows(text, good):
            out = []
            for t, g in zip(text, good, strict=True):
                f = read_lines(t or b"").features
                if len(f) > TRAIN_LINES:
                    f = f[np.linspace(0, len(f) - 1, TRAIN_LINES).astype(int)]
                out.append((f.ravel().tolist(), g))
            return out

        return rows

    found = map_rows(texts, "features array<double>, good boolean", make).collect()
    width = len(FEATURES)
    sample = sorted((tuple(r.features), bool(r.good)) for r in found)
    return train([(np.array(f).reshape(-1, width), g) for f, g in sample])


SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, base_failed boolean, kept boolean, content_share double"
)


def judge(text: bytes | None, field: Field) -> tuple:
    x = read_lines(text or b"")
    failed = x.n_words < MIN_WORDS or 100 * x.n_repeat_words > MAX_REPEAT_PERCENT * x.n_words
    share = content_share(field, x)
    return (*x[:5], failed, not failed and share >= MIN_CONTENT_SHARE, share)


def quality_verdicts(documents: DataFrame, field: Field) -> DataFrame:
    """One row per document: counts, base rule, verdict and share of words in content lines.

    A null or empty text has no words and fails; equal texts get equal verdicts; a null id stays null; an
    empty table gives no rows; other columns are not looked at. Very long texts are read whole.
    """

    def make():
        return lambda ids, texts: [(i, *judge(t, field)) for i, t in zip(ids, texts, strict=True)]

    return map_rows(documents.select(F.col("doc_id").cast("bigint"), "text"), SCHEMA, make)


def op7_line_field(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return quality_verdicts(documents, fit(documents, table(spark, folder, "labels")))


def keep_good(documents: DataFrame, field: Field) -> DataFrame:
    """The documents whose verdict is to keep them, with all their columns."""
    return filter_rows(documents, ["text"], lambda: lambda text: judge(text, field)[6])
