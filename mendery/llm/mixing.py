"""Mixing sources to target weights: iterative proportional fitting of token weights to source, language
and topic marginals, then a sample of documents with the calibrated probabilities.

Tokens are words. A topic is one of ``TOPICS`` groups of the vocabulary (by a hash of the word without case):
the group whose share of the document's words exceeds its share of all documents' words by the largest
factor. The cell table (source, language, topic) has at most (named + 1) entries per axis, because values
that the targets do not name are counted as ``other``; it is aggregated by Spark and only its totals reach
the driver. The fit is the classical raking of that small table.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mendery.llm.common import Words, filter_rows, map_rows, table

TOPICS = 8
OTHER = "other"
SWEEPS = 500
TOLERANCE = 1e-9
_FRACTION_BITS = 53


class Targets(NamedTuple):
    """Shares per axis; what they leave of 1 belongs to ``other``. Topics are to be even by default.
    ``keep`` is the share of all tokens that the sample is to hold."""

    source: dict[str, float]
    lang: dict[str, float]
    keep: float = 0.5


PRODUCTION = Targets(
    source={"src0": 0.20, "src1": 0.06, "src2": 0.06, "src3": 0.04},
    lang={"en": 0.60, "de": 0.13, "fr": 0.13, "es": 0.13},
)


class Mix(NamedTuple):
    """What the sample needs: share of each topic group, names per axis, probability per cell."""

    shares: np.ndarray
    sources: tuple[str, ...]
    langs: tuple[str, ...]
    probability: np.ndarray  # source x lang x topic
    fitted: np.ndarray  # tokens per cell that the sample is to hold
    observed: np.ndarray

    def cell(self, source: str | None, lang: str | None, counts: np.ndarray) -> tuple[int, int, int]:
        return _place(self.sources, source), _place(self.langs, lang), topic_of(counts, self.shares)


def _place(names: tuple[str, ...], value: str | None) -> int:
    return names.index(value) if value in names else len(names) - 1


def group_counts(words: list[bytes], groups: dict[bytes, int]) -> np.ndarray:
    return np.bincount(np.fromiter(map(groups.__getitem__, words), np.int64, len(words)), minlength=TOPICS)


class Groups(Words):
    """Word to its topic group; remembered like hashes of words."""

    def __missing__(self, word: bytes) -> int:
        core = word.strip(b".,;:!?()[]\"'").decode("utf-8", "replace").lower()
        return self.remember(word, xxhash.xxh3_64_intdigest(core.encode()) % TOPICS)


def topic_of(counts: np.ndarray, shares: np.ndarray) -> int:
    """Group with the largest excess over its share; the first of equals; 0 without words."""
    return int(np.argmax(np.where(shares > 0, counts / np.where(shares > 0, shares, 1), 0)))


def rake(observed: np.ndarray, margins: list[np.ndarray], budget: float) -> np.ndarray:
    """Tokens per cell: the table nearest to ``observed`` with the given margins, scaled to ``budget`` and
    never above what is there.

    Target shares of values without tokens are spread over the others of their axis. Where the limits make
    the margins impossible, the last sweep's table stands: limits hold, margins as near as the sweeps came.
    """
    total = observed.sum()
    if total <= 0 or budget <= 0:
        return np.zeros_like(observed, float)
    budget = min(budget, float(total))
    wanted = []
    for axis, margin in enumerate(margins):
        there = observed.sum(axis=tuple(i for i in range(observed.ndim) if i != axis)) > 0
        share = np.where(there, margin, 0.0)
        share = share / share.sum() if share.sum() > 0 else there / there.sum()
        wanted.append(share * budget)
    x = observed * (budget / total)
    for _ in range(SWEEPS):
        before = x
        for axis, target in enumerate(wanted):
            rest = tuple(i for i in range(x.ndim) if i != axis)
            have = x.sum(axis=rest)
            factor = np.divide(target, have, out=np.ones_like(have), where=have > 0)
            x = np.minimum(x * factor.reshape([-1 if i == axis else 1 for i in range(x.ndim)]), observed)
        if np.abs(x - before).max() <= TOLERANCE * budget:
            break
    return x


def _margin(named: dict[str, float]) -> np.ndarray:
    return np.array([*named.values(), max(0.0, 1 - sum(named.values()))])


def measure(documents: DataFrame) -> DataFrame:
    """Per document: id, source, language, words per topic group."""
    def make():
        groups = Groups()

        def rows(ids, sources, langs, texts):
            return [
                (i, s, g, group_counts((t or b"").split(), groups).tolist())
                for i, s, g, t in zip(ids, sources, langs, texts, strict=True)
            ]

        return rows

    return map_rows(
        documents.select(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), F.col("lang").cast("string"), "text"),
        "doc_id bigint, source string, lang string, counts array<bigint>",
        make,
    )


def _named(column: str, named: dict[str, float]) -> Column:
    return F.when(F.col(column).isin(list(named)), F.col(column)).otherwise(F.lit(OTHER))


def calibrate(documents: DataFrame, targets: Targets) -> Mix:
    """Totals over all documents, then the fit. Two aggregations: topic shares, then cells."""
    measured = measure(documents)
    total = measured.agg(*[F.sum(F.col("counts")[k]).alias(f"t{k}") for k in range(TOPICS)]).first()
    totals = np.array([v or 0 for v in total], float)
    shares = totals / totals.sum() if totals.sum() else totals
    excess = [
        F.when(F.lit(bool(shares[k] > 0)), F.col("counts")[k] / F.lit(float(shares[k] or 1))).otherwise(F.lit(0.0))
        for k in range(TOPICS)
    ]
    best = F.array_max(F.array(*[F.struct(e.alias("e"), F.lit(-k).alias("k")) for k, e in enumerate(excess)]))
    tokens = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, b: a + b)
    cells = (
        measured.select(
            _named("source", targets.source).alias("source"),
            _named("lang", targets.lang).alias("lang"),
            (-best["k"]).alias("topic"),
            tokens.alias("tokens"),
        )
        .groupBy("source", "lang", "topic")
        .agg(F.sum("tokens").alias("tokens"))
        .collect()  # at most (named sources + 1) * (named languages + 1) * TOPICS rows
    )
    sources, langs = (*targets.source, OTHER), (*targets.lang, OTHER)
    observed = np.zeros((len(sources), len(langs), TOPICS))
    for r in cells:
        observed[sources.index(r.source), langs.index(r.lang), r.topic] += r.tokens
    even = np.full(TOPICS, 1 / TOPICS)
    fitted = rake(observed, [_margin(targets.source), _margin(targets.lang), even], targets.keep * observed.sum())
    probability = np.divide(fitted, observed, out=np.ones_like(fitted), where=observed > 0)
    return Mix(shares, sources, langs, probability, fitted, observed)


def draw(doc_id: int | None, text: bytes | None, seed: int = 0) -> float:
    """Uniform number of a document, from its id (from its text where it has none)."""
    key = str(doc_id).encode() if doc_id is not None else b"text:" + (text or b"")
    return (xxhash.xxh3_64_intdigest(key, seed=seed) >> (64 - _FRACTION_BITS)) / (1 << _FRACTION_BITS)


SCHEMA = (
    "doc_id bigint, source string, lang string, topic int, tokens bigint, weight double, probability double, "
    "draw double, selected boolean"
)


def mix_plan(documents: DataFrame, mix: Mix) -> DataFrame:
    """One row per document: its cell (as named by the targets), tokens, raking weight (relative to an even
    sample), inclusion probability, draw and whether it is selected.

    Null source or language counts as ``other``; a null or empty text has no tokens and topic 0. Repeated
    rows share a draw, so they are selected together. An empty table gives no rows; other columns are not
    looked at.
    """
    keep = mix.fitted.sum() / mix.observed.sum() if mix.observed.sum() else 1.0

    def make():
        groups = Groups()

        def rows(ids, sources, langs, texts):
            out = []
            for i, s, g, t in zip(ids, sources, langs, texts, strict=True):
                counts = group_counts((t or b"").split(), groups)
                cell = mix.cell(_text(s), _text(g), counts)
                p, u = float(mix.probability[cell]), draw(i, t)
                out.append((i, mix.sources[cell[0]], mix.langs[cell[1]], cell[2], int(counts.sum()), p / keep if keep else 0.0, p, u, u < p))
            return out

        return rows

    return map_rows(
        documents.select(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), F.col("lang").cast("string"), "text"), SCHEMA, make
    )


def _text(value: bytes | None) -> str | None:
    return None if value is None else value.decode("utf-8", "replace")


def sample(documents: DataFrame, mix: Mix) -> DataFrame:
    """The selected documents, with all their columns."""

    def make():
        groups = Groups()

        def passes(doc_id, source, lang, text):
            cell = mix.cell(_text(source), _text(lang), group_counts((text or b"").split(), groups))
            return draw(doc_id, text) < mix.probability[cell]

        return passes

    return filter_rows(documents, ["doc_id", "source", "lang", "text"], make)


def op1_raked_mixture(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return mix_plan(documents, calibrate(documents, PRODUCTION))
