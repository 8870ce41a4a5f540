"""Substring dedup with prefix-partitioned suffix trees.

A suffix is the text from a word on; only its first ``WINDOW`` words matter here. All suffixes of a corpus
are many times its size, so they travel only where a repeat is possible, and neighbours travel together:

1. Every window of 50 words has an anchor: the smallest hash among its runs of ``PREFIX`` words. Equal
   windows have equal anchors. Each document's anchors are counted over the corpus; an anchor that stands in
   one text only can be dropped, with all windows that have it.
2. Windows in a row with the same anchor are cut out as one stretch of words, and the stretches are dealt out
   by their anchor: the words all of its suffixes have in common, a prefix of bounded length. A prefix that
   more than ``GROUP`` stretches share is lengthened to the whole window, where a group is a single node of
   the tree and needs no more than the smallest document in it.
3. The other groups are filled up to the size of a worker's memory. Suffixes are sorted by their words; the
   common prefixes of neighbours give the tree, and its internal nodes as deep as the window are the repeats.

Documents with equal word sequences are one text, whose number is the smallest id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendery.llm.common import Words, map_rows, mix, signed, table
from mendery.session import settle_table

WINDOW = 50
PREFIX = 12
# Stretches of one prefix that are sorted together; above it the prefix is lengthened to whole windows.
GROUP = 4096
# Windows that one stretch carries at most, so that a row stays small in periodic texts.
STRETCH = 64
# Suffixes after which a task sorts what it has gathered. A group of 4,096 stretches has some 80,000 suffixes
# of 50 words and 4 bytes: 16 MB, a few times that while sorting.
SORTED_AT_ONCE = 40_000

_STEP = np.uint64(0x9E3779B97F4A7C15)


def anchors(hashes: np.ndarray) -> np.ndarray:
    """Anchor of every window, by its start."""
    n = len(hashes) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    runs = np.zeros(len(hashes) - PREFIX + 1, np.uint64)
    for k in range(PREFIX):
        runs = runs * _STEP + hashes[k : k + len(runs)]
    least = mix(runs)
    # smallest of WINDOW - PREFIX + 1 successive values, by doubling
    width, want = 1, WINDOW - PREFIX + 1
    while width < want:
        step = min(width, want - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    return least


def stretches(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (first and one past the last window) of windows in a row with one anchor."""
    n = len(least)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    ends = np.concatenate([starts[1:], [n]])
    if (ends - starts).max() > STRETCH:
        cut = [np.arange(s, e, STRETCH) for s, e in zip(starts, ends, strict=True)]
        starts = np.concatenate(cut)
        ends = np.concatenate([starts[1:], [n]])
    return starts, ends


def text_key(words: list[bytes]) -> tuple[str, int]:
    joined = hashlib.sha256(b" ".join(words))
    return joined.hexdigest(), int.from_bytes(joined.digest()[:8], "big", signed=True)


def read_texts(documents: DataFrame) -> DataFrame:
    """Per document: id, number of words, checksum of the words, text number and the anchors of its stretches."""

    def make():
        known = Words()

        def rows(ids, texts):
            out = []
            for i, t in zip(ids, texts, strict=True):
                words = (t or b"").split()
                checksum, key = text_key(words)
                found: list[int] = []
                if i is not None and len(words) >= WINDOW:
                    least = anchors(known.hashes(words))
                    found = signed(least[stretches(least)[0]])
                out.append((i, len(words), checksum, key, found))
            return out

        return rows

    return map_rows(
        documents.select(F.col("doc_id").cast("bigint"), "text"),
        "doc_id bigint, n_words bigint, checksum string, text_key bigint, anchors array<bigint>",
        make,
    )


def _shared_stretches(known: Words, key: int, text: bytes, prefixes: list[int]):
    """Words of a text, and its stretches (anchor, start, end) whose anchor is among ``prefixes``."""
    words = text.split()
    if len(words) < WINDOW or text_key(words)[1] != key:
        return words, []  # another document with the same id
    least = anchors(known.hashes(words))
    starts, ends = stretches(least)
    values = least[starts].view(np.int64)
    keep = np.isin(values, np.array(prefixes, np.int64))
    return words, zip(values[keep].tolist(), starts[keep].tolist(), ends[keep].tolist(), strict=True)


def cut_stretches(candidates: DataFrame) -> DataFrame:
    """Stretches under the prefixes in column ``shared``."""

    def make():
        known = Words()

        def rows(ids, keys, texts, prefixes):
            out = []
            for i, key, text, some in zip(ids, keys, texts, prefixes, strict=True):
                words, found = _shared_stretches(known, key, text, some)
                out += [(v, i, s, b" ".join(words[s : e - 1 + WINDOW])) for v, s, e in found]
            return out

        return rows

    return map_rows(
        candidates.filter(F.size("shared") > 0).select("doc_id", "text_key", "text", "shared"),
        "prefix bigint, doc_id bigint, start bigint, words binary",
        make,
    )


def cut_windows(candidates: DataFrame) -> DataFrame:
    """Distinct whole windows of each text under the prefixes in column ``crowded``, as nodes of the tree,
    with the places where they start."""

    def make():
        known = Words()

        def rows(ids, keys, texts, prefixes):
            out = []
            for i, key, text, some in zip(ids, keys, texts, prefixes, strict=True):
                words, found = _shared_stretches(known, key, text, some)
                places: dict[bytes, list[int]] = {}
                for _, s, e in found:
                    for p in range(s, e):
                        places.setdefault(xxhash.xxh3_128_digest(b" ".join(words[p : p + WINDOW])), []).append(p)
                out += [(node, i, at) for node, at in places.items()]
            return out

        return rows

    return map_rows(
        candidates.filter(F.size("crowded") > 0).select("doc_id", "text_key", "text", "crowded"),
        "node binary, doc_id bigint, places array<bigint>",
        make,
    )


def deep_nodes(parts: list[tuple[int, int, list[bytes]]]) -> list[tuple[int, int, int]]:
    """Suffix trees of some stretches (document, start, words), cut at the window's depth.

    Returns (document, first window, one past the last) for windows whose node also holds a smaller document.
    """
    known: dict[bytes, int] = {}
    codes = np.fromiter(
        (known.setdefault(w, len(known)) for _, _, words in parts for w in words), ">i4", sum(len(w) for *_, w in parts)
    )
    docs, places, at, offset = [], [], [], 0
    for doc, start, words in parts:
        n = len(words) - WINDOW + 1
        docs.append(np.full(n, doc, np.int64))
        places.append(np.arange(start, start + n))
        at.append(np.arange(offset, offset + n))
        offset += len(words)
    doc, place = np.concatenate(docs), np.concatenate(places)
    suffixes = np.lib.stride_tricks.sliding_window_view(codes, WINDOW)[np.concatenate(at)]
    order = np.argsort(np.ascontiguousarray(suffixes).view(f"V{4 * WINDOW}").ravel(), kind="stable")
    ordered = suffixes[order]
    # neighbours that agree in all WINDOW words hang below the same node of that depth
    node_starts = np.concatenate([[0], np.flatnonzero((ordered[1:] != ordered[:-1]).any(axis=1)) + 1])
    smallest = np.minimum.reduceat(doc[order], node_starts)
    of_node = np.repeat(smallest, np.diff(np.concatenate([node_starts, [len(order)]])))
    repeated = np.zeros(len(doc), bool)
    repeated[order] = of_node < doc[order]
    hit = np.flatnonzero(repeated)
    if not len(hit):
        return []
    cuts = np.flatnonzero((np.diff(hit) != 1) | (np.diff(place[hit]) != 1) | (np.diff(doc[hit]) != 0)) + 1
    return [
        (int(doc[r[0]]), int(place[r[0]]), int(place[r[-1]]) + 1) for r in np.split(hit, cuts)
    ]


class TreeBuilder:
    """Gathers the groups of sorted rows, up to a worker's share, and builds their trees.

    The rows of one prefix may go on in the next batch, so a group is closed by the next prefix."""

    def __init__(self):
        self.prefix: int | None = None
        self.group: list[tuple[int, int, list[bytes]]] = []
        self.ready: list[tuple[int, int, list[bytes]]] = []
        self.size = 0

    def __call__(self, prefixes, docs, starts, texts) -> list[tuple]:
        out: list[tuple] = []
        for prefix, doc, start, text in zip(prefixes, docs, starts, texts, strict=True):
            if prefix != self.prefix:
                out += self._close()
                self.prefix = prefix
            self.group.append((doc, start, text.split()))
        return out

    def finish(self) -> list[tuple]:
        return self._close(last=True)

    def _close(self, last: bool = False) -> list[tuple]:
        if len({doc for doc, *_ in self.group}) > 1:
            self.ready += self.group
            self.size += sum(len(words) - WINDOW + 1 for *_, words in self.group)
        self.group = []
        if self.ready and (last or self.size >= SORTED_AT_ONCE):
            out = deep_nodes(self.ready)
            self.ready, self.size = [], 0
            return out
        return []


def repeated_windows(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(documents as read, texts, candidate texts with their words, repeated windows).

    The last has (doc_id, first, last): successive windows of the text with that number, each of which also
    stands in a text with a smaller number.
    """
    read = settle_table(read_texts(documents), "repeats-read")
    texts = (
        read.filter("doc_id IS NOT NULL")
        .groupBy("checksum", "text_key")
        .agg(F.min("doc_id").alias("number"), F.count("*").alias("copies"))
    )
    # copies of a text say nothing new; there may be very many of them
    several = texts.filter("copies > 1").select("checksum", "number")
    copies = read.join(several, "checksum").filter("doc_id > number").select("doc_id", "text_key")
    places = (
        read.filter(F.size("anchors") > 0)
        .select("doc_id", "text_key", "anchors")
        .join(copies, ["doc_id", "text_key"], "left_anti")
        .select("doc_id", "text_key", F.explode("anchors").alias("prefix"))
    )
    shared = (
        places.groupBy("prefix")
        .agg(F.min("text_key").alias("low"), F.max("text_key").alias("high"), F.count("*").alias("n"))
        .filter("low <> high")
        .select("prefix", (F.col("n") > GROUP).alias("hot"))
    )
    wanted = (
        places.join(shared, "prefix")
        .groupBy("doc_id", "text_key")
        .agg(
            F.collect_set(F.when(~F.col("hot"), F.col("prefix"))).alias("shared"),
            F.collect_set(F.when(F.col("hot"), F.col("prefix"))).alias("crowded"),
        )
    )
    bodies = documents.select(F.col("doc_id").cast("bigint"), "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    candidates = settle_table(wanted.join(bodies, "doc_id"), "repeats-candidates")

    trees = map_rows(
        cut_stretches(candidates).repartition("prefix").sortWithinPartitions("prefix"),
        "doc_id bigint, first bigint, last bigint",
        TreeBuilder,
    )
    nodes = cut_windows(candidates)
    smallest = nodes.groupBy("node").agg(F.min("doc_id").alias("least"))
    crowded = (
        nodes.join(smallest, "node")
        .filter("least < doc_id")
        .select("doc_id", F.explode("places").alias("first"))
        .select("doc_id", "first", (F.col("first") + 1).alias("last"))
    )
    return read, texts, candidates, trees.unionByName(crowded)


def remove_repeats(candidates: DataFrame, windows: DataFrame) -> DataFrame:
    """Texts with repeats: (doc_id, text_key, n_removed, kept), the kept words joined by one space."""
    spans = windows.groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("spans"))

    def make():
        def rows(ids, keys, texts, spans):
            out = []
            for i, key, text, some in zip(ids, keys, texts, spans, strict=True):
                words = text.split()
                if text_key(words)[1] != key:
                    continue
                gone = np.zeros(len(words), bool)
                for s in some:
                    gone[s["first"] : s["last"] - 1 + WINDOW] = True
                kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
                out.append((i, key, int(gone.sum()), kept))
            return out

        return rows

    joined = candidates.join(spans, "doc_id").select("doc_id", "text_key", "text", "spans")
    return map_rows(joined, "doc_id bigint, text_key bigint, n_removed bigint, kept string", make)


def dedup_report(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256.

    A null text has no words. A text with fewer than WINDOW words has no window and keeps all. A document
    without an id has no place in the order: it keeps its words and takes none from others. Of equal texts
    the smallest id keeps what is new in it, the others lose every word; rows that repeat an id and its text
    get equal results. An empty table gives no rows; other columns are not looked at.
    """
    read, texts, candidates, windows = repeated_windows(documents)
    changed = (
        remove_repeats(candidates, windows)
        .select(F.col("doc_id").alias("number"), F.col("text_key").alias("key"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
        .dropDuplicates(["number", "key"])
    )
    several = texts.filter("copies > 1").select(F.col("checksum").alias("of"), F.col("number").alias("smallest"))
    out = read.select("doc_id", "n_words", "checksum", "text_key").join(several, F.col("checksum") == F.col("of"), "left")
    out = out.join(changed, (F.col("doc_id") == F.col("number")) & (F.col("text_key") == F.col("key")), "left")
    is_copy = F.coalesce(F.col("doc_id") > F.col("smallest"), F.lit(False)) & (F.col("n_words") >= WINDOW)
    return out.select(
        "doc_id",
        "n_words",
        F.when(is_copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(is_copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "checksum")).alias("kept_sha256"),
    )


def op3_prefix_suffix_trees(spark: SparkSession, folder: str) -> DataFrame:
    return dedup_report(table(spark, folder, "documents"))
