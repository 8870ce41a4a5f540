"""MinHash near-duplicates by a chosen-path set similarity join.

A document is the set of its distinct word shingles. Each of several independent trees branches documents by
minwise tokens: on every level a document follows the shingle that is smallest under a hash of that tree and
level, so two documents stay together with probability J per level (J: their Jaccard similarity). Nodes of
at most ``NODE`` documents are compared exhaustively; larger ones branch on. The number of trees follows from
the recall asked for at the level where similar documents normally meet.

Exhaustive comparison inside a node first drops pairs whose 64 one-byte minhashes agree too rarely (six
standard deviations below the threshold), and then confirms the others on full sets, rebuilt from the texts.
A pair belongs to the first tree in which it meets, so it is confirmed once. A node returns links that span
what it connects; pairs are not listed.

Nodes still too large on the last level hold many near copies of one text. They are cut into blocks that all
contain one common document. Once components are known, only documents of such a node outside its largest
component are still open: they are compared to all its documents, block by block.

Documents with equal sets are one class, whose number is the smallest id.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mendery.llm.common import ByKey, Words, map_rows, mix, shingles, signed, table
from mendery.llm.components import components
from mendery.session import settle_table

FIRST_LEVEL, LAST_LEVEL = 2, 4  # minwise tokens on the way to a node
USUAL_LEVEL = 3  # where the recall is counted
RECALL = 0.99999
NODE = 64
SKETCH = 64
# Documents on either side of a block in which open documents meet the others of a crowded node: two sides of
# sketches are 64 kB, their comparison 16 MB.
SIDE = 512


class Similarity(NamedTuple):
    """Words of a shingle, and the least similarity in percent."""

    words: int
    percent: int

    @property
    def trees(self) -> int:
        meet = (self.percent / 100) ** USUAL_LEVEL
        return math.ceil(math.log(1 - RECALL) / math.log(1 - meet))

    @property
    def agree(self) -> int:
        j = self.percent / 100
        return max(1, math.floor(SKETCH * j - 6 * math.sqrt(SKETCH * j * (1 - j))))

    def similar(self, a: np.ndarray, b: np.ndarray) -> bool:
        if 100 * min(len(a), len(b)) < self.percent * max(len(a), len(b)):
            return False
        common = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * common >= self.percent * (len(a) + len(b) - common)


def _multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_set(text: bytes | None, words: int, known: Words) -> np.ndarray:
    """Distinct shingles of the text with A-Z lower-cased, as sorted hashes."""
    return np.unique(shingles(known.hashes((text or b"").lower().split()), words))


def set_key(members: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    a, b = mix(members), mix(members ^ np.uint64(0x5851F42D4C957F2D))
    return tuple(signed(np.array([a.sum(), b.sum()], np.uint64)))


def minima(members: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """Smallest member under each of the hashes."""
    out = np.empty(len(multipliers), np.uint64)
    for i, m in enumerate(multipliers):
        out[i] = (members * m).min()
    return out


def read_sets(documents: DataFrame, similarity: Similarity) -> DataFrame:
    """Per document: id, size and key of its set, sketch, and for each tree the nodes of its path."""
    trees = similarity.trees

    def make():
        known = Words()
        of_paths, of_sketch = np.split(_multipliers(trees * LAST_LEVEL + SKETCH), [trees * LAST_LEVEL])

        def rows(ids, texts):
            out = []
            for i, t in zip(ids, texts, strict=True):
                members = shingle_set(t, similarity.words, known)
                if not len(members):
                    out.append((i, 0, None, None, None, None))
                    continue
                tokens = minima(members, of_paths).reshape(trees, LAST_LEVEL)
                path = np.arange(trees, dtype=np.uint64)
                levels = []
                for level in range(LAST_LEVEL):
                    path = mix(path * np.uint64(0xD6E8FEB86659FD93) + tokens[:, level])
                    levels.append(path)
                sketch = (mix(minima(members, of_sketch)) >> np.uint64(56)).astype(np.uint8).tobytes()
                out.append((i, len(members), *set_key(members), sketch, signed(np.stack(levels[FIRST_LEVEL - 1 :], axis=1).ravel())))
            return out

        return rows

    return map_rows(
        documents.select(F.col("doc_id").cast("bigint"), "text"),
        "doc_id bigint, n_shingles bigint, key_a bigint, key_b bigint, sketch binary, paths array<bigint>",
        make,
    )


def small_nodes(classes: DataFrame, trees: int) -> tuple[DataFrame, DataFrame]:
    """(tree, node, number) of nodes with 2 to NODE members, and of those too large on the last level."""
    depth = LAST_LEVEL - FIRST_LEVEL + 1
    rows = classes.select("number", F.posexplode("paths").alias("at", "node")).select(
        "number", F.floor(F.col("at") / depth).cast("int").alias("tree"), (F.col("at") % depth).alias("level"), "node"
    )
    small, crowded = [], None
    for level in range(depth):
        here = rows.filter(F.col("level") == level).select("number", "tree", "node")
        if crowded is not None:  # only what came through a crowded node goes on
            here = here.join(crowded.select("number", "tree"), ["number", "tree"], "left_semi")
        counts = here.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1")
        met = settle_table(here.join(counts, "node"), f"near-level{level}")
        small.append(met.filter(F.col("n") <= NODE).select("tree", "node", "number"))
        crowded = met.filter(F.col("n") > NODE).select("tree", "node", "number")
    out = small[0]
    for s in small[1:]:
        out = out.unionByName(s)
    return out, crowded


def _agreeing(sketches: list[bytes], least: int) -> np.ndarray:
    x = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), SKETCH)
    return (x[:, None, :] == x[None, :, :]).sum(axis=2) >= least


def promising(members: DataFrame, similarity: Similarity) -> DataFrame:
    """Members of nodes that have a partner there: (node, number). ``members`` has node, tree, number, sketch,
    ``met`` (the document's node in each tree, where it has company) and ``side``.

    A pair counts in the first tree in which it meets. Members of equal non-null ``side`` are no pair.
    """
    least = similarity.agree

    def one(rows: list[tuple]) -> list[tuple]:
        if len(rows) < 2:
            return []
        pairs = np.triu(_agreeing([r[3] for r in rows], least), 1)
        found = set()
        for i, j in np.argwhere(pairs).tolist():
            a, b = rows[i], rows[j]
            if a[2] == b[2] or (a[5] is not None and a[5] == b[5]):
                continue
            tree = a[1]
            if tree is None or not any(x == y for x, y in zip(a[4][:tree], b[4][:tree], strict=True) if x is not None):
                found.update((i, j))
        return [(rows[i][0], rows[i][2]) for i in sorted(found)]

    sorted_rows = members.select("node", "tree", "number", "sketch", "met", "side").repartition("node").sortWithinPartitions("node")
    return map_rows(sorted_rows, "node bigint, number bigint", lambda: ByKey(one))


def confirm(work: DataFrame, texts: DataFrame, similarity: Similarity) -> DataFrame:
    """Links (a, b) that span, in each node, what full sets connect; ``texts`` has number, key_a and text."""
    rows = work.join(texts, "number").select("node", "number", "key_a", "text")

    def make():
        known = Words()

        def one(rows: list[tuple]) -> list[tuple]:
            sets: dict[int, np.ndarray] = {}
            for _, number, key, text in sorted(rows, key=lambda r: r[1]):
                members = shingle_set(text, similarity.words, known)
                if number not in sets and len(members) and set_key(members)[0] == key:  # else another text of that id
                    sets[number] = members
            top = {n: n for n in sets}

            def root(n: int) -> int:
                while top[n] != n:
                    top[n] = n = top[top[n]]
                return n

            numbers, out = sorted(sets), []
            for i, a in enumerate(numbers):
                for b in numbers[i + 1 :]:
                    x, y = root(a), root(b)
                    if x != y and similarity.similar(sets[a], sets[b]):
                        top[max(x, y)] = min(x, y)
                        out.append((a, b))
            return out

        return ByKey(one)

    return map_rows(rows.repartition("node").sortWithinPartitions("node"), "a bigint, b bigint", make)


def _nodes_by_tree(nodes: DataFrame, trees: int) -> DataFrame:
    """(number, met): the node of each document in each tree, NULL where it has none here."""
    met = nodes.groupBy("number").agg(F.map_from_entries(F.collect_list(F.struct("tree", "node"))).alias("of"))
    by_tree = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.col("of")[t])
    return met.select("number", by_tree.alias("met"))


def _blocks_with_common(crowded: DataFrame) -> DataFrame:
    """Crowded nodes in blocks of about NODE members that all hold the node's smallest document."""
    sizes = crowded.groupBy("node").agg(F.count("*").alias("n"), F.min("number").alias("common"))
    placed = crowded.join(sizes, "node").withColumn("blocks", F.ceil(F.col("n") / (NODE // 2)))
    block = F.xxhash64("node", F.pmod(F.xxhash64("number"), F.col("blocks")))
    own = placed.select(block.alias("node"), "number")
    common = placed.select(block.alias("node"), F.col("common").alias("number")).distinct()
    return own.unionByName(common).distinct()


def _open_blocks(crowded: DataFrame, labels: DataFrame) -> DataFrame:
    """Blocks (node, tree, number, side) that bring together every open document of a crowded node with all
    others.

    Open are the documents outside the node's largest component. Both sides are dealt into hash buckets of
    about SIDE documents; a block is a pair of buckets, so its size does not depend on that of the node.
    """
    named = crowded.select("tree", "node", "number").join(labels.select(F.col("id").alias("number"), "component"), "number", "left")
    named = named.select("tree", "node", "number", F.coalesce("component", "number").alias("component"))
    groups = named.groupBy("node", "component").agg(F.count("*").alias("n"))
    nodes = groups.groupBy("node").agg(
        F.max(F.struct("n", (-F.col("component")).alias("c")))["c"].alias("largest"), F.sum("n").alias("n"), F.count("*").alias("parts"), F.max("n").alias("most")
    )
    live = named.join(nodes.filter("parts > 1").select("node", (-F.col("largest")).alias("largest"), "n", "most"), "node")
    salt = F.xxhash64("number", "node")
    buckets = F.ceil(F.col("n") / SIDE)
    open_buckets = F.ceil((F.col("n") - F.col("most")) / SIDE)
    live = live.withColumns({"bucket": F.pmod(salt, buckets), "open_buckets": open_buckets, "buckets": buckets})
    is_open = F.col("component") != F.col("largest")
    everyone = live.select("tree", "node", "number", "component", F.col("bucket"), F.explode(F.sequence(F.lit(0), F.col("open_buckets") - 1)).alias("facing"))
    asking = live.filter(is_open).select(
        "tree", "node", "number", "component", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"), F.pmod(F.xxhash64("node", "number"), F.col("open_buckets")).alias("facing")
    )
    both = everyone.unionByName(asking).select(F.xxhash64("node", "bucket", "facing").alias("node"), "tree", "number", F.col("component").alias("side"))
    return both.distinct()


def link_documents(documents: DataFrame, similarity: Similarity) -> tuple[DataFrame, DataFrame]:
    """(sets as read, labels): labels has (id, component) for the numbers that have a link."""
    read = settle_table(read_sets(documents, similarity), "near-sets")
    classes = read.filter("doc_id IS NOT NULL AND n_shingles > 0").groupBy("key_a", "key_b").agg(
        F.min("doc_id").alias("number"), F.min("sketch").alias("sketch"), F.min("paths").alias("paths")
    )
    classes = settle_table(classes, "near-classes")
    small, crowded = small_nodes(classes, similarity.trees)
    small = settle_table(small, "near-nodes")
    sketches = classes.select("number", "sketch")
    nothing = F.lit(None).cast("bigint").alias("side")
    facts = sketches.join(_nodes_by_tree(small, similarity.trees), "number")
    work = promising(small.join(facts, "number").select("node", "tree", "number", "sketch", "met", nothing), similarity)

    crowded = settle_table(crowded, "near-crowded")
    no_tree = [F.lit(None).cast("int").alias("tree"), "number", "sketch", F.lit(None).cast("array<bigint>").alias("met")]
    common = _blocks_with_common(crowded).join(sketches, "number")
    work = work.unionByName(promising(common.select("node", *no_tree, nothing), similarity))
    work = settle_table(work, "near-work")

    # the texts that may be compared are taken out of the corpus once
    wanted = work.select("number").union(crowded.select("number")).distinct().join(classes.select("number", "key_a"), "number")
    bodies = documents.select(F.col("doc_id").cast("bigint").alias("number"), "text").filter("text IS NOT NULL")
    texts = settle_table(bodies.join(wanted, "number"), "near-texts")
    links = settle_table(confirm(work, texts, similarity), "near-links")
    labels = components(links)
    if not crowded.isEmpty():
        facts = sketches.join(_nodes_by_tree(crowded, similarity.trees), "number")
        still = _open_blocks(crowded, labels).join(facts, "number").select("node", "tree", "number", "sketch", "met", "side")
        more = settle_table(confirm(promising(still, similarity), texts, similarity), "near-links")
        if not more.isEmpty():
            labels = components(links.unionByName(more))
    return read, labels


def near_duplicate_report(documents: DataFrame, similarity: Similarity) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable over links), kept.

    A text without words, or none, has no shingles and is linked with nothing; a text shorter than a shingle
    is one shingle. A document without an id is not compared: its component is null and it is kept. Rows that
    repeat an id count as one document. An empty table gives no rows; other columns are not looked at.
    """
    read, labels = link_documents(documents, similarity)
    rows = read.select("doc_id", "n_shingles", "key_a", "key_b")
    several = (
        rows.filter("doc_id IS NOT NULL AND n_shingles > 0")
        .groupBy("key_a", "key_b")
        .agg(F.min("doc_id").alias("number"), F.count("*").alias("n"))
        .filter("n > 1")
        .select(F.col("key_a").alias("a"), F.col("key_b").alias("b"), "number")
    )
    out = rows.join(several, (F.col("key_a") == F.col("a")) & (F.col("key_b") == F.col("b")), "left")
    out = out.withColumn("number", F.coalesce("number", "doc_id"))
    out = out.join(labels, F.col("number") == F.col("id"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "number"))
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def without_near_duplicates(documents: DataFrame, similarity: Similarity) -> DataFrame:
    """One document of each group, the one with the smallest id, with all its columns.

    Rows without an id stay. Of rows that repeat an id the smallest (by text, then by the other columns) stays.
    """
    report = settle_table(near_duplicate_report(documents, similarity), "near-report")
    gone = report.filter("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    repeated = (
        report.filter("kept AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__again")).agg(F.count("*").alias("n")).filter("n > 1")
    ).select("__again")
    # planned alike at every size: few ids would be broadcast on a small input and not on a large one
    out = documents.join(gone.hint("merge"), F.col("doc_id") == F.col("__gone"), "left_anti")
    if repeated.isEmpty():
        return out
    names = ["text", *[c for c in documents.columns if c != "text"]]
    once = (
        out.join(repeated, F.col("doc_id") == F.col("__again"), "left_semi")
        .groupBy(F.col("doc_id").alias("__id"))
        .agg(F.min(F.struct(*names)).alias("__row"))
        .select("__row.*")
        .select(*documents.columns)
    )
    return out.join(repeated, F.col("doc_id") == F.col("__again"), "left_anti").unionByName(once)


CONTRACT = Similarity(words=3, percent=85)
PIPELINE = Similarity(words=5, percent=80)


def op5_chosen_path_join(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicate_report(table(spark, folder, "documents"), CONTRACT)
