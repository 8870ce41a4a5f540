"""Document fingerprints as invertible Bloom lookup sketches, in DataFrame and SQL functions only.

A paragraph is a line, cut after every 32 words, so that a text of one line has several, too. Its digest is 60
bits of md5. A sketch has three tables of eight cells, and every digest enters one cell of each table: the cell
counts its digests and holds the xor of them and of their check values. Two sketches are subtracted cell by
cell: what both versions hold cancels out, and what is left is peeled. A cell with one digest gives it away,
the digest leaves its other cells, and so on, one table after another, so that no digest is taken twice in a
round.

Where peeling stops with cells left, the sketch was too small for the difference, and the pair is tried again
with sketches of four times as many cells: the digests split by two more bits, and each part has three tables of its own.
Only parts that failed are split on. So the differing digests are recovered exactly, whatever their number,
and every row that takes part is a part of one pair, never more than its own two texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mendery.llm.common import table
from mendery.session import settle_table

PARAGRAPH_WORDS = 32
TABLES, PLACES = 3, 8
CHECK = 2_147_483_629  # check value of a digest: its remainder; this prime keeps it from following the xor
ROUNDS = 36  # one table each; peeling ends sooner, after a round through all tables without a find
SPLIT_BITS = 2  # a retry has 2**2 times as many cells

_BLANK = r"\x20\x09-\x0D"
_PARAGRAPH = rf"[^{_BLANK}]++(?:[\x20\x09\x0B-\x0D]++[^{_BLANK}]++){{0,{PARAGRAPH_WORDS - 1}}}+"
_CELLS = TABLES * PLACES


def digests(text: Column) -> Column:
    """The set of a text's paragraph digests."""
    found = F.regexp_extract_all(text, F.lit(_PARAGRAPH), F.lit(0))
    return F.array_distinct(F.transform(found, lambda p: F.conv(F.substring(F.md5(p.cast("binary")), 1, 15), 16, 10).cast("bigint")))


def _cell_bits() -> str:
    """Mask and value of every cell: each table looks at three bits of the digest."""
    bits = [(PLACES - 1 << 3 * t, place << 3 * t) for t in range(TABLES) for place in range(PLACES)]
    return "array(" + ", ".join(f"named_struct('mask', {mask}L, 'bits', {value}L)" for mask, value in bits) + ")"


def sketch(column: str) -> Column:
    """Cells of a set of digests: mask and bits of the cell, number, xor of digests, xor of check values."""
    return F.expr(f"""
        transform(
          transform({_cell_bits()}, c -> named_struct('c', c, 'm', filter({column}, x -> (x & c.mask) = c.bits))),
          s -> named_struct(
            'mask', s.c.mask, 'bits', s.c.bits,
            'n', cast(size(s.m) as bigint),
            'd', aggregate(s.m, 0L, (a, x) -> a ^ x),
            'h', aggregate(s.m, 0L, (a, x) -> a ^ (x % {CHECK}L))))""")


_REST = "'mask', a.mask, 'bits', a.bits"


def subtracted(here: str, there: str) -> Column:
    return F.expr(f"zip_with({here}, {there}, (a, b) -> named_struct({_REST}, 'n', a.n - b.n, 'd', a.d ^ b.d, 'h', a.h ^ b.h))")


def peeled(cells: str) -> Column:
    """struct(cells, found, idle): what cannot be peeled, and the digests found with their sign."""
    pure = f"""
        transform(
          filter(
            slice(s.cells, {PLACES} * ((r - 1) % {TABLES}) + 1, {PLACES}),
            c -> abs(c.n) = 1 and (c.d & c.mask) = c.bits and c.d % {CHECK}L = c.h),
          c -> named_struct('n', c.n, 'd', c.d))"""
    return F.expr(f"""
        aggregate(
          sequence(1, {ROUNDS}),
          named_struct('cells', {cells}, 'found', cast(array() as array<struct<n: bigint, d: bigint>>), 'idle', 0),
          (s, r) -> if(s.idle >= {TABLES}, s,
            transform(array({pure}), p -> if(size(p) = 0,
              named_struct('cells', s.cells, 'found', s.found, 'idle', s.idle + 1),
              named_struct(
                'cells', transform(s.cells, c -> aggregate(
                   filter(p, x -> (x.d & c.mask) = c.bits), c,
                   (a, x) -> named_struct({_REST}, 'n', a.n - x.n, 'd', a.d ^ x.d, 'h', a.h ^ (x.d % {CHECK}L)))),
                'found', concat(s.found, p),
                'idle', 0)))[0]))""")


def fingerprint(column: str) -> Column:
    """Text form of a sketch: number of paragraphs, then count:digests:checks of every cell, in hexadecimal."""
    cells = F.transform(
        sketch(column),
        lambda c: F.concat_ws(":", c["n"].cast("string"), F.lower(F.hex(c["d"])), F.lower(F.hex(c["h"]))),
    )
    return F.concat_ws(";", F.size(column).cast("string"), F.concat_ws(",", cells))


def differences(pairs: DataFrame) -> DataFrame:
    """(key, kind, part, level, only_here, only_there) from (key, kind, here, there): digests of one side only.

    A pair gives one row per part in which its difference was recovered; parts do not overlap. Each retry is
    a pass over the parts that failed, written so that no pass runs twice.
    """
    parts = pairs.select("key", "kind", F.lit(0).cast("bigint").alias("part"), "here", "there")
    solved, level = [], 0
    while True:
        cells = parts.withColumn("here_cells", sketch("here")).withColumn("there_cells", sketch("there"))
        left = cells.withColumn("left", subtracted("here_cells", "there_cells")).withColumn("end", peeled("left"))
        done = F.expr("forall(end.cells, c -> c.n = 0 and c.d = 0 and c.h = 0)")
        tried = settle_table(
            left.withColumn("done", done).select(
                "key",
                "kind",
                "part",
                "done",
                *[F.when(F.col("done"), F.expr(f"transform(filter(end.found, x -> x.n = {n}), x -> x.d)")).alias(f"only_{side}") for side, n in (("here", 1), ("there", -1))],
                *[F.when(~F.col("done"), F.col(side)).alias(side) for side in ("here", "there")],
            ),
            f"peeled-{level}",
        )
        solved.append(tried.filter("done").select("key", "kind", "part", F.lit(level).alias("level"), "only_here", "only_there"))
        failed = tried.filter("not done")
        if failed.isEmpty():
            return reduce(DataFrame.union, solved)
        shift = TABLES * 3 + SPLIT_BITS * level
        ways = 1 << SPLIT_BITS
        inner = [F.expr(f"filter({side}, x -> (shiftright(x, {shift}) & {ways - 1}) = way)").alias(side) for side in ("here", "there")]
        parts = (
            failed.withColumn("way", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
            .select("key", "kind", (F.col("part") * ways + F.col("way")).alias("part"), *inner)
            .filter((F.size("here") > 0) | (F.size("there") > 0))
        )
        level += 1


def _followers(rows: DataFrame) -> DataFrame:
    """(key, doc_id, before, take, copies) per document: the key of the one before it, a quarter of that one's length, its rows.

    Ids are cut into ranges; inside a range a window finds the document before, and the first of a range
    follows the last of the range before, a table of one row per range. The first document follows the last.
    """
    one = rows.groupBy("key", "doc_id", "sha", F.length("text").alias("n")).agg(F.count("*").alias("copies"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("sha").asc()]
    ranges = settle_table(one.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "id-ranges")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "sha", "key", "n")
    ends = ranges.groupBy("range").agg(F.max(rank).alias("end"))
    previous = F.coalesce(F.lag("end").over(Window.orderBy("range")), F.max("end").over(Window.partitionBy()))
    ends = ends.select(F.col("range").alias("of_range"), previous.alias("end"))
    inside = Window.partitionBy("range").orderBy(*order)
    before = F.lag(F.struct("key", "n")).over(inside)
    found = ranges.withColumn("prior", before).join(F.broadcast(ends), F.col("range") == F.col("of_range"))
    prior = F.coalesce(F.col("prior"), F.struct(F.col("end.key").alias("key"), F.col("end.n").alias("n")))
    found = found.withColumn("previous", prior)
    return found.select("key", "doc_id", F.col("previous.key").alias("before"), F.expr("cast(previous.n div 4 as int)").alias("take"), "copies")


def fingerprints(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    n_paragraphs, edited_paragraphs, retries.

    The edited text ends, instead of its own last quarter, with as much of the beginning of the next document.
    Documents are ordered by id, null ids last, then by the SHA-256 of the text; rows that repeat id and text
    are one document, and each of them gets its result. Null text counts as empty. A single document is its
    own next. Likeness is the share of paragraphs in common, from the sizes and the recovered difference; two
    texts without paragraphs are alike (1.0). ``retries`` counts how often a larger sketch was needed. An
    empty table gives no rows. Other columns are not looked at.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select("doc_id", text.alias("text")).withColumn("sha", F.unhex(F.sha2("text", 256)))
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"))
    rows = rows.withColumn("key", F.concat(name.cast("binary"), "sha"))
    followers = settle_table(_followers(rows).withColumnRenamed("key", "of"), "followers")
    rows = rows.select("key", "text")  # both uses below read one exchange of these two columns
    placed = rows.join(followers, F.col("key") == F.col("of"))
    heads = (
        placed.select("before", F.expr("substring(text, 1, take)").alias("head"), digests(F.col("text")).alias("next"))
        .groupBy("before")
        .agg(F.first("head").alias("head"), F.first("next").alias("next"))
    )
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars - n_chars div 4 as int))"), "head")
    versions = settle_table(
        placed.select("key", "doc_id", "text", "copies", F.length("text").cast("bigint").alias("n_chars"))
        .join(heads, F.col("key") == F.col("before"))
        .withColumn("edited_text", edited)
        .select(
            "key", "doc_id", "copies", "n_chars",
            F.sha2("edited_text", 256).alias("edited_sha256"),
            digests(F.col("text")).alias("own"),
            digests(F.col("edited_text")).alias("edited"),
            "next",
        ),
        "versions",
    )
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("there")) for k in ("edited", "next")]))
    pairs = versions.select("key", F.col("own").alias("here"), kinds.alias("pair")).select("key", "pair.kind", "here", "pair.there")
    parts = differences(pairs).select("key", "kind", "level", (F.size("only_here") + F.size("only_there")).alias("n"))
    sizes = (
        parts.groupBy("key")  # rows that repeat id and text were peeled each: their sum is a multiple
        .agg(
            *[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"n_{k}") for k in ("edited", "next")],
            F.max("level").alias("retries"),
        )
        .withColumnRenamed("key", "of")
    )

    def like(other: str) -> Column:
        n, both = (F.col(f"n_{other}") / F.col("copies")).cast("bigint"), F.size("own") + F.size(other)
        return F.when(both == 0, 1.0).otherwise((both - n) / (both + n))

    return versions.join(sizes, F.col("key") == F.col("of")).select(
        "doc_id", "n_chars", "edited_sha256",
        fingerprint("own").alias("fingerprint"),
        fingerprint("edited").alias("edited_fingerprint"),
        like("edited").alias("near_edited"),
        like("next").alias("near_next"),
        F.size("own").alias("n_paragraphs"),
        F.size("edited").alias("edited_paragraphs"),
        "retries",
    )


CONTRACT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def op12_lookup_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints(table(spark, folder, "documents")).select(*CONTRACT)


_SQL_PARAGRAPH = rf"[^{_BLANK}]+(?:[\x20\x09\x0B-\x0D]+[^{_BLANK}]+){{0,{PARAGRAPH_WORDS - 1}}}"


def _prints(name: str, source: str) -> str:
    """Paragraph sets and printed sketches of a version in SQL."""
    return f"""
{name}_p AS (SELECT DISTINCT pos, ('0x' || substr(md5(unnest(regexp_extract_all({source}, '{_SQL_PARAGRAPH}'))), 1, 15))::BIGINT AS d FROM versions),
{name}_c AS (SELECT pos, i, count(*) AS n, bit_xor(d) AS d, bit_xor(d % {CHECK}) AS h
  FROM (SELECT pos, d, unnest(range({TABLES})) AS t FROM {name}_p) JOIN (SELECT unnest(range({_CELLS})) AS i) ON i = t * {PLACES} + ((d >> (3 * t)::INT) & {PLACES - 1})
  GROUP BY ALL),
{name}_f AS (SELECT pos, (SELECT count(*) FROM {name}_p p WHERE p.pos = a.pos) || ';' ||
    string_agg(coalesce(n, 0) || ':' || lower(to_hex(coalesce(d, 0))) || ':' || lower(to_hex(coalesce(h, 0))), ',' ORDER BY i) AS print
  FROM (SELECT pos, unnest(range({_CELLS})) AS i FROM versions) a LEFT JOIN {name}_c USING (pos, i) GROUP BY pos)"""


ORACLE = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id NULLS LAST, sha256(coalesce(text, ''))) AS pos FROM documents),
versions AS (SELECT doc_id, pos, text, length(text) AS n, coalesce(lead(text) OVER (ORDER BY pos), first_value(text) OVER (ORDER BY pos)) AS next,
    substr(text, 1, n - n // 4) || substr(next, 1, n // 4) AS edited FROM docs),
{_prints("own", "text")}, {_prints("edited", "edited")}, {_prints("next", "next")},
common AS (SELECT v.pos, (SELECT count(*) FROM own_p p WHERE p.pos = v.pos) AS own, (SELECT count(*) FROM edited_p p WHERE p.pos = v.pos) AS edited,
    (SELECT count(*) FROM next_p p WHERE p.pos = v.pos) AS next,
    (SELECT count(*) FROM own_p p JOIN edited_p q USING (pos, d) WHERE p.pos = v.pos) AS with_edited,
    (SELECT count(*) FROM own_p p JOIN next_p q USING (pos, d) WHERE p.pos = v.pos) AS with_next FROM versions v)
SELECT v.doc_id, v.n::BIGINT AS n_chars, sha256(v.edited) AS edited_sha256, o.print AS fingerprint, e.print AS edited_fingerprint,
  CASE WHEN c.own + c.edited = 0 THEN 1.0 ELSE c.with_edited::DOUBLE / (c.own + c.edited - c.with_edited) END AS near_edited,
  CASE WHEN c.own + c.next = 0 THEN 1.0 ELSE c.with_next::DOUBLE / (c.own + c.next - c.with_next) END AS near_next
FROM versions v JOIN own_f o USING (pos) JOIN edited_f e USING (pos) JOIN common c USING (pos)
"""
