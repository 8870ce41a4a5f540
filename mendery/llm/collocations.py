"""Collocations of each language, mined shard by shard (SON) and then counted exactly.

Documents are dealt to ``shards`` shards, neighbouring ids together. A phrase that occurs ``support`` times in all occurs at
least ``support / shards`` times in one of them, so mining every shard completely at that lowered support
loses nothing. Inside a shard this goes by levels: words and pairs of words first, then phrases of three and four words
whose pairs are all frequent there. Shards are mined by many tasks each: a task counts what it reads and
sends counts per (shard, hash of the phrase), so neither a shard nor the corpus has to fit anywhere.

The union of what is frequent in some shard, whatever it sums up to, is then counted over all documents, by the
words themselves. Hashes only choose what is counted: two phrases with one hash make a candidate more, never one less.
The support is asked for only of these counts. Sums of the first passes are not used for it: a longer phrase is
counted there only in shards in which its pairs are frequent, so its sum can be too small.

Which phrases are frequent is sent to the tasks as a bit table of fixed size (two bits a phrase, as in a Bloom
filter): 8 MB whatever the corpus. A fuller table lets more phrases through to the exact count.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mendery.llm.common import as_list, bound_batches, mix, record_batch, table
from mendery.session import settle_table

LONGEST = 4
BREAK, END = b"\n", b"\r"  # stand between pieces and after a part of a text; no word is one
HELD = 5_000_000  # hashes that a task gathers before it counts and sends them
NAMED = 3_000_000  # counts of phrases that a task gathers before it sends them
NAMED_BYTES = 32 << 20
SENT = 50_000  # rows and bytes that are sent at once
SENT_BYTES = 8 << 20
RUN = 4 << 20  # bytes of text that are worked on at once
NEIGHBOURS = 4096  # ids that go to one shard together, so that a task counts for few shards
SLICE = 2 << 20  # bytes of a text that are cut into words at a time
TABLE_BITS = 26
_WIDE = 32_768  # bits of one row of bitmap_construct_agg
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = 15_485_863  # shifts the bits of one shard against the next
_BLOCK = 1 << 18
_LETTERS = mix(np.arange(1, 257, dtype=np.uint64) * _MIX)
_BACK = np.uint64(pow(int(_MIX), -1, 1 << 64))
_POWERS, _BACKS = (np.cumprod(np.r_[np.uint64(1), np.full(_BLOCK, x)]) for x in (_MIX, _BACK))

# Fixed values of the contract: what ends a piece, and capitals that are lowered.
_FOLD = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d\x09" + bytes(range(65, 91)), b"\n" * 10 + b" " + bytes(range(97, 123)))


@dataclass(frozen=True)
class Mining:
    support: int = 30
    shards: int = 8
    covered: int = 80  # per cent of a phrase's occurrences that a longer one must have to replace it
    top: int = 2000

    @property
    def local_support(self) -> int:
        return -(-self.support // self.shards)


# ---------------------------------------------------------------------------------- words


def slices(text: bytes) -> Iterator[tuple[list[bytes], int]]:
    """Words and breaks of a text in parts of bounded size; a part that goes on within a piece begins with
    the last words of the part before, whose number comes with it."""
    at, carried = 0, []
    while at < len(text):
        end = min(at + SLICE, len(text))
        if end < len(text):
            found = [p for p in (text.find(b" ", end), text.find(BREAK, end)) if p >= 0]
            end = min(found, default=len(text))
        part = text[at:end].replace(BREAK, b" \n ").split(b" ")
        tokens = carried + [t for t in part if t]
        last = tokens[-(LONGEST - 1) :]
        if BREAK in last:
            last = last[len(last) - last[::-1].index(BREAK) :]
        yield tokens, len(carried)
        carried, at = last, end


def word_hashes(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashes of the words that begin at ``starts`` and go on to the next: sums over their bytes, each times a power
    for its place, divided by the power of the place where the word begins."""
    bounds = np.append(starts, len(text))
    sums, back = np.empty((2, len(bounds)), np.uint64)
    total, up, down = np.zeros(1, np.uint64), np.ones(1, np.uint64), np.ones(1, np.uint64)
    for at in range(0, len(text) + 1, _BLOCK):
        block = text[at : at + _BLOCK]
        a, b = np.searchsorted(bounds, [at, at + _BLOCK])
        before = np.cumsum(np.concatenate([total, _LETTERS[block] * _POWERS[: len(block)] * up]))
        sums[a:b], back[a:b] = before[bounds[a:b] - at], _BACKS[bounds[a:b] - at] * down
        total, up, down = before[-1:], up * _POWERS[-1], down * _BACKS[-1]
    return mix((sums[1:] - sums[:-1]) * back[:-1])


class Stream:
    """The words of some texts in a row, with the shard and language of each, and hashes of their phrases."""

    def __init__(self, parts: list[tuple[bytes, int, int, bytes]]):
        """``parts`` are words and breaks with spaces between, how many words are carried, shard, language."""
        text = np.frombuffer(b"".join([part for words, *_ in parts for part in (words, b" \r ")]), np.uint8)
        space = text == 32
        self.text = text[~(space & np.r_[True, space[:-1]])]  # one space after each word
        self.starts = np.r_[0, np.flatnonzero(self.text == 32) + 1][:-1]
        kind = self.text[self.starts]
        ends = np.flatnonzero(kind == END[0]) + 1
        sizes = np.diff(ends, prepend=0)
        numbers: dict[bytes, int] = {}
        langs = [numbers.setdefault(lang, len(numbers)) for *_, lang in parts]
        self.langs = list(numbers)
        self.shard, self.lang = np.repeat(np.array([[p[2] for p in parts], langs], np.int32), sizes, axis=1)
        self.old = np.zeros(len(kind), bool)  # words carried over from the part before
        for (_, carried, _, _), end, size in zip(parts, ends.tolist(), sizes.tolist(), strict=True):
            if carried:
                self.old[end - size : end - size + carried] = True
        self.word, self.is_word = word_hashes(self.text, self.starts), (kind != BREAK[0]) & (kind != END[0])
        # languages with one seed would share candidates, not counts
        seeds = mix(np.array([zlib.crc32(lang) for lang in self.langs], np.uint64) + _MIX)
        self._hashes, self._ok = {0: seeds[self.lang]}, {0: np.ones(len(kind), bool)}

    def coded(self) -> pa.DictionaryArray:
        """The words, each with a space, by number."""
        offsets = np.append(self.starts, len(self.text)).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(self.starts), [None, pa.py_buffer(offsets), pa.py_buffer(self.text)]).dictionary_encode()

    def h(self, k: int) -> np.ndarray:
        """Hash of the phrase of k words at each place."""
        if k not in self._hashes:
            n = max(len(self.word) - k + 1, 0)
            self._hashes[k] = mix(self.h(k - 1)[:n] * _MIX + self.word[k - 1 :]) if n else self.word[:0]
        return self._hashes[k]

    def ok(self, k: int) -> np.ndarray:
        """Where no break is among the k words."""
        if k not in self._ok:
            n = max(len(self.word) - k + 1, 0)
            self._ok[k] = self.ok(k - 1)[:n] & self.is_word[k - 1 :]
        return self._ok[k]

    def fresh(self, k: int) -> np.ndarray:
        """Where phrases of k words begin that no earlier part has had."""
        return self.ok(k) & ~self.old[k - 1 :]


def runs(h: np.ndarray, lang: np.ndarray, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Counts of phrases with equal ones brought together. Hashes bring them together, languages and words tell them
    apart."""
    if not len(h):
        return h, lang, ids, n
    order = np.argsort(h)
    h, lang, ids = h[order], lang[order], ids[order]
    differs = (lang[1:] != lang[:-1]) | (ids[1:] != ids[:-1]).any(axis=1)
    first = np.flatnonzero(np.r_[True, differs])
    return h[first], lang[first], ids[first], np.add.reduceat(n[order], first)


def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[Stream]:
    """Batches of (text, lang, shard) as streams of words."""
    parts, size = [], 0
    for batch in batches:
        for text, lang, shard in zip(*(as_list(batch.column(i)) for i in range(3)), strict=True):
            text = text.translate(_FOLD)
            cut = [(text.replace(BREAK, b" \n "), 0)] if len(text) <= SLICE else ((b" ".join(t), c) for t, c in slices(text))
            for words, carried in cut:
                parts.append((words, carried, shard, lang))
                size += len(words) + 3
                if size >= RUN:
                    yield Stream(parts)
                    parts, size = [], 0
    if parts:
        yield Stream(parts)


# ---------------------------------------------------------------------------------- counting in tasks


class Hashes:
    """Counts of (shard, hash), sent when enough are held."""

    def __init__(self, shards: int):
        self.held: list[list[np.ndarray]] = [[] for _ in range(shards)]
        self.size = 0

    def add(self, shards: np.ndarray, hashes: np.ndarray) -> None:
        for s in np.unique(shards).tolist():
            self.held[s].append(hashes[shards == s])
        self.size += len(hashes)

    def take(self) -> list[tuple[int, np.ndarray, np.ndarray]]:
        out = [(s, *np.unique(np.concatenate(h), return_counts=True)) for s, h in enumerate(self.held) if h]
        self.__init__(len(self.held))
        return out


class Named:
    """Counts of phrases by language and the numbers of their words, sent when enough are held."""

    def __init__(self):
        self.words: list[pa.Array] = []
        self.langs: list[list[bytes]] = []
        self.held: dict[int, list[tuple[np.ndarray, ...]]] = {k: [] for k in range(1, LONGEST + 1)}
        self.rows = self.bytes = 0

    def add(self, stream: Stream, places: dict[int, np.ndarray]) -> None:
        coded = stream.coded()
        codes = coded.indices.to_numpy()
        for k, where in places.items():
            ids = np.stack([codes[where + j] for j in range(k)], axis=1)
            found = runs(stream.h(k)[where], stream.lang[where], ids, np.ones(len(where), np.int64))
            self.held[k].append(found)
            self.rows += len(found[0])
        self.words.append(coded.dictionary)
        self.langs.append(stream.langs)
        self.bytes += coded.dictionary.nbytes + sum(map(len, stream.langs))

    def full(self) -> bool:
        return self.rows >= NAMED or self.bytes >= NAMED_BYTES

    def take(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            words, word_numbers = _as_one([pc.binary_slice(w, 0, -1) for w in self.words])
            langs, lang_numbers = _as_one([pa.array(names, pa.binary()) for names in self.langs])
            length = pc.binary_length(words).to_numpy().astype(np.int64) + 1
        for k, held in self.held.items():
            if not sum(len(h) for h, *_ in held):
                continue
            same = [(h, new[lang], now[ids], n) for (h, lang, ids, n), new, now in zip(held, lang_numbers, word_numbers, strict=True)]
            _, lang, ids, n = runs(*map(np.concatenate, zip(*same, strict=True)))
            ends = np.cumsum(length[ids].sum(axis=1))
            at = 0
            while at < len(ids):
                to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SENT_BYTES, "right"))
                to = max(at + 1, min(to, at + SENT))
                phrase = pc.binary_join_element_wise(*[words.take(pa.array(ids[at:to, j])) for j in range(k)], " ")
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(lang[at:to])), phrase, pa.array(n[at:to])], schema=_NAMED_ARROW)
                at = to
        self.__init__()


def _as_one(parts: list[pa.Array]) -> tuple[pa.Array, list[np.ndarray]]:
    """The different values of several arrays, and the numbers in them of each array's values."""
    coded = pa.concat_arrays(parts).dictionary_encode()
    numbers = np.split(coded.indices.to_numpy(), np.cumsum([len(p) for p in parts])[:-1])
    return coded.dictionary.cast(pa.string()), numbers


_NAMED = "lang string, words string, n bigint"
_NAMED_ARROW = pa.schema([("lang", pa.string()), ("words", pa.string()), ("n", pa.int64())])
_HASHED = "shard int, h bigint, n bigint"
_HASHED_ARROW = pa.schema([("shard", pa.int32()), ("h", pa.int64()), ("n", pa.int64())])


def counted_by_hash(documents: DataFrame, pick, shards: int) -> DataFrame:
    """(shard, h, n): counts from one pass, not yet summed up over tasks. ``pick(stream, k)`` chooses the places of
    phrases of k words (None: nowhere)."""
    bound_batches(documents)

    def send(hashes: Hashes) -> Iterator[pa.RecordBatch]:
        for shard, h, n in hashes.take():
            for at in range(0, len(h), 2 * SENT):
                part = h[at : at + 2 * SENT].view(np.int64)
                arrays = [pa.array(np.full(len(part), shard, np.int32)), pa.array(part), pa.array(n[at : at + 2 * SENT].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, schema=_HASHED_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes(shards)
        for stream in streams(batches):
            for k in range(1, LONGEST + 1):
                mask = pick(stream, k)
                if mask is not None:
                    where = np.flatnonzero(mask)
                    hashes.add(stream.shard[where], stream.h(k)[where])
            if hashes.size >= HELD:
                yield from send(hashes)
        yield from send(hashes)

    # Tasks have counted what they hold, so rows are exchanged as they are and then summed up.
    return documents.mapInArrow(run, _HASHED).repartition("h")


def counted_by_words(documents: DataFrame, pick) -> DataFrame:
    """(lang, words, n): counts from one pass, not yet summed up over tasks; without words, the number of all words."""
    bound_batches(documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named, totals = Named(), Counter()
        for stream in streams(batches):
            every = np.bincount(stream.lang[stream.fresh(1)], minlength=len(stream.langs)).tolist()
            for lang, n in zip(stream.langs, every, strict=True):
                totals[lang] += n
            named.add(stream, {k: np.flatnonzero(pick(stream, k)) for k in range(1, LONGEST + 1)})
            if named.full():
                yield from named.take()
        yield from named.take()
        rows = [(lang.decode(), None, n) for lang, n in totals.items() if n]
        if rows:
            yield record_batch(rows, _NAMED_ARROW)

    return documents.mapInArrow(run, _NAMED).repartition("lang", "words")


# ---------------------------------------------------------------------------------- bit tables


def _places(h: Column, shard: Column) -> list[Column]:
    mask = F.lit((1 << TABLE_BITS) - 1)
    parts = [h, F.shiftrightunsigned(h, TABLE_BITS)]
    return [(p.bitwiseAND(mask) + shard.cast("bigint") * _STEP).bitwiseAND(mask) + 1 for p in parts]


def bit_table(spark: SparkSession, phrases: DataFrame):
    """Broadcast bits of (shard, h): 2**TABLE_BITS of them, however many rows there are."""
    bits = phrases.select(F.explode(F.array(*_places(F.col("h"), F.col("shard")))).alias("bit"))
    rows = (
        bits.groupBy(F.bitmap_bucket_number("bit").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
        .collect()
    )
    out = np.zeros((1 << TABLE_BITS) // 8, np.uint8)
    for r in rows:
        at = (r.bucket - 1) * _WIDE // 8
        out[at : at + _WIDE // 8] = np.frombuffer(bytes(r.bits), np.uint8)
    return spark.sparkContext.broadcast(out)


def in_table(bits: np.ndarray, h: np.ndarray, shard: np.ndarray | int) -> np.ndarray:
    """Which hashes may be in the table."""
    mask, found = np.uint64((1 << TABLE_BITS) - 1), np.ones(len(h), bool)
    shift = (np.asarray(shard).astype(np.uint64) * np.uint64(_STEP)) & mask
    for part in (h, h >> np.uint64(TABLE_BITS)):
        at = ((part & mask) + shift) & mask
        found &= (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found


# ---------------------------------------------------------------------------------- SON


def _words_and_pairs(stream: Stream, k: int) -> np.ndarray | None:
    return stream.fresh(k) if k <= 2 else None


def _longer(bits):
    def pick(stream: Stream, k: int) -> np.ndarray | None:
        if k <= 2:
            return None
        n = len(stream.h(k))
        if k == LONGEST - 1:  # looked up once for both lengths
            stream.pairs = in_table(bits.value, stream.h(2), stream.shard[: len(stream.h(2))])
        pairs = stream.pairs
        mask = stream.fresh(k)
        for j in range(k - 1):
            mask = mask & pairs[j : j + n]
        return mask

    return pick


def _candidates(bits):
    def pick(stream: Stream, k: int) -> np.ndarray:
        n = len(stream.h(k))
        mask = stream.ok(k).copy()
        if k > 1:  # what is frequent in a shard has only frequent parts there
            mask &= stream.chosen[:n] & stream.chosen[1 : n + 1]
        where = np.flatnonzero(mask)
        mask[where] = in_table(bits.value, stream.h(k)[where], 0)
        stream.chosen = mask
        return mask & stream.fresh(k)

    return pick


def _frequent(counts: DataFrame, options: Mining) -> DataFrame:
    """(shard, h) of what is frequent in a shard."""
    return counts.groupBy("h", "shard").agg(F.sum("n").alias("n")).filter(F.col("n") >= options.local_support).select("shard", "h")


def mine(documents: DataFrame, options: Mining = Mining()) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): (lang, words, n) of everything of 1 to 4 words that has the support, and (lang, total)."""
    spark = documents.sparkSession
    text, lang = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("lang"), F.lit("und"))
    shard = F.pmod(F.xxhash64(F.floor(F.col("doc_id") / NEIGHBOURS)), F.lit(options.shards)).cast("int")
    rows = documents.select(text.alias("text"), lang.alias("lang"), shard.alias("shard"))
    short = settle_table(_frequent(counted_by_hash(rows, _words_and_pairs, options.shards), options), "words-and-pairs")
    longer = counted_by_hash(rows, _longer(bit_table(spark, short)), options.shards)
    longer = settle_table(_frequent(longer, options), "longer-phrases")

    union = short.unionByName(longer).select(F.lit(0).alias("shard"), "h")
    exact = counted_by_words(rows, _candidates(bit_table(spark, union))).groupBy("lang", "words").agg(F.sum("n").alias("n"))
    exact = settle_table(exact.filter((F.col("n") >= options.support) | F.col("words").isNull()), "phrases")
    return exact.filter("words is not null"), exact.filter("words is null").select("lang", F.col("n").alias("total"))


def collocations(documents: DataFrame, options: Mining = Mining()) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Null text is empty, a null language is ``und``; a row that is there twice counts twice, and documents of
    one id count as they are. A language without phrases of the support gives no rows, nor does an empty table.
    Equal scores are ordered by frequency, then by the phrase's UTF-8 bytes. Scores are exact (decimals).
    Other columns are not looked at.
    """
    parts, totals = mine(documents, options)
    part = lambda side: parts.select(F.col("lang").alias(f"{side}_lang"), F.col("words").alias(f"{side}_words"), F.col("n").alias(side))
    split = parts.withColumn("word", F.split("words", " ", -1)).filter("size(word) > 1")
    cuts = split.withColumn("k", F.explode(F.expr("sequence(1, size(word) - 1)"))).select(
        "lang", "words", "n", "k",
        F.expr("array_join(slice(word, 1, k), ' ')").alias("left"),
        F.expr("array_join(slice(word, k + 1, size(word) - k), ' ')").alias("right"),
    )
    weighed = cuts.join(part("l"), (F.col("lang") == F.col("l_lang")) & (F.col("left") == F.col("l_words"))).join(
        part("r"), (F.col("lang") == F.col("r_lang")) & (F.col("right") == F.col("r_words"))
    )
    score = F.expr("(cast(n as decimal(20, 0)) * 2000000) div (cast(l as decimal(20, 0)) + r)")
    scored = weighed.groupBy("lang", "words", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    inner = split.filter("size(word) > 2").select(
        F.col("lang").alias("of_lang"),
        F.col("n").alias("longer"),
        F.explode(
            F.expr(
                "flatten(transform(sequence(2, size(word) - 1), w -> transform(sequence(1, size(word) - w + 1), i -> array_join(slice(word, i, w), ' '))))"
            )
        ).alias("inside"),
    )
    longest = inner.groupBy("of_lang", "inside").agg(F.max("longer").alias("longer"))
    kept = scored.join(longest, (F.col("lang") == F.col("of_lang")) & (F.col("words") == F.col("inside")), "left").filter(
        F.expr(f"longer is null or cast(longer as decimal(20, 0)) * 100 < cast(n as decimal(20, 0)) * {options.covered}")
    )
    order = [F.col("cut.score").desc(), F.col("n").desc(), F.col("words").asc()]
    # the best of each part of a language first, so that no task orders a whole language
    few = kept.withColumn("salt", F.pmod(F.xxhash64("words"), F.lit(64)))
    few = few.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("place") <= options.top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= options.top)
    return ranked.join(totals.withColumnRenamed("lang", "total_lang"), F.col("lang") == F.col("total_lang")).select(
        "lang",
        F.col("rank").cast("bigint").alias("rank"),
        F.col("words").alias("phrase"),
        F.col("n").alias("a"),
        F.col("cut.l").alias("l"),
        F.col("cut.r").alias("r"),
        F.col("total").alias("n"),
        F.col("cut.score").cast("bigint").alias("score"),
    )


def op13_shard_mined_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))


ORACLE = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
one AS (SELECT lang, id, unnest(w) AS w1, unnest(range(len(w))) AS i FROM w),
runs AS (SELECT lang, w1, lead(w1, 1) OVER later AS w2, lead(w1, 2) OVER later AS w3, lead(w1, 3) OVER later AS w4
  FROM one WINDOW later AS (PARTITION BY id ORDER BY i)),
f AS (SELECT lang, 1 AS k, w1 AS phrase, count(*) AS f FROM runs GROUP BY ALL
  UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM runs WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM runs WHERE w3 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, count(*) FROM runs WHERE w4 IS NOT NULL GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, phrase, f AS a, k AS size, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
cuts AS (SELECT c.*, x.k FROM c, (SELECT unnest([1, 2, 3]) AS k) x WHERE x.k < size),
scores AS (SELECT c.lang, c.phrase, c.a, c.size, c.k, l.f AS l, r.f AS r, ((2000000::HUGEINT * c.a) // (l.f + r.f))::BIGINT AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : c.k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1 : ], ' ')),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_phrases AS (SELECT c.lang, c.a, array_to_string(c.w[i : i + k - 1], ' ') AS phrase
  FROM c, (SELECT unnest([2, 3]) AS k), (SELECT unnest([1, 2, 3]) AS i) WHERE k < c.size AND i + k - 1 <= c.size),
longest AS (SELECT lang, phrase, max(a) AS longer FROM inner_phrases GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN longest USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""
