"""Benchmark decontamination by templates.

Words become typed placeholders where a question could be re-parameterised: numbers, names (capitalised
inside a sentence) and units (after a number). Windows of ``WINDOW`` canonical words of the benchmark are
hash-joined with those of every document. Around the hits the item is lined up with the text word by word:
runs of equal canonical words, in order, whose differences of positions change by at most ``DRIFT`` from run
to run, so that changed, added and dropped words only cost themselves. An item counts as leaked when of its
words, lined up like this,

- at least ``MIN_COVERAGE`` match, whatever the values of their slots, or
- at least ``MIN_PART``, and ``MIN_WORDS`` of them, stand as they are, or
- ``LONG_RUN`` stand as they are in one run (slots with other values inside do not count, nor break it).

An item of up to ``MIN_WORDS`` words must match whole, wherever it stands, and one of nothing but slots and
punctuation must have its own values. It is ``reparameterised`` when a slot value differs.

Slots must be consistent: what the item names more than once is one thing, so an alignment that gives it two
different new values is another text, and a leak only if at least ``MIN_COVERAGE`` of the item stand as they are or
``LONG_RUN`` do without a gap. A slot that keeps its own value contradicts nothing (the other one is an edit), the
document may give one value to different things of the item, and values of ``CHANCE_CHARS`` characters and words for
numbers agree by chance inside an item, so they bind nothing. Windows that agree with the value which most slots
of a thing have count as matched (``n_matched``).
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from typing import NamedTuple

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendery.llm.common import KNOWN_WORDS, REMEMBERED, filter_rows, map_rows, one_run, shingles, table

WINDOW = 5
MIN_COVERAGE = 0.8
MIN_PART = 0.5
MIN_WORDS = 8
LONG_RUN = 15
DRIFT = 6
CHANCE_CHARS = 1  # values of an item up to this long may be equal without meaning the same thing
PIECE = 2  # words of a run that is lined up beside a window
# The benchmark is joined in blocks of at most so many words, each broadcast to all documents in turn, so
# what is sent out is bounded whatever the size of the benchmark (about 80 MB a block).
BLOCK_WORDS = 1_000_000

# Words for numbers and common units.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve hundred thousand million".split()
UNITS = (
    "mm cm m km in ft yd mi mile miles meter meters metre metres g kg mg lb lbs oz ton tons s sec second seconds "
    "min minute minutes h hour hours day days week weeks month months year years l ml liter liters litre litres "
    "dollar dollars cent cents euro euros usd eur percent % kmh mph km/h m/s °c °f kb mb gb tb w kw v hz"
).split()

_NUMBER = re.compile(r"[+-]?[$€£]?[0-9][0-9.,:/]*(?:st|nd|rd|th|%)?")
_QUANTITY = re.compile(r"[+-]?[$€£]?[0-9][0-9.,]*([a-z/°%]+)")
_EDGE = "\"'`.,;:!?()[]{}<>#*$&|~^=\\-_"
_NUM, _NAME, _UNIT, _QTY = (np.uint64(xxhash.xxh3_64_intdigest(b"<%s>" % x)) for x in (b"num", b"name", b"unit", b"qty"))
_BARE = np.uint64(xxhash.xxh3_64_intdigest(b""))  # words of punctuation only
_IS_NUM, _IS_NAME, _IS_UNIT, _ENDS = 1, 2, 4, 8


class Forms(dict):
    """Raw word (bytes) to a row of the arrays: its own hash, its hash as a plain word, its kinds, whether it ends
    a sentence."""

    def __init__(self):
        self.word = np.zeros(KNOWN_WORDS, np.uint64)
        self.plain = np.zeros(KNOWN_WORDS, np.uint64)
        self.kind = np.zeros(KNOWN_WORDS, np.uint8)

    def __missing__(self, word: bytes) -> int:
        if len(word) > REMEMBERED:  # stands under its hash, so that the memory stays bounded in bytes
            short = xxhash.xxh3_128_digest(word)
            if short in self:
                return self[short]
        else:
            short = word
        at = len(self)
        text = word.decode("utf-8", "replace")
        core = text.strip(_EDGE)
        low = core.lower()
        kind = 0
        own = plain = np.uint64(xxhash.xxh3_64_intdigest(low.encode()))
        if _NUMBER.fullmatch(core) or low in NUMBER_WORDS:
            kind, plain = _IS_NUM, _NUM
        elif (m := _QUANTITY.fullmatch(low)) and m[1] in UNITS:
            kind, plain = _IS_NUM, _QTY
        else:
            if low in UNITS:
                kind |= _IS_UNIT
            if core[:1].isupper() and core[1:].islower():
                kind |= _IS_NAME
        if text.rstrip("\"')]}*").endswith((".", "!", "?", ":")):
            kind |= _ENDS
        self.word[at], self.plain[at], self.kind[at] = own, plain, kind
        self[short] = at
        return at

    def read(self, words: list[bytes]) -> Template:
        if len(self) + len(words) > KNOWN_WORDS:
            self.clear()
        if len(words) > KNOWN_WORDS:  # one text with more words than the memory holds: in pieces
            cut = KNOWN_WORDS // 2
            parts = [self._arrays(words[i : i + cut]) for i in range(0, len(words), cut)]
            word, plain, kind = (np.concatenate(x) for x in zip(*parts, strict=True))
        else:
            word, plain, kind = self._arrays(words)
        start = np.ones(len(words), bool)
        start[1:] = (kind[:-1] & _ENDS) > 0
        after_number = np.zeros(len(words), bool)
        after_number[1:] = (kind[:-1] & _IS_NUM) > 0
        name = ((kind & _IS_NAME) > 0) & ~start
        unit = ((kind & _IS_UNIT) > 0) & after_number
        hashes = np.where(unit, _UNIT, np.where(name, _NAME, plain))
        return Template(hashes, plain, unit | name | ((kind & _IS_NUM) > 0), name, word)

    def _arrays(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(self) + len(words) > KNOWN_WORDS:
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.word[at], self.plain[at], self.kind[at]


class Template(NamedTuple):
    hashes: np.ndarray
    plain: np.ndarray
    slot: np.ndarray  # whether a word is a placeholder
    name: np.ndarray
    word: np.ndarray  # hashes of the words as they are

    def windows(self, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes and starts of all windows. A window that opens with a name is also taken with that word
        plain: at the start of a quoted passage a capital is no sign of a name. The last array tells these."""
        own = shingles(self.hashes, size)
        n = len(own)
        at = np.flatnonzero(self.name[:n])
        if not len(at):
            return own, np.arange(n), np.zeros(n, bool)
        size = min(size, len(self.hashes))
        stack = np.stack([self.plain[at], *[self.hashes[at + k] for k in range(1, size)]])
        other = one_run(stack)
        return np.concatenate([own, other]), np.concatenate([np.arange(n), at]), np.concatenate([np.zeros(n, bool), np.ones(len(at), bool)])


class Block(NamedTuple):
    """Windows of some benchmark items, sorted by hash."""

    hashes: np.ndarray
    item: np.ndarray
    place: np.ndarray
    items: list[tuple[int, list[bytes], Template]]
    sizes: list[int]  # of the windows
    filter: np.ndarray  # by the upper 20 bits of a hash: whether any window has them

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.filter[(hashes >> np.uint64(44)).astype(np.int64)])
        if not len(maybe) or not len(self.hashes):
            return maybe[:0]
        at = np.searchsorted(self.hashes, hashes[maybe])
        at[at == len(self.hashes)] = 0
        return maybe[self.hashes[at] == hashes[maybe]]


def seed_size(n: int) -> int:
    """Words of a window of an item of n words: one edit in an item that need not match whole spares one."""
    return min(WINDOW, n if n <= MIN_WORDS else n // 2)


def build_block(items: list[tuple[int, bytes]]) -> Block:
    forms, hashes, item, place, kept, sizes = Forms(), [], [], [], [], set()
    for item_id, text in sorted(items):
        words = text.split()
        if not words:
            continue
        template, size = forms.read(words), seed_size(len(words))
        own = shingles(template.hashes, size)
        hashes.append(own)
        item.append(np.full(len(own), len(kept)))
        place.append(np.arange(len(own)))
        kept.append((item_id, words, template))
        sizes.add(size)
    found = np.zeros(1 << 20, bool)
    if not kept:
        return Block(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), [], [], found)
    h, i, p = np.concatenate(hashes), np.concatenate(item), np.concatenate(place)
    order = np.argsort(h, kind="stable")
    found[(h >> np.uint64(44)).astype(np.int64)] = True
    return Block(h[order], i[order], p[order], kept, sorted(sizes), found)


class Leak(NamedTuple):
    item_id: int
    n_windows: int
    n_matched: int
    start: int  # first word of the document that matches
    end: int
    reparameterised: bool
    slots: str


def _value(word: bytes) -> str:
    return word.decode("utf-8", "replace").strip(_EDGE).lower()


def find_leaks(words: list[bytes], forms: Forms, block: Block) -> list[Leak]:
    """Items whose template stands in the text, at most one row per item: its best alignment."""
    if not words:
        return []
    template = forms.read(words)
    shifts: dict[int, set[int]] = defaultdict(set)
    for size in block.sizes:
        if size > len(words):
            continue
        hashes, starts, _ = template.windows(size)
        for h in block.hits(hashes).tolist():
            value, p = hashes[h], int(starts[h])
            for k in range(np.searchsorted(block.hashes, value), np.searchsorted(block.hashes, value, "right")):
                shifts[int(block.item[k])].add(p - int(block.place[k]))
    out = []
    for i, lined in shifts.items():
        item_id, item_words, item = block.items[i]
        for pieces in _alignments(item, template, lined):
            found = _consistent(pieces, words, item_words, template, item, item_id)
            if found:
                out.append(found)
                break
    return sorted(out)


class Piece(NamedTuple):
    """Words start to end of the item that equal those of the text, ``shift`` words further on."""

    start: int
    end: int
    shift: int


def _pieces(item: Template, text: Template, shift: int) -> list[tuple[Piece, np.ndarray]]:
    """Runs of equal words at one difference of positions, with the count of words that stand as they are
    before each of their words."""
    a, b = max(0, -shift), min(len(item.word), len(text.word) - shift)
    if b <= a:
        return []
    same = item.word[a:b] == text.word[a + shift : b + shift]
    equal = same | (item.hashes[a:b] == text.hashes[a + shift : b + shift])
    ends = np.flatnonzero(np.diff(np.concatenate([[False], equal, [False]]).view(np.int8))).tolist()
    least = PIECE if len(item.word) > MIN_WORDS + 1 else 1  # with one edit, every other word of 9 counts
    runs = [(i, j) for i, j in zip(ends[::2], ends[1::2], strict=True) if j - i >= least]
    if not runs:
        return []
    counts = np.concatenate([[0], np.cumsum(same & (item.word[a:b] != _BARE))])
    return [(Piece(a + i, a + j, shift), counts[i : j + 1] - counts[i]) for i, j in runs]


def _alignments(item: Template, text: Template, shifts: set[int]) -> list[list[Piece]]:
    """Chains of runs, in order in the item and in the text, each within DRIFT of the one before: the one
    with most words, and the one that ends in the run with most words that stand as they are."""
    near = sorted({s + d for s in shifts for d in range(-DRIFT, DRIFT + 1)})
    runs = sorted((x for s in near for x in _pieces(item, text, s)), key=lambda x: (x[0].end, x[0].shift))
    by_shift: dict[int, list[int]] = defaultdict(list)
    best: list[tuple[int, int]] = []  # words that match and, again, those that stand; runs, fewer first
    before: list[tuple[int, int]] = []  # the run before, and where this one starts after it
    for k, (run, counts) in enumerate(runs):
        value, prior = (run.end - run.start + int(counts[-1]), 0), (-1, run.start)
        for s in range(run.shift - DRIFT, run.shift + DRIFT + 1):
            for j in by_shift.get(s, ()):
                start = max(run.start, runs[j][0].end + max(0, s - run.shift))
                if start < run.end:
                    gain = run.end - start + int(counts[-1] - counts[start - run.start])
                    other = (best[j][0] + gain, best[j][1] - 1)
                    if other > value:
                        value, prior = other, (j, start)
        by_shift[run.shift].append(k)
        best.append(value)
        before.append(prior)
    out = []
    first = lambda k: (-runs[k][0].shift, -k)
    most = max(range(len(runs)), key=lambda k: (best[k], first(k)), default=-1)
    longest = max(range(len(runs)), key=lambda k: (int(runs[k][1][-1]), best[k], first(k)), default=-1)
    for k in [most, longest] if most != longest else [most]:
        chain = []
        while k >= 0:
            j, start = before[k]
            chain.append(Piece(start, runs[k][0].end, runs[k][0].shift))
            k = j
        if chain:
            out.append(chain[::-1])
    return out


def _consistent(pieces, words, item_words, template, item, item_id) -> Leak | None:
    """The leak that an alignment gives. Windows count as matched where their slot values agree with the
    value most words give."""
    votes: dict[str, Counter] = defaultdict(Counter)
    filled = {}
    for start, end, shift in pieces:
        for q in (start + np.flatnonzero(item.slot[start:end] | template.slot[start + shift : end + shift])).tolist():
            a, b = filled[q] = _value(item_words[q]), _value(words[q + shift])
            votes[a][b] += 1
    chosen = {a: max(c.items(), key=lambda x: (x[1], x[0]))[0] for a, c in votes.items()}
    lost = {q for q, (a, b) in filled.items() if chosen[a] != b}
    contradicted = any(
        len(c.keys() - {a}) > 1 for a, c in votes.items() if len(a) > CHANCE_CHARS and a not in NUMBER_WORDS
    )
    n = len(item_words)
    good, stands = np.zeros(n, bool), np.zeros(n, bool)
    size, matched, longest, unbroken, places = min(WINDOW, n), 0, 0, 0, []
    for start, end, shift in pieces:
        good[start:end] = True
        stands[start:end] = (item.word[start:end] == template.word[start + shift : end + shift]) & (item.word[start:end] != _BARE)
        longest = max(longest, int(stands[start:end].sum()))
        if contradicted:
            gaps = np.flatnonzero(item.word[start:end] != template.word[start + shift : end + shift])
            unbroken = max(unbroken, int(np.diff(np.concatenate([[-1], gaps, [end - start]])).max()) - 1)
        places += [start + shift, end + shift]
        cuts = [start - 1, *sorted(q for q in lost if start <= q < end), end]
        matched += sum(max(0, j - i - size) for i, j in zip(cuts, cuts[1:], strict=False))
    covered, standing = int(good.sum()), int(stands.sum())
    if (item.slot | (item.word == _BARE)).all():
        own = [item_words[q] == words[q + shift] for start, end, shift in pieces for q in range(start, end)]
        covered = max(standing, sum(own))
    if contradicted:
        leaked = unbroken >= LONG_RUN or n > MIN_WORDS and standing >= MIN_COVERAGE * n
    elif n <= MIN_WORDS:
        leaked = covered == n
    else:
        leaked = covered >= MIN_COVERAGE * n or standing >= max(MIN_WORDS, MIN_PART * n) or longest >= LONG_RUN
    if not leaked:
        return None
    changed = sorted({(a, b) for a, b in filled.values() if a != b})
    slots = ",".join(f"{a}>{b}" for a, b in changed)
    return Leak(item_id, n - size + 1, matched, min(places), max(places), bool(changed), slots)


def blocks(benchmark: DataFrame) -> list[Block]:
    """The benchmark in blocks of at most BLOCK_WORDS words (a single longer item makes a block)."""
    items = benchmark.filter("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("bigint"), "text")
    words = items.agg(F.sum(F.size(F.split(F.col("text"), r"[\x20\x09-\x0D]+"))).alias("n")).first()["n"] or 0
    n = -(-words // BLOCK_WORDS) or 1
    # twice as many parts as needed keep uneven parts below the bound
    parts = n if n == 1 else 2 * n
    return [
        build_block([(r.item_id, r.text.encode()) for r in items.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k).collect()])
        for k in range(parts)
    ]


SCHEMA = (
    "doc_id bigint, item_id bigint, n_windows bigint, n_matched bigint, first_word bigint, end_word bigint, "
    "reparameterised boolean, slots string"
)


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and leaked item: (doc_id, item_id), windows of the item, matched windows, the
    words of the document from the first to the last that match, whether slots were re-parameterised and how.

    Null and empty texts leak nothing, on either side; a document without an id keeps its null. Repeated
    rows and items give repeated results; an empty table on either side gives none; other columns are not
    looked at. Of alignments that match equally well the one with the smallest shift is reported.
    """
    frame = documents.select(F.col("doc_id").cast("bigint"), "text")
    out = None
    for block in blocks(benchmark):
        shared = frame.sparkSession.sparkContext.broadcast(block)

        def make(shared=shared):
            forms = Forms()
            return lambda ids, texts: [
                (i, *leak) for i, t in zip(ids, texts, strict=True) for leak in find_leaks((t or b"").split(), forms, shared.value)
            ]

        found = map_rows(frame, SCHEMA, make)
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no item is found, with all their columns."""
    out = documents
    for block in blocks(benchmark):
        shared = documents.sparkSession.sparkContext.broadcast(block)

        def make(shared=shared):
            forms = Forms()
            return lambda text: not find_leaks((text or b"").split(), forms, shared.value)

        out = filter_rows(out, ["text"], make)
    return out


def op9_template_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
