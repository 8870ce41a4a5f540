"""Bit-plane clusters, lookup fingerprints and mined phrases against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mendery.llm import bitplanes, collocations, fingerprints

# ------------------------------------------------------------------------------- bit planes


@pytest.mark.parametrize("size", [3, 2**20, 2**40, 2**70])
def test_popcounts_give_exact_products(size):
    rng = random.Random(size)
    make = lambda n: np.array([[rng.randint(-size, size - 1) for _ in range(64)] for _ in range(n)], object)
    rows, other = make(5), make(1)
    width = int(bitplanes.width_of(rows).max())
    narrow = rows.astype(np.int64) if size < 2**62 else rows
    planes = bitplanes.pack(narrow, width)
    assert [bitplanes.whole(p) for p in planes] == rows.tolist()
    c = bitplanes.pack(other, int(bitplanes.width_of(other).max()))[0]
    assert bitplanes.dots(planes, c).tolist() == [int(sum(a * b for a, b in zip(r, other[0], strict=True))) for r in rows]
    best, distance = bitplanes.Centroids(rows.tolist()).nearest(planes)
    assert best.tolist() == list(range(5)) and distance.tolist() == [0] * 5


def plain_clusters(vectors, k, rounds):
    kept = []
    for vec_id, v in vectors:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, [math.floor(64 * x) for x in v]))
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        own = [[v for _, v in kept if near(v)[1] == i] for i in range(len(centroids))]
        centroids = [[sum(x) // len(vs) for x in zip(*vs, strict=True)] if vs else c for vs, c in zip(own, centroids, strict=True)]
    found = [(i, *near(v)) for i, v in kept]
    sums = Counter()
    for _, d, c in found:
        sums[c] += d
    text = lambda c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
    return sorted(((i, c, d, sums[c], sum(sums.values()), text(c)) for i, d, c in found), key=str)


def rows_of(frame, *names):
    return sorted((tuple(r) for r in frame.select(*names).collect()), key=str)


VECTORS = "vec_id bigint, embedding array<float>, label string, cluster string, number string, planes string"
CLUSTERED = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@pytest.mark.parametrize("n", [3, 60])
def test_clusters(spark, n):
    rng = random.Random(n)
    vectors = [(i, [float(np.float32(rng.gauss(0, 1))) for _ in range(64)]) for i in range(n)]
    vectors += [vectors[0], (None, [0.5] * 64), (77, None), (78, [1.0] * 63), (79, [None] + [1.0] * 63), (80, [float("nan")] * 64), (81, [float("inf")] * 64), (82, [])]
    frame = spark.createDataFrame([(*v, "x", "x", "x", "x") for v in vectors], VECTORS).repartition(3)
    got = bitplanes.cluster(frame)
    assert rows_of(got, *CLUSTERED) == plain_clusters(vectors, 16, 3)


def test_clusters_of_wide_and_of_no_vectors(spark):
    assert bitplanes.cluster(spark.createDataFrame([], VECTORS)).collect() == []
    wide = [(1, [1e30] * 64), (2, [-1e30] * 64), (3, [1e30] * 63 + [0.0]), (4, [0.25] * 64)]
    frame = spark.createDataFrame([(*v, "x", "x", "x", "x") for v in wide], VECTORS)
    got = {r.vec_id: r for r in bitplanes.cluster(frame, bitplanes.Clustering(centroids=2)).collect()}
    want = {r[0]: r for r in plain_clusters([(i, [float(np.float32(x)) for x in v]) for i, v in wide], 2, 3)}
    for i, r in got.items():
        assert (r.cluster, r.centroid_sha256) == (want[i][1], want[i][5])
        assert r.distance == (want[i][2] if want[i][2] < 2**63 else None) and r.inertia is None


# ------------------------------------------------------------------------------- fingerprints

BLANK = " \t\n\x0b\x0c\r"


def plain_paragraphs(text):
    out = set()
    for line in text.split("\n"):
        for words in [re.findall(rf"[^{BLANK}]+[{BLANK}]*", line)]:
            out |= {"".join(words[i : i + 32]).rstrip(BLANK) for i in range(0, len(words), 32)}
    return out


def plain_fingerprints(rows):
    texts = sorted({(i is None, i or 0, hashlib.sha256((t or "").encode()).hexdigest(), t or "") for i, t in rows})
    out = {}
    for at, (none, i, _, text) in enumerate(texts):
        after = texts[(at + 1) % len(texts)][3]
        take = len(text) // 4
        edited = text[: len(text) - take] + after[:take]
        a = plain_paragraphs(text)
        like = lambda b, a=a: len(a & b) / len(a | b) if a | b else 1.0
        out[None if none else i, text] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), like(plain_paragraphs(edited)), like(plain_paragraphs(after)), len(a))
    return sorted(((i, *out[i, t or ""]) for i, t in rows), key=str)


PRINTED = ["doc_id", "n_chars", "edited_sha256", "near_edited", "near_next", "n_paragraphs"]


def test_fingerprints(make_documents, odd_rows, prose):
    lines = ["\n".join(" ".join(prose(9, 31 * k + i)) for i in range(120)) for k in range(2)]
    rows = [r[:2] for r in odd_rows] + [(20, lines[0]), (21, lines[0] + "\nmore of it"), (22, lines[1]), (23, "\n".join(lines)), (20, lines[0]), (24, lines[0])]
    got = fingerprints.fingerprints(make_documents(rows)).cache()
    assert rows_of(got, *PRINTED) == plain_fingerprints(rows)
    assert got.agg(F.max("retries")).first()[0] >= 2
    prints = {}
    for r in got.collect():
        prints.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert prints[20] == prints[24] and len(prints[20]) == 1 and prints[20] != prints[21]


def test_fingerprints_of_few_documents(make_documents):
    assert fingerprints.fingerprints(make_documents([])).collect() == []
    one = [(3, "a b c d\ne f")]
    assert rows_of(fingerprints.fingerprints(make_documents(one)), *PRINTED) == plain_fingerprints(one)


def test_differing_digests_are_recovered(spark):
    rng = random.Random(5)
    digests = lambda n: [rng.getrandbits(60) for _ in range(n)]
    common = digests(300)
    pairs = {}
    for k, (here, there) in enumerate([(0, 0), (1, 0), (3, 2), (40, 1), (0, 500), (400, 400)]):
        pairs[str(k)] = (common + digests(here), common + digests(there))
    frame = spark.createDataFrame([(k.encode(), "x", *p) for k, p in pairs.items()], "key binary, kind string, here array<bigint>, there array<bigint>")
    found = {k: (set(), set()) for k in pairs}
    for r in fingerprints.differences(frame).collect():
        found[bytes(r.key).decode()][0].update(r.only_here)
        found[bytes(r.key).decode()][1].update(r.only_there)
    assert found == {k: (set(a) - set(b), set(b) - set(a)) for k, (a, b) in pairs.items()}


# ------------------------------------------------------------------------------- collocations


def plain_collocations(rows, support, covered=80, top=2000):
    count, total = Counter(), Counter()
    for text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            total[lang or "und"] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    count[lang or "und", tuple(words[i : i + k])] += 1
    candidates = {key: a for key, a in count.items() if len(key[1]) > 1 and a >= support}
    dropped = set()
    for (lang, p), a in candidates.items():
        for w in range(2, len(p)):
            for i in range(len(p) - w + 1):
                if 100 * a >= covered * candidates[lang, p[i : i + w]]:
                    dropped.add((lang, p[i : i + w]))
    out = {}
    for (lang, p), a in candidates.items():
        if (lang, p) not in dropped:
            cuts = [(2000000 * a // (count[lang, p[:k]] + count[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), count[lang, p[:k]], count[lang, p[k:]], score, a))
    return sorted(
        ((lang, n + 1, p.decode(), a, left, right, total[lang], score) for lang, found in out.items() for n, (_, _, p, left, right, score, a) in enumerate(sorted(found)[:top])),
        key=str,
    )


MINED = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def babble(seed, n, words=14):
    rng = random.Random(seed)
    vocabulary = ["a", "Be", "ça", "de\x00e", "éÉ", "F g", "h ", "Ij", "k-l", "MN", "o", "p", "q", "r"][:words]
    return "".join(rng.choice(vocabulary) + rng.choice([" "] * 9 + ["\t ", ". ", ",", "\n", "\x0b"]) for _ in range(n))


@pytest.mark.parametrize("slice_bytes", [40, 4 << 20])
def test_collocations(make_documents, odd_rows, monkeypatch, slice_bytes):
    monkeypatch.setattr(collocations, "SLICE", slice_bytes)
    rows = [*odd_rows, *[(100 + i, babble(i, 150), "s", ["en", None, "und", "fr"][i % 4]) for i in range(16)]]
    full = [(r[1], r[3] if len(r) > 2 else "en") for r in rows]
    for support, shards in ((3, 2), (7, 8), (30, 8)):
        options = collocations.Mining(support=support, shards=shards, top=40)
        got = collocations.collocations(make_documents(rows).repartition(3), options)
        assert rows_of(got, *MINED) == plain_collocations(full, support, top=40)


def one_of_each_shard(spark, options):
    """A doc_id of every shard."""
    ids = spark.range(200).selectExpr(f"id * {collocations.NEIGHBOURS} AS doc_id", "xxhash64(id) AS h").collect()
    return list({r.h % options.shards: r.doc_id for r in ids}.values())


def test_a_longer_phrase_counts_where_its_pairs_are_rare(spark, make_documents):
    options = collocations.Mining()
    ids = one_of_each_shard(spark, options)
    assert len(ids) == options.shards
    rows = [(i, "a b c. " * (2 if i == ids[0] else 4)) for i in ids]  # 30 in all, 2 in one shard
    got = collocations.collocations(make_documents(rows), options)
    assert rows_of(got, *MINED) == plain_collocations([(text, "en") for _, text in rows], 30) == [("en", 1, "a b c", 30, 30, 30, 90, 1000000)]


def test_collocations_over_many_shards(make_documents, monkeypatch):
    monkeypatch.setattr(collocations, "NEIGHBOURS", 1)
    rows = [(i, babble(i, 90, words=9), "s", ["en", None, "und", "fr"][i % 4]) for i in range(40)]
    full = [(r[1], r[3]) for r in rows]
    for support, shards in ((30, 8), (9, 3)):
        options = collocations.Mining(support=support, shards=shards)
        got = collocations.collocations(make_documents(rows).repartition(3), options)
        assert rows_of(got, *MINED) == plain_collocations(full, support)


@pytest.mark.parametrize("block", [8, 64, 1 << 18])
def test_hashes_of_words_do_not_depend_on_their_place(monkeypatch, block):
    monkeypatch.setattr(collocations, "_BLOCK", block)
    monkeypatch.setattr(collocations, "_POWERS", collocations._POWERS[: block + 1])
    monkeypatch.setattr(collocations, "_BACKS", collocations._BACKS[: block + 1])
    rng = random.Random(5)
    words = ["".join(rng.choice("abé\x00") for _ in range(rng.randint(1, 40))) for _ in range(300)]
    parts = [(" ".join(rng.choice(words) for _ in range(200)).encode(), 0, i % 3, b"en") for i in range(9)]
    stream = collocations.Stream([*parts, (b"", 0, 0, b"fr"), (b" \n  " + parts[0][0] + b" ", 0, 1, b"en")])
    texts = stream.coded().to_pylist()
    assert b"".join(texts).decode().split() == b" ".join(p + b" \r" for p, *_ in [*parts, (b"\n " + parts[0][0],)]).decode().replace("\r", "").split()
    found = dict(zip(texts, stream.word.tolist(), strict=True))
    assert [found[t] for t in texts] == stream.word.tolist() and len(set(found.values())) == len(found)


def test_long_words_and_many_languages_are_counted_in_parts(monkeypatch):
    for name, value in (("SLICE", 40), ("RUN", 300), ("SENT", 2), ("SENT_BYTES", 60), ("NAMED", 50)):
        monkeypatch.setattr(collocations, name, value)
    rows = [(f"{'x' * 50} y{'z' * (i % 3)} x\ty. Q q Q! " + babble(i, 30, words=6), f"l{i % 5}") for i in range(40)]
    columns = [pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([0] * len(rows), pa.int32())]
    named, got, sent, largest = collocations.Named(), Counter(), 0, 0
    for stream in collocations.streams(iter(pa.Table.from_arrays(columns, names=["text", "lang", "shard"]).to_batches(max_chunksize=7))):
        named.add(stream, {k: np.flatnonzero(stream.fresh(k)) for k in range(1, 5)})
        if named.full():
            sent += 1
            for batch in named.take():
                largest = max(largest, batch.num_rows)
                for r in batch.to_pylist():
                    got[r["lang"], r["words"]] += r["n"]
    for batch in named.take():
        for r in batch.to_pylist():
            got[r["lang"], r["words"]] += r["n"]
    want = Counter()
    for text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            want.update((lang, " ".join(words[i : i + k])) for k in range(1, 5) for i in range(len(words) - k + 1))
    assert got == want and sent > 5 and largest == 2


def test_what_a_shard_finds_frequent_is_counted_exactly(make_documents, monkeypatch):
    given, make = [], collocations.bit_table

    def table(spark, phrases):
        given.append(phrases.distinct().count())
        return make(spark, phrases)

    monkeypatch.setattr(collocations, "bit_table", table)
    phrases, totals = collocations.mine(make_documents([(1, "x y z. " * 4), (2, "p q. " * 3)]), collocations.Mining())
    assert given == [5, 6]  # x, y, z, x y, y z; then x y z, too: four times in a shard, whatever their sums
    assert phrases.count() == 0 and [r.total for r in totals.collect()] == [18]


def test_long_texts_are_cut_between_words():
    rng = random.Random(1)
    text = "".join(rng.choice("ab  \n") for _ in range(3000)).encode() + b"c" * 500 + b" d e"
    for size in (7, 64, 10_000):
        collocations.SLICE, old = size, collocations.SLICE
        try:
            grams = Counter()
            for tokens, carried in collocations.slices(text):
                for k in range(1, 5):
                    grams.update(tuple(tokens[i : i + k]) for i in range(len(tokens) - k + 1) if i + k > carried and b"\n" not in tokens[i : i + k])
        finally:
            collocations.SLICE = old
        want = Counter()
        for piece in text.split(b"\n"):
            words = piece.split()
            for k in range(1, 5):
                want.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
        assert grams == want


def test_no_collocations(make_documents):
    assert collocations.collocations(make_documents([])).collect() == []
    assert collocations.collocations(make_documents([(1, None), (2, "one. two, three"), (3, "")])).collect() == []


def test_bit_table_holds_what_it_was_given(spark):
    rng = np.random.default_rng(3)
    h = rng.integers(-(2**63), 2**63 - 1, 5000, dtype=np.int64)
    shard = rng.integers(0, 8, 5000)
    bits = collocations.bit_table(spark, spark.createDataFrame(list(zip(shard.tolist(), h.tolist(), strict=True)), "shard int, h bigint")).value
    assert collocations.in_table(bits, h.view(np.uint64), shard).all()
    assert collocations.in_table(bits, rng.integers(0, 2**63 - 1, 5000).astype(np.uint64), shard).mean() < 0.01
