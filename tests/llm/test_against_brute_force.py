"""Operators held against plain versions that follow the wording of their contract."""

import base64
import gzip
import hashlib
import itertools
import math
import random
import re
import time
import urllib.parse
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mendery.llm import decontamination, licenses, mixing, near_duplicates, private, quality, repeats, secrets, sharding, urls

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- op6


def test_shards_follow_the_law_key(spark, make_documents, prose):
    rows = [(i, " ".join(prose(5 + i % 7, i % 40))) for i in range(3000)]
    out = sharding.shard_documents(make_documents(rows), sharding.topology(8), sharding.topology(8, 1)).collect()
    texts = dict(rows)
    for r in out:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r.grown_shard in (r.shard, 8)
    counts = Counter(r.shard for r in out)
    assert set(counts) == set(range(8)) and all(300 < n < 450 for n in counts.values())
    assert 250 < sum(r.grown_shard == 8 for r in out) < 420
    for s in counts:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(counts[s]))


def test_draws_are_weighted_and_movement_stays_in_the_changed_subtree(spark):
    base = sharding.topology(8)
    heavier = [s._replace(weight=3.0) if hasattr(s, "_replace") else sharding.Shard(s.number, s.region, s.rack, 3.0 if s.number == 5 else 1.0) for s in base]
    ids = spark.range(20_000).selectExpr("cast(id AS string) AS k")
    out = ids.select(sharding.descend(ids.k, base).alias("a"), sharding.descend(ids.k, heavier).alias("b")).collect()
    moved = [r for r in out if r.a != r.b]
    assert moved
    # weight of shard 5 rose: documents come to its region, and inside it to its rack or shard; none go elsewhere
    assert all(r.b >= 4 for r in moved)
    assert all(r.b in (4, 5) for r in moved if r.a in (6, 7))
    assert all(r.b == 5 for r in moved if r.a == 4)
    share = sum(r.b == 5 for r in out) / len(out)
    assert abs(share - 3 / 10) < 0.02


# --- op2

SECRET = 'token = "abcdef123456"'


def plain_secrets(text):
    out = []
    for m in re.finditer(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), m.end(), "assign"))
    out += [(m.start(), m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[0], secrets.KINDS.index(s[2])))


PIECES = st.sampled_from(
    ["token", "PASSWORD", "api_key", "apikey", "Passwd", "ſecret", "secret", " ", "=", ":", '"', "'", "abc", "abcdef0", "0123456789abcdef", "AKIA", "ABCDEFGHIJKLMNOP", "é", "\n", "%41", "\\u0041", "%", "-", "x"]
)


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=25).map("".join))
def test_base_secrets(text):
    base, spans, _, _ = secrets.find_secrets(text)
    assert base == plain_secrets(text)
    assert set(base) <= set(spans)


@pytest.mark.parametrize(
    "wrap",
    [
        lambda s: base64.b64encode(s.encode()).decode(),
        lambda s: base64.urlsafe_b64encode(s.encode()).decode(),
        lambda s: urllib.parse.quote(s, safe=""),
        lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
        lambda s: base64.b64encode(gzip.compress(s.encode())).decode(),
        lambda s: base64.b64encode(zlib.compress(s.encode())).decode(),
    ],
)
def test_layers_of_layers(wrap):
    once = wrap(SECRET)
    for text, hidden in (
        (f"é x {once} y", once),
        ("z " + urllib.parse.quote(once, safe=""), urllib.parse.quote(once, safe="")),
        ("z " + base64.b64encode(once.encode()).decode(), base64.b64encode(once.encode()).decode()),
    ):
        base, spans, layers, _ = secrets.find_secrets(text)
        found = [s for s in spans if s not in base]
        assert base == [] and layers >= 1 and len(found) == 1
        start, end, kind = found[0]
        at = text.index(hidden)
        assert kind == "assign" and at <= start < end <= at + len(hidden)


def test_escapes_map_to_exact_spans_and_cycles_end():
    text = "a %74oken%3D%22abcdef1%22 b"
    _, spans, _, _ = secrets.find_secrets(text)
    assert [text[s:e] for s, e, _ in spans] == ["%74oken%3D%22abcdef1"]
    assert secrets.find_secrets("%25" * 2000)[1] == []
    assert secrets.find_secrets("QUFB" * 5000)[1] == []


def wrapped(raw, width, indent="", end="\n"):
    blob = base64.b64encode(raw).decode()
    return end.join(indent + blob[i : i + width] for i in range(0, len(blob), width))


@pytest.mark.parametrize("width", [64, 76])
@pytest.mark.parametrize("place", range(30, 100, 7))
def test_base64_goes_over_lines(width, place):
    lines = f"{'x' * place} {SECRET} and the rest of a letter that goes on for a while longer than one line".encode()
    for indent, end in (("", "\n"), ("    ", "\n"), ("", "\r\n")):
        for before, after in (("-----BEGIN X-----\n", "\n-----END X-----"), ("see ", "\nThanks\nall"), ("data: |\n", "\n")):
            blob = wrapped(lines, width, indent, end)
            text = before + blob + after
            spans = secrets.find_secrets(text)[1]
            raw = lambda s, e: base64.b64decode(re.sub(r"\s", "", text[s:e]) + "==")
            at = len(before)
            assert any(at <= s < e <= at + len(blob) and b"abcdef1234" in raw(s - len(re.sub(r"\s", "", text[at:s])) % 4, e) for s, e, _ in spans), (before, indent, end)


def noise(n):
    return "".join(random.Random(n).choices("ghijklmnopqrstuvwxyz ", k=n))


def test_wrapped_streams_and_all_members():
    packed = gzip.compress((noise(900) + SECRET + noise(900)).encode())
    text = "a mail\n\n" + wrapped(packed, 76) + "\n\nbye"
    assert secrets.find_secrets(text)[1] == [(8, len(text) - 5, "assign")]
    members = gzip.compress(noise(50).encode()) + gzip.compress(b"nothing") + gzip.compress(SECRET.encode())
    blob = base64.b64encode(members).decode()
    assert secrets.find_secrets(f"z {blob}")[1] == [(2, 2 + len(blob), "assign")]


@pytest.mark.parametrize("content", ["caf\xe9 {} caf\xe9".encode("latin-1"), b"\x00\x01\x02\xff{}\xfe\x03", b"\x81\x82\x83{}"])
@pytest.mark.parametrize("size", [0, 20 << 20])
def test_binary_data_around_a_secret_at_every_size(content, size):
    filler = b"a line of plain words\n" * (size // 22)
    packed = base64.b64encode(gzip.compress(filler + content.replace(b"{}", SECRET.encode()) + filler)).decode()
    _, spans, _, refused = secrets.find_secrets(f"z {packed}")
    assert (spans, refused) == ([(2, 2 + len(packed.rstrip("=")) + packed.count("="), "assign")], 0)


@pytest.mark.parametrize("wide", ["utf-8", "utf-16-le", "utf-16-be", "utf-16"])
@pytest.mark.parametrize("before", [b"", b"\xff", b"\x00\x9f", b"\xff\x00\xfe", b"\x00\x01\x02\xff"])
def test_text_in_binary_data_maps_to_its_characters(wide, before):
    head = before + "caf\xe9 ".encode(wide) + b"\xff\xff"
    raw = head + SECRET.encode(wide.replace("utf-16", "utf-16-le") if wide == "utf-16" else wide) + b"\xff\xff\xff"
    blob = base64.b64encode(raw).decode()
    size = len(SECRET[:-1]) * (1 if wide == "utf-8" else 2)  # the closing quote is no part of the secret
    expected = (2 + len(head) * 8 // 6, 2 + ((len(head) + size) * 8 - 1) // 6 + 1, "assign")
    assert secrets.find_secrets(f"z {blob}")[1] == [expected]


@pytest.mark.parametrize("place", [0, 8 << 20, 17 << 20])
def test_large_streams_are_scanned_whole(place):
    content = "a quiet line\n" * (18 << 20 >> 3)
    content = content[:place] + f"\n{SECRET}\n" + content[place : 18 << 20]
    for raw in (gzip.compress(content.encode()), gzip.compress(gzip.compress(content.encode()))):
        blob = base64.b64encode(raw).decode()
        _, spans, _, refused = secrets.find_secrets(f"z {blob}")
        assert spans == [(2, 2 + len(blob), "assign")] and refused == 0


# --- op8


def plain_private(text):
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
        if 12 <= len(digits) <= 19 and total % 10 == 0:
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], private.KINDS.index(s[2])))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a.b", "@", "mail", ".com", ".", "1", "255", "256", "0007", "+1", " ", "-", "(555)", "4111111111111111", "4111 1111 1111 1111", "555-0100", "x", "é", "\n", "%", "@@"]), max_size=20).map("".join))
def test_base_private(text):
    base, spans = private.find_private(text, private.FIXED)
    assert base == plain_private(text)
    assert [s for s in spans if s[2] != "entity"] == base


def test_labels_reach_distant_repeats():
    text = "write to jo.field7@mail.example.com today " + "and then more words " * 40 + "as jo.field7 said, JO.FIELD7 again, and other.thing5 not"
    base, spans = private.find_private(text, private.FIXED)
    found = [text[s:e] for s, e, k in spans if k == "entity"]
    assert [k for *_, k in base] == ["email"] and found == ["jo.field7", "JO.FIELD7"]


@pytest.mark.parametrize(
    "first, again",
    [
        ("4111 1111 1111 1111", "4111.1111.1111.1111"),
        ("4111111111111111", "4111 .1111. 1111 (1111)"),
        ("+1 555-867-5309", "(555) 867-5309"),
        ("+1 555-867-5309", "5558675309"),
    ],
)
def test_numbers_in_other_spacing_are_repeats(first, again):
    text = f"we have {first} on file and {'many more words ' * 30}then {again} was read out, not 12 or 867 or 1111"
    base, spans = private.find_private(text, private.FIXED)
    found = [text[s:e] for s, e, k in spans if k == "entity"]
    assert [text[s:e] for s, e, _ in base] == [first]
    assert "".join(c for f in found for c in f if c.isdigit()) == "".join(c for c in again if c.isdigit())


def test_messages_settle(monkeypatch):
    """Many links around: one more round than needed changes no belief."""
    text = " ".join(["mail ann.b77@mail.example.com", *(f"ann.b77 {i}234567 {i}234567" for i in range(9))] * 3)
    nodes = private.tokens(text, private.base_spans(text))
    settled = private.beliefs(nodes, private.FIXED)
    monkeypatch.setattr(private, "SETTLED", 0.0)
    assert np.abs(settled - private.beliefs(nodes, private.FIXED)).max() < 0.1


def test_messages_agree_with_enumeration():
    """On a tree of links loopy message passing is exact; compare signs with all labelings."""
    text = "call +1 555 0100 200 now 15550100200 later 15550100200 end 7777777"
    nodes = private.tokens(text, private.base_spans(text))
    weights = private.FIXED
    chain, skip = private.links(nodes)
    odds = private.beliefs(nodes, weights)
    best = np.zeros((len(nodes), 2))
    for labels in itertools.product((0, 1), repeat=len(nodes)):
        score = sum((private._OBSERVED if n.observed else sum(a * b for a, b in zip(weights.shape, n.shape, strict=True))) * y for n, y in zip(nodes, labels, strict=True))
        score += sum(weights.chain * (labels[i] == labels[j]) for i, j in chain) + sum(weights.skip * (labels[i] == labels[j]) for i, j in skip)
        for i, y in enumerate(labels):
            best[i, y] += math.exp(score)
    exact = np.log(best[:, 1] / best[:, 0])
    assert ((odds > 0) == (exact > 0)).all()


# --- op7


def test_base_counts(prose):
    rng = random.Random(5)
    for seed in range(60):
        words = prose(rng.randrange(0, 90), seed, vocabulary=rng.choice([3, 12, 3000]))
        text = "".join(w + rng.choice([" ", " ", "\n", "\t", "\x0b", "  ", " # ", "$|\n", "é "]) for w in words)
        found = WORDS.findall(text)
        lines = [x for x in text.split("\n") if WORDS.search(x)]
        runs = [tuple(found[i : i + 3]) for i in range(len(found) - 2)]
        often = Counter(runs)
        inside = {i + k for i, r in enumerate(runs) if often[r] > 1 for k in range(3)}
        got = quality.judge(text.encode(), quality.FIXED)
        assert got[:5] == (len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside))
        assert got[5] == (len(found) < 50 or 100 * len(inside) > 50 * len(found))


def test_viterbi_is_the_best_labeling():
    rng = np.random.default_rng(3)
    for _ in range(60):
        x = rng.normal(size=(7, len(quality.FEATURES)))
        field = quality.Field(rng.normal(size=len(quality.FEATURES)), rng.normal(size=(2, 2)))
        score = lambda y: sum(a @ field.line * b for a, b in zip(x, y, strict=True)) + sum(field.pair[a, b] for a, b in itertools.pairwise(y))  # noqa: E731,B023
        best = max(itertools.product((0, 1), repeat=7), key=score)
        assert abs(score(quality.viterbi(field, x).astype(int)) - score(best)) < 1e-9


def test_trained_field_on_held_out_lines(prose):
    def lines(n, bad, seed):
        rng = random.Random(seed)
        make = lambda k: "| ".join(prose(6, k)).upper() + " !!" if bad else " ".join(prose(10, k)).capitalize() + "."
        return "\n".join(make(rng.randrange(10**6)) for _ in range(n)).encode()

    sample = [(quality.read_lines(lines(8, i % 2 == 0, i)).features, i % 2 == 1) for i in range(40)]
    field = quality.train(sample)
    right = sum((quality.content_share(field, quality.read_lines(lines(9, bad, 1000 + i))) >= 0.5) != bad for i in range(30) for bad in (True, False))
    assert right >= 58


# --- op9


def test_leaks_and_slots(spark, make_documents, prose):
    items = [
        (1, "A train leaves Paris at 60 km per hour and reaches Rome after 12 hours with 60 people on board"),
        (2, " ".join(prose(30, 77))),
        (3, "what is it"),
    ]
    fill = lambda k: " ".join(prose(40, k))
    moved = "A train leaves Oslo at 75 km per hour and reaches Bern after 9 hours with 75 people on board"
    torn = "A train leaves Oslo at 75 km per hour and reaches Bern after 9 hours with 3 people on board"
    docs = [
        (1, f"{fill(1)}. {items[0][1]}. {fill(2)}"),
        (2, f"{fill(3)} {moved} {fill(4)}"),
        (3, fill(5)),
        (4, f"{fill(6)} {items[1][1]} {fill(7)}"),
        (5, f"{fill(8)} {' '.join(items[1][1].split()[:12])} {fill(9)}"),
        (6, f"{fill(10)} {torn} {fill(11)}"),
    ]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    out = {(r.doc_id, r.item_id): r for r in decontamination.leaks(make_documents(docs), bench).collect()}
    assert set(out) == {(1, 1), (2, 1), (4, 2)}  # 60 cannot stand for 75 and for 3
    assert not out[1, 1].reparameterised and out[2, 1].reparameterised
    assert out[2, 1].slots == "12>9,60>75,paris>oslo,rome>bern"


@pytest.mark.parametrize(
    "first, second, leaked",
    [("60", "60", True), ("75", "75", True), ("75", "3", False), ("60", "61", True), ("61", "60", True), ("12", "12", True), ("12", "61", False)],
)
def test_contradicting_slots_decide(prose, first, second, leaked):
    item = "A train leaves Paris at 60 km per hour and reaches Rome after 12 hours with 60 people on board"
    text = f"A train leaves Oslo at {first} km per hour and reaches Bern after 9 hours with {second} people on board"
    assert leaked_items(" ".join(prose(30, 1) + [text] + prose(30, 2)), [item]) == [0] * leaked


def test_contradicting_slots_of_mostly_verbatim_items(prose):
    words = prose(50, 500)
    words[5] = words[40] = "1850"
    other = words[:5] + ["1860"] + words[6:40] + ["1870"] + words[41:]
    fill = lambda t: " ".join(prose(30, 1) + t + prose(30, 2))
    assert leaked_items(fill(other), [" ".join(words)]) == [0]
    assert leaked_items(fill(other[:30]), [" ".join(words)]) == [0]


def test_blocks_of_the_benchmark_give_the_same(spark, make_documents, prose, monkeypatch):
    items = [(i, " ".join(prose(20, 100 + i))) for i in range(30)]
    docs = [(i, " ".join(prose(30, i)) + " " + items[i][1] + " " + " ".join(prose(30, 900 + i))) for i in range(0, 30, 3)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    whole = sorted(map(tuple, decontamination.leaks(make_documents(docs), bench).collect()))
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 200)
    assert len(decontamination.blocks(bench)) > 2
    assert sorted(map(tuple, decontamination.leaks(make_documents(docs), bench).collect())) == whole
    assert [r[:2] for r in whole] == [(i, i) for i, _ in docs]


def leaked_items(text, items):
    block = decontamination.build_block([(i, t.encode()) for i, t in enumerate(items)])
    return [x.item_id for x in decontamination.find_leaks(text.encode().split(), decontamination.Forms(), block)]


@pytest.mark.parametrize("n", [9, 10, 15, 28])
def test_items_with_one_edit_are_leaks(prose, n):
    words = prose(n, 300 + n)
    for i in range(n):
        for edited in (words[:i] + ["other"] + words[i + 1 :], words[:i] + words[i + 1 :], words[:i] + ["other"] + words[i:]):
            text = " ".join(prose(40, i) + edited + prose(40, 90 + i))
            assert leaked_items(text, [" ".join(words)]) == [0], (i, edited)


def test_long_passages_of_items_are_leaks(prose):
    words = prose(59, 400)
    spread = [w if i % 14 else "other" for i, w in enumerate(words)]
    for passage, leaked in ((words[10:50], True), (words[20:35], True), (words[20:34], False), (spread, True), (words[::-1], False)):
        text = " ".join(prose(40, 5) + passage + prose(40, 6))
        assert leaked_items(text, [" ".join(words)]) == [0] * leaked, passage
    assert leaked_items(" ".join(prose(5000, 7)), [" ".join(words)]) == []


def test_numbers_alone_are_no_passage():
    row = lambda k: " ".join(str(k + 7 * i) for i in range(20))
    item = f"which of these numbers is the largest one that three divides {row(100)} and why would that hold for every other row of it"
    assert leaked_items(f"a table of it {row(5)} and so on", [item]) == []


def test_equal_values_of_slots_are_no_conflict(prose):
    item = "Tom has 3 apples and 5 pears how many fruits does he have in all"
    same = "Sam has 8 coins and 8 stamps so which of them are more"
    around = lambda t: f"{' '.join(prose(30, 1))} {t} {' '.join(prose(30, 2))}"
    assert leaked_items(around(item.replace("3", "7").replace("5", "7")), [item]) == [0]
    assert leaked_items(around(same.replace("8", "2", 1).replace("8", "9")), [same]) == [0]
    few = "3 m by 5 m by 7 m by 9 m is how much"
    assert leaked_items(around("6 m by 6 m by 6 m by 6 m is how much"), [few]) == [0]
    assert leaked_items(around("sum 6 6 6 6 with 6 6 6 6"), ["sum 3 5 7 9 with 11 13 15 17"]) == [0]


def test_short_items_inside_texts(prose):
    around = lambda t: f"{' '.join(prose(30, 1))} {t} {' '.join(prose(30, 2))}"
    assert leaked_items(around("what is it"), ["what is it", "what was it", "is it", "12 13"]) == [0, 2]
    assert leaked_items(around("add 7 to 9"), ["add 2 to 3", "12 13"]) == [0]
    assert leaked_items(around("12 13"), ["12 13", "12 14"]) == [0]


# --- op10


@pytest.mark.parametrize("name", licenses.TEMPLATES)
def test_each_template_is_its_own_winner(name):
    text = "some words before. " + licenses.TEMPLATES[name] + " And words after it."
    _, found = licenses.find_licenses(text)
    assert [f.license for f in found][:1] == [name]
    start, end = found[0].start, found[0].end
    assert licenses.TEMPLATES[name][:20] in text[start:end] and found[0].saved > 0


def test_wording_decides():
    assert licenses.find_licenses("This work is licensed under the GNU General Public License, version 4.")[1] == []
    assert licenses.find_licenses("Not released under the license of kings.")[1] == []
    found = licenses.find_licenses("This whole work is licensed under the GNU General Public License, version 3.")[1]
    assert [(f.license, f.differences) for f in found] == [("GPL-3.0", "-+whole")]
    assert licenses.find_licenses("nothing of the kind here") == (0, [])


# --- op1


@pytest.mark.parametrize("first", licenses.TEMPLATES)
def test_all_licenses_of_a_block_with_their_own_spans(first):
    rng, pieces, expected = random.Random(first), [], []
    for name in [first, *rng.choices(list(licenses.TEMPLATES), k=6)]:
        wording = licenses.TEMPLATES[name]
        at = sum(map(len, pieces))
        end = at + len(re.sub(r"[^A-Za-z0-9]+$", "", wording))
        expected.append((at + len(wording) - len(wording.lstrip('"')), end, name))
        pieces.append(wording + rng.choice([" ", "\n", "\n\n\n", " It holds. "]))
    _, found = licenses.find_licenses("".join(pieces))
    assert [(f.start, f.end, f.license) for f in found] == expected


def test_long_blocks_take_time_in_proportion():
    def seconds(n):
        text = "A license of another kind holds for the work under version seven of it. " * n + licenses.TEMPLATES["MIT"]
        started = time.process_time()
        assert [f.license for f in licenses.find_licenses(text)[1]] == ["MIT"]
        return time.process_time() - started

    seconds(10)
    assert seconds(8000) < 8 * max(seconds(2000), 0.05)



def test_raking_meets_margins_and_limits():
    rng = np.random.default_rng(1)
    observed = rng.integers(50, 5000, size=(4, 3, 5)).astype(float)
    margins = [np.array([0.3, 0.2, 0.3, 0.2]), np.array([0.5, 0.3, 0.2]), np.full(5, 0.2)]
    budget = 0.2 * observed.sum()
    x = mixing.rake(observed, margins, budget)
    for axis, m in enumerate(margins):
        assert np.allclose(x.sum(axis=tuple(i for i in range(3) if i != axis)) / budget, m, atol=1e-6)
    assert (x <= observed + 1e-9).all()
    # plain proportional fitting, cell by cell
    y = observed * (budget / observed.sum())
    for _ in range(500):
        for axis, m in enumerate(margins):
            for k in range(len(m)):
                part = [slice(None)] * 3
                part[axis] = k
                y[tuple(part)] *= m[k] * budget / y[tuple(part)].sum()
    assert np.allclose(x, y, rtol=1e-5)
    assert mixing.rake(np.zeros((2, 2, 2)), [np.ones(2) / 2] * 3, 5.0).sum() == 0


def test_mixture_against_plain_version(make_documents, prose):
    rng = random.Random(9)
    rows = [(i, " ".join(prose(rng.randrange(5, 60), i)), rng.choice(["src0", "src0", "src1", "src9"]), rng.choice(["en", "en", "de", "xx", None])) for i in range(600)]
    targets = mixing.Targets({"src0": 0.3, "src1": 0.3}, {"en": 0.5, "de": 0.3}, keep=0.4)
    d = make_documents(rows)
    mix = mixing.calibrate(d, targets)
    out = {r.doc_id: r for r in mixing.mix_plan(d, mix).collect()}
    counts = {i: mixing.group_counts(t.encode().split(), mixing.Groups()) for i, t, *_ in rows}
    shares = sum(counts.values()) / sum(c.sum() for c in counts.values())
    observed = defaultdict(int)
    for i, t, s, g in rows:
        cell = (s if s in targets.source else "other", g if g in targets.lang else "other", mixing.topic_of(counts[i], shares))
        assert (out[i].source, out[i].lang, out[i].topic, out[i].tokens) == (*cell, len(t.split()))
        observed[cell] += len(t.split())
    for (s, g, k), n in observed.items():
        assert mix.observed[mix.sources.index(s), mix.langs.index(g), k] == n
    assert all(r.selected == (mixing.draw(i, None) < r.probability) for i, r in out.items())
    expected = sum(r.probability * r.tokens for r in out.values())
    assert abs(expected - 0.4 * sum(r.tokens for r in out.values())) < 0.02 * expected
    assert {r.doc_id for r in mixing.sample(d, mix).collect()} == {i for i, r in out.items() if r.selected}


# --- op4


def test_splits_are_the_most_probable():
    counts = Counter({"cheap": 50, "pills": 40, "pill": 30, "che": 5, "apple": 9, "a": 100, "the": 300, "rapist": 2, "therapist": 6, "s": 4})
    total = sum(counts.values())

    def cost(words):
        return sum(math.log(counts[w] / total) if counts[w] else math.log(0.1 / total) - len(w) * math.log(10) for w in words)

    def all_splits(run):
        if not run:
            yield []
        for k in range(1, len(run) + 1):
            for rest in all_splits(run[k:]):
                yield [run[:k], *rest]

    for run in ("cheappills", "therapist", "theapple", "apillsa", "xqz", "thexa"):
        known = {(i, k): counts[run[i : i + k]] for i in range(len(run)) for k in range(1, len(run) - i + 1) if run[i : i + k] in counts}
        got = urls.split_run(run, known, total)
        assert "".join(got) == run
        assert abs(cost(got) - max(map(cost, all_splits(run)))) < 1e-9


@pytest.mark.parametrize("length", [19, 20, 21, 34, 400])
def test_words_and_unknown_runs_of_any_length(spark, length):
    long, odd = "".join(random.Random(length).choices("bcdfg", k=length)), "z" * length
    pages = spark.createDataFrame([(f"<p>{long} apple {long} pie apple</p>".encode(),)], "html binary")
    runs = spark.createDataFrame([(r,) for r in (f"apple{long}pie", odd, f"apple{odd}", f"{long[:-1]}pie")], "run string")
    got = dict(urls.split_runs(runs, urls.word_counts(pages)).collect())
    assert got == {f"apple{long}pie": ["apple", long, "pie"], odd: [odd], f"apple{odd}": ["apple", odd], f"{long[:-1]}pie": [long[:-1], "pie"]}


def test_rules_and_model(spark):
    html = "<html><body>" + "cheap pills news daily report " * 20 + "</body></html>"
    rows = [
        (1, "http://www.EXAMPLE.com/en/1", html, "allow", "www.example.com/en/"),
        (2, "https://blog.example.com/en/x?q=1", html, "block", "example.com/en/"),
        (3, "https://blog.example.com/fr/x", html, "allow", "com/"),
        (4, "https://cheappills.net/fr/x#f", html, "block", "net/fr/"),
        (5, "https://dailynews.com/a", html, "allow", "com/"),
        (6, "https://pillscheap.org/a", html, "block", None),
        (7, "https://newsdaily.org/a", html, "allow", None),
        (8, "https://com", html, "allow", None),
        (9, "https://xcom/", html, "allow", None),
        (10, "ftp://a.net/es", html, "allow", None),
        (11, "ftp://a.net/es/?x", html, "block", "net/es/"),
    ]
    d = spark.createDataFrame([r[:3] for r in rows], "page_id bigint, url string, html string")
    out = {r.page_id: r for r in urls.judge_pages(d).collect()}
    assert {i: out[i].rule for i in out} == {r[0]: r[4] for r in rows}
    assert {i: out[i].verdict for i in (1, 2, 3, 4, 5, 6, 7, 11)} == {r[0]: r[3] for r in rows if r[0] in (1, 2, 3, 4, 5, 6, 7, 11)}
    assert (out[2].host, out[2].path) == ("blog.example.com", "/en/x")
    assert (out[1].host, out[8].path, out[11].path) == ("www.example.com", "", "/es/")


# --- op3


def plain_repeats(rows, window=50):
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = WORDS.findall(t or "")
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = []
    for i, t in rows:
        w = WORDS.findall(t or "")
        gone = [False] * len(w)
        if i is not None:
            for k in range(len(w) - window + 1):
                if first[tuple(w[k : k + window])] < i:
                    gone[k : k + window] = [True] * window
        out.append((str(i), len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return sorted(out)


def repeating_rows(prose):
    passage, other = prose(75, 500), prose(140, 501)
    rows = []
    for i in range(60):
        w = prose(60 + i, i)
        if i % 3 == 0:
            w[20:20] = passage
        if i % 7 == 0:
            w += other[i % 40 : 100 + i % 30]
        rows.append((i, " ".join(w)))
    rows += [(100 + i, rows[9][1]) for i in range(5)]  # copies
    rows += [(200, "a b " * 300), (201, "a b " * 90 + "c"), (202, " ".join(passage[:50])), (203, " ".join(passage[:49]))]
    rows += [(300, None), (301, ""), (None, rows[3][1]), (9, rows[9][1]), (302, rows[4][1].replace(" ", "\n\t", 9))]
    return rows


@pytest.mark.parametrize("group", [256, 3])
def test_repeats_are_those_of_all_windows(make_documents, prose, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)  # 3: nearly all prefixes are lengthened to whole windows
    rows = repeating_rows(prose)
    out = repeats.dedup_report(make_documents(rows)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in out) == plain_repeats(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=0, max_size=220))
def test_stretches_cover_all_windows_once(letters):
    words = [b"xyz"[k : k + 1] for k in letters]
    least = repeats.anchors(repeats.Words().hashes(words))
    assert len(least) == max(0, len(words) - repeats.WINDOW + 1)
    starts, ends = repeats.stretches(least)
    assert [p for s, e in zip(starts, ends, strict=True) for p in range(s, e)] == list(range(len(least)))
    same = {}
    for p in range(len(least)):  # equal windows have equal anchors
        assert same.setdefault(tuple(words[p : p + repeats.WINDOW]), least[p]) == least[p]


# --- op5


def plain_classes(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    top = {i: i for i in sets}

    def root(n):
        while top[n] != n:
            n = top[n]
        return n

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            x, y = root(a), root(b)
            top[max(x, y)] = min(x, y)
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def near_rows(prose):
    rng, rows = random.Random(4), []
    for g in range(25):
        base = prose(rng.randrange(8, 200), 3000 + g)
        for c in range(rng.choice([1, 2, 6])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                w[rng.randrange(len(w))] = f"new{rng.randrange(99)}"
            rows.append((len(rows), " ".join(w).upper() if c % 2 else " ".join(w)))
    return rows + [(900, None), (901, ""), (902, "One two"), (903, "one TWO"), (904, "one"), (905, "É é"), (906, "é é")]


@pytest.mark.parametrize("kind", [near_duplicates.CONTRACT, near_duplicates.PIPELINE])
def test_classes_of_all_links(make_documents, prose, kind):
    rows = near_rows(prose)
    out = near_duplicates.near_duplicate_report(make_documents(rows), kind).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out} == plain_classes(rows, *kind)


def test_crowded_nodes(make_documents, prose, monkeypatch):
    """Many near copies of two related texts, with nodes of at most 6 documents: blocks and open documents."""
    monkeypatch.setattr(near_duplicates, "NODE", 6)
    rng, rows = random.Random(8), []
    base = prose(150, 1)
    for i in range(90):
        w = list(base)
        if i % 2:
            w[:12] = prose(12, 2)
        for _ in range(rng.choice([0, 1, 2, 3])):
            w[rng.randrange(20, 150)] = f"n{i}x{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    for kind in (near_duplicates.CONTRACT, near_duplicates.Similarity(3, 93)):
        out = near_duplicates.near_duplicate_report(make_documents(rows), kind).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out} == plain_classes(rows, *kind)


def test_components_of_a_long_chain(spark):
    from mendery.llm.components import components

    order = list(range(40))
    random.Random(2).shuffle(order)
    links = [(min(a, b), max(a, b)) for a, b in itertools.pairwise(order)] + [(100, 101), (101, 102)]
    out = {r.id: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert out == {**dict.fromkeys(range(40), 0), 100: 100, 101: 100, 102: 100}
