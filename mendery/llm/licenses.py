"""License scans by conditional compression.

Sentences with a cue word, and those between and beside them, make the candidate blocks of a document. Each
block is compressed with zstandard alone and with each template as a raw dictionary; templates are ranked by
how many bytes they save. The winner is confirmed by its exact differences in wording: the template's words
must stand in a window of the block in order, all but a small share of them, and no word that tells licenses
apart (numbers, versions, "not", "commercial" ...) may differ. If it fails, the next template in rank is tried.
All places where the winner stands are findings, each with the span of its own words. What lies between them
is ranked again in the same way, until no template fits, so a block may hold any number of licenses.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendery.llm.common import map_rows, table

# Wordings of public licenses and the usual one-line statements.
TEMPLATES = {
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
        'on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for '
        "the specific language governing permissions and limitations under the License."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "BSD-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:"
    ),
    "MPL-2.0": "Licensed under the Mozilla Public License, version 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC0-1.0": "Released into the public domain under CC0 1.0.",
}
_WORD = re.compile(r"[A-Za-z0-9]+(?:\.[0-9]+)*")
MIN_MATCHED = 0.85  # of a template's words

# Wordings made by rule: the identifier line of each license, and the other usual verb before a name that is so
# short that the verb is more than a small share of the wording.
_NAMES = [n for n in TEMPLATES if not n.endswith(("-text", "-header"))]
_VERBS = ("Licensed under", "Released under")
TEMPLATES |= {f"{n}-spdx": f"SPDX-License-Identifier: {n}" for n in _NAMES}
TEMPLATES |= {
    f"{n}-{verb.split()[0].lower()}": TEMPLATES[n].replace(other, verb)
    for n in _NAMES
    for verb, other in (_VERBS, _VERBS[::-1])
    if TEMPLATES[n].startswith(other) and 1 - 1 / len(_WORD.findall(TEMPLATES[n])) < MIN_MATCHED
}
TELLING = frozenset(
    "not no non commercial noncommercial nc nd sa by zero cc0 lesser affero lgpl agpl gpl mit bsd apache mozilla unless without".split()
)
_CUES = ("licen", "copyright", "permission", "warrant", "spdx", "public domain", "creative commons", "cc by", "cc0", "redistribut")
_CUE = re.compile("|".join(map(re.escape, _CUES)))
_SENTENCE_END = re.compile(r"\n|[.!?] ")

GAP = 1  # sentences without a cue that a block may bridge
LEVEL = 9


class Finding(NamedTuple):
    start: int  # of the license's own words
    end: int
    license: str
    saved: int  # bytes that the template saves on the stretch it was ranked for
    share: float  # of the stretch's compressed size
    differences: str


def sentences(text: str) -> tuple[list[int], list[int]]:
    """Where sentences start and where they end: at line ends and after closed sentences."""
    ends = [(m.start() + (m[0] != "\n"), m.end()) for m in _SENTENCE_END.finditer(text)]
    return [0, *(b for _, b in ends)], [*(a for a, _ in ends), len(text)]


def candidate_blocks(text: str) -> list[tuple[int, int]]:
    """Runs of sentences with cues; neighbours at most GAP sentences apart are one block."""
    low = text.lower()
    if len(low) != len(text):  # letters whose lower case is longer would shift positions
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    out: list[tuple[int, int]] = []
    if not any(c in low for c in _CUES):
        return out
    starts, ends = sentences(text)
    at = 0
    while m := _CUE.search(low, at):
        start = starts[bisect_right(starts, m.start()) - 1]
        end = ends[bisect_left(ends, m.end())]
        start, end = max(start, out[-1][1] if out else 0), max(end, m.end())
        between = text[out[-1][1] : start] if out else ""
        if out and sum(1 for x in re.split(r"[.!?]\s|\n", between) if x.strip()) <= GAP:
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
        at = end
    return out


@lru_cache(maxsize=1)
def _compressors() -> tuple:
    plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)
    named = {
        name: zstandard.ZstdCompressor(
            level=LEVEL,
            dict_data=zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT),
            write_content_size=False,
            write_checksum=False,
            write_dict_id=False,
        )
        for name, text in TEMPLATES.items()
    }
    return plain, named


def rank(block: str) -> list[tuple[int, float, str]]:
    """(bytes saved, share of the plain size, template), most bytes first, ties by name."""
    plain, named = _compressors()
    data = block.lower().encode()
    alone = len(plain.compress(data))
    saved = [(alone - len(c.compress(data)), name) for name, c in named.items()]
    return [(s, s / alone, name) for s, name in sorted(saved, key=lambda x: (-x[0], x[1])) if s > 0]


def _telling(word: str) -> bool:
    return word in TELLING or any(c.isdigit() for c in word)


@lru_cache(maxsize=1)
def _wanted() -> dict[str, list[str]]:
    return {name: _WORD.findall(text.lower()) for name, text in TEMPLATES.items()}


def compare(mine: list[str], wanted: list[str]) -> tuple[int, int, str] | None:
    """First and last word (exclusive) of a template inside a window, with the differences in wording between
    them; None where the window does not carry it."""
    match = SequenceMatcher(None, wanted, mine, autojunk=False)
    pieces = [b for b in match.get_matching_blocks() if b.size]
    if not pieces or sum(b.size for b in pieces) < MIN_MATCHED * len(wanted):
        return None
    first, last = pieces[0].b, pieces[-1].b + pieces[-1].size
    changes = []
    for tag, i1, i2, j1, j2 in match.get_opcodes():
        j1, j2 = max(j1, first), min(j2, last)
        if tag == "equal":
            continue
        lost, new = wanted[i1:i2], mine[j1:j2] if j1 < j2 else []
        if any(map(_telling, lost)) or any(map(_telling, new)):
            return None
        if lost or new:
            changes.append(f"-{' '.join(lost)}+{' '.join(new)}")
    return first, last, ";".join(changes)


def occurrences(mine: list[str], wanted: list[str]) -> Iterator[tuple[int, int, str]]:
    """Places of a template in a list of words, left to right, none inside another.

    Windows are twice as long as the template and start at every half of it, so a place of up
    to one and a half times its length stands whole in one. Only windows with enough of its words are
    compared, so the time grows with the list and not with its square.
    """
    n, known = len(wanted), set(wanted)
    hits = np.concatenate([[0], np.cumsum([w in known for w in mine], dtype=np.int64)])
    starts = np.arange(0, max(len(mine) - n // 2, 1), max(n // 2, 1))
    starts = starts[hits[np.minimum(starts + 2 * n, len(mine))] - hits[starts] >= MIN_MATCHED * n]
    done = 0
    for start in starts.tolist():
        at = max(start, done)
        while place := compare(mine[at : start + 2 * n], wanted):
            # the window may have cut it: look once more with all that may belong to it
            low, high = max(done, at + place[0] - n), at + place[1] + n
            wider = compare(mine[low:high], wanted)
            if wider and wider[1] - wider[0] >= place[1] - place[0]:
                at, place = low, wider
            yield at + place[0], at + place[1], place[2]
            done = at = at + place[1]


def identify(stretch: str) -> tuple[str, int, float, list[tuple[int, int, str]]] | None:
    """The first template in rank that its wording confirms, and its places; of equal savings by name."""
    words = list(_WORD.finditer(stretch))
    mine = [m[0].lower() for m in words]
    for saved, share, name in rank(stretch):
        places = [(words[a].start(), words[b - 1].end(), changes) for a, b, changes in occurrences(mine, _wanted()[name])]
        if places:
            return name, saved, share, places
    return None


# Short blocks repeat from document to document; longer ones are not kept.
KEPT_LENGTH = 2_000
_identify_short = lru_cache(maxsize=20_000)(identify)


def licenses_of(block: str) -> list[Finding]:
    """All licenses of a block, by place."""
    found, work = [], [(0, len(block))]
    while work:
        start, end = work.pop()
        stretch = block[start:end]
        known = (_identify_short if len(stretch) <= KEPT_LENGTH else identify)(stretch)
        if known is None:
            continue
        name, saved, share, places = known
        at = start
        for a, b, changes in places:
            found.append(Finding(start + a, start + b, name, saved, share, changes))
            work.append((at, start + a))
            at = start + b
        work.append((at, end))
    return sorted(found)


def find_licenses(text: str) -> tuple[int, list[Finding]]:
    """Number of candidate blocks, and the licenses in them."""
    blocks = candidate_blocks(text)
    found = [
        f._replace(start=start + f.start, end=start + f.end)
        for start, end in blocks
        for f in licenses_of(text[start:end])
    ]
    return len(blocks), found


SCHEMA = (
    "doc_id bigint, n_blocks bigint, n_confirmed bigint, licenses string, spans string, differences string, "
    "bytes_saved bigint"
)


def digest(text: bytes | None) -> tuple:
    n, found = find_licenses((text or b"").decode("utf-8", "replace"))
    return (
        n,
        len(found),
        ",".join(sorted({f.license for f in found})),
        ",".join(f"{f.license}:{f.start}:{f.end}" for f in found),
        "|".join(f.differences for f in found if f.differences),
        sum(f.saved for f in found),
    )


def license_spans(documents: DataFrame) -> DataFrame:
    """One row per document: candidate blocks, confirmed licenses, their names, spans (code points) and
    differences from the template's wording.

    A null or empty text has no blocks. Rows are judged by themselves, so repeated rows give repeated
    results; an empty table gives none; other columns are not looked at. Texts are read whole.
    """

    def make():
        return lambda ids, texts: [(i, *digest(t)) for i, t in zip(ids, texts, strict=True)]

    return map_rows(documents.select(F.col("doc_id").cast("bigint"), "text"), SCHEMA, make)


def op10_compressed_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return license_spans(table(spark, folder, "documents"))
