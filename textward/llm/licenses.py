"""Licence scans by sentence rules: sentences -> identifiers -> ordered rules.

A text is cut into pieces (at line ends, after ``.``, ``;``, ``:``, ``!`` or ``?`` before white space, and before
``either version`` after a comma). From each piece on, the fewest pieces that make a known sentence are joined: wrapped
lines, ``v. 2.0`` and ``software: you can`` don't end one, but an empty line does, and so does a piece that is known by itself.
What is joined is normalised (lower case, letters, digits and dots in version numbers only, single spaces). Known sentences
are exact, or patterns that must match all of it. Other lines are one sentence up to one that ends with a mark. The identifiers found,
in the text's order, are then matched against the rules, most specific first: a rule is a sequence of identifiers that
must occur in that order with at most ``gap`` other sentences between two of them. Identifiers that one rule has used are
not offered to the next, so that a text's licences don't count twice.

Whole texts are read, each row by itself: no shuffle. Cases: null and empty texts have no licence; a licence that occurs
several times counts each time; ties between rules go to the first in the list; repeated rows each have their result;
extra columns don't matter, as only the id and the text are read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Known sentences: identifier -> pattern of the whole normalised sentence.
SENTENCES = {
    "mit.release": r"(?:released|licensed|available|distributed) under the (?:terms of the )?(?:mit|expat) licen[cs]e",
    "mit.title": r"(?:the )?mit licen[cs]e(?: mit)?",
    "mit.grant": r"permission is hereby granted free of charge to any person obtaining a copy of this software .*",
    "mit.notice": r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "asis.mit": r"the software is provided as is without warranty of any kind .*",
    "isc.grant": r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted .*",
    "apache2.release": r"(?:released|licensed|available|distributed) under the (?:terms of the )?apache licen[cs]e(?: version)? 2(?:\.0)?(?: the license)?",
    "apache2.title": r"apache licen[cs]e(?: version)? 2(?:\.0)?(?: january 2004)?",
    "apache2.comply": r"you may not use this file except in compliance with the license",
    "apache2.copy": r"you may obtain a copy of the license at.*",
    "apache2.asis": r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis.*",
    "gpl3.work": r"this (?:work|program|software) is licensed under the gnu general public licen[cs]e version 3(?:\.0)?",
    "gpl2.work": r"this (?:work|program|software) is licensed under the gnu general public licen[cs]e version 2(?:\.0)?",
    "gpl3.title": r"gnu general public licen[cs]e version 3(?:\.0)?(?: 29 june 2007)?",
    "gpl2.title": r"gnu general public licen[cs]e version 2(?:\.0)?(?: june 1991)?",
    "gpl.free": r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license.*",
    "gpl.later": r"either version (?:2|3) of the license or at your option any later version",
    "lgpl.work": r"this (?:work|library|software) is licensed under the gnu lesser general public licen[cs]e version (?:2\.1|3)(?:\.0)?",
    "agpl.work": r"this (?:work|program|software) is licensed under the gnu affero general public licen[cs]e version 3(?:\.0)?",
    "mpl2.form": r"this source code form is subject to the terms of the mozilla public license v 2\.0",
    "mpl2.copy": r"if a copy of the mpl was not distributed with this file you can obtain one at.*",
    "bsd.redist": r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd.source": r"(?:1 )?redistributions of source code must retain the above copyright notice.*",
    "bsd.binary": r"(?:2 )?redistributions in binary form must reproduce the above copyright notice.*",
    "bsd.endorse": r"(?:3 )?neither the name of .* may be used to endorse or promote products.*",
    "bsd.asis": r"this software is provided by .* as is and any express or implied warranties .* are disclaimed",
    "cc.by": r"(?:this work is )?(?:released|licensed) under (?:a )?(?:cc|creative commons) (?:by|attribution) \d\.\d(?: international)?(?: license)?",
    "cc.by-sa": r"(?:this work is )?(?:released|licensed) under (?:a )?(?:cc|creative commons) (?:by sa|attribution sharealike) \d\.\d(?: international)?(?: license)?",
    "cc.by-nc": r"(?:this work is )?(?:released|licensed) under (?:a )?(?:cc|creative commons) (?:by nc|attribution noncommercial) \d\.\d(?: international)?(?: license)?",
    "cc.by-nc-sa": r"(?:this work is )?(?:released|licensed) under (?:a )?(?:cc|creative commons) (?:by nc sa|attribution noncommercial sharealike) \d\.\d(?: international)?(?: license)?",
    "cc.by-nd": r"(?:this work is )?(?:released|licensed) under (?:a )?(?:cc|creative commons) (?:by nd|attribution noderivatives) \d\.\d(?: international)?(?: license)?",
    "cc.zero": r"(?:this work is )?(?:released|licensed|dedicated) (?:under|to the public domain under) (?:cc0|creative commons zero)(?: 1\.0)?",
    "reserved": r"(?:copyright .* )?all rights reserved",
    "unlicense.domain": r"this is free and unencumbered software released into the public domain",
    "spdx": r"spdx license identifier [a-z0-9. ]+",
}

#: Ordered rules: (licence, identifiers in order). The longer evidence comes first.
RULES = (
    ("MIT", ("mit.grant", "mit.notice", "asis.mit")),
    ("MIT", ("mit.title", "mit.grant")),
    ("MIT", ("mit.grant",)),
    ("ISC", ("isc.grant",)),
    ("Apache-2.0", ("apache2.release", "apache2.comply", "apache2.copy", "apache2.asis")),
    ("Apache-2.0", ("apache2.release", "apache2.comply")),
    ("Apache-2.0", ("apache2.release",)),
    ("Apache-2.0", ("apache2.title",)),
    ("BSD-3-Clause", ("bsd.redist", "bsd.source", "bsd.binary", "bsd.endorse")),
    ("BSD-2-Clause", ("bsd.redist", "bsd.source", "bsd.binary")),
    ("GPL-3.0", ("gpl3.work",)),
    ("GPL-2.0", ("gpl2.work",)),
    ("GPL-or-later", ("gpl.free", "gpl.later")),
    ("GPL-3.0", ("gpl3.title",)),
    ("GPL-2.0", ("gpl2.title",)),
    ("LGPL", ("lgpl.work",)),
    ("AGPL-3.0", ("agpl.work",)),
    ("MPL-2.0", ("mpl2.form", "mpl2.copy")),
    ("MPL-2.0", ("mpl2.form",)),
    ("MIT", ("mit.release",)),
    ("MIT", ("mit.title",)),
    ("CC-BY-NC-SA", ("cc.by-nc-sa",)),
    ("CC-BY-NC", ("cc.by-nc",)),
    ("CC-BY-SA", ("cc.by-sa",)),
    ("CC-BY-ND", ("cc.by-nd",)),
    ("CC-BY", ("cc.by",)),
    ("CC0", ("cc.zero",)),
    ("Unlicense", ("unlicense.domain",)),
    ("SPDX", ("spdx",)),
    ("All-rights-reserved", ("reserved",)),
)

_CUT = re.compile(r"[\r\n]+|(?<=[.;:!?])\s+|(?<=,)\s+(?=either\s+version\b)", re.I)
_WORD = re.compile(r"[a-z0-9]", re.I | re.A)
_LINE_END = re.compile(r"\r\n|\r|\n")
_JUNK = re.compile(r"[^a-z0-9.]+")
_DOT = re.compile(r"\.(?![0-9])|(?<![0-9])\.")
_SPACES = re.compile(r" +")
#: A text without any of these stems has no known sentence: each is part of one normalised word, whatever stands between words.
_STEMS = re.compile(r"licen[cs]e|permission|copyright|redistribut|software|reserved|creative|mpl|spdx|either|(?<![a-z0-9])cc(?:0|(?![a-z0-9]))", re.I | re.A)
_ID = re.compile("|".join(f"(?P<s{i}>{p})" for i, p in enumerate(SENTENCES.values())))
_NAMES = list(SENTENCES)


def normalise(sentence: str) -> str:
    """Lower case; only letters, digits and dots inside version numbers; single spaces."""
    return _SPACES.sub(" ", _DOT.sub(" ", _JUNK.sub(" ", sentence.lower()))).strip()


#: First words of known sentences, and the most characters that one has up to where an open end begins.
_FIRST = re.compile(r"[^a-z0-9]*(?:released|licensed|available|distributed|dedicated|the|mit|expat|permission|apache|you|unless|this|gnu|either|if|redistributions?|[123]|neither|copyright|all|spdx)(?![a-z0-9])", re.I | re.A)
_CLOSED = [re.sub(r"(?:\.\*|\[a-z0-9\. \]\+)$", "", p) for p in SENTENCES.values()]
_WIDEST = 2 + max(re._parser.parse(p).getwidth()[1] for p in _CLOSED if ".*" not in p)
#: Sentences with an open middle, which have no most characters: they are joined to the end of their lines.
_OPEN = ("copyright ", "neither the name of ", "3 neither the name of ", "this software is provided by ")


def _known(sentence: str) -> str | None:
    m = _ID.fullmatch(normalise(sentence))
    return _NAMES[int(m.lastgroup[1:])] if m else None


def identify(text: str | None) -> list[tuple[int, int, int, str]]:
    """(sentence number, start, end, identifier) of the known sentences of a text."""
    if not text or not _STEMS.search(text):
        return []
    # (start, end, whether a sentence may go on in the next piece, whether it does so over a line end alone)
    parts: list[tuple[int, int, bool, bool]] = []
    at = 0
    for cut in [*_CUT.finditer(text), None]:
        end = cut.start() if cut else len(text)
        if end > at:
            on = cut is not None and len(_LINE_END.findall(cut.group())) < 2 and _WORD.search(text, at, end) is not None
            parts.append((at, end, on, on and text[end - 1] not in ".;:!?" and cut.group()[0] in "\r\n"))
        elif parts:
            parts[-1] = (*parts[-1][:2], False, False)
        at = cut.end() if cut else end
    alone: dict[int, str | None] = {}

    def single(i: int) -> str | None:
        if i not in alone:
            alone[i] = _known(text[parts[i][0] : parts[i][1]]) if _FIRST.match(text, parts[i][0], parts[i][1]) else None
        return alone[i]

    found, n, i, fresh, tried = [], -1, 0, True, set()
    while i < len(parts):
        if fresh:
            n, tried = n + 1, set()
        name, last = single(i), i
        if name is None and _FIRST.match(text, parts[i][0], parts[i][1]):
            words = normalise(text[parts[i][0] : parts[i][1]])
            while name is None and len(words) <= _WIDEST and parts[last][2] and single(last + 1) is None:
                last += 1
                words = normalise(text[parts[i][0] : parts[last][1]])
                m = _ID.fullmatch(words)
                name = _NAMES[int(m.lastgroup[1:])] if m else None
            opening = next((x for x in _OPEN if words.startswith(x)), None)
            if name is None and opening and opening not in tried:  # an earlier one of these lines would have matched, too
                tried.add(opening)
                last = i
                while parts[last][3] and single(last + 1) is None:
                    last += 1
                name = _known(text[parts[i][0] : parts[last][1]])
        if name is None:
            fresh = not parts[i][3]
            i += 1
            continue
        if not fresh:  # it ends what lines came before
            n += 1
        found.append((n, parts[i][0], parts[last][1], name))
        i, fresh = last + 1, True
    return found


def recognise(found: list[tuple[int, int, int, str]], rules=RULES, gap: int = 8) -> list[tuple[str, int, int]]:
    """(licence, start, end) by the ordered rules over identified sentences; in the text's order."""
    free, out = [True] * len(found), []
    where: dict[str, list[int]] = {}
    for i, x in enumerate(found):
        where.setdefault(x[3], []).append(i)
    for licence, sequence in rules:
        if any(s not in where for s in sequence):
            continue
        for first in where[sequence[0]]:
            if not free[first]:
                continue
            used = [first]
            for name in sequence[1:]:
                places = where[name]
                k = bisect_right(places, used[-1])
                after = next((places[j] for j in range(k, min(k + gap + 2, len(places))) if free[places[j]]), None)
                if after is None or found[after][0] - found[used[-1]][0] > gap + 1:
                    break
                used.append(after)
            else:
                for i in used:
                    free[i] = False
                out.append((licence, found[used[0]][1], found[used[-1]][2]))
    return sorted(out, key=lambda x: (x[1], x[2], x[0]))


_SCHEMA = "n_sentences int, sentence_ids array<string>, licenses array<struct<license:string,start:int,end:int>>"
_ARROW = pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rules=RULES, gap: int = 8) -> DataFrame:
    """Per row: the key, the number of known sentences, their identifiers in order, and the licences with spans."""
    slim = docs.select(docs[key], docs[text].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, licences = [], []
            for t in b.column(1):
                found = identify(t.as_py())
                ids.append([x[3] for x in found])
                licences.append([{"license": n, "start": s, "end": e} for n, s, e in recognise(found, rules, gap)] if found else [])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) for x in ids], pa.int32()), pa.array(ids, pa.list_(pa.string())), pa.array(licences, pa.list_(_ARROW))],
                [key, "n_sentences", "sentence_ids", "licenses"],
            )

    return slim.mapInArrow(run, f"{key} {slim.schema[0].dataType.simpleString()}, {_SCHEMA}")
