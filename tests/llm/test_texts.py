"""Licences, language, pieces, mixing, chat and scoring: exact expectations, round trips and held-out quality."""

import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import pyarrow.compute as pc
from textward.llm import chat, hpyp, langid, licenses, mixing, pieces
from textward.llm.common import id_crc, word_hashes
from textward.llm.queries import PIECES


# ---------------------------------------------------------------- tokens


def test_words_of_a_batch_are_those_of_the_regex():
    import re

    texts = ["One  two\n", "", "three", "é\tTWO", "x" * 40, " "]
    raw = b"".join(t.encode() for t in texts)
    bounds = np.cumsum([0] + [len(t.encode()) for t in texts])
    h, s, e, first = word_hashes(np.frombuffer(raw, np.uint8), bounds)
    want = [re.findall(rb"[^\x20\x09-\x0D]+", t.encode()) for t in texts]
    assert [raw[a:b] for a, b in zip(s, e, strict=True)] == [w for x in want for w in x]
    assert list(np.diff(first)) == [len(x) for x in want]
    assert h[1] == h[4] and len(set(h.tolist())) == len(h) - 1  # two = TWO


# ---------------------------------------------------------------- licences


def test_licences(spark):
    apache = "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\n"
    rows = [
        (1, "Intro here.\nReleased under the MIT License.\nMore."),
        (2, apache),
        (3, "Licensed under CC BY-NC 4.0. All rights reserved."),
        (4, "Released under the MIT License. Released under the MIT License."),
        (5, None),
        (6, ""),
        (7, "A license to fish is not a sentence of this kind."),
        (None, "This work is licensed under the GNU General Public License, version 3."),
    ]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    names = {k: [x["license"] for x in r["licenses"]] for k, r in got.items()}
    assert names == {1: ["MIT"], 2: ["Apache-2.0"], 3: ["CC-BY-NC", "All-rights-reserved"], 4: ["MIT", "MIT"], 5: [], 6: [], 7: [], None: ["GPL-3.0"]}
    (x,) = got[1]["licenses"]
    assert rows[0][1][x["start"] : x["end"]] == "Released under the MIT License."
    assert got[2]["sentence_ids"] == ["apache2.release", "apache2.comply"]


KNOWN = {
    "mit.release": "Released under the MIT License.",
    "mit.title": "The MIT License (MIT)",
    "mit.grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and more",
    "mit.notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "asis.mit": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED',
    "isc.grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided",
    "apache2.release": "Licensed under the Apache License, Version 2.0",
    "apache2.title": "Apache License, Version 2.0, January 2004",
    "apache2.comply": "you may not use this file except in compliance with the License.",
    "apache2.copy": "You may obtain a copy of the License at",
    "apache2.asis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS',
    "gpl3.work": "This program is licensed under the GNU General Public License, version 3.",
    "gpl2.work": "This program is licensed under the GNU General Public License, version 2.",
    "gpl3.title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "gpl2.title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "gpl.free": "This program is free software, you can redistribute it and/or modify it under the terms of the GNU General Public License",
    "gpl.later": "either version 3 of the License, or (at your option) any later version.",
    "lgpl.work": "This library is licensed under the GNU Lesser General Public License, version 2.1.",
    "agpl.work": "This program is licensed under the GNU Affero General Public License, version 3.",
    "mpl2.form": "This Source Code Form is subject to the terms of the Mozilla Public License, v-2.0.",
    "mpl2.copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "bsd.redist": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd.source": "* Redistributions of source code must retain the above copyright notice, this list",
    "bsd.binary": "* Redistributions in binary form must reproduce the above copyright notice, this list",
    "bsd.endorse": "* Neither the name of the holder nor others may be used to endorse or promote products derived",
    "bsd.asis": 'This software is provided by the holders "as is" and any express or implied warranties of any kind are disclaimed.',
    "cc.by": "Released under CC BY 4.0.",
    "cc.by-sa": "Released under CC BY-SA 4.0.",
    "cc.by-nc": "Released under Creative-Commons Attribution-NonCommercial 4.0",
    "cc.by-nc-sa": "Released under CC BY-NC-SA 4.0.",
    "cc.by-nd": "Released under Creative  Commons Attribution-NoDerivatives 4.0",
    "cc.zero": "Dedicated to the public domain under CC0 1.0",
    "reserved": "All rights reserved.",
    "unlicense.domain": "This is free and unencumbered software released into the public domain.",
    "spdx": "SPDX-License-Identifier:MIT",
}


def test_every_known_sentence_passes_the_prefilter():
    assert set(KNOWN) == set(licenses.SENTENCES)
    for name, text in KNOWN.items():
        assert [x[3] for x in licenses.identify(text)] == [name], text
    assert [x[3] for x in licenses.identify("Released under_CC_BY-4.0.")] == ["cc.by"]


MIT_TERMS = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY.
"""
GPL_HEADER = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
"""
MPL_HEADER = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at http://mozilla.org/MPL/2.0/. */
"""
ISC_TERMS = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
BSD_TERMS = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER BE LIABLE.
"""
APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS.
"""


@pytest.mark.parametrize(
    ("text", "licence", "sentences"),
    [
        (MIT_TERMS, "MIT", ["mit.grant", "mit.notice", "asis.mit"]),
        (GPL_HEADER, "GPL-or-later", ["gpl.free", "gpl.later"]),
        (GPL_HEADER.replace("software:", "software;"), "GPL-or-later", ["gpl.free", "gpl.later"]),
        (MPL_HEADER, "MPL-2.0", ["mpl2.form", "mpl2.copy"]),
        (ISC_TERMS, "ISC", ["isc.grant"]),
        (BSD_TERMS, "BSD-3-Clause", ["bsd.redist", "bsd.source", "bsd.binary", "bsd.endorse", "bsd.asis"]),
        (APACHE_HEADER, "Apache-2.0", ["apache2.release", "apache2.comply", "apache2.copy", "apache2.asis"]),
        ("SPDX-License-Identifier: ISC\nint x;", "SPDX", ["spdx"]),
        ("GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991\n\nMore", "GPL-2.0", ["gpl2.title"]),
    ],
)
@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_published_texts_are_recognised(text, licence, sentences, ends):
    text = text.replace("\n", ends)
    found = licenses.identify(text)
    assert [x[3] for x in found] == sentences
    assert [x[0] for x in licenses.recognise(found)] == [licence]


def test_joined_lines_take_no_more_than_a_sentence():
    text = "Released under the\nMIT License\nand more of it\nAll rights reserved\n\nReleased under the\n\nMIT License"
    assert [(text[s:e], x) for _, s, e, x in licenses.identify(text)] == [("MIT License", "mit.title"), ("All rights reserved", "reserved"), ("MIT License", "mit.title")]
    assert licenses.identify("Copyright of many\n" * 3000) == []


def test_rules_need_their_order():
    found = licenses.identify("you may not use this file except in compliance with the License.\nLicensed under the Apache License, Version 2.0")
    assert [x[0] for x in licenses.recognise(found)] == ["Apache-2.0"]
    assert licenses.recognise([(0, 0, 1, "b"), (1, 2, 3, "a")], (("L", ("a", "b")),)) == []
    assert licenses.recognise([(0, 0, 1, "a"), (99, 2, 3, "b")], (("L", ("a", "b")),)) == []


# ---------------------------------------------------------------- language


def talk(rng, lang, n=40):
    parts = {"en": ["the", "and", "thing", "house", "sh", "ing"], "de": ["der", "und", "schaft", "keit", "ein", "ung"], "fr": ["le", "et", "eaux", "que", "tion", "ère"]}[lang]
    return " ".join(rng.choice(parts) + rng.choice(parts) for _ in range(n))


def test_language(spark):
    rng = random.Random(1)
    rows = [(i, talk(rng, lang), lang if i % 7 else None, "s") for i, lang in enumerate(rng.choice(["en", "de", "fr"]) for _ in range(240))]
    truth = {}
    rng = random.Random(1)
    for i, lang in enumerate(rng.choice(["en", "de", "fr"]) for _ in range(240)):
        truth[i] = lang
        talk(rng, lang)
    odd = [(1000, None, "en", "s"), (1001, "12 %% 34", "en", "s"), (1002, "", None, "s"), (1003, "the and thing " * 200_000, None, "s")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, lang_source string")
    held = id_crc(F.col("doc_id")) % 4 == 2
    model = langid.train(df, ~held)
    got = {r["doc_id"]: r for r in langid.predict(df.withColumn("held_out", held), model, ["doc_id", "held_out"]).collect()}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(240))
    assert np.mean([got[r[0]]["lang_pred"] == r[2] for r in rows if r[2]]) > 0.95
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "en"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert (model.weights == 0).mean() > 0.3  # sparse
    none = langid.train(df.withColumn("lang", F.lit(None).cast("string")), ~held)
    assert {r["lang_pred"] for r in langid.predict(df, none, ["doc_id"]).collect()} == {"und"}
    assert langid.predict(df.where("false"), model, ["doc_id"]).count() == 0


@pytest.mark.parametrize("languages", [5, 10])
def test_languages_of_equal_size_are_all_learnt(spark, languages):
    said = lambda y, i: " ".join(chr(97 + 2 * y + (i * j) % 3) * 2 + chr(97 + 2 * y) for j in range(1, 9))
    rows = [(100 * y + i, said(y, i), f"l{y}") for y in range(languages) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df, F.lit(True), sample_rows=20 * languages)
    got = langid.predict(df, model, ["doc_id", "lang"]).collect()
    assert {r["lang"]: r["lang_pred"] for r in got} == {f"l{y}": f"l{y}" for y in range(languages)}
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) == 1 and min(r["score"] for r in got) > 0.3


def test_a_language_of_one_row_is_learnt(spark):
    rows = [(i, w, y) for y, w, n in (("a", "aa bab", 1), ("b", "cc dcd", 6), ("c", "ee fef", 6)) for i in range(n)]
    df = spark.createDataFrame([*rows, (99, "123", "a")], "doc_id long, text string, lang string")
    assert langid.train(df, F.lit(True)).predict("aa bab")[0] == "a"


def test_slices_count_each_ngram_once(monkeypatch):
    text = "Größe und Länge, aber: viele Wörter in vielen Zeilen " * 20
    whole = langid.ngram_counts(text)
    monkeypatch.setattr(langid, "_SLICE", 37)
    assert np.array_equal(whole, langid.ngram_counts(text))
    assert langid.ngram_counts("1 2 3") is None


# ---------------------------------------------------------------- pieces


@pytest.fixture(scope="module")
def machine():
    return pieces.Pieces(pieces.read(PIECES))


def test_viterbi_finds_the_best_segmentation(machine):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    score = {sp.id_to_piece(i): sp.get_score(i) for i in range(259, sp.get_piece_size())}
    for text in ("▁the", "▁within", "▁hello", "▁thandén", "xq▁▁zz", "日本"):
        best = -math.inf
        for cuts in itertools.product((0, 1), repeat=len(text) - 1):
            at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(text)]
            parts = [text[a:b] for a, b in itertools.pairwise(at)]
            total = sum(score[p] if p in score else machine.unknown if len(p) == 1 else -math.inf for p in parts)
            best = max(best, total)
        got = machine.viterbi(text)
        mine, i = 0.0, 0
        while i < len(got):
            if sp.is_byte(got[i]):  # one unknown character: as many byte pieces as it has bytes
                first = int(sp.id_to_piece(got[i])[3:5], 16)
                i += 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                mine += machine.unknown
            else:
                mine += sp.get_score(got[i])
                i += 1
        assert mine == best, text


def test_round_trip(spark, machine, monkeypatch):
    rng = random.Random(2)
    texts = ["", " ", "  a  b ", "日本語 😀", "a\n\n b", "▁x", "word " * 3000] + ["".join(rng.choice("ab é▁ \n日") for _ in range(50)) for _ in range(50)]
    for t in texts:
        assert machine.decode(machine.encode(t).tolist()) == t.replace("▁", " ")
    whole = [machine.encode(t).tolist() for t in texts]
    monkeypatch.setattr(pieces, "_SLICE", 7)
    assert [machine.encode(t).tolist() for t in texts] == whole
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate([*texts, None])], "doc_id long, text string, ids string")
    proto = pieces.read(PIECES)
    enc = pieces.encode(df, proto, ["doc_id"])
    rows = enc.collect()
    assert all(r["round_trip"] for r in rows if r["ids"] is not None) and rows[-1]["ids"] is None
    back = {r["doc_id"]: r["text"] for r in pieces.decode(enc, proto, ["doc_id"]).collect()}
    assert back == {i: t if t is None else t.replace("▁", " ") for i, t in enumerate([*texts, None])}
    assert pieces.encode(df.where("false"), proto, ["doc_id"]).count() == 0


# ---------------------------------------------------------------- mixing


def waterfill(sizes, weights, share, cap):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(cap * sizes[s] for s in capped)
        if not free:
            return {s: cap * sizes[s] for s in names}
        t = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if t[s] > cap * sizes[s]}
        if not over:
            return t | {s: cap * sizes[s] for s in capped}
        capped |= over


def test_mix(spark):
    rng = random.Random(5)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(0, 300))), rng.choice(["a", "b", "B", "ü", None, "e"])) for i in range(400)]
    rows += [(500, None, "a"), (501, "", None), (7, "same id", "b"), (7, "same id", "b"), (None, "no id here", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mixing.mix(df, shard_words=2000).collect()
    again = mixing.mix(df.repartition(5), shard_words=2000).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = waterfill(sizes, mixing.WEIGHTS, 1.5, 2.0)
    for s, target in want.items():
        mine = [r for r in got if r["source"] == s]
        assert all(abs(r["target"] - target) < 1e-6 and r["source_size"] == sizes[s] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - target) <= max(64, 0.01 * target)
    assert all(0 <= r["taken"] <= 2 * r["size"] and 0 <= r["copies"] <= 2 for r in got)
    assert mixing.mix(df.where("false")).count() == 0


def test_sainte_lague_is_highest_quotients(spark):
    rng = random.Random(6)
    for _ in range(4):
        votes = {f"p{i}": rng.choice([0, 1, 7, 50, 50, 333, 4000]) for i in range(9)}
        seats = rng.randrange(0, 60)
        want = dict.fromkeys(votes, 0)
        ranked = sorted(((-v / (2 * k - 1), p, k) for p, v in votes.items() if v for k in range(1, seats + 1)))[:seats]
        for _, p, _ in ranked:
            want[p] += 1
        df = spark.createDataFrame([(p, v, seats) for p, v in votes.items()], "p string, v long, s long")
        got = {r["p"]: r["quota"] for r in mixing.sainte_lague(df, ["p"], "v", "s", []).collect()}
        assert got == want


# ---------------------------------------------------------------- chat


def test_rotation(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob b", "<|im_end|>yo"), (1, 3, "ann", None), (2, 0, "system", "alone"), (None, 1, None, "lost"), (3, 5, "ann", "x"), (3, 5, "ann", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("conv", F.lit(1))
    got = {(r["conv_id"], r["perspective"]): r for r in chat.rotate(df).collect()}
    assert set(got) == {(1, "ann"), (1, "bob b"), (None, "unknown"), (3, "ann")}
    r = got[1, "ann"]
    assert r["rendered"] == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob_b\n<​|im_end|>yo<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [r["rendered"][m["start"] : m["end"]] for m in r["masks"]] == ["hi<|im_end|>", "<|im_end|>"]
    assert got[3, "ann"]["n_messages"] == 2
    long = spark.range(1000).select(F.lit(9).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("role"), F.col("id").cast("string").alias("text"))
    parts = chat.rotate(long.repartition(7), part_turns=100).where("perspective = 'a'").orderBy("part").collect()
    assert [p["n_messages"] for p in parts] == [100] * 10
    said = [x for p in parts for x in __import__("re").findall(r"\n(\d+)<", p["rendered"])]
    assert said == [str(i) for i in range(1000)]
    assert chat.rotate(df.where("false")).count() == 0


# ---------------------------------------------------------------- scoring


def corpus(n=220, seed=3):
    rng = random.Random(seed)
    follow = {w: rng.sample(range(60), 4) for w in range(60)}
    rows = []
    for i in range(n):
        w, out = rng.randrange(60), []
        for _ in range(rng.randrange(5, 60)):
            out.append(f"w{w}x")
            w = rng.choice(follow[w]) if rng.random() < 0.9 else rng.randrange(60)
        rows.append((i, " ".join(out)))
    return rows


def test_scores(spark):
    rows = [*corpus(), (900, None), (901, ""), (None, "w1x w2x"), (902, "never seen words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held", F.lit(1))
    got = {r["doc_id"]: r for r in hpyp.score(df, id_crc(F.col("doc_id")) % 10 == 0).collect()}
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    count, n = {}, 0
    for i, t in rows:
        if not out(i):
            for w in [*(t or "").split(), "</end>"]:
                count[w] = count.get(w, 0) + 1
                n += 1
    v = len(count)
    for i, t in rows:
        words = [*(t or "").split(), "</end>"]
        r = got[i]
        base = sum(math.log10((count.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (out(i), len(words), n)
        assert r["n_known"] == sum(w in count for w in words) and abs(r["base_score"] - base) < 1e-6
    held = [got[i] for i, _ in rows if out(i)]
    tokens = sum(r["n_tokens"] for r in held)
    assert sum(r["score"] for r in held) / tokens > sum(r["base_score"] for r in held) / tokens + 0.2
    assert hpyp.score(df.where("false"), F.lit(False)).count() == 0


def test_probabilities_of_a_context_sum_to_one(spark):
    """Each of all words, the end and an unknown word after the same word: one with its own restaurant, one with a shared one."""
    rows = corpus(150)
    words = sorted({w for _, t in rows for w in t.split()})
    frame = [(i, t, False) for i, t in rows]
    for probe in ("w1x", "unseen"):
        frame += [(10_000, f"{probe} {w}", True) for w in [*words, "unheard"]] + [(20_000, probe, True)]
    df = spark.createDataFrame(frame, "id long, text string, held boolean").coalesce(1)
    layout = hpyp._frequent(df, 40, 1.0)
    t = hpyp._chunks(df, layout, 3).toArrow()
    totals = np.sum([x for x in t.column("totals").to_pylist() if x], axis=0)
    buckets = [t.filter(pc.equal(t.column("bucket"), i)) for i in range(3)]
    plan = (layout, totals, 3, 6, 2, 6, 3)
    shared = np.sum([hpyp._sample(*plan)(x).column("totals")[0].as_py() for x in buckets], axis=0)
    sums = np.zeros(layout.n)
    for x in buckets:
        found = hpyp._sample(*plan, shared)(x)
        for ctx, score in zip(x.column("ctx").to_pylist(), found.column("score").to_pylist(), strict=True):
            np.add.at(sums, hpyp.unpack(ctx, np.uint16), 10.0 ** hpyp.unpack(score, np.float32))
    for probe in (b"w1x", b"unseen"):
        raw = np.frombuffer(probe, dtype=np.uint8)
        h, s, e, _ = word_hashes(raw, np.array([0, len(raw)]))
        assert abs(sums[layout.context(h, hpyp._classes(raw, s, e))[0]] - 1) < 1e-4
    assert set(layout.hot.tolist()) and layout.n > layout.k + hpyp.CLASSES


def test_scores_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame(corpus(60), "doc_id long, text string")
    scores = [{r["doc_id"]: r["base_score"] for r in hpyp.score(df.repartition(n), F.col("doc_id") % 10 == 0, contexts=16).collect()} for n in (1, 3)]
    assert scores[0].keys() == scores[1].keys() and all(abs(scores[0][i] - x) < 1e-9 for i, x in scores[1].items())
    layouts = [hpyp._frequent(df.repartition(n).selectExpr("doc_id AS id", "text", "false AS held"), 16, 1.0) for n in (1, 3)]
    assert (layouts[0].hot == layouts[1].hot).all()


def test_gibbs_keeps_tables_within_customers():
    rng = np.random.default_rng(0)
    c = rng.integers(0, 400, 3000)
    t = hpyp.start_tables(c, np.full(3000, 0.5), 0.7)
    for _ in range(5):
        t = hpyp.gibbs(c, t, np.full(3000, 0.5), 0.7, rng, 6)
        assert ((t >= np.minimum(c, 1)) & (t <= c)).all()
    chance = hpyp.alone(0.7)
    assert abs(chance[2, 2] - 1) < 1e-12 and chance[5, 1] == 0 and abs(chance[3, 2] - (2 * 0.3) / (0.3 + 2 * 0.3) * 0.5 * 1.0) < 1


@pytest.mark.parametrize(("n", "w"), [(40, 3.0), (1000, 0.5), (1000, 60.0)])
def test_gibbs_seats_frequent_dishes_from_their_conditional(n, w):
    """Whatever the start, one sweep of 6 moves gives the mean of S(n, t) w^t over all numbers of tables."""
    d, t = 0.75, np.arange(n + 1)
    log = np.full(n + 1, -np.inf)
    log[1] = 0.0
    for c in range(1, n):
        log[1:] = np.logaddexp(log[1:] + np.log(np.maximum(c - d * t[1:], 1e-300)), log[:-1])
    p = np.exp(log[1:] + t[1:] * math.log(w) - (log[1:] + t[1:] * math.log(w)).max())
    p /= p.sum()
    mean, deviation = p @ t[1:], math.sqrt(p @ t[1:] ** 2 - (p @ t[1:]) ** 2)
    for start in (1, n):
        got = hpyp.gibbs(np.full(2000, n), np.full(2000, start), np.full(2000, w), d, np.random.default_rng(5), 6)
        assert abs(got.mean() - mean) < 0.12 * deviation and abs(got.std() / deviation - 1) < 0.1


def test_contexts_are_named_by_all_training_texts(spark, monkeypatch):
    """However long the texts are: here they are estimated at 40 million words, of which 60 are distinct and frequent."""

    import pyarrow as pa

    class Named(Exception):
        pass

    def stop(rows, layout, buckets):
        raise Named(layout)

    monkeypatch.setattr(hpyp, "_chunks", stop)
    df = spark.range(60).selectExpr("id AS doc_id", "concat(repeat(concat('common w', id, 'x '), 5), repeat(' ', 4000000)) AS text")
    with pytest.raises(Named) as got:
        hpyp.score(df, F.col("doc_id") < 0, contexts=61)
    words = ["common"] + [f"w{i}x" for i in range(60)]
    h = word_hashes(*hpyp.text_buffer(pa.array([" ".join(words)])))[0]
    assert set(got.value.args[0].hot.tolist()) == set(h.tolist())
    portions = hpyp._frequent(df.selectExpr("doc_id AS id", "substr(text, 1, 99) AS text", "false AS held"), 61, 1e-5)
    assert portions.hot.tolist() == got.value.args[0].hot.tolist()
