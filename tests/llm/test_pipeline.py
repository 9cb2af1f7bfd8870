"""The pipeline over a small table, stage by stage against brute force."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_lines import brute as brute_lines
from textward.llm import mixing, pieces

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, lang):
    parts = {"en": ["the", "and", "thing", "house", "sh"], "de": ["der", "und", "schaft", "keit", "ung"]}[lang]
    return " ".join(rng.choice(parts) + rng.choice(parts) + str(rng.randrange(99)) * 0 for _ in range(rng.randrange(8, 14)))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = []
    for i in range(60):
        lang = rng.choice(["en", "de"])
        out.append((i, "\n".join(sentence(rng, lang) for _ in range(rng.randrange(6, 12))), lang, rng.choice(["a", "b", "c", None])))
    shared = "\n".join(sentence(rng, "en") for _ in range(7))  # more than 50 words that repeat across documents
    out += [(100 + i, f"{sentence(rng, 'en')}\n{shared}\n{sentence(rng, 'en')}", "en", "a") for i in range(3)]
    out += [(200, out[3][1], "en", "b"), (201, "12 34 %%", "en", "b"), (202, None, None, "a"), (203, "", "de", "a")]
    words = out[5][1].replace("\n", " ").split(" ")
    out += [(300, " ".join(words), out[5][2], "c"), (301, " ".join([*words[:-1], "changed"]), out[5][2], "c")]  # one line each: near copies
    return [(*r, len(r[1]) if r[1] is not None else None) for r in out]


def test_stages(spark, rows, tmp_path):
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    columns = docs.columns
    by_id = {r[0]: r for r in rows}

    one = corpus_pipeline.language_id(spark, docs, "")
    assert one.columns == columns
    one.write.parquet(str(tmp_path / "1"))
    one = spark.read.parquet(str(tmp_path / "1"))
    assert {r["doc_id"] for r in one.collect()} == set(by_id) - {201, 202, 203}

    two = corpus_pipeline.line_dedup(spark, one, "")
    two.write.parquet(str(tmp_path / "2"))
    two = spark.read.parquet(str(tmp_path / "2"))
    kept = [(r["doc_id"], r["text"]) for r in one.orderBy("doc_id").collect()]
    want = {d: lines for (d, _), lines in zip(kept, brute_lines(kept, 50).values(), strict=True) if lines}
    got = {r["doc_id"]: r for r in two.collect()}
    assert two.columns == columns and set(got) == set(want) and 200 not in got
    assert all([x for x in got[d]["text"].split("\n") if x.strip()] == want[d] and got[d]["n_chars"] == len(got[d]["text"]) for d in got)
    assert len(want[100]) == 9 and len(want[101]) == len(want[102]) == 2

    three = corpus_pipeline.ngram_jaccard(spark, two, "")
    three.write.parquet(str(tmp_path / "3"))
    three = spark.read.parquet(str(tmp_path / "3"))
    shingles = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for d, r in got.items() for w in [r["text"].lower().split()]}
    label = {d: d for d in got}
    for a in sorted(got):
        for b in sorted(got):
            if a < b and 100 * len(shingles[a] & shingles[b]) >= 80 * len(shingles[a] | shingles[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {d: new if x == old else x for d, x in label.items()}
    assert {r["doc_id"] for r in three.collect()} == set(label.values()) and three.columns == columns
    assert 5 in label.values() and not {300, 301} & set(label.values())

    four = corpus_pipeline.source_mix(spark, three, "")
    four.write.parquet(str(tmp_path / "4"))
    four = spark.read.parquet(str(tmp_path / "4"))
    plan = {r["doc_id"]: r["copies"] for r in mixing.mix(three).collect()}
    times = {r["doc_id"]: r["count"] for r in four.groupBy("doc_id").count().collect()}
    assert four.columns == columns and times == {d: n for d, n in plan.items() if n}

    five = corpus_pipeline.sentencepiece(spark, four, "")
    machine = pieces.model(pieces.read(corpus_pipeline.PIECES))
    text = {r["doc_id"]: r["text"] for r in three.collect()}
    assert all(machine.decode(r["ids"]) == text[r["doc_id"]] for r in five.collect())


def test_repeated_rows(spark, rows):
    """Rows equal in id and text are one member of a class, and are mixed as the single rows that they are."""
    docs = spark.createDataFrame([*rows[:30], rows[2], rows[2]], SCHEMA).coalesce(1)
    kept = corpus_pipeline.ngram_jaccard(spark, docs, "").groupBy("doc_id").count().collect()
    assert len(kept) == 30 and all(r["count"] == 1 for r in kept)
    plan = {}
    for r in mixing.mix(docs).collect():
        plan[r["doc_id"]] = plan.get(r["doc_id"], 0) + r["copies"]
    mixed = {r["doc_id"]: r["count"] for r in corpus_pipeline.source_mix(spark, docs, "").groupBy("doc_id").count().collect()}
    assert mixed == {d: n for d, n in plan.items() if n}


def test_run_is_the_stages_in_order(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard", "source_mix", "sentencepiece"]
    assert out.where(F.col("doc_id").isin(200, 201, 202, 203, 300, 301)).count() == 0 and out.count() > 30
