"""The Jaccard join against a brute-force version."""

import random
import re

import numpy as np

from textward.llm.jaccard import classes, jaccard_classes


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 4]) for i in range(len(words) - 3)) or frozenset([tuple(words)])


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    label = [d for d, _ in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    while True:
        old = list(label)
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
        if old == label:
            return {d: (len(s), c) for (d, _), s, c in zip(rows, sets, label, strict=True)}


def chains(rng, n):
    rows = []
    while len(rows) < n:
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((3, 8, 12, 30, 60, 150, 400)))]
        for _ in range(rng.randrange(1, 12)):
            rows.append((len(rows), " ".join(words)))
            for _ in range(rng.randrange(0, 1 + len(words) // 40 + 1)):  # a chain of small edits: neighbours link, ends don't
                words[rng.randrange(len(words))] = f"w{rng.randrange(3000)}"
            if rng.random() < 0.3:
                words = words[rng.randrange(2) :] + [f"x{rng.randrange(99)}"]
    return rows


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = chains(random.Random(seed), 150)
        rows += [(1000, None), (1001, ""), (1002, " \n "), (1003, "One"), (1004, "one"), (1005, "one two"), (1006, "One\tTWO"), (1007, "É é")]
        for few in (2, 16):
            got = jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), few=few).collect()
            assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows)


def test_cases(spark):
    df = spark.createDataFrame([(None, "a b c d e", 1), (5, "a b c d e", 2), (5, "a b c d e", 2), (6, None, 3)], "doc_id long, text string, f int")
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in jaccard_classes(df).collect())
    assert got == [(-1, 2, 5), (5, 2, 5), (5, 2, 5), (6, 0, 6)]
    assert jaccard_classes(df.where("false")).count() == 0


def test_partners_are_one_class_away():
    tops = classes(85, 5000)
    for n in range(1, 4000):
        m = int(n * 100 / 85)
        a, b = np.searchsorted(tops, [n, m])
        assert b - a <= 1


def test_joins_are_merged_at_every_size(spark, monkeypatch):
    """Small tables are not collected to be broadcast: plans, and so disk, are the same for larger ones."""
    from textward.llm import components, jaccard

    plans = []

    def planned(save):
        def run(df):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return save(df)

        return run

    for module in (components, jaccard):
        monkeypatch.setattr(module, "save", planned(module.save))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    texts = [" ".join(f"w{(i // 3) * 50 + j}" for j in range(40 + i % 3)) for i in range(12)]
    out = jaccard_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert {r["doc_id"]: r["component_id"] for r in out.collect()} == {i: i // 3 * 3 for i in range(12)}
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before
