"""Neighbours and near-duplicates against brute force."""

import numpy as np
from pyspark.sql import functions as F

from textward.llm.mih import Codes, Tables, search
from textward.llm.neardup import near_duplicates


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, id string")


def sample(n=160, dim=12, seed=4):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 4, dim)).astype(np.float32)
    return np.concatenate([base, base + rng.normal(0, 0.12, base.shape), base[:20] * 3, rng.standard_normal((n // 4, dim))]).astype(np.float32)


ODD = [(900, None, 0, "n"), (901, [0.0] * 12, 0, "z"), (902, [float("nan")] + [1.0] * 11, 0, "x"), (903, [None] + [1.0] * 11, 0, "y"), (904, [float("inf")] * 12, 0, "i"), (905, [1.0, 2.0], 0, "short")]


def test_near_duplicates(spark):
    x = sample()
    rows = [(i, [float(v) for v in r], 0, "a") for i, r in enumerate(x)] + ODD
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hit = u @ u.T >= 0.95
    np.fill_diagonal(hit, False)
    label = np.arange(len(x))
    while True:
        new = np.array([min(label[i], *label[hit[i]]) if hit[i].any() else label[i] for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    got = {r["vec_id"]: r for r in near_duplicates(frame(spark, rows).repartition(3), cells=5, block=16).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["n_links"] == hit[i].sum() and got[i]["component_id"] == label[i] and got[i]["kept"] == (label[i] == i) for i in range(len(x)))
    assert all((got[r[0]]["n_links"], got[r[0]]["component_id"]) == (0, r[0]) for r in ODD)
    assert near_duplicates(frame(spark, rows).where("false")).count() == 0


def test_search(spark):
    x = sample()
    rows = [(i, [float(v) for v in r], 0, "a") for i, r in enumerate(x)] + ODD
    got = search(frame(spark, rows), F.col("id") % 20 == 0, k=10).collect()
    assert {r["query_id"] for r in got} == {q for q in range(0, len(x), 20)}
    found = 0
    for q in range(0, len(x), 20):
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        score = x.astype(float) @ x[q].astype(float)
        best = [i for i in np.lexsort((np.arange(len(x)), -score)) if i != q][:10]
        assert [r for r, _, _ in mine] == list(range(1, 11))
        assert all(abs(s - score[v]) < 1e-12 for _, v, s in mine)
        assert [(-s, v) for _, v, s in mine] == sorted((-s, v) for _, v, s in mine)
        found += len({v for _, v, _ in mine} & set(best))
    assert found >= 0.9 * 10 * len(range(0, len(x), 20))
    few = search(frame(spark, rows[:3]), F.col("id") == 0, k=20).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2]
    assert search(frame(spark, rows).where("false"), F.col("id") == 0).count() == 0


def test_negative_ids_are_linked(spark):
    rows = [(-7, [1.0, 0.0]), (-3, [1.0, 0.01]), (4, [1.0, 0.02]), (9, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_duplicates(df, cells=1).collect()}
    assert got == {-7: (2, -7, True), -3: (2, -7, False), 4: (2, -7, False), 9: (0, 9, True)}


def test_search_of_repeated_rows_and_ties(spark):
    """A query asks once, however often its row is repeated; each other row is a candidate; ties go to the smaller id."""
    x = sample(80)
    rows = [(i, [float(v) for v in r], 0, "a") for i, r in enumerate(x)]
    rows += [rows[20], (20, [float(v) for v in x[3]], 0, "a"), rows[7], (500, rows[9][1], 0, "a")]
    ids, vectors = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float32).astype(float)
    got = search(frame(spark, rows).repartition(3), F.col("id") % 20 == 0, k=12, margin=9.0).collect()
    assert sorted({r["query_id"] for r in got}) == [0, 20, 40, 60, 500]
    for q in (0, 20, 40, 60, 500):
        score = (vectors @ vectors[ids == q].T).max(axis=1)
        at = np.flatnonzero(ids != q)
        best = [(int(ids[i]), float(score[i])) for i in at[np.lexsort((ids[at], -score[at]))][:12]]
        mine = [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q]
        assert [v for v, _ in mine] == [v for v, _ in best] and all(abs(a - b) < 1e-9 for (_, a), (_, b) in zip(mine, best, strict=True))


def test_every_code_within_the_radius_is_retrieved_and_few_others():
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((200, 32))
    x = np.repeat(centres, 40, axis=0) + 0.3 * rng.standard_normal((8000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes = Codes(x[::3], float(np.linalg.norm(x, axis=1).max()), 256)
    tables, asked = Tables(codes.of(x)), codes.of(x[::200], query=True)
    share, hits = [], 0
    for code, i in zip(asked, range(0, 8000, 200), strict=True):
        for r in (0, 1, 2, 5):
            near = set(tables.near(code, r).tolist())
            assert set(np.flatnonzero(tables.distance(code, np.arange(8000)) <= 16 * r + 15).tolist()) <= near
        allowed = np.arange(8000) != i
        at, score, seen = tables.nearest(code, x, x[i], allowed, 20, 256, codes.norm, 1.0)
        share.append(seen / 8000)
        hits += len(set(at.tolist()) & set(np.argsort(-np.where(allowed, x @ x[i], -np.inf))[:20].tolist()))
    assert hits >= 0.9 * 20 * len(asked) and np.mean(share) < 0.2


def test_near_duplicates_do_not_write_a_vector_for_every_cell(spark, monkeypatch, tmp_path):
    """Vectors in all directions could have partners in all cells; tables stay as long as the input, links equal brute force."""
    from pathlib import Path

    from textward.llm import neardup

    rng = np.random.default_rng(8)
    x = rng.standard_normal((1500, 64)).astype(np.float32)
    x[1000:1200] = x[:200] + rng.normal(0, 0.2, (200, 64))
    x[1200:1260] = x[7] + rng.normal(0, 0.15, (60, 64))
    x[1300:1320] = x[9]
    written, save = [], neardup.save

    def measured(df):
        out, path = save(df)
        written.append(sum(p.stat().st_size for p in Path(path).rglob("*.parquet")))
        return out, path

    monkeypatch.setattr(neardup, "save", measured)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r for r in neardup.near_duplicates(df, cells=24, block=64).collect()}
    assert sum(written) < 4 * x.nbytes
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hit = u @ u.T >= 0.95
    np.fill_diagonal(hit, False)
    assert hit.sum() > 500 and all(got[i]["n_links"] == hit[i].sum() for i in range(len(x)))
    label = np.arange(len(x))
    while (new := np.array([min(label[i], *label[hit[i]]) if hit[i].any() else label[i] for i in range(len(x))])).tolist() != label.tolist():
        label = new
    assert all(got[i]["component_id"] == label[i] and got[i]["kept"] == (label[i] == i) for i in range(len(x)))
