"""Line dedup against a brute-force version."""

import random

from textward.llm.lines import dedup_lines


def brute(rows, min_words):
    """Deletes, by trying every window, what has an earlier copy that it doesn't overlap."""
    docs = sorted(enumerate(rows), key=lambda r: (r[1][0] is not None, r[1][0] or 0, r[0]))
    kept, seen, gone = {}, {}, {}
    split = {i: [x.strip() for x in (t or "").split("\n") if x.strip()] for i, (_, t) in docs}
    order = {i: n for n, (i, _) in enumerate(docs)}
    for i, _ in docs:
        lines = split[i]
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if sum(len(x.split()) for x in lines[a:b]) >= min_words:
                    seen.setdefault(tuple(lines[a:b]), []).append((order[i], a, i))
    for w, places in seen.items():
        first = min(places)
        for o, a, i in places:
            if (o, a) > first[:2] and (o != first[0] or a >= first[1] + len(w)):
                gone.setdefault(i, set()).update(range(a, a + len(w)))
    for i, _ in docs:
        kept[i] = [x for n, x in enumerate(split[i]) if n not in gone.get(i, set())]
    return kept


def test_against_brute_force(spark):
    rng = random.Random(3)
    for trial in range(4):
        pool = [" ".join(f"w{rng.randrange(9)}" for _ in range(rng.randrange(1, 5))) for _ in range(8)]
        rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 12)))) for i in range(12)]
        rows += [(100, rows[3][1]), (101, None), (102, ""), (103, "\n\n"), (104, "a b\n\n" + rows[5][1])]
        got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), min_words=6).collect()
        want = brute(rows, 6)
        by_id = {r["doc_id"]: r for r in got}
        assert len(got) == len(rows)
        for i, (d, t) in enumerate(rows):
            r = by_id[d]
            assert (r["text"] is None) == (t is None)
            assert [x.strip() for x in (r["text"] or "").split("\n") if x.strip()] == want[i], (trial, d)
            assert r["n_lines"] - r["n_deleted"] == len(want[i])


def test_cases(spark):
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(None, long, 1), (1, long, 2), (1, long, 2), (2, f"own line\n{long}\n\nend", 3), (3, "short\nshort", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, uid int").coalesce(1)
    got = {(r["doc_id"], r["uid"], r["text"]) for r in dedup_lines(df).collect()}
    assert got == {(None, 1, long), (1, 2, ""), (2, 3, "own line\n\nend"), (3, 4, "short\nshort")}
    assert dedup_lines(df.where("false")).count() == 0
    assert dedup_lines(df).columns == ["doc_id", "text", "uid", "n_lines", "n_deleted"]
