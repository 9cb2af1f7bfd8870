"""Exact n-gram Jaccard join in metric space: pivots, Voronoi regions, triangle-inequality windows.

Distance is 1 - Jaccard over sets of word shingles. Between unrelated texts it is nearly 1 to any pivot, so that Voronoi
cells over a few global pivots would not tell them apart. Regions are therefore opened where texts can meet at all:

1. Equal sets are one point (a hash of the set), with its smallest id.
2. Meeting places. If two sets are within the radius, their symmetric difference has at most ``D = radius / (1 - radius) *
   smaller`` elements. Dealt by hash to m = 17/12 D parts, at least m - D parts are then equal in both. Every point goes to a place for
   each of its parts but empty ones, of which it has e. So two such sets have at least m - D - e places in common, and
   every point leaves the m - D - e - 1 places with most points: the common place with fewest stays common. Passages that
   many texts share bring no texts together that way. m follows the size class of the smaller set; a point goes to the places
   of its own class and of the class below. This loses no pair. Places with equal members are one place.
3. Every place has a pivot, its smallest point. All members' distances to it are computed: those within the radius form
   its region.
4. Places whose members are not all connected by now join recursively. In small ones the pairs across components are
   verified. Large ones are regions cut in bands by the distance to their pivot: the triangle inequality
   ``|d(x, p) - d(y, p)| <= d(x, y)`` lets only neighbouring bands meet, block by block, inside tasks that emit a
   spanning set of links and no pairs.

Links found that way span the components of the full link graph. Rows are linear in the texts; the
comparisons of step 4 are not, where thousands of texts that are no near copies of one another share most of theirs.

Cases: a null text, or one without words, has the empty set and links with nothing; a text with fewer words than a
shingle is one shingle; repeated rows and ids are single rows of the result; a null id is never a component's name while
there is another; texts of any length are read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textward.llm.common import drop, merged_joins, mix, pieces, save, small_batches, text_buffer, tidy, word_hashes
from textward.llm.components import components, spanning

_K = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(raw: np.ndarray, bounds: np.ndarray, n: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, one after the other, and the rows' bounds among them."""
    h, _, _, first = word_hashes(raw, bounds)
    rows = len(bounds) - 1
    words = np.diff(first)
    full = np.zeros(max(0, len(h) - n + 1), dtype=np.uint64)
    for i in range(n):
        full = full * _K + h[i : len(h) - n + 1 + i] if len(full) else full
    full = mix(full)
    out, size = [], np.zeros(rows + 1, dtype=np.int64)
    for r in range(rows):
        a, w = first[r], words[r]
        if w >= n:
            s = np.sort(full[a : a + w - n + 1])
            if len(s) > 1:
                s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif w:
            x = np.uint64(w)
            with np.errstate(over="ignore"):
                for v in h[a : a + w]:
                    x = x * _K + v
            s = mix(np.array([x ^ _K], dtype=np.uint64))
        else:
            continue
        out.append(s)
        size[r + 1] = len(s)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.cumsum(size)


def points(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each row's set; 0 for empty sets."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets ^ _K))])
    n = np.diff(bounds).astype(np.uint64)
    return np.where(n > 0, mix(sums[bounds[1:]] - sums[bounds[:-1]] + n * _K), np.uint64(0))


def classes(percent: int, most: int) -> np.ndarray:
    """Upper bounds of size classes; a partner's size is at most one class away."""
    out = [100 // (100 - percent) if percent < 100 else 1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, -(-out[-1] * 100 // percent)))
    return np.array(out, dtype=np.int64)


def places(sets: np.ndarray, bounds: np.ndarray, percent: int = 85) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, row) of every row's meeting places, and how many of each row's places may go, by the parity of their class.

    The last bit of a place is the parity of its size class.
    """
    n = np.diff(bounds)
    spared = np.zeros((2, len(n)), dtype=np.int64)
    if not len(n) or not n.max():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), spared
    tops = classes(percent, int(n.max()))
    own = np.searchsorted(tops, n)
    a, b = (mix(sets) >> np.uint64(38)).astype(np.float64), (mix(sets ^ _K) >> np.uint64(38)).astype(np.float64)
    spot = mix(sets + _K) >> np.uint64(12)
    row_of = np.repeat(np.arange(len(n)), n)
    keys, rows = [], []
    for below in (0, 1):
        level = own - below
        top = tops[np.maximum(level, 0)]
        differ = top * (100 - percent) // percent
        parts = differ + np.maximum(1, differ * 5 // 12)
        use = (level >= 0) & (n > 0) & (differ > 0)
        if below:
            use &= n * percent <= top * 100
        if not use.any():
            continue
        parts = np.where(use, parts, 0)
        base = np.concatenate([[0], np.cumsum(parts)])
        chosen = use[row_of]
        r = row_of[chosen]
        at = base[r] + (spot[chosen] % parts[r].astype(np.uint64)).astype(np.int64)
        total = int(base[-1])
        size = np.bincount(at, minlength=total)
        x, y = np.bincount(at, a[chosen], total), np.bincount(at, b[chosen], total)
        owner = np.repeat(np.arange(len(n)), parts)
        equal = np.where(use, parts - differ, 0) - np.bincount(owner[size == 0], minlength=len(n))
        odd = level & 1
        for bit in (0, 1):
            spared[bit] = np.where(use & (odd == bit), np.maximum(equal - 1, 0), spared[bit])
        go = (size > 0) | (equal[owner] < 1)  # where empty parts could be all that two sets share, they count
        o = owner[go]
        part = np.flatnonzero(go) - base[o]
        key = x[go].astype(np.uint64) * _K + y[go].astype(np.uint64)
        key = mix(key) + part.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + top[o].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        key = mix(key ^ (size[go].astype(np.uint64) << np.uint64(48)))
        keys.append((key & ~np.uint64(1)) | odd[o].astype(np.uint64))
        rows.append(o)
    return (np.concatenate(keys), np.concatenate(rows), spared) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64), spared)


def _scan(docs: DataFrame, words: int, percent: int, buckets: int) -> DataFrame:
    """A row per document (id, n, f, spared by parity) and rows (bucket, keys, fs) of meeting places."""
    schema = "id long, n long, f long, even long, odd long, bucket int, keys binary, fs binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def dealt(keys: list[np.ndarray], fs: list[np.ndarray]) -> pa.RecordBatch:
        k, f = np.concatenate(keys), np.concatenate(fs)
        bucket = (k % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        k, f, bucket = (k // np.uint64(buckets))[order].astype(np.uint32), f[order], bucket[order]
        cut = np.searchsorted(bucket, np.arange(buckets + 1))
        some = np.flatnonzero(np.diff(cut))
        none = pa.nulls(len(some), pa.int64())
        blobs = [pa.array([x[cut[i] : cut[i + 1]].tobytes() for i in some], pa.binary()) for x in (k, f)]
        return pa.RecordBatch.from_arrays([none] * 5 + [pa.array(some, pa.int32()), *blobs], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fs, held, seen = [], [], 0, set()
        for b in batches:
            for part in pieces(b, "text"):
                sets, bounds = shingle_sets(*text_buffer(part.column(1)), words)
                f = points(sets, bounds)
                n = np.diff(bounds)
                m = len(n)
                empty = [pa.nulls(m, t) for t in (pa.int32(), pa.binary(), pa.binary())]
                place, row, spared = places(sets, bounds, percent)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(f.view(np.int64)), pa.array(spared[0]), pa.array(spared[1]), *empty], names)
                fresh = np.zeros(m, dtype=bool)  # a set that this task has dealt out before stays at home
                for i, x in enumerate(f.tolist()):
                    if x not in seen:
                        seen.add(x)
                        fresh[i] = True
                if len(seen) > 200_000:
                    seen.clear()
                go = fresh[row]
                keys.append(place[go]), fs.append(f[row[go]])
                held += int(go.sum())
                if held > 1_000_000:
                    yield dealt(keys, fs)
                    keys, fs, held = [], [], 0
        if held:
            yield dealt(keys, fs)

    return docs.mapInArrow(run, schema)


def _cells(t: pa.Table, buckets: int) -> pa.Table:
    """The places of one bucket with at least two points: (cell, f, size, times, odd).

    A cell's name is a hash of its members and its parity; ``times`` places of the bucket are that cell.
    """
    k = np.frombuffer(b"".join(t.column("keys").to_pylist()), dtype=np.uint32)
    f = np.frombuffer(b"".join(t.column("fs").to_pylist()), dtype=np.uint64)
    order = np.argsort(k, kind="stable")
    k, f = k[order], f[order]
    multi = np.zeros(len(k), dtype=bool)
    same = k[1:] == k[:-1]
    multi[1:] |= same
    multi[:-1] |= same
    k, f = k[multi], f[multi]
    order = np.lexsort((f, k))
    k, f = k[order], f[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (f[1:] != f[:-1])])[: len(k)]
    k, f = k[new], f[new]
    start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])[: len(k)])
    size = np.diff(np.concatenate([start, [len(k)]]))
    odd = (k[start].astype(np.int64) * buckets + (t.column("bucket")[0].as_py() if len(t) else 0)) & 1
    name = mix(np.add.reduceat(mix(f ^ _K), start) + size.astype(np.uint64)) if len(k) else np.zeros(0, np.uint64)
    name = mix(name + odd.astype(np.uint64))
    _, first, times = np.unique(name, return_index=True, return_counts=True)
    count = np.zeros(len(start), dtype=np.int64)
    count[first] = times
    count[size < 2] = 0
    go = np.repeat(count > 0, size)
    each = lambda x: np.repeat(x, size)[go]
    return pa.table({"cell": each(name).view(np.int64), "f": f[go].view(np.int64), "size": each(size), "times": each(count), "odd": each(odd.astype(bool))})


def _bitmap(values: DataFrame, column: str, bits: int = 26) -> np.ndarray:
    """A bitmap of fixed size over the hashes of a column: all of its values are in it, most others aren't."""
    blocks = 64
    width = (1 << bits) // 8 // blocks

    def rows_of(blocks_held: dict[int, np.ndarray]) -> pa.RecordBatch:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        return pa.RecordBatch.from_arrays([pa.array(list(blocks_held), pa.int32()), pa.array([squeeze(x.tobytes()) for x in blocks_held.values()], pa.binary())], ["block", "bits"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((1 << bits) // 8, dtype=np.uint8)
        for b in batches:
            slot = b.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)
            np.bitwise_or.at(seen, (slot >> np.uint64(3)).astype(np.int64), np.uint8(128) >> (slot & np.uint64(7)).astype(np.uint8))
        seen = seen.reshape(blocks, width)
        yield rows_of({int(i): seen[i] for i in np.flatnonzero(seen.any(axis=1))})

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = opened(x.as_py())
                held[i] = held[i] | x if i in held else x
        yield rows_of(held)

    def opened(x: bytes) -> np.ndarray:
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), dtype=np.uint8)

    marked = values.select(column).mapInArrow(mark, "block int, bits binary").repartition(blocks, "block").mapInArrow(join, "block int, bits binary").collect()
    out = np.zeros((blocks, width), dtype=np.uint8)
    for r in marked:
        out[r["block"]] |= opened(r["bits"])
    return out.ravel()


def _sets_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(f, s): the sorted shingles of the wanted points (f), one row each."""
    bits = 26
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted, "f", bits))  # 8 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, seen = bitmap.value, set()
        for b in batches:
            for part in pieces(b, "text"):
                sets, bounds = shingle_sets(*text_buffer(part.column(0)), words)
                f = points(sets, bounds)
                slot = f >> np.uint64(64 - bits)
                hit = (marks[slot >> np.uint64(3)] >> (np.uint64(7) - (slot & np.uint64(7))).astype(np.uint8)) & 1
                at = []
                for i in np.flatnonzero(hit & (np.diff(bounds) > 0)):
                    if int(f[i]) not in seen:
                        seen.add(int(f[i]))
                        at.append(i)
                if len(seen) > 200_000:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(f[at].view(np.int64)), pa.array([sets[bounds[i] : bounds[i + 1]].tobytes() for i in at], pa.binary())], ["f", "s"])

    return docs.select("text").mapInArrow(run, "f long, s binary").join(wanted, "f", "left_semi").dropDuplicates(["f"])


def _verify(pairs: DataFrame, sets: DataFrame, sizes: DataFrame, most: int = 4 << 20) -> DataFrame:
    """(x, p) -> (x, p, nx, np, common), exactly.

    A pivot's pairs are dealt to parts of about ``most`` bytes of sets; each part gets the pivot's set once, before the others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.uint64)
        for b in batches:
            xs, ps, nx, n_p, common = [], [], [], [], []
            for p, x, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if x is None:
                    held = np.frombuffer(s.as_py(), dtype=np.uint64)
                    continue
                own = np.frombuffer(s.as_buffer(), dtype=np.uint64)
                at = np.searchsorted(held, own)
                at[at == len(held)] = 0
                xs.append(x), ps.append(p), nx.append(len(own)), n_p.append(len(held)), common.append(int((held[at] == own).sum()))
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (xs, ps, nx, n_p, common)], ["x", "p", "nx", "np", "common"])

    weighed = pairs.join(sizes.withColumnRenamed("f", "x"), "x")
    parts = weighed.groupBy("p").agg(F.ceil(F.sum(F.col("n") * 8) / most).cast("int").alias("parts"))
    dealt = pairs.join(parts, "p").select("p", F.pmod(F.xxhash64("x"), F.col("parts")).cast("int").alias("part"), "x")
    others = dealt.join(sets.withColumnRenamed("f", "x"), "x").select("p", "part", "x", "s")
    pivots = parts.join(sets.withColumnRenamed("f", "p"), "p").select("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("x"), "s")
    both = pivots.union(others).repartition("p", "part").sortWithinPartitions("p", "part", F.col("x").asc_nulls_first())
    return both.select("p", "x", "s").mapInArrow(run, "x long, p long, nx long, np long, common long")


def _linked(v: DataFrame, percent: int) -> DataFrame:
    return v.where(F.col("common") * 100 >= (F.col("nx") + F.col("np") - F.col("common")) * percent).select(F.col("x").alias("a"), F.col("p").alias("b"))


def jaccard_classes(docs: DataFrame, words: int = 4, percent: int = 85, key: str = "doc_id", text: str = "text", few: int = 16) -> DataFrame:
    """Per row: the key, n_shingles and component_id, the smallest key reachable by links."""
    spark = docs.sparkSession
    with small_batches(spark), merged_joins(spark):
        own, of = _classes(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), words, percent, few)
    out = own.join(of.hint("merge"), "f", "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))


def _classes(slim: DataFrame, words: int, percent: int, few: int) -> tuple[DataFrame, DataFrame]:
    """(id, n, f) of all rows, and (f, component_id) of all points."""
    spark = slim.sparkSession
    read = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, read >> 23)  # a bucket has the places of about 8 MB of text
    scanned, scan_path = save(_scan(slim, words, percent, buckets))
    own, _ = save(scanned.where("bucket is null").select("id", "n", "f", "even", "odd"))
    cells = scanned.where("bucket is not null").select("bucket", "keys", "fs").groupBy("bucket").applyInArrow(lambda t: _cells(t, buckets), "cell long, f long, size long, times long, odd boolean")
    cells = cells.groupBy("cell", "f", "size", "odd").agg(F.sum("times").alias("times"))
    # a point leaves its most frequented places, as many as it can spare
    spared = own.groupBy("f").agg(F.first("even").alias("even"), F.first("odd").alias("many"))
    ranked = cells.join(spared, "f").withColumn("rank", F.sum("times").over(W.partitionBy("f", "odd").orderBy(F.desc("size"), "cell")))
    cells, cells_path = save(ranked.where(F.col("rank") > F.when(F.col("odd"), F.col("many")).otherwise(F.col("even"))).select("cell", "f"))
    alone = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cell")
    cells, path = save(cells.join(alone, "cell"))
    drop(spark, cells_path)
    cells_path = path
    drop(spark, scan_path)
    tidy(spark)
    sets, sets_path = save(_sets_of(slim, cells.select("f").distinct(), words))
    tidy(spark)
    # a pivot is the place's point with most copies: edited copies lie around the text that they were made from
    copies = own.groupBy("f").agg((-F.count(F.lit(1))).alias("c"), F.first("n").alias("n"))
    sizes = copies.select("f", "n")
    pivots = cells.join(copies, "f").groupBy("cell").agg(F.min(F.struct("c", "f"))["f"].alias("p"))
    pairs, pairs_path = save(cells.join(pivots, "cell").where("f <> p").select(F.col("f").alias("x"), "p").distinct())
    known, known_path = save(_verify(pairs, sets, sizes))
    drop(spark, pairs_path)
    tidy(spark)
    edges, edges_path = save(_linked(known, percent))
    roots, _ = save(components(edges))
    member = cells.join(roots.withColumnRenamed("v", "f"), "f", "left").select("cell", "f", F.coalesce("root", "f").alias("root"))
    spread = member.groupBy("cell").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi")
    member, member_path = save(member.join(spread.select("cell", "size"), "cell"))
    small = member.where(F.col("size") <= few)
    left, right = small.select("cell", F.col("f").alias("x"), F.col("root").alias("rx")), small.select("cell", F.col("f").alias("p"), F.col("root").alias("rp"))
    tried = left.join(right, "cell").where("x > p and rx <> rp").select("x", "p").distinct()
    done = known.select("x", "p").union(known.select(F.col("p").alias("x"), F.col("x").alias("p")))
    tried, tried_path = save(tried.join(done, ["x", "p"], "left_anti"))
    more, more_path = save(_linked(_verify(tried, sets, sizes), percent).union(_regions(member.where(F.col("size") > few), pivots, known, sets, sizes, percent)))
    tidy(spark)
    if not more.isEmpty():
        roots, _ = save(components(roots.where("v <> root").select(F.col("v").alias("a"), F.col("root").alias("b")).union(more)))
    name = own.where("n > 0").groupBy("f").agg(F.min("id").alias("least"))
    name = name.join(roots.select(F.col("v").alias("f"), "root"), "f", "left").select("f", "least", F.coalesce("root", "f").alias("root"))
    names = name.groupBy("root").agg(F.min("least").alias("component_id"))
    of, _ = save(name.join(names, "root").select("f", "component_id"))
    drop(spark, cells_path, sets_path, known_path, edges_path, member_path, tried_path, more_path)
    tidy(spark)
    return own, of


def _regions(member: DataFrame, pivots: DataFrame, known: DataFrame, sets: DataFrame, sizes: DataFrame, percent: int, block: int = 2048, most: int = 8 << 20) -> DataFrame:
    """Links across components inside large places: (a, b) edges that span them.

    A point's region is that of its most used pivot. A region of more than ``block`` points or ``most`` bytes of sets is cut
    in bands by the distance to the pivot, each as wide as the radius, and in blocks of about that size. Points within the radius lie in the same or in neighbouring bands of
    a region; blocks of different regions meet where they share a place. A task compares two blocks, and no pair leaves
    it, but a spanning set of the links.
    """
    radius = (100 - percent) / 100
    under = member.join(pivots, "cell")
    weight = under.groupBy("p").agg(F.count(F.lit(1)).alias("w"))
    home = under.join(weight, "p").groupBy("f").agg(F.max(F.struct("w", "p"))["p"].alias("p"), F.first("root").alias("root"))
    distance = known.select(F.col("x").alias("f"), "p", (1 - F.col("common") / (F.col("nx") + F.col("np") - F.col("common"))).alias("d"))
    placed = home.join(distance, ["f", "p"], "left")  # a pivot has no distance to itself: 0
    placed = placed.join(sizes, "f").select("f", "root", "p", "n", F.floor(F.coalesce("d", F.lit(0.0)) / (radius + 1e-9)).alias("band"))
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("n") * 8 / most))
    placed = placed.join(placed.groupBy("p").agg((blocks == 1).alias("whole")), "p").withColumn("band", F.when(F.col("whole"), F.lit(0)).otherwise(F.col("band")))
    placed = placed.join(placed.groupBy("p", "band").agg(blocks.alias("blocks")), ["p", "band"]).withColumn("block", F.xxhash64("p", "band", F.pmod(F.xxhash64("f"), F.col("blocks"))))
    placed, _ = save(placed.select("f", "root", F.col("p").alias("region"), "band", "block"))
    meets = member.select("cell", "f").join(placed.select("f", "region", "band", "block"), "f").select("cell", "region", "band", "block").distinct()
    one = meets.select("cell", *[F.col(c).alias(f"{c}1") for c in ("region", "band", "block")])
    two = meets.select("cell", *[F.col(c).alias(f"{c}2") for c in ("region", "band", "block")])
    near = (F.col("region1") != F.col("region2")) | (F.abs(F.col("band1") - F.col("band2")) <= 1)
    tasks, _ = save(one.join(two, "cell").where((F.col("block1") <= F.col("block2")) & near).select("block1", "block2").distinct())
    held = placed.select("f", "root", "block").join(sets, "f")
    sides = [held.join(tasks.withColumn("block", F.col(c)).where(w), "block").select("block1", "block2", F.lit(c == "block1").alias("first"), "f", "root", "s") for c, w in (("block1", "true"), ("block2", "block1 <> block2"))]

    def compare(t: pa.Table) -> pa.Table:
        first = t.column("first").to_numpy(zero_copy_only=False).astype(bool)
        f, root = t.column("f").to_numpy(), t.column("root").to_numpy()
        s = [np.frombuffer(x, dtype=np.uint64) for x in t.column("s").to_pylist()]
        a = np.flatnonzero(first)
        b = np.flatnonzero(~first) if not first.all() else a
        if not len(a) or not len(b):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        n = np.array([len(x) for x in s], dtype=np.int64)
        values, owner = np.concatenate([s[i] for i in b]), np.repeat(np.arange(len(b)), n[b])
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        hit = np.zeros((len(a), len(b)), dtype=bool)
        for i, x in enumerate(a):
            lo, hi = np.searchsorted(values, s[x], "left"), np.searchsorted(values, s[x], "right")
            size = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            common = np.bincount(owner[at], minlength=len(b))
            hit[i] = (common * 100 >= (n[x] + n[b] - common) * percent) & (root[x] != root[b])
        ids, names = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for u, r in spanning(hit, f[a], f[b]):
            ids.append(u), names.append(r)
        return pa.table({"a": np.concatenate(ids), "b": np.concatenate(names)})

    return sides[0].union(sides[1]).groupBy("block1", "block2").applyInArrow(compare, "a long, b long")
