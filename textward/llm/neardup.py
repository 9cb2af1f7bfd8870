"""Embedding near-duplicates: spherical k-means cells, blocked cosine products within and between cells.

Exact, whatever the cells are. A vector's home is the cell of its nearest centroid. A partner y of x (angle at most
delta) can have its home in cell c only if x is within delta of c's side of the plane between c and x's own centroid h:
``x.(h - c) <= sin(delta) |h - c|``, and y likewise of h's side. So two cells meet only if both hold vectors that pass this
test, and only those that pass it are compared.

Every vector is stored once, in a block of its cell of about ``block`` rows. Blocks meet in a Cartesian product of the
stored table, which is read again instead of being shuffled: disk is linear in the input, however many cells a vector could
visit. A pair of blocks is compared on one side only. First in single precision, by an upper bound from some dimensions of
a rotated basis and the lengths of the rest (Cauchy-Schwarz: ``x.y <= Px.Py + |Qx||Qy|``); what passes, exactly. Tasks
add up links by vector, and emit a spanning set of them, no pairs. Equal vectors are joined to one before, with their number.

Cases: null, zero and non-finite vectors, and those with null components, link with nothing; rows of the same vec_id are
separate vectors but share a component id if they link; an empty table gives no rows; other columns are ignored.
Vectors of different lengths never link.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textward.llm.common import drop, save, small_batches, tidy
from textward.llm.components import components, spanning, stars


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, x array<double>) of the rows that take part."""
    x = F.col(vector)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    return vectors.select(F.col(key).alias("id"), x.cast("array<double>").alias("x")).where(x.isNotNull() & fine)


def rows(column: pa.Array) -> np.ndarray:
    """A list column of one length as a matrix."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    top = np.abs(x).max(axis=1, keepdims=True)
    x = x / top
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def spherical_kmeans(vectors: DataFrame, dim: int, k: int, rounds: int = 4) -> np.ndarray:
    """Unit centroids from (x) rows of one length. All rows take part; tasks send sums by cell, which are added per cell."""
    first = vectors.select("x").orderBy(F.xxhash64("x")).limit(k).toPandas()["x"]
    centroids = unit(np.array(first.tolist(), dtype=np.float64).reshape(-1, dim))
    for _ in range(rounds):
        c = centroids

        def sums(batches: Iterator[pa.RecordBatch], c=c) -> Iterator[pa.RecordBatch]:
            total, seen = np.zeros_like(c), np.zeros(len(c), dtype=bool)
            for b in batches:
                x = unit(rows(b.column(0)))
                cell = np.argmax(x @ c.T, axis=1)
                np.add.at(total, cell, x)
                seen[cell] = True
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(list(total[at]), pa.list_(pa.float64()))], ["cell", "s"])

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"cell": pdf["cell"].iloc[:1], "s": [np.sum(np.stack(pdf["s"].to_numpy()), axis=0)]})

        got = vectors.select("x").mapInArrow(sums, "cell int, s array<double>").groupBy("cell").applyInPandas(add, "cell int, s array<double>").toPandas()
        new = centroids.copy()
        for cell, s in zip(got["cell"], got["s"], strict=True):
            if np.any(s):
                new[cell] = s
        centroids = unit(new)
    return centroids


def _typed(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, x) of all rows: x as stored if of floats, else as doubles; null where it takes no part."""
    kind = vectors.select(F.col(vector).alias("x")).schema["x"].dataType
    x = F.col(vector) if kind.elementType.typeName() == "float" else F.col(vector).cast("array<double>")
    return vectors.select(F.col(key).alias("id"), F.when(_is_fine(vector), x).alias("x"))


_LAST = (1 << 63) - 1
#: Two hashes of a vector name it in narrow tables.
_NAME = (F.xxhash64, lambda x: F.xxhash64(F.lit(7), x))


def near_duplicates(
    vectors: DataFrame,
    least: float = 0.95,
    key: str = "vec_id",
    vector: str = "embedding",
    cells: int | None = None,
    block: int = 4096,
) -> DataFrame:
    """One row per vector: the key, n_links, component_id, kept."""
    spark = vectors.sparkSession
    typed = _typed(vectors, key, vector)
    equal = typed.where("x is not null").groupBy("x").agg(F.min("id").alias("v"), F.count(F.lit(1)).alias("copies"))
    # vectors that have null ids alone are named behind all ids, and give no component a name
    u = F.monotonically_increasing_id()
    distinct, distinct_path = save(equal.withColumn("u", u).withColumn("v", F.coalesce("v", F.lit(_LAST) - F.col("u"))))
    tidy(spark)
    names, names_path = save(distinct.select("u", "v", "copies", *[f("x").alias(f"h{i}") for i, f in enumerate(_NAME)]))
    shapes = distinct.groupBy(F.size("x").alias("dim")).agg(F.sum("copies").alias("n")).collect()  # one row per vector length
    found: list[tuple[DataFrame, str]] = []
    for s in sorted(shapes, key=lambda r: r["dim"]):
        one = distinct.where(F.size("x") == s["dim"]).select("u", "v", "copies", "x")
        k = cells or max(1, min(256, round(math.sqrt(s["n"]) / 16)))
        found.append(_blocked(one, spherical_kmeans(one, s["dim"], k), least, block))
    drop(spark, distinct_path)
    if not found:
        return typed.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    held = found[0][0]
    for x, _ in found[1:]:
        held = held.union(x)
    counts = held.where("u is not null").groupBy("u").agg(F.sum("n").alias("n"))
    # an equal vector is a link, too; roots are the smallest ids of their vectors
    roots = components(held.where("u is null").select("a", "b"))
    per = names.join(counts, "u", "left").join(roots.withColumnRenamed("v", "_v"), F.col("v") == F.col("_v"), "left")
    n_links = F.coalesce("n", F.lit(0)) + F.col("copies") - 1
    root = F.coalesce("root", "v")
    per, _ = save(per.where((n_links > 0) | F.col("root").isNotNull()).select("h0", "h1", n_links.alias("n_links"), F.when(root <= _LAST - (1 << 50), root).alias("component")))
    drop(spark, names_path, *[p for _, p in found])
    tidy(spark)
    own = typed.select("id", *[F.when(F.col("x").isNotNull(), f("x")).alias(f"h{i}") for i, f in enumerate(_NAME)]).join(per, ["h0", "h1"], "left")
    component = F.coalesce("component", "id")
    return own.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def _is_fine(vector: str):
    x = F.col(vector)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    return F.coalesce(x.isNotNull() & fine, F.lit(False))


def lowered(x: np.ndarray) -> np.ndarray | None:
    """Some dimensions of unit vectors in a rotated basis, and the length of the rest: products are bounds of cosines."""
    dim = x.shape[1]
    if dim < 32:
        return None
    basis, _ = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    y = x @ basis[:, : max(16, dim * 3 // 8)]
    rest = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", y, y)))
    return np.concatenate([y, rest[:, None]], axis=1).astype(np.float32)


def linked(x: np.ndarray, y: np.ndarray, least: float, lx: np.ndarray | None, ly: np.ndarray | None) -> Iterator[tuple[slice, slice, np.ndarray | None, np.ndarray | None, np.ndarray | None]]:
    """Tile by tile: its rows of x and of y, and either all of its links as a matrix or, where few can be, as pairs."""
    for i in range(0, len(x), 256):
        for j in range(0, len(y), 1024):
            a, b = slice(i, min(i + 256, len(x))), slice(j, min(j + 1024, len(y)))
            if lx is not None:
                bound = lx[a] @ ly[b].T
                if bound.max() < least - 1e-5:
                    continue
                at = np.flatnonzero(bound >= least - 1e-5)
                if len(at) * 16 < bound.size:
                    r, c = np.divmod(at, bound.shape[1])
                    hit = np.einsum("ij,ij->i", x[a][r], y[b][c]) >= least
                    yield a, b, None, r[hit], c[hit]
                    continue
            yield a, b, x[a] @ y[b].T >= least, None, None


_BLOCK = "b long, cell int, meets array<int>, us binary, vs binary, cs binary, xs binary"


def _blocked(one: DataFrame, centroids: np.ndarray, least: float, block: int) -> tuple[DataFrame, str]:
    """Rows (u, n), a part of u's links, and rows (a, b), edges that span the links of a task; and their path."""
    spark = one.sparkSession
    k, dim = centroids.shape
    kind = np.dtype(np.float32 if one.schema["x"].dataType.elementType.typeName() == "float" else np.float64)
    reach = math.sin(math.acos(min(1.0, least))) + 1e-9
    gap = np.linalg.norm(centroids[:, None, :] - centroids[None, :, :], axis=2)

    def cell_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = np.argmax(unit(rows(b.column(3))) @ centroids.T, axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32))], ["u", "v", "copies", "x", "cell"])

    def near(x: np.ndarray, h: int, c: int | slice) -> np.ndarray:
        """Which rows of cell h pass the test for cells c."""
        return (x @ centroids[h])[:, None] - x @ np.atleast_2d(centroids[c]).T <= reach * gap[h, c]

    def packed(t: pa.Table) -> pa.Table:
        raw = rows(t.column("x").combine_chunks())
        h, part = t.column("cell")[0].as_py(), t.column("part")[0].as_py()
        meets = np.union1d(np.flatnonzero(near(unit(raw), h, slice(None)).any(axis=0)), [h])
        blob = lambda x, kind: pa.array([np.ascontiguousarray(x, dtype=kind).tobytes()], pa.binary())
        numbers = [blob(t.column(c).to_numpy(), np.int64) for c in ("u", "v", "copies")]
        return pa.table([pa.array([h << 32 | part]), pa.array([h], pa.int32()), pa.array([meets], pa.list_(pa.int32())), *numbers, blob(raw, kind)], names=[x.split()[0] for x in _BLOCK.split(", ")])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[tuple[np.ndarray, np.ndarray]] = []
        edges: list[tuple[np.ndarray, np.ndarray]] = []
        names = ["u", "n", "a", "b"]

        def summed() -> tuple[np.ndarray, np.ndarray]:
            u, at = np.unique(np.concatenate([x for x, _ in counts]), return_inverse=True)
            n = np.zeros(len(u), dtype=np.int64)
            np.add.at(n, at, np.concatenate([x for _, x in counts]))
            return u, n

        def rows_of(pair: tuple[np.ndarray, np.ndarray], first: int) -> pa.RecordBatch:
            columns = [pa.nulls(len(pair[0]), pa.int64())] * 4
            columns[first], columns[first + 1] = (pa.array(x.astype(np.int64)) for x in pair)
            return pa.RecordBatch.from_arrays(columns, names)

        def side(b: pa.RecordBatch, i: int, at: int) -> tuple:
            u, v, c = (np.frombuffer(b.column(at + 3 + j)[i].as_buffer(), dtype=np.int64) for j in range(3))
            return b.column(at)[i].as_py(), b.column(at + 1)[i].as_py(), u, v, c, np.frombuffer(b.column(at + 6)[i].as_buffer(), dtype=kind).reshape(-1, dim)

        opened: dict[int, tuple[int, np.ndarray, np.ndarray | None]] = {}

        def of(at: int, name: int, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
            if opened.get(at, (None,))[0] != name:  # the left block stays for many right ones
                x = unit(raw)
                opened[at] = name, x, lowered(x)
            return opened[at][1:]

        for batch in batches:
            for i in range(batch.num_rows):
                one_name, h, u1, v1, c1, raw1 = side(batch, i, 0)
                two_name, c, u2, v2, c2, raw2 = side(batch, i, 7)
                (x, lx), (y, ly) = of(0, one_name, raw1), of(1, two_name, raw2)
                if h != c:
                    p, q = near(x, h, c)[:, 0], near(y, c, h)[:, 0]
                    x, y, u1, v1, k1, u2, v2, k2 = x[p], y[q], u1[p], v1[p], c1[p], u2[q], v2[q], c2[q]
                    lx, ly = (None, None) if lx is None else (lx[p], ly[q])
                else:
                    k1, k2 = c1, c2
                n1, n2 = np.zeros(len(x), dtype=np.int64), np.zeros(len(y), dtype=np.int64)
                same = one_name == two_name
                for a, b, hit, r, s in linked(x, y, least, lx, ly):
                    if hit is None:
                        if same:
                            r, s = r[(go := u1[a][r] != u2[b][s])], s[go]
                        np.add.at(n1[a], r, k2[b][s])
                        if not same:
                            np.add.at(n2[b], s, k1[a][r])
                        edges.append((v1[a][r], v2[b][s]))
                    else:
                        if same:
                            hit &= u1[a][:, None] != u2[b][None, :]
                        n1[a] += hit @ k2[b]
                        if not same:
                            n2[b] += hit.T @ k1[a]
                        edges.extend(spanning(hit, v1[a], v2[b]))
                counts.extend((u[n > 0], n[n > 0]) for u, n in ((u1, n1), (u2, n2)))
                if sum(len(x) for x, _ in counts) > 1_000_000:
                    counts = [summed()]
                    if len(counts[0][0]) > 500_000:
                        yield rows_of(counts[0], 0)
                        counts = []
                if sum(len(x) for x, _ in edges) > 1_000_000:
                    edges = [stars(*(np.concatenate([e[j] for e in edges]) for j in (0, 1)))]
                    if len(edges[0][0]) > 500_000:
                        yield rows_of(edges[0], 2)
                        edges = []
        if counts:
            yield rows_of(summed(), 0)
        if edges:
            yield rows_of(stars(*(np.concatenate([e[j] for e in edges]) for j in (0, 1))), 2)

    with small_batches(spark):
        placed = one.mapInArrow(cell_of, "u long, v long, copies long, x " + one.schema["x"].dataType.simpleString() + ", cell int")
        sizes = one.select("x").mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array(np.argmax(unit(rows(b.column(0))) @ centroids.T, axis=1).astype(np.int32))], ["cell"]) for b in bs), "cell int")
        sizes = {r["cell"]: r["n"] for r in sizes.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most k rows
        parts = F.element_at(F.array(*[F.lit(max(1, -(-sizes.get(i, 0) // block))) for i in range(k)]), F.col("cell") + 1)
        placed = placed.withColumn("part", F.pmod(F.xxhash64("u"), parts).cast("int"))
        blocks, blocks_path = save(placed.groupBy("cell", "part").applyInArrow(packed, _BLOCK))
        tidy(spark)
        fields = [x.split()[0] for x in _BLOCK.split(", ")]
        left, right = (blocks.select(*[F.col(c).alias(f"{c}{i}") for c in fields]) for i in (1, 2))
        # of two blocks one is the left one, either as often as the other
        once = F.when((F.col("b1") + F.col("b2")) % 2 == 0, F.col("b1") <= F.col("b2")).otherwise(F.col("b1") > F.col("b2"))
        meeting = once & F.array_contains("meets1", F.col("cell2")) & F.array_contains("meets2", F.col("cell1"))
        out = save(left.hint("shuffle_replicate_nl").join(right, meeting).mapInArrow(products, "u long, n long, a long, b long"))
        drop(spark, blocks_path)
    return out
