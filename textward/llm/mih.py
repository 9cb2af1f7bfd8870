"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes.

Fit (bounded sample of ``fit_rows`` vectors): vectors are lifted by one coordinate so that the largest inner product is the
smallest angle, centred, and ``bits`` signs are taken after rotations learned by iterative quantisation, one for each
group of as many bits as the lifted vectors have coordinates.

Index and search: every vector's code is cut into substrings of 16 bits; each of the m substrings has its own table of buckets.
A code within Hamming distance ``m r + m - 1`` of the query's agrees with it to within r bits in one of its m substrings, so
probing the buckets within r bits of the query's substrings retrieves all such codes; beyond the level where buckets
outnumber the rows, a table is read along its column instead. The codes within that radius are reranked by the exact inner
product in double precision. Each query's radius is its own: r grows until the radius exceeds the Hamming distance that
vectors at the angle of its k-th best have, by ``margin`` standard deviations of a code's distance, or all rows are seen.

The index is dealt to shards; the queries stream past every shard in blocks, and a shard returns k rows a query at most.
Recall on the synthetic vectors, measured against brute force, is in the README.

Cases: rows of one id are one query, however often they are repeated: a candidate row counts once, by its largest
product with any of them. Null, zero and non-finite vectors, and those with null components, take no part, neither as queries nor as
candidates. Rows with the query's own vec_id are its own. Ties go to the smaller vec_id. Fewer candidates than k: all are
returned. Vectors of another length than the commonest are a separate index. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textward.llm.common import save
from textward.llm.neardup import rows, usable

_COUNT = np.bitwise_count(np.arange(1 << 16, dtype=np.uint16))
#: All differences of 16 bits, few bits first, and how many have up to r of them.
_MASKS = np.argsort(_COUNT, kind="stable").astype(np.uint16)
_WITHIN = np.cumsum(np.bincount(_COUNT))


class Codes:
    """Learned signs: lift, centre, rotate."""

    def __init__(self, sample: np.ndarray, norm: float, bits: int, rounds: int = 20, seed: int = 5):
        self.norm = norm
        x = self.lift(sample)
        self.mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
        self.mean[-1] = 0.0
        x = x - self.mean
        dim, rng, parts, left = x.shape[1], np.random.default_rng(seed), [], bits
        while left > 0:
            r, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
            for _ in range(rounds if len(x) else 0):
                u, _, vt = np.linalg.svd(np.sign(x @ r).T @ x)
                r = (u @ vt).T
            parts.append(r[:, : min(left, dim)])
            left -= dim
        self.rotation = np.hstack(parts)

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.maximum(0.0, self.norm**2 - np.einsum("ij,ij->i", x, x))
        return np.hstack([x, np.sqrt(rest)[:, None]]) / (self.norm or 1.0)

    def of(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        if query:
            n = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
            x = np.hstack([x / n, np.zeros((len(x), 1))])
        else:
            x = self.lift(x)
        return np.packbits((x - self.mean) @ self.rotation > 0, axis=1)


class Tables:
    """One table of buckets for each substring of 16 bits."""

    def __init__(self, codes: np.ndarray):
        codes = np.pad(codes, ((0, 0), (0, -codes.shape[1] % 8)))
        self.n = len(codes)
        self.sub = np.ascontiguousarray(codes.view(np.uint16).T)
        self.m = len(self.sub)
        self.order = np.argsort(self.sub, axis=1, kind="stable")
        self.starts = np.stack([np.concatenate([[0], np.cumsum(np.bincount(c, minlength=1 << 16))]) for c in self.sub])
        self.words = codes.copy().view(np.uint64)

    def near(self, code: np.ndarray, r: int) -> np.ndarray:
        """Rows of which a substring is within r bits of the code's: all rows within ``m r + m - 1`` bits are among them."""
        keys = np.pad(code, (0, -len(code) % 8)).view(np.uint16)
        buckets = int(_WITHIN[min(r, 16)])
        seen = np.zeros(self.n, dtype=bool)
        if buckets * 8 < self.n:
            table = np.repeat(np.arange(self.m), buckets)
            bucket = (keys[:, None] ^ _MASKS[:buckets]).ravel().astype(np.int64)
            begin = self.starts[table, bucket]
            size = self.starts[table, bucket + 1] - begin
            at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
            seen[self.order[np.repeat(table, size), at]] = True
        else:
            for column, key in zip(self.sub, keys, strict=True):
                seen |= np.bitwise_count(column ^ key) <= r
        return np.flatnonzero(seen)

    def distance(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        word = np.pad(code, (0, -len(code) % 8)).view(np.uint64)
        return np.bitwise_count(self.words[at] ^ word).sum(axis=1, dtype=np.int32)

    def nearest(self, code: np.ndarray, x: np.ndarray, q: np.ndarray, allowed: np.ndarray, k: int, bits: int, norm: float, margin: float) -> tuple[np.ndarray, np.ndarray, int]:
        """The k best rows and ties of the last, their products, and how many rows were retrieved."""
        r, most = 0, int(allowed.sum())
        scale = float(np.sqrt(q @ q)) * (norm or 1.0)
        while True:
            got = self.near(code, r)
            reach, whole = self.m * r + self.m - 1, len(got) == self.n
            far = None if whole else self.distance(code, got)
            at = got if whole else got[far <= reach]
            at = at[allowed[at]]
            score = x[at] @ q if len(at) * 4 < self.n else (x @ q)[at]  # copying most rows takes longer than their products
            wanted = r + 1
            if len(at) >= min(k, most) and len(at):
                last = np.partition(score, -min(k, len(at)))[-min(k, len(at))]
                share = float(np.arccos(np.clip(last / scale, -1.0, 1.0))) / np.pi
                radius = bits * share + margin * np.sqrt(bits * share * (1 - share))
                if reach >= radius or whole:
                    keep = score >= last
                    return at[keep], score[keep], len(got)
                wanted = max(wanted, int(np.ceil((radius - self.m + 1) / self.m)))
            elif whole:
                return at, score, len(got)
            else:  # the k-th nearest code retrieved bounds how far the next probe has to reach
                far = far[allowed[got]]
                if len(far) >= k:
                    wanted = max(wanted, -(-(int(np.partition(far, k - 1)[k - 1]) - self.m + 1) // self.m))
            r = min(16, wanted)


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    key: str = "vec_id",
    vector: str = "embedding",
    bits: int = 256,
    margin: float = 1.0,
    fit_rows: int = 20_000,
    shard_rows: int = 32768,
) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest by inner product. ``is_query`` is a condition on ``id``."""
    fine, _ = save(usable(vectors, key, vector).where(F.col("id").isNotNull()).withColumn("row", F.monotonically_increasing_id()))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))
    shapes = fine.groupBy(F.size("x").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("norm")).collect()
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for s in sorted(shapes, key=lambda r: r["dim"]):
        one = fine.where(F.size("x") == s["dim"])
        share = min(1.0, 1.2 * fit_rows / s["n"])
        sample = one.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share * 1_000_000).select("x").limit(fit_rows).toPandas()["x"]
        codes = Codes(np.array(sample.tolist(), dtype=np.float64).reshape(-1, s["dim"]), float(s["norm"]), bits)
        out = out.union(_search(one, is_query, codes, s["n"], k, bits, margin, shard_rows))
    return out


def _search(one: DataFrame, is_query: Column, codes: Codes, n: int, k: int, bits: int, margin: float, shard_rows: int) -> DataFrame:
    shards = max(-(-n // shard_rows), min(16, -(-n // 2048)))  # small tables still use several tasks
    index = one.select(F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("query"), "id", "x", "row")
    queries = one.where(is_query).groupBy("id", "x").agg(F.min("row").alias("row"))
    several = queries.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() > 0  # an id with different vectors
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("query"), "id", "x", "row")
    dealt = index.union(asked).repartition(shards, "shard").sortWithinPartitions("shard", "query")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, held = None, [], None
        for b in batches:
            where, asks = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            cuts = np.flatnonzero((where[1:] != where[:-1]) | (asks[1:] != asks[:-1])) + 1
            for i, j in zip([0, *cuts], [*cuts, len(where)], strict=True):
                part = b.slice(i, j - i)
                if where[i] != shard:
                    shard, parts, held = where[i], [], None
                if not asks[i]:
                    parts.append((part.column(2).to_numpy(), rows(part.column(3)), part.column(4).to_numpy()))
                    continue
                if held is None and parts:
                    ids, x, row = (np.concatenate([p[c] for p in parts]) for c in range(3))
                    held = (Tables(codes.of(x)), ids, x, row)
                if held is not None:
                    yield from answers(part, *held)

    def answers(part: pa.RecordBatch, tables: Tables, ids: np.ndarray, x: np.ndarray, row: np.ndarray) -> Iterator[pa.RecordBatch]:
        q_ids, q = part.column(2).to_numpy(), rows(part.column(3))
        got: list[list[np.ndarray]] = [[], [], [], []]
        for qid, qx, code in zip(q_ids, q, codes.of(q, query=True), strict=True):
            at, score, _ = tables.nearest(code, x, qx, ids != qid, k, bits, codes.norm, margin)
            best = np.lexsort((row[at], ids[at], -score))[:k]
            for c, v in zip(got, (np.full(len(best), qid), ids[at][best], score[best], row[at][best]), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in got], ["query_id", "vec_id", "score", "row"])

    hits = dealt.mapInArrow(probe, "query_id long, vec_id long, score double, row long")
    if several:
        hits = hits.groupBy("query_id", "row").agg(F.first("vec_id").alias("vec_id"), F.max("score").alias("score"))
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id", "row"))
    return hits.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
