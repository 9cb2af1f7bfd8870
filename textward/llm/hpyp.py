"""LM scoring by a hierarchical Pitman-Yor model.

Restaurants: every previous word has one. The ``contexts`` most frequent words have their own; their number grows as the 0.4th
power of the tokens, and they are counted exactly in all training texts. Rarer words share restaurants with others of their word-ending class by
hash, as many as frequent ones. Their parents are the restaurants of the 63 classes and of the start of a text, which
share the root; its base is uniform over the training words and one unknown word.

Seating is sampled by Gibbs on the number of tables of each dish. In dishes of few customers a move takes a customer away,
who sat alone with probability S(c - 1, t - 1) / S(c, t) (generalised Stirling numbers), and seats them again, at a new table
with weight w = (theta + d T) times the parent's probability. Dishes of more have their number of tables drawn from what such
moves lead to, proportional to S(c, t) w^t: exactly to 256 customers, and beyond by S at its saddle point. A table is a customer of the parent
restaurant. After the burn-in every sample gives predictive probabilities, and their mean is what a text is scored by.

Distribution: texts are cut in chunks; each chunk's distinct (word, context) cells go, as columns of numbers, to buckets of
words by hash. A bucket has every cell of its words on all levels, so that only the totals of the (boundedly many)
restaurants are shared between buckets. Buckets are sampled twice, with the same random numbers: first for the totals of
every sample, which are added up over all buckets, then for the probabilities, which take these totals, so that in each sample each
context's probabilities sum to 1. While sampling, a bucket estimates a context's tables by its customers in all data and the tables per customer
that the bucket has seen, and takes its own share of a class times the number of buckets. All counts are exact.

Cases: a null text is empty and has its end alone; null ids keep their row; repeated rows count and score repeatedly; with
no training rows every token is unknown: score = base_score = 0 per token (one word in all); an empty table gives no
rows; texts of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textward.llm.common import drop, pieces, save, text_buffer, tidy, word_hashes

END = np.uint64(0xA5A5A5A55A5A5A5A)
CLASSES = 63  # and one for the start of a text
#: Discount and strength of context, class and root restaurants.
D, THETA = (0.75, 0.7, 0.65), (1.0, 10.0, 20.0)
_TABLE = 256
_known: dict[float, np.ndarray] = {}
_logs: dict[float, np.ndarray] = {}
_ROW = 2048
_keys: dict[float, tuple[np.ndarray, np.ndarray]] = {}
_errors: dict[float, tuple[np.ndarray, np.ndarray]] = {}


def pack(x: np.ndarray) -> bytes:
    """A column of numbers, byte by byte of each, compressed here: shuffles then carry it as small as tables do."""
    x = np.ascontiguousarray(x)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def unpack(blob: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def stirling(d: float) -> np.ndarray:
    """[c, t]: logarithms of the generalised Stirling numbers."""
    if d not in _logs:
        log = np.full((_TABLE + 1, _TABLE + 1), -np.inf)
        log[1, 1] = 0.0
        t = np.arange(_TABLE + 1)
        for c in range(1, _TABLE):
            with np.errstate(divide="ignore", invalid="ignore"):
                stay = log[c] + np.log(np.maximum(c - d * t, 0))
                come = np.concatenate([[-np.inf], log[c, :-1]])
                log[c + 1] = np.logaddexp(stay, come)
        _logs[d] = log
    return _logs[d]


def alone(d: float) -> np.ndarray:
    """[c, t]: the chance that one of c customers at t tables sits alone."""
    if d not in _known:
        log = stirling(d)
        out = np.zeros((_TABLE + 1, _TABLE + 1))
        out[1, 1] = 1.0
        for c in range(2, _TABLE + 1):
            come = np.concatenate([[-np.inf], log[c - 1, :-1]])
            with np.errstate(invalid="ignore"):
                out[c] = np.where(np.isfinite(log[c]), np.exp(come - log[c]), 0.0)
        _known[d] = out
    return _known[d]


def _log_factorial(n: np.ndarray) -> np.ndarray:
    """log n!, of n >= 0, by Stirling's series from n + 8 on."""
    m = n + 8.0
    low = sum(np.log(n + i) for i in range(1, 9))
    return m * np.log(m) - m + 0.5 * np.log(2 * np.pi * m) + 1 / (12 * m) - 1 / (360 * m**3) - low


def _saddle(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log of c! / t! times the coefficient of x^c in ((1 - (1 - x)^d) / d)^t, at its saddle point x = 1 - exp(-y)."""
    if d not in _keys:
        key = np.geomspace(1e-9, 60 / d, 4000)
        _keys[d] = np.log(d * np.expm1(key) / np.expm1(d * key)), np.log(key)
    ratio = np.log(np.maximum(c, t + 0.5) / t)
    y = np.exp(np.interp(ratio, *_keys[d]))
    for _ in range(3):
        slope = -1 / np.expm1(-y) + d / np.expm1(-d * y)
        y = y - np.clip((np.log(d * np.expm1(y) / np.expm1(d * y)) - ratio) / np.maximum(slope, 1e-12), -y, y / 2)
    slope = -1 / np.expm1(-y) + d / np.expm1(-d * y)
    return _log_factorial(c) - _log_factorial(t) + t * np.log(-np.expm1(-d * y) / d) - c * np.log(-np.expm1(-y)) - 0.5 * np.log(2 * np.pi * c * slope * np.expm1(y))


def log_stirling(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """Logarithms of generalised Stirling numbers of many customers.

    The saddle point's error is a function of t / c^d (few tables: the branch point at 1 is near); it is taken from an exact row.
    """
    if d not in _errors:
        log = np.full(_ROW + 1, -np.inf)
        log[1], at = 0.0, np.arange(_ROW + 1)
        for n in range(1, _ROW):
            log[1 : n + 2] = np.logaddexp(log[1 : n + 2] + np.log(np.maximum(n - d * at[1 : n + 2], 1e-300)), log[: n + 1])
        few = np.unique(np.geomspace(1, _ROW // 2, 400).astype(np.int64))
        _errors[d] = np.log(few / _ROW**d), log[few] - _saddle(np.full(len(few), float(_ROW)), few.astype(float), d)
    c, t = np.broadcast_arrays(np.asarray(c, float), np.asarray(t, float))
    z, error = _errors[d]
    at = np.log(t) - d * np.log(c)
    below = np.minimum(at - z[0], 0.0) * (error[1] - error[0]) / (z[1] - z[0])
    return np.where(t >= c, 0.0, _saddle(c, t, d) + np.interp(at, z, error) + below)


def _draw_many(c: np.ndarray, a: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes of many customers from their conditional, S(c, t) a^t, on 128 steps over all but e^-25 of the mode."""
    weight = np.log(np.maximum(a, 1e-300))
    score = lambda t: log_stirling(c if t.ndim == 1 else c[:, None], t, d) + t * (weight if t.ndim == 1 else weight[:, None])

    def last(true, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The greatest t in low..high of which true holds, as of all before it; low if of none."""
        low, high = low.copy(), high.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            ok = true(mid)
            low, high = np.where(ok, mid, low), np.where(ok, high, np.maximum(low, mid - 1))
        return low

    one = np.ones(len(c), dtype=np.int64)
    mode = last(lambda t: score(t) >= score(np.maximum(t - 1, 1)), one, c)
    top = score(mode)
    low = np.minimum(last(lambda t: score(t) < top - 25, one, mode), mode)
    high = last(lambda t: score(t) >= top - 25, mode, c)
    edges = low[:, None] + (high - low + 1)[:, None] * np.arange(129) // 128
    width = np.diff(edges, axis=1)
    p = np.cumsum(width * np.exp(np.minimum(score(np.maximum(edges[:, :-1] + (width - 1) // 2, 1)) - top[:, None], 1.0)), axis=1)
    i = np.minimum((p < rng.random(len(c))[:, None] * p[:, -1:]).sum(axis=1), 127)
    rows = np.arange(len(c))
    return edges[rows, i] + (rng.random(len(c)) * width[rows, i]).astype(np.int64)


def _draw(c: np.ndarray, a: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Table counts from their conditional, S(c, t) a^t: of up to 256 customers exactly."""
    t = np.ones(len(c), dtype=np.int64)
    order = np.argsort(c, kind="stable")
    sizes, at = np.unique(c[order], return_index=True)
    log = stirling(d)
    for n, i, j in zip(sizes, at, [*at[1:], len(c)], strict=True):
        if n > _TABLE:
            break
        for k in range(i, j, 4096):
            go = order[k : min(j, k + 4096)]
            s = log[n, 1 : n + 1] + np.log(np.maximum(a[go], 1e-300))[:, None] * np.arange(1, n + 1)
            p = np.cumsum(np.exp(s - s.max(axis=1, keepdims=True)), axis=1)
            t[go] = 1 + np.minimum((p < rng.random(len(go))[:, None] * p[:, -1:]).sum(axis=1), n - 1)
    big = np.flatnonzero(c > _TABLE)
    for k in range(0, len(big), 4096):
        go = big[k : k + 4096]
        t[go] = _draw_many(c[go], a[go], d, rng)
    return t


def start_tables(c: np.ndarray, a: np.ndarray, d: float) -> np.ndarray:
    """About the expected tables of c customers if a new table weighs a."""
    t = np.ones(len(c))
    for _ in range(2):
        t = 1.0 + a * np.log(np.maximum(1.0, (a + c - d * t) / (a + 1.0 - d)))
    return np.clip(np.rint(t), 1, np.maximum(c, 1)).astype(np.int64) * (c > 0)


def gibbs(c: np.ndarray, t: np.ndarray, a: np.ndarray, d: float, rng: np.random.Generator, moves: int) -> np.ndarray:
    """Moves the customers of dishes of up to ``moves``; dishes of more have all of them seated anew by one draw. Single customers have one table."""
    t = np.clip(t, np.minimum(c, 1), c)
    chance = alone(d)
    few = np.flatnonzero((c > 1) & (c <= min(moves, _TABLE)))
    for k in range(moves):
        go = few if k < 2 else few[c[few] > k]
        if not len(go):
            break
        n, s, w = c[go], t[go], a[go]
        s = s - (rng.random(len(go)) < chance[n, s])
        s = s + (rng.random(len(go)) * (w + n - 1 - d * s) < w)
        t[go] = s
    many = np.flatnonzero((c > 1) & (c > min(moves, _TABLE)))
    if len(many):
        t[many] = _draw(c[many], a[many], d, rng)
    return t


class _Layout:
    """The ids of contexts: frequent words first, then the shared ones by class, and last the start of a text."""

    def __init__(self, hot: np.ndarray, parents: np.ndarray):
        order = np.argsort(hot)
        self.hot, self.parents = hot[order], parents[order]
        self.k = len(hot)
        self.shared = max(1, self.k // CLASSES)  # of each class
        self.n = self.k + CLASSES * self.shared + 1
        self.parents = np.concatenate([self.parents, np.repeat(np.arange(CLASSES), self.shared), [CLASSES]]).astype(np.int64)

    def context(self, words: np.ndarray, classes: np.ndarray) -> np.ndarray:
        rare = self.k + classes * self.shared + ((words >> np.uint64(40)) % np.uint64(self.shared)).astype(np.int64)
        if not self.k:
            return rare
        at = np.minimum(np.searchsorted(self.hot, words), self.k - 1)
        return np.where(self.hot[at] == words, at, rare)


def _classes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A word's class by its last two bytes, of which letters have no case."""
    if not len(starts):
        return np.zeros(0, np.int64)
    last = raw[ends - 1].astype(np.int64)
    prior = np.where(ends - starts > 1, raw[np.maximum(ends - 2, 0)], 0).astype(np.int64)
    low = lambda x: np.where((x >= 65) & (x <= 90), x + 32, x)
    return (low(last) * 31 + low(prior)) % CLASSES


def _frequent(docs: DataFrame, most: int, millions: float = 1.0) -> _Layout:
    """The most frequent of all training words, counted exactly; ties go to the smaller hash.

    A task adds up its counts, ``millions`` of distinct words at a time.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def added() -> tuple[np.ndarray, ...]:
            h, at, inv = np.unique(np.concatenate([x[0] for x in held]), return_index=True, return_inverse=True)
            n = np.zeros(len(h), dtype=np.int64)
            np.add.at(n, inv, np.concatenate([x[1] for x in held]))
            return h, n, np.concatenate([x[2] for x in held])[at]

        def row_of(x: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1]), pa.array(x[2], pa.int32())], ["h", "c", "k"])

        for b in batches:
            for part in pieces(b, "text"):
                raw, bounds = text_buffer(part.column(0))
                words, s, e, _ = word_hashes(raw, bounds)
                h, at, n = np.unique(words, return_index=True, return_counts=True)
                held.append((h, n, _classes(raw, s[at], e[at])))
                if sum(len(x[0]) for x in held) > millions * 1e6:
                    held = [added()]
                    if len(held[0][0]) > millions * 5e5:
                        yield row_of(held.pop())
        if held:
            yield row_of(added())

    got = docs.where(~F.col("held")).select("text").mapInArrow(count, "h long, c long, k int").groupBy("h").agg(F.sum("c").alias("c"), F.min("k").alias("k"))
    top = got.orderBy(F.col("c").desc(), "h").limit(most).toPandas()
    return _Layout(top["h"].to_numpy(np.int64).view(np.uint64), top["k"].to_numpy(np.int64))


_CHUNK = "chunk long, bucket int, words binary, cells binary, ctx binary, count binary, ids binary, nulls binary, held binary, bounds binary, low binary, high binary, totals array<bigint>"
_NAMES = [x.split()[0] for x in _CHUNK.split(", ")]


def _row(**values) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), *[pa.binary()] * 10, pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array([values.get(n)], t) for n, t in zip(_NAMES, types, strict=True)], _NAMES)


def _chunks(docs: DataFrame, layout: _Layout, buckets: int) -> DataFrame:
    """Per chunk a row with its tokens (as cell numbers), and a row for each bucket with its cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for b in batches:
            for part in pieces(b, "text", 8 << 20):
                raw, bounds = text_buffer(part.column(1))
                h, s, e, first = word_hashes(raw, bounds)
                held = part.column(2).to_numpy(zero_copy_only=False).astype(bool)
                rows = len(held)
                n = np.diff(first) + 1
                ends = np.cumsum(n)
                doc = np.repeat(np.arange(rows), n)
                words = np.full(int(ends[-1]), END, dtype=np.uint64)
                inside = np.ones(len(words), dtype=bool)
                inside[ends - 1] = False
                words[inside] = h
                ctx = np.empty(len(words), dtype=np.int64)
                of_word = np.zeros(len(words), dtype=np.int64)
                of_word[inside] = layout.context(h, _classes(raw, s, e))
                ctx[1:] = of_word[:-1]
                ctx[ends - n] = layout.n - 1
                uw, inv = np.unique(words, return_inverse=True)
                code, cell = np.unique(inv * layout.n + ctx, return_inverse=True)
                train = ~held[doc]
                count = np.bincount(cell, train, len(code)).astype(np.uint32)
                cell_ctx = (code % layout.n).astype(np.uint16)
                per_word = np.bincount(code // layout.n, minlength=len(uw)).astype(np.uint16)
                cells_before = np.concatenate([[0], np.cumsum(per_word, dtype=np.int64)])
                totals = np.bincount(ctx[train], minlength=layout.n)
                ids = part.column(0)
                yield _row(
                    chunk=chunk,
                    cells=pack(per_word),
                    ids=pack(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)),
                    nulls=pack(ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)),
                    held=pack(held.astype(np.uint8)),
                    bounds=pack(ends.astype(np.int64)),
                    low=pack((cell & 0xFFFF).astype(np.uint16)),
                    high=pack((cell >> 16).astype(np.uint16)),
                    totals=totals.tolist(),
                )
                bucket = ((uw >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                cut = np.searchsorted(bucket, np.arange(buckets + 1))
                for i in np.flatnonzero(np.diff(cut)):
                    w, c = slice(cut[i], cut[i + 1]), slice(cells_before[cut[i]], cells_before[cut[i + 1]])
                    yield _row(chunk=chunk, bucket=int(i), words=pack(uw[w]), cells=pack(per_word[w]), ctx=pack(cell_ctx[c]), count=pack(count[c]))
                chunk += 1

    return docs.mapInArrow(run, _CHUNK)


_FOUND = "chunk long, bucket int, score binary, known binary, totals array<double>"
_SHARED = 2 * (CLASSES + 1) + 2  # totals of a sample besides the contexts' tables


def _sample(layout: _Layout, totals: np.ndarray, buckets: int, sweeps: int, burn: int, moves: int, seed: int, shared: np.ndarray | None = None):
    """The seating of one bucket: a function over its rows, to the totals of each sample or, given their sums, to probabilities."""
    n_ctx, n_class = layout.n, CLASSES + 1

    def run(t: pa.Table) -> pa.Table:
        bucket = t.column("bucket")[0].as_py()
        order = np.argsort(t.column("chunk").to_numpy(), kind="stable")
        t = t.take(pa.array(order))
        chunks = t.column("chunk").to_pylist()
        read = lambda name, kind: [unpack(x, kind) for x in t.column(name).to_pylist()]
        words, cells, ctxs, counts = read("words", np.uint64), read("cells", np.uint16), read("ctx", np.uint16), read("count", np.uint32)
        word_at = np.cumsum([0] + [len(x) for x in words])
        cell_at = np.cumsum([0] + [len(x) for x in ctxs])
        uw, inv = np.unique(np.concatenate(words), return_inverse=True)
        per_word, ctx, count = np.concatenate(cells), np.concatenate(ctxs).astype(np.int64), np.concatenate(counts)
        code = np.repeat(inv, per_word) * n_ctx + ctx
        ucode, of = np.unique(code, return_inverse=True)
        c = np.bincount(of, count, len(ucode)).astype(np.int64)
        word, ctx = ucode // n_ctx, ucode % n_ctx
        class_code, to_class = np.unique(word * n_class + layout.parents[ctx], return_inverse=True)
        class_word, class_group = class_code // n_class, class_code % n_class
        leaf = np.flatnonzero(c > 0)
        lw, lc, lu = to_class[leaf], c[leaf], ctx[leaf]
        known = np.bincount(word, c, len(uw)).astype(np.int64)
        vocabulary = int((known > 0).sum())
        h = 1.0 / (buckets * max(1, vocabulary) + 1.0)
        rng = np.random.default_rng([seed, bucket])
        own = np.bincount(lu, lc, n_ctx)
        lt, ct, rt = np.minimum(lc, 1), None, None
        p0 = known / max(1.0, float(totals.sum())) + h
        p1 = p0[class_word]
        out, mean = [], np.zeros(len(ucode))
        for sweep in range(sweeps):
            tables = np.bincount(lu, lt, n_ctx)
            usual = lt.sum() / max(1, lc.sum())
            tu = totals * (tables + 8 * usual) / (own + 8)
            a = (THETA[0] + D[0] * tu[lu]) * p1[lw]
            lt = gibbs(lc, start_tables(lc, a, D[0]) if not sweep else lt, a, D[0], rng, moves)
            cc = np.bincount(lw, lt, len(class_code)).astype(np.int64)
            if ct is None:
                ct = np.minimum(cc, 1)
            tg = np.bincount(class_group, ct, n_class) * buckets
            a = (THETA[1] + D[1] * tg[class_group]) * p0[class_word]
            ct = gibbs(cc, start_tables(cc, a, D[1]) if not sweep else ct, a, D[1], rng, moves)
            rc = np.bincount(class_word, ct, len(uw)).astype(np.int64)
            if rt is None:
                rt = np.minimum(rc, 1)
            a = np.full(len(uw), (THETA[2] + D[2] * buckets * rt.sum()) * h)
            rt = gibbs(rc, start_tables(rc, a, D[2]) if not sweep else rt, a, D[2], rng, moves)
            customers, tables = np.bincount(class_group, cc, n_class), np.bincount(class_group, ct, n_class)
            p0, p1 = _predict(rc, rt, buckets * rc.sum(), buckets * rt.sum(), h, cc, ct, customers * buckets, tables * buckets, class_word, class_group)
            if sweep < burn:
                continue
            if shared is None:
                out.append(np.concatenate([np.bincount(lu, lt, n_ctx), customers, tables, [rc.sum(), rt.sum()]]))
                continue
            whole = shared[1 + (sweep - burn) * (n_ctx + _SHARED) :][: n_ctx + _SHARED]
            tu, customers, tables = whole[:n_ctx], whole[n_ctx : n_ctx + n_class], whole[n_ctx + n_class : n_ctx + 2 * n_class]
            _, q1 = _predict(rc, rt, whole[-2], whole[-1], 1.0 / (shared[0] + 1.0), cc, ct, customers, tables, class_word, class_group)
            left = np.zeros(len(ucode))
            left[leaf] = lc - D[0] * lt
            mean += (left + (THETA[0] + D[0] * tu[ctx]) * q1[to_class]) / (THETA[0] + totals[ctx]) / (sweeps - burn)
        if shared is None:
            sums = np.concatenate([[float(vocabulary)], *out])
            return pa.table({"chunk": pa.nulls(1, pa.int64()), "bucket": pa.array([bucket], pa.int32()), "score": pa.nulls(1, pa.binary()), "known": pa.nulls(1, pa.binary()), "totals": pa.array([sums.tolist()], pa.list_(pa.float64()))})
        score, known = np.log10(mean)[of].astype(np.float32), known[inv]
        blob = lambda x, at: pa.array([pack(x[at[i] : at[i + 1]]) for i in range(len(chunks))], pa.binary())
        return pa.table({"chunk": pa.array(chunks, pa.int64()), "bucket": pa.array([bucket] * len(chunks), pa.int32()), "score": blob(score, cell_at), "known": blob(known, word_at), "totals": pa.nulls(len(chunks), pa.list_(pa.float64()))})

    return run


def _predict(rc, rt, root_customers, root_tables, h, cc, ct, customers, tables, class_word, class_group) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of words at the root and, by class, in the classes' restaurants."""
    p0 = (rc - D[2] * rt + (THETA[2] + D[2] * root_tables) * h) / (THETA[2] + root_customers)
    return p0, (cc - D[1] * ct + (THETA[1] + D[1] * tables[class_group]) * p0[class_word]) / (THETA[1] + customers[class_group])


def _totals(df: DataFrame) -> np.ndarray:
    """The element-wise sum of an array column, as a bounded array on the driver."""
    rows = df.select(F.posexplode("totals").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    return np.array([r["v"] for r in rows])


def score(
    docs: DataFrame,
    held_out: Column,
    key: str = "doc_id",
    text: str = "text",
    contexts: int | None = None,
    bucket_tokens: int = 1_000_000,
    sweeps: int = 6,
    burn: int = 2,
    moves: int = 6,
    seed: int = 3,
) -> DataFrame:
    """Scores all rows by a model of those that aren't held out."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), held_out.alias("held"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("read"), F.count(F.lit(1)).alias("n")).first()
    tokens = (size["read"] or 0) // 6 + size["n"]
    layout = _frequent(rows, min(30_000, max(64, round(tokens**0.4))) if contexts is None else contexts)
    tidy(spark)  # the words' counts are done with
    buckets = max(4, -(-tokens // bucket_tokens))
    held, held_path = save(_chunks(rows, layout, buckets))
    totals = _totals(held.where("bucket is null"))
    if not len(totals):
        totals = np.zeros(layout.n)
    asked = held.where("bucket is not null").select("chunk", "bucket", "words", "cells", "ctx", "count").groupBy("bucket")
    plan = (layout, totals, buckets, sweeps, burn, moves, seed)
    sums, sums_path = save(asked.applyInArrow(_sample(*plan), _FOUND))
    shared = _totals(sums)
    drop(spark, sums_path)
    tidy(spark)
    if not len(shared):
        shared = np.zeros(1 + (sweeps - burn) * (layout.n + _SHARED))
    found, _ = save(asked.applyInArrow(_sample(*plan, shared), _FOUND))
    base_n, vocabulary = float(totals.sum()), float(shared[0])
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def add(t: pa.Table) -> pa.Table:
        at = np.argsort(t.column("bucket").fill_null(-1).to_numpy(), kind="stable")
        t = t.take(pa.array(at))
        own, rest = t.slice(0, 1), t.slice(1)
        one = lambda name, kind: unpack(own.column(name)[0].as_py(), kind)
        all_of = lambda name, kind: np.concatenate([unpack(x, kind) for x in rest.column(name).to_pylist()])
        c = all_of("known", np.int64)[np.repeat(np.arange(len(one("cells", np.uint16))), one("cells", np.uint16))]
        score_cell = all_of("score", np.float32).astype(float)
        base_cell = np.log10((c + 0.1) / (base_n + 0.1 * (vocabulary + 1.0)))
        cell = one("low", np.uint16).astype(np.int64) | (one("high", np.uint16).astype(np.int64) << 16)
        ends = one("bounds", np.int64)
        starts = np.concatenate([[0], ends[:-1]])
        ids = pa.array(one("ids", np.int64), mask=one("nulls", np.uint8).astype(bool))
        n = len(ends)
        return pa.table(
            {
                "doc_id": ids,
                "held_out": pa.array(one("held", np.uint8).astype(bool)),
                "n_tokens": pa.array(ends - starts),
                "n_known": pa.array(np.add.reduceat((c > 0)[cell].astype(np.int64), starts)),
                "train_tokens": pa.array(np.full(n, int(base_n))),
                "base_score": pa.array(np.add.reduceat(base_cell[cell], starts)),
                "score": pa.array(np.add.reduceat(score_cell[cell], starts)),
            }
        )

    back, _ = save(held.where("bucket is null").select("chunk", "bucket", "cells", "ids", "nulls", "held", "bounds", "low", "high"))
    drop(spark, held_path)  # the buckets' rows are done with
    back = back.select("*", *[F.lit(None).cast("binary").alias(c) for c in ("score", "known")])
    more = found.select("chunk", "bucket", *[F.lit(None).cast("binary").alias(c) for c in ("cells", "ids", "nulls", "held", "bounds", "low", "high")], "score", "known")
    tidy(spark)
    return back.union(more).groupBy("chunk").applyInArrow(add, schema)
