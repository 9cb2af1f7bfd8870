"""Line dedup: maximal repeated runs of lines, by prefix doubling over line identifiers; later copies are deleted.

The corpus is one sequence of line identifiers (hashes of the non-blank lines, white space at their ends left off), with
document ends as bounds. Prefix doubling gives every position, level by level, the rank of its class among the runs of
2^k lines: the class of 2^(k+1) lines at g is that of the pair of classes at g and g + 2^k. A class is named by its first
position, and only classes with at least two members go on: a suffix whose class has one member shares no longer
prefix with any other, and its place in the suffix array is settled. The tables of all levels together answer whether
two runs of any length are equal: a run of n lines is the pair of its first and its last 2^k lines, 2^k <= n. Such classes
of runs are the intervals of the suffix array whose longest common prefix is at least n; the earliest member stays.

A run counts if it holds ``min_words`` words or more. Every line of such a run lies in a shortest window of that many
words that starts, or that ends, at one of the run's lines. So deleting the later copies of all such windows deletes
exactly the later copies of all maximal runs, and the doubling ends at the longest window. A copy that overlaps the
class's first member in the same document is not a later copy. Order is that of doc_id (nulls first), then of the rows as
they are read, then of the lines.

Cases: null texts stay null, empty ones empty; a text whose lines all go becomes empty, and ``n_deleted`` says so;
repeated rows are copies of the first; lines of any length and texts of any number of lines are read whole; empty tables
give empty tables; other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textward.llm.common import drop, save, tidy


def _merge(df: DataFrame) -> DataFrame:
    """The side of a join that grows with the input: sorted and merged at every size, never sent to all tasks."""
    return df.hint("merge")


def _windows(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line, in how many lines from it on, and up to it, there are ``least`` words; 0: never."""
    sums = np.concatenate([[0], np.cumsum(words)])
    n = len(words)
    end = np.searchsorted(sums, sums[:-1] + least, side="left")
    ahead = np.where(end <= n, end - np.arange(n), 0)
    begin = np.searchsorted(sums, sums[1:] - least, side="right") - 1
    behind = np.where(begin >= 0, np.arange(1, n + 1) - begin, 0)
    return ahead, behind


def _lines(docs: DataFrame, least: int) -> DataFrame:
    """(doc, uid, text) -> a row per non-blank line."""
    schema = "doc long, uid long, idx int, h long, after int, ahead int, behind int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            held = 0
            for doc, uid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                kept = [x for x in map(bytes.strip, raw.split(b"\n")) if x]
                n = len(kept)
                if not n:
                    continue
                h = np.fromiter(map(xxhash.xxh3_64_intdigest, kept), dtype=np.uint64, count=n).view(np.int64)
                words = np.fromiter((len(x.split()) for x in kept), dtype=np.int64, count=n)
                ahead, behind = _windows(words, least)
                for c, x in zip(cols, (np.full(n, doc if doc is not None else np.iinfo(np.int64).min), np.full(n, uid), np.arange(n), h, np.arange(n - 1, -1, -1), ahead, behind), strict=True):
                    c.append(x)
                held += n
            if held:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)).cast(k) for c, k in zip(cols, kinds, strict=True)], schema.replace(" long", "").replace(" int", "").split(", "))

    return docs.mapInArrow(run, schema)


def repeated_runs(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """(doc long, uid long, text) with unique uids -> (uid, first, last): spans of non-blank lines to delete."""
    spark = docs.sparkSession
    lines, lines_path = save(_lines(docs, min_words).withColumn("gid", F.monotonically_increasing_id()))
    shared = lines.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    active, active_path = save(lines.join(_merge(shared), "h"))
    longest = active.agg(F.greatest(F.max("ahead"), F.max("behind"))).first()[0] or 0
    level, path = save(active.select("gid", "after", F.col("h").alias("r")))
    levels, paths, k = [level.withColumn("k", F.lit(0))], [path], 0
    while 2 << k <= longest:
        step = 1 << k
        second = level.select((F.col("gid") - step).alias("gid"), F.col("r").alias("r2"))
        pairs, pairs_path = save(level.where(F.col("after") >= step).join(_merge(second), "gid"))
        names = pairs.groupBy("r", "r2").agg(F.count(F.lit(1)).alias("n"), F.min("gid").alias("name")).where("n > 1").drop("n")
        level, path = save(pairs.join(_merge(names), ["r", "r2"]).select("gid", "after", F.col("name").alias("r")))
        drop(spark, pairs_path)
        k += 1
        if level.isEmpty():
            break
        levels.append(level.withColumn("k", F.lit(k)))
        paths.append(path)
        tidy(spark)
    ranks = levels[0]
    for x in levels[1:]:
        ranks = ranks.union(x)
    ranks = ranks.select("gid", "k", "r")
    whole = active.select("doc", "uid", "idx", "gid", F.col("ahead").alias("len")).where("len > 0")
    ending = active.where("behind > 0").select("doc", "uid", (F.col("idx") - F.col("behind") + 1).alias("idx"), (F.col("gid") - F.col("behind") + 1).alias("gid"), F.col("behind").alias("len"))
    windows = whole.union(ending).distinct().withColumn("k", F.floor(F.log2(F.col("len") + 0.5)).cast("int"))
    windows = windows.withColumn("gid2", F.col("gid") + F.col("len") - F.expr("shiftleft(1, k)"))
    found = windows.join(_merge(ranks.withColumnRenamed("r", "r1")), ["gid", "k"]).join(_merge(ranks.select(F.col("gid").alias("gid2"), "k", F.col("r").alias("r2"))), ["gid2", "k"])
    found, found_path = save(found)
    first = found.groupBy("len", "r1", "r2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "gid")).alias("first")).where("n > 1").drop("n")
    later = found.join(_merge(first), ["len", "r1", "r2"]).where(
        (F.struct("doc", "gid") > F.col("first")) & ((F.col("gid") >= F.col("first.gid") + F.col("len")) | (F.col("gid") < F.col("first.gid")))
    )
    spans, _ = save(later.select("uid", F.col("idx").alias("first"), (F.col("idx") + F.col("len") - 1).alias("last")).distinct())
    drop(spark, lines_path, active_path, found_path, *paths)
    return spans


def _cut(text: str, spans: list[tuple[int, int]]) -> tuple[str, int, int]:
    """The text without the spans of non-blank lines (and blank lines inside them), its non-blank lines, and how many went."""
    out, n, gone = [], 0, 0
    spans = sorted(spans)
    merged: list[list[int]] = []
    for a, b in spans:
        if merged and a <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    at = 0
    for line in text.split("\n"):
        blank = not line.encode("utf-8", "surrogatepass").strip()
        while at < len(merged) and merged[at][1] < n - (1 if blank else 0) and merged[at][1] < n:
            at += 1
        if blank:
            if not (at < len(merged) and merged[at][0] < n <= merged[at][1]):
                out.append(line)
            continue
        if at < len(merged) and merged[at][0] <= n <= merged[at][1]:
            gone += 1
        else:
            out.append(line)
        n += 1
    return "\n".join(out) if n > gone or not n else "", n, gone


def dedup_lines(docs: DataFrame, min_words: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The table with ``text`` cleaned, and n_lines and n_deleted beside its columns.

    The columns of the input come first, unchanged but for the text.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row"), F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    held, _ = save(packed.withColumn("uid", F.monotonically_increasing_id()))  # row numbers hold only for a written table
    spans = repeated_runs(held.select("doc", "uid", "text"), min_words)
    per = spans.groupBy("uid").agg(F.collect_list(F.struct("first", "last")).alias("spans"))  # at most two windows a line
    joined = held.join(_merge(per), "uid", "left").select("row", "text", "spans")
    result = T.StructType([*joined.schema[:2], T.StructField("n_lines", T.IntegerType()), T.StructField("n_deleted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, lines, gone = [], [], []
            for t, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if t is None or not s:
                    texts.append(t)
                    lines.append(sum(1 for x in (t or "").encode("utf-8", "surrogatepass").split(b"\n") if x.strip()))
                    gone.append(0)
                else:
                    cut, n, g = _cut(t, [(x["first"], x["last"]) for x in s])
                    texts.append(cut), lines.append(n), gone.append(g)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, b.schema.field(1).type), pa.array(lines, pa.int32()), pa.array(gone, pa.int32())], ["row", "text", "n_lines", "n_deleted"])

    done = joined.mapInArrow(run, result)
    return done.select(*[F.col("text").alias(text) if c == text else F.col(f"row.`{c}`") for c in docs.columns], "n_lines", "n_deleted")
