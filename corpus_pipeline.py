"""A corpus pipeline of five stages; each works on all rows that the stage before it kept.

Stages 1 to 4 return the columns of ``documents``; the last returns token ids. Rows of ``documents`` may repeat, in ids as
in texts: decisions are made by row.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textward.llm import common, jaccard, langid, lines, mixing, pieces
from textward.llm.common import id_crc, save
from textward.llm.queries import PIECES

#: Texts whose best language has a lower calibrated score are rejected, as are those without letters.
LEAST_SCORE = 0.3


#: Intermediate tables of the stage before, which nothing reads once its rows are written.
_left: list[str] = []


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage's rows are written before the next stage is called; the next one then deletes its intermediate tables."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.drop(spark, *_left)
        common.tidy(spark)
        before = set(common.WRITTEN)
        out = f(spark, docs, sf_dir)
        _left[:] = [p for p in common.WRITTEN if p not in before]
        return out

    return run


def _rows(docs: DataFrame) -> tuple[DataFrame, bool]:
    """The table with ``_row``, a hash of id and text that names equal rows alike, and whether there are any."""
    named = docs.withColumn("_row", F.xxhash64("doc_id", "text"))
    n = named.groupBy("_row").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    return named, n > 0


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognisable language."""
    model = langid.train(docs, id_crc(F.col("doc_id")) % 4 != 2)
    named = langid.predict(docs, model, docs.columns)
    return named.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of runs of lines of 50 words or more; a document of which nothing is left goes."""
    cleaned = lines.dedup_lines(docs)
    kept = cleaned.where((F.col("n_deleted") == 0) | (F.col("n_deleted") < F.col("n_lines")))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@_stage
def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each class of near copies (five-word shingles, similarity 0.8)."""
    named, repeated = _rows(docs)
    classes = jaccard.jaccard_classes(named, words=5, percent=80, key="_row")
    of = named.select("_row", "doc_id").distinct().join(classes.select("_row", "component_id").distinct(), "_row")
    first = of.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "_row"))["_row"].alias("_row"))
    kept = named.join(first, "_row", "left_semi")
    return (kept.dropDuplicates(["_row"]) if repeated else kept).select(*docs.columns)


@_stage
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes sources to target weights: a document comes once for each pass in which its middle word's block is taken."""
    named, repeated = _rows(docs)
    plan = mixing.mix(named, carry=("_row",)).groupBy("_row").agg(F.sum("copies").cast("int").alias("_copies")).where("_copies > 0")
    once = named.dropDuplicates(["_row"]) if repeated else named
    return once.join(plan, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)


@_stage
def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document of the mix."""
    return pieces.encode(docs, pieces.read(PIECES), ["doc_id", "lang", "source"])


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("source_mix", source_mix),
    ("sentencepiece", sentencepiece),
]

#: Regression, doubling rounds and graph components have no SQL form; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs, path = save(stage(spark, docs, sf_dir))
        if before:
            common.drop(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
