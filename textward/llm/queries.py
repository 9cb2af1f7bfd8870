"""The registered queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textward.llm import chat, hpyp, jaccard, langid, licenses, lines, mih, mixing, neardup, pieces
from textward.llm.common import id_crc
from textward.llm.oracles import ORACLES  # noqa: F401


#: The model file of op8; a parameter of the operator.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pitman_yor_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability by a model of nine tenths of the ids."""
    return hpyp.score(_table(spark, sf_dir, "documents"), id_crc(F.col("doc_id")) % 10 == 0)


def op2_hashed_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest by inner product of every vector whose id is divisible by 20."""
    return mih.search(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op3_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at cosine 0.95 and above among all vectors."""
    return neardup.near_duplicates(_table(spark, sf_dir, "embeddings"), least=0.95)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document, by sentence rules."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the later copies of runs of lines of 50 words or more."""
    return lines.dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_deleted")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents linked by a Jaccard similarity of 0.85 or more of their 4-word shingles."""
    return jaccard.jaccard_classes(_table(spark, sf_dir, "documents"), words=4, percent=85)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; learnt from three quarters of the ids."""
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", id_crc(F.col("doc_id")) % 4 == 2)
    model = langid.train(docs, ~F.col("held_out"))
    return langid.predict(docs, model, ["doc_id", "held_out"])


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's piece ids, and whether decoding them gives the text back."""
    return pieces.encode(_table(spark, sf_dir, "documents"), pieces.read(PIECES), ["doc_id"])


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents by the contract's weights."""
    plan = mixing.mix(_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op10_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from every participant's perspective."""
    return chat.rotate(_table(spark, sf_dir, "conversations")).withColumn("masks", F.to_json("masks"))


QUERIES = {
    "op1_pitman_yor_score": op1_pitman_yor_score,
    "op2_hashed_neighbours": op2_hashed_neighbours,
    "op3_embedding_neardup": op3_embedding_neardup,
    "op4_license_scan": op4_license_scan,
    "op5_line_dedup": op5_line_dedup,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_language_id": op7_language_id,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_source_mix": op9_source_mix,
    "op10_chat_rotation": op10_chat_rotation,
}
