"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Everything is DataFrame expressions. The order of work:

1. sizes: words per document, written once; no later step reads texts.
2. targets: each source's share of the mix by weight, capped at ``max_repeat`` times its size (water filling).
3. block quotas per source: ``round(sum(targets) / block)`` blocks go to the highest quotients
   ``target / (2 k - 1)``. Only quotients between two bracketing divisors are ranked, at most three a source.
4. each source's documents are dealt by a seeded hash to shards; its quota goes to the shards by the same rule, with the
   shards' sizes as votes.
5. seeded block selection: a shard's documents, in seeded order, form one run of words cut in blocks. A quota of q out
   of m blocks takes every block ``q // m`` times and ``q % m`` blocks once more: those whose number times a prime,
   plus a seeded shift, modulo m lies below ``q % m``. The prime makes that a permutation of the blocks.

A document's ``taken`` is the overlap of its words with the taken blocks.

Cases: null or empty texts have size 0 and nothing is taken from them. The null source is a source of its own, last in
order. Repeated rows are separate documents (rows that tie in id and size are interchangeable). Null ids are kept.
An empty table gives an empty plan. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textward.llm.common import WORD, save

#: Weights by a source's place in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Multipliers of the block permutation: primes above any number of blocks in a shard.
PRIMES = (2654435761, 2246822519, 3266489917)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded(seed: int, *parts: Column) -> Column:
    """A long from 0 to 2^52, the same in any engine that has md5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, max_repeat: float = 2.0) -> DataFrame:
    """source, source_size, target from rows of (source, size).

    Water filling over the sources sorted by cap / weight: a source is capped if the level reached by giving all that is
    left to it and those after it would lift it above its cap.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(max_repeat))
    per = per.select("source", "source_size", weight.alias("w"), cap.alias("cap"))
    by_level = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    after = by_level.rowsBetween(W.currentRow, W.unboundedFollowing)
    level = (F.lit(float(share)) * F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    per = per.withColumn("level", level).withColumn("free", F.col("level") * F.col("w") < F.col("cap"))
    # the first free source's level holds for all after it
    reached = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("w"), "source_size", "level"))).over(W.partitionBy())["level"]
    target = F.when(F.col("free"), F.coalesce(reached, F.col("level")) * F.col("w")).otherwise(F.col("cap"))
    return per.select("source", "source_size", target.alias("target"))


def sainte_lague(votes: DataFrame, party: list[str], vote: str, seats: str, within: list[str]) -> DataFrame:
    """Adds ``quota``: seats by highest quotients vote / (2 k - 1), ties to the first party.

    ``seats`` is a column with the seats to give within each group of ``within``. With divisors V / (n - p) and
    V / (n + p) for n seats, p parties and V votes, rounding gives at most and at least n seats, so that the quotients
    that decide lie between them.
    """
    group = W.partitionBy(*within)
    x = votes.withColumn("_v", F.sum(vote).over(group)).withColumn("_p", F.count(F.lit(1)).over(group))
    share = lambda n: F.when(F.col("_v") > 0, F.col(vote) * n / F.col("_v")).otherwise(F.lit(0.0))
    sure = F.floor(share(F.greatest(F.col(seats) - F.col("_p"), F.lit(0))) + 0.5).cast("long")
    most = F.floor(share(F.col(seats) + F.col("_p")) + 0.5).cast("long") + 1
    x = x.withColumn("_sure", F.greatest(sure - 1, F.lit(0))).withColumn("_most", F.when(F.col(vote) > 0, most).otherwise(F.lit(0)))
    x = x.withColumn("_left", F.col(seats) - F.sum("_sure").over(group))
    tried = x.select("*", F.explode_outer(F.when(F.col("_most") > F.col("_sure"), F.sequence(F.col("_sure") + 1, F.col("_most")))).alias("_k"))
    quotient = F.col(vote) / (F.col("_k") * 2 - 1)
    rank = F.row_number().over(group.orderBy(quotient.desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in party], "_k"))
    won = F.sum(F.when(F.col("_k").isNotNull() & (F.col("_rank") <= F.col("_left")), 1).otherwise(0))
    keep = [c for c in votes.columns if c not in party]
    return (
        tried.withColumn("_rank", rank)
        .groupBy(*party)
        .agg(*[F.first(c, ignorenulls=False).alias(c) for c in keep], (F.first("_sure") + won).alias("quota"))
    )


def mix(
    docs: DataFrame,
    weights=WEIGHTS,
    share: float = 1.5,
    max_repeat: float = 2.0,
    block: int = 8,
    shard_words: int = 16384,
    max_shards: int = 65536,
    seed: int = 7,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """The mix of a table (doc_id, text, source): doc_id, size, source, source_size, target, taken, copies.

    Columns of ``carry`` stand after these; they also order rows of equal id and size.

    ``taken`` counts words, repeats included; ``copies`` is for whole-document sampling: the full passes, plus one if
    the block that holds the document's middle word was selected once more. ``shard_words`` is a shard's usual size;
    a source has at most ``max_shards`` shards, which then grow with it.
    """
    sized, _ = save(docs.select("doc_id", "source", words(F.col("text")).alias("size"), *[F.col(c).alias(f"_carry{i}") for i, c in enumerate(carry)]))
    targets, _ = save(source_targets(sized.select("source", "size"), weights, share, max_repeat))
    # sources are few: their number is that of distinct names, and every step below keeps them in one small table
    blocks = targets.withColumn("blocks", F.round(F.sum("target").over(W.partitionBy()) / block).cast("long"))
    by_source = sainte_lague(blocks, ["source"], "target", "blocks", [])
    shards = F.least(F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1)), F.lit(max_shards))
    by_source, _ = save(by_source.select("source", "source_size", "target", F.col("quota").alias("source_quota"), shards.cast("long").alias("n_shards")))

    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("-"))
    order = seeded(seed, F.col("doc_id"))
    dealt = (
        sized.withColumn("_key", key)
        .join(by_source.select(key.alias("_key"), "source_size", "target", "source_quota", "n_shards"), "_key")
        .withColumn("order", order)
        .withColumn("shard", F.col("order") % F.col("n_shards"))
    )
    per_shard = dealt.groupBy("_key", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_quota").alias("source_quota"))
    quotas = sainte_lague(per_shard.where("shard_size > 0"), ["_key", "shard"], "shard_size", "source_quota", ["_key"])
    quotas = quotas.select("_key", "shard", "shard_size", "quota")
    carried = [f"_carry{i}" for i in range(len(carry))]
    run = W.partitionBy("_key", "shard").orderBy("order", "doc_id", "size", *carried).rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = dealt.withColumn("_end", F.sum("size").over(run)).join(quotas, ["_key", "shard"], "left")
    m = F.ceil(F.col("shard_size") / block).cast("long")
    shift = seeded(seed + 1, F.col("_key"), F.col("shard"))
    placed = placed.select(
        "doc_id", "source", "size", "source_size", "target", "_end", "shard_size",
        m.alias("_m"),
        F.least(F.coalesce(F.col("quota"), F.lit(0)), F.floor(m * F.lit(float(max_repeat)))).alias("_q"),
        shift.alias("_shift"), *carried,
    )
    placed = placed.withColumns({"_start": F.col("_end") - F.col("size"), "_full": F.floor(F.col("_q") / F.col("_m")), "_more": F.col("_q") % F.col("_m")})
    prime = F.element_at(F.array(*[F.lit(p) for p in PRIMES]), (F.col("_shift") % len(PRIMES) + 1).cast("int"))
    chosen = lambda j: (j * prime + F.col("_shift")) % F.col("_m") < F.col("_more")
    part = F.aggregate(
        F.sequence(F.floor(F.col("_start") / block), F.floor((F.col("_end") - 1) / block)),
        F.lit(0).cast("long"),
        lambda acc, j: acc + F.when(chosen(j), F.least(F.col("_end"), (j + 1) * block) - F.greatest(F.col("_start"), j * block)).otherwise(F.lit(0)),
    )
    some = (F.col("size") > 0) & (F.col("_q") > 0)
    taken = F.when(some, F.col("_full") * F.col("size") + F.when(F.col("_more") > 0, part).otherwise(F.lit(0))).otherwise(F.lit(0))
    middle = F.floor((F.col("_start") + F.floor(F.col("size") / 2)) / block)
    copies = F.when(some, F.col("_full") + F.when(chosen(middle), 1).otherwise(0)).otherwise(F.lit(0))
    return placed.select("doc_id", "size", "source", "source_size", "target", taken.cast("long").alias("taken"), copies.cast("int").alias("copies"), *[F.col(f"_carry{i}").alias(c) for i, c in enumerate(carry)])
