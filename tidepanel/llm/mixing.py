"""Mixing sources to target weights (operator 6): temperature mixing, realised as budgeted block permutations.

A source's weight is its token share to the power alpha, normalised. Alpha is found by repeated bisection (many points a round, one small aggregation each) so
that the weights' entropy meets a target, or no source is repeated more often than a limit. A source's quota is its weight times the token budget: whole passes
over the source, then part of one more. In a pass the documents are dealt to blocks by hash, blocks are ordered by a hash of the pass, and documents in a block
likewise; the part is the blocks that fit, then documents of the next block while they fit. Blocks and cuts are found from ids and token counts alone, and end as one row
per source, which every document is compared with: texts are not shuffled, and a hot source is no hot partition.

Cases: a null source is a source; documents without words have no tokens and go with their block; a source without tokens takes no weight and appears once if no
budget is given, else not at all; equal sources in size have equal weights; repeated rows are dealt alike; empty tables give an empty mix; columns of docs stay, and added
names are parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import SPACES, materialise, table


def token_count(text: Column) -> Column:
    """Words of a text."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACES}]+"), lambda w: w != "")).cast("long")


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def fit_alpha(sources: DataFrame, entropy: float | None = None, max_repeat: float | None = None, budget: float | None = None, points: int = 33, rounds: int = 6) -> float:
    """The alpha in [0, 1] at which the weights meet the target. sources: key, tokens (positive).

    entropy: natural logarithm; the alpha where the weights' entropy equals it. max_repeat: the least alpha at which no source is read more often than so many times
    under the budget; without a budget, than so many times the least-read source. Both measures fall as alpha grows; targets out of reach give the nearer end.
    """
    low, high = 0.0, 1.0
    share = sources.select("tokens", (F.col("tokens") / F.sum("tokens").over(Window.partitionBy(F.lit(0)))).alias("p"))
    share = materialise(share, "shares")
    for _ in range(rounds):
        step = (high - low) / (points - 1)
        each = share.select("tokens", F.log("p").alias("lp"), F.explode(F.array(*[F.lit(low + i * step) for i in range(points)])).alias("a"))
        of = each.groupBy("a").agg(F.sum(F.exp(F.col("a") * F.col("lp"))).alias("z"), F.sum(F.exp(F.col("a") * F.col("lp")) * F.col("lp")).alias("zl"), F.max(F.exp(F.col("a") * F.col("lp")) / F.col("tokens")).alias("most"), F.min(F.exp(F.col("a") * F.col("lp")) / F.col("tokens")).alias("least"))
        rows = sorted(of.collect(), key=lambda r: r["a"])  # `points` rows
        import math

        if entropy is not None:
            value, target = [math.log(r["z"]) - r["a"] * r["zl"] / r["z"] for r in rows], entropy
        else:
            value, target = [r["most"] / r["least"] if budget is None else r["most"] / r["z"] * budget for r in rows], max_repeat
        first = next((i for i, v in enumerate(value) if v <= target + 1e-12), len(rows) - 1)
        low, high = rows[max(0, first - 1)]["a"], rows[first]["a"]
        if first == 0:
            break
    return high


def plan(weights: DataFrame, alpha: float, budget: float | None, seed: int, block_docs: int) -> DataFrame:
    """One row per source: key, tokens, weight, quota, passes, blocks, and the cut of the last pass: block hash, block, document hash.

    weights: key, id, tokens of each document.
    """
    per = weights.groupBy("key").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    everything = Window.partitionBy(F.lit(0))  # one row per source
    raw = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.sum("tokens").over(everything), F.lit(alpha))).otherwise(0.0)
    per = per.withColumn("raw", raw).withColumn("weight", F.coalesce(F.try_divide("raw", F.sum("raw").over(everything)), F.lit(0.0)))
    total = F.lit(float(budget)) if budget is not None else F.try_divide(F.lit(1.0), F.min(F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens"))).over(everything))
    per = per.withColumn("quota", F.coalesce(total * F.col("weight"), F.lit(0.0)))
    ratio = F.col("quota") / F.col("tokens")
    passes = F.when(F.col("tokens") > 0, F.floor(ratio + 1e-9)).otherwise(F.lit(1 if budget is None else 0)).cast("int")
    per = per.withColumn("passes", passes).withColumn("rest", F.greatest(F.lit(0.0), F.col("quota") - F.col("passes") * F.col("tokens")))
    per = materialise(per.withColumn("blocks", F.ceil(F.col("docs") / block_docs).cast("long")).drop("raw", "docs"), "sources")
    dealt = weights.join(per.select("key", "passes", "blocks", "rest"), "key").where("rest > 0")
    dealt = dealt.select("key", "id", "tokens", "passes", "rest", block_of(F.col("id"), F.col("blocks"), seed).alias("block"))
    blocks = dealt.groupBy("key", "block").agg(F.sum("tokens").alias("tokens"), F.first("passes").alias("passes"), F.first("rest").alias("rest"))
    blocks = blocks.withColumn("h", order_hash(F.col("block"), F.col("passes"), seed))
    run = F.sum("tokens").over(Window.partitionBy("key").orderBy("h", "block"))  # rows of whole blocks, not of documents
    cut = blocks.withColumn("end", run).where("end > rest").groupBy("key").agg(F.min(F.struct("h", "block", (F.col("rest") - F.col("end") + F.col("tokens")).alias("room"))).alias("c"))
    cut = materialise(cut.select("key", F.col("c.h").alias("cut_hash"), F.col("c.block").alias("cut_block"), F.col("c.room").alias("room")), "cuts")
    edge = dealt.join(cut, "key").where("block = cut_block").withColumn("h", order_hash(F.col("id"), F.col("passes"), seed))
    inside = edge.withColumn("end", F.sum("tokens").over(Window.partitionBy("key").orderBy("h", "id"))).where("end <= room").groupBy("key").agg(F.max("h").alias("cut_doc"))  # one block per source
    return materialise(per.join(cut, "key", "left").join(inside, "key", "left"), "plan")


def block_of(key: Column, blocks: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), key), blocks)


def order_hash(key: Column, passes: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed + 1), passes, key)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", entropy: float | None = None, max_repeat: float | None = 2.0, budget_ratio: float | None = None, seed: int = 1, block_docs: int = 4096, epoch_col: str = "epoch", tokens_col: str | None = None) -> DataFrame:
    """Every row of docs as often as its source's quota reads it, with the pass in epoch_col.

    budget_ratio: token budget over the corpus's tokens; None: the smallest budget that reads every document. tokens_col adds the row's tokens.
    """
    named = docs.select(source_key(F.col(source_col)).alias("key"), F.col(id_col).cast("string").alias("id"), token_count(F.col(text_col)).alias("tokens"))
    weights = materialise(named, "weights")
    sources = weights.groupBy("key").agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    total = weights.agg(F.sum("tokens")).first()[0] or 0
    budget = None if budget_ratio is None else budget_ratio * total
    alpha = fit_alpha(sources, entropy, max_repeat, budget) if total else 1.0
    cuts = plan(weights, alpha, budget, seed, block_docs).select(*[F.col(c).alias(f"__{c}") for c in ("key", "passes", "blocks", "rest", "cut_hash", "cut_block", "cut_doc")])
    joined = docs.join(cuts, source_key(F.col(source_col)) == F.col("__key"))
    block, key = block_of(F.col(id_col).cast("string"), F.col("__blocks"), seed), F.col(id_col).cast("string")
    h = order_hash(block, F.col("__passes"), seed)
    whole = F.col("__cut_hash").isNull() | (h < F.col("__cut_hash")) | ((h == F.col("__cut_hash")) & (block < F.col("__cut_block")))
    within = (block == F.col("__cut_block")) & (order_hash(key, F.col("__passes"), seed) <= F.col("__cut_doc"))
    extra = F.when((F.col("__rest") > 0) & (whole | within), 1).otherwise(0)
    times = F.col("__passes") + extra
    out = joined.withColumn(epoch_col, F.explode(F.when(times > 0, F.sequence(F.lit(0), times - 1)).otherwise(F.array().cast("array<int>"))))
    added = [F.col(epoch_col)] + ([token_count(F.col(text_col)).alias(tokens_col)] if tokens_col else [])
    return out.select(*[F.col(c) for c in docs.columns], *added)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus's own number of tokens, no source read more than twice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs, budget_ratio=1.0, max_repeat=2.0, tokens_col="n_tokens").drop("text")
