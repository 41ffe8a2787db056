"""Mixing sources to target weights.

Words are summed per source, a weighted share of the whole is set as each source's
target, and the quotient gives the source's repetition rate. A document is emitted
floor(rate) times, plus once more if a coin hashed from its id falls under the
fraction. A source's targets stop at ``cap`` times its size; the excess goes to the
other sources by weight.

Of ``seeds`` hash seeds every source uses the one whose coins bring its taken words
nearest to its target (the first of equals). Coins stay plain hash-seeded Bernoulli
draws, only the seed is chosen, which keeps sources of a few long documents near
their targets too. Over many choices of ``salt`` a document gets its extra copy about as
often as the fraction says; for one salt the draw is fixed.

Defined results: a null text has size 0; null is a source of its own, last in order;
a null id gets the coin of the empty string; repeated rows share their coin; a source
without words has target 0 and is emitted 0 times; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspan.llm.common import materialize, with_prefix, word_count

WEIGHTS = (5, 2, 1)
CAP = 3
SEEDS = 16


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Rows (source, source_size, target) from rows (source, size)."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = with_prefix(
        sources.withColumn("last", F.col("source").isNull()), ["last", "source"], "source_size", "mix-sources"
    )
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    weighted = materialize(
        ordered.select("source", "source_size", F.get(cycle, (F.col("position") % len(weights)).cast("int")).cast("long").alias("weight")),
        "mix-weights",
    )
    level = _level(weighted, cap)
    share = F.col("weight") * F.lit(level)
    most = (cap * F.col("source_size")).cast("double")
    return weighted.select("source", "source_size", F.least(share, most).alias("target"))


def _level(weighted: DataFrame, cap: int) -> float:
    """Words per unit of weight once no source is above its cap.

    Every round counts the sources above the level as full and reshares the rest;
    the level only rises, so the rounds end. The driver holds three sums.
    """
    level = 0.0
    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    while True:
        full = (F.col("weight") * F.lit(level)) > (cap * F.col("source_size"))
        held, weight = weighted.agg(
            F.sum(F.when(full, cap * F.col("source_size")).otherwise(0)),
            F.sum(F.when(full, 0).otherwise(F.col("weight"))),
        ).first()
        raised = (total - (held or 0)) / weight if weight else level
        if raised <= level:
            return level
        level = raised


def coin(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from the md5 of seed and id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def mix_plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seeds: int = SEEDS, salt: int = 0) -> DataFrame:
    """Rows (source, source_size, target, rate, seed), one per source, from rows (doc_id, source, size)."""
    targets = materialize(
        source_targets(sizes, weights, cap).withColumn(
            "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
        ),
        "mix-targets",
    )
    base = F.floor("rate")
    extra = [
        F.sum(F.when(coin(F.col("doc_id"), salt * seeds + s) < F.col("rate") - base, F.col("size")).otherwise(0)).alias(f"extra_{s}")
        for s in range(seeds)
    ]
    drawn = _with_source(sizes, targets).groupBy("source").agg(F.first("rate").alias("rate"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), *extra)
    off = F.array(*[F.abs(base * F.col("source_size") + F.col(f"extra_{s}") - F.col("target")) for s in range(seeds)])
    chosen = drawn.select("source", "source_size", "target", "rate", (F.array_position(off, F.array_min(off)) - 1).cast("int").alias("seed"))
    return materialize(chosen, "mix-plan")


def _with_source(docs: DataFrame, table: DataFrame) -> DataFrame:
    named = table.withColumnRenamed("source", "source_of_plan")
    return docs.join(named, docs["source"].eqNullSafe(named["source_of_plan"])).drop("source_of_plan")


def copies(doc_id: Column, rate: Column, seed: Column, seeds: int = SEEDS, salt: int = 0) -> Column:
    """How often a document is emitted."""
    drawn = F.lit(None).cast("double")
    for s in reversed(range(seeds)):
        drawn = F.when(seed == s, coin(doc_id, salt * seeds + s)).otherwise(drawn)
    return (F.floor(rate) + F.when(drawn < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def doc_sizes(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, source, size), written once so that texts are read for their words once."""
    return materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")


def planned_copies(sizes: DataFrame, **options) -> DataFrame:
    """``sizes`` with source_size, target, rate and copies."""
    plan = mix_plan(sizes, **options)
    drawn = {k: v for k, v in options.items() if k in ("seeds", "salt")}
    return _with_source(sizes, plan).withColumn("copies", copies(F.col("doc_id"), F.col("rate"), F.col("seed"), **drawn))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as its source's rate says, columns unchanged."""
    plan = mix_plan(doc_sizes(docs), **options).select(
        F.col("source").alias("plan_source_"), F.col("rate").alias("plan_rate_"), F.col("seed").alias("plan_seed_")
    )
    drawn = {k: v for k, v in options.items() if k in ("seeds", "salt")}
    times = copies(docs["doc_id"], F.col("plan_rate_"), F.col("plan_seed_"), **drawn).cast("int")
    return (
        docs.join(plan, docs["source"].eqNullSafe(plan["plan_source_"]))
        .select(*[docs[c] for c in docs.columns], F.explode(F.array_repeat(F.lit(0), times)).alias("copy_"))
        .drop("copy_")
    )
