"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Every text gets a fixed set of measures. Two base rules always reject. The other
rules reject a document whose measure lies above a cutoff that is chosen per stratum
(language) on labelled documents. All rules of a stratum are certified together, as
one score: a chain of joint cutoffs is walked from lenient to strict, one rule after
another, and its last point is taken at which the false rejection rate of all rules
together among good documents is proved, by an exact binomial tail, to be at most
``alpha``. Within one chain no correction is needed, for it stops at the first
failure. The order of the rules comes from the documents labelled bad alone, which
the test never counts: first the rule that catches most of them, then always the one
that catches most of the rest. Lest a rule that good documents break too should block
the others, there is one more chain for each other rule, which begins with that rule.
The first chain is tested at ``MAIN`` times ``delta`` by the number of strata, the
other chains share the rest of it (Bonferroni over strata and chains). All proved points
hold at once, so any of them may be used: it is the one with most bad documents caught
less ``PRICE`` times the good ones lost, and none if no point is worth it. With probability 1 - delta no stratum
then loses more than ``alpha`` of its good documents. Without enough labels nothing
can be proved, and the rules reject nothing there; ``fewest_labels`` says how many good
documents a stratum needs.

Defined results: a null text has no words and fails the base rules; a null stratum is
a stratum; several labels of one document count as good if one of them is; null
labels and labels of unknown documents are ignored; repeated rows are judged alike.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenspan.llm.common import GAP, SPACES, materialize

MIN_WORDS = 10
REPEAT_PERCENT = 20
SYMBOLS = "#*$%&|<>"
ALPHA = 0.05
DELTA = 0.05
#: So many bad documents caught weigh as much as one good document lost, among proved points.
PRICE = 10
#: The first chain's part of a stratum's test level.
MAIN = 0.8
#: Measure and cutoffs from lenient to strict; a document is rejected above the cutoff.
RULES: dict[str, tuple[float, ...]] = {
    "symbol_ratio": (0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02, 0.01),
    "dup_line_ratio": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3),
    "repeat_ratio": (0.18, 0.15, 0.12, 0.1, 0.08),
    "upper_ratio": (0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1),
    "word_length": (20.0, 15.0, 12.0, 10.0, 9.0, 8.5, 8.0, 7.5, 7.0),
}
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines_", "n_upper_")


def _count_of(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def with_measures(docs: DataFrame) -> DataFrame:
    """``docs`` with the measures of their texts (bigint columns named in MEASURES)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, GAP), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    step = docs.select(
        "*",
        F.transform(words, lambda w: F.xxhash64(w)).alias("words_"),
        lines.alias("lines_"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        _count_of(text, SYMBOLS).cast("long").alias("n_symbols"),
        _count_of(text, UPPER).cast("long").alias("n_upper_"),
    )
    at = lambda i, k: F.get(F.col("words_"), i + k)
    step = step.select(
        "*",
        F.size("words_").cast("long").alias("n_words"),
        F.size("lines_").cast("long").alias("n_lines_"),
        (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size("words_") >= 5,
            F.transform(F.sequence(F.lit(0), F.size("words_") - 5), lambda i: F.xxhash64(at(i, 0), at(i, 1), at(i, 2), at(i, 3), at(i, 4))),
        ).alias("wins_"),
    ).drop("words_", "lines_")
    step = step.withColumn("order_", F.when(F.size(F.array_distinct("wins_")) < F.size("wins_"), F.array_sort(F.transform("wins_", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    last = F.size("wins_") - 1
    near = lambda x, j: ((j > 0) & (F.get(F.col("order_"), j - 1)["h"] == x["h"])) | ((j < last) & (F.get(F.col("order_"), j + 1)["h"] == x["h"]))
    step = step.withColumn(
        "starts_",
        F.array_sort(F.filter(F.transform("order_", lambda x, j: F.when(near(x, j), x["i"])), lambda i: i.isNotNull())),
    ).drop("order_", "wins_")
    spans = F.transform("starts_", lambda s, j: F.least(F.lit(5), F.coalesce(F.get(F.col("starts_"), j + 1) - s, F.lit(5))))
    return step.withColumn("n_repeat_words", F.coalesce(F.aggregate(spans, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")).drop("starts_")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def measure(rule: str) -> Column:
    """A rule's measure as a double; 0 where its divisor is 0."""
    over = {
        "symbol_ratio": ("n_symbols", "word_chars"),
        "dup_line_ratio": ("n_dup_lines", "n_lines_"),
        "repeat_ratio": ("n_repeat_words", "n_words"),
        "upper_ratio": ("n_upper_", "word_chars"),
        "word_length": ("word_chars", "n_words"),
    }[rule]
    return F.when(F.col(over[1]) > 0, F.col(over[0]) / F.col(over[1])).otherwise(F.lit(0.0))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k)."""
    logs = [
        math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
        for i in range(k + 1)
    ]
    return min(1.0, math.fsum(map(math.exp, logs)))


def fewest_labels(n_strata: int, alpha: float = ALPHA, delta: float = DELTA) -> int:
    """Good documents that a stratum needs for any proof, if none of them is rejected."""
    return math.ceil(math.log(MAIN * delta / n_strata) / math.log1p(-alpha))


def chains(cells: list[tuple[tuple[int, ...], int, int]]) -> list[list[int]]:
    """The orders in which the rules (by index) are tightened, the first by the bad documents caught."""
    order: list[int] = []
    rest = [(levels, bad) for levels, _, bad in cells if bad]
    while len(order) < len(RULES):
        best = max((r for r in range(len(RULES)) if r not in order), key=lambda r: sum(bad for levels, bad in rest if levels[r]))
        order.append(best)
        rest = [(levels, bad) for levels, bad in rest if not levels[best]]
    return [order] + [[r, *(o for o in order if o != r)] for r in order[1:]]


def certified(cells: list[tuple[tuple[int, ...], int, int]], alpha: float, level: float) -> dict[str, float]:
    """A stratum's cutoffs. A cell is (how many cutoffs of each rule the measure exceeds, good documents, bad ones)."""
    n = sum(good for _, good, _ in cells)
    grids = list(RULES.values())
    most, found = 0, [0] * len(grids)
    for nth, order in enumerate(chains(cells)):
        part = level * (MAIN if nth == 0 else (1 - MAIN) / (len(grids) - 1))
        used, good, bad, left = [0] * len(grids), 0, 0, cells
        for rule, step in ((r, i + 1) for r in order for i in range(len(grids[r]))):
            # The cutoff numbered step is exceeded if at most the step - 1 more lenient ones are not.
            hit = [c for c in left if c[0][rule] + step > len(grids[rule])]
            good += sum(c[1] for c in hit)
            if good > alpha * n or binomial_tail(good, n, alpha) > part:  # a tail from the mean on is at least 1/2
                break
            bad += sum(c[2] for c in hit)
            left = [c for c in left if c[0][rule] + step <= len(grids[rule])]
            used[rule] = step
            if bad - PRICE * good > most:
                most, found = bad - PRICE * good, list(used)
    return {name: cuts[step - 1] for (name, cuts), step in zip(RULES.items(), found, strict=True) if step}


def calibrate(measured: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> dict[str | None, dict[str, float]]:
    """Certified cutoffs: stratum -> rule -> cutoff.

    The driver gets counts by the cutoffs exceeded, of the strata that have enough good
    documents for any proof: for each of them at most one row for each point of the
    grid (30,000 to 40,000), and never more rows than labelled documents.
    """
    known = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("best_"))
    exceeded = [sum((F.when(measure(r) > c, 1).otherwise(0) for c in cuts), F.lit(0)).alias(r) for r, cuts in RULES.items()]
    held = measured.join(known, "doc_id").where(~base_failed()).select(F.col(stratum).alias("stratum_"), (F.col("best_") == 1).alias("good_"), *exceeded)
    cells = held.groupBy("stratum_", *RULES).agg(F.count(F.when(F.col("good_"), 1)).alias("n_good_"), F.count(F.when(~F.col("good_"), 1)).alias("n_bad_"))
    n_strata = cells.where("n_good_ > 0").select("stratum_").distinct().count()
    if not n_strata:
        return {}
    by_stratum: dict[str | None, list[tuple[tuple[int, ...], int, int]]] = {}
    totals = cells.withColumn("n_", F.sum("n_good_").over(Window.partitionBy("stratum_")))
    for row in totals.where(F.col("n_") >= fewest_labels(n_strata, alpha, delta)).collect():
        by_stratum.setdefault(row["stratum_"], []).append((tuple(row[r] for r in RULES), row["n_good_"], row["n_bad_"]))
    return {name: certified(rows, alpha, delta / n_strata) for name, rows in by_stratum.items()}


def rejected(cutoffs: dict[str | None, dict[str, float]], stratum: str = "lang") -> Column:
    """Whether a certified rule of the document's stratum rejects it."""
    out = F.lit(False)
    for name, rules in sorted(cutoffs.items(), key=lambda x: (x[0] is None, x[0] or "")):
        fires = F.lit(False)
        for rule, cut in rules.items():
            fires = fires | (measure(rule) > F.lit(cut))
        out = out | (F.col(stratum).eqNullSafe(F.lit(name)) & fires)
    return out


def judge(measured: DataFrame, labels: DataFrame, stratum: str = "lang", **options) -> DataFrame:
    cutoffs = calibrate(measured, labels, stratum, **options)
    failed = base_failed()
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & ~rejected(cutoffs, stratum))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, columns unchanged; written once, as calibration reads them first."""
    inner = docs.select(F.struct(*docs.columns).alias("row_"), "doc_id", "lang", "text")
    measured = materialize(with_measures(inner).drop("text"), "quality-measures")
    return judge(measured, labels, **options).where("kept").select("row_.*")
