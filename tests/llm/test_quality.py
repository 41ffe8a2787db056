import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lumenspan.llm import quality


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None, "", " \t\n", "one", "a b c d e a b c d e", "x x x x x x x x", "line\nline\n\nline\n other", "é# *$%&|<> ß\x0b\x0cz",
    "a b c d e f g h i j k l a b c d e z", "w " * 3000, "\n".join(["same old line here"] * 40), "q r s t u v q r s t u v q r s t u",
]


def test_measures_equal_brute_force(spark, docs):
    df = docs(*enumerate(TEXTS), extra=False)
    rows = {r["doc_id"]: r for r in quality.with_measures(df).collect()}
    for i, text in enumerate(TEXTS):
        r = rows[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(text), text


def test_binomial_tail():
    assert quality.binomial_tail(0, 10, 0.5) == pytest.approx(1 / 1024)
    assert quality.binomial_tail(10, 10, 0.3) == pytest.approx(1.0)
    assert quality.binomial_tail(1, 3, 0.2) == pytest.approx(0.8**3 + 3 * 0.2 * 0.8**2)


def corpus(docs, n):
    good = [(i, f"plain words of document number {i} that carry some sense and go on for a while", "en") for i in range(n)]
    bad = [(n + i, f"bad### words%%% of*** document{i} $$$ that&&& carry||| symbols<<< and>>> more*** of### them {i}", "en") for i in range(50)]
    return docs(*good, *bad)


def test_cutoffs_are_certified_only_with_enough_labels(spark, docs):
    df = corpus(docs, 4000)
    labels = df.select("doc_id", (F.col("doc_id") < 4000).cast("int").alias("quality"))
    measured = quality.with_measures(df)
    cutoffs = quality.calibrate(measured, labels)
    assert cutoffs["en"] == {"symbol_ratio": 0.3}  # the most lenient cutoff that catches all
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and kept.count() == 4000
    few = labels.where("doc_id < 50 OR doc_id >= 4000")
    assert quality.calibrate(measured, few) == {}
    assert quality.keep_good(df, few).count() == 4050  # nothing is proved, so only the base rules reject


def test_false_rejections_stop_the_walk(spark, docs):
    df = corpus(docs, 4000)
    labels = df.select("doc_id", F.lit(1).alias("quality"))  # the symbol texts are good here
    assert quality.calibrate(quality.with_measures(df), labels)["en"].get("symbol_ratio", 0.3) >= 0.2


def test_nulls_repeats_empty_tables_and_clashing_columns(spark, docs):
    df = docs((1, None, None), (2, "one two three four five six seven eight nine ten", None), (2, "one two three four five six seven eight nine ten", None), (None, "a", "en"), extra=True)
    labels = spark.createDataFrame([(2, None), (2, 1), (99, 0)], "doc_id long, quality int")
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and [r["doc_id"] for r in kept.collect()] == [2, 2]
    assert quality.keep_good(df.limit(0), labels).count() == 0
    assert quality.keep_good(df, labels.limit(0)).count() == 2


def test_a_few_hundred_labels_certify(spark, docs):
    df = corpus(docs, 100)
    labels = df.select("doc_id", (F.col("doc_id") < 100).cast("int").alias("quality"))
    assert quality.fewest_labels(1) == 63 and quality.fewest_labels(4) == 90
    assert quality.calibrate(quality.with_measures(df), labels)["en"] == {"symbol_ratio": 0.3}
    assert quality.keep_good(df, labels).count() == 100
    assert quality.calibrate(quality.with_measures(df), labels.where("doc_id >= 38")) == {}  # 62 good ones


def test_all_rules_together_lose_at_most_alpha():
    # Every rule alone rejects few of 1,000 good documents, but together they reject too many.
    grids = list(quality.RULES.values())
    alone = [tuple(len(g) if r == j else 0 for j, g in enumerate(grids)) for r in range(len(grids))]
    cells = [((0,) * len(grids), 985, 0), *((levels, 3, 200 - i) for i, levels in enumerate(alone))]
    found = quality.certified(cells, 0.01, 0.05)
    assert list(found) == ["symbol_ratio"]
    # The rule that catches most breaks on good documents; another one is still certified.
    found = quality.certified([((0,) * len(grids), 960, 0), (alone[0], 40, 20), (alone[1], 0, 10)], 0.01, 0.05)
    assert "symbol_ratio" not in found and found["dup_line_ratio"] == 0.9  # the most lenient cutoff that catches them


def test_a_lost_good_document_must_be_worth_it():
    n = len(quality.RULES)
    cells = [((0,) * n, 985, 0), ((1, *[0] * (n - 1)), 2, 15), ((9, *[0] * (n - 1)), 0, 30)]
    # The strictest cutoff is proved too, but two good documents for 15 bad ones are not worth it.
    assert quality.certified(cells, 0.05, 0.05) == {"symbol_ratio": 0.3}


def test_labelled_tables_of_some_size_are_judged(spark):
    d = "/root/testdata/sf0.1"
    df = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "text")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    measured = quality.with_measures(df).drop("text").cache()
    assert set(quality.calibrate(measured, labels)) == {"en", "de", "fr", "es"}
    judged = quality.judge(measured, labels).join(labels, "doc_id").where("NOT base_failed")
    n = {(r["quality"], r["kept"]): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    measured.unpersist()
    assert n[0, False] > 0.95 * (n[0, False] + n.get((0, True), 0))
    assert n.get((1, False), 0) <= 0.01 * (n[1, True] + n.get((1, False), 0))
