import pytest
from pyspark.sql import functions as F

from lumenspan.llm import mixing, q_mixing


def planned(df, **options):
    rows = mixing.planned_copies(mixing.doc_sizes(df), **options).collect()
    return {r["doc_id"]: r for r in rows}, rows


def test_targets_share_all_words_by_weight(spark, docs):
    rows = [(i, "a b c d", "en", s) for i, s in enumerate(["a", "b", "c", "d"] * 50)]
    found, _ = planned(docs(*rows))
    targets = {r["doc_id"] % 4: r["target"] for r in found.values()}
    assert sum(targets.values()) == pytest.approx(800)
    assert targets[0] / targets[2] == pytest.approx(5)
    taken = sum(r["copies"] * r["size"] for r in found.values())
    assert taken == pytest.approx(800, rel=0.1)
    assert max(r["copies"] for r in found.values()) <= 3


def test_targets_stop_at_cap_and_excess_is_reshared(spark, docs):
    rows = [(0, "w", "en", "a"), *[(i, "w " * 10, "en", "b") for i in range(1, 11)]]
    found, _ = planned(docs(*rows))
    assert found[0]["target"] == 3.0 and found[0]["copies"] == 3
    assert found[1]["target"] == pytest.approx(98.0)


def test_nulls_ties_repeats_and_clashing_columns(spark, docs):
    df = docs((1, None, "en", None), (2, "", "en", None), (None, "a b", "en", "x"), (3, "c d", "en", "x"), (3, "c d", "en", "x"), extra=True)
    _, rows = planned(df)
    assert len(rows) == 5
    assert [r["target"] for r in rows if r["source"] is None] == [0.0, 0.0]
    assert len({r["copies"] for r in rows if r["doc_id"] == 3}) == 1
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    expected = sum(r["copies"] for r in rows)
    assert mixed.count() == expected


def test_reruns_agree_and_empty_table(spark, docs):
    df = docs(*[(i, "one two three " * (i % 7 + 1), "en", f"s{i % 5}") for i in range(100)])
    assert sorted(map(tuple, mixing.mix(df).collect())) == sorted(map(tuple, mixing.mix(df).collect()))
    assert mixing.mix(df.limit(0)).count() == 0


def test_very_long_text_and_null_source_last(spark, docs):
    df = docs((1, "word " * 200_000, "en", "a"), (2, "x", "en", None))
    found, _ = planned(df)
    assert found[1]["size"] == 200_000
    assert found[2]["target"] == pytest.approx(3.0)


def test_query_columns(spark):
    df = q_mixing.query(spark, "/root/testdata/sf0.001")
    assert df.columns == ["doc_id", "size", "source_size", "target", "taken"]
    assert df.where(F.col("taken") > 3 * F.col("size")).isEmpty()


def test_copies_over_many_salts_follow_the_fraction(spark):
    rows = [(i, "a" if i < 40 else "b", 10 + i % 7) for i in range(120)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, size long")
    drawn, rate = [], {}
    for salt in range(8):
        found = mixing.planned_copies(sizes, seeds=4, salt=salt).collect()
        rate = {r["source"]: r["rate"] for r in found}
        drawn += [(r["source"], r["copies"] - int(r["rate"])) for r in found]
    for source, n in (("a", 40), ("b", 80)):
        mean = sum(x for s, x in drawn if s == source) / (8 * n)
        assert abs(mean - (rate[source] - int(rate[source]))) < 0.08
