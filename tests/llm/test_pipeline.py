import corpus_pipeline
import pytest

import __spark_entry__
from lumenspan.llm import minhash, mixing, pii
from lumenspan.llm.common import materialize

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], SF), "test-" + name.replace(" ", "-")))
    return out


def test_each_stage_does_its_part(spark, stages):
    docs, good, unique, clean, mixed, packed = stages
    assert all(s.columns == docs.columns for s in stages[:-1])
    assert 0 < good.count() < docs.count()
    kept = {r["doc_id"] for r in minhash.near_duplicates(good).where("kept").collect()}
    assert {r["doc_id"] for r in unique.collect()} == kept and unique.count() == len(kept)
    assert {r["doc_id"] for r in clean.collect()} == kept
    assert pii.with_spans(clean).where("size(base_) > 0").isEmpty()
    plan = mixing.planned_copies(mixing.doc_sizes(clean)).collect()
    assert mixed.count() == sum(r["copies"] for r in plan)
    assert packed.where("piece = 0").count() == mixed.count()


def test_run_equals_the_stages(spark, stages):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() == stages[-1].count()
    assert rows.agg({"length": "sum"}).first()[0] == stages[-1].agg({"length": "sum"}).first()[0]


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14))
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_odd_rows_and_empty_tables(spark, docs, tmp_path):
    sf = f"file://{tmp_path}"
    spark.createDataFrame([(1, 1, 0), (None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    text = lambda name, n=12: " ".join(f"{name}{chr(97 + i % 26)}{i}x" for i in range(n))
    df = docs((1, text("one")), (1, text("one")), (2, None), (3, ""), (4, text("four") + " a@b.co", None), (None, text("null")), (5, text("five"), "en", None), (6, text("six", 9000)), extra=True)
    ids, out = {}, df
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, out, sf), "odd-" + name.replace(" ", "-"))
        if name != "best-fit packing":
            assert out.columns == df.columns
            ids[name] = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out.collect())
    assert ids["quality rules"] == [(False, 1), (False, 1), (False, 4), (False, 5), (False, 6), (True, 0)]
    assert ids["near duplicates"] == ids["personal data"] == [(False, 1), (False, 4), (False, 5), (False, 6), (True, 0)]
    assert {i for _, i in ids["source mix"]} >= {5} and out.where("doc_id = 6").count() >= 1
    empty = df.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = materialize(stage(spark, empty, sf), "none")
    assert empty.count() == 0
