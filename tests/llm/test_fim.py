import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lumenspan.llm import fim

TEXTS = ["", None, "x", "a😀b\r\ńé", "one two\n\nthree  four. Five! 𝒳y 12ab", "has <P> inside", "almost <P < S> <M", "<", "<S", "same", "same", "z" * 300_000, "word " * 40_000]


def by_hand(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_equals_python_over_code_points(docs):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(120)] + [(None, "no id"), (7, "again"), (7, "again")]
    df = docs(*rows).withColumn("form", F.lit("theirs")).withColumn("row", F.lit(1)).withColumn("pieces", F.lit(2))
    out = fim.fill_in_middle(df).withColumn("rebuilt", fim.restored(F.col("output"), F.col("form")))
    found = sorted((str(r["doc_id"]), r["text"] or "", r["n_units"], r["form"], r["prefix_units"], r["middle_units"], r["output"], r["rebuilt"]) for r in out.collect())
    wanted = sorted((str(i), t or "", *by_hand(i, t), t or "") for i, t in rows)
    assert [tuple(map(str, f)) for f in found] == [tuple(map(str, w)) for w in wanted]
    assert out.filter("row = 1 AND pieces = 2").count() == len(rows)
    assert {f[3] for f in found} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("unit", "pattern"),
    [("code_point", r"(?s)."), ("word", r"[^\x20\x09-\x0D]*[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+"), ("line", r"[^\n]*\n|[^\n]+"), ("run", r"[A-Za-z]+|[0-9]+|[\x20\x09-\x0D]+|[^A-Za-z0-9\x20\x09-\x0D]"), ("sentence", r"(?s).+?[.!?](?=[\x20\x09-\x0D])|.+\Z")],
)
def test_units_of_every_grammar(docs, unit, pattern):
    texts = [t for t in TEXTS if t] + ["a.b! c?  d", "1a2 3", "\n\n", " lead", "trail "]
    df = docs(*enumerate(texts))
    for r in df.select("doc_id", fim.units(F.col("text"), unit).alias("u")).collect():
        text = texts[r["doc_id"]]
        assert "".join(r["u"]) == text and all(r["u"])
        assert r["u"] == re.findall(pattern, text)
    made = fim.fill_in_middle(df, unit=unit)
    back = made.select("text", fim.restored(F.col("output"), F.col("form")).alias("back"), "n_units", "prefix_units", "middle_units")
    assert all(r["text"] == r["back"] and (r["prefix_units"] is None or r["prefix_units"] + r["middle_units"] <= r["n_units"]) for r in back.collect())


def test_stays_in_one_stage(docs):
    plan = fim.fill_in_middle(docs((1, "a b c")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
