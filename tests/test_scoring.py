"""Fitted models, valence rules and intake against plain versions."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lumenspan.operators import intake, models, valence


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(4)
    made = [(i, r.gauss(0, 2), r.gauss(5, 1), None) for i in range(300)]
    made = [(i, a, b, int(a - b + 5 + r.gauss(0, 0.5) > 0) if i % 3 else None) for i, a, b, _ in made] + [(900, None, float("nan"), None), (901, float("inf"), 1.0, None)]
    return spark.createDataFrame(made, "id long, a double, b double, y int").cache()


def test_scores_are_the_coefficients_applied(spark, rows, tmp_path):
    store = models.ModelStore(spark, f"file://{tmp_path}/models")
    store.save("m", "1", models.fitted(rows, ["a"], "y"))
    store.save("m", "2", models.fitted(rows, ["a", "b"], "y"))
    assert store.versions("m") == ["1", "2"] and store.versions("other") == []
    with pytest.raises(ValueError, match="saved already"):
        store.save("m", "1", store.load("m", "1"))
    with pytest.raises(KeyError):
        store.load("m", "3")
    assert store.load("m", "2") is store.load("m", "2")
    for version in ("1", "2"):
        model = models.ModelStore(spark, store.folder).load("m", version)
        names, scaler, line = models.features_of(model), model.stages[1], model.stages[2]
        right = 0
        for x in models.scored(model, rows).collect():
            values = [0.0 if x[n] is None or not math.isfinite(x[n]) else x[n] for n in names]
            z = line.intercept + sum(c * (v - m) / s for c, v, m, s in zip(line.coefficients, values, scaler.mean, scaler.std, strict=True))
            assert x["probability"][1] == pytest.approx(1 / (1 + math.exp(-z))) and sum(x["probability"]) == pytest.approx(1)
            assert x["prediction"] == int(z > 0)
            right += x["y"] is not None and x["prediction"] == x["y"]
        assert right > 200 * (0.75 if version == "1" else 0.9)


LEXICON = {"good": 2.0, "great": 3.1, "bad": -2.5, "awful": -3.0, "fine": 0.8, "straße": 1.5}


def by_hand(text):
    words = [w for w in (re.sub(r"^[\W_]+|[\W_]+$", "", w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")) if w]
    loud = [w.upper() == w and w.lower() != w and len(w) > 1 for w in words]
    low = [w.lower() for w in words]
    but = low.index("but") if "but" in low else None
    scores = []
    for i, w in enumerate(low):
        v = LEXICON.get(w)
        if v is None:
            continue
        sign = 1 if v > 0 else -1
        v += sign * 0.733 * (loud[i] and sum(loud) < len(words))
        for d, fade in ((1, 1.0), (2, 0.95), (3, 0.9)):
            if i >= d:
                v += sign * fade * 0.293 * ((low[i - d] in valence.STRONGER) - (low[i - d] in valence.WEAKER))
        v *= -0.74 if any(low[i - d] in valence.NEGATIONS for d in (1, 2, 3) if i >= d) else 1
        scores.append(v * (1 if but is None or i == but else 0.5 if i < but else 1.5))
    asked = (text or "").count("?")
    marks = min((text or "").count("!"), 4) * 0.292 + (0.96 if asked > 3 else 0.18 * asked if asked > 1 else 0)
    total = sum(scores)
    total += (total > 0) * marks - (total < 0) * marks
    pos, neg = sum(v + 1 for v in scores if v > 0), sum(1 - v for v in scores if v < 0)
    pos, neg = pos + marks * (pos > neg), neg + marks * (neg > pos)
    rest = len(words) - len(scores)
    whole = pos + neg + rest
    return (pos / whole, neg / whole, rest / whole, total / math.sqrt(total**2 + 15)) if whole else (0.0, 0.0, 1.0, 0.0)


def test_valence_equals_a_walk_over_words(spark):
    r = random.Random(6)
    pool = [*LEXICON, "GOOD", "AWFUL!", "(great)", "very", "hardly", "not", "never", "but", "BUT", "the", "a", "Straße", "...", "??", "!!!", "x_y", "don't"]
    texts = [None, "", "  ", "!!!", "GREAT", "not very GOOD!!", "good but awful???"] + [" ".join(r.choice(pool) for _ in range(r.randint(1, 14))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    lexicon = spark.createDataFrame(list(LEXICON.items()), "word string, valence double")
    for row in valence.valence_scores(df, "id", "text", lexicon).collect():
        assert tuple(row)[1:] == pytest.approx(by_hand(texts[row["id"]])), texts[row["id"]]
    mixed = valence.blended(valence.valence_scores(df, "id", "text", lexicon), F.lit(0.0))
    assert {x["label"] for x in mixed.collect()} == {"positive", "negative", "neutral"}


def test_a_lexicon_is_learned_from_labels(spark):
    docs = spark.createDataFrame([(i, "nice clean text" if i % 2 else "spam spam text") for i in range(40)] + [(99, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(99, 1)], "doc_id long, quality int")
    found = {x["word"]: x["valence"] for x in valence.learned_lexicon(docs, labels).collect()}
    assert found["nice"] == 4.0 and found["spam"] == -4.0 and "text" not in found


def test_rows_are_appended_once(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.range(10).write.parquet(path)
    new = spark.createDataFrame([(5,), (20,), (20,), (None,)], "id long")
    assert sorted(x[0] for x in intake.appended(new, path, "id").collect()) == [*range(10), 20]
    assert intake.appended(new, path, "id").count() == 11
    assert spark.read.parquet(path).count() == 11


def test_reference_stream(spark):
    rows = [(1, 7, "hls", "relative", 1.0, 10, False), (2, 8, "flv", "epoch", 2.0, 20, False), (3, 7, "rtmp", "epoch", 3.0, 30, False)]
    schema = "request_id long, stream_id long, format string, time_form string, base double, at long, is_reference boolean"
    found = {x["stream_id"]: tuple(x) for x in intake.registered(spark.createDataFrame(rows, schema)).collect()}
    assert found == {7: (7, "rtmp", "epoch", 3.0, 10, True), 8: (8, "flv", "epoch", 2.0, 20, False)}
    asked = [*rows, (4, 9, "hls", "epoch", None, 40, True), (5, 8, "flv", "epoch", 2.0, 50, True)]
    assert [x["stream_id"] for x in intake.registered(spark.createDataFrame(asked, schema)).where("is_reference").collect()] == [8]
    assert intake.registered(spark.createDataFrame([], schema)).count() == 0


def test_topics_find_planted_ones(spark):
    from lumenspan.operators import content

    r = random.Random(1)
    fields = [["goal", "striker", "penalty", "keeper", "stadium"], ["boss", "dungeon", "loot", "raid", "healer"], ["guitar", "chorus", "melody", "drummer", "encore"]]
    rows = [(i, " ".join(r.choice(fields[i % 3]) for _ in range(12))) for i in range(150)]
    found = content.topics(spark.createDataFrame(rows, "id long, message string"), clusters=3).collect()
    assert sum(t["n"] for t in found) == 150
    for t in found:
        own = [sum(any(w in k for w in f) for k in t["keywords"]) for f in fields]
        assert max(own) >= 0.9 * len(t["keywords"])
    assert sorted(t["n"] for t in found) == [50, 50, 50]


def test_frames_kept_in_a_buffer(spark):
    from lumenspan.streaming import windows

    r = random.Random(2)
    rows = [(s, i, r.uniform(0, 1000), r.random() < 0.2) for s in range(4) for i in range(1000 * s, 1000 * s + (3, 40, 90, 200)[s])]
    df = spark.createDataFrame(rows, "stream_id long, frame_id long, t double, is_keyframe boolean")
    wanted = set()
    for s in range(4):
        mine = sorted((x for x in rows if x[0] == s), key=lambda x: (x[2], x[1]))
        while len(mine) > 50 and 1000 - mine[0][2] > (360 if mine[0][3] else 300):
            mine.pop(0)
        wanted |= {x[1] for x in mine}
    assert {x["frame_id"] for x in windows.retained(df, F.lit(1000.0), fewest=50).collect()} == wanted
    assert windows.retained(df.limit(0), F.lit(0.0)).count() == 0
