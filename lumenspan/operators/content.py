"""Scores of transcripts, energies and sets of results; topics; the choice of highlights as they come."""

from __future__ import annotations

import math

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, NGram, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenspan.functions import text as X
from lumenspan.functions.scalar import normalize, word_jaccard
from lumenspan.operators.temporal import band_join, fold_by, overlap_ratio
from lumenspan.sources.shared import written

# Fixed words of excited speech, weights of categories and limits.
SPOKEN = (
    "wow", "epic", "insane", "incredible", "amazing", "awesome", "sick", "clutch", "poggers", "pog", "lets go", "let's go", "holy", "oh my god", "omg", "no way", "unbelievable", "crazy",
    "nuts", "wild", "fire", "lit", "hype", "beast",
    "goal", "score", "touchdown", "home run", "slam dunk", "knockout", "winner", "champion", "victory", "comeback", "upset", "record", "fantastic", "brilliant",
    "yes", "yeah", "woah", "whoa", "outstanding", "phenomenal", "spectacular", "extraordinary", "perfect", "flawless", "legendary", "godlike",
)
CATEGORY_WEIGHTS = {"action": 1.2, "emotional": 1.1, "informative": 1.0, "humorous": 1.1, "dramatic": 1.2, "general": 0.9}
USUAL_SPEED, FAST_FROM = 160.0, 0.6


# ---- speech and sound --------------------------------------------------------------------


def spoken_words(text: Column) -> Column:
    """How often the listed words occur as words, in any case.

    No two of them can share a word of the text, so one pattern of all finds each of them as often as its own would.
    """
    return F.regexp_count(F.lower(text), F.lit(rf"\b(?=[{''.join(sorted({w[0] for w in SPOKEN}))}])(?:{'|'.join(SPOKEN)})\b"))


def keyword_score(found: Column, words: Column) -> Column:
    return normalize(10 * found / F.greatest(F.lit(1), words), method="sigmoid")


def speech_score(words: Column, seconds: Column) -> Column:
    """Words a minute above six tenths of the usual speed, through a logistic curve; 0 below."""
    speed = words / F.greatest(F.lit(0.1), seconds / 60) / USUAL_SPEED
    return F.when(speed > FAST_FROM, normalize(speed - FAST_FROM, method="sigmoid")).otherwise(0.0)


def rms_energy(samples: Column, frame: int, hop: int) -> Column:
    """Array of root mean squares of frames; the last frame that would end at the end is left out."""
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(samples) - frame, F.lit(0)), F.lit(hop)), lambda i: i < F.size(samples) - frame)
    square = lambda i: F.aggregate(F.slice(samples, i + 1, frame), F.lit(0.0), lambda a, x: a + x * x) / frame
    return F.transform(starts, lambda i: F.sqrt(square(i)))


def crossing_rate(samples: Column) -> Column:
    """Changes of sign from one sample to the next by the number of samples."""
    later = F.slice(samples, 2, F.size(samples) - 1)
    pairs = F.zip_with(F.slice(samples, 1, F.size(samples) - 1), later, lambda a, b: ((a >= 0) != (b >= 0)).cast("int"))
    return F.aggregate(pairs, F.lit(0), lambda s, x: s + x) / F.size(samples)


def volume_spikes(energy: Column, deviations: float = 2.0) -> Column:
    """Struct (spikes, intensity, consistency, score) of an array of energies."""
    n = F.size(energy)
    mean = F.aggregate(energy, F.lit(0.0), lambda a, x: a + x) / n
    spread = F.sqrt(F.aggregate(energy, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n)
    high = F.filter(energy, lambda x: x > mean + deviations * spread)
    count = F.size(high)
    intensity = F.when(count > 0, F.aggregate(high, F.lit(0.0), lambda a, x: a + x) / count / (mean + 1e-10)).otherwise(1.0)
    share = F.least(F.lit(1.0), count / n * intensity)
    return F.struct(count.alias("spikes"), intensity.alias("intensity"), F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), spread / (mean + 1e-10))).alias("consistency"), normalize(share, method="sigmoid").alias("score"))


# ---- sets of results ---------------------------------------------------------------------


def quality_scores(rows: DataFrame, key: str) -> DataFrame:
    """Per key weighted mean score, mean confidence, consistency and, without features, half of the diversity."""
    spread = F.when(F.count("*") > 1, 1 / (1 + F.var_pop("score"))).otherwise(1.0)
    return rows.groupBy(key).agg(F.count("*").alias("n"), (0.4 * F.avg("score") + 0.3 * F.avg("confidence") + 0.2 * spread + 0.1 * 0.5).alias("quality"))


def entropy_diversity(rows: DataFrame, features: list[str], bins: int = 10) -> DataFrame:
    """Mean entropy of the features' histograms of ten equal bins, by that of an even one."""
    ranges = rows.agg(*[F.min(f).alias(f"lo_{f}") for f in features], *[F.max(f).alias(f"hi_{f}") for f in features])
    total = None
    for f in features:
        width = (F.col(f"hi_{f}") - F.col(f"lo_{f}")) / bins
        place = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col(f) - F.col(f"lo_{f}")) / width))).otherwise(0)
        counts = rows.join(F.broadcast(ranges), F.lit(True)).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))
        p = F.col("n") / F.sum("n").over(Window.partitionBy())
        one = counts.withColumn("p", p).agg((-F.sum(F.col("p") * F.log(F.col("p") + 1e-10))).alias("e"))
        total = one if total is None else total.unionByName(one)
    return total.agg((F.avg("e") / F.log(F.lit(float(bins)))).alias("diversity"))


def determinant_diversity(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Determinant of the covariance of two features, within 0 and 1."""
    det = F.var_samp(a) * F.var_samp(b) - F.covar_samp(a, b) * F.covar_samp(a, b)
    return rows.agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), det)).alias("diversity"))


def cluster_similarity(clustered: DataFrame, longest: float = 240.0) -> DataFrame:
    """Per cluster the mean over pairs of half the overlap and half of 0.5; 1 for a single member.

    Only pairs that overlap add to the first half, so only they are joined.
    """
    sizes = clustered.groupBy("stream_id", "cluster").agg(F.count("*").alias("n"))
    other = clustered.select("stream_id", "cluster", F.col("id").alias("id2"), F.col("start_time").alias("s2"), F.col("end_time").alias("e2"))
    pairs = band_join(clustered, other, ["stream_id", "cluster"], "start_time", "s2", longest).where("id < id2")
    shared = pairs.groupBy("stream_id", "cluster").agg(F.sum(overlap_ratio(F.col("start_time"), F.col("end_time"), F.col("s2"), F.col("e2"))).alias("overlap"))
    n_pairs = F.col("n") * (F.col("n") - 1) / 2
    joined = sizes.join(shared, ["stream_id", "cluster"], "left")
    return joined.withColumn("similarity", F.when(F.col("n") < 2, 1.0).otherwise((F.coalesce("overlap", F.lit(0.0)) / n_pairs + 0.5) / 2)).drop("overlap")


def merged_clusters(clustered: DataFrame, target: Column) -> DataFrame:
    """Clusters joined by ``target``: members counted, the smallest number kept."""
    return clustered.withColumn("to_", target).groupBy("stream_id", "to_").agg(F.min("cluster").alias("cluster"), F.count("*").alias("n"), F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time")).drop("to_")


def category_results(rows: DataFrame, quality: Column, boost: float = 0.2, least_score: float = 0.5, least_confidence: float = 0.6) -> DataFrame:
    """Results with the weight of their category and a boost for good quality, that reach the limits."""
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in CATEGORY_WEIGHTS.items() for x in pair]), F.lower("category")), F.lit(CATEGORY_WEIGHTS["general"]))
    plain = F.col("score") * weight
    adjusted = F.when(quality > 0.7, F.least(F.lit(1.0), plain + (quality - 0.7) * boost)).otherwise(plain)
    return rows.withColumn("adjusted", F.round(adjusted, 9)).where((F.col("adjusted") >= least_score) & (F.col("confidence") >= least_confidence))


def modality_quality(score: Column, confidence: Column, aligned: Column, interpolated: Column) -> Column:
    return (score + confidence + F.when(aligned, 1.0).otherwise(0.5) + F.when(interpolated, 0.8).otherwise(1.0)) / 4


# ---- topics ------------------------------------------------------------------------------


def term_vocabulary(rows: DataFrame, terms: int, fewest: int = 2) -> list[str]:
    """The most frequent terms that are in ``fewest`` texts; the first in the alphabet of equals. rows: (id, weight, terms)."""
    each = rows.select("id", "weight", F.explode("terms").alias("term")).groupBy("id", "weight", "term").agg(F.count("*").alias("n"))
    found = each.groupBy("term").agg(F.sum(F.col("n") * F.col("weight")).alias("n"), F.sum("weight").alias("n_texts")).where(F.col("n_texts") >= fewest)
    return [r["term"] for r in found.orderBy(F.desc("n"), "term").limit(terms).select("term").collect()]


def topics(texts: DataFrame, clusters: int = 8, terms: int = 100, shown: int = 10, seed: int = 1) -> DataFrame:
    """Rows (topic, n, keywords): clusters of texts by the weights of their words and pairs of words.

    texts: (id, message) and, where equal texts come once, their number as ``weight``. Words
    and pairs are those in at least two texts, at most ``terms``. The texts are read twice,
    for the terms and for their counts; the model is fitted on the counts.
    """
    weight = F.col("weight").cast("long") if "weight" in texts.columns else F.lit(1).cast("long")
    words = texts.select("id", weight.alias("weight"), X.keywords(X.cleaned(F.col("message"))).alias("words"))
    pairs = NGram(n=2, inputCol="words", outputCol="pairs").transform(words)
    both = pairs.select("id", "weight", F.concat("words", "pairs").alias("terms")).where(F.size("terms") > 0)
    vocabulary = term_vocabulary(both, terms)
    counter = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="terms", outputCol="counts")
    known = F.array_intersect("terms", F.array(*[F.lit(v) for v in vocabulary]).cast("array<string>"))
    counted = written(counter.transform(both).select("id", "weight", "counts", known.alias("known")), "topic-counts")
    n_texts = counted.agg(F.sum("weight")).first()[0] or 0
    inside = {r["term"]: r["n"] for r in counted.select("weight", F.explode("known").alias("term")).groupBy("term").agg(F.sum("weight").alias("n")).collect()}
    scale = ElementwiseProduct(scalingVec=Vectors.dense([math.log((n_texts + 1) / (inside[v] + 1)) for v in vocabulary]), inputCol="counts", outputCol="weights")
    weighed = Normalizer(inputCol="weights", outputCol="features").transform(scale.transform(counted)).select("weight", "features")
    model = KMeans(k=clusters, seed=seed, weightCol="weight").fit(weighed)
    centres = [(i, [vocabulary[j] for j in sorted(range(len(c)), key=lambda j: -c[j])[:shown]]) for i, c in enumerate(model.clusterCenters())]
    sizes = model.transform(weighed).groupBy(F.col("prediction").alias("topic")).agg(F.sum("weight").alias("n"))
    return sizes.join(F.broadcast(texts.sparkSession.createDataFrame(centres, "topic int, keywords array<string>")), "topic")


# ---- highlights as they come ---------------------------------------------------------------


def similarity(t1: Column, t2: Column, text1: Column, text2: Column) -> Column:
    """Nearness within two minutes and common words."""
    return 0.6 * F.greatest(F.lit(0.0), 1 - F.abs(t1 - t2) / 120) + 0.4 * word_jaccard(text1, text2)


def created_in_turn(candidates: DataFrame, least: float = 0.5, spacing: float = 30.0, most: int = 3, window: float = 300.0, alike: float = 0.8) -> DataFrame:
    """Candidates in order of time that are made highlights, given those made before.

    A candidate needs the least score, its distance from the last one, a place in the
    window or a clearly better score, and must not resemble one of the last ten unless it
    is better. Only those within the window and the last ten are remembered.
    """

    def alike_to(row, other) -> float:
        near = max(0.0, 1 - abs(row["start_time"] - other["start_time"]) / 120)
        a, b = set(row["description"].lower().split()), set(other["description"].lower().split())
        return 0.6 * near + 0.4 * (len(a & b) / len(a | b) if a | b else 0.0)

    def step(state, row):
        made = state or []
        recent = [h for h in made if row["start_time"] - h["start_time"] <= window]
        good = row["score"] >= least and not (made and row["start_time"] - made[-1]["end_time"] < spacing)
        good = good and (len(recent) < most or row["score"] > max(h["score"] for h in recent) + 0.1)
        good = good and all(row["score"] > h["score"] + 0.05 for h in made[-10:] if alike_to(row, h) > alike)
        if not good:
            return made, []
        kept = [h for i, h in enumerate(made) if i >= len(made) - 10 or row["start_time"] - h["start_time"] <= window]
        return [*kept, row], [{"stream_id": row["stream_id"], "id": row["id"]}]

    slim = candidates.select("stream_id", "id", "start_time", "end_time", "score", "description")
    return fold_by(slim, ["stream_id"], ["start_time", "id"], step, "stream_id long, id long")
