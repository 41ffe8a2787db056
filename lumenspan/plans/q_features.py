"""Queries of linkage clusters and of features of sound and colour frames, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenspan.operators import linkage as L
from lumenspan.operators import pixels as P
from lumenspan.operators import spectrum as A
from lumenspan.plans.prelude import with_tables
from lumenspan.plans.q_temporal import candidates, rounded
from lumenspan.sources import tables as T

QUERIES, SQL = {}, {}
RATE, FRAME, HOP = 16000.0, 32, 8


def query(name: str, sql: str | None):
    """Register a query under ``name`` together with its SQL."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = with_tables(sql)
        return f

    return add


@query("g03_ward_clusters", None)
def _(s, d):
    return L.ward_clusters(candidates(s, d), ["score", "confidence"])


def clips(s, d):
    """Vectors as clips of 64 samples."""
    return T.read(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("samples"))


def _sum(body: str, n: int) -> str:
    return f"list_sum(list_transform(range(0, {n}), lambda t: {body}))"


#: The magnitudes by sums of cosines and sines; f holds the samples of a frame.
_MAGNITUDES = lambda n: f"list_transform(range(0, {n // 2}), lambda k: sqrt(pow({_sum(f'f[t + 1] * cos(2 * pi() * k * t / {n})', n)}, 2) + pow({_sum(f'f[t + 1] * sin(2 * pi() * k * t / {n})', n)}, 2)))"
_FRAMES = f"""clip AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings), parts AS (SELECT vec_id, i, x[i + 1:i + {FRAME}] AS f FROM clip, (VALUES (0), (8), (16), (24)) p(i)),
  mags AS MATERIALIZED (SELECT *, {_MAGNITUDES(FRAME)} AS m FROM parts), centred AS (SELECT *, {_sum(f'm[t + 1] * t * 500.0::DOUBLE', FRAME // 2)} / list_sum(m) AS centroid, list_position(list_transform(range(1, {FRAME // 2 + 1}), lambda k: list_sum(m[1:k]) >= 0.85::DOUBLE * list_sum(m)), TRUE) AS roll,
    list_sum(list_transform(range(1, {FRAME}), lambda t: abs(sign(f[t + 1]) - sign(f[t])))) / {2 * FRAME}.0::DOUBLE AS crossings FROM mags),
  wide AS (SELECT *, sqrt({_sum('m[t + 1] * pow(t * 500.0::DOUBLE - centroid, 2)', FRAME // 2)} / list_sum(m)) AS bandwidth FROM centred)"""


@query("h27_spectral_features", f"WITH {_FRAMES} SELECT vec_id, COUNT(*) AS n, ROUND(AVG(centroid), 6) AS centroid, ROUND(AVG((roll - 1) * 500.0::DOUBLE), 6) AS rolloff, ROUND(AVG(bandwidth), 6) AS bandwidth, ROUND(AVG(crossings), 9) AS crossings FROM wide GROUP BY vec_id")
def _(s, d):
    found = A.spectra(clips(s, d), ["vec_id"], "samples", RATE, FRAME, HOP)
    mean = lambda c: (F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c)).alias(c)
    found = found.select("vec_id", F.size("centroid").cast("long").alias("n"), *(mean(c) for c in A.FRAMED))
    return rounded(rounded(found, "centroid", "rolloff", "bandwidth"), "crossings", digits=9)


@query("h32_spectral_excitement", f"WITH {_FRAMES}, r AS (SELECT vec_id, AVG(CASE WHEN centroid > 4000 THEN 1 ELSE 0 END) AS high, var_pop(bandwidth) AS bv, AVG(crossings) AS zc FROM wide GROUP BY vec_id) SELECT vec_id, ROUND(high, 6) AS high_freq_energy, ROUND(bv, 3) AS bandwidth_var, ROUND(zc, 6) AS crossing_mean, ROUND((high + 1 / (1 + exp(-bv / 10000)) + 1 / (1 + exp(-zc * 100))) / 3, 6) AS spectral_score FROM r")
def _(s, d):
    found = A.spectral_excitement(A.spectra(clips(s, d), ["vec_id"], "samples", RATE, FRAME, HOP), 4000.0)
    found = found.select("vec_id", "high_freq_energy", F.round("bandwidth_var", 3).alias("bandwidth_var"), "crossing_mean", "spectral_score")
    return rounded(found, "high_freq_energy", "crossing_mean", "spectral_score")


@query("h41_clip_features", f"""WITH clip AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS f FROM embeddings), mags AS MATERIALIZED (SELECT *, {_MAGNITUDES(64)} AS m FROM clip)
  SELECT vec_id, ROUND(list_avg(f), 6) AS mean, ROUND(list_stddev_pop(f), 6) AS deviation, ROUND(list_max(list_transform(f, lambda x: abs(x))), 6) AS peak, CAST(len(f) AS DOUBLE) AS samples, ROUND(list_avg(m), 6) AS spectral_mean, ROUND(list_stddev_pop(m), 6) AS spectral_deviation, ROUND(list_sum(m), 6) AS spectral_sum,
    (list_position(list_transform(range(1, 33), lambda k: list_sum(m[1:k]) >= 0.85::DOUBLE * list_sum(m)), TRUE) - 1) / 32.0::DOUBLE AS rolloff_share FROM mags""")
def _(s, d):
    found = A.clip_vectors(clips(s, d), ["vec_id"], "samples").where("features IS NOT NULL")
    found = found.select("vec_id", *(F.col("features")[k].alias(name) for k, name in enumerate(A.CLIP)))
    return rounded(found, *A.CLIP[:3], *A.CLIP[4:7])


def colour_frames(s, d):
    """Vectors as frames of 64 colour pixels, ten to a segment."""
    value = F.col("embedding").cast("array<double>")
    shades = lambda x: F.array(F.least(F.lit(255.0), F.abs(x) * 600), F.least(F.lit(255.0), F.abs(x) * 300), F.least(F.lit(255.0), F.pow(x, F.lit(2)) * 2000))
    return T.read(s, d, "embeddings").select((F.col("vec_id") % 10).alias("stream_id"), F.floor(F.col("vec_id") / 100).cast("long").alias("segment"), F.col("vec_id").alias("frame_id"), F.flatten(F.transform(value, shades)).alias("pixels"))


_BIN = "LEAST(15, floor({v} / (255 / 16::DOUBLE)))"
_SHADES = ("LEAST(255, abs(x::DOUBLE) * 600)", "LEAST(255, abs(x::DOUBLE) * 300)", "LEAST(255, pow(x::DOUBLE, 2) * 2000)")
_COUNTS = " || ".join(f"list_transform(range(0, 16), lambda b: list_sum(list_transform(h{c}, lambda v: ({_BIN.format(v='v')} = b)::INT)) / len(h{c})::DOUBLE)" for c in range(3))


@query("w18_video_features", f"""WITH f AS (SELECT vec_id % 10 AS stream_id, vec_id // 100 AS segment, vec_id AS frame_id, {', '.join(f'list_transform(embedding, lambda x: {v}) AS p{c}' for c, v in enumerate(_SHADES))} FROM embeddings),
  g AS (SELECT *, p0 || p1 || p2 AS p, LAG(p0 || p1 || p2) OVER (PARTITION BY stream_id, segment ORDER BY frame_id) AS q FROM f),
  s AS (SELECT stream_id, segment, flatten(list(p)) AS px, COALESCE(SUM(list_sum(list_transform(range(1, 193), lambda i: abs(p[i] - q[i])))) / NULLIF(COUNT(q) * 192, 0), 0) AS motion, flatten(list(p0)) AS h0, flatten(list(p1)) AS h1, flatten(list(p2)) AS h2 FROM g GROUP BY stream_id, segment),
  v AS (SELECT stream_id, segment, [list_avg(px), list_stddev_pop(px), list_max(px) - list_min(px), motion] || {_COUNTS} AS v FROM s)
  SELECT stream_id, segment, CAST(len(v) AS INTEGER) AS size, list_transform(v, lambda x: round(x, 8)) AS features FROM v""")
def _(s, d):
    found = P.video_features(colour_frames(s, d), ["stream_id", "segment"], ["frame_id"])
    return found.select("stream_id", "segment", F.size("features").alias("size"), F.transform("features", lambda x: F.round(x, 8)).alias("features"))
