"""Scalar functions as column expressions; all of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def normalize(c: Column, low: float = 0.0, high: float = 1.0, method: str = "linear") -> Column:
    """Scores to [0, 1]: clamped line, logistic curve, or tanh."""
    if method == "sigmoid":
        return 1 / (1 + F.exp(-c))
    if method == "tanh":
        return (F.tanh(c) + 1) / 2
    return clamp((c - low) / (high - low)) if high > low else F.lit(0.0)


def weighted(scores: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """Weighted mean over the scores that are present; a missing weight is 0."""
    parts = [(F.coalesce(c, F.lit(0.0)) * weights.get(k, 0.0), F.when(c.isNotNull(), weights.get(k, 0.0)).otherwise(0.0)) for k, c in scores.items()]
    total, weight = sum((p for p, _ in parts), F.lit(0.0)), sum((w for _, w in parts), F.lit(0.0))
    return F.when(weight > 0, total / weight).otherwise(total)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different lengths or without length."""
    return F.when(F.size(a) == F.size(b), F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))).otherwise(0.0)


def euclidean(a: Column, b: Column) -> Column:
    """One less the distance by the root of the dimension, at least 0."""
    gap = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), F.greatest(F.lit(0.0), 1 - F.sqrt(gap) / F.sqrt(F.size(a)))).otherwise(0.0)


def jaccard_positive(a: Column, b: Column) -> Column:
    """Share of the places positive in either vector that are positive in both."""
    both = F.aggregate(F.zip_with(a, b, lambda x, y: ((x > 0) & (y > 0)).cast("int")), F.lit(0), lambda s, x: s + x)
    either = F.aggregate(F.zip_with(a, b, lambda x, y: ((x > 0) | (y > 0)).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.coalesce(F.try_divide(both, either), F.lit(0.0))


def levels(c: Column, steps: Sequence[tuple[float, str]], rest: str, unknown: str | None = None) -> Column:
    """The name of the first bound that the value reaches."""
    out = F.when(c.isNull(), unknown) if unknown else F.when(F.lit(False), None)
    for bound, name in steps:
        out = out.when(c >= bound, name)
    return out.otherwise(rest)


# Fixed bounds and names.
def confidence_level(c: Column) -> Column:
    return levels(c, [(0.9, "very_high"), (0.7, "high"), (0.5, "medium")], "low")


def score_level(c: Column) -> Column:
    return levels(c, [(0.8, "high"), (0.5, "medium"), (0.3, "low")], "very_low")


def engagement_level(c: Column) -> Column:
    return levels(c, [(0.8, "viral"), (0.6, "high"), (0.4, "medium"), (0.2, "low")], "minimal", "unknown")


def sentiment_label(c: Column) -> Column:
    return F.when(c > 0.5, "positive").when(c < -0.5, "negative").otherwise("neutral")


def duration_text(seconds: Column) -> Column:
    """1h 2m 3s, without leading parts of zero."""
    s = F.floor(seconds).cast("long")
    h, m, r = F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60
    return F.when(h > 0, F.concat(h, F.lit("h "), m, F.lit("m "), r, F.lit("s"))).when(m > 0, F.concat(m, F.lit("m "), r, F.lit("s"))).otherwise(F.concat(r, F.lit("s")))


def slug(name: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))


def initials(name: Column) -> Column:
    return F.upper(F.array_join(F.transform(F.filter(F.split(name, " +"), lambda w: w != ""), lambda w: F.substring(w, 1, 1)), ""))


def email_domain(email: Column) -> Column:
    return F.split_part(email, F.lit("@"), F.lit(-1))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1))


def url_platform(url: Column) -> Column:
    """Host names first, anywhere in the text, then the scheme; custom otherwise."""
    low = F.lower(url)
    named = F.when(F.contains(low, F.lit("twitch.tv")), "twitch").when(F.contains(low, F.lit("youtube.com")) | F.contains(low, F.lit("youtu.be")), "youtube")
    return named.when(low.startswith("rtmps://"), "rtmps").when(low.startswith("rtmp://"), "rtmp").otherwise("custom")


def twitch_name(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^https?://(?:www\.|m\.)?twitch\.tv/([A-Za-z0-9_]{4,25})/?$", 1)), F.lit(""))


def youtube_id(url: Column) -> Column:
    """The id of a video; null for channels and handles."""
    return F.nullif(F.regexp_extract(url, r"^https?://(?:(?:www\.|m\.)?youtube\.com/(?:watch\?v=|live/)|youtu\.be/)([A-Za-z0-9_-]{11})", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    name = twitch_name(url)
    return F.when(name.isNotNull(), F.concat(F.lit("https://www.twitch.tv/"), name)).otherwise(url)


def object_key(organization: Column, kind: Column, day: Column, resource: Column, name: Column) -> Column:
    """organization/kind/yyyy/mm/dd/resource/name, the name without folders and spaces."""
    plain = F.replace(F.regexp_extract(name, "([^/]*)$", 1), F.lit(" "), F.lit("_"))
    return F.concat_ws("/", organization, kind, F.date_format(day, "yyyy/MM/dd"), resource, plain)


def bucket_and_key(url: Column) -> Column:
    """Of s3:// addresses, of hosts that begin with the bucket, and of paths that do."""
    host, path = F.regexp_extract(url, "^https?://([^/]+)/", 1), F.regexp_extract(url, "^https?://[^/]+/(.*)$", 1)
    in_host = F.contains(host, F.lit(".s3.")) | F.contains(host, F.lit(".s3-"))
    bucket = F.when(url.startswith("s3://"), F.regexp_extract(url, "^s3://([^/]+)/", 1)).when(in_host, F.split_part(host, F.lit("."), F.lit(1))).otherwise(F.split_part(path, F.lit("/"), F.lit(1)))
    key = F.when(url.startswith("s3://"), F.regexp_extract(url, "^s3://[^/]+/(.*)$", 1)).when(in_host, path).otherwise(F.regexp_extract(path, "^[^/]*/(.*)$", 1))
    return F.struct(bucket.alias("bucket"), key.alias("key"))


def file_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_"), r"^\.+", "")


def quality_name(height: Column) -> Column:
    named = F.when(F.lit(False), None)
    for bound, name in ((2160, "4K"), (1440, "1440p"), (1080, "1080p"), (720, "720p"), (480, "480p"), (360, "360p"), (240, "240p")):
        named = named.when(height >= bound, name)
    return named.otherwise(F.concat(height, F.lit("p")))


def bandwidth_needed(bandwidth: Column, buffer_seconds: float = 10.0) -> Column:
    """A fifth more, and more again for buffers beyond ten seconds."""
    return F.floor((bandwidth + F.floor(bandwidth * 0.2)) * max(1.0, buffer_seconds / 10)).cast("long")


def retry_delay(attempt: Column, base: float = 60.0, factor: float = 2.0, most: float = 3600.0) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(factor), attempt), F.lit(most))


def word_jaccard(a: Column, b: Column) -> Column:
    x, y = (F.array_distinct(F.filter(F.split(F.lower(c), " +"), lambda w: w != "")) for c in (a, b))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


# Fixed weights of the eight dimensions and thresholds of the highlight types.
DIMENSIONS = ("skill_execution", "game_impact", "rarity", "visual_spectacle", "emotional_intensity", "narrative_value", "timing_importance", "momentum_shift")
DIMENSION_WEIGHTS = {
    "default": (0.20, 0.20, 0.15, 0.15, 0.10, 0.10, 0.05, 0.05),
    "skill": (0.35, 0.20, 0.15, 0.15, 0.05, 0.05, 0.03, 0.02),
    "impact": (0.15, 0.35, 0.15, 0.10, 0.10, 0.05, 0.05, 0.05),
    "entertainment": (0.15, 0.15, 0.20, 0.20, 0.15, 0.10, 0.03, 0.02),
}
THRESHOLDS = {
    "default": {"viable": 0.5, "good": 0.7, "exceptional": 0.85, "legendary": 0.95, "skill_play": 0.65, "clutch_moment": 0.75, "comeback": 0.70, "rare_event": 0.80, "perfect_execution": 0.90, "manual": 0.90},
    "strict": {"viable": 0.65, "good": 0.75, "exceptional": 0.88, "legendary": 0.95, "skill_play": 0.70, "clutch_moment": 0.80, "comeback": 0.75, "rare_event": 0.85, "perfect_execution": 0.92, "manual": 0.90},
    "lenient": {"viable": 0.40, "good": 0.60, "exceptional": 0.80, "legendary": 0.92, "skill_play": 0.55, "clutch_moment": 0.65, "comeback": 0.60, "rare_event": 0.75, "perfect_execution": 0.85, "manual": 0.90},
}
GENERAL = ("viable", "good", "exceptional", "legendary")


def dimension_score(dimensions: Mapping[str, Column], preset: str = "default") -> Column:
    return sum((dimensions[d] * w for d, w in zip(DIMENSIONS, DIMENSION_WEIGHTS[preset], strict=True) if d in dimensions), F.lit(0.0))


def quality_level(score: Column, preset: str = "default") -> Column:
    t = THRESHOLDS[preset]
    return levels(score, [(t[n], n) for n in reversed(GENERAL)], "below_threshold")


def meets_threshold(score: Column, kind: Column, preset: str = "default") -> Column:
    """Whether the score reaches the threshold of its type, or the general one."""
    t = THRESHOLDS[preset]
    table = F.create_map(*[F.lit(x) for n, v in t.items() if n not in GENERAL for x in (n, v)])
    return score >= F.coalesce(F.element_at(table, kind), F.lit(t["viable"]))


def keyword_priority(word: Column, high: Sequence[str], medium: Sequence[str], low: Sequence[str]) -> Column:
    w = F.lower(word)
    return F.when(w.isin([x.lower() for x in high]), 1.0).when(w.isin([x.lower() for x in medium]), 0.6).when(w.isin([x.lower() for x in low]), 0.3).otherwise(0.0)


# Fixed permissions.
PERMISSIONS = ("read", "write", "delete", "streams", "batches", "webhooks", "analytics", "admin")


def permissions(scopes: Column) -> Column:
    """The permissions that scopes of the form resource:action grant, in a fixed order; admin grants all."""
    parts = F.flatten(F.transform(F.filter(scopes, lambda x: F.contains(x, F.lit(":"))), lambda x: F.split(x, ":")))
    every = F.array(*[F.lit(p) for p in PERMISSIONS])
    return F.when(F.array_contains(scopes, "admin"), every).otherwise(F.filter(every, lambda p: F.array_contains(parts, p)))


# Fixed transitions of a stream's status.
TRANSITIONS = {"pending": ("processing", "failed", "cancelled"), "processing": ("completed", "failed", "cancelled")}


def may_follow(before: Column, after: Column) -> Column:
    allowed = F.lit(False)
    for status, following in TRANSITIONS.items():
        allowed = allowed | ((before == status) & after.isin(*following))
    return allowed


def confidence_of(scores: Column, method: str = "consistency", threshold: float = 0.5) -> Column:
    """Confidence from an array of scores by entropy, variance, consistency or majority; 0 for none."""
    n = F.size(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
    mean = total / n
    over = lambda f: F.aggregate(F.transform(scores, f), F.lit(0.0), lambda a, x: a + x)
    if method == "majority":
        value = F.size(F.filter(scores, lambda x: x > threshold)) / n
    elif method == "variance":
        value = F.when(n == 1, 1.0).otherwise(1 - F.least(over(lambda x: (x - mean) * (x - mean)) / n, F.lit(1.0)))
    elif method == "entropy":
        part = lambda x: F.when(total > 0, x / total).otherwise(1 / n)
        value = F.when(n == 1, 1.0).otherwise(1 + over(lambda x: part(x) * F.log(part(x) + 1e-10)) / F.log(n))
    else:
        value = F.when(n == 1, 1.0).otherwise(1 - F.least(over(lambda x: F.abs(x - mean)) / n, F.lit(1.0)))
    return F.when(n == 0, 0.0).otherwise(value)


def agent_score(dimensions: Mapping[str, Column], priority: Column, modifier: Column, preset: str = "default") -> Column:
    """Weighted dimensions, a tenth of the best keyword's priority and the context's modifier, within 0 and 1."""
    boosted = F.least(F.lit(1.0), F.least(F.lit(1.0), dimension_score(dimensions, preset)) + 0.1 * priority)
    return clamp(F.least(F.lit(1.0), boosted + modifier))


def instant(text: Column) -> Column:
    """Whole seconds since 1970 of an ISO date and time; a final Z stands for UTC."""
    return F.unix_seconds(F.to_timestamp(F.regexp_replace(text, "Z$", "+00:00")))


def duration_since(later: Column, earlier: Column) -> Column:
    """The difference in seconds; null if it is negative."""
    return F.when(later >= earlier, later - earlier)


def is_stream(url: Column) -> Column:
    """Whether the address has a scheme that streams use."""
    return url.rlike(r"^(?:https?|rtmps?)://[^/\s]+")


def enabled(flags: Mapping[str, Column]) -> Column:
    """The names whose flag is set."""
    return F.array_compact(F.array(*[F.when(flag, F.lit(name)) for name, flag in flags.items()]))


def processing_mode(is_live: Column, address: Column) -> Column:
    watched = F.contains(address, F.lit("youtube.com")) | F.contains(address, F.lit("youtu.be"))
    return F.when(is_live, "live").when(watched, "url").otherwise("file")


def jittered_delay(attempt: Column, spread: Column, jitter: float = 0.1) -> Column:
    """Whole seconds to wait, up to half the jitter more or less by ``spread`` from 0 to 1."""
    delay = retry_delay(attempt)
    return F.floor(delay + delay * jitter * (0.5 - spread)).cast("long")
