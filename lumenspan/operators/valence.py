"""Sentiment of messages by the valence of their words and the words before them.

Words have a valence in a table (word, valence); ``learned_lexicon`` derives one from
labelled texts. A word in capitals among others counts more, intensifying and weakening
words up to three places ahead change it, a negation there turns it round, and after a
"but" the rest counts more than what was ahead. Exclamation and question marks add to the
sum, which is brought into -1 to 1.

Words are rows joined with the table, so a text of any length and a word of any frequency
are spread; their surroundings come from the array of words before it is taken apart.

Defined results: null and empty texts, and those without a known word, have compound 0 and
the label neutral; marks around a word don't count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the published rules: intensity, capitals, negation, marks, and the constant of the norm.
INTENSITY, CAPITALS, NEGATION, SHOUT, ASK, ASK_MOST, NORM = 0.293, 0.733, -0.74, 0.292, 0.18, 0.96, 15.0
FADING = (1.0, 0.95, 0.9)
STRONGER = ("very", "really", "so", "extremely", "totally", "absolutely", "completely", "most", "more", "too")
WEAKER = ("barely", "hardly", "scarcely", "slightly", "somewhat", "kinda", "sorta", "less", "little", "partly")
NEGATIONS = ("not", "no", "never", "none", "nobody", "nothing", "neither", "nor", "nowhere", "without", "cannot", "isn't", "wasn't", "don't", "doesn't", "didn't", "can't", "won't", "ain't")
LABEL_FROM = 0.05
#: Rows up to which a lexicon is sent to all tasks; larger ones are joined by word.
SENT_ROWS = 200_000

WORD = r"[^\x20\x09-\x0D]+"
_EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"


def bare_words(text: Column) -> Column:
    """The words of a text without marks around them, as written; what is only marks is left out."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)), lambda w: F.regexp_replace(w, _EDGES, ""))
    return F.filter(found, lambda w: w != "")


def learned_lexicon(docs: DataFrame, labels: DataFrame, fewest: int = 5) -> DataFrame:
    """Rows (word, valence): twice the log ratio of good to bad documents with the word, between -4 and 4, without those near 0."""
    known = docs.join(labels.where("quality IS NOT NULL").select("doc_id", "quality"), "doc_id")
    words = known.select("quality", F.explode(F.array_distinct(F.transform(bare_words(F.col("text")), lambda w: F.lower(w)))).alias("word"))
    counts = words.groupBy("word").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad")).where(F.col("good") + F.col("bad") >= fewest)
    total = known.agg(F.count_if(F.col("quality") == 1).alias("g"), F.count_if(F.col("quality") == 0).alias("b"))
    rate = F.log(((F.col("good") + 1) / (F.col("g") + 2)) / ((F.col("bad") + 1) / (F.col("b") + 2)))
    valence = F.round(F.greatest(F.lit(-4.0), F.least(F.lit(4.0), 2 * rate)), 3)
    return counts.crossJoin(F.broadcast(total)).select("word", valence.alias("valence")).where("abs(valence) >= 0.5")


def _is(word: Column, words: tuple[str, ...]) -> Column:
    return F.coalesce(word.isin(*words), F.lit(False))


def valence_scores(messages: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """Rows (key, positive, negative, neutral, compound): shares of the words, and the sum brought into -1 to 1."""
    words = messages.select(key, F.col(text).alias("text_"), bare_words(F.col(text)).alias("written_"))
    capital = lambda w: w.rlike(r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$") & (F.length(w) > 1)
    words = words.withColumn("lower_", F.transform("written_", lambda w: F.lower(w))).withColumn("n_", F.size("written_")).withColumn("capitals_", F.size(F.filter("written_", capital)))
    words = words.withColumn("but_", F.array_position("lower_", "but") - 1)
    shout = F.least(F.length(F.regexp_replace(F.coalesce("text_", F.lit("")), "[^!]", "")), F.lit(4)) * SHOUT
    asked = F.length(F.regexp_replace(F.coalesce("text_", F.lit("")), "[^?]", ""))
    words = words.withColumn("marks_", shout + F.when(asked > 3, ASK_MOST).when(asked > 1, asked * ASK).otherwise(0.0))

    def placed(word: Column, i: Column) -> Column:
        ahead = [F.when(i >= d, F.get("lower_", i - d)) for d in (1, 2, 3)]
        push = sum((F.when(_is(w, STRONGER), INTENSITY * fade).when(_is(w, WEAKER), -INTENSITY * fade).otherwise(0.0) for w, fade in zip(ahead, FADING, strict=True)), F.lit(0.0))
        turned = _is(ahead[0], NEGATIONS) | _is(ahead[1], NEGATIONS) | _is(ahead[2], NEGATIONS)
        loud = capital(word) & (F.col("capitals_") < F.col("n_"))
        weight = F.when(F.col("but_") < 0, 1.0).when(i < F.col("but_"), 0.5).when(i > F.col("but_"), 1.5).otherwise(1.0)
        return F.struct(F.lower(word).alias("word"), push.alias("push"), turned.alias("turned"), loud.alias("loud"), weight.alias("weight"))

    told = words.select(key, F.explode(F.transform("written_", placed)).alias("w")).select(key, "w.*")
    few = lexicon.limit(SENT_ROWS + 1).count() <= SENT_ROWS
    met = told.join(F.broadcast(lexicon) if few else lexicon, "word")
    sign = F.signum("valence")
    value = F.col("valence") + F.when(F.col("loud"), sign * CAPITALS).otherwise(0.0) + sign * F.col("push")
    value = F.when(F.col("turned"), value * NEGATION).otherwise(value) * F.col("weight")
    sums = met.withColumn("v", value).groupBy(key).agg(F.sum("v").alias("sum_"), F.sum(F.when(F.col("v") > 0, F.col("v") + 1).otherwise(0.0)).alias("pos_"), F.sum(F.when(F.col("v") < 0, 1 - F.col("v")).otherwise(0.0)).alias("neg_"), F.count("*").alias("hits_"))
    full = words.select(key, "n_", "marks_").join(sums, key, "left").fillna(0.0, ["sum_", "pos_", "neg_"]).fillna(0, ["hits_"])
    total = F.col("sum_") + F.signum("sum_") * F.col("marks_")
    pos = F.col("pos_") + F.when(F.col("pos_") > F.col("neg_"), F.col("marks_")).otherwise(0.0)
    neg = F.col("neg_") + F.when(F.col("neg_") > F.col("pos_"), F.col("marks_")).otherwise(0.0)
    full = full.select(key, total.alias("total_"), pos.alias("pos_"), neg.alias("neg_"), (F.col("n_") - F.col("hits_")).alias("rest_"))
    whole = F.col("pos_") + F.col("neg_") + F.col("rest_")
    share = lambda c: F.coalesce(F.try_divide(F.col(c), whole), F.lit(0.0))
    return full.select(key, share("pos_").alias("positive"), share("neg_").alias("negative"), F.when(whole > 0, share("rest_")).otherwise(1.0).alias("neutral"), (F.col("total_") / F.sqrt(F.pow("total_", F.lit(2)) + NORM)).alias("compound"))


def blended(scores: DataFrame, polarity: Column) -> DataFrame:
    """Scores in the mean with a second polarity (-1 to 1), with label and confidence."""
    mixed = scores.withColumn("positive", (F.col("positive") + F.greatest(F.lit(0.0), polarity)) / 2).withColumn("negative", (F.col("negative") + F.greatest(F.lit(0.0), -polarity)) / 2).withColumn("compound", (F.col("compound") + polarity) / 2)
    c = F.col("compound")
    label = F.when(c >= LABEL_FROM, "positive").when(c <= -LABEL_FROM, "negative").otherwise("neutral")
    return mixed.withColumn("label", label).withColumn("confidence", F.when(F.col("label") == "neutral", 1 - F.abs(c)).otherwise(F.abs(c)))
