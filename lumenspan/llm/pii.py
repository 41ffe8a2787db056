"""Personal data by candidate gradient boosting, in DataFrame functions only.

Base spans of four kinds (email, ip, card, phone) come from fixed patterns with a
check on each match. High-recall generators propose further, overlapping spans for
what those patterns miss: numbers inside a run that failed as a whole, national phone
numbers, spelled-out addresses, and, as a kind of its own beside the four, secrets such
as tokens and keys. Boosted trees score each proposal by its format and
context; a proposal counts if its score reaches its kind's threshold, calibrated on
held-out examples to a stated precision. Base spans always stay; proposals that touch
one are dropped.

The trees are fitted by Spark ML on a fixed table of a few thousand built examples
(``training_examples``; its size is the bound) and then applied as column expressions
row by row, so texts are neither shuffled nor exploded. Every step is linear in the text
and in its spans, but for searches of a few steps: patterns start where a run starts and
repeat without going back, positions and reaches are running sums and maxima over arrays,
and pieces of a text are cut from blocks of it.

Defined results: a null text counts as empty and has no spans; offsets are code
points, the end exclusive; spans are ordered by start, then kind as listed; repeated
rows get equal spans; empty tables give empty results.
"""

from __future__ import annotations

import random
from dataclasses import dataclass
from functools import partial

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Kinds with base patterns, then the kind that only the trees find.
ALL_KINDS = (*KINDS, "secret")

# Possessive repeats and the start conditions (not inside a run, or right after the last
# match) change no match; they keep matching linear and free of recursion.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character that every match of the kind holds; texts without it are not searched.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}

OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$"

#: Proposals by kind.
PROPOSALS = (
    ("phone", r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{4}(?![0-9])"),
    ("phone", r"(?<![0-9+)(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])"),
    ("card", r"(?<![0-9])[0-9]{13,19}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{2,7}(?![0-9])"),
    ("ip", r"(?<![0-9])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9])"),
    # At most nine names before the at mark and eight after the first one behind it.
    ("email", r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]++){0,8}+\x20?(?:\[at\]|\(at\)|\{at\}|\x20at\x20)\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\[dot\]|\(dot\)|\{dot\}|\x20dot\x20)\x20?[A-Za-z]{2,}+){1,8}+"),
    ("phone", r"(?<![0-9+)(.-])0[0-9]{1,4}[\x20/-][0-9]{3,4}[\x20-]?[0-9]{3,4}(?![0-9-])"),
    ("secret", r"(?<=(?i:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key)[\"']?\x20{0,2}[:=]\x20{0,2}[\"']?)[A-Za-z0-9_+/=.~-]{8,}+"),
    ("secret", r"(?<![A-Za-z0-9_-])AKIA[0-9A-Z]{16}(?![A-Za-z0-9_-])"),
    ("secret", r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]{0,40}[0-9])[A-Za-z0-9_-]{20,}+"),
)
PROPOSAL_NEEDS = (r"\+[0-9]", r"[0-9]{3}[\x20.-][0-9]{4}", r"[0-9]{13}", r"[0-9]{4}[\x20-][0-9]{4}", r"[0-9]\.[0-9]", r"[\[({\x20]at[\])}\x20]", r"[0-9][\x20/-][0-9]{3}", r"(?i:token|secret|passw(?:or)?d|pwd|key)[\"']?\x20{0,2}[:=]", "AKIA", r"[0-9][A-Za-z_-]+[0-9]")

# Fixed word lists of the context features.
CUES = {
    "cue_phone": r"(?i)\b(?:phone|tel|telephone|mobile|cell|call|fax|whatsapp|sms)\b",
    "cue_card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|payment|pan)\b",
    "cue_ip": r"(?i)\b(?:ip|ipv4|host|server|address|ping|client)\b",
    "cue_email": r"(?i)\b(?:mail|email|e-mail|contact|write|reach)\b",
    "cue_secret": r"(?i)\b(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|bearer|credentials?)\b",
    "cue_hash": r"(?i)\b(?:commit|sha\d*|md5|hash|checksum|digest|etag|uuid|guid|rev|revision|build)\b",
    "cue_other": r"(?i)\b(?:order|invoice|isbn|version|release|v|id|serial|build|section|part|ref|tracking|sku|figure|chapter)\b",
}
# Fixed beginnings of keys that issuers hand out.
ISSUED = r"^(?:AKIA[0-9A-Z]{16}$|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9]{20,}|xox[abp]-)"
FEATURES = (
    "is_email", "is_ip", "is_card", "is_phone", "is_secret", "n_digits", "n_distinct", "mixed_case", "issued", "n_chars", "n_marks", "luhn", "octets", "plus", "paren", "bracketed",
    "digit_before", "digit_after", "letter_before", "letter_after", "lead_0", *CUES,
)
CONTEXT = 32


def _found(text: Column, pattern: str) -> Column:
    """Array of (s, e, m): start, end and string of all matches, left to right."""
    gaps, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.zip_with(gaps, matches, lambda g, m: F.struct(F.length(g).alias("g"), m.alias("m")))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


#: Elements of an array that are scanned step by step; longer arrays are scanned in such blocks.
SCAN = 64


def _running(values: Column, op, depth: int = 2) -> Column:
    """For each number (long) of an array what ``op`` makes of those before it, from 0 on."""

    def short(array: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("acc"), F.array().cast("array<bigint>").alias("out"))
        step = lambda a, x: F.struct(op(a["acc"], x).alias("acc"), F.concat(a["out"], F.array(a["acc"])).alias("out"))
        return F.aggregate(array, start, step, lambda a: a["out"])

    def in_blocks(array: Column) -> Column:
        upto = F.sequence(F.lit(0), F.floor(F.greatest(F.size(array) - 1, F.lit(0)) / SCAN).cast("int"))
        blocks = F.transform(upto, lambda i: F.slice(array, i * SCAN + 1, F.lit(SCAN)))

        def scanned(blocks_: Column) -> Column:
            totals = F.transform(blocks_, lambda block: F.aggregate(block, F.lit(0).cast("long"), op))
            return F.flatten(F.zip_with(blocks_, _running(totals, op, depth - 1), lambda block, before: F.transform(short(block), lambda v: op(v, before))))

        return _let(blocks, scanned)

    return _let(values, lambda array: F.when(F.size(array) <= SCAN, short(array)).otherwise(in_blocks(array))) if depth else short(values)


def _placed(found: Column) -> Column:
    """Positions of all matches; ``found`` as from _found."""
    before = _running(F.transform(found, lambda x: (x["g"] + F.coalesce(F.length(x["m"]), F.lit(0))).cast("long")), lambda a, b: a + b)
    at = F.zip_with(found, before, lambda x, b: F.struct((b + x["g"]).cast("int").alias("s"), (b + x["g"] + F.length(x["m"])).cast("int").alias("e"), x["m"].alias("m")))
    return F.filter(at, lambda x: x["m"].isNotNull())


def _once(spans: Column) -> Column:
    """Sorted, without repeats."""
    return _let(F.array_sort(spans), lambda a: F.filter(a, lambda x, i: (i == 0) | (x != F.get(a, i - 1))))


def _free(spans: Column, taken: Column) -> Column:
    """The spans (s, k, e, m) that touch none of ``taken`` (s, k, e).

    One walk in order of where a span ends and a taken one starts: a span touches one if
    the furthest end of those that start before its own end lies behind its start.
    """
    ends = F.transform(spans, lambda x: F.struct(x["e"].alias("at"), F.lit(0).alias("side"), x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["m"].alias("m")))
    starts = F.transform(taken, lambda x: F.struct(x["s"].alias("at"), F.lit(1).alias("side"), x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), F.lit(None).cast("string").alias("m")))

    def walked(both: Column) -> Column:
        reach = _running(F.transform(both, lambda x: F.when(x["side"] == 1, x["e"]).otherwise(0).cast("long")), lambda a, b: F.greatest(a, b))
        met = F.zip_with(both, reach, lambda x, r: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["m"].alias("m"), ((x["side"] == 0) & (r <= x["s"])).alias("free")))
        return F.transform(F.filter(met, lambda x: x["free"]), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["m"].alias("m")))

    return _let(F.array_sort(F.concat(ends, starts)), walked)


def _outermost(spans: Column) -> Column:
    """Of spans (s, k, e, p) those that lie in no longer one of their kind: by kind and start, the longer first, none ahead reaches as far."""
    order = F.array_sort(F.transform(spans, lambda c: F.struct(c["k"].alias("k"), c["s"].alias("s"), (-c["e"]).alias("n"))))
    place = lambda c: F.shiftleft(c["k"].cast("long") + 1, 32) - c["n"]

    def kept(a: Column) -> Column:
        reach = _running(F.transform(a, place), lambda x, y: F.greatest(x, y))
        return F.filter(F.zip_with(a, reach, lambda c, r: F.struct(c["s"].alias("s"), c["k"].alias("k"), (-c["n"]).alias("e"), (r < place(c)).alias("kept"))), lambda c: c["kept"])

    return F.transform(_let(order, kept), lambda c: F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e")))


#: Code points of a block; pieces of a text are cut from the blocks that they lie in.
PIECE = 1024


def blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def _cut(blocks_: Column, start: Column, end: Column) -> Column:
    """The text from ``start`` to ``end`` (code points)."""
    first, last = F.floor(start / PIECE).cast("int"), F.floor(F.greatest(end - 1, start) / PIECE).cast("int")
    two = F.concat(F.coalesce(F.get(blocks_, first), F.lit("")), F.coalesce(F.get(blocks_, first + 1), F.lit("")))
    held = F.when(last - first <= 1, two).otherwise(F.array_join(F.slice(blocks_, first + 1, last - first + 1), ""))
    return F.when(end > start, F.substring(held, start - first * PIECE + 1, end - start)).otherwise("")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _valid(kind: str, m: Column) -> Column:
    digits = _digits(m)
    if kind == "ip":
        return m.rlike(OCTETS)
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _passes(kind: str, x: Column) -> Column:
    return _valid(kind, x["m"])


def _marked(number: int, more: tuple[str, ...], x: Column) -> Column:
    return F.struct(x["s"].alias("s"), F.lit(number).alias("k"), x["e"].alias("e"), *[x[name].alias(name) for name in more])


def matches(text: Column, digits: Column) -> Column:
    """For each base pattern, then each proposal pattern, an array of its matches (s, e, m).

    ``digits`` tells whether the text has any; a pattern is searched only where the
    characters that it needs occur.
    """
    none = F.array().cast("array<struct<g:int,m:string>>")
    found = []
    for kind in KINDS:
        some = F.contains(text, F.lit(NEEDS[kind])) if NEEDS[kind] else text.rlike("[0-9][\\x20-]?[0-9]")
        found.append(F.when(some if kind == "email" else digits & some, _found(text, BASE[kind])).otherwise(none))
    for (kind, pattern), needs in zip(PROPOSALS, PROPOSAL_NEEDS, strict=True):
        some = text.rlike(needs) if kind in ("email", "secret") else digits & text.rlike(needs)
        if needs.endswith("[:=]"):
            some = (F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))) & some
        elif needs.startswith("[0-9]"):
            some = digits & some
        found.append(F.when(some, _found(text, pattern)).otherwise(none))
    return F.transform(F.array(*found), lambda f: F.when(F.size(f) > 0, _placed(f)).otherwise(F.array().cast("array<struct<s:int,e:int,m:string>>")))


def base_spans(found: Column) -> Column:
    """Array of (s, k, e), ordered, of the base matches that pass their kind's check; ``found`` as from ``matches``."""
    kept = [F.transform(F.filter(F.get(found, number), partial(_passes, kind)), partial(_marked, number, ())) for number, kind in enumerate(KINDS)]
    return F.array_sort(F.concat(*kept))


def proposals(found: Column) -> Column:
    """Array of proposed spans (s, k, e, m), overlaps included."""
    made = [F.transform(F.get(found, len(KINDS) + i), partial(_marked, ALL_KINDS.index(kind), ("m",))) for i, (kind, _) in enumerate(PROPOSALS)]
    return _once(F.concat(*made))


def features(pieces: Column, c: Column) -> dict[str, Column]:
    """Format and context features of a proposal ``c``, as doubles; ``pieces`` are the text's blocks."""
    digits, m = _digits(c["m"]), c["m"]
    before = _cut(pieces, F.greatest(c["s"] - CONTEXT, F.lit(0)), c["s"])
    last, following = _cut(pieces, F.greatest(c["s"] - 1, F.lit(0)), c["s"]), _cut(pieces, c["e"], c["e"] + 1)
    own = {
        "is_email": c["k"] == 0, "is_ip": c["k"] == 1, "is_card": c["k"] == 2, "is_phone": c["k"] == 3, "is_secret": c["k"] == 4,
        "n_distinct": F.size(F.array_distinct(F.split(m, ""))), "mixed_case": m.rlike("[a-z]") & m.rlike("[A-Z]"), "issued": m.rlike(ISSUED),
        "n_digits": F.length(digits), "n_chars": F.length(m), "n_marks": F.length(F.regexp_replace(m, "[A-Za-z0-9]", "")),
        "luhn": F.call_function("luhn_check", digits), "octets": m.rlike(OCTETS), "plus": m.startswith("+"), "paren": F.contains(m, F.lit("(")), "bracketed": m.rlike(r"[\[({](?:at|dot)[\])}]"),
        "digit_before": last.rlike("[0-9]"), "digit_after": following.rlike("[0-9]"), "letter_before": last.rlike(r"\p{L}"), "letter_after": following.rlike(r"\p{L}"), "lead_0": digits.startswith("0"),
    }
    own |= {name: before.rlike(words) for name, words in CUES.items()}
    return {k: own[k].cast("double") for k in FEATURES}


# ---- training -----------------------------------------------------------------------


def training_examples(rows: int = 2400, seed: int = 11) -> list[tuple[str, str, int]]:
    """Built examples (text, the string that may be private, 1 if it is)."""
    r = random.Random(seed)
    number = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice(("an", "er", "in", "th", "on", "re", "ti", "es", "or", "la", "de", "un")) for _ in range(r.randint(1, 4)))

    def card(n=16):
        body = r.choice("3456") + number(n - 2)
        total = sum(int(d) if i % 2 else (int(d) * 2 - 9 * (int(d) > 4)) for i, d in enumerate(reversed(body)))
        return body + str(-total % 10)

    octet = lambda: str(r.randint(1, 254))
    letters = "abcdefghijklmnopqrstuvwxyz"
    code = lambda n, of=letters + letters.upper() + "0123456789": "".join(r.choice(of) for _ in range(n))
    hexes = lambda n: code(n, "0123456789abcdef")

    def private():
        kind = r.choice(ALL_KINDS)
        if kind == "secret":
            s = r.choice((hexes(40), hexes(32), code(24), code(36), code(r.randint(6, 14)) + number(r.randint(2, 4)) + code(2)))
            if r.random() < 0.3:  # forms that need no word before them
                s = r.choice((f"AKIA{code(15, letters.upper() + '234567')}{code(1, letters.upper())}", f"AKIA{code(16, letters.upper() + '234567')}", f"ghp_{code(36)}", f"sk-{code(32)}"))
                return word(), s
            return r.choice(("token", "api_key", "secret", "password", "access_key", "TOKEN", "Secret")) + r.choice((" = ", "=", ": ", ' = "', ':"')), s
        if kind == "phone":
            a, b, c = number(3), number(3), number(4)
            s = r.choice((f"0{number(2)} {b} {c}", f"0{a}/{number(3)}{number(3)}", f"+1 ({a}) {b}-{c}", f"+1 {a} {b} {c}", f"+44 {number(4)} {number(3)} {number(4)}", f"({a}) {b}-{c}", f"{a}-{b}-{c}"))
            cue = r.choice(("call", "phone", "tel", "mobile", "fax")) if not s.startswith("+") or r.random() < 0.3 else word()
        elif kind == "card":
            s = card(r.choice((16, 16, 16, 15, 19)))
            s = " ".join(s[i : i + 4] for i in range(0, 16, 4)) if len(s) == 16 and r.random() < 0.3 else s
            cue = r.choice(("card", "visa", "payment", word(), word()))
        elif kind == "ip":
            s, cue = ".".join(octet() for _ in range(4)), r.choice(("ip", "host", "server", word()))
        else:
            at, dot = r.choice(((" [at] ", " [dot] "), (" (at) ", " (dot) "), (" at ", " dot "), ("[at]", "[dot]"), (" [at] ", ".")))
            local = r.choice((word(), f"{word()}.{word()}", f"{word()}.{number(2)}", f"{word()}{number(1)}"))
            end = r.choice(("com", "org", "net", "de", "fr", f"example{dot}com", f"mail{dot}org"))
            s, cue = f"{local}{at}{word()}{dot}{end}", r.choice(("email", "contact", word()))
        return cue, s

    def plain():
        pick = r.randrange(12)
        if pick == 8:
            return r.choice(("commit", "sha1", "md5", "checksum", "etag", "digest")) + r.choice((" ", ": ", " = ")), hexes(r.choice((32, 40, 64)))
        if pick == 9:
            return r.choice(("id", "uuid", "guid")), f"{hexes(8)}-{hexes(4)}-{hexes(4)}-{hexes(4)}-{hexes(12)}"
        if pick == 10:
            return r.choice(("token", "password", "secret")) + r.choice((": ", " = ")), r.choice((word() + word() + word() + word(), "required", "undefined", "process.env.NAME"))
        if pick == 11:
            return word(), "-".join(word() for _ in range(r.randint(4, 6))) + "-" + number(r.randint(1, 4))
        if pick == 0:
            return r.choice(("order", "invoice", "serial", "tracking", word())), number(r.choice((13, 14, 16, 17, 19)))
        if pick == 1:
            return r.choice(("version", "release", "section", "build")), ".".join(str(r.randint(0, 20)) for _ in range(4))
        if pick == 2:
            return word(), ".".join(str(r.randint(256, 999)) for _ in range(4))
        if pick == 3:
            return word(), f"{word()} at {word()}.{word()}"
        if pick == 4:
            return r.choice(("order", "ref", "part", "sku", word())), f"{number(3)}-{number(3)}-{number(4)}"
        if pick == 5:
            return r.choice(("isbn", "id")), f"978{number(10)}"
        if pick == 6:
            return word(), f"{number(4)} {number(4)} {number(4)} {number(4)}"
        return word(), f"{number(3)} {number(3)} {number(4)}"

    out = []
    for _ in range(rows):
        label = int(r.random() < 0.5)
        cue, s = private() if label else plain()
        filler = lambda n: " ".join(word() for _ in range(n))
        beside = number(r.randint(2, 3)) + "." + number(2) if r.random() < 0.15 else filler(1)
        between = "" if cue[-1] in "=\": " else " "
        out.append((f"{filler(5)}. {cue}{between}{s} {beside} {filler(4)}", s, label))
    return out


@dataclass(frozen=True)
class Scorer:
    """Boosted trees as nested tuples, and a threshold for each kind."""

    trees: tuple
    weights: tuple[float, ...]
    thresholds: tuple[float, ...]

    def margin(self, values: dict[str, Column]) -> Column:
        def walk(node):
            if len(node) == 1:
                return F.lit(node[0])
            name, cut, low, high = node
            return F.when(values[name] <= F.lit(cut), walk(low)).otherwise(walk(high))

        total = F.lit(0.0)
        for tree, weight in zip(self.trees, self.weights, strict=True):
            total = total + walk(tree) * F.lit(weight)
        return total


def _tree(node) -> tuple:
    if node.subtreeDepth() == 0:
        return (node.prediction(),)
    split = node.split()
    return (FEATURES[split.featureIndex()], split.threshold(), _tree(node.leftChild()), _tree(node.rightChild()))


_FITTED: dict[tuple, Scorer] = {}


def fit_scorer(spark: SparkSession, rows: int = 2400, precision: float = 0.98, trees: int = 12, depth: int = 3, seed: int = 11) -> Scorer:
    """Fit the trees on half of the built examples and calibrate thresholds on the other half.

    A kind's threshold is the smallest margin at which the held-out proposals that reach
    it are right at the stated precision; without such a margin the kind adds nothing.
    """
    key = (rows, precision, trees, depth, seed)
    if key in _FITTED:
        return _FITTED[key]
    numbered = [(i, *x) for i, x in enumerate(training_examples(rows, seed))]
    examples = spark.createDataFrame(numbered, "row long, text string, secret string, label int")
    found = examples.coalesce(1).withColumn("found", matches(F.col("text"), F.col("text").rlike("[0-9]")))
    spread = found.select("*", F.explode(proposals(F.col("found"))).alias("c"))
    values = features(blocks(F.col("text")), F.col("c"))
    # A proposal is private if its example is, and it lies within the private string.
    truth = (F.col("label") == 1) & F.contains(F.col("secret"), F.col("c.m"))
    table = spread.select("row", F.col("c.k").alias("kind"), truth.cast("double").alias("truth"), *[v.alias(k) for k, v in values.items()])
    table = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(table).cache()
    model: GBTClassificationModel = GBTClassifier(labelCol="truth", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=seed, maxBins=64).fit(table.where("row % 2 = 0"))
    scorer = Scorer(tuple(_tree(t._java_obj.rootNode()) for t in model.trees), tuple(model.treeWeights), ())
    held = table.where("row % 2 = 1").select("kind", "truth", scorer.margin({k: F.col(k) for k in FEATURES}).alias("margin")).collect()
    table.unpersist()
    thresholds = []
    for number in range(len(ALL_KINDS)):
        mine = sorted(((x["margin"], x["truth"]) for x in held if x["kind"] == number), reverse=True)
        best, right = float("inf"), 0.0
        for i, (margin, truth_) in enumerate(mine, 1):
            right += truth_
            if right >= precision * i and (i == len(mine) or mine[i][0] < margin):
                best = margin
        thresholds.append(best)
    _FITTED[key] = Scorer(scorer.trees, scorer.weights, tuple(thresholds))
    return _FITTED[key]


# ---- use ----------------------------------------------------------------------------


def with_spans(docs: DataFrame, scorer: Scorer | None = None) -> DataFrame:
    """``docs`` with ``base_`` and ``spans_``: ordered arrays of (s, k, e), k being the kind's number."""
    scorer = scorer or fit_scorer(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    cuts = F.array(*[F.lit(float(t)) for t in scorer.thresholds])
    step = docs.withColumn("digits_", text.rlike("[0-9]"))
    step = step.withColumn("found_", matches(text, F.col("digits_")))
    step = step.withColumn("base_", base_spans(F.col("found_"))).withColumn("proposed_", proposals(F.col("found_")))
    # Proposals that touch a base span go before any scoring.
    step = step.withColumn("fresh_", F.when((F.size("base_") > 0) & (F.size("proposed_") > 0), _free(F.col("proposed_"), F.col("base_"))).otherwise(F.col("proposed_")))
    step = step.withColumn("blocks_", F.when(F.size("fresh_") > 0, blocks(text)))
    # Features once a proposal, then the trees over them.
    told = F.transform("fresh_", lambda c: F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"), *[v.alias(n) for n, v in features(F.col("blocks_"), c).items()]))
    step = step.withColumn("told_", F.when(F.size("fresh_") > 0, told))
    scored = F.transform("told_", lambda c: F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"), scorer.margin({n: c[n] for n in FEATURES}).alias("p")))
    step = step.withColumn("scored_", scored)
    step = step.withColumn("chosen_", F.coalesce(F.filter("scored_", lambda c: c["p"] >= F.get(cuts, c["k"])), F.array().cast("array<struct<s:int,k:int,e:int,p:double>>")))
    # Of chosen proposals of one kind, those inside a longer one add nothing.
    step = step.withColumn("kept_", F.when(F.size("chosen_") > 0, _outermost(F.col("chosen_"))).otherwise(F.array().cast("array<struct<s:int,k:int,e:int>>")))
    step = step.withColumn("spans_", F.when(F.size("kept_") > 0, _once(F.concat("base_", "kept_"))).otherwise(F.col("base_")))
    return step.drop("digits_", "found_", "proposed_", "fresh_", "blocks_", "told_", "scored_", "chosen_", "kept_")


def written(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    names = F.array(*[F.lit(k) for k in ALL_KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat(F.get(names, x["k"]), F.lit(":"), x["s"], F.lit(":"), x["e"])), ",")


def redact(docs: DataFrame, scorer: Scorer | None = None) -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in brackets; spans that overlap become one."""
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in ALL_KINDS])
    inner = docs.select(F.struct(*docs.columns).alias("row_"), "text")
    found = with_spans(inner, scorer)

    # A span opens a mark if it starts at or behind the furthest end ahead of it.
    found = found.withColumn("ahead_", F.when(F.size("spans_") > 0, _running(F.transform("spans_", lambda x: x["e"].cast("long")), lambda a, b: F.greatest(a, b))))
    opened = F.filter(F.zip_with("spans_", "ahead_", lambda x, r: F.struct(x["s"].alias("s"), x["k"].alias("k"), r.alias("after"))), lambda x: x["s"] >= x["after"])
    found = found.withColumn("opened_", opened).withColumn("pieces_", F.when(F.size("spans_") > 0, blocks(F.col("text"))))
    marked = F.transform("opened_", lambda x: F.concat(_cut(F.col("pieces_"), x["after"].cast("int"), x["s"]), F.get(marks, x["k"])))
    end = F.array_max(F.transform("spans_", lambda x: x["e"]))
    clean = F.when(F.size("spans_") > 0, F.concat(F.array_join(marked, ""), _cut(F.col("pieces_"), end, F.length("text")))).otherwise(F.col("text"))
    return found.withColumn("clean_", clean).select(*[F.col("clean_").alias(c) if c == "text" else F.col(f"row_.`{c}`").alias(c) for c in docs.columns])
