"""Fill-in-the-middle training texts by lookaround splitting.

A unit grammar names the neighbouring classes between which a text may be cut. It is
translated to a regular expression without width, a lookbehind for the class on the left
and a lookahead for the one on the right, and Spark's ``split`` cuts there: no character
is consumed, so the pieces joined give the text again. Two cuts between pieces are drawn
from a hash of the document's id; prefix, middle and suffix are the pieces joined.

All is column expressions: a row is changed where it lies, and nothing is shuffled. Memory
is the pieces of the texts in work, one row a task.

Defined results: a null text counts as empty; an empty text has no units (``split`` would
give one empty piece) and stays plain; a text that holds a mark already stays plain, as its
parts could not be told apart; a null id hashes as an empty string; repeated ids draw the
same numbers, so repeated rows give equal results; other columns are passed through, and
those named like a result are replaced; an empty table gives an empty one. Classes of a
grammar are ASCII characters or their complement, so that characters of two UTF-16 units
are never cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ANY = r"(?s:.)"
SPACE, NO_SPACE = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
_RUNS = ("[A-Za-z]", "[0-9]", SPACE)
_OTHER = r"[^A-Za-z0-9\x20\x09-\x0D]"

#: For each unit the classes left and right of a cut.
GRAMMARS: dict[str, tuple[tuple[str, str], ...]] = {
    "code_point": ((ANY, ANY),),
    "word": ((SPACE, NO_SPACE),),
    "line": ((r"\n", ANY),),
    "sentence": ((r"[.!?]", SPACE),),
    "run": (*((c, c.replace("[", "[^")) for c in _RUNS), (_OTHER, ANY)),
}


def boundary(unit: str) -> str:
    """The regular expression that matches, without width, where units of a grammar meet."""
    return "|".join(f"(?<={left})(?={right})" for left, right in GRAMMARS[unit])


def units(text: Column, unit: str = "code_point") -> Column:
    """The units of a text in order; none if it is empty."""
    return F.when(F.length(text) > 0, F.split(text, boundary(unit), -1)).otherwise(F.array().cast("array<string>"))


def draws(doc_id: Column, seed: int = 1) -> list[Column]:
    """Four numbers of 32 bits from the hash of a seed and an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _joined(pieces: str, start: Column, n: Column) -> Column:
    return F.array_join(F.slice(pieces, start + 1, n), "")


def fill_in_middle(docs: DataFrame, unit: str = "code_point", fim_percent: int = 90, spm_percent: int = 20, seed: int = 1) -> DataFrame:
    """Add n_units, form (plain, psm, spm), prefix_units, middle_units, prefix, middle and output.

    The middle four are null for plain texts. fim_percent of the documents are rearranged,
    and of these spm_percent with the suffix ahead.
    """
    own = ("n_units", "form", "prefix_units", "middle_units", "prefix", "middle", "output")
    text = F.coalesce(F.col("text"), F.lit(""))
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    plain = (F.length(text) == 0) | marked | (h3 % 100 >= fim_percent)
    row = F.struct(*docs.columns).alias("row")
    cut = docs.select(row, text.alias("text"), units(text, unit).alias("pieces"), h1.alias("h1"), h2.alias("h2"), F.when(plain, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm").alias("form"))
    cut = cut.select("row", "text", "pieces", "form", F.size("pieces").alias("n"), "h1", "h2")
    a, b = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    cut = cut.select("row", "text", "pieces", "form", "n", F.least(a, b).cast("int").alias("start"), F.greatest(a, b).cast("int").alias("end"))
    moved = F.col("form") != "plain"
    parts = {"prefix": (F.lit(0), F.col("start")), "middle": (F.col("start"), F.col("end") - F.col("start")), "suffix": (F.col("end"), F.col("n") - F.col("end"))}
    cut = cut.select("row", "text", "form", "n", "start", "end", *(F.when(moved, _joined("pieces", *where)).alias(name) for name, where in parts.items()))
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    return cut.select(
        *(F.col("row")[c].alias(c) for c in docs.columns if c not in own),
        F.col("n").cast("long").alias("n_units"),
        "form",
        F.when(moved, F.col("start")).cast("long").alias("prefix_units"),
        F.when(moved, F.col("end") - F.col("start")).cast("long").alias("middle_units"),
        "prefix",
        "middle",
        F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text")).alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
