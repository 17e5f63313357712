"""Text functions as Column expressions: splitting, Hangul, normalising, previews."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ends a sentence when white space follows.
SENTENCE_END = r"(?U)(?<=[.!?。])\s+"
PUNCTUATION = "[.,!?;:()\\[\\]{}\"'`~、。“”‘’\\-]+"
#: Digits whose Korean reading ends in a consonant: 0, 1, 3, 6, 7, 8.
CLOSED_DIGITS = "013678"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space (of any script) at both ends."""
    return F.regexp_replace(_col(c), r"(?U)\A\s+|\s+\z", "")


def normalize(c: Column | str) -> Column:
    """Line feeds only, no no-break or zero-width spaces, no blanks at line ends, at most one empty line, stripped."""
    t = F.replace(F.replace(_col(c), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    t = F.replace(F.replace(t, F.lit(" "), F.lit(" ")), F.lit("​"), F.lit(""))
    t = F.regexp_replace(t, r"[ \t]+\n", "\n")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def sentences(c: Column | str) -> Column:
    """Sentences of a text: cut after end marks with white space behind, and at line feeds."""
    parts = F.flatten(F.transform(F.split(strip(c), SENTENCE_END), lambda x: F.split(x, "\n")))
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def eojeols(c: Column | str) -> Column:
    """Tokens between white space."""
    return F.filter(F.split(_col(c), r"(?U)\s+"), lambda x: x != "")


def last_eojeol(c: Column | str) -> Column:
    """The last token without punctuation; null if there is none."""
    return F.regexp_replace(F.try_element_at(eojeols(c), F.lit(-1)), PUNCTUATION, "")


def ending(c: Column | str) -> Column:
    """The last one to three syllables before an end mark; null if there are none."""
    return F.nullif(F.regexp_extract(_col(c), r"(?U)([가-힣]{1,3})\s*[.!?。]?\s*$", 1), F.lit(""))


def _last(c: Column) -> Column:
    return F.ascii(F.right(c, F.lit(1)))


def _is_syllable(c: Column) -> Column:
    return _last(c).between(0xAC00, 0xD7A3)


def has_final(c: Column | str) -> Column:
    """Whether a word ends in a consonant: by the last syllable, or the reading of a last digit; false otherwise."""
    c = _col(c)
    by_syllable = (_last(c) - 0xAC00) % 28 != 0
    return F.when(_is_syllable(c), by_syllable).otherwise(F.coalesce((c != "") & F.instr(F.lit(CLOSED_DIGITS), F.right(c, F.lit(1))).cast("boolean"), F.lit(False)))


def particle(c: Column | str, closed: str, opened: str) -> Column:
    return F.when(has_final(c), F.lit(closed)).otherwise(F.lit(opened))


def subject_particle(c: Column | str) -> Column:
    return particle(c, "이", "가")


def object_particle(c: Column | str) -> Column:
    return particle(c, "을", "를")


def topic_particle(c: Column | str) -> Column:
    return particle(c, "은", "는")


def instrumental_particle(c: Column | str) -> Column:
    """로 after a vowel, the consonant ㄹ or another script, else 으로."""
    c = _col(c)
    return F.when(_is_syllable(c) & ~((_last(c) - 0xAC00) % 28).isin(0, 8), F.lit("으로")).otherwise(F.lit("로"))


def n_chars(c: Column | str) -> Column:
    return F.length(strip(c))


def preview(c: Column | str, limit: int = 90) -> Column:
    """White space as single spaces, cut with an ellipsis."""
    flat = strip(F.regexp_replace(_col(c), r"(?U)\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("…"))).otherwise(flat)


def truncate(c: Column | str, limit: int = 6000) -> Column:
    """Whole paragraphs until the limit; the first one always stays."""
    t = _col(c)
    start = F.struct(F.lit(0).alias("total"), F.lit(False).alias("stop"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, p: Column) -> Column:
        stop = acc["stop"] | ((acc["total"] + F.length(p) > limit) & (F.size(acc["kept"]) > 0))
        return F.struct(F.when(stop, acc["total"]).otherwise(acc["total"] + F.length(p) + 2).alias("total"), stop.alias("stop"), F.when(stop, acc["kept"]).otherwise(F.array_append(acc["kept"], p)).alias("kept"))

    return F.when(F.length(t) <= limit, t).otherwise(F.array_join(F.aggregate(F.split(t, "\n\n"), start, step)["kept"], "\n\n"))


def document_id(c: Column | str) -> Column:
    """The first twelve hexadecimal digits of the text's SHA-1."""
    return F.substring(F.sha1(_col(c).cast("binary")), 1, 12)
