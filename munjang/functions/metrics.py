"""Punctuation and rhythm metrics over a column of sentences that is split once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from munjang.functions import registry as R
from munjang.functions.text import ending, eojeols, last_eojeol, strip

# Connective and declarative endings.
CONNECTIVES = "고|며|지만|면서|아서|어서"
DECLARATIVE = "(한다|된다|이다|난다|진다)$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def comma_inclusion_rate(s: Column | str) -> Column:
    """Share of sentences with a comma."""
    return _share(F.size(F.filter(s, lambda x: F.contains(x, F.lit(",")))), F.size(s))


def comma_usage_rate(s: Column | str) -> Column:
    """Commas for each sentence."""
    return _share(_sum(F.transform(s, lambda x: (F.length(x) - F.length(F.replace(x, F.lit(","), F.lit("")))).cast("long"))), F.size(s))


def ending_comma_rate(text: Column | str) -> Column:
    """Share of connectives at a word's end that a comma follows."""
    t = _col(text)
    total = F.regexp_count(t, F.lit(rf"(?U)(?:{CONNECTIVES})(?=[\s,.!?、。]|$)"))
    return _share(F.regexp_count(t, F.lit(rf"(?U)(?:{CONNECTIVES})\s*,")), total)


def comma_segment_length(s: Column | str) -> Column:
    """Mean number of tokens between commas; blank segments of a sentence with commas are left out."""
    segments = F.flatten(F.transform(s, lambda x: F.when(F.contains(x, F.lit(",")), F.filter(F.split(x, ","), lambda y: strip(y) != "")).otherwise(F.array(x))))
    return _share(_sum(F.transform(segments, lambda x: F.size(eojeols(x)).cast("long"))), F.size(segments))


def ending_diversity(s: Column | str) -> Column:
    """Distinct endings for each sentence that has one; 0 without any."""
    keys = F.filter(F.transform(s, ending), lambda x: x.isNotNull())
    return _share(F.size(F.array_distinct(keys)), F.size(keys))


def declarative_ratio(s: Column | str) -> Column:
    """Share of sentences whose last token is a plain declarative."""
    return _share(F.size(F.filter(s, lambda x: F.coalesce(last_eojeol(x).rlike(DECLARATIVE), F.lit(False)))), F.size(s))


def sentence_lengths(s: Column | str) -> Column:
    return F.transform(s, lambda x: F.length(x))


def all_metrics(text: Column | str, s: Column | str) -> dict[str, Column]:
    return {
        "comma_inclusion_rate": comma_inclusion_rate(s),
        "comma_usage_rate": comma_usage_rate(s),
        "ending_comma_rate": ending_comma_rate(text),
        "comma_segment_length": comma_segment_length(s),
        "ending_diversity": ending_diversity(s),
        "declarative_ratio": declarative_ratio(s),
        "n_sentences": F.size(s).cast("long"),
    }


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def z_score(value: Column, human: Column | float, machine: Column | float, percent: bool) -> Column:
    """Place between the two means: 0 at the human one, 2 at the machine one; 0 if they are equal."""
    human, machine = (x if isinstance(x, Column) else F.lit(float(x)) for x in (human, machine))
    half = F.abs(machine - human) / 2
    return F.coalesce(F.try_divide((value * 100 if percent else value) - human, half), F.lit(0.0))


def genre_cell(genre: Column | str) -> Column:
    """The genre whose baselines apply: itself, its alias, or the default."""
    g = _col(genre)
    for alias, name in R.GENRE_ALIAS.items():
        g = F.when(g == alias, F.lit(name)).otherwise(g)
    return F.when(g.isin(*R.BASELINES), g).otherwise(F.lit(R.DEFAULT_GENRE))


def metric_z(metric: str, value: Column, genre: Column | str) -> Column:
    """Clipped z-score of a metric in its genre; null where the genre has no baseline for it."""
    cell = genre_cell(genre)
    out = F.lit(None).cast("double")
    for name, metrics in R.BASELINES.items():
        if metrics[metric] is not None:
            out = F.when(cell == name, clip(z_score(value, *metrics[metric], metric in R.PERCENT), -3.0, 3.0)).otherwise(out)
    return out


def mean_of(values: list[Column]) -> Column:
    """Mean of those that are not null; 0 if all are."""
    known = F.filter(F.array(*values), lambda x: x.isNotNull())
    return _share(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known))


def rhythm(lengths: Column | str, diversity: Column, declarative: Column) -> dict[str, Column]:
    """The four ramps of rhythm, each 0 to 1, null where it does not apply, with the values they rest on."""
    n = F.size(lengths)
    mean = _share(_sum(F.transform(lengths, lambda x: x.cast("long"))), n)
    square = F.aggregate(F.transform(lengths, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x)
    cv = _share(F.sqrt(_share(square, n)), mean)
    long_share = _share(F.size(F.filter(lengths, lambda x: x >= 100)), n)
    ramp = lambda applies, value: F.when(applies, clip(value, 0.0, 1.0))
    return {
        "sentence_len_cv": F.struct(cv.alias("value"), ramp((n >= 4) & (cv < 0.35), (0.35 - cv) / 0.25).alias("strength")),
        "ending_diversity": F.struct(diversity.alias("value"), ramp((n >= 4) & (diversity < 0.45), (0.45 - diversity) / 0.30).alias("strength")),
        "long_sentence_absence": F.struct(long_share.alias("value"), ramp((n >= 15) & (long_share < 0.04), (0.04 - long_share) / 0.04).alias("strength")),
        "normalisation_score": F.struct(declarative.alias("value"), ramp((n >= 4) & (declarative > 0.75), (declarative - 0.75) / 0.25).alias("strength")),
    }
