"""Matches of an expression as nested columns, without leaving the JVM.

The expression's matches are wrapped in control characters and the text is
split at them: element 0 is what precedes the first match, every other one is
a match, its groups and what follows it. Positions are in code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

START, END, NEXT = "\x01", "\x02", "\x03"


def without_marks(c: Column) -> Column:
    return F.translate(c, START + END + NEXT, "")


def pieces(text: Column, expression: str | Column, groups: int = 0) -> Column:
    """Prefix, then for each match ``$0 NEXT $1 ... END tail``."""
    inner = NEXT.join(f"${i}" for i in range(groups + 1))
    rx = expression if isinstance(expression, Column) else F.lit(expression)
    return F.split(F.regexp_replace(text, rx, F.lit(START + inner + END)), START)


def rest(parts: Column) -> Column:
    return F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))


def match_parts(element: Column) -> tuple[Column, Column]:
    """(groups as an array, tail) of one element."""
    cut = F.split(element, END)
    return F.split(cut[0], NEXT), cut[1]


def spans(parts: Column) -> Column:
    """array<struct<start, end, text>> of the matches, in code points."""
    begin = F.struct(F.length(parts[0]).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("found"))

    def step(acc: Column, element: Column) -> Column:
        groups, tail = match_parts(element)
        size = F.length(groups[0])
        own = F.struct(acc["at"].alias("start"), (acc["at"] + size).alias("end"), groups[0].alias("text"))
        return F.struct((acc["at"] + size + F.length(tail)).alias("at"), F.array_append(acc["found"], own).alias("found"))

    return F.aggregate(rest(parts), begin, step)["found"]


def replaced(parts: Column, build: Callable[[Column], Column]) -> Column:
    """array<struct<before, after, tail>>: each match with what ``build`` makes of its groups."""

    def one(element: Column) -> Column:
        groups, tail = match_parts(element)
        return F.struct(groups[0].alias("before"), F.coalesce(build(groups), groups[0]).alias("after"), tail.alias("tail"))

    return F.transform(rest(parts), one)


def joined(first: Column, done: Column) -> Column:
    return F.concat(first, F.array_join(F.transform(done, lambda x: F.concat(x["after"], x["tail"])), ""))
