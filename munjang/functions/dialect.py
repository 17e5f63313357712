"""Regular expressions: Java's dialect, and literal strings that a match must hold."""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as parser
from collections.abc import Iterable
from functools import lru_cache

_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8}))")


def java(expression: str, guard: str = "") -> str:
    """The expression for Java: Unicode classes, line mode with line feeds alone, code points in braces."""
    flags = "(?U)"
    if expression.startswith("(?m)"):
        flags, expression = "(?U)(?dm)", expression[4:]
    return flags + guard + _ESCAPE.sub(lambda m: rf"\x{{{(m[1] or m[2]).lstrip('0')}}}", expression)


def any_of(words: Iterable[str]) -> str:
    """An expression for the longest of some literal words at a place: words with one first letter share a branch, the end of a word being tried last."""
    tails: dict[str, list[str]] = {}
    for word in words:
        tails.setdefault(word[:1], []).append(word[1:])
    if set(tails) <= {""}:
        return ""
    branches = [re.escape(first) + any_of(rest) for first, rest in tails.items() if first]
    return f"(?:{'|'.join(branches + [''] * ('' in tails))})"


def _better(a: set[str] | None, b: set[str] | None) -> set[str] | None:
    """The more selective of two sets: the one whose shortest string is longer, then the smaller one."""
    if a is None or b is None:
        return a or b
    rank = lambda s: (min(map(len, s)), -len(s))
    return a if rank(a) >= rank(b) else b


def _literals(items) -> set[str] | None:
    best: set[str] | None = None
    run = ""
    for op, value in [*items, (None, None)]:
        if op is sre.LITERAL:
            run += chr(value)
            continue
        if run:
            best, run = _better(best, {run}), ""
        found = None
        if op is sre.IN and all(k is sre.LITERAL for k, _ in value):
            found = {chr(v) for _, v in value}
        elif op is sre.BRANCH:
            parts = [_literals(x) for x in value[1]]
            found = None if any(x is None for x in parts) else set().union(*parts)
        elif op is sre.SUBPATTERN:
            found = _literals(value[3])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] > 0:
            found = _literals(value[2])
        best = _better(best, found)
    return best


@lru_cache(maxsize=None)
def required_literals(expression: str, most: int = 48) -> tuple[str, ...]:
    found = _literals(parser.parse(expression))
    return tuple(sorted(found)) if found and len(found) <= most else ()
