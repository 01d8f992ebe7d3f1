"""Literals that a regular expression cannot match without.

Functions of this module travel to Python workers by value, so workers need not have this package installed.
"""

from __future__ import annotations

import re
import sys
from re import _constants as ops
from re import _parser as parser

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Letters of the pieces by which literals are looked up; shorter literals say too little.
GRAM = 3
#: Alternatives up to which an expression is looked up by any of them.
ALTERNATIVES = 32


def compiled(pattern: str) -> re.Pattern | None:
    """The compiled expression, or None where Python refuses it."""
    try:
        return re.compile(pattern)
    except (re.error, RecursionError, OverflowError):
        return None


def required_literals(pattern: str) -> list[str] | None:
    """Texts of which any match holds at least one; empty where nothing of ``GRAM`` letters is sure; None if the pattern is no expression."""
    checked = compiled(pattern)
    if checked is None:
        return None
    if checked.flags & re.IGNORECASE:
        return []
    return sorted(_of_sequence(parser.parse(pattern)) or ())


def _of_sequence(items) -> frozenset[str] | None:
    """The best choice that the parts of a sequence offer: every part must match, so any of them may be asked for."""
    best, run = None, ""
    for kind, value in [*items, (None, None)]:
        if kind is ops.LITERAL:
            run += chr(value)
            continue
        for offered in (frozenset([run]), _of_part(kind, value)):
            if offered and len(offered) <= ALTERNATIVES and min(map(len, offered)) >= GRAM and (best is None or _rank(offered) > _rank(best)):
                best = offered
        run = ""
    return best


def _rank(offered: frozenset[str]) -> tuple:
    """Few alternatives first, then long ones; the texts themselves make the choice the same everywhere."""
    return -len(offered), min(map(len, offered)), sorted(offered)


def _of_part(kind, value) -> frozenset[str] | None:
    if kind is ops.SUBPATTERN:
        _, added, _, inner = value
        return None if added & re.IGNORECASE else _of_sequence(inner)
    if kind in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT):
        least, _, inner = value
        return _of_sequence(inner) if least else None
    if kind is ops.ATOMIC_GROUP:
        return _of_sequence(value)
    if kind is ops.BRANCH:
        found = [_of_sequence(option) for option in value[1]]
        return frozenset().union(*found) if all(found) else None
    return None


def grams(text: str) -> list[str]:
    """The different pieces of ``GRAM`` letters of a text."""
    return sorted({text[k : k + GRAM] for k in range(len(text) - GRAM + 1)})
