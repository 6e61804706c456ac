"""Literals that every match of a regular expression holds, to look for before the expression is tried.

A pattern's syntax tree says which texts a match can't do without: of a sequence, any of its parts will do, and the one whose shortest
text is longest is taken; of alternatives, all are needed, one of which a match has. Looking for a text in a line is a scan of
bytes, which most lines end at; the pattern is tried on the others only. Patterns without such a text are tried always.
"""

from __future__ import annotations

import re
from functools import lru_cache, reduce
from re import _constants as K
from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that alternatives may amount to before they are given up.
MOST = 16


def _better(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
    if a is None or b is None:
        return a if b is None else b
    score = lambda x: (min(map(len, x)), -len(x))
    return max(a, b, key=score)


def _needed(tree) -> frozenset[str] | None:
    """Texts of which any match of the tree has one; none if nothing is needed."""
    best, run = None, ""
    for op, arg in [*tree, (None, None)]:
        if op is K.LITERAL:
            run += chr(arg)
            continue
        if run:
            best, run = _better(best, frozenset([run])), ""
        found = None
        if op is K.SUBPATTERN:
            found = _needed(arg[3])
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT) and arg[0] >= 1:
            found = _needed(arg[2])
        elif op is K.ATOMIC_GROUP:
            found = _needed(arg)
        elif op is K.BRANCH:
            each = [_needed(x) for x in arg[1]]
            if all(each):
                found = frozenset().union(*each)
        elif op is K.IN and len(arg) <= MOST and all(o is K.LITERAL for o, _ in arg):
            found = frozenset(chr(c) for _, c in arg)
        if found is not None and len(found) <= MOST:
            best = _better(best, found)
    return best


@lru_cache(maxsize=1024)
def required(pattern: str) -> tuple[frozenset[str], bool] | None:
    """The texts of which any match has one, and whether letters' case does not count; none if the pattern needs none, or is not understood.

    Flags count at the beginning of a pattern only; texts with letters beyond ASCII are no help.
    """
    try:
        tree = parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return None
    any_case = bool(tree.state.flags & re.IGNORECASE)
    if tree.state.flags & re.VERBOSE or re.search(r"\(\?[a-zA-Z]*-?[a-zA-Z]*i[a-zA-Z]*:", pattern):
        return None
    found = _needed(tree)
    if not found or any(not x.isascii() for x in found):
        return None
    # a text that holds another is found with it
    least = frozenset(x for x in found if not any(y != x and y in x for y in found))
    return (frozenset(x.lower() for x in least) if any_case else least), any_case


def may_match(text: Column, patterns: tuple[str, ...]) -> Column | None:
    """Whether a text has what a match of any of the patterns needs; none if one of them needs nothing."""
    out = []
    for p in patterns:
        need = required(p)
        if need is None:
            return None
        literals, any_case = need
        if any_case and p.removeprefix("(?i)").startswith("^"):
            return None  # a pattern for a line's beginning fails sooner than a line is lower-cased
        where = F.lower(text) if any_case else text
        out += [F.contains(where, F.lit(x)) for x in sorted(literals)]
        if any_case:
            # some letters beyond ASCII equal ASCII ones of either case
            out.append(F.length(text) != F.octet_length(text))
    return reduce(lambda a, b: a | b, out)
