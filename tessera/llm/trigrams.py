"""Boolean trigram queries that follow from a regular expression: any match of it satisfies the query.

The parsed expression is worked through from its leaves. Of each part is known either the whole set of strings that it
can match, while these are few, or what its matches begin and end with, and a query that they satisfy. Letters A-Z count
as a-z, for expressions that ignore case and for those that don't.
"""

from __future__ import annotations

import string
from dataclasses import dataclass
from itertools import product
from re import _constants as op
from re import _parser as parser

#: A disjunction of conjunctions of trigrams. ALL, one empty conjunction, is satisfied by any text.
Query = frozenset
ALL: Query = frozenset({frozenset()})
#: Strings that are known of a part at most, characters of a class that counts as a choice, and conjunctions of a query.
STRINGS, CHOICES, CONJUNCTIONS = 64, 8, 64
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def _least(query) -> Query:
    """The query without conjunctions that others make needless."""
    return frozenset(x for x in query if not any(y < x for y in query))


def either(a: Query, b: Query) -> Query:
    out = _least(a | b)
    return out if len(out) <= CONJUNCTIONS else ALL


def both(a: Query, b: Query) -> Query:
    out = _least(frozenset(x | y for x, y in product(a, b)))
    return out if len(out) <= CONJUNCTIONS else min(a, b, key=len)


def holding(strings: frozenset) -> Query:
    """A text holds one of the strings: then all trigrams of one of them."""
    return _least(frozenset(frozenset(x[i : i + 3] for i in range(len(x) - 2)) for x in strings))


@dataclass(frozen=True)
class _Part:
    """exact: all strings that it can match, or None; begins, ends: what each match begins and ends with."""

    exact: frozenset | None
    begins: frozenset
    ends: frozenset
    query: Query = ALL

    @classmethod
    def of(cls, strings) -> _Part:
        known = frozenset(strings)
        return cls(known, known, known) if 0 < len(known) <= STRINGS else ANYTHING

    def known(self) -> Query:
        return both(self.query, both(holding(self.begins), holding(self.ends)))

    def then(self, other: _Part) -> _Part:
        if self.exact is not None and other.exact is not None and len(self.exact) * len(other.exact) <= STRINGS:
            return _Part.of(a + b for a, b in product(self.exact, other.exact))
        query = both(self.query, other.query)
        meet = frozenset(a + b for a, b in product(_cut(self.ends, slice(-2, None)), _cut(other.begins, slice(0, 2))))
        query = both(query, both(holding(self.ends), both(holding(meet), holding(other.begins))))
        begins, ends = self.begins, other.ends
        if self.exact is not None:
            begins = _few(frozenset(a + b for a, b in product(self.exact, other.begins)), self.begins)
        if other.exact is not None:
            ends = _few(frozenset(a + b for a, b in product(self.ends, other.exact)), other.ends)
        return _Part(None, begins, ends, query)

    def alternatively(self, other: _Part) -> _Part:
        if self.exact is not None and other.exact is not None:
            return _Part.of(self.exact | other.exact)
        none = frozenset({""})
        return _Part(None, _few(self.begins | other.begins, none), _few(self.ends | other.ends, none), either(self.known(), other.known()))


ANYTHING = _Part(None, frozenset({""}), frozenset({""}))
_EMPTY = _Part.of([""])


def _cut(strings: frozenset, part: slice) -> frozenset:
    return frozenset(x[part] for x in strings)


def _few(strings: frozenset, instead: frozenset) -> frozenset:
    return strings if len(strings) <= STRINGS else instead


def _choice(items) -> _Part:
    """A class of characters: a choice if it's of few single ones."""
    chars: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            chars.add(chr(value).translate(_LOWER))
        elif kind is op.RANGE and value[1] - value[0] < 2 * CHOICES:
            chars |= {chr(c).translate(_LOWER) for c in range(value[0], value[1] + 1)}
        else:
            return ANYTHING
    return _Part.of(chars) if len(chars) <= CHOICES else ANYTHING


def _repeated(part: _Part, least: int, most: int) -> _Part:
    out = _EMPTY
    for _ in range(min(least, 4)):
        out = out.then(part)
    if least > 4:  # what comes between the first and the last ones is left open
        out = out.then(ANYTHING).then(part)
    if most == least:
        return out
    return out.then(_EMPTY.alternatively(part)) if most == least + 1 else out.then(ANYTHING)


def _part(tokens) -> _Part:
    out = _EMPTY
    for kind, value in tokens:
        if kind is op.LITERAL:
            part = _Part.of([chr(value).translate(_LOWER)])
        elif kind is op.IN:
            part = _choice(value)
        elif kind is op.SUBPATTERN:
            part = _part(value[-1])
        elif kind is op.BRANCH:
            first, *rest = map(_part, value[1])
            part = first
            for x in rest:
                part = part.alternatively(x)
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            part = _repeated(_part(value[2]), value[0], value[1])
        elif kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
            part = _EMPTY
        else:
            part = ANYTHING
        out = out.then(part)
    return out


def trigram_query(pattern: str) -> Query:
    """What any text with a match of the pattern satisfies, if A-Z count as a-z; ALL if nothing follows."""
    return _part(parser.parse(pattern)).known()
