"""Boolean trigram queries from regular expressions.

A text that a pattern matches must hold certain trigrams (of its UTF-8 bytes, A-Z in lower case). The pattern's parsed form is walked bottom up;
each part knows the strings it can be, if they are few, or else how its matches can begin and end, and what any match must hold. A query is ``True``
(nothing is known: every text may match), a trigram number, or ``("and" | "or", frozenset of queries)``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from re import _constants as op
from re import _parser
from typing import Any

Query = Any
#: Strings that a part may have; longer lists, and classes of more bytes, are given up for what they must hold.
MOST_STRINGS, MOST_CLASS = 64, 12
EMPTY = frozenset([b""])


def trigram(three: bytes) -> int:
    return int.from_bytes(three, "big")


def both(*queries: Query) -> Query:
    parts = set()
    for q in queries:
        parts |= q[1] if isinstance(q, tuple) and q[0] == "and" else set() if q is True else {q}
    return True if not parts else parts.pop() if len(parts) == 1 else ("and", frozenset(parts))


def either(queries: Iterable[Query]) -> Query:
    parts = set(queries)
    return True if not parts or True in parts else parts.pop() if len(parts) == 1 else ("or", frozenset(parts))


def holding(strings: Iterable[bytes]) -> Query:
    """What a text must hold if it holds one of ``strings``."""
    return either(both(*(trigram(s[i:i + 3]) for i in range(len(s) - 2))) for s in strings)


@dataclass(frozen=True)
class Part:
    """``exact``: all its strings, or None; ``first`` and ``last``: sets of which one begins or ends each match; ``query``: what matches hold besides."""

    exact: frozenset[bytes] | None
    first: frozenset[bytes] = EMPTY
    last: frozenset[bytes] = EMPTY
    query: Query = True

    def ends(self) -> Part:
        """Without ``exact``: its strings live on as beginnings and ends of up to two bytes, and as what must be held."""
        if self.exact is None:
            return self
        return Part(None, frozenset(s[:2] for s in self.exact), frozenset(s[-2:] for s in self.exact), holding(self.exact))


ANY = Part(None)
NOTHING = Part(EMPTY)


def joined(a: Part, b: Part) -> Part:
    """a, then b."""
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MOST_STRINGS:
        return Part(frozenset(x + y for x in a.exact for y in b.exact))
    met = True
    left, right = a.exact if a.exact is not None else a.last, b.exact if b.exact is not None else b.first
    if len(left) * len(right) <= MOST_STRINGS:
        met = holding(x + y for x in left for y in right)
    first, last = a.ends().first, b.ends().last
    if a.exact is not None and len(a.exact) * len(right) <= MOST_STRINGS:
        first = frozenset((x + y)[:2] for x in a.exact for y in right)
    if b.exact is not None and len(b.exact) * len(left) <= MOST_STRINGS:
        last = frozenset((x + y)[-2:] for x in left for y in b.exact)
    return Part(None, first, last, both(a.ends().query, b.ends().query, met))


def one_of(parts: list[Part]) -> Part:
    if all(p.exact is not None for p in parts) and sum(len(p.exact) for p in parts) <= MOST_STRINGS:
        return Part(frozenset().union(*(p.exact for p in parts)))
    loose = [p.ends() for p in parts]
    return Part(None, frozenset().union(*(p.first for p in loose)), frozenset().union(*(p.last for p in loose)), either(p.query for p in loose))


def character(code: int) -> bytes:
    return chr(code).encode().lower()  # bytes.lower() changes A-Z only


def class_of(items: list) -> Part:
    """A character class; categories, negations and wide ranges may be anything."""
    found = set()
    for kind, value in items:
        if kind is op.LITERAL:
            found.add(character(value))
        elif kind is op.RANGE and value[1] - value[0] < 4 * MOST_CLASS:
            found |= {character(x) for x in range(value[0], value[1] + 1)}
        else:
            return ANY
    return Part(frozenset(found)) if len(found) <= MOST_CLASS else ANY


def walk(items: Iterable, folded: bool) -> Part:
    whole = NOTHING
    for kind, value in items:
        if kind is op.LITERAL:
            # With IGNORECASE a letter may stand for ones beyond A-Z: those of ASCII are safe with the ASCII flag only.
            part = ANY if folded and chr(value).isalpha() else Part(frozenset([character(value)]))
        elif kind is op.IN:
            part = ANY if folded else class_of(value)
        elif kind is op.BRANCH:
            part = one_of([walk(x, folded) for x in value[1]])
        elif kind is op.SUBPATTERN:
            _, added, removed, inner = value
            part = walk(inner, folded or bool(added & re.IGNORECASE)) if not removed else ANY
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            least, most, inner = value
            once = walk(inner, folded)
            part = NOTHING
            for _ in range(min(least, 4)):
                part = joined(part, once)
            if (least, most) == (0, 1):
                part = one_of([NOTHING, once])
            elif most != least or least > 4:
                part = joined(joined(part, ANY), once) if least else ANY
        elif kind is op.ATOMIC_GROUP:
            part = walk(value, folded)
        elif kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
            part = NOTHING
        else:  # any character, back references, conditions
            part = ANY
        whole = joined(whole, part)
    return whole


def trigram_query(pattern: str) -> Query:
    """What every text with a match of ``pattern`` holds; ``True`` if it needs no trigram."""
    parsed = _parser.parse(pattern)
    return walk(parsed, bool(parsed.state.flags & re.IGNORECASE)).ends().query


def trigrams_of(query: Query) -> set[int]:
    if query is True:
        return set()
    return set().union(*map(trigrams_of, query[1])) if isinstance(query, tuple) else {query}


def evaluated(query: Query, postings: Callable[[int], Any], everything: Any) -> Any:
    """The rows that ``query`` leaves; ``postings`` gives a bit set of the rows that hold a trigram."""
    if query is True:
        return everything
    if not isinstance(query, tuple):
        return postings(query)
    kind, parts = query
    found = None
    for part in parts:
        rows = evaluated(part, postings, everything)
        found = rows if found is None else found & rows if kind == "and" else found | rows
    return found
