"""Boolean trigram queries that every match of a regular expression must satisfy."""

from __future__ import annotations

from re import _constants as codes
from re import _parser as parser

# Alternatives that are followed at once; beyond that a part counts as unknown.
_WIDEST = 24
_REPEATS = (codes.MAX_REPEAT, codes.MIN_REPEAT, codes.POSSESSIVE_REPEAT)

# A query is a list of clauses, all of which must hold. A clause is a list of alternatives, one of
# which must hold. An alternative is a set of trigrams, all of which must occur.
Query = list[list[frozenset[str]]]


def _clause(texts: set[str]) -> Query:
    if not texts or any(len(t) < 3 for t in texts):
        return []
    return [sorted({frozenset(t[i : i + 3] for i in range(len(t) - 2)) for t in texts}, key=sorted)]


def _exact(node) -> set[str] | None:
    """All texts that a parsed part can match, if they are few."""
    code, value = node
    if code == codes.LITERAL:
        return {chr(value)}
    if code == codes.IN:
        found = set()
        for kind, item in value:
            if kind == codes.LITERAL:
                found.add(chr(item))
            elif kind == codes.RANGE and item[1] - item[0] < _WIDEST:
                found |= {chr(c) for c in range(item[0], item[1] + 1)}
            else:
                return None
        return found if len(found) <= _WIDEST else None
    if code == codes.SUBPATTERN:
        return _sequence_exact(value[-1])
    if code == codes.BRANCH:
        parts = [_sequence_exact(p) for p in value[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if code in _REPEATS and value[1] != codes.MAXREPEAT:
        once = _sequence_exact(value[2])
        if once is None or len(once) ** int(value[1]) > _WIDEST:
            return None
        found, made = set(), {""}
        for k in range(int(value[1]) + 1):
            found |= made if k >= value[0] else set()
            made = {a + b for a in made for b in once}
        return found
    return {""} if code == codes.AT else None


def _sequence_exact(parts) -> set[str] | None:
    texts = {""}
    for node in parts:
        own = _exact(node)
        if own is None or len(own) * len(texts) > _WIDEST:
            return None
        texts = {a + b for a in texts for b in own}
    return texts


def _sequence(parts) -> Query:
    query, texts = [], {""}
    for node in parts:
        own = _exact(node)
        if own is not None and len(own) * len(texts) <= _WIDEST:
            texts = {a + b for a in texts for b in own}
            continue
        query += _clause(texts)
        texts = own if own is not None else {""}
        if own is None:
            query += _inner(node)
    return query + _clause(texts)


def _inner(node) -> Query:
    """What a part without a short list of texts requires."""
    code, value = node
    if code == codes.SUBPATTERN:
        return _sequence(value[-1])
    if code in _REPEATS and value[0] > 0:
        return _sequence(value[2])
    if code == codes.BRANCH:
        parts = [_sequence(p) for p in value[1]]
        if all(parts):
            # one clause of each branch: whichever branch matches, its clause holds
            return [[alternative for p in parts for alternative in p[0]]]
    return []


def trigram_query(pattern: str) -> Query:
    """The query of a pattern, over lower-cased texts. An empty query: the pattern needs a full scan."""
    seen, query = set(), []
    for clause in _sequence(parser.parse(pattern)):
        lowered = sorted({frozenset(t.lower() for t in a) for a in clause}, key=sorted)
        if (mark := tuple(map(tuple, map(sorted, lowered)))) not in seen:
            seen.add(mark)
            query.append(lowered)
    return query
