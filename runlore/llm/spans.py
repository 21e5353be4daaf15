"""Places of regular-expression matches in a text, as column expressions.

Positions are code points, ends exclusive. Everything is linear in the text: positions come from the
lengths of matches and of the pieces between them, never from cutting the text at an offset.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def scan(values: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Running results of an associative ``step`` over an array: element i covers values 0 to i.

    Appending copies an array, so long arrays are scanned in blocks whose results are shifted by
    those of the blocks before.
    """

    def plain(a: Column) -> Column:
        grown = F.aggregate(a, F.array(zero), lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x))))
        return let(grown, lambda g: F.slice(g, 2, F.size(g) - 1))

    def blocked(a: Column) -> Column:
        cuts = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / _BLOCK).cast("int"))
        blocks = F.transform(cuts, lambda b: plain(F.slice(a, b * _BLOCK + 1, F.lit(_BLOCK))))

        def shifted(parts: Column) -> Column:
            before = F.concat(F.array(zero), plain(F.transform(parts, lambda p: F.element_at(p, -1))))
            return let(before, lambda s: F.flatten(F.transform(parts, lambda p, i: F.transform(p, lambda v: step(s[i], v)))))

        return let(blocks, shifted)

    return F.when(F.size(values) <= _BLOCK, plain(values)).otherwise(blocked(values))


def find_all(text: Column, pattern: str, context: int = 0) -> Column:
    """All leftmost non-overlapping matches: array of (start, end, value, before), with ``context`` also ``after``.

    ``before`` holds the last ``context`` code points between the match before and this one, ``after``
    the first ones up to the next match.
    """
    kind = f"array<struct<start:int,end:int,value:string,before:string{',after:string' if context else ''}>>"

    def placed(found: Column, pieces: Column) -> Column:
        sizes = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, v: F.char_length(p) + F.char_length(v))

        def rows(ends: Column) -> Column:
            return F.transform(
                F.arrays_zip(found.alias("v"), ends.alias("e")),
                lambda m, i: F.struct(
                    (m["e"] - F.char_length(m["v"])).alias("start"),
                    m["e"].alias("end"),
                    m["v"].alias("value"),
                    (F.right(pieces[i], F.lit(context)) if context else F.lit("")).alias("before"),
                    *([F.left(pieces[i + 1], F.lit(context)).alias("after")] if context else []),
                ),
            )

        return let(sizes, lambda s: let(scan(s, F.lit(0), lambda a, b: a + b), rows))

    return let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda found: F.when(F.size(found) == 0, F.array().cast(kind)).otherwise(
            let(F.split(text, pattern, -1), lambda pieces: placed(found, pieces)).cast(kind)
        ),
    )


def joined(spans: Column, kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` of (start, rank, end) structs in their order, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", names[s["rank"]], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def ranked(found: Column, rank: int) -> Column:
    """Matches as (start, rank, end) structs, the form in which spans of several kinds are sorted."""
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end")))


def apart(found: Column, spans: Column) -> Column:
    """The matches that overlap none of ``spans``, in the order of their positions.

    Both are sorted together: of the spans that begin before a match the last end counts, of the
    others the first beginning.
    """
    far = F.lit(2**31 - 1)
    event = lambda m, late, place: F.struct(
        m["start"].alias("start"), F.lit(late).alias("late"), m["end"].alias("end"), place.alias("place")
    )

    def free(events: Column, matches: Column) -> Column:
        own = F.transform(events, lambda e: F.when(e["late"] == 0, e["end"]).otherwise(F.lit(0)))
        begins = F.transform(F.reverse(events), lambda e: F.when(e["late"] == 0, e["start"]).otherwise(far))
        ends = let(own, lambda o: scan(o, F.lit(0), F.greatest))
        nexts = let(begins, lambda b: let(scan(b, far, F.least), F.reverse))
        fits = lambda e, before, after: (e["late"] == 1) & (before <= e["start"]) & (after >= e["end"])
        kept = let(ends, lambda x: let(nexts, lambda y: F.filter(events, lambda e, i: fits(e, x[i], y[i]))))
        return F.transform(kept, lambda e: matches[e["place"]])

    def parted(matches: Column) -> Column:
        taken = F.transform(spans, lambda s: event(s, 0, F.lit(-1)))
        events = F.array_sort(F.concat(taken, F.transform(matches, lambda m, i: event(m, 1, i))))
        return F.when((F.size(matches) == 0) | (F.size(spans) == 0), matches).otherwise(let(events, lambda e: free(e, matches)))

    return let(found, parted)


def outermost(spans: Column) -> Column:
    """(start, rank, end) structs that lie in no other one, one of equal ones, sorted."""
    wide = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["rank"].alias("rank"))))

    def kept(sorted_: Column) -> Column:
        upto = let(F.transform(sorted_, lambda s: -s["back"]), lambda e: scan(e, F.lit(0), F.greatest))
        out = let(upto, lambda u: F.filter(sorted_, lambda s, i: (i == 0) | (-s["back"] > u[F.greatest(i - 1, F.lit(0))])))
        return F.transform(out, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), (-s["back"]).alias("end")))

    return let(wide, kept)


def masked(text: Column, spans: Column, kinds: tuple[str, ...]) -> Column:
    """The text with each run of overlapping spans replaced by ``[KIND]`` of its first one.

    ``spans`` are sorted (start, rank, end) structs. Only texts with a span are taken apart.
    """
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in kinds])

    def built(chars: Column, upto: Column) -> Column:
        def part(s: Column, i: Column) -> Column:
            done = F.when(i == 0, F.lit(0)).otherwise(upto[i - 1])
            gap = F.greatest(s["start"] - done, F.lit(0))
            kept = F.array_join(F.slice(chars, done + 1, gap), "")
            return F.concat(kept, F.when((s["start"] >= done), marks[s["rank"]]).otherwise(""))

        tail = let(F.element_at(upto, -1), lambda e: F.array_join(F.slice(chars, e + 1, F.size(chars) - e), ""))
        return F.concat(F.array_join(F.transform(spans, part), ""), tail)

    ends = F.transform(spans, lambda s: s["end"])
    whole = let(
        F.split(text, "", -1),
        lambda chars: let(ends, lambda e: let(scan(e, F.lit(0), F.greatest), lambda upto: built(chars, upto))),
    )
    return F.when(F.size(spans) == 0, text).otherwise(whole)
