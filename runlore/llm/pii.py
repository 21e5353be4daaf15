"""Personal data in texts: base patterns, and further spans chosen by boosted trees.

Four base patterns with a check each always count. Two generators with high recall propose more
spans. Positives are checked base matches, as they stand and written in the other ways that people
use: a phone without its country code, an address with (at). A proposal without a base match is not
thereby a negative: one of the same form as many positives has no label and is left out of fitting
and calibration, unless it stands where positives hardly ever do. Trees learn from format and the words
on both sides, and a threshold calibrated on values kept from fitting selects the proposals that look
like personal data.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlore.llm.boost import Boosted, calibrated
from runlore.llm.spans import apart, find_all, joined, let, masked, outermost, ranked, scan

KINDS = ("email", "ip", "card", "phone")

# The lookbehinds and \G only spare attempts inside a run that cannot match anyway; the possessive
# groups are followed by nothing, or by something that they cannot hold, so matches stay the same.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

# generator -> (pattern, kinds that its proposals may be)
GENERATORS = {
    "number": (r"[+(]?[0-9](?:[\x20()./-]{0,3}+[0-9]){6,}+", ("ip", "card", "phone")),
    "address": (
        r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)*+",
        ("email",),
    ),
}
# Parts of a run that neither spaces, slashes nor brackets cut.
_PART = r"\+?\(?[0-9]++(?:[.-][0-9]++)*+"
# Digits of what is proposed from some parts of a run; no more parts than digits can belong to it.
_FEWEST, _MOST = 7, 19
# Addresses again, without a space beside a plain dot, which may end a sentence.
_TIGHT = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?\(dot\)\x20?|\x20?\[dot\]\x20?)[A-Za-z0-9-]++)*+"
CONTEXT = 24
# At least this share of the labelled distinct values that a threshold selects in the calibration fold
# is positive, and at least this many are.
PRECISION = 0.97
LEAST = 20
# A form is a look-alike's in surroundings that are so many times as frequent among what has no label as
# among the positives of that form.
STRANGE = 3
# Surroundings also differ by the last word before, in so many classes by its hash. Trees do not see it: the
# words before base matches are not all those before other spans.
WORDS = 16


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _checked(kind: str, value: Column) -> Column:
    """The check of a base match."""
    if kind == "ip":
        small = lambda p: let(F.ltrim(p, F.lit("0")), lambda d: (F.length(d) <= 3) & (F.coalesce(d.try_cast("int"), F.lit(0)) <= 255))
        return F.forall(F.split(value, r"\."), small)
    if kind == "card":
        return let(_digits(value), lambda d: F.length(d).between(14, 19) & F.call_function("luhn_check", d))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str, context: int = 0) -> Column:
    """Checked matches of one base pattern, as find_all gives them."""
    guard = {"email": "@", "ip": ".", "phone": "+"}.get(kind)
    found = F.filter(find_all(text, PATTERNS[kind], context), lambda m: _checked(kind, m["value"]))
    return found if guard is None else F.when(F.contains(text, F.lit(guard)), found).otherwise(F.slice(found, 1, 0))


def _features(value: Column, before: Column, after: Column) -> list[Column]:
    near, next_ = F.lower(before), F.lower(after)
    digits = F.length(_digits(value))
    groups = F.size(F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0)))
    return [
        F.contains(value, F.lit("(")),
        F.contains(value, F.lit(".")),
        F.contains(value, F.lit("-")),
        F.contains(value, F.lit(" ")),
        F.contains(value, F.lit("/")),
        F.contains(value, F.lit("@")),
        digits >= 10,
        digits >= 12,
        digits >= 14,
        digits >= 17,
        groups >= 2,
        groups >= 3,
        groups >= 4,
        groups >= 5,
        F.rlike(value, F.lit("[0-9]{5}")),
        F.rlike(value, F.lit("[^0-9][0-9]{4}$")),
        F.rlike(value, F.lit("^[3-6]")),
        F.rlike(near, F.lit(r"\b(tel|telephone|phone|call|fax|mobile|cell)\b")),
        F.rlike(near, F.lit(r"\b(card|visa|credit|debit|payment)\b")),
        F.rlike(near, F.lit(r"\b(ip|host|server|address|mail|e-mail|email|contact)\b")),
        F.rlike(value, F.lit(r"[(\[]at[)\]]")),
        F.rlike(value, F.lit(r"[(\[]dot[)\]]|[A-Za-z0-9-]\.[A-Za-z0-9-]")),
        F.rlike(near, F.lit(_THING)),
        F.rlike(next_, F.lit(_THING)),
        F.rlike(next_, F.lit(r"\b(ext|extension|tel|telephone|phone|call|fax|mobile|cell|mail|e-mail|email)\b")),
    ]


_THING = r"\b(order|invoice|part|item|ticket|case|ref|reference|serial|sku|isbn|code|version|build|batch|model)\b"
_WIDTH = 25
# Separators, words before a phone and a written @: bare digits without these have no form by which to
# tell a phone from an order number.
_FORM = 0b111111 | 1 << 17 | 1 << 20
# The words around a span, and of these the ones beside which a number is called.
_AROUND = 0b111 << 17 | 0b111 << 22
_CALLED = 1 << 17 | 1 << 24


def _pattern(value: Column, before: Column, after: Column) -> Column:
    """The features as bits of a long; there are at most 2^25 patterns, and far fewer occur."""
    bits = [F.when(f, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, f in enumerate(_features(value, before, after))]
    return reduce(lambda a, b: a + b, bits)


def _cut(run: Column) -> Column:
    """A run and what consecutive parts of it make, where these have _FEWEST to _MOST digits."""

    def spans(parts: Column, upto: Column) -> Column:
        def text(i: Column, j: Column) -> Column:
            piece = lambda p, k: F.when(k == 0, p["value"]).otherwise(F.concat(p["before"], p["value"]))
            return F.array_join(F.transform(F.slice(parts, i + 1, j - i + 1), piece), "")

        def begun(i: Column) -> Column:
            last = F.least(i + _MOST - 1, F.size(parts) - 1)
            number = lambda j: upto[j] - F.when(i == 0, F.lit(0)).otherwise(upto[i - 1])
            part_of = lambda j: (j - i < F.size(parts) - 1) & number(j).between(_FEWEST, _MOST)
            ends = F.filter(F.sequence(i, last), part_of)
            return F.transform(
                ends,
                lambda j: F.struct(
                    (run["start"] + parts[i]["start"]).alias("start"), (run["start"] + parts[j]["end"]).alias("end"),
                    text(i, j).alias("value"), run["before"].alias("before"), run["after"].alias("after"), F.lit(False).alias("whole"),
                ),
            )

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), begun))

    def several(parts: Column) -> Column:
        sizes = F.transform(parts, lambda p: F.length(_digits(p["value"])))
        return let(sizes, lambda n: let(scan(n, F.lit(0), lambda x, y: x + y), lambda upto: spans(parts, upto)))

    return F.concat(F.array(_whole(run)), let(find_all(run["value"], _PART, 3), several))


def _whole(m: Column) -> Column:
    return F.struct(*[m[f].alias(f) for f in ("start", "end", "value", "before", "after")], F.lit(True).alias("whole"))


def _once(docs: DataFrame, name: str, value: Column) -> DataFrame:
    """``docs`` with a column that is computed once, whatever reads it (explode of one element)."""
    return docs.withColumn(name, F.explode(F.array(value)))


def proposed(docs: DataFrame, generator: str, base: Column) -> DataFrame:
    """``docs`` with ``__free``: proposed spans that overlap no span of ``base``, as (start, end, value, before, after, whole).

    They may overlap each other. ``before`` and ``after`` are the words around the run, for its parts too; these
    are not ``whole``. The steps are columns of their own, because lambdas that are nested too deeply are
    not resolved.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = find_all(text, GENERATORS[generator][0], CONTEXT)
    if generator == "address":
        found = F.concat(found, find_all(text, _TIGHT, CONTEXT))
        found = F.when(F.rlike(text, F.lit(r"@|[(\[]at[)\]]")), found).otherwise(F.slice(found, 1, 0))
    runs = _once(docs, "__runs", found)
    spans = F.flatten(F.transform("__runs", _cut)) if generator == "number" else F.transform("__runs", _whole)
    cut = _once(runs, "__found", spans).drop("__runs")
    return _once(cut, "__free", apart(F.col("__found"), base)).drop("__found")


def _forms(kind: str, value: Column) -> Column:
    """A base match as it stands and in the other ways of writing it."""
    part = lambda n: F.substring_index(value, "@", n)
    again = lambda at, dot: F.concat(part(1), F.lit(at), F.replace(part(-1), F.lit("."), F.lit(dot)))
    if kind == "email":
        ways = [again(f"{gap}{a}at{b}{gap}", dot) for a, b in ("()", "[]") for gap in ("", " ") for dot in (".", f"{gap}{a}dot{b}{gap}")]
        return F.array(value, *ways)
    if kind == "phone":
        return F.array_distinct(F.array(value, F.regexp_replace(value, r"^\+[0-9]{1,3}[\x20.-]*(?=[(\x20.-])[\x20.-]*(?=[(0-9])", "")))
    if kind == "card":
        return F.array_distinct(F.array(value, F.regexp_replace(value, r"[\x20-]", "."), F.regexp_replace(value, r"[\x20-]", "/")))
    return F.array(value)


def _examples(docs: DataFrame) -> DataFrame:
    """generator, value, before, after, fold and rank, from one scan: all ways to write the checked base matches of each
    generator's kinds, and, with rank -1, its proposals that overlap no base match. All ways of one value share its fold."""
    text = F.coalesce(F.col("text"), F.lit(""))
    row = lambda generator, value, of, m, rank, whole: F.struct(
        F.lit(generator).alias("generator"), value.alias("value"), of.alias("of"), m["before"].alias("before"),
        m["after"].alias("after"), F.lit(rank).alias("rank"), whole.alias("whole"),
    )

    def positives(generator: str, kind: str) -> Column:
        ways = lambda m: F.transform(_forms(kind, m["value"]), lambda v: row(generator, v, m["value"], m, KINDS.index(kind), F.lit(True)))
        return F.flatten(F.transform(F.col(f"__base.{kind}"), ways))

    def others(generator: str) -> Column:
        return F.transform("__free", lambda p: row(generator, p["value"], p["value"], p, -1, p["whole"]))

    base = F.struct(*[base_spans(text, k, CONTEXT).alias(k) for k in KINDS])
    every = F.concat(*[ranked(F.col(f"__base.{k}"), i) for i, k in enumerate(KINDS)])
    found, rows = _once(docs.select("text"), "__base", base), []
    for generator, (_, kinds) in GENERATORS.items():
        found = _once(proposed(found, generator, every), f"__{generator}", others(generator)).drop("__free")
        rows += [F.col(f"__{generator}"), *[positives(generator, k) for k in kinds]]
    examples = found.select(F.explode(F.concat(*rows)).alias("p")).select("p.*")
    return examples.withColumn("fold", F.pmod(F.xxhash64("of"), F.lit(3))).drop("of")


def _unlike(pattern: np.ndarray, word: np.ndarray, n: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray) -> np.ndarray:
    """Which unlabelled patterns stand in surroundings, without a word for calling, that are strange to the positives.

    Surroundings are strange if they hold at least LEAST unlabelled values, and STRANGE times the share of these that they
    hold of the positives.
    """
    names, place = np.unique((pattern & _AROUND) * WORDS + word, return_inverse=True)
    counted = lambda chosen: np.bincount(place, n * chosen, len(names))
    known, free = counted(positive), counted(unlabelled)
    strange = (free >= LEAST) & (free * known.sum() > STRANGE * known * free.sum())
    return unlabelled & strange[place] & (pattern & _CALLED == 0)


def train(docs: DataFrame) -> dict[tuple[str, str], Boosted]:
    """One calibrated model per generator and kind, from the base matches and proposals in all texts.

    Spark counts the distinct values of (feature pattern, class of the word before, rank, fold); these counts,
    bounded by the numbers of patterns and classes, reach the driver. A card's digits tell its label in any form, and a value that
    the base pattern of its kind rejects is a negative; other proposals of the form of at least
    LEAST positives have no label for a phone or an address, but those written like a phone where phones are
    strange are negatives. Parts of a run have none for a card, as one in ten of any digits passes its check.
    """
    value, free = F.col("value"), F.col("rank") == -1
    card = free & ~F.startswith(value, F.lit("+")) & _checked("card", value)
    rejected = free & F.startswith(value, F.lit("+"))
    word = F.pmod(F.xxhash64(F.regexp_extract(F.lower("before"), r"(\w*)\W*$", 1)), F.lit(WORDS))
    counted = (
        _examples(docs)
        .select("generator", _pattern(value, F.col("before"), F.col("after")).alias("pattern"), word.alias("word"), "fold", "rank", "value", "whole", card.alias("card"), rejected.alias("rejected"))
        .distinct()
        .groupBy("generator", "pattern", "word", "fold", "rank", "whole", "card", "rejected")
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    )
    models = {}
    for generator, (_, kinds) in GENERATORS.items():
        own = [r for r in counted if r["generator"] == generator]
        column = lambda name: np.array([r[name] for r in own], np.int64)  # noqa: B023, E731
        pattern, fold, rank, n = (column(c) for c in ("pattern", "fold", "rank", "n"))
        form = pattern & ~_AROUND
        for kind in kinds:
            positive = (rank == KINDS.index(kind)) | ((kind == "card") & (column("card") == 1))
            labelled = (column("whole") == 1) | (kind != "card")
            if kind in ("phone", "email"):
                sure = positive & (fold != 0)
                alike, place = np.unique(form[sure], return_inverse=True)
                alike = alike[np.bincount(place, n[sure], len(alike)) >= LEAST]
                unlabelled = (rank == -1) & (column("rejected") == 0) & np.isin(form, alike) & (pattern & _FORM != 0)
                if kind == "phone":
                    unlabelled &= ~_unlike(pattern, column("word"), n, positive & np.isin(form, alike), unlabelled)
                labelled = labelled & ~unlabelled
            models[generator, kind] = calibrated(
                pattern[labelled], (n * positive)[labelled], n[labelled], fold[labelled], _WIDTH, PRECISION, LEAST
            )
    return models


def _over_threshold(model: Boosted, kind: str, bits: Column, value: Column) -> Column:
    """(margin, rank) where the margin reaches the model's threshold and the digits allow the kind, else null."""
    allowed = {"card": _checked("card", value), "phone": F.length(_digits(value)).between(_FEWEST, 15)}.get(kind, F.lit(True))
    rank = F.lit(KINDS.index(kind))
    return let(model.margin(bits), lambda m: F.when((m >= model.threshold) & allowed, F.struct(m.alias("m"), rank.alias("rank"))))


def _number_of(spans: str, rank: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["rank"] == rank)).cast("long")


def added_spans(free: Column, generator: str, models: Mapping[tuple[str, str], Boosted]) -> Column:
    """Selected ones of the proposals ``free`` that lie in no other, as (start, rank, end)."""
    kinds = [k for k in GENERATORS[generator][1] if models[generator, k].threshold is not None]

    def chosen(p: Column) -> Column:
        def best(bits: Column) -> Column:
            return F.array_max(F.array(*[_over_threshold(models[generator, k], k, bits, p["value"]) for k in kinds]))["rank"]

        rank = let(_pattern(p["value"], p["before"], p["after"]), best)
        return F.struct(p["start"].alias("start"), rank.alias("rank"), p["end"].alias("end"))

    return outermost(F.filter(F.transform(free, chosen), lambda s: s["rank"].isNotNull()))


def detected(docs: DataFrame, models: Mapping[tuple[str, str], Boosted]) -> DataFrame:
    """``docs`` with ``__base`` and ``__all``: arrays of (start, rank, end), sorted.

    A null or empty text has no spans. Rows are independent of each other.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.array_sort(F.concat(*[ranked(base_spans(text, k), i) for i, k in enumerate(KINDS)]))
    found, more = _once(docs, "__base", base), []
    for generator, (_, kinds) in GENERATORS.items():
        if all(models[generator, k].threshold is None for k in kinds):
            continue
        more.append(f"__{generator}")
        added = added_spans(F.col("__free"), generator, models)
        found = _once(proposed(found, generator, F.col("__base")), more[-1], added).drop("__free")
    return found.withColumn("__all", F.array_sort(F.concat("__base", *more)) if more else F.col("__base")).drop(*more)


def op5(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans per kind, their digest, and all spans of every document."""
    docs = docs.select("doc_id", "text")
    found = detected(docs, train(docs))
    counts = [_number_of("__base", i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select(
        "doc_id", *counts, F.sha2(joined(F.col("__base"), KINDS), 256).alias("base_sha256"), joined(F.col("__all"), KINDS).alias("spans")
    )


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span, base or added, replaced by its kind in brackets; n_chars follows the
    text where that column exists. Texts without a span, null ones included, stay as they are."""
    names = docs.columns
    found = detected(docs, train(docs)).withColumn("__text", F.explode(F.array(masked(F.col("text"), F.col("__all"), KINDS))))
    changed = F.size("__all") > 0
    out = []
    for name in names:
        column = F.col(f"`{name}`")
        if name == "text":
            column = F.col("__text")
        elif name == "n_chars":
            column = F.when(changed, F.char_length("__text")).otherwise(column)
        out.append(column.cast(docs.schema[name].dataType).alias(name))
    return found.select(*out)
