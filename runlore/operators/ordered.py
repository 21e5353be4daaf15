"""Order-dependent operators that stay balanced when one group is huge.

A window over (repository; time) puts a whole repository into one task. That is fine while every
group fits a task and it is the cheapest plan: one exchange. When a group is larger than
``target_rows`` it is cut into slices along its order, each slice is a window group of its own, and
what the earlier slices contribute (a running sum, a last row) is added from a carry table with one
row per slice of a hot group. Cut points only decide where a group is split, never what is counted,
so the result does not depend on them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlore.session import cut_lineage

# Rows that one task orders. A larger group is cut into slices of about this size.
TARGET_ROWS = 2_000_000
# Sampled order keys per slice, from which cut points are chosen.
POINTS = 20
# Cut points are looked up in a tree whose nodes hold this many, so a row meets few of them.
FANOUT = 16
# Up to this many cut points, slices or hot groups, a few short values each, are broadcast.
BROADCAST_POINTS = 500_000
# Up to this many rows of facts are broadcast to the rows they are joined with.
BROADCAST_FACTS = 100_000

_SALT = "__salt"
_SLICE = "__slice"
_CUTS = "__cuts"
_GROUP = "__group"
_NODE = "__node"
_HOT = "__hot"
_LAST = "__last"


@dataclass(frozen=True)
class Cuts:
    """Cut points of the hot groups: one row per hot group, ``most`` points in a row and ``total`` in all."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    table: DataFrame | None
    most: int = 0
    total: int = 0

    @property
    def any(self) -> bool:
        return self.table is not None


NO_CUTS = Cuts((), (), None)


def _matches(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, [left[x].eqNullSafe(right[y]) for x, y in pairs])


def _target(target_rows: int | None) -> int:
    return TARGET_ROWS if target_rows is None else target_rows


def _sizes(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))


def too_large(rows: int | None, target_rows: int | None = None) -> bool:
    """Whether a group of so many rows is too large for one task."""
    return (rows or 0) > _target(target_rows)


def has_hot_group(df: DataFrame, keys: Sequence[str], target_rows: int | None = None) -> bool:
    """Whether some group is too large for one task. Finer groups are hot only where these are."""
    return too_large(_sizes(df, keys).agg(F.max("__n")).first()[0], target_rows)


def find_cuts(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], target_rows: int | None = None
) -> Cuts:
    """Look for groups above ``target_rows`` and choose cut points inside them.

    Slices keep their size whatever the size of the table: a group of n rows gets n / target_rows of
    them. Cut points are every so many rows of a sample, ranked by a window, so only they are collected
    to one row. A few numbers reach the driver: sizes and counts.
    """
    target = _target(target_rows)
    largest = F.max("__n").alias("largest")
    found = _sizes(df, keys).agg(largest, F.count(F.when(F.col("__n") > target, 1)).alias("groups")).first()
    if (found["largest"] or 0) <= target:
        return NO_CUTS
    hot = (
        _sizes(df, keys)
        .filter(F.col("__n") > target)
        .select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__n")
    )
    pairs = [(k, f"__k{i}") for i, k in enumerate(keys)]
    names = [c for _, c in pairs]
    point = F.struct(*[F.col(o) for o in order])
    group = Window.partitionBy(*names)
    sampled = (
        df.join(_spare(hot, found["groups"]), _matches(df, hot, pairs), "inner")
        .select("__n", *names, point.alias("__point"))
        .sample(fraction=min(1.0, POINTS / target), seed=11)
        .withColumns({"__row": F.row_number().over(group.orderBy("__point")) - 1, "__rows": F.count(F.lit(1)).over(group)})
        .withColumn("__slices", F.ceil(F.col("__n") / target))
    )
    # the i-th cut point is the sampled row i * rows div slices
    ranked = sampled.withColumn("__i", F.expr("(__row * __slices + __rows - 1) div __rows"))
    points = ranked.filter("__i >= 1 AND __i < __slices AND __i * __rows div __slices = __row").select(*names, "__point").distinct()
    per_group = points.groupBy(*names).agg(F.sort_array(F.collect_list("__point")).alias(_CUTS))
    table = cut_lineage(per_group.withColumn(_GROUP, F.monotonically_increasing_id()))
    count = table.agg(F.max(F.size(_CUTS)).alias("most"), F.sum(F.size(_CUTS)).alias("total")).first()
    if count["most"] is None:
        return NO_CUTS
    return Cuts(tuple(keys), tuple(order), table, count["most"], count["total"])


def _spare(small: DataFrame, number: int) -> DataFrame:
    """``small`` marked for a broadcast if it has few rows or points, else left to a shuffle join."""
    return F.broadcast(small) if number <= BROADCAST_POINTS else small


def _resolve(df, keys, order, cuts, target_rows) -> tuple[DataFrame, Cuts]:
    """The rows to go on with and their cuts. Rows that are split are read several times, so they are stored."""
    if cuts is not None:
        return df, cuts
    if not has_hot_group(df, keys, target_rows):
        return df, NO_CUTS
    df = cut_lineage(df)
    return df, find_cuts(df, keys, order, target_rows)


def _nodes(cuts: Cuts, depth: int) -> DataFrame:
    """The nodes of the search tree that are ``depth`` levels above its leaves, FANOUT points in each.

    A leaf holds consecutive cut points of a group, a node above it the first point of each of its children.
    """
    firsts = F.filter(_CUTS, lambda _, i: i % FANOUT**depth == 0)
    each = F.sequence(F.lit(0), F.floor((F.size("__firsts") - 1) / FANOUT).cast("int"))
    parts = F.transform(each, lambda k: F.slice("__firsts", k * FANOUT + 1, F.lit(FANOUT)))
    rows = cuts.table.withColumn("__firsts", firsts)
    return rows.select(
        *[f"__k{i}" for i in range(len(cuts.keys))], _GROUP, F.posexplode(parts).alias(_NODE, "__points")
    ).withColumn(_NODE, F.col(_NODE).cast("long"))


def _sliced(df: DataFrame, cuts: Cuts) -> DataFrame:
    """Add the slice of each row, 0 outside of hot groups, and whether its group is hot."""
    pairs = [(k, f"__k{i}") for i, k in enumerate(cuts.keys)]
    names = [c for _, c in pairs]
    # made once a row, not once a comparison
    df = df.withColumn("__point", F.struct(*[F.col(o) for o in cuts.order]))
    passed = F.size(F.filter("__points", lambda c: c <= F.col("__point"))).cast("long")
    top = 0
    while FANOUT ** (top + 1) < cuts.most:
        top += 1
    root = _nodes(cuts, top)
    rows = df.join(_spare(root, cuts.total // FANOUT**top), _matches(df, root, pairs), "left").drop(*names)
    # rows of other groups have no node; below they are told apart, so that they do not share a join key
    own = F.coalesce(_GROUP, -1 - F.pmod(F.xxhash64(*cuts.order), F.lit(1 << 20)))
    rows = rows.withColumns({_HOT: F.col(_GROUP).isNotNull(), _GROUP: own})
    for depth in range(top, -1, -1):
        if depth < top:
            below = _nodes(cuts, depth).drop(*names)
            rows = rows.join(_spare(below, cuts.total // FANOUT**depth), [_GROUP, _NODE], "left")
        child = F.greatest(passed - 1, F.lit(0)) if depth else passed
        rows = rows.withColumn(_NODE, F.col(_NODE) * FANOUT + child).drop("__points")
    return rows.withColumn(_SLICE, F.coalesce(_NODE, F.lit(0).cast("long"))).drop(_GROUP, _NODE, "__point")


def _spread(sliced: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exchange by slice even if the rows already lie by some of the keys.

    A partitioning by fewer keys would satisfy the window as well, with all slices in one task.
    """
    return sliced.repartition(*keys, _SLICE)


def _with_carry(local: DataFrame, carry: DataFrame, keys: Sequence[str], cuts: Cuts) -> DataFrame:
    """Join the carry table; it has one row per slice of a hot group, so it may be broadcast if these are few."""
    pairs = [(k, f"__c{i}") for i, k in enumerate(keys)] + [(_SLICE, "__cslice")]
    return local.join(_spare(carry, cuts.total), _matches(local, carry, pairs), "left").drop(
        *[c for _, c in pairs]
    )


def _carry_keys(keys: Sequence[str]) -> list[Column]:
    return [F.col(k).alias(f"__c{i}") for i, k in enumerate(keys)] + [
        F.col(_SLICE).alias("__cslice")
    ]


def _carry_window(keys: Sequence[str]):
    return Window.partitionBy(*[f"__c{i}" for i in range(len(keys))]).orderBy("__cslice")


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column],
    *,
    cuts: Cuts | None = None,
    target_rows: int | None = None,
    source: DataFrame | None = None,
) -> DataFrame:
    """Add, per group, the sum of each expression over the rows up to and including this one.

    ``order`` should end in a unique column, otherwise equal rows are counted in any order. ``source`` has the
    same rows with fewer columns, where they are cheaper to read: what whole slices contribute is read there.
    """
    df, cuts = _resolve(df, keys, order, cuts, target_rows)
    if not cuts.any:
        upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({n: F.coalesce(F.sum(e).over(upto), F.lit(0)) for n, e in sums.items()})

    sliced = _spread(_sliced(df, cuts), keys)
    upto = (
        Window.partitionBy(*keys, _SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    local = sliced.withColumns(
        {f"__l_{n}": F.coalesce(F.sum(e).over(upto), F.lit(0)) for n, e in sums.items()}
    )
    per_slice = (
        _sliced(df if source is None else source, cuts)
        .filter(_HOT)
        .groupBy(*keys, _SLICE)
        .agg(*[F.sum(e).alias(f"__s_{n}") for n, e in sums.items()])
        .select(*_carry_keys(keys), *[f"__s_{n}" for n in sums])
    )
    before = _carry_window(keys).rowsBetween(Window.unboundedPreceding, -1)
    carry = per_slice.withColumns(
        {f"__s_{n}": F.sum(F.col(f"__s_{n}")).over(before) for n in sums}
    )
    out = _with_carry(local, carry, keys, cuts)
    return out.withColumns(
        {n: F.col(f"__l_{n}") + F.coalesce(F.col(f"__s_{n}"), F.lit(0)) for n in sums}
    ).drop(_HOT, _SLICE, *[f"__l_{n}" for n in sums], *[f"__s_{n}" for n in sums])


def previous_row(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    name: str,
    *,
    where: Column | None = None,
    cuts: Cuts | None = None,
    target_rows: int | None = None,
) -> DataFrame:
    """Add ``name``: a struct of ``columns`` of the row before this one, null for the first row.

    With ``where`` it is the last row before this one for which the condition holds.
    """
    df, cuts = _resolve(df, keys, order, cuts, target_rows)
    payload = F.struct(*columns) if where is None else F.when(where, F.struct(*columns))
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    if not cuts.any:
        return df.withColumn(name, F.last(payload, ignorenulls=True).over(w))

    sliced = _spread(_sliced(df, cuts), keys)
    w = Window.partitionBy(*keys, _SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = sliced.withColumn(name, F.last(payload, ignorenulls=True).over(w))
    point = F.when(payload.isNotNull(), F.struct(*order))
    # rows of other groups go after the exchange, which is then the one that the window reads
    last = (
        sliced.groupBy(*keys, _SLICE)
        .agg(F.max_by(payload, point).alias(_LAST), F.max(_HOT).alias(_HOT))
        .filter(_HOT)
        .select(*_carry_keys(keys), _LAST)
    )
    earlier = _carry_window(keys).rowsBetween(Window.unboundedPreceding, -1)
    carry = last.withColumn(_LAST, F.last(_LAST, ignorenulls=True).over(earlier))
    return (
        _with_carry(local, carry, keys, cuts)
        # only hot groups have a carry row; asking once more lets both sides have the same columns, so one exchange
        .withColumn(name, F.coalesce(name, F.when(F.col(_HOT), F.col(_LAST))))
        .drop(_HOT, _SLICE, _LAST)
    )


def running_extreme(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    name: str,
    *,
    cuts: Cuts | None = None,
    target_rows: int | None = None,
) -> DataFrame:
    """Add ``name``: the largest ``value`` of the rows before this one in its group, null for the first row."""
    df, cuts = _resolve(df, keys, order, cuts, target_rows)
    if not cuts.any:
        before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(name, F.max(value).over(before))
    sliced = _spread(_sliced(df, cuts), keys)
    before = Window.partitionBy(*keys, _SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = sliced.withColumn(name, F.max(value).over(before))
    most = sliced.filter(_HOT).groupBy(*keys, _SLICE).agg(F.max(value).alias(_LAST)).select(*_carry_keys(keys), _LAST)
    carry = most.withColumn(_LAST, F.max(_LAST).over(_carry_window(keys).rowsBetween(Window.unboundedPreceding, -1)))
    return _with_carry(local, carry, keys, cuts).withColumn(name, F.greatest(name, _LAST)).drop(_HOT, _SLICE, _LAST)


def join_facts(
    rows: DataFrame,
    facts: DataFrame,
    keys: Sequence[str],
    by: str,
    spread: bool,
    how: str = "inner",
    source: DataFrame | None = None,
) -> DataFrame:
    """Join rows with one row of facts per key.

    With ``spread`` a key with more than TARGET_ROWS rows is dealt out by ``by`` over as many salts as
    it has slices, and only its facts are repeated so often. Fewer keys than total rows /
    TARGET_ROWS are that large, so their list may be broadcast. ``source`` has about as many rows of
    each key and is cheaper to read: the keys' sizes are taken there.
    """
    if not spread:
        return rows.join(facts, list(keys), how)
    names = [f"__h{i}" for i in range(len(keys))]
    hot = (
        _sizes(rows if source is None else source, keys)
        .filter(F.col("__n") > TARGET_ROWS)
        .select(*[F.col(k).alias(h) for k, h in zip(keys, names)], F.ceil(F.col("__n") / TARGET_ROWS).alias("__salts"))
    )
    same = lambda df: reduce(lambda a, b: a & b, [df[k] == hot[h] for k, h in zip(keys, names)])
    salts = F.coalesce("__salts", F.lit(1).cast("long"))
    repeated = facts.join(F.broadcast(hot), same(facts), "left").withColumn(
        _SALT, F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))
    )
    dealt = rows.join(F.broadcast(hot), same(rows), "left").withColumn(_SALT, F.pmod(F.xxhash64(by), salts))
    return dealt.drop("__salts", *names).join(repeated.drop("__salts", *names), [*keys, _SALT], how).drop(_SALT)


def join_few(
    rows: DataFrame,
    facts: DataFrame,
    keys: Sequence[str],
    by: str,
    spread: bool,
    how: str = "inner",
    source: DataFrame | None = None,
) -> DataFrame:
    """``join_facts`` for facts that are few as a rule, such as those of repositories or workflows.

    They are stored, and if they are few they are broadcast: the rows stay where they are, and the sizes of their
    keys are not counted, which would make the rows once more.
    """
    stored = cut_lineage(facts)
    if stored.limit(BROADCAST_FACTS + 1).count() <= BROADCAST_FACTS:
        return rows.join(F.broadcast(stored), list(keys), how)
    return join_facts(rows, stored, keys, by, spread, how, source)


def asof_sums(
    events: DataFrame,
    measures: Mapping[str, Column],
    probes: DataFrame,
    points: Mapping[str, tuple[Column, bool]],
    *,
    levels: Mapping[str, Sequence[str]],
    ids: Sequence[str],
    at: str,
    cuts: Cuts | None = None,
    target_rows: int | None = None,
) -> DataFrame:
    """Running totals of one table, read at the points in time of another.

    ``levels`` names the groupings that are totalled, ``points`` the times at which a probe reads
    them: a tag, the time in microseconds, and whether events at that very time count. The result
    has one row per probe: its ``ids`` and a ``<tag>_<level>_<measure>`` column per combination.

    Events and probes share one sorted pass per level. Every frame starts at the beginning of its
    group, so a row costs the same however many rows lie before it; a sliding range frame would
    walk its whole window again for each row. There is no range join and thus no pair blow-up.
    """
    keys = list(dict.fromkeys(k for group in levels.values() for k in group))
    # an id that is a key too is read from the key, so that it travels once
    id_types = {c: probes.schema[c].dataType for c in ids if c not in keys}
    event_rows = events.select(
        *keys,
        F.col(at).cast("long").alias("__at"),
        F.lit(1).alias("__kind"),
        F.xxhash64(*events.columns).alias("__tie"),
        F.lit(None).cast("string").alias("__tag"),
        *[e.cast("long").alias(f"__m_{m}") for m, e in measures.items()],
        *[F.lit(None).cast(kind).alias(f"__id_{c}") for c, kind in id_types.items()],
    )
    # at one instant: 0 = probe that leaves the instant out, 1 = event, 2 = probe that counts it
    moments = [
        F.struct(
            F.lit(tag).alias("__tag"),
            when.cast("long").alias("__at"),
            F.lit(2 if closed else 0).alias("__kind"),
        )
        for tag, (when, closed) in points.items()
    ]
    point_rows = probes.select(
        *keys,
        *[F.col(c).alias(f"__id_{c}") for c in id_types],
        F.xxhash64(*ids).alias("__tie"),
        F.explode(F.array(*moments)).alias("__p"),
    ).select(
        *keys,
        "__p.__at",
        "__p.__kind",
        "__tie",
        "__p.__tag",
        *[F.lit(0).cast("long").alias(f"__m_{m}") for m in measures],
        *[f"__id_{c}" for c in id_types],
    )
    summed = event_rows.unionByName(point_rows)
    order = ["__at", "__kind", "__tie"]
    timeline, calm = summed, []
    for level, group in levels.items():
        # a finer grouping has no hot group where a coarser one has none
        known = NO_CUTS if any(set(c) <= set(group) for c in calm) else cuts
        if known is None:
            known = NO_CUTS
            if has_hot_group(timeline, group, target_rows):
                if summed is timeline:
                    summed = timeline = cut_lineage(timeline)
                known = find_cuts(timeline, group, order, target_rows)
        if not known.any:
            calm.append(group)
        sums = {f"__r_{level}_{m}": F.col(f"__m_{m}") for m in measures}
        summed = running_sums(summed, group, order, sums, cuts=known, source=timeline)
    read = {
        f"{tag}_{level}_{m}": F.max(F.when(F.col("__tag") == tag, F.col(f"__r_{level}_{m}")))
        for tag in points
        for level in levels
        for m in measures
    }
    return (
        summed.filter(F.col("__tag").isNotNull())
        .groupBy(*[F.col(f"__id_{c}").alias(c) if c in id_types else F.col(c) for c in ids])
        .agg(*[e.alias(n) for n, e in read.items()])
    )


def trailing_sums(
    df: DataFrame,
    measures: Mapping[str, Column],
    spans: Mapping[str, int],
    *,
    levels: Mapping[str, Sequence[str]],
    ids: Sequence[str],
    at: str,
    whole: str | None = None,
    cuts: Cuts | None = None,
    target_rows: int | None = None,
) -> DataFrame:
    """Per row, sums over the rows of its groups in [at - span, at], both ends included.

    The result has the ``ids``, which must identify a row, and ``<span>_<level>_<measure>`` columns;
    with ``whole``, also ``<whole>_<level>_<measure>`` over the entire group. Rows without a time are
    counted by ``whole`` only and are missing from the result.
    """
    points = {"hi": (F.col(at), True)} | {t: (F.col(at) - span, False) for t, span in spans.items()}
    if whole:
        points[whole] = (F.lit(2**62), True)
    sums = asof_sums(
        df, measures, df.filter(F.col(at).isNotNull()), points,
        levels=levels, ids=ids, at=at, cuts=cuts, target_rows=target_rows,
    )
    names = [f"{level}_{m}" for level in levels for m in measures]
    frames = [(F.col(f"hi_{n}") - F.col(f"{t}_{n}")).alias(f"{t}_{n}") for t in spans for n in names]
    totals = [F.col(f"{whole}_{n}") for n in names] if whole else []
    return sums.select(*ids, *frames, *totals)
