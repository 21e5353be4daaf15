"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source should be taken target / size times in expectation: a whole part and a
fraction. The fractions are rounded in pairs. A random amount of mass, measured in words, moves from
one document of a pair to the other until one of them is taken or left out; the other goes on to
the next pair. Words only move, so a source takes its target but for the one document that is
left over in the end, and every document keeps its expectation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlore.llm.common import row_id, small, stored
from runlore.llm.spans import let

WEIGHTS = (5, 2, 1)
# All sources together take this share of all words, none more than CAP times its own.
SHARE = 1.5
CAP = 2.0
# Documents, or open documents of the level below, that meet in one node of the reduction tree.
FAN = 48
SEED = 20
_WORD = r"[^\x20\x09-\x0D]+"
_SNAP = 1e-12


def size_of(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def _ranged(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` cut into ranges of ``order``, the number of the range as ``part``."""
    return stored(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))


def _earlier(ranged: DataFrame, **sums: Column) -> DataFrame:
    """For each range the sums over the ranges before it, as ``earlier_...``: a row for each range, so a small table."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per_part = ranged.groupBy("part").agg(*[value.alias(name) for name, value in sums.items()])
    return per_part.select("part", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"earlier_{n}") for n in sums])


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, n (documents with words) and target of each source.

    Sources in code point order, null last, weigh 5, 2, 1, 5, ... Shares above the cap are cut and
    the excess goes to the others by weight until none is above: sources are capped in the order of
    cap / weight, as long as the level that the rest would get lies above. Both orders are cut into
    ranges, and a range adds what the ones before it sum up to, so no task sees all sources.
    """
    per = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("n")
    )
    last = F.col("source").asc_nulls_last()
    named = _ranged(per, last)
    place = F.col("earlier_rows") + F.row_number().over(Window.partitionBy("part").orderBy(last)) - 1
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    weighted = (
        named.join(F.broadcast(_earlier(named, rows=F.count(F.lit(1)))), "part")
        .withColumn("weight", weights[(place % len(WEIGHTS)).cast("int")])
        .withColumn("cap", F.col("source_size") * F.lit(CAP))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .drop("part", "earlier_rows")
    )
    ranged = _ranged(weighted, F.col("ratio"), last)
    within = Window.partitionBy("part").orderBy("ratio", last).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda name: F.col(f"earlier_{name}") + F.coalesce(F.sum(name).over(within), F.lit(0.0))
    every = ranged.agg(F.struct(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).alias("every")).scalar()
    ordered = stored(
        ranged.join(F.broadcast(_earlier(ranged, cap=F.sum("cap"), weight=F.sum("weight"))), "part")
        .withColumn("level", (every["words"] * F.lit(SHARE) - before("cap")) / (every["weight"] - before("weight")))
        .withColumn("capped", F.col("level") * F.col("weight") > F.col("cap"))
        .select("source", "source_size", "n", "weight", "cap", "ratio", "level", "capped")
    )
    first = F.struct("ratio", F.col("source").isNull(), "source")
    shared = ordered.filter(~F.col("capped")).agg(F.min_by("level", first).alias("shared")).scalar()
    return ordered.select(
        "source", "source_size", "n",
        F.when(F.col("capped"), F.col("cap")).otherwise(F.least(F.col("cap"), shared * F.col("weight"))).alias("target"),
    )


def _uniform(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *parts), 11) / F.lit(float(1 << 53))


def _snapped(p: Column) -> Column:
    return F.when(p < _SNAP, 0.0).when(p > 1 - _SNAP, 1.0).otherwise(p)


def _unit_type(id_type: str) -> str:
    return f"struct<size:bigint,h:bigint,id:{id_type},occ:int,p:double>"


def _acc_type(kind: str) -> str:
    return f"struct<open:{kind},done:array<{kind}>>"


def _with(unit: Column, p: Column, kind: str) -> Column:
    return F.struct(*[unit[f].alias(f) for f in ("size", "h", "id", "occ")], p.alias("p")).cast(kind)


def _meet(acc: Column, b: Column, kind: str) -> Column:
    """Let the open document of ``acc`` and ``b`` exchange mass until one is decided."""
    a = acc["open"]

    def moved(m: Column) -> Column:
        up = _uniform(a["h"], b["h"]) < m["down"] / (m["down"] + m["up"])
        pa = F.when(up, F.when(m["a_room"] <= m["b_mass"], 1.0).otherwise((m["a_mass"] + m["up"]) / a["size"])).otherwise(
            F.when(m["a_mass"] <= m["b_room"], 0.0).otherwise((m["a_mass"] - m["down"]) / a["size"])
        )
        pb = F.when(up, F.when(m["b_mass"] <= m["a_room"], 0.0).otherwise((m["b_mass"] - m["up"]) / b["size"])).otherwise(
            F.when(m["b_room"] <= m["a_mass"], 1.0).otherwise((m["b_mass"] + m["down"]) / b["size"])
        )
        return F.struct(_snapped(pa).alias("a"), _snapped(pb).alias("b"))

    def outcome(p: Column) -> Column:
        whole = lambda v: (v == 0.0) | (v == 1.0)
        none = F.array().cast(f"array<{kind}>")
        still = F.when(~whole(p["a"]), _with(a, p["a"], kind)).when(~whole(p["b"]), _with(b, p["b"], kind))
        done = F.concat(
            acc["done"],
            F.when(whole(p["a"]), F.array(_with(a, p["a"], kind))).otherwise(none),
            F.when(whole(p["b"]), F.array(_with(b, p["b"], kind))).otherwise(none),
        )
        return F.struct(still.alias("open"), done.alias("done")).cast(_acc_type(kind))

    masses = F.struct(
        (a["p"] * a["size"]).alias("a_mass"), ((1 - a["p"]) * a["size"]).alias("a_room"),
        (b["p"] * b["size"]).alias("b_mass"), ((1 - b["p"]) * b["size"]).alias("b_room"),
    )
    amounts = let(masses, lambda m: F.struct(
        m["a_mass"].alias("a_mass"), m["a_room"].alias("a_room"), m["b_mass"].alias("b_mass"), m["b_room"].alias("b_room"),
        F.least(m["a_room"], m["b_mass"]).alias("up"), F.least(m["a_mass"], m["b_room"]).alias("down"),
    ))
    first = F.struct(b.alias("open"), acc["done"].alias("done")).cast(_acc_type(kind))
    return F.when(a.isNull(), first).otherwise(let(amounts, lambda m: let(moved(m), outcome)))


def _node(rows: DataFrame) -> DataFrame:
    """Reduce the open units of each (source, node): what is decided, and at most one left open.

    Large documents come first, so that the one left open tends to be small.
    """
    kind = _unit_type(rows.schema["id"].dataType.simpleString())
    unit = F.struct("size", "h", "id", "occ", "p").cast(kind)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("order"), F.col("h"), unit.alias("unit"))))
    zero = F.struct(F.lit(None).cast(kind).alias("open"), F.array().cast(f"array<{kind}>").alias("done")).cast(_acc_type(kind))
    units = F.transform(ordered, lambda x: x["unit"])
    return rows.groupBy("source", "node").agg(F.aggregate(units, zero, lambda acc, b: _meet(acc, b, kind)).alias("acc")).select("source", "node", "acc.*")


def copies(units: DataFrame) -> DataFrame:
    """id, source, size, source_size, target and copies of each row of (id, source, size); ids are of any type.

    Rows are told apart by their values and, where equal, by a running number. Leaves of the tree
    are chosen by a hash and hold about FAN documents of one source, however large the source; each
    further level joins FAN nodes, so a source of n documents takes log n / log FAN levels. All
    randomness comes from hashes of the rows, so reruns agree.
    """
    per = stored(targets(units))
    counted = units.groupBy("id", "source", "size").agg(F.count(F.lit(1)).cast("int").alias("m"))
    each = counted.select("id", "source", "size", F.explode(F.sequence(F.lit(1), F.col("m"))).alias("occ"))
    side = small(per.withColumnRenamed("source", "__source"))
    placed = each.join(side, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    split = stored(
        placed.withColumn("rate", rate)
        .withColumn("whole", F.floor("rate"))
        .withColumn("p", F.when(F.col("size") > 0, _snapped(F.col("rate") - F.col("whole"))).otherwise(F.lit(0.0)))
        .withColumn("h", F.xxhash64(F.lit(SEED), "id", "source", "size", "occ"))
    )
    leaves = F.ceil(F.col("n") / FAN)
    fractional = (F.col("p") > 0) & (F.col("p") < 1)
    level = split.filter(fractional).select(
        "source", F.pmod(F.xxhash64(F.lit("leaf"), "h"), leaves).alias("node"), "size", "h", "id", "occ", "p"
    )
    width = per.agg(F.max(F.ceil(F.col("n") / FAN))).first()[0] or 0
    decided = []
    while True:
        nodes = stored(_node(level))
        decided.append(nodes.select("source", F.explode("done").alias("u")).select("source", "u.*"))
        level = nodes.filter(F.col("open").isNotNull()).select(
            "source", F.floor(F.col("node") / FAN).alias("node"), "open.*"
        )
        if width <= 1:
            break
        width = -(-width // FAN)
    last = level.withColumn("p", F.when(_uniform(F.lit("last"), F.col("h")) < F.col("p"), 1.0).otherwise(0.0))
    decided.append(last.select("source", "size", "h", "id", "occ", "p"))
    drawn = decided[0]
    for more in decided[1:]:
        drawn = drawn.unionByName(more)
    settled = split.filter(~fractional).select("source", "size", "h", "id", "occ", "p").unionByName(drawn)
    again = settled.join(side, F.col("source").eqNullSafe(F.col("__source")))
    return again.select(
        "id", "source", "size", "source_size", "target", (F.floor(rate) + F.col("p")).cast("long").alias("copies")
    )


def op3(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (and copies) of every row of ``docs``.

    Texts that are null or hold no word have size 0 and take nothing. Repeated rows are separate
    documents of the mix.
    """
    units = docs.select(F.col("doc_id").alias("id"), "source", size_of(F.col("text")).alias("size"))
    return copies(stored(units)).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target",
        (F.col("size") * F.col("copies")).alias("taken"), "copies",
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with size, source_size, target, copies and taken.

    A row with copies 0 is not part of the mix. Equal rows come out once, with their copies added up.
    """
    marked = docs.withColumn("__row", row_id(docs))
    units = stored(marked.select(F.col("__row").alias("id"), "source", size_of(F.col("text")).alias("size")))
    per = copies(units).groupBy(F.col("id").alias("__id")).agg(
        *[F.max(c).alias(f"__{c}") for c in ("size", "source_size", "target")], F.sum("copies").alias("__copies")
    )
    found = marked.join(per, F.col("__row") == F.col("__id")).dropDuplicates(["__row"])
    own = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies", "taken")]
    return found.select(
        *[F.col(f"`{c}`") for c in own],
        F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
        F.col("__copies").alias("copies"), (F.col("__size") * F.col("__copies")).alias("taken"),
    )


def mixture(docs: DataFrame) -> DataFrame:
    """The mix itself: each document of ``mixed`` as often as it is taken, numbered by ``copy`` from 1.

    Documents that are not taken have no row, so the words of a source's rows come near its target.
    """
    taken = mixed(docs.drop("copy")).filter(F.col("copies") > 0)
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
