"""The prefix trie of conversations.

A turn's id is a 128-bit number in big-endian bytes, so a conversation is a byte string of fixed-width
ids, and conversations with common first turns are neighbours when these are sorted. The sorted
strings are cut into ranges, however many of them begin alike, and each range gives an adaptive radix
tree. Only byte depths at which a turn ends are nodes of the trie.

Two things reach over a range. Nodes on the path to its first and last string may go on in its
neighbours. And long conversations are cut into blocks of ``BLOCK`` turns, each a string of the trie
below the turns before it, so that no string is long. Those nodes, with the points where their paths
meet, are the skeleton: a small tree whose parts are merged by name and whose subtree sums are taken by
pointer doubling. Every other node is complete in its range, but for what hangs below one skeleton node.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlore.llm import art
from runlore.llm.common import BROADCAST_ROWS, stored
from runlore.llm.streams import groups
from runlore.operators.ordered import find_cuts, join_facts, running_sums

WIDTH = 16
BLOCK = 128
# Conversations and turns that one task arranges in a tree, about.
RANGE = 200_000
# The conversation that gives the first turns, and the number of turns it may give.
STEP = 20
SHARED = 4
_WORD = r"[^\x20\x09-\x0D]+"
_LANES = tuple(f"s{i}" for i in range(4))
_NOTHING = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, id and words of each row; rows without a conv_id belong to no conversation.

    Role and text are read once, here; null ones are empty.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.unhex(F.substring(F.sha2(whole, 256), 1, 2 * WIDTH)).alias("id"),
        F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words"),
    )


def rebuilt(conversations: DataFrame, step: int = STEP, shared: int = SHARED, target_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The turns (conv_id, total, d, id, words) of the rebuilt conversations, d from 1, and (conv_id, total) of each.

    The first h turns of a conversation are those of conversation conv_id - conv_id mod ``step``, as
    far as there are any; h is crc32 of its id as text modulo ``shared``. Turns with one number are
    ordered by their ids; repeated rows are separate turns. Hot conversations are numbered in slices.
    """
    turns = turns_of(conversations)
    cuts = find_cuts(turns, ["conv_id"], ["turn", "id"], target_rows)
    placed = stored(running_sums(turns, ["conv_id"], ["turn", "id"], {"pos": F.lit(1)}, cuts=cuts))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(shared)).cast("int")
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(step))
    heads = (
        placed.filter((F.pmod("conv_id", F.lit(step)) == 0) & (F.col("pos") < shared))
        .groupBy(F.col("conv_id").alias("base"))
        .agg(F.array_sort(F.collect_list(F.struct("pos", "id", "words"))).alias("head"))
    )
    whole = placed.groupBy("conv_id").agg(F.max("pos").alias("n")).withColumns({"h": h, "base": base})
    head = F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("h"))
    facts = stored(
        whole.join(heads, "base", "left")
        .withColumn("head", head)
        .withColumn("total", F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
        .select("conv_id", "h", "head", "total")
    )
    places = facts.select("conv_id", (F.size("head") - F.col("h")).alias("shift"), "total")
    own = join_facts(placed.filter(F.col("pos") > h), places, ["conv_id"], "pos", spread=cuts.any)
    first = facts.select("conv_id", "total", F.explode("head").alias("t"))
    steps = own.select("conv_id", "total", (F.col("pos") + F.col("shift")).alias("d"), "id", "words").unionByName(
        first.select("conv_id", "total", F.col("t.pos").alias("d"), "t.id", "t.words")
    )
    return steps, facts.select("conv_id", "total")


def _name(sums: list[Column]) -> Column:
    return F.unhex(F.concat(*[F.lpad(F.hex(F.pmod(s, F.lit(1 << 32))), 8, "0") for s in sums]))


def _blocks(steps: DataFrame, every: DataFrame, size: int, target_rows: int | None) -> DataFrame:
    """One row per block of a conversation: conv_id, block, key, words, ends, context, name.

    ``context`` names the turns before the block, ``name`` those up to its end. A name is a sum of hashes of
    blocks with their numbers, which running sums give without going through a conversation in order.
    """
    turn = F.struct("d", "id", "words")
    gathered = steps.groupBy("conv_id", F.floor((F.col("d") - 1) / size).alias("block")).agg(
        F.max("total").alias("total"), F.array_sort(F.collect_list(turn)).alias("turns")
    )
    key = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["id"])), ""))
    full = gathered.select("conv_id", "block", "total", key.alias("key"), F.transform("turns", lambda t: t["words"]).alias("words"))
    empty = every.filter("total = 0").select(
        "conv_id", F.lit(0).cast("long").alias("block"), "total", F.lit(b"").alias("key"), F.array().cast("array<bigint>").alias("words")
    )
    digest = F.sha2(F.concat(F.col("block").cast("string"), F.lit(":"), F.hex("key")), 256)
    lane = lambda i: F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")
    lanes = {s: F.when(F.col("total") == 0, F.lit(0).cast("long")).otherwise(lane(i)) for i, s in enumerate(_LANES)}
    blocks = stored(full.unionByName(empty).withColumns(lanes))
    ends = F.col("block") == F.greatest(F.ceil(F.col("total") / size) - 1, F.lit(0))
    own = [F.col(s) for s in _LANES]
    zero = [F.lit(0).cast("long")] * len(_LANES)
    columns = ["conv_id", "block", "key", "words", ends.alias("ends")]
    short = blocks.filter(F.col("total") <= size).select(*columns, _name(zero).alias("context"), _name(own).alias("name"))
    long = blocks.filter(F.col("total") > size)
    narrow = running_sums(
        long.select("conv_id", "block", *_LANES), ["conv_id"], ["block"], {f"to_{s}": F.col(s) for s in _LANES}, target_rows=target_rows
    )
    upto = [F.col(f"to_{s}") for s in _LANES]
    named = narrow.select("conv_id", "block", _name([u - o for u, o in zip(upto, own)]).alias("context"), _name(upto).alias("name"))
    return stored(short.unionByName(long.select(*columns).join(named, ["conv_id", "block"])))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined ids of each name; rows come sorted and only the digest is held."""
    name, digest = None, None
    for batch in batches:
        names, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        done, at = [], 0
        while at < len(names):
            end = at
            while end < len(names) and names[end] == names[at]:
                end += 1
            part = ",".join(map(str, ids[at:end])).encode()
            if names[at] == name:
                digest.update(b"," + part)
            else:
                if name is not None:
                    done.append((name, digest.hexdigest()))
                name, digest = names[at], hashlib.sha256(part)
            at = end
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done])], names=["name", "digest"])
    if name is not None:
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([digest.hexdigest()])], names=["name", "digest"])


def _items(blocks: DataFrame) -> DataFrame:
    """Distinct blocks: context, key, block, words, name, n, first_id, n_end and the digest of those that end here.

    The ids of conversations that are copies of each other pass one task as a sorted stream, because a
    digest takes them in order; a conversation without a copy needs no exchange.
    """
    one = F.when(F.col("ends"), F.col("conv_id"))
    items = stored(
        blocks.groupBy("name").agg(
            *[F.first(c).alias(c) for c in ("context", "key", "block", "words")],
            F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first_id"), F.count(one).alias("n_end"), F.min(one).alias("one"),
        )
    )
    several = items.filter("n_end > 1").select("name")
    ended = blocks.filter("ends").select("name", "conv_id").join(several, "name", "left_semi")
    digests = ended.repartition("name").sortWithinPartitions("name", "conv_id").mapInArrow(_digests, "name binary, digest string")
    digest = F.when(F.col("n_end") == 1, F.sha2(F.col("one").cast("string"), 256)).otherwise(F.col("digest"))
    plain = items.filter("n_end <= 1").withColumn("digest", F.lit(None).cast("string"))
    return stored(plain.unionByName(items.filter("n_end > 1").join(digests, "name", "left")).withColumn("ends", digest).drop("digest", "one"))


# --- one range ------------------------------------------------------------------------------------

_NODES = pa.schema(
    [
        ("name", pa.binary()), ("up", pa.binary()), ("below", pa.binary()), ("edge", pa.bool_()), ("conv_id", pa.int64()),
        ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("parent", pa.binary()), ("n", pa.int64()), ("children", pa.int64()),
        ("leaves", pa.int64()), ("saved", pa.int64()), ("words", pa.int64()), ("ends", pa.string()),
    ]
)
_NODES_SQL = (
    "name binary, up binary, below binary, edge boolean, conv_id long, depth long, parent_conv_id long, parent binary, "
    "n long, children long, leaves long, saved long, words long, ends string"
)


class _Range:
    """The trie nodes of the items of one context in one range, in pre-order."""

    def __init__(self, group: dict, first: bool, last: bool, size: int):
        self.keys, self.group, self.size = group["key"], group, size
        flat, lengths = group["words"]
        ends = [0]
        for length in lengths.tolist():
            ends.append(ends[-1] + length)
        self.words_of = lambda item, j: int(flat[ends[item] + j - 1])
        self.rims = [self.keys[k] for k, open_ in ((0, first), (-1, last)) if open_]
        self.parent, self.depth, self.sample, self.item, self.edge = [-1], [0], [0], [-1], [False]
        self._walk(art.build(self.keys))

    def _walk(self, root: art.Node) -> None:
        on_rim = [tuple(range(len(self.rims)))]
        stack = [(root, 0, 0)]
        while stack:
            node, at, here = stack.pop()
            end = at + len(node.path)
            for j in range(at // WIDTH + 1, end // WIDTH + 1):
                key = self.keys[node.sample]
                rims = tuple(r for r in on_rim[here] if self.rims[r][: j * WIDTH] == key[: j * WIDTH])
                self.parent.append(here)
                self.depth.append(j)
                self.sample.append(node.sample)
                self.item.append(-1)
                self.edge.append(bool(rims))
                on_rim.append(rims)
                here = len(self.parent) - 1
            if node.item >= 0:
                self.item[here] = node.item
            stack += [(child, end, here) for child in node.children()]

    def rows(self) -> pa.RecordBatch:
        group, parent, depth, edge = self.group, self.parent, self.depth, self.edge
        count = len(parent)
        context, block = group["context"][0], int(group["block"][0])
        n, conv = [0] * count, [None] * count
        children, offspring = [0] * count, [0] * count
        leaves, saved, words = [0] * count, [0] * count, [0] * count
        skeleton, below, branches = [False] * count, [-1] * count, [0] * count
        for t in range(count - 1, -1, -1):
            item = self.item[t]
            goes_on = False
            if item >= 0:
                n[t] += int(group["n"][item])
                own = int(group["first_id"][item])
                conv[t] = own if conv[t] is None else min(conv[t], own)
                goes_on = int(group["n"][item]) > int(group["n_end"][item])
            if t:
                words[t] = self.words_of(self.sample[t], depth[t])
            if t == 0 or edge[t] or goes_on or branches[t] > 1:
                skeleton[t], below[t] = True, t
            else:
                leaves[t] += offspring[t] == 0
                saved[t] += (n[t] - 1) * words[t]
            if t == 0:
                break
            up = parent[t]
            n[up] += n[t]
            conv[up] = conv[t] if conv[up] is None else min(conv[up], conv[t])
            offspring[up] += 1
            children[up] += not edge[t]
            if below[t] >= 0:
                branches[up] += 1
                below[up] = below[t]
            if not skeleton[t]:
                leaves[up] += leaves[t]
                saved[up] += saved[t]
        names: list = [None] * count
        for t in range(count):
            if not skeleton[t]:
                continue
            if t == 0:
                names[t] = context
            elif depth[t] == self.size:
                names[t] = group["name"][self.item[t]]
            else:
                prefix = self.keys[self.sample[t]][: depth[t] * WIDTH]
                names[t] = hashlib.blake2b(context + prefix, digest_size=WIDTH).digest()
        up = [-1] * count
        for t in range(1, count):
            up[t] = parent[t] if skeleton[parent[t]] else up[parent[t]]
        # membership of the root and of edges is only known when ranges are merged
        part = [t == 0 or edge[t] for t in range(count)]
        if block:
            n[0], conv[0] = 0, None
        columns = {
            "name": names,
            "up": [names[up[t]] if t and skeleton[t] else None for t in range(count)],
            "below": [names[below[t]] if not skeleton[t] and below[t] >= 0 else None for t in range(count)],
            "edge": edge,
            "conv_id": conv,
            "depth": [block * self.size + j for j in depth],
            "parent_conv_id": [None if t == 0 or part[parent[t]] else conv[parent[t]] for t in range(count)],
            "parent": [names[parent[t]] if t and part[parent[t]] else None for t in range(count)],
            "n": n,
            "children": children,
            "leaves": leaves,
            "saved": saved,
            "words": words,
            "ends": [group["ends"][i] if i >= 0 else None for i in self.item],
        }
        return pa.RecordBatch.from_pydict(columns, schema=_NODES)


def _nodes(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, first = None, True
        for group in groups(batches, ["context"]):
            if before is not None:
                yield _Range(before, first, False, size).rows()
                first = False
            before = group
        if before is not None:
            yield _Range(before, first, True, size).rows()

    return run


# --- merging --------------------------------------------------------------------------------------


def _skeleton(nodes: DataFrame) -> DataFrame:
    """Skeleton nodes, one row each, with the sums of their whole subtrees.

    Pointer doubling: each node knows the sums of its descendants less than 2^k steps below and points
    2^k steps up; a round adds what points to it, so the depth of the skeleton takes its logarithm in rounds.
    """
    merged = stored(
        nodes.filter("name is not null")
        .groupBy("name")
        .agg(
            *[F.max(c).alias(c) for c in ("up", "edge", "depth", "parent_conv_id", "parent", "words", "ends")],
            F.min("conv_id").alias("conv_id"),
            *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")],
        )
    )
    across = merged.filter("edge").groupBy(F.col("up").alias("name")).agg(F.count(F.lit(1)).alias("across"))
    whole = stored(
        merged.join(across, "name", "left")
        .withColumn("children", F.col("children") + F.coalesce("across", F.lit(0)))
        .withColumn("leaves", F.col("leaves") + (F.col("children") == 0).cast("long"))
        .withColumn("saved", F.col("saved") + (F.col("n") - 1) * F.col("words"))
        .drop("across")
    )
    sums = whole.select("name", F.col("up").alias("to"), "leaves", "saved")
    while not sums.filter("to is not null").isEmpty():
        gained = sums.filter("to is not null").groupBy(F.col("to").alias("name")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        hop = sums.select(F.col("name").alias("to"), F.col("to").alias("next"))
        moving = sums.filter("to is not null").join(hop, "to", "left").select("name", F.col("next").alias("to"), "leaves", "saved")
        sums = stored(
            sums.filter("to is null").unionByName(moving).join(gained, "name", "left").select(
                "name", "to", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")
            )
        )
    return stored(whole.drop("leaves", "saved").join(sums.drop("to"), "name"))


def _looked_up(rows: DataFrame, key: str, facts: DataFrame, few: bool) -> DataFrame:
    """Left join by a key that most rows lack and that one value may dominate."""
    facts = facts.withColumnRenamed("name", key)
    some = rows.filter(F.col(key).isNotNull())
    joined = some.join(F.broadcast(facts), key, "left") if few else join_facts(some, facts, [key], "conv_id", True, "left")
    none = rows.filter(F.col(key).isNull())
    for field in facts.schema.fields:
        if field.name != key:
            none = none.withColumn(field.name, F.lit(None).cast(field.dataType))
    return joined.unionByName(none)


def trie(steps: DataFrame, every: DataFrame, size: int = BLOCK, per_range: int = RANGE, target_rows: int | None = None) -> DataFrame:
    """The nodes of the trie of conversations given by ``steps`` (conv_id, total, d, id, words) and ``every`` (conv_id, total).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    Without conversations there is no node, not even a root.
    """
    cores = steps.sparkSession.sparkContext.defaultParallelism
    items = _items(_blocks(steps, every, size, target_rows))
    work = items.agg(F.sum(F.size("words") + 1)).first()[0] or 0
    ranges = max(1, math.ceil(work / per_range), min(2 * cores, math.ceil(work / 5_000)))
    sorted_ = items.repartitionByRange(ranges, "context", "key").sortWithinPartitions("context", "key")
    nodes = stored(sorted_.mapInArrow(_nodes(size), _NODES_SQL))
    skeleton = _skeleton(nodes)
    few = skeleton.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    parents = skeleton.select("name", F.col("conv_id").alias("owner"))
    rest = skeleton.select("name", F.col("leaves").alias("l"), F.col("saved").alias("s"))
    inner = _looked_up(nodes.filter("name is null").drop("name", "up", "edge", "words"), "below", rest, few)
    shown = ["conv_id", "depth", "parent_conv_id", "parent", "n", "children", "leaves", "saved", "ends"]
    zero = F.lit(0).cast("long")
    added = {"leaves": F.col("leaves") + F.coalesce("l", zero), "saved": F.col("saved") + F.coalesce("s", zero)}
    found = inner.withColumns(added).select(*shown).unionByName(skeleton.select(*shown))
    return _looked_up(found, "parent", parents, few).select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "owner").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(_NOTHING)).alias("ends_sha256"),
    )


def op11(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations, one row per node."""
    return trie(*rebuilt(conversations.select("conv_id", "turn", "role", "text")))


OP11_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
        lambda u, z: CASE WHEN u & 1 = 1 THEN xor(u >> 1, 3988292384::BIGINT) ELSE u >> 1 END)), 4294967295::BIGINT) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
steps AS (
  SELECT ids.conv_id, pos, role, text FROM ids JOIN t ON t.conv_id = ids.base AND pos <= h
  UNION ALL SELECT ids.conv_id, pos, role, text FROM ids JOIN t ON t.conv_id = ids.conv_id AND pos > h),
paths AS (
  SELECT ids.conv_id, coalesce(list(sha256(concat(len(role), ':', role, text)) ORDER BY pos) FILTER (pos IS NOT NULL), []) AS p,
    coalesce(list(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) ORDER BY pos) FILTER (pos IS NOT NULL), []) AS w
  FROM ids LEFT JOIN steps USING (conv_id) GROUP BY ids.conv_id),
prefixes AS (
  SELECT conv_id, d, p[1 : d] AS p, CASE WHEN d > 0 THEN w[d] ELSE 0 END AS w, d = len(p) AS ends
  FROM (SELECT conv_id, p, w, unnest(range(len(p) + 1)) AS d FROM paths)),
nodes AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n, (count(*) - 1) * any_value(w) AS saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM prefixes GROUP BY p, d),
kids AS (SELECT p[1 : d - 1] AS p, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
whole AS (
  SELECT p[1 : k] AS p, k AS d, count(*) FILTER (n_kids IS NULL) AS leaves, sum(saved) AS saved
  FROM (SELECT nodes.p, nodes.saved, kids.n AS n_kids, unnest(range(nodes.d + 1)) AS k FROM nodes LEFT JOIN kids USING (p, d))
  GROUP BY ALL)
SELECT nodes.conv_id, nodes.d AS depth, up.conv_id AS parent_conv_id, nodes.n AS n_convs, coalesce(kids.n, 0) AS n_children,
  whole.leaves AS n_leaves, CAST(whole.saved AS BIGINT) AS saved_tokens, nodes.ends_sha256
FROM nodes JOIN whole USING (p, d) LEFT JOIN kids USING (p, d) LEFT JOIN nodes AS up ON up.p = nodes.p[1 : nodes.d - 1] AND up.d = nodes.d - 1
"""
