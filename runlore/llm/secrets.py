"""Secrets in texts: a trigram inverted index proposes documents for each rule, regexes verify them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlore.llm.common import ascii_lower, small, stored
from runlore.llm.spans import find_all, joined, masked, ranked
from runlore.llm.trigrams import trigram_query


@dataclass(frozen=True)
class Rule:
    """``pattern`` is the rule as written, ``search`` an equivalent form that Java runs in linear time.

    A match counts if group ``group`` of it has at least ``least`` characters.
    """

    kind: str
    pattern: str
    search: str
    group: int = 0
    least: int = 0


_KEYS = "(?i:password|passwd|secret|token|api_?key)"
RULES = (
    Rule(
        "assign",
        _KEYS + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        _KEYS + r"""["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)""",
        1,
        8,
    ),
    Rule("access", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]++", 0, 16),
    # runs are maximal, so a shorter one has no match of 32 inside
    Rule("hex", "[0-9a-f]+", "(?<![0-9a-f])[0-9a-f]{32,}+", 0, 32),
    Rule("key_block", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "-----BEGIN [A-Z ]*+(?<=PRIVATE KEY)-----"),
    Rule("forge", "gh[pousr]_[A-Za-z0-9]{36,}", "gh[pousr]_[A-Za-z0-9]{36,}+"),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]{10,}", "xox[abprs]-[A-Za-z0-9-]{10,}+"),
    Rule("payment", "[rs]k_live_[0-9A-Za-z]{16,}", "[rs]k_live_[0-9A-Za-z]{16,}+"),
)
BASE = ("assign", "access", "hex")


def trigram_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, key) of rows of (key, text), for the trigrams that some query names."""
    low = ascii_lower(F.col("text"))
    named = F.array(*[F.lit(t) for t in trigrams])
    rows = docs.select("key", F.explode(F.array(low)).alias("low"))
    flags = [F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]
    found = F.filter(F.array(*flags), lambda t: t.isNotNull()) if flags else F.slice(named, 1, 0)
    return rows.select("key", F.explode(found).alias("trigram")).select("trigram", "key")


def _terms(queries: dict[int, list]) -> list[tuple[int, int, int, str, int, int]]:
    """(rule, clause, alternative, trigram, trigrams of the alternative, clauses of the rule)."""
    return [
        (rule, c, a, t, len(alternative), len(query))
        for rule, query in queries.items()
        for c, clause in enumerate(query)
        for a, alternative in enumerate(clause)
        for t in sorted(alternative)
    ]


def candidates(index: DataFrame, queries: dict[int, list]) -> DataFrame:
    """key and ``rules``, a bit set of the rules whose trigram query holds for the document.

    Postings of an alternative are intersected by counting them per document.
    """
    terms = index.sparkSession.createDataFrame(
        _terms(queries), "rule int, clause int, alternative int, trigram string, need int, clauses int"
    )
    # one row per trigram of a rule
    met = index.distinct().join(F.broadcast(terms), "trigram")
    held = (
        met.groupBy("key", "rule", "clause", "alternative", "need", "clauses")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n = need")
        .groupBy("key", "rule", "clauses")
        .agg(F.count_distinct("clause").alias("m"))
        .filter("m = clauses")
    )
    return held.groupBy("key").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("rules"))


def _matches(rule: Rule, text: Column) -> Column:
    value = lambda m: F.regexp_extract(m["value"], rule.search, rule.group) if rule.group else m["value"]
    found = find_all(text, rule.search)
    return F.filter(found, lambda m: F.length(value(m)) >= rule.least) if rule.least else found


def detected(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Each row of ``docs`` as ``row``, with ``spans``: sorted (start, rule, end) structs.

    Rules whose regex has no mandatory trigram scan every text. For the others only documents that
    the index proposes are searched. Rows are told apart by a hash of id and text, which only decides
    what is searched. Null and empty texts have no spans.
    """
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.xxhash64("doc_id", "text").alias("key"),
    )
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern))}
    trigrams = sorted({t for q in queries.values() for clause in q for alternative in clause for t in alternative})
    marked = rows.withColumn("rules", F.lit(0).cast("long"))
    if queries:
        index = stored(trigram_index(rows.select("key", "text"), trigrams))
        marked = rows.join(small(candidates(index, queries)), "key", "left")
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    parts = []
    for i, rule in enumerate(rules):
        found = ranked(_matches(rule, F.col("text")), i)
        if i in queries:
            proposed = F.getbit(F.coalesce("rules", F.lit(0).cast("long")), F.lit(i)) == 1
            found = F.when(proposed, found).otherwise(none)
        parts.append(found)
    return marked.select("row", "text", F.explode(F.array(F.array_sort(F.concat(*parts)))).alias("spans"))


def _number_of(rank: int) -> Column:
    return F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")


def op6(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans per kind, their digest, and all spans of every document."""
    kinds = tuple(r.kind for r in RULES)
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return detected(docs.select("doc_id", "text")).select(
        "row.doc_id",
        *[_number_of(i).alias(f"n_{k}") for i, k in enumerate(BASE)],
        F.sha2(joined(base, kinds), 256).alias("base_sha256"),
        joined(F.col("spans"), kinds).alias("spans"),
    )


def masked_texts(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(row, text) with every secret replaced by its kind in brackets."""
    kinds = tuple(r.kind for r in rules)
    return detected(docs, rules).select("row", masked(F.col("text"), F.col("spans"), kinds).alias("text"))
