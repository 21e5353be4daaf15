"""Benchmark decontamination: a positional inverted index of the documents, searched for item windows.

The index is built for the terms a search reads. A first pass counts every term of the benchmark
vocabulary over all documents. Each window of an item is then looked up by its two rarest terms:
their postings (term, document, position) are stored, shifted by the terms' offsets and
intersected, and what is left is compared with the document word by word. Where the shifted lists
come near each other without meeting, the document holds the item in proximity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlore.llm.common import ascii_lower, small, stored
from runlore.plans.pruning import likely, only, without

WINDOW = 13
# A document is contaminated if at least one in so many of its words is hit.
SHARE = 20
# In a proximity match two terms stand up to so many words nearer or farther apart than in the item.
SLOP = 4
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cased words of a text; null has none."""
    found = F.array_remove(F.split(ascii_lower(text), _BREAK), "")
    return F.coalesce(found, F.array().cast("array<string>"))


def item_words(benchmark: DataFrame) -> DataFrame:
    """key, words and item_ids (sorted as text) of each distinct item. Rows without an id or a word are none."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("id"), words_of(F.col("text")).alias("words"))
    return (
        rows.filter(F.col("id").isNotNull() & (F.size("words") > 0))
        .groupBy("words")
        .agg(F.array_sort(F.collect_set("id")).alias("item_ids"))
        .withColumn("key", F.sha2(F.array_join("words", " "), 256))
    )


def term_counts(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """How often each term of ``vocabulary`` (column term, distinct) occurs in all documents.

    Other terms are left out in the scan, and the rest is added up there before it is exchanged.
    """
    terms = docs.select(F.explode(words_of(F.col("text"))).alias("term"))
    counted = likely(terms, vocabulary, ["term"]).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return only(counted, vocabulary, ["term"])


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, keys, pos) of every occurrence of ``terms`` in rows of (keys, text), and of a few other terms if they are many."""
    keys = _keys(docs, "text")
    places = docs.select(*keys, F.posexplode(words_of(F.col("text"))).alias("pos", "term"))
    return likely(places, terms, ["term"]).select("term", *keys, "pos")


def _keys(df: DataFrame, *others: str) -> list[str]:
    """The columns that say which document a row of ``df`` belongs to."""
    return [c for c in df.columns if c not in others]


def segments(items: DataFrame, counts: DataFrame, window: int = WINDOW) -> DataFrame:
    """Neighbouring windows that share the two rarest of the terms that documents have, as one stretch of words each.

    ``at1`` and ``at2`` are the places of the two terms in ``words``, ``size`` the window's length.
    All windows of a stretch hold both places. Windows with a term that no document has occur nowhere as
    they are: their stretches are not ``exact`` and serve proximity only. Equal stretches of several
    items are one row with all their ids.
    """
    places = items.select("key", F.posexplode("words").alias("j", "term"))
    known = places.join(small(counts), "term", "left").groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("j", F.coalesce("n", F.lit(0)).alias("n")))).alias("terms")
    )
    size = F.least(F.size("words"), F.lit(window))
    windows = (
        items.join(known, "key")
        .withColumn("size", size)
        .withColumn("s", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("size"))))
    )
    held = windows.withColumn("t", F.slice("terms", F.col("s") + 1, F.col("size")))
    occurring = F.transform(F.filter("t", lambda t: t["n"] > 0), lambda t: F.struct(t["n"].alias("n"), t["j"].alias("j")))
    exact = F.forall("t", lambda t: t["n"] > 0)
    ranked = held.select("key", "s", "size", exact.alias("exact"), F.slice(F.array_sort(occurring), 1, 2).alias("r"))
    spans = ranked.filter(F.size("r") > 0).groupBy(
        "key", "size", "exact", F.col("r")[0]["j"].alias("j1"), F.try_element_at("r", F.lit(2))["j"].alias("j2")
    ).agg(F.min("s").alias("first"), F.max("s").alias("last"))
    cut = items.join(spans, "key").select(
        F.slice("words", F.col("first") + 1, F.col("last") - F.col("first") + F.col("size")).alias("words"),
        "size",
        "exact",
        (F.col("j1") - F.col("first")).alias("at1"),
        (F.col("j2") - F.col("first")).alias("at2"),
        "item_ids",
    )
    return (
        cut.groupBy("words", "size", "exact", "at1", "at2")
        .agg(F.array_distinct(F.flatten(F.collect_list("item_ids"))).alias("item_ids"))
        .withColumn("segment", F.xxhash64(F.array_join("words", " "), "size", "exact", "at1", "at2"))
    )


def anchors(stretches: DataFrame) -> DataFrame:
    """The one or two terms by which each stretch is looked up: term, segment, at, bit, need."""
    one = F.struct(F.col("at1").alias("at"), F.lit(1).alias("bit"))
    two = F.struct(F.col("at2").alias("at"), F.lit(2).alias("bit"))
    both = F.when(F.col("at2").isNull(), F.array(one)).otherwise(F.array(one, two))
    need = F.when(F.col("at2").isNull(), 1).otherwise(3).alias("need")
    return stretches.select("segment", "words", need, F.explode(both).alias("a")).select(
        F.element_at("words", F.col("a")["at"] + 1).alias("term"), "segment", "a.at", "a.bit", "need"
    )


def candidates(index: DataFrame, ends: DataFrame) -> DataFrame:
    """(keys, segment, start) where the lists of both rarest terms, shifted by their offsets, meet."""
    keys = _keys(index, "term", "pos")
    return (
        index.join(small(ends), "term")
        .groupBy(*keys, "segment", (F.col("pos") - F.col("at")).alias("start"), "need")
        .agg(F.bit_or("bit").alias("bits"))
        .filter(F.col("bits") == F.col("need"))
        .select(*keys, "segment", "start")
    )


def proximity(index: DataFrame, ends: DataFrame, slop: int = SLOP) -> DataFrame:
    """(keys, segment, start, gap): the two rarest terms of a stretch stand in a document as in the
    item, but up to ``slop`` words nearer or farther apart; gap 0 is their exact distance.

    One row per place of the first term, with the smallest gap. Lists meet by stripes of slop + 1
    positions, so a place is compared with at most three stripes, never with a whole list. One word is
    not both terms.
    """
    keys = _keys(index, "term", "pos")
    placed = index.join(small(ends.filter("need = 3")), "term").withColumn("start", F.col("pos") - F.col("at"))
    stripe = F.floor(F.col("start") / (slop + 1))
    first = placed.filter("bit = 1").select(
        *keys, "segment", "start", stripe.alias("stripe"), F.struct("term", "pos").alias("word")
    )
    second = placed.filter("bit = 2").select(
        *keys, "segment", F.col("start").alias("other"), F.struct("term", "pos").alias("second"),
        F.explode(F.array(stripe - 1, stripe, stripe + 1)).alias("stripe"),
    )
    gap = F.abs(F.col("start") - F.col("other"))
    return (
        first.join(second, [*keys, "segment", "stripe"])
        .filter((gap <= slop) & (F.col("word") != F.col("second")))
        .groupBy(*keys, "segment", "start")
        .agg(F.min(gap).alias("gap"))
    )


def near_items(index: DataFrame, stretches: DataFrame, slop: int = SLOP) -> DataFrame:
    """(keys, near_ids): the items that a document holds in proximity or exactly, sorted as text. Items of one word have no proximity."""
    keys = _keys(index, "term", "pos")
    met = proximity(index, anchors(stretches), slop).select(*keys, "segment").distinct()
    ids = F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids"))))
    return met.join(small(stretches.select("segment", "item_ids")), "segment").groupBy(*keys).agg(ids.alias("near_ids"))


def _match(words: Column, c: Column) -> Column:
    """The hit stretch of one candidate as (from, to, item_ids), null if no whole window agrees."""
    low = F.greatest(c["start"], F.lit(0))
    high = F.least(c["start"] + F.size(c["words"]), F.size(words))
    length = F.greatest(high - low, F.lit(0))
    same = F.zip_with(
        F.slice(words, low + 1, length),
        F.slice(c["words"], low - c["start"] + 1, length),
        lambda x, y: F.when(x == y, "1").otherwise("0"),
    )
    marks = F.array_join(same, "")
    # both terms lie in every window, so at most one run of agreeing words is long enough
    at = F.instr(marks, F.repeat(F.lit("1"), c["size"]))
    run = F.length(F.regexp_extract(F.substring(marks, at, F.length(marks)), "^1+", 0))
    return F.when(
        (length > 0) & (at > 0),
        F.struct((low + at - 1).alias("from"), (low + at - 1 + run).alias("to"), c["item_ids"].alias("item_ids")),
    )


_KEY = ["key", "key2"]


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with 128 bits of id and text as ``key``, by which postings and candidates go, and ``key2``."""
    return docs.withColumns({"key": F.xxhash64("doc_id", "text"), "key2": F.xxhash64(F.lit("second"), "doc_id", "text")})


def _indexed(docs: DataFrame, benchmark: DataFrame, window: int, near: bool) -> tuple[DataFrame, DataFrame]:
    """Stretches of the items, only exact ones unless ``near``, and the postings of their two rarest terms."""
    items = stored(item_words(benchmark))
    vocabulary = items.select(F.explode("words").alias("term")).distinct()
    counts = stored(term_counts(docs, vocabulary))
    found = segments(items, counts, window)
    stretches = stored(found if near else found.filter("exact"))
    rows = _keyed(docs.select("doc_id", "text")).select(*_KEY, "text")
    return stretches, stored(postings(rows, anchors(stretches).select("term").distinct()))


def hits(docs: DataFrame, stretches: DataFrame, index: DataFrame) -> DataFrame:
    """key, key2, n_words, n_hit and item_ids of the documents (doc_id, text) with a hit, each once.

    A word is hit inside any occurrence of a window. Only documents in which the two rarest terms of some
    window stand at their places are compared word by word, and only their texts are exchanged: which
    they are is tested in the scan.
    """
    rows = _keyed(docs.select("doc_id", "text")).select(*_KEY, "text")
    exact = stretches.filter("exact")
    body = exact.select("segment", "words", "size", "item_ids")
    by_document = stored(
        candidates(index, anchors(exact))
        .join(small(body), "segment")
        .groupBy(*_KEY)
        .agg(F.collect_list(F.struct("start", "words", "size", "item_ids")).alias("candidates"))
    )
    # explode of one element: the words are computed once, not once for each candidate
    met = likely(rows, by_document, _KEY).dropDuplicates(_KEY).join(by_document, _KEY).select(
        *_KEY, "candidates", F.explode(F.array(words_of(F.col("text")))).alias("words")
    )
    matches = F.array_sort(
        F.filter(F.transform("candidates", lambda c: _match(F.col("words"), c)), lambda m: m.isNotNull())
    )
    compared = met.select(*_KEY, F.size("words").cast("long").alias("n_words"), F.explode(F.array(matches)).alias("matches"))
    covered = F.aggregate(
        "matches",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, m: F.struct(
            F.greatest(acc["end"], m["to"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), m["to"] - F.greatest(acc["end"], m["from"]))).alias("n"),
        ),
    )["n"]
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform("matches", lambda m: m["item_ids"]))))
    return compared.filter(F.size("matches") > 0).select(*_KEY, "n_words", covered.cast("long").alias("n_hit"), ids.alias("item_ids"))


def _contaminated() -> Column:
    return (F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words"))


def marked(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids, near_ids and contaminated of each row of ``docs``.

    Repeated rows give the same result each; null and empty texts have no words and are not
    contaminated. ``near_ids`` are the items in proximity, which decide nothing. Words are counted in the
    scan, so no text is exchanged for it.
    """
    stretches, index = _indexed(docs, benchmark, window, near=True)
    found = hits(docs, stretches, index).select(*_KEY, "n_hit", "item_ids").join(near_items(index, stretches), _KEY, "full")
    rows = _keyed(docs.select("doc_id", "text")).select("doc_id", *_KEY, F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    return (
        rows.join(found, _KEY, "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
            F.coalesce("near_ids", F.array().cast("array<string>")).alias("near_ids"),
        )
        .withColumn("contaminated", _contaminated())
    )


def op10(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near and near_sha256 of every document."""
    return marked(docs.select("doc_id", "text"), benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
        F.size("near_ids").cast("long").alias("n_near"),
        F.sha2(F.array_join("near_ids", ","), 256).alias("near_sha256"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns.

    Rows that a filter over the contaminated ones does not hold are kept where they are read; the few it
    holds are joined.
    """
    stretches, index = _indexed(docs, benchmark, WINDOW, near=False)
    bad = stored(hits(docs, stretches, index).filter(_contaminated()).select(F.col("key").alias("__key"), F.col("key2").alias("__key2")))
    names = ["__key", "__key2"]
    rows = docs.withColumns({"__key": F.xxhash64("doc_id", "text"), "__key2": F.xxhash64(F.lit("second"), "doc_id", "text")})
    return without(rows, bad, names).select(*[F.col(f"`{c}`") for c in docs.columns])


OP10_SQL = r"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS r,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, row_number() OVER () AS i,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size,
    array_to_string(w[s + 1 : s + least(len(w), 13)], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(len(w) - least(len(w), 13) + 1)) AS s FROM items WHERE len(w) > 0)),
places AS (
  SELECT r, w, size, unnest(range(len(w) - size + 1)) AS p
  FROM words, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size),
found AS (
  SELECT r, p, places.size, item_id
  FROM (SELECT r, p, size, array_to_string(w[p + 1 : p + size], ' ') AS phrase FROM places) AS places
  JOIN windows ON windows.size = places.size AND windows.phrase = places.phrase),
hit AS (
  SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + size)) AS q FROM found) GROUP BY r),
ids AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS joined
  FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY r),
counts AS (SELECT term, count(*) AS n FROM (SELECT unnest(w) AS term FROM words) GROUP BY term),
inside AS (
  SELECT i, item_id, s, s + k AS j, w[s + k + 1] AS term
  FROM (SELECT i, item_id, w, s, unnest(range(least(len(w), 13))) AS k
    FROM (SELECT i, item_id, w, unnest(range(len(w) - least(len(w), 13) + 1)) AS s FROM items WHERE len(w) > 0))),
rarest AS (
  SELECT i, item_id, s, j, term, row_number() OVER (PARTITION BY i, s ORDER BY n, j) AS place
  FROM inside JOIN counts USING (term)),
pairs AS (
  SELECT DISTINCT a.item_id, a.term AS term1, b.term AS term2, b.j - a.j AS apart
  FROM rarest AS a JOIN rarest AS b ON a.i = b.i AND a.s = b.s WHERE a.place = 1 AND b.place = 2),
posted AS (
  SELECT r, p, w[p + 1] AS term FROM (SELECT r, w, unnest(range(len(w))) AS p FROM words)
  WHERE w[p + 1] IN (SELECT term1 FROM pairs UNION ALL SELECT term2 FROM pairs)),
near AS (
  SELECT r, count(*) AS n_near, string_agg(item_id, ',' ORDER BY item_id) AS near
  FROM (SELECT DISTINCT a.r, item_id
    FROM pairs JOIN posted AS a ON a.term = term1
    JOIN posted AS b ON b.r = a.r AND b.term = term2 AND b.p <> a.p AND abs(b.p - a.p - apart) <= 4)
  GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(joined, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
  CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, sha256(coalesce(near, '')) AS near_sha256
FROM words LEFT JOIN hit USING (r) LEFT JOIN ids USING (r) LEFT JOIN near USING (r)
"""
