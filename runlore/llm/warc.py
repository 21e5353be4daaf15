"""Revisit records resolved to the response they stand for.

A server that answers "not modified" sends no body. Such a record is joined as of its time to the
latest earlier full response of the same canonical URL; the validators must agree, and the headers
that a 304 answer may renew replace those of the response.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlore.llm.common import stored
from runlore.plans.pruning import likely

# Headers that a 304 answer may renew (fixed values).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
# Query parameters that do not name a page.
TRACKING = "^(utm_[a-z]+|ref|sessionid|fbclid|gclid)(=|$)"
_URL = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?//(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?"
_ORDER = ("at", "kind_order", "record_id", "hash")


def canonical(url: Column) -> Column:
    """Key of a URL: host without www, port if unusual, path, sorted query without tracking.

    Scheme, user, fragment and letter case of the host do not count. Other texts are their own key.
    """
    part = lambda i: F.regexp_extract(url, _URL, i)
    host = F.regexp_replace(F.lower(part(2)), r"^www\.", "")
    port = F.when(part(3).isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), part(3)))
    path = F.when(part(4) == "", "/").otherwise(part(4))
    kept = F.filter(F.split(part(5), "&", -1), lambda p: (p != "") & ~F.rlike(p, F.lit(TRACKING)))
    query = F.array_join(F.array_sort(kept), "&")
    whole = F.concat(host, port, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(F.rlike(url, F.lit(_URL)), whole).otherwise(url)


def _header(name: str) -> Column:
    return F.try_element_at("headers", F.lit(name))


def _lowered(headers: Column) -> Column:
    """Header names in lower case; of names that differ in case only, the last in order counts."""
    entries = F.array_sort(F.map_entries(headers))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    last = lambda n: F.element_at(F.filter(entries, lambda e: F.lower(e["key"]) == n), -1)["value"]
    return F.coalesce(F.map_from_arrays(names, F.transform(names, last)), F.create_map().cast("map<string,string>"))


def latest_known(rows: DataFrame, key: str, order: tuple[str, ...], mark: str, name: str) -> DataFrame:
    """Add ``name``: the last non-null ``mark`` of the rows before this one within ``key``.

    The rows are cut into ranges of (key, order), whatever the size of a key, and each range is
    a window of its own. Keys that reach over a range's end, at most one for each end, are carried on
    by a table of one row per key and range, which is therefore bounded by twice the number of ranges.
    """
    ranged = stored(rows.repartitionByRange(key, *order).withColumn("__part", F.spark_partition_id()))
    before = Window.partitionBy("__part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("__local", F.last(mark, ignorenulls=True).over(before))
    cut = (
        ranged.groupBy(F.col(key).alias("__key"))
        .agg(F.min("__part").alias("a"), F.max("__part").alias("b"))
        .filter("a < b")
        .select("__key")
    )
    ends = (
        ranged.join(F.broadcast(cut), F.col(key) == F.col("__key"))
        .groupBy("__key", F.col("__part").alias("__at"))
        .agg(F.max_by(mark, F.when(F.col(mark).isNotNull(), F.struct(*order))).alias("__end"))
    )
    earlier = Window.partitionBy("__key").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.withColumn("__end", F.last("__end", ignorenulls=True).over(earlier))
    met = local.join(F.broadcast(carry), (F.col(key) == F.col("__key")) & (F.col("__part") == F.col("__at")), "left")
    return met.withColumn(name, F.coalesce("__local", "__end")).drop("__part", "__local", "__key", "__at", "__end")


def resolve(records: DataFrame) -> DataFrame:
    """Each revisit of ``records`` with the response it stands for.

    Input: record_id, url, captured_at, kind (response or revisit), status, headers (map), payload.
    Output: record_id, url_key, state, source_id, headers, payload. A full response has kind
    response, status 200, a time and a payload. ``state`` is ``resolved``; ``mismatch`` where a
    validator of the revisit (entity tag, weakly compared, else modification time) differs from the
    response's or is missing there; ``unverified`` where the revisit has none; ``missing`` without an
    earlier response, URL or time. Only resolved and unverified ones get a payload and merged
    headers. Of responses at one instant the one with the largest record_id counts. Each repeated
    revisit row is resolved.
    """
    rows = records.select(
        "record_id",
        canonical(F.col("url")).alias("url_key"),
        F.unix_micros("captured_at").alias("at"),
        (F.col("kind") == "revisit").alias("again"),
        ((F.col("kind") == "response") & (F.col("status") == 200) & F.col("payload").isNotNull()).alias("full"),
        _lowered(F.col("headers")).alias("headers"),
        F.xxhash64("payload").alias("hash"),
    )
    rows = rows.filter(F.col("again") | F.col("full"))
    known = F.col("url_key").isNotNull() & F.col("at").isNotNull()
    mark = F.struct(
        F.col("record_id").alias("id"), F.col("hash").alias("hash"), F.col("headers").alias("headers")
    )
    # a response at the very time of a revisit comes after it
    timeline = rows.filter(known).select(
        "record_id", "url_key", "at", F.when(F.col("full"), 1).otherwise(0).alias("kind_order"), "hash", "headers",
        F.when(F.col("full"), mark).alias("mark"),
    )
    placed = latest_known(timeline, "url_key", _ORDER, "mark", "source").filter("kind_order = 0")
    asked = placed.select("record_id", "url_key", "headers", "source").unionByName(
        rows.filter(F.col("again") & ~known).select(
            "record_id", "url_key", "headers", F.lit(None).cast(placed.schema["source"].dataType).alias("source")
        )
    )
    strong = lambda tag: F.regexp_replace(tag, "^W/", "")
    theirs = lambda name: F.try_element_at(F.col("source.headers"), F.lit(name))
    agrees = F.when(
        _header("etag").isNotNull(), F.coalesce(strong(_header("etag")) == strong(theirs("etag")), F.lit(False))
    ).when(
        _header("last-modified").isNotNull(), F.coalesce(_header("last-modified") == theirs("last-modified"), F.lit(False))
    )
    state = (
        F.when(F.col("source").isNull(), "missing")
        .when(agrees.isNull(), "unverified")
        .when(agrees, "resolved")
        .otherwise("mismatch")
    )
    stated = asked.withColumn("state", state).withColumn("used", F.col("state").isin("resolved", "unverified"))
    renewed = F.map_filter("headers", lambda k, _: k.isin(*PERMITTED))
    kept = F.map_filter("source.headers", lambda k, _: ~F.array_contains(F.map_keys(renewed), k))
    merged = F.when(F.col("used"), F.map_concat(kept, renewed))
    # records without a source have no hash, so they match nothing; their own id spreads them
    own = stored(
        stated.withColumn("__s", F.when(F.col("used"), F.col("source")))
        .withColumn("__to", F.coalesce("__s.id", F.xxhash64("record_id")))
        .withColumn("merged", merged)
        .select("record_id", "url_key", "state", "merged", "__to", F.struct("__s.id", "__s.hash").alias("__s"))
    )
    full = records.filter((F.col("kind") == "response") & (F.col("status") == 200) & F.col("payload").isNotNull())
    asked_for = own.select(F.col("__s.id").alias("__id"), F.col("__s.hash").alias("__hash")).dropna()
    # bodies that no revisit stands for are left where they are read
    bodies = (
        likely(full.select(F.col("record_id").alias("__id"), F.xxhash64("payload").alias("__hash"), "payload"), asked_for, ["__id", "__hash"])
        .groupBy("__id", "__hash")
        .agg(F.min("payload").alias("payload"))
    )
    met = own.join(bodies, (F.col("__to") == F.col("__id")) & (F.col("__s.hash") == F.col("__hash")), "left")
    return met.select(
        "record_id", "url_key", "state", F.col("__s.id").alias("source_id"), F.col("merged").alias("headers"), "payload"
    )


def captures(pages: DataFrame) -> DataFrame:
    """The table ``pages`` seen as crawl records: a response and a revisit of each page.

    The table has neither times nor headers, so they are made from page_id: revisits come up to five
    days after the response, at the same time or before it, ask for another spelling of the URL, and
    a part of them carries another validator or none. Records of a page without an id have no time.
    """
    n = F.col("page_id")
    start = F.timestamp_micros(F.lit(1_704_067_200_000_000) + (n * 7919 % 100_000) * 60_000_000)
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    modified = F.concat(F.lit("day "), (n % 30).cast("string"))
    text = lambda c: c.cast("string")
    dropped = lambda *kv: F.map_filter(F.create_map(*kv), lambda _, v: v.isNotNull())
    response = pages.select(
        (n * 2).alias("record_id"),
        "url",
        start.alias("captured_at"),
        F.lit("response").alias("kind"),
        F.when(n % 17 == 0, 404).otherwise(200).alias("status"),
        dropped(
            F.lit("Content-Type"), F.lit("text/html"),
            F.lit("ETag"), F.when(n % 5 != 0, tag),
            F.lit("Last-Modified"), F.when(n % 3 != 0, modified),
            F.lit("Date"), F.concat(F.lit("t"), text(n)),
            F.lit("Server"), F.lit("s1"),
        ).alias("headers"),
        F.col("html").alias("payload"),
    )
    revisit = pages.select(
        (n * 2 + 1).alias("record_id"),
        F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#again")).alias("url"),
        (start + F.make_dt_interval(days=(n % 7 - 1).cast("int"))).alias("captured_at"),
        F.lit("revisit").alias("kind"),
        F.lit(304).alias("status"),
        dropped(
            F.lit("etag"), F.when(n % 5 != 0, F.when(n % 6 == 0, F.lit('"other"')).when(n % 2 == 0, F.concat(F.lit("W/"), tag)).otherwise(tag)),
            F.lit("last-modified"), F.when(n % 3 != 0, modified),
            F.lit("date"), F.concat(F.lit("r"), text(n)),
            F.lit("server"), F.lit("s2"),
        ).alias("headers"),
        F.lit(None).cast("string").alias("payload"),
    )
    return response.unionByName(revisit)


def op1(pages: DataFrame) -> DataFrame:
    """Every revisit of the captures of ``pages``, resolved; headers as text, the body as length and digest."""
    found = resolve(captures(pages))
    pairs = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return found.select(
        "record_id", "url_key", "state", "source_id",
        F.array_join(pairs, ";").alias("headers"),
        F.char_length("payload").cast("long").alias("body_chars"),
        F.sha2("payload", 256).alias("body_sha256"),
    )


OP1_SQL = r"""
WITH parts AS (
  SELECT page_id AS n, html, url, regexp_extract(url, '^(?:([A-Za-z][A-Za-z0-9+.-]*):)?//(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?',
    ['scheme', 'host', 'port', 'path', 'query']) AS u,
    regexp_matches(url, '^(?:([A-Za-z][A-Za-z0-9+.-]*):)?//') AS ok
  FROM pages),
keyed AS (
  SELECT n, html, CASE WHEN ok THEN regexp_replace(lower(u.host), '^www\.', '')
      || CASE WHEN u.port IN ('', '80', '443') THEN '' ELSE ':' || u.port END
      || CASE WHEN u.path = '' THEN '/' ELSE u.path END
      || CASE WHEN q = '' THEN '' ELSE '?' || q END ELSE url END AS url_key,
    1704067200000000 + (n * 7919 % 100000) * 60000000 AS start, '"' || md5(coalesce(html, '')) || '"' AS tag
  FROM (SELECT *, array_to_string(list_sort(list_filter(string_split(u.query, '&'),
    lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|sessionid|fbclid|gclid)(=|$)'))), '&') AS q FROM parts)),
response AS (
  SELECT n * 2 AS id, url_key, start AS at, html, CASE WHEN n % 5 <> 0 THEN tag END AS etag,
    CASE WHEN n % 3 <> 0 THEN 'day ' || (n % 30) END AS modified, n
  FROM keyed WHERE n % 17 <> 0 AND html IS NOT NULL),
revisit AS (
  SELECT n * 2 + 1 AS id, url_key, start + (n % 7 - 1) * 86400000000 AS at, n,
    CASE WHEN n % 5 <> 0 THEN CASE WHEN n % 6 = 0 THEN '"other"' WHEN n % 2 = 0 THEN 'W/' || tag ELSE tag END END AS etag,
    CASE WHEN n % 3 <> 0 THEN 'day ' || (n % 30) END AS modified, row_number() OVER () AS nth
  FROM keyed),
met AS (
  SELECT v.id, v.url_key, v.etag, v.n, s.id AS sid, s.html, s.etag AS setag, s.modified AS smodified, s.n AS sn,
    CASE WHEN s.id IS NULL THEN 'missing'
      WHEN v.etag IS NOT NULL THEN CASE WHEN regexp_replace(v.etag, '^W/', '') = s.etag THEN 'resolved' ELSE 'mismatch' END
      WHEN v.modified IS NOT NULL THEN CASE WHEN v.modified = s.modified THEN 'resolved' ELSE 'mismatch' END
      ELSE 'unverified' END AS state
  FROM revisit v LEFT JOIN response s ON s.url_key = v.url_key AND s.at < v.at
  QUALIFY row_number() OVER (PARTITION BY v.nth ORDER BY s.at DESC NULLS LAST, s.id DESC) = 1)
SELECT id AS record_id, url_key, state,
  CASE WHEN used THEN sid END AS source_id,
  CASE WHEN used THEN concat_ws(';', 'content-type=text/html', 'date=r' || n, 'etag=' || coalesce(etag, setag),
    'last-modified=' || smodified, 'server=s1') END AS headers,
  CASE WHEN used THEN CAST(length(html) AS BIGINT) END AS body_chars,
  CASE WHEN used THEN sha256(html) END AS body_sha256
FROM (SELECT *, state IN ('resolved', 'unverified') AS used FROM met)
"""
