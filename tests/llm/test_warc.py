"""Revisits against a plain search, canonical URLs, and a URL that holds most records."""

import datetime as dt
import random

from pyspark.sql import functions as F

from runlore.llm import warc

SCHEMA = "record_id long, url string, captured_at timestamp, kind string, status int, headers map<string,string>, payload string"


def when(minute):
    return None if minute is None else dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def plain(rows):
    out = []
    for r in rows:
        if r[3] != "revisit":
            continue
        full = [x for x in rows if x[3] == "response" and x[4] == 200 and x[6] is not None and x[1] == r[1] and r[1]
                and x[2] is not None and r[2] is not None and x[2] < r[2]]
        source = max(full, key=lambda x: (x[2], x[0]), default=None)
        own = {k.lower(): v for k, v in sorted((r[5] or {}).items())}
        if source is None:
            state = "missing"
        else:
            theirs = {k.lower(): v for k, v in (source[5] or {}).items()}
            weak = lambda t: t and t.removeprefix("W/")
            if own.get("etag") is not None:
                state = "resolved" if weak(own["etag"]) == weak(theirs.get("etag")) else "mismatch"
            elif own.get("last-modified") is not None:
                state = "resolved" if own["last-modified"] == theirs.get("last-modified") else "mismatch"
            else:
                state = "unverified"
        used = state in ("resolved", "unverified")
        merged = tuple(sorted((theirs | {k: v for k, v in own.items() if k in warc.PERMITTED}).items())) if used else None
        out.append((r[0], state, source[0] if used else None, merged, source[6] if used else None))
    return sorted(out, key=repr)


def got(spark, rows, partitions=8):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    df = warc.resolve(spark.createDataFrame(rows, SCHEMA).withColumn("source", F.lit(1)).withColumn("at", F.lit("x")))
    out = [(r.record_id, r.state, r.source_id, tuple(sorted(r.headers.items())) if r.headers is not None else None, r.payload) for r in df.collect()]
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    return sorted(out, key=repr)


def test_matches_a_plain_search(spark):
    pick = random.Random(7)
    tags = [None, '"a"', 'W/"a"', '"b"']
    rows = []
    for i in range(400):
        again = pick.random() < 0.5
        headers = {"Date": f"d{i}", "Server": "s"}
        if tag := pick.choice(tags):
            headers[pick.choice(["ETag", "etag"])] = tag
        if pick.random() < 0.5:
            headers["Last-Modified"] = pick.choice(["x", "y"])
        # one address holds most records, so it spans several ranges
        url = pick.choice(["http://hot.org/a"] * 6 + [f"http://h{pick.randrange(20)}.org/", None])
        rows.append((i, url, when(pick.choice([None, *range(60)])), "revisit" if again else "response", 304 if again else pick.choice([200, 200, 404]),
                     pick.choice([headers, headers, headers, None]), None if again or pick.random() < 0.1 else f"body {i}"))
    rows += [(900, "http://e.org/", when(1), "response", 200, {}, ""), (901, "http://e.org/", when(2), "revisit", 304, {}, None)] * 2
    assert got(spark, rows) == plain(rows)
    assert got(spark, rows, 40) == plain(rows)
    assert got(spark, rows[:0]) == []


def test_canonical_urls(spark):
    same = ["http://www.Ex.org/a?b=2&a=1", "https://ex.org:443/a?a=1&b=2&utm_source=z#f", "//u:p@EX.org:80/a?a=1&&b=2&ref=q", "HTTP://ex.org/a?b=2&a=1&gclid"]
    other = ["http://ex.org:8080/a?a=1&b=2", "http://ex.org/A?a=1&b=2", "http://ex.org", "http://ex.org/", "not a url", "", None]
    df = spark.createDataFrame([(u,) for u in same + other], "u string").select(warc.canonical(F.col("u")).alias("k"))
    keys = [r.k for r in df.collect()]
    assert set(keys[:4]) == {"ex.org/a?a=1&b=2"}
    assert keys[4:] == ["ex.org:8080/a?a=1&b=2", "ex.org/A?a=1&b=2", "ex.org/", "ex.org/", "not a url", "", None]


def test_query_matches_its_oracle(spark):
    from runlore.llm.common import table
    from tests.check_oracle import connection, difference

    sf = "/root/testdata/sf0.001"
    assert difference(spark, connection(sf), lambda s, d: warc.op1(table(s, d, "pages")), warc.OP1_SQL, sf) is None


def test_every_page_has_a_revisit(spark):
    pages = spark.createDataFrame([(i, f"http://h.org/{i}", f"b{i}") for i in range(50)] + [(None, "http://h.org/x", "b"), (7, None, None)], "page_id long, url string, html string")
    found = warc.op1(pages).collect()
    assert len(found) == 52
    assert sum(r.record_id is None and r.state == "missing" for r in found) == 1
