import random

from pyspark.sql import functions as F

from meterwork.llm.revisits import PERMITTED, canonical_url, headers_of, resolved, status_of

SCHEMA = "record_id bigint, url string, ts bigint, block string, digest string, headers string, full string"


def block(status, **fields):
    return f"HTTP/1.1 {status} X\r\n" + "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in fields.items()) + "\r\n"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def test_urls_and_blocks(spark):
    urls = {"HTTPS://WWW.Example.com:443/a/b/?b=2&utm_x=1&a=1#f": "example.com/a/b?a=1&b=2", "http://example.com:80": "example.com", "http://example.com/": "example.com",
            "http://example.com:8080/A": "example.com:8080/A", "no url": "no url", "": ""}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r[0]: r[1] for r in df.select("u", canonical_url(F.col("u"))).collect()} == urls
    one = spark.createDataFrame([("HTTP/1.1 304 Not\nETag: W/\"a:b\"\r\nX-Y:  1 \r\netag: c\r\nbroken\r\n\r\n",), ("",), (None,)], "b string")
    got = one.select(status_of(F.col("b")), headers_of(F.col("b"))).collect()
    assert tuple(got[0]) == (304, {"x-y": "1", "etag": "c"}) and tuple(got[1]) == (None, {}) and tuple(got[2]) == (None, None)


def test_fields_behind_many_lines(spark):
    many = "".join(f"X-{i % 10_500}: {i}\r\n" for i in range(12_000))
    df = spark.createDataFrame([(f"HTTP/1.1 200 OK\r\nETag: a\r\n{many}ETag: b\r\nLast-Modified: m\r\n\r\n",)], "b string")
    got = df.select(headers_of(F.col("b"))).first()[0]
    assert got == {f"x-{i % 10_500}": str(i) for i in range(12_000)} | {"etag": "b", "last-modified": "m"}


def test_each_outcome(spark):
    rows = [
        (1, "http://a.x/p", 100, block(200, ETag='"1"', Content_Type="text/html", Cache_Control="old", Date="d1"), "h1"),
        (2, "https://www.a.x/p#q", 200, block(304, ETag='W/"1"', Cache_Control="new", Content_Type="no", Connection="close"), None),
        (3, "http://a.x/p", 300, block(304, ETag='"2"'), "h1"),
        (4, "http://a.x/p", 400, block(304), "h1"),
        (5, "http://a.x/p", 500, block(304), None),
        (6, "http://a.x/p", 50, block(304, ETag='"1"'), "h1"),
        (7, None, 600, block(304), "h1"), (8, "http://a.x/p", None, block(304), "h1"),
        (9, "http://a.x/p", 700, block(404, ETag='"9"'), "h9"), (10, "http://a.x/p", 800, block(304, Last_Modified="m"), "zz"), (11, "http://a.x/p", 900, None, None),
    ]
    got = {r["record_id"]: r for r in resolved(table(spark, rows), chunk_seconds=150).collect()}
    assert {k: r["outcome"] for k, r in got.items()} == {2: "matched", 3: "conflict", 4: "matched", 5: "unchecked", 6: "orphan", 7: "orphan", 8: "orphan", 10: "conflict"}
    assert got[2]["headers"] == {"etag": 'W/"1"', "content-type": "text/html", "cache-control": "new", "date": "d1"} and got[2]["target_id"] == 1
    assert got[3]["target_id"] is None and got[3]["headers"] is None and "content-type" not in PERMITTED


def test_joins_equal_brute_force_with_ties_and_repeats(spark):
    rng = random.Random(6)
    rows = [(i, f"http://h{rng.choice([0, 0, 0, 1, 2])}.x/", rng.randrange(40), block(rng.choice([200, 304]), ETag=f'"{rng.randrange(3)}"'), None) for i in range(300)]
    rows += rows[:5]
    want = {}
    for i, url, ts, b, _ in rows:
        if " 304 " in b:
            before = [(t, j, c) for j, u, t, c, _ in rows if u == url and " 200 " in c and (t, j) < (ts, i)]
            last = max(before)[1:] if before else None
            tag = b.split('"')[1]
            want[i] = ("orphan", None) if last is None else ("matched", last[0]) if last[1].split('"')[1] == tag else ("conflict", None)
    for chunk in (1, 7, 3600):
        got = resolved(table(spark, rows), chunk_seconds=chunk).collect()
        assert {r["record_id"]: (r["outcome"], r["target_id"]) for r in got} == want
        assert len(got) == sum(" 304 " in r[3] for r in rows)
    assert resolved(table(spark, rows).limit(0)).count() == 0
