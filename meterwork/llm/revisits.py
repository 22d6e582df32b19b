"""WARC not-modified revisits: each is resolved to the latest earlier full response of its canonical URL.

A capture holds an HTTP header block; a full response has a 2xx status, a revisit is a 304. The as-of join is a
running "last full response" over the captures of a canonical URL in (time, record) order, computed in chunks that
follow the order (``meterwork.operators.ordered``), so a URL with a third of all captures is spread over tasks. The
validators of both sides are then checked: entity tags by weak comparison when both have one, else Last-Modified when
both have one, else payload digests when both have one. A revisit whose validators differ is a conflict: it is not
resolved, nor matched with an older response. A resolved revisit gets the response's headers, updated by those header
fields of the 304 that may change (``PERMITTED``).

Defined results: a revisit without an earlier full response is an orphan, as is one without a URL or time; one that
matches but has no validator in common is "unchecked" and resolved; captures of other statuses and of null blocks are
ignored; equal times are ordered by record id, repeated rows of one record are resolved alike; an empty table gives an
empty one; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterwork.operators.ordered import Running, running
from meterwork.session import stage

#: Header fields that a 304 may update in the stored response.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "set-cookie", "vary")
#: Captures of one URL within so many seconds are ordered in one task.
CHUNK_SECONDS = 3600

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)"


def canonical_url(url: Column) -> Column:
    """Host in lower case without "www." and default port, path without a last slash, query sorted and without utm_ fields; no scheme, no fragment."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, _HOST, 1)), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, _PATH, 1), "/$", "")
    fields = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda x: (x != "") & ~x.startswith("utm_"))
    query = F.array_join(F.array_sort(fields), "&")
    return F.when(~bare.rlike(_HOST), bare).otherwise(F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


def status_of(block: Column) -> Column:
    return F.regexp_extract(block, r"^HTTP/[0-9.]+ ([0-9]{3})", 1).try_cast("int")


def headers_of(block: Column) -> Column:
    """Header fields of a block by lower-cased name; of repeated fields the last counts."""
    lines = F.filter(F.split(block, "\r?\n"), lambda x, i: (i > 0) & x.contains(":"))
    pairs = F.array_sort(F.transform(lines, lambda x, i: F.struct(
        F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), i.alias("i"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v"))))
    # In the order of (name, line) the last of a name is the one whose neighbour has another name.
    marked = F.zip_with(pairs, F.slice(pairs, 2, F.size(pairs)), lambda x, y: F.struct(x["k"].alias("k"), x["v"].alias("v"), x["k"].eqNullSafe(y["k"]).alias("again")))
    last = F.filter(marked, lambda x: ~x["again"])
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["k"], x["v"])))


def _validator(headers: Column, name: str) -> Column:
    value = F.try_element_at(headers, F.lit(name))
    return F.regexp_replace(value, "^W/", "") if name == "etag" else value


def _agree(ours: Column, theirs: Column) -> Column:
    """True or False by the first validator that both have, null if there is none."""
    return F.coalesce(*[
        F.when(a.isNotNull() & b.isNotNull(), a == b)
        for a, b in ((ours["etag"], theirs["etag"]), (ours["modified"], theirs["modified"]), (ours["digest"], theirs["digest"]))
    ])


def resolved(captures: DataFrame, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """``captures(record_id, url, ts, block, digest)``, ts in seconds, one header block each -> one row per revisit.

    (record_id, canonical, target_id, target_ts, outcome, headers): outcome is matched, unchecked, conflict or orphan;
    target and merged headers are set for the first two.
    """
    parsed = captures.select(
        "record_id", canonical_url(F.col("url")).alias("canonical"), F.col("ts").cast("bigint").alias("ts"), F.col("digest"),
        status_of(F.col("block")).alias("status"), headers_of(F.col("block")).alias("headers"))
    full = F.col("status").between(200, 299)
    known = parsed.select(
        "record_id", "canonical", "ts", (F.col("status") == 304).alias("revisit"), "headers",
        F.struct(_validator(F.col("headers"), "etag").alias("etag"), _validator(F.col("headers"), "last-modified").alias("modified"), F.col("digest").alias("digest")).alias("check"),
    ).filter((F.col("status") == 304) | full)
    rows = stage(known, "captures")
    placed = rows.filter("canonical IS NOT NULL AND ts IS NOT NULL")
    value = F.when(~F.col("revisit"), F.struct("record_id", "ts", "headers", "check"))
    joined = running(placed, ["canonical"], [Running("full", "last", value)], [F.floor(F.col("ts") / chunk_seconds)], ["ts", "record_id"]).filter("revisit")
    lost = rows.filter("revisit AND (canonical IS NULL OR ts IS NULL)").withColumn("full", F.lit(None).cast(joined.schema["full"].dataType))
    agree = _agree(F.col("check"), F.col("full.check"))
    outcome = F.when(F.col("full").isNull(), "orphan").when(agree.isNull(), "unchecked").when(agree, "matched").otherwise("conflict")
    fresh = F.map_filter("headers", lambda k, _: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(F.col("full.headers"), lambda k, _: ~F.array_contains(F.map_keys(fresh), k)), fresh)
    told = F.col("outcome").isin("matched", "unchecked")
    return joined.unionByName(lost).withColumn("outcome", outcome).select(
        "record_id", "canonical", F.when(told, F.col("full.record_id")).alias("target_id"), F.when(told, F.col("full.ts")).alias("target_ts"),
        "outcome", F.when(told, merged).alias("headers"))
