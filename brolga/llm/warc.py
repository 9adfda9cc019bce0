"""Not-modified revisits of WARC crawls: each is resolved to the latest earlier full response of its canonical URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brolga.llm.common import materialize, table

#: The header fields that a 304 answer may renew (RFC 9110, section 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Seconds of one URL's captures that one group holds, and captures beyond which such a group is cut into shorter times.
BUCKET = 86_400
MOST = 100_000


def canonical_url(url: Column) -> Column:
    """Host and path without scheme, fragment, closing slashes, utm_ parameters and the scheme's default port (80 for http,
    443 for https; any other port stays); parameters sorted.

    The host is put in lower case. What has no scheme is taken as it is, without fragment. A null stays null.
    """
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.regexp_extract(F.lower(bare), "^([a-z][a-z0-9+.-]*://[^/?]*)", 1)
    host = F.regexp_replace(F.regexp_replace(host, "^(http://.*):80$|^(https://.*):443$", "$1$2"), "^[a-z][a-z0-9+.-]*://", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), "/+$", "")
    query = F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&")
    query = F.array_sort(F.filter(query, lambda p: (p != "") & ~p.startswith("utm_")))
    whole = F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))
    return F.when(bare.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), whole).otherwise(bare)


def _lower_names(headers: Column) -> Column:
    """Header names in lower case; of several that differ in case only, the first one counts."""
    names = F.array_distinct(F.transform(F.map_keys(headers), F.lower))
    values = F.transform(names, lambda n: F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == n)[0]["value"])
    return F.coalesce(F.map_from_arrays(names, values), F.create_map().cast("map<string,string>"))


def _plain(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def _cuts(captures: DataFrame, most: int) -> DataFrame:
    """(url_key, bucket, ts, start) for the seconds of buckets with more than `most` captures: the first second of their part.

    Both steps are written to the shared folder, so that the size of what is joined is known. A bucket has no more rows in
    the running sum than it has seconds.
    """
    key = ["url_key", "bucket"]
    full = materialize(captures.groupBy(*key).count().where(F.col("count") > most).select(*key))
    seconds = captures.join(full, key, "left_semi").groupBy(*key, "ts").agg(F.count("*").alias("n"))
    past = F.sum("n").over(W.partitionBy(*key).orderBy("ts").rowsBetween(W.unboundedPreceding, W.currentRow))
    parts = seconds.withColumn("part", F.floor((past - 1) / most))
    return materialize(parts.select(*key, "ts", F.min("ts").over(W.partitionBy(*key, "part")).alias("start")))


def resolve_revisits(records: DataFrame, permitted: tuple[str, ...] = PERMITTED, bucket: int = BUCKET, most: int = MOST) -> DataFrame:
    """One row for each revisit of records (record_id, url, ts in seconds, kind, headers, payload_sha256, payload_length).

    kind is 'response' for full responses and 'revisit' for not-modified ones; other kinds are left out. Returns
    record_id, url_key, resolution, source_id, headers and the payload's digest and length. The source is the response of
    the same canonical URL that is latest before the revisit by (ts, record_id). resolution is
      no_response  there is none, or the revisit has no url or no ts: nothing else is filled in;
      changed      a validator that both have differs (ETag, compared weakly, else Last-Modified): only source_id;
      unverified   they share no validator: only source_id;
      resolved     headers are the source's, with the permitted ones of the revisit put over them, and the payload is the
                   source's.
    Header names come out in lower case. Repeated revisits give repeated rows; of repeated responses any is the same.

    Only ids, headers and digests travel, never payloads. A URL's captures are grouped by time buckets, and what the
    buckets before hand on is one row for each, so a URL with a third of all captures is spread like the others. A bucket
    of more than `most` captures is cut at seconds so that each part holds about `most`; only a single second is never cut.
    """
    response = F.col("kind") == "response"
    known = F.col("url_key").isNotNull() & F.col("ts").isNotNull()
    rows = records.where(F.col("kind").isin("response", "revisit")).select(
        "record_id",
        canonical_url(F.col("url")).alias("url_key"),
        F.col("ts").cast("long").alias("ts"),
        "kind",
        _lower_names(F.col("headers")).alias("headers"),
        "payload_sha256",
        F.col("payload_length").cast("long").alias("payload_length"),
    )
    whole = F.when(response, F.struct("record_id", "headers", "payload_sha256", "payload_length"))
    rows = rows.select("*", F.floor(F.col("ts") / bucket).alias("bucket"), whole.alias("own"))
    rows = rows.join(_cuts(rows.where(known).select("url_key", "bucket", "ts"), most), ["url_key", "bucket", "ts"], "left")
    rows = rows.withColumn("bucket", F.coalesce("start", F.col("bucket") * bucket)).drop("start")
    lone = rows.where(~known & ~response).withColumn("source", F.lit(None).cast(rows.schema["own"].dataType))
    rows = rows.where(known)
    before = W.partitionBy("url_key", "bucket").orderBy("ts", "record_id").rowsBetween(W.unboundedPreceding, -1)
    here = rows.withColumn("source", F.last("own", ignorenulls=True).over(before)).where(~response)
    last = rows.where(response).groupBy("url_key", "bucket").agg(F.max(F.struct("ts", "record_id")).alias("at"))
    last = last.select("url_key", "bucket", F.col("at.ts").alias("ts"), F.col("at.record_id").alias("record_id"))
    asked = here.where(F.col("source").isNull()).select("url_key", "bucket").distinct()
    steps = last.unionByName(asked.select("url_key", "bucket", F.lit(None).cast("long").alias("ts"), F.lit(None).cast("long").alias("record_id")))
    steps = steps.groupBy("url_key", "bucket").agg(F.max(F.when(F.col("ts").isNotNull(), F.struct("ts", "record_id"))).alias("at"))
    past = W.partitionBy("url_key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    steps = steps.select("url_key", "bucket", F.last("at", ignorenulls=True).over(past).alias("at")).where("at is not null")
    carried = steps.select("url_key", "bucket", F.col("at.ts").alias("ts"), F.col("at.record_id").alias("record_id"))
    sources = rows.where(response).groupBy("url_key", "ts", "record_id").agg(F.first("own").alias("earlier"))
    carried = carried.join(sources, ["url_key", "ts", "record_id"]).select("url_key", "bucket", "earlier")
    here = here.join(carried, ["url_key", "bucket"], "left").withColumn("source", F.coalesce("source", "earlier")).drop("earlier")
    found = here.unionByName(lone.select(here.columns))

    mine, theirs = F.col("headers"), F.col("source.headers")
    tags = mine["etag"].isNotNull() & theirs["etag"].isNotNull()
    dates = mine["last-modified"].isNotNull() & theirs["last-modified"].isNotNull()
    resolution = (
        F.when(F.col("source").isNull(), "no_response")
        .when(tags, F.when(_plain(mine["etag"]) == _plain(theirs["etag"]), "resolved").otherwise("changed"))
        .when(dates, F.when(mine["last-modified"] == theirs["last-modified"], "resolved").otherwise("changed"))
        .otherwise("unverified")
    )
    renewed = F.map_filter(mine, lambda k, v: k.isin(*permitted) & v.isNotNull())
    merged = F.map_concat(F.map_filter(theirs, lambda k, _: ~F.map_contains_key(renewed, k)), renewed)
    done = F.col("resolution") == "resolved"
    return found.withColumn("resolution", resolution).select(
        "record_id",
        "url_key",
        "resolution",
        F.col("source.record_id").alias("source_id"),
        F.when(done, merged).alias("headers"),
        F.when(done, F.col("source.payload_sha256")).alias("payload_sha256"),
        F.when(done, F.col("source.payload_length")).alias("payload_length"),
    )


def crawl(pages: DataFrame) -> DataFrame:
    """Four captures of each page, a day apart: a response (for every seventh page a revisit that comes too early), then revisits.

    Their validators agree, but for the third capture of every fifth page; the fourth has a date only, or nothing.
    """
    v, page = F.col("v"), F.col("page_id")
    tag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 16), F.lit('"'))
    day = F.concat(F.lit("day "), (page % 365).cast("string"))
    rows = pages.select("page_id", "url", tag.alias("tag"), F.sha2("html", 256).alias("payload_sha256"), F.length("html").cast("long").alias("payload_length"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("v"))
    full = (v == 0) & (page % 7 != 0)
    headers = F.when(
        full,
        F.create_map(
            *[F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.col("payload_length").cast("string")],
            *[F.lit("ETag"), F.col("tag"), F.lit("Last-Modified"), day, F.lit("Date"), F.lit("0")],
        ),
    ).otherwise(
        F.create_map(
            *[F.lit("Content-Length"), F.lit("0"), F.lit("Date"), v.cast("string")],
            *[F.lit("Cache-Control"), F.concat(F.lit("max-age="), (page % 100).cast("string"))],
            *[F.lit("etag"), F.when(v < 3, F.when((v == 2) & (page % 5 == 0), '"other"').otherwise(F.concat(F.lit("W/"), F.col("tag"))))],
            *[F.lit("last-modified"), F.when((v == 3) & (page % 3 == 0), day)],
        )
    )
    return rows.select(
        (page * 4 + v).alias("record_id"),
        "url",
        (1_700_000_000 + (page % 997) * 60 + v * 86_400).alias("ts"),
        F.when(full, "response").otherwise("revisit").alias("kind"),
        headers.alias("headers"),
        "payload_sha256",
        "payload_length",
    )


def op1_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_revisits(crawl(table(spark, sf_dir, "pages")))
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("")))))
    return found.select(
        "record_id", "url_key", "resolution", "source_id", F.array_join(lines, "\n").alias("headers"), "payload_sha256", "payload_length"
    )


OP1_SQL = r"""
with p as (select page_id, url, '"' || substr(md5(html), 1, 16) || '"' as tag, sha256(html) as sha, cast(length(html) as bigint) as len,
                  'day ' || (page_id % 365) as day, regexp_replace(trim(url), '#.*$', '') as b from pages),
k as (select *, regexp_replace(lower(regexp_extract(b, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)),
                               case lower(regexp_extract(b, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) when 'http' then ':80$' when 'https' then ':443$' else '^$' end, '')
             || regexp_replace(regexp_extract(b, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/+$', '') as hp,
             list_sort(list_filter(string_split(regexp_extract(b, '\?(.*)$', 1), '&'), lambda x: x <> '' and not starts_with(x, 'utm_'))) as q from p),
c as (select *, case when regexp_matches(b, '^[A-Za-z][A-Za-z0-9+.-]*://') then hp || case when len(q) > 0 then '?' || array_to_string(q, '&') else '' end else b end as url_key,
             unnest([0, 1, 2, 3]) as v from k),
r as (select page_id * 4 + v as record_id, url_key, 1700000000 + (page_id % 997) * 60 + v * 86400 as ts, v = 0 and page_id % 7 <> 0 as full_one, sha, len, day, tag, page_id, v,
             case when v = 0 and page_id % 7 <> 0 then tag when v < 3 then case when v = 2 and page_id % 5 = 0 then '"other"' else tag end end as e,
             case when (v = 0 and page_id % 7 <> 0) or (v = 3 and page_id % 3 = 0) then day end as m from c),
s as (select *, last_value(case when full_one then {'id': record_id, 'sha': sha, 'len': len, 'e': e, 'm': m} end ignore nulls)
             over (partition by url_key order by ts, record_id rows between unbounded preceding and 1 preceding) as o from r),
f as (select *, case when o is null or url_key is null then 'no_response' when e is not null and o.e is not null then case when e = o.e then 'resolved' else 'changed' end
                     when m is not null and o.m is not null then case when m = o.m then 'resolved' else 'changed' end else 'unverified' end as resolution from s where not full_one)
select record_id, url_key, resolution, case when resolution <> 'no_response' then o.id end as source_id,
       case when resolution = 'resolved' then array_to_string(['cache-control: max-age=' || (page_id % 100), 'content-length: ' || coalesce(cast(o.len as varchar), ''),
            'content-type: text/html', 'date: ' || v, 'etag: ' || coalesce('W/' || e, o.e, ''), 'last-modified: ' || coalesce(o.m, '')], chr(10)) end as headers,
       case when resolution = 'resolved' then o.sha end as payload_sha256, case when resolution = 'resolved' then o.len end as payload_length
from f
"""
