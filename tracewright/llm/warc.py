"""Not-modified revisits of web captures, resolved by an as-of join by canonical URL to the latest earlier full response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Headers that a 304 answer may renew in the stored response. All others stay as they were stored.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that say where a visitor came from.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|msclkid|mc_[a-z]+|sessionid|sid)(=|$)"

RECORD = "record_id long, uri string, kind string, at timestamp, status int, headers map<string,string>, digest string"


def canonical_url(url: Column) -> Column:
    """Scheme, user, default port, fragment, tracking parameters, trailing slash and 'www.' go; the host is lower-cased and parameters are sorted. Null and blank stay null."""
    url = F.trim(url)
    bare = F.regexp_replace(F.when(url != "", url), r"#.*$", "")
    bare = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(bare, r"^([^/?]*)", 1), r"^.*@|:(80|443)$", ""))
    host = F.regexp_replace(host, r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING))), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def header_map(head: Column) -> Column:
    """Lines 'name: value' of a head as a map, names in lower case; of lines with one name the last wins. Other lines are passed over."""
    lines = F.transform(F.split(head, "\r?\n"), lambda h, i: F.struct(F.lower(F.trim(F.substring_index(h, ":", 1))).alias("name"), (-i).alias("place"), F.when(h.contains(":"), F.trim(F.regexp_replace(h, r"^[^:]*:", ""))).alias("value")))
    ordered = F.array_sort(F.filter(lines, lambda h: h["value"].isNotNull()))
    last = lambda s: F.filter(s, lambda h, i: (i == 0) | (h["name"] != F.get(s, i - 1)["name"]))
    once = F.transform(F.array(ordered), lambda s: F.map_from_entries(F.transform(last(s), lambda h: F.struct(h["name"], h["value"]))))  # s is sorted once, not for every line
    return F.element_at(once, 1)


def parse_records(raw: DataFrame) -> DataFrame:
    """raw (record_id, record: text of one WARC record) -> columns of RECORD and body.

    The record ends its WARC head and its HTTP head with an empty line each; lines end with LF or CRLF. kind is the WARC-Type in lower case; headers are those of the HTTP part, names in lower case, later ones winning; digest is WARC-Payload-Digest. The body is whatever follows, unchanged. A field that is missing or blank, and all fields of null or broken records, are null.
    """
    parts = raw.select(F.col("record_id").cast("long"), F.split("record", "\r?\n\r?\n", 3).alias("p")).select("record_id", F.get("p", F.lit(0)).alias("w"), F.get("p", F.lit(1)).alias("http"), F.get("p", F.lit(2)).alias("body"))
    parts = parts.select("record_id", header_map(F.col("w")).alias("w"), "http", "body")
    field = lambda name: F.nullif(F.col("w")[name], F.lit(""))
    status = F.regexp_extract("http", r"^HTTP/\S+ (\d{3})", 1).try_cast("int")
    return parts.select("record_id", field("warc-target-uri").alias("uri"), F.lower(field("warc-type")).alias("kind"), F.try_to_timestamp(field("warc-date")).alias("at"), status.alias("status"), header_map(F.col("http")).alias("headers"), field("warc-payload-digest").alias("digest"), "body")


def resolve_revisits(records: DataFrame, span_seconds: int = 86_400) -> DataFrame:
    """records (RECORD) -> one row per revisit record: record_id, url (canonical), at, base_id, base_at, verdict, headers (merged).

    The base is the latest full response (kind response, status 200) of the same canonical URL that is strictly earlier, or as early with a smaller record_id. verdict: 'not-found' without a base; else by the first validator of etag (weak ones by their value), last-modified and digest that both have: its name if it is equal, 'mismatch' if it differs; 'unchecked' if they share none. A mismatch keeps the base's headers; else the permitted ones of the revisit renew them.

    Captures of one URL may be a third of all rows: the as-of search runs within (url, span of time), and only each span's last response is carried from span to span, so no task holds a whole URL. Records are read once; headers of bases join by record_id afterwards, and bodies never move.
    Null or blank URL, or null time: a revisit is 'not-found', a response no base. Null record_id: no base; a revisit stays. Repeated records: each revisit keeps its row; of responses with one record_id one is taken. Null headers: none. Extra columns are not read. Empty table: no rows.
    """
    r = records.select("record_id", canonical_url(F.col("uri")).alias("url"), F.lower("kind").alias("kind"), "at", "status", "headers", "digest")
    full = "kind = 'response' and status = 200 and url is not null and at is not null and record_id is not null"
    revisit = F.col("kind") == "revisit"
    key = r.where(f"kind = 'revisit' or ({full})").select(
        "record_id", "url", "kind", "at", F.floor(F.unix_micros("at") / (span_seconds * 1_000_000)).alias("span"), "headers", "digest",
        F.when(~revisit, F.struct(F.col("at").alias("base_at"), F.col("record_id").alias("base_id"))).alias("own"),
    )
    key = materialize(key, "warc-keys")
    found = key.where("url is not null and at is not null").withColumns({c: F.when(revisit, F.col(c)) for c in ("headers", "digest")})
    spans = found.groupBy("url", "span").agg(F.max("own").alias("last"))
    before = Window.partitionBy("url").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("carried", F.max("last").over(before)).where("carried is not null").select("url", "span", "carried")
    inside = Window.partitionBy("url", "span").orderBy("at", F.col("record_id").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    asked = found.withColumn("own", F.max("own").over(inside)).where(revisit).join(spans, ["url", "span"], "left").withColumn("base", F.coalesce("own", "carried"))
    asked = asked.select("record_id", "url", "at", "headers", "digest", "base.base_id", "base.base_at")
    lost = key.where(revisit & (F.col("url").isNull() | F.col("at").isNull())).select("record_id", "url", "at", "headers", "digest", F.lit(None).cast("long").alias("base_id"), F.lit(None).cast("timestamp").alias("base_at"))
    asked = materialize(asked.unionByName(lost), "warc-asked")
    stored = key.where("own is not null").select(F.col("record_id").alias("base_id"), "headers", "digest")
    stored = stored.join(asked.select("base_id").where("base_id is not null").distinct(), "base_id", "left_semi")  # only headers that are asked for go on
    bases = stored.groupBy("base_id").agg(F.max_by(F.struct(F.col("headers").alias("h"), F.col("digest").alias("d")), F.coalesce("digest", F.lit(""))).alias("b"))
    lost = asked.where("base_id is null").withColumn("b", F.lit(None).cast(bases.schema["b"].dataType))  # kept out of the join, where they would be one key
    return _judge(asked.where("base_id is not null").join(bases, "base_id", "left").unionByName(lost))


def _judge(pairs: DataFrame) -> DataFrame:
    tag = lambda c: F.regexp_replace(c, "^W/", "")
    pairs = pairs.withColumns({"headers": F.coalesce("headers", F.create_map().cast("map<string,string>")), "old": F.coalesce("b.h", F.create_map().cast("map<string,string>"))})
    tests = [("etag", tag(F.col("headers")["etag"]), tag(F.col("old")["etag"])), ("last-modified", F.col("headers")["last-modified"], F.col("old")["last-modified"]), ("digest", F.col("digest"), F.col("b.d"))]
    verdict = F.when(F.col("base_id").isNull(), "not-found")
    for name, mine, theirs in tests:
        verdict = verdict.when(mine.isNotNull() & theirs.isNotNull(), F.when(mine == theirs, name).otherwise("mismatch"))
    pairs = pairs.withColumn("verdict", verdict.otherwise("unchecked"))
    renewed = F.map_filter("headers", lambda k, v: F.array_contains(F.array(*map(F.lit, PERMITTED)), k))
    merged = F.map_zip_with("old", renewed, lambda k, a, b: F.coalesce(b, a))
    headers = F.when(F.col("base_id").isNull(), F.lit(None)).when(F.col("verdict") == "mismatch", F.col("old")).otherwise(merged)
    return pairs.select("record_id", "url", "at", "base_id", "base_at", "verdict", headers.alias("headers"))


def records_of_pages(pages: DataFrame) -> DataFrame:
    """WARC records (record_id, record) that pages (page_id, url, html) give: the capture of each page, a revisit half an hour later, and for every fourth page a revisit three days before it. Validators are the page's own, or differ for every fifth page. Null url: no target; null html: an empty body without a validator; a row with a null page_id gives records with null ids and times. Extra columns are not read."""
    i, tag = F.col("page_id"), F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 12), F.lit('"'))
    line = lambda name, value: F.coalesce(F.concat(F.lit(name + ": "), value, F.lit("\r\n")), F.lit(""))

    def record(k, kind, shift, http, body):
        at = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + i * 3600 + shift), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        head = F.concat(F.lit("WARC/1.1\r\n"), line("WARC-Type", F.lit(kind)), line("WARC-Target-URI", F.col("url")), line("WARC-Date", at))
        return F.struct((i * 4 + k).alias("record_id"), F.concat(head, F.lit("\r\n"), http, F.lit("\r\n"), body).alias("record"))

    first = F.concat(
        F.when(i % 11 == 3, "HTTP/1.1 404 Not Found\r\n").otherwise("HTTP/1.1 200 OK\r\n"), F.when(i % 6 != 1, line("ETag", tag)).otherwise(""),
        line("Last-Modified", F.concat(F.lit("day "), i)), line("Content-Type", F.lit("text/html")), line("Cache-Control", F.concat(F.lit("max-age="), i % 100)),
    )
    again = F.concat(
        F.lit("HTTP/1.1 304 Not Modified\r\n"), line("ETag", F.when(i % 5 == 0, '"other"').otherwise(F.concat(F.when(i % 3 == 0, "W/").otherwise(""), tag))),
        line("Cache-Control", F.lit("max-age=600")), line("Content-Type", F.lit("text/plain")), line("Expires", F.concat(F.lit("day "), i)),
    )
    early = F.concat(F.lit("HTTP/1.1 304 Not Modified\r\n"), line("Last-Modified", F.concat(F.lit("day "), i)))
    nothing = F.lit("")
    made = F.array(record(0, "response", 0, first, F.coalesce("html", nothing)), record(1, "revisit", 1800, again, nothing), F.when(i % 4 == 0, record(2, "revisit", -259_200, early, nothing)))
    return pages.select(F.explode(made).alias("r")).where("r is not null").select("r.*")


#: The same records and rules as one as-of window over all captures of a URL.
WARC_SQL = r"""
WITH p AS (SELECT page_id AS i, url AS u, '"' || substr(md5(html), 1, 12) || '"' AS tag FROM pages),
raw AS (
  SELECT i * 4 AS record_id, u, 1700000000 + i * 3600 AS t, true AS full_, i % 11 <> 3 AS ok, CASE WHEN i % 6 <> 1 THEN tag END AS etag, 'day ' || i AS modified, 'max-age=' || i % 100 AS cache, NULL AS expires FROM p
  UNION ALL SELECT i * 4 + 1, u, 1700000000 + i * 3600 + 1800, false, false, CASE WHEN i % 5 = 0 THEN '"other"' ELSE tag END, NULL, 'max-age=600', 'day ' || i FROM p
  UNION ALL SELECT i * 4 + 2, u, 1700000000 + i * 3600 - 259200, false, false, NULL, 'day ' || i, NULL, NULL FROM p WHERE i % 4 = 0),
bare AS (SELECT *, regexp_replace(regexp_replace(trim(u), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS b FROM raw),
part AS (SELECT *, regexp_replace(lower(regexp_replace(regexp_extract(b, '^([^/?]*)', 1), '^.*@|:(80|443)$', '', 'g')), '^www\.', '') AS host,
  regexp_replace(regexp_extract(b, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
  array_to_string(list_sort(list_filter(string_split(regexp_extract(b, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[a-z]+|ref|fbclid|gclid|msclkid|mc_[a-z]+|sessionid|sid)(=|$)'))), '&') AS q FROM bare),
url AS (SELECT *, CASE WHEN trim(u) <> '' THEN host || path || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS canonical FROM part WHERE NOT full_ OR ok),
latest AS (SELECT *, CASE WHEN canonical IS NOT NULL THEN last_value(CASE WHEN full_ THEN record_id END IGNORE NULLS) OVER (PARTITION BY canonical ORDER BY t, record_id) END AS base_id FROM url)
SELECT r.record_id, r.canonical AS url, r.base_id, CAST(b.t AS BIGINT) AS base_at,
  CASE WHEN b.t IS NULL THEN 'not-found' WHEN r.etag IS NOT NULL AND b.etag IS NOT NULL THEN CASE WHEN r.etag = b.etag THEN 'etag' ELSE 'mismatch' END
       WHEN r.modified IS NOT NULL AND b.modified IS NOT NULL THEN CASE WHEN r.modified = b.modified THEN 'last-modified' ELSE 'mismatch' END ELSE 'unchecked' END AS verdict,
  CASE WHEN b.t IS NULL THEN NULL
       WHEN r.etag IS NOT NULL AND b.etag IS NOT NULL AND r.etag <> b.etag OR (r.etag IS NULL OR b.etag IS NULL) AND r.modified IS NOT NULL AND r.modified <> b.modified
       THEN concat_ws('|', 'cache-control=' || b.cache, 'content-type=text/html', 'etag=' || b.etag, 'last-modified=' || b.modified)
       ELSE concat_ws('|', 'cache-control=' || coalesce(r.cache, b.cache), 'content-type=text/html',
              'etag=' || coalesce(CASE WHEN (r.record_id // 4) % 3 = 0 AND (r.record_id // 4) % 5 <> 0 THEN 'W/' ELSE '' END || r.etag, b.etag), 'expires=' || r.expires, 'last-modified=' || coalesce(r.modified, b.modified)) END AS headers
FROM latest r LEFT JOIN latest b ON b.full_ AND b.record_id = r.base_id WHERE NOT r.full_
"""
