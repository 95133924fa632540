"""Resolution of not-modified revisits in web archives.

A revisit record of a 304 answer has no body. It is joined as of its date with the latest strictly earlier full
response (status 200 with a body) of the same canonical URL; the pair must agree on a validator, entity tags by weak
comparison if both carry one, else dates of last modification; and the headers a 304 may update replace those
of the response, all others of the revisit being ignored.

The as-of join sorts responses and revisits together into ranges of (URL, date), written once with the
range's number. Within a range a window carries the last response forward; one row per URL and range carries it
into later ranges. A URL with any number of captures thus spreads over ranges, and only the small columns of a
record move: the body stays behind until `with_payload` is asked for.

Records have: record_id, warc_type, target_uri, warc_date (timestamp), status, headers (array of name and value, in
order) and payload. Edge cases: a revisit without URL or date, or with no earlier response, is `no_response`; without a
shared validator `no_validator`; with differing ones `validator_mismatch`; responses of one date rank by record_id,
then digest, nulls lowest; header names compare without case, null headers are none; repeated rows
are resolved each; records of other types or statuses are ignored; an empty table gives no rows. Clashing extra columns
are passed over.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut

#: Header fields a 304 answer updates (RFC 9110, 15.4.5, and the validators).
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
#: Query parameters that do not name a resource.
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)"

_EMPTY_HEADERS = "array<struct<name:string,value:string>>"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www. and default port, path without closing slash, sorted parameters without
    tracking ones; no scheme, no fragment. Null for null and for texts that are no absolute URL."""
    part = lambda i: F.regexp_extract(url, "^(?i:https?)://([^/?#]+)([^?#]*)(\\?[^#]*)?", i)
    host = F.regexp_replace(F.regexp_replace(F.lower(part(1)), ":(80|443)$", ""), "^www\\.", "")
    path = F.regexp_replace(part(2), "/+$", "")
    given = F.split(F.regexp_replace(part(3), "^\\?", ""), "&")
    kept = F.array_sort(F.filter(given, lambda p: (p != "") & ~p.rlike(TRACKING)))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(part(1) != "", F.concat(host, path, query))


def _normal(headers: Column) -> Column:
    """Headers with trimmed lower-case names; those without a name are dropped."""
    named = F.filter(F.coalesce(headers, F.array().cast(_EMPTY_HEADERS)), lambda h: h["name"].isNotNull())
    return F.transform(named, lambda h: F.struct(F.lower(F.trim(h["name"])).alias("name"), F.trim(h["value"]).alias("value")))


def _header(headers: Column, name: str) -> Column:
    return F.try_element_at(F.filter(headers, lambda h: (h["name"] == name) & h["value"].isNotNull()), F.lit(1))["value"]


def merged_headers(stored: Column, update: Column) -> Column:
    """Stored headers, updated by the permitted ones of a 304 answer."""
    new = F.filter(update, lambda h: h["name"].isin(PERMITTED))
    names = F.transform(new, lambda h: h["name"])
    return F.concat(F.filter(stored, lambda h: ~F.array_contains(names, h["name"])), new)


def _events(records: DataFrame) -> DataFrame:
    """Full responses and not-modified revisits, small columns only."""
    full = (F.col("warc_type") == "response") & (F.col("status") == 200) & F.col("payload").isNotNull()
    revisit = (F.col("warc_type") == "revisit") & (F.col("status") == 304)
    return records.select(
        canonical_url(F.col("target_uri")).alias("url"), F.col("warc_date").alias("date"), full.alias("full"), revisit.alias("revisit"),
        "record_id", _normal(F.col("headers")).alias("headers"), F.when(full, F.md5("payload")).alias("digest"),
        F.when(full, F.length("payload").cast("long")).alias("length")).filter("full or revisit").drop("revisit")


def latest_responses(records: DataFrame) -> DataFrame:
    """Revisits with the latest earlier response of their URL in `response` (null if there is none)."""
    order = ["url", "date", "full", "record_id", "digest"]
    known = _events(records).filter("url is not null and date is not null").repartitionByRange(*order)
    events = cut(known.withColumn("range", F.spark_partition_id()), "captures")
    response = F.when(F.col("full"), F.struct("record_id", "date", "digest", "length", "headers"))
    # at one date revisits stand before responses: only strictly earlier ones answer
    window = Window.partitionBy("range", "url").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, -1)
    near = events.withColumn("near", F.last(response, ignorenulls=True).over(window)).filter("not full")
    place = F.struct("date", "record_id", "digest")
    ends = events.groupBy("url", "range").agg(F.max_by(response, F.when(F.col("full"), place)).alias("latest"))
    before = Window.partitionBy("url").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("carried", F.last("latest", ignorenulls=True).over(before)).filter("carried is not null").select("url", "range", "carried")
    found = near.join(carried, ["url", "range"], "left").withColumn("response", F.coalesce("near", "carried"))
    lost = _events(records).filter("not full and (url is null or date is null)")
    columns = ["url", "date", "record_id", "headers", "response"]
    kind = found.schema["response"].dataType
    return found.select(columns).unionByName(lost.withColumn("response", F.lit(None).cast(kind)).select(columns))


def resolve(records: DataFrame) -> DataFrame:
    """One row per not-modified revisit: record_id, url, date, resolution, and for resolved ones
    response_id, response_date, payload_digest, payload_length and merged headers."""
    weak = lambda tag: F.regexp_replace(tag, "^W/", "")
    rows = latest_responses(records)
    own, theirs = (lambda n: _header(F.col("headers"), n)), (lambda n: _header(F.col("response.headers"), n))
    tagged = own("etag").isNotNull() & theirs("etag").isNotNull()
    dated = own("last-modified").isNotNull() & theirs("last-modified").isNotNull()
    agree = F.when(tagged, weak(own("etag")) == weak(theirs("etag"))).when(dated, own("last-modified") == theirs("last-modified"))
    rows = rows.withColumn("agree", agree).withColumn(
        "resolution", F.when(F.col("response").isNull(), "no_response").when(F.col("agree").isNull(), "no_validator")
        .when(F.col("agree"), "resolved").otherwise("validator_mismatch"))
    good = F.col("resolution") == "resolved"
    return rows.select(
        "record_id", "url", "date", "resolution", F.when(good, F.col("response.record_id")).alias("response_id"),
        F.when(good, F.col("response.date")).alias("response_date"), F.when(good, F.col("response.digest")).alias("payload_digest"),
        F.when(good, F.col("response.length")).alias("payload_length"),
        F.when(good, merged_headers(F.col("response.headers"), F.col("headers"))).alias("headers"))


def with_payload(resolved: DataFrame, records: DataFrame) -> DataFrame:
    """Resolved revisits with their response's body; equal bodies of one response id and date are one."""
    full = records.filter("warc_type = 'response' and status = 200 and payload is not null").select(
        F.col("record_id").alias("response_id"), F.col("warc_date").alias("response_date"), canonical_url(F.col("target_uri")).alias("url"),
        F.md5("payload").alias("payload_digest"), "payload")
    keys = ["url", "response_date", "payload_digest", "response_id"]
    asked = resolved.filter("resolution = 'resolved'")
    needed = full.join(asked.select(keys).distinct(), keys, "left_semi").dropDuplicates(keys)
    return asked.join(needed, keys)
