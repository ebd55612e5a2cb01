"""Block and allow lists that change over time, applied as of each fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import column

# Validity intervals meet captures by key and by stretches of so many days.
STRETCH_DAYS = 30
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*://"


def host_of(url: Column) -> Column:
    """The host in lower case, without user and port; empty without one."""
    authority = F.regexp_extract(url, _SCHEME + r"([^/?#]*)", 1)
    return F.lower(F.regexp_replace(authority, r"^.*@|:[0-9]*$", ""))


def path_of(url: Column) -> Column:
    """The path without empty segments at its ends."""
    return F.regexp_replace(F.regexp_extract(url, _SCHEME + r"[^/?#]*([^?#]*)", 1), "^/+|/+$", "")


def _keys(host: Column, path: Column, most_labels: int, most_segments: int) -> Column:
    """All patterns that may match: the domains a host is in, and the beginnings of host and path by segments.

    Domains of more labels, and paths of more segments, than any pattern has are left out.
    """
    labels, segments = F.split(host, r"\."), F.split(path, "/")
    first = F.greatest(F.lit(1), F.size(labels) - F.lit(most_labels) + 1)
    domains = F.transform(F.sequence(first, F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    upto = F.least(F.size(segments), F.lit(most_segments))
    prefixes = F.transform(
        F.sequence(F.lit(1), upto), lambda i: F.concat_ws("/", host, F.array_join(F.slice(segments, 1, i), "/"))
    )
    none = F.array().cast("array<string>")
    return F.when(host == "", none).otherwise(
        F.concat(domains if most_labels else none, F.when(path == "", none).otherwise(prefixes) if most_segments else none)
    )


def validity(entries: DataFrame) -> DataFrame:
    """(pattern, action, valid_from, valid_to): what holds for a pattern, and when.

    ``entries``: pattern, action ("block", "allow" or "remove"), dated_at. An entry holds from
    its date until the next one of its pattern; the last holds on (null). "remove" ends what
    held. Of entries of one pattern and date, the last by name holds. Rows that lack a value
    are left out, and repeated rows count once.
    """
    one = (
        entries.where("pattern IS NOT NULL AND action IS NOT NULL AND dated_at IS NOT NULL")
        .groupBy("pattern", "dated_at")
        .agg(F.max("action").alias("action"))
    )
    following = F.lead("dated_at").over(Window.partitionBy("pattern").orderBy("dated_at"))
    return one.select(
        "pattern", "action", F.col("dated_at").alias("valid_from"), following.alias("valid_to")
    ).where("action != 'remove'")


def _stretch(time: Column) -> Column:
    return F.floor(F.unix_seconds(time) / (86_400 * STRETCH_DAYS))


def filter_urls(
    captures: DataFrame, entries: DataFrame, key: str = "page_id", url: str = "url", fetched: str = "fetched_at"
) -> DataFrame:
    """(key, url, fetched_at, blocked, pattern, action, valid_from): the verdict on each capture as of its fetch.

    A pattern without a slash is a domain, which holds all its hosts; one with a slash is a
    host and the beginning of a path, by whole segments. Of the entries that hold at the time
    of the fetch, a path wins over a domain, then the longer pattern wins. A capture without
    such an entry, or with a null or odd URL or no time, is not blocked.

    Each capture is joined with intervals by its patterns and its stretch of time, so a
    capture meets only the few versions of an entry that a stretch sees, and a host with very
    many captures falls into as many groups as there are stretches, which the join can split
    further. Equal captures give one row. Other columns are not looked at.
    """
    held = validity(entries)
    seen = captures.select(
        column(key).alias(key), column(url).alias("url"), column(fetched).cast("timestamp").alias("fetched_at")
    )
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    # Two numbers of the longest patterns.
    slashes, dots = F.size(F.split("pattern", "/")) - 1, F.size(F.split("pattern", r"\."))
    longest = held.agg(F.max(F.when(slashes == 0, dots)).alias("labels"), F.max(slashes).alias("segments")).first()
    keys = _keys(host, path, longest["labels"] or 0, longest["segments"] or 0)
    keyed = seen.select(key, "url", "fetched_at", F.explode_outer(keys).alias("pattern"), _stretch(F.col("fetched_at")).alias("stretch"))
    # The stretches in which anything was fetched: 122,000 in all the years that a timestamp has,
    # and a dozen in one year. An interval is listed in those that it reaches.
    stretches = sorted(r[0] for r in seen.where("fetched_at IS NOT NULL").select(_stretch(F.col("fetched_at"))).distinct().collect())
    fetched_in = F.array(*map(F.lit, stretches)).cast("array<long>")
    reached = F.filter(
        fetched_in,
        lambda s: (s >= _stretch(F.col("valid_from"))) & (F.col("valid_to").isNull() | (s <= _stretch(F.col("valid_to")))),
    )
    listed = held.withColumn("stretch", F.explode(reached))
    now = (F.col("fetched_at") >= F.col("valid_from")) & (
        F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to"))
    )
    winner = F.struct(
        F.contains(F.col("pattern"), F.lit("/")).alias("is_path"),
        F.length("pattern").alias("length"),
        "pattern",
        "action",
        "valid_from",
    )
    met = keyed.join(listed, ["pattern", "stretch"], "left").withColumn(
        "winner", F.when(F.col("action").isNotNull() & now, winner)
    )
    return (
        met.groupBy(key, "url", "fetched_at")
        .agg(F.max("winner").alias("winner"))
        .select(
            key,
            "url",
            "fetched_at",
            F.coalesce(F.col("winner.action") == "block", F.lit(False)).alias("blocked"),
            F.col("winner.pattern").alias("pattern"),
            F.col("winner.action").alias("action"),
            F.col("winner.valid_from").alias("valid_from"),
        )
    )


def fetched_at(page_id: Column) -> Column:
    """A fetch time within a year, from the page's number: the table has none."""
    seconds = F.pmod(page_id * 7919, F.lit(365)) * 86_400 + F.pmod(page_id, F.lit(86_400))
    return F.timestamp_seconds(F.lit(1_704_067_200) + seconds)


def _number(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 6), 16, 10).cast("long")


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated entries from the hosts and first path segments that occur in the pages.

    Every third host is blocked some day, taken off the list 60 days later and blocked again
    120 days after that; every fourth pair of host and first segment is allowed some day, and
    blocked 150 days later.
    """

    def entry(pattern: Column, days: int, action: str) -> Column:
        day = F.pmod(_number(pattern), F.lit(200)) + days
        dated = F.timestamp_seconds(F.lit(1_704_067_200) + day * 86_400)
        return F.struct(pattern.alias("pattern"), F.lit(action).alias("action"), dated.alias("dated_at"))

    host, path = host_of(F.col("url")), path_of(F.col("url"))
    places = pages.select(host.alias("host"), F.concat_ws("/", host, F.substring_index(path, "/", 1)).alias("prefix"))
    known = F.col("pattern")
    hosts = places.select(F.col("host").alias("pattern")).where("pattern != ''").distinct()
    prefixes = places.select(F.col("prefix").alias("pattern")).where("pattern LIKE '%_/_%'").distinct()
    dated = hosts.where(_number(known) % 3 == 0).select(
        F.explode(F.array(entry(known, 0, "block"), entry(known, 60, "remove"), entry(known, 180, "block"))).alias("entry")
    )
    allowed = prefixes.where(_number(known) % 4 == 0).select(
        F.explode(F.array(entry(known, 0, "allow"), entry(known, 150, "block"))).alias("entry")
    )
    return dated.unionByName(allowed).select("entry.*")


SQL = r"""
WITH places AS (
  SELECT page_id, url, make_timestamp((1704067200 + (page_id * 7919 % 365) * 86400 + page_id % 86400) * 1000000) AS fetched_at,
         lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), '^.*@|:[0-9]*$', '', 'g')) AS host,
         regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '^/+|/+$', '', 'g') AS path
  FROM pages),
patterns AS (
  SELECT DISTINCT host AS pattern, true AS is_host FROM places WHERE host != ''
  UNION ALL SELECT DISTINCT host || '/' || split_part(path, '/', 1), false FROM places WHERE host != '' AND path != ''),
numbered AS (SELECT *, ('0x' || substr(md5(pattern), 1, 6))::BIGINT AS m FROM patterns),
entries AS (
  SELECT pattern, unnest(['block', 'remove', 'block']) AS action, m % 200 + unnest([0, 60, 180]) AS day FROM numbered WHERE is_host AND m % 3 = 0
  UNION ALL SELECT pattern, unnest(['allow', 'block']), m % 200 + unnest([0, 150]) FROM numbered WHERE NOT is_host AND m % 4 = 0),
dated AS (SELECT pattern, action, make_timestamp((1704067200 + day * 86400) * 1000000) AS valid_from FROM entries),
held AS (SELECT *, lead(valid_from) OVER (PARTITION BY pattern ORDER BY valid_from) AS valid_to FROM dated)
SELECT page_id, url, fetched_at, coalesce(action = 'block', false) AS blocked, pattern, action, valid_from
FROM (SELECT DISTINCT page_id, url, fetched_at, host, host || '/' || path AS whole FROM places) c
LEFT JOIN (SELECT * FROM held WHERE action != 'remove') h
  ON (c.host = h.pattern OR ends_with(c.host, '.' || h.pattern) OR starts_with(c.whole || '/', h.pattern || '/') AND contains(h.pattern, '/'))
  AND c.fetched_at >= h.valid_from AND (h.valid_to IS NULL OR c.fetched_at < h.valid_to)
QUALIFY row_number() OVER (PARTITION BY page_id, url, fetched_at ORDER BY contains(pattern, '/') DESC NULLS LAST, length(pattern) DESC, pattern DESC) = 1
"""
