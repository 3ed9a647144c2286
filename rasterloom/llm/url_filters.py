"""URL filters as a temporal list join.

Dated list entries (add or remove a host, a domain or a URL prefix) become validity
intervals; every capture looks up its keys - host, domain suffixes, path prefixes - and an
as-of join finds the entries that are in force at its fetch time. All in DataFrame
operations: the join is an equality on the key with the interval as its condition, so that
Spark may broadcast a small list by its measured size and splits hot keys of a large one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Kinds of entries: exactly this host; this host and all below it; host and path from the start.
HOST, DOMAIN, PREFIX = "host", "domain", "prefix"
#: Tasks that the captures of one key are dealt over.
SALTS = 16


def parts(url: Column) -> tuple[Column, Column]:
    """Lower-case host without user, port and leading www, and the path without query and fragment (at least /)."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, "^(?:[^/?#@]*@)?([^/?#:]*)", 1)), "^www\\.", "")
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return host, F.when(path == "", "/").otherwise(path)


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals (list, kind, value, since, until) of dated entries (list, kind, value, action, at).

    action is add or remove. An entry is in force from an add until the next remove of the same
    list, kind and value; repeated adds change nothing; of an add and a remove at one time the
    remove holds. until is null while nothing removes it. Entries with a null in any of these
    columns, or another kind or action, are ignored.
    """
    known = entries.select("list", "kind", F.lower("value").alias("lowered"), "value", "action", "at")
    known = known.select("list", "kind", F.when(F.col("kind") == PREFIX, F.col("value")).otherwise(F.col("lowered")).alias("value"), F.col("action") == "add", "at").toDF("list", "kind", "value", "on", "at")
    known = known.dropna().where(F.col("kind").isin(HOST, DOMAIN, PREFIX)).groupBy("list", "kind", "value", "at").agg(F.min("on").alias("on"))
    w = Window.partitionBy("list", "kind", "value").orderBy("at")
    changes = known.withColumn("before", F.lag("on").over(w)).where(F.col("on") != F.coalesce("before", F.lit(False)))
    spans = changes.withColumn("until", F.lead("at").over(w))
    return spans.where("on").select("list", "kind", "value", F.col("at").alias("since"), "until")


def keys(host: Column, path: Column) -> Column:
    """All (kind, value) that could list a URL."""
    labels = F.split(host, "\\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit(DOMAIN).alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("value")))
    steps = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.struct(F.lit(PREFIX).alias("kind"), F.concat(host, F.array_join(F.slice(steps, 1, i), "/"), F.when(i < F.size(steps), "/").otherwise("")).alias("value")))
    return F.array_distinct(F.concat(F.array(F.struct(F.lit(HOST).alias("kind"), host.alias("value"))), domains, prefixes))


def judge(captures: DataFrame, spans: DataFrame) -> DataFrame:
    """captures (url, fetched, any more) with blocked, n_entries and the deciding list, kind, value and since.

    A capture is blocked where an entry is in force at its fetch time (since <= fetched < until).
    The deciding entry is the first by kind, value, list. A null fetch time or a URL without a host
    (null and empty ones too) is never blocked. Repeated rows are judged each; all columns stay, and
    a column of captures with the name of a result keeps its name while the result gets url_ before
    its own; an empty table or list gives no blocked rows.
    """
    own = [f"_own{i}" for i in range(len(captures.columns))]
    named = captures.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(captures.columns, own, strict=True)], F.col("url").cast("string").alias("_url"), F.col("fetched").cast("timestamp").alias("_at"))
    host, path = parts(F.col("_url"))
    # the verdict depends on host, path and time alone: each of them is looked up once
    asked = named.select(host.alias("_host"), path.alias("_path"), "_at").where("_host <> '' and _at is not null").distinct()
    asked = asked.select("*", F.explode(keys(F.col("_host"), F.col("_path"))).alias("k")).select("_host", "_path", "_at", F.col("k.kind").alias("kind"), F.col("k.value").alias("value"), F.pmod(F.xxhash64("_host", "_path", "_at"), F.lit(SALTS)).alias("salt"))
    # a domain that a third of all captures share, such as com, is dealt over SALTS tasks
    dealt = spans.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    met = asked.join(dealt, (asked["kind"] == dealt["kind"]) & (asked["value"] == dealt["value"]) & (asked["salt"] == dealt["salt"]) & (F.col("_at") >= F.col("since")) & (F.col("until").isNull() | (F.col("_at") < F.col("until"))))
    found = met.groupBy("_host", "_path", "_at").agg(F.count("*").alias("_n"), F.min(F.struct(dealt["kind"].alias("kind"), dealt["value"].alias("value"), F.col("list"), F.col("since"))).alias("_by"))
    whole = named.withColumns({"_h": host, "_p": path})
    out = whole.join(found, (whole["_h"] == found["_host"]) & (whole["_p"] == found["_path"]) & (whole["_at"] == found["_at"]), "left")
    name = lambda c: c if c not in captures.columns else f"url_{c}"
    return out.select(
        *[F.col(o).alias(c) for o, c in zip(own, captures.columns, strict=True)],
        F.col("_n").isNotNull().alias(name("blocked")),
        F.coalesce("_n", F.lit(0)).cast("long").alias(name("n_entries")),
        F.col("_by.list").alias(name("list")),
        F.col("_by.kind").alias(name("kind")),
        F.col("_by.value").alias(name("value")),
        F.col("_by.since").alias(name("since")),
    )


def bucket(value: Column) -> Column:
    return F.conv(F.substring(F.md5(value), 1, 7), 16, 10).cast("long") % 1000


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against a list whose history is taken from the events: an event lists or unlists the hosts of its bucket."""
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url")
    hosts = pages.select(parts(F.col("url"))[0].alias("host")).where("host <> ''").distinct()
    events = common.table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    dated = hosts.join(events, bucket(F.col("host")) == F.col("user_id") % 1000)
    kind = F.col("event_id") % 3
    entries = dated.select(
        F.concat(F.lit("list"), (F.col("event_id") % 2).cast("string")).alias("list"),
        F.when(kind == 0, HOST).when(kind == 1, DOMAIN).otherwise(PREFIX).alias("kind"),
        F.when(kind == 0, F.col("host")).when(kind == 1, F.regexp_replace("host", "^[^.]+\\.([^.]+\\.[^.]+\\.)", "$1")).otherwise(F.concat("host", F.lit("/en/"))).alias("value"),
        F.when(F.col("event_type").isin("error", "click"), "add").otherwise("remove").alias("action"),
        F.col("ts").cast("timestamp").alias("at"),
    )
    captures = pages.withColumn("fetched", F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 7919 % 2592000))
    return judge(captures, common.materialize(intervals(entries), "intervals")).select("page_id", "blocked", "n_entries", "list", "kind", "value", "since")


ORACLE_OP3 = """
WITH p AS (
  SELECT page_id, regexp_replace(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest,
    make_timestamp((1704067200 + page_id * 7919 % 2592000) * 1000000) AS fetched FROM pages
), q AS (
  SELECT page_id, fetched, regexp_replace(lower(regexp_extract(rest, '^(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\\.', '') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), c AS (SELECT page_id, fetched, host, CASE WHEN path = '' THEN '/' ELSE path END AS path FROM q),
e AS (
  SELECT 'list' || (event_id % 2) AS list,
    CASE event_id % 3 WHEN 0 THEN 'host' WHEN 1 THEN 'domain' ELSE 'prefix' END AS kind,
    CASE event_id % 3 WHEN 0 THEN host WHEN 1 THEN regexp_replace(host, '^[^.]+\\.([^.]+\\.[^.]+\\.)', '\\1') ELSE host || '/en/' END AS value,
    event_type IN ('error', 'click') AS is_on, ts AS tm
  FROM (SELECT DISTINCT host FROM c WHERE host <> '') h JOIN events ON CAST('0x' || substr(md5(host), 1, 7) AS BIGINT) % 1000 = user_id % 1000
), m AS (SELECT list, kind, value, tm, bool_and(is_on) AS is_on FROM e GROUP BY ALL),
b AS (SELECT *, coalesce(lag(is_on) OVER (PARTITION BY list, kind, value ORDER BY tm), false) AS before FROM m),
s AS (SELECT *, lead(tm) OVER (PARTITION BY list, kind, value ORDER BY tm) AS until FROM b WHERE is_on <> before),
v AS (SELECT list, kind, value, tm AS since, until FROM s WHERE is_on),
j AS (
  SELECT page_id, count(*) AS n, min({'kind': kind, 'value': value, 'list': list, 'since': since}) AS d
  FROM c JOIN v ON fetched >= since AND (until IS NULL OR fetched < until) AND (
    kind = 'host' AND value = host OR kind = 'domain' AND (host = value OR ends_with(host, '.' || value))
    OR kind = 'prefix' AND (value = host || path OR ends_with(value, '/') AND starts_with(host || path, value)))
  GROUP BY 1
)
SELECT c.page_id, n IS NOT NULL AS blocked, coalesce(n, 0) AS n_entries, d.list, d.kind, d.value, d.since FROM c LEFT JOIN j USING (page_id)
"""
