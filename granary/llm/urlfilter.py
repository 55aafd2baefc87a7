"""URL filters by temporal list join: every capture is judged by the list entries in force when it was fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Days of the periods by which intervals and captures meet.
PERIOD = 32
BLOCK, ALLOW, REMOVE = "block", "allow", "remove"


def host_of(url: Column) -> Column:
    """Host of an absolute URL in lower case, without user, port and final dot; null if there is none. An IPv6 address keeps its brackets."""
    host = F.regexp_extract(F.lower(F.trim(url.cast("string"))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^/?#@\]]*\]|[^/?#:@\[\]]+)", 1)
    return F.nullif(F.regexp_replace(host, r"\.+$", ""), F.lit(""))


def is_address(host: Column) -> Column:
    """Whether a host is an IP address, which has no labels and so no suffixes."""
    return host.rlike(r"^(\[.*\]|[0-9]{1,3}(\.[0-9]{1,3}){3})$")


def validity(entries: DataFrame) -> DataFrame:
    """(domain, action, valid_from, valid_to) of dated entries (domain, action, dated): each holds until its domain's next.

    valid_to is the first day on which it no longer holds, null if there is none. Of entries of one
    domain and day the strictest counts: block, allow, remove. Null domains, days or actions and
    unknown actions don't count; repeated entries count once.
    """
    rank = F.when(F.col("action") == BLOCK, 0).when(F.col("action") == ALLOW, 1).when(F.col("action") == REMOVE, 2)
    one = entries.select(F.lower(F.trim("domain")).alias("domain"), F.col("dated").cast("date").alias("dated"), "action", rank.alias("r")).where("domain is not null and dated is not null and r is not null")
    one = one.groupBy("domain", "dated").agg(F.min_by("action", "r").alias("action"))
    until = F.lead("dated").over(W.partitionBy("domain").orderBy("dated"))
    return one.select("domain", "action", F.col("dated").alias("valid_from"), until.alias("valid_to")).where(F.col("action") != REMOVE)


def _period(day: Column) -> Column:
    return F.floor(F.unix_date(day) / PERIOD)


def judge(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "fetched_on") -> DataFrame:
    """(id, host, fetched_on, verdict, domain, valid_from, valid_to) of every capture.

    verdict is the action of the entry for the longest suffix of the host, in whole labels (an address:
    the whole), that is in force on that day; `none` without one; `unknown` if the URL has no host or the day is null.
    Repeated captures are judged each; empty tables give no rows or `none`; other columns aren't read.
    Captures meet intervals by domain and period of PERIOD days, so a domain's long history doesn't
    multiply its captures, and are first reduced to distinct hosts and days, so a hot host is at most
    as many rows as there are days. Suffixes of fewer or more labels than any listed domain has, such
    as top-level ones, are never made.
    """
    rows = captures.select(F.col(f"`{id_col}`").cast("long").alias("id"), host_of(F.col(f"`{url_col}`")).alias("host"), F.col(f"`{day_col}`").cast("date").alias("fetched_on"))
    asked = rows.where("host is not null and fetched_on is not null").select("host", "fetched_on").distinct()
    span = asked.agg(F.min("fetched_on"), F.max("fetched_on")).first()
    least, most = entries.select(F.size(F.split(F.trim("domain"), r"\.")).alias("n"), is_address(F.trim("domain")).alias("ip")).where("not ip").agg(F.min("n"), F.max("n")).first()
    labels = F.when(is_address(F.col("host")), F.array("host")).otherwise(F.split("host", r"\."))
    sizes = F.filter(F.sequence(F.lit(1), F.size(labels)), lambda n: n.between(least or 1, most or 0) | is_address(F.col("host")))
    suffix = F.explode(F.transform(sizes, lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".")))
    parts = asked.select("host", "fetched_on", suffix.alias("domain")).withColumn("period", _period(F.col("fetched_on")))
    first, last = F.lit(span[0]).cast("date"), F.lit(span[1]).cast("date")
    within = validity(entries).where((F.col("valid_from") <= last) & (F.col("valid_to").isNull() | (F.col("valid_to") > first)))
    held = within.withColumn("period", F.explode(F.sequence(_period(F.greatest("valid_from", first)), _period(F.least(F.coalesce(F.date_sub("valid_to", 1), last), last)))))
    active = parts.join(held, ["domain", "period"]).where((F.col("fetched_on") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched_on") < F.col("valid_to"))))
    best = active.groupBy("host", "fetched_on").agg(F.max_by(F.struct("action", "domain", "valid_from", "valid_to"), F.length("domain")).alias("e"))
    unknown = F.col("host").isNull() | F.col("fetched_on").isNull()
    return rows.join(best, ["host", "fetched_on"], "left").select("id", "host", "fetched_on", F.when(unknown, "unknown").otherwise(F.coalesce("e.action", F.lit("none"))).alias("verdict"), "e.domain", "e.valid_from", "e.valid_to")
