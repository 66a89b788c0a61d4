"""Operator 5: temporal list join, in DataFrame functions only.

Dated list entries (domain, day, action) become validity intervals: an entry holds from its day until
the next entry of its domain. A capture is judged by the entries active at fetch time for its host and
the parent domains, the longest domain first. Hosts and days are made distinct before the join, so a
host that a third of all captures share is joined once a day; nothing is broadcast by hand.

Cases: null URLs and URLs without a scheme or host match nothing and are kept, as are captures without a day;
an address in brackets is a host; a dot at a host's end does not count; of entries with one domain and day the last
action in alphabetical order holds; repeated captures are judged alike; an empty table gives an empty table and an
empty list keeps all; a capture's columns come out inside one struct, so none of their names clashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    """Lower-case host of a URL, without user, port and final dot; null if there is none."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:@]+)", 1)
    return F.nullif(F.rtrim(F.lower(found), F.lit(".")), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """(domain, since, until, action); ``until`` is null for the last entry of a domain."""
    e = entries.groupBy(F.lower("domain").alias("domain"), "day").agg(F.max("action").alias("action"))
    return e.select("domain", F.col("day").alias("since"), F.lead("day").over(Window.partitionBy("domain").orderBy("day")).alias("until"), "action")


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "fetch_day") -> DataFrame:
    """capture (a struct of the columns of ``captures``), ``host``, ``matched`` (the domain that decides), ``listed_since`` and ``blocked``."""
    c = captures.select(F.struct(*[captures[x] for x in captures.columns]).alias("capture"), host(captures[url]).alias("host"), captures[day].alias("day"))
    asked = c.where("host is not null and day is not null").select("host", "day").distinct()
    labels = F.split("host", "\\.")
    suffixes = asked.select("host", "day", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("domain"))
    hit = suffixes.join(intervals(entries), "domain").where((F.col("since") <= F.col("day")) & (F.col("until").isNull() | (F.col("day") < F.col("until"))))
    best = hit.groupBy("host", "day").agg(F.max_by(F.struct("domain", "since", "action"), F.length("domain")).alias("entry"))
    out = c.join(best, ["host", "day"], "left")
    return out.select("capture", "host", F.col("entry.domain").alias("matched"), F.col("entry.since").alias("listed_since"), F.coalesce(F.col("entry.action") == "block", F.lit(False)).alias("blocked"))
