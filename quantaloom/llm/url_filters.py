"""URL filters as a temporal list join: every capture against the list entries active when it was fetched.

A list is a log of dated entries (list, action, pattern, day, op): ``op`` adds a pattern to a list or removes it
from the day on. Per list, action and pattern the log becomes validity intervals; of several entries on one day a
removal wins. A pattern is a domain (it holds for the host and its subdomains) or ``host/segment/...`` (it holds
for the paths of exactly that host below it). A capture offers all patterns it could meet, a few per URL, and an
equality join on (pattern, period) with an interval condition finds those active on its day; intervals are cut
into periods, so that a pattern that was switched often meets only the switches near a capture's day. Only patterns of
the lengths (labels of a domain, segments of a path) that some entry has are offered: others could meet nothing, and a
URL of any length offers no more patterns than the lists have lengths.

Of the active patterns the longest decides; where lists disagree on it, ``block`` wins.

Defined results: null or unparsable URLs and null days match nothing (verdict ``none``); entries with a null in
any field or an unknown op are ignored; repeated captures get the same row each; without entries every verdict is
``none``. URLs may be of any length. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantaloom.llm.common import fresh, let
from quantaloom.session import broadcast_if_small

PERIOD_DAYS = 32
LAST_DAY = 2**31 - 1
INTERVAL_BYTES = 160


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot; null where there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    host = F.regexp_replace(F.lower(F.regexp_replace(authority, r"^.*@", "")), r":[0-9]*$", "")
    return F.nullif(F.regexp_replace(host, r"\.$", ""), F.lit(""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def _counts(values: list[int]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<int>")


def lengths_of(patterns: DataFrame) -> tuple[list[int], list[int]]:
    """How many labels the domains among the patterns have, and how many segments the paths; each count once."""
    segments, labels = [F.size(F.split("pattern", sign)) for sign in ("/", r"\.")]
    found = patterns.select((segments - 1).alias("s"), F.when(segments == 1, labels).alias("l")).distinct().collect()
    return sorted(r["l"] for r in found if r["s"] == 0), sorted({r["s"] for r in found if r["s"] > 0})


def patterns_of(url: Column, labels: list[int], segments: list[int]) -> Column:
    """The patterns that a URL meets: suffixes of its host with as many labels as given, and the host with prefixes of
    its path with as many segments as given."""

    def suffixes(own: Column) -> Column:
        fitting = F.filter(_counts(labels), lambda n: n <= F.size(own))
        return F.transform(fitting, lambda n: F.array_join(F.slice(own, F.size(own) - n + 1, n), "."))

    def prefixes(own: Column) -> Column:
        fitting = F.filter(_counts(segments), lambda n: n <= F.size(own["parts"]))
        beginning = lambda n: F.array_join(F.slice(own["parts"], F.lit(1), n), "/")
        return F.transform(fitting, lambda n: F.concat(own["host"], F.lit("/"), beginning(n)))

    parts = F.filter(F.split(path_of(url), "/"), lambda p: p != "")
    paths = let(F.struct(host_of(url).alias("host"), parts.alias("parts")), prefixes)
    return F.concat(let(F.split(host_of(url), r"\."), suffixes), paths)


def validity(entries: DataFrame) -> DataFrame:
    """The log as intervals: list, action, pattern, since (inclusive), until (exclusive)."""
    key = ["list", "action", "pattern"]
    clean = entries.select(*key, F.col("day").cast("int").alias("day"), "op").dropna()
    daily = clean.where(F.col("op").isin("add", "remove")).groupBy(*key, "day").agg(F.max("op").alias("op"))
    until = F.coalesce(F.lead("day").over(Window.partitionBy(*key).orderBy("day")), F.lit(LAST_DAY))
    spans = daily.select(*key, F.col("day").alias("since"), until.alias("until"), "op")
    return spans.where(F.col("op") == "add").drop("op")


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Per capture (page_id, url, day): these, verdict, pattern, lists (that decide), n_active."""
    caps = captures.select("page_id", "url", F.col("day").cast("int").alias("day"))
    range_ = caps.agg(F.min("day").alias("first"), F.max("day").alias("last")).first()
    first, last = (range_["first"] or 0), (range_["last"] or 0)
    lists = validity(entries).where((F.col("since") <= last) & (F.col("until") > first))
    period = lambda day: F.floor(day / PERIOD_DAYS).cast("int")
    low, high = F.greatest("since", F.lit(first)), F.least(F.col("until") - 1, F.lit(last))
    lists = lists.withColumn("period", F.explode(F.sequence(period(low), period(high))))
    keyed = caps.dropna().distinct().select("*", F.explode(patterns_of(F.col("url"), *lengths_of(lists))).alias("pattern"), period(F.col("day")).alias("period"))
    met = keyed.join(broadcast_if_small(lists, INTERVAL_BYTES), ["pattern", "period"])
    met = met.where((F.col("since") <= F.col("day")) & (F.col("day") < F.col("until")))
    # longest pattern first, then block before allow
    rank = F.struct(F.length("pattern").alias("length"), "pattern", "action")
    decided = met.groupBy("page_id", "url", "day").agg(F.max(rank).alias("best"), F.collect_set(F.struct("pattern", "action", "list")).alias("all"))
    best = F.col("best")
    lists_of = F.filter("all", lambda e: (e["pattern"] == best["pattern"]) & (e["action"] == best["action"]))
    decided = decided.select(
        F.col("page_id").alias("p"),
        F.col("url").alias("u"),
        F.col("day").alias("d"),
        best["action"].alias("verdict"),
        best["pattern"].alias("pattern"),
        F.array_join(F.array_sort(F.transform(lists_of, lambda e: e["list"])), ",").alias("lists"),
        F.size("all").cast("long").alias("n_active"),
    )
    same = (F.col("page_id") == F.col("p")) & (F.col("url") == F.col("u")) & (F.col("day") == F.col("d"))
    return caps.join(decided, same, "left").select(
        "page_id",
        "url",
        "day",
        F.coalesce("verdict", F.lit("none")).alias("verdict"),
        "pattern",
        "lists",
        F.coalesce("n_active", F.lit(0).cast("long")).alias("n_active"),
    )


def admitted(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """The captures, all columns kept, that no list blocks on their day."""
    blocked = judge(captures, entries).where(F.col("verdict") == "block").select("page_id", "url", "day").distinct()
    names = {c: fresh(captures.columns, f"blocked_{c}") for c in blocked.columns}
    blocked = blocked.select(*[F.col(c).alias(n) for c, n in names.items()])
    same = (captures["page_id"] == blocked[names["page_id"]]) & (captures["url"] == blocked[names["url"]])
    return captures.join(blocked, same & (captures["day"].cast("int") == blocked[names["day"]]), "left_anti")
