"""URL filter lists in time, in DataFrame expressions only.

Lists change: an entry is (list, pattern, day, listed), dated when the pattern
was put on the list or taken off. The entries of one list and pattern become
validity intervals [day, next day), and a capture is judged by the entries that
were active when it was fetched, not by today's list.

Patterns are a host, a domain above it, or a host with a path prefix that ends
at a segment. A capture asks for its own patterns of the depths that the lists
have (a few distinct numbers, looked up first), so the join
is an equi-join on (pattern, month) with the interval as a condition: an
interval is listed in each month it touches (up to the last capture's), a
capture in one. Hot hosts are rows of a plain join, which adaptive execution
splits. The most specific active pattern decides; among equals, allow wins.

Defined cases: a null or malformed url, or a null day, has no patterns and the
decision ``none``; entries with a null are not used; entries of one day count
as listed if any of them is; repeated captures each give a row; an empty list
leaves all ``none``; extra columns are not read, whatever their names; a very
long url costs in proportion to its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONTH = 30


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and a leading ``www.``; empty if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.regexp_replace(host, r"^www\.|\.$", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def patterns_of(host: Column, path: Column, labels_of: list[int], steps_of: list[int]) -> Column:
    """The host and the domains above it (two labels at least), and the host with prefixes of its path.

    Only those of a number of labels or segments that the lists have, so the
    patterns of a very deep path stay few.
    """
    labels = F.split(host, r"\.")
    several = lambda sizes: F.array(*map(F.lit, sizes)) if sizes else F.array().cast("array<int>")
    sizes = F.filter(several(labels_of), lambda n: (n <= F.size(labels)) & ((n > 1) | (F.size(labels) == 1)))
    domains = F.transform(sizes, lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    steps = F.filter(F.split(path, "/"), lambda s: s != "")
    prefixes = F.transform(F.filter(several(steps_of), lambda k: k <= F.size(steps)),
                           lambda k: F.concat(host, F.lit("/"), F.array_join(F.slice(steps, 1, k), "/")))
    return F.when(host != "", F.array_distinct(F.concat(domains, prefixes)))


def depths(entries: DataFrame) -> tuple[list[int], list[int]]:
    """How many labels the hosts of the lists have, and how many segments their paths."""
    segments = F.length("pattern") - F.length(F.replace("pattern", F.lit("/"), F.lit("")))
    labels = F.length("pattern") - F.length(F.replace("pattern", F.lit("."), F.lit(""))) + 1
    found = entries.where("pattern is not null").select(
        (segments > 0).alias("deep"), F.when(segments > 0, segments).otherwise(labels).alias("n")).distinct().collect()
    return sorted(r["n"] for r in found if not r["deep"]), sorted(r["n"] for r in found if r["deep"])


def intervals(entries: DataFrame) -> DataFrame:
    """(list, pattern, from_day, to_day): when each pattern was listed; to_day is null while it still is."""
    daily = (entries.where("list is not null and pattern is not null and day is not null and listed is not null")
             .groupBy("list", "pattern", "day").agg(F.max("listed").alias("listed")))
    own = Window.partitionBy("list", "pattern").orderBy("day")  # a row per day at most
    return (daily.withColumn("to_day", F.lead("day").over(own)).where("listed")
            .select("list", "pattern", F.col("day").alias("from_day"), "to_day"))


def judge(captures: DataFrame, entries: DataFrame, allow_list: str = "allow") -> DataFrame:
    """captures (id, url, day) -> id, url, day, host, n_active, decision, list and pattern that decided."""
    captures = captures.select("id", "url", "day").groupBy("id", "url", "day").agg(F.count("*").alias("copies"))
    captures = captures.withColumn("host", F.coalesce(host_of("url"), F.lit("")))
    asked = (captures.where("day is not null")
             .select("id", "url", "day", F.explode(patterns_of(F.col("host"), path_of("url"), *depths(entries))).alias("pattern"))
             .withColumn("month", F.floor(F.col("day") / F.lit(MONTH))))
    last = F.lit(captures.agg(F.max("day")).first()[0]).cast("int")  # open intervals end with the last capture
    listed = intervals(entries).where(F.col("from_day") <= last)
    until = F.least(F.coalesce(F.col("to_day") - 1, last), last)
    listed = listed.withColumn("month", F.explode(F.sequence(F.floor(F.col("from_day") / F.lit(MONTH)),
                                                             F.floor(until / F.lit(MONTH)))))
    active = (asked.join(listed, ["pattern", "month"])
              .where("day >= from_day and (to_day is null or day < to_day)"))
    allow = (F.col("list") == allow_list).cast("int")
    best = active.groupBy("id", "url", "day").agg(
        F.count("*").alias("n_active"),
        F.max(F.struct(F.length("pattern").alias("length"), allow.alias("allow"), F.col("list"), F.col("pattern"))).alias("best"))
    own = captures.alias("c").join(best.alias("b"), (
        F.col("c.id").eqNullSafe(F.col("b.id")) & F.col("c.url").eqNullSafe(F.col("b.url"))
        & (F.col("c.day") == F.col("b.day"))), "left")
    out = own.select("c.id", "c.url", "c.day", "c.host", F.coalesce("b.n_active", F.lit(0)).cast("long").alias("n_active"),
                     F.when(F.col("b.best").isNull(), "none").when(F.col("b.best.allow") == 1, "allow")
                     .otherwise("block").alias("decision"),
                     F.col("b.best.list").alias("list"), F.col("b.best.pattern").alias("pattern"), "c.copies")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies", "copy")
