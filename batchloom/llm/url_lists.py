"""URL filters as of the fetch time: dated list entries against dated captures.

An entry puts a host (and all hosts below it) on the list or takes it off at a time. Entries of a
host become validity intervals; a capture is looked up under its host and each parent domain, and
the interval that holds its fetch time decides. Intervals are cut at month borders, so the join is
on (host, month) with a short range test behind it, and neither a host with a long history nor one
with a third of all captures multiplies rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Interval rows that are broadcast; more are joined by salted keys.
BROADCAST_ROWS, SALTS = 200_000, 32
_OPEN = "9999-12-31"


def host_of(url: Column) -> Column:
    """The lower-case host of a URL, null without one."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    return F.nullif(F.regexp_replace(found, r"\.+$", ""), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and its parent domains of at least two labels, longest first."""
    labels = F.split(host, r"\.")
    starts = F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1)))
    return F.when(host.isNotNull(), F.transform(starts, lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))


def intervals(entries: DataFrame) -> DataFrame:
    """``entries`` (host, ts, listed boolean) to (host, listed, valid_from, valid_to), valid_to not included.

    Of entries of one host and time the listing wins; entries that change nothing are merged away.
    Rows with a null host or time are left out.
    """
    one = entries.where(F.col("host").isNotNull() & F.col("ts").isNotNull()).groupBy(F.lower("host").alias("host"), "ts").agg(F.max(F.coalesce("listed", F.lit(False))).alias("listed"))
    window = Window.partitionBy("host").orderBy("ts")
    changed = one.withColumn("_was", F.lag("listed", 1, False).over(window)).where(F.col("listed") != F.col("_was"))
    return changed.select("host", "listed", F.col("ts").alias("valid_from"), F.coalesce(F.lead("ts").over(window), F.lit(_OPEN).cast(entries.schema["ts"].dataType)).alias("valid_to"))


def _month(ts: Column) -> Column:
    return F.year(ts) * 12 + F.month(ts)


def filter_captures(captures: DataFrame, entries: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, host, fetched, listed_host, listed_from, blocked) of every capture (key, url, fetched).

    blocked is true if the host or a parent domain is on the list at the time of the fetch;
    listed_host is the longest such domain. A capture with a null or hostless URL or a null time
    is not blocked. Repeated captures stay separate rows; either table may be empty. ``fetched``
    and the entries' ``ts`` are both dates or both timestamps. Other columns are not read.
    """
    rows = captures.select(F.col(key), host_of(F.col("url")).alias("host"), "fetched")
    last = rows.agg(F.max("fetched").alias("last")).first()["last"]
    live = intervals(entries).where("listed").where(F.col("valid_from") <= F.lit(last))
    months = F.sequence(_month(F.col("valid_from")), F.greatest(_month(F.col("valid_from")), _month(F.least(F.col("valid_to"), F.lit(last)))))
    cut = live.select(F.col("host").alias("listed_host"), "valid_from", "valid_to", F.explode(months).alias("month"))
    # the answer depends on host and time alone, so each such pair is asked once
    asked = rows.where(F.col("host").isNotNull() & F.col("fetched").isNotNull()).select("host", "fetched").distinct()
    tries = asked.select("host", "fetched", _month(F.col("fetched")).alias("month"), F.posexplode(suffixes(F.col("host"))).alias("depth", "listed_host"))
    on = ["listed_host", "month"]
    if cut.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        cut = F.broadcast(cut)
    else:
        tries = tries.withColumn("salt", F.pmod(F.xxhash64("host", "fetched"), F.lit(SALTS)).cast("int"))
        cut, on = cut.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*on, "salt"]
    hits = tries.join(cut, on).where((F.col("valid_from") <= F.col("fetched")) & (F.col("fetched") < F.col("valid_to")))
    best = hits.groupBy(F.col("host").alias("_host"), F.col("fetched").alias("_fetched")).agg(F.min(F.struct("depth", "listed_host", "valid_from")).alias("hit"))
    # captures without a host or time find nothing: they stay out of the join, where they would meet in one task
    whole = F.col("host").isNotNull() & F.col("fetched").isNotNull()
    found = rows.where(whole).join(best, (F.col("host") == F.col("_host")) & (F.col("fetched") == F.col("_fetched")), "left")
    found = found.unionByName(rows.where(~whole), allowMissingColumns=True)
    return found.select(key, "host", "fetched", F.col("hit.listed_host").alias("listed_host"), F.col("hit.valid_from").alias("listed_from"), F.col("hit").isNotNull().alias("blocked"))
