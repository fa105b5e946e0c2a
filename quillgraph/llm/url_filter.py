"""URL filters by a temporal list join, in DataFrame functions only.

A block list is a history of dated entries (entry, action 'add' or 'remove', listed). An entry is a host,
which covers its subdomains, or a host with a path prefix. An entry's history becomes validity intervals
[from, to); each capture is judged by the entries active when it was fetched.

The as-of join is an equi-join on entry and time bucket: an interval is entered under each bucket of
``BUCKET_DAYS`` days it overlaps (up to the last capture), a capture looks up its candidate entries (its
host's suffixes and its path's prefixes) under the one bucket of its fetch time, and the interval's bounds are
checked in the join. A capture meets at most one interval of an entry, as they don't overlap, so no group
multiplies. Repeated entries of a day are resolved first ('add' wins), which bounds an entry's history by days.

Defined results: a null url, a url without host or a null fetch time matches nothing and is not blocked;
entries with null entry, date or action are left out, unknown actions too; repeated captures each get a row; of
several active entries the longest is named (equal lengths: the first in order); other columns of captures are
left out of the result; empty captures give no rows, an empty list blocks nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import materialize

BUCKET_DAYS = 30
#: Rows of the list (entry, bucket, from, to) that are broadcast; some 100 bytes each.
BROADCAST_ROWS = 200_000
#: Captures that a key may have beside a larger list without being taken for a hot one.
USUAL = 1000
FAR = "9999-12-31"


def host(url: F.Column) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path(url: F.Column) -> F.Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def intervals(entries: DataFrame) -> DataFrame:
    """(entry, from, to): when each entry is in force; ``to`` is exclusive."""
    own = entries.select(F.col("entry").cast("string").alias("entry"), (F.col("action") == "add").alias("on"), F.col("listed").cast("date").alias("from"))
    daily = own.where("entry is not null and entry <> '' and `from` is not null and `on` is not null").groupBy("entry", "from").agg(F.max("on").alias("on"))
    following = F.lead("from").over(Window.partitionBy("entry").orderBy("from"))
    return daily.withColumn("to", F.coalesce(following, F.lit(FAR).cast("date"))).where("on").drop("on")


def _met(asked: DataFrame, spread: DataFrame, broadcast_rows: int) -> DataFrame:
    """``asked`` (entry, bucket, ...) with the intervals (from, to) entered under its key.

    A list of up to ``broadcast_rows`` rows is broadcast. Beside a larger one, keys that many captures ask for (as all
    hosts of a domain do for its suffix) are told by their counts; what the list has of them is broadcast, which is
    bounded by the number of such keys, and the rest is joined by a shuffle in which no key is hot.
    """
    if spread.count() <= broadcast_rows:
        return asked.join(F.broadcast(spread), ["entry", "bucket"])
    counts = materialize(asked.groupBy("entry", "bucket").agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") > max(USUAL, total // broadcast_rows)).select("entry", "bucket")
    often = asked.join(F.broadcast(spread.join(F.broadcast(hot), ["entry", "bucket"])), ["entry", "bucket"])
    return often.unionByName(asked.join(F.broadcast(hot), ["entry", "bucket"], "left_anti").join(spread, ["entry", "bucket"]))


def judge(captures: DataFrame, entries: DataFrame, bucket_days: int = BUCKET_DAYS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(page_id, url, fetched) of ``captures`` with (host, blocked, n_active, rule)."""
    known = entries.where(F.col("action").isin("add", "remove"))
    seen = captures.select(F.col("page_id"), F.col("url").cast("string").alias("url"), F.col("fetched").cast("date").alias("fetched"))
    distinct = seen.groupBy("page_id", "url", "fetched").agg(F.count(F.lit(1)).alias("copies"))
    # scalars: the deepest path of the list, the last fetch
    depth = known.agg(F.max(F.size(F.split("entry", "/")) - 1)).first()[0] or 0
    last = seen.agg(F.max("fetched")).first()[0]
    bucket = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / bucket_days)
    held = intervals(known)
    if last is None:
        held = held.where("false")
    spread = materialize(held.withColumn("bucket", F.explode(F.when(F.col("from") <= F.lit(last), F.sequence(bucket(F.col("from")), bucket(F.least(F.date_sub("to", 1), F.lit(last).cast("date"))))))))
    labels = F.split(F.col("host"), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    steps = F.slice(F.split(F.regexp_replace(path(F.col("url")), r"^/+|/+$", ""), "/"), 1, max(1, depth))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.concat(F.col("host"), F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i), "/")))
    asked = (
        distinct.withColumn("host", host(F.col("url")))
        .where("host <> '' and fetched is not null")
        .select("page_id", "url", "fetched", bucket(F.col("fetched")).alias("bucket"), F.explode(F.array_distinct(F.concat(suffixes, prefixes) if depth else suffixes)).alias("entry"))
    )
    met = _met(asked, spread, broadcast_rows).where((F.col("from") <= F.col("fetched")) & (F.col("fetched") < F.col("to")))
    best = met.groupBy("page_id", "url", "fetched").agg(F.count(F.lit(1)).alias("n_active"), F.min(F.struct(-F.length("entry"), "entry")).alias("first"))
    best = best.select(F.struct("page_id", "url", "fetched").alias("_key"), "n_active", F.col("first.entry").alias("rule"))
    out = distinct.join(best, F.struct("page_id", "url", "fetched").eqNullSafe(F.col("_key")), "left")
    return out.select(
        "page_id", "url", "fetched", host(F.col("url")).alias("host"), F.col("rule").isNotNull().alias("blocked"), F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"), "rule", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_copy")
    ).drop("_copy")
