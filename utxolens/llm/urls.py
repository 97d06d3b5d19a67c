"""URL filters with dated list entries: validity intervals and an as-of join, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The kinds of list entries, from the one that matches most to the one that matches least.
KINDS = ("domain", "host", "prefix", "url")


def normalised(url: Column) -> Column:
    """Lower-case scheme and host without user, default port, fragment, or trailing dot of the host; null if there is no host."""
    clean = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.lower(F.regexp_extract(clean, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?:]+)", 1))
    rest = F.regexp_extract(clean, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([/?].*)?$", 1)
    rest = F.when(F.coalesce(rest, F.lit("")) == "", "/").when(rest.startswith("?"), F.concat(F.lit("/"), rest)).otherwise(rest)
    host = F.regexp_replace(host, r"\.+$", "")
    return F.when(host != "", F.struct(host.alias("host"), rest.alias("rest")))


def keys_of(host: Column, rest: Column) -> Column:
    """Every (kind, key) under which a list entry can match a URL: host, each parent domain, each path prefix, and the URL."""
    labels = F.split(host, r"\.")
    path = F.regexp_extract(rest, r"^([^?]*)", 1)
    folders = F.filter(F.split(path, "/"), lambda x: x != "")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("key")))
    prefixes = F.transform(F.sequence(F.lit(0), F.size(folders)), lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(host, F.lit("/"), F.array_join(F.slice(folders, F.lit(1), i), "/")).alias("key")))
    own = F.array(F.struct(F.lit("host").alias("kind"), host.alias("key")), F.struct(F.lit("url").alias("kind"), F.concat(host, rest).alias("key")))
    return F.array_distinct(F.concat(domains, own, prefixes))


def intervals(entries: DataFrame, width: int = 86_400) -> DataFrame:
    """(kind, key, verdict, since, until): when each verdict on a key holds, from dated entries (kind, key, verdict, at).

    Dates are LONG (seconds). An entry holds from its date until the next entry of its key; a null verdict says that the key
    is off the list. Of several entries of a key and date the greatest verdict counts, null if there is no other. Entries
    without key or date, or of other kinds, say nothing. A key with very many entries is spread over spans of `width`: the
    next date is looked up inside the span, then among the first dates of the spans.
    """
    known = entries.filter(F.col("kind").isin(*KINDS) & F.col("key").isNotNull() & F.col("at").isNotNull())
    daily = known.groupBy("kind", "key", F.col("at").cast("long").alias("since")).agg(F.max("verdict").alias("verdict"))
    daily = daily.withColumn("span", F.floor(F.col("since") / width))
    first = daily.groupBy("kind", "key", "span").agg(F.min("since").alias("first"))
    first = first.withColumn("later", F.lead("first").over(Window.partitionBy("kind", "key").orderBy("span"))).drop("first")
    inside = Window.partitionBy("kind", "key", "span").orderBy("since")
    spans = daily.withColumn("next", F.lead("since").over(inside)).join(first, ["kind", "key", "span"])
    return spans.select("kind", "key", "span", "verdict", "since", F.coalesce("next", "later").alias("until"))


def as_of(points: DataFrame, spans: DataFrame, width: int = 86_400, per_window: int = 1_000_000) -> DataFrame:
    """points (kind, key, fetched, and more) with the interval of their key that holds at `fetched`: verdict, since, until.

    An as-of join by sorting: intervals and points of a key and span stand in time order, and each point takes the last
    interval before it. What holds at the start of a span comes from the last intervals of the spans before, one row each.
    A key and span with more than `per_window` points is dealt over several windows, each with all of its intervals.
    """
    state = F.struct("verdict", "since", "until")
    at = points.withColumn("span", F.floor(F.col("fetched") / width))
    last = spans.groupBy("kind", "key", "span").agg(F.max_by(state, "since").alias("last"))
    cells = at.groupBy("kind", "key", "span").agg(F.count("*").alias("asked")).join(last, ["kind", "key", "span"], "full")
    before = Window.partitionBy("kind", "key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = cells.withColumn("state", F.last("last", ignorenulls=True).over(before)).filter("asked > 0 and state is not null")
    carried = carried.select("kind", "key", "span", F.lit(-(2**62)).alias("time"), "state")
    states = spans.select("kind", "key", "span", F.col("since").alias("time"), state.alias("state")).unionByName(carried)

    hot = cells.filter(F.col("asked") > per_window).select("kind", "key", "span", F.ceil(F.col("asked") / per_window).alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    states = states.join(hot, ["kind", "key", "span"], "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("parts")
    dealt = F.pmod(F.xxhash64(*points.columns), parts)
    rows = at.join(hot, ["kind", "key", "span"], "left").withColumn("part", dealt).drop("parts")
    rows = rows.withColumn("time", F.col("fetched")).withColumn("point", F.lit(1)).unionByName(states.withColumn("point", F.lit(0)), allowMissingColumns=True)
    so_far = Window.partitionBy("kind", "key", "span", "part").orderBy("time", "point").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("now", F.last("state", ignorenulls=True).over(so_far)).filter("point = 1")
    rows = rows.filter("now is not null and (now.until is null or fetched < now.until)")
    return rows.select(*points.columns, "now.verdict", "now.since", "now.until")


def judged(captures: DataFrame, entries: DataFrame, width: int = 86_400, per_window: int = 1_000_000) -> DataFrame:
    """capture, host, fetched, verdict, kind, key, since, until, n_active for every row of captures (capture, url, fetched).

    n_active list entries match the URL and hold at its fetch time (LONG seconds); the narrowest kind decides (url, prefix,
    host, domain), then the longest key. Without any, verdict, kind, key, since and until are null; so too for null or
    unusable URLs and null fetch times. Repeated rows come back as often. Empty captures give an empty result, empty entries
    no verdicts; other columns are not read.

    Equal (host, path, time) captures are one row before keys are made, and only keys that the list has (looked up under 32
    salts, since a top-level domain is a key of a third of all rows) go on to the as-of join, where a key with a third of all rows is spread over spans of time and, in a span, over several windows.
    """
    parts = captures.select("capture", F.col("fetched").cast("long").alias("fetched"), normalised(F.col("url").cast("string")).alias("u"))
    parts = parts.select("capture", "fetched", F.col("u.host").alias("host"), F.col("u.rest").alias("rest"))
    distinct = parts.filter("host is not null and fetched is not null").select("host", "rest", "fetched").distinct()
    keyed = distinct.select("host", "rest", "fetched", F.explode(keys_of(F.col("host"), F.col("rest"))).alias("k"))
    keyed = keyed.select("host", "rest", "fetched", F.col("k.kind").alias("kind"), F.col("k.key").alias("key"))
    listed = intervals(entries, width)
    salt, salts = F.pmod(F.xxhash64("host", "rest", "fetched"), F.lit(32)), F.sequence(F.lit(0), F.lit(31)).cast("array<bigint>")
    known = listed.select("kind", "key").distinct().withColumn("salt", F.explode(salts))
    keyed = keyed.withColumn("salt", salt).join(known, ["kind", "key", "salt"], "left_semi").select("host", "rest", "fetched", "kind", "key")
    active = as_of(keyed, listed, width, per_window).filter("verdict is not null")
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    best = F.max(F.struct(rank.alias("rank"), F.length("key").alias("n"), "key", "kind", "verdict", "since", "until")).alias("best")
    found = active.groupBy("host", "rest", "fetched").agg(F.count("*").alias("n_active"), best)
    found = found.select("host", "rest", "fetched", "n_active", "best.verdict", "best.kind", "best.key", "best.since", "best.until")
    out = parts.join(found, ["host", "rest", "fetched"], "left")
    return out.select("capture", "host", "fetched", "verdict", "kind", "key", "since", "until", F.coalesce("n_active", F.lit(0)).alias("n_active"))


def passed(captures: DataFrame, entries: DataFrame, block: str = "block") -> DataFrame:
    """The judged captures whose verdict is not `block`."""
    return judged(captures, entries).filter(~F.col("verdict").eqNullSafe(F.lit(block)))
