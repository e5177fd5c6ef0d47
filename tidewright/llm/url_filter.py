"""URL filters by a temporal list join.

Dated list entries become validity intervals, one per entry and pattern, open to the next entry of the pattern. A pattern is
a domain, with or without a port, and the first steps of a path, if any: ``example.org``, ``example.org:8080/a/b``. A
capture asks for its host and the host's parent domains (an IP address has none), each without and with its port, and each
of these with every prefix of its path; an as-of join over pattern and interval evaluates it against the entries that were
active when it was fetched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


AUTHORITY = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]*)"


def host(url: Column) -> Column:
    """The host in lower case, an IPv6 address with its brackets; empty where there is none."""
    return F.lower(F.regexp_extract(url, AUTHORITY, 2))


def port(url: Column) -> Column:
    return F.regexp_extract(url, AUTHORITY + r":([0-9]+)", 3)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def keys(host: Column, port: Column, path: Column) -> Column:
    """The patterns that a capture asks for."""
    labels, steps = F.split(host, r"\."), F.split(path, "/")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    domains = F.when(F.regexp_like(host, F.lit(r"^(\[|[0-9.]+$)")), F.array(host)).otherwise(parents)
    places = F.when(port == "", domains).otherwise(F.concat(domains, F.transform(domains, lambda d: F.concat(d, F.lit(":"), port))))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))
    return F.array_distinct(F.flatten(F.transform(places, lambda p: F.transform(prefixes, lambda x: F.concat(p, x)))))


def validity(entries: DataFrame) -> DataFrame:
    """pattern, since and until (null: still open) of each stretch in which a pattern is listed.

    ``entries`` has pattern, at and listed (true adds, false removes). Entries of one pattern and time count once, an
    adding one first; rows with a null in any of the three say nothing.
    """
    dated = entries.select("pattern", "at", "listed").dropna().groupBy("pattern", "at").agg(F.max("listed").alias("listed"))
    until = F.lead("at").over(Window.partitionBy("pattern").orderBy("at"))
    return dated.select("pattern", F.col("at").alias("since"), until.alias("until"), "listed").where("listed").drop("listed")


def evaluate(captures: DataFrame, entries: DataFrame, salts: int = 16) -> DataFrame:
    """captures with blocked, pattern (the longest active one, the least on ties) and since (when its entry was made).

    ``captures`` has url and fetched; its other columns stay, but for columns named like the three results, which are
    replaced. Null or malformed urls and null times match nothing; repeated rows each stay; empty tables are fine. Hosts,
    ports, paths and times are made distinct before the join, whose keys are spread over ``salts`` so that a host with a third of
    all captures is not in one task.
    """
    held = [c for c in captures.columns if c not in ("blocked", "pattern", "since")]
    place = [F.coalesce(f(captures["url"]), F.lit("")).alias(f.__name__) for f in (host, port, path)] + [captures["fetched"].alias("at")]
    site = ["host", "port", "path", "at"]
    rows = captures.select(F.struct(*held).alias("capture"), *place)
    sites = captures.select(*place).where("host <> '' and at is not null").distinct()
    asked = sites.withColumn("pattern", F.explode(keys(*[F.col(c) for c in site[:3]]))).withColumn("salt", F.pmod(F.xxhash64(*site), F.lit(salts)).cast("int"))
    spans = validity(entries).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    active = asked.join(spans, ["pattern", "salt"]).where("since <= at and (until is null or at < until)")
    rank = F.struct((-F.length("pattern")).alias("l"), F.col("pattern").alias("pattern"), F.col("since").alias("since"))
    verdict = active.groupBy(*site).agg(F.min(rank).alias("m"))
    out = rows.join(verdict, site, "left")
    return out.select("capture.*", F.col("m").isNotNull().alias("blocked"), F.col("m.pattern").alias("pattern"), F.col("m.since").alias("since"))
