"""URL filters as a temporal list join.

List entries are dated additions and removals of a key: a domain (it and all its subdomains) or a domain with a path
prefix. The host part of a key is taken without case, the path with it. The entries of a key become validity intervals, from an addition to the next removal, held in one row a key. A
capture is evaluated as of its fetch time: its host's suffixes and path prefixes are looked up and a key counts if one of
its intervals holds that time. Captures are reduced to distinct (url, fetch time) first and no interval is joined as a row, so neither a
hot host nor a long list history multiplies rows.

Defined results: a null url or fetch time matches nothing; of entries with one key and time the removal counts last;
entries with a null key or time are ignored, as are actions other than add and remove; repeated captures get the same
result each; an empty list blocks nothing; further columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_side


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def path(url: Column) -> Column:
    """Path without scheme, host, query and fragment; starts with / or is empty."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def keys(url: Column) -> Column:
    """All list keys that would hold for the url: host suffixes of two labels or more, and the host with each path prefix."""
    labels, parts = F.split(host(url), r"\."), F.filter(F.split(path(url), "/"), lambda x: x != "")
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.concat(host(url), F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(suffixes, prefixes))


def intervals(entries: DataFrame) -> DataFrame:
    """entries(key, action, since) -> (key, spans array of struct(since, until)); until is null while the key is listed."""
    name = F.substring_index("key", "/", 1)  # the host; a path keeps its case
    listed = entries.filter("key is not null and since is not null and action in ('add', 'remove')").withColumn("key", F.concat(F.lower(name), F.expr("substring(key, length(substring_index(key, '/', 1)) + 1)")))
    events = listed.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("since", "action"))).alias("e"))
    spans = F.filter(
        F.transform("e", lambda x, i: F.struct(x["since"].alias("since"), F.try_element_at(F.col("e"), i + 2)["since"].alias("until"), x["action"].alias("action"))),
        lambda x: (x["action"] == "add") & (x["until"].isNull() | (x["until"] > x["since"])),
    )
    return events.select("key", spans.alias("spans"))


def url_filter(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """All columns of captures and url_filter: struct(host, n_hits, blocked, first_key)."""
    lists = intervals(entries)
    lists = small_side(lists, lists.count(), 200_000)
    seen = captures.select(F.col(url_col).alias("_url"), F.col(time_col).alias("_time")).filter("_url is not null and _time is not null").distinct()
    hits = seen.withColumn("key", F.explode(keys(F.col("_url")))).join(lists, "key")
    active = F.exists("spans", lambda s: (s["since"] <= F.col("_time")) & (s["until"].isNull() | (F.col("_time") < s["until"])))
    hits = hits.filter(active).groupBy("_url", "_time").agg(F.count(F.lit(1)).alias("_n"), F.min("key").alias("_key"))
    joined = captures.join(hits, (captures[url_col] == hits["_url"]) & (captures[time_col] == hits["_time"]), "left")
    facts = F.struct(host(captures[url_col]).alias("host"), F.coalesce(hits["_n"], F.lit(0)).cast("long").alias("n_hits"), hits["_n"].isNotNull().alias("blocked"), hits["_key"].alias("first_key"))
    return joined.select(*(captures[c] for c in captures.columns if c != "url_filter"), facts.alias("url_filter"))
