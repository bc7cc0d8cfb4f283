"""URL filters: dated list entries, evaluated for every capture as of its fetch time.

Entries add a pattern to a list or remove it on a date. They become validity intervals,
half-open, and a capture meets those that hold at its fetch time by an equi-join on the
pattern with a range condition on the time. A pattern is a host, which covers its
subdomains, or a host and leading path segments. Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import cut

HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
PATH = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)"


def host(url: str) -> Column:
    """Lower-case host of a URL column; empty if there is none."""
    return F.lower(F.regexp_extract(url, HOST, 1))


def intervals(entries: DataFrame) -> DataFrame:
    """list_name, pattern, valid_from, valid_to of entries (list_name, pattern, action add or remove, dated).

    An entry holds until the next one of its list and pattern; valid_to is null for the
    last. Of entries of one date, a removal counts last. Entries with nulls are left out.
    """
    known = entries.where("list_name is not null and pattern is not null and dated is not null and action in ('add', 'remove')")
    own = Window.partitionBy("list_name", "pattern").orderBy("dated", "action")
    spans = known.select(
        "list_name", F.lower("pattern").alias("pattern"), "action", F.col("dated").alias("valid_from")
    ).dropDuplicates(["list_name", "pattern", "action", "valid_from"])
    spans = spans.withColumnRenamed("valid_from", "dated").withColumn("valid_to", F.lead("dated").over(own))
    return spans.where("action = 'add' and (valid_to is null or valid_to > dated)").select(
        "list_name", "pattern", F.col("dated").alias("valid_from"), "valid_to"
    )


def patterns_of(url: str) -> Column:
    """All patterns that cover a URL: each of its host's suffixes, alone and with each leading part of its path."""
    labels = F.split(host(url), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    segments = F.filter(F.split(F.lower(F.regexp_extract(url, PATH, 1)), "/"), lambda s: s != "")
    heads = F.when(
        F.size(segments) > 0,
        F.transform(F.sequence(F.lit(1), F.size(segments)), lambda i: F.concat(F.lit("/"), F.concat_ws("/", F.slice(segments, F.lit(1), i)))),
    ).otherwise(F.array().cast("array<string>"))
    heads = F.concat(F.array(F.lit("")), heads)
    return F.array_distinct(F.flatten(F.transform(suffixes, lambda s: F.transform(heads, lambda h: F.concat(s, h)))))


def filter_urls(
    captures: DataFrame,
    entries: DataFrame,
    url_col: str = "url",
    time_col: str = "fetched_on",
    allow_lists: Sequence[str] = ("allow",),
) -> DataFrame:
    """captures with a struct ``url_filter``: blocked, list_name, pattern, active.

    active is the number of list entries that hold for the capture at its fetch time. The
    longest pattern of them decides, of equal ones an allow list, then the first list by
    name; blocked is true if the deciding list is not an allow list. Null or malformed
    URLs, and null times, match nothing and are not blocked. Rows equal in URL and time
    are evaluated once; every row of captures is returned.
    """
    spans = intervals(entries)
    asked = captures.select(F.col(url_col).alias("__url"), F.col(time_col).alias("__time")).where(
        "__url is not null and __time is not null"
    )
    keyed = asked.distinct().select("*", F.explode(patterns_of("__url")).alias("pattern"))
    holds = (F.col("__time") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("__time") < F.col("valid_to")))
    met = keyed.join(spans, "pattern").where(holds)
    order = F.struct(
        (-F.length("pattern")).alias("shorter"), (~F.col("list_name").isin(*allow_lists)).alias("blocked"), "list_name", "pattern"
    )
    found = met.groupBy("__url", "__time").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("active"))
    found = cut(
        found.select(
            "__url", "__time", F.struct("first.blocked", "first.list_name", "first.pattern", "active").alias("__found")
        ),
        "verdicts",
    )
    none = F.struct(
        F.lit(False).alias("blocked"),
        F.lit(None).cast("string").alias("list_name"),
        F.lit(None).cast("string").alias("pattern"),
        F.lit(0).cast("long").alias("active"),
    )
    joined = captures.join(found, (captures[url_col] == F.col("__url")) & (captures[time_col] == F.col("__time")), "left")
    own = [captures[c] for c in captures.columns if c != "url_filter"]
    return joined.select(*own, F.coalesce("__found", none).alias("url_filter"))
