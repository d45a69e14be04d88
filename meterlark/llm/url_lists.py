"""Operator 4: URL filters from dated lists, by a temporal join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:@\[\]]+)"


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without a final dot, an IP literal in its brackets; null where there is none."""
    return F.nullif(F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(".")), F.lit(""))


def validity(entries: DataFrame) -> DataFrame:
    """Dated entries (list, domain, action `add` or `remove`, at) as intervals (list, domain, from_at, to_at).

    Adding what is listed and removing what is not change nothing.  On one instant a removal counts before
    an addition.  to_at is null while an entry is still listed.  Rows with a null field are ignored; repeated ones count once.
    """
    rows = entries.select("list", F.lower("domain").alias("domain"), "action", "at").where("list is not null and domain is not null and at is not null and action in ('add', 'remove')").distinct()
    own = W.partitionBy("list", "domain").orderBy("at", F.col("action").desc())
    rows = rows.withColumn("_was", F.lag("action").over(own)).where(F.when(F.col("action") == "add", F.coalesce(F.col("_was"), F.lit("remove")) == "remove").otherwise(F.col("_was") == "add"))
    return rows.withColumn("to_at", F.lead("at").over(own)).where("action = 'add'").select("list", "domain", F.col("at").alias("from_at"), "to_at")


def filter_urls(captures: DataFrame, entries: DataFrame, *, id_col: str = "page_id", url_col: str = "url", at_col: str = "fetched_at") -> DataFrame:
    """Each capture against the entries that were listed when it was fetched: id, host, n_entries, matched, blocked.

    An entry matches its domain and all hosts below it.  matched: `list:domain` of the entries active at
    fetch time, sorted, comma-joined.  A null or malformed URL has a null host and matches nothing, as does a null time.
    Repeated captures are judged each and null ids kept; empty tables give empty results or no match; other
    columns are ignored.  Intervals are joined by domain and time; a host that holds any share of the captures
    is first made one row per host and instant, so that its size doesn't reach the join.
    """
    rows = captures.select(F.col(id_col).alias("_id"), host_of(F.col(url_col)).alias("host"), F.col(at_col).alias("_at"))
    spans = validity(entries)
    asked = rows.where("host is not null and _at is not null").select("host", "_at").distinct()
    labels = F.split("host", r"\.")
    keys = asked.select("host", "_at", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("domain"))
    active = keys.join(spans, "domain").where("_at >= from_at and (to_at is null or _at < to_at)")
    found = active.groupBy("host", "_at").agg(F.count(F.lit(1)).alias("n_entries"), F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "list", "domain"))), ",").alias("matched"))
    return rows.join(found, ["host", "_at"], "left").select(
        F.col("_id").alias(id_col), "host", F.coalesce("n_entries", F.lit(0)).cast("long").alias("n_entries"), F.coalesce("matched", F.lit("")).alias("matched"), F.col("n_entries").isNotNull().alias("blocked")
    )
