"""URL filters: dated list entries as validity intervals, and an as-of join.

An entry holds from its date until the next entry of its key. Keys are hosts
and the domains above them. Every capture looks up its host and all domains
above it with two labels at least, each as of the time of the fetch; the most
specific entry that is active decides.

Only DataFrame functions are used. Lookups and entries of a key stand in one
order of days, and each lookup takes the last entry before it; so the list is
never multiplied by time. A key with very many captures is dealt to salts, and
a key's entries, one a day at most, are repeated for the salts that it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How many parts the captures of a key are dealt to at most.
SALTS = 64
#: The end of intervals that nothing ends.
FOREVER = "9999-12-31"

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@\[\]]+)"
#: Hosts that are addresses: they have no domains above them.
ADDRESS = r"^(\[.*|[0-9]+(\.[0-9]+){3})$"


def host(url: Column) -> Column:
    """The lower-case host of a URL, without a dot at its end; null if there is none."""
    found = F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.+$", "")
    return F.when(found != "", found)


def domains(name: Column) -> Column:
    """A host and the domains above it with two labels at least, the most specific first; of an address, itself alone."""
    labels = F.split(name, r"\.")
    n = F.size(labels)
    above = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    none = F.array().cast("array<string>")
    return F.when(name.isNull(), none).when(name.rlike(ADDRESS), F.array(name)).otherwise(above)


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(key, action, since, until) of dated entries (key, entry_date, place, action).

    An entry holds from its date up to the day before the next entry of its
    key. Of entries on one day the last place holds, and of those the greatest
    action. An entry whose action is ``remove`` only ends the one before.
    Entries with a null key, date or action are left out.
    """
    whole = entries.select(F.lower("key").alias("key"), "entry_date", "place", "action").dropna(subset=["key", "entry_date", "action"])
    # One entry of a key and day is enough, and found before rows of a key come together.
    last = whole.groupBy("key", F.col("entry_date").alias("since")).agg(F.max(F.struct("place", "action")).alias("e"))
    until = F.lead("since").over(Window.partitionBy("key").orderBy("since"))
    spans = last.select("key", "since", F.col("e.action").alias("action"), F.coalesce(until, F.to_date(F.lit(FOREVER))).alias("until"))
    return spans.where("action <> 'remove'").select("key", "action", "since", "until")


def judge_captures(
    captures: DataFrame,
    entries: DataFrame,
    *,
    url_col: str = "url",
    date_col: str = "fetch_date",
    keep: tuple[str, ...] = (),
    salts: int = SALTS,
) -> DataFrame:
    """Every capture with the entry that was active for it: ``keep``, host, fetch_date, action, matched, since.

    A capture without a host or date, or without an active entry, has nulls in
    the last three. Null, repeated and empty rows each give a row; an empty
    list leaves all captures unmatched. A host of many labels has a lookup for
    each. Columns other than those named are not looked at. ``captures`` must
    give the same rows each time it is read, as files do.
    """
    kept = [F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)]
    rows = captures.select(*kept, host(F.col(url_col)).alias("host"), F.col(date_col).cast("date").alias("fetch_date"))
    rows = rows.withColumn("row_id", F.monotonically_increasing_id())
    looked = rows.select("*", F.posexplode_outer(domains(F.col("host"))).alias("level", "key")).select(
        "*", F.pmod(F.xxhash64("row_id"), F.lit(salts)).cast("int").alias("salt")
    )
    dates = rows.agg(F.max("fetch_date").alias("last"))
    spans = validity_intervals(entries).join(F.broadcast(dates), F.col("since") <= F.col("last")).drop("last")
    slots = looked.where("key is not null").select("key", "salt").distinct()
    entry = F.struct("action", "since", "until")
    lists = spans.join(slots, "key").select("key", "salt", F.col("since").alias("day"), entry.alias("entry"))
    both = looked.withColumn("day", F.col("fetch_date")).unionByName(lists, allowMissingColumns=True)
    # Of one day, the entry comes first. A lookup without a key stands alone with its like, by its salt.
    upto = Window.partitionBy("key", "salt").orderBy("day", F.col("entry").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("entry", F.last("entry", ignorenulls=True).over(upto)).where("row_id is not null")
    active = F.col("key").isNotNull() & (F.col("entry.since") <= F.col("fetch_date")) & (F.col("fetch_date") < F.col("entry.until"))
    looked = found.select("*", *[F.when(active, F.col(f"entry.{c}")).alias(c) for c in ("action", "since")]).drop("entry")
    hit = F.when(F.col("action").isNotNull(), F.struct(-F.col("level"), "action", "key", "since"))
    firsts = [F.first(c).alias(c) for c in ("host", "fetch_date", *(f"keep_{i}" for i in range(len(keep))))]
    return (
        looked.groupBy("row_id")
        .agg(*firsts, F.max(hit).alias("hit"))
        .select(
            *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)],
            "host",
            "fetch_date",
            F.col("hit.action").alias("action"),
            F.col("hit.key").alias("matched"),
            F.col("hit.since").alias("since"),
        )
    )
