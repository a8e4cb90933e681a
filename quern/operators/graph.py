"""Connected components and what is built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.digests import ordered_digest
from quern.storage import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); the root is the least node of the component.

    Each round hands a node's greater neighbours, and then its lesser ones, to
    the least of its neighbours, until every component is a star. Rounds grow
    with the logarithm of the size, and each is cut off by a checkpoint.
    """
    loops = edges.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("root"))
    now, mark = checkpointed(edges.select("a", "b").where("a <> b").distinct()), None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        down = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        now = checkpointed(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        new = tuple(now.select(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if new == mark:
            break
        mark = new
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    every = stars.unionByName(stars.select(F.col("root").alias("node"), "root")).unionByName(loops)
    return every.groupBy("node").agg(F.min("root").alias("root"))


def linked_repositories(members: DataFrame, group: str, repository: str) -> DataFrame:
    """(repository, component) of repositories that share duplicates; ``repo:`` and its name for one alone.

    The id is a digest of all names in order, of components of any size.
    """
    pairs = members.select(F.col(group).alias("g"), F.col(repository).alias("r")).distinct()
    first = pairs.groupBy("g").agg(F.min("r").alias("a"))
    edges = pairs.join(first, "g").select("a", F.col("r").alias("b")).distinct()
    found = checkpointed(components(edges))
    digests = ordered_digest(found, ["root"], ["node"], "node")
    ids = digests.join(found.groupBy("root").agg(F.count("*").alias("n")), "root")
    linked = F.concat(F.lit("linked-repos:"), F.substring("digest", 1, 20))
    named = ids.select("root", F.when(F.col("n") > 1, linked).otherwise(F.concat(F.lit("repo:"), "root")).alias("component"))
    return found.join(named, "root").select(F.col("node").alias(repository), "component")


def _quoted(name: Column) -> Column:
    """A string as JSON."""
    made = F.to_json(F.struct(name.alias("x")))
    return F.substring(made, F.lit(6), F.length(made) - 6)


def unit_members(episodes: DataFrame, owner: Column, group: Column, frames: Column) -> DataFrame:
    """(root, owner, grp, episodes, frames): a row for each pair of owner and group, with the unit that both are in.

    Episodes are counted first, so that what comes together in a unit is a row for each pair.
    """
    rows = episodes.select(owner.cast("string").alias("owner"), group.cast("string").alias("grp"), frames.cast("long").alias("frames"))
    rows = rows.groupBy("owner", "grp").agg(F.count("*").alias("episodes"), F.sum("frames").alias("frames"))
    edges = rows.select(F.concat(F.lit("owner:"), "owner").alias("a"), F.concat(F.lit("group:"), "grp").alias("b"))
    return rows.withColumn("node", F.concat(F.lit("owner:"), "owner")).join(components(edges), "node").drop("node")


def leakage_units(members: DataFrame) -> DataFrame:
    """(root, unit_id, owners, groups, n_owners, n_groups, episode_count, frame_count) of :func:`unit_members`.

    A unit's id is the digest of the JSON of its owners and groups, each in
    order. The JSON is never there as a whole: its pieces go through a running
    digest, a list's first name without the comma that the others have. The
    lists of owners and groups, in order, are a unit's row; where they are not
    asked for, Spark leaves them out and units may be of any size.
    """
    lists = [("owners", "owner", '{"owners":['), ("groups", "grp", '],"validation_groups":[')]
    pieces = None
    for at, (_, name, head) in enumerate(lists):
        own = members.select("root", F.col(name).alias("name")).distinct()
        first = own.groupBy("root").agg(F.min("name").alias("first"))
        text = F.concat(F.when(F.col("name") == F.col("first"), F.lit(head)).otherwise(F.lit(",")), _quoted(F.col("name")))
        one = own.join(first, "root").select("root", F.lit(at).alias("at"), "name", text.alias("text"))
        pieces = one if pieces is None else pieces.unionByName(one)
    ends = members.select("root").distinct().select("root", F.lit(len(lists)).alias("at"), F.lit("").alias("name"), F.lit("]}").alias("text"))
    named = ordered_digest(pieces.unionByName(ends), ["root"], ["at", "name"], "text", "")
    sums = members.groupBy("root").agg(F.sum("episodes").cast("long").alias("episode_count"), F.sum("frames").cast("long").alias("frame_count"))
    of = lambda at: F.col("at") == at
    names = [F.sort_array(F.collect_list(F.when(of(at), F.col("name")))).alias(n) for at, (n, *_) in enumerate(lists)]
    sizes = pieces.groupBy("root").agg(*names, *[F.count_if(of(at)).alias(f"n_{n}") for at, (n, *_) in enumerate(lists)])
    unit_id = F.concat(F.lit("leakage-unit:"), F.substring("digest", 1, 20)).alias("unit_id")
    return named.join(sums, "root").join(sizes, "root").select("root", unit_id, "owners", "groups", "n_owners", "n_groups", "episode_count", "frame_count")
