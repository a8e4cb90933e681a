"""A trie of conversations: which beginnings they share, and what it saves to keep each once.

A conversation's prefixes are told by chained SHA-256 digests. Every prefix is
exploded, prefixes are grouped by depth and digest into nodes, and each node
is exploded to its ancestors, where what it adds is summed.

So that neither a long conversation nor the sum over its ancestors is one
task's or grows with the square of its length, conversations are cut into
blocks of 32 turns. A block has its own chain, started anew, and the block's
first digest, the *top*, is chained from the blocks before it; a prefix's
digest is that of its block's top and of its place in the block's chain. Sums
climb in two strides: each node to the ancestors in its own block and to the
top, each top to the tops above it, and what a top has in all goes to the
nodes of the block above.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import checkpointed
from quern.operators.digests import ordered_digest

#: Turns of a block, as a power of two.
BLOCK_BITS = 5
BLOCK = 1 << BLOCK_BITS
#: Ids that are joined into one piece of an ends list, as a power of two.
PIECE_BITS = 12
#: A conversation is rebuilt from so many of its neighbour's turns at most.
MOST_HEAD = 8
NOTHING = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def _sha(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


def _root() -> Column:
    return _sha(F.lit(b""))


def placed_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, said, bytes): a digest of role and text in place of them, with the turn's place from 1.

    Turns are numbered within 64 turn numbers at a time and these are added
    up, so that a conversation is in one task with a row for each 64 at most.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = _sha(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        said.alias("said"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    turns = turns.withColumn("shelf", F.coalesce(F.shiftright("turn", 6), F.lit(-(1 << 62))))
    order = Window.partitionBy("conv_id", "shelf").orderBy(F.col("turn").asc_nulls_first(), "role", "said")
    sizes = turns.groupBy("conv_id", "shelf").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("shelf").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("conv_id", "shelf", F.coalesce(before, F.lit(0)).alias("start"))
    numbered = turns.withColumn("n", F.row_number().over(order)).join(starts, ["conv_id", "shelf"])
    return numbered.select("conv_id", (F.col("start") + F.col("n")).alias("place"), "said", "bytes")


def rebuilt_turns(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, turns, place, said, bytes) of rebuilt conversations, and (conv_id, turns) of all, turnless ones too.

    Conversation c is the first h turns of conversation c - c % 5, then its own
    without its first h, where h is crc32(c) % 9.
    """
    own = placed.groupBy("conv_id").agg(F.max("place").alias("own"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_HEAD + 1)
    own = own.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % 5)
    bases = own.select(F.col("conv_id").alias("base"), F.least("own", F.lit(MOST_HEAD).cast("long")).alias("has"))
    head = F.least("h", F.coalesce("has", F.lit(0).cast("long")))
    convs = own.join(bases, "base", "left").select(
        "conv_id", "base", "h", head.alias("head"), (head + F.greatest(F.col("own") - F.col("h"), F.lit(0).cast("long"))).alias("turns")
    )
    tails = placed.join(convs.drop("base"), "conv_id").where("place > h")
    tails = tails.select("conv_id", "turns", (F.col("place") - F.col("h") + F.col("head")).alias("place"), "said", "bytes")
    first = placed.where(F.col("place") <= MOST_HEAD).withColumnRenamed("conv_id", "base")
    heads = first.join(convs, "base").where("place <= head").select("conv_id", "turns", "place", "said", "bytes")
    return heads.unionByName(tails), convs.select("conv_id", "turns")


def blocks(turns: DataFrame) -> DataFrame:
    """(conv_id, turns, block, top, tops, digests, bytes): a block's prefixes, its top and the tops down to it."""
    said = F.array_sort(F.collect_list(F.struct("place", "said", "bytes"))).alias("said")  # no more than a block's turns
    block = F.shiftright(F.col("place") - 1, BLOCK_BITS).alias("block")
    cut = turns.groupBy("conv_id", block).agg(said, F.max("turns").alias("turns"))
    step = lambda acc, x: F.array_append(acc, _sha(F.concat(F.element_at(acc, -1), x)))
    chain = F.aggregate("said.said", F.array(F.lit(b"")), step)
    cut = cut.select("conv_id", "turns", "block", F.slice(chain, 2, BLOCK).alias("chain"), F.col("said.bytes").alias("bytes"))
    full = cut.where((F.size("chain") == BLOCK) & (F.col("turns") > (F.col("block") + 1) * BLOCK))
    ends = full.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", F.element_at("chain", -1).alias("end")))).alias("ends"))
    tops = ends.select("conv_id", F.aggregate("ends.end", F.array(_root()), step).alias("all"))
    tops = tops.select("conv_id", "all", F.posexplode("all").alias("at", "top")).where("at > 0")
    tops = tops.select("conv_id", F.col("at").cast("long").alias("block"), "top", F.slice("all", F.lit(1), F.col("at") + 1).alias("tops"))
    later = cut.where("block > 0").join(tops, ["conv_id", "block"])
    both = cut.where("block = 0").withColumns({"top": _root(), "tops": F.array(_root())}).unionByName(later)
    digests = F.transform("chain", lambda x: _sha(F.concat(F.col("top"), x)))
    return both.select("conv_id", "turns", "block", "top", "tops", digests.alias("digests"), "bytes")


def prefix_rows(cut: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each prefix of each conversation, the empty one too.

    ``chain`` is the digests from the block's first to the prefix's own. The
    last of a block is the next one's top, and has ``tops``, down to itself.
    """
    inner = cut.select("conv_id", "turns", "block", "top", "tops", "digests", "bytes", F.posexplode("digests").alias("at", "digest"))
    whole = F.col("at") == BLOCK - 1
    inner = inner.select(
        "conv_id",
        "turns",
        (F.col("block") * BLOCK + F.col("at") + 1).alias("depth"),
        "digest",
        F.when(F.col("at") > 0, F.get("digests", F.col("at") - 1)).otherwise(F.col("top")).alias("parent"),
        "top",
        F.slice("digests", F.lit(1), F.col("at") + 1).alias("chain"),
        F.when(whole, F.array_append("tops", F.col("digest"))).alias("tops"),
        F.get("bytes", F.col("at")).alias("bytes"),
    )
    none = F.lit(None).cast("binary")
    top = convs.select(
        "conv_id",
        "turns",
        F.lit(0).cast("long").alias("depth"),
        _root().alias("digest"),
        none.alias("parent"),
        none.alias("top"),
        F.array(_root()).alias("chain"),
        F.array(_root()).alias("tops"),
        F.lit(0).cast("long").alias("bytes"),
    )
    return inner.unionByName(top)


def nodes(prefixes: DataFrame) -> DataFrame:
    """Prefixes grouped by depth and digest; all that hangs on the digest is grouped by too, so that numbers alone are aggregated."""
    return prefixes.groupBy("depth", "digest", "parent", "top", "chain", "tops").agg(
        F.count("*").alias("n_convs"),
        F.min("conv_id").alias("conv_id"),
        F.max("bytes").alias("bytes"),
        F.max(F.col("turns") > F.col("depth")).alias("goes_on"),
    )


def with_own_sums(found: DataFrame) -> DataFrame:
    """Nodes with ``n_children``, what their own block adds (leaves, saved), and, for tops, what the block below adds."""
    leaf = F.when(F.col("goes_on"), 0).otherwise(1).cast("long")
    kept = found.withColumns({"leaf": leaf, "save": (F.col("n_convs") - 1) * F.col("bytes")})
    up = F.concat(
        F.transform("chain", lambda d: F.struct(d.alias("digest"), F.lit(False).alias("below"), d.eqNullSafe(F.col("parent")).alias("child"))),
        F.when(F.col("top").isNotNull(), F.array(F.struct(F.col("top").alias("digest"), F.lit(True).alias("below"), (F.col("parent") == F.col("top")).alias("child")))).otherwise(
            F.array().cast("array<struct<digest:binary,below:boolean,child:boolean>>")
        ),
    )
    rows = kept.select("leaf", "save", F.inline(up))
    part = lambda name, below: F.sum(F.when(F.col("below") == below, F.col(name)).otherwise(0))
    sums = rows.groupBy("digest").agg(
        F.sum(F.col("child").cast("long")).alias("n_children"),
        part("leaf", False).alias("leaves"),
        part("save", False).alias("saved"),
        part("leaf", True).alias("leaves_below"),
        part("save", True).alias("saved_below"),
    )
    whole = F.when(F.col("tops").isNotNull() & F.col("top").isNotNull(), F.slice("chain", 1, BLOCK - 1)).alias("chain")
    return found.select("depth", "digest", "parent", "n_convs", "conv_id", whole, "tops").join(sums, "digest")


def from_blocks_below(found: DataFrame) -> DataFrame:
    """(digest, more_leaves, more_saved): what blocks below a node's own add to it."""
    tops = found.where("tops is not null")
    totals = (
        tops.select("leaves_below", "saved_below", F.explode("tops").alias("digest"))
        .groupBy("digest")
        .agg(F.sum("leaves_below").alias("more_leaves"), F.sum("saved_below").alias("more_saved"))
    )
    held = tops.select("digest", "chain").join(totals, "digest")
    rows = held.select("more_leaves", "more_saved", F.explode(F.array_append(F.coalesce("chain", F.array().cast("array<binary>")), F.col("digest"))).alias("digest"))
    return rows.groupBy("digest").agg(F.sum("more_leaves").alias("more_leaves"), F.sum("more_saved").alias("more_saved"))


def ends_digests(cut: DataFrame, convs: DataFrame) -> DataFrame:
    """(digest, ends_sha256) of the nodes where conversations end: their ids in order, joined by commas.

    Ids meet in pieces of 4096 numbers first, and a node's pieces go one after
    the other through a running digest.
    """
    last = F.element_at("digests", -1)
    ended = cut.where((F.col("block") + 1) * BLOCK >= F.col("turns")).select(last.alias("digest"), "conv_id")
    ended = ended.unionByName(convs.where("turns = 0").select(_root().alias("digest"), "conv_id"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids")
    pieces = ended.groupBy("digest", F.shiftright("conv_id", PIECE_BITS).alias("piece")).agg(ids)
    return ordered_digest(pieces, ["digest"], ["piece"], "ids", ",", name="ends_sha256")


def trie(conversations: DataFrame) -> DataFrame:
    """One row for each node of the rebuilt conversations' trie.

    conv_id, the smallest member; depth; parent_conv_id; n_convs, members;
    n_children; n_leaves of the subtree; saved_tokens, its bytes that members
    after the first repeat; ends_sha256 of the members that end there.

    Turns without a conv_id belong to no conversation. A null role or text is
    empty; null turn numbers come first; equal ones go by role and then by the
    digest of what is said, so repeated rows are turns of their own. An empty
    table has no root and gives no rows. Columns of other names are not looked
    at. Texts are read whole, however long, and don't travel. The first stride
    takes time in proportion to the turns, the second to the square of a
    conversation's blocks of 32.
    """
    placed = checkpointed(placed_turns(conversations))
    turns, convs = rebuilt_turns(placed)
    convs = checkpointed(convs)
    cut = checkpointed(blocks(turns))
    found = checkpointed(with_own_sums(nodes(prefix_rows(cut, convs))))
    parents = found.select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = found.join(from_blocks_below(found), "digest", "left").join(ends_digests(cut, convs), "digest", "left").join(parents, "parent", "left")
    more = lambda own, name: (F.col(own) + F.coalesce(name, F.lit(0))).cast("long")
    return out.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        more("leaves", "more_leaves").alias("n_leaves"),
        more("saved", "more_saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
    )
