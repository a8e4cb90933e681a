"""Mixing sources to target weights: hierarchical budgeting.

Documents are the leaves' contents in a tree of domains, languages and
sources. A token budget is handed down the tree in proportion to weights. A
child can't take more than its capacity, which is what its documents hold
times the most epochs; what it can't take goes to its siblings, and only what
they can't take either shows in their parent's capacity and goes to the
parent's siblings.

A leaf takes whole epochs while its budget lasts, and of the next epoch a
prefix in an order seeded by the epoch. The order is that of a digest, so the
prefix is all documents up to a digest, which is found from sums over 4096
parts of the digests' range and from the one part where the budget ends.

Only DataFrame functions are used, and whole numbers only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import WORD, written

LEAF = ("domain", "lang", "source")
#: Hexadecimal digits of a digest that tell its part of the range.
PART = 3
#: Parts that a leaf's documents are dealt to where they meet its budget; a power of two.
SALTS = 128


def words(text: Column) -> Column:
    """How many words a text has; none if it is null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(children: DataFrame, parent: tuple[str, ...], budget: Column, name: str) -> DataFrame:
    """Hand a parent's budget to its children (weight, capacity): column ``name``, rounded down.

    All get the same amount for each unit of weight, but no more than their
    capacity. Children are taken by how soon they are full; each asks what a
    unit would get if all before it were full, and the first that this doesn't
    fill sets the amount for itself and all after it.
    """
    group = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = group.orderBy(F.col("capacity") / F.col("weight"), name[:-7])
    full = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    asked = children.select("*", budget.alias("b"), F.row_number().over(order).alias("at"), full.alias("full"), rest.alias("rest"))
    left = F.greatest(F.col("b") - F.col("full"), F.lit(0))
    first = F.when(left * F.col("weight") < F.col("capacity") * F.col("rest"), F.struct("at", left.alias("spare"), "rest"))
    found = asked.select("*", F.min(first).over(group).alias("unit"))
    share = F.expr("unit.spare * weight div unit.rest")
    # Once one is not filled, none after it is.
    given = F.when(F.col("unit").isNull() | (F.col("at") < F.col("unit.at")), F.col("capacity")).otherwise(share)
    return found.select(*children.columns, F.least(given, F.col("capacity")).cast("long").alias(name))


def leaf_budgets(leaves: DataFrame, share: tuple[int, int], epochs: int, weights: dict[str, Column]) -> DataFrame:
    """(domain, lang, source, tokens, leaf_budget) of leaves (domain, lang, source, tokens).

    The budget is ``share``, a fraction, of all tokens. Weights are whole
    numbers above 0.
    """
    sums = leaves.groupBy(*LEAF).agg(F.sum("tokens").cast("long").alias("tokens")).withColumn("capacity", F.col("tokens") * epochs)
    langs = sums.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity"))
    tops = langs.groupBy("domain").agg(F.sum("capacity").alias("capacity"))
    budget = F.expr(f"(select_total * {share[0]}) div {share[1]}")
    tops = tops.withColumn("weight", weights["domain"].cast("long")).withColumn(
        "select_total", F.expr(f"sum(capacity) over (partition by 0) div {epochs}")
    )
    tops = water_fill(tops, (), budget, "domain_budget").select("domain", "domain_budget")
    langs = langs.withColumn("weight", weights["lang"].cast("long")).join(tops, "domain")
    langs = water_fill(langs, ("domain",), F.col("domain_budget"), "lang_budget").select("domain", "lang", "lang_budget")
    own = sums.withColumn("weight", weights["source"].cast("long")).join(langs, ["domain", "lang"])
    filled = water_fill(own, ("domain", "lang"), F.col("lang_budget"), "source_budget")
    return filled.select(*LEAF, "tokens", F.col("source_budget").alias("leaf_budget"))


def with_leaves(rows: DataFrame, plan: DataFrame, small: bool = False) -> DataFrame:
    """Rows (LEAF, name, ...) with their leaf's plan.

    A plan that is known to be small is sent to all tasks, and the rows stay
    where they are. Otherwise the plan, a row for each leaf, is repeated for
    each salt.
    """
    if small:
        return rows.join(F.broadcast(plan), list(LEAF))
    salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    # Never null by its type, so no filter comes between and the exchange of the items is used again.
    dealt = rows.withColumn("salt", F.xxhash64("name").bitwiseAND(F.lit(SALTS - 1).cast("long")))
    return dealt.join(salted, [*LEAF, "salt"]).drop("salt")


class Mix:
    def __init__(
        self,
        docs: DataFrame,
        *,
        domain: Column,
        weights: dict[str, Column],
        share: tuple[int, int] = (4, 5),
        epochs: int = 2,
        seed: int = 23,
        id_col: str = "doc_id",
        text_col: str = "text",
        lang_col: str = "lang",
        source_col: str = "source",
        broadcast_leaves: int = 100_000,
    ):
        self.columns, self.seed = docs.columns, seed
        none = F.lit("(none)")
        digest = F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))
        name = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), digest)
        made = {
            "domain": F.coalesce(domain, none),
            "lang": F.coalesce(F.col(lang_col), none),
            "source": F.coalesce(F.col(source_col), none),
        }
        self.rows = docs.select(
            F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
            *[c.alias(k) for k, c in made.items()],
            F.col(id_col).cast("long").alias("doc_id"),
            words(F.col(text_col)).alias("tokens"),
            name.alias("name"),
        )
        slim = self.rows.select(*LEAF, "tokens", "name")
        # Equal rows are one item of all their tokens; they are taken or left together.
        items = slim.groupBy(*LEAF, "name").agg(F.sum("tokens").cast("long").alias("tokens"))
        budgets = leaf_budgets(items, share, epochs, weights)
        plan = budgets.select(
            *LEAF,
            "leaf_budget",
            F.expr("case when tokens > 0 then leaf_budget div tokens else 0 end").alias("full_epochs"),
            F.expr("case when tokens > 0 then leaf_budget % tokens else 0 end").alias("rest"),
        )
        # Written, so that its size is known before whole rows are joined with it.
        self.plan = written(self.cutoffs(items, plan))
        self.small = self.plan.count() <= broadcast_leaves

    def digest(self) -> Column:
        """Where a document stands in the order of its leaf's last epoch."""
        return F.md5(F.concat_ws(":", F.lit(str(self.seed)), F.col("full_epochs").cast("string"), F.col("name")).cast("binary"))

    def cutoffs(self, items: DataFrame, plan: DataFrame) -> DataFrame:
        """The plan with ``cutoff``: a leaf's last epoch takes the digests up to it."""
        placed = with_leaves(items, plan.where("rest > 0")).select(*LEAF, "rest", "tokens", self.digest().alias("h"))
        part = F.substring("h", 1, PART)
        parts = placed.groupBy(*LEAF, "rest", part.alias("part")).agg(F.sum("tokens").alias("held"))
        upto = F.sum("held").over(Window.partitionBy(*LEAF).orderBy("part"))
        ends = (
            parts.select(*LEAF, "rest", "part", "held", upto.alias("upto"))
            .where("upto > rest and upto - held <= rest")
            .select(*LEAF, "part", (F.col("rest") - F.col("upto") + F.col("held")).alias("room"))
        )
        inside = placed.withColumn("part", part).join(ends, [*LEAF, "part"])
        so_far = F.sum("tokens").over(Window.partitionBy(*LEAF, "part").orderBy("h").rowsBetween(Window.unboundedPreceding, 0))
        last = inside.select(*LEAF, "part", "h", "room", so_far.alias("so_far")).groupBy(*LEAF, "part")
        cut = last.agg(F.max(F.when(F.col("so_far") <= F.col("room"), F.col("h"))).alias("h")).select(
            *LEAF, F.coalesce("h", "part").alias("cutoff")
        )
        return plan.join(cut, list(LEAF), "left").select(*LEAF, "leaf_budget", "full_epochs", F.coalesce("cutoff", F.lit("")).alias("cutoff"))

    def taken(self) -> DataFrame:
        """Every row with ``copies``, how many epochs take it, where that is 1 at least."""
        copies = F.col("full_epochs") + (self.digest() <= F.col("cutoff")).cast("long")
        return with_leaves(self.rows, self.plan, self.small).withColumn("copies", copies).where("copies > 0")


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """One row for each document that the mix takes: doc_id, domain, lang, source, tokens, leaf_budget, copies.

    ``options`` are those of :class:`Mix`: the domain of a row and the weights
    of domains, languages and sources, each as a column; the budget as a
    fraction of all tokens; the most epochs; the seed; and up to how many
    leaves their plan is sent to all tasks, 100,000 by default, rather than
    joined by a shuffle.

    A null domain, language or source is a leaf of its own, ``(none)``. Null
    and empty texts have no tokens; they are taken with the prefix they stand
    in. Repeated rows are taken or left together. A text of more tokens than
    its leaf's rest ends the prefix. An empty table gives an empty result.
    """
    return Mix(docs, **options).taken().select("doc_id", *LEAF, "tokens", "leaf_budget", "copies")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each once for every epoch that takes it; columns stay as they are."""
    made = Mix(docs, **options)
    rows = made.taken().select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("epoch"))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in made.columns])
