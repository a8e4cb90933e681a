"""Joins and set comparisons that keep both sides in view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.sampling import numbered_in_groups


def coverage(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Every key with the side that has it: ``both``, ``missing`` (only a) or ``extra`` (only b)."""
    x, y = a.select(key).distinct().withColumn("in_a", F.lit(True)), b.select(key).distinct().withColumn("in_b", F.lit(True))
    side = F.when(F.col("in_a").isNull(), "extra").when(F.col("in_b").isNull(), "missing").otherwise("both")
    return x.join(y, key, "full").select(key, side.alias("side"))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b).withColumn("side", F.lit("a")).unionByName(b.subtract(a).withColumn("side", F.lit("b")))


def overlap(rows: DataFrame, key: str | Column, side: str) -> DataFrame:
    """How many keys stand on both sides, of how many."""
    sides = rows.groupBy((F.col(key) if isinstance(key, str) else key).alias("k")).agg(F.count_distinct(side).alias("sides"))
    return sides.agg(F.count_if(F.col("sides") > 1).alias("overlap"), F.count("*").alias("keys"))


#: Passages without an inner word are met by so many of their characters, or by all if there are fewer.
START = 8
#: Characters on both sides of white space that a short passage with white space is met by.
BEFORE, AFTER = 2, 3
#: White space, as in a regular expression's brackets.
SPACE = r" \t\n\r\f\x0B"


def contained_in(docs: DataFrame, passages: DataFrame, broadcast_rows: int = 100_000) -> DataFrame:
    """(doc_id, item_id) of documents whose text contains a passage.

    A passage's second word is a whole word of every text that contains the
    passage, with white space on both sides. So passages of three words or
    more meet the documents' distinct words by an equi-join on the longest of
    their inner words, and only then are texts compared. The others, short
    ones or those of a script without spaces, meet the texts' distinct runs of
    some characters, around white space if they have any, in the same way. Documents
    are told by their ids until then; a list of passages that is small is sent
    to all tasks. A null id meets no text.
    """
    split = F.split(F.trim("text"), f"[{SPACE}]+")
    small = passages.count() <= broadcast_rows

    def met(keys: DataFrame, lists: DataFrame, on: list[str]) -> DataFrame:
        return keys.join(F.broadcast(lists) if small else lists, on).select("doc_id", "item_id", "passage")

    lists = passages.where("text is not null").select("item_id", F.col("text").alias("passage"), split.alias("w"))
    inner = F.slice("w", 2, F.size("w") - 2)
    longest = F.array_max(F.transform(inner, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    long = lists.where(F.size("w") > 2).select("item_id", "passage", longest.alias("word"))
    words = docs.select("doc_id", F.explode(F.array_distinct(split)).alias("word"))
    found = met(words, long, ["word"])
    # White space in a short passage is white space in the text, so texts are looked at around theirs alone.
    head = F.length(F.regexp_extract("passage", f"^([^{SPACE}]*)", 1))
    at = F.when(head < F.length("passage"), head + 1).otherwise(0)
    # Both sides are of one length or none, so that there are few patterns; each is a pass over the texts.
    before = F.when(at > BEFORE, BEFORE).otherwise(0)
    after = F.when(F.length("passage") - at >= AFTER, AFTER).otherwise(0)
    width = F.least(F.length("passage"), F.lit(START))
    around = F.format_string(f"(?s)(?=(.{{%d}}[{SPACE}].{{%d}}))", before, after)
    anywhere = F.format_string("(?s)(?=(.{%d}))", width)
    part = F.when(at > 0, F.substring("passage", at - before, before + 1 + after)).otherwise(F.substring("passage", F.lit(1), width))
    short = lists.where(F.size("w") <= 2).select(
        "item_id", "passage", F.when(at > 0, around).otherwise(anywhere).alias("pattern"), part.alias("part")
    )
    patterns = [r.pattern for r in short.select("pattern").distinct().collect()]  # four, and START at most
    if patterns:
        # A look ahead at each place, so that time grows with the length and not with its square.
        found_parts = F.array_distinct(F.regexp_extract_all("text", F.col("pattern"), F.lit(1)))
        every = docs.select("doc_id", "text", F.explode(F.lit(patterns)).alias("pattern")).select("doc_id", "pattern", F.explode(found_parts).alias("part"))
        found = found.unionByName(met(every, short, ["pattern", "part"]))
    # Texts come back for what was met alone, by document.
    own = docs.select("doc_id", "text").where("text is not null")
    return found.distinct().join(own, "doc_id").where(F.expr("contains(text, passage)")).select("doc_id", "item_id").distinct()


def coverage_rules(a: DataFrame, b: DataFrame, key: str, *, side: str | None = None, group: str | None = None) -> dict[str, DataFrame]:
    """What keeps a from covering b exactly, by rule: missing in b, extra in b, listed twice in a, and groups of b on several sides of a."""
    sides = coverage(a, b, key)
    rules = {
        "missing": sides.where("side = 'missing'"),
        "extra": sides.where("side = 'extra'"),
        "listed_twice": a.groupBy(key).count().where("count > 1"),
    }
    if side is not None and group is not None:
        both = a.select(key, side).join(b.select(key, group), key)
        rules["straddling"] = both.groupBy(group).agg(F.min(side).alias("x"), F.max(side).alias("y")).where("x <> y")
    return rules


def included(rows: DataFrame, manifest: DataFrame, key: str, include: Column) -> DataFrame:
    """Rows whose manifest row says so; null counts as no."""
    return rows.join(manifest.where(include).select(key), key, "left_semi")


def against_manifest(wanted: DataFrame, manifest: DataFrame, key: str, include: str, reasons: str) -> DataFrame:
    """Wanted keys with ``status``: ``usable``, ``excluded`` with its reasons, or ``unknown`` to the manifest."""
    known = manifest.select(key, include, reasons).withColumn("_known", F.lit(True))
    status = F.when(F.col("_known").isNull(), "unknown").when(F.col(include), "usable").otherwise("excluded")
    none = F.array().cast("array<string>")
    return wanted.join(known, key, "left").select(*wanted.columns, status.alias("status"), F.coalesce(reasons, none).alias("reasons"))


def paired(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value_a, value_b) of two reports with the same keys; a key that only one has raises an error."""
    x = a.select(key, F.col(value).alias(f"{value}_a"), F.lit(True).alias("_a"))
    y = b.select(key, F.col(value).alias(f"{value}_b"), F.lit(True).alias("_b"))
    alone = F.col("_a").isNull() | F.col("_b").isNull()
    checked = F.when(alone, F.raise_error(F.concat(F.lit("only one report has "), F.col(key).cast("string")))).otherwise(F.col(f"{value}_a"))
    return x.join(y, key, "full").select(key, checked.alias(f"{value}_a"), f"{value}_b")


def with_runs(candidates: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """Candidates and the runs of each, with ``status``: ok, missing, extra (a run without a candidate) or repeated."""
    counted = runs.groupBy(key).agg(F.count("*").alias("runs"))
    status = (
        F.when(F.col("runs").isNull(), "missing").when(F.col("_own").isNull(), "extra").when(F.col("runs") > 1, "repeated").otherwise("ok")
    )
    joined = candidates.withColumn("_own", F.lit(True)).join(counted, key, "full")
    return joined.withColumn("status", status).withColumn("runs", F.coalesce("runs", F.lit(0))).drop("_own")


def same_sets(a: DataFrame, b: DataFrame, group: str, key: str) -> DataFrame:
    """(group, n_a, n_b, same_set): whether both have the same keys in a group of ``a``; repeats count.

    Keys are counted and met one by one, so neither a set nor a stand-in for it is gathered.
    """
    per_key = lambda t, name: t.groupBy(group, key).agg(F.count("*").alias(name))
    met = per_key(a, "_a").join(per_key(b, "_b"), [group, key], "full")
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    sums = met.groupBy(group).agg(n("_a").alias("n_a"), n("_b").alias("n_b"), F.every(F.col("_a").eqNullSafe(F.col("_b"))).alias("same_set"))
    return sums.where("n_a > 0")


def placed(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows with ``place``, from 1, in each group; a group of any size is numbered by ranges."""
    return numbered_in_groups(rows, by, order, "place", "_size").drop("_size")


def _sequence_digest(rows: DataFrame, by: list[str], columns: list[str], name: str) -> DataFrame:
    """(by..., ``name``): what equal sequences share: length, and sums of two 64-bit digests of each place and what stands there."""
    one = lambda seed: F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)"))
    return rows.groupBy(*by).agg(F.struct(F.count("*").alias("n"), one(1).alias("x"), one(2).alias("y")).alias(name))


def sequence_evidence(expected: DataFrame, others: dict[str, DataFrame], by: list[str], ident: str, values: list[str]) -> DataFrame:
    """Where tables depart from the expected sequences: (source, by..., ident, expected_place, place, status).

    All are rows (by..., place, ident, values...), as :func:`placed` makes
    them. Groups whose sequences have the same digest are equal and end there.
    Of the others, rows meet by what they are called, the first of a name with
    the first, and so on: ``missing`` and ``extra`` ones are on one side
    alone, ``misplaced`` ones elsewhere, ``changed`` ones have other values,
    and a row may be both. No group is gathered.
    """
    own = [*by, ident, "place", *values]
    digest = ["place", ident, *values]
    nth = F.row_number().over(Window.partitionBy(*by, ident).orderBy("place"))
    base, known = expected.select(*own), _sequence_digest(expected, by, digest, "_e")
    out = None
    for source, rows in others.items():
        rows = rows.select(*own)
        sides = known.join(_sequence_digest(rows, by, digest, "_o"), by, "full").where(~F.col("_e").eqNullSafe(F.col("_o"))).select(*by)
        want, have = (t.join(sides, by, "left_semi").withColumn("_nth", nth) for t in (base, rows))
        want = want.select(*by, ident, "_nth", F.col("place").alias("expected_place"), F.struct(*values).alias("_want"))
        have = have.select(*by, ident, "_nth", "place", F.struct(*values).alias("_have"))
        met = want.join(have, [*by, ident, "_nth"], "full")
        faults = F.array_compact(
            F.array(
                F.when(F.col("expected_place") != F.col("place"), "misplaced"),
                F.when(F.col("expected_place").isNotNull() & F.col("place").isNotNull() & ~F.col("_want").eqNullSafe(F.col("_have")), "changed"),
            )
        )
        status = F.when(F.col("place").isNull(), "missing").when(F.col("expected_place").isNull(), "extra").otherwise(F.array_join(faults, "+"))
        one = met.select(F.lit(source).alias("source"), *by, ident, "expected_place", "place", status.alias("status")).where("status <> ''")
        out = one if out is None else out.unionByName(one)
    return out
