"""JSON documents whose names are looked at one by one."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import keys
from quern.storage import checkpointed


def faults(text: str | None, forbidden: frozenset[str]) -> tuple[list[str], bool, int]:
    """(forbidden names that are there, whether an object has a name twice, how deep the deepest value lies); depth -1 for what is no JSON."""
    found, repeated = set(), False

    def kept(pairs: list[tuple]) -> dict:
        nonlocal repeated
        names = [n for n, _ in pairs]
        repeated |= len(set(names)) < len(names)
        found.update(forbidden.intersection(names))
        return dict(pairs)

    try:
        made = json.loads(text or "", object_pairs_hook=kept)
    except (ValueError, RecursionError):
        return [], False, -1
    depth, level = 0, [made]
    while level := [v for x in level if isinstance(x, dict | list) for v in (x.values() if isinstance(x, dict) else x)]:
        depth += 1
    return sorted(found), repeated, depth


def json_faults(rows: DataFrame, key: str, text: str, forbidden: tuple[str, ...]) -> DataFrame:
    """(key, forbidden, repeated, depth) of each document, as :func:`faults` tells."""
    banned = frozenset(forbidden)

    def run(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in source:
            made = pd.DataFrame([faults(t, banned) for t in part[text]], columns=["forbidden", "repeated", "depth"])
            yield made.assign(**{key: part[key].to_numpy()})[[key, "forbidden", "repeated", "depth"]]

    kind = dict(rows.dtypes)[key]
    return rows.select(key, text).mapInPandas(run, f"{key} {kind}, forbidden array<string>, repeated boolean, depth int")


#: Names are split where a lower-case letter or digit meets a capital, and at what is neither letter nor digit.
_HUMP, _GAP = "(?<=[a-z0-9])(?=[A-Z])", "[^a-z0-9]+"


def name_tokens(name: Column) -> Column:
    """The words of a name, in lower case: ``evalScore_v2`` has eval, score and v2."""
    return F.array_distinct(F.filter(F.split(F.lower(F.regexp_replace(name, _HUMP, "_")), _GAP), lambda x: x != ""))


def walked(rows: DataFrame, key: str, text: str, root: str = "$", most_levels: int = 64) -> DataFrame:
    """(key, path, name, string) of every value below the top of JSON documents; ``string`` is null for others than strings.

    Values are taken apart level by level, all documents at once, by the
    engine's variant functions; a path is ``$.a[0].b``. Text that is no JSON,
    or in which an object has a name twice, has no values here: see
    :func:`unread`. Documents deeper than ``most_levels`` are an error.
    """
    level = rows.select(F.col(key).alias(key), F.lit(root).alias("path"), F.try_parse_json(text).alias("v")).where("v is not null")
    out = None
    for _ in range(most_levels + 1):
        parts = level.lateralJoin(level.sparkSession.tvf.variant_explode(F.col("v").outer()).toDF("_pos", "_name", "_value"))
        place = F.when(F.col("_name").isNull(), F.concat(F.lit("["), F.col("_pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), "_name"))
        level = checkpointed(parts.select(key, F.concat("path", place).alias("path"), F.col("_name").alias("name"), F.col("_value").alias("v")))
        is_text = F.schema_of_variant("v") == "STRING"
        one = level.select(key, "path", "name", F.when(is_text, F.try_variant_get("v", "$", "string")).alias("string"))
        out = one if out is None else out.unionByName(one)
        if level.isEmpty():
            return out
        level = level.drop("name")
    raise ValueError(f"a document has more than {most_levels} levels")


class _Pairs(list):
    """An object's names and values as they stand in the text."""


def repeats(text: str) -> list[tuple[str, str]] | None:
    """(path below the top, name) of names that an object has more than once; None for what is no JSON."""
    try:
        open_, out = [("", json.loads(text, object_pairs_hook=_Pairs))], []
    except (ValueError, RecursionError):
        return None
    while open_:
        path, value = open_.pop()
        if isinstance(value, _Pairs):
            count = Counter(n for n, _ in value)
            out += [(path, n) for n, times in count.items() if times > 1]
            open_ += [(f"{path}.{n}", v) for n, v in value]
        elif isinstance(value, list):
            open_ += [(f"{path}[{i}]", v) for i, v in enumerate(value)]
    return sorted(out)


def unread(rows: DataFrame, key: str, text: str, root: str = "$") -> DataFrame:
    """(key, path, found, kind) of documents that don't parse: ``repeated`` names with their object's path, or ``malformed``.

    Only these are looked at by Python workers.
    """
    bad = rows.where(F.col(text).isNotNull() & F.try_parse_json(text).isNull()).select(F.col(key), F.col(text).alias("_text"))

    def run(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in source:
            made = []
            for k, t in zip(part[key], part["_text"], strict=True):
                found = repeats(t)
                made += [(k, root + p, n, "repeated") for p, n in found] if found else [(k, root, None, "malformed")]
            yield pd.DataFrame(made, columns=[key, "path", "found", "kind"])

    return bad.mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, path string, found string, kind string")


def forbidden_paths(
    rows: DataFrame, key: str, text: str, tokens: tuple[str, ...], exempt: tuple[str, ...] = (), fragments: tuple[str, ...] = (), root: str = "$"
) -> DataFrame:
    """(key, path, found, kind) of what documents must not have.

    ``name``: a name one of whose words is among ``tokens``, unless it is
    ``exempt``; one row for each such word. ``value``: a string that, lower
    case and with every run of other characters than letters and digits as an
    underscore, has one of ``fragments``. ``repeated`` and ``malformed`` as in
    :func:`unread`; a document with either is not looked at further. A null
    document has nothing.
    """
    every = walked(rows, key, text, root)
    own = F.array_intersect(name_tokens(F.col("name")), F.lit(list(tokens)).cast("array<string>"))
    named = every.where(F.col("name").isNotNull() & ~F.col("name").isin(list(exempt))).select(key, "path", F.explode(own).alias("found"))
    plain = keys.path_tokens(F.col("string"))
    held = F.filter(F.lit(list(fragments)).cast("array<string>"), lambda f: F.contains(plain, f))
    valued = every.where("string is not null").select(key, "path", F.explode(held).alias("found"))
    out = named.withColumn("kind", F.lit("name")).unionByName(valued.withColumn("kind", F.lit("value")))
    return out.unionByName(unread(rows, key, text, root))


def require_clean(found: DataFrame, key: str) -> None:
    """Raise with the first findings of :func:`forbidden_paths`, if there are any."""
    if rows := found.orderBy(key, "path").limit(10).collect():
        raise ValueError("forbidden: " + ", ".join(f"{r[key]} {r.path} ({r.kind} {r.found})" for r in rows))
