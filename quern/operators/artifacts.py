"""Artifacts held against what they were made of: every recorded count is counted again, and what differs is listed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.digests import ordered_digest
from quern.operators.partitions import TRAIN, VALIDATION, fold_audit
from quern.sources import artifacts as source

#: The names that :func:`quern.operators.partitions.fold_audit` gives to an artifact's counts.
_COUNTED = {"duplicate_train_episode_key_count": "duplicate_train_count", "duplicate_validation_episode_key_count": "duplicate_validation_count"}
#: What a pristine split's artifact calls itself, unless a caller's artifacts have another name.
ARTIFACT_TYPE = "checkpoint_pristine_split"
#: Keys that one document of an artifact lists, about.
DOCUMENT_KEYS = 10_000
SCOPES = {"owner": "owner", "repository": "repository_id", "validation_group": "validation_group"}


def manifest_rows(manifest: DataFrame) -> DataFrame:
    """(key, include, owner, repository_id, validation_group, reasons): what a record doesn't say of an episode is told by its key."""
    key = F.col("episode_key")
    repository = F.regexp_replace(key, "/[^/]*$", "")
    reasons = F.col("exclusion_reasons") if "exclusion_reasons" in manifest.columns else F.array()
    return manifest.select(
        key.alias("key"),
        F.coalesce(F.col("include_for_training"), F.lit(False)).alias("include"),
        F.coalesce(F.nullif("owner", F.lit("")), F.split_part(key, F.lit("/"), F.lit(1))).alias("owner"),
        F.coalesce(F.nullif("repository_id", F.lit("")), repository).alias("repository_id"),
        F.coalesce(F.nullif("validation_group", F.lit("")), repository).alias("validation_group"),
        F.coalesce(reasons.cast("array<string>"), F.array().cast("array<string>")).alias("reasons"),
    )


def _long_rows(df: DataFrame, by: list[str], checks: dict[str, Column], value: str) -> DataFrame:
    return df.select(*by, F.inline(F.array(*[F.struct(F.lit(c).alias("check"), x.cast("long").alias(value)) for c, x in checks.items()])))


def recounted(listed: DataFrame, episodes: DataFrame) -> DataFrame:
    """(fold_id, check, recounted): each recorded check of a fold, counted again from (fold_id, side, key) and the episodes to divide."""
    again = fold_audit(listed, episodes, "key", SCOPES)
    sizes = listed.groupBy("fold_id").agg(
        *[F.count_distinct(F.when(F.col("side") == s, F.col("key"))).alias(f"{s}_episode_count") for s in (TRAIN, VALIDATION)]
    )
    checks = {c: F.col(_COUNTED.get(c, c)) for c in (*source.TRUE_CHECKS, *source.ZERO_CHECKS)}
    checks |= {f"{s}_episode_count": F.col(f"{s}_episode_count") for s in (TRAIN, VALIDATION)}
    return _long_rows(again.join(sizes, "fold_id"), ["fold_id"], checks, "recounted")


def fold_findings(artifacts: DataFrame, manifest: DataFrame) -> DataFrame:
    """(fold_id, check, recorded, recounted, ok) of every fold of parsed artifacts, against rows of :func:`manifest_rows`.

    A check is ok if all documents say the same, the count made now agrees,
    and it is what a fold must have: flags that are 1, and no overlap,
    leakage, repeated, missing or unknown key. What isn't recorded, or what a
    fold without keys can't be counted for, is null and not ok.
    """
    now = recounted(source.members(artifacts), manifest.where("include"))
    rows = source.recorded(artifacts).join(now, ["fold_id", "check"], "full")
    must = F.when(F.col("check").isin(*source.TRUE_CHECKS), 1).when(F.col("check").isin(*source.ZERO_CHECKS), 0).otherwise(F.col("recounted"))
    ok = F.coalesce(F.col("alike") & (F.col("recorded") == F.col("recounted")) & (F.col("recorded") == must), F.lit(False))
    return rows.select("fold_id", "check", "recorded", "recounted", ok.alias("ok"))


def header_findings(artifacts: DataFrame, manifest: DataFrame, manifest_sha256: str, schema_version: int = 1) -> DataFrame:
    """(fold_id, check, recorded, recounted, ok), with no fold: what the headers say against the manifest they name.

    All documents must say it; of those that differ, the least is shown. The
    manifest's digest is told by 1 where it agrees.
    """
    n = manifest.agg(
        F.count("*").alias("total"),
        F.count_if("include").alias("included"),
        (F.count("*") - F.count_distinct("key")).alias("repeated"),
    )
    said = source.headers(artifacts)
    same = F.coalesce(F.col("manifest_sha256") == manifest_sha256, F.lit(False)).cast("long")
    checks = {
        "schema_version": (F.col("schema_version"), F.lit(schema_version)),
        "audit_passed": (F.col("passed"), F.lit(1)),
        "all_fold_audits_passed": (F.col("all_fold_audits_passed"), F.lit(1)),
        "manifest_sha256": (same, F.lit(1)),
        "total_record_count": (F.col("total_record_count"), F.col("total")),
        "included_episode_count": (F.col("included_episode_count"), F.col("included")),
        "repeated_manifest_keys": (F.lit(0), F.col("repeated")),
    }
    pairs = F.array(*[F.struct(F.lit(c).alias("check"), a.cast("long").alias("recorded"), b.cast("long").alias("recounted")) for c, (a, b) in checks.items()])
    rows = said.join(F.broadcast(n)).select(F.inline(pairs))
    alike = F.coalesce(F.bool_and(F.col("recorded") == F.col("recounted")), F.lit(False)) & (F.count("recorded") == F.count("*"))
    out = rows.groupBy("check").agg(F.min("recorded").alias("recorded"), F.max("recounted").alias("recounted"), alike.alias("ok"))
    return out.select(F.lit(None).cast("string").alias("fold_id"), "check", "recorded", "recounted", "ok")


def repeated_folds(artifacts: DataFrame) -> DataFrame:
    """Findings, not ok, on fold ids that one document has twice."""
    ids = artifacts.select("artifact_sha256", "path", F.explode("a.folds.fold_id").alias("fold_id"))
    many = ids.groupBy("path", "artifact_sha256", "fold_id").count().where("count > 1")
    return many.groupBy("fold_id").agg(
        F.lit("repeated_fold_id").alias("check"), F.max("count").alias("recorded"), F.lit(1).cast("long").alias("recounted"), F.lit(False).alias("ok")
    )


def findings(artifacts: DataFrame, manifest: DataFrame, manifest_sha256: str) -> DataFrame:
    """All findings on fold artifacts: of headers, of repeated ids and of each fold."""
    heads = header_findings(artifacts, manifest, manifest_sha256)
    return heads.unionByName(repeated_folds(artifacts)).unionByName(fold_findings(artifacts, manifest))


def require_ok(found: DataFrame, what: str) -> None:
    """Raise with the first broken checks, if there are any."""
    broken = found.where(~F.col("ok")).select("fold_id", "check", "recorded", "recounted").orderBy("fold_id", "check").limit(20).collect()
    if broken:
        said = ", ".join(f"{(r.fold_id + ' ') if r.fold_id else ''}{r.check} ({r.recorded}, counted {r.recounted})" for r in broken)
        raise ValueError(f"{what}: {said}")


def audited_fold(artifacts: DataFrame, manifest: DataFrame, manifest_sha256: str, fold_id: str) -> DataFrame:
    """(side, key) of one fold, if the headers and all that is recorded of this fold hold; an error otherwise, or if there is no such fold."""
    one = F.filter("a.folds", lambda f: f["fold_id"] == fold_id)
    own = artifacts.withColumn("a", F.col("a").withField("folds", one))
    if own.where(F.size("a.folds") > 0).isEmpty():
        raise ValueError(f"no fold {fold_id!r}")
    require_ok(findings(own, manifest, manifest_sha256), f"fold {fold_id!r}")
    return source.members(own).select("side", "key")


def fingerprints(rows: DataFrame, by: list[str], key: str = "key", name: str = "fingerprint") -> DataFrame:
    """(by..., ``name``): digest of each group's distinct keys in order, a line each; sets of any size."""
    return ordered_digest(rows.select(*by, key).distinct(), by, [key], key, "\n", trailing=True, name=name)


def pristine_sides(official: DataFrame, manifest: DataFrame) -> DataFrame:
    """(key, side, reasons) of the manifest's episodes and of the official held-out ones (episode_key).

    Held out are those that both the official list and the manifest's
    inclusion name; all other included ones are trained on. Official ones that
    the manifest leaves out are ``excluded``, and ``unknown`` without a record.
    """
    named = official.select(F.col("episode_key").alias("key")).distinct().withColumn("official", F.lit(True))
    side = (
        F.when(F.col("include").isNull(), "unknown")
        .when(F.col("include") & F.col("official").isNotNull(), VALIDATION)
        .when(F.col("include"), TRAIN)
        .when(F.col("official"), "excluded")
    )
    rows = manifest.select("key", "include", "reasons").join(named, "key", "full")
    return rows.select("key", side.alias("side"), "reasons").where("side is not null")


def pristine_audit(official: DataFrame, sides: DataFrame) -> DataFrame:
    """(check, counted) of a split that is made of an official list, in one row for each count."""
    listed = official.agg(F.count("*").alias("official_examples"), F.count_distinct("episode_key").alias("official_episodes"))
    on = lambda s: F.count_if(F.col("side") == s)
    sizes = sides.agg(
        on(TRAIN).alias("train_episodes"), on(VALIDATION).alias("usable_validation"), on("excluded").alias("excluded_official"), on("unknown").alias("unknown_official")
    )
    both = sizes.join(F.broadcast(listed))
    return _long_rows(both, [], {c: F.col(c) for c in both.columns}, "counted")


def pristine_findings(artifacts: DataFrame, manifest: DataFrame, manifest_sha256: str, metadata_sha256: str | None, split_id: str, official_size: int, artifact_type: str = ARTIFACT_TYPE) -> DataFrame:
    """(fold_id, check, recorded, recounted, ok) of a pristine split's artifact, of one document or of several that share their header.

    Headers are told by 1 where they say what they must. The listed held-out
    keys must be official and included, and both sides' fingerprints, made
    again from the manifest, must be those on record. The official list must
    have ``official_size`` episodes and none twice.
    """
    a = F.col("a")
    wanted = {
        "schema_version": a["schema_version"] == 1,
        "artifact_type": a["artifact_type"] == artifact_type,
        "split_id": a["split_id"] == split_id,
        "no_submission_kit": ~a["submission_kit_used"],
        "no_evaluation_data": ~a["evaluation_data_used"],
        "audit_passed": a["audit"]["passed"],
        "manifest_sha256": a["source_manifest"]["sha256"] == manifest_sha256,
        "metadata_sha256": (a["source_train_metadata"]["sha256"] == metadata_sha256) if metadata_sha256 else F.length(a["source_train_metadata"]["sha256"]) > 0,
    }
    as_one = {c: F.min(F.coalesce(x, F.lit(False)).cast("long")) for c, x in wanted.items()}
    heads = artifacts.agg(
        *[x.alias(c) for c, x in as_one.items()],
        F.max(a["continuation_train_fingerprint"]).alias("train_print"),
        F.max(a["usable_validation_fingerprint"]).alias("validation_print"),
        F.max(a["source_manifest"]["included_episode_count"]).alias("included_said"),
    )
    official = artifacts.select(F.explode("a.official_validation_examples").alias("e")).select("e.episode_key")
    listed = artifacts.select(F.explode("a.usable_validation_episode_keys").alias("key")).distinct()
    named = official.distinct().select(F.col("episode_key").alias("key"), F.lit(True).alias("official"))
    rows = manifest.where("include").select("key", F.lit(True).alias("included")).join(listed.withColumn("listed", F.lit(True)), "key", "full").join(named, "key", "left")
    counts = rows.agg(
        F.count("included").alias("included"),
        F.count("listed").alias("usable"),
        F.count_if(F.expr("listed and official is null")).alias("not_official"),
        F.count_if(F.expr("listed and included is null")).alias("not_included"),
    )
    sides = rows.where("included").select("key", F.when(F.col("listed"), VALIDATION).otherwise(TRAIN).alias("side"))
    prints = fingerprints(sides, ["side"]).agg(
        *[F.max(F.when(F.col("side") == s, F.col("fingerprint"))).alias(f"{s}_now") for s in (TRAIN, VALIDATION)]
    )
    sizes = official.agg(F.count("*").alias("examples"), F.count_distinct("episode_key").alias("episodes"))
    one = heads.join(F.broadcast(counts)).join(F.broadcast(prints)).join(F.broadcast(sizes))
    agree = lambda s: F.coalesce(F.col(f"{s}_print") == F.col(f"{s}_now"), F.lit(False))
    checks = {c: (F.col(c), F.lit(1)) for c in wanted} | {
        "official_examples": (F.col("examples"), F.lit(official_size)),
        "official_episodes": (F.col("episodes"), F.lit(official_size)),
        "usable_not_official": (F.lit(0), F.col("not_official")),
        "usable_not_included": (F.lit(0), F.col("not_included")),
        "usable_is_empty": (F.lit(0), F.col("usable") == 0),
        "train_fingerprint": (agree(TRAIN), F.lit(1)),
        "validation_fingerprint": (agree(VALIDATION), F.lit(1)),
        "included_episode_count": (F.col("included_said"), F.col("included")),
    }
    pairs = F.array(*[F.struct(F.lit(c).alias("check"), x.cast("long").alias("recorded"), y.cast("long").alias("recounted")) for c, (x, y) in checks.items()])
    ok = F.coalesce(F.col("recorded") == F.col("recounted"), F.lit(False))
    return one.select(F.inline(pairs)).select(F.lit(None).cast("string").alias("fold_id"), "check", "recorded", "recounted", ok.alias("ok"))


def audited_pristine(artifacts: DataFrame, manifest: DataFrame, manifest_sha256: str, metadata_sha256: str | None, split_id: str, official_size: int, artifact_type: str = ARTIFACT_TYPE) -> DataFrame:
    """(side, key) of a pristine split whose artifact holds; an error otherwise."""
    require_ok(pristine_findings(artifacts, manifest, manifest_sha256, metadata_sha256, split_id, official_size, artifact_type), f"split {split_id!r}")
    listed = artifacts.select(F.explode("a.usable_validation_episode_keys").alias("key")).distinct().withColumn("_held", F.lit(True))
    rows = manifest.where("include").select("key").join(listed, "key", "left")
    return rows.select(F.when(F.col("_held"), VALIDATION).otherwise(TRAIN).alias("side"), "key")


def _dealt(rows: DataFrame, by: list[str], lists: dict[str, Column], document_keys: int) -> DataFrame:
    """(by..., the lists) of rows (key, ...), dealt by digests of their keys to as many documents as keep lists short; null values are left out."""
    documents = 1 + rows.count() // document_keys
    dealt = rows.withColumn("_document", F.pmod(F.xxhash64("key"), F.lit(documents)))
    return dealt.groupBy(*by, "_document").agg(*[F.array_sort(F.collect_list(x)).alias(n) for n, x in lists.items()]).drop("_document")


def fold_documents(listed: DataFrame, manifest: DataFrame, manifest_sha256: str, document_keys: int = DOCUMENT_KEYS) -> DataFrame:
    """(value): the JSON documents of folds (fold_id, side, key), with their audit as it is counted now.

    Nothing is made of a collection in which a fold fails its audit; that is an error.
    """
    again = fold_audit(listed, manifest.where("include"), "key", SCOPES)
    failed = [r.fold_id for r in again.where(~F.col("passed")).select("fold_id").orderBy("fold_id").limit(10).collect()]
    if failed:
        raise ValueError(f"folds fail their audit: {', '.join(map(str, failed))}")
    names = (*source.TRUE_CHECKS, *source.ZERO_CHECKS)
    audits = again.select("fold_id", F.struct(*[F.col(_COUNTED.get(c, c)).alias(c) for c in names]).alias("audit"))
    on = {f"{s}_episode_keys": F.when(F.col("side") == s, F.col("key")) for s in (TRAIN, VALIDATION)}
    sizes = listed.groupBy("fold_id").agg(*[F.count(F.when(F.col("side") == s, F.lit(1))).alias(f"{s}_episode_count") for s in (TRAIN, VALIDATION)])
    summary = F.struct(*[f"{s}_episode_count" for s in (TRAIN, VALIDATION)]).alias("summary")
    n = manifest.agg(F.count("*").alias("total_record_count"), F.count_if("include").alias("included_episode_count"))
    rows = _dealt(listed, ["fold_id"], on, document_keys).join(audits, "fold_id").join(sizes, "fold_id").join(F.broadcast(n))
    document = F.struct(
        F.lit(1).alias("schema_version"),
        F.struct(F.lit(True).alias("passed"), F.lit(True).alias("all_fold_audits_passed")).alias("audit"),
        F.struct(F.lit(manifest_sha256).alias("sha256"), "total_record_count", "included_episode_count").alias("source_manifest"),
        F.array(F.struct("fold_id", "audit", summary, *on)).alias("folds"),
    )
    return rows.select(F.to_json(document).alias("value"))


def pristine_documents(
    official: DataFrame, manifest: DataFrame, manifest_sha256: str, metadata_sha256: str, split_id: str, official_size: int, document_keys: int = DOCUMENT_KEYS, artifact_type: str = ARTIFACT_TYPE
) -> DataFrame:
    """(value): the JSON documents of a split whose held-out side is an official list (episode_key, video_key).

    An official list of another size, with an episode twice or with one that
    the manifest doesn't know, and a split with an empty side are errors.
    """
    sides = pristine_sides(official, manifest)
    counts = {r.check: r.counted for r in pristine_audit(official, sides).collect()}
    wrong = {
        "official_examples": counts["official_examples"] != official_size,
        "official_episodes": counts["official_episodes"] != official_size,
        "unknown_official": counts["unknown_official"] > 0,
        "train_episodes": counts["train_episodes"] == 0,
        "usable_validation": counts["usable_validation"] == 0,
    }
    if broken := [f"{c} ({counts[c]})" for c, bad in wrong.items() if bad]:
        raise ValueError(f"no pristine split: {', '.join(broken)}")
    prints = fingerprints(sides.where(F.col("side").isin(TRAIN, VALIDATION)), ["side"]).agg(
        *[F.max(F.when(F.col("side") == s, F.col("fingerprint"))).alias(n) for s, n in ((TRAIN, "continuation_train_fingerprint"), (VALIDATION, "usable_validation_fingerprint"))]
    )
    example = F.struct(F.col("key").alias("episode_key"), "video_key")
    rows = official.select(F.col("episode_key").alias("key"), "video_key").join(sides.select("key", "side", "reasons"), "key", "left")
    excluded = F.struct(F.col("key").alias("episode_key"), F.col("reasons").alias("exclusion_reasons"))
    lists = {
        "official_validation_examples": example,
        "usable_validation_episode_keys": F.when(F.col("side") == VALIDATION, F.col("key")),
        "manifest_excluded_official_validation": F.when(F.col("side") == "excluded", excluded),
    }
    told = {
        "schema_version": F.lit(1),
        "artifact_type": F.lit(artifact_type),
        "split_id": F.lit(split_id),
        "submission_kit_used": F.lit(False),
        "evaluation_data_used": F.lit(False),
        "source_manifest": F.struct(F.lit(manifest_sha256).alias("sha256"), F.lit(counts["train_episodes"] + counts["usable_validation"]).alias("included_episode_count")),
        "source_train_metadata": F.struct(F.lit(metadata_sha256).alias("sha256")),
        "audit": F.struct(F.lit(True).alias("passed"), *[F.lit(v).alias(c) for c, v in counts.items()]),
    }
    made = _dealt(rows, [], lists, document_keys).join(F.broadcast(prints))
    return made.select(F.to_json(F.struct("*", *[x.alias(c) for c, x in told.items()])).alias("value"))
