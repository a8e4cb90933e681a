"""Queries on split artifacts: written as documents, read back, and held against what they were made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import keys
from quern.operators import artifacts
from quern.plans.registry import query
from quern.sources import artifacts as source
from quern.storage import new_path
from quern.tables import table

T20 = keys.threshold_hex(0.2)
MANIFEST = "6d616e6966657374"
#: Episodes that one document lists at most, a customer number for each.
PART = 500

EPISODES = """e AS (SELECT c_custkey AS k, 'n' || c_nationkey AS owner, 'n' || c_nationkey || '/r' || c_custkey % 40 AS repository,
  'n' || c_nationkey || '/r' || c_custkey % 40 || '/episode_' || lpad(c_custkey::VARCHAR, 6, '0') AS key, c_custkey % 9 > 0 AS include FROM customer)"""


def _manifest(spark, d):
    """Customers as episodes; their owner and repository are told by the key alone in two of three records."""
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    repository = F.concat(F.lit("n"), n, F.lit("/r"), (k % 40).cast("string"))
    told = k % 3 == 0
    return table(spark, d, "customer").select(
        k.alias("k"),
        F.format_string("%s/episode_%06d", repository, k).alias("episode_key"),
        (k % 9 > 0).alias("include_for_training"),
        F.when(told, F.concat(F.lit("n"), n)).alias("owner"),
        F.when(told, repository).otherwise(F.when(k % 3 == 1, "")).alias("repository_id"),
        F.lit(None).cast("string").alias("validation_group"),
    )


def _stored(spark, rows, column: str, schema: str):
    """Rows of JSON text written to the shared folder, a document each, and read from there."""
    path = new_path(spark, "artifact")
    rows.select(F.col(column).alias("value")).write.text(path)
    return source.parsed(source.documents(spark, path, lines=True), schema)


def _listed(manifest):
    """(fold_id, side, key, k): f0, f1 and f3 hold nations out; f2 lacks keys, has some on both sides and twice, and some of no episode."""
    e = manifest.where("include_for_training").withColumn("fold_id", F.explode(F.array(*[F.lit(f"f{i}") for i in range(4)])))
    owner = F.split_part("episode_key", F.lit("/"), F.lit(1))
    side = F.when(keys.score_hex(F.col("fold_id"), owner) < T20, "validation").otherwise("train")
    rows = e.select("fold_id", side.alias("side"), F.col("episode_key").alias("key"), "k")
    more = manifest.where("include_for_training").select(F.lit("f2").alias("fold_id"), F.lit("train").alias("side"), F.col("episode_key").alias("key"), "k")
    unknown = more.select("fold_id", F.lit("validation").alias("side"), F.concat(F.lit("x/"), "key").alias("key"), "k")
    return rows.where("fold_id <> 'f2' or k % 7 > 0").unionByName(more.where("k % 11 = 0")).unionByName(unknown.where("k % 13 = 0"))


def _fold_documents(spark, d):
    manifest = _manifest(spark, d)
    listed = _listed(manifest)
    sizes = listed.groupBy("fold_id").agg(*[F.count_distinct(F.when(F.col("side") == s, F.col("key"))).alias(s) for s in ("train", "validation")])
    n = manifest.agg(F.count("*").alias("total"), F.count_if("include_for_training").alias("included"))
    part = F.floor(F.col("k") / PART).alias("part")
    on = lambda s: F.collect_list(F.when(F.col("side") == s, F.col("key"))).alias(f"{s}_episode_keys")
    parts = listed.groupBy("fold_id", part).agg(on("train"), on("validation")).join(F.broadcast(sizes), "fold_id").join(F.broadcast(n))
    fold = F.col("fold_id")
    audit = F.struct(
        F.lit(True).alias("passed"),
        F.when(fold == "f3", False).otherwise(True).alias("complete_partition"),
        F.lit(True).alias("train_nonempty"),
        F.when((fold == "f3") & (F.col("part") == 0), False).otherwise(True).alias("validation_nonempty"),
        *[F.when((fold == "f1") & F.lit(c == "owner_overlap_count"), 2).when((fold == "f3") & F.lit(c == "missing_episode_count"), None).otherwise(0).alias(c) for c in source.ZERO_CHECKS],
    )
    summary = F.struct((F.col("train") + (fold == "f1").cast("int")).alias("train_episode_count"), F.col("validation").alias("validation_episode_count"))
    one = F.struct(fold, audit.alias("audit"), summary.alias("summary"), "train_episode_keys", "validation_episode_keys")
    document = F.struct(
        F.lit(1).alias("schema_version"),
        F.struct(F.lit(True).alias("passed"), (F.col("part") != 1).alias("all_fold_audits_passed")).alias("audit"),
        F.struct(F.lit(MANIFEST).alias("sha256"), F.col("total").alias("total_record_count"), (F.col("included") + 1).alias("included_episode_count")).alias("source_manifest"),
        F.array(one).alias("folds"),
    )
    return manifest, _stored(spark, parts.select(F.to_json(document).alias("value")), "value", source.FOLDS)


@query(f"""WITH {EPISODES}, i AS (SELECT * FROM e WHERE include),
b AS (SELECT 'f' || s AS fold_id, CASE WHEN substr(sha256('f' || s || ':' || owner), 1, 16) < '{T20}' THEN 'validation' ELSE 'train' END AS side, key, k FROM i, range(0, 4) AS r(s)),
m AS (SELECT * FROM b WHERE fold_id <> 'f2' OR k % 7 > 0 UNION ALL SELECT 'f2', 'train', key, k FROM i WHERE k % 11 = 0
  UNION ALL SELECT 'f2', 'validation', 'x/' || key, k FROM i WHERE k % 13 = 0),
p AS (SELECT fold_id, key, count(*) FILTER (side = 'train') AS t, count(*) FILTER (side = 'validation') AS v FROM m GROUP BY ALL),
j AS (SELECT p.*, i.key IS NOT NULL AS known, owner, repository FROM p LEFT JOIN i USING (key)),
o AS (SELECT fold_id, count(*) FILTER (a AND b) AS n FROM (SELECT fold_id, owner, bool_or(t > 0) AS a, bool_or(v > 0) AS b FROM j WHERE known GROUP BY ALL) GROUP BY fold_id),
r AS (SELECT fold_id, count(*) FILTER (a AND b) AS n FROM (SELECT fold_id, repository, bool_or(t > 0) AS a, bool_or(v > 0) AS b FROM j WHERE known GROUP BY ALL) GROUP BY fold_id),
a AS (SELECT fold_id, bool_or(t > 0) AS tn, bool_or(v > 0) AS vn, sum(greatest(t - 1, 0)) AS dt, sum(greatest(v - 1, 0)) AS dv, count(*) FILTER (t > 0 AND v > 0) AS eo,
  (SELECT count(*) FROM i) - count(*) FILTER (known) AS mi, count(*) FILTER (NOT known) AS un, count(*) FILTER (t > 0) AS nt, count(*) FILTER (v > 0) AS nv FROM j GROUP BY fold_id),
w AS (SELECT a.*, o.n AS oo, r.n AS ro, mi + un = 0 AS complete FROM a JOIN o USING (fold_id) JOIN r USING (fold_id)),
c AS (SELECT fold_id, unnest([{{'check': 'passed', 'recorded': 1, 'now': (tn AND vn AND complete AND dt + dv + eo + oo + ro = 0)::BIGINT, 'must': 1}},
  {{'check': 'complete_partition', 'recorded': (fold_id <> 'f3')::BIGINT, 'now': complete::BIGINT, 'must': 1}},
  {{'check': 'train_nonempty', 'recorded': 1, 'now': tn::BIGINT, 'must': 1}},
  {{'check': 'validation_nonempty', 'recorded': (fold_id <> 'f3')::BIGINT, 'now': vn::BIGINT, 'must': 1}},
  {{'check': 'duplicate_train_episode_key_count', 'recorded': 0, 'now': dt::BIGINT, 'must': 0}}, {{'check': 'duplicate_validation_episode_key_count', 'recorded': 0, 'now': dv::BIGINT, 'must': 0}},
  {{'check': 'episode_overlap_count', 'recorded': 0, 'now': eo, 'must': 0}}, {{'check': 'missing_episode_count', 'recorded': CASE WHEN fold_id <> 'f3' THEN 0 END, 'now': mi, 'must': 0}},
  {{'check': 'owner_overlap_count', 'recorded': CASE fold_id WHEN 'f1' THEN 2 ELSE 0 END, 'now': oo, 'must': 0}}, {{'check': 'repository_overlap_count', 'recorded': 0, 'now': ro, 'must': 0}},
  {{'check': 'unknown_episode_count', 'recorded': 0, 'now': un, 'must': 0}}, {{'check': 'validation_group_overlap_count', 'recorded': 0, 'now': ro, 'must': 0}},
  {{'check': 'train_episode_count', 'recorded': nt + (fold_id = 'f1')::BIGINT, 'now': nt, 'must': nt}}, {{'check': 'validation_episode_count', 'recorded': nv, 'now': nv, 'must': nv}}], recursive := true) FROM w)
SELECT fold_id, "check", recorded::BIGINT AS recorded, now::BIGINT AS recounted, coalesce(recorded = now AND recorded = must AND NOT (fold_id = 'f3' AND "check" = 'validation_nonempty'), false) AS ok FROM c
UNION ALL SELECT NULL, 'schema_version', 1, 1, true UNION ALL SELECT NULL, 'audit_passed', 1, 1, true UNION ALL SELECT NULL, 'manifest_sha256', 1, 1, true
UNION ALL SELECT NULL, 'all_fold_audits_passed', min((k // {PART} <> 1)::BIGINT), 1, bool_and(k // {PART} <> 1) FROM m
UNION ALL SELECT NULL, 'total_record_count', count(*), count(*), true FROM e
UNION ALL SELECT NULL, 'included_episode_count', count(*) + 1, count(*), false FROM i
UNION ALL SELECT NULL, 'repeated_manifest_keys', 0, count(*) - count(DISTINCT key), count(*) = count(DISTINCT key) FROM e""")
def artifact_reaudit(spark, d):
    """What fold artifacts record against what is counted again from their lists; f0 holds, the others contradict themselves."""
    manifest, stored = _fold_documents(spark, d)
    return artifacts.findings(stored, artifacts.manifest_rows(manifest), MANIFEST)


def _pristine(spark, d, spoiled: bool):
    """An official list of a fifth of the episodes as documents; a spoiled one drops a held-out key, takes up one that is none, and lists some twice."""
    manifest = artifacts.manifest_rows(_manifest(spark, d))
    numbered = F.regexp_extract("key", "([0-9]+)$", 1).cast("long")
    official = manifest.where(keys.score_hex("official", F.col("key")) < T20).select("key", numbered.alias("k"))
    sides = artifacts.pristine_sides(official.withColumnRenamed("key", "episode_key"), manifest)
    prints = artifacts.fingerprints(sides.where("side in ('train', 'validation')"), ["side"])
    one = prints.groupBy().pivot("side", ["train", "validation"]).agg(F.first("fingerprint"))
    usable = sides.where("side = 'validation'").select("key", numbered.alias("k"))
    if spoiled:
        wrong = manifest.where("include").select("key", numbered.alias("k")).where("k % 101 = 0")
        usable = usable.where("k % 17 > 0").unionByName(wrong)
        official = official.unionByName(official.where("k % 19 = 0"))
    example = F.struct(F.col("key").alias("episode_key"), F.lit("observation.images.top").alias("video_key"))
    rows = official.select("k", example.alias("o"), F.lit(None).cast("string").alias("u")).unionByName(
        usable.select("k", F.lit(None).cast("struct<episode_key:string,video_key:string>").alias("o"), F.col("key").alias("u"))
    )
    parts = rows.groupBy(F.floor(F.col("k") / PART).alias("part")).agg(
        F.collect_list("o").alias("official_validation_examples"), F.collect_list("u").alias("usable_validation_episode_keys")
    )
    n = manifest.agg(F.count_if("include").alias("included"))
    header = parts.join(F.broadcast(one)).join(F.broadcast(n)).select(
        F.lit(1).alias("schema_version"),
        F.lit("checkpoint_pristine_split").alias("artifact_type"),
        F.lit("v1").alias("split_id"),
        F.lit(False).alias("submission_kit_used"),
        (F.lit(spoiled) & (F.col("part") == 0)).alias("evaluation_data_used"),
        F.struct(F.lit(MANIFEST).alias("sha256"), F.col("included").alias("included_episode_count")).alias("source_manifest"),
        F.struct(F.lit("meta").alias("sha256")).alias("source_train_metadata"),
        "official_validation_examples",
        "usable_validation_episode_keys",
        F.col("train").alias("continuation_train_fingerprint"),
        F.col("validation").alias("usable_validation_fingerprint"),
        F.struct(F.lit(True).alias("passed")).alias("audit"),
    )
    stored = _stored(spark, header.select(F.to_json(F.struct("*")).alias("value")), "value", source.PRISTINE)
    return manifest, stored


@query(f"""WITH {EPISODES}, o AS (SELECT key, k, include FROM e WHERE substr(sha256('official:' || key), 1, 16) < '{T20}'),
good AS (SELECT key, k FROM o WHERE include),
bad AS (SELECT key, k FROM good WHERE k % 17 > 0 UNION SELECT key, k FROM e WHERE include AND k % 101 = 0),
u AS (SELECT 'good' AS artifact, key, k FROM good UNION ALL SELECT 'bad', key, k FROM bad),
x AS (SELECT 'good' AS artifact, key FROM o UNION ALL SELECT 'bad', key FROM o UNION ALL SELECT 'bad', key FROM o WHERE k % 19 = 0),
s AS (SELECT a.artifact, e.key, u.key IS NOT NULL AS held FROM e, (VALUES ('good'), ('bad')) AS a(artifact) LEFT JOIN u ON u.artifact = a.artifact AND u.key = e.key WHERE include),
f AS (SELECT artifact, sha256(coalesce(string_agg(key || chr(10), '' ORDER BY key) FILTER (NOT held), '')) AS t, sha256(coalesce(string_agg(key || chr(10), '' ORDER BY key) FILTER (held), '')) AS v FROM s GROUP BY 1),
g AS (SELECT artifact, (t = (SELECT t FROM f WHERE artifact = 'good'))::BIGINT AS t, (v = (SELECT v FROM f WHERE artifact = 'good'))::BIGINT AS v FROM f),
parts AS (SELECT 'bad' AS artifact, bool_or(k // {PART} = 0) AS first FROM (SELECT k FROM bad UNION ALL SELECT k FROM o)),
c AS (SELECT x.artifact, count(*) AS examples, count(DISTINCT x.key) AS episodes, (SELECT count(*) FROM o) AS size FROM x GROUP BY 1),
y AS (SELECT artifact, count(*) AS usable, count(*) FILTER (o.key IS NULL) AS strange FROM u LEFT JOIN o USING (key) GROUP BY 1),
l AS (SELECT artifact, unnest([{{'check': 'schema_version', 'a': 1, 'b': 1}}, {{'check': 'artifact_type', 'a': 1, 'b': 1}}, {{'check': 'split_id', 'a': 1, 'b': 1}},
  {{'check': 'no_submission_kit', 'a': 1, 'b': 1}}, {{'check': 'audit_passed', 'a': 1, 'b': 1}}, {{'check': 'manifest_sha256', 'a': 1, 'b': 1}}, {{'check': 'metadata_sha256', 'a': 1, 'b': 1}},
  {{'check': 'no_evaluation_data', 'a': CASE WHEN artifact = 'bad' AND (SELECT first FROM parts) THEN 0 ELSE 1 END, 'b': 1}},
  {{'check': 'official_examples', 'a': examples, 'b': size}}, {{'check': 'official_episodes', 'a': episodes, 'b': size}},
  {{'check': 'usable_not_official', 'a': 0, 'b': strange}}, {{'check': 'usable_not_included', 'a': 0, 'b': 0}}, {{'check': 'usable_is_empty', 'a': 0, 'b': (usable = 0)::BIGINT}},
  {{'check': 'train_fingerprint', 'a': t, 'b': 1}}, {{'check': 'validation_fingerprint', 'a': v, 'b': 1}},
  {{'check': 'included_episode_count', 'a': (SELECT count(*) FROM e WHERE include), 'b': (SELECT count(*) FROM e WHERE include)}}], recursive := true)
  FROM c JOIN y USING (artifact) JOIN g USING (artifact))
SELECT artifact, "check", a::BIGINT AS recorded, b::BIGINT AS recounted, a = b AS ok FROM l""")
def pristine_reaudit(spark, d):
    """A good and a spoiled artifact of one official list, held against the manifest."""
    out = None
    for name in ("good", "bad"):
        manifest, stored = _pristine(spark, d, name == "bad")
        size = manifest.where(keys.score_hex("official", F.col("key")) < T20).count()
        one = artifacts.pristine_findings(stored, manifest, MANIFEST, "meta", "v1", size).select(F.lit(name).alias("artifact"), "check", "recorded", "recounted", "ok")
        out = one if out is None else out.unionByName(one)
    return out
