"""Queries on records as they are read: frames, manifests, files, digests, statistics and their validity."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import checks, keys
from quern.operators import frame_audit as audit
from quern.operators import quality
from quern.plans.registry import query
from quern.sources import documents, episodes, records
from quern.tables import table


@query("""SELECT vec_id, CASE WHEN embedding IS NULL THEN 'null' WHEN len(embedding) = 0 THEN 'empty' WHEN len(embedding) <> 64 THEN 'width'
  WHEN NOT list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding]) THEN 'not_finite' ELSE 'ok' END AS fault, len(embedding)::INT AS width FROM embeddings""")
def frame_scan(spark, d):
    """What is wrong with each frame's vector, if anything is."""
    fault = records.vector_fault(F.col("embedding"), 64)
    return table(spark, d, "embeddings").select("vec_id", F.coalesce(fault, F.lit("ok")).alias("fault"), F.size("embedding").alias("width"))


@query("""WITH u AS (SELECT label, vec_id, unnest(range(0, 64)) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT label, dim::INT AS dim, count(*) AS n, min(x) AS least, max(x) AS most, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std,
  bool_and(isfinite(x)) AS finite, count(DISTINCT vec_id) = count(*) AS unique_index FROM u GROUP BY label, dim""")
def action_audit(spark, d):
    """Each episode's vectors by dimension: count, ends, mean, deviation, finiteness, and whether frames are there once."""
    return quality.vector_audit(table(spark, d, "embeddings"), ["label"], "vec_id", "embedding").select(
        "label", "dim", "n", "least", "most", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "finite", "unique_index"
    )


RECORD = """r AS (SELECT d.doc_id, source || '/episode_' || lpad(d.doc_id::VARCHAR, 6, '0') AS episode_key, n_chars AS length,
  CASE WHEN toxic = 1 THEN false WHEN quality = 1 THEN true END AS flag, d.doc_id % 2 + 1 AS schema_version FROM documents d LEFT JOIN labels l USING (doc_id))"""


def _lines(spark, d):
    """Documents as the JSON lines of a manifest; a document without labels has no flag."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    flag = F.when(F.col("toxic") == 1, False).when(F.col("quality") == 1, True)
    record = F.struct(
        (F.col("doc_id") % 2 + 1).alias("schema_version"),
        keys.episode_key(F.col("source"), F.col("doc_id")).alias("episode_key"),
        F.col("source").alias("repository_id"),
        F.col("n_chars").alias("length"),
        flag.alias("include_for_training"),
    )
    return docs.select(F.to_json(record).alias("value")).unionByName(spark.createDataFrame([("  ",)], "value string"))


@query(f"""WITH {RECORD} SELECT count(*) AS total, count(*) FILTER (coalesce(flag, true)) AS included, count(*) FILTER (NOT coalesce(flag, true)) AS excluded,
  array_to_string(list_sort(list(DISTINCT schema_version)), ',') AS schema_versions FROM r""")
def manifest_scan(spark, d):
    rows = records.require_unique(records.parsed(_lines(spark, d)), "episode_key")
    return records.manifest_snapshot(rows).withColumn("schema_versions", F.array_join("schema_versions", ","))


@query(f"""WITH {RECORD} SELECT episode_key, length, coalesce(flag, true) AS by_default_in, coalesce(flag, false) AS by_default_out,
  flag IS NOT DISTINCT FROM true AS only_true, flag IS DISTINCT FROM false AS not_false FROM r""")
def include_defaults(spark, d):
    """The four readings of a flag that may be missing."""
    flag = F.col("include_for_training")
    return records.parsed(_lines(spark, d)).select(
        "episode_key",
        "length",
        checks.is_included(flag, True).alias("by_default_in"),
        checks.is_included(flag, False).alias("by_default_out"),
        flag.eqNullSafe(F.lit(True)).alias("only_true"),
        (~flag.eqNullSafe(F.lit(False))).alias("not_false"),
    )


@query("""WITH f AS (SELECT doc_id, text, strlen(text) AS bytes FROM documents), k AS (SELECT bytes FROM f GROUP BY bytes HAVING count(*) > 1),
h AS (SELECT doc_id, bytes, sha256(text) AS sha256 FROM f SEMI JOIN k USING (bytes))
SELECT 'file:' || substr(sha256, 1, 20) AS group_id, sha256, bytes::BIGINT AS bytes_each, count(*) AS size, min(lpad(doc_id::VARCHAR, 9, '0')) AS canonical_member
FROM h GROUP BY sha256, bytes HAVING count(*) > 1""")
def exact_file_groups(spark, d):
    """Texts as files: only those of equal length are hashed."""
    docs = table(spark, d, "documents").where("text is not null")
    content = F.col("text").cast("binary")
    files = docs.select(
        F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("path"), F.length(content).cast("long").alias("length"), content.alias("content")
    )
    return quality.exact_file_groups(files).select("group_id", "sha256", "bytes_each", "size", "canonical_member")


@query("""WITH e AS (SELECT page_id::VARCHAR AS path, strlen(html)::BIGINT AS bytes, sha256(html) AS sha FROM pages WHERE page_id % 11 > 0),
f AS (SELECT page_id::VARCHAR AS path, strlen(h)::BIGINT AS bytes, sha256(h) AS sha FROM (SELECT page_id,
  CASE WHEN page_id % 7 = 0 THEN 'X' || substr(html, 2) WHEN page_id % 5 = 0 THEN html || '!' ELSE html END AS h FROM pages WHERE page_id % 13 > 0))
SELECT coalesce(e.path, f.path) AS path, CASE WHEN f.path IS NULL THEN 'missing' WHEN e.path IS NULL THEN 'extra' WHEN e.bytes <> f.bytes THEN 'other_size'
  WHEN e.sha <> f.sha THEN 'other_content' ELSE 'ok' END AS status FROM e FULL JOIN f ON e.path = f.path""")
def file_record_check(spark, d):
    """Records of pages, held against pages of which some are damaged, missing or new."""
    pages = table(spark, d, "pages").select("page_id", F.col("page_id").cast("string").alias("path"), "html")
    h = F.col("html")
    spoiled = F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("X"), F.expr("substring(html, 2)"))).when(F.col("page_id") % 5 == 0, F.concat(h, F.lit("!"))).otherwise(h)
    expected = episodes.records(pages.where("page_id % 11 > 0").select("path", h.alias("content")))
    return episodes.verified(expected, episodes.records(pages.where("page_id % 13 > 0").select("path", spoiled.alias("content"))))


@query("""WITH t AS (SELECT conv_id, list(role || chr(9) || turn || chr(9) || length(text) || chr(10) ORDER BY role, turn) AS lines FROM conversations GROUP BY conv_id)
SELECT conv_id, sha256(array_to_string(lines, '')) AS fingerprint FROM t""")
def descriptor_fingerprint(spark, d):
    """Digest of a conversation's descriptors, lines of tab-separated fields, sorted by the fields and not as text."""
    rows = table(spark, d, "conversations").withColumn("size", F.length("text"))
    fields = F.array_sort(F.collect_list(F.struct("role", "turn", "size")))
    line = lambda x: F.concat_ws("\t", x["role"], x["turn"].cast("string"), x["size"].cast("string"))
    return rows.groupBy("conv_id").agg(fields.alias("f")).select("conv_id", keys.lines_digest(F.transform("f", line)).alias("fingerprint"))


@query(r"""WITH s AS (SELECT conv_id, 'train' AS side, 0 AS o, role AS v FROM conversations GROUP BY ALL UNION ALL
  SELECT conv_id, 'validation', 1, lpad(turn::VARCHAR, 3, '0') FROM conversations GROUP BY ALL)
SELECT conv_id, sha256(string_agg(side || chr(9) || v || chr(10), '' ORDER BY o, v)) AS fingerprint FROM s GROUP BY conv_id""")
def split_fingerprint(spark, d):
    """Digest of both sides of a small split, each sorted and named."""
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(
        F.array_sort(F.collect_set("role")).alias("train"), F.array_sort(F.collect_set(F.lpad(F.col("turn").cast("string"), 3, "0"))).alias("val")
    )
    lines = F.concat(F.transform("train", lambda x: F.concat(F.lit("train\t"), x)), F.transform("val", lambda x: F.concat(F.lit("validation\t"), x)))
    return rows.select("conv_id", keys.lines_digest(lines).alias("fingerprint"))


@query("""WITH t AS (SELECT conv_id, list(turn::VARCHAR || chr(0) || sha256(role) || chr(0) || sha256(text) || chr(0) ORDER BY turn) AS parts FROM conversations GROUP BY conv_id)
SELECT conv_id, sha256(array_to_string(parts, '')) AS digest FROM t""")
def evidence_digest(spark, d):
    """Digest of names and their hashes with zero bytes between."""
    item = F.struct("turn", F.col("turn").cast("string").alias("n"), F.array(F.sha2("role", 256), F.sha2("text", 256)).alias("h"))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("x"))
    return rows.select("conv_id", keys.nul_digest(F.col("x.n"), F.col("x.h")).alias("digest"))


@query("""WITH t AS (SELECT conv_id, list(unhex(printf('%016X', strlen(role))) || encode(role) || unhex(printf('%016X', strlen(text))) || encode(text) ORDER BY turn) AS parts
  FROM conversations GROUP BY conv_id)
SELECT conv_id, sha256(list_reduce(parts, lambda a, b: a || b)) AS digest FROM t""")
def tree_digest(spark, d):
    """Digest over several files, names and contents each behind their length."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("name"), F.col("text").alias("content"))
    return quality.tree_digests(rows, ["conv_id"], "turn", "name", "content")


@query("""WITH s AS (SELECT label, unnest(range(0, 64)) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings),
c AS (SELECT label, list(avg ORDER BY dim) AS center, list(std ORDER BY dim) AS scale FROM (SELECT label, dim, avg(x) AS avg, stddev_pop(x) AS std FROM s GROUP BY label, dim) GROUP BY label)
SELECT label, len(center)::INT AS width, true AS usable, label % 3 > 0 AND list_bool_and([x > 0 FOR x IN scale]) AS usable_if_spoiled FROM c""")
def stats_checks(spark, d):
    """Whether statistics can be used, as they are and with a scale of 0 put in for a third of the labels."""
    audit = quality.vector_audit(table(spark, d, "embeddings"), ["label"], "vec_id", "embedding")
    listed = F.array_sort(F.collect_list(F.struct("dim", "mean", "std")))
    rows = audit.groupBy("label").agg(listed.alias("s")).select("label", F.col("s.mean").alias("center"), F.col("s.std").alias("scale"))
    spoiled = F.when(F.col("label") % 3 == 0, F.transform("scale", lambda x: x * 0)).otherwise(F.col("scale"))
    return rows.select(
        "label",
        F.size("center").alias("width"),
        checks.is_stats(F.col("center"), F.col("scale")).alias("usable"),
        checks.is_stats(F.col("center"), spoiled).alias("usable_if_spoiled"),
    )


@query("""SELECT event_id, CASE WHEN json_extract(props, '$.k')::INT > 50 THEN 'k' ELSE '' END AS forbidden, json_extract(props, '$.k')::INT % 7 = 0 AS repeated,
  CASE WHEN json_extract(props, '$.k')::INT > 50 THEN 4 ELSE 1 END::INT AS depth FROM events""")
def forbidden_keys(spark, d):
    """Nested documents made of event properties: which forbidden names they have at any depth, and whether a name is there twice."""
    k = F.get_json_object("props", "$.k").cast("int")
    again = F.when(k % 7 == 0, F.lit(', "a": 0}')).otherwise(F.lit("}"))
    nested = F.concat(F.lit('{"a": 0, "c": [{"b": '), F.col("props"), F.lit("}]"), again)
    flat = F.concat(F.lit('{"a": '), k.cast("string"), again)
    rows = table(spark, d, "events").select("event_id", F.when(k > 50, nested).otherwise(flat).alias("doc"))
    out = documents.json_faults(rows, "event_id", "doc", ("k", "secret"))
    return out.select("event_id", F.array_join("forbidden", ",").alias("forbidden"), "repeated", "depth")


@query("""WITH e AS (SELECT event_id, event_id % 5 AS m, json_extract(props, '$.k')::INT AS k FROM events)
SELECT event_id, '$.runInfo.evalScore' AS path, 'score' AS found, 'name' AS kind FROM e WHERE m = 0
UNION ALL SELECT event_id, '$.runInfo.items[1].featureMap', 'feature', 'name' FROM e WHERE m = 0
UNION ALL SELECT event_id, '$.from', 'submission_kit', 'value' FROM e WHERE m = 1
UNION ALL SELECT event_id, '$.list[0][1].kit-score', 'score', 'name' FROM e WHERE m = 1 AND k > 50
UNION ALL SELECT event_id, '$.b', 'a', 'repeated' FROM e WHERE m = 3
UNION ALL SELECT event_id, '$', NULL, 'malformed' FROM e WHERE m = 4 AND k > 50""")
def forbidden_paths(spark, d):
    """Documents of five kinds made of event properties: where they have forbidden names or values, repeated names, or are no JSON."""
    k = F.get_json_object("props", "$.k").cast("int")
    number = k.cast("string")
    score = F.when(k > 50, "kit-score").otherwise("kit")
    docs = [
        F.concat(F.lit('{"runInfo": {"evalScore": '), number, F.lit(', "items": [{"x": "scoreless"}, {"featureMap": {"y": 1}}]}}')),
        F.concat(F.lit('{"submission_kit_used": false, "from": "Data/Submission Kit/v1", "list": [[1, {"'), score, F.lit('": 2}]]}')),
        F.concat(F.lit('{"plain": {"deep": {"deeper": ['), number, F.lit(', null, "scores"]}}}')),
        F.concat(F.lit('{"a": 1, "b": {"a": 2, "a": '), number, F.lit("}}")),
        F.concat(F.lit('{"a": '), F.when(k > 50, F.lit("")).otherwise(number), F.lit("}")),
    ]
    doc = F.element_at(F.array(*docs), (F.col("event_id") % 5 + 1).cast("int"))
    rows = table(spark, d, "events").select("event_id", doc.alias("doc"))
    return documents.forbidden_paths(rows, "event_id", "doc", ("score", "feature", "submission"), ("submission_kit_used",), ("submission_kit",))


@query("""SELECT o_orderkey, lpad((s // 86400)::VARCHAR, 2, '0') || ':' || lpad((s // 3600 % 24)::VARCHAR, 2, '0') || ':' || lpad((s // 60 % 60)::VARCHAR, 2, '0') || ':' ||
  lpad((s % 60)::VARCHAR, 2, '0') AS duration FROM (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS s FROM orders)""")
def duration(spark, d):
    return table(spark, d, "orders").select("o_orderkey", keys.duration(F.col("o_totalprice")).alias("duration"))


@query("""SELECT doc_id, source IS NOT NULL AND source <> '' AND doc_id >= 0 AND n_chars > 100 AND doc_id % 9 > 0 AS identified,
  CASE WHEN lang IN ('en', 'de', 'fr', 'es') THEN lang ELSE 'other' END AS lang FROM documents""")
def sample_identity(spark, d):
    """Whether a sample names its repository, index and a positive size; and its language as one of a fixed list."""
    known = ("en", "de", "fr", "es", "other")
    lang = F.when(F.col("lang").isin(*known[:-1]), F.col("lang")).otherwise("other")
    ok = checks.is_identity(F.col("source"), F.col("doc_id"), F.col("n_chars") - 100, F.col("doc_id") % 9)
    return table(spark, d, "documents").select("doc_id", ok.alias("identified"), checks.one_of(lang, known, "language").alias("lang"))


@query("""SELECT doc_id, regexp_matches(sha256(coalesce(text, '')), '^[0-9a-f]{64}$') AS digest, source IS NOT NULL AND source <> '' AS named, n_chars > 0 AS positive,
  n_chars IS NOT NULL AND isfinite(n_chars::DOUBLE) AS finite FROM documents""")
def typed_checks(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(
        "doc_id",
        keys.is_sha256(keys.digest(F.coalesce("text", F.lit("")))).alias("digest"),
        checks.is_key_list(F.array("source")).alias("named"),
        (F.col("n_chars") > 0).alias("positive"),
        checks.is_finite_vector(F.array(F.col("n_chars").cast("double"))).alias("finite"),
    )


@query("""WITH d AS (SELECT doc_id, source, sha256(text) AS sha FROM documents), j AS (SELECT d.*, quality, toxic FROM d LEFT JOIN labels USING (doc_id)),
c AS (SELECT sha FROM j GROUP BY sha HAVING count(DISTINCT coalesce(quality::VARCHAR, '') || '/' || coalesce(toxic::VARCHAR, '')) > 1),
x AS (SELECT source FROM j LEFT JOIN c USING (sha) GROUP BY source HAVING count(c.sha) > 0 AND count(c.sha) / count(*) >= 0.03)
SELECT doc_id, source FROM d ANTI JOIN x USING (source)""")
def conflict_exclusion(spark, d):
    """Documents of the sources in which contradictions stay below a share."""
    docs = table(spark, d, "documents").select("doc_id", "source", keys.digest(F.col("text")).alias("sha"))
    rows = docs.join(table(spark, d, "labels"), "doc_id", "left")
    bad = quality.contradictions(rows, "sha", "quality", "toxic").select("sha", F.lit(True).alias("bad"))
    marked = rows.join(bad, "sha", "left")
    out = quality.excluded_groups(marked, "source", F.coalesce("bad", F.lit(False)), 0.03)
    return docs.join(out, "source", "left_anti").select("doc_id", "source")


@query("""SELECT conv_id, count(*) AS n, bool_and(turn = rn) AS contiguous FROM (
  SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text), turn) - 1 AS rn FROM conversations) GROUP BY conv_id""")
def contiguity_in_order(spark, d):
    """Whether turns count up in the order of another column, which stands for the order in a file."""
    rows = table(spark, d, "conversations").withColumn("size", F.length("text"))
    return quality.contiguous_in_order(rows, ["conv_id"], "turn", ["size", "turn"])


@query("""WITH f AS (SELECT user_id AS u, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS t, value::FLOAT AS x,
  json_extract(props, '$.k')::FLOAT AS k FROM events),
g AS (SELECT u, t, k, CASE WHEN u % 17 = 0 AND t = 0 THEN 'nan'::FLOAT ELSE x END AS x, CASE WHEN u % 13 = 0 AND t % 3 = 0 THEN u + 1 ELSE u END AS embedded,
  CASE WHEN u % 7 = 0 THEN t // 2 ELSE t END AS frame_index, CASE WHEN u % 11 = 0 THEN 0 ELSE event_id END AS idx FROM f WHERE u % 19 > 0),
a AS (SELECT u, count(*) AS rows, bool_and(isfinite(x)) AS finite, list_sort(list(DISTINCT embedded)) AS e, bool_and(frame_index = t) AS contiguous, count(DISTINCT idx) = count(*) AS uniq,
  min(k)::DOUBLE AS least, max(k)::DOUBLE AS most FROM g GROUP BY u),
n AS (SELECT user_id AS u, count(*) + (user_id % 5 = 0)::INT AS length FROM events GROUP BY user_id)
SELECT u AS user_id, coalesce(rows, 0) AS rows, coalesce(finite, false) AS finite, coalesce(array_to_string(e, ','), '') AS embedded, contiguous AS frame_index_contiguous, uniq AS index_unique,
  least, most, concat_ws(',', CASE WHEN rows IS NOT NULL AND e <> [u] THEN 'embedded_episode_index_mismatch' END, CASE WHEN NOT contiguous THEN 'frame_index_not_contiguous' END,
  CASE WHEN NOT uniq THEN 'index_not_unique_within_episode' END, CASE WHEN rows IS NULL THEN 'missing_parquet' END, CASE WHEN NOT finite THEN 'nonfinite_action' END,
  CASE WHEN rows <> length THEN 'row_length_mismatch' END) AS errors FROM n LEFT JOIN a USING (u)""")
def frame_audit(spark, d):
    """Users' events as frames of episodes, some spoiled and some without any, each audited in one pass."""
    from pyspark.sql import Window

    events, u = table(spark, d, "events"), F.col("user_id")
    t = (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long")
    k = F.get_json_object("props", "$.k").cast("float")
    rows = events.select("user_id", "event_id", F.col("value").cast("float").alias("x"), k.alias("k"), t.alias("t")).where(u % 19 > 0)
    nan = F.when((u % 17 == 0) & (F.col("t") == 0), float("nan")).otherwise(F.col("x")).cast("float")
    frames = rows.select(
        "user_id",
        "t",
        F.array(nan, "k").alias("v"),
        F.when((u % 13 == 0) & (F.col("t") % 3 == 0), u + 1).otherwise(u).alias("embedded"),
        F.when(u % 7 == 0, F.expr("t div 2")).otherwise(F.col("t")).alias("frame_index"),
        F.when(u % 11 == 0, 0).otherwise(F.col("event_id")).alias("idx"),
    )
    audits = audit.frame_audits(frames, "user_id", ["t"], "v", embedded="embedded", frame_index="frame_index", index="idx")
    listed = events.groupBy("user_id").agg((F.count("*") + (u % 5 == 0).cast("int")).alias("length")).withColumn("at", u)
    out = audit.audited(listed, audits, "user_id", "at", "length")
    return out.select(
        "user_id",
        "rows",
        "finite",
        F.array_join("embedded", ",").alias("embedded"),
        "frame_index_contiguous",
        "index_unique",
        F.get("minimum", F.lit(1)).alias("least"),
        F.get("maximum", F.lit(1)).alias("most"),
        F.array_join("errors", ",").alias("errors"),
    )
