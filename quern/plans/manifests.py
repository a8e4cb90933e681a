"""Queries on manifests: duplicates, contradictions, reasons, keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import keys
from quern.operators import artifacts, quality
from quern.plans.registry import query
from quern.tables import table

DOCS = "SELECT doc_id, text, lang, source, n_chars, sha256(text) AS sha FROM documents"


def _docs(spark, d):
    """Text plays the part of file bytes; only its digest goes on."""
    return table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars", keys.digest(F.col("text")).alias("sha"))


def _reasons(rows):
    return quality.reasons(
        {
            "low_quality": F.col("quality") == 0,
            "toxic": F.col("toxic") == 1,
            "unlabelled": F.col("quality").isNull(),
            "too_short": F.col("n_chars") < 100,
            "exact_duplicate_noncanonical": (F.col("group_size") > 1) & (F.col("doc_id") != F.col("canonical")),
        }
    )


def _manifest(spark, d):
    docs = quality.with_canonical(_docs(spark, d), "sha", "doc_id")
    rows = docs.join(table(spark, d, "labels"), "doc_id", "left")
    return rows.withColumn("reasons", _reasons(rows))


MANIFEST = f"""
d AS ({DOCS}),
g AS (SELECT sha, count(*) AS group_size, min(doc_id) AS canonical FROM d GROUP BY sha),
m AS (
  SELECT d.doc_id, d.source, d.lang, d.n_chars, d.sha, g.group_size, g.canonical, quality, toxic,
    list_sort(list_filter([
      CASE WHEN quality = 0 THEN 'low_quality' END, CASE WHEN toxic = 1 THEN 'toxic' END,
      CASE WHEN quality IS NULL THEN 'unlabelled' END, CASE WHEN n_chars < 100 THEN 'too_short' END,
      CASE WHEN group_size > 1 AND d.doc_id <> canonical THEN 'exact_duplicate_noncanonical' END
    ], lambda x: x IS NOT NULL)) AS reasons
  FROM d JOIN g USING (sha) LEFT JOIN labels l ON l.doc_id = d.doc_id
)"""


@query(f"""WITH {MANIFEST}
SELECT doc_id, source || '/episode_' || lpad(doc_id::VARCHAR, 6, '0') AS episode_key,
  CASE WHEN group_size > 1 THEN 'file:' || substr(sha, 1, 20) END AS duplicate_group, canonical,
  array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS include_for_training FROM m""")
def dup_manifest(spark, d):
    group = F.when(F.col("group_size") > 1, keys.group_id("file", F.col("sha")))
    return _manifest(spark, d).select(
        "doc_id",
        keys.episode_key(F.col("source"), F.col("doc_id")).alias("episode_key"),
        group.alias("duplicate_group"),
        "canonical",
        F.array_join("reasons", ",").alias("reasons"),
        (F.size("reasons") == 0).alias("include_for_training"),
    )


@query(f"""WITH d AS ({DOCS}) SELECT 'file:' || substr(sha, 1, 20) AS group_id, count(*) AS size, count(*) - 1 AS excess,
  min(doc_id) AS canonical FROM d GROUP BY sha HAVING count(*) > 1""")
def dup_groups(spark, d):
    groups = quality.duplicate_groups(_docs(spark, d), "sha", "doc_id")
    return groups.select(keys.group_id("file", F.col("sha")).alias("group_id"), "size", "excess", "canonical")


@query(f"WITH d AS ({DOCS}) SELECT doc_id, min(doc_id) OVER (PARTITION BY sha) AS canonical FROM d")
def canonical_member(spark, d):
    return quality.with_canonical(_docs(spark, d), "sha", "doc_id").select("doc_id", "canonical")


@query(f"""WITH d AS ({DOCS}), j AS (SELECT d.*, quality, toxic FROM d LEFT JOIN labels USING (doc_id)),
c AS (SELECT sha FROM j GROUP BY sha HAVING count(DISTINCT coalesce(quality::VARCHAR, '') || '/' || coalesce(toxic::VARCHAR, '')) > 1)
SELECT source, count(*) AS n, count(c.sha) AS conflicting, round(count(c.sha) / count(*), 6) AS share,
  count(c.sha) > 0 AND count(c.sha) / count(*) >= 0.05 AS excluded
FROM j LEFT JOIN c USING (sha) GROUP BY source""")
def content_conflicts(spark, d):
    rows = _docs(spark, d).join(table(spark, d, "labels"), "doc_id", "left")
    bad = quality.contradictions(rows, "sha", "quality", "toxic").select("sha", F.lit(1).alias("bad"))
    out = rows.join(bad, "sha", "left").groupBy("source").agg(F.count("*").alias("n"), F.count("bad").alias("conflicting"))
    share = F.col("conflicting") / F.col("n")
    return out.select("source", "n", "conflicting", F.round(share, 6).alias("share"), ((share > 0) & (share >= 0.05)).alias("excluded"))


@query(f"WITH {MANIFEST} SELECT doc_id, array_to_string(reasons, ',') AS reasons, len(reasons)::INT AS n_reasons FROM m")
def exclusion_reasons(spark, d):
    return _manifest(spark, d).select("doc_id", F.array_join("reasons", ",").alias("reasons"), F.size("reasons").alias("n_reasons"))


@query(f"WITH {MANIFEST} SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM m) GROUP BY reason")
def issue_counts(spark, d):
    return quality.issue_counts(_manifest(spark, d), "reasons")


@query("""SELECT n_name, ('0x' || substr(sha256('7:' || n_name), 1, 16))::UBIGINT::VARCHAR AS score,
  substr(sha256('7:' || n_name), 1, 16) AS score_hex FROM nation""")
def hash_score(spark, d):
    name = F.col("n_name")
    return table(spark, d, "nation").select(
        "n_name", keys.score("7", name).cast("string").alias("score"), keys.score_hex("7", name).alias("score_hex")
    )


@query("""SELECT source, sha256(string_agg(DISTINCT lpad(doc_id::VARCHAR, 9, '0'), chr(10) ORDER BY lpad(doc_id::VARCHAR, 9, '0')) || chr(10)) AS fingerprint
FROM documents GROUP BY source""")
def set_fingerprint(spark, d):
    key = F.lpad(F.col("doc_id").cast("string"), 9, "0")
    return artifacts.fingerprints(table(spark, d, "documents").select("source", key.alias("key")), ["source"])


@query("""SELECT doc_id, doc_id // 1000 AS chunk, 'data/chunk-' || lpad((doc_id // 1000)::VARCHAR, 3, '0') || '/' || source || '/episode_' ||
  lpad(doc_id::VARCHAR, 6, '0') || '.parquet' AS path FROM documents""")
def path_template(spark, d):
    index = F.col("doc_id")
    path = F.format_string("data/chunk-%03d/%s.parquet", keys.chunk(index), keys.episode_key(F.col("source"), index))
    return table(spark, d, "documents").select("doc_id", keys.chunk(index).alias("chunk"), path.alias("path"))


@query("""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host,
  (len(string_split(regexp_extract(url, '^[a-z]+://[^/?#]+(/[^?#]*)', 1), '/')) - 1)::INT AS depth,
  regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g') AS token, position('?' IN url) > 0 AS has_query FROM pages""")
def url_parts(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select(
        "page_id",
        F.regexp_extract(url, "^[a-z]+://([^/?#:]+)", 1).alias("host"),
        (F.size(F.split(F.regexp_extract(url, "^[a-z]+://[^/?#]+(/[^?#]*)", 1), "/")) - 1).alias("depth"),
        keys.path_tokens(url).alias("token"),
        url.contains("?").alias("has_query"),
    )


@query("""SELECT event_id, json_extract(props, '$.k')::DOUBLE AS k, event_type,
  CASE WHEN json_extract(props, '$.k')::DOUBLE > 50 THEN 'high' ELSE 'low' END AS band FROM events""")
def json_extract(spark, d):
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, d, "events").select("event_id", k.alias("k"), "event_type", F.when(k > 50, "high").otherwise("low").alias("band"))


@query("""SELECT array_to_string(list_sort(json_keys(props)), ',') AS names, count(*) AS n,
  array_to_string(list_sort(json_keys(props)), ',') = 'k' AS exact FROM events GROUP BY ALL""")
def exact_key_set(spark, d):
    names = F.array_join(F.array_sort(F.json_object_keys("props")), ",")
    return table(spark, d, "events").groupBy(names.alias("names")).agg(F.count("*").alias("n")).withColumn("exact", F.col("names") == "k")


@query("SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 50 OFFSET 100")
def paginate(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").orderBy("doc_id").offset(100).limit(50)


@query("""SELECT o_orderkey, rn FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn, count(*) OVER () AS n FROM orders)
WHERE rn > n - 5 OR rn % 1000 = 0""")
def keep_last_and_milestones(spark, d):
    from quern.operators.sampling import numbered

    rows = numbered(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", "rn")
    n = rows.agg(F.count("*").alias("n"))
    return rows.join(F.broadcast(n)).where((F.col("rn") > F.col("n") - 5) | (F.col("rn") % 1000 == 0)).select("o_orderkey", "rn")
