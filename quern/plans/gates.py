"""Queries on selection: gates, contracts, ranks, budgets, and what is derived again."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import keys
from quern.operators import evaluate, selection
from quern.operators.sampling import ring_donor
from quern.plans.registry import query
from quern.tables import table

POLICY = selection.Policy(least_mean_delta=0.0, least_positive=0.49)
#: Event types as candidates: the value is the original's error, the property k the control's.
EVENTS = "e AS (SELECT event_id, event_type, value AS v, json_extract(props, '$.k')::DOUBLE AS k FROM events)"
SELECTION = f"""{EVENTS}, p AS (SELECT event_type, count(*) AS n, avg(k - v) AS mean, median(k - v) AS median, avg((k - v > 0)::INT) AS positive FROM e GROUP BY 1),
r AS (SELECT event_type, 16 AS samples, round(sum(v) / 20, 0) + 20 AS total, 10.0::DOUBLE AS setup, round(sum(v) / 25, 0) AS generation FROM e GROUP BY 1),
q AS (SELECT event_type, samples, CASE WHEN total >= setup AND generation <= total * (1 + 1e-9) THEN
  300 + 1.25 * (setup + 216 * greatest(total - setup, generation) / samples) END AS projected FROM r),
m AS (SELECT event_type, round(avg(v), 9) AS overall FROM e GROUP BY 1),
j AS (SELECT *, list_sort(list_filter([CASE WHEN NOT coalesce(mean > 0, false) THEN 'mean_delta' END, CASE WHEN NOT coalesce(positive >= 0.49, false) THEN 'positive_fraction' END,
  CASE WHEN NOT coalesce(samples >= 8, false) THEN 'too_few_samples' END, CASE WHEN NOT coalesce(projected <= 3600, false) THEN 'runtime' END], lambda x: x IS NOT NULL)) AS failed
  FROM m JOIN p USING (event_type) JOIN q USING (event_type)),
s AS (SELECT *, len(failed) = 0 AS eligible, CASE WHEN len(failed) = 0 THEN row_number() OVER (PARTITION BY len(failed) = 0 ORDER BY overall, event_type) END AS rank FROM j)"""


def _events(spark, d):
    return table(spark, d, "events").select(
        "event_id", "event_type", F.col("value").alias("v"), F.get_json_object("props", "$.k").cast("double").alias("k")
    )


def _selection(spark, d):
    e = _events(spark, d)
    gates = selection.sensitivity(e, ["event_type"], "v", "k")
    total = F.round(F.sum("v") / 20, 0) + 20
    runs = e.groupBy("event_type").agg(
        F.lit(16).alias("samples"),
        total.alias("total"),
        F.lit(6.0).alias("data"),
        F.lit(4.0).alias("model"),
        F.round(F.sum("v") / 25, 0).alias("generation"),
    )
    overall = e.groupBy("event_type").agg(F.round(F.avg("v"), 9).alias("overall"))
    return selection.select(gates, runs, overall, "event_type", [F.col("overall")], POLICY)


@query(f"WITH {EVENTS} SELECT event_type, count(*) AS n, round(sum(k - v), 2) AS total, round(median(k - v), 4) AS median, count(*) FILTER (k - v > 0) AS positive, avg(k - v) > 0 AS gate FROM e GROUP BY 1")
def action_sensitivity(spark, d):
    out = selection.sensitivity(_events(spark, d), ["event_type"], "v", "k")
    n = F.col("n")
    return out.select(
        "event_type", "n", F.round(F.col("mean") * n, 2).alias("total"), F.round("median", 4).alias("median"), F.round(F.col("positive") * n).cast("long").alias("positive"), "gate"
    )


@query(f"""WITH {SELECTION} SELECT event_type, array_to_string(failed, ',') AS failed, eligible, rank::INT AS rank, coalesce(rank = 1, false) AS selected,
  round(projected, 4) AS projected FROM s""")
def candidate_selection(spark, d):
    """All gates and the rank of every candidate, in one plan."""
    out = _selection(spark, d)
    return out.select("event_type", F.array_join("failed", ",").alias("failed"), "eligible", "rank", "selected", F.round("projected", 4).alias("projected"))


@query(f"""WITH {SELECTION}, n AS (SELECT event_type, rank::INT AS rank, array_to_string(failed, ',') AS failed, eligible FROM s),
o AS (SELECT event_type, rank, failed, CASE WHEN length(event_type) % 2 = 0 THEN NOT eligible ELSE eligible END AS eligible FROM n)
SELECT event_type, rank, side FROM (SELECT *, 'stored' AS side FROM (SELECT * FROM o EXCEPT SELECT * FROM n) UNION ALL SELECT *, 'again' FROM (SELECT * FROM n EXCEPT SELECT * FROM o))""")
def selection_rederived(spark, d):
    """A stored selection held against the one that its sources give again; candidates with a name of even length were changed in store."""
    from quern.storage import checkpointed

    columns = ["event_type", "rank", "failed", "eligible"]
    even = F.length("event_type") % 2 == 0
    stored = checkpointed(_selection(spark, d).select(*columns).withColumn("eligible", F.when(even, ~F.col("eligible")).otherwise(F.col("eligible"))))
    out = selection.differing(stored, _selection(spark, d), columns)
    return out.select("event_type", "rank", "side")


@query("""SELECT 'bad_length' AS rule, count(*) AS violations, count(*) = 0 AS ok FROM documents WHERE NOT coalesce(n_chars >= 0, false)
UNION ALL SELECT 'no_language', count(*), count(*) = 0 FROM documents WHERE NOT coalesce(lang IN ('en', 'de'), false)
UNION ALL SELECT 'repeated_doc_id', count(*), count(*) = 0 FROM (SELECT doc_id FROM documents GROUP BY doc_id HAVING count(*) > 1)
UNION ALL SELECT 'other_lang', count(*), count(*) = 0 FROM (SELECT count(DISTINCT lang) AS n FROM documents) WHERE n > 1""")
def report_contract(spark, d):
    docs = table(spark, d, "documents")
    required = {"bad_length": F.col("n_chars") >= 0, "no_language": F.col("lang").isin("en", "de")}
    return evaluate.assertions(selection.report_rules(docs, "doc_id", required, ["lang"]))


@query("""WITH b AS (SELECT doc_id, lang, n_chars + (doc_id % 17 = 0)::INT AS n_chars, source, row_number() OVER (ORDER BY substr(sha256('9:' || doc_id), 1, 16), doc_id) AS rn,
  count(*) OVER () AS n FROM documents WHERE doc_id % 19 > 0),
c AS (SELECT x.*, y.doc_id AS donor FROM b x JOIN b y ON y.rn = x.rn % x.n + 1), j AS (SELECT a.doc_id AS ai, c.doc_id AS ci, a.lang AS al, c.lang AS cl, a.n_chars AS an, c.n_chars AS cn
  FROM documents a FULL JOIN c ON a.doc_id = c.doc_id)
SELECT 'alone' AS rule, count(*) AS violations, count(*) = 0 AS ok FROM j WHERE ai IS NULL OR ci IS NULL
UNION ALL SELECT 'other_lang', count(*), count(*) = 0 FROM j WHERE ai = ci AND al IS DISTINCT FROM cl
UNION ALL SELECT 'other_n_chars', count(*), count(*) = 0 FROM j WHERE ai = ci AND an IS DISTINCT FROM cn
UNION ALL SELECT 'own_donor', count(*), count(*) = 0 FROM c WHERE donor = doc_id
UNION ALL SELECT 'unknown_donor', count(*), count(*) = 0 FROM c ANTI JOIN documents d ON d.doc_id = c.donor""")
def pair_contract(spark, d):
    """A report against its control, in which some rows are missing, some differ, and each has a donor from the ring."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars", keys.score_hex("9", F.col("doc_id").cast("string")).alias("s"))
    control = docs.where("doc_id % 19 > 0").withColumn("n_chars", F.col("n_chars") + (F.col("doc_id") % 17 == 0).cast("int"))
    control = ring_donor(control, ["s", "doc_id"], "doc_id", "donor")
    return evaluate.assertions(selection.pair_rules(docs, control, "doc_id", ["lang", "n_chars"], ("donor", "doc_id")))


L = """l AS (SELECT l_suppkey, l_quantity AS err, l_linenumber::DOUBLE AS tax FROM lineitem), m AS (SELECT l_suppkey, count(*) AS n, avg(err) AS err, avg(tax) AS tax FROM l GROUP BY 1),
w AS (SELECT *, row_number() OVER (ORDER BY err DESC, l_suppkey) AS rn, count(*) OVER () AS c FROM m)"""


@query(f"""WITH {L} SELECT 'overall' AS scope, sum(n)::BIGINT AS n, round(sum(err * n) / sum(n), 9) AS err, round(sum(tax * n) / sum(n), 9) AS tax FROM m
UNION ALL SELECT 'worst_quartile', count(*), round(avg(err), 9), round(avg(tax), 9) FROM w WHERE rn <= greatest(ceil(c * 0.25), 1)""")
def metric_report(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", F.col("l_quantity").alias("err"), F.col("l_linenumber").cast("double").alias("tax"))
    out = selection.metric_report(rows, "l_suppkey", "err", ["err", "tax"])
    return out.select("scope", "n", F.round("err", 9).alias("err"), F.round("tax", 9).alias("tax"))


@query("""WITH b AS (SELECT l_suppkey, l_orderkey % 50 AS batch, avg(l_quantity) AS v, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_suppkey, round(sum(v * n) / sum(n), 8) AS weighted, round(avg(v), 8) AS unweighted FROM b GROUP BY l_suppkey""")
def batch_means(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_suppkey", (F.col("l_orderkey") % 50).alias("batch"))
    batches = lines.agg(F.avg("l_quantity").alias("v"), F.count("*").alias("n"))
    out = selection.batch_means(batches, ["l_suppkey"], "v", "n")
    return out.select("l_suppkey", F.round("weighted", 8).alias("weighted"), F.round("unweighted", 8).alias("unweighted"))


@query("SELECT l_suppkey, ceil(1000 * (SELECT count(*) FROM lineitem) / count(*))::BIGINT AS steps FROM lineitem GROUP BY l_suppkey")
def update_budget(spark, d):
    """Steps for all line items, if each supplier's were a fold that took 1,000."""
    lines = table(spark, d, "lineitem")
    sizes, total = lines.groupBy("l_suppkey").agg(F.count("*").alias("n")), lines.agg(F.count("*").alias("total"))
    steps = selection.scaled_budget(F.lit(1000), F.col("total"), F.col("n"))
    return sizes.join(F.broadcast(total)).select("l_suppkey", steps.alias("steps"))


@query("""WITH s AS (SELECT n_regionkey AS stage, n_nationkey AS name FROM nation), a AS (SELECT DISTINCT n_regionkey AS stage, n_nationkey AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0)
SELECT stage, count(*) AS wanted, count(a.name) AS found, count(*) = count(a.name) AS complete FROM s LEFT JOIN a USING (stage, name) GROUP BY stage""")
def stage_completeness(spark, d):
    """Regions as stages whose nations must each have left something: a supplier with a balance above 0."""
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("stage"), F.col("n_nationkey").alias("name"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("name"), F.col("s_acctbal").alias("bytes")).join(n, "name")
    return selection.complete(n, s, "stage", "name")


@query("""WITH r AS (SELECT page_id, sha256(html) AS digest, CASE WHEN page_id > 0 THEN page_id - 1 - (page_id % 31 = 0)::INT * 1000 END AS parent,
  page_id % 7 = 0 AS spoiled FROM pages), l AS (SELECT a.*, CASE WHEN a.spoiled THEN sha256('x') ELSE b.digest END AS parent_digest, b.digest AS known FROM r a LEFT JOIN r b ON b.page_id = a.parent)
SELECT page_id, CASE WHEN parent IS NULL THEN 'root' WHEN known IS NULL THEN 'unknown' WHEN known <> parent_digest THEN 'other_digest' ELSE 'ok' END AS status FROM l""")
def contract_links(spark, d):
    """Records that name the one before them and its digest; some name none, or a wrong digest."""
    pages = table(spark, d, "pages").select("page_id", F.sha2("html", 256).alias("digest"))
    before = F.col("page_id") - 1 - (F.col("page_id") % 31 == 0).cast("int") * 1000
    rows = pages.withColumn("parent", F.when(F.col("page_id") > 0, before))
    known = pages.select(F.col("page_id").alias("parent"), F.col("digest").alias("b"))
    named = rows.join(known, "parent", "left").withColumn("parent_digest", F.when(F.col("page_id") % 7 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.col("b")))
    return selection.linked(named.drop("b"), "page_id", "parent", "digest")
