"""Queries on metrics by domain, gates, ranks and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import evaluate, sampling, selection, stats
from quern.plans.registry import query
from quern.plans.statistics import r6
from quern.tables import table

METRICS = ["err", "tax", "disc"]
L = """l AS (SELECT l_suppkey, l_returnflag, l_extendedprice / 1000 AS err, l_tax AS tax, l_discount AS disc FROM lineitem),
m AS (SELECT l_suppkey, count(*) AS n, avg(err) AS err, avg(tax) AS tax, avg(disc) AS disc FROM l GROUP BY l_suppkey)"""
R6 = ", ".join(f"round({m}, 6) AS {m}" for m in METRICS)


def _lines(spark, d):
    """Line items as samples: a supplier is a domain, a return flag a candidate."""
    return table(spark, d, "lineitem").select(
        "l_suppkey", "l_returnflag", (F.col("l_extendedprice") / 1000).alias("err"), F.col("l_tax").alias("tax"), F.col("l_discount").alias("disc")
    )


@query(f"WITH {L} SELECT l_suppkey, n, {R6} FROM m")
def domain_mean(spark, d):
    return evaluate.domain_means(_lines(spark, d), ["l_suppkey"], METRICS).select("l_suppkey", "n", *r6(*METRICS))


@query(f"""WITH {L}, w AS (SELECT sum(n)::BIGINT AS n, sum(err * n) / sum(n) AS err, sum(tax * n) / sum(n) AS tax, sum(disc * n) / sum(n) AS disc FROM m)
SELECT n, {R6} FROM w""")
def weighted_overall(spark, d):
    means = evaluate.domain_means(_lines(spark, d), ["l_suppkey"], METRICS)
    return evaluate.weighted_overall(means, [], METRICS).select("n", *r6(*METRICS))


@query(f"""WITH {L}, p AS (SELECT *, row_number() OVER (ORDER BY err DESC, l_suppkey) AS rn, count(*) OVER () AS c FROM m)
SELECT count(*) AS n_domains, round(avg(err), 6) AS err, round(avg(tax), 6) AS tax, round(avg(disc), 6) AS disc FROM p WHERE rn <= greatest(ceil(c * 0.25), 1)""")
def worst_quartile(spark, d):
    means = evaluate.domain_means(_lines(spark, d), ["l_suppkey"], METRICS)
    return evaluate.worst_quartile(means, [], "l_suppkey", "err", METRICS).select("n_domains", *r6(*METRICS))


@query("""WITH r AS (SELECT value, json_extract(props, '$.k')::DOUBLE AS k, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS n, event_type FROM events),
p AS (SELECT b.k - a.value AS delta FROM r a JOIN r b ON a.event_type = b.event_type AND b.rn = a.rn % a.n + 1)
SELECT count(*) AS n, round(sum(delta), 2) AS total, round(median(delta), 4) AS median, count(*) FILTER (delta > 0) AS positive, avg(delta) > 0 AS gate FROM p""")
def paired_sensitivity(spark, d):
    """Events' values against the property of the next event of their type, the last against the first."""
    rows = table(spark, d, "events").select("event_id", "event_type", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    placed = sampling.numbered_in_groups(rows, ["event_type"], ["event_id"], "rn", "n")
    donors = placed.select("event_type", (F.col("rn") - 1).alias("to"), F.col("k").alias("control"))
    pairs = placed.withColumn("to", F.col("rn") % F.col("n")).join(donors, ["event_type", "to"])
    out, n = selection.sensitivity(pairs, [], "value", "control"), F.col("n")
    return out.select("n", F.round(F.col("mean") * n, 2).alias("total"), F.round("median", 4).alias("median"), F.round(F.col("positive") * n).cast("long").alias("positive"), "gate")


@query(f"""WITH {L}, c AS (SELECT l_returnflag, l_suppkey, count(*) AS n, avg(err) AS err, avg(disc) AS disc FROM l GROUP BY ALL),
o AS (SELECT l_returnflag, sum(n)::BIGINT AS n, round(sum(err * n) / sum(n), 6) AS overall, round(sum(disc * n) / sum(n), 6) AS disc FROM c GROUP BY l_returnflag),
q AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY err DESC, l_suppkey) AS rn, count(*) OVER (PARTITION BY l_returnflag) AS k FROM c),
w AS (SELECT l_returnflag, round(avg(err), 6) AS worst FROM q WHERE rn <= greatest(ceil(k * 0.25), 1) GROUP BY l_returnflag),
j AS (SELECT o.*, worst, o.l_returnflag <> 'N' AS eligible FROM o JOIN w USING (l_returnflag))
SELECT l_returnflag, overall, worst, disc, eligible, CASE WHEN eligible THEN row_number() OVER (PARTITION BY eligible ORDER BY overall, worst, -disc, l_returnflag) END::INT AS rank FROM j""")
def lexicographic_rank(spark, d):
    means = evaluate.domain_means(_lines(spark, d), ["l_returnflag", "l_suppkey"], ["err", "disc"])
    overall = evaluate.weighted_overall(means, ["l_returnflag"], ["err", "disc"]).select(
        "l_returnflag", F.round("err", 6).alias("overall"), F.round("disc", 6).alias("disc")
    )
    worst = evaluate.worst_quartile(means, ["l_returnflag"], "l_suppkey", "err", ["err"]).select("l_returnflag", F.round("err", 6).alias("worst"))
    order = [F.col("overall"), F.col("worst"), -F.col("disc")]
    out = evaluate.ranked(overall.join(worst, "l_returnflag"), "l_returnflag", F.col("l_returnflag") != "N", order)
    return out.select("l_returnflag", "overall", "worst", "disc", "eligible", "rank")


@query("""WITH r AS (SELECT p_partkey, p_size * 10.0::DOUBLE AS total, (p_size % 7)::DOUBLE + (p_size % 5 + 4)::DOUBLE AS setup,
  p_size * 9.0::DOUBLE + (p_partkey % 3)::DOUBLE AS gen, p_partkey % 9 AS n FROM part),
q AS (SELECT p_partkey, CASE WHEN n > 0 AND total >= setup AND gen <= total * (1 + 1e-9) THEN greatest(total - setup, gen) / n END AS per_sample, setup FROM r)
SELECT p_partkey, round(per_sample, 6) AS per_sample, round(setup + 216 * per_sample, 4) AS raw, round(300 + 1.25 * (setup + 216 * per_sample), 4) AS guarded FROM q""")
def runtime_projection(spark, d):
    """Parts as runs: times from their sizes, some of which contradict themselves."""
    size, key = F.col("p_size"), F.col("p_partkey")
    rows = table(spark, d, "part").select(
        "p_partkey",
        (size * 10.0).alias("total"),
        (size % 7).cast("double").alias("data"),
        (size % 5 + 4).cast("double").alias("model"),
        (size * 9.0 + key % 3).alias("gen"),
        (key % 9).alias("n"),
    )
    made = evaluate.runtime_projection(*[F.col(c) for c in ("total", "data", "model", "gen", "n")], wanted=216, reserve=300.0, factor=1.25)
    return rows.select("p_partkey", *[F.round(x, 6 if name == "per_sample" else 4).alias(name) for name, x in made.items()])


@query(f"""WITH {L}, s AS (SELECT l_suppkey, sum(err) / count(*) AS err FROM l GROUP BY l_suppkey)
SELECT l_suppkey, abs(m.err - s.err) <= greatest(greatest(abs(m.err), abs(s.err)) * 1e-10, 1e-12) AS close FROM m JOIN s USING (l_suppkey)""")
def isclose_recheck(spark, d):
    means = evaluate.domain_means(_lines(spark, d), ["l_suppkey"], ["err"])
    again = _lines(spark, d).groupBy("l_suppkey").agg((F.sum("err") / F.count("*")).alias("again"))
    return means.join(again, "l_suppkey").select("l_suppkey", stats.close(F.col("err"), F.col("again")).alias("close"))


@query("""SELECT 'label_without_document' AS rule, count(*) AS violations, count(*) = 0 AS ok FROM labels ANTI JOIN documents USING (doc_id)
UNION ALL SELECT 'turns_not_contiguous', count(*), count(*) = 0 FROM (SELECT conv_id FROM conversations GROUP BY conv_id HAVING max(turn) <> count(*) - 1)
UNION ALL SELECT 'repeated_line_number', count(*), count(*) = 0 FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'negative_length', count(*), count(*) = 0 FROM documents WHERE n_chars < 0""")
def evidence_report(spark, d):
    """The final cross-check's shape: named rules, each with how often it is broken."""
    docs, turns = table(spark, d, "documents"), table(spark, d, "conversations")
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last"), F.count("*").alias("n"))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    return evaluate.assertions(
        {
            "label_without_document": table(spark, d, "labels").join(docs, "doc_id", "left_anti"),
            "turns_not_contiguous": last.where("last <> n - 1"),
            "repeated_line_number": lines.where("n > 1"),
            "negative_length": docs.where("n_chars < 0"),
        }
    )
