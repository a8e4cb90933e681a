import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from quern.llm import mixing as M

SCHEMA = "doc_id long, text string, lang string, source string, domain string, copies int"


def options(**more):
    weight = F.when(F.col("domain") == "a", 3).otherwise(1)
    return {"domain": F.col("domain"), "weights": {"domain": weight, "lang": F.lit(2), "source": F.length("source")}, **more}


def fill(children, b):
    """{name: given} for {name: (weight, capacity)}, by raising one level until a child is full."""
    order = sorted(children, key=lambda k: (children[k][1] / children[k][0], k))
    out, full = {}, 0
    for i, k in enumerate(order):
        rest, spare = sum(children[x][0] for x in order[i:]), max(b - full, 0)
        if spare * children[k][0] < children[k][1] * rest:
            out |= {x: min(spare * children[x][0] // rest, children[x][1]) for x in order[i:]}
            break
        out[k] = children[k][1]
        full += children[k][1]
    return out


def plain(docs, share=(4, 5), epochs=2, seed=23):
    rows = []
    for doc_id, text, lang, source, domain, _ in docs:
        name = f"{'' if doc_id is None else doc_id}:{hashlib.md5((text or '').encode()).hexdigest()}"
        rows.append((domain or "(none)", lang or "(none)", source or "(none)", name, len((text or "").split()), doc_id))
    leaves = Counter()
    for d, la, s, _, n, _ in rows:
        leaves[d, la, s] += n
    cap = lambda *prefix: epochs * sum(n for k, n in leaves.items() if k[: len(prefix)] == prefix)
    below = lambda *prefix: {k[len(prefix)] for k in leaves if k[: len(prefix)] == prefix}
    budgets = {}
    top = fill({d: (3 if d == "a" else 1, cap(d)) for d in below()}, sum(leaves.values()) * share[0] // share[1])
    for d, b in top.items():
        for la, b2 in fill({x: (2, cap(d, x)) for x in below(d)}, b).items():
            for s, b3 in fill({x: (len(x), cap(d, la, x)) for x in below(d, la)}, b2).items():
                budgets[d, la, s] = b3
    out = []
    for leaf, budget in budgets.items():
        own = [r for r in rows if r[:3] == leaf]
        whole, rest = divmod(budget, leaves[leaf]) if leaves[leaf] else (0, 0)
        items = Counter()
        for r in own:
            items[r[3]] += r[4]
        place = {n: hashlib.md5(f"{seed}:{whole}:{n}".encode()).hexdigest() for n in items}
        taken, so_far = set(), 0
        for n in sorted(items, key=place.get) if rest else []:
            so_far += items[n]
            if so_far > rest:
                break
            taken.add(n)
        for r in own:
            if copies := whole + (r[3] in taken):
                out.append((r[5], *leaf, r[4], budget, copies))
    return Counter(out)


def made(seed, n):
    rng = random.Random(seed)
    docs = []
    for i in range(n):
        source = "big" if rng.random() < 0.4 else rng.choice(["s1", "s22", "s333", None])
        domain = "a" if rng.random() < 0.1 else rng.choice(["b", "c", None])
        docs.append((i, "w " * rng.randint(0, 30), rng.choice(["en", "de", None]), source, domain, 7))
    return docs + [(None, None, "en", "s1", "b", 0), (5000, "long " * 3000, "en", "s1", "b", 0)] + docs[:4] + [(None, "null id", "de", "big", "c", 1)] * 3


def test_report_equals_brute_force(spark):
    for seed, share, epochs in ((1, (4, 5), 2), (2, (3, 2), 3), (3, (1, 50), 1)):
        docs = made(seed, 250)
        df = spark.createDataFrame(docs, SCHEMA)
        got = Counter(map(tuple, M.mix_report(df, **options(share=share, epochs=epochs)).collect()))
        assert got == plain(docs, share, epochs)


def test_large_and_small_plans_give_the_same_rows(spark):
    df = spark.createDataFrame(made(6, 150), SCHEMA)
    small, large = (M.mix_report(df, **options(broadcast_leaves=n)) for n in (100_000, 0))
    assert Counter(map(tuple, small.collect())) == Counter(map(tuple, large.collect())) == plain(made(6, 150))
    for out, joins in ((small, 0), (large, 1)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert ("strategy=broadcast" in plan) == (not joins) and plan.count("Join Inner") == 1


def test_mix_repeats_rows_and_keeps_columns(spark):
    docs = made(4, 120)
    df = spark.createDataFrame(docs, SCHEMA)
    out = M.mix(df, **options(share=(3, 2), epochs=3))
    assert out.columns == df.columns
    want = Counter()
    for row, n in plain(docs, (3, 2), 3).items():
        want[row[0]] += n * row[6]
    assert Counter(r.doc_id for r in out.collect()) == want
    budget = sum(len((d[1] or "").split()) for d in docs) * 3 // 2
    assert 0 < out.select(F.sum(M.words(F.col("text")))).first()[0] <= budget


def test_empty_table_and_no_tokens(spark):
    df = spark.createDataFrame([(1, "", "en", "s", "a", 1), (2, None, None, None, None, 1)], SCHEMA)
    assert M.mix_report(df, **options()).count() == M.mix(df.limit(0), **options()).count() == 0


def test_native_plan(spark):
    df = spark.createDataFrame(made(1, 5), SCHEMA)
    plan = M.mix(df, **options())._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
