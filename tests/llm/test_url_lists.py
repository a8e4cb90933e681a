import datetime as dt
import random

from pyspark.sql import functions as F

from quern.llm import url_lists as U

DAY = dt.date(2024, 1, 1)


def plain(captures, entries):
    last = {}
    for key, day, place, action in entries:
        if key is not None and day is not None and action is not None:
            k = (key.lower(), day)
            last[k] = max(last.get(k, (place, action)), (place, action), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    by = {}
    for (key, day), (_, action) in sorted(last.items()):
        by.setdefault(key, []).append((day, action))
    out = []
    for i, host, day in captures:
        labels = host.split(".") if host else []
        above = 1 if host and (host[0] == "[" or host == "1.2.3.4") else max(1, len(labels) - 1)
        keys = [".".join(labels[k:]) for k in range(above)] if host else []
        hit = (None, None, None)
        for key in keys:
            before = [x for x in by.get(key, []) if day is not None and x[0] <= day]
            if before and before[-1][1] != "remove":
                hit = (before[-1][1], key, before[-1][0])
                break
        out.append((i, host, day, *hit))
    return out


def key(row):
    return tuple((x is not None, str(x)) for x in row)


def test_as_of_join_equals_brute_force(spark):
    rng = random.Random(2)
    hosts = ["a.b.example.com", "b.example.com", "example.com", "x.org", "localhost", "deep.a.b.example.com", "1.2.3.4", "2.3.4", "3.4", "[2001:db8::1]"]
    entries = [
        (rng.choice([*hosts, "EXAMPLE.com", "com"]), DAY + dt.timedelta(rng.randint(0, 200)), rng.randint(0, 3), rng.choice(["block", "allow", "remove"]))
        for _ in range(90)
    ] + [(None, DAY, 1, "block"), ("x.org", None, 1, "block"), ("x.org", DAY, 1, None)]
    captures, rows = [], []
    for i in range(300):
        host, day = rng.choice([*hosts, None]), rng.choice([None, *[DAY + dt.timedelta(rng.randint(-50, 500)) for _ in range(20)]])
        url = rng.choice(["", None, "no url"]) if host is None else rng.choice(["http://{}/p?q", "https://user:pw@{}:80", "HTTP://{}./x"]).format(host.upper())
        captures.append((i % 250 if i < 290 else None, host, day))
        rows.append((captures[-1][0], url, day, "clash"))
    df = spark.createDataFrame(rows, "page_id long, url string, fetch_date date, action string")
    lists = spark.createDataFrame(entries, "key string, entry_date date, place int, action string")
    out = U.judge_captures(df, lists, keep=("page_id",), salts=3)
    got = [(r.page_id, r.host, r.fetch_date, r.action, r.matched, r.since) for r in out.collect()]
    assert sorted(got, key=key) == sorted(plain(captures, entries), key=key)
    assert U.judge_captures(df, lists.limit(0), keep=("page_id",)).where("action is null").count() == 300
    assert U.judge_captures(df.limit(0), lists).count() == 0


def test_native_plan(spark):
    df = spark.createDataFrame([(1, "http://a.b/", DAY)], "page_id long, url string, fetch_date date")
    lists = spark.createDataFrame([("a.b", DAY, 1, "block")], "key string, entry_date date, place int, action string")
    plan = U.judge_captures(df, lists)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_addresses_have_no_domains_above(spark):
    urls = ["http://1.2.3.4:80/x", "http://[2001:DB8::1]:8080/", "https://a.b.c/", "http://1.2.3/", "http://[::1", "//x"]
    df = spark.createDataFrame([(u,) for u in urls], "url string").select(U.host(F.col("url")).alias("h"))
    got = [(r.h, r.d) for r in df.select("h", U.domains(F.col("h")).alias("d")).collect()]
    assert got == [
        ("1.2.3.4", ["1.2.3.4"]),
        ("[2001:db8::1]", ["[2001:db8::1]"]),
        ("a.b.c", ["a.b.c", "b.c"]),
        ("1.2.3", ["1.2.3", "2.3"]),
        (None, []),
        (None, []),
    ]


def test_a_long_list_is_not_multiplied_by_time(spark):
    captures = spark.createDataFrame([(1, "http://a.b/", DAY), (2, "http://a.b/", DAY + dt.timedelta(3650))], "page_id long, url string, fetch_date date")
    lists = spark.createDataFrame([("a.b", DAY, 1, "block")], "key string, entry_date date, place int, action string")
    out = U.judge_captures(captures, lists, keep=("page_id",))
    assert sorted((r.page_id, r.action, r.since) for r in out.collect()) == [(1, "block", DAY), (2, "block", DAY)]
    assert "sequence" not in out._jdf.queryExecution().optimizedPlan().toString().split("Window")[0]
