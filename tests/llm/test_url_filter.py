from datetime import datetime

import pytest
from pyspark.sql import functions as F

from meshlark.llm.url_filter import host_of, url_filter, validity_intervals


def day(n):
    return datetime(2024, 1, n)


ENTRIES = [
    ("bad.org", "spam", day(5), "add"), ("bad.org", "spam", day(7), "add"), ("bad.org", "spam", day(10), "remove"), ("bad.org", "spam", day(20), "add"),
    ("sub.bad.org", "adult", day(1), "add"), ("never.org", "spam", day(3), "remove"), ("tie.org", "spam", day(4), "add"), ("tie.org", "spam", day(4), "remove"),
    (None, "spam", day(1), "add"), ("x.org", None, day(2), "add"), ("y.org", "spam", None, "add"), ("z.org", "spam", day(1), "other"), ("org", "tld", day(25), "add"),
]


@pytest.fixture
def entries(spark):
    return spark.createDataFrame(ENTRIES, "domain string, category string, at timestamp, action string")


def brute(host, at):
    found = []
    for domain in {".".join(host.split(".")[i:]) for i in range(host.count(".") + 1)} if host else ():
        for category in {c for d, c, *_ in ENTRIES if d == domain}:
            log = {}
            for d, c, t, action in ENTRIES:
                if d == domain and c == category and t and action in ("add", "remove") and at and t <= at:
                    log[t] = min(log.get(t, 1), int(action == "add"))
            if log and log[max(log)]:
                found.append((domain, category or ""))
    return (max((d for d, _ in found), key=len, default=None), ",".join(sorted({c for _, c in found})) if found else None)


def test_matches_brute_force(spark, entries, clashing):
    hosts = ["bad.org", "www.bad.org", "a.sub.bad.org", "sub.bad.org", "notbad.org", "tie.org", "never.org", "x.org", "y.org", "z.org", "org", "other.net"]
    rows = [(n, f"http://{h}/p?q#{n}", day(d)) for n, (h, d) in enumerate((h, d) for h in hosts for d in (1, 2, 4, 5, 9, 10, 19, 20, 25, 30))]
    rows += [(900, None, day(6)), (901, "no url", day(6)), (902, "http://bad.org/", None), (None, "HTTPS://User:pw@WWW.Bad.Org.:8080", day(6)), (1, "http://bad.org/", day(6)), (1, "http://bad.org/", day(6))]
    df = spark.createDataFrame(rows, "page_id bigint, url string, fetched_at timestamp")
    names = ["host", "domain", "blocked", "page", "fetched", "best", "category", "at"]
    got = url_filter(df.withColumns({n: F.lit("x") for n in names}), entries).collect()
    host = lambda u: "www.bad.org" if u and "@" in u else u.split("/")[2].lower() if u and "//" in u else ""
    want = [(n, host(u), *brute(host(u), t)) for n, u, t in rows]
    assert sorted(((r.page_id, r.host, r.matched_domain, r.categories) for r in got), key=str) == sorted(want, key=str)
    assert all(r.blocked == (r.matched_domain is not None) for r in got) and sum(r.blocked for r in got) > 20


def test_intervals(entries):
    got = {(r.domain, r.category, r.valid_from.day, r.valid_to and r.valid_to.day) for r in validity_intervals(entries).collect()}
    assert got == {("bad.org", "spam", 5, 10), ("bad.org", "spam", 20, None), ("sub.bad.org", "adult", 1, None), ("x.org", "", 2, None), ("org", "tld", 25, None)}


def test_hosts_and_empty_tables(spark, entries):
    urls = ["http://A.b.C/x", "ftp://u@h:21", "http://h.", "http:///x", "//h/x", "mailto:x@y", "http://a\\b/c"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r.h for r in df.select(host_of(F.col("u")).alias("h")).collect()] == ["a.b.c", "h", "h", "", "", "", "a"]
    pages = spark.createDataFrame([(1, "http://bad.org/", day(6))], "page_id bigint, url string, fetched_at timestamp")
    assert url_filter(pages.limit(0), entries).count() == 0
    assert not url_filter(pages, entries.limit(0)).first().blocked


def test_hosts_of_any_number_of_labels(spark, entries):
    hosts = ["a." * n + "bad.org" for n in (125, 126, 127, 128, 1000)] + ["a..bad.org", ".bad.org", "bad.org..", "."]
    df = spark.createDataFrame([(n, f"http://{h}/", day(6)) for n, h in enumerate(hosts)], "page_id bigint, url string, fetched_at timestamp")
    got = {r.page_id: (r.host, r.matched_domain, r.categories) for r in url_filter(df, entries).collect()}
    host = lambda h: h.removesuffix(".")
    assert got == {n: (host(h), *brute(host(h), day(6))) for n, h in enumerate(hosts)}
    assert sum(m == "bad.org" for _, m, _ in got.values()) == 7


def test_wrong_clocks_cost_nothing(spark):
    """Captures of 1970 and 9990 among thousands of open listings: intervals go to captured spans alone."""
    log = spark.range(2000).selectExpr("concat('d', id, '.org') AS domain", "'spam' AS category", "timestamp '2024-01-01' AS at", "'add' AS action")
    rows = [(1, "http://d7.org/", "1970-01-01"), (2, "http://www.d7.org/", "2024-02-01"), (3, "http://d8.org/", "9990-01-01"), (4, "http://e.org/", "2024-02-01")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, fetched_at string")
    out = url_filter(df, log)
    assert {r.page_id: r.matched_domain for r in out.collect()} == {1: None, 2: "d7.org", 3: "d8.org", 4: None}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == plan.count("Generate explode(sequence(1, size(split(host")
