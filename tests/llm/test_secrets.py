import hashlib
import random
import re

from pyspark.sql import functions as F

from meshlark.llm import secrets
from meshlark.llm.secrets import secret_scan

PATTERNS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 8, 2),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16, 0),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32, 0),
]
OPAQUE = re.compile(r"[A-Za-z0-9+/_=-]{24,}")
KINDS = ["assign", "access", "hex", "owned"]


def brute(rows, max_owners=1):
    spans, owners = [], {}
    for i, t, source in rows:
        t, found = t or "", []
        for kind, pattern, keep, group in PATTERNS:
            found += [(m.start(), KINDS.index(kind), m.end(), m[group]) for m in pattern.finditer(t) if keep(m)]
        extra = [(m.start(), 3, m.end(), m[0]) for m in OPAQUE.finditer(t) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and not any(s < m.end() and m.start() < e for s, _, e, _ in found)]
        for x in found + extra:
            owners.setdefault(x[3], set()).add(source)
        spans.append((i, sorted(found), sorted(extra)))
    out = []
    few = lambda v: len(owners[v] - {None}) <= max_owners
    for i, base, extra in spans:
        every = sorted(base + [x for x in extra if few(x[3])])
        text = lambda xs: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in xs)
        n = [sum(x[1] == k for x in base) for k in range(3)]
        out.append((str(i), *n, hashlib.sha256(text(base).encode()).hexdigest(), text(every), sum(few(x[3]) for x in every), sum(len(owners[x[3]] - {None}) >= 3 for x in every)))
    return sorted(out)


def corpus():
    rng = random.Random(8)
    secret = ["04dbebab91ab85687d33eeaaf9ac699e1188f962", "AKIA" + "Q7" * 8, "hunter2hunter2", "a" * 40, "Zm9vYmFyYmF6cXV4MTIzNDU2Nzg5MA==", "short", "AKIAAKIAAKIA", "x" * 30]
    key = ["password", "TOKEN", "api_key", "ApiKey", "secret", "passwd", "key", "ſecret", "toKen"]
    sep = [" = ", ":", '": "', "='", " == ", "\n=", "=token: ", " "]
    rows = []
    for i in range(150):
        parts = [rng.choice(["über 🙂 ", "plain words ", "abc def0 ", "東京", "password=token:abcdefgh123 "]) if rng.random() < 0.5 else rng.choice(key) + rng.choice(sep) + rng.choice(secret) + rng.choice([" ", "", '"', "#"]) for _ in range(rng.choice([0, 1, 5, 30]))]
        rows.append((i, "".join(parts), rng.choice(["s1", "s1", "s1", "s2", None])))
    rows += [(900 + k, f"sample token = EXAMPLE-key-that-everyone-copies-{0}1", f"o{k}") for k in range(5)]
    rows += [(1000, None, "s1"), (1001, "", None), (1002, "token=abcdefgh " * 1500, "s9"), (None, "secret=12345678x", "s1"), (None, "nothing", "s1"), (1003, "secret=12345678y", "s1"), (1003, "secret=12345678y", "s1")]
    return rows


def test_matches_brute_force(spark, clashing):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    got = secret_scan(clashing(df)).collect()
    assert sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans, r.n_live, r.n_example) for r in got) == brute(rows)
    assert any("owned" in r.spans for r in got) and any(r.n_example for r in got) and any(r.n_live for r in got)
    assert secret_scan(df.limit(0)).count() == 0


def test_running_sums_of_any_length(spark):
    for n in (0, 1, 255, 256, 257, 700):
        row = spark.range(1).select(secrets.running_sums(F.transform(F.sequence(F.lit(1), F.lit(max(n, 1))), lambda x: x.cast("bigint")) if n else F.array().cast("array<bigint>")).alias("s")).first()
        assert row.s == [k * (k + 1) // 2 for k in range(1, n + 1)]


def test_repositories_decide_too(spark):
    """Three owners in one repository are one copy; in three repositories they are an example."""
    rows = [(1, "token = abcdefgh1", f"o{k}", "one") for k in range(3)] + [(k, "token = abcdefgh2", f"o{k}", f"r{k}") for k in range(2, 5)] + [(None, "token = abcdefgh3 " + "x" * n, None, None) for n in range(4)]
    got = secret_scan(spark.createDataFrame(rows, "doc_id bigint, text string, source string, repo string"), repo_col="repo").collect()
    assert sorted((r.n_example, r.most_owners, r.most_repositories) for r in got) == [(0, 0, 1)] * 4 + [(0, 3, 1)] * 3 + [(1, 3, 3)] * 3
    long = "über " * 400_000 + "password = longlonglong1 " + "x y " * 100_000
    (r,) = secret_scan(spark.createDataFrame([(1, long, "s")], "doc_id bigint, text string, source string")).collect()
    assert r.spans == f"assign:2000000:{2000000 + len('password = longlonglong1')}"
