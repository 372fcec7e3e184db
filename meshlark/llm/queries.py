"""One query per operator of this subpackage, with production parameters and over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import bpe_encode
from .centroids import CENTROIDS, COMPONENTS, ROUNDS, cluster
from .common import table
from .decontaminate import decontaminate
from .exact_dedup import exact_dedup
from .importance import importance_sample
from .jaccard import jaccard_components
from .langid import identify
from .line_dedup import line_dedup
from .packing import pack
from .secrets import secret_scan
from .sharding import TABLE_SIZE, assign_shards, lookup_table
from .substring_dedup import substring_dedup
from .url_filter import host_of, url_filter

#: Shards of the placement query.
SHARDS = [f"shard-{i:03d}" for i in range(100)]
#: Captures and list entries of the URL query are dated within a year from here (2024-01-01 UTC).
EPOCH, DAY = 1_704_067_200, 86_400


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hits")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"), with_text=False)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every document goes."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return assign_shards(docs, ["doc_id"], SHARDS)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("n_chunks")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents")).drop("found")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), with_text=False)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def blocklist(pages: DataFrame) -> DataFrame:
    """A dated list for the hosts of ``pages`` and their parent domains, as the tables have none: derived from digests of the names.

    One name in four is listed; of these one in two is removed after 60 days,
    and of those again one in two listed anew after 120.
    """
    host = host_of(F.col("url"))
    names = pages.select(F.explode(F.array(host, F.regexp_extract(host, r"([^.]+\.[^.]+\.[^.]+)$", 1))).alias("domain")).where("domain <> ''").distinct()
    number = F.conv(F.substring(F.md5("domain"), 1, 15), 16, 10).cast("bigint")
    listed = names.withColumn("m", number).where("m % 4 = 0").withColumn("category", F.element_at(F.array(*map(F.lit, ("adult", "malware", "spam"))), (F.col("m") % 3 + 1).cast("int")))
    day = (F.expr("m div 16") % 300).cast("bigint")
    entry = lambda n, action: F.struct((EPOCH + (day + n) * DAY).alias("at"), F.lit(action).alias("action"))
    log = F.filter(F.array(entry(0, "add"), F.when(F.col("m") % 8 == 0, entry(60, "remove")), F.when(F.col("m") % 16 == 0, entry(120, "add"))), lambda e: e.isNotNull())
    return listed.select("domain", "category", F.explode(log).alias("e")).select("domain", "category", F.timestamp_seconds("e.at").alias("at"), "e.action")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages have no fetch time in the tables; theirs follows from the id, spread over a year."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", F.timestamp_seconds(EPOCH + F.pmod(F.col("page_id") * 7919, F.lit(366 * DAY))))
    return url_filter(captures, blocklist(pages))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe_encode(table(spark, sf_dir, "documents"), with_bytes=True)
    spoken = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(spoken, 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_decontaminate": op3_decontaminate,
    "op4_line_dedup": op4_line_dedup,
    "op5_sharding": op5_sharding,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_secret_scan": op7_secret_scan,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_language_id": op9_language_id,
    "op10_url_filter": op10_url_filter,
    "op11_importance": op11_importance,
    "op12_centroids": op12_centroids,
    "op13_byte_bpe": op13_byte_bpe,
}

_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _centroid_rounds() -> str:
    """Each round's assignments and centroids, one step after another, then the last assignments."""
    steps = []
    for i in range(ROUNDS + 1):
        steps.append(f"""
        p{i} AS (SELECT v.id, v.vec_id, v.q, arg_min(c.c, {{'d': apart(v.q, c.q), 'c': c.c}}) AS c, min(apart(v.q, c.q)) AS d FROM v, c{i} AS c GROUP BY v.id, v.vec_id, v.q)""")
        if i < ROUNDS:
            steps.append(f"""
        s{i} AS (SELECT c, k, sum(q[k])::BIGINT AS s, count(*) AS n FROM (SELECT c, q, unnest(range(1, {COMPONENTS + 1})) AS k FROM p{i}) GROUP BY c, k),
        c{i + 1} AS (SELECT c, coalesce(m.q, c{i}.q) AS q FROM c{i} LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY k) AS q FROM s{i} GROUP BY c) AS m USING (c))""")
    return ",".join(steps).replace("apart(v.q, c.q)", "list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT")


#: Words as the word contract has them; the register of a CRC-32 after each byte, for all distinct runs of words at once.
_RUNS = f"""
        words AS (SELECT kind, id, list_filter(string_split_regex({_ASCII_LOWER.format("coalesce(text, '')")}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
                  FROM (SELECT 0 AS kind, row_number() OVER () AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark)),
        runs AS (SELECT kind, id, array_to_string(w[i:i + k - 1], ' ') AS f FROM (SELECT kind, id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (VALUES (1), (2), (3)) AS n(k) WHERE len(w) >= k)),
        counted AS (SELECT kind, id, f, count(*) AS n FROM runs GROUP BY ALL),
        crcs AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce([b, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS b))),
        bytes AS (SELECT DISTINCT f, hex(encode(f)) AS h FROM counted),
        crc AS (SELECT f, h, 4294967295::BIGINT AS c, 0 AS j FROM bytes
                UNION ALL SELECT f, h, xor(c >> 8, t[xor(c & 255, ('0x' || substr(h, 2 * j + 1, 2))::BIGINT) + 1]), j + 1 FROM crc, crcs WHERE 2 * j < length(h)),
        bucket AS (SELECT f, xor(c, 4294967295) % 10000 AS b FROM crc WHERE 2 * j = length(h))"""

ORACLE_SQL: dict[str, str] = {
    "op2_jaccard_join": f"""
        WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex({_ASCII_LOWER.format("coalesce(text, '')")}, '[ \\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        sets AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
        sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
        pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM sets x JOIN sets y USING (s) WHERE x.doc_id < y.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
        ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT doc_id, b FROM reach JOIN ways ON r = a)
        SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r) AS component_id FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id""",
    "op3_decontaminate": f"""
        WITH d AS (SELECT doc_id, list_filter(string_split_regex({_ASCII_LOWER.format("coalesce(text, '')")}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
        b AS (SELECT item_id, list_filter(string_split_regex({_ASCII_LOWER.format("coalesce(text, '')")}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, w[i:i + 9] AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT len(win) AS n FROM win),
        dw AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
        hit AS (SELECT doc_id, i, n, item_id FROM (SELECT doc_id, i, n, w[i:i + n - 1] AS win FROM dw) JOIN win USING (win)),
        words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
        its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM hit GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op4_line_dedup": f"""
        WITH lines AS (SELECT doc_id, i, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i
                       FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
        keyed AS (SELECT *, {_ASCII_LOWER.format("regexp_replace(line, '^[ \\x09-\\x0D]+|[ \\x09-\\x0D]+$', '', 'g')")} AS k FROM lines),
        rep AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
        judged AS (SELECT doc_id, i, line, keeper IS NOT NULL AND doc_id < keeper AS gone FROM keyed LEFT JOIN rep USING (k))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM judged GROUP BY doc_id""",
    "op5_sharding": f"""
        SELECT doc_id, slot, 'shard-' || lpad(string_split('{",".join(map(str, lookup_table(SHARDS)))}', ',')[slot + 1], 3, '0') AS shard
        FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(length(doc_id::VARCHAR) || ':' || doc_id, '-')), 1, 15))::BIGINT % {TABLE_SIZE} AS slot FROM documents)""",
    "op6_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)""",
    "op7_secret_scan": """
        WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
        m AS (SELECT doc_id, source, 'assign' AS kind, 0 AS k, regexp_extract_all(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0) AS hits,
                     regexp_extract_all(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS vals,
                     string_split_regex(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS gaps FROM d
              UNION ALL SELECT doc_id, source, 'access', 1, regexp_extract_all(t, 'AKIA[A-Z0-9]{12,}'), regexp_extract_all(t, 'AKIA[A-Z0-9]{12,}'), string_split_regex(t, 'AKIA[A-Z0-9]{12,}') FROM d
              UNION ALL SELECT doc_id, source, 'hex', 2, regexp_extract_all(t, '[0-9a-f]{32,}'), regexp_extract_all(t, '[0-9a-f]{32,}'), string_split_regex(t, '[0-9a-f]{32,}') FROM d
              UNION ALL SELECT doc_id, source, 'owned', 3, regexp_extract_all(t, '[A-Za-z0-9+/_=-]{24,}'), regexp_extract_all(t, '[A-Za-z0-9+/_=-]{24,}'), string_split_regex(t, '[A-Za-z0-9+/_=-]{24,}') FROM d),
        placed AS (SELECT doc_id, source, kind, k, vals[i] AS v,
                      (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s, length(hits[i]) AS n
               FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m)),
        base AS (SELECT *, s + n AS e FROM placed WHERE k < 3 AND (k > 0 OR length(v) >= 8)),
        extra AS (SELECT *, s + n AS e FROM placed a WHERE k = 3 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')
                  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = a.doc_id AND b.s < a.s + a.n AND a.s < b.e)),
        cand AS (SELECT * FROM base UNION ALL SELECT * FROM extra),
        owners AS (SELECT v, count(DISTINCT source) AS owners, count(DISTINCT coalesce(doc_id::VARCHAR, '')) AS repos FROM cand GROUP BY v),
        kept AS (SELECT cand.*, owners, repos FROM cand JOIN owners USING (v) WHERE k < 3 OR owners <= 1),
        g AS (SELECT doc_id, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS c, count(*) FILTER (k = 2) AS h,
                     string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3) AS b, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans,
                     count(*) FILTER (owners <= 1) AS live, count(*) FILTER (owners >= 3 AND repos >= 3) AS ex, max(owners) AS mo, max(repos) AS mr FROM kept GROUP BY doc_id)
        SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256,
               coalesce(spans, '') AS spans, coalesce(live, 0) AS n_live, coalesce(ex, 0) AS n_example,
               coalesce(mo, 0) AS most_owners, coalesce(mr, 0) AS most_repositories
        FROM d LEFT JOIN g USING (doc_id)""",
    "op8_substring_dedup": """
        WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        wins AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
        later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM wins) WHERE r > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p, true AS gone FROM later),
        each AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
        g AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS r, string_agg(x, ' ' ORDER BY p) FILTER (gone IS NULL) AS kept FROM each LEFT JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(r, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)""",
    "op10_url_filter": f"""
        WITH h AS (SELECT page_id, {EPOCH} + page_id * 7919 % {366 * DAY} AS fetched,
                   {_ASCII_LOWER.format("regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\\\]*)', 1), '^.*@', ''), '\\.?(:[0-9]*)?$', '')")} AS host FROM pages),
        names AS (SELECT DISTINCT domain FROM (SELECT host AS domain FROM h UNION ALL SELECT regexp_extract(host, '([^.]+\\.[^.]+\\.[^.]+)$', 1) FROM h) WHERE domain <> ''),
        listed AS (SELECT domain, ['adult', 'malware', 'spam'][m % 3 + 1] AS category, m, {EPOCH} + (m // 16 % 300) * {DAY} AS t
                   FROM (SELECT domain, ('0x' || substr(md5(domain), 1, 15))::BIGINT AS m FROM names) WHERE m % 4 = 0),
        spells AS (SELECT domain, category, t AS a, CASE WHEN m % 8 = 0 THEN t + 60 * {DAY} END AS z FROM listed
                   UNION ALL SELECT domain, category, t + 120 * {DAY}, NULL FROM listed WHERE m % 16 = 0),
        parts AS (SELECT page_id, fetched, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, fetched, string_split(host, '.') AS l FROM h WHERE host <> '')),
        hit AS (SELECT page_id, domain, category FROM (SELECT page_id, fetched, array_to_string(l[i:], '.') AS domain FROM parts) JOIN spells USING (domain)
                WHERE a <= fetched AND (z IS NULL OR fetched < z)),
        g AS (SELECT page_id, arg_max(domain, length(domain)) AS matched_domain, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM hit GROUP BY page_id)
        SELECT page_id, host, matched_domain IS NOT NULL AS blocked, matched_domain, categories FROM h LEFT JOIN g USING (page_id)""",
    "op11_importance": f"""
        WITH RECURSIVE {_RUNS},
        per AS (SELECT kind, id, b, sum(n)::BIGINT AS n FROM counted JOIN bucket USING (f) GROUP BY kind, id, b),
        totals AS (SELECT coalesce(sum(n) FILTER (kind = 0), 0)::BIGINT AS s_all, coalesce(sum(n) FILTER (kind = 1), 0)::BIGINT AS t_all FROM per),
        gains AS (SELECT b, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS g
                  FROM (SELECT b, coalesce(sum(n) FILTER (kind = 0), 0)::BIGINT AS s, coalesce(sum(n) FILTER (kind = 1), 0)::BIGINT AS t FROM per GROUP BY b), totals),
        weights AS (SELECT id, sum(n)::BIGINT AS n_features, sum(n * g)::BIGINT AS weight FROM per JOIN gains USING (b) WHERE kind = 0 GROUP BY id),
        scored AS (SELECT doc_id, len(w) >= 20 AS fit, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                   coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
                   FROM (SELECT row_number() OVER () AS id, doc_id FROM documents) JOIN (FROM words WHERE kind = 0) USING (id) LEFT JOIN weights USING (id)),
        placed AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id) AS r, count(*) FILTER (fit) OVER () AS n FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN fit AND r <= 5 * n // 100 THEN r END AS rank FROM placed""",
    "op12_centroids": f"""
        WITH v AS (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
                   WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda x: isfinite(x))) = {COMPONENTS}),
        c0 AS (SELECT row_number() OVER (ORDER BY h, q) - 1 AS c, q FROM (SELECT sha256('2:' || vec_id) AS h, q FROM v ORDER BY h, q LIMIT {CENTROIDS})),{_centroid_rounds()}
        SELECT vec_id, c::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
               sha256(array_to_string(z.q, ',')) AS centroid_sha256
        FROM p{ROUNDS} AS p JOIN c{ROUNDS} AS z USING (c)""",
}
