"""The registered queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, lexical, license_scan, near_dedup, packing, pii, simhash, substring_dedup, token_counts, toxicity, url_filter, vector_codes
from .common import table

RULES = [
    url_filter.Rule("block", "net", "/"),
    url_filter.Rule("allow", "example.net", "/en/"),
    url_filter.Rule("block", "example.com", "/de/"),
    url_filter.Rule("allow", "org", "/fr/"),
]
#: The listed urls: numbered pages of one host in four languages, as a blocklist feed would name them.
LISTED_HOSTS, LISTED_LANGS, LISTED_PAGES = ("spam-farm.example.com", "spam-farm.example.org"), ("en", "de", "fr", "es"), 10_000


def listed_urls(spark: SparkSession) -> DataFrame:
    hosts, langs = (F.array(*[F.lit(x) for x in xs]) for xs in (LISTED_HOSTS, LISTED_LANGS))
    rows = spark.range(LISTED_PAGES).withColumn("h", F.explode(hosts)).withColumn("l", F.explode(langs))
    return rows.select(F.format_string("https://%s/%s/%d", "h", "l", "id").alias("url"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), listed_urls(spark), RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = token_counts.token_lengths(table(spark, sf_dir, "documents"))
    return token_counts.suffix_sums(token_counts.length_histogram(lengths))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.match_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, toxicity.training_rows(labels))
    scored = toxicity.score_documents(docs, model, ["doc_id"], locate=True)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "worst_start", "worst_end", "worst_probability")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), pii.Surrogates(pii.session_key(spark)), found="n_entities")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licences(table(spark, sf_dir, "documents"))


def op10_licence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_windows(table(spark, sf_dir, "documents"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_table(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_url_filter, op2_substring_dedup, op3_near_dedup, op4_token_counts, op5_decontaminate, op6_toxicity, op7_pii, op8_packing, op9_nearest, op10_licences, op10_licence_windows, op11_simhash, op12_ranked_search, op13_vector_codes)
}

_HOST_PATH = r"""
SELECT page_id, translate(regexp_extract(a, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(a, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(regexp_extract(a, '(\?[^#]*)', 1), '^\?(.*)$', 1) AS query
FROM (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS a FROM pages)
"""

SQL: dict[str, str] = {
    "op1_url_filter": rf"""
WITH u AS ({_HOST_PATH}),
c AS (SELECT page_id, host, path,
  CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, ':(80|443)?$', ''), '^www\.', '') || regexp_replace(regexp_replace(path, '/+', '/', 'g'), '/$', '')
    || CASE WHEN len(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))) > 0
       THEN '?' || array_to_string(list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))), '&') ELSE '' END END AS k FROM u),
listed AS (SELECT h || '/' || l || '/' || i AS k FROM unnest(['spam-farm.example.com', 'spam-farm.example.org']) a(h), unnest(['en', 'de', 'fr', 'es']) b(l), range(10000) r(i)),
r AS (SELECT page_id, host, path, k, CASE
  WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM c)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN k IN (SELECT k FROM listed) THEN 'block' ELSE 'allow' END AS verdict FROM r
""",
}


def _licence_sql() -> str:
    """Every line and every paragraph of every document against every template."""
    values = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in license_scan.TEMPLATES + license_scan.FULL_TEXTS)
    words = lambda x: f"list_filter(string_split(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '')"
    grams = "CASE WHEN len(w) = 1 THEN [w[1] || ' ' || w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END"
    return f"""
WITH t AS (SELECT template, {grams} AS g FROM (SELECT template, {words('wording')} AS w FROM (VALUES {values}) v(template, wording))),
d AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
l AS (SELECT row, doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM d),
w AS (SELECT row, doc_id, line, {words('x')} AS w FROM l),
r AS (SELECT *, line - row_number() OVER (PARTITION BY row ORDER BY line) AS run FROM w WHERE len(w) > 0),
u AS (SELECT row, doc_id, line, 1 AS n_lines, w FROM r UNION ALL SELECT row, doc_id, min(line), count(*), flatten(list(w ORDER BY line)) FROM r GROUP BY row, doc_id, run HAVING count(*) > 1),
s AS (SELECT row, doc_id, line, n_lines, {grams} AS g FROM u),
c AS (SELECT row, doc_id, line, n_lines, template, 2.0::DOUBLE * len(list_intersect(s.g, t.g)) / (len(s.g) + len(t.g)) AS dice, len(s.g) AS n FROM s, t WHERE len(s.g) <= 3 * len(t.g))
SELECT doc_id, line::INT AS line, n_lines::INT AS n_lines, template, round(dice, 6) AS dice, n::INT AS n_grams
FROM (SELECT *, row_number() OVER (PARTITION BY row, line, n_lines ORDER BY dice DESC, template) AS rn FROM c WHERE dice >= 0.8) WHERE rn = 1
"""


SQL["op10_licences"] = _licence_sql()

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"

SQL["op12_ranked_search"] = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS t FROM documents WHERE text IS NOT NULL),
n AS (SELECT row, doc_id, len(t)::BIGINT AS n FROM d WHERE len(t) > 0),
s AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS nt FROM n),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
p AS (SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY row, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(nd) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term),
i AS (SELECT row, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * nd) // nt))) AS part FROM p JOIN w USING (term) JOIN n USING (row), s),
r AS (SELECT item_id, row, doc_id, sum(part)::BIGINT AS score FROM q JOIN i USING (term) GROUP BY item_id, row, doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 10
"""


def _codes_sql() -> str:
    """Plain assignment to every entry, twice with a move of the entries and once without."""
    xs = [f"x{i}" for i in range(4)]
    distance = " + ".join(f"(p.{x} - b.{x}) * (p.{x} - b.{x})" for x in xs)
    mean = lambda x: f"((sum({x}) - ((sum({x}) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS {x}"
    steps = []
    for r in range(3):
        steps.append(f"a{r} AS MATERIALIZED (SELECT r, part, min(({distance}) * 64 + entry) AS k FROM p JOIN b{r} b USING (part) GROUP BY r, part)")
        if r < 2:
            steps.append(f"m{r} AS (SELECT part, k % 64 AS entry, {', '.join(mean(x) for x in xs)} FROM p JOIN a{r} USING (r, part) GROUP BY part, k % 64)")
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT part, entry, {', '.join(f'coalesce(m.{x}, b.{x}) AS {x}' for x in xs)} FROM b{r} b LEFT JOIN m{r} m USING (part, entry))")
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, part, {', '.join(f'x[part * 4 + {i + 1}] AS x{i}' for i in range(4))} FROM v, range(16) t(part)),
b0 AS MATERIALIZED (SELECT part, r AS entry, {', '.join(xs)} FROM p WHERE r < 64),
{", ".join(steps)},
c AS (SELECT r, string_agg(format('{{:02x}}', k % 64), '' ORDER BY part) AS code, sum(k // 64)::BIGINT AS error FROM a2 GROUP BY r),
h AS (SELECT sha256(string_agg(concat_ws(',', {', '.join(xs)}), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2),
l AS (SELECT label, sum(error)::BIGINT AS label_error FROM v JOIN c USING (r) GROUP BY label)
SELECT vec_id, code, error, label_error, codebooks_sha256 FROM v JOIN c USING (r) JOIN l ON v.label IS NOT DISTINCT FROM l.label, h
"""


SQL["op13_vector_codes"] = _codes_sql()
