"""The registered queries of this package: thin, with production parameters, over whole tables."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidimus.llm import alignment, bpe, chat, exact, licences, lm, negatives, packing, quality, rules, simhash, suffixes, urls
from vidimus.llm.common import read

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def registered(sql: str | None = None) -> Callable[[Plan], Plan]:
    def add(plan: Plan) -> Plan:
        QUERIES[plan.__name__] = plan
        if sql is not None:
            SQL[plan.__name__] = sql
        return plan

    return add


def _duck_canonical(text: str) -> str:
    """licences.canonical as DuckDB SQL over the column `text`; built from the same fixed values."""
    low = f"lower(coalesce({text}, ''))"
    bare = f"regexp_replace({low}, '(?m){licences.COPYRIGHT}', '', 'g')"
    flat = f"trim(regexp_replace(regexp_replace({bare}, '{licences.PUNCTUATION}', ' ', 'g'), '{licences.WIDE_PUNCTUATION}', ' ', 'g'))"
    one = "flat"
    for spelled, to in licences.EQUIVALENT:
        one = f"regexp_replace({one}, '\\b{spelled}\\b', '{to.replace('$1', chr(92) + '1')}', 'g')"
    return f"SELECT *, CASE WHEN {' OR '.join(f"contains(flat, '{h}')" for h in licences.HINTS)} THEN {one} ELSE flat END AS canon FROM (SELECT *, {flat} AS flat"


def _known_values() -> str:
    rows = [(k, n.format(name)) for k, names in licences.NAMES.items() for name in names for n in licences.NOTICES] + list(licences.known_texts())
    return ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in rows)


OP1_SQL = f"""
WITH known AS (
  SELECT canon, min(licence) AS licence FROM ({_duck_canonical('t')} FROM (VALUES {_known_values()}) v(licence, t))) GROUP BY canon),
whole AS (SELECT doc_id, canon FROM ({_duck_canonical('text')} FROM documents))),
lines AS (SELECT doc_id, canon FROM ({_duck_canonical('line')} FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)))),
hits AS (SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS line_licences, count(*) AS n_licence_lines
  FROM lines JOIN known USING (canon) GROUP BY doc_id)
SELECT doc_id, licence, coalesce(line_licences, '') AS line_licences, coalesce(n_licence_lines, 0) AS n_licence_lines
FROM whole LEFT JOIN known USING (canon) LEFT JOIN hits USING (doc_id)
"""


@registered(OP1_SQL)
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(read(spark, sf_dir, "documents"), licences.known_licences(spark))


@registered()
def op2_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@registered()
def op3_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return near.select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


OP4_SQL = r"""
WITH turns AS (
  SELECT conv_id, coalesce(turn, -1) AS turn, list(DISTINCT {'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY {'role': coalesce(role, ''), 'text': coalesce(text, '')}) AS said
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY ALL),
conv AS (SELECT conv_id, list(said ORDER BY turn) AS c, len(list(said)) AS n FROM turns GROUP BY conv_id),
single AS (SELECT min(conv_id) AS conv_id, c, any_value(n) AS n FROM conv GROUP BY c),
starts AS (SELECT DISTINCT c[1:k] AS c FROM (SELECT c, unnest(range(1, n)) AS k FROM conv)),
kept AS (SELECT conv_id, n FROM single ANTI JOIN starts USING (c)),
shown AS (
  SELECT conv_id, turn, n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place,
    list_aggregate(list_transform(said, lambda m: '<|im_start|>' || m.role || chr(10) || m.text || '<|im_end|>' || chr(10)), 'string_agg', '') AS rendered
  FROM turns JOIN kept USING (conv_id))
SELECT conv_id, place, rendered, CAST(sum(length(rendered)) OVER (PARTITION BY conv_id ORDER BY place) - length(rendered) AS BIGINT) AS char_start, n AS turns
FROM shown
"""


@registered(OP4_SQL)
def op4_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(read(spark, sf_dir, "conversations"))


#: Fixed values of the contract, and the list used beside them: pages (host and path) seen with a tracking parameter.
URL_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"),
]
TRACKED = "utm_source="

OP5_SQL = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
r AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM u),
p AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
j AS (SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule,
  bool_or(contains(url, 'utm_source=')) OVER (PARTITION BY host || path) AS listed FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN listed THEN 'block' ELSE 'allow' END AS verdict FROM j
"""


@registered(OP5_SQL)
def op5_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.filter(F.col("url").contains(TRACKED)).select(F.concat(*urls.host_and_path()).alias("key")).distinct()
    return urls.judge_urls(pages, URL_RULES, listed, by=("host", "path"))


@registered()
def op6_bpe_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(read(spark, sf_dir, "documents"))
    return coded.select(
        "doc_id", "n_tokens", F.sha2(F.encode("ids", "UTF-8"), 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256")
    )


@registered()
def op7_rule_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@registered()
def op8_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(read(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""


@registered(OP9_SQL)
def op9_exact_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(read(spark, sf_dir, "documents"))


@registered()
def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


OP11_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT r, s, md5(b[s + 1 : s + 200]) AS k FROM (SELECT r, b, unnest(range(octet_length(b) - 199)) AS s FROM d)),
twice AS (SELECT r, s FROM (SELECT r, s, count(*) OVER (PARTITION BY k) AS n FROM w) WHERE n > 1),
marked AS (SELECT r, s, coalesce(s > lag(s) OVER (PARTITION BY r ORDER BY s) + 200, true) AS new FROM twice),
runs AS (SELECT r, s, sum(CAST(new AS INT)) OVER (PARTITION BY r ORDER BY s) AS span FROM marked),
spans AS (SELECT r, min(s) AS b0, max(s) + 200 AS b1 FROM runs GROUP BY r, span),
cuts AS (SELECT r, b0, b1 FROM spans UNION ALL SELECT r, octet_length(b), octet_length(b) FROM d),
kept AS (SELECT r, b0, b1, coalesce(lag(b1) OVER (PARTITION BY r ORDER BY b0, b1), 0) AS past FROM cuts),
pieces AS (SELECT r, b1 - b0 AS gone, b0, b1, CASE WHEN b0 > past THEN hex(b[past + 1 : b0]) ELSE '' END AS piece FROM kept JOIN d USING (r))
SELECT doc_id, CAST(octet_length(any_value(b)) AS BIGINT) AS n_bytes, CAST(sum(gone) AS BIGINT) AS n_removed, count(*) FILTER (gone > 0) AS n_spans,
  sha256(unhex(string_agg(piece, '' ORDER BY b0, b1))) AS kept_sha256
FROM pieces JOIN d USING (r) GROUP BY r, doc_id
"""


@registered(OP11_SQL)
def op11_suffix_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(read(spark, sf_dir, "documents")).drop("spans")


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id AS negative_id,
  positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3
"""


@registered(OP12_SQL)
def op12_segment_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(read(spark, sf_dir, "embeddings"))


@registered()
def op13_pair_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read(spark, sf_dir, "documents"))
