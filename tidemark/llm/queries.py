"""Named queries of the training-data operators, and SQL oracles where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import ann, bpe, divergence, exact_dedup, jaccard_join, language_id, license_scan, manifest, minhash, mixing, quality, secrets, token_rollups
from tidemark.llm.common import documents, shared_folder


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict_languages(documents(spark, sf_dir))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_groups(documents(spark, sf_dir))


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.predict_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(documents(spark, sf_dir))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op7_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/rollup-{uuid.uuid4().hex}"
    return token_rollups.feed(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), path).totals()


def op8_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.search(vectors, vectors.where("vec_id % 100 = 0"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir).select("doc_id", "source"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_report(documents(spark, sf_dir))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_copies(documents(spark, sf_dir))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(documents(spark, sf_dir))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(documents(spark, sf_dir), F.crc32(F.col("doc_id").cast("string")) % 3 == 0)


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
"""

OP7_SQL = r"""
WITH c AS (
  SELECT doc_id, source, lang, coalesce(text, '') AS t,
         regexp_replace(coalesce(text, ''), '[|%&$#*!]', '', 'g') AS t2
  FROM documents),
n AS (
  SELECT doc_id, source, lang, unnest(['words-v1', 'bytes-v1']) AS version,
         unnest([len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')), strlen(t)]) AS n1,
         unnest([len(regexp_extract_all(t2, '[^\x20\x09-\x0D]+')), strlen(t2)]) AS n2
  FROM c),
m AS (
  SELECT doc_id, bool_or(toxic = 1) AS toxic, min(quality) AS quality
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id)
SELECT source, lang, version, CAST(count(*) AS BIGINT) AS n_docs,
       CAST(sum(CASE WHEN quality = 0 THEN n2 ELSE n1 END) AS BIGINT) AS n_tokens
FROM n LEFT JOIN m USING (doc_id)
WHERE NOT coalesce(toxic, false)
GROUP BY source, lang, version
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _near_sql(k: int, percent: int) -> str:
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) >= {k} THEN list_distinct(list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c WHERE 100 * c >= {percent} * (n + m - c)),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT s.doc_id, CAST(len(any_value(s.s)) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(min(r.y), s.doc_id)) AS component_id FROM s LEFT JOIN r ON r.x = s.doc_id GROUP BY s.doc_id
"""


def _secrets_sql() -> str:
    """Matches of each rule are what lies between the pieces of the text split by it; places are sums of lengths."""
    quoted = lambda p: p.replace("'", "''")
    parts = [f"SELECT doc_id, {k} AS k, '{name}' AS name, {least} AS least, {value} AS value, string_split_regex(t, '{quoted(p)}') AS p, regexp_extract_all(t, '{quoted(p)}') AS m FROM d" for k, (name, p, least, value, _) in enumerate(secrets.RULES)]
    base = len(secrets.BASE_RULES)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({' UNION ALL '.join(parts)}),
e AS (SELECT *, unnest(range(1, len(m) + 1)) AS j FROM f WHERE len(m) > 0),
s AS (
  SELECT doc_id, k, name, least, value, m[j] AS s, CAST(list_sum(list_transform(p[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:j - 1], lambda x: length(x))), 0) AS BIGINT) AS a FROM e),
g AS (SELECT *, a + length(s) AS b, concat(name, ':', a, ':', a + length(s)) AS span FROM s
  WHERE length(CASE WHEN value > 0 THEN regexp_extract(s, '[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1) ELSE s END) >= greatest(least, value))
SELECT d.doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY a, k) FILTER (k < {base}), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY a, k), '') AS spans
FROM d LEFT JOIN g USING (doc_id) GROUP BY d.doc_id
"""


def _licenses_sql() -> str:
    grams = [f"('{a}', '{b}', {t}, {at}, {n}, {base}, '{label}')" for a, b, t, at, n, base, label in license_scan.template_grams()]
    return rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT doc_id, w[i] AS a, w[i + 1] AS b, i - 1 AS place FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM w)),
t(a, b, template, spot, grams, base, label) AS (VALUES {', '.join(grams)}),
h AS (SELECT doc_id, template, any_value(label) AS label, any_value(base) AS base, any_value(grams) AS grams, place - spot AS diagonal, bit_or(1::BIGINT << spot) AS places FROM g JOIN t USING (a, b) GROUP BY doc_id, template, place - spot),
m AS (SELECT *, CASE WHEN base THEN places ELSE bit_or(places) OVER (PARTITION BY doc_id, template ORDER BY diagonal RANGE BETWEEN CURRENT ROW AND {license_scan.NEAR} FOLLOWING) END AS held FROM h),
s AS (SELECT *, bit_count(held)::DOUBLE / grams AS share FROM m WHERE bit_count(held)::DOUBLE / grams >= CASE WHEN base THEN 1.0 ELSE {license_scan.SHARE} END)
SELECT w.doc_id, CAST(len(any_value(w.w)) AS BIGINT) AS n_words, count(*) FILTER (base) AS n_base, CAST(min(diagonal) FILTER (base) AS BIGINT) AS first_word, CAST(max(diagonal) FILTER (base) AS BIGINT) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(share), 0.0)::DOUBLE AS score
FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id
"""


OP9_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(source, chr(0)) AS source_key, substr(md5(concat(doc_id, ':9')), 1, 10) AS h FROM documents),
q AS (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY h, doc_id) - 1 AS place FROM d),
c AS (SELECT source_key, pow(count(*), {mixing.ALPHA}) AS share FROM d GROUP BY 1),
x AS (SELECT source_key, greatest({mixing.PERIOD}, {mixing.EACH} * count(*) OVER ()) AS slots, share / sum(share) OVER () * slots AS exact FROM c),
y AS (SELECT *, greatest(1, floor(exact))::BIGINT AS low, row_number() OVER (ORDER BY floor(exact) - exact, source_key) AS place FROM x),
w AS (SELECT source_key, low + (place <= slots - sum(low) OVER ())::BIGINT AS a FROM y),
m AS (SELECT list(source_key ORDER BY source_key) AS names, list(a ORDER BY source_key) AS a, sum(a)::BIGINT AS q FROM w HAVING count(*) > 0),
r AS (
  SELECT 0::BIGINT AS slot, list_transform(a, lambda x: 0::BIGINT) AS done, NULL::BIGINT AS took, a, q FROM m
  UNION ALL
  SELECT slot + 1, list_transform(done, lambda x, i: CASE WHEN i = best.i THEN x + 1 ELSE x END), best.i, a, q
  FROM (SELECT *, list_min(list_filter(list_transform(done, lambda x, i: CASE WHEN (x * q) // a[i] <= slot THEN {{'deadline': ((x + 1) * q + a[i] - 1) // a[i], 'less': -a[i], 'i': i}} END), lambda x: x IS NOT NULL)) AS best FROM r WHERE slot < q)),
t AS (SELECT took, list(slot - 1 ORDER BY slot) AS slots FROM r WHERE took IS NOT NULL GROUP BY took),
s AS (SELECT names[took] AS source_key, m.a[took] AS a, m.q, slots FROM t, m),
e AS (SELECT doc_id, source, place, (place // {mixing.BLOCK}) // a * s.q + slots[(place // {mixing.BLOCK}) % a + 1] AS slot FROM q JOIN s USING (source_key))
SELECT doc_id, source, slot // {mixing.SLOTS} AS mix_unit, slot % {mixing.SLOTS} AS mix_slot, CAST(place % {mixing.BLOCK} AS INT) AS mix_at FROM e
"""

OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
e AS (SELECT i, lang, source, unnest(t) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM e GROUP BY 1, 2 HAVING count(DISTINCT i) >= {divergence.LEAST_DOCS}),
v AS (SELECT lang, count(*) AS v, sum(n) AS held FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM e GROUP BY 1, 2, 3),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS whole FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (
  SELECT f.lang, f.source, term, n, (1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY f.lang, f.source) + 2 * v.v))::BIGINT AS p, (1 + (1000000000::HUGEINT * (whole + 2)) // (v.held + 2 * v.v))::BIGINT AS q
  FROM f JOIN v ON v.lang = f.lang),
t AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
b AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
a AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(b.value, 0)::BIGINT AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN b ON b.lang = x.lang AND b.source = x.source AND b.item = y.source
  UNION ALL SELECT lang, source, part, item, value::BIGINT FROM t),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM a)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= {divergence.TOP}
"""



def _tree_sql(name: str, leaves: str) -> str:
    """Levels (tree, pos, h, n, k) over leaves(tree, pos, h, n), and the siblings before and after each node."""
    run = f"PARTITION BY tree, k, pos // {manifest.FAN} ORDER BY pos ROWS BETWEEN"
    return f"""
{name} AS (SELECT tree, pos, h, n, 0 AS k FROM {leaves} UNION ALL
  SELECT tree, pos // {manifest.FAN}, sha256(string_agg(h, '' ORDER BY pos)), (n + {manifest.FAN - 1}) // {manifest.FAN}, k + 1 FROM {name} WHERE n > 1 GROUP BY tree, pos // {manifest.FAN}, n, k),
{name}s AS (SELECT tree, pos, k, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b, coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM {name} WHERE n > 1)"""


def _manifest_sql() -> str:
    field = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    whole = " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", "text")))
    changed = " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", f"translate(text, '{_UPPER}', '{_LOWER}')")))
    # crc32 by the table of its polynomial
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda x, y: xor(x >> 8, crc.t[(xor(x, y) & 255) + 1])), 4294967295::BIGINT)"
    fold = lambda name, first, tree: f"{name} AS (SELECT i, tree, pos, 0 AS k, h, proof FROM {first} UNION ALL SELECT f.i, f.tree, f.pos // {manifest.FAN}, f.k + 1, sha256(s.b || f.h || s.a), f.proof || s.b || s.a FROM {name} f JOIN {tree}s s USING (tree, pos, k))"
    return f"""
WITH RECURSIVE bits AS (SELECT i, i AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
d AS (SELECT row_number() OVER () AS i, doc_id, coalesce('+' || lang, '') AS tree, sha256({whole}) AS h, CASE WHEN {crc} % 3 = 0 THEN sha256({changed}) ELSE sha256({whole}) END AS shown FROM documents, crc),
o AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d),
{_tree_sql('t', 'o')},
r AS (SELECT '' AS tree, tree AS lang_tree, h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
{_tree_sql('u', 'r')},
w AS (SELECT i, tree, pos, shown AS h, '' AS proof FROM o), {fold('f', 'w', 't')},
x AS (SELECT i, '' AS tree, r.pos, arg_max(f.h, f.k) AS h, arg_max(f.proof, f.k) AS proof FROM f JOIN r ON r.lang_tree = f.tree GROUP BY i, r.pos), {fold('g', 'x', 'u')},
e AS (SELECT i, arg_max(h, k) AS folded_root, sha256(arg_max(proof, k)) AS proof_sha256 FROM g GROUP BY i),
root AS (SELECT h AS root FROM u WHERE n = 1)
SELECT o.doc_id, o.h AS leaf, r.h AS subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM o JOIN e USING (i) JOIN r ON r.lang_tree = o.tree CROSS JOIN root
"""


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_bpe_round_trip": op3_bpe_round_trip,
    "op4_quality": op4_quality,
    "op5_secret_scan": op5_secret_scan,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_token_rollup": op7_token_rollup,
    "op8_nearest_vectors": op8_nearest_vectors,
    "op9_mixing": op9_mixing,
    "op10_license_scan": op10_license_scan,
    "op11_minhash": op11_minhash,
    "op12_source_divergence": op12_source_divergence,
    "op13_merkle_manifest": op13_merkle_manifest,
}
ORACLES = {
    "op2_ngram_jaccard": _near_sql(5, 80),
    "op5_secret_scan": _secrets_sql(),
    "op6_exact_dedup": OP6_SQL,
    "op7_token_rollup": OP7_SQL,
    "op9_mixing": OP9_SQL,
    "op10_license_scan": _licenses_sql(),
    "op11_minhash": f"SELECT *, doc_id = component_id AS kept FROM ({_near_sql(3, 85)})",
    "op12_source_divergence": OP12_SQL,
    "op13_merkle_manifest": _manifest_sql(),
}
