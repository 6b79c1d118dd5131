"""The registered queries over the operators, and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import importance, media, near_dup, packing, preference_format, quality_fm, quality_rules, quotient_dedup, suffix_dedup, token_counts, vector_codes, warc, word_bpe


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the installed vocabulary file of that name is."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"), tokenizer_path())


def op3_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference_format.preference_format(_table(spark, sf_dir, "conversations"))


def op5_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), tokenizer_path())


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(_table(spark, sf_dir, "documents"))


def op7_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(_table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.digests(_table(spark, sf_dir, "documents"), tokenizer_path())


def op9_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(_table(spark, sf_dir, "documents"))


def op10_wav_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(_table(spark, sf_dir, "documents")).drop("media")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_elkan_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(_table(spark, sf_dir, "embeddings"))


def op13_quotient_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotient_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_quality_fm,
        op2_best_fit_packing,
        op3_minhash_near_dup,
        op4_preference_format,
        op5_token_histogram,
        op6_suffix_dedup,
        op7_warc_round_trip,
        op8_bpe_round_trip,
        op9_host_rules,
        op10_wav_fingerprints,
        op11_importance_resampling,
        op12_elkan_codes,
        op13_quotient_dedup,
    )
}

OP7_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, CAST(unhex(sha1(payload)) AS BIT)::VARCHAR AS bits FROM p),
f AS (SELECT *, max(page_id) OVER (PARTITION BY bits) AS first FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
    16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT)
    + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT) AS INT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM f
"""

_RULE_STATISTICS = """
d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) > 8)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, sum(least(8, coalesce(nx - i, 8))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM rep) GROUP BY doc_id),
ln AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
s AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l)::BIGINT AS n_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN ln USING (doc_id) LEFT JOIN cov USING (doc_id)),
f AS (
  SELECT *, (n_words < 20)::INT AS r1, (100 * n_repeat_words > 30 * n_words)::INT AS r2,
    (100 * n_symbols > 20 * word_chars)::INT AS r3, (100 * n_dup_lines > 10 * n_lines)::INT AS r4 FROM s),
h AS (SELECT source, count(*) AS n, sum(r1) AS r1, sum(r2) AS r2, sum(r3) AS r3, sum(r4) AS r4 FROM f GROUP BY source),
m AS (SELECT source, n, unnest([r1, r2, r3, r4]) AS r, unnest([1, 2, 3, 4]) AS rule FROM h),
q AS (SELECT rule, sum(r) / sum(n) AS p, sum(r * r / n) / sum(n) AS squares, (count(*) - 1) / sum(n) AS share FROM m GROUP BY rule),
v AS (SELECT rule, p, p * (1 - p) AS noise, squares - p * p - p * (1 - p) * share AS between_hosts FROM q),
z AS (SELECT source, r, n, p, between_hosts, CASE WHEN between_hosts < noise THEN noise / nullif(between_hosts, 0) - 1 ELSE 1.0 END AS weight FROM m JOIN v USING (rule)),
y AS (SELECT source, p, between_hosts, n + weight AS docs, (r + p * weight) / (n + weight) AS mean FROM z),
bad AS (SELECT source, bool_or(between_hosts > 0 AND mean - 2 * sqrt(greatest(mean * (1 - mean) / (docs + 1), 0)) > least(0.5, greatest(0.2, 2 * p))) AS rejected FROM y GROUP BY source),
verdict AS (
  SELECT f.*, (r1 + r2 > 0) AS base_failed, NOT (r1 + r2 > 0) AND NOT coalesce(rejected, false) AS kept
  FROM f JOIN bad ON f.source IS NOT DISTINCT FROM bad.source)
"""

OP9_SQL = f"WITH {_RULE_STATISTICS} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM verdict"

OP4_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
last AS (SELECT conv_id, max(i) AS i, arg_max(text, i) AS reply FROM t WHERE role = 'assistant' GROUP BY conv_id),
j AS (SELECT t.*, last.i AS last, d.reply FROM t LEFT JOIN last USING (conv_id) LEFT JOIN last AS d ON d.conv_id = xor(t.conv_id, 1)),
n AS (SELECT conv_id, CASE WHEN any_value(last) IS NULL OR any_value(reply) IS NOT NULL AND bool_or(i = last AND text = reply) THEN max(i) ELSE any_value(last) - 1 END AS n FROM j GROUP BY conv_id),
r AS (SELECT conv_id, i, role, text, 'c' AS side FROM j UNION ALL
  SELECT conv_id, i, role, CASE WHEN i = last THEN reply ELSE text END, 'r' FROM j WHERE i IS DISTINCT FROM last OR reply IS NOT NULL),
x AS (SELECT r.*, n.n, CASE WHEN i <= n THEN 'p' ELSE side END AS part, '<|' || role || '|>' || chr(10) || text || chr(10) AS seg FROM r JOIN n USING (conv_id) WHERE side = 'c' OR i > n.n),
y AS (SELECT *, coalesce(sum(length(seg)) OVER (PARTITION BY conv_id, part ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(role) + 5 AS a FROM x)
SELECT conv_id, any_value(n)::BIGINT AS prompt_turns, coalesce(string_agg(seg, '' ORDER BY i) FILTER (part = 'p'), '') AS prompt,
  coalesce(string_agg(seg, '' ORDER BY i) FILTER (part = 'c'), '') AS chosen, coalesce(string_agg(seg, '' ORDER BY i) FILTER (part = 'r'), '') AS rejected,
  coalesce(string_agg(a::BIGINT || ':' || (a + length(text))::BIGINT, ',' ORDER BY i) FILTER (part = 'c' AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(a::BIGINT || ':' || (a + length(text))::BIGINT, ',' ORDER BY i) FILTER (part = 'r' AND role = 'assistant'), '') AS rejected_mask
FROM y GROUP BY conv_id
"""

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: DuckDB has no CRC-32, so its table of 256 numbers and the sum over a word's bytes are made here.
OP11_SQL = f"""
WITH crc AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) AS c FROM range(256) AS r(i))),
d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
dw AS MATERIALIZED (SELECT doc_id, unnest(w) AS g FROM d),
bw AS MATERIALIZED (SELECT unnest(regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS g FROM benchmark),
g AS MATERIALIZED (
  SELECT g, xor(list_reduce(range(length(x) // 2), lambda c, j: xor(c // 256, t[1 + (xor(c, ('0x' || substr(x, 2 * j + 1, 2))::BIGINT) & 255)]), 4294967295), 4294967295) % 10000 AS bucket
  FROM (SELECT g, hex(encode(g)) AS x FROM (SELECT g FROM dw UNION SELECT g FROM bw)), crc),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN g USING (g) GROUP BY bucket), t AS (SELECT bucket, count(*) AS n FROM bw JOIN g USING (g) GROUP BY bucket),
gain AS MATERIALIZED (
  SELECT b AS bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000)::DOUBLE
    / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bw) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM range(10000) AS r(b) LEFT JOIN s ON s.bucket = b LEFT JOIN t ON t.bucket = b),
f AS (SELECT doc_id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total FROM dw JOIN g USING (g) JOIN gain USING (bucket) GROUP BY doc_id),
v AS (
  SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(CASE WHEN total % n < 0 THEN total // n - 1 ELSE total // n END, 0)::BIGINT AS weight,
    ('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT AS h FROM d LEFT JOIN f USING (doc_id)),
z AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM v),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () * 10 // 100 AS places FROM z WHERE n_features >= 20)
SELECT z.doc_id, n_features, weight, score, CASE WHEN place <= places THEN place END AS rank FROM z LEFT JOIN r USING (doc_id)
"""


def _op12_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Rounds of plain search, one after the other; integers are below 2^53, so doubles are exact."""
    nearest = lambda r: f"""
a{r} AS MATERIALIZED (
  SELECT vec_id, p, unnest(list_slice(list_sort(list({{'d': d, 'e': e}})), 1, 1)) AS b FROM (
    SELECT vec_id, p, e, CAST(list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM x JOIN c{r} AS c USING (p))
  GROUP BY vec_id, p)"""  # noqa: E731
    moved = lambda r: f"""
c{r + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(m.v, c.v) AS v FROM c{r} AS c LEFT JOIN (
    SELECT p, e, list(v ORDER BY i) AS v FROM (
      SELECT p, b.e AS e, i, CAST(floor(sum(k) / count(*)) AS BIGINT) AS v FROM a{r} JOIN (SELECT vec_id, p, unnest(v) AS k, generate_subscripts(v, 1) AS i FROM x) USING (vec_id, p) GROUP BY ALL)
    GROUP BY p, e) AS m USING (p, e))"""  # noqa: E731
    return f"""
WITH y AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda k: CAST(floor(4096 * k::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda k: k IS NULL OR NOT isfinite(k))) = 0),
x AS MATERIALIZED (SELECT vec_id, p, v[1 + p * (len(v) // {parts}):(p + 1) * (len(v) // {parts})] AS v FROM y, range({parts}) AS r(p)),
c0 AS MATERIALIZED (SELECT p, n - 1 AS e, v FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS n FROM y) USING (vec_id) WHERE n <= {entries}),
{",".join(f"{nearest(r)},{moved(r)}" for r in range(rounds))},{nearest(rounds)},
z AS (SELECT vec_id, string_agg(lower(lpad(to_hex(b.e), 2, '0')), '' ORDER BY p) AS code, CAST(sum(b.d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(k::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, unnest(v) AS k, generate_subscripts(v, 1) AS i FROM c{rounds}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM z JOIN y USING (vec_id), h
"""


OP13_SQL = f"""
WITH d AS (SELECT doc_id, {_LOWERED} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""

SQL: dict[str, str] = {
    "op4_preference_format": OP4_SQL,
    "op7_warc_round_trip": OP7_SQL,
    "op9_host_rules": OP9_SQL,
    "op11_importance_resampling": OP11_SQL,
    "op12_elkan_codes": _op12_sql(),
    "op13_quotient_dedup": OP13_SQL,
}
