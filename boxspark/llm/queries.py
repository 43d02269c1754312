"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxspark.llm import collocations, exact_dedup, image_copies, language_id, lexical_search, mixing, ngram_jaccard, secret_scan, sentencepiece_nbest, suffix_dedup, token_store, toxicity, warc
from boxspark.llm.common import table


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_nbest.digests(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.drop_repeats(table(spark, sf_dir, "documents")).drop("spans", "kept")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources own the values; a different text is a repository, so copies of a document count once."""
    text = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    return secret_scan.digests(table(spark, sf_dir, "documents"), repository=text)


def op3_secret_scan_both_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same verdicts under the name they had when ``op3_secret_scan`` still counted owners alone."""
    return op3_secret_scan(spark, sf_dir)


def op3_secret_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts behind the verdicts: every candidate value's hash, repositories, owners and whether it is an example."""
    text = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    return secret_scan.scan(table(spark, sf_dir, "documents"), repository=text)[1]


def op4_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image_copies.vector_copies(table(spark, sf_dir, "embeddings"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.jaccard_components(table(spark, sf_dir, "documents"), n=3, percent=90)


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_summaries(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))[0]


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable]:
    return {f.__name__: f for f in (op11_collocations, op12_lexical_search, op13_warc, op1_sentencepiece, op2_suffix_dedup, op3_secret_scan, op3_secret_scan_both_counts, op3_secret_values, op4_image_copies, op5_language_id, op6_ngram_jaccard, op7_token_store, op8_mixing, op9_toxicity, op10_exact_dedup)}


OP10_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)
"""


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT r, s, md5(b[s + 1 : s + 200]) AS h FROM (SELECT r, b, unnest(range(octet_length(b) - 199)) AS s FROM d WHERE octet_length(b) >= 200)),
rep AS (SELECT r, s FROM (SELECT r, s, count(*) OVER (PARTITION BY h) AS n FROM w) WHERE n > 1),
i AS (SELECT r, s, sum(new) OVER (PARTITION BY r ORDER BY s) AS k FROM (SELECT r, s, CASE WHEN s <= lag(s) OVER (PARTITION BY r ORDER BY s) + 200 THEN 0 ELSE 1 END AS new FROM rep)),
gone AS (SELECT r, min(s) AS a, max(s) + 200 AS z FROM i GROUP BY r, k),
parts AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS from_ FROM gone),
kept AS (SELECT p.r, count(*) AS n_spans, sum(z - a)::BIGINT AS n_removed, max(z) AS tail, string_agg(CASE WHEN a > from_ THEN hex(b[from_ + 1 : a]) ELSE '' END, '' ORDER BY a) AS h FROM parts p JOIN d USING (r) GROUP BY p.r)
SELECT doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(CASE WHEN n_spans IS NULL THEN b ELSE unhex(h || CASE WHEN tail < octet_length(b) THEN hex(b[tail + 1 :]) ELSE '' END) END) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 3 THEN list_distinct([array_to_string(ws[i : i + 2], ' ') FOR i IN range(1, len(ws) - 1)]) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS k FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n) GROUP BY 1, 2, 3, 4),
links AS (SELECT x, y FROM pairs WHERE 100 * k >= 90 * (nx + ny - k)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x, y FROM ways UNION SELECT r.x, b.y FROM reach r JOIN ways b ON r.y = b.x)
SELECT s.doc_id, len(s.sh) AS n_shingles, least(s.doc_id, coalesce(c.m, s.doc_id)) AS component_id, coalesce(k.n, 0) AS n_links
FROM s LEFT JOIN (SELECT x, min(y) AS m FROM reach GROUP BY x) c ON c.x = s.doc_id LEFT JOIN (SELECT x, count(*) AS n FROM ways GROUP BY x) k ON k.x = s.doc_id
"""


def _sql_matches(kind: str, pattern: str, group: int) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT r, {secret_scan.KINDS.index(kind)} AS kind, generate_subscripts(ms, 1) AS i, unnest(ms) AS m, unnest(vs) AS v, unnest(gs[: len(ms)]) AS g
  FROM (SELECT r, regexp_extract_all(t, '{p}') AS ms, regexp_extract_all(t, '{p}', {group}) AS vs, string_split_regex(t, '{p}') AS gs FROM d WHERE regexp_matches(t, '{p}'))"""


_RANDOM = "regexp_matches(v, '[A-Za-z]') AND regexp_matches(v, '[0-9]') AND len(list_distinct(string_split(v, ''))) >= 10 AND len(list_distinct(string_split(v, ''))) * 4 >= least(length(v), 40)"
_OP3 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, chr(0)) AS owner, coalesce(text, '') AS t FROM documents),
raw AS ({" UNION ALL ".join(_sql_matches(k, p, g) for k, p, g in (("assign", secret_scan.ASSIGN, 2), ("access", secret_scan.ACCESS, 0), ("hex", secret_scan.HEX, 0), ("owned", secret_scan.LONG, 0)))}),
placed AS (SELECT r, kind, m, v, (sum(length(g) + length(m)) OVER (PARTITION BY r, kind ORDER BY i))::BIGINT AS e FROM raw),
spans AS (SELECT r, kind, v, e - length(m) AS s, e FROM placed WHERE (kind <> 0 OR length(v) >= {secret_scan.LEAST_VALUE}) AND (kind <> 3 OR ({_RANDOM}))),
cand AS (SELECT x.*, owner, md5(t) AS repository FROM spans x JOIN d USING (r) WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM spans b WHERE b.r = x.r AND b.kind < 3 AND b.s < x.e AND x.s < b.e)),
owners AS (SELECT v, count(DISTINCT owner) AS owners, count(DISTINCT repository) AS repositories, count(DISTINCT owner) >= {secret_scan.EXAMPLE_OWNERS} OR count(DISTINCT repository) >= {secret_scan.EXAMPLE_REPOSITORIES} AS copied FROM cand GROUP BY v)
"""
OP3_SQL = f"""{_OP3},
judged AS (SELECT c.*, copied, NOT copied AND ({_RANDOM}) AS live, ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || s || ':' || e AS txt FROM cand c JOIN owners USING (v))
SELECT d.doc_id, count(j.r) FILTER (kind = 0) AS n_assign, count(j.r) FILTER (kind = 1) AS n_access, count(j.r) FILTER (kind = 2) AS n_hex,
       sha256(coalesce(string_agg(txt, ',' ORDER BY s, kind) FILTER (kind < 3), '')) AS base_sha256,
       coalesce(string_agg(txt, ',' ORDER BY s, kind) FILTER (kind < 3 OR live), '') AS spans,
       count(j.r) FILTER (kind = 3 AND live) AS n_added, count(j.r) FILTER (copied) AS n_examples, count(j.r) FILTER (live) AS n_live
FROM d LEFT JOIN judged j ON j.r = d.r GROUP BY d.r, d.doc_id
"""
OP3_VALUES_SQL = f"{_OP3} SELECT sha256(v) AS value_hash, repositories, owners, copied FROM owners"


#: Every length is exploded on its own here, unlike in the operator.
OP11_SQL = """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?' || chr(10) || chr(11) || chr(12) || chr(13) || chr(9), 'abcdefghijklmnopqrstuvwxyz' || repeat(chr(10), 10) || ' '), chr(10))) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split(piece, ' '), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i : i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3)) t(k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY ALL),
total AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, n AS a FROM f WHERE k > 1 AND n >= 10),
cut AS (SELECT lang, phrase, a, ws, unnest(range(1, k)) AS j FROM c),
s AS (SELECT cut.lang, cut.phrase, a, j, x.n AS l, y.n AS r, ((1000000::HUGEINT * a * a) // (x.n::HUGEINT * y.n))::BIGINT AS score
      FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(ws[1 : j], ' ') JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(ws[j + 1 :], ' ')),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
longer AS (SELECT lang, phrase, max(a) AS a FROM (SELECT lang, a, unnest([array_to_string(ws[1 : 2], ' '), array_to_string(ws[2 : 3], ' ')]) AS phrase FROM c WHERE k = 3) GROUP BY ALL),
ranked AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.phrase = b.phrase AND len(string_split(b.phrase, ' ')) = 2
           WHERE o.a IS NULL OR 100 * o.a < 50 * b.a)
SELECT r.lang, rank, phrase, a, l, r, n, score FROM ranked r JOIN total USING (lang) WHERE rank <= 2000
"""


OP12_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT count(*) FILTER (len(ts) > 0) AS n, sum(len(ts))::BIGINT AS l FROM t),
o AS (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM t),
f AS (SELECT doc_id, n, term, count(*) AS tf FROM o WHERE term IN (SELECT term FROM q) GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM f GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * s.n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM d, s),
p AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * f.n * s.n) // s.l))))::BIGINT AS score FROM q JOIN f USING (term) JOIN w USING (term), s GROUP BY ALL)
SELECT item_id, (row_number() OVER x)::INTEGER AS rank, doc_id, score FROM p WHERE score > 0
WINDOW x AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER x <= 10
"""


#: Base32 of a digest: its bits, five at a time.
OP13_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS h, min(page_id) OVER (PARTITION BY b) AS least FROM p),
x AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: right('000' || bin(('0x' || substr(h, i, 1))::INTEGER), 4)), '') AS bits FROM d)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(1, 6), lambda j: substr(bits, (5 * i + j)::BIGINT, 1)::INTEGER * (1 << (5 - j))))::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> least THEN least END AS refers_to
FROM x
"""


def oracle_sql() -> dict[str, str]:
    return {"op13_warc": OP13_SQL, "op12_lexical_search": OP12_SQL, "op11_collocations": OP11_SQL, "op2_suffix_dedup": OP2_SQL, "op3_secret_scan": OP3_SQL, "op3_secret_scan_both_counts": OP3_SQL, "op3_secret_values": OP3_VALUES_SQL, "op6_ngram_jaccard": OP6_SQL, "op10_exact_dedup": OP10_SQL}
