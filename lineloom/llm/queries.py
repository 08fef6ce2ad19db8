"""The queries of this package by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .byte_bpe import op10_byte_bpe
from .centroids import op13_centroids
from .fingerprints import op11_fingerprints
from .lattice_lm import op1_lattice_lm
from .line_dedup import op3_line_dedup
from .merkle import op12_merkle
from .mixing import op7_mixing
from .ngram_join import op9_ngram_join
from .nn_descent import op8_nn_descent
from .pii_boost import op6_pii_boost
from .rule_ledger import op5_quality_rules
from .toxicity import op4_toxicity
from .warc import op2_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lattice_lm": op1_lattice_lm,
        "op2_warc": op2_warc,
        "op3_line_dedup": op3_line_dedup,
        "op4_toxicity": op4_toxicity,
        "op5_quality_rules": op5_quality_rules,
        "op6_pii_boost": op6_pii_boost,
        "op7_mixing": op7_mixing,
        "op8_nn_descent": op8_nn_descent,
        "op9_ngram_join": op9_ngram_join,
        "op10_byte_bpe": op10_byte_bpe,
        "op11_fingerprints": op11_fingerprints,
        "op12_merkle": op12_merkle,
        "op13_centroids": op13_centroids,
    }


WARC_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), s AS (SELECT page_id, strlen(h) AS n, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS m FROM p),
  g AS (SELECT *, list_transform(range(8), lambda g: ('0x' || substr(x, (g * 5 + 1)::BIGINT, 5))::BIGINT) AS v FROM s)
  SELECT page_id, n::BIGINT AS payload_bytes, array_to_string(list_transform(v, lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', k // 32768 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', k // 1024 % 32 + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', k // 32 % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', k % 32 + 1, 1)), '') AS payload_digest,
    CASE WHEN page_id = m OR m IS NULL THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to FROM g"""

NGRAM_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l FROM documents),
  s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) >= 3 THEN list_transform(range(1, len(l) - 1), lambda i: array_to_string(l[i:i + 2], ' ')) WHEN len(l) > 0 THEN [array_to_string(l, ' ')] ELSE [] END) AS x FROM w),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
  e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
  u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
  r AS (SELECT a AS doc_id, a AS at FROM u UNION SELECT r.doc_id, u.b FROM r JOIN u ON r.at = u.a)
  SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(min(r.at), d.doc_id) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id, n.n"""


RULES_SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
  x AS (SELECT doc_id, unnest(range(1, len(l) - 3)) AS k, unnest(list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' '))) AS g FROM w WHERE len(l) >= 5),
  r AS (SELECT doc_id, unnest(range(k, k + 5)) AS p FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, g) AS c FROM x) WHERE c > 1), q AS (SELECT doc_id, count(DISTINCT p) AS n FROM r GROUP BY doc_id),
  m AS (SELECT w.doc_id, len(l)::BIGINT AS n_words, coalesce(list_sum(list_transform(l, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(q.n, 0)::BIGINT AS n_repeat_words,
    len(ls) AS n_lines, len(regexp_extract_all(t, '[A-Za-z]')) + len(regexp_extract_all(t, '[^\x00-\x7F]')) AS n_letters, len(regexp_extract_all(t, '[A-Z]')) AS n_upper, len(list_filter(l, lambda x: regexp_matches(x, '^[!-/:-@\[-`{-~]+$'))) AS n_bare_words, coalesce(list_max(list_transform(l, lambda x: strlen(x))), 0) AS longest_word
    FROM w LEFT JOIN q ON q.doc_id = w.doc_id),
  b AS (SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (10 * n_symbols > 3 * n_words AND 20 * n_symbols > word_chars)::BIGINT + 8 * (n_lines >= 4 AND 2 * n_dup_lines > n_lines)::BIGINT
    + 16 * (n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words))::BIGINT + 32 * (2 * n_letters < word_chars)::BIGINT + 64 * (n_letters >= 40 AND 10 * n_upper > 6 * n_letters)::BIGINT + 128 * (n_words >= 10 AND 10 * n_bare_words > 3 * n_words)::BIGINT + 256 * (longest_word > 1000)::BIGINT AS fail_bits FROM m)
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b"""


MERKLE_SQL = """WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
  x AS (SELECT doc_id, lang, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS f, strlen(text) AS k, text,
    xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS crc FROM documents, crc),
  l AS (SELECT doc_id, lang, sha256(f || coalesce(k || ':' || text, '-')) AS leaf, CASE WHEN crc % 3 = 0 THEN sha256(f || coalesce(k || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS other FROM x),
  r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM l),
  node AS (SELECT lang, 0 AS level, i, n, leaf AS h FROM r UNION ALL SELECT lang, level + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM node WHERE n > 1 GROUP BY lang, level, n, i // 8),
  top AS (SELECT lang, level, h, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM node WHERE n = 1),
  over_ AS (SELECT 0 AS level, i, n, h FROM top UNION ALL SELECT level + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM over_ WHERE n > 1 GROUP BY level, n, i // 8),
  side AS (SELECT lang, level, i, n, coalesce(string_agg(h, '') OVER (PARTITION BY lang, level, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a, coalesce(string_agg(h, '') OVER (PARTITION BY lang, level, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM node),
  side2 AS (SELECT level, i, n, coalesce(string_agg(h, '') OVER (PARTITION BY level, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a, coalesce(string_agg(h, '') OVER (PARTITION BY level, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM over_),
  up AS (SELECT doc_id, lang, leaf, 0 AS level, i, n, '' AS proof, coalesce(other, leaf) AS h FROM r
    UNION ALL SELECT u.doc_id, u.lang, leaf, u.level + 1, u.i // 8, (u.n + 7) // 8, proof || a || b, sha256(a || h || b) FROM up u JOIN side s ON u.lang IS NOT DISTINCT FROM s.lang AND u.level = s.level AND u.i = s.i WHERE u.n > 1),
  up2 AS (SELECT doc_id, leaf, t.h AS subroot, 0 AS level, t.i, t.n, proof, u.h FROM up u JOIN top t ON u.lang IS NOT DISTINCT FROM t.lang WHERE u.n = 1
    UNION ALL SELECT doc_id, leaf, subroot, u.level + 1, u.i // 8, (u.n + 7) // 8, proof || a || b, sha256(a || h || b) FROM up2 u JOIN side2 s ON u.level = s.level AND u.i = s.i WHERE u.n > 1)
  SELECT doc_id, leaf, subroot, o.h AS root, sha256(proof) AS proof_sha256, u.h AS folded_root, u.h = o.h AS verified FROM up2 u, (SELECT h FROM over_ WHERE n = 1) o WHERE u.n = 1"""


def centroid_sql() -> str:
    """The rounds written out, every vector against every centroid."""
    near = "SELECT r, j, d FROM (SELECT r, j, d, row_number() OVER (PARTITION BY r ORDER BY d, j) AS o FROM (SELECT v.r, c.j, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS d FROM v JOIN {c} c ON v.p = c.p GROUP BY ALL)) WHERE o = 1"
    sql = """WITH k AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
  n AS (SELECT *, row_number() OVER (ORDER BY sha256('1:' || vec_id), e) AS r FROM k), v AS (SELECT r, unnest(range(64)) AS p, unnest(e) AS x FROM n), c0 AS (SELECT r - 1 AS j, p, x FROM v WHERE r <= 16)"""
    for k in range(3):
        sql += f""",
  a{k} AS ({near.format(c=f"c{k}")}), m{k} AS (SELECT j, p, sum(x)::BIGINT AS s, count(*) AS n FROM a{k} JOIN v USING (r) GROUP BY ALL),
  c{k + 1} AS (SELECT c.j, c.p, CASE WHEN m.n IS NULL THEN c.x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c{k} c LEFT JOIN m{k} m ON c.j = m.j AND c.p = m.p)"""
    return sql + f""",
  a3 AS ({near.format(c="c3")}), h AS (SELECT j, sha256(string_agg(x::VARCHAR, ',' ORDER BY p)) AS s FROM c3 GROUP BY j)
  SELECT vec_id, a3.j::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a3.j))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, h.s AS centroid_sha256 FROM n JOIN a3 USING (r) JOIN h ON h.j = a3.j"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express; tests hold the others against brute force."""
    return {"op2_warc": WARC_SQL, "op5_quality_rules": RULES_SQL, "op9_ngram_join": NGRAM_SQL, "op12_merkle": MERKLE_SQL, "op13_centroids": centroid_sql()}
