"""DuckDB SQL with the rows of the registered queries."""

from __future__ import annotations

from lineloom.plans import text_queries as q

LINES = r"""lines AS (
  SELECT doc_id, i - 1 AS line_no, trim(regexp_replace(x, '^\s+|\s+$', '', 'g')) AS text
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))"""
SPANS = r"""tiles AS (
  SELECT doc_id, unnest(l) AS raw, generate_subscripts(l, 1) AS tile
  FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?\n]+[.!?]?|[.!?\n]') AS l FROM documents)),
sums AS (
  SELECT *, sum(length(raw)) OVER w AS stop, sum(CASE WHEN raw = chr(10) THEN 1 ELSE 0 END) OVER w AS line_no, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS text
  FROM tiles WINDOW w AS (PARTITION BY doc_id ORDER BY tile)),
spans AS (
  SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY tile) - 1 AS span_no,
    stop - length(regexp_replace(raw, '^\s+', '')) AS "start", stop - length(regexp_replace(raw, '^\s+', '')) + length(text) AS "end", text
  FROM sums WHERE regexp_matches(text, '[^.!?\s]'))"""
HEADS = r"""shaped AS (
  SELECT *, lower(trim(regexp_replace(trim(text), '[:?]+\s*$', ''))) AS h FROM lines),
heads AS (
  SELECT *, CASE WHEN h <> '' AND NOT regexp_matches(h, '[.!?]$') AND len(list_filter(regexp_split_to_array(h, '\s+'), lambda x: x <> '')) BETWEEN 1 AND 10 THEN {kind} END AS heading FROM shaped)"""


def _any(terms) -> str:
    return "(" + " OR ".join("contains(h, '" + t.replace("'", "''") + "')" for t in terms) + ")"


def _kinds(a, b, c, d, safe) -> str:
    return f"CASE WHEN {_any(a)} THEN 'responsibility' WHEN {_any(b)} THEN 'requirement' WHEN {_any(c)} THEN 'other' WHEN {_any(d)} OR (regexp_matches(h, '^about\\b') AND NOT {_any(safe)}) THEN 'ignored' ELSE 'unknown' END"


TOY_HEADS = HEADS.replace("{kind}", _kinds(("role", "ing "), ("the ", "des "), ("und",), ("of ", "la "), q.lines.vocab.ABOUT_SAFE_WORDS))
V = q.lines.vocab
FULL_HEADS = HEADS.replace("{kind}", _kinds(V.RESPONSIBILITY_HEADINGS, V.REQUIREMENT_HEADINGS, V.OTHER_HEADINGS, V.IGNORED_HEADINGS, V.ABOUT_SAFE_WORDS))
STATES = """known AS (SELECT *, CASE WHEN heading <> 'unknown' THEN heading END AS k FROM heads),
states AS (SELECT *, last_value(k IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM known)"""
SENTENCES = (
    f"{LINES}, {FULL_HEADS}, {STATES}, {SPANS}, "
    "st AS (SELECT doc_id, line_no, s, bool_or(k IS NOT NULL) OVER (PARTITION BY doc_id) AS any_known FROM states), "
    "sentences AS (SELECT p.doc_id, p.span_no, p.text, (NOT any_known OR s IS DISTINCT FROM 'ignored') AND NOT regexp_matches(p.text, '(?i)(" + "|".join(V.ABSOLUTE_EXCLUDES) + ")') AS matchable, "
    "CASE WHEN NOT any_known THEN 'responsibility' WHEN s = 'ignored' THEN NULL ELSE s END AS sub_type FROM spans p JOIN st USING (doc_id, line_no))"
)


def _values(rows, columns: str) -> str:
    show = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows) + f") AS v({columns})"


WORDS = "words AS (SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9_]+')) AS w FROM documents) WHERE w <> '')"



def tag_hits(source: str) -> str:
    """CTEs up to tf(doc_id, span_no, tag) of a table of sentences."""
    worded = _values([t for t in q.TAGS if not any(c.isdigit() for c in t[1])], "tag, p")
    return rf"""tw AS (SELECT DISTINCT tag, p, unnest(string_split(p, ' ')) AS w FROM {worded}), ts AS (SELECT DISTINCT tag, p, {STEM} AS b FROM tw WHERE w NOT IN {V.STOPWORDS}), tn AS (SELECT tag, p, count(*) AS n FROM ts GROUP BY ALL),
      sw AS (SELECT DISTINCT doc_id, span_no, unnest(regexp_split_to_array(lower(text), '[^a-z0-9+%]+')) AS w FROM {source}), ss AS (SELECT DISTINCT doc_id, span_no, {STEM} AS a FROM sw WHERE w <> ''),
      tm AS (SELECT doc_id, span_no, tag, p, count(DISTINCT b) AS k FROM ss JOIN ts ON a = b OR (least(length(a), length(b)) >= 5 AND abs(length(a) - length(b)) <= 2 AND (starts_with(a, b) OR starts_with(b, a))) GROUP BY ALL),
      tf AS (SELECT DISTINCT doc_id, span_no, tag FROM tm JOIN tn USING (tag, p) WHERE k = n UNION SELECT doc_id, span_no, 'number' FROM {source} WHERE contains(' ' || trim(regexp_replace(lower(text), '[^a-z0-9+%]+', ' ', 'g')) || ' ', ' 2 0 '))"""


STEM = r"""CASE WHEN length(w) <= 3 THEN w
  WHEN w LIKE '%ation' AND length(w) >= 8 THEN left(w, length(w) - 5) WHEN w LIKE '%ing' AND length(w) >= 6 THEN left(w, length(w) - 3)
  WHEN w LIKE '%ion' AND length(w) >= 6 THEN left(w, length(w) - 3) WHEN w LIKE '%ed' AND length(w) >= 5 THEN left(w, length(w) - 2)
  WHEN w LIKE '%es' AND length(w) >= 5 THEN left(w, length(w) - 2) WHEN regexp_matches(w, '[^s]s$') AND length(w) >= 4 THEN left(w, length(w) - 1)
  WHEN w LIKE '%ize' AND length(w) >= 6 THEN left(w, length(w) - 3) || 'is' WHEN w LIKE '%e' AND length(w) >= 4 THEN left(w, length(w) - 1) ELSE w END"""
HITS = f"{SENTENCES}, ms AS (SELECT * FROM sentences WHERE matchable), {tag_hits('ms')}, hits AS (SELECT DISTINCT doc_id, tag FROM tf)"
SCORES = (
    f"{HITS}, terms AS (SELECT * FROM {_values(q.PROFILE_TERMS, 'profile_id, kind, term, weight, term_no')}), profiles AS (SELECT * FROM {_values(q.PROFILES, 'profile_id, priority, title_required')}), "
    "body AS (SELECT d.doc_id, p.profile_id, coalesce(sum(weight) FILTER (WHERE h.tag IS NOT NULL), 0)::BIGINT AS body_score FROM documents d CROSS JOIN (SELECT DISTINCT profile_id FROM terms) p "
    "LEFT JOIN terms t ON t.profile_id = p.profile_id AND t.kind = 'body' LEFT JOIN hits h ON h.doc_id = d.doc_id AND h.tag = t.term GROUP BY ALL), "
    "ttext AS (SELECT doc_id, ' ' || regexp_replace(lower(source || ' | ' || left(string_split(text, chr(10))[1], 120)), '[^a-z0-9&+]+', ' ', 'g') || ' ' AS t FROM documents), "
    "tscore AS (SELECT doc_id, profile_id, CASE WHEN bool_or(kind = 'title_exclude') THEN 0 ELSE least(sum(CASE WHEN kind = 'title' THEN weight ELSE 0 END), 45) END AS title_score FROM ttext JOIN terms ON kind <> 'body' AND contains(t, ' ' || lower(term) || ' ') GROUP BY ALL), "
    "total AS (SELECT doc_id, profile_id, priority, CASE WHEN title_required AND coalesce(title_score, 0) = 0 THEN 0 ELSE body_score + coalesce(title_score, 0) END::BIGINT AS score FROM body LEFT JOIN tscore USING (doc_id, profile_id) JOIN profiles USING (profile_id)), "
    "ranked AS (SELECT doc_id, profile_id, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, priority, profile_id) AS rank FROM total)"
)
PLAIN = r"""plain AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(m, '(?i)&nbsp;', ' ', 'g'), '(?i)&amp;', '&', 'g'), '(?i)&quot;', '"', 'g'), '(?i)&(?:#39|apos|rsquo|lsquo);', '''', 'g'), '(?i)&[lr]dquo;', '"', 'g'), '(?i)&ndash;', '–', 'g'), '(?i)&mdash;', '—', 'g'), '(?i)&lt;', '<', 'g'), '(?i)&gt;', '>', 'g'),
  '\r\n?', chr(10), 'g'), '(?m)^\s*`{3,}.*$', '', 'g'), '[├└│]──\s?|[├└│]', '', 'g'), '(?m)^\s{0,3}#{1,6}\s+', '', 'g'), '\*\*|__', '', 'g'), '\[([^\]\n]+)\]\([^)\s]+\)', '\1', 'g'), '[ \t\x{00A0}]+', ' ', 'g') AS t
  FROM (SELECT page_id, CASE WHEN regexp_matches(html, '(?i)</?(?:p|div|br|li|ul|ol|span|strong|b|i|em|h\d|section|table|tr|td)\b') THEN regexp_replace(regexp_replace(html, '(?i)<\s*(?:br|/p|/div|/li|/h\d|/tr|li|p|div|h\d)\b[^>]*>', chr(10), 'g'), '<[^>]+>', ' ', 'g') ELSE html END AS m FROM pages))"""
JUNK = "'(?i)^(?:" + "|".join(V.JUNK_LINES).replace("'", "''") + r")\s*[»›>]*$'"
CONSENT = "'(?i)" + V.CONSENT + "'"
HEADING = "'(?i)^(?:" + "|".join(V.DESCRIPTION_HEADINGS).replace("'", "''") + r")\s*:?$'"
BLOCKS = "blocks AS (SELECT doc_id, line_no::INT AS block_no, text FROM lines)"
SMOKE = q.gates.SMOKE
STRENGTHS = "['required', 'core', 'support', 'filler']"
ITEM = "SELECT doc_id, block_no, c AS cost, c - c % 7 AS short_cost, s % 4 + 1 AS strength_no FROM (SELECT l_orderkey AS doc_id, l_linenumber AS block_no, sum(l_quantity)::BIGINT AS c, max(l_suppkey) AS s FROM lineitem GROUP BY ALL)"

SQL = {
    "a5_audit": "SELECT c_mktsegment || '-v1' AS data_version, to_json({'doc_id': c_custkey, 'c_name': c_name, 'c_nationkey': c_nationkey, 'n': n})::VARCHAR AS value FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey",
    "a6_stamp": """WITH h AS (SELECT sha256(to_json({'doc_id': doc_id, 'text': text})::VARCHAR) AS h FROM documents), p AS (SELECT count(*) AS n, """ + ", ".join(f"sum(('0x' || substr(h, {15 * k + 1}, 15))::BIGINT::HUGEINT) AS p{k}" for k in range(4)) + """ FROM h) SELECT left(sha256(concat_ws(':', n, p0, p1, p2, p3)), 10) AS stamp FROM p""",
    "i3_versions": """WITH v AS (SELECT conv_id AS key, turn AS version, text AS b, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM conversations), h AS (SELECT *, len(list_filter(range(1, least(length(a), length(b)) + 1), lambda k: left(a, k::BIGINT) = left(b, k::BIGINT))) AS head FROM v),
      t AS (SELECT *, substr(a, head + 1) AS ra, substr(b, head + 1) AS rb, greatest(length(a), length(b)) AS longer FROM h), u AS (SELECT *, len(list_filter(range(1, least(length(ra), length(rb)) + 1), lambda k: right(ra, k::BIGINT) = right(rb, k::BIGINT))) AS tail FROM t)
      SELECT key, version, CASE WHEN a IS NOT NULL THEN round((longer - head - tail) / greatest(longer, 1), 6) END AS changed, coalesce((longer - head - tail) / greatest(longer, 1) > 0.5, true) AS is_new FROM u""",
    "b15_titles": "SELECT p_partkey, CASE WHEN regexp_matches(upper(p_name), '[A-Z]{4}') THEN array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') ELSE upper(p_name) END AS title, p_brand AS company, 'Title: ' || upper(p_name) || ' (remote)' AS quote FROM part",
    "b21_highlights": r"""WITH p AS (SELECT conv_id, turn, role, text, list_transform([['1', 'the'], ['2', 'and'], ['3', 'of']], lambda w: CASE WHEN regexp_matches(text, '(?is)(?:^|[^A-Za-z0-9])' || w[2] || '(?:[^A-Za-z0-9]|$)') THEN {'at': length(regexp_extract(text, '(?is)^(|.*?[^A-Za-z0-9])' || w[2] || '(?:[^A-Za-z0-9]|$)', 1)), 'n': length(w[2])} END) AS l FROM conversations)
      SELECT conv_id, turn, role, coalesce(array_to_string(list_transform(list_sort(list_filter(l, lambda x: x IS NOT NULL)[1:2]), lambda x: substr(text, x['at'] + 1, x['n'])), '|'), '') AS bold, true AS joins_back FROM p""",
    "d3_hits": "WITH w AS (SELECT doc_id, regexp_split_to_array(lower(text), '[^a-z0-9_]+') AS l FROM documents) SELECT doc_id, len(list_filter(l, lambda x: starts_with(x, 'the')))::INT AS n_the, len(list_filter(l, lambda x: starts_with(x, 'on')))::INT AS n_on FROM w",
    "b1_html_to_plain": f"WITH {PLAIN} SELECT page_id, length(t) AS n_chars, md5(t) AS digest FROM plain",
    "b2_lines": f"WITH {LINES} SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE text = '') AS n_blank, sum(length(text))::BIGINT AS n_chars, max(line_no) AS last_line FROM lines GROUP BY doc_id",
    "b3_junk_lines": f"""WITH {PLAIN}, l AS (SELECT page_id AS doc_id, trim(regexp_replace(unnest(string_split(t, chr(10))), '^\\s+|\\s+$', '', 'g')) AS text FROM plain)
      SELECT doc_id, count(*) AS n_lines, sum(length(text))::BIGINT AS n_chars FROM l WHERE NOT regexp_matches(text, {JUNK}) AND NOT (regexp_matches(text, {CONSENT}) AND length(text) > 25) GROUP BY doc_id""",
    "b4_header_zone": f"""WITH {LINES}, a AS (SELECT *, length(text) > 160 AS lng, sum(CASE WHEN length(text) > 160 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS n_in FROM lines WHERE text <> ''),
      b AS (SELECT *, max(CASE WHEN (NOT lng AND n_in > 1 AND regexp_matches(text, {HEADING})) OR (lng AND n_in >= 3) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS stopped FROM a)
      SELECT doc_id, count(*) AS n, sum(line_no)::BIGINT AS line_sum, max(n_in)::INT AS last FROM b WHERE stopped = 0 AND NOT lng AND n_in <= 40 GROUP BY doc_id""",
    "b5_spans": f'WITH {SPANS} SELECT doc_id, count(*) AS n, sum("start")::BIGINT AS starts, sum("end")::BIGINT AS ends, sum(line_no)::BIGINT AS line_sum FROM spans GROUP BY doc_id',
    "b6_quote_at": f'WITH {SPANS} SELECT d.doc_id, (length(d.text) // 2)::INT AS at, span_no, length(s.text) AS n_chars FROM documents d JOIN spans s ON d.doc_id = s.doc_id AND length(d.text) // 2 >= s."start" AND length(d.text) // 2 < s."end"',
    "b8_stems": f"WITH t AS (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z0-9+%]+')) AS w FROM documents), c AS (SELECT w, count(*) AS n FROM t WHERE w <> '' AND w NOT IN {V.STOPWORDS} GROUP BY w) SELECT {STEM} AS stem, sum(n)::BIGINT AS n, count(*) AS n_words FROM c GROUP BY 1",
    "b11_clauses": f"""WITH {SPANS}, c AS (SELECT doc_id, span_no, text, list_filter(list_transform(regexp_split_to_array(text, '[,;]'), lambda x: trim(x)), lambda x: x <> '') AS l FROM spans),
      d AS (SELECT doc_id, CASE WHEN len(l) > 0 THEN l ELSE [text] END AS l FROM c) SELECT doc_id, sum(len(l))::BIGINT AS n, sum(list_sum(list_transform(l, lambda x: length(x))))::BIGINT AS n_chars, max(len(l) - 1) AS most FROM d GROUP BY doc_id""",
    "b13_forms": r"""SELECT p_partkey, p_type AS opened, list_aggregate(list_transform(string_split(lower(p_name), ' '), lambda w, i: CASE WHEN NOT regexp_matches(w, '^[a-z''-]+$') OR (i > 1 AND list_contains(['a','an','and','as','at','but','by','for','in','of','on','or','the','to','with','via','per'], w)) THEN w ELSE upper(left(w, 1)) || substr(w, 2) END), 'string_agg', ' ') AS titled,
      regexp_replace(regexp_replace(p_brand || '_' || p_type, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, len(list_filter(regexp_split_to_array(p_name, '\s+'), lambda x: x <> ''))::INT AS n_words, trim(regexp_replace(lower(p_name), '[^a-z0-9+%]+', ' ', 'g')) AS norm FROM part""",
    "b20_templates": "SELECT c_custkey, 'To ' || c_name || ': news for ' || lower(c_mktsegment) || ', {{LATER}}' AS text, 'LATER' AS open FROM customer",
    "c1_headings": f"WITH {LINES}, {TOY_HEADS} SELECT doc_id, " + ", ".join(f"count(*) FILTER (WHERE heading = '{k}') AS {k}" for k in ("responsibility", "requirement", "other", "ignored", "unknown")) + " FROM heads GROUP BY doc_id",
    "c2_sections": f"WITH {LINES}, {TOY_HEADS}, {STATES} SELECT doc_id, count(*) FILTER (WHERE s = 'ignored') AS n_ignored, count(*) FILTER (WHERE s = 'requirement') AS n_requirement, count(k) AS n_known FROM states GROUP BY doc_id",
    "c3_sentences": f"WITH {SENTENCES} SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE matchable) AS n_matchable, count(*) FILTER (WHERE sub_type = 'responsibility') AS n_responsibility FROM sentences GROUP BY doc_id",
    "c4_matchable_text": f"WITH {SENTENCES}, t AS (SELECT doc_id, coalesce(string_agg(text, ' ' ORDER BY span_no) FILTER (WHERE matchable), '') AS t FROM sentences GROUP BY doc_id) SELECT doc_id, length(t) AS n_chars, md5(t) AS digest FROM t",
    "c5_unclassified": f"WITH {LINES}, {FULL_HEADS} SELECT doc_id, count(*) FILTER (WHERE heading = 'unknown')::INT AS n, md5(coalesce(string_agg(text, chr(10) ORDER BY line_no) FILTER (WHERE heading = 'unknown'), '')) AS digest, coalesce(bool_or(heading <> 'unknown'), false) AS headings_found FROM heads GROUP BY doc_id",
    "c6_requirement_sections": f"""WITH {LINES}, {HEADS.replace('{kind}', "CASE WHEN regexp_matches(h, '(?:^|[^a-z0-9_À-ɏ])the(?:[^a-z0-9_À-ɏ]|$)') THEN 'requirement' WHEN regexp_matches(h, '(?:^|[^a-z0-9_À-ɏ])(?:of|und)(?:[^a-z0-9_À-ɏ]|$)') THEN 'ignored' END")},
      s AS (SELECT *, last_value(heading IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l FROM heads)
      SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE l = 'ignored') AS n_ignored, count(*) FILTER (WHERE l = 'requirement') AS n_requirement FROM s WHERE heading IS NULL AND text <> '' GROUP BY doc_id""",
    "d1_terms": rf"""WITH {WORDS},
      m AS (SELECT DISTINCT doc_id, term FROM words JOIN {_values([(t, t.rstrip('*'), t.endswith('*')) for t in q.TERMS if ' ' not in t], 'term, base, wild')} ON w = base OR (wild AND starts_with(w, base))
      UNION SELECT doc_id, 'of the' FROM documents WHERE regexp_matches(text, '(?i)\bof the\b'))
      SELECT term, count(*) AS n_docs, sum(doc_id)::BIGINT AS id_sum FROM m GROUP BY term""",
    "d4_stem_pairs": f"""WITH t AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-z0-9+%]+')) AS w FROM benchmark), s AS (SELECT DISTINCT {STEM} AS a FROM t WHERE w <> '')
      SELECT x.a, count(*) AS n, min(y.a) AS "first", max(y.a) AS "last" FROM s x JOIN s y ON x.a = y.a OR (least(length(x.a), length(y.a)) >= 5 AND abs(length(x.a) - length(y.a)) <= 2 AND (starts_with(x.a, y.a) OR starts_with(y.a, x.a))) GROUP BY x.a""",
    "d9_tag_universe": """WITH e AS (SELECT 0 AS src, p_partkey AS pos, upper(p_type) AS tag FROM part UNION ALL SELECT 1, p_partkey, lower(p_type) FROM part UNION ALL SELECT 2, p_partkey, p_brand FROM part)
      SELECT src::INT AS src, pos, tag FROM (SELECT *, row_number() OVER (PARTITION BY lower(tag) ORDER BY src, pos, tag) AS r FROM e) WHERE r = 1""",
    "d11_tools": f"WITH {WORDS} SELECT doc_id, coalesce(string_agg(w, ',' ORDER BY w) FILTER (WHERE w IN ('the', 'der')), '') AS have, coalesce(string_agg(w, ',' ORDER BY w) FILTER (WHERE w IN ('la', 'of')), '') AS missing FROM words WHERE w IN ('the', 'der', 'la', 'of') GROUP BY doc_id",
    "d13_first_matches": f"""WITH {SPANS}, m AS (SELECT doc_id, 'r1' AS rule_id, "start", text FROM spans WHERE regexp_matches(text, '(?i)the [a-z]+ing') UNION ALL SELECT doc_id, 'r2', "start", text FROM spans WHERE regexp_matches(text, '(?i)^d') UNION ALL SELECT doc_id, 'r3', "start", text FROM spans WHERE regexp_matches(text, '[0-9]'))
      SELECT doc_id, rule_id, "start"::INT AS "start", length(text) AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, rule_id ORDER BY "start") AS r FROM m) WHERE r = 1""",
    "d14_verbatim": "WITH q AS (SELECT lower(r_name) AS quote FROM region UNION ALL VALUES ('the'), ('der')) SELECT l.doc_id, count(*) AS n, count(*) FILTER (WHERE contains(lower(d.text), quote)) AS n_verbatim FROM labels l CROSS JOIN q LEFT JOIN documents d USING (doc_id) GROUP BY l.doc_id",
    "d12_places": r"""WITH m AS (SELECT doc_id, unnest(l) AS n, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '\b(?:the of|the|und|der|of|la)\b') AS l FROM documents)),
      f AS (SELECT doc_id, CASE n WHEN 'the of' THEN 'Theof' ELSE upper(left(n, 1)) || substr(n, 2) END AS p, min(i) AS i FROM m GROUP BY ALL) SELECT doc_id, string_agg(p, ',' ORDER BY i) AS places FROM f GROUP BY doc_id""",
    "d14_quotes": "SELECT item_id AS quote_id, doc_id, strpos(lower(d.text), lower(b.text)) - 1 AS at FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text))",
    "d14_phrases": """WITH s AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark), q AS (SELECT item_id * 10 + k AS quote_id, lower(substr(array_to_string(w[1:n], ' '), c)) AS q FROM s, (VALUES (0, 12, 2), (1, 10, 1), (2, 5, 2), (3, 3, 1), (4, 2, 2), (5, 1, 1), (6, 1, 2)) AS v(k, n, c))
      SELECT quote_id, count(*) AS n_docs, sum(strpos(lower(d.text), q) - 1)::BIGINT AS at_sum FROM q JOIN documents d ON contains(lower(d.text), q) GROUP BY quote_id""",
    "d12_mentions": r"""WITH m AS (SELECT doc_id, regexp_extract_all(lower(text), '\b(?:the of|the|und|der|of|la)\b') AS l, list_transform(regexp_split_to_array(lower(text), '\b(?:the of|the|und|der|of|la)\b'), lambda x: length(x)) AS g FROM documents),
      x AS (SELECT doc_id, unnest(range(len(l))) AS no, unnest(l) AS n, l, g FROM m)
      SELECT doc_id, no::INT AS no, (list_sum(g[1:no + 1]) + coalesce(list_sum(list_transform(l[1:no], lambda y: length(y))), 0))::INT AS start, (list_sum(g[1:no + 1]) + coalesce(list_sum(list_transform(l[1:no], lambda y: length(y))), 0) + length(n))::INT AS "end", CASE n WHEN 'the of' THEN 'Theof' ELSE upper(left(n, 1)) || substr(n, 2) END AS canonical FROM x""",
    "e1_numbers": rf"""WITH {SPANS}, m AS (SELECT doc_id, span_no, text, regexp_extract_all(text, '{q.UNIT}', 1) AS a, regexp_extract_all(text, '{q.UNIT}', 2) AS b FROM spans), x AS (SELECT doc_id, span_no, text, unnest(a) AS a, unnest(b) AS b, generate_subscripts(a, 1) - 1 AS no FROM m)
      SELECT doc_id, span_no, no, least(try_cast(a AS INT), coalesce(try_cast(b AS INT), try_cast(a AS INT))) AS value, regexp_matches(text, '(?i)version') AS has_context, coalesce(least(try_cast(a AS INT), coalesce(try_cast(b AS INT), try_cast(a AS INT))) <= 15, false) AS valid FROM x""",
    "e2_required": rf"""WITH {SPANS}, m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{q.UNIT}', 1)) AS a, unnest(regexp_extract_all(text, '{q.UNIT}', 2)) AS b FROM spans), v AS (SELECT doc_id, least(try_cast(a AS INT), coalesce(try_cast(b AS INT), try_cast(a AS INT))) AS v FROM m),
      g AS (SELECT doc_id, max(v) FILTER (WHERE v <= 15) AS required, count(*) AS n, count(*) FILTER (WHERE v <= 15) AS k FROM v GROUP BY doc_id) SELECT doc_id, required, coalesce(n, 0) > 0 AND coalesce(k, 0) = 0 AS all_discarded FROM (SELECT doc_id FROM documents) LEFT JOIN g USING (doc_id)""",
    "e3_labels": "SELECT conv_id AS doc_id, turn AS line_no, length(trim(regexp_extract(role || ': ' || replace(text, chr(10), ' '), '(?i)^(?:user)\\s*:\\s*(.+)$', 1))) AS n_chars FROM conversations WHERE regexp_matches(role || ': ' || replace(text, chr(10), ' '), '(?i)^(?:user)\\s*:\\s*(.+)$')",
    "e13_salary": r"""SELECT doc_id, regexp_matches(text, '[€£$]\s?[0-9]') OR regexp_matches(text, '(?i)\bper annum\b|\bp\.a\.') OR regexp_matches(text, '(?i)\b(?:salary|compensation|remuneration|pay)\b[^.\n]{0,40}[0-9]{2}') AS salary,
      trim(source) <> '' AND NOT contains(source, 'src1') AND NOT contains(source, 'src2') AS outside FROM documents""",
    "f1_scores": f"WITH {SCORES} SELECT doc_id, profile_id, body_score FROM body",
    "f3_ranks": f"WITH {SCORES} SELECT doc_id, profile_id, score, rank::INT AS rank FROM ranked",
    "f4_picks": f"WITH {SCORES} SELECT d.doc_id, CASE WHEN score = 0 AND length(text) >= 300 THEN 'en' WHEN score <> 0 THEN profile_id END AS picked, score = 0 AS no_match, score = 0 AND length(text) >= 300 AS guessed FROM documents d JOIN ranked r ON r.doc_id = d.doc_id AND rank = 1",
    "f8_variants": f"""WITH {HITS}, v AS (SELECT * FROM {_values(q.VARIANTS, 'group_id, strength, variant_no, variant_id')}), t AS (SELECT * FROM {_values(q.VARIANT_TAGS, 'variant_id, tag')}), o AS (SELECT doc_id, variant_id, count(DISTINCT tag) AS n FROM t JOIN hits USING (tag) GROUP BY ALL),
      r AS (SELECT d.doc_id, v.group_id, v.variant_id, coalesce(o.n, 0) AS n, row_number() OVER (PARTITION BY d.doc_id, v.group_id ORDER BY (v.variant_id = 'a3' AND h.tag IS NOT NULL) DESC, coalesce(o.n, 0) DESC, v.variant_no) AS r, max(coalesce(o.n, 0)) OVER (PARTITION BY d.doc_id, v.group_id) AS best_overlap
      FROM documents d CROSS JOIN v LEFT JOIN o ON o.doc_id = d.doc_id AND o.variant_id = v.variant_id LEFT JOIN hits h ON h.doc_id = d.doc_id AND h.tag = 'spanish') SELECT doc_id, group_id, variant_id, best_overlap FROM r WHERE r = 1""",
    "f12_roles": "SELECT o_custkey AS person_id, o_orderkey AS role_no, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderpriority < '3') DESC, o_orderdate::DATE DESC, o_orderkey)::INT AS place FROM orders",
    "f18_strengths": "SELECT lower(p_type) AS tag, min(p_size % 4 + 1)::INT AS strength FROM part GROUP BY 1",
    "f21_close_match": f"WITH {SPANS} SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE regexp_matches(text, '(?i)th')) AS n_hit, count(*) FILTER (WHERE regexp_matches(text, '(?i)th')) * 2 >= count(*) AS close FROM spans GROUP BY doc_id",
    "f24_rotation": "WITH h AS (SELECT c_custkey, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(lower(c_name), ''), lambda x: ascii(x)::BIGINT)), lambda a, x: (a * 31 + x) % 4294967296) AS hash FROM customer) SELECT c_custkey, hash, ['a', 'b', 'c', 'd', 'e', 'f', 'g'][hash % 7 + 1] AS item FROM h",
    "g10_outcomes": "SELECT user_id::VARCHAR AS rule_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS n_rejected, max(ts::DATE)::VARCHAR AS latest FROM events GROUP BY user_id",
    "g13_verdicts": """WITH r AS (SELECT p_partkey AS doc_id, p_size > 45 AS b, CASE WHEN p_size % 8 < 7 THEN p_size % 8 END AS q, p_size % 3 AS m, p_size % 5 = 0 AS skips, p_size % 2 = 0 AS vague, p_size % 8 = 7 AS gone FROM part), v AS (SELECT *, CASE WHEN skips THEN 0 ELSE coalesce(q, 0) END AS y FROM r)
      SELECT doc_id, CASE WHEN b THEN 'BLOCKED' WHEN y >= 2 OR m >= 2 THEN 'STRETCH' ELSE 'GOOD' END AS verdict, CASE WHEN b THEN '' ELSE concat_ws(',', CASE WHEN y >= 5 THEN 'years_reach' END, CASE WHEN y >= 2 AND y < 5 THEN 'years_stretch' END, CASE WHEN m >= 2 THEN 'tools' END) END AS reasons,
        NOT b AND NOT skips AND q IS NULL AND vague AS ambiguous, NOT b AND gone AS discarded FROM v""",
    "g15_months": """WITH s AS (SELECT l_orderkey AS k, max(l_shipdate::DATE) AS e FROM lineitem GROUP BY 1), r AS (SELECT o_custkey AS person_id, o_orderdate::DATE AS s, coalesce(e, DATE '1999-01-01') AS e, o_orderstatus = 'F' AS relevant, o_orderpriority < '4' AS ft FROM orders LEFT JOIN s ON k = o_orderkey),
      m AS (SELECT *, (year(e) - year(s)) * 12 + month(e) - month(s) + CASE WHEN day(e) >= day(s) THEN 1 ELSE 0 END AS m FROM r)
      SELECT person_id, coalesce(sum(m) FILTER (WHERE relevant), 0)::BIGINT AS relevant, coalesce(sum(m) FILTER (WHERE ft), 0)::BIGINT AS professional, coalesce(sum(m) FILTER (WHERE NOT ft AND NOT relevant), 0)::BIGINT AS other FROM m GROUP BY person_id""",
    "h4_dashes": rf"""WITH {LINES}, b AS (SELECT doc_id, line_no, translate(text, '|%', '–—') AS t FROM lines), p AS (SELECT doc_id, line_no, t, unnest(generate_series(1, length(t))) AS k FROM b WHERE regexp_matches(t, '[–—]'))
      SELECT doc_id, count(*) AS n, sum(k - 1)::BIGINT AS at_sum, sum(length(substr(t, greatest(k - 20, 1), k - greatest(k - 20, 1) + 21)))::BIGINT AS n_chars FROM p WHERE substr(t, k, 1) IN ('–', '—') GROUP BY doc_id""",
    "h9_smoke": f"WITH {LINES}, f AS ({' UNION ALL '.join(f'''SELECT doc_id, '{k}' AS detail FROM lines WHERE regexp_matches(text, '{p}')''' for k, p in SMOKE.items())}) SELECT detail, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM f GROUP BY detail",
    "h10_budget": f"WITH b AS ({ITEM}) SELECT doc_id, sum(cost + 1)::BIGINT AS used, greatest(0, sum(cost + 1) - 95)::BIGINT AS overflow, sum(cost + 1) <= 95 AS fits FROM b GROUP BY doc_id",
    "h11_shorten": f"""WITH b AS ({ITEM}), o AS (SELECT *, greatest(0, sum(cost + 1) OVER (PARTITION BY doc_id) - 95) AS overflow, greatest(0, cost - short_cost) AS saving FROM b), s AS (SELECT *, coalesce(sum(saving) OVER (PARTITION BY doc_id ORDER BY strength_no DESC, cost DESC, block_no DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o)
      SELECT doc_id, block_no, before < overflow AND saving > 0 AS shortened, CASE WHEN before < overflow AND saving > 0 THEN saving ELSE 0 END::BIGINT AS saved FROM s""",
    "i2_stale": "WITH m AS (SELECT doc_id AS key, CASE WHEN lang = 'fr' THEN md5(text) ELSE sha256(text) END AS h FROM documents WHERE lang <> 'de'), c AS (SELECT doc_id AS key, sha256(text) AS g FROM documents WHERE n_chars < 2000) SELECT key, CASE WHEN h IS NULL THEN 'missing' WHEN g IS NULL THEN 'extra' ELSE 'stale' END AS state FROM m FULL JOIN c USING (key) WHERE h IS DISTINCT FROM g",
    "i4_multiset": "WITH x AS (SELECT l_returnflag, l_quantity::INT AS q FROM lineitem WHERE l_linestatus = 'O' EXCEPT ALL SELECT l_returnflag, l_quantity::INT FROM lineitem WHERE l_linestatus <> 'O') SELECT l_returnflag, q, count(*) AS n FROM x GROUP BY ALL",
    "i5_baseline": f"WITH {HITS}, t AS (SELECT unnest(['english', 'german', 'french', 'spanish', 'nothing']) AS tag) SELECT tag, count(doc_id) AS n_docs FROM t LEFT JOIN hits USING (tag) GROUP BY tag",
    "i5_documents": f"WITH {HITS} SELECT tag, doc_id FROM hits WHERE tag IN ('english', 'german', 'french', 'spanish', 'nothing')",
    "i6_delta": f"WITH {HITS} SELECT tag, doc_id, CASE WHEN n_chars >= 4000 THEN 'added' ELSE 'removed' END AS change FROM hits JOIN documents USING (doc_id) WHERE tag IN ('english', 'german', 'french', 'spanish', 'nothing') AND (n_chars >= 4000 OR n_chars <= 400)",
    "i8_accuracy": "SELECT quality::VARCHAR AS expected, CASE WHEN n_chars > 100 THEN '1' ELSE '0' END AS picked, count(*) AS n, quality::VARCHAR = CASE WHEN n_chars > 100 THEN '1' ELSE '0' END AS \"right\" FROM labels JOIN documents USING (doc_id) GROUP BY ALL",
    "j1_dangling": "SELECT 'dangling' AS rule, l_orderkey || '-' || l_linenumber AS key, l_suppkey::VARCHAR AS detail FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)",
    "j2_coverage": "SELECT 'coverage' AS rule, c_custkey::VARCHAR AS key, count(o_orderkey)::VARCHAR AS detail FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING count(o_orderkey) < 5 OR count(o_orderkey) > 12",
    "j3_domains": "SELECT 'domain' AS rule, o_orderkey::VARCHAR AS key, o_orderstatus AS detail FROM orders WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT 'too_short', p_partkey::VARCHAR, length(p_name)::VARCHAR FROM part WHERE length(trim(p_name)) < 18",
    "j5_first_words": "WITH d AS (SELECT doc_id, lower(regexp_extract(text, '^\\s*([A-Za-z'']+)', 1)) AS w FROM documents) SELECT 'first_word' AS rule, doc_id::VARCHAR AS key, w AS detail FROM d WHERE w NOT IN (SELECT lower(regexp_extract(text, '^\\s*([A-Za-z'']+)', 1)) FROM benchmark WHERE regexp_extract(text, '^\\s*([A-Za-z'']+)', 1) <> '')",
    "j12_dates": """WITH r AS (SELECT l_orderkey || '-' || l_linenumber AS k, o_orderdate::DATE AS s, l_linenumber AS n, l_shipdate::DATE AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
      SELECT 'dates' AS rule, k AS key, CASE WHEN n = 7 THEN 'bad end' ELSE 'end before start' END AS detail FROM r WHERE n = 7 OR (n = 6 AND DATE '1990-01-01' < s) OR (n NOT IN (6, 7) AND e < s)""",
    "j14_slots": "SELECT 'slot' AS rule, c_custkey::VARCHAR AS key, 'malformed: lower' AS detail FROM customer UNION ALL SELECT 'slot', c_custkey::VARCHAR, 'unknown: ' || c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING'",
    "j15_pii": """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 8 AS f FROM orders) SELECT 'pii' AS rule, k::VARCHAR AS key, CASE f WHEN 0 THEN 'trainee: TCS/Trainee/' || k WHEN 1 THEN 'immigration: gnib-' || lpad(k::VARCHAR, 5, '0') WHEN 2 THEN 'registration: OREG ' || k WHEN 3 THEN 'certificate: Jan/24/' || lpad(k::VARCHAR, 3, '0')
      WHEN 4 THEN 'salary_band: 45,000 - 5' || k % 10 || ',500' WHEN 5 THEN 'employee_before: EMPLOYEE no. ' || lpad(k::VARCHAR, 7, '0') ELSE 'employee_after: ' || lpad(k::VARCHAR, 7, '1') || ' is an employee' END AS detail FROM o WHERE f < 7 AND (f <> 2 OR k >= 1000)""",
    "j16_contacts": r"""WITH f AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9]')) AS v FROM documents UNION SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\+[0-9][0-9 ()-]{7,}[0-9]')) FROM documents) SELECT 'contact' AS rule, doc_id::VARCHAR AS key, v AS detail FROM f""",
    "k1_inbox": r"""SELECT slug, strftime(try_strptime('2024-05-' || lpad((page_id % 40)::VARCHAR, 2, '0'), '%Y-%m-%d'), '%Y-%m-%d') AS day, sha256(replace(replace(html, '–', '-'), '—', '-')) AS hash
      FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY page_id DESC, sha256(replace(replace(html, '–', '-'), '—', '-')) DESC) AS r FROM (SELECT *, replace(regexp_extract(url, '^https?://([^?#]+)', 1), '/', '-') AS slug FROM pages)) WHERE r = 1""",
    "k2_upserts": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, md5(event_id::VARCHAR || '|' || event_type) DESC) AS r FROM events) WHERE r = 1",
    "k2_repeats": "SELECT DISTINCT event_type, sha256(props) AS hash FROM events",
    "k3_stream": "SELECT strftime(ts::DATE, '%Y-%m-%d') AS day, event_type AS tag, count(*) AS n FROM events WHERE ts::DATE + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY ALL",
    "a7_published": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders",
    "k2_latest": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, md5(event_id::VARCHAR || '|' || event_type) DESC) AS r FROM events) WHERE r = 1",
    "k3_counts": "SELECT strftime(ts::DATE, '%Y-%m-%d') AS day, event_type AS tag, count(*) AS n FROM events GROUP BY ALL",
    "d5_tags": rf"""WITH {SPANS}, tw AS (SELECT DISTINCT tag, p, unnest(string_split(p, ' ')) AS w FROM {_values([t for t in q.TAGS if not any(c.isdigit() for c in t[1])], 'tag, p')}), ts AS (SELECT DISTINCT tag, p, {STEM} AS b FROM tw WHERE w NOT IN {V.STOPWORDS}), n AS (SELECT tag, p, count(*) AS n FROM ts GROUP BY ALL),
      sw AS (SELECT DISTINCT doc_id, span_no, unnest(regexp_split_to_array(lower(text), '[^a-z0-9+%]+')) AS w FROM spans), ss AS (SELECT DISTINCT doc_id, span_no, {STEM} AS a FROM sw WHERE w <> ''),
      m AS (SELECT doc_id, span_no, tag, p, count(DISTINCT b) AS k FROM ss JOIN ts ON a = b OR (least(length(a), length(b)) >= 5 AND abs(length(a) - length(b)) <= 2 AND (starts_with(a, b) OR starts_with(b, a))) GROUP BY ALL),
      f AS (SELECT DISTINCT doc_id, span_no, tag FROM m JOIN n USING (tag, p) WHERE k = n UNION SELECT doc_id, span_no, 'number' FROM spans WHERE contains(' ' || trim(regexp_replace(lower(text), '[^a-z0-9+%]+', ' ', 'g')) || ' ', ' 2 0 '))
      SELECT tag, count(*) AS n_spans, count(DISTINCT doc_id) AS n_docs, sum(span_no)::BIGINT AS span_sum FROM f GROUP BY tag""",
    "g1_clauses": rf"""WITH {SPANS}, c AS (SELECT doc_id, span_no, CASE WHEN len(l) > 0 THEN l ELSE [text] END AS l FROM (SELECT *, list_filter(list_transform(regexp_split_to_array(text, '[,;]'), lambda x: trim(x)), lambda x: x <> '') AS l FROM spans)),
      e AS (SELECT doc_id, span_no, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM c), k AS (SELECT *, regexp_matches(t, '(?i){'|'.join(V.PREFERRED)}') AS p, regexp_matches(t, '(?i){'|'.join(V.REQUIRED)}') AS r FROM e),
      x AS (SELECT *, coalesce(lead(p) OVER (PARTITION BY doc_id, span_no ORDER BY i), false) AS nx FROM k)
      SELECT CASE WHEN p THEN 'preferred' WHEN r THEN 'required' WHEN nx THEN 'preferred' WHEN span_no % 2 = 0 THEN 'required' ELSE 'ambiguous' END AS class, p OR r OR nx AS explicit, count(*) AS n FROM x GROUP BY ALL""",
    "h3_banned": rf"""WITH {LINES}, f AS (SELECT doc_id, line_no, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9_]+', ' ', 'g')) || ' ' AS t FROM lines) SELECT doc_id, term AS detail, count(*) AS n, min(line_no)::INT AS first_block FROM f JOIN (SELECT unnest(['idiot', 'password', 'apache license']) AS term) ON contains(t, ' ' || term || ' ') GROUP BY ALL""",
    "h14_paragraphs": f"""WITH b AS ({ITEM}), o AS (SELECT doc_id, block_no, cost, greatest(0, sum(cost) OVER (PARTITION BY doc_id) - 80) AS over FROM b),
      s AS (SELECT *, CASE WHEN block_no IN (2, 3) THEN cost ELSE 0 END AS s FROM o), t AS (SELECT *, coalesce(sum(s) OVER (PARTITION BY doc_id ORDER BY CASE WHEN block_no IN (2, 3) THEN 0 ELSE 1 END, block_no DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
      SELECT doc_id, block_no AS paragraph_no, block_no IN (2, 3) AND s > 0 AND before < over AS dropped FROM t""",
    "h7_gates": rf"""WITH {LINES}, f AS (SELECT doc_id, 'smoke' AS gate FROM ({' UNION ALL '.join(f"SELECT doc_id FROM lines WHERE regexp_matches(text, '{p}')" for p in SMOKE.values())}) UNION ALL SELECT doc_id, 'required' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM lines WHERE line_no = 2)),
      g AS (SELECT d.doc_id, p.gate, count(f.gate) AS n FROM documents d CROSS JOIN (SELECT unnest(['smoke', 'required']) AS gate) p LEFT JOIN f ON f.doc_id = d.doc_id AND f.gate = p.gate GROUP BY ALL)
      SELECT doc_id, gate, n = 0 AS passed, n AS n_findings, bool_and(n = 0) OVER (PARTITION BY doc_id) AS all_passed FROM g""",
    "a4_overlay": "SELECT c_custkey, CASE WHEN c_mktsegment < 'F' THEN c_name || '-x' ELSE c_name END AS c_name, CASE WHEN c_mktsegment < 'BUILDING' THEN upper(c_mktsegment) ELSE c_mktsegment END AS c_mktsegment FROM customer",
}
