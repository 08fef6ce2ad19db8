"""DuckDB SQL with the rows of the rule queries. What a field or finding should be is said by the form of the document, from
the rules, and not derived from the operators."""

from __future__ import annotations

from lineloom.operators.scoring import MARKERS
from lineloom.plans import rule_queries as q_rules
from lineloom.plans import text_queries as q
from lineloom.plans.oracles import HITS, SENTENCES, SPANS, STEM, V, WORDS, _values
from lineloom.plans.oracles import SQL as BASE

ADS = "ads AS (SELECT c_custkey AS doc_id, replace(c_name, '#', '') AS n, 'Town' || chr(65 + n_nationkey) AS p, 'Town' || chr(65 + n_nationkey) || '/' || n_regionkey AS c, n_regionkey AS r, n_nationkey AS y, c_mktsegment AS s FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def by_form(auto: str, building: str, furniture: str, machinery: str, household: str) -> str:
    forms = zip(("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD"), (auto, building, furniture, machinery, household))
    return "CASE s " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in forms) + " END"


ROLE = by_form("'Senior Risk Analyst'", "'Site Engineer'", "'Product Designer'", "'Machine Operator'", "NULL")
ROLE_HOW = by_form("'label'", "'header'", "'body'", "'header'", "NULL")
COMPANY = by_form("n", "n", "n", "NULL", "NULL")
CITY = by_form("CASE WHEN r IN (0, 1) THEN c ELSE 'TownD/3' END", "c", "c", "NULL", "CASE WHEN p = 'TownD' THEN c END")
CITY_HOW = by_form("'label'", "'header'", "'body'", "NULL", "CASE WHEN p = 'TownD' THEN 'mentioned' END")
NOTE = by_form("NULL", "NULL", "NULL", "'remote'", "CASE WHEN p <> 'TownD' THEN 'several' END")
TEAM = by_form("'Credit Risk team'", "NULL", "NULL", "NULL", "NULL")
RECIPIENT = by_form("'Mary Byrne'", "'Tom Smith'", "'Ann Lee'", "NULL", "NULL")

# findings: the rules over the clauses and sentences of the documents with their demands
_chosen = " || ' ' || ".join(f"{[*x]}[doc_id % {len(x)} + 1]" for x in q_rules.DEMANDS)
DEMANDS = rf"""demands AS (SELECT doc_id, text || chr(10) || replace(replace(replace({_chosen}, '{{y}}', (doc_id % 23)::VARCHAR), '{{a}}', (doc_id % 19 + 1)::VARCHAR), '{{b}}', (doc_id % 13 + 5)::VARCHAR) AS text FROM documents)"""
_unit, _item = f"(?i){V.YEARS}", _values([(i, p) for i, p, held, _ in q_rules.ITEMS if held != "held"], "id, p")
FOUND = rf"""{DEMANDS}, {SENTENCES.replace("FROM documents", "FROM demands")}, placed AS (SELECT s.*, p."start" FROM sentences s JOIN spans p USING (doc_id, span_no)),
upgraded AS (SELECT doc_id, coalesce(regexp_matches(text, '(?i){V.REGULATORY}'), false) AS up FROM demands),
c AS (SELECT doc_id, span_no, CASE WHEN len(l) > 0 THEN l ELSE [text] END AS l FROM (SELECT *, list_filter(list_transform(regexp_split_to_array(text, '[,;]'), lambda x: trim(x)), lambda x: x <> '') AS l FROM spans)),
ce AS (SELECT doc_id, span_no, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM c), ck AS (SELECT *, regexp_matches(t, '(?i){'|'.join(V.PREFERRED)}') AS p, regexp_matches(t, '(?i){'|'.join(V.REQUIRED)}') AS r FROM ce),
cx AS (SELECT *, coalesce(lead(p) OVER (PARTITION BY doc_id, span_no ORDER BY i), false) AS nx FROM ck), clauses AS (SELECT doc_id, span_no, i, t, CASE WHEN p THEN 'preferred' WHEN r THEN 'required' WHEN nx THEN 'preferred' ELSE 'ambiguous' END AS class, p OR r OR nx AS explicit FROM cx),
iw AS (SELECT DISTINCT id, unnest(string_split(p, ' ')) AS w FROM {_item}), ib AS (SELECT DISTINCT id, {STEM} AS b FROM iw), ibn AS (SELECT id, count(*) AS n FROM ib GROUP BY id),
cw AS (SELECT DISTINCT doc_id, span_no, i, unnest(regexp_split_to_array(lower(t), '[^a-z0-9+%]+')) AS w FROM clauses), cb AS (SELECT DISTINCT doc_id, span_no, i, {STEM} AS a FROM cw WHERE w <> ''),
met AS (SELECT doc_id, span_no, i, id, count(DISTINCT b) AS n FROM cb JOIN ib ON a = b OR (least(length(a), length(b)) >= 5 AND abs(length(a) - length(b)) <= 2 AND (starts_with(a, b) OR starts_with(b, a))) GROUP BY ALL),
read AS (SELECT doc_id, span_no, i, id, t, explicit, CASE WHEN up AND id = 'degree' AND class = 'ambiguous' THEN 'required' ELSE class END AS class FROM met JOIN ibn USING (id, n) JOIN clauses USING (doc_id, span_no, i) JOIN upgraded USING (doc_id)),
needs AS (SELECT doc_id, id, class, explicit, CASE WHEN id = 'degree' AND class = 'required' THEN 'red' ELSE 'amber' END AS severity, t AS quote, span_no AS "at"
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, id ORDER BY explicit DESC, CASE class WHEN 'required' THEN 0 WHEN 'preferred' THEN 1 ELSE 2 END, span_no, i) AS k FROM read) WHERE k = 1),
n1 AS (SELECT doc_id, span_no, matchable, text, regexp_extract_all(translate(text, '–—', '--'), '{_unit}', 1) AS a, regexp_extract_all(translate(text, '–—', '--'), '{_unit}', 2) AS b FROM sentences),
n2 AS (SELECT doc_id, span_no, matchable, text, generate_subscripts(a, 1) AS no, try_cast(unnest(a) AS INT) AS a, try_cast(unnest(b) AS INT) AS b FROM n1),
years AS (SELECT doc_id, span_no, no, text AS quote, least(a, coalesce(b, a)) AS value, coalesce((matchable OR regexp_matches(text, '(?i){V.YEARS_CONTEXT}')) AND least(a, coalesce(b, a)) <= {V.MOST_YEARS}, false) AS valid FROM n2),
figures AS (SELECT doc_id, 'amber' AS severity, quote, value, span_no AS "at" FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, quote ORDER BY span_no, no) AS k FROM years WHERE valid AND value > 1) WHERE k = 1),
sponsors AS (SELECT doc_id, 'amber' AS severity, text AS quote, span_no AS "at" FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY span_no) AS k FROM sentences WHERE regexp_matches(text, '(?i)\bsponsorship\b.{{0,60}}\bnow or in the future\b') OR regexp_matches(text, '(?i)\bnow or in the future\b.{{0,60}}\bsponsorship\b')) WHERE k = 1),
rules AS (SELECT * FROM {_values([(w["id"], w["severity"], w["pattern"], bool(w.get("needs_years"))) for w in q_rules.WARNINGS], "rule_id, severity, p, strict")}),
warned AS (SELECT doc_id, rule_id, severity, text AS quote, "start" AS "at" FROM (SELECT s.doc_id, rule_id, severity, text, "start", row_number() OVER (PARTITION BY s.doc_id, rule_id ORDER BY "start") AS k FROM placed s JOIN rules ON regexp_matches(lower(text), p)
  WHERE matchable AND (NOT strict OR EXISTS (SELECT 1 FROM years y WHERE y.valid AND y.doc_id = s.doc_id AND y.quote = s.text))) WHERE k = 1)"""

LINE = "l AS (SELECT l_orderkey AS doc_id, l_linenumber AS no, max(l_returnflag) AS f, max(l_quantity)::INT AS n, max(l_linestatus) AS s FROM lineitem GROUP BY ALL)"
EVIDENCE = f"{LINE}, e AS (SELECT doc_id, no, f, n - 20 AS overlap, n <= 30 AS lead, CASE WHEN n > 35 THEN '' WHEN s = 'O' THEN 'project' ELSE 'hours' END AS m FROM l)"
QUOTE_FORM = r"""(SELECT trim(regexp_replace(CASE WHEN len(list_filter(regexp_split_to_array(regexp_extract(t, '^[A-Z][A-Za-z &/]{1,40}:\s+(.+)$', 1), '\s+'), lambda x: x <> '')) >= 4 THEN regexp_extract(t, '^[A-Z][A-Za-z &/]{1,40}:\s+(.+)$', 1) ELSE t END, '[\s.;:,]+$', ''))
  FROM (SELECT trim(regexp_replace(regexp_replace(trim(text), '^[\s•*·▪–—-]+', ''), '^\(?[0-9]{1,2}[.)]\s+', '')) AS t))"""
QUOTES = rf"""{HITS}, strengths AS (SELECT * FROM (VALUES ('english', 2), ('german', 1), ('french', 3), ('able', 4)) AS v(tag, strength)), best AS (SELECT doc_id, span_no, min(strength) AS strength FROM tf JOIN strengths USING (tag) GROUP BY ALL),
 kept AS (SELECT doc_id, span_no, text, strength, {QUOTE_FORM} AS quote FROM ms JOIN best USING (doc_id, span_no) WHERE len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) >= 4 AND regexp_matches(text, '[.!?]$') AND NOT regexp_matches(text, '[<>{{}}|]')
   AND NOT list_bool_or(list_transform(list_zip(regexp_extract_all(translate(text, '–—', '--'), '{q.UNIT}', 1), regexp_extract_all(translate(text, '–—', '--'), '{q.UNIT}', 2)), lambda z: coalesce(least(TRY_CAST(z[1] AS INT), coalesce(TRY_CAST(z[2] AS INT), TRY_CAST(z[1] AS INT))) BETWEEN 3 AND 15, false))) IS TRUE AND NOT regexp_matches(text, '(?i)\b(?:equal opportunit|apply now|click here)') AND NOT regexp_matches(text, '(?i)\b(?:idiot|licensed)\b')),
 once AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(quote) ORDER BY strength, span_no) AS o FROM kept), quotes AS (SELECT doc_id, span_no, quote, strength, row_number() OVER (PARTITION BY doc_id ORDER BY strength, span_no) AS rank FROM once WHERE o = 1)"""
VARIANTS = _values(q.VARIANTS, "group_id, strength, variant_no, variant_id")

SQL = {
    "a1_documents": "SELECT doc_id, length(text) AS n FROM documents",
    "b16_names": "SELECT c_custkey, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) || CASE WHEN c_acctbal > 0 THEN ' Supply' ELSE '' END AS company FROM customer",
    "d8_keyword_hits": f"WITH {HITS} SELECT doc_id, tag FROM hits",
    "d10_demands": rf"""WITH {SENTENCES}, w AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS w FROM sentences WHERE matchable), m AS (SELECT DISTINCT doc_id, CASE WHEN starts_with(w, 'thing') THEN 'thing*' ELSE w END AS term FROM w WHERE w IN ('the', 'der') OR starts_with(w, 'thing'))
      SELECT doc_id, string_agg(term, ',' ORDER BY term) AS demands FROM m GROUP BY doc_id""",
    "e4_roles": f"WITH {ADS} SELECT doc_id, {ROLE} AS value, {ROLE_HOW} AS how FROM ads WHERE s <> 'HOUSEHOLD'",
    "e5_companies": f"WITH {ADS} SELECT doc_id, {COMPANY} AS value, {by_form(chr(39) + 'label' + chr(39), chr(39) + 'header' + chr(39), chr(39) + 'body' + chr(39), 'NULL', 'NULL')} AS how, {by_form('11', '8', '6', 'NULL', 'NULL')}::INT AS score FROM ads WHERE s NOT IN ('MACHINERY', 'HOUSEHOLD')",
    "e6_links": "SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN NULL WHEN 'BUILDING' THEN 'AXA' ELSE replace(c_name, '#', ' ') END AS company FROM customer",
    "e7_cities": f"WITH {ADS} SELECT doc_id, {CITY} AS city, {CITY_HOW} AS how, {NOTE} AS note FROM ads",
    "e8_mentions": f"WITH {ADS} SELECT doc_id, {by_form(chr(39) + 'TownD/3' + chr(39) + ' || CASE WHEN p <> ' + chr(39) + 'TownD' + chr(39) + ' THEN ' + chr(39) + ',' + chr(39) + ' || c ELSE ' + chr(39) * 2 + ' END', 'c', 'c', 'c', 'c || CASE WHEN p <> ' + chr(39) + 'TownD' + chr(39) + ' THEN ' + chr(39) + ',TownD/3' + chr(39) + ' ELSE ' + chr(39) * 2 + ' END')} AS places FROM ads",
    "e9_locations": f"WITH {ADS} SELECT doc_id AS c_custkey, CASE r WHEN 0 THEN 'dublin' WHEN 1 THEN 'cork' ELSE 'review' END AS kind, CASE WHEN r IN (0, 1) THEN c ELSE 'TownD/3' END AS place FROM ads",
    "e10_teams": f"WITH {ADS} SELECT doc_id, 'Credit Risk team' AS value, 'body' AS how FROM ads WHERE s = 'AUTOMOBILE'",
    "e11_recipients": f"WITH {ADS} SELECT doc_id, {RECIPIENT} AS value, {by_form(chr(39) + 'body' + chr(39), chr(39) + 'label' + chr(39), chr(39) + 'hiring-team' + chr(39), 'NULL', 'NULL')} AS how FROM ads WHERE s NOT IN ('MACHINERY', 'HOUSEHOLD')",
    "e12_fields": f"WITH {ADS} SELECT doc_id, {ROLE} AS role, {COMPANY} AS company, {CITY} AS city, {TEAM} AS team, {RECIPIENT} AS recipient, {NOTE} AS note FROM ads",
    "e15_missing": "SELECT c_custkey, concat_ws(',', CASE WHEN NOT c_acctbal > 0 THEN 'role' END, CASE WHEN NOT c_acctbal > 3000 AND c_mktsegment <> 'BUILDING' THEN 'company' END) AS missing FROM customer",
    "f5_top_terms": """WITH f AS (SELECT l_orderkey AS doc_id, l_returnflag AS profile_id, l_linestatus = 'O' AS title, l_linenumber AS no, max(l_quantity::INT) AS w FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, profile_id ORDER BY title DESC, w DESC, no) AS r FROM f)
      SELECT doc_id, profile_id, string_agg('t' || no, ',' ORDER BY r) AS terms FROM r WHERE r <= 3 GROUP BY ALL""",
    "f9_clean": "WITH v AS (SELECT p_partkey AS variant_id, p_brand AS group_id, (p_type = 'SMALL' OR p_type LIKE 'PROMO%' OR p_type LIKE 'ECON%') AS bad FROM part), w AS (SELECT *, bool_and(bad) OVER (PARTITION BY group_id) AS every FROM v) SELECT variant_id, group_id FROM w WHERE NOT bad OR every",
    "f10_sorted": "SELECT p_partkey, p_size FROM part",
    "f11_in_order": "WITH i AS (SELECT o_orderkey AS owner, unnest([o_custkey, -1, 1]) AS k, unnest([0, 1, 2]) AS pos FROM orders) SELECT owner, pos::INT AS pos, c_name AS fact FROM i JOIN customer ON k = c_custkey",
    "f13_sections": """WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority < '3' DESC, o_orderdate::DATE DESC, o_orderkey) AS place FROM orders WHERE o_orderstatus = 'O'),
      entry AS (SELECT o_custkey AS doc_id, o_orderkey, 'experience' AS sec, place AS ip FROM ranked UNION ALL SELECT o_custkey, o_orderkey, 'project', o_orderkey FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_custkey, o_orderkey, 'education', o_orderkey FROM orders WHERE o_orderstatus = 'F'),
      e AS (SELECT * FROM entry JOIN orders USING (o_orderkey)), items AS (SELECT l_orderkey, l_linenumber, max(l_returnflag) || ' ' || max(l_quantity)::INT AS text FROM lineitem GROUP BY ALL), t AS (SELECT DISTINCT o_custkey AS doc_id, o_orderstatus AS st, o_orderpriority AS pr FROM orders),
      home AS (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
      b AS (SELECT c_custkey AS doc_id, 'profile' AS sec, 0 AS ip, 0 AS fp, 'para' AS type, c_mktsegment AS text FROM customer
      UNION ALL SELECT DISTINCT doc_id, 'skills', ascii(st), 0, 'skill_label', 'Status ' || st FROM t
      UNION ALL SELECT doc_id, 'skills', ascii(st), 1, 'skill_line', string_agg(pr, ', ' ORDER BY pr = '5-LOW', pr >= '3', ascii(pr) DESC) FROM t GROUP BY doc_id, st
      UNION ALL SELECT doc_id, sec, ip, 0, 'role', o_orderpriority FROM e
      UNION ALL SELECT doc_id, sec, ip, CASE sec WHEN 'project' THEN 2 ELSE 1 END, CASE sec WHEN 'project' THEN 'dates' ELSE 'org' END, 'large' FROM e WHERE o_totalprice > 50000
      UNION ALL SELECT doc_id, sec, ip, CASE sec WHEN 'project' THEN 1 ELSE 2 END, 'aside', 'no ' || o_orderkey FROM e WHERE sec <> 'education'
      UNION ALL SELECT doc_id, sec, ip, CASE sec WHEN 'education' THEN 2 ELSE 3 END, 'dates', strftime(o_orderdate, '%Y-%m') FROM e WHERE sec <> 'project'
      UNION ALL SELECT doc_id, sec, ip, 3, 'para', 'Modules: ' || array_to_string(string_split(o_orderpriority, '-'), ', ') FROM e WHERE sec = 'education'
      UNION ALL SELECT doc_id, sec, ip, 10 + l_linenumber, 'bullet', text FROM e JOIN items ON l_orderkey = o_orderkey WHERE sec <> 'education'
      UNION ALL SELECT c_custkey, 'certifications', 0, 0, 'para', n_name || ', ' || n_regionkey FROM home UNION ALL SELECT c_custkey, 'certifications', 0, 1, 'para', 'Region ' || n_regionkey FROM home UNION ALL SELECT c_custkey, 'certifications', 1, 2, 'para', r_name FROM home),
      s AS (SELECT *, CASE sec WHEN 'profile' THEN 1 WHEN 'skills' THEN 2 WHEN 'experience' THEN 3 WHEN 'project' THEN 4 WHEN 'education' THEN CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE 5 END ELSE 6 END AS sp FROM b JOIN customer ON c_custkey = doc_id),
      h AS (SELECT doc_id, sec, sp, ip, fp, type, text FROM s UNION ALL SELECT DISTINCT doc_id, sec, sp, -1, 0, 'head', CASE sec WHEN 'skills' THEN 'SKILLS' WHEN 'experience' THEN 'EXPERIENCE' WHEN 'project' THEN 'PROJECTS' WHEN 'education' THEN 'EDUCATION' ELSE 'MORE' END FROM s WHERE sec <> 'profile')
      SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY sp, ip, fp, text) - 1)::INT AS block_no, sec AS section_type, type, text FROM h""",
    "h1_sections": "SELECT c_custkey AS doc_id, 'text differs' AS detail FROM customer WHERE c_acctbal < 0",
    "f29_composed": """WITH l AS (SELECT l_orderkey AS doc_id, l_linenumber AS no, max(l_returnflag) AS f, max(l_quantity)::INT AS n, max(l_linestatus) AS s FROM lineitem GROUP BY ALL),
      e AS (SELECT doc_id, no, f, n - 20 AS overlap, n <= 30 AS lead, CASE WHEN n > 35 THEN '' WHEN s = 'O' THEN 'project' ELSE 'hours' END AS m, CASE WHEN n > 35 THEN 'plain words' WHEN s = 'O' THEN 'a project' ELSE 'saved 9 hours' END AS text FROM l),
      one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY overlap DESC, no) AS r FROM e WHERE lead) WHERE r = 1),
      two AS (SELECT * FROM (SELECT e.*, row_number() OVER (PARTITION BY e.doc_id ORDER BY e.overlap DESC, e.no) AS r FROM e JOIN one o USING (doc_id) WHERE e.f <> o.f AND (e.m = '' OR e.m <> o.m)) WHERE r = 1),
      three AS (SELECT * FROM (SELECT e.*, row_number() OVER (PARTITION BY e.doc_id ORDER BY e.overlap DESC, e.no) AS r FROM e JOIN one o USING (doc_id) LEFT JOIN two t USING (doc_id) WHERE e.overlap > 0 AND e.f <> o.f AND e.f IS DISTINCT FROM t.f AND (e.m = '' OR (e.m <> o.m AND e.m IS DISTINCT FROM t.m))) WHERE r = 1),
      ev AS (SELECT doc_id, no, m, text FROM one UNION ALL SELECT doc_id, no, m, text FROM two UNION ALL SELECT doc_id, no, m, text FROM three), told AS (SELECT doc_id, list(m) AS ms FROM ev WHERE m <> '' GROUP BY doc_id),
      p AS (SELECT doc_id, list(no ORDER BY no) AS l FROM (SELECT *, bool_and(again) OVER (PARTITION BY doc_id) AS every FROM (SELECT e.*, coalesce(list_contains(ms, m), false) AS again FROM e LEFT JOIN told USING (doc_id))) WHERE NOT again OR every GROUP BY doc_id),
      h AS (SELECT *, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, x: (a * 31 + x) % 4294967296) AS h FROM p), why AS (SELECT doc_id, l[h % len(l) + 1] AS no FROM h), w AS (SELECT why.doc_id, e.text FROM why JOIN e USING (doc_id, no)),
      f AS (SELECT l_orderkey AS doc_id, min(l_returnflag) FILTER (WHERE l_returnflag IN ('N', 'R')) AS f FROM lineitem GROUP BY 1), g AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'It is urgent.' WHEN o_orderstatus = 'F' THEN 'Years are short.' WHEN f = 'N' THEN 'Nothing is old.' WHEN f = 'R' THEN 'Some came back.' END AS text FROM orders LEFT JOIN f ON doc_id = o_orderkey),
      said AS (SELECT doc_id, text FROM ev UNION ALL SELECT doc_id, text FROM w), part AS (SELECT o_orderkey AS doc_id, 4 AS part_no, 0 AS pos, 'opening' AS part, 'For ' || o_orderpriority || ':' AS text FROM orders UNION ALL SELECT doc_id, 5, 0, 'why', text FROM w UNION ALL SELECT doc_id, 7, no, 'evidence', text FROM ev
      UNION ALL SELECT doc_id, 8, 0, 'gap', text FROM g WHERE text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM said WHERE said.doc_id = g.doc_id AND ((g.text = 'Years are short.' AND said.text = 'plain words') OR (g.text = 'Nothing is old.' AND said.text = 'a project') OR (g.text = 'Some came back.' AND said.text = 'saved 9 hours'))) UNION ALL SELECT o_orderkey, 10, 0, 'close', 'Yours' FROM orders)
      SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY part_no, pos) - 1)::INT AS paragraph_no, part, text FROM part""",
    "f13_blocks": """WITH b AS (SELECT o_orderkey AS doc_id, 0 AS sp, 'open' AS type, 0 AS ip, o_orderstatus AS text FROM orders UNION ALL SELECT l_orderkey, 1, 'items', l_linenumber, max(l_returnflag) FROM lineitem GROUP BY l_orderkey, l_linenumber UNION ALL SELECT DISTINCT l_orderkey, 1, 'head', -1, 'Items' FROM lineitem
      UNION ALL SELECT o_orderkey, 2, 'extra', 0, 'now' FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT o_orderkey, 2, 'head', -1, 'Extra' FROM orders WHERE o_orderpriority = '1-URGENT') SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY sp, ip) - 1)::INT AS block_no, type, text FROM b""",
    "f14_skills": f"WITH {LINE}, h AS (SELECT o_orderkey AS doc_id, o_orderstatus = 'O' AS much FROM orders) SELECT l.doc_id, f AS category, string_agg('t' || no, ', ' ORDER BY no = 1, ((n > 25) = much) DESC, no) AS line FROM l JOIN h USING (doc_id) GROUP BY ALL",
    "f15_to_add": """WITH w AS (SELECT DISTINCT conv_id AS doc_id, role = 'user' AS own, unnest(regexp_split_to_array(lower(text), '[^a-z0-9_]+')) AS w FROM conversations), a AS (SELECT * FROM (VALUES ('the', 'The'), ('of', 'Of'), ('und', 'Und'), ('thing*', 'Things')) AS v(word, term)),
      m AS (SELECT DISTINCT doc_id, own, word, term FROM w JOIN a ON w = word OR (word = 'thing*' AND starts_with(w, 'thing'))) SELECT doc_id, word, term FROM m WHERE own EXCEPT SELECT doc_id, word, term FROM m WHERE NOT own""",
    "f16_gaps": "WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9_]+')) AS w FROM documents), m AS (SELECT DISTINCT doc_id, CASE WHEN w = 'the' THEN 'A' WHEN w = 'der' THEN 'B' ELSE 'C' END AS label FROM w WHERE w IN ('the', 'der') OR starts_with(w, 'thing')) SELECT doc_id, string_agg(label, ',' ORDER BY label) AS gaps FROM m GROUP BY doc_id",
    "f19_quotes": f"WITH {QUOTES} SELECT doc_id, span_no, quote, strength, rank::INT AS rank FROM quotes",
    "f20_auto_quote": rf"""WITH {QUOTES}, d AS (SELECT *, len(list_filter(regexp_split_to_array(quote, '\s+'), lambda x: x <> '')) AS n, lower(regexp_extract(quote, '^[A-Za-z-]+')) AS f FROM quotes), w AS (SELECT *, regexp_replace(f, '(ing|es|s)$', '') AS stem FROM d),
      k AS (SELECT doc_id, span_no, quote, strength * 10 + CASE WHEN n > 30 THEN 3 WHEN n > 22 OR n < 5 THEN 2 ELSE 0 END + CASE WHEN regexp_matches(quote, '(?i)\b(?:you|your|we|our|us)\b') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(quote, '[<>]') THEN 5 ELSE 0 END AS cost FROM w
        WHERE n <= 22 AND NOT regexp_matches(quote, '(?i)\b(?:we|our|ours)\b') AND NOT regexp_matches(quote, '\bus\b') AND NOT regexp_matches(quote, '(?i)^(?:you|the successful candidate|the ideal candidate)\b')
          AND NOT regexp_matches(quote, '(?i)\b(?:essential|required|requirement|must|desirable|preferred|experience (?:in|of|with)|years?|qualified|qualification|degree|ability to|skills?)\b')
          AND len(list_filter(['to', 'und', 'di', 'plac', 'a'], lambda v: f = v OR stem = v OR stem || 'e' = v OR (starts_with(f, v) AND len(f) - len(v) <= 3))) > 0),
      r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cost, span_no) AS r FROM k) SELECT doc_id, quote, cost::INT AS cost FROM r WHERE r = 1""",
    "f22_for_profile": "SELECT p_partkey FROM part WHERE p_size > 40 OR p_type = 'SMALL'",
    "f23_eligible": f"WITH {HITS}, r AS (SELECT * FROM (VALUES ('a1', 'german'), ('a2', 'able'), ('a2', 'english')) AS v(variant_id, tag)) SELECT DISTINCT doc_id, variant_id FROM hits JOIN r USING (tag) UNION SELECT DISTINCT doc_id, variant_id FROM hits CROSS JOIN (SELECT variant_id FROM {VARIANTS} WHERE variant_id NOT IN ('a1', 'a2'))",
    "f25_markers": "SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(text, '(?i){p.replace(chr(39), chr(39) * 2)}') THEN '{i}' END" for i, p in enumerate(MARKERS)) + r") AS marks, regexp_matches(text, '(?i)\bproject\b') OR regexp_matches(text, '(?i)\b[0-9]+ (?:days|weeks|months|years)\b') AS shares FROM documents",
    "f26_evidence": f"""WITH {EVIDENCE}, one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY overlap DESC, no) AS r FROM e WHERE lead) WHERE r = 1),
      two AS (SELECT * FROM (SELECT e.*, row_number() OVER (PARTITION BY e.doc_id ORDER BY e.overlap DESC, e.no) AS r FROM e JOIN one o USING (doc_id) WHERE e.f <> o.f AND (e.m = '' OR e.m <> o.m)) WHERE r = 1),
      three AS (SELECT * FROM (SELECT e.*, row_number() OVER (PARTITION BY e.doc_id ORDER BY e.overlap DESC, e.no) AS r FROM e JOIN one o USING (doc_id) LEFT JOIN two t USING (doc_id) WHERE e.overlap > 0 AND e.f <> o.f AND e.f IS DISTINCT FROM t.f AND (e.m = '' OR (e.m <> o.m AND e.m IS DISTINCT FROM t.m))) WHERE r = 1),
      every AS (SELECT doc_id, no FROM one UNION ALL SELECT doc_id, no FROM two UNION ALL SELECT doc_id, no FROM three) SELECT doc_id, string_agg(no, ',' ORDER BY no) AS evidence FROM every GROUP BY doc_id""",
    "f27_why": f"""WITH {EVIDENCE}, t AS (SELECT e.*, coalesce(m = 'project' AND o_orderstatus = 'O', false) AS again FROM e LEFT JOIN orders ON o_orderkey = doc_id), p AS (SELECT doc_id, list(no ORDER BY no) AS l FROM (SELECT *, bool_and(again) OVER (PARTITION BY doc_id) AS every FROM t) WHERE NOT again OR every GROUP BY doc_id),
      h AS (SELECT *, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, x: (a * 31 + x) % 4294967296) AS h FROM p) SELECT doc_id, l[h % len(l) + 1]::VARCHAR AS variant_id FROM h""",
    "f28_gaps": """WITH f AS (SELECT l_orderkey AS doc_id, min(l_returnflag) FILTER (WHERE l_returnflag IN ('N', 'R')) AS f FROM lineitem GROUP BY 1) SELECT o_orderkey AS doc_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'mismatch' WHEN o_orderstatus = 'F' THEN 'years' WHEN f = 'N' THEN 'new' WHEN f = 'R' THEN 'returned' END AS gap FROM orders LEFT JOIN f ON doc_id = o_orderkey""",
    "f29_letters": "SELECT c_custkey AS doc_id, unnest([0, 1, 2, 3])::INT AS paragraph_no, unnest(['opening', 'requirement_gap', 'requirement_gap', 'close']) AS part, unnest(['Dear ' || c_name || ',', 'g1 ' || lower(c_mktsegment), 'g2', 'Yours']) AS text FROM customer",
    "g2_sentences": rf"""WITH {SPANS}, k AS (SELECT doc_id, CASE WHEN regexp_matches(text, '(?i){'|'.join(V.PREFERRED)}') THEN 'preferred' WHEN regexp_matches(text, '(?i){'|'.join(V.REQUIRED)}') OR regexp_matches(text, '^[A-M]') THEN 'required' ELSE 'ambiguous' END AS class FROM spans) SELECT class, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM k GROUP BY class""",
    "g3_upgrades": f"WITH {FOUND} SELECT doc_id, up AS upgraded FROM upgraded",
    "g4_requirements": f"WITH {FOUND} SELECT doc_id, id, class, explicit, severity, quote FROM needs",
    "g5_figures": f"WITH {FOUND} SELECT doc_id, severity, quote, value::INT AS value FROM figures",
    "g6_sponsorship": f"WITH {FOUND} SELECT doc_id, severity, quote FROM sponsors",
    "g7_eligibility": f"""WITH {FOUND}, e AS (SELECT doc_id, severity FROM needs UNION ALL SELECT doc_id, severity FROM figures UNION ALL SELECT doc_id, severity FROM sponsors)
      SELECT doc_id, CASE WHEN bool_or(severity = 'red') THEN 'RED' WHEN count(severity) > 0 THEN 'AMBER' ELSE 'GREEN' END AS verdict, count(severity) AS n_findings FROM demands LEFT JOIN e USING (doc_id) GROUP BY doc_id""",
    "g8_warnings": f"WITH {FOUND} SELECT doc_id, rule_id, severity, quote FROM warned",
    "g9_wording": f"WITH {FOUND} SELECT w.doc_id, rule_id, CASE WHEN rule_id = 'w3' AND contains(lower(quote), 'welcome') THEN 'low' ELSE severity END AS severity FROM warned w JOIN demands d USING (doc_id) WHERE NOT (rule_id = 'w3' AND contains(lower(d.text), 'audits'))",
    "g11_experience": "SELECT c_custkey, c_acctbal > 5000 OR c_mktsegment = 'BUILDING' AS skips, c_mktsegment = 'MACHINERY' AND NOT c_acctbal < 0 AS vague FROM customer",
    "g14_keywords": """WITH t AS (SELECT conv_id AS doc_id, turn, role, lower(regexp_extract(text, '([A-Za-z]+)', 1)) AS term FROM conversations), m AS (SELECT DISTINCT doc_id, term FROM t WHERE turn >= 2)
      SELECT doc_id, t.term, min(CASE WHEN role = 'user' THEN 0 ELSE 1 END)::INT AS src, CASE WHEN t.term IN ('the', 'and') THEN 'yes' WHEN t.term IN ('of', 'der') THEN 'in progress' ELSE 'no' END AS have, bool_or(m.term IS NOT NULL) AS made_it FROM t LEFT JOIN m USING (doc_id, term) WHERE t.term <> '' GROUP BY ALL""",
    "g16_fit": rf"""WITH {FOUND}, y AS (SELECT doc_id, max(value) FILTER (WHERE valid) AS required, NOT bool_or(valid) AS none_valid FROM years GROUP BY doc_id), w AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE severity = 'block') AS blocks FROM warned GROUP BY doc_id),
      f AS (SELECT doc_id, required, coalesce(none_valid, false) AS none_valid, coalesce(n, 0) AS n, coalesce(blocks, 0) > 0 AS blocked, regexp_matches(text, '(?i)\blicence\b')::INT + regexp_matches(text, '(?i)\baudits\b')::INT AS m, regexp_matches(text, '(?i)no (prior )?experience (is )?(required|needed)') AS skips, regexp_matches(text, '(?i)\b(some|relevant|previous|proven|significant|solid|strong) experience\b') AS vague FROM demands LEFT JOIN y USING (doc_id) LEFT JOIN w USING (doc_id)),
      v AS (SELECT *, CASE WHEN blocked OR skips OR required IS NULL OR required < 2 THEN NULL WHEN required >= 5 THEN 'years_reach' ELSE 'years_stretch' END AS a, CASE WHEN NOT blocked AND m >= 2 THEN 'tools' END AS b FROM f)
      SELECT doc_id, required, greatest(0, coalesce(required, 0) - 3)::INT AS years_short, n AS n_warnings, m::INT AS n_missing_tools, skips, CASE WHEN blocked THEN 'BLOCKED' WHEN a IS NOT NULL OR b IS NOT NULL THEN 'STRETCH' ELSE 'GOOD' END AS verdict, concat_ws(',', a, b) AS reasons, NOT blocked AND NOT skips AND required IS NULL AND vague AS ambiguous, NOT blocked AND none_valid AS discarded FROM v""",
    "g17_verdicts": rf"""WITH {FOUND}, e AS (SELECT doc_id, quote, CASE WHEN severity = 'red' THEN 0 ELSE 1 END AS k, 0 AS src, "at" FROM needs UNION ALL SELECT doc_id, quote, 1, 1, "at" FROM figures UNION ALL SELECT doc_id, quote, 1, 2, "at" FROM sponsors UNION ALL SELECT doc_id, quote, 1, 3, "at" FROM warned),
      o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, trim(regexp_replace(lower(quote), '[^a-z0-9+%]+', ' ', 'g')) ORDER BY k, src, "at") AS r FROM e),
      g AS (SELECT doc_id, min(k) AS k, string_agg(quote, '|' ORDER BY k, src, "at", quote) AS reasons FROM o WHERE r = 1 GROUP BY doc_id) SELECT doc_id, CASE k WHEN 0 THEN 'red' WHEN 1 THEN 'amber' ELSE 'green' END AS verdict, coalesce(reasons, '') AS reasons FROM demands LEFT JOIN g USING (doc_id)""",
    "g18_answers": """SELECT c_custkey AS doc_id, 'a month' AS notice, CASE WHEN c_mktsegment = 'BUILDING' OR c_acctbal < 0 THEN 'the advertised range' WHEN n_regionkey > 1 THEN '25' WHEN c_mktsegment = 'MACHINERY' THEN '30' ELSE 'not saved' END AS salary_answer FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "h1_provenance": """SELECT o_orderkey AS doc_id, 0 AS block_no, CASE WHEN o_orderpriority = '5-LOW' THEN 'unknown type' WHEN o_orderpriority = '1-URGENT' THEN 'missing source' ELSE 'text differs' END AS detail FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority IN ('5-LOW', '1-URGENT') OR (o_orderstatus = 'P' AND o_orderpriority <> '2-HIGH')""",
    "h5_quotes": "WITH q AS (SELECT doc_id, text, unnest([0, 1, 2]) AS block_no, unnest([upper(regexp_extract(text, '([A-Za-z]+)', 1)), source, 'the ' || lang]) AS quote FROM documents) SELECT doc_id, block_no::INT AS block_no, quote AS detail FROM q WHERE NOT contains(lower(text), lower(quote))",
    "h6_grounding": """WITH a AS (SELECT c_custkey AS doc_id, n_nationkey AS y, n_regionkey AS r, ['two', 'Seven', 'hundred', 'none'][n_nationkey % 4 + 1] AS w, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS s, string_split(n_name, ' ') AS n, regexp_extract(n_name, '[0-9]{2,}') AS d FROM customer JOIN nation ON c_nationkey = n_nationkey)
      SELECT doc_id, 0 AS block_no, y || '%' AS detail FROM a WHERE y NOT IN (r, 10, 112) UNION ALL SELECT doc_id, 0, d FROM a WHERE d <> '' UNION ALL SELECT doc_id, 0, w FROM a WHERE w IN ('Seven', 'hundred') UNION ALL SELECT doc_id, 0, s FROM a WHERE s <> 'Building'
      UNION ALL SELECT doc_id, 0, upper(left(x, 1)) || lower(substr(x, 2)) FROM (SELECT doc_id, unnest(n[2:]) AS x FROM a) UNION ALL SELECT doc_id, 0, 'profile opening' FROM a WHERE r < 2 AND NOT (y = 5 AND s = 'Building')""",
    "h8_flat": "SELECT p_partkey AS doc_id, 0 AS block_no, 'line' AS type, 'p_name' AS field, p_name AS text FROM part WHERE p_name <> '' UNION ALL SELECT p_partkey, 0, 'line', 'p_brand', p_brand FROM part WHERE p_size <= 25 AND p_brand <> ''",
    "i7_runs": """WITH a AS (SELECT o_orderkey AS doc_id, o_orderstatus AS v FROM orders WHERE o_orderpriority <> '5-LOW'), b AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderstatus = 'P' THEN 'F' ELSE o_orderstatus END AS v FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED')
      SELECT doc_id, a.v AS before, b.v AS after, coalesce(a.v = b.v, false) AS same FROM a FULL JOIN b USING (doc_id)""",
    "i9_collisions": """WITH s AS (SELECT 'type.' || p_partkey AS path, lower(p_type) AS t FROM part UNION ALL SELECT 'name.' || p_partkey, p_name FROM part) SELECT path, 'small' AS term FROM s WHERE regexp_matches(t, '\\bsmall\\b') UNION SELECT path, 'red widget' FROM s WHERE t = 'red widget' UNION SELECT path, 'promo*' FROM s WHERE regexp_matches(t, '\\bpromo')""",
    "j4_first_sentences": r"SELECT 'first_sentence' AS rule, doc_id::VARCHAR AS key, length(regexp_extract(text, '^\s*([^.!?]+[.!?]?)', 1)) AS n FROM documents WHERE NOT regexp_matches(regexp_extract(text, '^\s*([^.!?]+[.!?]?)', 1), '^[A-M]')",
    "j6_wildcards": f"WITH {WORDS}, v AS (SELECT DISTINCT w FROM words) SELECT 'short_wildcard' AS rule, w || '*' AS key, length(w)::VARCHAR AS detail FROM v WHERE length(w) % 2 = 1 AND length(w) < 6",
    "j7_own_words": "SELECT 'own_word' AS rule, p_partkey::VARCHAR AS key, p_type AS detail FROM part WHERE NOT (p_type = 'SMALL' OR (p_size > 25 AND p_type LIKE 'ECON%') OR (p_size <= 25 AND p_type = 'LARGE'))",
    "j8_highlights": """SELECT 'highlight' AS rule, p_partkey::VARCHAR AS key, 'not in text: widget' AS detail FROM part WHERE NOT contains(p_name, 'widget') UNION ALL SELECT 'highlight', p_partkey::VARCHAR, unnest(['digit: 3 sizes', 'no own tag: sizes']) FROM part""",
    "j9_single_words": r"""WITH t AS (SELECT DISTINCT CASE turn % 3 WHEN 0 THEN upper(regexp_extract(text, '([A-Za-z]+)', 1)) WHEN 1 THEN regexp_extract(text, '([A-Za-z]+)', 1) ELSE regexp_extract(text, '([A-Za-z]+ [A-Za-z]+)', 1) END AS t FROM conversations) SELECT 'single_word_tag' AS rule, t AS key, t AS detail FROM t WHERE t <> '' AND NOT regexp_matches(t, '\s') AND NOT regexp_matches(t, '^[A-Z]{2,6}$')""",
    "j10_figures": """SELECT 'figure_guard' AS rule, p_partkey::VARCHAR AS key, 'ring: required phrase missing' AS detail FROM part WHERE contains(p_name, 'ring') AND NOT contains(p_name, 'Small') AND NOT contains(p_name, 'hot')
      UNION ALL SELECT 'figure_guard', p_partkey::VARCHAR, 'ring: forbidden phrase old' FROM part WHERE contains(p_name, 'ring') AND contains(p_name, 'old') UNION ALL SELECT 'figure_guard', p_partkey::VARCHAR, 'widget: forbidden phrase red' FROM part WHERE contains(p_name, 'widget') AND contains(p_name, 'red')""",
    "j15_keys": "SELECT 'pii_key' AS rule, event_id::VARCHAR AS key, CASE WHEN event_id % 3 = 0 THEN 'salary' ELSE 'certNo' END AS detail FROM events WHERE event_id % 3 < 2",
    "a3_notes": """SELECT c_custkey, '{"list":[{"a":{"k":' || c_custkey || '},"_kept":{"k":1}}],"name":"' || c_name || '"}' AS s FROM customer""",
    "j11_shorts": "SELECT 'short_adds' AS rule, p_partkey::VARCHAR AS key, 'Deal' AS detail FROM part WHERE p_size BETWEEN 6 AND 25",
    "j13_incomplete": "SELECT 'incomplete' AS rule, o_orderkey::VARCHAR AS key, concat_ws(', ', CASE WHEN o_orderstatus = 'P' THEN 'status' END, CASE WHEN NOT o_totalprice > 100000 THEN 'price' END) AS detail FROM orders WHERE o_orderstatus = 'P' OR NOT o_totalprice > 100000",
    "j17_tokens": "SELECT 'token' AS rule, p_partkey::VARCHAR AS key, 'SMALL' AS detail FROM part WHERE p_size < 10 AND NOT contains(p_type, 'SMALL')",
    "j18_coverage": "SELECT count(*) AS n, count(*) FILTER (WHERE p_size > 10) AS n_short, count(*) FILTER (WHERE p_size > 40) AS n_saves_nothing FROM part",
    "j18_saves_nothing": "SELECT 'saves_nothing' AS rule, p_partkey::VARCHAR AS key, '1' AS detail FROM part WHERE p_size > 40",
    "j19_patterns": "SELECT 'pattern' AS rule, n_nationkey::VARCHAR AS key, '(' || n_name AS detail FROM nation WHERE n_regionkey = 0",
}

SQL["f17_auto_picks"] = BASE["f8_variants"]

# the drops one by one: x(doc_id, no, cost, g, s, type, over) -> done(doc_id, gone, over)
FOLD = """f AS (SELECT doc_id, list({'no': no, 'g': g, 's': s, 'bullet': type = 'bullet', 'cost': cost} ORDER BY no) AS l, max(over) AS over FROM x GROUP BY doc_id),
  r AS (SELECT doc_id, l, over::BIGINT AS over, []::INTEGER[] AS gone, 0 AS step FROM f
    UNION ALL SELECT doc_id, l, (over - list_sum(list_transform(o, lambda y: y.cost)))::BIGINT, list_concat(gone, list_transform(o, lambda y: y.no)), step + 1 FROM (
      SELECT *, CASE WHEN len(free) > 0 THEN [free[-1]] ELSE list_filter(alive, lambda y: y.g = c[-1].g) END AS o FROM (
        SELECT *, list_filter(c, lambda y: len(list_filter(alive, lambda z: z.bullet AND z.g = y.g)) > 1) AS free FROM (
          SELECT *, CASE WHEN len(list_filter(alive, lambda y: y.bullet AND y.s = 'filler')) > 0 THEN list_filter(alive, lambda y: y.bullet AND y.s = 'filler') ELSE list_filter(alive, lambda y: y.bullet AND y.s = 'support') END AS c FROM (
            SELECT *, list_filter(l, lambda y: NOT list_contains(gone, y.no)) AS alive FROM r WHERE over > 0 AND step < 200))) WHERE len(c) > 0)),
  done AS (SELECT doc_id, arg_max(gone, step) AS gone, greatest(0, min(over)) AS over FROM r GROUP BY doc_id)"""
BUDGET = """b AS (SELECT *, CASE WHEN no = 1 THEN 'head' ELSE 'bullet' END AS type, ['required', 'core', 'support', 'filler'][k % 4 + 1] AS s, k % 4 AS rank, CASE WHEN cost > 40 THEN 3 ELSE 0 END AS bold, cost - cost % 7 AS short, sum(cost) OVER (PARTITION BY doc_id) - 80 AS over
  FROM (SELECT l_orderkey AS doc_id, l_linenumber::INTEGER AS no, sum(l_quantity)::BIGINT AS cost, max(l_suppkey) AS k, max(l_returnflag) AS g FROM lineitem GROUP BY ALL))"""


def phase(to: str, of: str, eligible: str, saving: str, order: str, name: str) -> str:
    """Rows are marked in order while the document is over its budget; what they save is taken off."""
    return f"""{to}0 AS (SELECT *, CASE WHEN {eligible} THEN {saving} ELSE 0 END AS sv FROM {of}), {to}1 AS (SELECT *, ({eligible}) AND sv > 0 AND coalesce(sum(sv) OVER (PARTITION BY doc_id ORDER BY CASE WHEN {eligible} THEN 0 ELSE 1 END, {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < owed AS {name} FROM {to}0),
  {to} AS (SELECT * EXCLUDE (sv, owed), greatest(0, owed - sum(CASE WHEN {name} THEN sv ELSE 0 END) OVER (PARTITION BY doc_id)) AS owed FROM {to}1)"""


SQL["h12_dropped"] = f"WITH RECURSIVE {BUDGET}, x AS (SELECT * FROM b), {FOLD} SELECT doc_id, no AS block_no, list_contains(gone, no) AS dropped FROM b JOIN done USING (doc_id)"
SQL["h13_trimmed"] = f"""WITH RECURSIVE {BUDGET}, p AS (SELECT * EXCLUDE (over), greatest(0, over) AS owed FROM b), {phase("p1", "p", "bold > 0", "bold", "no DESC", "unbold")}, {phase("p2", "p1", "cost - short > 0", "cost - short", "rank DESC, cost DESC, no DESC", "shortened")},
  {phase("p3", "p2", "no = 3", "cost", "no DESC", "para_dropped")}, {phase("p4", "p3", "no = 4", "cost", "no DESC", "term_dropped")}, n AS (SELECT *, cost - CASE WHEN unbold THEN bold ELSE 0 END AS c1 FROM p4),
  x AS (SELECT doc_id, no, CASE WHEN shortened THEN least(c1, short) ELSE c1 END AS cost, g, s, type, owed AS over FROM n WHERE NOT (para_dropped OR term_dropped)), {FOLD}
  SELECT n.doc_id, n.no AS block_no, unbold, shortened, para_dropped, term_dropped, coalesce(NOT (para_dropped OR term_dropped) AND list_contains(gone, n.no), false) AS bullet_dropped, coalesce(done.over, owed)::BIGINT AS overflow_left FROM n LEFT JOIN done USING (doc_id)"""
