"""Registered queries over texts: cleaning, sections, matching, extraction, scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineloom.functions import text as T
from lineloom.operators import extract, findings, gates, lines, matching, scoring

#: Rule tables of the queries: words of the tables' own languages.
TERMS = ("the", "thing*", "of the", "der", "und", "ion*", "la", "heth*")
TAGS = (("english", "the of"), ("english", "and that"), ("german", "der und"), ("french", "les des"), ("spanish", "los del"), ("able", "thingable"), ("number", "2 0"))
PROFILES = (("en", 1, False), ("de", 2, False), ("fr", 3, False), ("es", 4, True))
PROFILE_TERMS = (
    ("en", "body", "english", 5, 0), ("en", "body", "able", 3, 1), ("de", "body", "german", 6, 0), ("fr", "body", "french", 6, 0), ("es", "body", "spanish", 6, 0),
    ("en", "title", "the", 20, 0), ("en", "title", "of", 15, 1), ("en", "title", "and", 15, 2), ("de", "title", "der", 20, 0), ("fr", "title", "la", 10, 0), ("es", "title", "el", 20, 0), ("fr", "title_exclude", "el", 0, 0),
)
VARIANTS = (("g1", "core", 0, "a1"), ("g1", "core", 1, "a2"), ("g1", "core", 2, "a3"), ("g2", "support", 0, "b1"), ("g2", "support", 1, "b2"))
VARIANT_TAGS = (("a1", "german"), ("a2", "english"), ("a2", "able"), ("a3", "french"), ("b1", "spanish"), ("b2", "french"), ("b2", "english"))
PREFERRED = (("a3", "spanish"),)
UNIT = r"([0-9]+)(?:\s*-\s*([0-9]+))?[.%]"


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs_of(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", "text")


def rule_rows(spark: SparkSession, rows, schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def b1_html_to_plain(spark, d):
    out = read(spark, d, "pages").select("page_id", T.html_to_plain("html").alias("t"))
    return out.select("page_id", F.length("t").alias("n_chars"), F.md5("t").alias("digest"))


def b2_lines(spark, d):
    rows = lines.explode_lines(docs_of(spark, d))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("text") == "").alias("n_blank"), F.sum(F.length("text")).alias("n_chars"), F.max("line_no").alias("last_line"))


def b3_junk_lines(spark, d):
    rows = lines.explode_lines(read(spark, d, "pages").select(F.col("page_id").alias("doc_id"), T.html_to_plain("html").alias("text")))
    return lines.drop_junk_lines(rows).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("text")).alias("n_chars"))


def b4_header_zone(spark, d):
    rows = lines.header_zone(lines.explode_lines(docs_of(spark, d)))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("line_no").alias("line_sum"), F.max("header_no").alias("last"))


def b5_spans(spark, d):
    rows = lines.split_spans(docs_of(spark, d))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("starts"), F.sum("end").alias("ends"), F.sum("line_no").alias("line_sum"))


def b6_quote_at(spark, d):
    spans = lines.split_spans(docs_of(spark, d))
    at = docs_of(spark, d).select("doc_id", F.floor(F.length("text") / 2).cast("int").alias("at"))
    return lines.quote_at(spans, at).select("doc_id", "at", "span_no", F.length("text").alias("n_chars"))


def b8_stems(spark, d):
    words = docs_of(spark, d).select(F.explode(T.remove_stopwords(T.tokenize("text"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    # the suffix rules run on the distinct words only
    return words.select(T.stem("w").alias("stem"), "n").groupBy("stem").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_words"))


def b11_clauses(spark, d):
    rows = lines.split_clauses(lines.split_spans(docs_of(spark, d)))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("clause")).alias("n_chars"), F.max("clause_no").alias("most"))


def b13_forms(spark, d):
    p = read(spark, d, "part")
    c = F.col("p_name")
    return p.select("p_partkey", T.unhyphenate(T.plain_dashes("p_type")).alias("opened"), T.title_case(F.lower(c)).alias("titled"), T.slug("p_brand", "p_type").alias("slug"), T.word_count(c).alias("n_words"), T.normalize(c).alias("norm"))


def b15_titles(spark, d):
    p = read(spark, d, "part").select("p_partkey", F.concat(F.lit("Title: "), F.upper("p_name"), F.lit(" (remote)")).alias("raw"), F.concat("p_brand", F.lit(" Ltd. (group)")).alias("company"))
    return p.select("p_partkey", T.tidy_title("raw").alias("title"), T.tidy_name("company").alias("company"), T.quote_form(F.concat(F.lit("1. "), F.col("raw"), F.lit("."))).alias("quote"))


def b20_templates(spark, d):
    rows = read(spark, d, "customer").select("c_custkey", F.create_map(F.lit("NAME"), "c_name", F.lit("SEGMENT"), F.lower("c_mktsegment")).alias("slots"))
    filled = rows.select("c_custkey", T.fill_template(F.lit("To {{NAME}}: news for {{SEGMENT}}, {{LATER}}"), "slots").alias("text"))
    return filled.select("c_custkey", "text", F.array_join(T.open_slots("text"), ",").alias("open"))


def b21_highlights(spark, d):
    rows = read(spark, d, "conversations").select("conv_id", "turn", "role", T.highlight("text", F.array(F.lit("the"), F.lit("and"), F.lit("of")), 2).alias("pieces"), "text")
    return rows.select("conv_id", "turn", "role", F.array_join(F.transform(F.filter("pieces", lambda x: x["bold"]), lambda x: x["text"]), "|").alias("bold"), (F.array_join(F.transform("pieces", lambda x: x["text"]), "") == F.col("text")).alias("joins_back"))


def c1_headings(spark, d):
    rows = lines.classify_headings(lines.explode_lines(docs_of(spark, d)), responsibility=("role", "ing "), requirement=("the ", "des "), other=("und",), ignored=("of ", "la "))
    return rows.groupBy("doc_id").agg(*(F.count_if(F.col("heading") == k).alias(k) for k in ("responsibility", "requirement", "other", "ignored", "unknown")))


def c2_sections(spark, d):
    rows = lines.classify_headings(lines.explode_lines(docs_of(spark, d)), responsibility=("role", "ing "), requirement=("the ", "des "), other=("und",), ignored=("of ", "la "))
    out = lines.section_state(rows)
    return out.groupBy("doc_id").agg(F.count_if(F.col("state") == "ignored").alias("n_ignored"), F.count_if(F.col("sub_type") == "requirement").alias("n_requirement"), F.count_if("known_heading").alias("n_known"))


def c3_sentences(spark, d):
    rows = lines.classify_sentences(docs_of(spark, d))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("matchable").alias("n_matchable"), F.count_if(F.col("sub_type") == "responsibility").alias("n_responsibility"))


def c4_matchable_text(spark, d):
    out = lines.matchable_text(lines.classify_sentences(docs_of(spark, d)))
    return out.select("doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def c5_unclassified(spark, d):
    return lines.unclassified_headings(docs_of(spark, d)).select("doc_id", F.size("unclassified").alias("n"), F.md5(F.array_join("unclassified", "\n")).alias("digest"), "headings_found")


def c6_requirement_sections(spark, d):
    rows = lines.requirement_sections(docs_of(spark, d), included=("the",), ignored=("of", "und"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("state") == "ignored").alias("n_ignored"), F.count_if("requirement").alias("n_requirement"))


def d1_terms(spark, d):
    found = matching.match_terms(docs_of(spark, d), rule_rows(spark, [(t,) for t in TERMS], "term string"))
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("doc_id").alias("id_sum"))


def d3_hits(spark, d):
    return docs_of(spark, d).select("doc_id", matching.count_hits("text", F.lit("the")).alias("n_the"), matching.count_hits("text", F.lit("on*")).alias("n_on"))


def d4_stem_pairs(spark, d):
    words = read(spark, d, "benchmark").select(F.explode(F.transform(T.tokenize("text"), T.stem)).alias("a")).distinct()
    return matching.stem_pairs(words, words.withColumnRenamed("a", "b")).groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("first"), F.max("b").alias("last"))


def sentences_of(spark, d) -> DataFrame:
    return lines.split_spans(docs_of(spark, d)).withColumn("matchable", F.lit(True)).withColumn("sub_type", F.lit("responsibility"))


def d5_tags(spark, d):
    found = matching.match_tags(sentences_of(spark, d), rule_rows(spark, TAGS, "tag string, phrase string"))
    return found.groupBy("tag").agg(F.count(F.lit(1)).alias("n_spans"), F.count_distinct("doc_id").alias("n_docs"), F.sum("span_no").alias("span_sum"))


def hits_of(spark, d) -> DataFrame:
    """D8 for the scoring queries: tags hit by a matchable sentence."""
    return matching.keyword_hits(lines.matchable_sentences(docs_of(spark, d)), rule_rows(spark, TAGS, "tag string, phrase string"))


def d9_tag_universe(spark, d):
    p = read(spark, d, "part")
    return matching.tag_universe([p.select(F.col("p_partkey").alias("pos"), F.upper("p_type").alias("tag")), p.select(F.col("p_partkey").alias("pos"), F.lower("p_type").alias("tag")), p.select(F.col("p_partkey").alias("pos"), F.col("p_brand").alias("tag"))]).select("src", "pos", "tag")


def d11_tools(spark, d):
    out = matching.tools_mentioned(docs_of(spark, d), rule_rows(spark, [("the",), ("der",)], "term string"), rule_rows(spark, [("la",), ("of",)], "term string"))
    return out.select("doc_id", F.array_join("have", ",").alias("have"), F.array_join("confirmed_missing", ",").alias("missing"))


GAZETTEER = (("the", "The", "a"), ("the of", "Theof", "b"), ("of", "Of", "b"), ("und", "Und", "c"), ("der", "Der", "c"), ("la", "La", "d"))


def d12_places(spark, d):
    out = matching.places_in(docs_of(spark, d), rule_rows(spark, GAZETTEER, "name string, canonical string, area string"))
    return out.select("doc_id", F.array_join("places", ",").alias("places"))


def d13_first_matches(spark, d):
    out = matching.first_accepted_match(sentences_of(spark, d), [("r1", "the [a-z]+ing"), ("r2", "^d"), ("r3", "[0-9]")])
    return out.select("doc_id", "rule_id", "start", F.length("quote").alias("n_chars"))


def d14_verbatim(spark, d):
    t = docs_of(spark, d)
    quotes = read(spark, d, "labels").select("doc_id").crossJoin(F.broadcast(read(spark, d, "region").select(F.lower("r_name").alias("quote")).unionByName(rule_rows(spark, [("the",), ("der",)], "quote string"))))  # seven rows
    out = matching.contains_verbatim(t, quotes)
    return out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("verbatim").alias("n_verbatim"))


def d12_mentions(spark, d):
    out = matching.place_mentions(docs_of(spark, d), rule_rows(spark, GAZETTEER, "name string, canonical string, area string"))
    return out.select("doc_id", "no", "start", "end", "canonical")


def d14_quotes(spark, d):
    b = read(spark, d, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    return matching.find_quotes(docs_of(spark, d), b)


def d14_phrases(spark, d):
    """Beginnings of the benchmark's texts: some words, few words, a word and a part of a word."""
    b = read(spark, d, "benchmark")
    part = lambda n, cut: F.substring(F.substring_index("text", " ", n), cut, 10000)
    quotes = [b.select((F.col("item_id") * 10 + k).alias("quote_id"), part(n, cut).alias("quote")) for k, (n, cut) in enumerate(((12, 2), (10, 1), (5, 2), (3, 1), (2, 2), (1, 1), (1, 2)))]
    every = quotes[0]
    for q in quotes[1:]:
        every = every.unionByName(q)
    return matching.find_quotes(docs_of(spark, d), every).groupBy("quote_id").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("at").alias("at_sum"))


def e1_numbers(spark, d):
    out = extract.number_candidates(sentences_of(spark, d), UNIT, "version", 15)
    return out.select("doc_id", "span_no", "no", "value", "has_context", "valid")


def e2_required(spark, d):
    c = extract.number_candidates(sentences_of(spark, d), UNIT, "version", 15)
    return extract.number_required(docs_of(spark, d), c)


def e3_labels(spark, d):
    rows = read(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("line_no"), F.concat("role", F.lit(": "), F.translate("text", "\n", " ")).alias("text"))
    out = extract.labelled_values(rows, ("user",))
    return out.select("doc_id", "line_no", F.length("value").alias("n_chars"))


def e13_salary(spark, d):
    return read(spark, d, "documents").select("doc_id", extract.states_salary("text").alias("salary"), extract.outside_region("source", ("src1", "src2")).alias("outside"))


def f1_scores(spark, d):
    p = rule_rows(spark, PROFILE_TERMS, "profile_id string, kind string, term string, weight int, term_no int")
    return scoring.score_profiles(docs_of(spark, d), hits_of(spark, d), p)


def ranked_of(spark, d) -> DataFrame:
    docs = docs_of(spark, d)
    p = rule_rows(spark, PROFILE_TERMS, "profile_id string, kind string, term string, weight int, term_no int")
    titles = scoring.score_titles(read(spark, d, "documents").select("doc_id", scoring.title_text("source", F.substring_index("text", "\n", 1)).alias("title")), p)
    profiles = rule_rows(spark, PROFILES, "profile_id string, priority int, title_required boolean")
    return scoring.rank_profiles(scoring.score_profiles(docs, hits_of(spark, d), p), titles, profiles)


def f3_ranks(spark, d):
    return ranked_of(spark, d)


def f4_picks(spark, d):
    return scoring.pick_profile(docs_of(spark, d), ranked_of(spark, d), "en")


def f8_variants(spark, d):
    v = rule_rows(spark, VARIANTS, "group_id string, strength string, variant_no int, variant_id string")
    return scoring.pick_variant(docs_of(spark, d), v, rule_rows(spark, VARIANT_TAGS, "variant_id string, tag string"), hits_of(spark, d), rule_rows(spark, PREFERRED, "variant_id string, tag string"))


def f18_strengths(spark, d):
    p = read(spark, d, "part")
    v = p.select(F.col("p_partkey").alias("variant_id"), F.element_at(F.array(*map(F.lit, scoring.STRENGTHS)), (F.col("p_size") % 4 + 1).cast("int")).alias("strength"))
    return scoring.tag_strength(v, p.select(F.col("p_partkey").alias("variant_id"), F.col("p_type").alias("tag")))


def f21_close_match(spark, d):
    s = sentences_of(spark, d)
    return scoring.close_match(s, s.filter(F.col("text").rlike("(?i)th")).select("doc_id", "span_no"))


def f24_rotation(spark, d):
    items = F.array(*(F.lit(x) for x in ("a", "b", "c", "d", "e", "f", "g")))
    return read(spark, d, "customer").select("c_custkey", T.hash31(F.lower("c_name")).alias("hash"), scoring.rotate(items, "c_name").alias("item"))


def g1_clauses(spark, d):
    s = lines.split_clauses(sentences_of(spark, d)).withColumn("requirement", F.col("span_no") % 2 == 0)
    out = findings.clause_class(s)
    return out.groupBy("class", "explicit").agg(F.count(F.lit(1)).alias("n"))


def blocks_of(spark, d) -> DataFrame:
    return lines.explode_lines(docs_of(spark, d)).select("doc_id", F.col("line_no").alias("block_no"), F.lit("para").alias("type"), "text")


def h3_banned(spark, d):
    out = gates.banned_terms(blocks_of(spark, d), rule_rows(spark, [("idiot",), ("password",), ("apache license",)], "term string"))
    return out.groupBy("doc_id", "detail").agg(F.count(F.lit(1)).alias("n"), F.min("block_no").alias("first_block"))


def h4_dashes(spark, d):
    rows = blocks_of(spark, d).withColumn("text", F.translate("text", "|%", "–—"))
    return gates.dash_scan(rows).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("at").alias("at_sum"), F.sum(F.length("context")).alias("n_chars"))


def h7_gates(spark, d):
    b = blocks_of(spark, d)
    found = [gates.smoke_scan(b), gates.require_block(docs_of(spark, d), b.filter("block_no = 2"), "para")]
    return gates.run_gates(docs_of(spark, d), found, ("smoke", "required")).select("doc_id", "gate", "passed", "n_findings", "all_passed")


def h9_smoke(spark, d):
    return gates.smoke_scan(blocks_of(spark, d)).groupBy("detail").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"))


QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and k[0] in "abcdefgh" and k[1].isdigit()}
