"""Registered queries over texts and rows derived from the tables: fields, choices, findings, gates, rule tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineloom.functions import text as T
from lineloom.operators import changes, extract, findings, gates, lines, matching, quality, scoring, sections
from lineloom.plans.text_queries import PREFERRED, TAGS, UNIT, VARIANT_TAGS, VARIANTS, docs_of, hits_of, read, rule_rows
from lineloom.sources import documents, publish

#: Documents of a form that each customer gets by its market segment: {n} its name, {p} its nation's place.
ADS = {
    "AUTOMOBILE": "Job Title: Senior Risk Analyst (Hybrid)\nCompany: {n} Ltd\nLocation: TownD or {p}\n\nAbout the role\nYou join the Credit Risk team at work. You report daily.\nPlease contact Mary Byrne for details.",
    "BUILDING": "Site Engineer\n{n}\n{p}\n\nOverview\nYou will plan sites. {n} is a builder.\nRecruiter: Tom Smith",
    "FURNITURE": "About us at a glance\n\nJob description\nHere we are looking for a Product Designer to help. Join {n} and grow.\n{n} is a maker of chairs. The workshop is based in {p}.\nMeet the hiring team\nAnn Lee • Talent partner",
    "MACHINERY": "Machine Operator, {p}\nremote\n\nThe role\nThe firm is headquartered in {p}. Work is quiet.\nLocation: remote",
    "HOUSEHOLD": "About the shop\n\nDescription\nWe sell in {p} and in TownD.\nWe thank the Shop Floor team lead. Just call Monday Morning.",
}
#: Sentences that follow each document's own text, one of every list by the document's number; {y}, {a} and {b} are numbers. The
#: lists' lengths have no common factor, so that all their combinations come up.
DEMANDS = (
    ("An accounting degree is required, with audits.", "Accounting degree holders welcome.", "A degree in accounting is preferred, and must be recent.", "Bring an accounting degree, desirable but late.", "Degrees and accounts matter.", "", "Accounting is a plus."),
    ("A driving licence is preferred.", "You must hold a driving licence; a car is a plus.", "Accounting degrees are essential.", "", "Driving licences, nice to have."),
    ("Do you need sponsorship now or in the future?", "Now or in the future, will you want sponsorship?", "Sponsorship is offered."),
    ("We follow the minimum competency code.", "It is a controlled function.", "Come along.", "", "No experience is needed.", "Some experience helps.", "Audits come twice.", "Solid experience counts, degree or none."),
    ("At least {y} years experience is needed here.", "Bring {a}-{b} years in sales.", "The firm is {y} years old.", "{y}+ yrs PQE; {a} years experience of audits.", "Many years experience helps.", "", "Work {a} years. Work {a} years.", "{b} years experience, {a} years in sales.", "The years go by.", "{a} to {b} years.", "No years experience."),
)
ITEMS = (("degree", "accounting degree", "not_held", True), ("licence", "driving licence", "unknown", False), ("along", "come along", "held", False))
WARNINGS = [
    {"id": "w1", "pattern": "years experience", "severity": "stretch", "needs_years": True},
    {"id": "w2", "pattern": "sponsorship", "severity": "block"},
    {"id": "w3", "pattern": "degree", "severity": "note"},
]
WORDING = {"w3": {"held": "audits", "hedge": "welcome", "hedged": "low"}}


def place():
    """A place's name for each nation."""
    return F.concat(F.lit("Town"), F.char(F.col("n_nationkey") + 65))


def _shaped(spark, d, forms: dict[str, str]):
    # customers are few bytes and much work each: by their files they would be few tasks
    c = read(spark, d, "customer").repartition(4 * spark.sparkContext.defaultParallelism, "c_custkey").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    form = F.coalesce(*(F.when(F.col("c_mktsegment") == k, F.lit(v)) for k, v in forms.items()))
    for slot, value in (("{n}", F.replace("c_name", F.lit("#"), F.lit(""))), ("{p}", place())):
        form = F.replace(form, F.lit(slot), value)
    return c.select(F.col("c_custkey").alias("doc_id"), form.alias("text"))


def ads_of(spark, d):
    return _shaped(spark, d, ADS)


def demands_of(spark, d):
    """The documents' whole texts, each followed by demands of its own."""
    chosen = F.array_join(F.array(*(F.element_at(F.array(*map(F.lit, x)), (F.pmod("doc_id", F.lit(len(x))) + 1).cast("int")) for x in DEMANDS)), " ")
    for slot, value in (("{y}", F.pmod("doc_id", F.lit(23))), ("{a}", F.pmod("doc_id", F.lit(19)) + 1), ("{b}", F.pmod("doc_id", F.lit(13)) + 5)):
        chosen = F.replace(chosen, F.lit(slot), value.cast("string"))
    return read(spark, d, "documents").select("doc_id", F.concat("text", F.lit("\n"), chosen).alias("text"))


def gazetteer_of(spark, d):
    area = F.when(F.col("n_regionkey") == 0, "dublin").when(F.col("n_regionkey") == 1, "cork").when(F.col("n_regionkey") == 2, "east")
    return read(spark, d, "nation").select(place().alias("name"), F.concat_ws("/", place(), "n_regionkey").alias("canonical"), area.alias("area"))


def placed(spark, d):
    return matching.with_places(ads_of(spark, d), gazetteer_of(spark, d))


def a1_documents(spark, d):
    return documents.read_documents(spark, f"{d}/documents.parquet", "parquet").select("doc_id", F.length("text").alias("n"))


def d8_keyword_hits(spark, d):
    return hits_of(spark, d).select("doc_id", "tag")


def d10_demands(spark, d):
    t = lines.matchable_text(lines.classify_sentences(docs_of(spark, d)))
    out = matching.qualification_demands(t, rule_rows(spark, [("the",), ("der",), ("thing*",)], "term string"))
    return out.select("doc_id", F.array_join("demands", ",").alias("demands"))


def e4_roles(spark, d):
    return extract.extract_role(placed(spark, d)).select("doc_id", "value", "how")


def e5_companies(spark, d):
    return extract.extract_company(placed(spark, d)).select("doc_id", "value", "how", "score")


def e6_links(spark, d):
    host = F.when(F.col("c_mktsegment") == "MACHINERY", "linkedin").when(F.col("c_mktsegment") == "BUILDING", "axa").otherwise(F.replace(F.lower("c_name"), F.lit("#"), F.lit("-")))
    return read(spark, d, "customer").select("c_custkey", extract.company_from_link(F.concat(F.lit("see https://careers."), host, F.lit(".com/apply"))).alias("company"))


def e7_cities(spark, d):
    out = extract.extract_city(placed(spark, d))
    return out.select("doc_id", "city", "how", "note")


def e8_mentions(spark, d):
    out = extract.cities_mentioned(placed(spark, d))
    return out.filter("size(places) > 0").select("doc_id", F.array_join("places", ",").alias("places"))


def e9_locations(spark, d):
    rows = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = matching.with_places(rows.select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("TownD, "), place()).alias("text")), gazetteer_of(spark, d))
    rule = extract.location_rule(matching.all_places("text"))
    return rows.select(F.col("doc_id").alias("c_custkey"), rule.alias("r")).select("c_custkey", "r.kind", "r.place")


def e10_teams(spark, d):
    return extract.extract_team(ads_of(spark, d)).select("doc_id", "value", "how")


def e11_recipients(spark, d):
    return extract.extract_recipient(ads_of(spark, d)).select("doc_id", "value", "how")


def e12_fields(spark, d):
    out = extract.extract_all(ads_of(spark, d), gazetteer_of(spark, d))
    return out.select("doc_id", *(F.col(f"{k}.value").alias(k) for k in ("role", "company", "city", "team", "recipient")), "note")


def e15_missing(spark, d):
    c = read(spark, d, "customer")
    rows = c.select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("role"), F.when(F.col("c_acctbal") > 3000, "Acme").otherwise(" ").alias("company"), F.lit(None).cast("string").alias("typed_role"), F.when(F.col("c_mktsegment") == "BUILDING", "B").alias("typed_company"))
    return rows.select("c_custkey", F.array_join(extract.missing_fields(("role", "company")), ",").alias("missing"))


def f5_top_terms(spark, d):
    l = read(spark, d, "lineitem")  # noqa: E741
    found = l.select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("profile_id"), F.when(F.col("l_linestatus") == "O", "title").otherwise("body").alias("kind"), F.concat(F.lit("t"), F.col("l_linenumber")).alias("term"), F.col("l_quantity").cast("int").alias("weight"), F.col("l_linenumber").alias("term_no"))
    found = found.groupBy("doc_id", "profile_id", "kind", "term", "term_no").agg(F.max("weight").alias("weight"))
    return scoring.top_terms(found).select("doc_id", "profile_id", F.array_join("terms", ",").alias("terms"))


def f9_clean(spark, d):
    v = read(spark, d, "part").select(F.col("p_partkey").alias("variant_id"), F.col("p_brand").alias("group_id"), F.col("p_type").alias("text"))
    return scoring.clean_variants(v, rule_rows(spark, [("small",), ("promo*",), ("econ*",)], "term string")).select("variant_id", "group_id")


def f10_sorted(spark, d):
    return scoring.stable_sort_desc(read(spark, d, "part").select("p_partkey", "p_size"), "p_size", "p_partkey")


def f11_in_order(spark, d):
    ids = read(spark, d, "orders").select(F.col("o_orderkey").alias("owner"), F.array(F.col("o_custkey"), F.lit(-1).cast("long"), F.lit(1).cast("long")).alias("fact_ids"))
    facts = read(spark, d, "customer").select(F.col("c_custkey").alias("fact_id"), F.col("c_name").alias("fact"))
    return scoring.select_in_order(ids, facts).select("owner", "pos", "fact")


def f13_blocks(spark, d):
    o, l = read(spark, d, "orders"), read(spark, d, "lineitem")  # noqa: E741
    sections = o.select(F.col("o_orderkey").alias("doc_id"), F.inline(F.array(F.struct(F.lit(0).alias("pos"), F.lit("open").alias("type"), F.lit(None).cast("string").alias("heading")), F.struct(F.lit(1).alias("pos"), F.lit("items").alias("type"), F.lit("Items").alias("heading")), F.struct(F.lit(2).alias("pos"), F.lit("extra").alias("type"), F.lit("Extra").alias("heading")))))
    part = lambda df, kind, key, item, text: df.select(F.col(key).alias("doc_id"), F.lit(kind).alias("section_type"), item.alias("item_pos"), F.lit(0).alias("field_pos"), text.alias("text"))
    opened = part(o, "open", "o_orderkey", F.lit(0), F.col("o_orderstatus"))
    items = part(l.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("f")), "items", "l_orderkey", F.col("l_linenumber"), F.col("f"))
    extra = part(o.filter("o_orderpriority = '1-URGENT'"), "extra", "o_orderkey", F.lit(0), F.lit("now"))
    return scoring.assemble_blocks(sections, [opened, items, extra]).select("doc_id", "block_no", "type", "text")


def _facts(spark, d):
    """Orders as roles, projects and education, nations as certificates, regions as volunteering."""
    o, n, r = (read(spark, d, t) for t in ("orders", "nation", "region"))
    text = lambda: F.lit(None).cast("string")
    kind = F.when(F.col("o_orderstatus") == "O", "role").when(F.col("o_orderstatus") == "P", "project").otherwise("education")
    of_orders = o.select(F.concat(F.lit("o"), "o_orderkey").alias("fact_id"), kind.alias("kind"), F.col("o_orderpriority").alias("title"), F.when(F.col("o_totalprice") > 50000, "large").alias("org"), F.concat(F.lit("no "), "o_orderkey").alias("aside"), F.date_format("o_orderdate", "yyyy-MM").alias("dates"), text().alias("body"), F.split("o_orderpriority", "-").alias("items"), (F.col("o_orderpriority") < "3").alias("relevant"), F.col("o_orderdate").cast("date").alias("start_date"))
    rest = lambda df, key, name, kind, body, items: df.select(F.concat(F.lit(key), name).alias("fact_id"), F.lit(kind).alias("kind"), text().alias("title"), text().alias("org"), text().alias("aside"), text().alias("dates"), body.alias("body"), items.alias("items"), F.lit(None).cast("boolean").alias("relevant"), F.lit(None).cast("date").alias("start_date"))
    certs = rest(n, "n", "n_nationkey", "certification", F.concat(F.lit("Region "), "n_regionkey"), F.array("n_name", F.lit(None), F.col("n_regionkey").cast("string")))
    return of_orders.unionByName(certs).unionByName(rest(r, "r", "r_regionkey", "volunteering", F.col("r_name"), F.array().cast("array<string>")))


def _profile_sections(spark, d):
    """A customer's sections; builders have education first."""
    first = F.when(F.col("c_mktsegment") == "BUILDING", 0).otherwise(5)
    rows = [("profile", F.lit(1), None), ("skills", F.lit(2), "SKILLS"), ("experience", F.lit(3), "EXPERIENCE"), ("project", F.lit(4), "PROJECTS"), ("education", first, "EDUCATION"), ("certifications", F.lit(6), "MORE")]
    return read(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.inline(F.array(*(F.struct(at.alias("pos"), F.lit(t).alias("type"), F.lit(h).cast("string").alias("heading"), F.lit("sections").alias("source_id")) for t, at, h in rows))))


def _section_parts(spark, d):
    c, o, n = (read(spark, d, t) for t in ("customer", "orders", "nation"))
    facts = _facts(spark, d)
    home = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("doc_id"), F.inline(F.array(F.struct(F.lit(0).cast("long").alias("pos"), F.concat(F.lit("n"), "n_nationkey").alias("fact_id")), F.struct(F.lit(1).cast("long").alias("pos"), F.concat(F.lit("r"), "n_regionkey").alias("fact_id")))))
    includes = o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("pos"), F.concat(F.lit("o"), "o_orderkey").alias("fact_id")).unionByName(home)
    # by the order, as the join with the orders needs them
    items = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity").repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("f"), F.max("l_quantity").cast("int").alias("q"))
    bullets = items.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("doc_id"), F.concat(F.lit("o"), "o_orderkey").alias("fact_id"), F.col("l_linenumber").alias("bullet_pos"), F.concat_ws("-", F.lit("l"), "l_orderkey", "l_linenumber").alias("variant_id"), F.concat_ws(" ", "f", "q").alias("text"))
    terms = o.groupBy(F.col("o_custkey").alias("doc_id"), F.col("o_orderstatus").alias("category"), F.col("o_orderpriority").alias("term")).agg(F.max("o_orderkey").alias("k"))
    terms = terms.select("doc_id", "category", F.concat(F.lit("Status "), "category").alias("label"), F.ascii("category").alias("category_pos"), F.concat(F.lit("t"), "term").alias("term_id"), "term", (-F.ascii("term")).alias("term_pos"), (F.col("term") < "3").alias("hit"), (F.col("term") == "5-LOW").alias("added"))
    chosen = c.select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("c"), "c_custkey").alias("variant_id"), F.col("c_mktsegment").alias("text"))
    parts = [sections.profile_blocks(chosen), sections.skill_blocks(terms), sections.fact_blocks(includes, facts, bullets)]
    own = lambda df, key, field, text: df.select(F.col(key).alias("source_id"), F.lit(field).alias("source_field"), F.col(text).alias("text"))
    sources = [sections.fact_sources(facts), sections.heading_sources(_profile_sections(spark, d)), own(chosen, "variant_id", "text", "text"), own(bullets, "variant_id", "text", "text"), own(terms, "term_id", "term", "term").distinct(), own(terms, "category", "label", "label").distinct()]
    every = sources[0]
    for s in sources[1:]:
        every = every.unionByName(s)
    return parts, every


def f13_sections(spark, d):
    """Each customer's document from its orders, their lines, its nation and region."""
    return sections.assemble_sections(_profile_sections(spark, d), _section_parts(spark, d)[0]).select("doc_id", "block_no", "section_type", "type", "text")


def h1_sections(spark, d):
    """f13_sections checked against the facts it was made of; the profile of a customer in debt was changed since."""
    parts, sources = _section_parts(spark, d)
    debt = read(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("doc_id"), F.lit(True).alias("debt"))
    blocks = sections.assemble_sections(_profile_sections(spark, d), parts).join(debt, "doc_id", "left")
    blocks = blocks.withColumn("text", F.when(F.col("debt") & (F.col("section_type") == "profile"), F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return gates.check_carried(blocks, sources, sections.BLOCK_TYPES).select("doc_id", "detail")


def f14_skills(spark, d):
    l = read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("f"), F.max("l_quantity").alias("q"))  # noqa: E741
    terms = l.select(F.col("l_orderkey").alias("doc_id"), F.col("f").alias("category"), F.concat(F.lit("t"), F.col("l_linenumber")).alias("term"), F.when(F.col("q") > 25, "much").otherwise("little").alias("tag"), F.col("l_linenumber").alias("pos"), (F.col("l_linenumber") == 1).alias("added"))
    hits = read(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderstatus") == "O", "much").otherwise("little").alias("tag"))
    return scoring.order_skill_terms(terms, hits).select("doc_id", "category", "line")


def f15_to_add(spark, d):
    c = read(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), "role", "text")
    asks = rule_rows(spark, [("the", "The"), ("of", "Of"), ("und", "Und"), ("thing*", "Things")], "word string, term string")
    return scoring.terms_to_add(c.filter("role = 'user'").select("doc_id", "text"), c.filter("role <> 'user'"), asks).select("doc_id", "word", "term").distinct()


def f16_gaps(spark, d):
    out = scoring.term_gaps(docs_of(spark, d), rule_rows(spark, [("the", "A"), ("der", "B"), ("thing*", "C")], "word string, label string"))
    return out.select("doc_id", F.array_join("gaps", ",").alias("gaps"))


def f17_auto_picks(spark, d):
    v = rule_rows(spark, VARIANTS, "group_id string, strength string, variant_no int, variant_id string")
    return scoring.auto_picks(docs_of(spark, d), v, rule_rows(spark, VARIANT_TAGS, "variant_id string, tag string"), hits_of(spark, d), rule_rows(spark, PREFERRED, "variant_id string, tag string"))


def quotes_of(spark, d):
    s = lines.classify_sentences(docs_of(spark, d))
    hits = matching.match_tags(s, rule_rows(spark, TAGS, "tag string, phrase string"))
    strength = rule_rows(spark, [("english", 2), ("german", 1), ("french", 3), ("able", 4)], "tag string, strength int")
    numbers = extract.number_candidates(s, UNIT, "version", 15)
    return scoring.quote_candidates(s, hits, strength, rule_rows(spark, [("idiot",), ("licensed",)], "term string"), numbers=numbers, held_years=2)


def f19_quotes(spark, d):
    return quotes_of(spark, d).select("doc_id", "span_no", "quote", "strength", "rank")


def f20_auto_quote(spark, d):
    return scoring.auto_quote(quotes_of(spark, d), ("to", "und", "di", "plac", "a")).select("doc_id", "quote", "cost")


def f22_for_profile(spark, d):
    v = read(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 40, F.array(F.lit("*"))).otherwise(F.split("p_type", " ")).alias("profiles"))
    return scoring.for_profile(v, F.lit("SMALL")).select("p_partkey")


def f23_eligible(spark, d):
    v = rule_rows(spark, VARIANTS, "group_id string, strength string, variant_no int, variant_id string")
    return scoring.requires_tags(v, rule_rows(spark, [("a1", "german"), ("a2", "able"), ("a2", "english")], "variant_id string, tag string"), hits_of(spark, d)).select("doc_id", "variant_id").distinct()


def f25_markers(spark, d):
    marked = scoring.fact_markers("text")
    return read(spark, d, "documents").select("doc_id", F.array_join(F.transform(marked, lambda x: x.cast("string")), ",").alias("marks"), scoring.shares_fact("text", F.lit("a project of 3 days")).alias("shares"))


def evidence_rows(spark, d):
    # lines are dealt out by order once, for their numbers and for all that is done by order
    l = read(spark, d, "lineitem").repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("family"), F.max("l_quantity").cast("int").alias("q"), F.max("l_linestatus").alias("s"))  # noqa: E741
    text = F.when(F.col("q") > 35, "plain words").when(F.col("s") == "O", "a project").otherwise("saved 9 hours")
    return l.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("string").alias("variant_id"), F.col("l_linenumber").alias("pos"), "family", text.alias("text"), (F.col("q") - 20).alias("overlap"), (F.col("q") <= 30).alias("lead"))


def f26_evidence(spark, d):
    return scoring.pick_evidence(evidence_rows(spark, d)).select("doc_id", F.array_join("evidence", ",").alias("evidence"))


def f27_why(spark, d):
    c = evidence_rows(spark, d).withColumn("overlap", F.lit(1)).withColumn("key", F.col("doc_id").cast("string"))
    told = read(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderstatus") == "O", "my project").otherwise("no facts").alias("text"))
    return scoring.pick_why(c, told).select("doc_id", "variant_id")


def f28_gaps(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderpriority") == "1-URGENT").alias("mismatch"), F.when(F.col("o_orderstatus") == "F", 2).otherwise(0).alias("years_short"))
    found = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("rule_id"), F.ascii("l_returnflag").alias("rule_no"))
    return scoring.gap_choice(o, found, {"N": "new", "R": "returned"}).select("doc_id", "gap")


def f29_letters(spark, d):
    c = read(spark, d, "customer")
    rows = [("close", 0, "Yours"), ("opening", 0, "Dear {{NAME}},"), ("requirement_gap", 0, "g1 {{SEGMENT}}"), ("requirement_gap", 1, "g2"), ("requirement_gap", 2, "g3"), ("quote", 0, "{{EMPTY}}"), ("other", 0, "never")]
    parts = c.select(F.col("c_custkey").alias("doc_id"), F.inline(F.array(*(F.struct(F.lit(a).alias("part"), F.lit(b).alias("pos"), F.lit(t).alias("template")) for a, b, t in rows))))
    slots = c.select(F.col("c_custkey").alias("doc_id"), F.create_map(F.lit("NAME"), "c_name", F.lit("SEGMENT"), F.lower("c_mktsegment"), F.lit("EMPTY"), F.lit("")).alias("slots"))
    return scoring.assemble_letter(parts, slots)


def f29_composed(spark, d):
    """Each order's letter from its lines: evidence, a reason, a gap that these don't name, and two fixed parts."""
    o, e = read(spark, d, "orders"), evidence_rows(spark, d)
    docs = o.select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderpriority") == "1-URGENT").alias("mismatch"), F.when(F.col("o_orderstatus") == "F", 2).otherwise(0).alias("years_short"))
    found = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("rule_id"), F.ascii("l_returnflag").alias("rule_no"))
    why = e.withColumn("overlap", F.lit(1)).withColumn("key", F.col("doc_id").cast("string"))
    gaps = rule_rows(spark, [("mismatch", "It is urgent."), ("years", "Years are short."), ("new", "Nothing is old."), ("returned", "Some came back.")], "gap string, template string")
    named = rule_rows(spark, [("new", "project"), ("returned", "hours"), ("years", "plain words")], "gap string, term string")
    fixed = o.select(F.col("o_orderkey").alias("doc_id"), F.inline(F.array(F.struct(F.lit("close").alias("part"), F.lit(0).alias("pos"), F.lit("Yours").alias("template")), F.struct(F.lit("opening").alias("part"), F.lit(0).alias("pos"), F.lit("For {{PRIORITY}}:").alias("template")))))
    slots = o.select(F.col("o_orderkey").alias("doc_id"), F.create_map(F.lit("PRIORITY"), "o_orderpriority").alias("slots"))
    return scoring.compose_letter(docs, e, why, found, {"N": "new", "R": "returned"}, gaps, named, fixed, slots)


def g2_sentences(spark, d):
    s = lines.split_spans(docs_of(spark, d)).withColumn("class", findings.sentence_class("text", F.col("text").rlike("^[A-M]")))
    return s.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"))


def g3_upgrades(spark, d):
    return findings.regulatory_upgrade(demands_of(spark, d))


def found_of(spark, d):
    """Documents, sentences and the four kinds of findings. The sentences are written once: every finding reads them."""
    docs, at = demands_of(spark, d), publish.fresh_folder(spark, "sentences")
    made = lines.classify_sentences(docs).select("doc_id", "span_no", "start", "text", "matchable")
    made.write.parquet(at)
    s = spark.read.schema(made.schema).parquet(at)
    items = rule_rows(spark, ITEMS, "item_id string, phrase string, held string, qualification boolean")
    needs = findings.requirement_findings(docs, s.withColumn("requirement", F.lit(False)), items)
    return docs, s, needs, findings.number_findings(s), findings.future_sponsorship(s), findings.warning_findings(s, WARNINGS, extract.number_candidates(s))


def g4_requirements(spark, d):
    return found_of(spark, d)[2].select("doc_id", "id", "class", "explicit", "severity", "quote")


def g5_figures(spark, d):
    return found_of(spark, d)[3].select("doc_id", "severity", "quote", "value")


def g6_sponsorship(spark, d):
    return found_of(spark, d)[4].select("doc_id", "severity", "quote")


def g7_eligibility(spark, d):
    docs, _, needs, figures, sponsors, _ = found_of(spark, d)
    return findings.eligibility(docs, [needs, figures, sponsors])


def g8_warnings(spark, d):
    return found_of(spark, d)[5].select("doc_id", "rule_id", "severity", "quote")


def g9_wording(spark, d):
    found = found_of(spark, d)
    return findings.severity_by_wording(found[5], found[0], WORDING).select("doc_id", "rule_id", "severity")


def g11_experience(spark, d):
    text = F.when(F.col("c_mktsegment") == "BUILDING", "No experience required.").when(F.col("c_mktsegment") == "MACHINERY", "Some relevant experience.").otherwise("Come.")
    profile = F.when(F.col("c_acctbal") > 5000, "graduate").otherwise("senior")
    years = F.when(F.col("c_acctbal") < 0, F.lit(3))
    return read(spark, d, "customer").select("c_custkey", findings.skip_experience(profile, text).alias("skips"), findings.ambiguous_experience(text, years).alias("vague"))


def g14_keywords(spark, d):
    """The first word of each turn: users' words, then the others'; turns from the third on count as made."""
    t = read(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", "role", F.regexp_extract("text", "([A-Za-z]+)", 1).alias("term")).filter("term <> ''")
    held = rule_rows(spark, [("The", "yes"), ("of", "in progress"), ("and", "yes"), ("DER", "in progress")], "term string, have string")
    return findings.keyword_table([t.filter("role = 'user'").select("doc_id", "term"), t.filter("role <> 'user'").select("doc_id", "term")], held, t.filter("turn >= 2").select("doc_id", "term"))


def g16_fit(spark, d):
    docs, s, _, _, _, warned = found_of(spark, d)
    tools = matching.tools_mentioned(docs, rule_rows(spark, [("degree",)], "term string"), rule_rows(spark, [("licence",), ("audits",)], "term string"))
    out = findings.fit_check(docs, warned, extract.number_required(docs, extract.number_candidates(s)), tools, 3)
    return out.select("doc_id", "required", "years_short", "n_warnings", "n_missing_tools", "skips", "verdict", F.array_join("reasons", ",").alias("reasons"), "ambiguous", "discarded")


def g17_verdicts(spark, d):
    docs, _, needs, figures, sponsors, warned = found_of(spark, d)
    out = findings.overall_verdict(docs, [needs, figures, sponsors, warned.withColumn("span_no", F.col("start"))])
    return out.select("doc_id", "verdict", F.array_join("reasons", "|").alias("reasons"))


def g18_answers(spark, d):
    c = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    text = F.when(F.col("c_mktsegment") == "BUILDING", "Pay: 40 a day").when(F.col("c_acctbal") < 0, "€ 500").otherwise("no word of it")
    docs = c.select(F.col("c_custkey").alias("doc_id"), text.alias("text"), F.lower("c_mktsegment").alias("profile_id"), F.when(F.col("n_regionkey") == 0, "Dublin 4").when(F.col("n_regionkey") == 1, " ").otherwise(F.col("n_name")).alias("city"))
    return findings.form_answers(docs, {"notice": "a month"}, rule_rows(spark, [("machinery", "30"), ("household", None), ("regional", "25")], "bucket string, salary string"))


def h1_provenance(spark, d):
    o = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    text = F.concat(F.lit("To "), F.col("c_name"), F.lit(" / "), F.when(F.col("o_orderstatus") == "P", "nobody").otherwise(F.col("c_mktsegment")), F.lit("."))
    kind = F.when(F.col("o_orderpriority") == "5-LOW", "odd").otherwise("line")
    blocks = o.select(F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("block_no"), kind.alias("type"), text.alias("text"), F.lit("To ").alias("prefix"), F.lit(".").alias("suffix"), F.lit(" / ").alias("joiner"), F.lit(None).cast("string").alias("template"), F.lit(None).cast("map<string,string>").alias("slots"), (F.col("o_orderpriority") == "2-HIGH").alias("edited"))
    source = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(-1).cast("long")).otherwise(F.col("o_custkey"))
    atoms = o.select(F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("block_no"), source.alias("source_id"), F.inline(F.array(F.struct(F.lit(0).alias("atom_no"), F.lit("name").alias("source_field")), F.struct(F.lit(1).alias("atom_no"), F.lit("segment").alias("source_field")))))
    sources = read(spark, d, "customer").select(F.col("c_custkey").alias("source_id"), F.inline(F.array(F.struct(F.lit("name").alias("source_field"), F.col("c_name").alias("text")), F.struct(F.lit("segment").alias("source_field"), F.col("c_mktsegment").alias("text")))))
    return gates.check_provenance(blocks, atoms, sources, ("line",)).select("doc_id", "block_no", "detail")


def h5_quotes(spark, d):
    t = read(spark, d, "documents").select("doc_id", "text", "lang", "source")
    quotes = t.select("doc_id", F.inline(F.array(F.struct(F.lit(0).alias("block_no"), F.upper(F.regexp_extract("text", "([A-Za-z]+)", 1)).alias("quote")), F.struct(F.lit(1).alias("block_no"), F.col("source").alias("quote")), F.struct(F.lit(2).alias("block_no"), F.concat(F.lit("the "), F.col("lang")).alias("quote")))))
    return gates.quote_check(t.select("doc_id", "text"), quotes).select("doc_id", "block_no", "detail")


def h6_grounding(spark, d):
    c = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    number = F.element_at(F.array(*map(F.lit, ("two", "Seven", "hundred", "none"))), (F.col("n_nationkey") % 4 + 1).cast("int"))
    text = F.concat(F.lit("It grew by "), F.col("n_nationkey"), F.lit("% to "), number, F.lit(" in "), F.initcap("c_mktsegment"), F.lit(", Rome. "), F.initcap("n_name"), F.lit(" and I agree"))
    edited = c.select(F.col("c_custkey").alias("doc_id"), F.lit(0).alias("block_no"), text.alias("text"), F.when(F.col("n_regionkey") < 2, "profile").otherwise("line").alias("kind"))
    corpus = c.select(F.col("c_custkey").alias("doc_id"), F.concat_ws(" ", F.lit("Rome Buildings, twofold"), F.concat("n_regionkey", F.lit("%")), F.lit("10%, 112%.")).alias("text"))
    return gates.grounding_check(edited, corpus, rule_rows(spark, [("It grew by 5% to Seven in Building, Rome. And so on",), ("Another",)], "text string")).select("doc_id", "block_no", "detail")


def h8_flat(spark, d):
    b = read(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.lit(0).alias("block_no"), F.lit("line").alias("type"), "p_name", F.when(F.col("p_size") > 25, "").otherwise(F.col("p_brand")).alias("p_brand"))
    return gates.flatten_blocks(b, ("p_name", "p_brand"))


def budget_blocks(spark, d):
    l = read(spark, d, "lineitem").repartition("l_orderkey").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("block_no")).agg(F.sum("l_quantity").cast("long").alias("cost"), F.max("l_suppkey").alias("s"), F.max("l_returnflag").alias("group_id"))  # noqa: E741
    strength = F.element_at(F.array(*map(F.lit, scoring.STRENGTHS)), (F.col("s") % 4 + 1).cast("int"))
    kind = F.when(F.col("block_no") == 1, "head").otherwise("bullet")
    return l.select("doc_id", "block_no", "cost", "group_id", kind.alias("type"), strength.alias("strength"), F.when(F.col("cost") > 40, 3).otherwise(0).alias("bold_cost"), (F.col("cost") - F.col("cost") % 7).alias("short_cost"), (F.col("block_no") == 3).alias("droppable"), (F.col("block_no") == 4).alias("added"), F.lit(False).alias("soft"))


def h12_dropped(spark, d):
    return gates.drop_blocks(budget_blocks(spark, d), 80).select("doc_id", "block_no", "dropped")


def h13_trimmed(spark, d):
    return gates.trim_to_budget(budget_blocks(spark, d), 80)


def i7_runs(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("verdict"), F.col("o_orderpriority").alias("category"))
    a = o.filter("category <> '5-LOW'")
    b = o.filter("category <> '4-NOT SPECIFIED'").withColumn("verdict", F.when(F.col("verdict") == "P", "F").otherwise(F.col("verdict")))
    return changes.compare_runs(a, b, ("verdict", "category")).select("doc_id", F.col("left.verdict").alias("before"), F.col("right.verdict").alias("after"), "same")


def i9_collisions(spark, d):
    p = read(spark, d, "part")
    key = lambda c: F.concat_ws(".", F.lit(c), "p_partkey")
    return changes.collision_test(rule_rows(spark, [("small",), ("red widget",), ("promo*",), ("hot++",), ("re",)], "term string"), [p.select(key("type").alias("path"), F.col("p_type").alias("text")), p.select(key("name").alias("path"), F.replace("p_name", F.lit(" "), F.lit("-")).alias("text"))])


def j4_first_sentences(spark, d):
    return quality.first_sentence(docs_of(spark, d), "doc_id", "text", "^[A-M]").select("rule", "key", F.length("detail").alias("n"))


def j6_wildcards(spark, d):
    """The words of the documents as a vocabulary, those of odd length with a mark."""
    words = docs_of(spark, d).select(F.explode(F.array_distinct(matching.words_of("text"))).alias("w")).distinct()
    return quality.short_wildcards(words.select(F.when(F.length("w") % 2 == 1, F.concat("w", F.lit("*"))).otherwise(F.col("w")).alias("term")))


def j7_own_words(spark, d):
    p = read(spark, d, "part")
    asks = p.select(F.col("p_partkey").alias("term_id"), F.explode(F.array(F.lit("small"), F.when(F.col("p_size") > 25, "econ*").otherwise("large"))).alias("word"))
    return quality.own_word(p.select(F.col("p_partkey").alias("term_id"), F.col("p_type").alias("term")), asks)


def j8_highlights(spark, d):
    v = read(spark, d, "part").select(F.col("p_partkey").alias("variant_id"), F.concat_ws(" ", "p_name", F.lit("in 3 sizes")).alias("text"), F.array(F.lit("widget"), F.lit("3 sizes"), F.lit("sizes")).alias("phrases"), F.array(F.lit("Red widget")).alias("tags"))
    return quality.highlights(v)


def j9_single_words(spark, d):
    """The beginnings of the turns as tags: one word, one in capitals, or two."""
    first, two = F.regexp_extract("text", "([A-Za-z]+)", 1), F.regexp_extract("text", "([A-Za-z]+ [A-Za-z]+)", 1)
    tag = F.when(F.col("turn") % 3 == 0, F.upper(first)).when(F.col("turn") % 3 == 1, first).otherwise(two)
    return quality.single_word_tags(read(spark, d, "conversations").select(tag.alias("tag")).filter("tag <> ''").distinct())


def j10_figures(spark, d):
    guards = rule_rows(spark, [("ring", ["Small", "hot"], ["old"]), ("widget", [], ["red"])], "figure string, required array<string>, forbidden array<string>")
    return quality.figure_guards(read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), F.col("p_name").alias("text")), guards)


def j11_shorts(spark, d):
    short = F.when(F.col("p_size") > 25, F.concat(F.lit("Best "), F.substring_index("p_name", " ", -1))).when(F.col("p_size") > 5, F.concat(F.lit("Best "), F.substring_index("p_name", " ", -1), F.lit(" Deal")))
    return quality.short_adds_nothing(read(spark, d, "part").select(F.col("p_partkey").alias("variant_id"), F.col("p_name").alias("text"), short.alias("short_text")))


def j13_incomplete(spark, d):
    rows = read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.col("o_orderstatus")).alias("status"), F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("price"))
    return quality.incomplete(rows, "o_orderkey", ("status", "price"))


def j17_tokens(spark, d):
    return quality.token_present(read(spark, d, "part"), "p_partkey", "p_type", F.col("p_size") < 10, "SMALL")


def shorts_of(spark, d):
    return read(spark, d, "part").select(F.col("p_partkey").alias("variant_id"), F.col("p_type").alias("text"), F.when(F.col("p_size") > 40, F.concat("p_type", F.lit("!"))).when(F.col("p_size") > 10, F.left("p_type", F.lit(3))).alias("short_text"))


def j18_coverage(spark, d):
    return quality.coverage_report(shorts_of(spark, d))


def j18_saves_nothing(spark, d):
    return quality.saves_nothing(shorts_of(spark, d))


def j19_patterns(spark, d):
    n = read(spark, d, "nation").select("n_nationkey", F.when(F.col("n_regionkey") == 0, F.concat(F.lit("("), F.col("n_name"))).when(F.col("n_regionkey") == 1, F.lit(r"\p{L}+")).otherwise(F.col("n_name")).alias("p"))
    return quality.bad_patterns(n, "n_nationkey", "p")


def b16_names(spark, d):
    c = read(spark, d, "customer")
    name = F.concat(F.initcap("c_mktsegment"), F.lit(" Supply Ltd"))
    seg = F.initcap("c_mktsegment")
    text = F.concat_ws(". ", seg, seg, seg, name, F.when(F.col("c_acctbal") > 0, F.concat_ws(". ", name, name, name)))
    return c.select("c_custkey", T.tidy_company(name, text).alias("company"))


QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and k[0] in "abcdefghij" and k.split("_")[0][1:].isdigit()}
