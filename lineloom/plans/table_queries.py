"""Registered queries over keyed tables: choice, months, budgets, changes, quality rules, stamps, streams' batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineloom.operators import changes, findings, gates, quality, scoring
from lineloom.plans.text_queries import docs_of, hits_of, read, rule_rows
from lineloom.sources import documents, publish
from lineloom.streaming import inbox


def a4_overlay(spark, d):
    base = read(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    other = base.filter("c_mktsegment < 'F'").select("c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.upper("c_mktsegment")).alias("c_mktsegment"), F.concat("c_name", F.lit("-x")).alias("c_name"))
    return documents.overlay(base, other, "c_custkey")


def a5_audit(spark, d):
    rows = read(spark, d, "customer").select(F.concat("c_mktsegment", F.lit("-v1")).alias("data_version"), F.col("c_custkey").alias("doc_id"), "c_name", "c_nationkey")
    placed = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))
    return documents.audit(rows.join(placed, "doc_id"), ("c_name", "c_nationkey", "n"))


def a6_stamp(spark, d):
    return documents.content_stamp(read(spark, d, "documents").select("doc_id", "text"))


def f12_roles(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("person_id"), F.col("o_orderkey").alias("role_no"), F.col("o_orderdate").cast("date").alias("start_date"), (F.col("o_orderpriority") < "3").alias("relevant"))
    return scoring.order_roles(o).select("person_id", "role_no", "place")


def g10_outcomes(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").cast("string").alias("rule_id"), F.col("ts").cast("date").alias("date"), F.when(F.col("event_type") == "error", "rejected").otherwise(F.col("event_type")).alias("outcome"))
    return findings.outcome_summary(e).select("rule_id", "n", "n_rejected", F.col("latest").cast("string").alias("latest"))


def g15_months(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("person_id"), F.col("o_orderdate").cast("date").alias("start_date"), (F.col("o_orderstatus") == "F").alias("relevant"), (F.col("o_orderpriority") < "4").alias("full_time"))
    ship = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(F.col("l_shipdate").cast("date")).alias("end_date"))
    return findings.experience_months(o.join(ship, "o_orderkey", "left"), "1999-01-01")


def g13_verdicts(spark, d):
    rows = read(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), (F.col("p_size") > 45).cast("int").alias("n_block"), F.when(F.col("p_size") % 8 < 7, F.col("p_size") % 8).alias("required"), (F.col("p_size") % 3).alias("n_missing_tools"), (F.col("p_size") % 5 == 0).alias("skips"), (F.col("p_size") % 2 == 0).alias("vague"), (F.col("p_size") % 8 == 7).alias("all_discarded"))
    out = findings.fit_verdict(rows)
    return out.select("doc_id", "verdict", F.array_join("reasons", ",").alias("reasons"), "ambiguous", "discarded")


def lines_as_blocks(spark, d):
    items = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("block_no")).agg(F.sum("l_quantity").cast("long").alias("cost"), F.max("l_suppkey").alias("s"))
    strength = F.element_at(F.array(*map(F.lit, scoring.STRENGTHS)), (F.col("s") % 4 + 1).cast("int"))
    return items.select("doc_id", "block_no", "cost", (F.col("cost") - F.col("cost") % 7).alias("short_cost"), strength.alias("strength"), F.lit(1).alias("spacing"))


def h10_budget(spark, d):
    return gates.budget_fit(lines_as_blocks(spark, d), 100, 5)


def h11_shorten(spark, d):
    b = lines_as_blocks(spark, d)
    return gates.shorten(b, gates.budget_fit(b, 100, 5)).select("doc_id", "block_no", "shortened", "saved")


def h14_paragraphs(spark, d):
    rows = lines_as_blocks(spark, d).select("doc_id", F.col("block_no").alias("paragraph_no"), F.col("block_no").alias("evidence_no"), "cost")
    return gates.drop_optional_paragraphs(rows, 80).select("doc_id", "paragraph_no", "dropped")


def i2_stale(spark, d):
    docs = read(spark, d, "documents")
    old = docs.filter("lang <> 'de'").select(F.col("doc_id").alias("key"), F.when(F.col("lang") == "fr", F.md5("text")).otherwise(changes.content_hash("text")).alias("hash"))
    return changes.stale_rows(old, docs.filter("n_chars < 2000").select(F.col("doc_id").alias("key"), changes.content_hash("text").alias("hash")))


def i3_versions(spark, d):
    v = read(spark, d, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("version"), "text")
    return changes.is_new_version(v).select("key", "version", F.round("changed", 6).alias("changed"), "is_new")


def i4_multiset(spark, d):
    rows = read(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").cast("int").alias("q"), F.col("l_linestatus").alias("s"))
    return changes.multiset_diff(rows.filter("s = 'O'").drop("s"), rows.filter("s <> 'O'").drop("s")).groupBy("l_returnflag", "q").agg(F.count(F.lit(1)).alias("n"))


BASELINE_TAGS = ("english", "german", "french", "spanish", "nothing")


def i5_baseline(spark, d):
    return changes.tag_baseline(rule_rows(spark, [(t,) for t in BASELINE_TAGS], "tag string"), hits_of(spark, d))


def i5_documents(spark, d):
    return changes.tag_documents(rule_rows(spark, [(t,) for t in BASELINE_TAGS], "tag string"), hits_of(spark, d))


def i6_delta(spark, d):
    rows, docs = i5_documents(spark, d), read(spark, d, "documents")
    of = lambda keep: rows.join(docs.filter(keep).select("doc_id"), "doc_id", "left_semi")
    return changes.baseline_delta(of("n_chars < 4000"), of("n_chars > 400"))


def i8_accuracy(spark, d):
    expected = read(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("expected"))
    picked = read(spark, d, "documents").select("doc_id", F.when(F.col("n_chars") > 100, "1").otherwise("0").alias("picked"))
    return changes.pick_accuracy(expected, picked)


def j1_dangling(spark, d):
    return quality.dangling(read(spark, d, "lineitem").withColumn("k", F.concat_ws("-", "l_orderkey", "l_linenumber")), "k", "l_suppkey", read(spark, d, "supplier").filter("s_acctbal > 0"), "s_suppkey")


def j2_coverage(spark, d):
    return quality.coverage(read(spark, d, "customer"), "c_custkey", read(spark, d, "orders"), "o_custkey", 5, 12)


def j3_domains(spark, d):
    p = read(spark, d, "part")
    return quality.validate([quality.domain(read(spark, d, "orders"), "o_orderkey", "o_orderstatus", ("F", "O")), quality.too_short(p, "p_partkey", "p_name", 18)])


def j5_first_words(spark, d):
    verbs = read(spark, d, "benchmark").select(F.regexp_extract("text", r"^\s*([A-Za-z']+)", 1).alias("verb")).filter("verb <> ''")
    return quality.first_word(docs_of(spark, d), "doc_id", "text", verbs)


def j12_dates(spark, d):
    rows = read(spark, d, "lineitem").join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("s"), F.when(F.col("l_linenumber") == 7, "soon").when(F.col("l_linenumber") == 6, "1990-01-01").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("e"))
    return quality.date_order(rows, "k", "s", "e")


def j14_slots(spark, d):
    rows = read(spark, d, "customer").select("c_custkey", F.concat(F.lit("Dear {{NAME}}, {{"), "c_mktsegment", F.lit("}} and {{lower}}")).alias("t"))
    return quality.template_slots(rows, "c_custkey", "t", ("NAME", "BUILDING"))


def j15_pii(spark, d):
    """Order lines as a personnel file would write them, each fourth of them with one of the shapes."""
    o = read(spark, d, "orders")
    k, form = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 8
    shaped = F.when(form == 0, F.concat(F.lit("ref TCS/Trainee/"), k)).when(form == 1, F.concat(F.lit("card gnib-"), F.lpad(k, 5, "0"))).when(form == 2, F.concat(F.lit("OREG "), k)).when(form == 3, F.concat(F.lit("cert Jan/24/"), F.lpad(k, 3, "0")))
    shaped = shaped.when(form == 4, F.concat(F.lit("pay 45,000 - 5"), F.col("o_orderkey") % 10, F.lit(",500"))).when(form == 5, F.concat(F.lit("EMPLOYEE no. "), F.lpad(k, 7, "0"))).when(form == 6, F.concat(F.lpad(k, 7, "1"), F.lit(" is an employee")))
    return quality.pii_scan(o.select("o_orderkey", F.concat_ws("; ", shaped.otherwise("nothing here"), "o_orderpriority").alias("t")), "o_orderkey", "t")


def j15_keys(spark, d):
    e = read(spark, d, "events")
    body = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"salary": 1, "a": '), F.col("event_id"), F.lit("}"))).when(F.col("event_id") % 3 == 1, F.lit('{"a": {"salary": 1, "certNo" : "x"}}')).otherwise(F.lit('{"a": "certNo"}'))
    return quality.banned_keys(e.select("event_id", body.alias("j")), "event_id", "j")


def a3_notes(spark, d):
    """Structs, arrays and maps with notes in each, as the customers' rows fill them."""
    c = read(spark, d, "customer")
    m = F.create_map(F.lit("a"), F.struct(F.col("c_custkey").alias("k"), F.lit("x").alias("_why")), F.lit("_note"), F.struct(F.lit(0).cast("long").alias("k"), F.lit("y").alias("_why")), F.lit("_kept"), F.struct(F.lit(1).cast("long").alias("k"), F.lit("z").alias("_why")))
    rows = c.select("c_custkey", F.struct(F.array(m).alias("list"), F.lit("gone").alias("_note"), F.col("c_name").alias("name")).alias("s"), F.lit(1).alias("_top"))
    return documents.strip_notes(rows, ("_kept",)).select("c_custkey", F.to_json("s").alias("s"))


def j16_contacts(spark, d):
    allowed = rule_rows(spark, [("nobody@example.com",)], "value string")
    return quality.contacts_not_allowed(docs_of(spark, d), "doc_id", "text", allowed)


def k2_latest(spark, d):
    e = read(spark, d, "events").select("user_id", "ts", F.md5(F.concat_ws("|", F.col("event_id").cast("string"), "event_type")).alias("hash"), "event_id", "event_type")
    return inbox.latest_per_key(e, "user_id").select("user_id", "event_id", "event_type")


def k1_inbox(spark, d):
    """The pages as they drop in, named by day and address; the last of each address."""
    at = publish.fresh_folder(spark, "k1")
    raw = inbox.stream_table(spark, f"{d}/pages.parquet", 4).select(F.format_string("in/2024-05-%02d-%s.txt", F.pmod("page_id", F.lit(40)), F.replace(F.regexp_extract("url", "^https?://([^?#]+)", 1), F.lit("/"), F.lit("-"))).alias("path"), F.timestamp_seconds("page_id").alias("ts"), F.col("html").alias("text"))
    inbox.drain(inbox.inbox_rows(raw).writeStream.foreachBatch(inbox.upsert_latest(f"{at}/rows", "slug")), f"{at}/state")
    return inbox.read_latest(spark, f"{at}/rows", "slug").select("slug", F.date_format("day", "yyyy-MM-dd").alias("day"), "hash")


def k2_upserts(spark, d):
    """k2_latest, taken in by a stream."""
    at = publish.fresh_folder(spark, "k2")
    e = _events(spark, d, 4).select("user_id", "ts", F.md5(F.concat_ws("|", F.col("event_id").cast("string"), "event_type")).alias("hash"), "event_id", "event_type")
    inbox.drain(e.writeStream.foreachBatch(inbox.upsert_latest(f"{at}/rows", "user_id")), f"{at}/state")
    return inbox.read_latest(spark, f"{at}/rows", "user_id").select("user_id", "event_id", "event_type")


def _events(spark, d, files_a_batch=None):
    """The events as a stream, their times as moments: watermarks take no times without a zone."""
    ts = F.to_timestamp(F.concat(F.col("ts").cast("string"), F.lit("Z")))
    return inbox.stream_table(spark, f"{d}/events.parquet", files_a_batch).withColumn("ts", ts)


def _appended(spark, stream, at):
    inbox.drain(stream.writeStream.format("parquet").option("path", f"{at}/rows"), f"{at}/state")
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def k2_repeats(spark, d):
    """The first of the events of a kind with the same properties; the delay spans the table."""
    e = _events(spark, d).select("ts", "event_type", F.sha2("props", 256).alias("hash"))
    return _appended(spark, inbox.drop_repeats(e, "event_type", "3650 days"), publish.fresh_folder(spark, "repeats")).select("event_type", "hash")


def k3_stream(spark, d):
    """The days that the watermark has passed, counted by a stream."""
    e = _events(spark, d).select("ts", F.col("event_type").alias("tag"))
    return _appended(spark, inbox.stream_hit_counts(e), publish.fresh_folder(spark, "k3")).select(F.date_from_unix_date((F.unix_seconds("day") / 86400).cast("int")).cast("string").alias("day"), "tag", "n")


def a7_published(spark, d):
    """The orders as published: customers that exist are checked, and a second publication, of rows without status F, is refused."""
    at, o = publish.fresh_folder(spark, "a7"), read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    documents.publish_checked(o, quality.dangling(o, "o_orderkey", "o_custkey", read(spark, d, "customer"), "c_custkey"), at)
    less = o.filter("o_orderstatus <> 'F'")
    try:
        documents.publish_checked(less, quality.domain(less, "o_orderkey", "o_orderstatus", ("F",)), at)
    except ValueError:
        pass
    return publish.read_current(spark, at)


def k3_counts(spark, d):
    e = read(spark, d, "events").select("ts", F.col("event_type").alias("tag"))
    return inbox.stream_hit_counts(e).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "tag", "n")


QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and k[0] in "afghijk" and k[1].isdigit()}
