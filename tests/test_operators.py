"""Small cases for operators that the driver's tables don't reach."""

import datetime

import pytest
from pyspark.sql import functions as F

from lineloom.functions import text as T
from lineloom.operators import changes, extract, findings, gates, lines, matching, quality, scoring
from lineloom.sources import documents

AD = "Junior Data Analyst\nAcme Labs Ltd\nLocation: Dublin\n\nAbout the role\nYou will build reports. We work at Acme Labs.\n\nRequirements:\nAt least 2-3 years experience with SQL, ideally Python; a degree is required.\nPlease contact Mary Byrne for details.\n\nBenefits\nFree lunch every day."


@pytest.fixture(scope="module")
def ads(spark):
    return spark.createDataFrame([(1, AD), (2, ""), (3, None)], "doc_id long, text string")


def one(df, c):
    return [r[c] for r in df.collect()]


def test_stems_and_overlap(spark):
    words = ["regulation", "running", "edition", "worked", "classes", "cats", "class", "realize", "store", "the"]
    got = one(spark.createDataFrame([(w,) for w in words], "w string").select(T.stem("w").alias("s")), "s")
    assert got == ["regul", "runn", "edit", "work", "class", "cat", "class", "realis", "stor", "the"]
    pairs = spark.createDataFrame([("regul", "regulat"), ("regul", "regulatio"), ("data", "datab"), ("same", "same")], "a string, b string")
    assert one(pairs.select(matching.stems_overlap("a", "b").alias("o")), "o") == [True, False, False, True]


def test_count_hits_and_hash(spark):
    row = spark.range(1).select(matching.count_hits(F.lit("sql sql sql"), F.lit("sql")).alias("n"), T.hash31(F.lit("abc")).alias("h")).first()
    assert (row["n"], row["h"]) == (3, 96354)


def test_sections(ads):
    rows = lines.classify_sentences(ads.filter("doc_id = 1")).collect()
    by = {r["text"]: (r["matchable"], r["sub_type"]) for r in rows}
    assert by["You will build reports."] == (True, "responsibility")
    assert by["Free lunch every day."][0] is False
    assert any(t.startswith("At least") and s == (True, "requirement") for t, s in by.items())


def test_prefix_terms_of_the_narrow_sections_never_match(spark):
    docs = spark.createDataFrame([(1, "Benefits\nFree lunch")], "doc_id long, text string")
    assert one(lines.requirement_sections(docs), "state") == ["included", "included"]
    assert one(lines.requirement_sections(docs, whole=False), "state") == ["ignored"]


def test_spans_have_exact_offsets(ads):
    for r in lines.split_spans(ads).collect():
        assert AD[r["start"] : r["end"]] == r["text"]


def test_numbers(ads):
    s = lines.classify_sentences(ads.filter("doc_id = 1"))
    assert one(extract.number_required(ads, extract.number_candidates(s)).orderBy("doc_id"), "required") == [2, None, None]


def test_fields(spark, ads):
    gazetteer = spark.createDataFrame([("Dublin", "Dublin", "dublin"), ("Cork", "Cork", "cork")], "name string, canonical string, area string")
    row = extract.extract_all(ads, gazetteer).filter("doc_id = 1").first()
    assert row["role"]["value"] == "Junior Data Analyst"
    assert row["city"]["value"] == "Dublin"
    assert row["recipient"]["value"] == "Mary Byrne"
    assert row["company"]["value"] == "Acme Labs"


def test_clause_classes(spark):
    spans = spark.createDataFrame([(1, 0, "SQL is required, Python, ideally R; Go", True)], "doc_id long, span_no int, text string, requirement boolean")
    rows = findings.clause_class(lines.split_clauses(spans)).orderBy("clause_no").collect()
    assert [(r["class"], r["explicit"]) for r in rows] == [("required", True), ("preferred", True), ("preferred", True), ("required", False)]


def test_requirement_findings(spark, ads):
    items = spark.createDataFrame([("degree", "degree", "not_held", True), ("py", "python", "unknown", False)], "item_id string, phrase string, held string, qualification boolean")
    spans = lines.split_spans(ads).withColumn("requirement", F.lit(False))
    got = {r["id"]: (r["class"], r["severity"]) for r in findings.requirement_findings(ads, spans, items).collect()}
    assert got == {"degree": ("required", "red"), "py": ("preferred", "amber")}


def test_months(spark):
    d = datetime.date
    e = spark.createDataFrame([(1, d(2024, 1, 15), None, True, True)], "person_id long, start_date date, end_date date, full_time boolean, relevant boolean")
    assert findings.experience_months(e, "2026-09-30").first()["relevant"] == 33


def test_highlight_joins_back(spark):
    row = spark.range(1).select(T.highlight(F.lit("Built SQL reports in SQL and R"), F.array(F.lit("SQL"), F.lit("R"), F.lit("reports")), 2).alias("p")).first()["p"]
    assert "".join(x["text"] for x in row) == "Built SQL reports in SQL and R"
    assert [x["text"] for x in row if x["bold"]] == ["SQL", "R"]


def test_provenance(spark):
    blocks = spark.createDataFrame(
        [(1, 0, "bullet", "A, B.", "", ".", ", ", None, None, False), (1, 1, "bullet", "other", "", "", "", None, None, False), (1, 2, "odd", "x", "", "", "", None, None, False)],
        "doc_id long, block_no int, type string, text string, prefix string, suffix string, joiner string, template string, slots map<string,string>, edited boolean",
    )
    atoms = spark.createDataFrame([(1, 0, 0, "s", "a"), (1, 0, 1, "s", "b"), (1, 1, 0, "s", "a"), (1, 2, 0, "s", "a")], "doc_id long, block_no int, atom_no int, source_id string, source_field string")
    sources = spark.createDataFrame([("s", "a", "A"), ("s", "b", "B")], "source_id string, source_field string, text string")
    got = {r["block_no"]: r["detail"] for r in gates.check_provenance(blocks, atoms, sources, ("bullet",)).collect()}
    assert got == {1: "text differs", 2: "unknown type"}


def test_drop_blocks_takes_empty_groups(spark):
    rows = [(1, 0, "head", "g", "core", 5), (1, 1, "bullet", "g", "filler", 10), (1, 2, "head", "h", "core", 5), (1, 3, "bullet", "h", "required", 10)]
    out = gates.drop_blocks(spark.createDataFrame(rows, "doc_id long, block_no int, type string, group_id string, strength string, cost long"), 20)
    assert {r["block_no"] for r in out.filter("dropped").collect()} == {0, 1}


def test_trim_order(spark):
    rows = [(1, 0, "para", "g", "core", 10, 2, None, False, False, False), (1, 1, "para", "g", "core", 10, 0, 6, False, False, False), (1, 2, "para", "g", "core", 10, 0, None, True, False, False)]
    b = spark.createDataFrame(rows, "doc_id long, block_no int, type string, group_id string, strength string, cost long, bold_cost long, short_cost long, droppable boolean, added boolean, soft boolean")
    out = {r["block_no"]: r for r in gates.trim_to_budget(b, 25).collect()}
    assert out[0]["unbold"] and out[1]["shortened"] and not out[2]["para_dropped"] and out[0]["overflow_left"] == 0


def test_versions(spark):
    v = spark.createDataFrame([("k", 1, "one two three"), ("k", 2, "one two four"), ("k", 3, "something else")], "key string, version int, text string")
    assert one(changes.is_new_version(v).orderBy("version"), "is_new") == [True, False, True]


def test_quality_rules(spark):
    v = spark.createDataFrame([("v", "Built 3 tools", "Built 5 tools in Rust", ["Built 3", "absent"], ["tools"])], "variant_id string, text string, short_text string, phrases array<string>, tags array<string>")
    assert one(quality.short_adds_nothing(v), "detail") == ["5, Rust"]
    assert sorted(one(quality.highlights(v), "detail")) == ["digit: Built 3", "not in text: absent"]
    rules = spark.createDataFrame([("a", "(x"), ("b", "x+")], "id string, p string")
    assert one(quality.bad_patterns(rules, "id", "p"), "key") == ["a"]


def test_strip_notes_and_publish(spark, tmp_path):
    df = spark.createDataFrame([(1, (2, "n"), [(3, "m")])], "a int, s struct<x:int,_note:string>, l array<struct<y:int,_note:string>>").withColumn("_top", F.lit(1))
    out = documents.strip_notes(df)
    assert out.first() == (1, (2,), [(3,)])
    none = spark.createDataFrame([], "rule string, key string, detail string")
    stamp = documents.publish_checked(out, none, f"file://{tmp_path}/p")
    assert len(stamp) == 10
    bad = spark.createDataFrame([("r", "k", "d")], "rule string, key string, detail string")
    with pytest.raises(ValueError, match="r k: d"):
        documents.publish_checked(out, bad, f"file://{tmp_path}/p")


def test_readers_see_whole_versions(spark, tmp_path):
    from lineloom.sources import publish

    at = f"file://{tmp_path}/t"
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "a int")
    seen = lambda: sorted(r["a"] for r in publish.read_current(spark, at).collect())
    with pytest.raises(ValueError, match="nothing is published"):
        publish.read_current(spark, at)
    first = documents.write_versioned(rows(1, 2), at)
    old = publish.read_current(spark, at)
    with pytest.raises(Exception):  # fails while it writes, after some of its rows may be there
        publish.publish(rows(3, 4).select(F.assert_true(F.col("a") < 4).isNull().cast("int").alias("a")), at, "stamp=broken")
    assert seen() == [1, 2]
    documents.write_versioned(rows(3), at)
    assert seen() == [3] and sorted(r["a"] for r in old.collect()) == [1, 2]
    assert documents.write_versioned(rows(2, 1), at) == first and seen() == [1, 2]
    publish.publish(rows(5), at, "stamp=broken")
    assert seen() == [5]


def test_streams_take_late_rows_and_drop_repeats(spark, tmp_path):
    from lineloom.streaming import inbox

    src, at = f"file://{tmp_path}/src", f"file://{tmp_path}"
    put = lambda *v: spark.createDataFrame([("k", moment(t), h) for t, h in v], "k string, ts timestamp, hash string").coalesce(1).write.mode("append").parquet(src)
    counts = lambda: inbox.drain(inbox.stream_hit_counts(inbox.stream_table(spark, src, 1), "k").writeStream.format("parquet").option("path", f"{at}/n"), f"{at}/c1")
    upserts = lambda: inbox.drain(inbox.stream_table(spark, src, 1).writeStream.foreachBatch(inbox.upsert_latest(f"{at}/u", "k")), f"{at}/c2")
    firsts = lambda: inbox.drain(inbox.drop_repeats(inbox.stream_table(spark, src, 1), "k").writeStream.format("parquet").option("path", f"{at}/f"), f"{at}/c3")
    for rows in ((("2024-01-01 10:00:00", "a"), ("2024-01-01 11:00:00", "a")), (("2024-01-03 10:00:00", "b"),), (("2024-01-01 12:00:00", "late"), ("2024-01-05 10:00:00", "a"))):
        put(*rows)
        counts(), upserts(), firsts()
    assert {(str(r["day"])[:10], r["n"]) for r in spark.read.parquet(f"{at}/n").collect()} == {("2024-01-01", 2), ("2024-01-03", 1)}
    assert [r["hash"] for r in inbox.read_latest(spark, f"{at}/u", "k").collect()] == ["a"]
    assert sorted(r["hash"] for r in spark.read.parquet(f"{at}/f").collect()) == ["a", "a", "b"]


def moment(text):
    import datetime

    return datetime.datetime.fromisoformat(text).replace(tzinfo=datetime.timezone.utc)


def test_evidence_and_why(spark):
    rows = [(1, "a", 0, "f1", "Saved 20% of hours", 2, True), (1, "b", 1, "f2", "Saved 20% again", 3, False), (1, "c", 2, "f3", "Wrote a thesis", 1, False), (1, "d", 3, "f4", "Nothing special", 0, False)]
    c = spark.createDataFrame(rows, "doc_id long, variant_id string, pos int, family string, text string, overlap int, lead boolean")
    assert one(scoring.pick_evidence(c), "evidence") == [["a", "c"]]


def test_inbox(spark, tmp_path):
    from lineloom.streaming import inbox

    (tmp_path / "in").mkdir()
    (tmp_path / "in/2024-05-01-acme.txt").write_text("A – b")
    stream = inbox.stream_inbox(spark, f"file://{tmp_path}/in")
    q = stream.writeStream.foreachBatch(inbox.upsert_latest(f"file://{tmp_path}/out", "slug")).option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(60)
    row = spark.read.parquet(f"file://{tmp_path}/out/version=0").first()
    assert (row["slug"], str(row["day"]), row["text"]) == ("acme", "2024-05-01", "A - b")


def test_phrases_of_any_length(spark):
    text = "We are a fast paced young team of 24 7 365 on call people in the town of Newcastle upon Tyne today"
    docs = spark.createDataFrame([(1, text), (2, "a fast paced young"), (3, "")], "doc_id long, text string")
    terms = lambda *t: spark.createDataFrame([(x,) for x in t], "term string")
    got = matching.match_terms(docs, terms("a fast paced young team", "are a fast paced you*", "fast", "upon tyne today and more"))
    assert {(r["doc_id"], r["term"]) for r in got.collect()} == {(1, "a fast paced young team"), (1, "are a fast paced you*"), (1, "fast"), (2, "fast")}
    assert matching.match_terms(docs, terms("fast").limit(0)).count() == 0
    blocks = docs.select("doc_id", F.lit(0).alias("block_no"), F.lit("fixed").alias("type"), "text")
    assert gates.banned_terms(blocks, terms("a fast paced young team")).count() == 1
    strings = docs.select(F.col("doc_id").cast("string").alias("path"), "text")
    assert one(changes.collision_test(terms("a fast paced young team"), [strings]), "path") == ["1"]
    tags = spark.createDataFrame([("shift", "24 7 365 on call")], "tag string, phrase string")
    assert one(matching.match_tags(docs.withColumn("span_no", F.lit(0)), tags), "tag") == ["shift"]
    gazetteer = spark.createDataFrame([("town of newcastle upon tyne", "Newcastle", "ne"), ("newcastle", "Other", "x")], "name string, canonical string, area string")
    assert one(matching.places_in(docs, gazetteer), "places") == [["Newcastle"]]


def test_terms_stand_between_word_boundaries(spark):
    docs = spark.createDataFrame([(1, "we use c and go"), (2, "c++x and .net, asp.net"), (3, "Data-Science teams, dataset; one, two"), (4, "élan the thé")], "doc_id long, text string")
    terms = lambda *t: spark.createDataFrame([(x,) for x in t], "term string")
    got = lambda t, **k: {(r["doc_id"], r["term"]) for r in matching.match_terms(docs, t, **k).collect()}
    assert got(terms("c++", "c", "go", ".net", "one two", "data*", "data sci*", "th", "lan")) == {(1, "c"), (1, "go"), (2, "c++"), (2, "c"), (2, ".net"), (3, "data*"), (4, "th"), (4, "lan")}
    assert got(terms("data sci*", "data science"), joined=True) == {(3, "data sci*"), (3, "data science")}
    assert got(terms("++", "")) == set()


def test_places_in_text_order(spark):
    gazetteer = spark.createDataFrame([("Cork", "Cork", "cork"), ("Dublin", "Dublin", "dublin"), ("Dublin Airport", "Dublin Airport", "dublin"), ("Airport Road", "Road", "x")], "name string, canonical string, area string")
    docs = spark.createDataFrame([(1, "from cork to Dublin, CORK"), (2, "Dublin Airport Road in Cork"), (3, "Dublin 4 and Cork"), (4, "at D02 H638 near Cork"), (5, "none")], "doc_id long, text string")
    got = {r["doc_id"]: r["places"] for r in matching.places_in(docs, gazetteer).collect()}
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(matching, "MOST_RULES", 0)
        assert {r["doc_id"]: r["places"] for r in matching.places_in(docs, gazetteer).collect()} == got
    assert got == {1: ["Cork", "Dublin"], 2: ["Dublin Airport", "Cork"], 3: ["Dublin", "Cork"], 4: ["Dublin", "Cork"]}
    shown = {r["doc_id"]: r["p"] for r in matching.with_places(docs, gazetteer).select("doc_id", matching.all_places("text").alias("p")).collect()}
    assert shown == got | {5: []}


def test_gazetteers_of_any_size_agree(spark):
    """Nulls, blanks, names that differ in case only, names without a letter of ASCII, rows that share an id."""
    small = [("Cork", "Cork IE", "cork"), ("cork", "Cork US", "us"), (None, "Nowhere", None), (" ", "Blank", None), ("Dún Laoghaire", "DL", "dublin"), ("東京", "Tokyo", "jp"), ("St. John's", "SJ", None), ("New York", "NY", "us"), ("York", "Y", "uk"), ("Łódź", "Lodz", "pl")]
    rows = [(1, "CORK, 東京タワー and St. John's"), (1, "new york or York in Dún Laoghaire"), (None, "Łódź, Yorkshire, york"), (2, None), (3, "no place")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    shape = "name string, canonical string, area string"
    want = [("1", ["Cork IE", "Tokyo", "SJ"]), ("1", ["NY", "Y", "DL"]), ("None", ["Lodz", "Y"])]
    big = small + [(f"place{k} of nowhere", f"P{k}", None) for k in range(30_000)]
    for names in (small, big):
        got = matching.places_in(docs, spark.createDataFrame(names, shape)).collect()
        assert sorted((str(r["doc_id"]), r["places"]) for r in got) == sorted(want)
        for r in matching.place_mentions(docs, spark.createDataFrame(names, shape)).collect():
            assert r["name"] in [t[r["start"] : r["end"]] for i, t in rows if t and i == r["doc_id"]]
    assert matching.places_in(docs, spark.createDataFrame([], shape)).count() == 0


def test_large_vocabularies_match_as_small_ones(spark, monkeypatch):
    rows = [(1, "a data-driven team, data sets"), (2, "c++ and go; databases"), (None, "data"), (None, "go"), (3, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    terms = spark.createDataFrame([("data*",), ("data set*",), ("c++",), ("go",), ("team",), ("data driven",)], "term string")
    for joined in (False, True):
        few = sorted(map(str, matching.match_terms(docs, terms, joined).collect()))
        with monkeypatch.context() as patch:
            patch.setattr(matching, "MOST_RULES", 0)
            assert sorted(map(str, matching.match_terms(docs, terms, joined).collect())) == few


def test_quotes_in_all_texts(spark):
    import random

    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "Delta", "eta,", "theta.", "io", "É"]
    texts = [(k, " ".join(rng.choices(words, k=rng.choice([0, 1, 3, 20, 80])))) for k in range(60)] + [(None, "alpha beta"), (7, None), (8, "  io\n\tbeta  ")]
    quotes = [(0, None), (1, ""), (2, " "), (3, "a"), (4, "ta g"), (5, "beta gamma"), (6, "io\n\tbeta"), (7, "ALPHA"), (8, "a beta a"), (9, "not there at all"), (10, "\n")]
    for k in range(40):
        t = rng.choice([t for _, t in texts if t])
        a = rng.randrange(len(t))
        quotes.append((20 + k, t[a : a + rng.choice([1, 5, 15, 40, 90, 200])]))
    got = matching.find_quotes(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(quotes, "quote_id long, quote string")).collect()
    want = [(q, i, t.lower().index(x.lower())) for q, x in quotes if x is not None for i, t in texts if t is not None and x.lower() in t.lower()]
    assert sorted(map(str, ((r["quote_id"], r["doc_id"], r["at"]) for r in got))) == sorted(map(str, want))


def test_hits_need_no_order_of_lines(spark):
    from lineloom.plans import text_queries

    from .conftest import SF

    plan = text_queries.hits_of(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
    docs = spark.createDataFrame([(1, "We build. We sell!\n\nBenefits\nFree lunch.\nRequirements\nYou know SQL."), (2, None), (3, ""), (None, "a b.")], "doc_id long, text string")
    kept = lambda df: sorted((r["doc_id"], r["text"]) for r in df.filter("matchable").collect())
    assert kept(lines.matchable_sentences(docs)) == kept(lines.classify_sentences(docs)) != []


def test_few_quotes_are_found_where_the_text_is(spark):
    docs = spark.createDataFrame([(1, "The theorems of  Thales\nwere old"), (1, "of"), (2, None), (None, "THE end, the ending"), (3, "")], "doc_id long, text string")
    texts = ["the", "heor", "he", "ms of", "of  thales", "Thales\nwere o", "e theorems of  th", "end, the end", "ending", "", " ", None, "zz", "orems", "the", "d, t"]
    quotes = spark.createDataFrame(list(enumerate(texts)), "quote_id long, quote string")
    rows = [(1, "The theorems of  Thales\nwere old"), (1, "of"), (None, "THE end, the ending"), (3, "")]
    want = sorted(str((q, i, t.lower().index(x.lower()))) for q, x in enumerate(texts) if x is not None for i, t in rows if x.lower() in t.lower())
    got = lambda: sorted(str((r["quote_id"], r["doc_id"], r["at"])) for r in matching.find_quotes(docs, quotes).collect())
    assert got() == want
    # the texts aren't shuffled
    plan = matching.find_quotes(docs, quotes)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [_d" not in plan and "Distinct" not in plan
    assert not any("_d#" in line for line in plan.splitlines())
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(matching, "FEW_SHORT", 0)
        assert got() == want
        patch.setattr(matching, "MOST_RULES", 5)
        assert got() == want


def test_fields_within_rows_are_those_of_the_line_operators(spark):
    rows = [(1, "Title: x\n\nAbout the role\nWe build. We sell!\n\nBenefits\nFree lunch.\nRequirements\nYou know SQL."), (2, None), (3, ""), (4, "One line\n" * 60), (5, "x" * 200 + "\nhead\n" + "y" * 170 + "\nmore")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    of = docs.select("doc_id", lines.lines_in("text").alias("l"), lines.spans_in("text").alias("s")).withColumn("m", lines.matchable_in(F.col("l"))).withColumn("h", lines.header_in(F.col("l"), lambda x: F.lit(False)))
    got = {r["doc_id"]: r for r in of.collect()}
    listed = lambda df, c: {i: [r[c] for r in df.filter(F.col("doc_id") == i).orderBy("line_no" if "span_no" not in df.columns else "span_no").collect()] for i in (1, 3, 4, 5)}
    assert {i: got[i]["l"] for i in (1, 3, 4, 5)} == listed(lines.explode_lines(docs), "text")
    assert {i: got[i]["s"] for i in (1, 3, 4, 5)} == listed(lines.split_spans(docs), "text")
    assert {i: got[i]["m"] for i in (1, 3, 4, 5)} == listed(lines.classify_sentences(docs).filter("matchable"), "text")
    assert {i: [h["text"] for h in got[i]["h"]] for i in (1, 3, 4, 5)} == listed(lines.header_zone(lines.explode_lines(docs)), "text")


def test_warnings_pass_over_sentences_without_a_figure(spark):
    docs = spark.createDataFrame([(1, "Years of experience help. You have 3 years experience."), (2, "Years of experience help.")], "doc_id long, text string")
    s = lines.classify_sentences(docs)
    rules = [{"id": "y", "pattern": "years", "severity": "block", "needs_years": True}, {"id": "h", "pattern": "help", "severity": "note"}]
    got = {(r["doc_id"], r["rule_id"]): r["quote"] for r in findings.warning_findings(s, rules, extract.number_candidates(s)).collect()}
    assert got == {(1, "y"): "You have 3 years experience.", (1, "h"): "Years of experience help.", (2, "h"): "Years of experience help."}


def test_patterns_are_those_of_spark(spark):
    rules = spark.createDataFrame([("a", r"\p{L}+"), ("b", "(?<x"), ("c", None), ("d", "(?P<x>y)")], "id string, p string")
    assert sorted(one(quality.bad_patterns(rules, "id", "p"), "key")) == ["b", "d"]


def test_entities_of_any_code(spark):
    row = spark.createDataFrame([("<p>a&#8217;b &ldquo;c&rdquo;</p><script>x()</script>\n```js\n# T", ), ("no tags &lt;p", )], "h string")
    assert one(row.select(T.html_to_plain("h").alias("t")), "t") == ['\na’b "c"\n x() \nT', "no tags <p"]
    assert "x()" not in one(row.select(T.html_to_plain("h", drop_scripts=True).alias("t")), "t")[0]


def test_trim_drops_whole_groups_at_last(spark):
    rows = [(1, 0, "head", "g", "core", 5, False), (1, 1, "bullet", "g", "filler", 10, False), (1, 2, "bullet", "h", "support", 10, False), (1, 3, "para", "p", "core", 10, True)]
    b = spark.createDataFrame(rows, "doc_id long, block_no int, type string, group_id string, strength string, cost long, droppable boolean")
    b = b.selectExpr("*", "0L AS bold_cost", "cost AS short_cost", "false AS added", "false AS soft")
    gone = lambda n: {(r["block_no"], r["para_dropped"], r["bullet_dropped"]) for r in gates.trim_to_budget(b, n).collect() if r["para_dropped"] or r["bullet_dropped"]}
    assert gone(25) == {(3, True, False)}
    assert gone(15) == {(3, True, False), (0, False, True), (1, False, True)}
    assert gates.trim_to_budget(b, 35).agg(F.max("overflow_left")).first()[0] == 0


def test_read_documents_and_rules(spark, tmp_path):
    import json

    (tmp_path / "a.txt").write_text("one – two\nthree")
    row = documents.read_documents(spark, f"file://{tmp_path}/a.txt", "text").first()
    assert row["path"].endswith("a.txt") and row["text"] == "one - two\nthree"
    rules = {"version": "1", "profiles": [{"id": "p", "priority": 1, "keywords": {"sql": 3}, "title_exclude": ["lead"], "include": ["f1", "f2"], "sections": [{"type": "t", "heading": "H"}]}], "groups": [{"id": "g", "strength": "core", "variants": [{"id": "v", "text": "x", "tags": ["sql"]}]}], "terms": {"never": ["a", "b"]}, "warnings": [{"id": "w", "pattern": "x", "severity": "block"}], "requirements": [{"id": "r", "held": "held", "patterns": ["y", "z"]}]}
    (tmp_path / "r.json").write_text(json.dumps(rules))
    got = documents.read_rules(spark, f"file://{tmp_path}/r.json")
    assert {k: v.count() for k, v in got.items()} == {"profiles": 1, "profile_terms": 2, "profile_includes": 2, "profile_sections": 1, "variants": 1, "variant_tags": 1, "variant_prefers": 0, "term_list": 2, "warning_rules": 1, "requirement_items": 2}
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(Exception):
        documents.read_rules(spark, f"file://{tmp_path}/bad.json")["term_list"].collect()


def test_upserts_merge_and_drop_old_versions(spark, tmp_path):
    from lineloom.streaming import inbox

    at = f"file://{tmp_path}/t"
    write = inbox.upsert_latest(at, "k", merge_every=3)
    want = {}
    for n in range(10):
        rows = [(f"k{n % 4}", n, f"v{n}"), ("hot", n, f"h{n}"), ("hot", n - 1, "old")]
        batch = spark.createDataFrame(rows, "k string, ts int, hash string")
        for _ in range(2 if n in (5, 8) else 1):  # batches that run again
            write(batch, n)
        want |= {f"k{n % 4}": f"v{n}", "hot": f"h{n}"}
        got = {r["k"]: r["hash"] for r in inbox.read_latest(spark, at, "k").collect()}
        assert got == want
    left = sorted(int(p.name.split("=")[1]) for p in (tmp_path / "t").glob("version=*"))
    assert left == [5, 6, 7, 8, 9]


def test_only_duty_lines_are_quoted(spark):
    rows = [(1, 0, "The office in Cork has a nice view", 1), (1, 1, "Prepare monthly VAT returns", 2), (1, 2, "Managing our team of ten people", 1), (1, 3, "Preparing reports is required", 1), (2, 0, "You will prepare the accounts", 1), (3, 0, "Reviews the files", 1), (3, 1, "Ensuring that all of it is filed", 1), (4, 0, "Support US and UK clients every day", 1), (4, 1, "Works with us every day", 1)]
    got = scoring.auto_quote(spark.createDataFrame(rows, "doc_id long, span_no int, quote string, strength int")).collect()
    assert {r["doc_id"]: (r["quote"], r["cost"]) for r in got} == {1: (rows[1][2], 22), 3: (rows[6][2], 10), 4: (rows[7][2], 12)}


def test_verdict_bands_are_on_the_years_required(spark):
    rows = [(1, 0, 3, 0, False, False, False), (2, 0, 6, 0, True, False, False), (3, 0, None, 0, False, True, True), (4, 1, None, 0, False, True, True), (5, 0, 1, 2, False, True, False)]
    out = {r["doc_id"]: (r["verdict"], r["reasons"], r["ambiguous"], r["discarded"]) for r in findings.fit_verdict(spark.createDataFrame(rows, "doc_id long, n_block int, required int, n_missing_tools int, skips boolean, vague boolean, all_discarded boolean")).collect()}
    assert out == {1: ("STRETCH", ["years_stretch"], False, False), 2: ("GOOD", [], False, False), 3: ("GOOD", [], True, True), 4: ("BLOCKED", [], False, False), 5: ("STRETCH", ["tools"], False, False)}


def test_grounding_of_number_words_and_names(spark):
    edited = spark.createDataFrame([(1, 0, "We led seven teams.", "line"), (1, 1, "Acme grew. Bravo and I saw Acme at 45.", "profile"), (2, 0, "Ten of them", "line"), (3, 0, None, "line")], "doc_id long, block_no int, text string, kind string")
    corpus = spark.createDataFrame([(1, "acme has 1045 people"), (1, "A twofold view")], "doc_id long, text string")
    openings = spark.createDataFrame([("Acme grew. It did",)], "text string")
    got = {(r["doc_id"], r["block_no"], r["detail"]) for r in gates.grounding_check(edited, corpus, openings).collect()}
    assert got == {(1, 0, "seven"), (1, 1, "45"), (2, 0, "Ten")}


def test_drops_prefer_groups_that_keep_a_bullet(spark):
    rows = [(1, 0, "head", "g", "core", 1), (1, 1, "bullet", "g", "filler", 10), (1, 2, "bullet", "g", "core", 10), (1, 3, "head", "h", "core", 1), (1, 4, "bullet", "h", "filler", 10), (2, 0, "bullet", None, "support", 7), (2, 1, "line", None, "core", 9)]
    df = spark.createDataFrame(rows, "doc_id long, block_no int, type string, group_id string, strength string, cost long")
    gone = lambda budget: {(r["doc_id"], r["block_no"]) for r in gates.drop_blocks(df, budget).filter("dropped").collect()}
    assert gone(30) == {(1, 1)}
    assert gone(12) == {(1, 1), (1, 3), (1, 4), (2, 0)}
    assert gates.drop_blocks(df.limit(0), 5).count() == 0


def test_notes_at_any_depth(spark):
    row = spark.sql("SELECT 1 AS id, map('a', 1, '_note', 2) AS m, map('k', named_struct('x', 1, '_y', 2)) AS n, map(1, map('_z', 1, 'q', 2)) AS o, CAST(NULL AS map<string,int>) AS p")
    out = documents.strip_notes(row).first().asDict(recursive=True)
    assert out == {"id": 1, "m": {"a": 1}, "n": {"k": {"x": 1}}, "o": {1: {"q": 2}}, "p": None}
    assert documents.strip_notes(row, ("_note", "_y")).first()["m"] == {"a": 1, "_note": 2}


def test_figures_in_their_own_case(spark):
    strings = spark.createDataFrame([("a", "Cut cost 40% Overall"), ("b", "cut 40% overall in Cork"), ("c", "a 40%"), ("d", "x 4 0%"), ("e", None)], "path string, text string")
    guards = spark.createDataFrame([("40%", ["Overall", "in Cork"], ["Cut", "cost"]), ("nothing", [], ["a"]), ("", ["z"], [])], "figure string, required array<string>, forbidden array<string>")
    got = {(r["key"], r["detail"]) for r in quality.figure_guards(strings, guards).collect()}
    assert got == {("a", "40%: forbidden phrase Cut"), ("a", "40%: forbidden phrase cost"), ("c", "40%: required phrase missing")}


def test_sections_carry_where_they_come_from(spark):
    from lineloom.operators import sections

    fact = "fact_id string, kind string, title string, org string, aside string, dates string, body string, items array<string>, relevant boolean, start_date date"
    facts = spark.sql("SELECT * FROM VALUES ('r1','role','Clerk',NULL,'','2020',NULL,NULL,true,DATE'2020-01-01'), ('r2','role','Cook','Inn',NULL,NULL,NULL,NULL,false,DATE'2022-01-01'), ('e1','education','BA',NULL,NULL,NULL,NULL,array('x',NULL,'y'),NULL,NULL), ('c1','certification',NULL,NULL,NULL,NULL,'told',array(),NULL,NULL), ('v1','volunteering',NULL,NULL,NULL,NULL,'helped',NULL,NULL,NULL) AS t(fact_id,kind,title,org,aside,dates,body,items,relevant,start_date)")
    assert [f.name for f in facts.schema] == [c.split()[0] for c in fact.split(", ")]
    includes = spark.createDataFrame([(1, 0, "r2"), (1, 1, "r1"), (1, 2, "gone"), (1, 3, "e1"), (1, 5, "c1"), (1, 4, "v1"), (2, 0, "e1")], "doc_id long, pos int, fact_id string")
    bullets = spark.createDataFrame([(1, "r1", 0, "b1", "Filed"), (1, "r1", 1, "b2", None), (1, "zz", 0, "b3", "nobody's")], "doc_id long, fact_id string, bullet_pos int, variant_id string, text string")
    rows = [(1, 0, "experience", "WORK", "s"), (1, 1, "project", "NONE", "s"), (1, 2, "education", "STUDY", "s"), (1, 3, "certifications", None, "s"), (2, 0, "hobbies", "FUN", "t")]
    wanted = spark.createDataFrame(rows, "doc_id long, pos int, type string, heading string, source_id string")
    parts = [sections.experience_blocks(includes, facts, bullets), sections.project_blocks(includes, facts, bullets), sections.education_blocks(includes, facts), sections.certification_blocks(includes, facts)]
    blocks = sections.assemble_sections(wanted, parts)
    got = {d: [(r["type"], r["text"]) for r in sorted(blocks.collect(), key=lambda r: r["block_no"]) if r["doc_id"] == d] for d in (1, 2)}
    assert got[1] == [("head", "WORK"), ("role", "Clerk"), ("dates", "2020"), ("bullet", "Filed"), ("role", "Cook"), ("org", "Inn"), ("head", "STUDY"), ("role", "BA"), ("para", "Modules: x, y"), ("para", "told"), ("para", "helped")]
    assert got[2] == [("unknown", "hobbies")]
    sources = sections.fact_sources(facts).unionByName(sections.heading_sources(wanted)).unionByName(bullets.select(F.col("variant_id").alias("source_id"), F.lit("text").alias("source_field"), "text"))
    check = lambda b, s: {(r["doc_id"], r["block_no"], r["detail"]) for r in gates.check_carried(b, s, sections.BLOCK_TYPES).collect()}
    assert check(blocks, sources) == {(2, 0, "unknown type")}
    changed = blocks.withColumn("text", F.when(F.col("text") == "Modules: x, y", "Modules: x").otherwise(F.col("text")))
    assert check(changed, sources.filter("source_id <> 'b1'")) == {(2, 0, "unknown type"), (1, 8, "text differs"), (1, 3, "missing source")}
    assert sections.assemble_sections(wanted.limit(0), parts).count() == 0


def test_blocks_of_all_facts_are_those_of_their_builders(spark):
    from lineloom.operators import sections

    facts = spark.sql("SELECT * FROM VALUES ('r1','role','Clerk',NULL,'','2020',NULL,NULL,true,DATE'2020-01-01'), ('r2','role','Cook','Inn',NULL,NULL,NULL,NULL,false,DATE'2022-01-01'), ('p1','project','Hall','City','by hand',NULL,NULL,NULL,NULL,NULL), ('e1','education','BA',NULL,NULL,NULL,NULL,array('x',NULL,'y'),NULL,NULL), ('c1','certification',NULL,NULL,NULL,NULL,'told',array('q'),NULL,NULL), ('v1','volunteering',NULL,NULL,NULL,NULL,'helped',NULL,NULL,NULL), ('o1','other','no',NULL,NULL,NULL,NULL,NULL,NULL,NULL) AS t(fact_id,kind,title,org,aside,dates,body,items,relevant,start_date)")
    # a project comes twice, and with it its bullets; a degree's and nobody's bullets make none
    rows = [(1, 0, "r2"), (1, 1, "r1"), (1, 2, "gone"), (1, 3, "e1"), (1, 5, "c1"), (1, 4, "v1"), (1, 6, "p1"), (1, 7, "p1"), (1, 8, "o1"), (2, 0, "e1"), (2, 1, "p1"), (None, 0, "r1")]
    includes = spark.createDataFrame(rows, "doc_id long, pos int, fact_id string")
    told = [(1, "r1", 0, "b1", "Filed"), (1, "r1", 1, "b2", None), (1, "zz", 0, "b3", "nobody's"), (1, "p1", 0, "b4", "Built"), (1, "e1", 0, "b5", "Read"), (3, "p1", 0, "b6", "Else"), (None, "r1", 0, "b7", "None")]
    bullets = spark.createDataFrame(told, "doc_id long, fact_id string, bullet_pos int, variant_id string, text string")
    wanted = [sections.experience_blocks(includes, facts, bullets), sections.project_blocks(includes, facts, bullets), sections.education_blocks(includes, facts), sections.certification_blocks(includes, facts)]
    listed = lambda df: sorted(str(r.asDict(recursive=True)) for r in (df if "last" in df.columns else df.withColumn("last", F.lit(0))).select(*sections.BLOCK, "last").collect())
    made = sections.fact_blocks(includes, facts, bullets)
    assert listed(made) == sorted(r for w in wanted for r in listed(w))
    # the includes and the facts meet in one join
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_right_blocks_of_one_atom_are_not_grouped(spark):
    from lineloom.operators import gates

    one = lambda *a: [{"source_id": x, "source_field": "f"} for x in a]
    rows = [(1, 0, "para", "A", "", "", one("a")), (1, 1, "para", "p: A", "p: ", "", one("a")), (1, 2, "para", "A!", "", "", one("a")), (1, 3, "odd", "A", "", "", one("a")), (1, 4, "para", "A", "", "", one("z")), (1, 5, "para", "A, B", "", ", ", one("a", "b")), (1, 6, "para", "A", "", ", ", one("a", "b")), (1, 7, "para", "A", None, None, []), (1, 8, "", "", "", "", [])]
    blocks = spark.createDataFrame(rows, "doc_id long, block_no int, type string, text string, prefix string, joiner string, atoms array<struct<source_id:string,source_field:string>>")
    sources = spark.createDataFrame([("a", "f", "A"), ("b", "f", "B")], "source_id string, source_field string, text string")
    out = gates.check_carried(blocks, sources, ("para",))
    assert {(r["block_no"], r["detail"]) for r in out.collect()} == {(2, "text differs"), (3, "unknown type"), (4, "missing source"), (6, "text differs"), (7, "missing source")}
    grouped = out._jdf.queryExecution().optimizedPlan().toString().split("Aggregate", 1)[1]
    assert "Filter" in grouped.split("Join", 1)[0]


def test_a_gap_that_is_named_is_dropped(spark):
    docs = spark.createDataFrame([(1, False, 0), (2, False, 0), (3, True, 0), (4, False, 1), (5, None, None)], "doc_id long, mismatch boolean, years_short int")
    found = spark.createDataFrame([(1, "w", 1), (2, "w", 1), (2, "x", 2), (3, "w", 1)], "doc_id long, rule_id string, rule_no int")
    named = spark.createDataFrame([("g", "cold calls"), ("years", "young")], "gap string, term string")
    told = spark.createDataFrame([(2, "I made Cold calls."), (3, "cold calls"), (4, None), (1, "cold callsign")], "doc_id long, text string")
    out = scoring.gap_choice(docs, found, {"w": "g", "x": "h"}, named, told)
    assert {r["doc_id"]: r["gap"] for r in out.collect()} == {1: "g", 2: None, 3: "mismatch", 4: "years", 5: None}
    marks = docs.select(scoring.fact_markers(F.lit("A Kitchen"), ("night", "kitchen")).alias("m")).first()["m"]
    assert marks == [1]


def test_may_hold(spark):
    """Left out is only what match_tags finds nothing in."""
    texts = ["An accounting degree.", "Accounts; degrees", "A driving licence", "nothing here", "", "of the", "Version 2 0 now", "3 men", None]
    s = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id long, span_no int, text string")
    for phrases, left in ((["accounting degree"], {0, 1}), (["driving licence", "version 2 0"], {2, 6, 7}), (["of the"], set()), ([], set())):
        tags = spark.createDataFrame([(p, p) for p in phrases], "tag string, phrase string")
        kept = matching.may_hold(s, tags.select("phrase"))
        assert {r["doc_id"] for r in kept.collect()} == left
        assert sorted(matching.match_tags(s, tags).collect()) == sorted(matching.match_tags(kept, tags).collect())


def test_word_boundaries_are_ascii(spark):
    # "our" stands before a letter with an accent: a word by the rules, which know letters of ASCII only
    rows = [(1, 0, "Au ouré mentç des les", 3), (2, 0, "Au pouré mentç des les", 3)]
    got = scoring.auto_quote(spark.createDataFrame(rows, "doc_id long, span_no int, quote string, strength int"), ("a",)).collect()
    assert [(r["doc_id"], r["cost"]) for r in got] == [(2, 30)]
    assert one(spark.createDataFrame([("éus",), ("éu s",)], "t string").select(F.col("t").rlike(T.ascii_words(r"\bus\b")).alias("x")), "x") == [True, False]


def test_sentences_begin_where_spans_do(spark):
    texts = ["A b. C!\n\n  . ? d e ...f\r\nThe role\nlast", "...", " x\t\n", "About us\nWe pay. Much!\nRequirements:\n9. go", "One. Two.\n" * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    place = lambda df: sorted(tuple(r) for r in df.select("doc_id", "line_no", "span_no", "start", "end", "text").collect())
    assert place(lines.classify_sentences(docs)) == place(lines.split_spans(docs))


def test_tags_read_sentences_once(spark):
    rows = [(1, 0, "It held 2 0 of c++ and works"), (1, 1, "12 0 is 2 and 0"), (2, 0, "go, Working on C++: 2+0"), (3, 0, None)]
    s = spark.createDataFrame(rows, "doc_id long, span_no int, text string")
    tags = spark.createDataFrame([("n", "2 0"), ("w", "working c++"), ("g", "go"), ("none", "the of")], "tag string, phrase string")
    assert sorted(tuple(r) for r in matching.match_tags(s, tags).collect()) == [(1, 0, "n"), (1, 0, "w"), (2, 0, "g"), (2, 0, "w")]
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = matching.keyword_hits(lines.classify_sentences(docs), tags)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode") == 2  # lines and their sentences; four times as long as words and literals each read them


def test_letters_are_made_in_one_row_a_document(spark):
    e = [(d, f"v{i}", i, "AB"[i % 2], t, 3 - i, i == 0) for d in (1, 2) for i, t in enumerate(("a project", "a Project again", "saved 9 hours"))]
    evidence = spark.createDataFrame(e, "doc_id long, variant_id string, pos int, family string, text string, overlap int, lead boolean")
    why = spark.createDataFrame([(1, "w0", 0, "my thesis project", 1, "k"), (1, "w1", 1, "plain words", 1, "k"), (3, "w0", 0, "in 9 hours", 1, "k")], "doc_id long, variant_id string, pos int, text string, overlap int, key string")
    docs = spark.createDataFrame([(1, True, 0), (2, False, 2), (3, False, 0), (4, True, 0)], "doc_id long, mismatch boolean, years_short int")
    found = spark.createDataFrame([(3, "R", 0)], "doc_id long, rule_id string, rule_no int")
    gaps = spark.createDataFrame([("mismatch", "Off."), ("years", "Short of {{N}}."), ("r", "Back.")], "gap string, template string")
    named = spark.createDataFrame([("mismatch", "plain word"), ("years", "proj*"), ("r", "9 hour*")], "gap string, term string")
    fixed = spark.createDataFrame([(d, "close", 0, "Yours") for d in (1, 2, 3, 4)], "doc_id long, part string, pos long, template string")
    slots = spark.createDataFrame([(d, {"N": "2"}) for d in (1, 2, 3)], "doc_id long, slots map<string,string>")
    out = scoring.compose_letter(docs, evidence, why, found, {"R": "r"}, gaps, named, fixed, slots)
    assert sorted(out.collect()) == [(1, 0, "why", "plain words"), (1, 1, "evidence", "a project"), (1, 2, "gap", "Off."), (1, 3, "close", "Yours"), (2, 0, "evidence", "a project"), (2, 1, "close", "Yours"), (3, 0, "why", "in 9 hours"), (3, 1, "close", "Yours")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join FullOuter" not in plan


def test_word_boundaries_of_ascii(spark):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(("xthesis", "éthesis x", "thesis1", "my 3 days", "13 days", "bx"))], "i int, t string")
    for pattern, held in ((r"\bthesis\b", {1}), (r"\b3 days\b", {3}), (r"\b[0-9]+ days", {3, 4}), (r"\ba?b?x", {0, 1, 5})):
        assert set(one(texts.filter(F.col("t").rlike(T.ascii_words(pattern))), "i")) == held


def test_a_document_is_trimmed_in_one_row(spark):
    shape = "doc_id long, block_no int, type string, group_id string, strength string, cost int, bold_cost int, short_cost int, droppable boolean, added boolean, soft boolean"
    rows = [(1, 0, "head", "g", None, 5, None, None, None, None, None), (1, 1, "bullet", "g", "filler", 10, 3, 6, False, False, False), (1, 2, "bullet", "g", "core", 10, 3, None, False, False, False), (1, 3, "para", None, None, 8, 0, 8, True, False, None), (1, 4, "term", None, None, 4, None, 1, None, True, True), (2, 0, "para", None, None, 9, 1, 2, True, True, True)]
    out = gates.trim_to_budget(spark.createDataFrame(rows, shape), 9)
    got = {(r[0], r[1]): tuple(r)[2:] for r in out.collect()}
    assert got == {(1, 0): (False, False, False, False, False, 0), (1, 1): (True, True, False, False, True, 0), (1, 2): (True, False, False, False, False, 0), (1, 3): (False, False, True, False, False, 0), (1, 4): (False, True, False, True, False, 0), (2, 0): (False, False, False, False, False, 0)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan


def test_few_names_are_found_without_a_shuffle(spark):
    text = " ".join(f"w{i} Of the OF x" for i in range(40))
    docs = spark.createDataFrame([(1, text), (1, "the end"), (2, None), (None, "of")], "doc_id long, text string")
    gazetteer = spark.createDataFrame([("of the", "B"), ("of", "A"), ("none", "C")], "name string, canonical string")
    out = matching.place_mentions(docs, gazetteer)
    got = [r for r in sorted(map(tuple, out.filter("doc_id = 1").collect()))]
    assert len(got) == 80 and [r[1] for r in got] == list(range(80))
    assert all(text[s:e] == name and c == ("B" if " " in name else "A") for _, _, s, e, name, c in got)
    assert one(out.filter("doc_id IS NULL"), "canonical") == ["A"]
    plan = matching.places_in(docs, gazetteer)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" not in plan
    sizes = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 2, 5, 9, 10, 50)], "xs array<int>")
    assert all(r["s"] == [sum(r["xs"][: i + 1]) for i in range(len(r["xs"]))] for r in sizes.select("xs", matching.running(F.col("xs")).alias("s")).collect())


def test_fields_are_read_once(spark, ads):
    for made, pattern in ((extract.extract_company(ads), extract.ABOUT_COMPANY), (extract.extract_team(ads), extract.TEAM_RUN)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        before = plan[: plan.index("Generate")]
        assert pattern not in before and "Generate explode" in plan
        assert [x for x in plan.splitlines() if "Filter" in x and pattern in x] == []


def test_customers_texts_are_dealt_out(spark):
    from lineloom.plans import rule_queries

    assert rule_queries.ads_of(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
