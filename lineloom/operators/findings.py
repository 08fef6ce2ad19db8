"""Requirement and fit findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lineloom import vocab
from lineloom.functions.text import ascii_words, col, normalize
from lineloom.operators.extract import number_candidates, outside_region, states_salary
from lineloom.operators.lines import split_clauses
from lineloom.operators.matching import bounded, first_accepted_match, match_tags, may_hold

CLASS_RANK = {"ambiguous": 0, "preferred": 1, "required": 2}


def holds(c: str | Column, patterns) -> Column:
    return col(c).rlike(ascii_words(f"(?i){'|'.join(patterns)}"))


def _ranked(c: str) -> Column:
    out = F.when(F.col(c) == "required", 2).when(F.col(c) == "preferred", 1)
    return out.otherwise(0)


def clause_class(clauses: DataFrame) -> DataFrame:
    """G1: `class` and `explicit` of clauses(doc_id, span_no, clause_no, clause, requirement): preferred words here,
    required words here, preferred words in the next clause, a requirement heading, else ambiguous."""
    order = W.partitionBy("doc_id", "span_no").orderBy("clause_no")
    preferred, required = holds("clause", vocab.PREFERRED), holds("clause", vocab.REQUIRED)
    rows = clauses.withColumn("_p", preferred)
    rows = rows.withColumn("_next", F.coalesce(F.lead("_p").over(order), F.lit(False)))
    kind = F.when(F.col("_p"), "preferred").when(required, "required").when(F.col("_next"), "preferred").when(F.col("requirement"), "required").otherwise("ambiguous")
    return rows.withColumn("class", kind).withColumn("explicit", F.col("_p") | required | F.col("_next")).drop("_p", "_next")


def sentence_class(text: str | Column, requirement: Column) -> Column:
    """The same of a whole sentence."""
    return F.when(holds(text, vocab.PREFERRED), "preferred").when(holds(text, vocab.REQUIRED), "required").when(requirement, "required").otherwise("ambiguous")


def regulatory_upgrade(docs: DataFrame, pattern: str = vocab.REGULATORY) -> DataFrame:
    """(doc_id, upgraded)."""
    return docs.select("doc_id", F.coalesce(F.col("text").rlike(ascii_words(f"(?i){pattern}")), F.lit(False)).alias("upgraded"))


def requirement_findings(docs: DataFrame, spans: DataFrame, items: DataFrame) -> DataFrame:
    """Per document and item that isn't held, its best reading: explicit before implied, then required, preferred,
    ambiguous, then the first; red where required and not held, else amber. spans(doc_id, span_no, text, requirement),
    items(item_id, phrase, held, qualification)."""
    wanted = items.filter("held <> 'held'")
    clauses = clause_class(split_clauses(may_hold(spans, wanted.select("phrase"))))
    keyed = clauses.select(F.struct("doc_id", "span_no", "clause_no").alias("doc_id"), F.lit(0).alias("span_no"), F.col("clause").alias("text"))
    hits = match_tags(keyed, wanted.select(F.col("item_id").alias("tag"), "phrase")).select("doc_id.*", F.col("tag").alias("item_id"))
    rows = hits.join(clauses, ["doc_id", "span_no", "clause_no"]).join(bounded(wanted.select("item_id", "held", "qualification").distinct()), "item_id")
    rows = rows.join(regulatory_upgrade(docs), "doc_id")
    raised = F.col("upgraded") & F.col("qualification") & (F.col("class") == "ambiguous")
    rows = rows.withColumn("class", F.when(raised, "required").otherwise(F.col("class")))
    order = W.partitionBy("doc_id", "item_id").orderBy(F.desc("explicit"), F.desc(_ranked("class")), "span_no", "clause_no")
    rows = rows.withColumn("_r", F.row_number().over(order)).filter("_r = 1")
    severity = F.when((F.col("held") == "not_held") & (F.col("class") == "required"), "red").otherwise("amber")
    return rows.select("doc_id", F.col("item_id").alias("id"), "class", "explicit", severity.alias("severity"), F.col("clause").alias("quote"), "span_no")


def number_findings(sentences: DataFrame, most: int = 1) -> DataFrame:
    """Valid figures over `most`, once for each different sentence, the first place of it."""
    found = number_candidates(sentences).filter(F.col("valid") & (F.col("value") > most))
    order = W.partitionBy("doc_id", "quote").orderBy("span_no", "no")
    return found.withColumn("_r", F.row_number().over(order)).filter("_r = 1").select("doc_id", F.lit("years").alias("id"), F.lit("amber").alias("severity"), "quote", "span_no", "value")


def future_sponsorship(sentences: DataFrame) -> DataFrame:
    """The first sentence with sponsorship near 'now or in the future'."""
    pattern = r"(?i)\bsponsorship\b.{0,60}\bnow or in the future\b|\bnow or in the future\b.{0,60}\bsponsorship\b"
    rows = sentences.filter(F.col("text").rlike(ascii_words(pattern)))
    return rows.groupBy("doc_id").agg(F.min_by("text", "span_no").alias("quote"), F.min("span_no").alias("span_no")).select("doc_id", F.lit("sponsorship").alias("id"), F.lit("amber").alias("severity"), "quote", "span_no")


def eligibility(docs: DataFrame, findings: list[DataFrame]) -> DataFrame:
    """RED with any red finding, AMBER with any other, else GREEN."""
    every = None
    for f in findings:
        one = f.select("doc_id", "severity")
        every = one if every is None else every.unionByName(one)
    worst = every.groupBy("doc_id").agg(F.max(F.when(F.col("severity") == "red", 2).otherwise(1)).alias("w"), F.count(F.lit(1)).alias("n"))
    out = docs.select("doc_id").join(worst, "doc_id", "left")
    return out.select("doc_id", F.when(F.col("w") == 2, "RED").when(F.col("w") == 1, "AMBER").otherwise("GREEN").alias("verdict"), F.coalesce("n", F.lit(0)).alias("n_findings"))


def warning_findings(sentences: DataFrame, rules: list[dict], years_ok: DataFrame | None = None) -> DataFrame:
    """The first accepted match of each rule(id, pattern, severity, needs_years). A rule that needs years passes over
    sentences without a valid figure of years_ok(doc_id, quote, valid)."""
    strict = tuple(r["id"] for r in rules if r.get("needs_years"))
    accepted = None
    if years_ok is not None and strict:
        ok = years_ok.filter("valid").select("doc_id", F.col("quote").alias("text"), F.lit(True).alias("_figure")).distinct()
        # only sentences that a rule finds are joined
        any_rule = F.lit(False)
        for r in rules:
            any_rule = any_rule | F.col("text").rlike(ascii_words(f"(?i){r['pattern']}"))
        sentences, accepted = sentences.filter(F.col("matchable") & any_rule).join(ok, ["doc_id", "text"], "left"), F.col("_figure")
    found = first_accepted_match(sentences, [(r["id"], r["pattern"]) for r in rules], accepted, strict)
    severity = F.create_map(*(F.lit(x) for r in rules for x in (r["id"], r["severity"])))
    return found.withColumn("severity", F.element_at(severity, F.col("rule_id")))


def severity_by_wording(findings: DataFrame, docs: DataFrame, wording: dict[str, dict]) -> DataFrame:
    """wording[rule_id] may hold `held` (a pattern that drops the finding if anywhere in the document) and `hedge`
    (a pattern in the quote that lowers the severity to `hedged`)."""
    rows = findings.join(docs.select("doc_id", F.col("text").alias("_doc")), "doc_id")
    severity = F.col("severity")
    for rule, w in wording.items():
        mine = F.col("rule_id") == rule
        if "held" in w:
            rows = rows.filter(~(mine & F.col("_doc").rlike(f"(?i){w['held']}")))
        if "hedge" in w:
            severity = F.when(mine & F.col("quote").rlike(f"(?i){w['hedge']}"), w["hedged"]).otherwise(severity)
    return rows.withColumn("severity", severity).drop("_doc")


def outcome_summary(log: DataFrame) -> DataFrame:
    """log(rule_id, date, outcome) by rule."""
    return log.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") == "rejected").alias("n_rejected"), F.max("date").alias("latest"))


def skip_experience(profile: str | Column, text: str | Column, profiles=("graduate",), pattern: str = r"no (?:prior )?experience (?:is )?(?:required|needed)|graduate (?:programme|program|scheme)") -> Column:
    """By profile or by language."""
    return F.coalesce(col(profile).isin(*profiles), F.lit(False)) | col(text).rlike(ascii_words(f"(?i){pattern}"))


def ambiguous_experience(text: str | Column, required: str | Column, pattern: str = r"\b(?:some|relevant|previous|proven|significant|solid|strong) experience\b") -> Column:
    """Vague wording and no figure."""
    return col(text).rlike(ascii_words(f"(?i){pattern}")) & col(required).isNull()


def fit_verdict(docs: DataFrame, stretch: int = 2, reach: int = 5, missing_tools: int = 2) -> DataFrame:
    """docs(doc_id, n_block, required, n_missing_tools[, skips, vague, all_discarded]) -> BLOCKED, STRETCH with reasons, or
    GOOD. The bands are tested on the years required, unless the test of years is skipped (G11). `ambiguous`: no figure, but
    vague wording (G12) and no skip; `discarded`: there were figures and none was valid. Blocked documents have neither."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in docs.columns else F.lit(False)
    y, m = F.when(~flag("skips"), F.col("required")), F.coalesce("n_missing_tools", F.lit(0))
    reasons = F.filter(F.array(F.when(y >= reach, "years_reach"), F.when((y >= stretch) & (y < reach), "years_stretch"), F.when(m >= missing_tools, "tools")), lambda x: x.isNotNull())
    blocked = F.coalesce("n_block", F.lit(0)) > 0
    verdict = F.when(blocked, "BLOCKED").when(F.size(reasons) > 0, "STRETCH").otherwise("GOOD")
    ambiguous = ~blocked & ~flag("skips") & F.col("required").isNull() & flag("vague")
    return docs.select("doc_id", verdict.alias("verdict"), F.when(blocked, F.array().cast("array<string>")).otherwise(reasons).alias("reasons"), ambiguous.alias("ambiguous"), (~blocked & flag("all_discarded")).alias("discarded"))


def keyword_table(sources: list[DataFrame], held: DataFrame, output: DataFrame) -> DataFrame:
    """A row for each document and term of sources(doc_id, term), by source order: have (yes, no, in progress) from
    held(term, have), and whether output(doc_id, term) has it."""
    every = None
    for i, s in enumerate(sources):
        one = s.select("doc_id", F.lower("term").alias("term"), F.lit(i).alias("src"))
        every = one if every is None else every.unionByName(one)
    rows = every.groupBy("doc_id", "term").agg(F.min("src").alias("src"))
    rows = rows.join(held.select(F.lower("term").alias("term"), "have").dropDuplicates(["term"]), "term", "left")
    rows = rows.join(output.select("doc_id", F.lower("term").alias("term"), F.lit(True).alias("made_it")).distinct(), ["doc_id", "term"], "left")
    return rows.select("doc_id", "term", "src", F.coalesce("have", F.lit("no")).alias("have"), F.coalesce("made_it", F.lit(False)).alias("made_it"))


def months_inclusive(start: str | Column, end: str | Column) -> Column:
    """Months between the calendar months, and one more where the last day of the month reaches the first's."""
    s, e = col(start), col(end)
    months = (F.year(e) - F.year(s)) * 12 + F.month(e) - F.month(s)
    return (months + F.when(F.dayofmonth(e) >= F.dayofmonth(s), 1).otherwise(0)).cast("int")


def experience_months(employment: DataFrame, as_of: str) -> DataFrame:
    """Per person months of relevant, other professional and other work; open jobs end on as_of."""
    m = months_inclusive("start_date", F.coalesce("end_date", F.lit(as_of).cast("date")))
    rows = employment.withColumn("m", m)
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("m"))), F.lit(0)).cast("long")
    return rows.groupBy("person_id").agg(total(F.col("relevant")).alias("relevant"), total(F.col("full_time")).alias("professional"), total(~F.col("full_time") & ~F.col("relevant")).alias("other"))


def overall_verdict(docs: DataFrame, findings: list[DataFrame]) -> DataFrame:
    """Red, amber or green over all checks; reasons once for each normal form of their quote, red first, then by
    check and place. findings(doc_id, severity, quote, span_no)."""
    every = None
    for i, f in enumerate(findings):
        one = f.select("doc_id", "severity", "quote", "span_no", F.lit(i).alias("src"))
        every = one if every is None else every.unionByName(one)
    rank = F.when(F.col("severity") == "red", 0).otherwise(1)
    rows = every.withColumn("rank", rank).withColumn("norm", normalize("quote"))
    once = W.partitionBy("doc_id", "norm").orderBy("rank", "src", "span_no")
    rows = rows.withColumn("_r", F.row_number().over(once)).filter("_r = 1")
    reasons = F.transform(F.array_sort(F.collect_list(F.struct("rank", "src", "span_no", "quote"))), lambda x: x["quote"])
    out = docs.select("doc_id").join(rows.groupBy("doc_id").agg(F.min("rank").alias("w"), reasons.alias("reasons")), "doc_id", "left")
    return out.select("doc_id", F.when(F.col("w") == 0, "red").when(F.col("w") == 1, "amber").otherwise("green").alias("verdict"), F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"))


def fit_check(docs: DataFrame, warnings: DataFrame, required: DataFrame, tools: DataFrame, held_years: int, profile: str | None = None, keywords: DataFrame | None = None, months: DataFrame | None = None) -> DataFrame:
    """Years required and short, warnings, missing tools, whether the test of years is skipped, the verdict with its reasons
    and flags in one row a document; `keywords`, how many of G14's rows are held and how many there are, and `months`, G15's
    relevant ones, where these are given. docs(doc_id, text[, profile column]), required is E2's result."""
    blocks = warnings.groupBy("doc_id").agg(F.count_if(F.col("severity") == "block").alias("n_block"), F.count(F.lit(1)).alias("n_warnings"))
    who = F.col(profile) if profile else F.lit(None).cast("string")
    rows = docs.select("doc_id", skip_experience(who, "text").alias("skips"), F.col("text").alias("_t")).join(required.select("doc_id", "required", "all_discarded"), "doc_id", "left").join(blocks, "doc_id", "left")
    rows = rows.join(tools.select("doc_id", F.size("confirmed_missing").alias("n_missing_tools")), "doc_id", "left")
    rows = rows.withColumn("vague", ambiguous_experience("_t", "required")).drop("_t")
    rows = rows.withColumn("years_short", F.greatest(F.lit(0), F.coalesce("required", F.lit(0)) - held_years))
    out = rows.select("doc_id", "required", "years_short", F.coalesce("n_warnings", F.lit(0)).alias("n_warnings"), F.coalesce("n_missing_tools", F.lit(0)).alias("n_missing_tools"), "skips").join(fit_verdict(rows), "doc_id")
    if keywords is not None:
        held = keywords.groupBy("doc_id").agg(F.struct(F.count_if(F.col("have") == "yes").alias("held"), F.count(F.lit(1)).alias("asked")).alias("keywords"))
        out = out.join(held, "doc_id", "left")
    if months is not None:
        out = out.join(months.select(F.col("person_id").alias("doc_id"), F.col("relevant").alias("months")), "doc_id", "left")
    return out


def form_answers(docs: DataFrame, fixed: dict[str, str], buckets: DataFrame, regional: str = "regional") -> DataFrame:
    """The fixed answers and one about salary: the advertised range if the text states one, else the bucket of the
    profile, or the regional one outside the home regions. docs(doc_id, text, profile_id, city), buckets(bucket, salary),
    a bucket a profile."""
    rows = docs.withColumn("bucket", F.when(outside_region("city"), regional).otherwise(F.col("profile_id")))
    rows = rows.join(bounded(buckets), "bucket", "left")
    salary = F.when(states_salary("text"), "the advertised range").when(F.col("bucket").isNull(), "no profile").otherwise(F.coalesce("salary", F.lit("not saved")))
    return rows.select("doc_id", *(F.lit(v).alias(k) for k, v in fixed.items()), salary.alias("salary_answer"))
