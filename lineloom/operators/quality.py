"""Data-quality rules (J1-J19). Each returns violations (rule, key, detail); an empty table is a pass."""

from __future__ import annotations

from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineloom.functions.text import col
from lineloom.operators.matching import MOST_RULES, bounded, find_quotes, match_terms


def violations(df: DataFrame, rule: str, key: str | Column, detail: str | Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), col(key).cast("string").alias("key"), col(detail).cast("string").alias("detail"))


def dangling(child: DataFrame, key: str, ref: str, parent: DataFrame, parent_key: str, rule: str = "dangling") -> DataFrame:
    """References that no row of the parent has; null references aren't references."""
    p = parent.select(F.col(parent_key).alias("_p")).distinct()
    bad = child.filter(F.col(ref).isNotNull()).join(p, F.col(ref) == F.col("_p"), "left_anti")
    return violations(bad, rule, key, ref)


def coverage(parents: DataFrame, key: str, rows: DataFrame, ref: str, least: int = 1, most: int | None = None, rule: str = "coverage") -> DataFrame:
    """Parents with fewer rows than `least` or more than `most`."""
    n = rows.groupBy(F.col(ref).alias(key)).agg(F.count(F.lit(1)).alias("n"))
    counted = parents.select(key).distinct().join(n, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    bad = counted.filter((F.col("n") < least) | (F.col("n") > most if most is not None else F.lit(False)))
    return violations(bad, rule, key, "n")


def domain(df: DataFrame, key: str, column: str, allowed: Iterable, rule: str = "domain") -> DataFrame:
    """Values out of a list; null is out."""
    return violations(df.filter(~F.coalesce(F.col(column).isin(*allowed), F.lit(False))), rule, key, column)


def too_short(df: DataFrame, key: str, column: str, least: int = 20, rule: str = "too_short") -> DataFrame:
    """Texts under a length; null is the empty text."""
    return violations(df.filter(F.length(F.trim(F.coalesce(column, F.lit("")))) < least), rule, key, F.length(F.coalesce(column, F.lit(""))))


def first_sentence(df: DataFrame, key: str, column: str, pattern: str, rule: str = "first_sentence") -> DataFrame:
    """Texts whose first sentence doesn't match."""
    one = F.regexp_extract(column, r"^\s*([^.!?]+[.!?]?)", 1)
    return violations(df.filter(~F.coalesce(one.rlike(pattern), F.lit(False))), rule, key, one)


def first_word(df: DataFrame, key: str, column: str, verbs: DataFrame, rule: str = "first_word") -> DataFrame:
    """Texts whose first word, case aside, isn't in verbs(verb)."""
    rows = df.select(key, F.lower(F.regexp_extract(column, r"^\s*([A-Za-z']+)", 1)).alias("w"))
    return violations(rows.join(verbs.select(F.lower("verb").alias("w")), "w", "left_anti"), rule, key, "w")


def short_wildcards(terms: DataFrame, least: int = 6, rule: str = "short_wildcard") -> DataFrame:
    """Wildcard terms under so many characters, the mark aside."""
    return violations(terms.filter(F.col("term").endswith("*") & (F.length("term") - 1 < least)), rule, "term", F.length("term") - 1)


def own_word(terms: DataFrame, asks: DataFrame, rule: str = "own_word") -> DataFrame:
    """terms(term_id, term) that hold none of their asks(term_id, word)."""
    v = asks.select(F.col("word").alias("term")).distinct()
    found = match_terms(terms.select(F.col("term_id").alias("doc_id"), F.col("term").alias("text")), v, joined=True)
    has = found.join(asks, (found["doc_id"] == asks["term_id"]) & (found["term"] == asks["word"])).select("term_id")
    return violations(terms.join(asks.select("term_id").distinct(), "term_id", "left_semi").join(has, "term_id", "left_anti"), rule, "term_id", "term")


def highlights(variants: DataFrame, rule: str = "highlight") -> DataFrame:
    """Of variants(variant_id, text, phrases, tags): phrases that the text lacks, that hold a digit, or that share no
    word with the text's own tags."""
    rows = variants.select("variant_id", "text", F.explode("phrases").alias("p"), F.lower(F.array_join("tags", " ")).alias("t"))
    words = lambda c: F.split(F.lower(col(c)), "[^a-z0-9]+")
    why = F.when(~F.contains("text", "p"), "not in text").when(F.col("p").rlike("[0-9]"), "digit").when(F.size(F.array_intersect(words("p"), words("t"))) == 0, "no own tag")
    return violations(rows.withColumn("why", why).filter("why IS NOT NULL"), rule, "variant_id", F.concat_ws(": ", "why", "p"))


def single_word_tags(tags: DataFrame, rule: str = "single_word_tag") -> DataFrame:
    """Tags of one word that aren't acronyms of two to six capitals."""
    return violations(tags.filter(~F.col("tag").rlike(r"\s") & ~F.col("tag").rlike("^[A-Z]{2,6}$")), rule, "tag", "tag")


def figure_guards(strings: DataFrame, guards: DataFrame, rule: str = "figure_guard") -> DataFrame:
    """strings(path, text) that hold a guard's figure, in its own case, without one of its required phrases, or with a
    forbidden one; a row a fault. guards(figure, required, forbidden) may have any size: the figures are looked up in an
    index of the strings (matching.find_quotes), and only what is met is compared."""
    g = guards.filter(F.col("figure") != "").select("figure", F.coalesce("required", F.array().cast("array<string>")).alias("required"), F.coalesce("forbidden", F.array().cast("array<string>")).alias("forbidden"))
    met = find_quotes(strings.select(F.col("path").alias("doc_id"), "text"), g.select(F.col("figure").alias("quote_id"), F.col("figure").alias("quote")).distinct())
    met = met.select(F.col("doc_id").alias("_path"), F.col("quote_id").alias("figure")).distinct()
    rows = strings.select("path", "text").join(met, F.col("path").eqNullSafe(F.col("_path"))).join(g, "figure").filter(F.contains("text", F.col("figure")))
    held = lambda p: F.contains("text", p)
    missing = F.when((F.size("required") > 0) & ~F.exists("required", held), F.lit("required phrase missing"))
    present = F.transform(F.filter("forbidden", held), lambda p: F.concat(F.lit("forbidden phrase "), p))
    faults = F.filter(F.concat(F.array(missing), present), lambda x: x.isNotNull())
    return violations(rows.withColumn("why", F.explode(faults)), rule, "path", F.concat_ws(": ", "figure", "why"))


FACTS = r"(?<![A-Za-z0-9])[0-9][0-9.,%]*|\b[A-Z][A-Za-z]+"


def short_adds_nothing(variants: DataFrame, rule: str = "short_adds") -> DataFrame:
    """Figures and capitalised words of the short form that the full text lacks; its first word may be new."""
    found = lambda c: F.regexp_extract_all(c, F.lit(FACTS), F.lit(0))
    extra = F.array_except(found("short_text"), F.array_union(found("text"), F.array(F.regexp_extract("short_text", r"^\s*([A-Z][A-Za-z]+)", 1))))
    rows = variants.filter("short_text IS NOT NULL").withColumn("extra", extra)
    return violations(rows.filter(F.size("extra") > 0), rule, "variant_id", F.array_join("extra", ", "))


def date_order(df: DataFrame, key: str, start: str, end: str, rule: str = "dates") -> DataFrame:
    """Dates (as text) that aren't dates, or end before they start; an empty end is open."""
    s, e = F.try_to_date(F.col(start), "yyyy-MM-dd"), F.try_to_date(F.col(end), "yyyy-MM-dd")
    why = F.when(s.isNull(), "bad start").when(F.col(end).isNotNull() & e.isNull(), "bad end").when(e < s, "end before start")
    return violations(df.withColumn("_why", why).filter("_why IS NOT NULL"), rule, key, "_why")


def incomplete(df: DataFrame, key: str, columns: Iterable[str], rule: str = "incomplete") -> DataFrame:
    """Rows with a blank in a required column."""
    blanks = F.filter(F.array(*(F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", F.lit(c)) for c in columns)), lambda x: x.isNotNull())
    return violations(df.withColumn("_b", blanks).filter(F.size("_b") > 0), rule, key, F.array_join("_b", ", "))


def template_slots(templates: DataFrame, key: str, column: str, known: Iterable[str], rule: str = "slot") -> DataFrame:
    """Slots that aren't capitals, or aren't known."""
    rows = templates.select(key, F.explode(F.regexp_extract_all(column, F.lit(r"\{\{([^{}]*)\}\}"), F.lit(1))).alias("slot"))
    why = F.when(~F.col("slot").rlike("^[A-Z_]+$"), "malformed").when(~F.col("slot").isin(*known), "unknown")
    return violations(rows.withColumn("why", why).filter("why IS NOT NULL"), rule, key, F.concat_ws(": ", "why", "slot"))


# Shapes of reference numbers, of a salary band and of an employee's number, and keys that aren't published.
REFERENCE_SHAPES = {
    "trainee": r"\bTCS/[A-Za-z]+/[0-9]+\b",
    "immigration": r"(?i)\b(?:GNIB|IRP|ISD)[\s/-]?[0-9]{4,}\b",
    "registration": r"\bOREG[\s/-]?[0-9]{4,}\b",
    "certificate": r"\b[A-Z][a-z]{2}/[0-9]{2}/[0-9]{2,}\b",
    "salary_band": r"\b[0-9]{2,3},?[0-9]{3}\s*-\s*[0-9]{2,3},?[0-9]{3}\b",
    "employee_before": r"(?i)\bEmployee\b[^0-9]{0,30}\b[0-9]{7}\b",
    "employee_after": r"(?i)\b[0-9]{7}\b[^0-9]{0,30}\bEmployee\b",
}
BANNED_TOP_KEYS, BANNED_KEYS = ("salary",), ("certNo",)


def pii_scan(df: DataFrame, key: str, column: str, shapes: dict[str, str] | None = None, rule: str = "pii") -> DataFrame:
    """Texts that hold a shape of reference numbers or a salary band, with the finds."""
    found = F.array(*(F.struct(F.lit(n).alias("shape"), F.regexp_extract_all(column, F.lit(p), F.lit(0)).alias("finds")) for n, p in (REFERENCE_SHAPES if shapes is None else shapes).items()))
    rows = df.select(key, F.inline(found)).select(key, "shape", F.explode("finds").alias("find"))
    return violations(rows, rule, key, F.concat_ws(": ", "shape", "find"))


def banned_keys(df: DataFrame, key: str, column: str, top: Iterable[str] = BANNED_TOP_KEYS, anywhere: Iterable[str] = BANNED_KEYS, rule: str = "pii_key") -> DataFrame:
    """JSON texts with a key at the top, or anywhere, that isn't to be published."""
    keys = F.coalesce(F.json_object_keys(column), F.array().cast("array<string>"))
    deep = [F.when(F.col(column).rlike('"' + k + r'"\s*:'), F.lit(k)) for k in anywhere]
    found = F.array_distinct(F.concat(F.array_intersect(keys, F.array(*map(F.lit, top))), F.filter(F.array(*deep), lambda x: x.isNotNull())))
    return violations(df.select(F.col(key).alias("_key"), F.explode(found).alias("_found")), rule, "_key", "_found")


CONTACTS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9]", "phone": r"\+[0-9][0-9 ()-]{7,}[0-9]"}


def contacts_not_allowed(df: DataFrame, key: str, column: str, allowed: DataFrame, rule: str = "contact") -> DataFrame:
    """Addresses and numbers that allowed(value) doesn't list; blanks and marks in numbers don't matter."""
    found = F.flatten(F.array(*(F.regexp_extract_all(column, F.lit(p), F.lit(0)) for p in CONTACTS.values())))
    plain = lambda c: F.lower(F.regexp_replace(c, r"[\s()-]", ""))
    rows = df.select(key, F.explode(F.array_distinct(found)).alias("value")).withColumn("v", plain("value"))
    return violations(rows.join(allowed.select(plain("value").alias("v")).distinct(), "v", "left_anti"), rule, key, "value")


def token_present(df: DataFrame, key: str, column: str, where: Column, token: str, rule: str = "token") -> DataFrame:
    """Named rows whose text has lost a token."""
    return violations(df.filter(where & ~F.coalesce(F.contains(F.col(column), F.lit(token)), F.lit(False))), rule, key, F.lit(token))


def saves_nothing(variants: DataFrame, rule: str = "saves_nothing") -> DataFrame:
    """Variants whose short form is as long as the text or longer."""
    return violations(variants.filter(F.length("short_text") >= F.length("text")), rule, "variant_id", F.length("short_text") - F.length("text"))


def coverage_report(variants: DataFrame) -> DataFrame:
    """How many variants there are, how many have a short form, and how many save nothing by it (saves_nothing)."""
    nothing = F.length("short_text") >= F.length("text")
    return variants.agg(F.count(F.lit(1)).alias("n"), F.count("short_text").alias("n_short"), F.count_if(F.coalesce(nothing, F.lit(False))).alias("n_saves_nothing"))


def bad_patterns(rules: DataFrame, key: str, column: str, rule: str = "pattern") -> DataFrame:
    """Patterns of a rule table that the regular expressions of Spark's functions refuse. The table is read by the driver
    in one job, within a bound that is refused beyond, and each pattern is compiled there as Spark's functions would compile
    it; null is the empty pattern."""
    rows = rules.select(F.col(key).cast("string").alias("key"), F.coalesce(F.col(column), F.lit("")).alias("p")).limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} patterns")
    spark, bad = rules.sparkSession, []
    for r in rows:
        try:
            spark._jvm.java.util.regex.Pattern.compile(r["p"])
        except (Py4JJavaError, PySparkException):
            bad.append((rule, r["key"], r["p"]))
    return spark.createDataFrame(bad, "rule string, key string, detail string")


def validate(checks: Iterable[DataFrame]) -> DataFrame:
    """All violations in one table."""
    out = None
    for c in checks:
        out = c if out is None else out.unionByName(c)
    return out
