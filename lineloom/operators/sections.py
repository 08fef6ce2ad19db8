"""Typed blocks of a document's sections, each field with the places its text was taken from, so that H1 can check it.

facts(fact_id, kind, title, org, aside, dates, body, items array<string>, relevant, start_date); kind is role, project,
education, certification or volunteering. includes(doc_id, pos, fact_id) names a document's facts in order; ids that no fact
has drop out. Empty and null fields make no block, null items none of the joined text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lineloom.functions.text import col
from lineloom.operators.scoring import order_roles

SECTION_TYPES = ("profile", "skills", "experience", "project", "education", "certifications")
BLOCK_TYPES = ("head", "para", "skill_label", "skill_line", "role", "org", "aside", "dates", "bullet")
BLOCK = ("doc_id", "section_type", "item_pos", "field_pos", "type", "text", "prefix", "joiner", "atoms")
#: Fields of an entry come before its bullets.
BULLETS_AT = 10


def atom(source: str | Column, field: str | Column) -> Column:
    return F.struct(col(source).cast("string").alias("source_id"), (F.lit(field) if isinstance(field, str) else field).alias("source_field"))


def one_field(field_pos: int, kind: str, text: str | Column, source: str | Column, field: str) -> Column:
    return joined_field(field_pos, kind, text, F.array(atom(source, field)))


def joined_field(field_pos: int, kind: str, text: str | Column, atoms: Column, joiner: str = "", prefix: str = "") -> Column:
    return F.struct(F.lit(field_pos).alias("field_pos"), F.lit(kind).alias("type"), F.concat(F.lit(prefix), col(text)).alias("text"), F.lit(prefix).alias("prefix"), F.lit(joiner).alias("joiner"), atoms.alias("atoms"))


def _blocks(rows: DataFrame, section: str, item_pos: str | Column, *fields: Column) -> DataFrame:
    rows = rows.select("doc_id", F.lit(section).alias("section_type"), col(item_pos).cast("long").alias("item_pos"), F.inline(F.array(*fields)))
    return rows.filter(F.length("text") > F.length("prefix")).select(*BLOCK)


def _items(kind: str, field_pos: int, joiner: str, prefix: str = "") -> Column:
    """The fact's items that aren't null, joined."""
    kept = F.filter(F.transform("items", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda p: p["x"].isNotNull())
    atoms = F.transform(kept, lambda p: atom(F.col("fact_id"), F.concat(F.lit("items:"), p["i"].cast("string"))))
    return joined_field(field_pos, kind, F.array_join("items", joiner), atoms, joiner, prefix)


def included(includes: DataFrame, facts: DataFrame, *kinds: str) -> DataFrame:
    return includes.join(facts.filter(F.col("kind").isin(*kinds)), "fact_id")


def profile_blocks(chosen: DataFrame) -> DataFrame:
    """The paragraph of chosen(doc_id, variant_id, text)."""
    return _blocks(chosen, "profile", F.lit(0), one_field(0, "para", "text", "variant_id", "text"))


def skill_blocks(terms: DataFrame, joiner: str = ", ") -> DataFrame:
    """A label and a line a category: given terms that were hit, the others, then added ones, each in file order.
    terms(doc_id, category, label, category_pos, term_id, term, term_pos, hit, added)."""
    item = F.struct("added", (~F.col("hit")).alias("miss"), "term_pos", "term_id", "term")
    rows = terms.groupBy("doc_id", "category").agg(F.min("label").alias("label"), F.min("category_pos").alias("at"), F.array_sort(F.collect_list(item)).alias("l"))
    line = joined_field(1, "skill_line", F.array_join(F.transform("l", lambda x: x["term"]), joiner), F.transform("l", lambda x: atom(x["term_id"], "term")), joiner)
    return _blocks(rows, "skills", "at", one_field(0, "skill_label", "label", "category", "label"), line)


def _role_fields() -> list[Column]:
    return [one_field(n, kind, field, "fact_id", field) for n, (kind, field) in enumerate((("role", "title"), ("org", "org"), ("aside", "aside"), ("dates", "dates")))]


def _project_fields() -> list[Column]:
    return [one_field(n, kind, field, "fact_id", field) for n, (kind, field) in enumerate((("role", "title"), ("aside", "aside"), ("dates", "org")))]


def _education_fields(prefix: str = "Modules: ") -> list[Column]:
    return [*(one_field(n, kind, field, "fact_id", field) for n, (kind, field) in enumerate((("role", "title"), ("org", "org"), ("dates", "dates")))), _items("para", 3, ", ", prefix)]


def _certification_fields(joiner: str = ", ") -> list[Column]:
    return [_items("para", 0, joiner), one_field(1, "para", "body", "fact_id", "body")]


def _volunteering_fields() -> list[Column]:
    return [one_field(2, "para", "body", "fact_id", "body")]


def _bullet() -> Column:
    return F.struct((F.col("bullet_pos") + BULLETS_AT).alias("field_pos"), F.lit("bullet").alias("type"), F.col("text"), F.lit("").alias("prefix"), F.lit("").alias("joiner"), F.array(atom("variant_id", "text")).alias("atoms"))


def _bullets(entries: DataFrame, bullets: DataFrame, section: str) -> DataFrame:
    """The chosen bullets(doc_id, fact_id, bullet_pos, variant_id, text) of entries(doc_id, fact_id, at)."""
    return _blocks(entries.select("doc_id", "fact_id", "at").join(bullets, ["doc_id", "fact_id"]), section, "at", _bullet())


def experience_blocks(includes: DataFrame, facts: DataFrame, bullets: DataFrame, newest_only: bool = False) -> DataFrame:
    """Roles, relevant ones first unless newest_only, then the newest, with their bullets."""
    rows = order_roles(included(includes, facts, "role").withColumn("person_id", F.col("doc_id")).withColumn("role_no", F.col("pos")), newest_only).withColumn("at", F.col("place"))
    return _blocks(rows, "experience", "at", *_role_fields()).unionByName(_bullets(rows, bullets, "experience"))


def project_blocks(includes: DataFrame, facts: DataFrame, bullets: DataFrame) -> DataFrame:
    """Projects in the order of the includes: title, what it was made with, whom it was for, bullets."""
    rows = included(includes, facts, "project").withColumn("at", F.col("pos"))
    return _blocks(rows, "project", "at", *_project_fields()).unionByName(_bullets(rows, bullets, "project"))


def education_blocks(includes: DataFrame, facts: DataFrame, prefix: str = "Modules: ") -> DataFrame:
    return _blocks(included(includes, facts, "education"), "education", "pos", *_education_fields(prefix))


def certification_blocks(includes: DataFrame, facts: DataFrame, joiner: str = ", ") -> DataFrame:
    """Certifications, their items in a line and their text, then volunteering."""
    certs = _blocks(included(includes, facts, "certification"), "certifications", "pos", *_certification_fields(joiner))
    unpaid = _blocks(included(includes, facts, "volunteering"), "certifications", "pos", *_volunteering_fields())
    return certs.withColumn("last", F.lit(0)).unionByName(unpaid.withColumn("last", F.lit(1)))


def fact_blocks(includes: DataFrame, facts: DataFrame, bullets: DataFrame, newest_only: bool = False) -> DataFrame:
    """The blocks of experience, project, education and certifications, as their builders make them, in one reading of the
    includes, the facts and the bullets: a document's entries and bullets meet where the document is."""
    kinds = {"role": ("experience", _role_fields()), "project": ("project", _project_fields()), "education": ("education", _education_fields()), "certification": ("certifications", _certification_fields()), "volunteering": ("certifications", _volunteering_fields())}
    entries = included(includes, facts, *kinds).select("doc_id", "fact_id", "pos", "kind", "title", "org", "aside", "dates", "body", "items", "relevant", "start_date")
    rows = entries.unionByName(bullets.filter("doc_id IS NOT NULL").select("doc_id", "fact_id", "bullet_pos", "variant_id", "text"), allowMissingColumns=True).repartition("doc_id")
    # bullets have no kind, and are put in no order here
    rows = order_roles(rows.withColumnRenamed("pos", "role_no"), newest_only, ("doc_id", "kind")).withColumnRenamed("role_no", "pos")
    rows = rows.withColumn("at", F.when(F.col("kind") == "role", F.col("place")).otherwise(F.col("pos")).cast("long"))
    section = lambda: F.coalesce(*(F.when(F.col("kind") == k, F.lit(s)) for k, (s, _) in kinds.items()))
    last = (F.col("kind") == "volunteering").cast("int")
    # where the document has a bullet's fact: as often as it has it
    held = F.when(F.col("kind").isin("role", "project"), F.struct(section().alias("section_type"), F.col("at").alias("item_pos"), F.lit(0).alias("last")))
    rows = rows.withColumn("held", F.collect_list(held).over(W.partitionBy("doc_id", "fact_id")))
    at = F.when(F.col("kind").isNull(), F.col("held")).otherwise(F.array(F.struct(section().alias("section_type"), F.col("at").alias("item_pos"), last.alias("last"))))
    rows = rows.select("*", F.inline(at).alias("section_type", "item_pos", "last"))
    # joined items are made beforehand: with lambdas in it, the making of all blocks would be interpreted
    lists = [(k, n) for k, (_, fields) in kinds.items() for n, _ in enumerate(fields) if (k, n) in (("education", 3), ("certification", 0))]
    rows = rows.select("*", *(F.when(F.col("kind") == k, kinds[k][1][n]).alias(f"_{k}") for k, n in lists))
    for k, n in lists:
        kinds[k][1][n] = F.col(f"_{k}")
    own = F.coalesce(*(F.when(F.col("kind") == k, F.array(*fields)) for k, (_, fields) in kinds.items()), F.array(_bullet()))
    rows = rows.select("doc_id", "section_type", "item_pos", "last", F.inline(own)).filter(F.length("text") > F.length("prefix"))
    return rows.select(*BLOCK, "last")


def assemble_sections(sections: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """the parts' blocks in the order of sections(doc_id, pos, type, heading, source_id), headings before them; sections
    without blocks drop out with their heading, and a section of an unknown type leaves a block of type `unknown`, which H1
    reports. source_id is where headings come from, as the field heading:<pos>."""
    place = F.struct("section_type", "pos", "heading", "source_id")
    s = sections.withColumnRenamed("type", "section_type")
    odd = s.filter(~F.coalesce(F.col("section_type").isin(*SECTION_TYPES), F.lit(False)))
    unknown = odd.select("doc_id", "section_type", F.lit(0).cast("long").alias("item_pos"), F.lit(0).alias("field_pos"), F.lit("unknown").alias("type"), F.coalesce("section_type", F.lit("null")).alias("text"), F.lit("").alias("prefix"), F.lit("").alias("joiner"), F.array(atom("source_id", _heading_field())).alias("atoms"), F.lit(0).alias("last"), F.array(place.withField("heading", F.lit(None).cast("string"))).alias("_own"))
    every = unknown
    for p in parts:
        p = p if "last" in p.columns else p.withColumn("last", F.lit(0))
        every = every.unionByName(p, allowMissingColumns=True)
    # a document's sections are one row, so that its blocks are shuffled by the document alone, once for them and for the order;
    # being many times fewer than the blocks, they are looked up without sorting these
    listed = s.groupBy("doc_id").agg(F.collect_list(place).alias("_listed")).hint("shuffle_hash")
    rows = every.join(listed, "doc_id", "left")
    at = F.coalesce("_own", F.filter("_listed", lambda x: x["section_type"] == F.col("section_type")))
    rows = rows.select(*BLOCK, "last", at.alias("_at")).select(*BLOCK, "last", F.explode("_at").alias("_at")).select(*BLOCK, "last", "_at.pos", "_at.heading", "_at.source_id")
    # one order of a document's blocks says where its sections begin, so that headings need no second reading of the parts
    order = W.partitionBy("doc_id").orderBy("pos", "last", "item_pos", "field_pos", "text")
    rows = rows.withColumn("n", F.row_number().over(order)).withColumn("before", F.lag("pos").over(order))
    rows = rows.withColumn("begins", (F.length("heading") > 0) & ~F.col("before").eqNullSafe(F.col("pos")))
    rows = rows.withColumn("n", F.col("n") - 1 + F.count_if("begins").over(order.rowsBetween(W.unboundedPreceding, 0)))
    # a block that begins a section comes twice, as the heading and as itself; columns that nobody reads stay behind
    rows = rows.select("*", F.explode(F.when(F.col("begins"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))).alias("is_head"))
    either = lambda head, own: F.when(F.col("is_head"), head).otherwise(F.col(own)).alias(own)
    block_no = (F.col("n") - F.col("is_head").cast("int")).cast("int").alias("block_no")
    return rows.select("doc_id", block_no, "section_type", either(F.lit("head"), "type"), either(F.col("heading"), "text"), either(F.lit(""), "prefix"), either(F.lit(""), "joiner"), either(F.array(atom("source_id", _heading_field())), "atoms"))


def _heading_field() -> Column:
    return F.concat(F.lit("heading:"), F.col("pos").cast("string"))


def fact_sources(facts: DataFrame) -> DataFrame:
    """(source_id, source_field, text) of the facts, as H1 looks them up."""
    plain = [F.struct(F.lit(f).alias("source_field"), F.col(f).alias("text")) for f in ("title", "org", "aside", "dates", "body")]
    items = F.transform(F.coalesce("items", F.array().cast("array<string>")), lambda x, i: F.struct(F.concat(F.lit("items:"), i.cast("string")).alias("source_field"), x.alias("text")))
    return facts.select(F.col("fact_id").cast("string").alias("source_id"), F.inline(F.concat(F.array(*plain), items))).filter("text IS NOT NULL")


def heading_sources(sections: DataFrame) -> DataFrame:
    return sections.select(F.col("source_id").cast("string").alias("source_id"), _heading_field().alias("source_field"), F.col("heading").alias("text")).filter("text IS NOT NULL").distinct()
