"""Term matching between texts and vocabularies.

Vocabularies are tables. The words of a text are first cut down to those that a vocabulary's words begin with; only these
are exploded and joined, by equality, so no operator compares every text with every term. Rule tables are broadcast only
where a count has shown that they are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lineloom.functions.text import ascii_words, col, escaped, let, normalize, once, remove_stopwords, stem, tokenize, unhyphenate, word_count

PREFIX, OVERHANG = 5, 2


def words_of(c: str | Column) -> Column:
    """Lower-case runs of letters, digits and underscores: what a word boundary parts."""
    return F.filter(F.split(F.lower(col(c)), "[^a-z0-9_]+"), lambda x: x != "")


#: Rows of a rule table that a join may broadcast; larger tables are shuffled.
MOST_RULES = 20_000


def bounded(rules: DataFrame, most: int = MOST_RULES) -> DataFrame:
    """The rule table, to be broadcast if its size, which is checked, allows."""
    return F.broadcast(rules) if rules.limit(most + 1).count() <= most else rules


WORD_CHAR = "[A-Za-z0-9_]"


def whole(term: Column, wild: Column) -> Column:
    """A pattern of a lower-cased term between word boundaries: where letters, digits and underscores begin or end."""
    left = F.when(term.rlike(f"^{WORD_CHAR}"), F.lit(f"(?<!{WORD_CHAR})")).otherwise(F.lit(f"(?<={WORD_CHAR})"))
    right = F.when(term.rlike(f"{WORD_CHAR}$"), F.lit(f"(?!{WORD_CHAR})")).otherwise(F.lit(f"(?={WORD_CHAR})"))
    return F.concat(left, escaped(term), F.when(wild, F.lit(rf"(?:{WORD_CHAR}+(?!{WORD_CHAR})|)")).otherwise(F.lit("")), F.when(wild & term.rlike(f"{WORD_CHAR}$"), F.lit("")).otherwise(right))


def vocabulary(terms: DataFrame) -> DataFrame:
    """(term, first, prefix, plain, pattern) of terms: the first word of each, whether words need only begin with it,
    and whether finding that word is all there is to do."""
    v = terms.select("term", F.regexp_replace(F.lower("term"), r"\*$", "").alias("base"), F.col("term").endswith("*").alias("wild"))
    v = v.withColumn("first", F.regexp_extract("base", f"{WORD_CHAR}+", 0)).filter("first <> ''")
    one = F.col("first") == F.col("base")
    begins = F.col("base").endswith(F.col("first")) & (F.length(F.regexp_replace("base", WORD_CHAR, "")) == F.length("base") - F.length("first"))
    return v.select("term", "first", (F.col("wild") & begins).alias("prefix"), one.alias("plain"), whole(F.col("base"), F.col("wild")).alias("pattern"))


def match_terms(texts: DataFrame, terms: DataFrame, joined: bool = False) -> DataFrame:
    """(doc_id, term) of the terms in each text, between word boundaries, case aside; a term with a final *
    matches any word ending. joined also looks at the text with hyphens opened. Terms of any length and with any marks;
    a term without a letter or digit matches nothing.

    A text's different words meet the terms' first words before anything is exploded, so rows are as many as words found;
    terms that are more than that word are then looked for in the text itself.
    """
    form = texts.select("doc_id", F.lower("text").alias("t"))
    if joined:
        opened = texts.filter(F.col("text").rlike("[A-Za-z0-9]-[A-Za-z0-9]"))
        form = form.unionByName(opened.select("doc_id", F.lower(unhyphenate("text")).alias("t")))
    v = vocabulary(terms)
    if v.limit(MOST_RULES + 1).count() > MOST_RULES:
        return _match_many(form, v)
    keys = v.agg(F.collect_set(F.when(~F.col("prefix"), F.col("first"))).alias("_words"), F.collect_set(F.when(F.col("prefix"), F.col("first"))).alias("_stems"), F.collect_set(F.when(F.col("prefix"), F.length("first"))).alias("_lengths"))
    rows = form.select("doc_id", "t", F.array_distinct(words_of("t")).alias("_w")).crossJoin(F.broadcast(keys))  # one row, of MOST_RULES words at most
    begins = lambda k: F.transform(F.filter("_w", lambda x: F.length(x) >= k), lambda x: F.left(x, k))
    found = F.concat(
        F.transform(F.array_intersect("_w", "_words"), lambda x: F.struct(x.alias("first"), F.lit(False).alias("prefix"))),
        F.transform(F.array_intersect(F.flatten(F.transform("_lengths", begins)), F.col("_stems")), lambda x: F.struct(x.alias("first"), F.lit(True).alias("prefix"))),
    )
    rows = rows.select("doc_id", "t", F.explode(found).alias("f")).select("doc_id", "t", "f.*")
    met = rows.join(F.broadcast(v), ["first", "prefix"])
    return met.filter(F.col("plain") | F.rlike("t", F.col("pattern"))).select("doc_id", "term").distinct()


def _match_many(form: DataFrame, v: DataFrame) -> DataFrame:
    """match_terms for vocabularies that aren't broadcast: words and their beginnings meet the terms by a shuffled join, and
    only documents that met a term of more than one word are read again. The result is the same."""
    lengths = F.broadcast(v.filter("prefix").agg(F.collect_set(F.length("first")).alias("_lengths")))  # as many as words have lengths
    words = form.select("doc_id", F.explode(F.array_distinct(words_of("t"))).alias("w")).distinct()
    heads = words.crossJoin(lengths).select("doc_id", F.explode(F.transform(F.filter("_lengths", lambda k: F.length("w") >= k), lambda k: F.left("w", k))).alias("first")).distinct()
    keys = words.select("doc_id", F.col("w").alias("first"), F.lit(False).alias("prefix")).unionByName(heads.select("doc_id", "first", F.lit(True).alias("prefix")))
    met = keys.join(v, ["first", "prefix"])
    rest = met.filter("NOT plain").select(F.col("doc_id").alias("_d"), "term", "pattern").distinct()
    read = form.join(rest, F.col("doc_id").eqNullSafe(F.col("_d"))).filter(F.rlike("t", F.col("pattern")))
    return met.filter("plain").select("doc_id", "term").unionByName(read.select("doc_id", "term")).distinct()


def count_hits(text: str | Column, term: str | Column) -> Column:
    """D3: occurrences that may overlap, each allowing a word ending."""
    base = F.regexp_replace(F.lower(col(term)), r"\*$", "")
    return F.regexp_count(F.lower(col(text)), F.concat(F.lit(f"(?=(?<!{WORD_CHAR})"), escaped(base), F.lit(f"{WORD_CHAR}*)")))


def stem_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (a, b) of left(a) and right(b) that overlap: equal, or the shorter, of five letters or more, begins the
    longer, which has at most two more."""
    a, b = left.select("a").distinct(), right.select("b").distinct()
    same = a.join(b, F.col("a") == F.col("b"))
    key = lambda c: F.left(F.col(c), F.lit(PREFIX))
    near = a.filter(F.length("a") >= PREFIX).withColumn("k", key("a")).join(b.filter(F.length("b") >= PREFIX).withColumn("k", key("b")), "k")
    gap = F.abs(F.length("a") - F.length("b"))
    near = near.filter((gap <= OVERHANG) & (F.col("a") != F.col("b")) & (F.startswith("a", "b") | F.startswith("b", "a")))
    return same.select("a", "b").unionByName(near.select("a", "b"))


def stems_overlap(a: str | Column, b: str | Column) -> Column:
    """D4 as a column."""
    a, b = col(a), col(b)
    short = F.least(F.length(a), F.length(b))
    return (a == b) | ((short >= PREFIX) & (F.abs(F.length(a) - F.length(b)) <= OVERHANG) & (F.startswith(a, b) | F.startswith(b, a)))


def _led_by(rules: DataFrame) -> DataFrame:
    """One row, to be broadcast: `_led`, a pattern of the words that begin with one of rules(h), grouped by first characters so
    that it stays short; null where there are none."""
    plain = lambda c: F.replace(c, F.lit("+"), F.lit("\\+"))
    by = rules.filter("h <> ''").groupBy(F.left("h", F.lit(1)).alias("c")).agg(F.array_join(F.collect_set(plain(F.substring("h", 2, 10))), "|").alias("more"))
    every = F.array_join(F.collect_list(F.concat(plain(F.col("c")), F.lit("(?:"), "more", F.lit(")"))), "|")
    return F.broadcast(by.agg(F.when(F.count("c") > 0, F.concat(F.lit("(?<![a-z0-9+%])(?:"), every, F.lit(")[a-z0-9+%]*"))).alias("_led")))


def match_tags(sentences: DataFrame, tags: DataFrame) -> DataFrame:
    """(doc_id, span_no, tag) where every content stem of one of a tag's phrases overlaps some stem there, in any
    order. tags(tag, phrase) has a row an alternative; phrases with a digit are matched literally instead.

    Stems that overlap share their first three letters, and so do a word and its stem: only words that share them with
    a stem of the tags are taken out of a sentence and stemmed. Words also meet the first words of literal phrases, which the sentence's normal
    form must hold as whole words then. The sentences are read once.
    """
    tags = tags.select("tag", "phrase", F.xxhash64("tag", "phrase").alias("alt"))
    head = lambda c: F.left(F.col(c), F.lit(3))
    need = tags.filter(~F.col("phrase").rlike("[0-9]")).select("tag", "alt", F.array_distinct(F.transform(remove_stopwords(tokenize("phrase")), stem)).alias("bs"))
    need = need.select("tag", "alt", F.size("bs").alias("size"), F.explode("bs").alias("b"), F.lit(None).cast("string").alias("shown"))
    literal = tags.filter(F.col("phrase").rlike("[0-9]")).select("tag", "alt", F.lit(1).alias("size"), normalize("phrase").alias("shown"))
    rules = need.unionByName(literal.withColumn("b", F.substring_index("shown", " ", 1))).distinct().withColumn("h", head("b"))
    # only sentences with a digit can hold a literal phrase; both columns are made before the words part
    words = sentences.crossJoin(_led_by(rules)).select("doc_id", "span_no", F.when(F.col("text").rlike("[0-9]"), F.concat(F.lit(" "), normalize("text"), F.lit(" "))).alias("norm"), F.regexp_extract_all(F.lower("text"), "_led", F.lit(0)).alias("ws"))
    # explode_outer, as the optimizer would have the words taken out twice more before an explode
    words = words.select("doc_id", "span_no", "norm", F.explode_outer("ws").alias("w"))
    met = words.filter("w <> ''").withColumn("h", head("w")).join(bounded(rules), "h")
    held = (F.col("w") == F.col("b")) & F.contains("norm", F.concat(F.lit(" "), F.col("shown"), F.lit(" ")))
    met = met.filter(F.when(F.col("shown").isNull(), let(stem("w"), lambda a: stems_overlap(a, "b"))).otherwise(held))
    found = met.groupBy("doc_id", "span_no", "tag", "alt", "size").agg(F.count_distinct("b").alias("met"))
    return found.filter("met = size").select("doc_id", "span_no", "tag").distinct()


def may_hold(sentences: DataFrame, phrases: DataFrame) -> DataFrame:
    """The sentences that match_tags could find one of phrases(phrase) in: those with a digit, if a phrase has one, or with a
    word that begins like a phrase's. Every sentence that is left out, and each of its parts, matches none of them."""
    words = F.transform(remove_stopwords(tokenize("phrase")), lambda x: F.left(x, F.lit(3)))
    literal = phrases.agg(F.coalesce(F.max(F.col("phrase").rlike("[0-9]")), F.lit(False)).alias("_literal"))  # one row
    rows = sentences.crossJoin(_led_by(phrases.select(F.explode(words).alias("h")))).crossJoin(F.broadcast(literal))
    led = F.coalesce(F.regexp_instr(F.lower("text"), F.col("_led")) > 0, F.lit(False))
    return rows.filter(led | (F.col("_literal") & F.col("text").rlike("[0-9]"))).drop("_led", "_literal")


def keyword_hits(sentences: DataFrame, tags: DataFrame) -> DataFrame:
    """(doc_id, tag) hit by a matchable sentence; presence, not counts."""
    return match_tags(sentences.filter("matchable"), tags).select("doc_id", "tag").distinct()


def tag_universe(sources: list[DataFrame]) -> DataFrame:
    """Distinct tags, case aside, of several (pos, tag) tables; the first spelling wins."""
    every = None
    for i, s in enumerate(sources):
        one = s.select(F.lit(i).alias("src"), "pos", "tag")
        every = one if every is None else every.unionByName(one)
    first = W.partitionBy(F.lower("tag")).orderBy("src", "pos", "tag")
    return every.withColumn("_r", F.row_number().over(first)).filter("_r = 1").select("src", "pos", "tag")


def qualification_demands(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """Per document the listed terms its matchable text holds, in order."""
    found = match_terms(texts.withColumn("text", normalize("text")), terms)
    return found.groupBy("doc_id").agg(F.array_sort(F.collect_set("term")).alias("demands"))


def tools_mentioned(texts: DataFrame, have: DataFrame, absent: DataFrame) -> DataFrame:
    """`have` and `confirmed_missing`; words of neither list aren't reported."""
    v = have.select("term", F.lit(True).alias("held")).unionByName(absent.select("term", F.lit(False).alias("held")))
    found = match_terms(texts, v).join(v, "term")
    pick = lambda held: F.array_sort(F.collect_set(F.when(F.col("held") == held, F.col("term"))))
    return found.groupBy("doc_id").agg(pick(True).alias("have"), pick(False).alias("confirmed_missing"))


# A routing key or a numbered district, and the place that either stands for.
DISTRICT = r"\bD[0-9]{2}\s?[A-Z0-9]{4}\b|\bDublin\s+[0-9]{1,2}\b"
DISTRICT_OF = "Dublin"
# What a line that names a place looks like, beside the names.
COUNTRY_LEAD = r"(?i)^(?:Republic of )?Ireland\s*[-–—,:]\s*"
PLACE_SHAPE = r"^[A-Za-zÀ-ÿ'’. -]+(?: [0-9]{1,2})?(?:\s*(?:,|/|or|and|\(|-)\s*[A-Za-zÀ-ÿ0-9'’. ()-]{1,60}){0,6}\)?$"
PLACE_WORDS = 8
HOME_AREAS = ("dublin", "cork")

PLACES = "array<struct<length:int,name:string,canonical:string,area:string>>"


def gazetteer_names(gazetteer: DataFrame) -> DataFrame:
    """(name, canonical, area) of gazetteer(name, canonical[, area]) without null and blank names. Spellings that differ in
    case only are one name: it stands for the smallest of their canonical names, with its smallest area."""
    area = F.col("area").cast("string") if "area" in gazetteer.columns else F.lit(None).cast("string")
    rows = gazetteer.select("name", "canonical", area.alias("area")).filter(F.trim("name") != "")
    order = W.partitionBy(F.lower("name")).orderBy(F.col("canonical").asc_nulls_last(), F.col("area").asc_nulls_last())
    chosen = F.first(F.struct("canonical", "area")).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return rows.withColumn("_c", chosen).select("name", "_c.canonical", "_c.area").distinct()


#: Names that are looked for one by one in every text; more meet the texts through their words.
FEW_NAMES = 50


def with_places(texts: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """texts(doc_id, text, ...) with `places`: the names of the gazetteer that the text holds, the longest first.

    A dictionary join for gazetteers of any size above FEW_NAMES: a name waits under its first word, a text's different words meet the names
    by equality, and names that the text holds as a string stay. The columns functions below then look for these names only,
    so their patterns are as small as the text is. Rows that share an id each get their own names."""
    names = gazetteer_names(gazetteer)
    text = F.lower("text")
    one = F.struct((-F.length("name")).alias("length"), "name", "canonical", "area")
    if names.limit(FEW_NAMES + 1).count() <= FEW_NAMES:
        # names so few are looked for in each text where it is: one row of them, nothing is shuffled and no text is cut up
        every = F.broadcast(names.agg(F.sort_array(F.collect_set(one)).alias("_every")))
        held = let(text, lambda t: F.filter("_every", lambda p: F.contains(t, F.lower(p["name"]))))
        return texts.crossJoin(every).withColumn("places", F.coalesce(held, F.array().cast(PLACES))).drop("_every")
    # a name without any letter or digit of ASCII waits under its first character
    words = words_of("name")
    names = names.withColumn("_key", F.when(F.size(words) > 0, F.get(words, F.lit(0))).otherwise(F.left(F.lower(F.trim("name")), F.lit(1))))
    others = F.split(F.regexp_replace("text", r"[A-Za-z0-9_\s]+", ""), "")
    keys = F.array_distinct(F.concat(words_of("text"), F.transform(others, lambda x: F.lower(x))))
    met = texts.select(F.col("doc_id").alias("_d"), F.explode(keys).alias("_key")).join(bounded(names), "_key")
    own = met.groupBy("_d").agg(F.sort_array(F.collect_set(one)).alias("_met"))
    out = texts.join(own, F.col("doc_id").eqNullSafe(F.col("_d")), "left").drop("_d")
    held = let(text, lambda t: F.filter(F.coalesce("_met", F.array().cast(PLACES)), lambda p: F.contains(t, F.lower(p["name"]))))
    return out.withColumn("places", F.coalesce(held, F.array().cast(PLACES))).drop("_met")


def names_pattern(places: str | Column) -> Column:
    """The names as a pattern, the longest first; one that matches nothing where there are none."""
    p = col(places)
    return F.when(F.size(p) > 0, F.array_join(F.transform(p, lambda x: escaped(x["name"])), "|")).otherwise(F.lit("(?!)"))


def _named(c: Column, any_case: bool, names: Column) -> Column:
    pattern = F.concat(F.lit(f"{'(?i)' if any_case else ''}(?<!{WORD_CHAR})("), names, F.lit(f")(?!{WORD_CHAR})"))
    return F.regexp_extract_all(c, pattern, F.lit(1))


def _canonical(places: Column, name: Column, field: str = "canonical") -> Column:
    return F.get(F.filter(places, lambda p: F.lower(p["name"]) == F.lower(name)), F.lit(0))[field]


def all_places(c: str | Column, places: str | Column = "places", any_case: bool = True, district: str = DISTRICT, stands_for: str = DISTRICT_OF, names: Column | None = None) -> Column:
    """D12 as a column: the different canonical names in order of first mention; a name inside a longer one doesn't count, and
    of names with the same beginning the longest does. A district's mark stands for its city, before all others where nothing
    else names it. names is names_pattern(places), where a row has it as a column already."""
    t, p = col(c), col(places)
    none = F.array().cast("array<string>")
    found = F.when(F.size(p) > 0, F.array_distinct(F.transform(F.array_distinct(_named(t, any_case, names_pattern(p) if names is None else names)), lambda x: _canonical(p, x)))).otherwise(none)
    marked = lambda named: F.when(t.rlike(district) & ~F.array_contains(named, stands_for), F.array_prepend(named, F.lit(stands_for))).otherwise(named)
    return let(found, marked)


def names_place(c: str | Column, places: str | Column = "places", names: Column | None = None) -> Column:
    """Whether a string names a place or a district."""
    pattern = F.concat(F.lit(r"(?i)\b(?:"), names_pattern(places) if names is None else names, F.lit(r")\b"))
    return ((F.size(col(places)) > 0) & F.rlike(col(c), pattern)) | col(c).rlike(DISTRICT)


def is_place(c: str | Column, places: str | Column = "places") -> Column:
    """Whether a string is a place's name and nothing else."""
    return F.exists(col(places), lambda p: F.lower(p["name"]) == F.lower(col(c)))


def is_place_line(c: str | Column, places: str | Column = "places", names: Column | None = None) -> Column:
    """Whether a line is a place: led by one, in a few words, without the marks of a sentence."""
    line = F.regexp_replace(F.regexp_replace(col(c), r"\s+[·|]\s.*$", ""), COUNTRY_LEAD, "")
    lead = lambda x: F.regexp_extract(x, r"^(.*?)(?:\s*[,(/]\s*|\s+[-–—]\s+|$)", 1)
    return let(line, lambda x: (word_count(x) <= PLACE_WORDS) & x.rlike(PLACE_SHAPE) & let(lead(x), lambda y: names_place(y, places, names)))


def area_of(place: Column, places: str | Column = "places") -> Column:
    """The area of a canonical name among a text's own."""
    return F.get(F.filter(col(places), lambda p: p["canonical"] == place), F.lit(0))["area"]


def pick_place(found: str | Column, places: str | Column = "places", first: tuple[str, ...] = HOME_AREAS) -> Column:
    """The first place of the preferred areas in turn, else the first."""
    p = col(found)
    return F.coalesce(*(F.get(F.filter(p, (lambda a: lambda x: area_of(x, places) == a)(a)), F.lit(0)) for a in first), F.get(p, F.lit(0)))


def place_mentions(texts: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(doc_id, no, start, end, name, canonical) of every mention in order, the longest names first, none inside another.
    start and end are places in the text."""
    rows = with_places(texts.select("doc_id", "text"), gazetteer)
    pattern = F.concat(F.lit(f"(?i)(?<!{WORD_CHAR})(?:"), names_pattern("places"), F.lit(f")(?!{WORD_CHAR})"))
    some = F.size("places") > 0
    rows = rows.select("doc_id", "places", F.when(some, F.regexp_extract_all("text", pattern, F.lit(0))).alias("_n"), F.when(some, F.transform(F.split(F.col("text"), pattern, -1), lambda x: F.length(x))).alias("_gap"))
    # what a mention and the text before it take, summed up to each; mentions leave the row without the arrays
    taken = F.transform("_n", lambda x, i: F.get("_gap", i) + F.length(x))
    rows = rows.select("doc_id", "places", "_n", once(running(taken)).alias("_end"))
    mention = lambda x, i: F.struct(i.cast("int").alias("no"), (F.get("_end", i) - F.length(x)).alias("start"), F.get("_end", i).alias("end"), x.alias("name"), _canonical(F.col("places"), x).alias("canonical"))
    # an outer explode, as once() says why
    return rows.select("doc_id", F.explode_outer(F.transform("_n", mention)).alias("m")).filter("m IS NOT NULL").select("doc_id", "m.*")


def running(sizes: Column) -> Column:
    """Sums of an array of integers up to each element, in about the power 1.5 of its length: within blocks of the root of it,
    and over the blocks before."""

    def sums(xs: Column) -> Column:
        add = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x)
        k = F.ceil(F.sqrt(F.size(xs))).cast("int")
        blocks = lambda k: F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / k).cast("int")), lambda b: add(F.slice(xs, b * k + 1, k)))
        before = lambda k, totals: let(F.transform(totals, lambda _, b: add(F.slice(totals, 1, b))), lambda sofar: F.transform(xs, lambda _, i: let(F.floor(i / k).cast("int"), lambda b: F.get(sofar, b) + add(F.slice(xs, b * k + 1, i - b * k + 1)))))
        return F.when(F.size(xs) > 0, let(k, lambda k: let(blocks(k), lambda totals: before(k, totals)))).otherwise(F.array().cast("array<int>"))

    return let(sizes, sums)


def places_in(texts: DataFrame, gazetteer: DataFrame, district: str = DISTRICT, stands_for: str = DISTRICT_OF) -> DataFrame:
    """(doc_id, places) of the texts that name any, as all_places finds them. gazetteer(name, canonical[, area]) may have
    any size."""
    out = with_places(texts.select("doc_id", "text"), gazetteer)
    return out.select("doc_id", once(all_places("text", "places", True, district, stands_for)).alias("places")).filter(F.size("places") > 0)


def first_accepted_match(sentences: DataFrame, rules: list[tuple[str, str]], accepted: Column | None = None, strict: tuple[str, ...] = ()) -> DataFrame:
    """Per document and rule the first matchable sentence that the rule's pattern finds; of the rules in `strict` (of
    all, if it is empty) the first for which `accepted` holds too."""
    ok = F.coalesce(accepted, F.lit(False)) if accepted is not None else F.lit(True)
    may = lambda r: ok if accepted is not None and (not strict or r in strict) else F.lit(True)
    flags = F.filter(F.array(*(F.when(F.col("text").rlike(ascii_words(f"(?i){p}")) & may(r), F.lit(r)) for r, p in rules)), lambda x: x.isNotNull())
    rows = sentences.filter("matchable").select("doc_id", "start", F.col("text").alias("quote"), F.explode(flags).alias("rule_id"))
    first = W.partitionBy("doc_id", "rule_id").orderBy("start")
    return rows.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")


def contains_verbatim(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """quotes(doc_id, quote) with `verbatim`: whether the document holds it, case aside; empty quotes do."""
    d = docs.select("doc_id", F.lower("text").alias("_t"))
    out = quotes.join(d, "doc_id", "left")
    return out.withColumn("verbatim", F.coalesce(F.contains("_t", F.lower("quote")), F.lit(False))).drop("_t")


#: Words in a shingle and shingles in a window of the quote index.
SHINGLE, WINDOW = 4, 4


def _shingles(words: Column, n: int = SHINGLE) -> Column:
    """Hashes of all runs of n words."""
    return let(words, lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.xxhash64(F.slice(w, i, n)))).otherwise(F.array().cast("array<bigint>")))


def winnowed(words: Column, n: int = SHINGLE, window: int = WINDOW) -> Column:
    """The different smallest hashes of every `window` neighbouring shingles: two word sequences that share window + n - 1
    words share one of them."""
    least = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (window - 1)), lambda i: F.array_min(F.slice(h, i, window)))
    return let(_shingles(words, n), lambda h: F.when(F.size(h) >= window, F.array_distinct(least(h))).otherwise(F.array().cast("array<bigint>")))


def find_quotes(texts: DataFrame, quotes: DataFrame) -> DataFrame:
    """D14 over all texts: (quote_id, doc_id, at) of every text(doc_id, text) that holds a quote(quote_id, quote) word for
    word, case aside; at is the first place, from 0. Null quotes are in no text, empty ones in every text.

    Quotes that may be broadcast are looked for in each text where it is, nothing is shuffled (_find_few_quotes). With more,
    texts are indexed by winnowed word shingles. A quote's first and last word may be parts of words, so its inner words are
    looked up: by the smallest of their shingles where there are enough for a window, which every text that holds the quote
    has in its index; by one inner word where there are fewer; a quote of two words by the first one as a word's ending, a
    quote of one word as a part of a word. What is met is then searched for the quote itself, so each key only has to be
    necessary. Quotes without any word are compared with all texts, up to a bound on their number."""
    split = lambda c: F.filter(F.split(c, r"\s+"), lambda x: x != "")
    q = quotes.select("quote_id", F.lower("quote").alias("q")).filter("q IS NOT NULL").distinct().withColumn("w", split(F.col("q")))
    n_quotes = q.limit(MOST_RULES + 1).count()
    if n_quotes <= MOST_RULES:
        return _find_few_quotes(texts, q)
    inner = F.slice("w", 2, F.greatest(F.size("w") - 2, F.lit(0)))
    q = q.withColumn("inner", inner).withColumn("kind", F.when(F.size("w") == 0, 4).when(F.size("inner") >= SHINGLE + WINDOW - 1, 0).when(F.size("inner") > 0, 1).when(F.size("w") == 2, 2).otherwise(3))
    longest = F.array_max(F.transform("inner", lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    key = F.when(F.col("kind") == 0, F.array_min(_shingles(F.col("inner")))).when(F.col("kind") == 1, F.xxhash64(longest)).otherwise(F.xxhash64(F.get("w", F.lit(0))))
    # a quote of two words may begin or end with white space, so its ends are whole words there; the key holds either way
    q = q.select("quote_id", "q", "kind", key.alias("key"), F.when(F.col("kind").isin(2, 3), F.length(F.get("w", F.lit(0)))).alias("n"))
    lengths = F.broadcast(q.agg(*(F.collect_set(F.when(F.col("kind") == k, F.col("n"))).alias(f"_n{k}") for k in (2, 3)), *(F.count_if(F.col("kind") == k).alias(f"_c{k}") for k in (0, 1))))  # lengths of words
    t = texts.select("doc_id", F.lower("text").alias("t")).crossJoin(lengths).withColumn("w", split(F.col("t")))
    words = F.array_distinct("w")
    ends = F.flatten(F.transform(words, lambda x: F.transform(F.filter("_n2", lambda n: n <= F.length(x)), lambda n: F.xxhash64(F.right(x, n)))))
    parts = F.flatten(F.transform(words, lambda x: F.flatten(F.transform(F.filter("_n3", lambda n: n <= F.length(x)), lambda n: F.transform(F.sequence(F.lit(1), F.length(x) - n + 1), lambda i: F.xxhash64(F.substring(x, i, n)))))))
    kinds = ((0, F.when(F.col("_c0") > 0, winnowed(F.col("w")))), (1, F.when(F.col("_c1") > 0, F.transform(words, lambda x: F.xxhash64(x)))), (2, ends), (3, parts))
    keyed = F.flatten(F.array(*(F.transform(F.array_distinct(F.coalesce(c, F.array().cast("array<bigint>"))), (lambda k: lambda h: F.struct(F.lit(k).alias("kind"), h.alias("key")))(k)) for k, c in kinds)))
    index = t.select(F.col("doc_id").alias("_d"), F.explode(keyed).alias("x")).select("_d", "x.*")
    met = index.join(bounded(q.filter("kind < 4").select("quote_id", "q", "kind", "key")), ["kind", "key"]).select("_d", "quote_id", "q").distinct()
    plain = texts.select("doc_id", F.lower("text").alias("t"))
    found = plain.join(met, F.col("doc_id").eqNullSafe(F.col("_d"))).drop("_d")
    bare = q.filter("kind = 4").select("quote_id", "q")
    n_bare = bare.limit(MOST_RULES + 1).count()
    if n_bare > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} quotes without a word")
    if n_bare:
        found = found.unionByName(plain.crossJoin(F.broadcast(bare)))
    return found.filter(F.contains("t", F.col("q"))).select("quote_id", "doc_id", (F.instr("t", F.col("q")) - 1).alias("at"))


#: Letters of a word that a quote without an inner word is met by; of quotes with no word so long, up to FEW_SHORT different ones
#: are looked for one by one in every text.
GRAM, FEW_SHORT = 4, 200


def _find_few_quotes(texts: DataFrame, q: DataFrame) -> DataFrame:
    """find_quotes for q(quote_id, q, w), the lower-cased quotes with their words, of MOST_RULES rows at most. The result is the
    same: a text's different words meet the quotes' longest inner words, the runs of GRAM letters in its words meet the
    beginnings of the longest words of quotes without an inner one, and what is met is searched for. Few quotes of shorter
    words, and those without any word, are searched for in every text."""
    most = lambda xs: F.array_max(F.transform(xs, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    # quotes that are alike are searched for once
    alike = q.groupBy("q").agg(most(F.slice(F.first("w"), 2, F.greatest(F.size(F.first("w")) - 2, F.lit(0)))).alias("_whole"), most(F.first("w")).alias("_part"), F.collect_list("quote_id").alias("_ids"))
    n_short = alike.filter(F.col("_whole").isNull() & (F.length("_part") < GRAM)).limit(FEW_SHORT + 1).count()
    by_part = F.col("_whole").isNull() & (F.length("_part") >= (GRAM if n_short <= FEW_SHORT else 1))
    kind = F.when(F.col("_whole").isNotNull(), 0).when(by_part, 1).otherwise(2)
    alike = alike.select("q", "_ids", kind.alias("_kind"), F.when(kind == 0, F.col("_whole")).when(kind == 1, F.left("_part", F.lit(GRAM))).alias("_on"))
    of = lambda k, c: F.when(F.col("_kind") == k, c)
    keys = alike.agg(F.collect_set(of(0, F.col("_on"))).alias("_words"), F.collect_set(of(1, F.col("_on"))).alias("_parts"), F.collect_set(of(1, F.length("_on"))).alias("_sizes"), F.collect_list(of(2, F.struct("q", "_ids"))).alias("_every"))
    t = texts.select("doc_id", F.lower("text").alias("t")).filter("t IS NOT NULL").crossJoin(F.broadcast(keys))  # one row, of MOST_RULES quotes at most
    runs = lambda x: F.flatten(F.transform(F.filter("_sizes", lambda n: n <= F.length(x)), lambda n: F.transform(F.sequence(F.lit(1), F.length(x) - n + 1), lambda i: F.substring(x, i, n))))
    met = lambda found, k: F.transform(found, lambda x: F.struct(F.lit(k).alias("_kind"), x.alias("_on")))
    found = let(F.array_distinct(F.split(F.col("t"), r"\s+")), lambda w: F.concat(met(F.array_intersect(w, F.col("_words")), 0), met(F.array_intersect(F.flatten(F.transform(w, runs)), F.col("_parts")), 1)))
    rows = t.select("doc_id", "t", F.explode(found).alias("f")).select("doc_id", "t", "f.*")
    rows = rows.join(F.broadcast(alike), ["_kind", "_on"]).select("doc_id", "t", "q", "_ids").unionByName(t.select("doc_id", "t", F.inline("_every")))
    # whether a text holds a string costs less than where
    at = F.when(F.col("q") == "", 0).otherwise(F.instr("t", F.col("q")) - 1)
    return rows.filter(F.contains("t", F.col("q"))).select(F.explode("_ids").alias("quote_id"), "doc_id", at.alias("at"))
