"""Personal data: fixed rules, and candidates chosen by gradient boosting. DataFrame and Spark ML operations only.

Fixed rules give the base spans. Beside them, high-recall generators propose spans that may overlap, each with a kind, among
them secrets, which have no fixed rule; boosted trees score them by format and context, and a threshold for each kind,
calibrated on rows the trees haven't seen, selects those to add. Selected spans that overlap become one.

No labels exist, and the fixed rules' own finds would only teach the rules. So the trees learn from rewritten finds, in their
true context. True: base spans without the mark or check that the rule insists on (an address with "(at)", an ip with other
separators, a card with another digit or in groups, a phone without its plus), and long runs that are assigned to a name
like token or password, half of them with the assignment masked. False: proposals beside all base spans whose form can't be
their kind's (IMPOSSIBLE), and remains of base spans (DECOYS: a handle, a version, a short number, a word without digits).
What the trees then select among proposals are such unmarked forms.

Positions come from the pieces between the matches: a window sums their lengths, so no pattern is run twice from the
start, and a text of any length with any number of matches stays cheap. Overlaps are found by running sums in order of
position, never by pairs. Patterns repeat no group without bound (a single separator inside a run is first replaced by a
mark of the same length), so that long runs can't exhaust the stack.

The trees are fitted on a bounded sample of examples (SAMPLE of each kind and label, by hash order); candidates come from
all whole texts, and the thresholds from all examples of the unseen fold.

Defined results: a null text has no spans; spans count code points, the end exclusive; rows that agree in id and text
get the same result, and null ids are kept; a kind without true or without false examples gets no added spans; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved, table

#: In the order of the results.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
#: Examples of each kind and label that the trees are fitted on.
SAMPLE = 1_000
TREES, DEPTH = 10, 4
PRECISION = 0.97
CONTEXT = 24

#: Stands for a separator inside a run, as long as it.
MARK = "\x01"

# The patterns of the base rules over marked text, written without unbounded groups.
BASE = {
    "email": rf"(?:\G|(?<![A-Za-z0-9._%+{MARK}-]))[A-Za-z0-9._%+{MARK}-]++@[A-Za-z0-9-]++{MARK}[A-Za-z0-9{MARK}-]++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": rf"[0-9][0-9{MARK}]++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What is marked before a pattern runs: a dot between label characters, a blank or hyphen between digits.
MARKED = {"email": r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", "card": r"(?<=[0-9])[\x20-](?=[0-9])"}

# Generators of candidates; those of a kind may overlap each other.
GENERATORS = {
    "email": (
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:@|\(at\)|\[at\]|\{at\})\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|\(dot\)|\[dot\]|\{dot\})\x20?[A-Za-z0-9-]{1,63}){0,4}",
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20at\x20[A-Za-z0-9-]{1,63}(?:\x20dot\x20[A-Za-z0-9-]{1,63}){1,4}",
    ),
    "ip": (r"(?<![0-9.,])[0-9]{1,3}(?:(?:[.,]|\[\.\])[0-9]{1,3}){3}(?![0-9])", r"(?<![0-9])[0-9]{1,3}(?:\x20?[.,]\x20?[0-9]{1,3}){2,5}(?![0-9])"),
    "card": (r"(?<![0-9])[0-9]{4}(?:[\x20./-]?[0-9]{2,6}){2,4}(?![0-9])", r"(?<![0-9])[0-9]{7,24}(?![0-9])"),
    "phone": (r"(?<![0-9])\(?[0-9]{2,4}\)?[\x20./-]{1,2}[0-9]{2,4}[\x20./-][0-9]{2,4}(?:[\x20./-]?[0-9]{2,4})?(?![0-9])", r"(?<![0-9+])[0-9]{1,3}\x20\(?[0-9]{2,4}\)?[\x20./-][0-9]{3,4}[\x20./-][0-9]{3,4}(?![0-9])"),
    "secret": (r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}+",),
}
#: A text without any of these has neither base spans nor candidates.
ANY = r"@|[(\[{]at[)\]}]|\x20at\x20[A-Za-z0-9-]{1,63}\x20dot\x20|\+[0-9]|[0-9]\x20?[.,]\x20?[0-9]|[0-9]\[\.\]|[0-9][\x20./)-]{1,3}[0-9]|[0-9]{7}|[A-Za-z0-9_+/=-]{20}"

# Words near a span that speak for it, and the assignment of a secret before it.
NEARBY = r"(?i)\b(?:mail|e-mail|email|contact|call|phone|tel|mobile|fax|card|visa|credit|account|ip|host|address|server)\b"
ASSIGNED = r"""(?i)(?:key|token|secret|passw|pwd|auth|bearer|credential)[a-z_]*["']?\s{0,3}(?:=>|=|:)\s{0,3}["']?$"""

FEATURES = ("length", "digits", "letters", "groups", "at", "dots", "dashes", "blanks", "brackets", "longest", "largest", "turns", "near", "assigned", "before_letter", "after_letter", "first_digit", "distinct")

# The form of a proposal that can't be its kind's.
IMPOSSIBLE = {
    "email": "letters = 0 OR dots = 0 AND brackets < 3",
    "ip": "largest > 255 OR groups <> 4",
    "card": "digits < 13 OR digits > 19",
    "phone": "digits < 9 OR digits > 15",
    "secret": "digits = 0 OR letters = 0 OR distinct < 8",
}


def _matches(texts: DataFrame, pattern: str, kind: str, marked: str | None = None) -> DataFrame:
    """texts(doc_id, th, row, text) -> (doc_id, th, row, kind, start, end, match, before, after), in code points."""
    text = F.translate("text", MARK, "?")
    text = F.regexp_replace(text, marked, MARK) if marked else text
    both = texts.select("doc_id", "th", "row", text.alias("t"))
    both = both.filter(F.col("t").rlike(pattern)).select("doc_id", "th", "row", F.split("t", pattern, -1).alias("piece"), F.regexp_extract_all("t", F.lit(pattern), F.lit(0)).alias("match"))
    rows = both.select("doc_id", "th", "row", F.posexplode(F.arrays_zip("piece", "match")).alias("pos", "x"))
    n_piece, n_match = F.length("x.piece"), F.coalesce(F.length("x.match"), F.lit(0))
    rows = rows.select("doc_id", "th", "row", "pos", F.col("x.match").alias("match"), n_piece.alias("n_piece"), n_match.alias("n_match"), F.right("x.piece", F.lit(CONTEXT)).alias("before"), F.left("x.piece", F.lit(CONTEXT)).alias("head"))
    order = W.partitionBy("row").orderBy("pos")
    rows = rows.withColumn("end", F.sum(F.col("n_piece") + F.col("n_match")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("after", F.lead("head").over(order)).filter("match IS NOT NULL")
    return rows.select("doc_id", "th", "row", F.lit(kind).alias("kind"), (F.col("end") - F.col("n_match")).cast("int").alias("start"), F.col("end").cast("int").alias("end"), "match", "before", "after")


def _digits(c: str) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    rev = F.reverse(digits)
    doubled = lambda x, i: F.when(i % 2 == 0, x).when(x > 4, x * 2 - 9).otherwise(x * 2)
    values = F.transform(F.split(rev, ""), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    return F.aggregate(F.transform(values, doubled), F.lit(0), lambda s, x: s + x) % 10 == 0


def base_spans(texts: DataFrame) -> DataFrame:
    """The spans of the fixed rules."""
    parts = F.split("match", r"\.")
    small = F.forall(parts, lambda p: F.length(F.ltrim(F.lit("0"), p)) <= 3) & F.forall(parts, lambda p: F.coalesce(F.right(p, F.lit(4)).try_cast("int"), F.lit(0)) <= 255)
    n = F.length(_digits("match"))
    valid = {"email": F.lit(True), "ip": small, "card": n.between(12, 19) & _luhn(_digits("match")), "phone": n.between(9, 15)}
    found = None
    for kind in BASE_KINDS:
        one = _matches(texts, BASE[kind], kind, MARKED.get(kind)).filter(valid[kind]).select("doc_id", "th", "row", "kind", "start", "end")
        found = one if found is None else found.unionByName(one)
    return found


def described(found: DataFrame) -> DataFrame:
    """FEATURES of found(match, before, after, ...), which lose the three."""
    count = lambda p: F.regexp_count("match", F.lit(p)).cast("double")
    numbers = F.transform(F.regexp_extract_all("match", F.lit("[0-9]+"), F.lit(0)), lambda x: F.when(F.length(x) < 10, x.cast("int")).otherwise(10**9))
    values = {
        "length": F.length("match").cast("double"), "digits": count("[0-9]"), "letters": count("[A-Za-z]"), "groups": count("[A-Za-z0-9]+"), "at": count("@|\\bat\\b"),
        "dots": count("[.]|\\bdot\\b"), "dashes": count("-"), "blanks": count(" "), "brackets": count("[()\\[\\]{}]"),
        "longest": F.array_max(F.transform(F.split("match", "[^A-Za-z0-9]+"), lambda x: F.length(x))).cast("double"),
        "largest": F.coalesce(F.array_max(numbers), F.lit(-1)).cast("double"), "turns": count("[0-9][A-Za-z]|[A-Za-z][0-9]"),
        "near": F.coalesce(F.concat_ws(" ", "before", "after").rlike(NEARBY), F.lit(False)).cast("double"), "assigned": F.coalesce(F.col("before").rlike(ASSIGNED), F.lit(False)).cast("double"),
        "before_letter": F.coalesce(F.col("before").rlike("[A-Za-z]$"), F.lit(False)).cast("double"), "after_letter": F.coalesce(F.col("after").rlike("^[A-Za-z]"), F.lit(False)).cast("double"),
        "first_digit": F.coalesce(F.regexp_extract("match", "[0-9]", 0).try_cast("double"), F.lit(-1.0)), "distinct": F.size(F.array_distinct(F.split("match", ""))).cast("double"),
    }
    return found.select(*[c for c in found.columns if c not in ("match", "before", "after")], *(c.alias(k) for k, c in values.items()))


def candidates(texts: DataFrame) -> DataFrame:
    """What the generators propose, each span of a kind once."""
    found = None
    for kind in KINDS:
        for pattern in GENERATORS[kind]:
            one = _matches(texts, pattern, kind)
            found = one if found is None else found.unionByName(one)
    return described(found.dropDuplicates(["row", "kind", "start", "end"]))


def beside(spans: DataFrame, base: DataFrame) -> DataFrame:
    """Spans that overlap no base span of their row: none that begins before reaches in, none begins inside."""
    rest = [c for c in spans.columns if c not in ("row", "start", "end")]
    own = spans.select("row", "start", "end", F.struct(*rest).alias("span"))
    both = own.unionByName(base.select("row", "start", "end", F.lit(None).cast(own.schema["span"].dataType).alias("span")))
    is_base = F.col("span").isNull()
    forth = W.partitionBy("row").orderBy("start").rangeBetween(W.unboundedPreceding, 0)
    back = W.partitionBy("row").orderBy(F.desc("start")).rangeBetween(W.unboundedPreceding, 0)
    both = both.withColumn("reach", F.max(F.when(is_base, F.col("end"))).over(forth)).withColumn("next", F.min(F.when(is_base, F.col("start"))).over(back))
    free = (F.coalesce("reach", F.lit(-1)) <= F.col("start")) & (F.col("next").isNull() | (F.col("next") >= F.col("end")))
    return both.filter(~is_base & free).select("row", "start", "end", "span.*")


def rewritten(texts: DataFrame, base: DataFrame) -> DataFrame:
    """Examples (doc_id, th, kind, label, FEATURES) from base spans: without the rule's marks, and decoys."""
    at = base.select("row", "kind", "start", "end").join(texts.hint("merge"), "row")
    part = lambda a, n: F.substring(F.col("text"), a, n)
    before = F.greatest(F.col("start") - CONTEXT, F.lit(0))
    at = at.select("doc_id", "th", "kind", "start", part(F.col("start") + 1, F.col("end") - F.col("start")).alias("m"), part(before + 1, F.col("start") - before).alias("before"), part(F.col("end") + 1, F.lit(CONTEXT)).alias("after"))
    m, digits = F.col("m"), _digits("m")
    turn = F.pmod(F.xxhash64("th", "start", F.lit(5)), F.lit(3))
    pick = lambda *forms: F.when(turn == 0, forms[0]).when(turn == 1, forms[1]).otherwise(forms[2])
    typo = F.concat(F.left(m, F.length(m) - 1), F.translate(F.right(m, F.lit(1)), "0123456789", "3456789012"))
    bare = F.regexp_replace(m, r"^\+[0-9]{1,2}[\x20.-]*", "")
    true = {
        "email": pick(F.replace(m, F.lit("@"), F.lit(" (at) ")), F.replace(F.replace(m, F.lit("@"), F.lit("[at]")), F.lit("."), F.lit("[dot]")), F.replace(F.replace(m, F.lit("@"), F.lit(" at ")), F.lit("."), F.lit(" dot "))),
        "ip": pick(F.replace(m, F.lit("."), F.lit(",")), F.replace(m, F.lit("."), F.lit("[.]")), F.replace(m, F.lit("."), F.lit(" . "))),
        "card": pick(typo, F.regexp_replace(digits, "(.{4})(?=.)", "$1."), F.regexp_replace(typo, "(.{4})(?=.)", "$1 ")),
        "phone": pick(F.substring(m, 2, 60), bare, F.regexp_replace(bare, r"[()\x20-]+(?=[0-9])", ".")),
    }
    decoy = {
        "email": pick(F.concat(F.lit("@"), F.substring_index(m, "@", 1)), F.concat(F.substring_index(m, "@", 1), F.lit(" at home")), F.concat(F.substring_index(m, "@", 1), F.lit("@"))),
        "ip": pick(F.substring_index(m, ".", 3), F.concat(m, F.lit(".7")), F.concat(F.lit("1"), F.replace(m, F.lit("."), F.lit("00,")))),
        "card": pick(F.left(digits, F.lit(8)), F.left(digits, F.lit(10)), F.concat(digits, digits)),
        "phone": pick(F.concat_ws("-", F.lit("20"), F.substring(digits, 2, 2), F.substring(digits, 4, 2)), F.concat_ws("/", F.substring(digits, 2, 2), F.substring(digits, 4, 2), F.lit("1998")), F.concat_ws(" ", F.substring(digits, 2, 3), F.substring(digits, 5, 3))),
    }
    of = lambda forms: F.coalesce(*(F.when(F.col("kind") == k, c) for k, c in forms.items()))
    both = at.select("doc_id", "th", "kind", "start", F.explode(F.array(F.struct(F.lit(1.0).alias("label"), of(true).alias("match")), F.struct(F.lit(0.0).alias("label"), of(decoy).alias("match")))).alias("x"), "before", "after")
    return described(both.select("doc_id", "th", "kind", "start", "x.*", "before", "after"))


def examples(texts: DataFrame, proposed: DataFrame, base: DataFrame) -> DataFrame:
    """(doc_id, th, kind, start, label, FEATURES) of all rewritten base spans, assigned secrets and impossible proposals."""
    columns = ("doc_id", "th", "kind", "start", "label", *FEATURES)
    impossible = F.coalesce(*(F.when(F.col("kind") == k, F.expr(sql)) for k, sql in IMPOSSIBLE.items()))
    free = beside(proposed, base)
    false = free.filter(impossible).withColumn("label", F.lit(0.0))
    half = F.pmod(F.xxhash64("th", "start", F.lit(6)), F.lit(2)) == 0
    secret = free.filter((F.col("kind") == "secret") & (F.col("assigned") == 1) & ~impossible).withColumn("label", F.lit(1.0)).withColumn("assigned", F.when(half, 0.0).otherwise(1.0))
    return rewritten(texts, base).select(*columns).unionByName(false.select(*columns)).unionByName(secret.select(*columns))


def _kinds(df: DataFrame) -> DataFrame:
    flags = [F.when(F.col("kind") == k, 1.0).otherwise(0.0).alias(f"is_{k}") for k in KINDS]
    return VectorAssembler(inputCols=[*FEATURES, *(f"is_{k}" for k in KINDS)], outputCol="features").transform(df.select("*", *flags))


def thresholds(scored: DataFrame) -> DataFrame:
    """scored(kind, label, score) -> (kind, cut): the lowest fiftieth at and above which so large a share is true."""
    bins = scored.groupBy("kind", F.floor(F.col("score") * 50).alias("bin")).agg(F.sum("label").alias("t"), F.count(F.lit(1)).alias("n"))
    above = W.partitionBy("kind").orderBy(F.desc("bin"))
    both = F.max(F.col("t") < F.col("n")).over(W.partitionBy("kind"))
    bins = bins.withColumn("ok", F.sum("t").over(above) >= PRECISION * F.sum("n").over(above)).withColumn("both", both)
    return bins.filter("ok AND both").groupBy("kind").agg((F.min("bin") / 50.0).alias("cut"))


def added_spans(texts: DataFrame, proposed: DataFrame, base: DataFrame) -> DataFrame:
    """Proposals over their kind's threshold that overlap no base span; those that overlap each other become one span of
    the surest one's kind."""
    known = examples(texts, proposed, base).withColumn("fold", F.pmod(F.xxhash64("doc_id", "th"), F.lit(3)))
    known = saved(known, "pii-examples")
    # bounded by SAMPLE; hash order, so that it follows from the rows alone
    order = W.partitionBy("kind", "label").orderBy(F.xxhash64("doc_id", "th", "kind", "start"), "start")
    sample = known.filter("fold < 2").withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= SAMPLE).drop("_r")
    sample = saved(sample.orderBy("kind", "label", F.xxhash64("doc_id", "th", "start"), "start").coalesce(1), "pii-sample")
    if len(sample.select("label").distinct().take(2)) < 2:
        return proposed.select("doc_id", "th", "row", "kind", "start", "end").limit(0)
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=1, maxBins=32).fit(_kinds(sample))
    score = lambda df: model.transform(_kinds(df)).withColumn("score", vector_to_array("probability")[1])
    cuts = thresholds(score(known.filter("fold = 2")))
    passing = score(beside(proposed, base)).join(F.broadcast(cuts), "kind").filter("score >= cut").select("doc_id", "th", "row", "kind", "start", "end", "score")  # a row a kind
    doc = W.partitionBy("row").orderBy("start", "end")
    reach = F.max("end").over(doc.rowsBetween(W.unboundedPreceding, -1))
    chain = passing.withColumn("new", F.when(F.col("start") < reach, 0).otherwise(1))
    chain = chain.withColumn("part", F.sum("new").over(doc.rowsBetween(W.unboundedPreceding, 0)))
    surest = F.max_by("kind", F.struct("score", -F.col("start"), "kind"))
    return chain.groupBy("doc_id", "th", "row", "part").agg(surest.alias("kind"), F.min("start").alias("start"), F.max("end").alias("end")).drop("part")


def _spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: doc_id, th (the hash of its text) and `spans`. Rows that share an id have the spans of their own texts."""
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    texts = saved(keyed.filter(F.col("text").rlike(ANY)).withColumn("row", F.monotonically_increasing_id()), "pii-texts")
    base = saved(base_spans(texts), "pii-base")
    proposed = saved(candidates(texts), "pii-candidates")
    added = added_spans(texts, proposed, base)
    every = base.withColumn("base", F.lit(True)).unionByName(added.withColumn("base", F.lit(False)))
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    span = F.struct("start", number.alias("kind"), "end", "base")
    grouped = every.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(span)).alias("spans"))
    grouped = grouped.withColumnsRenamed({"doc_id": "id2", "th": "th2"}).hint("merge")
    out = keyed.select("doc_id", "th").join(grouped, F.col("doc_id").eqNullSafe(F.col("id2")) & F.col("th").eqNullSafe(F.col("th2")), "left")
    return out.select("doc_id", "th", F.coalesce("spans", F.array().cast("array<struct<start:int,kind:int,end:int,base:boolean>>")).alias("spans"))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and `spans`, an array of (start, kind, end, base) in order; kind is the place in KINDS."""
    return _spans(docs, id_col, text_col).select("doc_id", "spans")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and `redacted`, the text with every span replaced by its kind in brackets. Texts meet their spans by id
    and hash of the text, so rows that share an id, or have none, are each redacted by their own spans."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th"))
    spans = _spans(docs, id_col, text_col).filter(F.size("spans") > 0).withColumnRenamed("th", "_th").distinct()
    both = texts.join(spans.hint("merge"), F.col("id").eqNullSafe(F.col("doc_id")) & F.col("th").eqNullSafe(F.col("_th")), "left")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    names = F.array(*(F.lit(f"[{k}]") for k in KINDS))

    def cut(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["at"]
        text = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.get(names, s["kind"]))
        return F.struct(F.when(inside, acc["out"]).otherwise(text).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    done = F.aggregate("spans", start, cut)
    rest = F.concat(done["out"], F.substring(F.col("text"), done["at"] + 1, F.length("text")))
    return both.select(F.col("id").alias("doc_id"), F.when(F.col("spans").isNull(), F.col("text")).otherwise(rest).alias("redacted"))


def op6_pii_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_spans(table(spark, sf_dir, "documents"))
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat(F.get(F.array(*map(F.lit, KINDS)), s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter(base, (lambda i: lambda s: s["kind"] == i)(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE_KINDS)]
    return out.select("doc_id", *counts, F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
