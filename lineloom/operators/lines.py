"""Lines, sentences and sections of documents."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lineloom import vocab
from lineloom.functions.text import any_of, col, let, once, word_count


def doc():
    return W.partitionBy("doc_id")


def so_far():
    """The lines of a document up to the current one."""
    return doc().orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)


def explode_lines(docs: DataFrame) -> DataFrame:
    """B2: (doc_id, line_no, text), trimmed."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text")).withColumn("text", F.trim(F.regexp_replace("text", r"^\s+|\s+$", "")))


def drop_junk_lines(lines: DataFrame, junk: Iterable[str] = vocab.JUNK_LINES, consent: str = vocab.CONSENT, long: int = 25) -> DataFrame:
    """Without site furniture, and without consent lines over `long` characters."""
    furniture = F.col("text").rlike(rf"(?i)^(?:{'|'.join(junk)})\s*[»›>]*$")
    return lines.filter(~furniture & ~(F.col("text").rlike(f"(?i){consent}") & (F.length("text") > long)))


def header_zone(lines: DataFrame, headings: Iterable[str] = vocab.DESCRIPTION_HEADINGS, most: int = 40, long: int = 160, enough: int = 3) -> DataFrame:
    """The first lines that aren't blank, up to a heading of the description below the first of them; a long line is
    skipped, or ends the zone once enough lines are in."""
    rows = lines.filter("text <> ''").withColumn("_long", F.length("text") > long)
    rows = rows.withColumn("_in", F.sum(F.when(F.col("_long"), 0).otherwise(1)).over(so_far()))
    opens = F.col("text").rlike(rf"(?i)^(?:{'|'.join(headings)})\s*:?$")
    stop = (opens & ~F.col("_long") & (F.col("_in") > 1)) | (F.col("_long") & (F.col("_in") >= enough))
    rows = rows.withColumn("_stopped", F.max(stop.cast("int")).over(so_far()))
    return rows.filter((F.col("_stopped") == 0) & ~F.col("_long") & (F.col("_in") <= most)).withColumn("header_no", F.col("_in").cast("int")).select("doc_id", "line_no", "header_no", "text")


def split_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, span_no, start, end, text) of runs up to an end mark, never over a line end.

    Tiles that cover every character are exploded, so a running sum of their lengths is the exact offset.
    """
    tiles = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(TILE), F.lit(0))).alias("tile", "raw"))
    order = W.partitionBy("doc_id").orderBy("tile")
    tiles = tiles.withColumn("stop", F.sum(F.length("raw")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    tiles = tiles.withColumn("line_no", F.sum(F.when(F.col("raw") == "\n", 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, 0)))
    text = F.regexp_replace("raw", r"^\s+|\s+$", "")
    spans = tiles.withColumn("text", text).filter(F.col("text").rlike(r"[^.!?\s]"))
    lead = F.length("raw") - F.length(F.regexp_replace("raw", r"^\s+", ""))
    start = F.col("stop") - F.length("raw") + lead
    spans = spans.select("doc_id", F.col("line_no").cast("int"), "tile", start.cast("int").alias("start"), (start + F.length("text")).cast("int").alias("end"), "text")
    return spans.withColumn("span_no", F.row_number().over(order) - 1).drop("tile").select("doc_id", "line_no", "span_no", "start", "end", "text")


def quote_at(spans: DataFrame, offsets: DataFrame) -> DataFrame:
    """offsets(doc_id, at) with the span that holds each."""
    s = spans.select(F.col("doc_id").alias("_d"), "span_no", "start", "end", "text")
    return offsets.join(s, (F.col("doc_id") == F.col("_d")) & (F.col("at") >= F.col("start")) & (F.col("at") < F.col("end"))).drop("_d")


def split_clauses(spans: DataFrame) -> DataFrame:
    """A row a clause, parted by commas and semicolons; the whole text if nothing is left."""
    parts = F.filter(F.transform(F.split("text", "[,;]"), lambda x: F.trim(x)), lambda x: x != "")
    return spans.select(*[c for c in spans.columns if c != "text"], F.posexplode(F.when(F.size(parts) > 0, parts).otherwise(F.array("text"))).alias("clause_no", "clause"))


def heading_text(c: str | Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(col(c)), r"[:?]+\s*$", ""))


def heading_shaped(stripped: Column, most: int = 10) -> Column:
    """One to ten words that don't end like a sentence."""
    return (stripped != "") & ~stripped.rlike("[.!?]$") & word_count(stripped).between(1, most)


#: A text of twelve words or fewer: no other can be shaped like a heading.
FEW_WORDS = r"^\s*+(?:\S++\s++){0,11}+\S*+$"


def heading_kind(c: str | Column, responsibility=vocab.RESPONSIBILITY_HEADINGS, requirement=vocab.REQUIREMENT_HEADINGS, other=vocab.OTHER_HEADINGS, ignored=vocab.IGNORED_HEADINGS, safe=vocab.ABOUT_SAFE_WORDS) -> Column:
    """C1 as a column: null, responsibility, requirement, other, ignored or unknown; the first class that fits."""

    def kind(t: Column) -> Column:
        about = t.rlike(r"^about\b") & ~t.rlike(any_of(safe))
        known = F.when(t.rlike(any_of(responsibility)), "responsibility").when(t.rlike(any_of(requirement)), "requirement").when(t.rlike(any_of(other)), "other")
        return F.when(heading_shaped(t), known.when(t.rlike(any_of(ignored)) | about, "ignored").otherwise("unknown"))

    return F.when(col(c).rlike(FEW_WORDS), let(F.lower(heading_text(c)), kind))


def classify_headings(lines: DataFrame, **vocabularies) -> DataFrame:
    """Lines with `heading`; the vocabularies are those of heading_kind."""
    return lines.withColumn("heading", heading_kind("text", **vocabularies))


#: A span with what lies before it in its line: blanks and marks alone.
PIECE = r"[.!?\s]*+[^.!?\s](?:[^.!?\n]*+[.!?]|[^.!?\n]*[^.!?\s])?"


#: A run up to an end mark, never over a line end; or a mark alone.
TILE = r"[^.!?\n]+[.!?]?|[.!?\n]"


def lines_in(c: str | Column) -> Column:
    """B2 within a row: the trimmed lines of a text as an array."""
    return F.transform(F.split(col(c), "\n", -1), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")))


def spans_in(c: str | Column) -> Column:
    """B5 within a row: the texts of the spans in order."""
    tiles = F.transform(F.regexp_extract_all(col(c), F.lit(TILE), F.lit(0)), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(tiles, lambda x: x.rlike(r"[^.!?\s]"))


def header_in(lines: Column, junk: Callable[[Column], Column], headings: Iterable[str] = vocab.DESCRIPTION_HEADINGS, most: int = 40, long: int = 160, enough: int = 3) -> Column:
    """B4 within a row: (line_no, text) of the header zone of an array of lines, without those that `junk` holds for."""
    opens = lambda x: x.rlike(rf"(?i)^(?:{'|'.join(headings)})\s*:?$")
    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("stopped"), F.array().cast("array<struct<line_no:int,text:string>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        is_long = F.length(x["text"]) > long
        n = a["n"] + F.when(is_long, 0).otherwise(1)
        stop = (opens(x["text"]) & ~is_long & (n > 1)) | (is_long & (n >= enough))
        keep = ~stop & ~is_long & (n <= most) & ~junk(x["text"])
        now = F.struct(n.alias("n"), stop.alias("stopped"), F.when(keep, F.array_append(a["out"], x)).otherwise(a["out"]).alias("out"))
        return F.when(a["stopped"] | (x["text"] == ""), a).otherwise(now)

    numbered = F.transform(lines, lambda x, i: F.struct(i.alias("line_no"), x.alias("text")))
    return F.aggregate(numbered, start, step)["out"]


def matchable_in(lines: Column, excludes: Iterable[str] = vocab.ABSOLUTE_EXCLUDES) -> Column:
    """C3 within a row: the spans of matchable lines in order, as an array. A line's state is that of the last known heading
    up to it; a text without known headings is matchable."""
    heads = F.transform(lines, lambda x: F.nullif(heading_kind(x), F.lit("unknown")))
    start = F.struct(F.lit(False).alias("ignored"), F.array().cast("array<boolean>").alias("out"))

    def step(a: Column, h: Column) -> Column:
        return let(F.coalesce(h == "ignored", a["ignored"]), lambda now: F.struct(now.alias("ignored"), F.array_append(a["out"], ~now).alias("out")))

    open_ = F.aggregate(heads, start, step)["out"]
    kept = F.transform(F.filter(F.arrays_zip(lines.alias("x"), open_.alias("ok")), lambda z: z["ok"]), lambda z: z["x"])
    return F.filter(F.flatten(F.transform(kept, spans_in)), lambda s: ~s.rlike(f"(?i){any_of(excludes)}"))


def matchable_sentences(docs: DataFrame) -> DataFrame:
    """C3's matchable sentences, (doc_id, span_no, text, matchable), for what needs no offsets and no sections: made within the
    document's row, so that no line is shuffled or sorted. span_no counts the matchable ones."""
    # an outer explode of the array, as once() says why
    rows = docs.filter("doc_id IS NOT NULL").select("doc_id", once(lines_in("text")).alias("l")).select("doc_id", F.posexplode_outer(matchable_in(F.col("l"))).alias("span_no", "text"))
    return rows.filter("text IS NOT NULL").withColumn("matchable", F.lit(True))


def section_state(lines: DataFrame) -> DataFrame:
    """`state` and `sub_type` of every line: those of the last known heading above it; unknown headings inherit."""
    known = F.when(F.col("heading").isin("responsibility", "requirement", "other", "ignored"), F.col("heading"))
    rows = lines.withColumn("_last", F.last(known, ignorenulls=True).over(so_far()))
    rows = rows.withColumn("state", F.when(F.col("_last") == "ignored", "ignored").otherwise("matchable"))
    rows = rows.withColumn("sub_type", F.when(F.col("_last") == "ignored", None).otherwise(F.col("_last")))
    return rows.withColumn("known_heading", known.isNotNull()).drop("_last")


def classify_sentences(docs: DataFrame, excludes: Iterable[str] = vocab.ABSOLUTE_EXCLUDES) -> DataFrame:
    """Spans with `matchable` and `sub_type`; a document without known headings is all responsibility.

    The spans are B5's. Only lines are shuffled and ordered: each takes its spans along, and sums over the lines before say at
    which number and place they begin."""
    rows = docs.filter("doc_id IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "raw"))
    rows = rows.withColumn("text", F.when(F.col("raw").rlike(FEW_WORDS), F.trim(F.regexp_replace("raw", r"^\s+|\s+$", ""))))
    rows = classify_headings(rows).select("doc_id", "line_no", "heading", F.length("raw").alias("n"), F.regexp_extract_all("raw", F.lit(PIECE), F.lit(0)).alias("pieces"))
    before = so_far().rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("first", F.coalesce(F.sum(F.size("pieces")).over(before), F.lit(0))).withColumn("begin", F.coalesce(F.sum(F.col("n") + 1).over(before), F.lit(0)))
    rows = section_state(rows).withColumn("any_known", F.max("known_heading").over(doc()))
    rows = rows.select("doc_id", "line_no", "heading", "state", "sub_type", "any_known", "first", "begin", F.posexplode("pieces").alias("pos", "piece"))
    rows = rows.withColumn("text", F.regexp_replace("piece", r"^[.!?\s]+", ""))
    inside = W.partitionBy("doc_id", "line_no").orderBy("pos")
    end = (F.col("begin") + F.sum(F.length("piece")).over(inside.rowsBetween(W.unboundedPreceding, 0))).cast("int")
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("text"))
    never = F.col("text").rlike(f"(?i){any_of(excludes)}")
    matchable = (~F.col("any_known") | (F.col("state") == "matchable")) & ~never
    sub_type = F.when(F.col("any_known"), F.col("sub_type")).otherwise("responsibility")
    return rows.select("doc_id", "line_no", (F.col("first") + F.col("pos")).cast("int").alias("span_no"), "start", "end", "text", sub_type.alias("sub_type"), "heading", matchable.alias("matchable"))


def matchable_text(sentences: DataFrame) -> DataFrame:
    """C4: (doc_id, text), the matchable sentences in order, joined by blanks."""
    parts = F.array_sort(F.collect_list(F.when(F.col("matchable"), F.struct("span_no", "text"))))
    return sentences.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("text"))


def unclassified_headings(docs: DataFrame) -> DataFrame:
    """Heading-shaped lines of no vocabulary, in order, and whether any heading is known."""
    rows = classify_headings(explode_lines(docs))
    unknown = F.array_sort(F.collect_list(F.when(F.col("heading") == "unknown", F.struct("line_no", "text"))))
    known = F.max(F.coalesce(F.col("heading").isin("responsibility", "requirement", "other", "ignored"), F.lit(False)))
    return rows.groupBy("doc_id").agg(F.transform(unknown, lambda x: x["text"]).alias("unclassified"), known.alias("headings_found"))


def requirement_sections(docs: DataFrame, included=vocab.INCLUDED_WORD_HEADINGS, ignored=vocab.IGNORED_WORD_HEADINGS, whole: bool = True) -> DataFrame:
    """Content lines with `state` (included or ignored) and `requirement`. With whole, terms match as whole words, so
    a term that is only the beginning of a word never matches; whole=False is the corrected reading."""
    t = F.lower(heading_text("text"))
    shaped = heading_shaped(t)
    kind = F.when(shaped & t.rlike(any_of(included, whole)), "requirement").when(shaped & t.rlike(any_of(ignored, whole)), "ignored")
    rows = explode_lines(docs).withColumn("_kind", kind).withColumn("_last", F.last("_kind", ignorenulls=True).over(so_far()))
    rows = rows.filter(F.col("_kind").isNull() & (F.col("text") != ""))
    return rows.select("doc_id", "line_no", "text", F.when(F.col("_last") == "ignored", "ignored").otherwise("included").alias("state"), F.coalesce(F.col("_last") == "requirement", F.lit(False)).alias("requirement"))
