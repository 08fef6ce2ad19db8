"""Sources and sinks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineloom.functions.text import plain_dashes
from lineloom.sources import publish

#: The nested rule file.
RULES = (
    "version string, fallback string, "
    "profiles array<struct<id:string,label:string,priority:int,title_required:boolean,keywords:map<string,int>,title_keywords:map<string,int>,title_exclude:array<string>,include:array<string>,sections:array<struct<type:string,heading:string>>>>, "
    "groups array<struct<id:string,strength:string,variants:array<struct<id:string,text:string,short:string,tags:array<string>,prefer:array<string>>>>>, "
    "terms map<string,array<string>>, warnings array<struct<id:string,pattern:string,severity:string>>, "
    "requirements array<struct<id:string,held:string,qualification:boolean,patterns:array<string>>>"
)


def read_documents(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A1: (doc_id, text) of a table, or (path, text) of plain-text files, dashes made plain."""
    if fmt == "text":
        return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), plain_dashes("value").alias("text"))
    df = spark.read.format(fmt).load(path)
    return df.withColumn("text", plain_dashes("text"))


def read_rules(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A2: the nested rule file as tables; a file that doesn't parse fails instead of giving nulls."""
    raw = spark.read.schema(RULES).option("mode", "FAILFAST").json(path, multiLine=True)
    profile = raw.select(F.explode("profiles").alias("p"))
    terms = [
        profile.select(F.col("p.id").alias("profile_id"), F.lit(kind).alias("kind"), F.posexplode(entries).alias("term_no", "e")).select("profile_id", "kind", "e.term", "e.weight", "term_no")
        for kind, entries in (
            ("body", _pairs(F.col("p.keywords"))), ("title", _pairs(F.col("p.title_keywords"))),
            ("title_exclude", F.transform(F.coalesce("p.title_exclude", F.array().cast("array<string>")), lambda x: F.struct(x.alias("term"), F.lit(0).alias("weight")))),
        )
    ]
    variants = raw.select(F.explode("groups").alias("g")).select(F.col("g.id").alias("group_id"), F.col("g.strength").alias("strength"), F.posexplode("g.variants").alias("variant_no", "v"))
    return {
        "profiles": profile.select(F.col("p.id").alias("profile_id"), "p.label", "p.priority", F.coalesce("p.title_required", F.lit(False)).alias("title_required")),
        "profile_terms": terms[0].unionByName(terms[1]).unionByName(terms[2]),
        "profile_includes": profile.select(F.col("p.id").alias("profile_id"), F.posexplode("p.include").alias("pos", "fact_id")),
        "profile_sections": profile.select(F.col("p.id").alias("profile_id"), F.posexplode("p.sections").alias("pos", "s")).select("profile_id", "pos", "s.type", "s.heading"),
        "variants": variants.select("group_id", "strength", "variant_no", F.col("v.id").alias("variant_id"), F.col("v.text").alias("text"), F.col("v.short").alias("short_text")),
        "variant_tags": variants.select(F.col("v.id").alias("variant_id"), F.explode("v.tags").alias("tag")),
        "variant_prefers": variants.select(F.col("v.id").alias("variant_id"), F.explode("v.prefer").alias("tag")),
        "term_list": raw.select(F.explode("terms").alias("list_name", "t")).select("list_name", F.explode("t").alias("term")),
        "warning_rules": raw.select(F.posexplode("warnings").alias("rule_no", "w")).select("rule_no", F.col("w.id").alias("rule_id"), "w.pattern", "w.severity"),
        "requirement_items": raw.select(F.explode("requirements").alias("r")).select(F.col("r.id").alias("item_id"), "r.held", "r.qualification", F.explode("r.patterns").alias("phrase")),
    }


def _pairs(m: Column) -> Column:
    entries = F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("term"), e["value"].alias("weight")))
    return F.coalesce(entries, F.array().cast("array<struct<term:string,weight:int>>"))


def strip_notes(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """A3: without any field, or key of a map, at any depth, whose name begins with an underscore, but those of `keep`."""
    keep = set(keep)

    def fields(t: T.StructType) -> list[T.StructField]:
        return [f for f in t.fields if not f.name.startswith("_") or f.name in keep]

    def clean(c: Column, t: T.DataType) -> Column:
        if isinstance(t, T.StructType):
            inner = F.struct(*(clean(c[f.name], f.dataType).alias(f.name) for f in fields(t)))
            return F.when(c.isNotNull(), inner)
        if isinstance(t, T.ArrayType):
            return F.transform(c, lambda x: clean(x, t.elementType))
        if isinstance(t, T.MapType):
            inside = F.transform_values(c, lambda _, v: clean(v, t.valueType))
            if not isinstance(t.keyType, T.StringType):
                return inside
            kept = lambda k: ~F.startswith(k, F.lit("_")) | F.array_contains(F.array(*map(F.lit, keep)).cast("array<string>"), k)
            return F.map_filter(inside, lambda k, _: kept(k))
        return c

    return df.select(*(clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fields(df.schema)))


def overlay(base: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """A4: base with the values of the overrides where these aren't blank; arrays get the values they lack."""
    theirs = [c for c in overrides.columns if c != key]
    o = overrides.select(key, *(F.col(c).alias(f"_o_{c}") for c in theirs))
    rows = base.join(o, key, "left")
    kinds = dict(base.dtypes)

    def merged(c: str) -> Column:
        mine, other = F.col(c), F.col(f"_o_{c}")
        if kinds[c].startswith("array"):
            return F.when(other.isNull(), mine).otherwise(F.array_union(F.coalesce(mine, F.array().cast(kinds[c])), other))
        return F.coalesce(F.when(F.trim(other.cast("string")) != "", other), mine)

    return rows.select(*((merged(c) if c in theirs else F.col(c)).alias(c) for c in base.columns))


def audit(builds: DataFrame, columns: Iterable[str]) -> DataFrame:
    """A5: one JSON record a build, fields in the order given, partitioned by data_version when written."""
    return builds.select("data_version", F.to_json(F.struct("doc_id", *columns)).alias("value"))


def write_audit(builds: DataFrame, columns: Iterable[str], path: str) -> None:
    audit(builds, columns).write.mode("overwrite").partitionBy("data_version").text(path)


def content_stamp(df: DataFrame, length: int = 10) -> DataFrame:
    """One row with the stamp of all rows, whatever their order. Row hashes are summed by four 64-bit parts, so that no
    task holds more than sums."""
    h = F.sha2(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(h, 15 * k + 1, 15), 16, 10).cast("decimal(38,0)")).alias(f"p{k}") for k in range(4)]
    return df.agg(*parts, F.count(F.lit(1)).alias("n")).select(F.left(F.sha2(F.concat_ws(":", "n", *(f"p{k}" for k in range(4))), 256), F.lit(length)).alias("stamp"))


def write_versioned(df: DataFrame, path: str) -> str:
    """Writes under stamp=<content stamp> and then points at it (publish.read_current); equal content is written once."""
    stamp = content_stamp(df).first()["stamp"]
    publish.publish(df, path, f"stamp={stamp}")
    return stamp


def publish_checked(df: DataFrame, violations: DataFrame, path: str) -> str:
    """write_versioned, or an error with the first violations, which leaves the version published before."""
    bad = violations.limit(5).collect()
    if bad:
        raise ValueError("not published: " + "; ".join(f"{r['rule']} {r['key']}: {r['detail']}" for r in bad))
    return write_versioned(df, path)
