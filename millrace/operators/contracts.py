"""Nested output contracts: JSON values walked level by level against a table of paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.storage import materialise

CONTRACT = "path string, types array<string>, required boolean, closed boolean"


def output_errors(outputs: DataFrame, contract: DataFrame, deepest: int = 32) -> DataFrame:
    """(event_id, path, error) for outputs (event_id, output: JSON text) that break a contract.

    contract (CONTRACT): one row a path, `$` the root, `$.a` a property, `$.a[*]` the items of an array; types of object,
    array, string, number, boolean, null (null or empty: any); required in its object; closed: no properties but those
    that have a path. A value of another type is not looked into, nor are items or properties without a path.
    Each level of the contract is one join; what is nested deeper is never read. Text that is no JSON is an error of the
    root; null outputs too.
    """
    spark = outputs.sparkSession
    rules = contract.select("path", "types", F.coalesce("required", F.lit(False)).alias("required"), F.coalesce("closed", F.lit(False)).alias("closed"))
    depth = rules.agg(F.max(F.size(F.split("path", r"\.|\[\*\]")))).first()[0] or 1
    if depth > deepest:
        raise ValueError(f"a contract of {depth} levels; {deepest} are allowed")
    children = rules.filter("path <> '$'").withColumn("parent", F.regexp_replace("path", r"(\.[^.\[]+|\[\*\])$", "")).withColumn("name", F.regexp_extract("path", r"\.([^.\[]+)$", 1))
    owned = children.groupBy("parent").agg(
        F.collect_set(F.when(F.col("name") != "", F.col("name"))).alias("names"), F.collect_set(F.when(F.col("required") & (F.col("name") != ""), F.col("name"))).alias("needed")
    )
    rules = rules.join(owned.withColumnRenamed("parent", "path"), "path", "left")
    empty = F.array().cast("array<string>")
    shape = F.upper(F.schema_of_variant("v"))
    kind = (
        F.when(F.col("v").isNull() | F.is_variant_null("v"), "null")
        .when(shape.startswith("OBJECT"), "object")
        .when(shape.startswith("ARRAY"), "array")
        .when(shape == "STRING", "string")
        .when(shape == "BOOLEAN", "boolean")
        .otherwise("number")
    )
    nodes = outputs.select("event_id", F.lit("$").alias("at"), F.lit("$").alias("path"), F.try_parse_json("output").alias("v"))
    broken = nodes.filter("v is null").select("event_id", F.col("at").alias("path"), F.lit("not JSON").alias("error"))
    nodes = nodes.filter("v is not null")
    out = [broken]
    for level in range(depth):
        here = nodes.join(rules, "path").withColumn("kind", kind)
        here = materialise(here.withColumn("fits", (F.coalesce(F.size("types"), F.lit(0)) <= 0) | F.array_contains("types", F.col("kind"))), "contract-level")
        wrong = here.filter("not fits").select("event_id", F.col("at").alias("path"), F.concat(F.lit("expected "), F.array_join("types", " or "), F.lit(", got "), "kind").alias("error"))
        objects = here.filter("fits and kind = 'object'").withColumn("keys", F.expr("json_object_keys(to_json(v))"))
        missing = objects.select("event_id", F.col("at").alias("path"), F.explode(F.array_except(F.coalesce("needed", empty), "keys")).alias("k"))
        extra = objects.filter("closed").select("event_id", F.col("at").alias("path"), F.explode(F.array_except("keys", F.coalesce("names", empty))).alias("k"))
        out += [wrong, missing.select("event_id", "path", F.concat(F.lit("missing "), "k").alias("error")), extra.select("event_id", "path", F.concat(F.lit("not allowed: "), "k").alias("error"))]
        if level + 1 < depth:
            inner = here.filter("fits and kind in ('object', 'array')")
            each = inner.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).toDF("i", "k", "value"))
            listed = F.col("kind") == "array"
            nodes = each.select(
                "event_id",
                F.when(listed, F.concat("at", F.lit("["), F.col("i").cast("string"), F.lit("]"))).otherwise(F.concat("at", F.lit("."), "k")).alias("at"),
                F.when(listed, F.concat("path", F.lit("[*]"))).otherwise(F.concat("path", F.lit("."), "k")).alias("path"),
                F.col("value").alias("v"),
            )
    return reduce(DataFrame.unionByName, out)
