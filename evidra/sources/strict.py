"""Strict form of JSON: texts walked as VARIANT against a closed schema table, level by level, and every misfit a row.

The schema is a table of places: what kind of value stands there, whether null may, which members an object has, and which values are allowed.
A place is named by the members that lead to it; elements of arrays and values of maps have the place of what holds them. A level looks
its values up in that small table and makes rows of their children, so nothing is shuffled and no document is parsed on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as K

from evidra.functions import text as T

PLACES = "at string, kind string, inner string, nullable boolean, members array<string>, allowed array<string>, depth int"
STAMP = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|\+00:00)$"


def places(kind: K.DataType, at: str, nullable: set[str], allowed: dict[str, tuple[str, ...]], depth: int = 0) -> list[tuple]:
    """Rows of PLACES for a type and all below it. An open object is a type of binary: anything may stand there, as long as it is one."""
    inner, below = "", []
    if isinstance(kind, K.StructType):
        name, members = "object", list(kind.names)
        for f in kind.fields:
            below += places(f.dataType, f"{at}.{f.name}", nullable, allowed, depth + 1)
    elif isinstance(kind, (K.ArrayType, K.MapType)):
        name, members = ("array" if isinstance(kind, K.ArrayType) else "map"), None
        inner = f"{at}[]"
        below = places(kind.elementType if isinstance(kind, K.ArrayType) else kind.valueType, inner, nullable, allowed, depth + 1)
    else:
        members = None
        name = {"string": "string", "boolean": "boolean", "int": "int", "bigint": "int", "double": "number", "timestamp": "stamp", "binary": "open"}[kind.simpleString()]
    plain = at.replace("[]", "")
    # What holds for an array's elements is said of the array: only they have it.
    own = None if isinstance(kind, K.ArrayType) else list(allowed[plain]) if plain in allowed else None
    return [(at, name, inner, plain in nullable and not at.endswith("[]"), members, own, depth), *below]


def table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, PLACES)


def _kind(v: Column, entries: Column, elements: Column) -> Column:
    # Only a scalar's schema is asked for, as that of an object walks through all that it holds.
    scalar = T.let(F.schema_of_variant(v), lambda said: F.when(said == "STRING", "string").when(said == "BOOLEAN", "boolean").when(said == "BIGINT", "int").otherwise("number"))
    return F.when(F.is_variant_null(v), "null").when(entries.isNotNull(), "object").when(elements.isNotNull(), "array").otherwise(scalar)


_CHILD = "struct<at:string,rule:string,v:variant>"


def misfits(texts: DataFrame, schema: DataFrame, depth: int, root: str) -> DataFrame:
    """(id, at, rule) for texts (id, text): rule is json, kind, null, unknown, missing or value. No rows for a text that fits.

    depth: levels of the schema. at never holds a value, only names of the schema; of members that it does not have their holder is named.
    """
    none = F.lit(None).cast("string")
    level = texts.select("id", F.lit(root).alias("at"), none.alias("rule"), F.try_parse_json("text").alias("v"))
    level = level.withColumn("rule", F.when(F.col("v").isNull(), "json"))
    # The same columns on every level.
    wanted = F.col("kind")
    is_ = F.col("is")
    fine = F.when(wanted.isin("map", "open"), is_ == "object").when(wanted == "stamp", is_ == "string").when(wanted == "number", is_.isin("int", "number")).otherwise(is_ == wanted)
    get = lambda kind: F.try_variant_get(F.col("v"), "$", kind)
    bad_value = (
        F.when(wanted == "stamp", ~get("string").rlike(STAMP))
        .when(wanted.isin("int", "number"), (get("double") < 0) | (F.col("at").contains("confidence") & (get("double") > 1)))
        .when(F.col("allowed").isNotNull() & (F.col("is") == "string"), ~F.array_contains("allowed", get("string")))
        .otherwise(False)
    )
    one = lambda at, rule, v=None: F.struct(at.alias("at"), F.lit(rule).cast("string").alias("rule"), (F.lit(None).cast("variant") if v is None else v).alias("v")).cast(_CHILD)
    some = lambda when, x: F.when(when, F.array(x)).otherwise(F.array().cast(f"array<{_CHILD}>"))
    at = F.col("at")
    entries, elements = F.col("entries"), F.col("elements")
    keys = F.coalesce(F.transform(entries, lambda e: e["key"]), F.array().cast("array<string>"))
    object_ = F.col("fine") & (wanted == "object")
    children = (
        F.when(object_, F.transform(F.filter(entries, lambda e: F.array_contains("members", e["key"])), lambda e: one(F.concat(at, F.lit("."), e["key"]), None, e["value"])))
        .when(F.col("fine") & (wanted == "map"), F.transform(entries, lambda e: one(F.col("inner"), None, e["value"])))
        .when(F.col("fine") & (wanted == "array"), F.transform(elements, lambda x: one(F.col("inner"), None, x)))
    )
    rows = F.concat(
        some(F.col("rule").isNotNull(), one(at, "").withField("rule", F.col("rule"))),
        some((F.col("is") == "null") & ~F.col("nullable"), one(at, "null")),
        some((F.col("is") != "null") & ~F.col("fine"), one(at, "kind")),
        some(F.col("fine") & F.coalesce(bad_value, F.lit(True)), one(at, "value")),
        some(object_ & (F.size(F.array_except(keys, "members")) > 0), one(at, "unknown")),
        F.when(object_, F.transform(F.array_except("members", keys), lambda k: one(F.concat(at, F.lit("."), k), "missing"))).otherwise(F.array().cast(f"array<{_CHILD}>")),
        F.coalesce(children, F.array().cast(f"array<{_CHILD}>")),
    )
    known = F.broadcast(schema.drop("depth"))
    columns = ["id", "at", "rule", "v", "kind", "inner", "nullable", "members", "allowed"]
    for _ in range(depth + 1):
        met = level.join(known, "at", "left").select(*columns, F.when(F.col("rule").isNull(), F.col("v")).alias("w"))
        met = met.select(*columns, "w", F.map_entries(F.try_variant_get("w", "$", "map<string,variant>")).alias("entries"), F.try_variant_get("w", "$", "array<variant>").alias("elements"))
        met = met.select(*columns, "entries", "elements", F.when(F.col("rule").isNull(), _kind(F.col("w"), entries, elements)).alias("is"))
        # The outer form, so that no inferred filter works out all rows again.
        below = met.select(*columns, "entries", "elements", "is", fine.alias("fine")).select("id", F.explode_outer(rows).alias("r"))
        level = below.where("r is not null").select("id", "r.*")
    return level.where("rule is not null").select("id", "at", "rule")
