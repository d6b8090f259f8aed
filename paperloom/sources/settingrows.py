"""Layered settings as rows, so that uploads of many templates run in one job, each under its own settings.

A layer is a JSON document for a template, or for all (a null template).  Documents are flattened to rows
(template, layer, path, value); which rows hold is told by an aggregation over the paths' prefixes, and
uploads get the values of their template by a join.

Layers merge as ``settings.merged`` does: objects key by key, anything else replaces what lower layers have
at its path or below it.  A document that is no object is no layer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LAYERS = "template string, layer int, document string"
#: Most templates whose values are broadcast.
BROADCAST_TEMPLATES = 10_000


def flattened(layers: DataFrame) -> DataFrame:
    """(template, layer, path, value, empty) of each value in the documents; value is JSON, empty says that it is an object without keys."""
    document = F.try_parse_json("document").alias("v")
    level = layers.select("template", F.col("layer").cast("int").alias("layer"), F.expr("cast(array() as array<string>)").alias("path"), document)
    level = level.where(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")))
    out = None
    while not level.isEmpty():  # once per depth of the documents
        each = level.select("template", "layer", "path", F.explode(F.expr("cast(v as map<string, variant>)")).alias("key", "v"))
        each = each.select("template", "layer", F.concat("path", F.array("key")).alias("path"), "v", F.coalesce(F.schema_of_variant("v"), F.lit("VOID")).alias("kind"))
        nested = F.startswith("kind", F.lit("OBJECT")) & (F.col("kind") != "OBJECT<>")
        leaves = each.where(~nested).select("template", "layer", "path", F.coalesce(F.to_json("v"), F.lit("null")).alias("value"), (F.col("kind") == "OBJECT<>").alias("empty"))
        out = leaves if out is None else out.unionByName(leaves)
        level = each.where(nested).select("template", "layer", "path", "v")
    if out is None:
        return layers.sparkSession.createDataFrame([], "template string, layer int, path array<string>, value string, empty boolean")
    return out


def resolved(layers: DataFrame) -> DataFrame:
    """(template, path, value) that hold for each template, and for uploads without one (a null template)."""
    rows = flattened(layers)
    names = [r.template for r in layers.select("template").distinct().collect() if r.template is not None]  # one per template
    own = rows.where(F.col("template").isNotNull())
    base = rows.where(F.col("template").isNull()).withColumn("template", F.explode(F.array(F.lit(None).cast("string"), *[F.lit(n) for n in names])))
    rows = base.unionByName(own).withColumn("template", F.coalesce(F.concat(F.lit("."), "template"), F.lit("")))
    upto = F.transform(F.sequence(F.lit(1), F.size("path")), lambda i: F.struct(F.slice("path", F.lit(1), i).alias("prefix"), (i < F.size("path")).alias("strict")))
    each = rows.select("*", F.inline(upto))
    known = each.groupBy("template", "prefix").agg(
        F.max(F.when(~F.col("strict") & ~F.col("empty"), F.col("layer"))).alias("set_at"), F.max(F.when(F.col("strict"), F.col("layer"))).alias("below_at"), F.max(F.when(~F.col("strict"), F.col("layer"))).alias("last_at")
    )
    replaced = F.coalesce(F.col("set_at") > F.col("layer"), F.lit(False))
    whole = ~F.col("strict")
    merged = whole & F.col("empty") & F.coalesce(F.col("below_at") > F.coalesce("set_at", F.lit(-1)), F.lit(False))
    opened = whole & ~F.col("empty") & (F.coalesce(F.col("below_at") > F.col("layer"), F.lit(False)) | (F.col("last_at") > F.col("layer")))
    again = whole & F.col("empty") & (F.col("last_at") > F.col("layer"))
    met = each.join(known, ["template", "prefix"]).groupBy("template", "layer", "path").agg(F.bool_or(replaced | merged | opened | again).alias("gone"), F.first("value").alias("value"))
    return met.where("not gone").select(F.when(F.col("template") != "", F.substring("template", 2, 1 << 20)).alias("template"), "path", "value")


def with_settings(uploads: DataFrame, held: DataFrame, wanted: dict[str, tuple[str, ...]], template: str = "template") -> DataFrame:
    """``uploads`` with a column (JSON) for each of the ``wanted`` paths, by their template; unknown templates have those of none."""
    names = [r.template for r in held.select("template").distinct().collect() if r.template is not None]  # one per template
    key = F.coalesce(F.concat(F.lit("."), "template"), F.lit(""))
    at = {n: F.max(F.when(F.col("path") == F.array(*[F.lit(p) for p in path]), F.col("value"))).alias(n) for n, path in wanted.items()}
    by = held.select(key.alias("__template"), "path", "value").groupBy("__template").agg(*at.values())
    if len(names) <= BROADCAST_TEMPLATES:
        by = F.broadcast(by)
    own = uploads.withColumn("__of", F.when(F.col(template).isin(names), F.concat(F.lit("."), template)).otherwise(""))
    return own.join(by, F.col("__of") == F.col("__template"), "left").drop("__of", "__template")
