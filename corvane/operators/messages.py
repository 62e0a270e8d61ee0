"""Operators over chat and tool messages, and over what a language model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import mentioned_paths

FIELDS = ("symbols", "concepts", "error_terms", "sub_queries")


def paths_of_messages(messages: DataFrame, roles: tuple[str, ...] = ("assistant", "tool")) -> DataFrame:
    """(conv_id, path, ord): file paths that messages (conv_id, turn, role, text) mention, each once, in order."""
    each = messages.filter(F.col("role").isin(*roles)).select("conv_id", "turn", F.posexplode(mentioned_paths(F.col("text"))).alias("pos", "path"))
    first = each.groupBy("conv_id", "path").agg(F.min(F.struct("turn", "pos")).alias("f"))
    return first.select("conv_id", "path", F.row_number().over(Window.partitionBy("conv_id").orderBy("f", "path")).alias("ord"))


def paths_of_results(messages: DataFrame) -> DataFrame:
    """(conv_id, path, ord): paths in the JSON arrays that tools (role 'tool') return, each once, in order."""
    arrays = messages.filter("role = 'tool' and text like '[%'").select("conv_id", "turn", F.from_json("text", "array<struct<path:string>>").alias("items"))
    each = arrays.select("conv_id", "turn", F.posexplode("items").alias("pos", "item")).select("conv_id", "turn", "pos", F.col("item.path").alias("path")).filter("path <> ''")
    first = each.groupBy("conv_id", "path").agg(F.min(F.struct("turn", "pos")).alias("f"))
    return first.select("conv_id", "path", F.row_number().over(Window.partitionBy("conv_id").orderBy("f", "path")).alias("ord"))


def extraction(raw: Column) -> Column:
    """The answer of a model as a struct of four string lists: the whole as JSON, else its part from the first to the last
    brace; a string stands for a list of one, anything else for an empty list."""
    inner = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    text = F.when(F.try_parse_json(raw).isNotNull() & F.trim(raw).startswith("{"), raw).otherwise(F.nullif(inner, F.lit("")))

    whole = F.try_parse_json(text)

    def one(name: str) -> Column:
        value = F.try_variant_get(whole, f"$.{name}", "variant")
        kind = F.schema_of_variant(value)
        listed = F.filter(F.try_variant_get(whole, f"$.{name}", "array<string>"), lambda v: v.isNotNull() & (v != ""))
        single = F.try_variant_get(whole, f"$.{name}", "string")
        return F.coalesce(F.when(kind.startswith("ARRAY"), listed), F.when((kind == "STRING") & (single != ""), F.array(single)), F.array().cast("array<string>")).alias(name)

    return F.struct(*[one(n) for n in FIELDS])


def sub_queries(query: Column, parts: Column) -> Column:
    """Queries to run: the original, the original with up to 10 symbols and error terms, up to 3 concepts, up to 3 others."""
    extra = F.concat(parts["symbols"], parts["error_terms"])
    wide = F.when(F.size(extra) > 0, F.array(F.concat_ws(" ", query, F.array_join(F.slice(extra, 1, 10), " ")))).otherwise(F.array().cast("array<string>"))
    first = F.concat(F.array(query), wide, F.slice(parts["concepts"], 1, 3))
    more = F.filter(F.array_distinct(F.slice(parts["sub_queries"], 1, 3)), lambda s: ~F.array_contains(first, s))
    return F.concat(first, more)


def import_edges(files: DataFrame, paths: DataFrame, weight: float = 0.9) -> DataFrame:
    """(from_path, to_path, edge_kind, weight): files (path, content) to the files of the modules they import."""
    from corvane.functions.text import imported_modules
    from corvane.operators.lookups import module_paths

    each = files.select("path", F.explode(imported_modules(F.col("content"))).alias("module"))
    found = module_paths(each.select("module"), paths).filter("path is not null").withColumnRenamed("path", "to_path")
    return each.join(found, "module").filter("path <> to_path").select(F.col("path").alias("from_path"), "to_path", F.lit("import").alias("edge_kind"), F.lit(weight).alias("weight")).distinct()
