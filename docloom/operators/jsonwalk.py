"""Walks over JSON of any depth, inside a document's own row, and what they look for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Which names are ids, and when a string is held to have drifted into Latin letters.
ID_NAME, LATIN_LEAST, LATIN_SHARE = r"_id$", 15, 0.6


def walk(c: Column) -> Column:
    """Every value of a JSON text: array of (path, parent, key, member, depth, value), parents before children, an object's members by name; null if the text isn't JSON.

    ``key`` is the name of the nearest object member above, as items of an array have none; ``member``: the value is an object's member, not an array's item.
    The row is opened level by level until nothing is left to open; a text has no more levels than brackets.
    """
    root = F.struct(F.lit("$").alias("path"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("key"), F.lit(False).alias("member"), F.lit(0).alias("depth"), F.try_parse_json(c).alias("value"))
    brackets = F.length(c) - F.length(F.translate(c, "{[", ""))

    def opened(n: Column) -> Column:
        child = lambda path, key, member, value: F.struct(path.alias("path"), n["path"].alias("parent"), key.alias("key"), F.lit(member).alias("member"), (n["depth"] + 1).alias("depth"), value.alias("value"))
        members = F.transform(F.map_entries(F.try_variant_get(n["value"], "$", "map<string,variant>")), lambda e: child(F.concat(n["path"], F.lit("."), e["key"]), e["key"], True, e["value"]))
        items = F.transform(F.try_variant_get(n["value"], "$", "array<variant>"), lambda x, i: child(F.concat(n["path"], F.lit("["), i.cast("string"), F.lit("]")), n["key"], False, x))
        return F.coalesce(members, items, F.slice(F.array(child(n["path"], n["key"], False, n["value"])), 1, 0))

    def level(s: Column, _: Column) -> Column:
        wider = F.struct(F.concat(s["done"], s["open"]).alias("done"), F.flatten(F.transform(s["open"], opened)).alias("open"))
        return F.when(F.size(s["open"]) > 0, wider).otherwise(s)

    start = F.struct(F.slice(F.array(root), 1, 0).alias("done"), F.array(root).alias("open"))
    end = F.aggregate(F.sequence(F.lit(0), brackets), start, level, lambda s: F.concat(s["done"], s["open"]))
    return F.when(F.try_parse_json(c).isNotNull(), end)


def text_of(value: Column) -> Column:
    """A string's text; null for any other kind of value."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def drifted(nodes: Column) -> Column:
    """The first string of several words that is written in Latin letters, as ``key='its beginning...'``; null without one. nodes: of ``walk``."""

    def found(n: Column) -> Column:
        visible = lambda t: F.regexp_replace(t, r"\s+", "")
        said = F.transform(F.array(text_of(n["value"])), lambda t: F.when(F.contains(F.trim(t), F.lit(" ")) & (F.length(visible(t)) >= LATIN_LEAST) & (F.length(F.regexp_replace(t, "[^A-Za-z]+", "")) / F.length(visible(t)) >= LATIN_SHARE), t))[0]
        return F.transform(F.array(said), lambda t: F.concat(F.coalesce(n["key"], F.lit("None")), F.lit("='"), F.substring(t, 1, 40), F.lit("...'")))[0]

    return F.get(F.filter(F.transform(nodes, found), lambda x: x.isNotNull()), F.lit(0))


def empty_ids(nodes: Column) -> Column:
    """Paths of members named like ids that are blank strings in objects with other content: a string that isn't blank, an array or object that isn't empty. nodes: of ``walk``."""
    id_like = lambda n: n["member"] & F.regexp_like(n["key"], F.lit(ID_NAME))
    size = lambda v: F.coalesce(F.size(F.try_variant_get(v, "$", "map<string,variant>")), F.size(F.try_variant_get(v, "$", "array<variant>")), F.lit(0))
    content = lambda n: n["member"] & ~F.regexp_like(n["key"], F.lit(ID_NAME)) & ((F.coalesce(F.trim(text_of(n["value"])), F.lit("")) != "") | (F.greatest(size(n["value"]), F.lit(0)) > 0))
    filled = F.array_distinct(F.transform(F.filter(nodes, content), lambda n: n["parent"]))
    blank = F.filter(nodes, lambda n: id_like(n) & (F.trim(text_of(n["value"])) == ""))
    return F.transform(F.array(F.struct(blank.alias("blank"), filled.alias("filled"))), lambda s: F.transform(F.filter(s["blank"], lambda n: F.array_contains(s["filled"], n["parent"])), lambda n: n["path"]))[0]
