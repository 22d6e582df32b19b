"""Reading loosely typed JSON: VARIANT nodes to typed columns.

Every helper takes a VARIANT column (a node) and gives NULL when the node has
the wrong type; none of them raises under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that read as a number, as digits, as nothing.
_NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*$"
_DIGITS = r"^\s*(\d+)\s*$"
_BLANK = r"^\s*$"
# How a VARIANT names the types of JSON numbers.
_NUMERIC = "^(BIGINT|DECIMAL|DOUBLE|FLOAT)"
_BLANKS = " \t\r\n\f"
# What a count beyond BIGINT reads as.
_MOST = (1 << 63) - 1


def get(v: Column | str, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def kind(node: Column) -> Column:
    return F.schema_of_variant(node)


def is_object(node: Column) -> Column:
    return F.try_variant_get(node, "$", "struct<_ variant>").isNotNull()


def fields(node: Column | str, names: list[str], path: str = "$") -> Column:
    """Several fields of an object at once, as a struct of nodes; NULL if the node (at ``path``) is no object.

    One pass over the object instead of one path walk per field.
    """
    return F.try_variant_get(node, path, "struct<" + ", ".join(f"`{n}` variant" for n in names) + ">")


def elements(node: Column) -> Column:
    """ARRAY<VARIANT> of an array node, else NULL."""
    return F.try_variant_get(node, "$", "array<variant>")


def absent(node: Column) -> Column:
    """True where the key is missing (a JSON null is present)."""
    return node.isNull()


def missing_or_null(node: Column) -> Column:
    return node.isNull() | F.is_variant_null(node)


def is_string(node: Column) -> Column:
    return F.coalesce(kind(node) == "STRING", F.lit(False))


def string(node: Column) -> Column:
    return F.when(kind(node) == "STRING", F.try_variant_get(node, "$", "string"))


def text(node: Column) -> Column:
    """P5: a non-empty string; numbers are not text."""
    return F.nullif(string(node), F.lit(""))


def trimmed(node: Column) -> Column:
    """P16 leaf: a string with something left after trimming."""
    return F.nullif(F.btrim(string(node), F.lit(_BLANKS)), F.lit(""))


def is_number(node: Column) -> Column:
    return F.coalesce(kind(node).rlike(_NUMERIC), F.lit(False))


def number(node: Column) -> Column:
    """A JSON number; the text "100" is text and therefore not one."""
    return F.when(kind(node).rlike(_NUMERIC), F.try_variant_get(node, "$", "double"))


def lenient_number(node: Column) -> Column:
    """A number, or text that reads as one (blank text reads as 0). Only text takes the way through patterns."""
    text_ = string(node)
    read = F.coalesce(F.regexp_extract(text_, _NUMBER, 1).try_cast("double"), F.when(text_.rlike(_BLANK), F.lit(0.0)))
    return F.coalesce(number(node), read)


def whole(value: Column) -> Column:
    """Truncate toward zero and floor at zero; beyond BIGINT is its largest value, no number is 0."""
    floored = F.greatest(value, F.lit(0.0))
    return F.coalesce(floored.try_cast("bigint"), F.when(floored > 0, F.lit(_MOST)), F.lit(0).cast("bigint"))


def count(*nodes: Column) -> Column:
    """First node that reads as a number, as a non-negative integer; else 0."""
    return whole(first(list(nodes), lenient_number) if len(nodes) > 1 else lenient_number(nodes[0]))


def natural(node: Column) -> Column:
    """A non-negative integer, or a string of digits; else NULL."""
    exact = F.when(kind(node) == "BIGINT", F.try_variant_get(node, "$", "bigint"))
    value = number(node)
    integral = F.when(value == F.floor(value), value.try_cast("bigint"))  # 5.0 counts, 5.5 does not
    some = F.coalesce(exact, integral)
    return F.coalesce(F.when(some >= 0, some), F.regexp_extract(string(node), _DIGITS, 1).try_cast("bigint"))


def first(nodes: list[Column], read) -> Column:
    """First non-NULL ``read(node)``. A lambda keeps the plan small where ``coalesce`` would repeat ``read``.

    Most nodes of a list are not there and read as NULL, so only the others are read.
    """
    there = F.array_compact(F.array(*nodes))
    return F.try_element_at(F.filter(F.transform(there, read), lambda x: x.isNotNull()), F.lit(1))


def parse_once(df, value: Column, keep: list[str], name: str = "v"):
    """Add the parsed JSON of ``value`` as ``name``.

    A filter above a projection is pushed into it, which would parse the text
    once per reference; a generator keeps the parsed value as one column.
    """
    return df.select(*keep, F.explode(F.array(value)).alias(name))


def otel_value(node: Column) -> Column:
    """P10: an attribute that may be wrapped as {intValue|doubleValue|stringValue|value}."""
    inner = [get(node, f"$.{w}") for w in ("intValue", "doubleValue", "stringValue", "value")]
    unwrapped = F.coalesce(*[F.when(~F.is_variant_null(n), n) for n in inner], node)
    return F.when(is_object(node), unwrapped).otherwise(F.when(~F.is_variant_null(node), node))


def otel_text(nodes: list[Column]) -> Column:
    """First unwrapped attribute that is non-empty text or a number (as text)."""
    def read(node: Column) -> Column:
        return F.when(kind(node).rlike("^(STRING|BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.nullif(F.try_variant_get(node, "$", "string"), F.lit("")))

    return first(nodes, read)


def owners_of_keys(text_: Column, node: Column, key_sets: list[list[str]], depth: int = 6) -> Column:
    """For each set of keys the first object, outermost first and in key order, that owns one of them; NULL if there is none.

    ``node`` is the VARIANT of the JSON ``text_``. A VARIANT sorts object keys, so their order is read from the text, one
    level at a time for all sets together: every object or array of a level carries its path of places, its own text and
    its node. Of all owners the one with the least path is the first that a search in depth meets; nodes behind the
    owners of every set are not looked into.
    """

    def inner(raw: Column, v: Column, path: Column) -> Column:
        """The objects and arrays right below a node, with their paths."""
        texts, nodes = F.from_json(raw, "map<string,string>"), F.try_variant_get(v, "$", "map<string,variant>")
        named = F.transform(F.map_keys(texts), lambda k, i: F.struct(F.concat(path, F.array(i)).alias("path"), F.try_element_at(texts, k).alias("raw"), F.try_element_at(nodes, k).alias("v")))
        items = F.from_json(raw, "array<string>")
        listed = F.transform(elements(v), lambda x, i: F.struct(F.concat(path, F.array(i)).alias("path"), F.get(items, i).alias("raw"), x.alias("v")))
        found = F.when(is_object(v), named).otherwise(listed)
        return F.filter(F.coalesce(found, F.array().cast(_LEVEL)), lambda c: kind(c["v"]).rlike("^(OBJECT|ARRAY)"))

    def least(level: Column, keys: list[str]) -> Column:
        """The first owner of a level: its nodes stand in the order of their paths."""
        wanted = F.array(*[F.lit(k) for k in keys])
        owns = lambda c: F.coalesce(F.arrays_overlap(F.map_keys(F.try_variant_get(c["v"], "$", "map<string,variant>")), wanted), F.lit(False))
        return F.try_element_at(F.filter(level, owns), F.lit(1))

    def deeper(acc: Column, _: Column) -> Column:
        ahead = F.filter(acc["level"], lambda c: F.exists(acc["best"], lambda b: b.isNull() | (c["path"] < b["path"])))
        level = F.flatten(F.transform(ahead, lambda c: inner(c["raw"], c["v"], c["path"])))
        # A one-element array keeps the level computed once for its owners and for the next step.
        found = lambda x: F.array(*[_first(F.get(acc["best"], i), least(x, keys)) for i, keys in enumerate(key_sets)])
        return F.transform(F.array(level), lambda x: F.struct(x.alias("level"), found(x).alias("best")).cast(_SEARCH))[0]

    top = F.array(F.struct(F.array().cast("array<int>").alias("path"), text_.alias("raw"), node.alias("v")))
    start = F.struct(top.alias("level"), F.array(*[least(top, keys) for keys in key_sets]).alias("best")).cast(_SEARCH)
    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), start, deeper, lambda acc: F.transform(acc["best"], lambda b: b["v"]))


def owner_of_keys(text_: Column, node: Column, keys: list[str], depth: int = 6) -> Column:
    """P9 for one set of keys."""
    return F.get(owners_of_keys(text_, node, [keys], depth), 0)


def _first(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | (b["path"] < a["path"]), b).otherwise(a)


_NODE = "struct<path:array<int>,raw:string,v:variant>"
_LEVEL = f"array<{_NODE}>"
_SEARCH = f"struct<level:{_LEVEL},best:array<{_NODE}>>"
