"""JSON documents as VARIANT or text, and XML tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def object_keys(j: Column) -> Column:
    return F.json_object_keys(j)


def exists_key(j: Column, key: str) -> Column:
    """j ? key."""
    return F.coalesce(F.array_contains(F.json_object_keys(j), key), F.lit(False))


def exists_any(j: Column, keys: Sequence[str]) -> Column:
    return F.coalesce(F.arrays_overlap(F.json_object_keys(j), F.array(*[F.lit(k) for k in keys])), F.lit(False))


def exists_all(j: Column, keys: Sequence[str]) -> Column:
    return F.coalesce(F.size(F.array_except(F.array(*[F.lit(k) for k in keys]), F.json_object_keys(j))) == 0, F.lit(False))


def json_typeof(j: Column) -> Column:
    """object, array, string, number, boolean or null of a JSON text."""
    first = F.substring(F.ltrim(j), 1, 1)
    return F.when(first == "{", "object").when(first == "[", "array").when(first == '"', "string").when(first.isin("t", "f"), "boolean").when(first == "n", "null").otherwise("number")


def flat_contains(a: Column, b: Column) -> Column:
    """a @> b for objects of scalars: every pair of b is in a."""
    x, y = F.from_json(a, "map<string,string>"), F.from_json(b, "map<string,string>")
    return F.forall(F.map_entries(y), lambda e: F.map_contains_key(x, e["key"]) & x[e["key"]].eqNullSafe(e["value"]))


def json_set(j: Column, key: str, value: Column) -> Column:
    """jsonb_set for a top-level key of an object of scalars."""
    m = F.from_json(j, "map<string,string>")
    kept = F.map_filter(m, lambda k, v: k != key)
    return F.to_json(F.map_concat(kept, F.create_map(F.lit(key), value.cast("string"))))


def strip_nulls(j: Column) -> Column:
    return F.to_json(F.map_filter(F.from_json(j, "map<string,string>"), lambda k, v: v.isNotNull()))


def path(j: Column, p: str, kind: str = "string") -> Column:
    """A plain SQL/JSON path; NULL where it leads nowhere."""
    return F.try_variant_get(F.try_parse_json(j), p, kind)


def path_filter(j: Column, items: str, keep, kind: str) -> Column:
    """$.items[*] ? (...): the elements of an array path for which ``keep`` holds."""
    return F.filter(F.from_json(F.get_json_object(j, items), f"array<{kind}>"), keep)


def each(df: DataFrame, column: str, key: str = "key", value: str = "value") -> DataFrame:
    """json_each_text: a row for each pair of an object."""
    return df.select("*", F.explode(F.from_json(column, "map<string,string>")).alias(key, value))


def xml_table(df: DataFrame, column: str, rows: str, columns: dict[str, tuple[str, str]], ordinality: str | None = None) -> DataFrame:
    """XMLTABLE: a row for each node at ``rows`` (/root/.../node); columns: name -> (relative path, type; @x: an attribute).

    The nodes are read first and the columns inside each of them, so a column that a node lacks is NULL.
    """
    fields: dict = {}
    for path_, _ in columns.values():
        at = fields
        *above, last = path_.replace("@", "_").split("/")
        for part in above:
            at = at.setdefault(part, {})
        at.setdefault(last, None)

    def ddl(tree: dict) -> str:
        return ", ".join(f"`{k}`: STRING" if v is None else f"`{k}`: STRUCT<{ddl(v)}>" for k, v in tree.items())

    root, *inner, node = rows.strip("/").split("/")
    schema = f"`{node}`: ARRAY<STRUCT<{ddl(fields)}>>"
    for part in reversed(inner):
        schema = f"`{part}`: STRUCT<{schema}>"
    read = F.from_xml(F.col(column), f"STRUCT<{schema}>", {"rowTag": root, "attributePrefix": "_"})
    for part in (*inner, node):
        read = read[part]
    placed = df.select("*", F.posexplode(read).alias("at__", "node__"))
    out = [F.col("node__." + ".".join(f"`{x}`" for x in p.replace("@", "_").split("/"))).cast(t).alias(n) for n, (p, t) in columns.items()]
    return placed.select(*df.columns, *([(F.col("at__") + 1).alias(ordinality)] if ordinality else []), *out)


def canonical(j: Column) -> Column:
    """A JSON text with sorted keys and no blanks: equal documents give equal texts (jsonb equality)."""
    return F.to_json(F.try_parse_json(j))


def json_equal(a: Column, b: Column) -> Column:
    return canonical(a) == canonical(b)


def object_agg(key: str, value: str) -> Column:
    """json_object_agg, in the order of keys; a repeated key keeps its largest value."""
    pairs = F.array_sort(F.collect_set(F.struct(F.col(key).alias("k"), F.col(value).alias("v"))))
    last = F.filter(pairs, lambda p, i: (i == F.size(pairs) - 1) | (F.get(pairs, i + 1)["k"] != p["k"]))
    return F.to_json(F.map_from_entries(last))


def xml_text(value: Column) -> Column:
    """A value with the marks of XML escaped."""
    out = value.cast("string")
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return out


def xml_element(name: str, *content: Column, **attributes: Column) -> Column:
    """xmlelement(name, xmlattributes(...), content): contents are XML already; NULL ones and NULL attributes are left out."""
    given = [F.concat(F.lit(f' {k}="'), F.replace(xml_text(v), F.lit('"'), F.lit("&quot;")), F.lit('"')) for k, v in attributes.items()]
    inside = F.concat_ws("", *content) if content else F.lit("")
    start = F.concat(F.lit(f"<{name}"), F.concat_ws("", *given) if given else F.lit(""))
    return F.when(inside == "", F.concat(start, F.lit("/>"))).otherwise(F.concat(start, F.lit(">"), inside, F.lit(f"</{name}>")))


def xml_forest(**values: Column) -> Column:
    """xmlforest: an element for each value that is not NULL."""
    return F.concat_ws("", *[F.when(v.isNotNull(), xml_element(k, xml_text(v))) for k, v in values.items()])


def table_to_xml(df: DataFrame, order: Sequence[str], name: str = "table") -> DataFrame:
    """table_to_xml: a row of XML for each row, and its place by ``order`` (the document is these rows in that order)."""
    return df.select(*order, xml_element("row", *[xml_forest(**{c: F.col(c)}) for c in df.columns]).alias(name))
