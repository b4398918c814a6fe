"""Arrays, enums, integer arrays, maps of text, and label paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def array_length(a: Column) -> Column:
    """NULL for an empty array."""
    return F.nullif(F.size(a), F.lit(0))


def array_position(a: Column, x: Column) -> Column:
    """NULL where there is none."""
    return F.nullif(F.array_position(a, x), F.lit(0).cast("long"))


def array_replace(a: Column, old: Column, new: Column) -> Column:
    return F.transform(a, lambda x: F.when(x.eqNullSafe(old), new).otherwise(x))


def array_to_string(a: Column, delimiter: str, null: str | None = None) -> Column:
    return F.array_join(a, delimiter) if null is None else F.array_join(a, delimiter, null)


def string_to_array(text: Column, delimiter: str, null: str | None = None) -> Column:
    parts = F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "\\Q" + delimiter + "\\E", -1))
    return parts if null is None else F.transform(parts, lambda x: F.when(x != null, x))


def subscript(a: Column, i: Column) -> Column:
    """1-based, NULL outside."""
    return F.when(i >= 1, F.try_element_at(a, F.when(i >= 1, i).otherwise(F.lit(1))))


def array_slice(a: Column, lo: int, hi: int) -> Column:
    lo = max(1, lo)
    return F.slice(a, lo, max(0, hi - lo + 1))


def any_of(x: Column, a: Column, op) -> Column:
    """x op ANY (array)."""
    return F.exists(a, lambda v: op(x, v))


def all_of(x: Column, a: Column, op) -> Column:
    return F.forall(a, lambda v: op(x, v))


# Enums: labels in order of declaration -----------------------------------------------
def enum_ordinal(label: Column, labels: Sequence[str]) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in labels]), label)


def enum_range(labels: Sequence[str], first: Column | None = None, last: Column | None = None) -> Column:
    every = F.array(*[F.lit(x) for x in labels])
    lo = F.coalesce(enum_ordinal(first, labels), F.lit(1)) if first is not None else F.lit(1)
    hi = F.coalesce(enum_ordinal(last, labels), F.lit(len(labels))) if last is not None else F.lit(len(labels))
    return F.slice(every, lo.cast("int"), F.greatest(hi - lo + 1, F.lit(0)).cast("int"))


# Integer arrays ------------------------------------------------------------------------
def int_overlap(a: Column, b: Column) -> Column:
    return F.arrays_overlap(a, b)


def int_contains(a: Column, b: Column) -> Column:
    return F.size(F.array_except(b, a)) == 0


def int_union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def int_intersection(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def int_difference(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_except(a, b))


def idx(a: Column, x: Column) -> Column:
    """Place of x, 0 where there is none."""
    return F.array_position(a, x)


def uniq(a: Column) -> Column:
    """Drops repeats that stand next to each other."""
    return F.transform(F.filter(F.transform(a, lambda x, i: F.struct(x.alias("x"), ((i == 0) | ~x.eqNullSafe(F.get(a, i - 1))).alias("new"))), lambda s: s["new"]), lambda s: s["x"])


def query_int(a: Column, query: str) -> Column:
    """a @@ query: numbers joined by &, |, ! and parentheses."""
    import re

    tokens = re.findall(r"\d+|[&|!()]", query)
    return _boolean(tokens, lambda n: F.array_contains(a, int(n)))


def _boolean(tokens: list[str], leaf) -> Column:
    """Or of ands of possibly negated leaves, by descent."""
    at = 0

    def either() -> Column:
        nonlocal at
        out = both()
        while at < len(tokens) and tokens[at] == "|":
            at += 1
            out = out | both()
        return out

    def both() -> Column:
        nonlocal at
        out = one()
        while at < len(tokens) and tokens[at] == "&":
            at += 1
            out = out & one()
        return out

    def one() -> Column:
        nonlocal at
        t = tokens[at]
        at += 1
        if t == "!":
            return ~one()
        if t == "(":
            out = either()
            at += 1
            return out
        return leaf(t)

    return either()


# Maps of text to text --------------------------------------------------------------------
def hstore(text: Column) -> Column:
    """'a=>1, b=>NULL' as a map; the first of equal keys stays."""
    item = r'("(?:[^"\\]|\\.)*"|[^\s,=]+)\s*=>\s*("(?:[^"\\]|\\.)*"|[^\s,]+)'
    bare = lambda x: F.when(F.startswith(x, F.lit('"')), F.regexp_replace(F.regexp_replace(x, '^"|"$', ""), r"\\(.)", "$1")).otherwise(x)
    keys = F.transform(F.regexp_extract_all(text, F.lit(item), F.lit(1)), bare)
    values = F.transform(F.regexp_extract_all(text, F.lit(item), F.lit(2)), lambda x: F.when(F.upper(x) != "NULL", bare(x)))
    first = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v"), F.sequence(F.lit(1), F.greatest(F.size(keys), F.lit(1))).alias("i")), lambda s: s["k"].isNotNull() & (F.array_position(keys, s["k"]) == s["i"]))
    return F.map_from_arrays(F.transform(first, lambda s: s["k"]), F.transform(first, lambda s: s["v"]))


def map_contains(a: Column, b: Column) -> Column:
    """a @> b."""
    return F.forall(F.map_entries(b), lambda e: F.map_contains_key(a, e["key"]) & a[e["key"]].eqNullSafe(e["value"]))


def map_update(a: Column, b: Column) -> Column:
    """a || b: the right value wins."""
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)


def map_delete(a: Column, keys: Column) -> Column:
    return F.map_filter(a, lambda k, v: ~F.array_contains(keys, k))


# Label paths -------------------------------------------------------------------------------
def labels(path: Column) -> Column:
    return F.filter(F.split(path, r"\."), lambda x: x != "")


def is_ancestor(a: Column, b: Column) -> Column:
    """a @> b: a is b or lies above it."""
    return F.slice(labels(b), F.lit(1), F.size(labels(a))) == labels(a)


def subpath(path: Column, offset: int, length: int | None = None) -> Column:
    x = labels(path)
    start = F.lit(offset) if offset >= 0 else F.greatest(F.size(x) + offset, F.lit(0))
    end = F.size(x) if length is None else (start + length if length >= 0 else F.size(x) + length)
    return F.array_join(F.slice(x, start + 1, F.greatest(end - start, F.lit(0))), ".")


def lca(a: Column, b: Column) -> Column:
    """The longest path that lies above both."""
    x, y = labels(a), labels(b)
    most = F.least(F.size(x), F.size(y)) - 1
    same = F.filter(F.sequence(F.lit(0), F.greatest(most, F.lit(0))), lambda n: F.slice(x, F.lit(1), n) == F.slice(y, F.lit(1), n))
    return F.when(most >= 0, F.array_join(F.slice(x, F.lit(1), F.array_max(same)), "."))


def lquery(path: Column, query: str) -> Column:
    """path ~ lquery: labels, *, *{n,m}, prefix marks, alternatives and negation."""
    import re

    out = []
    for level in query.split("."):
        m = re.fullmatch(r"\*(?:\{(\d*)(,?)(\d*)\})?", level)
        if m:
            lo, comma, hi = m[1] or "0", m[2], m[3] or ""
            n = f"{{{lo},{hi}}}" if comma or m[1] is None else f"{{{lo}}}"
            out.append(rf"(?:[^.]+\.){n}")
            continue
        no = level.startswith("!")
        names = []
        for name in level.removeprefix("!").split("|"):
            flags = re.search(r"[@*%]*$", name)[0]
            body = re.escape(name[: len(name) - len(flags)])
            names.append(("(?i:" if "@" in flags else "(?:") + body + (r"[^.]*" if "*" in flags else "") + ")")
        inner = "|".join(names)
        out.append(rf"(?!(?:{inner})\.)[^.]+\." if no else rf"(?:{inner})\.")
    return F.concat(path, F.lit(".")).rlike("^" + "".join(out) + "$")
