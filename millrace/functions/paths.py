"""Dotted paths into rows, for both lanes: typed columns, and bodies of type map<string,variant>.

A path is names joined by dots, with an optional leading ``$.``; a number indexes an array and ``#`` is an array's length. ``#(a.b == "x")`` is the
first element of an array whose a.b is x, ``#(...)#`` all such elements; without a path the elements themselves are compared, and conditions may
hold conditions. In the dynamic lane a JSON null exists and a missing key does not; in the typed lane null and missing are the same.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BODY = "body"


#: The signs of conditions, those that hold others first. % matches a pattern of * and ?.
SIGNS = ("!=", "!%", "<=", ">=", "==", "=", "<", ">", "%")


def _split(text: str) -> list[str]:
    """The parts of a path between dots outside of parentheses and quotes."""
    parts, depth, quote, escaped = [""], 0, False, False
    for c in text:
        if quote:
            quote, escaped = escaped or c != '"', not escaped and c == "\\"
        elif c == '"' and depth:
            quote = True
        elif c in "()":
            if c == ")" or parts[-1] == "#" or depth:  # a parenthesis of a plain name is part of it
                depth = max(0, depth + (1 if c == "(" else -1))
        if c == "." and not depth:
            parts.append("")
        else:
            parts[-1] += c
    if depth or quote:
        raise ValueError(f"unclosed condition: {text!r}")
    return [p for p in parts if p]


def segments(path: str) -> list[str]:
    bare = path[2:] if path.startswith("$.") else path[1:] if path.startswith("$") else path
    found = _split(bare)
    if not found:
        raise ValueError(f"empty path: {path!r}")
    return found


@dataclass(frozen=True)
class Query:
    """A condition on elements: the path in each (empty for the element itself), a sign (empty: the path exists), what it is compared with; every: all
    elements that fulfil it, else the first."""

    path: str
    sign: str
    literal: str | float | bool | None
    every: bool


def query_of(segment: str) -> Query | None:
    """The condition of a path's segment ``#(...)`` or ``#(...)#``; None for other segments."""
    if not segment.startswith("#(") or not segment.endswith((")", ")#")):
        return None
    every = segment.endswith("#")
    inner = segment[2 : -2 if every else -1].strip()
    depth, quote = 0, False
    for i, c in enumerate(inner):
        quote = quote != (c == '"' and inner[i - 1 : i] != "\\")
        depth += 0 if quote else {"(": 1, ")": -1}.get(c, 0)
        sign = next((s for s in SIGNS if inner.startswith(s, i)), None)
        if sign and not depth and not quote:
            return Query(inner[:i].strip(), "==" if sign == "=" else sign, _literal(inner[i + len(sign) :].strip()), every)
    return Query(inner, "", None, every)


def _literal(text: str) -> str | float | bool | None:
    if text.startswith('"'):
        return re.sub(r"\\(.)", r"\1", text[1:-1] if text.endswith('"') and len(text) > 1 else text[1:])
    if text in ("true", "false", "null"):
        return {"true": True, "false": False, "null": None}[text]
    try:
        return float(text)
    except ValueError:
        return text


def _pattern(text: str) -> str:
    """A pattern of * and ? as a regular expression of the whole."""
    return "(?s)^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in text) + "$"


def _compares(sign: str, literal: str | float | bool | None, text: Column, number: Column, flag: Column, is_null: Column) -> Column:
    """Whether a value (its text, number or boolean, where it is one) stands to a literal as a sign says; values of another kind do not, except that they
    are different."""
    if sign in ("%", "!%"):
        found = F.coalesce(text.rlike(_pattern(str(literal))), F.lit(False))
        return found if sign == "%" else text.isNotNull() & ~found
    value = text if isinstance(literal, str) else flag if isinstance(literal, bool) else number
    if literal is None:
        found = {"==": is_null, "!=": ~is_null}.get(sign, F.lit(False))
    else:
        right = F.lit(literal)
        found = {"==": value == right, "!=": value != right, "<": value < right, "<=": value <= right, ">": value > right, ">=": value >= right}[sign]
        if sign == "!=":
            found = F.coalesce(found, F.lit(True))
    return F.coalesce(found, F.lit(False))


def last_segment(path: str) -> str:
    return segments(path)[-1]


def is_dynamic(df: DataFrame) -> bool:
    return BODY in df.columns and df.schema[BODY].dataType == T.MapType(T.StringType(), T.VariantType())


def parse_body(df: DataFrame, text: str = "value", body: str = BODY) -> DataFrame:
    """df with the JSON objects of a text (or binary) column as bodies; anything else has a null body and keeps its bytes."""
    return df.withColumn(body, F.from_json(F.col(text).cast("string"), "map<string,variant>", {"allowSingleQuotes": "false"}))


def render_body(df: DataFrame, body: str = BODY, text: str = "value") -> DataFrame:
    """df with the text of its bodies; rows without one keep their own text."""
    return df.withColumn(text, F.coalesce(F.to_json(F.col(body)), F.col(text).cast("string")))


def _json_path(names: list[str]) -> str:
    return "$" + "".join(f"[{n}]" if n.isdigit() else f"['{n}']" if not n.isidentifier() else f".{n}" for n in names)


def variant_at(body: Column, path: str) -> Column:
    """The variant at a path of a body; SQL null where it is missing."""
    first, *rest = segments(path)
    return _variant_in(body[first], rest)


def _variant_in(value: Column, rest: list[str]) -> Column:
    at = next((i for i, s in enumerate(rest) if s == "#" or query_of(s)), None)
    if at is None:
        return F.try_variant_get(value, _json_path(rest), "variant") if rest else value
    array = (F.try_variant_get(value, _json_path(rest[:at]), "variant") if at else value).try_cast("array<variant>")
    tail, query = rest[at + 1 :], query_of(rest[at])
    if query is None:
        return F.size(array).cast("variant") if not tail else F.transform(array, lambda x: _variant_in(x, tail)).cast("variant")
    kept = F.filter(array, lambda x: _variant_fulfils(x, query))
    if not query.every:
        return _variant_in(F.get(kept, F.lit(0)), tail)
    if tail and tail[0] == "#" and len(tail) == 1:
        return F.size(kept).cast("variant")
    found = F.filter(F.transform(kept, lambda x: _variant_in(x, tail)), lambda x: x.isNotNull()) if tail else kept
    return found.cast("variant")


def _variant_fulfils(element: Column, query: Query) -> Column:
    value = _variant_in(element, segments(query.path)) if query.path else element
    if not query.sign:
        return value.isNotNull()

    def compared(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        plain = ~(kind.startswith("OBJECT") | kind.startswith("ARRAY"))
        text = F.when(kind == "STRING", v.try_cast("string"))
        number = F.when(plain & ~kind.isin("STRING", "BOOLEAN", "VOID"), v.try_cast("double"))
        return v.isNotNull() & _compares(query.sign, query.literal, text, number, F.when(kind == "BOOLEAN", v.try_cast("boolean")), F.coalesce(kind == "VOID", F.lit(False)))

    return F.coalesce(once(value, compared), F.lit(False))


def variant_exists(body: Column, path: str) -> Column:
    """Whether a body has a value, JSON null included, at a path."""
    found = segments(path)
    return F.coalesce(F.map_contains_key(body, F.lit(found[0])) if len(found) == 1 else variant_at(body, path).isNotNull(), F.lit(False))


def variant_text(value: Column, kind: Column | None = None) -> Column:
    """The text form of a variant: strings as they are, null as '', whole numbers without a fraction, objects and arrays as JSON."""
    kind = F.schema_of_variant(value) if kind is None else kind
    number = F.regexp_replace(value.try_cast("string"), r"^(-?\d+)\.0$", "$1")
    return F.when(kind == "VOID", "").when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.to_json(value)).when(kind == "STRING", value.try_cast("string")).otherwise(number)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), in which value is worked out once however often use mentions it (the optimizer would put its expression in every place)."""
    return F.transform(F.array(value), lambda x: use(x))[0]


def over(body: Column, more: Column) -> Column:
    """body with the entries of another map laid over it."""
    return once(more, lambda m: F.map_concat(F.map_filter(body, lambda k, _: ~F.map_contains_key(m, k)), m))


def _with_entry(body: Column, name: str, value: Column) -> Column:
    return F.map_concat(F.map_filter(body, lambda k, _: k != name), F.create_map(F.lit(name), value))


def last_wins(keys: Column, values: Column) -> Column:
    """A map of keys and values, in which the last of equal keys stays."""
    pairs = F.zip_with(keys, values, lambda k, v: F.struct(k.alias("k"), v.alias("v")))
    return once(pairs, lambda z: F.map_from_entries(F.filter(z, lambda e, i: ~F.exists(F.slice(z, i + 2, F.size(z)), lambda o: o["k"] == e["k"]))))


def put_variant(body: Column, names: list[str], value: Column) -> Column:
    """body with a value set at a path; objects on the way are made where missing, and a body in which something else is in the way stays as it is."""
    name, *rest = names
    if not rest:
        return _with_entry(body, name, value)
    child = body[name].try_cast("map<string,variant>")
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))
    inner = F.to_variant_object(put_variant(F.coalesce(child, empty), rest, value)).cast("variant")
    blocked = F.map_contains_key(body, F.lit(name)) & child.isNull()
    return F.when(blocked, body).otherwise(_with_entry(body, name, inner))


def drop_variant(body: Column, names: list[str]) -> Column:
    """body without the value at a path."""
    name, *rest = names
    if not rest:
        return F.map_filter(body, lambda k, _: k != name)
    child = body[name].try_cast("map<string,variant>")
    return F.when(child.isNull(), body).otherwise(_with_entry(body, name, F.to_variant_object(drop_variant(child, rest)).cast("variant")))


def _step(kind: T.DataType | None, name: str) -> T.DataType | None:
    """The type of what a segment leads to from a value of a type."""
    if isinstance(kind, T.StructType):
        return kind[name].dataType if name in kind.names else None
    if isinstance(kind, T.ArrayType):
        if name.isdigit():
            return kind.elementType
        query = query_of(name)
        if query:
            return kind if query.every else kind.elementType
        return T.IntegerType() if name == "#" else None
    return kind.valueType if isinstance(kind, T.MapType) else None


def typed_type(schema: T.StructType, path: str) -> T.DataType | None:
    """The type at a path of a schema, or None."""
    return _typed_in(F.lit(None), schema, segments(path))[1]


def _typed_in(value: Column | None, kind: T.DataType | None, names: list[str]) -> tuple[Column | None, T.DataType | None]:
    """(the value, the type) that names lead to from a value of a type; a type of None where they lead nowhere."""
    for i, name in enumerate(names):
        rest, query = names[i + 1 :], query_of(name) if isinstance(kind, T.ArrayType) else None
        if query or (name == "#" and rest and isinstance(kind, T.ArrayType)):
            element = kind.elementType
            kept = F.filter(value, _fulfils(element, query)) if query else value
            if query and not query.every:
                value, kind = F.get(kept, F.lit(0)), element
                continue
            if not rest or rest == ["#"]:
                return (F.size(kept), T.IntegerType()) if rest else (kept, kind)
            inner = _typed_in(F.lit(None), element, rest)[1]
            if inner is None:
                return None, None
            found = F.transform(kept, lambda x: _typed_in(x, element, rest)[0])  # noqa: B023
            return (F.filter(found, lambda x: x.isNotNull()) if query else found), T.ArrayType(inner)
        stepped = _step(kind, name)
        if stepped is None:
            return None, None
        is_array = isinstance(kind, T.ArrayType)
        value, kind = (F.size(value) if name == "#" and is_array else F.get(value, F.lit(int(name))) if is_array else value[name]), stepped
    return value, kind


def _fulfils(kind: T.DataType, query: Query) -> Callable[[Column], Column]:
    return lambda x: _typed_fulfils(x, kind, query)


def _typed_fulfils(element: Column, kind: T.DataType, query: Query) -> Column:
    value, own = _typed_in(element, kind, segments(query.path)) if query.path else (element, kind)
    if own is None:
        return F.lit(False)
    if not query.sign:
        return value.isNotNull()
    none = F.lit(None)
    text = value.cast("string") if isinstance(own, T.StringType) else none.cast("string")
    number = value.cast("double") if isinstance(own, T.NumericType) else none.cast("double")
    flag = value if isinstance(own, T.BooleanType) else none.cast("boolean")
    return (value.isNotNull() | F.lit(query.literal is None)) & _compares(query.sign, query.literal, text, number, flag, value.isNull())


def typed_at(path: str, schema: T.StructType | None = None) -> Column:
    """The value at a path; conditions need the schema."""
    first, *rest = segments(path)
    value = F.col(f"`{first}`")
    if schema is not None and first in schema.names:
        found = _typed_in(value, schema[first].dataType, rest)[0]
        return F.lit(None) if found is None else found
    for name in rest:
        value = F.size(value) if name == "#" else F.get(value, F.lit(int(name))) if name.isdigit() else value[name]
    return value


def put_typed(df: DataFrame, path: str, value: Column) -> DataFrame:
    first, *rest = segments(path)
    if not rest:
        return df.withColumn(first, value)
    return df.withColumn(first, F.col(f"`{first}`").withField(".".join(f"`{n}`" for n in rest), value))


def drop_typed(df: DataFrame, path: str) -> DataFrame:
    if typed_type(df.schema, path) is None:
        return df
    first, *rest = segments(path)
    return df.withColumn(first, F.col(f"`{first}`").dropFields(".".join(f"`{n}`" for n in rest))) if rest else df.drop(first)
