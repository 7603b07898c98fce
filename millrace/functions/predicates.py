"""Conditions on rows: ``path`` (is it truthy?) and ``path == 'literal'`` (is its text this?)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import paths


def truthy_variant(value: Column) -> Column:
    """Booleans as they are; text unless '' or 'false'; numbers unless 0; null no; objects and arrays, empty ones too, yes; missing no."""
    kind = F.schema_of_variant(value)
    found = (
        F.when(value.isNull(), False)
        .when(kind == "BOOLEAN", value.try_cast("boolean"))
        .when(kind == "STRING", ~value.try_cast("string").isin("", "false"))
        .when(kind == "VOID", False)
        .when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), True)
        .otherwise(F.coalesce(value.try_cast("double") != 0, F.lit(True)))
    )
    return F.coalesce(found, F.lit(False))


def truthy_typed(value: Column, kind: T.DataType | None) -> Column:
    if kind is None or isinstance(kind, T.NullType):
        return F.lit(False)
    if isinstance(kind, T.VariantType):
        return truthy_variant(value)
    if isinstance(kind, T.BooleanType):
        found = value
    elif isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        found = ~value.isin("", "false")
    elif isinstance(kind, T.NumericType):
        found = value != 0
    else:
        found = value.isNotNull()
    return F.coalesce(found, F.lit(False))


def split_equality(condition: str) -> tuple[str, str] | None:
    """(path, literal) of an equality, else None. A literal that isn't quoted is ''; a backslash keeps the quote after it and stays itself."""
    depth, at = 0, -1
    for i, c in enumerate(condition):  # a sign within parentheses belongs to the path
        depth += {"(": 1, ")": -1}.get(c, 0)
        if depth == 0 and condition.startswith("==", i):
            at = i
            break
    if at < 0:
        return None
    left, right = condition[:at], condition[at + 2 :]
    found = re.match(r"""\s*(?:'((?:\\.|[^'\\])*)'|"((?:\\.|[^"\\])*)")""", right, re.S)
    return left.strip(), next((g for g in found.groups() if g is not None), "") if found else ""


def condition(df: DataFrame, text: str) -> Column:
    """A condition on the rows of df, in its lane; never null."""
    equality = split_equality(text.strip())
    path = equality[0] if equality else text.strip()
    if paths.is_dynamic(df):
        if not equality:
            return paths.once(paths.variant_at(F.col(paths.BODY), path), truthy_variant)

        def equal(body: Column) -> Column:
            return paths.variant_exists(body, path) & F.coalesce(paths.once(paths.variant_at(body, path), paths.variant_text) == equality[1], F.lit(False))

        return paths.once(F.col(paths.BODY), equal)
    kind = paths.typed_type(df.schema, path)
    if kind is None:
        return F.lit(False)
    value = paths.typed_at(path, df.schema)
    if not equality:
        return truthy_typed(value, kind)
    text = F.to_json(value) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else value.cast("string")
    if isinstance(kind, T.FractionalType):  # whole numbers without a fraction, as in bodies
        text = F.regexp_replace(text, r"^(-?\d+)\.0+$", "$1")
    return F.coalesce(text == equality[1], F.lit(False))


def valid_json(text: Column) -> Column:
    """Whether a text is a JSON value of any kind."""
    # before a number that the text lacks, in an array, since the parser does not look at what follows a value: the array must end with that number
    whole = text.cast("string")
    sign = F.when(F.contains(whole, F.lit(_SIGN)), F.concat(F.lit(_SIGN), F.crc32(whole.cast("binary")).cast("string"), F.length(whole).cast("string"))).otherwise(_SIGN)

    def alone(x: Column) -> Column:
        parsed = F.try_parse_json(F.concat(F.lit("["), x["text"], F.lit("\n,"), x["sign"], F.lit("]"))).try_cast("array<variant>")
        return F.coalesce((F.size(parsed) == 2) & (parsed[1].try_cast("string") == x["sign"]), F.lit(False)) & ~F.coalesce(x["text"].rlike(r"^\s*[\],]"), F.lit(False))

    return paths.once(F.struct(whole.alias("text"), sign.alias("sign")), alone)


#: A number that texts are unlikely to contain; where one does, more digits follow that depend on the text.
_SIGN = "7310592648"
