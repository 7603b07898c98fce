"""Row transformations. Each takes its settings and returns a function from DataFrame to DataFrame; both lanes are handled."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import deep as deep_bodies
from millrace.functions import names, paths, predicates

Step = Callable[[DataFrame], DataFrame]
BODY = paths.BODY


def timestamp(field: str = "created_at", layout: str = "RFC3339", now: Column | None = None) -> Step:
    """Set a field to the time, as text in a reference-time layout. Rows without a body stay as they are."""

    def step(df: DataFrame) -> DataFrame:
        text = F.date_format(F.current_timestamp() if now is None else now, names.time_pattern(layout))
        if paths.is_dynamic(df):
            return df.withColumn(BODY, paths.once(F.col(BODY), lambda b: paths.put_variant(b, paths.segments(field), text.cast("variant"))))
        return paths.put_typed(df, field, text)

    return step


def filter_rows(condition: str) -> Step:
    """Keep the rows that fulfil a condition."""
    return lambda df: df.filter(predicates.condition(df, condition))


def mask(fields: list[str], mask_char: str = "*", keep_length: bool = False) -> Step:
    """Replace existing fields by a mask: as many times mask_char as the field's text has bytes, or three times."""

    def masked(text: Column) -> Column:
        return F.repeat(F.lit(mask_char), F.octet_length(text)) if keep_length else F.lit(mask_char * 3)

    def one(df: DataFrame, field: str) -> DataFrame:
        if paths.is_dynamic(df):

            def put(body: Column) -> Column:
                value = paths.once(paths.variant_at(body, field), lambda v: masked(paths.variant_text(v))) if keep_length else masked(F.lit(""))
                return F.when(paths.variant_exists(body, field), paths.put_variant(body, paths.segments(field), value.cast("variant"))).otherwise(body)

            return df.withColumn(BODY, paths.once(F.col(BODY), put))
        kind = paths.typed_type(df.schema, field)
        if kind is None:
            return df
        value = paths.typed_at(field, df.schema)
        text = F.to_json(value) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else value.cast("string")
        return paths.put_typed(df, field, F.when(value.isNotNull(), masked(text)))

    return lambda df: reduce(one, fields, df)


def router(conditions: list[str], column: str = "route") -> Step:
    """Tag each row with the text of the first condition it fulfils; others keep the tag they have."""

    def step(df: DataFrame) -> DataFrame:
        had = F.col(column) if column in df.columns else F.lit(None).cast("string")
        tag = reduce(lambda w, c: (F if w is None else w).when(predicates.condition(df, c), F.lit(c)), conditions, None)
        return df.withColumn(column, had if tag is None else tag.otherwise(had))

    return step


def select(fields: list[str], keep: tuple[str, ...] = ()) -> Step:
    """Keep only some fields, each under the last name of its path (of two alike the later wins). With none present the row stays as it is.

    keep: typed columns that are no fields, such as metadata."""

    def step(df: DataFrame) -> DataFrame:
        if paths.is_dynamic(df):
            named: dict[str, list[str]] = {}
            for f in fields:
                named.setdefault(paths.last_segment(f), []).insert(0, f)

            def entry(body: Column, name: str) -> Column:
                value, there = None, F.lit(False)
                for f in named[name]:  # the latest first
                    here = paths.variant_exists(body, f)
                    value = (F if value is None else value).when(here, paths.variant_at(body, f))
                    there = there | here
                return F.struct(F.lit(name).alias("k"), value.alias("v"), there.alias("there"))

            def kept(body: Column) -> Column:
                found = F.filter(F.array(*[entry(body, n) for n in named]), lambda e: e["there"])
                chosen = paths.once(found, lambda z: F.when(F.size(z) > 0, F.map_from_entries(F.transform(z, lambda e: F.struct(e["k"].alias("k"), e["v"].alias("v"))))))
                return F.when(body.isNotNull(), F.coalesce(chosen, body))

            return df.withColumn(BODY, paths.once(F.col(BODY), kept))
        found = {paths.last_segment(f): paths.typed_at(f, df.schema) for f in fields if paths.typed_type(df.schema, f) is not None}
        return df.select(*[c for c in keep if c not in found], *[v.alias(k) for k, v in found.items()]) if found else df

    return step


def remove(fields: list[str]) -> Step:
    """Delete fields; missing ones are skipped."""

    def step(df: DataFrame) -> DataFrame:
        if paths.is_dynamic(df):
            return df.withColumn(BODY, reduce(lambda b, f: paths.once(b, lambda x: paths.drop_variant(x, paths.segments(f))), fields, F.col(BODY)))
        return reduce(paths.drop_typed, fields, df)

    return step


def flatten(field: str) -> Step:
    """One row for each element of an array, in order. An object's keys are laid over the row's own, other elements stand under the field's last name. An
    empty array leaves one row without the field; a row whose field is missing or no array stays as it is. ``{"array": [...]}`` counts as the array."""
    last = paths.last_segment(field)

    def dynamic(df: DataFrame) -> DataFrame:
        body, value = F.col(BODY), paths.variant_at(F.col(BODY), field)
        wrapped = value.try_cast("map<string,variant>")
        items = F.coalesce(value.try_cast("array<variant>"), F.when(F.size(wrapped) == 1, wrapped["array"].try_cast("array<variant>")))
        rest = paths.drop_variant(body, paths.segments(field))
        element = lambda x: F.when(x.try_cast("map<string,variant>").isNotNull(), paths.over(F.col("__rest"), x.try_cast("map<string,variant>"))).otherwise(paths.over(F.col("__rest"), F.create_map(F.lit(last), x)))
        staged = df.withColumn("__items", items).withColumn("__rest", rest)
        bodies = F.when(F.col("__items").isNull(), F.array(body)).when(F.size("__items") == 0, F.array(F.col("__rest"))).otherwise(F.transform("__items", element))
        return staged.withColumn(BODY, F.explode_outer(bodies)).drop("__items", "__rest")

    def typed(df: DataFrame) -> DataFrame:
        kind = paths.typed_type(df.schema, field)
        value = paths.typed_at(field, df.schema)
        if isinstance(kind, T.StructType) and kind.names == ["array"]:
            kind, value = kind["array"].dataType, value["array"]
        if not isinstance(kind, T.ArrayType):
            return df
        rest = paths.drop_typed(df.withColumn("__items", value), field)
        rows = rest.withColumn("__item", F.explode_outer("__items")).drop("__items")
        if not isinstance(kind.elementType, T.StructType):
            return rows.withColumnRenamed("__item", last)
        inner = kind.elementType.names
        own = [c for c in rows.columns if c != "__item"]
        # an element's key wins where there is an element
        both = [F.when(F.col("__item").isNotNull(), F.col("__item")[c]).otherwise(F.col(f"`{c}`")).alias(c) if c in inner else F.col(f"`{c}`") for c in own]
        return rows.select(*both, *[F.col("__item")[c].alias(c) for c in inner if c not in own])

    return lambda df: dynamic(df) if paths.is_dynamic(df) else typed(df)


def _rename_keys(column_rename, text_rename, deep: bool) -> Step:
    @F.pandas_udf("string")
    def deeply(texts: pd.Series) -> pd.Series:
        def walk(x):
            if isinstance(x, dict):
                return {text_rename(k): walk(v) for k, v in x.items()}
            return [walk(v) for v in x] if isinstance(x, list) else x

        return texts.map(lambda t: None if t is None else json.dumps(walk(json.loads(t, parse_float=names.ExactNumber)), ensure_ascii=False))

    def step(df: DataFrame) -> DataFrame:
        if paths.is_dynamic(df):
            body = F.col(BODY)
            shape = deep_bodies.body_shape(df) if deep and not df.isStreaming else None
            if shape is not None:
                renaming = deep_bodies.Renaming.of(shape.keys, text_rename, column_rename)
                return df.withColumn(BODY, paths.once(body, lambda b: F.when(b.isNotNull(), deep_bodies.entries(b, shape.levels, renaming))))
            if deep:  # a stream, or bodies whose depth their shape does not tell: batches of JSON text
                return df.withColumn(BODY, F.from_json(deeply(F.to_json(body)), "map<string,variant>"))
            return df.withColumn(BODY, paths.once(body, lambda b: paths.last_wins(F.transform(F.map_keys(b), column_rename), F.map_values(b))))
        kind = names.renamed(df.schema, text_rename, deep)
        return df.select(*[F.col(f"`{f.name}`").cast(g.dataType).alias(g.name) if f.dataType != g.dataType else F.col(f"`{f.name}`").alias(g.name) for f, g in zip(df.schema.fields, kind.fields, strict=True)])

    return step


def snake_case(deep: bool = False) -> Step:
    """Rename keys to snake case; nested ones too if deep."""
    return _rename_keys(names.snake, names.snake_text, deep)


def camel_case(deep: bool = False) -> Step:
    """Rename keys to Pascal case; nested ones too if deep."""
    return _rename_keys(names.pascal, names.pascal_text, deep)


def _pairs(rules: list[str], what: str) -> list[tuple[str, str]]:
    split = [tuple(r.split(":")) for r in rules]
    if any(len(p) != 2 or not p[0] or not p[1] for p in split):
        raise ValueError(f"invalid {what} format: {rules}")
    return split


def rename_fields(rules: list[str]) -> Step:
    """``old:new`` moves a field, both possibly nested; a missing one is skipped."""
    pairs = _pairs(rules, "rename")

    def one(df: DataFrame, pair: tuple[str, str]) -> DataFrame:
        old, new = pair
        if paths.segments(old) == paths.segments(new):
            return df
        if paths.is_dynamic(df):
            body = F.col(BODY)
            moved = paths.put_variant(paths.drop_variant(body, paths.segments(old)), paths.segments(new), paths.variant_at(body, old))
            return df.withColumn(BODY, F.when(paths.variant_exists(body, old), moved).otherwise(body))
        if paths.typed_type(df.schema, old) is None:
            return df
        if len(paths.segments(old)) == len(paths.segments(new)) == 1:
            return df.withColumnRenamed(old, new)
        held = paths.drop_typed(df.withColumn("__moved", paths.typed_at(old, df.schema)), old)
        first, *rest = paths.segments(new)
        if rest and first not in held.columns:
            value = reduce(lambda v, n: F.struct(v.alias(n)), reversed(rest), F.col("__moved"))
            return held.withColumn(first, value).drop("__moved")
        return paths.put_typed(held, new, F.col("__moved")).drop("__moved")

    return lambda df: reduce(one, pairs, df)


def header_from(rules: list[str], headers: str = "headers") -> Step:
    """``Header:path`` copies a header (array of key and value) into the row; rows without it stay as they are."""
    pairs = _pairs(rules, "header mapping")

    def one(df: DataFrame, pair: tuple[str, str]) -> DataFrame:
        if headers not in df.columns or not isinstance(df.schema[headers].dataType, T.ArrayType):
            return df
        header, path = pair
        value = F.try_element_at(F.filter(headers, lambda h: h["key"] == header), F.lit(-1))["value"].cast("string")
        if paths.is_dynamic(df):
            body = F.col(BODY)
            return df.withColumn(BODY, F.when(value.isNotNull(), paths.put_variant(body, paths.segments(path), value.cast("variant"))).otherwise(body))
        first, *rest = paths.segments(path)
        if rest and first not in df.columns:
            return df.withColumn(first, F.when(value.isNotNull(), reduce(lambda v, n: F.struct(v.alias(n)), reversed(rest), value)))
        had = paths.typed_at(path, df.schema).cast("string") if paths.typed_type(df.schema, path) is not None else F.lit(None).cast("string")
        return paths.put_typed(df, path, F.coalesce(value, had))

    return lambda df: reduce(one, pairs, df)


CUSTOM: dict[str, Callable[..., Step]] = {}


def register(name: str, build: Callable[..., Step]) -> None:
    """Make a user's own transformation known by name."""
    CUSTOM[name] = build


def chain(steps: list[Step]) -> Step:
    """All steps in order, as one plan."""
    return lambda df: reduce(lambda d, s: d.transform(s), steps, df)
