"""Rewriting bodies at any depth with built-in expressions: how deep they are is asked of the data, and the plan is made to fit.

The expression is unrolled level by level, and each level only handles what occurs there: objects, arrays or both. What the shape of the bodies cannot
tell (a place with objects in some rows and other kinds in others hides what is below it) is left to the caller.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import paths

OBJECT, ARRAY = "OBJECT", "ARRAY"
#: How many places an unrolled expression may have (a level with both kinds doubles what is below), and how many keys a table of names.
MOST_PLACES, MOST_KEYS = 64, 50


@dataclass
class Shape:
    """levels: which kinds of containers each level has. keys: all keys of all objects."""

    levels: list[set[str]]
    keys: set[str]


def shape_of(text: str) -> Shape | None:
    """What a variant's shape (as schema_of_variant gives it) tells; None if a place hides what is below it."""
    levels: list[set[str]] = []
    keys: set[str] = set()
    depth = 0
    for token in re.findall(r"`(?:[^`]|``)*`: |[^\s`<>,:]+: |OBJECT<|ARRAY<|VARIANT|>", text):
        if token.endswith(": "):
            keys.add(token[1:-3].replace("``", "`") if token.startswith("`") else token[:-2])
        elif token == "VARIANT":
            return None
        elif token == ">":
            depth -= 1
        else:
            if len(levels) == depth:
                levels.append(set())
            levels[depth].add(token[:-1])
            depth += 1
    return Shape(levels, keys)


def body_shape(df: DataFrame) -> Shape | None:
    """The shape of all bodies of df below their own keys, from one pass over it; None if it cannot be told, or an expression would be too large."""
    text = df.agg(F.schema_of_variant_agg(F.to_variant_object(paths.BODY))).first()[0]
    found = shape_of(text or "VOID")
    if found is None:
        return None
    places = 1
    for kinds in found.levels:
        places *= len(kinds)
    return Shape(found.levels[1:], found.keys) if places <= MOST_PLACES else None


@dataclass
class Renaming:
    """How keys are renamed, as an expression; alone: whether no two of the keys that there are get the same name."""

    rename: Callable[[Column], Column]
    alone: bool

    @classmethod
    def of(cls, keys: set[str], by_text: Callable[[str], str], by_column: Callable[[Column], Column]) -> Renaming:
        """For few keys a table of them; for many the expression, which works names out anew for each row."""
        new = {k: by_text(k) for k in sorted(keys)}
        table = F.create_map(*[x for pair in new.items() for x in map(F.lit, pair)]) if 0 < len(new) <= MOST_KEYS else None
        return cls(by_column if table is None else lambda k: table[k], len(set(new.values())) == len(new))


def rewrite(value: Column, levels: list[set[str]], names: Renaming | None = None, unwrap: bool = False) -> Column:
    """A variant whose objects' keys are renamed, or whose objects with an array under the only key `array` are replaced by that array, at all levels."""
    if not levels:
        return value
    here, below = levels[0], levels[1:]
    found = []
    if OBJECT in here:

        def object_of(m: Column) -> Column:
            whole = F.to_variant_object(entries(m, below, names, unwrap)).cast("variant")
            if not unwrap:
                return whole
            inner = m["array"]
            is_wrapper = (F.size(m) == 1) & inner.try_cast("array<variant>").isNotNull()
            return F.when(is_wrapper, rewrite(inner, below, names, unwrap)).otherwise(whole)

        found.append(paths.once(value.try_cast("map<string,variant>"), lambda m: F.when(m.isNotNull(), object_of(m))))
    if ARRAY in here:
        found.append(F.transform(value.try_cast("array<variant>"), lambda x: rewrite(x, below, names, unwrap)).cast("variant"))
    return F.coalesce(*found, value)


def entries(body: Column, levels: list[set[str]], names: Renaming | None = None, unwrap: bool = False) -> Column:
    """A map<string,variant> with its keys renamed (the last of equal ones stays) and its values rewritten."""
    values = F.transform(F.map_values(body), lambda x: rewrite(x, levels, names, unwrap)) if levels else F.map_values(body)
    keys = F.map_keys(body) if names is None else F.transform(F.map_keys(body), names.rename)
    return F.map_from_arrays(keys, values) if names is None or names.alone else paths.last_wins(keys, values)
