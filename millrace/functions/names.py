"""Key names in snake case and in Pascal case, as columns and for schemas."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BREAKS = r"(?<=[\p{Ll}\p{Nd}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"


def snake(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, _BREAKS, "_"))


def pascal(name: Column) -> Column:
    parts = F.filter(F.split(name, "_"), lambda x: x != "")
    joined = F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2)))), "")
    return F.when(F.size(parts) == 0, name).otherwise(joined)


def snake_text(name: str) -> str:
    out = ""
    for i, c in enumerate(name):
        before, after = name[i - 1 : i], name[i + 1 : i + 2]
        if c.isupper() and before and (before.islower() or before.isdigit() or before.isupper() and after.islower()):
            out += "_"
        out += c.lower()
    return out


def pascal_text(name: str) -> str:
    return "".join(p[0].upper() + p[1:] for p in name.split("_") if p) or name


def renamed(kind: T.DataType, rename, deep: bool) -> T.DataType:
    """A type with the names of its structs changed; raises where two names become one."""
    if isinstance(kind, T.StructType):
        names = [rename(f.name) for f in kind.fields]
        if len(set(names)) < len(names):
            raise ValueError(f"names collide: {sorted(names)}")
        return T.StructType([T.StructField(n, renamed(f.dataType, rename, deep) if deep else f.dataType, f.nullable) for n, f in zip(names, kind.fields, strict=True)])
    if isinstance(kind, T.ArrayType) and deep:
        return T.ArrayType(renamed(kind.elementType, rename, deep), kind.containsNull)
    if isinstance(kind, T.MapType) and deep:
        return T.MapType(kind.keyType, renamed(kind.valueType, rename, deep), kind.valueContainsNull)
    return kind


#: Parts of a reference-time layout, longest first, and the pattern letters that mean the same.
LAYOUT = (
    ("January", "MMMM"), ("Monday", "EEEE"), ("-07:00", "xxx"), ("Z07:00", "XXX"), (".000000000", ".SSSSSSSSS"), (".000000", ".SSSSSS"), (".000", ".SSS"), ("-0700", "xx"),
    ("2006", "yyyy"), ("Jan", "MMM"), ("Mon", "EEE"), ("MST", "z"), ("01", "MM"), ("02", "dd"), ("03", "hh"), ("04", "mm"), ("05", "ss"), ("06", "yy"), ("15", "HH"), ("PM", "a"), ("1", "M"), ("2", "d"), ("3", "h"),
)
RFC3339 = "2006-01-02T15:04:05Z07:00"


def time_pattern(layout: str) -> str:
    """The date pattern for a layout written as the reference time; other letters are quoted."""
    named = {"RFC3339": RFC3339, "RFC3339Nano": "2006-01-02T15:04:05.000000Z07:00"}
    layout, out, i, quoted = named.get(layout, layout), "", 0, ""
    while i < len(layout):
        found = next(((part, pattern) for part, pattern in LAYOUT if layout.startswith(part, i)), None)
        if not found and layout[i].isalpha():
            quoted, i = quoted + layout[i], i + 1
            continue
        if quoted:
            out, quoted = f"{out}'{quoted}'", ""
        out, i = (out + found[1], i + len(found[0])) if found else (out + ("''" if layout[i] == "'" else layout[i]), i + 1)
    return f"{out}'{quoted}'" if quoted else out


class ExactNumber(float):
    """A number of a JSON text that is written out as it was read."""

    def __new__(cls, text):
        made = super().__new__(cls, text)
        made.text = text
        return made

    def __repr__(self):
        return self.text
