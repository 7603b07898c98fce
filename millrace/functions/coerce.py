"""Values brought to the types of a target table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import paths

INTEGERS, REALS = ("bigint", "integer", "int", "smallint", "tinyint"), ("double", "real", "float", "decimal", "numeric")
BOOLEANS, TEXTS = ("boolean", "bool"), ("varchar", "char", "text", "string")


def base_type(name: str) -> str:
    return name.lower().split("(")[0].strip()


def spark_type(target: str) -> str:
    """Spark's name of a target type."""
    name = base_type(target)
    if name.startswith("timestamp"):
        return "timestamp"
    if name in TEXTS or name in ("json", "jsonb", "uuid"):
        return "string"
    known = {"integer": "int", "real": "float", "double precision": "double", "bool": "boolean"}
    return known.get(name) or target.lower().replace("numeric", "decimal")


def _parts(value: Column, kind: T.DataType, what: Column | None = None) -> tuple[Column, Column, Column]:
    """A value as number, text and boolean; null where it is none of them. what: a variant's kind, if it is known already."""
    if isinstance(kind, T.VariantType):
        what = F.schema_of_variant(value) if what is None else what
        text = F.when(what == "VOID", F.lit(None).cast("string")).otherwise(paths.variant_text(value, what))
        number = F.when(~what.isin("STRING", "BOOLEAN", "VOID") & ~what.startswith("OBJECT") & ~what.startswith("ARRAY"), value.try_cast("double"))
        return number, text, F.when(what == "BOOLEAN", value.try_cast("boolean"))
    none = F.lit(None)
    number = value.cast("double") if isinstance(kind, T.NumericType) else none.cast("double")
    text = F.to_json(value) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else value.cast("string")
    return number, text, value if isinstance(kind, T.BooleanType) else none.cast("boolean")


def coerce(value: Column, kind: T.DataType, target: str, what: Column | None = None) -> Column:
    """value, of type kind, as a target type. Null stays null; what is of another kind becomes 0, false or null as the target has it, and a number
    outside the target's range becomes null (misfits() tells of it)."""
    name = base_type(target)
    number, text, flag = _parts(value, kind, what)
    there = text.isNotNull()
    if name in INTEGERS:
        if isinstance(kind, T.IntegralType):
            return value.try_cast(spark_type(target))
        # through a decimal, as a double has no place for all digits of large ids
        decimal = F.bround(value.try_cast("decimal(38,18)") if isinstance(kind, (T.VariantType, T.DecimalType)) else F.lit(None).cast("decimal(38,18)"), 0)
        exact = F.coalesce(decimal.try_cast(spark_type(target)), F.when(decimal.isNull(), F.bround(number, 0)).try_cast(spark_type(target)))
        general = F.when(there, F.when(number.isNotNull(), exact).otherwise(F.lit(0).cast(spark_type(target))))
        # most numbers are whole already, which needs no more than one cast
        return F.when((F.schema_of_variant(value) if what is None else what) == "BIGINT", value.try_cast(spark_type(target))).otherwise(general) if isinstance(kind, T.VariantType) else general
    if name in REALS:
        exact = F.coalesce(value.try_cast(spark_type(target)), number.try_cast(spark_type(target))) if isinstance(kind, (T.VariantType, T.DecimalType)) else number.try_cast(spark_type(target))
        return F.when(there, F.when(number.isNotNull(), exact).otherwise(F.lit(0).cast(spark_type(target))))
    if name in BOOLEANS:
        return F.when(there, F.coalesce(flag, F.lit(False)))
    if name.startswith("timestamp"):
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return value.cast("timestamp")
        seconds = F.floor(F.when(F.abs(number) > 1e10, number / 1000).otherwise(number))
        return F.coalesce(F.timestamp_seconds(seconds), text.try_cast("timestamp"))
    if name == "date":
        return text.try_cast("date")
    return text


def align(df: DataFrame, target: list[tuple[str, str]]) -> DataFrame:
    """All columns of a target (name, type), in its order: missing ones null, extra ones left out, values brought to their types."""
    if paths.is_dynamic(df):
        # each value and its kind are taken out once, then mentioned as often as a coercion needs them
        taken = [F.col(paths.BODY)[n].alias(f"__v{i}") for i, (n, _) in enumerate(target)]
        staged = df.select(*taken).select("*", *[F.schema_of_variant(f"__v{i}").alias(f"__k{i}") for i in range(len(target))])
        return staged.select(*[coerce(F.col(f"__v{i}"), T.VariantType(), t, F.col(f"__k{i}")).alias(n) for i, (n, t) in enumerate(target)])
    return df.select(*[coerce(F.col(f"`{n}`"), df.schema[n].dataType, t).alias(n) if n in df.columns else F.lit(None).cast(spark_type(t)).alias(n) for n, t in target])


def misfits(df: DataFrame, target: list[tuple[str, str]], required: tuple[str, ...] = ()) -> list[tuple[Column, str]]:
    """Checks for split_bad on rows of df before they are aligned: numbers within range, times and dates that can be read, and required columns there."""
    dynamic, checks = paths.is_dynamic(df), []

    def check(value: Column, own: T.DataType, use: Callable[[Column, Column | None], Column]) -> Column:
        # a variant and its kind are taken out once, as checks mention both many times
        return paths.once(value, lambda v: paths.once(F.schema_of_variant(v), lambda what: use(v, what))) if dynamic else use(value, None)

    for name, kind in target:
        if not dynamic and name not in df.columns:
            value, own = None, None
        else:
            value, own = (paths.variant_at(F.col(paths.BODY), name), T.VariantType()) if dynamic else (F.col(f"`{name}`"), df.schema[name].dataType)
        if name in required:
            there = F.lit(False) if value is None else (check(value, own, lambda v, what: _parts(v, own, what)[1].isNotNull()) if dynamic else value.isNotNull())  # noqa: B023
            checks.append((there, f"{name} is missing"))
        if value is not None and base_type(kind) in INTEGERS + REALS:
            checks.append((check(value, own, lambda v, what: _parts(v, own, what)[0].isNull() | coerce(v, own, kind, what).isNotNull()), f"{name} is out of range for {kind}"))  # noqa: B023
        if value is not None and (base_type(kind).startswith("timestamp") or base_type(kind) == "date"):
            checks.append((check(value, own, lambda v, what: _parts(v, own, what)[1].isNull() | coerce(v, own, kind, what).isNotNull()), f"{name} is out of form for {kind}"))  # noqa: B023
    return checks
