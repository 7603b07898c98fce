"""Pipelines as specifications: a source, transformations, sinks by route and an error sink, compiled to one plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import paths
from millrace.functions.coerce import misfits
from millrace.operators import sinks
from millrace.operators import transforms as t

KINDS = ("kafka", "postgresql", "trino")
_NEEDS = {"kafka": ("brokers", "topic"), "postgresql": ("connectionString", "table"), "trino": ("serverURL", "catalog", "schema", "table")}


def _need(spec: dict, where: str, kind: str, names: tuple[str, ...]) -> None:
    block = spec.get(kind)
    if not block:
        raise ValueError(f"{where}.{kind} is required for type {kind}")
    for name in names:
        if not block.get(name) and not (name == "table" and block.get("query")):
            raise ValueError(f"{where}.{kind}.{name} is required")


def check_end(spec: dict | None, where: str) -> None:
    """A source or sink: its type known and that type's settings there."""
    kind = (spec or {}).get("type")
    if not kind:
        raise ValueError(f"{where}.type is required")
    if kind not in KINDS:
        raise ValueError(f"{where}.type {kind!r} is not one of {KINDS}")
    _need(spec, where, kind, _NEEDS[kind])


def build_step(spec: dict, where: str = "transformation") -> t.Step:
    """The step that one transformation spec describes; raises where something is missing."""
    kind = spec.get("type")
    if not kind:
        raise ValueError(f"{where}.type is required")
    own = spec.get(kind)
    lists = {"mask": "fields", "select": "fields", "remove": "fields", "flatten": "field", "filter": "condition"}
    if kind in lists and not (own or {}).get(lists[kind]):
        raise ValueError(f"{where}.{kind}.{lists[kind]} is required")
    own = own or {}
    if kind == "timestamp":
        return t.timestamp(own.get("fieldName") or "created_at", own.get("format") or "RFC3339", own.get("now"))
    if kind == "flatten":
        return t.flatten(own["field"])
    if kind == "filter":
        return t.filter_rows(own["condition"])
    if kind == "mask":
        return t.mask(own["fields"], own.get("maskChar") or "*", bool(own.get("keepLength")))
    if kind == "router":
        for i, route in enumerate(own.get("routes", [])):
            if not route.get("condition"):
                raise ValueError(f"{where}.router.routes[{i}].condition is required")
            check_end(route.get("sink"), f"{where}.router.routes[{i}].sink")
        return t.router([r["condition"] for r in own.get("routes", [])])
    if kind == "select":
        return t.select(own["fields"], ("value", "meta", "ts", "route"))
    if kind == "remove":
        return t.remove(own["fields"])
    if kind == "snakeCase":
        return t.snake_case(bool(own.get("deep")))
    if kind == "camelCase":
        return t.camel_case(bool(own.get("deep")))
    if kind == "replaceField":
        return t.rename_fields(own.get("renames", []))
    if kind == "headerFrom":
        return t.header_from(own.get("mappings", []))
    if kind in t.CUSTOM:
        return t.CUSTOM[kind](**own)
    raise ValueError(f"{where}.type {kind!r} is unknown")


@dataclass
class Flow:
    steps: list[t.Step]
    routes: dict[str, dict]
    sink: dict
    errors: dict | None

    def plan(self, messages: DataFrame) -> DataFrame:
        """Messages (value, ...) parsed once, transformed, and rendered."""
        df = t.chain(self.steps)(paths.parse_body(messages))
        return paths.render_body(df if "route" in df.columns else df.withColumn("route", F.lit(None).cast("string")))

    def write_batch(
        self, planned: DataFrame, writers: dict[str, Callable[[DataFrame], Any]], default: Callable[[DataFrame], Any], errors: Callable[[DataFrame], None] | None = None,
        target: list[tuple[str, str]] | None = None, required: tuple[str, ...] = (), run: Callable[[str, Callable[[], Any]], Any] | None = None, threads: int = 4,
    ) -> tuple[int, int]:
        """One batch to its sinks; (rows written, rows in error).

        With an error sink, rows that are no JSON object go there, each in its envelope, and nowhere else; so do, given the target table's columns (name,
        type), rows with a value that doesn't fit or without a required column; and so do rows that a writer returns as a DataFrame (value, reason),
        such as those a database refuses. Without an error sink refused rows fail the batch."""
        run = run or (lambda _, write: write())
        checks = [(F.col(paths.BODY).isNotNull(), "not a JSON object"), *(misfits(planned, target, required) if target else [])] if errors is not None else []
        tagged = sinks.tag_bad(planned, checks, "__reason").persist()
        try:
            good, bad = tagged.where("__reason IS NULL").drop("__reason"), tagged.where("__reason IS NOT NULL").withColumnRenamed("__reason", "reason")
            if errors is not None:
                run("errors", lambda: errors(self._envelopes(bad)))
            returned = sinks.fan_out(good.drop(paths.BODY), writers, default, run=run, held=True, threads=threads)
            refused = {name: rows for name, rows in returned.items() if isinstance(rows, DataFrame)}
            for name, rows in refused.items():
                if errors is not None:
                    run(f"errors of {name}", lambda rows=rows: errors(self._envelopes(rows)))
                elif not rows.isEmpty():
                    raise RuntimeError(f"sink {name} refused rows: {rows.first()['reason']}")
            total, wrong = tagged.agg(F.count("*"), F.count("__reason")).first()
            late = sum(rows.count() for rows in refused.values())
            return total - wrong - late, wrong + late
        finally:
            tagged.unpersist()

    def _envelopes(self, bad: DataFrame) -> DataFrame:
        meta = F.col("meta") if "meta" in bad.columns else F.create_map().cast("map<string,string>")
        at = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
        return bad.select(sinks.error_envelope(F.col("value").cast("string"), F.col("reason"), at, self.sink["type"], meta).alias("value"))

    def policy(self, name: str) -> tuple[int, float, tuple[str, ...]]:
        """The retry policy of a sink by its name: a route's condition, `default`, or `errors` (of ...)."""
        end = self.errors if name.startswith("errors") else self.routes.get(name, self.sink)
        return sinks.POLICIES.get((end or {}).get("type", ""), sinks.POLICIES["default"])


def compile_flow(spec: dict) -> Flow:
    """A checked flow from a specification with source, sink, transformations and errors."""
    check_end(spec.get("source"), "source")
    check_end(spec.get("sink"), "sink")
    if spec.get("errors"):
        check_end(spec["errors"], "errors")
    described = spec.get("transformations") or []
    steps = [build_step(s, f"transformations[{i}]") for i, s in enumerate(described)]
    routes = {r["condition"]: r["sink"] for s in described if s["type"] == "router" for r in s.get("router", {}).get("routes", [])}
    return Flow(steps, routes, spec["sink"], spec.get("errors"))
