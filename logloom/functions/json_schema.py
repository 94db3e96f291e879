"""JSON Schema as a column: a schema compiles to one expression over a VARIANT, so documents are checked where they lie.

Known are the keywords that event schemas use: type (one or several), const, enum, required,
properties, additionalProperties, minimum, maximum, minLength, maxLength, pattern and items. A
keyword that isn't known is an error when the schema is compiled, never passed over.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fingerprint import bound

NOTES = ("$schema", "$id", "$comment", "title", "description", "default", "examples")
TYPES = ("object", "array", "string", "number", "integer", "boolean", "null")
KNOWN = (*NOTES, "type", "const", "enum", "required", "properties", "additionalProperties", "minimum", "maximum", "minLength", "maxLength", "pattern", "items")


def kind_of(value: Column) -> Column:
    """The JSON type of a variant: object, array, string, integer, number, boolean or null; a number without a fraction is an integer."""

    def named(shape: Column) -> Column:
        whole = shape.isin("BIGINT", "INT", "SMALLINT", "TINYINT") | bound(F.try_variant_get(value, "$", "double"), lambda x: x == F.floor(x))
        return (
            F.when(shape.isNull() | (shape == "VOID"), "null").when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "array").when(shape == "BOOLEAN", "boolean")
            .when(shape.startswith("DECIMAL") | shape.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT"), F.when(whole, "integer").otherwise("number")).otherwise("string")
        )

    return bound(F.schema_of_variant(value), named)


def same_as(value: Column, kind: Column, expected: Any) -> Column:
    """Whether a variant is a constant: numbers by value, other scalars by type and value; lists and objects by their text with sorted keys."""
    if expected is None:
        return kind == "null"
    if isinstance(expected, bool):
        return (kind == "boolean") & F.coalesce(F.try_variant_get(value, "$", "boolean") == F.lit(expected), F.lit(False))
    if isinstance(expected, int | float):
        return kind.isin("integer", "number") & F.coalesce(F.try_variant_get(value, "$", "double") == F.lit(float(expected)), F.lit(False))
    if isinstance(expected, str):
        return (kind == "string") & F.coalesce(F.try_variant_get(value, "$", "string") == F.lit(expected), F.lit(False))
    return F.coalesce(F.to_json(value) == F.lit(json.dumps(expected, separators=(",", ":"), sort_keys=True, ensure_ascii=False)), F.lit(False))


def checks(schema: dict | bool, value: Column, path: Column) -> Column:
    """array<string>: what is wrong with a value and what is in it, each with the path of what is meant."""
    said = lambda wrong, *what: F.when(wrong, F.array(F.concat(path, *[F.lit(x) if isinstance(x, str) else x for x in what]))).otherwise(F.array().cast("array<string>"))
    if isinstance(schema, bool):
        return said(F.lit(not schema), " is not allowed")
    if unknown := [k for k in schema if k not in KNOWN]:
        raise ValueError(f"schema keywords not known: {', '.join(unknown)}")

    def of_kind(kind: Column) -> Column:
        out = []
        if "type" in schema:
            wanted = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
            if wrong := [t for t in wanted if t not in TYPES]:
                raise ValueError(f"schema types not known: {', '.join(wrong)}")
            out.append(said(~kind.isin(*wanted, *(["integer"] if "number" in wanted else [])), f" is not of type {' or '.join(wanted)}"))
        if "const" in schema:
            out.append(said(~same_as(value, kind, schema["const"]), f" is not {json.dumps(schema['const'])}"))
        if "enum" in schema:
            hit = F.lit(False)
            for x in schema["enum"]:
                hit = hit | same_as(value, kind, x)
            out.append(said(~hit, f" is none of {json.dumps(schema['enum'])}"))
        number, numeric = F.try_variant_get(value, "$", "double"), kind.isin("integer", "number")
        if "minimum" in schema:
            out.append(said(F.coalesce(numeric & (number < schema["minimum"]), F.lit(False)), f" is less than {schema['minimum']}"))
        if "maximum" in schema:
            out.append(said(F.coalesce(numeric & (number > schema["maximum"]), F.lit(False)), f" is greater than {schema['maximum']}"))
        text = F.try_variant_get(value, "$", "string")
        for word, wrong, what in (("minLength", lambda n: F.length(text) < n, "shorter"), ("maxLength", lambda n: F.length(text) > n, "longer")):
            if word in schema:
                out.append(said(F.coalesce((kind == "string") & wrong(schema[word]), F.lit(False)), f" is {what} than {schema[word]}"))
        if "pattern" in schema:
            out.append(said(F.coalesce((kind == "string") & ~text.rlike(schema["pattern"]), F.lit(False)), f" does not match {schema['pattern']}"))
        none = F.array().cast("array<string>")
        if any(k in schema for k in ("required", "properties", "additionalProperties")):
            members = F.try_variant_get(value, "$", "map<string,variant>")
            out.append(F.when(kind == "object", bound(members, lambda m: within(m))).otherwise(none))
        if "items" in schema:
            inside = lambda xs: F.flatten(F.transform(xs, lambda x, i: checks(schema["items"], x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
            out.append(F.when(kind == "array", bound(F.try_variant_get(value, "$", "array<variant>"), inside)).otherwise(none))
        return F.flatten(F.array(*out)) if out else none

    def within(members: Column) -> Column:
        at = lambda name: F.concat(path, F.lit("."), name)
        has, known = lambda k: F.map_contains_key(members, F.lit(k)), schema.get("properties", {})
        out = [said(~has(k), f".{k} is missing") for k in schema.get("required", [])]
        member = lambda k, sub: bound(F.element_at(members, k), lambda x: checks(sub, x, at(F.lit(k))))
        out += [F.when(has(k), member(k, sub)).otherwise(F.array().cast("array<string>")) for k, sub in known.items()]
        more = schema.get("additionalProperties", True)
        if more is not True:
            others = F.filter(F.map_entries(members), lambda e: ~e["key"].isin(*known)) if known else F.map_entries(members)
            out.append(F.flatten(F.transform(others, lambda e: checks(more, e["value"], at(e["key"])))))
        return F.flatten(F.array(*out)) if out else F.array().cast("array<string>")

    return bound(kind_of(value), of_kind)


def compile_schema(schema: dict) -> Callable[[Column], Column]:
    """A function from a VARIANT to an array of what is wrong with it by the schema, empty if nothing is. A null variant (a text that is no JSON) is wrong."""
    checks(schema, F.lit(None).cast("variant"), F.lit("$"))  # what isn't known is found now
    return lambda value: F.when(value.isNull(), F.array(F.lit("$ is no JSON"))).otherwise(checks(schema, value, F.lit("$")))
