"""The engine's functions by name in SQL: each is an expression of built-in functions, so Catalyst sees through it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import drift, extract, fingerprint, ids

#: Operators that a column's text names in front of their arguments.
INFIX = {"-": "-", "+": "+", "*": "*", "/": "/", "%": "%", "=": "=", "<=>": "<=>", "!=": "<>", "<": "<", "<=": "<=", ">": ">", ">=": ">=", "and": "AND", "or": "OR"}
CALL = re.compile(r"(?<![\w'])(<=>|<=|>=|!=|[-+*/%=<>!]|\band|\bor|\bnot)\(")
SKIP = re.compile(r"'(?:[^'\\]|\\.)*'|`[^`]*`", re.S)


def _end(text: str, at: int) -> tuple[int, list[int]]:
    """Where the bracket that opens before at closes, and the commas between its arguments."""
    depth, commas = 1, []
    while depth:
        quoted = SKIP.match(text, at)
        if quoted:
            at = quoted.end()
            continue
        c = text[at]
        depth += (c in "([") - (c in ")]")
        if c == "," and depth == 1:
            commas.append(at)
        at += 1
    return at - 1, commas


def sql_text(column: Column) -> str:
    """A column's expression as SQL that Spark reads."""

    def infix(text: str) -> str:
        out, at = [], 0
        while at < len(text):
            quoted, call = SKIP.match(text, at), CALL.match(text, at)
            if quoted:
                out.append(quoted[0])
                at = quoted.end()
            elif call:
                end, commas = _end(text, call.end())
                cuts = [call.end() - 1, *commas, end]
                parts = [infix(text[a + 1 : b].strip()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                sign = call[1]
                out.append(f"(NOT {parts[0]})" if sign in ("!", "not") else f"({sign}{parts[0]})" if len(parts) == 1 else "(" + f" {INFIX[sign]} ".join(parts) + ")")
                at = end + 1
            elif text.startswith("Infinity", at):
                out.append("DOUBLE('Infinity')")
                at += len("Infinity")
            else:
                out.append(text[at])
                at += 1
        return "".join(out)

    return infix(column._jc.node().sql())


TEXT = (("x", "STRING"),)
#: Name to arguments, type and expression.
FUNCTIONS: dict[str, tuple[tuple[tuple[str, str], ...], str, Callable[..., Column]]] = {
    "log_fingerprint": (TEXT, "STRING", lambda x: fingerprint.fingerprint_id(x, xml=False)),
    "log_shape": (TEXT, "ARRAY<STRING>", fingerprint.shape_sequence),
    "log_shape_hash": (TEXT, "STRING", fingerprint.shape_hash),
    "log_token_class": (TEXT, "STRING", fingerprint.token_class),
    "log_content_hash": (TEXT, "STRING", ids.content_hash),
    "log_raw_id": ((("x", "STRING"), ("y", "INT"), ("z", "BIGINT")), "STRING", ids.raw_id),
    "log_event_id": ((("x", "STRING"), ("y", "INT")), "STRING", ids.event_id),
    "log_merkle_root": ((("x", "ARRAY<STRING>"),), "STRING", ids.merkle_root),
    "log_key_values": (TEXT, "ARRAY<STRUCT<key: STRING, value: STRING>>", extract.key_values),
    "log_flatten": (TEXT, "MAP<STRING, STRING>", extract.flatten_json),
    "log_value_class": (TEXT, "STRING", drift.classify_value),
    "log_null_rate_severity": ((("x", "DOUBLE"), ("y", "DOUBLE")), "STRING", drift.null_rate_severity),
    "log_match_rate_severity": ((("x", "DOUBLE"), ("y", "DOUBLE")), "STRING", drift.match_rate_severity),
    "log_shape_severity": ((("x", "DOUBLE"),), "STRING", drift.shape_severity),
    "log_tier1_severity": ((("x", "DOUBLE"),), "STRING", drift.tier1_severity),
    "log_volume_severity": ((("x", "BIGINT"), ("y", "BIGINT"), ("z", "BIGINT")), "STRING", drift.volume_severity),
    "log_decide_action": (TEXT, "STRING", drift.decide_action),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to spark.sql for this session; returns their names."""
    for name, (args, kind, build) in FUNCTIONS.items():
        body = sql_text(build(*[F.col(a) for a, _ in args]))
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({', '.join(f'{a} {t}' for a, t in args)}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
