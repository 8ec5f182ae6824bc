"""Strict checks of JSON outputs against a nested schema, with the path of each fault, and signatures of repeated outputs.

A schema is text: an object of fields, a list of one schema, a type ("string", "text" for one that is not blank, "integer", "number", "boolean"), or a list of allowed values
under "allowed". A field whose name ends with "?" may be missing or null; fields that the schema does not name are faults.

    {"action": {"allowed": ["READ", "STOP"]}, "target?": "text", "steps": [{"n": "integer"}]}

Defined results: null and unreadable texts have the fault not_json at $; a repeated key counts by its last value; true and false are no numbers, 1.0 is no integer; repeated rows are
checked each; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TYPES = {
    "string": lambda v: isinstance(v, str), "text": lambda v: isinstance(v, str), "boolean": lambda v: isinstance(v, bool),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool), "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
}


def faults(value: object, schema: object, path: str = "$") -> list[tuple[str, str]]:
    """(path, fault) of all that is wrong with a value."""
    if isinstance(schema, str):
        if not _TYPES[schema](value):
            return [(path, "wrong_type")]
        return [(path, "blank")] if schema == "text" and not value.strip() else []
    if isinstance(schema, list):
        if not isinstance(value, list):
            return [(path, "wrong_type")]
        return [f for i, v in enumerate(value) for f in faults(v, schema[0], f"{path}[{i}]")]
    if set(schema) == {"allowed"}:
        return [] if any(value == a and type(value) is type(a) for a in schema["allowed"]) else [(path, "not_allowed")]
    if not isinstance(value, dict):
        return [(path, "wrong_type")]
    out = []
    for name, own in schema.items():
        key = name.removesuffix("?")
        if key not in value or (value[key] is None and name.endswith("?")):
            out += [] if name.endswith("?") else [(f"{path}.{key}", "missing")]
        else:
            out += faults(value[key], own, f"{path}.{key}")
    known = {name.removesuffix("?") for name in schema}
    return out + [(f"{path}.{key}", "unknown_field") for key in sorted(value) if key not in known]


def _read(text: str | None) -> tuple[object, bool]:
    try:
        return json.loads(text or "", parse_constant=lambda c: (_ for _ in ()).throw(ValueError(c))), True
    except (ValueError, RecursionError):
        return None, False


def check(outputs: DataFrame, schema: object, text: str = "output") -> DataFrame:
    """outputs(case_id, output) -> (case_id, path, fault): a row a fault."""
    spec = json.dumps(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want = json.loads(spec)
        for batch in batches:
            rows = []
            for case, own in zip(batch.column("case_id").to_pylist(), batch.column("output").to_pylist(), strict=True):
                value, good = _read(own)
                rows += [(case, *f) for f in (faults(value, want) if good else [("$", "not_json")])]
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["case_id", "path", "fault"])

    return outputs.select(F.col("case_id").cast("string").alias("case_id"), F.col(text).alias("output")).mapInArrow(run, "case_id string, path string, fault string")


def signatures(outputs: DataFrame, ignored: tuple[str, ...] = (), text: str = "output") -> DataFrame:
    """outputs(case_id, output) of repeated runs -> (case_id, runs, readable, signatures, stable): how many different outputs a case has, whatever the order of keys; fields named in ignored do not count."""

    def plain(value: object) -> object:
        if isinstance(value, dict):
            return {k: plain(v) for k, v in value.items() if k not in ignored}
        return [plain(v) for v in value] if isinstance(value, list) else value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for own in batch.column("output").to_pylist():
                value, good = _read(own)
                found.append(hashlib.sha256(json.dumps(plain(value), sort_keys=True, separators=(",", ":")).encode()).hexdigest() if good else None)
            yield pa.RecordBatch.from_arrays([batch.column("case_id"), pa.array(found, pa.string())], ["case_id", "signature"])

    signed = outputs.select(F.col("case_id").cast("string").alias("case_id"), F.col(text).alias("output")).mapInArrow(run, "case_id string, signature string")
    out = signed.groupBy("case_id").agg(F.count("*").alias("runs"), F.count("signature").alias("readable"), F.countDistinct("signature").alias("signatures"))
    return out.withColumn("stable", (F.col("signatures") == 1) & (F.col("readable") == F.col("runs")))
