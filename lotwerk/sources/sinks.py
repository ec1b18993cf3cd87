"""Writers: nothing is published before its gates pass, and a reader never sees half a table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwerk.sources import versions


class GateError(Exception):
    """Rows that must not be published, by gate."""


def content_hash(df: DataFrame) -> str:
    """A fingerprint of df's rows whatever their order; repeated rows count."""
    row = F.xxhash64(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}))
    n, a, b = df.select(row.alias("h")).agg(F.count("*"), F.sum(F.col("h").cast("decimal(38,0)")), F.bit_xor("h")).first()
    return f"{n}-{a or 0}-{b or 0}"


def publish(df: DataFrame, path: str, gates: dict[str, DataFrame] | None = None, only_if_changed: bool = True) -> bool:
    """Write df as the version of the table at path that holds (see versions.publish), once every gate has no rows.

    A reader, versions.published(), sees the old rows or the new ones at any time. False if the table already has the
    same content and is left alone.
    """
    failed = {k: n for k, g in (gates or {}).items() if (n := g.count())}
    if failed:
        raise GateError(f"not published: {failed}")
    spark = df.sparkSession
    old = versions.published(spark, path) if only_if_changed else None
    if old is not None and set(old.columns) == set(df.columns) and content_hash(old) == content_hash(df):
        return False
    versions.publish(df, path)
    return True


def json_lines(df: DataFrame, path: str) -> None:
    """One JSON object a row, nulls kept, in parallel files."""
    df.write.option("ignoreNullFields", "false").mode("overwrite").json(path)


def csv_export(df: DataFrame, path: str) -> None:
    """Semicolons, everything quoted, a header in every file; the order within files is df's."""
    df.write.mode("overwrite").option("sep", ";").option("quoteAll", True).option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def nested_map(df: DataFrame, key: str) -> DataFrame:
    """(key, points): every key's rows as one sorted array of structs, the shape of a map of lists."""
    rest = F.struct(*(c for c in df.columns if c != key))
    return df.groupBy(key).agg(F.sort_array(F.collect_list(rest)).alias("points"))


def gaps_marked(df: DataFrame, mark: str = "FEHLT") -> DataFrame:
    """All columns as text, what is missing written as mark."""
    return df.select(*(F.coalesce(F.col(c).cast("string"), F.lit(mark)).alias(c) for c in df.columns))


_JSON = {"string": "string", "boolean": "boolean", "date": "string", "timestamp": "string", "timestamp_ntz": "string", "double": "number", "float": "number", "decimal": "number"}


def _type(t: T.DataType) -> dict:
    if isinstance(t, T.StructType):
        return {"type": "object", "properties": {f.name: _type(f.dataType) for f in t.fields}}
    if isinstance(t, T.ArrayType):
        return {"type": "array", "items": _type(t.elementType)}
    if isinstance(t, T.MapType):
        return {"type": "object", "additionalProperties": _type(t.valueType)}
    return {"type": _JSON.get(t.typeName(), "integer")}


def contract(df: DataFrame) -> dict:
    """A JSON Schema of df's rows: types by column; required are those without a null, counted over all rows."""
    filled = df.agg(F.count("*").alias("__n"), *(F.count(F.col(c)).alias(c) for c in df.columns)).first()
    return {**_type(df.schema), "required": sorted(c for c in df.columns if filled["__n"] and filled[c] == filled["__n"])}


def _flat(schema: dict, path: str = "") -> dict[str, str]:
    out = {path: schema["type"] + ("<map>" if "additionalProperties" in schema else "")} if path else {}
    for k, v in schema.get("properties", {}).items():
        out |= _flat(v, f"{path}.{k}" if path else k)
    if "items" in schema:
        out |= _flat(schema["items"], f"{path}[]")
    if "additionalProperties" in schema:
        out |= _flat(schema["additionalProperties"], f"{path}{{}}")
    return out


def version_after(version: str, old: dict, new: dict) -> str:
    """The next version: major if a required path went or a type changed, minor if the paths or what is required
    changed otherwise, patch if the same."""
    major, minor, patch = map(int, version.split("."))
    a, b = _flat(old), _flat(new)
    if any(a[p] != b[p] for p in a.keys() & b.keys()) or set(old.get("required", [])) - b.keys():
        return f"{major + 1}.0.0"
    if a.keys() != b.keys() or old.get("required") != new.get("required"):
        return f"{major}.{minor + 1}.0"
    return f"{major}.{minor}.{patch + 1}"


def write_contract(df: DataFrame, path: str) -> str:
    """Keep the contract of df in the file path; rewritten, with its version raised, only if it changed."""
    new = contract(df)
    text = versions.read_text(df.sparkSession, path)
    old = json.loads(text) if text else None
    if old and old["schema"] == new:
        return old["version"]
    version = version_after(old["version"], old["schema"], new) if old else "1.0.0"
    versions.write_text(df.sparkSession, path, json.dumps({"version": version, "schema": new}, indent=1, sort_keys=True))
    return version


def violations(schema: dict, value: object, path: str = "$") -> list[str]:
    """Where a document breaks a contract: missing or wrongly typed parts, nulls passing as any type."""
    kinds = {"object": dict, "array": list, "string": str, "boolean": bool, "integer": int, "number": (int, float)}
    if value is None:
        return []
    if not isinstance(value, kinds[schema["type"]]) or (isinstance(value, bool) and schema["type"] in ("integer", "number")):
        return [f"{path} is no {schema['type']}"]
    out = [f"{path}.{k} is missing" for k in schema.get("required", []) if value.get(k) is None]
    for k, s in schema.get("properties", {}).items():
        out += violations(s, value.get(k), f"{path}.{k}")
    if "items" in schema:
        for i, x in enumerate(value):
            out += violations(schema["items"], x, f"{path}[{i}]")
    if "additionalProperties" in schema:
        for k, x in value.items():
            out += violations(schema["additionalProperties"], x, f"{path}.{k}")
    return out
