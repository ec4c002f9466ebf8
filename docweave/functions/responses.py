"""Response schemas: checks of a user's schema, the schema that a model answers to, and answers back in the user's shape.

Schemas are few and small, so they are handled on the driver; answers are JSON columns, restored by
Arrow functions over a schema in the closure. User schemas map field names to nodes.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Limits of a user's schema, types of leaves, keys of references, of wrapped leaves and of what dialects keep.
DEPTH, LEAVES, DESIGNED = 5, 1000, 40
TYPES = ("boolean", "integer", "number", "string")
REFERENCES = ("$ref", "$dynamicRef", "$recursiveRef")
WRAPPED, WRAPPED_PLAIN = {"value", "chunks", "quote"}, {"value", "quote"}
KEPT = ("required", "description", "nullable")
LETTERS = "abcdefghijklmnopqrstuvwxyz"


class SchemaError(ValueError):
    """kind: empty, too_wide, too_deep, cycle, unsupported or malformed."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


def scalar_type(kind):
    """The type of a nullable union; others as they are."""
    return next((k for k in kind if k != "null"), "string") if isinstance(kind, list) else kind


def clean_enum(values) -> list | None:
    """Members without null; None if none is left."""
    return [v for v in values if v is not None] or None if isinstance(values, list) else None


def _kind(node: dict) -> str:
    return scalar_type(node.get("type", "string"))


def _children(node: dict) -> Iterator[tuple[str, dict]]:
    """Parts of an object by name, or of an array as []."""
    if _kind(node) == "object":
        yield from node.get("properties", {}).items()
    elif _kind(node) == "array":
        yield "[]", node.get("items", {"type": "string"})


def checked(schema: dict) -> int:
    """The number of leaves of a user's schema; SchemaError if it can't be answered."""
    if not isinstance(schema, dict) or not schema:
        raise SchemaError("empty", "a schema is an object of fields")
    leaves, todo = 0, [(str(name), node, 1) for name, node in reversed(schema.items())]
    while todo:
        path, node, depth = todo.pop()
        if not isinstance(node, dict):
            raise SchemaError("unsupported", f"{path}: not an object")
        if any(k in node for k in REFERENCES):
            raise SchemaError("cycle", f"{path}: references aren't supported")
        if depth > DEPTH:
            raise SchemaError("too_deep", f"{path}: more than {DEPTH} levels")
        kind = _kind(node)
        if kind == "object" and not (isinstance(node.get("properties"), dict) and node["properties"]):
            raise SchemaError("malformed", f"{path}: an object needs properties")
        if kind == "array" and not isinstance(node.get("items"), dict):
            raise SchemaError("malformed", f"{path}: an array needs items")
        if kind in ("object", "array"):
            todo += [(path + name if name == "[]" else f"{path}.{name}", child, depth + 1) for name, child in reversed(list(_children(node)))]
        elif kind in TYPES:
            leaves += 1
        else:
            raise SchemaError("unsupported", f"{path}: type {kind!r} is none of {', '.join(TYPES)}, object, array")
    if leaves > LEAVES:
        raise SchemaError("too_wide", f"{leaves} leaves, more than {LEAVES}")
    return leaves


def _shaped(node: dict, leaf: Callable[[dict], dict], optional: bool) -> dict:
    """node with every leaf replaced; `optional` lets objects leave fields out."""
    if _kind(node) == "array":
        return {"type": "array", "items": _shaped(next(_children(node))[1], leaf, optional)}
    if _kind(node) == "object":
        out = {"type": "object", "properties": {k: _shaped(v, leaf, optional) for k, v in _children(node)}}
        return out | {"required": []} if optional else out
    return leaf(node)


def _value(node: dict) -> dict:
    enum = clean_enum(node.get("enum"))
    return {"type": _kind(node), "nullable": True} | ({} if enum is None else {"enum": enum})


def wrapped(node: dict, chunk_ids: bool = True, optional: bool = False) -> dict:
    """Each leaf with the chunks it is from, if asked for, and a quote."""

    def leaf(n: dict) -> dict:
        chunks = {"chunks": {"type": "array", "items": {"type": "integer"}}} if chunk_ids else {}
        parts = {"value": _value(n), **chunks, "quote": {"type": "string"}}
        return {"type": "object", "description": n.get("description", ""), "properties": parts, "required": list(parts)}

    return _shaped(node, leaf, optional)


def bare(node: dict, optional: bool = False) -> dict:
    """Each leaf as a nullable value."""
    return _shaped(node, lambda n: {"type": _kind(n), "nullable": True, "description": n.get("description", "")} | _value(n), optional)


def dialect(node: dict) -> dict:
    """The same schema in the dialect of upper-case types, with the keys that it knows."""
    out = {k: v for k, v in node.items() if k in KEPT}
    if "type" in node:
        out["type"] = str(scalar_type(node["type"])).upper()
    if "properties" in node:
        out["properties"] = {k: dialect(v) for k, v in node["properties"].items()}
    if "items" in node:
        out["items"] = dialect(node["items"])
    enum = clean_enum(node.get("enum"))
    return out if enum is None else out | {"enum": enum}


def response_schema(schema: dict, chunk_ids: bool = True, wrap: bool = True, optional: bool = False) -> dict:
    """What a model is asked to answer to, for a user's schema."""
    whole = {"type": "object", "properties": schema}
    return dialect(wrapped(whole, chunk_ids, optional) if wrap else bare(whole, optional))


def absent(node, wrap: bool = True, chunk_ids: bool = True):
    """What stands for a field that an answer leaves out: nulls in all leaves, arrays empty."""
    if isinstance(node, dict) and _kind(node) == "object":
        return {k: absent(v, wrap, chunk_ids) for k, v in _children(node)}
    if isinstance(node, dict) and _kind(node) == "array":
        return []
    return ({"value": None, "chunks": [], "quote": ""} if chunk_ids else {"value": None, "quote": ""}) if wrap else None


def rehydrated(answer, node, wrap: bool = True, chunk_ids: bool = True):
    """An answer with all declared fields; fields that aren't declared stay."""
    if not isinstance(node, dict):
        return answer
    if isinstance(answer, dict) and _kind(node) == "object":
        return answer | {k: rehydrated(answer[k], v, wrap, chunk_ids) if k in answer else absent(v, wrap, chunk_ids) for k, v in _children(node)}
    if isinstance(answer, list) and _kind(node) == "array":
        return [rehydrated(x, next(_children(node))[1], wrap, chunk_ids) for x in answer]
    return answer


def alias(n: int) -> str:
    """a to z, aa, ab and so on: numbers from 0 in letters, each word once."""
    word, n = "", n + 1
    while n:
        n, digit = divmod(n - 1, len(LETTERS))
        word = LETTERS[digit] + word
    return word


def row_aliases(schema: dict) -> dict[str, dict[str, str]]:
    """For each field that is an array of objects the names of its columns by short alias, in order."""
    out = {}
    for name, node in schema.items():
        if isinstance(node, dict) and scalar_type(node.get("type")) == "array" and isinstance(items := node.get("items"), dict) and scalar_type(items.get("type")) == "object" and items.get("properties"):
            out[name] = {alias(k): column for k, column in enumerate(items["properties"])}
    return out


def aliased(response: dict, aliases: dict[str, dict[str, str]]) -> dict:
    """A response schema whose rows have the short names."""
    parts = dict(response.get("properties") or {})
    for name, columns in aliases.items():
        items = parts[name].get("items") if isinstance(parts.get(name), dict) else None
        if isinstance(items, dict):
            own = items.get("properties") or {}
            new = items | {"properties": {a: own[c] for a, c in columns.items() if c in own}}
            if isinstance(items.get("required"), list):
                new["required"] = [a for a, c in columns.items() if c in items["required"]]
            parts[name] = parts[name] | {"items": new}
    return response | {"properties": parts}


def unaliased(answer, aliases: dict[str, dict[str, str]]):
    """Rows of an answer with their full names; what isn't an alias stays."""
    if not isinstance(answer, dict):
        return answer
    rename = lambda row, names: {names.get(k, k): v for k, v in row.items()} if isinstance(row, dict) else row
    return answer | {name: [rename(r, names) for r in answer[name]] for name, names in aliases.items() if isinstance(answer.get(name), list)}


def is_wrapped(node) -> bool:
    return isinstance(node, dict) and (node.keys() >= WRAPPED or node.keys() == WRAPPED_PLAIN)


def unwrapped(node):
    """Values of a wrapped answer, unverified; empty texts are null."""
    if is_wrapped(node):
        return None if node.get("value") == "" else node.get("value")
    if isinstance(node, dict):
        return {k: unwrapped(v) for k, v in node.items()}
    return [unwrapped(v) for v in node] if isinstance(node, list) else node


def has_content(node) -> bool:
    """Some leaf isn't null."""
    parts = node.values() if isinstance(node, dict) else node if isinstance(node, list) else None
    return node is not None if parts is None else any(map(has_content, parts))


def designed(fields: list) -> dict:
    """A flat schema from a model's proposals: trimmed names without . and [], once each, known types, at most so many."""
    out: dict[str, dict] = {}
    for f in fields or []:
        name = f.get("name") if isinstance(f, dict) else None
        name = name.strip() if isinstance(name, str) else ""
        if name and name not in out and not set(name) & set(".[]") and len(out) < DESIGNED:
            out[name] = {"type": f["type"] if f.get("type") in TYPES else "string", "description": str(f.get("description") or "")}
    if not out:
        raise SchemaError("empty", "no usable fields")
    return out


def answers(df: DataFrame, schema: dict, column: str = "answer", wrap: bool = True, chunk_ids: bool = True) -> DataFrame:
    """df with JSON answers of aliased rows restored to the user's shape in `restored`, and their `values` alone.

    Answers that aren't JSON give null in both; null stays null.
    """
    aliases, node = row_aliases(schema), {"type": "object", "properties": schema}

    @F.pandas_udf("struct<restored:string,values:string>")
    def restore(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            try:
                whole = rehydrated(unaliased(json.loads(t), aliases), node, wrap, chunk_ids)
                out.append((json.dumps(whole, ensure_ascii=False), json.dumps(unwrapped(whole) if wrap else whole, ensure_ascii=False)))
            except (TypeError, ValueError):
                out.append((None, None))
        return pd.DataFrame(out, columns=["restored", "values"])

    return df.withColumn("_r", restore(column)).select(*df.columns, "_r.restored", "_r.values")


def context_lines(e: DataFrame) -> DataFrame:
    """e: doc_id, page_no, idx, chunk_type, text. Elements with text as a model reads them: number in the
    document and page in brackets; tables are marked; texts of several lines follow on a new line."""
    order = Window.partitionBy("doc_id").orderBy("page_no", "idx")
    full = e.where(F.trim("text") != "").withColumn("i", F.row_number().over(order) - 1)
    head = F.concat(F.lit("["), F.col("i").cast("string"), F.lit(" | page "), F.col("page_no").cast("string"), F.when(F.col("chunk_type") == "table", " | table]").otherwise("]"))
    return full.select("doc_id", "page_no", "idx", F.concat(head, F.when(F.col("text").contains("\n"), "\n").otherwise(" "), F.col("text")).alias("line"))


def high_stakes(path: Column, suffixes: tuple[str, ...]) -> Column:
    """A field's path ends in one of the suffixes."""
    out = F.lit(False)
    for s in suffixes:
        out = out | path.endswith(s)
    return out


def normalized_datetime(kind: Column, key: Column, keys: tuple[str, ...]) -> Column:
    """A field whose schema says that it is a date or time, by format or by name."""
    return F.coalesce(kind.isin("date", "time", "date-time"), F.lit(False)) | F.coalesce(F.lower(key).isin(*keys), F.lit(False))
