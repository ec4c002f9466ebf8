"""Schema algebra on the driver: JSON schemas to flat fields, groups of bounded size, and leaf trees."""

from __future__ import annotations

SCALARS = ("string", "number", "integer", "boolean", "null")


def resolved(node: dict, root: dict, seen: tuple[str, ...] = ()) -> dict:
    """A node with local references followed, parts of allOf put together and a null alternative dropped.

    Raises ValueError for a cycle and for references to other documents.
    """
    while "$ref" in node:
        ref = node["$ref"]
        if ref in seen or not ref.startswith("#/"):
            raise ValueError(f"{ref}: a cycle" if ref in seen else f"{ref}: not in this schema")
        seen, target = (*seen, ref), root
        for part in ref[2:].split("/"):
            target = target.get(part, {})
        node = target
    if "allOf" in node:
        whole = {k: v for k, v in node.items() if k != "allOf"}
        for part in node["allOf"]:
            part = resolved(part, root, seen)
            fields = {**part.get("properties", {}), **whole.get("properties", {})}
            order = [*whole.get("properties", {}), *(k for k in part.get("properties", {}) if k not in whole.get("properties", {}))]
            whole = {**part, **whole, **({"properties": {k: fields[k] for k in order}} if fields else {})}
        node = whole
    for key in ("anyOf", "oneOf"):
        real = [n for n in node.get(key, []) if n.get("type") != "null"]
        if len(real) == 1:
            return resolved(real[0], root, seen)
    return node


def leaves(schema: dict, root: dict | None = None, path: str = "") -> list[tuple[str, str, bool]]:
    """(path, type, inside an array) of each scalar field, in order of definition."""
    root = root or schema
    node = resolved(schema, root)
    kind = node.get("type", "object" if "properties" in node else "string")
    kind = next((k for k in kind if k != "null"), "null") if isinstance(kind, list) else kind
    if kind == "object":
        return [x for name, child in node.get("properties", {}).items() for x in leaves(child, root, f"{path}.{name}" if path else name)]
    if kind == "array":
        return [(p, t, True) for p, t, _ in leaves(node.get("items", {}), root, f"{path}[]")]
    return [(path, kind, False)]


def groups(schema: dict, most: int) -> list[list[str]]:
    """Top-level fields in order, in groups of at most `most` leaves; a larger field is a group of its own."""
    out: list[list[str]] = []
    size = most
    for name, child in resolved(schema, schema).get("properties", {}).items():
        n = len(leaves(child, schema, name))
        if size + n > most:
            out.append([])
            size = 0
        out[-1].append(name)
        size += n
    return out


def merged(a, b):
    """First non-null scalar; objects by key; arrays end to end without repeats."""
    if a is None or b is None:
        return b if a is None else a
    if isinstance(a, dict) and isinstance(b, dict):
        return {k: merged(a.get(k), b.get(k)) for k in [*a, *(k for k in b if k not in a)]}
    if isinstance(a, list) and isinstance(b, list):
        return a + [x for x in b if x not in a]
    return a


def leaf_values(value, path: str = "") -> list[tuple[str, object]]:
    """(path, scalar) of a tree; elements of arrays by index."""
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in leaf_values(v, f"{path}.{k}" if path else k)]
    if isinstance(value, list):
        return [x for i, v in enumerate(value) for x in leaf_values(v, f"{path}[{i}]")]
    return [(path, value)]


def union_records(a: list[dict], b: list[dict]) -> list[dict]:
    """Pair records by shared identity values, most shared first, then nearest place, then the last; records
    without any pair by place among themselves; fill nulls; append the rest of b."""
    def identity(r: dict) -> set[str]:
        flat = ("".join(c for c in str(v).lower() if c.isalnum()) for _, v in leaf_values(r) if v is not None and not isinstance(v, bool))
        return {x for x in flat if len(x) >= 3}

    ia, ib = [identity(r) for r in a], [identity(r) for r in b]
    holders: dict[str, list[int]] = {}
    for i, keys in enumerate(ia):
        for k in keys:
            holders.setdefault(k, []).append(i)
    score: dict[tuple[int, int], int] = {}
    for j, keys in enumerate(ib):
        for k in keys:
            for i in holders.get(k, ()):
                score[i, j] = score.get((i, j), 0) + 1
    pair: dict[int, int] = {}
    used: set[int] = set()
    for (i, j), _ in sorted(score.items(), key=lambda x: (x[1], -abs(x[0][0] - x[0][1]), x[0]), reverse=True):
        if i not in used and j not in pair:
            pair[j] = i
            used.add(i)
    for j in range(len(b)):
        if j not in pair and not ib[j] and j < len(a) and j not in used and not ia[j]:
            pair[j] = j
            used.add(j)
    back = {i: j for j, i in pair.items()}
    return [merged(r, b[back[i]]) if i in back else r for i, r in enumerate(a)] + [r for j, r in enumerate(b) if j not in pair]
