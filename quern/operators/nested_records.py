"""Nested JSON as flat tables with Dewey labels (general problem 6).

Every node of a record gets a Dewey label, the numbers of the children on the
way to it; cutting the last number off gives its parent's label, so the parent
link needs no join. Nodes of one schema path (the path without ordinals) are
the rows of one table: the record itself, objects within objects, arrays and
each of their elements. An object's scalar members are its columns; members
that are objects or arrays are rows of their own. Nothing is lost: rebuild
gives the record back, empty and null parts included.

flatten keeps only the rows of objects inside arrays (p6_found).

Parsing is one Arrow pass without a shuffle. A string that itself holds a JSON
object or array is read as that value, at any depth. Text that is no JSON
(also NaN, Infinity, cut-off text, or nesting beyond the parser's stack) gives
no rows; null gives none; of repeated keys in an object the last counts, as in
common parsers. Halves of a surrogate pair are written as escapes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _refuse(token: str) -> None:
    raise ValueError(token)


def strict_json(text: str | None):
    """(True, value), or (False, None) if text is no JSON."""
    if text is None:
        return False, None
    try:
        return True, json.loads(text, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return False, None


def unwrap(value):
    """A string that holds a JSON object or array is that value."""
    if isinstance(value, str) and value.lstrip(" \t\r\n")[:1] in ("{", "["):
        ok, inner = strict_json(value)
        if ok and isinstance(inner, (dict, list)):
            return inner
    return value


def walk(value) -> Iterator[tuple[tuple, str, str, str, str | None, int | None, object]]:
    """(label, parent_path, path, schema_path, key, ordinal, node) of every node but the scalar members of objects.

    parent_path is the path of the nearest enclosing object that is an array element, '' if none. Walks with its own stack.
    """
    stack = [((), "", "", "", None, None, unwrap(value))]
    while stack:
        at = stack.pop()
        yield at
        label, parent, path, schema, _, ordinal, node = at
        if isinstance(node, dict):
            above = path if ordinal is not None else parent
            for i, (key, x) in enumerate(node.items()):
                x = unwrap(x)
                if isinstance(x, (dict, list)):
                    stack.append(((*label, i), above, f"{path}.{key}" if path else key, f"{schema}.{key}" if schema else key, key, None, x))
        elif isinstance(node, list):
            for i, x in enumerate(node):
                stack.append(((*label, i), parent, f"{path}[{i}]", f"{schema}[]", None, i, unwrap(x)))


def dewey(value) -> Iterator[tuple[str, str, str, dict]]:
    """(parent_path, child_path, schema_path, object) of each object that is an array element."""
    for _, parent, path, schema, _, ordinal, node in walk(value):
        if ordinal is not None and isinstance(node, dict):
            yield parent, path, schema, node


def _kind(node) -> str:
    return "object" if isinstance(node, dict) else "array" if isinstance(node, list) else "value"


def node_rows(value) -> Iterator[tuple]:
    """(label, parent_label, parent_path, path, schema_path, kind, key, ordinal, members, value) of every node.

    members: the scalar members of an object as JSON text, null for other nodes; value: JSON text of a scalar.
    """
    for label, parent, path, schema, key, ordinal, node in walk(value):
        members = json.dumps({k: v for k, v in node.items() if not isinstance(unwrap(v), (dict, list))}) if isinstance(node, dict) else None
        scalar = None if isinstance(node, (dict, list)) else json.dumps(node)
        yield ".".join(map(str, label)), ".".join(map(str, label[:-1])) if label else None, parent, path, schema, _kind(node), key, ordinal, members, scalar


def rebuild(nodes: list[tuple]):
    """The value of one record from its node rows (in any order): keys come in their old order, but scalars before objects and arrays."""
    made: dict[str, object] = {}
    for label, up, _, _, _, kind, key, ordinal, members, value in sorted(nodes, key=lambda n: [int(x) for x in n[0].split(".") if x]):
        node = json.loads(members) if kind == "object" else [] if kind == "array" else json.loads(value)
        made[label] = node
        if up is None:
            continue
        if ordinal is None:
            made[up][key] = node
        else:
            made[up].append(node)
    return made[""]


FOUND = "row_id string, parent_path string, child_path string, schema_path string"
NODES = "row_id string, label string, parent_label string, parent_path string, path string, schema_path string, kind string, key string, ordinal int, members string, value string"


def text_array(values: list, kind: pa.DataType) -> pa.Array:
    try:
        return pa.array(values, kind)
    except UnicodeEncodeError:  # halves of a surrogate pair
        return pa.array([None if v is None else v.encode("utf-8", "backslashreplace").decode() for v in values], kind)


def _pass(rows_of, ddl: str):
    """An Arrow pass that gives rows_of(value) of each record under its row id."""
    schema = pa.schema([(c.split(" ")[0], pa.int32() if c.endswith(" int") else pa.string()) for c in ddl.split(", ")])

    def batch(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * len(schema)
        return pa.RecordBatch.from_arrays([text_array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            out: list[tuple] = []
            for rid, text in zip(given.column(0).to_pylist(), given.column(1).to_pylist()):
                ok, value = strict_json(text)
                if ok:
                    for row in rows_of(value):
                        out.append((rid, *row))
                if len(out) > 20_000:
                    yield batch(out)
                    out = []
            yield batch(out)

    return run


def may_hold_array(json_col: str) -> Column:
    """False only for text in which no array can be: no bracket is written, plainly or by an escape."""
    return F.col(json_col).contains("[") | F.col(json_col).contains("\\u")


def flatten(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """Objects inside arrays of one JSON column: row_id, parent_path, child_path, schema_path."""
    rows = df.filter(may_hold_array(json_col)).select(F.col(id_col).cast("string"), F.col(json_col))
    return rows.mapInArrow(_pass(lambda v: (n[:3] for n in dewey(v)), FOUND), FOUND)


def nodes(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """All nodes of one JSON column, the rows of the tables that schema_path names."""
    return df.filter(F.col(json_col).isNotNull()).select(F.col(id_col).cast("string"), F.col(json_col)).mapInArrow(_pass(node_rows, NODES), NODES)


def latest_json(df: DataFrame, id_col: str, version_col: str, json_col: str, arrays_only: bool = True) -> DataFrame:
    """One row per id, that of the greatest version; with arrays_only, JSON without an array becomes null and isn't shuffled."""
    moved = F.when(may_hold_array(json_col), F.col(json_col)) if arrays_only else F.col(json_col)
    slim = df.select(F.col(id_col).alias("id"), F.col(version_col).alias("v"), moved.alias("j"))
    return slim.groupBy("id").agg(F.max(F.struct("v", "j")).alias("r")).select(F.col("id").alias(id_col), F.col("r.j").alias(json_col))
