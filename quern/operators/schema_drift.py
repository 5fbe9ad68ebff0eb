"""Fields that come, go, change name or type between files (general problem 1).

A catalogue of column lifespans stands in for the footers of the dump files:
each file contributes its (path, type) pairs once, gathered per batch before
the shuffle. Within a producer's stream of files, lag and lead over the file
ordinals cut the presence of each (path, type) into islands; where an island
begins or ends, a change is logged. Pairs of an ending and a beginning whose
values agree on all records that both files share are renames and make the
alias table. From it and the types of each field's lifespans the casts of one
typed table per entity are generated.

Only paths that changed are looked up again in the records, so the second pass
moves a few values and not the records.

Defined results: lines that are no JSON objects (null, empty, damaged) count
for nothing, records with a null id take no part in renames, a file without
any usable line keeps its place in the order and loses all paths, equal
exported_at is ordered by file name, lines repeated in a file count once.
Records with a null id are rows of the typed tables like any other.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.nested_records import strict_json, text_array
from quern.plans.checkpoints import cut

STREAM = ["exporter", "entity"]


def _kind(v) -> str:
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    return "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"


def leaves(record: dict) -> Iterator[tuple[str, str, object]]:
    """(path, type, value) of each non-null member at any depth; for objects the value is None."""
    stack = [("", record)]
    while stack:
        at, node = stack.pop()
        for k, v in node.items():
            path = f"{at}.{k}" if at else k
            if isinstance(v, dict):
                yield path, "object", None
                stack.append((path, v))
            elif v is not None:
                yield path, _kind(v), v


def _batch(columns: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([text_array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_FOOT = pa.schema([("exporter", pa.string()), ("entity", pa.string()), ("dump_file", pa.string()), ("path", pa.string()), ("type", pa.string()), ("n", pa.int64()), ("whole", pa.int64())])


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: dict[tuple, list[int]] = {}
        for exporter, entity, dump, text in zip(*(c.to_pylist() for c in batch.columns)):
            ok, record = strict_json(text)
            if ok and isinstance(record, dict):
                for path, kind, v in leaves(record):
                    n = seen.setdefault((exporter, entity, dump, path, kind), [0, 0])
                    n[0] += 1
                    n[1] += kind == "number" and isinstance(v, int) and -(2**63) <= v < 2**63
        yield _batch([list(c) for c in zip(*((*k, *n) for k, n in seen.items()))] or [[] for _ in _FOOT], _FOOT)


_VALUE = pa.schema([("dump_file", pa.string()), ("exporter", pa.string()), ("entity", pa.string()), ("record_id", pa.string()), ("path", pa.string()), ("value", pa.string())])


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in _VALUE]
        for exporter, entity, dump, text, wanted in zip(*(c.to_pylist() for c in batch.columns)):
            ok, record = strict_json(text)
            if not ok or not isinstance(record, dict) or record.get("id") is None:
                continue
            wanted = set(wanted)
            for path, kind, v in leaves(record):
                if path in wanted and kind != "object":
                    for c, x in zip(out, (dump, exporter, entity, json.dumps(record["id"]), path, json.dumps(v, sort_keys=True))):
                        c.append(x)
        yield _batch(out, _VALUE)


def catalogue(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, lifespans).

    files: exporter, entity, dump_file, at, no; lifespans: exporter, entity, path, type, first_no, last_no, n, whole (of n values the whole numbers).
    """
    order = Window.partitionBy(*STREAM).orderBy("at", "dump_file")
    files = lines.groupBy(*STREAM, "dump_file").agg(F.min("exported_at").alias("at")).withColumn("no", F.row_number().over(order))
    foot = lines.select(*STREAM, "dump_file", "record_json").mapInArrow(_footers, "exporter string, entity string, dump_file string, path string, type string, n long, whole long")
    per_file = foot.groupBy(*STREAM, "dump_file", "path", "type").agg(F.sum("n").alias("n"), F.sum("whole").alias("whole"))
    seen = cut(per_file.join(files, [*STREAM, "dump_file"]).select(*STREAM, "path", "type", "no", "n", "whole"))
    life = Window.partitionBy(*STREAM, "path", "type").orderBy("no")
    islands = seen.withColumn("new", (F.col("no") - F.lag("no", 1, -1).over(life) > 1).cast("int")).withColumn("island", F.sum("new").over(life))
    return files, islands.groupBy(*STREAM, "path", "type", "island").agg(F.min("no").alias("first_no"), F.max("no").alias("last_no"), F.sum("n").alias("n"), F.sum("whole").alias("whole")).drop("island")


def _edges(lifespans: DataFrame, files: DataFrame) -> DataFrame:
    """Beginnings and endings as (stream, no, path, olds, news): the types that ended before and began in file no."""
    last = files.groupBy(*STREAM).agg(F.max("no").alias("final"))
    spans = lifespans.join(last, STREAM)
    start = spans.filter(F.col("first_no") > 1).select(*STREAM, F.col("first_no").alias("no"), "path", F.lit(None).cast("string").alias("old"), F.col("type").alias("new"))
    end = spans.filter(F.col("last_no") < F.col("final")).select(*STREAM, (F.col("last_no") + 1).alias("no"), "path", F.col("type").alias("old"), F.lit(None).cast("string").alias("new"))
    return start.unionByName(end).groupBy(*STREAM, "no", "path").agg(F.array_sort(F.collect_set("old")).alias("olds"), F.array_sort(F.collect_set("new")).alias("news"))


def changes(lines: DataFrame) -> DataFrame:
    """Every change: exporter, entity, dump_file, no, change, old_path, new_path, old_type, new_type."""
    files, lifespans = catalogue(lines)
    return _changes(lines, cut(files), cut(lifespans))


def _changes(lines: DataFrame, files: DataFrame, lifespans: DataFrame) -> DataFrame:
    edges = cut(_edges(lifespans, files))
    # A type that goes while another of the path comes or stays is a retype, as is one that comes beside others.
    at = lambda no: (F.col("s.first_no") <= no) & (no <= F.col("s.last_no"))
    keyed = edges.alias("e").join(lifespans.alias("s"), [*STREAM, "path"]).groupBy(*STREAM, "no", "path").agg(
        F.first("olds").alias("olds"), F.first("news").alias("news"),
        F.array_sort(F.collect_set(F.when(at(F.col("no") - 1), F.col("type")))).alias("before"),
        F.array_sort(F.collect_set(F.when(at(F.col("no")), F.col("type")))).alias("after"),
    )
    has = lambda c: F.size(c) > 0
    leaf = lambda c: F.size(F.array_except(c, F.array(F.lit("object")))) > 0
    kinds = keyed.withColumn(
        "kind",
        F.when(has("before") & has("after"), F.lit("retyped"))
        .when(~has("before") & leaf("after"), F.lit("new"))
        .when(~has("after") & leaf("before"), F.lit("gone")),
    ).filter(F.col("kind").isNotNull())
    kinds = cut(kinds.select(*STREAM, "no", "path", "kind", F.array_join("before", "|").alias("old_type"), F.array_join("after", "|").alias("new_type")))
    retyped = kinds.filter("kind = 'retyped'")
    # Below a path that turned from or into an object nothing is a case.
    turned = retyped.filter(F.col("old_type").contains("object") | F.col("new_type").contains("object")).select(*STREAM, "no", F.col("path").alias("above"))
    moved = kinds.filter("kind <> 'retyped'").withColumn("above", F.explode_outer(_prefixes(F.col("path"))))
    below = moved.join(turned, [*STREAM, "no", "above"]).select(*STREAM, "no", "path").distinct()
    moved = cut(kinds.filter("kind <> 'retyped'").join(below, [*STREAM, "no", "path"], "left_anti"))
    renamed = cut(_renames(lines, files, moved))
    done = renamed.select(*STREAM, "no", F.col("old_path").alias("path"), F.lit("gone").alias("kind")).unionByName(renamed.select(*STREAM, "no", F.col("new_path").alias("path"), F.lit("new").alias("kind"))).distinct()
    plain = moved.join(done, [*STREAM, "no", "path", "kind"], "left_anti")
    new = F.col("kind") == "new"
    log = (
        retyped.select(*STREAM, "no", F.lit("retyped").alias("change"), F.col("path").alias("old_path"), F.col("path").alias("new_path"), "old_type", "new_type")
        .unionByName(renamed.select(*STREAM, "no", F.lit("renamed").alias("change"), "old_path", "new_path", F.lit("").alias("old_type"), F.lit("").alias("new_type")))
        .unionByName(plain.select(*STREAM, "no", F.when(new, F.lit("added")).otherwise(F.lit("removed")).alias("change"), F.when(new, F.lit("")).otherwise(F.col("path")).alias("old_path"), F.when(new, F.col("path")).otherwise(F.lit("")).alias("new_path"), "old_type", "new_type"))
    )
    return log.join(files.select(*STREAM, "no", "dump_file"), [*STREAM, "no"])


def _prefixes(path: Column) -> Column:
    """The proper prefixes of a dotted path."""
    keys = F.split(path, r"\.")
    return F.when(F.size(keys) > 1, F.transform(F.sequence(F.lit(1), F.size(keys) - 1), lambda i: F.array_join(F.slice(keys, 1, i), ".")))


def _renames(lines: DataFrame, files: DataFrame, moved: DataFrame) -> DataFrame:
    """(stream, no, old_path, new_path) whose values agree on all records with both."""
    # Values of gone paths are read in the file before, those of new paths in the file itself; both keep the number of the later one.
    both = moved.groupBy(*STREAM, "no").agg(F.sum((F.col("kind") == "new").cast("int")).alias("n"), F.sum((F.col("kind") == "gone").cast("int")).alias("g")).filter("n > 0 and g > 0").select(*STREAM, "no")
    moved = moved.join(both, [*STREAM, "no"])
    sides = moved.select(*STREAM, "path", "kind", F.col("no").alias("later"), F.when(F.col("kind") == "new", F.col("no")).otherwise(F.col("no") - 1).alias("no"))
    sides = cut(sides.join(files.select(*STREAM, "no", "dump_file"), [*STREAM, "no"]))
    wanted = sides.groupBy(*STREAM, "dump_file").agg(F.collect_set("path").alias("wanted"))
    found = lines.join(wanted, [*STREAM, "dump_file"]).select(*STREAM, "dump_file", "record_json", "wanted").mapInArrow(_values, "dump_file string, exporter string, entity string, record_id string, path string, value string")
    values = found.join(sides.select(*STREAM, "dump_file", "path", "kind", "later"), [*STREAM, "dump_file", "path"]).groupBy(*STREAM, "later", "record_id", "kind", "path").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    values = cut(values)
    old = values.filter("kind = 'gone'").select(*STREAM, "later", "record_id", F.col("path").alias("old_path"), F.col("lo").alias("o_lo"), F.col("hi").alias("o_hi"))
    new = values.filter("kind = 'new'").select(*STREAM, "later", "record_id", F.col("path").alias("new_path"), F.col("lo").alias("n_lo"), F.col("hi").alias("n_hi"))
    same = (F.col("o_lo") == F.col("n_lo")) & (F.col("o_hi") == F.col("n_hi")) & (F.col("o_lo") == F.col("o_hi"))
    pairs = old.join(new, [*STREAM, "later", "record_id"]).groupBy(*STREAM, "later", "old_path", "new_path").agg(F.min(same).alias("all_same"))
    return pairs.filter("all_same").select(*STREAM, F.col("later").alias("no"), "old_path", "new_path")


def aliases(log: DataFrame, lifespans: DataFrame) -> DataFrame:
    """Lifespans with field, the last name of their path: renames after the lifespan are followed, one of each chain per round."""
    names = log.filter("change = 'renamed'").select(*STREAM, "no", F.col("old_path").alias("field"), F.struct(F.col("no"), F.col("new_path").alias("to")).alias("hop"))
    spans = lifespans.withColumn("field", F.col("path")).withColumn("since", F.col("last_no"))
    key = [*STREAM, "path", "type", "first_no"]
    while True:
        hop = cut(spans.join(names, [*STREAM, "field"]).filter(F.col("no") > F.col("since")).groupBy(*key).agg(F.min("hop").alias("hop")))
        if hop.isEmpty():
            return spans.drop("since")
        spans = cut(spans.join(hop, key, "left").select(*lifespans.columns, F.coalesce("hop.to", "field").alias("field"), F.coalesce("hop.no", "since").alias("since")))


def casts(spans: DataFrame) -> DataFrame:
    """entity, field, cast_to, paths: the narrowest type that holds every value a field ever had; arrays and mixtures are text."""
    kind = F.when(F.col("type") != "number", F.col("type")).when(F.col("whole") == F.col("n"), F.lit("integer")).otherwise(F.lit("number"))
    kinds = spans.filter("type <> 'object'").groupBy("entity", "field").agg(F.collect_set(kind).alias("kinds"), F.array_sort(F.collect_set("path")).alias("paths"))
    only = lambda *names: F.size(F.array_except("kinds", F.array(*[F.lit(n) for n in names]))) == 0
    to = F.when(only("integer"), "bigint").when(only("integer", "number"), "double").when(only("boolean"), "boolean").otherwise("string")
    return kinds.select("entity", "field", to.alias("cast_to"), "paths")


def _aligned(fields: list[str]):
    """An Arrow pass from record_json and the renamed paths of its file to the values of fields, as text in their order."""
    place = {f: i for i, f in enumerate(fields)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep: list[int] = []
            cells: list[list] = []
            for row, (text, renamed) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                ok, record = strict_json(text)
                if not ok or not isinstance(record, dict):
                    continue
                to = {r["path"]: r["field"] for r in renamed or ()}
                values: list[str | None] = [None] * len(fields)
                for path, kind, v in leaves(record):
                    if kind != "object" and (at := place.get(to.get(path, path))) is not None:
                        values[at] = v if isinstance(v, str) else json.dumps(v)
                keep.append(row)
                cells.append(values)
            kept = batch.take(pa.array(keep, pa.int64()))
            try:
                made = pa.array(cells, pa.list_(pa.string()))
            except UnicodeEncodeError:  # halves of a surrogate pair
                made = pa.array([[None if v is None else v.encode("utf-8", "backslashreplace").decode() for v in row] for row in cells], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*kept.columns[2:], made], names=[*kept.schema.names[2:], "cells"])

    return run


#: Bytes up to which the renamed paths of all files are sent to every executor; beyond, they are joined by shuffling.
BROADCAST_BYTES = 32 << 20


def unify(lines: DataFrame) -> dict[str, DataFrame]:
    """One typed table per entity: exporter, dump_file, line_no and every field under its last name, with its cast.

    Fields are collected on the driver, as a table's columns must be; they are bounded by the shapes of records, not their number.
    Lines repeated in a file are one row, that of the least line_no. Names that clash, with the three key columns or but for their case, get a trailing underscore.
    """
    files, lifespans = catalogue(lines)
    files, lifespans = cut(files), cut(lifespans)
    spans = cut(aliases(cut(_changes(lines, files, lifespans)), lifespans))
    renamed = spans.filter("field <> path").join(files, STREAM).filter("no between first_no and last_no").groupBy(*STREAM, "dump_file").agg(F.collect_set(F.struct("path", "field")).alias("renamed"))
    renamed = cut(renamed)
    size = renamed.select(F.sum(F.aggregate("renamed", F.lit(0), lambda n, r: n + F.length(r["path"]) + F.length(r["field"]) + 16))).first()[0] or 0
    once = lines.filter(F.col("record_json").isNotNull()).groupBy(*STREAM, "dump_file", "record_json").agg(F.min("line_no").alias("line_no"))
    named = once.join(F.broadcast(renamed) if size <= BROADCAST_BYTES else renamed, [*STREAM, "dump_file"], "left")
    wanted: dict[str, list] = {}
    for r in casts(spans).orderBy("entity", "field").collect():
        wanted.setdefault(r["entity"], []).append((r["field"], r["cast_to"]))
    return {entity: _typed(named.filter(F.col("entity") == entity), columns) for entity, columns in wanted.items()}


def _typed(named: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    keys = ["exporter", "dump_file", "line_no"]
    ddl = f"exporter string, dump_file string, line_no {named.schema['line_no'].dataType.simpleString()}, cells array<string>"
    cells = named.select("record_json", "renamed", *keys).mapInArrow(_aligned([f for f, _ in columns]), ddl)
    names: dict[str, str] = {k: k for k in keys}
    for f, _ in columns:
        free = f
        while free.lower() in names:  # also fields that differ in case only
            free += "_"
        names[free.lower()] = free
    return cells.select(*keys, *[F.col("cells")[i].try_cast(to).alias(name) for i, ((_, to), name) in enumerate(zip(columns, list(names.values())[3:]))])
