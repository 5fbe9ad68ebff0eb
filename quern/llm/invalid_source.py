"""Source files that do not parse (problem 2).

Each file's whole token stream goes through the table-driven GLR parser of its
language in one Arrow pass without a shuffle; the first error that no parse
survives is reported. Tables are built once on the driver from the bundled
grammars, whose size is fixed, and loaded by the workers.

Defined results: a null content or a language without a grammar is not judged
(error null, judged false); language is compared without case and outer
spaces; an empty text is judged by the grammar (no file of go or xml, a valid
one elsewhere); repeated rows give one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import syntax
from quern.plans.partitioning import spread

_SCHEMA = pa.schema([("project_id", pa.string()), ("path", pa.string()), ("language", pa.string()), ("judged", pa.bool_()), ("line", pa.int32()), ("token", pa.string())])


def _parser(packed: bytes):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = syntax.unpacked(packed)
        for batch in batches:
            out: list[list] = [[] for _ in _SCHEMA]
            for project, path, language, text in zip(*(c.to_pylist() for c in batch.columns)):
                known = (language or "").strip().lower()
                judged = known in syntax.LANGUAGES and text is not None
                error = syntax.first_error(known, text, tables) if judged else None
                for c, x in zip(out, (project, path, language, judged, error and error[0], error and error[1][:40])):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _SCHEMA)], schema=_SCHEMA)

    return go


def verdicts(files: DataFrame) -> DataFrame:
    """project_id, path, language, judged, line, token: line and token of the first error, null for whole files."""
    return spread(files.select("project_id", "path", "language", "content")).mapInArrow(_parser(syntax.packed()), "project_id string, path string, language string, judged boolean, line int, token string")


def invalid_files(files: DataFrame) -> DataFrame:
    """(project_id, path) of the files that aren't whole files of their language."""
    return verdicts(files).filter(F.col("line").isNotNull()).select("project_id", "path").distinct()


def error_rates(files: DataFrame) -> DataFrame:
    """project_id, language, files, invalid, rate over distinct paths."""
    one = verdicts(files).filter("judged").groupBy("project_id", "path", "language").agg(F.max(F.col("line").isNotNull().cast("long")).alias("bad"))
    return one.groupBy("project_id", "language").agg(F.count(F.lit(1)).alias("files"), F.sum("bad").alias("invalid")).withColumn("rate", F.round(F.col("invalid") / F.col("files"), 6))
