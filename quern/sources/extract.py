"""Symbols and references of source files, by line patterns per language; one pass, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (language, kind, pattern whose first group is the name)
DEFINITIONS = [
    ("python", "function", r"^\s*(?:async\s+)?def\s+(\w+)"), ("python", "class", r"^\s*class\s+(\w+)"),
    ("javascript", "function", r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)"), ("javascript", "class", r"^\s*(?:export\s+)?class\s+(\w+)"), ("javascript", "constant", r"^(?:export\s+)?const\s+(\w+)"),
    ("typescript", "function", r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)"), ("typescript", "class", r"^\s*(?:export\s+)?(?:abstract\s+)?class\s+(\w+)"), ("typescript", "interface", r"^\s*(?:export\s+)?interface\s+(\w+)"), ("typescript", "type_alias", r"^\s*(?:export\s+)?type\s+(\w+)"), ("typescript", "constant", r"^(?:export\s+)?const\s+(\w+)"),
    ("go", "function", r"^func\s+(?:\([^)]*\)\s*)?(\w+)"), ("go", "struct", r"^type\s+(\w+)\s+struct\b"),
    ("rust", "function", r"^\s*(?:pub\s+)?fn\s+(\w+)"), ("rust", "struct", r"^\s*(?:pub\s+)?struct\s+(\w+)"),
    ("java", "class", r"^\s*(?:public\s+)?(?:final\s+)?class\s+(\w+)"), ("c", "struct", r"^\s*struct\s+(\w+)\s*\{"),
]


def definition(language: Column, line: Column) -> Column:
    """struct(kind, name) of the symbol that a line defines, null if none."""
    return F.coalesce(*[F.when((language == lang) & line.rlike(p), F.struct(F.lit(kind).alias("kind"), F.regexp_extract(line, p, 1).alias("name"))) for lang, kind, p in DEFINITIONS])


def symbols(files: DataFrame) -> DataFrame:
    """project_id, path, kind, name, line of the definitions in files(project_id, path, language, content), of any size."""
    rows = files.filter(F.col("content").isNotNull()).select("project_id", "path", "language", "content").distinct()
    lines = rows.select("project_id", "path", "language", F.posexplode(F.split("content", "\n")).alias("no", "text"))
    found = lines.select("project_id", "path", (F.col("no") + 1).alias("line"), definition(F.col("language"), F.col("text")).alias("d")).filter("d IS NOT NULL")
    return found.select("project_id", "path", "d.kind", "d.name", "line")


#: (language, pattern whose first group is what a line imports)
IMPORTS = [
    ("python", r"^\s*import\s+([\w.]+)"), ("python", r"^\s*from\s+([\w.]+)\s+import\b"),
    ("javascript", r"""^\s*(?:import|export)\b[^"']*["']([^"']+)["']"""), ("javascript", r"""\brequire\(\s*["']([^"']+)["']\s*\)"""),
    ("typescript", r"""^\s*(?:import|export)\b[^"'=(]*["']([^"']+)["']"""), ("typescript", r"""\brequire\(\s*["']([^"']+)["']\s*\)"""),
    ("go", r"""^\s*(?:import\s+)?(?:[\w.]+\s+)?"([\w./-]+)"\s*$"""), ("rust", r"^\s*(?:pub\s+)?use\s+([\w:]+)"),
    ("java", r"^\s*import\s+(?:static\s+)?([\w.]+)"), ("c", r"""^\s*#\s*include\s*[<"]([^>"]+)[>"]"""),
]
CALL = r"\b([A-Za-z_]\w*)\s*\("
#: Words before a bracket that call nothing.
NO_CALL = tuple("if for while switch catch return function func fn def class sizeof elif and or not in await yield match with lambda typeof new super import assert print".split())


def import_of(language: Column, line: Column) -> Column:
    """What a line imports, null if nothing."""
    return F.coalesce(*[F.when((language == lang) & line.rlike(p), F.regexp_extract(line, p, 1)) for lang, p in IMPORTS])


def references(files: DataFrame) -> DataFrame:
    """project_id, path, language, kind (imports, calls), name, line of what the lines of files refer to; a line that defines a symbol doesn't call it."""
    rows = files.filter(F.col("content").isNotNull()).select("project_id", "path", "language", "content").distinct()
    lines = rows.select("project_id", "path", "language", F.posexplode(F.split("content", "\n")).alias("no", "text"))
    named, defined = import_of(F.col("language"), F.col("text")), definition(F.col("language"), F.col("text"))["name"]
    calls = F.filter(F.array_distinct(F.regexp_extract_all("text", F.lit(CALL), F.lit(1))), lambda n: ~n.isin(*NO_CALL) & ~n.eqNullSafe(defined))
    found = F.when(named.isNotNull(), F.array(F.struct(F.lit("imports").alias("kind"), named.alias("name")))).otherwise(F.transform(calls, lambda n: F.struct(F.lit("calls").alias("kind"), n.alias("name"))))
    return lines.filter(F.col("language") != "xml").select("project_id", "path", "language", F.explode(found).alias("r"), (F.col("no") + 1).alias("line")).select("project_id", "path", "language", "r.kind", "r.name", "line")


def symbols_sql() -> str:
    """The rows of symbols as SQL."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    cases = " ".join(f"WHEN language = '{lang}' AND regexp_matches(t, {quoted(p)}) THEN ['{kind}', regexp_extract(t, {quoted(p)}, 1)]" for lang, kind, p in DEFINITIONS)
    return f"""{_LINES}, m AS (SELECT project_id, path, line, CASE {cases} END AS d FROM l)
SELECT project_id, path, d[1] AS kind, d[2] AS name, CAST(line AS INTEGER) AS line FROM m WHERE d IS NOT NULL"""


_LINES = """WITH f AS (SELECT DISTINCT project_id, path, language, string_split(content, chr(10)) AS ls FROM source_files WHERE content IS NOT NULL), l AS (SELECT project_id, path, language, ls[i] AS t, i AS line FROM f, unnest(range(1, len(ls) + 1)) x(i))"""


def references_sql() -> str:
    """The rows of references as SQL."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    named = " ".join(f"WHEN language = '{lang}' AND regexp_matches(t, {quoted(p)}) THEN regexp_extract(t, {quoted(p)}, 1)" for lang, p in IMPORTS)
    defined = " ".join(f"WHEN language = '{lang}' AND regexp_matches(t, {quoted(p)}) THEN regexp_extract(t, {quoted(p)}, 1)" for lang, _, p in DEFINITIONS)
    none = ", ".join(f"'{w}'" for w in NO_CALL)
    return f"""{_LINES}, m AS (SELECT *, CASE {named} END AS named, CASE {defined} END AS defined FROM l WHERE language <> 'xml'),
c AS (SELECT *, list_distinct(list_filter(regexp_extract_all(t, {quoted(CALL)}, 1), lambda n: n NOT IN ({none}) AND n IS DISTINCT FROM defined)) AS calls FROM m)
SELECT project_id, path, language, 'imports' AS kind, named AS name, CAST(line AS INTEGER) AS line FROM c WHERE named IS NOT NULL
UNION ALL SELECT project_id, path, language, 'calls', unnest(calls), CAST(line AS INTEGER) FROM c WHERE named IS NULL"""


def hunks(patches: DataFrame) -> DataFrame:
    """doc, old_start, old_lines, new_start, new_lines of the hunks in unified diffs(doc, patch); a missing count is 1."""
    head = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
    lines = patches.select("doc", F.explode(F.split("patch", r"\r?\n")).alias("l")).filter(F.col("l").rlike(head))
    number = lambda i: F.coalesce(F.when(F.regexp_extract("l", head, i) != "", F.regexp_extract("l", head, i).cast("int")), F.lit(1))
    return lines.select("doc", number(1).alias("old_start"), number(2).alias("old_lines"), number(3).alias("new_start"), number(4).alias("new_lines"))
