"""Ranked search over symbols: field-qualified queries, weighted BM25 over prefixes, substring and edit-distance fallbacks.

A query's few words are matched within each row, so nothing of the corpus is
shuffled: one pass counts the rows per word and the mean length (one row of
totals), a second scores the rows and keeps the best.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.plans.checkpoints import cut

# Weight of a term's occurrences by column; a table may lack some of the columns.
WEIGHTS = {"name": 20.0, "qualified_name": 5.0, "docstring": 1.0, "signature": 2.0, "search_text": 3.0}
K1, B = 1.2, 0.75
OPERATORS = frozenset("and or not near".split())


@dataclass
class Query:
    """A parsed query: free text and the filters of its qualified words."""

    text: str = ""
    kinds: list[str] = field(default_factory=list)
    languages: list[str] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)


def parse_query(raw: str, kinds: set[str], languages: set[str]) -> Query:
    """kind:, lang:, language:, path: and name: filters; quoted values keep spaces; what isn't a known filter is text."""
    out, words = Query(), []
    for token in re.findall(r'(?:[^\s"]|"[^"]*"|"[^"]*$)+', raw):
        key, colon, value = token.partition(":")
        value = value[1:-1] if len(value) >= 2 and value[0] == value[-1] == '"' else value
        slot = {"kind": out.kinds, "lang": out.languages, "language": out.languages, "path": out.paths, "name": out.names}.get(key.lower())
        known = value in kinds if slot is out.kinds else value.lower() in languages if slot is out.languages else True
        if not colon or not key or not value or slot is None or not known:
            words.append(token)
        else:
            slot.append(value.lower() if slot is out.languages else value)
    out.text = " ".join(words).strip()
    return out


def with_search_text(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("search_text", T.search_text(F.col("name"), F.col("qualified_name")))


def terms(column: Column) -> Column:
    return F.filter(F.split(F.lower(column), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def query_phrases(text: str) -> list[list[list[str]]]:
    """Per word of the query its alternatives: the word as a prefix, or all of its parts as prefixes."""
    out = []
    for token in re.sub(r"['\"*():^]", "", text.replace("::", " ")).split():
        if token.lower() in OPERATORS:
            continue
        spaced = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", token))
        parts = list(dict.fromkeys(w for w in re.split(r"[^a-z0-9]+", spaced.lower()) if len(w) >= 2 and w not in OPERATORS))
        whole = [w for w in re.split(r"[^\w]+", token.lower()) if w]
        out.append([whole] + ([parts] if len(parts) >= 2 else []))
    return out


def bm25(nodes: DataFrame, text: str, limit: int) -> DataFrame:
    """id, score of the rows that match a word of the query, best first; at most max(5 * limit, 100).

    Formula: sum over prefixes p of idf(p) * f * (k1 + 1) / (f + k1 * (1 - b + b * len / avg len)), with
    idf(p) = max(ln((N - n + 0.5) / (n + 0.5)), 1e-6), f the weighted occurrences of words that begin with p, n the rows that have one.
    """
    phrases = query_phrases(text)
    prefixes = sorted({p for alternatives in phrases for group in alternatives for p in group})
    if not prefixes:
        return nodes.limit(0).select("id", F.lit(0.0).alias("score"))
    have = {c: F.coalesce(terms(F.col(c)), F.array().cast("array<string>")) for c in WEIGHTS if c in nodes.columns}
    hits = lambda c, p: F.size(F.filter(have[c], lambda t: F.startswith(t, F.lit(p)))) * WEIGHTS[c]
    rows = nodes.select("id", sum((F.size(c) for c in have.values()), F.lit(0)).alias("len"), *[sum((hits(c, p) for c in have), F.lit(0.0)).alias(f"f{i}") for i, p in enumerate(prefixes)])
    f = [F.col(f"f{i}") for i in range(len(prefixes))]
    totals = rows.agg(F.count(F.lit(1)).alias("every"), F.avg("len").alias("avg"), *[F.count(F.when(x > 0, 1)).alias(f"n{i}") for i, x in enumerate(f)])
    score = F.lit(0.0)
    for i, x in enumerate(f):
        n = F.col(f"n{i}")
        idf = F.greatest(F.log((F.col("every") - n + 0.5) / (n + 0.5)), F.lit(1e-6))
        score = score + F.when(x > 0, idf * x * (K1 + 1) / (x + K1 * (1 - B + B * F.col("len") / F.col("avg")))).otherwise(0.0)
    every = lambda group: reduce(lambda a, b: a & b, [f[prefixes.index(p)] > 0 for p in group])
    matched = reduce(lambda a, b: a | b, [every(group) for alternatives in phrases for group in alternatives if group])
    return rows.filter(matched).join(F.broadcast(totals)).select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(max(5 * limit, 100))


def like(nodes: DataFrame, text: str, limit: int) -> DataFrame:
    """id, score of the rows whose name or qualified name holds every word; 1, .9, .8, .7 or .5 by how the joined words occur."""
    words = [w for w in text.split() if len(w) >= 2]
    if not words:
        return nodes.limit(0).select("id", F.lit(0.0).alias("score"))
    joined = "".join(words)
    name, qualified = F.col("name"), F.col("qualified_name")
    every = F.lit(True)
    for w in words:
        every = every & (name.ilike(f"%{w}%") | qualified.ilike(f"%{w}%"))
    score = F.when(name == joined, 1.0).when(name.ilike(f"{joined}%"), 0.9).when(name.ilike(f"%{joined}%"), 0.8).when(qualified.ilike(f"%{joined}%"), 0.7).otherwise(0.5)
    return nodes.filter(every).select("id", score.alias("score"), F.length("name").alias("l")).orderBy(F.desc("score"), "l", "id").limit(limit).select("id", "score")


def fuzzy(nodes: DataFrame, text: str, limit: int) -> DataFrame:
    """id, score = 1 / (1 + distance) of the rows whose name is within 1 (short words) or 2 edits; at most five per name."""
    word = text.lower()
    most = 1 if len(word) <= 4 else 2
    distance = F.levenshtein(F.lower("name"), F.lit(word), most)
    names = nodes.select("name").distinct().withColumn("d", distance).filter("d >= 0").orderBy("d", "name").limit(max(2 * limit, 50))
    place = F.row_number().over(Window.partitionBy("name").orderBy("id"))
    met = nodes.join(F.broadcast(names), "name").withColumn("place", place).filter("place <= 5")
    return met.orderBy("d", "name", "id").limit(limit).select("id", (1 / (1 + F.col("d"))).alias("score"))


def exact_names(nodes: DataFrame, names: list[str], limit: int) -> DataFrame:
    """id, score of the rows with one of the names; rows in files of a distinctive name (in fewer than ten files) gain 20; a quota per name."""
    low = [n.lower() for n in names]
    quota = max(8, -(-limit // len(low)))
    met = nodes.select("id", F.lower("name").alias("n"), "file_path").filter(F.col("n").isin(low))
    files = met.select("n", "file_path").distinct()
    rare = files.groupBy("n").agg(F.count(F.lit(1)).alias("c")).filter("c < 10").select("n")
    near = files.join(rare, "n").select("file_path").distinct().withColumn("near", F.lit(20.0))
    scored = met.join(near, "file_path", "left").select("id", "n", (1.0 + F.coalesce("near", F.lit(0.0))).alias("score"))
    place = F.row_number().over(Window.partitionBy("n").orderBy(F.desc("score"), "id"))
    return scored.withColumn("place", place).filter(F.col("place") <= quota).orderBy(F.desc("score"), "id").limit(limit).select("id", "score")


def name_bonus(name: Column, query: str) -> Column:
    """80 for the query itself, 60 for one of its words, 10 to 40 for a prefix, 15 for all words, 10 for a substring."""
    low = F.lower(name)
    parts = [t for t in re.split(r"[\s_.\-]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", query).lower()) if len(t) >= 2]
    tokens = [t for t in query.lower().split() if len(t) >= 2]
    joined = re.sub(r"\s+", "", query).lower()
    bonus = F.when(low == joined, 80)
    if len(tokens) > 1:
        bonus = bonus.when(low.isin(tokens), 60)
    bonus = bonus.when(F.startswith(low, F.lit(joined)), F.floor(10 + 30 * F.lit(len(joined)) / F.length(low) + 0.5))
    if len(parts) > 1:
        every = F.lit(True)
        for t in parts:
            every = every & F.contains(low, F.lit(t))
        bonus = bonus.when(every, 15)
    return bonus.when(F.contains(low, F.lit(joined)), 10).otherwise(0)


def _plain_terms(query: str) -> list[str]:
    """The terms of a query as text.search_terms gives them without other forms."""
    whole = re.findall(r"\b(?:[a-zA-Z][a-zA-Z0-9]*(?:[A-Z][a-z]+)+|[A-Z][a-z]+(?:[A-Z][a-z]*)+)\b", query) + re.findall(r"\b[a-zA-Z][a-zA-Z0-9]*(?:_[a-zA-Z0-9]+)+\b", query)
    spaced = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", re.sub(r"([a-z])([A-Z])", r"\1 \2", query))
    words = [w for w in re.split(r"[^a-z0-9]+", spaced.lower()) if len(w) >= 3 and w not in T.STOP_WORDS]
    return list(dict.fromkeys([w.lower() for w in whole if len(w) >= 3] + words))


def rescored(nodes: DataFrame, found: DataFrame, query: str, limit: int) -> DataFrame:
    """id, score with the bonuses of kind, path and name, best first."""
    test = "test" in query.lower() or "spec" in query.lower()
    extra = T.kind_bonus(F.col("kind")) + T.path_relevance(F.col("file_path"), _plain_terms(query), test) + name_bonus(F.col("name"), query)
    return found.join(nodes, "id").select("id", "name", "file_path", (F.col("score") + extra).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def search(nodes: DataFrame, raw: str, limit: int = 100, kinds: set[str] = frozenset(T.KIND_BONUS), languages: set[str] = frozenset()) -> DataFrame:
    """id, score of a query: the first step of the ladder that finds something, exact names added, rescored, then gated by path: and name:.

    The gates come after the limit, as the query language defines them.
    """
    q = parse_query(raw, set(kinds), set(languages))
    base = with_search_text(nodes.filter(F.col("kind").isin(q.kinds)) if q.kinds else nodes)
    if q.languages:
        base = base.filter(F.col("language").isin(q.languages))
    base = cut(base)
    found = cut(bm25(base, q.text, limit)) if q.text else base.orderBy("name", "id").limit(5 * limit).select("id", F.lit(1.0).alias("score"))
    if len(q.text) >= 2 and found.isEmpty():
        found = cut(like(base, q.text, limit))
    if len(q.text) >= 3 and found.isEmpty():
        found = cut(fuzzy(base, q.text, limit))
    if not found.isEmpty():
        words = [w.lower() for w in raw.split() if len(w) >= 2]
        top = found.agg(F.max("score").alias("score"))
        place = F.row_number().over(Window.partitionBy(F.lower("name")).orderBy("id"))
        same = base.filter(F.lower("name").isin(words)).withColumn("p", place).filter("p <= 20").select("id")
        found = found.unionByName(same.join(found, "id", "left_anti").join(F.broadcast(top)).select("id", "score"))
    out = rescored(base, found, q.text or raw, limit)
    for column, filters in (("file_path", q.paths), ("name", q.names)):
        if filters:
            hit = F.lit(False)
            for f in filters:
                hit = hit | F.contains(F.lower(column), F.lit(f.lower()))
            out = out.filter(hit)
    return out.select("id", "score")


def by_substring(nodes: DataFrame, part: str, limit: int, beyond_prefix: bool = False) -> DataFrame:
    """id of rows whose name holds the part (not at its begin, if so asked), shortest names first."""
    hit = F.col("name").ilike(f"%{part}%")
    if beyond_prefix:
        hit = hit & ~F.col("name").ilike(f"{part}%")
    return nodes.filter(hit).select("id", F.length("name").alias("l")).orderBy("l", "id").limit(limit).select("id")


def by_glob(nodes: DataFrame, pattern: str) -> DataFrame:
    """Rows whose qualified name matches a pattern of * and ?."""
    regex = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
    return nodes.filter(F.col("qualified_name").rlike(f"^{regex}$"))


def find_sequence(lines: DataFrame, pattern: list[str]) -> DataFrame:
    """doc, at: where the pattern's lines first follow each other, by the strictest way of comparing that finds them.

    lines(doc, no, line). Passes: equal; without trailing white space; without
    outer white space; with typographic signs as ASCII.
    """
    plain = lambda c: F.translate(F.regexp_replace(F.trim(c), "…", "..."), "‘’‚‛“”„‟‐‑‒–—―−   ", "''''\"\"\"\"-------   ")
    passes = [lambda c: c, lambda c: F.regexp_replace(c, r"\s+$", ""), lambda c: F.regexp_replace(c, r"^\s+|\s+$", ""), plain]
    w = Window.partitionBy("doc").orderBy("no")
    out = lines
    tests = []
    for k, p in enumerate(passes):
        hit = F.lit(True)
        for i, want in enumerate(pattern):
            got = F.col("line") if i == 0 else F.lead("line", i).over(w)
            hit = hit & F.coalesce(p(got) == p(F.lit(want)), F.lit(False))
        tests.append(F.when(hit, k))
    out = out.withColumn("pass", F.coalesce(*tests)).filter(F.col("pass").isNotNull())
    return out.groupBy("doc").agg(F.min(F.struct("pass", "no")).alias("m")).select("doc", F.col("m.no").alias("at"), F.col("m.pass").alias("pass"))


def merged_filter(asked: list[str], given: list[str] | None) -> list[str] | None:
    """Values of a filter written in the query beside those given as options, each once; options alone where the query has none."""
    return list(dict.fromkeys([*(given or []), *asked])) if asked else given


def term_groups(terms: Column) -> Column:
    """array<array<string>>: terms by mutual substring, longest first; a term joins the first group whose first term holds it or lies in it."""
    by_length = lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)

    def place(groups: Column, term: Column) -> Column:
        at = F.array_position(F.transform(groups, lambda g: F.contains(g[0], term) | F.contains(term, g[0])), F.lit(True))
        joined = F.transform(groups, lambda g, i: F.when(i + 1 == at, F.concat(g, F.array(term))).otherwise(g))
        return F.when(at > 0, joined).otherwise(F.concat(groups, F.array(F.array(term))))

    return F.aggregate(F.array_sort(F.array_distinct(terms), by_length), F.array().cast("array<array<string>>"), place)


# The lines by which a patch is seen to touch imports or exports.
IMPORT_LINE = r"""\s*(?:import(?:\s|["'{*])|from\s+.+\s+import\s)"""
EXPORT_LINE = r"""\s*export(?:\s|\{|\*)"""


def patch_signals(patch: Column) -> Column:
    """array<struct<kind, change>> of the imports and exports that the added and removed lines of a patch name."""
    signal = lambda kind, change, mark, line: F.when(patch.rlike(f"(?m)^{mark}{line}"), F.struct(F.lit(kind).alias("kind"), F.lit(change).alias("change")))
    return F.array_compact(F.array(*[signal(kind, change, mark, line) for kind, line in (("import_statement", IMPORT_LINE), ("export_boundary", EXPORT_LINE.removeprefix(r"\s*"))) for change, mark in (("added", r"\+"), ("removed", "-"))]))
