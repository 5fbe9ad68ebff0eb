"""Text functions as columns; they stay in the JVM and inside code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

REDACTED = "[REDACTED]"

# Shapes of secrets and their redaction.
PRIVATE_KEY = r"(?i)-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z0-9 ]*PRIVATE KEY-----"
AUTHORIZATION = r"(?i)\b(authorization\s*[:=]\s*(?:bearer\s+)?)([^\s,;]+)"
CREDENTIAL = r"(?i)\b(api[_-]?key|client[_-]?secret|password|passwd|secret|session[_-]?token|access[_-]?token|refresh[_-]?token)\b(\s*[:=]\s*)([\"']?)([^\s,\"';]{8,})\3"
KNOWN_TOKEN = r"\b(?:sk-[A-Za-z0-9_-]{16,}|github_pat_[A-Za-z0-9_]{20,}|gh[pousr]_[A-Za-z0-9]{20,}|AKIA[A-Z0-9]{16}|xox[baprs]-[A-Za-z0-9-]{10,})\b"
_RUN = r"[A-Za-z0-9+/_=-]"
#: A run of 40 or more such characters with both cases and a digit that isn't all hexadecimal.
HIGH_ENTROPY = rf"(?<!{_RUN})(?={_RUN}{{40}})(?![A-Fa-f0-9]+(?!{_RUN}))(?={_RUN}*[a-z])(?={_RUN}*[A-Z])(?={_RUN}*[0-9]){_RUN}+"

# Words that say nothing in a query.
STOP_WORDS = frozenset(
    """the a an and or but in on at to for of with by from is it that this are was be has had have do does did will would could should may might can shall not no all each
    every how what where when who which why i me my we our you your he she they show give tell been done made used using work works found also into then than just more some such
    over only out its so up as if look need needs want happen happens affect affected break breaks failing implemented implement code file files function method class type fix bug called""".split()
)
# What a kind of symbol adds to a score.
KIND_BONUS = {
    "function": 10, "method": 10, "class": 8, "interface": 9, "type_alias": 6, "struct": 6, "trait": 9, "enum": 5, "component": 8, "route": 9, "module": 4, "property": 3, "field": 3, "variable": 2, "constant": 3,
    "import": 1, "export": 1, "parameter": 0, "namespace": 4, "file": 0, "protocol": 9, "enum_member": 3,
}
# Directories whose files aren't production code.
NON_PRODUCTION = ("integration", "sample", "samples", "example", "examples", "fixture", "fixtures", "benchmark", "benchmarks", "demo", "demos")


def _any(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded half up."""
    return F.floor(F.length(text) / 4 + 0.5)


def token_ceiling(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def redact_secrets(text: Column) -> Column:
    out = F.regexp_replace(text, PRIVATE_KEY, REDACTED)
    out = F.regexp_replace(out, AUTHORIZATION, "$1" + REDACTED)
    out = F.regexp_replace(out, CREDENTIAL, "$1$2" + REDACTED)
    out = F.regexp_replace(out, KNOWN_TOKEN, REDACTED)
    return F.regexp_replace(out, HIGH_ENTROPY, REDACTED)


def contains_secret(text: Column) -> Column:
    return _any(*[text.rlike(p) for p in (PRIVATE_KEY, AUTHORIZATION, CREDENTIAL, KNOWN_TOKEN, HIGH_ENTROPY)])


def clean_text(text: Column, most: int = 300) -> Column:
    """Control characters as spaces, white space collapsed, at most so many characters."""
    plain = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ")
    return F.substring(F.trim(F.regexp_replace(plain, r"[\s   -     　﻿]+", " ")), 1, most)


def file_hash(text: Column) -> Column:
    """SHA-256 of the text with CRLF as LF."""
    return F.sha2(F.replace(text, F.lit("\r\n"), F.lit("\n")), 256)


def supported_by(text: Column, source: Column) -> Column:
    """Whether some term of four or more characters of text occurs in source; true if there is none."""
    terms = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_-]{4,}"), F.lit(0))
    return (F.size(terms) == 0) | F.exists(terms, lambda t: F.contains(F.lower(source), t))


def head_lines(text: Column, most_lines: int, most_bytes: int) -> Column:
    """struct(kept, removed, unit): the first lines within both limits; removed counts bytes if those ran out, else lines."""
    lines = F.split(text, "\n")
    step = lambda s, line: F.when(
        s["stop"] | (s["n"] >= most_lines), F.struct(s["n"].alias("n"), s["bytes"].alias("bytes"), F.lit(True).alias("stop"), s["hit"].alias("hit"))
    ).otherwise(
        F.when(s["bytes"] + F.octet_length(line) + F.when(s["n"] > 0, 1).otherwise(0) > most_bytes, F.struct(s["n"].alias("n"), s["bytes"].alias("bytes"), F.lit(True).alias("stop"), F.lit(True).alias("hit")))
        .otherwise(F.struct((s["n"] + 1).alias("n"), (s["bytes"] + F.octet_length(line) + F.when(s["n"] > 0, 1).otherwise(0)).alias("bytes"), F.lit(False).alias("stop"), F.lit(False).alias("hit")))
    )
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("bytes"), F.lit(False).alias("stop"), F.lit(False).alias("hit"))
    end = F.aggregate(lines, zero, step)
    return F.struct(
        F.array_join(F.slice(lines, F.lit(1), end["n"]), "\n").alias("kept"),
        F.when(end["hit"], F.octet_length(text) - end["bytes"]).otherwise(F.size(lines) - end["n"]).alias("removed"),
        F.when(end["hit"], "bytes").otherwise("lines").alias("unit"),
    )


def words_of(identifier: Column) -> Column:
    """Distinct lower-case words of an identifier, of two characters or more, in order."""
    spaced = F.regexp_replace(F.regexp_replace(identifier, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.array_distinct(F.filter(F.split(F.lower(spaced), "[^a-z0-9]+"), lambda w: F.length(w) >= 2))


def search_text(name: Column, qualified: Column) -> Column:
    return F.array_join(F.array_union(words_of(name), F.coalesce(words_of(qualified), F.array().cast("array<string>"))), " ")


def stem_variants(term: Column) -> Column:
    """Other forms of a lower-case word, by its ending; of three characters or more."""
    n = F.length(term)
    cut = lambda k: F.substring(term, F.lit(1), n - k)
    ends = lambda *s: _any(*[F.endswith(term, F.lit(x)) for x in s])
    doubled = lambda base: F.when((F.length(base) >= 2) & (F.right(base, F.lit(1)) == F.substring(base, F.length(base) - 1, F.lit(1))), F.substring(base, F.lit(1), F.length(base) - 1))
    ing, er = ends("ing") & (n > 5), ends("er") & (n > 4)
    ies, es = ends("ies") & (n > 4), ends("es") & (n > 4)
    ed = ends("ed") & ~ends("eed") & (n > 4)
    forms = [
        F.when(ing, cut(3)), F.when(ing, F.concat(cut(3), F.lit("e"))), F.when(ing, doubled(cut(3))),
        F.when(ends("tion", "sion") & (n > 5), cut(3)), F.when(ends("ment") & (n > 6), cut(4)),
        F.when(ies, F.concat(cut(3), F.lit("y"))).when(es, cut(2)).when(ends("s") & ~ends("ss") & (n > 4), cut(1)),
        F.when(ed, cut(1)), F.when(ed, cut(2)), F.when(ed & ends("ied") & (n > 5), F.concat(cut(3), F.lit("y"))),
        F.when(er, cut(2)), F.when(er, F.concat(cut(2), F.lit("e"))), F.when(er, doubled(cut(2))),
    ]
    return F.array_distinct(F.filter(F.array_compact(F.array(*forms)), lambda v: (F.length(v) >= 3) & (v != term)))


def search_terms(query: Column, stems: bool = True) -> Column:
    """Distinct lower-case terms of a query: compounds and snake case whole, then their words without stop words, then other forms."""
    compounds = F.regexp_extract_all(query, F.lit(r"\b([a-zA-Z][a-zA-Z0-9]*(?:[A-Z][a-z]+)+|[A-Z][a-z]+(?:[A-Z][a-z]*)+)\b"), F.lit(1))
    snakes = F.regexp_extract_all(query, F.lit(r"\b([a-zA-Z][a-zA-Z0-9]*(?:_[a-zA-Z0-9]+)+)\b"), F.lit(1))
    spaced = F.regexp_replace(F.regexp_replace(query, "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    stop = F.array(*[F.lit(w) for w in sorted(STOP_WORDS)])
    words = F.filter(F.split(F.lower(spaced), "[^a-z0-9]+"), lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w))
    whole = F.filter(F.transform(F.concat(compounds, snakes), F.lower), lambda w: F.length(w) >= 3)
    terms = F.array_distinct(F.concat(whole, words))
    if not stems:
        return terms
    return F.array_union(terms, F.array_except(F.flatten(F.transform(terms, stem_variants)), stop))


def is_distinctive(token: Column) -> Column:
    """Whether an identifier has an underscore, a digit or a capital after its first letter."""
    return F.coalesce(token.rlike("[_0-9]|^.+[A-Z]"), F.lit(False))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def is_test_file(path: Column) -> Column:
    """By its name, by a test directory, or by a directory of samples and the like; camel-case marks keep their case."""
    low, name = F.lower(path), base_name(path)
    dirs = "|".join(NON_PRODUCTION)
    return F.coalesce(
        _any(
            F.lower(name).rlike(r"^test[_.]"), F.lower(name).rlike(r"[._-](?:test|tests|spec|specs)\.[a-z0-9]+$"), name.rlike(r"(?:Test|Tests|TestCase|Tester|Spec|Specs)\.[A-Za-z0-9]+$"),
            low.rlike(r"/(?:tests?|__tests__|specs?|testlib|testing)/|^(?:tests?|specs?)/"), path.rlike(r"(?:^|/)[A-Za-z0-9]*(?:Test|Tests|Spec)/"), low.rlike(rf"(?:^|/)(?:{dirs})/"),
        ),
        F.lit(False),
    )


def is_low_value(path: Column) -> Column:
    """Test files of the common languages, for which results are ranked lower."""
    low = F.lower(path)
    return F.coalesce(
        low.rlike(r"(?:^|/)(?:tests?|__tests?__|spec)/|_test\.(?:go|py|rb|dart)$|(?:^|/)test_[^/]+\.py$|_spec\.rb$|\.(?:test|spec)\.[jt]sx?$|(?:test|spec|tests)\.(?:java|kt|scala)$|(?:tests?|spec)\.cs$|tests?\.swift$"),
        F.lit(False),
    )


def path_relevance(path: Column, terms: list[str], test_query: bool) -> Column:
    """Points for query terms in the file name, the directory or elsewhere in the path; test files lose unless asked for."""
    if not terms:
        return F.lit(0)
    low, name, folder = F.lower(path), F.lower(base_name(path)), F.lower(dir_name(path))
    score = F.lit(0)
    for t in terms:
        score = score + F.when(F.contains(name, F.lit(t)), 10).otherwise(0) + F.when(F.contains(folder, F.lit(t)), 5).when(F.contains(low, F.lit(t)), 3).otherwise(0)
    return score if test_query else score - F.when(is_test_file(path), 15).otherwise(0)


def kind_bonus(kind: Column) -> Column:
    table = F.create_map(*[x for k, v in KIND_BONUS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(table, kind), F.lit(0))


def strip_citations(text: Column, tag: str = "memory-citation") -> Column:
    """The text without its blocks of the tag, an unclosed one included; trailing white space goes with them."""
    block = rf"(?is)<{tag}\b[^>]*>.*?(?:</{tag}\s*>|\z)"
    return F.when(text.rlike(block), F.regexp_replace(F.regexp_replace(text, block, ""), r"\s+\z", "")).otherwise(text)


def citation_entries(text: Column, tag: str = "memory-citation") -> Column:
    """array<struct<path, first, last, note>> of the lines "path:first-last | note=[...]" within blocks of the tag."""
    blocks = F.array_join(F.regexp_extract_all(text, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)(?:</{tag}\s*>|\z)"), F.lit(1)), "\n")
    entry = r"^\s*((?:global|project)/[^\r\n:]*):(\d+)-(\d+)\s*\|\s*note=\[([^\r\n]*)\]\s*$"
    found = F.filter(F.split(blocks, r"\r?\n"), lambda x: x.rlike(entry))
    part = lambda x, i: F.regexp_extract(x, entry, i)
    return F.filter(
        F.transform(found, lambda x: F.struct(part(x, 1).alias("path"), part(x, 2).cast("long").alias("first"), part(x, 3).cast("long").alias("last"), F.trim(part(x, 4)).alias("note"))),
        lambda e: (e["first"] >= 1) & (e["last"] >= e["first"]),
    )
