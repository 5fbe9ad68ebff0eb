"""Table-driven parsers of whole source files: first_error(language, text)."""

from __future__ import annotations

import pickle
from functools import lru_cache, partial

from quern.llm.syntax import grammars, lexers
from quern.llm.syntax.glr import Table, recognise

#: language: (grammar, start, lexer, terminal inserted at line ends)
LANGUAGES = {
    "javascript": (grammars.JAVASCRIPT, "Program", partial(lexers.script, typed=False), "ASI"),
    "typescript": (grammars.TYPESCRIPT, "Program", partial(lexers.script, typed=True), "ASI"),
    "python": (grammars.PYTHON, "File", lexers.python, None),
    "go": (grammars.GO, "File", lexers.go, ";"),
    "rust": (grammars.RUST, "File", lexers.rust, None),
    "java": (grammars.JAVA, "File", lexers.java, None),
    "c": (grammars.C, "File", lexers.c, None),
    "xml": (grammars.XML, "Document", lexers.xml, None),
}


@lru_cache(maxsize=None)
def table(language: str) -> Table:
    grammar, start, _, _ = LANGUAGES[language]
    return Table(grammar, start)


@lru_cache(maxsize=1)
def packed() -> bytes:
    """All tables, made once for workers to load; their size is that of the bundled grammars (about 2 MB)."""
    return pickle.dumps({language: table(language) for language in LANGUAGES}, protocol=pickle.HIGHEST_PROTOCOL)


@lru_cache(maxsize=1)
def unpacked(tables: bytes) -> dict[str, Table]:
    return pickle.loads(tables)


def first_error(language: str, text: str, tables: dict[str, Table] | None = None) -> tuple[int, str] | None:
    """Line and token of the first error that no parse survives; None for a whole file of the language."""
    _, _, lexer, insert = LANGUAGES[language]
    try:
        return recognise((tables or {}).get(language) or table(language), lexer(text), insert)
    except lexers.Bad as e:
        return e.line, e.what
