"""Text functions that need a parser or a hash the JVM side lacks; Arrow batches, never rows."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

#: Elements whose content isn't text.
SKIPPED = frozenset("script style noscript iframe object embed".split())


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs) -> None:
        self.hidden += tag in SKIPPED and tag != "embed"

    def handle_endtag(self, tag) -> None:
        if tag in SKIPPED and tag != "embed" and self.hidden:
            self.hidden -= 1

    def handle_data(self, data) -> None:
        if not self.hidden:
            self.out.append(data)


def html_to_text(html: str | None) -> str | None:
    if html is None:
        return None
    parser = _Text()
    parser.feed(html)
    parser.close()
    return "".join(parser.out).strip()


@F.pandas_udf(StringType())
def html_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Text of an HTML page without scripts, styles and embedded objects."""
    for html in batches:
        yield html.map(html_to_text)


@F.pandas_udf(IntegerType())
def line_hash(numbers: pd.Series, lines: pd.Series) -> pd.Series:
    """8 bits of xxHash32 of a line; its number is the seed if it has no letter or digit."""
    import xxhash

    return pd.Series([None if s is None else xxhash.xxh32_intdigest(s.encode(), 0 if any(map(str.isalnum, s)) else int(n)) & 255 for n, s in zip(numbers, lines)], dtype="Int32")
