"""Encoding of the corpus with a byte-level BPE vocabulary (problem 8).

Each partition's texts are cut into words by the vocabulary's pattern; words
that the worker hasn't met are encoded together by one recursive DuckDB query:
rows of (word, position, token) join the merge table, every word contracts the
leftmost places of its pair of least rank, until no pair of any word is in the
table; an ordered aggregation gives each word's ids. All places of the least
pair that don't overlap are contracted in one round, which gives the same ids,
for a merge can't create a pair of lesser rank. The query keeps one row per
place, that of the last round. Texts are not shuffled.

Words of any length: where no entry of the vocabulary that occurs in a word
reaches across a place, no merge ever does. Long words (runs without spaces,
encoded blobs) are cut at all such places, found by one pass of an automaton
of the vocabulary, and the pieces are encoded as words are.

Defined results: null and empty texts have an empty list; strings of special
tokens in a text are ordinary text; repeated documents each get their row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quern.plans.partitioning import spread

#: Where the public vocabularies lie, and the one that is used.
TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.json"
#: Words a worker remembers before it begins anew; bounds memory, not results.
REMEMBERED = 1_000_000
#: Characters from which on a word is cut into pieces; the ids are the same.
LONG = 64
#: Bytes of the words that one query encodes.
BLOCK_BYTES = 400_000

# The pattern by which byte-level BPE texts are cut into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Pairs of two different tokens can't overlap: a place of the least pair is contracted, the one after it goes (token -1).
#: Of overlapping places of a pair of equal tokens every second one of a run is contracted; words with such a pair go their own way.
_CONTRACT = """
WITH RECURSIVE state(word, pos, tok) USING KEY (word, pos) AS (
  SELECT word, pos, tok FROM letters
  UNION ALL (
    WITH pairs AS MATERIALIZED (
      SELECT p.word, p.pos, p.tok, m.rnk, m.made, m.a = m.b AS twin, l.rnk AS before, min(m.rnk) OVER (PARTITION BY p.word) AS best
      FROM (SELECT word, pos, tok, lead(tok) OVER w AS nxt, lag(tok) OVER w AS prv FROM state WHERE tok >= 0 WINDOW w AS (PARTITION BY word ORDER BY pos)) p
      LEFT JOIN merges m ON m.a = p.tok AND m.b = p.nxt
      LEFT JOIN merges l ON l.a = p.prv AND l.b = p.tok),
    twins AS (SELECT DISTINCT word FROM pairs WHERE rnk = best AND twin)
    SELECT word, pos, CASE WHEN before = best THEN -1 WHEN rnk = best THEN made ELSE tok END
    FROM pairs WHERE best IS NOT NULL AND word NOT IN (FROM twins)
    UNION ALL
    SELECT word, pos, CASE WHEN eaten THEN -1 WHEN taken THEN made ELSE tok END
    FROM (
      SELECT *, coalesce(lag(taken) OVER (PARTITION BY word ORDER BY pos), false) AS eaten
      FROM (
        SELECT *, hit AND (place - min(place) FILTER (hit) OVER (PARTITION BY word, run)) % 2 = 0 AS taken
        FROM (
          SELECT *, coalesce(rnk = best, false) AS hit, row_number() OVER (PARTITION BY word ORDER BY pos) AS place,
                 sum(CASE WHEN rnk = best THEN 0 ELSE 1 END) OVER (PARTITION BY word ORDER BY pos) AS run
          FROM pairs WHERE word IN (FROM twins)
        )
      )
    )
  )
)
SELECT word, list(tok ORDER BY pos) AS ids FROM state WHERE tok >= 0 GROUP BY word
"""


def _byte_letters() -> dict[str, int]:
    """The letter by which the vocabulary file writes each byte: printable ones stand for themselves, the others follow from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """A worker's DuckDB connection with the merge table, and the words it has met."""

    def __init__(self, path: str):
        import duckdb
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary: dict[str, int] = model["vocab"]
        self.letters = str.maketrans({chr(byte): letter for letter, byte in _byte_letters().items()})
        self.of_letter = {letter: vocabulary[letter] for letter in _byte_letters()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.entries = [a + b for a, b in pairs]
        table = pa.table({
            "a": pa.array([vocabulary[a] for a, _ in pairs], pa.int32()), "b": pa.array([vocabulary[b] for _, b in pairs], pa.int32()),
            "rnk": pa.array(range(len(pairs)), pa.int32()), "made": pa.array([vocabulary[x] for x in self.entries], pa.int32()),
        })
        self.cut = regex.compile(PATTERN).findall
        # Nothing is written to the machine's disk: blocks are bounded by bytes.
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "700MB", "temp_directory": ""})
        self.db.register("given", table)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM given")
        self.known: dict[str, list[int]] = {}

    @cached_property
    def automaton(self):
        import ahocorasick

        made = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for entry in self.entries:
            made.add_word(entry)
        made.make_automaton()
        return made

    def spell(self, word: str) -> str:
        """The word's bytes as the vocabulary writes them."""
        return word.encode("utf-8").decode("latin-1").translate(self.letters)

    def pieces(self, spelled: str) -> list[str]:
        """The spelled word cut wherever no entry that occurs in it reaches across."""
        reach = np.zeros(len(spelled) + 2, dtype=np.int64)
        for end, size in self.automaton.iter(spelled):
            reach[end - size + 2] += 1
            reach[end + 1] -= 1
        places = np.flatnonzero(np.cumsum(reach)[1 : len(spelled)] == 0) + 1
        return [spelled[i:j] for i, j in zip([0, *places.tolist()], [*places.tolist(), len(spelled)])]

    def learn(self, words: list[str]) -> dict[str, list[int]]:
        """ids of spelled words by the recursive query."""
        sizes = [len(w) for w in words]
        letters = pa.table({
            "word": pa.array(np.repeat(np.arange(len(words), dtype=np.int32), sizes)), "pos": pa.array(np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])),
            "tok": pa.array([self.of_letter[x] for w in words for x in w], pa.int32()),
        })
        self.db.register("letters", letters)
        found = {words[i]: ids for i, ids in self.db.execute(_CONTRACT).fetchall()}
        self.db.unregister("letters")
        return found

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        cut = [self.cut(t) if t else [] for t in texts]
        known = self.known
        # Long words are never remembered: they hardly come back, and few would fill the memory.
        apart = {w: self.pieces(self.spell(w)) for ws in cut for w in ws if len(w) > LONG}
        new = dict.fromkeys(self.spell(w) for w in dict.fromkeys(w for ws in cut for w in ws if len(w) <= LONG and w not in known))
        new |= dict.fromkeys(p for ps in apart.values() for p in ps)
        learnt: dict[str, list[int]] = {}
        block: list[str] = []
        size = 0
        # Blocks by bytes, so that the query's rows stay few however many or long the words are.
        for w in new:
            block.append(w)
            size += len(w)
            if size > BLOCK_BYTES:
                learnt |= self.learn(block)
                block, size = [], 0
        if block:
            learnt |= self.learn(block)
        here = {w: [i for p in ps for i in learnt[p]] for w, ps in apart.items()}
        here |= {w: known[w] if w in known else learnt[self.spell(w)] for w in {w for ws in cut for w in ws if len(w) <= LONG}}
        if len(known) + len(here) > REMEMBERED:
            known.clear()
        known.update((w, ids) for w, ids in here.items() if len(w) <= LONG)
        return [[i for w in ws for i in here[w]] for ws in cut]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most that many bytes of text, or of one row."""
    begin = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()):
        if size and size + n > most:
            yield batch.slice(begin, i - begin)
            begin, size = i, 0
        size += n
    yield batch.slice(begin)


def _encoding(path: str, most: int = 4_000_000):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = encoder(path)
        for whole in batches:
            for batch in _slices(whole, most):
                ids = worker.encode(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return go


def encode(docs: DataFrame, path: str = f"{TOKENIZER_DIR}/{VOCABULARY}") -> DataFrame:
    """(doc_id, ids) of docs(doc_id, text)."""
    return spread(docs.select("doc_id", "text")).mapInArrow(_encoding(path), "doc_id long, ids array<int>")
