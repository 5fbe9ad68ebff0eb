"""Evaluation texts in training text (problem 9).

The corpus is cut into shards of whole documents; each shard gets a suffix
array over its words (prefix doubling), in which every suffix of every test
item is found by binary search: the range of corpus suffixes that begin with
its first MIN_WORDS words. Suffixes of an item that follow each other at
following places make up its longest verbatim match. Words that no test item has cannot be in a match, so shards
keep only runs of MIN_WORDS or more test words; nothing else is left out.

The test set never meets on the driver: its items are cut into words by the
executors, items of equal words are put together, and one of each is written
to the shared folder of the checkpoints, where the workers read it. The corpus
is read once: each shard's suffix array is built once and searched for the
items in blocks of at most BLOCK_WORDS words. A worker holds the test set's
distinct words, one shard and one block (all blocks up to KEPT_WORDS). Corpus
texts are not shuffled; a document's matches arise within its own shard.

Defined results: null and empty texts hold nothing; items of fewer than
MIN_WORDS words can't leak; items of equal text each get their row; a document
gives one row per item however often it holds it.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.dataset  # noqa: F401
import pyarrow.fs  # noqa: F401
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.plans.checkpoints import cut, shared_dir
from quern.plans.partitioning import spread

MIN_WORDS = 12
#: Words of test items in one block.
BLOCK_WORDS = 200_000
#: Words of test items up to which a worker keeps the blocks between shards.
KEPT_WORDS = 2_000_000
#: Words of one shard; a document is never divided.
SHARD_WORDS = 1_000_000

_ASCII = re.compile(r"[a-z0-9]+")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_FORMAT = regex.compile(r"\p{Cf}+")


def words(text: str) -> list[str]:
    """Runs of letters and digits without case, format characters and the encoding of accents."""
    if text.isascii():
        return _ASCII.findall(text.lower())
    plain = unicodedata.normalize("NFC", unicodedata.normalize("NFD", _FORMAT.sub("", text)).casefold())
    return _WORD.findall(plain)


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes in order of their first depth codes (at least), by prefix doubling."""
    n = len(codes)
    _, rank = np.unique(codes, return_inverse=True)
    rank = rank.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    width = 1
    while width < depth and n:
        after = np.zeros(n, dtype=np.int64)
        after[: max(0, n - width)] = rank[width:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        fresh = np.concatenate([[0], (ranked[1:] != ranked[:-1]).cumsum()])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = fresh
        width *= 2
        if fresh[-1] == n - 1:
            break
    return order


def _compare(text: np.ndarray, at: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """-1, 0 or 1: the text at the places against the probes, word by word; the end of the text comes first."""
    width = probes.shape[1]
    places = at[:, None] + np.arange(width)
    got = np.where(places < len(text), text[np.minimum(places, len(text) - 1)], -2)
    differ = got != probes
    first = differ.argmax(axis=1)
    rows = np.arange(len(at))
    sign = np.sign(got[rows, first] - probes[rows, first])
    return np.where(differ.any(axis=1), sign, 0)


def bounds(text: np.ndarray, order: np.ndarray, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each probe (a row of words) the range of the suffix array that begins with it, by binary search for all at once."""
    out = []
    for above in (False, True):
        lo, hi = np.zeros(len(probes), dtype=np.int64), np.full(len(probes), len(order), dtype=np.int64)
        while (active := lo < hi).any():
            rows = np.flatnonzero(active)
            mid = (lo[rows] + hi[rows]) // 2
            c = _compare(text, order[mid], probes[rows])
            right = c <= 0 if above else c < 0
            lo[rows[right]] = mid[right] + 1
            hi[rows[~right]] = mid[~right]
        out.append(lo)
    return out[0], out[1]


class Probes:
    """The test suffixes of one block: items' words as codes."""

    def __init__(self, items: list[tuple[int, list[str]]], width: int, vocabulary: dict[str, int]):
        self.width = width
        codes = [np.array([vocabulary[w] for w in said], dtype=np.int64) for _, said in items]
        many = [max(len(c) - width + 1, 0) for c in codes]
        self.items = [item for item, _ in items]
        self.rows = np.concatenate([np.lib.stride_tricks.sliding_window_view(c, width) for c, n in zip(codes, many) if n] or [np.empty((0, width), dtype=np.int64)])
        self.which = np.repeat(np.arange(len(items), dtype=np.int64), many)
        self.places = np.concatenate([np.arange(n, dtype=np.int64) for n in many] or [np.empty(0, dtype=np.int64)])


class Items:
    """The written test items as a worker reads them: their distinct words, and their suffixes block by block."""

    def __init__(self, folder: str, width: int, block_words: int):
        self.folder, self.width, self.block_words = folder, width, block_words
        self.vocabulary: dict[str, int] = {}
        total = 0
        for _, said in self._rows():
            total += len(said)
            for w in said:
                self.vocabulary.setdefault(w, len(self.vocabulary))
        self.kept = list(self._blocks()) if total <= KEPT_WORDS else None

    def _rows(self) -> Iterator[tuple[int, list[str]]]:
        system, path = pa.fs.FileSystem.from_uri(self.folder)
        for batch in pa.dataset.dataset(path, filesystem=system, format="parquet", schema=_ITEM).to_batches(batch_size=1024):
            yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())

    def _blocks(self) -> Iterator[Probes]:
        block: list[tuple[int, list[str]]] = []
        size = 0
        for item, said in self._rows():
            if block and size + len(said) > self.block_words:
                yield Probes(block, self.width, self.vocabulary)
                block, size = [], 0
            block.append((item, said))
            size += len(said)
        if block:
            yield Probes(block, self.width, self.vocabulary)

    def blocks(self) -> Iterator[Probes]:
        return iter(self.kept) if self.kept is not None else self._blocks()


@lru_cache(maxsize=1)
def read_items(folder: str, width: int, block_words: int) -> Items:
    return Items(folder, width, block_words)


class Shard:
    """The suffix array over some documents' words (codes; -1: not a test word)."""

    def __init__(self, docs: list[list[int]], width: int):
        text: list[int] = []
        owner: list[int] = []
        for doc, codes in enumerate(docs):
            start = 0
            for stop in [*(i for i, c in enumerate(codes) if c < 0), len(codes)]:
                if stop - start >= width:
                    text += codes[start:stop]
                    text.append(-1)
                    owner += [doc] * (stop - start + 1)
                start = stop + 1
        self.codes, self.owners = np.array(text, dtype=np.int64), np.array(owner, dtype=np.int64)
        self.order = suffix_array(self.codes, width) if text else self.codes

    def matches(self, probes: Probes) -> dict[tuple[int, int], int]:
        """(document's number, item): words of the longest verbatim match."""
        if not len(self.codes) or not len(probes.rows):
            return {}
        lo, hi = bounds(self.codes, self.order, probes.rows)
        hit = np.flatnonzero(hi > lo)
        # Every place of every test suffix.
        many = hi[hit] - lo[hit]
        row = np.repeat(hit, many)
        at = self.order[np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + lo[row]]
        which, shift = probes.which[row], at - probes.places[row]
        # Suffixes of an item that follow each other at following places are one verbatim match.
        by = np.lexsort((at, shift, which))
        at, which, shift = at[by], which[by], shift[by]
        fresh = np.ones(len(at), dtype=bool)
        fresh[1:] = (which[1:] != which[:-1]) | (shift[1:] != shift[:-1]) | (at[1:] != at[:-1] + 1)
        begin = np.flatnonzero(fresh)
        length = np.diff(np.append(begin, len(at))) + probes.width - 1
        found: dict[tuple[int, int], int] = {}
        for doc, n, said in zip(self.owners[at[begin]].tolist(), which[begin].tolist(), length.tolist()):
            key = (doc, probes.items[n])
            if said > found.get(key, 0):
                found[key] = said
        return found


_OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("match_words", pa.int32())])
_ITEM = pa.schema([("item_id", pa.int64()), ("words", pa.list_(pa.string()))])


def _searcher(folder: str, width: int, block_words: int, shard_words: int):
    def flush(docs: list[tuple[int, list[int]]], items: Items) -> Iterator[pa.RecordBatch]:
        shard = Shard([codes for _, codes in docs], width)
        for probes in items.blocks():
            found = shard.matches(probes)
            columns = [docs[k[0]][0] for k in found], [k[1] for k in found], list(found.values())
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OUT)], schema=_OUT)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = read_items(folder, width, block_words)
        code = items.vocabulary.get
        docs: list[tuple[int, list[int]]] = []
        size = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes = [code(w, -1) for w in words(text)]
                docs.append((doc, codes))
                size += len(codes)
                if size >= shard_words:
                    yield from flush(docs, items)
                    docs, size = [], 0
        yield from flush(docs, items)

    return go


def _said(width: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, ws) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if len(ws := words(t)) >= width]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.string()))], schema=_ITEM)

    return go


def write_items(items: DataFrame, width: int) -> tuple[str, DataFrame]:
    """(folder, members): one item of each class of equal words is written; members(item_id, class) tells whose."""
    rows = items.filter(F.col("item_text").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "item_text").distinct()
    said = rows.mapInArrow(_said(width), "item_id long, words array<string>").withColumn("key", F.sha2(F.array_join("words", " "), 256))
    said = cut(said)
    first = said.groupBy("key").agg(F.min(F.struct("item_id", "words")).alias("one")).select("key", F.col("one.item_id").alias("class"), "one.words")
    folder = f"{shared_dir(items.sparkSession)}/test-items-{uuid.uuid4().hex}"
    first.select(F.col("class").alias("item_id"), "words").write.parquet(folder)
    return folder, said.select("item_id", "key").join(first.select("key", "class"), "key").drop("key")


def leaks(docs: DataFrame, items: DataFrame, width: int = MIN_WORDS, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, item_id, match_words) of each document and item that share width or more consecutive words."""
    folder, members = write_items(items, width)
    texts = spread(docs.select("doc_id", "text").filter(F.col("text").isNotNull() & F.col("doc_id").isNotNull()))
    found = texts.mapInArrow(_searcher(folder, width, block_words, shard_words), "doc_id long, class long, match_words int")
    return found.groupBy("doc_id", "class").agg(F.max("match_words").alias("match_words")).join(members, "class").select("doc_id", "item_id", "match_words")


def clean(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs without those that hold a test passage."""
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
