"""Benchmark decontamination: pigeonhole pieces, exact piece hits, Myers bit-parallel verification.

Texts and items are compared as word sequences (lower case, every ASCII character but letters and digits parts words). An
item of m words may differ from a passage by k = floor(RATE * m) word edits. It is split into k + 1 pieces; of a passage
within k edits at least one piece stands there unchanged, so exact piece hits find every candidate. Each candidate is
verified by the bit-parallel edit distance of the whole item against the words around the hit.

The benchmark is cut into blocks of at most BLOCK_BYTES of text; each block is indexed on its own and meets every document,
so what is broadcast is bounded whatever the benchmark's size. Documents are never shuffled. Items without words match
nothing; null texts and null items count as empty; repeated rows and null ids are reported each. Of several places of an item
in a document the one with the fewest edits is told, the first found among equals. Empty tables give no rows; other columns,
whatever their names, are not looked at by find() and are passed on by clean(). A very long text is read in pieces of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm._core import PUNCTUATION, runs, small_batches, utf8, windows, word_hashes, word_hashes_of_rows

#: Word edits allowed per word of an item, and most bytes of items in an index.
RATE = 0.15
BLOCK_BYTES = 4 << 20
_BITS = 20


def distance(masks: dict[int, int], m: int, text: list[int]) -> tuple[int, int]:
    """The least edit distance of a pattern to any part of text, and the end of that part, by Myers' bit vectors.

    masks gives for each symbol the places in the pattern as bits.
    """
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = full, 0, m, m, 0
    for k, symbol in enumerate(text):
        equal = masks.get(symbol, 0)
        cross = equal | minus
        equal |= (((equal & plus) + plus) ^ plus) & full
        up = minus | (~(equal | plus) & full)
        down = plus & equal
        score += 1 if up & high else -1 if down & high else 0
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (~(cross | up) & full), up & cross
        if score < best:
            best, end = score, k + 1
    return best, end


@dataclass
class Index:
    """Pieces of a block of items by length: sorted hashes, and for each the item and the piece's place in it."""

    items: list[tuple[int, np.ndarray, int]] = field(default_factory=list)
    pieces: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)
    masks: dict[int, dict[int, int]] = field(default_factory=dict)

    @staticmethod
    def of(rows: list[tuple[int, str | None]], rate: float = RATE) -> Index:
        index, by_size = Index(), {}
        folded = pc.utf8_lower(pa.array([text or "" for _, text in rows], pa.string()))  # as the documents are
        for (item, _), text in zip(rows, folded, strict=True):
            words, _ = word_hashes(np.frombuffer(text.as_buffer(), np.uint8), PUNCTUATION)
            m = len(words)
            if m:
                budget = int(rate * m)
                cuts = np.linspace(0, m, min(budget + 1, m) + 1).astype(int)
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    by_size.setdefault(int(b - a), []).append((int(windows(words[a:b], int(b - a))[0]), len(index.items), int(a)))
                index.items.append((item, words, budget))
        for size, found in by_size.items():
            found.sort()
            index.pieces[size] = tuple(np.array(x, t) for x, t in zip(zip(*found, strict=True), (np.uint64, np.int64, np.int64), strict=True))
        return index

    def hits(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Row, item's place in the index, distance and first word of the verified passages, the best of each row and item.

        words holds the words of several rows; first tells where each begins.
        """
        found: dict[tuple[int, int], tuple[int, int]] = {}
        seen: dict[tuple[int, int], set[int]] = {}
        for size, (hashes, items, places) in self.pieces.items():
            if len(words) < size:
                continue
            w = windows(words, size)
            maybe = np.zeros(1 << _BITS, bool)
            maybe[hashes >> np.uint64(64 - _BITS)] = True
            at = np.flatnonzero(maybe[w >> np.uint64(64 - _BITS)])
            low, high = np.searchsorted(hashes, w[at], "left"), np.searchsorted(hashes, w[at], "right")
            at, low, high = at[high > low], low[high > low], high[high > low]
            rows = np.searchsorted(first, at, "right") - 1
            for p, row, a, b in zip(at.tolist(), rows.tolist(), low.tolist(), high.tolist(), strict=True):
                start, stop = int(first[row]), int(first[row + 1])
                if p + size > stop:
                    continue
                for k in range(a, b):
                    self._verify(row, int(items[k]), p - int(places[k]), words, start, stop, found, seen)
        for (row, k), (far, begin) in found.items():
            yield row, k, far, begin

    def _verify(self, row: int, k: int, begin: int, words: np.ndarray, start: int, stop: int, found: dict, seen: dict) -> None:
        _, pattern, budget = self.items[k]
        diagonals = seen.setdefault((row, k), set())
        if found.get((row, k), (1, 0))[0] == 0 or begin in diagonals:
            return
        diagonals.add(begin)
        if k not in self.masks:
            masks: dict[int, int] = {}
            for place, word in enumerate(pattern.tolist()):
                masks[word] = masks.get(word, 0) | 1 << place
            self.masks[k] = masks
        a = max(start, begin - budget)
        far, _ = distance(self.masks[k], len(pattern), words[a : min(stop, begin + len(pattern) + budget)].tolist())
        if far <= budget and far < found.get((row, k), (budget + 1, 0))[0]:
            found[row, k] = far, max(0, begin - start)


def blocks(benchmark: DataFrame, rate: float = RATE) -> Iterator[Index]:
    """Indexes over benchmark(item_id, text), each of a bounded number of bytes."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = -(-size // (BLOCK_BYTES // 2)) or 1
    for k in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield Index.of([tuple(r) for r in part.collect()], rate)


def _matches(index: Index, column: pa.Array) -> Iterator[tuple[int, int, int, int]]:
    """Row of the column, item's place, distance and first word."""
    data, at = utf8(pc.utf8_lower(column))
    for i, j in runs(at):
        words, first = word_hashes_of_rows(data, at[i : j + 1], PUNCTUATION)
        for row, k, far, begin in index.hits(words, first):
            yield i + row, k, far, begin


def find(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, item_id, edits and first_word: each document and item whose words stand in it within the item's budget."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows, out = docs.select("doc_id", F.col("text").cast("string")), None
    for index in blocks(benchmark, rate):

        def found(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = sorted(_matches(index, batch.column(1)))
                ids = batch.column(0).take(pa.array([h[0] for h in hits], pa.int64()))
                rest = [[index.items[h[1]][0] for h in hits], [h[2] for h in hits], [h[3] for h in hits]]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in rest)], names=["doc_id", "item_id", "edits", "first_word"])

        part = rows.mapInArrow(found, f"doc_id {kind}, item_id long, edits long, first_word long")
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of docs that hold no item, with all their columns; one pass per block, no shuffle."""
    small_batches(docs.sparkSession)
    where = docs.columns.index("text")
    for index in blocks(benchmark, rate):

        def kept(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                mask = np.ones(batch.num_rows, bool)
                mask[[h[0] for h in _matches(index, batch.column(where))]] = False
                yield batch.filter(pa.array(mask))

        docs = docs.mapInArrow(kept, docs.schema)
    return docs
