"""Language identification by language-bitmask n-gram filters.

Learning: Spark counts letter n-grams (word edges included; 64-bit hashes, never folded) per language over all learning texts.
A language owns an n-gram that makes up at least LEAST of its n-grams and stands there at least SHARE times as often as in the
language that uses it most. The owned n-grams fill Bloom filters that are sliced by bit: one array of words, whose bit L at a place belongs
to language L, so the AND of the K places of an n-gram gives the mask of all languages that contain it. Spark sets the bits, and what
reaches the driver are the words of the filter, whose number FILTER bounds.

Prediction: each language's popcount over a text's n-grams, less the false positives that its filter's fill leads one to
expect, decides; the score is the winner's part of the corrected counts. A text without letters, and a null or empty one, is
`und` with score 0; so is every text if there is nothing to learn from. Ties go to the first language in the alphabet. Only texts
are looked at, whole and in pieces of PIECE characters, so a very long one needs no more memory than its own. A null doc_id is in the
learning part; repeated rows teach as often as they occur and get equal answers; other columns, whatever their names, are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm._core import Tally, mixed, parts, small_batches, written

ORDERS = (2, 3, 4)
#: Bits of the number of places of a filter, and hash places of an n-gram.
FILTER, K = 22, 4
#: Least part of a language's n-grams, and of the use in the language that uses it most, of an n-gram that it owns. The first leaves a
#: language at most 1 / LEAST n-grams, so the filters' fill has a bound at any size of the corpus.
LEAST, SHARE = 2e-6, 0.3
PIECE = 1 << 16
UNKNOWN = "und"
_LETTERS: list[np.ndarray] = []


def _letters(code: np.ndarray) -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.array([chr(k).isalpha() for k in range(0x110000)]))
    return _LETTERS[0][code]


def _codes(text: str) -> Iterator[np.ndarray]:
    """The code points of a text's letters in lower case, every run of other characters and either end as one 0; in pieces."""
    begun = inside = False
    for k in range(0, len(text), PIECE):
        code = np.frombuffer(text[k : k + PIECE].lower().encode("utf-32-le", "replace"), np.uint32)
        letter = _letters(code)
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[0] |= inside
        inside = bool(letter[-1])
        out = np.where(letter, code, 0)[keep]
        if len(out):
            yield out if begun else np.concatenate([np.zeros(1, np.uint32), out])
            begun = True
    if inside:
        yield np.zeros(1, np.uint32)


def grams(text: str) -> Iterator[np.ndarray]:
    """The hashes of a text's n-grams, in pieces."""
    tail = np.zeros(0, np.uint64)
    for part in _codes(text):
        code = np.concatenate([tail, part.astype(np.uint64)])
        out = []
        for n in ORDERS:
            first = max(0, len(tail) - n + 1)
            if len(code) - first >= n:
                h = np.full(len(code) - first - n + 1, n, np.uint64)
                for k in range(n):
                    h = h * np.uint64(0x100000001B3) + code[first + k : len(code) - n + 1 + k]
                out.append(mixed(h))
        if out:
            yield np.concatenate(out)
        tail = code[-(max(ORDERS) - 1) :]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally = Tally()

    def out() -> Iterator[pa.RecordBatch]:
        for lang, keys, n in tally.taken():
            yield pa.RecordBatch.from_arrays([pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(keys), np.int8)), pa.array([lang])).cast(pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    for batch in batches:
        for part in parts(batch, 1, PIECE):
            found: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                for keys in grams(text.as_py()):
                    found.setdefault(lang, []).append(keys)
                    if len(found[lang]) > 64:
                        tally.add(lang, np.concatenate(found.pop(lang)))
            for lang, keys in found.items():
                tally.add(lang, np.concatenate(keys))
            if tally.full():
                yield from out()
    yield from out()


def places(gram: np.ndarray) -> Iterator[np.ndarray]:
    for k in range(K):
        yield (mixed(gram + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) % (1 << 64))) >> np.uint64(64 - FILTER)).astype(np.int64)


@dataclass
class Filters:
    langs: list[str] = field(default_factory=list)
    #: A slice of 64 languages each: a word per place.
    slices: list[np.ndarray] = field(default_factory=list)
    false_rate: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @staticmethod
    def of(langs: list[str], words: list[tuple[np.ndarray, np.ndarray]]) -> Filters:
        """Filters of the languages, with the places and words of each slice."""
        made = Filters(list(langs), [np.zeros(1 << FILTER, np.uint64) for _ in words])
        for bits, (at, mask) in zip(made.slices, words, strict=True):
            np.bitwise_or.at(bits, at, mask)
        fill = [((made.slices[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(langs))]
        made.false_rate = np.array(fill, float) ** K
        return made

    def masks(self, gram: np.ndarray) -> list[np.ndarray]:
        """Per slice, the mask of the languages that contain each n-gram."""
        out = [np.full(len(gram), ~np.uint64(0)) for _ in self.slices]
        for at in places(gram):
            for k, bits in enumerate(self.slices):
                out[k] &= bits[at]
        return out

    def predict(self, text: str) -> tuple[str, float]:
        hits, n = np.zeros(len(self.langs), np.int64), 0
        for gram in grams(text) if self.langs else ():
            masks = self.masks(gram)
            hits += [np.count_nonzero(masks[k // 64] & np.uint64(1 << (k % 64))) for k in range(len(self.langs))]
            n += len(gram)
        if not n:
            return UNKNOWN, 0.0
        part = np.clip((hits / n - self.false_rate) / np.maximum(1 - self.false_rate, 1e-9), 0, 1)
        best = int(part.argmax())
        return self.langs[best], float(part[best] / part.sum()) if part.sum() > 0 else 0.0


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """place, slice and mask of every place of the owned n-grams (gram, number of the language)."""
    for batch in batches:
        gram, number = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy().astype(np.int64)
        for at in places(gram):
            mask = np.uint64(1) << (number % 64).astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(number // 64), pa.array(mask.view(np.int64))], names=["place", "slice", "mask"])


def learn(docs: DataFrame) -> Filters:
    """Filters from docs(text, lang); rows with a null or empty text or a null lang teach nothing."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter("lang is not null and length(text) > 0")
    counted = written(rows.mapInArrow(_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    totals = sorted((r.lang, r.total) for r in counted.groupBy("lang").agg(F.sum("n").alias("total")).collect())  # a row per language
    if not totals:
        return Filters()
    numbered = F.broadcast(spark.createDataFrame([(x, k, n) for k, (x, n) in enumerate(totals)], "lang string, number long, total long"))
    shares = counted.join(numbered, "lang").withColumn("share", F.col("n") / F.col("total")).filter(F.col("share") >= LEAST)
    by_gram = shares.groupBy("gram").agg(F.collect_list(F.struct("number", "share")).alias("s"))  # an entry per language
    owners = by_gram.select("gram", F.explode(F.filter("s", lambda x: x["share"] >= SHARE * F.array_max(F.transform("s", lambda y: y["share"])))).alias("s")).select("gram", "s.number")
    words = owners.mapInArrow(_bits, "place long, slice long, mask long").groupBy("slice", "place").agg(F.bit_or("mask").alias("mask")).toArrow()
    columns = [words.column(c).to_numpy() for c in ("slice", "place", "mask")]
    held = [(columns[1][columns[0] == k], columns[2][columns[0] == k].view(np.uint64)) for k in range(-(-len(totals) // 64))]
    return Filters.of([x for x, _ in totals], held)


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, lang_pred and score of every row of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            found = [held.predict(x.as_py() or "") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(of, f"doc_id {kind}, lang_pred string, score double")


def classify(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred and score of all documents, learned from those whose fold is not the held one."""
    fold = lambda: F.crc32(F.col("doc_id").cast("string")) % folds
    out = identify(docs, learn(docs.filter(F.coalesce(fold() != held, F.lit(True)))))
    return out.select("doc_id", F.coalesce(fold() == held, F.lit(False)).alias("held_out"), "lang_pred", "score")
