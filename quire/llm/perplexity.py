"""Quality rules: base word and line counts, and a perplexity band per language from a modified Kneser-Ney model.

The model is a character model of order ORDER over all code points (white space folds to one blank; nothing else is folded), counted by
Spark over all texts of the corpus, each language on its own (a null lang is the language ""). A word model would know next to
no word of a language that compounds or of invented prose. Counts, discounts and probabilities are tables that grow with the
corpus and never meet in one place: an n-gram is a pair of longs, HIGH with all but its last three code points and LOW with these.

Scoring: texts are dealt, in packed runs of rows, to buckets of about BUCKET bytes. A bucket asks for the distinct n-grams of its texts, Spark joins them with the
model, and what comes back is the bucket's part of the model: sorted arrays of hashes with log probabilities, in which its texts are
looked up. So a task holds no more of the model than its own texts use, at any size of the corpus, and nothing is broadcast.

Bands: per language, the median of the log perplexity of the documents that pass the base rules, and their median absolute
deviation; a document more than BELOW deviations under it (too predictable) is rejected, and one of whose sections
all but PLAIN lie more than ABOVE deviations over the median of such sections (too odd; passages in another language leave enough).
Deviations widen for short texts, whose perplexity scatters more. Languages with fewer than LEAST such documents share a band of all.

A null or empty text has no words and fails the base rules. Null ids are measured like others, repeated rows count as often as they
occur, a very long text is read in pieces of PIECE characters, an empty table gives an empty one, and columns besides doc_id, text
and lang, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm._core import WHITE, mixed, parts, small_batches, utf8, windows, word_hashes, written

ORDER = 4
#: Reach of a band below and above the median in robust standard deviations; added deviation for texts of few characters; least documents.
BELOW, ABOVE, SCATTER, LEAST = 4.0, 3.5, 0.9, 20
#: Characters of a section of a text, and the share of its plainest sections that may be less odd than the band.
SECTION, PLAIN = 128, 0.2
#: Bytes of text in a bucket, and of the runs of rows that go to one; characters looked at together; n-grams of a partition held before
#: they are handed on.
BUCKET, RUN, PIECE, HELD = 64 << 20, 1 << 20, 1 << 19, 1 << 21
#: Bits of a code point, and of its number among those of one piece.
POINT, LOCAL = 21, 12
_ONE = (1 << POINT) - 1
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)

Gram = tuple[np.ndarray, np.ndarray]


def points(texts: list[str]) -> np.ndarray:
    """The code points of texts, each after ORDER - 1 zeros; white space and control zeros as one blank."""
    lead = "\0" * (ORDER - 1)
    code = np.frombuffer("".join(lead + t.replace("\0", " ") for t in texts).encode("utf-32-le", "replace"), np.uint32)
    blank = (code == 32) | (code - np.uint32(9) < 5)
    code = np.where(blank, np.uint32(32), code)
    return code[~(blank & np.concatenate([[False], blank[:-1]]))]


def segments(code: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Pieces [a, b) of code with their distinct code points and each place's n-gram, packed by the points' numbers."""
    todo = [(0, len(code))]
    seen = np.zeros(0x110000, bool)
    number = np.zeros(0x110000, np.uint64)
    while todo:
        a, b = todo.pop()
        part = code[max(0, a - ORDER + 1) : b]
        seen[part] = True
        alphabet = np.flatnonzero(seen)
        seen[part] = False
        if len(alphabet) > 1 << LOCAL:
            todo += [((a + b) // 2, b), (a, (a + b) // 2)]
            continue
        number[alphabet] = np.arange(len(alphabet), dtype=np.uint64)
        local = number[part]
        n = b - a
        if len(local) < n + ORDER - 1:  # the first places have zeros before them
            local = np.concatenate([np.full(n + ORDER - 1 - len(local), number[0], np.uint64), local])
        packed = np.zeros(n, np.uint64)
        for k in range(ORDER):
            packed = packed << np.uint64(LOCAL) | local[k : k + n]
        yield a, b, alphabet, packed


def unpacked(packed: np.ndarray, alphabet: np.ndarray) -> Gram:
    """HIGH and LOW of packed n-grams."""
    at = [alphabet[(packed >> np.uint64(LOCAL * (ORDER - 1 - k)) & np.uint64((1 << LOCAL) - 1)).astype(np.int64)].astype(np.int64) for k in range(ORDER)]
    high, low = np.zeros(len(packed), np.int64), np.zeros(len(packed), np.int64)
    for k, x in enumerate(at):
        if k < ORDER - 3:
            high = high << POINT | x
        else:
            low = low << POINT | x
    return high, low


def hashed(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return mixed(mixed(high.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) ^ low.view(np.uint64))


class _Found:
    """Distinct n-grams with their counts by name, handed on when there are many."""

    def __init__(self) -> None:
        self.held: dict[tuple, list[np.ndarray]] = {}
        self.size = 0

    def add(self, name: tuple, code: np.ndarray) -> None:
        for a, b, alphabet, packed in segments(code):
            packed = np.sort(packed[code[a:b] != 0])
            first = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]])) if len(packed) else np.zeros(0, np.int64)
            n = np.diff(np.append(first, len(packed)))
            rows = np.stack([*unpacked(packed[first], alphabet), n])
            self.held.setdefault(name, []).append(rows)
            self.size += rows.shape[1]

    def fold(self) -> None:
        for name, found in self.held.items():
            if len(found) > 1:
                rows = np.concatenate(found, 1)
                _, first, at = np.unique(hashed(rows[0], rows[1]), return_index=True, return_inverse=True)
                self.held[name] = [np.stack([rows[0][first], rows[1][first], np.bincount(at, rows[2]).astype(np.int64)])]
        self.size = sum(x[0].shape[1] for x in self.held.values())

    def full(self) -> bool:
        if self.size > HELD:
            self.fold()
        return self.size > HELD // 2

    def taken(self) -> Iterator[tuple[tuple, np.ndarray]]:
        self.fold()
        yield from ((name, x[0]) for name, x in self.held.items() if x[0].shape[1])
        self.held, self.size = {}, 0


def pieces(texts: Iterator[str]) -> Iterator[list[str]]:
    """Texts in lists of about PIECE characters."""
    held, n = [], 0
    for text in texts:
        held.append(text)
        n += len(text)
        if n > PIECE:
            yield held
            held, n = [], 0
    if held:
        yield held


def _dealt(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """bucket and run, a packed batch of (lang, text, doc_id), of the rows (lang, text, doc_id, number)."""
    for batch in batches:
        for part in parts(batch, 1, RUN):
            bucket = int(mixed(part.column(3)[:1].to_numpy().view(np.uint64))[0] % np.uint64(buckets))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.select([0, 1, 2]).schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(part.select([0, 1, 2]))
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["bucket", "run"])


def _unpacked_runs(column: pa.ChunkedArray | pa.Array) -> Iterator[pa.RecordBatch]:
    for run in column:
        yield from pa.ipc.open_stream(run.as_buffer())


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As _counted, of the rows (bucket, run)."""

    def rows() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, run in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for part in pa.ipc.open_stream(run.as_buffer()):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), bucket, np.int32)), *part.columns[:2]], names=["bucket", "lang", "text"])

    return _counted(rows())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bucket, lang, high, low and n of the rows (bucket, lang, text)."""
    found = _Found()

    def out() -> Iterator[pa.RecordBatch]:
        for (bucket, lang), rows in found.taken():
            size = rows.shape[1]
            same = pa.DictionaryArray.from_arrays(pa.array(np.zeros(size, np.int8)), pa.array([lang], pa.string())).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size, bucket, np.int32)), same, *map(pa.array, rows)], names=["bucket", "lang", "high", "low", "n"])

    for batch in batches:
        for part in parts(batch, 2):
            by: dict[tuple, list[str]] = {}
            for bucket, lang, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                by.setdefault((bucket, lang), []).append(text or "")
            for name, texts in by.items():
                for some in pieces(iter(texts)):
                    found.add(name, points(some))
            if found.full():
                yield from out()
    yield from out()


_COUNTED = "bucket int, lang string, high long, low long, n long"


def _suffix(n: int) -> tuple[Column, Column]:
    """HIGH and LOW of an n-gram without its first code point."""
    if n > 3:
        return F.col("high").bitwiseAND((1 << POINT * (n - 4)) - 1), F.col("low")
    return F.col("high"), F.col("low").bitwiseAND((1 << POINT * (n - 1)) - 1)


def _context(n: int) -> tuple[Column, Column]:
    """HIGH and LOW of an n-gram without its last code point."""
    low = F.shiftright("low", POINT)
    if n > 3:
        low = F.shiftleft(F.col("high").bitwiseAND(_ONE), 2 * POINT).bitwiseOR(low)
    return F.shiftright("high", POINT), low


def kneser_ney(counts: DataFrame) -> DataFrame:
    """lang, high, low, p: interpolated modified Kneser-Ney of counts (lang, high, low, c): raw counts in the highest order, counts of
    distinct left neighbours below. An n-gram's probability is that of its last code point after the others."""
    levels = {ORDER: counts}
    for n in range(ORDER, 1, -1):
        high, low = _suffix(n)
        levels[n - 1] = written(levels[n].groupBy("lang", high.alias("high"), low.alias("low")).agg(F.count("*").alias("c")))
    lower = levels[1].groupBy("lang").agg((1 / (F.count("*") + 1)).alias("below"))
    for n in range(1, ORDER + 1):
        level = levels[n]
        often = level.groupBy("lang").agg(*(F.sum((F.col("c") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)))
        y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1.0))
        cut = lambda k, y=y: F.least(F.greatest(k - (k + 1) * y * F.col(f"n{k + 1}") / F.greatest(F.col(f"n{k}"), F.lit(1.0)), F.lit(0.1)), F.lit(k - 0.1))
        level = level.join(often.select("lang", *(cut(k).alias(f"cut{k}") for k in (1, 2, 3))), "lang")
        level = level.select("lang", "high", "low", "c", F.when(F.col("c") == 1, F.col("cut1")).when(F.col("c") == 2, F.col("cut2")).otherwise(F.col("cut3")).alias("less"))
        head, tail = _context(n)
        level = level.withColumns({"head": head, "tail": tail})
        contexts = level.groupBy("lang", "head", "tail").agg(F.sum("c").alias("total"), F.sum("less").alias("freed"))
        level = level.join(contexts, ["lang", "head", "tail"])
        if n > 1:
            high, low = _suffix(n)
            level = level.withColumns({"high_": high, "low_": low}).join(lower.select("lang", F.col("high").alias("high_"), F.col("low").alias("low_"), F.col("p").alias("below")), ["lang", "high_", "low_"])
        else:
            level = level.join(lower, "lang")
        lower = written(level.select("lang", "high", "low", ((F.col("c") - F.col("less")) / F.col("total") + F.col("freed") / F.col("total") * F.col("below")).alias("p")))
    return lower


class Store:
    """A bucket's part of the model: sorted arrays of hashes of n-grams with log probabilities, per language."""

    def __init__(self, lang: list[str], high: np.ndarray, low: np.ndarray, log_p: np.ndarray) -> None:
        langs = np.array(lang, object)
        self.of: dict[str, Gram] = {}
        for name in set(lang):
            at = np.flatnonzero(langs == name)
            keys, first = np.unique(hashed(high[at], low[at]), return_index=True)
            self.of[name] = keys, log_p[at][first]

    def look_up(self, lang: str, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        keys, values = self.of[lang]
        key = hashed(high, low)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        if not (keys[at] == key).all():
            raise RuntimeError("an n-gram of a text is not in the model of its bucket")
        return values[at]

    def log_perplexities(self, lang: str, texts: list[str]) -> np.ndarray:
        """Log perplexity per character, that of the section at PLAIN, and characters of each text, as rows."""
        return np.concatenate([np.zeros((3, 0)), *(self._of_piece(lang, some) for some in pieces(iter(texts)))], 1)

    def _of_piece(self, lang: str, texts: list[str]) -> np.ndarray:
        code = points(texts)
        real = code != 0
        owner = (np.cumsum(~real) // (ORDER - 1) - 1)[real]
        values = np.zeros(len(code))
        for a, b, alphabet, packed in segments(code):
            inside = real[a:b]
            packed = packed[inside]
            if len(packed):
                order = np.sort(packed)
                known = order[np.concatenate([[True], order[1:] != order[:-1]])]
                values[a:b][inside] = self.look_up(lang, *unpacked(known, alphabet))[np.searchsorted(known, packed)]
        values = -values[real]
        size = np.bincount(owner, minlength=len(texts))
        out = np.stack([np.bincount(owner, values, len(texts)) / np.maximum(size, 1), np.zeros(len(texts)), size])
        if len(values):
            place = np.arange(len(values)) - np.concatenate([[0], np.cumsum(size)[:-1]])[owner]
            first = np.flatnonzero(place % SECTION == 0)
            length = np.diff(np.append(first, len(values)))
            mean = np.add.reduceat(values, first) / length
            order = np.lexsort((mean, owner[first]))
            weight = np.cumsum(length[order])
            plain = np.cumsum(size) - size + np.ceil(PLAIN * size)
            out[1, size > 0] = mean[order][np.searchsorted(weight, plain[size > 0])]
        return out


def base(data: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of one text's bytes."""
    words, _ = word_hashes(data, fold=False)
    n = len(words)
    inside = data[~WHITE[data]]
    chars = int(((inside & 0xC0) != 0x80).sum())
    symbols = int(np.bincount(data, minlength=256)[_SYMBOLS].sum()) if len(data) else 0
    lines, seen, again = data.tobytes().split(b"\n"), set(), 0
    if len(lines) > 1:
        for line in lines:
            if line in seen:
                again += 1
            elif line.strip(b" \t\n\x0b\x0c\r"):
                seen.add(line)
    repeated = 0
    if n >= 3:
        w = windows(words, 3)
        order = np.argsort(w, kind="stable")
        same = w[order[1:]] == w[order[:-1]]
        if same.any():
            often = np.zeros(len(w), bool)
            often[order[1:][same]] = True
            often[order[:-1][same]] = True
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : k + len(w)] |= often
            repeated = int(covered.sum())
    return n, chars, symbols, again, repeated


NAMES = ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_perplexity", "plain_log_perplexity", "n_chars"]


def _scored(runs: pa.Table, model: pa.Table) -> pa.Table:
    texts = pa.Table.from_batches(list(_unpacked_runs(runs.column("run"))))
    store = Store(model.column("lang").to_pylist(), *(model.column(c).to_numpy() for c in ("high", "low", "log_p")))
    langs = texts.column("lang").to_pylist()
    scores = np.zeros((3, len(langs)))
    by: dict[str, list[int]] = {}
    for k, lang in enumerate(langs):
        by.setdefault(lang, []).append(k)
    for lang, at in by.items():
        for k in range(0, len(at), 1024):
            rows = at[k : k + 1024]
            scores[:, rows] = store.log_perplexities(lang, [x or "" for x in texts.column("text").take(rows).to_pylist()])
    counts = []
    for chunk in texts.column("text").chunks:
        data, at = utf8(chunk)
        counts += [base(data[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    figures = [pa.array(x, pa.int64()) for x in zip(*counts, strict=True)]
    return pa.table([texts.column("doc_id"), texts.column("lang"), *figures, *(pa.array(x, mask=scores[2] == 0) for x in scores[:2]), pa.array(scores[2].astype(np.int64))], names=NAMES)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, base columns, log perplexities (null without characters) and n_chars of every row of docs(doc_id, text, lang)."""
    spark = docs.sparkSession
    small_batches(spark)
    lang, text = F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col("text").cast("string").alias("text")
    counts = docs.select(F.lit(0).alias("bucket"), lang, text).mapInArrow(_counted, _COUNTED).groupBy("lang", "high", "low").agg(F.sum("n").alias("c"))
    model = kneser_ney(written(counts))
    buckets = -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 1) // BUCKET)
    rows = docs.select(lang, text, "doc_id", F.monotonically_increasing_id().alias("number"))
    dealt = rows.mapInArrow(lambda batches: _dealt(batches, buckets), "bucket int, run binary").repartition("bucket")
    asked = dealt.mapInArrow(_asked, _COUNTED)  # of all columns, so that both sides read one exchange
    parts_ = asked.select("bucket", "lang", "high", "low").join(model.select("lang", "high", "low", F.log("p").alias("log_p")), ["lang", "high", "low"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, lang string, " + ", ".join(f"{c} long" for c in NAMES[2:7]) + ", log_perplexity double, plain_log_perplexity double, n_chars long"
    return dealt.groupBy("bucket").cogroup(parts_.groupBy("bucket")).applyInArrow(_scored, schema)


def apply_rules(docs: DataFrame, below: float = BELOW, above: float = ABOVE) -> DataFrame:
    """doc_id, the base columns, base_failed, kept, log_perplexity and its language's band for every document."""
    rows = written(measured(docs))
    rows = rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    fit = rows.filter(~F.col("base_failed") & F.col("log_perplexity").isNotNull())
    few = fit.groupBy("lang").agg(F.count("*").alias("docs"))  # a row per language, as in what follows
    names = rows.select("lang").distinct().join(few, "lang", "left").select("lang", F.when(F.col("docs") >= LEAST, F.col("lang")).alias("band"))
    figures = {"lower": "log_perplexity", "upper": "plain_log_perplexity"}
    fit = fit.select(F.explode(F.array("lang", F.lit(None).cast("string"))).alias("band"), *figures.values())  # null: all
    median = lambda c: F.percentile_approx(c, 0.5, 10000)
    middle = fit.groupBy("band").agg(*(median(c).alias(f"{k}_middle") for k, c in figures.items()))
    same = F.col("band").eqNullSafe(F.col("of"))
    away = [(1.4826 * median(F.abs(F.col(c) - F.col(f"{k}_middle")))).alias(f"{k}_spread") for k, c in figures.items()]
    spread = fit.join(middle.withColumnRenamed("band", "of"), same).groupBy("band").agg(*(F.first(f"{k}_middle").alias(f"{k}_middle") for k in figures), *away)
    out = rows.join(names.join(spread.withColumnRenamed("band", "of"), same, "left").drop("band", "of"), "lang", "left")
    for name, reach in (("lower", -below), ("upper", above)):
        deviation = F.sqrt(F.pow(f"{name}_spread", F.lit(2)) + F.pow(F.lit(SCATTER), F.lit(2)) / F.greatest("n_chars", F.lit(1)))
        out = out.withColumn(name, F.col(f"{name}_middle") + reach * deviation)
    inside = (F.col("log_perplexity") >= F.col("lower")) & (F.col("plain_log_perplexity") <= F.col("upper"))
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity", "plain_log_perplexity", "lower", "upper"
    )
