"""Byte-pair encoding and decoding as bounded-lookahead transducers.

The merge list fixes a sufficient lookahead: whether a token ends at a place can depend only on so many bytes after it. Let
R(t) be the bytes after a formed token t that can still keep it from being formed. For t = u + v by a merge of rank r,
R(t) = max(R(u) - |v|, R(v), max over merges (v, c) of a rank below r of |c| + R(c)): a later merge can only steal v if it
comes first, and then c was formed before it, so ranks fall and one pass in the order of the ranks computes R. A token of the
final text can also be lost to any merge (t, c), so the lookahead is the largest of |c| + R(c) over all merges and of R.
Tokens that end at least that many bytes before the end of the buffer are stable: they are emitted and leave the buffer, and
as a token boundary parts the merges on its two sides, what stays is encoded on its own. Memory is one buffer.

Encoding: the text is parted at added tokens, then by the vocabulary's pattern into words; known words come from a bounded
memory of results, others pass the transducer. Decoding turns ids to bytes and bytes to text by an incremental UTF-8 state
machine that needs no more than the bytes of one character. Null texts are read as empty: no tokens, empty decoded text.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm._core import runs, small_batches, utf8

#: Bytes in the transducer's buffer besides the lookahead, characters of text looked at together, and words remembered.
BUFFER, WINDOW, REMEMBERED = 1 << 12, 1 << 16, 1 << 17
#: Bytes of a word that is merged without a heap or a buffer.
SHORT = 48
_SPACE = r"\t-\r \x85\xa0  -     　"
# The vocabulary's pattern for words, with Unicode white space spelt out, and its printable stand-ins of bytes.
_WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
_PRINTABLE = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]


class Codec:
    """The encoder and decoder of a byte-level vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        stand_in = {chr(b): b for b in _PRINTABLE} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(_PRINTABLE))}
        raw = lambda token: bytes(stand_in[c] for c in token)
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        vocabulary = {t: i for t, i in spec["model"]["vocab"].items() if t not in self.added}
        self.ids = {raw(t): i for t, i in vocabulary.items()}
        self.bytes = {str(i): t for t, i in self.ids.items()} | {str(i): t.encode() for t, i in self.added.items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.ranks = {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}
        # for short words: the rank of a pair of ids, what each rank makes, and the ids of single bytes
        self.size = max(self.ids.values(), default=0) + 1
        self.rank_of = {self.ids[a] * self.size + self.ids[b]: k for (a, b), k in self.ranks.items()}
        self.made = [self.ids[a + b] for a, b in self.ranks]
        self.of_byte = [self.ids.get(bytes([k]), -1) for k in range(256)]
        self.prefix = bool((spec.get("pre_tokenizer") or {}).get("add_prefix_space"))
        self.words = regex.compile(_WORDS)
        self.parts = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.cut = regex.compile(rf"[^{_SPACE}](?=[{_SPACE}])")
        self.known = _Known(self)

    @cached_property
    def lookahead(self) -> int:
        """Bytes after a place that decide whether a token ends there."""
        reach: dict[bytes, int] = {}
        after: dict[bytes, int] = {}  # by left part: most bytes that a merge of a lower rank with it needs
        for u, v in self.ranks:
            need = max(reach.get(u, 0) - len(v), reach.get(v, 0), after.get(v, 0))
            after[u] = max(after.get(u, 0), len(v) + reach.get(v, 0))
            reach[u + v] = max(reach.get(u + v, 0), need)
        return max([0, *reach.values(), *after.values()])

    def merged(self, data: bytes) -> list[bytes]:
        """The tokens of data: the leftmost merge of the lowest rank first, by a heap over a linked list."""
        n = len(data)
        parts: list[bytes | None] = [data[k : k + 1] for k in range(n)]
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []
        ranks = self.ranks
        for k in range(n - 1):
            if (r := ranks.get((parts[k], parts[k + 1]))) is not None:
                heap.append((r, k, parts[k], parts[k + 1]))
        heapq.heapify(heap)
        while heap:
            _, k, left, right = heapq.heappop(heap)
            if parts[k] != left or (j := after[k]) >= n or parts[j] != right:
                continue
            parts[k], parts[j] = left + right, None
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
                if (r := ranks.get((parts[k], parts[after[k]]))) is not None:
                    heapq.heappush(heap, (r, k, parts[k], parts[after[k]]))
            if (i := before[k]) >= 0 and (r := ranks.get((parts[i], parts[k]))) is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[k]))
        return [p for p in parts if p is not None]

    def merged_short(self, data: bytes) -> list[int]:
        """The ids of data as merged() gives them, by looking for the leftmost lowest rank each time; for short data."""
        ids, size, rank_of, none = [self.of_byte[k] for k in data], self.size, self.rank_of, len(self.made)
        ranks = [rank_of.get(a * size + b, none) for a, b in zip(ids, ids[1:])]  # noqa: B905
        while ranks:
            low = min(ranks)
            if low == none:
                break
            k = ranks.index(low)
            ids[k : k + 2] = [self.made[low]]
            del ranks[k]
            if k < len(ranks):
                ranks[k] = rank_of.get(ids[k] * size + ids[k + 1], none)
            if k:
                ranks[k - 1] = rank_of.get(ids[k - 1] * size + ids[k], none)
        return ids

    def stream(self, chunks: Iterable[bytes]) -> Iterator[bytes]:
        """Tokens of one word that comes in chunks, each as soon as it is stable."""
        buffer = b""
        for chunk in chunks:
            buffer += chunk
            if len(buffer) > BUFFER + self.lookahead:
                end, stable = 0, len(buffer) - self.lookahead
                for token in self.merged(buffer):
                    if end + len(token) > stable:
                        break
                    end += len(token)
                    yield token
                buffer = buffer[end:]
        yield from self.merged(buffer)

    def word(self, word: str) -> str:
        """The ids of a word, joined by commas."""
        data = word.encode("utf-8", "surrogatepass")
        if len(data) <= SHORT:
            return ",".join(map(str, self.merged_short(data)))
        return ",".join(str(self.ids[t]) for t in self.stream(data[k : k + BUFFER] for k in range(0, len(data), BUFFER)))

    def windows(self, text: str) -> Iterator[str]:
        """Pieces of text that end where no word can go on: after a character before white space."""
        pos, n = 0, len(text)
        while n - pos > WINDOW:
            found = self.cut.search(text, pos + WINDOW - 1)
            end = found.end() if found else n
            yield text[pos:end]
            pos = end
        if pos < n:
            yield text[pos:]

    def encode(self, text: str) -> Iterator[str]:
        """The ids of text, joined by commas, in pieces."""
        look = self.known.__getitem__
        for part in self.parts.split(text) if self.parts else [text]:
            if part in self.added:
                yield str(self.added[part])
                continue
            if self.prefix and part and not part[0].isspace():
                part = " " + part
            for piece in self.windows(part):
                yield ",".join(map(look, self.words.findall(piece)))
                if len(self.known) > REMEMBERED // 2:
                    self.known.age()

    def decode(self, pieces: Iterable[str]) -> Iterator[str]:
        """The text of pieces of ids, as bytes become characters."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        of = self.bytes.__getitem__
        for piece in pieces:
            yield machine.decode(b"".join(map(of, piece.split(","))))
        yield machine.decode(b"", True)


class _Known(dict):
    """Ids of words met lately, in two ages, so that frequent words stay when it is full; words of more than a few hundred
    characters are not kept."""

    def __init__(self, codec: Codec) -> None:
        super().__init__()
        self.codec = codec
        self.older: dict[str, str] = {}

    def age(self) -> None:
        self.older = dict(self)
        self.clear()

    def __missing__(self, word: str) -> str:
        ids = self.older.get(word) or self.codec.word(word)
        if len(word) <= 256:
            self[word] = ids
        return ids


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per vocabulary file and process."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs with token_ids (array of int) added after its columns, in the place of a column of that name."""
    small_batches(docs.sparkSession)
    docs = docs.drop("token_ids")
    where = docs.columns.index("text")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(path)
        for batch in batches:
            _, at = utf8(batch.column(where))
            for i, j in runs(at):
                part = batch.slice(i, j - i)
                rows = [[np.array(piece.split(","), np.int32) for piece in made.encode(t.as_py() or "") if piece] for t in part.column(where)]
                ends = np.cumsum([0, *(sum(map(len, row)) for row in rows)])
                ids = np.concatenate([np.zeros(0, np.int32), *(piece for row in rows for piece in row)])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))], names=[*batch.schema.names, "token_ids"])

    return docs.mapInArrow(encoded, T.StructType([*docs.schema.fields, T.StructField("token_ids", T.ArrayType(T.IntegerType()))]))


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """tokens with the column decoded, the text of its token_ids; null for null."""
    small_batches(tokens.sparkSession)
    tokens = tokens.drop("decoded")

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(path)
        for batch in batches:
            rows = []
            for ids in batch.column("token_ids"):
                x = None if not ids.is_valid else ids.values.to_numpy()
                rows.append(None if x is None else "".join(made.decode(",".join(map(str, x[k : k + WINDOW].tolist())) for k in range(0, len(x), WINDOW))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.string())], names=[*batch.schema.names, "decoded"])

    return tokens.mapInArrow(decoded, T.StructType([*tokens.schema.fields, T.StructField("decoded", T.StringType())]))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document, encoded and decoded in one pass of bounded memory."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(path)
        for batch in batches:
            counts, ids, texts = [], [], []
            for text in pc.fill_null(batch.column(1), ""):
                seen, back, n = hashlib.sha256(), hashlib.sha256(), 0

                def pieces(text: str = text.as_py(), seen: object = seen) -> Iterator[str]:
                    nonlocal n
                    for piece in made.encode(text):
                        if piece:
                            seen.update((("," if n else "") + piece).encode())
                            n += piece.count(",") + 1
                            yield piece

                for piece in made.decode(pieces()):
                    back.update(piece.encode("utf-8"))
                counts.append(n)
                ids.append(seen.hexdigest())
                texts.append(back.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids), pa.array(texts)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(digested, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
