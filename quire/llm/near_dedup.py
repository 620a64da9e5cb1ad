"""Near-duplicate documents by SetSketch registers, banding, joint likelihood and full verification.

A document's set holds its distinct five-word shingles (fewer words: the whole sequence as one; no words or a null text:
empty, linked with nothing). Two documents are linked if 100 * |A & B| >= 75 * |A | B|; a class is a connected component.

1. One pass sketches every document: per register the smallest hash of its shingles becomes an exponentially spaced
   register value, truncated to [0, Q + 1]. Registers merge by maximum.
2. Documents with equal sets fold to one representative per set (summed on the map side), so groups of exact copies of
   any size cost one row from here on.
3. Bands of register values put representatives into buckets; buckets of equal members fold to the one of the lowest band.
   A bucket is never expanded into its pairs: each member is compared with the bucket's hub, then links become components.
   The hub is the member whose buckets are largest together: in a group of near copies that is the text they all derive
   from, so one round links such a group whatever its size.
   Pairs that the likelihood keeps are verified on the full sets; the others are not lost, as they still meet in 4.
4. Members of buckets that still hold several components are dealt into blocks with their full sets, and those outside the
   largest component meet every block of the bucket. Intersections are counted in the block, and what leaves it is a
   spanning forest of the links between its components: as many rows as members at most, whatever the number of pairs.

Ids, bands and sketches are shuffled, the texts of bucketed documents once, and the sets of 4 once per bucket and block met. Equal doc_id values in several rows
fold into one class member each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm._core import broadcast_if_small, mixed, parts, runs, small_batches, utf8, windows, word_hashes_of_rows, written

SHINGLE = 5
#: Linked if PART * intersection >= SHARE * union.
SHARE, PART = 75, 100
BANDS, ROWS = 32, 4
#: Registers that are banded, and those that estimate similarities (drawn independently, for bucketed documents only).
REGISTERS, FINE = BANDS * ROWS, 512
#: Register k stands for minima in (b ** -k, b ** (1 - k)] / RATE and ends at q + 1: banded registers take two bytes and a
#: small base, so that equal ones mean equal minima; estimating ones take a byte.
RATE, BANDED, ESTIMATING = 20.0, (1.001, (1 << 16) - 2, "<u2"), (1.1, (1 << 8) - 2, "u1")
B = ESTIMATING[0]
#: Pairs of member and hub whose likeliest similarity is below this are not verified: 0.75 less 3.7 standard errors of 512 registers.
LIKELY = 0.68
#: Members and shingles in a block of a large bucket (a larger set stands with others all the same), members that try a block
#: at once, and marks of shingles that they have together.
BLOCK, HELD, TRIES, MARKS = 2048, 1 << 21, 64, 1 << 25
#: Pairs estimated together.
PAIRS = 1024

_SEEDS = mixed(np.arange(1, (REGISTERS + FINE) // 2 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTORS = mixed(_SEEDS) | np.uint64(1)
SKETCH_TYPE = "doc_id long, n_shingles long, set_id binary, sketch binary"


def registers(minima: np.ndarray, kind: tuple[float, int, str]) -> np.ndarray:
    """Register values of 32-bit hash minima: floor(1 - log_b of the exponential minimum), truncated to [0, q + 1]."""
    base, q, dtype = kind
    u = (minima.astype(np.float64) + 0.5) / 2.0**32
    return np.clip(np.floor(1 - np.log(-np.log1p(-u) / RATE) / np.log(base)), 0, q + 1).astype(dtype)


def set_sketches(sets: list[np.ndarray], skip: int, count: int, kind: tuple[float, int, str]) -> np.ndarray:
    """Registers skip to skip + count of non-empty sets of hashes, a row each; either half of a product serves a register."""
    minima = np.zeros((len(sets), count), np.uint32)
    if len(sets):
        h = np.concatenate(sets)
        begin = np.concatenate([[0], np.cumsum([len(s) for s in sets])])[:-1]
        for k in range(count // 2):
            halves = ((h ^ _SEEDS[skip // 2 + k]) * _FACTORS[skip // 2 + k]).view(np.uint32)
            minima[:, 2 * k] = np.minimum.reduceat(halves[1::2], begin)
            minima[:, 2 * k + 1] = np.minimum.reduceat(halves[::2], begin)
    return registers(minima, kind)


def shingles_of(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of rows that lie together in data."""
    out = []
    words, first = word_hashes_of_rows(data, at)
    for a, b in zip(first[:-1], first[1:], strict=True):
        out.append(np.unique(windows(words[a:b], SHINGLE)))
    return out


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = utf8(batch.column(1))
        counts, ids, sketches = [], [], []
        for i, j in runs(at):
            sets = shingles_of(data, at[i : j + 1])
            rows = iter(set_sketches([x for x in sets if len(x)], 0, REGISTERS, BANDED))
            for s in sets:
                counts.append(len(s))
                ids.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sketches.append(next(rows).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary()), pa.array(sketches, pa.binary())],
            names=["doc_id", "n_shingles", "set_id", "sketch"],
        )


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_id (equal for equal sets, null for empty ones) and sketch of every document."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_sketches, SKETCH_TYPE)


def likelihood(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The similarity that makes the registers' counts of greater, smaller and equal likeliest, given both set sizes."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = a.shape[1] - more - less
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    most = np.minimum(u / v, v / u)
    grid = np.linspace(0, 1, 101)[None, :] * most
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B)
    above, below = p(u - v * grid), p(v - u * grid)
    log = lambda x: np.log(np.maximum(x, 1e-300))
    score = more * log(above) + less * log(below) + same * log(1 - above - below)
    return np.take_along_axis(grid, score.argmax(1)[:, None], 1)[:, 0]


def _estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b, fine_a, fine_b, n_a, n_b) that are likely links."""
    for batch in batches:
        for k in range(0, batch.num_rows, PAIRS):
            part = batch.slice(k, PAIRS)
            x, y = (np.frombuffer(b"".join(part.column(k).to_pylist()), "u1").reshape(-1, FINE) for k in (2, 3))
            est = likelihood(x, y, *(part.column(k).to_numpy(zero_copy_only=False).astype(float) for k in (4, 5)))
            yield part.select([0, 1]).filter(pa.array(est >= LIKELY))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b, shingles_a, shingles_b) with whether their sets are linked."""
    for batch in batches:
        out = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(PART * both >= SHARE * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.bool_())], names=["a", "b", "linked"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in parts(batch, 1):
            data, at = utf8(part.column(1))
            sets = [x for i, j in runs(at) for x in shingles_of(data, at[i : j + 1])]
            fine = [row.tobytes() for x in sets for row in set_sketches([x], REGISTERS, FINE, ESTIMATING)]
            columns = [part.column(0).cast(pa.int64()), pa.array([len(x) for x in sets], pa.int64()), *(pa.array(x, pa.binary()) for x in (fine, [x.astype("<u8").tobytes() for x in sets]))]
            yield pa.RecordBatch.from_arrays(columns, names=["rep", "n", "fine", "shingles"])


def components(edges: DataFrame) -> DataFrame:
    """node, component of edges (a, b): the smallest node that each reaches, by rounds of neighbour minima with pointer jumps."""
    both = written(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select("b", "a")).distinct())
    labels = written(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("component")))
    while True:
        near = both.join(labels, both.y == labels.node).groupBy("x").agg(F.min("component").alias("near"))
        step = labels.join(near, labels.node == near.x).select("node", F.col("component").alias("old"), F.least("component", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("component").alias("far"))
        step = written(step.join(jump, "mid", "left").select("node", "old", F.least("mid", F.coalesce("far", "mid")).alias("component")))
        done = step.filter("old <> component").isEmpty()
        labels = step.select("node", "component")
        if done:
            return labels


def _with_hubs(keys: DataFrame) -> DataFrame:
    """key, rep, n, hub of the buckets (key, band, rep, n) with several members; of buckets with equal members, one.

    Only the fold of a bucket is ever gathered: its size and two checksums of its members, and its most central member.
    """
    each = F.xxhash64("rep")
    sizes = keys.groupBy("key").agg(F.count("*").alias("members"), F.sum(F.shiftright(each, 8)).alias("sum"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("xor"), F.first("band").alias("band"))
    shared = written(sizes.filter("members > 1"))
    kept = shared.groupBy("members", "sum", "xor").agg(F.min(F.struct("band", "key")).alias("first")).select("first.key", "members")
    placed = written(keys.join(kept, "key").select("key", "rep", "n", "members"))
    central = placed.groupBy("rep").agg(F.sum("members").alias("central"))
    hubs = placed.join(central, "rep").groupBy("key").agg(F.max(F.struct("central", (-F.col("rep")).alias("minus"))).alias("top"))
    return placed.join(hubs.select("key", (-F.col("top.minus")).alias("hub")), "key").select("key", "rep", "n", "hub")


def classes(docs: DataFrame, reps: DataFrame, repeated: bool) -> DataFrame:
    """node, component of the linked ones among the representatives (rep, n, sketch); docs has their texts, and
    ids in several rows if repeated."""
    band = lambda k: F.xxhash64(F.lit(k), F.expr(f"substring(sketch, {2 * ROWS * k + 1}, {2 * ROWS})"))
    keys = reps.select("rep", "n", F.posexplode(F.array(*[band(k) for k in range(BANDS)])).alias("band", "key"))
    bucketed = written(_with_hubs(keys))
    inside = written(bucketed.select("rep").distinct())
    near_ids = broadcast_if_small(inside, 16)
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text")).filter("text is not null")
    texts = texts.join(near_ids, "rep")
    if repeated:
        texts = texts.dropDuplicates(["rep"])
    sets = written(texts.mapInArrow(_sets, "rep long, n long, fine binary, shingles binary"))
    own = sets.select("rep", "n", "fine")

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*[F.col(c).alias(f"{c}_{name}") for c in df.columns])

    def verified(pairs: DataFrame) -> DataFrame:
        """(a, b, linked) of written pairs (a, b); only sets that take part are moved, and where the pairs are few, once."""
        few, ids = broadcast_if_small(pairs, 16), broadcast_if_small(pairs.select(F.col("a").alias("rep")).distinct(), 8)
        held = sets.select("rep", "shingles")
        one = side(held, "b").join(few, F.col("b") == F.col("rep_b")).select("a", "b", "shingles_b")
        two = one.join(side(held.join(ids, "rep"), "a"), F.col("a") == F.col("rep_a"))
        return two.select("a", "b", "shingles_a", "shingles_b").mapInArrow(_verified, "a long, b long, linked boolean")

    first = bucketed.filter("rep <> hub").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
    first = broadcast_if_small(written(first), 16).join(side(own, "a"), F.col("a") == F.col("rep_a")).join(side(own, "b"), F.col("b") == F.col("rep_b"))
    first = first.filter(F.least("n_a", "n_b") * PART >= F.greatest("n_a", "n_b") * SHARE)
    first = first.select("a", "b", "fine_a", "fine_b", "n_a", "n_b").mapInArrow(_estimated, "a long, b long")
    links = written(verified(written(first)).filter("linked").select("a", "b"))
    met = _met(_open(bucketed, components(links)), sets.select("rep", "shingles"))
    return components(written(links.union(met)))


def _open(bucketed: DataFrame, labels: DataFrame) -> DataFrame:
    """rep, component, places of the members of buckets that hold several components: per bucket its key, blocks and whether
    the member asks there, which those outside the bucket's largest component do."""
    placed = bucketed.select("key", "rep", "n").join(labels, bucketed.rep == labels.node, "left")
    placed = written(placed.select("key", "rep", "n", F.coalesce("component", "rep").alias("component")))
    sizes = placed.groupBy("key", "component").agg(F.count("*").alias("size"), F.sum("n").alias("total"))
    main = sizes.groupBy("key").agg(F.max(F.struct("size", "component")).alias("top"), F.count("*").alias("parts"), F.sum("size").alias("members"), F.sum("total").alias("total"))
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK, F.col("total") / HELD)).cast("int")
    rows = placed.join(main.filter("parts > 1").select("key", F.col("top.component").alias("main"), blocks.alias("blocks")), "key")
    asks = (F.col("component") != F.col("main")).alias("asks")
    return rows.groupBy("rep", "component").agg(F.collect_list(F.struct("key", "blocks", asks)).alias("places"))


def _met(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: links between components. Members are dealt into blocks, and each member that asks meets all blocks of its
    bucket once. A member's set is joined once, whatever the number of its buckets."""
    own_block = "named_struct('key', p.key, 'block', cast(pmod(xxhash64(rep), p.blocks) AS INT), 'asks', false)"
    all_blocks = "transform(sequence(0, p.blocks - 1), k -> named_struct('key', p.key, 'block', k, 'asks', true))"
    visits = f"flatten(transform(places, p -> CASE WHEN p.asks THEN concat(array({own_block}), {all_blocks}) ELSE array({own_block}) END))"
    rows = open_.join(sets, "rep").select("rep", "component", "shingles", F.expr(f"inline({visits})"))
    dealt = rows.select("key", "block", "asks", "rep", "component", "shingles").repartition("key", "block").sortWithinPartitions("key", "block", "asks")
    return dealt.mapInArrow(_meetings, "a long, b long")


class _Block:
    """The members of a block: reps, components and sets. Those that ask are compared with all of them."""

    def __init__(self, held: list[tuple[int, int, np.ndarray]]) -> None:
        reps, comps, sets = zip(*held, strict=True)
        self.reps, self.comps, self.sizes = np.array(reps), np.array(comps), np.array([len(x) for x in sets])
        self.begin = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.hashes, at = np.unique(np.concatenate(sets), return_inverse=True)
        self.at = at.astype(np.int32)
        self.merged: dict[int, int] = {}
        self.most = max(1, min(TRIES, MARKS // len(at)))

    def links(self, asking: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, int]]:
        """Links that join components which no earlier one has joined here."""
        marks = np.zeros((len(asking), len(self.hashes)), bool)
        for mark, (_, _, own) in zip(marks, asking, strict=True):
            at = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
            mark[at[self.hashes[at] == own]] = True
        out = []
        for mark, (rep, comp, own) in zip(marks, asking, strict=True):
            while comp in self.merged:
                comp = self.merged[comp]
            both = np.add.reduceat(mark[self.at], self.begin, dtype=np.int64)
            fit = np.flatnonzero((self.comps != comp) & (PART * both >= SHARE * (self.sizes + len(own) - both)))
            others, first = np.unique(self.comps[fit], return_index=True)
            out += [(min(rep, y), max(rep, y)) for y in self.reps[fit[first]].tolist()]
            for other in others.tolist():
                self.merged[other] = comp
                self.comps[self.comps == other] = comp
        return out


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted: a block's members, which are held, then those that ask, which pass by a few at a time."""
    at, held, known, asking = None, [], None, []

    def table(found: list[tuple[int, int]]) -> pa.RecordBatch:
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        found: list[tuple[int, int]] = []
        keys, blocks, asks, reps, comps = (c.to_pylist() for c in batch.columns[:5])
        for key, block, ask, rep, comp, shingles in zip(keys, blocks, asks, reps, comps, batch.column(5), strict=True):
            if at != (key, block):
                found += known.links(asking) if asking else []
                at, held, known, asking = (key, block), [], None, []
            x = rep, comp, np.frombuffer(shingles.as_py(), "<u8")
            if not ask:
                held.append(x)
            elif held:
                known = known or _Block(held)
                asking.append(x)
                if len(asking) >= known.most:
                    found += known.links(asking)
                    asking = []
        yield table(found)
    yield table(known.links(asking) if asking else [])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs(doc_id, text); kept marks one document of each class."""
    small_batches(docs.sparkSession)
    all_ = written(sketch(docs))
    reps = all_.filter("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    reps = written(reps)
    repeated = not all_.groupBy("doc_id").count().filter("count > 1").isEmpty()
    linked = classes(docs, reps.select("rep", "n", "sketch"), repeated)
    rep = reps.join(linked, reps.rep == linked.node, "left").select("set_id", F.coalesce("component", "rep").alias("component_id"))
    out = all_.select("doc_id", "n_shingles", "set_id").join(rep, "set_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
