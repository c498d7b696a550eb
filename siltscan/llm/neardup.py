"""MinHash near-duplicate groups through a multi-index Hamming join.

A document's words (lower case, runs of letters and digits; characters of scripts without spaces one by one) give
word-pair shingles, ``SYMBOLS`` min-hashes and from each, mixed with a salt of its own, 16 bits: a signature of
``SYMBOLS`` 16-bit symbols, whose expected share of equal symbols is the shingles' Jaccard similarity. Unmixed low bits
would depend on the low bits of the shingle only, and unrelated texts of few shingles would get equal signatures. With 16
bits the narrowest key has 48, so unrelated signatures hardly ever share one, however many there are. Two documents are near duplicates when their signatures differ in at most ``RADIUS``
symbols; a group is a connected component of that relation.

The join is exact. The symbols are split into chunks, chunk i tolerating e_i errors with sum(e_i + 1) > RADIUS, so by
the pigeonhole principle any two signatures within the radius agree on some chunk but for e_i symbols. Those errors are
enumerated: a chunk gives one key for every way to leave e_i of its symbols out. Equal signatures are collapsed
first, so copies cost one row however many there are; keys that only one signature has are dropped before any
signature is shipped; and in a bucket of many signatures only pairs that can still join two groups are compared
(``bucket_edges``), so a bucket of thousands of copies costs time in proportion, and no pair is left out by a cap.

Null, empty and wordless texts have no signature and are in no group, nor are rows with a null id. Rows with the same
id are one document. A group is named by its smallest id, which is the one to keep.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltscan.llm._common import cut, kept_columns, slices

SYMBOLS, RADIUS, SEED = 96, 40, 20240607
WORD = re.compile(r"\w+")
#: Scripts written without spaces, whose characters are words of their own.
UNSPACED = "[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]"
ANY_UNSPACED = re.compile(UNSPACED)
WORD_OR_SIGN = re.compile(f"{UNSPACED}|(?:(?!{UNSPACED})\\w)+")
BLOCK = 2_048
#: The symbols of the operators' signatures.
BYTE, SYMBOL = np.dtype("u1"), np.dtype("<u2")
#: Up to this many signatures of a bucket are compared pair by pair.
FEW = 12


class MinHash:
    def __init__(self, symbols: int = SYMBOLS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 32, symbols, dtype=np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, symbols, dtype=np.uint32)
        self.salt = rng.integers(0, 1 << 32, symbols, dtype=np.uint32) | np.uint32(1)

    @staticmethod
    def shingles(text: str) -> np.ndarray:
        """32-bit hashes of the pairs of neighbouring words; of the word, if there is one only."""
        low = text.lower()
        words = (WORD_OR_SIGN if not low.isascii() and ANY_UNSPACED.search(low) else WORD).findall(low)
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
        if len(h) > 1:
            h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + (h[1:] ^ (h[1:] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
        return ((h * np.uint64(0x94D049BB133111EB)) >> np.uint64(32)).astype(np.uint32)

    def minima(self, text: str | None) -> np.ndarray | None:
        s = self.shingles(text) if text else ()
        if not len(s):
            return None
        low = np.full(len(self.a), 0xFFFFFFFF, dtype=np.uint32)
        for i in range(0, len(s), BLOCK):
            np.minimum(low, (s[i : i + BLOCK, None] * self.a + self.b).min(axis=0), out=low)
        return low

    def signature(self, text: str | None) -> bytes | None:
        """The lowest 8 bits of each minimum, unmixed."""
        low = self.minima(text)
        return None if low is None else (low & np.uint32(0xFF)).astype(np.uint8).tobytes()

    def mixed(self, text: str | None) -> bytes | None:
        """8 bits of each minimum that depend on all of its bits."""
        low = self.minima(text)
        return None if low is None else (self._mix(low) >> np.uint32(24)).astype(np.uint8).tobytes()

    def wide(self, text: str | None) -> bytes | None:
        """16 bits of each minimum that depend on all of its bits: what the operators compare."""
        low = self.minima(text)
        return None if low is None else (self._mix(low) >> np.uint32(16)).astype(SYMBOL).tobytes()

    def _mix(self, low: np.ndarray) -> np.ndarray:
        return (low ^ (low >> np.uint32(16))) * self.salt


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``sig`` of the rows that have an id and a signature. A narrow map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = MinHash()
        for batch in slices(batches):
            sigs = [make.wide(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigs, pa.binary())], ["doc_id", "sig"])

    src = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, sig binary").where("sig IS NOT NULL")


def chunking(symbols: int, radius: int) -> list[tuple[list[int], int]]:
    """(symbols, errors) of each chunk: one error a chunk, and a last one with none if the radius is even."""
    chunks = [1] * ((radius + 1) // 2) + [0] * ((radius + 1) % 2) or [0]
    if len(chunks) > symbols:
        raise ValueError("the radius is too large for so few symbols")
    cuts = np.linspace(0, symbols, len(chunks) + 1).round().astype(int)
    return [(list(range(a, b)), min(e, b - a)) for (a, b), e in zip(zip(cuts, cuts[1:]), chunks)]


def chunk_keys(sigs: np.ndarray, radius: int) -> np.ndarray:
    """64-bit keys (a row per signature); two signatures within the radius share one in the same column's number."""
    out = []
    for number, (columns, errors) in enumerate(chunking(sigs.shape[1], radius)):
        for left_out in itertools.combinations(columns, errors):
            key = np.full(len(sigs), np.uint64(xxhash.xxh3_64_intdigest(repr((number, left_out)))), dtype=np.uint64)
            for c in columns:
                if c not in left_out:
                    key = (key ^ (sigs[:, c].astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(32)
            out.append(key)
    return np.stack(out, axis=1).astype(np.int64)


def _matrix(column: pa.Array, symbol: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=symbol).reshape(len(column), -1)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches sorted by their first column, cut so that no run of equal values spans two, with the runs' starts."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        new = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if held and held[-1].column(0)[-1].as_py() != keys[0]:
            new = np.concatenate(([0], new))
        if len(new):
            held.append(batch.slice(0, int(new[-1])))
            yield _whole(held)
            held = []
            batch = batch.slice(int(new[-1]))
        held.append(batch)
    if held:
        yield _whole(held)


def _whole(parts: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, np.ndarray]:
    batch = pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if len(parts) > 1 else parts[0]
    if not batch.num_rows:
        return batch, np.zeros(0, dtype=np.int64)
    keys = batch.column(0).to_numpy()
    return batch, np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))


def bucket_members(reps: DataFrame, radius: int = RADIUS, symbol: np.dtype = BYTE) -> DataFrame:
    """(key, sid) of every chunk key that at least two signatures of ``reps`` (sid, sig) have."""
    sid = reps.schema["sid"].dataType.simpleString()

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = chunk_keys(_matrix(batch.column(1), symbol), radius)
                ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(keys)), keys.shape[1])))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), ids], ["key", "sid"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in _runs(batches):
            sizes = np.diff(np.append(starts, batch.num_rows))
            yield batch.filter(pa.array(np.repeat(sizes > 1, sizes)))

    keyed = reps.select("sid", "sig").mapInArrow(explode, f"key bigint, sid {sid}")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(shared, f"key bigint, sid {sid}")


def bucket_edges(sigs: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges between rows within the radius that connect whatever such pairs of rows connect.

    Rows are given to leaders: a row within the radius of a leader is connected to the first such one. Rows of two
    leaders need comparing only where no edge has joined these yet and the triangle inequality lets any pair of
    them be near, so what is left out can't change the connected components.
    """
    edges: list[tuple[int, int]] = []
    left, leaders = np.arange(len(sigs)), []
    while len(left):
        head = left[0]
        gap = np.count_nonzero(sigs[left] != sigs[head], axis=1)
        near = gap <= radius
        leaders.append((head, left[near], gap[near]))
        edges += [(int(head), int(i)) for i in left[near][1:]]
        left = left[~near]
    group = list(range(len(leaders)))

    def find(g: int) -> int:
        while group[g] != g:
            group[g] = g = group[group[g]]
        return g

    heads, reach = sigs[[h for h, *_ in leaders]], np.array([gap.max() for *_, gap in leaders], dtype=np.int64)
    for i, (_, own, gap) in enumerate(leaders):
        apart = np.count_nonzero(heads[i + 1 :] != heads[i], axis=1)
        for j in (np.flatnonzero(apart <= radius + reach[i] + reach[i + 1 :]) + i + 1).tolist():
            if find(i) == find(j):
                continue
            theirs = leaders[j][1]
            for x in own[apart[j - i - 1] - gap - reach[j] <= radius]:
                hit = np.flatnonzero(np.count_nonzero(sigs[theirs] != sigs[x], axis=1) <= radius)
                if len(hit):
                    edges.append((int(x), int(theirs[hit[0]])))
                    group[find(i)] = find(j)
                    break
    return edges


def _edges(batches: Iterator[pa.RecordBatch], radius: int, symbol: np.dtype) -> Iterator[pa.RecordBatch]:
    for batch, starts in _runs(batches):
        n = batch.num_rows
        if not n:
            continue
        sigs, sid = _matrix(batch.column(2), symbol), batch.column(1)
        ends = np.append(starts[1:], n)
        sizes = ends - starts
        end_of, few = np.repeat(ends, sizes), np.repeat(sizes <= FEW, sizes)
        left, right = [], []
        for lag in range(1, FEW):
            i = np.flatnonzero(few & (np.arange(n) + lag < end_of))
            if not len(i):
                break
            i = i[np.count_nonzero(sigs[i] != sigs[i + lag], axis=1) <= radius]
            left.append(i)
            right.append(i + lag)
        for a, b in zip(starts[sizes > FEW], ends[sizes > FEW]):
            e = np.array(bucket_edges(sigs[a:b], radius), dtype=np.int64).reshape(-1, 2) + a
            left.append(e[:, 0])
            right.append(e[:, 1])
        if left:
            a, b = sid.take(pa.array(np.concatenate(left))), sid.take(pa.array(np.concatenate(right)))
            pairs = pa.table([a, b], names=["a", "b"]).group_by(["a", "b"]).aggregate([]).combine_chunks()
            yield from pairs.to_batches()


def _bucketed(reps: DataFrame, radius: int, symbol: np.dtype) -> DataFrame:
    """(key, sid, sig) of the shared buckets, each bucket whole in one partition, in order of key and sid."""
    members = bucket_members(reps, radius, symbol)
    return members.join(reps, "sid").select("key", "sid", "sig").repartition("key").sortWithinPartitions("key", "sid")


def hamming_edges(reps: DataFrame, radius: int = RADIUS, symbol: np.dtype = BYTE) -> DataFrame:
    """(a, b): enough of the pairs of ``reps`` (distinct sid, distinct sig) within the radius to connect all that they connect."""
    sid = reps.schema["sid"].dataType.simpleString()
    return _bucketed(reps, radius, symbol).mapInArrow(lambda b: _edges(b, radius, symbol), f"a {sid}, b {sid}").distinct()


def hamming_pairs(reps: DataFrame, radius: int = RADIUS, symbol: np.dtype = BYTE) -> DataFrame:
    """(a, b, distance), a < b: every pair of ``reps`` (distinct sid) within the radius; ``symbol`` is how signatures are read."""
    sid = reps.schema["sid"].dataType.simpleString()

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in _runs(batches):
            sigs, ids = _matrix(batch.column(2), symbol), batch.column(1)
            for a, b in zip(starts, np.append(starts[1:], batch.num_rows)):
                for i in range(a, b - 1):
                    gap = np.count_nonzero(sigs[i + 1 : b] != sigs[i], axis=1)
                    hit = np.flatnonzero(gap <= radius)
                    if len(hit):
                        yield pa.RecordBatch.from_arrays(
                            [ids.take(pa.array(np.full(len(hit), i))), ids.take(pa.array(hit + i + 1)), pa.array(gap[hit].astype(np.int32))],
                            ["a", "b", "distance"],
                        )

    return _bucketed(reps, radius, symbol).mapInArrow(pairs, f"a {sid}, b {sid}, distance int").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's connected component.

    Alternates large-star and small-star steps, each a minimum by node with map-side combining and a join back, until
    the edges stay the same. Lineage is cut at every round.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = state(edges)
    while True:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        after = small.select("a", F.col("m").alias("b")).union(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        edges = cut(after.where("a <> b").distinct())
        if (now := state(edges)) == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id`` and ``keep_id`` of every document that has a near duplicate with a smaller id: its group's smallest id."""
    sigs = cut(signatures(docs))
    reps = cut(sigs.groupBy("sig").agg(F.min("doc_id").alias("sid")))
    roots = components(hamming_edges(reps, radius, SYMBOL))
    named = reps.join(roots, reps["sid"] == roots["node"], "left").select("sig", F.coalesce("root", "sid").alias("keep_id"))
    # An id whose rows differ may be in two groups; it stays with the first.
    return sigs.join(named, "sig").groupBy("doc_id").agg(F.min("keep_id").alias("keep_id")).where("doc_id <> keep_id")


def without_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One document of each group, with all the columns of ``docs``; of the rows with one id, one that comes first by text and the rest."""
    drop = cut(near_duplicates(docs, radius))
    again = cut(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.isEmpty():
        return kept_columns(docs, drop, "left_anti")
    rest = kept_columns(docs, drop.select("doc_id").union(again).distinct(), "left_anti")
    repeated = kept_columns(docs, again.join(drop, "doc_id", "left_anti"), "left_semi")
    order = Window.partitionBy("doc_id").orderBy(*[F.asc_nulls_last(F.col(f"`{c}`").cast("string")) for c in ["text", *sorted(set(docs.columns) - {"text", "doc_id"})]])
    first = repeated.withColumn("__silt_row", F.row_number().over(order)).where("__silt_row = 1")
    return rest.unionByName(first.select(*[F.col(f"`{c}`") for c in docs.columns]))
