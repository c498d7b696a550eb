"""Byte-level BPE encoding and decoding with a contiguous rank array.

A pretoken's bytes start as one part each. ``starts`` holds the part boundaries and ``ranks`` the rank of each
adjacent pair of parts. The lowest rank (leftmost on ties) is found by a scan, its inner boundary is deleted, and the
ranks of the two neighbouring pairs are refreshed, until no pair is in the vocabulary. Pretokens beyond ``SHORT``
bytes use a heap over linked parts instead, which gives the same merges in n log n.

Null text: null ids. Empty text: no ids. Texts of any length are encoded whole. Repeated rows give repeated results; an
empty table gives none. Decoding gives back every text exactly.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from siltscan.llm._common import MEMO_ENTRIES, by_size, drop_long, map_rows, per_worker

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHORT = 256
NONE = 1 << 60


class Bpe:
    def __init__(self, ranks_file: bytes, pattern: str = PATTERN):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines() if ranks_file else [])}
        self.tokens: list[bytes] = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.split = regex.compile(pattern).findall
        self.memo: dict[str, bytes] = {}
        self.single = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)
        pairs = [
            (self.ranks[token[:i]] << 32 | self.ranks[token[i:]], rank)
            for token, rank in self.ranks.items()
            if len(token) <= SHORT
            for i in range(1, len(token))
            if token[:i] in self.ranks and token[i:] in self.ranks
        ]
        keys, merged = (np.array(x, dtype=np.int64) for x in (zip(*pairs) if pairs else ([], [])))
        self.slots = np.full(1 << self.BITS, -1, dtype=np.int64)  # an open-addressing table of the pairs
        self.merged = np.full(1 << self.BITS, NONE, dtype=np.int64)
        self.probes, at = 0, self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.slots[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.slots[at[put]], self.merged[at[put]] = keys[put], merged[put]
            rest = np.ones(len(keys), dtype=bool)
            rest[put] = False
            keys, merged, at = keys[rest], merged[rest], (at[rest] + 1) & (len(self.slots) - 1)
            self.probes += 1

    BITS = 21

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def merge(self, word: bytes) -> list[int]:
        ranks = self.ranks
        if word in ranks:
            return [ranks[word]]
        if len(word) > SHORT:
            return self.merge_long(word)
        get = ranks.get
        starts = list(range(len(word) + 1))
        pair = [get(word[i : i + 2], NONE) for i in range(len(word) - 1)]
        while pair:
            low = min(pair)
            if low == NONE:
                break
            i = pair.index(low)
            del starts[i + 1], pair[i]
            if i < len(pair):
                pair[i] = get(word[starts[i] : starts[i + 2]], NONE)
            if i:
                pair[i - 1] = get(word[starts[i - 1] : starts[i + 1]], NONE)
        return [ranks[word[a:b]] for a, b in zip(starts, starts[1:])]

    def merge_long(self, word: bytes) -> list[int]:
        ranks, n = self.ranks, len(word)
        after, before = list(range(1, n + 2)), list(range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\1") * n
        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i] or (j := after[i]) >= n or after[j] != end:
                continue
            alive[j] = 0
            after[i] = end
            if end < n:
                before[end] = i
                if (r := ranks.get(word[i : after[end]])) is not None:
                    heapq.heappush(heap, (r, i, after[end]))
            if (b := before[i]) >= 0 and (r := ranks.get(word[b:end])) is not None:
                heapq.heappush(heap, (r, b, end))
        return [ranks[word[i : after[i]]] for i in range(n) if alive[i]]

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """``merge`` of words of one length at most ``SHORT`` in step: a row of parts and a row of ranks per word; packed ids."""
        n, size = len(words), len(words[0])
        part = self.single[np.frombuffer(b"".join(words), dtype=np.uint8).reshape(n, size)]
        rank = self._pair(part[:, :-1].ravel(), part[:, 1:].ravel()).reshape(n, size - 1)
        rows, done = np.arange(n), [b""] * n
        while len(rows):
            m = rank.shape[1]
            k = np.arange(len(rows))
            at = rank.argmin(axis=1) if m else np.zeros(len(rows), dtype=np.int64)
            low = rank[k, at] if m else np.full(len(rows), NONE)
            if (over := low == NONE).any():
                packed = part[over].astype("<i4").tobytes()
                step = 4 * part.shape[1]
                for j, row in enumerate(rows[over].tolist()):
                    done[row] = packed[j * step : (j + 1) * step]
                go = ~over
                rows, part, rank, at, low = rows[go], part[go], rank[go], at[go], low[go]
                k = np.arange(len(rows))
                if not len(rows):
                    break
            part[k, at] = low
            keep = np.ones(part.shape, dtype=bool)
            keep[k, at + 1] = False
            part = part[keep].reshape(len(rows), m)
            keep = np.ones(rank.shape, dtype=bool)
            keep[k, at] = False
            rank = rank[keep].reshape(len(rows), m - 1)
            right = np.flatnonzero(at + 1 < m)
            rank[right, at[right]] = self._pair(part[right, at[right]], part[right, at[right] + 1])
            left = np.flatnonzero(at > 0)
            rank[left, at[left] - 1] = self._pair(part[left, at[left] - 1], part[left, at[left]])
        return done

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the tokens that adjacent parts form, ``NONE`` where there is none."""
        key = (left << 32) | right
        at = self._slot(key)
        slot = self.slots[at]
        out = np.where(slot == key, self.merged[at], NONE)
        for _ in range(self.probes - 1):
            open_ = np.flatnonzero((slot != key) & (slot >= 0))
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & (len(self.slots) - 1)
            slot[open_] = self.slots[at[open_]]
            hit = open_[slot[open_] == key[open_]]
            out[hit] = self.merged[at[hit]]
        return out

    def learn(self, words: list[str]) -> None:
        """Put the packed ids of ``words`` into the memo."""
        by_length: dict[int, list[str]] = {}
        for w in words:
            b = w.encode()
            if b in self.ranks or len(b) > 32:
                self.memo[w] = np.array(self.merge(b), dtype="<i4").tobytes()
            else:
                by_length.setdefault(len(b), []).append(w)
        for group in by_length.values():
            for w, ids in zip(group, self.merge_many([w.encode() for w in group])):
                self.memo[w] = ids

    def encode_all(self, texts: list[str | None]) -> list[bytes | None]:
        """Little-endian 32-bit ids of each text."""
        out: list[bytes | None] = []
        for group in by_size(texts):
            parts = [None if t is None else self.split(t) for t in group]
            every = set().union(*(words for words in parts if words))
            new = every.difference(self.memo)
            if len(self.memo) + len(new) > MEMO_ENTRIES:
                self.memo.clear()
                new = every
            self.learn(list(new))
            out += [None if words is None else b"".join(map(self.memo.__getitem__, words)) for words in parts]
            drop_long(self.memo, new)
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_all([text])[0], dtype="<i4").tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


def codec(ranks_file: bytes, pattern: str) -> Bpe:
    return per_worker(("bpe", ranks_file, pattern), lambda: Bpe(ranks_file, pattern))


def _ids_array(packed: list[bytes | None]) -> pa.ListArray:
    sizes = np.fromiter((0 if p is None else len(p) // 4 for p in packed), dtype=np.int64, count=len(packed))
    offsets = np.zeros(len(packed) + 1, dtype=np.int32)
    np.cumsum(sizes, out=offsets[1:])
    values = np.frombuffer(b"".join(p or b"" for p in packed), dtype="<i4")
    mask = pa.array([p is None for p in packed], pa.bool_()) if any(p is None for p in packed) else None
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()), mask=mask)


def _open(docs: DataFrame, ranks_path: str):
    with open(ranks_path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, ranks_path: str = RANKS, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``token_ids`` (array of int) and ``round_trip``: whether decoding the ids gave the text again.

    One narrow Arrow map; the vocabulary has a fixed size. Every row gives one row; null text gives nulls.
    """
    ranks = _open(docs, ranks_path)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(ranks.value, pattern)
        texts = batch.column(1).to_pylist()
        packed = c.encode_all(texts)
        same = [None if p is None else c.decode(np.frombuffer(p, dtype="<i4").tolist()) == t for p, t in zip(packed, texts)]
        return pa.RecordBatch.from_arrays([batch.column(0), _ids_array(packed), pa.array(same, pa.bool_())], [id_col, "token_ids", "round_trip"])

    src = docs.select(id_col, text_col)
    return map_rows(src, run, f"`{id_col}` {src.schema[id_col].dataType.simpleString()}, token_ids array<int>, round_trip boolean")


def decode(tokens: DataFrame, ranks_path: str = RANKS, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """``id_col`` and the ``text`` of ``ids_col``; null ids give null text, ids outside the vocabulary raise."""
    ranks = _open(tokens, ranks_path)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(ranks.value, PATTERN)
        texts = [None if ids is None else c.decode(ids) for ids in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    src = tokens.select(id_col, ids_col)
    return map_rows(src, run, f"`{id_col}` {src.schema[id_col].dataType.simpleString()}, text string")
