"""Token counts: Viterbi over a unigram vocabulary that carries only the best score and the piece count.

The vocabulary and its scores come from a SentencePiece model file, read as a unigram model: the answer is the
number of pieces of the highest-scoring segmentation. An Aho-Corasick automaton enumerates the vocabulary matches.
Ties follow the public tokenizers: at each end position matches are tried from the longest to the shortest, and a
later one must score strictly higher to win. A character that no single-character piece covers costs ten less than
the lowest score and falls back to its UTF-8 bytes, each a token. Scores are summed exactly.

A text is escaped (spaces become U+2581, one is put in front) and, since no piece continues across a
word start, it falls apart into words whose counts add up; counts of words of up to ``MEMO_KEY`` characters are memoised per worker.
Null text: null count. Empty text: 0. Texts of any length are counted whole, in time linear in their length.
Repeated rows give repeated results; an empty table gives none.
"""

from __future__ import annotations

import re
import struct
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siltscan.llm._common import MEMO_ENTRIES, by_size, drop_long, map_rows, per_worker

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
NORMAL, USER_DEFINED, BYTE = 1, 4, 6
UNKNOWN_PENALTY = 10.0


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a serialised protocol buffer."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def vocabulary(model: bytes) -> list[tuple[str, float, int]]:
    """(piece, score, type) of a SentencePiece model file."""
    out = []
    for field, value in _fields(model):
        if field == 1:
            piece = dict(_fields(value))
            out.append((piece[1].decode(), struct.unpack("<f", piece[2])[0], piece.get(3, NORMAL)))
    return out


class WordCounter:
    """The same automaton and dynamic programme over many words in step, one character position at a time.

    A dense Aho-Corasick table covers the ``DENSE`` commonest characters of the vocabulary; words with others,
    or longer than ``LONGEST``, are left to the scalar form.
    """

    DENSE, LONGEST = 160, 40

    def __init__(self, own: list[tuple[str, float]], unknown: float):
        common = Counter(c for p, _ in own for c in p).most_common(self.DENSE)
        self.unknown, self.code = unknown, np.full(0x3000, -1, dtype=np.int32)
        for k, c in enumerate(sorted(c for c, _ in common if ord(c) < 0x3000)):
            self.code[ord(c)] = k
        width = int(self.code.max()) + 1
        code = {chr(c): int(k) for c, k in enumerate(self.code) if k >= 0}
        children, piece_at = [{}], {}
        for k, (piece, _) in enumerate(own):
            if all(c in code for c in piece):
                node = 0
                for c in piece:
                    if (child := children[node].get(code[c])) is None:
                        child = children[node][code[c]] = len(children)
                        children.append({})
                    node = child
                piece_at[node] = k
        self.lengths = np.array([len(p) for p, _ in own], dtype=np.int64)
        self.scores = np.array([s for _, s in own], dtype=np.float64)
        self.delta = np.zeros((len(children), width), dtype=np.int32)
        fail, link = [0] * len(children), [-1] * len(children)  # link: the nearest proper suffix that is a piece
        self.first, self.next = np.full(len(children), -1, dtype=np.int32), np.full(len(children), -1, dtype=np.int32)
        queue = [0]
        for node in queue:
            row = self.delta[node]
            if node:
                row[:] = self.delta[fail[node]]
                up = fail[node]
                link[node] = up if up in piece_at else link[up]
                self.first[node] = node if node in piece_at else link[node]
                self.next[node] = link[node]
            for c, child in children[node].items():
                fail[child] = int(row[c]) if node else 0
                row[c] = child
                queue.append(child)
        self.piece = np.full(len(children), -1, dtype=np.int64)
        for node, k in piece_at.items():
            self.piece[node] = k

    def counts(self, words: list[str]) -> tuple[dict[str, int], list[str]]:
        """Counts of the words that the dense table covers, and the other words."""
        long = [w for w in words if len(w) > self.LONGEST]
        words = sorted((w for w in words if 0 < len(w) <= self.LONGEST), key=len, reverse=True)
        if not words:
            return {}, long
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        codes = np.where(points < len(self.code), self.code[np.minimum(points, len(self.code) - 1)], -1)
        starts = np.concatenate(([0], np.cumsum(size)[:-1]))
        fits = np.minimum.reduceat(codes, starts) >= 0
        others = long + [w for w, ok in zip(words, fits) if not ok]
        words, size, starts = [w for w, ok in zip(words, fits) if ok], size[fits], starts[fits]
        n, most = len(words), int(size[0]) if len(size) else 0
        score, count = np.zeros((most + 1, n)), np.zeros((most + 1, n), dtype=np.int32)
        state = np.zeros(n, dtype=np.int32)
        bytes_of = np.where(points < 0x80, 1, np.where(points < 0x800, 2, 3)).astype(np.int32)
        active = n
        for i in range(most):
            active = int(np.searchsorted(-size, -i, side="left"))  # words longer than i
            at = starts[:active] + i
            state = self.delta[state[:active], codes[at]]
            best, pieces = np.full(active, -np.inf), np.zeros(active, dtype=np.int32)
            single, rows, node = np.zeros(active, dtype=bool), np.arange(active), self.first[state]
            while True:
                keep = node >= 0
                rows, node = rows[keep], node[keep]
                if not len(rows):
                    break
                k = self.piece[node]
                length = self.lengths[k]
                s = score[i + 1 - length, rows] + self.scores[k]
                won = s > best[rows]
                w = rows[won]
                best[w], pieces[w] = s[won], count[i + 1 - length[won], w] + 1
                single[rows[length == 1]] = True
                node = self.next[node]
            s = score[i, :active] + self.unknown
            won = ~single & (s > best)
            best[won], pieces[won] = s[won], count[i, :active][won] + bytes_of[at[won]]
            score[i + 1, :active], count[i + 1, :active] = best, pieces
        return dict(zip(words, count[size, np.arange(n)].tolist())), others


class UnigramCounter:
    """Counts tokens under a unigram vocabulary with byte fallback."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        if sum(kind == BYTE for *_, kind in pieces) != 256:
            raise ValueError("the vocabulary must have the 256 byte pieces")
        own = [(p, s) for p, s, kind in pieces if kind in (NORMAL, USER_DEFINED)]
        self.unknown = min(s for _, s in own) - UNKNOWN_PENALTY
        self.matches = ahocorasick.Automaton()
        for piece, score in own:
            self.matches.add_word(piece, (len(piece), score))
        self.matches.make_automaton()
        self.by_word = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _ in own)
        self.by_line = not any("\n" in p for p, _ in own)
        self.words, self.memo = WordCounter(own, self.unknown), {}

    def viterbi(self, segment: str) -> int:
        n = len(segment)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        matches = iter(self.matches.iter(segment))  # by end; for one end the longest first
        end, match = next(matches, (n, None))
        for i in range(n):
            best, pieces, single = float("-inf"), 0, False
            while end == i:
                length, s = match
                j = i + 1 - length
                if score[j] + s > best:
                    best, pieces = score[j] + s, count[j] + 1
                single = single or length == 1
                end, match = next(matches, (n, None))
            if not single and score[i] + self.unknown > best:
                best, pieces = score[i] + self.unknown, count[i] + len(segment[i].encode("utf-8", "surrogatepass"))
            score[i + 1], count[i + 1] = best, pieces
        return count[n]

    def segments(self, text: str) -> tuple[list[str], int]:
        """Parts that no piece joins, and the number of tokens outside them.

        A part is written as the word alone where one space goes before it, else with a line break in front.
        """
        if not self.by_word:
            return ["\n" + SPACE + text.replace(" ", SPACE)], 0
        if SPACE in text:
            text = text.replace(SPACE, " ")
        lines = (" " + text).split("\n") if self.by_line else [" " + text]  # a line break is an unknown character: one byte
        out: list[str] = []
        for line in lines:
            if "  " in line or line.endswith(" "):
                out += ["\n" + w.replace(" ", SPACE) for w in re.findall(" *[^ ]+| +$", line)]
            elif line:
                words = line.split(" ")
                words[0] = "\n" + words[0]
                out += words
        return out, len(lines) - 1

    def counts(self, texts: list[str | None]) -> list[int | None]:
        out: list[int | None] = []
        memo = self.memo
        for group in by_size(texts):
            parts = [(None, 0) if t is None else ([], 0) if not t else self.segments(t) for t in group]
            every = set().union(*(words for words, _ in parts if words))
            new = every.difference(memo)
            if len(memo) + len(new) > MEMO_ENTRIES:
                memo.clear()
                new = every
            bare = {w: w[1:] if w[0:1] == "\n" else SPACE + w for w in new}
            found, others = self.words.counts(list(set(bare.values())))
            found.update((w, self.viterbi(w)) for w in others)
            found[""] = 0
            memo.update((key, found[w]) for key, w in bare.items())
            out += [None if words is None else more + sum(map(memo.__getitem__, words)) for words, more in parts]
            drop_long(memo, new)
        return out


def counter(model: bytes) -> UnigramCounter:
    return per_worker(("unigram", model), lambda: UnigramCounter(vocabulary(model)))


def token_counts(docs: DataFrame, model_path: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``n_tokens`` for every row of ``docs``, repeated rows included; other columns are not read.

    A narrow map without a shuffle; the vocabulary (read on the driver, of fixed size) is all that is broadcast.
    """
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = counter(model.value)
        n = pa.array(c.counts(batch.column(1).to_pylist()), pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), n], [id_col, "n_tokens"])

    src = docs.select(id_col, text_col)
    return map_rows(src, count, f"`{id_col}` {src.schema[id_col].dataType.simpleString()}, n_tokens bigint")
