"""Quality rules: a linear-chain conditional random field labels lines as content or boilerplate, and the share of
content decides which documents stay.

A line's features are indicators of binned measurements (upper case, symbols, digits, word lengths, repeated words,
words that echo the one before, length, an earlier equal line, licence words, end punctuation, its place, and whether it
or its neighbours recur in the corpus). A line recurs if it stands in at least ``RECURS`` different surroundings, these being ``APART`` of
its occurrences at least: lines of page furniture stand between ever other lines, the lines of a text that is
copied with small changes mostly between the same. Surroundings are the first two words of the lines before and after.
They are counted over all lines of all documents, natively, by a shuffle of two numbers a line.

The two-label chain is trained on the driver by maximum likelihood on at most ``SAMPLE`` labelled documents, those with the
smallest hashed ids. Each of their lines has a label of its own: a line of a document of bad quality, a line that recurs and
one with licence words are boilerplate, any other is content. Decoding is Viterbi over all of a document's lines, ties going
to content. A document is kept when at least ``SHARE`` of its characters lie in content lines.

Null texts, and texts without a line that has more than white space, are not kept. With no labelled documents
the field has no weights, and all that has text is kept. Repeated rows give repeated results and count as often; of rows
with one id the first by text trains. Texts of any length are labelled whole; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Container, Iterator
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltscan.llm._common import BROADCAST_ROWS, by_size, cut, slices

#: Chosen on held-out labels: good documents may hold little but furniture, bad ones have next to no content.
SAMPLE, SHARE, ROUNDS, RATE, DECAY, RECURS, APART = 2_000, 0.25, 80, 0.15, 3e-5, 5, 0.7
LICENCE = re.compile(r"licen[sc]ed? under|all rights reserved|copyright|apache license|mit license|cookie policy|terms of (use|service)|©", re.I)
UPPER, LOWER, DIGIT, WHITE, OTHER = range(5)
BINS = (0.02, 0.1, 0.25, 0.5, 0.8)
FEATURES = [
    ("upper", BINS), ("symbols", BINS), ("digits", BINS), ("long_word", (3.0, 4.0, 5.0, 6.5, 9.0)), ("short_words", BINS),
    ("distinct", (0.1, 0.3, 0.5, 0.7, 0.9)), ("echo", BINS), ("words", (2, 6, 15, 40, 120)), ("repeated", (0.5,)), ("licence", (0.5,)), ("stop", (0.5,)),
    ("place", (0.5, 1.5, 2.5)), ("recurs", (0.5,)), ("beside", (0.5, 1.5)),
]
OFFSET = np.cumsum([0, *(len(b) + 1 for _, b in FEATURES)])
WIDTH = int(OFFSET[-1])


def _classes() -> np.ndarray:
    table = np.full(0x3000, OTHER, dtype=np.uint8)
    for c in map(chr, range(0x3000)):
        table[ord(c)] = WHITE if c.isspace() else DIGIT if c.isdigit() else UPPER if c.isupper() else LOWER if c.isalpha() else OTHER
    return table


CLASS = _classes()


def lines_of(text: str) -> list[str]:
    return [line for line in text.split("\n") if line and not line.isspace()]


def line_hash(line: str) -> int:
    """The number by which Spark's ``xxhash64`` knows the line."""
    h = xxhash.xxh64_intdigest(line.encode("utf-8", "replace"), seed=42)
    return h - (1 << 64) if h >> 63 else h


def features(docs: list[list[str]], recurring: Container[int] = ()) -> np.ndarray:
    """A row per line of all documents, holding the index of the indicator that is on for each measurement.

    ``recurring`` has the hashes of the lines that recur in the corpus.
    """
    lines = [line for doc in docs for line in doc]
    if not lines:
        return np.zeros((0, len(FEATURES)), dtype=np.int16)
    points = np.frombuffer("\n".join([*lines, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kind = np.where(points < len(CLASS), CLASS[np.minimum(points, len(CLASS) - 1)], LOWER)
    size = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines)) + 1
    start = np.concatenate(([0], np.cumsum(size)[:-1]))
    count = [np.add.reduceat(kind == k, start) for k in range(5)]
    inked = np.maximum(size - count[WHITE], 1)
    letters = np.maximum(count[UPPER] + count[LOWER], 1)
    white = kind == WHITE
    begin = np.flatnonzero(~white & np.concatenate(([True], white[:-1])))
    length = np.flatnonzero(white & np.concatenate(([False], ~white[:-1]))) - begin
    line = np.searchsorted(start, begin, side="right") - 1
    words = np.bincount(line, minlength=len(lines))
    some = np.maximum(words, 1)
    mean = np.bincount(line, weights=length, minlength=len(lines)) / some
    short = np.bincount(line, weights=length <= 3, minlength=len(lines)) / some
    split = [x.split() for x in lines]
    distinct = np.fromiter(map(len, map(set, split)), dtype=np.float64, count=len(lines)) / some
    echo = np.fromiter((sum(map(eq, w, islice(w, 1, None))) for w in split), dtype=np.float64, count=len(lines)) / some
    recurs = np.fromiter((line_hash(x) in recurring for x in lines), dtype=np.float64, count=len(lines)) if recurring else np.zeros(len(lines))
    place = np.concatenate([[0.0] if len(doc) == 1 else [1.0, *[2.0] * (len(doc) - 2), 3.0] for doc in docs if doc])
    # How many of the lines before and after recur: what furniture says of its own label says nothing of its neighbours'.
    beside = np.zeros(len(lines))
    beside[1:] += recurs[:-1] * (place[1:] > 1)
    beside[:-1] += recurs[1:] * (place[1:] > 1)
    again, licence = np.zeros(len(lines)), np.fromiter((LICENCE.search(x) is not None for x in lines), dtype=np.float64, count=len(lines))
    k = 0
    for doc in docs:
        seen: set[str] = set()
        for x in doc:
            again[k] = x in seen
            seen.add(x)
            k += 1
    stop = np.fromiter((x.rstrip()[-1] in ".!?…。" for x in lines), dtype=np.float64, count=len(lines))
    measured = [count[UPPER] / letters, count[OTHER] / inked, count[DIGIT] / inked, mean, short, distinct, echo, words, again, licence, stop, place, recurs, beside]
    cols = [np.searchsorted(bins, m, side="right") + at for (_, bins), m, at in zip(FEATURES, measured, OFFSET)]
    return np.stack(cols, axis=1).astype(np.int16)


class LineCrf:
    """Labels 0 (content) and 1 (boilerplate): weights of the indicators for label 1, of the start, and of each transition."""

    def __init__(self, weights: np.ndarray | None = None, start: np.ndarray | None = None, step: np.ndarray | None = None):
        self.weights = np.zeros(WIDTH) if weights is None else weights
        self.start = np.zeros(2) if start is None else start
        self.step = np.zeros((2, 2)) if step is None else step

    def emissions(self, rows: np.ndarray) -> np.ndarray:
        return self.weights[rows].sum(axis=1)

    def decode(self, emission: list[float]) -> list[int]:
        """The best labelling of a document's lines by Viterbi."""
        (s0, s1), ((a, b), (c, d)) = self.start.tolist(), self.step.tolist()
        best0, best1, back = s0, s1 + emission[0], []
        for e in emission[1:]:
            to0, to1 = (0, best0 + a) if best0 + a >= best1 + c else (1, best1 + c), (0, best0 + b) if best0 + b >= best1 + d else (1, best1 + d)
            back.append((to0[0], to1[0]))
            best0, best1 = to0[1], to1[1] + e
        label = int(best1 > best0)
        out = [label]
        for pointers in reversed(back):
            label = pointers[label]
            out.append(label)
        return out[::-1]

    def fit(self, docs: list[tuple[np.ndarray, int | np.ndarray]]) -> LineCrf:
        """Full-batch Adam on the mean log-likelihood of the label sequences, forward and backward over all documents in step.

        A document comes with a label for each of its rows, or one for all.
        """
        docs = [(rows, label) for rows, label in docs if len(rows)]
        if not docs:
            return self
        docs.sort(key=lambda x: -len(x[0]))
        size = np.array([len(r) for r, _ in docs])
        first = np.concatenate(([0], np.cumsum(size)[:-1]))
        rows, gold = np.concatenate([r for r, _ in docs]), np.concatenate([np.broadcast_to(y, len(r)) for r, y in docs]).astype(np.int64)
        active = [int(np.searchsorted(-size, -t, side="left")) for t in range(int(size[0]))]  # documents longer than t
        total = float(len(rows))
        # What the data say of start, transitions and indicators is a count.
        gold_start = np.bincount(gold[first], minlength=2).astype(float)
        gold_step, later = np.zeros((2, 2)), np.ones(len(rows), dtype=bool)
        later[first] = False
        later = np.flatnonzero(later)
        np.add.at(gold_step, (gold[later - 1], gold[later]), 1.0)
        gold_rows = np.bincount(rows[gold == 1].ravel(), minlength=WIDTH).astype(float)
        theta, m, v = np.zeros(WIDTH + 6), np.zeros(WIDTH + 6), np.zeros(WIDTH + 6)
        for k in range(1, ROUNDS + 1):
            w, start, step = theta[:WIDTH], theta[WIDTH : WIDTH + 2], theta[WIDTH + 2 :].reshape(2, 2)
            emit = w[rows].sum(axis=1)
            # One row per line of all documents, so that a long document doesn't pad the others.
            forward, backward = np.zeros((len(rows), 2)), np.zeros((len(rows), 2))
            forward[first] = start
            forward[first, 1] += emit[first]
            for t in range(1, len(active)):
                at = first[: active[t]] + t
                before = forward[at - 1]
                forward[at] = np.logaddexp(before[:, :1] + step[0], before[:, 1:] + step[1])
                forward[at, 1] += emit[at]
            for t in range(len(active) - 2, -1, -1):
                at = first[: active[t + 1]] + t
                ahead = backward[at + 1]
                ahead[:, 1] += emit[at + 1]
                backward[at] = np.logaddexp(ahead[:, None, 0] + step[:, 0], ahead[:, None, 1] + step[:, 1])
            z = np.repeat(np.logaddexp(*forward[first + size - 1].T), size)
            p = np.exp(forward + backward - z[:, None])
            post, want_start = p[:, 1], p[first].sum(axis=0)
            inner = np.ones(len(rows), dtype=bool)
            inner[first] = False
            to = np.flatnonzero(inner)
            ahead = backward[to].copy()
            ahead[:, 1] += emit[to]
            want_step = np.exp(forward[to - 1][:, :, None] + step + ahead[:, None, :] - z[to][:, None, None]).sum(axis=0)
            want_rows = np.bincount(rows.ravel(), weights=np.repeat(post, rows.shape[1]), minlength=WIDTH)
            slope = np.concatenate([gold_rows - want_rows, gold_start - want_start, (gold_step - want_step).ravel()]) / total - DECAY * theta
            m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
            theta += RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        return LineCrf(theta[:WIDTH], theta[WIDTH : WIDTH + 2], theta[WIDTH + 2 :].reshape(2, 2))

    def labels(self, texts: list[str | None], recurring: Container[int] = ()) -> Iterator[tuple[list[str], list[int]]]:
        """The lines of each text and their labels."""
        for group in by_size(texts):
            docs = [lines_of(t) if t else [] for t in group]
            emission, at = self.emissions(features(docs, recurring)).tolist(), 0
            for doc in docs:
                yield doc, self.decode(emission[at : at + len(doc)]) if doc else []
                at += len(doc)

    def shares(self, texts: list[str | None], recurring: Container[int] = ()) -> list[float | None]:
        """The share of each text's characters that lie in content lines; None without lines."""
        out: list[float | None] = []
        for doc, labels in self.labels(texts, recurring):
            sizes = list(map(len, doc))
            out.append(sum(s for s, y in zip(sizes, labels) if not y) / sum(sizes) if doc else None)
        return out


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike("\\S"))


def recurring_lines(docs: DataFrame, recurs: int = RECURS, apart: float = APART) -> DataFrame:
    """(line): hashes of the lines that recur. What is shuffled is a hash of a line, one of its surroundings, and a count."""

    def words(x: Column) -> Column:
        return F.regexp_extract(F.coalesce(x, F.lit("")), r"^\s*(\S+(?:\s+\S+)?)", 1)

    each = F.transform(F.col("x"), lambda x, i: F.struct(F.xxhash64(x).alias("line"), F.xxhash64(words(F.get("x", i - 1)), words(F.get("x", i + 1))).alias("around")))
    rows = docs.select(_lines(docs["text"]).alias("x")).select(F.explode(each).alias("r")).select("r.*")
    counts = rows.groupBy("line", "around").agg(F.count("*").alias("n")).groupBy("line").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    return counts.where((F.col("k") >= recurs) & (F.col("k") >= apart * F.col("n"))).select("line")


def with_recurring(docs: DataFrame, recurring: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Broadcast | None]:
    """(id, text, own) and, where the table of recurring lines, which is cut already, is small by its checked size, its
    hashes to be shipped whole; ``own`` is empty then. Beyond that lines meet the table by a shuffle of their hashes and each
    document gets its own."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if recurring.count() <= BROADCAST_ROWS:
        return src.withColumn("own", F.array().cast("array<bigint>")), docs.sparkSession.sparkContext.broadcast(frozenset(r[0] for r in recurring.collect()))
    each = src.select(F.col("id").alias("own_id"), F.explode(F.array_distinct(F.transform(_lines(F.col("text")), lambda x: F.xxhash64(x)))).alias("line"))
    own = each.join(recurring, "line", "left_semi").groupBy("own_id").agg(F.collect_set("line").alias("own"))
    return src.join(own, src["id"].eqNullSafe(own["own_id"]), "left").select("id", "text", "own"), None


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, recurring: DataFrame | None = None) -> LineCrf:
    """Fit on the labelled documents with the ``sample`` smallest hashed ids; quality 0 means that all lines are boilerplate."""
    chosen = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample)
    )
    # At most ``sample`` rows, so it is broadcast; of rows with one id one trains, so no more come to the driver.
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality"))
    picked = cut(picked)
    src, shipped = with_recurring(picked, cut(recurring_lines(docs)) if recurring is None else recurring, "doc_id", "text")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = [frozenset(x or ()) for x in batch.column(1).to_pylist()]
            rows = [features([lines_of(t)], shipped.value if shipped else o) if t else np.zeros((0, len(FEATURES)), dtype=np.int16) for t, o in zip(batch.column(0).to_pylist(), own)]
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary()), batch.column(2).cast(pa.int32())], ["rows", "quality"])

    quality = picked.select(F.col("doc_id").alias("q_id"), "quality")
    got = src.join(quality, src["id"] == quality["q_id"]).select("text", "own", "quality").mapInArrow(lines, "rows binary, quality int").collect()
    got = sorted((bytes(r["rows"]), int(r["quality"])) for r in got)  # the sums' order doesn't depend on the partitions
    return LineCrf().fit([(x := np.frombuffer(r, dtype=np.int16).reshape(-1, len(FEATURES)), line_labels(x, q)) for r, q in got])


def line_labels(rows: np.ndarray, quality: int) -> np.ndarray:
    """What the lines of a labelled document are taken for."""
    on = {name: OFFSET[k] + len(bins) for k, (name, bins) in enumerate(FEATURES)}
    return (rows == on["recurs"]).any(axis=1) | (rows == on["licence"]).any(axis=1) | (quality == 0)


def content_shares(docs: DataFrame, crf: LineCrf, id_col: str = "doc_id", text_col: str = "text", recurring: DataFrame | None = None) -> DataFrame:
    """``id_col`` and ``content_share`` of every row; null without lines. A narrow map where the table of lines that recur is small or not given."""
    src, shipped = docs.select(id_col, text_col), None
    if recurring is not None:
        src, shipped = with_recurring(docs, recurring, id_col, text_col)
    apiece = recurring is not None and shipped is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            if not apiece:
                shares = crf.shares(texts, shipped.value if shipped else ())
            else:
                shares = [crf.shares([t], frozenset(own or ()))[0] for t, own in zip(texts, batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shares, pa.float64())], [id_col, "content_share"])

    return src.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, content_share double")


def kept_documents(docs: DataFrame, labels: DataFrame, share: float = SHARE) -> DataFrame:
    """``doc_id`` and ``content_share`` of the documents that stay."""
    recurring = cut(recurring_lines(docs))
    return content_shares(docs, train(docs, labels, recurring=recurring), recurring=recurring).where(F.col("content_share") >= share)
