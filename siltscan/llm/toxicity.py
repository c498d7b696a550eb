"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows that tell quotation from abuse.

A state of the product automaton is a set of (trie node, edits) pairs. It is determinised lazily: each transition is
computed once per worker, so a word costs one table step per character and most die within a few. How many edits a
term tolerates depends on its length (``edits_for``): short terms only match exactly or by look-alike characters
(0 for o, @ for a, and so on, which are free), since one edit turns them into ordinary words.

Beside the given lexicon, terms are learned from at most ``SAMPLE`` labelled documents, those with the smallest hashed
ids. Near copies among them count once. A word is taken if it is in toxic documents so much more often than their share
that the binomial tail bound is below exp(-``EVIDENCE``), and in at least three toxic ones for each other; for a word within
the edits of one taken so, an inflection mostly, exp(-``NEAR_EVIDENCE``) suffices. Its severity is the square of its
smoothed precision, so one hit of a term of 0.922 and more suffices. Learned terms tolerate edits too, from
``LEARNED_LETTERS`` letters, where ordinary words are known, but a misspelled one counts ``LEARNED_EDIT`` only, so that it takes two.

Near misses that are ordinary words are told by the corpus (``ordinary_words``): a misspelling is rarer than what it
misspells, so a near miss that all documents hold in at least ``COMMON`` surroundings, and in ``COMMON_SHARE`` times as
many as the term itself, is a word of its own. Surroundings, the words before and after, are counted rather than
documents, so that copies count once. What is collected is such words near a term, whose number the lexicon bounds.

A hit's score is its term's severity, times ``PER_EDIT`` for each edit, so that one unquoted misspelling suffices, times the context's factor: within ``WINDOW``
words, a quoted hit next to a reporting word counts 0.1, a quoted one 0.4, one next to a reporting word 0.6; a second
person within ``NEAR`` words counts 1.25. A quotation lies within a line, however long. A document is toxic from a total of ``THRESHOLD``.

Null, empty and wordless texts score 0 and are never toxic. Texts of any length are judged whole. Repeated rows give
repeated results; of labelled rows with one id the first by text teaches. Without labelled documents nothing is learned.
An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltscan.llm._common import Memo, cut, map_rows, per_worker, slices
from siltscan.llm.neardup import MinHash

#: Insults that are one edit from common words (of other languages too) match exactly only.
EXACT = frozenset("cretin degenerate retard vermin wanker".split())
#: term -> severity. A starting lexicon of public everyday insults; pass another to ``toxic_documents``.
LEXICON = {
    **dict.fromkeys(["idiot", "moron", "stupid", "loser", "scum", "clown", "trash", "worthless", "pathetic", "disgusting"], 1.0),
    **dict.fromkeys(["imbecile", "dumbass", "jackass", "asshole", "bastard", "bitch", "dimwit", "lowlife"], 1.0),
    **dict.fromkeys(["scumbag", "shithead", "fuckwit", "motherfucker"], 1.0),
    **dict.fromkeys(EXACT, 1.0),
}
#: Words that are no misspellings, though near a term: for tables too small to tell by.
ORDINARY = frozenset("apathetic bustard dastard discussing jackals stupa studio stupor worthiness".split())
REPORTING = frozenset(
    "said says say wrote writes quoted quote quotes quoting called calls calling word words term terms slur insult insults "
    "insulting phrase tweet comment alleged reported claimed sagte schrieb nannte wort dit écrit appelé mot dijo escribió llamó palabra".split()
)
SECOND_PERSON = frozenset(
    "you your you're youre yourself u ur du dich dir dein deine deiner euch euer tu toi ton ta tes vous votre vos tú te ti tus usted ustedes vosotros".split()
)
ALIKE = str.maketrans("0134578@$!", "oieastbasi")
WORD = re.compile(r"[@$]?\w+(?:[@$!*]+\w+)*")
MARK = re.compile("[\"“”«»„‘’\\n]")
CLOSES = {"»": "«", "’": "‘", "”": "“„", "“": "„", '"': '"'}
#: Chosen on held-out labels: no clean document is hit, and two quoted hits (0.8) stay below.
WINDOW, NEAR, THRESHOLD, PER_EDIT = 8, 3, 0.85, 0.93
SAMPLE, EVIDENCE, NEAR_EVIDENCE, PRECISION = 5_000, 10.0, 4.0, 0.75
LEARNED_LETTERS, LEARNED_EDIT, COMMON, COMMON_SHARE = 9, 0.6, 5, 0.125
#: Differing symbols of two signatures up to which a labelled document is a copy of another.
COPY = 60


def hash64(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def edits_for(term: str) -> int:
    return 0 if len(term) < 6 else 1 if len(term) < 10 else 2


def edits_for_learned(term: str) -> int:
    return int(len(term) >= LEARNED_LETTERS)


class LexiconAutomaton:
    """Finds the lexicon term within its edit budget of a word: the one with fewest edits, then the first by name."""

    def __init__(self, terms: Iterable[str], exact: Iterable[str] = (), learned: Iterable[str] = (), ordinary: Iterable[str] = ()):
        self.edits = {t: edits_for_learned(t) for t in learned} | dict.fromkeys(exact, 0) | {t: edits_for(t) for t in terms}
        self.per_edit = dict.fromkeys(self.edits, PER_EDIT) | dict.fromkeys(learned, LEARNED_EDIT)
        self.ordinary = ORDINARY.union(ordinary)
        self.children: list[dict[str, int]] = [{}]
        self.term: dict[int, str] = {}
        self.budget = [0]
        for term in sorted(self.edits):
            node = 0
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.budget.append(0)
                node = self.children[node][c]
            self.term[node] = term
        self._budgets(0)
        self.alphabet = {c for d in self.children for c in d}
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[str, int] | None] = []
        self.start = self._state({(0, 0)})
        self.memo = Memo(self.match)

    def _budgets(self, node: int) -> int:
        """Most edits that any term below ``node`` tolerates; recursion is as deep as a term is long."""
        below = [self._budgets(child) for child in self.children[node].values()]
        self.budget[node] = max([self.edits[self.term[node]] if node in self.term else 0, *below])
        return self.budget[node]

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        """The number of the state of ``pairs`` closed over deletions from the term; -1 when nothing is left."""
        best: dict[int, int] = {}
        todo = list(pairs)
        while todo:
            node, edits = todo.pop()
            if edits > self.budget[node] or best.get(node, 99) <= edits:
                continue
            best[node] = edits
            todo += [(child, edits + 1) for child in self.children[node].values()]
        if not best:
            return -1
        key = frozenset(best.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            ends = [(e, self.term[n]) for n, e in key if n in self.term and e <= self.edits[self.term[n]]]
            self.accepts.append(min(ends)[::-1] if ends else None)
        return self.states[key]

    def _move(self, state: int, c: str) -> int:
        after = set()
        for node, edits in self.sets[state]:
            after.add((node, edits + 1))
            for label, child in self.children[node].items():
                after.add((child, edits + (label != c)))
        to = self.moves[state][c] = self._state(after)
        return to

    def match(self, word: str) -> tuple[str, int] | None:
        if word in self.ordinary and word not in self.edits:
            return None
        word = word.translate(ALIKE) if any(map(str.isalpha, word)) else word
        state, alphabet, moves = self.start, self.alphabet, self.moves
        for c in word:
            c = c if c in alphabet else "\0"
            state = moves[state].get(c) if c in moves[state] else self._move(state, c)
            if state < 0:
                return None
        return self.accepts[state]


def quotations(text: str) -> list[tuple[int, int]]:
    """Spans between quotation marks of one line, with something between them, in order and without overlaps; one pass."""
    spans: list[tuple[int, int]] = []
    opened: dict[str, int] = {}
    for m in MARK.finditer(text):
        mark, at = m[0], m.start()
        if mark == "\n":
            opened.clear()
            continue
        own = [opened[x] for x in CLOSES.get(mark, "") if x in opened]
        if own and min(own) + 1 < at:
            first = min(own)
            opened = {x: p for x, p in opened.items() if p < first}
            while spans and spans[-1][0] > first:
                spans.pop()
            spans.append((first, at + 1))
        elif mark in '"“«„‘':
            opened[mark] = at if mark == '"' else opened.get(mark, at)
    return spans


def score(text: str, automaton: LexiconAutomaton, lexicon: dict[str, float]) -> tuple[float, list[str]]:
    """The document's score and the distinct terms that it hits, in order of name."""
    low = text.lower()
    memo = automaton.memo
    words = WORD.findall(low)
    hits = [i for i, w in enumerate(words) if memo[w] is not None]
    if not hits:
        return 0.0, []
    spans = quotations(low)
    at = [m.start() for m in WORD.finditer(low)]
    total, span = 0.0, 0
    for i in hits:
        term, edits = memo[words[i]]
        while span < len(spans) and spans[span][1] <= at[i]:
            span += 1
        quoted = span < len(spans) and spans[span][0] < at[i]
        reported = not REPORTING.isdisjoint(words[max(0, i - WINDOW) : i + WINDOW + 1])
        factor = (0.1 if reported else 0.4) if quoted else 0.6 if reported else 1.0
        if not quoted and not SECOND_PERSON.isdisjoint(words[max(0, i - NEAR) : i + NEAR + 1]):
            factor *= 1.25
        total += lexicon[term] * automaton.per_edit[term] ** edits * factor
    return total, sorted({memo[words[i]][0] for i in hits})


def automaton_of(lexicon: dict[str, float], learned: dict[str, float] | None = None, ordinary: Iterable[str] | None = None) -> LexiconAutomaton:
    """This worker's automaton. Learned terms are in many languages: without ``ordinary`` words they match exactly."""
    own, exact = (learned or {}).keys() - lexicon.keys(), EXACT & lexicon.keys()
    exact, own = (exact | own, ()) if ordinary is None else (exact, own)
    terms = tuple(sorted(lexicon.keys() - EXACT)), tuple(sorted(exact)), tuple(sorted(own)), frozenset(ordinary or ())
    return per_worker(("toxicity", terms), lambda: LexiconAutomaton(*terms))


def ordinary_words(docs: DataFrame, lexicon: dict[str, float] = LEXICON, learned: dict[str, float] | None = None, text_col: str = "text") -> frozenset[str]:
    """Near misses of terms that the whole corpus uses too widely to be misspellings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = automaton_of(lexicon, learned, ()).memo
        for batch in slices(batches):
            seen = set()
            for text in batch.column(0).to_pylist():
                words = WORD.findall(text.lower()) if text else ()
                for i in [i for i, w in enumerate(words) if memo[w] is not None]:
                    term, edits = memo[words[i]]
                    around = hash64("\n".join(words[max(0, i - 1) : i] + ["", *words[i + 1 : i + 2]]))
                    seen.add((words[i] if edits else term, term, around))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*seen) if seen else ((), (), ()), (pa.string(), pa.string(), pa.int64()))], ["word", "term", "around"])

    each = docs.select(text_col).mapInArrow(run, "word string, term string, around bigint").distinct()
    n = cut(each.groupBy("word", "term").agg(F.count("*").alias("n")))
    terms = F.broadcast(n.where("word = term").select(F.col("term").alias("of"), F.col("n").alias("n_term")))  # a row per term at most
    near = n.where("word <> term").join(terms, F.col("term") == F.col("of"), "left")
    common = near.where((F.col("n") >= COMMON) & (F.col("n") >= COMMON_SHARE * F.coalesce("n_term", F.lit(0))))
    return frozenset(r[0] for r in common.select("word").collect())


def learned_terms(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict[str, float]:
    """Severities of the terms that the labelled sample teaches."""
    chosen = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample)
    )
    # At most ``sample`` rows, so it is broadcast.
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # One row per id, so that no more than the sample comes to the driver.
    picked = picked.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = MinHash()
        for batch in slices(batches):
            texts = batch.column(0).to_pylist()
            sigs = [make.mixed(t) for t in texts]
            found = ["\n".join(sorted({w for w in WORD.findall(t.lower()) if w.isalpha()})) if t else "" for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), pa.array(sigs, pa.binary()), pa.array(found, pa.string())], ["toxic", "sig", "words"])

    rows = picked.mapInArrow(words, "toxic int, sig binary, words string").where("sig IS NOT NULL").collect()
    rows = sorted((bytes(r["sig"]), r["words"], int(r["toxic"] > 0)) for r in rows)
    return terms_of(rows)


def terms_of(rows: list[tuple[bytes, str, int]]) -> dict[str, float]:
    """Terms and severities from (signature, distinct words a line each, toxic)."""
    kept = np.zeros((len(rows), len(rows[0][0]) if rows else 0), dtype=np.uint8)
    counts, n = (Counter(), Counter()), [0, 0]
    for sig, words, toxic in rows:
        own, k = np.frombuffer(sig, dtype=np.uint8), sum(n)
        if k and np.count_nonzero(kept[:k] != own, axis=1).min() <= COPY:
            continue
        kept[k] = own
        n[toxic] += 1
        counts[toxic].update(words.split("\n"))
    if not all(n):
        return {}
    share, out, weaker = n[1] / sum(n), {}, {}
    for word, hits in counts[1].items():
        others = counts[0][word]
        precision = hits / (hits + others)
        if word and precision > max(PRECISION, share):
            gap = precision * math.log(precision / share) + (0 if not others else (1 - precision) * math.log((1 - precision) / (1 - share)))
            if (hits + others) * gap >= NEAR_EVIDENCE:
                kind = out if (hits + others) * gap >= EVIDENCE else weaker
                kind[word] = (hits / (hits + others + 1)) ** 2
    near = LexiconAutomaton(out)
    return out | {word: s for word, s in weaker.items() if near.match(word)}


def toxicity(
    docs: DataFrame,
    lexicon: dict[str, float] = LEXICON,
    learned: dict[str, float] | None = None,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
    ordinary: Iterable[str] | None = None,
) -> DataFrame:
    """``id_col``, ``score``, ``terms`` and ``toxic`` of every row. A narrow map: nothing is shuffled."""
    severity = {**(learned or {}), **lexicon}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        automaton = automaton_of(lexicon, learned, ordinary)
        found = [score(t, automaton, severity) if t else (0.0, []) for t in batch.column(1).to_pylist()]
        scores, terms = [s for s, _ in found], [t for _, t in found]
        # A float sum of 0.99999 from factors that add up to 1 still counts.
        toxic = [s + 1e-9 >= threshold for s in scores]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(scores, pa.float64()), pa.array(terms, pa.list_(pa.string())), pa.array(toxic, pa.bool_())],
            [id_col, "score", "terms", "toxic"],
        )

    src = docs.select(id_col, text_col)
    return map_rows(src, run, f"`{id_col}` {src.schema[id_col].dataType.simpleString()}, score double, terms array<string>, toxic boolean")


def toxic_documents(docs: DataFrame, **params) -> DataFrame:
    """The toxic rows of ``toxicity``."""
    return toxicity(docs, **params).where("toxic")


def without_toxic(
    docs: DataFrame,
    lexicon: dict[str, float] = LEXICON,
    learned: dict[str, float] | None = None,
    threshold: float = THRESHOLD,
    text_col: str = "text",
    ordinary: Iterable[str] | None = None,
) -> DataFrame:
    """``docs`` with all its columns, less the toxic rows; judged row by row in place, so nothing is joined or shuffled."""
    severity = {**(learned or {}), **lexicon}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        automaton = automaton_of(lexicon, learned, ordinary)
        texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
        keep = [not t or score(t, automaton, severity)[0] + 1e-9 < threshold for t in texts]
        return batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(lambda batches: map(run, slices(batches)), docs.schema)


