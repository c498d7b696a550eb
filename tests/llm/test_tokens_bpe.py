import random

import pytest
import tiktoken
from llm_rows import LONG, ROWS
from tokenizers import models

from siltscan.llm import bpe, tokens

MODEL = open(tokens.MODEL, "rb").read()
RANKS = open(bpe.RANKS, "rb").read()


def texts(n=300):
    rng = random.Random(3)
    alphabet = "etaoinshrdlu  \n.,'éüñ漢字🙂▁X0\t"
    own = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    words = ["hello", "world", "don't", "naïve", "ſtraße", "    ", "12345", "e" * 70, "ab" * 300, "\r\n", "日本語"]
    return own + [" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(n)] + ["", " ", "  ", "\n", "\n\n ", " a ", "▁", "a▁ b"]


def test_counts_equal_the_tokenizer():
    vocabulary = [(p, s if kind == tokens.NORMAL else -1e9) for p, s, kind in tokens.vocabulary(MODEL)]
    oracle = models.Unigram(vocabulary, unk_id=0, byte_fallback=True)
    c = tokens.UnigramCounter(tokens.vocabulary(MODEL))
    some = texts()
    want = [len(oracle.tokenize("▁" + t.replace(" ", "▁"))) if t else 0 for t in some]
    assert c.counts(some) == want
    assert c.counts([None]) == [None]


def brute(word, pieces, unknown):
    """All segmentations' best, in the order of the rule: by end, longest piece first, strictly better wins."""
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        options = [(best[s][0] + pieces[word[s:end]], best[s][1] + 1) for s in range(end) if word[s:end] in pieces]
        if word[end - 1] not in pieces:
            options.append((best[end - 1][0] + unknown, best[end - 1][1] + len(word[end - 1].encode())))
        top = options[0]
        for o in options[1:]:
            top = o if o[0] > top[0] else top
        best.append(top)
    return best[-1][1]


def test_ties_go_to_the_longer_piece():
    rng = random.Random(9)
    own = [("▁", -3.0, 1)] + [("".join(rng.choice("abc") for _ in range(rng.randint(1, 4))), float(-rng.randint(1, 4)), 1) for _ in range(40)]
    own = list({p: (p, s, k) for p, s, k in own}.values())
    c = tokens.UnigramCounter(own + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)])
    pieces = {p: s for p, s, _ in own}
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 50))) for _ in range(300)]
    assert c.counts(words) == [brute("▁" + w, pieces, c.unknown) for w in words]
    assert [c.viterbi("▁" + w) for w in words] == c.counts(words)


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_ENTRIES", 50)
    c = tokens.UnigramCounter(tokens.vocabulary(MODEL))
    got = [c.counts([f"word{i} {i}"])[0] for i in range(200)]
    assert len(c.memo) <= 50 and got == tokens.UnigramCounter(tokens.vocabulary(MODEL)).counts([f"word{i} {i}" for i in range(200)])


def test_long_words_stay_out_of_the_memos(codec):
    c = tokens.UnigramCounter(tokens.vocabulary(MODEL))
    for part in range(10):
        words = [f"{part}x{i}" + "q" * 2000 for i in range(100)] + ["short"]
        assert c.counts(words)[0] == c.counts(words[:1])[0] > 1 and codec.decode(codec.encode(words[3])) == words[3]
    for memo in (c.memo, codec.memo):
        assert memo and max(map(len, memo)) <= 64


def test_token_counts_of_awkward_rows(spark, awkward, empty):
    c = tokens.UnigramCounter(tokens.vocabulary(MODEL))
    got = tokens.token_counts(awkward)
    assert got.columns == ["doc_id", "n_tokens"]
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.createDataFrame([(r[0], c.counts([r[1]])[0]) for r in ROWS], "doc_id bigint, n_tokens bigint").collect()))
    assert tokens.token_counts(empty).count() == 0


@pytest.fixture(scope="module")
def codec():
    return bpe.Bpe(RANKS)


@pytest.fixture(scope="module")
def oracle(codec):
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def test_encoding_equals_the_tokenizer(codec, oracle):
    for t in [*texts(), "x" * 5000, "ab" * 2000, "<|endoftext|>", LONG[:3000]]:
        assert codec.encode(t) == oracle.encode_ordinary(t)
        assert codec.decode(codec.encode(t)) == t


def test_three_ways_to_merge_agree(codec):
    rng = random.Random(4)
    for size in (2, 3, 7, 20, 40):
        words = [bytes(rng.choice(b"etaoin shr\xc3\xa9") for _ in range(size)) for _ in range(200)]
        packed = codec.merge_many(words)
        for w, p in zip(words, packed):
            ids = [int.from_bytes(p[i : i + 4], "little") for i in range(0, len(p), 4)]
            if w not in codec.ranks:
                assert ids == codec.merge(w) == codec.merge_long(w)


def test_bpe_of_awkward_rows(spark, awkward, empty, oracle):
    got = bpe.encode(awkward)
    assert got.columns == ["doc_id", "token_ids", "round_trip"]
    want = sorted(str((r[0], None if r[1] is None else oracle.encode_ordinary(r[1]), None if r[1] is None else True)) for r in ROWS)
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    assert sorted(str(tuple(r)) for r in bpe.decode(got).collect()) == sorted(str((r[0], r[1])) for r in ROWS)
    assert bpe.encode(empty).count() == 0 and bpe.decode(bpe.encode(empty)).count() == 0
