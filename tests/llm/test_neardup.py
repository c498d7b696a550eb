import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltscan.llm import neardup


def distance(a, b):
    return sum(x != y for x, y in zip(a, b))


def clustered(n=400, seed=1):
    """Signatures in clumps, so that there are pairs on both sides of the radius."""
    rng = np.random.default_rng(seed)
    out = [rng.integers(0, 256, neardup.SYMBOLS, dtype=np.uint8)]
    while len(out) < n:
        base = out[rng.integers(len(out))].copy() if rng.random() < 0.8 else rng.integers(0, 256, neardup.SYMBOLS, dtype=np.uint8)
        base[rng.permutation(neardup.SYMBOLS)[: rng.integers(0, 60)]] = rng.integers(0, 256)
        out.append(base)
    return np.unique(np.stack(out), axis=0)


def roots(n, edges):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("radius", [0, 1, 4, 7, 24, 25, 40])
def test_every_pair_within_the_radius_shares_a_key(radius):
    sigs = clustered()
    keys = neardup.chunk_keys(sigs, radius)
    near = [(i, j) for i, j in itertools.combinations(range(len(sigs)), 2) if distance(sigs[i], sigs[j]) <= radius]
    assert all((keys[i] == keys[j]).any() for i, j in near)
    assert sum(e + 1 for _, e in neardup.chunking(neardup.SYMBOLS, radius)) > radius


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(13, 60), st.integers(1, 45))
def test_bucket_edges_connect_what_pairs_connect(seed, n, radius):
    sigs = clustered(n, seed)
    pairs = [(i, j) for i, j in itertools.combinations(range(len(sigs)), 2) if distance(sigs[i], sigs[j]) <= radius]
    edges = neardup.bucket_edges(sigs, radius)
    assert set(map(tuple, map(sorted, edges))) <= set(pairs)
    assert roots(len(sigs), edges) == roots(len(sigs), pairs)


@pytest.mark.parametrize("few", [neardup.FEW, 2])
def test_join_equals_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(neardup, "FEW", few)
    sigs = clustered(250, 3)
    reps = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sigs)], "sid bigint, sig binary")
    pairs = {(i, j): d for i, j in itertools.combinations(range(len(sigs)), 2) if (d := distance(sigs[i], sigs[j])) <= neardup.RADIUS}
    got = neardup.hamming_pairs(reps)
    assert {tuple(sorted((r.a, r.b))): r.distance for r in got.collect()} == pairs and got.count() == len(pairs)
    found = {r.node: r.root for r in neardup.components(neardup.hamming_edges(reps)).collect()}
    want = roots(len(sigs), pairs)
    assert [found.get(i, i) for i in range(len(sigs))] == want


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randint(50, 90), rng.randint(50, 90)) for _ in range(30)] + [(100, k) for k in range(101, 160)]
    want = roots(200, edges)
    got = {r.node: r.root for r in neardup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert [got.get(i, i) for i in range(200)] == want
    assert neardup.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_signature_is_the_minimum_of_each_hash():
    m = neardup.MinHash()
    text = " ".join(f"w{i % 700}" for i in range(5000))
    s = m.shingles(text).astype(object)
    want = bytes(int(min((x * int(a) + int(b)) & 0xFFFFFFFF for x in set(s))) & 0xFF for a, b in zip(m.a, m.b))
    assert m.signature(text) == want
    assert [m.signature(t) for t in (None, "", " \n", "!?")] == [None] * 4 and m.signature("word") is not None


def test_short_texts_stay_apart():
    """Unmixed, 4,000 texts of one shingle had 256 signatures in all."""
    m, rng = neardup.MinHash(), random.Random(12)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(9000)]
    texts = words[:2000] + [f"{a} {b}" for a, b in zip(words[2000:4000], words[4000:6000])] + [" ".join(words[i : i + 3]) for i in range(6000, 9000, 3)]
    sigs = np.stack([np.frombuffer(m.mixed(t), dtype=np.uint8) for t in texts])
    assert all(np.count_nonzero(sigs[i + 1 :] != s, axis=1).min() > neardup.RADIUS for i, s in enumerate(sigs[:-1]))
    # The share of equal symbols is still the Jaccard similarity.
    a, b = " ".join(words[:401]), " ".join([*words[:301], *words[500:600]])
    assert abs(distance(m.mixed(a), m.mixed(b)) / neardup.SYMBOLS - 0.4) < 0.15


def test_wide_symbols_share_next_to_no_key():
    rng, shared, narrow = np.random.default_rng(3), [], []
    for column in range(3):  # keys of the first chunk, of the fewest symbols, and of the last
        for symbol, out in ((np.uint16, shared), (np.uint8, narrow)):
            sigs = rng.integers(0, np.iinfo(symbol).max + 1, (2_000_000, 4), dtype=symbol)
            key = neardup.chunk_keys(sigs, 1)[:, column]
            out.append(len(key) - len(np.unique(key)))
    assert sum(shared) <= 3 and sum(narrow) > 100_000
    m, words = neardup.MinHash(), [f"w{i}" for i in range(900)]
    for a, b in ((words[:400], words[:300] + words[500:600]), (words[:1], words[1:2]), (["漢字"], ["仮名"])):
        wa, wb, ma, mb = (np.frombuffer(f(" ".join(x)), dtype=t) for f, t in ((m.wide, np.uint16), (m.mixed, np.uint8)) for x in (a, b))
        assert (wa >> 8 == ma).all() and (wb >> 8 == mb).all() and np.count_nonzero(wa != wb) >= np.count_nonzero(ma != mb)


def test_texts_without_spaces_have_near_copies(spark):
    rng = random.Random(4)
    text = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(400))
    rows = [(1, text), (2, text[:200] + "変" + text[201:]), (3, "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(400))), (4, f"latin {text} words")]
    got = {r.doc_id: r.keep_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {2: 1, 4: 1}


def test_distinct_short_documents_are_all_kept(spark):
    rows = [(i, f"word{i}" + (f" next{i}" if i % 2 else "") + (f" third{i}" if i % 4 == 3 else "")) for i in range(2000)] + [(5000, "Word7, next7 third7")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: r.keep_id for r in neardup.near_duplicates(df).collect()} == {5000: 7}


def planted():
    """Originals, copies with words replaced here and there, punctuation and case changed, and unrelated texts with a shared passage."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice(["an", "er", "th", "ou", "ing", "st", "re"]) for _ in range(rng.randint(1, 4))) for _ in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    docs, groups = [], []
    for g in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(60, 500))]
        if g % 3 == 0:
            at = rng.randint(0, len(words))
            words[at:at] = passage if len(words) > 300 else []
        group = [len(docs)]
        docs.append(" ".join(words))
        for _ in range(g % 4):
            copy = [rng.choice(vocabulary) if rng.random() < 0.03 else w.capitalize() if rng.random() < 0.05 else w + "," if rng.random() < 0.05 else w for w in words]
            group.append(len(docs))
            docs.append(" ".join(copy))
        groups.append(group)
    return docs, groups


def test_planted_copies_are_found_and_nothing_else(spark):
    docs, groups = planted()
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    got = {r.doc_id: r.keep_id for r in neardup.near_duplicates(df).collect()}
    assert got == {d: g[0] for g in groups for d in g[1:]}
    left = sorted(r.doc_id for r in neardup.without_near_duplicates(df).collect())
    assert left == [g[0] for g in groups]


def test_large_groups_of_copies(spark):
    docs, _ = planted()
    rows = [(i, docs[0]) for i in range(1500)] + [(2000 + i, docs[0] + f" tail{i}") for i in range(200)] + [(5000, docs[-1])]
    got = {r.doc_id: r.keep_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: 0 for i, _ in rows if i not in (0, 5000)}


def test_awkward_rows(spark, awkward, empty):
    assert {r.doc_id: r.keep_id for r in neardup.near_duplicates(awkward).collect()} == {2: 1}
    out = neardup.without_near_duplicates(awkward)
    assert out.columns == awkward.columns
    count = defaultdict(int)
    for r in out.collect():
        count[r.doc_id] += 1
    assert count == {1: 1, 3: 1, 4: 1, 5: 1, 6: 1, None: 1, 7: 1, 8: 1, 9: 1}
    assert [r.text for r in out.where("doc_id = 8").collect()] == ["quite another text with the very same identifier"]
    assert neardup.near_duplicates(empty).count() == 0 and neardup.without_near_duplicates(empty).count() == 0
