"""The pipeline against a brute-force version, stage by stage and whole."""

import hashlib
import itertools
import math
import random
import re
from collections import defaultdict

import pytest
import tiktoken
from llm_rows import ROWS, SCHEMA

import corpus_pipeline
from siltscan.llm import bpe, mixing, neardup, secrets, toxicity


def documents(n=120, seed=11):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice(["an", "er", "th", "ou", "ing", "st", "re", "qu"]) for _ in range(rng.randint(1, 4))) for _ in range(2000)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 400))]
        if i % 9 == 0:
            words[2:2] = ["idiot", "you", "pathetic"] if i % 2 else ["what", "a", "dizgustin", "show"]
        if i % 8 == 5:
            words[1:1] = ["zorble", "grumf", "zorble", "brathelings"]
        if i in (111, 113):
            words[4:4] = ["bratheling" if i == 111 else "brathelinks", "and", "brathilings"]
        if i % 11 == 0:
            words[3:3] = [f'token = "{hashlib.md5(str(i).encode()).hexdigest()}"']
        if i % 10 == 0:
            words[4:4] = ['API_KEY="a1b2c3d4e5f6a7b8c9d0"']
        rows.append((i, " ".join(words), "en", rng.choice("aaaabbc"), len(" ".join(words))))
        if i % 5 == 0:
            copy = [w + "," if rng.random() < 0.1 else w for w in words]
            rows.append((1000 + i, " ".join(copy), "en", rng.choice("abc"), len(" ".join(copy))))
        if i % 7 == 0:
            rows.append((2000 + i, " ".join(words), "en", "a", len(" ".join(words))))
    return rows


LABELS = [(i, int(i % 9 == 0 or i % 8 == 5)) for i in range(110)]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute_learned(rows):
    """Terms that the labels teach, counted in plain Python; near copies among the labelled count once."""
    m, label = neardup.MinHash(), dict(LABELS)
    seen, n, held = [], [0, 0], (defaultdict(int), defaultdict(int))
    for sig, words, toxic in sorted((m.mixed(r[1]), "\n".join(sorted({w for w in re.findall(r"\w+", r[1].lower()) if w.isalpha()})), label[r[0]]) for r in rows if r[0] in label):
        if all(sum(x != y for x, y in zip(sig, s)) > toxicity.COPY for s in seen):
            seen.append(sig)
            n[toxic] += 1
            for w in words.split("\n"):
                held[toxic][w] += 1
    share, strength = n[1] / sum(n), {}
    for w, k in held[1].items():
        p = k / (k + held[0][w])
        if p > max(toxicity.PRECISION, share):
            strength[w] = (k + held[0][w]) * (p * math.log(p / share) + ((1 - p) * math.log((1 - p) / (1 - share)) if p < 1 else 0)), (k / (k + held[0][w] + 1)) ** 2
    sure = {w for w, (e, _) in strength.items() if e >= toxicity.EVIDENCE}
    near = {w for w, (e, _) in strength.items() if e >= toxicity.NEAR_EVIDENCE and any(edits(w, t) <= (0 if len(t) < 6 else 1 if len(t) < 10 else 2) for t in sure)}
    return {w: strength[w][1] for w in sure | near}


def brute_toxicity(rows):
    learned = brute_learned(rows)
    assert "zorble" in learned
    terms = {t: 1 if len(t) >= toxicity.LEARNED_LETTERS else 0 for t in learned}
    terms |= {t: 0 if len(t) < 6 or t in toxicity.EXACT else 1 if len(t) < 10 else 2 for t in toxicity.LEXICON}
    severity = {**learned, **toxicity.LEXICON}
    texts = {r: re.findall(r"[@$]?\w+(?:[@$!*]+\w+)*", r[1].lower()) for r in rows}
    hit = {}
    for w in {w for words in texts.values() for w in words}:
        plain = "".join(dict(zip("0134578@$!", "oieastbasi")).get(c, c) for c in w) if any(c.isalpha() for c in w) else w
        near = [(edits(plain, t), t) for t, most in terms.items() if abs(len(t) - len(plain)) <= most]
        near = [(e, t) for e, t in near if e <= terms[t]]
        if near and (w in terms or w not in toxicity.ORDINARY):
            hit[w] = min(near)
    around = defaultdict(set)
    for words in texts.values():
        for i, w in enumerate(words):
            if w in hit:
                around[w if hit[w][0] else hit[w][1]].add((words[i - 1] if i else None, words[i + 1] if i + 1 < len(words) else None))
    for w in [w for w in hit if hit[w][0]]:
        if len(around[w]) >= max(toxicity.COMMON, toxicity.COMMON_SHARE * len(around[hit[w][1]])):
            del hit[w]
    out = []
    for r, words in texts.items():
        total = 0
        for i, w in enumerate(words):
            if w in hit:
                e, t = hit[w]
                factor = 0.6 if set(words[max(0, i - 8) : i + 9]) & toxicity.REPORTING else 1.0
                factor *= 1.25 if set(words[max(0, i - 3) : i + 4]) & toxicity.SECOND_PERSON else 1
                total += severity[t] * (toxicity.PER_EDIT if t in toxicity.LEXICON else toxicity.LEARNED_EDIT) ** e * factor
        if total < toxicity.THRESHOLD - 1e-9:
            out.append(r)
    return out


def brute_dedup(rows):
    m = neardup.MinHash()
    sig = [m.signature(r[1]) for r in rows]
    group = list(range(len(rows)))
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, j in itertools.combinations(order, 2):
        if sig[i] and sig[j] and sum(x != y for x, y in zip(sig[i], sig[j])) <= neardup.RADIUS:
            a, b = find(i), find(j)
            if a != b:
                a, b = sorted((a, b), key=lambda k: rows[k][0])
                group[b] = a
    return [r for i, r in enumerate(rows) if find(i) == i]


def brute_secrets(rows):
    owners, repos, own = defaultdict(set), defaultdict(set), defaultdict(set)
    for doc, text, lang, source, *_ in rows:
        for m in re.findall(secrets.PATTERN, text or ""):
            q = re.search(secrets.QUOTED, m)
            s = q[1] if q else m
            if len(s) >= secrets.MIN_LENGTH and len(set(s)) >= secrets.MIN_DISTINCT and re.search("[A-Za-z]", s) and re.search("[0-9]", s):
                owners[s].add(source or "")
                repos[s].add((source or "", lang or ""))
                own[doc].add(s)
    out = []
    for doc, text, lang, source, n in rows:
        live = sorted((s for s in own.get(doc, ()) if len(owners[s]) <= secrets.MAX_OWNERS and len(repos[s]) <= secrets.MAX_REPOS), key=len, reverse=True)
        for s in live:
            text = text.replace(s, secrets.REDACTED)
        out.append((doc, text, lang, source, len(text) if live else n))
    return out


def _md5(*parts):
    return hashlib.md5("|".join([mixing.SEED, *map(str, parts)]).encode()).hexdigest()


#: The same expression as Python writes it.
TOKEN = re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), mixing.TOKEN)


def brute_mixing(rows, block_tokens=mixing.BLOCK_TOKENS, shard_tokens=mixing.SHARD_TOKENS, fraction=mixing.FRACTION):
    units = defaultdict(int)
    for doc, text, _, source, *_ in rows:
        units["" if doc is None else str(doc), source or ""] += len(re.findall(TOKEN, text or ""))
    totals = defaultdict(int)
    for (_, s), n in units.items():
        totals[s] += n
    n_shards = max(1, -(-sum(totals.values()) // shard_tokens))
    piles = defaultdict(list)
    for (i, s), n in units.items():
        piles[int(_md5("shard", i)[:8], 16) % n_shards, s].append((_md5("order", i), i, n))
    block, total = {}, defaultdict(int)
    for (shard, s), pile in piles.items():
        for _, i, n in sorted(pile):
            block[i, s] = (shard, total[shard, s] // block_tokens)
            total[shard, s] += n
    chosen = set()
    for shard in range(n_shards):
        there = defaultdict(set)
        for (_, s), (sh, b) in block.items():
            if sh == shard:
                there[s].add(b)
        n_blocks = {s: max(math.ceil(total[shard, s] / block_tokens), max(bs) + 1) for s, bs in there.items()}
        seats, won = math.ceil(sum(n_blocks.values()) * fraction - 1e-9), dict.fromkeys(there, 0)
        for _ in range(seats):
            open_ = [s for s in there if won[s] < n_blocks[s] and totals[s]]
            if not open_:
                break
            won[min(open_, key=lambda s: (-math.sqrt(totals[s]) / (2 * won[s] + 1), s))] += 1
        for s, bs in there.items():
            used = 0
            for b in sorted(bs, key=lambda b: (_md5("block", shard, s, b), b)):
                span = min([x for x in bs if x > b], default=n_blocks[s]) - b
                if used + span / 2 <= won[s]:
                    chosen.add((shard, s, b))
                used += span
    return [r for r in rows if (lambda i, s: (block[i, s][0], s, block[i, s][1]) in chosen)("" if r[0] is None else str(r[0]), r[3] or "")]


COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
BRUTE = [brute_toxicity, brute_dedup, brute_secrets, brute_mixing]


def test_each_stage_and_the_whole(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(LABELS, "doc_id bigint, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    left = rows
    for (name, stage), brute in zip(corpus_pipeline.STAGES, BRUTE):
        got = stage(spark, spark.createDataFrame(left, COLUMNS), str(tmp_path))
        assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        before, left = left, brute(left)
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, left)), name
        assert left != before, name
    ranks = bpe.Bpe(open(bpe.RANKS, "rb").read()).ranks
    oracle = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r.token_ids for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {r[0]: oracle.encode_ordinary(r[1]) for r in left}


@pytest.mark.parametrize("rows", [ROWS, []])
def test_every_stage_stands_awkward_tables(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    spark.createDataFrame(LABELS[: len(rows)], "doc_id bigint, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns and out.count() <= len(rows), name
    assert corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path)).count() == len(rows)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() <= len(rows)
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "secret_scan", "mixing", "bpe"]
