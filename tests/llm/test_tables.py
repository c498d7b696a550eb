import itertools
import random
import re
from html.parser import HTMLParser

import duckdb
import numpy as np
import pytest
from llm_rows import ROWS, SCHEMA
from pyspark.sql import functions as F

from siltscan.llm import ann, html, mixing, sharding

# Mixing.


def corpus(spark, n=600, seed=1):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * int(rng.expovariate(1 / 300))), "en", rng.choice(["a"] * 6 + ["b", "b", "c", None]), 1) for i in range(n)]
    rows += [(5, "again and again", "en", "b", 1), (None, "x y", "en", "a", 1), (n + 1, None, "en", "c", 1), (n + 2, "long " * 9000, "en", "c", 1)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


def sainte_lague(weights, there, seats):
    """One seat at a time to the highest quotient."""
    won = dict.fromkeys(weights, 0)
    for _ in range(seats):
        open_ = [s for s in weights if won[s] < there[s] and weights[s] > 0]
        if not open_:
            break
        s = min(open_, key=lambda s: (-weights[s] / (2 * won[s] + 1), s))
        won[s] += 1
    return won


def test_apportionment_equals_one_seat_at_a_time(spark):
    rng = random.Random(4)
    for _ in range(4):
        sources = [f"s{i}" for i in range(rng.randint(1, 6))]
        cases = {sh: ({s: float(rng.randint(1, 9)) for s in sources}, {s: rng.randint(1, 12) for s in sources}, rng.randint(0, 40)) for sh in range(8)}
        blocks = spark.createDataFrame([(sh, s, w[s], there[s]) for sh, (w, there, _) in cases.items() for s in sources], "shard bigint, source string, weight double, n_blocks bigint")
        seats = spark.createDataFrame([(sh, n) for sh, (*_, n) in cases.items()], "shard bigint, n_seats bigint")
        got = {(r.shard, r.source): r.quota for r in mixing.apportion(blocks, seats).collect()}
        want = {(sh, s): q for sh, (w, there, n) in cases.items() for s, q in sainte_lague(w, there, n).items() if q}
        assert got == want


def test_mixture_equals_sql_and_keeps_to_the_weights(spark):
    df = corpus(spark)
    got = [tuple(r) for r in mixing.mixture(df).collect()]
    con = duckdb.connect()
    documents = df.toPandas().astype({"doc_id": "Int64"})  # noqa: F841
    con.register("documents", documents)
    assert sorted(map(str, con.sql(mixing.ORACLE).fetchall())) == sorted(map(str, got))
    assert 0.5 < sum(r[-1] for r in got) / sum(r.tokens for r in mixing.units(df).collect()) < 0.9
    chosen = {(r[0], r[1]) for r in got}
    rows = mixing.mixed(df)
    assert rows.columns == df.columns
    assert sorted(str((r.doc_id, r.source)) for r in rows.collect()) == sorted(str((r.doc_id, r.source)) for r in df.collect() if (r.doc_id, r.source or "") in chosen)


def test_given_weights_and_shards(spark):
    df = corpus(spark, 3000, 2)
    got = mixing.mixture(df, weights={"a": 1.0, "b": 1.0}, fraction=0.3, block_tokens=256, shard_tokens=60_000).groupBy("source").agg(F.sum("tokens").alias("n"), F.countDistinct("shard").alias("s")).collect()
    n = {r.source: r.n for r in got}
    assert set(n) == {"a", "b"} and 0.85 < n["a"] / n["b"] < 1.2 and all(r.s > 8 for r in got)
    assert mixing.mixture(df, weights={}).count() == 0


def test_long_documents_cost_the_blocks_they_span(spark):
    """Shares by tokens keep to the quota within a block, or half of a long document, whatever the lengths."""
    rng = random.Random(5)
    rows = [(i, "x " * 4000, "en", "long", 1) for i in range(60)] + [(1000 + i, "y " * rng.randint(1, 200), "en", "short", 1) for i in range(2400)]
    rows += [(9000 + i, "漢" * 100, "ja", "signs", 1) for i in range(2400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    n = {r.source: r.t for r in mixing.units(df).groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    assert n["long"] == n["signs"] == 240_000
    for long, block in ((1, 512), (2, 512), (1, 5000)):
        got = mixing.mixture(df, weights={"long": float(long), "short": 1.0, "signs": 1.0}, fraction=0.3, block_tokens=block, shard_tokens=10**9).groupBy("source").agg(F.sum("tokens").alias("t")).collect()
        got, whole = {r.source: r.t for r in got}, 0.3 * sum(n.values())
        for s, weight in (("long", long), ("short", 1), ("signs", 1)):
            assert abs(got[s] - whole * weight / (long + 2)) <= 2 * block + (2000 if s == "long" else 200), (s, got, block)
    one = spark.createDataFrame([(1, "a b c", "en", "a", 5)], df.schema)
    assert mixing.mixture(one).count() == 1
    given = mixing.mixture(one.withColumn("n_tokens", F.lit(77)), tokens_col="n_tokens").collect()
    assert [(r.doc_id, r.tokens) for r in given] == [(1, 77)]


def test_native_counts_go_with_the_tokenizers(spark):
    from siltscan.llm import tokens

    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    exact = tokens.token_counts(df).join(df.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("n_tokens").alias("t"))
    native = mixing.units(df).groupBy("source").agg(F.sum("tokens").alias("n"))
    ratio = [r.t / r.n for r in exact.join(native, "source").collect()]
    assert len(ratio) > 10 and max(ratio) / min(ratio) < 1.25


def test_mixing_of_awkward_rows(spark, awkward, empty):
    every = mixing.mixed(awkward, fraction=1.0)
    assert every.columns == awkward.columns and every.count() == len(ROWS)
    assert mixing.mixture(awkward, fraction=1.0).count() == len({(r[0], r[3]) for r in ROWS})
    assert mixing.mixed(empty).count() == mixing.mixture(empty).count() == 0


# Sharding.


def test_hilbert_curve_visits_every_cell_by_unit_steps():
    cells = np.array(list(itertools.product(range(16), repeat=3)))
    at = sharding.hilbert_index(cells)
    path = cells[np.argsort(at)]
    assert sorted(at) == list(range(4096)) and (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
    square = np.array(list(itertools.product(range(8), repeat=2)))
    path = square[np.argsort(sharding.hilbert_index(square, 3))]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_shards_cover_evenly_and_prune(spark):
    rng = random.Random(6)
    rows = [(i, "", rng.choice("abcdefgh"), f"s{rng.randint(0, 30)}", int(rng.expovariate(1 / 3000))) for i in range(5000)] + [(10_000 + i, "", "a", "s0", 2000) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    size = 200_000
    got = sharding.shards(df, size).join(df, "doc_id").toPandas()
    assert len(got) == len(rows)
    totals = got.groupby("shard").n_chars.sum()
    assert set(got["shard"]) == set(range(int(got["shard"].max()) + 1)) and totals.max() < 2.2 * size
    light = got.groupby("shard").hilbert.agg(["min", "max"]).sort_index()
    assert (light["min"].to_numpy()[1:] >= light["max"].to_numpy()[:-1]).all()
    assert got.groupby("shard").lang.nunique().mean() < 4


def test_sharding_of_awkward_rows(spark, awkward, empty):
    odd = awkward.unionByName(spark.createDataFrame([(50, "x", "en", "a", -5, "s", 0.0, "s"), (51, "x", "en", "a", 1 << 40, "s", 0.0, "s")], SCHEMA))
    got = sharding.shards(odd)
    assert got.count() == len(ROWS) + 2 and got.columns == ["doc_id", "hilbert", "shard"] and got.where("hilbert IS NULL OR shard IS NULL").count() == 0
    documents = odd.select("doc_id", "lang", "source", "n_chars").toPandas().astype({"doc_id": "Int64", "n_chars": "Int64"})  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    assert sorted(map(str, con.sql(sharding.ORACLE).fetchall())) == sorted(str(tuple(r)) for r in got.collect())
    assert sharding.shards(empty).count() == 0


# HTML.


def page(body, chrome="menu one two three four five six seven"):
    return f'<!DOCTYPE html><html><head><title>T, with, commas, in, it, and a long line of words</title><style>p{{}}</style></head><body><nav>{chrome}</nav>{body}<footer>&copy; x</footer></body></html>'


TEXT = "A sentence that is long enough to count, with commas, and &amp; an entity."


def test_scan_and_text():
    path, text = html.extract(page(f'<div class="post-12 big"><h1>Title</h1><p>{TEXT}<br>More <b>bold</b> text.<p>{TEXT}</div>'), None)
    assert path == "/html/body/div.post-#"
    assert text.split("\n") == ["Title", TEXT.replace("&amp;", "&"), "More bold text.", TEXT.replace("&amp;", "&")]


def test_all_that_the_winner_contains_is_extracted():
    said = TEXT.replace("&amp;", "&")
    links = "".join(f"<a href=/x>link number {i} of many</a> " for i in range(9))
    inner = f"<p>{TEXT} one</p><blockquote>{TEXT} quote<p>second</blockquote><div class=box>{TEXT} box</div><div class=rel>{links}</div><aside>{TEXT} aside</aside><table><tr><td>cell</td></tr></table><p>{TEXT} two</p><p>{TEXT} three</p>"
    path, text = html.extract(page(f"<article>{inner}</article>"), None)
    assert path == "/html/body/article"
    assert text.split("\n") == [f"{said} one", f"{said} quote", "second", f"{said} box", "cell", f"{said} two", f"{said} three"]
    split = "".join(f"<section class={c}><p>{TEXT} {c}</p></section>" for c in ("first", "second", "third"))
    path, text = html.extract(page(f"<main>{split}</main>"), None)
    assert path == "/html/body/main" and text.split("\n") == [f"{said} {c}" for c in ("first", "second", "third")]
    assert html.extract("<div>" * 3000 + TEXT, "/div")[1] == said


def test_links_and_chrome_lose():
    links = "".join(f'<a href="/x">{TEXT}</a>' for _ in range(5))
    assert html.extract(page(f"<div class=links>{links}</div><nav>{TEXT * 9}</nav><article>{TEXT}</article>"), None)[0] == "/html/body/article"


@pytest.mark.parametrize("broken", ["<", "<div", "<div class='a", "</div></div>", "<div><p>x", "<!-- open", "<script>var a = '</p>'", "<a><a><a></a>", "a < b > c", "<a '" * 3000, '<p x="<', "<" * 5000, "", "\x00", "<div/>x", "<br/><DIV CLASS=Q>t</Div>"])
def test_broken_markup_never_raises(broken):
    for p in (broken, page(broken), broken * 3):
        html.extract(p, None)
        html.extract(p, "/html/body/article")


def test_consensus_outvotes_a_page(spark, empty):
    good = page(f"<div class=ad>short, ad</div><article>{TEXT * 3}</article>")
    rows = [(i, "https://A.example.org:80/x", good) for i in range(5)] + [(5, "http://u@a.example.org/y", page(f"<div class=ad>{TEXT}</div><article>tiny</article>"))]
    rows += [(6, "http://b.example.org", page(f"<main>{TEXT}</main>")), (7, None, page(f"<main>{TEXT}</main>")), (8, "not a url", None), (9, "http://a.example.org", ""), (10, "http://a.example.org/z", page(f"<section>{TEXT}</section>"))]
    rows += [(0, "https://A.example.org:80/x", good)]
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], "page_id bigint, url string, html string, host int, path string")
    got = sorted(html.extracted(df).collect(), key=lambda r: r.page_id)
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert {r.host for r in got} == {"a.example.org", "b.example.org", ""}
    assert by[5].path == "/html/body/article" and by[5].text == "tiny"
    assert by[6].path == by[7].path == "/html/body/main" and by[10].path == "/html/body/section"
    assert (by[8].path, by[8].text, by[9].text) == (None, None, None)
    # Brute force: the votes counted in plain Python.
    votes = {}
    for i, _, p in rows:
        if p and (b := html.best(html.scan(p))):
            key = (by[i].host, b[0])
            votes[key] = votes.get(key, 0) + round(1000 * b[1])
    want = {h: min((-v, p) for (g, p), v in votes.items() if g == h)[1] for h, _ in votes}
    assert {r.host: r.path for r in html.winning_paths(df).collect()} == want
    assert html.extracted(df.limit(0)).count() == 0


def test_cells_need_no_end_tags():
    cells = "".join(f"<tr><td class=c>{TEXT} {i}<td class=c><div>inner {i}" for i in range(4))
    for rows in (cells, cells.replace("<td", "</td><td").replace("<tr>", "</tr><tr>")):
        scanned = html.scan(f"<table><tr>{rows}</table><div>after</div>")
        assert {scanned.path(c) for c in scanned} == {"", "/td.c", "/td.c/div", "/div"}
    nested = html.scan(f"<table><tr><td class=a>{TEXT}<table><tr><td class=b>x<td class=b>y</table>still a<td class=d>z</table>")
    assert [nested.path(c) for c in nested] == ["", "/td.a", "/td.a/td.b", "/td.a/td.b", "/td.d"]
    assert "".join(html.subtree(nested[1])).split()[-2:] == ["still", "a"]


def test_long_and_deep_pages_take_linear_memory():
    import tracemalloc

    tracemalloc.start()
    deep = html.extract("<div class=x1>" * 200_000 + TEXT, None)
    wide = html.extract("<td>" * 200_000 + TEXT, None)
    long = html.extract(page(f"<article>{('<p>' + TEXT) * 140_000}</article>"), "/html/body/article")
    used = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    said = TEXT.replace("&amp;", "&")
    assert deep == ("/div.x#" * 200_000, said) and wide == ("/td", said) and long[1] == "\n".join([said] * 140_000)
    assert used < 400e6


class Tree(HTMLParser):
    """Another reading of the same rules: a tree by the standard library's parser, scored by recursion."""

    def __init__(self, text):
        super().__init__(convert_charrefs=True)
        self.root = self.node = {"path": "", "tag": "", "up": None, "kids": []}
        self.links = self.skip = 0
        self.feed(text)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "title", "noscript", "template")
        self.links += tag == "a"
        if tag in html.BREAKS:
            self.node["kids"].append("\n")
        if tag in html.CONTAINERS:
            name = (dict(attrs).get("class") or "").split()
            step = tag + ("." + re.sub("[0-9]+", "#", name[0].lower()) if name else "")
            self.node["kids"].append({"path": f"{self.node['path']}/{step}", "tag": tag, "up": self.node, "kids": []})
            self.node = self.node["kids"][-1]

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "title", "noscript", "template")
        self.links = max(0, self.links - (tag == "a"))
        if tag in html.BREAKS:
            self.node["kids"].append("\n")
        if tag in html.CONTAINERS:
            assert self.node["tag"] == tag, "the pages of this test are well formed"
            self.node = self.node["up"]
            self.node["kids"].append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.node["kids"].append((data, bool(self.links)))

    def judge(self, node, chrome=False):
        """Value, linked and whole size, and text of a node; and its place in ``found``."""
        chrome = chrome or node["tag"] in html.CHROME
        score = linked = size = passed = all_linked = all_size = 0
        text, place = "", len(self.found)
        self.found.append(None)
        for kid in node["kids"]:
            if isinstance(kid, str):
                text += kid
            elif isinstance(kid, tuple):
                n, raw = len(kid[0].strip()), kid[0].replace("\n", " ")
                text += raw if n else " " if text else ""
                size, linked = size + n, linked + n * kid[1]
                if n >= 25 and not kid[1]:
                    score += 1 + raw.count(",") + min(n / 100, 3)
            else:
                v, kid_linked, kid_size, kid_text = self.judge(kid, chrome)
                if kid["tag"] not in html.CHROME and kid_linked <= 0.5 * kid_size:
                    all_linked, all_size, passed, text = all_linked + kid_linked, all_size + kid_size, passed + 0.7 * v, text + kid_text
        own = score * (1 - linked / size) * (0.1 if chrome else 1) if size else 0
        self.found[place] = node["path"], own + passed, size - linked, all_size + size, text
        return own + passed, all_linked + linked, all_size + size, text

    def containers(self):
        self.found = []
        self.judge(self.root)
        return self.found


def test_extraction_equals_another_reading_of_the_rules(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    pages = {r.page_id: (re.match("[a-z]+://([^/:?#]*)", r.url)[1].lower() if r.url else "", r.html) for r in df.collect()}
    trees, votes = {}, {}
    for i, (host, text) in pages.items():
        if text:
            trees[i] = Tree(text).containers()
            path, v, _, n, _ = max(trees[i], key=lambda c: (round(c[1], 9), c[2]))
            if n:
                votes.setdefault(host, {}).setdefault(path, 0)
                votes[host][path] += round(1000 * v)
    won = {h: min((-v, p) for p, v in paths.items())[1] for h, paths in votes.items()}
    got = {r.page_id: (r.host, r.path, r.text) for r in html.extracted(df).collect()}
    assert got.keys() == pages.keys() and len(pages) > 200
    for i, (host, text) in pages.items():
        path = won.get(host)
        if i in trees and not any(p == path and n for p, _, _, n, _ in trees[i]):
            path = max(trees[i], key=lambda c: (round(c[1], 9), c[2]))[0]
        lines = [re.sub("[ \t\r]+", " ", x).strip() for p, _, _, n, t in trees.get(i, []) if p == path and n for x in t.split("\n")]
        want = "\n".join(filter(None, lines))
        assert got[i] == (host, path if i in trees else None, want if i in trees else None), i


# Nearest neighbours.


def exact(ids, x, k):
    d = np.sqrt(((x[:, None].astype(np.float64) - x[None]) ** 2).sum(-1))
    out = {}
    for i in range(len(x)):
        order = sorted((d[i, j], ids[j]) for j in range(len(x)) if j != i)[:k]
        out[ids[i]] = order
    return out


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 24)) * 2
    x = (centres[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 24))).astype(np.float32)
    ids = list(range(100, 3100))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id bigint, embedding array<float>")
    got = ann.neighbours(df, shard_rows=1200).collect()
    want = exact(ids, x, 10)
    found = {}
    for r in got:
        found.setdefault(r.vec_id, {})[r["rank"]] = (r.distance, r.neighbor_id)
    assert set(found) == set(ids) and all(sorted(f) == list(range(1, 11)) for f in found.values())
    assert np.mean([len({n for _, n in found[i].values()} & {n for _, n in want[i]}) / 10 for i in ids]) >= 0.95
    assert all(abs(d - np.linalg.norm(x[i - 100].astype(float) - x[n - 100].astype(float))) < 1e-4 for i in ids[:200] for d, n in found[i].values())


def test_pruning_keeps_no_edge_that_another_makes_needless():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    points, cand = np.arange(20), np.array([rng.permutation(300)[:60] for _ in range(20)], dtype=np.int32)
    dist = ann._distances(x[points], x[cand])
    out = ann.prune(points, cand, dist, x, 12, 1.2)
    for p, row, own in zip(points, out, cand):
        kept, left = [], sorted((c for c in own if c != p), key=lambda c: ((x[p] - x[c]) ** 2).sum())
        while left and len(kept) < 12:
            kept.append(left.pop(0))
            left = [c for c in left if 1.44 * ((x[kept[-1]] - x[c]) ** 2).sum() > ((x[p] - x[c]) ** 2).sum() + 1e-6]
        assert [c for c in row if c >= 0] == kept


def test_vectors_that_are_awkward(spark):
    same = [0.5, 0.5]
    rows = [(i, same) for i in range(30)] + [(40, [3.0, 4.0]), (40, [9.0, 9.0]), (41, None), (42, []), (43, [1.0, 2.0, 3.0]), (44, [None, 1.0]), (45, [float("nan"), 1.0]), (None, [1.0, 1.0]), (46, [float("inf"), 0.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id bigint, embedding array<float>, rank int, ids int")
    got = ann.neighbours(df).collect()
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append((r["rank"], r.neighbor_id, round(r.distance, 4)))
    assert set(by) == {*range(30), 40}
    assert [n for _, n, _ in sorted(by[29])] == list(range(10)) and [n for _, n, _ in sorted(by[0])] == list(range(1, 11))
    assert sorted(by[40])[0] == (1, 0, round(float(np.hypot(2.5, 3.5)), 4))
    assert {r.reason: r.n for r in ann.left_out(df).collect()} == {"no id": 1, "no finite vector": 5, "other length": 1}
    assert ann.left_out(df.limit(0)).count() == 0 == ann.neighbours(df.limit(0)).count()
    assert ann.neighbours(df.where("vec_id = 40")).count() == 0
    assert [(r.vec_id, r.neighbor_id) for r in ann.neighbours(df.where("vec_id IN (3, 40)")).orderBy("vec_id").collect()] == [(3, 40), (40, 3)]
