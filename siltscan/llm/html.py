"""HTML extraction by consensus host paths.

A page is scanned once by a tokenising regular expression (no tree is built). Text goes to the innermost open
container; each paragraph-like stretch of text scores it (a point, one for each comma, up to three for length), and text
inside links counts against it. ``PASSED`` of a container's value counts for the one around it too, chrome aside, so that
content split over several containers is won by what holds them all. A container's path is its chain of tags with their first class, digits generalised to
``#`` and slashes turned to bars. Every page votes for the path of its best container with that container's score; in Spark the votes of a host are
summed and the highest total wins (ties: the first path by name). Each page is then extracted again by its host's path:
the text of every container there, with all that it contains in document order but for chrome and containers of mostly
linked text, or of the page's own best container where the page has none.

A cell ends where the next cell or row of its table starts, with or without an end tag. Time and memory are linear in a
page's length, however long it is and however deeply it nests.

Null or empty pages and pages without text give null text and path. Repeated rows give repeated results and vote as often;
an empty table gives no rows. Null hosts, and urls without a host, form one host
''. Broken markup never raises: unknown end tags are ignored and open elements close with their parents.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltscan.llm._common import slices, small

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!\w[^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*'|[\"'])*+)>",
    re.S | re.I,
)
CLASS = re.compile(r"""\bclass\s*=\s*(?:"\s*([^\s"]+)|'\s*([^\s']+)|([^\s"'>]+))""", re.I)
CONTAINERS = frozenset("html body article section main div td aside nav header footer form blockquote".split())
BREAKS = CONTAINERS | frozenset("p br li ul ol table tr h1 h2 h3 h4 h5 h6 pre dl dt dd hr figure figcaption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROWS = frozenset("td th tr tbody thead tfoot".split())
CHROME = frozenset("nav aside header footer form".split())
DIGITS = re.compile(r"\d+")
SPACES = re.compile(r"[ \t\r\f\v]+")
LONG = 25
#: Share of a container's value that its parent gets; share of linked text above which a container in another is left out.
PASSED, LINKED = 0.7, 0.5


class Container:
    __slots__ = ("place", "step", "above", "score", "linked", "size", "parts", "chrome", "own", "passed", "all_linked", "all_size")

    def __init__(self, place: int, step: str, above: int, chrome: bool, own: bool):
        """``place`` numbers the path, ``above`` the container around it (-1: none); ``own``: whether it is chrome itself, and not only in chrome.

        ``parts`` has the containers inside at their places.
        """
        self.place, self.step, self.above, self.chrome, self.own = place, step, above, chrome, own
        self.score, self.linked, self.size, self.parts = 0.0, 0, 0, []
        self.passed, self.all_linked, self.all_size = 0.0, 0, 0


class Page(list):
    """A page's containers in order of their start tags. Paths are numbered, a path being its parent's number and a step, so
    that what a page takes grows with its length however deeply it nests; a path is only spelled for one container."""

    def __init__(self):
        super().__init__([Container(0, "", -1, False, False)])
        self.places: dict[tuple[int, str], int] = {}

    def path(self, c: Container) -> str:
        steps = []
        while c.above >= 0:
            steps.append(c.step)
            c = self[c.above]
        return "".join("/" + x for x in reversed(steps))

    def place(self, path: str) -> int:
        """The number of a spelled path, -1 if no container has it."""
        at = 0
        for step in path.split("/")[1:]:
            at = self.places.get((at, step), -1)
            if at < 0:
                break
        return at


def scan(page: str) -> Page:
    """The page's containers, each with its own text and the containers inside."""
    out = Page()
    root = out[0]
    # An open element: its tag, container, that one's number, and the open cell's place in the stack when it began.
    stack, opened, cell = [("", root, 0, 0)], {}, 0
    at = links = 0

    def text(raw: str) -> None:
        if not raw or raw.isspace():
            if raw and stack[-1][1].parts:
                stack[-1][1].parts.append(" ")
            return
        raw = entities.unescape(raw) if "&" in raw else raw
        c = stack[-1][1]
        c.parts.append(raw.replace("\n", " "))
        n = len(raw.strip())
        c.size += n
        if links:
            c.linked += n
        elif n >= LONG:
            c.score += 1 + raw.count(",") + min(n / 100, 3)

    def close(depth: int) -> int:
        """Close all beyond ``depth``; the place of the cell that is open then."""
        first = stack[depth][3]
        for ended, *_ in stack[depth:]:
            opened[ended] -= 1
        del stack[depth:]
        stack[-1][1].parts.append("\n")
        return first

    for m in TOKEN.finditer(page):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        tag = m.group(3)
        if tag is None:
            continue
        tag, closing = tag.lower(), m.group(2)
        if tag in BREAKS:
            stack[-1][1].parts.append("\n")
        if tag == "a":
            links = max(0, links + (-1 if closing else 1))
        if tag in ROWS and cell:  # a cell's end tag may be left out
            cell, links = close(cell), 0
        if tag not in CONTAINERS and tag != "table":
            continue
        if not closing:
            if m.group(4).endswith("/"):
                continue
            opened[tag] = opened.get(tag, 0) + 1
            if tag == "table":  # cells of a table inside a cell don't end that cell
                stack.append((tag, *stack[-1][1:3], cell))
                cell = 0
                continue
            found = CLASS.search(m.group(4))
            name = next(filter(None, found.groups()), "") if found else ""
            step = tag + ("." + DIGITS.sub("#", name.lower()).replace("/", "|") if name else "")
            _, above, number, _ = stack[-1]
            key = above.place, step
            c = Container(out.places.setdefault(key, len(out.places) + 1), step, number, above.chrome or tag in CHROME, tag in CHROME)
            above.parts.append(c)
            stack.append((tag, c, len(out), cell))
            out.append(c)
            if tag == "td":
                cell = len(stack) - 1
        elif opened.get(tag):
            depth = len(stack) - 1
            while stack[depth][0] != tag:
                depth -= 1
            cell, links = close(depth), 0
    if at < len(page):
        text(page[at:])
    for c in reversed(out):  # those inside come before their container
        c.all_linked += c.linked
        c.all_size += c.size
        if c.above >= 0 and not left_out(c):
            above = out[c.above]
            above.all_linked += c.all_linked
            above.all_size += c.all_size
            above.passed += PASSED * value(c)
    return out


def left_out(c: Container) -> bool:
    """Whether what is extracted around it goes without it."""
    return c.own or c.all_linked > LINKED * c.all_size


def value(c: Container) -> float:
    """Text score, less by the share of linked text, navigation and the like a tenth of it; and what containers inside pass on."""
    return (c.score * (1 - c.linked / c.size) * (0.1 if c.chrome else 1.0) if c.size else 0.0) + c.passed


def best(containers: Page) -> tuple[str, float] | None:
    """Path and value of the page's best container, the first of equals; the one with most text if none scores."""
    top = max(containers, key=lambda c: (value(c), c.size - c.linked), default=None)
    return (containers.path(top), value(top)) if top is not None and top.all_size else None


def tidy(parts: list[str]) -> str:
    lines = (SPACES.sub(" ", x).strip() for x in "".join(parts).split("\n"))
    return "\n".join(x for x in lines if x)


def subtree(c: Container) -> list[str]:
    """The text parts of a container and of those inside that aren't left out, in order; without recursion, as pages may nest deeply."""
    out, todo = [], [iter(c.parts)]
    while todo:
        for part in todo[-1]:
            if isinstance(part, str):
                out.append(part)
            elif not left_out(part):
                todo.append(iter(part.parts))
                break
        else:
            todo.pop()
    return out


def extract(page: str | None, path: str | None) -> tuple[str | None, str | None]:
    """(path used, text) of the page."""
    if not page:
        return None, None
    containers = scan(page)
    place = -1 if path is None else containers.place(path)
    if not any(c.place == place and c.all_size for c in containers):
        own = best(containers)
        if own is None:
            return None, None
        path = own[0]
        place = containers.place(path)
    return path, "\n".join(filter(None, (tidy(subtree(c)) for c in containers if c.place == place and c.all_size)))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, path): each host's winning path. Votes are summed on the map side first, so a large host doesn't skew."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 50):
            got = [(h, *b) for h, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if page and (b := best(scan(page)))]
            cols = list(zip(*got)) or [(), (), ()]
            # Whole thousandths, so that the sum doesn't depend on its order.
            weight = pa.array([round(1000 * v) for v in cols[2]], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), weight], ["host", "path", "weight"])

    votes = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(vote, "host string, path string, weight bigint")
    totals = votes.groupBy("host", "path").agg(F.sum("weight").alias("weight"))
    return totals.groupBy("host").agg(F.min_by("path", F.struct(-F.col("weight"), F.col("path"))).alias("path"))


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id``, ``host``, ``path`` and ``text`` of every row of ``pages``.

    The table of winning paths is broadcast where its checked size allows, so pages are not shuffled; beyond that the
    join is Spark's to plan.
    """
    paths = small(winning_paths(pages)).select(F.col("host").alias("on"), F.col("path").alias("won"))
    src = pages.select("page_id", host_of(F.col("url")).alias("host"), "html")
    joined = src.join(paths, src["host"] == paths["on"], "left").select("page_id", "host", "html", "won")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 50):
            got = [extract(p, w) for p, w in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([p for p, _ in got], pa.string()), pa.array([t for _, t in got], pa.string())],
                ["page_id", "host", "path", "text"],
            )

    return joined.mapInArrow(run, f"page_id {src.schema['page_id'].dataType.simpleString()}, host string, path string, text string")
