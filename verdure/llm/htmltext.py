"""Main text of web pages by a maximum-scoring subsequence of words and tags.

A page is read as a sequence of tokens. Each word scores by how much more often
words in its surroundings belong to main text than not, each tag by how rarely
it stands inside main text; both weights are learned from labelled pages. One
linear scan finds the contiguous region of the highest sum. Inside it a second scan
has the signs turned round, over the elements whose own names count against main
text: a name speaks for leaving its element out, each word of its prose against
it, so that adverts, forms and link lists go and sections stay. Reader comments
go as such by their repetition. What stands round the region has no say in that.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
#: The rest of a tag. Quotes count after an equals sign alone; nothing is read twice.
REST = re.compile(r"(?:[^>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[\"'=])*+>")
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))", re.I)
SPACE = re.compile(r"\s+")
WORDS = re.compile(r"[a-z]+")

# Fixed values of HTML: elements without content, with raw content, and that open or close a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object canvas select".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: What closes an open paragraph.
CLOSES_P = BLOCK - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
#: Landmarks that label a page's main text.
LANDMARKS = ("article", "main")
#: Prior belief, in documents, about surroundings that labelled pages may not show.
AGAINST = frozenset(
    "nav menu navbar header masthead banner footer foot aside sidebar ad ads adv advert advertisement sponsor sponsored promo promoted popup modal cookie cookies consent notice alert form search login signup subscribe newsletter share social related recommend recommended breadcrumb breadcrumbs comment comments reply replies respond disqus discussion widget toolbar pagination pager tags button input label dialog copyright legal".split()
)
PRIOR = 4.0
#: Elements around all text: their attributes say nothing.
EVERYWHERE = frozenset({"<html>", "<body>"})
#: Bounds of a word's score: text amid the region that counts against it can't part it at once.
WORST, BEST = -0.5, 2.0
#: Log-odds from which on an element's names speak against its text.
AGAINST_ODDS = -1.0
#: An element with such a share of a page's words stands round the page: its listed classes, or listed tags, say nothing.
ROUND, WHOLE = 0.5, 0.8
#: Words that a block has at least to be prose; words of prose that outweigh an element's names.
PROSE, NAMES = 12, 60
#: Names of reader comments, where several of them stand together.
READERS = frozenset("comment comments reply replies respond disqus".split())
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


@dataclass
class Weights:
    """Log-odds by surrounding token (words) and by tag (tags)."""

    words: dict[str, float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)

    def name(self, name: str) -> float:
        return self.words.get(name, -3.0 if name in AGAINST else 0.0)

    def tag(self, name: str) -> float:
        """Between -1 and 0, so that an advert amid the text can't part it."""
        return min(max(self.tags.get(name, -1.0 if name in AGAINST else -0.5), -1.0), 0.0)


@dataclass
class Page:
    """Tokens (kind, value, element), kind "text", "open" or "close"; and by element, in page order, its parent and its names."""

    items: list[tuple[str, str, int]]
    parents: list[int]
    names: list[frozenset[str]]

    def __post_init__(self) -> None:
        n = len(self.parents)
        self.words = [0] * n
        for kind, value, at in self.items:
            if kind == "text":
                self.words[at] += len(value.split())
        self.total = list(self.words)
        for i in range(n - 1, 0, -1):
            self.total[self.parents[i]] += self.total[i]
        # The landmark with the most words labels the main text.
        marks: list[int] = []
        self.mark = ""
        for x in LANDMARKS:
            if marks := [i for i in range(1, n) if f"<{x}>" in self.names[i]]:
                self.mark = f"<{x}>"
                break
        around, k = set(), max(marks, key=lambda i: self.total[i], default=0)
        while k:
            around.add(k)
            k = self.parents[k]
        self.inside = [False] * n
        for i in range(1, n):
            own = self.names[i]
            self.inside[i] = self.inside[self.parents[i]] or (bool(self.mark) and self.mark in own)
            if own & EVERYWHERE:
                own = own & EVERYWHERE
            elif i in around or self.total[i] >= WHOLE * self.total[0] > 0:
                own = frozenset(x for x in own if x.strip("<>") not in AGAINST)
            elif self.total[i] >= ROUND * self.total[0] > 0:
                own = frozenset(x for x in own if x not in AGAINST or f"<{x}>" in own)
            self.names[i] = own


def parse(page: str) -> Page:
    """Tokens and elements in time linear in the page, however its tags nest or fail to close.

    A tag or comment that never ends is read to the end of the page, as browsers do.
    """
    items: list[tuple[str, str, int]] = []
    parents, names = [0], [frozenset()]
    stack: list[tuple[str, int]] = [("", 0)]
    where: dict[str, list[int]] = {}  # places of open elements by name
    blocks = [0]  # places of open block elements

    def close(k: int) -> None:
        while len(stack) > k:
            where[stack.pop()[0]].pop()
            if blocks[-1] == len(stack):
                blocks.pop()

    at = begin = 0
    n = len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0 or lt + 1 >= n:
            break
        c, kind = page[lt + 1], ""
        attributes = name = ""
        inner = None
        if c == "!" and page.startswith("<![CDATA[", lt):
            end = page.find("]]>", lt + 9)
            inner = page[lt + 9 : end if end >= 0 else n]
            at = end + 3 if end >= 0 else n
        elif c == "!" and page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = end + 3 if end >= 0 else n
        elif c in "!?" or (c == "/" and not NAME.match(page, lt + 2)):
            end = page.find(">", lt + 2)
            at = end + 1 if end >= 0 else n
        elif c == "/":
            name, kind = NAME.match(page, lt + 2)[0].lower(), "close"
            end = page.find(">", lt + 2)
            at = end + 1 if end >= 0 else n
        elif m := NAME.match(page, lt + 1):
            name, kind = m[0].lower(), "open"
            rest = REST.match(page, m.end())
            attributes, at = (rest[0][:-1], rest.end()) if rest else ("", n)
            if not rest:
                kind = ""
        else:
            at = lt + 1  # no tag
            continue
        if lt > begin:
            items.append(("text", page[begin:lt], stack[-1][1]))
        if inner:
            items.append(("text", inner, stack[-1][1]))
        begin = at
        if kind == "close":
            k = where[name][-1] if where.get(name) else 0
            # A stray end tag closes nothing; one of an inline element doesn't close blocks.
            if k and (name in BLOCK or k > blocks[-1]):
                close(k)
            items.append(("close", name, stack[-1][1]))
        if kind != "open":
            continue
        empty = attributes.rstrip().endswith("/")
        if name in RAW:
            if not empty:
                m = _RAW_END[name].search(page, at)
                end = page.find(">", m.end()) if m else -1
                begin = at = end + 1 if end >= 0 else n
            continue
        if (name in CLOSES_P or name == "p") and stack[blocks[-1]][0] == "p":
            close(blocks[-1])
        if name in ("li", "tr", "td", "th", "dt", "dd", "option") and stack[-1][0] == name:
            close(len(stack) - 1)
        if name not in VOID and not empty:
            own = {f"<{name}>"} | ({name} if name in AGAINST else set())
            for a in ATTRIBUTE.finditer(attributes):
                own.update(WORDS.findall((a[2] or a[3] or a[4] or "").lower()))
            parents.append(stack[-1][1])
            names.append(frozenset(own))
            where.setdefault(name, []).append(len(stack))
            if name in BLOCK:
                blocks.append(len(stack))
            stack.append((name, len(parents) - 1))
        items.append(("open", name, stack[-1][1]))
    if begin < n:
        items.append(("text", page[begin:], stack[-1][1]))
    return Page(items, parents, names)


def maximal(scores: list[float]) -> tuple[int, int]:
    """[first, last + 1) of the contiguous run of the largest sum; the first of equals; (0, 0) if none is positive."""
    best, total, start, found = 0.0, 0.0, 0, (0, 0)
    for i, x in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += x
        if total > best:
            best, found = total, (start, i + 1)
    return found


def scores(page: Page, weights: Weights) -> tuple[list[float], list[bool]]:
    """The score of each token, and by element whether its own names speak against it.

    A word has the strongest evidence among what surrounds it, against main text or else for it.
    """
    outside = weights.name(f"!{page.mark}") if page.mark else 0.0
    low, high, against, word = [0.0], [0.0], [False], []
    cache: dict[frozenset[str], tuple[float, float]] = {}
    for i, (up, own) in enumerate(zip(page.parents, page.names)):
        if i:
            if own not in cache:
                odds = [weights.name(x) for x in own]
                cache[own] = min(odds, default=0.0), max(odds, default=0.0)
            a, b = cache[own]
            low.append(min(low[up], a))
            high.append(max(high[up], b))
            against.append(a <= AGAINST_ODDS)
        worst = low[i] if page.inside[i] else min(low[i], outside)
        word.append(min(max(worst if worst <= AGAINST_ODDS else max(high[i], 0.1), WORST), BEST))
    return [word[at] * len(value.split()) if kind == "text" else weights.tag(value) for kind, value, at in page.items], against


def prose(page: Page, first: int, last: int) -> list[int]:
    """By element, the words in it that stand in the region, in blocks of a sentence's length, and in no link."""
    linked = [False] * len(page.parents)
    for i in range(1, len(linked)):
        linked[i] = linked[page.parents[i]] or "<a>" in page.names[i]
    out, block = [0] * len(page.parents), []
    for kind, value, at in [*page.items[first:last], ("close", "div", 0)]:
        if kind == "text":
            block.append((at, len(value.split())))
        elif value in BLOCK:
            if sum(n for at, n in block if not linked[at]) >= PROSE:
                for at, n in block:
                    out[at] += 0 if linked[at] else n
            block = []
    for i in range(len(out) - 1, 0, -1):
        out[page.parents[i]] += out[i]
    return out


def readers(page: Page) -> list[bool]:
    """By element, whether it bears a name of reader comments and holds, or stands beside, another that does."""
    own = [bool(names & READERS) for names in page.names]
    under, beside = [0] * len(own), Counter(up for up, mine in zip(page.parents, own) if mine)
    for i in range(len(own) - 1, 0, -1):
        under[page.parents[i]] += under[i] + own[i]
    return [mine and (under[i] >= 2 or beside[page.parents[i]] >= 2) for i, mine in enumerate(own)]


def region(page: Page, weights: Weights) -> tuple[int, int, list[bool]]:
    """First token, last + 1 of the maximum-scoring region, and by element whether it is left out of it."""
    value, against = scores(page, weights)
    first, last = maximal(value)
    # Elements that begin inside the region and aren't all of it may be left out.
    held = sum(len(v.split()) for kind, v, _ in page.items[first:last] if kind == "text")
    starts = {at for kind, _, at in page.items[first:last] if kind == "open"}
    gone, told, crowd = [False] * len(page.parents), prose(page, first, last), readers(page)
    for i in range(1, len(gone)):
        turned = (NAMES if against[i] else 0) - told[i]
        gone[i] = gone[page.parents[i]] or (i in starts and page.total[i] < max(held, 1) and against[i] and (turned > 0 or crowd[i]))
    # Between two landmarks' text lies what is in neither.
    if page.mark and weights.name(f"!{page.mark}") <= AGAINST_ODDS and any(page.inside[at] for _, _, at in page.items[first:last]):
        gone = [g or not page.inside[i] for i, g in enumerate(gone)]
    return first, last, gone


def extract(text: str, weights: Weights) -> str:
    """Blocks of the main text, in page order, joined by one newline."""
    page = parse(text)
    first, last, gone = region(page, weights)
    blocks, part = [], []
    for kind, value, at in page.items[first:last]:
        if kind == "text":
            if not gone[at]:
                part.append(value)
        elif value in BLOCK:
            blocks.append(part)
            part = []
        elif value == "br":
            part.append(" ")
    blocks.append(part)
    lines = (SPACE.sub(" ", html.unescape("".join(b))).strip() for b in blocks)
    return "\n".join(x for x in lines if x)


def observe(text: str) -> Counter:
    """(kind, name, inside) counts of a page that has a landmark of its main text, by that landmark alone; nothing from others.

    What a listed element holds speaks for or against its listed names, not those of the
    plain elements that it is in or holds; for them only its prose speaks, as what else it
    holds in a landmark may be there by habit.
    """
    page = parse(text)
    out: Counter = Counter()
    if not page.mark:
        return out
    n = len(page.parents)
    listed = [frozenset(x for x in own if x.strip("<>") in AGAINST) for own in page.names]
    told = prose(page, 0, len(page.items))
    bad = [False] * n
    for i in range(1, n):
        bad[i] = bad[page.parents[i]] or bool(listed[i])
    yes = [w if page.inside[i] and not bad[i] else 0 for i, w in enumerate(page.words)]
    no = [w if not page.inside[i] and not bad[i] else 0 for i, w in enumerate(page.words)]
    out["word", f"!{page.mark}", False] = sum(w for i, w in enumerate(page.words) if not page.inside[i])
    for i in range(n - 1, 0, -1):
        yes[page.parents[i]] += yes[i]
        no[page.parents[i]] += no[i]
    # A name counts a word once, for the outermost element that bears it.
    open_: list[tuple[int, list[str]]] = []
    names: set[str] = set()
    for i in range(1, n):
        while open_ and open_[-1][0] != page.parents[i]:
            names.difference_update(open_.pop()[1])
        new = [x for x in (listed[i] if bad[i] else page.names[i]) if x not in names]
        names.update(new)
        open_.append((i, new))
        for x in new:
            if bad[i]:
                out["word", x, page.inside[i]] += told[i] if page.inside[i] else page.total[i]
            else:
                out["word", x, True] += yes[i]
                out["word", x, False] += no[i]
    for kind, value, at in page.items:
        if kind != "text" and (not bad[at] or value in AGAINST):
            out["tag", value, page.inside[at] and not bad[at]] += 1
    return out


def learn(pages: DataFrame, *, most: int = 2_000) -> Weights:
    """Weights from labelled pages: those with an article or main landmark, which is taken as their main text.

    At most about ``most`` pages are read, chosen by a hash of page_id; the counts of
    distinct names, a few to a page, come to the driver. Without labelled pages the
    prior alone holds.
    """
    n = pages.count()
    share = min(1.0, most / max(n, 1))
    sample = pages.where(F.pmod(F.xxhash64("page_id", F.lit(9)), F.lit(1_000_000)) < int(share * 1_000_000)).select(F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                seen = observe(page or "")
                size = {k: sum(v for (kind, _, _), v in seen.items() if kind == k) for k in ("word", "tag")}
                for (kind, name, inside), v in seen.items():
                    total[kind, name, inside] += v / max(size[kind], 1)
        yield pa.RecordBatch.from_pylist([{"kind": k, "name": n, "inside": i, "n": float(v)} for (k, n, i), v in total.items()], pa.schema([("kind", pa.string()), ("name", pa.string()), ("inside", pa.bool_()), ("n", pa.float64())]))

    counts = sample.mapInArrow(run, "kind string, name string, inside boolean, n double").groupBy("kind", "name", "inside").agg(F.sum("n").alias("n")).collect()
    return weigh({(r.kind, r.name, r.inside): r.n for r in counts})


def weigh(counts: dict[tuple[str, str, bool], float]) -> Weights:
    """Log-odds of all counted names; listed ones have a prior against them that pages can outweigh."""
    out = Weights()
    for kind, into in (("word", out.words), ("tag", out.tags)):
        names = {n for k, n, _ in counts if k == kind}
        total = {i: sum(v for (k, _, j), v in counts.items() if k == kind and i == j) for i in (True, False)}
        scale = 100 / max(sum(total.values()), 1e-9)
        base = (total[True] * scale + 1) / (total[False] * scale + 1)
        for name in names:
            yes, no = (counts.get((kind, name, i), 0.0) * scale for i in (True, False))
            prior = PRIOR if name.strip("<>") in AGAINST else 0.0
            # Tags of the landmarks themselves and everything around both regions says nothing.
            into[name] = log((yes + 0.05) / (no + 0.05 + prior)) - (log(base) if kind == "tag" else 0.0)
    return out


def main_text(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html), from the whole html.

    Null or empty html gives an empty text. Character references are decoded, white space
    within a block is one space, blocks are joined by one newline. Rows that repeat a
    page_id each give a row; very long or ill-formed pages are read whole, in linear time;
    further columns are not read; an empty table gives no rows.
    """
    known = weights if weights is not None else learn(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [extract(page or "", known) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
