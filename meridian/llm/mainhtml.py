"""Main text of web pages by minimum-cut labelling.

A page becomes blocks of text in page order. A classifier gives each block log-odds of being content, the capacity to
one terminal or the other. They are made of what its containers say (elements, class names; OUTSIDE, INSIDE, BOILER,
CONTENT) and of its shape (length, share of links, punctuation, kind), whose weights are fitted: blocks whose containers
speak clearly are the labelled rows, on about `max_pages` pages with the lowest hashes of page_id, and few rows shrink
towards PRIOR. Blocks that follow each other are joined by smoothness edges, and DOM proximity by edges from each block
to its container and from each container to the one around it. The minimum cut labels the blocks: nodes whose own
capacity outweighs all their edges are settled first, in a queue, and max-flow decides the rest.

Null and empty pages give an empty text. Unclosed and stray tags are tolerated: an unclosed quote ends no later than
the next `>`, a tag that is never closed ends the page. A page costs in proportion to its length but for max-flow over
what its costs leave open. A page without markup is one block of content. Null ids and urls are kept. Repeated rows
get equal texts; an empty table gives an empty result. Columns other than page_id, url and html are left alone.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"<(/?)([A-Za-z][\w:-]*)")
TAG = re.compile(r"((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>")
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden|style|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
#: The elements of HTML by what they do to text.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "br", "wbr", "img", "ruby", "rt", "rp"}
LEAF = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "pre", "blockquote", "figcaption", "td", "th", "tr", "ul", "ol", "dl", "table", "tbody", "thead", "caption"}
CLOSES_P = LEAF - {"td", "th", "tr", "tbody", "thead", "caption", "li", "dt", "dd"} | {"div", "section", "article", "aside", "nav", "header", "footer", "main", "form", "figure", "hr", "address", "fieldset", "details"}
RAW = {"script": "", "style": "", "template": "", "svg": "", "noscript": " ", "iframe": " ", "object": " ", "textarea": " ", "select": " ", "canvas": " ", "title": " "}
CLOSING = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
#: What containers add to the log-odds of content; how far those for content may go together, and all of them against it.
OUTSIDE = {"nav": 8.0, "footer": 8.0, "aside": 8.0, "form": 8.0, "button": 8.0, "menu": 8.0, "dialog": 8.0, "head": 9.0, "header": 6.0}
INSIDE = {"article": 2.5, "main": 2.0}
NAMED_BOILER, NAMED_CONTENT, MOST, FARTHEST = 8.0, 1.5, 3.5, 6.0
BOILER = re.compile(r"(?:^|[\s_-])(ads?|advert\w*|banner|promo\w*|sponsor\w*|nav\w*|menu|sidebar|side|widget|footer|header|masthead|cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter|subscri\w*|shar(?:e|ing)\w*|social|related|recommend\w*|breadcrumbs?|comments?\w*|respond|repl(?:y|ies)|disqus|discussion|login|signin|search|toolbar|pag(?:er|ination)|copyright|legal|complementary|contentinfo|navigation|alert|dialog|hidden)(?=$|[\s_-])", re.I)
CONTENT = re.compile(r"(?:^|[\s_-])(articlebody|article|post|entry|story|content|main|body|text)(?=$|[\s_-])", re.I)
SPACE = re.compile(r"\s+")
#: Edges: to the next block in the same container and in another one, to the container, to the container around it.
NEXT, ACROSS, HOME, AROUND = 1.0, 0.3, 0.7, 0.2
#: Log-odds of shapes before any page was seen, worth STRENGTH rows; how far one may go, what they are scaled by, how far all may go.
PRIOR = {"links0": 0.3, "links1": 0.0, "links2": -1.0, "links3": -2.5, "heading": 0.5, "ends1": 0.4, "ends0": -0.2}
STRENGTH, LIMIT, SCALE, SHAPE, BIAS = 50.0, 2.0, 0.6, 3.0, 0.5
#: Containers' log-odds from which a block counts as labelled.
CLEAR_CONTENT, CLEAR_BOILER = 2.0, -3.0
MAX_PAGES = 5_000


def tokens(page: str):
    """(text, None, None, None) or ("", closing, element, attributes), in page order; what isn't shown is left out."""
    i, n, quoted = 0, len(page), True
    while i < n:
        j = page.find("<", i)
        if j != i:
            yield page[i : j if j >= 0 else n], None, None, None
            if j < 0:
                return
        if page.startswith("<!--", j):
            k = page.find("-->", j + 4)
            i = k + 3 if k >= 0 else n
            continue
        m = NAME.match(page, j)
        if not m:
            if page[j + 1 : j + 2] in ("!", "?", "/"):
                k = page.find(">", j + 2)
                i = k + 1 if k >= 0 else n
            else:
                yield "<", None, None, None
                i = j + 1
            continue
        t = TAG.match(page, m.end()) if quoted else None
        if t:
            attrs, i = t[1], t.end()
        else:
            quoted = False  # from here on a tag ends at the next >
            k = page.find(">", m.end())
            if k < 0:
                return
            attrs, i = page[m.end() : k], k + 1
        tag = m[2].lower()
        if tag in RAW and not m[1] and not attrs.endswith("/"):
            end = CLOSING[tag].search(page, i)
            i = end.end() if end else n
            if RAW[tag]:
                yield " ", None, None, None
            continue
        yield "", bool(m[1]), tag, attrs


def _weight(tag: str, attrs: str, inside: bool) -> float:
    """What a container adds to the log-odds of content."""
    w = INSIDE.get(tag, 0.0) - OUTSIDE.get(tag, 0.0)
    if tag == "header" and inside:
        w = -1.0  # a heading of the article itself
    for name, value in ATTRIBUTE.findall(attrs) if attrs else ():
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role", "itemprop"):
            if BOILER.search(value):
                w -= 1.0 if tag in ("body", "html") else NAMED_BOILER
            elif CONTENT.search(value) and tag not in INLINE:
                w += NAMED_CONTENT
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            w -= 9.0
    return w


class Block:
    __slots__ = ("text", "container", "said", "shape")

    def __init__(self, text: str, container: int, said: float, links: float, kind: str):
        self.text, self.container, self.said = text, container, said
        stops = sum(map(text.count, ".,;:!?"))
        self.shape = (
            f"long{min(len(text).bit_length(), 11)}", f"links{0 if links == 0 else 1 if links < 0.3 else 2 if links < 0.7 else 3}",
            f"ends{int(text[-1] in '.!?:;\"\'»”')}", f"stops{min(stops.bit_length(), 4)}", kind,
        )


def blocks(page: str) -> tuple[list[Block], list[int]]:
    """The blocks, and the container around each container; 0 is the page."""
    out: list[Block] = []
    parents = [-1]
    text: list[str] = []
    links = size = 0
    inside_link, kind = False, ""
    # element, its container, the log-odds of all containers for and against content, whether one of them is INSIDE
    stack: list[tuple[str, int, float, float, bool]] = [("", 0, 0.0, 0.0, False)]
    open_: Counter = Counter()

    def flush():
        nonlocal text, links, size
        if text:
            t = SPACE.sub(" ", html.unescape("".join(text))).strip()
            if t:
                _, container, good, bad, _ = stack[-1]
                out.append(Block(t, container, max(-FARTHEST, min(MOST, good) + bad), links / max(1, size), kind or "other"))
            text, links, size = [], 0, 0

    def push(tag, w, container):
        if container:
            parents.append(stack[-1][1])
        _, around, good, bad, inside = stack[-1]
        stack.append((tag, len(parents) - 1 if container else around, good + max(w, 0.0), bad + min(w, 0.0), inside or tag in INSIDE))
        open_[tag] += 1

    def pop():
        open_[stack.pop()[0]] -= 1

    for shown, closing, tag, attrs in tokens(page):
        if tag is None:
            text.append(shown)
            size += len(shown)
            if inside_link:
                links += len(shown)
            continue
        if tag in INLINE:
            if tag == "br":
                text.append(" ")
            elif tag == "a":
                inside_link = not closing
            if not closing and tag not in VOID and attrs:
                w = _weight(tag, attrs, False)
                if w:
                    flush()
                    push(tag, w, False)
            elif closing and stack[-1][0] == tag:
                flush()
                pop()
            continue
        flush()
        if closing:
            if open_[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
            kind = ""
            continue
        while (stack[-1][0] == "p" or stack[-1][0] in INLINE) and tag in CLOSES_P:
            pop()
        kind = "heading" if len(tag) == 2 and tag[0] == "h" and tag != "hr" else tag if tag in LEAF else "other"
        if tag in VOID or attrs.endswith("/") and tag not in LEAF:
            continue
        if tag == "li" and stack[-1][0] == "li":
            pop()
        if tag == "body":
            while stack[-1][0] not in ("", "html"):
                pop()
        push(tag, _weight(tag, attrs, stack[-1][4]), tag not in LEAF)
    flush()
    return out, parents


def _flow(source: list[float], sink: list[float], edges: list[list[tuple[int, float]]]) -> list[bool]:
    """The source side of a minimum cut by blocking flows along shortest paths. edges[u] has (v, capacity) both ways."""
    n = len(source)
    cap: list[dict[int, float]] = [{} for _ in range(n + 2)]
    s, t = n, n + 1
    for u in range(n):
        both = min(source[u], sink[u])
        if source[u] > both:
            cap[s][u], cap[u][s] = source[u] - both, 0.0
        elif sink[u] > both:
            cap[u][t], cap[t][u] = sink[u] - both, 0.0
        for v, c in edges[u]:
            cap[u][v] = cap[u].get(v, 0.0) + c
    while True:
        level, queue = {s: 0}, deque([s])
        while queue:
            u = queue.popleft()
            for v, c in cap[u].items():
                if c > 1e-9 and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if t not in level:
            return [u in level for u in range(n)]
        ways = {u: iter(list(cap[u])) for u in level}
        path = [s]
        while path:
            u = path[-1]
            if u == t:
                least = min(cap[a][b] for a, b in zip(path, path[1:]))
                cut = 0
                for i, (a, b) in enumerate(zip(path, path[1:])):
                    cap[a][b] -= least
                    cap[b][a] = cap[b].get(a, 0.0) + least
                    if not cut and cap[a][b] <= 1e-9:
                        cut = i + 1
                path = path[:cut]
                continue
            v = next((v for v in ways[u] if level.get(v, -1) == level[u] + 1 and cap[u][v] > 1e-9), None)
            if v is None:
                level[u] = -1
                path.pop()
            else:
                path.append(v)
                if v != t:
                    ways[u] = _again(v, ways[u])


def _again(v, rest):
    yield v
    yield from rest


def min_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for nodes on the content side. odds: capacity to content where positive, to boilerplate where negative; edges work both ways."""
    n = len(odds)
    gain, around = list(odds), [[] for _ in range(n)]
    for u, v, c in edges:
        around[u].append((v, c))
        around[v].append((u, c))
    pull = [sum(c for _, c in x) for x in around]
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:  # nodes that outweigh what is open around them
        u = queue.popleft()
        if label[u] is None and (gain[u] > pull[u] or -gain[u] > pull[u] or not pull[u]):
            label[u] = gain[u] > 0
            for v, c in around[u]:
                if label[v] is None:
                    gain[v] += c if label[u] else -c
                    pull[v] = max(0.0, pull[v] - c) if pull[v] - c > 1e-9 else 0.0
                    queue.append(v)
    rest = [u for u in range(n) if label[u] is None]
    if rest:
        at = {u: i for i, u in enumerate(rest)}
        found = _flow([max(gain[u], 0.0) for u in rest], [max(-gain[u], 0.0) for u in rest], [[(at[v], c) for v, c in around[u] if v in at] for u in rest])
        for u, x in zip(rest, found):
            label[u] = x
    return label


def block_odds(found: list[Block], model: dict[str, float]) -> list[float]:
    return [b.said + BIAS + max(-SHAPE, min(SHAPE, SCALE * sum(model.get(x, 0.0) for x in b.shape))) for b in found]


def labels(found: list[Block], parents: list[int], odds: list[float]) -> list[bool]:
    """The labels of blocks by the minimum cut."""
    n = len(found)
    used: set[int] = set()
    edges = []
    for i, b in enumerate(found):
        edges.append((i, n + b.container, HOME))
        if i:
            edges.append((i - 1, i, NEXT if found[i - 1].container == b.container else ACROSS))
        c = b.container
        while c >= 0 and c not in used:
            used.add(c)
            if parents[c] >= 0:
                edges.append((n + c, n + parents[c], AROUND))
            c = parents[c]
    return min_cut([*odds, *[0.0] * len(parents)], edges)[:n]


def main_text(page: str | None, model: dict[str, float] = PRIOR) -> str:
    """The content blocks of a page, joined by two line feeds."""
    if not page:
        return ""
    found, parents = blocks(page)
    return "\n\n".join(b.text for b, content in zip(found, labels(found, parents, block_odds(found, model))) if content)


def shapes(pages: DataFrame) -> DataFrame:
    """(shape, content, boiler): how many clearly labelled blocks of pages (html) have a shape; "" counts all."""
    def run(batches):
        n: dict[bool, Counter] = {True: Counter(), False: Counter()}
        for batch in batches:
            for page in batch.column("html").to_pylist():
                for b in blocks(page or "")[0]:
                    if b.said >= CLEAR_CONTENT or b.said <= CLEAR_BOILER:
                        n[b.said > 0].update([*b.shape, ""])
        keys = sorted({*n[True], *n[False]})
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *[pa.array([n[x][k] for k in keys], pa.int64()) for x in (True, False)]], ["shape", "content", "boiler"])

    return pages.select("html").mapInArrow(run, "shape string, content long, boiler long").groupBy("shape").agg(F.sum("content").alias("content"), F.sum("boiler").alias("boiler"))


def fit(pages: DataFrame, max_pages: int = MAX_PAGES) -> dict[str, float]:
    """Log-odds of content for each shape, from about max_pages pages."""
    n = pages.count()
    if n > max_pages:
        pages = pages.filter(F.pmod(F.xxhash64("page_id"), F.lit(1 << 52)) < (max_pages << 52) // n)
    seen = {r.shape: (r.content, r.boiler) for r in shapes(pages).collect()}  # some 30 shapes
    good, bad = seen.pop("", (0, 0))
    out = dict(PRIOR)
    if good and bad:
        for k, (c, b) in seen.items():
            odds = math.log((c + 1) / (good + 2)) - math.log((b + 1) / (bad + 2))
            out[k] = max(-LIMIT, min(LIMIT, ((c + b) * odds + STRENGTH * PRIOR.get(k, 0.0)) / (c + b + STRENGTH)))
    return out


def extract(pages: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html)."""
    model = fit(pages, max_pages)

    def run(batches):
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                texts = [main_text(h, model) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
