"""HTML extraction by consensus host paths.

Each page's containers are scored by the running text that their paragraphs hold. The best one stands for the
whole it is a part of: the article or main around it or, without either, the outermost element around it with
paragraphs of its own, so that titles, leads and closing paragraphs beside it are kept. That element's path,
generalised to tags and classes without numbers, gets the page's vote on its host. Spark counts the votes and
every page of a host is extracted again from the elements at the host's winning path; a page that has none of
them, as one from another template, or only empty ones falls back on its own best container, then on its body.
Without article and main, a div beside the best one that no paragraph of their common parent joins to it is taken
for a page's other box, not for a part of the article.

Within the container, navigation, headers (but the article's own), footers, sidebars, forms, scripts, styles, adverts, notices and
reader comments are left out, by tag or by a word of their class or id. Character references are decoded, white
space inside a block becomes one space, and blocks are joined in page order by one space.

Names count for blocks alone, not for what stands inside a sentence, and not where they tell what a wrapper has or how
it stands (``has-sidebar``, ``nav-open``). An element that holds most of a page's running text together with its first
heading, or all of that text, is the page's wrapper and never left out for its name.

Null html counts as empty and gives an empty text; a null url has its votes with all other pages without a host.
Null and repeated page_ids get a row each. Html of any length is read whole, also where it is cut off or its
tags do not match. An empty table gives an empty result. Only page_id, url and html are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proselab.llm.common import materialise

#: Comments, declarations and tags; a quote right after the equals sign opens a value, which may hold the sign that ends a tag.
TAG = re.compile(r"""<!--(?:-?>|(?s:.*?)(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*"[^"]*"|=\s*'[^']*'|=)*?)(?:>|\Z)""")
#: One name with its value, read from left to right, so that names inside quoted values are not seen; a quote left open ends with the tag.
ATTRIBUTE = re.compile(r"""([^\s/>="'][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s"'>][^\s>]*)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}
#: Never part of the text; a header inside an article is part of it.
OUT = RAW | frozenset("nav header footer aside form button select option noscript template svg math canvas object audio video menu dialog head fieldset label datalist".split())
BLOCK = frozenset("address article aside blockquote body br button canvas caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
CONTAINERS = frozenset("article main section div td body".split())
PARAGRAPHS = frozenset("p pre blockquote li dd h1 h2 h3 h4 h5 h6 figcaption td".split())
#: Words of a class or id that mark what is not the article, anywhere among its parts; inside an article a header is its own.
HEADER = re.compile(r"(?:^|[\s_-])(?:header|masthead)(?:$|[\s_-])", re.I)
AWAY = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|sidebar|footer|cookies?|consent|gdpr|notices?|popup|modal|"
    r"overlay|newsletter|subscri\w*|signup|login|recommend\w*|comments?|disqus|replies|respond|toolbar|pagination|pager)(?:$|[\s_-])",
    re.I,
)
#: Words that mark it only as the whole name, or with a word for a place or kind beside them: side-by-side and tag-line are none.
PLACE = r"(?:article|post|entry|page|site|content|story|news|main)"
KIND = r"(?:bar|box|list|links?|block|section|area|panel|wrap(?:per)?|container|content|buttons?|icons?|nav|posts?|articles?|stories|items?|cloud|left|right)"
AWAY_ALONE = re.compile(rf"(?:^|\s)(?:{PLACE}[-_])?(?:side|rail|tags?|skip|social|share|sharing|related|alert|widgets?)(?:[-_]{KIND})?(?:$|\s)", re.I)
#: Names that tell what a page or wrapper has or how it stands, not what it is.
STATE = re.compile(
    r"(?:^|(?<=\s))(?:(?:has|no|not|with|without|show|shows|hide|hides|enable|disable|js|can)[-_]\S+"
    r"|\S+[-_](?:open|opened|closed|collapsed|expanded|enabled|disabled|active|visible|hidden|ready|loaded|layout|template|theme|sticky))(?=\s|$)",
    re.I,
)
#: Elements inside a sentence, whose names say nothing about the page.
PHRASE = frozenset("span em strong b i u s small big sub sup code kbd samp var tt mark q cite abbr acronym time dfn bdi bdo font del".split())
#: What running text stands in.
TEXTUAL = PARAGRAPHS - frozenset("h1 h2 h3 h4 h5 h6".split())
#: An open element is closed by a start tag of these.
CLOSED_BY = {"p": BLOCK - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: Behind these the search for an element to close stops.
SCOPE = frozenset("article main section div td th table body html ul ol dl aside form nav footer header".split())


#: The names whose open elements a start tag closes.
CLOSES = {name: tuple(k for k, by in CLOSED_BY.items() if name in by) for name in {n for by in CLOSED_BY.values() for n in by}}


class Node:
    """An element, with what a walk to the root would tell: no step of the work follows the depth of a page.

    box and hold are the nearest container, and the nearest one that is no section (or the root); article and
    main the outermost such elements around it; link and inside tell whether it is in a link and in a paragraph,
    running whether a paragraph stands between it and hold. The path is kept as a 64-bit hash, keyed by process.
    """

    __slots__ = ("article", "box", "children", "hold", "inside", "key", "link", "main", "name", "out", "parent", "running", "step")

    def __init__(self, name: str, parent: Node | None, step: str, out: bool):
        self.name, self.parent, self.step, self.out, self.children = name, parent, step, out, []
        self.key = hash((parent.key if parent else 0, step))
        paragraph, up = name in PARAGRAPHS, parent or self
        self.link = name == "a" or bool(parent) and parent.link
        self.inside = paragraph or bool(parent) and parent.inside
        self.box = self if name in CONTAINERS else parent.box if parent else None
        holds = parent is None or name in CONTAINERS and name != "section"
        self.hold = self if holds else up.hold
        self.running = paragraph or not holds and up.running
        self.article = parent and parent.article or (self if name == "article" else None)
        self.main = parent and parent.main or (self if name == "main" else None)

    @property
    def path(self) -> str:
        steps, x = [], self
        while x is not None:
            steps.append(x.step)
            x = x.parent
        return "/".join(reversed(steps))


def _key(path: str) -> int:
    key = 0
    for step in path.split("/"):
        key = hash((key, step))
    return key


def _step(name: str, attributes: dict[str, str]) -> str:
    """The tag and its classes without those that hold digits, in order of the alphabet."""
    classes = sorted({c.lower() for c in attributes.get("class", "").split() if not re.search(r"\d", c)})
    return ".".join([name, *classes])


def _away(marks: str, article: Node | None) -> bool:
    """Whether a class or id names something beside the article."""
    marks = STATE.sub("", marks)
    return bool(AWAY.search(marks) or AWAY_ALONE.search(marks) or article is None and HEADER.search(marks))


class _Open:
    """The open elements: a stack, and the places of each name in it, so that none is searched for."""

    def __init__(self, root: Node):
        self.stack, self.places, self.scopes = [root], {}, [0]

    def push(self, node: Node) -> None:
        self.places.setdefault(node.name, []).append(len(self.stack))
        if node.name in SCOPE:
            self.scopes.append(len(self.stack))
        self.stack.append(node)

    def last(self, name: str) -> int:
        places = self.places.get(name)
        return places[-1] if places else 0

    def close(self, place: int) -> None:
        """Close the element at ``place`` and all in it."""
        while len(self.stack) > place:
            name = self.stack.pop().name
            self.places[name].pop()
            if name in SCOPE:
                self.scopes.pop()


def parse(html: str) -> Node:
    """The tree of elements; texts are children as strings."""
    root = Node("html", None, "html", False)
    opened = _Open(root)
    at, n = 0, len(html)
    while at < n:
        m = TAG.search(html, at)
        if m is None:
            opened.stack[-1].children.append(html[at:])
            break
        if m.start() > at:
            opened.stack[-1].children.append(html[at : m.start()])
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            place = opened.last(name)
            if place and (name in SCOPE or place > opened.scopes[-1]):
                opened.close(place)
            continue
        if name == "html" or name == "body" and opened.last("body"):
            continue
        for _ in range(len(opened.stack)):
            place = max((opened.last(k) for k in CLOSES.get(name, ())), default=0)
            if not place or place < opened.scopes[-1]:
                break
            opened.close(place)
        node = opened.stack[-1]
        attributes = {a[0].lower(): a[1] or a[2] or a[3] for a in ATTRIBUTE.findall(m[3])} if m[3] else {}
        marks = f"{attributes.get('class', '')} {attributes.get('id', '')}"
        out = name in OUT and not (name == "header" and node.article) or "hidden" in attributes or name not in PHRASE and name not in ("body", "html", "article", "main") and marks != " " and _away(marks, node.article)
        own = Node(name, node, _step(name, attributes), out or attributes.get("role", "") in ("navigation", "banner", "complementary", "contentinfo", "search"))
        node.children.append(own)
        if name in RAW:
            end = RAW_END[name].search(html, at)
            at = n if end is None else end.start()
        elif name not in VOID and not m[3].endswith("/"):
            opened.push(own)
    return root


def _restore(root: Node) -> None:
    """Take back the leaving out of an element that is the page's wrapper, whatever its name.

    It holds most of the page's running text, and with it the page's first heading or main, or all of that text.
    """
    nodes, stack = [], [(root, False, False)]
    own: dict[Node, list[int]] = {}
    while stack:
        x, link, running = stack.pop()
        nodes.append(x)
        own[x] = counts = [0, int(x.name in ("h1", "main"))]
        link, running = link or x.name == "a", running or x.name in TEXTUAL
        for c in x.children:
            if isinstance(c, Node):
                if c.name not in RAW:
                    stack.append((c, link, running))
            elif running and not link:
                counts[0] += len(c.strip())
    # children stand behind their parents
    for x in reversed(nodes):
        if x.parent is not None:
            for k in (0, 1):
                own[x.parent][k] += own[x][k]
    every, tops = own[root][0], own[root][1]
    for x in nodes:
        text, heads = own[x]
        if x.out and x.name not in ("nav", "footer", "aside", "template", "noscript") and 2 * text > every and (heads and heads == tops or text == every):
            x.out = False


def _tree(root: Node, within=None) -> Iterator[tuple[Node | str, Node | None]]:
    """Nodes and texts with their parents in page order, without what is left out."""
    stack: list = [(root, None)]
    while stack:
        x, parent = stack.pop()
        yield x, parent
        if isinstance(x, Node) and not x.out and (within is None or within(x)):
            stack.extend((c, x) for c in reversed(x.children))


class Page:
    """A parsed page and what its elements say about its article."""

    def __init__(self, html: str):
        self.root = parse(html)
        _restore(self.root)
        scores: dict[Node, float] = {}
        self._held: set[Node] = set()
        #: The outermost articles in each main.
        self._articles: dict[Node, set[Node]] = {}
        for x, parent in _tree(self.root):
            if isinstance(x, Node):
                if x.name == "article" and x.main is not None and not x.out:
                    self._articles.setdefault(x.main, set()).add(x.article)
                continue
            if parent.link or not x.strip():
                continue
            # an outer container gets half of what an inner one gets
            weight, share, e = len(x.strip()) * (1.0 if parent.inside else 0.25), 1.0, parent.box
            while e is not None and share >= 0.2:
                scores[e] = scores.get(e, 0.0) + weight * share
                share, e = share / 2, e.parent.box if e.parent else None
            if parent.running and unescape(x).strip():
                self._held.add(parent.hold)
        self.best = max(scores, key=scores.get) if scores else None
        self.score = scores[self.best] if scores else 0.0
        self._outermost: dict[Node, Node | None] = {}

    def _outer(self, node: Node) -> Node:
        """The outermost element around ``node`` with paragraphs of its own, or itself."""
        line, x = [], node
        while x is not None and x not in self._outermost:
            line.append(x)
            x = x.parent
        found = self._outermost[x] if x is not None else None
        for x in reversed(line):
            found = found or (x if x in self._held else None)
            self._outermost[x] = found
        return found or node

    def whole(self, node: Node) -> Node:
        """The element that holds the rest of the article of which ``node`` is a part.

        The article or main around it or, without either, the outermost element with paragraphs of its own.
        A section is a part of the container around it.
        """
        top, main = node.article, node.main
        if top is None and main is None:
            return self._outer(node)
        if top is None or main is None or main.article is top:
            return top or main
        # a main with more articles lists them; one around a single article holds its title and the like
        return top if self._articles.get(main, set()) - {top} else main

    def elected(self) -> Node | None:
        """The element that the page votes for."""
        return self.best and self.whole(self.best)

    def text(self, path: str | None) -> str:
        """The text of the elements at ``path``, else of the page's own best container, else of the page."""
        wanted, text = _key(path) if path else None, ""
        if path:
            found = [x for x, _ in _tree(self.root) if isinstance(x, Node) and x.key == wanted and not x.out]
            chosen = {self.whole(x) for x in found}
            # an element inside another chosen one is part of it
            tops = [x for x, _ in _tree(self.root, lambda x: x not in chosen) if isinstance(x, Node) and x in chosen]
            text = " ".join(filter(None, map(text_of, tops)))
        if not text and self.best is not None:
            text = text_of(self.whole(self.best))
        return text or text_of(self.root)


def text_of(node: Node) -> str:
    """The blocks of an element, white space made single spaces, joined by one space."""
    pieces: list[str] = []
    stack: list = [(node, False)]
    while stack:
        x, ends = stack.pop()
        if isinstance(x, str):
            pieces.append(unescape(x))
        elif ends:
            pieces.append(" ")
        elif not x.out or x is node:
            if x.name in BLOCK:
                pieces.append(" ")
                stack.append((x, True))
            stack.extend((c, False) for c in reversed(x.children))
    return " ".join("".join(pieces).split())


def extract(html: str, path: str | None) -> str:
    return Page(html).text(path)


def _pages(df: DataFrame) -> DataFrame:
    host = F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit(""))
    return df.select(F.col("page_id").cast("long").alias("page_id"), "url", F.lower(host).alias("host"), F.coalesce("html", F.lit("")).alias("html"))


def host_paths(df: DataFrame) -> DataFrame:
    """host, path: the container path that most pages of a host vote for, by text held and then name on a tie."""

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = ((h, p, p.elected()) for h, p in zip(b["host"], map(Page, b["html"])))
            rows = [(h, node.path, p.score) for h, p, node in found if node is not None]
            yield pd.DataFrame(rows, columns=["host", "path", "score"]).groupby(["host", "path"], as_index=False).agg(votes=("score", "size"), score=("score", "sum"))

    votes = _pages(df).select("host", "html").mapInPandas(vote, "host string, path string, votes long, score double")
    counted = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("score").alias("score"))
    order = Window.partitionBy("host").orderBy(F.col("votes").desc(), F.round("score", 3).desc(), "path")
    return counted.withColumn("place", F.row_number().over(order)).where("place = 1").select("host", "path")


def main_text(df: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    # the table of winners is written first: its real size decides whether it is sent to all tasks, and a larger
    # one meets the pages by a join whose large hosts Spark splits
    winners = materialise(host_paths(df), "hosts")

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [extract(h, p if isinstance(p, str) else None) for h, p in zip(b["html"], b["path"])]
            yield pd.DataFrame({"page_id": b["page_id"].astype("Int64"), "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return _pages(df).join(winners, "host", "left").mapInPandas(again, "page_id long, url string, text string, n_chars long")
