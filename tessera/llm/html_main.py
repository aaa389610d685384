"""Main text of web pages by consensus host paths (operator 3).

First pass: every page scores its containers (text outside links and page furniture, times the share that such text has of
all that the container holds) and votes with its better containers' generalised tag-class paths. A path is known by a hash
that is made from its parent's, so deep pages cost no more. Spark adds up the votes of a host and keeps its winning path. Second pass: a page takes its text from all containers at its host's winning path,
or from their smallest common container where that holds more; from its own best container where that encloses them, where
there are none, or where they hold little of what the page has.

What is furniture is told by elements and roles, and by class names: outside an article or <main> by any word of a name, inside one
(and for paragraphs, headings and the like everywhere) only where the whole name is made of such words, as `ad-slot` and
`related-posts` are but `related-work` and `social-science` aren't. A list of links is a menu, but not inside an article or <main>.

Edge cases: null or empty html gives an empty text; a null or odd url makes the page a host of its own making (it uses its
own best container); unclosed, crossed and stray tags are read as browsers do in the main; a page of any length and depth is
read whole, in steps that grow with its length; repeated page_ids are rows like any other; ties of votes go to the deeper
path, then the greater hash; further columns, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import table, written

#: Winning paths are broadcast up to so many hosts (about 100 bytes each); beyond it they are joined by a shuffle.
MAX_BROADCAST_HOSTS = 200_000
#: A page votes for containers that score so much of its best, and takes the host's container if that scores as much.
VOTE_SHARE = 0.5
OWN_SHARE = 0.3
#: A list of links: so much of its text is in links.
LINK_SHARE = 0.9

# Element names by what HTML makes of them.
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_CONTAINER = frozenset("html body main article section div td center".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noscript noembed noframes xmp".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_DROPPED = frozenset("head nav footer aside form button select option datalist template svg math canvas object audio video menu dialog label".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager sidebar aside rail footer foot "
    "banner cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login form search share sharing social related recommended recommendations trending "
    "comment comments commentlist respond reply replies disqus discussion widget toolbar copyright skip hidden".split()
)
#: Words that say nothing of their own in the name of a piece of furniture.
_NEUTRAL = frozenset("site page main top bottom left right center box block blocks wrap wrapper container inner outer area list item items section slot unit units button buttons btn link links post posts article articles story stories content contents body bar col column row group holder panel card cards text title heading small large big mobile desktop primary secondary sticky fixed float inline in and of the to by us on for x n".split())
_MASTHEAD = frozenset("header head masthead topbar".split())
#: Elements that hold text of their own rather than parts of a page.
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption figure".split())

_OPEN = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
_NAME = re.compile(r"[^\s/>]+")
#: The rest of a tag up to its end, quoted values being whole.
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTR = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_DIGITS = re.compile(r"\d+")

#: What an element is: kept; a head, of which only headings are kept; furniture; named like furniture by the whole of a name,
#: or by a part of one. The named may be wrappers of everything (`class="page has-sidebar"`) and so count as furniture only
#: without a main heading inside.
KEPT, HEAD, FURNITURE, NAMED, ALLUDED = range(5)


def _tags(html: str) -> Iterator[tuple[str, str, str, bool]]:
    """(text before, name, attributes, closing) of each tag; the text after the last one has an empty name. Linear.

    A tag's quotes are minded until one tag runs to the end of the page for want of a closing quote; from there on a tag ends
    at its first `>`. A `<` after which no `>` comes is text.
    """
    at, seek, end, quotes = 0, 0, len(html), True
    before: list[str] = []
    while (m := _OPEN.search(html, seek)) is not None:
        i = m.start()
        if html.startswith("<!--", i):
            before.append(html[at:i])
            stop = html.find("-->", i + 4)
            at = seek = end if stop < 0 else stop + 3
            continue
        stop = html.find(">", i)
        if stop < 0:
            break
        if html[i + 1] in "!?":
            before.append(html[at:i])
            at = seek = stop + 1
            continue
        closing = html[i + 1] == "/"
        name = _NAME.match(html, i + 1 + closing)
        if quotes:
            if rest := _REST.match(html, name.end()):
                stop = rest.end() - 1
            else:
                quotes = False
        before.append(html[at:i])
        lower = name[0].lower()
        yield "".join(before), lower, html[name.end() : max(stop, name.end())], closing
        before = []
        at = seek = max(stop, name.end()) + 1
        if not closing and lower in _RAW:
            close = re.compile(rf"</{lower}(?=[\s/>])", re.I).search(html, at)
            stop = html.find(">", close.end()) if close else -1
            at = seek = end if stop < 0 else stop + 1
    yield "".join(before) + html[at:], "", "", False


@lru_cache(maxsize=1 << 14)
def _element(tag: str, attrs: str) -> tuple[str, int]:
    """The generalised step of a path, and what the element is by itself."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)} if attrs else {}
    classes = found.get("class", "").split()
    named = [*classes, *([found["id"]] if found.get("id") else [])]
    parts = [{w.lower() for w in _PIECE.findall(name) if not w.isdigit()} for name in named]
    words = set().union(*parts)
    whole = any(p & _FURNITURE and p <= _FURNITURE | _NEUTRAL for p in parts)
    step = tag + "".join(f".{_DIGITS.sub('N', c.lower())}" for c in sorted(set(classes))) + (f"#{_DIGITS.sub('N', found['id'].lower())}" if found.get("id") else "")
    state = KEPT
    if tag in _DROPPED or found.get("role", "").lower() in _ROLES:
        state = FURNITURE
    elif tag not in ("html", "body", "main", "article") and words & _FURNITURE:
        state = NAMED if whole else KEPT if tag in _TEXT else ALLUDED
    elif tag == "header" or tag not in ("html", "body", "main", "article") and words & _MASTHEAD and tag not in _HEADING:
        state = HEAD
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")):
        state = FURNITURE
    return step, state


@lru_cache(maxsize=1 << 15)
def _below(parent: int, step: str) -> int:
    """The hash of a path of one step more."""
    return int.from_bytes(blake2b(f"{parent}>{step}".encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def path_hash(path: str) -> int:
    """The hash of a path written out, its steps joined by `>`."""
    found = 0
    for step in path.split(">"):
        found = _below(found, step)
    return found


class _Stack:
    """Open elements, with the depths at which each name is open, so that nothing walks the whole stack."""

    def __init__(self):
        self.at, self.names = [0], ["#root"]
        self.where: dict[str, list[int]] = {}

    def push(self, i: int, name: str) -> None:
        self.where.setdefault(name, []).append(len(self.at))
        self.at.append(i)
        self.names.append(name)

    def last(self, names) -> int:
        """The greatest depth at which one of these is open; 0 if none is."""
        return max((d[-1] for n in names if (d := self.where.get(n))), default=0)

    def cut(self, depth: int) -> None:
        """Closes what is open from a depth on."""
        while len(self.at) > max(1, depth):
            self.at.pop()
            self.where[self.names.pop()].pop()


class Page:
    """A page's block elements as parallel lists (a parent comes before its children), and its blocks of text in page order."""

    def __init__(self, html: str):
        self.tag, self.step, self.parent, self.state = ["#root"], ["#root"], [-1], [KEPT]
        self.path, self.depth = [0], [0]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links
        self._read(html)
        self._weigh()

    def _read(self, html: str) -> None:
        stack, buf, link, linked, breaks = _Stack(), [], False, 0, 0

        def flush() -> None:
            nonlocal buf, linked, link, breaks
            if buf:
                if text := " ".join("".join(buf).split()):
                    self.blocks.append((stack.at[-1], text, min(linked, len(text))))
                buf = []
            linked, link, breaks = 0, False, 0

        for text, name, attrs, closing in _tags(html):
            if text:
                if "&" in text:
                    text = unescape(text)
                buf.append(text)
                if text.strip():
                    breaks = 0
                    if link:
                        linked += len(text)
            if not name:
                continue
            if closing:
                if name == "a":
                    link = False
                elif name == "p" or name in _BLOCK or stack.where.get(name):
                    flush()
                    if depth := stack.last((name,)):
                        stack.cut(depth)
                continue
            if name in _RAW:
                continue
            if name == "br":
                breaks += 1
                buf.append(" ")
                if breaks == 2:
                    flush()
                continue
            if name in _VOID:
                if name == "hr":
                    flush()
                continue
            if name == "a":
                link = True
                continue
            block = name in _BLOCK
            if not block and name not in _DROPPED and not ("class" in attrs or "id" in attrs or "hidden" in attrs or "role" in attrs or "style" in attrs):
                continue
            step, state = _element(name, attrs)
            if not block and state in (KEPT, HEAD, ALLUDED):
                continue
            if block:
                flush()
                top = stack.names[-1]
                if top == "p" or top in _HEADING and name in _HEADING:
                    stack.cut(len(stack.at) - 1)
                elif name in _CLOSES:
                    same, scope = _CLOSES[name]
                    limit = stack.last(scope)
                    while (depth := stack.last(same)) > limit:
                        stack.cut(depth)
                        if name != "tr":
                            break
                elif name != "head" and stack.where.get("head"):
                    stack.cut(stack.where["head"][0])
            parent = stack.at[-1]
            self.tag.append(name)
            self.step.append(step)
            self.parent.append(parent)
            self.state.append(state)
            self.path.append(_below(self.path[parent], step))
            self.depth.append(self.depth[parent] + 1)
            stack.push(len(self.tag) - 1, name)
        flush()

    def _weigh(self) -> None:
        n = len(self.tag)
        every, linked, items = [0] * n, [0] * n, [0] * n
        for i, text, links in self.blocks:
            every[i] += len(text)
            linked[i] += links
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            every[p] += every[i]
            linked[p] += linked[i]
            items[p] += self.tag[i] == "li"
        # A wrapper is told from furniture by what it holds: the main heading, or for a head the article itself.
        h1, body = [t == "h1" for t in self.tag], [t in ("main", "article") for t in self.tag]
        for i in range(n - 1, 0, -1):
            h1[self.parent[i]] |= h1[i]
            body[self.parent[i]] |= body[i]
        inside = [False] * n  # of an article, or of the main part of a page
        for i in range(1, n):
            inside[i] = inside[self.parent[i]] or self.tag[i] in ("article", "main")
            if self.state[i] == NAMED:
                self.state[i] = KEPT if h1[i] and self.tag[i] not in _HEADING else FURNITURE
            elif self.state[i] == ALLUDED:
                self.state[i] = KEPT if h1[i] or inside[i] else FURNITURE
            elif self.state[i] == HEAD and body[i]:
                self.state[i] = KEPT
            self.state[i] = max(self.state[i], self.state[self.parent[i]])
            if self.tag[i] in ("ul", "ol") and not inside[i] and items[i] > 1 and linked[i] >= LINK_SHARE * every[i] > 0:
                self.state[i] = FURNITURE
        # Furniture is never taken, so a container isn't the worse for holding some.
        good, every = [0] * n, [0] * n
        for i, text, links in self.blocks:
            if self.state[i] < FURNITURE:
                every[i] += len(text)
            if self.state[i] == KEPT or self.state[i] == HEAD and self.tag[i] in _HEADING:
                good[i] += len(text) - links
        for i in range(n - 1, 0, -1):
            good[self.parent[i]] += good[i]
            every[self.parent[i]] += every[i]
        self.good, self.every = good, every
        self.score = [good[i] * good[i] // every[i] if every[i] and (self.tag[i] in _CONTAINER or i == 0) and self.state[i] == KEPT else 0 for i in range(n)]

    def best(self) -> int:
        """The container with the highest score; of equal ones the innermost and first."""
        return max(range(len(self.tag)), key=lambda i: (self.score[i], self.depth[i], -i))

    def votes(self) -> dict[int, tuple[int, int]]:
        """Paths of the better containers, each with its depth and its best score in millionths of the page's best."""
        top, out = max(self.score), {}
        for i, s in enumerate(self.score):
            if top and s >= VOTE_SHARE * top:
                p = self.path[i]
                out[p] = (self.depth[i], max(out.get(p, (0, 0))[1], s * 1_000_000 // top))
        return out

    def _line(self, i: int) -> list[int]:
        """An element and all that it lies in, outermost first."""
        line = [i]
        while i > 0:
            line.append(i := self.parent[i])
        return line[::-1]

    def _common(self, elements: list[int]) -> int:
        """The smallest container that holds all of the elements: as they are in page order, that of the first and last."""
        line = [a for a, b in zip(self._line(elements[0]), self._line(elements[-1])) if a == b]
        return next(i for i in reversed(line) if i == 0 or self.tag[i] in _CONTAINER)

    def _chosen(self, path: int | None) -> list[int]:
        own = self.best()
        if path is None:
            return [own]
        there = [i for i, p in enumerate(self.path) if p == path and self.score[i] > 0]
        good, every = sum(self.good[i] for i in there), sum(self.every[i] for i in there)
        if not there or good * good // every < OWN_SHARE * self.score[own]:
            return [own]
        common = self._common(there)
        if own in self._line(common):
            return [own]
        return [common] if self.good[common] > good else there

    def text(self, path: int | None) -> str:
        """The kept blocks of the containers at a path and of what encloses them, or of the page's own best one."""
        inside = [False] * len(self.tag)
        for i in self._chosen(path):
            inside[i] = True
        for i in range(1, len(inside)):
            inside[i] = inside[i] or inside[self.parent[i]]
        return "\n".join(t for i, t, _ in self.blocks if inside[i] and (self.state[i] == KEPT or self.state[i] == HEAD and self.tag[i] in _HEADING))


def _vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        cast = [(h, p, d, v) for h, html in zip(rows["host"], rows["html"]) for p, (d, v) in Page(html).votes().items()]
        yield pd.DataFrame(cast, columns=["host", "path", "depth", "vote"])


@F.pandas_udf(T.StringType())
def _extract(html: pd.Series, path: pd.Series) -> pd.Series:  # path: a hash as text, since pandas makes nullable longs doubles
    return pd.Series([Page(h).text(None if pd.isna(p) else int(p)) if h else "" for h, p in zip(html, path)], dtype=object)


def _host(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def host_paths(pages: DataFrame) -> DataFrame:
    """host and its winning path (a hash): the one with most votes; of equal ones the deepest, then the greatest hash."""
    rows = pages.select(_host(F.col("url")).alias("host"), "html").filter("host <> '' AND html <> ''")
    votes = rows.mapInPandas(_vote, "host string, path long, depth int, vote long").groupBy("host", "path").agg(F.sum("vote").alias("vote"), F.max("depth").alias("depth"))
    return votes.groupBy("host").agg(F.max(F.struct("vote", "depth", "path"))["path"].alias("path"))


def main_text(pages: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """page_id, url and text of every page. paths: host and path, by default those that the pages themselves elect."""
    paths = written(paths if paths is not None else host_paths(pages), "host-paths")
    if paths.count() <= MAX_BROADCAST_HOSTS:
        paths = F.broadcast(paths)
    rows = pages.select("page_id", "url", "html", _host(F.col("url")).alias("host")).join(paths, "host", "left")
    return rows.select("page_id", "url", _extract("html", F.col("path").cast("string")).alias("text"))


def op3_extract_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3 over all pages."""
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
