"""Main text of web pages, by container paths that the pages of a host agree on.

Each page is read into elements and blocks of text. Containers are scored by the text
outside links that lies in them, nearest container first. A page votes, with its best
container's score, for that container's generalised path: tags and classes from the root
on, without digits. Spark sums up the votes per host (combined before the shuffle) and keeps
each host's winner. Then every page is read again, and the elements with the winning path are its
article; a page on which that path holds little text, or less than nearly all of the text in the
page's own best container that it lies in, or is missing, uses its own best container.

Text may be dealt over containers. Where no article is marked, the best container gives way to
the one around it while the rest of that holds more text outside links than inside (for the body, and
what is around it: half as much text as the container), and containers with the same path that hold more text
outside links than inside are taken together.

Elements that never belong to an article (menus, buttons and fields, scripts, adverts, reader
comments and the like, by tag, role, style or class) are left out wherever they stand, phrases within a
paragraph too. One that holds most of a page's text in spite of its class is kept if the page marks no
article. A form is left out unless it holds most of the text or an article: then the page is wrapped in it.
Within a marked article a doubtful word beside others in a class (``related-work``) leaves an
element out only if its text is mostly links. All steps take time in proportion to the page.

Defined cases: null and empty html, and pages without text, give the empty text. Pages
without a host vote for themselves alone. Markup that is not closed ends with its parent.
Repeated rows are extracted one by one. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logwarden.llm.rows import texts, type_of
from logwarden.sources.landing import land

#: Kinds of elements.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template svg math object".split())
CONTAINERS = frozenset("html body main article section div td center".split())
ARTICLES = frozenset(("article", "main"))
#: Left out wherever they stand; a form only if it is not what the page is wrapped in.
NEVER = frozenset("nav footer aside menu button select label dialog head fieldset legend datalist output".split())
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu".split())
NEVER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar widget footer comment comments disqus reply replies respond cookie cookies consent "
    "notice gdpr popup modal overlay share sharing social related recommended newsletter subscribe subscription login "
    "signup search pagination pager toolbar skip alert alerts notification notifications toast announcement disclaimer "
    "masthead topbar".split())
#: Words of classes that are sure signs wherever they stand, and those that count on phrases and paragraphs too.
DOUBTFUL = frozenset(
    "related recommended notice search alert alerts notification notifications announcement disclaimer reply replies respond "
    "promotion subscription".split())
SURE = NEVER_WORDS - DOUBTFUL
ADVERTS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo".split())
PHRASES = frozenset("p h1 a span b i em strong".split())
GOOD_WORDS = frozenset("article content post entry main story text body".split())
#: Elements that an opening tag ends if one is open: the tag, what it ends, and what it does not look beyond.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*)>?", re.S)
#: A whole attribute: name, and value in quotes or bare.
ATTRIBUTE = re.compile(r"([^\s/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: A style that hides an element.
HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
HOST = re.compile(r"\s*[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")
#: An element left out by its class is kept if it holds so much of the page's text; a host's path is used on a page
#: if it scores at least so much of what the page's own best container does, and, where it lies in that, holds so much of
#: its text; a page's body is its article if its rest holds so much of what the best container does.
MOST, ENOUGH, NEARLY, REST = 0.6, 0.3, 0.95, 0.5
ROOTS = frozenset(("#", "html", "body"))


class Page:
    """Elements in order of their tags (parents before children) and blocks of text; all steps are linear in the page."""

    def __init__(self, html: str) -> None:
        self.parent, self.tag, self.label, self.out = [-1], ["#"], ["#"], [""]
        self.kind = [0]  # equal for elements of equal paths
        self.kinds: dict[tuple[int, str], int] = {}
        self.in_article = [False]
        self.pieces: list[tuple[int, list[tuple[int, str, bool]]]] = []  # of a block: element, text, whether in a link
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links
        self.scores: dict[int, float] = {}
        self.plain: dict[int, int] = {}  # characters outside links, and in them, of containers
        self.linked: dict[int, int] = {}
        self.read(html)
        self.drop_hidden()
        self.score()

    # --- markup to elements and pieces of text ---------------------------------------

    def read(self, html: str) -> None:
        stack, pieces, open_tags = [0], [], Counter()
        at = 0

        def add(raw: str) -> None:
            if raw:
                pieces.append((stack[-1], unescape(raw), open_tags["a"] > 0))

        def flush() -> None:
            if pieces:
                self.pieces.append((stack[-1], pieces.copy()))
                pieces.clear()

        def close(index: int) -> None:
            if any(self.tag[e] in BLOCKS for e in stack[index:]):
                flush()
            open_tags.subtract(self.tag[e] for e in stack[index:])
            del stack[index:]

        for found in TOKEN.finditer(html):
            begin = found.start()
            if begin < at:
                continue  # inside a raw element
            add(html[at:begin])
            at = found.end()
            name = found[2]
            if name is None:
                continue
            name = name.lower()
            if found[1]:
                if open_tags[name] > 0:
                    close(next(k for k in range(len(stack) - 1, 0, -1) if self.tag[stack[k]] == name))
                elif name in BLOCKS:
                    flush()
                continue
            if name == "br":
                pieces.append((stack[-1], " ", open_tags["a"] > 0))
                continue
            if name in RAW:
                if not found[3].endswith("/"):
                    end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                    at = end.end() if end else len(html)
                continue
            ends, beyond = ENDS.get(name, (("p",), ("body",)) if name in BLOCKS else ((), ()))
            if any(open_tags[t] > 0 for t in ends):
                for index in range(len(stack) - 1, 0, -1):
                    tag = self.tag[stack[index]]
                    if tag in ends:
                        close(index)
                        break
                    if tag in beyond or tag in CONTAINERS:
                        break
            if name in BLOCKS:
                flush()
            if name not in VOID and not found[3].endswith("/"):
                stack.append(self.element(stack[-1], name, found[3]))
                open_tags[name] += 1
        add(html[at:])
        flush()

    def element(self, parent: int, name: str, attributes: str) -> int:
        has: dict[str, str] = {}
        for k, a, b, c in ATTRIBUTE.findall(attributes):
            has.setdefault(k.lower(), a or b or c)  # of repeated attributes the first counts
        names = [re.sub(r"[\d>]+", "", c).strip("-_") for c in has.get("class", "").split()]
        self.parent.append(parent)
        self.tag.append(name)
        self.label.append(".".join([name, *sorted({c for c in names if c})]))
        self.kind.append(self.kinds.setdefault((self.kind[parent], self.label[-1]), len(self.kinds) + 1))
        self.out.append(self.reason(name, has, self.in_article[parent]))
        self.in_article.append(self.in_article[parent] or name in ARTICLES)
        return len(self.tag) - 1

    @staticmethod
    def reason(name: str, has: dict[str, str], in_article: bool) -> str:
        """Why an element by itself is no part of an article: always, form, class, or (perhaps) weak; or ""."""
        if name in ("html", "body", "main", "article"):
            return ""
        if (name in NEVER or "hidden" in has or has.get("aria-hidden") == "true"
                or has.get("role", "").lower() in NEVER_ROLES or HIDING.search(has.get("style", ""))):
            return "always"
        if name == "form":
            return "form"
        tokens = [{w.lower() for w in WORDS.findall(c)} for c in f"{has.get('class', '')} {has.get('id', '')}".split()] if has else []
        words = set().union(*tokens)
        if (name == "header" or "header" in words and not words & GOOD_WORDS) and not in_article:
            return "class"  # a page's header; an article's own holds its title
        if name in PHRASES:
            return "class" if words & ADVERTS else ""
        if words & SURE or any(t and t <= NEVER_WORDS for t in tokens):
            return "class"
        # one doubtful word beside others, as in related-work
        return ("weak" if in_article else "class") if words & NEVER_WORDS else ""

    # --- what is left out ----------------------------------------------------------

    def drop_hidden(self) -> None:
        """Decide which elements are left out, and make blocks of the pieces outside of them."""
        n = len(self.tag)
        always, chars, linked = [False] * n, [0] * n, [0] * n
        for e in range(1, n):
            always[e] = always[self.parent[e]] or self.out[e] == "always"
        for _, pieces in self.pieces:
            for e, text, link in pieces:
                if not always[e]:
                    size = len("".join(text.split()))
                    chars[e] += size
                    linked[e] += size * link
        article = [t in ARTICLES and not a for t, a in zip(self.tag, always)]
        for e in range(n - 1, 0, -1):
            up = self.parent[e]
            chars[up] += chars[e]
            linked[up] += linked[e]
            article[up] = article[up] or article[e] and chars[e] > 0
        # an article within what a class leaves out does not make the page one with a marked article
        free = [True] * n
        for e in range(1, n):
            free[e] = free[self.parent[e]] and self.out[e] in ("", "weak", "form")
        marked = any(self.tag[e] in ARTICLES and free[e] and article[e] and chars[e] for e in range(1, n))
        for e in range(1, n):
            large = chars[e] >= MOST * chars[0] > 0
            if (self.out[e] == "form" and (large or article[e]) or self.out[e] == "class" and large and not marked
                    or self.out[e] == "weak" and 2 * linked[e] < chars[e]):
                self.out[e] = ""
        gone = [False] * n
        for e in range(1, n):
            gone[e] = gone[self.parent[e]] or self.out[e] != ""
        for element, pieces in self.pieces:
            kept = [(text, link) for e, text, link in pieces if not gone[e]]
            text = " ".join("".join(t for t, _ in kept).split())
            if text:
                self.blocks.append((element, text, min(sum(len(t) for t, link in kept if link), len(text))))

    # --- which container -------------------------------------------------------------

    def score(self) -> None:
        """A container's text outside links: its own as a whole, that of containers in it at half their score."""
        n = len(self.tag)
        own, chars, linked, articles = [0.0] * n, [0] * n, [0] * n, [False] * n
        for element, text, in_links in self.blocks:
            own[element] += len(text) - in_links
            chars[element] += len(text)
            linked[element] += in_links
        for e in range(n - 1, -1, -1):
            container = self.tag[e] in CONTAINERS or e == 0
            if chars[e] and container:
                self.plain[e], self.linked[e] = chars[e] - linked[e], linked[e]
                words = {w.lower() for w in WORDS.findall(self.label[e])}
                factor = 1.5 if self.tag[e] in ARTICLES else 1.25 if words & GOOD_WORDS else 1.0
                self.scores[e] = own[e] * factor * (1 - linked[e] / chars[e])
                articles[e] = articles[e] or self.tag[e] in ARTICLES
            if e:
                up = self.parent[e]
                own[up] += own[e] / 2 if container else own[e]
                chars[up] += chars[e]
                linked[up] += linked[e]
                articles[up] = articles[up] or articles[e]
        self.marked = articles  # elements that are or hold an article with text

    def line(self, element: int) -> Iterator[int]:
        """The element and what it is in, innermost first."""
        while element >= 0:
            yield element
            element = self.parent[element]

    def within(self, elements: set[int]) -> list[bool]:
        """Per element whether it is, or lies in, one of these."""
        inside = [False] * len(self.tag)
        for e in range(len(inside)):
            inside[e] = e in elements or e > 0 and inside[self.parent[e]]
        return inside

    def best(self) -> int:
        """The best container, or the article it is in."""
        if not self.scores:
            return 0
        top = max(self.scores, key=lambda e: (self.scores[e], -e))
        return next((e for e in self.line(top) if self.tag[e] in ARTICLES and e in self.scores), top)

    def path(self, element: int) -> str:
        return ">".join(self.label[e] for e in reversed(list(self.line(element))))

    def main(self) -> list[int]:
        """The best container, climbed to what holds the text beside it, and those like it."""
        best = self.best()
        if self.tag[best] in ARTICLES or not self.scores:
            return [best]
        top = below = best
        for e in self.line(self.parent[best]):
            if self.marked[e]:
                break
            if e not in self.scores:
                continue
            if self.tag[e] in ROOTS:
                climb = self.plain[e] - self.plain[top] >= REST * self.plain[top]
            else:
                climb = self.plain[e] - self.plain[below] > self.linked[e] - self.linked[below]
            below = e
            top = e if climb else top
        return self.alike(top)

    def alike(self, element: int) -> list[int]:
        """The container and those with its path that are no lists of links; an article stands alone."""
        if self.tag[element] in ARTICLES:
            return [element]
        return sorted(e for e in self.scores if e == element or self.kind[e] == self.kind[element] and self.plain[e] > self.linked[e])

    def with_path(self, path: str, own: list[int]) -> list[int] | None:
        """The containers with this path, if they hold enough of the page, of which ``own`` is the main part."""
        kind: int | None = 0
        for label in path.split(">")[1:]:
            kind = self.kinds.get((kind, label))
        same = [e for e in self.scores if self.kind[e] == kind]
        if not same:
            return None
        top = max(same, key=lambda e: (self.scores[e], -e))
        found = self.alike(top)
        if self.scores[top] < ENOUGH * self.scores.get(self.best(), 0.0):
            return None
        mine, inner = set(own), set(found)
        in_mine = self.within(mine)
        if mine != inner and any(in_mine[f] for f in found):
            in_inner = self.within(inner)
            held = sum(self.plain[f] for f in found)
            around = sum(self.plain[e] for e in own if not in_inner[e])
            return found if held >= NEARLY * around else None
        return found

    def text(self, containers: list[int]) -> str:
        inside = self.within(set(containers))
        return "\n".join(text for element, text, _ in self.blocks if inside[element])


def host_of(url: str | None) -> str:
    found = HOST.match(url or "")
    return found[1].lower() if found else ""


def extract(html: str, path: str | None = None) -> str:
    page = Page(html)
    own = page.main()
    return page.text(page.with_path(path, own) or own if path else own)


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, score) of each page's best container."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url, html in zip(batch.column("url").to_pylist(), texts(batch.column("html"))):
                host = host_of(url)
                if host and html:
                    page = Page(html)
                    own = page.main()
                    rows.append((host, page.path(own[0]), sum(page.scores.get(e, 0.0) for e in own)))
            hosts, paths, scores = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(scores, pa.float64())],
                ["host", "path", "score"])

    return pages.select("url", "html").mapInArrow(run, "host string, path string, score double")


def winners(pages: DataFrame) -> DataFrame:
    """(host, path): the path with the largest sum of scores (rounded, so that the order of adding is of no account)."""
    sums = votes(pages).groupBy("host", "path").agg(F.round(F.sum("score")).alias("score"))
    return sums.groupBy("host").agg(F.max(F.struct("score", "path")).alias("best")).select("host", "best.path")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars per page."""
    chosen = land(winners(pages), "host_paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [extract(h, p) for h, p in zip(texts(batch.column("html")), batch.column("path").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()),
                 pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    host = F.lower(F.regexp_extract(F.col("url"), r"^\s*[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.selectExpr("page_id", "url", "cast(html as string) as html").withColumn("host", host)
    rows = rows.join(chosen, "host", "left").select("page_id", "url", "html", "path")
    return rows.mapInArrow(run, f"page_id {type_of(pages, 'page_id')}, url string, text string, n_chars bigint")
