"""Main text of web pages by paths that the pages of a host agree on.

Every page's outer containers (article or main, else those right inside the
body) are scored by all the text they hold outside links and page furniture,
however deep, and the best one, with those beside it that hold a paragraph of
their own, votes for its generalised path (tags with their classes, numbers
removed). Spark counts the votes of each host; each page is
then extracted again from the containers on its host's winning path, or from its
own best container where the page has none on it.

Pages are read by a small scanner that keeps a stack of structural elements
only, so unclosed inline and paragraph elements do no harm.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinculo.llm.common import MOST_SENT_IDS, column, map_slices, materialize

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL)
#: Whole attributes one after another, so that no name is found inside the value of another attribute.
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
#: Elements whose content is not text of the page.
_RAW = frozenset({"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "object", "xmp"})
_DROPPED = frozenset({"nav", "header", "footer", "aside", "form", "menu", "button", "select", "dialog", "fieldset", "head"})
_STRUCTURE = frozenset({"html", "body", "div", "section", "article", "main", "table", "tbody", "tr", "td", "th", "ul", "ol", "dl", "center", "details", "figure", "figcaption", "blockquote"}) | _DROPPED
_CONTAINERS = frozenset({"body", "div", "section", "article", "main", "td", "center"})
_BLOCKS = _STRUCTURE | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "pre", "br", "hr", "address", "summary", "caption", "option", "img"}
_VOID = frozenset({"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"})
_HEADINGS = frozenset({"h1", "h2", "h3"})
_ANY_HEADING = _HEADINGS | {"h4", "h5", "h6"}
#: Elements of running text: of the words below only those of adverts, notices and comments count on them.
_TEXT = frozenset({"p", "li", "dt", "dd", "pre", "blockquote", "span", "a", "b", "i", "em", "strong", "small"})
#: Words of classes and ids that mark page furniture.
_FURNITURE = re.compile(
    r"(?:^|[-_\s])(?:ads?|adverts?|advertisements?|adsense|sponsor(?:ed)?|promo(?:tion)?s?|banners?|cookies?|consent|gdpr|notices?|alerts?|sidebars?|side"
    r"|navs?|navbar|navigation|menus?|breadcrumbs?|footers?|headers?|masthead|topbar|toolbar|comments?|disqus|replies|respond|discussion|share|sharing|social"
    r"|related|recommend(?:ed|ations)?|newsletter|subscribe|signup|login|popup|modal|overlay|widgets?|pagination|pager|skip|search)(?:$|[-_\s\d])",
    re.IGNORECASE,
)
_TEXT_FURNITURE = re.compile(
    r"(?:^|[-_\s])(?:ads?|adverts?|advertisements?|adsense|sponsor(?:ed)?|promo(?:tion)?s?|banners?|cookies?|consent|gdpr|notices?|alerts?|sidebars?"
    r"|navs?|navbar|navigation|menus?|breadcrumbs?|footers?|comments?|disqus|replies|respond|discussion)(?:$|[-_\s\d])",
    re.IGNORECASE,
)
_HEADER = re.compile(r"(?:^|[-_\s])headers?(?:$|[-_\s\d])", re.IGNORECASE)
#: Characters outside links that make a block a paragraph of the article.
_PARAGRAPH = 80
_MAIN_NAMES = re.compile(r"article|content|post|entry|story|main|text|body", re.IGNORECASE)
_COMMENTS = re.compile(r"comment|disqus|replies|respond|discussion", re.IGNORECASE)
_SPACES = re.compile(r"\s+")
_NUMBER = re.compile(r"\d+")


@dataclass
class _Open:
    """An open structural element."""

    tag: str
    dropped: bool
    #: The element in ``Page.steps``, and the digest of its path.
    node: int = -1
    digest: bytes = b""
    comments: bool = False
    aside: bool = False
    #: An article, a main or an element named like one, or inside one.
    main: bool = False
    #: Header of a container: only its headings count.
    headings: bool = False
    #: The nearest container at or above, and the place in the stack of the outermost dropped element.
    holder: int = -1
    first_dropped: int = -1


@dataclass
class Page:
    """Text blocks of a page with the containers they are in, and the containers' scores.

    Paths are kept as steps and parents, with a digest of fixed size for
    comparing, and written out for the container that votes only.
    """

    steps: list[str] = field(default_factory=list)
    above: list[int] = field(default_factory=list)
    nodes: list[int] = field(default_factory=list)
    digests: list[bytes] = field(default_factory=list)
    #: The longest paragraph that counts to a container.
    longest: list[int] = field(default_factory=list)
    #: Numbers of the blocks that are headings of the first rank.
    titles: set[int] = field(default_factory=set)
    scores: list[float] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    #: The outer container that each one counts to.
    tops: list[int] = field(default_factory=list)
    #: (container number, text) in page order.
    blocks: list[tuple[int, str]] = field(default_factory=list)

    def path(self, k: int) -> str:
        steps, node = [], self.nodes[k]
        while node >= 0:
            steps.append(self.steps[node])
            node = self.above[node]
        return ">".join(reversed(steps))

    def tag(self, k: int) -> str:
        return self.steps[self.nodes[k]].partition(".")[0] if k >= 0 else ""


def _digest(above: bytes, step: str) -> bytes:
    return hashlib.blake2b(above + step.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def path_digest(path: str) -> bytes:
    made = b""
    for step in path.split(">"):
        made = _digest(made, step)
    return made


def _attributes(raw: str) -> tuple[str, bool]:
    """Class and id, and whether the element is hidden."""
    names, hidden = [], False
    for m in _ATTRIBUTE.finditer(raw):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            names.append(value)
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
            hidden = True
        elif name == "role" and value in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert"):
            names.append("nav")
    return " ".join(names), hidden


def _step(tag: str, names: str) -> str:
    classes = sorted({_NUMBER.sub("", x) for x in names.replace(">", "").split()} - {""})
    return ".".join([tag, *classes])


def _is_main(step: str) -> bool:
    tag, _, names = step.partition(".")
    return tag in ("article", "main") or tag not in ("html", "body") and _MAIN_NAMES.search(names) is not None


def _only_header(names: str) -> bool:
    """Whether the class and id say header and nothing else of the page furniture."""
    return _HEADER.search(names) is not None and _FURNITURE.search(_HEADER.sub(" ", names)) is None


def read_page(source: str) -> Page:
    """One pass over the tags of a page; work and memory grow with its length."""
    page = Page()
    stack: list[_Open] = []
    text: list[str] = []
    length = link = 0
    in_link = 0
    heading = False

    title = False
    open_tags: Counter[str] = Counter()

    def container(tag: str, node: int, digest: bytes, up: int) -> int:
        own = len(page.nodes)
        page.nodes.append(node)
        page.digests.append(digest)
        page.scores.append(0.0)
        page.longest.append(0)
        page.parents.append(up)
        outer = page.tops[up] if up >= 0 else -1
        over = page.tag(outer)
        first = outer < 0 or over == "body" or tag in ("article", "main") and over not in ("article", "main")
        page.tops.append(own if first else outer)
        return own

    def end_block() -> None:
        nonlocal text, length, link
        if text:
            words = _SPACES.sub(" ", "".join(text)).strip()
            if words:
                own = stack[-1].holder if stack else -1
                if title:
                    page.titles.add(len(page.blocks))
                page.blocks.append((own, words))
                if own >= 0 and length > link:
                    worth = (length - link) * (1.0 - link / max(length, 1))
                    top = page.tops[own]
                    page.scores[top] += worth
                    page.longest[top] = max(page.longest[top], length - link)
                    if (parent := page.parents[top]) >= 0:
                        page.scores[page.tops[parent]] += 0.5 * worth
            text = []
        length = link = 0

    def close(upto: int) -> None:
        end_block()
        for x in stack[upto:]:
            open_tags[x.tag] -= 1
        del stack[upto:]

    def add(piece: str) -> None:
        nonlocal length, link
        if piece and not (stack and stack[-1].dropped and not (stack[-1].headings and heading)):
            if "&" in piece:
                piece = html.unescape(piece)
            text.append(piece)
            size = len(piece)
            length += size
            link += size if in_link else 0

    at = 0
    for m in _TAG.finditer(source):
        if m.start() < at:
            continue
        add(source[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                in_link = max(0, in_link - 1)
            if tag in _HEADINGS:
                end_block()
                heading = title = False
            for k in range(len(stack) - 1, -1, -1) if open_tags[tag] else ():
                if stack[k].tag == tag:
                    close(k)
                    break
                if tag not in _STRUCTURE and stack[k].tag in _STRUCTURE:
                    break
            if tag in _BLOCKS:
                end_block()
            continue
        if tag in _RAW and not m[3].rstrip().endswith("/"):
            end_raw = re.compile(rf"</{tag}\b[^>]*>?", re.IGNORECASE).search(source, at)
            at = end_raw.end() if end_raw else len(source)
            continue
        names, hidden = _attributes(m[3]) if m[3] else ("", False)
        furniture = bool(names) and tag not in _ANY_HEADING and (_TEXT_FURNITURE if tag in _TEXT else _FURNITURE).search(names) is not None
        if tag in ("article", "main") and stack and stack[-1].dropped and not furniture:
            # An unclosed menu or advert before the article ends where the article starts.
            if not (stack[-1].comments or stack[-1].aside):
                close(stack[-1].first_dropped)
        if tag in _BLOCKS:
            end_block()
            while stack and stack[-1].tag == "p":
                close(len(stack) - 1)
        if tag in _HEADINGS:
            heading, title = True, tag == "h1"
        if tag == "a":
            in_link += 1
        if tag in _VOID or m[3].endswith("/") and tag not in _STRUCTURE:
            continue
        up = stack[-1] if stack else None
        drop = furniture and tag not in ("html", "body", "main") or hidden or tag in _DROPPED
        if tag in _STRUCTURE or drop:
            if tag == "article" and furniture and not _COMMENTS.search(names) and not hidden:
                drop = False
            step = _step(tag, names)
            own = _Open(tag, bool(drop or up and up.dropped), len(page.steps), _digest(up.digest if up else b"", step))
            page.steps.append(step)
            page.above.append(up.node if up else -1)
            own.comments = bool(up and up.comments) or bool(names) and _COMMENTS.search(names) is not None
            own.aside = bool(up and up.aside) or tag == "aside"
            own.main = bool(up and up.main) or _is_main(step) and not own.dropped
            header = tag == "header" or drop and not hidden and tag in _STRUCTURE and tag not in _DROPPED and _only_header(names)
            own.headings = bool(up and up.headings) or header and not (up and up.dropped) and bool(up and up.main)
            own.first_dropped = up.first_dropped if up and up.dropped else len(stack)
            own.holder = up.holder if up else -1
            if tag in _CONTAINERS and not own.dropped:
                own.holder = container(tag, own.node, own.digest, own.holder)
            open_tags[tag] += 1
            stack.append(own)
    add(source[at:])
    end_block()
    for k, node in enumerate(page.nodes):
        last = page.steps[node]
        if last.startswith(("article", "main")):
            page.scores[k] = page.scores[k] * 1.5 + 1
        elif _MAIN_NAMES.search(last.partition(".")[2]):
            page.scores[k] *= 1.25
    return page


def best_container(page: Page) -> int:
    """The container with the highest score, the outermost of equals; -1 without one."""
    return max(range(len(page.scores)), key=lambda k: (page.scores[k], -k), default=-1)


def text_of(page: Page, path: str | None) -> str:
    """Text inside the containers on ``path`` (one a line), or in the best ones if there is none on it."""
    wanted = {path_digest(x) for x in path.split("\n")} if path else set()
    chosen = {k for k, x in enumerate(page.digests) if x in wanted}
    if not any(k in chosen for k, _ in page.blocks) and not _inside(page, chosen):
        best = best_container(page)
        if best < 0:
            return " ".join(x for _, x in page.blocks)
        chosen = {best} | _neighbours(page, best)
    inside = _inside(page, chosen)
    first = next((n for n, (k, _) in enumerate(page.blocks) if k in inside), 0)
    # A title right before its article, where the article has none.
    titles = {n for n in page.titles if n < first and page.blocks[n][0] in {page.parents[k] for k in chosen}}
    if any(page.blocks[n][0] in inside for n in page.titles):
        titles = set()
    return " ".join(x for n, (k, x) in enumerate(page.blocks) if k in inside or n in titles)


def _neighbours(page: Page, best: int) -> set[int]:
    """Where the best container is none of an article or main: the others beside it that hold a paragraph of their own."""
    body = page.parents[best]
    if page.tag(best) in ("article", "main") or page.tag(body) != "body":
        return set()
    return {k for k, up in enumerate(page.parents) if up == body and page.tops[k] == k and page.longest[k] >= _PARAGRAPH}


def voted_path(page: Page, best: int) -> str:
    """The paths of the best container and its neighbours, one a line."""
    return "\n".join(sorted({page.path(k) for k in {best} | _neighbours(page, best)}))


def _inside(page: Page, chosen: set[int]) -> set[int]:
    """Containers at or below the chosen ones that hold text; parents come before children."""
    found = set()
    for k, parent in enumerate(page.parents):
        if k in chosen or parent in found:
            found.add(k)
    held = {k for k, _ in page.blocks}
    return found if found & held else set()


def host_votes(pages: DataFrame) -> DataFrame:
    """(host, path, votes, score): how many pages of a host have their best container on a path."""

    def make():
        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            hosts, paths, scores = [], [], []
            for host, source in zip(column(part, "host").to_pylist(), column(part, "html").to_pylist(), strict=True):
                page = read_page(source or "")
                best = best_container(page)
                if best >= 0 and page.scores[best] > 0:
                    hosts.append(host)
                    paths.append(voted_path(page, best))
                    scores.append(page.scores[best])
            return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(scores, pa.float64())], names=["host", "path", "score"])

        return one

    votes = map_slices(pages.select("host", "html"), make, "host string, path string, score double", "html", 1 << 21)
    return votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"), F.sum("score").alias("score"))


def winning_paths(votes: DataFrame) -> DataFrame:
    """(host, path): the path with most votes, of equals the one with more text, then the first by name."""
    best = F.max_by("path", F.struct("votes", F.round("score", 3), "path"))
    return votes.groupBy("host").agg(best.alias("path"))


def with_host(pages: DataFrame, url: str = "url") -> DataFrame:
    """The host of a URL in lower case, without port; pages without one share the host ''."""
    host = F.regexp_extract(F.lower(F.coalesce(F.col(url), F.lit(""))), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1)
    return pages.withColumn("host", host)


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page.

    A null or empty page has an empty text. A null URL counts to the host ''.
    Repeated rows vote and are extracted each; null ids stay; columns besides
    page_id, url and html are not read; an empty table gives no rows.
    """
    pages = with_host(pages.select("page_id", "url", "html"))
    winners = materialize(winning_paths(host_votes(pages)), "host-paths")
    # Few hosts are sent to all tasks; many are joined, where the engine splits a host with most of the pages.
    if winners.count() <= MOST_SENT_IDS // 8:
        winners = F.broadcast(winners)
    known = pages.join(winners, "host", "left")

    def make():
        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            texts = [text_of(read_page(x), path) if x else "" for x, path in zip(column(part, "html").to_pylist(), column(part, "path").to_pylist(), strict=True)]
            columns = [column(part, "page_id"), column(part, "url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

        return one

    kind = pages.schema["page_id"].dataType.simpleString()
    return map_slices(known.select("page_id", "url", "html", "path"), make, f"page_id {kind}, url string, text string, n_chars long", "html", 1 << 21)
