"""Main text of web pages by tree scoring.

A page is read into a tree of elements with blocks of text.  Elements that never hold the article (scripts, forms,
navigation, footers, adverts, notices, reader comments, ...) are cut by element, role or class name.  A class name
alone does not cut what holds the page: an element with a name for content or with modifiers only (has-sidebar) stays,
and so does one that holds the only article or most of the paragraphs; its inner elements are judged anew.  A word that
content has in its names too (social, search, ...) cuts by name only where all words of the name are of that kind; beside
other words the element is judged by its paragraphs and link density.  Every paragraph of the rest passes points for its
length and commas to the nearest six ancestors, fewer the higher they are; a container's points are discounted by its
link density.  The best container is kept with those siblings that look like content: those with a share of its points,
text of few links between such siblings, and lists, tables and quotations of few links after them.  Where the best
container lies in an ``article`` or ``main``, its siblings and those of its ancestors up to that element stay unless most
of their text is links.  Nothing inside what is kept is dropped but what was cut before.

A page takes time in proportion to its length, however deep its elements lie.

Null, empty or text-free html gives an empty text.  Tags left open, cut off or closed twice are tolerated; character
references are decoded; any white space within a block becomes one space; blocks are joined by two newlines in page
order.  Repeated rows are extracted alike.  One page is one unit of work, so memory is bounded by the longest page.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import islice, takewhile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessella.tables import table

# Element and class names.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label",
    "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
}
CUT = {"head", "nav", "aside", "footer", "form", "button", "select", "option", "dialog", "menu", "template", "svg", "math", "canvas", "object", "audio", "video", "fieldset", "datalist"}
CUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
CUT_WORDS = {
    "ad", "adbox", "ads", "adsense", "adslot", "adunit", "adv", "advert", "advertisement", "advertising", "adverts", "alert", "announcement", "aside", "banner", "breadcrumb", "breadcrumbs", "comment",
    "comments", "commentlist", "consent", "cookie", "cookies", "disclaimer", "disqus", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar",
    "navigation", "newsletter", "notice", "notices", "overlay", "pagination", "pager", "popup", "promo", "promoted", "rail", "recommended", "related",
    "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "skyscraper", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
#: Of CUT_WORDS, those that page builders also give to the wrapper of an article.
LAYOUT_WORDS = {
    "alert", "announcement", "aside", "banner", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "notice", "notices", "overlay", "pager", "pagination", "promo",
    "promoted", "rail", "search", "share", "sharing", "sidebar", "skyscraper", "social", "toolbar", "widget",
}
#: Of CUT_WORDS, those that names of content have too ...
DOUBTFUL_WORDS = {
    "alert", "announcement", "banner", "disclaimer", "notice", "notices", "overlay", "pager", "rail", "recommended", "related", "replies",
    "reply", "respond", "search", "share", "sharing", "social", "widget",
}
#: ... and the words beside which they still cut.
BOX_WORDS = {
    "area", "articles", "bar", "block", "blocks", "bottom", "box", "button", "buttons", "card", "cards", "container", "content", "danger", "error", "float", "floating", "form", "global",
    "group", "icon", "icons", "info", "inline", "inner", "item", "items", "left", "legal", "link", "links", "list", "media", "message", "module", "outer", "page", "pages", "panel", "post", "posts",
    "primary", "right", "section", "site", "sticky", "stories", "story", "strip", "success", "system", "text", "title", "tool", "tools", "top", "warning", "wrap", "wrapper",
}
CONTENT_WORDS = {"article", "content", "entry", "headline", "post", "story", "title"}
LEAVES = {"p", "pre", "td", "th", "li", "dd", "dt", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "figcaption", "caption", "address"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
TEXT = {"ul", "ol", "dl", "table", "blockquote", "pre", "figure"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
WALLS = {"table", "ul", "ol", "dl", "td", "th", "article", "section", "div", "body", "blockquote", "main"}

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"""(?:[^>"']+|"[^"]*"|'[^']*')*+>""")
_NAMED = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_MODIFIER = re.compile(r"(^|[-_])(has|no|not|with|without|hide)[-_].*|.*[-_](enabled|disabled|free)$", re.I)
_ENDS = {tag: re.compile(f"</{tag}(?=[\\s/>])", re.I) for tag in RAW}


def named_cut(kind: str) -> tuple[str, set[str], bool]:
    """The first class name or id that has a word of CUT_WORDS (or header), all such words, and whether each such name is
    doubtful; empty if there is none, or if a name beside it has words for content and none of these."""
    first, found, doubtful = "", set(), True
    content = False
    for name in (_MODIFIER.sub("", x) for x in kind.split()):
        words = {w.lower() for w in _WORDS.findall(name)}
        cut = words & CUT_WORDS | ({"header"} if "header" in words and not words & CONTENT_WORDS else set())
        content = content or (not cut and bool(words & CONTENT_WORDS))
        if cut:
            first, found = first or name, found | cut
            doubtful = doubtful and cut <= DOUBTFUL_WORDS and not words <= CUT_WORDS | BOX_WORDS
    return ("", set(), False) if content or not first else (first, found, doubtful)


class Tree:
    """Elements as parallel lists, and the text blocks in page order as (element, text, characters in links)."""

    def __init__(self, page: str):
        self.tag, self.parent, self.cut = ["#root"], [-1], [False]
        self.named: dict[int, tuple[str, set[str], bool]] = {}  # elements that their class name may cut; whether by scores alone
        self.blocks: list[tuple[int, str, int]] = []
        # By element: the nearest that is not inline, whether a link is open, whether an article or main is.
        self._block, self._in_link, self._in_article = [0], [False], [False]
        self._open, self._at = [0], defaultdict(list)  # open elements, and their positions by tag
        self._text, self._linked = [], 0
        self._read(page)
        if self.named:
            self._settle()

    def summed(self, own: list) -> list:
        """An element's value with those of all elements in it; elements are in page order, so parents come first."""
        for e in range(len(own) - 1, 0, -1):
            if self.parent[e] > 0:
                own[self.parent[e]] += own[e]
        return own

    def _settle(self) -> None:
        """Cut the elements of ``named`` that do not hold the page, outermost first, with all they hold."""
        n = len(self.tag)
        chars, links, worth = [0] * n, [0] * n, [0.0] * n
        for owner, text, linked in self.blocks:
            chars[owner] += len(text)
            links[owner] += linked
            worth[owner] += points(text) * (1 - linked / len(text))
        rootless = worth[0]
        chars, links, worth = self.summed(chars), self.summed(links), self.summed(worth)
        last = list(range(n))  # the last element within
        for e in range(n - 1, 0, -1):
            last[self.parent[e]] = max(last[self.parent[e]], last[e])
        outer = [0] * n  # the outermost named element around, itself included
        whole = [0] * n  # the innermost article or main around, itself included
        for e in range(1, n):
            outer[e] = outer[self.parent[e]] or (e if e in self.named else 0)
            whole[e] = e if self.tag[e] in ("article", "main") and not self.cut[e] else whole[self.parent[e]]
        articles = [e for e in range(1, n) if whole[e] == e and chars[e]]
        total = rootless + sum(worth[e] for e in range(1, n) if self.parent[e] == 0)
        paragraphs = any(not outer[o] and (self.tag[o] == "p" or points(t) * (1 - k / len(t)) > 0) for o, t, k in self.blocks)
        outside = sum(points(t) * (1 - k / len(t)) for o, t, k in self.blocks if not outer[o])
        apart = [e for e in articles if not outer[e]]
        above = [0] * n  # elements of apart around
        for e in range(1, n):
            above[e] = above[self.parent[e]]
            if whole[e] == e and chars[e] and not outer[e]:
                above[e] += 1
        group: dict[str, float] = defaultdict(float)
        reach: dict[str, int] = {}
        for e in sorted(self.named):
            name = self.named[e][0]
            if e > reach.get(name, 0):
                reach[name] = last[e]
                group[name] += worth[e]
        for e in range(1, n):
            if self.cut[self.parent[e]]:
                self.cut[e] = True
            elif e in self.named:
                name, words, doubtful = self.named[e]
                if doubtful and worth[e] > 0 and 2 * links[e] < chars[e]:
                    continue
                around = whole[self.parent[e]]
                within = bisect_right(apart, last[e]) - bisect_left(apart, e)
                rival = len(apart) - within - above[e] > 0
                inside = articles[bisect_left(articles, e) : bisect_right(articles, last[e])] if not around and not apart else []
                # Teasers and comments come as articles too, several at a time.
                one = sum(not whole[self.parent[a]] for a in inside) == 1 or (bool(inside) and worth[e] >= outside)
                holds = any(self.tag[a] == "main" for a in inside) or (one and (words <= LAYOUT_WORDS or not paragraphs))
                share = max(worth[e], group[name] if "widget" in words else 0.0)
                most = worth[e] > 0 and 2 * share > total and not rival and (words <= LAYOUT_WORDS or not paragraphs)
                self.cut[e] = not (holds or most)
        self.blocks = [b for b in self.blocks if not self.cut[b[0]]]

    def _flush(self) -> None:
        text = " ".join("".join(self._text).split())
        if text:
            owner = self._block[self._open[-1]]
            if not self.cut[owner]:
                self.blocks.append((owner, text, min(self._linked, len(text))))
        self._text, self._linked = [], 0

    def _chars(self, raw: str) -> None:
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            if self.cut[self._open[-1]]:
                return
            self._text.append(text)
            if self._in_link[self._open[-1]]:
                self._linked += len(" ".join(text.split()))

    def _close(self, names: set[str], walls: set[str]) -> None:
        """Close the innermost open element of these names and all in it, unless a wall lies between."""
        k, tag = max(((self._at[x][-1], x) for x in names if self._at[x]), default=(0, ""))
        if not k or any(self._at[x] and self._at[x][-1] > k for x in walls):
            return
        if tag not in INLINE:  # the end of an inline element does not end the block
            self._flush()
        for e in self._open[k:]:
            self._at[self.tag[e]].pop()
        del self._open[k:]

    def _start(self, tag: str, attributes: str) -> None:
        if tag == "br" or tag == "wbr":
            self._text.append(" " if tag == "br" else "")
            return
        inline = tag in INLINE
        if not inline:
            self._flush()
            if tag not in VOID:
                self._close({"p"}, WALLS)
            if tag in CLOSES:
                self._close(CLOSES[tag], WALLS - CLOSES[tag])
        if tag in VOID:
            return
        top = self._open[-1]
        kind = " ".join(m[2].strip("\"'") for m in _NAMED.finditer(attributes) if m[1].lower() in ("class", "id")) if "=" in attributes else ""
        words = {w.lower() for w in _WORDS.findall(kind)}
        role = next((m[2].strip("\"'").lower() for m in _NAMED.finditer(attributes) if m[1].lower() == "role"), "") if "role" in attributes else ""
        cut = self.cut[top] or tag in CUT or role in CUT_ROLES
        name, cut_words, doubtful = ("", set(), False) if cut or tag in ("html", "body", "article", "main") else named_cut(kind)
        cut = cut or (tag == "article" and bool(words & {"comment", "comments"}))
        inner = self._in_article[top]
        if tag == "header":
            cut = cut or not inner
        if cut_words == {"header"} and (inner or tag not in ("div", "section")):
            cut_words = set()
        if "hidden" in attributes and re.search(r"(^|\s)hidden(\s|=|$)", re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes)):
            cut = True
        if cut_words and inline and not doubtful:  # its text is part of the block around it
            cut = True
        if cut and not self.cut[top] and inline:  # what a cut inline element holds must not join the text around it
            self._text.append(" ")
        self.tag.append(tag)
        self.parent.append(top)
        self.cut.append(cut)
        e = len(self.tag) - 1
        self._block.append(self._block[top] if inline else e)
        self._in_link.append(tag == "a" or self._in_link[top])
        self._in_article.append(inner or tag in ("article", "main"))
        if cut_words and not cut and not inline:
            self.named[e] = (name, cut_words, doubtful)
        self._at[tag].append(len(self._open))
        self._open.append(e)

    def _read(self, page: str) -> None:
        at, end = 0, len(page)
        while at < end:
            lt = page.find("<", at)
            if lt < 0:
                self._chars(page[at:])
                break
            self._chars(page[at:lt])
            name = _NAME.match(page, lt)
            if not name:
                if page.startswith("<!--", lt):
                    stop = page.find("-->", lt + 4)
                    at = end if stop < 0 else stop + 3
                elif page.startswith(("<!", "<?", "</"), lt):
                    stop = page.find(">", lt)
                    at = end if stop < 0 else stop + 1
                else:
                    self._chars("<")
                    at = lt + 1
                continue
            rest = _REST.match(page, name.end())
            stop = rest.end() if rest else page.find(">", name.end()) + 1
            if not stop:  # cut off within a tag
                break
            tag, attributes, at = name[1].lower(), page[name.end() : stop - 1], stop
            if page[lt + 1] == "/":
                if tag == "p" and not self._at["p"]:
                    self._flush()
                elif tag in INLINE:
                    self._close({tag}, WALLS | LEAVES)
                else:
                    self._close({tag}, set())
                continue
            if tag in RAW:
                close = _ENDS[tag].search(page, at)
                at = end if not close else close.start()
                if tag not in ("noscript", "iframe", "xmp"):
                    self._text.append(" ")
                if close:
                    stop = page.find(">", close.end())
                    at = end if stop < 0 else stop + 1
                continue
            self._start(tag, attributes)
            if attributes.endswith("/") and tag in ("a", "span", "svg", "math") and self._open[-1] == len(self.tag) - 1 and self.tag[-1] == tag:
                self._open.pop()
                self._at[tag].pop()
        self._flush()

    def _ancestors(self, e: int) -> Iterator[int]:
        while e > 0:
            yield e
            e = self.parent[e]


def points(text: str) -> float:
    """A paragraph's points: one, one a comma, one a hundred characters up to three; none below 25 characters."""
    return 0.0 if len(text) < 25 else 1 + text.count(",") + min(len(text) // 100, 3)


def _siblings(tree: Tree, best: int, final: list[float], chars: list[int], density: Callable[[int], float]) -> set[int]:
    """The siblings of the best container that belong to the article, itself included."""
    row = [e for e in range(1, len(tree.tag)) if tree.parent[e] == tree.parent[best] and chars[e]]
    own: dict[int, list[str]] = {e: [] for e in row if tree.tag[e] == "p"}
    for owner, text, _ in tree.blocks:
        if owner in own:
            own[owner].append(text)
    kept = set()
    for e in row:
        text = " ".join(own.get(e, ()))
        if e == best or 0 < final[e] >= 0.2 * final[best] or tree.tag[e] in ("h1", "h2") or (tree.tag[e] == "p" and (density(e) < 0.25 if len(text) > 80 else density(e) == 0 and text.endswith((".", "!", "?")))):
            kept.add(e)
    body = [k for k, e in enumerate(row) if e == best or (e in kept and tree.tag[e] not in HEADINGS)]
    last = max(body)  # up to it any text of few links is kept, beyond it only headings with text of the article below
    plain = [k for k, e in enumerate(row) if density(e) < 0.25]
    body += [k for k in plain if k > body[0] and tree.tag[row[k]] in TEXT]  # after them, text blocks
    kept |= {row[k] for k in body} | {row[k] for k in plain if body[0] < k < max(body) and (k < last or tree.tag[row[k]] in HEADINGS)}
    for k in range(body[0] - 1, -1, -1):  # headings right above the first
        if tree.tag[row[k]] not in HEADINGS or density(row[k]) >= 0.25:
            break
        kept.add(row[k])
    return kept


def extract(page: str | None) -> str:
    """The article's text, empty if there is none."""
    if not page:
        return ""
    tree = Tree(page)
    if not tree.blocks:
        return ""
    n = len(tree.tag)
    score, chars, linked = [0.0] * n, [0] * n, [0] * n
    for owner, text, links in tree.blocks:
        chars[owner] += len(text)
        linked[owner] += links
        share = points(text) * (1 - links / len(text))
        holder = tree.parent[owner] if tree.tag[owner] in LEAVES else owner
        for depth, e in enumerate(islice(tree._ancestors(holder), 6)):
            score[e] += share if depth == 0 else share / 2 if depth == 1 else share / (3 * depth)
    chars, linked = tree.summed(chars), tree.summed(linked)
    density = lambda e: linked[e] / chars[e] if chars[e] else 0.0
    final = [score[e] * (1 - density(e)) for e in range(n)]
    scored = [e for e in range(1, n) if final[e] > 0]
    if scored:
        best = max(scored, key=lambda e: (final[e], -e))
    else:
        best = next((e for want in ("article", "main", "body") for e in range(1, n) if tree.tag[e] == want and chars[e]), 0)
    kept, path = {best}, set()
    whole = next((e for want in ("article", "main") for e in tree._ancestors(best) if tree.tag[e] == want), None)
    if whole is None and best > 0:
        kept |= _siblings(tree, best, final, chars, density)
    elif whole not in (None, best):
        path = set(takewhile(lambda e: e != whole, tree._ancestors(tree.parent[best]))) | {whole}
        kept |= {e for e in range(1, n) if tree.parent[e] in path and e not in path and (density(e) < 0.5 or tree.tag[e] in LEAVES)}
    inside = [False] * n
    for e in range(n):
        inside[e] = e in kept or (e > 0 and inside[tree.parent[e]])
    return "\n\n".join(text for owner, text, links in tree.blocks if inside[owner] or (owner in path and 2 * links < len(text)))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row; text is never null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                texts = [extract(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars long")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extracted(table(spark, sf_dir, "pages"))


QUERIES = {"op8_html_extraction": op8_html_extraction}
