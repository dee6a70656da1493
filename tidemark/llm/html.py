"""Main text of web pages by tag-path ratios.

A page is cut into text blocks, each with its root-to-leaf path of block elements. Per path the text length and the
punctuation per block are taken; the blocks' values are smoothed in page order, fused, and held against a threshold.
The blocks that pass choose the article: it is the element that holds the most text of passing blocks, less the text
(above all that of links) of those that fail. Short paragraphs and headings inside it thus stay whatever their own
ratio. Tags, roles, classes and ids only take away: elements that can hold no article text go with all in them, and
elements whose name may also be that of a part of an article go where their ratios fail as well.

Pages are independent: one pass over each, no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shingles import bites

#: Names of HTML elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page; the first kind ends the page where they are not closed, the tag of the
#: second is passed over then, and so it is where it closes itself.
RAW = set("script style textarea title".split())
SKIPPED = set("noscript template iframe svg object annotation annotation-xml".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
MATH = set("math mi mo mn ms mtext mrow mfrac msqrt mroot msup msub msubsup munder mover munderover mtable mtr mtd mstyle mspace mpadded mphantom menclose semantics".split())
IN_TEXT = INLINE | MATH | {"svg", "annotation", "annotation-xml"}
#: Elements that hold text, but are no part of a page that could hold an article.
LEAVES = set("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption pre blockquote figure figcaption address hgroup".split())
DROPPED = set("nav footer aside form button select option menu dialog head datalist audio video canvas optgroup fieldset".split())
ARTICLE = set("article main".split())
NEVER_HINTED = set("html body article main".split())
#: An opening tag of the first kind ends open elements of the second.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of classes and ids that name no part of an article; inside an article's element they count where the ratios fail.
HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|ad(?:box|slot|unit|block|container|wrapper)|advert\w*|adsense|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|nav|navbar|navigation|menu|breadcrumbs?|sidebar|sharing|social|comments?|commentlist|disqus|footer|masthead|subscribe|newsletter|signup|login|popup|modal|overlay|toolbar|pagination|pager|copyright)(?:$|[\s_-])",
    re.I,
)
#: Names of what readers write, wherever it stands: a whole class or id.
COMMENTS = re.compile(r"(?:^|\s)(?:(?:user|reader|post|article)s?[_-]?)?comments?(?:[_-]?(?:list|area|section|thread|wrapper|container|box|form|body|item))?(?:$|\s)|(?:^|\s)disqus[\w-]*", re.I)
#: Words that may: they count where the ratios fail as well.
MAYBE = re.compile(r"(?:^|[\s_-])(?:banner|notices?|alert|disclaimer|side|widgets?|related|recommend\w*|share|responses?|respond|reply|replies|discussion|foot|form|search|legal|skip)(?:$|[\s_-])", re.I)
#: Of a page's header, but not of an article's.
HEAD_HINT = re.compile(r"(?:^|[\s_-])header(?:$|[\s_-])", re.I)
#: What a class says of its surroundings: "has-sidebar" is no sidebar.
AROUND = re.compile(r"(?:^|(?<=[\s_-]))(?:has|with|without|no)[-_][\w-]+", re.I)
_VALUE = r"""(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*)"""
TAG = re.compile(rf"""<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[\s/]++|[^\s"'>/=][^\s/>=]*+(?:\s*+=\s*+{_VALUE})?|["'=])*+)>""")
NAMED = re.compile(rf"""(?:^|[\s/"'])(class|id|role|hidden|aria-hidden)(?:\s*=\s*({_VALUE})|(?=[\s/>]|$))""", re.I)
PUNCTUATION = re.compile(r"[.,;:!?。，！？¿¡]")


class _Page:
    """Blocks of one page, in order: text, path, element, length of link text, and whether it can be of no article.

    A path is a number, that of a tag below another path, so a page may be of any depth.
    """

    def __init__(self, html: str):
        self.parent, self.tag, self.maybe = [-1], [""], [False]
        self.blocks: list[tuple[str, int, int, int, bool]] = []
        self.stack: list[tuple[str, int, bool, int]] = [("", 0, False, 0)]
        self.paths: dict[tuple[int, str], int] = {}
        self.open: dict[str, int] = {}
        self.held: list[str] = []
        self.links, self.in_link = 0, 0
        self.read(html)

    def read(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            lt = html.find("<", at)
            if lt < 0:
                self.text(html[at:])
                break
            if lt > at:
                self.text(html[at:lt])
            if html.startswith("<!--", lt):
                end = html.find("-->", lt + 2)  # "<!-->" is a whole comment
                at = n if end < 0 else end + 3
                continue
            m = TAG.match(html, lt)
            if m is None:
                if html[lt + 1 : lt + 2] in ("!", "?", "/") or html[lt + 1 : lt + 2].isalpha():
                    end = html.find(">", lt)
                    at = n if end < 0 else end + 1
                else:
                    self.text("<")
                    at = lt + 1
                continue
            at, tag = m.end(), m[2].lower()
            if m[1]:
                self.end(tag)
            elif tag in RAW or tag in SKIPPED:
                if tag not in IN_TEXT:
                    self.flush()
                if tag in SKIPPED and m[3].endswith("/"):
                    continue
                end = re.compile(f"</{tag}[^>]*>", re.I).search(html, at)
                at = end.end() if end else at if tag in SKIPPED else n
            else:
                self.start(tag, m[3])
        self.flush()

    def text(self, s: str) -> None:
        # decoded here: a reference does not reach across a tag
        s = unescape(s)
        self.held.append(s)
        if self.in_link:
            self.links += len(s)

    def flush(self) -> None:
        if self.held:
            s = " ".join("".join(self.held).split())
            if s:
                _, element, dropped, path = self.stack[-1]
                self.blocks.append((s, path, element, min(self.links, len(s)), dropped))
            self.held, self.links = [], 0

    def start(self, tag: str, attributes: str) -> None:
        if tag in IN_TEXT:
            if tag == "br":
                self.text(" ")
            elif tag == "a":
                self.in_link += 1
            return
        self.flush()
        self.in_link = 0
        if self.open.get("p"):
            self.pop("p")
        for other in CLOSES.get(tag, ()):
            if self.stack[-1][0] == other:
                self.pop(other)
        if tag in VOID:
            return
        in_article = any(self.open.get(t) for t in ARTICLE)
        dropped, maybe = self.stack[-1][2] or tag in DROPPED, tag == "header" and not in_article
        if attributes and not dropped and tag not in NEVER_HINTED:
            for name, value in NAMED.findall(attributes):
                value = value.strip("\"'")
                name = name.lower()
                if name == "role":
                    dropped = dropped or value.lower() in ROLES
                elif name in ("hidden", "aria-hidden"):
                    dropped = dropped or value.lower() in ("", "hidden", "true")
                else:
                    value = AROUND.sub("", value)
                    named = bool(HINT.search(value))
                    dropped = dropped or bool(COMMENTS.search(value)) or (not in_article and (named or bool(HEAD_HINT.search(value))))
                    maybe = maybe or named or bool(MAYBE.search(value))
        self.parent.append(self.stack[-1][1])
        self.tag.append(tag)
        self.maybe.append(maybe)
        path = self.paths.setdefault((self.stack[-1][3], tag), len(self.paths) + 1)
        self.stack.append((tag, len(self.tag) - 1, dropped, path))
        self.open[tag] = self.open.get(tag, 0) + 1

    def end(self, tag: str) -> None:
        if tag in IN_TEXT:
            if tag == "br":
                self.text(" ")
            elif tag == "a" and self.in_link:
                self.in_link -= 1
            return
        self.flush()
        if self.open.get(tag):
            self.pop(tag)

    def pop(self, tag: str) -> None:
        while len(self.stack) > 1:
            last = self.stack.pop()[0]
            self.open[last] -= 1
            if last == tag:
                return

    def sums(self, of_block: np.ndarray) -> list[float]:
        """A value of the blocks added up for every element, with all in it."""
        out = [0.0] * len(self.tag)
        for block, x in zip(self.blocks, of_block.tolist(), strict=True):
            out[block[2]] += x
        for i in range(len(out) - 1, 0, -1):  # an element comes after its parent
            out[self.parent[i]] += out[i]
        return out


def _smooth(x: np.ndarray) -> np.ndarray:
    kernel = np.array([0.1, 0.2, 0.4, 0.2, 0.1])
    return np.convolve(np.pad(x, 2, mode="edge"), kernel, "valid")


def fused(blocks: list[tuple[str, int, int, int, bool]]) -> np.ndarray:
    """Each block's smoothed ratio of text to its path times that of punctuation."""
    length, marks, count = {}, {}, {}
    for s, path, _, links, _ in blocks:
        length[path] = length.get(path, 0) + len(s) - links
        marks[path] = marks.get(path, 0) + len(PUNCTUATION.findall(s))
        count[path] = count.get(path, 0) + 1
    text = np.array([length[b[1]] / count[b[1]] for b in blocks])
    punctuation = np.array([marks[b[1]] / count[b[1]] for b in blocks])
    return _smooth(text) * (1 + _smooth(punctuation))


#: What a character that is no link takes off where its block fails; one of a link takes off 1.
PLAIN = 0.25


def main_text(html: str, sharpness: float = 0.5) -> str:
    """The article of one page; ``sharpness`` times the deviation of the fused ratios is the threshold."""
    page = _Page(html)
    if not page.blocks:
        return ""
    value = fused(page.blocks)
    passed = value >= min(sharpness * value.std(), value.max())
    size, links, open_ = (np.array(x) for x in zip(*((len(b[0]), b[3], not b[4]) for b in page.blocks), strict=True))
    gain = page.sums(np.where(passed, size - links, -(links + PLAIN * (size - links))) * open_)
    # the element of the largest gain, the innermost of equal ones
    best = max((i for i, t in enumerate(page.tag) if t not in LEAVES), key=lambda i: (gain[i], i))
    all_, good = page.sums(size * open_), page.sums(size * (passed & open_))
    inside = [False] * len(page.tag)
    for i, parent in enumerate(page.parent):
        # an element that may be no part of an article goes where less than half of its text passed
        gone = i > best and page.maybe[i] and 2 * good[i] < all_[i]
        inside[i] = i == best or (parent >= 0 and inside[parent] and not gone)
    return "\n\n".join(b[0] for b in page.blocks if inside[b[2]] and not b[4])


def extract(df: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, ``text`` and n_chars (code points) of every page.

    Blocks have their character references decoded and white space (line-break elements too) made one space, and are
    joined by two line feeds. A null or empty page gives an empty text. Repeated rows stay, other columns are not read,
    an empty table gives an empty one. A page may be of any length and depth: time and memory are linear in it.
    """
    rows = df.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for pages in bites(batch.column(2), lambda h: len(h.as_py() or "")):
                part = batch.slice(at, len(pages))
                at += len(pages)
                texts = [main_text(h.as_py()) if h.is_valid else "" for h in pages]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    schema = rows.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")
    return rows.mapInArrow(run, schema)
