"""Main text of web pages by tag-path ratios.

A page is read once into blocks of text; each block has a path, the block elements (with their classes) from the root to
its own. Inline elements are no step of a path, so that a sentence is kept or dropped as a whole. Over all blocks of one
path three things are summed: characters outside links, punctuation marks and the number of blocks.

1. Smoothing: a path also gets the sums of every other path, less by the factor NEAR for each step between the two in
   the tree of paths. Two passes over that tree give this exactly, whatever the number of paths.
2. Fusion: a path's score is the geometric mean of its smoothed characters a block and punctuation marks a block.
3. Threshold: a path is content if its score is at least THRESHOLD of the page's mean score, weighted by characters,
   and links hold no more than MOST_LINKED of its own text.

What an element is said to be goes before its ratios: text in menus, headers, footers, asides, forms and the like (by tag,
or by a word of class, id or role) is none of the candidates, and where a page names its main part (article, main),
paths outside of it are none either and paths inside need only pass the limit on links.

Pages are read one by one in tasks, so a host with most of the pages is no group. Time and memory of a page grow with
its length alone, however deep or broken its markup is.
"""

from __future__ import annotations

import html
import re
from math import sqrt

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

NEAR, THRESHOLD, MOST_LINKED = 0.3, 0.4, 0.6
#: Pages read before their texts leave the task.
PAGES = 64
PUNCTUATION = re.compile(r"[.,;:!?…،؛؟。、，；：！？।]")

# Elements of HTML by what they do to the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre search section summary table ul dd dt".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that end an open one of these, if it stands above the nearest of the second.
IMPLIED_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
#: Elements whose text is never the article's.
NEVER = frozenset("applet audio aside button canvas datalist dialog footer form head iframe input map math menu nav noembed noframes noscript object script select style svg template textarea title video".split())
#: Words of class, id or role that say so.
NAMED = frozenset(
    "ad ads adsense adslot advert advertisement adverts aside banner breadcrumb breadcrumbs colophon comment commentlist comments consent cookie cookies copyright"
    " discussion disqus dropdown footer form gdpr login masthead menu menubar modal nav navbar navigation navigationbar newsletter notice notices notification"
    " pager pagination paywall popup promo promoted promotion recommended recommendations related replies respond search share sharing sidebar signup skip"
    " social sponsor sponsored sponsors subscribe subscription tabs toolbar topbar trackback widget widgets".split()
)
MAIN_NAMES = frozenset(["articlebody", "main"])
ABOUT_OTHERS = frozenset("has is no with without".split())
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: Up to the end of a tag, quoted values whole.
IN_TAG = re.compile(r"""(?:[^"'>]++|"[^"]*+"|'[^']*+')*+>""")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""")


def tokens(page: str):
    """("text", text), ("open", tag, attributes) and ("close", tag, None) in order; comments, raw text and declarations are skipped.

    What never ends (a comment, a script) goes on to the end of the page. A tag whose quotes don't match ends at the first ``>``.
    """
    at, n, quoted = 0, len(page), True
    while at < n:
        tag = page.find("<", at)
        if tag < 0:
            yield "text", page[at:], None
            return
        if tag > at:
            yield "text", page[at:tag], None
        follows = page[tag + 1 : tag + 2]
        if page.startswith("<!--", tag):
            end = page.find("-->", tag + 2)  # <!--> ends itself
            at = n if end < 0 else end + 3
        elif follows in ("!", "?") or page.startswith("</", tag) and not page[tag + 2 : tag + 3].isalpha():
            end = page.find(">", tag)
            at = n if end < 0 else end + 1
        elif follows == "/" or (follows.isascii() and follows.isalpha()):
            start = tag + 1 + (follows == "/")
            name = NAME.match(page, start)
            if not name:
                yield "text", "<", None
                at = tag + 1
                continue
            end = IN_TAG.match(page, name.end()) if quoted else None
            if end:
                stop = end.end()
            else:
                quoted = False  # a quote stays open to the end of the page: from here on none is trusted
                stop = page.find(">", name.end()) + 1 or n
            kind = name.group().lower()
            if follows == "/":
                yield "close", kind, None
            else:
                yield "open", kind, page[name.end() : stop]
                if kind in RAW:
                    close = re.compile(rf"</{kind}(?=[\s/>])", re.I).search(page, stop)
                    stop = close.start() if close else n
            at = stop
        else:
            yield "text", "<", None
            at = tag + 1


def names(attributes: str, parts: bool = True) -> set[str]:
    """The names in class, id, role and itemprop, lower case, and the words they are made of (``parts``).

    A name that says what else a page has or lacks (``no-sidebar``) says nothing of its element.
    """
    out: set[str] = set()
    for m in ATTRIBUTE.finditer(attributes):
        if m[1].lower() in ("class", "id", "role", "itemprop"):
            value = html.unescape(m[2] or m[3] or m[4] or "")
            for part in value.split():
                out.add(part.lower())
                words = [w.lower() for w in WORD.findall(part)]
                if parts and words and words[0] not in ABOUT_OTHERS:
                    out.update(words)
    return out


def hides(attributes: str) -> bool:
    """Whether an element says that it is not shown."""
    low = attributes.lower()
    return bool(re.search(r"\shidden(?=[\s/>=]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", low))


class Page:
    """The blocks of a page: text, the number of characters in links, and the path."""

    def __init__(self, page: str):
        #: Tree of paths: parent and step of each; path 0 is the root.
        self.parent, self.step, self.known = [-1], [("", False, False)], {}
        self.blocks: list[tuple[int, str, int]] = []  # path, text, characters in links
        self._parts: list[str] = []
        self._linked = self._links = 0
        self.stack: list[tuple[str, int, bool]] = []  # element, path, whether it is inline
        self.count: dict[str, int] = {}
        for kind, value, attributes in tokens(page):
            if kind == "text":
                text = html.unescape(value)
                self._parts.append(text)
                if self._links:
                    self._linked += len(" ".join(text.split()))
            elif kind == "open":
                self._open(value, attributes)
            else:
                self._close(value)
        self._flush()

    def _path(self) -> int:
        return self.stack[-1][1] if self.stack else 0

    def _flush(self) -> None:
        text = " ".join("".join(self._parts).split())
        if text:
            self.blocks.append((self._path(), text, min(self._linked, len(text))))
        self._parts.clear()
        self._linked = 0

    def _pop(self) -> None:
        tag, _, inline = self.stack[-1]
        if not inline:
            self._flush()
        self.stack.pop()
        self.count[tag] -= 1
        self._links -= tag == "a"

    def _end(self, tags, borders) -> None:
        """Ends the nearest open one of ``tags`` and all in it, unless a border stands above it."""
        if not any(self.count.get(t) for t in tags):
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in tags:
                while len(self.stack) > i:
                    self._pop()
                return
            if self.stack[i][0] in borders:
                return

    def _open(self, tag: str, attributes: str) -> None:
        if tag in VOID:
            if tag in ("br", "hr"):
                self._flush()
            return
        if tag in CLOSES_P:
            self._end(("p",), SCOPES)
        if tag in IMPLIED_ENDS:
            ends, borders = IMPLIED_ENDS[tag]
            while any(self.count.get(t) for t in ends):
                before = len(self.stack)
                self._end(ends, borders)
                if len(self.stack) == before:
                    break
        inline = tag in INLINE
        above = self._path()
        hidden = len(attributes) > 1 and hides(attributes)
        said = names(attributes, tag != "article") if len(attributes) > 1 and not (inline and not hidden and tag != "span") else set()
        if inline and not hidden and not said & NAMED:
            self.stack.append((tag, above, True))
        else:
            self._flush()
            within = self.step[above][2]
            main = tag in ("article", "main") or bool(said & MAIN_NAMES)
            bad = hidden or tag in NEVER or (tag == "header" and not within) or ("header" in said and not within and not main and tag not in HEADINGS)
            bad = bad or (bool(said & NAMED) and tag not in ("html", "body", "main"))
            main = main and not bad
            own_class = next((m[2] or m[3] or m[4] for m in ATTRIBUTE.finditer(attributes) if m[1].lower() == "class"), None) if said else None
            key = (above, tag, own_class, bad, main)
            if key not in self.known:
                self.known[key] = len(self.parent)
                self.parent.append(above)
                self.step.append((tag, bad or self.step[above][1], (main or within) and not bad))
            self.stack.append((tag, self.known[key], False))
        self.count[tag] = self.count.get(tag, 0) + 1
        self._links += tag == "a"

    def _close(self, tag: str) -> None:
        if tag == "br":
            self._flush()
        elif self.count.get(tag):
            if tag in INLINE:  # an inline element is not ended from inside a later block
                for i in range(len(self.stack) - 1, -1, -1):
                    if self.stack[i][0] == tag:
                        while len(self.stack) > i:
                            self._pop()
                        return
                    if not self.stack[i][2]:
                        return
            else:
                self._end((tag,), ())
        elif tag in CLOSES_P:
            self._flush()


#: Elements out of which no paragraph is ended.
SCOPES = frozenset("applet button caption html marquee object table td template th".split())


def smoothed(parent: list[int], own: list[float]) -> list[float]:
    """Each path's sum of ``own`` over all paths, by NEAR to the power of the steps between them. Parents come first."""
    inside = own[:]
    for i in range(len(own) - 1, 0, -1):
        inside[parent[i]] += NEAR * inside[i]
    out = inside[:]
    for i in range(1, len(own)):
        out[i] += NEAR * (out[parent[i]] - NEAR * inside[i])
    return out


def content_paths(page: Page) -> set[int]:
    """The paths whose blocks are content."""
    n = len(page.parent)
    free, linked, marks, blocks = [0.0] * n, [0] * n, [0.0] * n, [0.0] * n
    for path, text, links in page.blocks:
        if not page.step[path][1]:
            free[path] += len(text) - links
            linked[path] += links
            marks[path] += len(PUNCTUATION.findall(text))
            blocks[path] += 1
    used = [i for i in range(n) if blocks[i]]
    named = [i for i in used if page.step[i][2]]
    # headings count as linked only if they stand outside of the main part
    plain = [i for i in used if linked[i] <= MOST_LINKED * (free[i] + linked[i]) or (page.step[i][2] and page.step[i][0] in HEADINGS)]
    if any(page.step[i][2] for i in plain):
        return {i for i in plain if page.step[i][2]}
    if named:
        plain = [i for i in plain if not page.step[i][2]] or named
    length, punctuation, number = (smoothed(page.parent, x) for x in (free, marks, blocks))
    score = {i: sqrt(length[i] / number[i] * punctuation[i] / number[i]) for i in plain}
    total = sum(free[i] for i in plain)
    mean = sum(free[i] * score[i] for i in plain) / total if total else 0.0
    keep = {i for i in plain if score[i] >= THRESHOLD * mean}
    beside = {page.parent[i] for i in keep}
    return keep | {i for i in plain if page.step[i][0] in HEADINGS and page.parent[i] in beside}


def main_text(page: str | None) -> str:
    """The page's content blocks, each with single spaces, joined by one space."""
    read = Page(page or "")
    keep = content_paths(read)
    return " ".join(text for path, text, _ in read.blocks if path in keep)


def extracted(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all but the page) of each row with ``text`` and ``n_chars``.

    A null or empty page, and one without content, has an empty text. Pages are read whole, repeated rows one by one; an empty
    table gives no rows. Columns named ``text`` or ``n_chars`` are replaced.
    """
    kept = [c for c in (pages.columns if keep is None else keep) if c not in (html_col, "text", "n_chars")]

    def task(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, PAGES):
                rows = batch.slice(i, PAGES)
                texts = [main_text(p) for p in rows.column(rows.num_columns - 1).to_pylist()]
                columns = [*rows.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [*kept, "text", "n_chars"])

    kinds = ", ".join([f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept] + ["text string", "n_chars long"])
    return pages.select(*[F.col(f"`{c}`") for c in kept], F.col(html_col).cast("string").alias(html_col)).mapInArrow(task, kinds)


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all ``pages``."""
    return extracted(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


QUERIES = {"op12_html_extraction": (op12_html_extraction, None)}
