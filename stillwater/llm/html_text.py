"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one a block element, in page order. A line's length is that of its
text outside links; lines in menus, headers, footers, sidebars, notices, adverts, forms and reader
comments have length 0. Sums over sliding windows of lines rise at a surge point, where the main text
begins, and fall to nothing at a dive point, where it ends; lines with text between them are kept. Where a page marks its
article, the mark is a prior: text in links counts within it, a surge is half as high within it and twice as high outside,
and the article's edge ends a text. A marked article, or a page without a mark, that is too
short for any surge point is taken whole, as far as it is not skipped.

Defined results: a null or empty page, or one without main text, gives an empty text and 0
characters; repeated rows are read alike; an end tag finds its opening tag at any depth; an unclosed tag is dropped and an unclosed comment,
script or style runs to the page's end; a page of any length is read whole, and equal lines are
all kept; further columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillwater.llm.common import id_type, map_texts

#: A comment, a declaration, or a tag; an attribute's quoted value may hold ">".
TOKEN = re.compile(r"<!--(?:.*?--!?>|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(?=/?[A-Za-z])[^>]*(?:>|\Z)", re.S)
NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "xmp", "noembed"}
ASIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "fieldset", "head", "svg", "object", "audio", "video", "canvas", "datalist"}
BLOCKS = ASIDE | set("address article blockquote body center dd details dir div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hr html legend li main ol optgroup option p pre section summary table tbody tfoot thead tr ul caption".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
KEEPS = {"article", "main"}
#: No end tag of what is not a block reaches past them.
WALLS = KEEPS | ASIDE
#: What the parts of a page that are not main text are called by their class, id or role: one of these words, then only words
#: for kinds of boxes. Other words after it ("share-of-market") make it a name of content.
KIND = r"(?:[-_]?(?:bar|box|list|links?|buttons?|block|area|wrap(?:per)?|container|widgets?|menu|nav|top|bottom|left|right|main|inner|outer|section|panel|form|icons?|items?|title|header|footer|modal|popup|banner|overlay|slot|unit|media|signup|subscribe|[0-9]+))*"
ASIDE_WORDS = (
    "ads?|adv|advert(?:s|isements?|ising)?|banners?|sponsor(?:s|ed)?|promo(?:s|tions?)?|cookies?(?:[-_](?:policy|law|consent|notice))?|consent|notices?|notifications?|alerts?|sidebar|complementary|menus?|nav|navigation|"
    "breadcrumbs?|footer|header|mast(?:head)?|share|sharing|social|related(?:[-_](?:posts?|articles?|stories|news|content|topics))?|newsletters?|subscri(?:be|ptions?)|sign-?up|login|search|popups?|modal|tool|widgets?|"
    "contentinfo|pagination|skip(?:[-_]to[-_][a-z]+)?|disclaimer"
)
NOT_MAIN = re.compile(rf"(?!.*(?:with|has|no)[-_])(?:(?:{ASIDE_WORDS}){KIND}|(?:\w+[-_])+(?:ads?|advert|sidebar|menu|nav|navbar|banner|notice|footer))", re.I)
COMMENTS = re.compile(rf"(?:comments?|replies|reply|respond|disqus(?:[-_]thread)?|discussion[-_](?:thread|board|list)){KIND}(?:[-_](?:thread|count|author|meta|body|reply|respond|feed|text|content))*|(?:\w+[-_])+comments?", re.I)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
WINDOW, SURGE = 3, 86
#: A marked article's surge is lower, and that of what is outside it higher, by this factor.
PRIOR = 2
#: Closed by a tag that begins the next of them, where no other block is open within.
NEXT = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
BOUNDS = (BLOCKS | {"td", "th"}) - {"address", "div", "p"}
#: Closed likewise by a part of the same table.
CELLS = ("td", "th")
ROWS = (*CELLS, "tr")
PARTS = (*ROWS, "thead", "tbody", "tfoot", "caption")
TABLE = dict.fromkeys(CELLS, CELLS) | {"tr": (*ROWS, "caption")} | dict.fromkeys(("thead", "tbody", "tfoot", "caption"), PARTS)


class Line:
    __slots__ = ("words", "links", "skipped", "inside", "heading")

    def __init__(self, skipped: bool, inside: bool, heading: bool):
        self.words: list[str] = []
        self.links = 0
        self.skipped, self.inside, self.heading = skipped, inside, heading


def lines_of(page: str) -> list[Line]:
    """The page's lines with text, in order."""
    # a frame: tag, skipped, within reader comments, inside the marked article, in a link
    stack: list[tuple[str, bool, bool, bool, bool]] = [("", False, False, False, False)]
    # the places in the stack of the open frames of a tag, and of those that end the search for another
    places: dict[str, list[int]] = {}
    bounds: list[int] = []
    walls: list[int] = []
    lines: list[Line] = []
    line: Line | None = None

    def last(tag: str) -> int:
        return own[-1] if (own := places.get(tag)) else 0

    def close(at: int) -> None:
        while len(stack) > at:
            tag = stack.pop()[0]
            places[tag].pop()
            if tag in BOUNDS:
                bounds.pop()
            if tag in WALLS:
                walls.pop()

    def add(text: str) -> None:
        nonlocal line
        if not text or (text.isspace() and line is None):
            return
        _, skipped, comments, inside, link = stack[-1]
        if line is None:
            line = Line(skipped or comments, inside, stack[-1][0] in HEADINGS)
            lines.append(line)
        text = entities.unescape(text)
        line.words.append(text)
        if link:
            line.links += len(text)

    at, n = 0, len(page)
    while at < n:
        token = TOKEN.search(page, at)
        if token is None:
            add(page[at:])
            break
        add(page[at : token.start()])
        at = token.end()
        if token.group(2) is None:
            continue
        closing, tag, attributes = token.group(1), token.group(2).lower(), token.group(3)
        if tag in RAW and not closing:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in BLOCKS:
            line = None
        elif tag in {"br", "td", "th"}:
            add(" ")
        if closing:
            i = last(tag)
            if i > (last("table") if tag in TABLE else walls[-1] if walls and tag not in BLOCKS else 0):
                close(i)
            continue
        if tag in VOID or attributes.endswith("/"):
            continue
        if tag in NEXT and bounds and stack[bounds[-1]][0] in NEXT[tag]:
            close(bounds[-1])
        elif tag in TABLE and (open_ := [i for x in TABLE[tag] if (i := last(x)) > last("table")]):
            close(min(open_))
        if tag in BLOCKS and tag != "p":
            while stack[-1][0] in {"p", "b", "i", "em", "strong", "span", "u", "font"} and any(f[0] == "p" for f in stack[-8:]):
                close(len(stack) - 1)
        elif tag == "p":
            for i in range(len(stack) - 1, max(0, len(stack) - 8), -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in BLOCKS:
                    break
        _, skipped, comments, inside, link = stack[-1]
        names = [w for m in NAMES.finditer(attributes) for w in (m.group(1) or m.group(2) or m.group(3) or "").split()] if attributes else []
        comments = comments or (tag not in {"html", "body", "main"} and any(COMMENTS.fullmatch(w) for w in names))
        main = tag in KEEPS or (tag != "body" and any(w.lower() in {"main", "articlebody", "article-body"} for w in names))
        if tag in ASIDE:
            skipped = True
        elif main:
            skipped = False
        elif tag not in {"html", "body"} and any(NOT_MAIN.fullmatch(w) for w in names):
            skipped = True
        places.setdefault(tag, []).append(len(stack))
        if tag in BOUNDS:
            bounds.append(len(stack))
        if tag in WALLS:
            walls.append(len(stack))
        stack.append((tag, skipped, comments, inside or (main and not comments), link or tag == "a"))
    return lines


def main_blocks(page: str) -> list[str]:
    """The texts of the lines between surge and dive points."""
    found = [(x, " ".join("".join(x.words).split())) for x in lines_of(page)]
    found = [(x, text) for x, text in found if text]
    marked = any(x.inside and not x.skipped for x, _ in found)
    length = [0 if x.skipped else len(text) if x.inside else max(0, len(text) - x.links) for x, text in found]
    sums = [sum(length[i : i + WINDOW]) for i in range(len(length))]
    keep, on, surged = [], False, False
    for i, total in enumerate(sums):
        own, inside = length[i], found[i][0].inside
        surge = SURGE if not marked else SURGE // PRIOR if inside else SURGE * PRIOR
        if i and inside != found[i - 1][0].inside:
            on = False
        if not on and own and total > surge:
            # the surge is this line's, not only what follows: a long line, a heading, or one of several
            on = own > surge or found[i][0].heading or sum(1 for n in length[i : i + WINDOW] if n > surge // 3) >= 2
            surged = surged or (on and inside)
        elif on and total == 0:
            on = False
        if on and own:
            keep.append(i)
    if marked and not surged:
        keep = sorted({*keep, *(i for i, n in enumerate(length) if n and found[i][0].inside)})
    elif not marked and not keep:
        keep = [i for i, n in enumerate(length) if n]
    return [found[i][1] for i in keep]


def extract(page: str | None) -> str:
    return "\n\n".join(main_blocks(page)) if page else ""


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = pages.select(pages[id_col].alias("page_id"), F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("html"), pages[url_col].alias("url"))

    def make():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            texts = [extract(x) for x in part.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

        return work

    return map_texts(rows, make, f"page_id {id_type(pages, id_col)}, url {id_type(pages, url_col)}, text string, n_chars long")
