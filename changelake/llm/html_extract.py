"""Main text of web pages by line-block distribution.

1. Markup is stripped into lines, one per block-level element.  Elements that
   hold no article text (scripts, menus, page headers and footers, side bars,
   notices, adverts, forms, reader comments) leave one empty line.  A class, id or
   role drops an element by its name alone only if all parts of the name say so;
   where just a part does, the text decides: the element goes if it is mostly links.
2. A line weighs the characters of its text; lines that are all link weigh nothing
   outside of marked articles, and where the page marks ``article`` or ``main``
   elements, lines outside of them weigh nothing.
3. Weights are summed over windows of ``WINDOW`` lines.  A surge point is where
   the sum rises above ``SURGE`` characters, a dive point where a window falls to
   zero, or where a marked article ends.
4. Text between dive points is kept if there is a surge point in it, with the short
   lines before and after it; so of several marked articles, teasers without a
   surge go.  A page without any surge is short, and kept as it is.

Character references are decoded, white space inside a block becomes one space,
and blocks are joined by a newline.  Nothing else is cut: a region is kept whole.

Edge cases: null or empty html, or a page without text, gives an empty text;
unclosed elements end with the page, but an ``article`` or ``main`` ends a dropped
element that is never closed, or a form around it, and a ``main`` one that was
dropped for its names; what is not of a head's elements ends an open head; an
article named as a comment or the like is dropped, and articles in dropped parts
don't mark a page; repeated rows, ties and further columns change nothing; an
empty table stays empty.  One pass, no shuffle.
"""

from __future__ import annotations

import html as references
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens

WINDOW, SURGE = 3, 40

# HTML element names by role.
RAW = {"script", "style", "textarea", "title", "xmp", "noframes", "iframe", "noembed"}
DROPPED = {"nav", "header", "footer", "aside", "form", "head", "noscript", "template", "button", "select", "svg", "canvas", "object", "menu", "dialog", "audio", "video"}
BLOCKS = {"address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "html", "legend", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
HEADS = {"base", "bgsound", "basefont", "head", "html", "link", "meta", "noframes", "noscript", "script", "style", "template", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
# Words of names that tell what a page has or lacks, not what an element is.
TELLS = {"has", "no", "not", "with", "without"}
# Words of class, id and role attributes that mark other parts of a page.
MARKS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "complementary", "contentinfo", "cookie", "cookies", "consent", "disqus", "footer", "gdpr", "header", "masthead", "menu", "menubar", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notification", "pagination", "popup", "promo", "promoted", "promotion", "related", "search", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}

# Words of names that say where or how big an element is, or that it has more of a kind.
PLAIN = {"area", "articles", "bar", "block", "body", "bottom", "box", "button", "buttons", "card", "cards", "center", "child", "col", "column", "container", "content", "depth", "desktop", "even", "first", "form", "global", "group", "icon", "icons", "inner", "item", "items", "large", "last", "layout", "left", "level", "line", "link", "links", "list", "local", "main", "media", "mobile", "module", "odd", "outer", "page", "panel", "parent", "post", "posts", "primary", "respond", "right", "row", "secondary", "section", "sections", "signup", "site", "small", "space", "sticky", "stories", "text", "thread", "title", "top", "unit", "units", "wrap", "wrapper", "zone"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>(?:[^>\"']|\"[^\"]*\"|'[^']*')*))>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def _named(value: str, lead: bool) -> str:
    """What the names in ``value`` say: "named" if all parts of one are marks or plain, "perhaps" if one holds a mark, or nothing.

    With ``lead``, only names that begin with a mark count.  Names like has-sidebar don't.
    """
    out = ""
    for name in value.split():
        parts = [p.lower() for p in _PART.findall(name)]
        for k, p in enumerate(parts[:1] if lead else parts):
            if p in MARKS and not TELLS.intersection(parts[:k]):
                if all(q in MARKS or q in PLAIN or q.isdigit() for q in parts):
                    return "named"
                out = "perhaps"
    return out


def _boilerplate(name: str, attributes: str) -> str:
    """Why an element is dropped: its element name, "hidden" or "named"; "perhaps" if its text decides; empty if it isn't."""
    if name in DROPPED:
        return name
    if not attributes or name in ("html", "body", "main"):
        return ""
    if name != "article" and _HIDDEN.search(attributes):
        return "hidden"
    out = ""
    for m in _ATTRIBUTE.finditer(attributes):
        says = _named(m[2] or m[3] or m[4] or "", name == "article")
        if says == "named":
            return says
        out = out or says
    return out


def _tags(page: str):
    """Start of the text before a tag, the tag's start and end, name, whether it closes, attributes; nameless for what has no part in the structure."""
    at = 0
    while m := _TOKEN.search(page, at):
        begin, at = at, m.end()
        name, closing = (m[2] or m[5] or "").lower(), bool(m[1] or m[4])
        if name in RAW and not closing:
            close = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
            at = close.start() if close else len(page)
            name = ""
        yield begin, m.start(), at, name, closing, m[3] or m[6] or ""
    yield at, len(page), len(page), "", False, ""


def _closed(page: str) -> set[int]:
    """Where the tags start that are closed later."""
    open_at: dict[str, list[int]] = {}
    out = set()
    for _, start, _, name, closing, attributes in _tags(page):
        if not name or name in VOID:
            continue
        if not closing and not attributes.endswith("/"):
            open_at.setdefault(name, []).append(start)
        elif closing and open_at.get(name):
            out.add(open_at[name].pop())
    return out


def lines(page: str) -> tuple[list[str], list[int], list[int]]:
    """Lines of text, the weight of each, and which marked article it is in (from 1; all 0 on a page without)."""
    out: list[str] = []
    weights: list[int] = []
    inner: list[int] = []
    articles = 0
    doubtful: list[list] = []  # elements whose text decides: name, open ones of the name, first line, characters and linked ones before
    every = links = 0
    text: list[str] = []
    size = linked = depth = 0  # depth: of article and main elements that are open
    marked = False  # whether there is such an element at all
    link = False
    dropped, level = "", 0  # the element that is being dropped, and how many of its name are open

    def end(blank: bool = False) -> None:
        nonlocal size, linked
        line = " ".join(references.unescape("".join(text)).split())
        text.clear()
        if line or blank:
            out.append(line)
            weights.append(len(line) if size > linked else -len(line))
            inner.append(articles if depth else 0)
        size = linked = 0

    def decide(first: int, chars: int, of_links: int) -> None:
        """Drop the lines from ``first`` on if they are mostly links."""
        if every > chars and 2 * (links - of_links) >= every - chars:
            out[first:], weights[first:], inner[first:] = [""], [0], [0]

    def add(piece: str) -> None:
        nonlocal size, linked, every, links
        if dropped or not piece:
            return
        text.append(piece)
        n = len(piece) - piece.count(" ") if not piece.isspace() else 0
        size += n
        linked += n * link
        every += n
        links += n * link

    closed, since, why = None, 0, ""  # tags that are closed; where the dropped element starts, and why it is dropped
    for begin, start, _, name, closing, attributes in _tags(page):
        add(page[begin:start])
        if not name:
            continue
        if dropped:
            if name == dropped and name not in VOID:
                level += -1 if closing else (not attributes.endswith("/"))
                if level == 0:
                    dropped = ""
                continue
            if closing:
                continue
            if dropped == "head":
                if name in HEADS:
                    continue
            elif name not in ("article", "main"):
                continue
            elif why != "form" and not (why == "named" and name == "main"):
                closed = _closed(page) if closed is None else closed
                if since in closed:
                    continue
            dropped = ""
        for d in doubtful:
            if name == d[0]:
                d[1] += -1 if closing else (not attributes.endswith("/"))
        if doubtful and doubtful[-1][1] == 0:
            end()
            while doubtful and doubtful[-1][1] == 0:
                decide(*doubtful.pop()[2:])
        if not closing and name not in VOID and (reason := _boilerplate(name, attributes)):
            end()
            if reason == "perhaps":
                if not attributes.endswith("/"):
                    doubtful.append([name, 1, len(out), every, links])
            else:
                end(blank=True)
                if not attributes.endswith("/"):
                    dropped, level, since, why = name, 1, start, reason
                continue
        if name == "a":
            link = not closing
        elif name == "br":
            add(" ")
        elif name in BLOCKS:
            end()
            if name in ("article", "main"):
                if not closing:
                    articles += depth == 0
                    marked = True
                depth = max(0, depth - 1) if closing else depth + 1
    end()
    if marked:
        weights = [abs(w) if i else 0 for w, i in zip(weights, inner, strict=True)]
    else:
        weights = [max(0, w) for w in weights]
    return out, weights, inner


def extract(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """Text between surge and dive points of a page's line-block distribution."""
    if not page:
        return ""
    found, weights, inner = lines(page)
    n = len(found)
    # Regions between dive points: a window of empty lines, or the end of a marked article.
    regions: list[list[int]] = []
    empty = window
    for i, w in enumerate(weights):
        if not w:
            empty += 1
            continue
        if (empty >= window if not inner[i] else not regions or inner[regions[-1][-1]] != inner[i]) or not regions:
            regions.append([])
        regions[-1].append(i)
        empty = 0
    kept = []
    for region in regions:
        at, last = 0, 0
        for k, i in enumerate(region):  # the window that begins at each line
            last = max(last, k)
            while last < len(region) and region[last] < min(n, i + window):
                at += weights[region[last]]
                last += 1
            if at > surge:
                kept.append(region)
                break
            at -= weights[i]
    return "\n".join(found[i] for region in kept or regions for i in region)


def extract_pages(pages: DataFrame, column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` with the main text and its length in code points."""
    chosen = pages.select(*keep, F.col(column).alias("__html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]) + ", text string, n_chars long"

    def run(batches):
        for b in batches:
            text = [extract(p) for p in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], [*b.schema.names[:-1], "text", "n_chars"])

    return chosen.mapInArrow(run, schema)


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens.small_batches(spark)
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op2_html_extract": op2_html_extract}
ORACLES: dict[str, str] = {}
