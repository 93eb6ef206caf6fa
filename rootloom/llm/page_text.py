"""Main text of web pages by two passes of rules over their blocks.

A page is cut into blocks: text between tags that start or end a block. Scripts, styles, comments and form controls give no
text. Blocks inside an element that says what it is (menu, header, footer, sidebar, notice, advert, form, reader comments: by
its tag, role, class or id) go at once. All others are judged by what they hold:

* First pass: a block is *out* if much of it is links, *in* if it is long and holds enough stop words, *out* if it is long
  with hardly any, and else *open*: too short to tell, or near the bounds.
* Second pass: an open block takes the label of its nearest decided neighbours to the left and to the right. Where they
  differ, or nothing on the page is decided, a short one goes out and one near the bounds stays (in a marked article, both
  stay); a heading goes with the next block that is none.

Where the page marks its article (``article``, ``main``, their roles, ``articleBody``), blocks outside of it are out, and its
ends count as decided neighbours that are in: so a one-word paragraph of an article stays. Stop words then only tell what is
surely in: an article in a language without a list has none, and stays by its neighbours and the ends.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bounds of the published rules: characters of a short and of a long block, shares of stop words and of characters in links.
SHORT, LONG = 70, 200
STOPS_LOW, STOPS_HIGH = 0.30, 0.32
MOST_LINKS, MOST_LINKS_IN_ARTICLE = 0.2, 0.5
#: A page with a smaller share of stop words than this is in a language without a list: its blocks are judged by length and links.
LEAST_STOPS = 0.02
#: Frequent words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """a about after all also an and any are as at be been but by can could do for from had has have he her his how i if in into is it its
    more no not of on one only or other our out she so some that the their them there they this to up was we were what when which who will
    with would you your aber als am auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer er es für hat
    ich ihr im ist kann mit nach nicht noch nur oder sein sich sie sind über um und uns vom von vor war was wenn werden wie wir wird zu
    zum zur au aux avec ce ces cette dans de elle en est et été il ils je la le les leur lui mais même ne nous ont ou où par pas pour plus
    qu que qui sa sans se ses son sont sur tout un une vous como con del el ella entre era esta este ha hay las lo los más muy o para pero
    por porque se ser si sin sobre su sus también todo una unas unos y ya""".split()
)
#: Tags.
BLOCK_TAGS = frozenset(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
    head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead
    title tr ul""".split()
)
RAW_TAGS = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math canvas object audio video".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED_TAGS = {"nav": "menu", "menu": "menu", "header": "header", "footer": "footer", "aside": "sidebar", "form": "form", "fieldset": "form", "dialog": "notice", "search": "form", "head": "head", "select": "control", "button": "control", "label": "control", "datalist": "control"}
DROPPED_ROLES = {"navigation": "menu", "menu": "menu", "menubar": "menu", "banner": "header", "contentinfo": "footer", "complementary": "sidebar", "search": "form", "form": "form", "alert": "notice", "alertdialog": "notice", "dialog": "notice", "toolbar": "menu"}
#: Words of a class or an id, parted at marks and humps, that say what a block is.
DROPPED_WORDS = {
    word: kind
    for kind, words in {
        "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar topbar skip tags tagcloud toc",
        "header": "header masthead",
        "footer": "footer copyright colophon legal",
        "sidebar": "sidebar rail widget widgets related recommended recommendations trending popular teaser teasers",
        "notice": "cookie cookies consent gdpr notice notices alert popup modal overlay disclaimer paywall",
        "advert": "ad ads advert adverts advertisement advertisements advertising banner sponsor sponsored sponsors promo promos promotion outbrain taboola",
        "form": "form login signin signup register subscribe subscription newsletter search share sharing social follow",
        "comments": "comment comments commentlist disqus reply replies respond reader",
    }.items()
    for word in words.split()
}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: What an implied end doesn't reach beyond.
SCOPES = frozenset(("ul", "ol", "dl", "table", "article", "main", "body", "html", "div", "section"))

_TAG = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)|[!?/])")
_VALUE_OR_END = re.compile(r"=\s*([\"'])|>")
_NAMED = re.compile(r"(?<![^\s\"'/])(class|id|role|itemprop|aria-hidden|hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/>\"']|$)", re.I)
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|[^A-Za-z0-9]+")
_WORD = re.compile(r"[^\W\d_]+")


class _Element:
    __slots__ = ("dropped", "kind", "links", "name", "tops")

    def __init__(self, name: str, dropped: str, tops: bool, links: bool):
        self.name, self.dropped, self.tops, self.links = name, dropped, tops, links


def _tag_end(text: str, at: int, unclosed: set[str]) -> int:
    """Behind the ``>`` of the tag whose name ends at ``at``; quoted values may hold one. A quote that is never closed is none."""
    while m := _VALUE_OR_END.search(text, at):
        if m[0] == ">":
            return m.end()
        at = m.end()
        if m[1] not in unclosed:
            end = text.find(m[1], at)
            if end < 0:
                unclosed.add(m[1])
            else:
                at = end + 1
    return len(text)


def _names(attributes: dict[str, str]) -> list[str]:
    return f"{attributes.get('class', '')} {attributes.get('id', '')}".split()


def _said_by(name: str, attributes: dict[str, str], tops: bool) -> str:
    """What an element says it is, if that is none of the article's: '' if it says nothing of the kind."""
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I):
        return "hidden"
    if name in DROPPED_TAGS:
        return DROPPED_TAGS[name]
    if (role := attributes.get("role", "").lower()) in DROPPED_ROLES:
        return DROPPED_ROLES[role]
    if name in ("html", "body"):
        return ""
    for each in _names(attributes):
        # What marks an article is told by whole names only ("comments-open" says nothing of the kind), elsewhere by each word.
        words = [each.lower()] if tops else [w.lower() for w in _HUMP.split(each) if w]
        if words and words[0] in ("has", "with", "no", "without"):
            continue
        for word in words:
            if word in DROPPED_WORDS:
                return DROPPED_WORDS[word]
    return ""


def blocks(page: str) -> list[tuple[str, str, bool, int, bool]]:
    """(text, what it was dropped for or '', inside a marked article, characters in links, a heading) of each block with text."""
    found: list[tuple[str, str, bool, int, bool]] = []
    stack: list[_Element] = []
    standing: Counter[str] = Counter()  # names on the stack
    parts: list[str] = []
    in_links = 0
    unclosed: set[str] = set()
    no_end: set[str] = set()
    dropped, tops, links, heading = "", False, False, False

    def flush():
        nonlocal in_links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                found.append((text, dropped, tops, min(in_links, len(text)), heading))
            parts.clear()
        in_links = 0

    def look():
        nonlocal dropped, tops, links, heading
        top = stack[-1] if stack else None
        dropped, tops, links = (top.dropped, top.tops, top.links) if top else ("", False, False)
        heading = any(e.name in HEADINGS for e in stack[-4:])
        # The heading of an article may stand in a header of its own.
        if dropped == "header" and tops and heading:
            dropped = ""

    def add(raw: str):
        nonlocal in_links
        parts.append(raw)
        if links:
            in_links += len(html.unescape(raw).strip())

    def close_to(name: str, stop: frozenset[str] = frozenset()) -> None:
        for k in range(len(stack) - 1, -1, -1) if standing[name] else ():
            if stack[k].name == name:
                standing.subtract(e.name for e in stack[k:])
                del stack[k:]
                return
            if stack[k].name in stop:
                return

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        if m[1]:  # a comment
            end = page.find("-->", m.start() + 4) if "-->" not in no_end else -1
            if end < 0:
                no_end.add("-->")
            at = n if end < 0 else end + 3
            continue
        if not m[3]:  # a declaration, or an end without a name
            end = page.find(">", m.end())
            at = n if end < 0 else end + 1
            continue
        name = m[3].lower()
        bare = page.startswith(">", m.end())
        end = m.end() + 1 if bare else _tag_end(page, m.end(), unclosed)
        if m[2]:
            if name in BLOCK_TAGS or standing[name]:
                if name in BLOCK_TAGS:
                    flush()
                close_to(name, frozenset(("body",)) if name != "html" else frozenset())
                look()
            at = end
            continue
        if name in BLOCK_TAGS:
            flush()
        if name in ("br", "hr"):
            parts.append(" ")
        if name in RAW_TAGS:
            at = end
            if page[end - 2 : end] != "/>":
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, end) if name not in no_end else None
                if close is None:
                    no_end.add(name)
                    at = n if name in ("script", "style", "textarea") else end
                else:
                    at = _tag_end(page, close.end(), unclosed)
            continue
        at = end
        if name in VOID_TAGS:
            continue
        if name in BLOCK_TAGS:
            close_to("p", SCOPES)
            for other in CLOSED_BY.get(name, ()):
                close_to(other, SCOPES)
        elif name == "a":
            close_to("a", BLOCK_TAGS)
        elif bare and name not in DROPPED_TAGS:
            continue  # inline, and says nothing
        attributes = {} if bare else {a[0].lower(): a[1] or a[2] or a[3] for a in _NAMED.findall(page[m.end() : end - 1])}
        marks = name in ("article", "main") or attributes.get("role", "").lower() in ("main", "article") or "articlebody" in attributes.get("itemprop", "").lower()
        above = stack[-1] if stack else _Element("", "", False, False)
        said = _said_by(name, attributes, marks) if attributes else DROPPED_TAGS.get(name, "")
        inherited = above.dropped
        # A menu or form around a whole article is one that wasn't closed, or that wraps the page.
        if marks and inherited in ("menu", "form", "header"):
            inherited = ""
        if name in BLOCK_TAGS or name == "a" or said:
            standing[name] += 1
            stack.append(_Element(name, inherited or said, above.tops or (marks and not (inherited or said)), above.links or name == "a"))
            if said and name not in BLOCK_TAGS:
                flush()
            look()
    flush()
    return found


def stop_share(text: str) -> float:
    words = _WORD.findall(text.lower())
    return sum(map(STOP_WORDS.__contains__, words)) / max(len(words), 1)


def main_text(page: str) -> str:
    """The page's main text: '' if it has none."""
    rows = [b for b in blocks(page) if not b[1]]
    marked = any(b[2] for b in rows)
    if marked:
        rows = [b for b in rows if b[2]]
    most = MOST_LINKS_IN_ARTICLE if marked else MOST_LINKS
    by_links = [in_links > most * len(text) for text, _, _, in_links, _ in rows]
    if marked and not any(by_links):  # nothing is out, so no open block has a neighbour that is
        return " ".join(b[0] for b in rows)
    shares, sizes = [stop_share(b[0]) for b in rows], [len(b[0]) for b in rows]
    has_list = sum(s * n for s, n in zip(shares, sizes)) >= LEAST_STOPS * sum(sizes)

    def first_pass(k: int) -> bool | None:
        if by_links[k]:
            return False
        if rows[k][4] or sizes[k] < SHORT:
            return None
        if has_list and shares[k] < STOPS_LOW and not marked:
            return False
        return True if sizes[k] >= LONG and (shares[k] >= STOPS_HIGH or not has_list) else None

    labels = [first_pass(k) for k in range(len(rows))]  # True: in, False: out, None: open
    nothing = not any(x is not None for x in labels)
    # Second pass: the nearest decided label on either side, by one sweep each way; beyond the ends lies the article, or the page.
    left, last = [], marked
    for label in labels:
        left.append(last)
        last = last if label is None else label
    kept, right, next_one = [], marked, marked
    for k in range(len(rows) - 1, -1, -1):
        label = labels[k]
        if label is None:
            if rows[k][4]:
                label = next_one
            elif left[k] == right and not nothing:
                label = right
            else:
                label = marked or sizes[k] >= SHORT
        else:
            right = label
        if not rows[k][4]:
            next_one = label
        if label:
            kept.append(rows[k][0])
    return " ".join(reversed(kept))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars long) for each row: the main text of its whole html.

    A null or empty page has the empty text; null ids and urls are handed through; repeated rows each give a row; an empty table
    gives no rows; other columns aren't read. A page of any length is read whole, in time and memory linear in its length.
    """

    def make(batches):
        for batch in batches:
            texts = [main_text(p) if p else "" for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names)

    rows = pages.select(F.col(id_col).alias("_i"), F.col(url_col).alias("_u"), F.col(html_col).cast("string").alias("_h"))
    names = [id_col, url_col, "text", "n_chars"]
    types = [rows.schema["_i"].dataType, rows.schema["_u"].dataType, T.StringType(), T.LongType()]
    return rows.mapInArrow(make, T.StructType([T.StructField(n, t) for n, t in zip(names, types)]))
