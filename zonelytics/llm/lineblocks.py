"""HTML extraction by line-block distribution."""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonelytics.llm.common import Out, rows

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*)>""", re.DOTALL)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.IGNORECASE)
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template svg math iframe object canvas title textarea".split())
_OUT = frozenset("nav footer aside form menu dialog select button head audio video map datalist".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_ENDS_P = _BLOCK - {"html", "body", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: words of class, id and role that name parts beside the article
_BESIDE = frozenset(
    "ad ads adv advert advertisement adverts advertising adbox adslot banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright discussion disqus "
    "footer form gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted recommended "
    "related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags teaser toolbar topbar widget widgets "
    "alert complementary contentinfo header".split()
)


#: what may follow such a word in the name of its container
_PARTS = frozenset(
    "area bar block body bottom box button buttons col container content count group head heading icon icons inner item items label left link links list listing main module "
    "outer panel placeholder posts region right row section slot stories strip target text thread title tools top unit wrap wrapper zone".split()
)
#: words before it that make a name say something of another element
_ABOUT = frozenset("has is no not non with without hide hides show shows open opens above below after before".split())
_STORY = frozenset("article content entry post story".split())


def named_beside(word: str) -> bool:
    """Whether one name out of class, id or role is that of a part beside the article.

    The whole name, its last word ("site-footer"), or its first words before words for containers ("share-buttons") say so;
    not in "has-sidebar", "no-comments", "share-price", nor "entry-header", which holds the title.
    """
    if word.lower() in _BESIDE:
        return True
    parts = [x.lower() for x in _CAMEL.findall(word)]
    if not parts or parts[0] in _ABOUT or parts[-1] == "header" and parts[0] in _STORY:
        return False
    while len(parts) > 1 and (parts[-1] in _PARTS or parts[-1].isdigit()):
        parts.pop()
    return parts[-1] in _BESIDE


def beside(attributes: str) -> bool:
    """Whether class, id or role names a part beside the article."""
    return bool(attributes) and any(named_beside(word) for _, a, b, c in _NAMES.findall(attributes) for word in (a or b or c).split())


def lines(page: str) -> list[tuple[str, int, bool]]:
    """The page's blocks in order: (text, characters inside links, inside an article or main element).

    Markup is gone; blocks of parts beside the article have an empty text. A block ends where a
    block-level element begins or ends, not at ``br``. Unclosed elements end with their parent.
    """
    out: list[tuple[str, int, bool]] = []
    stack: list[tuple[str, int]] = []  # open elements; 1: beside the article by its kind, 2: by its name
    text: list[str] = []
    linked, outside, links, inside, at = 0, 0, 0, 0, 0

    def flush() -> None:
        nonlocal linked
        got = " ".join(html.unescape("".join(text)).split())
        if got or outside:
            out.append((got, linked, inside > 0))
        text.clear()
        linked = 0

    def close(upto: int) -> None:
        nonlocal outside, links, inside
        while len(stack) > upto:
            name, off = stack.pop()
            outside -= off > 0
            links -= name == "a"
            inside -= name in ("article", "main")

    size = len(page)
    while at < size:
        m = _TAG.search(page, at)
        chunk = page[at : m.start() if m else size]
        if chunk and not outside:
            text.append(chunk)
            linked += len(chunk) if links else 0
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), m[1] == "/"
        block = name in _BLOCK
        if block:
            flush()
        elif name == "br":
            text.append(" ")
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    close(i)
                    break
            continue
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(page, at)
            if not m[3].rstrip().endswith("/"):
                at = end.end() if end else size
            continue
        if name in _ENDS_P or name in ("li", "dt", "dd", "tr", "td", "th"):
            ends = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}.get(name, ())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p" and name in _ENDS_P or stack[i][0] in ends:
                    close(i)
                    break
                if stack[i][0] in _BLOCK:
                    break
        if name in _VOID or m[3].rstrip().endswith("/") and not block:
            continue
        if name in ("article", "main"):  # what holds the article is not beside it, whatever its name
            outside -= sum(off == 2 for _, off in stack)
            stack = [(n, 0 if off == 2 else off) for n, off in stack]
        off = 1 if name in _OUT or name == "header" and not inside else 0
        if not off and name not in ("html", "body", "article", "main"):
            off = 1 if m[3] and _HIDDEN.search(m[3]) else 2 * beside(m[3])
        stack.append((name, off))
        outside += off > 0
        links += name == "a"
        inside += name in ("article", "main")
    flush()
    return out


def between(lengths: np.ndarray, window: int, most: int) -> np.ndarray:
    """Which lines lie between a surge and a dive of the windowed text length.

    The value of a line is the text of the ``window`` lines from it on. It surges where it passes the
    threshold, min(``most``, a quarter of the page's highest value), and dives where it falls to 0.
    """
    n = len(lengths)
    total = np.append(0, np.cumsum(lengths))
    value = total[np.minimum(np.arange(n) + window, n)] - total[:n]
    keep = np.zeros(n, bool)
    if not n or not value.max():
        return keep
    threshold, at = min(most, value.max() / 4), 0
    while at < n:
        if value[at] <= threshold and value[at] < value.max():
            at += 1
            continue
        end = at
        while end < n and value[end] > 0:
            end += 1
        # lines before the surge that lead up to it without a gap belong to it
        while at and lengths[at - 1] > 0 and not keep[at - 1]:
            at -= 1
        keep[at:end] = True
        at = end
    return keep & (lengths > 0)


def extract(page: str | None, window: int = 3, most: int = 80) -> str:
    found = lines(page) if page else []
    if any(t and a for t, _, a in found):  # text outside the marked article counts nothing, and parts beside it inside leave no gap
        found = [(t if a else "", k, a) for t, k, a in found if t or not a]
    counted = np.array([0 if 2 * k > len(t) and not a else len(t) for t, k, a in found], np.int64)
    keep = between(counted, window, most)
    return "\n\n".join(t for (t, _, _), k in zip(found, keep, strict=True) if k)


def main_text(pages: DataFrame, window: int = 3, most: int = 80) -> DataFrame:
    """The main text of each row of ``pages(page_id, url, html)``: page_id, url, text, n_chars (code points).

    Markup is stripped to one line per block; blocks of menus, headers, footers, sidebars, notices,
    adverts, forms and comments, blocks that are mostly links, and, where the page marks an article,
    blocks outside it count as empty lines; inside a marked article such parts count as absent. An element named like one of them that
    holds the article is none of them. Text lengths are summed over ``window`` lines, and the
    lines between a surge of that sum and its dive to 0 are kept, joined by two line feeds; inside a
    block white space is one space. Nothing is cut.

    NULL or empty html, or a page without text: an empty text. NULL ids and repeated rows are kept.
    Extra columns are dropped; an empty table gives no rows.
    """

    def apply(batches):
        out = Out(pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())]), 500)
        for page_id, url, page in rows(batches, "page_id", "url", "html"):
            text = extract(page, window, most)
            out.add(page_id, url, text, len(text))
            if out.full():
                yield out.batch()
        yield out.batch()

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(apply, "page_id long, url string, text string, n_chars long")
