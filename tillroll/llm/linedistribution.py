"""Main text of HTML pages by the distribution of line blocks.

1. Markup is stripped: each block element starts a line, and a line holds the text between,
   character references decoded and white space made single; tags without text between them make
   no line. Scripts, styles, comments and the
   like have no text. Lines of parts that say what they are (navigation, page header and footer,
   asides, forms, adverts, notices, reader comments, by element, role, class or id) count
   as empty lines, as do lines made mostly of links outside an article. On headings and inside an
   article, words in a class or id that have other uses (UNSURE) count only for lines made mostly of links.
   The headings in an article's own header are the article's. If more than half of the text stands in
   forms, they are wrapped around the page and are no asides.
2. A line block at i is the lines i to i + WINDOW - 1; its weight is the sum of their text
   lengths. Lines inside an article (an article or main element, the role of one, or an id in
   MAIN_IDS) weigh BONUS more, so that a few short paragraphs of an article surge as a long one does, but a
   single short line among empty ones doesn't. WINDOW empty lines stand
   at the edges of an article, in front of a heading right before it.
3. A surge is a line that has text where the weight of its block is over SURGE (for pages whose blocks are
   all lighter, over half of the heaviest); a dive is where the weight falls to zero. The
   text between surges and dives is the main text, without the empty lines. The start of a
   surge is moved back over the lines just before it that have text.
4. Gaps are bridged: text in the same container (division, section, cell and the like) as main
   text is main text; what stands in no container is if it lies between such main text.

So text that nothing marks as beside the page, next to main text, is taken for main text.

Cases: a NULL or empty page, or one without text, has the empty text; markup cut off at the
end, unclosed and unmatched tags are read as far as they go; pages are read alone, so
repeated rows and ties get equal results; NULL ids and urls are handed through; a table without
rows gives none; further columns are not looked at.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import column, map_rows

WINDOW = 3
SURGE = 86
BONUS = SURGE // 2
# Share of a line's characters that are link text from which it counts as empty.
LINKED = 0.6

# Tags, comments and declarations. A quoted value, which may hold ">", begins after "=" only; elsewhere
# a quote is a character as any other.
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:[!?][^>]*)(?:>|\Z)"
    r"|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_NAME = re.compile(r"[a-z0-9]+")
_SPACE = re.compile(r"\s+")

# Elements whose content is no text of the page.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "xmp", "noembed", "noframes"}
BLOCKS = set(
    "address article aside blockquote body br caption dd details dialog div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre"
    " section select summary table tbody td tfoot th thead tr ul button label legend video audio object"
    " canvas".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
# Elements that are never main text; "header" and "footer" too, outside or inside an article.
ASIDE = set("nav aside footer header form button select menu dialog fieldset label legend object canvas video audio".split())
MAIN = {"article", "main"}
MAIN_IDS = set(
    "content main maincontent main-content main_content article article-body articlebody article-content post"
    " post-content entry-content story story-body page-content bodycontent mw-content-text".split()
)
HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup".split())
# Blocks that are no container of their own.
WITHIN = HEADINGS | set(
    "html body head address blockquote caption dd details dl dt figcaption figure li ol option p pre summary table"
    " tbody tfoot thead tr ul".split()
)
# Words in a class or id that name such parts, and roles that do.
ASIDE_NAMES = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation"
    " menu sidebar aside breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice"
    " popup modal newsletter subscribe signup login comment comments reply replies respond disqus share sharing"
    " social related recommended widget toolbar pagination pager".split()
)
# Those that also name parts of the text itself.
UNSURE = set(
    "promo banner nav navbar navigation menu sidebar aside breadcrumb breadcrumbs footer header masthead notice popup"
    " modal comment reply replies share sharing social related recommended widget toolbar pagination pager".split()
)
# Those that an article or main element may be itself.
ASIDE_ARTICLES = set("ad ads advert sponsored promo comment comments reply replies related".split())
# In front of such a word these say that the part only stands beside one.
BESIDE = {"has", "with", "no", "without", "not"}
ASIDE_ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())


def _marks(tag: str, attributes: str, inside: bool) -> tuple[bool, bool, bool]:
    """Whether an element is an aside, is one where it is mostly links, and is an article."""
    if tag in ASIDE:
        return True, False, False
    main = tag in MAIN
    if not attributes or tag in ("html", "body"):
        return False, False, main
    names = ASIDE_ARTICLES if main else ASIDE_NAMES
    found: set[str] = set()
    for m in _ATTRIBUTE.finditer(attributes):
        value = (m[2] or m[3] or m[4] or "").lower()
        if m[1].lower() == "role":
            if value in ASIDE_ROLES:
                return True, False, False
            main |= value in MAIN
            continue
        if m[1].lower() == "id":
            main |= value in MAIN_IDS and tag in BLOCKS and tag not in HEADINGS
        for words in map(_NAME.findall, value.split()):
            if BESIDE.isdisjoint(words):
                found |= names.intersection(words)
    if tag in MAIN or not found:
        return bool(found), False, main and not found
    if tag in HEADINGS or (inside and found <= UNSURE):
        return False, True, main
    return True, False, False


def lines_of(page: str, forms: bool = True) -> list[tuple[str, int, int]]:
    """(text, weight, container) of the page's lines; the weight is 0 for lines that don't count.

    ``forms`` tells whether forms are asides.
    """
    lines: list[tuple[str, int, int]] = []
    parts: list[str] = []
    # Open elements: name, aside, aside where mostly links, article, container, header of an article.
    stack: list[tuple[str, int, bool, bool, int, bool]] = []
    opened: Counter[str] = Counter()
    aside = unsure = mains = links = linked = boxes = own = 0
    headings, edge, before = 0, -1, False  # the place of the line before the next, if a heading
    at, end = 0, len(page)

    def flush() -> None:
        nonlocal linked, edge, before
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip() if parts else ""
        parts.clear()
        links_only = linked > LINKED * len(text)
        linked = 0
        if not text:
            return
        if aside or (links_only and (unsure or not mains)):
            lines.append(("", 0, 0))
            edge = -1
            return
        if bool(mains) != before and lines:
            place = edge if mains and edge >= 0 else len(lines)
            lines[place:place] = [("", 0, 0)] * WINDOW
        before = bool(mains)
        edge = len(lines) if headings else -1
        box = stack[-1][4] if stack else 0
        lines.append((text, len(text) + BONUS * (mains > 0), box))

    while at < end:
        m = _MARKUP.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            parts.append(page[at:stop])
            if links:
                linked += len(page[at:stop].strip())
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        closing, tag, attributes = m[1], m[2].lower(), m[3]
        if tag in RAW:
            if not closing and not attributes.endswith("/"):
                raw = re.compile(rf"</{re.escape(tag)}\s*(?:>|\Z)", re.IGNORECASE).search(page, at)
                at = raw.end() if raw else end
            continue
        if tag == "a":
            links = 0 if closing else 1
            continue
        named = weak = main = False
        if not closing and tag not in VOID and (forms or tag != "form"):
            named, weak, main = _marks(tag, attributes, mains > 0)
        if tag not in BLOCKS and not named and not (closing and opened[tag]):
            continue
        if tag in BLOCKS or named:
            flush()
        if tag in VOID or tag == "p":
            continue
        if not closing:
            if tag in WITHIN or tag not in BLOCKS:
                box = stack[-1][4] if stack else 0
            else:
                boxes += 1
                box = boxes
            # 1 for an aside, -1 for a heading of an article's own header, which undoes it.
            mark = -1 if tag in HEADINGS and own == aside == 1 and not named else int(named)
            own_header = tag == "header" and mains > 0 and not aside
            own += own_header
            stack.append((tag, mark, weak, main, box, own_header))
            opened[tag] += 1
            aside += mark
            unsure += weak
            mains += main
            headings += tag in HEADINGS
            continue
        if opened[tag]:
            if tag not in BLOCKS:
                flush()
            while True:
                top, was, less, article, _, own_header = stack.pop()
                opened[top] -= 1
                own -= own_header
                aside -= was
                unsure -= less
                mains -= article
                headings -= top in HEADINGS
                if top == tag:
                    break
    flush()
    return lines


def main_lines(weights: list[int], window: int = WINDOW, surge: int = SURGE) -> list[bool]:
    """Which lines lie between a surge and its dive."""
    n = len(weights)
    block = [sum(weights[i : i + window]) for i in range(n)]
    least = min(surge, max(block, default=0) // 2)
    out, inside = [False] * n, False
    for i in range(n):
        if not inside and weights[i] and block[i] > least:
            inside = True
            k = i - 1
            while k >= 0 and weights[k] and not out[k]:
                out[k] = True
                k -= 1
        elif inside and not block[i]:
            inside = False
        out[i] = out[i] or inside
    return out


def bridged(lines: list[tuple[str, int, int]], chosen: list[bool]) -> list[bool]:
    """``chosen`` with the text in containers of chosen lines, and without a container between them."""
    of_main = {box for (_, weight, box), ok in zip(lines, chosen) if ok and weight and box}
    free = [i for i, (_, weight, box) in enumerate(lines) if chosen[i] and weight and not box]
    return [
        ok or (box in of_main if box else bool(free) and free[0] < i < free[-1])
        for i, ((_, _, box), ok) in enumerate(zip(lines, chosen))
    ]


def page_lines(page: str) -> list[tuple[str, int, int]]:
    """``lines_of``, with forms as asides unless most of the text is in them."""
    lines = lines_of(page)
    if "<form" in page.lower():
        within = lines_of(page, forms=False)
        size = lambda found: sum(len(text) for text, weight, _ in found if weight)
        if 2 * size(lines) < size(within):
            return within
    return lines


def main_text(page: str | None) -> str:
    lines = page_lines(page or "")
    chosen = bridged(lines, main_lines([weight for _, weight, _ in lines]))
    return " ".join(text for (text, weight, _), ok in zip(lines, chosen) if ok and weight)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``."""

    def work(batch: pa.RecordBatch) -> list:
        texts = [main_text(p) for p in column(batch, "html")]
        same = [batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url")]
        return [*same, texts]

    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    found = map_rows(pages.select("page_id", "url", "html"), f"{kinds}, text string", work)
    return found.withColumn("n_chars", F.length("text").cast("bigint"))
