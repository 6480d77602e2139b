"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block of text (the text between two block-level tags), with empty lines
where sections begin and end. Scripts, styles, forms and whatever a tag name, role, class or id marks as menu, header,
footer, sidebar, notice, advert or reader comments are cut out with all they hold; attributes are read by their whole
names, and a class or id marks a cut only if nothing else stands in the word (site-footer does, no-sidebar doesn't).
A class or id does not cut an element that holds over ``WHOLE`` of the page's text in at least ``2 * SPAN`` blocks, for that
is a wrapper (reader comments are always cut).

Over the lines a window of ``SPAN`` lines slides and sums text lengths; lines that are mostly links count as empty. Text
begins at a surge point, a line of ``DIVE`` or more (of any length, if there is none) with a window sum of ``SURGE`` or more (or the
largest, if that is less), and ends at a dive point, a window sum under ``DIVE``. The *holder* of the text is the innermost body, division, section, article or
main part with at least ``SHARE`` of what lies between surge and dive points. The lines from the first surge point in the
holder to the last dive point in it are kept, whatever stands between. The two ends are then moved outwards over short
lines of the same kind: over lines in the holder, or in the parts around it below the body, up to a line that is mostly
link or that stands in a part of its own beside the text; up to the page's first headline, if it stands before the text.
Where the holder is an article or main part, it is kept whole. Text outside the holder is left out.

Blocks are kept whole: character references are decoded, white space becomes one space, blocks are joined by an empty
line. Each page is read once from left to right.

Defined results: null or empty html, or html without text, gives an empty text; repeated pages each get their row; of
parts with equal shares the first is the holder. An empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, table

SPAN, SURGE, DIVE, LINKED, SHARE, WHOLE = 3, 80, 25, 0.5, 0.75, 0.6
SCHEMA = "page_id bigint, url string, text string, n_blocks int"

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
SECTIONS = frozenset("article aside body div footer form header main nav section table ul ol dl".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text; it ends at their own end tag only.
RAW = frozenset("script style textarea title noscript template iframe object svg math canvas select audio video xmp".split())
CUT_TAGS = frozenset("nav footer aside form button dialog menu fieldset".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
CUT_NAMES = frozenset(
    "ad ads adsense advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner banners nav navbar navigation menu menus "
    "breadcrumb breadcrumbs masthead footer foot sidebar sidebars sidenav aside widget widgets comment comments commentlist disqus respond reply replies cookie "
    "cookies consent notice notices gdpr newsletter subscribe subscription signup login popup modal overlay social share sharing related recommended recommendations "
    "pagination pager toolbar topbar skip skiplink search legal copyright imprint disclaimer".split()
)
#: Cut whatever they hold.
ALWAYS = frozenset("comment comments commentlist disqus respond reply replies".split())
#: For the elements that hold the article.
CUT_ARTICLE = frozenset("comment comments reply replies ad ads advert advertisement promo related recommended sponsored teaser".split())
#: Parts that a name may hold besides one that marks a cut; with any other part, as in no-sidebar, the element stays.
AROUND = frozenset("site page main global top bottom primary secondary list box area wrap wrapper container inner outer block section bar link links post posts article articles item items slot slots unit units zone space holder placeholder panel group thread form button buttons icon icons title".split())
HEADER_NAMES = frozenset(("header", "head", "top", "site-header", "page-header"))

_open = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_stop = re.compile(r"[<>\"']")
_attribute = re.compile(r"([^\s\"'<>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)(?:\"|$)|'([^']*+)(?:'|$)|([^\s\"'>]++)))?")
_parts = re.compile(r"[a-z]+|[0-9]+")
_camel = re.compile(r"(?<=[a-z])(?=[A-Z])")


#: Elements that can hold the text of a page, and kinds of lines that continue it.
HOLDERS = frozenset("html body div section article main td center".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figcaption caption td th summary".split())

KEPT, NAMED, CUT = range(3)


def _cut_kind(name: str, attributes: str, in_main: bool) -> int:
    """CUT for what always goes; NAMED for what a class or id marks, which stays if it holds most of the page."""
    if name in CUT_TAGS or name == "header" and not in_main:
        return CUT
    if not attributes or name in ("html", "body"):
        return KEPT
    given: dict[str, str] = {}
    for found in _attribute.finditer(attributes):
        given.setdefault(found[1].lower(), found[2] or found[3] or found[4] or "")
    if "hidden" in given or given.get("role", "").strip().lower() in CUT_ROLES:
        return CUT
    listed = CUT_ARTICLE if name in ("article", "main") else CUT_NAMES
    for value in (given.get("class"), given.get("id")):
        if not value:
            continue
        tokens = [set(_parts.findall(_camel.sub(" ", x).lower())) for x in value.split()]
        marks = [x & listed for x in tokens if all(part in listed or part in AROUND or part.isdigit() for part in x)]
        if any(marks):
            return CUT if any(x & ALWAYS for x in marks) else NAMED
        names = set().union(*tokens)
        if not in_main and name not in ("article", "main") and names and names <= HEADER_NAMES | {"site", "page", "header"} and "header" in names:
            return NAMED
    return KEPT


def _tag_end(page: str, at: int, dead: set[int]) -> int:
    """The place of the > that ends a tag whose attributes begin at ``at``, whatever their length; -1 if a < or an open
    quote comes first. ``dead`` keeps the quotes from which no end was found, so a page is searched once."""
    seen = []
    while found := _stop.search(page, at):
        place, mark = found.start(), found[0]
        if mark == ">":
            return place
        if mark == "<" or place in dead:
            break
        seen.append(place)
        at = page.find(mark, place + 1) + 1
        if not at:
            break
    dead.update(seen)
    return -1


class Line:
    """A block of text: its length as mostly linked text, its element, and the innermost element that a name cuts, or -1.

    The empty lines at section borders have no text."""

    __slots__ = ("cut", "element", "linked", "text")

    def __init__(self, text: str = "", linked: int = 0, element: int = 0, cut: int = -1) -> None:
        self.text, self.linked, self.element, self.cut = text, linked, element, cut

    @property
    def is_link(self) -> bool:
        return self.linked > LINKED * len(self.text)


class Page:
    """Lines of a page, and its block elements as (tag, number of the parent); element 0 stands for the whole page."""

    def __init__(self) -> None:
        self.lines: list[Line] = []
        self.tags, self.parents = ["html"], [-1]

    def open(self, tag: str, parent: int) -> int:
        self.tags.append(tag)
        self.parents.append(parent)
        return len(self.tags) - 1

    def sums(self, lengths: list[int], elements: list[int]) -> list[int]:
        """For each element the sum of the lengths of the lines in it."""
        total = [0] * len(self.tags)
        for length, element in zip(lengths, elements, strict=True):
            total[element] += length
        for k in range(len(total) - 1, 0, -1):  # parents have smaller numbers
            total[self.parents[k]] += total[k]
        return total


def read_page(source: str) -> Page:
    out = Page()
    stack: list[tuple[str, int, int, int]] = []  # open blocks: tag, number, kind of cut, element that a name cuts
    buffer: list[str] = []
    linked = at = cut = links = mains = 0
    n = len(source)
    last = source.rfind(">")
    dead: set[int] = set()
    unclosed: set[str] = set()

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            if text:
                out.lines.append(Line(text, min(linked, len(text)), stack[-1][1] if stack else 0, stack[-1][3] if stack else -1))
            buffer.clear()
        linked = 0

    def border() -> None:
        if out.lines and out.lines[-1].text:
            out.lines.append(Line())

    def pop_to(index: int) -> None:
        nonlocal cut, mains
        while len(stack) > index:
            name, _, kind, _ = stack.pop()
            cut -= kind == CUT
            mains -= name in ("article", "main")
            if name in SECTIONS:
                border()

    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            lt = n
        if lt > at and not cut:
            piece = source[at:lt]
            buffer.append(piece)
            if links:
                linked += len(piece)
        if lt >= n:
            break
        if source.startswith("<!--", lt):
            end = source.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if source.startswith("<![CDATA[", lt):
            end = source.find("]]>", lt)
            at = n if end < 0 else end + 3
            continue
        if source[lt + 1 : lt + 2] in ("!", "?"):
            end = source.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        found = _open.match(source, lt)
        end = _tag_end(source, found.end(), dead) if found else -1
        if found and end < 0 and found.end() <= last:
            end = source.find(">", found.end())
        if end < 0:
            if not cut:
                buffer.append("<")
            at = lt + 1
            continue
        at = end + 1
        closing, name, attributes = found[1], found[2].lower(), source[found.end() : end]
        is_block = name in BLOCKS
        if name == "a":
            links = 0 if closing else 1
        elif name == "br":
            if not cut:
                buffer.append(" ")
        elif not closing and name in RAW:
            if not attributes.endswith("/") and name not in unclosed:
                end = re.compile(f"</{re.escape(name)}\\s*>", re.I).search(source, at)
                if end:
                    at = end.end()
                elif name in ("script", "style", "textarea", "xmp"):
                    at = n
                else:  # no later one is closed either
                    unclosed.add(name)
        elif name in VOID and name != "hr":
            pass
        elif not closing:
            kind = _cut_kind(name, attributes, mains > 0)
            if is_block:
                flush()
                links = 0
                if stack and stack[-1][0] == "p" and name != "hr":
                    pop_to(len(stack) - 1)
                if name in ("li", "dt", "dd", "option", "tr", "td", "th"):
                    same = {"li"} if name == "li" else {"dt", "dd"} if name in ("dt", "dd") else {name}
                    if stack and stack[-1][0] in same:
                        pop_to(len(stack) - 1)
                if name in SECTIONS:
                    border()
            if (is_block and name != "hr" or kind) and not attributes.endswith("/"):
                if kind:
                    flush()
                number = out.open(name, stack[-1][1] if stack else 0)
                stack.append((name, number, kind, number if kind == NAMED else stack[-1][3] if stack else -1))
                cut += kind == CUT
                mains += name in ("article", "main")
        else:
            if is_block:
                flush()
                links = 0
            for index in range(len(stack) - 1, -1, -1):
                if stack[index][0] == name:
                    pop_to(index)
                    break
    flush()
    return out


def without_named(page: Page) -> list[Line]:
    """The lines of the page but those in an element that a name cuts, unless it holds most of the text."""
    lines = page.lines
    total, count = (page.sums(x, [line.element for line in lines]) for x in ([len(line.text) for line in lines], [bool(line.text) for line in lines]))
    goes = {k for k in {x.cut for x in lines} - {-1} if total[k] <= WHOLE * total[0] or count[k] < 2 * SPAN}
    return [x for x in lines if x.cut not in goes]


def line_blocks(lengths: list[int]) -> list[tuple[int, int]]:
    """Spans [surge point, dive point) of a list of line lengths, without empty lines at their ends."""
    sums, total = [], 0
    for k in range(len(lengths) - 1, -1, -1):
        total += lengths[k] - (lengths[k + SPAN] if k + SPAN < len(lengths) else 0)
        sums.append(total)
    sums.reverse()
    surge = min(SURGE, max(sums, default=0))
    dive = min(DIVE, surge)
    least = DIVE if any(x >= surge and length >= DIVE for x, length in zip(sums, lengths, strict=True)) else 1
    spans: list[tuple[int, int]] = []
    k = 0
    while surge and k < len(sums):
        if sums[k] >= surge and lengths[k] >= least:
            end = k
            while end < len(sums) and sums[end] >= dive:
                end += 1
            while not lengths[end - 1]:
                end -= 1
            spans.append((k, end))
            k = end
        else:
            k += 1
    return spans


def _inside(page: Page, lines: list[Line], holder: int) -> list[bool]:
    """Whether each line stands in an element."""
    within = [False] * len(page.tags)
    for k in range(len(within)):
        within[k] = k == holder or k > holder and within[page.parents[k]]
    return [within[x.element] for x in lines]


def _holder(page: Page, lines: list[Line], lengths: list[int], spans: list[tuple[int, int]]) -> int:
    """The innermost element with ``SHARE`` of the text in spans; the innermost article or main part, if one has it."""
    dense = [0] * len(lengths)
    for a, b in spans:
        dense[a:b] = lengths[a:b]
    total = page.sums(dense, [x.element for x in lines])
    chain = [0]
    for k in range(1, len(total)):
        if page.parents[k] == chain[-1] and page.tags[k] in HOLDERS and total[k] >= SHARE * total[0]:
            chain.append(k)
    return next((k for k in reversed(chain) if page.tags[k] in ("article", "main")), chain[-1])


def kept_lines(page: Page) -> list[Line]:
    """The lines of the page's main text, in order."""
    lines = without_named(page)
    lengths = [0 if x.is_link and len(x.text) < 4 * SURGE else len(x.text) for x in lines]
    spans = line_blocks(lengths)
    if not spans:
        return []
    holder = _holder(page, lines, lengths, spans)
    inside = _inside(page, lines, holder)
    if page.tags[holder] in ("article", "main"):
        return [x for x, here in zip(lines, inside, strict=True) if here and x.text]
    mine = [k for a, b in spans for k in range(a, b) if inside[k] and lengths[k]]
    first, end = mine[0], mine[-1] + 1
    around = {holder}
    while page.tags[holder] not in ("body", "html") and page.parents[holder] >= 0 and page.tags[page.parents[holder]] not in ("body", "html"):
        holder = page.parents[holder]
        around.add(holder)
    kinds = TEXTUAL | {page.tags[lines[k].element] for k in mine}
    held = {}  # parts that hold text of a span

    def belongs(line: Line) -> bool:
        """Whether a line beside the text continues it: in a part around it, or in a list, table or quote there."""
        if not line.text:
            return True
        if line.is_link:
            return False
        at = line.element
        while at not in around:
            if at < 0 or page.tags[at] in ("body", "html"):
                return page.tags[line.element] in kinds and at == line.element
            if page.tags[at] in HOLDERS and page.tags[at] not in kinds and at not in held:
                return False
            at = page.parents[at]
        return True

    for k in mine:
        at = lines[k].element
        while at >= 0 and at not in held:
            held[at] = True
            at = page.parents[at]
    headline = next((k for k in range(first) if page.tags[lines[k].element] == "h1" and lines[k].text), first)
    start = first
    while start and belongs(lines[start - 1]):
        start -= 1
    start = min(start, headline)
    while end < len(lines) and belongs(lines[end]):
        end += 1
    return [x for x in lines[start:end] if x.text]


def main_text(source: str | None) -> list[str]:
    return [x.text for x in kept_lines(read_page(source))] if source else []


def _step():
    def step(batch: pa.RecordBatch) -> dict:
        found = [main_text(x) for x in batch.column(2).to_pylist()]
        return {"page_id": batch.column(0), "url": batch.column(1), "text": ["\n\n".join(x) for x in found], "n_blocks": [len(x) for x in found]}

    return step


def extract(pages: DataFrame) -> DataFrame:
    """pages: page_id, url, html. Returns page_id, url, text, n_blocks."""
    return map_rows(pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html"), ["page_id", "url", "html"], _step, SCHEMA)


def op6(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"), "n_blocks")
