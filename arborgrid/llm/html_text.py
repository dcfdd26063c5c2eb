"""Main text of HTML pages by block rules in two passes: density of stop words and links, then context."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

# Frequent function words of the languages that the block rules know.
STOP_WORDS = frozenset(
    """a an and are as at be by for from has have he her his i in is it its not of on or our she that the their there they
    this to was we were which who will with you your
    au aux avec ce ces dans de des du elle en est et eux il ils je la le les leur lui ma mais me mon ne nous on ou par pas
    pour qu que qui sa se ses son sur un une vous
    al como con de del el ella en es esta este la las lo los mas no o para pero por que se si sin su sus un una y
    als am an auch auf aus bei das dem den der des die ein eine einem einen einer er es für hat ich ihr im in ist mit
    nach nicht noch oder sich sie sind über um und von vor war werden wie wird zu zum zur""".split()
)
# Elements by their part in a page.
SKIPPED = frozenset("script style noscript template svg math iframe object canvas select textarea button title".split())
#: What these hold is text, not tags: one that does not close runs to the end of the page.
RAW = frozenset("script style textarea title".split())
#: Elements that a head can hold; any other ends it.
IN_HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
BOILERPLATE = frozenset("nav header footer aside form menu dialog".split())
MAIN = frozenset("article main".split())
BLOCKS = frozenset(
    """address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4
    h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A paragraph ends where one of these begins.
ENDS_P = BLOCKS - {"body", "html"}
# Words of class names and ids that boilerplate bears, and beginnings of such words.
MARKS = frozenset(
    """ad ads banner cookie cookies consent gdpr notice popup modal newsletter subscribe comment comments disqus replies respond
    sidebar widget related recommended share sharing social breadcrumb breadcrumbs menu pagination pager footer foot header
    masthead toolbar login signup skip""".split()
)
MARK_STEMS = ("advert", "sponsor", "promo", "nav")
#: Of these, the ones that an article's own heading may bear as well.
OWN_HEADER = frozenset("header masthead".split())
# ARIA roles.
MAIN_ROLES = frozenset("main article".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: An attribute as HTML's tokenizer reads it: a stray quote begins a name, a value that no quote closes ends at white space.
_ATTRIBUTE = r"[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s>]*))?+"
_NAMED = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(\"[^\"]*\"|'[^']*'|[^\s>]*))?+")
#: A comment, a declaration, or a tag; what does not close runs to the end of the page.
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_ATTRIBUTE})*+)(?:>|\Z)", re.S)
_SPACE = re.compile(r"\s+")

# Thresholds of the block rules.
LONG, SHORT = 200, 70
STOP_LOW, STOP_HIGH = 0.30, 0.32
LINKS_MOST = 0.2
LOOK = 200  # characters of a neighbour that still counts as near
#: A page whose longer blocks hold a smaller share of stop words is in another language: length and links decide there.
KNOWN = 0.25


class Block(NamedTuple):
    text: str
    linked: int  # characters inside links
    place: str  # "main" in an article or main element, "side" in an element that HTML keeps for other things, or ""
    heading: bool
    marks: tuple[int, ...]  # elements around it that bear a boilerplate name, outermost first


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _NAMED.findall(source):
        quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "\"'"
        out.setdefault(name.lower(), value[1:-1] if quoted else value)
    return out


def is_hidden(a: dict[str, str]) -> bool:
    style = {tuple(x.strip().lower() for x in d.split(":", 1)) for d in a.get("style", "").replace("!important", "").split(";")}
    return "hidden" in a or a.get("aria-hidden", "").lower() == "true" or ("display", "none") in style or ("visibility", "hidden") in style


def boilerplate_names(a: dict[str, str]) -> set[str]:
    words = re.split(r"[\s_-]+", f"{a.get('class', '')} {a.get('id', '')}".lower())
    return {w for w in words if w in MARKS or w.startswith(MARK_STEMS)}


def blocks_of(page: str) -> list[Block]:
    """A page's text blocks in order.

    Character references are decoded; white space inside a block is one space. Tags that never close, close twice or are
    cut off at the page's end are borne: a closing tag closes what it finds open, and nothing if it finds nothing. A head
    ends at the first text or element that it cannot hold; a skipped element that never closes hides nothing, unless its
    content is raw text.
    """
    out: list[Block] = []
    text: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, str, tuple[int, ...]]] = []  # open elements, the place that each gives and the marks around
    place, marks, links, heading, marked = "", (), 0, False, 0

    def flush() -> None:
        nonlocal heading
        if text:
            whole = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            if whole:
                out.append(Block(whole, len(_SPACE.sub(" ", html.unescape("".join(linked))).strip()), place, heading, marks))
            text.clear()
            linked.clear()
        heading = False

    open_ended: set[str] = set()  # names that no closing tag follows from here on

    def closing(name: str, at: int) -> int:
        """The place behind the next closing tag of this name; 0 if there is none."""
        if name in open_ended:
            return 0
        end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
        if not end:
            open_ended.add(name)
        return end.end() if end else 0

    def close(k: int) -> None:
        """Close the k-th open element and all inside it."""
        nonlocal place, marks
        del stack[k:]
        place, marks = stack[-1][1:] if stack else ("", ())

    def end_head() -> None:
        for k, (name, *_) in enumerate(stack):
            if name == "head":
                flush()
                close(k)
                break

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece:
            if not piece.isspace():
                end_head()
            text.append(piece)
            if links:
                linked.append(piece)
        if not m:
            break
        at = m.end()
        name = (m.group(2) or "").lower()
        if not name:
            continue
        if m.group(1):  # a closing tag
            if name in BLOCKS:
                flush()
            if name == "a":
                links = 0
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close(k)
                    break
            continue
        if name not in IN_HEAD:
            end_head()
        if name in SKIPPED and not m.group(3).rstrip().endswith("/"):
            at = closing(name, at) or (size if name in RAW else at)  # if never closed, its content is read like any other
            continue
        if name in BLOCKS:
            flush()
            heading = len(name) == 2 and name[0] == "h" and name[1].isdigit()
        elif name == "br":
            text.append(" ")
            if links:
                linked.append(" ")
        elif name == "a":
            links = 1
        if name in VOID or m.group(3).rstrip().endswith("/"):
            continue
        if name in ENDS_P or name == "p":
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] in BLOCKS:
                    break
        given, around = place, marks
        if name in BOILERPLATE or name == "head":
            # a header inside an article is the article's own
            given = place if place == "main" and name == "header" else "side"
        elif place != "side":
            if name in MAIN:
                given = "main"
            if m.group(3).strip():
                a = attributes(m.group(3))
                roles = set(a.get("role", "").lower().split())
                if is_hidden(a) or roles & SIDE_ROLES:
                    given = "side"
                elif roles & MAIN_ROLES:
                    given = "main"
                elif name in BLOCKS and name not in ("body", "html", "article", "main") and boilerplate_names(a) - (OWN_HEADER if place == "main" else set()):
                    marked += 1
                    around = (*marks, marked)
        stack.append((name, given, around))
        place, marks = given, around
    flush()
    return out


def stop_share(text: str) -> float:
    words = text.split()
    return sum(w.strip(".,;:!?()\"'").lower() in STOP_WORDS for w in words) / len(words)


def decided(block: Block, known: bool = True) -> str:
    """First pass: good, near-good, short (undecided) or bad, by the block's length, links and density of stop words.

    known: whether the page is in a language that the stop words are of; if not, length and links decide. In an article or
    main element nothing is bad for few stop words: lists, code and tables there are left to their neighbours.
    """
    main, length = block.place == "main", len(block.text)
    if block.place == "side" or block.linked >= length > 0 or (block.linked > LINKS_MOST * length and not main):
        return "bad"
    if length < SHORT:
        return "bad" if block.linked and not main else "short"
    if block.linked > LINKS_MOST * length:
        return "short"
    stops = stop_share(block.text) if known else 1.0
    if stops >= STOP_HIGH:
        return "good" if length > LONG else "near-good"
    return "near-good" if stops >= STOP_LOW else "short" if main else "bad"


def unmarked(blocks: list[Block], first: list[str]) -> list[str]:
    """First-pass labels with those of blocks in marked elements set to bad, as long as there is prose elsewhere.

    A name alone decides nothing: while no block outside marked elements is good, near-good or an article's, the outermost marked
    element with the most prose counts as unmarked, as a page's wrapper with such a name does.
    """
    void: set[int] = set()
    prose = [len(b.text) if label in ("good", "near-good") or (b.place == "main" and label == "short") else 0 for b, label in zip(blocks, first, strict=True)]
    while True:
        outermost = [next((c for c in b.marks if c not in void), 0) for b in blocks]
        mass: dict[int, int] = {}
        for c, n in zip(outermost, prose, strict=True):
            mass[c] = mass.get(c, 0) + n
        if mass.get(0) or not any(mass.values()):
            return ["bad" if c else label for c, label in zip(outermost, first, strict=True)]
        void.add(max(mass, key=lambda c: (mass[c], -c)))


def labels_of(blocks: list[Block]) -> list[bool]:
    """Second pass: blocks that the first left open take the label of their nearest decided neighbours.

    A short block is kept if both neighbours are good, or one is and it is near; a near-good one unless both are bad. A
    heading is kept if a good block follows close by. The page's edges count as bad, the edges of an article or main
    element, for blocks in it, as good; there one good neighbour is enough.
    """
    long = [b.text for b in blocks if b.place != "side" and len(b.text) >= SHORT and b.linked <= LINKS_MOST * len(b.text)]
    known = not long or stop_share(" ".join(long)) >= KNOWN
    first = unmarked(blocks, [decided(b, known) for b in blocks])
    n = len(first)
    before, after = ["bad"] * n, ["bad"] * n
    for label, ks, step in ((before, range(n), -1), (after, range(n - 1, -1, -1), 1)):
        last = "bad"
        for k in ks:
            if blocks[k].place == "main" and not (0 <= k + step < n and blocks[k + step].place == "main"):
                last = "good"
            label[k] = last
            if first[k] in ("good", "bad"):
                last = first[k]
    out = []
    for k, (block, label) in enumerate(zip(blocks, first, strict=True)):
        if label == "short" and block.place == "main" and "good" in (before[k], after[k]):
            keep = True
        elif label == "short":
            if block.heading:
                gap, keep = 0, False
                for j in range(k + 1, n):
                    if first[j] == "good" or first[j] == "near-good":
                        keep = True
                        break
                    gap += len(blocks[j].text)
                    if gap > LOOK:
                        break
            else:
                keep = before[k] == after[k] == "good"
                if before[k] != after[k]:
                    near = first[k - 1] if k else "bad"
                    keep = "near-good" in (near, first[k + 1] if k + 1 < n else "bad") or (near == "good" and (k + 1 == n or first[k + 1] != "bad"))
        elif label == "near-good":
            keep = "good" in (before[k], after[k])
        else:
            keep = label == "good"
        out.append(keep)
    if n and not any(out) and "near-good" in first:  # a short page of prose with nothing better around
        out = [x == "near-good" for x in first]
    return out


def main_text(page: str | None) -> str:
    """The main text: kept blocks in page order, joined by an empty line. Null, empty and textless pages give ''."""
    blocks = blocks_of(page or "")
    return "\n\n".join(b.text for b, keep in zip(blocks, labels_of(blocks), strict=True) if keep)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h.as_py()) for h in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", content: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) for every row of pages; one pass over batches, no shuffle.

    Null, empty and textless html give an empty text and 0; a null id or url stays null; repeated rows repeat; whole pages are
    read, however long. Columns besides the three named ones play no part, whatever their names. An empty table gives an
    empty result.
    """
    side = pages.select(pages[page_id].cast("long").alias("page_id"), pages[url].cast("string").alias("url"), pages[content].alias("html"))
    return side.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
