"""Main text of web pages by rules over blocks, in two passes.

First pass: each block (the text between two tags that break lines) is judged by the share of its
characters inside links, by its length, and by the share of its words that are stop words: text,
clutter, or undecided. Where a page as a whole has hardly any of the stop words known here, they
abstain, and lengths and links decide. Second pass: an undecided block takes over what its nearest
decided neighbours say, looking both ways.

Markup is evidence. What HTML itself sets apart (navigation, asides, footers, forms, hidden
elements) is clutter, and so is what names like "comments" or "cookie-notice" say, unless nothing
would remain. Article and main elements count where they hold most of what the first pass takes
for text: then what stands outside is clutter, and their undecided blocks look for neighbours
inside only. Where they hold less, as teasers do, they say nothing.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessera.llm.quality import STOP_WORDS

#: Elements whose content is no text at all, as raw text up to their end tag.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
#: Elements that never belong to the main text (fixed by what HTML says of them).
CLUTTER_TAGS = {"nav", "footer", "aside", "form", "menu", "button", "select", "option", "dialog", "head", "svg", "canvas", "object", "audio", "video", "map", "label", "fieldset", "input"}
CLUTTER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "dialog", "alert", "alertdialog", "form", "toolbar"}
MAIN_TAGS, MAIN_ROLES = {"article", "main"}, {"main", "article"}
#: Words of class and id names that tell clutter.
CLUTTER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "sidebar aside rail widget widgets footer foot masthead topbar header cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login "
    "comment comments commentlist disqus respond reply replies share sharing social related recommended recommendations pagination pager tags tagcloud toolbar search searchbox skip copyright legal disclaimer alert".split()
)
#: Words that say where or how, after or beside the word that says what.
PLACE_NAMES = frozenset(
    "left right top bottom upper lower wrapper wrap container box area section list listing block inner outer col column content contents item items bar panel group unit slot "
    "row text body title heading links link posts articles stories buttons icons media desktop mobile fixed sticky".split()
)
#: Words of parts of an article, whose header is its headline.
ARTICLE_NAMES = frozenset("article entry post story content".split())
#: Words before others that tell of the layout.
LAYOUT_NAMES = frozenset("has no with without is js".split())
#: Tags that end a block.
BLOCK_TAGS = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Start tags that end an open paragraph.
ENDS_P = BLOCK_TAGS - {"body", "html", "head", "caption", "legend", "option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "title"}

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|</(?P<close>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|</(?![a-zA-Z])[^>]*(?:>|\Z)"
    r"|<(?P<open>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?P<end>>|\Z)"
    r"|<(?P<odd>[a-zA-Z][^\s/>]*)(?P<oddattrs>[^>]*)(?:>|\Z)",
    re.S,
)
ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPACE = re.compile(r"\s+")
WORD = re.compile(r"[^\W\d_]+")
STOP = frozenset(STOP_WORDS)

#: First pass, in characters and shares.
SHORT, LONG, LINKS, LINKED, STOP_LOW, STOP_HIGH, STOP_NONE = 70, 200, 0.2, 0.5, 0.15, 0.25, 0.02
#: Share of stop words in a page below which they abstain; blocks in a row that are links only and make a menu.
ABSTAIN, MENU = 0.05, 3


@dataclass
class Block:
    text: str
    main: bool  # inside an article or main element
    clutter: bool  # inside an element that HTML sets apart
    named: bool  # inside an element with the name of clutter
    heading: bool
    linked: int  # characters inside links

    @property
    def links(self) -> float:
        return self.linked / len(self.text)


def _attributes(raw: str) -> dict[str, str]:
    return {m[0].lower(): html.unescape(m[1] or m[2] or m[3]) for m in ATTR.findall(raw)} if raw.strip(" /\n\t") else {}


def _is_clutter(tag: str, attrs: dict[str, str], main: bool) -> bool:
    if tag in CLUTTER_TAGS or attrs.get("role", "").lower() in CLUTTER_ROLES:
        return True
    if tag == "header":  # that of a page; an article has its own, with its headline
        return not main
    return "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", "")))


def _has_clutter_name(tag: str, attrs: dict[str, str]) -> bool:
    """Whether a class or the id names clutter: by its last word that says what, not where."""
    if tag in ("body", "html"):
        return False
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        words = [w.lower() for w in re.split(r"[_-]+|(?<=[a-z])(?=[A-Z])", name) if w and not w.isdigit()]
        if not words or words[0] in LAYOUT_NAMES:
            continue
        while len(words) > 1 and words[-1] in PLACE_NAMES:
            words.pop()
        if words[-1] in CLUTTER_NAMES and not (words[-1] == "header" and words[0] in ARTICLE_NAMES):
            return True
    return False


def blocks(page: str) -> list[Block]:
    """The blocks of a page with any text, in page order, white space and references resolved."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # (tag, clutter in or above, named so, main)
    opened: Counter[str] = Counter()  # how often each tag is on the stack
    parts: list[str] = []
    linked = links = breaks = heading = 0

    def close() -> None:
        nonlocal parts, linked
        text = SPACE.sub(" ", "".join(parts)).strip()
        if text:
            _, clutter, named, main = stack[-1] if stack else ("", False, False, False)
            out.append(Block(text, main, clutter, named, heading > 0, min(linked, len(text))))
        parts, linked = [], 0

    def text(raw: str) -> None:
        nonlocal linked, breaks
        if raw:
            value = html.unescape(raw)
            if not value.isspace():
                breaks = 0
            parts.append(value)
            if links:
                linked += len(SPACE.sub(" ", value).strip())

    def pop(tag: str) -> None:
        nonlocal links, heading
        while stack:
            name = stack.pop()[0]
            opened[name] -= 1
            links -= name == "a"
            heading -= name in ("h1", "h2", "h3", "h4", "h5", "h6")
            if name == tag:
                break

    at = 0
    while True:
        found = TOKEN.search(page, at)
        text(page[at : found.start() if found else len(page)])
        if not found:
            break
        at = found.end()
        tag = (found["open"] or found["odd"] or "").lower()
        ended = (found["close"] or "").lower()
        if tag:
            if tag == "br":
                breaks += 1
                parts.append(" ")
                if breaks > 1:
                    close()
                continue
            if tag in BLOCK_TAGS:
                close()
                breaks = 0
                if tag in ENDS_P and any(t[0] == "p" for t in stack[-12:]):
                    pop("p")
                for same in ({"li"} if tag == "li" else {"dt", "dd"} if tag in ("dt", "dd") else ()):
                    if stack and stack[-1][0] == same:
                        pop(same)
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
                continue
            raw = found["attrs"] if found["open"] else found["oddattrs"]
            if tag in VOID:
                continue
            attrs = _attributes(raw or "")
            _, clutter, named, main = stack[-1] if stack else ("", False, False, False)
            main_here = tag in MAIN_TAGS or attrs.get("role", "").lower() in MAIN_ROLES
            stack.append((tag, clutter or _is_clutter(tag, attrs, main), named or _has_clutter_name(tag, attrs), main or main_here))
            opened[tag] += 1
            links += tag == "a"
            heading += tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        elif ended:
            if ended in BLOCK_TAGS:
                close()
                breaks = 0
            if opened[ended] > 0:
                pop(ended)
    close()
    return out


def _stop_words(block: Block) -> tuple[int, int]:
    words = WORD.findall(block.text.lower())
    return sum(w in STOP for w in words), len(words)


def first_pass(found: list[Block]) -> list[bool | None]:
    """For each block True: text, False: clutter, None: undecided; by densities and length alone."""
    counts = [_stop_words(b) for b in found]
    stops, words = (sum(c[k] for b, c in zip(found, counts) if b.links <= LINKS) for k in (0, 1))
    abstain = stops < ABSTAIN * words
    return [_judged(b, None if abstain else n / max(m, 1)) for b, (n, m) in zip(found, counts)]


def _judged(block: Block, stops: float | None) -> bool | None:
    """stops: the share of stop words; None: they abstain."""
    if block.links > LINKED:
        return False
    if len(block.text) < SHORT:
        return None if block.linked == 0 or block.heading else False
    if block.links > LINKS:
        return None
    if len(block.text) >= LONG:
        return True if stops is None or stops >= STOP_LOW else False if stops <= STOP_NONE else None
    return True if stops is not None and stops >= STOP_HIGH else None


def second_pass(labels: list[bool | None], headings: list[bool], alone: bool = True) -> list[bool]:
    """Undecided blocks follow the nearest decided ones: both, or else the nearer (the following
    one for a heading, the one before on a tie); where nothing at all is decided, `alone`."""
    n = len(labels)
    before, after, at = [None] * n, [None] * n, None
    for i in range(n):
        at = i if labels[i] is not None else at
        before[i] = at
    at = None
    for i in reversed(range(n)):
        at = i if labels[i] is not None else at
        after[i] = at
    out = []
    for i, label in enumerate(labels):
        a, b = before[i], after[i]
        if label is None:
            if a is None and b is None:
                label = alone
            elif a is None or b is None:
                label = labels[b if a is None else a]
            elif labels[a] == labels[b]:
                label = labels[a]
            else:
                label = labels[b] if headings[i] or b - i < i - a else labels[a]
        out.append(label)
    return out


def _inside(found: list[Block], labels: list[bool | None]) -> list[bool | None]:
    """Labels in a trusted article: densities say no only to menus, blocks in a row that are links."""
    out = [label or None for label in labels]
    at = 0
    while at < len(found):
        end = at
        while end < len(found) and found[end].links > 0.9 and not found[end].heading:
            end += 1
        if end - at >= MENU:
            out[at:end] = [False] * (end - at)
        at = max(end, at + 1)
    return out


def judged(found: list[Block]) -> tuple[list[bool | None], list[bool]]:
    """(labels before the second pass, whether each block is kept), for the blocks of a page."""
    for named in (True, False):  # names count unless nothing would remain
        open_to = [i for i, b in enumerate(found) if not (b.clutter or named and b.named)]
        if open_to:
            break
    own = [found[i] for i in open_to]
    by_density = first_pass(own)
    plain = lambda main, of: sum(len(b.text) - b.linked for b, x in zip(own, by_density) if x in of and b.main == main)
    trusted = any(b.main for b in own) and plain(True, (True, None)) >= plain(False, (True,))
    labels: list[bool | None] = [False] * len(found)
    kept = [False] * len(found)
    if trusted:
        open_to = [i for i in open_to if found[i].main]
        here = _inside([found[i] for i in open_to], [x for b, x in zip(own, by_density) if b.main])
        verdict = second_pass(here, [found[i].heading for i in open_to])
        for i, label, keep in zip(open_to, here, verdict):
            labels[i], kept[i] = label, keep
        return labels, kept
    for i, label in zip(open_to, by_density):
        labels[i] = label
    # marked clutter says what its undecided neighbours are, if anything at all was taken for text
    sure = labels if any(by_density) else [labels[i] for i in open_to]
    where = range(len(found)) if any(by_density) else open_to
    for i, keep in zip(where, second_pass(list(sure), [found[i].heading for i in where])):
        kept[i] = keep
    return labels, kept


def main_text(page: str) -> str:
    """The text blocks of a page, one per line."""
    found = blocks(page)
    return "\n".join(b.text for b, keep in zip(found, judged(found)[1]) if keep)


def extract_html(pages: DataFrame, html_col: str = "html", out_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of pages (all but html_col, if None; one named as out_col is replaced)
    with out_col: the main text of each page.

    A null or empty page, or one without text, gives an empty string. Pages that break off or nest
    tags wrongly are read as far as they go. Repeated rows each come back; an empty table gives an
    empty result. Pages are read whole, whatever their length.
    """
    keep = [c for c in (pages.columns if keep is None else keep) if c not in (html_col, out_col)]
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in keep), F.lit(True).alias("_")).alias("carried"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("page"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(x.as_py()) for x in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["carried", "text"])

    out = rows.mapInArrow(run, StructType([rows.schema["carried"], StructField("text", StringType())]))
    return out.select(*(F.col("carried")[c].alias(c) for c in keep), F.col("text").alias(out_col))
