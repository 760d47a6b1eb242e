"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass classifies each block by itself from
stop-word density, length and link density: good, bad, or undecided when it is short or its density
lies between. In the second pass undecided blocks take the label of the nearest decided neighbours.
On a page in a language without listed stop words, length, links and sentence marks decide instead;
writing without spaces counts two characters as a word.

Menus, headers, footers, asides and the like are bad whatever their words, by their element; scripts,
styles and the head aren't text. A form, or an element whose class, id or role names such a part,
only hints at it: names that tell of a layout ("with-sidebar", "comments-open") or stand beside names
of content don't count, and where next to no text is left outside such an element, the block rules
decide inside it, unless it holds comments, notices or recommendations. In an article element, words
alone never make a block bad: only a block of links or such a part does.

Defined cases: a null or empty page, or one without main text, has the empty text; markup that is cut
off or badly nested is read as far as it goes; very long pages are read whole; repeated rows are
extracted alike; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import STOP_WORDS

_STOP = frozenset(STOP_WORDS)
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")

#: Elements whose content is not markup (fixed values).
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Elements that start a new block (fixed values).
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements without content (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never the article's (fixed values).
BAD_TAGS = frozenset("head nav header footer aside noscript template svg math button select option dialog menu search object canvas audio video datalist label fieldset script style".split())
#: Words in an element's class, id or role that tell what it holds (fixed values).
BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies "
    "copyright disclaimer disqus footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification notifications overlay pager pagination "
    "popup promo promoted promotion recommended recommendations related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription "
    "toolbar widget widgets alert dialog form discussion".split()
)


#: Of these, names of parts that are never the main text, however long they are (fixed values).
NEVER_MAIN = frozenset("ad ads advert adverts advertisement comment comments commentlist cookie cookies consent gdpr discussion disqus notice notices recommended recommendations related replies reply respond".split())
#: Words in a name that tell of content (fixed values).
GOOD_NAMES = frozenset("article body content entry main page post story text wrapper container layout site".split())
#: Words that turn a name into one of a layout or a state (fixed values).
STATES = frozenset("with without has no not is open opened closed enabled disabled on off allow allowed show hide left right layout type status category tag".split())
_IDEOGRAPHS = re.compile("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\u0e00-\u0eff]")
_SENTENCE = re.compile("[.!?。．！？؟।…]")


@dataclass
class Block:
    text: str
    words: int
    stop: int
    linked: int  # characters in links
    bad: bool
    article: int  # number of the article element, 0 outside
    heading: bool
    item: bool  # of a list or table
    hints: tuple[int, ...] = ()  # elements around it whose names hint at a part that isn't main text
    label: str = ""


def _named(attrs: str) -> tuple[bool, str]:
    """Whether an element is hidden, and what its class, id and role hint at: "", "part" or "never"."""
    hint, good, weak, exact = "", False, set(), set()
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, ""
        if key in ("class", "id", "role"):
            for name in value.split():
                words = [w.lower() for w in _NAME.findall(name)]
                bad = {w for w in words if w in BAD_NAMES}
                if not bad:
                    good = good or not GOOD_NAMES.isdisjoint(words)
                elif len(words) == 1:
                    exact |= bad
                elif STATES.isdisjoint(words):
                    weak |= bad
    found = exact | (set() if good else weak)
    if found:
        hint = "part" if NEVER_MAIN.isdisjoint(found) else "never"
    return False, hint


def blocks(page: str) -> tuple[list[Block], list[str]]:
    """The blocks of a page, and the kind of each hint."""
    out: list[Block] = []
    hints: list[str] = []
    parts: list[tuple[str, bool]] = []
    stack: list[tuple[str, bool, int, tuple[int, ...]]] = []  # containers: name, bad, article number, hints
    articles = links = 0
    heading = item = False
    breaks = 0

    def flush() -> None:
        nonlocal heading, item, breaks
        text = " ".join(html.unescape("".join(p for p, _ in parts)).split())
        if text:
            words = text.lower().split()
            linked = sum(len(" ".join(html.unescape(p).split())) for p, in_link in parts if in_link)
            _, bad, article, around = stack[-1] if stack else NONE
            n = max(len(words), len(_IDEOGRAPHS.findall(text)) // 2)
            out.append(Block(text, n, sum(w.strip(".,;:!?()\"'") in _STOP for w in words), linked, bad, article, heading, item, around))
        parts.clear()
        heading = item = False
        breaks = 0

    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            lt = end
        if lt > at:
            piece = page[at:lt]
            parts.append((piece, links > 0))
            if piece.strip():
                breaks = 0
        if lt == end:
            break
        m = _TAG.match(page, lt)
        if not m:
            parts.append(("<", links > 0))
            at = lt + 1
            continue
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue  # comment, doctype
        closing, attrs = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in RAW and not closing:
            stop = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if name == "br":
            breaks += 1
            if breaks > 1:
                flush()
            else:
                parts.append((" ", links > 0))
            continue
        if name == "a":
            links = 0 if closing else 1
            continue
        if name in BLOCK or name in BAD_TAGS:
            flush()
            links = 0
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        if re.fullmatch(r"h[1-6]", name):
            heading = True
        item = name in ("li", "td", "th", "dt", "dd") or item and name == "p"
        if name in VOID or attrs.endswith("/") and name not in BLOCK:
            continue
        _, bad, article, around = stack[-1] if stack else NONE
        hidden, hint = _named(attrs)
        if name in ("p", "li", "td", "th", "tr", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6"):  # may lack an end tag: no containers
            if stack and stack[-1][0] == name:  # a new one ends the one before
                stack.pop()
                _, bad, article, around = stack[-1] if stack else NONE
            if (hidden or hint) and not bad:
                if hint:
                    hints.append(hint)
                    around = (*around, len(hints) - 1)
                stack.append((name, hidden, article, around))
            continue
        if name in BLOCK or name in BAD_TAGS:
            if name in ("article", "main") and not bad and not article:
                articles += 1
                article = articles
            if name == "form":
                hint = hint or "part"
            if name in ("html", "body", "main"):
                hidden, hint = False, ""
            if hint:
                hints.append(hint)
                around = (*around, len(hints) - 1)
            stack.append((name, bad or name in BAD_TAGS or hidden, article, around))
    flush()
    return out, hints


NONE = ("", False, 0, ())


def settle(found: list[Block], hints: list[str], left: float = 0.25) -> None:
    """Blocks in an element that hints at another part become bad, unless nearly all plain text stands in it."""
    plain = [0 if b.bad else len(b.text) - min(b.linked, len(b.text)) for b in found]
    open_ = set(range(len(hints)))
    for k, kind in enumerate(hints):  # outer elements come first
        if kind == "never":
            continue
        inside = sum(n for b, n in zip(found, plain, strict=True) if k in b.hints and not any(hints[h] == "never" for h in b.hints))
        outside = sum(n for b, n in zip(found, plain, strict=True) if k not in b.hints and not any(h in open_ for h in b.hints))
        if inside and outside < left * inside:
            open_.discard(k)
    for b in found:
        b.bad = b.bad or any(h in open_ for h in b.hints)


def classify(found: list[Block], short: int = 10, dense: float = 0.2, sparse: float = 0.08, link_density: float = 0.33) -> None:
    """Set every block's label to good or bad."""
    only_articles = any(b.article and not b.bad for b in found)
    running = [b for b in found if not b.bad and b.words >= short and b.linked <= link_density * len(b.text)]
    # hardly a listed stop word in the running text: another language
    foreign = sum(b.stop for b in running) < 0.5 * dense * sum(b.words for b in running)
    for b in found:
        density, links = b.stop / max(b.words, 1), b.linked / max(len(b.text), 1)
        if b.bad or only_articles and not b.article:
            b.label = "bad"
        elif b.article:
            b.label = "bad" if links > 0.5 and (b.item or b.words < short) else "good" if b.words >= short and (density >= sparse or foreign) else ""
        elif links > link_density:
            b.label = "bad"
        elif b.words < short:
            b.label = ""
        elif foreign:
            b.label = "good" if _SENTENCE.search(b.text) else ""
        else:
            b.label = "good" if density >= dense else "" if density >= sparse else "bad"
    decided = [(i, b.label, b.article) for i, b in enumerate(found) if b.label and not b.bad]
    labels = []
    before = after = 0
    for i, b in enumerate(found):
        if b.label:
            labels.append(b.label)
            continue
        while after < len(decided) and decided[after][0] < i:
            after += 1
        before = after - 1
        near = [d for d in ((decided[before] if before >= 0 else None), (decided[after] if after < len(decided) else None)) if d and (not b.article or d[2] == b.article)]
        if not near:
            labels.append("good" if b.article else "bad")
        elif len(near) == 2 and near[0][1] != near[1][1]:
            gaps = [abs(d[0] - i) for d in near]
            # a heading goes with what follows it, else the nearer one decides, and good wins a tie
            labels.append(near[1][1] if b.heading else near[0][1] if gaps[0] < gaps[1] else near[1][1] if gaps[1] < gaps[0] else "good")
        else:
            labels.append(near[0][1])
    for b, label in zip(found, labels, strict=True):
        b.label = label


def main_text(page: str | None) -> str:
    found, hints = blocks(page or "")
    settle(found, hints)
    classify(found)
    return "\n".join(b.text for b in found if b.label == "good")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page."""

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
