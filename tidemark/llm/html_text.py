"""Main text of web pages by two-pass block rules.

The page is cut into blocks at block tags. First pass: a block inside furniture (navigation, footers, asides, forms, blocks
named as adverts, comments and the like, but for an article inside them if there is none elsewhere) or mostly made of links is bad; one that is long enough and dense enough in stop words
is good; the rest is undecided. A name that only has a piece of furniture beside words of its own ("market-share") tells little: such an
element is furniture if no block in it is long, dense and not made of links. The stop words are of four languages, so a long block in another than the Latin script is good
without them, as is any long block of a page whose long blocks are for the greater part not dense. Second pass: undecided blocks take the label of the nearest decided block of their region
(an article, or what lies outside), a heading preferring the one below it; with none decided, an article's blocks are good and
others bad.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "the of and to in is that it for was on are as with be by this from at or an not have has but he she they which you we his her its their been were "
    "der die das und ist in den von zu mit sich des auf für im dem nicht ein eine als auch es an werden aus er hat dass sie nach bei um am sind noch wie "
    "de la le les et des un une en du que est pour qui dans par sur au pas plus ce se il elle avec son sa ne ou aux sont mais cette "
    "el los las y del que se por con para una su al lo como más pero sus este ya entre cuando muy sin sobre también me hasta hay donde".split()
)
#: Words of a long block, the stop-word density that makes a block good, and the link density that makes it bad.
LONG, DENSE, LINKED = 12, 0.10, 0.5
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
_RAW = frozenset("script style noscript template iframe svg math object select textarea button head title canvas audio video".split())
_SWALLOWS = frozenset("script style textarea title".split())  # unclosed, they hold the rest of the page
_FURNITURE = frozenset("nav footer aside form menu dialog".split())
_PAGE = frozenset("html body main article".split())  # their names tell of the whole page
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Names of furniture: as a piece of a class, id or role that '-' or '_' part, and as the whole of one (as pieces these also tell
#: of a page's layout or an article's subject); and names that tell of a state.
_NAMED = re.compile(r"(?:^|[_-])(?:ads?|advert\w*|adbox|banner|sponsor\w*|promo\w*|cookies?|consent|alert|popup|modal|overlay|newsletter|subscribe|signup|widget|menu|navbar|breadcrumbs?|pagination|pager|share|sharing|recommend\w*|comments?|comment-\w+|replies|reply|respond|disqus|footer|masthead|site-header|page-header|topbar|toolbar|copyright|disclaimer|login)(?=$|[_-])", re.IGNORECASE)
_WHOLE = re.compile(r"^(?:side-?bar|nav\w*|legal|social|search|related|notice|(?:main|site|top|primary|secondary|left|right)[_-](?:nav\w*|side-?bar)|related[_-](?:posts?|articles?|stories|links|items?)|social[_-](?:links|media|icons|bar)|search[_-](?:form|box|bar)|legal[_-](?:notice|links))$", re.IGNORECASE)
#: Pieces that name furniture whatever stands beside them, and pieces that only tell of layout.
_CLEAR = re.compile(r"advert\w*|adbox|sponsor\w*|cookies?|consent|popup|modal|newsletter|navbar|breadcrumbs?|pagination|comments|replies|respond|disqus|masthead|topbar", re.IGNORECASE)
_LAYOUT = frozenset("bar box block wrapper wrap container section area list item items inner outer top bottom left right site page main primary secondary header unit slot module panel form link links button buttons icon icons text title body content meta row col column grid group nav search social".split())
_QUOTED = frozenset("blockquote pre h1 h2 h3 h4 h5 h6 td th".split())  # text of an article's own, whatever their names
_REPLY = re.compile(r"(?:^|[_-])(?:comments?|replies|reply)(?=$|[_-])", re.IGNORECASE)
_STATE = re.compile(r"(?:has|with|without|no)[_-].*|.*[_-](?:open|opened|closed|enabled|disabled)", re.IGNORECASE)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: An attribute: its name, and a value in double quotes (and the closing one), in single quotes, or bare.
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)(\"?)|'([^']*)('?)|([^\s>]*)))?")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_BETWEEN = re.compile(r"[\s/]*")
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"\w+")
#: Letters of scripts that part no words by spaces (Thai, Lao, Burmese, Khmer, kana, Han), and all letters outside Latin.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_LETTERS, _FOREIGN = re.compile(r"[^\W\d_]"), re.compile("[^\\W\\d_\u0000-\u024f\u1e00-\u1eff]")


def _attributes(page: str, at: int) -> tuple[list[str], bool, int]:
    """The names in class, id and role of a tag whose attributes begin at a place, whether it is hidden (by that attribute or its own
    style), and the place behind its '>' (the page's end without one). A quote that nothing closes ends the tag at the next '>'. Each character is looked at a bounded number of times:
    a kind of quote can be left open once a page."""
    names, hidden, start, end = [], False, at, len(page)
    while True:
        at = _BETWEEN.match(page, at).end()
        if at >= end:
            return names, hidden, end
        if page[at] == ">":
            return names, hidden, at + 1
        m = _ATTRIBUTE.match(page, at)
        at = m.end()
        if m[3] == "" or m[5] == "":
            over = page.find(">", start)
            return names, hidden, over + 1 if over >= 0 else end
        name, value = m[1].lower(), m[2] or m[4] or m[6] or ""
        if name in ("class", "id", "role"):
            names += value.split()
        elif name == "hidden" or name == "style" and _UNSEEN.search(value):
            hidden = True


def _named(names: list[str], *names_of: re.Pattern) -> bool:
    """Whether one of the names of class, id or role is such a name."""
    return any(not _STATE.fullmatch(t) and any(x.search(t) for x in names_of) for t in names)


def _furniture(names: list[str], quoted: bool) -> int:
    """2 if a name of class, id or role is furniture's, 1 if only a piece of one may be, else 0."""
    found = 0
    for t in names:
        if _STATE.fullmatch(t):
            continue
        if _WHOLE.search(t):
            return 2
        if _NAMED.search(t):
            pieces = [p for p in re.split("[_-]", t.lower()) if p]
            own = [p for p in pieces if not (p in _LAYOUT or p.isdigit() or _NAMED.search(p))]
            if any(_CLEAR.fullmatch(p) for p in pieces) or not quoted and (not own or pieces[0] == "comment"):
                return 2
            found = 1
    return found


@dataclass
class Block:
    text: str
    bad: bool
    region: int  # 0: outside articles
    heading: bool
    link_chars: int
    doubt: int = 0  # the outermost element around it whose name may be furniture's
    label: int = 0  # after the first pass: 1 good, -1 bad, 0 undecided
    final: int = 0


def blocks(page: str) -> list[Block]:
    """The page's non-empty blocks, in order, with decoded and squeezed text."""
    out: list[Block] = []
    stack: list[tuple[str, int, int, int]] = []  # open elements: tag, inside furniture (1 by name, 2 by tag), region, doubt
    parts: list[str] = []
    linked = links = 0
    regions = 0
    wrapped: set[int] = set()  # articles inside elements that only their name makes furniture
    heading = False
    bad, region, doubt, doubts = 0, 0, 0, 0

    def close() -> None:
        nonlocal parts, linked, heading
        text = _SPACE.sub(" ", "".join(parts)).strip()
        if text:
            out.append(Block(text, bad > 0, region, heading, linked, doubt))
        parts, linked, heading = [], 0, False

    def say(piece: str) -> None:
        nonlocal linked
        piece = html.unescape(piece)
        parts.append(piece)
        if links:
            linked += len(piece.strip())

    at, end = 0, len(page)
    unclosed: set[str] = set()  # raw elements that nothing closes from here on
    while at < end:
        m = _TAG.match(page, at) if page[at] == "<" else None
        if m is None:
            if page[at] != "<" or page[at + 1 : at + 2] not in ("!", "?", "/"):
                over = page.find("<", at + 1)
                over = end if over < 0 else over
                say(page[at:over])
                at = over
            else:
                mark = "-->" if page.startswith("<!--", at) else ">"
                over = page.find(mark, at + 2)
                at = end if over < 0 else over + len(mark)
            continue
        tag, closing = m[2].lower(), bool(m[1])
        names, hidden, at = _attributes(page, m.end())
        if tag in _RAW and not closing:
            over = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.IGNORECASE).search(page, at)
            if over is None and tag not in _SWALLOWS:  # its start tag stands alone
                unclosed.add(tag)
                continue
            at = over.end() if over else end
            if tag in _BLOCK:
                close()
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag == "a":
            links = max(0, links + (-1 if closing else 1)) if closing or not links else links
            continue
        if tag in _BLOCK:
            close()
            links = 0
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            _, bad, region, doubt = stack[-1] if stack else ("", 0, 0, 0)
        elif tag in _BLOCK and tag not in _VOID:
            if tag in ("p", "li", "td", "th", "tr", "dd", "dt", "option"):  # these end their like without an end tag
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
                    if stack[k][0] not in ("p", "b", "span", "em", "i"):
                        break
                _, bad, region, doubt = stack[-1] if stack else ("", 0, 0, 0)
            if tag in ("article", "main") and not region:
                regions += 1
                region = regions
                if bad == 1 and not (tag == "article" and _named(names, _REPLY)):  # a comment may be an article too
                    bad = 0
                    wrapped.add(region)
            named = 0 if tag in _PAGE else _furniture(names, tag in _QUOTED)
            if hidden or tag in _FURNITURE or tag == "header" and not region:
                bad = 2
            elif not bad and named == 2:
                bad = 1
            elif named == 1 and not doubt:
                doubts += 1
                doubt = doubts
            stack.append((tag, bad, region, doubt))
        if tag in _HEADING and not closing:
            heading = True
    close()
    # Where there is an article outside such elements, those inside them are teasers or comments.
    if any(b.region and b.region not in wrapped and not b.bad for b in out):
        for b in out:
            b.bad = b.bad or b.region in wrapped
    return out


def classify(found: list[Block]) -> list[Block]:
    """Gives every block its final label, 1 (good) or -1 (bad)."""
    cleared: set[int] = set()  # elements of a doubtful name that hold text of the page
    dull, chars = [], [0, 0]  # long blocks that are not dense; code points of long blocks that are not, that are
    for b in found:
        words = _WORDS.findall(b.text)
        dense = sum(w.lower() in STOP_WORDS for w in words) / max(1, len(words))
        if b.doubt and len(words) >= LONG and (dense >= DENSE or b.region) and 5 * b.link_chars <= len(b.text):
            cleared.add(b.doubt)
        if b.bad or b.link_chars > LINKED * len(b.text):
            b.label = -1
        elif len(words) >= LONG or not b.text.isascii() and len(_UNSPACED.findall(b.text)) >= 2 * LONG:  # about two letters a word
            chars[dense >= DENSE] += len(b.text)
            if dense >= DENSE or b.region or not b.text.isascii() and 2 * len(_FOREIGN.findall(b.text)) > len(_LETTERS.findall(b.text)):
                b.label = 1
            else:
                dull.append(b)
    if chars[0] > chars[1]:
        for b in dull:
            b.label = 1
    for b in found:
        if b.doubt and b.doubt not in cleared:
            b.label = -1
    # Nearest decided blocks above and below, by one walk each way. What is bad inside an article is an island there and
    # decides nothing about its neighbours.
    above, below = _nearest(found, range(len(found))), _nearest(found, range(len(found) - 1, -1, -1))
    for k, b in enumerate(found):
        if not b.label:
            near = [(abs(j - k) - 0.5 * (b.heading and j > k), -found[j].label) for j in (above[k], below[k]) if j is not None]
            b.final = -min(near)[1] if near else 1 if b.region else -1
        else:
            b.final = b.label
    return found


def _nearest(found: list[Block], order) -> list[int | None]:
    out: list[int | None] = [None] * len(found)
    last: dict[int, int] = {}
    for k in order:
        b = found[k]
        out[k] = last.get(b.region)
        if b.label > 0 or b.label < 0 and not b.region:
            last[b.region] = k
    return out


def main_text(page: str | None) -> str:
    """The good blocks joined by two newlines; empty for null, empty or textless pages."""
    return "\n\n".join(b.text for b in classify(blocks(page or "")) if b.final > 0)


def _main_texts(pages: pd.Series) -> pd.Series:
    return pages.map(main_text)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row; a null or empty page has empty text. Repeated rows are repeated, null ids and
    urls kept, other columns (of whatever name) ignored. Pages of any length and markup of any kind are read in one pass."""
    return pages.select("page_id", "url", F.pandas_udf(_main_texts, "string")(F.coalesce("html", F.lit(""))).alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))


def op9(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
