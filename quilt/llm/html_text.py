"""Main text of web pages by two-pass block rules.

Pass one cuts a page into blocks and classifies each by link density, length and stop-word density, inside articles as outside. What
the containers say comes before (navigation, footers, adverts and the like are boilerplate, as is what lies outside the article of a page that marks one) and
lowers the demand on blocks inside an article or a container that is named like one: there, a block of few stop words is ambiguous, not
boilerplate. Pass two lets blocks that stay ambiguous inherit from their nearest decided neighbours of the same region; where a region
has none, its container decides.

Edge cases: null or empty html gives an empty text; unclosed tags, comments and scripts end with the page; pages of any length are
read whole; an ambiguous block between two neighbours at the same distance goes with the good one; repeated rows give repeated results; a null
id or url stays null; only the key, the url and the html are read, so further columns can't clash; an empty table gives an empty table.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """a about after all also an and any are as at be been but by can for from had has have he her his if in into is it its more no not of on one or
    other our out over she so some than that the their them then there these they this to up was we were what when which who will with would you
    aber als am an auch auf aus bei bin bis das dass dem den der des die doch ein eine einem einen einer er es für hat ich ihr im in ist kann
    mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wenn wer wie wir wird zu zum zur
    au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se ses
    son sur un une vous y
    al como con de del el ella en es esta este fue ha hay la las le lo los más me muy no nos o para pero por que se si sin su sus también un una y ya""".split()
)

#: Elements whose content is never text.
_RAW = frozenset("script style noscript template svg iframe textarea select option object canvas math audio video map title".split())
#: Elements that begin and end blocks.
_BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
    header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BOILER_TAGS = frozenset("nav footer aside form menu dialog button label fieldset".split())
_BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class and id attributes that mark boilerplate anywhere.
_BOILER_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted banner sidebar sidebars aside related recommended
    widget share sharing social breadcrumb breadcrumbs menu nav navbar navigation pagination pager footer comment comments disqus replies reply respond
    notice cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup login search toolbar skip copyright""".split()
)
#: And those that do so only outside an article.
_OUTER_WORDS = frozenset("header masthead topbar top bottom site".split())
_MAIN_WORDS = frozenset("article content main post entry story".split())

_MARK = re.compile(r"<!--|<(?=[a-zA-Z/!?])")
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME_WORDS = re.compile(r"[a-z]+")
_WORD = re.compile(r"\w+")
_SPACES = re.compile(r"\s+")


class Block:
    """One run of text between block boundaries: pieces, characters in links, region, container verdict, and the rule that decided."""

    __slots__ = ("boiler", "linked", "main", "pieces", "region", "rule", "tag", "text", "verdict")

    def __init__(self, tag: str, boiler: int, main: int, region: int):
        self.tag, self.boiler, self.main, self.region = tag, boiler, main, region
        self.pieces: list[str] = []
        self.linked, self.text, self.verdict, self.rule = 0, "", "", ""


#: How surely a container is boilerplate: a name that is usual for outer parts of a page yields to an article inside it.
SOFT, HARD = 1, 2
#: How surely a container marks content: by a word of its class or id, or as an article or main element or role=main, which alone silence the rest of the page.
NAMED, MARKED = 1, 2


def _hints(tag: str, attributes: str, inside_main: int) -> tuple[int, int]:
    """How surely an element's name, role, class or id mark boilerplate, and how surely they mark content."""
    boiler = HARD if tag in _BOILER_TAGS or (tag == "header" and not inside_main) else 0
    main = MARKED if tag in ("article", "main") else 0
    if attributes and not attributes.isspace():
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name in ("class", "id") and tag not in ("body", "html", "main"):
                words = set(_NAME_WORDS.findall(value))
                if not words.isdisjoint(_BOILER_WORDS):
                    boiler = HARD
                elif not inside_main and not main and not words.isdisjoint(_OUTER_WORDS) and words.isdisjoint(_MAIN_WORDS):
                    boiler = max(boiler, SOFT)
                if tag in ("div", "section", "td") and not words.isdisjoint(_MAIN_WORDS):
                    main = max(main, NAMED)
            elif name == "role":
                boiler = HARD if value in _BOILER_ROLES else boiler
                main = MARKED if value == "main" else max(main, NAMED) if value == "article" else main
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
                boiler = HARD
    return boiler, 0 if boiler else main


def blocks(page: str) -> list[Block]:
    """The page's blocks in order, with decoded and normalised text; empty ones are left out."""
    out: list[Block] = []
    stack: list[tuple[str, int, int, int]] = []  # element, boilerplate, content, region
    regions = 0
    links, now = 0, Block("", 0, 0, 0)

    def add(text: str) -> None:
        if text:
            now.pieces.append(text)
            if links:
                now.linked += len(text)

    def cut(tag: str) -> Block:
        if now.pieces:
            now.text = _SPACES.sub(" ", references.unescape("".join(now.pieces))).strip()
            if now.text:
                out.append(now)
        top = stack[-1] if stack else ("", 0, 0, 0)
        return Block(tag, top[1], top[2], top[3])

    def pop(depth: int) -> None:
        nonlocal links
        links -= sum(s[0] == "a" for s in stack[depth:])
        del stack[depth:]

    at, n = 0, len(page)
    while at < n:
        m = _MARK.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.start()
        if m[0] == "<!--":
            end = page.find("-->", at + 4)
            at = n if end < 0 else end + 3
            continue
        if page[at + 1] in "!?":
            end = page.find(">", at)
            at = n if end < 0 else end + 1
            continue
        t = _TAG.match(page, at) or _LOOSE.match(page, at)
        if not t:
            if page.find(">", at) < 0:
                break  # a tag that the end of the page cuts off
            add("<")
            at += 1
            continue
        at, tag = t.end(), t[2].lower()
        if t[1]:
            if tag in _BLOCK:
                now_at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
                if now_at >= 0:
                    cut(tag)
                    pop(now_at)
                    now = Block(stack[-1][0], *stack[-1][1:]) if stack else Block("", 0, 0, 0)
                else:
                    now = cut(tag)
            else:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        inner = stack[i][1]
                        outer = stack[i - 1] if i else ("", 0, 0, 0)
                        if inner != outer[1]:
                            cut(tag)
                        pop(i)
                        if inner != outer[1]:
                            now = Block(*outer)
                        break
                    if stack[i][0] in _BLOCK:
                        break
            continue
        if tag in _RAW:
            if not t[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if tag == "br":
            add(" ")
            continue
        top = stack[-1] if stack else ("", 0, 0, 0)
        if tag in _BLOCK:
            for i in range(len(stack) - 1, -1, -1):  # a paragraph ends where a block begins, a list item where the next one begins
                if stack[i][0] == "p" or (tag == "li" and stack[i][0] == "li"):
                    now = cut(tag)
                    pop(i)
                    break
                if stack[i][0] in _BLOCK:
                    break
            top = stack[-1] if stack else ("", 0, 0, 0)
        boiler, main = _hints(tag, t[3], top[2])
        region = top[3]
        if main > top[2]:
            regions += 1
            region = regions
        outer = 0 if main and top[1] == SOFT else top[1]
        boiler = max(outer, boiler)
        entry = (tag, boiler, 0 if boiler else max(top[2], main), region)
        if tag in _BLOCK:
            now = cut(tag)
            if tag not in _VOID:
                stack.append(entry)
            now.boiler, now.main, now.region = entry[1:]
        elif tag not in _VOID:
            if entry[1] != top[1]:  # an inline advert and the like is a block of its own
                now = cut(tag)
                now.boiler, now.main, now.region = entry[1:]
            stack.append(entry)
            links += tag == "a"
    cut("")
    return out


def classify(found: list[Block], stub: int = 15, short: int = 70, long: int = 200, low: float = 0.12, high: float = 0.28, links: float = 0.4) -> None:
    """Pass one: good, bad, near (rather good) or short (ambiguous)."""
    for b in found:
        size = len(b.text)
        density = min(1.0, b.linked / max(1, size))
        if b.boiler:
            b.verdict, b.rule = "bad", "container"
        elif density > links and (b.main < MARKED or b.tag == "li" or (density > 0.9 and size < short)):
            b.verdict, b.rule = "bad", "link density"
        elif not b.main and "©" in b.text[:200] and size < long:
            b.verdict, b.rule = "bad", "copyright sign"
        elif size < short:
            b.verdict = "short"
        else:
            words = _WORD.findall(b.text.lower())
            stop = sum(w in STOP_WORDS for w in words) / max(1, len(words))
            # in an article the middling density that is rather good elsewhere is enough
            if size >= long and stop >= (low if b.main == MARKED else high):
                b.verdict, b.rule = "good", "stop-word density"
            elif stop >= low:
                b.verdict = "near"
            elif b.main:
                b.verdict = "short"
            else:
                b.verdict, b.rule = "bad", "stop-word density"
        if b.verdict == "short" and b.main == MARKED and (size >= stub or b.tag in _HEADINGS):
            b.verdict = "near"


def inherit(found: list[Block]) -> None:
    """Pass two: ambiguous blocks take the label of their nearest decided neighbour of the same region.

    With decided neighbours on both sides that differ, the nearer one counts (the good one for rather good blocks and those of content
    regions). Without a good one, an article's blocks are good unless they are stubs beside a bad one; without any, a block
    of a content region is good, a rather good one too, and any other is bad.
    """
    n = len(found)
    label = {"good": "good", "kept": "good", "bad": "bad", "dropped": "bad"}
    for kind in ("near", "short"):  # rather good blocks first, so that short ones between them find a neighbour
        sides: list[list[tuple[int, str]]] = [[] for _ in found]
        for order in (range(n), range(n - 1, -1, -1)):
            last: dict[int, tuple[int, str]] = {}
            for i in order:
                b = found[i]
                if b.region in last:
                    sides[i].append(last[b.region])
                # what stands in a menu or an advert says nothing about the text beside it
                if b.verdict in label and not b.boiler:
                    last[b.region] = (i, label[b.verdict])
        for i, b in enumerate(found):
            if b.verdict != kind:
                continue
            b.rule = "neighbours"
            if any(s[1] == "good" for s in sides[i]) and (b.main or kind == "near"):
                good = True
            elif b.main == MARKED and kind == "near":
                good, b.rule = True, "container"
            elif not sides[i]:
                good, b.rule = bool(b.main) or kind == "near", "no neighbours"
            elif b.main or kind == "near":
                good = False
            else:
                good = min(sides[i], key=lambda s: (abs(s[0] - i), s[1] != "good"))[1] == "good"
            b.verdict = "kept" if good else "dropped"


def judged(page: str | None) -> list[Block]:
    """The page's blocks with verdict and the rule that gave it."""
    if not page:
        return []
    found = blocks(page)
    if any(b.main == MARKED for b in found):  # the page marks its content itself: what lies outside is not the article
        for b in found:
            b.boiler = b.boiler if b.main else HARD
    classify(found)
    inherit(found)
    return found


def main_text(page: str | None) -> str:
    """The page's main text: kept blocks in page order, one a line."""
    return "\n".join(b.text for b in judged(page) if b.verdict in ("good", "kept"))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) for each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[key, url, "text", "n_chars"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, url, F.col(html)).mapInArrow(run, f"`{key}` {kind}, `{url}` string, text string, n_chars long")
