"""Flat text blocks of an HTML page, with the shallow features that tell main text from the rest."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

#: Elements whose content is no text of the page; what stands in the first ones is never markup.
RAW = frozenset("script style title textarea".split())
DROPPED = RAW | frozenset("noscript template svg iframe object select datalist audio video canvas annotation annotation-xml".split())
#: Elements that begin and end blocks.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot "
    "th thead tr ul".split()
)
#: Elements that stay open until closed and colour what they hold.
HOLDERS = frozenset("article aside blockquote body button details dialog div dl fieldset figure footer form header main menu nav ol section table ul".split())
BOILER_TAGS = frozenset("aside button dialog fieldset footer form menu nav".split())
#: What a class or id calls a part of the page that is no text of the article, alone or between the words below; and what it calls the article.
_BOILER_WORDS = (
    "ad|ads|adv|advert|adverts|advertisement|advertising|adsense|affiliate|banner|breadcrumbs?|byline-share|captcha|comments?|commentlist|consent|cookies?|copyright|"
    "disclaimer|disqus|footer|footnav|gdpr|header|headbar|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|notification|"
    "pager|pagination|popup|popular|promo|promoted|promotion|recommended|recommendations|related|replies|respond|rss|search|share|sharing|sidebar|side-bar|"
    "signup|sign-up|siteinfo|site-info|skiplink|skip-link|social|sponsor|sponsored|subscribe|subscription|teaser|toolbar|topbar|top-bar|trending|warningbar|widget"
)
_AROUND_BEFORE = r"(?:(?:site|page|main|global|top|bottom|left|right|article|post|entry|blog|cookie|user|reader|sub|primary|secondary|js)[_-])*+"
_AROUND_AFTER = r"(?:[_-](?:container|area|wrap|wrapper|box|list|section|bar|block|links?|form|inner|content|notice|banner|signup|menu|items?|widgets?|title|body|panel|modal|popup|text|buttons?|consent|posts?|articles?|nav|top|bottom|left|right|[0-9]+))*+"
BOILER_NAME = re.compile(rf"(?<!\S){_AROUND_BEFORE}(?:{_BOILER_WORDS}){_AROUND_AFTER}(?!\S)|(?<!\S)(?:{_BOILER_WORDS}){_AROUND_AFTER}(?!\S)")
MAIN_NAME = re.compile(r"(?<!\S)(?:article|article-?body|body-?text|content|entry|entry-?content|main|main-?content|post|post-?body|story|story-?body|text)(?!\S)")
BOILER_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?|[\"'])*+)>",
    re.S,
)
_NAME = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: What ends an option, whose own end tag may be left out.
_OPTION_END = re.compile(rf"</?(?:option|optgroup|datalist|select|{'|'.join(sorted(BLOCKS))})(?=[\s/>])", re.I)
_TAG_BEGIN = re.compile(r"</?[a-zA-Z]")
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

#: A notice of rights at the beginning of a block, or in it.
_RIGHTS = re.compile(r"^(?:©|\(c\)|copyright\b)|\ball rights reserved\b", re.I)

#: Its own words and share of linked words, those of the blocks beside it, and what its elements say of it.
FLAT = ("words", "links", "words_before", "links_before", "words_after", "links_after", "heading", "item", "rights")
FEATURES = (*FLAT, "in_main", "boiler_tag", "boiler_name")


@dataclass
class Block:
    """A run of text between block elements; links is the share of its words inside anchors."""

    text: str
    words: int
    links: float
    heading: bool
    item: bool
    in_main: bool
    boiler_tag: bool
    boiler_name: bool


def _colour(tag: str, rest: str, inside_main: bool) -> tuple[bool, bool, bool]:
    """(main, boiler tag, boiler name) that an element adds for what it holds."""
    names, role = "", ""
    for m in _NAME.finditer(rest):
        value = (m[2] or m[3] or m[4] or "").lower()
        if m[1].lower() == "role":
            role = value
        else:
            names += f" {value}"
    boiler_tag = tag in BOILER_TAGS or role in BOILER_ROLE or tag == "header" and not inside_main
    boiler_name = bool(names and BOILER_NAME.search(names))
    main = tag in ("article", "main") or role in ("main", "article") or bool(names and MAIN_NAME.search(names))
    return main and not boiler_name, boiler_tag, boiler_name


def _ends(page: str, tag: str) -> dict[int, int]:
    """Where it begins to where its end tag ends, for every element of the tag that is closed; comments and raw text hold none."""
    out, opened = {}, []
    raw = rf"<!--.*?(?:-->|\Z)|<({'|'.join(sorted(RAW))})(?=[\s>])[^>]*(?<!/)>.*?(?:</\1(?=[\s/>])|\Z)"
    for m in re.finditer(rf"{raw}|<(/?){re.escape(tag)}(?=[\s/>])[^>]*>?", page, re.I | re.S):
        if m[2] is None:
            continue
        if not m[2]:
            if not m[0].endswith("/>"):
                opened.append(m.start())
        elif opened:
            out[opened.pop()] = m.end()
    return out


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in page order: references decoded, white space collapsed, no block empty."""
    out: list[Block] = []
    held: list[tuple[str, bool, bool, bool]] = [("", False, False, False)]  # tag and colours so far
    own = ("", (False, False, False))  # the latest block element that holds no others
    parts: list[str] = []
    linked: list[str] = []
    in_link = 0
    at, size = 0, len(page)
    ends: dict[str, dict[int, int]] = {}

    def text(raw: str) -> None:
        if raw:
            raw = html.unescape(raw) if "&" in raw else raw
            parts.append(raw)
            if in_link:
                linked.append(raw)

    def end() -> None:
        nonlocal parts, linked
        words = "".join(parts).split()
        if words:
            tag, (main, boiler_tag, boiler_name) = own
            _, m, t, n = held[-1]
            out.append(Block(
                " ".join(words), len(words), min(1.0, len(" ".join(linked).split()) / len(words)), tag in _HEADINGS, tag in ("li", "dt", "dd", "td", "th", "option"),
                m or main, t or boiler_tag, n or boiler_name,
            ))
        parts, linked = [], []

    for token in _TOKEN.finditer(page):
        if token.start() < at:
            continue
        text(page[at : token.start()])
        at = token.end()
        tag = token["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if token["close"]:
            if tag == "a":
                in_link = max(0, in_link - 1)
            elif tag in BLOCKS:
                end()
                own = ("", (False, False, False))
                if tag in HOLDERS and any(h[0] == tag for h in held):
                    while held.pop()[0] != tag:
                        pass
                    in_link = 0
        elif tag in DROPPED:
            if token["rest"].rstrip().endswith("/"):
                continue
            if tag not in RAW:
                # one that is not closed loses its tag only
                if tag not in ends:
                    ends[tag] = _ends(page, tag)
                at = ends[tag].get(token.start(), at)
            else:
                close = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
                at = page.find(">", close.start()) + 1 or size if close else size
        elif tag == "option":
            stop = _OPTION_END.search(page, at)
            at = stop.start() if stop else size
        elif tag == "a":
            in_link = 1
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCKS:
            end()
            colour = _colour(tag, token["rest"], held[-1][1])
            if tag in HOLDERS:
                _, m, t, n = held[-1]
                held.append((tag, m or colour[0], t or colour[1], n or colour[2]))
                own = ("", (False, False, False))
            else:
                own = (tag, colour)
    # a tag that the page's end cuts off is no text
    cut = _TAG_BEGIN.search(page, max(at, page.rfind(">") + 1))
    text(page[at : cut.start() if cut else size])
    end()
    return out


def features(page: list[Block]) -> list[list[float]]:
    """FEATURES of each block; there are no words before the first block and behind the last."""
    out = []
    for k, b in enumerate(page):
        before, after = (page[k - 1] if k else None), (page[k + 1] if k + 1 < len(page) else None)
        out.append([
            b.words, b.links, before.words if before else 0, before.links if before else 0.0, after.words if after else 0, after.links if after else 0.0,
            b.heading, b.item, bool(_RIGHTS.search(b.text)), b.in_main, b.boiler_tag, b.boiler_name,
        ])
    return [[float(x) for x in row] for row in out]
