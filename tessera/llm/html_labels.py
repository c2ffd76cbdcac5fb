"""The small labelled table that the block classifier learns from: pages and one letter a block.

``y`` is main text, ``n`` everything else. ``~12`` stands for sentences of twelve words. The first pages are written by
hand. The others are built from layouts without telling elements or classes, where only a block's words and links and
those of the blocks beside it say what it is.
"""

from __future__ import annotations

import random
import re

_WORDS = (
    "the river had carried silt down to the delta for years before anyone thought of measuring how much of it stayed and "
    "how much went out to sea with the tide so the engineers who came later found maps of little use when they planned a dam"
).split()


def _filled(page: str) -> str:
    return re.sub(r"~(\d+)", lambda m: " ".join(_WORDS[k % len(_WORDS)] for k in range(int(m[1]))).capitalize() + ".", page)


_PAGES = (
    # news article with semantic elements
    ("<header><a href=/>Daily Paper</a></header><nav><ul><li><a href=1>Home</a><li><a href=2>World</a><li><a href=3>Sport</a></ul></nav>"
     "<article><h1>~6</h1><p>~30</p><p>~45</p><h2>~4</h2><p>~12</p><p>~5</p></article><footer>&copy; 2020 ~8</footer>", "nnnn yyyyyy n"),
    ("<nav><a href=1>Start</a> <a href=2>About us</a></nav><div class=ad>~12</div><article><h1>~9</h1><p>~9<br><p>~40</p><p>~3</p></article><footer>~14</footer>", "nn yyyy n"),
    ("<nav><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul></nav><div class='ad'>~20</div><article><h1>~5</h1><p><b>~60<br></article><footer>~20</footer>", "nnn yy n"),
    # blog with divs, sidebar, comments, sharing
    ("<div id=header><h1><a href=/>My blog</a></h1><p>~5</p></div><div id=content><div class=post><h2>~7</h2><p>~25</p><p>~60</p><p>~7</p><ul><li>~8</li><li>~6</li></ul></div>"
     "<div class=share-bar><a href=x>Share</a> <a href=y>Tweet</a></div><div id=comments><h3>3 comments</h3><p>~20</p><p>~34</p><p>~5</p></div></div>"
     "<div id=sidebar><h3>About me</h3><p>~22</p><ul><li><a href=1>~3</a></li><li><a href=2>~5</a></li></ul></div><div id=footer>~9</div>", "nn yyyyyy n nnnn nnnn n"),
    # no classes at all
    ("<body><p><a href=1>Home</a> | <a href=2>News</a> | <a href=3>Mail</a></p><h1>~5</h1><p>~33</p><p>~28</p><p>~50</p><p>Copyright 2001</p></body>", "n yyyy n"),
    ("<body><h1>~4</h1><p>~40</p><p>~22</p><p>~18</p></body>", "yyyy"),
    ("<p>~35</p><p>~20</p>", "yy"),
    ("<p>~14</p>", "y"),
    ("<div>~60</div><div>~30</div>", "yy"),
    # shop page with cookie notice, form, related items
    ("<div class='cookie-notice'><p>~30</p><button>Accept</button></div><main><h1>~4</h1><p>~26</p><p>~15</p><form action=/buy><label>Amount</label><p>~6</p><button>Buy now</button></form>"
     "<section class=related><h2>~3</h2><p>~12</p><p>~9</p></section></main><aside><h3>~3</h3><p>~40</p></aside><footer><p>~25</p><p><a href=1>Terms</a> <a href=2>Privacy</a></p></footer>", "nn yyy nnn nnn nn nn"),
    # forum thread whose first post is the text
    ("<div class=navbar><a href=1>Forum</a></div><div class=breadcrumb><a href=1>A</a> &gt; <a href=2>B</a></div><div class=entry-content><p>~44</p><p>~12</p></div><section class=replies><p>~33</p><p>~15</p></section>", "nn yy nn"),
    # article with header and footer of its own, with an aside in it
    ("<article><header><h1>~8</h1></header><p>~38</p><aside><p>~18</p></aside><p>~29</p><blockquote><p>~16</p></blockquote><footer><p>~7</p></footer></article>", "yy n yy n"),
    # list article
    ("<main><h1>~5</h1><ol><li>~14</li><li>~22</li><li>~9</li></ol><p>~11</p></main><nav><ol><li><a href=1>Older posts</a></li></ol></nav>", "yyyyy n"),
    # table of data in the text
    ("<article><h2>~4</h2><table><tr><td>Year</td><td>Height</td></tr><tr><td>1990</td><td>4 metres</td></tr></table><p>~24</p></article><div class=advertisement><p>~25</p></div>", "yyyyyy n"),
    # very short paragraphs and linked ones inside the text
    ("<article><h1>~2</h1><p>~60</p><p>~1</p><p>~70</p><p>~2</p><p>~3</p></article><p>&copy; ~2</p>", "yyyyyy n"),
    ("<main><p>~80</p><p>~2</p><p>~1</p><p>~55</p></main><p>Copyright ~1</p>", "yyyy n"),
    ("<div class=content><p>~64</p><p>~1</p><p>~2</p></div><div><p>All rights reserved</p></div>", "yyy n"),
    ("<article><p>~30</p><p><a href=1>~8</a></p><p>~20</p><ul><li><a href=2>~5</a></li><li><a href=3>~2</a></li></ul></article><p><a href=4>~5</a></p>", "yyyyy n"),
    ("<article><p>~120</p><p>~1</p><p>~1</p><p>~90</p><p>~1</p></article>", "yyyyy"),
    ("<p>~70</p><p>~2</p><p>~66</p><p>~1</p>", "yyyy"),
    ("<p>~40</p><p>~1</p><p>~40</p>", "yyy"),
    # what an article says of rights, and links in it, are its text
    ("<article><h1>~4</h1><p>~33</p><p>All rights reserved.</p><p>~21</p></article><footer>All rights reserved</footer>", "yyyy n"),
    ("<article><p>~25</p><p>All rights reserved.</p></article><p>Copyright ~2</p>", "yy n"),
    ("<main><p>Copyright ~9</p><p>~1</p></main><div class=ad>~9</div>", "yy n"),
    ("<article><p>&copy; ~4</p><p>All rights reserved. ~3</p><p>~60</p></article>", "yyy"),
    ("<article><h1><a href=1>~5</a></h1><p><a href=2>~3</a></p><p><a href=3>~2</a></p><p>~9</p></article>", "yyyy"),
    ("<main><ul><li><a href=1>~3</a></li><li><a href=2>~2</a></li><li><a href=3>~6</a></li></ul></main>", "yyy"),
    ("<article><p>~3</p><p><a href=1>~1</a></p></article><p><a href=1>~1</a></p>", "yy n"),
    ("<article><p>~2</p></article>", "y"),
    ("<article><p>~12</p><p><a href=1>~3</a></p><p>~2</p></article>", "yyy"),
    ("<main><p><a href=1>~3</a> ~2</p><p>~1</p></main>", "yy"),
    ("<article><p>~20</p><p>All rights reserved.</p></article>", "yy"),
    ("<article><h2>~2</h2><p>&copy; ~3</p></article>", "yy"),
    ("<nav><p>~30</p></nav><article><p>~1</p></article><aside><p>~30</p></aside>", "n y n"),
    ("<article><section class=social-history><h2>~3</h2><p>~40</p></section><p>~22</p></article>", "yyy"),
    # link lists and long link texts outside the text
    ("<div class=menu><p><a href=1>~12</a></p><p><a href=2>~15</a></p></div><div class=story><p>~31 <a href=3>~3</a> ~10</p><p><a href=4>~6</a> ~21</p></div><ul><li><a href=5>~9</a></li><li><a href=6>~11</a></li></ul>", "nn yy nn"),
    ("<p><a href=1>~4</a></p><p><a href=1>~8</a></p><p>~42</p><p>~38</p><p><a href=1>~5</a></p><p><a href=1>~3</a></p>", "nn yy nn"),
    ("<p><a href=1>Top</a></p><h2>~6</h2><p>~24</p><h2>~3</h2><p>~19</p><p><a href=2>Next page</a></p>", "n yyyy n"),
    # long boilerplate and short text
    ("<div class=banner><p>~50</p></div><article><p>~4</p><p>~8</p></article><div class=newsletter-signup><p>~45</p></div><div class='site-info disclaimer'><p>~90</p></div>", "n yy nn"),
    ("<section role=navigation><p>~20</p></section><div role=main><p>~6</p><h3>~2</h3><p>~17</p></div><div role=contentinfo><p>~30</p></div>", "n yyy n"),
    ("<form><p>~14</p><p>~26</p></form><div id=main-content><h1>~2</h1><p>~3</p><p>~70</p></div><div class='widget popular'><ul><li>~4</li><li>~10</li></ul></div>", "nn yyy nn"),
    ("<header><p>~18</p><h1>~4</h1></header><p>~36</p><p>~41</p><footer><ul><li>~6</li></ul></footer>", "nn yy n"),
    ("<article><h1>~3</h1><p>~2</p></article><article class=comment><p>~40</p></article><article class=comment><p>~6</p></article>", "yy nn"),
    ("<div class=notice><p>~16</p></div><div class=text><p>~1</p><p>~52</p></div><div class='comments-area'><p>~52</p><p>~1</p></div>", "n yy nn"),
    ("<dialog><p>~33</p></dialog><main><article><p>~10</p></article></main><aside class=sidebar><p>~64</p></aside>", "n y n"),
)



#: Ways to write three kinds of blocks: lists of links, running text, what follows it.
_MENUS = (
    lambda links: "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>",
    lambda links: "".join(f"<p>{x}</p>" for x in links),
    lambda links: "<table><tr>" + "".join(f"<td>{x}</td>" for x in links) + "</tr></table>",
    lambda links: "".join(f"<div>{x}</div>" for x in links),
)
_TEXTS = (("p", "h2"), ("div", "h3"), ("p", "p"), ("li", "h2"))


def _page(rng: random.Random, menu: int, text: int, end: int) -> tuple[str, str]:
    """A page without telling elements or classes, and its labels."""
    link = lambda n: f"<a href=x>~{n}</a>"
    links = lambda: [link(rng.randint(1, 4)) for _ in range(rng.randint(3, 7))]
    body, heading = _TEXTS[text]
    html, letters = "", ""

    def add(part: str, label: str) -> None:
        nonlocal html, letters
        html, letters = html + part, letters + label

    def menu_with_title(of: list[str]) -> None:
        add(f"<p>~{rng.randint(1, 3)}</p>" + _MENUS[menu](of), "n" * (1 + len(of)))

    top = links()
    menu_with_title(top) if rng.random() < 0.5 else add(_MENUS[menu](top), "n" * len(top))
    if rng.random() < 0.3:  # a word between two menus
        add(f"<p>~{rng.randint(1, 3)}</p>", "n")
        more = links()
        add(_MENUS[menu](more), "n" * len(more))
    add(f"<h1>~{rng.randint(3, 9)}</h1>", "y")
    for k in range(rng.randint(3, 7)):
        if k and rng.random() < 0.3:
            add(f"<{heading}>~{rng.randint(1, 5)}</{heading}>", "y")
        add(f"<{body}>~{rng.randint(18, 90)}</{body}>", "y")
        if rng.random() < 0.35:  # short paragraphs and linked ones between long ones
            add(f"<{body}>~{rng.randint(1, 5)}</{body}>" if rng.random() < 0.7 else f"<{body}>{link(rng.randint(3, 7))}</{body}>", "y")
            add(f"<{body}>~{rng.randint(20, 60)}</{body}>", "y")
    if rng.random() < 0.3:
        add(f"<{body}>~{rng.randint(1, 5)}</{body}>", "y")
    if end == 1:
        add(f"<p>&copy; {rng.randint(1999, 2024)} ~{rng.randint(1, 9)}</p>", "n")
    elif end == 2:
        menu_with_title(links())
        add(f"<p>~{rng.randint(1, 4)}</p>", "n")
    elif end == 3:
        of = links()
        add(_MENUS[menu](of), "n" * len(of))
        add(f"<p>Copyright ~{rng.randint(1, 6)}, all rights reserved</p>", "n")
    return html, letters


def plain_pages(seed: int) -> list[tuple[str, str]]:
    """A page of each layout: 4 kinds of menus, 4 of texts, 4 of ends."""
    rng = random.Random(seed)
    return [_page(rng, menu, text, end) for menu in range(4) for text in range(4) for end in range(4)]


def article_pages(seed: int, number: int = 16) -> list[tuple[str, str]]:
    """Pages whose article is told by its element: any block in it is text, with links or without, short or long."""
    rng, out = random.Random(seed), []
    for k in range(number):
        tag, html, letters = ("article", "main")[k % 2], "", ""
        for _ in range(rng.randint(1, 9)):
            n, m = rng.choice((0, 0, 2, 20, 60)), rng.choice((0, 1, 2, 5))
            html += f"<p>{f'~{n}' if n else ''} {f'<a href=x>~{m}</a>' if m or not n else ''}</p>".replace("~0", "~1")
            letters += "y"
        out.append((f"<nav><p><a href=x>~{rng.randint(1, 3)}</a></p></nav><{tag}>{html}</{tag}><footer><p>~{rng.randint(1, 30)}</p></footer>", f"n{letters}n"))
    return out


HAND = tuple((_filled(page), labels.replace(" ", "")) for page, labels in _PAGES)
#: Those written by hand weigh three times as much.
PAGES = (*HAND, *HAND, *HAND, *((_filled(page), labels) for page, labels in (*plain_pages(1), *article_pages(1))))
#: As many that are not trained on.
HELD_OUT = tuple((_filled(page), labels) for page, labels in (*plain_pages(2), *article_pages(2)))
