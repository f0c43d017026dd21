import random
import re
from html.parser import HTMLParser

import pytest

from tidemark.llm import html

PAGES = [
    ("<article><h1>Title</h1><p>Some  text&nbsp;here &amp; there.</p></article><footer>bye</footer>", "Title\nSome text here & there."),
    ("<body><nav><a href='/x'>Home</a></nav><main><p>One<br>two</p></main><aside>no</aside></body>", "One two"),
    ("<div class='ad'>buy</div><article><p>A <b>bold</b> word<p>B</article><div id=comments><p>me too</p></div>", "A bold word\nB"),
    ("<script>var t='</p><p>no</p>';</script><article>x<!-- no --><style>p{}</style>y</article>", "x\ny"),
    (None, ""),
    ("", ""),
    ("<article>", ""),
    ("<article><p title=it's>one</p><p data-x='a>b' class=\"c>d\">two</p><p title=\"open>three</p></article>", "one\ntwo\nthree"),
    ("<article>" + "<div>" * 3000 + "deep" + "</b>" * 3000 + "</div>" * 2999 + "<p>last", "deep\nlast"),
    ("plain text without any tag", "plain text without any tag"),
    ("<article><form><p>name</p></form><p>kept &lt;b&gt; &#233;</p></article>", "kept <b> é"),
]


@pytest.mark.parametrize("page, want", PAGES)
def test_main_text(page, want):
    assert html.main_text(page) == want


COMMON = [
    ('<div style="overflow:hidden"><article><p>kept</p></article></div>', "kept"),
    ('<html class="fixed-header"><body class="has-sidebar menu"><article class="post category-social"><p>kept</p></article></body></html>', "kept"),
    ('<body style="visibility: hidden"><main id="main" class="widget"><p>kept</p></main></body>', "kept"),
    ('<div class="layout with-sidebar overflow-hidden" data-state="hidden" title="display:none"><p>kept</p></div>', "kept"),
    ('<article><p>kept</p><p hidden>no</p><p hidden="">no</p><p style="color:red; visibility:hidden">no</p><p style=display:none>no</p><p aria-hidden=true>no</p></article>', "kept"),
    ('<article><p>kept</p><div class="Site-Footer">no</div><div id="comments">no</div><div class="x ad-slot-3">no</div><ul class="post__sharing">no</ul></article>', "kept"),
    ('<div class="site-header">no</div><div role="navigation">no</div><div class="cookie-banner">no</div><article>kept</article>', "kept"),
    ('<article><p a="' + "x=" * 50_000 + ">kept</p>", "kept"),
]


@pytest.mark.parametrize("page, want", COMMON)
def test_common_markup(page, want):
    assert html.main_text(page) == want


RUSSIAN = "Вчера вечером в городе открылась новая библиотека, и жители пришли посмотреть на книги, которые собирали много лет. Они остались довольны."
PROSE = "It was the best of the times and it was the worst of the times, as it is said by the one who was there in the end. "


def test_other_languages_and_scripts():
    pages = [RUSSIAN, "これは長い文章です。" * 12, "Kaupungissa avattiin eilen uusi kirjasto jonne saapui satoja asukkaita katsomaan kirjoja, joita kerättiin vuosikausia ympäri maata ja ulkomailta saakka."]
    for text in pages:
        menu = "".join(f"<li><a href=/{i}>{text[:40]}</a></li>" for i in range(4))
        assert html.main_text(f"<body><ul>{menu}</ul><p>{text}</p><p>{text}</p></body>") == f"{text}\n{text}"


def test_a_teaser_is_not_the_article():
    text = (PROSE * 4).strip()
    page = f"<body><div><p>{text}</p><p>{text}</p></div><article><p>Read this next, it is good.</p></article></body>"
    assert html.main_text(page).split("\n")[:2] == [text, text]
    page = f"<body><div><p>{text}</p></div><article><p>{text}</p></article></body>"
    assert html.main_text(page) == text


def brute(page):
    """The rules again, block by block from their definitions: each block in doubt looks at all others."""
    found = [b for b in html.blocks_of(page) if b[0] != html.OUT]

    def label(blocks, i, article):
        _, text, linked = blocks[i]
        words = [w for b in blocks for w in re.findall(r"[^\W\d_]+", b[1].lower())]
        foreign = len(words) >= html.TELLING and sum(w in html.STOP_WORDS for w in words) < html.KNOWN * len(words)
        is_link = lambda k: 0 <= k < len(blocks) and blocks[k][2] > html.LINKED * len(blocks[k][1])
        if is_link(i):
            return None if article and len(text) < html.SHORT and not is_link(i - 1) and not is_link(i + 1) else False
        if len(text) < html.SHORT:
            return None
        own = re.findall(r"[^\W\d_]+", text.lower())
        dense = sum(w in html.STOP_WORDS for w in own) / len(own) if own else 0
        if foreign or dense >= html.DENSE or (dense >= html.SPARSE and (article or len(text) >= html.LONG)):
            return True
        return None if article or dense >= html.SPARSE else False

    article, rest = [b for b in found if b[0] == html.ARTICLE], [b for b in found if b[0] == html.BODY]
    sure = sum(len(b[1]) for i, b in enumerate(rest) if label(rest, i, False))
    teaser = article and sure > html.MASS * sum(len(b[1]) for b in article)
    own = found if teaser or not article else article
    labels = [label(own, i, bool(article) and not teaser) for i in range(len(own))]
    kept = []
    for i, (_, text, _) in enumerate(own):
        if labels[i] is None:
            decided = [(abs(k - i), not x) for k, x in enumerate(labels) if x is not None]
            if decided and min(decided)[1]:
                continue
        elif not labels[i]:
            continue
        kept.append(text)
    return "\n".join(kept)


def test_rules_against_brute_force():
    random.seed(4)
    texts = ["Menu", "A heading", PROSE, PROSE * 3, RUSSIAN, "x1 y2 z3 " * 12, "and the of " * 9, "Name Surname " * 8]
    for _ in range(400):
        parts = []
        for _ in range(random.randrange(9)):
            text, tag = random.choice(texts), random.choice(["p", "p", "div", "li", "article", "aside", "main"])
            text = f"<a href=/>{text}</a>" if random.random() < 0.3 else text
            parts.append(f"<{tag}>{text}</{tag}>")
        page = f"<body>{''.join(parts)}</body>"
        assert html.main_text(page) == brute(page), page


def test_short_blocks_follow_their_neighbours():
    long = "It was the best of the times and it was the worst of the times, as it is said by the one who was there in the end. " * 3
    page = f"<body><p>Menu one</p><ul>{'<li><a href=/>a link of some length here</a></li>' * 4}</ul><h2>Heading</h2><p>{long}</p><p>Short.</p><p>{long}</p></body>"
    assert html.main_text(page) == "\n".join(["Heading", long.strip(), "Short.", long.strip()])


def test_pages(spark):
    rows = [(i, p, "clash") for i, (p, _) in enumerate(PAGES)] + [(0, PAGES[0][0], None), (None, "<p>" * 50_000 + "x", None)]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = html.extract(pages).collect()
    assert len(got) == len(rows)
    assert all(r.text == PAGES[r.id][1] for r in got if r.id is not None)
    assert html.extract(pages.limit(0)).collect() == []


LONG_PROSE = (PROSE * 3).strip()
BAD = ["reader-comments", "user-comments", "comment-thread", "comments", "post-comments", "CommentList", "disqus_thread", "related-posts", "related-articles", "article-share", "story-newsletter", "site-footer", "ad-slot-3", "cookie-banner", "reader_comments_2"]
FINE = ["has-comments", "no-sidebar", "comments-open", "category-social", "with-related", "tag-advert", "commentary", "content", "lead", "adventure-story"]


@pytest.mark.parametrize("name", BAD)
def test_bad_names(name):
    for attribute in ("class", "id"):
        bad = f'<div {attribute}="{name}"><p>{LONG_PROSE} And nobody said so.</p></div>'
        assert html.main_text(f"<body><article><p>{LONG_PROSE}</p>{bad}</article></body>") == LONG_PROSE
        assert html.main_text(f"<body><main><article><p>{LONG_PROSE}</p></article>{bad}</main></body>") == LONG_PROSE
        assert html.main_text(f"<body><p>{LONG_PROSE}</p>{bad.replace('div', 'section')}</body>") == LONG_PROSE


@pytest.mark.parametrize("name", FINE)
def test_names_that_only_sound_bad(name):
    for page in (f'<body><article><div class="{name}"><p>{LONG_PROSE}</p></div></article></body>', f'<body><div class="{name}"><p>{LONG_PROSE}</p></div></body>'):
        assert html.main_text(page) == LONG_PROSE


def test_words_decide_in_articles_too():
    """Of two blocks as long and beside the same list of links the one with stop words stays, the other follows its neighbour."""
    links = "".join(f"<li><a href=/{i}>one more of the links</a></li>" for i in range(3))
    names = "Lorem Dolor Amet Tempor Magna Aliqua Veniam Nostrud Labore Cillum Fugiat Nulla Officia Mollit"
    page = f"<article><p>{LONG_PROSE}</p><p>%s</p><p>%s</p><ul>{links}</ul></article>"
    assert html.main_text(page % (names, names)) == f"{LONG_PROSE}\n{names}"
    assert html.main_text(page % (PROSE.strip(), PROSE.strip())) == "\n".join([LONG_PROSE, PROSE.strip(), PROSE.strip()])


class Reader(HTMLParser):
    """A second way to the blocks, for sound pages: the standard library's parser and a stack of places."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.text, self.linked, self.link, self.out = [html.BODY], "", 0, False, []

    def close_block(self):
        if text := " ".join(self.text.split()):
            self.out.append((self.stack[-1], text, self.linked))
        self.text, self.linked = "", 0

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.text += " "
        elif tag == "a":
            self.link = True
        elif tag not in ("b", "i", "span"):
            self.close_block()
            name, now = dict(attrs).get("class", ""), self.stack[-1]
            if now == html.OUT or tag in ("nav", "aside", "footer", "script", "form") or (tag not in ("article", "main") and name in ("comments", "ad", "related-posts", "reader-comments")):
                now = html.OUT
            elif tag in ("article", "main") or name == "post-content":
                now = html.ARTICLE
            self.stack.append(now)

    def handle_endtag(self, tag):
        if tag == "a":
            self.link = False
        elif tag not in ("b", "i", "span", "br"):
            self.close_block()
            self.stack.pop()

    def handle_data(self, data):
        self.text += data
        self.linked += len(data) * self.link


def test_blocks_against_a_second_parser():
    rng = random.Random(12)
    texts = ["A heading", PROSE, "caf&eacute; &amp; more &#8212; of it", "x &lt; y", RUSSIAN[:80], "  spaced \n out\t"]

    def element(depth):
        tag = rng.choice(["p", "div", "div", "section", "ul", "h2", "article", "aside", "nav", "footer", "main", "script"])
        name = rng.choice(["", "", "", ' class="comments"', " class='ad'", ' class="post-content"', ' class="related-posts"', ' class="reader-comments"', ' class="lead"'])
        if tag == "script":
            return "<script>var x = '</p><p>';</script>"
        if tag in ("p", "h2") or depth == 0:
            inner = rng.choice(texts)
            inner = rng.choice([inner, f"<b>{inner}</b> and <i>so</i> on", f'<a href="/x">{inner}</a>', f"{inner}<br>{inner}"])
        else:
            inner = "".join(element(depth - 1) for _ in range(rng.randrange(4)))
        return f"<{tag}{name}>{inner}</{tag}>"

    some_without = 0
    for _ in range(400):
        page = f"<body>{''.join(element(3) for _ in range(rng.randrange(1, 5)))}</body>"
        reader = Reader()
        reader.feed(page)
        reader.close()
        reader.close_block()
        kept = lambda blocks: [b[:2] for b in blocks if b[0] != html.OUT]
        assert kept(html.blocks_of(page)) == kept(reader.out), page
        some_without += "<article" not in page and "<main" not in page and "post-content" not in page
        assert html.main_text(page) == brute(page), page
    assert some_without > 50
