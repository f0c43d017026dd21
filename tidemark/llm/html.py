"""Main text of HTML pages by two passes of block rules.

A page is cut into blocks at block-level tags. Pass one decides what it can from a block alone: its place (menus,
forms, adverts, comments ... are boilerplate; the article element or an element named as content is the article),
its link density, its length and its density of stop words. Pass two gives each block in doubt (short ones, and in an
article those with few stop words) the label of the nearest decided neighbours in the same part of the page. Kept blocks
are joined in page order.

Where the text outside the article that pass one is sure of is more than MASS times the article's, the article is taken
for a teaser, and the whole page but its boilerplate is judged. Where hardly any word of a page is one of the stop
words (KNOWN), its language is none of theirs: length and link density then decide alone.

A null or empty page has the empty text, an empty table an empty result. Broken markup is read as browsers read it: what
isn't closed stays open. A block as near to a kept neighbour as to a dropped one (a tie) is kept. Pages are independent: no
shuffle, repeated rows repeat their result, a page of any length is read whole. The operator reads the id and html
columns only, so other columns may have any name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, text_chunks

# Frequent function words of the four languages.
STOP_WORDS = frozenset(
    """
    a an and are as at be by for from has he in is it its not of on or that the this to was were will with
    au aux avec ce ces dans de des du elle en est et il la le les mais ne ou par pas pour que qui sa se ses sur un une
    als auch auf aus bei das dem den der die ein eine er es im ist mit nicht oder sich sie sind und von war zu
    al con del el ella esta este las lo los más no para pero por su sus una y como más
    """.split()
)

SHORT, LONG, DENSE, SPARSE, LINKED = 70, 200, 0.3, 0.15, 0.5

#: The least share of stop words in a page of one of their languages, and words that tell.
KNOWN, TELLING = 0.1, 20

#: How much more text there is outside of an article that is but a teaser.
MASS = 3

GONE = frozenset("script style noscript template iframe object svg math canvas head title textarea select option button".split())
RAW = frozenset("script style noscript template iframe svg title textarea".split())
BAD_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
GOOD_TAGS = frozenset("article main".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BAD_NAMES = frozenset(
    """
    ad ads adv advert adverts advertisement advertisements banner sponsor sponsored promo promotion cookie cookies
    consent gdpr notice notices alert sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer
    comment comments respond disqus share sharing social related recommended newsletter subscribe subscription popup
    modal overlay widget widgets toolbar pagination pager login signup copyright legal disclaimer skip masthead
    """.split()
)
GOOD_NAMES = frozenset("article articlebody content entry main post story".split())

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*)(?:>|\Z)""",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
NAMING = frozenset("class id role itemprop".split())
UNSEEN = re.compile(r"(?<![\w-])(?:display\s*:\s*none|visibility\s*:\s*hidden)(?![\w-])", re.IGNORECASE)
PART = re.compile(r"[a-z0-9]+")

# Words that say where or how an element stands, not what it is. A name like site-footer or ad-slot is bad
# as a whole; has-sidebar, category-social or overflow-hidden says something else.
STANDING = frozenset(
    """
    site page global top bottom left right primary secondary inner outer wrap wrapper container box bar list section area
    block link links item items form slot unit banner post posts entry article articles story stories blog main header
    reader readers user users visitor thread area
    """.split()
)
#: Names of comments, whatever else a token says.
ALWAYS = frozenset("comment comments commentlist commenter commenters disqus respond".split())
#: Words that make a token a remark about a page or a topic, not the name of a part.
REMARKS = frozenset("has have with without no not is are open closed enabled disabled free category tag topic format".split())
#: Elements that hold the text whatever their names are.
HOLDERS = frozenset("html body main article".split())

OUT, BODY, ARTICLE = 0, 1, 2


def is_bad(token: str, now: int) -> bool:
    """Whether a whole class token, id or role names boilerplate: comments anywhere in it, a bad name at its end, or one with nothing else but words of standing or numbers."""
    parts = PART.findall(token)
    if not any(p in BAD_NAMES or p in ALWAYS for p in parts) and not ("header" in parts and now != ARTICLE):
        return False
    if any(p in REMARKS for p in parts):
        return False
    names = [p for p in parts if not p.isdigit()]
    if any(p in ALWAYS for p in parts) or (names and names[-1] in BAD_NAMES):
        return True
    return all(p in BAD_NAMES or p in STANDING or any(c.isdigit() for c in p) for p in parts)


def place_of(tag: str, attributes: str, now: int) -> int:
    """The part of the page that an element is in, given the part around it."""
    if now == OUT or tag in BAD_TAGS or tag in GONE or (tag == "header" and now != ARTICLE):
        return OUT
    if attributes and not attributes.isspace():
        tokens: list[str] = []
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in NAMING:
                tokens += value.lower().split()
            elif tag not in ("html", "body") and (name == "hidden" or (name == "style" and UNSEEN.search(value)) or (name == "aria-hidden" and value.strip().lower() == "true")):
                return OUT  # scripts show what hides a whole page
        if tag not in HOLDERS and any(is_bad(t, now) for t in tokens):
            return OUT
        if tag in BLOCKS and tag not in ("html", "body") and any(p in GOOD_NAMES for t in tokens for p in PART.findall(t)):
            return ARTICLE
    return ARTICLE if tag in GOOD_TAGS else now


def blocks_of(page: str) -> list[tuple[int, str, int]]:
    """(part of the page, text, characters in links) of each block that has text."""
    out: list[tuple[int, str, int]] = []
    stack: list[tuple[str, int]] = []  # open elements that can change the part
    depth: Counter[str] = Counter()  # how often each is open, so that a stray end tag costs nothing
    place, link, at, end = BODY, 0, 0, len(page)
    parts: list[str] = []
    linked = 0

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append((place, text, linked))
            parts.clear()
            linked = 0

    def push(tag: str) -> None:
        stack.append((tag, place))
        depth[tag] += 1

    def pop(tag: str) -> None:
        """Close the innermost ``tag`` and what is open within it."""
        nonlocal place
        while True:
            name, place = stack.pop()
            depth[name] -= 1
            if name == tag:
                return

    while at < end:
        m = TOKEN.search(page, at)
        upto = m.start() if m else end
        if upto > at:
            parts.append(page[at:upto])
            if link:
                linked += upto - at
        if not m:
            break
        at = m.end()
        name = m[2]
        if name is None:
            continue
        tag = name.lower()
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            link = 0 if m[1] else 1
        elif tag in BLOCKS or tag in GONE:
            close()
            if tag in BLOCKS:
                link = 0
            if m[1]:
                if depth[tag]:
                    pop(tag)
            elif tag not in VOID:
                if tag in RAW:
                    shut = re.compile(rf"</{tag}(?![\w-])[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
                    at = shut.end() if shut else end
                    continue
                if tag == "p" or tag == "li":  # one such element ends the one before it
                    inner = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag or stack[i][0] not in ("p", "li")), -1)
                    if inner >= 0 and stack[inner][0] == tag:
                        pop(tag)
                push(tag)
                place = place_of(tag, m[3], place)
        elif not m[1] and m[3] and tag not in VOID and not m[3].endswith("/") and place_of(tag, m[3], place) == OUT != place:
            close()
            push(tag)
            place = OUT
        elif m[1] and depth[tag]:
            close()
            pop(tag)
    close()
    return out


Block = tuple[int, str, int]


def density(text: str) -> tuple[int, int]:
    """Words, and stop words among them."""
    words = re.findall(r"[^\W\d_]+", text.lower())
    return len(words), sum(w in STOP_WORDS for w in words)


def first_pass(own: list[Block], in_article: bool) -> list[bool | None]:
    """Keep, drop or None for each block from itself. In an article no block is dropped for its words: with few stop words it is in doubt."""
    told = [density(text) for _, text, _ in own]
    many = sum(n for n, _ in told)
    foreign = many >= TELLING and sum(k for _, k in told) < KNOWN * many
    links = [False, *(linked > LINKED * len(text) for _, text, linked in own), False]
    labels: list[bool | None] = []
    for i, (_, text, _) in enumerate(own):
        size = len(text)
        words = told[i][1] / told[i][0] if told[i][0] else 0.0
        if links[i + 1]:  # a lone short link in an article may be a line of it; a list of links is a menu
            alone = in_article and size < SHORT and not links[i] and not links[i + 2]
            labels.append(None if alone else False)
        elif size < SHORT:
            labels.append(None)
        elif foreign or words >= DENSE or (words >= SPARSE and (in_article or size >= LONG)):
            labels.append(True)
        else:
            labels.append(None if in_article or words >= SPARSE else False)
    return labels


def second_pass(labels: list[bool | None]) -> list[bool]:
    """Blocks in doubt follow the nearest decided one; of two as near, one that is kept; alone they are kept."""
    before: list[tuple[int, bool] | None] = []
    last: tuple[int, bool] | None = None
    for i, label in enumerate(labels):
        before.append(last)
        if label is not None:
            last = (i, label)
    keep = [False] * len(labels)
    after: tuple[int, bool] | None = None
    for i in range(len(labels) - 1, -1, -1):
        if (label := labels[i]) is not None:
            keep[i], after = label, (i, label)
            continue
        near = [x for x in (before[i], after) if x is not None]
        least = min((abs(x[0] - i) for x in near), default=0)
        keep[i] = any(x[1] for x in near if abs(x[0] - i) == least) if near else True
    return keep


def main_text(page: str | None) -> str:
    """The article's blocks, one a line."""
    if not page:
        return ""
    found = [b for b in blocks_of(page) if b[0] != OUT]  # what is elsewhere is boilerplate
    article, rest = ([b for b in found if b[0] == place] for place in (ARTICLE, BODY))
    size = lambda blocks, labels: sum(len(b[1]) for b, label in zip(blocks, labels, strict=True) if label)
    teaser = bool(article and rest) and size(rest, first_pass(rest, False)) > MASS * size(article, [True] * len(article))
    own = found if teaser else article or rest
    labels = first_pass(own, bool(article) and not teaser)
    return "\n".join(text for (_, text, _), k in zip(own, second_pass(labels), strict=True) if k)


def extract(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``id``, ``text``: each page's main text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            texts = [main_text(x) for x in chunk.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([chunk.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    rows = pages.select(pages[id_col].alias("id"), pages[html_col].alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, and its length."""
    pages = documents(spark, sf_dir, "pages").select(F.struct("page_id", "url").alias("key"), "html")
    return extract(pages, id_col="key").select("id.page_id", "id.url", "text", F.length("text").cast("long").alias("n_chars"))
