"""Main text of web pages by two passes of block rules.

The page is cut into blocks at block-level tags. Blocks in menus, page headers,
footers, sidebars, notices, adverts, forms and comments are boilerplate, as are
all blocks outside an article if the page has one. Pass one decides the others
by length and density: mostly linked ones are boilerplate, long ones with a fair
share of stop words are main text, and long ones with few are boilerplate
outside articles. Blocks that stay ambiguous, as short ones do (and in an article
ones of few stop words, such as tables or languages without a list), take in pass
two the label of the nearest decided block in the same article or body; between
two that are as near, main text wins, as it does where nothing is decided inside
an article, or on a page without any.

A class, id or role names boilerplate if one of its parts (between spaces) holds
a word of HINTS and nothing else but words of PLACES.

Null and empty pages give an empty text; a text without tags is one block.
Unclosed tags end with their holder or the page; a tag, comment or script that
the page's end cuts is dropped. Nothing is capped. Repeated rows are extracted
alike, empty tables give no rows. Only page_id, url and html are read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import groups, map_arrow, record_batch

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|svg|math|iframe|object|select)\b[^>]*(?:>.*?(?:</\1\s*>|\Z)|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S | re.I)
ATTRIBUTE = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HOLDERS = frozenset("html body main article section div nav header footer aside form ul ol dl table tbody thead tfoot tr td th details dialog figure blockquote fieldset menu button label".split())
BREAKS = HOLDERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd hr pre address caption figcaption summary legend option center".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog button fieldset label".split())
#: Words of class, id or role that name boilerplate.
HINTS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices alert popup modal sidebar side menu nav navbar navigation breadcrumb breadcrumbs topbar masthead header footer footnav comment comments disqus reply replies respond form login signup subscribe newsletter share sharing social related recommended widget pagination pager copyright skip toolbar contentinfo complementary search".split())
#: Words that say where or what shape, and leave the meaning to a hint beside them.
PLACES = frozenset("site page main article post posts stories top bottom left right primary secondary global mobile sticky box bar block list item items links link buttons button area panel section wrapper container wrap inner outer row col unit slot text message content".split())
#: Beside these, a header or footer is the article's own.
OWN = frozenset("article post entry story".split())
#: Frequent words of the languages served.
STOP_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which you were their one all we can has there been if more when will would who so no "
    "der die das und ist nicht von zu mit sich den dem ein eine im auf für als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum kann "
    "le la les de des du et est un une en que qui dans pour pas sur au par plus avec ce il sont aux ou mais se ne "
    "el los las del y que una por con para su al lo como más pero sus este ya o sin sobre".split()
)
LINKED, SHORT, DENSE, SPARSE, LONG = 0.33, 70, 0.30, 0.12, 210
GOOD, BAD, OPEN = 1, 0, None


class Block:
    __slots__ = ("parts", "linked", "holder", "bad", "text")

    def __init__(self, holder: int, bad: bool):
        self.parts, self.linked, self.holder, self.bad, self.text = [], 0, holder, bad, ""


def named_boilerplate(name: str, attributes: str, in_article: bool) -> bool:
    if name in BOILERPLATE or name == "header" and not in_article:
        return True
    if "=" not in attributes or name in ("html", "body"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        for part in (m[1] or m[2] or m[3] or "").lower().split():
            words = {w for w in re.split(r"[^a-z]+", part) if w}
            hints = words & HINTS
            if words & OWN:
                hints -= {"header", "footer"}
            if hints and words <= HINTS | PLACES | OWN:
                return True
    return False


def blocks_of(page: str) -> list[Block]:
    """The blocks with text, in page order. holder: 0 outside articles, else the number of the article."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int]] = [("", False, 0)]  # name, boilerplate, article
    articles, block, link, at = 0, Block(0, False), False, 0

    def close() -> None:
        nonlocal block
        if block.parts:
            block.text = " ".join(entities.unescape("".join(block.parts)).split())
            if block.text:
                out.append(block)
        block = Block(stack[-1][2], stack[-1][1])

    def say(text: str) -> None:
        block.parts.append(text)
        if link:
            block.linked += len(text.strip())

    for m in TOKEN.finditer(page):
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            if m[1] and m[1].lower() in ("title", "textarea", "select"):
                close()
            continue
        if name == "br":
            say(" ")
        elif name == "a":
            link = not m[2]
        if name not in BREAKS:
            continue
        close()
        if name in HOLDERS and not m[4].rstrip().endswith("/"):
            if not m[2]:
                _, bad, article = stack[-1]
                if name in ("article", "main") and not article:
                    articles += 1
                    article = articles
                stack.append((name, bad or named_boilerplate(name, m[4], bool(article)), article))
                link = False
            elif any(s[0] == name for s in stack[1:]):
                while stack.pop()[0] != name:
                    pass
                link = False
            block = Block(stack[-1][2], stack[-1][1])
    if at < len(page):
        say(page[at:])
    close()
    return out


def first_pass(block: Block, has_article: bool) -> int | None:
    if block.bad or has_article and not block.holder:
        return BAD
    n = len(block.text)
    if block.linked > LINKED * n:
        return OPEN if block.holder and n < SHORT else BAD
    if n < SHORT:
        return OPEN
    words = [w.strip(".,;:!?#*$%&|<>\"'()").lower() for w in block.text.split()]
    density = sum(w in STOP_WORDS for w in words) / len(words)
    if density >= DENSE or density >= SPARSE and n > LONG:
        return GOOD
    return BAD if density < SPARSE and not block.holder else OPEN


def second_pass(found: list[Block], labels: list[int | None]) -> list[int]:
    """Each open label from the nearest decided block of the same holder; without one, main text in an article or on a page that has no other."""
    out = list(labels)
    bare = GOOD not in labels
    before: dict[int, int] = {}
    near: dict[int, tuple[int, int]] = {}
    for i, block in enumerate(found):
        if labels[i] is OPEN:
            if block.holder in before:
                j = before[block.holder]
                near[i] = i - j, labels[j]
        elif not block.bad:
            before[block.holder] = i
    after: dict[int, int] = {}
    for i in range(len(found) - 1, -1, -1):
        block = found[i]
        if labels[i] is OPEN:
            options = [near[i]] if i in near else []
            if block.holder in after:
                j = after[block.holder]
                options.append((j - i, labels[j]))
            out[i] = min(options, key=lambda x: (x[0], -x[1]))[1] if options else GOOD if block.holder or bare else BAD
        elif not block.bad:
            after[block.holder] = i
    return out


def main_text(page: str) -> str:
    found = blocks_of(page)
    has_article = any(b.holder and not b.bad for b in found)
    labels = second_pass(found, [first_pass(b, has_article) for b in found])
    return " ".join(b.text for b, label in zip(found, labels, strict=True) if label == GOOD)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text (empty if none) and n_chars (its code points) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sources in groups(batches, "html"):
            texts = list(map(main_text, sources))
            yield record_batch({"page_id": part.column(0), "url": part.column(1), "text": texts, "n_chars": list(map(len, texts))}, {"page_id": pa.int64(), "url": pa.string(), "text": pa.string(), "n_chars": pa.int64()})

    return map_arrow(pages.select(F.col("page_id").cast("long"), "url", "html"), run, "page_id long, url string, text string, n_chars long")
