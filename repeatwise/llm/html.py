"""Main text of web pages by line-block distribution.

Markup is stripped to lines: block-level elements begin and end a line, inline ones don't.
Comments, scripts, styles and the like vanish with all they hold; an element of these that
isn't closed ends where the next block begins or ends, or its parent ends, but for scripts,
styles and text areas, whose text could be anything and goes to the end of the page. Lines inside elements that
are boilerplate by tag, role or name (menus, headers, footers, sidebars, notices, adverts,
forms, comments) weigh nothing; the others weigh the length of their text outside links, and
those inside an article or main element `ANCHOR` more, as their author has marked them.
A name is a class or id: one part of it that tells, like `comments` in `user-comments`, makes it
boilerplate unless another part says otherwise, like `no` or `has`; other parts do only together, so
`social-share-bar` is boilerplate, `legal-analysis` isn't. An article or main element in a wrapper that is
boilerplate by name, or a form, isn't, unless it has such a name itself or is in an article.
Two or more lines in a row of nothing but links, outside of articles, are a menu.

The weights of `WINDOW` lines from each line on are summed. Text surges at the first line
that weighs anything and whose sum reaches the threshold, a share of the page's largest sum;
it dives after the last line that reaches it together with the lines before it. For the
threshold a line's text counts up to `LONG` characters, so that a very long block doesn't
raise it, and any line of an article or main element reaches it alone. Such lines lend nothing
to the sums of others. On a page without them the lines that are mostly text outside links take their
place, so that short paragraphs aren't lost. What lies between is
kept, but for lines that weigh nothing because they are boilerplate.

Character references are decoded, white space inside a line becomes one blank, lines are
joined by one line break. Null, empty and text-free pages give an empty text. The whole page
counts, however long; pages don't influence each other, so equal rows get equal texts, and an empty table
gives an empty table.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repeatwise.llm.work import fresh, ship

WINDOW, SHARE, ANCHOR, LONG = 3, 0.2, 400, 80
#: Elements that go with all they hold, whose text isn't markup: to the page's end if open,
RAW = "script|style|textarea"
#: or, if open, like those that hold markup.
WHOLE = "title|iframe"
DROPPED = frozenset("title iframe template noscript svg math canvas object select button".split())
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<whole>{WHOLE})(?=[\s/>])[^>]*>(?:(?!<(?P=whole)[\s/>]|<body[\s>]|</head\s*>).)*?</(?P=whole)\s*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)/?>"
    r"|<[!?/][^>]*>", re.S | re.I)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark "
    "picture q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose begin and end also end an open element that is dropped.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary "
    "table caption tbody td tfoot th thead tr ul".split())
#: Elements that end where another block begins or their parent ends, written or not.
LOOSE = frozenset("p li dt dd option tr td th thead tbody tfoot".split())
BOILERPLATE = frozenset("nav header footer aside form menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsored sponsor promo promotion banner "
    "nav navigation navbar menu menubar breadcrumb breadcrumbs sidebar aside widget footer header masthead "
    "cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social comment comments disqus respond replies related recommended recommendations "
    "pagination pager toolbar skip copyright disclaimer legal".split())
#: Parts of names that tell by themselves,
TELLING = frozenset(
    "ad ads advert adverts advertisement advertising sponsored nav navbar navigation menubar breadcrumb breadcrumbs "
    "sidebar footer masthead cookie cookies gdpr popup newsletter comment comments disqus related pagination".split())
#: unless it is only said whether they are there, or another part names a text
STATES = frozenset("has no non not with without is open hide hidden free".split())
SUBJECTS = frozenset("article story post content entry body text analysis".split())
#: that what is told wouldn't belong to; and parts that say nothing.
BELONGING = frozenset("comment comments related sponsored ad ads advert footer sidebar newsletter".split())
NEUTRAL = frozenset(
    "site main primary secondary global block list item link links button buttons area bar box section slot left right top "
    "bottom page inner outer container wrapper wrap row col thread google user reader".split())
#: How much an element, or a wrapper of it, is marked as an article.
MARKED = {"main": 1, "article": 2}
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
SIZES = re.compile(r"\d+x\d+")
NAME = re.compile(r"[^\W\d_]+")
#: Whether an element is boilerplate: no; by its name or as a form; by its tag or role, or hidden.
PLAIN, NAMED, CERTAIN = range(3)


def is_boilerplate_name(value: str) -> bool:
    for name in value.split():
        parts = NAME.findall(SIZES.sub("", name))
        if NAMES.isdisjoint(parts):
            continue
        if all(x in NAMES or x in NEUTRAL for x in parts):
            return True
        told = TELLING.intersection(parts)
        if told and STATES.isdisjoint(parts) and (SUBJECTS.isdisjoint(parts) or told & BELONGING):
            return True
    return False


def boilerplate_of(tag: str, attributes: str, in_marked: int) -> int:
    if tag in ("body", "html", "head"):
        return PLAIN
    # A header inside an article holds its headline.
    found = PLAIN
    if tag in BOILERPLATE and not (tag == "header" and in_marked):
        found = NAMED if tag == "form" else CERTAIN
    if attributes and not attributes.isspace():
        for name, *values in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values).lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in ROLES:
                return CERTAIN
            if name in ("class", "id") and is_boilerplate_name(value):
                found = max(found, NAMED)
    return found


def ends_of(tokens: list[re.Match]) -> dict[int, int]:
    """For the start of each element that is dropped and closed, by place, the place of its end."""
    ends: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    held: Counter = Counter()
    for i, token in enumerate(tokens):
        tag = (token["tag"] or "").lower()
        if not tag or tag in INLINE or tag in VOID:
            continue
        if not token["end"]:
            if tag in DROPPED and token[0].endswith("/>"):
                ends[i] = i
            else:
                stack.append((tag, i))
                held[tag] += 1
        elif held[tag]:
            while stack:
                name, start = stack.pop()
                held[name] -= 1
                if name == tag:
                    break
            if tag in DROPPED:
                ends[start] = i
    return ends


class Line(NamedTuple):
    """A line that has text: characters of it outside links, whether marked as article, or boilerplate."""

    text: str
    own: int
    marked: bool
    boilerplate: bool


def lines_of(page: str) -> list[Line]:
    """The lines of a page in order."""
    out: list[Line] = []
    stack: list[tuple[str, int, int]] = []  # tag, how far boilerplate, how far marked
    parts: list[str] = []
    linked, boilerplate, marked, in_link = 0, PLAIN, 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(references.unescape("".join(parts)).split())
            if text:
                out.append(Line(text, max(0, len(text) - linked), marked > 0, bool(boilerplate)))
            parts.clear()
        linked = 0

    def text_run(run: str) -> None:
        nonlocal linked
        if run:
            parts.append(run)
            if in_link:
                linked += len(run.strip())

    at, tokens = 0, list(TOKEN.finditer(page))
    ends = ends_of(tokens)
    skip_to = -1  # the end of a closed element that is dropped
    dropping, inside = False, []  # whether an open one is dropped, inline elements begun in it
    for i, token in enumerate(tokens):
        if i > skip_to and not dropping:
            text_run(page[at:token.start()])
        at = token.end()
        if i <= skip_to:
            continue
        tag = token["tag"]
        if not tag:
            if token["whole"] and token["whole"].lower() == "title":
                flush()
            continue
        tag = tag.lower()
        if tag in DROPPED:
            if not token["end"]:
                if tag == "title":
                    flush()
                if i in ends:
                    skip_to = ends[i]
                elif not dropping:
                    dropping, inside = True, []
            continue
        if dropping:
            if tag in INLINE and tag not in VOID and not token["end"]:
                inside.append(tag)
            elif token["end"] and tag in inside:
                inside.remove(tag)
            elif tag in BLOCKS or token["end"] and (tag in INLINE or any(x == tag for x, _, _ in stack)):
                dropping = False
            if dropping:
                continue
        if tag == "a":
            in_link = 0 if token["end"] else 1
        if tag == "br":
            parts.append(" ")
            continue
        if tag in INLINE:
            continue
        flush()
        if token["end"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if stack[k][0] not in LOOSE and tag in LOOSE:
                    break
        elif tag not in VOID:
            while stack and (stack[-1][0] == "p" or stack[-1][0] == tag and tag in LOOSE):
                stack.pop()
            upper = stack[-1] if stack else ("", PLAIN, 0)
            own = boilerplate_of(tag, token["attributes"], upper[2])
            if tag in MARKED and own < CERTAIN and upper[1] < CERTAIN:
                # Its own name counts only in a wrapper that has one, as in a list of comments.
                own = upper[1] if own or upper[2] == MARKED["article"] else PLAIN
            else:
                own = max(own, upper[1])
            stack.append((tag, own, max(upper[2], MARKED.get(tag, 0))))
        _, boilerplate, marked = stack[-1] if stack else ("", PLAIN, 0)
    if not dropping:
        text_run(page[at:])
    flush()
    return out


def sums(weights: list[int]) -> list[int]:
    """Of `WINDOW` weights from each on."""
    n, total = len(weights), [0, *accumulate(weights)]
    return [total[min(n, i + WINDOW)] - total[i] for i in range(n)]


def kept_lines(lines: list[Line]) -> list[int]:
    """Numbers of the lines between surge and dive that aren't boilerplate."""
    n = len(lines)
    links = [not (x.own or x.marked or x.boilerplate) for x in lines]
    menu = [links[i] and (i > 0 and links[i - 1] or i + 1 < n and links[i + 1]) for i in range(n)]
    good = [not (x.boilerplate or m) for x, m in zip(lines, menu)]
    some_marked = any(x.marked and g for x, g in zip(lines, good))
    anchored = [g and (x.marked if some_marked else 2 * x.own >= len(x.text)) for x, g in zip(lines, good)]
    own = [max(1, x.own) * g for x, g in zip(lines, good)]
    least = SHARE * max(sums([min(w, LONG) + ANCHOR * a for w, a in zip(own, anchored)]), default=0)
    lent = [w * (not a) for w, a in zip(own, anchored)]
    ahead, behind = sums(lent), sums(lent[::-1])[::-1]
    surge = next((i for i in range(n) if good[i] and (anchored[i] or ahead[i] >= least)), n)
    dive = next((i for i in range(n - 1, -1, -1) if good[i] and (anchored[i] or behind[i] >= least)), -1)
    return [i for i in range(surge, dive + 1) if good[i]]


def main_text(page: str | None) -> str:
    lines = lines_of(page) if page else []
    return "\n".join(lines[i].text for i in kept_lines(lines))


def extracted(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """`pages` with the main text of `html` in `into`, replacing a column of that name."""
    ship(pages.sparkSession)

    @F.arrow_udf("string")
    def texts(column: pa.Array) -> pa.Array:
        return pa.array([main_text(x.as_py()) for x in column], pa.string())

    raw = fresh(pages, "_main")
    return pages.withColumn(raw, texts(F.col(html))).withColumn(into, F.col(raw)).drop(raw)
