"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped into lines, one for each block of text. A line's mass is its text without that of links, of which
an article keeps three fifths. Lines fall into runs, parted by what can't be text (menus, footers, forms and the like) and by the borders
of articles and of elements whose name marks them as something else. In a run, sums of mass and of length over windows of lines, one
ending and one beginning at each line, tell where text surges and where it dives: a block of links stays only where text
stands on both its sides (a title where text follows, a single paragraph where text stands before), a label only where text follows. Runs outside the article, or under a mark, stay only if they hold most of the page.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

# Element names of HTML, roles, and words of class and id names that mark what isn't main text.
RAW = frozenset("script style noscript template textarea iframe noembed noframes object svg math canvas audio video xmp title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
CHROME = frozenset("nav aside footer button select label dialog menu head".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle adbox banner sponsor sponsored promo promoted promotion cookie cookies consent gdpr notice notices alert alerts "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs "
    "topbar header masthead footer copyright comment comments commentlist disqus respond replies reply widget widgets pagination pager toolbar skip paywall disclaimer".split()
)
#: Words that stand beside a mark in a name without changing it.
NEUTRAL = frozenset("site page global top bottom left right upper lower wrap wrapper container inner outer box block list item items area section bar col column links link buttons button main content primary secondary fixed sticky mobile desktop reader user thread form slot unit zone".split())
#: What may stand in a head; anything else ends it.
HEAD = frozenset("base link meta title style script noscript template head html".split())
#: Elements that a mark never takes away: they hold the page or the article itself.
KEPT = frozenset("html body article main".split())
HEADINGS = {f"h{n}": n for n in range(1, 7)}
COMMENT_HEAD = re.compile(r"(?:\d+ )?(?:reader |user )?(?:comments?|replies|commentaires?|kommentare?|comentarios?)(?: ?\(\d+\))?:?|(?:leave|post|add|write) a (?:comment|reply)|join the (?:conversation|discussion)", re.I)
RIGHTS = re.compile(r"(?:copyright )?(?:©|\(c\) ?\d{4})|copyright \d{4}", re.I)
SENTENCE_END = tuple(".!?…:;\"'”’»)")
WINDOW = 3
DENSE = 0.5
LABEL = 60

_TAG = re.compile(
    r"""<(?:!--(?:.*?--!?>|.*)|(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+)*+)>|[!?/][^>]*>?)""", re.S
)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTR = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/"']|$)""", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

HARD, MARKED, MAYBE = 3, 2, 1


def _named(name: str, inside: bool) -> int:
    """Whether a class or id says what it holds isn't main text: MARKED by marks alone, MAYBE by marks among neutral words, which a wrapper may have too."""
    words = [w.lower() for w in _WORD.findall(name)]
    found = [w in MARKS and not (inside and w == "header") for w in words]
    if not any(found) or not all(m or w in NEUTRAL for m, w in zip(found, words)):
        return 0
    return MARKED if all(found) else MAYBE


def _chrome(tag: str, attrs: str, inside: bool) -> int:
    """Whether an element can't hold main text (HARD), is named as something else (MARKED), may be or is a form (MAYBE), or neither (0)."""
    if tag in CHROME or tag == "header" and not inside:
        return HARD
    found = MAYBE if tag == "form" else 0
    if not attrs or attrs.isspace() or tag in KEPT:
        return found
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
            return HARD
        if name == "role" and value.lower() in ROLES:
            return HARD
        if name in ("class", "id"):
            found = max([found, *(_named(part, inside) for part in value.split())])
    return found


@dataclass
class Line:
    """A block's text: how much of it is links, whether it can't be main text, and the article, main and innermost marked element it is in (0 for none)."""

    text: str
    links: int
    dark: bool
    article: int
    main: int
    mark: int
    #: The level of the heading it is, 0 for none, and whether it is a paragraph.
    heading: int
    paragraph: bool


class _Reader:
    """Lines of a page in one forward pass; every step is undone at most once, so the time is linear in the page.

    marks holds the marked elements by number, each with the one around it (0 for none) and what its name says; a line has the number of its innermost.
    """

    def __init__(self, html: str):
        self.html, self.lines = html, []
        self.stack: list[tuple[str, bool, bool]] = []
        self.open: Counter = Counter()
        self.parts: list[tuple[str, bool]] = []
        self.marks: list[tuple[int, int]] = [(0, 0)]
        self.mark = 0
        self.articles: list[int] = []
        self.mains: list[int] = []
        #: Depth of the element that a comments' heading silences from there on, and the heading's level.
        self.mute: tuple[int, int] | None = None
        self.dark = self.count = 0
        self.level = 0

    def flush(self) -> None:
        if not self.parts:
            return
        text = " ".join("".join(t for t, _ in self.parts).split())
        if text:
            if self.level:
                depth = next(i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] in HEADINGS)
                if self.mute and depth <= self.mute[0] + 1 and self.level <= self.mute[1]:
                    self.mute = None
                if not self.mute and not self.articles and COMMENT_HEAD.fullmatch(text):
                    self.mute = depth - 1, self.level
            links = sum(len("".join(t.split())) for t, link in self.parts if link)
            self.lines.append(Line(text, links, self.dark > 0 or self.mute is not None, self.articles[-1] if self.articles else 0, self.mains[-1] if self.mains else 0, self.mark, self.level, self.open["p"] > 0))
        self.parts.clear()

    def pop(self) -> None:
        tag, was_dark, marked = self.stack.pop()
        self.open[tag] -= 1
        self.dark -= was_dark
        if marked:
            self.mark = self.marks[self.mark][0]
        if tag == "article":
            self.articles.pop()
        elif tag == "main":
            self.mains.pop()
        elif tag in HEADINGS:
            self.level = next((HEADINGS[t] for t, _, _ in reversed(self.stack[-2:]) if t in HEADINGS), 0)
        if self.mute and len(self.stack) <= self.mute[0]:
            self.mute = None

    def push(self, tag: str, attrs: str) -> None:
        inside = bool(self.articles or self.mains)
        how = _chrome(tag, attrs, inside)
        # A form in the text, and what an article itself marks, is no wrapper of it.
        if how and (self.articles or tag == "form" and inside):
            how = HARD
        if 0 < how < HARD:
            self.marks.append((self.mark, how))
            self.mark = len(self.marks) - 1
        self.stack.append((tag, how == HARD, 0 < how < HARD))
        self.open[tag] += 1
        self.dark += how == HARD
        if tag == "article":
            self.count += 1
            self.articles.append(self.count)
        elif tag == "main":
            self.count += 1
            self.mains.append(self.count)
        elif tag in HEADINGS:
            self.level = HEADINGS[tag]

    def text(self, text: str) -> None:
        if not text:
            return
        if self.stack and self.stack[-1][0] == "head" and not text.isspace():
            self.pop()
        self.parts.append((entities.unescape(text) if "&" in text else text, self.open["a"] > 0))

    def read(self) -> list[Line]:
        html, at, end, last, failed = self.html, 0, len(self.html), self.html.rfind(">"), 0
        while at < end:
            begin = html.find("<", at)
            if begin < 0 or begin > last and not html.startswith("<!--", begin):
                self.text(html[at:])
                break
            found = _TAG.match(html, begin) if failed < 3 else None
            if not found:
                named = html[begin + 1 : begin + 3].lstrip("/")[:1].isalpha()
                failed += named
                found = _LOOSE.match(html, begin) if named else None
            if not found:
                self.text(html[at : begin + 1])
                at = begin + 1
                continue
            self.text(html[at:begin])
            at = found.end()
            if found[2]:
                at = self.tag(found[2].lower(), bool(found[1]), found[3], at)
        self.flush()
        return self.lines

    def tag(self, tag: str, closing: bool, attrs: str, at: int) -> int:
        if tag in BLOCK or tag not in HEAD and self.stack and self.stack[-1][0] == "head":
            self.flush()
        if closing:
            if self.open[tag]:
                while self.stack[-1][0] != tag:
                    self.pop()
                self.pop()
            return at
        if tag in BLOCK:
            # A paragraph, list item or table part ends where the next block of its kind begins.
            top = self.stack[-1][0] if self.stack else ""
            if top == "p" or tag == top and tag in ("li", "dd", "dt", "tr", "td", "th", "option"):
                self.pop()
        if tag not in HEAD and self.stack and self.stack[-1][0] == "head":
            self.pop()
        # A slash that ends an unquoted value closes nothing.
        closed = attrs.endswith("/") and attrs[-2:-1] in ("", " ", "\t", "\n", "\r", '"', "'")
        if tag in RAW:
            if closed:
                return at
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(self.html, at)
            return close.end() if close else len(self.html)
        if tag in VOID or closed and tag not in BLOCK:
            return at
        self.push(tag, attrs)
        return at


def _kept(run: list[Line], window: int) -> list[Line]:
    """The lines of a run that belong to its text, by sums over the windows that end and that begin at each line."""
    size = [len(x.text) for x in run]
    mass = [max(0.0, n - x.links * (0.4 if x.article or x.main else 1.0)) for n, x in zip(size, run)]
    masses, sizes = ([0, *accumulate(v)] for v in (mass, size))
    dense = lambda a, b: masses[b] - masses[a] > DENSE * (sizes[b] - sizes[a])
    out = []
    for i, line in enumerate(run):
        before, after = dense(max(0, i + 1 - window), i + 1), dense(i, min(len(run), i + window))
        if mass[i] <= DENSE * size[i]:
            # A title of links belongs to the text that surges after it; a single paragraph of links to the text that dives with it.
            title, beyond = 0 < line.heading <= 2, i + 1 == len(run) or dense(i + 1, min(len(run), i + 1 + window))
            single = line.paragraph and i > 0 and dense(i - 1, i) and beyond
            keep = before and (after or single) or title and after
        elif size[i] <= LABEL and not line.text.endswith(SENTENCE_END):
            keep = after
        else:
            keep = True
        if keep:
            out.append(line)
    return out


def main_text(html: str | None, window: int = WINDOW) -> str:
    """The main text of a page; empty for null, empty and text-free pages.

    The article is the articles of a page, or without any its main, if they hold at least half of the mass outside menus and the like. A name
    that a wrapper may have counts only for what holds less than half of it, and marks around the article only where another one has none.
    """
    if not html:
        return ""
    reader = _Reader(html)
    lines = reader.read()
    while lines and not lines[-1].dark and len(lines[-1].text) <= 200 and RIGHTS.match(lines[-1].text):
        lines.pop()
    lit = [x for x in lines if not x.dark]
    weight = lambda some: sum(max(0, len(x.text) - x.links) for x in some)
    # Elements are numbered from the outside in, so what holds for one is known when those in it come.
    sure = [False]
    for outer, how in reader.marks[1:]:
        sure.append(sure[outer] or how == MARKED)
    plain = [x for x in lit if not sure[x.mark]] or lit
    total = weight(plain)
    inside = next((f for f in (lambda x: x.article, lambda x: x.main) if any(map(f, plain)) and 2 * weight(filter(f, plain)) >= total), None)
    held = [0] * len(reader.marks)
    for x in plain:
        held[x.mark] += max(0, len(x.text) - x.links)
    for n in range(len(held) - 1, 0, -1):
        held[reader.marks[n][0]] += held[n]
    lost = [False]
    for n, (outer, how) in enumerate(reader.marks[1:], 1):
        lost.append(lost[outer] or how == MARKED or 2 * held[n] <= total)
    under = lambda x: lost[x.mark]
    core = [x for x in lit if inside is None or inside(x)]
    if core and all(map(under, core)):
        under = lambda x: False
    # Runs are parted by dark lines and where article or marks change; only those of the article without a mark are text.
    kind = lambda x: None if x.dark or under(x) or inside is not None and not inside(x) else (inside(x) if inside else 0, x.mark)
    return " ".join(x.text for key, run in groupby(lines, kind) if key is not None for x in _kept(list(run), window))


def extract(pages: DataFrame, window: int = WINDOW) -> DataFrame:
    """page_id, url, text of every row of (page_id, url, html).

    Null html gives an empty text; repeated rows and null ids or urls keep their row; an empty table gives
    no rows. Whole pages are read, however long.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(h.as_py(), window) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), pa.array(text, pa.string())], names=["page_id", "url", "text"])

    return pick(pages, "page_id", "url", "html").mapInArrow(made, "page_id bigint, url string, text string")


def op7_html(spark, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    found = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
