"""HTML extraction (operator 4): the maximum-scoring run of a page's tokens.

A page is a run of tags and words. Words score positive and tags negative; words of links, and of elements that hold
menus, headers, footers, sidebars, notices, adverts, forms or comments, score negative as well. The weights are log odds
learned from the labelled pages below; an element apart counts once, however long, so that an advert within an article
doesn't end it. One linear scan (Kadane) finds the run with the greatest sum, which is taken to both ends of the smallest
element that holds its words (a table of short cells costs more tags than it has words, and is text all the same); its
blocks, less the elements apart, are the text. What a class or id says of an element doesn't count if the element holds
most of the page's words.

Defined cases: null or empty html, or a page without words, gives an empty text; a truncated page, an element that is
not closed, and a bare `<` or `&` in text are read as browsers do; long pages are read whole, in linear time; repeated
rows give repeated rows; of runs with equal sums the one that ends first counts; other columns are not read.
"""

from __future__ import annotations

import bisect
import functools
import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import bounded_batches, columns_of

#: Elements whose content is not text, those that hold no main text, those that bound blocks, those that hold
#: several blocks, and those of running text.
RAW = frozenset("script style noscript template title textarea svg math iframe object canvas audio video select option head".split())
APART = frozenset("nav footer aside form button dialog menu header label fieldset".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody tfoot thead tr ul".split())
HOLDERS = frozenset("article main section div form fieldset center td".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote dd figcaption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that may stand in a head, whose tags are left out; any other, or a word, ends a head that is open.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: Class and id names, and roles, of elements apart from the main text. A name counts when it is a whole class or
#: id, or its last part but for those that say nothing (ad-box-2); not after a part that tells of a state (has-sidebar). Parts
#: end at marks and where a capital begins (siteFooter); sizes (300x250) say nothing.
NAMES = frozenset("adsbygoogle adslot adunit adbox adbanner adwrapper adcontainer ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside widget footer masthead topbar toolbar comment comments respond replies reply disqus discussion share sharing social related recommended newsletter subscribe subscription signup login search pagination pager skip form".split())
#: Of these, the names that never stand for the main text, however much they hold; and elements that may wrap a page.
NEVER = frozenset("ad ads adv advert adverts advertisement advertising cookie cookies consent gdpr nav navbar navigation menu menubar footer comment comments respond replies reply disqus discussion".split())
#: Names that say so at any part (comment-body, related-posts), unless the element holds most of the page's words.
STRONG = frozenset("adsbygoogle ad ads advert adverts advertisement advertising sponsored comment comments disqus related share sharing cookie cookies consent gdpr breadcrumb breadcrumbs footer nav navbar navigation newsletter".split())
WRAPS = frozenset("form fieldset dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
SAY_NOTHING = frozenset("area bar block bottom box col column container group inner item items left links list outer panel right row section slot top unit wrap wrapper".split())
STATES = frozenset("has no with without is not hide show free".split())
#: Of two kinds of names, `header` means the page's own head unless one of these stands beside it.
CONTENT_NAMES = frozenset("article content entry post story main".split())

#: Fixed value: what texts have between two blocks.
BETWEEN = "\n\n"

#: Labelled pages: what stands between the two marks is the main text.
OPEN, CLOSE = "<!--main-->", "<!--/main-->"
LABELLED = (
    '<html><head><title>Tide tables</title></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/t">Tides</a></li></ul></nav>'
    "<!--main--><article><h1>Reading a tide table</h1><p>High water comes about fifty minutes later each day, because the moon moves on while the earth turns below it.</p>"
    '<p>The table gives heights over a <a href="/datum">datum</a>, and the times are those of the harbour itself.</p></article><!--/main-->'
    "<footer><p>About us</p><a>Contact</a></footer></body></html>",
    '<body><div id="top"><a href="/a">News</a> <a href="/b">Sport</a> <a href="/c">Weather</a></div><div><ul><li><a href="/1">First story</a></li><li><a href="/2">Second story</a></li></ul></div>'
    "<!--main--><div><h2>A mill is restored</h2><p>After nine years of work the mill on the river grinds corn again, and the stones were cut by hand.</p><p>Visitors may see it on the first Sunday of the month, when the wheel is let run for an hour.</p></div><!--/main-->"
    '<div><h4>More</h4><ul><li><a href="/3">Third story</a></li><li><a href="/4">Fourth story</a></li></ul></div></body>',
    '<body><header><img src="l.png"><form><input name="q"><button>Go</button></form></header><table><tr><td><a href="/x">Shop</a></td><td><a href="/y">Cart</a></td></tr></table>'
    "<!--main--><main><p>Sourdough wants time more than it wants kneading.</p><p>Mix the flour with the water, leave it for an hour, and only then add the salt and the leaven.</p><ul><li>Fold the dough every half hour.</li><li>Let it rest in the cold over night.</li></ul></main><!--/main-->"
    "<aside><h3>Tags</h3><a>bread</a> <a>flour</a></aside><footer><span>All rights reserved</span></footer></body>",
    '<body><ul><li><a href="/">Start</a></li><li><a href="/k">Kontakt</a></li></ul><div><span>Anzeige</span> <a href="/kauf">Jetzt kaufen</a></div>'
    "<!--main--><section><h1>Wie Glas entsteht</h1><p>Sand, Soda und Kalk werden geschmolzen, bis die Masse klar ist, und dann langsam gekühlt.</p><blockquote>Zu schnelles Kühlen lässt es springen, sagt der Meister.</blockquote><p>So wird es seit langem gemacht.</p></section><!--/main-->"
    "<div><a>Impressum</a> <a>Datenschutz</a></div></body>",
)

#: Comments (`<!-->` is an empty one), and tags with their attributes: a quote counts only after `=`. Nothing is tried twice.
_TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?>[^"'>=]|=\s*(?:"[^"]*"|'[^']*')|["'=])*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s"'<>/=]++)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*+))?""")
_TELLING = re.compile("class|id|role|hidden|style", re.I)
_WORD = re.compile(r"[^a-z0-9]+")
_CAPITAL, _SIZE = re.compile(r"(?<=[a-z0-9])(?=[A-Z])"), re.compile(r"\d+(?:x\d+)?(?:px)?")


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes), kinds `open`, `close`, `text` and `mark`; raw content and comments are left out."""
    at, end, head = 0, len(html), False
    while at < end:
        m = _TOKEN.search(html, at)
        stop = m.start() if m else end
        if head and html[at:stop].strip():
            head = False
            yield "close", "head", ""
        if stop > at and not head:
            yield "text", html[at:stop], ""
        if not m:
            return
        at = m.end()
        if m[2] is None:
            if m[0] in (OPEN, CLOSE):
                yield "mark", m[0], ""
            continue
        name = m[2].lower()
        if head and (name == "head" if m[1] else name not in IN_HEAD and name not in ("head", "html")) or head and m[1] and name in ("body", "html", "br"):
            head = False
            if name != "head":
                yield "close", "head", ""
        if not head:
            yield "close" if m[1] else "open", name, m[3]
        if name == "head":
            head = not m[1] and not m[3].endswith("/")
        elif name in RAW and not m[1] and not m[3].endswith("/"):
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])|</{re.escape(name)}\Z", re.I).search(html, at)
            at = stop.start() if stop else end
    if head:
        yield "close", "head", ""


def parts_of(token: str) -> list[str]:
    """The words of a class or id, in lower case, without sizes; `has-sidebar` and the like tell of a state and say nothing."""
    return [x for x in _WORD.split(_CAPITAL.sub("-", token).lower()) if x and not _SIZE.fullmatch(x)]


def named(value: str, wraps: bool = False) -> set[str]:
    """What the classes or ids of an element say it is: the last part that tells anything, and any strong one unless the element holds most of the page's words."""
    out = set()
    for token in value.split():
        parts = parts_of(token)
        if STATES.intersection(parts[:-1]) or STATES.intersection(parts[1:]):
            continue
        if not wraps:
            out |= STRONG.intersection(parts)
        while len(parts) > 1 and (parts[-1] in SAY_NOTHING or parts[-1].isdigit()):
            parts.pop()
        out.update(parts[-1:])
    return out


def elements(found: list[tuple[str, str, str]]) -> tuple[int, list[tuple[int, int, str, int, bool]]]:
    """Words outside links, and for each element: the places of its tags, its name, such words in it, and whether it was closed."""
    n = links = 0
    open_: list[tuple[str, int, int]] = []
    count: Counter = Counter()
    out = []
    for i, (kind, name, _) in enumerate(found):
        if kind == "text":
            n += 0 if links else len(name.split())
        elif kind == "open" and name not in VOID:
            links = links + 1 if name == "a" else 0 if name in BLOCKS else links
            open_.append((name, i, n))
            count[name] += 1
        elif kind == "close":
            links = 0 if name == "a" or name in BLOCKS else links
            while count[name]:
                x, j, before = open_.pop()
                count[x] -= 1
                out.append((j, i, x, n - before, x == name))
                if x == name:
                    break
    out += [(j, len(found), x, n - before, False) for x, j, before in open_]
    return n, out


def apart(name: str, attrs: str, inside: bool, wraps: bool = False) -> bool:
    """Whether an element holds no main text, by its name, class, id or role; inside: it stands within an article; wraps: it holds most of the page's words."""
    if name in RAW or name in APART and not (name == "header" and inside) and not (wraps and name in WRAPS):
        return True
    if not attrs or name in ("body", "html", "main", "article") or not _TELLING.search(attrs):
        return False
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key in ("class", "id"):
            names = named(value, wraps)
            if names & (NEVER if wraps else NAMES) or "header" in names and not inside and not wraps and not CONTENT_NAMES.intersection(parts_of(value)):
                return True
            continue
        value = value.lower()
        if key == "role" and value in ROLES or key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


class _Walk:
    """Where a reader of tokens stands: in links, in articles, in an element apart."""

    def __init__(self):
        self.links = self.articles = self.depth = 0
        self.skipped = ""

    def step(self, kind: str, name: str, attrs: str, wraps: bool = False) -> None:
        if kind == "open":
            if self.skipped and (name in ("article", "main") or self.skipped == "p" and name in BLOCKS or self.skipped == "li" and name == "li" and self.depth == 1):
                self.skipped = ""
            if self.skipped:
                self.depth += name == self.skipped
            elif name not in VOID and not attrs.endswith("/") and apart(name, attrs, self.articles > 0, wraps):
                self.skipped, self.depth = name, 1
            self.articles += name in ("article", "main")
            self.links = self.links + 1 if name == "a" else 0 if name in BLOCKS else self.links
        elif kind == "close":
            if name == self.skipped:
                self.depth -= 1
                if not self.depth:
                    self.skipped = ""
            elif self.skipped == "li" and name in ("ul", "ol") and self.depth == 1:
                self.skipped = ""
            self.articles -= name in ("article", "main") and self.articles > 0
            self.links = 0 if name == "a" or name in BLOCKS else self.links

    def word(self) -> str:
        return "word apart" if self.skipped else "word of a link" if self.links else "word"


@functools.cache
def weights() -> dict[str, float]:
    """Log odds of each kind of token to stand in main text; tags at most -0.05, plain words at least 0.5."""
    count: dict[bool, Counter] = {True: Counter(), False: Counter()}
    for page in LABELLED:
        main, walk = False, _Walk()
        for kind, name, attrs in tokens(page):
            if kind == "mark":
                main = name == OPEN
            elif kind == "text":
                count[main][walk.word()] += len(name.split())
            else:
                walk.step(kind, name, attrs)
                count[main][name] += 1
    total = {m: sum(c.values()) for m, c in count.items()}
    odds = {k: math.log((count[True][k] + 0.5) / (total[True] + 1)) - math.log((count[False][k] + 0.5) / (total[False] + 1)) for k in count[True] | count[False]}
    return {k: max(v, 0.5) if k == "word" else min(v, -0.05) for k, v in odds.items()} | {"tag": -0.3}


def whole(run: tuple[int, int], spans: list[tuple[int, int, str, int, bool]], words: list[int]) -> tuple[int, int]:
    """A run, to both ends of the smallest closed element of several blocks that holds its words; words: their places, in order."""
    at = bisect.bisect_left(words, run[0])
    to = bisect.bisect_left(words, run[1]) - 1
    if to < at:
        return run
    around = [(i, j) for i, j, name, _, closed in spans if closed and name in HOLDERS and i < words[at] and j > words[to]]
    if not around:
        return run
    i, j = max(around)
    return min(run[0], i), max(run[1], j)


def best_run(values: list[float]) -> tuple[int, int]:
    """The run (first, end) with the greatest sum, by one scan; the first to reach it among equals, and of those the shortest; (0, 0) if none is above 0."""
    score = best = 0.0
    first, run = 0, (0, 0)
    for i, value in enumerate(values):
        score += value
        if score <= 0:
            score, first = 0.0, i + 1
        elif score > best:
            best, run = score, (first, i + 1)
    return run


def extract(html: str, between: str = BETWEEN) -> str:
    """The main text of a page: its blocks in page order, with `between` between them."""
    weight, walk = weights(), _Walk()
    tag = weight["tag"]
    found = [x for x in tokens(html) if x[0] != "mark"]
    n_words, spans = elements(found)
    wrap = {i for i, _, _, k, _ in spans if 2 * k > n_words}
    seen: list[str] = []  # for each token: what kind of word, or whether a tag stands in an element apart
    words: list[int] = []
    values: list[float] = []
    block = ""
    for i, (kind, name, attrs) in enumerate(found):
        if kind == "text":
            n, of = len(name.split()), walk.word()
            seen.append(of)
            if not n:
                values.append(0.0)
                continue
            if of == "word":
                words.append(i)
            elif of == "word of a link" and (walk.articles or block in PROSE):
                seen[i] = "word of a linked text"
            value = 0.0 if walk.skipped else n * weight[of]
        else:
            before = walk.skipped
            walk.step(kind, name, attrs, i in wrap)
            block = name if name in BLOCKS else block
            value = weight.get(name, tag) if not (before or walk.skipped) else 0.0 if before else weight["word apart"]
            seen.append("")
        values.append(value)
    run = best_run(values)
    begin, end = whole(run, spans, words)
    blocks: list[str] = []
    parts: list[str] = []

    def close() -> None:
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            blocks.append(text)
        parts.clear()

    for i in range(begin, end):
        kind, name, _ = found[i]
        if kind == "text":
            # beside the run itself, lists of links are menus more often than not
            if seen[i] in ("word", "word of a linked text") or seen[i] == "word of a link" and run[0] <= i < run[1]:
                parts.append(name)
        elif name in BLOCKS:
            close()
        elif name in ("br", "td", "th", "img"):
            parts.append(" ")
    close()
    return between.join(blocks)


def main_texts(pages: DataFrame, between: str = BETWEEN) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, urls, htmls in columns_of(batches, "page_id", "url", "html"):
            texts = [extract(h, between) for h in htmls]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    bounded_batches(pages.sparkSession)
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    return plain.mapInArrow(rows, "page_id long, url string, text string, n_chars long")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
