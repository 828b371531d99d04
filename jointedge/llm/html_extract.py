"""Main text of web pages by tag-path ratios.

A page is read once into blocks of text, each with its root-to-leaf tag path. Per path, text length and punctuation per
block are added up, smoothed over paths that follow one another, fused into one score (reduced by the share of link
text) and compared with a threshold; blocks on the paths above it are the content. Elements that the standard sets apart (navigation,
footers, forms, scripts, hidden ones ...) are no candidates.

What a page says of its parts are terms of the score, in doublings of it: the marked article (of several, those with the most unlinked text)
raises its paths, so that short lines inside stay, and lesser ones, as teasers are, lower theirs; but a path of several blocks without a tenth of the
threshold goes, as a list of links in the article. A class or id that is made of noise words only (``post-comments``,
``ad-slot``) weighs against the blocks inside, and one that says more (``legal-news``, ``share-price``) a little. Against that stands the share of the
page's text that such an element holds: what holds nearly all of it is the story, whatever its name.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

# Element names of the HTML standard by role, and words that sites put in class, id and role attributes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe textarea title xmp noembed noframes svg math object select datalist canvas audio video".split())
BOILERPLATE = frozenset("nav footer aside form button dialog menu head".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
CELLS = frozenset("td th".split())
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
MARKED = frozenset("article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay "
    "sidebar sidebars rail menu menus nav navbar navigation breadcrumb breadcrumbs footer footers masthead comment comments commentlist disqus respond replies share sharing social "
    "related recommended recommendations newsletter subscribe subscription login signin signup pagination pager widget widgets toolbar copyright legal".split()
)
UNLESS = frozenset("has with no without".split())
#: Words that add nothing to a name.
NEUTRAL = frozenset(
    "area bar block body bottom box btn button close col column container content entry fixed footer form group header heading icon id inner item items js left link links list main module page panel post row section site slot "
    "sticky tab text thread title top unit wrap wrapper zone right style widget".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 html body".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
_WORD = re.compile(r"[a-z]+|\d+")
_PUNCTUATION = re.compile(r"[.,;:!?¡¿、。，！？…]")


#: Doublings of the score: for the story's mark and against lesser ones, against names of noise and against names that also hold a noise word.
MARK, NOISY, DOUBTFUL = 3.0, 5.0, 1.0
#: A path's ratio counts from a tenth of the threshold to four times it; an element named noise wins back what its share of the text is over half.
LEAST, MOST, WHOLE = 0.1, 4.0, 10.0
LIST = 3  # blocks of a path that make it a list


def _set_apart(tag: str, rest: str, marked: bool) -> bool:
    """Whether an element is no content by its tag, its role, or because it is hidden."""
    if tag in BOILERPLATE or tag == "header" and not marked:
        return True
    if not rest.strip() or tag in HEADINGS or tag in MARKED and not marked:
        return False
    for key, *values in _ATTRIBUTE.findall(rest):
        key, value = key.lower(), "".join(values).lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if key == "role" and value.strip() in ROLES:
            return True
    return False


def _doubt(tag: str, rest: str, marked: bool) -> float:
    """How much an element's names speak against it. A noise word counts wherever it stands, but not in names like ``has-sidebar``, which tell of something else."""
    out = 0.0
    if not rest.strip() or tag in HEADINGS or tag in MARKED and not marked:
        return out
    for key, *values in _ATTRIBUTE.findall(rest):
        if key.lower() in ("class", "id"):
            for name in "".join(values).lower().split():
                words = set(_WORD.findall(name))
                if words & NOISE and not words & UNLESS:
                    rest_ = {w for w in words - NOISE - NEUTRAL if not w.isdigit() and len(w) > 1}
                    out = max(out, DOUBTFUL if rest_ else NOISY)
    return out


class Open:
    """The open elements of a page. Each knows the number of its path, whether it is set apart, the marked article and the named noise that it is in."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, bool, int, int]] = []  # tag, path, apart, article and noise (0: none)
        self.count: dict[str, int] = {}
        self.paths: dict[tuple[int, str], int] = {}
        self.articles, self.doubts = 0, [0.0]
        self.path, self.noisy, self.article, self.noise = 0, False, 0, 0

    def push(self, tag: str, rest: str) -> None:
        noisy = self.noisy or _set_apart(tag, rest, self.article > 0)
        if not noisy and (doubt := _doubt(tag, rest, self.article > 0)) > self.doubts[self.noise]:
            self.doubts.append(doubt)
            self.noise = len(self.doubts) - 1
        step = tag
        if tag in MARKED and not noisy:
            self.articles += 1
            self.article, step = self.articles, f"{tag} {self.articles}"  # each has paths of its own
        if self.noise and self.noise == len(self.doubts) - 1 and (not self.stack or self.stack[-1][4] != self.noise):
            step = f"{step} !{self.noise}"  # and so has each named noise
        if tag not in INLINE:
            self.path = self.paths.setdefault((self.path, step), len(self.paths) + 1)
        self.noisy = noisy
        self.stack.append((tag, self.path, self.noisy, self.article, self.noise))
        self.count[tag] = self.count.get(tag, 0) + 1

    def pop(self, depth: int) -> None:
        for tag, *_ in self.stack[depth:]:
            self.count[tag] -= 1
        del self.stack[depth:]
        self.path, self.noisy, self.article, self.noise = self.stack[-1][1:] if self.stack else (0, False, 0, 0)

    def last(self, tag: str) -> int:
        """The depth of the innermost open element of a tag, or -1; only what a close then removes is looked at."""
        if not self.count.get(tag):
            return -1
        return next(i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == tag)


Block = tuple[str, int, int, int, int]


def blocks(html: str) -> tuple[list[Block], list[float]]:
    """Text, number of its tag path, length of its link text, its innermost marked article and its named noise (0: none) of each candidate block in page order; and the doubt of each noise."""
    out: list[Block] = []
    held = Open()
    parts: list[str] = []
    links: list[str] = []
    at, size = 0, len(html)

    def flush() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                linked = len(" ".join(entities.unescape("".join(links)).split()))
                out.append((text, held.path, linked, held.article, held.noise))
            parts.clear()
        links.clear()

    while at < size:
        m = _TOKEN.search(html, at)
        if m is None:
            if not held.noisy:
                parts.append(html[at:])
            break
        if m.start() > at and not held.noisy:
            piece = html[at : m.start()]
            parts.append(piece)
            if held.count.get("a"):
                links.append(piece)
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if tag is None:
            if m["cdata"] and not held.noisy:
                parts.append(entities.escape(m["cdata"]))
            continue
        tag, rest = tag.lower(), m["rest"] if m["tag"] else m["rest2"]
        if m["close"] or m["close2"]:
            depth = held.last(tag)
            if depth < 0:
                continue
            if tag in CELLS:
                parts.append(" ")
            if any(t not in INLINE and t not in CELLS for t, *_ in held.stack[depth:]):
                flush()
            held.pop(depth)
        elif tag in RAW:
            end = _END[tag].search(html, at)
            if rest.endswith("/") and tag in ("svg", "math"):
                continue
            close = html.find(">", end.end()) if end else -1
            at = close + 1 if close >= 0 else size
        elif tag == "br" or tag == "wbr" or tag in VOID:
            if tag == "hr":
                flush()
            elif tag != "wbr":
                parts.append(" ")
        else:
            if tag in CELLS:
                parts.append(" ")
            elif tag not in INLINE:
                flush()
            closes = {"p"} if tag in ENDS_P else SAME.get(tag, ())
            if any(held.count.get(t) for t in closes):
                for depth in range(len(held.stack) - 1, -1, -1):
                    if held.stack[depth][0] in closes:
                        held.pop(depth)
                        break
                    if held.stack[depth][0] not in INLINE and held.stack[depth][0] not in CELLS:
                        break
            if not rest.endswith("/") or tag not in INLINE:
                held.push(tag, rest)
    flush()
    return out, held.doubts


def path_scores(found: list[Block]) -> dict[int, float]:
    """The fused, smoothed ratio of each path: text length and punctuation per block, less link text."""
    total: dict[int, list[float]] = {}
    for text, path, linked, *_ in found:
        t = total.setdefault(path, [0, 0, 0, 0])
        for i, x in enumerate((1, len(text), len(_PUNCTUATION.findall(text)), linked)):
            t[i] += x
    ratio = [(n / k, p / k, max(0.0, 1 - link / n)) for k, n, p, link in total.values()]
    smooth = []
    for i in range(len(ratio)):
        near = [(ratio[j], 0.5 if j == i else 0.25) for j in (i - 1, i, i + 1) if 0 <= j < len(ratio)]
        weight = sum(w for _, w in near)
        size, points = (sum(r[k] * w for r, w in near) / weight for k in (0, 1))
        smooth.append((size * (1 + points)) ** 0.5 * ratio[i][2])
    return dict(zip(total, smooth))


def stories(found: list[Block]) -> set[int]:
    """The marked articles with the most unlinked text, or at least half as much."""
    size: dict[int, int] = {}
    for text, _, linked, article, _ in found:
        if article:
            size[article] = size.get(article, 0) + len(text) - linked
    return {k for k, n in size.items() if 2 * n >= max(size.values())}


def main_text(html: str | None, threshold: float = 0.3) -> str:
    """The content blocks, two newlines apart; empty for a null or empty page.

    A path is content if its score, raised and lowered by what the page says of it, reaches ``threshold`` times the mean over all text that no noise is named for.
    """
    found, doubts = blocks(html or "")
    if not found:
        return ""
    doubted = [0] * len(doubts)
    for text, _, linked, _, noise in found:
        doubted[noise] += len(text) - linked
    size = max(1, sum(doubted))
    # what a page names noise weighs less the more of the page it is, unless a marked article stands beside it
    inside = {noise for *_, article, noise in found if article} if any(b[3] for b in found) else set(range(len(doubts)))
    against = [max(0.0, d - WHOLE * max(0.0, 2 * n / size - 1)) if k in inside else d for k, (d, n) in enumerate(zip(doubts, doubted))]
    plain = [b for b in found if against[b[4]] < NOISY] or found
    apart = [b for b in found if against[b[4]] >= NOISY] if len(plain) < len(found) else []
    score, marked = path_scores(plain) | (path_scores(apart) if apart else {}), stories(plain)
    bar = threshold * sum(len(b[0]) * score[b[1]] for b in plain) / sum(len(b[0]) for b in plain)

    listed = Counter(b[1] for b in found)

    def stands(block: Block) -> bool:
        ratio = score[block[1]] / bar if bar else 1.0
        if ratio < LEAST and (block[3] not in marked or listed[block[1]] >= LIST):
            return False
        mark = MARK if block[3] in marked else -MARK if block[3] else 0.0
        if against[block[4]] >= NOISY:
            mark = min(mark, 0.0)  # a story's mark does not speak for the noise inside it
        return math.log2(max(LEAST * 2, min(ratio, MOST))) + mark - against[block[4]] >= 0

    return "\n\n".join(b[0] for b in found if stands(b))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of the main text for each row of ``pages``; see ``main_text``.

    Rows that repeat each give a row. Other columns are not read.
    """

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h.as_py()) for h in batch.column(2)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    page = pages.schema["page_id"].dataType.simpleString()
    return map_batches(pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")), each, f"page_id {page}, url string, text string, n_chars long")
