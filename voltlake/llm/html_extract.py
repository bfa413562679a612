"""Main text of web pages.

A page is cut into flat text blocks at block-level tags. A block is described by its words and link density, those
of its neighbours, and what the open tags around it say, and a decision tree tells text from boilerplate. What tags
say is evidence and no verdict: a class name is weighed against the words and links it encloses and the text of the
page outside all such names. The tree is trained here on a small labelled table: the blocks of raw pages rendered
from LAYOUTS with many lengths.

Edge cases: a null or empty page, and one without text, gives an empty text; tags left open or closed twice are
tolerated (a closing tag closes the nearest such tag, else nothing); comments, scripts and styles left open end with
the page; a quote left open is a character; character references are decoded once; parsing takes time in proportion
to the page, whatever its tags; page ids and other columns may be null or repeated and are passed on; columns named
text or n_chars are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import html as html_lib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, read

#: Element names of the HTML standard, and words that class names and ids use.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas", "xmp")
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHROME = frozenset("nav aside footer head button select fieldset menu dialog datalist option".split())
#: Chrome elements that don't hold a page's article: one opened within means they were left open, or span the page.
SHUT = frozenset("nav header footer form button select menu".split())
MAIN = frozenset("article main".split())
NAMES = re.compile(
    r"(?:^|[-_\s])(?:ads?|ads\d+|adsbygoogle|adv|advert\w*|alerts?|announcements?|breadcrumbs?|comments?|commentlist|comment\w*|consent|cookies?|cookie\w*|disqus|footer|footnav|gdpr|menu|modal|nav|navbar|navigation|newsletter|notices?|notifications?|pagination|pager|popup|promo\w*|reader-?comments|recommended|related|replies|reply|respond|share|sharing|sidebar|signup|skip\w*|sponsor\w*|subscribe|subscription|toolbar|topbar|widgets?|paywall|overlay)(?:$|[-_\s])", re.I,
)
#: Names that an article's own parts have too.
WEAK_NAMES = re.compile(r"(?:^|[-_\s])(?:banner|byline-links|copyright|disclaimer|header|legal|login|masthead|rail|search|side|social|tags)(?:$|[-_\s])", re.I)
#: Names of a layout, not of what an element holds: has-sidebar, no-comments.
LAYOUT_NAMES = re.compile(r"(?:^|(?<=\s))(?:has|with|no|show|hide)[-_]\S+", re.I)
MAIN_NAMES = re.compile(r"(?:^|[-_\s])(?:article|content|entry|story|post|main|body-?text|article-?body|post-?body|entry-?content|text|prose)(?:$|[-_\s])", re.I)
CHROME_ROLES = frozenset("navigation banner complementary contentinfo search alert dialog form menu menubar toolbar".split())
BREAKS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul li".split())
TEXT_TAGS = frozenset("p li blockquote pre dd dt figcaption h1 h2 h3 h4 h5 h6".split())

_ATTRS = r"(?:[^<>\"']|\"[^\"]*\"|'[^']*'|[\"'])*(?:>|(?=<)|\Z)"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")\b" + _ATTRS + r"(?:.*?(?:</(?P=raw)[^<>]*(?:>|(?=<)|\Z)|\Z))|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/<>]*)(?P<attrs>" + _ATTRS + ")", re.I | re.S,
)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|$|=|>)", re.I)
#: Evidence against a block, by the strongest open tag around it.
PLAIN, WEAK, NAMED, ELEMENT, HIDDEN = range(5)
FEATURES = (
    "words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "words_around", "link_density_around",
    "evidence", "region_words", "region_link_density", "plain_share", "main", "page_main", "heading", "text_tag",
)


@dataclass
class Block:
    text: str
    words: int
    linked: int
    evidence: int
    region: int  # the outermost element with that evidence, by its number on the page
    main: int  # 2 within a main element, 1 within one so named
    heading: bool
    text_tag: bool

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


def _says(name: str, attrs: str, within_main: bool) -> tuple[int, int]:
    """(evidence, main) of a tag."""
    evidence = ELEMENT if name in CHROME or name == "header" and not within_main else NAMED if name == "form" else PLAIN
    main = 2 if name in MAIN else 0
    if "=" in attrs:
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                value = LAYOUT_NAMES.sub("", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value))
                if name not in ("body", "html", "main"):
                    if NAMES.search(value):
                        evidence = max(evidence, NAMED)
                    elif WEAK_NAMES.search(value):
                        evidence = max(evidence, WEAK)
                if MAIN_NAMES.search(value):
                    main = max(main, 1)
            elif key == "role":
                evidence, main = max(evidence, NAMED if value.lower() in CHROME_ROLES else PLAIN), 2 if value.lower() in ("main", "article") else main
            elif key == "style" and "display:none" in value.replace(" ", "").lower() or key == "aria-hidden" and value.lower() == "true":
                evidence = HIDDEN
    if "hidden" in attrs.lower() and _HIDDEN.search(re.sub(r"\"[^\"]*\"|'[^']*'", "", attrs)):
        evidence = HIDDEN
    return evidence, 0 if evidence >= NAMED else main


class _Open:
    """The open tags, by name and by what they say; each operation takes constant time on average."""

    def __init__(self):
        self.tags: list[tuple[str, int, int]] = []
        self.named: dict[str, list[int]] = {}
        self.evidence: list[list[tuple[int, int]]] = [[] for _ in range(HIDDEN + 1)]  # (place, region number), outermost first
        self.mains = [0, 0, 0]
        self.regions = 0

    def push(self, name: str, evidence: int, main: int) -> None:
        self.named.setdefault(name, []).append(len(self.tags))
        if evidence:
            self.regions += 1
            self.evidence[evidence].append((len(self.tags), self.regions))
        self.mains[main] += 1
        self.tags.append((name, evidence, main))

    def pop_to(self, place: int) -> None:
        while len(self.tags) > place:
            name, evidence, main = self.tags.pop()
            self.named[name].pop()
            self.mains[main] -= 1
            if evidence and self.evidence[evidence] and self.evidence[evidence][-1][0] == len(self.tags):
                self.evidence[evidence].pop()

    def close(self, name: str) -> None:
        if self.named.get(name):
            self.pop_to(self.named[name][-1])

    def acquit_shut(self) -> None:
        """An article opened within: what SHUT elements around it say counts no more."""
        for level in (WEAK, NAMED, ELEMENT):
            if self.evidence[level]:
                self.evidence[level] = [x for x in self.evidence[level] if self.tags[x[0]][0] not in SHUT]

    @property
    def within_main(self) -> int:
        return 2 if self.mains[2] else 1 if self.mains[1] else 0

    def verdict(self) -> tuple[int, int]:
        for level in (HIDDEN, ELEMENT, NAMED, WEAK):
            if self.evidence[level]:
                return level, self.evidence[level][0][1]
        return PLAIN, 0


def blocks(page: str | None) -> list[Block]:
    """The text blocks of a page in order."""
    page, out, parts, linked, opened = page or "", [], [], 0, _Open()
    link, at = False, 0

    def text(piece: str) -> None:
        nonlocal linked
        if piece:
            if "&" in piece:
                piece = html_lib.unescape(piece)
            parts.append(piece)
            if link:
                linked += len(piece.split())

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            found = "".join(parts).split()
            if found:
                own = opened.tags[-1][0] if opened.tags else ""
                out.append(Block(" ".join(found), len(found), min(linked, len(found)), *opened.verdict(), opened.within_main, own[0:1] == "h" and own[1:].isdigit(), own in TEXT_TAGS))
            parts, linked = [], 0

    for m in _TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            if m["raw"] and m["raw"].lower() in ("title", "textarea"):
                flush()
            continue
        name = name.lower()
        if name == "br":
            parts.append(" ")
            continue
        if name == "a":
            link = not m["close"]
            continue
        if name in INLINE and name != "label":
            continue
        flush()
        if m["close"]:
            opened.close(name)
            continue
        if name in BREAKS_P:
            link = False
            if opened.tags and opened.tags[-1][0] == "p":
                opened.pop_to(len(opened.tags) - 1)
        attrs = m["attrs"].rstrip(">")
        if name in VOID or attrs.endswith("/") and name not in BREAKS_P:
            continue
        if name in MAIN:
            opened.acquit_shut()
        opened.push(name, *_says(name, attrs, opened.within_main > 0))
    text(page[at:])
    flush()
    return out


def describe(found: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block."""
    near = [(0, 0.0)] * 2 + [(b.words, b.density) for b in found] + [(0, 0.0)] * 2
    regions: dict[int, list[int]] = {0: [0, 0]}
    for b in found:
        if b.evidence:
            own = regions.setdefault(b.region, [0, 0])
            own[0] += b.words
            own[1] += b.linked
    plain = sum(b.words for b in found if not b.evidence) / max(1, sum(b.words for b in found))
    page_main = max((b.main for b in found if b.evidence < NAMED), default=0)
    rows = []
    for i, b in enumerate(found):
        around = near[i : i + 2] + near[i + 3 : i + 5]
        words = sum(w for w, _ in around)
        region, region_linked = regions[b.region if b.evidence else 0]
        rows.append((b.words, b.density, *near[i + 1], *near[i + 3], words, sum(w * d for w, d in around) / max(1, words), b.evidence, region, region_linked / max(1, region), plain, b.main, page_main, b.heading, b.text_tag))
    return np.array(rows, float).reshape(len(found), len(FEATURES))


# --- the tree


@dataclass(frozen=True)
class Node:
    keep: float
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None


def grow(x: np.ndarray, y: np.ndarray, depth: int = 10, least: int = 10) -> Node:
    """A tree by Gini impurity; cuts lie halfway between values."""
    keep = float(y.mean()) if len(y) else 0.0
    best = (1e-9, -1, 0.0)
    if depth and 0 < keep < 1:
        for j in range(x.shape[1]):
            order = np.argsort(x[:, j], kind="stable")
            v, s = x[order, j], np.cumsum(y[order])
            n = np.arange(1, len(y) + 1)
            at = np.flatnonzero(v[1:] > v[:-1])
            at = at[(n[at] >= least) & (len(y) - n[at] >= least)]
            if len(at):
                p, q = s[at] / n[at], (s[-1] - s[at]) / (len(y) - n[at])
                gain = keep * (1 - keep) - (n[at] * p * (1 - p) + (len(y) - n[at]) * q * (1 - q)) / len(y)
                k = int(gain.argmax())
                if gain[k] > best[0] + 1e-12:
                    best = (float(gain[k]), j, float(v[at[k]] + v[at[k] + 1]) / 2)
    if best[1] < 0:
        return Node(keep)
    low = x[:, best[1]] <= best[2]
    return Node(keep, best[1], best[2], grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least))


def decide(node: Node, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), bool)
    work = [(node, np.arange(len(x)))]
    while work:
        n, at = work.pop()
        if n.feature < 0:
            out[at] = n.keep > 0.5
        elif len(at):
            low = x[at, n.feature] <= n.cut
            work += [(n.low, at[low]), (n.high, at[~low])]
    return out


# --- the labelled table: parts are (html with {} for words, fewest words, most words, keep)

_LINKS = "".join('<li><a href="/{0}">{{}}</a></li>'.format(i) for i in range(4))
_TITLE, _P, _SHORT = ("<h1>{}</h1>", 2, 14, True), ("<p>{}</p>", 20, 90, True), ("<p>{}</p>", 1, 8, True)
_ARTICLE = [
    _TITLE, _P, _SHORT, ("<p>{} <a href='/x'>{}</a> {}</p>", 4, 20, True), ("<h2>{}</h2>", 1, 8, True), _P, _SHORT, ("<ul><li>{}</li><li>{}</li></ul>", 1, 15, True), ("<blockquote>{}</blockquote>", 4, 30, True),
    ("<p><a href='/y'>{}</a></p>", 1, 8, True), ("<figure><figcaption>{}</figcaption></figure>", 2, 14, True), ("<p class='legal'>{}</p>", 12, 60, True), ("<table><tr><td>{}</td><td>{}</td></tr></table>", 1, 6, True),
    ("<div class='side-story'><p>{}</p><p>{}</p></div>", 20, 60, True), _P,
]
_MENU, _FOOT, _AD = ("<nav><ul>" + _LINKS + "</ul></nav>", 1, 3, False), ("<footer>&copy; {}</footer>", 2, 30, False), ("<div class='ad'>{}</div>", 1, 30, False)
_COMMENTS = ("<section class='comments'><h3>{}</h3><p>{}</p><div class='comment'><p>{}</p></div></section>", 1, 60, False)
_CHROME = [
    _MENU, _AD, ("<div class='cookie-notice'><p>{}</p></div>", 5, 40, False), _FOOT, ("<aside><h3>{}</h3><p>{}</p></aside>", 2, 40, False), ("<form><label>{}</label><button>{}</button></form>", 1, 6, False), ("<header class='site-header'><p>{}</p></header>", 1, 10, False),
    ("<div id='sidebar'><h3>{}</h3><p>{}</p></div>", 3, 50, False), _COMMENTS, ("<div class='newsletter-signup'>{}</div>", 3, 25, False), ("<div role='alert'>{}</div>", 3, 25, False), ("<div class='related'><ul>" + _LINKS + "</ul></div>", 2, 9, False),
    ("<div class='share'><a href='/s'>{}</a></div>", 1, 3, False), ("<div class='social'>{}</div>", 1, 6, False), ("<div class='legal'><p>{}</p></div>", 5, 40, False), ("<p hidden>{}</p>", 3, 40, False), ("<div style='display:none'>{}</div>", 3, 40, False),
]
_OUTSIDE = [("<div><p>{}</p></div>", 5, 40, False), ("<div>{}</div>", 1, 8, False), ("<div>{}</div>", 20, 60, False), ("<p>{}</p>", 3, 20, False), ("<h3>{}</h3>", 1, 6, False)]
#: Pages without any marked part: only words, links and neighbours tell.
_BARE_LINKS = [("<div><a href='/a'>{}</a> <a href='/b'>{}</a> <a href='/c'>{}</a></div>", 1, 3, False), ("<ul>" + _LINKS + "</ul>", 1, 4, False), ("<table><tr><td><a href='/c'>{}</a></td><td><a href='/d'>{}</a></td></tr></table>", 1, 4, False), ("<div><a href='/l'>{}</a></div>", 4, 25, False)]
_BARE_SMALL = ("<div>{}</div>", 1, 8, False)
_BARE_DIVS = [("<div>{}</div>", 25, 90, True), ("<div>{}</div>", 2, 8, True), ("<div>{}</div>", 25, 90, True), ("<div>{}</div>", 18, 60, True)]
_BARE_TEXT = [_TITLE, ("<p>{}</p>", 8, 30, True), _SHORT, _P, ("<h2>{}</h2>", 1, 6, True), _P, _SHORT]
#: (before, within, after, wrapper).
LAYOUTS = [
    ([_MENU, _AD], _ARTICLE, [_FOOT], "<article>{}</article>"),
    (_CHROME[:3], _ARTICLE[::-1], _CHROME[3:9], "<main>{}</main>"),
    (_CHROME[6:8], [*_ARTICLE[:4], _AD, *_ARTICLE[4:], _COMMENTS], _CHROME[9:], "<article class='post'>{}</article>"),
    (_CHROME[2:5], [*_ARTICLE, _CHROME[5], _CHROME[10], _CHROME[11]], [_FOOT], "<div id='content'>{}</div>"),
    (_CHROME[5:], [_P, _SHORT, _CHROME[4], _P, _CHROME[9], _CHROME[12]], _CHROME[:5], "<div class='entry-content'>{}</div>"),
    ([*_OUTSIDE, *_CHROME], _ARTICLE, [*_OUTSIDE, *_CHROME], "<article>{}</article>"),
    (_OUTSIDE, [*_ARTICLE, *_CHROME[15:]], [*_OUTSIDE, _FOOT], "<main id='main'>{}</main>"),
    ([_MENU], [("<header><h1>{}</h1></header>", 2, 12, True), *_ARTICLE[1:]], [*_OUTSIDE, *_CHROME[13:]], "<article>{}</article>"),
    (_BARE_LINKS, _BARE_TEXT, [], "{}"),
    ([], _BARE_TEXT[:3], [], "{}"),
    ([], _BARE_TEXT, [*_BARE_LINKS, ("<p>{}</p>", 1, 8, False)], "{}"),
    ([_BARE_SMALL, *_BARE_LINKS, _BARE_SMALL], _BARE_DIVS, [*_BARE_LINKS, _BARE_SMALL, _BARE_LINKS[0]], "{}"),
    ([*_BARE_LINKS[:2], _MENU], _BARE_DIVS, [_BARE_LINKS[3], _BARE_SMALL, _FOOT], "<div>{}</div>"),
    (_CHROME, _BARE_TEXT, _CHROME, "{}"),
    (_CHROME[:5], _BARE_TEXT, [_COMMENTS, *_CHROME[11:15], _COMMENTS], "<div class='wrapper'>{}</div>"),
    ([_MENU], [*_BARE_TEXT, _P], [_BARE_LINKS[1]], "<div class='widget-area'>{}</div>"),
    ([_MENU], [*_BARE_TEXT, _P], [_CHROME[5]], "<form>{}</form>"),
    ([*_BARE_LINKS[:1]], [*_BARE_TEXT, _P], [_FOOT], "<div class='page-header'>{}</div>"),
]
RENDERINGS, WORD = 24, re.compile(r"(x|k)w\d+")


def render(layout, rng: np.random.Generator) -> str:
    """A raw page of a layout; words that are to be kept start with k, others with x."""
    before, within, after, wrapper = layout

    def fill(parts) -> str:
        out = []
        for shape, least, most, keep in parts:
            words = (" ".join(f"{'k' if keep else 'x'}w{j}" for j in range(int(rng.integers(least, most + 1)))) for _ in range(shape.count("{}")))
            out.append(shape.format(*words))
        return "".join(out)

    some = lambda parts: [x for x in parts if rng.random() < 0.8]
    return "<html><head><title>t</title></head><body>" + fill(some(before)) + wrapper.replace("{}", fill(some(within) or within)) + fill(some(after)) + "</body></html>"


def labelled(layouts=LAYOUTS, renderings: int = RENDERINGS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """FEATURES and labels of the blocks of pages rendered from layouts."""
    rng, xs, ys = np.random.default_rng(seed), [], []
    for layout in layouts:
        for _ in range(renderings):
            found = blocks(render(layout, rng))
            xs.append(describe(found))
            ys += [WORD.search(b.text)[1] == "k" for b in found]
    return np.concatenate(xs), np.array(ys, bool)


@functools.cache
def tree() -> Node:
    return grow(*labelled())


def main_text(page: str | None, node: Node | None = None) -> str:
    found = blocks(page)
    if not found:
        return ""
    kept = decide(node or tree(), describe(found))
    return "\n".join(b.text for b, k in zip(found, kept.tolist()) if k)


def extract(df: DataFrame, html_col: str = "html") -> DataFrame:
    """df without html_col, with text and its n_chars. The tree is trained on the driver and goes with the task."""
    columns, node = [c for c in df.columns if c not in ("text", "n_chars", html_col)], tree()

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py(), node) for x in batch.column(len(columns))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*columns, "text", "n_chars"])

    return map_arrow(df.select(*columns, F.col(html_col).alias("__html")), run, "text string, n_chars long", columns)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
