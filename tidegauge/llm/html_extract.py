"""Main text of web pages: the contiguous region of tokens with the greatest sum of scores.

A page is cut into words and tags in one pass. Weights are learned from labelled pages, those whose markup holds exactly
one ``article`` or ``main`` element. A tag costs what its log-odds to stand in it lack. A word is worth 1, and less, down
to -1, if the word, the class of the element around it, or standing in a link only, is seen on more labelled pages outside
than inside (menus, adverts and other parts taken out count as outside). Where a page itself marks its text, by one
``article``, else by ``main``, else by several articles, words in it are worth 1, words around it -1, and its tags cost
nothing; the mark counts if no more words stand before the marked text than in it, and articles inside an article go unless
one has more words than the article around it. A linear scan finds the contiguous
region of greatest sum. What never is main text is taken out before the scan:
scripts, styles, forms, menus, headers, footers, asides, and elements whose class, id or role names an advert, a notice,
a sidebar, a menu, or readers' comments. A class or id counts as a whole word: a name, or names with a place or a shape
(``sidebar-left``), but not ``no-sidebar`` or ``related-work``. An element that holds an ``article`` or ``main`` element
is not taken out for its class or id; one named after comments, replies or related texts, which are articles too, only
stays if the page has no other article or main.

Text: character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined by
one space; inline tags separate nothing.

Defined cases: a null or empty page gives an empty text, and so does one without words outside the parts taken out.
Unclosed and stray tags are allowed; a part that is never closed ends with the element around it, ``svg`` and ``math``
also before the next HTML element, and only ``script``, ``style``, ``textarea`` and ``title`` go on to the end of the
page. A quoted value that is never closed reaches to the end of the page too. Pages of any length and depth of nesting
are taken whole, in linear time. Of equal regions the first counts. Repeated rows give repeated results. Extra columns are dropped unless named in ``keep``.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

TRAIN_PAGES = 500
#: Least cost of a tag, and the weight of a tag that no labelled page has.
LEAST_TAG, DEFAULT_TAG = 0.02, -0.3
#: Labelled pages that must hold a word, class or link outside before it loses weight; the weight of words around a
#: marked text, which is the least a word can have.
LEAST_PAGES, OUTSIDE = 5, -1.0
#: Bits of a place: in a main element, in an article, in an article inside an article.
MAIN, ARTICLE, NESTED = 1, 2, 4

# Fixed values of the HTML standard and common names of page parts.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title".split())
#: Also raw, but a page that never closes one goes on.
CLOSED_RAW = frozenset("iframe noembed noframes xmp".split())
FOREIGN = frozenset(("svg", "math"))
#: Start tags in these leave open paragraphs around them alone, and so do theirs.
APART = FOREIGN | {"template", "noscript", "iframe", "noembed", "noframes"}
#: HTML elements that end an ``svg`` or ``math`` element left open, and the elements in these that may hold them.
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr "
    "ol p pre ruby s small span strong strike sub sup table tt u ul var article main section header footer nav aside".split()
)
HOLDS_HTML = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
PARTS = frozenset(
    "head nav header footer aside form button select option dialog menu script style noscript template iframe noembed "
    "noframes textarea title svg math xmp object audio video canvas".split()
)
SILENT = frozenset("script style template noscript".split())
HEADER_PARENTS = frozenset(("article", "main", "section"))
NAMES = frozenset(
    "ad ads adv advert advertisement advertising adsense banner promo promoted promotion sponsor sponsored sponsoring "
    "sidebar side widget widgets nav navbar navigation menu breadcrumb breadcrumbs footer header masthead topbar "
    "toolbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended recommendations comment comments disqus "
    "discussion replies respond pagination pager skip copyright legal disclaimer".split()
)
#: Of these, the ones whose articles are other texts than the page's.
LISTS = frozenset(
    "related recommended recommendations comment comments disqus discussion replies respond".split()
)
#: What may stand beside a name in a class of several words: a place, a shape, a kind of list.
BESIDE = frozenset(
    "left right top bottom upper lower center fixed sticky floating primary secondary main sub mobile desktop page site "
    "global box block area section container wrapper wrap inner outer holder panel pane bar row column col group item "
    "items list lists link links button buttons btn icon icons title heading form label text slot unit zone div gpt dfp "
    "google x posts articles stories thread count reply".split()
)
#: Readers' comments named by who speaks and what that is: a class needs one of each.
SPEAKERS = frozenset("user users reader readers visitor visitors member members guest guests audience customer public".split())
SAYINGS = frozenset(
    "opinion opinions say says said feedback reaction reactions response responses remark remarks thought thoughts voice "
    "voices letter letters post posts reply answer answers review reviews submitted".split()
)
#: Microdata types and properties of readers' comments.
COMMENT_TYPES = frozenset(("comment", "usercomments"))
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar toolbar".split())
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"},
}
SCOPE = APART | set("ul ol dl table select body html article main section div aside nav header footer form".split())

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)"
    # a quote counts behind an equals sign only, and one that is never closed reaches to the end
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=(?:\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)))?)*+)(?:>|\Z)",
    re.S,
)
# Attributes one after another, so that what a value holds is never taken for an attribute.
_ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_PIECE = re.compile(r"[a-z]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in RAW | CLOSED_RAW}


#: Weight of a word; of tags; of lower-cased words, of ``.class`` words and of ``LINK``, for words that stand in links only.
Weights = tuple[float, dict[str, float]] | tuple[float, dict[str, float], dict[str, float]]
#: No word has a blank.
LINK = " link"

#: Whether an element is taken out: for what it is, for its class or id, or for one that names a list of other texts.
KEPT, CUT, NAMED, LISTED = range(4)


def _named(value: str) -> int:
    found = KEPT
    for word in value.split():
        pieces = _PIECE.findall(word)
        own = {p for p in pieces if p not in BESIDE or p in SAYINGS}
        if own & SPEAKERS and own & SAYINGS and own <= SPEAKERS | SAYINGS | NAMES:
            return LISTED
        if any(p in NAMES for p in pieces) and all(p in NAMES or p in BESIDE for p in pieces):
            found = max(found, LISTED if any(p in LISTS for p in pieces) else NAMED)
    return found


class _Stack:
    """Open elements. Every question is answered without a walk over them, so a page of any depth takes linear time."""

    def __init__(self):
        #: Name, why it is unwanted, where it starts, the outermost svg or math whose content it holds, the nearest scope,
        #: its place, the class words of the nearest element that has any.
        self.items: list[tuple[str, int, int, int, int, int, str]] = []
        self.places: dict[str, list[int]] = {}

    def __len__(self) -> int:
        return len(self.items)

    @property
    def why(self) -> int:
        return self.items[-1][1] if self.items else KEPT

    @property
    def foreign(self) -> int:
        return self.items[-1][3] if self.items else -1

    @property
    def place(self) -> int:
        return self.items[-1][5] if self.items else 0

    @property
    def classes(self) -> str:
        return self.items[-1][6] if self.items else ""

    def last(self, *names: str) -> int:
        """The innermost open element of some names, -1 if there is none."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def in_scope(self, names: set[str]) -> int:
        """The same, if no element that shields what is open around it lies further in."""
        k = self.last(*names)
        return k if k >= 0 and self.items[-1][4] <= k else -1

    def push(self, name: str, why: int, start: int, classes: str = "") -> None:
        here = len(self.items)
        foreign = self.foreign
        if name in HOLDS_HTML:
            foreign = -1
        elif foreign < 0 and name in FOREIGN:
            foreign = here
        scope = here if name in SCOPE else self.items[-1][4] if self.items else -1
        place = self.place
        if not why:
            if name == "main":
                place |= MAIN
            elif name == "article":
                place |= NESTED if place & ARTICLE else ARTICLE
        self.items.append((name, why, start, foreign, scope, place, classes or self.classes))
        self.places.setdefault(name, []).append(here)

    def pop_to(self, k: int) -> None:
        for name, *_ in self.items[k:]:
            self.places[name].pop()
        del self.items[k:]


def _unwanted(name: str, attributes: str, parents: _Stack) -> int:
    if name in PARTS:
        # the header of an article is a part of it, and holds its title
        return KEPT if name == "header" and parents.last(*HEADER_PARENTS) >= 0 else CUT
    if name in ("html", "body", "article", "main") or not attributes:
        return KEPT
    named = KEPT
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), (value[1:-1] if value[:1] in ("'", '"') else value).lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in ROLES:
            return CUT
        if key == "style" and re.search(r"display\s*:\s*none", value):
            return CUT
        if key in ("class", "id"):
            named = max(named, _named(value))
        if key == "itemprop" and value in COMMENT_TYPES or key == "itemtype" and value.rpartition("/")[2] in COMMENT_TYPES:
            named = LISTED
    return named


def _classes(attributes: str) -> str:
    for key, value in _ATTRIBUTE.findall(attributes):
        if key.lower() == "class":
            return " ".join(sorted(set(value.strip("\"'").lower().split())))
    return ""


#: ``kind`` is ``text``, ``tag``, ``end``, or ``cut`` for text of a part taken out; then the text or name, the place, the
#: class words around a text, and whether a link is open around it.
Token = tuple[str, str, int, str, bool]


def tokens(page: str, cuts: bool = False) -> list[Token]:
    """The page without unwanted parts, or with their texts as ``cut``."""
    named: set[int] = set()
    listed: set[int] = set()
    found = list(_walk(page, frozenset(), named, listed, cuts))
    spared = named or not any(kind == "tag" and value in ("article", "main") for kind, value, *_ in found) and listed
    return list(_walk(page, spared, set(), set(), cuts)) if spared else found


def marked(found: list[Token]) -> int:
    """The places that hold the text by the page's own marks, 0 if it has none to rely on."""
    articles = [place for kind, value, place, *_ in found if kind == "tag" and value == "article" and not place & ARTICLE]
    has_main = any(kind == "tag" and value == "main" for kind, value, *_ in found)
    choices = []
    if len(articles) == 1:
        choices.append(MAIN | ARTICLE if has_main and not articles[0] & MAIN else ARTICLE)
    if has_main:
        choices.append(MAIN)
    if len(articles) > 1:
        choices.append(ARTICLE)
    for mask in choices:
        before = held = 0
        for kind, value, place, *_ in found:
            if kind == "text":
                if place & mask:
                    held += len(value.split())
                elif not held:
                    before += len(value.split())
        if held and held >= before:
            return mask
    return 0


def _walk(
    page: str, spared: set[int] | frozenset[int], named: set[int], listed: set[int], cuts: bool
) -> Iterator[Token]:
    """The tokens, if elements that start at ``spared`` stay whatever their class or id. Adds to ``named`` and ``listed``
    the starts of elements that are left out for theirs and hold an article or main; ``listed``: in a list of others."""
    stack = _Stack()
    at, size = 0, len(page)
    while at < size:
        found = _TOKEN.search(page, at)
        start = found.start() if found else size
        if start > at and (cuts or not stack.why):
            kind = "cut" if stack.why else "text"
            yield kind, page[at:start], stack.place, stack.classes, bool(stack.places.get("a"))
        if not found:
            return
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        hidden = stack.why
        if found[1]:  # an end tag
            k = stack.last(name)
            if k >= 0:
                stack.pop_to(k)
                if not hidden:
                    yield "end", name, stack.place, "", False
            continue
        closed = found[3].rstrip().endswith("/")
        foreign = stack.foreign if hidden else -1
        if foreign >= 0 and name in BREAKOUT:
            stack.pop_to(foreign)
            foreign = -1
        apart = name in APART or name in RAW
        closes = CLOSED_BY.get(name) or ({"p"} if not apart and name not in INLINE and name not in VOID else None)
        if closes and (k := stack.in_scope(closes)) >= 0:
            stack.pop_to(k)
        hidden = stack.why
        if foreign < 0 and (name in RAW or name in CLOSED_RAW):  # what it holds is not markup
            end = _RAW_END[name].search(page, at)
            if end or name in RAW:
                at = end.end() if end else size
                if not hidden and name not in SILENT:
                    yield "end", name, stack.place, "", False
                continue
        own = CUT if hidden == CUT else _unwanted(name, found[3], stack)
        if own >= NAMED and start in spared:
            own = KEPT
        drop = CUT if own == CUT else max(hidden, own)
        if drop >= NAMED and name in ("article", "main"):
            holders = named if drop == NAMED else listed
            for _, why, place, *_ in reversed(stack.items):
                if why < NAMED or place in holders:
                    break
                holders.add(place)
        if not drop:
            yield "tag", name, stack.place, "", False
        elif not hidden and name not in SILENT:  # a part taken out still parts the text around it
            yield "end", name, stack.place, "", False
        if name not in VOID and not closed:
            stack.push(name, drop, start, _classes(found[3]) if found[3] else "")


def without_nested(found: list[Token]) -> list[Token]:
    """The tokens without articles inside an article, if none of these has more words than the article around: by the
    HTML standard they are other texts then, comments above all. A longer one is the article's body."""
    own = longest = nested = 0
    for kind, value, place, *_ in found:
        if kind == "tag" and value == "article":
            nested = 0
        elif kind == "text" and place & NESTED:
            nested += len(value.split())
            longest = max(longest, nested)
        elif kind == "text" and place & ARTICLE:
            own += len(value.split())
    return [token for token in found if not token[2] & NESTED] if own >= longest else found


def train(pages: list[str]) -> Weights:
    """Weight of a word, weights of start and end tags, and weights of words, classes and links that stand outside, from
    pages with one article or main element.

    A tag costs what its log-odds to stand in main text lack, but never nothing: paragraphs of an article hardly part it,
    the tags around it do. What is found outside on more pages than inside weighs less than 1, by the log of the ratio.
    """
    inside, total = Counter(), Counter()
    sides = Counter(), Counter()
    for page in pages:
        seen: tuple[set[str], set[str]] = set(), set()
        for kind, value, place, classes, linked in tokens(page, cuts=True):
            if kind in ("tag", "end"):
                key = value if kind == "tag" else f"/{value}"
                total[key] += 1
                inside[key] += place > 0
            elif words := value.split():
                side = seen[kind == "cut" or not place]
                side.update(map(str.lower, words))
                side.update(f".{c}" for c in classes.split())
                if linked:
                    side.add(LINK)
        for pages_with, keys in zip(sides, seen):
            pages_with.update(keys)
    within, without = sides
    tags = {key: -max(LEAST_TAG, -math.log((inside[key] + 0.5) / (n + 1))) for key, n in total.items()}
    odds = {key: 1 + math.log((within[key] + 1) / (n + 1)) for key, n in without.items() if n >= LEAST_PAGES}
    return 1.0, tags, {key: max(OUTSIDE, odd) for key, odd in odds.items() if odd < 1}


def _blocks_of_links(found: list[Token]) -> set[int]:
    """Numbers of the texts in links that share their block with no other words."""
    alone: set[int] = set()
    block: list[int] = []
    plain = False
    for k, (kind, value, _, _, linked) in enumerate(found):
        if kind == "text":
            if linked:
                block.append(k)
            elif value.strip():
                plain = True
        elif value not in INLINE:
            alone.update(() if plain else block)
            block, plain = [], False
    alone.update(() if plain else block)
    return alone


def _text_score(value: str, classes: str, link: bool, word: float, learned: dict[str, float]) -> float:
    words = value.split()
    most = min((learned.get(f".{c}", 1.0) for c in classes.split()), default=1.0)
    if link:
        most = min(most, learned.get(LINK, 1.0))
    return word * sum(min(most, learned.get(w.lower(), 1.0)) for w in words)


def extract(page: str, weights: Weights) -> str:
    """The main text of one page. ``weights`` without those of words, classes and links takes all words alike, wherever
    they stand."""
    word, tag_weights, *rest = weights
    learned = rest[0] if rest else {}
    found = tokens(page)
    mask = marked(found) if rest else 0
    if mask:
        found = without_nested(found)
    links = _blocks_of_links(found) if learned and not mask else set()
    parts: list[str] = []
    best = (0.0, 0, 0)
    total, start = 0.0, 0
    for k, (kind, value, place, classes, _) in enumerate(found):
        if kind == "text":
            parts.append(html.unescape(value))
            if mask or not learned:
                score = (word if place & mask or not mask else OUTSIDE) * len(value.split())
            else:
                score = _text_score(value, classes, k in links, word, learned)
        else:
            parts.append("" if value in INLINE else " ")
            key, default = (value, DEFAULT_TAG) if kind == "tag" else (f"/{value}", 0.0)
            score = 0.0 if place & mask else tag_weights.get(key, default)
        if total <= 0:
            total, start = 0.0, len(parts) - 1
        total += score
        if total > best[0]:
            best = (total, start, len(parts))
    return " ".join("".join(parts[best[1] : best[2]]).split())


def learn(pages: DataFrame, rows: int = TRAIN_PAGES) -> Weights:
    """Weights from at most ``rows`` labelled pages, spread by hash."""
    text = F.col("html").cast("string")
    count = F.regexp_count(F.lower(text), F.lit(r"<(article|main)[\s>]"))
    chosen = pages.where(count == 1).select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(rows)
    # at most `rows` ids: their size is bounded by the parameter, and so are the pages that come to the driver
    found = pages.select("page_id", text.alias("html")).where(count == 1).join(F.broadcast(chosen.distinct()), "page_id")
    return train([r["html"] for r in found.orderBy(F.xxhash64("page_id"), "page_id", "html").limit(rows).collect()])


def extract_text(
    pages: DataFrame, weights: Weights, keep: tuple[str, ...] = ("page_id", "url")
) -> DataFrame:
    """``keep`` columns with ``text`` and ``n_chars``."""
    rows = pages.select(*keep, F.coalesce(F.col("html").cast("string"), F.lit("")).alias("__html"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                own = batch.slice(start, 256)
                texts = [extract(x.as_py(), weights) for x in own.columns[-1]]
                yield pa.RecordBatch.from_arrays(
                    [*own.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=[*own.schema.names[:-1], "text", "n_chars"],
                )

    return rows.mapInArrow(run, f"{kept}, text STRING, n_chars LONG")
