"""Main text of web pages as a maximum-scoring subsequence.

A page becomes a sequence of tags and runs of words. Every word in plain text scores positive, every tag negative, words
in menus, notices, adverts and the like negative too, with weights fitted on labelled pages as log ratios of how
often a kind occurs inside and outside the content. One linear scan finds the contiguous region of the highest score;
its blocks, without those marked as something else, are the text.

Defined results: null or empty html, or a page whose every region scores at most zero, gives an empty text; of regions with the same score the first wins; markup that is cut off ends with the
page; paragraphs, list items, rows, cells and options that are not closed end where the next begins; a page of any length is read whole, one at
a time; null ids stay; repeated rows give repeated results; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches
from .labelled_pages import PAGES

# Drawings and formulas closed in their own tag, content that is never text, comments and declarations, tags (quoted signs may hold ">"), runs of text.
TOKEN = re.compile(
    r"""<(?:svg|math)\b(?>[^>"'<]++|"[^"<]*+"|'[^'<]*+')*+(?<=/)>"""
    r"""|<(?P<raw>script|style|noscript|template|textarea|iframe|object|svg|math|select|title)\b[^>]*+>.*?(?:</(?P=raw)\s*+>|\Z)"""
    r"""|<!--.*?(?:-->|\Z)|<[!?][^>]*+>?"""
    r"""|<(?P<close>/?)(?P<name>[a-z][^\s/>]*+)(?P<attrs>(?>[^>"'<]++|"[^"<]*+"|'[^'<]*+')*+)>"""
    r"""|<(?P<close2>/?)(?P<name2>[a-z][^\s/><]*+)(?P<attrs2>[^><]*+)>?"""
    r"""|(?P<text>[^<]++|<)""",
    re.S | re.I,
)
# One attribute after the other, so that nothing inside a value is taken for an attribute.
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"?|'([^']*+)'?|([^\s"'>]++)))?""")
# Names that tell what an element has or may do, not what it is.
PROPERTY = re.compile(r"(?:has|with|without|no|is|js|supports)[-_].*|.*[-_](?:open|closed|on|off|enabled|disabled)")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo br big cite code del em font i ins kbd mark q s samp small span strong sub sup time tt u var wbr img".split())
ASIDE_TAGS = frozenset("nav footer aside form button menu dialog label fieldset".split())
MAIN_TAGS = frozenset("article main".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies disqus footer login masthead "
    "menu modal nav navbar navigation newsletter notice pagination popup promo promotion related respond search share sharing sidebar signup social sponsor "
    "sponsored subscribe toolbar topbar widget widgets".split()
)
MAIN_WORDS = frozenset("article entry post content story".split())
# What readers wrote stays out even where it is called content or an entry.
READER_WORDS = frozenset("comment comments commentaire commentaires comentario comentarios kommentar kommentare disqus replies responses respond".split())

# Elements that end where another begins: what an opening tag ends, up to the element that holds both.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "option": ("option",)}
HOLDERS = frozenset("ul ol menu dl table select datalist".split())
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)


def tag_kind(name: str) -> str:
    for kind, names in (
        ("text", "p blockquote pre"), ("break", "br hr wbr"), ("heading", "h1 h2 h3 h4 h5 h6"), ("link", "a"), ("list", "ul ol li dl dt dd"), ("main", "article main section"),
        ("side", "nav footer header aside menu dialog"), ("form", "form input button select label option fieldset"), ("table", "table tr td th tbody thead tfoot"),
    ):
        if name in names.split():
            return kind
    return "inline" if name in INLINE else "box"


def marks(attrs: str) -> tuple[set[str], bool]:
    """(words of an element's class, id and role, whether it is hidden)."""
    words, hidden = set(), False
    for name, *values in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), "".join(values).lower()
        if name in ("class", "id", "role"):
            words |= {w for token in value.split() if not PROPERTY.fullmatch(token) for w in re.split(r"[^a-z0-9]+", token)}
        hidden |= name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value) is not None)
    return words, hidden


def ended(stack: list[tuple[str, str, bool]], name: str) -> int:
    """How many open elements an opening tag ends by itself."""
    ends = ENDS.get(name)
    for n, (open_, _, _) in enumerate(reversed(stack), 1):
        if ends:
            if open_ in ends:
                return n
            if open_ in HOLDERS or (open_ == "tr" and name != "tr"):
                return 0
        elif name not in ENDS_PARAGRAPH or open_ not in INLINE:
            return n if open_ == "p" and name in ENDS_PARAGRAPH else 0
    return 0


def tokens(html: str) -> Iterator[tuple[str, str, str, bool]]:
    """(kind, text, tag, main): kind ``tag:*`` with the tag's name, or ``word:*`` with a run of text.

    ``word:aside`` stands in a part that its tag or its class marks as something else than content, ``word:inner`` in
    such a part inside the article; ``main`` is true inside an element that carries data-main.
    """
    stack: list[tuple[str, str, bool]] = []  # name, state of what is inside, labelled
    open_: dict[str, int] = {}
    state, labelled = "plain", False
    for m in TOKEN.finditer(html):
        text = m["text"]
        if text is not None:
            links = open_.get("a", 0)
            yield "word:" + (state if state in ("aside", "inner") else "link" if links else "plain"), text, "", labelled
            continue
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            # A comment or script stands between words without parting them.
            continue
        attrs = m["attrs"] or m["attrs2"] or ""
        if m["close"] or m["close2"]:
            yield ("tag:inner" if state == "inner" else "tag:" + tag_kind(name)), "", name, labelled
            if open_.get(name):
                while True:
                    last = stack.pop()[0]
                    open_[last] -= 1
                    if last == name:
                        break
                state, labelled = stack[-1][1:] if stack else ("plain", False)
            continue
        n = ended(stack, name) if name in ENDS or name in ENDS_PARAGRAPH else 0
        if n:
            for last, _, _ in stack[-n:]:
                open_[last] -= 1
            del stack[-n:]
            state, labelled = stack[-1][1:] if stack else ("plain", False)
        if name not in VOID:
            inside = state
            in_main = any(open_.get(t) for t in MAIN_TAGS)
            hints, hidden = marks(attrs) if attrs else (set(), False)
            readers = bool(hints & READER_WORDS)
            if name in MAIN_TAGS and not hints & ASIDE_WORDS and not readers:
                inside = "plain"
            elif state == "plain" and name not in ("html", "body"):
                aside = name in ASIDE_TAGS or hidden or readers or (hints & ASIDE_WORDS and not hints & MAIN_WORDS)
                if aside or (not in_main and (name == "header" or "header" in hints)):
                    inside = "inner" if in_main else "aside"
            stack.append((name, inside, labelled or "data-main" in attrs))
            open_[name] = open_.get(name, 0) + 1
            state, labelled = stack[-1][1:]
        yield ("tag:inner" if state == "inner" else "tag:" + tag_kind(name)), "", name, labelled


def fit_weights(pages: list[str] = PAGES, smooth: float = 0.5, least: float = 0.02) -> dict[str, float]:
    """Log ratio of each kind's frequency inside and outside the content; tags never positive, plain words never negative."""
    inside: dict[str, float] = {}
    outside: dict[str, float] = {}
    for page in pages:
        for kind, text, _, main in tokens(page):
            side = inside if main else outside
            side[kind] = side.get(kind, 0) + (len(text.split()) if kind.startswith("word") else 1)
    kinds = inside.keys() | outside.keys()
    n, m = sum(inside.values()) + smooth * len(kinds), sum(outside.values()) + smooth * len(kinds)
    ratio = {k: math.log((inside.get(k, 0) + smooth) / n) - math.log((outside.get(k, 0) + smooth) / m) for k in kinds}
    weights = {k: min(v, -least) if k.startswith("tag") else max(v, least) if k == "word:plain" else v for k, v in ratio.items()}
    # What lies inside the article but is marked as something else neither helps nor cuts the article.
    return weights | {"word:inner": 0.0, "tag:inner": 0.0}


def best_region(scores: list[float]) -> tuple[int, int, float]:
    """(first, end, score) of the contiguous region with the largest sum; the first of equals; (0, 0, 0) if none is positive."""
    best, run, start = (0, 0, 0.0), 0.0, 0
    for i, s in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += s
        if run > best[2]:
            best = (start, i + 1, run)
    return best


def main_text(html: str | None, weights: dict[str, float]) -> tuple[str, float]:
    """Text and score of a page's best region; blocks in page order, one line each."""
    from html import unescape

    found = list(tokens(html or ""))
    scores = [
        weights.get(kind, weights.get("tag:box", -1.0)) * (len(text.split()) if kind.startswith("word") else 1) for kind, text, _, _ in found
    ]
    first, end, score = best_region(scores)
    blocks: list[list[str]] = [[]]
    for kind, text, name, _ in found[first:end]:
        if kind.startswith("tag"):
            if name == "br":
                blocks[-1].append(" ")
            elif name not in INLINE and blocks[-1]:
                blocks.append([])
        elif kind in ("word:plain", "word:link"):
            blocks[-1].append(text)
    lines = (" ".join(unescape("".join(b)).split()) for b in blocks)
    return "\n".join(x for x in lines if x), score


def extract(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text, n_chars and score of every page."""
    weights = weights or fit_weights()
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, scores = [], []
            for html in batch.column("html"):
                text, score = main_text(html.as_py(), weights)
                texts.append(text)
                scores.append(score)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64(), size=len(texts)), pa.array(scores, pa.float64())],
                names=["page_id", "url", "text", "n_chars", "score"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint, score double")
