"""Main text of web pages: flat text blocks, classified by a decision tree over their own and their neighbours' features.

A page is cut at block-level tags into flat blocks. A block's features are its words and link density, those of the
blocks before and after it, and what encloses it. A small labelled table of blocks trains the tree (Gini, on the
driver); blocks it accepts are joined in page order.
"""

from __future__ import annotations

import html as _html
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A quote opens a value only after an equals sign, as in the HTML syntax; elsewhere it is a character like others. Raw text
# (script, style) runs on to the end where it isn't closed; other skipped elements are skipped only where they are. A tag
# that the page's end cuts off goes.
_ATTRIBUTES = r"(?:[\s/](?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*')?)*+)?+"
_TAG = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(script|style)(?=[\s/>]){_ATTRIBUTES}>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)"
    rf"|<(noscript|template|svg|iframe|textarea|title|select|object|math)(?=[\s/>]){_ATTRIBUTES}(?<!/)>(?:(?!<\2[\s/>]).)*?</\2\s*>"
    rf"|<(/?)([a-zA-Z][^\s/>]*)({_ATTRIBUTES})>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^\s/>]*{_ATTRIBUTES}\Z", re.S | re.I)
_NAME = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"\shidden\b|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_WORD = re.compile(r"[^a-z0-9]+")

# Fixed values of HTML: block-level elements, elements without content, and elements that hold page furniture.
_BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HOLDS = frozenset("article aside blockquote body button center details dialog div dl fieldset figure footer form head header html main menu nav ol section table td ul".split())
_FURNITURE = frozenset("nav footer aside menu button dialog".split())
_MAYBE = frozenset("form fieldset".split())
#: Words of class, id, role and itemprop: of furniture itself, and such as layout containers around a text bear too.
_SIGNS = frozenset("ad ads advert advertisement adverts anuncio anuncios anzeige comment comments comentarios commentaire commentaires kommentare consent cookie cookies copyright disqus gdpr newsletter promo pub publicidad publicite replies reply respond sponsor sponsored werbung".split())
_MAYBE_SIGNS = frozenset("banner breadcrumb breadcrumbs footer header masthead menu modal nav navbar navigation notice pager pagination popup related share sharing sidebar signup social subscribe toolbar widget".split())
#: Words that say of a container what kind it is, not what it holds.
_KINDS = frozenset("area bar block body bottom box button card cell container content end first footer form group header head holder inline inner item label last left line link links list main middle module note outer panel right row section side slot small space text title top unit wrap wrapper zone".split())
_LAYOUT = re.compile(r"(?:has|with|no|without)[-_]", re.I)  # class names that say what a container has

FEATURES = ["words", "links", "words_before", "links_before", "words_after", "links_after", "in_article", "in_furniture", "furniture_around", "page_has_article", "is_heading"]

#: Typical surroundings of a block: words, link density before and after it.
_TEXT = [(0, 0.0, 60, 0.0), (40, 0.0, 60, 0.0), (120, 0.0, 0, 0.0), (9, 0.2, 300, 0.0), (20, 0.0, 90, 0.0), (90, 0.0, 17, 0.0), (70, 0.0, 2, 0.0), (2, 0.0, 70, 0.0)]
_AMID = [(40, 0.0, 60, 0.0), (90, 0.1, 30, 0.0), (30, 0.0, 200, 0.1)]
_LINKED = [(1, 1.0, 1, 1.0), (6, 1.0, 8, 0.9), *[(n, 0.0, k, 1.0) for n in (9, 40, 120, 300) for k in (1, 2, 9)], *[(k, 1.0, n, 0.0) for n in (9, 40, 120, 300) for k in (1, 2, 9)]]
_NEAR = [*_TEXT, (1, 1.0, 9, 0.0), (9, 0.0, 1, 1.0), (1, 1.0, 1, 1.0)]


def _rows(words, links, inside, furniture, has, heading, main, near=_NEAR, around=0):
    return [(n, d, *x, inside, furniture, around, has, heading, main) for n in words for d in links for x in near]


#: The labelled table: FEATURES of typical blocks in typical surroundings, and 1 for main text. in_furniture is 2 in what
#: is furniture for sure (never main text), 1 in what may be a layout container (words and link densities decide).
LABELLED = [
    # inside an article: headings, short and long paragraphs; linked ones amid text, but no lists of links and no teasers
    *_rows((3, 9), (0.0,), 1, 0, 1, 1, 1, [*_NEAR, *_LINKED]), *_rows((1, 5, 20, 60, 300), (0.0, 0.1), 1, 0, 1, 0, 1, [*_NEAR, *_LINKED]), *_rows((3, 14), (0.5,), 1, 0, 1, 0, 1, _TEXT),
    *_rows((3, 14), (1.0,), 1, 0, 1, 0, 1, _TEXT), *_rows((1, 3, 14), (0.9, 1.0), 1, 0, 1, 0, 0, _LINKED), *_rows((30, 60, 200), (0.8, 1.0), 1, 0, 1, 0, 0),
    # an article in furniture: text is long and has few links, or stands amid such text; teasers are short beside links
    *_rows((60, 300), (0.0, 0.1), 1, 0, 1, 0, 1, [*_TEXT, *_LINKED], 1), *_rows((3, 14), (0.0,), 1, 0, 1, 0, 1, _AMID, 1), *_rows((3, 9), (0.0,), 1, 0, 1, 1, 1, [(n, d, k, 0.0) for n, d in ((0, 0.0), (1, 1.0), (6, 1.0), (40, 0.0), (120, 0.0)) for k in (40, 90, 300)], 1),
    *_rows((3, 14), (0.0,), 1, 0, 1, 0, 0, _LINKED, 1), *_rows((3, 14), (0.8, 1.0), 1, 0, 1, 0, 0, [*_TEXT, *_LINKED, (3, 0.0, 0, 0.0), (4, 0.0, 5, 0.0)], 1), *_rows((3, 9), (0.0,), 1, 0, 1, 1, 0, [(n, d, k, e) for n, d in ((0, 0.0), (1, 1.0), (40, 0.0)) for k, e in ((3, 0.0), (9, 0.0), (3, 1.0), (9, 1.0))], 1), *_rows((3, 9), (1.0,), 1, 0, 1, 1, 0, [*_TEXT, *_LINKED], 1), *_rows((30, 60), (0.8, 1.0), 1, 0, 1, 0, 0, _TEXT, 1),
    # sure furniture, in and around an article: menus, adverts, notices, footers, comments
    *[r for inside, has in ((0, 0), (0, 1), (1, 1)) for heading in (0, 1) for r in _rows((1, 3, 7, 12, 18, 25, 35, 40, 45, 60, 90, 120, 300), (0.0, 0.1, 0.3, 0.6, 1.0), inside, 2, has, heading, 0, [*_NEAR, *_LINKED[:4], *_AMID])],
    # containers that may be furniture, in and around an article: long text with few links amid text stays
    *_rows((1, 3, 12), (0.0, 0.3, 0.6, 1.0), 1, 1, 1, 0, 0, [*_NEAR, *_LINKED]), *_rows((60, 300), (0.4, 1.0), 1, 1, 1, 0, 0), *_rows((3,), (0.0,), 1, 1, 1, 1, 0), *_rows((60, 300), (0.0, 0.1), 1, 1, 1, 0, 1, _TEXT), *_rows((60,), (0.0,), 1, 1, 1, 0, 0, _LINKED),
    *_rows((1, 4), (1.0,), 0, 1, 1, 0, 0), *_rows((2, 9, 35), (0.0,), 0, 1, 1, 0, 0), *_rows((60, 120), (0.5, 1.0), 0, 1, 1, 0, 0), *_rows((60, 120, 300), (0.0, 0.1), 0, 1, 1, 0, 1, _AMID), *_rows((60, 120), (0.0,), 0, 1, 1, 0, 0, _LINKED),
    # other blocks outside the article of a page that has one: long text with few links beside text is main text too
    *_rows((2, 12, 40), (0.0, 0.9), 0, 0, 1, 0, 0), *_rows((4,), (0.0,), 0, 0, 1, 1, 0), *_rows((60, 150, 300), (0.0, 0.1), 0, 0, 1, 0, 1, _TEXT), *_rows((60, 150), (0.0,), 0, 0, 1, 0, 0, _LINKED), *_rows((60, 150), (0.6, 1.0), 0, 0, 1, 0, 0),
    # what may be furniture on a page without an article
    *_rows((1, 4), (1.0,), 0, 1, 0, 0, 0), *_rows((2, 9), (0.0,), 0, 1, 0, 0, 0), *_rows((40, 60, 200), (0.0, 0.1), 0, 1, 0, 0, 1, _TEXT), *_rows((60, 200), (0.0,), 0, 1, 0, 0, 0, _LINKED), *_rows((60, 200), (0.5, 1.0), 0, 1, 0, 0, 0),
    # text of a page without an article: long blocks, and short ones beside long ones
    *_rows((18, 45, 90, 200), (0.0, 0.1), 0, 0, 0, 0, 1, [*_NEAR, *_LINKED]), *_rows((30, 90), (0.8,), 0, 0, 0, 0, 0), *_rows((2, 5), (0.8, 1.0), 0, 0, 0, 0, 0),
    *[(n, 0.0, *near, 0, 0, 0, 0, h, 1) for n in (3, 8) for h in (0, 1) for near in ((60, 0.0, 70, 0.0), (40, 0.0, 60, 0.0), (3, 0.0, 60, 0.0), (90, 0.0, 30, 0.0))],
    *[(n, 0.0, *near, 0, 0, 0, 0, h, 0) for n in (2, 5) for h in (0, 1) for near in ((1, 1.0, 2, 1.0), (3, 1.0, 4, 1.0), (2, 0.0, 3, 1.0), (5, 0.6, 3, 1.0))],
]


def train_tree(rows: list[tuple], depth: int = 16):
    """Nested (feature, threshold, below, above), or a class at the leaves; ties go to the earlier feature."""
    x, y = np.array([r[:-1] for r in rows], float), np.array([r[-1] for r in rows])

    def grow(on, left):
        p = y[on].mean()
        if left == 0 or p in (0.0, 1.0):
            return int(p >= 0.5)
        best = None
        for j in range(x.shape[1]):
            values = np.unique(x[on, j])
            for cut in (values[1:] + values[:-1]) / 2:
                low = on & (x[:, j] < cut)
                high = on & ~low & on
                cost = sum(m.sum() * 2 * y[m].mean() * (1 - y[m].mean()) for m in (low, high))
                if best is None or cost < best[0] - 1e-12:
                    best = (cost, j, float(cut), low, high)
        if best is None:
            return int(p >= 0.5)
        return (best[1], best[2], grow(best[3], left - 1), grow(best[4], left - 1))

    return grow(np.ones(len(y), bool), depth)


def accepts(tree, f) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if f[tree[0]] < tree[1] else tree[3]
    return bool(tree)


def blocks(page: str) -> list[tuple[str, int, float, int, int, int, int]]:
    """(text, words, link density, in_article, in_furniture, furniture_around, is_heading) of the flat blocks with text.

    The outermost open article or main puts what encloses it aside as furniture_around; one inside it does so with what
    may be furniture only, since comments and teasers are articles too. What is hidden stays so."""
    out, parts, links = [], [], []
    open_tags: list[tuple[str, int, int, int, bool]] = []  # name, and of it with all that encloses it: in_article, in_furniture, furniture_around, hidden
    anchors, heading, at = 0, 0, 0

    def flush():
        nonlocal parts, links
        if parts:
            text = " ".join(_html.unescape("".join(parts)).split())
            if text:
                n = len(text.split())
                linked = len(_html.unescape("".join(links)).split())
                out.append((text, n, min(1.0, linked / n), *(open_tags[-1][1:4] if open_tags else (0, 0, 0)), int(heading > 0)))
            parts, links = [], []

    for m in _TAG.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
            if anchors:
                links.append(page[at : m.start()] + " ")
        at = m.end()
        name = m[4]
        if name is None:
            continue
        name, closing = name.lower(), m[3] == "/"
        if name in _BLOCK:
            flush()
        if name == "a":
            anchors = max(0, anchors + (-1 if closing else 1)) if closing or not anchors else anchors
        elif name in ("h1", "h2", "h3", "h4", "h5", "h6"):
            heading = 0 if closing else 1
        if name not in _HOLDS or name in _VOID:
            continue
        if closing:
            for k in range(len(open_tags) - 1, -1, -1):
                if open_tags[k][0] == name:
                    del open_tags[k:]
                    break
        elif not m[0].endswith("/>"):
            attributes = m[5] or ""
            named_words = [{w for w in _WORD.split(x) if w} for n in _NAME.findall(attributes) for x in "".join(n).lower().split() if not _LAYOUT.match(x)]
            signs = set().union(*named_words)
            inside, furniture, around, hidden = open_tags[-1][1:] if open_tags else (0, 0, 0, False)
            hidden = hidden or bool(_HIDDEN.search(attributes))
            if name in ("article", "main") or "articlebody" in signs:
                if not inside:
                    around = int(furniture == 2)
                furniture = 2 if inside and furniture == 2 else 0
                inside = 1
            if inside:
                signs.discard("header")  # an article's own
            named = name not in ("body", "html", "article", "main")
            # in an article a name that also says something else (cookie-steps) may be of its text; words and links decide
            sure = [x for x in named_words if x & _SIGNS and (not inside or all(w in _SIGNS or w in _MAYBE_SIGNS or w in _KINDS or w.isdigit() for w in x))]
            if hidden or name in _FURNITURE or (named and sure):
                furniture = 2
            elif name in _MAYBE or (name == "header" and not inside) or (named and signs & (_MAYBE_SIGNS | _SIGNS)):
                furniture = max(furniture, 1)
            open_tags.append((name, inside, furniture, around, hidden))
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


def main_text(page: str, tree) -> str:
    found = blocks(page)
    has = int(any(b[3] for b in found))
    kept = []
    for i, (text, n, density, inside, furniture, around, heading) in enumerate(found):
        before = found[i - 1] if i else ("", 0, 0.0)
        after = found[i + 1] if i + 1 < len(found) else ("", 0, 0.0)
        if accepts(tree, (n, density, before[1], before[2], after[1], after[2], inside, furniture, around, has, heading)):
            kept.append(text)
    return " ".join(kept)


def extract(pages: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns, text and n_chars (code points) of every row; null and empty html give the empty text.

    Broken markup is read as far as it goes; repeated rows and null keys are rows like others."""
    tree = train_tree(LABELLED)

    @F.pandas_udf("string")
    def run(page):
        import pandas as pd

        return pd.Series([main_text(p, tree) if p else "" for p in page], dtype=object)

    return pages.select(*columns, run("html").alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op6_html(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return extract(table(spark, sf_dir, "pages"), ["page_id", "url"])
