"""Main text of HTML pages by two-pass block rules.

A page is read tag by tag into blocks; what stands in scripts, styles, navigation and the like, or in an element
whose class, id or role names an advert, menu, notice, sidebar, header, footer or comment section, is left out, as are hidden
elements. Inside an article a part of a name (reader-comments, newsletter-box) counts only for the names of INSIDE, and not if
the element holds half of the article's text or more; html, body, article and main are never set apart by a part of a name, nor
is an element that turns out to hold an article. A form is left out if it has fields and little text beside them.

The blocks are then decided in two passes. First, by stop-word density, length and link density: link density over
MAX_LINKS is bad; short blocks stay open (with links: bad); many stop words make a block good (long) or nearly good, few
make it bad. On a page whose blocks have next to no known stop words, length and links alone decide. An <article> or <main>
shifts these rules: if it holds at least half of what they call good on the page, blocks inside need fewer stop words, and
blocks outside are bad; if it holds less (a teaser), it counts for nothing. Second: nearly good blocks are good unless both
decided neighbours are bad; short ones take the label of the nearest decided neighbours, good if one of equally near ones
is, and good if nothing on the page is decided.

Character references are decoded, white space in a block becomes one space, blocks are joined in page order by one space.

Defined cases: null, empty or text-free html gives an empty text; broken markup is read as far as it goes (an open tag at
the end of the page is markup); null page_id or url are passed on; repeated rows give repeated rows; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

MAX_LINKS, SHORT, LONG, FEW, MANY, HALF, FIELD = 0.3, 70, 200, 0.12, 0.2, 0.5, 100
#: Elements whose content is no text, and those that are not the article's.
RAW = frozenset("script style noscript template svg math iframe object textarea title select option canvas audio video".split())
APART = frozenset("nav footer aside button menu dialog head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Words of class, id and role names that mark what is not the article.
NAMES = frozenset(
    "ad ads adv advert advertisement adverts banner sponsor sponsored promo cookie cookies consent notice notification alert gdpr popup modal overlay sidebar side menu nav navigation navbar breadcrumb breadcrumbs topbar header masthead footer comment comments respond discussion share sharing social related recommended newsletter subscribe signup login search pagination pager widget skip contentinfo complementary".split()
)
#: Names of which a part sets an element inside an article apart.
INSIDE = frozenset(
    "ad ads advert advertisement adverts sponsor sponsored promo cookie cookies consent notice gdpr popup modal overlay menu nav navigation navbar breadcrumb breadcrumbs comment comments respond discussion share sharing related recommended newsletter subscribe signup login pagination".split()
)
#: Names that set even an article apart: those of a comment or an advert.
NOT_ARTICLE = frozenset("ad ads advert advertisement comment comments promo related sponsored".split())
#: Frequent function words of English, German, French and Spanish.
STOP = frozenset(
    "the of and to in a is that it was for on are with as be this at by from or an have not but they which you were her all she there would their we him been has when who will no more if out so "
    "der die das und ist nicht ein eine zu den mit von auf für im dem sich des auch als an es er sie wie aus bei nach wird "
    "le la les de des un une et est dans que qui pour sur pas avec au par ce il elle ne se plus sont du en "
    "el los las y que del se por con una su para como más pero sus al lo o".split()
)
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<([/!?]?)([a-zA-Z\[][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^<>]*(?:>|\Z)", re.S)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|(?:^|\s)style\s*=\s*["']?[^"'>]*display\s*:\s*none""", re.I)
BARE_VALUE = re.compile(r"=\s*[^\s\"'>]*/$")
NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
WORD = re.compile(r"[^\W\d_]+")


FIELDS = re.compile(r"<(?:input|textarea|select)\b(?![^<>]*type\s*=\s*[\"']?hidden)", re.I)
END_FORM = re.compile(r"</form\s*>", re.I)
MARKUP = re.compile(r"<[^>]*>|\s+")


def _named(name: str, attributes: str, in_main: bool) -> str:
    """"whole" or "part" if class, id or role name what is not the article, as a whole word or as a part of one; "inside" for such a part in an article."""
    if not attributes or name in ("html", "body"):
        return ""
    if HIDDEN.search(attributes) and name not in ("article", "main"):
        return "whole"
    names = [m[1] or m[2] or m[3] or "" for m in NAMED.finditer(attributes)]
    whole = {w.lower() for x in names for w in x.split()}
    if name in ("article", "main"):
        return "whole" if whole & NOT_ARTICLE else ""
    if whole & NAMES:
        return "whole"
    words = {w for x in names for w in re.split(r"[\s_-]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", x).lower())}
    if in_main:
        return "inside" if name not in INLINE and words & INSIDE else ""
    return "part" if words & NAMES else ""


def blocks(page: str) -> list[tuple[str, float, bool]]:
    """(text, link density, whether it is in an article or main element) of each block with text, in page order."""
    out: list = []
    stack: list[list] = []  # name, whether apart, main, whether apart for a part of a name alone, number of a part in an article
    open_: dict[str, int] = {}
    apart = main = links = parts = 0
    text: list[str] = []
    linked = at = group = groups = 0
    meant: set[int] = set()
    endless: set = set()

    def close():
        nonlocal text, linked
        plain = " ".join("".join(text).split())
        if plain:
            out.append((plain, min(1.0, linked / len(plain)), main > 0, group))
        text, linked = [], 0

    def add(a: int, b: int):
        nonlocal linked
        if a < b and not apart:
            piece = html.unescape(page[a:b])
            text.append(piece)
            if links:
                linked += len(" ".join(piece.split()))

    def pop():
        nonlocal apart, main, links, parts, group
        name, was_apart, was_main, in_part, began = stack.pop()
        group = 0 if began else group
        open_[name] -= 1
        apart, main, links, parts = apart - was_apart, main - was_main, links - (name == "a"), parts - in_part

    def is_form(begin: int) -> bool:
        """Whether the form that begins here has fields and little text."""
        end = None if "form" in endless else END_FORM.search(page, begin)
        if not end:
            endless.add("form")
            return False
        inner = page[begin : end.start()]
        fields = len(FIELDS.findall(inner))
        return fields > 0 and len(MARKUP.sub(" ", inner).split()) * 5 < FIELD * (fields + 1)

    while m := TAG.search(page, at):
        add(at, m.start())
        at = m.end()
        name, sign, attributes = (m[2] or "").lower(), m[1], m[3] or ""
        if not name or sign in ("!", "?"):
            continue
        if name in RAW and sign != "/":
            end = None if name in endless else re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            if end:
                at = end.end()
            elif name in ("script", "style"):
                at = len(page)
            else:
                endless.add(name)
            continue
        if name not in INLINE:
            if name == "br":
                text.append(" ")
                continue
            close()
        if name in VOID:
            continue
        if sign == "/":
            if open_.get(name):
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name not in INLINE and any(x[0] == "p" for x in stack[-4:]):  # a block ends an open paragraph
            while stack[-1][0] != "p":
                if stack[-1][0] not in INLINE:
                    break
                pop()
            if stack[-1][0] == "p":
                pop()
        if attributes.endswith("/") and not BARE_VALUE.search(attributes):
            continue
        marked, named = name in ("article", "main"), _named(name, attributes, main > 0)
        if marked and parts and not named:  # what holds an article was not meant by a part of its name
            for x in stack:
                apart, parts, x[1], x[3] = apart - x[3], parts - x[3], x[1] and not x[3], False
        if marked and group:  # nor what holds another article
            meant.add(group)
        began = named == "inside" and not group
        if named == "inside":
            named = ""
        tag = name in APART or (name == "header" and not main) or (name == "form" and is_form(at))
        part = named == "part" and not tag
        if began:
            group = groups = groups + 1
        stack.append([name, bool(named) or tag, marked, part, began])
        open_[name] = open_.get(name, 0) + 1
        apart, main, links, parts = apart + (bool(named) or tag), main + marked, links + (name == "a"), parts + part
    add(at, len(page))
    close()
    size: dict[int, int] = {}
    for block in out:
        size[block[3]] = size.get(block[3], 0) + len(block[0])
    whole = sum(len(b[0]) for b in out if b[2])
    return [b[:3] for b in out if not b[3] or b[3] in meant or 2 * size[b[3]] >= whole]


def _first(text: str, density: float, stop: float, few: float, many: float) -> str:
    if density > MAX_LINKS:
        return "bad"
    if len(text) < SHORT:
        return "bad" if density else "short"
    if stop >= many:
        return "good" if len(text) > LONG else "near"
    return "near" if stop >= few else "bad"


def _nearest(state: list[str]) -> list[tuple[str, int]]:
    """For each block the label of the decided one before it, and how far it is."""
    out, label, far = [], "", 0
    for s in state:
        far += 1
        out.append((label, far))
        if s in ("good", "bad"):
            label, far = s, 0
    return out


def labels(found: list[tuple[str, float, bool]]) -> list[bool]:
    """Which blocks are of the article."""
    stops = []
    for text, _, _ in found:
        words = WORD.findall(text.lower())
        stops.append(sum(w in STOP for w in words) / len(words) if words else 0.0)
    long = [s for (text, _, _), s in zip(found, stops, strict=True) if len(text) >= SHORT]
    few, many = (FEW, MANY) if any(s >= FEW / 2 for s in long) else (0.0, 0.0)  # none known: another language
    state = [_first(text, density, s, few, many) for (text, density, _), s in zip(found, stops, strict=True)]
    good = [len(b[0]) * (x in ("good", "near")) for b, x in zip(found, state, strict=True)]
    inside = sum(n for n, b in zip(good, found, strict=True) if b[2])
    if any(b[2] for b in found) and inside >= HALF * sum(good):
        state = [("short" if len(b[0]) < SHORT and b[1] <= MAX_LINKS else _first(b[0], b[1], s, 0.0, few)) if b[2] else "bad" for b, s in zip(found, stops, strict=True)]
    if not any(x in ("good", "bad") for x in state):
        return [True] * len(state)
    for kind in ("near", "short"):
        near = zip(_nearest(state), reversed(_nearest(state[::-1])), strict=True)
        after = []
        for x, ((left, a), (right, b)) in zip(state, near, strict=True):
            if x != kind:
                after.append(x)
            elif kind == "near":
                after.append("bad" if left == right == "bad" else "good")
            elif not left or not right:
                after.append(left or right)
            elif a == b:
                after.append("good" if "good" in (left, right) else "bad")
            else:
                after.append(left if a < b else right)
        state = after
    return [x == "good" for x in state]


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return " ".join(b[0] for b, good in zip(found, labels(found), strict=True) if good)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = [main_text(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """pages -> (page_id, url, text, n_chars), one row per row of pages."""
    ship(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(_run, "page_id long, url string, text string, n_chars long")
