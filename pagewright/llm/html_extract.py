"""Main text of web pages by tag-path ratios.

A page is read into blocks of text, each with its root-to-leaf tag path. Text length and punctuation
are summed by path and divided by the path's number of blocks; the ratios are smoothed over
neighbouring blocks, fused over the path's ancestors, and paths over a threshold are content; elements
of running text have a lower one. Where a page has <article> or <main>, those dense enough are searched,
not the whole page. Elements of boilerplate (menus, headers, footers, forms, scripts, styles) never are;
elements whose class or id names them so (sidebars, notices, adverts, reader comments) only if they hold
most of the page's running text.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .common import map_rows

#: The inside of a tag. A quote opens a value only behind an equals sign; one that nothing closes ends at the tag.
#: A closing quote is followed by a space, a slash or the end of the tag, or the value holds no tag.
VALUE = r"""(?:"[^"]*"(?=[\s/>]|$)|"[^"<>]*"|'[^']*'(?=[\s/>]|$)|'[^'<>]*'|["'][^>]*|[^\s>"'][^\s>]*)"""
INSIDE = rf"(?>(?:[^>=]++|=\s*+{VALUE}?+)*+)"
TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    rf"|<(script|style|noscript|template|textarea|iframe|svg|title|select|xmp|math|object|canvas)\b{INSIDE}(?:>.*?(?:</\1\s*>|$)|$)"
    rf"|<(/?)([a-z][a-z0-9:-]*)({INSIDE})(?:>|$)",
    re.I | re.S,
)
ATTRIBUTE = re.compile(rf"""([^\s=>/"'][^\s=>/]*)(?:\s*=\s*({VALUE}))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that are never part of an article.
DROPPED = frozenset("head nav footer aside form button dialog menu input label fieldset option noframes audio video map".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog form menu menubar".split())
#: Words of class and id names, cut at every character that is no letter and before capitals. A name is boilerplate's
#: if it holds one of these and otherwise only words of form or place, so "ad box" is and "legal analysis" isn't.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion menu nav navbar navigation navigator topnav header masthead topbar footer foot bottombar"
    " sidebar aside rail widget widgets breadcrumb breadcrumbs cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login comment comments respond"
    " reply replies disqus discussion share sharing social related recommended trending pagination pager copyright legal skip search toolbar".split()
)
PLACES = frozenset("site page main global local top bottom left right upper lower side inner outer box bar block wrapper wrap container area section panel list item items link links row col column group unit slot inline primary secondary first last mobile desktop sticky fixed floating small big large the and of in js is has no".split())
ENDS_P = frozenset("address article aside blockquote center div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements of running text: inside the article's element a LEAF_SHARE of the threshold makes them content.
TEXT_LEAVES = frozenset("p li blockquote pre td th dd dt figcaption h1 h2 h3 h4 h5 h6".split())
LEAF_SHARE = 0.25
#: Characters of a block that count when the middle of the text is looked for.
LONGEST = 200
PUNCT = re.compile(r"[.,;:!?…。，、；：！？]")


def attributes(inside: str) -> dict[str, str]:
    """Lower-cased names and values of a tag's attributes; the first of a name counts."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(inside):
        value = m[2] or ""
        if value[:1] in ('"', "'"):
            value = value[1:-1] if len(value) > 1 and value[-1] == value[0] else value[1:]
        out.setdefault(m[1].lower(), value)
    return out


def names_boilerplate(name: str) -> bool:
    """Whether one of the names in a class or id attribute is that of boilerplate."""
    for one in name.split():
        words = re.findall(r"[a-z]+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", one).lower())
        if any(w in BOILERPLATE for w in words) and all(w in BOILERPLATE or w in PLACES or len(w) == 1 for w in words):
            return True
    return False


def boilerplate(tag: str, own: dict[str, str], within: bool) -> int:
    """2: the element is never part of an article; 1: its name says so; 0: neither. within: inside <article> or <main>."""
    if tag in DROPPED or tag == "header" and not within:
        return 2
    if not own or tag in ("html", "body", "article", "main"):
        return 0
    if own.get("hidden", "until-found") != "until-found" or own.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", own.get("style", ""), re.I):
        return 2
    if own.get("role", "").lower() in ROLES:
        return 2
    return int(names_boilerplate(own.get("class", "")) or names_boilerplate(own.get("id", "")))


class Block:
    """path: number of its tag path; named: number of the element named as boilerplate that holds it, or -1."""

    __slots__ = ("linked", "named", "path", "text")

    def __init__(self, path: int, text: str, linked: int, named: int):
        self.path, self.text, self.linked, self.named = path, text, linked, named


class Paths:
    """The tree of root-to-leaf tag paths: number 0 is the empty path; a path's parent has the smaller number."""

    def __init__(self) -> None:
        self.parent, self.tag = [-1], [""]
        self.known: dict[tuple[int, str], int] = {}

    def below(self, path: int, tag: str, step: str) -> int:
        at = self.known.get((path, step))
        if at is None:
            at = self.known[path, step] = len(self.parent)
            self.parent.append(path)
            self.tag.append(tag)
        return at


CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "body": {"head"}}


def blocks(page: str) -> tuple[list[Block], Paths]:
    """Blocks of text in page order, without elements that are never part of an article, and their paths.

    A path holds block elements only; each step is the tag with its class and, unless it is running text, its id.
    """
    out: list[Block] = []
    paths = Paths()
    stack: list[tuple[str, int, int, int]] = []  # tag, kind of boilerplate, path, element named as boilerplate
    opened: dict[str, int] = defaultdict(int)
    pieces: list[str] = []
    linked = hidden = elements = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                _, _, path, named = stack[-1] if stack else ("", 0, 0, -1)
                out.append(Block(path, text, linked, named))
            pieces.clear()
        linked = 0

    def pop(to: int) -> None:
        nonlocal hidden
        for tag, kind, *_ in stack[to:]:
            hidden -= kind == 2
            opened[tag] -= 1
        del stack[to:]

    def text(raw: str) -> None:
        nonlocal linked
        if raw and not hidden:
            raw = html.unescape(raw) if "&" in raw else raw
            pieces.append(raw)
            linked += len(raw) * (opened["a"] > 0)

    at = 0
    for m in TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        if m[3] is None:  # a comment, a declaration, or an element whose content isn't text
            if m[0].startswith("<![CDATA["):
                text(html.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        tag = m[3].lower()
        if m[2]:
            if opened[tag]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        if tag not in INLINE:
                            flush()
                        pop(k)
                        break
                    if tag in INLINE and stack[k][0] not in INLINE:  # an inline end tag doesn't close blocks
                        break
            continue
        if tag in ("br", "wbr"):
            if tag == "br":
                text(" ")
            continue
        if tag not in INLINE:
            flush()
            closes = CLOSES.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
            k = len(stack) - 1
            while k >= 0 and any(opened[t] for t in closes) and (stack[k][0] in INLINE or stack[k][0] in closes):
                if stack[k][0] in closes:
                    pop(k)
                    k = len(stack)
                k -= 1
        if tag in VOID or m[4].endswith("/") and tag not in INLINE | ENDS_P:
            continue
        own = attributes(m[4]) if m[4] else {}
        kind = boilerplate(tag, own, opened["article"] + opened["main"] > 0)
        _, _, path, named = stack[-1] if stack else ("", 0, 0, -1)
        if tag not in INLINE:
            path = paths.below(path, tag, f"{tag} {own.get('class', '')} {'' if tag in TEXT_LEAVES else own.get('id', '')}")
        if kind == 1 and named < 0:
            named, elements = elements, elements + 1
        stack.append((tag, kind, path, named))
        opened[tag] += 1
        hidden += kind == 2
    text(page[at:])
    flush()
    return out, paths


def ratios(found: list[Block], n: int) -> tuple[list[float], list[float], list[int]]:
    """Of each of the n paths its ratio, text length times punctuation a block, the ratio smoothed over neighbouring blocks, and its number of blocks."""
    size, punct, count = [0.0] * n, [0.0] * n, [0] * n
    for b in found:
        free = max(0, len(b.text) - b.linked)  # link text is no evidence for an article
        size[b.path] += free
        punct[b.path] += len(PUNCT.findall(b.text)) if free else 0
        count[b.path] += 1
    ratio = [s / c * (1 + p / c) if c else 0.0 for s, p, c in zip(size, punct, count, strict=True)]
    line = [ratio[b.path] for b in found]
    total = [0.0] * n
    for k, b in enumerate(found):  # weights 1 2 3 2 1
        near = [(w, line[k + d]) for d, w in ((-2, 1), (-1, 2), (0, 3), (1, 2), (2, 1)) if 0 <= k + d < len(line)]
        total[b.path] += sum(w * x for w, x in near) / sum(w for w, _ in near)
    return ratio, [t / c if c else 0.0 for t, c in zip(total, count, strict=True)], count


def content_paths(found: list[Block], paths: Paths, threshold: float = 0.35) -> set[int]:
    """Tag paths that hold the article."""
    parent, tag = paths.parent, paths.tag
    n = len(parent)
    ratio, level, count = ratios(found, n)
    # fused: an ancestor gathers what its paths hold; the densest deep one is the article's element
    held, many = [x * c for x, c in zip(level, count, strict=True)], list(count)
    deep = [False] * n  # whether a path with text lies below
    for p in range(n - 1, 0, -1):
        held[parent[p]] += held[p]
        many[parent[p]] += many[p]
        deep[parent[p]] = deep[parent[p]] or many[p] > 0
    covered = [False] * n  # below an outermost <article> or <main>
    roots = []
    for p in range(1, n):
        covered[p] = covered[parent[p]] or tag[parent[p]] in ("article", "main")
        if tag[p] in ("article", "main") and not covered[p] and many[p]:
            roots.append(p)
    if roots:
        most = max(held[p] / many[p] for p in roots)
        roots = [p for p in roots if held[p] / many[p] >= threshold * most]
    else:
        inner = [p for p in range(1, n) if deep[p] and held[p] >= 0.6 * held[0]]
        roots = [max(inner, default=0)]  # each holds over half, so they lie on one path; the deepest has the largest number
    inside = [False] * n
    for p in roots:
        inside[p] = True
    for p in range(1, n):
        inside[p] = inside[p] or inside[parent[p]]
    # against the block in the middle of the text, so that neither one very long block nor many tiny ones set the bar
    usual = sorted((level[b.path], min(len(b.text), LONGEST)) for b in found if inside[b.path])
    half, bar = sum(x for _, x in usual) / 2, 0.0
    for x, size in usual:
        half -= size
        if half <= 0:
            bar = threshold * x
            break
    return {p for p in range(n) if count[p] and inside[p] and ratio[p] > 0 and level[p] >= bar * (LEAF_SHARE if tag[p] in TEXT_LEAVES else 1)}


def readmitted(found: list[Block]) -> list[Block]:
    """The blocks outside elements named as boilerplate, and those inside one that holds more running text than the rest of the page."""
    size: dict[int, int] = defaultdict(int)
    for b in found:
        size[b.named] += max(0, len(b.text) - b.linked)
    total = sum(size.values())
    return [b for b in found if b.named < 0 or 2 * size[b.named] > total]


def extract(page: str | None) -> str:
    """The article's blocks joined by two newlines; empty for null or where there is none."""
    if not page:
        return ""
    found, paths = blocks(page)
    found = readmitted(found)
    good = content_paths(found, paths)
    return "\n\n".join(b.text for b in found if b.path in good)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``.

    Null html gives empty text; very long and deeply nested pages are read whole, in time linear in their tags; of
    equally dense elements all are kept; no-break spaces fold like other white space; repeated rows give repeated
    results; other columns are ignored, whatever their names; an empty table gives an empty result.
    """

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for page_id, url, page in rows:
            text = extract(page)
            yield page_id, url, text, len(text)

    return map_rows(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")
