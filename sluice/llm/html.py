"""Main text of HTML pages by tree scoring."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map

# A quote counts only after "="; a tag or value that isn't closed goes to the page's end. Nothing is read twice.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?)*+)(>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

# Fixed values of HTML: how elements nest and which hold no prose.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes template".split())
#: Drawings and formulas, and the elements that end one that isn't closed.
FOREIGN = frozenset("svg math".split())
ENDS_FOREIGN = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s section article small span strong strike sub sup table tt u ul var".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"body", "caption", "html", "legend", "option", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: An element that ends open elements of these kinds, up to the nearest of the others.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "a": ({"a"}, {"td", "th", "body"}),
}
SCOPE = frozenset("table td th caption html button object".split())
#: Elements and words in class, id or role that mark what isn't the article.
ASIDE = frozenset("nav aside footer button select input menu dialog audio video canvas object embed label svg math".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline-links comment comments commentlist complementary contentinfo cookie cookies consent disclaimer discussion disqus footer form gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification paywall popup promo promoted promotion recommend recommended related replies reply respond search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription tags toolbar widget widgets alert".split()
)
#: Those of MARKS whose elements often hold more prose than a short article.
TALK = frozenset("comment comments commentlist discussion disqus recommend recommended related replies reply respond sidebar sidebars widget widgets".split())
#: Words beside those of MARKS in a name that still says what the element is for: "comment-list", "site-footer", "ad-slot".
PLAIN = frozenset("area articles aside bar bars block bottom box btn button buttons center column container content fixed full group header heading holder inner item items js left letter line link links list local main middle mobile modal module outer overlay panel placeholder policy post posts primary reader right rail row section secondary shell signup site slot small sticky stories strip sub tab tags text thread top unit user users view wide wrap wrapper zone".split())
#: Share of linked text, and of the page's unlinked text, by which an element whose name only touches on a mark is left out: much of its text linked, or little text.
LINKED, LITTLE = 1 / 3, 0.1
#: Share of the page's unlinked text from which an article element counts as the page's own, and by which alone a page without headings is one element.
OWN, WHOLE = 0.2, 0.8
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class _Node:
    __slots__ = ("tag", "parent", "out", "marks", "weak", "chars", "linked", "score")

    def __init__(self, tag: str, parent: _Node | None, out: bool, marks: tuple[frozenset[str], bool] = (frozenset(), False)):
        self.tag, self.parent, self.out = tag, parent, out
        self.marks, self.weak = marks
        self.chars, self.linked, self.score = 0, 0, 0.0


def _attributes(raw: str) -> dict[str, str]:
    """Names in lower case and values; of a repeated name the first counts."""
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(raw):
        found.setdefault(name.lower(), "".join(values))
    return found


def _is_out(tag: str, attributes: dict[str, str], parent: _Node | None) -> bool:
    """Whether an element that opens is left out with all it holds, however much that is."""
    if tag in ASIDE:
        return True
    if tag == "header":
        at = parent
        while at and at.tag not in ("article", "main"):
            at = at.parent
        if not at:
            return True
    if tag in ("html", "body", "article", "main"):
        return False
    return "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or bool(_UNSEEN.search(attributes.get("style", "")))


def _marks(tag: str, attributes: dict[str, str]) -> tuple[frozenset[str], bool]:
    """The words of MARKS that a form is or that class, id and role hold, and whether they only occur beside other words ("market-share", "related-work"), which says little."""
    found, weak = {"form"} if tag == "form" else set(), True
    for name in " ".join(attributes.get(x, "") for x in ("class", "id", "role")).split():
        own = {w.lower() for w in _WORD.findall(name)}
        if own & MARKS:
            found |= own & MARKS
            weak = weak and not all(w in MARKS or w in PLAIN or w.isdigit() for w in own)
    return frozenset(found), weak and tag != "form" and bool(found)


def _around(node: _Node | None) -> Iterator[_Node]:
    """The element and those that hold it."""
    while node:
        yield node
        node = node.parent


def _leave_out(nodes: list[_Node], pieces: list[list | None]) -> list[list | None]:
    """The pieces that stay when marked elements go, which are then out with all they hold.

    An element whose name only touches on a mark pays with its form: it goes if more than LINKED of its text is linked, or if it has less than LITTLE of the page's unlinked text and no heading. Another marked element stays if it holds a main element, the article element with most text, or more than half of the page's unlinked text where no article or main element lies elsewhere: a wrapper's name says little. One named by TALK needs, besides, a heading of its own (h1, h2; WHOLE of the text if the page has none).
    """
    soft = [n for n in nodes if n.marks and not n.out and n.tag not in ("article", "main") and n.tag not in HEADING]
    if not soft:
        return pieces
    size, linked, titles, heads, mains = ({id(n): 0 for n in nodes} for _ in range(5))
    for piece in pieces:
        if piece is not None:
            (linked if piece[2] else size)[id(piece[0])] += len("".join(piece[1].split()))
    for n in nodes:
        if not n.out and not n.marks:
            titles[id(n)], heads[id(n)], mains[id(n)] = int(n.tag in ("h1", "h2")), int(n.tag in HEADING), int(n.tag == "main")
    for n in reversed(nodes):  # parents come before what they hold
        if n.parent:
            for of in (size, linked, titles, heads, mains):
                of[id(n.parent)] += of[id(n)]
    total = size[id(nodes[0])]
    articles = [n for n in nodes if n.tag in ("article", "main") and not n.out and not n.marks and size[id(n)]]
    own = max((n for n in articles if n.tag == "article" and size[id(n)] >= OWN * total), key=lambda n: size[id(n)], default=None)
    above = {id(n) for n in _around(own)} if own else set()
    open_ = {id(n) for n in soft}

    def elsewhere(of: _Node) -> bool:
        """Whether an article lies beside this element, in none that is left out or not yet judged."""
        around = {id(n) for n in _around(of)}
        return any(id(a) not in around and not any(id(n) in open_ for n in _around(a)) for a in articles)

    for n in soft:  # a wrapper comes before what it holds
        k = id(n)
        titled = titles[k] > 0 if titles[id(nodes[0])] else size[k] >= WHOLE * total
        if n.weak:
            n.out = linked[k] > LINKED * (linked[k] + size[k]) or (size[k] < LITTLE * total and not heads[k])
            if not n.out:
                open_.discard(k)
            continue
        n.out = not (mains[k] or (not n.marks & TALK or titled) and (k in above or 2 * size[k] > total and not elsewhere(n)))
        if not n.out:
            open_.discard(k)
    for n in nodes:
        n.out = n.out or bool(n.parent and n.parent.out)
    return [p for p in pieces if p is None or not p[0].out]


def _parse(page: str) -> tuple[list[_Node], list[list]]:
    """The elements in page order, and the blocks of text: [nearest block element, element, text, whether in a link], a None between blocks."""
    root = _Node("html", None, False)
    nodes, stack, pieces = [root], [root], []
    links, at = 0, 0

    def close(to: int) -> None:
        nonlocal links
        while len(stack) > to:
            gone = stack.pop()
            links -= gone.tag == "a"
            if gone.tag in BLOCK and pieces and pieces[-1] is not None:
                pieces.append(None)

    def text(raw: str) -> None:
        if raw and not stack[-1].out:
            pieces.append([stack[-1], raw, links > 0])

    raw_end = None
    while True:
        if raw_end:
            m = re.compile(rf"</{raw_end}[\s/>]", re.I).search(page, at)
            if not m:
                break  # as browsers do, all the rest is its content
            at = m.start()
            raw_end = None
        m = _TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        if not m[4]:  # the page ends within a tag
            break
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                text(" ")
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
                if stack[i].tag in SCOPE and tag not in BLOCK and tag != "html":
                    break
            continue
        if tag in ("html", "head", "body"):
            if tag == "body" and len(stack) == 1:
                stack.append(_Node("body", root, False))
                nodes.append(stack[-1])
            continue
        if tag in ENDS_FOREIGN:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "foreignobject":
                    break
                if stack[i].tag in FOREIGN:
                    close(i)
                    break
        if tag in RAW and not any(n.tag in FOREIGN for n in stack[1:]):
            raw_end = tag
            continue
        if tag == "br" or tag == "wbr":
            if tag == "br":
                text(" ")
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in SCOPE:
                    break
        if tag in ENDS:
            ended, limit = ENDS[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in limit:
                    break
                if stack[i].tag in ended:
                    close(i)
                    break
        if tag in BLOCK and pieces and pieces[-1] is not None:
            pieces.append(None)
        if tag in VOID:
            continue
        attributes = _attributes(m[3]) if m[3] else {}
        node = _Node(tag, stack[-1], stack[-1].out or _is_out(tag, attributes, stack[-1]), _marks(tag, attributes))
        nodes.append(node)
        if not m[3].rstrip().endswith("/") or tag in BLOCK:
            stack.append(node)
            links += tag == "a"
    return nodes, pieces


def _blocks(pieces: list[list | None]) -> Iterator[tuple[_Node, str, int]]:
    """The nearest block element, the text and its linked characters of each block that isn't blank."""
    group: list[list] = []
    for piece in [*pieces, None]:
        if piece is not None:
            group.append(piece)
            continue
        if group:
            whole = " ".join(html.unescape("".join(p[1] for p in group)).split())
            if whole:
                at = group[0][0]
                for p in group:
                    if p[1].strip():
                        at = p[0]
                        break
                while at.tag not in BLOCK and at.parent:
                    at = at.parent
                yield at, whole, sum(len(" ".join(html.unescape(p[1]).split())) for p in group if p[2])
            group = []


def main_text(page: str | None) -> str:
    """The article of an HTML page: its blocks in page order, joined by newlines; "" if there is none.

    Every block of text (a paragraph, a cell, a list item, an element with text of its own) gives 1 point, 1 for each comma and 1 for each 100 characters, discounted by its share of linked text, to the element that holds it, half to the next, and a smaller part to each further ancestor. An element's points are multiplied by its share of text outside of links. The best element, or the article or main element around it, is the container; of its siblings those stay that hold a heading or have a fifth of its points and few links. Menus, headers, footers, asides, forms and elements whose class, id or role says so (MARKS) neither score nor stay; a form or marked element that holds the article or most of the text isn't left out (see _leave_out), and none is where nothing else has text. Of the container all blocks stay, however short.
    """
    if not page:
        return ""
    nodes, pieces = _parse(page)
    found = _best_text(nodes, _leave_out(nodes, pieces))
    if not found and any(n.marks for n in nodes):
        nodes, pieces = _parse(page)
        found = _best_text(nodes, pieces)
    return found


def _best_text(nodes: list[_Node], pieces: list[list | None]) -> str:
    """The blocks of the best element and of the siblings that stay."""
    blocks = list(_blocks(pieces))
    if not blocks:
        return ""
    for at, whole, linked in blocks:
        holder = at.parent if at.tag in ("p", "pre", "li", "td", "th", "dd", "dt", "blockquote", "figcaption") or at.tag in HEADING else at
        if at.tag not in HEADING:
            points = (1 + whole.count(",") + whole.count("、") + whole.count("，") + len(whole) / 100) * (1 - min(1.0, linked / len(whole)))
            level, to = 0, holder
            while to:
                to.score += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
                level, to = level + 1, to.parent
        to = at
        while to:
            to.chars += len(whole)
            to.linked += linked
            to = to.parent
    worth = lambda n: n.score * (1 - min(1.0, n.linked / max(n.chars, 1)))
    best = max(nodes, key=worth)
    if worth(best) <= 0:
        return ""
    at = best
    while at:
        if at.tag in ("article", "main"):
            best = at
            if at.tag == "article":
                break
        at = at.parent
    limit, keep = worth(best) / 5, {id(best)}
    for n in nodes:
        if n is not best and n.parent is best.parent and best.parent and not n.out and n.chars:
            few = n.linked <= n.chars / 4
            if few and (n.tag in HEADING or n.tag == "p" or worth(n) >= limit):
                keep.add(id(n))
    out = []
    for at, whole, linked in blocks:
        to = at
        while to and id(to) not in keep:
            to = to.parent
        if to:
            out.append(whole)
    return "\n".join(out)


def extract(df: DataFrame, column: str = "html") -> DataFrame:
    """df with text, the main text of each whole page (see main_text; null gives ""), and n_chars, its code points, in place of column. Map only. Other columns stay; those named text and n_chars are replaced."""
    others = [f for f in df.schema if f.name not in (column, "text", "n_chars")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in others] + ["text string", "n_chars long"])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = [main_text(x.as_py()) for x in batch.column(batch.schema.get_field_index(column))]
            kept = [batch.column(batch.schema.get_field_index(f.name)) for f in others]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*(f.name for f in others), "text", "n_chars"])

    return arrow_map(df.select(*(f.name for f in others), column), batches, schema)
