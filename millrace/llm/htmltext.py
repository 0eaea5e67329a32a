"""Main text of web pages by tree scoring.

A tolerant parser builds the element tree.  Paragraphs give points for their
length and commas to the elements above them (all to the parent, half to the
grandparent, less further up); an element's points are discounted by its link
density.  The best element and those of its siblings that look like text are
kept, or the whole article or main element around it, without menus, page
headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments.  An element is of these by its tag, its role, or a class name
that says so and nothing else ("social-links", not "social-history").

Null or empty html, and pages without text, give an empty text.  Broken
markup never fails: unclosed elements end with their parent, end tags without
a start are skipped.  Long and deeply nested pages are read whole.  Repeated rows are rows of
their own, also those of a null page_id or url; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>?", re.S)
ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACE = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
DROP = frozenset(
    "script style noscript template head title nav header footer aside form button select option textarea input "
    "iframe object embed svg math canvas video audio menu dialog xmp noembed noframes datalist fieldset".split()
)
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCK - frozenset("body html caption legend".split())
# tags that end open elements of a family, up to the nearest element of a scope
FAMILIES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
SAME_ENDS = {"li": "li", "dd": "dt", "dt": "dt", "tr": "tr", "td": "td", "th": "td", "option": "option"}
ENDED = frozenset().union(*(a for a, _ in FAMILIES.values()))
SCOPES = frozenset().union(*(b for _, b in FAMILIES.values()))
# words of class names that say what an element is for
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsors sponsored promo promos promotion promoted comment comments commentlist disqus "
    "replies cookie cookies consent gdpr notice notices alert alerts menu menus nav navbar navigation breadcrumb breadcrumbs sidebar side footer foot header masthead "
    "share sharing shares social related recommended newsletter subscribe subscription signup login popup modal overlay widget widgets pagination pager toolbar skip hidden".split()
)
# words that say no more than that it is a part of a page
PART = frozenset(
    "the a to of site page web main global primary secondary article post posts entry blog news story reader readers user users top bottom left right upper lower inner outer "
    "box bar list lists link links item items wrap wrapper container content section area block panel row col column slot unit zone group holder frame strip button buttons "
    "icon icons form text title label body head heading image img small large wide sticky fixed floating mobile desktop more also like you box".split()
)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
NOISY_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar form".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd h2 h3 h4".split())


class Node:
    __slots__ = ("tag", "up", "kids", "drop", "within", "paragraph", "ends", "points", "size", "links")

    def __init__(self, tag: str, up: Node | None, drop: bool):
        self.tag, self.up, self.drop = tag, up, drop
        self.within = tag in ("article", "main") or up is not None and up.within
        # the open paragraph, and the open list items, cells and the like that a tag of their family ends
        self.paragraph: Node | None = self if tag == "p" else None if up is None or tag in ("td", "th", "button", "table") else up.paragraph
        self.ends: dict[str, Node] = {} if up is None else up.ends
        if tag in ENDED or tag in SCOPES:
            own = {k: v for k, v in self.ends.items() if tag not in FAMILIES[k][1]}
            for k, (closes, _) in FAMILIES.items():
                if tag in closes:
                    own.setdefault(k, self)
            self.ends = own
        self.kids: list[Node | str] = []
        self.points, self.size, self.links = 0.0, 0, 0


def noise_name(names: str) -> bool:
    """Whether one of the names of a class or id attribute is of noise: it has a word for it, and no word of a meaning of its own."""
    for name in names.split():
        parts = [p.lower() for p in NAME_PART.findall(name)]
        if any(p in NOISE for p in parts) and all(p in NOISE or p in PART for p in parts):
            return True
    return False


def noisy(tag: str, attrs: str, within: bool) -> bool:
    """Whether an element is no part of an article; ``within``: it stands in an article or main element, whose header has its title."""
    if tag in DROP and not (within and tag in ("header", "hgroup")):
        return True
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    for name, a, b, c in ATTR.findall(attrs):
        value = a or b or c
        name = name.lower()
        if name in ("class", "id") and value and noise_name(value):
            return True
        if name == "role" and value.lower() in NOISY_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return False


def parse(page: str) -> Node:
    """The element tree, in time linear in the page; text stays as it stands, with its character references."""
    root = Node("#root", None, False)
    here, at, n = root, 0, len(page)
    opened: dict[str, int] = {}

    def close(node: Node) -> Node:
        """End all elements up to an open one and that one."""
        now = here
        while now is not node.up:
            opened[now.tag] -= 1
            now = now.up
        return now

    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            here.kids.append(page[at:])
            break
        if m.start() > at:
            here.kids.append(page[at : m.start()])
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):
            if opened.get(tag):
                node = here
                while node.tag != tag:
                    node = node.up
                here = close(node)
            continue
        if tag in ENDS_P and here.paragraph is not None:  # a block ends an open paragraph
            here = close(here.paragraph)
        if tag in SAME_ENDS and SAME_ENDS[tag] in here.ends:
            here = close(here.ends[SAME_ENDS[tag]])
        attrs = m.group(3)
        node = Node(tag, here, here.drop or noisy(tag, attrs, here.within))
        here.kids.append(node)
        if tag in VOID:
            continue
        opened[tag] = opened.get(tag, 0) + 1
        here = node
        if tag in RAW and not attrs.rstrip().endswith("/"):
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            at = end.start() if end else n
    return root


def nodes(root: Node) -> list[Node]:
    """All kept elements, parents first."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.drop:
            continue
        out.append(node)
        todo += [k for k in reversed(node.kids) if isinstance(k, Node)]
    return out


def score(all_nodes: list[Node]) -> None:
    """Sizes and links from below, then points of paragraphs to what stands above them."""
    for node in reversed(all_nodes):
        commas = 0
        own = 0
        for k in node.kids:
            if isinstance(k, str):
                own += len(k.strip())
                commas += k.count(",")
            elif not k.drop:
                node.size += k.size
                node.links += k.links
                node.points += k.points  # holds commas until points are passed
        node.size += own
        node.points += commas
        if node.tag == "a":
            node.links = node.size
    given = [(n, n.points) for n in all_nodes]
    for n in all_nodes:
        n.points = 0.0
    for node, commas in given:
        direct = node.tag in ("div", "section", "article", "main", "body") and any(
            isinstance(k, str) and len(k.strip()) >= 25 for k in node.kids
        )
        if node.tag not in PARAGRAPHS and not direct or not node.size:
            continue
        worth = (1 + commas + min(node.size / 100, 3)) * (1 - node.links / node.size)
        up, share = node if direct else node.up, 1.0
        for level in range(1, 6):
            if up is None or up.tag in ("#root", "html"):
                break
            up.points += worth * share
            up, share = up.up, 1 / (2 * level)
    for n in all_nodes:
        n.points *= 1 - n.links / n.size if n.size else 0


def kept(root: Node) -> list[Node]:
    """The best container and those siblings that belong to it, in page order."""
    every = nodes(root)
    score(every)
    best = max(every, key=lambda n: (n.points, -len(n.kids)))
    if best.points <= 0:
        best = next((n for n in every if n.tag in ("article", "main")), None) or next((n for n in every if n.tag == "body"), root)
    whole = best
    while whole is not None and whole.tag not in ("article", "main"):
        whole = whole.up
    if whole is not None and whole is not best:
        return [whole]
    if best.up is None or best.tag in ("body", "html"):
        return [best]
    least, out = max(10.0, 0.2 * best.points), []
    for k in best.up.kids:
        if not isinstance(k, Node) or k.drop:
            continue
        dense = k.links / k.size if k.size else 1
        if k is best or k.points >= least and k.tag == best.tag or k.tag == "p" and k.size > 80 and dense < 0.25:
            out.append(k)
        elif k.tag in ("h1", "h2") and k.size and dense < 0.25 and not any(o is best for o in out):
            out.append(k)
    return out


def blocks(top: list[Node]) -> list[str]:
    """Texts of the blocks below some elements, in page order."""
    out: list[str] = []
    parts: list[str] = []

    def close() -> None:
        if parts:
            text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append(text)
            parts.clear()

    for node in top:
        todo: list = [node]
        while todo:
            x = todo.pop()
            if x is None:
                close()
            elif isinstance(x, str):
                parts.append(x)
            elif not x.drop:
                if x.tag == "br":
                    parts.append(" ")
                    continue
                if x.tag in BLOCK or x is node:
                    close()
                    todo.append(None)
                todo += reversed(x.kids)
        close()
    return out


def main_text(page: str | None) -> str:
    """The article of a page, its blocks joined by line breaks."""
    return "\n".join(blocks(kept(parse(page)))) if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page, in one map stage."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column("html")]
            yield pa.RecordBatch.from_pydict({
                "page_id": b.column("page_id"), "url": b.column("url"), "text": pa.array(texts, pa.string()),
                "n_chars": pa.array(map(len, texts), pa.int64()),
            })

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
