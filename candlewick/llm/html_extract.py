"""HTML extraction by tree scoring.

The page becomes a tree (lenient about missing end tags).  Every paragraph-like element passes
points for its length and its commas to its parent, half of them to its grandparent, a quarter
to the one above; what a container gets is discounted by its link density.  Points don't leave
boilerplate.  The best container is kept with the article that it stands in, or else with those
siblings that score well, are headings, or hold prose themselves.  The result is the text of
what was kept, without boilerplate inside: blocks in page order, white space inside a block as
one space, trimmed, blocks joined by one space, character references decoded.

Boilerplate is what its element says (nav, header, footer, aside, form, script, style, and
the like; the headings in an article's header stay) or what a part of its class or id names:
a layout (menu, sidebar, notice) or a kind of text that is not the article (comments, adverts,
teasers).  A name counts if nothing but common companions stands behind it ("sidebar-left", not
"related-work"), and not as a state ("has-sidebar", "no-header").  An article is boilerplate
only if it names a kind.  What is inside boilerplate scores, too: if the best of an article
there, or ``LAYOUT`` of the best that only layout names enclose, beats all that is outside, the
elements around it are freed.

Work is linear in the page: two passes over the tree.  Pages are scored one by one in the task
that reads them; there is no exchange, and every row has one result row, repeated rows too.
Null or empty html and pages without prose outside boilerplate give an empty text.  If no
paragraph earns points, the body's text outside boilerplate is taken.  A null page_id or url
stays null, further columns of any name are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from candlewick.llm.session import read

#: Attributes as the tokenizer of HTML reads them: a quote inside a name or an unquoted value is part of it.
ATTRIBUTE = r"""[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+"""
TOKEN = re.compile(rf"""<!--.*?(?:-->|$)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{ATTRIBUTE})*+)(?:>|\Z)""", re.S)
PARTS = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+))?+)?+""")
NAMES = frozenset("class id role hidden style aria-hidden".split())
SPACES = re.compile(r"\s+")

RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template title head nav header footer aside form button select option textarea input iframe object embed svg canvas audio video dialog menu xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Start tags that end an open paragraph.
ENDS_P = BLOCKS - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body"}
#: Start tags that end an open element of these names, up to the enclosing ones.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
PARAGRAPHS = frozenset("p pre blockquote td dd li".split())
#: Names of layouts, of kinds of text that are not the article, what may stand behind either, and what makes a state of it.
LAYOUTS = frozenset(
    "banner breadcrumb breadcrumbs captcha consent cookie cookies copyright dialog disclaimer footer footnav gdpr header hidden login masthead menu menubar modal nav navbar navigation newsletter notice notices overlay pager pagination paywall popup privacy "
    "rss search share sharing sidebar signup skyscraper social subscribe subscription tags toolbar toc tooltip widget".split()
)
KINDS = frozenset("ad ads adv advert adverts advertisement advertising adsense combx comment comments commentlist disqus outbrain promo promoted promotion recommended related replies reply shoutbox sponsor sponsors sponsored taboola teaser teasers".split())
COMPANIONS = frozenset(
    "area articles bar block body bottom box button buttons close column container content footer form group head holder icons inner item items label left links list main message news outer panel posts primary right rail row section secondary slot stories text thread title top topics unit wrap wrapper"
    .split()
)
STATES = frozenset("has have no non not with without hide show toggle".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Points: of a paragraph, for each comma, for each hundred characters up to a limit; characters that make one.
BASE, COMMA, PER, MOST, LEAST = 1.0, 1.0, 100, 3.0, 25
#: A sibling stays if it has this share of the best score, or enough prose with few links.
SHARE, ENOUGH = 0.2, 10.0
#: What the scores inside layouts count for, against those outside.
LAYOUT = 0.2
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FLOW = HEADINGS | frozenset("p pre blockquote ul ol dl table figure".split())
#: Elements that end the search for an open paragraph.
AROUND_P = frozenset("td th table button object".split())


class Node:
    __slots__ = ("tag", "parent", "parts", "dropped", "named", "holds", "score", "size", "links", "commas", "open_p")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False, named: str = ""):
        self.tag, self.parent, self.parts = tag, parent, []
        self.dropped, self.named, self.holds = dropped, named, False
        self.score, self.size, self.links, self.commas = 0.0, 0, 0, 0
        self.open_p = self if tag == "p" else None if parent is None or tag in AROUND_P else parent.open_p


def names(value: str) -> str:
    """What the parts of a class or id name: "kind", "layout" or nothing."""
    found = ""
    for token in value.split():
        parts = [x for x in re.split(r"[-_]+|\d+", token.lower()) if x]
        for k, part in enumerate(parts):
            if part not in LAYOUTS and part not in KINDS:
                continue
            if k and parts[k - 1] in STATES or not all(x in COMPANIONS or x in LAYOUTS or x in KINDS for x in parts[k + 1 :]):
                continue
            if part in KINDS:
                return "kind"
            found = "layout"
    return found


def boilerplate(tag: str, attributes: str) -> str:
    """Why the attributes make an element boilerplate: "hidden", "role", "kind", "layout" or nothing."""
    found = ""
    if not attributes or tag in ("html", "body", "main"):
        return found
    for name, *values in PARTS.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name not in NAMES:
            continue
        if name in ("class", "id"):
            found = max(found, names(value), key=["", "layout", "kind"].index)
        elif name == "role" and value.lower() in ROLES:
            return "role"
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return "hidden"
        elif name == "style" and "display:none" in value.replace(" ", "").lower():
            return "hidden"
    return "" if tag == "article" and found == "layout" else found


def tree(page: str) -> Node:
    root = node = Node("#root", None)
    at, end = 0, len(page)
    unclosed: dict[str, int] = {}  # start tags seen and not yet matched; may count some that were closed by others
    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            node.parts.append(page[at:])
            break
        if m.start() > at:
            node.parts.append(page[at : m.start()])
        at = m.end()
        if m.group(2) is None:
            continue
        tag = m.group(2).lower()
        if m.group(1):
            up = node if unclosed.get(tag) else root
            while up is not root and up.tag != tag:
                # an end tag inside a section doesn't reach out of it
                if up.tag in ("article", "main", "td", "table") and tag not in BLOCKS:
                    up = root
                    break
                up = up.parent
            if up is not root:
                node = up.parent
                unclosed[tag] -= 1
            elif tag == "br":
                node.parts.append(Node("br", node))
            continue
        if tag in ENDS_P and node.open_p is not None:
            node = node.open_p.parent
        if tag in SIBLINGS:
            ended, inside = SIBLINGS[tag]
            up, last = node if any(unclosed.get(x) for x in ended) else root, None
            while up is not root and up.tag not in inside:
                if up.tag in ended:
                    last = up
                up = up.parent
            if last is not None:
                node = last.parent
        own = Node(tag, node, tag in DROPPED, boilerplate(tag, m.group(3)))
        node.parts.append(own)
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            if tag == "title":
                own.parts.append(page[at : close.start() if close else end])
            at = close.end() if close else end
        elif tag not in VOID and not re.search(r"""(?:^|[\s"'])/$""", m.group(3)):
            node = own
            unclosed[tag] = unclosed.get(tag, 0) + 1
    return root


def gone(node: Node) -> bool:
    return (node.dropped or bool(node.named)) and not node.holds


def headings(header: Node) -> list[Node]:
    """Headings inside an article's header, which is boilerplate otherwise."""
    out, stack = [], list(reversed(header.parts))
    while stack:
        x = stack.pop()
        if isinstance(x, Node):
            if x.tag in HEADINGS:
                out.append(x)
            elif not gone(x):
                stack.extend(reversed(x.parts))
    return out


def text_of(nodes: list[Node], whole: bool = False) -> str:
    """Text of the nodes without boilerplate; blocks apart by a space.  Of headers inside, unless ``whole`` pages, the headings."""
    out: list[str] = []
    stack: list = list(reversed(nodes))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif not gone(x):
            if x.tag in BLOCKS:
                stack.append(" ")
            stack.extend(reversed(x.parts))
            if x.tag in BLOCKS:
                out.append(" ")
        elif x.tag == "header" and not whole and x.named != "kind":
            stack.extend(reversed(headings(x)))
    joined = "".join(out)
    if "&" in joined:
        joined = html.unescape(joined)
    return SPACES.sub(" ", joined).strip()


def measured(root: Node) -> list[Node]:
    """All nodes in page order, with what they hold outside boilerplate below them, and scores from the paragraphs."""
    order: list[Node] = []
    stack = [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(x for x in reversed(node.parts) if isinstance(x, Node))
    for node in reversed(order):
        size = links = commas = 0
        for x in node.parts:
            if isinstance(x, str):
                size += len(x.strip())
                commas += x.count(",")
            elif not gone(x):
                size += x.size
                links += x.links
                commas += x.commas
        node.size, node.links, node.commas, node.score = size, size if node.tag == "a" else links, commas, 0.0
    for node in order:
        loose = node.tag in ("div", "section", "article", "main", "body") and not any(isinstance(x, Node) and x.tag in BLOCKS and x.tag != "br" for x in node.parts)
        if not (node.tag in PARAGRAPHS or loose) or node.size < LEAST or node.parent is None or (gone(node) and not loose):
            continue
        points = (BASE + COMMA * node.commas + min(node.size / PER, MOST)) * (1 - node.links / node.size)
        up = node if loose else node.parent
        for share in (1.0, 0.5, 0.25):
            if up is None or up.tag == "#root":
                break
            up.score += points * share
            if gone(up):
                break
            up = up.parent
    for node in order:
        node.score *= 1 - node.links / max(node.size, 1)
    return order


def freed(order: list[Node]) -> bool:
    """Frees what is around the best of boilerplate, if that beats all outside; whether it did."""
    best, most, least = None, 0.0, 0.0
    # of each node: whether boilerplate is around it, whether only layouts are, and whether an article is inside that
    around: dict[int, tuple[bool, bool, bool]] = {}
    for node in order:
        inside, soft, article = around[id(node.parent)] if node.parent is not None else (False, True, False)
        if gone(node):
            inside, soft, article = True, soft and not node.dropped and node.named == "layout", False
        elif node.tag in ("article", "main"):
            article = True
        around[id(node)] = inside, soft, article
        if not inside:
            least = max(least, node.score)
        elif not gone(node) or (soft and node.score):
            score = node.score * (1.0 if article else LAYOUT if soft else 0.0)
            if score > most:
                best, most = node, score
    if best is None or most <= least:
        return False
    while best is not None:
        best.holds = True
        best = best.parent
    return True


def outside(order: list[Node]) -> list[Node]:
    hidden: set[int] = set()
    out = []
    for node in order:
        if gone(node) or (node.parent is not None and id(node.parent) in hidden):
            hidden.add(id(node))
        else:
            out.append(node)
    return out


def extract(page: str | None) -> str:
    if not page:
        return ""
    root = tree(page)
    order = measured(root)
    if freed(order):
        order = measured(root)
    best = max(outside(order), key=lambda x: x.score)
    if best.score <= 0:
        return text_of([root], True)
    # the article that it stands in, the outermost if several do
    up, article = best, None
    while up is not None:
        article = up if up.tag == "article" else article
        up = up.parent
    best = article or best
    if article is None and (best.parent is None or best.parent.tag == "#root" or best.tag in ("body", "html", "main")):
        return text_of([best])
    if article is not None and not any(isinstance(x, Node) and x is not best and x.tag == "article" and not gone(x) for x in best.parent.parts):
        return text_of([best])
    kept = []
    for x in best.parent.parts:
        if x is best:
            kept.append(x)
        elif isinstance(x, Node) and not gone(x):
            density = x.links / max(x.size, 1)
            flow = x.tag in FLOW and x.size and density < 0.25
            if x.score >= max(ENOUGH, SHARE * best.score) and density < 0.5 or (flow and article is None):
                kept.append(x)
    return text_of(kept)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                own = batch.slice(at, 64)
                texts = [extract(x) for x in own.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as bigint) page_id", "cast(url as string) url", "cast(html as string) html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(read(spark, sf_dir, "pages"))
