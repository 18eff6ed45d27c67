"""Main text of HTML pages: boosted trees over features of DOM nodes, decoded along the hierarchy.

A page is read into a tree of elements. The trees score every element from its own tag, attribute tokens, depth,
siblings and the density of its subtree. Decoding chooses the set of kept elements with the largest total score in
which no kept element lies below a dropped one, so an ancestor and a descendant never contradict each other. The model
is trained on pages made here (``training_pages``) in many layouts, whose main text is known by construction.
"""

from __future__ import annotations

import dataclasses
import functools
import html as entities
import math
import random
import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonegauge.llm import boosting
from tonegauge.llm.common import map_columns, ship

# Fixed word lists: HTML's element classes, and tokens of class, id, role and aria attributes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg audio video textarea title head select option".split())
#: Embedded content whose text belongs to the element around it: kept exactly when that is.
EMBEDDED = frozenset("math object canvas".split())
OPAQUE = frozenset("script style textarea title iframe noscript template".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_PARAGRAPH = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "body", "html"}
TAG_KINDS = [
    {"article"}, {"main"}, {"section"}, {"div"}, {"p", "blockquote", "pre"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "dl", "menu"}, {"li", "dt", "dd"}, {"nav"},
    {"header"}, {"footer"}, {"aside"}, {"form", "button", "label", "fieldset", "legend", "input", "dialog"}, {"table", "tbody", "thead", "tfoot", "tr", "td", "th"}, {"a"}, {"html", "body", "#root"}, {"figure", "figcaption"},
]
TAG_BITS = {tag: sum(1 << k for k, kind in enumerate(TAG_KINDS) if tag in kind) for kinds in TAG_KINDS for tag in kinds}
TOKEN_KINDS = [
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner teaser affiliate outbrain taboola",
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc tabs links topbar skip",
    "header masthead top branding logo sitehead pagehead siteheader",
    "footer foot bottom copyright colophon sitefooter legal imprint contentinfo",
    "sidebar side aside widget related recommended recommendations trending popular complementary rail more also read",
    "comment comments reply replies discussion disqus respond commentlist reader readers feedback remarks thread reviews",
    "notice cookie cookies consent gdpr alert message warning popup modal overlay privacy notification disclaimer banner toast subscribe newsletter signup paywall",
    "form search login register contact input poll survey",
    "share sharing social follow twitter facebook tools toolbar print tags meta byline author date",
    "article post entry story content main body text copy prose articlebody maincontent paragraph page",
]
TOKEN_SETS = [frozenset(kind.split()) for kind in TOKEN_KINDS]
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+))""")
QUOTED = re.compile(r"""=\s*(?:"[^"]*"|'[^']*'|[^\s"'=<>`]+)""")
HIDDEN = re.compile(r"(?:^|[\s/])hidden(?=[\s=/]|$)", re.I)
TOKEN = re.compile(r"[a-z]+")
#: Quotes count right after an equals sign only; a quoted value without its closing quote ends with the tag.
MARKUP = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>\x00]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|\Z)", re.S)
WHITE = re.compile("[" + "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])) + "]+")


@dataclasses.dataclass(slots=True)
class Node:
    tag: str
    parent: int
    depth: int
    place: int
    kinds: int
    hidden: bool
    children: list
    items: list  # texts, and children by number, in page order
    last: int = 0


def parse(page: str) -> list[Node]:
    """Elements in page order, the root first. Unclosed and stray tags are allowed; comments, markup and raw elements hold no text."""
    nodes = [Node("#root", -1, 0, 0, 0, False, [], [])]
    open_, at, size = [0], 0, len(page)
    held: Counter[str] = Counter()  # open elements of each tag

    def close(tags: Iterable[str], stop: frozenset[str]) -> bool:
        if not any(held[tag] for tag in tags):  # a stray end tag costs no walk
            return False
        for i in range(len(open_) - 1, 0, -1):
            name = nodes[open_[i]].tag
            if name in tags:
                held.subtract(nodes[n].tag for n in open_[i:])
                del open_[i:]
                return True
            if name in stop:
                return False
        return False

    while at < size:
        found = MARKUP.search(page, at)
        text = page[at : found.start()] if found else page[at:]
        if text:
            nodes[open_[-1]].items.append(text)
        if not found:
            break
        at = found.end()
        slash, tag, rest = found.group(1), found.group(2), found.group(3)
        if tag is None:
            if found.group().startswith("<![CDATA["):
                nodes[open_[-1]].items.append(entities.escape(found.group()[9:].removesuffix("]]>")))
            continue
        tag = tag.lower()
        if slash:
            if tag == "br":
                nodes[open_[-1]].items.append(" ")
            elif tag in BLOCKS:
                close({tag}, frozenset())
            else:
                close({tag}, BLOCKS)
            continue
        if tag == "br" or tag == "wbr":
            nodes[open_[-1]].items.append(" " if tag == "br" else "")
            continue
        if tag in ENDS_PARAGRAPH:
            close({"p"}, BLOCKS - {"p"})
        if tag == "li":
            close({"li"}, frozenset({"ul", "ol", "menu"}))
        elif tag in ("dt", "dd"):
            close({"dt", "dd"}, frozenset({"dl"}))
        elif tag in ("td", "th"):
            close({"td", "th"}, frozenset({"tr", "table"}))
        elif tag == "tr":
            close({"tr"}, frozenset({"table"}))
        elif tag == "option":
            close({"option"}, frozenset({"select"}))
        if tag in OPAQUE and not rest.rstrip().endswith("/"):
            ending = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = ending.end() if ending else size
            continue
        kinds, hidden = 0, False
        if rest and "=" in rest:
            for name, one, two, three in ATTRIBUTE.findall(rest):
                name = name.lower()
                if name in ("class", "id", "role", "aria-label", "itemprop", "data-component"):
                    parts = set(TOKEN.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", one or two or three).lower()))
                    for k, known in enumerate(TOKEN_SETS):
                        if not known.isdisjoint(parts):
                            kinds |= 1 << k
                elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", one or two or three, re.I):
                    hidden = True
        if rest and "hidden" in rest.lower() and HIDDEN.search(QUOTED.sub("= ", rest)):  # the attribute's name, not a word of some value
            hidden = True
        up = open_[-1]
        nodes.append(Node(tag, up, nodes[up].depth + 1, len(nodes[up].children), kinds, hidden, [], []))
        number = len(nodes) - 1
        nodes[up].children.append(number)
        nodes[up].items.append(number)
        if tag not in VOID and not rest.rstrip().endswith("/") or tag in ("p", "div", "li", "section", "article"):
            open_.append(number)
            held[tag] += 1
    return nodes


def features(nodes: list[Node]) -> np.ndarray:
    """One row for each element, tags and tokens as bit sets; every number is taken from the page itself, whole."""
    count = len(nodes)
    own, linked, tags, paras, commas, kinds_below = [0] * count, [0] * count, [1] * count, [0] * count, [0] * count, [0] * count
    for number in range(count - 1, -1, -1):
        node = nodes[number]
        node.last = number
        for item in node.items:
            if isinstance(item, str):
                own[number] += len(item.strip())
                commas[number] += item.count(",") + item.count(".")
            else:
                node.last = max(node.last, nodes[item].last)
                own[number] += own[item]
                linked[number] += linked[item]
                tags[number] += tags[item]
                paras[number] += paras[item]
                commas[number] += commas[item]
                kinds_below[number] |= kinds_below[item] | nodes[item].kinds
        if node.tag == "a":
            linked[number] = own[number]
        if node.tag == "p" and own[number] > 40:
            paras[number] += 1
    total = max(1, own[0])
    rows, above, tag_above = [], [0] * count, [0] * count
    for number, node in enumerate(nodes):
        siblings = 1
        if node.parent >= 0:
            up = nodes[node.parent]
            above[number] = above[node.parent] | up.kinds
            tag_above[number] = tag_above[node.parent] | TAG_BITS.get(up.tag, 0)
            siblings = len(up.children)
        size = own[number] or 1
        rows.append((
            TAG_BITS.get(node.tag, 0), node.kinds, above[number], tag_above[number], node.depth, siblings, node.place / siblings,
            math.log1p(own[number]), own[number] / total, linked[number] / size, own[number] / tags[number], min(paras[number], 20),
            commas[number] / size, len(node.children), node.hidden, number / count, (kinds_below[number] & 0xFF).bit_count(),
        ))
    return np.array(rows, float)


def widened(table: np.ndarray) -> np.ndarray:
    """Bit sets as columns of 0 and 1."""
    bits = lambda column, width: (table[:, column].astype(np.int64)[:, None] >> np.arange(width)) & 1
    return np.hstack([bits(0, len(TAG_KINDS)), bits(1, len(TOKEN_SETS)), bits(2, len(TOKEN_SETS)), bits(3, len(TAG_KINDS)), table[:, 4:]]).astype(np.float32)


def decode(nodes: list[Node], score: np.ndarray) -> list[bool]:
    """Kept elements: the best total of scores such that all of a kept element's ancestors are kept too.

    An element whose subtree cannot repay the ancestors it needs is dropped with everything below it.
    """
    best = np.clip(score, -12, 3).tolist()
    follows = [False] * len(nodes)  # elements of embedded content, which add nothing to the choice
    for number, node in enumerate(nodes):
        follows[number] = node.parent >= 0 and (follows[node.parent] or node.tag in EMBEDDED)
    for number in range(len(nodes) - 1, -1, -1):
        node = nodes[number]
        gain = best[number] + sum([best[child] for child in node.children]) if node.children else best[number]
        best[number] = gain if gain > 0 and not follows[number] and not node.hidden and node.tag not in RAW else 0.0
    kept = [False] * len(nodes)
    for number, node in enumerate(nodes):
        able = best[number] > 0 or follows[number] and not node.hidden and node.tag not in RAW
        kept[number] = able and (node.parent < 0 or kept[node.parent])
    return kept


def text_of(nodes: list[Node], kept: list[bool]) -> str:
    """Text of the kept elements: one line for each block, white space as one space, character references decoded."""
    lines, line = [], []

    def flush() -> None:
        # references first, so that a reference to white space counts as white space
        flat = "".join(line)
        flat = WHITE.sub(" ", entities.unescape(flat) if "&" in flat else flat).strip(" ")
        if flat:
            lines.append(flat)
        line.clear()

    stack: list = [0]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            line.append(item)
        elif item < 0:
            flush()
        elif kept[item]:
            node = nodes[item]
            if node.tag in BLOCKS:
                flush()
                stack.append(-1)
            stack.extend(reversed(node.items))
    flush()
    return "\n".join(lines)


# training


def training_pages(count: int = 400, seed: int = 11) -> list[tuple[str, list[str]]]:
    """Pages in random layouts, with the marks of their main elements: every tag carries `data-k`, 1 for main text."""
    draw = random.Random(seed)

    def sentence(low=4, high=18):
        return " ".join("".join(draw.choices("abcdefghijklmnoprstuvw", k=draw.randint(2, 9))) for _ in range(draw.randint(low, high))).capitalize() + draw.choice([".", ".", ",", ""])

    def prose(low=1, high=5):
        return " ".join(sentence() for _ in range(draw.randint(low, high)))

    def element(tag, inside, keep, attributes=""):
        return f'<{tag} data-k="{int(keep)}"{" " + attributes if attributes else ""}>{inside}</{tag}>'

    def naming(kind):
        names = TOKEN_KINDS[kind].split()
        return f'{draw.choice(["class", "class", "id"])}="{draw.choice(["", "site-", "page-", "js-"])}{draw.choice(names)}{draw.choice(["", "-box", "-wrap", " block", "-list"])}"'

    def links(low=2, high=9):
        items = [element("li", element("a", sentence(1, 3), 0, 'href="/x"'), 0) for _ in range(draw.randint(low, high))]
        return element(draw.choice(["ul", "ol"]), "".join(items), 0) if draw.random() < 0.7 else "".join(element("a", sentence(1, 3), 0, 'href="/y"') for _ in items)

    def junk():
        kind = draw.randrange(9)
        tag = draw.choice(["div", "div", "section", "aside", *[{0: "aside", 1: "nav", 2: "header", 3: "footer", 4: "aside", 5: "section", 6: "div", 7: "form", 8: "div"}[kind]] * 3])
        body = draw.choice([lambda: sentence(), lambda: element("p", prose(1, 3), 0), lambda: element("h2", sentence(1, 2), 0) + "".join(element("p", prose(1, 4), 0) for _ in range(draw.randint(1, 4))), links, lambda: element("h3", sentence(1, 4), 0) + links(), lambda: "".join(element("div", element("p", prose(1, 2), 0), 0, naming(5) if kind == 5 else "") for _ in range(draw.randint(1, 4)))])()
        semantic = tag in ("nav", "header", "footer", "form") or tag == "aside"
        return element(tag, body, 0, "" if semantic and draw.random() < 0.5 else naming(kind))

    def main():
        parts = []
        if draw.random() < 0.8:
            parts.append(element(draw.choice(["h1", "h1", "h2"]), sentence(2, 9), 1))
        for _ in range(draw.choice([0, 1, 1, 1, 2, 3, 5, 8, 14])):
            pick = draw.random()
            if pick < 0.72:
                inside = prose() if draw.random() < 0.7 else prose(1, 2) + " " + element(draw.choice(["b", "em", "i", "strong", "span", "a", "code"]), sentence(1, 4), 1) + " " + prose(0, 2)
                parts.append(element("p", inside, 1))
            elif pick < 0.8:
                parts.append(element(draw.choice(["h2", "h3"]), sentence(2, 6), 1))
            elif pick < 0.86:
                parts.append(element("ul", "".join(element("li", sentence(), 1) for _ in range(draw.randint(2, 5))), 1))
            elif pick < 0.9:
                parts.append(element("blockquote", draw.choice([prose(), element("p", prose(), 1)]), 1))
            elif pick < 0.93:
                parts.append(element("table", element("tr", element("td", sentence(), 1) + element("td", sentence(1, 3), 1), 1), 1))
            elif pick < 0.95:
                parts.append(element("pre", element("code", sentence(), 1), 1))
            else:
                parts.append(element("figure", element("figcaption", sentence(), 1), 1))
        for _ in range(draw.choice([0, 0, 0, 1, 1, 2])):
            parts.insert(draw.randint(0, len(parts)), junk())
        return "".join(parts)

    pages = []
    for _ in range(count):
        head = f"<html data-k=\"1\"><head><title>{sentence()}</title><style>p{{}}</style></head>"
        style = draw.random()
        article = main() if style < 0.1 else element("article", main(), 1) if style < 0.55 else element("main", main(), 1) if style < 0.7 else element("div", main(), 1, naming(9))
        if draw.random() < 0.3:
            article = element(draw.choice(["main", "div", "section"]), "".join(junk() for _ in range(draw.randint(0, 2))) + article + "".join(junk() for _ in range(draw.randint(0, 2))), 1, draw.choice(["", naming(9), 'class="container"', 'id="wrapper"']))
        bare = draw.random() < 0.08  # nothing but the main text
        before = "" if bare else "".join(junk() for _ in range(draw.randint(0, 4)))
        after = "" if bare else "".join(junk() for _ in range(draw.randint(0, 4)))
        if not bare and draw.random() < 0.5:
            before = element("nav", links(), 0) + before
        if not bare and draw.random() < 0.5:
            after += element("footer", draw.choice([sentence(2, 25), element("p", sentence(), 0), links(1, 4)]), 0)
        pages.append(f'{head}<body data-k="1">{before}{article}{after}</body></html>')
    return pages


@functools.lru_cache(maxsize=4)
def train(count: int = 600, seed: int = 11) -> boosting.Boosted:
    """Boosted trees over every element of the training pages; ``count`` bounds them. Each page weighs the same."""
    tables, labels = [], []
    for page in training_pages(count, seed):
        marks = [1.0, *(float(m) for m in re.findall(r'<[a-z0-9]+ data-k="(\d)"', page))]
        nodes = parse(re.sub(r'<head>.*?</head>', "", page).replace(' data-k="0"', "").replace(' data-k="1"', ""))
        if len(nodes) == len(marks):
            tables.append(widened(features(nodes)))
            labels.append(np.array(marks))
    return boosting.fit(np.vstack(tables), np.concatenate(labels), trees=60, depth=5, rate=0.25)


def extract(page: str | None, model: boosting.Boosted) -> str:
    """Main text of one page; empty for NULL, empty and text-free pages."""
    if not page:
        return ""
    nodes = parse(page)
    return text_of(nodes, decode(nodes, model.score(widened(features(nodes)))))


def extract_pages(pages: DataFrame, html: Column, keys: dict[str, str], model: boosting.Boosted | None = None) -> DataFrame:
    """text and n_chars of every whole page, beside the key columns. NULL and empty pages: empty text, 0."""
    shipped = ship(pages.sparkSession, model or train())
    schema = ", ".join(f"`{name}` {kind}" for name, kind in keys.items()) + ", text string, n_chars bigint"

    def make():
        own = shipped()

        def step(*columns):
            texts = [""] * len(columns[-1])
            trees, tables, held = [], [], 0

            def solve() -> None:
                scores = own.score(widened(np.vstack(tables)))
                first = 0
                for i, nodes in trees:
                    texts[i] = text_of(nodes, decode(nodes, scores[first : first + len(nodes)]))
                    first += len(nodes)

            for i, page in enumerate(columns[-1]):
                if page:
                    nodes = parse(page)
                    trees.append((i, nodes))
                    tables.append(features(nodes))
                    held += len(nodes)
                    if held > 20_000:
                        solve()
                        trees, tables, held = [], [], 0
            if trees:
                solve()
            return [*columns[:-1], texts, [len(t) for t in texts]]

        return step

    return map_columns(pages, [*[F.col(f"`{name}`").cast(kind) for name, kind in keys.items()], html], schema, make)
