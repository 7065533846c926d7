"""Main text of web pages by wrappers inferred for each host.

A wrapper is a union-free regular expression over a page's tags and text slots, kept as a tree: each node is an element that
may be optional or repeated and may hold text. A page is its own first wrapper, once runs of alike neighbours are folded into
one repeated group. Two wrappers are aligned child by child; what both have is merged, what one lacks becomes optional, and
the folding is repeated. Tasks fold the pages they read into one wrapper per host; these partial wrappers are folded in
groups of FAN, round by round, so no task sees all pages of a host.

Every page is then aligned with its host's wrapper, which gives each block of text the slot it fills. What of a page is its
article is read from the slots, by counts over all pages of the host:

* a text that fills the same slot on most of the host's different pages (three at least) is the template's. It goes only with
  its unit, the container around it or the heading above it with what follows, if on most of these pages all text of the
  unit is the template's; labels of a table that varies, a quote or a heading of the article stay;
* on pages without an article or main element, a slot whose text is mostly links goes;
* a container whose class speaks of nothing but what stands beside an article (for reader comments, its id too) goes unless it
  holds half of the host's text or more.

Elements that HTML itself sets beside the article (nav, aside, form, footer, ...) and what stands outside an article or main
element, on pages that have one with text, never count.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatloom.llm.common import forget, save

ATTRIBUTES = r"""(?:[^>"'=]|=\s*"[^"]*(?:"|\Z)|=\s*'[^']*(?:'|\Z)|[="'])*"""
TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({ATTRIBUTES})(?:>|\Z)""", re.S)
NAMED = re.compile(r"""(?:^|[\s"'/])(class|role|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Elements deeper than this lie in the wrapper's deepest node.
DEPTH = 60
REPEATED_GROUP = 3
#: Children of a wrapper's node; one that would have more takes each kind of child any number of times, in any order.
WIDE = 128
#: Partial wrappers that one task folds at once.
FAN = 64
#: Different pages that must show a text in a slot before it counts as the template's.
WITNESSES = 3

# Fixed word lists: element names and roles of HTML by their part in a page's layout.
RAW = frozenset("script style title textarea noscript template iframe svg object xmp".split())
BLOCKS = frozenset("html body head main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address nav header footer aside form fieldset details summary hgroup menu dialog center".split())
ENDS_PARAGRAPH = BLOCKS - {"html", "body", "head"}
CLOSED_BY_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
CONTAINERS = frozenset("ul ol dl table article section div main aside nav form".split())
GROUPS = frozenset("div ul ol dl table".split())
AROUND = CONTAINERS | frozenset("body header footer figure blockquote".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BESIDE = frozenset("head nav footer aside form menu dialog button select".split())
BESIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar".split())
ARTICLE = frozenset("article main".split())
# Fixed word lists: first words of class names that speak of what stands beside an article, a vote that counts can overturn; the
# words of layout that may follow them; and words for reader comments. Any other word takes the vote back.
BESIDE_WORDS = frozenset("ad ads advert advertisement adbox adslot sponsor sponsored promo sidebar menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice alert popup modal newsletter subscribe share sharing social comment comments disqus replies respond login signup widget toolbar pager pagination".split())
HEADER_WORDS = frozenset("header masthead banner".split())
LAYOUT_WORDS = frozenset("area bar bars block body bottom box buttons button column container content count fixed form group header inner item items label left link links list main outer overlay panel placeholder row right section side site slot sticky strip text thread title top unit wrap wrapper zone".split())
COMMENT_WORDS = frozenset("comment comments disqus replies respond".split())
INLINE = frozenset("button select".split())


class Node:
    """An element of a page or wrapper: name, marks (words of its class and id) and items.

    Of a page: `votes` are the words that speak of what stands beside an article, items are nodes, (text, in a link) pairs and None for line breaks. Of a wrapper: items are nodes; `text` says
    whether there is a slot, `free` that the children come in any order, and `number` is the node's place in the wrapper.
    """

    __slots__ = ("name", "marks", "items", "role", "optional", "repeated", "text", "free", "number", "places", "votes")

    def __init__(self, name: str, marks: tuple[str, ...] = (), role: str = "", votes: frozenset = frozenset()):
        self.name, self.marks, self.items, self.role, self.votes = name, marks, [], role, votes
        self.optional = self.repeated = self.text = self.free = False
        self.number, self.places = -1, None

    @property
    def symbol(self) -> tuple:
        return (self.name, self.marks)

    @property
    def is_article(self) -> bool:
        return self.name in ARTICLE or self.role == "main"

    @property
    def is_beside(self) -> bool:
        return self.name in BESIDE or self.role in BESIDE_ROLES

    def is_voted(self, article: bool) -> bool:
        """Whether its class speaks against it; that of a header only outside the article, for it may hold the title."""
        votes = BESIDE_WORDS if article else BESIDE_WORDS | HEADER_WORDS
        return self.name in CONTAINERS and not self.is_article and not votes.isdisjoint(self.votes)


def _marks(name: str, attributes: str) -> tuple[tuple[str, ...], str, frozenset]:
    """The first words of the class names and, of what only groups others, of the id (behind #); the role; and the first words
    of class names, or ids of comments, of which all other words are such words or words of layout."""
    found, role, votes = set(), "", set()
    for m in NAMED.finditer(attributes):
        kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if kind == "role":
            role = role or value.strip()
            continue
        for x in value.split():
            if not (w := re.findall(r"[a-z]+", x)):
                continue
            if kind == "class":
                found.add(w[0])
            elif name in GROUPS:
                found.add(f"#{w[0]}")
            if (kind == "class" or w[0] in COMMENT_WORDS) and LAYOUT_WORDS.union(BESIDE_WORDS, HEADER_WORDS).issuperset(w[1:]):
                votes.add(w[0])
    return tuple(sorted(found)), role, frozenset(votes)


def parse(page: str) -> Node:
    """The element tree of a page. Bad markup is mended."""
    root = Node("#root")
    stack, link, at = [("#root", root)], False, 0

    def close(names: set | frozenset, stop: frozenset = frozenset()) -> None:
        nonlocal link
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                del stack[i:]
                link = False
                return
            if stack[i][0] in stop:
                return

    def text(piece: str) -> None:
        if piece:
            stack[-1][1].items.append((entities.unescape(piece) if "&" in piece else piece, link))

    while m := TOKEN.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name == "a":
                link = False
            elif name in BLOCKS or name in BESIDE:
                close({name})
        elif name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif name == "br" or name == "hr":
            stack[-1][1].items.append(None)
        elif name == "a":
            link = True
        elif name in BLOCKS or name in BESIDE:
            if name in ENDS_PARAGRAPH:
                close({"p"}, CONTAINERS)
            if name in CLOSED_BY_SAME:
                close(CLOSED_BY_SAME[name], CONTAINERS)
            node = Node(name, *_marks(name, m[3])) if "=" in m[3] else Node(name)
            link = False
            if len(stack) > DEPTH and (not node.is_beside or stack[-1][1].is_beside):  # its text stays with the ancestor
                stack[-1][1].items.append(None)
                node = stack[-1][1]
            else:
                stack[-1][1].items.append(node)
            stack.append((name, node))
    text(page[at:])
    return root


def skeleton(node: Node) -> Node:
    """The page's own wrapper."""
    out = Node(node.name, node.marks)
    for x in node.items:
        if isinstance(x, Node):
            out.items.append(skeleton(x))
        elif x is not None and not x[0].isspace():
            out.text = True
    return _narrow(out, folded(out.items))


def _narrow(node: Node, items: list[Node]) -> Node:
    """node with these children, generalised if they are too many."""
    if len(items) > WIDE and not node.free:
        node.free = True
        items = _kinds(items)
    if len(items) > WIDE:
        for x in items:
            x.marks = ()
        items = _kinds(items)
    node.items = items
    return node


def _kinds(items: list[Node]) -> list[Node]:
    """One optional and repeated node for each symbol of items, in the order of first appearance."""
    found: dict = {}
    for x in items:
        x.optional = x.repeated = True
        if x.symbol in found:
            merge(found[x.symbol], x)
        else:
            found[x.symbol] = x
    return list(found.values())


def folded(items: list[Node]) -> list[Node]:
    """Neighbouring equal groups of up to REPEATED_GROUP elements merged into one repeated group."""
    out: list[Node] = []
    for x in items:
        out.append(x)
        again = True
        while again:
            again = False
            for n in range(1, REPEATED_GROUP + 1):
                if len(out) >= 2 * n and all(y.symbol == z.symbol for y, z in zip(out[-2 * n : -n], out[-n:], strict=True)):
                    for y, z in zip(out[-2 * n : -n], out[-n:], strict=True):
                        merge(y, z)
                        y.repeated = True
                    del out[-n:]
                    again = True
                    break
    return out


def _pairs(a: list[Node], b: list[Node]) -> list[tuple[int, int]]:
    """Longest common subsequence of two lists of at most WIDE elements, by symbol."""
    x, y = [n.symbol for n in a], [n.symbol for n in b]
    if x == y:
        return [(i, i) for i in range(len(x))]
    length = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            length[i][j] = length[i + 1][j + 1] + 1 if x[i] == y[j] else max(length[i + 1][j], length[i][j + 1])
    found, i, j = [], 0, 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        elif length[i + 1][j] >= length[i][j + 1]:
            i += 1
        else:
            j += 1
    return found


def merge(a: Node, b: Node) -> Node:
    """a, generalised so that it also fits b: common elements are merged, the others become optional."""
    a.text, a.optional, a.repeated = a.text or b.text, a.optional or b.optional, a.repeated or b.repeated
    if a.free or b.free:
        a.free = True
        return _narrow(a, _kinds([*a.items, *b.items]))
    if not a.items and not b.items:
        return a
    items, i, j = [], 0, 0
    for p, q in [*_pairs(a.items, b.items), (len(a.items), len(b.items))]:
        for x in [*a.items[i:p], *b.items[j:q]]:
            x.optional = True
            items.append(x)
        if p < len(a.items):
            items.append(merge(a.items[p], b.items[q]))
        i, j = p + 1, q + 1
    return _narrow(a, folded(items) if len(items) > len(a.items) else items)


def to_json(node: Node) -> str:
    def plain(n: Node) -> list:
        return [n.name, " ".join(n.marks), n.optional + 2 * n.repeated + 4 * n.text + 8 * n.free, [plain(x) for x in n.items]]

    return json.dumps(plain(node), separators=(",", ":"))


def from_json(text: str) -> Node:
    """A wrapper with its nodes numbered in the order of the text."""
    numbers = iter(range(len(text)))

    def node(x: list) -> Node:
        n = Node(x[0], tuple(x[1].split()))
        n.number = next(numbers)
        n.optional, n.repeated, n.text, n.free = (bool(x[2] & b) for b in (1, 2, 4, 8))
        n.items = [node(y) for y in x[3]]
        return n

    return node(json.loads(text))


def as_expression(node: Node) -> str:
    """The wrapper as a regular expression over tags, with #text for slots."""
    inner = "".join(as_expression(x) for x in node.items)
    body = f"<{node.name}>{'#text' if node.text else ''}{f'({inner})*' if node.free else inner}</{node.name}>"
    return f"({body}){'*' if node.optional and node.repeated else '+' if node.repeated else '?'}" if node.optional or node.repeated else body


def aligned(children: list[Node], pattern: Node) -> list[Node | None]:
    """The pattern's child for each of a page's; a repeated group of the pattern may take many."""
    if pattern.places is None:
        pattern.places = {}
        for i, x in enumerate(pattern.items):
            pattern.places.setdefault(x.symbol, []).append(i)
    found, at = [], 0
    for x in children:
        places = pattern.places.get(x.symbol) or pattern.places.get((x.name, ()))
        if places:
            i = bisect_left(places, at)  # onwards, else back to an earlier repeated group
            at = places[i] if i < len(places) else places[-1]
        found.append(pattern.items[at] if places else None)
    return found


def page_blocks(page: str, wrapper: Node) -> tuple[bool, list[tuple]]:
    """Whether the page has an article with text, and its blocks that may be the article's, in order.

    A block is (slot, box, group, linked, heading, after, head, text): the wrapper's node that it fills (-1: none), the outermost
    container with a class beside the article (-1: none), the innermost container around it (-1: none), characters in links, whether it is a heading, the place of the
    next block that is none (-1: none), and that of the last heading up to it (-1: none).
    """
    inside: list[tuple] = []
    outside: list[tuple] = []

    def visit(node: Node, pattern: Node | None, article: bool, box: int, group: int) -> None:
        slot = -1 if pattern is None else pattern.number
        if node.name in AROUND:
            group = slot
        children = [x for x in node.items if isinstance(x, Node)]
        partners = iter(aligned(children, pattern) if pattern is not None and children else [None] * len(children))
        line: list[str] = []
        linked = 0

        def end() -> None:
            nonlocal linked
            if line:
                if text := " ".join("".join(line).split()):
                    (inside if article else outside).append((slot, box, group, min(linked, len(text)), node.name in HEADINGS, text))
                line.clear()
                linked = 0

        for x in node.items:
            if isinstance(x, Node):
                partner = next(partners)
                if x.name in INLINE:
                    continue
                end()
                if not x.is_beside and (article or x.name != "header"):
                    there = partner.number if partner is not None else -2
                    visit(x, partner, article or x.is_article, there if box == -1 and x.is_voted(article) else box, group)
            elif x is None:
                end()
            else:
                line.append(x[0])
                linked += len(x[0].strip()) * x[1]
        end()

    visit(parse(page), wrapper, False, -1, -1)
    blocks = inside or outside
    above = list(accumulate((i if b[-2] else -1 for i, b in enumerate(blocks)), max))
    after, found = -1, []
    for i in range(len(blocks) - 1, -1, -1):
        *rest, heading, text = blocks[i]
        found.append((*rest, heading, after, above[i], text))
        after = after if heading else i
    return bool(inside), found[::-1]


WRAPPERS = "host string, pages long, wrapper string"
PAGE_BLOCKS = "article boolean, blocks array<struct<slot:int,box:int,group:int,linked:int,heading:boolean,after:int,head:int,text:string>>"


def _infer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    found: dict[str, list] = {}
    for batch in batches:
        for host, page in zip(batch["host"], batch["html"], strict=True):
            own = skeleton(parse(page))
            if host in found:
                found[host][0] += 1
                merge(found[host][1], own)
            else:
                found[host] = [1, own]
            if len(found) >= 5_000:  # a partial wrapper may go out at any time
                yield _rows(found)
                found = {}
    if found:
        yield _rows(found)


def _rows(found: dict[str, list]) -> pd.DataFrame:
    return pd.DataFrame([(h, n, to_json(w)) for h, (n, w) in found.items()], columns=["host", "pages", "wrapper"])


def _fold(rows: pd.DataFrame) -> pd.DataFrame:
    whole = None
    for text in sorted(rows["wrapper"], key=lambda t: (len(t), t)):
        part = from_json(text)
        whole = part if whole is None else merge(whole, part)
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "pages": [int(rows["pages"].sum())], "wrapper": [to_json(whole)]})


def host_of(url: Column) -> Column:
    """Host of a URL column; empty for null and for what has none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """host, pages and wrapper (JSON) of pages (url, html): one row for each host.

    Null urls and urls without a host share the host '', null and empty pages have the empty wrapper, repeated rows count
    as pages, further columns are ignored, and no pages give no wrappers.
    """
    rows = pages.select(host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    parts = save(rows.mapInPandas(_infer, WRAPPERS), "wrapper-parts")
    while True:
        most = parts.groupBy("host").count().agg(F.max("count")).first()[0] or 0
        deal = F.pmod(F.xxhash64("wrapper"), F.lit(-(-most // FAN) or 1))
        before, parts = parts, save(parts.groupBy("host", deal.alias("deal")).applyInPandas(_fold, WRAPPERS), "wrappers")
        forget(before)
        if most <= FAN:
            return parts


@lru_cache(maxsize=500)
def _known(wrapper: str) -> Node:
    return from_json(wrapper)


EMPTY = '["#root","",0,[]]'


def with_blocks(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """row (the columns of pages but html), host, article and blocks of each page, as `page_blocks` gives them."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for pages_html, known in batches:
            yield pd.DataFrame([page_blocks(p, _known(w)) if p else (False, []) for p, w in zip(pages_html, known, strict=True)], columns=["article", "blocks"])

    row = F.struct(*[F.col(c) for c in pages.columns if c != "html"]).alias("row")
    rows = pages.select(row, host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    own = wrappers.select(F.col("host").alias("of"), "wrapper")
    rows = rows.join(own, F.col("host") == F.col("of"), "left")
    found = F.pandas_udf(run, PAGE_BLOCKS)("html", F.coalesce("wrapper", F.lit(EMPTY)))
    return rows.select("row", "host", found.alias("found")).select("row", "host", "found.*")


def _text(b: Column) -> Column:
    """A slot and the text in it."""
    return F.struct(b["slot"].alias("slot"), b["hash"].alias("hash"))


def _units(b: Column, blocks: str) -> Column:
    """What a block may go with: the container around it, and the heading above it with what follows, or itself."""
    unit = lambda kind, number: F.struct(F.lit(kind).alias("kind"), number.cast("long").alias("number"))
    head = F.get(blocks, b["head"])
    return F.array(unit(0, b["group"]), unit(1, F.when(b["head"] >= 0, F.xxhash64(head["slot"], head["hash"]))))


def decisions(blocks: DataFrame) -> DataFrame:
    """What each host's slots say, of blocks with `hash` for `text`: host, template (slots and hashes of texts), units (in which
    such texts go), links (slots), boxes (containers to drop).

    Pages with the same blocks count once. A template text is on most of the host's different pages, so a host has at most
    twice as many as its pages have blocks on average.
    """
    key = F.xxhash64(F.transform("blocks", lambda b: b["hash"]))
    pages = blocks.where(F.size("blocks") > 0).groupBy("host", key.alias("page")).agg(F.min("article").alias("article"), F.min("blocks").alias("blocks"))
    pages = save(pages, "html-pages")
    counted = pages.groupBy("host").agg(F.count("*").alias("pages"))
    texts = pages.select("host", F.explode(F.array_distinct(F.transform("blocks", _text))).alias("t")).where(F.col("t.slot") >= 0)
    texts = texts.groupBy("host", "t").agg(F.count("*").alias("n")).where(F.col("n") >= WITNESSES)
    texts = texts.join(counted, "host").where(F.col("n") * 2 > F.col("pages"))
    template = save(texts.groupBy("host").agg(F.collect_set("t").alias("template"), F.first("pages").alias("pages")), "html-template")
    known = pages.join(template, "host").withColumn("known", F.transform("blocks", lambda b: F.array_contains("template", _text(b))))
    met = known.select("host", "page", "pages", F.explode(F.transform("blocks", lambda b, i: F.struct(F.get("known", i).alias("same"), b["heading"].alias("heading"), _units(b, "blocks").alias("units")))).alias("b"))
    met = met.select("host", "page", "pages", "b.same", "b.heading", F.explode("b.units").alias("unit")).where(F.col("unit.number").isNotNull() & (F.col("unit.number") != -1))
    met = met.groupBy("host", "page", "unit").agg(F.min("same").alias("same"), F.min("heading").alias("bare"), F.first("pages").alias("pages"))
    met = met.where(F.col("same") & ~(F.col("bare") & (F.col("unit.kind") == 1))).groupBy("host", "unit").agg(F.count("*").alias("n"), F.first("pages").alias("pages"))
    units = met.where(F.col("n") * 2 > F.col("pages")).groupBy("host").agg(F.collect_set("unit").alias("units"))
    each = pages.select("host", "article", F.explode("blocks").alias("b")).select("host", "article", "b.*")
    links = each.where(~F.col("article") & (F.col("slot") >= 0)).groupBy("host", "slot").agg(F.sum("linked").alias("linked"), F.sum("chars").alias("chars"))
    links = links.where(F.col("linked") * 2 > F.col("chars")).groupBy("host").agg(F.collect_set("slot").alias("links"))
    boxed = each.groupBy("host", "box").agg(F.sum("chars").alias("chars"))
    whole = boxed.groupBy("host").agg(F.sum("chars").alias("all"))
    boxes = boxed.where(F.col("box") != -1).join(whole, "host").where(F.col("chars") * 2 < F.col("all")).groupBy("host").agg(F.collect_set("box").alias("boxes"))
    return save(template.drop("pages").join(units, "host", "full").join(links, "host", "full").join(boxes, "host", "full"), "html-decisions")


def main_text(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """The columns of pages (url, html, ...) but html, with `main_text`: the article's blocks in page order, joined by newlines.

    Null, empty and textless pages give an empty text; repeated rows are kept; a page whose host has no wrapper, or fewer
    than WITNESSES different pages, is judged by its elements and classes alone. Cut-off markup ends where the page ends. A
    column `main_text` of pages is replaced, all others are kept, whatever their names; no pages give no rows.
    """
    columns = [c for c in pages.columns if c not in ("html", "main_text")]
    fact = lambda b: F.struct(F.xxhash64(b["text"]).alias("hash"), F.length(b["text"]).alias("chars"), *[b[c].alias(c) for c in ("slot", "box", "group", "linked", "heading", "head")])
    blocks = save(with_blocks(pages, wrappers).withColumn("facts", F.transform("blocks", fact)), "html-blocks")
    judged = decisions(blocks.select("host", "article", F.col("facts").alias("blocks"))).withColumnRenamed("host", "of")
    rows = blocks.join(judged, F.col("host") == F.col("of"), "left")
    has = lambda c, x: F.coalesce(F.array_contains(F.col(c), x), F.lit(False))
    same = lambda b: has("template", _text(b)) & F.coalesce(F.arrays_overlap("units", _units(b, "facts")), F.lit(False))
    gone = lambda b: same(b) | has("boxes", b["box"]) | (~F.col("article") & has("links", b["slot"]))
    rows = rows.withColumn("kept", F.transform("facts", lambda b: ~gone(b)))
    stays = lambda b, i: F.get("kept", i) | (b["heading"] & (b["after"] >= 0) & F.coalesce(F.get("kept", b["after"]), F.lit(False)) & ~has("boxes", b["box"]))
    text = F.array_join(F.transform(F.filter("blocks", stays), lambda b: b["text"]), "\n")
    return rows.select(*[F.col("row")[c].alias(c) for c in columns], text.alias("main_text"))


def op4_html(spark, sf_dir: str) -> DataFrame:
    """Main text of all pages; one row for each row of pages, null and empty ones included."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    found = main_text(pages, infer_wrappers(pages))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
