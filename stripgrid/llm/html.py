"""Main text of web pages by wrapper induction on pages of the same host."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stripgrid.functions.lineage import cut_lineage

SAMPLE_PAGES = 8
SENT_ROWS, SENT_BYTES = 100_000, 16 * 2**20
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
HIDDEN = set(
    "script style noscript template head title nav footer aside form button select option input textarea iframe object "
    "svg math canvas audio video dialog menu".split()
)
CONTAINERS = set("html body div section center table tbody tr td main article".split())
ENDS_PARAGRAPH = set(
    "address article aside blockquote center details dialog dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr li main menu nav ol p pre section table ul".split()
)
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# Words in class names and ids that name parts around an article, and roles of such parts.
AROUND = set(
    "nav navbar navigation menu sidebar footer header masthead ad ads advert adverts advertisement sponsor sponsored promo banner "
    "cookie cookies consent gdpr notice notices comment comments respond disqus share sharing social related breadcrumb breadcrumbs "
    "popup modal overlay newsletter subscribe login signup widget toolbar pagination pager".split()
)
ROLES = set("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
NAMES = re.compile(r"[^a-z0-9]+")
WHITE_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "key", "around", "children")

    def __init__(self, tag: str, attributes: dict[str, str]):
        names = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower()
        self.tag = tag
        self.key = f"{tag} {' '.join(sorted(set(attributes.get('class', '').split())))}".strip()
        self.children: list[Node | str] = []
        named = tag not in ("html", "body", "article", "main") and not AROUND.isdisjoint(NAMES.split(names))
        self.around = (
            tag in HIDDEN
            or named
            or attributes.get("role", "").lower() in ROLES
            or "hidden" in attributes
            or attributes.get("aria-hidden") == "true"
        )


class TreeParser(HTMLParser):
    """A tolerant tree: paragraphs, list items and cells end where the next begins, stray end tags are passed over."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.stack = [self.root]

    def _close(self, tags: set[str], barrier: set[str]) -> None:
        for at in range(len(self.stack) - 1, 0, -1):
            if self.stack[at].tag in tags:
                del self.stack[at:]
                return
            if self.stack[at].tag in barrier:
                return

    def handle_starttag(self, tag: str, attributes: list) -> None:
        if tag == "html":
            return
        if tag in ENDS_PARAGRAPH:
            self._close({"p"}, ENDS_PARAGRAPH - {"p"} | {"td", "th", "body"})
        if tag in SELF_CLOSING:
            self._close(SELF_CLOSING[tag], {"ul", "ol", "dl", "table", "select", "menu"})
        if tag == "body":
            self._close({"head"}, set())
        node = Node(tag, {k: v or "" for k, v in attributes})
        self.stack[-1].children.append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag: str, attributes: list) -> None:
        self.handle_starttag(tag, attributes)
        if tag not in VOID and self.stack[-1].tag == tag:
            self.stack.pop()

    def handle_endtag(self, tag: str) -> None:
        barrier = ENDS_PARAGRAPH | CONTAINERS if tag in INLINE or tag == "p" else {"body"} if tag not in ("body", "html") else set()
        self._close({tag}, barrier - {tag})

    def handle_data(self, data: str) -> None:
        self.stack[-1].children.append(data)


def parse(html: str | None) -> Node:
    parser = TreeParser()
    parser.feed(html or "")
    parser.close()
    return parser.root


def blocks(node: Node, inside: bool = False) -> list[str]:
    """Texts of the blocks below a node in page order; parts that surround articles are left out."""
    out, run = [], []

    def end() -> None:
        text = WHITE_SPACE.sub(" ", "".join(run)).strip()
        run.clear()
        if text:
            out.append(text)

    stack: list = [(iter(node.children), False)]
    depth = [inside or node.tag in ("article", "main")]
    while stack:
        item = next(stack[-1][0], None)
        if item is None:
            if stack.pop()[1]:
                end()
            depth.pop()
        elif isinstance(item, str):
            run.append(item)
        elif item.tag == "br":
            run.append("\n")
        elif item.around or item.tag == "header" and not depth[-1]:
            if item.tag not in ("script", "style", "template"):
                end()
        else:
            block = item.tag not in INLINE and item.tag not in VOID
            if block or item.tag == "hr":
                end()
            stack.append((iter(item.children), block))
            depth.append(depth[-1] or item.tag in ("article", "main"))
    end()
    return out


class Slot:
    """A node of a wrapper: neighbours with one key are one slot (a list), with the blocks of all of them."""

    __slots__ = ("key", "tag", "nodes", "children", "texts")

    def __init__(self, key: str, tag: str, nodes: list[Node]):
        self.key, self.tag, self.nodes = key, tag, nodes
        self.children: list[Slot] = []
        self.texts: list[str] = []

    def grow(self) -> Slot:
        """Build the slots below, each one once, without recursion: pages nest as deep as they like."""
        waiting = [self]
        while waiting:
            slot = waiting.pop()
            if slot.tag not in CONTAINERS:
                continue
            for node in slot.nodes:
                for child in node.children:
                    if isinstance(child, str) or child.around or child.tag == "header" and slot.tag not in ("article", "main"):
                        continue
                    if slot.children and slot.children[-1].key == child.key:
                        slot.children[-1].nodes.append(child)
                    else:
                        slot.children.append(Slot(child.key, child.tag, [child]))
            waiting += slot.children
        return self

    def only_child(self) -> Slot | None:
        """The one container that holds everything in this slot, if there is one."""
        if len(self.nodes) != 1 or len(self.children) != 1 or self.children[0].tag not in CONTAINERS:
            return None
        child = self.children[0]
        plain = all(x in child.nodes if isinstance(x, Node) else not x.strip() for x in self.nodes[0].children)
        return child if plain else None

    @property
    def size(self) -> int:
        return sum(len(x) for node in self.nodes for x in blocks(node))


def match(a: Slot, b: Slot) -> tuple[int, list[tuple[Slot, Slot]]]:
    """Simple tree matching: the largest order-preserving mapping of two trees whose roots have one key.

    The recursion of the algorithm runs on a list of suspended steps, so that deep pages don't exhaust Python's stack.
    """
    steps, answer = [_match_step(a, b)], None
    while steps:
        try:
            wanted = steps[-1].send(answer)
            steps.append(_match_step(*wanted))
            answer = None
        except StopIteration as done:
            steps.pop()
            answer = done.value
    return answer


def _match_step(a: Slot, b: Slot):
    """One pair of nodes; yields pairs of children and is sent their results."""
    if a.key != b.key:
        return 0, []
    m, n = len(a.children), len(b.children)
    best = [[0] * (n + 1) for _ in range(m + 1)]
    pairs: dict[tuple[int, int], tuple[int, list]] = {}
    for i in range(m):
        for j in range(n):
            here = 0
            if a.children[i].key == b.children[j].key:
                pairs[i, j] = yield a.children[i], b.children[j]
                here = pairs[i, j][0]
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + here)
    mapped, i, j = [(a, b)], m, n
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            mapped += pairs[i, j][1]
    return best[m][n] + 1, mapped


def tree(html: str | None) -> Slot:
    return Slot("html", "html", [parse(html)]).grow()


def descend(slot: Slot, weight) -> Slot:
    """The deepest container that still holds most of the varying text; an article or main part ends the way."""
    while slot.tag not in ("article", "main"):
        if (child := slot.only_child()) is not None:
            slot = child
            continue
        whole = weight(slot)
        inner = [x for x in slot.children if x.tag in CONTAINERS and weight(x) > 0.6 * whole]
        if not whole or not inner:
            break
        slot = inner[0]
    return slot


def induce(pages: list[str | None]) -> str:
    """The wrapper of a host as JSON: the template tree, its content slot, and constant blocks inside that slot.

    The trees of the sampled pages are aligned with the first by simple tree matching. Blocks that all pages have in
    a matched slot are constant. The content slot is where most of the varying text lies. Constant blocks of the content slot are template
    only if at least four different pages show them and they are a small part (under 30 %) of each page's content; else pages that
    copy each other would lose their text.
    """
    trees = [tree(x) for x in dict.fromkeys(pages)]
    first = trees[0]
    matched: dict[int, list[Slot]] = {}
    for other in trees[1:]:
        for a, b in match(first, other)[1]:
            matched.setdefault(id(a), []).append(b)

    def texts(slot: Slot) -> list[str]:
        return [x for node in slot.nodes for x in blocks(node)]

    def constant(slot: Slot) -> set[str]:
        others = matched.get(id(slot), [])
        return set(texts(slot)).intersection(*[set(texts(x)) for x in others]) if others else set()

    def varying(slot: Slot) -> int:
        fixed = constant(slot)
        rest = sum(len(x) for x in texts(slot) if x not in fixed)
        return rest + sum(len(x) for other in matched.get(id(slot), []) for x in texts(other) if x not in fixed)

    content = descend(first, varying if len(trees) > 1 else lambda x: sum(map(len, texts(x))))
    fixed = constant(content)
    shown = [content, *matched.get(id(content), [])]
    small = all(sum(len(x) for x in texts(s) if x in fixed) < 0.3 * sum(map(len, texts(s))) for s in shown)
    if len(trees) < 4 or len(shown) < len(trees) or not small:
        fixed = set()

    # A flat list (key, tag, place of the parent): parents come before their children, however deep the page is.
    slots, parents = [first], [-1]
    for at, slot in enumerate(slots):
        slots += slot.children
        parents += [at] * len(slot.children)
    nodes = [(slot.key, slot.tag, parent) for slot, parent in zip(slots, parents)]
    at = next(i for i, slot in enumerate(slots) if slot is content)
    return json.dumps({"nodes": nodes, "content": at, "fixed": sorted(fixed)})


class Wrapper:
    def __init__(self, spec: str):
        loaded = json.loads(spec)
        self.fixed = set(loaded["fixed"])
        slots: list[Slot] = []
        for key, tag, parent in loaded["nodes"]:
            slots.append(Slot(key, tag, []))
            if parent >= 0:
                slots[parent].children.append(slots[-1])
        self.tree, self.content = slots[0], slots[loaded["content"]]

    def extract(self, html: str | None) -> list[str]:
        """Blocks of a page's content slot; a page that the wrapper does not fit is searched for its own largest part."""
        page = tree(html)
        found = next((b for a, b in match(self.tree, page)[1] if a is self.content), None)
        if found is None or not any(blocks(x) for x in found.nodes):
            found = descend(page, lambda x: x.size)
        inside = found.tag in ("article", "main")
        return [x for node in found.nodes for x in blocks(node, inside) if x not in self.fixed]


def main_text(frame: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """A row per page: key, url, ``host``, ``blocks`` and ``text`` (the blocks joined by one space).

    For each host a wrapper is induced from up to ``SAMPLE_PAGES`` pages, drawn by a hash of key and url, one from each of as
    many hash classes; so learning reads a bounded sample per host and no host's pages meet in one task. Every page is
    then matched with its host's wrapper, whole. Menus, headers, footers, sidebars, notices, adverts, forms, comments
    and scripts are recognised by their elements, roles and names and never count as content.

    Null and empty pages give an empty text. Pages without url or host share one wrapper. Repeated rows agree. Other columns
    are not read; an empty table gives an empty result.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    pages = frame.select(F.col(key).alias("key"), F.col(url).alias("url"), host.alias("host"), F.col(html).alias("html"))
    pages = pages.withColumn("draw", F.xxhash64("key", F.lit("|"), "url"))
    drawn = pages.groupBy("host", F.pmod("draw", F.lit(SAMPLE_PAGES)).alias("class")).agg(F.min("draw").alias("draw"))
    drawn = cut_lineage(drawn.select("host", "draw"))
    if drawn.count() <= SENT_ROWS:  # else both sides are shuffled
        drawn = F.broadcast(drawn)
    sample = pages.join(drawn, ["host", "draw"]).groupBy("host", "draw").agg(F.min("html").alias("html"))

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        pages = [x or "" for x in group.sort_values("draw")["html"]]
        return pd.DataFrame({"of": [group["host"].iloc[0]], "wrapper": [induce(pages)]})

    wrappers = cut_lineage(sample.groupBy("host").applyInPandas(learn, "of string, wrapper string"))
    if (wrappers.agg(F.sum(F.octet_length("wrapper") + F.octet_length("of"))).first()[0] or 0) <= SENT_BYTES:
        wrappers = F.broadcast(wrappers)
    schema = T.StructType(
        [
            T.StructField("key", frame.schema[key].dataType),
            T.StructField("url", T.StringType()),
            T.StructField("host", T.StringType()),
            T.StructField("blocks", T.ArrayType(T.StringType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Wrapper] = {}
        for batch in batches:
            out = []
            for html, spec in zip(batch.column(3), batch.column(4)):
                spec = spec.as_py()
                if spec not in known:
                    if len(known) >= 256:
                        known.clear()
                    known[spec] = Wrapper(spec)
                out.append(known[spec].extract(html.as_py()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.list_(pa.string()))], names=schema.names)

    joined = pages.join(wrappers, F.col("host") == F.col("of")).select("key", "url", "host", "html", "wrapper")
    found = joined.mapInArrow(run, schema)
    return found.select(F.col("key").alias(key), F.col("url").alias(url), "host", "blocks", F.array_join("blocks", " ").alias("text"))
