"""Main text of web pages by wrapper induction: texts are counted by their place over all pages of a host."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import materialise

OWN_WORDS, TOP, ANY = 5, 0, 0
# Fixed names of HTML.
CONTAINERS = frozenset("html body div section article main header center".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul br".split())
CLOSES_P = BLOCKS - frozenset("body html td th tr tbody thead tfoot option optgroup title legend br".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody")}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",), "tfoot": ("table",), "option": ("select", "datalist")}
DROPPED = frozenset("head script style noscript template nav footer aside form button select textarea input iframe frame object embed svg canvas audio video map dialog menu search title".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
NAMES = re.compile(r"(?:^|[\s_-])(?:ads?|adv|advert\w*|sponsor\w*|promo\w*|banner|sidebar|side-?bar|aside|menu|nav|navbar|navigation|topbar|footer|masthead|site-?header|page-?header|breadcrumbs?|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|subscribe|subscription|newsletter|signup|login|comments?|replies|reply|disqus|discussion|respond|shar(?:e|ing)|social|related|recommend\w*|widget|pagination|pager|toolbar|skip-?link|copyright)(?:$|[\s_-])", re.I)
HEADER = re.compile(r"(?:^|[\s_-])header(?:$|[\s_-])", re.I)
# Parts of class names that say nothing about what a node holds.
NEUTRAL = re.compile(r"(?:\d+|[a-z]|box|block|wrap|wrapper|container|inner|outer|section|bar|list|item|items|area|unit|slot|form|top|bottom|left|right|main|site|page|post|article|content|side|user|reader|links?|buttons?|tools?|media|stories|posts|articles|end|head|title|module|component|in|up|now|us|by|js)", re.I)


class Node:
    __slots__ = ("children", "dropped", "key", "tag", "text")

    def __init__(self, tag: str, dropped: bool = False, text: str = ""):
        self.tag, self.dropped, self.text = tag, dropped, text
        self.children: list[Node] = []
        self.key = ""


class Tree(HTMLParser):
    """A forgiving reader: implied ends of paragraphs, list items and cells; unknown ends are ignored."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]
        self.count: Counter[str] = Counter()  # open nodes of each tag

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in CLOSES_P:
            self._close(("p",), ("button", "td", "th", "article", "section", "div", "li", "blockquote"))
        if tag in CLOSES:
            self._close(CLOSES[tag], SCOPES[tag])
        node = Node(tag, self._boilerplate(tag, dict(attrs)))
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.count[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag and tag in ("svg", "path", "g", "circle", "rect"):
            self._cut(len(self.open) - 1)

    def _cut(self, i: int) -> None:
        for node in self.open[i:]:
            self.count[node.tag] -= 1
        del self.open[i:]

    def handle_endtag(self, tag: str) -> None:
        if not self.count[tag]:
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                self._cut(i)
                return

    def handle_data(self, data: str) -> None:
        data = data.replace("\0", "")  # as browsers do in text
        if not data:
            return
        top = self.open[-1]
        if top.children and top.children[-1].tag == "#text":
            top.children[-1].text += data
        else:
            top.children.append(Node("#text", text=data))

    def _close(self, tags: tuple[str, ...], stops: tuple[str, ...]) -> None:
        if not any(self.count[t] for t in tags):
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                self._cut(i)
                return
            if self.open[i].tag in stops:
                return

    def _boilerplate(self, tag: str, attrs: dict[str, str | None]) -> bool:
        inside = self.count["article"] + self.count["main"] > 0
        if tag in DROPPED or tag == "header" and not inside:
            return True
        if "hidden" in attrs or attrs.get("aria-hidden") == "true" or (attrs.get("role") or "").lower() in ROLES:
            return True
        if tag in ("html", "body", "main") or tag == "article" and not inside and not re.search("comment|related|promo|teaser", attrs.get("class") or ""):
            return False
        names = f"{attrs.get('class') or ''} {attrs.get('id') or ''}"
        if inside:  # "copyright-law" and "related-work" can be what an article is about
            return any(NAMES.search(name) and all(NAMES.search(part) or NEUTRAL.fullmatch(part) for part in re.split("[_-]+", name) if part) for name in names.split())
        return bool(NAMES.search(names) or HEADER.search(names))


def parse(html: str) -> Node:
    tree = Tree()
    tree.feed(html)
    tree.close()
    for node in walk(tree.root):
        if node.tag == "#text":
            node.key = digest(node.text) if node.text.strip() else ""
    return tree.root


def digest(text: str) -> str:
    return hashlib.blake2b(" ".join(text.split()).encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def walk(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        x = stack.pop()
        yield x
        stack.extend(reversed(x.children))


def solid(node: Node) -> list[Node]:
    """The children that matching looks at: no blank texts, nothing that its tag already drops."""
    return [x for x in node.children if not x.dropped and (x.tag != "#text" or x.key)]


@lru_cache(1 << 16)
def number(*parts: str | int) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def slots(root: Node) -> Iterator[tuple[Node, int, int]]:
    """Text nodes with their slot (the tags above and the text) and box (the tags above down to the last container)."""
    stack = [(root, TOP, TOP)]
    while stack:
        node, path, box = stack.pop()
        for x in solid(node):
            if x.tag == "#text":
                yield x, number(path, x.key), box
            else:
                below = number(path, x.tag)
                stack.append((x, below, below if x.tag in CONTAINERS else box))


def skeleton(boxes: set[int]) -> int:
    """The structural key of a page: which containers hold its texts."""
    return number("skeleton", *sorted(boxes))


def page_slots(html: str) -> tuple[int, int, list[tuple[int, int]]]:
    """Content, structural key and distinct (slot, box) of a page.

    Pages of equal content are copies: they differ at most in digits and in texts of fewer than OWN_WORDS words (dates, counters).
    """
    found = list(slots(parse(html)))
    known = sorted({(slot, box) for _, slot, box in found})
    texts = {re.sub(r"\d+", "0", " ".join(x.text.split())) for x, _, _ in found}
    own = {x for x in texts if x.count(" ") >= OWN_WORDS - 1} or texts
    content = hashlib.blake2b("\n".join(sorted(own)).encode("utf-8", "surrogatepass"), digest_size=8).digest()
    return int.from_bytes(content, "big", signed=True), skeleton({box for _, box in known}), known


def whole_blocks(root: Node, constant: set[int]) -> set[int]:
    """The constant texts whose block has no other text: a constant phrase in a varying paragraph is content."""
    blocks: dict[int, list[int]] = {}
    stack = [(root, id(root))]
    while stack:
        node, block = stack.pop()
        for x in solid(node):
            if x.tag == "#text":
                blocks.setdefault(block, []).append(id(x))
            else:
                stack.append((x, id(x) if x.tag in BLOCKS else block))
    return {x for texts in blocks.values() if all(x in constant for x in texts) for x in texts}


def extract(html: str, wrapper: frozenset[tuple[int, int]]) -> str:
    """The main text of a page: what neither its tags nor the wrapper of its host, pairs of structural key or ANY and slot, mark as template."""
    root = parse(html)
    template: set[int] = set()
    if wrapper:
        found = list(slots(root))
        kind = skeleton({box for _, _, box in found})
        template = whole_blocks(root, {id(x) for x, slot, _ in found if (ANY, slot) in wrapper or (kind, slot) in wrapper})
    mains = topmost(root, "article") or topmost(root, "main")
    out: list[str] = []

    # characters, characters in links and links below each node that isn't dropped
    facts: dict[int, list[int]] = {}
    order: list[tuple[Node, Node | None]] = []
    walked: list[tuple[Node, Node | None, bool]] = [(root, None, False)]
    while walked and not mains:
        x, above, linked = walked.pop()
        n = len(x.text.strip()) if x.tag == "#text" else 0
        facts[id(x)] = [n, n * linked, int(x.tag == "a")]
        order.append((x, above))
        walked.extend((y, x, linked or x.tag == "a") for y in x.children if not y.dropped)
    for x, above in reversed(order):
        if above is not None:
            facts[id(above)] = [p + q for p, q in zip(facts[id(above)], facts[id(x)], strict=True)]

    def listed(node: Node) -> bool:
        """A list of links rather than prose, by most of its characters; one link alone is none."""
        total, inside, anchors = facts[id(node)]
        return anchors > 1 and inside > 0.6 * total

    stack: list[Node | str] = list(reversed(mains or [root]))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag == "#text":
            if id(x) not in template:
                out.append(x.text)
        elif not x.dropped:
            block = x.tag in BLOCKS
            if block:
                out.append("\n")
                stack.append("\n")
            if mains or x.tag not in ("ul", "ol", "div", "section", "table", "p") or not listed(x):
                stack.extend(reversed(x.children))
    return " ".join("".join(out).split())


def topmost(root: Node, tag: str) -> list[Node]:
    """Nodes of the tag that are in no other one, nor in what is dropped, in page order."""
    found, stack = [], [root]
    while stack:
        x = stack.pop()
        if x.tag == tag:
            found.append(x)
        else:
            stack.extend(y for y in reversed(x.children) if not y.dropped)
    return found


def host(url: Column) -> Column:
    """Host name in lower case without www, user and port; empty if there is none."""
    return F.coalesce(F.regexp_replace(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), r"^www\.", ""), F.lit(""))


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper: the texts that stay constant over the unlike pages (host, html) of a host.

    All pages are read whole and counted; copies count once. A text is constant if it stands in one slot in two thirds of the
    host's pages that have its box, or in two thirds of those with one structural key, and in three pages or in both of only two.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [page_slots(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([np.array(x[2], "<i8").tobytes() for x in found], pa.binary())], ["host", "content", "kind", "slots"])

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, kind, packed in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                known = np.frombuffer(packed, "<i8").reshape(-1, 2).tolist()
                rows += [(host, ANY, box, slot) for slot, box in known] + [(host, kind, 0, slot) for slot, _ in known]
                # the pages themselves have no slot: of the host, of each box, of the structural key
                rows += [(host, ANY, box, None) for box in {TOP, *(box for _, box in known)}] + [(host, kind, 0, None)]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), *[pa.int64()] * 3), strict=True)], ["host", "kind", "box", "slot"])

    unlike = pages.mapInArrow(read, "host string, content long, kind long, slots binary").groupBy("host", "content").agg(F.min(F.struct("kind", "slots")).alias("page"))
    rows = unlike.select("host", "page.kind", "page.slots").mapInArrow(level, "host string, kind long, box long, slot long")
    counts = materialise(rows.groupBy("host", "kind", "box", "slot").agg(F.count("*").alias("n")).where("n > 1 or slot is null"), "slots")
    whole = counts.where("slot is null").select("host", "kind", "box", F.col("n").alias("pages"))
    two = whole.where(f"kind = {ANY} and box = {TOP} and pages = 2").select("host", F.lit(True).alias("two"))
    constant = counts.where("slot is not null").join(whole, ["host", "kind", "box"]).where("3 * n >= 2 * pages").join(two, "host", "left").where("n > 2 or two")
    return constant.groupBy("host").agg(F.collect_set(F.struct("kind", "slot")).alias("wrapper"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html).

    The wrapper of a host comes from all its pages and is applied to every one of them. Without a host, or with no two unlike pages,
    tags and names alone decide. Null or empty html gives an empty text. Repeated rows give repeated rows.
    """
    keyed = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host(F.col("url")).alias("host"))
    # written, so that its size is known: small ones are broadcast, and of a large one the join splits hot hosts
    learned = materialise(wrappers(keyed.where("host <> '' and html <> ''").select("host", "html")), "wrappers")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[str, frozenset[tuple[int, int]]] = {}
            texts = []
            for i in range(batch.num_rows):
                name = batch.column(4)[i].as_py()
                if name not in known:
                    known[name] = frozenset((x["kind"], x["slot"]) for x in batch.column(3)[i].as_py() or [])
                texts.append(extract(batch.column(2)[i].as_py(), known[name]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    joined = keyed.join(learned, "host", "left").select("page_id", "url", "html", "wrapper", "host")
    return joined.mapInArrow(apply, "page_id long, url string, text string, n_chars long")
