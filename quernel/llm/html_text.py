"""Main text of web pages by site style trees (operator 9).

Pages of one host are merged into a style tree: a style node is the path of tags, classes and roles of block
elements that leads to it.  On how many of the m pages that have a node the same text stands in it, or the
same run of child styles, gives entropies, and these the node's importance: 1 where each page has its own, 0
where all pages have the same.

* content: ``1 - sum(c log c) / (sum(c) log m)`` over the node's texts, with c the pages that have a text;
* presentation: the entropy of the runs of child styles, in units of log m;
* a branch: presentation and the mean of its children, the latter damped by ``DAMPING`` to the power of the
  number of child styles.

Few pages say little, so the distance from 1 is multiplied by (m - 1) / m, and the same is computed for the
path over all hosts: templates that many small hosts use show their boilerplate there.  The smaller of the
two counts.  Importance is taken in proportion to that of the page's most important text, so pages that are
copies of each other, or a host with a single page, lose nothing by it.

Every block of text of a page gets a score in log odds, and blocks below zero are removed:

* importance of the block's node, and half of that of the branch that it stands in;
* what names say: tags, roles, and class or id words whose head is a word for boilerplate ("comment-list",
  but not "list-with-comments" or "social-history") count ``NAMED``, less where the branch holds most of the
  page's text outside links (a wrapper); such words elsewhere in a name count ``HINTED``;
* whether it stands in an article or main element, if the page has one;
* the share of links in its text.

Counts are combined before they are shuffled, so a host with most of the pages is no burden.  Importances go
to the pages in a broadcast if they were counted and are few; else each page meets the nodes that it has
itself, by (host, path), in a shuffled join.

Text: character references are decoded, white space in a block becomes one space, blocks are joined by one
space in page order.  Pages are scanned once, forwards, and elements may be nested to any depth: nothing
here recurses, or looks for the end of a tag twice.

Defined cases: null and empty html give an empty text; broken markup is read leniently, and a tag cut off by
the end is dropped; a quote that is never closed is an ordinary character; a null url is a host of its own,
of which no page tells anything about another; repeated rows give equal results; where all that a page says
is in what readers write, that is its text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape
from math import log

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.common import BROADCAST_ROWS, durable

#: Tags without an end, tags whose content isn't markup, tags inside a line of text, tags whose content isn't shown as text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())  # noqa: SIM905
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes".split())  # noqa: SIM905
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())  # noqa: SIM905
UNSEEN = frozenset("head script style noscript template iframe svg canvas select input textarea object embed audio video title noembed noframes xmp datalist link meta".split())  # noqa: SIM905
#: Of these, those that don't part the text around them.
SILENT = frozenset("script style template link meta".split())  # noqa: SIM905
#: Tags, roles and words of names that speak against a branch.
NOISE_TAGS = frozenset("nav header footer aside form dialog menu button".split())  # noqa: SIM905
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())  # noqa: SIM905
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner sponsor sponsored sponsors promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social comment comments commentlist reply replies respond disqus discussion sidebar related recommended "
    "menu nav navbar navigation breadcrumb breadcrumbs footer header masthead toolbar pagination pager widget widgets skip hidden form".split()  # noqa: SIM905
)
#: Of these, names of what readers write.
THREAD_WORDS = frozenset("comment comments commentlist reply replies respond disqus discussion".split())  # noqa: SIM905
#: Words for a place or box, which are no head of a name; words that say what a wrapper has or hasn't; headers that belong to the content.
PLACES = frozenset("area bar block box bottom col column container content group inner item items left list main outer panel row section slot top unit wrap wrapper right link links text body primary secondary".split())  # noqa: SIM905
STATES = frozenset("has with without no not".split())  # noqa: SIM905
CONTENT_WORDS, HEADERS = frozenset("post entry article story content".split()), frozenset("header masthead".split())  # noqa: SIM905
MAIN_TAGS = frozenset("article main".split())  # noqa: SIM905

DAMPING = 0.9
#: Log odds.  Importance alone reaches from -LIMIT to LIMIT; a name's head outweighs all that speaks for a block, a hint doesn't.
LIMIT = 4.0
DOUBT, NAMED, HINTED, LINKS = -1.0, -12.0, -2.0, -2.5
#: In an article (or a main element without one), elsewhere in a main element, elsewhere on a page that has one of these.
INSIDE, MAIN, ASIDE = 5.0, 1.0, -6.0
#: A named branch with this share of the page's text outside links begins to count as a wrapper, and with that one wholly does.
WRAPPER_FROM, WRAPPER_FULL = 0.5, 0.8

TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
PLAIN_TAG = re.compile(r"<([a-zA-Z][a-zA-Z0-9]*)>")
PLAIN_END = re.compile(r"</([a-zA-Z][a-zA-Z0-9]*)>")
BEFORE_NAME = re.compile(r"[\s/]*")
ATTRIBUTE_NAME = re.compile(r"[^\s/>=][^\s/>=]*|=[^\s/>=]*")
EQUALS = re.compile(r"\s*=\s*")
BARE_VALUE = re.compile(r"[^\s>]*")
WORDS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"([a-z])([A-Z])")
#: Which open elements a start tag closes, up to which ancestors.
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}


class Node:
    __slots__ = ("above", "block", "children", "content", "depth", "headed", "held", "inside", "links", "name", "own", "parent", "path", "said", "seen", "tag", "thread", "value")

    def __init__(self, tag: str, parent: Node | None, style: str = "", name: float = 0.0, seen: bool = True, thread: bool = False):
        self.tag, self.parent, self.name, self.seen, self.thread = tag, parent, name, seen, thread
        self.block = parent is None or tag not in INLINE or name < 0
        self.headed = tag in ("h1", "main")
        self.children: list[Node | str] = []
        self.depth = parent.depth + 1 if parent else 0
        #: The block that this stands in.
        self.above: Node | None = parent if parent is None or parent.block else parent.above
        #: Characters outside links in the branch; own text, its characters, and those of them in links.
        self.held, self.own, self.links = 0, [], [0, 0]
        #: The score without importance; 2 in an article (or a main element without one), 1 in a main element; importance of the own text and of the branch.
        self.said, self.inside, self.content, self.value = 0.0, 0, 1.0, 1.0
        above = self.above.path if self.above else 0
        self.path = xxhash.xxh64_intdigest(f"{tag} {style}", above) if self.block else above


def _token(token: str) -> tuple[float, bool]:
    """What one class or id says (0, HINTED or NAMED), and whether it means what readers write."""
    words = WORDS.findall(CAMEL.sub(r"\1 \2", token).lower())
    found = NOISE_WORDS.intersection(words)
    if not found or not STATES.isdisjoint(words) or (found <= HEADERS and not CONTENT_WORDS.isdisjoint(words)):
        return 0.0, False
    while len(words) > 1 and words[-1] in PLACES and words[-1] not in found:
        words.pop()
    return (NAMED, not THREAD_WORDS.isdisjoint(found)) if words[-1] in found else (HINTED, False)


def _style(tag: str, attributes: dict[str, str]) -> tuple[str, float, bool, bool]:
    """A node's style, what its names say, whether it is shown, and whether it is what readers write."""
    seen, name, thread = tag not in UNSEEN, NAMED if tag in NOISE_TAGS else 0.0, False
    if not attributes:
        return "", name, seen, thread
    text = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    role = attributes.get("role", "").lower()
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in "".join(attributes.get("style", "").split()).lower():
        seen = False
    if role in NOISE_ROLES:
        name = NAMED
    names = WORDS.findall(text.lower())
    if tag not in ("html", "body", "article", "main") and (not NOISE_WORDS.isdisjoint(names) or CAMEL.search(text)):
        for token in text.split():
            said, of_readers = _token(token)
            name, thread = min(name, said), thread or of_readers
    return f"{' '.join(sorted(set(names)))} {role}".strip(), name, seen, thread


class Open:
    """The open elements, and for each tag the depths at which it is open."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []  # depths of those that aren't inline

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(node.depth)
        if node.tag not in INLINE:
            self.blocks.append(node.depth)
        self.stack.append(node)

    def cut(self, depth: int) -> None:
        """Closes the elements from this depth on."""
        while len(self.stack) > depth:
            node = self.stack.pop()
            self.at[node.tag].pop()
            if node.tag not in INLINE:
                self.blocks.pop()

    def last(self, tag: str) -> int:
        return (self.at.get(tag) or [0])[-1]

    def first_after(self, tag: str, depth: int) -> int:
        """The outermost open element of this tag below a depth, 0 if there is none."""
        found = self.at.get(tag) or []
        k = bisect_right(found, depth)
        return found[k] if k < len(found) else 0


class Scanner:
    """Reads a page forwards.  A quote that was looked for and not found isn't looked for again."""

    def __init__(self, html: str):
        self.html, self.end = html, len(html)
        self.unclosed: set[str] = set()

    def attributes(self, at: int) -> tuple[dict[str, str], bool, int]:
        """Attributes from a place inside a tag, whether it closes itself, and the place after its end (-1 if it has none)."""
        html, found = self.html, {}
        while True:
            gap = BEFORE_NAME.match(html, at)
            at = gap.end()
            if at >= self.end:
                return found, False, -1
            if html[at] == ">":
                return found, gap[0].endswith("/"), at + 1
            name = ATTRIBUTE_NAME.match(html, at)
            at, value = name.end(), ""
            if m := EQUALS.match(html, at):
                at = m.end()
                quote = html[at : at + 1]
                close = -1
                if quote in ("'", '"') and quote not in self.unclosed:
                    close = html.find(quote, at + 1)
                    if close < 0:
                        self.unclosed.add(quote)
                if close >= 0:
                    value, at = html[at + 1 : close], close + 1
                else:
                    m = BARE_VALUE.match(html, at)
                    value, at = m[0], m.end()
            found.setdefault(name[0].lower(), value)

    def raw(self, tag: str, at: int) -> tuple[int, int]:
        """Where an element without markup inside ends, and the place after its end tag."""
        m = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(self.html, at)
        if not m:
            return self.end, self.end
        close = self.html.find(">", m.end())
        return m.start(), close + 1 if close >= 0 else self.end


def parse(html: str) -> Node:
    root = Node("", None)
    opened, scan = Open(root), Scanner(html)
    at, text_from, end = 0, 0, len(html)

    def text(to: int) -> None:
        if to > text_from:
            opened.stack[-1].children.append(unescape(html[text_from:to]))

    while True:
        lt = html.find("<", at)
        if lt < 0 or lt + 1 >= end:
            text(end if lt < 0 else lt)
            return root
        plain = PLAIN_TAG.match(html, lt)
        closing = None if plain else PLAIN_END.match(html, lt)
        sign = html[lt + 1]
        attributes: dict[str, str] = {}
        itself = False
        if plain or closing:
            tag, after = (plain or closing)[1].lower(), (plain or closing).end()
        elif sign in "!?" or (sign == "/" and not html[lt + 2 : lt + 3].isalpha()):
            text(lt)
            if html.startswith("<!--", lt):
                close = html.find("-->", lt + 4)
                text_from = at = close + 3 if close >= 0 else end
            else:
                close = html.find(">", lt + 2)
                text_from = at = close + 1 if close >= 0 else end
            continue
        elif sign.isascii() and (sign.isalpha() or sign == "/"):
            name = TAG_NAME.match(html, lt + 1 + (sign == "/"))
            if name is None:  # a letter that isn't ASCII
                at = lt + 1
                continue
            tag = name[0].lower()
            attributes, itself, after = scan.attributes(name.end())
            closing = sign == "/"
            if after < 0:
                text(lt)
                return root
        else:
            at = lt + 1
            continue
        text(lt)
        text_from = at = after
        if closing:
            if depth := opened.last(tag):
                opened.cut(depth)
            elif tag in ("p", "br"):
                opened.stack[-1].children.append(Node("br", opened.stack[-1]))
            continue
        if tag in CLOSES:
            closed, stops = CLOSES[tag]
            stop = max(map(opened.last, stops))
            depths = [d for x in closed.split() if (d := opened.first_after(x, stop))]
            if depths:
                opened.cut(min(depths))
        elif tag not in INLINE and tag not in VOID and opened.blocks and opened.stack[opened.blocks[-1]].tag == "p":
            opened.cut(opened.blocks[-1])
        now = opened.stack[-1]
        node = Node(tag, now, *_style(tag, attributes))
        now.children.append(node)
        if tag in RAW:
            node.seen = False
            _, text_from = scan.raw(tag, at)
            at = text_from
        elif tag not in VOID and not itself:
            opened.push(node)


def _squeeze(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


class Page:
    """A page's blocks in order, with the text of each and what can be said without the host's other pages."""

    def __init__(self, html: str):
        self.root = parse(html)
        #: (block or None, text): None for the border of a block.
        self.pieces: list[tuple[Node | None, str]] = []
        self.order: list[Node] = [self.root]
        todo: list[tuple[Node | str | None, Node, bool]] = [(c, self.root, False) for c in reversed(self.root.children)]
        while todo:
            c, block, link = todo.pop()
            if c is None:
                self.pieces.append((None, "\n"))
            elif isinstance(c, str):
                self.pieces.append((block, c))
                block.own.append(c)
                size = len(c.strip())
                block.held += 0 if link else size
                block.links[0] += size
                block.links[1] += size if link else 0
            elif not c.seen:
                if c.tag not in SILENT and c.tag not in INLINE:
                    self.pieces.append((None, "\n"))
            else:
                into = c if c.block else block
                if c.block:
                    self.order.append(c)
                    if c.tag not in INLINE:
                        self.pieces.append((None, "\n"))
                        todo.append((None, block, link))
                inside = link or c.tag == "a"
                todo += [(x, into, inside) for x in reversed(c.children)]

    def styles(self) -> Iterator[tuple[int, int, int]]:
        """(path, kind, signature) of the page's style nodes: kind 0 the run of child styles, 1 a text, 2 that the page has it."""
        runs: dict[int, list[int]] = {}
        for node in self.order[1:]:
            run = runs.setdefault(id(node.above), [])
            if not run or run[-1] != node.path:
                run.append(node.path)
        for node in self.order:
            path = node.path - (1 << 63)
            yield path, 2, 0
            if id(node) in runs:
                yield path, 0, _digest(repr(runs[id(node)]))
            if own := _squeeze(node.own):
                yield path, 1, _digest(own)

    def judge(self) -> None:
        """Gives every block what names, links and the article element say of it."""
        for node in reversed(self.order[1:]):
            node.above.held += node.held
            node.above.headed |= node.headed
        # What readers write is often longer than the text, so it counts only where there is nothing else.
        threads: dict[int, bool] = {id(self.root): False}
        whole = self.root.held
        for node in self.order[1:]:
            mine = node.thread and not node.headed
            threads[id(node)] = mine or threads[id(node.above)]
            whole -= node.held if mine and not threads[id(node.above)] else 0
        for node in self.order:
            if node.name == NAMED and whole and not threads[id(node)]:
                share = (node.held / whole - WRAPPER_FROM) / (WRAPPER_FULL - WRAPPER_FROM)
                node.name *= 1 - min(max(share, 0.0), 1.0)
            elif node.name == NAMED and not whole:
                node.name *= node.held < self.root.held
        mains = self._mains()
        around: set[int] = set()
        for node in mains:
            while node is not None and id(node) not in around:
                around.add(id(node))
                node = node.above
        for node in self.order[1:]:
            node.inside = max(node.inside, node.above.inside)
            name = 0.0 if id(node) in around else node.name
            if node.tag == "header" and node.inside and node.headed:
                name = 0.0  # a header with the article's own heading
            node.said = name + node.above.said
        for node in self.order:
            if mains:
                node.said += (ASIDE, MAIN, INSIDE)[node.inside]
            node.said += DOUBT + (LINKS * (node.links[1] / node.links[0]) ** 2 if node.links[0] else 0.0)

    def _mains(self) -> list[Node]:
        """Article and main elements that stand neither in an article nor in boilerplate.  Marks them."""
        mains: list[tuple[Node, Node | None]] = []
        state: dict[int, tuple[bool, bool, Node | None]] = {id(self.root): (False, False, None)}
        for node in self.order[1:]:
            noisy, inside, main = state[id(node.above)]
            noisy = noisy or node.name <= NAMED / 2
            if node.tag in MAIN_TAGS and not inside and not noisy:
                mains.append((node, main))
                inside, main = node.tag == "article", node
            state[id(node)] = (noisy, inside, main)
        parted = {id(main) for node, main in mains if main is not None and node.tag == "article"}
        for node, _ in mains:
            node.inside = 1 if id(node) in parted else 2
        return [node for node, _ in mains]

    def weigh(self, known: dict[int, tuple[float, float]]) -> None:
        """Gives every block the importance of its own text and of its branch."""
        below: dict[int, tuple[float, int, set[int]]] = {}
        for node in reversed(self.order):
            pres, node.content = known.get(node.path - (1 << 63), (1.0, 1.0))
            total, n, kinds = below.pop(id(node), (0.0, 0, set()))
            if node.links[0]:
                total, n = total + node.content, n + 1
            weight = DAMPING ** len(kinds)
            node.value = (1 - weight) * pres + weight * (total / n if n else 1.0)
            if node.above is not None and n:
                t, k, ks = below.get(id(node.above), (0.0, 0, set()))
                ks.add(node.path)
                below[id(node.above)] = (t + node.value, k + 1, ks)

    def text(self, known: dict[int, tuple[float, float]] | None = None) -> str:
        self.judge()
        self.weigh(known or {})
        texts = [n for n in self.order if n.links[0] and n.said > NAMED / 2]
        most, best = max((n.content for n in texts), default=1.0), max((n.value for n in texts), default=1.0)
        keep = set()
        for node in self.order:
            score = node.said + _odds(node.content, most)
            if node.above is not None and node.above.tag not in ("", "html", "body"):
                score += 0.5 * _odds(node.above.value, best)
            if score >= 0:
                keep.add(id(node))
        return _squeeze([t for node, t in self.pieces if node is None or id(node) in keep])


def _odds(value: float, most: float) -> float:
    """Log odds of an importance in proportion to the page's largest, within LIMIT."""
    share = min((value + 0.02) / (most + 0.02), 1.0)
    return max(-LIMIT, min(LIMIT, log(share / (1 - share)))) if share < 1 else LIMIT


def _digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def main_text(html: str, known: dict[int, tuple[float, float]] | None = None) -> str:
    """known: presentation and content importance by path; 1 where it has none."""
    return Page(html).text(known)


def host(url) -> F.Column:
    """Host of a url, in lower case and without port; null stays null."""
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _importance(counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pres, content: importances of nodes from (keys, kind, signature, c)."""
    c, of = F.col("c"), lambda kind, value: F.sum(F.when(F.col("kind") == kind, value))
    nodes = counts.groupBy(*keys).agg(of(2, c).alias("m"), of(0, c).alias("runs"), of(0, c * F.log(c)).alias("run_logs"), of(1, c).alias("texts"), of(1, c * F.log(c)).alias("text_logs"))
    few = F.col("m").cast("double") - 1
    # Of one page nothing is known; a node's distance from 1 counts by (m - 1) / m.
    part = lambda logs, n: F.when((few > 0) & (F.col(n) > 0), 1 - F.col(logs) / (F.col(n) * F.log("m")) * few / F.col("m")).otherwise(1.0)
    return nodes.select(*keys, part("run_logs", "runs").alias("pres"), part("text_logs", "texts").alias("content"))


def style_tree(df: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, path, pres, content of the style nodes that are less important than text which each page has of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, paths, kinds, signatures = [], [], [], []
            for h, html in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for path, kind, signature in set(Page(html.as_py() or "").styles()):
                    hosts.append(h), paths.append(path), kinds.append(kind), signatures.append(signature)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.int64()), pa.array(paths, pa.int64()), pa.array(kinds, pa.int32()), pa.array(signatures, pa.int64())], names=["host", "path", "kind", "signature"])

    rows = df.select(F.xxhash64(host(df[url_col])).alias("host"), df[html_col].cast("string").alias("html")).where(df[url_col].isNotNull())
    seen = rows.mapInArrow(run, "host long, path long, kind int, signature long").groupBy("host", "path", "kind", "signature").agg(F.count(F.lit(1)).alias("c"))
    seen = durable(seen)
    over_all = seen.groupBy("path", "kind", "signature").agg(F.sum("c").alias("c"))
    own = _importance(seen, ["host", "path"])
    over_all = _importance(over_all, ["path"]).select("path", F.col("pres").alias("all_pres"), F.col("content").alias("all_content"))
    both = own.join(over_all, "path").select("host", "path", F.least("pres", "all_pres").alias("pres"), F.least("content", "all_content").alias("content"))
    return both.where("pres < 0.98 or content < 0.98")


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """id_col, url_col, text, n_chars long for every row."""
    tree = durable(style_tree(df, url_col, html_col))
    rows = df.select(df[id_col].alias("id"), df[url_col].cast("string").alias("url"), df[html_col].cast("string").alias("html"), F.xxhash64(host(df[url_col])).alias("host"))
    kind = df.schema[id_col].dataType.simpleString()
    out = f"id {kind}, url string, text string, n_chars long"

    def answer(b: pa.RecordBatch, known) -> pa.RecordBatch:
        texts = [main_text(html.as_py() or "", known(k)) for k, html in enumerate(b.column(2))]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    if tree.count() <= broadcast_rows:
        by_host: dict[int, dict[int, tuple[float, float]]] = {}
        for r in tree.toArrow().to_pylist():  # counted above
            by_host.setdefault(r["host"], {})[r["path"]] = (r["pres"], r["content"])
        sent = df.sparkSession.sparkContext.broadcast(by_host)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nothing: dict = {}
            for b in batches:
                hosts = b.column(3).to_pylist()
                yield answer(b, lambda k: sent.value.get(hosts[k], nothing))  # noqa: B023

        return rows.mapInArrow(run, out).withColumnsRenamed({"id": id_col, "url": url_col})

    # Each page by its host and its bytes; a page's own nodes meet the tree, so what comes back to it is no larger than the page.
    rows = rows.withColumn("page", F.unhex(F.md5(F.coalesce("html", F.lit("")))))

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, found = [], []
            for k, html in enumerate(b.column(2)):
                mine = {path for path, _, _ in Page(html.as_py() or "").styles()}
                at += [k] * len(mine)
                found += mine
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(at, pa.int64())) for c in (0, 1)), pa.array(found, pa.int64())], names=["host", "page", "path"])

    has = rows.select("host", "page", "html").mapInArrow(paths, "host long, page binary, path long").distinct()
    lists = has.join(tree, ["host", "path"]).groupBy("host", "page").agg(F.collect_list(F.struct("path", "pres", "content")).alias("known"))
    lists = durable(lists).withColumnsRenamed({"host": "its_host", "page": "its_page"})
    pages = rows.join(lists, (rows["host"] == lists["its_host"]) & (rows["page"] == lists["its_page"]), "left").select("id", "url", "html", "known")

    def run_listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield answer(b, lambda k: {x["path"]: (x["pres"], x["content"]) for x in b.column(3)[k].as_py() or []})  # noqa: B023

    return pages.mapInArrow(run_listed, out).withColumnsRenamed({"id": id_col, "url": url_col})


__all__ = ["Page", "extract", "host", "main_text", "parse", "style_tree"]
