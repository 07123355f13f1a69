"""HTML extraction (operator 3): wrapper induction over the pages of a host.

1. Each page is parsed into a tree of block elements; siblings with equal structure fold into one repeated node. The folded tree is the page's skeleton.
2. Per host, the distinct skeletons are aligned by simple tree matching and merged into one template tree, in a tree of tasks; a node carries the
   number of pages that have it. Every skeleton node maps to its template node.
3. Every text block is a slot value of a template node. Values are counted per host, node and digest over all pages: a value that most pages of the host share is constant and
   becomes template; the rest of the node is a varying slot.
4. Template nodes in navigation, header, footer, sidebar, notice, advert, form and comment regions hold no content: by element, or by a class, id or role all of whose
   words name a region or a place on the page ("site-header", not "share-price"). If a page has article or main nodes with at least as much text as any other element has in its own blocks, only slots under them are content. The varying slots that are left are the text.

White space in a block becomes one space, blocks are joined by one new line. A template node on fewer than `min_pages` distinct contents has no constants, as so few pages tell
template and text apart by chance only; its regions are still known.

Cases: null and empty html give an empty text; broken or cut-off markup is parsed as far as it goes; a null url is a host of its own; repeated pages count as one page
for constants (equal html, or near copies: under a quarter of own text beside the same shared values); an empty table gives an empty result; other columns are not read. Whole pages are read, to any depth: trees are flat lists of (depth, name), and no step recurses.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm.common import materialise, table

#: Fixed values of the HTML standard: block elements, raw-text elements, void elements.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
RAW = tuple("script style textarea iframe noembed noframes title".split())
#: Elements of other vocabularies: in them a slash closes a tag, and nothing is raw text.
FOREIGN = frozenset(("svg", "math"))
#: Elements left out with all they hold, if they are closed; unclosed ones are ordinary tags.
SKIPPED = frozenset("noscript template svg object select button canvas audio video".split())
#: Of these a start tag ends one still open.
_FLAT = frozenset(("button", "select"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without content.
DROPPED = frozenset("head nav footer aside form menu dialog fieldset search".split())
#: Words for regions without content.
REGION = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar aside widget widgets related recommended footer header masthead topbar toolbar comment comments commentlist reply replies respond discussion disqus notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup login share sharing social socials form search tags tagcloud copyright legal opinions".split())
#: Words that say where or in what box a region is.
PLACES = frozenset("site page main global top bottom left right upper lower primary secondary inner outer wrapper container box block section area region list item items bar row col column panel group holder slot unit zone link links side sticky fixed mobile desktop post posts article articles blog user users reader readers thread x js the body content text wrap".split())
#: In an article its heading belongs to it, and these words name its matter as well as a region.
_INNER = REGION - frozenset("header masthead legal search form alert share tags".split())
#: Names with these tell of another element's region ("with-sidebar").
_NOT = frozenset("has with without no".split())
_CONTENT = frozenset(("article", "main"))
_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z", re.S)
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGIT = re.compile(r"[0-9]")


class Node:
    __slots__ = ("children", "content", "dropped", "name", "parent", "shape", "slot", "tag")

    def __init__(self, tag: str, name: str, parent: Node | None, dropped: bool, content: bool) -> None:
        self.tag, self.name, self.parent, self.dropped, self.content, self.children, self.shape, self.slot = tag, name, parent, dropped, content, [], 0, 0


class Mark(NamedTuple):
    """A piece of markup: a tag, a raw-text element with its text (tag None, raw its name), or a comment and the like (both None)."""

    start: int
    end: int
    tag: str | None = None
    close: bool = False
    attrs: str = ""
    empty: bool = False
    raw: str | None = None


def marks_of(page: str) -> list[Mark]:
    """Markup in page order. Raw text goes on to its end tag, or the page's end (a self-closed raw tag without end tag is empty); in foreign elements there is none. A block element ends
    foreign elements left open, but for those inside foreignObject."""
    out, at, foreign = [], 0, []
    while m := _MARK.search(page, at):
        at, tag = m.end(), m["tag"]
        if tag is None:
            out.append(Mark(m.start(), at))
            continue
        tag, close, empty = tag.lower(), bool(m["close"]), m["attrs"].endswith("/")
        if tag in FOREIGN or (foreign and tag == "foreignobject"):
            if not close and not empty:
                foreign.append(tag)
            elif close and tag in foreign:
                del foreign[len(foreign) - 1 - foreign[::-1].index(tag) :]
        elif foreign and foreign[-1] in FOREIGN:
            if not close and tag in BLOCKS and tag != "title":
                foreign.clear()
        elif not close and tag in _RAW_END:
            ended = _RAW_END[tag].search(page, at)
            if ended or not empty:
                out.append(Mark(m.start(), ended.end() if ended else len(page), raw=tag))
                at = out[-1].end
                continue
        out.append(Mark(m.start(), at, tag, close, m["attrs"], empty))
    return out


def skipped(tokens: list[Mark]) -> dict[int, int]:
    """Number of the end token by number of the start token of each closed skipped element."""
    starts: dict[str, list[int]] = {}
    out = {}
    for i, m in enumerate(tokens):
        if m.tag not in SKIPPED:
            continue
        at = starts.setdefault(m.tag, [])
        if m.close:
            if at:
                out[at.pop()] = i
        elif not m.empty:
            if m.tag in _FLAT:
                at.clear()
            at.append(i)
    return out


def is_region(name: str, regions: frozenset = REGION) -> bool:
    """Whether all words of a class, id or role name a region or a place, and one a region."""
    words = {w.lower() for w in _WORDS.findall(name)}
    return not words.isdisjoint(regions) and words <= REGION | PLACES and words.isdisjoint(_NOT)


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """Block elements in page order, the root first, and the text blocks in page order with the node each stands in."""
    root = Node("", "", None, False, False)
    node, nodes, blocks, run, at = root, [root], [], [], 0
    still_open: dict[str, int] = {}

    def flush() -> None:
        if run:
            text = " ".join(entities.unescape("".join(run)).split())
            run.clear()
            if text:
                blocks.append((node, text))

    marks = marks_of(page)
    ends, last = skipped(marks), -1
    for i, m in enumerate(marks):
        if i <= last:
            continue
        if m.start > at:
            run.append(page[at : m.start])
        at = m.end
        if i in ends:
            last = ends[i]
            at = marks[last].end
            continue
        tag = m.tag
        if tag is None:
            if m.raw == "title":
                flush()
            continue
        if tag not in BLOCKS:
            if tag == "br":
                run.append(" ")
            continue
        flush()
        if m.close:
            if still_open.get(tag):
                while True:
                    closed, node = node.tag, node.parent
                    still_open[closed] -= 1
                    if closed == tag:
                        break
            continue
        if node.tag == "p" or (node.tag == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option")):
            still_open[node.tag] -= 1
            node = node.parent
        if tag in VOID:
            continue
        names = [a for x in _ATTR.finditer(m.attrs) for a in (x[2] or x[3] or x[4] or "").split()] if m.attrs else []
        content = node.content or tag in _CONTENT or "main" in (n.lower() for n in names)
        regions = _INNER if node.content else REGION
        dropped = node.dropped or tag in DROPPED or (tag == "header" and not node.content) or (tag not in ("html", "body", "article", "main") and any(is_region(n, regions) for n in names))
        child = Node(tag, ".".join([tag, *sorted(set(_stable(m.attrs)))]), node, dropped, content)
        node.children.append(child)
        nodes.append(child)
        still_open[tag] = still_open.get(tag, 0) + 1
        node = child
    if at < len(page):
        run.append(page[at:])
    flush()
    return nodes, blocks


def _stable(attrs: str | None) -> list[str]:
    """Class and role names that pages of a shape share: ids, and names with a digit, differ from page to page."""
    if not attrs:
        return []
    return [a for x in _ATTR.finditer(attrs) if x[1].lower() != "id" for a in (x[2] or x[3] or x[4] or "").lower().split() if not _DIGIT.search(a)]


class Tree:
    """Nodes in the order of the page: names, and the numbers of each node's children; 0 is the root."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        self.names, self.kids, above = [n for _, n in rows], [[] for _ in rows], []
        for i, (depth, _) in enumerate(rows):
            del above[depth:]
            if above:
                self.kids[above[-1]].append(i)
            above.append(i)

    def rows(self) -> Iterator[tuple[int, int]]:
        """Depth and number of each node, parents before children."""
        stack = [(0, 0)]
        while stack:
            depth, n = stack.pop()
            yield depth, n
            stack += [(depth + 1, k) for k in reversed(self.kids[n])]


def skeleton(nodes: list[Node]) -> list[tuple[int, str]]:
    """Depth and name of each node of the folded tree, where children of equal structure are one; writes its number in this list to each node's slot."""
    shapes: dict[tuple, int] = {}
    for node in reversed(nodes):
        node.shape = shapes.setdefault((node.name, tuple(dict.fromkeys(c.shape for c in node.children))), len(shapes))
    of = list(shapes)
    rows, at, stack = [], {}, [(nodes[0].shape, -1, 0)]
    while stack:
        shape, parent, depth = stack.pop()
        at[parent, shape] = len(rows)
        stack += [(k, len(rows), depth + 1) for k in reversed(of[shape][1])]
        rows.append((depth, of[shape][0]))
    for node in nodes:
        node.slot = at[node.parent.slot if node.parent else -1, node.shape]
    return rows


def match(a: Tree, b: Tree) -> dict[tuple[int, int], int]:
    """Simple tree matching: of each pair of nodes whose ancestors have equal names in turn, the size of the largest order-keeping matching of their trees."""
    pairs = [(0, 0)] if a.names[0] == b.names[0] else []
    for i, j in pairs:  # grows while it is read: parents come before children
        pairs += [(x, y) for x in a.kids[i] for y in b.kids[j] if a.names[x] == b.names[y]]
    size: dict[tuple[int, int], int] = {}
    for i, j in reversed(pairs):
        row = [0] * (len(b.kids[j]) + 1)
        for x in a.kids[i]:
            new = [0]
            for k, y in enumerate(b.kids[j]):
                new.append(max(new[k], row[k + 1], row[k] + size.get((x, y), 0)))
            row = new
        size[i, j] = row[-1] + 1
    return size


def align(old: list[int], new: list[int], size: dict) -> list[tuple[int | None, int | None]]:
    """Two lists of children in one order, matched ones side by side, for the largest total."""
    best = [[0] * (len(new) + 1) for _ in range(len(old) + 1)]
    for i, x in enumerate(old):
        for j, y in enumerate(new):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + size.get((x, y), 0))
    i, j, out = len(old), len(new), []
    while i or j:
        hit = size.get((old[i - 1], new[j - 1]), 0) if i and j else 0
        if hit and best[i][j] == best[i - 1][j - 1] + hit:
            i, j = i - 1, j - 1
            out.append((old[i], new[j]))
        elif j and (not i or best[i][j] == best[i][j - 1]):
            j -= 1
            out.append((None, new[j]))
        else:
            i -= 1
            out.append((old[i], None))
    return out[::-1]


class Template(Tree):
    """Merged tree of a host, with the number of pages that have each node."""

    def __init__(self) -> None:
        super().__init__([(0, "")])
        self.pages = [0]

    def merge(self, tree: Tree, weights: list[int]) -> list[int]:
        """Aligns tree with the template, adds its unmatched nodes, and returns the template's node of each of its nodes."""
        size, out, stack = match(self, tree), [0] * len(tree.names), [(0, 0)]
        while stack:
            n, y = stack.pop()
            out[y] = n
            self.pages[n] += weights[y]
            kids = []
            for x, k in align(self.kids[n], tree.kids[y], size):
                if x is None:
                    x = len(self.names)
                    self.names.append(tree.names[k])
                    self.pages.append(0)
                    self.kids.append([])
                kids.append(x)
                if k is not None:
                    stack.append((x, k))
            self.kids[n] = kids
        return out

    def text(self) -> str:
        """Depth, pages and name of each node, a line each."""
        return "\n".join(f"{d} {self.pages[n]} {self.names[n]}" for d, n in self.rows())


def tree_of(text: str) -> tuple[Tree, list[int]]:
    """Tree and pages by node of a template's text."""
    rows = [x.split(" ", 2) for x in text.split("\n")]
    return Tree([(int(d), n) for d, _, n in rows]), [int(p) for _, p, _ in rows]


def nodes_in(template: Tree, tree: Tree) -> list[tuple[int, int]]:
    """Node of tree and node of the template that it is aligned with, for those that are."""
    size, out, stack = match(template, tree), [], [(0, 0)]
    while stack:
        n, y = stack.pop()
        out.append((y, n))
        stack += [(x, k) for x, k in align(template.kids[n], tree.kids[y], size) if x is not None and k is not None]
    return out


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(errors="replace"), digest_size=8).digest(), "big", signed=True)


def content_blocks(page: str) -> tuple[str, list[tuple[int, str]]]:
    """Skeleton (as a template's text of one page), and the place in it and text of each block that no region excludes."""
    nodes, blocks = parse(page)
    rows = skeleton(nodes)
    sizes: dict[Node, int] = {}
    for n, t in blocks:
        if not n.dropped:
            sizes[n if n.content else n.parent or n] = sizes.get(n if n.content else n.parent or n, 0) + len(t)
    article = sum(size for n, size in sizes.items() if n.content)
    # a main block holds the text: not a teaser beside a longer story in another element
    inside = article > 0 and article >= max((size for n, size in sizes.items() if not n.content), default=0)
    chosen = [(n.slot, t) for n, t in blocks if not n.dropped and (n.content or not inside)]
    return "\n".join(f"{d} 1 {name}" for d, name in rows), chosen


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        skeletons, hashes, blocks, body = [], [], [], []
        for page in batch.column("html").to_pylist():
            skeleton, found = content_blocks(page or "")
            skeletons.append(skeleton)
            hashes.append(_digest(skeleton))
            body.append(xxhash.xxh3_64_intdigest((page or "").encode(errors="replace")) - (1 << 63))
            blocks.append([{"place": p, "digest": _digest(t), "size": len(t)} for p, t in found])
        kind = pa.list_(pa.struct([("place", pa.int32()), ("digest", pa.int64()), ("size", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(skeletons), pa.array(hashes, pa.int64()), pa.array(body, pa.int64()), pa.array(blocks, kind)], names=["host", "skeleton", "shape", "body", "blocks"])


def host_of(url) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def _merge_shapes(group: pa.Table) -> pa.Table:
    """One part of a host's skeletons into one template tree."""
    rows = sorted(group.to_pylist(), key=lambda r: (-r["pages"], r["shape"]))
    template = Template()
    for r in rows:
        tree, _ = tree_of(r["skeleton"])
        template.merge(tree, [r["pages"]] * len(tree.names))
    return pa.table({"host": [rows[0]["host"]], "tree": [template.text()], "part": pa.array([rows[0]["part"]], pa.int32())})


def _merge_parts(group: pa.Table) -> pa.Table:
    """Some trees of a host into one."""
    template = Template()
    rows = sorted(group.to_pylist(), key=lambda r: r["part"])
    for r in rows:
        template.merge(*tree_of(r["tree"]))
    return pa.table({"host": [rows[0]["host"]], "tree": [template.text()], "part": pa.array([rows[0]["up"]], pa.int32())})


def _map_shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Template node of each place of each skeleton that is aligned with one. A host's template is read once a run of its rows."""
    last = template = None
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if template is None or r["host"] != last:
                last, template = r["host"], tree_of(r["template"])[0]
            out += [(r["host"], r["shape"], place, node) for place, node in nodes_in(template, tree_of(r["skeleton"])[0])]
        cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], names=["host", "shape", "place", "node"])


def induce(pages: DataFrame, fan: int = 64) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Templates (host, template), nodes (host, shape, place, node) and the profile of every page (host, shape, body, blocks).

    A host's distinct skeletons are merged in a tree: some `fan` of them in a task, then some `fan` of the results, until one is left.
    """
    ready = pages.select(host_of(F.col("url")).alias("host"), F.col("html"))
    profile = materialise(ready.mapInArrow(_profile, "host string, skeleton string, shape long, body long, blocks array<struct<place:int,digest:long,size:long>>"), "profile")
    shapes = materialise(profile.groupBy("host", "shape").agg(F.first("skeleton").alias("skeleton"), F.count(F.lit(1)).alias("pages")), "shapes")
    sizes = materialise(shapes.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / fan).cast("int").alias("parts")), "shape-parts")
    parted = shapes.join(sizes, "host").withColumn("part", F.pmod(F.xxhash64("shape"), F.col("parts")).cast("int")).drop("parts")
    trees = materialise(parted.groupBy("host", "part").applyInArrow(_merge_shapes, "host string, tree string, part int"), "trees")
    left = sizes.agg(F.max("parts")).first()[0] or 0
    while left > 1:
        trees = materialise(trees.withColumn("up", F.floor(F.col("part") / fan).cast("int")).groupBy("host", "up").applyInArrow(_merge_parts, "host string, tree string, part int"), "trees")
        left = -(-left // fan)
    templates = trees.select("host", F.col("tree").alias("template"))
    nodes = shapes.join(templates, "host").select("host", "shape", "skeleton", "template").mapInArrow(_map_shapes, "host string, shape long, place int, node int")
    return templates, materialise(nodes, "nodes"), profile


def _shared(placed: DataFrame, min_pages: int, min_share: float) -> DataFrame:
    """host, node, digest of the values on min_share of the distinct votes that have the node. placed: host, node, digest, vote."""
    counted = placed.select("host", "node", "digest", "vote").distinct().groupBy("host", "node", "digest").agg(F.count(F.lit(1)).alias("n"))
    pages = placed.select("host", "node", "vote").distinct().groupBy("host", "node").agg(F.count(F.lit(1)).alias("pages"))
    return counted.join(pages, ["host", "node"]).where((F.col("pages") >= min_pages) & (F.col("n") >= min_share * F.col("pages"))).select("host", "node", "digest")


def constants(nodes: DataFrame, profile: DataFrame, min_pages: int, min_share: float, min_own: float = 0.25) -> DataFrame:
    """host, shape, place, digest of the values that are constant at their template node: on min_share of the host's distinct contents that have the node.

    Shared values are found with a vote for each distinct page. Pages whose own text, beside these, is under min_own of their text are near copies
    (of an article, with another advert or date) if they have the same shared values: such a group has one vote in the count that decides.
    """
    each = profile.select("host", "shape", "body", F.inline("blocks")).distinct()
    placed = materialise(each.join(nodes, ["host", "shape", "place"]).select("host", "body", "node", "digest", "size").distinct(), "placed")
    first = materialise(_shared(placed.withColumn("vote", F.col("body")), min_pages, min_share).withColumn("common", F.lit(True)), "shared")
    both = placed.join(first, ["host", "node", "digest"], "left")
    own = F.sum(F.when(F.col("common").isNull(), F.col("size")).otherwise(0))
    # an order-free digest of the page's shared values
    common = F.bit_xor(F.when(F.col("common"), F.xxhash64("node", "digest")))
    votes = both.groupBy("host", "body").agg(own.alias("own"), F.sum("size").alias("all"), common.alias("same"))
    votes = votes.where(F.col("own") < min_own * F.col("all")).select("host", "body", "same")
    voted = placed.join(votes, ["host", "body"], "left").withColumn("vote", F.coalesce("same", "body"))
    return _shared(voted, min_pages, min_share).join(nodes, ["host", "node"]).select("host", "shape", "place", "digest")


def extract_text(pages: DataFrame, min_pages: int = 4, min_share: float = 0.6) -> DataFrame:
    """page_id, url, text, n_chars, n_constant (blocks dropped as template) of every row of pages.

    The last step reads the pages again and looks up the constants of their skeleton, joined by host and skeleton.
    """
    _, nodes, profile = induce(pages)
    fixed = constants(nodes, profile, min_pages, min_share)

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("place", pa.int32()), ("digest", pa.int64()), ("text", pa.string())]))
        for batch in batches:
            own, blocks = [], []
            for page in batch.column("html").to_pylist():
                skeleton, found = content_blocks(page or "")
                own.append(_digest(skeleton))
                blocks.append([{"place": p, "digest": _digest(t), "text": t} for p, t in found])
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("page_id", "url", "host")] + [pa.array(own, pa.int64()), pa.array(blocks, kind)], names=["page_id", "url", "host", "shape", "blocks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes, gone = [], [], []
            for found, known in zip(batch.column("blocks").to_pylist(), batch.column("fixed").to_pylist(), strict=True):
                out = {(x["place"], x["digest"]) for x in known or ()}
                kept = [x["text"] for x in found if (x["place"], x["digest"]) not in out]
                texts.append("\n".join(kept))
                sizes.append(len(texts[-1]))
                gone.append(len(found) - len(kept))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64())], names=["page_id", "url", "text", "n_chars", "n_constant"])

    by_shape = materialise(fixed.groupBy("host", "shape").agg(F.collect_list(F.struct("place", "digest")).alias("fixed")), "shape-constants")
    ready = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"))
    parsed = ready.mapInArrow(shapes, "page_id long, url string, host string, shape long, blocks array<struct<place:int,digest:long,text:string>>")
    return parsed.join(by_shape, ["host", "shape"], "left").select("page_id", "url", "blocks", "fixed").mapInArrow(run, "page_id long, url string, text string, n_chars long, n_constant long")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
