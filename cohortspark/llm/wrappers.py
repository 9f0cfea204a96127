"""Operator 11, main text of web pages by wrappers induced from pages of one host.

Every page is read into a tree of its block elements, folded so that equal siblings
are one node: the skeleton. The distinct skeletons of a host are aligned by simple
tree matching and merged into the host's wrapper; each node of a page
thereby gets a slot. A text that fills a slot on nearly all differing pages of the
host is template, what varies is content. Regions that name themselves as
menu, footer, advert, form, comment and the like are no content wherever they vary.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.registry import register
from cohortspark.llm.tables import settled, table
from cohortspark.operators.skew import SkewPolicy, attach

POLICY = SkewPolicy(task_rows=20_000, broadcast_rows=20_000)
FAN = 500                 # trees that one task merges
DEEPEST = 64              # levels of a skeleton; deeper elements belong to the last one
# A slot's text is template when this share of the host's pages has it, counted by
# distinct titles so that copies of a page are one, with so many titles at least.
INSIDE = (0.9, 5)         # in an element that declares itself the article
OUTSIDE = (0.5, 3)
LINKED = 0.5              # share of link characters from which a slot outside an article is a menu

BLOCKS = frozenset("""html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot
tr td th caption blockquote pre figure figcaption header footer nav aside form fieldset address details summary center
head title menu dialog hgroup search""".split())
DROPPED = frozenset("""script style noscript template button select textarea svg iframe object video audio canvas math
head nav footer aside form menu dialog search""".split())
RAW = {t: re.compile(f"</{t}(?=[\\s/>])", re.I) for t in ("script", "style", "textarea", "title", "iframe", "noscript")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {                # an opening tag ends an open element of these before it
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
LISTS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr")}
ASIDE = frozenset("""ad ads adv advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation
menu breadcrumb breadcrumbs pagination pager sidebar footer cookie cookies consent gdpr notice alert comment comments
disqus respond related recommended share sharing social newsletter subscribe subscription popup modal overlay login
signup search widget toolbar contentinfo complementary""".split())
OPEN_TEXT = ("article", "main")

TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*+>?|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>?"""
    r"""|(?P<text>[^<]++|<)""", re.S)
ATTR = re.compile(r"""(?:^|[\s"'])(class|id|role|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/"'>]|$)""", re.I)
SPACE = re.compile(r"[\x20\x09-\x0D\xA0]+")
NAME = re.compile(r"[a-z]+")


class Page:
    """Blocks of one page and the tree of their elements.

    ``labels``, ``parents``: the elements. ``blocks``: (element, text, link characters, inside an
    article) in page order, without the regions that are no content.
    """

    def __init__(self, source: str):
        self.labels, self.parents = ["#"], [-1]
        self.blocks: list[tuple[int, str, int, bool]] = []
        self.title = ""
        self._stack = [(0, "#", False, False)]       # element, tag, no content, inside an article
        self._parts: list[str] = []
        self._link, self._linked = False, 0
        self._read(source)

    def _read(self, source: str) -> None:
        at = 0
        while found := TOKEN.match(source, at):
            at = found.end()
            if found["text"] is not None:
                self._text(found["text"])
            elif tag := (found["tag"] or "").lower():
                if found["close"]:
                    self._close(tag)
                    continue
                self._open(tag, found["attrs"])
                if tag in RAW:
                    end = RAW[tag].search(source, at)
                    stop = end.start() if end else len(source)
                    if tag == "title" and not self.title:
                        self.title = clean(source[at:stop])
                    at = stop
        self._flush()

    def _text(self, text: str) -> None:
        if not self._stack[-1][2]:
            self._parts.append(text)
            if self._link:
                self._linked += len(text.strip())

    def _flush(self) -> None:
        if self._parts:
            text = clean("".join(self._parts))
            if text:
                element, _, _, inside = self._stack[-1]
                self.blocks.append((element, text, min(self._linked, len(text)), inside))
            self._parts.clear()
        self._linked = 0

    def _open(self, tag: str, attrs: str) -> None:
        if tag == "br":
            self._text(" ")
        elif tag == "a":
            self._link = True
        if tag == "hr":
            self._flush()
        if tag in VOID or tag not in BLOCKS and tag not in DROPPED:
            return
        if tag in BLOCKS:
            self._flush()
            self._imply(tag)
        element, _, outer, inside = self._stack[-1]
        names = marks(attrs)
        gone = outer or tag in DROPPED or no_content(tag, names, inside)
        if len(self._stack) <= DEEPEST and tag in BLOCKS:
            self.labels.append(tag + "".join("." + n for n in names))
            self.parents.append(element)
            element = len(self.labels) - 1
        self._stack.append((element, tag, gone, inside or tag in OPEN_TEXT and not gone))

    def _imply(self, tag: str) -> None:
        """End the elements that an opening block ends without a closing tag."""
        if self._stack[-1][1] == "p":
            self._stack.pop()
        for depth in range(len(self._stack) - 1, 0, -1):
            name = self._stack[depth][1]
            if name in LISTS.get(tag, ()) or tag not in CLOSES:
                return
            if name in CLOSES[tag]:
                del self._stack[depth:]
                return

    def _close(self, tag: str) -> None:
        if tag == "a":
            self._link = False
        elif tag in BLOCKS or tag in DROPPED:
            depth = next((d for d in range(len(self._stack) - 1, 0, -1) if self._stack[d][1] == tag), 0)
            if tag in BLOCKS:
                self._flush()
                self._link = False
            if depth:
                del self._stack[depth:]

    def folded(self) -> tuple[str, list[int]]:
        """The skeleton as text, and for each element its node: equal siblings are one node."""
        n = len(self.labels)
        children: list[list[int]] = [[] for _ in range(n)]
        for i in range(n - 1, 0, -1):
            children[self.parents[i]].append(i)
        shape = [""] * n
        for i in range(n - 1, -1, -1):           # children have greater numbers
            mine = dict.fromkeys(shape[c] for c in reversed(children[i]))
            shape[i] = self.labels[i] + ("(" + " ".join(mine) + ")" if mine else "")
        node, first, made = [0] * n, {}, 1
        sizes = {s: s.count(" ") + s.count("(") + 1 for s in set(shape)}
        place = {}                               # (node of the parent, shape) to node
        for i in range(1, n):
            up = node[self.parents[i]]
            key = (up, shape[i])
            if key not in place:
                place[key] = first.get(up, up + 1)
                first[up] = place[key] + sizes[shape[i]]
            node[i] = place[key]
        return shape[0], node


def clean(text: str) -> str:
    """Character references decoded, white space runs as one space, none at the ends."""
    return SPACE.sub(" ", html.unescape(text)).strip(" ")


def marks(attrs: str) -> list[str]:
    """Names in class, id and role, without their numbers; ``hidden`` if the element is."""
    if not attrs or attrs == "/":
        return []
    out = []
    for name, *values in ATTR.findall(attrs):
        out += ["hidden"] if name.lower() == "hidden" else NAME.findall("".join(values).lower())
    return sorted(set(out))


def no_content(tag: str, names: list[str], inside: bool) -> bool:
    if tag in ("html", "body", "main"):
        return False
    if tag == "article":
        return "comment" in names
    if tag == "header" or "header" in names and tag not in ("h1", "h2", "h3"):
        return not inside
    return "hidden" in names or not ASIDE.isdisjoint(names)


class Tree:
    __slots__ = ("children", "label", "number")

    def __init__(self, label: str):
        self.label, self.children, self.number = label, [], -1

    @staticmethod
    def read(text: str) -> Tree:
        top = Tree("")
        stack = [top]
        for token in re.findall(r"[^() ]+|[()]", text):
            if token == "(":
                stack.append(stack[-1].children[-1])
            elif token == ")":
                stack.pop()
            else:
                stack[-1].children.append(Tree(token))
        return top.children[0]

    def written(self) -> str:
        inner = " ".join(c.written() for c in self.children)
        return f"{self.label}({inner})" if inner else self.label

    def count(self, start: int = 0) -> int:
        """Number the nodes from ``start`` in the order in which they are written."""
        self.number = start
        start += 1
        for c in self.children:
            start = c.count(start)
        return start


def matching(a: Tree, b: Tree, known: dict) -> int:
    """Nodes in the largest order-preserving top-down match of two trees; 0 for different roots."""
    if a.label != b.label:
        return 0
    key = (id(a), id(b))
    if key not in known:
        row = [0] * (len(b.children) + 1)
        rows = [row]
        for x in a.children:
            new = [0]
            for j, y in enumerate(b.children):
                new.append(max(row[j + 1], new[j], row[j] + matching(x, y, known)))
            rows.append(new)
            row = new
        known[key] = (row[-1] + 1, rows)
    return known[key][0]


def merge(wrapper: Tree, tree: Tree, grow: bool, known: dict | None = None) -> list[int]:
    """Slots (numbers of the wrapper's nodes) of the tree's nodes in written order, -1 unmatched.

    With ``grow`` unmatched nodes are put into the wrapper behind their last matched sibling.
    """
    known = {} if known is None else known
    slots = [wrapper.number]
    if matching(wrapper, tree, known) == 0:
        return [-1] * tree.count()
    rows = known[id(wrapper), id(tree)][1]
    i, j, pairs = len(wrapper.children), len(tree.children), {}
    while i and j:
        if rows[i][j] == rows[i - 1][j]:
            i -= 1
        elif rows[i][j] == rows[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs[j] = i
    before, out = 0, []
    for j, child in enumerate(tree.children):
        if j in pairs:
            out += wrapper.children[before:pairs[j] + 1]
            before = pairs[j] + 1
            slots += merge(wrapper.children[pairs[j]], child, grow, known)
        else:
            out.append(child)
            slots += [-1] * child.count()
    if grow:
        wrapper.children = out + wrapper.children[before:]
    return slots


def induce(trees: list[str]) -> str:
    """One wrapper that every tree matches, begun with the first tree."""
    wrapper = Tree.read(trees[0])
    for text in trees[1:]:
        merge(wrapper, Tree.read(text), grow=True)
    return wrapper.written()


def host_of(url: Column) -> Column:
    """Lower-cased part behind the first ``://``, empty without one."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.substring(url, F.instr(url, "://") + 3, F.length(url)), "/", 1))
    return F.coalesce(F.lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.lit(""))


BLOCK = "struct<node:int,text:string,links:int,inside:boolean>"


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, skeleton, title (a digest of it, or of the texts without one) and the blocks."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def reading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.struct([("node", pa.int32()), ("text", pa.string()), ("links", pa.int32()), ("inside", pa.bool_())])
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = batch.slice(at, 64)
                skeletons, titles, blocks = [], [], []
                for source in rows.column("html").to_pylist():
                    page = Page(source or "")
                    skeleton, node = page.folded()
                    skeletons.append(skeleton)
                    titles.append(page.title or "\n".join(b[1] for b in page.blocks))
                    blocks.append([{"node": node[e], "text": t, "links": k, "inside": i} for e, t, k, i in page.blocks])
                yield pa.RecordBatch.from_pydict({
                    **{c: rows.column(c) for c in ("page_id", "url", "host")}, "skeleton": pa.array(skeletons, pa.string()),
                    "title": pa.array(titles, pa.string()), "blocks": pa.array(blocks, pa.list_(block))})

    return pages.select("page_id", "url", host_of(F.col("url")).alias("host"), "html").mapInArrow(
        reading, f"page_id {kind}, url string, host string, skeleton string, title string, blocks array<{BLOCK}>"
    ).withColumn("title", F.xxhash64("title"))


def wrappers(skeletons: DataFrame, fan: int = FAN) -> DataFrame:
    """(host, wrapper): the merged trees of each host, at most some ``fan`` of them in one task.

    Hosts with more trees are merged in groups first, and the groups' wrappers again.
    """
    def merging(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group.column("n").to_pylist(), group.column("tree").to_pylist()), key=lambda r: (-r[0], r[1]))
        return pa.table({
            "host": pa.array([group.column("host")[0].as_py()], pa.string()),
            "tree": pa.array([induce([t for _, t in rows])], pa.string()), "n": pa.array([sum(n for n, _ in rows)], pa.int64())})

    kind = "host string, tree string, n long"
    trees = skeletons.select("host", F.col("skeleton").alias("tree"), "n")
    while True:
        sizes = trees.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / fan).alias("groups")).where("groups > 1")
        large = settled(sizes)
        if large.isEmpty():
            break
        grouped = attach(trees, large, ["host"], policy=POLICY)
        group = F.coalesce(F.pmod(F.xxhash64("tree"), F.col("groups")), F.lit(0))
        trees = settled(grouped.withColumn("group", group).groupBy("host", "group").applyInArrow(merging, kind))
    return trees.groupBy("host").applyInArrow(merging, kind).select("host", F.col("tree").alias("wrapper"))


def aligned(skeletons: DataFrame, induced: DataFrame) -> DataFrame:
    """(host, skeleton, slots): the wrapper's node for each node of every distinct skeleton, matched once."""
    def aligning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, wrapper = None, None
        for batch in batches:
            slots = []
            for w, s in zip(batch.column("wrapper").to_pylist(), batch.column("skeleton").to_pylist()):
                if w != text:
                    text, wrapper = w, Tree.read(w)
                    wrapper.count()
                slots.append(merge(wrapper, Tree.read(s), grow=False))
            yield pa.RecordBatch.from_pydict({
                "host": batch.column("host"), "skeleton": batch.column("skeleton"), "slots": pa.array(slots, pa.list_(pa.int32()))})

    both = attach(skeletons.select("host", "skeleton"), induced, ["host"], policy=POLICY)
    return both.select("host", "skeleton", "wrapper").mapInArrow(aligning, "host string, skeleton string, slots array<int>")


def templates(slotted: DataFrame) -> DataFrame:
    """(host, fixed): slot and text digest of what a host repeats; digest NULL for a whole slot of links.

    Texts are counted over all pages of the host by distinct titles. A
    text counts when it fills most pages, so a host has at most about twice as many as a page has blocks.
    """
    block = F.col("b")
    lines = slotted.select("host", "title", F.explode("blocks").alias("b")).select(
        "host", "title", block["slot"].alias("slot"), block["inside"].alias("inside"), block["digest"].alias("digest"),
        block["links"].alias("links"), block["size"].alias("size")).where("slot >= 0")
    once = lines.groupBy("host", "slot", "inside", "digest", "title").agg(F.sum("links").alias("links"), F.sum("size").alias("size"))
    once = settled(once)
    texts = once.groupBy("host", "slot", "inside", "digest").agg(F.count(F.lit(1)).alias("titles"))
    slots = once.groupBy("host", "slot", "inside", "title").agg(F.sum("links").alias("links"), F.sum("size").alias("size")).groupBy(
        "host", "slot", "inside").agg(F.count(F.lit(1)).alias("of"), F.sum("links").alias("links"), F.sum("size").alias("size"))
    share = F.when(F.col("inside"), INSIDE[0]).otherwise(OUTSIDE[0])
    least = F.when(F.col("inside"), INSIDE[1]).otherwise(OUTSIDE[1])
    fixed = attach(texts.where(F.col("titles") >= least), slots.select("host", "slot", "inside", "of"), ["host", "slot", "inside"],
                   policy=POLICY).where(F.col("titles") >= share * F.col("of")).select("host", "slot", "digest")
    menus = slots.where(~F.col("inside") & (F.col("links") > LINKED * F.col("size"))).select(
        "host", "slot", F.lit(None).cast("long").alias("digest"))
    return fixed.union(menus).groupBy("host").agg(F.collect_list(F.struct("slot", "digest")).alias("fixed"))


def main_texts(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text and n_chars.

    The text is what the page's article element holds, else its body, without regions
    that name themselves as something else (``DROPPED``, ``ASIDE``) and without what the
    host's wrapper shows to be template. Blocks come in page order, one a line; a line
    break is a space. Broken markup is read as far as it goes: missing closing
    tags are implied, unknown ones ignored, deep nesting is cut in the tree but not in the text.

    NULL html and pages without text give an empty text; a NULL url, or one without
    host, belongs to the host ``''``; repeated rows each give a row; pages of one title count once
    for the template, so copies do not turn their article into it; an empty table gives no row;
    other columns are not read. A host with most of the pages is spread by salt
    where its wrapper or templates are joined, and its trees are merged in groups. A page is held whole.
    """
    read = settled(parsed(pages))
    skeletons = settled(read.groupBy("host", "skeleton").agg(F.count(F.lit(1)).alias("n")))
    slots = aligned(skeletons, wrappers(skeletons))
    slotted = attach(read, slots, ["host", "skeleton"], policy=POLICY)
    slotted = slotted.withColumn("blocks", F.transform("blocks", lambda b: F.struct(
        F.get("slots", b["node"]).alias("slot"), F.xxhash64(b["text"]).alias("digest"), b["links"].alias("links"),
        F.length(b["text"]).alias("size"), b["inside"].alias("inside"), b["text"].alias("text"))))
    known = attach(slotted, templates(slotted), ["host"], policy=POLICY)
    declared = F.exists("blocks", lambda b: b["inside"])
    own = F.filter("blocks", lambda b: b["inside"] | ~declared)
    null = F.lit(None).cast("long")
    free = F.filter(own, lambda b: F.coalesce(
        ~F.array_contains("fixed", F.struct(b["slot"], b["digest"]))
        & (b["inside"] | ~F.array_contains("fixed", F.struct(b["slot"], null.alias("digest")))), F.lit(True)))
    text = F.array_join(F.transform(free, lambda b: b["text"]), "\n")
    return known.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


# The given pages keep their story between article tags and end its blocks at h1 and p tags: no tree, no wrapper.
SQL = r"""WITH a AS (SELECT page_id, url, regexp_extract(html, '<article>(.*?)</article>', 1, 's') AS story FROM pages),
b AS (SELECT page_id, url, list_filter(list_transform(string_split_regex(story, '</?(?:h1|p)>'), lambda x: trim(regexp_replace(
  regexp_replace(replace(x, '<b>', ''), '<[^>]*>', ' ', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'))), lambda x: x <> '') AS blocks FROM a),
c AS (SELECT page_id, url, COALESCE(array_to_string(blocks, chr(10)), '') AS text FROM b),
d AS (SELECT page_id, url, regexp_replace(replace(replace(replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'),
  '&quot;', '"'), '&#39;', chr(39)), '&#x27;', chr(39)), '&amp;?', '&', 'g') AS text FROM c)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM d"""


@register("op11_html_extraction", SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return main_texts(table(spark, folder, "pages"))
