"""Main text of web pages by site style trees.

The pages of one host are merged into one style tree: its nodes are the paths of block
elements (tag, class and id words, digits dropped) of those pages. A node of m pages
has two measures in [0, 1]:

* presentation: the entropy, to base m, of the sequences of children it has; a node
  that looks alike on every page has 0;
* content: one less the mean, over the texts that stand in it, of log_m(c), c being
  the number of pages with that text there; texts of all pages give 0, own texts 1.

The importance of a branch is the larger of its content, weighted over all that stands
below it, and half its presentation, drawn towards NEUTRAL by PRIOR_PAGES pages: few pages say
little, and a node of one page says nothing. A block has the importance of the node it stands in. What the page's own
marks say is a bounded prior: blocks in a landmark (article, main) gain MARK, blocks outside the
landmarks of a page that has some lose MARK. As MARK is less than half the range of the
importance, text of all pages falls inside landmarks too, and own text stays outside
them. Blocks below LEAST fall; the rest gives the text.

A host also has a cut (`host_cuts`): where the contents of its nodes in which text stands part with
the least variance within the two parts. Without marks (`extract(..., marks=False)`) it decides alone.

A node also has a mass: the characters that stand in it, each text's weighted by 1 - log_m(c).
Branches whose tag or class names a menu, header, footer, sidebar, notice, advert, form or
comments fall, as their texts are often other ones on each page; unless the tree overrules the name: a branch with over half of the mass of its
host is the host's text, whatever it is called (but comments are comments). Inside a landmark only a name
that says nothing else counts ("ad-slot" does, "ad-lib", "related-work" and a table called menu don't); so it is with
comments everywhere. A landmark has no such name but as a comment. Names on html, body and on wrappers, and forms and page headers
that wrap, are no marks either: an element wraps if it holds a main, most of the text of the
page's articles or, where there are neither, of the page (a comment section has to hold all of it). Landmarks in a nav, footer, aside or comment are none. Where names alone would take
all text, or all of the landmarks, only comments count.

The tree is two counting aggregations over (host, node, value); the hot host's values
are many keys, pre-counted in each task. Only nodes of two pages and more come back to the
pages: as a broadcast table if it is small; else page and node rows are joined, salted
against hot hosts, and a page gets the few nodes that it has itself, never its host's tree.

Null html is empty; null or odd urls share the host ''. A page without kept text has
an empty text. A page of any length is parsed whole. Pages of one host with equal html count
as one page: each of n copies has a weight of 1/n. An importance equal to LEAST (a tie) stays.
Where the tree would take all blocks of a page, its marks alone decide. An empty table gives
none. An input column named text is left out of the output.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import SLICE_BYTES, col, map_texts, texts
from .staging import settle

#: What a node's pages weigh against: its importance is drawn towards NEUTRAL as if by so many pages.
PRIOR_PAGES = 1.0
LEAST = NEUTRAL = 0.5
MARK = 0.4
#: Importances are counted by host in so many bins, to find the cut between its two kinds.
BINS = 200
BROADCAST_BYTES = 8 << 20
#: Into so many parts a hot host's rows are dealt where tables are joined.
SALTS = 16

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg|textarea|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+)>|<[!?][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([^\s"'/=>]+)\s*+(?:=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
WORD = re.compile("[a-z]+")

#: Elements that begin a block of their own.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section select summary table tbody td tfoot th thead tr ul button".split()
)
#: An opening tag ends these if they are open and nothing of the second set stands between.
ENDS = {"p": ({"p"}, set()), "li": ({"li", "p"}, {"ul", "ol", "menu"}), "tr": ({"tr", "td", "th", "p"}, {"table"}), "td": ({"td", "th", "p"}, {"tr"}), "th": ({"td", "th", "p"}, {"tr"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"})}
SINGLE = frozenset({"hr"})
LANDMARKS = frozenset({"article", "main"})
OUTER_TAGS = frozenset("nav footer aside menu dialog select button head".split())
#: Outer if they wrap nothing; a header only outside landmarks.
SOFT_TAGS = frozenset("form fieldset header".split())
OUTER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo cookie cookies consent gdpr notice popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside comment comments reply replies disqus share sharing social "
    "related recommended newsletter subscribe signup login search widget pagination pager masthead complementary contentinfo".split()
)
#: Of these, those that speak of a landmark itself; "has-sidebar" and the like speak of what is beside it.
TALK_WORDS = frozenset("comment comments reply replies disqus".split())
#: Words beside which a name of the lists above still says the same: "ad-slot" does, "ad-lib" doesn't.
PLAIN_WORDS = frozenset(
    "box block wrap wrapper container button buttons bar list links link item items post posts article articles story stories slot unit section area inner outer "
    "top bottom left right main site page content primary secondary icons icon count body text thread user reader author meta form tree title holder group row col head".split()
)
NAMED_BY = frozenset({"class", "id", "role"})
WHOLE = frozenset({"html", "body"})


class Element:
    """An open or closed block element: its place in `elements` of its parent, marks, and lengths of text in it."""

    __slots__ = ("parent", "tag", "node", "landmark", "hard", "word", "plain", "talk", "main", "length", "landed")

    def __init__(self, parent, tag, node, landmark, names):
        self.parent, self.tag, self.node, self.landmark = parent, tag, node, landmark
        words = {w for name in names for w in name}
        said = [set(name) for name in names if name and all(w in OUTER_WORDS or w in PLAIN_WORDS for w in name)]
        self.talk = any(name & TALK_WORDS for name in said)
        self.word = not landmark and bool(words & OUTER_WORDS)
        self.plain = tag != "table" and any(name & OUTER_WORDS for name in said)
        self.hard = tag in OUTER_TAGS or landmark and self.talk
        self.main, self.length, self.landed = False, 0, 0


def judge(elements: list[Element], own: list[tuple[int, int]]) -> list[tuple[tuple[Element, ...], bool]]:
    """(marks, inside) of each element: the elements about it that are marked as outer, and whether it is in a
    landmark; own: place of an element and length of text that stands in it."""
    hidden, landed = [False] * len(elements), [False] * len(elements)
    for i, e in enumerate(elements[1:], 1):
        hidden[i] = hidden[e.parent] or e.hard
        landed[i] = not hidden[i] and (landed[e.parent] or e.landmark)
        e.main = landed[i] and e.landmark and e.tag != "article"
    for i, n in own:
        elements[i].length += n
        elements[i].landed += n * landed[i]
    for e in reversed(elements[1:]):
        up = elements[e.parent]
        up.length, up.landed, up.main = up.length + e.length, up.landed + e.landed, up.main or e.main
    top = elements[0]

    def wraps(e: Element) -> bool:
        most_landed = e.main or 2 * e.landed > top.landed
        most = 2 * e.length > top.length
        if e.talk:
            return e.main or (e.landed == top.landed if top.landed else e.length == top.length)
        return most_landed or most and not top.landed and not top.main and e.tag != "header"

    def marks(names: bool) -> list[tuple[tuple[Element, ...], bool]]:
        out: list[tuple[tuple[Element, ...], bool]] = [((), False)]
        for e in elements[1:]:
            marked, inside = out[e.parent]
            soft = names and ((e.plain and e.word if inside else e.word) or e.tag in SOFT_TAGS and not (e.tag == "header" and inside)) or e.talk and not e.landmark
            if e.hard or soft and e.tag not in WHOLE and not wraps(e):
                marked = (*marked, e)
            out.append((marked, inside or e.landmark))
        return out

    out = marks(True)
    if any(not out[i][0] and (landed[i] or not top.landed) for i, _ in own):
        return out
    return marks(False)


class Block:
    """A run of text of one block element: path of nodes, marks, and its text."""

    __slots__ = ("nodes", "marks", "inside", "text")

    def __init__(self, nodes, text):
        self.nodes, self.marks, self.inside, self.text = nodes, (), False, text


def node_id(path: str) -> int:
    return xxhash.xxh64_intdigest(path) - (1 << 63)


ROOT, CUT = node_id(""), node_id("#cut")


def parse(page: str) -> tuple[list[Block], dict[int, list[str]]]:
    """The blocks of a page in order, and each node's children, in order and without repeats in a row."""
    blocks: list[Block] = []
    children: dict[int, list[str]] = {}
    elements, own = [Element(0, "", ROOT, False, [])], []
    # Open block elements: tag, node, path, place in elements.
    stack: list[tuple[str, int, str, int]] = [("", ROOT, "", 0)]
    run: list[str] = []
    at = 0

    def close() -> None:
        if run:
            said = " ".join(html.unescape("".join(run)).split())
            run.clear()
            if said:
                own.append((stack[-1][3], len(said)))
                blocks.append(Block([s[1] for s in stack], said))

    for m in TOKEN.finditer(page):
        if m.start() > at:
            run.append(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag not in BLOCKS:
            if tag == "br":
                run.append(" ")
            continue
        close()
        if m[2]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        ends, fence = ENDS.get(tag, ({"p"}, set()))
        k = len(stack)
        while k > 1 and stack[k - 1][0] not in fence and stack[k - 1][0] in ends:
            k -= 1
        del stack[k:]
        words: set[str] = set()
        names: list[list[str]] = []
        landmark = tag in LANDMARKS
        if m[4]:
            for a in ATTRIBUTE.finditer(m[4]):
                name = a[1].lower()
                if name in NAMED_BY:
                    value = (a[2] or a[3] or a[4] or "").lower()
                    said = WORD.findall(value)
                    words.update(said)
                    names += [WORD.findall(part) for part in value.split()]
                    landmark = landmark or name == "role" and "main" in said
        _, parent, path, place = stack[-1]
        name = ".".join([tag, *sorted(words)])
        kids = children.setdefault(parent, [])
        if not kids or kids[-1] != name:
            kids.append(name)
        if tag in SINGLE:
            continue
        path = f"{path}>{name}"
        elements.append(Element(place, tag, node_id(path), landmark, names))
        stack.append((tag, elements[-1].node, path, len(elements) - 1))
        children.setdefault(stack[-1][1], [])
    if at < len(page):
        run.append(page[at:])
    close()
    judged = judge(elements, own)
    for b, (i, _) in zip(blocks, own):
        b.marks, b.inside = judged[i]
    return blocks, children


Nodes = dict[int, tuple[float, float]]


def by_tree(block: Block, nodes: Nodes) -> float:
    """What the tree alone says of a block, around NEUTRAL: how far its node lies from the host's cut."""
    if block.nodes[-1] not in nodes or CUT not in nodes:
        return NEUTRAL
    (cut, reach), at = nodes[CUT], nodes[block.nodes[-1]][0]
    return NEUTRAL + max(-0.5, min(0.5, (at - cut) / max(reach, 1e-6) / 2))


def text_of(blocks: list[Block], nodes: Nodes, marks: bool = True) -> str:
    """What is kept of a page's blocks, given importance and mass of nodes of its host's tree (absent: NEUTRAL).

    marks: whether the page's own marks have a say; without them the tree's cut decides alone.
    """
    if not marks:
        return "\n".join(b.text for b in blocks if by_tree(b, nodes) >= LEAST)
    whole = nodes.get(ROOT, (0.0, 0.0))[1]

    def overruled(e: Element) -> bool:
        return not e.talk and 2 * nodes.get(e.node, (0.0, 0.0))[1] > whole

    blocks = [b for b in blocks if all(map(overruled, b.marks))]
    landmarks = any(b.inside for b in blocks)
    mark = lambda b: MARK if b.inside else -MARK if landmarks else 0.0
    kept = [b.text for b in blocks if nodes.get(b.nodes[-1], (NEUTRAL,))[0] + mark(b) >= LEAST]
    return "\n".join(kept or [b.text for b in blocks if NEUTRAL + mark(b) >= LEAST])


def main_text(page: str, nodes: Nodes) -> str:
    """As text_of, of a page's html."""
    return text_of(parse(page)[0], nodes)


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url.cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


PAGE, STYLE, TEXT, STANDS = 0, 1, 2, 3


def style_counts(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """(host, node, kind, value, n, chars): distinct pages with a node, with a sequence of children, with a text in it,
    and the characters of such texts."""
    schema = "host string, node long, kind int, value long, n double, chars double"
    rows = pages.select(host_of(col(url)).alias("host"), F.coalesce(col(page).cast("string"), F.lit("")).alias("page"))
    rows = rows.withColumn("digest", F.xxhash64("page"))
    copies = settle(rows.groupBy("host", "digest").agg(F.count("*").alias("copies")).filter("copies > 1"), "copies")
    size = copies.agg(F.coalesce(F.sum(F.length("host") + 16), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        rows = rows.join(F.broadcast(copies), ["host", "digest"], "left")
    else:
        copies = copies.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.spark_partition_id() % SALTS).join(copies, ["host", "digest", "salt"], "left")
    rows = rows.select("host", "page", (1 / F.coalesce("copies", F.lit(1))).alias("share"))

    def run(batches):
        for batch in batches:
            hosts, shares, size = batch.column(0).to_pylist(), batch.column(2).to_pylist(), 0
            seen: dict[tuple, float] = defaultdict(float)
            chars: dict[tuple, float] = defaultdict(float)
            for i, (host, share) in enumerate(zip(hosts, shares)):
                text = batch.column(1)[i].as_py() or ""
                blocks, children = parse(text)
                found = {(host, n, PAGE, 0) for n in children}
                found.update((host, n, STYLE, node_id("|".join(kids))) for n, kids in children.items() if kids)
                found.update((host, b.nodes[-1], STANDS, 0) for b in blocks)
                for b in blocks:
                    value = node_id(b.text)
                    for n in b.nodes:
                        key = (host, n, TEXT, value)
                        found.add(key)
                        chars[key] += share * len(b.text)
                for key in found:
                    seen[key] += share
                size += len(text)
                if size > SLICE_BYTES or i == len(hosts) - 1:
                    cols = [*zip(*seen)]
                    types = [pa.string(), pa.int64(), pa.int32(), pa.int64()]
                    arrays = [pa.array(c, t) for c, t in zip(cols, types)]
                    arrays += [pa.array(list(seen.values()), pa.float64()), pa.array([chars.get(k, 0.0) for k in seen], pa.float64())]
                    yield pa.RecordBatch.from_arrays(arrays, ["host", "node", "kind", "value", "n", "chars"])
                    seen.clear()
                    chars.clear()
                    size = 0

    counted = rows.mapInArrow(run, schema).groupBy("host", "node", "kind", "value")
    return counted.agg(F.round(F.sum("n")).cast("long").alias("n"), F.sum("chars").alias("chars"))


def node_importance(counts: DataFrame) -> DataFrame:
    """(host, node, pages, importance, mass) of every node of the style trees."""
    on = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x).otherwise(0.0))
    n = F.col("n").cast("double")
    nodes = counts.groupBy("host", "node").agg(
        on(PAGE, n).alias("m"), on(STYLE, n).alias("s"), on(STYLE, n * F.log(n)).alias("s_log"),
        on(STANDS, n).alias("own"), on(TEXT, n).alias("t"), on(TEXT, n * F.log(n)).alias("t_log"), F.sum("chars").alias("c"), on(TEXT, F.col("chars") * F.log(n)).alias("c_log"),
    )
    base = F.log(F.col("m"))
    presentation = F.when(F.col("s") > 0, (F.log("s") - F.col("s_log") / F.col("s")) / base).otherwise(0.0)
    content = F.when(F.col("t") > 0, 1 - F.col("t_log") / F.col("t") / base).otherwise(0.0)
    many = F.col("m") > 1
    share = F.col("m") / (F.col("m") + PRIOR_PAGES)
    worth = F.when(many, NEUTRAL + (F.greatest(content, presentation / 2) - NEUTRAL) * share).otherwise(NEUTRAL)
    mass = F.when(many, F.col("c") - F.col("c_log") / base).otherwise(F.col("c"))
    own = F.when(many, F.greatest(F.lit(0.0), F.least(F.lit(1.0), content)))
    return nodes.select("host", "node", F.col("m").cast("long").alias("pages"), worth.alias("importance"), mass.alias("mass"), F.when(F.col("own") > 0, own).alias("own"))


def host_cuts(nodes: DataFrame) -> DataFrame:
    """(host, node = CUT, importance = cut, mass = reach): where the importances of a host's nodes part.

    Of all cuts of a host's nodes in which text stands, this is the one with the least variance within the two parts;
    reach is half the distance of their means. A host whose nodes are all alike, or all of one page, has none.
    """
    bins = nodes.filter("own is not null").groupBy("host", F.floor(F.col("own") * BINS).cast("int").alias("bin")).agg(F.count("*").alias("k"), F.sum("own").alias("s"))

    def of_host(key, frame):
        frame = frame.sort_values("bin")
        k, s = frame["k"].to_numpy(float).cumsum(), frame["s"].to_numpy(float).cumsum()
        if len(k) < 2:
            return frame.iloc[:0].assign(importance=0.0, mass=0.0)[["host", "importance", "mass"]]
        low, high = s[:-1] / k[:-1], (s[-1] - s[:-1]) / (k[-1] - k[:-1])
        at = int(np.argmax(k[:-1] * (k[-1] - k[:-1]) * (high - low) ** 2))  # least within is most between
        # Midway between the parts' nearest bins.
        cut = (frame["bin"].iloc[at] + 1 + frame["bin"].iloc[at + 1]) / 2 / BINS
        return type(frame)({"host": [key[0]], "importance": [cut], "mass": [(high[at] - low[at]) / 2]})

    # At most BINS + 1 rows a host.
    found = bins.groupBy("host").applyInPandas(of_host, "host string, importance double, mass double")
    return found.select("host", F.lit(CUT).alias("node"), "importance", "mass")


class Forest:
    """Nodes of many hosts as sorted arrays: what a broadcast holds."""

    def __init__(self, nodes):
        self.of = {h: tuple(part[c].to_numpy() for c in ("node", "importance", "mass")) for h, part in nodes.sort_values("node").groupby("host")}

    def pick(self, host: str, wanted: list[int]) -> Nodes:
        if host not in self.of or not wanted:
            return {}
        node, importance, mass = self.of[host]
        at = np.minimum(np.searchsorted(node, wanted), len(node) - 1)
        return {n: (float(importance[i]), float(mass[i])) for n, i in zip(wanted, at.tolist()) if node[i] == n}


def nodes_of(blocks: list[Block]) -> list[int]:
    return [CUT, *{n for b in blocks for n in b.nodes}] if blocks else []


def extract(pages: DataFrame, url: str = "url", page: str = "html", keep: tuple[str, ...] = ("page_id", "url"), marks: bool = True) -> DataFrame:
    """Columns `keep` of every page with its main text; marks: as text_of."""
    known = settle(node_importance(style_counts(pages, url, page)).filter(F.col("pages") > 1), "nodes")
    trees = known.select("host", "node", F.col("importance") if marks else F.coalesce("own", "importance").alias("importance"), "mass")
    known = settle(trees.unionByName(host_cuts(known)), "trees")
    names = [n for n in keep if n.lower() != "text"]
    kept = [f"_k{i}" for i in range(len(names))]
    rows = pages.select(col(page).cast("string").alias("_page"), host_of(col(url)).alias("_host"), *(col(n).alias(k) for n, k in zip(names, kept)))
    size = known.agg(F.coalesce(F.sum(F.octet_length("host") + 24), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        shared = pages.sparkSession.sparkContext.broadcast(Forest(known.toPandas()))

        def factory():
            forest = shared.value

            def kernel(array, hosts):
                parsed = [(h, parse(x)[0]) for x, h in zip(texts(array), hosts.to_pylist())]
                return [pa.array([text_of(blocks, forest.pick(h, nodes_of(blocks)), marks) for h, blocks in parsed], pa.string())]

            return kernel

        found = map_texts(rows, "_page", [("text", "string")], factory, kept, ("_host",))
    else:
        found = _joined_texts(rows, known, kept, marks)
    return found.select(*(col(k).alias(n) for k, n in zip(kept, names)), "text")


def _joined_texts(rows: DataFrame, known: DataFrame, kept: list[str], marks: bool) -> DataFrame:
    """Columns `kept` and the text of rows (_page, _host), where the trees are too large to broadcast."""
    rows = settle(rows.select(F.monotonically_increasing_id().alias("_row"), "*"), "pages")  # so that a row keeps its number

    def list_nodes():
        return lambda array: [pa.array([nodes_of(parse(x)[0]) for x in texts(array)], pa.list_(pa.int64()))]

    have = map_texts(rows, "_page", [("nodes", "array<long>")], list_nodes, ("_row", "_host"))
    have = have.select("_row", "_host", F.explode("nodes").alias("node"), (F.col("_row") % SALTS).cast("int").alias("salt"))
    dealt = known.select(F.col("host").alias("_host"), "node", "importance", "mass", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    own = have.join(dealt, ["_host", "node", "salt"]).groupBy("_row").agg(F.collect_list(F.struct("node", "importance", "mass")).alias("_nodes"))

    def factory():
        def kernel(array, nodes):
            trees = ({x["node"]: (x["importance"], x["mass"]) for x in t or ()} for t in nodes.to_pylist())
            return [pa.array([text_of(parse(x)[0], t, marks) for x, t in zip(texts(array), trees)], pa.string())]

        return kernel

    return map_texts(rows.join(own, "_row", "left"), "_page", [("text", "string")], factory, kept, ("_nodes",))
