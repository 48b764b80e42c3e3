"""Main text of web pages by site style trees.

Pages of a host are merged into one tree of style nodes: a node is the way from the root through block
elements with their classes. A node's blocks of text are its contents, the sequence of its children
its presentation. Importance is the entropy that a doubling of the pages still adds, in bits: 1 if
each further page brings contents of its own, 0 if all of them come from a stock that the pages seen
so far have used up (menus, notices, adverts from a pool). Each content counts once, so copies of an
article, under whatever menus, do not lower it. Contents and presentations make the composite
importance: the more children a node has, the more its presentation counts.

A node is as important as the less important of what its host and what all hosts say, either leaning
towards 1 while it knows few pages. The logarithm of its odds decides together with a prior:
elements and names that mark what stands around an article speak against it, the less the more of the
host's text they hold (so that they say nothing about what wraps the page); an article element
speaks for it. Below the border a branch is cut from every page of the host; there a content that no
other page of any host holds still stays if it is much longer than the node's repeated contents.

Everything is counted by host, node and content, never by host alone, so that a host may hold any
share of the pages.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reposcope.llm.common import materialize, parts

#: Pages of importance 1 that are taken as seen beforehand.
LEAN = 3.0
#: Share of the contents for each child element, in the composite importance.
GAMMA = 0.9
#: Verdicts of this many nodes at most (about 100 bytes each) are sent to every worker; more are joined.
BROADCAST_ROWS = 200_000
#: Importance stays this far from 0 and 1, so that its odds are finite.
EDGE = 0.02
#: Log-odds: for an article, against what is marked as around it (outside and inside an article or main
#: element).
ARTICLE, OUTSIDE, INSIDE = 2.0, 8.0, 6.0
#: How many times longer than a cut node's repeated contents a content must be to stay.
LONGER = 4.0
#: Elements within each other that make a way; deeper ones count as their ancestor at that depth.
DEPTH = 64
#: Elements whose text is never shown, elements inside a line, elements without an end,
#: elements and words of classes that mark what is around an article.
HIDDEN = frozenset("script style noscript template head title iframe svg math object select textarea button canvas audio video datalist".split())
RAW = frozenset("script style noscript template iframe textarea title svg".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
AROUND = frozenset("nav footer aside form menu dialog".split())
_AROUND_WORD = re.compile(r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|banner|sponsor\w*|promo\w*|sidebar|side|widget|comments?|respond|disqus|cookies?|consent|notice|alert|popup|modal|newsletter|subscribe|menu|nav|navbar|navigation|breadcrumbs?|footer|share|sharing|social|related|recommended|login|search|toolbar|masthead|copyright|pagination|pager)(?:$|[\s_-])", re.I)
_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_NAIVE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"[0-9]+")
#: Elements that an opening tag ends, beside the paragraphs that blocks end.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


def tags(source: str, at: int = 0) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, slash, name, attributes) of tags; no name for comments and declarations. Linear: once
    a tag's quotes do not close, tags end at the next > whatever is quoted."""
    quoted, n = True, len(source)
    while (at := source.find("<", at)) >= 0:
        after = source[at + 1 : at + 2]
        if source.startswith("<!--", at):
            end = source.find("-->", at + 4)
            end = end + 3 if end >= 0 else n
            yield at, end, "", "", ""
        elif after and after in "!?":
            end = source.find(">", at) + 1
            if not end:
                return
            yield at, end, "", "", ""
        elif after.isalpha() or after == "/":
            m = _OPEN.match(source, at) if quoted else None
            first = source[at + 1 + (after == "/") : at + 2 + (after == "/")]
            if m is None and first.isascii() and first.isalpha():
                quoted = False
                if source.find(">", at) < 0:
                    return
                m = _NAIVE.match(source, at)
            if m is None:
                at += 1
                continue
            end = m.end()
            at = (yield at, end, m[1], m[2].lower(), m[3]) or end
            continue
        else:
            end = at + 1
        at = end


class Page:
    """Blocks of text in page order, each with its node; children of each node."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, str]] = []
        self.children: dict[str, list[str]] = {}
        self.stack: list[tuple[str, str]] = [("", "")]
        self.open: Counter[str] = Counter()
        self.held: list[str] = []
        self.hidden = 0
        at, found = 0, tags(source)
        tag = next(found, None)
        while tag is not None:
            start, end, slash, name, rest = tag
            if not self.hidden:
                self.held.append(source[at:start])
            at = end
            if name and (raw := self._tag(slash, name, rest)):
                close = re.compile(f"</{re.escape(raw)}\\s*>", re.I).search(source, end)
                at = close.end() if close else len(source)
            try:
                tag = found.send(at) if name else next(found)
            except StopIteration:
                tag = None
        if not self.hidden:
            self.held.append(source[at:])
        self._flush()

    def _flush(self) -> None:
        text = _SPACE.sub(" ", entities.unescape("".join(self.held))).strip()
        self.held.clear()
        if text:
            self.blocks.append((self.stack[-1][1], text))

    def _pop(self) -> None:
        name, _ = self.stack.pop()
        self.open[name] -= 1
        self.hidden -= name in HIDDEN

    def _tag(self, slash: str, name: str, rest: str) -> str | None:
        """Takes a tag; the name if the element's text is raw."""
        if name in VOID or name in INLINE:
            if not self.hidden and name == "br":
                self.held.append(" ")
            elif not self.hidden and name == "hr":
                self._flush()
            return None
        if slash:
            if self.open[name] > 0:
                self._flush()
                while self.stack[-1][0] != name:
                    self._pop()
                self._pop()
            return None
        self._flush()
        if name in CLOSES_P or name in _ENDS:
            while self.stack[-1][0] in _ENDS.get(name, ("p",)):
                self._pop()
        above = self.stack[-1][1]
        self.children.setdefault(above, []).append(name)
        if name in RAW:
            return name
        if rest.endswith("/") and name in ("svg", "math"):
            return None
        marks = " ".join(sorted({w for a in _ATTR.finditer(rest) for w in _DIGITS.sub("0", a[2] or a[3] or a[4] or "").split()})) if rest else ""
        if len(marks) > 200:
            marks = xxhash.xxh64_hexdigest(marks.encode("utf-8", "surrogatepass"))
        step = f">{name}.{marks.replace('>', '')}" if marks else f">{name}"
        self.stack.append((name, above + step if len(self.stack) <= DEPTH else above))
        self.open[name] += 1
        self.hidden += name in HIDDEN
        return None


def _steps(node: str) -> list[str]:
    """A node's ancestors and itself, as nodes."""
    at = [i for i, c in enumerate(node) if c == ">"]
    return [node[:i] for i in at[1:]] + [node] if at else []


def marked(node: str) -> tuple[float, list[tuple[str, float]]]:
    """The log-odds that speak for a node as an article's, and the marked ways to it with what each says
    against it. Marks of whatever holds a main element say nothing."""
    article, main, against = False, False, []
    for way in _steps(node):
        name, _, marks = way[way.rfind(">") + 1 :].partition(".")
        if name == "main":
            main = True
            against.clear()
        elif name in AROUND or name == "header" and not (article or main) or marks and name not in ("html", "body", "article") and _AROUND_WORD.search(marks):
            against.append((way, INSIDE if article or main else OUTSIDE))
        article = article or name == "article"
    return (ARTICLE if article and not against else 0.0), against


def host_of(url: str | None) -> str:
    rest = (url or "").partition("://")[2]
    return re.split(r"[/?#]", rest, maxsplit=1)[0].lower()


def _key(text: str, host: str) -> int:
    plain = _DIGITS.sub("0", text.replace(host, "") if host else text)
    return xxhash.xxh64_intdigest(plain.encode("utf-8", "surrogatepass")) - (1 << 63)


def observations(pages: DataFrame) -> DataFrame:
    """(host, node, page, contents, sizes, style, kids): what each node holds on each page, one row for
    each node; page is a key of the page's whole text."""
    names = ["host", "node", "page", "contents", "sizes", "style", "kids"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64()]

    def run(batches):
        for part in parts(batches, 64):
            rows: list[tuple] = []
            for url, source in zip(*(c.to_pylist() for c in part.columns), strict=True):
                page, host = Page(source or ""), host_of(url)
                texts: dict[str, dict[int, int]] = {}
                for node, text in page.blocks:
                    texts.setdefault(node, {})[_key(text, host)] = len(text)
                whole = _key(" ".join(t for _, t in page.blocks), "")
                for node, own in texts.items():
                    below = page.children.get(node, [])
                    rows.append((host, node, whole, list(own), list(own.values()), _key(" ".join(below), ""), len(below)))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    return pages.select("url", "html").mapInArrow(run, "host string, node string, page bigint, contents array<bigint>, sizes array<bigint>, style bigint, kids bigint")


def growth(values: DataFrame, by: list[str], name: str) -> DataFrame:
    """Of ``values(..., a, b)``, one row for each different value with whether either half of the pages
    holds it: the entropy that the second half adds, counting each value once; 0 to 1."""
    halves = F.sum("a") + F.sum("b")
    return values.groupBy(*by).agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.log2(2 * F.count("*") / halves))).alias(name))


def _held(rows: DataFrame, by: list[str]) -> DataFrame:
    """Different values with the halves that hold them, and the least and greatest page that does."""
    return rows.groupBy(*by).agg(F.max("a").alias("a"), F.max("b").alias("b"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("size").alias("size"))


def importance(seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, node, u, size): composite importance of each node and its characters on the host; and
    (host, node, content): contents that stay though their node may be cut."""
    once = seen.groupBy("host", "node", "page").agg(*(F.first(c).alias(c) for c in ("contents", "sizes", "style", "kids")))
    half = F.pmod("page", F.lit(2))
    once = once.withColumns({"a": 1 - half, "b": half, "low": F.col("page"), "high": F.col("page")})
    blocks = once.select("host", "node", F.explode(F.arrays_zip("contents", "sizes")).alias("x"), "a", "b", "low", "high").select("host", "node", F.col("x.contents").alias("content"), F.col("x.sizes").alias("size"), "a", "b", "low", "high")
    own = materialize(_held(blocks, ["host", "node", "content"]), "contents")
    every = _held(own, ["node", "content"])
    styles = _held(once.withColumn("size", F.lit(0)), ["host", "node", "style"])
    weight = F.pow(F.lit(GAMMA), "kids")

    def composite(contents, presentations, counted, by, name):
        rows = growth(contents, by, "c").join(growth(presentations, by, "s"), by).join(counted, by)
        u = (1 - weight) * F.col("s") + weight * F.col("c")
        return rows.select(*by, ((F.col("m") * u + LEAN) / (F.col("m") + LEAN)).alias(name))

    pages = once.groupBy("host", "node").agg(F.count("*").alias("m"), F.avg("kids").alias("kids"))
    total = pages.groupBy("node").agg(F.sum("m").alias("m_"), (F.sum(F.col("m") * F.col("kids")) / F.sum("m")).alias("kids")).withColumnRenamed("m_", "m")
    by_host = composite(own, styles, pages, ["host", "node"], "own")
    by_node = composite(every, _held(styles, ["node", "style"]), total, ["node"], "every")
    chars = F.aggregate("sizes", F.lit(0).cast("bigint"), lambda total, x: total + x)
    sizes = once.groupBy("host", "node").agg(F.sum(chars).alias("size"))
    tree = by_host.join(by_node, "node").join(sizes, ["host", "node"]).select("host", "node", F.least("own", "every").alias("u"), "size")
    repeated = every.where("low < high").groupBy("node").agg(F.avg("size").alias("usual"))
    tree = materialize(tree, "style-tree")
    single = every.where("low = high").join(repeated, "node").where(F.col("size") > LONGER * F.col("usual")).select("node", "content")
    return tree, own.join(tree.where("u < 0.5").select("host", "node"), ["host", "node"]).join(single, ["node", "content"]).select("host", "node", "content")


def verdicts(tree: DataFrame) -> DataFrame:
    """(host, node, odds, prior) of each node: odds of its importance and prior together, and the prior
    alone. What a marked way says weighs less the more of the host's text it holds."""

    def run(batches):
        for batch in batches:
            rows = []
            for host, node in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                plus, against = marked(node)
                rows += [(host, node, plus, way, x) for way, x in against or [(None, 0.0)]]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.string(), pa.string(), pa.float64(), pa.string(), pa.float64()), strict=True)], ["host", "node", "plus", "way", "against"])

    said = tree.select("host", "node").mapInArrow(run, "host string, node string, plus double, way string, against double")
    steps = F.split("node", ">")
    ways = F.transform(F.sequence(F.lit(2), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), ">"))
    inside = tree.where(F.size(steps) > 1).select("host", F.explode(ways).alias("way"), "size").groupBy("host", "way").agg(F.sum("size").alias("inside"))
    whole = tree.groupBy("host").agg(F.sum("size").alias("whole"))
    held = said.join(inside, ["host", "way"], "left").join(whole, "host")
    minus = F.when(F.col("way").isNotNull(), -F.col("against") * (1 - F.col("inside") / F.col("whole"))).otherwise(0.0)
    prior = held.groupBy("host", "node").agg((F.max("plus") + F.min(minus)).alias("prior"))
    u = F.least(F.greatest("u", F.lit(EDGE)), F.lit(1 - EDGE))
    return tree.join(prior, ["host", "node"]).select("host", "node", (F.log(u / (1 - u)) + F.col("prior")).alias("odds"), "prior")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row. Null pages count as empty; text is empty if nothing
    is left. Repeated rows give repeated rows and count once in the trees; null URLs make one host of
    their own; other columns are not read; an empty table gives no rows. Pages are read whole, in
    linear time, however long they are and whatever tags they leave open.

    Verdicts of BROADCAST_ROWS nodes at most go to all workers; more are joined to the blocks."""
    tree, rare = importance(materialize(observations(pages), "style-nodes"))
    said, rare = materialize(verdicts(tree), "verdicts"), materialize(rare, "rare-contents")
    if said.count() + rare.count() > BROADCAST_ROWS:
        return _joined(pages, said, rare)
    nodes = {(r["host"], r["node"]): (r["odds"], r["prior"]) for r in said.toLocalIterator()}
    own = {(r["host"], r["node"], r["content"]) for r in rare.toLocalIterator()}
    shared = pages.sparkSession.sparkContext.broadcast((nodes, own))

    def run(batches):
        known, single = shared.value
        for part in parts(batches, 64):
            out = []
            for url, source in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                host, found = host_of(url), []
                for node, text in Page(source or "").blocks:
                    odds, prior = known[host, node]
                    if odds >= 0 or prior > -_MOST and single and (host, node, _key(text, host)) in single:
                        found.append(text)
                out.append(" ".join(found))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")


#: The greatest odds that importance alone can give.
_MOST = 3.9


def _joined(pages: DataFrame, said: DataFrame, rare: DataFrame) -> DataFrame:
    """The same by joins of all blocks with their verdicts; a row for each page marks it at place -1."""
    kind = pages.schema["page_id"].dataType.simpleString()
    kinds = [pa.int64(), None, pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string()]
    names = ["row", "page_id", "url", "place", "host", "node", "content", "text"]

    def run(batches):
        for part in parts(batches, 64):
            rows = []
            for row, page_id, url, source in zip(*(c.to_pylist() for c in part.columns), strict=True):
                host = host_of(url)
                rows.append((row, page_id, url, -1, host, None, None, None))
                rows += [(row, page_id, url, i, host, node, _key(text, host), text) for i, (node, text) in enumerate(Page(source or "").blocks)]
            own = [k or part.column(1).type for k in kinds]
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, own, strict=True)], names)

    numbered = pages.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", "html")
    blocks = materialize(numbered.mapInArrow(run, f"row bigint, page_id {kind}, url string, place int, host string, node string, content bigint, text string"), "blocks")
    kept = blocks.join(said, ["host", "node"], "left").join(rare.withColumn("single", F.lit(True)), ["host", "node", "content"], "left")
    kept = kept.where((F.col("place") < 0) | (F.col("odds") >= 0) | (F.col("prior") > -_MOST) & F.col("single"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("place") >= 0, F.struct("place", "text")))), lambda x: x["text"]), " ")
    made = kept.groupBy("row").agg(F.first("page_id").alias("page_id"), F.first("url").alias("url"), text.alias("text"))
    return made.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
