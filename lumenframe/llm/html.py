"""Main text of web pages with a site style tree.

Pages of one host are merged: elements with the same path of styles (tag, class, id) from the root form an element node of
the host's tree, and the different sequences of child styles of a node are its presentation styles. Importance goes from
the leaves up. A leaf is as important as its content varies: the entropy of its texts over the most that so many could
have, times the share of its words that aren't links (menus differ from page to page, but link throughout). An inner node's own part is the entropy of its presentation styles, likewise relative; with l styles it weighs
1 - DECAY ** l, and the mean importance of its children (by style, then over the styles' shares) weighs DECAY ** l. Text
that an inner node holds beside its children is a leaf of its own. Nodes on fewer than MIN_PAGES different pages, or on
less than SUPPORT of their host's, count as important (1), so a host's tree has at most (mean nodes a page) / SUPPORT nodes.

Branches below LOW importance are removed from each page. Beside the tree, branches are removed that their tag, role, class
or id names as menus, headers, footers, sidebars, notices, adverts, forms, comments or code, and where a page marks an
article (or else a main element), its text alone is taken; ``marks=False`` leaves both out.

Pages with equal text count once, so that copies don't make their content unimportant. White space within a block becomes
one space, blocks are joined by one space in page order. Null html gives an empty text; null URLs and those without a host
share the host ''. Repeated rows stay repeated; an empty table gives an empty table. Very long and very deep pages are
taken whole. Malformed markup is read tolerantly: unclosed elements end with their parent, stray end tags are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.llm._shared import checkpoint, fresh, join_groups, numbered, quoted, written

MIN_PAGES, SUPPORT = 5, 0.01
LOW = 0.2
#: What one more presentation style leaves of the children's weight.
DECAY = 0.9
#: A parent's share for one child, in steps of 1 / STEPS (integers, so that sums don't depend on order).
STEPS = 1_000_000
OPENING = re.compile(r"<(?:(!--|!\[CDATA\[|[!?])|(/?)([a-zA-Z][^\s/>]*))")
ENDS = {"!--": "-->", "![CDATA[": "]]>", "!": ">", "?": ">"}
#: What may follow the closing quote of an attribute's value.
AFTER_VALUE = frozenset(" \t\r\n\f/>")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table ul".split())
SELF_CLOSING = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr", ("table", "tbody", "thead")), "td": ("td th", ("tr",)), "th": ("td th", ("tr",)), "option": ("option", ("select",))}
NOISE_TAGS = frozenset("script style noscript template nav header footer aside form button select textarea input option iframe svg canvas dialog menu head title object embed audio video map datalist".split())
#: Those that never hold a page's text, whatever else is in them.
HARD = frozenset("script style noscript template button select textarea input option iframe svg canvas head title object embed audio video map datalist".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice notices notification popup modal overlay "
    "newsletter subscribe subscription signup login sidebar side aside nav navbar navigation menu menus breadcrumb breadcrumbs footer foot header masthead topbar comment comments commentlist disqus replies reply "
    "respond discussion share sharing social related recommended recommendations widget widgets toolbar pagination pager skip legal copyright disclaimer alert search form tags".split()
)
#: Parts that a class or id may have beside noise words and still be named for them (site-footer, left-nav).
NEUTRAL_NAMES = frozenset("site page main top bottom left right global primary secondary box block area wrap wrapper container section list item items bar links link inner outer content text js mobile desktop sticky fixed small big".split())
#: Noise branches are given back where less than this share of a page's text is outside them.
LEFT_OVER = 0.1


@dataclass
class Node:
    tag: str
    style: str
    noise: bool = False
    main: int = 0  # 2: article, 1: main
    path: int = 0
    children: list = field(default_factory=list)  # nodes and strings
    hard: bool = False


def _named_noise(names: str) -> bool:
    """Whether one of the classes or ids is named for noise as a whole: has a noise word, and no part that says otherwise."""
    for name in names.split():
        parts = [x for x in re.split(r"[^a-z0-9]+", name) if x]
        if any(x in NOISE_NAMES for x in parts) and all(x in NOISE_NAMES or x in NEUTRAL_NAMES or x.isdigit() for x in parts):
            return True
    return False


def _node(tag: str, attributes: str) -> Node:
    named: dict[str, str] = {}
    if attributes.strip():
        for k, v in ATTRIBUTE.findall(attributes):  # the first of a repeated attribute counts
            named.setdefault(k.lower(), v.strip("\"'").lower())
    names = f"{named.get('class', '')} {named.get('id', '')}"
    role = named.get("role", "")
    hidden = "hidden" in named or named.get("aria-hidden") == "true"
    noise = tag in NOISE_TAGS or role in NOISE_ROLES or hidden or _named_noise(names)
    main = 2 if tag == "article" or role == "article" else 1 if tag == "main" or role == "main" else 0
    return Node(tag, f"{tag}.{' '.join(sorted(names.split()))}" if names.strip() else tag, noise and tag not in ("html", "body"), main, hard=tag in HARD)


def tokens(text: str):
    """Text runs (as strings) and tags (end mark, name, attributes) of a page, in one pass that never goes back for more than
    one attribute's value.

    A value ends at the next quote of its kind, if blank, slash or the tag's end follow there; else its quote stands alone,
    and the tag ends at the next ">". A tag that never ends takes the rest of the page. Comments, declarations and CDATA are left out.
    """
    at, last = 0, text.rfind(">")
    while m := OPENING.search(text, at):
        if m.start() > at:
            yield text[at : m.start()]
        if m[1]:
            end = text.find(ENDS[m[1]], m.end())
            at = len(text) if end < 0 else end + len(ENDS[m[1]])
            continue
        begin = end = m.end()
        while end <= last and text[end] != ">":
            c = text[end]
            if c in "\"'" and text[end - 1] in "= \t\r\n\f":
                close = text.find(c, end + 1)
                if close < 0 or text[close + 1 : close + 2] not in AFTER_VALUE:
                    end = text.find(">", end)
                    break
                end = close
            end += 1
        if end < 0 or end > last:
            at = len(text)
            return
        at = end + 1
        jump = yield m[2], m[3].lower(), text[begin:end], at
        if jump is not None:
            at = jump
            yield ""
    if at < len(text):
        yield text[at:]


def parse(text: str | None) -> Node:
    root = Node("", "")
    stack, open_, text = [root], Counter(), text or ""

    def close(k: int) -> None:
        for n in stack[k:]:
            open_[n.tag] -= 1
        del stack[k:]

    scan = tokens(text)
    for token in scan:
        if isinstance(token, str):
            if token:
                stack[-1].children.append(entities.unescape(token))
            continue
        ending, tag, attributes, at = token
        if ending:
            if not open_[tag]:
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
                if tag in INLINE and stack[k].tag not in INLINE:
                    break  # an inline end tag closes no block
            continue
        if tag in CLOSES_P and open_["p"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag not in INLINE:
                    break
        if tag in SELF_CLOSING:
            ends, within = SELF_CLOSING[tag]
            if any(open_[x] for x in ends.split()):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in ends.split():
                        close(k)
                        break
                    if stack[k].tag in within:
                        break
        node = _node(tag, attributes)
        stack[-1].children.append(node)
        if tag in VOID or attributes.endswith("/") and tag in ("path", "circle", "rect"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|\Z", re.I).search(text, at)
            scan.send(end.end())
            continue
        stack.append(node)
        open_[tag] += 1
    _paths(root)
    _give_back(root)
    return root


def _give_back(root: Node) -> None:
    """Names and tags may take branches beside a page's text, never the text: where all marked articles (main elements,
    where there is none) lie in noise, the branches round the longest are no noise; where none is marked and next to nothing
    is left outside noise, those round the longest noise branch's text aren't."""
    order, todo = [], [(root, False, None)]
    parents: dict[int, Node] = {}
    while todo:  # parents before children
        n, inside, parent = todo.pop()
        if parent is not None:
            parents[id(n)] = parent
        order.append((n, inside))
        if n.hard:
            continue
        todo += [(c, inside or n.noise, n) for c in n.children if isinstance(c, Node)]
    size: dict[int, int] = {}
    free: dict[int, int] = {}  # characters outside noise
    for n, _ in reversed(order):
        kids = [c for c in n.children if isinstance(c, Node)]
        own = sum(len(x.strip()) for x in n.children if isinstance(x, str))
        size[id(n)] = 0 if n.hard else own + sum(size.get(id(c), 0) for c in kids)
        free[id(n)] = 0 if n.noise else own + sum(free.get(id(c), 0) for c in kids)
    marked = [(n, inside or n.noise) for n, inside in order if n.main]
    if marked:
        level = max(n.main for n, _ in marked)
        marked = [(n, hidden) for n, hidden in marked if n.main == level]
        if any(not hidden and size[id(n)] for n, hidden in marked):
            return
        kept = max((n for n, _ in marked), key=lambda n: size[id(n)])
    elif free[id(root)] < LEFT_OVER * size[id(root)]:
        outer = [n for n, inside in order if n.noise and not n.hard and not inside]
        if not outer:
            return
        kept = max(outer, key=lambda n: size[id(n)])
    else:
        return
    while kept is not None:
        kept.noise = kept.hard
        kept = parents.get(id(kept))


def _hash(*parts) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest("\x00".join(map(str, parts)).encode("utf-8", "replace"), 7)).astype(np.int64))


def _paths(root: Node) -> None:
    todo = [root]
    while todo:
        n = todo.pop()
        for c in n.children:
            if isinstance(c, Node):
                c.path = _hash(n.path, c.style)
                todo.append(c)


def _words(node: Node, low: frozenset = frozenset(), marks: bool = True) -> list[str]:
    """Text of a subtree in page order, with blanks between blocks, without removed branches and, with marks, named noise."""
    out: list[str] = []
    todo: list = [node]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
            continue
        if n.path in low or (n.noise if marks else n.tag in RAW):
            out.append(" ")
            continue
        block = n.tag not in INLINE
        todo += ([" "] if block else []) + n.children[::-1] + ([" "] if block else [])
    return out


def _clean(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def main_text(page: str | None, low: frozenset = frozenset(), marks: bool = True, linked: frozenset = frozenset()) -> str:
    """Text of a page without its unimportant branches: constant ones (low) anywhere, those that are so for their links (linked)
    outside a marked article, whose lists of links are its own."""
    root, low_outside = parse(page), low | linked
    for level in (2, 1) if marks else ():
        found, todo = [], [root]
        while todo:
            n = todo.pop()
            if n.noise or n.path in low_outside:
                continue
            if n.main == level:
                found.append(n)
                continue
            todo += [c for c in reversed(n.children) if isinstance(c, Node)]
        text = _clean([x for n in found for x in _words(n, low)])
        if text:
            return text
    return _clean(_words(root, low_outside, marks))


OWN = "#text"
LEAF = 0
#: Path of the root node, which every page has.
ROOT = 0


def style_nodes(page: str | None) -> list[tuple[int, int, int, int, int, int, int]]:
    """(path, parent, shape, content, share, words, linked) of the root and each block with text of a page, outside code, bottom up.

    shape is LEAF for leaves, else the hash of the child styles; content is a leaf's text as a hash, and of inner nodes the
    hash of their children's contents; share is STEPS over the number of the parent's children; words and linked count a leaf's
    words and those within links (0 for inner nodes).
    """
    root = parse(page)
    order, todo = [], [(root, None, False)]
    while todo:  # parents before children
        n, block, linked = todo.pop()
        if n.tag in RAW:
            continue
        own = n.tag not in INLINE and n.tag not in VOID and n.tag not in ("html", "body", "head")
        mine = {"path": n.path, "style": n.style, "parent": block, "pieces": [], "linked": 0, "kids": []} if own else block
        if own:
            order.append(mine)
        linked = linked or n.tag == "a"
        # inline elements and strings belong to the block around them
        for c in reversed(n.children):
            if isinstance(c, Node):
                todo.append((c, mine, linked))
        said = [c for c in n.children if isinstance(c, str)]
        mine["pieces"] += said
        if linked:
            mine["linked"] += sum(len(c.split()) for c in said)
    out = []
    for b in reversed(order):
        text = " ".join(" ".join(b["pieces"]).split())
        kids = b["kids"][::-1]
        if not kids and not text and b["parent"] is not None:
            continue
        count = (text.count(" ") + 1 if text else 0, b["linked"])
        if kids and text:
            kids.append((_hash(b["path"], OWN), OWN, _hash(text), LEAF, *count))
        content = _hash(*[k[2] for k in kids]) if kids else _hash(text)
        shape = _hash(*[k[1] for k in kids]) if kids else LEAF
        count = (0, 0) if kids else count
        out += [(path, b["path"], kind, c, STEPS // len(kids), words, linked) for path, _, c, kind, words, linked in kids]
        if b["parent"] is not None:
            b["parent"]["kids"].append((b["path"], b["style"], content, shape, *count))
        else:
            out.append((ROOT, ROOT, shape, content, 0, *count))
    return out


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))


NODES = T.StructType([T.StructField("host", T.StringType()), *(T.StructField(n, T.LongType(), False) for n in ("page", "path", "parent", "shape", "content", "n", "share", "words", "linked"))])


def nodes(pages: DataFrame) -> DataFrame:
    """(host, page digest, path, parent, shape, content, n, share, words, linked) of (host, html): n is how many equal nodes the
    page has; share, words and linked are the sums of theirs."""

    def run(batches):
        names = NODES.fieldNames()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                hosts, rows = [], []
                for host, page in zip(*(c.to_pylist() for c in batch.slice(k, 256).columns), strict=True):
                    some = style_nodes(page)
                    sums: dict[tuple, list[int]] = {}
                    for *node, share, words, linked in some:
                        held = sums.setdefault(tuple(node), [0, 0, 0, 0])
                        for at, more in enumerate((1, share, words, linked)):
                            held[at] += more
                    hosts += [host] * len(sums)
                    rows += [(some[-1][3], *x, *held) for x, held in sums.items()]
                cols = np.array(rows, np.int64).reshape(-1, 9).T
                yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), *(pa.array(np.ascontiguousarray(c)) for c in cols)], names=names)

    return pages.select("host", "html").mapInArrow(run, NODES)


def tree(pages: DataFrame, min_pages: int = MIN_PAGES, support: float = SUPPORT) -> DataFrame:
    """(host, path, parent, n, leaves, styles, shape, content, share, words, linked) of the nodes with enough pages, of (host, html).

    n: elements; leaves: those without children; styles, shape: number and relative entropy of presentation styles;
    content: relative entropy of the contents; share: sum of the parents' shares; words, linked: the leaves' words, and those
    within links. Copies of a page count once.
    """
    every = nodes(pages).groupBy("host", "path", "page", "shape", "content").agg(*[F.max(c).alias(c) for c in ("n", "share", "words", "linked")], F.min("parent").alias("parent"))
    seen = written(every)
    # one row a page and node, without contents: how many different pages have a node
    on = seen.groupBy("host", "path", "page").agg(F.count(F.lit(1)).alias("k")).groupBy("host", "path").agg(F.count(F.lit(1)).alias("pages"))
    whole = checkpoint(on.where(F.col("path") == ROOT).select("host", F.col("pages").alias("of")))
    enough = join_groups(on, whole, ["host"]).where((F.col("pages") >= min_pages) & (F.col("pages") >= F.col("of") * support)).select("host", "path")

    def entropy(kind: str, *more: Column) -> DataFrame:
        each = seen.groupBy("host", "path", kind).agg(*[F.sum(c).alias(c) for c in ("n", "share", "words", "linked")], F.min("parent").alias("parent"))
        sums = each.groupBy("host", "path").agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.log("n")).alias("nlogn"), *more)
        # -sum p log p over the largest possible, log(all)
        part = F.greatest(F.lit(0.0), F.log("all") - F.col("nlogn") / F.col("all")) / F.log("all")
        return sums.withColumn(f"e_{kind}", F.when(F.col("all") > 1, part).otherwise(1.0)).drop("nlogn")

    shape = entropy("shape", F.min("parent").alias("parent"), *[F.sum(c).alias(c) for c in ("share", "words", "linked")], F.count(F.lit(1)).alias("styles"), F.sum(F.when(F.col("shape") == LEAF, F.col("n")).otherwise(0)).alias("leaves"))
    both = enough.join(shape, ["host", "path"]).join(entropy("content").drop("all"), ["host", "path"])
    return both.select("host", "path", "parent", F.col("all").alias("n"), "leaves", "styles", F.col("e_shape").alias("shape"), F.col("e_content").alias("content"), "share", "words", "linked")


def importances(rows: list[dict], links: bool = True) -> dict[int, float]:
    """Importance of each node of one host's tree; rows as tree() gives them. links: leaves count less for linked words."""
    at = {r["path"]: r for r in rows}
    below: dict[int, list[int]] = {}
    for r in rows:
        if r["path"] != ROOT and r["parent"] in at:
            below.setdefault(r["parent"], []).append(r["path"])
    out: dict[int, float] = {}
    # nodes whose parent is too rare stand alone
    todo = [(p, False) for p, r in at.items() if p == ROOT or r["parent"] not in at]
    while todo:
        path, done = todo.pop()
        r = at[path]
        if not done:
            todo.append((path, True))
            todo += [(c, False) for c in below.get(path, ())]
            continue
        inner = r["n"] - r["leaves"]
        if not inner:
            out[path] = r["content"] * (1 - links * r["linked"] / max(1, r["words"]))
            continue
        # the children's mean importance over the node's styles; children too rare for the tree and leaves count 1
        known = [(at[c]["share"] / STEPS / r["n"], out[c]) for c in below.get(path, ())]
        mean = max(0.0, 1.0 - sum(w for w, _ in known)) + sum(w * x for w, x in known)
        keep = DECAY ** r["styles"]
        out[path] = (1 - keep) * r["shape"] + keep * min(1.0, mean)
    return out


def unimportant(pages: DataFrame, min_pages: int = MIN_PAGES, low: float = LOW, support: float = SUPPORT) -> DataFrame:
    """(host, path, importance, constant) of style nodes below the importance limit, of (host, html); constant ones are below it
    whatever they link to. A task holds one host's tree, whose size support bounds; pages don't meet in a task."""

    def one(pdf):
        import pandas as pd

        rows = pdf.to_dict("records")
        plain = importances(rows, links=False)
        got = [(p, x) for p, x in importances(rows).items() if x < low and p != ROOT]
        return pd.DataFrame({"host": pd.Series([pdf["host"].iloc[0]] * len(got), dtype=object), "path": pd.Series([p for p, _ in got], dtype="int64"), "importance": pd.Series([x for _, x in got], dtype="float64"), "constant": pd.Series([plain[p] < low for p, _ in got], dtype=bool)})

    return tree(pages, min_pages, support).groupBy("host").applyInPandas(one, "host string, path long, importance double, constant boolean")


def extract(pages: DataFrame, html: str = "html", url: str = "url", min_pages: int = MIN_PAGES, low: float = LOW, marks: bool = True) -> DataFrame:
    """Append text: the main text of each page. A column of that name is replaced, others are kept; all rows stay."""
    kept = [f for f in pages.schema.fields if f.name.lower() != "text"]
    at_host, at_low, at_linked = (fresh([f.name for f in kept], n) for n in ("_host", "_low", "_linked"))
    with_host = pages.select(*[quoted(f.name) for f in kept], host_of(quoted(url)).alias(at_host))
    found = unimportant(with_host.select(F.col(at_host).alias("host"), quoted(html).alias("html")), min_pages, low)
    drop = checkpoint(found.groupBy(F.col("host").alias(at_host)).agg(*[F.array_sort(F.collect_set(F.when(F.col("constant") == yes, F.col("path")))).alias(n) for n, yes in ((at_low, True), (at_linked, False))]))
    rows = join_groups(with_host, drop, [at_host], "left").select(*[quoted(f.name) for f in kept], at_low, at_linked)
    schema = T.StructType([*kept, T.StructField("text", T.StringType(), False)])
    at = [f.name for f in kept].index(html)

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                b = batch.slice(k, 256)
                gone = zip(*(b.column(b.num_columns - k).to_pylist() for k in (2, 1)), strict=True)
                out = [main_text(page, frozenset(low or ()), marks, frozenset(linked or ())) for page, (low, linked) in zip(b.column(at).to_pylist(), gone, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(out, pa.string())], names=schema.fieldNames())

    return numbered(rows).mapInArrow(run, schema)
