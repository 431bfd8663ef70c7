"""Main text of web pages by union-free wrappers inferred for each host.

A page becomes a tree of its block elements, boilerplate elements (by element or by class,
id and role words) left out, with a leaf where a block has text. The distinct pages of a host
that have the same kind of content (an article, a main element, or neither; the latter told
apart by their outermost elements) are aligned one after another into a union-free regular
expression, the wrapper:

  where the children of two elements have the same labels they are aligned one by one; leaves
  with one text stay literals, leaves whose texts differ become text slots;
  else subtrees that are literally the same and occur once on both sides stay where they are,
  and between them equal neighbouring groups fold into repeats, a longest common subsequence
  of labels is aligned, and what only one side has becomes optional.

All pages take part; partial wrappers of salted groups are aligned in rounds, so that no host
is gathered whole. Then the wrapper tells content: the slots and literals under its articles or
main elements where it has them; else those of the deepest element around others with most of the
text in slots that is not in links, without the literals that LITERAL_PAGES distinct pages share,
unless they are most of the text (then the pages are copies of each other). A page is aligned
with its wrapper, and the blocks that come to lie on content are its text, in page order; a
block that the wrapper has no place for goes with the innermost element that has one. A page
without any such block is decided by a wrapper of its own.

Edge cases: null or empty html gives an empty text, as does a page of boilerplate only;
a null or odd url belongs to host ''; unclosed elements, comments, scripts and tags end
where HTML lets them or at the end of the page; pages of any length are read whole; elements
nested deeper than DEPTH count as parts of the one at that depth; more than WIDE children that
don't fold are told apart by label alone; repeated pages each give a row; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, table, tidy, written

#: Names of HTML elements by what they do to text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
DROPPED = frozenset("script style noscript template iframe svg math head title object select option button textarea form nav footer aside menu dialog audio video canvas fieldset label datalist applet embed noembed noframes xmp search".split())
CLOSES_P = BLOCKS - {"html", "body", "head", "title", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table div article section body html main aside nav blockquote".split())
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs comment comments commentlist disqus respond replies cookie cookies consent gdpr disclaimer footer footnav foot header masthead topbar topnav menu menus nav navbar navigation sidebar sidebars aside widget widgets newsletter subscribe subscription signup notice notices alert popup modal overlay promo promos promotion related recommended recommendations share sharing social sponsor sponsored sponsors toolbar pagination pager skip login search form complementary contentinfo tags".split()
)
GOOD_WORDS = frozenset("articlebody article-body post-body entry-content post-content article-content main-content".split())
#: Words that say of an element that boilerplate is beside it, and those whose header is the article's own.
BESIDE_WORDS = frozenset("has with without no layout".split())
OWN_HEADER = re.compile(r"^(?:article|entry|post|story|content)[-_]{1,2}(?:header|head)$")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LITERAL_PAGES = 3
DEPTH, WIDE, GROUP_TREES = 48, 200, 128
#: Hosts and bytes up to which the wrappers are broadcast.
BROADCAST_HOSTS, BROADCAST_BYTES = 20_000, 32 << 20

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)>?|[^<]++|<""", re.S)
_ATTR = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_SHUT = {tag: re.compile(rf"</{tag}[\s>/]", re.I) for tag in RAW}
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")
_NAME = re.compile(r"[^a-z0-9]+")


def boilerplate(word: str) -> bool:
    """Whether a class, id or role names boilerplate."""
    parts = _NAME.split(word)
    if OWN_HEADER.match(word) or BESIDE_WORDS.intersection(parts):
        return False
    return word in BAD_WORDS or any(p in BAD_WORDS for p in parts)


@lru_cache(maxsize=20_000)
def label(tag: str, attributes: str) -> tuple[str, bool]:
    """Label of an element and whether it is boilerplate or hidden by itself."""
    words: list[str] = []
    named: list[str] = []  # digits count as signs: sidebar-2, ad-728x90
    bad = tag in DROPPED
    for m in _ATTR.finditer(attributes):
        key, value = m.group(1).lower(), (m.group(2) or "").strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            bad = True
        elif key == "style":
            bad |= re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) is not None
        elif key != "hidden":
            plain = [w for w in value.split() if not any(c.isdigit() for c in w)]
            words += plain[:4] + [w for w in plain[4:] if w in GOOD_WORDS]
            named += [_DIGITS.sub("-", w).strip("-_") for w in value.split()]
    good = any(w in GOOD_WORDS for w in words)
    if tag not in ("html", "body", "article", "main") and not good:
        bad |= any(boilerplate(w) for w in named)
    return ".".join([tag, *(w.replace("/", "") for w in words)]), bad


class Open:
    """The open elements of a page."""

    def __init__(self) -> None:
        self.tags: list[str] = [""]
        self.nodes: list[list] = [["", "1", []]]
        self.dropped: list[bool] = [False]
        self.kinds: list[str] = [""]  # article, main or neither, of the element or one around it
        self.last: dict[str, list[int]] = {}
        self.scopes: list[int] = []

    def push(self, tag: str, node: list, dropped: bool, kind: str) -> None:
        if tag in SCOPE:
            self.scopes.append(len(self.tags))
        self.last.setdefault(tag, []).append(len(self.tags))
        for x, v in ((self.tags, tag), (self.nodes, node), (self.dropped, dropped), (self.kinds, kind)):
            x.append(v)

    def place(self, tag: str, scoped: bool) -> int:
        """Where the innermost open element of a tag is; 0 if there is none, or none within the scope."""
        at = self.last.get(tag)
        return at[-1] if at and not (scoped and self.scopes and self.scopes[-1] > at[-1]) else 0

    def cut(self, at: int) -> None:
        for tag in self.tags[at:]:
            self.last[tag].pop()
        while self.scopes and self.scopes[-1] >= at:
            self.scopes.pop()
        del self.tags[at:], self.nodes[at:], self.dropped[at:], self.kinds[at:]


def parse(page: str | None) -> tuple[list, list[tuple[str, int]], str]:
    """Children of the root, the (text, characters in links) of each block that isn't boilerplate, and the kind of content.

    Nodes are [label, occurrence, children]; leaves ['#', occurrence, [digest, pages, characters, characters in links, blocks]].
    """
    top = Open()
    blocks: list[tuple[str, int]] = []
    kinds: set[str] = set()
    run: list[str] = []
    linked, links = 0, 0

    def close() -> None:
        nonlocal linked
        if run:
            text = _SPACE.sub(" ", entities.unescape("".join(run))).strip()
            run.clear()
            if text and not top.dropped[-1]:
                inside = min(linked, len(text))
                digest = xxhash.xxh3_64_hexdigest(text)
                top.nodes[-1][2].append(["#", "1", [digest, 1, len(text), inside, [len(blocks)]]])
                blocks.append((text, inside))
                kinds.add(top.kinds[-1])
        linked = 0

    def end(tag: str, scoped: bool) -> None:
        if at := top.place(tag, scoped):
            close()
            top.cut(at)

    def begin(tag: str, attributes: str) -> None:
        close()
        name, bad = label(tag, attributes)
        kind = top.kinds[-1]
        if tag == "header" and not kind:
            bad = True
        if kind != "article":
            kind = "article" if tag == "article" or any(w in GOOD_WORDS for w in name.split(".")[1:]) else "main" if tag == "main" else kind
        dropped = top.dropped[-1] or bad
        if tag in VOID:
            return
        node = top.nodes[-1]
        if not dropped and len(top.tags) <= DEPTH:
            node = [name, "1", []]
            top.nodes[-1][2].append(node)
        top.push(tag, node, dropped, kind)

    at, size = 0, len(page or "")
    skipped = 0  # depth of dropped inline elements
    while at < size:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m.group(2) or m.group(5)
        if tag is None:
            piece = m.group()
            if piece[0] != "<" or piece == "<":
                if not skipped:
                    run.append(piece)
                    if links:
                        linked += len(piece)
            continue
        tag, closing = tag.lower(), bool(m.group(1) or m.group(4))
        attributes = m.group(3) or m.group(6) or ""
        if closing:
            if tag in BLOCKS:
                end(tag, tag == "p")
            elif tag == "a":
                links = 0
            elif tag in DROPPED and skipped:
                skipped -= 1
            continue
        if tag in RAW:
            shut = _SHUT[tag].search(page, at)
            at = shut.start() if shut else size
            if shut:
                at = page.find(">", at) + 1 or size
            continue
        if tag in BLOCKS:
            if tag in CLOSES_P:
                end("p", True)
            for other in ENDED_BY.get(tag, ()):
                end(other, True)
            begin(tag, attributes)
        elif tag == "br":
            run.append(" ")
        elif tag == "a":
            links = 1
        elif tag in DROPPED and tag not in VOID and not attributes.rstrip().endswith("/"):
            skipped += 1
    close()
    root = top.nodes[0][2]
    return root, blocks, "article" if "article" in kinds else "main" if "main" in kinds else f"plain {shape(root)}" if blocks else ""


def shape(nodes: list) -> str:
    """What the outermost elements of a page are: labels down to the third level below the root."""
    found, level = [], nodes
    for _ in range(3):
        found.append(sorted({n[0] for n in level if n[0] != "#"}))
        level = [c for n in level if n[0] != "#" for c in n[2]]
    return xxhash.xxh3_64_hexdigest(json.dumps(found))


# ------------------------------------------------------------------ wrappers
def repeat(occurrence: str) -> str:
    return "*" if occurrence in "?*" else "+"


def joint(a: str, b: str) -> str:
    many, none = a in "+*" or b in "+*", a in "?*" or b in "?*"
    return "*" if many and none else "+" if many else "?" if none else "1"


def optional(node: list) -> list:
    return [node[0], "*" if node[1] in "+*" else "?", *node[2:]]


def merge(a: list, b: list) -> list:
    """One node for both. A fourth member, if one has it, says whether it is content."""
    role = a[3:] or b[3:]
    if a[0] != "#":
        return [a[0], joint(a[1], b[1]), align(a[2], b[2]), *role]
    x, y = a[2], b[2]
    return ["#", joint(a[1], b[1]), [x[0] if x[0] == y[0] else None, x[1] + y[1], x[2] + y[2], x[3] + y[3], x[4] + y[4]], *role]


def fold(nodes: list) -> list:
    """Fold equal neighbouring groups of up to four nodes into repeats."""
    for k in (1, 2, 3, 4):
        out: list = []
        for node in nodes:
            out.append(node)
            while len(out) >= 2 * k and all(a[0] == b[0] for a, b in zip(out[-2 * k : -k], out[-k:], strict=True)):
                again = [merge(a, b) for a, b in zip(out[-2 * k : -k], out[-k:], strict=True)]
                del out[-2 * k :]
                out += [[n[0], repeat(n[1]), *n[2:]] for n in again]
        nodes = out
    if len(nodes) > WIDE:  # an order that can't be told
        by: dict[str, list] = {}
        for n in nodes:
            by[n[0]] = merge(by[n[0]], n) if n[0] in by else n
        nodes = [[n[0], "*", *n[2:]] for n in by.values()]
    return nodes


def said(node: list) -> str | None:
    """What stands for a subtree of literals; None if it has a slot or a repeat."""
    if node[1] != "1":
        return None
    if node[0] == "#":
        return node[2][0]
    parts = [said(c) for c in node[2]]
    return None if None in parts else f"<{node[0]} {' '.join(parts)}>" if len(parts) < 8 else xxhash.xxh3_64_hexdigest(f"<{node[0]} {' '.join(parts)}>")


def anchors(a: list, b: list) -> list[tuple[int, int]]:
    """Literal subtrees that occur once in both sequences, as many as keep their order."""
    places: list[dict[str, int]] = []
    for nodes in (a, b):
        seen: dict[str, int] = {}
        for i, n in enumerate(nodes):
            if (x := said(n)) is not None:
                seen[x] = -1 if x in seen else i
        places.append(seen)
    pairs = [(i, places[1][x]) for x, i in places[0].items() if i >= 0 and places[1].get(x, -1) >= 0]
    pairs.sort()
    ends: list[int] = []  # of a longest increasing subsequence by the second place
    at, before = [], []
    for _, j in pairs:
        k = bisect_left(ends, j)
        ends[k : k + 1] = [j]
        before.append(at[k - 1] if k else -1)
        at[k : k + 1] = [len(before) - 1]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def align(a: list, b: list) -> list:
    """Union-free expression for both sequences."""
    if [x[0] for x in a] == [x[0] for x in b]:
        return [merge(x, y) for x, y in zip(a, b, strict=True)]
    out: list = []
    i = j = 0
    for p, q in [*anchors(a, b), (len(a), len(b))]:
        out += between(fold(a[i:p]), fold(b[j:q]))
        if p < len(a):
            out.append(merge(a[p], b[q]))
        i, j = p + 1, q + 1
    return out


def between(a: list, b: list) -> list:
    """A longest common subsequence of labels is merged, the rest is optional."""
    n, m = len(a), len(b)
    if n == m and all(x[0] == y[0] for x, y in zip(a, b, strict=True)):
        return [merge(x, y) for x, y in zip(a, b, strict=True)]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][0] == b[j][0] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i][0] == b[j][0]:
            out.append(merge(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append(optional(a[i]))
            i += 1
        else:
            out.append(optional(b[j]))
            j += 1
    return fold(out)


def pattern(nodes: list) -> str:
    """The wrapper written as a regular expression over tags, literals (=) and text slots (#)."""
    out = []
    for name, occurrence, inner, *_ in nodes:
        body = ("#" if inner[0] is None else f"={inner[0]}") if name == "#" else f"<{name}>{pattern(inner)}</{name.split('.')[0]}>"
        out.append(body if occurrence == "1" else f"({body}){occurrence}")
    return "".join(out)


def bare(nodes: list, texts: bool) -> list:
    """The tree as it takes part in a wrapper: without its blocks and, where texts don't count, folded and without them."""
    out = [["#", n[1], [*n[2][:4], []] if texts else [None, 0, 0, 0, []]] if n[0] == "#" else [n[0], n[1], bare(n[2], texts)] for n in nodes]
    return out if texts else fold(out)


def leaves(nodes: list) -> Iterator[list]:
    for n in nodes:
        if n[0] == "#":
            yield n
        else:
            yield from leaves(n[2])


def first_tag(name: str) -> str:
    return name.split(".")[0]


def is_root(name: str, kind: str) -> bool:
    """Whether an element is where content of a kind is: an article or what a class names so, or a main element."""
    return first_tag(name) == kind or kind == "article" and any(w in GOOD_WORDS for w in name.split(".")[1:])


def decided(nodes: list, kind: str) -> list:
    """The wrapper with a fourth member in each node: 1 if it is, or is in, content."""
    if kind in ("article", "main"):

        def marked(nodes: list, inside: int) -> list:
            out = []
            for n in nodes:
                now = inside or int(is_root(n[0], kind))
                out.append([n[0], n[1], n[2] if n[0] == "#" else marked(n[2], now), now])
            return out

        return marked(nodes, 0)
    worth: dict[int, int] = {}

    def weigh(n: list) -> int:
        if n[0] == "#":
            digest, pages, chars, linked, _ = n[2]
            own = max(0, chars - 2 * linked)
            return own if digest is None or pages < LITERAL_PAGES else 0
        worth[id(n)] = sum(weigh(c) for c in n[2])
        return worth[id(n)]

    def everything(nodes: list) -> int:
        return sum(max(0, n[2][2] - 2 * n[2][3]) for n in leaves(nodes))

    whole = sum(weigh(n) for n in nodes)
    copies = everything(nodes) >= 2 * whole  # most of the text is literal: the pages are copies of each other
    if copies:

        def weigh_all(n: list) -> int:
            worth[id(n)] = max(0, n[2][2] - 2 * n[2][3]) if n[0] == "#" else sum(weigh_all(c) for c in n[2])
            return worth[id(n)]

        whole = sum(weigh_all(n) for n in nodes)
    best, level = None, nodes
    while level:  # down to the deepest element that has nearly all of it
        inner = [n for n in level if n[0] != "#" and worth[id(n)] >= 0.8 * whole and any(c[0] != "#" for c in n[2])]
        if not inner or not whole:
            break
        best = inner[0]
        level = best[2]

    def marked_plain(nodes: list, inside: int) -> list:
        out = []
        for n in nodes:
            now = inside or int(n is best)
            if n[0] == "#":
                template = n[2][0] is not None and n[2][1] >= LITERAL_PAGES and not copies
                out.append([n[0], n[1], n[2], int(now and not template)])
            else:
                heading = first_tag(n[0]) in HEADINGS and now
                out.append([n[0], n[1], marked_plain(n[2], now) if not heading else [[*c[:3], 1] if c[0] == "#" else c for c in marked_plain(n[2], now)], now])
        return out

    return marked_plain(nodes, int(best is None))


def content_blocks(page: list, wrapper: list, kind: str) -> list[int]:
    """The blocks of a page that come to lie on content of a wrapper."""
    made = align(wrapper, page if not kind.startswith(("article", "main")) else folded(page))
    out: list[int] = []
    level = [(n, 0) for n in made]
    while level:
        n, around = level.pop()
        role = n[3] if len(n) > 3 else around
        if n[0] == "#":
            if role:
                out += n[2][4]
        else:
            level += [(c, role) for c in n[2]]
    return sorted(out)


def folded(nodes: list) -> list:
    return fold([n if n[0] == "#" else [n[0], n[1], folded(n[2])] for n in nodes])


class Reader:
    """Extracts the text of pages; wrappers: the wrapper of each kind of a host, as JSON."""

    def __init__(self) -> None:
        self.wrapper = lru_cache(maxsize=64)(lambda found: {k: json.loads(w) for k, w in json.loads(found).items()} if found else {})
        self.known: dict[tuple[str, str], list[bool]] = {}

    def text(self, page: str | None, wrappers: str | None) -> str:
        root, blocks, kind = parse(page)
        if not blocks:
            return ""
        wrapper = self.wrapper(wrappers).get(kind)
        chosen: list[int] = []
        if wrapper is not None and kind in ("article", "main"):  # few trees, each aligned once
            tree = folded(root)
            mine = [n[2][4] for n in leaves(tree)]
            key = (wrappers, json.dumps(bare(tree, False)))
            if (roles := self.known.get(key)) is None:
                if len(self.known) >= 5000:
                    self.known.clear()
                for i, n in enumerate(leaves(tree)):
                    n[2][4] = [i]
                found = set(content_blocks(tree, wrapper, kind))
                roles = self.known[key] = [i in found for i in range(len(mine))]
            chosen = sorted(i for of, role in zip(mine, roles, strict=True) if role for i in of)
        elif wrapper is not None:
            chosen = content_blocks(root, wrapper, kind)
        if not chosen:
            tree = folded(root) if kind in ("article", "main") else root
            chosen = content_blocks(tree, decided(bare(tree, True), kind), kind)
        return "\n".join(blocks[i][0] for i in chosen)


# ------------------------------------------------------------------ Spark
def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def wrappers(pages: DataFrame) -> DataFrame:
    """host, kind, pattern (the wrapper as text) and wrapper (as JSON, content marked) of every host and kind of pages (url, html)."""
    lean(pages.sparkSession)
    named = pages.select(host(F.col("url")).alias("host"), "html")

    @tidy
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: set[tuple[str, str, str]] = set()
            for h, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                root, blocks, kind = parse(page)
                if blocks:
                    found.add((h, kind, json.dumps(bare(root, kind.startswith("plain")), separators=(",", ":"))))
            rows = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], names=["host", "kind", "tree"])

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        made = None
        for tree in sorted(rows["tree"], key=lambda t: (len(t), t)):  # the same wrapper whatever the order of the rows
            made = json.loads(tree) if made is None else align(made, json.loads(tree))
        return pd.DataFrame({"host": [key[0]], "kind": [key[1]], "tree": [json.dumps(made, separators=(",", ":"))]})

    shape = "host string, kind string, tree string"
    trees = written(named.mapInArrow(read, shape).distinct(), "trees")
    while True:  # rounds: each aligns about GROUP_TREES at most
        sizes = trees.groupBy("host", "kind").agg(F.count("*").alias("n"))
        most = sizes.agg(F.max("n")).first()[0] or 0
        if most <= 1:
            break
        salted = trees.join(sizes, ["host", "kind"]).withColumn("salt", F.pmod(F.xxhash64("tree"), F.ceil(F.col("n") / GROUP_TREES)))
        trees = written(salted.groupBy("host", "kind", "salt").applyInPandas(fit, shape), "wrapper-round")

    @tidy
    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [json.loads(t) for t in b.column(2).to_pylist()]
            marked = [json.dumps(decided(t, k), separators=(",", ":")) for t, k in zip(made, b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([pattern(t) for t in made], pa.string()), pa.array(marked, pa.string())], names=["host", "kind", "pattern", "wrapper"])

    return trees.mapInArrow(decide, "host string, kind string, pattern string, wrapper string")


def kinds(pages: DataFrame) -> DataFrame:
    """pages with the `kind` of their content."""

    @tidy
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [parse(page)[2] for page in b.column(b.schema.get_field_index("html")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], names=[*b.schema.names, "kind"])

    return pages.mapInArrow(read, ", ".join(f"{n} {t}" for n, t in pages.dtypes) + ", kind string")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of pages (page_id, url, html)."""
    fitted = written(wrappers(pages).select("host", "kind", "wrapper"), "wrappers")
    size = fitted.agg(F.count_distinct("host").alias("n"), F.sum(F.length("wrapper")).alias("bytes")).first()
    named = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    if size["n"] <= BROADCAST_HOSTS and (size["bytes"] or 0) <= BROADCAST_BYTES:
        by_host = fitted.groupBy("host").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("kind", "wrapper")))).alias("wrappers"))
        both = named.join(F.broadcast(by_host), "host", "left").select("page_id", "url", "html", "wrappers")
    else:  # a host may have any number of kinds: each page meets the wrapper of its own
        own = fitted.select("host", "kind", F.to_json(F.create_map("kind", "wrapper")).alias("wrappers"))
        both = kinds(named).join(own, ["host", "kind"], "left").select("page_id", "url", "html", "wrappers")

    @tidy
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for b in batches:
            texts = [reader.text(b.column(2)[i].as_py(), b.column(3)[i].as_py()) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return both.mapInArrow(over, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
