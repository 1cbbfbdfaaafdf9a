"""HTML extraction by wrapper induction.

Pages of one host share a template. A bounded sample of each host's distinct pages, of any length, is
parsed into DOM trees, and all are aligned with the first by simple tree matching (the largest top-down,
order-keeping matching of nodes with equal labels; neighbours of equal label count as one repeated node).
A slot is the place of aligned nodes. What stands there is compared: a text that nearly all sampled pages
have in a slot is template, and so is a slot in which nearly every text is one of several pages; the
other slots vary and hold the content. All that a reader sees is aligned, whatever its tag. That is the
host's wrapper, and it decides page by page:

* template texts and template slots go, within <article> and <main> too;
* <article> and <main> bound the content only where they hold most of the host's varying text;
* slots that vary are content, unless a tag or name tells adverts, reader comments, menus or the like, which
  vary as articles do. A name that may be wrong doesn't count if half of the host's varying text stands
  there, and a tag, or a name of nothing but furniture, if nearly all does.

Where a host has no wrapper, for want of distinct pages, tags and names decide alone, and a slot unknown to the wrapper
stays if it isn't mostly links. If names that may be wrong would leave nothing of a page, they are passed over. A link
within a sentence, and a page's first heading, are never left out for their names.

A host with a third of all pages costs no more to learn: its sample is picked on hashes of its pages,
and only picked pages are moved. Copies of a page count once, and near copies too, lest an article pass
for a template. Wrappers are sent to all tasks only if they are small in total, and joined by host, which
Spark splits where skewed, if not.

Nulls, empties, ties: a null or empty html gives an empty text; a null or odd url belongs to the host
""; unclosed and stray tags are read as browsers do, roughly; pages may be nested to any depth; repeated
rows give each their own row; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, temporary

SAMPLE = 12
LEAST_PAGES = 4
SHARES = 64
BROADCAST_BYTES = 16_000_000

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?/][^>]*+>|<[a-zA-Z][^>]*+>""", re.S)
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements without text for readers, and elements that hold menus, page headers and the like.
HARD = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "head", "button", "select", "svg", "canvas", "object", "noembed", "noframes", "xmp", "datalist", "audio", "video"}
SOFT = {"nav", "footer", "aside", "form", "menu", "dialog", "search"}
#: A start tag of the key ends an open element of these.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "thead": {"tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPE = {"ul", "ol", "dl", "table", "div", "article", "section", "body", "html", "main", "aside", "nav", "header", "footer", "form"}
#: Names that tell furniture, if they stand alone or with parts of furniture, and names that may be wrong.
SURE = set("ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promoted cookie cookies consent gdpr comment comments disqus replies respond share sharing social newsletter subscribe subscription signup login".split())
DOUBTFUL = set(
    "banner notice notices alert popup modal overlay sidebar side aside menu nav navbar navigation breadcrumb breadcrumbs footer masthead header topbar related recommended "
    "widget pagination pager skip toolbar copyright legal complementary contentinfo search".split()
)
PARTS = set(
    "box list section area block bar button buttons btn container wrapper wrap panel link links item items slot unit top bottom left right inner outer count form title head text label icon icons thread body content author meta date row group "
    "inline big small large page site reader user post".split()
)
#: A name that begins so tells of a state, or of a part of the article.
STATE, PART = {"has", "with", "without", "no", "is", "not", "js"}, {"article", "post", "entry", "story", "content", "headline", "title"}
ATTRIBUTE = re.compile(r"""\b(class|id|role|aria-hidden|hidden|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""", re.I)
SPACE = re.compile(r"\s+")


def name_kind(called: str, main: bool) -> int:
    """2: what is called so is furniture; 1: it may be; 0: nothing is known. A name with other words beside a known one
    (share-price-analysis) may be anything, and within an article it tells nothing."""
    found = 0
    for token in called.lower().split():
        parts = [x for x in re.split(r"[-_]+", token) if x and not x.isdigit()]
        if not parts or parts[0] in STATE:
            continue
        ends, plain = {parts[0], parts[-1]}, all(x in SURE or x in DOUBTFUL or x in PARTS for x in parts)
        if plain and ends & SURE:
            return 2
        if ends & (DOUBTFUL | SURE) and parts[0] not in PART and (plain or not main):
            found = 1
    return found


class Node:
    """key: a hash of the labels from the root down, the node's slot. level: what its tag or name says, as name_kind().
    doubt: the nearest node, itself or above, with a level. never: whether one of them has level 2; hard: whether one
    has no text for readers."""

    __slots__ = ("tag", "label", "key", "parent", "children", "never", "hard", "main", "link", "level", "doubt")

    def __init__(self, tag: str, label: str, parent: "Node | None", hard: bool, main: bool, link: bool, level: int):
        self.tag, self.label, self.parent, self.hard, self.main, self.link, self.level = tag, label, parent, hard, main, link, level
        self.key = xxhash.xxh3_64_intdigest(f"{parent.key if parent else 0}/{label}")
        self.children: list[Node] = []
        self.never = hard or level == 2 or (parent is not None and parent.never)
        self.doubt: Node | None = self if level else parent.doubt if parent else None


class Block:
    __slots__ = ("node", "never", "hard", "main", "doubt", "parts", "linked")

    def __init__(self, node: Node, top: Node):
        self.node, self.never, self.hard, self.main, self.doubt, self.parts, self.linked = node, top.never, top.hard, top.main, top.doubt, [], 0

    def words(self) -> str:
        return SPACE.sub(" ", "".join(self.parts)).strip()

    def doubts(self):
        """The nodes with a level over it, from the nearest up."""
        at = self.doubt
        while at is not None:
            yield at
            at = at.parent.doubt if at.parent else None


def parse(html: str | None) -> tuple[Node, list[Block]]:
    """The DOM tree and the text blocks in page order."""
    root = Node("", "", None, False, False, False, 0)
    stack, blocks = [root], []
    block: Block | None = None
    html = html or ""
    at, n = 0, len(html)

    def text(piece: str) -> None:
        nonlocal block
        if "&" in piece:
            piece = unescape(piece)
        top = stack[-1]
        if block is None:
            if not piece or piece.isspace():
                return
            k = len(stack) - 1
            while k and stack[k].tag not in BLOCK:
                k -= 1
            block = Block(stack[k], top)
            blocks.append(block)
        elif block.never != top.never:  # an inline advert or the like within a block
            if top.never or not piece.strip():
                return
            block = Block(block.node, top)
            blocks.append(block)
        block.parts.append(piece)
        if top.link:
            block.linked += len(piece)

    def close(k: int) -> None:
        nonlocal block
        if any(x.tag in BLOCK for x in stack[k:]):
            block = None
        del stack[k:]

    while at < n:
        m = TAG.search(html, at)
        if m is None:
            text(html[at:])
            break
        if m.start() > at:
            text(html[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        tag = name.lower()
        if m[1]:
            k = len(stack) - 1
            while k and stack[k].tag != tag:
                k -= 1
            if k:
                close(k)
            continue
        if tag == "br":
            if block is not None:
                block.parts.append(" ")
            continue
        if tag in BLOCK:
            block = None
            if tag != "html" and tag != "body":
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == "p":
                        close(k)
                        break
                    if stack[k].tag in SCOPE:
                        break
        if tag in ENDS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ENDS[tag]:
                    close(k)
                    break
                if stack[k].tag in SCOPE:
                    break
        attributes = {a.lower(): (v or "").strip("\"'") for a, v in ATTRIBUTE.findall(m[3])} if m[3] else {}
        top = stack[-1]
        called = " ".join(attributes[a] for a in ("class", "id", "role") if attributes.get(a))
        hidden = "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true"
        main = top.main or tag in ("article", "main") or attributes.get("role") == "main" or attributes.get("itemprop") == "articleBody"
        level = name_kind(called, main) if called and tag not in ("article", "main", "body", "html", "h1") else 0
        if tag == "a" and block is not None:
            level = 0  # a link within a sentence
        if tag in SOFT or (tag == "header" and not main):
            level = 2
        node = Node(tag, f"{tag}.{called.lower()}" if called else tag, top, top.hard or tag in HARD or hidden, main, top.link or tag == "a", level)
        top.children.append(node)
        if tag in VOID or m[3].rstrip().endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else n
            continue
        stack.append(node)
    return root, blocks


class Kind:
    """Neighbouring nodes of one label under one parent, as one repeated node."""

    __slots__ = ("label", "nodes", "children")

    def __init__(self, label: str, nodes: list[Node]):
        self.label, self.nodes, self.children = label, nodes, []


def repeated(root: Node) -> Kind:
    """The tree with neighbours of equal label as one node each; where still very many alternate, all of one label."""
    top = Kind("", [root])
    todo = [top]
    while todo:
        kind = todo.pop()
        below = [c for n in kind.nodes for c in n.children]
        runs: list[list[Node]] = []
        for c in below:
            if runs and runs[-1][0].label == c.label:
                runs[-1].append(c)
            else:
                runs.append([c])
        if len(runs) > 100:
            by_label: dict[str, list[Node]] = {}
            for c in below:
                by_label.setdefault(c.label, []).append(c)
            runs = list(by_label.values())
        kind.children = [Kind(r[0].label, r) for r in runs]
        todo += kind.children
    return top


def match(a: Kind, b: Kind) -> list[tuple[Kind, Kind]]:
    """Simple tree matching: the node pairs of the largest top-down, order-keeping matching of two trees."""
    pairs = [(a, b)]
    below: list[dict[tuple[int, int], int]] = []  # for each pair, the numbers of the pairs of its children
    for x, y in pairs:  # grows as it goes
        own = {}
        places = defaultdict(list)
        for j, c in enumerate(y.children):
            places[c.label].append(j)
        for i, c in enumerate(x.children):
            for j in places.get(c.label, ()):
                own[i, j] = len(pairs)
                pairs.append((c, y.children[j]))
        below.append(own)
    size = [1] * len(pairs)
    chosen: list[list[int]] = [[] for _ in pairs]
    for at in range(len(pairs) - 1, -1, -1):
        x, y = pairs[at]
        own, m, n = below[at], len(x.children), len(y.children)
        if not own:
            continue
        best = [[0] * (n + 1) for _ in range(m + 1)]
        for i in range(m):
            row, last = best[i + 1], best[i]
            for j in range(n):
                row[j + 1] = max(last[j + 1], row[j], last[j] + (size[own[i, j]] if (i, j) in own else 0))
        size[at] += best[m][n]
        i, j = m, n
        while i and j:
            pair = own.get((i - 1, j - 1))
            if pair is not None and best[i][j] == best[i - 1][j - 1] + size[pair]:
                i, j = i - 1, j - 1
                chosen[at].append(pair)
            elif best[i][j] == best[i - 1][j]:
                i -= 1
            else:
                j -= 1
    out, todo = [], [0]
    while todo:
        at = todo.pop()
        out.append(pairs[at])
        todo += chosen[at]
    return out


#: A text in so large a share of the sampled pages is template, as is a slot with so large a share of texts that several pages have.
SHARED = 0.8
#: What holds so large a share of a host's varying text is content, whatever its name (1) or its tag (2) says.
FREED = {1: 0.5, 2: 0.9}


def text_key(slot: int, words: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{slot}/{words}")


@dataclass
class Wrapper:
    """slots: those aligned; template: those of them that don't vary; texts: template texts by slot;
    free: slots whose tag or name the varying text in them belies; main: whether <article> and <main> do."""

    slots: set[int] = field(default_factory=set)
    template: set[int] = field(default_factory=set)
    texts: set[int] = field(default_factory=set)
    free: set[int] = field(default_factory=set)
    main: bool = True

    def dump(self) -> str:
        return json.dumps([sorted(self.slots), sorted(self.template), sorted(self.texts), sorted(self.free), self.main])

    @staticmethod
    def load(text: str | None) -> "Wrapper | None":
        if not text:
            return None
        *sets, main = json.loads(text)
        return Wrapper(*map(set, sets), main)


def learn(pages: list[str]) -> Wrapper | None:
    """The wrapper of a host's pages; None if fewer than LEAST_PAGES of them differ in most of their text."""
    parsed = []
    for html in pages:
        root, blocks = parse(html)
        found = [(b, w) for b in blocks if not b.hard and (w := b.words())]
        own = Counter({w: len(w) for b, w in found if not b.never})
        if all(sum((own & other).values()) <= 0.5 * max(1, min(own.total(), other.total())) for _, _, other in parsed):
            parsed.append((root, found, own))
    if len(parsed) < LEAST_PAGES:
        return None
    first = repeated(parsed[0][0])
    texts: dict[int, list[tuple[int, Block, str]]] = defaultdict(list)
    for i, (root, found, _) in enumerate(parsed):
        aligned = {id(n) for _, kind in match(first, repeated(root)) for n in kind.nodes}
        for b, w in found:
            if id(b.node) in aligned:
                texts[b.node.key].append((i, b, w))
    out = Wrapper(main=False)
    varying: list[tuple[Block, int]] = []
    for slot, found in texts.items():
        out.slots.add(slot)
        pages_of = Counter(w for _, w in {(i, w) for i, _, w in found})
        common = {w for w, n in pages_of.items() if n >= max(LEAST_PAGES, SHARED * len(parsed))}
        out.texts |= {text_key(slot, w) for w in common}
        if len({i for i, _, _ in found}) >= LEAST_PAGES and sum(pages_of[w] > 1 for _, _, w in found) >= SHARED * len(found):
            out.template.add(slot)
        else:
            varying += [(b, len(w)) for _, b, w in found if w not in common]
    total, doubtful = sum(n for _, n in varying), Counter()
    for b, n in varying:
        for at in b.doubts():
            doubtful[at.key, at.level] += n
    out.free = {slot for (slot, level), n in doubtful.items() if n > FREED[level] * total}
    kept = [(b, n) for b, n in varying if not _level(b, out)]
    out.main = 2 * sum(n for b, n in kept if b.main) >= sum(n for _, n in kept)
    return out


def _level(b: Block, wrapper: Wrapper | None) -> int:
    """What tags and names over the block say of it, but for those that the wrapper frees."""
    return max((at.level for at in b.doubts() if wrapper is None or at.key not in wrapper.free), default=0)


@lru_cache(maxsize=256)
def _wrapper(text: str | None) -> Wrapper | None:
    return Wrapper.load(text)


def main_text(html: str | None, wrapper: Wrapper | None = None) -> str:
    """The main text of a page, its blocks joined by newlines."""
    found = [(b, w, _level(b, wrapper)) for b in parse(html)[1] if not b.hard and (w := b.words())]
    for most in (0, 1):  # the second only if doubtful names leave nothing
        rows = [(b, w) for b, w, level in found if level <= most]
        if wrapper is not None:
            rows = [(b, w) for b, w in rows if b.node.key not in wrapper.template and text_key(b.node.key, w) not in wrapper.texts]
        bound = any(b.main for b, _ in rows) and (wrapper is None or wrapper.main)
        known = wrapper.slots if wrapper is not None else ()
        out = [w for b, w in rows if b.main or not bound and (b.node.key in known or 2 * b.linked <= len(w))]
        if out:
            return "\n".join(out)
    return ""


def host(url: str) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#:]*)", 1)), F.lit(""))


def induce(pages: DataFrame, sample: int = SAMPLE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """host, wrapper: a row per host, from at most `sample` of its distinct pages of any length."""
    full = pages.where(F.length("html") > 0).select(host("url").alias("host"), F.xxhash64("html").alias("order"), "html")
    narrow = materialize(full.select("host", "order").distinct(), "page-keys")
    # the first of each share of a host's pages, then of those: no task meets all pages of a host
    ranked = narrow.withColumn("share", F.pmod(F.col("order"), F.lit(SHARES)))
    for by in (["host", "share"], ["host"]):
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("order"))).where(F.col("rank") <= sample)
    picked = materialize(ranked.select("host", "order", "rank"), "picked-pages")
    size = picked.agg(F.sum(F.octet_length("host") + 48)).first()[0] or 0
    few = full.join(F.broadcast(picked) if size <= broadcast_bytes else picked.hint("merge"), ["host", "order"])
    few = few.groupBy("host", "order").agg(F.first("rank").alias("rank"), F.first("html").alias("html"))

    def run(pdf):
        import pandas as pd

        found = learn(pdf.sort_values("rank").html.tolist())
        return pd.DataFrame({"host": [pdf.host.iloc[0]], "wrapper": [found.dump() if found else None]})

    return few.select("host", "html", "rank").groupBy("host").applyInPandas(run, "host string, wrapper string").where("wrapper is not null")


RESULT = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame, sample: int = SAMPLE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, text, n_chars for each page (page_id, url, html)."""
    with temporary(pages.sparkSession):
        known = materialize(induce(pages, sample, broadcast_bytes), "wrappers", keep=True)
    size = known.agg(F.sum(F.length("wrapper") + F.length("host") + 64)).first()[0] or 0
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host("url").alias("host"))
    rows = rows.join(F.broadcast(known) if size <= broadcast_bytes else known, "host", "left")

    def run(batches):
        for batch in batches:
            texts = [main_text(html, _wrapper(w)) for html, w in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.select("page_id", "url", "html", "wrapper").mapInArrow(run, RESULT)
