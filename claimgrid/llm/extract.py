"""Main text of web pages by equivalence-class template deduction.

Tokens are elements (by their path) and text runs (by path and content). The occurrence vector of
a token over the pages of its host is kept as one 64-bit sum of page hashes times counts, so
tokens with equal vectors, an equivalence class, are found by a plain grouped sum. Tokens as
frequent as the page itself form the outermost class. A text run whose vector equals that of its
element stands in every instance of it: it belongs to the template of the nested class. What is
left in the slots of the template is data; the innermost element of the outermost class that
holds most of it is the host's main slot, and slots inside it are judged by their data, too. Names
of elements and classes choose among slots that hold the same data, say which small slots are
aside, and decide alone only where a host has no template.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgrid.llm.common import BYTE_VALUE, prefix_hash, span_hash, stored

#: Pages of a host that must repeat a text before it can be template.
MIN_PAGES = 5
#: Share of a host's data that the main slot holds at least.
MAIN_SHARE = 0.8
#: What holds this share of the data is never aside.
CONTENT_SHARE = 0.5

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(script|style|noscript|template|textarea|title|svg|iframe|select)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([^\s\"'=<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?|\"[^\"]*\"|'[^']*'")
NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table "
    "tbody td tfoot th thead tr ul".split()
)
#: A start tag ends an open element of its own row, unless one of the second set lies between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
CONTAINERS = {"div", "article", "section", "td", "th", "li", "blockquote", "body", "main", "aside", "table", "form", "button", "figure", "dd", "header", "footer", "nav"}

#: Elements that never hold main text, and words in id, class or role that say the same.
ASIDE_TAGS = set("nav aside form footer button head input label fieldset menu dialog search object audio video canvas map".split())
ASIDE_WORDS = set(
    "nav navbar navigation menu menubar header masthead topbar footer foot sidebar aside side widget ad ads advert adverts "
    "advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent notice notices notification alert "
    "popup modal overlay comment comments disqus reply replies respond discussion related recommended recommendations share sharing social "
    "newsletter subscribe subscription signup login search breadcrumb breadcrumbs crumbs pagination pager copyright legal disclaimer "
    "skip toolbar contentinfo complementary tagcloud tags hidden print gdpr".split()
)
#: Words that also name parts of a text: inside the main text they need the template's word.
WEAK_WORDS = set(
    "header side banner notice notices alert reply replies respond discussion related recommended recommendations share sharing "
    "social search copyright legal disclaimer tags print skip widget overlay".split()
)
KEEP_INSIDE = {"html", "body", "article", "main"}
#: Bits of an element's kind: aside by its name, by a weak word, main by its name, fit for a slot.
STRONG, WEAK, MAIN, SLOT = 1, 2, 4, 8


def host_of(url: Column) -> Column:
    """Lower-cased host after the first ``://``; empty without one or for null."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Node:
    """An element: path name, parent, what its name says of it; ``aside`` comes with the whole page."""

    __slots__ = ("tag", "parent", "path", "kind", "hidden", "central", "aside")

    def __init__(self, tag: str, name: str, parent: Node | None, kind: int, hidden: bool):
        self.tag, self.parent, self.kind = tag, parent, kind
        self.path = (parent.path + ">" if parent else "") + name
        self.hidden = hidden or (parent is not None and parent.hidden)
        self.central = bool(kind & MAIN) or (parent is not None and parent.central)
        self.aside = False


def aside_kind(value: str) -> int:
    """STRONG or WEAK if one of the names consists of listed words only."""
    kind = 0
    for name in value.split():
        words = [w for w in re.split(r"[^a-z]+", name) if w]
        if words and ASIDE_WORDS.issuperset(words):
            kind |= WEAK if WEAK_WORDS.issuperset(words) else STRONG
    return kind


def _node(tag: str, attributes: str, parent: Node | None) -> Node:
    name, hidden = tag, False
    kind = STRONG if tag in ASIDE_TAGS or (tag == "header" and not (parent and parent.central)) else 0
    kind |= (MAIN if tag in ("article", "main") else 0) | (SLOT if tag in CONTAINERS else 0)
    if attributes:
        for key, *values in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), next((v for v in values if v), "").lower()
            if key in ("id", "class", "role"):
                if key == "role" and value == "main":
                    kind |= MAIN
                elif tag not in KEEP_INSIDE or any(w.startswith("comment") for w in value.split()):
                    kind |= aside_kind(value)
                name += f"[{key}={re.sub(r'[0-9]{2,}', '0', value)}]"
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and NO_DISPLAY.search(value)):
                hidden = True
    if tag in KEEP_INSIDE and kind & (STRONG | WEAK):
        kind &= ~MAIN
    return Node(tag, name, parent, kind, hidden)


def inner_chars(texts: list[tuple[Node | None, str, int]]) -> dict[int, int]:
    """Characters of text inside each element, by its id; hidden ones don't count."""
    chars: dict[int, int] = {}
    for node, run, _ in texts:
        n = len(squeezed(run))
        up = None if node is None or node.hidden else node
        while n and up is not None:
            chars[id(up)] = chars.get(id(up), 0) + n
            up = up.parent
    return chars


def mark_asides(nodes: list[Node], chars: dict[int, int], parts: set[int], content: set[int], deduced: bool) -> None:
    """Sets ``aside``: named so, and neither main text by the data of the host or page nor around it.

    ``parts`` are elements that the template confirms as aside, ``content`` those it knows to hold data.
    """
    total = sum(chars.get(id(n), 0) for n in nodes if n.parent is None)
    for n in nodes:
        said = n.kind & (STRONG | WEAK)
        token = _signed(_hash(n.path)) if said and (parts or content) else None
        if token in content or (said == WEAK and (deduced or n.central) and token not in parts):
            said = 0
        if said and chars.get(id(n), 0) >= MAIN_SHARE * total:
            said = 0
        n.aside = bool(said)
    own = {id(n): n.aside for n in nodes}

    def inherit() -> None:
        for n in nodes:
            n.aside = own[id(n)] or (n.parent is not None and n.parent.aside)

    inherit()
    mains = [n for n in nodes if n.kind & MAIN and chars.get(id(n), 0)]
    if mains and all(n.aside for n in mains):
        up = max(mains, key=lambda n: chars[id(n)])
        beside = sum(chars.get(id(n), 0) for n in nodes if own[id(n)] and not (n.parent is not None and n.parent.aside))
        # What is around the only main text isn't aside, unless there is more text outside of all asides.
        if chars[id(up)] >= total - beside:
            while up is not None:
                own[id(up)] = False
                up = up.parent
            inherit()


def runs(page: str) -> tuple[list[Node], list[tuple[Node | None, str, int]]]:
    """The elements of a page, and its text runs as (element, text, block number)."""
    stack: list[Node] = []
    nodes: list[Node] = []
    texts: list[tuple[Node | None, str, int]] = []
    block = 0

    def text(part: str) -> None:
        if part and (stack or part.strip()):
            texts.append((stack[-1] if stack else None, html.unescape(part) if "&" in part else part, block))

    at = 0
    for m in TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                texts.append((stack[-1] if stack else None, m[0][9:].removesuffix("]]>"), block))
            continue
        if m[2]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth].tag == tag:
                    if any(x.tag in BLOCK for x in stack[depth:]):
                        block += 1
                    del stack[depth:]
                    break
            else:
                block += tag in BLOCK
            continue
        if tag == "br":
            texts.append((stack[-1] if stack else None, " ", block))
        block += tag in BLOCK
        ends, scope = ENDS.get(tag, (None, None))
        if tag in BLOCK and ends is None:
            ends, scope = {"p"}, CONTAINERS
        if ends:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth].tag in ends:
                    del stack[depth:]
                    if tag != "tr":
                        break
                elif stack[depth].tag in scope:
                    break
        node = _node(tag, m[4], stack[-1] if stack else None)
        nodes.append(node)
        if tag not in VOID and not m[4].endswith("/"):
            stack.append(node)
    text(page[at:])
    return nodes, texts


def squeezed(text: str) -> str:
    return " ".join(text.split())


def _hash(text: str) -> int:
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = np.array([len(raw)])
    return int(span_hash(prefix_hash(BYTE_VALUE[raw]), np.array([0]), n)[0])


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


TOKENS = "host string, token long, parent long, path string, vector long, n long, chars long, kind int"


def _page_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch and host: tokens with the sum of page hash times count, the count, and the chars inside."""
    known: dict[str, int] = {}

    def hashed(path: str) -> int:
        if path not in known:
            if len(known) > 50_000:
                known.clear()
            known[path] = _signed(_hash(path))
        return known[path]

    for batch in batches:
        sums: dict[tuple[str, int], list] = {}

        def add(host: str, token: int, parent: int, path: str | None, page_hash: int, chars: int, kind: int = 0) -> None:
            row = sums.get((host, token))
            if row is None:
                sums[host, token] = [parent, path, page_hash, 1, chars, kind]
            else:
                row[2] += page_hash
                row[3] += 1
                row[4] += chars

        for host, key, page in zip(*(batch.column(c).to_pylist() for c in ("host", "page_hash", "html")), strict=True):
            nodes, texts = runs(page or "")
            add(host, 0, 0, "", key, 0)
            chars = inner_chars(texts)
            for node, run, _ in texts:
                run = squeezed(run)
                if not run or node is None:
                    continue
                add(host, _signed(_hash(node.path + "\0" + run)), hashed(node.path), None, key, 0 if node.hidden else len(run))
            for node in nodes:
                add(host, hashed(node.path), 0, node.path, key, chars.get(id(node), 0), node.kind)
        if sums:
            rows = [(h, t, p, path, _wrap(v), n, c, k) for (h, t), (p, path, v, n, c, k) in sums.items()]
            yield pa.RecordBatch.from_pandas(
                pd.DataFrame(rows, columns=["host", "token", "parent", "path", "vector", "n", "chars", "kind"]),
                schema=pa.schema([("host", pa.string()), ("token", pa.int64()), ("parent", pa.int64()), ("path", pa.string()), ("vector", pa.int64()), ("n", pa.int64()), ("chars", pa.int64()), ("kind", pa.int32())]),
                preserve_index=False,
            )


def _wrap(v: int) -> int:
    return ((v + (1 << 62)) & ((1 << 63) - 1)) - (1 << 62)


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, main_share: float = MAIN_SHARE) -> DataFrame:
    """(host, main, fixed): path of the main slot and the hashes of template texts, per host.

    Vectors are sums of 40-bit page hashes times counts, so they add up exactly in 63 bits.
    """
    tokens = stored(
        pages.mapInArrow(_page_tokens, TOKENS)
        .groupBy("host", "token", "parent")
        .agg(F.max("path").alias("path"), F.sum("vector").alias("vector"), F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.max("kind").alias("kind"))
        .where(f"token = 0 OR path IS NOT NULL OR n >= {min_pages}")
    )
    page = tokens.where("token = 0").select("host", F.col("vector").alias("__pages"), F.col("n").alias("__n"))
    elements = tokens.where("path IS NOT NULL AND token <> 0")
    # Nested classes: a text as often, page by page, as the element that holds it.
    inner = elements.select(
        "host", F.col("token").alias("parent"), F.col("path").alias("__in"), F.col("vector").alias("__of"), F.col("n").alias("__times")
    )
    constant = stored(
        tokens.where("path IS NULL")
        .join(inner, ["host", "parent"])
        .where(f"vector = __of AND n = __times AND n >= {min_pages}")
        .select("host", "token", "__in", "chars")
    )
    fixed = constant.groupBy("host").agg(F.collect_set("token").alias("fixed"))
    # Data of an element: its characters without those of constant texts in it or in elements below.
    names = F.split("__in", ">")
    above = F.transform(F.sequence(F.lit(1), F.size(names)), lambda k: F.array_join(F.slice(names, F.lit(1), k), ">"))
    spent = constant.select("host", F.explode(above).alias("path"), "chars").groupBy("host", "path").agg(F.sum("chars").alias("__spent"))
    judged = elements.join(page, "host").where(
        f"__n >= {min_pages} AND (vector = __pages OR (n >= {min_pages} AND kind & {STRONG | WEAK} <> 0))"
    )
    judged = stored(judged.join(spent, ["host", "path"], "left").withColumn("data", F.col("chars") - F.coalesce("__spent", F.lit(0))))
    # The outermost class: elements with the vector of the page itself.
    outer = judged.where("vector = __pages")
    most = stored(outer.groupBy("host").agg(F.max("data").alias("__most")).where("__most > 0"))
    # Of slots inside each other that hold the data, the innermost; one named as main text goes first.
    main = (
        outer.join(most, "host")
        .where((F.col("data") >= main_share * F.col("__most")) & (F.col("kind").bitwiseAND(SLOT) != 0))
        .groupBy("host")
        .agg(F.max_by("path", F.struct(F.col("kind").bitwiseAND(MAIN), F.length("path"), "path")).alias("main"))
    )
    named = judged.where(f"kind & {STRONG | WEAK} <> 0").join(most, "host").withColumn("__big", F.col("data") >= CONTENT_SHARE * F.col("__most"))
    sides = named.groupBy("host").agg(
        F.collect_set(F.when(~F.col("__big"), F.col("token"))).alias("parts"), F.collect_set(F.when(F.col("__big"), F.col("token"))).alias("content")
    )
    return stored(page.select("host").join(main, "host", "left").join(fixed, "host", "left").join(sides, "host", "left"))


def main_text(
    page: str, main: str | None, fixed: set[int], parts: set[int] = frozenset(), content: set[int] = frozenset()
) -> str:
    """Blocks of the main slot without template texts and parts aside, joined by two line feeds."""
    nodes, texts = runs(page)
    chars = inner_chars(texts)
    inside: dict[int, bool] = {}

    def within(node: Node) -> bool:
        if id(node) not in inside:
            inside[id(node)] = node.path == main or (node.parent is not None and within(node.parent))
        return inside[id(node)]

    by_slot = main is not None and any(n.path == main for n in nodes)
    mark_asides(nodes, chars, parts, content, by_slot)
    shown = [(node, run, block) for node, run, block in texts if (not by_slot if node is None else not node.hidden and (not by_slot or within(node)))]
    size = [len(squeezed(run)) for _, run, _ in shown]
    beside = [node is not None and node.aside for node, _, _ in shown]
    held = sum(n for n, out in zip(size, beside, strict=True) if not out)
    inner = [node is not None and node.central and not out for (node, _, _), out in zip(shown, beside, strict=True)]
    called = sum(n for n, at in zip(size, inner, strict=True) if at)
    # Names decide without a slot; inside one they do if they name most of its text.
    central = called > 0 and (not by_slot or called >= CONTENT_SHARE * held)
    narrow = [part for part, at, out in zip(shown, inner, beside, strict=True) if (at if central else not out)]
    for chosen, drop in ((narrow, fixed), (narrow, ()), (shown, ())):
        found: list[list] = []
        for node, run, block in chosen:
            if drop and node is not None and _signed(_hash(node.path + "\0" + squeezed(run))) in drop:
                continue
            if not found or found[-1][0] != block:
                found.append([block, []])
            found[-1][1].append(run)
        text = "\n\n".join(b for b in (squeezed("".join(part)) for _, part in found) if b)
        if text:
            return text
    return ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets: dict[str, list[set[int]]] = {}
    for batch in batches:
        out = []
        for host, page, main, *known in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "main", "fixed", "parts", "content")), strict=True):
            if host not in sets:
                if len(sets) > 1000:
                    sets.clear()
                sets[host] = [set(k or ()) for k in known]
            out.append(main_text(page, main, *sets[host]) if page else "")
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract_main_text(pages: DataFrame, min_pages: int = MIN_PAGES, main_share: float = MAIN_SHARE) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``.

    Null and empty pages give empty text. Pages with a null url, or one without a host, share one
    empty host. Hosts of fewer than ``min_pages`` pages, or without data in the slots that all pages
    share, have no main slot: element names and their id, class and role decide alone. In a slot
    they narrow the text only to an element named as main that holds most of it. Repeated rows weigh alike in every vector and change no class. A text is
    never dropped for being frequent: only if it fills every instance of its element.
    """
    rows = pages.select(
        "page_id",
        "url",
        host_of(F.col("url")).alias("host"),
        F.shiftrightunsigned(F.xxhash64("page_id", "url", "html"), 24).alias("page_hash"),
        "html",
    )
    found = templates(rows.select("host", "page_hash", "html"), min_pages, main_share)
    ids = f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars long"
    return rows.join(found, "host", "left").select("page_id", "url", "host", "html", "main", "fixed", "parts", "content").mapInArrow(_extract, ids)
