"""Main text of web pages by wrapper induction.

Induction. Pages of a host with different contents are parsed into DOM trees and aligned with one of them by simple tree matching. An aligned node
whose texts repeat from page to page is constant, one whose texts vary is a slot; the wrapper's container is the smallest element that
holds nine tenths of the text of slots that are paragraphs (of all slots, where there are none) and every title (h1) among them. Which texts at which place are template is counted over all pages of the host: those found in at least
a tenth (repeated) or a half (constant) of its different contents, and in ``least`` of them. A place where half of the texts come again on
other pages holds a pool of template texts. Copies of a page count once: contents are told apart by their longest blocks.

Extraction. The wrapper's container, where the page has it, else the whole page, is searched for the article elements that no menu, sidebar or list of
comments holds, else for a main element; without either the container itself is the main part, and on a page without a wrapper the smallest element
that holds nine tenths of the paragraphs' text and the titles. All blocks of the main part stay, in page order, but for

* template texts of the host of three words or more that are no headings: constant ones, repeated ones, and texts of pools outside paragraphs. A paragraph beside varying ones (under one parent) stays
  if it stands between two of them, however often it recurs, and wherever it stands if it is not constant;
* what sits in elements for menus, asides, footers, forms or buttons, or of a class, role or id that is exactly one of ``INNER``, inline or not: text around an inline one stays one block.

No tag decides more than where the main part is: with or without an article element the same texts of it are template.

Words within class names are hints for elements around the main part alone. A name that ends in a word for content is none; nor is one of an element that holds the title and a paragraph, or all paragraphs and
another hinted element; where hints would take everything, there are none. Sizes play no part.

A host that holds a third of all pages costs one task no more than another: the sample (``sample`` pages a host, a bound of the alignment alone) comes
from a rank that each task limits first, template counts are by place and text, and wrappers meet pages by broadcast while they are few
(``broadcast_bytes``), else by a join salted on the page's row.

Defined results: null html is an empty page (empty text); a page without a host, or of a host with fewer than ``least`` different contents, is
extracted without a wrapper; repeated rows are extracted each; an empty table stays empty; columns named text and n_template are replaced;
pages are taken whole, however long, deep or wide.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Memory, free_names, settled, share

# Tags by what the HTML standard makes of them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg object select noframes annotation annotation-xml".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body html td th tr tbody thead tfoot caption legend dd dt li summary".split())
#: A start tag of the key ends an open element of the value, up to a list, table or definition list that holds it.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th")}
HOLDS = frozenset("ul ol dl table menu article section div body".split())

#: Tags, and words of class, id or role, that mark what is no part of an article; names that do so within one; classes of comments.
OUTER_TAGS = frozenset("nav aside footer form dialog menu search button fieldset label input head".split())
OUTER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense banner sponsor sponsored promo promotion promoted nav navbar navigation menu submenu breadcrumb breadcrumbs masthead topbar footer sidebar aside rail related recommended recommendations teaser share sharing social cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login register paywall search comment comments commentlist disqus discussion reply replies respond reviews toolbar pagination pager copyright skip complementary contentinfo".split()
)
INNER = frozenset(
    "nav navbar menu responses replies reader-comments ad ads advert adverts advertisement adsbygoogle ad-container ad-slot banner-ad sponsored sidebar comments comment-list commentlist comments-area comments-section comment-section comment-form comment-respond disqus_thread related-posts related-articles newsletter newsletter-signup share-buttons social-share social-links sharing breadcrumb breadcrumbs pagination cookie-banner cookie-notice cookie-consent cookie-bar gdpr-notice navigation complementary contentinfo".split()
)
#: Words that end a name of content, and words that say nothing at a name's end.
CONTENT_WORDS = frozenset("article story entry post prose longread".split())
GENERIC = frozenset("area list wrapper wrap inner outer container box section block content body main item items group row col column left right top bottom".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 dt th caption legend summary".split())
PARAGRAPHS = frozenset("p pre blockquote li h1 h2 h3 td dd".split())
PROSE = frozenset("p pre blockquote".split())
_TAG = re.compile(r"<(?:!--(.*?)(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|[!?/][^>]*(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/>]|$)""", re.I)
_NAME = re.compile(r"[a-z0-9]+")
_NUMBER = re.compile("[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Page:
    """A parsed page: elements in order (tag, label, names and words of attributes, place as a hash of the labels from the root, parent),
    and blocks of text (element, text)."""

    __slots__ = ("blocks", "label", "names", "parent", "place", "tag", "words")

    def __init__(self, source: str) -> None:
        self.tag, self.label, self.names, self.words, self.parent, self.place = ["html"], ["html"], [frozenset()], [frozenset()], [-1], [0]
        self.blocks: list[tuple[int, str]] = []
        self._parse(source)

    def _parse(self, source: str) -> None:
        # Text is gathered for the innermost element that parts it from what is around: the block at hand, or an inline element that has to go.
        stack, gathered, at, end = [0], [(0, [])], 0, len(source)
        tags, find = self.tag, _TAG.search

        def flush() -> None:
            text = gathered[-1][1]
            if text:
                whole = " ".join("".join(text).split())
                text.clear()
                if whole:
                    self.blocks.append((stack[-1], whole))

        def end_at(depth: int, block: bool) -> None:
            """The elements from ``depth`` on the stack end; ``block``: so does the block at hand."""
            ending = set(stack[depth:])
            while gathered[-1][0] in ending:
                flush()
                del stack[stack.index(gathered.pop()[0]) :]
            if block:
                flush()
            del stack[depth:]

        while at < end:
            m = find(source, at)
            stop = m.start() if m else end
            if stop > at:
                piece = source[at:stop]
                gathered[-1][1].append(entities.unescape(piece) if "&" in piece else piece)
            if not m:
                break
            at = m.end()
            name = m.group(3)
            if not name:
                continue
            name = name.lower()
            if m.group(2):
                if name in VOID:
                    continue
                depth = next((i for i in range(len(stack) - 1, 0, -1) if tags[stack[i]] == name), 0)
                if depth:
                    end_at(depth, name in BLOCK or any(tags[x] in BLOCK for x in stack[depth:]))
                continue
            if name in RAW:
                if name in ("svg", "math") and m.group(4).endswith("/"):
                    continue
                close = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(source, at)
                at = close.end() if close else end
                continue
            if name == "br":
                gathered[-1][1].append(" ")
                continue
            if name in BLOCK:
                flush()
                if "head" in (tags[x] for x in stack[:3]):  # nothing of a head is a block
                    end_at(next(i for i, x in enumerate(stack) if tags[x] == "head"), True)
                if name in CLOSES_P:
                    p = next((i for i in range(len(stack) - 1, 0, -1) if tags[stack[i]] in ("p", "button")), 0)
                    if p and tags[stack[p]] == "p" and not any(tags[x] in ("table", "ul", "ol", "dl") for x in stack[p:]):
                        end_at(p, True)
                if name in ENDS:
                    for i in range(len(stack) - 1, 0, -1):
                        if i >= len(stack):
                            continue
                        if tags[stack[i]] in ENDS[name]:
                            end_at(i, True)
                        elif tags[stack[i]] in HOLDS:
                            break
            if name in VOID:
                continue
            if name in ("html", "body") and name in (tags[x] for x in stack):
                continue
            names, words, label = frozenset(), frozenset(), name
            if (attributes := m.group(4)) and "=" in attributes:
                found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
                if found:
                    kind = found.get("class", "")
                    label = f"{name}.{_NUMBER.sub('0', kind)}" if kind else name
                    names = frozenset(" ".join(found.get(k, "") for k in ("class", "id", "role")).lower().split()) | {f"role={found.get('role', '').lower()}"}
                    named = " ".join(found.get(k, "") for k in ("class", "id", "role", "itemprop"))
                    words = frozenset(_NAME.findall(_CAMEL.sub(" ", named.replace("articleBody", "articlebody")).lower()))
                    if found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
                        words, names = words | {"popup"}, names | {"ad"}
            if name in BLOCK or name in OUTER_TAGS or words:
                self.place.append(xxhash.xxh3_64_intdigest(f"{self.place[stack[-1]]}/{label}"))
                self.tag.append(name)
                self.label.append(label)
                self.names.append(names)
                self.words.append(words)
                self.parent.append(stack[-1])
                stack.append(len(self.tag) - 1)
                if name not in BLOCK and (name in OUTER_TAGS or names & INNER):
                    gathered.append((stack[-1], []))
        end_at(1, True)

    def key(self, node: int, text: str) -> int:
        """A text at its place, as a signed number."""
        return xxhash.xxh3_64_intdigest(f"{self.place[node]}\t{text}") - (1 << 63)

    def signature(self) -> int:
        """The content of a page: its longest blocks."""
        longest = sorted((t for _, t in self.blocks), key=lambda t: (-len(t), t))[:3]
        return xxhash.xxh3_64_intdigest("\n".join(longest)) - (1 << 63)

    def sizes(self, of: Iterator[tuple[int, int]]) -> list[int]:
        """Sums over subtrees."""
        out = [0] * len(self.tag)
        for node, n in of:
            out[node] += n
        for x in range(len(out) - 1, 0, -1):
            out[self.parent[x]] += out[x]
        return out

    def around(self) -> list[bool]:
        """For each element whether it, or one that holds it, is told to be around the main part."""
        n, outer = len(self.tag), [False] * len(self.tag)
        for x in range(1, n):
            outer[x] = outer[self.parent[x]] or self.tag[x] in OUTER_TAGS or bool(self.tag[x] == "article" and self.words[x] & COMMENT_WORDS)
        mains = self.sizes((x, 1) for x in range(n) if is_main(self, x))
        titles = self.sizes((x, 1) for x, _ in self.blocks if self.tag[x] == "h1" and not outer[x])
        prose = self.sizes((x, 1) for x, _ in self.blocks if self.tag[x] in PROSE and not outer[x])
        hinted = [x for x in range(1, n) if self.tag[x] not in ("html", "body", "article", "main", "p") and self.tag[x] not in HEADINGS and not mains[x] and self.hinted(x)]
        inner = self.sizes((x, 1) for x in hinted)
        hints = {x for x in hinted if not (titles[x] and prose[x]) and not (prose[x] and prose[x] == prose[0] and inner[x] > 1)}

        def spread(hints: set[int]) -> list[bool]:
            out = list(outer)
            for x in range(1, n):
                out[x] = out[x] or x in hints or out[self.parent[x]]
            return out

        out = spread(hints)
        left = any(not out[x] for x, _ in self.blocks)
        return out if left or not hints else outer

    def hinted(self, x: int) -> bool:
        """Whether a name of the element has a word for what is around an article, and is no name of content by its last word."""
        if not self.words[x] & OUTER_WORDS:
            return False
        for name in self.names[x]:
            parts = _NAME.findall(name)
            if OUTER_WORDS.intersection(parts):
                while len(parts) > 1 and parts[-1] in GENERIC:
                    parts.pop()
                if parts[-1] in CONTENT_WORDS:
                    return False
        return True

    def smallest(self, size: list[int], titles: list[int], least: float = 0.9) -> int:
        """The smallest element, no paragraph or heading itself, with that share of the sizes and all of the titles."""
        children: dict[int, list[int]] = defaultdict(list)
        held = self.sizes((x, 1) for x in titles)
        for x in range(1, len(self.tag)):
            if size[x] >= least * size[0] > 0 and held[x] == len(titles) and self.tag[x] not in PARAGRAPHS and self.tag[x] not in HEADINGS:
                children[self.parent[x]].append(x)
        x = 0
        while children.get(x):
            x = children[x][0]
        return x


def is_main(page: Page, x: int) -> bool:
    return page.tag[x] == "main" or "articlebody" in page.words[x] or "role=main" in page.names[x]


def main_roots(page: Page, container: int | None, template: list[bool]) -> tuple[list[int], bool]:
    """The elements that hold the main part, and whether markup tells so."""
    around = page.around()
    size = page.sizes((x, len(t)) for (x, t), known in zip(page.blocks, template, strict=True) if not around[x] and not known)
    found = [x for x in range(1, len(page.tag)) if container is not None and page.place[x] == container and size[x]]
    # Of several elements at the container's place those that hold paragraphs count, by their length.
    told = page.sizes((x, len(t)) for (x, t), known in zip(page.blocks, template, strict=True) if page.tag[x] in PROSE and not around[x] and not known)
    told = told if any(told[x] for x in found) else size
    most = max((told[x] for x in found), default=0)
    found = [x for x in found if told[x] and 5 * told[x] >= most]
    # What encloses a container and is told to be the main part is the main part.
    for i, x in enumerate(found):
        up = x
        while up > 0:
            if (page.tag[up] == "article" or is_main(page, up)) and not around[up]:
                found[i] = up
            up = page.parent[up]
    inside = [not found] * len(page.tag)
    for x in range(len(page.tag)):
        inside[x] = inside[x] or x in found or (x > 0 and inside[page.parent[x]])
    for kind in (lambda x: page.tag[x] == "article", lambda x: is_main(page, x)):
        held, fit = [False] * len(page.tag), []
        for x in range(1, len(page.tag)):
            held[x] = held[page.parent[x]]
            if inside[x] and kind(x) and not around[x] and size[x]:
                if not held[x]:
                    fit.append(x)
                held[x] = True
        if fit:
            return fit, True
    if found:
        return sorted(set(found)), False
    paragraphs = page.sizes((x, len(t)) for x, t in page.blocks if not around[x] and page.tag[x] in PARAGRAPHS)
    titles = [x for x, _ in page.blocks if page.tag[x] == "h1" and not around[x]]
    return [page.smallest(paragraphs if paragraphs[0] else size, titles)], False


def main_blocks(page: Page, wrapper: dict | None = None) -> tuple[list[str], int]:
    """The texts of the main part's blocks, and how many of its blocks went as template of the host."""
    wrapper = wrapper or {}
    constant, repeated, pools = (wrapper.get(k, frozenset()) for k in ("constant", "repeated", "pools"))
    prose = lambda x: page.tag[x] in PARAGRAPHS or page.tag[x] in HEADINGS
    keys = [page.key(x, t) if constant or repeated else 0 for x, t in page.blocks]
    template = [k in constant or k in repeated or (page.place[x] in pools and not prose(x)) for k, (x, _) in zip(keys, page.blocks, strict=True)]
    roots, marked = main_roots(page, wrapper.get("container"), template)
    state = [0] * len(page.tag)  # 1: in the main part
    for x in roots:
        state[x] = 1
    around = None if marked else page.around()
    for x in range(1, len(page.tag)):
        if not state[x] and state[page.parent[x]]:
            out = page.tag[x] in OUTER_TAGS or (page.tag[x] not in HEADINGS and page.names[x] & INNER) or (page.tag[x] == "article" and page.words[x] & COMMENT_WORDS)
            state[x] = int(not out and not (around and around[x]))
    # Where the varying texts under one parent begin and end.
    span: dict[int, list[int]] = {}
    for i, ((x, _), known) in enumerate(zip(page.blocks, template, strict=True)):
        if state[x] and not known and prose(x):
            span.setdefault(page.parent[x], [i, i])[1] = i
    keep, gone = [], 0
    for i, ((x, text), key, known) in enumerate(zip(page.blocks, keys, template, strict=True)):
        if not state[x]:
            continue
        beside = span.get(page.parent[x]) if prose(x) else None
        stays = beside and (beside[0] < i < beside[1] or key not in constant)
        if known and not stays and page.tag[x] not in HEADINGS and text.count(" ") >= 2:
            gone += 1
        else:
            keep.append(text)
    return keep, gone


# ---- induction ----

#: Pages of a host that are aligned; two lists of children of a larger product, and those at a greater depth, are matched in one pass.
SAMPLE, PRODUCT, DEPTH = 12, 20_000, 80
#: Parts of a host's contents that are ranked apart; sampled pages whose keys are broadcast (some 60 bytes each), more are joined.
PARTS, MOST_CHOSEN = 64, 200_000
#: Shares of a host's contents at which a text at its place is repeated, and constant.
REPEATED, CONSTANT = 0.1, 0.5


def in_order(labels: list[str], others: list[str]) -> list[tuple[int, int]]:
    """The k-th of a label with the other's k-th of it."""
    at: dict[str, list[int]] = defaultdict(list)
    for j, label in enumerate(others):
        at[label].append(j)
    seen: Counter[str] = Counter()
    out = []
    for i, label in enumerate(labels):
        if seen[label] < len(at[label]):
            out.append((i, at[label][seen[label]]))
        seen[label] += 1
    return out


def tree_match(a: Page, b: Page) -> list[tuple[int, int]]:
    """Matched elements of two pages by simple tree matching (the largest order- and parent-preserving matching of equal labels)."""

    def kids(page: Page) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in page.tag]
        for x in range(1, len(page.tag)):
            out[page.parent[x]].append(x)
        return out

    kids_a, kids_b = kids(a), kids(b)
    memory: dict[tuple[int, int], tuple[int, list]] = {}

    def match(x: int, y: int, depth: int) -> int:
        if (x, y) in memory:
            return memory[x, y][0]
        if a.label[x] != b.label[y]:
            return 0
        p, q = kids_a[x], kids_b[y]
        if depth > DEPTH or len(p) * len(q) > PRODUCT:
            pairs = [(p[i], q[j]) for i, j in in_order([a.label[u] for u in p], [b.label[v] for v in q])]
            total = sum(match(u, v, depth + 1) if depth <= DEPTH else 1 for u, v in pairs)
            memory[x, y] = (total + 1, pairs)
            return total + 1
        best = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
        for i, u in enumerate(p):
            for j, v in enumerate(q):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + match(u, v, depth + 1))
        pairs, i, j = [], len(p), len(q)
        while i and j:
            w = match(p[i - 1], q[j - 1], depth + 1)
            if w and best[i][j] == best[i - 1][j - 1] + w:
                pairs.append((p[i - 1], q[j - 1]))
                i, j = i - 1, j - 1
            elif best[i][j] == best[i - 1][j]:
                i -= 1
            else:
                j -= 1
        memory[x, y] = (best[-1][-1] + 1, pairs)
        return best[-1][-1] + 1

    match(0, 0, 0)
    out, todo = [], [(0, 0)]
    while todo:
        x, y = todo.pop()
        out.append((x, y))
        if (x, y) not in memory:  # below the depth that is aligned by counts
            memory[x, y] = (0, [(kids_a[x][i], kids_b[y][j]) for i, j in in_order([a.label[u] for u in kids_a[x]], [b.label[v] for v in kids_b[y]])])
        todo += memory[x, y][1]
    return out


def induce(sources: list[str], least: int = 4) -> dict:
    """What pages of one host tell by alignment: the container of the slots, and how many nodes are constant and how many slots."""
    pages = [Page(s) for s in dict.fromkeys(sources)]
    if len(pages) < least:
        return {"container": None, "constants": 0, "slots": 0}
    pages.sort(key=lambda p: len(p.tag))
    base = pages[len(pages) // 2]

    def texts(page: Page) -> dict[int, str]:
        out: dict[int, str] = {}
        for x, t in page.blocks:
            out[x] = f"{out[x]}\n{t}" if x in out else t
        return out

    own = texts(base)
    values: dict[int, Counter[str]] = {x: Counter([t]) for x, t in own.items()}
    for other in pages:
        if other is not base:
            theirs = texts(other)
            for x, y in tree_match(base, other):
                if x in own and y in theirs:
                    values[x][theirs[y]] += 1
    # A slot's texts vary: most of them are there once.
    slots = {x for x, of in values.items() if 2 * sum(n for n in of.values() if n == 1) > of.total()}
    around = base.around()
    prose = [x for x in slots if base.tag[x] in PROSE and not around[x]]
    size = base.sizes((x, len(own[x])) for x in prose or slots if not around[x])
    held = base.smallest(size, [x for x in slots if base.tag[x] == "h1" and not around[x]]) if size[0] else 0
    return {"container": base.place[held] if held else None, "constants": len(own) - len(slots), "slots": len(slots)}


def extract(source: str | None, wrapper: dict | None = None) -> str:
    """The main text of one page."""
    return "\n\n".join(main_blocks(Page(source), wrapper)[0]) if source else ""


def host_of(url: str):  # noqa: ANN201
    return F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each page its host, hash, content and texts at their places."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            pages = [Page(s) for s in part.column(2).to_pylist()]
            keys = [[{"key": k, "place": str(y)} for k, y in {(p.key(x, t), p.place[x]) for x, t in p.blocks}] for p in pages]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([p.signature() for p in pages], pa.int64()), pa.array(keys, pa.list_(pa.struct([("key", pa.int64()), ("place", pa.string())])))], names=["host", "hash", "content", "keys"])


def wrappers(pages: DataFrame, url: str = "url", html: str = "html", sample: int = SAMPLE, least: int = 4) -> DataFrame:
    """(host, wrapper as JSON) of each host with enough different contents: container, constants, slots (of the alignment); constant and
    repeated (texts at their places) and pools (places of changing template texts), counted over all pages."""
    own = pages.where(F.col(html).isNotNull() & (F.col(html) != "")).select(host_of(url).alias("host"), F.col(html).alias("html")).where("host <> ''")
    own = own.select("host", F.xxhash64("html").alias("hash"), "html")
    evidence = settled(own.mapInArrow(_evidence, "host string, hash long, content long, keys array<struct<key:long,place:string>>"))
    contents = evidence.groupBy("host", "content").agg(F.min("hash").alias("hash"))
    of_host = contents.groupBy("host").agg(F.count("*").alias("contents")).where(F.col("contents") >= least)

    # The smallest contents of a host: of each of its parts first, so that no task ranks more than a part of a host and ``sample`` rows a part.
    part = F.pmod("content", F.lit(PARTS))
    of_part = contents.withColumn("part", part).withColumn("place", F.row_number().over(W.partitionBy("host", "part").orderBy("content"))).where(F.col("place") <= sample)
    chosen = settled(of_part.withColumn("place", F.row_number().over(W.partitionBy("host").orderBy("content"))).where(F.col("place") <= sample).select("host", "hash", "place"))
    few = own.join(F.broadcast(chosen) if chosen.count() <= MOST_CHOSEN else chosen, ["host", "hash"]).groupBy("host", "place").agg(F.first("html").alias("html"))

    def learn(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [key[0]], "aligned": [json.dumps(induce(rows.sort_values("place")["html"].tolist(), least))]})

    aligned = few.groupBy("host").applyInPandas(learn, "host string, aligned string")
    found = evidence.select("host", "content", F.explode("keys").alias("k")).select("host", "content", "k.*").distinct().groupBy("host", "place", "key").agg(F.count("*").alias("n"))
    found = settled(found.join(of_host, "host"))
    texts = found.where((F.col("n") >= least) & (F.col("n") >= F.col("contents") * REPEATED))
    is_constant = F.col("n") >= F.col("contents") * CONSTANT
    template = texts.groupBy("host").agg(F.collect_list(F.when(is_constant, F.col("key"))).alias("constant"), F.collect_list(F.when(~is_constant, F.col("key"))).alias("repeated"))
    again = F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0))
    pools = found.groupBy("host", "place").agg((again / F.sum("n")).alias("again"), F.sum("n").alias("met"), F.first("contents").alias("contents"))
    pools = pools.where((F.col("again") >= CONSTANT) & (F.col("met") >= least) & (F.col("met") >= F.col("contents") * REPEATED)).groupBy("host").agg(F.collect_list("place").alias("pools"))
    both = of_host.join(aligned, "host").join(template, "host", "left").join(pools, "host", "left")
    held = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    return both.select("host", F.to_json(F.struct("aligned", held("constant", "bigint"), held("repeated", "bigint"), held("pools", "string"))).alias("wrapper"))


def read_wrapper(raw: str | None) -> dict:
    if raw is None:
        return {}
    found = json.loads(raw)
    return json.loads(found["aligned"]) | {k: frozenset(found[k]) for k in ("constant", "repeated")} | {"pools": frozenset(map(int, found["pools"]))}


def extract_pages(pages: DataFrame, url: str = "url", html: str = "html", broadcast_bytes: int = 16_000_000, salts: int = 64) -> DataFrame:
    """All columns of ``pages`` but the html, plus text, and n_template: blocks of the main part that went as template of the host."""
    spark = pages.sparkSession
    pages = pages.drop("text", "n_template")
    c_html, c_host, c_wrapper, c_salt = free_names(pages, "html", "host", "wrapper", "salt")
    learned = settled(wrappers(pages, url, html))
    size = learned.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0
    rest = [f for f in pages.schema if f.name != html]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "text string", "n_template long"])
    named = pages.select(*[F.col(f"`{f.name}`") for f in rest], F.col(html).alias(c_html), host_of(url).alias(c_host))
    known = None
    if size <= broadcast_bytes:
        known = share(spark, {r.host: r.wrapper for r in learned.toLocalIterator()})
    else:
        salted = learned.select(F.col("host").alias(c_host), F.col("wrapper").alias(c_wrapper), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias(c_salt))
        named = named.withColumn(c_salt, F.pmod(F.xxhash64(c_html), F.lit(salts)).cast("int")).join(salted, [c_host, c_salt], "left").drop(c_salt)
    columns = named.columns
    at_html, at_host = columns.index(c_html), columns.index(c_host)
    at_wrapper = columns.index(c_wrapper) if known is None else None
    keep = [columns.index(f.name) for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory(read_wrapper, 2000)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                raw = [known.value.get(h) for h in part.column(at_host).to_pylist()] if known is not None else part.column(at_wrapper).to_pylist()
                found = [main_blocks(Page(s), memory[w]) if s else ([], 0) for s, w in zip(part.column(at_html).to_pylist(), raw, strict=True)]
                texts = ["\n\n".join(t) for t, _ in found]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), pa.array(texts, pa.string()), pa.array([n for _, n in found], pa.int64())], names=[*(f.name for f in rest), "text", "n_template"])

    return named.mapInArrow(run, schema)
