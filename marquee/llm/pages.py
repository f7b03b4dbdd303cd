"""Main text of web pages by composite text density.

Every node of the page tree gets a density: characters per tag, scaled down by how
much of its text and how many of its tags are links. The densities of a node's
children add up; the node with the largest sum is the best subtree. The smallest
density on the way from it to the body (without the body) is the threshold: from
the body down, the first node of each branch that reaches it gives its best
subtree as content. A subtree inside an ``article`` or ``main`` stands for all of
that element, so headlines and further sections stay.

Menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles
and reader comments are told by element, role or the words of class and id, and
count for nothing. ``header`` elements inside an article belong to it.

The text is what is left of the content in page order: character references
decoded, white space inside a block as one space, blocks joined by one space.

Edge cases: a null or empty page has the empty text; markup that is cut off, not
closed or closed twice is read like a browser would, roughly; a page without any
markup is one block; repeated rows get a row each; an empty table gives no rows.
"""

import math
import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from marquee.llm.common import in_slices, only, shipped, texts_of

# Elements and words of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg xmp noembed noframes".split())
CLOSES = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]),
    "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]),
}
SCOPES = frozenset("ul ol dl table select".split())
NOISE = RAW | frozenset("head nav footer aside form button select input dialog menu object audio video canvas".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs"
    " footer masthead comment comments disqus reply replies respond cookie cookies consent gdpr notice notification newsletter subscribe share sharing social related popup modal".split()
)
KEEPERS = frozenset(["has", "with", "no", "without"])
WHOLE = frozenset(["article", "main"])

MARK = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>""", re.S)
NAMED = re.compile(r"""(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
WORD = re.compile(r"[^\s_-]+")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW}


def is_noise(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element and all below it are no part of an article."""
    if tag in NOISE or tag == "header" and not in_article:
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    for name, value in NAMED.findall(attributes):
        name, value = name.lower(), unescape(value.strip("\"'")).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in NOISE_ROLES:
            return True
        if name in ("class", "id"):
            for token in value.split():
                words = WORD.findall(token)
                hit = words and (words[0] in NOISE_WORDS or words[-1] in NOISE_WORDS and words[0] not in KEEPERS)
                if hit and (tag != "article" or "comment" in token or "reply" in token):
                    return True
    return False


class Tree:
    """Nodes in page order as parallel lists; node 0 is the root. ``pieces`` are (node, text, starts a block)."""

    def __init__(self, html: str) -> None:
        self.tag, self.parent, self.noise, self.kin = ["#root"], [-1], [False], [False]
        self.pieces: list[tuple[int, str, bool]] = []
        self.body = 0
        self._read(html)

    def _read(self, html: str) -> None:
        tags, parents, noise, kin, pieces = self.tag, self.parent, self.noise, self.kin, self.pieces
        stack, at, fresh, end = [0], 0, True, len(html)
        while at < end:
            m = MARK.search(html, at)
            text = html[at : m.start() if m else end]
            if text:
                pieces.append((stack[-1], text, fresh))
                fresh = False
            if not m:
                break
            at, name = m.end(), m[2]
            if not name:
                continue
            name = name.lower()
            inline = name in INLINE
            fresh = fresh or not inline
            if m[1]:
                if name == "br":
                    continue
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] == name:
                        del stack[k:]
                        break
                    if inline and tags[stack[k]] not in INLINE:
                        break
                continue
            if name in ("html", "body") and len(stack) > 1:
                if name == "body" and not self.body:
                    while len(stack) > 1 and tags[stack[-1]] != "html":
                        stack.pop()
                elif name == "html" or self.body:
                    continue
            if not inline and name not in VOID:
                self._close(stack, "p")
            if name in CLOSES:
                self._close_any(stack, CLOSES[name])
            top, node = stack[-1], len(tags)
            tags.append(name)
            parents.append(top)
            kin.append(kin[top] or name in WHOLE)
            noise.append(noise[top] or is_noise(name, m[3], kin[top]))
            if name == "body" and not self.body:
                self.body = node
            if name in VOID or m[3].endswith("/") and name in RAW:
                continue
            if name in RAW:
                close = RAW_END[name].search(html, at)
                at = close.end() if close else end
                continue
            stack.append(node)

    def _close(self, stack: list[int], name: str) -> None:
        """An open paragraph ends where a block begins, unless a block lies between."""
        for k in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[k]]
            if tag == name:
                del stack[k:]
                return
            if tag not in INLINE:
                return

    def _close_any(self, stack: list[int], names: frozenset[str]) -> None:
        """An open item, row or cell ends where the next begins, within its own list or table."""
        lowest = 0
        for k in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[k]]
            if tag in SCOPES:
                break
            if tag in names:
                lowest = k
        if lowest:
            del stack[lowest:]


def densities(tree: Tree) -> tuple[list[float], list[float]]:
    """Composite text density of each node, and the sum over its children."""
    n = len(tree.tag)
    chars, link_chars, tags, link_tags, linked = [0] * n, [0] * n, [0] * n, [0] * n, [False] * n
    for k in range(1, n):
        linked[k] = linked[tree.parent[k]] or tree.tag[k] == "a"
    for node, text, _ in tree.pieces:
        if not tree.noise[node]:
            size = len("".join(text.split()))
            chars[node] += size
            if linked[node]:
                link_chars[node] += size
    for k in range(n - 1, 0, -1):
        if not tree.noise[k]:
            up = tree.parent[k]
            chars[up] += chars[k]
            link_chars[up] += link_chars[k]
            tags[up] += tags[k] + 1
            link_tags[up] += link_tags[k] + (tree.tag[k] == "a")
    body_links = link_chars[tree.body] / max(chars[tree.body], 1)
    density, total = [0.0] * n, [0.0] * n
    for k in range(n):
        if chars[k] and not tree.noise[k]:
            density[k] = chars[k] / max(tags[k], 1)
            base = math.log(math.log(chars[k] / max(chars[k] - link_chars[k], 1) * link_chars[k] + body_links * chars[k] + math.e))
            if base > 0:  # else the page has no linked text
                density[k] *= max(math.log(chars[k] / max(link_chars[k], 1) * max(tags[k], 1) / max(link_tags[k], 1)), 0.0) / base
            if k:
                total[tree.parent[k]] += density[k]
    return density, total


def content(tree: Tree) -> list[bool]:
    """Which nodes belong to the main text."""
    n, parent = len(tree.tag), tree.parent
    density, total = densities(tree)
    # The best node of each subtree: itself or the best of a child's; children come after their parent.
    best = list(range(n))
    for k in range(n - 1, 0, -1):
        up = parent[k]
        if not tree.noise[k] and (total[best[k]], density[best[k]]) >= (total[best[up]], density[best[up]]):
            best[up] = best[k]
    threshold, k = math.inf, best[tree.body]
    while k > 0 and k != tree.body:
        threshold = min(threshold, density[k])
        k = parent[k]
    chosen, passed = [False] * n, [False] * n
    for k in range(tree.body, n):
        if tree.noise[k] or k != tree.body and (parent[k] < tree.body or passed[parent[k]]):
            passed[k] = True
            continue
        if density[k] >= threshold or k == tree.body and threshold == math.inf:
            passed[k] = True
            node = up = best[k]
            while up > 0 and up != tree.body:
                if tree.tag[up] in WHOLE:
                    node = up
                up = parent[up]
            chosen[node] = True
    inside = [False] * n
    for k in range(n):
        inside[k] = not tree.noise[k] and (chosen[k] or k > 0 and inside[parent[k]])
    return inside


def main_text(html: str) -> str:
    tree = Tree(html)
    inside = content(tree)
    blocks, block, broken = [], [], False
    for node, text, fresh in tree.pieces:
        broken = broken or fresh
        if inside[node]:
            if broken and block:
                blocks.append("".join(block))
                block = []
            broken = False
            block.append(text)
    blocks.append("".join(block))
    # References are decoded once the block is whole: a piece ends at markup only, never inside one.
    clean = (" ".join(unescape(b).split()) for b in blocks)
    return " ".join([b for b in clean if b])


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h) for h in texts_of(batch.column("html")).to_pylist()]
        columns = [batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    return only(pages, "page_id", "url", "html").mapInArrow(in_slices(run, "html"), "page_id long, url string, text string, n_chars long")


def op4_composite_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(shipped(spark).read.parquet(f"{sf_dir}/pages.parquet"))
