"""Main text of web pages by composite text density.

Every DOM node gets its characters per tag, scaled down by the share of its text and tags that are links (after Sun, Song and Liao,
2011). The node with the largest sum of its children's densities holds the main text; where that is a paragraph or the like, what it
stands in. The body itself gives way to the largest node in it that has half of its sum. The threshold is the least density on the path from
the body to it: what stands beside that path is taken as well if it is as dense as that and not mostly links; in an element that holds navigation too, only a block
with SHARE of the main node's sum. An article or main element around the main node is taken whole.

Navigation, asides, footers, forms and what a class or id names as such are not counted and not taken, but never if half of the page's
text that isn't links is in them: tags and names choose no node and remove no main text.

Cases: a null, empty or textless page gives an empty text; unclosed and stray tags are closed as browsers do; repeated rows give
repeated result rows; null ids and addresses stay null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

TAG = re.compile(r"""<!--(?:-?>|.*?(?:-->|\Z))|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
#: What stands beside the path has no greater share of its characters in links.
MOST_LINKED = 0.5
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

# Element names of the HTML standard by how they are read.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opening tag ends an open one of its group, but not beyond the last element of the fence.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
# Elements that show no text of the page's own.
NEVER = frozenset("head select dialog noscript template svg canvas object audio video search option datalist".split())
# What is no part of an article, by tag, by role, and by a part of a class or id.
BESIDES = frozenset("nav footer aside form menu".split())
STRICT = frozenset("nav footer".split())
CONTROLS = frozenset("button label".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adbox sponsor sponsored promo promotion promoted banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices notification alert popup modal overlay comment comments disqus reply replies respond share sharing social related recommended recommendations newsletter subscribe subscription signup login pagination pager widget widgets toolbar paywall masthead topbar".split()
)
#: Parts of names that say nothing of what an element holds.
NEUTRAL = frozenset("area bar block bottom box col column container footer form frame global group header holder id inner item items js layer left level link links list page panel region right row section site slot small sticky text thread top unit wrap wrapper".split())
#: A name with one of these says what an element lacks or has beside it.
BESIDE = frozenset("has no with without".split())
#: Parts of names that even most of the page's text doesn't outweigh: there may be more comments than article.
ANSWERS = frozenset("comment comments disqus reply replies respond".split())
WHOLE = frozenset("html body article main".split())
#: Parts of a running text: the main node is never one of them.
PARTS = frozenset("p ul ol li dl dt dd blockquote pre figure figcaption address h1 h2 h3 h4 h5 h6 hgroup hr table caption thead tbody tfoot tr center details summary".split())
ROOTS = frozenset("#root html body".split())
#: Of the main node's sum, what a block beside the path has at least; of the body's, what its largest node has to stand for it.
SHARE, STANDS_FOR = 0.2, 0.5


def named_boilerplate(name: str) -> bool:
    """Whether a class or id names something that is no part of an article."""
    parts = [p.lower() for p in NAME_PARTS.findall(name)]
    if not parts or BESIDE & set(parts):
        return False
    return parts[-1] in BOILERPLATE or (not BOILERPLATE.isdisjoint(parts) and all(p in BOILERPLATE or p in NEUTRAL or p.isdigit() or len(p) == 1 for p in parts))


class Page:
    """The tree of a page as lists over its nodes, parents before children; node 0 stands above all."""

    def __init__(self, text: str):
        self.tag, self.parent, self.out, self.article = ["#root"], [-1], [False], [False]
        self.in_head, self.in_article, self.in_text = [False], [False], [False]
        self.named, self.answers = [False], [False]  # left out unless the page's text is inside
        self.events: list[tuple[int, str | None]] = []  # (node, text), or (node, None) where a block begins or ends
        self._parse(text)
        self._prune()

    def _open(self, tag: str, attributes: str, parent: int) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.in_head.append(tag == "head" or self.in_head[parent])
        self.in_article.append(tag in ("article", "main") or self.in_article[parent])
        self.in_text.append(tag in PARTS or self.in_text[parent])
        named, answers = tag in BESIDES or (tag == "header" and not self.in_article[parent]) or (tag in CONTROLS and not self.in_text[parent]), False
        out, article = tag in NEVER, tag in ("article", "main")
        if attributes and tag not in ("html", "body"):
            given = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)}
            role = given.get("role", "").lower()
            article = article or role in ("main", "article")
            if tag not in WHOLE:
                told = [name for k in ("class", "id") for name in given.get(k, "").split() if named_boilerplate(name)]
                named = named or bool(told) or role in ROLES
                answers = any(not ANSWERS.isdisjoint(p.lower() for p in NAME_PARTS.findall(name)) for name in told)
            out = out or "hidden" in given or given.get("aria-hidden", "").lower() == "true" or bool(HIDDEN.search(given.get("style", "")))
        self.out.append(out or self.out[parent])
        self.named.append(named)
        self.answers.append(answers)
        self.article.append(article)
        return len(self.tag) - 1

    def _parse(self, text: str) -> None:
        stack, at, events = [0], 0, self.events
        standing: Counter[str] = Counter()  # open elements by tag
        cut = text.rfind(">") + 1  # no tag ends behind it: what begins and doesn't end isn't tried again and again

        def close(upto: int) -> None:
            while len(stack) > upto:
                node = stack.pop()
                standing[self.tag[node]] -= 1
                if self.tag[node] in BLOCK:
                    events.append((node, None))

        def last(tags, fence) -> int:
            if not any(standing[t] for t in tags):
                return 0
            for k in range(len(stack) - 1, 0, -1):
                if self.tag[stack[k]] in tags:
                    return k
                if self.tag[stack[k]] in fence:
                    return 0
            return 0

        while True:
            m = TAG.search(text, at, cut)
            if m is None:
                break
            if m.start() > at:
                events.append((stack[-1], text[at : m.start()]))
            at = m.end()
            if m[2] is None:
                if m[0].startswith("<!--") and not m[0].endswith("-->"):
                    at = len(text)
                continue
            tag = m[2].lower()
            if m[1]:
                if k := last({tag}, ()):
                    close(k)
                continue
            if tag in ("html", "body", "head") and last({tag}, ()):
                continue
            if tag in ENDS_P and (k := last({"p"}, {"table", "button", "object", "td", "th"})):
                close(k)
            if tag in SIBLINGS and (k := last(*SIBLINGS[tag])):
                close(k)
            if tag == "body" and (k := last({"head"}, ())):
                close(k)
            if tag == "br":
                events.append((stack[-1], " "))
            node = self._open(tag, m[3], stack[-1])
            if tag in BLOCK:
                events.append((node, None))
            if tag in RAW:
                end = re.compile(f"</{tag}\\b[^>]*>", re.I).search(text, at, cut)
                at = end.end() if end else len(text)
            elif tag not in VOID and not m[3].endswith("/") or tag in BLOCK and tag not in VOID:
                stack.append(node)
                standing[tag] += 1
        comment = text.find("<!--", at)
        if rest := text[at : comment if comment >= 0 else len(text)]:
            events.append((stack[-1], rest))
        close(1)

    def _prune(self) -> None:
        """Leave out what is named so, but for what holds the page's text."""
        n = len(self.tag)
        plain, in_link, under = [0] * n, [False] * n, [False] * n
        for i in range(1, n):
            in_link[i] = self.tag[i] == "a" or in_link[self.parent[i]]
            under[i] = self.answers[i] or under[self.parent[i]]
        for node, text in self.events:
            if text is not None and not in_link[node] and not self.out[node] and not self.in_head[node]:
                plain[node] += len("".join(text.split()))
        for i in range(n - 1, 0, -1):
            plain[self.parent[i]] += plain[i]
        comments = sum(plain[i] for i in range(n) if self.answers[i] and not under[self.parent[i]])
        whole = plain[0] - comments if 4 * comments >= plain[0] else plain[0]
        # Text outside an article with a quarter of the page's isn't the page's text.
        chief = max((i for i in range(n) if self.article[i] and not under[i]), key=lambda i: plain[i], default=0)
        within = [not chief or 4 * plain[chief] < whole] * n
        if not within[0]:
            node = chief
            while node >= 0:
                within[node] = True
                node = self.parent[node]
            for i in range(1, n):
                within[i] = within[i] or (i > chief and within[self.parent[i]] and self.parent[i] >= chief)
        keeps = [2 * plain[i] >= whole and within[i] and not under[i] and self.tag[i] not in STRICT for i in range(n)]
        out = list(self.out)
        for i in range(1, n):
            out[i] = out[i] or out[self.parent[i]] or (self.named[i] and not keeps[i])
        if any(text is not None and not out[node] and not self.in_head[node] and text.strip() for node, text in self.events):
            self.out = out

    def densities(self) -> tuple[list[float], list[float], list[int], list[int]]:
        """Composite text density, sum of the children's, characters, and those in links, of each node."""
        n = len(self.tag)
        chars, linked, tags, links = [0] * n, [0] * n, [0] * n, [0] * n
        in_link, body_chars, body_linked = [False] * n, 0, 0
        for i in range(1, n):
            in_link[i] = self.tag[i] == "a" or in_link[self.parent[i]]
        for node, text in self.events:
            if text is not None and (size := len("".join(text.split()))) and not self.in_head[node]:
                body_chars += size
                body_linked += size * in_link[node]
                if not self.out[node]:
                    chars[node] += size
                    linked[node] += size * in_link[node]
        own, breaks = list(chars), [0] * n
        density, total = [0.0] * n, [0.0] * n
        share = body_linked / max(1, body_chars)
        for i in range(n - 1, -1, -1):
            c, lc, t, lt = chars[i], linked[i], tags[i], links[i]
            if c:
                base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
                plain = c / max(1, t)
                density[i] = plain * math.log(max(1.0, c / max(1, lc) * max(1, t) / max(1, lt))) / math.log(base) if base > 1 + 1e-9 else plain
            if breaks[i] and own[i]:  # lines parted by breaks are like paragraphs
                total[i] += own[i] * math.log(max(1.0, own[i] / (breaks[i] + 1)))
            if i and not self.out[i]:
                p = self.parent[i]
                breaks[p] += self.tag[i] == "br"
                chars[p] += c
                linked[p] += lc
                tags[p] += t + 1
                links[p] += lt + (self.tag[i] == "a")
                total[p] += density[i]
        return density, total, chars, linked

    def _outside_parts(self, node: int) -> int:
        """The first of the node and what it stands in that is no part of a running text nor inside a line of it."""
        while node > 0 and (self.tag[node] in PARTS or self.tag[node] not in BLOCK) and self.tag[node] not in ROOTS:
            node = self.parent[node]
        return node

    def main_nodes(self) -> list[bool]:
        """Which nodes' text is main text."""
        n = len(self.tag)
        density, total, chars, linked = self.densities()
        inside = [i for i in range(1, n) if chars[i] and not self.out[i]]
        if not inside:
            return [not out for out in self.out]
        largest = lambda nodes: max(nodes, key=lambda i: (total[i], density[i], -i))
        best = self._outside_parts(largest(inside))
        if self.tag[best] in ROOTS and (blocks := [i for i in inside if self.tag[i] not in ROOTS and self._outside_parts(i) == i]):
            chief = largest(blocks)
            if total[chief] and total[chief] >= STANDS_FOR * total[best]:
                best = chief
        node = best
        while node > 0:  # outwards to the last article around it
            if self.article[node] and self.tag[node] not in ROOTS:
                best = node
            node = self.parent[node]
        path, node = [], best
        while node > 0 and self.tag[node] not in ROOTS:
            path.append(node)
            node = self.parent[node]
        least = min((density[i] for i in [*path, node] if density[i]), default=0.0)
        on_path, taken, enough = {*path, 0, node}, [False] * n, SHARE * total[best]
        while node > 0:
            on_path.add(node)
            node = self.parent[node]
        # What holds navigation and the like is the page, not the article.
        around = [tag in ROOTS for tag in self.tag]
        for i in range(1, n):
            if (self.out[i] and self.named[i]) or (chars[i] and linked[i] > MOST_LINKED * chars[i] and self.tag[i] in BLOCK):
                around[self.parent[i]] = True
        for i in range(n):
            p = self.parent[i]
            if not i or self.out[i]:
                continue
            if i == best or taken[p]:
                taken[i] = True
            elif i not in on_path and p in on_path and chars[i] and linked[i] <= MOST_LINKED * chars[i] and density[i] >= least:
                taken[i] = total[i] >= enough > 0 or not around[p]
            elif self.tag[i] in PARTS and p == self.parent[best] and not around[p]:  # a lead or the like, however short
                taken[i] = bool(chars[i]) and linked[i] <= MOST_LINKED * chars[i]
        heading: dict[int, int] = {}  # by parent, a heading with nothing else behind it yet
        for i in range(1, n):
            p = self.parent[i]
            if self.out[i] or not chars[i]:
                continue
            if self.tag[i] in HEADINGS and p in on_path and not taken[i]:
                heading[p] = i
            elif taken[i] and p in heading:
                taken[heading.pop(p)] = True
            elif i in on_path and i == best and p in heading:
                taken[heading.pop(p)] = True
            elif p in heading and i not in on_path:
                heading.pop(p)
        for i in range(1, n):
            taken[i] = not self.out[i] and (taken[i] or taken[self.parent[i]])
        if not path:
            taken[0] = taken[best] = True
        return taken


def main_text(page: str) -> str:
    """The page's main text: blocks in page order, one a line."""
    if not page:
        return ""
    tree = Page(page)
    taken = tree.main_nodes()
    blocks, block = [], []
    for node, text in [*tree.events, (0, None)]:
        if text is None:
            if block and (line := " ".join(html.unescape("".join(block)).split())):
                blocks.append(line)
            block = []
        elif taken[node]:
            block.append(text)
    return "\n".join(blocks)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns named in keep, none of them text or n_chars, with text and n_chars, its code points."""
    if {"text", "n_chars"} & {c.lower() for c in keep}:
        raise ValueError("keep must not name text or n_chars")

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            texts = [main_text(page) for page in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

        return each

    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep) + ", text string, n_chars long"
    return map_arrow(pages.select(*keep, F.col(html_col).alias("__html")), make, schema)


def op3_text_density(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op3_text_density": op3_text_density}
ORACLES: dict[str, str] = {}
