"""HTML extraction with a tree-structured graphical model.

A page becomes a tree: block-level elements, and as leaves its text blocks (runs
of text and inline elements). Each node is content or not. A node's own features
(tag, class words, links, length, punctuation, and its share of the page's text,
which needs no names) give its potential; a table of potentials couples every
child to its parent. Hidden elements and controls (buttons, selections) are left out. Sum-product messages, once upward
and once downward, give each block's exact marginal; blocks that are content
with a probability of at least one half are the page's text.

Weights and tables are learned together from labelled pages by the gradient of
their likelihood, for which the same messages give the expectations. The library
brings a generator of labelled pages (``html_pages``); ``train`` takes any.

Pages are independent: they are read where they lie, without a shuffle.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfrank.llm.common import id_type, slices, small_batches, text_of, texts_of

_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s "
                    "samp small span strike strong sub sup time tt u var wbr br input picture source canvas object "
                    # MathML is text of its line
                    "math mrow mi mn mo ms mtext mspace mfrac msqrt mroot msub msup msubsup munder mover munderover mmultiscripts "
                    "mprescripts none mstyle merror mpadded mphantom mfenced menclose maction mtable mtr mlabeledtr mtd semantics "
                    "annotation annotation-xml".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without text of the page; all up to their end tag is left out.
_SILENT = frozenset("script style title textarea iframe noembed noframes template".split())
#: Elements that hold what a page is about.
_MAIN = ("article", "main")
#: Elements that may be any part of a page.
_BOXES = frozenset("div section main table td center".split())
#: Elements whose text is no text of the page, if they are closed.
_CONTROLS = frozenset("button noscript select datalist".split())
#: What a drawing ends at (these start tags also if its end tag is missing), but
#: not within those of its elements that may hold HTML.
_HOLDS_HTML = frozenset("foreignobject desc title".split())
_IN_SVG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)(svg|foreignobject|desc|title|address|article|aside|b|big|blockquote|body|br|"
    r"center|code|dd|details|div|dl|dt|em|embed|fieldset|figure|footer|form|h[1-6]|head|header|hr|i|img|li|listing|main|menu|meta|nav|"
    r"nobr|ol|p|pre|ruby|s|section|small|span|strike|strong|sub|sup|table|tt|u|ul|var)(?=[\s/>])([^>]*)>", re.I | re.S)
_ENDS_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header "
                    "hr main menu nav ol p pre section table ul".split())
#: A start tag ends an open element of these names, within the nearest of those.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
         "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
         "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"})}

#: Elements whose children have tables of their own.
_PARENTS = {"article": 1, "main": 1, "body": 2, "html": 2}

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Stems that class, id, role and label words are told by.
_STEMS = ("ad", "ads", "advert", "sponsor", "promo", "banner", "cookie", "consent", "notice", "alert", "popup", "modal", "overlay",
          "newsletter", "subscri", "signup", "sidebar", "widget", "related", "recommend", "trending", "popular", "share", "social",
          "follow", "breadcrumb", "menu", "nav", "head", "masthead", "foot", "copyright", "legal", "comment", "discuss", "repl",
          "respond", "disqus", "form", "login", "search", "pagina", "pager", "tag", "toolbar", "skip", "hidden", "complement",
          "contentinfo", "dialog", "content", "article", "post", "entry", "story", "main", "body", "text", "page", "wrap", "container",
          "layout", "title", "paragraph", "caption", "figure", "quote", "author", "byline", "meta", "date", "rating", "user")


@dataclass
class Tree:
    """Nodes in page order, parents first. ``own``: an element's start tag, share
    and links, or a block's features; ``text``: of blocks, else None; ``edge``: which table
    couples the node to its parent."""

    parent: list[int] = field(default_factory=list)
    edge: list[int] = field(default_factory=list)
    own: list = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)


def _svg_end(page: str, at: int, nested: bool) -> tuple[int, bool]:
    """Where a drawing that starts before ``at`` ends, and whether HTML within it
    was closed. ``nested``: HTML within it belongs to it."""
    opened, count, first = ["svg"], Counter(svg=1), None
    for m in _IN_SVG.finditer(page, at):
        if m[2] is None:
            continue
        closing, name = m[1], m[2].lower()
        if name == "svg" or name in _HOLDS_HTML:
            if not closing:
                if not m[3].endswith("/") and (nested or name == "svg"):
                    opened.append(name)
                    count[name] += 1
            elif count[name]:
                last = ""
                while last != name:
                    last = opened.pop()
                    count[last] -= 1
                if not opened:
                    return m.end(), True
        elif not closing or name in ("p", "br"):
            first = m.start() if first is None else first
            while opened[-1] == "svg":
                count[opened.pop()] -= 1
                if not opened:
                    return m.start(), True
    return (len(page), True) if first is None else (first, False)


def parse(page: str) -> Tree:
    """The page's tree, without elements that hold no text."""
    parent, tags, names, texts, blocks = [-1], [""], ["html"], [None], []
    ended: set[int] = set()
    stack, open_names = [0], {"html": 1}
    run: list[str] = []
    in_link = run_size = link_size = 0

    def end_block() -> None:
        nonlocal run, run_size, link_size
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                blocks.append((stack[-1], text, link_size / max(1, run_size), len(parent)))
                parent.append(stack[-1])
                tags.append("")
                names.append("#")
                texts.append(text)
            run, run_size, link_size = [], 0, 0

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            open_names[names[stack.pop()]] -= 1

    at, n, loose, nested = 0, len(page), False, True
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            piece = page[at:lt]
            run.append(piece)
            run_size += len(piece)
            if in_link:
                link_size += len(piece)
        if lt == n:
            break
        at = lt
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            at = n if end < 0 else end + 1
            continue
        m = None if loose else _TAG.match(page, at)
        if m is None:
            m = _LOOSE_TAG.match(page, at)
            if m is not None and not loose and m[3].count('"') % 2 + m[3].count("'") % 2:
                loose = page.find('"', m.end()) < 0 or page.find("'", m.end()) < 0
        if m is None:
            if page[at + 1:at + 2].isalpha() or page.startswith("</", at):
                if page.find(">", at) < 0:
                    break  # a tag cut off by the end of the page
            run.append("<")
            run_size += 1
            at += 1
            continue
        at = m.end()
        closing, name = m[1], m[2].lower()
        if name in _INLINE:
            if name == "a":
                in_link = 0 if closing else 1
            elif name in ("br", "mtd"):
                run.append(" ")
            continue
        end_block()
        in_link = 0
        if closing:
            if open_names.get(name):
                depth = len(stack) - 1
                while names[stack[depth]] != name:
                    depth -= 1
                if depth > 0:
                    ended.add(stack[depth])
                    pop_to(depth)
            continue
        if name == "svg":
            if not m[3].endswith("/"):
                at, closed = _svg_end(page, at, nested)
                nested = nested and closed
            continue
        if name in _SILENT:
            if not m[3].endswith("/"):
                end = re.compile(f"</{re.escape(name)}[^>]*>", re.I).search(page, at)
                at = n if end is None else end.end()
            continue
        if name in _ENDS_P and open_names.get("p"):
            depth = len(stack) - 1
            while names[stack[depth]] != "p":
                depth -= 1
            pop_to(depth)
        if name in _ENDS:
            ends, within = _ENDS[name]
            depth = len(stack) - 1
            last = None
            while depth > 0 and names[stack[depth]] not in within:
                if names[stack[depth]] in ends:
                    last = depth
                depth -= 1
            if last is not None:
                pop_to(last)
        if name in _VOID:
            continue
        parent.append(stack[-1])
        tags.append(m[0])
        names.append(name)
        texts.append(None)
        stack.append(len(parent) - 1)
        open_names[name] = open_names.get(name, 0) + 1
    end_block()

    # hidden elements and controls hold no text of the page
    out_of_sight = [False] * len(parent)
    for i in range(1, len(parent)):
        out_of_sight[i] = out_of_sight[parent[i]] or texts[i] is None and (
            names[i] in _CONTROLS and i in ended or names[i] != "body" and _HIDING.search(tags[i]) is not None and hidden(tags[i]))
        if out_of_sight[i]:
            texts[i] = None
    used = [t is not None for t in texts]
    used[0] = True
    size, linked, kids = [0] * len(parent), [0.0] * len(parent), [0] * len(parent)
    links = {i: share for _, _, share, i in blocks}
    largest = 1
    for i in range(len(parent) - 1, -1, -1):
        if texts[i] is not None:
            size[i] = len(texts[i])
            linked[i] = size[i] * links[i]
            largest = max(largest, size[i])
        if i and used[i]:
            used[parent[i]] = True
            size[parent[i]] += size[i]
            linked[parent[i]] += linked[i]
            kids[parent[i]] += 1
    number, out = {}, Tree()
    for i, keep in enumerate(used):
        if keep:
            number[i] = len(out.parent)
            text = texts[i]
            out.parent.append(number[parent[i]] if i else -1)
            out.edge.append(2 * _PARENTS.get(names[parent[i]], 0) + (text is not None))
            if text is None:
                share = min(5, int(-math.log2(size[i] / size[0]))) if size[i] else 6
                out.own.append((tags[i], share, math.ceil(4 * linked[i] / size[i]) if size[i] else 0,
                                min(3, kids[i] if names[i] == "body" else names.count(names[i]) if names[i] in _MAIN else 0)))
            else:
                out.own.append(block_features(text, links[i], names[parent[i]], min(5, int(math.log2(largest / len(text))))))
            out.text.append(text)
    return out


_HIDING = re.compile(r"hidden|display\s*:\s*none", re.I)


def hidden(tag: str) -> bool:
    """Whether a start tag hides its element."""
    for a in _ATTR.finditer(tag):
        name, value = a[1].lower(), a[2] or a[3] or a[4] or ""
        if name == "hidden" and a.start() > 1 or name == "style" and "display:none" in "".join(value.lower().split()):
            return True
    return False


def element_features(tag: str, share: int = 0, links: int = 0, number: int = 0) -> list[str]:
    """Features of an element: its start tag, its share of the page's text (as a
    power of two), the links in its text (in quarters), and a number: of the parts
    of a body, of the articles where it is one (one alone is the page's own)."""
    m = _LOOSE_TAG.match(tag)
    if m is None:
        return ["tag:html"]
    name = m[2].lower()
    out = ["tag:" + name]
    if name == "body" or name in _MAIN:
        out.append(f"{name} number:{number}")
    words: set[str] = set()
    for a in _ATTR.finditer(tag[1 + len(m[2]):-1]):
        key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
        if key in ("class", "id", "role", "aria-label", "itemprop"):
            words |= {w.lower() for w in _NAME.findall(value)}
        elif key == "aria-hidden" and value == "true":
            words.add("hidden")
    found = {s for w in words for s in _STEMS if (w == s if len(s) < 4 else w.startswith(s))}
    if words and not found:
        found = {"other"}
    if not words and name in _BOXES:
        # a box without a name is told by what stands in it
        out += [f"box share:{share}", f"box linked:{links}"]
    return out + sorted("word:" + s for s in found)


def _features(own: tuple) -> list[str] | tuple[str, ...]:
    return element_features(*own) if len(own) == 4 and isinstance(own[1], int) else own


def block_features(text: str, links: float, within: str, smaller: int = 0) -> tuple[str, ...]:
    """Features of a text block; ``smaller``: than the page's largest, as a power of two."""
    end = text[-1]
    return ("block", f"smaller:{smaller}", f"size:{min(9, len(text).bit_length())}", f"links:{math.ceil(links * 4)}", "in:" + within,
            "ends:" + ("stop" if end in ".!?:;\"'»”…" else "letter" if end.isalpha() else "other"),
            "words:" + ("one" if " " not in text else "more"), *(("copyright",) if "©" in text else ()))


# ------------------------------------------------------------------ model

@dataclass
class Model:
    """``weights`` of features (log-odds of content); ``tables[edge][parent][child]``:
    log potentials of an edge to an element or to a block, by the kind of parent."""

    weights: dict[str, float] = field(default_factory=dict)
    tables: list = field(default_factory=lambda: [[[0.5, -0.5], [-0.5, 0.5]] for _ in range(6)])
    memo: dict = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    def own(self, node) -> float:
        """The potential of a node's own features."""
        x = self.memo.get(node)
        if x is None:
            if len(self.memo) > 50_000:
                self.memo.clear()
            names = _features(node)
            x = self.memo[node] = sum(self.weights.get(f, 0.0) for f in names)
        return x


def _log_ratio(a: float, b: float, c: float, d: float, x: float) -> float:
    """log((e^a + e^(b + x)) / (e^c + e^(d + x)))"""
    return _log_sum(a, b + x) - _log_sum(c, d + x)


def _log_sum(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a >= b else b + math.log1p(math.exp(a - b))


def messages(model: Model, tree: Tree) -> tuple[list[float], list[float], list[float]]:
    """Log-odds of content of every node (exact marginals), what each node's
    subtree alone says, and what comes to it from above."""
    n, parent, tables = len(tree.parent), tree.parent, model.tables
    below = [model.own(x) for x in tree.own]
    up = [0.0] * n
    for i in range(n - 1, 0, -1):
        t = tables[tree.edge[i]]
        up[i] = _log_ratio(t[1][0], t[1][1], t[0][0], t[0][1], below[i])
        below[parent[i]] += up[i]
    belief, above = list(below), [0.0] * n
    for i in range(1, n):
        t = tables[tree.edge[i]]
        above[i] = belief[parent[i]] - up[i]
        belief[i] = below[i] + _log_ratio(t[0][1], t[1][1], t[0][0], t[1][0], above[i])
    return belief, below, above


def content(model: Model, page: str, least: float = 0.5) -> list[str]:
    """The page's content blocks in page order."""
    tree = parse(page)
    limit = math.log(least / (1 - least))
    belief = messages(model, tree)[0]
    return [t for t, b in zip(tree.text, belief) if t is not None and b >= limit]


def train(pages: Iterable[tuple[str, set[str]]], *, epochs: int = 14, rate: float = 0.2, shrink: float = 1e-4, seed: int = 3) -> Model:
    """Learns from pages with the texts of their content blocks. An element
    counts as content when most of its text is."""
    model, rows = Model(), []
    for page, texts in pages:
        tree = parse(page)
        n = len(tree.parent)
        size, good = [0] * n, [0] * n
        for i in range(n - 1, -1, -1):
            if tree.text[i] is not None:
                size[i] = len(tree.text[i])
                good[i] = size[i] if tree.text[i] in texts else 0
            if i:
                size[tree.parent[i]] += size[i]
                good[tree.parent[i]] += good[i]
        names = [_features(x) for x in tree.own]
        rows.append((tree, names, [int(2 * g > s) for g, s in zip(good, size)]))
    rng = random.Random(seed)
    # the mean of the weights over the later epochs, which steps less by chance
    late, sums, table_sums = epochs - epochs // 2, {}, [[[0.0, 0.0], [0.0, 0.0]] for _ in range(6)]
    for epoch in range(epochs):
        rng.shuffle(rows)
        step = rate / (1 + 0.1 * epoch)
        for tree, names, y in rows:
            model.memo.clear()
            belief, below, above = messages(model, tree)
            # gradient: what the labels say less what the model expects
            for i, fs in enumerate(names):
                g = y[i] - 1 / (1 + math.exp(-max(-500.0, min(500.0, belief[i]))))
                for f in fs:
                    w = model.weights.get(f, 0.0)
                    model.weights[f] = w + step * (g - shrink * w)
            change = [[[0.0, 0.0], [0.0, 0.0]] for _ in range(6)]
            for i in range(1, len(names)):
                kind = tree.edge[i]
                t = model.tables[kind]
                joint = [[t[a][b] + a * above[i] + b * below[i] for b in (0, 1)] for a in (0, 1)]
                top = max(map(max, joint))
                joint = [[math.exp(x - top) for x in r] for r in joint]
                total = sum(map(sum, joint))
                for a in (0, 1):
                    for b in (0, 1):
                        change[kind][a][b] += (a == y[tree.parent[i]] and b == y[i]) - joint[a][b] / total
            for kind in range(6):
                for a in (0, 1):
                    for b in (0, 1):
                        model.tables[kind][a][b] += step * (change[kind][a][b] / 10 - shrink * model.tables[kind][a][b])
            if epoch >= late:
                for f in set().union(*names):
                    last, total = sums.get(f, (0, 0.0))
                    sums[f] = (last + 1, total + model.weights[f])
                for kind in range(6):
                    for a in (0, 1):
                        for b in (0, 1):
                            table_sums[kind][a][b] += model.tables[kind][a][b]
    if epochs // 2:
        model.weights |= {f: total / n for f, (n, total) in sums.items()}
        model.tables = [[[x / (len(rows) * (epochs // 2)) for x in row] for row in t] for t in table_sums] if rows else model.tables
    model.memo.clear()
    return model


def extract(pages: DataFrame, model: Model, *, id_col: str = "page_id", html_col: str = "html", url_col: str | None = "url") -> DataFrame:
    """Per page: ``id``, ``url`` (null without ``url_col``), ``text`` (content
    blocks joined by one space, white space inside a block turned into one
    space; empty if none).

    Null and empty pages have an empty text. Pages are read whole; broken markup
    is read as browsers read it, roughly. One row per input row.
    """
    small_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                texts = [" ".join(content(shared.value, t.decode())) for t in texts_of(part)]
                doc = part.column(2)
                yield pa.RecordBatch.from_arrays([part.column(0), doc.field(0), pa.array(texts, pa.string())], names=["id", "url", "text"])

    url = F.col(url_col).cast("string") if url_col else F.lit(None).cast("string")
    source = pages.select(F.col(id_col).alias("id"), text_of(html_col).cast("binary").alias("utf8"),
                          F.struct(url.alias("url")).alias("more"))
    return source.mapInArrow(run, f"id {id_type(pages, id_col)}, url string, text string")
