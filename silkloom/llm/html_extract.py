"""Main text of web pages: flat text blocks, classified by a small decision tree.

A page is cut into blocks at block-level tags. Each block has its word count and link density, those of its two
neighbours, and marks: what is around it (article, boilerplate container), how much of the class, id or role names around
it tells of other parts, whether it is a heading, a list item or a rights notice. All are features of one decision tree,
grown on a labelled table of pages of several shapes (`labelled_pages`), some with plain tags and names only, where lengths
and links of the block and its neighbours have to decide. No mark decides by itself. The tree is grown once on the driver.

Left out before the blocks are cut: comments, and what stands between the tags of SILENT elements. Script, style, textarea
and title run to their closing tag or the end of the page; of the others an unclosed one hides nothing but opens a block.

Null and empty pages give an empty text, and an empty table an empty result. Pages may be cut off anywhere: open elements
count as closed at the end, and an unfinished tag is no text. White space (any Unicode kind) in a block becomes one space;
blocks are joined by a newline. Whole pages are read and no block is cut. Repeated rows give repeated results. Columns of
the table that are not in `keep` are left out, whatever their names.
"""

from __future__ import annotations

import functools
import html
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from silkloom.llm.common import sliced

#: Tags, by how they are treated.
BLOCK_TAGS = frozenset("address blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul article aside".split())
CONTAINERS = frozenset("article aside blockquote center details dialog div dl fieldset figure footer form header main menu nav ol section table ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNMARKED = frozenset("script style textarea title".split())
SILENT = UNMARKED | frozenset("noscript template iframe svg select button canvas video audio noframes".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog".split())
#: Words of a class, id or role that tell of a part which is not main text.
HINTS = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer header masthead topbar cookie cookies consent gdpr notice notification alert popup modal overlay comment comments disqus reply replies respond "
    "share sharing social related recommended recommendations newsletter subscribe subscription paywall login signup signin search form widget pagination pager "
    "toolbar copyright legal disclaimer complementary contentinfo tags byline trending popular outbrain taboola".split()
)

#: A part's own header is no page header.
OWN_PARTS = frozenset("post entry article story".split())
_RIGHTS = re.compile(r"^(?:©|\(c\)|copyright\b)|all rights reserved", re.I)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|=(?!\s*[\"'])|[^>=])*+)(?:>|\Z)|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)",
    re.S,
)
_NAMED = re.compile(r"(?:^|\s)(?:class|id|role|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_CLOSING = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I) for tag in SILENT}
_LABEL = re.compile(r"data-main=(\d)")


def _hint(rest: str) -> float:
    """The greatest part of a name in class, id or role (words of it) that tells of a part which is not main text; 1 if hidden."""
    if not rest:
        return 0.0
    top = 1.0 if _HIDDEN.search(rest) else 0.0
    for value in _NAMED.findall(rest):
        listed = [p.lower() for p in _PART.findall(value)]
        if listed and not ("header" in listed and OWN_PARTS.intersection(listed)):
            pairs = {k for k, two in enumerate(zip(listed, listed[1:])) if "".join(two) in HINTS}
            told = sum(w in HINTS or k in pairs or k - 1 in pairs for k, w in enumerate(listed))
            top = max(top, told / len(listed))
    return top


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    article: bool = False
    boiler: bool = False
    hint: float = 0.0
    heading: bool = False
    listed: bool = False
    label: int | None = None
    text: str = ""
    words: int = 0
    density: float = 0.0
    rights: bool = False


def blocks(page: str | None) -> list[Block]:
    """The page's blocks that hold text, in page order."""
    if not page:
        return []
    found: list[Block] = []
    # Open containers: (tag, in an article, in boilerplate, hint).
    stack: list[tuple[str, bool, bool, float]] = [("", False, False, 0.0)]
    now, in_link, at = Block(), False, 0

    def close(**marks) -> None:
        nonlocal now
        if now.parts:
            words = html.unescape("".join(now.parts)).split()
            if words:
                linked = len(html.unescape(" ".join(now.linked)).split())
                now.text, now.words, now.density = " ".join(words), len(words), min(1.0, linked / len(words))
                now.rights = _RIGHTS.search(now.text) is not None
                found.append(now)
        _, article, boiler, hint = stack[-1]
        now = Block(article=article, boiler=boiler, hint=hint)
        for k, v in marks.items():
            setattr(now, k, v)

    def say(text: str) -> None:
        now.parts.append(text)
        if in_link:
            now.linked.append(text)

    close()
    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        end, rest = m["end"] or m["end2"], m["rest"] or m["rest2"] or ""
        if tag in SILENT and not end:
            stop = None if rest.rstrip().endswith("/") and tag not in UNMARKED else _CLOSING[tag].search(page, at)
            if stop or tag in UNMARKED:
                at = stop.end() if stop else len(page)
                now.parts.append(" ")
            elif tag in ("button", "select"):
                close()
                now.boiler = True
        elif tag == "a":
            in_link = not end
        elif tag == "br":
            now.parts.append(" ")
        elif tag in CONTAINERS:
            in_link = False
            if not end:
                _, article, boiler, hint = stack[-1]
                outer = boiler or tag in BOILERPLATE_TAGS or tag == "header" and not article
                stack.append((tag, article or tag in ("article", "main"), outer, hint if tag in ("article", "main") else max(hint, _hint(rest))))
            elif any(s[0] == tag for s in stack):
                while stack.pop()[0] != tag:
                    pass
            close(listed=tag in ("ul", "ol", "dl"), label=int(x[1]) if (x := _LABEL.search(rest)) else None)
        elif tag in BLOCK_TAGS:
            own = 0.0 if end or tag in ("body", "html") else _hint(rest)
            close(heading=not end and tag[0] == "h" and tag[1:].isdigit(), listed=tag == "li", label=int(x[1]) if (x := _LABEL.search(rest)) else None)
            now.hint = max(now.hint, own)
    close()
    return found


FEATURES = ("boilerplate", "hint", "rights", "article", "heading", "listed", "density", "words", "density before", "words before", "density after", "words after")


def features(found: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block; a missing neighbour has no words and no links."""
    own = np.array([(b.density, b.words) for b in found], float).reshape(-1, 2)
    none = np.zeros((1, 2))
    marks = np.array([(b.boiler, b.hint, b.rights, b.article, b.heading, b.listed) for b in found], float).reshape(-1, 6)
    return np.hstack([marks, own, np.vstack([none, own])[:-1], np.vstack([own, none])[1:]])


#: Node of a tree: (feature, threshold, at most, above), or the answer.
Tree = tuple | bool


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 3) -> Tree:
    """A classification tree by Gini impurity; ties go to the earlier feature and lower threshold."""
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return bool(y.mean() >= 0.5)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= t
            n = low.sum()
            if min(n, len(y) - n) < least:
                continue
            a, b = y[low].mean(), y[~low].mean()
            impurity = n * a * (1 - a) + (len(y) - n) * b * (1 - b)
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, float(t), low)
    if best is None or best[0] >= len(y) * y.mean() * (1 - y.mean()) - 1e-9:
        return bool(y.mean() >= 0.5)
    _, f, t, low = best
    return (f, t, grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least))


def decide(tree: Tree, row: list[float]) -> bool:
    while not isinstance(tree, bool):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def labelled_pages(n: int = 500, seed: int = 3) -> list[str]:
    """Pages of five shapes, as their authors mean them: data-main=1 marks main text and 0 everything else.

    `semantic` pages have articles, navs and footers; `classed` ones divs with telling names; `plain` ones divs and tables
    without any or with meaningless names; `wiki` ones long runs of headings and lists; `bare` ones have text only. Main parts
    may carry a name that holds a telling word, and any page may hold parts that only lengths and links give away.
    """
    rng = np.random.default_rng(seed)
    pick = lambda *parts: parts[rng.integers(len(parts))]
    chance = lambda p: rng.random() < p
    some = lambda n: "word " * int(n)

    def part(tag: str, main: int, words: int, linked: float = 0.0, name: str = "") -> str:
        in_links = int(round(words * linked))
        text = some(words - in_links) + "".join(f"<a>{some(k)}</a> " for k in ([in_links] if in_links < 4 else [in_links // 2, in_links - in_links // 2]) if k)
        return f"<{tag} data-main={main}{f' class={name!r}' if name else ''}>{text}</{tag}>"

    def paragraph(tag: str = "p", sure: bool = False, name: str = "") -> str:
        least, most = (1, 12) if sure and chance(0.3) else (14, 120)
        return part(tag, 1, rng.integers(least, most), pick(0, 0, 0, 0.1, 0.25) if not (sure and chance(0.06)) else 1.0, name)

    def links(tag: str = "ul", item: str = "li", name: str = "") -> str:
        rows = "".join(part(item, 0, rng.integers(1, pick(4, 4, 12)), pick(1.0, 1.0, 0.9)) for _ in range(rng.integers(3, 9)))
        return f"<{tag}{f' class={name!r}' if name else ''}>{rows}</{tag}>"

    def heading(tag: str = "h2") -> str:
        return part(tag, 1, rng.integers(1, 14))

    def body(sure: bool, tag: str = "p") -> list[str]:
        odd = lambda: pick("sponsored-research", "lead social", "post-comment-policy", "ad-free text", "story-form body", "c3", "intro") if sure and chance(0.12) else ""
        out = [heading("h1")] if chance(0.8) else []
        for _ in range(rng.integers(1, 6)):
            if chance(0.25):
                out.append(heading())
            out.append(paragraph(tag, sure, odd()))
            if chance(0.15):
                out.append("<ul>" + "".join(part("li", 1, rng.integers(3 if sure else 9, 30)) for _ in range(rng.integers(2, 5))) + "</ul>")
            if sure and chance(0.05):
                out.append(f"<p data-main=1>{some(rng.integers(5, 30))} All rights reserved.</p>")
            if sure and chance(0.25):
                out.append(pick(lambda: part("div", 0, rng.integers(2, 160), 0.0, pick("ad", "advert", "newsletter", "promo banner", "cookie-notice")), lambda: links(name=pick("", "share", "related-posts")), lambda: f"<aside>{paragraph().replace('data-main=1', 'data-main=0')}</aside>", lambda: f"<form>{part('p', 0, rng.integers(2, 20))}</form>")())
        return out

    def comments(named: bool) -> str:
        rows = "".join(part("p", 0, rng.integers(3, 160)) for _ in range(rng.integers(1, 4)))
        return f"<div class={pick('comments', 'comment-list', 'replies')!r}>{rows}</div>" if named else f"<aside>{rows}</aside>"

    def teasers() -> str:
        return "".join(part("div", 0, rng.integers(2, 12), 1.0) + part("div", 0, rng.integers(6, 26)) for _ in range(rng.integers(2, 6))) + part("div", 0, rng.integers(1, 4), 1.0)

    def rights(tag: str) -> str:
        return f"<{tag} data-main=0>{pick('© ', 'Copyright ')}{some(rng.integers(1, 25))}</{tag}>"

    def semantic() -> str:
        tag = pick("article", "article", "main")
        before = f"<nav>{links()}</nav>" + (part("div", 0, rng.integers(2, 160), 0.0, pick("ad", "cookie-notice", "banner")) if chance(0.6) else "") + (f"<header>{part('h1', 0, 3)}{part('p', 0, 8)}</header>" if chance(0.3) else "")
        after = (f"<aside>{part('p', 0, rng.integers(2, 160))}{links()}</aside>" if chance(0.4) else "") + (comments(chance(0.7)) if chance(0.4) else "") + f"<footer>{rights(pick('p', 'div'))}{links() if chance(0.3) else ''}</footer>"
        return f"{before}<{tag}>{''.join(body(True))}</{tag}>{after}"

    def classed() -> str:
        box = lambda name, inner: f"<div class={name!r}>{inner}</div>"
        before = box(pick("site-header", "navbar", "topbar", "menu"), links("div", "div")) + (box(pick("cookie-notice", "cookies", "alert", "modal"), part("p", 0, rng.integers(3, 160))) if chance(0.5) else "")
        side = box(pick("sidebar", "sidebar-left", "related", "widget"), part("p", 0, rng.integers(2, 160)) + links()) if chance(0.7) else ""
        after = (comments(True) if chance(0.4) else "") + box(pick("footer", "site-footer", "legal"), rights("p"))
        main = box(pick("content", "post", "text", "entry body"), "".join(body(False)))
        return before + (side + main if chance(0.5) else main + side) + after

    def plain() -> str:
        name = lambda: pick("", "", "c1", "x-7", "row", "box")
        outer, inner = pick(("div", "p"), ("div", "div"), ("table", "td"))
        top = links(outer, inner if inner == "td" else "div", name()) + (part("div", 0, rng.integers(1, 7), 0.0, name()) if chance(0.5) else "")
        end = links("div", "div", name()) + (rights("div") if chance(0.7) else part("div", 0, rng.integers(1, 8), 0.5))
        return top + "".join(body(False, inner)) + pick(links, teasers, lambda: "")() + end

    def wiki() -> str:
        rows = [heading("h1")]
        for _ in range(rng.integers(2, 6)):
            rows += [heading(), paragraph(), "<ul>" + "".join(part("li", 1, rng.integers(8, 40), pick(0, 0.1, 0.2)) for _ in range(rng.integers(2, 7))) + "</ul>"]
        return f"<div class='menu'>{links()}</div><div id='body'>{''.join(rows)}</div>{links('div', 'div', pick('', 'footer'))}"

    def bare() -> str:
        return "".join(body(False))

    return ["<body>" + pick(semantic, semantic, classed, classed, plain, plain, plain, wiki, bare)() for _ in range(n)]


@functools.cache
def train() -> Tree:
    """The tree of the labelled pages, densities in steps of 0.02."""
    rows, labels = [], []
    for page in labelled_pages():
        found = [b for b in blocks(page) if b.label is not None]
        every = blocks(page)
        x = features(every)
        keep = [k for k, b in enumerate(every) if b.label is not None]
        rows.append(x[keep])
        labels += [b.label for b in found]
    return grow(np.round(np.vstack(rows) * 50) / 50, np.array(labels, float), depth=9, least=4)


def main_text(page: str | None, tree: Tree) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, row in zip(found, features(found).tolist()) if decide(tree, row))


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), source: str = "html") -> DataFrame:
    """keep columns, text, n_chars."""
    tree = train()
    chosen = pages.select(*keep, pages[source].alias("__html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name != "__html") + ", text string, n_chars long"

    def run(batches):
        for b in sliced(batches):
            texts = [main_text(p, tree) for p in b.column("__html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return chosen.mapInArrow(run, schema)
