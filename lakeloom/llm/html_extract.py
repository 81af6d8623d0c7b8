"""Main text of web pages: gradient-boosted trees rate the nodes of a page's tree, and a decoding over the tree keeps
the choices of ancestors and descendants in agreement.

The trees are learnt from pages that mark their article themselves. On half of these the marking is hidden from the
features, so that density, links, attributes and place in the tree must tell too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.runtime import record, small_batches, texts, tidy

ROWS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
#: Pages, least by a hash of page_id and url, from which the trees are learnt; the longest such page; and how many times
#: as many are looked at, so that enough are left of those that are short enough.
LEARN_PAGES, LEARN_CHARS, LOOKED_AT = 400, 200_000, 3
#: Places for hashed tokens of attributes, and the counts that a token listed below begins with.
TOKEN_PLACES, PRIOR = 1 << 13, 6.0
TREES, DEPTH, RATE, BINS = 40, 4, 0.25, 32

#: HTML's elements without content, those whose content is no markup, those that are no text of the page
#: (its head, scripts, styles and fields of forms), inline ones, and those that end an open p or one another.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes".split())
HIDDEN = frozenset("head script style template textarea select option".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mi mo mn ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder semantics svg g text tspan path".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
BARRIER = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",), "option": ("select",)}
#: Words of class, id and role that are taken to speak for the article and against it, as far as the pages
#: that are learnt from don't say otherwise.
FOR = frozenset("article articlebody body content entry main maincontent post story text".split())
AGAINST = frozenset("ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer form gdpr header legal links login masthead menu nav navbar navigation newsletter notice pagination popup promo promoted related replies reply reviews search share sharing sidebar signup social sponsor sponsored subscribe tags toolbar widget".split())
SECTIONS = frozenset("nav aside footer header form menu dialog".split())
KINDS = ("p", "h", "list", "cell", "div", "section", "marked", "aside", "quote", "other")
_KIND = {"p": "p", "pre": "p", "h1": "h", "h2": "h", "h3": "h", "h4": "h", "h5": "h", "h6": "h", "li": "list", "ul": "list", "ol": "list", "dl": "list", "dt": "list", "dd": "list", "td": "cell", "th": "cell", "tr": "cell", "table": "cell", "tbody": "cell", "div": "div", "section": "section", "body": "section", "html": "section", "article": "marked", "main": "marked", "nav": "aside", "aside": "aside", "footer": "aside", "header": "aside", "form": "aside", "menu": "aside", "dialog": "aside", "button": "aside", "blockquote": "quote", "figure": "quote", "figcaption": "quote"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>?", re.S)
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_UNSEEN = re.compile(r"(?:^|\s)hidden(?:[\s=]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")


@dataclass
class Tree:
    """Nodes of block elements, in page order, and the blocks of text that stand right in them."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    tokens: list[frozenset[str]] = field(default_factory=list)
    hidden: list[bool] = field(default_factory=list)
    #: Whether the element, or one around it, says that it isn't shown; and whether it was planted by with_noise().
    unseen: list[bool] = field(default_factory=list)
    planted: list[bool] = field(default_factory=list)
    blocks: list[tuple[int, str, int]] = field(default_factory=list)

    def add(self, parent: int, tag: str, tokens: frozenset[str] = frozenset(), unseen: bool = False, planted: bool = False) -> int:
        above = parent >= 0
        self.parent.append(parent)
        self.tag.append(tag)
        self.tokens.append(tokens)
        self.hidden.append(above and self.hidden[parent] or tag in HIDDEN)
        self.unseen.append(above and self.unseen[parent] or unseen)
        self.planted.append(above and self.planted[parent] or planted)
        return len(self.parent) - 1


def parse(html: str) -> Tree:
    """The page's tree. Open elements end where HTML ends them; text of a block is unescaped, each run of white space in
    it is one space, and its third field is the length of its text in links. The places of open elements are kept by
    tag, so the work grows with the page and not with its depth."""
    tree = Tree()
    stack: list[tuple[str, int]] = [("", tree.add(-1, ""))]
    open_: dict[str, list[int]] = {}
    parts: list[str] = []
    linked, links, at, n = 0, 0, 0, len(html)

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text and not tree.hidden[stack[-1][1]]:
                tree.blocks.append((stack[-1][1], text, min(linked, len(text))))
            parts, linked = [], 0

    def last(tags: tuple[str, ...]) -> int:
        return max((x[-1] for t in tags if (x := open_.get(t))), default=0)

    def end(tags: tuple[str, ...], barrier: tuple[str, ...] = ()) -> bool:
        """End the innermost open element of these tags, unless one of the barrier is within it."""
        k = last(tags)
        if not k or last(barrier) > k:
            return False
        flush()
        for tag, _ in stack[k:]:
            open_[tag].pop()
        del stack[k:]
        return True

    while at < n:
        m = _TOKEN.search(html, at)
        upto = m.start() if m else n
        if upto > at:
            parts.append(html[at:upto])
            linked += (upto - at) * (links > 0)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in INLINE:
                links -= tag == "a" and links > 0
            elif not end((tag,)) and tag == "p":  # an empty paragraph
                flush()
            continue
        if tag in VOID:
            if tag == "br" or tag == "wbr":
                parts.append(" " * (tag == "br"))
            elif tag == "hr":
                flush()
                end(("p",), ("table", "td", "th"))
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>?", re.I).search(html, at)
            at = close.end() if close else n
            continue
        if tag in INLINE:
            links += tag == "a"
            continue
        flush()
        links = 0
        if tag in ENDS_P:
            end(("p",), ("table", "td", "th", "button", "object"))
        while tag in SAME_ENDS and end(SAME_ENDS[tag], BARRIER[tag]):
            pass
        up = stack[-1][1]
        said = m[3] or ""
        words = frozenset(w.lower() for g in _ATTRIBUTE.findall(said) for w in _SPLIT.split(g[0] or g[1] or g[2]) if w) if "=" in said else frozenset()
        node = tree.add(up, tag, words, bool(said and _UNSEEN.search(said)), PLANTED in said)
        open_.setdefault(tag, []).append(len(stack))
        stack.append((tag, node))
    flush()
    return tree


#: The attribute by which with_noise() marks what it plants.
PLANTED = "data-lakeloom-planted"
#: Tags and tokens by which an element says that it is the article.
MARKS = frozenset(["article", "main", "articlebody"])


def place(token: str) -> int:
    return crc32(token.encode()) % TOKEN_PLACES


def said_tokens(tree: Tree, i: int, marks: bool) -> list[str]:
    """Words of a node's class, id and role, and the tags that name a part of the page; without marks, none that speak for
    the article."""
    tag = tree.tag[i]
    found = [*tree.tokens[i], f"<{tag}>"] if tag in SECTIONS or tag in MARKS else list(tree.tokens[i])
    return found if marks else [t for t in found if t not in FOR and t.strip("<>") not in MARKS]


def token_weights(labelled: list[tuple[Tree, np.ndarray]]) -> np.ndarray:
    """By place of a token, the log-odds that a node with it is of the article, above those of any node. A listed token
    begins with some counts, one that never occurs weighs nothing."""
    counts = np.zeros((2, TOKEN_PLACES))
    for tree, y in labelled:
        for i in range(1, len(tree.parent)):
            for t in said_tokens(tree, i, True):
                counts[int(y[i]), place(t)] += 1
    n = counts.sum(axis=0)
    all_ = np.array([sum(len(y) - y.sum() for _, y in labelled), sum(y.sum() for _, y in labelled)]) + 1.0
    for words, k in ((FOR, 1), (AGAINST, 0)):
        for t in words:
            counts[k, place(t)] += PRIOR * 2 * all_[k] / all_.sum()
    counts[0, [place(f"<{t}>") for t in SECTIONS]] += PRIOR
    share = all_ / all_.sum()
    odds = np.log(counts[1] + share[1]) - np.log(counts[0] + share[0]) - np.log(share[1] / share[0])
    return np.where((n > 0) | (counts.sum(axis=0) > 0), np.clip(odds, -4, 4), 0.0)


FEATURES = 18 + len(KINDS)


def features(tree: Tree, weights: np.ndarray, marks: bool = True) -> np.ndarray:
    """A row for each node; without marks, elements that say they are the article look like any other."""
    n = len(tree.parent)
    own, link, words, marksum, blocks = (np.zeros(n) for _ in range(5))
    for node, text, linked in tree.blocks:
        own[node] += len(text)
        link[node] += linked
        words[node] += text.count(" ") + 1
        marksum[node] += sum(map(text.count, ".,;!?"))
        blocks[node] += 1
    total, total_link, size, total_blocks = own.copy(), link.copy(), np.ones(n), blocks.copy()
    depth, index, children, same = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    good, bad, good_up, bad_up, odds = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n), weights.tolist()
    kinds: dict[tuple[int, str], int] = {}
    for i, up in enumerate(tree.parent):
        tag = tree.tag[i]
        for t in said_tokens(tree, i, marks):
            w = odds[place(t)]
            good[i] += max(w, 0.0)
            bad[i] += max(-w, 0.0)
        if up >= 0:
            depth[i], index[i] = depth[up] + 1, children[up]
            good_up[i], bad_up[i] = good_up[up] + good[up], bad_up[up] + bad[up]
            children[up] += 1
            kinds[up, tag] = kinds.get((up, tag), 0) + 1
    for i in range(n - 1, 0, -1):
        up = tree.parent[i]
        total[up] += total[i]
        total_link[up] += total_link[i]
        size[up] += size[i]
        total_blocks[up] += total_blocks[i]
        same[i] = kinds[up, tree.tag[i]]
    up = np.maximum(np.array(tree.parent), 0)
    kind = np.zeros((n, len(KINDS)))
    for i, tag in enumerate(tree.tag):
        k = _KIND.get(tag, "other")
        kind[i, KINDS.index("div" if k == "marked" and not marks else k)] = 1
    cols = [own, total, total / size, link / np.maximum(own, 1), total_link / np.maximum(total, 1), total / max(1.0, total[0]), total / np.maximum(total[up], 1), depth, index, children[up], same, marksum / np.maximum(words, 1), own / np.maximum(words, 1), good, bad, np.minimum(good_up, 9), np.minimum(bad_up, 9), np.array(tree.unseen, float)]
    return np.concatenate([np.stack(cols, axis=1), kind], axis=1)


def weak_labels(tree: Tree) -> np.ndarray | None:
    """Per node whether it is in an element that is marked as the article, in no other part of the page within it, and not
    planted; None if the page marks none."""
    n = len(tree.parent)
    inside, other = np.zeros(n, bool), np.array(tree.planted, bool)
    for i, up in enumerate(tree.parent):
        tag, tokens = tree.tag[i], tree.tokens[i]
        inside[i] = up >= 0 and inside[up] or tag in MARKS or bool(tokens & MARKS)
        other[i] |= up >= 0 and other[up] or tag in SECTIONS
    return inside & ~other if inside.any() else None


def plain_labels(tree: Tree) -> np.ndarray:
    """Where no page marks its article: running text that is not in links and in nothing that is listed or planted."""
    f = features(tree, token_weights([]))
    return (f[:, 0] > 80) & (f[:, 3] < 0.3) & (f[:, 14] + f[:, 16] == 0) & ~np.array(tree.planted, bool)


@dataclass
class Boosted:
    """Oblivious regression trees on binned features: a level asks one question of all its nodes."""

    edges: list[np.ndarray]
    base: float
    questions: np.ndarray
    values: np.ndarray
    weights: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> "Boosted":
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        bins = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
        base = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        score, questions, values = np.full(len(y), base), [], []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            g, h, leaf, asked = y - p, p * (1 - p), np.zeros(len(y), np.int64), []
            for level in range(DEPTH):
                best = (-1.0, 0, 0)
                for f in range(x.shape[1]):
                    cells = leaf * BINS + bins[:, f]
                    gs = np.bincount(cells, g, (1 << level) * BINS).reshape(-1, BINS).cumsum(axis=1)
                    hs = np.bincount(cells, h, (1 << level) * BINS).reshape(-1, BINS).cumsum(axis=1)
                    gain = (gs**2 / (hs + 1) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + 1)).sum(axis=0)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), f, k)
                asked.append(best[1:])
                leaf = 2 * leaf + (bins[:, best[1]] > best[2])
            v = RATE * np.bincount(leaf, g, 1 << DEPTH) / (np.bincount(leaf, h, 1 << DEPTH) + 1)
            score += v[leaf]
            questions.append(asked)
            values.append(v)
        return Boosted(edges, base, np.array(questions), np.array(values), weights)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        bins = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], axis=1)
        out = np.full(len(x), self.base)
        for asked, v in zip(self.questions, self.values, strict=True):
            leaf = np.zeros(len(x), np.int64)
            for f, k in asked:
                leaf = 2 * leaf + (bins[:, f] > k)
            out += v[leaf]
        return out


#: What is put into every third page that trees are learnt from, with a paragraph of another page: boilerplate that
#: reads like an article.
NOISE = ('<div class="comments"><h3>{0}</h3><p>{1}</p></div>', '<div id="sidebar"><p>{1}</p></div>', '<aside><p>{1}</p><p>{0}</p></aside>', '<div class="cookie-notice">{1}</div>', '<form><p>{1}</p></form>', '<div class="related-posts"><ul><li>{0}</li><li>{1}</li></ul></div>', '<section class="replies"><div class="reply"><p>{1}</p></div></section>', '<div class="newsletter signup"><p>{1}</p></div>', '<header class="site-header"><p>{1}</p></header>', '<div class="share-links"><button>{0}</button></div>')


def with_noise(pages: list[str]) -> list[str]:
    out = []
    for k, page in enumerate(pages):
        if k % 3 == 0:
            other = pages[(k * 7 + 1) % len(pages)]
            parts = sorted((x for x in re.findall(r"<p>([^<>]*)", other)[:40]), key=len) or [""]
            noise = NOISE[k // 3 % len(NOISE)].format(parts[0][:80], parts[-1])
            noise = re.sub(r"^<[a-z]+", lambda m: f"{m[0]} {PLANTED}", noise)
            cut = page.rfind("</article>") if k % 2 else page.find("<article")
            cut = cut + len("</article>") * (k % 4 == 1) if cut >= 0 else len(page)
            page = page[:cut] + noise + page[cut:]
        out.append(page)
    return out


def learn(pages: DataFrame) -> Boosted:
    """Trees from a bounded set of pages (page_id, url, html). A hash of page_id and url passes a share of all pages that
    leaves some hundreds, however many there are, so the driver's part doesn't grow with the table; rows that repeat a
    page_id and url are one page."""
    key, bound = F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 40)), 1 << 40
    n = pages.count()
    share = min(bound, -(-bound * LOOKED_AT * LEARN_PAGES // max(n, 1)))
    some = pages.withColumn("key", key).filter(F.col("key") < share).filter(F.coalesce(F.length("html"), F.lit(0)).between(1, LEARN_CHARS))
    some = some.groupBy("key", "page_id", "url").agg(F.min("html").alias("html"))
    chosen = some.orderBy("key", "page_id", "url").limit(LEARN_PAGES).select("html").collect()
    trees = [parse(h) for h in with_noise([r["html"] for r in chosen])]
    marked = [(t, y) for t in trees if (y := weak_labels(t)) is not None]
    labelled = marked or [(t, plain_labels(t)) for t in trees]
    weights = token_weights(labelled)
    x = [features(t, weights, marks=bool(k % 2)) for k, (t, _) in enumerate(labelled)] or [np.zeros((1, FEATURES))]
    y = [y for _, y in labelled] or [np.zeros(1)]
    return Boosted.fit(np.concatenate(x), np.concatenate(y).astype(np.float64), weights)


OPEN, KEPT, DROPPED = range(3)
#: What may stand right under what: below an open node anything, below a kept one no open one, below a dropped one only
#: dropped ones.
_UNDER = ((OPEN, KEPT, DROPPED), (KEPT, DROPPED), (DROPPED,))
#: Cost of leaving a node open, and of a change from kept to dropped.
OPEN_COST, TURN_COST = 0.2, 1.0


def decode(tree: Tree, score: np.ndarray) -> np.ndarray:
    """Per node whether its own text is kept: the best choice of states for all nodes together. Kept text counts by its
    score, weighted by its length; an open node holds both and keeps none of its own."""
    n = len(score)
    own = np.zeros(n)
    for node, text, _ in tree.blocks:
        own[node] += len(text)
    weight = 0.1 + np.sqrt(own)
    s = np.clip(score, -8, 8) * weight
    value = np.zeros((n, 3))
    value[:, KEPT], value[:, DROPPED] = np.minimum(s, 0), np.minimum(-s, 0)
    value[:, OPEN] = -OPEN_COST - np.where(own > 0, np.maximum(s, 0), 0)
    if n == 1:  # no markup at all
        return np.ones(1, bool)
    best = np.zeros((n, 3), np.int8)
    rows = value.tolist()
    for i in range(n - 1, 0, -1):
        mine, up = rows[i], rows[tree.parent[i]]
        for state in range(3):
            choice = max(_UNDER[state], key=lambda c: mine[c] - (TURN_COST if state == KEPT and c == DROPPED else 0))
            best[i, state] = choice
            up[state] += mine[choice] - (TURN_COST if state == KEPT and choice == DROPPED else 0)
    state = np.zeros(n, np.int8)
    state[0] = max(range(3), key=lambda c: rows[0][c])
    for i in range(1, n):
        state[i] = best[i, state[tree.parent[i]]]
    return state == KEPT


def extract(pages: list[str], model: Boosted) -> list[str]:
    """Main text of each page: its kept blocks in page order, joined by line feeds."""
    trees = [parse(p) for p in pages]
    if not trees:
        return []
    scores = model.score(np.concatenate([features(t, model.weights) for t in trees]))
    out, at = [], 0
    for t in trees:
        keep = decode(t, scores[at : at + len(t.parent)])
        at += len(t.parent)
        out.append("\n".join(text for node, text, _ in t.blocks if keep[node]))
    return out


def extract_main_text(pages: DataFrame, model: Boosted | None = None) -> DataFrame:
    """Per row of pages (page_id, url, html; null: empty): page_id, url, text, n_chars.

    The whole html is read, however deep its elements are nested; text is empty where the page has no article. Scripts,
    styles, the head, and fields of forms are no text; all else, what says that it isn't shown too, is judged by the
    trees. Repeated rows and null ids or urls stay as they
    are; an empty table gives no rows. One pass; the model is learnt from a bounded set of the pages."""
    small_batches(pages.sparkSession)
    pages = pages.select("page_id", "url", "html")
    shared = pages.sparkSession.sparkContext.broadcast(model or learn(pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = texts(batch, "html"), []
            for k in range(0, len(rows), 64):
                found += extract(rows[k : k + 64], shared.value)
            yield record(ROWS, page_id=batch.column("page_id"), url=batch.column("url"), text=found, n_chars=[len(t) for t in found])

    return pages.mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")
