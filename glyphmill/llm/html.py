"""Operator 3: main text of web pages by a tree-structured graphical model.

The block elements of a page are nodes of a tree; each is content or not. A logistic
model of a node's tag, names, links and length, and of the names above it, gives its own evidence, potentials
between parent and child tie labels together, and sum-product messages up and down the
tree give each node's marginal. The text of nodes that are more likely content than
not is the page's main text.

Both are trained on labelled pages: drawn pages with one <article>, as they are and
rebuilt with other containers and with boilerplate of many kinds around and inside.
Messages run on arrays, for all pages of a batch at once, one depth after another.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.shared import ship

#: The pages that training draws at most, the characters of a page that may be drawn, and the rebuilt pages made of each.
SAMPLE_PAGES, SAMPLE_CHARS, REBUILT = 300, 200_000, 5
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?/][^>]*+>""", re.S
)
#: A tag with a quote that is never closed ends at the next '>'.
ODD_TOKEN = re.compile(r"<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>[^>]*+)>")
ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br picture source".split()
)
#: Controls and drawings: what stands in them is no text of the page.
CONTROLS = frozenset("button svg select canvas object audio video".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tr": {"table"}, "option": {"select"}}
#: What words in a class, id or role speak of.
GROUPS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs tabs toolbar pagination pager skip",
    "header": "header masthead topbar logo brand hero",
    "footer": "footer foot copyright legal colophon contentinfo",
    "side": "sidebar side aside widget rail complementary related recommended recommendations trending popular more",
    "notice": "cookie cookies consent gdpr notice notification alert banner popup modal overlay dialog disclaimer warning paywall",
    "advert": "ad ads advert advertisement advertising adsense sponsor sponsored promo promotion promoted",
    "form": "form search login signin signup subscribe subscription newsletter register contact poll",
    "comments": "comment comments commentlist reply replies discussion disqus respond feedback reviews",
    "share": "share sharing social follow like twitter facebook print tools meta tags byline",
    "content": "content article post entry story text main body blog maincontent articlebody",
}
#: Elements that speak for what is below them, as words in a class, id or role do, and the words and elements that hold content.
TOLD = frozenset("nav header footer aside form menu article main".split())
CONTENT_BOXES = frozenset({"article", "main", "content"})
GROUP_OF = {word: group for group, words in GROUPS.items() for word in words.split()}


class Page:
    """The block nodes of a page in order: parent, features, label of its own if marked; runs are (node, text)."""

    __slots__ = ("parent", "depth", "features", "article", "chars", "linked", "own", "under", "runs")

    def __init__(self, html: str):
        self.parent, self.depth, self.features, self.article = [-1], [0], [["tag=root"]], [False]
        self.chars, self.linked, self.own = [0], [0], [0]
        self.under: list[frozenset[str]] = [frozenset()]
        self.runs: list[tuple[int, str]] = []
        self._read(html)
        for v in range(len(self.parent) - 1, 0, -1):
            self.chars[self.parent[v]] += self.chars[v]
            self.linked[self.parent[v]] += self.linked[v]
        size = lambda n: min(6, len(str(n)) * 2 - (str(n)[0] < "4")) if n else 0
        boxes = {v for v, under in enumerate(self.under) if under & CONTENT_BOXES}
        for v, (f, chars, linked) in enumerate(zip(self.features, self.chars, self.linked, strict=True)):
            share = linked / chars if chars else 0.0
            links = "all" if share > 0.8 else "many" if share > 0.3 else "some" if share else "none"
            outer = self.under[self.parent[v]] if v else frozenset()
            place = "inside" if outer & CONTENT_BOXES else "beside" if boxes else "alone"
            f += [f"chars={size(chars)}", f"own={size(self.own[v])}", f"{f[0]} {'text' if self.own[v] else 'no text'}", f"links={links}", f"{f[0]} links={links}", f"{place} links={links}", f"{f[0]} {place}", *(f"under={g}" for g in outer)]

    def _read(self, html: str) -> None:
        open_: list[tuple[str, int]] = [("", 0)]  # element, and the block node it stands in
        places: dict[str, list[int]] = {}  # of each tag, where in open_ it stands
        piece: list[str] = []
        unclosed: set[str] = set()  # controls of which no more end is to come
        links = linked = at = 0

        def flush() -> None:
            nonlocal linked
            text = " ".join("".join(piece).split())
            piece.clear()
            if text:
                node = open_[-1][1]
                self.runs.append((node, text))
                self.chars[node] += len(text)
                self.own[node] += len(text)
                self.linked[node] += min(linked, len(text))
            linked = 0

        def opened(tag: str, node: int) -> None:
            places.setdefault(tag, []).append(len(open_))
            open_.append((tag, node))

        def leave(tags: Iterable[str], scope: Iterable[str] = ()) -> None:
            """Close the innermost open element of these, unless one of the scope is inside it."""
            nonlocal links
            innermost = lambda names: max((places[t][-1] for t in names if places.get(t)), default=0)
            k = innermost(tags)
            if not k or innermost(scope) > k:
                return
            if any(t not in INLINE for t, _ in open_[k:]):
                flush()
            for t, _ in open_[k:]:
                places[t].pop()
                links -= t == "a"
            del open_[k:]

        end = len(html)
        last = html.rfind(">")
        while at < end:
            m, mark = None, html.find("<", at, last + 1)
            while mark >= 0 and not (m := TOKEN.match(html, mark) or ODD_TOKEN.match(html, mark)):
                mark = html.find("<", mark + 1, last + 1)
            if not m and html.startswith("<!--", mark := html.find("<!--", max(at, last))):
                m = TOKEN.match(html, mark)
            text = unescape(html[at : m.start() if m else end])
            if text:
                piece.append(text)
                if links:
                    linked += len(text.strip())
            if not m:
                break
            at = m.end()
            tag = (m["tag"] or "").lower()
            if not tag:
                continue
            if m["end"]:
                if tag not in RAW:
                    leave({tag}, {"table", "td", "th"} if tag not in ("table", "tr", "td", "th", "body", "html") else frozenset())
                continue
            if tag == "br":
                piece.append(" ")
                continue
            if tag in RAW:
                close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
                at = close.end() if close else end
                continue
            if tag in CONTROLS and tag not in unclosed:
                if close := re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at):
                    piece.append(" ")
                    at = close.end()
                    continue
                unclosed.add(tag)  # it is read as any element
            if tag in VOID:
                if tag == "hr":
                    leave({"p"}, {"table", "td", "th", "button"})
                    flush()
                continue
            if tag in INLINE:
                opened(tag, open_[-1][1])
                links += tag == "a"
                continue
            if tag in CLOSES_P:
                leave({"p"}, {"table", "td", "th", "button"})
            if tag in SIBLINGS:
                leave(SIBLINGS[tag], SCOPES[tag])
            flush()
            node, above = len(self.parent), open_[-1][1]
            names = {GROUP_OF[w] for a in ATTRIBUTE.finditer(m["attrs"]) for w in map(str.lower, NAME.findall(a[2] or a[3] or a[4] or "")) if w in GROUP_OF}
            self.parent.append(above)
            self.depth.append(self.depth[above] + 1)
            self.features.append([f"tag={tag}", *(f"name={g}" for g in names)])
            self.under.append(self.under[above] | names | ({tag} & TOLD))
            self.article.append(tag == "article")
            self.chars.append(0)
            self.linked.append(0)
            self.own.append(0)
            opened(tag, node)
        flush()

    def labels(self) -> np.ndarray | None:
        """Content is what stands in the page's one <article>; None if there is not one."""
        if sum(self.article) != 1:
            return None
        inside = list(self.article)
        for v in range(1, len(inside)):
            inside[v] |= inside[self.parent[v]]
        return np.array(inside)


#: Containers of content, and of boilerplate, that training rebuilds pages with; what stands inside them, with sentences for the numbers.
CONTAINERS = (
    "article", "article", "article", 'article class="post"', "main", "div", "div", 'div class="content"', 'div id="main-content"', 'div class="post-body"', 'section class="entry"',
    'div class="article-text"', 'div role="main"', 'div class="story"', "section",
)
BOILERPLATE = (
    "nav", "header", "footer", "aside", "form", 'div class="menu"', 'ul class="breadcrumbs"', 'div id="header"', 'div class="sidebar"', 'div class="cookie-notice"',
    'div class="ad"', 'div class="advert banner"', 'section class="promo"', 'div class="newsletter-signup"', 'div id="comments"', 'section class="comments"',
    'div class="comment"', 'article class="comment"', 'article class="comment"', 'div class="share-tools"', 'div class="related"', 'div id="footer"', 'div class="alert"', 'div class="widget"',
    'div role="navigation"', 'header class="site-header"', "footer", "footer",
)
CONTENT = (
    "<p>{0}</p>", "<p>{0}</p>", "<p>{0} {1}</p>", "<p>{0} <a href=/x>{1}</a> {2}</p>", "<ul><li>{0}</li><li>{1}</li></ul>", "<ol><li>{0}</li><li>{1}</li><li>{2}</li></ol>",
    "<ul><li>{0} <a href=/x>{1}</a></li><li>{2}</li></ul>", "<ul><li><p>{0}</p></li></ul>", "<table><tr><th>{0}</th><th>{1}</th></tr><tr><td>{2}</td><td>{0}</td></tr></table>",
    "<table><tbody><tr><td>{0}</td></tr></tbody></table>", "<table><caption>{0}</caption><thead><tr><th>{1}</th></tr></thead></table>", "<pre>{0}</pre>", "<pre><code>{0}</code></pre>",
    "<blockquote>{0}</blockquote>", "<blockquote><p>{0}</p></blockquote>", "<figure><img src=x><figcaption>{0}</figcaption></figure>", "<dl><dt>{0}</dt><dd>{1}</dd></dl>", "<h1>{0}</h1>",
    "<h2>{0}</h2>", "<h3>{0}</h3>", "<h4>{0}</h4>", "<h5>{0}</h5>", "<h6>{0}</h6>", "<section><h2>{0}</h2><p>{1}</p></section>", "<section><h3>{0}</h3><ul><li>{1}</li></ul></section>",
    "<div><p>{0}</p><p>{1}</p></div>", "<div>{0}</div>", "<details><summary>{0}</summary><p>{1}</p></details>", "<address>{0}</address>", "<div><h4>{0}</h4><div>{1}</div></div>",
)
LINKED = ("<ul><li><a href=/x>{0}</a></li><li><a href=/y>{1}</a></li></ul>", "<ol><li><a href=/x>{0}</a></li><li><a href=/y>{1}</a></li><li><a href=/z>{2}</a></li></ol>", "<p><a href=/x>{0}</a></p>")
COMMENTS = (
    '<div id="comments">{0}</div>', '<section class="comments"><h3>{1}</h3>{0}</section>', '<ol class="comment-list"><li>{0}</li></ol>', '<ol class="commentlist"><li>{1}</li><li><p>{1}</p></li></ol>',
    '<ul class="comments"><li><b>{2}</b> <p>{1}</p></li><li><p>{1}</p><p>{2}</p></li></ul>', '<div class="comments"><ul><li><b>{2}</b><p>{1}</p></li></ul></div>', '<section id="comments"><h2>{2}</h2><p>{1}</p><p>{1}</p></section>',
    '<section class="comments"><article><p>{1}</p></article><article><h4>{2}</h4><p>{1}</p></article></section>', '<div id="comments"><h3>{2}</h3><div><p>{1}</p></div><div><blockquote>{1}</blockquote></div></div>',
)
PLAIN = "<html><body><nav><ul><li><a href=/>home</a></li><li><a href=/news>news</a></li></ul></nav><article><h1>One title of a page</h1><p>The first paragraph of the text is here, and it is long enough to be read.</p><p>A second one follows.</p></article><footer>All rights reserved.</footer></body></html>"


def rebuilt(html: str, rng: random.Random) -> str | None:
    """Another page from a page with one <article>: its content in another container, its other texts, and some of its sentences, as boilerplate.

    The container and the boilerplate are marked by attributes that features don't see.
    """
    m = re.search(r"<article\b[^>]*>(.*?)</article>", html, re.S | re.I)
    if not m or html.lower().count("<article") != 1:
        return None
    waste = [w for w in re.split(r"<[^>]*>", html[: m.start()].split("<body", 1)[-1] + html[m.end() :]) if w.strip()] or ["more"]
    sentences = [w for w in re.split(r"<[^>]*>", m[1]) if len(w.split()) > 2] or waste

    def piece() -> str:
        kind = rng.choice(BOILERPLATE)
        said = rng.choice(waste) if rng.random() < 0.6 else rng.choice(sentences)
        form = rng.choice(
            ("{0}", "<p>{0}</p>", "<p>{0}</p><p>{0}</p>", "<ul><li><a href=/x>{0}</a></li><li><a href=/y>{0}</a></li></ul>", "<h3>{0}</h3><p>{0}</p>", "<div>{0}</div>", "<ul><li>{0}</li></ul>", "<h4>{0}</h4><a href=/x>{0}</a>")
        )
        made = f"<{kind} data-waste=1>{form.format(said)}</{kind.split()[0]}>"
        if "comment" in kind and rng.random() < 0.8:
            made = rng.choice(COMMENTS).format(made * rng.randrange(1, 3), said, rng.choice(sentences)).replace(" ", " data-waste=1 ", 1)
        return made

    def block() -> str:
        size = rng.choice((2, 4, 8, 16, 60))
        return rng.choice(CONTENT if rng.random() < 0.85 else LINKED).format(*(" ".join(rng.choice(sentences).split()[:size]) for _ in range(3)))

    if rng.random() < 0.15:  # text without elements of its own, alone or between boilerplate
        said = [" ".join(rng.choice(sentences).split()[: rng.choice((3, 10, 40))]) for _ in range(rng.randrange(1, 5))]
        form = rng.choice(("{0}", "{0}", "{0}", "<center data-main=1><font>{0}</font></center>", "<p data-main=1>{0}</p>", "<div data-main=1>{0}</div>", "<td data-main=1>{0}</td>"))
        told = form.format(rng.choice(("<br>", "<br><br>", " ")).join(said))
        wrap = rng.random()
        if form == "{0}":
            return told if wrap < 0.4 else f"<html data-main=1><body data-main=1>{piece() if wrap < 0.7 else ''}{told}{piece() if wrap > 0.6 else ''}</body></html>"
        return told if wrap < 0.3 else f"<html><body>{piece() if wrap < 0.7 else ''}{told}{piece() if wrap > 0.5 else ''}</body></html>"
    box = rng.choice(CONTAINERS)
    blocks = re.split(r"(?=<p\b|<h[1-6]\b)", m[1])
    if rng.random() < 0.25:  # some articles are short
        kinds = (rng.choice(("h1", "h2", "p", "p")) for _ in range(rng.randrange(1, 4)))
        blocks = [f"<{k}>{' '.join(rng.choice(sentences).split()[: rng.randrange(1, 12)])}</{k}>" for k in kinds]
    for _ in range(rng.choice((0, 2, 4, 8))):  # and of many kinds of elements
        blocks.insert(rng.randrange(1, len(blocks) + 1), block())
    for _ in range(rng.choice((0, 1, 2, 3))):
        blocks.insert(rng.randrange(1, len(blocks) + 1), piece())
    inner = "".join(blocks)
    around = [piece() for _ in range(rng.randrange(2, 7))]
    cut = rng.randrange(len(around) + 1)
    body = f"{''.join(around[:cut])}<{box} data-main=1>{inner}</{box.split()[0]}>{''.join(around[cut:])}"
    if rng.random() < 0.5:
        body = f"<div class={rng.choice(('wrapper', 'page', 'container', 'layout'))}>{body}</div>"
    return f"<html><body>{body}</body></html>"


class Marked(Page):
    """A page of training whose containers carry marks."""

    __slots__ = ("mark",)

    def _read(self, html: str) -> None:
        super()._read(html)
        marks = [m["attrs"] for m in TOKEN.finditer(html) if m["tag"] and not m["end"] and (t := m["tag"].lower()) not in INLINE and t not in VOID and t not in RAW]
        self.mark = [not marks or bool(self.own[0])] + ["data-main" in a or None if "data-waste" not in a else False for a in marks]

    def labels(self) -> np.ndarray | None:
        out = [bool(x) for x in self.mark]
        for v in range(1, len(out)):
            out[v] = out[self.parent[v]] if self.mark[v] is None else bool(self.mark[v])
        return np.array(out)


class Model:
    """Weights of features, and potentials[parent's label, child's label], as logarithms."""

    def __init__(self, pages: list[tuple[Page, np.ndarray]]):
        names = sorted({f for p, _ in pages for fs in p.features for f in fs})
        self.number = {f: i + 1 for i, f in enumerate(names)}
        y = np.concatenate([v for _, v in pages]).astype(float)
        x = np.zeros((len(y), len(names) + 1))
        x[:, 0] = 1
        row = 0
        pairs = np.ones((2, 2))
        for p, v in pages:
            for fs in p.features:
                x[row, [self.number[f] for f in fs]] = 1
                row += 1
            np.add.at(pairs, (v[np.array(p.parent[1:], int)].astype(int), v[1:].astype(int)), 1)
        w = np.zeros(x.shape[1])
        for _ in range(12):  # Newton's method with a ridge
            q = 1 / (1 + np.exp(-x @ w))
            w += np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + np.eye(len(w)), x.T @ (y - q) - w)
        self.weights = w
        pairs /= pairs.sum()
        self.potentials = np.log(pairs / pairs.sum(1, keepdims=True) / pairs.sum(0, keepdims=True))

    def marginals(self, pages: list[Page]) -> np.ndarray:
        """The probability of content, for all nodes of all pages one after the other."""
        sizes = [len(p.parent) for p in pages]
        offset = np.repeat(np.cumsum([0, *sizes[:-1]]), sizes)
        parent = np.array([v for p in pages for v in p.parent]) + offset
        depth = np.array([d for p in pages for d in p.depth])
        get = self.number.get
        flat = np.array([w for p in pages for fs in p.features for w in (0, *(get(f, -1) for f in fs))])
        ends = np.cumsum([len(fs) + 1 for p in pages for fs in p.features])
        values = np.where(flat >= 0, self.weights[flat], 0.0)
        own = np.zeros((len(parent), 2))  # log evidence
        own[:, 1] = np.add.reduceat(values, np.concatenate([[0], ends[:-1]]))
        belief = own.copy()  # own evidence and the messages of all children
        upward = np.zeros_like(own)
        levels = np.split(np.argsort(depth, kind="stable"), np.cumsum(np.bincount(depth))[:-1])
        for rows in levels[:0:-1]:
            m = belief[rows][:, None, :] + self.potentials[None]
            upward[rows] = np.logaddexp(m[:, :, 0], m[:, :, 1])
            np.add.at(belief, parent[rows], upward[rows])
        for rows in levels[1:]:  # a parent's message leaves out what it heard from the child
            rest = belief[parent[rows]] - upward[rows]
            m = rest[:, :, None] + self.potentials[None]
            down = np.logaddexp(m[:, 0, :], m[:, 1, :])
            belief[rows] += down - down.mean(1, keepdims=True)
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500)))

    def texts(self, htmls: list[str | None]) -> list[str]:
        """The main text of each page; empty if there is none."""
        pages = [Page(h or "") for h in htmls]
        if not pages:
            return []
        content = self.marginals(pages) > 0.5
        out, at = [], 0
        for p in pages:
            out.append(" ".join(t for v, t in p.runs if content[at + v]))
            at += len(p.parent)
        return out


def train(htmls: list[str], seed: int = 5) -> Model:
    rng = random.Random(seed)
    pages = []
    for html in [*htmls, PLAIN]:
        page = Page(html)
        if (labels := page.labels()) is None:
            continue
        pages.append((page, labels))
        for _ in range(REBUILT):
            if made := rebuilt(html, rng):
                twin = Marked(made)
                pages.append((twin, twin.labels()))
    return Model(pages)


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE_PAGES) -> Model:
    """A model from the first pages by a hash of id and text, as far as they are labelled by one <article>, and one fixed page.

    At most ``sample`` pages, each of at most SAMPLE_CHARS characters, train. Pages are
    counted first, so that about twice as many are looked at in all, not as many from
    each partition; repeated rows are drawn once.
    Without labelled pages, or on an empty table, the fixed page and its rebuilt ones train alone.
    """
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{html_col}`").alias("html")).where(F.col("html").contains("<article") & (F.char_length("html") <= SAMPLE_CHARS))
    below = min(1 << 63, 2 * sample * (1 << 64) // max(1, rows.count()) - (1 << 63)) - 1
    near = rows.select("id", "html", F.xxhash64(F.lit(3), "id", "html").alias("order")).where(F.col("order") <= F.lit(below))
    first = near.dropDuplicates(["order"]).orderBy("order").limit(sample)
    return train([r["html"] for r in sorted(first.collect(), key=lambda r: (r["order"], str(r["id"]), r["html"]))])


def main_text(html: Column, spark_model) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from glyphmill.llm.shared import settle

        for htmls in batches:
            out: list[str] = []
            for at in range(0, len(htmls), 256):
                out += spark_model.value.texts([h if isinstance(h, str) else None for h in htmls[at : at + 256]])
            yield pd.Series(out, dtype=object)
        settle()

    return run(html)


def extract(pages: DataFrame, model: Model, html_col: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text; a column of that name is replaced.

    Null and empty pages have the empty text. Every row is read by itself and whole, repeated
    rows give repeated results, an empty table an empty one. Work is linear in a page's length.
    """
    spark = pages.sparkSession
    ship(spark)
    return pages.withColumn(out, main_text(F.col(f"`{html_col}`"), spark.sparkContext.broadcast(model)))
