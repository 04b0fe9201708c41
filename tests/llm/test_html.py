import random
import re
from html import unescape

import numpy as np
import pytest

from pyspark.sql import functions as F

from glyphmill.llm import html as L
from glyphmill.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pages(spark):
    return [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html").collect()]


@pytest.fixture(scope="module")
def model(pages):
    return L.train([h for _, h in pages[:120]])


def article(html):
    body = re.search(r"<article>(.*)</article>", html, re.S)[1]
    return " ".join(unescape(re.sub(r"</?b>", "", re.sub(r"<(?!/?b>)[^>]*>", " ", body))).split())


def test_query(spark):
    got = {r["page_id"]: r for r in QUERIES["op3_html"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        g = got[r["page_id"]]
        assert g["text"] == article(r["html"]) and g["n_chars"] == len(g["text"]) and g["url"] == r["url"]


def test_pages_that_training_did_not_see(model, pages):
    assert model.texts([h for _, h in pages[120:]]) == [article(h) for _, h in pages[120:]]
    rng, right, n = random.Random(99), 0, 0
    for _, h in pages[120:220]:
        page = L.Marked(L.rebuilt(h, rng))
        told, labels = model.marginals([page]) > 0.5, page.labels()
        with_text = {v for v, _ in page.runs}
        right, n = right + sum(told[v] == labels[v] for v in with_text), n + len(with_text)
    assert right / n > 0.97


def test_messages_give_exact_marginals(model):
    page = L.Page("<body><div class=content><p>one two three</p><ul><li><a href=x>four</a></li></ul></div><footer>five</footer></body>")
    n = len(page.parent)
    total = np.zeros(n)
    z = 0.0
    get = model.number.get
    own = [sum(model.weights[get(f)] for f in fs if get(f)) + model.weights[0] for fs in page.features]
    for code in range(2**n):
        y = [code >> v & 1 for v in range(n)]
        w = np.exp(sum(own[v] * y[v] for v in range(n)) + sum(model.potentials[y[page.parent[v]], y[v]] for v in range(1, n)))
        z += w
        total += w * np.array(y)
    assert np.allclose(model.marginals([page]), total / z, atol=1e-9)


def test_tags_and_references(model):
    html = "<html><head><title>t</title></head><body><header>Site</header><div class='content'><h1>Title</h1><p>Hello w&ouml;rld &amp; all.</p><aside>side</aside><p>More<b>bold</b> x<br>y</p>"
    html += "<div class=comments><p>I agree with this a lot.</p></div></div><div class='cookie-notice'><p>We use cookies</p></div><form><input><label>Name</label></form><footer>f</footer><script>if(a<b)x</script></body></html>"
    assert model.texts([html]) == ["Title Hello wörld & all. Morebold x y"]
    odd = ["", None, "<", "<!-- open", "<p", "<script>never closed", "&#0;&bogus;", "</p></div>", "<a href='x", "<table><tr><td>1<td>2</table>", "<p>" * 3000, "<div " + "x" * 50000]
    assert len(model.texts(odd)) == len(odd) and model.texts([]) == []


SAID = ["The council met on Monday to talk about the new bridge", "It will be built by the end of next year", "Costs have risen since the first plan"]


@pytest.mark.parametrize("box", ["article", "main", "div", 'div class="content"', 'section class="entry"'])
def test_no_kind_of_element_is_lost_and_comments_are(model, box):
    plain = lambda x: " ".join(re.sub(r"<[^>]*>", " ", x).split())
    every = [c.format(*SAID) for c in L.CONTENT]
    for kind in [*every, "".join(every)]:
        inner = f"<h1>A bridge for the town</h1><p>{SAID[0]}.</p><p>{SAID[1]}.</p>{kind}<p>{SAID[2]}.</p>"
        comment = "<article class=comment><p>I like this bridge a lot</p></article>"
        page = f"<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav><{box}>{inner}</{box.split()[0]}>"
        for after in (comment, f"<div id=comments>{comment}</div>"):
            assert model.texts([f"{page}{after}<footer><p>All rights reserved 2024</p></footer></body></html>"]) == [plain(inner)], kind


NAV, FOOT = "<nav><ul><li><a href=/>Home</a></li></ul></nav>", "<footer><p>All rights reserved 2024</p></footer>"
TOLD = "<h1>A bridge for the town</h1><p>The council met on Monday to talk about the new bridge.</p><p>It will be built by the end of next year.</p>"
TEXT = "A bridge for the town The council met on Monday to talk about the new bridge. It will be built by the end of next year."
READERS = (
    "<ol class=commentlist><li>I like it very much indeed</li><li>So do I, and my friend</li></ol>",
    "<section class=comments><h2>Two comments</h2><article><p>I like it very much indeed.</p></article><article><p>So do I</p></article></section>",
    "<div class=comments><ul><li><b>Ann</b><p>I like it very much indeed, said she.</p></li></ul></div>",
    "<section id=comments><h2>Comments</h2><p>I like it very much indeed.</p><p>So do I, and my friend too.</p></section>",
)


@pytest.mark.parametrize("box", ["article", "main", "div", "section", 'div class="content"'])
def test_comments_in_lists_and_sections_are_cut(model, box):
    end = f"</{box.split()[0]}>"
    for said in READERS:
        assert model.texts([f"<html><body>{NAV}<{box}>{TOLD}{said}{end}{FOOT}</body></html>", f"<html><body>{NAV}<{box}>{TOLD}{end}{said}{FOOT}</body></html>"]) == [TEXT] * 2, said


def test_text_in_few_elements_or_none(model):
    article = lambda inner: f"<html><body>{NAV}<article>{inner}</article>{FOOT}</body></html>"
    cases = {
        article(f"{TOLD}<ul><li><a href=/a>The first plan</a></li><li><a href=/b>The second plan</a></li></ul>"): f"{TEXT} The first plan The second plan",
        "<html><body>The council met on Monday.<br>It will be built soon.<br>Costs rise.</body></html>": "The council met on Monday. It will be built soon. Costs rise.",
        "<html><body><center><font>The council met on Monday.</font></center></body></html>": "The council met on Monday.",
        "<p>The council met on Monday.</p>": "The council met on Monday.",
        "<html><body><p>The council met on Monday.</p></body></html>": "The council met on Monday.",
        "<article><h1>T</h1><p>Yes.</p><p>No.</p></article>": "T Yes. No.",
        "The council met on Monday to talk about the new bridge.": "The council met on Monday to talk about the new bridge.",
        "Hello there": "Hello there",
        f"<html><body><header class=site-header><h1>The Daily</h1></header>{NAV}<article>{TOLD}</article>{FOOT}</body></html>": TEXT,
        article(f"{TOLD}<button>Share <b>this</b></button>"): TEXT,
        article(f"{TOLD}<svg><text>Logo</text></svg>"): TEXT,
        article(f"{TOLD}<footer>Filed under towns</footer>"): TEXT,
        article(f"{TOLD}<p>One<button>Share</button>two</p><button>never closed"): f"{TEXT} One two never closed",
    }
    assert dict(zip(cases, model.texts(list(cases)), strict=True)) == cases


def test_time_is_linear(model):
    import time

    for page in ("<div>" * 20_000, "<a " * 200_000, '<a "' * 100_000 + ">", "<p>" * 20_000, "<table><tr><td><p>" + "<div>" * 20_000, "<!--" * 100_000, "< " * 200_000 + ">", "<button>" * 50_000, "<svg>x" * 50_000):
        began = time.perf_counter()
        model.texts([page])
        assert time.perf_counter() - began < 20, page[:20]


def test_awkward(spark, awkward):
    frame = awkward.withColumnRenamed("doc_id", "page_id").withColumn("html", awkward["text"])
    fitted = L.fit(frame)
    assert L.extract(frame, fitted).count() == 9
    assert L.extract(frame.limit(0), L.fit(frame.limit(0))).count() == 0


def test_draw_of_pages(spark, monkeypatch):
    """The first distinct pages by the hash, and few from each partition reach the driver."""
    page = lambda i: f"<html><body><article><p>page {i}</p></article></body></html>"
    rows = [(i, page(i)) for i in range(4000)] + [(5000, page(0))] * 2000 + [(6000, "<p>no label</p>"), (None, None)]
    df = spark.createDataFrame(rows, "page_id long, html string").repartition(16)
    seen = []
    monkeypatch.setattr(L, "train", seen.extend)
    L.fit(df, sample=50)
    order = F.xxhash64(F.lit(3), "page_id", "html")
    want = [r["html"] for r in df.where(F.col("html").contains("<article")).distinct().orderBy(order).limit(50).collect()]
    assert seen == want
    seen.clear()
    L.fit(df.where("page_id < 10"), sample=50)
    assert sorted(seen) == sorted(map(page, range(10)))
    seen.clear()
    L.fit(df.limit(0))
    assert seen == []
