import html
import random
import re

import numpy as np
import pytest

from spanlake.llm import htmlblocks, pagetext

SCHEMA = "page_id long, url string, html string, text string, n_chars int, arrays int, path string"


def table(spark, rows):
    """Pages from (page_id, url, html), with columns that clash with inner names."""
    return spark.createDataFrame([(*r, "other", 3, 4, "p") for r in rows], SCHEMA)


def texts(page):
    return [b.text for b in htmlblocks.blocks(page)]


@pytest.mark.parametrize("page, want", [
    ("", []), ("plain", ["plain"]), ("a < b & c", ["a < b & c"]), ("<p>x<p>y", ["x", "y"]),
    ("<p>a <b>bo\tld</b>,\n\n<a href=x>link</a>.</p>", ["a bo ld, link."]),
    ("<div>one<br>two</div>three", ["one two", "three"]),
    ("<script>var t='<p>no</p>';</script><STYLE>p{}</STYLE >yes", ["yes"]),
    ("<title>no &amp</title><h1>A&amp;B &#x41;&nbsp;&copy C</h1>", ["A&B A © C"]),
    ("x<!-- <p>no</p> -->y<!-- no end <p>z", ["xy"]), ("<p title='a > b'>in</p>", ["in"]),
    ("<p title='open>in</p>it's", []), ("a<p title=it's>in</p>", ["a", "in"]), ("<script>never closed <p>in", ["never closed", "in"]),
    ("</div></p>a</table>b", ["a", "b"]), ("<ul><li>a<li>b</ul>c", ["a", "b", "c"]),
    ("<select><option>no</select><textarea>no</textarea>z<img src=x>w", ["zw"]), ("<", ["<"]), ("<p", []), ("a<3", ["a<3"]),
])
def test_blocks(page, want):
    assert texts(page) == want


def test_paths_and_links():
    first, second = htmlblocks.blocks("<div class='Side-Bar x'><ul><li><a href=/>aa</a> b</ul></div><article data-main='1'>t</article>")
    assert first.tags == ("div", ".side", ".bar", ".x", "ul", "li") and first.linked == 2 and not first.main
    assert second.tags == ("article",) and second.main


def test_scan_time_is_linear():
    for page in ("<p title='" * 40_000, "<div>" * 60_000 + "x", "<a href=\"" * 40_000, "</p>" * 60_000, "<script>" * 30_000):
        htmlblocks.blocks(page)


def test_gradients():
    net = pagetext.Labeller.fresh(3)
    net.p = {k: a.astype(np.float64) for k, a in net.p.items()}
    rnd = np.random.default_rng(1)
    x, lengths = rnd.normal(0, 1, (9, pagetext.INPUTS)).astype(np.float64), np.array([5, 3, 1])
    y = (rnd.random(9) < 0.5).astype(float)
    grads, _ = net.gradients(x, lengths, y)
    for name, at in [("wx", (3, 5)), ("wx", (7, 150)), ("u0", (2, 30)), ("u1", (4, 80)), ("v", (7,)), ("v", (40,)), ("b", (0,))]:
        put = []
        for move in (1e-2, -1e-2):
            net.p[name][at] += move
            put.append(net.gradients(x, lengths, y)[1])
            net.p[name][at] -= move
        assert abs((put[0] - put[1]) / 2e-2 - grads[name][at]) < 2e-3, (name, at)


def prose(rnd, n):
    return " ".join(rnd.choice("lorem ipsum dolor sit amet, river stone. moon winter").strip() if rnd.random() < 0.05
                    else "".join(rnd.choice("abcdefghilmnorstu") for _ in range(rnd.randint(2, 9))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def model():
    rnd = random.Random(1)
    pages = []
    for k in range(60):
        story = "".join(f"<p>{prose(rnd, rnd.randint(3, 60))}</p>" for _ in range(rnd.randint(1, 12)))
        pages.append(f"<body><nav><ul><li><a href=/a>{prose(rnd, 1)}</a></ul></nav><div class=ad>{prose(rnd, 9)}</div>"
                     f"<article><h1>{prose(rnd, 4)}</h1>{story}</article><footer>{prose(rnd, 8)}</footer>")
    return pagetext.learnt(pages)


def test_layouts_not_learnt_from(model):
    rnd, right, blocks, f = random.Random(77), 0, 0, []
    others = [prose(rnd, rnd.randint(2, 50)) for _ in range(300)]
    for _ in range(150):
        found = htmlblocks.blocks(pagetext.layout(rnd, [prose(rnd, rnd.randint(3, 60)) for _ in range(rnd.randint(1, 20))], others))
        z = model.logits(pagetext.vectors(found, np.arange(len(found)), np.full(len(found), len(found))), np.array([len(found)])) > 0
        want = np.array([b.main for b in found])
        right, blocks = right + (z == want).sum(), blocks + len(found)
        f.append(2 * (z & want).sum() / max(1, z.sum() + want.sum()))
    assert right / blocks >= 0.95 and np.mean(f) >= 0.95, (right / blocks, np.mean(f))


def test_long_page_by_windows(model, monkeypatch):
    rnd = random.Random(9)
    page = "<nav>menu</nav><article>" + "".join(f"<p>{prose(rnd, 12)}</p>" for _ in range(400)) + "</article><footer>x</footer>"
    found = htmlblocks.blocks(page)
    whole = model.logits(pagetext.vectors(found, np.arange(len(found)), np.full(len(found), len(found))), np.array([len(found)]))
    monkeypatch.setattr(pagetext, "WINDOW", 64)
    assert np.abs(model.long_logits(found) - whole).max() < 1e-3
    assert pagetext.main_texts(model, [page, "", page])[2] == pagetext.main_texts(model, [page])[0]


def plain(page):
    """The article element's blocks by search and replace, good for the test table's pages."""
    body = re.search("<article>(.*?)</article>", page, re.S).group(1)
    parts = re.split("</?(?:p|h1)>", re.sub("</?b>", "", body.replace("<br>", " ")))
    return "\n".join(t for t in (" ".join(html.unescape(p).split()) for p in parts) if t)


def test_whole_table(spark):
    from conftest import SF_DIR
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    want = {r.page_id: plain(r.html) for r in pages.collect()}
    got = pagetext.pages_table(pages).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_odd_rows(spark):
    article = "<article><p>" + "Some words of a story, told at length and with care. " * 6 + "</p></article>"
    rows = [(1, "u", None), (1, "u", ""), (None, None, article), (2, "a", article), (2, "a", article), (3, "b", "<p>" * 1000),
            (4, "c", "\x00\x01<\x02>"), (5, "d", "<article>" + "<p>A long story goes on and on, as it does. </p>" * 3000)]
    got = pagetext.pages_table(table(spark, rows)).collect()
    assert sorted(str(r.page_id) for r in got) == ["1", "1", "2", "2", "3", "4", "5", "None"]
    assert {r.text for r in got if r.page_id in (1, 3)} == {""}
    assert [r.url for r in got if r.page_id is None] == [None]
    assert len({r.text for r in got if r.page_id in (2, None)}) == 1


def test_empty_table(spark):
    assert pagetext.pages_table(table(spark, [])).count() == 0
    assert [r.n_chars for r in pagetext.pages_table(table(spark, [(1, "u", None)])).collect()] == [0]
