import time

import numpy as np
import pytest
from celerix.llm import html_blocks as H


def texts(page):
    return [b.text for b in H.blocks(page)]


def test_blocks():
    assert texts("<p>a&amp;b\n  c<b>d</b><br>e<p>f&#233;<script>var t='</p>';</script> g<!-- no --> h</div>tail") == ["a&b cd", "e", "fé g h", "tail"]
    assert texts("<head><title>t</title></head><body>x<style>p{}</style><ul><li>1<li>2</ul>") == ["x", "1", "2"]
    assert texts("") == [] and texts("<p>  <br>") == [] and texts("plain < 3 & more") == ["plain < 3 & more"]
    paths = [b.path for b in H.blocks('<div class="side bar"><p>a<p id=x>b</div><p>c')]
    assert paths == [("div", ".side", ".bar", "p"), ("div", ".side", ".bar", "p", ".x"), ("p",)]


@pytest.mark.parametrize("tag", ["<svg-icon name=x></svg-icon>", "<video-player>", "<select-box>", "<title-bar></title-bar>", "<svg width='1' />", '<svg aria-label="a>b"/>', "<math/>", "<video src=x>", "<iframe src=x>", "<SVG>"])
def test_what_follows_a_tag_that_nothing_closes_is_read(tag):
    assert texts(f"<p>one<p>{tag}</p><p>two</p><svg><text>no</text></svg><p>three") == (["one", "three"] if tag == "<SVG>" else ["one", "two", "three"])
    assert texts(f"<p>one</p>{tag}<p>two</p><p>three") == ["one", "two", "three"]


def test_silent_tags_that_run_to_the_end():
    for tag in ("script", "style", "textarea", "title"):
        assert texts(f"<p>one</p><{tag} a=b>two<p>three") == ["one"]
    assert texts("<p>one</p><svg a=b><title>t</title></svg>two<select\n><option>no</select>three") == ["one", "two three"]
    assert len(texts("<video src=x>v" * 20000)) == 20000


def test_odd_markup():
    assert texts("<p title=it's>one</p><p title='a>b' x=\"c>d\">two</p>") == ["one", "two"]
    assert texts("<p>a<!-- x > y -->b</p><!doctype x><?php z?><p>c</p>x <b") == ["ab", "c", "x <b"]
    assert texts("<p a=\"never closed>one</p><p>two</p>") == ["one", "two"]
    assert texts("<table><tr><td>1<td>2<tr><td>3</table>") == ["1", "2", "3"]


@pytest.mark.parametrize("page", ["<a" * 40000, "<a" * 40000 + ">x", "<div>x" * 20000, "<b>" * 40000 + "<div>x</div>" * 100, "<a b='" * 20000, "<p><b>" * 20000 + "x", "</p>x" * 40000, "<ul><li>" * 20000 + "x", "<!--" * 20000, "<script>" * 20000, "&amp" * 50000])
def test_time_is_in_proportion_to_the_page(page):
    start = time.process_time()
    H.blocks(page)
    assert time.process_time() - start < 5


def test_layouts_and_cells(net):
    """Cells and a paragraph that is one link are the article's; the text expected is written out, not made by the parser."""
    text = "The river rose again last night, and the town waited for the morning with sandbags at every door."
    page = f'<html><body><nav><ul><li><a href="/">Home</a></li><li><a href="/x">News</a></li></ul></nav><article><h1>Rivers</h1><p>{text}</p><table><tr><td>20</td><td>metres wide</td></tr></table><p><a href="#">{text}</a></p><p>{text}</p></article><footer>All rights reserved by the paper.</footer></body></html>'
    assert H.main_texts([page], net) == [f"Rivers {text} 20 metres wide {text} {text}"]


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = H.Labeller(1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x = rng.standard_normal((4, 3, H.INPUT)) * 0.5
    mask = np.array([[1, 1, 1], [1, 1, 1], [1, 0, 1], [1, 0, 0]], float)
    y = (rng.random((4, 3)) > 0.5).astype(float)
    _, grad = net.gradients(x, mask, y)
    for name in net.w:
        at = tuple(rng.integers(0, n) for n in net.w[name].shape)
        keep = net.w[name][at]
        net.w[name][at] = keep + 1e-3
        up = net.gradients(x, mask, y)[0]
        net.w[name][at] = keep - 1e-3
        down = net.gradients(x, mask, y)[0]
        net.w[name][at] = keep
        assert abs((up - down) / 2e-3 - grad[name][at]) < 2e-3 * max(1, abs(grad[name][at])), name


@pytest.fixture(scope="module")
def net():
    return H.trained()


def test_unseen_template_pages(net):
    pages = [next(t) for t in [H.Templates(99)] for _ in range(300)]
    got = net.label([b for b, _ in pages])
    want = np.concatenate([np.array(y, bool) for _, y in pages])
    assert (np.concatenate(got) == want).mean() > 0.97


def test_pages_table(spark, sf, net):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = H.extract(pages, net).join(pages.select("page_id", "html"), "page_id").collect()
    good = 0
    for r in rows:
        article = r["html"].split("<article>", 1)[1].split("</article>", 1)[0]
        good += r["text"] == " ".join(texts("<article>" + article))
        assert r["n_chars"] == len(r["text"])
    assert good >= 0.95 * len(rows)


def test_edges(spark, net):
    pages = spark.createDataFrame([(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<p>" + "word " * 50000, "x"), (3, "u", "<div>" * 500 + "deep", "x")], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in H.extract(pages, net).collect()}
    assert got[1]["text"] == "" and got[2]["n_chars"] == 0 and len(got) == 4
    assert H.extract(pages.limit(0), net).count() == 0
