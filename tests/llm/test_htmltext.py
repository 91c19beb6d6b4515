"""HTML extraction: block reading, the trained field on unseen labelled pages, the table."""
import html
import re

import pytest

from carelens.llm import htmltext as H

SCHEMA = "page_id long, url string, html string, text string, n_chars string"


@pytest.fixture(scope="module")
def weights():
    return H.train()


def test_blocks_of_ragged_markup():
    page = ("<!doctype html><title>no</title><script>var a='</p><p>x';</script><body>a &amp; b"
            "<p>one <b>bold<br>two<p title='>'>three&nbsp; &#233;<ul><li>x<li>y <a href=q>link</a>"
            "</ul><!-- <p>gone</p> --><table><tr><td>c<td>d</table><div>tail &am")
    assert [b.text for b in H.leaf_blocks(page)] == \
        ["a & b", "one bold two", "three é", "x", "y link", "c", "d", "tail &am"]
    assert H.leaf_blocks("") == [] and H.leaf_blocks("<p></p><br>") == []
    assert H.leaf_blocks("<p>" * 3000 + "deep")[0].text == "deep"


def test_unseen_elements_without_end_tags():
    def texts(page):
        return [b.text for b in H.leaf_blocks(page)]

    body = "<article><p>Hello</p><p>there</p></article>"
    for page in ("<html><head><title>t</title><body>%s", "<html><head><meta charset=x>%s",
                 "<head><title>t</title></head><body>%s</body>", "<head>%s",
                 "<head><noscript><img></noscript><script>a</script><body class=a>%s"):
        assert texts(page % body) == ["Hello", "there"]
        assert not any("<head" in b.marks for b in H.leaf_blocks(page % body))
    for tag in ("object", "svg", "video", "audio", "canvas", "select", "noscript", "template"):
        assert texts(f"<div><{tag} class='a'>no<p>no</div>{body}") == ["Hello", "there"]
        assert texts(f"<div><{tag}>no<b>no</{tag}>yes</div>{body}") == ["yes", "Hello", "there"]
        assert texts(f"<div><{tag}><{tag}>no</{tag}>no</{tag}></div>{body}") == ["Hello", "there"]
    assert texts(f"<svg width=1 />{body}") == ["Hello", "there"]
    assert texts("<video-list><p>a</p></video-list><header>b</header>") == ["a", "b"]
    assert texts("<p>a <video><p>no</p></video> b<p>c") == ["a b", "c"]


def test_held_out_pages(weights):
    right = total = 0
    for blocks, labels in H.training_set(200, seed=77):
        got = H.viterbi(H.features(blocks), weights)
        right += sum(a == b for a, b in zip(got, labels))
        total += len(labels)
    assert right / total > 0.985


PARAGRAPHS = [
    "The council met on Tuesday to talk about the new bridge and its cost for the town.",
    "It was the third meeting of the year, and many people from the river side had come.",
    "Work could begin in the spring if the money is found, a member of the board said.",
    "Until then the old bridge stays open for cars that weigh less than three tons."]
LAYOUTS = {
    "unnamed": "<ul><li><a href=a>Home</a><li><a href=b>News</a><li><a href=c>Sport</a></ul>"
               "<div>%s</div><div>&copy; 2020 All rights reserved</div>",
    "foreign": "<div class=navigation><a href=a>Start</a> <a href=b>Sport</a></div>"
               "<div id=inhalt>%s</div><div class=fusszeile>Impressum Datenschutz</div>",
    "columns": "<div class=wrapper><div class=col-4><a href=a>Home</a> <a href=b>News</a></div>"
               "<div class=col-8>%s</div></div>",
    "plain": "%s", "article": "<nav><a href=a>Home</a></nav><article>%s</article>",
    "main": "<p>We use cookies, accept our privacy notice.</p><main>%s</main>",
    "nested": "<div id=x1><section><div class=box>%s</div></section></div>"
              "<footer>Contact us</footer>",
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_layouts_with_and_without_telling_names(weights, layout):
    for n in (3, 4):
        body = "<h1>Town talks about the bridge</h1>" + "".join(
            f"<p>{p}</p>" for p in PARAGRAPHS[:n])
        got = H.main_text(f"<html><body>{LAYOUTS[layout] % body}</body></html>", weights)
        assert got.split("\n") == ["Town talks about the bridge", *PARAGRAPHS[:n]]


def test_pages_with_names_never_trained_on(weights):
    import random
    rng, kept, content, wrong, boiler = random.Random(3), 0, 0, 0, 0
    for k in range(200):
        names = [f"{rng.choice('zxkwj')}{rng.choice('aeiou')}{rng.choice('zxkwj')}{i}"
                 for i in range(4)]
        prose = [" ".join(rng.sample(" ".join(PARAGRAPHS).split(), rng.randint(9, 50))) + "."
                 for _ in range(rng.randint(2, 9))]
        menu = [f"Item {rng.randint(1, 99)}" for _ in range(rng.randint(3, 8))]
        page = (f"<body><div class={names[0]}><ul>" + "".join(f"<li><a href=x>{m}</a>" for m in menu)
                + f"</ul></div><div id={names[1]}>" + "".join(f"<p>{p}</p>" for p in prose)
                + f"</div><div class={names[2]}><p>&copy; 2021 All rights reserved</p></div>")
        got = H.main_text(page, weights).split("\n")
        content += len(prose)
        kept += sum(p in got for p in prose)
        boiler += len(menu) + 1
        wrong += sum(g not in prose for g in got if g)
    assert kept >= 0.98 * content and wrong <= 0.02 * boiler


def test_viterbi_is_the_best_labelling(weights):
    from itertools import product
    for blocks, _ in H.training_set(30, seed=5):
        fs = H.features(blocks)[:9]

        def value(y):
            v = sum(weights.get(f, 0.0) for one, k in zip(fs, y) if k for f in one)
            return v + sum(weights[f"T:{a}{b}"] for a, b in zip(y, y[1:]))

        best = max(value(y) for y in product((0, 1), repeat=len(fs)))
        assert abs(value(H.viterbi(fs, weights)) - best) < 1e-9


def test_supplied_pages(spark, weights):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    source = {r["page_id"]: r["html"] for r in df.collect()}
    for r in H.extract(df, weights).collect():
        page = source[r["page_id"]]
        inner = page[page.index("<article>") + 9:].split("</article>")[0]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>|<br>", " ", inner))
        text = "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)
        assert r["text"] == text and r["n_chars"] == len(text)


def test_awkward_rows(spark, weights):
    rows = [(1, "u", None, "t", "n"), (2, None, "", "t", "n"), (None, "u", "<nav>menu</nav>", "", ""),
            (3, "u", "<article><p>Some words of text here.</p></article>", "", ""),
            (3, "u", "<article><p>Some words of text here.</p></article>", "", ""),
            (4, "u", "<article>" + "<p>Long words of text here.</p>" * 20_000 + "</article>", "", "")]
    got = H.extract(spark.createDataFrame(rows, SCHEMA), weights).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert len(got) == 6 and text[1] == text[2] == text[None] == ""
    assert text[3] == "Some words of text here." and text[4].count("\n") == 19_999
    assert H.extract(spark.createDataFrame([], SCHEMA), weights).collect() == []
