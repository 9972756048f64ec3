"""Blocks of odd markup, gradients, and pages with parts that are not the article."""

import numpy as np
import pytest

from frostline.llm import html_text as html


def texts(page):
    return [x.text for x in html.blocks(page)]


def test_blocks():
    assert texts(None) == texts("") == texts("<p> <br></p>") == []
    assert texts("a&amp;b&nbsp;&#x41;<br>c") == ["a&b A c"]
    assert texts("<p>one <b>two</b><p>three</ul></div> four") == ["one two", "three four"]
    assert texts("<script>x<p>y</script><style>p{}</style><p>z<!-- c --><noscript>n</noscript>") == ["z"]
    assert texts("<ul><li>a<li>b</ul>tail") == ["a", "b", "tail"]
    assert html.blocks("<div class='X y' id=k role=main><a>l</a> m</div>")[0] == html.Block(
        ("div", ".x", ".y", "#k", "@main"), "l m", 1
    )
    assert len(texts("<p>w</p>" * 5000)) == 5000


def test_phrases_go_on_after_what_is_not_shown():
    for silent in (
        "<script>x<p></script>", "<style>p{}</style>", "<svg><path d=1><g>t</g></svg>", "<noscript><p>n</p></noscript>",
        "<select><option>a<option>b</select>", "<iframe>f</iframe>", "<object><p>o</p></object>", "<textarea>t</textarea>",
    ):
        assert texts(f"<p>Hello {silent}world</p><p>next</p>") == ["Hello world", "next"], silent
    assert texts("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds</p>") == ["so x=2 holds"]
    assert texts("<p>a <select><option>b</p><p>c</p>") == ["a", "c"]
    assert texts("<div>a<svg></div><p>b") == ["a", "b"]


def test_a_null_or_repeated_id_does_not_fill_the_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(html, "blocks", lambda x: seen.append(x) or [])
    rows = [((None, 7, k)[k % 3], f"<p>page {k}</p>") for k in range(3000)] + [(None, "<p>copy</p>")] * 3000
    pages = spark.createDataFrame(rows, "page_id long, html string")
    assert html.learn(pages, train_pages=100) is None
    assert 10 < len(seen) <= 200 and len(set(seen)) == len(seen)


def test_gradients():
    rng = np.random.default_rng(0)
    model = html.Labeller()
    model.parameters = {k: v.astype(np.float64) for k, v in model.parameters.items()}
    pages = [rng.normal(size=(n, html.WIDTH)) for n in (3, 1, 4)]
    x, mask = html._padded(pages)
    y = (rng.random(mask.shape) < 0.5).astype(float)

    def loss():
        z = model._joined(x, mask) @ model.parameters["out"]
        return float(((np.logaddexp(0, z) - y * z) * mask).sum() / mask.sum())

    grads = model.gradients(x, mask, y)
    for name, value in model.parameters.items():
        at = tuple(rng.integers(0, n) for n in value.shape)
        kept, step = value[at], 1e-2
        value[at] = kept + step
        up = loss()
        value[at] = kept - step
        down = loss()
        value[at] = kept
        assert grads[name][at] == pytest.approx((up - down) / (2 * step), rel=0.1, abs=2e-5), name


def test_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    labeller = html.learn(pages)
    found = {r["page_id"]: r["text"] for r in html.extract(pages, labeller).collect()}
    for r in pages.collect():
        read = html.blocks(r["html"])
        assert found[r["page_id"]] == "\n".join(b.text for b, y in zip(read, html.teacher(read), strict=True) if y)
    page = (
        "<body><div class='cookie'>We use cookies here</div><header><h1>Site</h1></header><nav><a href=x>Home</a></nav>"
        "<main><h1>A title of some words</h1><p>Long text of the article with many words here.</p>"
        "<p>Second &amp; last text of the article is here.</p><aside>Read this as well</aside>"
        "<div class='comments'><p>I like it, said a reader.</p></div></main>"
        "<div class=sidebar>Links</div><form>Name</form><footer>Legal</footer></body>"
    )
    rows = [(1, "u", page, 5), (2, "u", None, 5), (3, None, "", 5), (None, "u", "<p></p>", 5)]
    odd = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long")
    out = {r["page_id"]: (r["text"], r["n_chars"]) for r in html.extract(odd, labeller).collect()}
    article = "A title of some words\nLong text of the article with many words here.\nSecond & last text of the article is here."
    assert out == {1: (article, len(article)), 2: ("", 0), 3: ("", 0), None: ("", 0)}
    assert html.extract(odd.limit(0), labeller).count() == 0
    assert html.learn(odd.limit(0)) is None
    assert html.extract(odd.limit(1), None).first()["text"] == article


def test_words_after_the_first_200_count():
    path, words = ("body", "p"), [f"w{k}" for k in range(400)]
    whole = html.vectors([html.Block(path, " ".join(words), 0)])[0]
    other = html.vectors([html.Block(path, " ".join(words[:200] + ["else"] * 200), 0)])[0]
    hashed = slice(html.PATH_CELLS, html.PATH_CELLS + html.WORD_CELLS)
    assert np.abs(whole[hashed] - other[hashed]).sum() > 0.4
    assert whole[hashed].sum() == pytest.approx(1) and other[hashed].sum() == pytest.approx(1)


def test_long_pages_are_learned_whole(spark, monkeypatch):
    shown = []
    monkeypatch.setattr(html.Labeller, "fit", lambda self, pages, labels: shown.extend(zip(pages, labels, strict=True)))
    body = "".join(f"<p>Part {k} of the text.</p>" for k in range(90))
    page = f"<body><article>{body}</article><footer><p>Legal</p><p>Contact</p></footer></body>"
    html.learn(spark.createDataFrame([(1, page)], "page_id long, html string"))
    first, labels = shown[0]
    assert len(first) == len(labels) == 92 and labels.sum() == 90 and not labels[-2:].any()


def test_batches_of_long_pages(monkeypatch):
    monkeypatch.setattr(html, "BATCH_BLOCKS", 40)
    monkeypatch.setattr(html, "STEPS", 6)
    sizes, padded = [], html._padded

    def noted(pages):
        out = padded(pages)
        sizes.append((len(pages), out[0].shape[0]))
        return out

    monkeypatch.setattr(html, "_padded", noted)
    rng = np.random.default_rng(0)
    pages = [rng.normal(size=(n, html.WIDTH)).astype(np.float32) for n in (3, 5, 9, 9, 30, 100)]
    html.Labeller().fit(pages, [np.ones(len(x), np.float32) for x in pages])
    assert max(n for _, n in sizes) == 100 and all(k == 1 or k * n <= 40 for k, n in sizes)
