"""Extraction from layouts that the generator of labelled pages doesn't make, and exactness of the messages."""

import itertools
import time

import numpy as np
import pytest

from spanflow.llm import html

#: (page, blocks of its article, blocks beside it)
PAGES = [
    (
        '<body><div class="c1"><a href=/>Home</a> <a href=/n>News</a></div><div class="c2"><h1>A tale of rivers</h1><p>The river rose in the night and by morning the lower fields were under water, as they had been ten years before.</p><p>People went to the hill with what they could carry. Nobody was hurt, the council said.</p></div><div class="c3">Copyright 2024 Example. All rights reserved.</div></body>',
        ["A tale of rivers", "The river rose in the night and by morning the lower fields were under water, as they had been ten years before.", "People went to the hill with what they could carry. Nobody was hurt, the council said."],
        ["Home News", "Copyright 2024 Example. All rights reserved."],
    ),
    (
        "<table><tr><td><a href=/>Home</a><br><a href=/n>News</a></td><td><h1>On bridges</h1><p>A bridge carries a road over water, and the oldest of them here is made of stone that was cut in the hills nearby.</p><p>It was mended twice, once after a flood and once after a war.</p></td></tr></table>",
        ["On bridges", "A bridge carries a road over water, and the oldest of them here is made of stone that was cut in the hills nearby.", "It was mended twice, once after a flood and once after a war."],
        ["Home News"],
    ),
    (
        "<article><h1>Winter</h1><p>Snow fell on the pass for three days and the road stayed closed until the plough came up from the valley.</p><div class='share'>Share this on Facebook</div><p>Then the sun came out.</p></article>",
        ["Winter", "Snow fell on the pass for three days and the road stayed closed until the plough came up from the valley.", "Then the sun came out."],
        ["Share this on Facebook"],
    ),
    (
        '<center><font size=2><a href=a>Index</a> - <a href=b>Archive</a> - <a href=c>Links</a></font></center><hr><h2>How to bake bread</h2>Mix the flour with water and salt, and leave it in a warm place until it has doubled in size, which takes an hour or two.<p>Then shape the loaf and let it rest once more.<p>Bake it in a hot oven for forty minutes.<hr><address><a href="mailto:x">Webmaster</a></address>',
        ["How to bake bread", "Mix the flour with water and salt, and leave it in a warm place until it has doubled in size, which takes an hour or two.", "Then shape the loaf and let it rest once more.", "Bake it in a hot oven for forty minutes."],
        ["Index - Archive - Links", "Webmaster"],
    ),
    (
        '<div id=root><div><div><ul><li><a href=1>World</a><li><a href=2>Sport</a><li><a href=3>Arts</a></ul></div><div><div><h1>Council votes for new school</h1><div><div>The council voted on Monday to build a new school on the site of the old market hall, ending a dispute of six years.</div><div>Work is to begin in spring. The cost is put at nine million.</div><div>"We are glad that it is settled", the mayor said after the vote, which passed by two voices.</div></div></div></div><div><h4>Most read</h4><ol><li><a href=9>Storm hits the coast</a><li><a href=8>Train fares to rise</a></ol></div></div></div>',
        ["Council votes for new school", "The council voted on Monday to build a new school on the site of the old market hall, ending a dispute of six years.", "Work is to begin in spring. The cost is put at nine million.", '"We are glad that it is settled", the mayor said after the vote, which passed by two voices.'],
        ["World", "Sport", "Arts", "Most read", "Storm hits the coast", "Train fares to rise"],
    ),
    (
        '<body><header><h1>The Daily Note</h1><nav><a href=x>Home</a></nav></header><main><section><h2>A quiet year</h2><p>It was a quiet year for the harbour, with fewer ships than in any year since the war, and the cranes stood still for weeks.</p><ul><li>Ships: 212</li><li>Cargo: 1.1 million tons</li></ul></section><section class="comments"><h3>Comments</h3><p>I miss the noise of it, to be honest.</p></section></main><footer><p>Published by the Note Company since 1901.</p></footer></body>',
        ["A quiet year", "It was a quiet year for the harbour, with fewer ships than in any year since the war, and the cranes stood still for weeks.", "Ships: 212", "Cargo: 1.1 million tons"],
        ["The Daily Note", "Home", "Comments", "I miss the noise of it, to be honest.", "Published by the Note Company since 1901."],
    ),
    (
        '<div class="page"><div class="cookie-bar">We use cookies. <a href=/c>More</a></div><div class="post"><h1>Moss</h1><p>Moss grows where it is damp, on the north side of walls and under trees, and needs no soil to speak of.</p><blockquote>It asks for little, and gives a green that nothing else has.</blockquote><p>Some gardens in the east are made of it alone.</p></div><form><p>Subscribe to our newsletter</p><input></form></div>',
        ["Moss", "Moss grows where it is damp, on the north side of walls and under trees, and needs no soil to speak of.", "It asks for little, and gives a green that nothing else has.", "Some gardens in the east are made of it alone."],
        ["We use cookies. More", "Subscribe to our newsletter"],
    ),
    (
        '<table width=100%><tr><td colspan=2><a href=1>Start</a> | <a href=2>Map</a></td></tr><tr><td width=150><b>Topics</b><br><a href=3>Birds</a><br><a href=4>Fish</a></td><td><font size=5>The heron</font><p>The heron stands in shallow water and waits, often for an hour, until a fish comes near enough to be taken with one thrust.<p>It nests in tall trees, in colonies that may be a hundred years old, and comes back to the same nest each spring.</td></tr><tr><td colspan=2>&copy; 2003 Bird Club. All rights reserved.</td></tr></table>',
        ["The heron", "The heron stands in shallow water and waits, often for an hour, until a fish comes near enough to be taken with one thrust.", "It nests in tall trees, in colonies that may be a hundred years old, and comes back to the same nest each spring."],
        ["Start | Map", "Topics Birds Fish", "© 2003 Bird Club. All rights reserved."],
    ),
    (
        '<div><h1>Salt</h1><p>Salt was mined here for two thousand years, and the town owes it its name and its first church.</p><div aria-hidden="false" data-id="menu"><p>The last shaft was closed in 1965, when the water could no longer be held back by the pumps.</p></div></div>',
        ["Salt", "Salt was mined here for two thousand years, and the town owes it its name and its first church.", "The last shaft was closed in 1965, when the water could no longer be held back by the pumps."],
        [],
    ),
]


def test_layouts_never_seen():
    model, right, total = html.standard_model(), 0, 0
    for page, wanted, beside in PAGES:
        got = model.extract([page])[0].split("\n\n")
        assert {t for t in html.parse(page).text if t is not None} == {*wanted, *beside}
        right += sum(b in got for b in wanted) + sum(b not in got for b in beside)
        total += len(wanted) + len(beside)
    assert right >= 0.95 * total
    for page, wanted, _ in PAGES[:3]:
        assert model.extract([page])[0] == "\n\n".join(wanted)


def test_attributes_are_whole_names():
    tree = html.parse('<div aria-hidden="false" data-id="menu" title="class=promo">x</div><div CLASS=menu hidden>y</div>')
    assert not [f for f in tree.features[1] if f.startswith(("is:", "word:"))]
    assert {"is:hidden", "word:menu"} <= {*tree.features[3]}


@pytest.mark.parametrize("page", ["<div>x " * 100_000, "<ul><li>x" * 50_000, "<table><tr><td>x" * 30_000, "<div " * 200_000, '<a "' * 200_000, "<p>x</div>" * 100_000], ids=range(6))
def test_time_is_linear_in_length(page):
    model = html.standard_model()
    begin = time.process_time()
    model.extract([page[: len(page) // 4]])
    quarter = time.process_time() - begin
    model.extract([page])
    whole = time.process_time() - begin - quarter
    assert whole < max(2.0, 8 * quarter)


def test_deep_and_shallow_messages_agree():
    model = html.standard_model()
    for page in (*html.labelled_pages(5, seed=8), PAGES[4][0]):
        tree = html.parse(page)
        odds = [sum(model.weight.get(f, 0) for f in fs) for fs in tree.features]
        up = html._deep(tree, odds, model.pair.tolist())
        assert np.allclose([1 / (1 + np.exp(-x)) for _, x in up], model.marginals([tree])[0], atol=1e-9)


def test_messages_give_exact_marginals():
    tree = html.parse("<div><p>a<p>b</div>c")
    model = html.TreeModel(html.labelled_pages(30), steps=5)
    n = len(tree.parent)
    odds = [sum(model.weight.get(f, 0) for f in fs) for fs in tree.features]
    total, each = 0.0, np.zeros(n)
    for y in itertools.product((0, 1), repeat=n):
        w = np.exp(sum(o for o, b in zip(odds, y, strict=True) if b) + sum(model.pair[int(tree.text[i] is not None), y[tree.parent[i]], y[i]] for i in range(1, n)))
        total += w
        each += w * np.array(y)
    assert np.allclose(model.marginals([tree])[0], each / total)


def test_held_out_pages_of_the_generator():
    model, right, total = html.standard_model(), 0, 0
    for page in html.labelled_pages(60, seed=99):
        tree = html.parse(page)
        label = html.true_labels(tree)
        for i, p in enumerate(model.marginals([tree])[0]):
            if tree.text[i] is not None:
                right, total = right + ((p > 0.5) == label[i]), total + 1
    assert right > 0.95 * total


def test_template_and_odd_pages(spark):
    page = '<html><head><title>t</title><script>var a="</p>"</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies.</div><article><h1>A title</h1><p>First  text<br>goes &amp; on here, as it does.<p>Second one is here too.</p><ul><li>An item of it</li></ul></article><section id="comments"><div class="comment"><p>I liked it very much.</p></div></section><form><p>Sign up now.</p></form><footer>&copy; me</footer></body></html>'
    df = spark.createDataFrame([(1, page, "x"), (2, None, "x"), (3, "", "x"), (4, "<p", "x"), (5, "<div " * 3000, "x"), (6, "<b>" * 3000 + "z", None), (6, "<b>" * 3000 + "z", None)], "page_id long, html string, text string")
    got = {r.page_id: r for r in html.extract_main_text(df).collect()}
    assert got[1].text == "A title\n\nFirst text goes & on here, as it does.\n\nSecond one is here too.\n\nAn item of it"
    assert got[2].text == got[3].text == got[4].text == got[5].text == "" and got[1].n_chars == len(got[1].text) and len(got) == 6
    assert html.extract_main_text(df.limit(0)).count() == 0


def test_attributes_of_any_length(spark):
    """A quoted value ends at its quote, whatever it holds; none of it becomes text."""
    value = "a > b, tail of the title " * 400
    page = f"<body><article><p title=\"{value}\">The harbour was quiet when the boats came in, and nobody spoke for a while.</p><p data-x='{value}'>Later the lamps were lit along the quay, one after the other.</p></article></body>"
    df = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    text = html.extract_main_text(df).first()["text"]
    assert "tail of the title" not in text and text.startswith("The harbour was quiet")
