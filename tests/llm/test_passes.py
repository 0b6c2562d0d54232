"""Benchmarks in several passes, queries of repeated ids, pages of odd markup."""

import time

import pytest

from candlewick.llm import decontaminate, html_extract, topk
from tests.llm.test_llm import PASSAGE, TEXTS, prose


@pytest.mark.parametrize("size", [500, 1000])
def test_passes_give_what_one_pass_gives(spark, monkeypatch, size):
    items = [(1, PASSAGE), (1, prose(15, 90)), (2, " ".join(PASSAGE.split()[5:40])), (3, "one"), (4, prose(40, 6)), (5, None), (6, ""), (None, "a b c"), (7, prose(30, 2).upper())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, t, "s", 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "s", 1), (3, "a different one", "s", 1), (None, PASSAGE, "s", 1), (None, None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, starts string, n_words int").repartition(3)
    key = lambda r: tuple(str(v) for v in r)
    one = sorted((tuple(r) for r in decontaminate.contamination(docs, bench).collect()), key=key)
    stays = sorted((tuple(r) for r in decontaminate.stage(docs, bench).collect()), key=key)
    monkeypatch.setattr(decontaminate, "PASS_BYTES", size)
    assert len(decontaminate.parts_of(bench)) > 1
    assert sorted((tuple(r) for r in decontaminate.contamination(docs, bench).collect()), key=key) == one
    assert sorted((tuple(r) for r in decontaminate.stage(docs, bench).collect()), key=key) == stays
    assert sum(r[2] > 0 for r in one) >= 5 and len(stays) == sum(r[2] == 0 for r in one)
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


def test_a_repeated_query_id_is_its_least_row(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [2.0, 0.0]), (2, [0.0, 3.0]), (40, [0.5, 0.5])]
    want = None
    for own in (rows, rows[::-1], [rows[1], *rows[2:], rows[0]]):
        for parts in (1, 3):
            got = sorted(tuple(r) for r in topk.top_k(spark.createDataFrame(own, "vec_id long, embedding array<double>").repartition(parts)).collect())
            want = want or got
            assert got == want
    assert [r[2:] for r in want if r[0] == 20] == [(2, 12288), (40, 2048), (1, 0)]  # by [0, 64]
    assert [r for r in want if r[:3] == (40, 3, 20)] == [(40, 3, 20, 2048)]


P = "This is a long paragraph, with commas, and quite a lot of text to read in it, so that it scores as prose does."


@pytest.mark.parametrize(
    "page,want",
    [
        (f'<div class="content has-sidebar"><div class="post"><p>{P}</p><p>{P}</p></div></div>', f"{P} {P}"),
        (f'<div id="page" class="no-header"><div class="post"><p>{P}</p><p>{P}</p></div></div>', f"{P} {P}"),
        (f'<article><h1>Title</h1><p>Short intro.</p><div class="entry"><p>{P}</p><p>{P}</p><p>{P}</p></div><h3>Sub</h3><ul><li>one<li>two</ul><p>The end.</p></article>', f"Title Short intro. {P} {P} {P} Sub one two The end."),
        (f"<article><section><p>{P}</p><p>{P}</p></section><section><h2>B</h2><p>Short.</p></section></article>", f"{P} {P} B Short."),
        (f'<article><header><h1>T</h1><span>by me</span></header><p>{P}</p><div class="related-work"><p>{P}</p></div></article>', f"T {P} {P}"),
        (f'<header class="site"><h1>Site</h1></header><div class="sidebar-left"><p>{P}</p></div><main><article><p>{P}</p><div class="comments"><p>{P}{P}</p></div><div class="related-posts"><a href=x>r</a></div></article></main><footer>f</footer>', P),
        (f'<div class="post"><h1>T</h1><p>Short intro.</p><div class="entry"><p>{P}</p><p>{P}</p></div><h3>Sub</h3><p>The end.</p></div>', f"T Short intro. {P} {P} Sub The end."),
        (f'<div class="wrapper overlay"><div><p>{P}</p><p>{P}</p></div></div><div class="sidebar"><a href=x>{P}</a></div>', f"{P} {P}"),
    ],
)
def test_whole_articles_of_usual_markup(page, want):
    assert html_extract.extract(page) == want


@pytest.mark.parametrize("page", ["<!" * 500_000, "<article>" * 50_000 + "<p>" + P, "<nav>" + "<article>" * 50_000 + "<p>" + P, "<div>" * 100_000 + P, "<div>" * 50_000 + "</span>" * 50_000, "<script>" + "</script " * 100_000, "<p>" * 100_000 + P, "<div class=sidebar>" * 50_000 + P, "<span>" * 20_000 + "<li></li>" * 20_000])
def test_time_is_linear_in_the_page(page):
    began = time.process_time()
    html_extract.extract(page)
    assert time.process_time() - began < 10


def scores(page):
    """Scores of `measured` by their definition, from each paragraph up, over all nodes."""
    root = html_extract.tree(page)
    order = html_extract.measured(root)
    hidden = lambda x: html_extract.gone(x)

    def below(x):
        if isinstance(x, str):
            return len(x.strip()), 0, x.count(",")
        parts = [below(y) for y in x.parts if isinstance(y, str) or not hidden(y)]
        size, links, commas = (sum(p[k] for p in parts) for k in range(3))
        return size, size if x.tag == "a" else links, commas

    want = dict.fromkeys(map(id, order), 0.0)
    for x in order:
        size, links, commas = below(x)
        loose = x.tag in ("div", "section", "article", "main", "body") and not any(not isinstance(y, str) and y.tag in html_extract.BLOCKS - {"br"} for y in x.parts)
        if x.parent is None or size < 25 or not (loose or x.tag in html_extract.PARAGRAPHS) or (hidden(x) and not loose):
            continue
        up, points = x if loose else x.parent, (1 + commas + min(size / 100, 3)) * (1 - links / size)
        for share in (1, 0.5, 0.25):
            if up is None or up.tag == "#root":
                break
            want[id(up)] += points * share
            if hidden(up):
                break
            up = up.parent
    for x in order:
        size, links, _ = below(x)
        assert x.score == pytest.approx(want[id(x)] * (1 - links / max(size, 1)))


def test_scores_follow_their_definition():
    pages = [f'<body><div class="a"><p>{P}<p>{P} <a href=x>{P}</a></div><nav><p>{P}</nav><div class=sidebar>{P}<div><p>{P}</div></div><table><tr><td>{P}<td>x</table>', f"<main>{P}<section><ul><li>{P}<li>{P}, and, more</ul></section></main>"]
    for page in pages:
        scores(page)
