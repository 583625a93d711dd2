import html
import re

import pytest

from tessera.llm.html_text import blocks, extract_html, first_pass, judged, main_text, second_pass
from tessera.llm.queries import op9_html

PROSE = "It was the best of times and it was the worst of times, so that nobody in the town was sure of what the day would bring to them. "


def test_articles_of_the_table(spark, sf):
    rows = {r.page_id: r for r in op9_html(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for p in pages:
        article = re.search(r"<article>(.*?)</article>", p.html, re.S)
        if article:
            lines = re.split(r"</?p>|<br>|</?h1>|</?b>|\n\n", article[1])
            want = "\n".join(x for x in (re.sub(r"\s+", " ", html.unescape(line)).strip() for line in lines) if x)
            assert rows[p.page_id].text == want and rows[p.page_id].n_chars == len(want)


def test_clutter_goes_with_and_without_an_article_element():
    clutter = [
        "<header><h2>Site</h2></header>", "<nav><ul><li><a href=x>Home page of the site and of all that is in it</a></ul></nav>", "<div class='cookie-notice'>" + PROSE + "</div>",
        "<aside>" + PROSE + "</aside>", "<form><p>" + PROSE + "</p><input></form>", "<div id=comments><p>" + PROSE + "</p></div>", "<script>if (a<b) {'</p>'}</script>",
        "<style>p > b {}</style>", "<footer>&copy; us</footer>", "<div class=ad>Buy the best of it</div>", "<section class='sidebar-left'><p>" + PROSE + "</p></section>",
        "<article class='comment'><p>" + PROSE + "</p></article>", "<!-- <p>" + PROSE + "</p> -->", "<div hidden>" + PROSE + "</div>",
    ]
    body = f"<h1>Ti&amp;tle</h1><p>{PROSE}<b>bold</b>er<p>Short.</p>\n<p>{PROSE * 2}"
    want = "\n".join(["Ti&tle", PROSE + "bolder", "Short.", (PROSE * 2).strip()])
    for wrap in ("<article class='has-sidebar'>%s</article>", "<div class=content>%s</div>", "<main>%s</main>", "%s"):
        page = "<html><head><title>t</title></head><body class='no-sidebar search'>" + "".join(clutter[:7]) + wrap % body + "</p>" + "".join(clutter[7:]) + "</body></html>"
        assert main_text(page) == want


RUSSIAN = "Лучшее из времён было и худшим из времён, так что никто в городе не знал, что принесёт ему новый день, и все ждали утра у окна. "
POLISH = "Była to najlepsza i najgorsza z epok, nikt w mieście nie wiedział, co przyniesie mu nowy dzień, więc wszyscy czekali przy oknie. "
GREEK = "Ήταν οι καλύτερες και οι χειρότερες των εποχών, κανείς στην πόλη δεν ήξερε τι θα φέρει η νέα μέρα και όλοι περίμεναν. "
CHINESE = "那是最好的时代那是最坏的时代城里没有人知道新的一天会带来什么所以大家都在窗边等待着早晨的到来。" * 5
GERMAN = "Es war die beste und die schlimmste aller Zeiten, so dass niemand in der Stadt wusste, was der Tag ihm bringen und was er ihm nehmen werde. "
LABELLED = [  # (page, its text), by hand
    ("<body><div><a href=1>Home</a> <a href=2>News</a></div><div><p>%s</p><p>%s</p></div></body>" % (RUSSIAN * 2, RUSSIAN * 3), [RUSSIAN * 2, RUSSIAN * 3]),
    ("<h1>Dwie epoki</h1><p>%s</p><p>Tak.</p><p>%s</p><ul><li><a href=1>a</a><li><a href=2>b</a></ul>" % (POLISH * 2, POLISH * 2), ["Dwie epoki", POLISH * 2, "Tak.", POLISH * 2]),
    ("<table><tr><td><a href=1>x</a><td><h2>Εποχές</h2><p>%s<p>%s</table><div><a href=3>©</a></div>" % (GREEK * 2, GREEK * 4), ["Εποχές", GREEK * 2, GREEK * 4]),
    ("<div>%s</div><div><a href=x>下一页</a></div>" % CHINESE, [CHINESE]),
    ("<div class='post tags-politics category-news'><p>%s</p><p>%s</p></div><div class='post-comments'><p>%s</p></div>" % (PROSE * 2, PROSE * 3, PROSE * 4), [PROSE * 2, PROSE * 3]),
    ("<div class=story><p>%s</p><p>%s</p></div><article><h3><a href=1>Read on</a></h3><p>A teaser of the day.</p></article><article><h3><a href=2>More</a></h3></article>" % (GERMAN * 3, GERMAN * 2), [GERMAN * 3, GERMAN * 2]),
    ("<div class=widget><p>%s</p></div>" % (PROSE * 3), [PROSE * 3]),
    ("<article class='post'><header class='entry-header'><h1>Head</h1></header><p>One.</p><p>%%% $$$ ###</p><p>Two.</p></article><div><p>Not of it, and not with it.</p></div>", ["Head", "One.", "%%% $$$ ###", "Two."]),
    ("<main><p>%s</p><ul><li><a href=1>a</a><li><a href=2>b</a><li><a href=3>c</a></ul><p>%s</p><p><a href=4>All a link</a></p></main>" % (PROSE * 2, PROSE), [PROSE * 2, PROSE, "All a link"]),
    ("<div><a href=1>one</a></div><p>%s</p><div id=cookie-box>%s</div><div class=left-sidebar><p>%s</p></div>" % (PROSE * 2, PROSE, PROSE), [PROSE * 2]),
]


@pytest.mark.parametrize(("page", "want"), LABELLED)
def test_labelled_pages(page, want):
    assert main_text(page) == "\n".join(x.strip() for x in want)


def test_the_second_pass_decides_blocks_of_the_table(spark, sf):
    decided = first = 0
    for r in spark.read.parquet(f"{sf}/pages.parquet").select("html").collect():
        labels, kept = judged(blocks(r.html or ""))
        decided += sum(label is None for label in labels)
        first += sum(label is True for label in labels)
        assert all(keep == label for label, keep in zip(labels, kept) if label is not None)
    assert decided > 0 and first > 0


def test_time_grows_with_the_page():
    import time

    took = []
    for n in (5_000, 20_000):
        page = "<article>" + "<div>" * n + "x" + "</span>" * n + "</div>" * n
        begin = time.perf_counter()
        assert main_text(page) == "x"
        took.append(time.perf_counter() - begin)
    assert took[1] < 10 * took[0]


def test_passes():
    found = blocks(f"<p>{PROSE * 2}</p><p>Yes.</p><p><a href=1>one two three</a></p><p>No.</p><ul><li><a>x</a></ul>")
    labels = first_pass(found)
    assert labels == [True, None, False, None, False]
    assert second_pass(labels, [False] * 5) == [True, True, False, False, False]
    assert second_pass([False, None, None, True], [False, True, False, False]) == [False, True, True, True]
    assert second_pass([None, None], [False, False]) == [True, True]


def test_odd_pages():
    assert main_text("") == "" and main_text("   ") == ""
    assert main_text("just a line &lt;b&gt; &#x41;&nbsp;&#66; &amp") == "just a line <b> A B &"
    assert main_text("<p>a <b>b</p></i><p>c < d <3 & e</div>") == "a b\nc < d <3 & e"
    assert main_text("<article><p>cut off <a href='x") == "cut off"
    assert main_text("<article><p>one<br>two<br><br>three</article>") == "one two\nthree"
    assert main_text("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert main_text("<article><p title='a > b' data-x=\"</p>\">in</p></article>") == "in"
    assert len(main_text("<article><p>" + "word " * 400_000)) == 5 * 400_000 - 1


def test_defined_cases(spark):
    rows = [(1, None, "u"), (2, "", "u"), (3, "<p>x</p>", None), (3, "<p>x</p>", None)]
    pages = spark.createDataFrame(rows, "page_id long, html string, url string").selectExpr("*", "'old' AS text", "1 AS carried")
    got = extract_html(pages)
    assert got.columns == ["page_id", "url", "carried", "text"]
    assert sorted((r.page_id, r.text, r.carried) for r in got.collect()) == [(1, "", 1), (2, "", 1), (3, "x", 1), (3, "x", 1)]
    assert extract_html(pages.limit(0)).count() == 0
