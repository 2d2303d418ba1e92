"""Main text of pages, against what a reader would take."""

import pytest

from tidewash.llm import main_text

PROSE = "It rained all night, said the keeper, and the river rose."
WRAPPERS = [
    ("<div class='page has-sidebar'>", "</div>"), ("<div class='content-sidebar-wrap'>", "</div>"), ("<form id='aspnetForm'>", "</form>"),
    ("<div id='search-results-page'><nav>menu</nav>", "<div class='sidebar'><p>Aside, a side.</p></div></div>"),
]
CASES = [
    (None, ""), ("", ""), ("plain  text", "plain text"), ("<p>a<p>b", "a\nb"), ("<nav>menu</nav><script>x</script>", ""),
    ("<div id=main><p>One, two.<div class='ad'>x</div></div><nav>m</nav>", "One, two."),
    ("<body><header>h</header><main><header><h1>T</h1></header><p>x &lt; y&nbsp; z<br>q</p><aside>s</aside>"
     "<section id='comments'><p>c</p></section></main><form>f</form>", "T\nx < y z q"),
    ("<article><h1>A</h1><ul><li>x<li>y</ul><p>z</article><footer>f", "A\nx\ny\nz"),
    ("<article><div class=ad><p>q</div><p>ok</p></article>", "ok"), ("<p>1 < 2 and <b>3</p>", "1 < 2 and 3"),
    ("<script>var t=\"</p>\";</script><article><p><b>open.<br><p>Next&amp;&amp;</p></article><footer>&copy; f</footer>", "open.\nNext&&"),
    ("<div class=story><p>" + "Long text, with commas. " * 20 + "</p></div><div><a href=x>" + "link " * 40 + "</a></div>",
     ("Long text, with commas. " * 20).strip()),
    ("<article><p>" + "x" * 300_000 + "</p></article>", "x" * 300_000), ("<!-- open comment <p>a</p>", ""),
    *[(f"<body>{open_}<article><h1>Title</h1><div class='body'><p>{PROSE}</p></div></article>{close}</body>", f"Title\n{PROSE}") for open_, close in WRAPPERS],
    *[(f"<body>{open_}<div class='text'><h1>Title</h1><p>{PROSE}</p><p>{PROSE}</p></div>{close}</body>", f"Title\n{PROSE}\n{PROSE}") for open_, close in WRAPPERS],
    (f"<article><section id='search-methods'><h2>Search</h2><p>{PROSE}</p></section><p class='social-history'>Lives alone.</p></article>", f"Search\n{PROSE}\nLives alone."),
    (f"<div><h1>A headline</h1><div class='body'><p>{PROSE}</p><p>{PROSE}</p></div></div>", f"A headline\n{PROSE}\n{PROSE}"),
    ("<p>Hello <span class='share'>x</span> world</p>", "Hello world"), ("<p>a <span class='ad'><span>Buy</span> now cheap</span> b</p>", "a b"),
    ("<article><p>a <span class='ad'>open <b>x</p><p>next.</p></article>", "a\nnext."),
    (f"<article><p>{PROSE}</p></article><section class='comments'><article><p>{PROSE * 9}</p></article></section>", PROSE),
    (f"<main><p>{PROSE}</p><div class='related-posts'><a href=x>More, and more</a></div><div class='ad-slot'>Buy now, cheap.</div></main>", PROSE),
    (f"<article><p>{PROSE}</p><form><label>Your mail</label><input><button>Go</button></form></article>", PROSE),
    ("<article><p>&lt;p&gt; &#233; &eacute;&unknown;</p></article>", "<p> é é&unknown;"),
]


@pytest.mark.parametrize("page, text", CASES)
def test_text(page, text):
    assert main_text.main_text(page) == text


def test_rows(spark):
    rows = [(k, None if k % 2 else f"u{k}", page, "x", 1) for k, (page, _) in enumerate(CASES)] + [(None, "u", "<p>a", "x", 1)] * 2
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, n_chars int")
    got = sorted(main_text.extract(pages).collect(), key=lambda r: (r.page_id is None, r.page_id))
    assert [(r.page_id, r.url, r.text, r.n_chars) for r in got[:-2]] == [(k, None if k % 2 else f"u{k}", t, len(t)) for k, (_, t) in enumerate(CASES)]
    assert got[-1].text == got[-2].text == "a"
    assert main_text.extract(pages.limit(0)).count() == 0
