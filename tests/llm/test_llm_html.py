"""Main text of pages against the article that the test pages mark, and hand-made pages."""

import re
from html import unescape

from fleetscope.llm.html_extract import extract_main_text, keep_lines, main_text


def article(page: str) -> str:
    body = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", body)
    texts = (re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", " ", b))).strip() for b in blocks)
    return "\n".join(t for t in texts if t)


def test_pages(spark, sf):
    rows = extract_main_text(spark.read.parquet(f"{sf}/pages.parquet").selectExpr("page_id", "url", "html", "html as raw")).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/pages.parquet").count()
    for r in rows:
        assert r["text"] == article(r["raw"]), r["page_id"]
        assert r["n_chars"] == len(r["text"])


def test_boilerplate_without_article():
    page = """<body><div id="top-nav"><a href=/>Home</a></div><div class="cookie-notice">We use cookies, a lot of them, every day.</div>
    <script>if (a < b) { document.write("</p>") }</script><style>p > a { x: "<p>" }</style>
    <div><p>The first paragraph is long enough to count as text &amp; carries caf&eacute; &#233; in it, and more.</p>
    <ul><li>short item</li></ul><p>The   second
    one closes<br>it.</p></div><p hidden>unseen</p>
    <section class="comments"><p>First! What a long and winding comment this is, longer than the article itself.</p></section>
    <form><label>Name</label></form><aside><p>Also read this and that and those, all of them very long titles.</p></aside>
    <footer>&copy; all rights reserved by everybody who ever wrote anything at all.</footer></body>"""
    want = "The first paragraph is long enough to count as text & carries café é in it, and more.\nshort item\nThe second one closes it."
    assert main_text(page) == want


def test_article_keeps_short_blocks_and_links():
    page = (
        '<header><h1>Site</h1></header><p>outside the article, long enough to be taken for text if it were not outside of it</p>'
        '<article><header><h1>Title</h1></header><p>Hi.</p><p><a href="x">a link line</a></p><table><tr><td>a<td>b</table>'
        '<div class="share">Tweet</div><p>End</article><nav>x</nav>'
    )
    assert main_text(page) == "Title\nHi.\na link line\na\nb\nEnd"


def test_link_lines_around_unmarked_text():
    page = "<div><a href=a>Home</a> <a href=b>News</a></div><div>Some words of a text that is long enough to be one.</div><div><a href=c>inside</a></div><div>More of it.</div><div><a href=d>Next page</a></div>"
    assert main_text(page) == "Some words of a text that is long enough to be one.\ninside\nMore of it."


def test_surge_and_dive():
    assert keep_lines([5, 0, 0, 0, 90, 40, 0, 60, 0, 0, 0, 4], 3, 80) == [False] * 4 + [True] * 4 + [False] * 4
    assert keep_lines([], 3, 80) == []


def test_edges(spark):
    df = spark.createDataFrame([(1, None, None, "k"), (2, "u", "", "k"), (2, "u", "", "k"), (3, "u", "<p>one", "k"), (4, "u", "<p>" + "x y " * 300_000 + "</p", "k")], "page_id long, url string, html string, text string")
    out = {(r["page_id"], r["text"], r["n_chars"]) for r in extract_main_text(df).collect()}
    assert {(1, "", 0), (2, "", 0), (3, "one", 3)} <= out and extract_main_text(df).count() == 5
    assert max(n for _, _, n in out) == 1_199_999
    assert extract_main_text(df.limit(0)).count() == 0


TEXT = "The river rose for three days before anyone in the valley thought of moving the cattle, and by then it was late."
MORE = "When the bridge went, the two halves of the town wrote each other letters and tied them to arrows for a week."
WANT = f"{TEXT}\n{MORE}"


def test_names_of_a_wrapper_do_not_hide_the_text():
    text = f"<p>{TEXT}</p><p>{MORE}</p>"
    side = '<div class="sidebar"><p>Most read this week: nine ways to peel an orange.</p></div>'
    for page in (
        f'<body><div class="has-sidebar layout">{text}{side}</div></body>',
        f'<body><div class="widget-area">{text}</div>{side}</body>',
        f'<body><form action="/x">{text}<input name="q"><select><option>One</option></select></form>{side}</body>',
        f'<body><div class="layout-nav-top"><nav><a href="/">Home</a></nav><div id="elementor-widget-container">{text}</div></div>{side}</body>',
    ):
        assert main_text(page) == WANT
        assert main_text(page.replace("<div", "<section").replace("</div", "</section")) == WANT


def test_cards_of_other_articles_are_not_the_text():
    card = '<article class="card"><h3><a href="/{0}">Another story, number {0}</a></h3></article>'
    page = f"<body><div><p>{TEXT}</p><p>{MORE}</p></div><div>{card.format(1)}{card.format(2)}{card.format(3)}</div></body>"
    assert main_text(page) == WANT
    assert main_text(f"<body><div><p>{TEXT}</p><p>{MORE}</p><p>{TEXT}</p></div><div>{card.format(1)}</div></body>") == f"{WANT}\n{TEXT}"


def test_distribution_decides_without_the_mark(spark, sf):
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        unmarked = re.sub(r"<(/?)(?:article|main)\b", r"<\1div", r["html"])
        assert main_text(r["html"]) == article(r["html"])
        assert main_text(unmarked) == article(r["html"]), r["page_id"]


def test_long_comments_below_an_article():
    comments = "".join(f"<div class='comment'><p>{MORE} {k}</p></div>" for k in range(3))
    assert main_text(f"<article><p>{TEXT}</p><p>{MORE}</p><p>{TEXT}</p></article><section id='comments'>{comments}</section>") == f"{WANT}\n{TEXT}"
