import itertools
import random

from touchline.llm import html

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header class="site-header"><a href=/>Home</a></header>
<nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav><main><article><h1>A title &amp; more</h1>
<p>First paragraph of the story, with   some words.<br>And a line.</p><script>var x = "<p>no</p>";</script>
<p>Second paragraph&nbsp;of the story; it has marks, too.</p></article>
<div class="comments"><p>Great post, thank you for it, dear author of this.</p></div></main>
<aside class="sidebar"><p>Buy now, cheap things, only today, in our shop.</p></aside><footer><p>Copyright 2024, all rights.</p></footer></body></html>"""


def test_keeps_the_article_only():
    assert html.main_text(PAGE) == (
        "A title & more First paragraph of the story, with some words. And a line. Second paragraph of the story; it has marks, too."
    )


def test_hard_pages():
    assert html.main_text(None) == "" and html.main_text("") == "" and html.main_text("<p") == ""
    assert html.main_text("<p>Just one paragraph of plain words, unclosed, and long enough to count as text.") != ""
    line = "Some words of the article, which is long."
    assert html.main_text("<article>" + f"<p>{line}</p>" * 20_000 + "</article>") == " ".join([line] * 20_000)


#: Pages whose elements have no telling names; each block with whether it belongs to the article.
PLAIN = [
    [
        ("<div><div><a href=/>Home</a></div>", "Home", False),
        ("<div><a href=/n>News</a></div>", "News", False),
        ("<div>Pick one</div></div>", "Pick one", False),
        ("<div><p>The first paragraph, which tells of a long day at the harbour, and of the rain that came with it.</p>", None, True),
        ("<p>Yes</p>", "Yes", True),
        ("<p>He said so twice; nobody else, not even the captain, had an answer to that, and so they all went home.</p>", None, True),
        ("<p>Later</p>", "Later", True),
        ("<p>What came of it was told in many letters, all of them long, most of them lost before the year was over.</p></div>", None, True),
        ("<div><div><a href=/t>Terms</a></div>", "Terms", False),
        ("<div>All of it, as it is, is ours. Ask first, then wait.</div>", None, False),
        ("<div><a href=/p>Press</a></div></div>", "Press", False),
    ],
    [
        ("<table><tr><td><a href=/1>One</a></td>", "One", False),
        ("<td>Up to 9, or more: see below.</td>", None, False),
        ("<td><a href=/2>Two</a></td></tr></table>", "Two", False),
        ("<div>In the old town there stood a mill, a large one, which nobody had used for as long as people could think back; its roof was gone, its stones were green, and birds lived in it.</div>", None, True),
        ("<div>No one</div>", "No one", True),
        ("<div>But on that morning, so they say, its wheel turned: slowly at first, then faster, and in the end with a roar that was heard, it is told, on the far side of the hills.</div>", None, True),
    ],
]


def test_the_cut_labels_better_than_the_signs_of_the_costs():
    right = {"sign": 0, "cut": 0}
    total = 0
    for page in PLAIN:
        found = html.blocks("<body>" + "".join(markup for markup, *_ in page) + "</body>")
        wanted = [content for *_, content in page]
        assert len(found) == len(wanted) and all(text in (None, b.text) for b, (_, text, _) in zip(found, page, strict=True))
        labels = html.min_cut([b.cost for b in found], html.edges(found))
        right["sign"] += sum((b.cost > 0) == w for b, w in zip(found, wanted, strict=True))
        right["cut"] += sum(x == w for x, w in zip(labels, wanted, strict=True))
        total += len(wanted)
    assert right["cut"] == total > right["sign"]


STORY = [
    "The first paragraph of the story tells of a long day at the harbour, and of the rain that came with it that night.",
    "He said so twice; nobody else, not even the captain, had an answer to that, and so they all went home in silence.",
    "What came of it was told in many letters, all of them long, most of them lost before the year was over, sadly.",
    "In the old town there stood a mill, a large one, which nobody had used for as long as people could think back.",
    "But on that morning, so they say, its wheel turned: slowly at first, then faster, and in the end with a roar.",
]
WRAPPERS = [
    '<div class="post-with-sidebar">', '<div class="layout-sidebar-left">', '<div class="site header-fixed">', '<article id="review-123">',
    '<div class="single-review">', '<main class="social-science">', '<div class="warning-systems-article">',
    '<section aria-label="History of search engines">', '<form id="page">', '<div class="comments-open">', "<div>", '<article class="post">',
]
COMMENT = "<div><div>user{i}</div><div>Great post, thank you for it, dear author of this page, number {i}.</div><div><a href=#r{i}>Reply</a></div></div>"
AFTER = [
    "",
    "<div>" + "".join(COMMENT.format(i=i) for i in range(4)) + "</div><div>We use cookies to make this site better, and more useful. <a href=/c>Accept</a></div>",
    '<div id="comments"><p>Great post, thank you for it, dear author of this page.</p><p>I had another day at the harbour, with less rain.</p></div>',
]


def test_articles_in_wrappers_of_everyday_names():
    """36 pages: every wrapper with nothing after it, with reader comments and a notice without names, and with named comments."""
    body = "".join(f"<p>{t}</p>" for t in STORY)
    for wrapper in WRAPPERS:
        tag = wrapper[1:-1].split()[0]
        for after in AFTER:
            page = f"<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav>{wrapper}{body}</{tag}>{after}<footer>Copyright 2024, all of it.</footer></body></html>"
            assert html.main_text(page) == " ".join(STORY), (wrapper, after)


def test_names_keep_their_weight_beside_an_article():
    page = '<body><div class="x">' + "".join(f"<p>{t}</p>" for t in STORY) + '</div><div class="related"><p>Ten more mills that you will like, all of them by the sea.</p></div></body>'
    assert html.main_text(page) == " ".join(STORY)
    assert html.main_text('<body><div class="footer"><p>All of it, as it is, is ours, and stays so for all of time.</p></div></body>') == ""


def test_deep_and_broken_pages_take_linear_time():
    import time

    began = time.time()
    assert html.main_text("<div>" * 30_000 + "<p>A paragraph, deep inside, that is long enough to be kept, with marks.</p>" + "</div>" * 30_000)
    html.blocks("".join(f"<div>a{k}" for k in range(30_000)))
    html.blocks("<a b=\"" * 30_001 + "x" * 1000)
    html.blocks("<b>" * 30_000 + "<p>x" * 3000)
    assert time.time() - began < 20


def test_minimum_cut_matches_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randint(1, 7)
        costs = [rng.uniform(-3, 3) for _ in range(n)]
        links = [(i, j, rng.uniform(0, 3)) for i in range(n) for j in range(i) if rng.random() < 0.6]

        def price(side, costs=costs, links=links):
            return sum(max(0, -c) if s else max(0, c) for s, c in zip(side, costs, strict=True)) + sum(w for i, j, w in links if side[i] != side[j])

        least = min(map(price, itertools.product([False, True], repeat=n)))
        assert abs(price(html.min_cut(costs, links)) - least) < 1e-9


def test_rows_and_columns(spark):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (None, "v", "", "y"), (1, "u", PAGE, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = html.extract(pages).collect()
    assert len(found) == 4 and all(r["n_chars"] == len(r["text"]) for r in found)
    assert html.extract(pages.limit(0)).count() == 0
