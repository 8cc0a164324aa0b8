"""Pages that a site style tree must not empty."""

import odd
import pytest

from rollbook.llm import site_style


def texts(spark, pages):
    return {r.page_id: r.text for r in site_style.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}


NOTICE = '<div class="x2"><p>Read all our stories</p></div>'


@pytest.mark.parametrize("copies", [5, 1000])
@pytest.mark.parametrize("urls", ["https://a.example.org/1", "https://a.example.org/1?from=%d", None, "no address"])
def test_copies_keep_their_text(spark, copies, urls):
    html = f'<body><div class="x1"><p>{odd.prose(9, 1)}</p></div></body>'
    pages = [(n, urls % n if urls and "%" in urls else urls, html) for n in range(copies)]
    pages += [(n, f"https://a.example.org/{n}", f'<body><div class="x1"><p>{odd.prose(9, n)}</p></div>{NOTICE}</body>') for n in range(2000, 2020)]
    got = texts(spark, pages)
    assert {got[n] for n in range(copies)} == {odd.prose(9, 1)}
    assert all(got[n] == odd.prose(9, n) for n in range(2000, 2020))


def test_wrapper_of_an_article_stays(spark):
    html = f'<body><div class="wrap"><article><p>{odd.prose(9, 1)}</p></article></div></body>'
    pages = [(n, f"https://a.example.org/{n}", html.replace("<p>", f"<p>{n % 2} ")) for n in range(12)]
    got = texts(spark, pages)
    assert all(got[n] == f"{n % 2} {odd.prose(9, 1)}" for n in range(12))
    tree = site_style.parsed(html)
    around = {p for n, p in site_style.walk(tree) if not n.main}
    assert site_style.main_text(tree, around) == odd.prose(9, 1)


@pytest.mark.parametrize(
    "html",
    [
        '<article class="post comments-open">%s</article>',
        '<main class="content no-sidebar">%s</main>',
        '<div role="main" id="ad">%s</div>',
        '<div class="content-with-sidebar"><article>%s</article></div>',
        '<article><div class="entry-header"><h1>%s</h1></div><div class="related">x</div></article>',
        '<article>%s<section id="comments"><article class="comment">x</article></section><div class="ad">x</div></article><div class="sidebar">x</div>',
    ],
)
def test_class_words_keep_the_article(html):
    assert site_style.main_text(site_style.parsed(f"<body>{html % 'Title'}</body>"), set()) == "Title"


def test_repeated_box_inside_articles(spark):
    page = '<body><div class="wrap"><article><h1>About {0}</h1><p>{1}</p><div class="x2"><p>Read all our stories</p></div></article></div></body>'
    pages = [(n, f"https://a.example.org/{n}", page.format(n, odd.prose(30, n))) for n in range(12)]
    got = texts(spark, pages + [(50, "https://b.example.org/", page.format(50, odd.prose(30, 50)))])
    assert all(got[n] == f"About {n}\n{odd.prose(30, n)}" for n in range(12))
    assert got[50] == f"About 50\n{odd.prose(30, 50)}\nRead all our stories"


def test_one_story_on_several_pages_stays(spark):
    pages = [(n, f"https://a.example.org/{n}", f'<article><h1>Part {n}</h1><div class="x1"><p>{odd.prose(30, 1)}</p></div></article>') for n in range(12)]
    got = texts(spark, pages)
    assert all(got[n] == f"Part {n}\n{odd.prose(30, 1)}" for n in range(12))
