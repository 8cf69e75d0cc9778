import itertools
import random

from strataloom.llm.html_mincut import extract, main_text, min_cut

P = "This is a long sentence of the article that says something, and it goes on for a while. " * 2


def test_page_with_all_kinds_of_boilerplate():
    page = f"""<!DOCTYPE html><html lang="en"><head><title>T &amp; U</title><style>p{{}}</style><script>var t="</p>";</script></head>
    <body class="has-sidebar"><header><a href="/">Home</a><h2>Site name</h2></header><nav><ul><li><a href="/a">a</a><li><a href="/b">b</a></ul></nav>
    <div class="cookie-notice"><p>{P}</p></div><div class="ad">Buy this now. It is good.</div>
    <article><h1>A   title &amp; more</h1><p><b>{P}<br><p>Short.</p><div class="ad"><p>{P}</p></div><p>Fish &#38; chips&nbsp;here</p><ul><li>One item of a list.</li></ul>
    <form><label>Name</label><input></form></article><aside class="sidebar"><p>{P}</p></aside>
    <section id="comments"><h3>Comments</h3><div class="comment"><p>{P}</p></div></section><footer>&copy; x &middot; y</footer></body></html>"""
    assert main_text(page) == "\n".join(["A title & more", P.strip(), "Short.", "Fish & chips here", "One item of a list."])


def test_page_without_article_is_smoothed():
    page = f"<html><body><div><a href=x>Home</a> <a href=y>News</a></div><div><p>{P}</p><p>Yes.</p><p>{P}</p></div><div class=footer>Imprint</div>"
    assert main_text(page) == f"{P.strip()}\nYes.\n{P.strip()}"


def test_names_of_regions():
    page = f'''<body><div class="content no-sidebar"><article><div class="post-header"><h1>Title</h1></div><p>{P}</p><ol class="commentlist"><li><p>{P}</p></li></ol>
    <p class="notice">{P}</p><div class="advertBox"><p>{P}</p></div></article></div><div id="sideBar" role="complementary"><p>{P}</p></div><div class="cookiebar"><p>{P}</p></div>'''
    assert main_text(page) == f"Title\n{P.strip()}"


def test_broken_pages():
    assert main_text(None) == main_text("") == main_text("<nav><a href='x'>y</a>") == main_text("<!-- open") == main_text("<script>x") == ""
    assert main_text(f"<article><p>{P}") == P.strip()
    assert main_text("<" * 2000 + "p" * 10) is not None
    assert main_text("<a title='x" * 3000) is not None


def test_cut_is_minimal():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 8)
        gain = [rng.uniform(-2, 2) for _ in range(n)]
        edges = {(i, j): rng.uniform(0, 1.5) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5}
        cost = lambda x: sum(max(0, g) if not k else max(0, -g) for g, k in zip(gain, x)) + sum(w for (i, j), w in edges.items() if x[i] != x[j])
        best = min(map(cost, itertools.product([False, True], repeat=n)))
        assert abs(cost(min_cut(gain, edges)) - best) < 1e-9


def test_many_blocks():
    page = "<article>" + "".join(f"<p>Word {i} here.</p>" for i in range(20000)) + "</article>"
    assert main_text(page).count("\n") == 19999


def test_operator(spark):
    pages = spark.createDataFrame([(1, "u", f"<article><p>{P}é</p></article>", 5), (2, None, None, 5)], "page_id long, url string, html string, n_chars int")
    assert sorted(map(tuple, extract(pages).collect())) == [(1, "u", P + "é", len(P) + 1), (2, None, "", 0)]
    assert extract(pages.limit(0)).count() == 0
