from __future__ import annotations

import pytest

from tidepanel.llm import html_extract as H

SHELL = '<html><head><title>t</title></head><body><nav><a href=/>Home</a></nav>{}<footer>foot</footer></body></html>'
CASES = {
    "article": (SHELL.format("<article><h1>A &amp; B</h1><p>one  two<br>three<p>four</article>"), "A & B\none two three\nfour"),
    "no article": ("<body><div class=header>x</div><div id=content><p>text</p></div><div class='sidebar'>s</div></body>", "text"),
    "comments": (SHELL.format("<main><p>body</p><div class='comments'><p>reader says</p></div></main>"), "body"),
    "form and script": (SHELL.format("<article><script>var a='</p>';</script><p>x</p><form>mail</form><style>p{}</style></article>"), "x"),
    "notice": ("<body><div class='cookie-notice'>we use</div><p>real</p></body>", "real"),
    "nested sidebar name": ("<body><div class='with-sidebar'><p>kept</p></div></body>", "kept"),
    "references": ("<p>&lt;b&gt; &#233; &copy &nbsp; x</p>", "<b> é © x"),
    "cut off": ("<article><p>one</p><p>two <b", "one\ntwo"),
    "unclosed": ("<article><p><b>one<br><p>two</article>", "one\ntwo"),
    "comment": ("<article><!-- <p>no</p> --><p>yes</p></article>", "yes"),
    "plain": ("just text", "just text"),
    "header in article": ("<article><header><h1>T</h1></header><p>x</p><footer>f</footer></article>", "T\nx"),
    "empty": ("", ""),
    "deep": ("<div>" * 5000 + "x" + "</div>" * 5000, "x"),
    "lists": ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a\nb\nc\nd"),
}


@pytest.mark.parametrize("name", CASES)
def test_one_page(name):
    page, want = CASES[name]
    assert "\n".join(t for _, t in H.content_blocks(page)[1]) == want


OPEN = {
    "custom element": ("<article><p>a</p><svg-icon name=x></svg-icon><p>kept</p></article>", "a\nkept"),
    "custom elements": ("<article><video-player>v</video-player><p>one</p><button-group><p>two</p></button-group><title-bar>t</title-bar><p>three</p></article>", "v\none\ntwo\nt\nthree"),
    "unclosed button": ("<article><button>go<p>one</p><button>no</button><p>two</p></article>", "go\none\ntwo"),
    "unclosed others": ("<article><object data=x><audio src=y><select><p>kept</p></article>", "kept"),
    "closed": ("<article><svg><title>t</title><p>no</p></svg><p>x</p><object><object>no</object>no</object><button>no</button></article>", "x"),
    "raw to the end": ("<article><p>x</p><script>var a = '<p>no</p>'", "x"),
}


@pytest.mark.parametrize("name", OPEN)
def test_elements_that_hold_no_text(name):
    page, want = OPEN[name]
    assert "\n".join(t for _, t in H.content_blocks(page)[1]) == want


def test_many_unclosed_elements_take_linear_time():
    assert len(H.content_blocks("<button><object>" * 100_000 + "<p>x")[1]) == 1


NAMES = {
    "share price": ("<article><div class='share-price'>Share price rose</div><div class='form-factor'>text</div><p id=searchResults2>kept</p></article>", "Share price rose\ntext\nkept"),
    "parts of names": ("<body><div class='related-work'>a</div><div class='legal-theory'>b</div><div class='tags-of-the-city'>c</div><div class='alert-mountain'>d</div></body>", "a\nb\nc\nd"),
    "regions": ("<body><div class=siteHeader>no</div><div class='main-nav'>no</div><div id='comments-list'>no</div><div class='ad-300x250'>no</div><div class='cookieNotice top'>no</div><p>yes</p></body>", "yes"),
    "formula": ("<article><p>Let <math>x</math> be</p></article>", "Let x be"),
}


@pytest.mark.parametrize("name", NAMES)
def test_names_of_regions(name):
    page, want = NAMES[name]
    assert "\n".join(t for _, t in H.content_blocks(page)[1]) == want


def tree(name, *kids):
    rows = [(0, name)]
    for k in kids:
        rows += [(d + 1, n) for d, n in k]
    return rows


def test_simple_tree_matching():
    t = tree
    a = H.Tree(t("r", t("a", t("x"), t("y")), t("b"), t("c")))
    assert H.match(a, a)[0, 0] == 6
    assert H.match(a, H.Tree(t("r", t("b"), t("a"))))[0, 0] == 2
    assert H.match(a, H.Tree(t("q"))) == {}


def test_alignment_keeps_matched_nodes_and_adds_others():
    t, template = tree, H.Template()
    first = template.merge(H.Tree(t("", t("a"), t("c"))), [3, 3, 3])
    second = template.merge(H.Tree(t("", t("a"), t("b"), t("c"))), [2, 2, 2, 2])
    assert second[1] == first[1] and second[3] == first[2] and second[2] not in first
    assert template.pages[second[2]] == 2 and template.pages[first[1]] == 5
    again, pages = H.tree_of(template.text())
    assert again.names == ["", "a", "b", "c"] and pages == [5, 5, 2, 5]
    assert sorted(H.nodes_in(again, H.Tree(t("", t("c"), t("d"))))) == [(0, 0), (1, 3)]


def test_deep_and_long_pages_through_the_whole_extraction(spark):
    deep = "<article>" + "".join(f"<div class=d{'abc'[i % 3]}>" + (f"level {i}" if i % 1000 == 0 else "") for i in range(6000)) + "</div>" * 6000 + "<p>end</p></article>"
    lost = "<div>" * 20_000 + "<p>x</p>" + "</section>" * 20_000
    long = "<article>" + "".join(f"<p>paragraph {i} of many</p>" for i in range(30_000)) + "</article>"
    rows = [(i, "http://a.example/%d" % i, page) for i, page in enumerate([deep, deep.replace("level 0", "other"), lost, long, deep.replace("end", "END")] * 2)]
    out = {r.page_id: r.text for r in H.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[0] == "\n".join([f"level {i}" for i in range(0, 6000, 1000)] + ["end"]) == out[5] and out[4].endswith("END")
    assert out[2] == "x" and out[3].count("\n") == 29_999


def test_hand_labelled_pages_of_a_host(spark):
    """Pages are put together from labelled parts; the parts labelled as text are what must come out."""
    import random

    rng = random.Random(5)
    words = lambda n: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) for _ in range(n))
    rows, want = [], {}
    for i in range(60):
        own = [f"{words(8)} {i}" for _ in range(rng.randint(1, 6))]
        parts = [(False, f"<nav><a href=/>{words(2)}</a></nav>"), (False, f"<div class='ad'>{words(5)}</div>"), (True, own[0])]
        body = [(True, f"<h1>{own[0]}</h1>")] + [(True, f"<p>{x}</p>") for x in own[1:]]
        fixed = [(False, "<p>Sign up for our letter today</p>"), (False, f"<section class=comments><p>{words(9)}</p></section>")]
        shown = body[: len(body) // 2 + 1] + ([fixed[0]] if i % 5 else []) + body[len(body) // 2 + 1 :] + fixed[1:]
        html = "<body>" + "".join(h for _, h in parts[:2]) + "<article>" + "".join(h for _, h in shown) + f"</article><aside>{words(4)}</aside><footer>&copy; {i}</footer></body>"
        rows.append((i, f"https://h{i % 2}.example/{i}", html))
        want[i] = "\n".join(own)
    out = {r.page_id: r.text for r in H.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == want


def test_constants_of_a_host_become_template(spark):
    page = "<article><p>story {0}</p><p>more of {0}</p><div><p>Read on our app</p></div></article>"
    rows = [(i, "http://a.example/%d" % i, page.format(i), 1) for i in range(12)]
    rows += [(100, "http://b.example/1", page.format("b"), 1), (101, None, page.format("n"), 1), (102, "http://a.example/x", None, 1), (103, "http://a.example/0", rows[0][2], 1)]
    out = {r.page_id: r.text for r in H.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, host int")).collect()}
    assert out[3] == "story 3\nmore of 3" and out[103] == out[0]
    assert out[100] == "story b\nmore of b\nRead on our app" and out[102] == ""
    assert out[101] == "story n\nmore of n\nRead on our app"


def test_equal_pages_are_no_template(spark):
    rows = [(i, "http://a.example/", "<article><p>same</p></article>") for i in range(30)]
    assert {r.text for r in H.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"same"}


def test_near_equal_pages_are_no_template(spark):
    story = "".join(f"<p>paragraph {k} of one long article that many pages of the host repeat word by word</p>" for k in range(5))
    tail = "<div><p>Read on our app</p></div></article>"
    copies = [(i, "http://a.example/", f"<article><p>seen {i} times</p>{story}</article><!-- {i} -->") for i in range(30)]
    mixed = [(100 + i, "http://b.example/", f"<article><p>seen {i} times</p>{story}{tail}") for i in range(30)]
    mixed += [(200 + i, "http://b.example/", f"<article>{story.replace('article', f'story{i}')}{tail}") for i in range(10)]
    out = {r.page_id: r.text.split("\n") for r in H.extract_text(spark.createDataFrame(copies + mixed, "page_id long, url string, html string")).collect()}
    assert all(len(out[i]) == 6 and out[i][0] == f"seen {i} times" for i in range(30))
    assert all(len(out[100 + i]) == 6 for i in range(30)) and all(len(out[200 + i]) == 5 for i in range(10))


def test_names_of_single_pages_do_not_split_a_template(spark):
    page = "<article id=post-{0} class='post post-{0} tag-a{0}'><p>story {0} of many words</p><p>more of {0}</p><div id=app-{0}><p>Read on our app</p></div></article>"
    rows = [(i, "http://a.example/%d" % i, page.format(i)) for i in range(12)]
    rows += [(100 + i, "http://b.example/%d" % i, "<article>" + "<div>" * (i % 9) + f"<p>own text {i}</p>" + "</div>" * (i % 9) + "<footer>f</footer><section><p>Read on</p></section></article>") for i in range(90)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r.page_id: r for r in H.extract_text(pages).collect()}
    assert all(out[i].text == f"story {i} of many words\nmore of {i}" for i in range(12))
    assert all(out[100 + i].text == f"own text {i}" for i in range(90))
    _, nodes, _ = H.induce(pages, fan=2)
    assert nodes.where("host = 'b.example'").select("shape").distinct().count() == 9
    assert nodes.where("host = 'b.example' and node > 0").select("node").distinct().count() >= 9


def test_empty_table_and_query(spark):
    assert H.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    out = H.op3_html_extract(spark, "/root/testdata/sf0.001").collect()
    assert len(out) == 50 and all(r.n_chars == len(r.text) and "©" not in r.text for r in out)


def texts_of(page):
    return [t for _, t in H.content_blocks(page)[1]]


def test_raw_text_ends_where_the_standard_ends_it():
    assert texts_of("<p>one</p><svg><title/></svg><p>two</p>") == ["one", "two"]
    assert texts_of("<p>one</p><svg><style/><path/></svg><p>two</p>") == ["one", "two"]
    assert texts_of("<p>one</p><script>if (a < b) { '<p>no</p>' }</script><p>two</p>") == ["one", "two"]
    assert texts_of("<p>one</p><script src=x /><p>two</p>") == ["one", "two"]
    assert texts_of("<p>one</p><svg><title>icon<p>two</p>") == ["one", "icon", "two"] or texts_of("<p>one</p><svg><title>icon<p>two</p>")[-1] == "two"
    assert texts_of("<p>one</p><style>p { }") == ["one"]
    assert texts_of("<svg><foreignObject><p>in</p></foreignObject></svg><p>out</p>") == ["out"]


def test_comments_by_their_names():
    for name in ("comment-body", "comment-content", "user-comment-text", "user-opinions"):
        assert texts_of(f"<article><p>story</p></article><div class={name}><p>I disagree</p></div>") == ["story"], name


def test_matter_of_an_article_is_not_a_region():
    page = "<article><p>story</p><section class=legal><p>the law</p></section><div class=search><p>the hunt</p></div></article>"
    assert texts_of(page) == ["story", "the law", "the hunt"]


def test_a_teaser_is_not_the_article():
    story = "<div class=story>" + "".join(f"<p>a long paragraph of the story, number {i}</p>" for i in range(6)) + "</div>"
    assert len(texts_of("<article class=teaser><p>read this next</p></article>" + story)) == 7
    assert texts_of("<main><p>the story itself, long enough</p></main><div><p>aside</p></div>") == ["the story itself, long enough"]
