"""Main text of pages against texts that are known beforehand."""

import random

import pytest

from tidemill.llm import wrappers


def texts(spark, pages, **columns):
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in wrappers.extract_text(df).collect()}


def words(rng, n):
    return " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet", "elit"]) + str(rng.randrange(1000)) for _ in range(n))


def test_articles_without_furniture(spark):
    rng = random.Random(1)
    pages, want = [], {}
    for i in range(12):
        paragraphs = [words(rng, rng.randrange(1, 40)) for _ in range(rng.randrange(1, 6))]
        pages.append(
            (
                "HTTP://User@News.example.com:80/a",
                f"<!doctype html><html><head><title>{words(rng, 4)}</title><style>p {{}}</style></head><body class=x><header><p>{words(rng, 60)}</p></header>"
                f"<nav><ul><li><a href='/'>{words(rng, 30)}</a></ul></nav><div class='cookie-notice'>We use cookies {words(rng, 50)}</div>"
                f"<article><h1>A &amp; B {i}</h1>" + "".join(f"<p>{p[:3]}<b>{p[3:]}</b>" for p in paragraphs) + "<script>if (a < b) c('<p>no</p>')</script>"
                f"<form><p>{words(rng, 9)}<input></p></form><section id=comments><p>{words(rng, 80)}</p></section></article>"
                f"<aside class='side'><p>{words(rng, 90)}</p></aside><footer>&copy; {words(rng, 40)}</footer></body></html>",
            )
        )
        want[i] = "\n\n".join([f"A & B {i}", *paragraphs])
    assert texts(spark, pages) == want


def test_the_main_part_is_inferred_where_nothing_names_it(spark):
    """Only the host's pages together tell the part with the text from a column of links and a few fixed words."""
    rng = random.Random(2)
    pages, want = [], {}
    for i in range(20):
        paragraphs = [words(rng, rng.randrange(30, 60)) for _ in range(rng.randrange(2, 7))]
        if i == 7:
            paragraphs = ["tiny"]
        links = "".join(f"<div><a href=x>{words(rng, 3)}</a></div>" for _ in range(rng.randrange(2, 20)))
        pages.append(
            ("https://b.example.org/", f"<div class=top>{links}<div>Our site</div></div><div class=text{i}><h2>T{i}</h2><div class=by>Read it aloud</div>" + "".join(f"<div>{p}</div>" for p in paragraphs) + "</div><div class=low><p>All rights reserved by us and by nobody else</p></div>")
        )
        want[i] = "\n\n".join([f"T{i}", *paragraphs])
    assert texts(spark, pages) == want


def test_repeats_options_and_slots():
    one = wrappers.folded(wrappers.parse("<div><h1>a</h1><h2>x</h2><p>b</p><h2>y</h2><p>c</p><p>d</p></div>"))
    two = wrappers.folded(wrappers.parse("<div><h1>a</h1><ul><li>q</ul></div>"))
    (box,) = wrappers.merge(one, two).kids
    assert [(k.label, k.optional, k.many, k.pages) for k in box.kids] == [("h1", False, False, 2), ("h2", True, True, 1), ("p", True, True, 1), ("ul", True, False, 1)]
    assert box.kids[0].kids[0].text == "a" and box.kids[1].kids[0].text is None
    same = wrappers.Node.load(wrappers.merge(one, two).dump())
    assert same.dump() == wrappers.merge(one, two).dump()


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain &lt;text&gt; &amp no end", "plain <text> & no end"),
        ("<article><p>a <br>b&nbsp;&#99;\n\t d<p>e<i>f</i>g<hr>h<li>i<li>j<td>k", "a b c d\n\nefg\n\nh\n\ni\n\nj\n\nk"),
        ("<p>1 < 2 and 3 > 2</p></div></p><p>x", "1 < 2 and 3 > 2\n\nx"),
        ("<article title='a>b' data=\">\"><p>x<!-- <p>y --><script>'</p>'</SCRIPT >z</article><style>", "xz"),
        ("<article>cut <b", "cut"),
        ("<article>cut <a href='x", "cut"),
        ("<!-- never closed <p>x", ""),
        ("<title>only", ""),
        ("<nav>all <p>furniture</nav>", ""),
        ("<div class='page with-sidebar no-ads'><div id=x class='post has-comments'><p>kept</div><div class='post-comments'><p>a reader's</div><div role=navigation>menu</div></div>", "kept"),
        ("<head><meta charset=x><p>no body</p>", "no body"),
    ],
)
def test_odd_pages(spark, page, text):
    tree = wrappers.parse(page or "")
    assert "\n\n".join(wrappers.Reader(wrappers.folded(tree))(tree)) == text


def test_unusual_rows(spark, monkeypatch):
    big = "<article>" + "".join(f"<p>long {k}</p>" for k in range(30_000)) + "</article>"
    deep = "<div>" * 20_000 + "deep"
    rows = [(1, None, None), (1, "http://a/", "<p>x"), (1, "http://a/", "<p>x"), (None, "no address", "<p>y"), (2, "http://[", big), (3, "", ""), (4, "http://deep/", deep)]
    df = spark.createDataFrame([(*r, "own", 1) for r in rows], "page_id int, url string, html string, text string, wrapper int")
    want = sorted([(1, ""), (1, "x"), (1, "x"), (None, "y"), (2, "\n\n".join(f"long {k}" for k in range(30_000))), (3, ""), (4, "deep")], key=str)
    assert sorted(((r.page_id, r.text) for r in wrappers.extract_text(df).collect()), key=str) == want
    monkeypatch.setattr(wrappers, "BROADCAST_BYTES", 0)
    assert sorted(((r.page_id, r.text) for r in wrappers.extract_text(df).collect()), key=str) == want
    assert wrappers.extract_text(df.where("false")).collect() == []


def test_one_wrapper_per_host_whatever_the_partitions(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "FAN_IN", 2)
    pages = [(i, f"http://h{i % 3}.example/", f"<div class=a><p>{'t' * i}</p></div>" + "<ul><li>x</ul>" * (i % 2)) for i in range(60)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(9)
    found = wrappers.infer_wrappers(df).collect()
    assert sorted(r.host for r in found) == ["h0.example", "h1.example", "h2.example"]
    assert all('"ul"' in r.wrapper for r in found)
