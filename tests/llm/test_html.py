"""HTML extraction: tree matching against a brute force, induction without names, and the cases of the docstring."""
import random

import pytest

from textquarry.llm import html_text as H


def tree(rng, depth=0):
    tag = rng.choice(["div", "section", "ul"])
    inner = "".join(tree(rng, depth + 1) for _ in range(rng.randint(0, 3))) if depth < 3 else ""
    return f"<{tag}>{inner}</{tag}>"


def brute(a, b):
    """Simple tree matching by plain recursion over all children."""
    if a.label != b.label:
        return 0
    xs, ys = a.elements, b.elements
    best = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    for i, x in enumerate(xs):
        for j, y in enumerate(ys):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + brute(x, y))
    return 1 + best[-1][-1]


def test_tree_matching():
    rng = random.Random(1)
    for _ in range(150):
        a, b = (H.weigh(H.parse(tree(rng) + tree(rng))) for _ in range(2))
        pairs = list(H.Matching().pairs(a[0], b[0]))
        assert H.Matching().size(a[0], b[0]) == brute(a[0], b[0]) == len(pairs)
        assert len({x.place for x, _ in pairs}) == len({y.place for _, y in pairs}) == len(pairs)
        partner = {x.place: y for x, y in pairs}
        assert all(x.label == y.label and (x.up is None or partner[x.up.place] is y.up) for x, y in pairs)
    many = [H.weigh(H.parse("".join(f"<p>{k}</p>" + "<div><b>x</b></div>" * (k % n == 0) for k in range(3000)))) for n in (3, 7)]
    assert H.Matching().size(many[0][0], many[1][0]) > 3000


def page(k, body, foot="All rights reserved"):
    menu = "".join(f"<a href=/{k}x{j}>entry {k} {j}</a>" for j in range(5))
    return f"<html><body><div class=top>{menu}</div><div class=x><p>Follow us for more</p><div class=y>{body}</div><div class=z>{foot}</div></div></body></html>"


def test_induction_needs_no_names(spark, monkeypatch):
    monkeypatch.setattr(H, "DROP_WORDS", frozenset())
    monkeypatch.setattr(H, "DROP_TAGS", frozenset())
    body = lambda k: f"<h1>Title {k}</h1><p>lede {k} and more</p><div class=body><p>first {k} " + "long text " * 9 + f"</p><p>see <a href=/>here</a> for {k}</p></div><div><p>Subscribe to us</p></div>"
    sources = [page(k, body(k)) for k in range(4)]
    trees = [H.weigh(H.parse(s)) for s in sources]
    wrapper = H.induce(trees[0], sum(H.align(trees[0], t) for t in trees[1:]), 3)
    for k, s in enumerate(sources):
        assert H.extract(s, wrapper) == f"Title {k}\n\nlede {k} and more\n\nfirst {k} {('long text ' * 9).strip()}\n\nsee here for {k}"
    assert "Subscribe" in H.extract(sources[0]) and "entry 0 0" in H.extract(sources[0])


def test_copies_give_no_evidence():
    text = "<h1>One title</h1><p>" + "the same article " * 30 + "</p>"
    trees = [H.weigh(H.parse(page(0, text + f"<p>print {k}</p>"))) for k in range(5)]
    assert all(H.align(trees[0], t) is None for t in trees[1:])


@pytest.mark.parametrize(
    ("source", "want"),
    [
        (None, ""),
        ("", ""),
        ("<p title=it's>one<p>two<p title='x>y'>three", "one\n\ntwo\n\nthree"),
        ('<p>a < b and c</p><p class="x>open', "a < b and c\n\nopen"),
        ("<article><h2 id=related-work>Related</h2><p class=notice-period>A month</p><section id=search-engines>They search</section><div class='comment-list'>Nice</div></article>", "Related\n\nA month\n\nThey search"),
        ("<article><header><h1>T</h1></header><p>x</p><footer>f</footer></article><header>Site</header>", "T\n\nx"),
        ("<body>" + "<span>" * 205 + "<nav>menu</nav>text" + "</span>" * 205 + " tail", "text tail"),
        ("<div>" * 30000 + "deep", "deep"),
        ("<p title=\"x>it's", "it's"),
        ("<p>1&nbsp;&lt;\n 2</p><!-- no --><![CDATA[yes]]><script>var a='<p>no</p>'</script>", "1 < 2\n\nyes"),
        ("<article>a</article><article>b<article>c</article></article>", "a\n\nb\n\nc"),
    ],
)
def test_single_pages(source, want):
    assert H.extract(source) == want


def test_pages(spark, monkeypatch):
    rows = [(k, f"https://a.example/{k}", page(k, f"<h1>Title {k}</h1><p>First <b>bold {k}</b> text<br>more &amp; more<p>Second {k}")) for k in range(6)]
    rows += [(5, rows[5][1], rows[5][2]), (100, "https://b.example/x", "<article><p>Only page"), (101, None, None), (102, "not a url", ""), (103, "https://c.example/", "<p>plain " * 3000), (None, None, "<p>no id")]
    pages = spark.createDataFrame([(*r, "clash", "old") for r in rows], "page_id long, url string, html string, host string, text string")
    for most in (H.BROADCAST_BYTES, 0):
        monkeypatch.setattr(H, "BROADCAST_BYTES", most)
        out = H.extract_pages(pages)
        assert sorted(out.columns) == ["host", "page_id", "text", "url"]
        got = [(r.page_id, r.text) for r in out.collect()]
        assert len(got) == len(rows)
        got = dict(got)
        assert all(got[k] == f"Title {k}\n\nFirst bold {k} text more & more\n\nSecond {k}" for k in range(6))
        assert (got[100], got[101], got[102], got[None]) == ("Only page", "", "", "no id") and got[103] == "\n\n".join(["plain"] * 3000)
    assert H.extract_pages(pages.limit(0)).count() == 0
