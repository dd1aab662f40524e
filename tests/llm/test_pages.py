"""Page operators: url reputation and html extraction."""

from __future__ import annotations

import json
from collections import Counter

import brute
import duckdb
import pytest

from spotweave.llm import html_wrapper, queries, url_reputation

PATH = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string, host string, rule string, text string, main string"


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "", "h", "r", "t", "m") for i, u in enumerate(urls)], PAGES)


def test_rules_and_parts(spark):
    cases = {
        "http://WWW.Example.com/en/x?q#f": ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
        "https://a.example.com/en/": ("a.example.com", "/en/", "example.com/en/", "block"),
        "https://example.com/EN/": ("example.com", "/EN/", "com/", "allow"),
        "x://example.com": ("example.com", "", None, "allow"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "http://b.net/es/1#a://b": ("b.net", "/es/1", "net/es/", "block"),
        "http://net/fr/": ("net", "/fr/", "net/fr/", "block"),
        "http://b.net/es": ("b.net", "/es", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "http://ÀB.org?x=/en/": ("Àb.org", "", None, "allow"),
        "a\nb://q.com/\nz?": ("q.com", "/\nz", "com/", "allow"),
    }
    p = pages(spark, list(cases))
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in url_reputation.filter_urls(p, url_reputation.bad_labels(lab)).collect()}
    for i, want in enumerate(cases.values()):
        r = got[i]
        assert (r.host, r.path, r.rule, r.verdict) == want
    assert url_reputation.filter_urls(p.limit(0), url_reputation.bad_labels(lab)).count() == 0


def test_reputation_shrinks_towards_the_levels_above(spark):
    urls = [f"http://bad.evil.org/{i}" for i in range(40)] + [f"http://ok.fine.org/{i}" for i in range(40)] + ["http://new.evil.org/", "http://new.fine.org/", "http://one.other.org/"]
    lab = [(i, 0, 0) for i in range(40)] + [(40 + i, 1, 0) for i in range(40)] + [(82, 0, 0)]
    d = url_reputation.filter_urls(pages(spark, urls), url_reputation.bad_labels(spark.createDataFrame(lab, "doc_id long, quality int, toxic int")))
    got = {r.host: r for r in d.collect()}
    assert got["bad.evil.org"].verdict == "block" and got["ok.fine.org"].verdict == "allow"
    assert got["new.evil.org"].bad_rate_bound > got["new.fine.org"].bad_rate_bound
    assert got["one.other.org"].verdict == "allow"  # one bad label is not proof enough


@pytest.mark.parametrize(("bad", "verdict"), [(1, "allow"), (40, "block")])
@pytest.mark.parametrize("level", ["host", "domain", "suffix"])
def test_one_bad_label_never_blocks_and_forty_do(spark, level, bad, verdict):
    at = {"host": "http://h.dom.xx/{i}", "domain": "http://h{i}.dom.xx/", "suffix": "http://h.dom{i}.xx/"}[level]
    other = {"host": "http://h.dom.xx/", "domain": "http://new.dom.xx/", "suffix": "http://new.newdom.xx/"}[level]
    urls = [at.format(i=i) for i in range(bad)] + [f"http://ok{i % 9}.fine{i % 3}.yy/{i}" for i in range(60)] + [other]
    lab = [(i, 0, 0) for i in range(bad)] + [(bad + i, 1, 0) for i in range(60)]
    d = url_reputation.filter_urls(pages(spark, urls), url_reputation.bad_labels(spark.createDataFrame(lab, "doc_id long, quality int, toxic int")))
    assert d.filter(f"page_id = {len(urls) - 1}").first().verdict == verdict


def test_url_query_matches_sql(spark):
    con = duckdb.connect()
    for t in ("pages", "labels", "documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{PATH}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        cur = con.execute(sql)
        cols = [c[0] for c in cur.description]
        want = Counter(tuple(map(str, r)) for r in cur.fetchall())
        got = queries.QUERIES[name](spark, PATH)
        assert Counter(tuple(map(str, r)) for r in got.select(*cols).collect()) == want, name


def test_extraction_of_the_test_pages(spark):
    rows = duckdb.connect().execute(f"SELECT page_id, coalesce(html, '') FROM '{PATH}/pages.parquet'").fetchall()
    got = {r.page_id: r for r in queries.QUERIES["op8_html_extraction"](spark, PATH).collect()}
    assert len(got) == len(rows)
    for i, page in rows:
        assert got[i].text == brute.article(page) and got[i].n_chars == len(got[i].text)


LAYOUT = (
    "<html><head><title>T{i}</title><script>if (a < b) document.write('<p>no</p>')</script></head><body><header><h1>Site</h1></header>"
    "<div class='sidebar'><p>side {i}</p></div><div id=content class=post><h2>Title &lt;{i}&gt;</h2><p>First {i}<br>second <b>bo</b>ld&nbsp;x"
    "<p>Unclosed {i}<div class='share'>Share me</div><ul><li>a{i}<li>b{i}</ul><form><input>send</form></div>"
    "<section class='comments'><p>comment {i}</p></section><footer>f</footer></body></html>"
)


def test_layout_without_an_article(spark):
    rows = [(i, f"http://h.com/{i}", LAYOUT.format(i=i), "", "", "", "") for i in range(12)]
    rows += [(100, None, None, "", "", "", ""), (101, "http://one.org/", "", "", "", "", ""), (102, "http://two.org/", "plain &amp; text", "", "", "", "")]
    rows += [(103, "http://three.org/", "<article>a<!-- <p>x</p> --><nav>m</nav> b<br/>c", "", "", "", ""), rows[0]]
    rows += [(104, "http://four.org/", "<main><p>" + "w " * 50_000 + "<unclosed <p>z</main>", "", "", "", "")]
    got = Counter((r.page_id, r.text) for r in html_wrapper.extract(spark.createDataFrame(rows, PAGES)).collect())
    want = Counter({(i, f"Title <{i}> First {i} second bold x Unclosed {i} a{i} b{i}"): 1 for i in range(12)})
    want[0, "Title <0> First 0 second bold x Unclosed 0 a0 b0"] += 1
    for i, t in ((100, ""), (101, ""), (102, "plain & text"), (103, "a b c")):
        want[i, t] += 1
    long_ = next(k for k in got if k[0] == 104)
    assert long_[1].startswith("w w ") and long_[1].endswith("z") and len(long_[1]) > 99_999
    del got[long_]
    assert got == want
    assert html_wrapper.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_wrapper_is_union_free_and_folds_repeats():
    names, _, lengths = html_wrapper.stream(LAYOUT.format(i=1))
    assert names.count("li+") == 1 and names.count("/li") == 1
    parts = [json.dumps([[n, False, h, v, 1] for n, h, v in zip(*html_wrapper.stream(LAYOUT.format(i=i)))]) for i in range(3)]
    short = LAYOUT.replace("<section class='comments'><p>comment {i}</p></section>", "").format(i=9)
    parts.append(json.dumps([[n, False, h, v, 1] for n, h, v in zip(*html_wrapper.stream(short))]))
    w = json.loads(html_wrapper.infer(parts))
    optional = [n[0] for n in w if n[1]]
    assert optional == ["section.comments", "p", "#", "/p", "/section"]
    changing = [n for n in w if n[0] == "#" and n[2] == -1]
    assert changing and html_wrapper.regions(w)[0] == "div.content.post"


def test_one_host_in_many_parts(spark):
    """The large host's pages are spread; the result does not depend on the partitions."""
    rows = [(i, "http://h.com/", LAYOUT.format(i=i), "", "", "", "") for i in range(40)]
    a = {r.page_id: r.text for r in html_wrapper.extract(spark.createDataFrame(rows, PAGES).repartition(13)).collect()}
    b = {r.page_id: r.text for r in html_wrapper.extract(spark.createDataFrame(rows, PAGES).coalesce(1)).collect()}
    assert a == b and len(a) == 40


def extracted(spark, htmls, host="h.com"):
    d = spark.createDataFrame([(i, f"http://{host}/{i}", h, "", "", "", "") for i, h in enumerate(htmls)], PAGES)
    return [r.text for r in sorted(html_wrapper.extract(d).collect(), key=lambda r: r.page_id)]


def test_repeated_text_inside_the_article_goes(spark):
    """A notice in a block of an unlisted class, and one among the paragraphs, on every page of a host."""
    page = "<body><ul><li>a<li>b</ul><article><h1>T{i}</h1><div class=zq>Read our other news</div><p>First {i}</p><p>Second {i}</p><p>Follow us</p></article></body>"
    assert extracted(spark, [page.format(i=i) for i in range(12)]) == [f"T{i} First {i} Second {i}" for i in range(12)]
    two = [page.format(i=i) for i in range(2)]  # too few pages to tell
    assert extracted(spark, two * 5) == [f"T{i} Read our other news First {i} Second {i} Follow us" for i in range(2)] * 5


def test_region_comes_from_the_wrapper(spark):
    """The article that holds the text is read, not cards of another label beside it that repeat."""
    page = "<body><main><article class=post><p>Story {i}</p><p>More {i}</p></article><article class=card><h3>Always the same</h3></article></main></body>"
    assert extracted(spark, [page.format(i=i) for i in range(8)]) == [f"Story {i} More {i}" for i in range(8)]


def test_region_holds_all_text_that_changes(spark):
    page = "<body><div class=page><div class=lead><p>" + "lead{i} " * 40 + "</p></div><div class=more><p>" + "rest{i} " * 10 + "</p></div></div></body>"
    want = [" ".join([f"lead{i}"] * 40 + [f"rest{i}"] * 10) for i in range(6)]
    assert extracted(spark, [page.format(i=i) for i in range(6)]) == want
    page = "<body><div class=x0><p>Short {i}</p></div><div class=comments><div><p>" + "long comment {i} " * 50 + "</p></div></div></body>"
    assert extracted(spark, [page.format(i=i) for i in range(6)]) == [f"Short {i}" for i in range(6)]


@pytest.mark.parametrize("n", [1, 2, 3, 7])
def test_copies_are_read_alike(spark, n):
    page = "<html><body><div class=box><h1>One title</h1><p>One paragraph</p></div></body></html>"
    assert extracted(spark, [page] * n) == ["One title One paragraph"] * n
