import hashlib
import random
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from metrilith.llm import html_diff, pii, queries


# --- pages -----------------------------------------------------------------------------


def test_lines_of_a_page():
    page = """<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li>Home</li></ul></nav>
    <div class="ad">Buy <div>now</div> here</div><!-- x --><article><header><h1>A &amp; B</h1></header><p><b>First.<br><p>Sec&eacute;\n ond
    <i>it</i>alic</p><form>name</form><section id="comments"><p>nice</p></section></article><footer>&copy;</footer></body></html>"""
    out, free, own = html_diff.OUTSIDE, html_diff.OPEN, html_diff.INSIDE
    want = [("Home", out), ("Buy", out), ("now", out), ("here", out), ("A & B", own), ("First.", own), ("Secé ond italic", own), ("name", out), ("nice", out), ("©", out)]
    assert html_diff.text_lines(page) == want
    assert html_diff.main_text(want) == "A & B\nFirst.\nSecé ond italic"
    assert html_diff.text_lines("") == []
    assert html_diff.text_lines("plain < 3 &amp; <unclosed") == [("plain < 3 & <unclosed", free)]
    assert html_diff.text_lines("<p>a<script>never closed") == [("a", free)]


def test_marks_of_wrappers_and_broken_tags():
    inside = lambda page: html_diff.main_text(html_diff.text_lines(page))
    assert inside('<div class="sidebar"><p>menu</p><main><p>story</p></main></div>') == "story"
    assert inside('<article class="with-sidebar"><p>story</p><div class="site-footer">foot</div></article>') == "story"
    assert inside('<article><p>story</p></article><article class="comment"><p>reader</p></article>') == "story"
    # a teaser isn't the bulk of the page
    assert inside("<div><p>" + "long story " * 20 + "</p><article>teaser</article></div>") == ("long story " * 20).strip() + "\nteaser"
    assert inside("<p title='a>b'>x</p><p class=\"c'>\">y</p><b <i>z</i>") == "x\ny\nz"


@pytest.mark.parametrize("page, want", [
    ('<article class="post category-social-science"><p>Body</article>', "Body"),
    ('<div class="article share-prices"><p>Body</p></div>', "Body"),
    ('<main><section id="menu-of-the-day"><p>Soup</p></section></main>', "Soup"),
    ('<article><section class="related-work"><p>Others</p></section></article>', "Others"),
    ('<p class="notice">Note<p>Real one<p>Real two', "Real one\nReal two"),
    ('<div><p class="notice">Note</div><p>Real', "Real"),
    ('<ul><li class="ad">Buy<ul><li>now</ul><li>Real</ul>', "Real"),
    ('<ul><li class="ad"><p>Buy</p>now</li><li>Real</li></ul>', "Real"),
    ('<table><tr class="ad"><td>x</td><td>y</td></tr><tr><td>Real</table>', "Real"),
    ('<table><tr><td class="sidebar">side<td>Real</table>', "Real"),
    ('<dl><dt class="promo">Buy<dd>Real</dl>', "Real"),
    ('<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p>', "so x=1 holds"),
    ('<div class="header">Site Name</div><p>Real</p>', "Real"),
    ('<div id="header">Site</div><div class="top-bar">Menu</div><div id="topmenu">Menu</div><p>Real</p>', "Real"),
    ('<article><div class="header"><h1>Title</h1></div><p>Real</p></article>', "Title\nReal"),
    ('<p>a</p><b <i>z</i> <a href="x" <p>b</p>', "a\nz\nb"),
    ('<div class="share-links">Share</div><div class="related-posts">More</div><p>Real</p>', "Real"),
])
def test_what_is_kept_and_what_goes(page, want):
    assert html_diff.main_text(html_diff.text_lines(page)) == want


@pytest.mark.parametrize("page", ["<" + "a" * 1_000_000, "<a '" * 250_000, '<a "' * 250_000, "<!" * 500_000, "<!--" * 250_000, "</script " * 110_000, "<script>" + "</script " * 110_000, "<p>" * 330_000, "<a '>'" * 160_000, "&" * 1_000_000])
def test_broken_pages_take_linear_time(page):
    began = time.time()
    html_diff.text_lines(page)
    assert time.time() - began < 5


def brute_extract(rows):
    """All pages of all hosts in plain loops."""
    from urllib.parse import urlsplit

    def split(url):
        u = urlsplit(url or "")
        return (u.hostname or None), (u.path + ("?" + u.query if u.query else ""))

    def lcs(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in reversed(range(len(a))):
            for j in reversed(range(len(b))):
                best[i][j] = 1 + best[i + 1][j + 1] if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
        return best[0][0]

    found = [(i, *split(url), html_diff.text_lines(page or "")) for i, url, page in rows]
    hosts = {}
    for _, host, path, lines in found:
        if host:
            key = tuple(t for t, _ in lines)
            hosts.setdefault(host, {})
            hosts[host][key] = min(hosts[host].get(key, path), path)
    return found, hosts, lcs


def test_pages_without_article_elements_against_plain_loops(spark):
    """Hosts whose pages have no article element: what is left is exactly what the nearest other page doesn't share."""
    rng = random.Random(11)
    rows = []
    for host in ("a.example", "b.example"):
        menu, foot = [f"{host} menu {k}" for k in range(4)], [f"{host} foot {k}" for k in range(3)]
        for k in range(25):
            own = [f"{host} line {rng.randrange(400)}" for _ in range(rng.randrange(1, 9))]
            body = "".join(f"<p>{x}</p>" for x in menu[: rng.randrange(2, 5)] + own + foot)
            rows.append((len(rows), f"https://{host}/s{rng.randrange(4)}/p{k:02d}", f"<body>{body}</body>"))
            if k % 6 == 0:  # another crawl of the same page
                rows.append((len(rows), f"https://{host}/s0/p{k:02d}?again=1", rows[-1][2]))
    found, hosts, lcs = brute_extract(rows)
    got = {r.page_id: r for r in html_diff.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    decided = 0
    for i, host, _, lines in found:
        key = tuple(t for t, _ in lines)
        order = sorted((path, k) for k, path in hosts[host].items())
        at = next(n for n, (_, k) in enumerate(order) if k == key)
        common = lambda p, q: next((n for n, (x, y) in enumerate(zip(p, q)) if x != y), min(len(p), len(q)))
        near = [(common(order[at][0], order[n][0]), n < at, order[n][1]) for n in (at - 1, at + 1) if 0 <= n < len(order)]
        other = max(near, key=lambda x: x[:2])[2]
        n_shared = lcs(list(key), list(other))
        assert got[i].n_shared == n_shared and got[i].n_lines == len(key)
        left = got[i].text.split("\n") if got[i].text else []
        rest = iter(key)
        assert len(left) == len(key) - n_shared and all(x in rest for x in left)
        decided += n_shared > 0
    assert decided > 40


def test_shared_passages_of_articles_stay_and_templates_inside_them_go(spark):
    rows = [
        (1, "https://h.example/1", "<body><article><p>one</p><p>quoted by both</p><p>Share this story</p></article></body>"),
        (2, "https://h.example/2", "<body><article><p>two</p><p>quoted by both</p></article><div>Share this story</div></body>"),
    ]
    got = {r.page_id: r.text for r in html_diff.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {1: "one\nquoted by both", 2: "two\nquoted by both"}


def test_common_lines_is_a_longest_common_subsequence():
    rng = random.Random(3)

    def length(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    for _ in range(300):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(14))] for _ in range(2))
        at = html_diff.common_lines(a, b)
        rest = iter(b)
        assert at == sorted(set(at)) and all(a[k] in rest for k in at)
        assert len(at) == length(a, b)


def test_pages_against_their_articles(spark, small):
    """The article element of the generated pages holds the text and nothing else."""
    import html

    got = {r.page_id: r for r in queries.op1_html_extraction(spark, small).collect()}
    rows = duckdb.sql(f"select page_id, url, html from '{small}/pages.parquet'").fetchall()
    assert len(got) == len(rows)
    for page_id, url, page in rows:
        article = re.search(r"<article>(.*)</article>", page, re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        want = "\n".join(x for x in blocks if x)
        assert (got[page_id].url, got[page_id].text, got[page_id].n_chars) == (url, want, len(want))


def test_differencing_decides_without_an_article(spark):
    def page(body):
        return f"<body><p>Site name</p><div>Menu one</div>{body}<p>All about us</p></body>"

    rows = [
        (1, "http://h.example/a/1", page("<p>First story</p>")),
        (2, "http://H.example:80/a/2#x", page("<p>Second story</p><p>more</p>")),
        (3, "http://h.example/b", None),
        (4, "http://alone.example/", page("<p>Only</p>")),
        (5, None, page("<p>No address</p>")),
        (None, "http://h.example/a/3", page("<p>No id</p>")),
        (2, "http://H.example:80/a/2#x", page("<p>Second story</p><p>more</p>")),
    ]
    pages = spark.createDataFrame([(*r, "text", 1) for r in rows], "page_id bigint, url string, html string, text string, n_shared int")
    got = sorted((r.page_id or 0, r.text) for r in html_diff.extract(pages).collect())
    whole = "Site name\nMenu one\n{}\nAll about us"
    assert got == [(0, "No id"), (1, "First story"), (2, "Second story\nmore"), (2, "Second story\nmore"), (3, ""), (4, whole.format("Only")), (5, whole.format("No address"))]
    assert html_diff.extract(pages.limit(0)).count() == 0


# --- personal data ------------------------------------------------------------------------

BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    found = [(m.start(), k, m.end()) for k, (name, (pattern, good)) in enumerate(BASE.items()) for m in re.finditer(pattern, text or "", re.A) if good(m[0])]
    return sorted(found)


def same(rows, texts):
    names = list(BASE)
    for doc_id, text in texts:
        want = brute(text)
        r = rows[doc_id]
        spans = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[1] == k for x in want) for k in range(4)], (doc_id, text[:200])
        assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert set(spans.split(",")) - {""} <= set(r.spans.split(","))


def test_base_spans_on_the_small_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.op2_pii(spark, sf).collect()}
    same(rows, duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall())


def test_base_spans_on_odd_texts(spark, tmp_path, odd_docs):
    rng = random.Random(5)
    pieces = ["a@b.c", "a.b%+-@c-d.e.f_x@y.z", "@", ".", "-", " ", "  ", "1", "23", "4111 1111 1111 1111", "4111-1111-1111-1112", "1.2.3.4", "999.1.1.1", "001.255.0.256", "+1 (377) 555-0271", "+44", "++1.2", "é", "\n", "x", "0000000000000000", "12345678901234567890"]
    texts = [(k, "".join(rng.choice(pieces) for _ in range(rng.randrange(40)))) for k in range(400)]
    texts += [(1000 + k, t) for k, t in enumerate(["1 2 3 4 5 " * 3000, "a" * 60_000, "a@" + "b." * 9000 + "c", "9" * 40_000, "+" * 5000, "1." * 9000, "a.b@" * 3000])]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    same({r.doc_id: r for r in queries.op2_pii(spark, str(tmp_path)).collect()}, texts)
    out = pii.detect(odd_docs).select("doc_id", "n_chars", F.size("pii_spans").alias("n")).collect()
    assert len(out) == odd_docs.count() and {r.n for r in out if r.doc_id in (2, 3, 4)} == {0}
    assert pii.detect(odd_docs.limit(0)).count() == 0


def test_added_kinds_and_masking(spark):
    text = "IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432, not DE89 3704 0044 0532 0130 01; ssn 123-45-6789; mail a@b.co"
    df = spark.createDataFrame([(text,), (None,), ("clean",)], "text string")
    found = df.select(pii.as_text(pii.spans(F.col("text"))).alias("s")).collect()
    kinds = [x.split(":")[0] for x in found[0].s.split(",")]
    assert kinds == ["iban", "iban", "ssn", "email"] and found[1].s == "" and found[2].s == ""
    assert [r.text for r in pii.redact(df).collect()] == ["IBAN [IBAN] and [IBAN], not DE89 3704 0044 0532 0130 01; ssn [SSN]; mail [EMAIL]", None, "clean"]


@pytest.mark.parametrize("code,good", [("DE89370400440532013000", True), ("DE89370400440532013001", False)])
def test_mod97(spark, code, good):
    assert spark.createDataFrame([(code,)], "c string").select(pii.mod97(F.col("c"))).first()[0] is good
