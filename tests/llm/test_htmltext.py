import pyarrow.parquet as pq

from galleyproof.llm import htmltext as H

PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body class='with-sidebar'><nav><ul><li><a href=/x>Home</a></li></ul></nav><!-- ad -->"
    "<div class=\"ad\">Buy now</div><div id='cookie-notice'>We use cookies</div><article><h1>Title &amp; more</h1><p><b>One   two<br>three<p>Four&nbsp;five &lt;b&gt; <i>six</i>seven</p>"
    "<aside>side</aside><form><input value='>'>Name</form><ul><li>item</ul><section class=comments><p>first!</p></section><p class=ad>advert<p>last</article>"
    "<footer>&copy; me</footer></body></html>"
)


def test_structure():
    inner, outer, marked = H.blocks(PAGE)
    assert marked and inner == ["Title & more", "One two three", "Four five <b> sixseven", "item", "last"]
    assert "Home" in outer and "Buy now" in outer and "first!" in outer


def brute(page):
    """The same rules for the driver's pages, by plain string search."""
    import html
    import re

    body = page[page.index("<article>") + 9 : page.index("</article>")]
    parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
    return "\n".join(x for x in parts if x)


def test_pages_of_the_driver(spark):
    path = "/root/testdata/sf0.01/pages.parquet"
    got = {r.page_id: (r.text, r.n_chars) for r in H.extract(spark.read.parquet(path)).collect()}
    rows = pq.read_table(path).to_pylist()
    assert len(got) == len(rows)
    for r in rows:
        want = brute(r["html"]) if r["html"] else ""
        assert got[r["page_id"]] == (want, len(want))


def test_unmarked_pages_lose_what_the_host_repeats(spark):
    bar = "Welcome to the site that repeats this long line on every page it has, and goes on with it for more than a hundred bytes"
    pages = [(i, f"https://a.example/{i}", f"<body><div>{bar}</div><p>w{i * 7919} unique{i} number{i * 31}</p><p>{bar} {i}day</p></body>") for i in range(10)]
    pages += [(10, "https://b.example/", f"<body><p>{bar}</p></body>"), (11, None, None), (12, None, ""), (12, None, ""), (None, "https://c.example", "<p>no id")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as text", "'m' as marked")
    out = H.extract(df).collect()
    assert len(out) == len(pages)
    by = {r.page_id: r.text for r in out}
    # whole blocks go, on eight pages and more; a block with words of its own stays
    assert by[3] == f"w{3 * 7919} unique3 number93\n{bar} 3day"
    assert by[10] == bar and by[11] == "" and by[12] == "" and by[None] == "no id"
    assert H.extract(df.limit(0)).count() == 0
