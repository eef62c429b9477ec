"""What stays of pages that mark no content."""

import random

from galleyproof.llm import htmltext

SCHEMA = "page_id long, url string, html string"
NAV = ["Home", "All articles of this site by date", "About the editors and how to reach them by letter or by telephone"]
NOTICE = "No part and no picture of this site may be copied without the written leave of its publisher, who answers letters."


def prose(seed, words=60):
    pick = random.Random(seed)
    return " ".join("".join(pick.choice("abcdefghilmnorstu") for _ in range(pick.randrange(2, 9))) for _ in range(words))


def article(seed):
    return [prose((seed, k).__repr__(), 40 + 5 * k) for k in range(3)]


def page(*blocks):
    return "<html><body>" + "".join(f"<p>{b}</p>" for b in blocks) + "</body></html>"


def texts(spark, pages):
    rows = [(i, f"http://h.example.com/{i}", h) for i, h in enumerate(pages)]
    return {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_copied_articles_of_one_host_stay(spark):
    copied = article("copied")
    two = texts(spark, [page(*copied), page(*copied)])
    assert two == {0: "\n".join(copied), 1: "\n".join(copied)}
    # at many urls, each with other text around it
    many = texts(spark, [page(prose(f"side {i}", 12), *copied) for i in range(12)] + [page(*article(i)) for i in range(12)])
    assert all("\n".join(copied) in many[i] for i in range(12))
    assert all(many[12 + i] == "\n".join(article(i)) for i in range(12))


def test_quotations_stay_and_boilerplate_goes(spark):
    quote = "It was said in the house that nothing said in the house would be said again, " * 2
    quote = quote.strip()
    bodies = [[*article(i), *([quote] if i < 9 else []), prose(f"end {i}", 50)] for i in range(40)]
    got = texts(spark, [page(*NAV, *b, NOTICE) for b in bodies])
    assert got == {i: "\n".join(b) for i, b in enumerate(bodies)}
