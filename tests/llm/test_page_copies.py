"""Copies and near copies of pages without an article keep their text, and a host's own boilerplate still goes."""

from rasterloom.llm import html_extract


def test_copies_keep_their_text(spark):
    page = "<body><div><p>only text</p></div><section><p>second part</p></section></body>"
    pages = [(i, f"https://Me@Copies.org:80/{i}", page) for i in range(10)]
    # Near copies: thirty of 31 blocks of the one branch are on every page.
    same = "".join(f"<p>block {k}</p>" for k in range(30))
    pages += [(100 + i, f"http://near.org/{i}", f"<body><div>{same}<p>own {i}</p></div></body>") for i in range(10)]
    # Copies beside other pages: boilerplate goes, and many rows of one page are no evidence against its text.
    own = [f"<body><div class='t'><p>own {i}</p></div><section><p>boilerplate</p></section></body>" for i in range(12)]
    pages += [(200 + i, f"http://mixed.org/{i}", h) for i, h in enumerate(own + own[:1] * 400)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert len(got) == len(pages)
    assert all(got[i] == "only text\nsecond part" for i in range(10))
    assert all(got[100 + i] == "\n".join([*(f"block {k}" for k in range(30)), f"own {i}"]) for i in range(10))
    assert all(got[200 + i] == f"own {i if i < 12 else 0}" for i in range(412))
