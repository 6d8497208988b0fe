from matchweave.llm import html_text as H

PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><script>var a='<p>no</p>';</script></head><body><header><h1>Site</h1></header>"
    "<nav><a href=/>menu</a></nav><div class='cookie-notice'>We use cookies</div><main class='content-12'><article class='post'>"
    "<h1>Head &amp; tail</h1><p>One <b>bold</b>&nbsp; word.<br>Two</p><ul><li>x<li>y</ul></article>"
    "<section id='comments'><p>I like this very much, says a reader at length.</p></section></main><aside>side</aside>"
    "<form>Sign up</form><footer>foot</footer></body></html>"
)


def test_article_only():
    assert H.extract(PAGE, None) == "Head & tail\nOne bold word. Two\nx\ny"


def test_odd_inputs():
    assert H.extract("", None) == ""
    assert H.extract("a &lt; b\n c", None) == "a < b c"
    assert H.extract("<p>a<p>b<foot", None) == "a\nb"
    assert H.extract("<script>x</script><nav>m</nav>", None) == ""
    assert H.extract("<div class='ad'>only this</div>", None) == ""
    assert H.extract("<p>" + "long words here " * 50_000 + "</p>", None).count("long") == 50_000


def test_rows(spark):
    path = H.scan(PAGE).path
    assert ">main.content-#>article.post" in path
    plain = "<body><div class='b7'><p>first long text of this page, long enough</p></div><div class='c'>x</div></body>"
    other = "<body><div class='b9'><p>second text</p></div><div class='c'>" + "noise without an end " * 2 + "</div></body>"
    rows = [(1, "http://h.x/1", plain, "a"), (2, "http://h.x/2", plain, "b"), (3, "http://h.x/3", other, "c"), (4, None, PAGE, "d"), (5, "http://h.x/5", None, "e"), (5, "http://h.x/5", None, "e")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = {(r.page_id, r.url): (r.text, r.n_chars) for r in H.main_text(df).collect()}
    assert out[(3, "http://h.x/3")][0] == "second text"  # the host's path wins over the page's own best container
    assert out[(4, None)][0].startswith("Head & tail") and out[(5, "http://h.x/5")] == ("", 0)
    assert H.main_text(df).count() == 6
    assert H.main_text(df.limit(0)).count() == 0


def test_nothing_but_boilerplate_goes():
    long = "plain words of the body " * 6
    nav = "<div class='menu'><p>menu</p></div><ul><li><a href=/>link one</a></ul>"
    split = f"<body>{nav}<div class='all'><div class='lead'>The lead of it, bare text of some length</div><div class='body'>{long}</div><div class='end'><p>{long}</p></div></div></body>"
    path = next(p for p in H.scan(split).path if p.endswith("div.body"))
    want = "\n".join(["The lead of it, bare text of some length", long.strip(), long.strip()])
    assert H.extract(split, path) == want and H.extract(split, None) == want
    beside = f"<body>{nav}<h1>Title</h1><div class='x'><p>A lead beside the body.</p></div><div class='body'>{long}</div><p>The last part.</p></body>"
    assert H.extract(beside, None) == "\n".join(["Title", "A lead beside the body.", long.strip(), "The last part."])
    assert H.extract(beside, "nowhere") == H.extract(beside, None) == H.extract(beside, next(p for p in H.scan(beside).path if p.endswith("div.body")))
    inner = f"<body><main><p>{long}</p></main><p>Outside the main element.</p></body>"
    assert H.extract(inner, None) == long.strip()
