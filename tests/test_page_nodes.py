"""Elements, selectors, descriptions and cards: by hand and against a plain tree walk over random pages."""

import random
import re

from pyspark.sql import functions as F

from matchweave.operators import page_nodes as P

SELECTORS = ("li", ".a", '[class*="job"]', "#x", "[data-job-id]", 'div[class*="b"]', ".a b", '[title="t"], p', "div .b", 'li.a, [class*="ob"] b')


def tree(rng, depth=0):
    """A random element as (tag, attributes, children); children are elements or words."""
    tag = rng.choice(["div", "ul", "section", "b", "span"] if depth < 4 else ["b", "span"])
    attrs = {k: rng.choice(v) for k, v in (("class", ["a", "b a", "job-a", "ab", "b\ta"]), ("id", ["x", "y"]), ("data-job-id", ["1"]), ("title", ["t", "u"])) if rng.random() < 0.3}
    inner = [rng.choice(["one", "two &amp; three", " four "]) if depth > 3 or rng.random() < 0.4 else tree(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return tag, attrs, inner


def markup(t):
    if isinstance(t, str):
        return t
    tag, attrs, inner = t
    return f"<{tag}{''.join(f' {k}={chr(34)}{v}{chr(34)}' for k, v in attrs.items())}>{''.join(map(markup, inner))}</{tag}>"


def walk(t, around=()):
    yield t, around
    for c in t[2]:
        if not isinstance(c, str):
            yield from walk(c, (*around, t))


def fits(t, step):
    tag, rest = re.match(r"([a-z]*)(.*)", step).groups()
    a = t[1]
    if tag and t[0] != tag:
        return False
    if rest.startswith("."):
        return rest[1:] in a.get("class", "").split()
    if rest.startswith("#"):
        return a.get("id") == rest[1:]
    if "*=" in rest:
        name, v = rest[1:-1].split("*=")
        return v.strip('"') in a.get(name, "")
    if "=" in rest:
        name, v = rest[1:-1].split("=")
        return a.get(name) == v.strip('"')
    return not rest or rest[1:-1] in a


def chosen(t, selector):
    out = []
    for k, (n, around) in enumerate(walk(t)):
        for way in selector.split(","):
            *outer, own = way.split()
            if fits(n, own) and (not outer or any(fits(r, outer[0]) for r in around)):
                out.append(k)
                break
    return out


def words(t):
    return t if isinstance(t, str) else " ".join(map(words, t[2]))


def test_selectors_equal_a_tree_walk(spark):
    rng = random.Random(5)
    trees = [tree(rng) for _ in range(60)]
    df = P.read(spark.createDataFrame([(k, "http://a.b/c", markup(t)) for k, t in enumerate(trees)], "page_id long, url string, html string"))
    nodes = F.col("nodes")
    picked = [F.transform(F.filter(nodes, lambda n: P.matches(n, P._literal(P.selector(s), P._SELECTOR), nodes)), lambda n: n["node"]).alias(f"s{k}") for k, s in enumerate(SELECTORS)]
    shown = F.transform(nodes, lambda n: P.shown(F.col("text"), n)).alias("shown")
    for r in df.select("page_id", shown, F.size("nodes").alias("n"), *picked).collect():
        t = trees[r.page_id]
        all_ = [x for x, _ in walk(t)]
        assert r.n == len(all_)
        for k, s in enumerate(SELECTORS):
            assert r[f"s{k}"] == chosen(t, s), (s, markup(t))
        squeezed = lambda x: re.sub(r"\s+", "", x).replace("&amp;", "&")
        assert [squeezed(x) for x in r.shown] == [squeezed(words(x)) for x in all_]


def test_broken_markup(spark):
    html = "<head><title>no</title></head><p>one<p>two</b> <ul><li>a<ul><li>b</ul><li>c</ul><script>if (a<b) '</p>'</script><!-- <p>x --> x &lt; y<br>z <div title='a>b' TITLE=c hidden>end"
    r = P.read(spark.createDataFrame([(1, None, html), (2, None, None), (3, None, ""), (4, None, "<<>< a <b"), (5, None, "<script>never")], "page_id long, url string, html string")).orderBy("page_id").collect()
    assert r[0].text == "one\ntwo \na\nb\nc\nx < y\nz \nend\n" and r[0].nodes[-1].attrs == {"title": "a>b", "hidden": ""}
    assert [n.tag for n in r[0].nodes] == ["head", "title", "p", "p", "ul", "li", "ul", "li", "li", "script", "br", "div"] and r[0].nodes[5].last == 7
    assert [(x.text, len(x.nodes)) for x in r[1:]] == [("", 0), ("", 0), ("<<>< a <b", 0), ("", 1)]


def test_descriptions(spark):
    long, short = "word " * 60, "short one"
    rows = [
        (1, "https://www.linkedin.com/x", f'<div class="job-view-layout">{short}</div><div class="jobs-description"> {long}</div><main>{long}main</main>'),
        (2, "https://il.linkedin.com/x", f'<div class="jobs-description">{short}</div><div class="jobs-description">{long}</div><article>{short}</article><main>{long}main</main>'),
        (3, "https://a.b/x", f'<div class="my-content">{long}</div><article>{short}</article><article>{long}art</article>'),
        (4, "https://a.b/x", f"<body><p>{short}<div>{short}</div>"),
        (5, None, None),
    ]
    got = {r.page_id: (r.found, r.text) for r in P.descriptions(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    long = long.strip()
    assert got == {1: ("site", long), 2: ("generic", long + " main"), 3: ("generic", long + " art"), 4: ("body", f"{short}\n{short}"), 5: ("body", "")}


def test_cards(spark):
    item = lambda k, c: f'<li class="{c}"><h3>Offer {k}</h3><a href="?o={k}">open</a> a position with a career, apply with sixty letters or more of text'
    card = lambda k, c="job-card": f'<div class="{c}"><h2>Offer {k}</h2>some more text</div>'
    rows = [
        (1, "http://a.b/l", "<ul>" + item(1, "it") + item(2, "it") + "</ul><ul>" + "".join(item(k, "row") for k in range(3, 7)) + "</ul>"),
        (2, "http://a.b/l", '<div id="related">' + card(1) + card(2) + "</div>" + card(3)),
        (3, "http://a.b/l", '<div id="related">' + card(1) + "</div>" + card(2) + card(3) + card("x", "job-card-2").replace("Offer x", "Save this")),
        (4, "http://a.b/l", card(1)),
        (5, "http://a.b/l", "".join(f'<div class="card item"><a href="#">o</a>{"job position career " * 5}{k}</div>' for k in range(2))),
        (6, None, None),
        (7, "http://a.b/l", "<ul>" + "".join(item(k, "many") for k in range(151)) + "</ul>"),
    ]
    got = {}
    for r in P.cards(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id", "nth").collect():
        got.setdefault(r.page_id, []).append((r.nth, r.how, r.title.split("\n")[0][:8], r.href))
    assert got[1] == [(k, "repeated", f"Offer {k + 3}", f"http://a.b/l?o={k + 3}") for k in range(4)]
    assert got[2] == [(k, "generic", f"Offer {k + 1}", "") for k in range(3)]  # one card alone would be left
    assert got[3] == [(0, "generic", "Offer 2", ""), (1, "generic", "Offer 3", "")]
    # two elements that fit two selectors are four finds
    assert [x[:2] for x in got[5]] == [(0, "repeated"), (1, "repeated"), (2, "repeated"), (3, "repeated")] and set(got) == {1, 2, 3, 5}
