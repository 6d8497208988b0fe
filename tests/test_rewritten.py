"""Rules by hand: links, page tiers, analyses, referral journeys, bank of answers."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from matchweave.functions import links
from matchweave.operators import directory, journeys, rewriting

DAY = datetime(2024, 1, 1)
AT = "https://t.example/go?app_id=7&target="


def test_links(spark):
    cases = {
        "see https://github.com/me/.": f"see [LINK:github.com/me/|{AT}github&url=https%3A%2F%2Fgithub.com%2Fme%2F]",
        "[LINK:my code|github.com/me] end": f"[LINK:my code|{AT}github&url=https%3A%2F%2Fgithub.com%2Fme] end",
        "[site](http://a.io/x y)": f"[LINK:site|{AT}portfolio&url=http%3A%2F%2Fa.io%2Fx%20y]",
        "mail a@foo.com/x": "mail a@foo.com/x",
        "no links": "no links",
        "": "",
        None: None,
        "[LINK:a|b.io/x]https://c.io": f"[LINK:a|{AT}portfolio&url=https%3A%2F%2Fb.io%2Fx][LINK:c.io|{AT}portfolio&url=https%3A%2F%2Fc.io]",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    got = [r.x for r in df.orderBy("i").select(links.tracked(F.col("t"), F.lit(7), "https://t.example/go").alias("x")).collect()]
    assert got == list(cases.values())


def test_page_tiers(spark):
    text = lambda n: "[NAME]\nme\n[EXPERIENCE]\n" + "\n".join(["- x"] * n)
    df = spark.createDataFrame([(n, text(n)) for n in (1, 55, 56, 59, 60, 90)] + [(-1, ""), (-2, None)], "doc_id long, text string")
    got = {r.doc_id: (r.tier, r.lines, r.most_lines) for r in rewriting.page_tiers(df).collect()}
    assert got == {1: ("normal", 4, 58), 55: ("normal", 58, 58), 56: ("tight", 59, 62), 59: ("tight", 62, 62), 60: ("compact", 63, 66), 90: ("compact", 93, 66), -1: ("normal", 1, 58), -2: ("normal", 1, 58)}


def test_verdicts_reasons_and_scores(spark):
    blocks = spark.createDataFrame([(1, 1, "x" * 100, False, True), (1, 2, "x" * 100, True, True), (1, 3, "x", False, False)], "doc_id long, block long, text string, focus boolean, shrink boolean")
    returned = spark.createDataFrame([(1, 1, "x" * 95), (1, 1, "x" * 94), (1, 2, "x" * 59), (1, 2, "x" * 60), (1, 3, "y"), (1, 9, "y"), (1, 2, None)], "doc_id long, block long, text string")
    assert sorted((r.block, r.verdict) for r in rewriting.block_verdicts(blocks, returned).collect()) == [
        (1, "kept"), (1, "shrink_not_shorter"), (2, "expand_got_shorter"), (2, "kept"), (2, "not_requested"), (3, "not_requested"), (9, "not_requested"),
    ]
    pairs = spark.createDataFrame([(None, "a"), ("a", "**a**"), ("a", "3"), ("aaaaa", "aaa"), ("a", "b"), ("a", None)], "o string, n string")
    assert [r[0] for r in pairs.select(rewriting.change_reason(F.col("o"), F.col("n"))).collect()] == ["new", "emphasised", "measured", "shortened", "adapted", "shortened"]
    sets = spark.createDataFrame([(1, 60), (2, 99), (3, None)], "set_id long, base int")
    asked = spark.createDataFrame([(1, 15, 50), (1, 10, None), (2, 9, 100)], "set_id long, weight int, pct int")
    got = {r.set_id: (r.score, r.gap_pct, r.n_questions) for r in rewriting.answered_scores(sets, asked).collect()}
    assert got == {1: (68, 25, 4), 2: (100, 10, 3), 3: (0, 20, 4)}


def test_referral_journey(spark):
    rows = [
        ("request", None, 1, True, 0), ("credit", 10, None, True, 0), ("request", None, None, True, 1), ("request", None, 1, False, 1), ("request", None, 1, True, 1),
        ("request", None, 1, True, 2), ("decline", None, 1, True, 3), ("decline", None, 1, True, 3), ("request", None, 1, True, 4), ("accept", None, 1, True, 11),
        ("request", None, 1, True, 12), ("request", None, 2, True, 12), ("request", None, 3, True, 12), ("accept", None, 2, True, 20), ("request", None, 2, True, 20),
    ]
    df = spark.createDataFrame([(i, 5, DAY + timedelta(days=d), k, c, j, f) for i, (k, c, j, f, d) in enumerate(rows)], "entry_id long, user_id long, ts timestamp_ntz, kind string, credit int, job long, found boolean")
    got = [(r.outcome, r.balance) for r in journeys.referrals(df).orderBy("entry_id").collect()]
    assert got == [
        ("short", 0), ("credited", 10), ("no_job", 10), ("nobody", 10), ("pending", 5), ("active", 5), ("declined", 10), ("handled", 10), ("pending", 5), ("accepted", 5),
        ("active", 5), ("pending", 0), ("short", 0), ("handled", 5), ("pending", 0),
    ]


def test_answer_bank_and_sheets(spark):
    said = [("SQL", "five years"), ("sql", " yes "), ("go", "a lot"), ("rust", "לא ענה"), ("c", "some"), ("Sql", "again")]
    df = spark.createDataFrame([(i, 1, DAY + timedelta(days=i), s, a) for i, (s, a) in enumerate(said)], "entry_id long, user_id long, ts timestamp_ntz, skill string, answer string")
    got = [(r.outcome, r.dropped) for r in journeys.banked_answers(df, 2).orderBy("entry_id").collect()]
    assert got == [("added", None), ("skipped", None), ("added", None), ("skipped", None), ("added", "sql"), ("added", "go")]
    assert directory.missing_columns([" Email ", None, "COMPANY"], {"email", "company", "full_name"}) == ["full_name"]


def test_analysis_and_description(spark):
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(["intro", "Strengths", "- a", "gaps", "- b", "Summary", "c"])], "doc_id long, line_no int, line string")
    assert [r.mode for r in rewriting.analysis_modes(lines).orderBy("line_no").collect()] == ["neutral", "strength", "strength", "gap", "gap", "neutral", "neutral"]
    texts = ["\n".join(["x"] * 30 + ["Requirements:", "y"]), "The role\nx", "nothing here\nrequired", ""]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(rewriting.description(F.col("t"))).collect()]
    assert got == ["\n".join(["x"] * 25 + ["Requirements:", "y"]), *texts[1:]]


def test_recent_lists(spark):
    visits = [("save", "a", 0), ("save", "b", 1), ("save", "a", 2), ("save", "c", 3), ("load", "a", 6), ("load", "b", 6), ("load", "a", 7), ("load", "a", 7), ("load", None, 7)]
    df = spark.createDataFrame([(i, 1, DAY + timedelta(hours=h), k, u) for i, (k, u, h) in enumerate(visits)], "entry_id long, user_id long, ts timestamp_ntz, kind string, url string")
    got = [(r.outcome, r.dropped) for r in journeys.recent_lists(df, 2).orderBy("entry_id").collect()]
    assert got == [("saved", None), ("saved", None), ("saved", None), ("saved", "b"), ("hit", None), ("miss", None), ("stale", None), ("miss", None), ("miss", None)]
