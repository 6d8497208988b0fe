"""Community operators and text-only profiles by hand."""

from pyspark.sql import functions as F

from matchweave.operators import community, fallback_profile, named_terms


def test_optins(spark):
    kinds = [(1, "accept"), (1, "add"), (1, "decline"), (1, "accept"), (1, "add"), (1, "self"), (1, "decline"), (2, "self"), (2, "decline"), (2, "add"), (3, "add"), (None, "add")]
    df = spark.createDataFrame([(k, e, k, kind) for k, (e, kind) in enumerate(kinds)], "event_id long, employee_id long, ts long, kind string")
    got = [(r.outcome, r.status) for r in community.optins(df).orderBy("event_id").collect()]
    assert got == [
        ("unknown", None), ("invited", "pending"), ("declined", "declined"), ("handled", "declined"), ("present", "declined"), ("registered", "accepted"), ("handled", "accepted"),
        ("registered", "accepted"), ("handled", "accepted"), ("present", "accepted"), ("invited", "pending"),
    ]


def test_employee_upserts(spark):
    rows = [(1, "Ann", "Acme", "a@x.io", " ;", "60"), (2, "Bob", "Other", "A@x.io ", "data; ml", "0"), (3, "Bob", "Other", "a@x.io", "web", None), (4, " ", "Acme", "b@x.io", None, None), (5, "Cy", "Acme", "nomail", None, None), (6, None, None, None, None, None), (7, "Di", "A  B", "d@gmail.com", "x,y", "n/a")]
    df = spark.createDataFrame(rows, "seq long, full_name string, company string, email string, domains string, threshold string")
    assert [(r.seq, r.outcome) for r in community.employee_outcomes(df).orderBy("seq").collect()] == [(1, "created"), (2, "enriched"), (3, "duplicate"), (4, "no_name"), (5, "bad_email"), (6, "no_name"), (7, "created")]
    got = {r.email: tuple(r)[1:] for r in community.employees(df).collect()}
    assert got == {"a@x.io": ("Ann", "Acme", "acme", 60, ["data", "ml"]), "d@gmail.com": ("Di", "A  B", "a b", 75, ["x", "y"])}


def test_text_forms(spark):
    one = lambda f, *v: spark.range(1).select(f(*[F.lit(x) for x in v]).alias("o")).collect()[0].o
    assert one(community.page_title, "Engineer | LinkedIn Jobs") == "Engineer" and one(community.page_title, None) == ""
    assert one(community.polished, "\n - “Did it” \nmore") == "Did it" and one(community.polished, None) == ""
    assert one(community.escaped, "a<b & c>") == "a&lt;b &amp; c&gt;"
    assert not one(community.is_card, "Save it all", "x" * 20) and one(community.is_card, "Engineer", "x" * 20) and not one(community.is_card, None, "x" * 20)
    final = "[NAME]\nAnn\n[PROFILE]\nhi\n[EXPERIENCE]\nworked\n[SKILLS]\nall"
    assert one(community.output_issues, final, "x" * 400) == ["missing_or_empty:[EDUCATION]", "experience_has_no_bullets", f"drastic_shrink orig_chars=400 final_chars={len(final)}"]


def test_text_only_profiles(spark):
    texts = spark.createDataFrame([(1, "6 years of experience. " + "x " * 100 + "Python, Docker " + "y " * 100 + "golang 2.5 years"), (2, None), (3, "java")], "profile_id long, text string")
    got = {(r.profile_id, r.tech): (r.domain, r.industry) for r in fallback_profile.entries(texts).collect()}
    assert got == {(1, "python"): ("backend", 3.0), (1, "docker"): ("devops_cloud", 3.0), (1, "golang"): ("backend", 2.5), (3, "java"): ("backend", 1.0)}
    assert {(r.profile_id, r.domain): r.years for r in fallback_profile.domain_years(fallback_profile.entries(texts)).collect()} == {(1, "backend"): 5.5, (1, "devops_cloud"): 3.0, (3, "backend"): 1.0}
    postings = spark.createDataFrame([(1, "Requirements:\n- 3 years of Python\n- Docker")], "posting_id long, text string")
    scored = {r.profile_id: r for r in named_terms.scores(postings, *fallback_profile.profile_tables(texts)).collect()}
    assert scored[1].score > scored[3].score >= scored[2].score and scored[1].matched == ["docker", "python"]
