import difflib

import pytest
from pyspark.sql import functions as F

from matchweave.functions import text as T
from matchweave.operators import directory, documents_cv, ledger, matcher


def entries(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "entry_id long, user_id long, action string, delta long, ref_id long, ts string")
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def test_ledger_balances_and_charges(spark):
    led = entries(spark, [(1, "recruiter_added_new", 10, 1, "2024-01-01"), (1, "email_open", -5, 2, "2024-01-02"), (1, "referral_request", -7, 3, "2024-01-03"), (1, "refund", 5, 2, "2024-01-04"), (1, "referral_request", -7, 4, "2024-01-05")])
    users = spark.createDataFrame([(1,), (2,)], "user_id long")
    assert {r.user_id: r.balance for r in ledger.balances(users, led).collect()} == {1: -4, 2: 0}
    assert [(r.accepted, r.balance) for r in ledger.admitted_charges(led).orderBy("entry_id").collect()] == [(True, 10), (True, 5), (False, 5), (True, 10), (True, 3)]
    assert {(r.ref_id, r.refund) for r in ledger.refunds(led).collect()} == {(2, 5), (3, 7), (4, 7)}


def test_a_capped_award_can_come_later(spark):
    led = entries(spark, [(1, "recruiter_added_new" if k % 2 else "employee_added_new", 10, k, "2024-01-01") for k in range(6)] + [(1, "employee_added_new", 10, 0, "2024-01-02"), (1, "recruiter_added_new", 10, 5, "2024-01-02")])
    assert [r.outcome for r in ledger.capped_awards(led).orderBy("entry_id").collect()] == ["awarded"] * 5 + ["capped", "repeat", "awarded"]


def test_upsert_fills_only_what_is_missing(spark):
    rows = [(1, None, " Dana@Acme.com ", " Acme   Corp ", None, False, None, None, None), (2, "Dana", "dana@acme.com", "Acme", None, False, None, None, None), (3, "Other", "dana@acme.com", "Acme", "1", True, None, None, None), (4, "X", "dana@acme.com", "A", "2", False, None, None, None), (5, "Y", "y@gmail.com", "A", None, False, None, None, None), (6, "Z", "nobody", "A", None, False, None, None, None)]
    df = spark.createDataFrame(rows, "seq long, full_name string, email string, company string, phone string, verified boolean, domains string, threshold string, opt_in string")
    out = {r.seq: r.outcome for r in directory.upsert_outcomes(df).collect()}
    assert out == {1: "created", 2: "enriched", 3: "enriched", 4: "unchanged", 5: "rejected", 6: "rejected"}
    person = directory.directory(df).first()
    assert (person.company, person.full_name, person.phone, person.verified) == ("acme corp", "Dana", "1", True)


@pytest.mark.parametrize(("score", "available"), [(70, False), (75, True), (80, True), (85, True)])
def test_eligibility_thresholds(spark, score, available):
    staff = spark.createDataFrame([("b", "acme", 75, True), ("a", "acme", 85, True), ("0", "acme", 10, False)], "employee_id string, company string, threshold int, opted_in boolean")
    asked = spark.createDataFrame([(1, "acme", score)], "request_id long, company string, score long")
    r = directory.eligible(asked, staff).first()
    assert r.available is available and r.employee_id == ({75: "b", 80: "b", 85: "a"}.get(score))


def test_scalars(spark):
    df = spark.createDataFrame([("\t A  B \n", "a;b, ,c", "80.7", "  ", "http://h.x/a")], "a string, b string, c string, d string, e string")
    r = df.select(T.normalized_company(F.col("a")).alias("a"), T.domain_list(F.col("b")).alias("b"), T.threshold(F.col("c")).alias("c"), T.ticked(F.col("d")).alias("d"), T.url_hash(F.col("e")).alias("e"), T.html_to_text(F.lit("<p>a&amp;b</p><script>x</script><nav>n</nav>c")).alias("h"), T.cleaned(F.lit(" a \n\n\t b ")).alias("cl")).first()
    h = 0
    for ch in "http://h.x/a":
        h = (h * 31 + ord(ch)) % 2**32
    h = 2**32 - h if h >= 2**31 else h
    digits = ""
    while h:
        digits, h = "0123456789abcdefghijklmnopqrstuvwxyz"[h % 36] + digits, h // 36
    assert (r.a, r.b, r.c, r.d, r.e, r.h, r.cl) == ("a b", ["a", "b", "c"], 80, False, digits, "a&b\nc", "a\n\nb")


def score(spark, text, entries, total=0.0):
    posting = spark.createDataFrame([(1, text)], "posting_id long, text string")
    e = spark.createDataFrame([(1, *x) for x in entries], "profile_id long, domain string, tech string, industry double, personal double, weight int, tags array<string>")
    return matcher.scores(matcher.parsed(posting), matcher.profiles(e, spark.createDataFrame([(1, total)], "profile_id long, total_years double"))).first()


def test_matcher_scores(spark):
    python = [("backend", "python", 2.0, 0.0, None, [])]
    assert score(spark, "Requirements:\n- 4+ years of Python experience", python).score == 65
    # a year-less ask with real exposure earns 0.7 at least
    assert score(spark, "Requirements:\n- Experience with Python", [("backend", "python", 0.5, 0.0, None, [])]).score == 70
    # half of the personal years count; the alias resolves to the entry with the most years
    aliased = [("data_bi", "PostgreSQL", 0.0, 2.0, None, ["sql"]), ("data_bi", "MySQL", 0.5, 0.0, None, ["sql"])]
    assert score(spark, "Requirements:\n- 2 years of SQL", aliased).score == 65
    # one member of an either-or line is enough; nothing known scores the least
    assert score(spark, "Requirements:\n- 2 years of Python or Java", python).score == 94
    assert score(spark, "Requirements:\n- 2 years of Rust or Java", [("mobile", "ios", 1.0, 0.0, None, [])]).score == 18
    assert score(spark, "About us:\nnothing", python).score == 25


def test_matcher_lines(spark):
    text = "Dev\nRequirements:\n- Go home\n- go developer, 3-5 years\n- kubernetes - advantage\n- aws\nNice to have:\n- 4 years docker\n- react"
    lines = matcher.told_lines(spark.createDataFrame([(1, text)], "posting_id long, text string"))
    reqs = {r.tech: (r.section, r.years) for r in matcher.requirements(matcher.line_facts(lines)).collect()}
    assert reqs == {"go": ("required", 3.0), "aws": ("required", None), "kubernetes": ("advantage", None), "docker": ("advantage", 4.0), "react": ("advantage", None)}


def test_edit_script_replays_both_sides():
    a, b = list("kitten on a mat"), list("sitting on mats")
    ops = documents_cv.edit_script(a, b)
    assert [x for k, x in ops if k != "insert"] == a and [x for k, x in ops if k != "delete"] == b
    assert sum(k == "keep" for k, _ in documents_cv.edit_script(["x"] * 300, ["x"] * 300)) == 0  # too many cells


def test_revisions_and_strategy(spark):
    new = spark.createDataFrame([(1, 0, "built reliable services"), (1, 1, "zzz")], "doc_id long, line_no int, text string")
    old = spark.createDataFrame([(1, 0, "Built a reliable service"), (1, 1, "other")], "doc_id long, line_no int, text string")
    out = {r.line_no: r for r in documents_cv.revisions(new, old).collect()}
    assert out[0].best == "Built a reliable service" and out[0].ratio == round(difflib.SequenceMatcher(None, "built a reliable service", "built reliable services").ratio(), 6)
    assert out[1].best is None and out[1].changed
    said = [(1, 'ok\nDECISION: high_fit\n###STRATEGY###{"fit_type":"niche_fit","questions":["a"]}'), (2, 'x ###STRATEGY###{"fit_type":"niche_fit","questions":["a","b"]}'), (3, "x ###STRATEGY### {bad"), (4, "x")]
    got = {r.doc_id: (r.fit_type, r.n_questions) for r in documents_cv.strategy(spark.createDataFrame(said, "doc_id long, text string")).collect()}
    assert got == {1: ("high_fit", 0), 2: ("niche_fit", 2), 3: ("", 0), 4: ("", 0)}


def test_each_text_is_scored_once(spark):
    postings = spark.createDataFrame([(1, "Requirements:\n- python"), (2, "Requirements:\n- java"), (3, "Requirements:\n- python"), (4, None), (5, ""), (6, "Requirements:\n- python")], "posting_id long, text string")
    entries = spark.createDataFrame([(7, "backend", "python", 3.0, 0.0, None, []), (8, "backend", "java", 3.0, 0.0, None, [])], "profile_id long, domain string, tech string, industry double, personal double, weight int, tags array<string>")
    people = matcher.profiles(entries, spark.createDataFrame([(7, 3.0), (8, 3.0)], "profile_id long, total_years double"))
    seen = []

    def scored(texts):
        seen.append(texts.count())
        return matcher.scores(matcher.parsed(texts), people)

    plain = matcher.scores(matcher.parsed(postings), people)
    assert sorted(matcher.once_a_text(postings, scored).collect()) == sorted(plain.collect()) and seen == [3]
    assert sorted(matcher.top_postings(postings, people, 2, 18).collect()) == sorted(matcher.ranked(plain, 2, 18).collect())


def test_small_files_are_dealt_before_texts_are_made(spark):
    from matchweave.plans import fallback, inputs, named

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for rows in (inputs.postings(spark, "/root/testdata/sf0.001"), named.vacancies(spark, "/root/testdata/sf0.001"), fallback._people(spark, "/root/testdata/sf0.001")):
        assert rows.rdd.getNumPartitions() == tasks


def test_signals_look_at_a_text_without_lambdas(spark):
    rows = spark.createDataFrame([("THE ROLE job position career",), ("what you’ll need",), ("job career",), (None,)], "text string")
    out = rows.select(T.has_signal(F.col("text")).alias("a"), T.has_page_words(F.col("text")).alias("b"))
    assert [tuple(r) for r in out.collect()] == [(True, True), (True, False), (False, False), (False, False)]
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_fallback_terms_are_looked_for_before_their_patterns(spark):
    from matchweave.operators import fallback_profile

    rows = spark.createDataFrame([(1, "xgo go Golang/Java, 3 years of C# and node.js"), (2, "javascripts"), (3, None)], "profile_id long, text string")
    out = fallback_profile.entries(rows)
    assert sorted(r.tech for r in out.collect()) == ["c#", "go", "golang", "java", "node.js"]
    assert "Contains(" in out._jdf.queryExecution().optimizedPlan().toString()
