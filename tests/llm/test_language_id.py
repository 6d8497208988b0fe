from matchweave.llm import language_id as L

WORDS = {"en": "the and of with that when there only thing", "de": "der und nicht über schön auch ein zwischen straße", "fr": "le être où avec pour une très élève dans"}


def corpus(n):
    out = []
    for i in range(n):
        lang = sorted(WORDS)[i % 3]
        w = WORDS[lang].split()
        out.append((i, " ".join(w[(i * k + k * k) % len(w)] for k in range(1, 40)), lang))
    return out


def test_held_out_accuracy_and_odd_rows(spark):
    rows = corpus(300) + [(1000, None, "en"), (1001, "12 34 !!", "de"), (1002, "", None), (None, "the and of with that", None), (5, corpus(6)[5][1], "fr"), (1003, "der und nicht " * 20_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "0.0D AS score")
    out = L.identify(df).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: r for r in out}
    held = [i for i, _, _ in corpus(300) if got[i].held_out]
    assert 40 < len(held) < 120
    assert sum(got[i].lang_pred == sorted(WORDS)[i % 3] for i in held) >= 0.97 * len(held)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002))
    assert got[1003].lang_pred == "de" and not got[None].held_out and all(0 <= r.score <= 1 for r in out)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "the end", None)], "doc_id long, text string, lang string")
    assert L.identify(df).first().lang_pred == "und"
    assert L.identify(df.limit(0)).count() == 0
    one = spark.createDataFrame([(0, "the end", "en"), (1, "the rest", "en"), (3, "a word", "en"), (5, "more", "en")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in L.identify(one).collect()} == {"en"}
