import itertools

import pytest
from pyspark.sql import functions as F

from matchweave.llm import sentence_pieces as S

sentencepiece = pytest.importorskip("sentencepiece")
TEXTS = [
    "a  b", " a", "", None, "a\nb\t c\n\n d \n", "héé😀 x▁y", "x" * 300 + "implementation" * 20 + " " + "abc" * 50, " " * 40 + "z", "\x00​", "日本語 안녕",
    "----------------=====/////## includegraphics MERCHANTABILITY", "the end of the text. " * 5000,
]


@pytest.mark.parametrize("table_words", [S.TABLE_WORDS, 5, 0])
def test_equals_the_library(spark, table_words):
    sp = sentencepiece.SentencePieceProcessor(model_file=S.MODEL)
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(0, "a  b", 1), (None, "a  b", 1)], "doc_id long, text string, ids int")
    out = S.encode(df, table_words=table_words, checked=True).collect()
    assert len(out) == len(TEXTS) + 2
    for r in out:
        assert r.ids == sp.encode(r.text or "") and r.n_ids == len(r.ids) and r.round_trip
    text = S.decoder(spark)(F.col("ids"))
    back = {r.doc_id: r.t for r in S.encode(df).select("doc_id", text.alias("t")).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in enumerate(TEXTS))


def test_empty(spark):
    assert S.encoded_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_viterbi_is_the_best_path(spark):
    """Against all paths: of two sets of merges the one with the least merge that the other lacks is better."""
    order = ["aa", "ab", "aaa", "abab", "aab", "ba", "xa"]
    merges = {"aa": ["aa"], "ab": ["ab"], "aaa": ["aa", "aaa"], "abab": ["ab", "ab", "abab"], "aab": ["aa", "aab"], "ba": ["ba"], "xa": ["xa"]}
    places = {"aa": [1], "ab": [1], "aaa": [1, 2], "abab": [1, 3, 2], "aab": [1, 2], "ba": [1], "xa": [1]}

    def own(piece, start):
        return [(order.index(m) << 32) + p + start for m, p in zip(merges[piece], places[piece], strict=True)]

    for word in ("aaaaa", "ababab", "xaabaaab", "x", "babaxaaaa"):
        edges = [(i, j, own(word[i:j], i)) for i, j in itertools.combinations(range(len(word) + 1), 2) if word[i:j] in merges]
        df = spark.createDataFrame([(word, edges)], "word string, edges array<struct<start:int,end:int,merges:array<bigint>>>")
        found = df.select(S.viterbi(F.col("word"), F.col("edges")).alias("v")).first().v
        paths = []
        for n in range(len(word)):
            for cut in itertools.combinations(range(1, len(word)), n):
                spans = list(zip((0, *cut), (*cut, len(word)), strict=True))
                if all(j - i == 1 or word[i:j] in merges for i, j in spans):
                    paths.append(sorted(m for i, j in spans if j - i > 1 for m in own(word[i:j], i)) + [S.NO_MERGE])
        assert found == min(paths)
        assert found == S.fold_in_place(len(word), [(m[-1] >> 32, i, j) for i, j, m in edges])


def test_clashing_names_and_a_cut_between_words(spark):
    df = spark.createDataFrame([(1, "one, two.", 5, 6, 7, 8), (2, None, 5, 6, 7, 8)], "doc_id long, text string, need int, own int, told int, key int")
    out = S.encode(df, table_words=0).collect()
    assert sorted((r.doc_id, r.need, r.own, r.told, r.key) for r in out) == [(1, 5, 6, 7, 8), (2, 5, 6, 7, 8)]
    sp = sentencepiece.SentencePieceProcessor(model_file=S.MODEL)
    assert {r.doc_id: r.ids for r in out} == {1: sp.encode("one, two."), 2: []}
