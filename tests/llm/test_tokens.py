import numpy as np
import pytest

from matchweave.llm import line_dedup, near_dedup, tokens


def parts(text):
    data = np.frombuffer(text.encode(), np.uint8)
    starts, h = tokens.words(data)
    assert len(starts) == len(h)
    return [text.encode()[s:].decode()[0] for s in starts], h


def test_words_of_any_script():
    assert parts("Année deux — «trois»　x")[0] == ["A", "d", "t", "x"]
    assert parts("中文,ab 字。")[0] == ["中", "文", "a", "字"]
    assert parts("ab中cd日")[0] == ["a", "中", "c", "日"]
    assert parts("ภาษา")[0] == list("ภาษา") and parts("한국어 말")[0] == ["한", "말"] and parts("𠀀𠀁a")[0] == ["𠀀", "𠀁", "a"]
    assert parts("")[0] == [] and parts("。 — ")[0] == []
    a, b = parts("“Déjà vu”")[1], parts("déjÀ, vu")[1]
    assert (a == b).all() and parts("中")[1][0] == parts("文中")[1][1]


def test_unspaced_scripts_link(spark):
    rng = np.random.default_rng(1)
    line = lambda n: "".join(map(chr, rng.integers(0x4E00, 0x9000, n)))
    text = [line(30) + "。" for _ in range(20)]
    near = [x[:7] + "变" + x[8:] if k == 9 else x for k, x in enumerate(text)]
    df = spark.createDataFrame([(1, "\n".join(text)), (2, "\n".join(near)), (3, text[0] + "\n" + line(30))], "doc_id long, text string")
    out = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df).collect()}
    assert out == {1: 1, 2: 1, 3: 3}
    kept = {r.doc_id: r.text.split("\n") for r in line_dedup.dedup_lines(df).collect()}
    assert len(kept[1]) == 20 and kept[2] == [near[9]] and len(kept[3]) == 1


@pytest.mark.parametrize("n", range(8))
def test_few_words_in_all(n):
    h, g = np.arange(1, n + 1, dtype=np.uint64), np.zeros(n, np.int64)
    got, groups = tokens.shingles(h, g, 5)
    # the same runs as beside a group of many words
    beside, of = tokens.shingles(np.concatenate([h, np.arange(50, 70, dtype=np.uint64)]), np.concatenate([g, np.ones(20, np.int64)]), 5)
    assert len(got) == (n > 0) * max(1, n - 4) and set(groups) <= {0}
    assert sorted(got) == sorted(beside[of == 0])
