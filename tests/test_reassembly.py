"""Documents put together again from accepted and rejected changes."""

from matchweave.operators import documents_cv


def test_reassembled(spark):
    kind = "doc_id long, unit_order int, unit_id long, unit_type string, changed boolean, approved boolean, original_text string, updated_text string"
    rows = [
        (1, 3, "bullet", True, False, " old bullet ", "new bullet"), (1, 1, "role_header", True, True, "Old", "New"), (1, 4, "role_header", True, None, "Old two", "New two"),
        (1, 5, "bullet", True, False, "no", "kept, as the original is short"), (1, 6, "section", False, False, "original", "unchanged"), (1, 2, "bullet", True, True, "x", "  "),
        (2, 1, "role_header", True, False, None, None), (3, 1, None, None, None, "gone", "text"),
    ]
    df = spark.createDataFrame([(d, n, 10 - n, *r) for d, n, *r in rows], kind)
    got = {r.doc_id: (r.text, r.n_units) for r in documents_cv.reassembled(df).collect()}
    assert got == {1: ("New\n$ old bullet\n\nNew two\n$ kept, as the original is short\nunchanged", 5), 2: ("", 0), 3: ("text", 1)}
    assert documents_cv.reassembled(df.limit(0)).count() == 0
