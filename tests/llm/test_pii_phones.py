"""Phones in all their shapes, and the columns that go with the texts."""

from hammerprice.llm import pii

KEY = "k"


def one(spark, texts, **more):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    return [r["text"] for r in pii.pseudonymised(df, key=KEY, **more).orderBy("doc_id").collect()]


def test_one_number_in_many_shapes(spark):
    for code, shapes in {"49": ["+49301234567", "+49-30-1234-567", "+49 30 1234 567", "+49 (30) 1234 567", "+49.30.1234.567"], "1": ["+12125551234", "+1 (212) 555-1234", "+1-212-555-1234", "(212) 555-1234", "212-555-1234"], "352": ["+352 621 123 456", "+352621123456"], "7": ["+7 495 123 45 67", "+74951234567"]}.items():
        new = one(spark, shapes)
        plain = ["".join(filter(str.isdigit, x)) for x in new]
        own = [p.removeprefix(code) if s.startswith("+") else p for p, s in zip(plain, shapes)]
        assert len(set(own)) == 1 and all(x != s for x, s in zip(new, shapes)), (shapes, new)
        assert all(p.startswith(code) for p, s in zip(plain, shapes) if s.startswith("+"))
        assert ["".join(c if not c.isdigit() else "0" for c in x) for x in new] == ["".join(c if not c.isdigit() else "0" for c in x) for x in shapes]
        assert one(spark, new, reveal=True) == shapes


def test_different_numbers_stay_different(spark):
    numbers = [f"+49 30 1234 {n:03d}" for n in range(60)]
    assert len(set(one(spark, numbers))) == 60


def test_all_columns_stay(spark):
    df = spark.createDataFrame([(1, "+49301234567", "a", "b", "c")], "doc_id int, text string, found_0 string, FOUND_1 string, hammerprice_found string")
    out = pii.pseudonymised(df, key=KEY)
    assert out.columns == df.columns
    row = out.first()
    assert (row["found_0"], row["FOUND_1"], row["hammerprice_found"]) == ("a", "b", "c")
