"""Any number of languages is learned."""

from tamarack.llm import language_id
from tamarack.llm._sample import sample_by_class


def test_more_than_64_languages(spark):
    rows = [(k, f"{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]} " * 9, f"l{k % 70}") for k in range(210)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert len(model.languages) == 70
    assert language_id.identify(docs, model).where("lang_pred <> 'und'").count() == 210
    assert 20 <= sample_by_class(docs, "doc_id", "lang", 3, max_rows=70).count() <= 140


def test_the_limit_holds_for_rows_of_one_id_and_of_none(spark):
    rows = [(None, f"text {k}", "a") for k in range(5000)] + [(7, f"other {k}", "b") for k in range(3000)] + [(k, "same", "c") for k in range(2000)] + [(9, "row", "d")] * 2000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for seed in range(4):
        got = sample_by_class(docs, "doc_id", "lang", 400, seed=seed).groupBy("lang").count().collect()
        assert {r.lang: r["count"] <= 400 for r in got if r.lang != "d"} == dict.fromkeys("abc", True)
        assert all(r["count"] >= 380 for r in got if r.lang in "abc") and all(r["count"] <= 400 for r in got)
    assert sample_by_class(docs.where("lang = 'd'").limit(30), "doc_id", "lang", 400).count() == 30


def test_long_texts_are_cut_for_training_alone(spark):
    docs = spark.createDataFrame([(k, ("abc def " if k % 2 else "xyz uvw ") * 9000, f"l{k % 2}") for k in range(8)], "doc_id long, text string, lang string")
    model = language_id.train(docs, max_chars=100)
    assert [r.lang_pred for r in language_id.identify(docs, model).orderBy("doc_id").collect()] == [f"l{k % 2}" for k in range(8)]
