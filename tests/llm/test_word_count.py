from commweave.llm.common import word_count


def test_words_are_counted_in_the_jvm_as_bytes_are_split(spark):
    texts = [None, "", " ", "a", " a\tb\nc\x0bd\x0ce\rf ", "a\xa0b\u2003c\x1cd\x85e", "é ü\u200b 語 \U0001f600", "x" * 300_000, "a b " * 100_000, "\x00 \x1f"]
    found = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string").select("i", word_count("text").alias("n"))
    assert {r["i"]: r["n"] for r in found.collect()} == {i: len((t or "").encode().split()) for i, t in enumerate(texts)}
    assert dict(found.dtypes)["n"] == "bigint" and "Python" not in found._jdf.queryExecution().executedPlan().toString()
