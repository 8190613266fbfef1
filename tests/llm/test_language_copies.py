"""A language whose rows are mostly copies keeps its training texts."""

from pyspark.sql import functions as F

from facetframe.llm import language


def test_copies_take_no_training_texts(spark):
    copies = spark.range(200_000).select(F.lit("the same old text").alias("text"), F.lit("xx").alias("lang"))
    others = spark.range(60).select(F.concat(F.lit("another text "), "id").alias("text"), F.lit("xx").alias("lang"))
    few = spark.range(7).select(F.concat(F.lit("ein Text "), "id").alias("text"), F.lit("yy").alias("lang"))
    got = language.sample(copies.unionByName(others).unionByName(few), rows=80)
    by_language = [k for _, k in got]
    assert len(set(got)) == len(got)
    assert by_language.count("xx") == 40 and by_language.count("yy") == 7


def test_every_language_is_learned(spark):
    rows = [(f"{chr(97 + i % 26)}{chr(97 + i // 26)} word{i}", f"l{i:03}") for i in range(200)]
    got = language.sample(spark.createDataFrame(rows, "text string, lang string"))
    assert sorted(got) == sorted(rows)
    model = language.fit([t for t, _ in got], [k for _, k in got])
    assert len(model.languages) == 200
