"""How texts become words for the license scan, and how often."""

import re

from pyspark.sql import functions as F

from barwright.llm import licenses

TEXTS = ["", " ", "MIT License", "--a..b--", "a", "été, ÉTÉ\tA1-b2", "x y \U0001F600z", "\x7f\x00{q}", "words\n\nand\r\nlines ", "Kelvin İx", "no_gap|here~"]


def test_words_are_the_runs_of_word_characters(spark):
    rows = spark.createDataFrame([(i, text) for i, text in enumerate(TEXTS)] + [(-1, None)], "id int, text string").select("id", licenses.words_of(F.col("text")).alias("words"))
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    assert {r["id"]: r["words"] for r in rows.collect()} == {-1: []} | {i: re.findall(licenses.WORD, text.translate(lower)) for i, text in enumerate(TEXTS)}


def test_texts_are_split_once_for_matches_and_once_for_phrases(spark):
    rows = spark.createDataFrame([(1, "released under the MIT license"), (2, None)], "doc_id bigint, text string")
    plan = licenses.scan(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and plan.count("split(translate(") == 2
