from sparkcols.llm import line_dedup


def test_lines_with_inner_repeats_are_linked(spark):
    """Equal sets of shingles in lines of different length."""
    texts = ["-" * 20, "-" * 40, "a phrase again " * 5, "a phrase again " * 10, "a line of its own that has no copy"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc: r.lost for r in line_dedup.lost_lines(docs).collect()} == {1: [0], 3: [0]}
