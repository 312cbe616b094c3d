"""Texts that stand once are neither stored nor shuffled."""

from gradeflow.llm import exact


def test_only_texts_that_may_repeat_are_kept_for_grouping(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)] + [(50, "TEXT 3"), (51, None), (52, "")], "doc_id long, text string")
    marked = exact._marked(docs, "doc_id", "text")
    assert marked.where("_radix_text is not null").count() <= 4
    rows = {r.doc_id: r for r in exact.exact_dedup(docs).collect()}
    assert len(rows) == 43 and rows[3].keep_id == 50 and not rows[3].kept and rows[50].group_size == 2
    assert rows[51].keep_id == 52 and rows[7].keep_id == 7 and rows[7].kept and rows[7].group_size == 1
