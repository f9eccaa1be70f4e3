"""Every row is segmented by its own language's profile, whichever languages the table holds."""

from tessella.plans import relational


def test_a_fifth_language(spark, tmp_path):
    rows = [(1, "da", "Den 3. maj kom han. Ja."), (2, "hi", "यह एक है। वह दो है।"), (3, "xx", "One. Two."), (4, None, "One. Two.")]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.sent_id, r.sent) for r in relational.segment_docs_multilang(spark, str(tmp_path)).collect())
    assert [s for d, _, s in got if d == 2] == ["यह एक है।", "वह दो है।"]
    assert [s for d, _, s in got if d == 1] == ["Den 3. maj kom han.", "Ja."]
    assert [d for d, *_ in got].count(3) == [d for d, *_ in got].count(4) == 2
