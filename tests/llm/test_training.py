"""The sample that the classifiers learn from."""

from __future__ import annotations

from keyloom.llm.training import labelled_sample

from .helpers import labels_frame


def test_rows_of_one_id_dont_push_out_others(spark):
    rows = [(1, f"text {k}") for k in range(2000)] + [(i, f"single {i}") for i in range(2, 40)] + [(50, "copy")] * 9
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = labels_frame(spark, [(i, 1, i % 2) for i in [*range(1, 40), 50]])
    got = []
    for frame in (docs.repartition(7), docs.repartition(3, "text"), docs.coalesce(1)):
        got.append(sorted(map(tuple, labelled_sample(frame, labels, "toxic", 5, 0, 100, "t").select("doc_id", "text", "label").collect())))
    assert got[0] == got[1] == got[2]
    ids = [i for i, _, _ in got[0]]
    known = {r["doc_id"] for r in labels.selectExpr("doc_id", "crc32(cast(cast(doc_id as string) as binary)) % 5 as fold").where("fold != 0").collect()}
    assert 1 in known and set(ids) == known
    assert sorted(ids) == sorted([*known, 1])
