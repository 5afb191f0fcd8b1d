"""Classes of near copies bear nulls, empty texts, repeated rows and empty tables."""

from tiepoint.llm import spotsigs


def test_classes_of_hard_rows(spark, hard):
    got = [(r["doc_id"], r["class_id"]) for r in spotsigs.near_duplicates(hard).collect()]
    assert len(got) == hard.count()
    of = dict(got)
    assert of[1] == of[2] == 1 and of[3] == of[4] == 3 and of[5] == 5 and of[9] == 9 and got.count((9, 9)) == 2
    assert of[None] is None and of[6] == 6 and of[8] == 8
    assert spotsigs.near_duplicates(hard.limit(0)).count() == 0
