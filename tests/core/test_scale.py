"""Where texts and anchors meet, and what is read once."""

from tessella.operators import evaluation, phrases
from tessella.plans import catalog

SF = "/root/testdata/sf0.001"


def test_anchors_whole_and_spread(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "a", "one two three"), (1, "a", "One, two"), (1, "b", "three"), (2, "a", "two"), (3, "a", "x")], "case int, model string, text string")
    anchors = spark.createDataFrame([(c, t) for c in (1, 2) for t in ("one", "one two", "three", "two", "two", "!", "wo")], "case int, anchor string")
    rows = lambda: sorted(map(tuple, evaluation.anchors_in_all(texts, anchors).collect()))
    whole = rows()
    assert whole == [(1, "a", 3, 6), (1, "b", 1, 6), (2, "a", 1, 6)]
    for most in (5, 0):
        monkeypatch.setattr(phrases, "WHOLE", most)
        assert rows() == whole


def test_anchors_are_shuffled_once(spark):
    plan = catalog.queries()["anchors_in_repeats"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3 and "BroadcastHashJoin" not in plan


def test_texts_stay_where_they_are(spark):
    """Scores by case don't shuffle the texts to their case, even where Spark would not broadcast by itself."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.queries()["must_keep_score"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_names_and_words_in_one_scan(spark):
    texts = spark.createDataFrame([("c", "a", "so Anna met Bert"), ("c", "b", "then bert met Carl"), ("c", None, "so Dora met"), ("c", "b", "and Dora"), (None, "a", "so Emil")], "case string, model string, text string")
    known = spark.createDataFrame([("c", "carl")], "case string, name string")
    found = evaluation.invented_names(texts, known)
    assert {tuple(r) for r in found.collect()} == {("c", "a", "anna"), ("c", "b", "dora")}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2
