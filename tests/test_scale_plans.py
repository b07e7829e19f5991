"""Plan shape and skew checks for the headline operators."""

from pyspark.sql import functions as F

from conftest import SF001
from scrubjay.operators import dedup as D
from scrubjay.operators import resolve as RS
from scrubjay.sources.observations import obs_documents


def test_hot_group_is_exact(spark):
    # a third of the rows share one text; numbering and ranks must stay exact
    n = 3000
    df = spark.range(n).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, F.lit("HOT text, same for many rows!"))
         .otherwise(F.concat(F.lit("row "), (F.col("id") % 997).cast("string"), F.lit(" tail"))).alias("content"),
        F.expr("timestampadd(SECOND, id, TIMESTAMP_NTZ'2024-01-01 00:00:00')").alias("created_at"),
        F.lit(None).cast("string").alias("entity_name"),
        F.lit(None).cast("timestamp_ntz").alias("updated_at"))
    g = D.find_groups(df)
    hot = g.filter(F.col("seed_id") == 2997).orderBy("rank_in_group").collect()
    assert len(hot) == n // 3
    assert [r.member_id for r in hot[:3]] == [2997, 2994, 2991]
    assert [r.rank_in_group for r in hot] == list(range(n // 3))
    # ids 2999 and 2998 are newer seeds of their own groups ("row 8 tail", "row 7 tail")
    assert hot[0].group_id == 2 and all(r.group_size == n // 3 for r in hot)
    tot = D.summarize(df).collect()[0]
    assert tot.duplicate_groups == g.filter("is_seed").count()
    assert tot.duplicate_records == g.count()
    # the merged text of the hot group lists every secondary once, in scan order
    merged = RS.merged_texts(g, df, "2024-06-01 00:00:00").filter(F.col("id") == 2997).collect()[0].merged
    dates = merged.split("[Original dates: ")[1].rstrip("]").split(", ")
    assert len(dates) == n // 3 - 1 and dates[0] == "2024-01-01 00:49:54"


def test_entity_filter_and_pruning_reach_the_scan(spark):
    obs = obs_documents(spark, SF001)
    q = D.summarize(obs, entity="src3")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(source), EqualTo(source,src3)]" in plan
    # the row count reads the filter column only; the text is read by the class subquery
    assert "ReadSchema: struct<source:string>" in plan
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython"):
        assert bad not in plan
