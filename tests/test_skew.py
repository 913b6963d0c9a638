"""Joins with hot keys, verdict reuse over long chains, and myth matching by text."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from claimspark.operators import batch as B
from claimspark.operators import chronology as C
from claimspark.operators import myths as M
from claimspark.operators import skew
from claimspark.sources import seeds


@pytest.fixture(scope="module")
def sides(spark):
    r = random.Random(4)
    left = [(i, "hot" if i % 3 == 0 else None if i % 50 == 1 else f"k{r.randrange(400)}", i % 7) for i in range(6000)]
    right = [("hot", 1), ("hot", 2), (None, 3)] + [(f"k{i}", i) for i in range(300)]
    return spark.createDataFrame(left, "id long, k string, n int"), spark.createDataFrame(right, "k string, v int"), left, right


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_equals_brute_force(sides, how):
    l, r, left, right = sides
    got = sorted(map(tuple, skew.skew_join(l, r, ["k"], how, salts=16).select("id", *(["v"] if how in ("inner", "left") else [])).collect()), key=repr)
    values = {}
    for k, v in right:
        if k is not None:
            values.setdefault(k, []).append(v)
    want = {"inner": [(i, v) for i, k, _ in left for v in values.get(k, [])], "left": [(i, v) for i, k, _ in left for v in values.get(k, [None])],
            "left_semi": [(i,) for i, k, _ in left if k in values], "left_anti": [(i,) for i, k, _ in left if k not in values]}[how]
    assert got == sorted(want, key=repr)


def test_skew_join_refuses_outer_joins(sides):
    with pytest.raises(ValueError):
        skew.skew_join(sides[0], sides[1], ["k"], "full_outer")


def test_hot_keys_are_named(spark, sides):
    hot = skew.hot_keys(sides[0], ["k"])
    name = sides[0].filter("k = 'hot'").select(F.xxhash64("k")).first()[0]
    assert name in hot and len(hot) <= 2 / skew.HOT_SHARE
    assert skew.hot_keys(sides[0].limit(0), ["k"]) == []


def largest_and_median(joined):
    sizes = [n for n in joined.rdd.glom().map(len).collect() if n]
    return max(sizes), statistics.median(sizes)


def test_hot_key_is_dealt_over_tasks(spark):
    """A third of the rows on one name: without adaptive execution the largest task stays within three times the median."""
    rows = spark.range(60_000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 20_000)).alias("k"))
    table = rows.select("k").distinct().withColumn("v", F.lit(1))
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        largest, median = largest_and_median(skew.skew_join(rows, table, ["k"]))
        plain, _ = largest_and_median(rows.join(table, "k"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert largest <= 3 * median and plain > 4 * median


def test_dates_of_a_hot_name(spark):
    nodes = "claim_id long, ordinal int, node_type string, name string, birth_date date, death_date date, start_date date, end_date date"
    claims = spark.sql("SELECT id AS claim_id, 0 AS ordinal, 'Person' AS node_type, IF(id % 2 = 0, 'Anna', concat('P', id)) AS name, DATE'1900-01-01' AS birth_date, "
                       "CAST(NULL AS DATE) AS death_date, CAST(NULL AS DATE) AS start_date, CAST(NULL AS DATE) AS end_date FROM range(2000)")
    facts = spark.createDataFrame([(0, 0, "Person", "ANNA", None, None, None, None), (0, 1, "Person", "P7", None, None, None, None)], nodes).withColumn("birth_date", F.to_date(F.lit("1950-01-01")))
    issues = C.compare_dates(claims, facts)
    assert issues.count() == 1001 and issues.filter("severity = 'high'").count() == 1001


@pytest.mark.parametrize("inclusive", [False, True])
def test_reuse_over_ten_thousand_slices(spark, inclusive):
    r = random.Random(8)
    times = sorted(r.randrange(30_000 * 50) for _ in range(40_000))
    anchor, want = None, []
    for t in times:
        hit = anchor is not None and (t - anchor <= 50 if inclusive else t - anchor < 50)
        want.append(hit)
        anchor = anchor if hit else t
    df = spark.createDataFrame(list(enumerate(times)), "request_id long, s long").select("request_id", F.lit("k").alias("key"), F.timestamp_seconds("s").alias("ts"))
    got = [x["hit"] for x in B.reuse_flags(df, 50, inclusive=inclusive, hot_rows=10).orderBy("request_id").collect()]
    # Of equal times the request with the smallest id misses; sorted times keep that order.
    assert got == want


def test_myths_of_repeated_and_null_ids(spark):
    rows = [("a", "Napoleon war klein"), ("a", "die Erde ist flach"), (None, "die Erde ist flach"), (None, None), ("b", ""), ("b", "nothing of the kind"), ("c", "Napoleon war klein")]
    claims = spark.createDataFrame(rows, "claim_id string, text string")
    myths = seeds.myths(spark)
    pick = lambda df: sorted(((r["claim_id"], r["text"], r["myth_id"], r["myth_score"]) for r in df.collect()), key=repr)
    inline = pick(M.match_myths(claims, myths))
    assert len(inline) == len(rows) and inline == pick(M.match_myths(claims, myths, inline_limit=0))


def test_few_row_groups_are_spread(spark, tmp_path):
    """A file of one row group is cut into many splits by its bytes, of which one holds all rows."""
    from claimspark.session import spread

    path, cores = str(tmp_path / "one"), spark.sparkContext.defaultParallelism
    spark.range(40_000).withColumn("text", F.sha2(F.col("id").cast("string"), 256)).coalesce(1).write.parquet(path)
    small = {"spark.sql.files.maxPartitionBytes": "65536", "spark.sql.files.openCostInBytes": "1024"}
    before = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        table = spark.read.parquet(path)
        sizes = lambda df: [n for n in df.rdd.glom().map(len).collect() if n]
        assert table.rdd.getNumPartitions() >= cores and len(sizes(table)) == 1
        found = sizes(spread(table))
        assert sum(found) == 40_000 and max(found) <= 1.5 * 40_000 / cores
        even = spark.read.parquet(path).repartition(2 * cores)
        assert spread(even).rdd.getNumPartitions() == 2 * cores
        assert spread(table.limit(0)).count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_keywords_shuffle_texts_and_not_words(spark):
    """One shuffle of the texts; rows that share an id, or have none, still count together."""
    from claimspark.operators import kb as K

    rows = [(1, "alpha beta alpha gamma"), (1, "beta beta delta"), (None, "alpha alpha"), (None, "omega"), (2, None)]
    found = K.top_keywords(spark.createDataFrame(rows, "id long, text string"), 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "keyword" not in plan[plan.index("Exchange "):]
    assert sorted(((r["text_id"] or 0, r["rank"], r["keyword"], r["n"]) for r in found.collect())) == [
        (0, 1, "alpha", 2), (0, 2, "omega", 1), (1, 1, "beta", 3), (1, 2, "alpha", 2), (1, 3, "delta", 1)]


def test_known_myths_are_matched_once(spark):
    """The analysis of known myths is stored, so the result's plan does not match the texts again."""
    from claimspark.plans import analyze as A

    texts = spark.createDataFrame([("a", "Napoleon war klein"), ("b", "no remark"), ("c", None)], "claim_id string, text string")
    statuses = spark.createDataFrame([("b", "confirmed")], "claim_id string, fact_status string")
    out = A.analyze_texts(texts, seeds.myths(spark), statuses)
    assert "array_max" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["claim_id"] for r in out.collect()) == ["a", "b", "c"]
