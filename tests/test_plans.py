"""Shapes of physical plans: pushed filters, pruned columns, no nested-loop joins, no window over all rows."""

import re

import pytest
from pyspark.sql import functions as F

from batchloom.operators import lookups, positions, sets, sharding
from batchloom.plans import QUERIES, relations
from batchloom.session import table

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scoring_reads_only_its_columns_and_shuffles_only_sums(spark):
    plan = plan_of(QUERIES["topk_accuracy"](spark, SF))
    assert "vec_id" not in plan and "label:int" in plan and "embedding:array<float>" in plan
    assert plan.count("Exchange") == 1


def test_all_teachers_answer_in_one_pass(spark):
    for name in ("ensemble_teachers", "softmax_losses", "distill_loss"):
        plan = plan_of(QUERIES[name](spark, SF))
        assert plan.count("MapInArrow") == 1 and "MapInPandas" not in plan


def test_date_filter_is_pushed(spark):
    months = [relations.month_customers(spark, SF, *m) for m in (("1997-01-01", "1997-02-01"), ("1997-02-01", "1997-03-01"))]
    plan = plan_of(sets.membership_diff(*months, ["member"]))
    assert len(re.findall(r"PushedFilters: \[.*?GreaterThanOrEqual\(o_orderdate", plan)) == 2


@pytest.mark.parametrize("name", ["consistent_hash_assign", "record_range_lookup", "skip_processed_records", "barrier_complete", "balance_clients_servers"])
def test_no_nested_loops(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_windows_over_all_rows_see_top_blocks_only(spark):
    far = spark.range(5000).select((F.col("id") * 1_000_000_007_003).alias("id"))  # a block for each row
    tops = far.select(F.shiftright(F.expr("id div (1 << 18)"), 32)).distinct().count()
    assert tops < 100
    assert plan_of(positions.id_positions(far, "id")).count("SinglePartition") <= 1


def test_lookups_have_one_plan_with_salts(spark):
    rows = spark.range(1000).select((F.col("id") % 10).alias("k"))
    values = spark.range(10).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    assert "_salt" in plan_of(lookups.skewed_lookup(rows, values, "k"))


def test_ring_of_any_size_has_one_plan(spark):
    keys = spark.range(500).select(F.col("id").cast("string").alias("k"))
    plans = []
    for n in (3, 1001):
        nodes = spark.range(n).select(F.format_string("n%d", "id").alias("node"))
        found = sharding.consistent_hash_assign(keys, F.col("k"), nodes, "node", virtual=5)
        assert found.count() == 500
        plans.append([line.split("[")[0] for line in found._jdf.queryExecution().optimizedPlan().toString().split("\n")])
    assert [x.split("(")[0].strip(" +-:") for x in plans[0]] == [x.split("(")[0].strip(" +-:") for x in plans[1]]


def test_ranks_of_a_hot_job_are_found_in_many_tasks(spark):
    members = spark.range(6000).select(F.lit("j").alias("job"), F.col("id").alias("m"))
    leaders = spark.createDataFrame([("j", 5900)], "job string, l bigint")
    ranked = sharding.rank_members(members, "job", "m", leaders, "l", 3, 5000)
    assert plan_of(ranked).count("Window [") >= 2
    found = {r["m"]: r["rank"] for r in ranked.collect()}
    assert found == {5900: 0} | {m: m + 1 for m in range(4999)}


def test_bucketed_table_stays_in_place(spark, tmp_path):
    from batchloom.operators import colocated

    values = spark.range(2000).select(F.col("id").alias("k"), F.col("id").alias("v"))
    colocated.save_bucketed(values, "k", 16, "plan_test", str(tmp_path / "b"))
    assert len(list((tmp_path / "b").glob("*.parquet"))) == 16
    rows = spark.range(100_000).select((F.col("id") % 3000).alias("k"))
    plan = plan_of(colocated.bucketed_multi_get(rows, "plan_test", "k"))
    table_side = plan[plan.index("SortMergeJoin"):]
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(k" in table_side
    scan = table_side[table_side.index("FileScan"):]
    assert "Bucketed: true" in scan and "SelectedBucketsCount: 16 out of 16" in scan
    held = {r["f"] for r in spark.table("plan_test").where("k in (5, 6)").select(F.col("_metadata.file_name").alias("f")).collect()}
    for part in (tmp_path / "b").glob("*.parquet"):
        if part.name not in held:
            part.write_bytes(b"no parquet")  # whoever opens it fails
    for crc in (tmp_path / "b").glob(".*.crc"):
        crc.unlink()
    assert 1 <= len(held) <= 2
    assert sorted(r["v"] for r in colocated.bucketed_get(spark, "plan_test", "k", [5, 6]).collect()) == [5, 6]


def test_lines_of_files_are_numbered_without_a_shuffle(spark, tmp_path):
    from batchloom.sources import text

    (tmp_path / "a.txt").write_text("x\ty\t1\n\nx\ty\nx\tz\t0\n")
    good, _ = text.read_tsv_records(spark, str(tmp_path))
    for lines in (text.read_text_records(spark, str(tmp_path)), good):
        plan = plan_of(lines)
        assert "hashpartitioning" not in plan and "Window" not in plan and "SortMergeJoin" not in plan
    assert sorted((r.guid, r.segmented) for r in good.collect()) == [(0, "y"), (1, "z")]


def test_vocabulary_moves_whole_texts_and_shuffles_words_once(spark):
    plan = plan_of(QUERIES["read_vocabulary"](spark, SF))
    assert plan.count("hashpartitioning") == 1 and "Window" not in plan


def test_batches_of_texts_are_numbered_in_small_blocks(spark):
    plan = plan_of(QUERIES["columnar_batches"](spark, SF))
    assert max(int(n) for n in re.findall(r"doc_id#\d+L? div (\d+)", plan)) <= 4096
