"""Column-partitioned input, and blocks on storage with their boundaries."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import RUN_ERRORS, grid_of, rows_of
from stripgrid.sources import storage
from stripgrid.sources.grids import from_blocks, from_column_parts, stack_columns

ARRAY = np.random.default_rng(1).normal(size=(23, 11))


def parts_of(spark, cuts=(0, 4, 5, 11)):
    return [rows_of(spark, ARRAY[:, a:b], partitions=p + 2) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def test_parts_side_by_side(spark):
    grid = stack_columns(parts_of(spark), 6)
    assert grid.dim == ARRAY.shape and np.array_equal(grid.to_local(), ARRAY)
    assert {(r.col_start, r.n_cols) for r in grid.directory().collect()} == {(0, 4), (4, 1), (5, 6)}
    assert np.array_equal(grid[3:20, 2:9].to_local(), ARRAY[3:20, 2:9])
    assert np.array_equal(grid.to_rows().to_local(), ARRAY)


def test_one_exchange_for_any_number_of_parts(spark):
    plan = stack_columns(parts_of(spark, range(12)), 6).df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_a_missing_or_repeated_row_is_an_error(spark):
    first, second, third = parts_of(spark)
    for broken in (second.base.where("row_id <> 7"), second.base.unionByName(second.base.where("row_id = 7"))):
        grid = stack_columns([first, second.replace(broken, second.cells), third], 6)
        with pytest.raises(RUN_ERRORS, match="same rows, each once"):
            grid.to_local()
    shifted = second.base.withColumn("row_id", F.when(F.col("row_id") == 7, 99).otherwise(F.col("row_id")))
    with pytest.raises(RUN_ERRORS, match="same rows, each once"):
        stack_columns([first, second.replace(shifted, second.cells), third], 6).to_local()
    with pytest.raises(ValueError):
        stack_columns([], 6)


def column_table(spark):
    rows = [(part, i, ARRAY[i, part * 4 : part * 4 + 4].tolist()) for part in range(3) for i in range(23)]
    return spark.createDataFrame(rows, "part int, row_id bigint, vec array<double>").repartition(4)


def test_table_of_column_parts(spark):
    table = column_table(spark)
    assert np.array_equal(from_column_parts(table, "part", "row_id", "vec", 5, parts=[0, 1, 2]).to_local(), ARRAY)
    # Ids with gaps keep their order.
    gaps = table.withColumn("part", F.col("part") * 10 - 7)
    assert np.array_equal(from_column_parts(gaps, "part", "row_id", "vec", 50).to_local(), ARRAY)


def test_incomplete_tables_of_column_parts(spark):
    table = column_table(spark)
    read = lambda t, **k: from_column_parts(t, "part", "row_id", "vec", 5, **k)
    with pytest.raises(ValueError, match="are wanted"):
        read(table.where("part <> 1"), parts=[0, 1, 2])
    with pytest.raises(ValueError, match="different numbers"):
        read(table.where("part <> 1 or row_id <> 3"))
    with pytest.raises(ValueError, match="differ in length"):
        read(table.withColumn("vec", F.when(F.col("row_id") == 3, F.array(F.lit(1.0))).otherwise(F.col("vec"))))
    swapped = table.withColumn("row_id", F.when(F.expr("part = 1 and row_id = 3"), 99).otherwise(F.col("row_id")))
    with pytest.raises(RUN_ERRORS, match="same rows, each once"):
        read(swapped).to_local()


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_stored_blocks_know_their_size_and_boundaries(spark, tmp_path):
    grid = grid_of(spark, ARRAY, 5, 4)
    storage.write_blocks(grid, str(tmp_path / "grid"))
    again = storage.read_blocks(spark, str(tmp_path / "grid"))
    assert again._dim == ARRAY.shape and again.steps == grid.steps
    assert np.array_equal(again.to_local(), ARRAY)
    # A grid whose first blocks were cut keeps its uneven boundaries.
    storage.write_blocks(again[3:20, 2:10], str(tmp_path / "cut"))
    cut = storage.read_blocks(spark, str(tmp_path / "cut"))
    assert cut.row_steps.lead == 2 and cut.row_steps.size == 5 and cut._dim == (17, 8)
    assert np.array_equal(cut[1:9, 3:7].to_local(), ARRAY[4:12, 5:9])
    with pytest.raises(RUN_ERRORS):
        storage.write_blocks(grid, str(tmp_path / "grid"))


def test_element_slices_prune_folders_and_row_groups(spark, tmp_path):
    storage.write_blocks(grid_of(spark, ARRAY, 5, 4), str(tmp_path / "grid"))
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = plan_of(storage.read_blocks(spark, str(tmp_path / "grid"))[11:19, 5:7].df)
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    folders = next(line for line in plan.splitlines() if "PartitionFilters" in line).split("PartitionFilters: ")[1]
    assert "block_col" in folders.split("]")[0] and ">= 1" in folders.split("]")[0]
    assert "GreaterThanOrEqual(block_row,2)" in plan and "LessThanOrEqual(block_row,3)" in plan


def test_element_slices_reach_below_the_shuffle_of_a_grid(spark):
    plan = plan_of(grid_of(spark, ARRAY, 5, 4)[11:14, :].df)
    below = plan[plan.rindex("Exchange hashpartitioning") :]
    assert "cast((row_id" in below and ">= 2" in below and "<= 2" in below


def test_irregular_blocks_are_stored_without_steps(spark, tmp_path):
    grid = grid_of(spark, ARRAY, 5, 4)
    loose = from_blocks(grid.df.select("block_row", "block_col", "n_rows", "n_cols", "vals"))
    storage.write_blocks(loose, str(tmp_path / "loose"))
    again = storage.read_blocks(spark, str(tmp_path / "loose"))
    assert again.steps == (None, None) and np.array_equal(again[3:20, 2:10].to_local(), ARRAY[3:20, 2:10])


def test_blocks_directories_come_from_one_scan(spark):
    """The input counts how often it is read: once for positions, once for values."""
    reads = spark.sparkContext.accumulator(0)

    def tap(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    blocks = grid_of(spark, ARRAY, 5, 4).df.select("block_row", "block_col", "n_rows", "n_cols", "vals").cache()
    total = blocks.count()
    tapped = blocks.mapInArrow(tap, blocks.schema)
    assert np.array_equal(from_blocks(tapped).to_rows().df.orderBy("row_id").toPandas()["vec"].apply(list).tolist(), ARRAY)
    assert reads.value <= 3 * total  # positions, panels of to_rows, values
    blocks.unpersist()
