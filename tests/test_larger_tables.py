"""What shows on larger tables only: tables of several files, rare hashes, cells and blocks of many rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatseam.functions.checksums import is_mixed_case, mixed_case
from chatseam.operators import neighbours
from chatseam.plans import QUERIES
from chatseam.plans.analysis_queries import _INFO_TABLES, wrong_case


def test_wrong_case_is_refused_whatever_the_letters(spark):
    digits = ["0" * 40, "a" + "1" * 39, "1" * 39 + "F", "ab" + "2" * 38, "AB" + "2" * 38, "3" * 38 + "ef", "aB" * 20, "5" * 20 + "abcdef" * 3 + "90"]
    right = spark.createDataFrame([("0x" + d,) for d in digits], "address string").select(mixed_case(F.col("address")).alias("address"))
    data = right.select("address", wrong_case(F.col("address")).alias("wrong"))
    for row in data.select("address", "wrong", is_mixed_case(F.col("wrong")).alias("passes")).collect():
        assert not row.passes and len(row.wrong) == 42, row
        assert row.wrong.lower() == row.address.lower() or (row.wrong[:-1] + "g" == row.wrong and row.wrong[:-1] == row.address[:-1])


def test_parquet_info_counts_a_table_of_several_files_once(spark, tmp_path):
    for name in _INFO_TABLES:
        rows = 0 if name == "labels" else 7
        spark.range(rows).selectExpr("id", "id AS other").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r.file: (r.rows, r.column_count) for r in QUERIES["parquet_info"](spark, str(tmp_path)).collect()}
    assert got == {f"{name}.parquet": (0 if name == "labels" else 7, 2) for name in _INFO_TABLES}


def test_equal_distances_go_to_smaller_ids(spark):
    # 40 places around the origin at one distance: only the names that a place has in the search can differ.
    ring = [(100 + k, [1.0 if k // 2 == d else 0.0 for d in range(20)] if k % 2 else [-1.0 if k // 2 == d else 0.0 for d in range(20)]) for k in range(40)]
    data = spark.createDataFrame([(7, [0.0] * 20), *ring], "id long, embedding array<double>")
    got = neighbours.neighbour_lists(data, "id", k=5, pivots=4).where("id = 7").collect()
    assert sorted(r.neighbour for r in got) == [100, 101, 102, 103, 104]


def test_cells_that_need_all_rows_are_searched_together():
    rows = {cell: 1_000 for cell in range(64)}
    blocks = neighbours._blocks(rows, {cell: 64_000 for cell in rows}, 64, 12)
    # Every block of queries gets all rows once: few blocks, each of them bounded.
    assert sum(parts for _, _, parts, _ in blocks) <= 3 and sorted(t for _, ts, _, _ in blocks for t in ts) == list(rows)
    apart = neighbours._blocks(rows, {cell: 2_000 for cell in rows}, 64, 12)
    assert len(apart) == 64
