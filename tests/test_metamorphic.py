"""Metamorphic checks: results do not depend on the partitioning; output never grows."""
import os

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="test data not present")
def test_flagship_invariant_to_partition_count(spark):
    q = E.queries()["h5_optimize_context_fx2"]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        a = sorted(map(tuple, q(spark, SF).collect()))
        spark.conf.set("spark.sql.shuffle.partitions", "11")
        b = sorted(map(tuple, q(spark, SF).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == b


@pytest.mark.skipif(not os.path.exists(SF), reason="test data not present")
def test_optimized_output_never_longer(spark):
    for name in ("h5_optimize_context_fx2", "h5_optimize_context_fx1"):
        rows = E.queries()[name](spark, SF).where("status = 'optimized'").collect()
        assert rows and all(r.final_size <= r.initial_size for r in rows)
