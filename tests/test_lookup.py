"""A lookup without hot keys is one join."""

from deflow.operators.skew import lookup


def test_no_hot_keys_is_a_plain_join(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 4)], "k string, v int")
    right = spark.createDataFrame([("a", 10), ("c", 30)], "k string, w int")
    for how, want in (("inner", [("a", 1, 10)]), ("left", [("a", 1, 10), ("b", 2, None), ("b", 3, None), (None, 4, None)])):
        out = lookup(left, right, ["k"], how, [])
        assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
        assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
