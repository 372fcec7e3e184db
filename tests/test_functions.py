"""Corner cases of the expression language, against Python's own arithmetic."""

import math
import struct

from pyspark.sql import functions as F

from meshlark.functions import arrays, scalar


def column(spark, values, kind="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").repartition(2)


def values(df, c):
    return [r.v for r in df.select("i", c.alias("v")).orderBy("i").collect()]


def test_error_functions(spark):
    xs = [0.0, 1e-300, 1e-9, 0.1, 0.5, 0.999, 1.5, 1.999, 2.0, 2.001, 2.9, 3.0, 3.1, 5.0, 10.0, 26.0, 30.0, math.inf]
    xs += [-x for x in xs] + [math.nan]
    df = column(spark, xs)
    for f, want in ((scalar.erf, math.erf), (scalar.erfc, math.erfc)):
        for x, got in zip(xs, values(df, f(F.col("x")))):
            assert math.isnan(got) if math.isnan(x) else math.isclose(got, want(x), rel_tol=2e-13, abs_tol=1e-300), (f, x, got)


def test_quotients_by_zeros_of_both_signs(spark):
    df = column(spark, [0.0, -0.0, 2.0])
    assert values(df, scalar.divide(F.lit(1.0), F.col("x"))) == [math.inf, -math.inf, 0.5]
    assert values(df, scalar.divide(F.lit(-1.0), F.col("x"))) == [-math.inf, math.inf, -0.5]


def test_halves_round_away(spark):
    xs = [0.49999999999999994, 0.5, -0.5, 1.5, 2.5, -2.5, 2.4, 4503599627370497.0, 1e300]
    assert values(column(spark, xs), scalar.round_away(F.col("x"))) == [0.0, 1.0, -1.0, 2.0, 3.0, -3.0, 2.0, 4503599627370497.0, 1e300]


def test_bits(spark):
    ints = [0, 1, -1, 255, -(2**31), 2**31 - 1]
    df = column(spark, ints, "int")
    assert values(df, scalar.popcount(F.col("x"))) == [bin(x & 0xFFFFFFFF).count("1") for x in ints]
    wrap = lambda x: (x + 2**31) % 2**32 - 2**31
    assert values(df, scalar.wrapping(lambda a, b: a + b, F.col("x"), F.lit(2**31 - 1))) == [wrap(x + 2**31 - 1) for x in ints]
    assert values(df, scalar.wrapping(lambda a, b: a * b, F.col("x"), F.lit(-70_000))) == [wrap(x * -70_000) for x in ints]
    longs = [0, 1, -1, 2**40, 2**63 - 1]
    wide = column(spark, longs, "bigint")
    assert values(wide, scalar.popcount(F.col("x"), 64)) == [bin(x & (2**64 - 1)).count("1") for x in longs]
    assert values(wide, scalar.count_leading_zeros(F.col("x"), 64)) == [64 - (x & (2**64 - 1)).bit_length() for x in longs]
    floats = column(spark, [0.0, 1.5, -2.25], "float")
    bits = [struct.unpack("<i", struct.pack("<f", x))[0] for x in (0.0, 1.5, -2.25)]
    assert values(floats, scalar.float_bits(F.col("x"))) == bits
    assert values(column(spark, bits, "int"), scalar.bits_float(F.col("x"))) == [0.0, 1.5, -2.25]


def test_repeat(spark):
    assert values(column(spark, [1.0, 3.0]), scalar.repeat(4, lambda i, x: x * 2 + i, F.col("x"))) == [27.0, 59.0]


def test_arrays(spark):
    df = spark.createDataFrame([(0, [3.0, 1.0, 2.0, 1.0], [1, 2, 3, 4])], "i int, a array<double>, b array<int>")
    one = lambda c: df.select(c.alias("v")).first().v
    assert one(arrays.concatenate(F.col("a"), F.array(F.lit(9.0)))) == [3.0, 1.0, 2.0, 1.0, 9.0]
    assert one(arrays.broadcast_rows(F.col("b"), 2)) == [[1, 2, 3, 4]] * 2 and one(arrays.broadcast_cols(F.col("b"), 2)) == [[1, 1], [2, 2], [3, 3], [4, 4]]
    down = arrays.sort_with(lambda x, y: x["f0"] > y["f0"], F.col("a"), F.col("b"))
    assert [one(c) for c in down] == [[3.0, 2.0, 1.0, 1.0], [1, 3, 2, 4]]
    best = arrays.reduce_rows(F.struct(F.lit(-1.0).alias("f0"), F.lit(0).alias("f1")), lambda s, r: F.when(r["f0"] > s["f0"], F.struct(r["f0"].alias("f0"), r["f1"].alias("f1"))).otherwise(s), F.col("a"), F.col("b"))
    assert tuple(one(best)) == (3.0, 1)
    pairs = F.array(F.col("a"), F.col("a"))
    assert one(arrays.batched_dot(pairs, pairs)) == [15.0, 15.0]
    assert one(arrays.pad(F.col("a"), 4, F.lit(0.0), low=-1, high=2, interior=1)) == [0.0, 1.0, 0.0, 2.0, 0.0, 1.0, 0.0, 0.0]
