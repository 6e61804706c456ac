"""Functions around lines: the sweep against the product, and on a file of many functions."""

import random
import time

import pytest

from sparkwarden.operators.learning import enclosing


def nested(r, first, last, out, depth=0):
    """Random functions inside the lines first to last."""
    at = first
    while at <= last:
        end = min(last, at + r.randint(0, 12))
        if r.random() < 0.6:
            out.append((at, end, depth))
            if end > at:
                nested(r, at + 1, end - r.randint(0, 1), out, depth + 1)
        at = end + 1 + r.randint(0, 3)


@pytest.mark.parametrize("seed", range(3))
def test_equal_to_the_product(spark, seed):
    r = random.Random(seed)
    functions, places = [], []
    for f in range(12):
        out = []
        nested(r, 1, 60, out)
        functions += [(f"f{f}", a, b, d) for a, b, d in out]
        places += [(f"f{f}", r.choice([None, *range(0, 66)])) for _ in range(80)]
    places.append(("none", 3))
    fn = spark.createDataFrame(functions, "file string, a long, b long, depth int")
    got = {(x.file, x.line): (x.a, x.b, x.open) for x in enclosing(spark.createDataFrame(places, "file string, line long").repartition(3), fn).collect()}
    want = {}
    for file, line in places:
        if line is not None:
            around = [(d, a, b) for f, a, b, d in functions if f == file and a <= line <= b]
            want[file, line] = (*min(around)[1:], len(around)) if around else (None, None, 0)
    assert got == want


def test_a_file_of_a_hundred_thousand_functions(spark):
    n = 100_000
    fn = spark.range(n).selectExpr("'f' AS file", "id * 3 + 1 AS a", "id * 3 + 2 AS b").union(spark.sql(f"SELECT 'f', 0L, {3 * n + 5}L"))
    places = spark.range(4 * n).selectExpr("'f' AS file", f"id % {3 * n} + 1 AS line")
    start = time.perf_counter()
    out = enclosing(places, fn)
    assert out.where("a = 0 AND open = CASE WHEN line % 3 = 0 THEN 1 ELSE 2 END").count() == 3 * n
    assert time.perf_counter() - start < 60
