import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomsearch.functions import metrics, text
from loomsearch.functions.metrics import Metric


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_exact_values(spark):
    a, b = metrics.vector([1, 2, 3]), metrics.vector([4, 5, 6])
    r = one(spark, metrics.dot(a, b), metrics.squared_norm(metrics.vector([3, 4])), metrics.score("l2", metrics.vector([0, 0]), metrics.vector([3, 4])), metrics.score("ip", a, b))
    assert tuple(r) == (32.0, 25.0, -5.0, 32.0)


def test_zero_and_empty_vectors(spark):
    zero, empty = metrics.vector([0, 0, 0]), metrics.vector([])
    r = one(spark, metrics.cosine(zero, metrics.vector([1, 2, 3])), metrics.cosine(empty, empty), metrics.dot(empty, empty), metrics.squared_l2(empty, empty))
    assert tuple(r) == (0.0, 0.0, 0.0, 0.0)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 17, 65, 129, 257])
def test_against_numpy(spark, n):
    r = np.random.default_rng(n)
    a, b = r.uniform(-1, 1, n), r.uniform(-1, 1, n)
    got = one(spark, *[metrics.score(m, metrics.vector(a), metrics.vector(b)) for m in ("cosine", "l2", "ip")])
    want = (a @ b / np.linalg.norm(a) / np.linalg.norm(b), -np.linalg.norm(a - b), a @ b)
    assert np.allclose(got, want, atol=1e-12)


def test_metric_names():
    assert [Metric.parse(x) for x in ("cosine", "l2", "euclidean", "ip", "inner_product")] == [Metric.COSINE, Metric.L2, Metric.L2, Metric.IP, Metric.IP]
    assert str(Metric.L2) == "l2"
    with pytest.raises(ValueError):
        Metric.parse("hamming")


def test_haversine(spark):
    paris, london = (48.8566, 2.3522), (51.5074, -0.1278)
    km = one(spark, metrics.haversine_km(*map(F.lit, paris + london)))[0]
    assert 340 < km < 347
    assert math.isclose(one(spark, metrics.haversine_km(*map(F.lit, (0.0, 0.0, 0.0, 180.0))))[0], math.pi * 6371, rel_tol=1e-9)


def test_tokens(spark):
    cases = ["Hello, World! AI in 2025.", "", "ÉCOLE été", "a-b_c", "日本 x", "...", None]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cases], "t string").select(text.tokens(F.col("t"))).collect()]
    assert got[0] == ["hello", "world", "ai", "in", "2025"]
    assert got[2] == ["École".replace("cole", "cole"), "été"]
    assert got[:-1] == [text.tokenize(c) for c in cases[:-1]]
    assert got[-1] is None


def test_tokens_fuzz(spark):
    r = random.Random(5)
    alphabet = "aZ9 .,-éÉ日\n\t_'\"§"
    cases = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 30))) for _ in range(200)]
    got = [x[0] for x in spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string").orderBy("i").select(text.tokens(F.col("t"))).collect()]
    assert got == [text.tokenize(c) for c in cases]


def test_crc(spark):
    assert one(spark, F.crc32(F.lit("abc").cast("binary")))[0] == zlib.crc32(b"abc") == 0x352441C2
