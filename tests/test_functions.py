import datetime as dt

import pytest
from pyspark.sql import types as T

from quarry.functions import dates as D
from quarry.functions import indexes as IX
from quarry.operators import evalset as EV
from quarry.sources import schema as SC


def test_index_prefix(spark):
    names = ["orchard-telegram-archive", "a-a-tiktok", "harbor-facebook-youtube", "x-web-y"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(IX.index_prefix("n")).collect()]
    assert got == ["orchard-archive", "a-a", "harbor", "x-y"]
    assert got == [IX.py_index_prefix(n) for n in names]
    sel = spark.createDataFrame([("a-b-web,a-b-telegram,c-d-web",)], "s string")
    assert sorted(sel.select(IX.selection_topic_indexes("s")).collect()[0][0]) == ["topics-a-b", "topics-c-d"]
    assert df.select(IX.base_index("n")).collect()[0][0] == "orchard-telegram"


def test_schema_walk():
    s = T.StructType([
        T.StructField("issues", T.StructType([T.StructField("a", T.DoubleType()),
                                              T.StructField("sub", T.StructType([T.StructField("b", T.DoubleType())]))])),
        T.StructField("topics", T.ArrayType(T.StructType([T.StructField("topic_hash_id", T.StringType())]))),
        T.StructField("issuesx", T.DoubleType()),
    ])
    assert SC.prefixed_fields(s, "issues.") == ["issues.a", "issues.sub", "issues.sub.b"]
    assert SC.prefixed_fields(s, "topics") == ["topics", "topics.topic_hash_id"]
    assert SC.union_fields([s, T.StructType([T.StructField("issues", T.StructType([T.StructField("z", T.DoubleType())]))])], "issues.") == [
        "issues.a", "issues.sub", "issues.sub.b", "issues.z"]


def test_default_window():
    today = dt.date(2024, 3, 20)
    assert D.default_window("2020-01-01", today, "2024-01-01", "2024-01-31") == (dt.date(2024, 1, 1), dt.date(2024, 1, 31))
    assert D.default_window("2020-01-01", today, "2024-01-01", None) == (dt.date(2024, 3, 7), today)
    assert D.default_window("2025-01-01", today) == (dt.date(2025, 1, 1), dt.date(2025, 1, 1))
    with pytest.raises(ValueError):
        D.check_window(dt.date(2019, 1, 1), today, "2020-01-01", today)


def test_model_pairs(spark):
    q = spark.range(50).withColumnRenamed("id", "question_id")
    rows = EV.model_pairs(q, ["m1", "m2", "m3"], seed="s").collect()
    by_q = {}
    for r in rows:
        by_q.setdefault(r.question_id, []).append(r.model)
    assert len(by_q) == 50 and all(len(set(v)) == 2 for v in by_q.values())
    assert len({tuple(v) for v in by_q.values()}) > 1
    with pytest.raises(ValueError):
        EV.model_pairs(q, ["only"])


def test_fill_single_pass(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([("Q {texts}", "T {question}")], "q string, t string")
    got = df.select(EV.fill("A {question} B {texts} C {question}", F.col("q"), F.col("t"))).collect()[0][0]
    assert got == "A Q {texts} B T {question} C Q {texts}"
    assert EV.template_for({"x": None}, "x")[1] == EV.DEFAULT_HUMAN
    assert EV.template_for({"x": "t {texts}"}, "x")[1] == "t {texts}"


def test_hashing_encoder_deterministic_and_normalised():
    import numpy as np

    from quarry.operators.encode import HashingEncoder

    e = HashingEncoder(dim=32)
    a = e.encode(["Hello world hello", None, ""])
    b = HashingEncoder(dim=32).encode(["hello WORLD hello"])
    assert np.allclose(a[0], b[0]) and abs(np.linalg.norm(a[0]) - 1) < 1e-12
    assert not a[1].any() and not a[2].any()
