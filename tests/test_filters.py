from pyspark.sql import functions as F
import datetime as dt


from quarry.operators import filters as FL


def _posts(spark):
    rows = [
        ("1", "harbor-web", dt.datetime(2024, 1, 2, 23, 59, 59, 999999), "comment", "en", "US", "cat1", ("one1", "two1"), (0.2, 1.0)),
        ("2", "orchard-orchard-web", dt.datetime(2024, 1, 3, 0, 0, 0), None, "fr", None, "cat2", None, (None, 0.0)),
        ("3", "lantern-notes-comments", dt.datetime(2024, 1, 1, 12, 0), "post", "de", "DE", None, ("one3", None), (0.9, None)),
    ]
    return spark.createDataFrame(
        rows,
        "id string, index_name string, date_ts timestamp_ntz, type string, language_text string, country string, "
        "category string, misc struct<category_one:string, category_two:string>, issues struct<spread:double, toxic:double>",
    )


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_terms_sentinels():
    assert FL.terms(None) == []
    assert FL.terms([]) == []
    assert FL.terms(["Any", "x"]) == []
    assert FL.terms(["x"]) == ["x"]


def test_active_thresholds():
    assert FL.active_thresholds({"a": "0.0:0.0"}) == {}
    assert FL.active_thresholds({"a": "0.1:0.5", "b": "0.0:0.0"}) == {"a": (0.1, 0.5)}


def test_comment_exclusion_keeps_null_type(spark):
    assert ids(FL.exclude_comments(_posts(spark))) == ["2", "3"]


def test_issue_or_and_missing_scores(spark):
    df = _posts(spark)
    spec = FL.FilterSpec(thresholds={"issues.spread": "0.8:1.0", "issues.toxic": "1.0:1.0"}, exclude_comments=False)
    assert ids(FL.apply_filter(df, spec)) == ["1", "3"]
    inverted = FL.FilterSpec(thresholds={"issues.spread": "0.5:0.1"}, exclude_comments=False)
    assert ids(FL.apply_filter(df, inverted)) == []
    inactive = FL.FilterSpec(thresholds={"issues.spread": "0.0:0.0"}, exclude_comments=False)
    assert ids(FL.apply_filter(df, inactive)) == ["1", "2", "3"]


def test_day_range_inclusive(spark):
    df = _posts(spark)
    spec = FL.FilterSpec(start_date="2024-01-02", end_date="2024-01-02", exclude_comments=False)
    assert ids(FL.apply_filter(df, spec)) == ["1"]  # 23:59:59.999999 kept, next midnight dropped


def test_scheme_routing(spark):
    df = _posts(spark)
    rules = FL.SchemeRules(two_level=("harbor",), one_level=("lantern",))
    per_index = FL.FilterSpec(category_one=["one1", "cat2", "one3"], exclude_comments=False, rules=rules)
    assert ids(FL.apply_filter(df, per_index)) == ["1", "2", "3"]
    # parity: one scheme for the whole selection
    base = FL.FilterSpec(category_one=["one1", "cat2"], exclude_comments=False, scheme=FL.BASE)
    assert ids(FL.apply_filter(df, base)) == ["2"]
    two = FL.FilterSpec(category_one=["one1"], category_two=["two1"], exclude_comments=False, scheme=FL.TWO_LEVEL)
    assert ids(FL.apply_filter(df, two)) == ["1"]
    assert rules.for_name("x-harbor,orchard-orchard-web") == FL.TWO_LEVEL


def test_compare_mode(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, ""), (4, "Any"), (5, "b")], "id int, c string")
    assert {r.id for r in FL.compare_mode(df, F.col("c")).collect()} == {1, 5}
    many = spark.range(70).selectExpr("cast(id % 7 as string) as c")
    assert FL.compare_mode(many, F.col("c")).count() == 70

def test_empty_spec_is_true(spark):
    df = _posts(spark)
    assert ids(FL.apply_filter(df, FL.FilterSpec(exclude_comments=False))) == ["1", "2", "3"]


def test_filter_pushdown(spark, tmp_path):
    p = str(tmp_path / "p")
    _posts(spark).write.parquet(p)
    df = spark.read.parquet(p)
    spec = FL.FilterSpec(start_date="2024-01-01", end_date="2024-01-02", language=["en"], exclude_comments=False)
    plan = FL.apply_filter(df, spec)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "language_text" in plan and "GreaterThanOrEqual(date_ts" in plan


def test_map_typed_issues(spark):
    from quarry.sources.schema import map_key_fields

    df = spark.createDataFrame(
        [("1", {"spread": 0.9}), ("2", {"toxic": 1.0}), ("3", {})], "id string, issues map<string,double>"
    )
    spec = FL.FilterSpec(thresholds={"issues.spread": "0.8:1.0", "issues.toxic": "1.0:1.0"}, exclude_comments=False)
    assert ids(FL.apply_filter(df, spec)) == ["1", "2"]
    assert sorted(r.field for r in map_key_fields(df, "issues").collect()) == ["issues.spread", "issues.toxic"]
