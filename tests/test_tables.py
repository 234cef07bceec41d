from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tenura.errors import DataError, QualityError, StaleFeaturesError
from tenura.operators import clean, features, gold, quality
from tenura.plans import medallion
from tenura.sources import catalog, feature_store
from tenura.streaming import bronze

REF = datetime(2025, 1, 1)


def day(n):
    return REF - timedelta(days=n)


def visits(spark, ages, minutes=60):
    return spark.createDataFrame([("m", "l", day(a), minutes) for a in ages],
                                 "member_id string, location_id string, visit_date timestamp_ntz, visit_duration_minutes int")


def test_window_bounds_are_inclusive(spark):
    ages = [1, 4, 7, 12, 14, 22, 27, 47, 61, 78]
    for build in (gold.visit_windows, features.visit_features):
        r = build(visits(spark, ages), str(REF)).first()
        assert [r[f"visit_count_{n}d"] for n in (7, 14, 30, 60, 90)] == [3, 5, 7, 8, 10]
        assert r["days_since_last_visit"] == 1


def test_future_visits_count_in_gold_but_not_in_features(spark):
    assert gold.visit_windows(visits(spark, [-3, 2]), str(REF)).first()["visit_count_7d"] == 2
    assert features.visit_features(visits(spark, [-3, 2]), str(REF)).first()["visit_count_7d"] == 1


@pytest.mark.parametrize("recent,prior,want", [(2, 6, 1 / 3), (5, 0, 5.0)])
def test_frequency_trend(spark, recent, prior, want):
    r = features.visit_features(visits(spark, [3] * recent + [20] * prior), str(REF)).first()
    assert r["visit_frequency_trend"] == pytest.approx(want)


def test_member_without_visits_and_null_keys(spark):
    m = spark.createDataFrame([("a", "l", day(100), None, False, "regular", 10.0), ("b", None, day(10), day(0), True, "regular", 5.0)],
                              "member_id string, location_id string, join_date timestamp_ntz, cancel_date timestamp_ntz, churned boolean, contract_source string, monthly_price double")
    a = spark.createDataFrame([], "member_id string, location_id string, action_date timestamp_ntz, action_type string, action_id long, cost double")
    wide = gold.member_360(m, visits(spark, []), a, str(REF))
    row = wide.filter("member_id = 'a'").first()
    assert (row["visit_count_30d"], row["days_since_last_visit"], row["retention_action_count"], row["tenure_days"]) == (0, -1, 0, 100)
    assert [r["location_id"] for r in gold.location_kpis(wide).collect()] == ["l"]


def test_location_revenue_leaves_out_churned(spark):
    rows = [("l", "m%d" % i, i == 3, float(p), 0, 10, "regular") for i, p in enumerate([100, 120, 150, 80])]
    df = spark.createDataFrame(rows, "location_id string, member_id string, churned boolean, monthly_price double, visit_count_30d long, tenure_days long, contract_source string")
    r = gold.location_kpis(df).first()
    assert (r["mrr"], r["churn_rate"]) == (370.0, 0.25)


def test_null_limits(spark):
    df = lambda bad: spark.createDataFrame([(None if i < bad else 1.0,) for i in range(100)], "monthly_price double")
    assert clean.enforce_null_limits(df(1), {"monthly_price": 0.01}).count() == 100
    with pytest.raises(DataError):
        clean.enforce_null_limits(df(5), {"monthly_price": 0.01})


def spells(spark, *parts):
    return spark.createDataFrame([("m", day(a), None if b is None else day(b), i) for i, (a, b) in enumerate(parts)],
                                 "member_id string, join_date timestamp_ntz, cancel_date timestamp_ntz, load_id long")


def test_reenrollment_chain(spark):
    got = clean.merge_reenrollments(spells(spark, (400, 300), (281, 200), (175, 100), (40, None))).orderBy("join_date").collect()
    assert [(r["join_date"], r["cancel_date"], r["churned"], r["n_spells"]) for r in got] == [
        (day(400), day(100), True, 3), (day(40), None, False, 1)]


def test_reenrollment_boundary_and_open_spell(spark):
    assert clean.merge_reenrollments(spells(spark, (100, 60), (30, None))).count() == 1  # 30 days
    assert clean.merge_reenrollments(spells(spark, (100, 61), (30, None))).count() == 2  # 31 days
    assert clean.merge_reenrollments(spells(spark, (100, None), (30, 10))).count() == 2  # still open


def test_reenrollment_of_nested_spells(spark):
    got = clean.merge_reenrollments(spells(spark, (300, 150), (270, 260), (141, None))).collect()
    assert [(r["join_date"], r["cancel_date"], r["n_spells"]) for r in got] == [(day(300), None, 3)]


def test_keep_last_and_unknown_mode(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, None), (2, 1, "x")], "k int, seq int, v string")
    assert {tuple(r) for r in clean.keep_last(df, ["k"], ["seq"]).collect()} == {(1, 3, "c"), (2, 1, "x")}
    with pytest.raises(DataError):
        clean.limit_durations(visits(spark, [1]), mode="other")


def test_point_in_time_join_equals_brute_force(spark):
    import random

    rng = random.Random(5)
    t0 = datetime(2024, 1, 1)
    at = lambda: t0 + timedelta(minutes=rng.randrange(0, 4000))
    feats = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(3)}", at(), float(i)) for i in range(150)]
    ents = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(4)}", at(), i) for i in range(200)]
    f = spark.createDataFrame(feats, "k string, event_timestamp timestamp_ntz, v double")
    e = spark.createDataFrame(ents, "k string, event_timestamp timestamp_ntz, id long")
    for ttl in (3_600, 86_400, None):
        for bucket in (60, 7_200):
            got = {r["id"]: r["v"] for r in features.point_in_time_join(e, f, "k", ttl_seconds=ttl, bucket_seconds=bucket).collect()}
            assert len(got) == len(ents)
            for k, ts, i in ents:
                past = [(t, v) for kk, t, v in feats if kk == k and t <= ts and (ttl is None or (ts - t).total_seconds() <= ttl)]
                assert got[i] == (max(past)[1] if past else None)


def test_folds_never_look_ahead(spark):
    df = spark.createDataFrame([(datetime(2023, 1, 1) + timedelta(days=i),) for i in range(365)], "event_date timestamp_ntz")
    got = features.expanding_folds(df, "event_date", 4, 3, 3).groupBy("fold", "role").agg(F.min("event_date").alias("lo"), F.max("event_date").alias("hi"), F.count("*").alias("n"))
    rows = {(r["fold"], r["role"]): r for r in got.collect()}
    assert len({f for f, _ in rows}) == 3
    for f in range(3):
        assert rows[f, "train"]["hi"] < rows[f, "val"]["lo"]
        assert f == 0 or rows[f, "train"]["n"] > rows[f - 1, "train"]["n"]


def test_temporal_split_errors(spark):
    df = spark.createDataFrame([], "d timestamp_ntz")
    with pytest.raises(DataError):
        features.temporal_split(df, "d", 1, 1, 1)
    with pytest.raises(DataError):
        features.temporal_split(df, "missing", 1, 1, 1)


def test_schema_problems_are_listed_together(spark):
    df = spark.createDataFrame([("a", 1)], "member_id string, age int").withColumn("extra", F.lit(1))
    assert len(catalog.schema_problems(df, {"member_id": "int64", "age": "int64", "name": "string"})) == 2
    with pytest.raises(DataError):
        catalog.load_raw(spark, "nope", {})
    with pytest.raises(DataError):
        catalog.load_raw(spark, "x", {"x": "/tmp/does-not-exist.parquet"})
    with pytest.raises(DataError):
        catalog.lookup_one(df, "member_id", "zzz")
    assert catalog.lookup_one(df, "member_id", "a")["age"] == 1


def test_feature_store_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("m", day(1), 5), ("m", day(0), 6)], "member_id string, event_timestamp timestamp_ntz, tenure_days long")
    feature_store.publish(rows, "tenure", str(tmp_path))
    view = feature_store.read_view(spark, "tenure", str(tmp_path))
    keys = spark.createDataFrame([("m",), ("x",)], "member_id string")
    got = {r["member_id"]: r["tenure_days"] for r in feature_store.online_features(keys, ["tenure:tenure_days"], {"tenure": view}).collect()}
    assert got == {"m": 6, "x": None}
    for bad in ([], ["tenure:nope"], ["other:x"]):
        with pytest.raises(DataError):
            feature_store.online_features(keys, bad, {"tenure": view})
    with pytest.raises(DataError):
        feature_store.publish(rows, "unknown", str(tmp_path))


def test_gates_raise(spark):
    df = visits(spark, [1], minutes=2)
    with pytest.raises(QualityError):
        quality.require(quality.silver_visits(df))
    with pytest.raises(StaleFeaturesError):
        quality.require_fresh(visits(spark, [2]).withColumnRenamed("visit_date", "event_timestamp"), str(REF))
    assert quality.silver_visits(visits(spark, [])).filter("not passed").count() == 0


def test_pipeline_and_incremental_bronze(spark, tmp_path):
    m = spark.createDataFrame([(f"m{i}", "l1", str(day(200 + i)), str(day(20)) if i % 3 == 0 else None, i % 3 == 0, "regular", "basic", 50.0, 1) for i in range(60)],
                              "member_id string, location_id string, join_date string, cancel_date string, churned boolean, contract_source string, plan_type string, monthly_price double, seq int")
    v = spark.createDataFrame([(f"m{i % 60}", "l1", str(day(i % 50)), 30 + i) for i in range(300)], "member_id string, location_id string, visit_date string, visit_duration_minutes int")
    a = spark.createDataFrame([("m1", "l1", str(day(5)), "personal_trainer_session", 80.0, 1)], "member_id string, location_id string, action_date string, action_type string, cost double, action_id long")
    raw, table = str(tmp_path / "raw"), str(tmp_path / "bronze")
    v.write.mode("append").parquet(raw)
    for _ in range(2):  # a second run finds nothing new
        bronze.ingest_new_files(spark, raw, v.schema, table, str(tmp_path / "cp"))
    assert bronze.read_bronze(spark, table).count() == 300
    v.write.mode("append").parquet(raw)
    bronze.ingest_new_files(spark, raw, v.schema, table, str(tmp_path / "cp"))
    landed = bronze.read_bronze(spark, table).drop("ingest_date")
    assert landed.count() == 600
    paths = medallion.run(m, landed, a, ["seq"], str(REF), str(tmp_path / "lake"))
    assert spark.read.parquet(paths["silver/visits"]).count() == 271  # copies and durations above 300 are gone
    assert spark.read.parquet(paths["gold/member_360"]).filter("last_action_type = 'pt_session'").count() == 1
    assert spark.read.parquet(paths["gold/locations"]).first()["total_members"] == 60


def test_activity_counts_members_of_any_id_and_merges_states(spark):
    rows = [(f"m{i % 37}" if i % 50 else None, "ab"[i % 3 == 0], f"2024-01-{1 + i % 28:02d} 10:00:00", 30 + i % 5) for i in range(900)] + [("m1", None, "2024-01-05 10:00:00", 10)]
    visits = spark.createDataFrame(rows, "member_id string, location_id string, d string, visit_duration_minutes int").withColumn("visit_date", F.col("d").cast("timestamp_ntz")).drop("d")
    got = {(r["grain"], r["location_id"], str(r["period_start"])[:10]): (r["visits"], r["visiting_members"], r["total_minutes"]) for r in gold.location_activity(visits).collect()}
    known = visits.where("location_id is not null")
    for grain, unit in gold.GRAINS.items():
        want = known.groupBy("location_id", F.date_trunc(unit, "visit_date").alias("p")).agg(F.count("*").alias("n"), F.count_distinct("member_id").alias("m"), F.sum("visit_duration_minutes").alias("t")).collect()
        for r in want:
            assert got[grain, r["location_id"], str(r["p"])[:10]] == (r["n"], r["m"], r["t"])
    numbers = gold.member_numbers(visits)
    assert sorted(r["number"] for r in numbers.collect()) == list(range(37))
    # states of two days' loads, made apart, merge to what one load gives; sketches come close
    joined = known.join(numbers, "member_id", "left")
    early, late = (gold.daily_activity(joined.where(c), F.col("number")) for c in ("visit_date < '2024-01-10'", "visit_date >= '2024-01-10'"))
    merged = {(r["grain"], r["location_id"], str(r["period_start"])[:10]): r["visiting_members"] for r in gold.merge_activity(early.unionByName(late)).collect()}
    assert merged == {k: v[1] for k, v in got.items()}
    rough = gold.merge_activity(gold.daily_activity(joined, F.col("number"), sketch=True), ["monthly"], sketch=True).collect()
    assert all(abs(r["visiting_members"] - got["monthly", r["location_id"], "2024-01-01"][1]) <= 1 for r in rough)


def test_last_row_keeps_its_attributes_and_the_merged_membership(spark):
    rows = [("a", "2024-01-01", "2024-06-01", "basic", 1), ("a", "2024-06-20", None, "premium", 2), ("b", "2023-01-01", "2023-02-01", "basic", 3), ("b", "2024-01-01", None, "standard", 4), ("c", "nonsense", None, "basic", 5)]
    raw = spark.createDataFrame(rows, "member_id string, join_date string, cancel_date string, plan_type string, load_id int").withColumns({"contract_source": F.lit("regular"), "churned": F.lit(False)})
    got = {r["member_id"]: (str(r["join_date"])[:10], r["cancel_date"], r["plan_type"], r["churned"]) for r in clean.clean_members(raw, ["load_id"]).collect()}
    assert got == {"a": ("2024-01-01", None, "premium", False), "b": ("2024-01-01", None, "standard", False), "c": ("None", None, "basic", False)}
