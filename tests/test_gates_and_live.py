"""Gates with injected faults, digests, live rules, streams and model steps."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallycast.operators import live as L
from tallycast.operators import modeling as ML
from tallycast.operators import quality as Q
from tallycast.operators import release as RL
from tallycast.streaming import jobs as R

DAY = dt.timedelta(days=1)
META = ("market_id string, clob_token_id string, question string, start_date timestamp_ntz, end_date timestamp_ntz, duration_days long, "
        "total_volume double, yes_final_price double, outcome int, split string")


def meta_row(t0, i, **kw):
    row = dict(market_id=f"m{i}", clob_token_id="t", question="q", start_date=t0, end_date=t0 + 40 * DAY, duration_days=40,
               total_volume=1.0, yes_final_price=0.99, outcome=1, split="train")
    return tuple({**row, **kw}.values())


def test_clean_metadata_passes_and_faults_are_found(spark, t0):
    Q.require_clean(Q.check_meta(spark.createDataFrame([meta_row(t0, 1), meta_row(t0, 2)], META)))
    faulty = [meta_row(t0, 1), meta_row(t0, 1), meta_row(t0, 2, question=" "), meta_row(t0, 3, yes_final_price=0.95),
              meta_row(t0, 4, outcome=0), meta_row(t0, 5, end_date=None), meta_row(t0, 6, end_date=t0), meta_row(t0, 7, duration_days=39),
              meta_row(t0, 8, split="val")]
    gate = Q.check_meta(spark.createDataFrame(faulty, META))
    got = {r.check_name: r.n for r in Q.gate_counts(gate).collect()}
    ids = {(r.check_name, r.market_id) for r in gate.collect()}
    assert {("empty_question", "m2"), ("bad_dates", "m5"), ("bad_split", "m8"), ("duplicate_market_id", "m1")} <= ids
    assert got == {"duplicate_market_id": 2, "empty_question": 1, "placeholder_price": 1, "outcome_vs_price": 1, "empty_end_date": 1,
                   "bad_dates": 1, "end_not_after_start": 1, "duration_mismatch": 2, "bad_split": 1}
    with pytest.raises(Q.GateFailed):
        Q.require_clean(gate)
    with pytest.raises(Q.GateFailed):
        Q.check_meta(spark.range(1).withColumnRenamed("id", "market_id"))


def test_evidence_tolerances(spark, t0):
    meta = spark.createDataFrame([meta_row(t0, i) for i in range(4)], META)
    seen = [meta_row(t0, 0, start_date=t0 + dt.timedelta(milliseconds=500), total_volume=1.0 + 1e-7), meta_row(t0, 1, total_volume=1.001), meta_row(t0, 2, outcome=0)]
    got = {(r.market_id, r.problem) for r in Q.check_against_source(meta, spark.createDataFrame(seen, META)).collect()}
    assert got == {("m1", "total_volume_differs"), ("m2", "outcome_differs"), ("m3", "no_evidence")}


def test_digests_ignore_order_and_notice_changes(spark):
    df = spark.createDataFrame([(i % 3, i, float(i)) for i in range(50)], "market_id int, ts int, v double")
    same = lambda a, b: sorted(Q.market_digests(a).collect()) == sorted(Q.market_digests(b).collect())
    assert same(df, df.orderBy(F.desc("ts")).repartition(3))
    assert not same(df, df.withColumn("v", F.when(F.col("ts") == 7, 0.5).otherwise(F.col("v"))))
    assert Q.table_digest(df, ["ts"]).first() == Q.table_digest(df.orderBy(F.desc("ts")), ["ts"]).first()


def live_row(t0, **kw):
    row = dict(start_date=t0 - 60 * DAY, end_date=t0 + 60 * DAY, n_prices=40, price_at_snapshot=0.4, total_volume=50000.0, category="crypto")
    return tuple({**row, **kw}.values())


LIVE = "start_date timestamp_ntz, end_date timestamp_ntz, n_prices int, price_at_snapshot double, total_volume double, category string"
CASES = [({}, []), ({"end_date": None}, ["no_end_date"]), ({"end_date": -1}, ["past_end_date"]), ({"n_prices": 5}, ["few_prices"]),
         ({"start_date": -5}, ["young_market"]), ({"price_at_snapshot": 0.97}, ["settled_price"]), ({"price_at_snapshot": 0.05}, ["settled_price"]),
         ({"end_date": 10}, ["near_close"]), ({"end_date": 400}, ["long_market"]), ({"total_volume": 10.0}, ["outside_filters"]),
         ({"category": None}, ["no_category"]), ({"start_date": -10, "end_date": 5}, ["near_close", "young_market", "outside_filters"])]


def test_warning_codes(spark, t0):
    def shift(kw):
        return {k: t0 + v * DAY if k.endswith("date") and isinstance(v, int) else v for k, v in kw.items()}

    df = spark.createDataFrame([(i, *live_row(t0, **shift(kw))) for i, (kw, _) in enumerate(CASES)], "i int, " + LIVE)
    got = {r.i: r.w for r in df.select("i", L.warning_codes(F.lit(t0)).alias("w")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(CASES)}


def test_outcome_rule(spark):
    df = spark.createDataFrame([(1.0,), (0.96,), (0.0,), (0.05,), (0.5,), (None,)], "p double")
    assert [r[0] for r in df.select(L.outcome_of(F.col("p"))).collect()] == [1, 1, 0, 0, None, None]


POOL = "market_id string, n_outcomes int, closed boolean, n_tokens int, scope_date timestamp_ntz, volume double, created_at timestamp_ntz, end_date timestamp_ntz, yes_price double"


def test_each_condition_makes_a_market_ineligible(spark, t0):
    good = dict(market_id="m", n_outcomes=2, closed=False, n_tokens=1, scope_date=t0 - 60 * DAY, volume=5000.0, created_at=t0 - 60 * DAY, end_date=t0 + 60 * DAY, yes_price=0.4)
    bad = [{"market_id": None}, {"n_outcomes": 3}, {"closed": True}, {"n_tokens": 0}, {"scope_date": None}, {"scope_date": dt.datetime(2022, 1, 1)},
           {"volume": 999.0}, {"end_date": t0}, {"created_at": t0 - 13 * DAY}, {"created_at": t0 - 15 * DAY, "end_date": t0 + 10 * DAY}, {"yes_price": None}, {"yes_price": 0.95}, {"yes_price": 0.05}]
    df = spark.createDataFrame([tuple({**good, **b}.values()) for b in [{}, *bad]], POOL)
    assert [r[0] for r in df.select(L.eligible(F.lit(t0))).collect()] == [True] + [False] * len(bad)


def test_draw_spreads_evenly_and_removals_keep_the_rest_in_order(spark):
    names = spark.range(400).select(F.concat(F.lit("market-"), "id").alias("market_id"), (F.col("id") % 4).alias("part"))
    drawn = names.orderBy(*L.draw_order("week 9"))
    head = drawn.limit(200).groupBy("part").count().collect()
    assert len(head) == 4 and all(25 <= r["count"] <= 75 for r in head)
    every = [r.market_id for r in drawn.collect()]
    odd = [r.market_id for r in names.filter("part = 1").repartition(7).orderBy(*L.draw_order("week 9")).collect()]
    assert odd == [m for m in every if int(m.split("-")[1]) % 4 == 1]
    assert [r.market_id for r in names.orderBy(*L.draw_order("week 10")).limit(10).collect()] != every[:10]


def test_length_weights_and_buckets(spark):
    df = spark.createDataFrame([(30,), (380,), (10,), (90,), (365,)], "duration_days int")
    got = df.select(L.length_weight().alias("w"), L.live_bucket().alias("b")).collect()
    assert [round(1 / r.w) for r in got[:3]] == [16, 366, 1]
    assert [r.b for r in got] == ["<=90d", ">365d", "<=90d", "<=90d", "90-365d"]


def test_record_needs_enough_resolved_markets(spark, t0):
    rows = [("s", i, i, t0, "r1", 0.4, 0.3 if i % 2 else 0.6, i % 2) for i in range(120)]
    rows += [("s", 0, 500, t0 + DAY, "r1", 0.9, 0.9, 0)]
    df = spark.createDataFrame(rows, "source string, market_id int, lookup_id int, ts timestamp_ntz, release string, market_price double, m double, outcome int")
    firsts = L.first_lookups(df).withColumn("resolution_status", F.lit("resolved"))
    assert firsts.count() == 120
    assert {r.model for r in L.record_metrics(L.scorable(firsts, ["m"]), ["release"], ["m"]).collect()} == {"market", "m"}
    assert L.record_metrics(L.scorable(firsts.filter("market_id < 99"), ["m"]), ["release"], ["m"]).isEmpty()


def test_promotion_checks(spark):
    cols = "model string, auc_lo double, auc_hi double, loss_lo double, loss_hi double, ece_old double, ece_new double, edge_lo double"
    df = spark.createDataFrame([("ok", -0.1, 0.1, -0.1, 0.1, 0.02, 0.03, 0.1), ("bad", -0.2, -0.1, 0.1, 0.2, 0.02, 0.04, -0.1)], cols)
    got = {r.model: r for r in RL.promotion_checks(df).collect()}
    assert got["ok"].passed and not got["ok"].warnings
    assert got["bad"].fails == ["auc_regression", "log_loss_regression", "calibration"] and got["bad"].warnings == ["no_edge_over_market"]


def test_stream_in_slices_equals_batch(spark, t0, tmp_path):
    rows = [(i % 7, i, t0 + dt.timedelta(hours=i)) for i in range(60)]
    df = spark.createDataFrame(rows, "market_id int, lookup_id int, ts timestamp_ntz")
    for k in range(3):
        df.filter(F.col("lookup_id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    log = R.append_log(source.withColumn("source", F.lit("s")).withColumn("release", F.lit("r1")), spark, str(tmp_path / "log"))
    assert log.count() == 60
    assert {(r.market_id, r.lookup_id) for r in R.first_of_log(log).collect()} == {(i, i) for i in range(7)}
    unique = R.run_to_table(R.ingest(source.withColumn("end_date", F.col("ts").cast("timestamp")), "market_id", "end_date"), spark, str(tmp_path / "out"))
    assert sorted(r.market_id for r in unique.collect()) == list(range(7))


def test_model_steps(spark):
    rows = [(i // 5, "ab"[i % 2], float(i % 10) / 10, int(i % 10 >= 5)) for i in range(100)]
    df = ML.training_table(spark.createDataFrame(rows, "market_id int, category string, x double, outcome int"))
    model = ML.fit_logistic(["x"])(ML.prepare(df, ["x"]), {"C": 1.0, "l1": False})
    out = ML.scored(model, ML.prepare(df, ["x"]))
    assert ML.holdout_auc(model, ML.prepare(df, ["x"])) == 1.0
    p = [r.p for r in ML.calibrated(ML.fit_calibrator(out), out).collect()]
    assert min(p) == ML.PROB_FLOOR and max(p) == ML.PROB_CEIL
    assert ML.importance_table(model, df, ["x"]).orderBy(F.abs("importance").desc()).first().feature == "x"
    with pytest.raises(ValueError):
        ML.check_params({"C": 1.0}, {"C", "l1"})


def test_rare_and_unseen_categories_collapse(spark):
    train = spark.createDataFrame([(i, "rare" if i == 0 else "big") for i in range(100)], "market_id int, category string")
    test = spark.createDataFrame([(1, "big"), (2, "rare"), (3, "new")], "market_id int, category string")
    a, b = ML.collapse_rare(train, test)
    assert {r.category for r in a.collect()} == {"big", "other"} and sorted(r.category for r in b.collect()) == ["big", "other", "other"]


def test_classifiers_leave_unanswered_rows_for_the_next_run(spark):
    df = spark.createDataFrame([(1, "ROCKET above 1?"), (2, "rain?"), (3, ""), (4, "a storm in orbit")], "market_id int, question string")
    native = df.select("market_id", ML.keyword_category(F.col("question"), {"air": ["storm"], "space": ["rocket", "orbit"]}).alias("c"))
    assert {r.market_id: r.c for r in native.collect()} == {1: "space", 2: "other", 3: None, 4: "air"}
    plugged = ML.classify_questions(df, lambda texts: [t[:1] or None for t in texts])
    assert {r.market_id: r.category for r in plugged.collect()} == {1: "R", 2: "r", 3: None, 4: "a"}


def test_preparation_of_numbers_and_categories(spark):
    train = spark.createDataFrame([(1.0, "b"), (3.0, "a"), (None, "b"), (10.0, None)], "x double, category string")
    other = spark.createDataFrame([(None, "zz"), (5.0, "a")], "x double, category string")
    a, b = ML.fill_medians(train, other, ["x"])
    assert sorted(r.x for r in a.collect()) == [1.0, 3.0, 3.0, 10.0] and sorted(r.x for r in b.collect()) == [3.0, 5.0]
    a, b = ML.ordinal_category(train, other)
    assert sorted(r.category_code for r in a.collect()) == [-1.0, 0.0, 1.0, 1.0] and sorted(r.category_code for r in b.collect()) == [-1.0, 0.0]
    assert ML.standardized(spark.createDataFrame([(1.0,), (3.0,)], "x double"), ["x"]) == {"x": (2.0, 1.0)}


def test_boosting_stops_at_its_best_round_and_models_survive_saving(spark, tmp_path):
    rows = [(i // 4, "ab"[i % 2], (i * 37 % 101) / 100, int((i * 37 % 101) > 50) if i % 9 else i % 2, i % 5 == 0) for i in range(400)]
    df = spark.createDataFrame(rows, "market_id int, category string, x double, outcome int, is_holdout boolean").withColumn("weight", F.lit(1.0))
    model = ML.fit_boosted(["x"], rounds=24, patience=5, first=6)(ML.prepare(df, ["x"]), {"learning_rate": 0.3, "max_depth": 2, "min_child_weight": 5})
    assert 1 <= ML.rounds_of(model) <= 24
    held = ML.prepare(df.filter("is_holdout"), ["x"])
    iso = ML.fit_calibrator(ML.scored(model, held))
    ML.save_model(model, iso, str(tmp_path / "m"))
    again = {r.x: r.p for r in ML.score_saved(str(tmp_path / "m"), held).collect()}
    assert again == {r.x: r.p for r in ML.calibrated(iso, ML.scored(model, held)).collect()}


def test_smoke_fit_has_a_floor(spark):
    rows = [(i, "a", t, float(i % 2), i % 2) for i in range(60) for t in range(2)]
    df = spark.createDataFrame(rows, "market_id int, category string, snapshot_timestamp int, x double, outcome int")
    assert ML.smoke_fit(df, df, ["x"]) == 1.0
    with pytest.raises(ValueError, match="does not exceed"):
        ML.smoke_fit(df, df.withColumn("outcome", 1 - F.col("outcome")), ["x"])
