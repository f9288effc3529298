"""Streaming equals batch; model trains, scores in [0, 1], artifacts round-trip."""


from pyspark.sql import functions as F

from delaylens.operators.model import (
    evaluation_frame,
    feature_importance,
    load_artifacts,
    save_artifacts,
    score_orders,
    train_gbt,
    training_stats,
)
from delaylens.operators.geo import geo_centroid
from delaylens.plans import common as c
from delaylens.plans.ml import open_order_records
from delaylens.plans.streams import _run_dir, delivery_outcomes
from delaylens.schemas import FEATURES
from delaylens.session import scratch_path
from delaylens.streaming.jobs import late_rate_windows
from tests.conftest import SF_SMALL


def _arrivals(spark, run, outcomes, order):
    """Let the outcomes of each year arrive in ``order``, one run per year."""
    from pyspark.sql import functions as F

    for k, year in enumerate(order):
        outcomes.filter(F.year("delivered_at") == year).write.parquet(f"{run}/incoming/slice-{k}")
        yield k


def _years(outcomes):
    from pyspark.sql import functions as F

    return [r.y for r in outcomes.select(F.year("delivered_at").alias("y")).distinct().orderBy("y").collect()]


def test_monitor_drops_late_rows_and_evicts_state(spark):
    from delaylens.streaming.jobs import compact_monitor, late_rate_monitor, read_monitor

    outcomes = delivery_outcomes(spark, SF_SMALL)
    run = _run_dir(spark, "late-test")
    years = _years(outcomes)
    order = [*years[1:4], years[0]]  # the first year's outcomes come last
    held = []
    for _ in _arrivals(spark, run, outcomes, order):
        q = late_rate_monitor(spark, f"{run}/incoming/*", f"{run}/sink", f"{run}/ckpt")
        q.awaitTermination()
        held.append(q.lastProgress.stateOperators[0].numRowsTotal)
    cols = ["window_start", "window_end", "seller_state", "deliveries", "late", "late_rate"]
    want = {tuple(r) for r in late_rate_windows(outcomes).select(cols).collect() if r.window_start.year in order[:-1]}
    assert {tuple(r) for r in read_monitor(spark, f"{run}/sink").select(cols).collect()} == want
    # state holds the open days only, not the years that went by
    assert max(held) < len(want) / 4
    compact_monitor(spark, f"{run}/sink")
    assert {tuple(r) for r in read_monitor(spark, f"{run}/sink").select(cols).collect()} == want


def test_train_score_roundtrip(spark):
    t = c.tables(spark, SF_SMALL)
    prep = c.features(spark, SF_SMALL)
    res = train_gbt(prep.features, rounds=3, depth=3)
    n_train, n_test = res.train.count(), res.test.count()
    assert n_train + n_test == prep.features.count()
    ev = evaluation_frame(res.model, res.test)
    probs = [r.p for r in ev.collect()]
    assert all(0.0 <= p <= 1.0 for p in probs)
    root = scratch_path(spark, "test-artifacts")
    save_artifacts(res.model, prep.seller_profile, geo_centroid(t.geolocation),
                   training_stats(prep.features, prep.seller_profile), root)
    art = load_artifacts(spark, root)
    scored, rejected = score_orders(open_order_records(t), art)
    rows = scored.collect()
    assert rows and all(0.0 <= r.delay_risk_probability <= 1.0 for r in rows)
    assert all(r.is_high_risk == (r.delay_risk_probability > 0.5) for r in rows)
    assert {r.reason for r in rejected.select("reason").distinct().collect()} <= {
        "no_seller_geo", "no_customer_geo"}
    assert scored.count() + rejected.count() == open_order_records(t).count()
    imp = feature_importance(spark, root).collect()
    assert 1 <= len(imp) <= 5 and all(r.mean_gain >= 0 and r.splits > 0 for r in imp)
    used = art.model.stages[-1].featureImportances.toArray()
    assert {r.feature for r in imp} == {f for f, v in zip(FEATURES, used) if v > 0}
    # a missing price or freight is scored, as in training
    holes = open_order_records(t).limit(20).withColumns({"price": F.lit(None).cast("double"), "freight_value": F.lit(None).cast("double")})
    scored, rejected = score_orders(holes, art)
    assert scored.count() + rejected.count() == 20 and scored.count() > 0


def test_monitor_append_mode_emits_closed_windows_once(spark):
    from pyspark.sql import functions as F

    from delaylens.streaming.jobs import late_rate_monitor, read_monitor

    outcomes = delivery_outcomes(spark, SF_SMALL)
    run = _run_dir(spark, "append-test")
    for _ in _arrivals(spark, run, outcomes, _years(outcomes)):
        late_rate_monitor(spark, f"{run}/incoming/*", f"{run}/sink", f"{run}/ckpt", output_mode="append").awaitTermination()
    emitted = spark.read.parquet(f"{run}/sink")
    # each window at most once
    assert emitted.groupBy("window_start", "seller_state").count().filter("count > 1").count() == 0
    batch = late_rate_windows(outcomes)
    cols = ["window_start", "seller_state", "deliveries", "late"]
    got = sorted(tuple(r) for r in read_monitor(spark, f"{run}/sink").select(cols).collect())
    want_all = {tuple(r) for r in batch.select(cols).collect()}
    assert set(got) <= want_all  # nothing emitted early or wrong
    # every window that closed before the last slice began is final and present
    last_year = outcomes.agg(F.max(F.year("delivered_at"))).first()[0]
    closed = {w for w in want_all if w[0].year < last_year}
    assert closed <= set(got) and len(got) < len(want_all)


def test_epoch_shows_both_outputs_or_neither(spark):
    from delaylens.sources.raw import file_system
    from delaylens.streaming.jobs import REJECTED, SCORED, compact_scored, read_scored, write_epoch

    sink = _run_dir(spark, "epochs")
    scored = lambda *ids: spark.createDataFrame([(i, 1, 0.5, False, "ON TRACK") for i in ids], "order_id long, seller_id long, delay_risk_probability double, is_high_risk boolean, risk_label string").select(*SCORED)
    rejected = lambda *ids: spark.createDataFrame([(i, 1, "no_seller_geo") for i in ids], "order_id long, seller_id long, reason string").select(*REJECTED)
    seen = lambda: tuple(sorted(r.order_id for r in part.collect()) for part in read_scored(spark, sink))
    assert read_scored(spark, sink) is None
    write_epoch(spark, sink, 0, scored(1, 2), rejected(3))
    assert seen() == ([1, 2], [3])
    # killed between the two writes: the second output fails after the first is there
    broken = rejected(5).withColumn("reason", F.raise_error(F.lit("executor lost")).cast("string"))
    try:
        write_epoch(spark, sink, 1, scored(4), broken)
        raise SystemExit("the write should have failed")
    except Exception as e:
        assert "executor lost" in str(e)
    fs, path = file_system(spark, f"{sink}/epochs/1")
    assert fs.exists(path) and seen() == ([1, 2], [3])
    write_epoch(spark, sink, 1, scored(4), rejected(5))  # the retry
    write_epoch(spark, sink, 1, scored(4), rejected(5))  # and one more of a published epoch
    assert seen() == ([1, 2, 4], [3, 5])
    compact_scored(spark, sink)
    assert seen() == ([1, 2, 4], [3, 5]) and not fs.exists(path)
    write_epoch(spark, sink, 2, scored(6), rejected())
    assert seen() == ([1, 2, 4, 6], [3, 5])
    compact_scored(spark, sink)
    assert seen() == ([1, 2, 4, 6], [3, 5])


def _planted(spark, n=3000):
    """A missing price means late, a missing freight means on time; the values
    themselves mean nothing."""
    i = F.col("id")
    late = (i % 10 < 3).cast("int")
    spread = lambda m: (F.pmod(F.xxhash64(i, F.lit(m)), F.lit(1000)) / 10.0).cast("double")
    absent = F.pmod(F.xxhash64(i, F.lit(9)), F.lit(10)) < 8
    return spark.range(n).select(
        i.alias("order_id"), i.alias("seller_id"), late.alias("is_late"),
        *[spread(k).alias(f) for k, f in enumerate(FEATURES) if f not in ("price", "freight_value")],
        F.when((late == 1) & absent, None).otherwise(spread(7)).alias("price"),
        F.when((late == 0) & absent, None).otherwise(spread(8)).alias("freight_value"),
    )


def test_direction_of_missing_values_is_learned(spark):
    from delaylens.operators.metrics import roc_auc
    from delaylens.operators.model import predict

    rows = _planted(spark)
    res = train_gbt(rows, rounds=5, depth=3)
    assert roc_auc(evaluation_frame(res.model, res.test)).first().roc_auc > 0.85
    probe = spark.createDataFrame(
        [("price", 50.0, 50.0, 50.0, 50.0, None), ("freight", 50.0, 50.0, 50.0, None, 50.0), ("nan", 50.0, 50.0, 50.0, 50.0, float("nan"))],
        "missing string, distance_km double, seller_late_rate double, product_weight_g double, freight_value double, price double",
    )
    got = {r.missing: r.delay_risk_probability for r in predict(res.model, probe).collect()}
    assert got["price"] > 0.8 and got["nan"] == got["price"] and got["freight"] < 0.5 < got["price"]
    # a value that no training row lacked gets the neutral one, not an end of the range
    hole = probe.withColumns({"distance_km": F.lit(None).cast("double"), "price": F.lit(50.0), "freight_value": F.lit(50.0)})
    assert all(0 <= r.delay_risk_probability <= 1 for r in predict(res.model, hole).collect())


def test_training_row_turns_red_for_a_model_of_shuffled_labels(spark):
    from delaylens.operators.model import TrainResult
    from delaylens.plans.ml import training_facts

    rows = c.features(spark, SF_SMALL).features
    good = train_gbt(rows, rounds=10, depth=4)
    assert {r.beats_rate for r in training_facts(good).collect()} == {True}
    shuffled = rows.withColumn("is_late", (F.pmod(F.xxhash64("order_id", "seller_id", "price"), F.lit(100)) < 10).cast("int"))
    bad = train_gbt(shuffled, rounds=10, depth=4)
    assert {r.beats_rate for r in training_facts(TrainResult(bad.model, good.train, good.test)).collect()} == {False}


def test_gains_are_those_of_the_stored_nodes(spark):
    """Mean gain and splits per feature, recomputed from the loaded trees."""
    import collections

    t = c.tables(spark, SF_SMALL)
    prep = c.features(spark, SF_SMALL)
    res = train_gbt(prep.features, rounds=3, depth=3)
    root = scratch_path(spark, "gain-artifacts")
    save_artifacts(res.model, prep.seller_profile, geo_centroid(t.geolocation), training_stats(prep.features, prep.seller_profile), root)
    gains = collections.defaultdict(list)
    for tree in load_artifacts(spark, root).model.stages[-1].trees:
        nodes = [tree._call_java("rootNode")]
        while nodes:
            node = nodes.pop()
            if "Internal" in node.getClass().getSimpleName():
                gains[FEATURES[node.split().featureIndex() % len(FEATURES)]].append(node.gain())
                nodes += [node.leftChild(), node.rightChild()]
    got = {r.feature: (r.mean_gain, r.splits) for r in feature_importance(spark, root).collect()}
    assert got.keys() == gains.keys() and len(got) > 2
    for f, values in gains.items():
        assert got[f][1] == len(values) and abs(got[f][0] - sum(values) / len(values)) < 1e-9


def test_cells_give_the_trees_of_all_rows(spark, monkeypatch):
    """Rows alike in all bins and label are one row with their weight; the trees are
    those that all rows in their bins give."""
    from pyspark.ml import Pipeline
    from delaylens.operators import model as m

    rows = _planted(spark).unionByName(_planted(spark))
    monkeypatch.setattr(m, "WHOLE_ROWS", 100)
    seen = []
    fit = Pipeline.fit
    monkeypatch.setattr(Pipeline, "fit", lambda self, df, *a: (seen.append(df.count()), fit(self, df, *a))[1])
    res = m.train_gbt(rows, rounds=3, depth=3)
    train = m.with_class_weight(res.train)
    matrix, bins, assembler, gbt = res.model.stages
    binned = bins.transform(matrix.transform(train))
    alike = [f + x for f in FEATURES for x in (m.BIN, m.MISSING)] + ["is_late"]
    assert seen == [binned.select(alike).distinct().count()] and seen[0] < train.count()
    assert all(len(s) <= m.BINS + 1 for s in bins.getSplitsArray())
    # only price and freight are ever missing
    assert assembler.getInputCols() == [f + m.BIN for f in FEATURES] + ["freight_value" + m.MISSING, "price" + m.MISSING]
    plain = fit(Pipeline(stages=[assembler, m.build_pipeline(3, depth=3).getStages()[-1]]), binned)
    probability = lambda df: {r.order_id: r.probability[1] for r in df.select("order_id", "probability").collect()}
    want, got = probability(plain.transform(binned)), probability(res.model.transform(train))
    assert want.keys() == got.keys() and all(abs(want[i] - got[i]) < 1e-9 for i in want)
    root = scratch_path(spark, "cell-artifacts")
    res.model.write().overwrite().save(f"{root}/model")
    assert {r.feature for r in feature_importance(spark, root).collect()} <= set(FEATURES)


def test_bins_of_few_values_are_the_values(spark):
    from delaylens.operators import model as m

    df = spark.range(1000).select(*[(F.col("id") % (3 if k else 1)).cast("double").alias(f + m.FILLED) for k, f in enumerate(FEATURES)])
    cuts = m.bin_cuts(df)
    assert cuts[FEATURES[0]] == [0.0] and all(cuts[f] == [1.0, 2.0] for f in FEATURES[1:])
