import numpy as np
from pyspark.sql import functions as F

from wardline.config import CLASSES
from wardline.operators.evaluate import confusion_matrix
from wardline.operators.ranks import auc, percentile_rank, quantiles
from wardline.operators.scoring import blend_cold_start, gate_classes, top_class
from wardline.functions.scalars import unified_score
from wardline.operators.splits import leaking_sessions, session_split, three_way_split
from wardline.operators.reference import by_grids, score_grids
from wardline.sources.events import access_events


def test_percentile(spark):
    df = spark.createDataFrame([(float(x), True) for x in (1, 2, 2, 3, 10)] + [
        (x, False) for x in (0.0, 1.0, 2.0, 2.5, 10.0, 11.0)], "s double, ref boolean")
    got = percentile_rank(df, "s", "p", F.col("ref")).where("not ref").orderBy("s").collect()
    assert [r["p"] for r in got] == [0, 20, 60, 60, 100, 100]


def _skewed(spark):
    rng = np.random.default_rng(3)
    xs = np.concatenate([np.round(rng.lognormal(0, 2, 700), 3), np.full(350, 1.5)])
    return xs, spark.createDataFrame([(float(x), bool(i % 3 == 0), "ab"[i % 2]) for i, x in enumerate(xs)],
                                     "s double, pos boolean, g string")


def test_bins_give_the_same_as_one_sort(spark):
    xs, df = _skewed(spark)
    whole = {r["s"]: r["p"] for r in percentile_rank(df, "s", "p", F.col("pos")).collect()}
    parts = {r["s"]: r["p"] for r in percentile_rank(df, "s", "p", F.col("pos"), max_rows=10).collect()}
    assert whole == parts
    pos = np.array([i % 3 == 0 for i in range(len(xs))])
    a, b = xs[pos], xs[~pos]
    want = ((a[:, None] > b).sum() + 0.5 * (a[:, None] == b).sum()) / (len(a) * len(b))
    for limit in (10, 10_000):
        assert abs(auc(df, "s", F.col("pos"), max_rows=limit).first()[0] - want) < 1e-12
        got = {r["g"]: (r["m"], r["hi"]) for r in quantiles(df, "s", {"m": 0.5, "hi": 0.95}, ["g"], max_rows=limit).collect()}
        for i, g in enumerate("ab"):
            assert np.allclose(got[g], np.percentile(xs[i::2], [50, 95]))


def test_blend_and_merge(spark):
    df = spark.createDataFrame([("a", 90.0, 0.2), ("new", 90.0, 0.2)], "dept string, ensemble_score_raw double, cold_start_blend_weight double")
    ref = spark.createDataFrame([("a", 50.0), ("__global__", 40.0)], "dept string, ref_score double")
    got = {r["dept"]: r["final_risk_score"] for r in blend_cold_start(df, ref).collect()}
    assert got == {"a": 58.0, "new": 50.0}
    row = spark.createDataFrame([(80.0, 60.0)], "a double, b double").select(
        unified_score(F.col("a"), F.col("b"), "mean"), unified_score(F.col("a"), F.col("b"), "max")).first()
    assert tuple(row) == (70.0, 80.0)


def test_gate(spark):
    probs = {"brute_force": .6, "lateral_movement": .3, "normal": .1}
    p = [probs.get(c, 0.0) for c in CLASSES]
    q = [0.2 if c == "normal" else 0.16 for c in CLASSES]
    df = spark.createDataFrame([(1, p, 0, 0), (2, p, 1, 0), (3, q, 0, 0)],
                               "id int, probs array<double>, failure_burst_count int, fingerprint_mismatch int")
    got = [(r["pred_label"], round(r["confidence"], 6), round(r["attack_prob"], 6))
           for r in gate_classes(df).orderBy("id").collect()]
    assert got == [("lateral_movement", .3, .9), ("brute_force", .6, .9), ("normal", .2, .8)]


def test_gate_never_lets_a_forbidden_class_through(spark):
    rng = np.random.default_rng(0)
    rows = [([float(x) for x in rng.dirichlet(np.ones(6))], int(rng.integers(2)), int(rng.integers(2))) for _ in range(500)]
    out = gate_classes(spark.createDataFrame(rows, "probs array<double>, failure_burst_count int, fingerprint_mismatch int"))
    assert out.where("(pred_label = 'brute_force' and failure_burst_count = 0) or "
                     "(pred_label = 'device_spoofing' and fingerprint_mismatch = 0)").isEmpty()


def test_gate_of_ties_and_nulls_without_interpreted_lambdas(spark):
    """Ties go to class order, a null probability comes first in the gate and last in the top class, a short array has the
    classes it holds; the plan has no array function with a lambda."""
    n = len(CLASSES)
    normal, brute = CLASSES.index("normal"), CLASSES.index("brute_force")
    one = [0.0] * n
    rows = [(1, [0.5] * n, 1, 1), (2, [0.5] * n, 0, 0), (3, None, 1, 1), (4, [0.9 if i == brute else 0.1 for i in range(n)], None, 0),
            (5, [None if i == normal else 0.3 for i in range(n)], 0, 0), (6, one[:-1] + [0.4], 0, 0), (7, [0.2, 0.2], 0, 0)]
    df = spark.createDataFrame(rows, "id int, probs array<double>, failure_burst_count int, fingerprint_mismatch int")
    out = top_class(df.where("id < 7"))
    out = gate_classes(out)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan
    for r in out.collect():
        if r["probs"] is None:
            assert r["pred_label"] is None and r["raw_label"] is None
            continue
        ok = [(r["failure_burst_count"] or 0) >= 1 if c == "brute_force" else (r["fingerprint_mismatch"] or 0) >= 1
              if c == "device_spoofing" else True for c in CLASSES]
        order = sorted((i for i in range(n) if ok[i]), key=lambda i: (r["probs"][i] is not None, -(r["probs"][i] or 0), i))
        assert r["pred_label"] == CLASSES[order[0]]
        assert r["raw_label"] == CLASSES[max(range(n), key=lambda i: (r["probs"][i] is not None, r["probs"][i] or 0, -i))]
    short = top_class(df.where("id = 7")).first()
    assert short["raw_label"] == CLASSES[0] and short["raw_confidence"] == 0.2


def test_splits_keep_sessions_whole(spark, sf_dir):
    events = access_events(spark, sf_dir)
    df = three_way_split(events)
    assert df.count() == events.count() and leaking_sessions(df).isEmpty()
    one = {r["attack_id"]: r["clf_split"] for r in session_split(events).collect()}
    many = {r["attack_id"]: r["clf_split"] for r in session_split(events, max_rows=5).collect()}
    assert one == many


def test_confusion_matrix_has_all_classes(spark):
    df = spark.createDataFrame([("normal", "normal"), ("brute_force", "normal")], "target string, pred_label string")
    rows = {r["true_class"]: r for r in confusion_matrix(df).collect()}
    assert set(rows) == set(CLASSES) and rows["brute_force"]["pred_normal"] == 1
    assert rows["lateral_movement"]["pred_lateral_movement"] == 0


def test_scores_against_stored_grids(spark):
    """Equal to a plain count over the reference rows; ties, nulls, values outside and an empty reference."""
    ref = [1.0, 2.0, 2.0, 2.0, 5.0, 7.0, 7.5]
    asked = [0.5, 1.0, 1.9, 2.0, 6.0, 7.5, 99.0, None]
    reference = spark.createDataFrame([(x, -x) for x in ref] + [(None, None)], "iso_raw double, ae_raw double")
    rows = spark.createDataFrame([(i, x, None if x is None else -x) for i, x in enumerate(asked)], "i int, iso_raw double, ae_raw double")
    got = by_grids(rows, score_grids(reference)).orderBy("i").collect()

    def share(x, values):
        return None if x is None else round(100 * sum(v <= x for v in values) / len(values) + 1e-9, 2)

    assert [r["iso_forest_score"] for r in got] == [share(x, ref) for x in asked]
    assert [r["autoencoder_score"] for r in got] == [share(None if x is None else -x, [-v for v in ref]) for x in asked]
    assert got[-1]["ensemble_score_raw"] is None
    none = by_grids(rows, score_grids(reference.limit(0))).orderBy("i").collect()
    assert [r["iso_forest_score"] for r in none] == [0.0] * 7 + [None]
