import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidewatch.operators import preprocess, realized, shifts
from tidewatch.operators.split import TemporalLeakageError
from tidewatch.plans.models import fit_model
from tidewatch.schema import FeaturePolicyError, flow_features, select_feature_set, split_by_type, without_groups
from tidewatch.sources import views

FOLDER = "/root/testdata/sf0.001"
KEY = ["event_id"]


@pytest.fixture(scope="module")
def flows(spark):
    return views.events_common(spark, FOLDER).cache()


@pytest.mark.parametrize("kind,magnitude", shifts.catalogue())
def test_shift_invariants(flows, kind, magnitude):
    once = shifts.apply_shift(flows, kind, magnitude, KEY)
    again = shifts.apply_shift(flows.repartition(5), kind, magnitude, KEY)
    assert once.exceptAll(again).isEmpty() and again.exceptAll(once).isEmpty()
    kept = once.join(flows.select("event_id", F.col("label").alias("l0"), F.col("timestamp").alias("t0")), "event_id")
    assert kept.where("label <> l0 OR timestamp <> t0").isEmpty()
    if kind != "class_prevalence":
        assert once.count() == flows.count()


def test_unit_factor_changes_nothing(flows):
    for kind in ("duration", "packet_rate", "byte_rate", "iat"):
        same = shifts.apply_shift(flows, kind, 1.0, KEY)
        assert same.select("event_id", "packet_rate", "byte_rate").exceptAll(flows.select("event_id", "packet_rate", "byte_rate")).isEmpty()


def test_prevalence_hits_its_target(flows):
    for target in (0.05, 0.30):
        rate = shifts.apply_shift(flows, "class_prevalence", target, KEY).agg(F.avg("label")).first()[0]
        assert rate == pytest.approx(target, abs=0.002)
    assert shifts.prevalence_quota(10, 90, 0.5) == (10, 10)
    with pytest.raises(ValueError):
        shifts.apply_shift(flows.where("label = 0"), "class_prevalence", 0.3, KEY)
    with pytest.raises(ValueError):
        shifts.prevalence_quota(5, 5, 1.5)
    with pytest.raises(ValueError):
        shifts.apply_shift(flows, "nope", 1.0, KEY)
    with pytest.raises(ValueError):
        shifts.apply_shift(flows.where("protocol = 'TCP'"), "protocol_mixture", 3.0, KEY)
    with pytest.raises(KeyError):
        shifts.apply_shift(flows.drop("protocol"), "protocol_mixture", 3.0, KEY)


def test_realized_effect(flows):
    longer = shifts.apply_shift(flows, "duration", 3.0, KEY)
    rates = realized.class_rates(flows, longer)
    moved = realized.verdict(realized.numeric_moves(flows, longer, ["flow_duration"]), None, rates).first()
    assert moved.verified and moved.max_abs_cohens_d > 0.5
    still = realized.verdict(realized.numeric_moves(flows, flows, ["flow_duration"]), None, realized.class_rates(flows, flows)).first()
    assert not still.verified
    dropped = realized.verdict(realized.numeric_moves(flows, flows, ["flow_duration"]), None, rates, dropped=["tos"]).first()
    assert dropped.verified and dropped.columns_removed == ["tos"]
    mix = shifts.apply_shift(flows, "protocol_mixture", 3.0, KEY)
    assert realized.mixture_distance(flows, mix, "protocol").first().tvd > 0.1


def test_feature_fit_is_training_only(flows):
    fitted = preprocess.fit_features(flows, ["flow_duration", "total_packets"], ["protocol"])
    assert fitted.names[:2] == ["flow_duration", "total_packets"] and fitted.names[2] == "protocol=ICMP"
    assert set(fitted.provenance()) == {"numeric_features", "categorical_features", "scaler_mean", "categories"}
    unseen = fitted.wide(flows.withColumn("protocol", F.lit("SCTP")).limit(3)).first()
    assert list(unseen[2:]) == [0.0, 0.0, 0.0]
    constant = preprocess.fit_features(flows.withColumn("flow_duration", F.lit(3.0)), ["flow_duration"])
    assert constant.wide(flows.limit(1).withColumn("flow_duration", F.lit(4.0))).first()[0] == 1.0
    with pytest.raises(TemporalLeakageError):
        preprocess.fit_features(flows, ["flow_duration"], cutoff="2024-01-02 00:00:00")
    with pytest.raises(FeaturePolicyError):
        preprocess.fit_features(flows, ["label"])
    vectors = fitted.vectors(flows.limit(2))
    assert vectors.schema["features"].metadata["feature_names"] == fitted.names and vectors.columns == [*flows.columns, "features"]
    same = fitted.vectors(flows, "f").select("event_id", vector_to_array("f").alias("f")).join(fitted.wide(flows, ["event_id"]), "event_id").limit(50).toPandas()
    assert np.allclose(np.stack(same.f), same[fitted.names])


def test_a_category_of_many_levels(spark):
    """10,001 levels with nulls and unseen ones fit, score and give the same vectors as single comparisons would."""
    rng = np.random.default_rng(4)
    level = np.r_[np.arange(10_001), rng.integers(0, 10_001, 9_999)]
    pdf = pd.DataFrame({"id": np.arange(20_000), "label": (level % 2).astype(int), "amount": rng.normal(0, 1, 20_000), "host": [f"h{i:05d}" for i in level]})
    df = spark.createDataFrame(pdf)
    fitted = preprocess.fit_features(df, ["amount"], ["host"])
    assert len(fitted.names) == 10_002 and fitted.names[1] == "host=h00000"
    rows = spark.createDataFrame([(1, 0.0, "h00000"), (2, 0.0, "h10000"), (3, 0.0, "unseen"), (4, 0.0, None)], "id int, amount double, host string")
    places = {r.id: sorted(int(i) for i in r.features.indices) for r in fitted.vectors(rows).collect()}
    assert {k: [i for i in v if i] for k, v in places.items()} == {1: [1], 2: [10_001], 3: [], 4: []}
    model = fit_model("logistic_regression", df, fitted, {"max_iter": 10})
    scored = model.score(df).toPandas()
    assert ((scored.y_score > 0.5) == scored.label).mean() > 0.95


def test_feature_lists(flows):
    assert flow_features(flows, "number")[0] == "flow_duration" and "protocol" not in flow_features(flows, "number")
    assert without_groups(["flow_duration", "total_bytes"], ["timing"]) == ["total_bytes"]
    with pytest.raises(KeyError):
        without_groups([], ["nope"])
    with pytest.raises(FeaturePolicyError):
        select_feature_set(flows, "S", {"S": ["label"]})
    with pytest.raises(ValueError):
        select_feature_set(flows, "T", {"S": ["a"]})
    assert split_by_type(flows.select("protocol", "total_bytes")) == (["total_bytes"], ["protocol"])


def test_mixture_of_many_protocols(spark):
    df = spark.sql("SELECT id, concat('p', id % 300) AS protocol, 1 AS label FROM range(30000)")
    got = {r[0]: r[1] for r in shifts.apply_shift(df, "protocol_mixture", 30.0, ["id"]).groupBy("protocol").count().collect()}
    assert sum(got.values()) == 30_000 and len(got) == 300
    assert abs(got["p0"] - 30_000 * 30 / 329) < 300 and max(n for p, n in got.items() if p != "p0") < 160
