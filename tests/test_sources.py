import hashlib
import io
import json
import tarfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch import schema, sinks
from tidewatch.operators import audit
from tidewatch.operators.flows import require_binary
from tidewatch.plans import models, static_eval
from tidewatch.operators.preprocess import fit_features
from tidewatch.sources import files, flows, runs

LINE = "2016-05-01 00:03:06,4.236,165.131.105.128,42.219.156.211,56428,80,TCP,.AP.S.,0,0,5,677,{}\n"


def archive(path, text, mtime=0):
    data = text.encode()
    with tarfile.open(path, "w:gz") as tar:
        info = tarfile.TarInfo("week/export.csv")
        info.size, info.mtime = len(data), mtime
        tar.addfile(info, io.BytesIO(data))


def test_netflow_archive(spark, tmp_path):
    archive(tmp_path / "a_csv.tar.gz", "\n" + LINE.format("background") + LINE.format(" Blacklist ") + LINE.format("scan"))
    rows = flows.netflow_archives(spark, [str(tmp_path / "a_csv.tar.gz")]).orderBy("label").collect()
    assert [r.label for r in rows] == [0, 1]
    r = rows[0]
    assert (str(r.timestamp), r.flow_duration, r.protocol, r.tcp_flags) == ("2016-05-01 00:03:06", 4.236, "TCP", ".AP.S.")
    assert (r.total_packets, r.total_bytes, r.tos, r.source_file) == (5.0, 677.0, 0.0, "a_csv.tar.gz")
    assert r.packet_rate == pytest.approx(5 / 4.236) and "bytes_ratio" not in r.asDict()


@pytest.mark.parametrize("mtime", [0, 1234.5])
def test_netflow_framing(spark, tmp_path, mtime):
    """No lead line, no final newline, extended headers: still exactly the data rows."""
    lines = [LINE.format("background").replace("677", str(i)) for i in range(25)]
    archive(tmp_path / "b.tar.gz", "".join(lines).rstrip("\n"), mtime)
    got = sorted(r.total_bytes for r in flows.netflow_archives(spark, [str(tmp_path / "b.tar.gz")]).collect())
    assert got == [float(i) for i in range(25)]


def test_row_cap_counts_data_rows_per_file(spark, tmp_path):
    for name in ("a", "b"):
        archive(tmp_path / f"{name}.tar.gz", "\n" + "".join(LINE.format("background").replace("677", str(i)) for i in range(20)))
    got = flows.netflow_archives(spark, [str(tmp_path / f"{n}.tar.gz") for n in "ab"], max_rows_per_file=5)
    assert sorted(r.total_bytes for r in got.collect()) == sorted([0.0, 1.0, 2.0, 3.0, 4.0] * 2)
    with pytest.raises(FileNotFoundError):
        flows.netflow_archives(spark, [])


def test_ingest_writes_once(spark, tmp_path):
    archive(tmp_path / "a.tar.gz", "\n" + LINE.format("background") + LINE.format("blacklist"))
    flows.ingest_netflow(spark, [str(tmp_path / "a.tar.gz")], str(tmp_path / "out"), partitions=2)
    assert spark.read.parquet(str(tmp_path / "out")).where("date = '2016-05-01'").count() == 2
    with pytest.raises(Exception, match="already exists"):
        flows.ingest_netflow(spark, [str(tmp_path / "a.tar.gz")], str(tmp_path / "out"), partitions=2)


def test_bidirectional_parquet(spark, tmp_path):
    pd.DataFrame({"Stime": [1421927414, None, 1421927415], "dur": [0.0, 1.0, 2.0], "Spkts": [1, 2, 3], "Dpkts": [1, 2, 3],
                  "sbytes": [10, 20, 30], "dbytes": [10, 20, 30], "proto": ["tcp"] * 3, "Label": [1, 0, None], "junk": [1, 2, 3]}
                 ).to_parquet(tmp_path / "raw.parquet")
    got = flows.bidirectional_flows(spark, str(tmp_path / "raw.parquet")).orderBy("timestamp").toPandas()
    assert len(got) == 2 and got.label.tolist() == [1, 0] and "junk" not in got
    assert got.packet_rate.tolist() == [0.0, 3.0] and got.bytes_ratio.tolist() == pytest.approx([0.5, 0.5])
    assert flows.bidirectional_flows(spark, str(tmp_path / "raw.parquet"), max_rows=1).count() <= 1
    with pytest.raises(ValueError, match="lacks"):
        flows.map_bidirectional(spark.createDataFrame([(1,)], "stime long"))
    with pytest.raises(KeyError):
        flows.source("nope")


def test_manifest_and_dataset_kind(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name in ("train.csv", "test.csv"):
        (tmp_path / "d" / name).write_text("h\n1\n2\n3\n")
    digest = hashlib.sha256(b"h\n1\n2\n3\n").hexdigest()
    facts = files.file_facts(spark, str(tmp_path / "d"), "*.csv")

    def kind(rows):
        manifest = spark.createDataFrame(rows, "file string, expected_rows long, expected_sha256 string")
        checked = files.manifest_check(facts, manifest)
        return {r.file: r.status for r in checked.collect()}, files.dataset_kind(checked).first().kind

    assert kind([("train.csv", 3, digest), ("test.csv", 3, digest)]) == ({"train.csv": "ok", "test.csv": "ok"}, "research")
    assert kind([("train.csv", 3, digest), ("test.csv", 3, "x")])[1] == "unexpected-content"
    assert kind([("train.csv", 9, digest), ("test.csv", 3, digest)])[1] == "development-sample"
    assert kind([("train.csv", 3, digest), ("gone.csv", 3, digest)])[1] == "incomplete"
    assert kind([("gone.csv", 3, digest)]) == ({"gone.csv": "missing"}, "missing")
    assert files.existing(spark, [str(tmp_path / "d"), str(tmp_path / "none")]) == [str(tmp_path / "d")]
    (tmp_path / "cat.json").write_text(json.dumps({"datasets": [{"name": "a", "rows": 1}, {"name": "b", "rows": 2}]}))
    assert files.catalogue_record(spark, str(tmp_path / "cat.json"), "b").first().rows == 2


def static_frame(n, seed):
    row = {c: [i % 7 for i in range(n)] for c in schema.STATIC_COLUMNS}
    row.update(proto=[" tcp ", "udp"] * (n // 2), service=["dns"] * n, state=["FIN", None] * (n // 2), attack_cat=["x"] * n,
               label=[(i * seed) % 2 for i in range(n)], dur=[(i * seed) % 2 + 0.1 * (i % 3) for i in range(n)])
    return pd.DataFrame(row)


def test_static_release(spark, tmp_path):
    assert len(schema.STATIC_COLUMNS) == 45 and len(schema.FULL_FEATURES) == 37 and len(schema.RESTRICTED_FEATURES) == 17
    for name, seed in (("train", 1), ("test", 3)):
        static_frame(60, seed).to_csv(tmp_path / f"{name}.csv", index=False)
    train, test = (flows.static_table(spark, str(tmp_path / f"{n}.csv")) for n in ("train", "test"))
    grid = static_eval.evaluate_grid(train, test, ["majority", "logistic_regression"], params={"logistic_regression": {"max_iter": 10}}).toPandas()
    assert len(grid) == 4 and grid[grid.model == "logistic_regression"].f1_score.min() > 0.9
    rows, numeric, categorical = static_eval.prepare_static(train, "FULL_METADATA")
    assert set(categorical) == {"proto", "service", "state"} and rows.select("proto").distinct().count() == 2
    checks = static_eval.validate_table(train)
    assert checks["schema"].isEmpty() and checks["target"].where("status <> 'ok'").isEmpty()
    with pytest.raises(ValueError, match="missing values"):
        require_binary(train.withColumn("label", F.lit(None).cast("int")))
    with pytest.raises(ValueError, match="other than"):
        require_binary(train.withColumn("label", F.lit(4)))


def test_sinks(spark, tmp_path):
    df = spark.range(10).select((F.col("id") % 2).cast("int").alias("label"), F.col("id").cast("double").alias("a"), F.lit("m").alias("model"), F.lit("forward").alias("period"))
    root = str(tmp_path)
    path = sinks.write_predictions(df, root, "r1")
    assert spark.read.parquet(path).where("model = 'm' AND period = 'forward'").count() == 10
    with pytest.raises(Exception, match="already exists"):
        sinks.write_predictions(df, root, "r1")
    sinks.write_table(df, root, "r1", "rows.csv", form="csv")
    doc = sinks.write_document(spark.sql("SELECT 1 AS a, 2 AS _b, 3 AS model_object"), root, "r1", "doc.json")
    assert spark.read.json(doc).columns == ["a"]
    kept = spark.sql("SELECT map('a', 1, '_b', 2, 'c_object', 3) AS m").select(sinks.public_map("m").alias("m")).first().m
    assert kept == {"a": 1}
    fitted = fit_features(df, ["a"])
    features = sinks.write_features(fitted.vectors(df).select("features", "label"), root + "/features")
    assert spark.read.parquet(features).schema["features"].metadata["feature_names"] == ["a"]
    back = sinks.read_features(spark, features)
    assert [r.features for r in back.orderBy("features").collect()] == [r.features for r in fitted.vectors(df).orderBy("features").collect()]
    fitted.save(spark, root + "/fitted")
    assert type(fitted).load(spark, root + "/fitted") == fitted
    model = models.fit_model("logistic_regression", df, fitted, {"max_iter": 5})
    sinks.save_model(model.model, root + "/model")
    loaded = sinks.load_model(root + "/model")
    vectors = fitted.vectors(df, "_features")
    assert [r.prediction for r in loaded.transform(vectors).collect()] == [r.prediction for r in model.model.transform(vectors).collect()]


def run_folder(root, run, broken=False):
    folder = root / run
    folder.mkdir(parents=True)
    rates = dict(precision=.5, recall=.5, f1=.5, false_positive_rate=.1, balanced_accuracy=.7, roc_auc=.6, pr_auc=.5, rows=10)
    model = {"model": "majority", "result": {"model": "majority", "threshold": 0.4, "backtest": rates,
             "forward": {**rates, "f1": float("nan") if broken else .5}, "f1_degradation": 0.0},
             "adaptation": {"strategies": [{"strategy": "none", "threshold": 0.4, "metrics": rates, "recovery": {"f1_gain": 0.0}}]}}
    split = {f"{p}_period": [f"2024-0{i}-01", f"2024-0{i}-20"] for i, p in enumerate(("train", "validation", "backtest"), 1)}
    split["forward_period"] = {"start": "2024-03-10" if broken else "2024-04-01", "end": "2024-04-20"}
    split.update({f"{p}_count": {"rows": 5} for p in ("train", "validation", "backtest", "forward")}, rows_total=20)
    (folder / "metrics.json").write_text(json.dumps({"dataset": "d", "models": [model], "split": split, "drift_summary": {"alerts": 1}}))
    (folder / "metadata.json").write_text(json.dumps({
        "experiment_id": run, "git_commit": None if broken else "abc", "dataset": "d", "random_seed": 42, "feature_schema_hash": "h",
        "package_versions": {p: "1" for p in audit.REQUIRED_PACKAGES}, "temporal_split": split}))


def test_run_folder_audit(spark, tmp_path):
    run_folder(tmp_path, "1_temporal_a")
    run_folder(tmp_path, "2_temporal_b", broken=True)
    root = str(tmp_path)
    docs = runs.documents(spark, root, "metrics.json", runs.RUN_METRICS)
    meta = runs.documents(spark, root, "metadata.json", runs.RUN_METADATA)
    drift_rows = spark.createDataFrame([("1_temporal_a", 4), ("2_temporal_b", 4)], "run string, n long")
    found = audit.temporal_problems(meta, runs.model_rows(docs), runs.strategy_rows(docs), drift_rows).collect()
    assert {r.run for r in found} == {"2_temporal_b"}
    assert any("git_commit" in r.problem for r in found) and any("not a finite number" in r.problem for r in found)
    strict = audit.temporal_problems(meta, runs.model_rows(docs), runs.strategy_rows(docs), drift_rows, strict=True)
    assert strict.where("problem LIKE 'required model missing%'").count() == 6
    overlaps = audit.period_problems(runs.period_rows(docs)).collect()
    assert [(r.run, r.period) for r in overlaps] == [("2_temporal_b", "forward")]
    assert audit.bad_numbers(docs.select("run", "models"), ["run"]).count() == 1
    kinds = {r.run: r.kind for r in runs.run_list(meta).collect()}
    assert kinds == {"1_temporal_a": "temporal", "2_temporal_b": "temporal"}
    assert runs.texts(spark, root).where("text LIKE '%NaN%'").count() == 1
    assert audit.reproduction_errors(runs.strategy_rows(docs), runs.model_rows(docs)).where("run = '1_temporal_a'").isEmpty()


def test_checksums_of_files_of_any_size(spark, tmp_path):
    """A file of 3 GB (sparse, so it takes no disk), an empty one that Spark does not list, and names that a URI has to escape."""
    folder = tmp_path / "d"
    folder.mkdir()
    contents = {"a b+c%20d.bin": b"plain", "empty.bin": b"", "\u00e9.bin": b"x" * 100_000}
    for name, data in contents.items():
        (folder / name).write_bytes(data)
    with (folder / "large.bin").open("wb") as f:
        f.write(b"head")
        f.truncate(3 << 30)
    want = hashlib.sha256(b"head")
    block = bytes(1 << 20)
    for i in range(3 << 10):
        want.update(block[:-4] if i == 0 else block)
    got = {r.file: r for r in files.file_hashes(spark, str(folder)).collect()}
    assert got["large.bin"].sha256 == want.hexdigest() and got["large.bin"].length == 3 << 30
    assert {n: r.sha256 for n, r in got.items() if n != "large.bin"} == {n: hashlib.sha256(d).hexdigest() for n, d in contents.items() if d}
