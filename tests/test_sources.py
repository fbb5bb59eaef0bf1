import pytest

from tidewatch.functions.fixed import FEATURES_V3
from tidewatch.operators import clean, features, training
from tidewatch.sources import events, flow_csv

HEADER = " Destination Port, Flow Duration, Total Fwd Packets, Total Backward Packets,Flow IAT Mean, Fwd Header Length, Fwd Header Length, label \n"


def test_padded_and_repeated_headers(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text(HEADER + "80,-1,0,0,Infinity,1,2, PortScan \n80,5000000,3,2,NaN,1,2,BENIGN\n80,5000000,3,2,NaN,1,2,BENIGN\n80,100,3,2,7,1,2,Bot\n443,0,1,0,,1,2,DoS Hulk\n")
    df = flow_csv.read_labelled(spark, str(f))
    assert {"dest_port", "duration", "total_fwd_packets", "Label"} <= set(df.columns)
    rows = clean.clean(features.train_v3(df), FEATURES_V3).collect()
    assert sorted(r["Label"] for r in rows) == ["Benign", "DoS", "PortScan"]
    assert all(r["flow_iat_mean"] is None or r["flow_iat_mean"] == r["flow_iat_mean"] for r in rows)
    by = {r["Label"]: r for r in rows}
    assert by["DoS"]["flow_packets_per_sec"] == 1e6 and by["Benign"]["is_long_connection"] == 1.0 and by["PortScan"]["n_flushes"] == 1.0


def test_missing_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Flow Duration,Total Fwd Packets\n1,2\n")
    with pytest.raises(KeyError, match="Label"):
        flow_csv.read_labelled(spark, str(tmp_path / "a.csv"))
    (tmp_path / "b.csv").write_text("Flow Duration,Label\n1,BENIGN\n")
    with pytest.raises(KeyError, match="total_fwd_packets"):
        flow_csv.read_labelled(spark, str(tmp_path / "b.csv"))


def test_folder_union_skips_files_without_label(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Flow Duration,Label\n1,BENIGN\n")
    (tmp_path / "b.csv").write_text("Flow Duration\n1\n")
    (tmp_path / "c.csv").write_text(" Total Fwd Packets, Label\n5,DDoS\n")
    df = flow_csv.read_folder(spark, str(tmp_path))
    assert sorted((r["duration"] or 0, r["total_fwd_packets"] or 0, r["Label"]) for r in df.collect()) == [(0, 5, "DDoS"), (1, 0, "BENIGN")]
    assert flow_csv.task_paths(spark, str(tmp_path), {"DoS": "a.csv", "PortScan": "none.csv"}).keys() == {"DoS"}


def test_files_of_equal_headers_share_a_reader(spark, tmp_path):
    for k in range(4):
        (tmp_path / f"{k}.csv").write_text(" Flow Duration,Flow Bytes/s, Label\n" + "".join(f"{k}{i},Infinity,BENIGN\n x,NaN,DDoS\n" for i in range(3)))
    (tmp_path / "other.csv").write_text("Label,Flow Duration\nDDoS,7.5\n")
    (tmp_path / "empty.csv").write_text("")
    df = flow_csv.read_folder(spark, str(tmp_path))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("Relation") == 2 and dict(df.dtypes)["duration"] == "double"
    rows = df.collect()
    assert len(rows) == 25 and sorted(r["duration"] for r in rows if r["duration"] is not None) == sorted([float(f"{k}{i}") for k in range(4) for i in range(3)] + [7.5])
    assert sum(r["flow_bytes_per_sec"] == float("inf") for r in rows) == 12


def test_lines(spark, tmp_path):
    (tmp_path / "x.json").write_text("a\nb\n")
    assert events.read_lines(spark, str(tmp_path)).count() == 2
    assert events.stream_lines(spark, str(tmp_path)).isStreaming


def test_training_saves_and_loads(spark, tmp_path):
    rows = spark.range(600).selectExpr("id % 7 as dest_port", "(id % 3) * 1000 as duration", "case when id % 3 = 0 then 90 else id % 5 end as total_fwd_packets", "id % 4 as total_bwd_packets", "id as flow_iat_mean", "case when id % 3 = 0 then 'DoS' else 'Benign' end as Label")
    quick = training.Settings(forest_trees=3, forest_depth=3, folds=2, grid={"maxDepth": [2], "maxIter": [3]})
    names = ["dest_port", "duration", "total_fwd_packets"]
    task = training.train_task(rows, "DoS", names, quick)
    assert {r["model"]: r["test_f1"] for r in task.metrics.collect()}["xgb"] > 0.95
    task.save(str(tmp_path / "task"), spark)
    again = training.Task.load(str(tmp_path / "task"), spark)
    one, two = (t.score(rows.limit(20)).orderBy("flow_iat_mean").select("DoS_dt", "DoS_rf", "DoS_xgb").collect() for t in (task, again))
    assert one == two and again.threshold == task.threshold and again.features == names
