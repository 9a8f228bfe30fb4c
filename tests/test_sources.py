"""Adapters on small files of each shape."""

import json

import numpy as np
import pytest

from tidemark.operators import label_rules
from tidemark.schema import CATALOG
from tidemark.sources import raw


def put(folder, **files):
    for name, text in files.items():
        target = folder / name.replace("__", "/").replace("_DOT_", ".")
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)
    return str(folder)


def labels(cells, channel=0):
    return [r["label"] for r in cells.where(f"channel = {channel}").orderBy("series_id", "row_idx").collect()]


def test_wide_rows(spark, tmp_path):
    path = put(tmp_path, valve1__0_DOT_csv="datetime;P;T;anomaly;changepoint\n2020-01-01 00:00:02;1.5;2;1;0\n2020-01-01 00:00:01;1;2;0;0\n2020-01-01 00:00:03;NaN;4;;0\n")
    cells, catalog = raw.LOADERS["skab"](spark, path)
    assert labels(cells) == [0, 1, 0] and [r["value"] for r in cells.where("channel = 0").orderBy("row_idx").collect()] == [1.0, 1.5, None]
    row = catalog.first()
    assert (row["series_id"], row["n_rows"], row["n_channels"], row["step_s"], row["benchmark"], row["channel_names"]) == ("valve1/0", 3, 2, 1.0, "SKAB benchmark", "P|T")
    assert row["anomaly_row_ratio"] == pytest.approx(1 / 3) and not row["unlabeled"] and row["label_confidence"] == 1.0
    assert (row["license"], row["file"]) == ("AGPL-3.0", "source=skab") and catalog.columns == [c.split()[0] for c in CATALOG.split(", ")]


def test_farms_with_event_windows(spark, tmp_path):
    lines = ["time_stamp;id;status_type_id;a_avg;b_avg;c_std"] + [f"2020-01-01 00:{i:02}:00;{i};{i % 4};{i};5;{i}" for i in range(8)]
    info = "event_id;event_label;event_start_id;event_end_id\n7;anomaly;5;6\n8;normal;0;7\n"
    for name, text in {"datasets/7.csv": "\n".join(lines), "datasets/8.csv": "\n".join(lines), "event_info.csv": info}.items():
        target = tmp_path / "Wind Farm B" / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)
    cells, catalog = raw.LOADERS["care"](spark, str(tmp_path))
    assert labels(cells) == [0, -1, 0, -1, 0, 1, 1, -1] + [0, -1] * 4
    rows = {r["series_id"]: r for r in catalog.collect()}
    assert set(rows) == {"farmB/event7", "farmB/event8"} and rows["farmB/event7"]["channel_names"] == "a_avg" and rows["farmB/event8"]["label_confidence"] == 0.3
    with pytest.raises(ValueError):
        raw.LOADERS["care_c"](spark, str(tmp_path))


def test_turbines_with_status_logs(spark, tmp_path):
    stamp = lambda i: f"2021-01-{1 + i // 144:02} {i // 6 % 24:02}:{i % 6 * 10:02}:00"
    data = ["# note"] * 9 + ['# Date and time,Wind speed (m/s),"Wind speed, Maximum (m/s)",Lost Production to Downtime (kWh)'] + [f"{stamp(i)},{i % 7},{i},{i}" for i in range(1000)]
    head = "Timestamp start,Timestamp end,Duration,Status,Code,Message,Comment,Service contract category,IEC category"
    states = [f"{stamp(10)},{stamp(12)},x,Stop,1,m,,,Forced outage", "2021-01-01 05:05:00,2021-01-01 05:06:00,x,Communication,1,m,,,", f"{stamp(40)},{stamp(41)},x,Warning,1,m,,error,", f"{stamp(998)},-,x,Stop,1,m,,Safety chain (1),"]
    put(tmp_path, **{"Turbine_Data_Kelmarsh_3_2021-01-01_-_x.csv": "\n".join(data), "Status_Kelmarsh_3_2021-01-01_-_x.csv": "\n".join(["# note"] * 9 + [head, *states]), "Turbine_Data_Kelmarsh_4_2021-01-01_-_x.csv": "\n".join(data)})
    cells, catalog = raw.LOADERS["kelmarsh"](spark, str(tmp_path))
    row = catalog.collect()
    assert [(r["series_id"], r["channel_names"], r["label_confidence"], r["label_quality"]) for r in row] == [("wt03/2021", "Wind speed (m/s)", 0.5, "log")]
    got = labels(cells)
    assert {i: x for i, x in enumerate(got) if x} == {9: 1, 10: 1, 11: 1, 12: 1, 30: -1, 997: 1, 998: 1, 999: 1} and len(got) == 1000


def test_water_network(spark, tmp_path):
    stamps = [f"2018-01-01 00:{5 * i:02}:00" for i in range(10)]
    sheet = lambda name, f: f"Timestamp;{name}\n" + "\n".join(f"{t};{f(i)}" for i, t in enumerate(stamps))
    put(tmp_path, **{"2018_SCADA_Pressures.csv": sheet("n1", lambda i: f"{i},5"), "2018_SCADA_Flows.csv": sheet("p1", lambda i: f"2,{i}"), "2018_SCADA_Levels.csv": sheet("t1", lambda i: "1"), "2018_Leakages.csv": sheet("l1;l2", lambda i: f"{'4,5' if i > 6 else '0,0'};{'1,0' if i > 7 else '0'}")})
    cells, catalog = raw.LOADERS["battledim"](spark, str(tmp_path))
    assert labels(cells) == [0] * 7 + [1] * 3 and catalog.first()["channel_names"] == "n1|p1|t1" and catalog.first()["label_quality"] == "onset"
    assert [r["value"] for r in cells.where("row_idx = 3").orderBy("channel").collect()] == [3.5, 2.3, 1.0]


def test_wells_and_held_out_groups(spark, tmp_path):
    import pandas as pd

    for folder, well in [("1", w) for w in range(1, 6)] + [("7", 1)]:
        n, start = 400, 300
        frame = pd.DataFrame({"timestamp": pd.date_range("2020-01-01", periods=n, freq="s"), "P": np.arange(n) % 9.0, "class": [0.0] * start + [float(folder)] * (n - start - 1) + [np.nan]})
        (tmp_path / folder).mkdir(exist_ok=True)
        frame.astype({"timestamp": "datetime64[us]"}).to_parquet(tmp_path / folder / f"WELL-{well:05}_x.parquet")
    (tmp_path / "1" / "SIMULATED_1.parquet").write_bytes((tmp_path / "1" / "WELL-00001_x.parquet").read_bytes())
    parts = {n: raw.LOADERS[n](spark, str(tmp_path)) for n in ("w3", "w3_val")}
    wells = {n: {r["series_id"].split("/")[1] for r in c.collect()} for n, (_, c) in parts.items()}
    assert len(wells["w3_val"]) == 1 and len(wells["w3"]) == 4 and not wells["w3"] & wells["w3_val"]
    assert {r["source"] for r in parts["w3_val"][1].collect()} == {"w3_val"} and {r["sector"] for r in parts["w3"][1].collect()} == {"oil_gas"}
    got = {}
    for cells, _ in parts.values():
        for r in cells.orderBy("row_idx").collect():
            got.setdefault(r["series_id"], []).append(r["label"])
    assert len(got) == 6 and got["1/WELL-00003_x"] == [0] * 300 + [1] * 99 + [-1] and got["7/WELL-00001_x"] == [0] * 300 + [-1] * 100


def test_buildings_with_enough_readings(spark, tmp_path):
    stamp = lambda i: f"2016-01-{1 + i // 24:02} {i % 24:02}:00:00"
    lines = [f"{b},{stamp(i)},{'' if b == 1 and i >= 499 else i},0" for b in (1, 2, 3) for i in range(510)]
    path = put(tmp_path, x_DOT_csv="building_id,timestamp,meter_reading,anomaly\n" + "\n".join(lines))
    found = [r["series_id"] for n in ("lead", "lead_val") for r in raw.LOADERS[n](spark, path)[1].collect()]
    assert sorted(found) == ["2", "3"]


def test_windows_json(spark, tmp_path):
    path = put(tmp_path, real__x_DOT_csv="timestamp,value\n" + "\n".join(f"2020-01-01 00:0{i}:00,{i}" for i in range(6)), combined_windows_DOT_json=json.dumps({"real/x.csv": [["2020-01-01 00:02:00", "2020-01-01 00:03:00"]], "real/y.csv": []}))
    assert labels(raw.LOADERS["nab"](spark, path)[0]) == [0, 0, 1, 1, 0, 0]


def test_interval_in_file_name(spark, tmp_path):
    assert labels(raw.LOADERS["ucr"](spark, put(tmp_path, **{"001_U_x_2_4_5_DOT_txt": "\n".join(map(str, range(7)))}))[0]) == [-1, -1, 0, 0, 1, 1, 0]


def test_interpretation_lines(spark, tmp_path):
    path = put(tmp_path, **{"test__m_DOT_txt": "1,2\n3,4\n5,6\n7,8", "test_label__m_DOT_txt": "0\n1\n1\n0", "interpretation_label__m_DOT_txt": "1-1:2"})
    cells, _ = raw.LOADERS["smd"](spark, path)
    assert labels(cells, 0) == [0, 0, 1, 0] and labels(cells, 1) == [0, 1, 1, 0]


def test_long_rows_and_run_to_failure(spark, tmp_path):
    cells, _ = raw.LOADERS["skab_teaser"](spark, put(tmp_path / "a", x_DOT_csv="datetime;id;value\n2020-01-01 00:00:00;p;1\n2020-01-01 00:00:00;p;3\n2020-01-01 00:00:01;q;5\n"))
    assert [r["value"] for r in cells.orderBy("row_idx", "channel").collect()] == [2.0, None, None, 5.0]
    lines = "\n".join(f"1 {c} 0.5 {c * 2} " for c in range(1, 31))
    cells, catalog = raw.LOADERS["cmapss"](spark, put(tmp_path / "b", t_DOT_txt=lines))
    assert sum(labels(cells)) == 25 and catalog.first()["channel_names"] == "s3" and catalog.first()["label_quality"] == "weak"


def test_log_bins(spark, tmp_path):
    line = lambda tag, t, part: f"{tag} {t} d n ts n R {part} INFO text with blanks"
    cells, _ = raw.LOADERS["bgl"](spark, put(tmp_path, x_DOT_log="\n".join([line("-", 0, "KERNEL"), line("ERR", 5, "APP"), line("-", 185, "KERNEL"), "broken"])))
    assert labels(cells) == [1, 0, 0, 0] and [r["value"] for r in cells.where("channel = 0").orderBy("row_idx").collect()] == [2, 0, 0, 1]


def test_snapshots_and_cycles(spark, tmp_path):
    files = {f"run1__{i:02}_DOT_txt": "\n".join(f"{(-1) ** j * i} {j}" for j in range(8)) for i in range(1, 14)}
    cells, catalog = raw.LOADERS["ims_bearing"](spark, put(tmp_path / "a", **files))
    assert catalog.first()["n_channels"] == 6 and sum(labels(cells)) == 2
    assert cells.where("channel = 0 and row_idx = 2").first()["value"] == 3.0
    path = put(tmp_path / "b", PS1_DOT_txt=" ".join(str(i // 2) for i in range(120)), TS1_DOT_txt=" ".join(map(str, range(60))))
    cells, _ = raw.LOADERS["hydraulic"](spark, path)
    assert [r["value"] for r in cells.where("row_idx = 7").orderBy("channel").collect()] == [7.0, 7.0]


def test_topics_on_a_grid(spark, tmp_path):
    text = "flight,topic,t,value\n1,alt,0.0,5\n1,alt,0.25,6\n1,spd,0.1,7\n1,spd,0.5,8\n1,failure,0.3,1\n2,alt,0,1\n2,spd,0.1,1\n"
    cells, _ = raw.load_topics(spark, put(tmp_path, x_DOT_csv=text))
    first = cells.where("series_id = '1' and channel = 0").orderBy("row_idx").collect()
    assert [r["value"] for r in first] == [5, 5, 5, 6, 6, 6] and {r["label"] for r in cells.where("series_id = '2'").collect()} == {-1}


def test_messages_and_beats(spark, tmp_path):
    text = "t,id,label,a,b\n0.00,7,0,1,\n0.05,7,0,2,9\n0.31,8,1,3,\n"
    cells, catalog = raw.LOADERS["road"](spark, put(tmp_path / "a", x_DOT_csv=text))
    assert catalog.first()["channel_names"] == "7_a|7_b|8_a" and [r["value"] for r in cells.where("channel = 0").orderBy("row_idx").collect()] == [2, 2, 2, 2] and labels(cells) == [0, 0, 0, 1]
    path = put(tmp_path / "b", r_signal_DOT_csv="sample,mv\n" + "\n".join(f"{i},{i}" for i in range(200)), r_beats_DOT_csv="sample,symbol\n20,N\n100,V\n")
    cells, _ = raw.LOADERS["mitbih"](spark, path)
    assert labels(cells) == [int(46 <= i <= 153) for i in range(200)]


def test_nested_arrays_and_pool(spark, tmp_path):
    spark.sql("select 'a' as item_id, timestamp'2020-01-01' as start, 60 as freq_s, array(transform(sequence(1, 70), x -> cast(x as float)), transform(sequence(1, 70), x -> cast(-x as float))) as target").write.parquet(str(tmp_path / "in"))
    cells, catalog = raw.LOADERS["lotsa"](spark, str(tmp_path / "in"))
    assert cells.count() == 140 and catalog.first()["unlabeled"]
    raw.write_pool(cells, str(tmp_path / "pool"), "lotsa")
    assert raw.read_series(spark, str(tmp_path / "pool"), ["a"], "lotsa").where("value = -70").count() == 1
    files = spark.createDataFrame([("solar_x", "f1", 9), ("solar_x", "f2", 3), ("zzz", "f3", 1)], "subset string, file string, size long")
    assert sorted(tuple(r) for r in raw.smallest_files(files).collect()) == [("solar_x", "f2", "unknown"), ("zzz", "f3", "unknown")]


def test_simulations_and_labels_by_position(spark, tmp_path):
    rows = [f"{f},1,{s},{s}" for f in (0, 1, 3) for s in range(1, 161)]
    cells, _ = raw.LOADERS["tep"](spark, put(tmp_path / "a", x_DOT_csv="faultNumber,simulationRun,sample,xmeas_1\n" + "\n".join(rows)))
    got = labels(cells)
    assert got[:160] == [0] * 160 and got[160:320] == [0] * 20 + [1] * 100 + [-1] * 40 and got[320:] == [0] * 20 + [-1] * 140
    path = put(tmp_path / "b", train_DOT_csv="timestamp_(min),a\n0,1\n", test_DOT_csv="timestamp_(min),a\n0,1\n1,2\n2,3\n", test_label_DOT_csv="timestamp_(min),label\n0,0\n1,1\n")
    assert labels(raw.LOADERS["psm"](spark, path)[0]) == [0, 1, -1, -1]


def test_arrays_blocks_and_days(spark, tmp_path):
    for part in ("train", "test"):
        (tmp_path / "a" / part).mkdir(parents=True)
        np.save(tmp_path / "a" / part / "A-1.npy", np.arange(12.0).reshape(6, 2))
    path = put(tmp_path / "a", labeled_anomalies_DOT_csv='chan_id,anomaly_sequences\nA-1,"[[1, 2]]"\nA-1,"[[5, 9]]"\n')
    cells, _ = raw.LOADERS["smap"](spark, path)
    assert labels(cells.where("series_id = 'test/A-1'")) == [0, 1, 1, 0, 0, 1] and set(labels(cells.where("series_id = 'test/A-1'"), 1)) == {0}
    path = put(tmp_path / "b", good__f_DOT_csv="x\n" + "\n".join(map(str, range(25))))
    assert [r["value"] for r in raw.LOADERS["bosch_cnc"](spark, path)[0].orderBy("row_idx").collect()] == [4.5, 14.5]
    path = put(tmp_path / "c", **{"machine-1_0_DOT_csv": "a\n1\n2\n", "machine-1_5_DOT_csv": "a\n3\n4\n", "label_machine-1_DOT_csv": "label\n1\n0\n"})
    cells, catalog = raw.load_machine_days(spark, path)
    assert labels(cells) == [-1, -1, 1, 0] and catalog.first()["n_rows"] == 4


def test_mission(spark, tmp_path):
    rows = lambda k: "time,value\n" + "\n".join(f"2020-01-01 00:{10 * i}:00,{k + i}" for i in range(4))
    path = put(tmp_path, channel_1_DOT_csv=rows(0), channel_2_DOT_csv=rows(5), labels_DOT_csv="ID,Channel,StartTime,EndTime\ne1,channel_1,2020-01-01 00:10:00,2020-01-01 00:20:00\ne2,channel_2,2020-01-01 00:20:00,2020-01-01 00:30:00\n", anomaly_types_DOT_csv="ID,Category\ne1,Anomaly\ne2,Rare Event\n")
    cells, _ = raw.LOADERS["esa_full"](spark, path)
    assert labels(cells, 0) == [0, 1, 1, 0] and labels(cells, 1) == [0, 0, -1, -1]


def test_leaks(spark):
    rows = [("p", i, 5.0 if 10 <= i < 30 else 0.0) for i in range(50)] + [("q", i, 1.0 if 40 <= i else 0.0) for i in range(50)]
    out = label_rules.leak_labels(spark.createDataFrame(rows, "leak string, row_idx long, flow double"), onset=5, margin=2)
    got = [r["label"] for r in out.orderBy("row_idx").collect()]
    assert got == [0] * 10 + [1] * 5 + [0] * 13 + [-1] * 4 + [0] * 8 + [-1] * 5 + [0] * 5


def test_all_sources_are_registered():
    assert set(raw.WIDE) <= set(raw.LOADERS) and len(raw.LOADERS) >= 50
    assert len(set(raw.LOADERS.values())) >= len(raw.LOADERS) - 3  # three names of one archive's missions share an adapter


def test_sectors_by_start_of_name(spark):
    names = ["solar_power_4s", "taxi_30min", "era5_2018", "m4_daily", "tourism_monthly", "my_taxi_", "Taxi_", "largest_2017", "cmip6_1850"]
    files = spark.createDataFrame([(n, "f", 1) for n in names], "subset string, file string, size long")
    found = {r["subset"]: r["sector"] for r in raw.smallest_files(files).collect()}
    assert found == {"solar_power_4s": "energy", "taxi_30min": "transport", "era5_2018": "environment", "m4_daily": "mixed_business", "tourism_monthly": "tourism", "my_taxi_": "unknown", "Taxi_": "unknown"}


def test_rooms(spark, tmp_path):
    put(tmp_path, **{"air_quality/AirQualityUCI.csv": "Date;Time;CO(GT);T;;\n10/03/2004;18.00.00;2,6;-200;;\n10/03/2004;19.00.00;-200;13,5;;\n;;;;;\n", "occupancy/datatest.txt": '"date","Temperature","Humidity","Light","CO2","HumidityRatio","Occupancy"\n"1","2015-02-02 14:19:00",23.7,26.2,585.2,749.2,0.004,1\n', "appliances/energydata_complete.csv": '"date","Appliances"\n"2016-01-11 17:00:00","60"\n'})
    cells, catalog = raw.LOADERS["uci"](spark, str(tmp_path))
    rows = {r["series_id"]: r for r in catalog.collect()}
    assert {k: (r["sector"], r["n_rows"], r["n_channels"]) for k, r in rows.items()} == {"air_quality": ("environment", 2, 2), "appliances": ("building", 1, 1), "occupancy_datatest": ("building", 1, 5)}
    assert rows["air_quality"]["step_s"] == 3600.0 and rows["air_quality"]["unlabeled"]
    assert [r["value"] for r in cells.where("series_id = 'air_quality'").orderBy("row_idx", "channel").collect()] == [2.6, None, None, 13.5]
    assert [r["value"] for r in cells.where("series_id = 'occupancy_datatest'").orderBy("channel").collect()] == [23.7, 26.2, 585.2, 749.2, 0.004]


def test_houses_by_minute(spark, tmp_path):
    day = 86400
    lines = [f"x,{t},{t % 7},{t // 30 % 5},0" for t in range(0, 120 * 20, 30)] + [f"x,{60 * day + t},1,2,0" for t in range(0, 60 * 12, 30)]
    path = put(tmp_path, House_1_DOT_csv="Time,Unix,Aggregate,Appliance1,Issues\n" + "\n".join(lines))
    _, catalog = raw.load_houses(spark, path, least=12)
    assert catalog.count() == 0  # nearly all minutes are missing, so no channel is known
    lines = [f"x,{t},{t % 7},{t // 30 % 5},0" for t in range(0, 60 * 60, 30) if t // 60 != 5] + [f"x,{3600 * 24 + t},1,2,0" for t in range(0, 60 * 12, 30)]
    put(tmp_path, House_1_DOT_csv="Time,Unix,Aggregate,Appliance1,Issues\n" + "\n".join(lines[: len(lines) - 24]))
    cells, catalog = raw.load_houses(spark, path, least=59)
    row = catalog.first()
    assert (row["series_id"], row["n_rows"], row["channel_names"], row["step_s"], row["sector"]) == ("house_1/p00", 60, "Aggregate|Appliance1", 60.0, "residential")
    got = {r["row_idx"]: r["value"] for r in cells.where("channel = 1").collect()}
    assert got[0] == 0.5 and got[5] is None and raw.load_houses(spark, path, least=60)[1].count() == 0


def test_attacks_by_process(spark, tmp_path):
    head = "time;P1_A;P2_B;P3_C;attack;attack_P1;attack_P2"
    old = [f"2020-01-01 00:00:0{i};{i};{i * 2};7;{int(i > 1)};{int(i == 2)};{int(i == 3)}" for i in range(6)]
    new = ["timestamp,P1_A"] + [f"2022-01-01 00:00:0{i},{i}" for i in range(4)]
    put(tmp_path, **{"v1/test1.csv": "\n".join([head, *old]), "v1/train1.csv": "\n".join([head, *old]), "v2/hai-test1.csv": "\n".join(new), "v2/label-test1.csv": "timestamp,label\n2022-01-01 00:00:01,1\n2022-01-01 00:00:02,0\n"})
    cells, catalog = raw.LOADERS["hai"](spark, str(tmp_path))
    rows = {r["series_id"]: (r["label_level"], r["channel_names"]) for r in catalog.collect()}
    assert rows == {"v1/test1": ("cell", "P1_A|P2_B"), "v1/train1": ("row", "P1_A|P2_B"), "v2/test1": ("row", "P1_A")}
    of = lambda s, c: labels(cells.where(f"series_id = '{s}'"), c)
    assert of("v1/test1", 0) == [0, 0, 1, 0, 1, 1] and of("v1/test1", 1) == [0, 0, 0, 1, 1, 1] and of("v1/train1", 0) == [0] * 6 and of("v2/test1", 0) == [0, 1, 0, 0]


@pytest.fixture
def tiny_splits(spark):
    """Files are cut every few dozen bytes and spread over many tasks."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_rows_are_numbered_in_the_order_of_the_file(spark, tmp_path, tiny_splits):
    path = put(tmp_path, a_DOT_txt="\n".join(f"{i}" if i % 7 else f"{i}\n" for i in range(700)), b_DOT_txt="\n".join(f"{1000 + i:09}" for i in range(99)))
    read = spark.read.text(path).where("value != ''").select("value", raw.file_order().alias("order"))
    assert read.rdd.getNumPartitions() > 20
    got = raw.row_numbers_in_file(read).select("value", "row_idx").collect()
    assert sorted((int(r["value"]), r["row_idx"]) for r in got) == [(i, i) for i in range(700)] + [(1000 + i, i) for i in range(99)]


def test_positions_hold_in_tiny_splits(spark, tmp_path, tiny_splits):
    """Label files that go with their data by row number only."""
    n = 300
    data = "t,f\n" + "\n".join(f"{i},{i * 3}" for i in range(n))
    path = put(tmp_path / "psm", train_DOT_csv=data.replace("t,f", "timestamp_(min),f"), test_DOT_csv=data.replace("t,f", "timestamp_(min),f"), test_label_DOT_csv="timestamp_(min),label\n" + "\n".join(f"{i},{int(i % 5 == 0)}" for i in range(n)))
    cells, _ = raw.LOADERS["psm"](spark, path)
    assert labels(cells.where("series_id = 'test'")) == [int(i % 5 == 0) for i in range(n)]
    assert [r["value"] for r in cells.where("series_id = 'test'").orderBy("row_idx").collect()] == [3.0 * i for i in range(n)]
    path = put(tmp_path / "smd", test__m1_DOT_txt="\n".join(f"{i},{-i}" for i in range(n)), test_label__m1_DOT_txt="\n".join(str(int(i % 4 == 1)) for i in range(n)), interpretation_label__m1_DOT_txt="8-13:2")
    cells, _ = raw.LOADERS["smd"](spark, path)
    assert [r["value"] for r in cells.where("channel = 1").orderBy("row_idx").collect()] == [float(-i) for i in range(n)]
    assert labels(cells) == [int(i % 4 == 1 and not 8 <= i <= 13) for i in range(n)]


def test_causes_and_affected_channels(spark, tmp_path, tiny_splits):
    at = lambda i: f"2023-01-01 00:{i // 60:02}:{i % 60:02}"
    marked = {5, 6, 7, 40, 41, 90}
    data = ["timestamp,aimp,amud,arnd,y,category"] + [f"{at(i)},{i}.5,{-i},{i % 3},{int(i in marked)}.0,0.0" for i in range(100)]
    meta = ["start_time,end_time,root_cause,affected,category", f"{at(5)},{at(7)},aimp,\"['arnd']\",1", f"{at(6)},{at(8)},amud,[],2", f"{at(40)},{at(40)},other,\"['nothing']\",3"]
    path = put(tmp_path, data_DOT_csv="\n".join(data), metadata_DOT_csv="\n".join(meta))
    cells, catalog = raw.LOADERS["cats"](spark, path)
    got = [[0] * 70 + [0] * 30 for _ in range(3)]
    for c, rows in enumerate(([5, 6, 7, 40, 41, 90], [6, 7, 8, 40, 41, 90], [5, 6, 7, 40, 41, 90])):
        for i in rows:
            got[c][i] = 1
    for c in range(3):
        assert labels(cells.where("series_id = 'train'"), c) == got[c][:70] and labels(cells.where("series_id = 'val'"), c) == got[c][70:]
    assert {(r["series_id"], r["n_rows"], r["label_level"], r["channel_names"]) for r in catalog.collect()} == {("train", 70, "cell", "aimp|amud|arnd"), ("val", 30, "cell", "aimp|amud|arnd")}


def test_servers_by_position(spark, tmp_path, tiny_splits):
    path = put(tmp_path, omi_1_train_DOT_csv="\n".join(f"{i},0" for i in range(60)), omi_1_test_DOT_csv="\n".join(f"{i},1" for i in range(50)), omi_1_test_label_DOT_csv="\n".join(f"{int(i > 30)}.0" for i in range(45)))
    cells, catalog = raw.LOADERS["asd"](spark, path)
    assert labels(cells.where("series_id = 'omi_1/train'")) == [-1] * 60
    assert labels(cells.where("series_id = 'omi_1/test'")) == [int(i > 30) for i in range(45)] + [-1] * 5
    first = cells.where("series_id = 'omi_1/test' and row_idx = 0 and channel = 1").first()
    assert (first["timestamp"], first["value"]) == (raw.EPOCH + 300 * 60, 1.0)
    assert {r["series_id"]: r["unlabeled"] for r in catalog.collect()} == {"omi_1/train": True, "omi_1/test": False}


def test_plant_faults(spark, tmp_path, tiny_splits):
    code = [0] * 30 + [1, 2, 3, 4] + [0] * 6
    path = put(tmp_path, dataset_DOT_csv="vdc1,vdc2,idc1,idc2,irr,pvt,f_nv\n" + "\n".join(f"{i},2,3,4,5,6,{f}" for i, f in enumerate(code)))
    cells, catalog = raw.LOADERS["pvfault"](spark, path)
    assert labels(cells) == [0] * 30 + [1, 1, 1, -1] + [0] * 6
    assert [r["value"] for r in cells.where("channel = 0").orderBy("row_idx").collect()] == [float(i) for i in range(40)]
    assert catalog.first()["sector"] == "energy"
