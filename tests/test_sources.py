import json

import pytest
from pyspark.sql import functions as F

from perigee import fixed_values as fv
from perigee.session import materialize, scratch_root
from perigee.sources import artifacts, dims, telemetry


def write_csv(path, header, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join([",".join(header)] + [",".join(map(str, r)) for r in rows]) + "\n")
    return str(path)


def test_csv_with_declared_schema(spark, tmp_path):
    header = [*fv.FEATURES, "Label"]
    path = write_csv(tmp_path / "noised_dataset.csv", header, [[i + j / 2 for j in range(22)] + [i % 5] for i in range(9)])
    df = telemetry.read_csv(spark, path, telemetry.telemetry_schema())
    assert df.columns == header and dict(df.dtypes)["Label"] == "int" and df.count() == 9
    assert telemetry.read_csv(spark, path).where("Label = 0").count() == 2


def test_labels_written_as_decimals_and_broken_numbers(spark, tmp_path):
    path = write_csv(tmp_path / "n.csv", ["a", "Label"], [[1.5, "3.0"], ["x", 2], ["", ""]])
    got = telemetry.read_csv(spark, path, telemetry.telemetry_schema(["a"])).collect()
    assert [tuple(r) for r in got] == [(1.5, 3), (None, 2), (None, None)]


def test_csv_with_another_header_fails(spark, tmp_path):
    path = write_csv(tmp_path / "x.csv", ["b", "a", "Label"], [[1.0, 2.0, 0]])
    with pytest.raises(Exception):
        telemetry.read_csv(spark, path, telemetry.telemetry_schema(["a", "b"])).collect()


def test_files_are_found_by_name(spark, tmp_path):
    for name in ("a/Noised_v1.csv", "b/noised_v2.csv", "c/RAW_noised.csv", "consolidated.csv", "other.csv", "raw.txt"):
        write_csv(tmp_path / name, ["x"], [[1]])
    got = {r.role: r.path.rsplit("/", 1)[1] for r in telemetry.discover(spark, str(tmp_path)).collect()}
    assert got == {"noised": "noised_v2.csv", "raw": "consolidated.csv"}


def test_csv_rows_keep_their_place(spark, tmp_path):
    for part in range(3):
        write_csv(tmp_path / f"part{part}.csv", ["a", "Label"], [[part * 1000 + i, 0] for i in range(700)])
    small = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        df = telemetry.read_ordered_csv(spark, str(tmp_path), telemetry.telemetry_schema(["a"]))
        got = [(r.seq, r.a) for r in df.orderBy("seq").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", small)
    assert got == list(enumerate(float(part * 1000 + i) for part in range(3) for i in range(700)))


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_statistics_and_manifest_round_trip(spark, tmp_path, fmt):
    stats = dims.nominal_baseline(spark)
    artifacts.save_table(stats, str(tmp_path / "stats"), fmt)
    assert artifacts.stats_map(artifacts.load_stats(spark, str(tmp_path / "stats"), fmt), fv.FEATURES) == fv.NOMINAL_BASELINE
    artifacts.save_table(artifacts.manifest(spark, fv.FEATURES), str(tmp_path / "order"), fmt)
    assert artifacts.load_manifest(spark, str(tmp_path / "order"), fmt) == fv.FEATURES


def test_nested_json_artefacts(spark, tmp_path):
    (tmp_path / "stats.json").write_text(json.dumps({"a": {"mean": 1.5, "std": 2.0}, "b": {"mean": 0.0, "std": 0.0}}, indent=2))
    (tmp_path / "order.json").write_text(json.dumps(["b", "a"], indent=2))
    got = artifacts.stats_map(artifacts.load_nested_stats(spark, str(tmp_path / "stats.json")), ["a", "b"])
    assert got == {"a": (1.5, 2.0), "b": (0.0, 0.0)}
    order = artifacts.load_json_manifest(spark, str(tmp_path / "order.json")).orderBy("pos").collect()
    assert [r.feature for r in order] == ["b", "a"]


def test_dimensions_have_exact_sizes(spark):
    assert dims.classes(spark).count() == 5
    assert dims.knowledge(spark).groupBy("type").count().orderBy("type").collect() == [("class_mapping", 5), ("incident", 8)]
    assert len(dims.band_rows()) == 17


def test_scratch_is_the_named_shared_folder(spark):
    assert scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")
    df = materialize(spark.range(5).select(F.rand().alias("x"), F.array("id").alias("a")), "t")
    assert df.collect() == df.collect() and scratch_root(spark) + "/t-" in df.inputFiles()[0]


def test_part_files_are_read_in_the_order_of_their_numbers(spark, tmp_path):
    for number in (100000, 10001, 9, 99999):
        (tmp_path / f"part-{number}.csv").write_text(f"a,Label\n{number},0\n")
    rows = telemetry.read_ordered_csv(spark, str(tmp_path), telemetry.telemetry_schema(["a"]))
    assert [r.a for r in rows.orderBy("seq").collect()] == [9, 10001, 99999, 100000]


def test_data_sets_written_in_parts_are_found_by_their_folder(spark, tmp_path):
    spark.range(3).repartition(2).write.option("header", True).csv(str(tmp_path / "x" / "noised_dataset.csv"))
    (tmp_path / "consolidated.csv").write_text("a\n1\n")
    found = {r["role"]: r["path"] for r in telemetry.discover(spark, str(tmp_path)).collect()}
    assert found["noised"].endswith("/x/noised_dataset.csv") and found["raw"].endswith("/consolidated.csv")
