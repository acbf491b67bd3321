import hashlib
import io
import zipfile

import pytest
from helpers import DAY0, DATE0, rows, trades
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidegrid.operators import quality
from tidegrid.sources import archives, tables
from tidegrid.sources import trades as source
from tidegrid.sources.schema import CANONICAL_TRADES, RAW_TRADES, SchemaMismatch, require_columns

MICROS = DAY0 // 1_000
MILLIS = DAY0 // 1_000_000
SPOT = f"7,100.5,2.0,70,71,{MICROS},True,True\n8,101.0,1.0,72,72,{MICROS + 5},False,True\n"
HEADER = "agg_trade_id,price,quantity,first_trade_id,last_trade_id,transact_time,is_buyer_maker\n"
PERPETUAL = HEADER + f"9,99.5,3.0,1,2,{MILLIS + 2},true\n"


def _zip(path, members):
    with zipfile.ZipFile(path, "w") as archive:
        for name, text in members.items():
            archive.writestr(name, text)


def _ingest(spark, folder):
    return source.normalise_raw(archives.ingest_archives(archives.read_binary(spark, str(folder))))


def test_archives_of_both_markets(spark, tmp_path):
    _zip(tmp_path / f"AAA-spot-{DATE0}.zip", {"a.csv": SPOT, "readme.txt": "x"})
    _zip(tmp_path / f"AAA-perpetual-{DATE0}.zip", {"b.csv": PERPETUAL})
    out = _ingest(spark, tmp_path)
    assert out.columns == [*CANONICAL_TRADES.fieldNames(), "date"]
    got = rows(
        out.select("market_type", "event_time_ns", "aggregate_trade_id", "signed_notional", "is_buyer_maker"),
        "aggregate_trade_id",
    )
    assert got == [
        ("spot", DAY0, 7, -201.0, True),
        ("spot", DAY0 + 5_000, 8, 101.0, False),
        ("perpetual", DAY0 + 2_000_000, 9, -298.5, True),
    ]


@pytest.mark.parametrize(
    "name, members",
    [
        (f"AAA-perpetual-{DATE0}.zip", {"b.csv": PERPETUAL.replace("agg_trade_id", "id")}),
        (f"AAA-spot-{DATE0}.zip", {"a.csv": SPOT, "b.csv": SPOT}),
        (f"AAA-spot-{DATE0}.zip", {"a.txt": SPOT}),
        (f"AAA-spot-{DATE0}.zip", {"a.csv": ""}),
        (f"AAA-spot-{DATE0}.zip", {"a.csv": SPOT.replace("True,True", "unknown,True")}),
        (f"AAA-spot-{DATE0}.zip", {"a.csv": SPOT.replace("100.5", "cheap")}),
        (f"AAA-spot-{DATE0}.zip", {"a.csv": SPOT.replace(str(MICROS), str(MICROS + 86_400_000_000))}),
        (f"AAA-spot-{DATE0}.zip", {"a.csv": SPOT.replace(str(MICROS), "12345")}),
        (f"AAA-spot-{DATE0}.zip", {"a.csv": SPOT.replace(str(MICROS) + ",", str(MILLIS) + ",")}),
    ],
)
def test_malformed_archives_are_rejected(spark, tmp_path, name, members):
    _zip(tmp_path / name, members)
    with pytest.raises(PySparkException):
        _ingest(spark, tmp_path).collect()


def test_plain_csv_files(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "p").mkdir()
    (tmp_path / "bad").mkdir()
    (tmp_path / "s" / f"AAA-spot-{DATE0}.csv").write_text(SPOT)
    (tmp_path / "p" / f"AAA-perpetual-{DATE0}.csv").write_text(PERPETUAL)
    (tmp_path / "bad" / f"AAA-perpetual-{DATE0}.csv").write_text(PERPETUAL.replace("price", "cost"))
    spot = archives.read_csv_files(spark, str(tmp_path / "s"), "spot")
    perpetual = archives.read_csv_files(spark, str(tmp_path / "p"), "perpetual")
    assert spot.columns == RAW_TRADES.fieldNames()
    assert source.normalise_raw(spot.unionByName(perpetual)).count() == 3
    with pytest.raises(SchemaMismatch):
        archives.read_csv_files(spark, str(tmp_path / "bad"), "perpetual")
    (tmp_path / "mixed").mkdir()
    (tmp_path / "mixed" / f"AAA-spot-{DATE0}.csv").write_text(SPOT.replace(f"{MICROS},", f"{MILLIS},"))
    with pytest.raises(PySparkException, match="mixes timestamp units"):
        archives.read_csv_files(spark, str(tmp_path / "mixed"), "spot").collect()


def test_pack_and_ingest_are_inverse(spark):
    raw = source.raw_text_from_events(source.read_events(spark, "/root/testdata/sf0.001"))
    packed = archives.pack_archives(raw, rows_per_file=300)
    assert packed.count() > raw.select("source_file").distinct().count()
    back = archives.ingest_archives(packed).drop("source_file")
    assert back.exceptAll(raw.drop("source_file").select(*back.columns)).count() == 0
    assert back.count() == raw.count()


def test_days_are_cut_into_files_by_their_own_rows(spark):
    """Ids far apart do not cut a day that fits one file; files of a crowded day are full but the last."""
    raw = source.raw_text_from_events(source.read_events(spark, "/root/testdata/sf0.001"))
    apart = raw.withColumn("aggregate_trade_id", (F.col("aggregate_trade_id").cast("long") * 5_000_000).cast("string"))
    files = archives.pack_archives(apart)
    names = {r[0] for r in files.select("path").collect()}
    assert names == {f"{r[0]}-000000.zip" for r in apart.select("source_file").distinct().collect()}
    day = "symbol = 'AAA' AND market_type = 'spot'"
    packed = archives.pack_archives(raw.where(day).withColumn("date", F.lit(DATE0)), most_rows=100)
    sizes = [r[1] for r in archives.ingest_archives(packed).groupBy("source_file").count().orderBy("source_file").collect()]
    assert sum(sizes) == raw.where(day).count() and set(sizes[:-1]) == {100} and len(sizes) == -(-sum(sizes) // 100)


def test_checksum_statuses(spark, tmp_path):
    def digest(text):
        return hashlib.sha256(text.encode()).hexdigest()

    bodies = {f"f{i}.zip": f"body{i}" for i in range(5)}
    for name, text in bodies.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "f0.zip.CHECKSUM").write_text(f"{digest('body0').upper()} *f0.zip\n")
    (tmp_path / "f1.zip.CHECKSUM").write_text(f"{digest('other')}  f1.zip\n")
    (tmp_path / "f2.zip.CHECKSUM").write_text("not a digest")
    (tmp_path / "f3.zip.CHECKSUM").write_text(f"{digest('body3')}  f9.zip\n")
    files = archives.read_binary(spark, str(tmp_path), "*.zip")
    got = dict(rows(archives.verify_checksums(files, archives.read_sidecars(spark, str(tmp_path)))))
    assert got == {
        "f0.zip": "ok",
        "f1.zip": "mismatch",
        "f2.zip": "bad_sidecar",
        "f3.zip": "wrong_name",
        "f4.zip": "missing_sidecar",
    }


def test_timestamp_units(spark):
    frame = spark.createDataFrame([(MILLIS,), (MICROS,), (DAY0,), (12345,)], "t long")
    got = rows(frame.select(source.timestamp_unit(F.col("t")), source.to_nanoseconds(F.col("t"))))
    assert got == [("ms", DAY0), ("us", DAY0), ("ns", DAY0), (None, None)]


def test_mixed_units_are_reported(spark):
    raw = spark.createDataFrame([("a", str(MILLIS)), ("a", str(MICROS)), ("b", str(MICROS))],
                                "source_file string, transact_time string")
    assert dict(rows(source.timestamp_units(raw).select("source_file", "accepted"))) == {"a": False, "b": True}


def _some(spark):
    return trades(
        spark,
        [(m, i * 1_000_000, i, 100 + i, 1, i % 2 == 0) for i in range(1, 40) for m in ("spot", "perpetual")],
    )


def test_trade_table_round_trip_and_rerun(spark, tmp_path):
    path = str(tmp_path / "trades")
    frame = _some(spark)
    for _ in range(2):
        tables.write_trades(frame, path, slice_ids=10)
    back = tables.read_trades(spark, path)
    assert back.count() == frame.count()
    assert back.exceptAll(frame.select(*back.columns)).count() == 0
    reports = quality.validate_files(back, ["AAA"])
    assert reports.count() >= 2
    assert reports.agg(F.sum("time_reversals")).first()[0] == 0
    inventory = tables.file_inventory(spark, path)
    assert inventory.where("length(sha256) <> 64 OR sha256 IS NULL").count() == 0
    assert inventory.agg(F.sum("rows")).first()[0] == frame.count()


def test_physical_order_across_blocks(spark, tmp_path):
    frame, path = _some(spark), str(tmp_path / "trades")
    backwards = frame.where("market_type = 'spot'").unionByName(
        frame.where("market_type = 'perpetual'").withColumn("event_time_ns", F.lit(DAY0))
    )
    order = [-F.col("event_time_ns"), -F.col("aggregate_trade_id")]
    tables.write_trades(backwards, path, order=order)
    for block in (1, 4, 1_000_000):
        report = quality.physical_order(tables.read_trades(spark, path), ["market_type"], block)
        got = rows(report.select("market_type", "rows", "time_reversals", "id_disorders", "in_order"), "market_type")
        assert got == [("perpetual", 39, 0, 38, False), ("spot", 39, 38, 0, False)]
    tables.write_trades(backwards, path)
    report = quality.physical_order(tables.read_trades(spark, path), ["market_type"], 4)
    assert [r["in_order"] for r in report.collect()] == [True, True]


def test_a_write_that_dies_leaves_the_committed_table(spark, tmp_path):
    frame, path = _some(spark), str(tmp_path / "trades")
    assert tables.commit_trades(frame, path, slice_ids=10) == 1

    def total(number=None):
        table = tables.read_committed_trades(spark, path, number)
        return table.groupBy("market_type").agg(F.sum("price"), F.count("*")).orderBy("market_type").collect()

    before = total()
    changed = frame.withColumn("price", F.col("price") + 1_000.0)
    broken = F.when(F.col("aggregate_trade_id") == 33, F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(PySparkException):
        tables.commit_trades(changed.withColumn("quantity", broken.otherwise(F.col("quantity"))), path, slice_ids=10)
    assert total() == before
    # All files written, but the run dies before its commit.
    tables.write_trades(changed, f"{path}/files/version=dead")
    assert total() == before
    assert tables.commit_trades(changed.where("market_type = 'spot'"), path) == 2
    after = total()
    assert after[0] == before[0] and after[1][1] == before[1][1] + 39_000 and after[1][2] == 39
    assert total(1) == before
    # A second writer that started from the first commit is refused and changes nothing.
    late = str(tmp_path / "trades" / "commits" / "_waiting-late")
    spark.range(1).write.parquet(late)
    with pytest.raises(Exception, match="FileAlreadyExists|already exists|Rename"):
        tables._publish(spark, late, f"{path}/commits/2")
    assert total() == after


def test_replaced_versions_are_pruned(spark, tmp_path):
    frame, path = _some(spark), str(tmp_path / "trades")
    for _ in range(2):
        tables.commit_trades(frame, path)
    plan = tables.read_committed_trades(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    with pytest.raises(ValueError):
        tables.read_committed_trades(spark, str(tmp_path / "nothing"))


def test_feature_scan_prunes_partitions_and_columns(spark, tmp_path):
    path = str(tmp_path / "features")
    frame = spark.createDataFrame(
        [("AAA", f"2024-01-0{d}", d, 1.0, 2.0) for d in range(1, 8)],
        "symbol string, date string, decision_time_ns long, a double, b double",
    )
    tables.write_features(frame, path)
    scan = tables.read_features(spark, path, ["AAA"], "2024-01-02", "2024-01-04", ["a"], frame.schema)
    assert rows(scan, "date") == [("AAA", f"2024-01-0{d}", d, 1.0) for d in (2, 3, 4)]
    plan = scan._jdf.queryExecution().executedPlan().toString()
    partition_filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "date" in partition_filters and "symbol" in partition_filters
    assert "b:double" not in plan.split("ReadSchema")[1]


def test_reports_keep_their_header_without_rows(spark, tmp_path):
    path = tmp_path / "report"
    tables.write_report(tables.empty_report(spark, "fold int, message string"), str(path))
    files = list(path.glob("part-*.csv"))
    assert len(files) == 1 and files[0].read_text().strip() == "fold,message"


def test_validation_counts(spark):
    good = _some(spark)
    keys = ["symbol", "market_type", "date"]
    for block in (4, 1_000_000):
        report = quality.validate_trades(good, keys, "aggregate_trade_id", ["AAA"], block)
        assert report.agg(F.sum("time_reversals"), F.sum("invalid_numeric")).first() == (0, 0)
    backwards = good.withColumn("event_time_ns", -F.col("event_time_ns"))
    for block in (4, 1_000_000):
        report = quality.validate_trades(backwards, keys, "aggregate_trade_id", ["AAA"], block)
        assert {r["time_reversals"] for r in report.collect()} == {38}
    broken = good.withColumn("price", F.when(F.col("aggregate_trade_id") == 3, -1.0).otherwise(F.col("price")))
    broken = broken.withColumn("aggressor_sign", F.lit(0).cast("byte"))
    report = quality.validate_trades(broken, keys, "aggregate_trade_id", ["BBB"]).first()
    assert report["invalid_numeric"] == 1
    assert report["invalid_sign"] == report["invalid_identity"] == report["rows"] == 39
    with pytest.raises(quality.DataQualityError):
        quality.require_clean(
            quality.validate_trades(broken, keys, "aggregate_trade_id", ["AAA"]), ["invalid_numeric"]
        )
    assert rows(quality.duplicate_ids(good, ["aggregate_trade_id"]), "aggregate_trade_id")[0] == (1, 2)


def test_column_sets(spark):
    frame = spark.createDataFrame([(1, 2)], "a int, b int")
    require_columns(frame, ["a"], exact=False)
    with pytest.raises(SchemaMismatch):
        require_columns(frame, ["a"])
    with pytest.raises(SchemaMismatch):
        require_columns(frame, ["a", "c"], exact=False)


def test_bytes_reader_streams(tmp_path):
    assert list(archives._chunks(io.BytesIO(SPOT.encode()), "spot", "x"))[0].shape == (2, 8)
