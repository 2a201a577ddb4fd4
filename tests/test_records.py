"""The protocol data source, tables computed once, nested audio and slices."""

import gzip
import os

import pytest
from pyarrow import parquet as pq
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyvoice.operators import arrays
from tallyvoice.plans import records
from tallyvoice.sources import cache, clip_protocol, nested
from tallyvoice.sources.folders import children

LINES = ["s1 u1 - A01 spoof", "", "  ", "s2 ü2 - - bonafide", "s1 " + "u" * 90 + " - A02 spoof", "s3 u4 - - bonafide"]


@pytest.mark.parametrize("end", ["\n", ""])
@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_every_line_is_in_one_range(tmp_path, end, block):
    path = tmp_path / "p"
    path.write_text("\n".join(LINES) + end)
    size = path.stat().st_size
    system, _ = clip_protocol.opened(str(path))
    for step in (1, 2, 5, 17, 18, 19, 60, size, size + 9):
        got = [x for part in clip_protocol.cut(str(path), 0, size, step) for some in clip_protocol.lines_of(system, part, block) for x in some]
        assert [x for x in got if x.strip()] == [x for x in LINES if x.strip()], step


def read(spark, path, mode="FAILFAST", dataset="asv19", **options):
    clip_protocol.register(spark)
    return spark.read.format("clip_protocol").option("dataset", dataset).option("mode", mode).options(**options).load(str(path))


def test_modes(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.txt").write_text("\n".join([*LINES, "s9 u9 - spoof", "s9 u8 - A1 maybe"]))
    (tmp_path / "p" / "_hidden").write_text("no protocol")
    kept = read(spark, tmp_path / "p", "PERMISSIVE", split_bytes="10").collect()
    assert len(kept) == 6 and sorted(r.error for r in kept if r.error) == ["asv19: expected 5 fields: s9 u9 - spoof", "asv19: unknown label: s9 u8 - A1 maybe"]
    assert all(r.utt_id is None and r.label is None for r in kept if r.error)
    good = {r.utt_id: r for r in read(spark, f"file://{tmp_path}/p", "DROPMALFORMED").collect()}
    assert set(good) == {"u1", "ü2", "u" * 90, "u4"} and good["u1"].attack_key == "asv19:A01" and good["ü2"].attack == "-"
    with pytest.raises(Exception, match="expected 5 fields"):
        read(spark, tmp_path / "p").collect()
    with pytest.raises(Exception, match="unknown dataset"):
        read(spark, tmp_path / "p", dataset="other").collect()
    (tmp_path / "none").mkdir()
    assert read(spark, tmp_path / "none").count() == 0


def test_stream_reads_what_has_come(spark, tmp_path):
    clip_protocol.register(spark)
    (tmp_path / "in").mkdir()
    first = tmp_path / "in" / "a"
    first.write_text("s1 u1 - A01 spoof\n")

    def run():
        stream = spark.readStream.format("clip_protocol").option("dataset", "asv19").load(str(tmp_path / "in"))
        out = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
        out.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        return sorted(r.utt_id for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == ["u1"]
    with first.open("a") as more:
        more.write("s1 u2 - A01 spoof\ns1 u3 - - bonafide\n")
    (tmp_path / "in" / "b").write_text("s1 u4 - - bonafide\n")
    assert run() == ["u1", "u2", "u3", "u4"] and run() == ["u1", "u2", "u3", "u4"]


def test_cache_reads_resumes_and_recomputes(spark, tmp_path):
    rows = spark.range(100).select(F.when(F.col("id") > 2, F.col("id")).alias("k"), (F.col("id") * 2).alias("v"))
    built = []

    def build(some):
        built.append(1)
        return some.groupBy("k").agg(F.sum("v").alias("v"))

    def table(store, settings, **how):
        return store.table("t", rows, ["k"], build, settings, "plan 1", **{"parts": 4, **how})

    store = cache.Cache(spark, str(tmp_path))
    assert table(store, {"a": 1}, most=3) is None and len(built) == 3 and len(store.wrote) == 3
    # another run, with another number of parts, computes what lacks
    again = cache.Cache(spark, str(tmp_path))
    have = sorted((r.k or -1, r.v) for r in table(again, {"a": 1}, parts=3).collect())
    assert have == sorted([(-1, 6), *((k, 2 * k) for k in range(3, 100))])
    count = len(built)
    assert table(cache.Cache(spark, str(tmp_path)), {"a": 1}).count() == 98 and len(built) == count  # reads only
    other = table(again, {"a": 2})
    assert other.count() == 98 and len(built) == count + 4  # another setting: another table
    assert store.address("t", rows.orderBy(F.desc("v")), ["k"], {"a": 1}, "plan 1") == store.address("t", rows, ["k"], {"a": 1}, "plan 1")
    assert len({store.address("t", x, ["k"], {"a": 1}, p) for x, p in ((rows, "plan 1"), (rows, "plan 2"), (rows.where("k <> 50"), "plan 1"))}) == 3
    assert {(r.settings, r.plan) for r in again.manifest().collect()} == {('{"a": 1}', "plan 1"), ('{"a": 2}', "plan 1")}
    keep = store.address("t", rows, ["k"], {"a": 2}, "plan 1")
    assert len(again.drop_others("t", [keep])) == 1 and children(spark, f"{tmp_path}/t") == [keep] and again.manifest().count() == 1
    assert store.table("none", rows.where("v < 0"), ["k"], build, parts=2).count() == 0


def test_nested_column_is_found():
    of = lambda text: nested.binary_path(StructType.fromDDL(text))
    assert of("id long, thumb binary, audio struct<path:string, bytes:binary>") == "`audio`.`bytes`"
    assert of("item struct<meta struct<x:binary>, WAV binary>") == "`item`.`WAV`"
    assert of("waveform binary") == "`waveform`"
    with pytest.raises(ValueError, match="no binary column"):
        of("id long, picture binary")


def test_slices_read_their_chunks_only(spark, tmp_path):
    path = str(tmp_path / "w")
    wave = [i / 1000 for i in range(100)]
    rows = spark.createDataFrame([(1, wave), (2, wave[:3]), (3, []), (4, wave[:50])], "call_id long, wave array<double>")
    nested.write_chunks(rows, path, 10, rows_a_group=4)
    got = nested.slices(spark, path, 25, 52, F.col("call_id") < 4)
    (only,) = got.collect()
    want = spark.createDataFrame([(wave[25:52],)], "w array<double>").select(arrays.from_pcm16(arrays.to_pcm16("w")).alias("w")).first().w
    assert only.call_id == 1 and only.wave == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    pushed, schema = plan.split("PushedFilters")[1].split("ReadSchema")[:2]
    assert "irst,52)" in pushed and "GreaterThanOrEqual(la" in pushed and "audio:struct<bytes:binary>>" in schema
    groups = sum(pq.ParquetFile(f).num_row_groups for f in tmp_path.glob("w/*.parquet"))
    assert groups >= 4


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_a_compressed_file_is_one_range(tmp_path, block):
    path = str(tmp_path / "p.gz")
    with gzip.open(path, "wt") as file:
        file.write("\n".join(LINES) + "\n")
    size, (system, _) = os.path.getsize(path), clip_protocol.opened(path)
    (part,) = clip_protocol.cut(path, 0, size, 5)
    got = [x for some in clip_protocol.lines_of(system, part, block) for x in some]
    assert got == LINES and clip_protocol.cut(path, size, size, 5) == []
    with pytest.raises(ValueError, match="has grown"):
        clip_protocol.cut(path, size - 1, size, 5)


def test_round_trip_writes_less_than_half_of_its_text(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "_folder", lambda _, name: str(tmp_path / name))
    sf = "/root/testdata/sf0.001"
    found = records.protocol_round_trip(spark, sf).collect()
    rows = records.protocol_rows(spark, sf)
    text = sum(rows.select(F.sum(F.octet_length(records._line(x)) + 1)).first()[0] for x in records.protocols.LAYOUTS.values())
    written = sum(p.stat().st_size for p in (tmp_path / "protocols").rglob("part-*"))
    assert sum(r.n for r in found) == 4 * rows.count() and 0 < written < text / 2
