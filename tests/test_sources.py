"""Protocol, score and chunk scans on written files."""

import json

import pytest

from tallyvoice.sources import protocols


def lines(path, *rows):
    path.write_text("\n".join(rows) + "\n")
    return str(path)


def test_layouts(spark, tmp_path):
    files = {
        "asv19": ("s1 u1 - A01 spoof", "s1 u2 - - bonafide"),
        "asv5": ("s1 u1 F C03 1 2 AC1 A01 spoof -", "s1 u2 M - - - - bonafide bonafide -"),
        "asv21": ("u1 s1 alaw lon_mad A07 spoof eval notrim", "u2 s1 none none bonafide bonafide eval trim"),
        "calls": ("u1 s1 opus white 5-10 7.5 0 A01 spoof", "u2 s1 - none none - 0 - bonafide"),
    }
    for dataset, rows in files.items():
        got = {r.utt_id: r for r in protocols.read_protocol(spark, lines(tmp_path / dataset, *rows), dataset).collect()}
        assert got["u1"].label == 1 and got["u1"].attack.startswith("A0") and got["u1"].attack_key == f"{dataset}:{got['u1'].attack}"
        assert got["u2"].label == 0 and got["u2"].attack == "-" and got["u2"].codec == "-" and got["u2"].speaker == "s1"


def test_wrong_width_and_label_fail(spark, tmp_path):
    with pytest.raises(Exception, match="expected 5 fields"):
        protocols.read_protocol(spark, lines(tmp_path / "a", "s u - spoof"), "asv19").collect()
    with pytest.raises(Exception, match="unknown label"):
        protocols.read_protocol(spark, lines(tmp_path / "b", "s u - A1 fake"), "asv19").collect()
    with pytest.raises(ValueError, match="unknown dataset"):
        protocols.read_protocol(spark, "x", "other")


def test_itw_sample_and_available(spark, tmp_path):
    path = lines(tmp_path / "meta.csv", "file,speaker,label", " a.b.wav ,Ann, Spoof", "c.wav,Bob,bona-fide")
    got = {r.utt_id: r for r in protocols.read_protocol(spark, path, "itw").collect()}
    assert got["a.b"].attack == "itw" and got["c"].label == 0
    have = spark.createDataFrame([("c",), ("c",)], "utt_id string")
    assert [r.utt_id for r in protocols.read_protocol(spark, path, "itw", available=have).collect()] == ["c"]
    assert protocols.read_protocol(spark, path, "itw", limit=1).count() == 1


def test_inventory(spark, tmp_path):
    (tmp_path / "u1.flac").write_bytes(b"123")
    (tmp_path / "note.txt").write_bytes(b"1")
    assert [(r.utt_id, r.bytes) for r in protocols.audio_inventory(spark, str(tmp_path)).collect()] == [("u1", 3)]


def test_noted_parquet(spark, tmp_path):
    note = lambda u, a: json.dumps({"utterance_id": u, "speaker_id": "s", "codec": "none", "attack_id": a})
    spark.createDataFrame([(1, note("u1", "A07")), (0, note("u2", "bonafide"))], "label int, notes string").write.parquet(str(tmp_path / "p"))
    rows = protocols.read_noted_parquet(spark, str(tmp_path / "p"))
    assert {r.utt_id: r.attack for r in rows.collect()} == {"u1": "A07", "u2": "-"} and protocols.repeated_ids(rows).count() == 0
    spark.createDataFrame([(0, note("u3", "A07"))], "label int, notes string").write.parquet(str(tmp_path / "q"))
    with pytest.raises(Exception, match="disagrees"):
        protocols.read_noted_parquet(spark, str(tmp_path / "q")).collect()


def test_scores_round_trip(spark, tmp_path):
    long = spark.createDataFrame([(0, 1, "A1", "-", "svm", t, p) for t, p in ((2.0, 0.123456), (4.0, 0.5))], "clip_index long, label int, attack string, codec string, branch string, t double, p double")
    path = str(tmp_path / "scores")
    protocols.write_scores(long, path, ["svm"], [2.0, 4.0])
    assert protocols.read_scores(spark, path, "svm_2s").first().p == 0.12346
    with pytest.raises(ValueError):
        protocols.read_scores(spark, path, "none_2s")


def test_protocol_and_report_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("u1", None)], "utt_id string, codec string")
    protocols.write_protocol(rows, str(tmp_path / "t"), ["utt_id", "codec"])
    assert spark.read.text(str(tmp_path / "t")).first().value == "u1 -"
    protocols.write_json_report(rows, str(tmp_path / "j"))
    assert json.loads(spark.read.text(str(tmp_path / "j")).first().value) == {"utt_id": "u1"}


def test_chunks(spark):
    rows = spark.createDataFrame([("c", [1.0, 2.0, 3.0])], "call_id string, wave array<double>")
    got = sorted((r.seq, r.chunk, r.eof) for r in protocols.chunk_calls(rows, 2).collect())
    assert got == [(0, [1.0, 2.0], False), (1, [3.0], True)]


def test_corpora_and_repeated_ids(spark, tmp_path):
    for name in ("musan/a/1.wav", "musan/2.wav", "demand/x.flac", "demand/y.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"12")
    got = {r.corpus: (r.files, r.bytes) for r in protocols.corpora(spark, str(tmp_path), ("musan", "demand")).collect()}
    assert got == {"musan": (2, 4), "demand": (1, 2)}
    with pytest.raises(ValueError, match="esc50"):
        protocols.corpora(spark, str(tmp_path), ("musan", "esc50"))
    assert [r.utt_id for r in protocols.audio_inventory(spark, str(tmp_path), "^[xy]").collect()] == ["x"]
    ids = lambda *u: spark.createDataFrame([(x,) for x in u], "utt_id string")
    assert protocols.unique_ids(ids("a", "b")).count() == 2
    with pytest.raises(Exception, match="repeated id: a"):
        protocols.unique_ids(ids("a", "b", "a")).collect()


def test_verdict_records(spark):
    rows = spark.createDataFrame([("c/1", 2, 0.5, True)], "call_id string, seq long, p double, final boolean")
    (record,) = protocols.verdict_records(rows).collect()
    assert record.key == "c/1" and json.loads(record.value) == {"call_id": "c/1", "seq": 2, "p": 0.5, "final": True}
