"""The command line, its sources and sinks, the log channels, and the same masking on a stream."""

import io
import json
import logging

from umbraframe import cli
from umbraframe.logs import LOG, TRACE
from umbraframe.sources.texts import read_texts, write_masked
from umbraframe.streaming.masking import mask_stream


def test_exit_codes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("to k@l.mn\nand o@p.qr, k@l.mn\n")
    (tmp_path / "in/b.txt").write_text(" \n")
    source, out = str(tmp_path / "in"), lambda i: str(tmp_path / f"out{i}")
    assert cli.main([]) == 1 and cli.main(["-h"]) == 0 and cli.main([source, out(0)]) == 1 and cli.main([source, out(0), "--model", "/no/such"]) == 1
    assert cli.main([source, out(0), "--rules", "--timeout", "0"]) == 1 and cli.main([source, out(0), "--rules", "--threshold", "x"]) == 1
    assert cli.main([source, out(0), "--rules", "--manifest", str(tmp_path / "none.json")]) == 1
    assert cli.main([source, out(1), "--rules", "--show-map", out(2)], spark) == 0
    rows = spark.read.parquet(out(1)).collect()
    assert [r.masked_fields for r in rows] == [["to [EMAIL_ADDRESS_1]\nand [EMAIL_ADDRESS_2], [EMAIL_ADDRESS_3]\n"]] and "restore" not in rows[0].asDict()
    originals = [(r.placeholder, r.original) for r in spark.read.parquet(out(2)).collect()]
    assert originals == [("[EMAIL_ADDRESS_1]", "k@l.mn"), ("[EMAIL_ADDRESS_2]", "o@p.qr"), ("[EMAIL_ADDRESS_3]", "k@l.mn")]
    assert cli.main(["-", out(3), "--rules"], spark, io.StringIO("from s@t.uv")) == 0
    assert [r.masked_fields for r in spark.read.parquet(out(3)).collect()] == [["from [EMAIL_ADDRESS_1]"]]
    assert cli.main(["-", out(4), "--rules"], spark, io.StringIO("  \n")) == 0 and spark.read.parquet(out(4)).count() == 0
    assert cli.main(["-", out(5), "--rules"], spark, io.StringIO("a \x1e\x1e b")) == 2  # nothing could be sent
    assert [(r.status, r.masked_fields) for r in spark.read.parquet(out(5)).collect()] == [("drop_separator", None)]


def test_a_model_that_is_not_the_manifest_s(spark, tmp_path):
    for name in ("model.onnx", "tokenizer.json", "tokenizer_config.json"):
        (tmp_path / name).write_text("x")
    manifest = {"version": "v", "sourceURL": "file:///x", "archiveSHA256": "0", "weightsSHA256": "0", "bytes": 1, "maxWidth": 12, "maxSequenceLength": 768}
    (tmp_path / "m.json").write_text(json.dumps(manifest))
    assert cli.main(["-", str(tmp_path / "out"), "--model", str(tmp_path), "--manifest", str(tmp_path / "m.json")], spark, io.StringIO("x")) == 1
    # With a folder that looks like a model but is none, every row fails closed.
    assert cli.main(["-", str(tmp_path / "out"), "--model", str(tmp_path)], spark, io.StringIO("to k@l.mn")) == 2
    assert [(r.status, r.masked_fields) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("drop_filter_failed", None)]


def test_whole_files(spark, tmp_path):
    (tmp_path / "a").write_text("x\n\ny")
    (tmp_path / "b").write_text("")
    got = {r.path.rsplit("/", 1)[-1]: r.text for r in read_texts(spark, str(tmp_path)).collect()}
    assert got["a"] == "x\n\ny"
    rows = spark.createDataFrame([(2, "p", {"[B_1]": "y", "[A_1]": "x"}), (1, "q", {}), (3, "r", None)], "k int, masked string, restore map<string,string>")
    write_masked(rows, "k", str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o")).columns == ["k", "masked"]


def test_logs_hold_no_text(spark, tmp_path):
    """A failure is told by its kind alone, and the channel that may hold texts reaches no sink by itself."""
    told, sink = [], logging.Handler()
    sink.emit = lambda record: told.append(record.getMessage())
    logging.getLogger().addHandler(sink)
    try:
        TRACE.warning("secret text")
        LOG.warning("a row failed: %s", "ValueError")
    finally:
        logging.getLogger().removeHandler(sink)
    assert told == ["a row failed: ValueError"]


def test_a_batch_through_the_stream_s_masking(spark):
    got = mask_stream(spark.createDataFrame([(1, "to k@l.mn"), (2, None), (3, "\x1e\x1e")], "i int, text string")).orderBy("i").collect()
    assert [(r.status, r.masked) for r in got] == [("send", "to [EMAIL_ADDRESS_1]"), ("drop_filter_failed", None), ("drop_separator", None)]
