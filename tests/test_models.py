import errno
import hashlib
import io
import json
import os
import tarfile
import time
import urllib.error

import numpy as np
import pytest

from umbraframe.operators.detect import CLS, ENTITY, ENTITY_END, SEP, Late, OnnxDetector, build_inputs, decode_window
from umbraframe.sources.models import PARTIAL_AGE, REQUIRED, Installer, InstallError, ModelPin, ModelStore, RecordFile, Rollback, classify, disk_needed, predecessor, safe_component, same_volume, verified


def published(tmp_path, version, weights=b"w"):
    src = tmp_path / f"src-{version}"
    src.mkdir()
    for name in ("model.onnx", "tokenizer.json", "tokenizer_config.json"):
        (src / name).write_bytes(weights)
    archive = tmp_path / f"{version}.tar.gz"
    with tarfile.open(archive, "w:gz") as t:
        for name in os.listdir(src):
            t.add(src / name, name)
    return ModelPin(version, archive.as_uri(), hashlib.sha256(archive.read_bytes()).hexdigest(), hashlib.sha256(weights).hexdigest().upper(), archive.stat().st_size)


def test_install_and_gates(tmp_path):
    store = ModelStore(str(tmp_path / "m"))
    pin = published(tmp_path, "v1")
    assert Installer(store, pin).ensure() == "installed" and Installer(store, pin).ensure() == "up_to_date"
    assert store.resolved().endswith("v1") and store.generation == 1 and store.installed()
    bad = ModelPin("v2", pin.url, "0" * 64, pin.weights_sha256, pin.archive_bytes)
    with pytest.raises(InstallError):
        Installer(store, bad).ensure()
    with pytest.raises(InstallError, match="space"):
        Installer(store, published(tmp_path, "v3"), free=lambda p: 0).ensure()
    assert Installer(store, bad).ensure(skipping=("v2",)) == "blocked"
    assert not [x for x in os.listdir(tmp_path / "m") if x.startswith((".download", ".staging"))]


def test_rollback(tmp_path):
    store = ModelStore(str(tmp_path / "m"))
    pins = [published(tmp_path, "v1"), published(tmp_path, "v2")]
    for p in pins:
        Installer(store, p).ensure()
    r = Rollback(store, RecordFile(str(tmp_path / "r.json")), pins)
    assert not r.arm("v2", "v2") and not r.arm("v2", "v0") and r.arm("v2", "v1")
    assert [r.at_launch() for _ in range(3)] == ["proving", "proving", "reverted"]
    assert store.promoted().endswith("v1") and r.blocked() == ["v2"]
    r.arm("v2", "v1")
    assert r.verify(lambda: (True, 2)) == "confirmed" and r.armed() is None
    r.arm("v2", "v1")
    assert r.verify(lambda: (True, 1)) == "reverted"
    os.remove(tmp_path / "m/v2/model.onnx")
    r.arm("v2", "v1")
    assert r.verify(lambda: (False, 0)) == "inconclusive" and r.armed()
    (tmp_path / "r.json").write_text("{torn")
    assert r.armed() is None


def test_names_and_sizes(tmp_path):
    assert [safe_component(x) for x in ("v1.2-a_b", "..", "../x", "a/b", "", "NUL", "COM1.2026")] == [True] + [False] * 6
    assert disk_needed(10) == (25, 15)
    pin = ModelPin("b", "file:///x", "", "", 1)
    assert predecessor([pin, pin], "b") is None
    with pytest.raises(ValueError):
        pin.relocated("x/y")


def test_manifest(tmp_path):
    """A manifest names the pin and the hashes that are checked at each load."""
    store = ModelStore(str(tmp_path / "m"))
    pin = published(tmp_path, "v1", b"all files alike")
    Installer(store, pin).ensure()
    sha = hashlib.sha256(b"all files alike").hexdigest()
    manifest = {"_comment": "x", "version": "v1", "sourceURL": pin.url, "archiveSHA256": pin.archive_sha256, "weightsSHA256": sha, "bytes": 9, "maxWidth": 7, "maxSequenceLength": 99, "files": {"tokenizerSHA256": sha.upper(), "tokenizerConfigSHA256": sha}}
    path = tmp_path / "manifest.json"
    path.write_text(json.dumps(manifest))
    read = ModelPin.from_json(str(path))
    assert (read.version, read.url, read.archive_bytes, read.max_width, read.max_sequence) == ("v1", pin.url, 9, 7, 99)
    assert set(read.file_sha256) == set(REQUIRED) and verified(store.resolved(), read)
    for name in REQUIRED:
        old = (tmp_path / "m/v1" / name).read_bytes()
        (tmp_path / "m/v1" / name).write_bytes(b"other")
        assert not verified(store.resolved(), read)
        (tmp_path / "m/v1" / name).write_bytes(old)
    del manifest["files"]
    path.write_text(json.dumps(manifest))
    assert ModelPin.from_json(str(path)).file_sha256 == {} and verified(store.resolved(), ModelPin.from_json(str(path)))
    del manifest["bytes"]
    path.write_text(json.dumps(manifest))
    with pytest.raises(ValueError, match="bytes"):
        ModelPin.from_json(str(path))


def test_no_model_is_loaded_but_that_of_the_pin(tmp_path, spark):
    """The hashes are checked at each load, before any file is read as a model."""
    store, pin = ModelStore(str(tmp_path / "m")), published(tmp_path, "v1", b"no real weights")
    Installer(store, pin).ensure()
    (tmp_path / "m/v1/model.onnx").write_bytes(b"tampered")
    with pytest.raises(ValueError, match="not those of the pin"):
        OnnxDetector(store.resolved(), "a", pin=pin).session()
    (tmp_path / "m/v1/model.onnx").write_bytes(b"no real weights")
    with pytest.raises(Exception) as e:  # now the files are the pin's, and no model
        OnnxDetector(store.resolved(), "b", pin=pin).session()
    assert "not those of the pin" not in str(e.value)
    (tmp_path / "m/v1/model.onnx").write_bytes(b"tampered")
    assert OnnxDetector(store.resolved(), "c", pin=pin)(spark.createDataFrame([("k@l.mn",)], "text string"), "text").first().spans is None


def test_http_download(tmp_path):
    """Over any opener: progress in pieces, hashes checked, a refused address is a failure."""
    pin, seen = published(tmp_path, "v1", os.urandom(3_000_000)), []
    content = open(pin.url.removeprefix("file://"), "rb").read()
    remote = pin.relocated("https://models.invalid/v1.tar.gz")
    assert remote.archive_sha256 == pin.archive_sha256
    opened = lambda url, timeout: io.BytesIO(content)
    assert Installer(ModelStore(str(tmp_path / "m")), remote, opener=opened).ensure(on_progress=seen.append) == "installed"
    assert len(seen) >= 3 and seen == sorted(seen) and seen[-1] == 1

    def refused(url, timeout):
        raise urllib.error.HTTPError(url, 404, "gone", {}, None)

    def unreachable(url, timeout):
        raise urllib.error.URLError("no route")

    for opener, kind in ((refused, "download"), (unreachable, "offline"), (lambda url, timeout: io.BytesIO(content[:-9]), "download")):
        with pytest.raises(InstallError, match=kind):
            Installer(ModelStore(str(tmp_path / "n")), remote, opener=opener).ensure()
    assert not os.listdir(tmp_path / "n")


def test_partial_files_are_swept_by_age(tmp_path):
    old, new, other = (tmp_path / x for x in (".download-a", ".staging-b", "v1"))
    for x in (old, new, other):
        x.mkdir()
    now = time.time()
    os.utime(old, (now - PARTIAL_AGE - 5,) * 2)
    os.utime(other, (0, 0))
    Installer(ModelStore(str(tmp_path)), published(tmp_path, "v2")).sweep(now)
    assert not old.exists() and new.exists() and other.exists()


def test_volumes_and_kinds_of_failure(tmp_path):
    assert same_volume(str(tmp_path), str(tmp_path / "not/yet/here")) and not same_volume("/proc", str(tmp_path))
    made = [OSError(errno.ENOSPC, ""), PermissionError(errno.EACCES, ""), TimeoutError(), urllib.error.URLError(OSError(errno.ENOSPC, "")), ValueError(), InstallError("offline")]
    assert [classify(e) for e in made] == ["space", "permission", "offline", "space", "download", "offline"]


def test_pointer_and_overrides(tmp_path):
    store = ModelStore(str(tmp_path / "m"))
    for v in ("v1", "v2"):
        Installer(store, published(tmp_path, v)).ensure()
    assert store.promoted().endswith("v2")
    link = ModelStore(str(tmp_path / "l"))
    (tmp_path / "l").mkdir()
    os.symlink("v7", tmp_path / "l/current")
    assert link.promoted().endswith("v7")
    (tmp_path / "m/current").write_text("../v1")
    assert store.promoted() is None
    assert ModelStore(str(tmp_path / "m"), overrides=(str(tmp_path / "none"), str(tmp_path / "m/v1"))).resolved().endswith("v1")


def onnx_stub(calls, steps):
    """A clock that moves by what each call of the model takes."""
    now = [0.0]

    def run(inputs, left):
        calls.append(left)
        now[0] += steps[min(len(calls), len(steps)) - 1]
        return np.full((inputs["text_lengths"][0][0], 12, 1), -9.0)

    return run, lambda: now[0]


def test_a_pass_ends_at_its_deadline():
    text, encode = " ".join(["word"] * 900), lambda ws: [[1]] * len(ws)
    calls = []
    run, clock = onnx_stub(calls, (2.0, 2.0, 2.0, 2.0))
    detector = OnnxDetector("x", labels=("address",), max_sequence=300, timeout=5.0)
    with pytest.raises(Late):
        detector.detect(text, run, encode, clock)
    assert calls == [5.0, 3.0, 1.0]  # no fourth window is begun
    run, clock = onnx_stub([], (1.0,))
    assert detector.detect(text, run, encode, clock) == []
    run, clock = onnx_stub(calls := [], (99.0,))
    assert OnnxDetector("x", labels=("address",), max_sequence=300).detect(text, run, encode, clock) == [] and set(calls) == {None}

    def ended(inputs, left):
        raise RuntimeError("the call was told to end")

    late = iter([0.0, 0.0, 9.0])
    with pytest.raises(Late):
        detector.detect(text, ended, encode, lambda: next(late))
    with pytest.raises(RuntimeError):
        detector.detect(text, ended, encode, lambda: 0.0)


def test_texts_over_the_model_s_limits_are_dropped():
    encode = lambda ws: [[1] * len(w) for w in ws]
    run = lambda inputs, left: np.full((inputs["text_lengths"][0][0], 12, 1), -9.0)
    detect = OnnxDetector("x", labels=("id",), max_input_tokens=50, max_sequence=30).detect
    assert detect("ab cd", run, encode) == [] and detect("", run, encode) == [] and detect("  ", run, encode) == []
    assert detect("a" * 51, run, encode) is None  # all together
    assert detect("a" * 30, run, encode) is None  # one word alone
    assert detect("abcd " * 12, run, encode) == []  # in several windows


def varint(n):
    out = bytearray()
    while True:
        out.append(n & 127 | (128 if n > 127 else 0))
        n >>= 7
        if not n:
            return bytes(out)


def field(number, value):
    """One field of a protocol buffer: an integer, or bytes (text, a message)."""
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def tiny_model():
    """An ONNX file whose logits are 5 for spans of one word and -5 or less for others: 5 - 10 (end - start), as (1, words, 12, 1)."""
    node = lambda op, into, out, *attributes: field(1, b"".join(field(1, x) for x in into) + field(2, out) + field(4, op) + b"".join(field(5, x) for x in attributes))
    number = lambda name, i: field(1, name) + field(3, i) + field(20, 2)
    tensor = lambda name, kind, dims, array: field(5, b"".join(field(1, d) for d in dims) + field(2, kind) + field(8, name) + field(9, array.tobytes()))
    value = lambda name, kind, rank: field(1, name) + field(2, field(1, field(1, kind) + field(2, b"".join(field(1, field(2, f"{name}{i}")) for i in range(rank)))))
    nodes = [
        node("Gather", ["span_idx", "zero"], "starts", number("axis", 2)), node("Gather", ["span_idx", "one"], "ends", number("axis", 2)),
        node("Sub", ["starts", "ends"], "shorter"), node("Cast", ["shorter"], "width", number("to", 1)), node("Mul", ["width", "ten"], "scaled"),
        node("Add", ["scaled", "five"], "flat"), node("Reshape", ["flat", "shape"], "logits"),
    ]
    held = [tensor("zero", 7, [], np.array(0)), tensor("one", 7, [], np.array(1)), tensor("ten", 1, [], np.array(10, "f4")), tensor("five", 1, [], np.array(5, "f4")), tensor("shape", 7, [4], np.array([1, -1, 12, 1]))]
    ranks = {"input_ids": 2, "attention_mask": 2, "words_mask": 2, "text_lengths": 2, "span_idx": 3, "span_mask_int64": 2}
    graph = b"".join(nodes) + field(2, "g") + b"".join(held) + b"".join(field(11, value(k, 7, r)) for k, r in ranks.items()) + field(12, value("logits", 1, 4))
    return field(1, 8) + field(7, graph) + field(8, field(1, "") + field(2, 13))


def test_a_model_file_from_pin_to_masked_text(tmp_path, spark):
    """A real session and tokenizer: installed from a pin, checked at load, run in Python workers, and by the command line."""
    from public_tokenizers import path as public
    from umbraframe import cli
    from umbraframe.operators import masking

    files = {"model.onnx": tiny_model(), "tokenizer.json": open(public("byte_bpe_50k.json"), "rb").read(), "tokenizer_config.json": b"{}"}
    archive = tmp_path / "m.tar.gz"
    with tarfile.open(archive, "w:gz") as t:
        for name, content in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(content)
            t.addfile(info, io.BytesIO(content))
    sha = {k: hashlib.sha256(v).hexdigest() for k, v in files.items()}
    pin = ModelPin("v1", archive.as_uri(), hashlib.sha256(archive.read_bytes()).hexdigest(), sha["model.onnx"], archive.stat().st_size, file_sha256=sha)
    store = ModelStore(str(tmp_path / "s"))
    assert Installer(store, pin).ensure() == "installed"
    detector = OnnxDetector(store.resolved(), "v1", labels=("address",), pin=pin, timeout=60.0)
    rows = [(1, ["red (blue)", "👍 green"]), (2, ["x " * 1500]), (3, [""])]
    got = {r.id: r for r in masking.mask_fields(spark.createDataFrame(rows, "id int, fields array<string>"), detector=detector).collect()}
    assert got[1].masked_fields == ["[ADDRESS_1] ([ADDRESS_2])", "👍 [ADDRESS_3]"] and got[1].restore == {"[ADDRESS_1]": "red", "[ADDRESS_2]": "blue", "[ADDRESS_3]": "green"}
    assert got[2].status == "send" and got[2].masked_fields[0].endswith("[ADDRESS_1499] [ADDRESS_1500] ") and got[3].masked_fields == [""]
    late = OnnxDetector(store.resolved(), "v1", labels=("address",), pin=pin, timeout=1e-9)
    assert [r.status for r in masking.mask_fields(spark.createDataFrame(rows, "id int, fields array<string>"), detector=late).orderBy("id").collect()] == ["drop_timed_out"] * 3
    assert masking.probe_run(spark, detector, "red at 10.1.1.1", ("red", "10.1.1.1", "none")) == (True, 2)
    manifest = {"version": "v1", "sourceURL": pin.url, "archiveSHA256": pin.archive_sha256, "weightsSHA256": sha["model.onnx"], "bytes": 9, "maxWidth": 12, "maxSequenceLength": 768, "files": {"tokenizerSHA256": sha["tokenizer.json"]}}
    (tmp_path / "m.json").write_text(json.dumps(manifest))
    # This model knows one label where the command line asks for 17: the text is dropped, not guessed at.
    assert cli.main(["-", str(tmp_path / "out"), "--model", store.resolved(), "--manifest", str(tmp_path / "m.json")], spark, io.StringIO("no secret")) == 2


def test_inputs_and_decoding():
    x = build_inputs([[7, 8], [9]], [[3, 4], [5]], 3)
    assert x["input_ids"].tolist() == [[CLS, ENTITY, 7, 8, ENTITY, 9, ENTITY_END, 3, 4, 5, SEP]]
    assert x["words_mask"].tolist() == [[0] * 7 + [1, 0, 2, 0]] and x["span_idx"].shape == (1, 6, 2)
    assert x["span_mask_int64"].tolist() == [[1, 1, 0, 1, 0, 0]]
    logits = np.full((2, 3, 2), -9.0)
    logits[0, 1, 1] = logits[1, 1, 0] = 4
    assert decode_window(logits, 2, 2, 0.1, 3) == [(0, 1, 1)]


def test_detector_fails_closed(spark):
    df = spark.createDataFrame([("k@l.mn",)], "text string")
    assert OnnxDetector("/no/such/model")(df, "text").first().spans is None
    found = OnnxDetector("x", labels=("email address",), max_width=2).detect("to k@l.mnop 👋", lambda i, left: np.where(np.arange(3 * 2) == 2, 5.0, -5.0), lambda ws: [[1]] * len(ws))
    assert found == [{"start": 3, "end": 11, "label": "email address"}]
