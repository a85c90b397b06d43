"""Detectors: each adds a column ``spans`` (array<struct<start,end,label>>, null on failure) beside a text column.

``RuleDetector`` finds a few labels by patterns; it stands in where no model weights are at hand and is no measure of
a model's recall. ``LogitsDetector`` decodes scores that a model has given. ``OnnxDetector`` runs a span model.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbraframe.functions import spans as S
from umbraframe.functions.shipping import ship
from umbraframe.functions.words import EMOJI_PYTHON, MAX_WIDTH, NEUTRAL, found_words, plan, preamble_length
from umbraframe.logs import LOG
from umbraframe.sources.models import ModelPin, verified

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: label -> pattern, in the order in which ties are resolved. They read alike in Java, RE2 and Python.
RULES = {
    "email address": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip address": rf"\b{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}\b",
    "phone number": r"\+[0-9]{1,2} \([0-9]{3}\) [0-9]{3}-[0-9]{4}",
    "access token": r"[0-9a-f]{40}",
}
#: pattern -> (one with the same matches that never starts inside a run nor gives back, so it is linear in unbroken text; what each match holds).
_LOCAL = "[A-Za-z0-9._%+-]"
FASTER = {
    RULES["email address"]: (rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    # Java's \b counts other letters than ASCII's.
    RULES["ip address"]: (rf"(?<![0-9A-Za-z_]){_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}(?![0-9A-Za-z_])", "."),
    RULES["phone number"]: (RULES["phone number"], "+"),
}
THRESHOLD = 0.1
MAX_INPUT_TOKENS = 2_000
MAX_SEQUENCE = 768
# The model's special token ids.
CLS, SEP, ENTITY, ENTITY_END = 1, 2, 128001, 128002


class Detector(Protocol):
    def __call__(self, df: DataFrame, text_col: str) -> DataFrame: ...


def pattern_spans(text: Column, pattern: str, label: str) -> Column:
    faster, held = FASTER.get(pattern, (pattern, None))
    found = F.transform(S.matches(text, faster), lambda m: S.span(m["start"], m["end"], F.lit(label)))
    return found if held is None else F.when(text.contains(held), found).when(text.isNotNull(), S.none())


def distinct_keys(labels: tuple[str, ...]) -> tuple[str, ...]:
    """The labels; refused where two have one placeholder key, or one has none, as their originals could not be told apart."""
    keys = [S.label_key(x) for x in labels]
    if not all(keys) or len(set(keys)) < len(keys):
        raise ValueError("labels whose placeholder keys are empty or collide")
    return labels


@dataclass(frozen=True)
class RuleDetector:
    rules: dict[str, str] = field(default_factory=lambda: dict(RULES))

    def __post_init__(self):
        distinct_keys(tuple(self.rules))

    def __call__(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        text = F.coalesce(F.col(text_col), F.lit(""))
        return df.withColumn("spans", F.concat(*[pattern_spans(text, p, k) for k, p in self.rules.items()]))


def sigmoid32(x: Column) -> Column:
    """The logistic function, rounded to 32 bits, as scores are compared at that width."""
    return (1 / (1 + F.exp(-x.cast("float")))).cast("float")


def decode_logits(scores: DataFrame, words: DataFrame, labels: tuple[str, ...], threshold: float = THRESHOLD) -> DataFrame:
    """(id, start, end, label, score) over the threshold (strictly).

    scores: id, window, first_word, n_words (of the window), start_word, width, label_index, logit; words: id, pos, start, end. Where
    words has a column is_emoji, spans of emoji only are dropped.
    """
    label_of = F.array(*[F.lit(x) for x in labels])
    kept = (
        scores.withColumn("score", sigmoid32(F.col("logit")))
        .filter((F.col("score") > F.lit(threshold).cast("float")) & (F.col("start_word") + F.col("width") < F.col("n_words")))
        .withColumn("a", F.col("first_word") + F.col("start_word"))
        .withColumn("b", F.col("a") + F.col("width"))
    )
    if "is_emoji" in words.columns:  # words that are no emoji up to and before each word: a span has one if they differ
        upto = F.sum((~F.col("is_emoji")).cast("int")).over(Window.partitionBy("id").orderBy("pos"))
        words = words.withColumn("_upto", upto).withColumn("_before", F.col("_upto") - (~F.col("is_emoji")).cast("int"))
    else:
        words = words.withColumn("_before", F.lit(0)).withColumn("_upto", F.lit(1))
    a = words.select("id", F.col("pos").alias("a"), "start", "_before")
    b = words.select("id", F.col("pos").alias("b"), "end", "_upto")
    return kept.join(a, ["id", "a"]).join(b, ["id", "b"]).filter("_upto > _before").select("id", "start", "end", F.element_at(label_of, F.col("label_index") + 1).alias("label"), "score", "window", "start_word", "width", "label_index")


def decode_rows(windows: DataFrame, labels: tuple[str, ...], threshold: float = THRESHOLD, max_width: int = MAX_WIDTH) -> DataFrame:
    """(id, start, end, label, score, start_word, width, label_index): :func:`decode_logits` of windows that are a row each, with no shuffle.

    windows: id, logits (array by start word x width x label), and arrays of their words' starts, ends and is_emoji.
    """
    # Outer: an inner explode would have its input's size tested first, by expressions evaluated anew.
    cells = (
        windows.select("id", "starts", "ends", "is_emoji", F.posexplode_outer("logits").alias("i", "logit"))
        .withColumn("score", sigmoid32(F.col("logit")))
        .withColumn("start_word", F.expr(f"CAST(i DIV {len(labels) * max_width} AS INT)"))
        .withColumn("width", F.expr(f"CAST(i DIV {len(labels)} % {max_width} AS INT)"))
    )
    end_word = F.col("start_word") + F.col("width")
    # Coalesced, as a test that needs its column would have that tested for null first, anew too.
    has_word = F.coalesce(F.array_contains(F.slice("is_emoji", F.col("start_word") + 1, F.col("width") + 1), False), F.lit(False))
    kept = cells.filter((F.col("score") > F.lit(threshold).cast("float")) & (end_word < F.size("ends"))).filter(has_word)
    kept = kept.withColumn("label_index", F.col("i") % len(labels)).withColumn("label", F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("label_index") + 1))
    return kept.select("id", F.col("starts")[F.col("start_word")].alias("start"), F.col("ends")[end_word].alias("end"), "label", "score", "start_word", "width", "label_index")


@dataclass(frozen=True)
class LogitsDetector:
    """From a column of logits ((start word x width x label) of one window a row) and one of words with offsets."""

    labels: tuple[str, ...] = S.LABELS
    threshold: float = THRESHOLD
    max_width: int = MAX_WIDTH
    logits_col: str = "logits"
    words_col: str = "words"

    def __post_init__(self):
        distinct_keys(self.labels)

    def __call__(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        n, w, words = len(self.labels), self.max_width, F.col(self.words_col)
        label_of = F.array(*[F.lit(x) for x in self.labels])

        def decoded(x, i):
            width, start = F.floor(i / n) % w, F.floor(i / (n * w))
            end = start + width
            fits = (sigmoid32(x) > F.lit(self.threshold).cast("float")) & (end < F.size(words))
            return F.when(fits, S.span(F.try_element_at(words, (start + 1).cast("int"))["start"], F.try_element_at(words, (end + 1).cast("int"))["end"], F.element_at(label_of, (i % n + 1).cast("int"))))

        return df.withColumn("spans", F.filter(F.transform(F.col(self.logits_col), decoded), lambda s: s.isNotNull()))


# ---- model inputs


def build_inputs(label_ids: list[list[int]], word_ids: list[list[int]], max_width: int = MAX_WIDTH) -> dict[str, np.ndarray]:
    """The int64 tensors of one window."""
    ids = [CLS]
    for x in label_ids:
        ids += [ENTITY, *x]
    ids.append(ENTITY_END)
    mask = [0] * len(ids)
    for k, x in enumerate(word_ids, 1):
        ids += x
        mask += [k if i == 0 else 0 for i in range(len(x))]
    ids.append(SEP)
    mask.append(0)
    n = len(word_ids)
    start = np.repeat(np.arange(n), max_width)
    end = start + np.tile(np.arange(max_width), n)
    as_row = lambda x: np.array([x], np.int64)
    return {
        "input_ids": as_row(ids), "attention_mask": np.ones((1, len(ids)), np.int64), "words_mask": as_row(mask), "text_lengths": np.array([[n]], np.int64),
        "span_idx": np.stack([start, end], 1)[None].astype(np.int64), "span_mask_int64": (end < n)[None].astype(np.int64),
    }


def decode_window(logits: np.ndarray, n_words: int, labels: int, threshold: float, max_width: int = MAX_WIDTH) -> list[tuple[int, int, int]]:
    """(first word, last word, label index) over the threshold, by start, width and label."""
    x = logits.reshape(-1)[: n_words * max_width * labels].reshape(n_words, max_width, labels).astype(np.float32)
    hit = np.argwhere(1 / (1 + np.exp(-x)) > np.float32(threshold))
    return [(int(s), int(s + w), int(k)) for s, w, k in hit if s + w < n_words]


_SESSIONS: dict[tuple[str, str], tuple] = {}


class Late(Exception):
    """A pass went over its time."""


@dataclass(frozen=True)
class OnnxDetector:
    """A span model in Arrow batches. Any failure of a row gives null spans, never a guess; a missing model fails all rows.

    With a ``pin`` the files' hashes are checked at each load, before the first row. With a ``timeout`` in seconds (off by default,
    as its outcome depends on the machine) a row's pass ends at a window's end or within the model's call, and ``_timed_out`` is true.
    """

    model_dir: str
    version: str = ""
    labels: tuple[str, ...] = S.LABELS
    threshold: float = THRESHOLD
    max_input_tokens: int = MAX_INPUT_TOKENS
    max_sequence: int = MAX_SEQUENCE
    max_width: int = MAX_WIDTH
    pin: ModelPin | None = None
    timeout: float | None = None

    def __post_init__(self):
        distinct_keys(self.labels)

    def session(self) -> tuple:
        """(session, tokenizer) of this Python worker, loaded again when the version changes. Only files of the pin are loaded."""
        key = (self.model_dir, self.version)
        if key not in _SESSIONS:
            if self.pin is not None and not verified(self.model_dir, self.pin):
                LOG.error("the model's files are not those of the pin %s", self.pin.version)
                raise ValueError("the model's files are not those of the pin")
            import onnxruntime
            from tokenizers import Tokenizer

            options = onnxruntime.SessionOptions()
            options.intra_op_num_threads = 1  # partitions give the parallelism
            _SESSIONS.clear()
            _SESSIONS[key] = (onnxruntime.InferenceSession(f"{self.model_dir}/model.onnx", options), Tokenizer.from_file(f"{self.model_dir}/tokenizer.json"))
        return _SESSIONS[key]

    def runner(self, session):
        """run(inputs, seconds left or None): the model's logits; past that time the call is told to end."""
        import onnxruntime

        def run(inputs, left):
            if left is None:
                return session.run(None, inputs)[0]
            options = onnxruntime.RunOptions()
            watch = threading.Timer(left, lambda: setattr(options, "terminate", True))
            watch.start()
            try:
                return session.run(None, inputs, options)[0]
            finally:
                watch.cancel()

        return run

    def detect(self, text: str, run, encode, clock=time.monotonic) -> list[dict] | None:
        """Spans of one text; run(inputs, seconds left) gives logits, encode(words) the ids of each. Raises :class:`Late`."""
        deadline = None if self.timeout is None else clock() + self.timeout
        found = found_words([text])[0].as_py()
        if not found:
            return []
        emoji = [bool(EMOJI_PYTHON.fullmatch(w["text"])) for w in found]
        ids = encode([NEUTRAL if e else w["text"] for w, e in zip(found, emoji, strict=True)])
        label_ids = encode(list(self.labels))
        counts = [len(x) for x in ids]
        windows = None if sum(counts) > self.max_input_tokens else plan(counts, self.max_sequence - preamble_length([len(x) for x in label_ids]), self.max_width)
        if windows is None:
            return None
        out = []
        for first, last in windows:
            left = None if deadline is None else deadline - clock()
            if left is not None and left <= 0:
                raise Late
            inputs = build_inputs(label_ids, ids[first:last], self.max_width)
            if inputs["input_ids"].shape[1] > self.max_sequence:
                return None
            try:
                logits = run(inputs, left)
            except Exception as e:
                if deadline is not None and clock() >= deadline:
                    raise Late from e
                raise
            for a, b, k in decode_window(logits, last - first, len(self.labels), self.threshold, self.max_width):
                if not all(emoji[first + a : first + b + 1]):
                    out.append({"start": found[first + a]["start"], "end": found[first + b]["end"], "label": self.labels[k]})
        if deadline is not None and clock() > deadline:
            raise Late
        return out

    def __call__(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        ship(df.sparkSession)

        @F.pandas_udf(f"struct<spans:{S.SPANS},late:boolean>")
        def detected(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            try:
                session, tokenizer = self.session()
                run = self.runner(session)
            except Exception as e:  # no model: every row fails closed
                LOG.error("no model could be loaded: %s", type(e).__name__)
                session = None

            def one(text):
                if session is None or text is None:
                    return None, False
                try:
                    return self.detect(text, run, lambda ws: [e.ids for e in tokenizer.encode_batch(ws, add_special_tokens=False)]), False
                except Late:
                    return None, True
                except Exception as e:  # the row fails closed
                    LOG.warning("a row failed: %s", type(e).__name__)
                    return None, False

            for texts in batches:
                yield pd.DataFrame([one(t) for t in texts], columns=["spans", "late"])

        return df.withColumn("_detected", detected(F.col(text_col))).withColumn("spans", F.col("_detected.spans")).withColumn("_timed_out", F.col("_detected.late")).drop("_detected")
