"""Queries over the test tables and their SQL."""

from __future__ import annotations

from umbraframe.functions.names import FULL, GIVEN_TOO
from umbraframe.functions.spans import LABELS
from umbraframe.plans import queries as q
from umbraframe.plans.sql import SQL as _SQL

QUERIES = {
    "words_with_offsets": q.words_with_offsets,
    "word_count_budget": q.word_count_budget,
    "window_plan": q.window_plan,
    "window_budget": q.window_budget,
    "preamble_lengths": q.preamble_lengths,
    "model_inputs": q.model_inputs,
    "neutral_words": q.neutral_words,
    "emoji_spans": q.emoji_spans,
    "detect_email": q.detect_label("email address"),
    "detect_ipv4": q.detect_label("ip address"),
    "detect_phone": q.detect_label("phone number"),
    "detect_token": q.detect_label("access token"),
    "trim_spans": q.trim_spans,
    "merge_spans": q.merge_spans,
    "protect_markers": q.protect_markers,
    "protect_exact": q.protect_exact,
    "valid_spans": q.valid_spans,
    "number_placeholders": q.number_placeholders,
    "mask_documents": q.mask_documents,
    "restore_map_rows": q.restore_map_rows,
    "restore_map_order": q.restore_map_order,
    "restore_roundtrip": q.restore_roundtrip,
    "restore_garbled_default": q.garbled(LABELS),
    "restore_garbled_any": q.garbled(None),
    "replies_join": q.replies_join,
    "join_split_fields": q.join_split_fields,
    "mask_fields_shared_map": q.mask_fields_shared_map,
    "separator_smuggle_drop": q.separator_smuggle_drop,
    "name_mask_full": q.name_mask(FULL),
    "name_mask_given": q.name_mask(GIVEN_TOO),
    "name_mask_transcript": q.name_mask_transcript,
    "logits_decode": q.logits_decode,
    "label_histogram": q.label_histogram,
    "probe_verdict": q.probe_verdict,
    "safe_component": q.safe_component,
    "pin_predecessor": q.pin_predecessor,
    "disk_budget": q.disk_budget,
    "file_digests": q.file_digests,
    "digest_compare": q.digest_compare,
    "progress": q.progress,
    "failure_kinds": q.failure_kinds,
    "pin_plausible": q.pin_plausible,
    "sql_functions": q.sql_functions,
    "decisions": q.decisions,
    "sanitize": q.sanitize,
    "mask_stream_smoke": q.mask_stream_smoke,
}
SQL = {k: v for k, v in _SQL.items() if k in QUERIES}
