"""python -m umbraframe.cli IN OUT: masks text files ("-": standard input). Exit 0: done, 1: usage or no model, 2: nothing was produced."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from umbraframe.operators.detect import THRESHOLD, OnnxDetector, RuleDetector
from umbraframe.operators.masking import mask_fields
from umbraframe.sources.models import ModelPin, is_complete, verified
from umbraframe.sources.texts import read_stdin, read_texts, write_masked

TIMEOUT = 30.0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="umbraframe")
    p.add_argument("source")
    p.add_argument("out")
    p.add_argument("--model", default=os.environ.get("UMBRAFRAME_MODEL_DIR"))
    p.add_argument("--manifest", help="only the model that this file names is loaded")
    p.add_argument("--rules", action="store_true", help="patterns instead of a model")
    p.add_argument("--show-map", metavar="DIR", help="where to write originals")
    p.add_argument("--threshold", type=float, default=THRESHOLD)
    p.add_argument("--timeout", type=float, default=TIMEOUT, help="seconds for a text; it is dropped beyond them")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None, stdin=None) -> int:
    try:
        a = parser().parse_args(args)
        if a.timeout <= 0 or not 0 <= a.threshold <= 1:
            raise ValueError("the timeout must be positive and the threshold between 0 and 1")
        pin = ModelPin.from_json(a.manifest) if a.manifest else None
    except SystemExit as e:
        return 1 if e.code else 0
    except (OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    if not a.rules and not (a.model and is_complete(a.model) and (pin is None or verified(a.model, pin))):
        print("no complete model folder, or not that of the manifest", file=sys.stderr)
        return 1
    spark = spark or SparkSession.builder.getOrCreate()
    texts = read_stdin(spark, stdin or sys.stdin) if a.source == "-" else read_texts(spark, a.source)
    detector = RuleDetector() if a.rules else OnnxDetector(a.model, threshold=a.threshold, timeout=a.timeout, pin=pin)
    masked = mask_fields(texts.filter(~F.col("text").rlike(r"(?U)^\s*$")).select("path", F.array("text").alias("fields")), detector=detector)
    write_masked(masked, "path", a.out, a.show_map)
    n, sent = spark.read.parquet(a.out).agg(F.count(F.lit(1)), F.count_if(F.col("status") == "send")).first()
    return 2 if n and not sent else 0


if __name__ == "__main__":
    sys.exit(main())
