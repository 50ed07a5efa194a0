"""Command line: mask and audit a folder, build an index of approved texts, ask it, see whether a model answers.

A model is a function of the form package.module:name that takes a prompt and a schema and returns text; without one none is asked.
"""

from __future__ import annotations

import argparse
import importlib
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from redactica.operators import audit, cascade, dictionary, retrieval
from redactica.sources import local_model, readers, writers


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="redactica")
    verbs = parser.add_subparsers(dest="verb", required=True)
    for verb, *names in (("mask", "source", "target"), ("audit", "source"), ("build-index", "source", "target"), ("ask", "index", "question"), ("model-status",), ("warm-up", "model")):
        p = verbs.add_parser(verb)
        for n in names:
            p.add_argument(n)
        if verb == "mask":
            p.add_argument("--dictionary")
        if verb == "ask":
            p.add_argument("--top", type=int, default=3)
        if verb == "warm-up":
            p.add_argument("--url", default=local_model.DEFAULT)
        if verb in ("ask", "model-status"):
            p.add_argument("--client")
    args = parser.parse_args(argv)
    if args.verb == "warm-up":
        print(local_model.LocalModel(args.model, args.url).warm_up())
        return 0
    spark = spark or SparkSession.builder.appName("redactica").getOrCreate()
    year = datetime.now(timezone.utc).year
    if args.verb in ("mask", "audit"):
        docs = readers.files(spark, args.source).withColumn("doc_id", F.xxhash64("path"))
    if args.verb == "mask":
        terms = dictionary.load(spark, args.dictionary) if args.dictionary else None
        writers.masked_table(cascade.masked(docs, year, terms=terms), args.target)
    elif args.verb == "audit":
        for r in audit.findings(docs.filter("text is not null"), F.col("text"), year, ["path"]).select("path", "total", "status", "risk_level").toLocalIterator():
            print(*r, sep="\t")
    elif args.verb == "build-index":
        writers.knowledge_index(retrieval.chunks(readers.approved(spark, args.source)), args.target)
    elif args.verb == "model-status":
        print(_asked("Say yes.", args.client)[1] or "available")
    else:
        texts = readers.knowledge_index(spark, args.index)
        asked = spark.createDataFrame([(1, args.question)], "q_id int, question string")
        found = retrieval.top_k(retrieval.token_index(texts), asked, args.top).cache()
        prompt = retrieval.prompts(asked, found, texts).first()
        answer, error = _asked(prompt.prompt, args.client) if prompt else (None, None)
        said = spark.createDataFrame([(1, answer, None if error == "disabled" else error)], "q_id int, answer string, error string")
        print(retrieval.formatted(retrieval.answers(asked, found, said)).first().text)
    return 0


def _asked(prompt: str, client: str | None) -> tuple[str | None, str | None]:
    """(answer, None), or (None, why there is none)."""
    if not client:
        return None, "disabled"
    module, _, name = client.partition(":")
    try:
        return getattr(importlib.import_module(module), name)(prompt, {}), None
    except TimeoutError:
        return None, "timeout"
    except ConnectionError:
        return None, "service_unavailable"
    except Exception:  # noqa: BLE001  nothing of its message gets out
        return None, "processing_error"


if __name__ == "__main__":
    raise SystemExit(main())
