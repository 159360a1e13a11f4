"""Commands: train an index, score payloads, serve a folder.

    python -m tamarack train references.json INDEX --k 1700 --rounds 20
    python -m tamarack query payloads.json --index INDEX
    python -m tamarack serve IN OUT REJECTS CHECKPOINT --index INDEX

Settings that are not given come from IVF_PATH, NPROBE, FAST_NPROBE and WARMUP.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.index import IvfIndex
from .sources.payloads import read_references
from .streaming.scorer import Scorer, score_raw, stream_decisions


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tamarack")
    commands = p.add_subparsers(dest="command", required=True)
    train = commands.add_parser("train", help="references to a stored index")
    train.add_argument("references")
    train.add_argument("index")
    train.add_argument("--k", type=int, default=1700)
    train.add_argument("--rounds", type=int, default=20)
    train.add_argument("--dim", type=int, default=14)
    train.add_argument("--lines", action="store_true", help="JSON lines with ref_id instead of one array")
    query = commands.add_parser("query", help="decisions of a file of payloads, one JSON object a line")
    query.add_argument("payloads")
    serve = commands.add_parser("serve", help="score files as they arrive in a folder")
    for name in ("source", "sink", "rejects", "checkpoint"):
        serve.add_argument(name)
    serve.add_argument("--once", action="store_true", help="stop when all files are scored")
    serve.add_argument("--warm-up", help="a file of payloads to replay first")
    for command in (query, serve):
        command.add_argument("--index", help="default: IVF_PATH")
        command.add_argument("--nprobe", type=int)
        command.add_argument("--fast", type=int)
    return p


def lines(spark: SparkSession, path: str):
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("qid"), F.col("value").alias("body")).where(F.trim("body") != "")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    """Runs a command; returns the lines that it printed."""
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    out: list[str] = []
    if a.command == "train":
        refs = read_references(spark, a.references, a.dim, a.lines).withColumnRenamed("vector", "v")
        index = IvfIndex.build(refs, a.k, a.rounds)
        index.save(a.index)
        out.append(f"{int(index.list_sizes().sum())} vectors of {index.dim} values in {index.k} lists, scale {index.scale}")
    else:
        given = {"nprobe": a.nprobe, "fast_nprobe": a.fast}
        scorer = Scorer.load(spark, a.index, **{k: v for k, v in given.items() if v is not None})
        if a.command == "query":
            raw = lines(spark, a.payloads)
            good, _ = score_raw(raw, scorer.index, scorer.fast_nprobe, scorer.nprobe)
            answers = raw.select("qid").join(good, "qid", "left").orderBy("qid")
            out += [r.response or "bad request" for r in answers.toLocalIterator()]
        else:
            scorer.warm_up(lines(spark, a.warm_up) if a.warm_up else None)
            stream_decisions(spark, a.source, scorer, a.sink, a.rejects, a.checkpoint, once=a.once).awaitTermination()
            out.append(str(scorer.stats.snapshot()))
    print("\n".join(out))
    return out


if __name__ == "__main__":
    main()
