"""Runs the dense array path over a grid of settings and reports its throughput and stages.

    python sweep.py --mib 64 --codecs none,lz4,zstd --sides 32,64 --reduce mean,max --fills xor,zeros,rand [--out results.jsonl]

Every run is a line of JSON in the results; a table in Markdown is printed at the end.  Runs that are in the results
already are not run again, so a sweep that was broken off goes on.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
from itertools import product

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402
from pyspark import StorageLevel  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tessella.operators.codec import encode  # noqa: E402
from tessella.operators.metrics import discard, timed  # noqa: E402
from tessella.operators.packed import packed_levels  # noqa: E402
from tessella.plans.geometry import ArrayPlan  # noqa: E402
from tessella.plans.spec import DTYPES, REDUCERS, ArraySpec, Codec, Dim, SpecError, dtype  # noqa: E402
from tessella.sources.store import objects  # noqa: E402

SIDE = 256
FILLS = ("xor", "zeros", "rand")
KEYS = ("codec", "side", "reduce", "fill", "dtype", "levels", "mib")


def plan_of(codec: str, side: int, reduce: str, kind: str, levels: bool, mib: int) -> ArrayPlan:
    name, _, level = codec.partition(":")
    frames = max(side, mib * (1 << 20) // (dtype(kind).nbytes * SIDE * SIDE) // side * side)
    dims = (Dim("z", frames, side, 4), Dim("y", SIDE, side, 4, downsample=levels), Dim("x", SIDE, side, 4, downsample=levels))
    return ArrayPlan(ArraySpec(dims, dtype=kind, reduce=reduce, codec=Codec(name, int(level) if level else None)))


def source(spark: SparkSession, plan: ArrayPlan, fill: str):
    """Chunks of a pattern, made chunk by chunk."""
    extents = plan.extents()
    side, counts, kind = extents[0].chunk, [e.chunk_count for e in extents], dtype(plan.spec.dtype).numpy

    def run(batches):
        z, y, x = np.ogrid[:side, :side, :side]
        for batch in batches:
            for i in batch.column(0).to_pylist():
                c = [i // (counts[1] * counts[2]), i // counts[2] % counts[1], i % counts[2]]
                if fill == "xor":
                    block = ((z + side * c[0]) ^ (y + side * c[1]) ^ (x + side * c[2])).astype(kind)
                elif fill == "rand":
                    block = np.random.default_rng(i).integers(0, 100, (side, side, side)).astype(kind)
                else:
                    block = np.zeros((side, side, side), kind)
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.list_(pa.int64())), pa.array([block.tobytes()], pa.binary())], names=["chunk", "payload"])

    n = counts[0] * counts[1] * counts[2]
    return spark.range(n, numPartitions=min(n, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(run, "chunk array<bigint>, payload binary"), n


def run(spark: SparkSession, setting: dict) -> dict:
    plan = plan_of(setting["codec"], setting["side"], setting["reduce"], setting["dtype"], setting["levels"], setting["mib"])
    chunks, n = source(spark, plan, setting["fill"])
    with timed(spark) as took:
        kept = encode(packed_levels(chunks, plan), plan.spec.codec, dtype(setting["dtype"]).nbytes).persist(StorageLevel.DISK_ONLY)
        discard(objects(kept, plan).select(F.octet_length("object").alias("n")))
        stored = kept.agg(F.sum(F.octet_length("data"))).first()[0]
        kept.unpersist()
    mib = n * plan.chunk_bytes / (1 << 20)
    stages = [{"name": s.name.partition(" at ")[0], "tasks": s.tasks, "seconds": round(s.seconds, 3), "cpu": round(s.cpu_seconds, 3), "shuffle": s.shuffle_written} for s in took.stages]
    return setting | {"seconds": round(took.seconds, 3), "mib_s": round(mib / took.seconds, 1), "ratio": round(mib * (1 << 20) / max(1, stored), 2), "stages": stages}


def table(results: list[dict]) -> str:
    head = [*KEYS, "mib_s", "ratio", "seconds"]
    lines = ["| " + " | ".join(head) + " |", "| " + " | ".join("---" for _ in head) + " |"]
    lines += ["| " + " | ".join(str(r[h]) for h in head) + " |" for r in sorted(results, key=lambda r: -r["mib_s"])]
    return "\n".join(lines)


def settings(args: argparse.Namespace) -> list[dict]:
    """The grid; a value that no run can have is an error before anything runs."""
    out = []
    for values in product(args.codecs.split(","), map(int, args.sides.split(",")), args.reduce.split(","), args.fills.split(","), args.dtypes.split(","), [not args.single], [args.mib]):
        s = dict(zip(KEYS, values))
        if s["fill"] not in FILLS or s["reduce"] not in REDUCERS or s["dtype"] not in DTYPES:
            raise SpecError(f"no such run: {s}")
        plan_of(s["codec"], s["side"], s["reduce"], s["dtype"], s["levels"], s["mib"]).check_shards()
        out.append(s)
    return out


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--mib", type=int, default=64)
    p.add_argument("--codecs", default="none,lz4,zstd:1")
    p.add_argument("--sides", default="32,64")
    p.add_argument("--reduce", default="mean")
    p.add_argument("--fills", default="xor")
    p.add_argument("--dtypes", default="u16")
    p.add_argument("--single", action="store_true", help="level 0 only")
    p.add_argument("--cpus", type=int, default=os.cpu_count())
    p.add_argument("--out", default=None)
    return p.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> list[dict]:
    args = arguments(argv)
    todo, results = settings(args), []
    if args.out and os.path.exists(args.out):
        with open(args.out) as f:
            results = [json.loads(line) for line in f]
    done = {tuple(r[k] for k in KEYS) for r in results}
    own = spark is None
    spark = spark or SparkSession.builder.master(f"local[{args.cpus}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", args.cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    for s in todo:
        if tuple(s[k] for k in KEYS) in done:
            continue
        began = time.time()
        results.append(run(spark, s))
        print(f"{results[-1]['mib_s']} MiB/s after {time.time() - began:.1f} s: {s}", file=sys.stderr)
        if args.out:
            with open(args.out, "a") as f:
                f.write(json.dumps(results[-1]) + "\n")
    print(table(results))
    if own:
        spark.stop()
    return results


if __name__ == "__main__":
    main()
