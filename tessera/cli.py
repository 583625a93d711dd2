"""python -m tessera.cli: build, query, benchmark, and the verbs of a collection.

Exit codes: 0 done, 1 the collection refused, 2 wrong arguments.
"""

from __future__ import annotations

import argparse
import fcntl
import json
import sys
from contextlib import contextmanager
from pathlib import Path

from tessera.errors import TesseraError

VERBS = ("ping", "stats", "snapshot", "delete", "get", "insert-text", "replace-text", "search-text", "insert-vec", "replace-vec", "search-vec")
HELP = ":stats :ping :get ID :insert TEXT :replace ID TEXT :delete ID :snapshot :help :q; anything else is searched for"


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tessera")
    sub = out.add_subparsers(dest="command", required=True)

    def command(name: str) -> argparse.ArgumentParser:
        own = sub.add_parser(name)
        own.add_argument("--config", required=name != "benchmark")
        own.add_argument("--format", choices=("text", "tsv", "json"), default="text")
        own.add_argument("--top-k", type=int, default=10 if name == "benchmark" else 5)
        own.add_argument("--ef", type=int)
        own.add_argument("--method", choices=("exact", "graph"), default="exact")
        return own

    command("build").add_argument("texts", help="a folder with *.txt files")
    taken = command("import")
    taken.add_argument("vectors", help="a file of vectors of another program")
    taken.add_argument("--names")
    taken.add_argument("--log")
    command("query")
    bench = command("benchmark")
    bench.add_argument("--dataset", help="a folder with *base.fvecs and *query.fvecs")
    for name, default in (("--dim", 128), ("--base", 10_000), ("--queries", 100)):
        bench.add_argument(name, type=int, default=default)
    for name, default in (("--seed", 1), ("--warmup", 1), ("--batches", 10), ("--m", 16), ("--ef-construction", 200)):
        bench.add_argument(name, type=int, default=default)
    bench.add_argument("--validate", type=float, help="the least recall; a lower one is an error")
    bench.add_argument("--against", help="a report in JSON to compare with")
    for verb in VERBS:
        own = command(verb)
        if verb in ("delete", "get", "replace-text", "replace-vec"):
            own.add_argument("id", type=int)
        if verb.endswith("-text"):
            own.add_argument("text")
        if verb.endswith("-vec"):
            own.add_argument("--vec")
            own.add_argument("--vec-file")
    return out


@contextmanager
def locked(folder: str):
    """One writer at a time in a local data folder."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    with open(f"{folder}/LOCK", "w") as file:
        try:
            fcntl.flock(file, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError as e:
            raise SystemExit(f"{folder} is in use") from e
        yield


def shown(results: list[tuple[int, float, str]], form: str) -> str:
    if form == "json":
        return json.dumps([{"id": i, "dist": round(d, 6), "name": n} for i, d, n in results])
    line = "{}\t{:.6f}\t{}" if form == "tsv" else "{:>8}  {:.6f}  {}"
    return "\n".join(line.format(*r) for r in results)


def repl(collection, lines, out, args) -> None:
    for line in lines:
        line = line.strip()
        verb, _, rest = line.partition(" ")
        try:
            if not line:
                continue
            if verb == ":q":
                return
            if verb == ":help":
                print(HELP, file=out)
            elif verb == ":ping":
                print("pong", file=out)
            elif verb == ":stats":
                print(json.dumps(collection.stats()), file=out)
            elif verb == ":get":
                print(json.dumps(dict(zip(("name", "vec"), collection.get(int(rest))))), file=out)
            elif verb == ":insert":
                print(collection.insert_text(rest), file=out)
            elif verb == ":replace":
                row, _, text = rest.partition(" ")
                collection.replace_text(int(row), text)
                print("ok", file=out)
            elif verb == ":delete":
                collection.delete(int(rest))
                print("ok", file=out)
            elif verb == ":snapshot":
                print(collection.snapshot(), file=out)
            elif verb.startswith(":"):
                print(f"unknown: {verb}; {HELP}", file=out)
            else:
                print(shown(collection.search_text(line, args.top_k, args.ef, args.method), args.format), file=out)
        except (TesseraError, ValueError) as e:
            print(f"error: {getattr(e, 'status', 'invalid')}: {e}", file=out)


def run_benchmark(spark, args) -> dict:
    """Builds and searches a graph, with the time of each phase and percentiles over batches of queries."""
    import time

    from pyspark.sql import functions as F

    from tessera.functions.vectors import random_unit_vectors
    from tessera.operators import exact, graph, report
    from tessera.sources.vectorfiles import read_dataset

    phases = {}

    def timed(name: str, work):
        began = time.perf_counter_ns()
        out = work()
        phases[name] = time.perf_counter_ns() - began
        return out

    def load():
        truth = None
        if args.dataset:
            base, queries, truth = read_dataset(spark, args.dataset)
        else:
            base = random_unit_vectors(spark, args.base, args.dim, args.seed)
            queries = random_unit_vectors(spark, args.queries, args.dim, args.seed + 1).withColumnRenamed("id", "qid")
        base, queries = base.cache(), queries.cache()
        return base, queries, truth, base.count(), queries.count(), len(base.first().vec)

    base, queries, truth, n, q, dim = timed("load", load)
    k, ef = args.top_k, args.ef or 100
    edges = graph.build_graph(base, args.m, args.ef_construction, args.seed).cache()
    timed("build", edges.count)
    search = lambda some: graph.graph_search(edges, base, some, k, ef)
    for _ in range(args.warmup):
        timed("warm-up", search(queries).count)
    found = search(queries).cache()
    timed("search", found.count)
    batches = max(1, min(args.batches, q))
    samples = []
    for part in range(batches):
        some = queries.where(F.pmod(F.xxhash64("qid"), F.lit(batches)) == part)
        began = time.perf_counter_ns()
        search(some).count()
        samples.append((time.perf_counter_ns() - began,))
    width, most = 1_000_000, 600_000  # a millisecond to ten minutes
    histogram = report.histogram(spark.createDataFrame(samples, "ns long"), width, most).cache()
    shares = {r.share: r.ns for r in report.percentiles(histogram, width, [0.5, 0.9, 0.95, 0.99]).collect()}
    whole = report.summary(histogram, width, most).first()
    if truth is not None:
        truth = truth.select(F.col("id").alias("qid"), F.posexplode(F.slice("vec", 1, k)).alias("rk", "id")).select("qid", "rk", F.col("id").cast("long").alias("id"))
    exactly = timed("truth", lambda: (truth if truth is not None else exact.knn_join(base, queries, k)).cache())
    rate = exact.recall(exactly, found).agg(F.avg("recall")).first()[0]
    per_s = lambda ops, ns: spark.range(1).select(report.ops_per_second(F.lit(ops), F.lit(ns)).alias("x")).first().x
    out = {
        "schema": 3,
        "params": {"dim": dim, "base": n, "queries": q, "k": k, "ef_search": ef, "ef_construction": args.ef_construction, "m": args.m, "seed": args.seed, "warmup": args.warmup, "batches": batches},
        "phases_ns": phases,
        "build": {"wall_ns": phases["build"], "per_s": per_s(n, phases["build"])},
        "search": {"wall_ns": phases["search"], "per_s": per_s(q, phases["search"])},
        "batch_latency_ns": {f"p{round(x * 100)}": shares[x] for x in sorted(shares)} | {"mean": whole.mean_ns, "max": whole.max_ns, "overflow": whole.overflow},
        "recall_at_k": rate,
    }
    if args.validate is not None:
        out["valid"] = rate >= args.validate
    if args.against:
        with open(args.against, encoding="utf-8") as file:
            other = json.load(file)
        differ = report.misaligned(out["params"], other["params"])
        words = {x: report.ratio_words(out[x]["per_s"], other[x]["per_s"]) for x in ("build", "search")}
        out["against"] = {"differ": differ} if differ else words
    return out


def pretty(found: dict) -> str:
    """The report as lines of `name  value`."""
    lines = []

    def walk(prefix: str, value) -> None:
        if isinstance(value, dict):
            for k, v in value.items():
                walk(f"{prefix}.{k}" if prefix else k, v)
        else:
            lines.append((prefix, f"{value:.4f}" if isinstance(value, float) else str(value)))

    walk("", found)
    wide = max(len(k) for k, _ in lines)
    return "\n".join(f"{k:<{wide}}  {v}" for k, v in lines)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from tessera.functions.embedders import HttpModel
    from tessera.plans.collection import Collection
    from tessera.sources.config import Config, ConfigError
    from tessera.sources.vectorfiles import read_texts, vector_argument

    if args.command == "benchmark":
        found = run_benchmark(SparkSession.builder.getOrCreate(), args)
        print(json.dumps(found) if args.format == "json" else pretty(found))
        return 0 if found.get("valid", True) else 1
    try:
        config = Config.load(args.config)
    except (ConfigError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    spark = SparkSession.builder.getOrCreate()
    model = None if config.embedder.provider == "hash" else HttpModel(config.embedder.base_url, config.embedder.model)
    try:
        with locked(config.storage.data_dir):
            c = Collection(spark, f"file://{Path(config.storage.data_dir).resolve()}", config.embedder.dim, config.storage.max_vectors, config.server.max_text_bytes, model, ef_construction=config.index.ef_construction, max_ef=config.index.max_ef, seed=config.index.seed, snapshot_every=config.server.snapshot_every, normalize=config.embedder.normalize)
            c.verify()
            if args.command == "build":
                from pyspark.sql import functions as F

                from tessera.functions.embedders import embed

                rows = embed(read_texts(spark, args.texts).orderBy("id"), config.embedder.dim, model, normalize_to=config.embedder.normalize)
                print(c.build(rows.select("vec", F.col("name"))))
            elif args.command == "import":
                from tessera.sources.imports import read_collection

                print(c.take_over(read_collection(spark, args.vectors, args.names, args.log)))
            elif args.command == "query":
                repl(c, sys.stdin, sys.stdout, args)
            elif args.command in ("ping", "stats", "snapshot"):
                print(json.dumps({args.command: getattr(c, args.command)()}))
            elif args.command == "delete":
                c.delete(args.id)
            elif args.command == "get":
                name, vec = c.get(args.id)
                print(f"{args.id}\t{name}\t{','.join(map(str, vec))}" if args.format == "tsv" else json.dumps({"name": name, "vec": vec}))
            else:
                verb, _, kind = args.command.partition("-")
                value = args.text if kind == "text" else vector_argument(spark, c.dim, args.vec, args.vec_file)
                if verb == "search":
                    search = c.search_text if kind == "text" else c.search
                    print(shown(search(value, args.top_k, args.ef, args.method), args.format))
                elif verb == "insert":
                    print((c.insert_text if kind == "text" else c.insert)(value))
                else:
                    (c.replace_text if kind == "text" else c.replace)(args.id, value)
    except TesseraError as e:
        print(f"error: {e.status}: {e}", file=sys.stderr)
        return 1
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
