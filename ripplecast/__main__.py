"""python -m ripplecast prepare votes|reviews|synthetic|summary ..., python -m ripplecast run DATASET ..."""

from __future__ import annotations

import argparse
import re
import sys
from dataclasses import replace

from pyspark.sql import SparkSession

from ripplecast import experiments, reports
from ripplecast.operators import summary
from ripplecast.sources import datasets, social, synthetic


def numbers(text: str) -> tuple[int, ...]:
    return tuple(int(x) for x in re.split(r"[,\s]+", text.strip()) if x)


def methods(text: str) -> tuple[str, ...]:
    """Names whatever their case and marks; all or * names every one."""
    plain = lambda x: re.sub(r"[^a-z]", "", x.lower())
    if text.strip() in ("*", "all"):
        return experiments.METHODS
    known = {plain(m): m for m in experiments.METHODS}
    asked = [plain(x) for x in text.split(",") if x.strip()]
    unknown = [x for x in asked if x not in known]
    if unknown or not asked:
        raise argparse.ArgumentTypeError(f"unknown methods {unknown}; known: {', '.join(experiments.METHODS)}")
    return tuple(known[x] for x in dict.fromkeys(asked))


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="ripplecast")
    commands = out.add_subparsers(dest="command", required=True)
    prepare = commands.add_parser("prepare", help="raw files to a dataset folder")
    prepare.add_argument("kind", choices=["votes", "reviews", "synthetic", "summary"])
    prepare.add_argument("--raw", default="")
    prepare.add_argument("--out", default="")
    for name, default in (("users", 0), ("links", 0), ("items", 0), ("seed", 42)):
        prepare.add_argument(f"--{name}", type=int, default=default)
    run = commands.add_parser("run", help="an experiment on a dataset folder")
    run.add_argument("dataset")
    run.add_argument("--out", default="results")
    run.add_argument("--quick", action="store_true")
    run.add_argument("--methods", type=methods, default=experiments.METHODS)
    run.add_argument("--ks", type=numbers)
    run.add_argument("--z-grid", type=numbers, dest="z_grid")
    run.add_argument("--c-grid", type=numbers, dest="c_grid")
    run.add_argument("--sweeps", type=lambda x: tuple(s for s in x.split(",") if s))
    for name in ("C", "Z", "seed", "runs", "n_items", "topic_sweeps", "community_sweeps", "em_sweeps", "cap", "delta", "k_of_grids"):
        run.add_argument("--" + name.replace("_", "-"), type=int, dest=name)
    run.add_argument("--h", type=float)
    return out


def prepared(spark: SparkSession, args: argparse.Namespace) -> datasets.Dataset:
    sizes = {"users": args.users, "links": args.links, "items": args.items}
    if args.kind == "votes":
        friends, votes = social.find_vote_files(spark, args.raw)
        return social.prepare_votes(spark, friends, votes, **sizes)
    if args.kind == "reviews":
        return social.prepare_reviews(spark, args.raw, **sizes)
    return synthetic.generate(spark, args.users or 400, args.links or 4000, args.items or 200, 40, 10, 8, args.seed)


def main(argv: list[str] | None = None) -> int:
    """0; 2 where raw files are missing, 1 where no point came out."""
    args = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if args.command == "prepare":
        if args.kind == "summary":
            print(summary.table(datasets.load(spark, args.raw or args.out)))
            return 0
        try:
            ds = prepared(spark, args)
        except FileNotFoundError as e:
            print(e, file=sys.stderr)
            return 2
        datasets.save(ds, args.out)
        back = datasets.load(spark, args.out)
        if (back.meta["n_links"], back.meta["n_logs"]) != (ds.meta["n_links"], ds.meta["n_logs"]):
            print(f"{args.out} reads back otherwise than it was written", file=sys.stderr)
            return 1
        print(summary.table(back))
        return 0
    names = ("methods", "ks", "z_grid", "c_grid", "sweeps", "C", "Z", "seed", "runs", "n_items", "topic_sweeps", "community_sweeps", "em_sweeps", "cap", "delta", "k_of_grids", "h")
    config = replace(experiments.Config(), **{n: getattr(args, n) for n in names if getattr(args, n) is not None})
    results = experiments.prepare(spark, datasets.load(spark, args.dataset), config.quick() if args.quick else config).run()
    print("\n".join(reports.write(results, args.out)))
    got = (results.points is not None and results.points.where("status = 'ok'").limit(1).count()) or any(g.where("status = 'ok'").limit(1).count() for g in results.grids.values())
    return 0 if got else 1


if __name__ == "__main__":
    sys.exit(main())
