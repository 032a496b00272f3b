"""Command line: ``spark-submit`` this module, or ``python -m foldwise``.

    preview --folder DIR                      shape, types and first rows of every table
    check   --folder DIR                      sizes, id and label defects, column differences
    profile --folder DIR                      every column of the training table, and test's drift
    compare --folder DIR --arm A --arm B ..   cross-validated arms, pair by pair, and their blend
    run     --folder DIR --arm NAME --out DIR validate, fit, score and write predictions
    blend   --out DIR NAME=PATH NAME=PATH ..  average prediction files by id
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from foldwise.operators.profile import drift, read_profile, sketch_columns
from foldwise.operators.tables import bundle_check
from foldwise.plans import experiments, laps
from foldwise.plans.cv import PARALLELISM, leaderboard
from foldwise.plans.pipelines import blend_files, train_and_submit
from foldwise.sources.schema import LAPS
from foldwise.sources.tables import Bundle, preview, shape
from foldwise.workspace import clear_scratch, materialize


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"foldwise {args.command}").getOrCreate()
    if args.command == "preview":
        bundle = Bundle.from_folder(spark, args.folder)
        for table in (bundle.train, bundle.test, bundle.sample):
            shape(table).show(truncate=False)
            preview(table, args.rows).show(truncate=False)
    elif args.command == "check":
        bundle_check(Bundle.from_folder(spark, args.folder, LAPS), LAPS).show(truncate=False)
    elif args.command == "profile":
        bundle = Bundle.from_folder(spark, args.folder, LAPS)
        train, test = (materialize(sketch_columns(t), "sketches") for t in (bundle.train, bundle.test))
        read_profile(train).orderBy("position").show(1000, truncate=False)
        drift(train, test).orderBy("position").show(1000, truncate=False)
        clear_scratch(spark)
    elif args.command == "compare":
        arms = {arm.run: arm for arm in laps.arms(args.max_bins)}
        chosen = [arms[name].staged(args.rounds) if args.rounds else arms[name] for name in args.arm]
        bundle = Bundle.from_folder(spark, args.folder, LAPS)
        result = experiments.compare_arms(
            bundle.train, chosen, LAPS.id, LAPS.label, parallelism=args.parallelism, group=args.group
        )
        leaderboard(result.fold_scores).show(1000, truncate=False)
        result.pairs.show(1000, truncate=False)
        for run, weight in result.weights.items():
            print(f"{weight:.4f}  {run}")
        clear_scratch(spark)
    elif args.command == "run":
        arms = {arm.run: arm for arm in laps.arms(args.max_bins)}
        bundle = Bundle.from_folder(spark, args.folder, LAPS)
        result = train_and_submit(
            bundle, arms[args.arm], LAPS, args.out, parallelism=args.parallelism
        )
        result.fold_scores.orderBy("fold").show()
        leaderboard(result.fold_scores).show(truncate=False)
        if arms[args.arm].learner == "gbt":
            result.fitted.importance().show(100, truncate=False)
        clear_scratch(spark)
    else:
        blend_files(spark, dict(pair.split("=", 1) for pair in args.sets), args.out)


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="foldwise", description=__doc__.splitlines()[0])
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("preview", "check", "profile", "compare", "run"):
        commands.add_parser(name).add_argument("--folder", required=True)
    commands.choices["preview"].add_argument("--rows", type=int, default=10)
    names = [arm.run for arm in laps.arms()]
    compare = commands.choices["compare"]
    compare.add_argument("--arm", required=True, action="append", choices=names)
    compare.add_argument("--group", help="column whose rows stay in one fold")
    compare.add_argument("--rounds", type=int, nargs="+", help="score trees after these rounds")
    compare.add_argument("--parallelism", type=int, default=PARALLELISM)
    compare.add_argument("--max-bins", type=int, default=32)
    run = commands.choices["run"]
    run.add_argument("--arm", required=True, choices=names)
    run.add_argument("--out", required=True)
    run.add_argument("--parallelism", type=int, default=PARALLELISM)
    run.add_argument("--max-bins", type=int, default=32)
    blend = commands.add_parser("blend")
    blend.add_argument("--out", required=True)
    blend.add_argument("sets", nargs="+", metavar="NAME=PATH")
    return parser


if __name__ == "__main__":
    main()
