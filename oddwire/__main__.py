"""``python -m oddwire <run> …``, or ``oddwire_app.py`` with ``spark-submit``: one of the complete runs."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from oddwire.plans import runs

RUNS = {
    "application": runs.run_application,
    "evaluation": runs.run_evaluation,
    "scoring": runs.run_scoring,
}


def main() -> None:
    parser = argparse.ArgumentParser(prog="oddwire", description=__doc__)
    parser.add_argument("run", choices=sorted(RUNS))
    parser.add_argument("--normal-training", required=True)
    parser.add_argument("--normal-test", required=True)
    parser.add_argument("--anomalous", required=True)
    parser.add_argument("--out", required=True)
    parser.add_argument("--seed", type=int, required=True)
    parser.add_argument("--threshold", type=float)
    parser.add_argument("--refit", action="store_true")
    options = vars(parser.parse_args())
    run = RUNS[options.pop("run")]
    if options["threshold"] is None or run is runs.run_evaluation:
        options.pop("threshold")
    run(SparkSession.builder.appName("oddwire").getOrCreate(), **options)


if __name__ == "__main__":
    main()
