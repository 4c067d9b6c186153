"""Command line: a run over files, or over the built-in demo. Exit 0 if it ends well, 1 if an expected score is missed, 2 on an error."""

from __future__ import annotations

import argparse
import json
import sys


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--config")
    p.add_argument("--data", nargs="*", help="paths Spark can read; the demo if none")
    p.add_argument("--label")
    p.add_argument("--time")
    p.add_argument("--entities", nargs="*")
    p.add_argument("--learner")
    p.add_argument("--seed", type=int)
    p.add_argument("--skip", nargs="*", help="stages to pass over")
    p.add_argument("--output")
    p.add_argument("--expect", type=float, help="average precision of the core, to 1e-6")
    p.add_argument("--quiet", action="store_true")
    a = p.parse_args(argv)
    try:
        from pyspark.sql import SparkSession

        from quarry.plans.config import load_config
        from quarry.plans.pipeline import run
        from quarry.sources.io import demo, read_any

        spark = SparkSession.builder.appName("quarry").getOrCreate()
        over = {k: v for k, v in {"label": a.label, "time_col": a.time, "entity_cols": a.entities, "learner": a.learner, "seed": a.seed, "skip": a.skip}.items() if v is not None}
        if not a.data:
            over = {"time_col": "event_time", "entity_cols": ["customer"]} | over
        result = run(read_any(spark, a.data) if a.data else demo(spark), load_config(a.config, **over))
        if a.output:
            result.save(a.output)
        if not a.quiet:
            print(json.dumps(result.scores, indent=2))
        return int(a.expect is not None and abs(result.scores["core"]["ap"] - a.expect) > 1e-6)
    except Exception as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
