"""spark-submit sparkloom/score.py --artifact DIR --input TABLE --output TABLE [--drift TABLE]"""

from __future__ import annotations

import argparse

from sparkloom.plans.tabular import Scorer
from sparkloom.session import session
from sparkloom.sources.tables import read_table, write_table


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Scores a table with an exported run.")
    for name, needed in (("artifact", True), ("input", True), ("output", True), ("drift", False)):
        p.add_argument(f"--{name}", required=needed)
    a = p.parse_args(argv)
    spark = session("score")
    scorer, rows = Scorer.load(spark, a.artifact), read_table(spark, a.input)
    write_table(scorer.score(rows), a.output)
    if a.drift:
        write_table(scorer.drift(rows), a.drift)


if __name__ == "__main__":
    main()
