"""Print the physical plans of the headline operators (for docs/plans.md).

Usage: python tools/show_plans.py [sf_dir]
The records are first stored the way a review stores them
(``write_records``: partitioned by key type, sorted by year), so the scan
shows partition pruning and pushed filters.
"""

from __future__ import annotations

import os
import re
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sieve.operators import multi, screening  # noqa: E402
from sieve.operators.enrich import resolve_ids  # noqa: E402
from sieve.operators.prisma import prisma_flow  # noqa: E402
from sieve.plans.review import ReviewInputs, run_review  # noqa: E402
from sieve.session import build_session, materialize  # noqa: E402
from sieve.sources.bibliography import write_records  # noqa: E402


def plan(df) -> str:
    text = df._jdf.queryExecution().executedPlan().toString()
    text = re.sub(r"#\d+L?", "", text)
    text = re.sub(r"[\x00-\x08\x0b-\x1f]", lambda m: "\\u%04x" % ord(m.group(0)), text)
    text = re.sub(r"map_from_arrays\(array\([^)]*\), array\([^)]*\)\)", "<entity map>", text)
    text = re.sub(r"file:/[^\],]*", "<path>", text)
    out = []
    for line in text.splitlines():
        out.append(line[:200])
        if "FileScan" in line:
            pad = " " * (len(line) - len(line.lstrip(" :|+-")) + 4)
            for key in ("PartitionFilters", "PushedFilters", "ReadSchema"):
                m = re.search(key + r": (\[.*?\]|\S+)(?=, [A-Z][A-Za-z]+:|$)", line)
                if m:
                    out.append((pad + key + ": " + m.group(1))[:400])
    return "\n".join(out)


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(shuffle_partitions=8)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    inp = ReviewInputs(spark, sf_dir)
    path = os.path.join(tempfile.mkdtemp(prefix="plans-"), "records")
    write_records(inp.bib, path)
    records = spark.read.parquet(path)
    st = inp.study(1)
    shown = {
        "screen (one review over stored records)": screening.screen(records, st, inp.rank_table),
        "screen_many (four reviews, one scan)": multi.screen_many(records, inp.studies, inp.rank_table),
        "resolve_ids (written papers; title index cut to needed titles)": resolve_ids(
            materialize(screening.split_venue(screening.candidates(records, inp.study(2)))[0], "plans-papers"),
            inp.view("title_index"), cut=True),
    }
    r = run_review(inp)
    shown["prisma_flow (after the review tables are written)"] = prisma_flow(
        inp.bib, inp.studies, r.gated, r.contents, r.responses, r.reports, r.criteria_assessments)
    for title, df in shown.items():
        print(f"### {title}\n\n```\n{plan(df)}\n```\n")


if __name__ == "__main__":
    main()
