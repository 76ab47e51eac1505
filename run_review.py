"""Launcher for the review job: ``spark-submit --py-files sieve.zip run_review.py --study ... --out ...``
(or ``python run_review.py ...`` on a local master).  Flags: see ``sieve/plans/job.py``."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sieve.plans.job import main  # noqa: E402

if __name__ == "__main__":
    sys.exit(main())
