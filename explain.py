"""Print the physical plans of registered queries (for plan review).

    python explain.py [sf_dir] [key ...]      # default: the bench's headline queries at sf0.01
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main(argv: list[str]) -> None:
    from bench import HEADLINE
    from fieldwork.plans.queries import queries
    from fieldwork.session import get_session

    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    keys = [a for a in argv[1:] if not a.startswith("/")] or list(HEADLINE.values())
    spark = get_session("local[8]", 16)
    qs = queries()
    for key in keys:
        print(f"===== {key}")
        qs[key](spark, sf_dir).explain("formatted")


if __name__ == "__main__":
    main(sys.argv)
