"""python -m murmurline.llm [QUERY TABLES [OUT]]: lists or runs the queries of the subpackage."""

from __future__ import annotations

import sys

from murmurline.__main__ import main
from murmurline.llm.queries import QUERIES

if __name__ == "__main__":
    sys.exit(main(sys.argv[1:], QUERIES))
