"""Runs queries that use Python workers from another folder: ``cd / && python …/tests/elsewhere.py [name …]``."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402
from shoebox.session import build_session  # noqa: E402

NAMES = ("kee6", "emb1", "emb2", "emb3", "emb3_blocks", "emb9", "emb11", "hed2", "hed6", "hed9", "eva1", "eva8", "eva8_binary", "eva10", "eva11", "eva12", "fpr8", "snk1", "str3", "str5")

if __name__ == "__main__":
    spark = build_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    queries = entry.queries()
    for name in sys.argv[1:] or NAMES:
        print("@", name, len(queries[name](spark, "/root/testdata/sf0.001").collect()), flush=True)
