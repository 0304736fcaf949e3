"""Write k copies of the driver tables (ids offset, group keys kept) for scaling runs.

usage: python tools/replicate.py SRC_DIR DST_DIR K

Ids (conv_id, doc_id, page_id, event_id, item_id) are shifted per copy so keys
stay unique; grouping keys (user, topic, language) are kept, so hot groups grow
with K as they would at scale.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

IDS = {"conversations": "conv_id", "documents": "doc_id", "pages": "page_id", "events": "event_id",
       "benchmark": "item_id", "labels": "doc_id"}


def main():
    src, dst, k = sys.argv[1], sys.argv[2], int(sys.argv[3])
    from tessera.session import local_session

    spark = local_session(8)
    for name, key in IDS.items():
        df = spark.read.parquet(f"{src}/{name}.parquet")
        span = df.agg(F.max(key)).first()[0] + 1
        # every row k times, each copy with its ids shifted by a multiple of the id span
        rep = df.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
        rep = rep.withColumn(key, F.col(key) + F.col("_copy") * F.lit(span)).drop("_copy")
        rep.select(*df.columns).write.mode("overwrite").parquet(f"{dst}/{name}.parquet")
    print("done", dst)


if __name__ == "__main__":
    main()
