"""spark-submit entry: python -m tessera PATH index FILE.json | search TEXT | compact | snapshot TO | restore FROM | health"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.plans.engine import Engine, SearchRequest
from tessera.plans.settings import METRICS, PROFILES, Settings
from tessera.sources.documents import read_json


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__)
    p.add_argument("path", help="the collection's folder")
    p.add_argument("command", choices=["index", "search", "compact", "snapshot", "restore", "health"])
    p.add_argument("value", nargs="?", help="a file, a text or a folder")
    p.add_argument("--dim", type=int, default=384)
    p.add_argument("--metric", choices=METRICS, default="cosine")
    p.add_argument("--profile", choices=sorted(PROFILES), default="balanced")
    p.add_argument("-k", type=int, default=10)
    a = p.parse_args(args)
    spark = spark or SparkSession.builder.appName("tessera").getOrCreate()
    e = Engine(spark, a.path, Settings(dim=a.dim, metric=a.metric, pq=PROFILES[a.profile]))
    if a.command == "index":
        docs = read_json(spark, a.value).withColumn("item_id", F.monotonically_increasing_id())
        print(json.dumps({"position": e.index_new(docs), "visible": e.refresh()}))
    elif a.command == "search":
        for r in e.search(SearchRequest("keyword", a.value, k=a.k)).results.collect():  # k rows
            print(json.dumps({"doc_id": r.doc_id, "score": r.score}))
    elif a.command == "compact":
        e.compact()
    elif a.command == "snapshot":
        e.snapshot(a.value)
    elif a.command == "restore":
        e.restore(a.value)
    else:
        print(json.dumps(e.health()))


if __name__ == "__main__":
    main()
