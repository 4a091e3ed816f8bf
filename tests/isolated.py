"""Runs queries with Python workers that cannot import the package, and prints their rows as JSON.

Called as a program from a folder outside the repository: python isolated.py REPOSITORY MODULE FOLDER NAME...
"""

import importlib
import json
import sys


def importable(_):
    import importlib.util

    yield importlib.util.find_spec("skeinlake") is not None


def main(repository: str, module: str, folder: str, *names: str) -> None:
    sys.path.insert(0, repository)
    from skeinlake.session import local_session

    queries = importlib.import_module(module).QUERIES
    spark = local_session(4, partitions=2, memory="2g")
    assert not any(spark.sparkContext.parallelize([0], 1).mapPartitions(importable).collect())
    for name in names:
        rows = sorted(json.dumps(r.asDict(), sort_keys=True, default=str) for r in queries[name](spark, folder).collect())
        print(json.dumps({"name": name, "rows": rows}))
    spark.stop()


if __name__ == "__main__":
    main(*sys.argv[1:])
