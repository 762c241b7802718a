import threading
import time
from concurrent.futures import ThreadPoolExecutor
from types import SimpleNamespace

from lemmary.sources import tables


def test_package_is_shipped_once_by_parts_computed_side_by_side():
    sent, start = [], threading.Barrier(8)

    class Context:
        def addPyFile(self, path):  # noqa: N802
            """As a cluster does: a second path for the same name is refused."""
            sent.append(path)
            time.sleep(0.05)
            if len(sent) > 1:
                raise ValueError("already registered with a different path")

    spark = SimpleNamespace(sparkContext=Context())

    def part(_):
        start.wait()
        tables.ship(spark)

    with ThreadPoolExecutor(8) as pool:
        list(pool.map(part, range(8)))
    assert len(sent) == 1
