"""Queries of one session side by side."""

import os
import threading

from tidemark import session
from tidemark.llm.queries import QUERIES


def test_queries_side_by_side_leave_each_other_alone(spark, sf_dir):
    """Three queries that stage tables, in three threads: each result is whole, and what they staged on the way is gone."""
    session.release(spark)
    folder = session.shared_folder(spark).removeprefix("file://")
    before, rows, errors = set(os.listdir(folder)), {}, []

    def work(name):
        try:
            rows[name] = QUERIES[name](spark, sf_dir).count()
        except Exception as e:  # noqa: BLE001
            errors.append((name, e))

    threads = [threading.Thread(target=work, args=(n,)) for n in ("op1_simhash", "op4_suffix_tree", "op9_substrings")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and rows == dict.fromkeys(rows, 200) and len(rows) == 3
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before}
    assert left == {"tidemark-near", "tidemark-scores", "tidemark-without_recurring"}  # the results
    session.release(spark)
    assert set(os.listdir(folder)) == before
