"""How many files a log is made of: as many as there are days, not days times tasks."""

import datetime as dt
import os

from textward.sources import decision_log

from test_decision_log import entries, ids


def files(path):
    return sum(f.endswith(".parquet") for _, _, names in os.walk(path) for f in names)


def test_a_day_of_a_batch_is_one_file_however_many_tasks(spark, tmp_path):
    path, into = str(tmp_path / "log"), str(tmp_path / "compacted")
    rows = entries(spark, range(200), step=dt.timedelta(hours=1)).repartition(8)  # nine days
    for batch in ("a", "b", "a"):
        decision_log.append(rows, path, batch)
    assert files(path) == 18 and len(ids(decision_log.read(spark, path))) == 400
    decision_log.compact(spark, path, into, "2024-03-06")
    assert files(into) == 5 and len(ids(decision_log.read(spark, into))) == 240
