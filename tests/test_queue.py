import pytest
from pyspark.sql import functions as F

from tidemill.sources import queue


def entries(spark, a, b):
    return spark.range(a, b).select("id", F.concat(F.lit('say "'), "id", F.lit('"\n')).alias("body"))


def run(stream, sink, state):
    """One batch at a time until nothing new is admitted."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", state).trigger(availableNow=True).start()


def states(spark, folder):
    return {r.state: r.entries for r in queue.queue_state(spark, folder).collect()}


def test_entries_are_delivered_in_bounded_batches(spark, tmp_path):
    folder, seen = str(tmp_path / "q"), []
    queue.enqueue(entries(spark, 0, 40), folder, files=4)
    queue.enqueue(entries(spark, 40, 50), folder, files=1)
    assert states(spark, folder) == {"waiting": 50}

    def sink(batch, number):
        seen.append(sorted(int(r.id) for r in batch.collect()))

    for _ in range(4):
        run(queue.read_queue(spark, folder, admit=2), sink, str(tmp_path / "state")).awaitTermination()
    assert sorted(sum(seen, [])) == list(range(50)) and all(len(s) <= 25 for s in seen)
    assert states(spark, folder).get("waiting", 0) == 0


def test_a_crash_before_the_commit_redelivers(spark, tmp_path):
    folder, seen = str(tmp_path / "q"), []
    queue.enqueue(entries(spark, 0, 10), folder, files=2)

    def failing(batch, number):
        seen.append({r.entry: (r.id, r.body) for r in batch.collect()})
        raise RuntimeError("lost before the commit")

    query = run(queue.read_queue(spark, folder), failing, str(tmp_path / "state"))
    with pytest.raises(Exception, match="lost before the commit"):
        query.awaitTermination()
    assert states(spark, folder) == {"pending": 10}
    assert queue.queue_state(spark, folder).first().idle_seconds >= 0
    queue.enqueue(entries(spark, 10, 13), folder, files=1)

    def sink(batch, number):
        seen.append({r.entry: (r.id, r.body) for r in batch.collect()})

    for _ in range(2):
        run(queue.read_queue(spark, folder), sink, str(tmp_path / "state")).awaitTermination()
    assert seen[1] == seen[0] and len(seen[0]) == 10, "the same deliveries again"
    assert {i for s in seen[1:] for i, _ in s.values()} == {str(k) for k in range(13)}
    assert seen[0][min(seen[0])][1].endswith('"\n')


def test_half_written_folders_are_not_read(spark, tmp_path):
    folder = str(tmp_path / "q")
    queue.enqueue(entries(spark, 0, 3), folder, files=1)
    half = tmp_path / "q" / "entries" / "99999999999999999999"
    half.mkdir()
    (half / "part-0.json").write_text('{"id": "x"}\n')
    assert len(queue.groups(folder)) == 1
    assert queue.groups(str(tmp_path / "nothing")) == []
