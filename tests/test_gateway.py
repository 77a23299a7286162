"""The service over TCP, and numbers that outlive batches."""

import socket
import threading
import time

from pyspark.sql import functions as F

from glyphloom.operators import features, morphology
from glyphloom.streaming import gateway, surrogates


def asked(port, messages):
    """The answers to requests sent at the same time, each over a connection of its own."""
    got = {}
    threads = [threading.Thread(target=lambda m=m: got.__setitem__(m, gateway.ask_server(m, port))) for m in messages]
    for t in threads:
        t.start()
    for t in threads:
        t.join(90)
    return got


def test_each_client_reads_its_own_answer(spark, tmp_path):
    door = gateway.Gateway(patience=80)
    query = gateway.serve(spark, door.address, F.upper, f"file://{tmp_path}/cp")
    try:
        messages = [f"request {i} é" for i in range(5)] + ["", "x" * 2000, "é" * 600]
        got = asked(door.port, messages)
        assert {m: got[m] for m in messages[:6]} == {m: m.upper() for m in messages[:6]}
        assert got["x" * 2000] == "X" * 1024 and got["é" * 600] == "É" * 512
    finally:
        query.stop()
    # Requests that come while no query runs are answered by the next one, from the same checkpoint; the answered ones are not asked for again.
    late = {}
    waiting = threading.Thread(target=lambda: late.update(asked(door.port, ["later", "last"])))
    waiting.start()
    time.sleep(1)
    query = gateway.serve(spark, door.address, F.reverse, f"file://{tmp_path}/cp")
    try:
        waiting.join(90)
        assert late == {"later": "retal", "last": "tsal"}
    finally:
        query.stop()
        door.close()


def test_a_batch_that_comes_again_reads_the_same_and_answers_once():
    door = gateway.Gateway()
    try:
        line = socket.create_connection((door.host, door.port))
        line.sendall(b"hello")
        line.shutdown(socket.SHUT_WR)
        reader, writer = gateway._Reader(door.address), gateway._Writer(door.address)
        while not door.waiting:
            time.sleep(0.05)
        end = reader.latestOffset()
        first = [r for p in reader.partitions({"number": 0}, end) for r in reader.read(p)]
        assert first == [r for p in reader.partitions({"number": 0}, end) for r in reader.read(p)] and [v for _, v in first] == ["hello"]
        for answer in ("one", "two"):
            writer.write(iter([{"number": first[0][0], "answer": answer}]))
        assert gateway._whole(line) == b"one"
        reader.commit(end)
        assert not door.waiting and [r for p in reader.partitions({"number": 0}, end) for r in reader.read(p)] == []
    finally:
        door.close()


def test_stemming_over_tcp(spark, tmp_path):
    door = gateway.Gateway(patience=80)
    query = gateway.serve(spark, door.address, morphology.stem_text, f"file://{tmp_path}/cp")
    try:
        assert gateway.ask_server("وسيكتبونه", door.port) == " ".join(morphology.segments("wsyktbwnh")).translate(str.maketrans(morphology.T.BUCKWALTER, morphology.T.ARABIC))
    finally:
        query.stop()
        door.close()


def test_numbers_stay_over_batches_and_restarts(spark, tmp_path):
    schema = "doc_id long, pos int, token string"
    rows = [[(1, 0, "\U0001f602"), (1, 1, "w")], [(2, 0, "\U0001f600"), (2, 1, "\U0001f602")], [(3, 0, "\U0001f603"), (3, 1, "\U0001f600")]]
    (tmp_path / "in").mkdir()
    table = surrogates.SurrogateTable(spark, f"file://{tmp_path}/table")
    got = {}

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
        q = surrogates.numbered(stream, table, lambda df, n: got.__setitem__(n, sorted(map(tuple, df.collect()))), f"file://{tmp_path}/cp")
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    for i, some in enumerate(rows):  # the query is stopped and started again for each
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        run()
    assert [got[i] for i in range(3)] == [[(1, 0, "eMJ0"), (1, 1, "w")], [(2, 0, "eMJ1"), (2, 1, "eMJ0")], [(3, 0, "eMJ2"), (3, 1, "eMJ1")]]
    again = table.absorb(spark.createDataFrame(rows[1], schema), 1)  # a batch that comes again
    assert {r.emoji: r.surrogate for r in again.collect()} == {"\U0001f602": "eMJ0", "\U0001f600": "eMJ1"}
    # A second corpus goes on from the first.
    later = surrogates.SurrogateTable(spark, f"file://{tmp_path}/table").absorb(features.tokens(spark.createDataFrame([(9, "new \U0001f680 old \U0001f602")], "doc_id long, text string")))
    assert {r.emoji: r.surrogate for r in later.collect()}["\U0001f680"] == "eMJ3" and later.count() == 4
