"""Requests over TCP, one a connection, answered by a stream on the connection that they came from.

A Gateway listens where clients can reach it. Each connection brings one request, which gets a number; the stream's tasks fetch requests by number,
and its sink's tasks bring the answers back, which go out on the connections that wait for them. What is fetched is kept until the batch is
committed, so a batch that comes again after a failure reads the same requests; an answer that comes twice is sent once. Numbers rise over restarts of
the gateway, as the first is the time of its start. Register RequestSource to use it as a format of streams:

    gateway = Gateway()
    spark.dataSource.register(RequestSource)
    serve(spark, gateway.address, morphology.stem_text, checkpoint)
    ask_server("text", gateway.port)
"""

from __future__ import annotations

import json
import socket
import socketserver
import threading
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from .service import REQUEST_BYTES, Task, identity

#: Requests that one task fetches, at most, and seconds that a connection waits for its answer.
AT_ONCE, PATIENCE = 256, 60.0


class Gateway:
    """Listens for clients on `port` and for the stream's tasks on `inner`; 0 takes any free port. Tasks have to reach `host`."""

    def __init__(self, host: str = "127.0.0.1", port: int = 0, inner: int = 0, patience: float = PATIENCE, most: int = REQUEST_BYTES) -> None:
        self.waiting: dict[int, tuple[str, threading.Event, list[str]]] = {}
        self.next, self.lock = time.time_ns(), threading.Lock()
        self.patience, self.most = patience, most
        self._servers = [self._listen(host, port, self._client), self._listen(host, inner, self._task)]
        self.host, self.port = host, self._servers[0].server_address[1]
        self.address = f"{host}:{self._servers[1].server_address[1]}"

    @staticmethod
    def _listen(host: str, port: int, talk) -> socketserver.ThreadingTCPServer:
        class Handler(socketserver.BaseRequestHandler):
            def handle(self) -> None:
                talk(self.request)

        class Server(socketserver.ThreadingTCPServer):
            allow_reuse_address, daemon_threads, request_queue_size = True, True, 128

        server = Server((host, port), Handler)
        threading.Thread(target=server.serve_forever, kwargs={"poll_interval": 0.1}, daemon=True).start()
        return server

    def _client(self, line: socket.socket) -> None:
        """One request, up to its last whole character within `most` bytes, and its answer."""
        line.settimeout(self.patience)
        data = b""
        try:
            while len(data) < self.most and (more := line.recv(self.most - len(data))):
                data += more
        except OSError:
            return
        come, said = threading.Event(), []
        with self.lock:
            number = self.next
            self.next += 1
            self.waiting[number] = data.decode(errors="ignore"), come, said
        if not come.wait(self.patience):
            with self.lock:
                self.waiting.pop(number, None)
            return
        try:
            line.sendall(said[0].encode())
        except OSError:
            pass

    def _task(self, line: socket.socket) -> None:
        """A task's question: where numbers end, the requests of some numbers, or what to do with answers or with numbers that are done."""
        asked = json.loads(_whole(line))
        with self.lock:
            if "answers" in asked:
                for number, answer in asked["answers"]:
                    held = self.waiting.get(number)
                    if held and not held[2]:
                        held[2].append(answer)
                        held[1].set()
                told: object = len(asked["answers"])
            elif "done" in asked:
                for number in [n for n in self.waiting if n < asked["done"] and self.waiting[n][2]]:
                    del self.waiting[number]
                told = asked["done"]
            elif "first" in asked:
                told = [[n, x[0]] for n, x in sorted(self.waiting.items()) if asked["first"] <= n < asked["last"]]
            else:
                told = self.next
        line.sendall(json.dumps(told).encode())

    def close(self) -> None:
        for server in self._servers:
            server.shutdown()
            server.server_close()


def _whole(line: socket.socket) -> bytes:
    parts = []
    while more := line.recv(1 << 16):
        parts.append(more)
    return b"".join(parts)


def _told(address: str, **asked: object):
    host, port = address.rsplit(":", 1)
    with socket.create_connection((host, int(port)), timeout=30) as line:
        line.sendall(json.dumps(asked).encode())
        line.shutdown(socket.SHUT_WR)
        return json.loads(_whole(line))


def ask_server(message: str, port: int, host: str = "127.0.0.1", timeout: float = PATIENCE) -> str:
    """A client: the answer to one request; empty if the service gave none in time."""
    with socket.create_connection((host, port), timeout=timeout) as line:
        line.settimeout(timeout)
        line.sendall(message.encode())
        line.shutdown(socket.SHUT_WR)
        return _whole(line).decode()


@dataclass
class Numbers(InputPartition):
    first: int
    last: int


class _Reader(DataSourceStreamReader):
    def __init__(self, address: str) -> None:
        self.address = address

    def initialOffset(self) -> dict:
        return {"number": 0}

    def latestOffset(self) -> dict:
        return {"number": _told(self.address)}

    def partitions(self, start: dict, end: dict) -> list[Numbers]:
        numbers = [n for n, _ in _told(self.address, first=start["number"], last=end["number"])]
        edges = numbers[::AT_ONCE] + [end["number"]]
        return [Numbers(a, b) for a, b in zip(edges, edges[1:])] or [Numbers(end["number"], end["number"])]

    def read(self, partition: Numbers) -> Iterator[tuple[int, str]]:
        for number, value in _told(self.address, first=partition.first, last=partition.last):
            yield number, value

    def commit(self, end: dict) -> None:
        _told(self.address, done=end["number"])


class _Writer(DataSourceStreamWriter):
    def __init__(self, address: str) -> None:
        self.address = address

    def write(self, iterator) -> WriterCommitMessage:
        some: list[list[object]] = []
        for row in iterator:
            some.append([row["number"], row["answer"] or ""])
            if len(some) == AT_ONCE:
                _told(self.address, answers=some)
                some = []
        if some:
            _told(self.address, answers=some)
        return WriterCommitMessage()


class RequestSource(DataSource):
    """The format `requests`: streams of number and value, and a sink for number and answer. Its option `gateway` is a Gateway's address."""

    @classmethod
    def name(cls) -> str:
        return "requests"

    def schema(self) -> str:
        return "number long, value string"

    def streamReader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["gateway"])

    def streamWriter(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["gateway"])


def serve(spark: SparkSession, address: str, task: Task = identity, checkpoint: str | None = None, name: str | None = None) -> StreamingQuery:
    """Answer a gateway's requests until the query is stopped. A query that starts again from its checkpoint answers what was not committed."""
    spark.dataSource.register(RequestSource)
    requests = spark.readStream.format("requests").option("gateway", address).load()
    made = requests.select("number", F.coalesce(task(F.col("value")), F.lit("")).alias("answer"))
    writer = made.writeStream.format("requests").option("gateway", address).trigger(processingTime="0 seconds")
    for option, value in (("checkpointLocation", checkpoint),):
        writer = writer.option(option, value) if value else writer
    return (writer.queryName(name) if name else writer).start()
