"""A work queue that speaks the beanstalk protocol, as a stream.

A batch is what could be reserved when it began.  Its jobs are part of the offset
that Spark logs before the batch runs, so a batch that is repeated, also after a
restart, has the same rows without asking the queue.  Jobs are deleted from the
queue once their batch is committed; one that comes again because the run ended
before that is known by the offset that holds it, and goes then.
"""

from __future__ import annotations

import json
import socket
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType


class Client:
    """One connection to the queue; it watches one tube."""

    def __init__(self, host: str, port: int, tube: str, timeout: float = 30.0):
        self.connection = socket.create_connection((host, port), timeout)
        self.lines = self.connection.makefile("rb")
        self.ask(f"watch {tube}", "WATCHING")
        if tube != "default":
            self.ask("ignore default", "WATCHING")

    def ask(self, command: str, *expected: str) -> list[str]:
        self.connection.sendall(command.encode() + b"\r\n")
        line = self.lines.readline()
        if not line:
            raise ConnectionError("the queue has closed the connection")
        answer = line.decode().split()
        if answer[0] not in expected:
            raise ValueError(f"{command!r} was answered with {line!r}")
        return answer

    def reserve(self) -> tuple[int, str] | None:
        """The next job, as (number, body); None if there is none just now."""
        answer = self.ask("reserve-with-timeout 0", "RESERVED", "TIMED_OUT", "DEADLINE_SOON")
        if answer[0] != "RESERVED":
            return None
        body = self.lines.read(int(answer[2]) + 2)[:-2]
        return int(answer[1]), body.decode(errors="replace")

    def delete(self, job: int) -> None:
        self.ask(f"delete {job}", "DELETED", "NOT_FOUND")


class QueueSource(DataSource):
    """Jobs of a tube: ``id`` and ``body``, or the members of bodies of JSON that ``columns`` names."""

    @classmethod
    def name(cls) -> str:
        return "weftline_queue"

    def schema(self) -> str:
        return self.options.get("columns", "id bigint, body string")

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:  # noqa: N802
        return QueueReader(dict(self.options), schema.names)


class QueueReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict, names: list[str]):
        self.options, self.names = options, names
        self.client: Client | None = None
        self.held: set[int] = set()  # reserved by this connection and not committed

    def queue(self) -> Client:
        if self.client is None:
            self.client = Client(self.options.get("host", "localhost"), int(self.options.get("port", 11300)), self.options["tube"])
        return self.client

    def initialOffset(self) -> dict:  # noqa: N802
        return {"n": 0, "jobs": []}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        jobs: list[list] = []  # as they are once the offset has been JSON
        seen = {i for i, _ in start["jobs"]}
        while len(jobs) < int(self.options.get("batch", 1000)) and (job := self.queue().reserve()) is not None:
            if job[0] in seen:  # its batch was committed, but the run ended before it was deleted
                self.queue().delete(job[0])
            else:
                self.held.add(job[0])
                jobs.append([*job])
        if not jobs:
            return iter(()), start
        return self.rows(jobs), {"n": start["n"] + len(jobs), "jobs": jobs}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return self.rows(end["jobs"]) if end["n"] > start["n"] else iter(())

    def commit(self, end: dict) -> None:
        for i, _ in end["jobs"]:
            if i in self.held:  # others come again, and are known by the offset then
                self.queue().delete(i)
                self.held.discard(i)

    def rows(self, jobs: list) -> Iterator[tuple]:
        return iter([self.row(*job) for job in jobs])  # Spark copies it

    def row(self, number: int, body: str) -> tuple:
        if self.names == ["id", "body"]:
            return number, body
        try:
            found = json.loads(body)
        except ValueError:
            found = None
        found = found if isinstance(found, dict) else {}
        return tuple(found.get(n) for n in self.names)
