"""Lines from TCP connections and UDP datagrams as streaming sources of Spark.

A listener owns the socket and buffers lines, each with the time it came in, up to a bound; a full buffer holds TCP senders back
and drops datagrams, which it counts. Spark builds a reader more than once, in several processes, so a reader binds nothing: the
process that plans the batches opens the listener when it is first asked for an offset, and there is one for each host and port.

An offset is the number of lines taken so far. The lines of a batch travel in its partitions, so tasks need no socket, and are kept
until the batch is committed, so it can be planned again. A query that starts from a checkpoint goes on with the number it left off
at; lines that were buffered when the planning process ended are lost.
"""

from __future__ import annotations

import itertools
import socket
import threading
import time
from collections import deque
from collections.abc import Iterator, Sequence

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..errors import SourceError

LINES = "received_at timestamp, source struct<kind:string,addr:string,path:string>, content string, metadata map<string,string>"
DATAGRAM = 65_535
#: Lines in one task.
TASK_LINES = 5_000
#: For how long a port that is still held, say by the query before, is tried again.
BIND_SECONDS = 15


class Buffer:
    """Numbered lines with a bound on those that no batch has been planned for. Spark commits a batch only when there are lines for
    the next one, so a bound on all uncommitted lines would never be left again."""

    def __init__(self, bound: int) -> None:
        self.bound, self.first, self.planned, self.lines, self.dropped = bound, 0, 0, deque(), 0
        self.lock = threading.Condition()

    def _full(self) -> bool:
        return self.first + len(self.lines) - max(self.planned, self.first) >= self.bound

    def put(self, kind: str, addr: str, line: str, wait: bool) -> None:
        with self.lock:
            while wait and self._full():
                self.lock.wait(0.1)
            if self._full():
                self.dropped += 1
                return
            self.lines.append((time.time(), kind, addr, line))

    def plan(self) -> int:
        """The number after the latest line, up to which a batch may take them."""
        with self.lock:
            self.planned = self.first + len(self.lines)
            self.lock.notify_all()
            return self.planned

    def begin(self, at: int) -> None:
        """Number the lines on from `at`, where a query goes on; those before it are done with."""
        with self.lock:
            while self.first < at and self.lines:
                self.lines.popleft()
                self.first += 1
            self.first = self.planned = at
            self.lock.notify_all()

    def read(self, start: int, end: int) -> list[tuple]:
        with self.lock:
            return list(itertools.islice(self.lines, max(0, start - self.first), max(0, end - self.first)))

    def forget(self, end: int) -> None:
        with self.lock:
            while self.first < end and self.lines:
                self.lines.popleft()
                self.first += 1
            self.lock.notify_all()


def packet_to_lines(packet: bytes) -> list[str]:
    """The lines of a datagram: nothing of one that isn't UTF-8; trimmed, cut at line ends, empty lines skipped."""
    try:
        text = packet.decode("utf-8")
    except UnicodeDecodeError:
        return []
    return [x for x in text.strip().replace("\r\n", "\n").split("\n") if x]


def bound_socket(kind: int, host: str, port: int, seconds: float = BIND_SECONDS) -> socket.socket:
    until = time.time() + seconds
    while True:
        try:
            if kind == socket.SOCK_STREAM:
                return socket.create_server((host, port))
            s = socket.socket(socket.AF_INET, kind)
            try:
                s.bind((host, port))
            except OSError:
                s.close()
                raise
            return s
        except OSError as e:
            if time.time() >= until:
                raise SourceError(f"{host}:{port}: {e}") from e
            time.sleep(0.2)


class TcpListener:
    """A server with a thread a connection; connections beyond the limit are refused, and closed ones make room again."""

    def __init__(self, host: str, port: int, max_connections: int, bound: int) -> None:
        self.buffer, self.open, self.limit = Buffer(bound), 0, max_connections
        self.lock = threading.Lock()
        self.server = bound_socket(socket.SOCK_STREAM, host, port)
        self.port = self.server.getsockname()[1]
        threading.Thread(target=self._accept, daemon=True).start()

    def _accept(self) -> None:
        while True:
            try:
                conn, peer = self.server.accept()
            except OSError:
                return
            with self.lock:
                if self.open >= self.limit:
                    conn.close()
                    continue
                self.open += 1
            threading.Thread(target=self._serve, args=(conn, f"{peer[0]}:{peer[1]}"), daemon=True).start()

    def _serve(self, conn: socket.socket, peer: str) -> None:
        try:
            with conn, conn.makefile("rb") as f:
                for raw in f:
                    line = raw.rstrip(b"\n").removesuffix(b"\r").decode("utf-8")
                    if line:
                        self.buffer.put("tcp", peer, line, wait=True)
        except (OSError, UnicodeDecodeError):
            pass  # this connection ends, the others go on
        finally:
            with self.lock:
                self.open -= 1

    def close(self) -> None:
        self.server.close()


class UdpListener:
    def __init__(self, host: str, port: int, bound: int) -> None:
        self.buffer = Buffer(bound)
        self.socket = bound_socket(socket.SOCK_DGRAM, host, port)
        self.port = self.socket.getsockname()[1]
        threading.Thread(target=self._receive, daemon=True).start()

    def _receive(self) -> None:
        while True:
            try:
                packet, peer = self.socket.recvfrom(DATAGRAM)
            except OSError:
                return
            for line in packet_to_lines(packet):
                self.buffer.put("udp", f"{peer[0]}:{peer[1]}", line, wait=False)

    def close(self) -> None:
        self.socket.close()


#: The listeners of this process by kind, host and port.
_LISTENERS: dict[tuple, TcpListener | UdpListener] = {}


class Lines(InputPartition):
    """A part of a batch: times, kinds, addresses and lines."""

    def __init__(self, rows: list[tuple]) -> None:
        self.rows = rows


class _Reader(DataSourceStreamReader):
    def __init__(self, kind: str, options: dict) -> None:
        self.kind, self.host, self.port, self.bound = kind, options.get("host", "127.0.0.1"), int(options.get("port", 0)), int(options.get("buffer", 10_000))
        self.limit, self.port_file = int(options.get("maxConnections", 100)), options.get("portFile")

    def _listener(self, first: int | None = None) -> TcpListener | UdpListener:
        key = (self.kind, self.host, self.port)
        found = _LISTENERS.get(key)
        if found is None:
            found = _LISTENERS[key] = TcpListener(self.host, self.port, self.limit, self.bound) if self.kind == "tcp" else UdpListener(self.host, self.port, self.bound)
            found.buffer.begin(first or 0)
            if self.port_file:
                with open(self.port_file, "w") as f:
                    f.write(str(found.port))
        return found

    def initialOffset(self) -> dict:
        return {"line": self._listener().buffer.first}

    def latestOffset(self) -> dict:
        return {"line": self._listener().buffer.plan()}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        buffer = self._listener(end["line"]).buffer
        if end["line"] > buffer.first + len(buffer.lines):  # a listener of another query's numbers
            buffer.begin(end["line"])
        rows = buffer.read(start["line"], end["line"])
        return [Lines(rows[i : i + TASK_LINES]) for i in range(0, len(rows), TASK_LINES)] or [Lines([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from datetime import datetime, timezone

        for t, kind, addr, line in partition.rows:
            yield datetime.fromtimestamp(t, timezone.utc), (kind, addr, None), line, {}

    def commit(self, end: dict) -> None:
        self._listener(end["line"]).buffer.forget(end["line"])

    def stop(self) -> None:
        found = _LISTENERS.pop((self.kind, self.host, self.port), None)
        if found is not None:
            found.close()


class TcpLines(DataSource):
    """`spark.readStream.format("tcp_lines")`: options host, port, maxConnections, buffer."""

    @classmethod
    def name(cls) -> str:
        return "tcp_lines"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader("tcp", self.options)


class UdpLines(DataSource):
    """`spark.readStream.format("udp_lines")`: options host, port, buffer."""

    @classmethod
    def name(cls) -> str:
        return "udp_lines"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader("udp", self.options)
