"""A streaming source of UDP datagrams: one datagram, one event."""

from __future__ import annotations

import socket
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


class DatagramReader(SimpleDataSourceStreamReader):
    """Reads what has come since the last batch; what is read is kept until it is committed, for replays."""

    def __init__(self, options: dict) -> None:
        self.most = int(options.get("most", 500))
        self.socket = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
        self.socket.bind((options.get("host", "127.0.0.1"), int(options.get("port", 5514))))
        self.socket.setblocking(False)
        self.kept: dict[int, tuple] = {}

    def initialOffset(self) -> dict:
        return {"n": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        at = start["n"]
        for _ in range(self.most):
            try:
                data, peer = self.socket.recvfrom(65_536)
            except BlockingIOError:
                break
            text = data.decode("utf-8", "replace").rstrip("\r\n")
            if text:
                self.kept[at] = (f"udp-{peer[0]}", text)
                at += 1
        return iter([self.kept[k] for k in range(start["n"], at)]), {"n": at}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([self.kept[k] for k in range(start["n"], end["n"]) if k in self.kept])

    def commit(self, end: dict) -> None:
        for k in [k for k in self.kept if k < end["n"]]:
            del self.kept[k]


class Datagrams(DataSource):
    @classmethod
    def name(cls) -> str:
        return "datagrams"

    def schema(self) -> str:
        return "source_id string, raw string"

    def simpleStreamReader(self, schema) -> DatagramReader:
        return DatagramReader(self.options)


