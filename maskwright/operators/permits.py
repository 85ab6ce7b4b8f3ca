"""Permits for calls: over all tasks together, so many calls in flight, and none after a failure that concerns all calls.

The driver answers on a socket; a task asks before each call and tells how it went. So a table may have as many partitions
as its size asks for, while a service sees ``most`` callers. A task that ends or dies gives its permit back with its
connection. A tally of what was asked stays with the driver."""

from __future__ import annotations

import hmac
import secrets
import socket
import socketserver
import threading
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import SparkSession

_ASK, _YES, _NO, _DONE, _STOP = b"?", b"y", b"n", b".", b"!"


@dataclass(frozen=True)
class Address:
    """What a task needs to ask: where, and the word that tells it from strangers."""

    host: str
    port: int
    word: bytes

    @contextmanager
    def desk(self) -> Iterator[Desk]:
        with socket.create_connection((self.host, self.port), timeout=None) as s:
            s.sendall(self.word)
            yield Desk(s)


class Desk:
    """A task's connection: one permit at a time."""

    def __init__(self, sock: socket.socket):
        self.sock = sock

    def may_call(self) -> bool:
        """Waits for a permit; False once calls are stopped, or where the driver is gone."""
        try:
            self.sock.sendall(_ASK)
            return self.sock.recv(1) == _YES
        except OSError:
            return False

    def done(self, systemic: bool = False) -> None:
        self.sock.sendall(_STOP if systemic else _DONE)
        self.sock.recv(1)  # the driver knows before this task goes on


class Permits:
    """The driver's side. ``stopped`` tells whether a call's failure was systemic, ``granted`` how many calls there were."""

    def __init__(self, most: int):
        self.most, self.free, self.granted, self.stopped = most, most, 0, False
        self.changed = threading.Condition()

    def take(self) -> bool:
        with self.changed:
            self.changed.wait_for(lambda: self.stopped or self.free > 0)
            if self.stopped:
                return False
            self.free -= 1
            self.granted += 1
            return True

    def give(self, stop: bool = False) -> None:
        with self.changed:
            self.free += 1
            self.stopped |= stop
            self.changed.notify_all()


@contextmanager
def permits(spark: SparkSession, most: int) -> Iterator[tuple[Permits, Address]]:
    """Permits that live while the block does, on the host that executors know the driver by."""
    held, word = Permits(most), secrets.token_bytes(32)

    class Handler(socketserver.BaseRequestHandler):
        def handle(self) -> None:
            got = b""
            while len(got) < len(word):
                part = self.request.recv(len(word) - len(got))
                if not part:
                    return
                got += part
            if not hmac.compare_digest(got, word):
                return
            mine = False
            try:
                while said := self.request.recv(1):
                    if said == _ASK:
                        mine = held.take()
                        self.request.sendall(_YES if mine else _NO)
                    elif mine:
                        mine = False
                        held.give(said == _STOP)
                        self.request.sendall(_DONE)
            except OSError:
                pass
            finally:
                if mine:
                    held.give()

    class Server(socketserver.ThreadingTCPServer):
        daemon_threads, allow_reuse_address, request_queue_size = True, True, 128

    host = spark.conf.get("spark.driver.host")
    with Server((spark.conf.get("spark.driver.bindAddress", host), 0), Handler) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        try:
            yield held, Address(host, server.server_address[1], word)
        finally:
            with held.changed:  # tasks that still wait are answered
                held.stopped = True
                held.changed.notify_all()
            server.shutdown()
