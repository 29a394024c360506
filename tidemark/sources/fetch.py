"""Filling a landing folder from the driver: paced, repeated where it helps, and never fetched twice.

A transport is any callable that gives status, headers and the body in pieces; ``http_transport`` is the standard library's.
"""

from __future__ import annotations

import os
import random
import re
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from pathlib import Path
from urllib.parse import urlsplit

from tidemark.sources.tables import keep_answer
from tidemark.sources.urls import LANDING

Answer = tuple[int, Mapping[str, str], Iterable[bytes]]

# The longest wait between two tries, tries, requests a second.
MAX_WAIT, TRIES, RATE = 30.0, 5, 5.0


@dataclass(frozen=True)
class Settings:
    """Where things are and who asks. The archive wants an address in every request."""

    contact: str
    root: Path = field(default_factory=lambda: Path(os.environ.get("TIDEMARK_ROOT", "data")))
    rate: float = RATE

    def __post_init__(self) -> None:
        if "@" not in self.contact:
            raise ValueError("a contact address is needed")

    @property
    def landing(self) -> Path:
        return self.root / "landing"

    @property
    def facts(self) -> Path:
        return self.root / "facts"


class Pace:
    """At most so many requests a second, over all threads."""

    def __init__(self, rate: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        if rate <= 0:
            raise ValueError("the rate must be positive")
        self.gap, self.clock, self.sleep = 1 / rate, clock, sleep
        self.free, self.lock = 0.0, threading.Lock()

    def wait(self) -> None:
        with self.lock:
            now = self.clock()
            at = max(now, self.free)
            self.free = at + self.gap
        if at > now:
            self.sleep(at - now)


def wait_before(attempt: int, retry_after: str | None = None, chance: Callable[[], float] = random.random) -> float:
    """Seconds before a further try: what the server asks for, else doubling with a random part; never more than 30."""
    if retry_after and retry_after.strip().isdigit():
        return min(MAX_WAIT, float(retry_after))
    return min(MAX_WAIT, 2.0**attempt * (0.5 + chance() / 2))


def place_of(url: str) -> str:
    """As ``urls.landing_path``, on the driver."""
    parts = urlsplit(url)
    safe = lambda s: re.sub(r"[^A-Za-z0-9._/-]", "_", re.sub(r"(?:(?<=/)|^)\.+(?=/|$)", "", s))
    for pattern, place in LANDING:
        if re.search(pattern, parts.path):
            return re.sub("/{2,}", "/", safe(re.sub(pattern, place.replace("$", "\\"), parts.path)))
    return re.sub("/{2,}", "/", f"misc/{safe(parts.netloc)}/{safe(parts.path.lstrip('/'))}")


class FetchError(RuntimeError):
    def __init__(self, url: str, status: int) -> None:
        super().__init__(f"{url}: status {status}")
        self.status = status


def http_transport(settings: Settings, timeout: float = 60.0, piece: int = 1 << 16) -> Callable[[str], Answer]:
    """Requests that say who asks. A lost connection counts as an overloaded server."""

    def pieces(answer) -> Iterator[bytes]:
        with answer:
            while part := answer.read(piece):
                yield part

    def ask(url: str) -> Answer:
        request = urllib.request.Request(url, headers={"user-agent": settings.contact})
        try:
            answer = urllib.request.urlopen(request, timeout=timeout)
        except urllib.error.HTTPError as e:
            return e.code, {k.lower(): v for k, v in e.headers.items()}, ()
        except OSError:
            return 503, {}, ()
        return answer.status, {k.lower(): v for k, v in answer.headers.items()}, pieces(answer)

    return ask


class Landing:
    """Answers by address. Every try takes a turn of the pace; only overload and server errors are tried again."""

    def __init__(self, folder: str | Path, transport: Callable[[str], Answer], pace: Pace, sleep: Callable[[float], None] = time.sleep) -> None:
        self.folder, self.transport, self.pace, self.sleep = Path(folder), transport, pace, sleep

    def get(self, url: str, *, refresh: bool = False) -> tuple[Path, bool]:
        """The file of an answer, and whether it was there before."""
        path = self.folder / place_of(url)
        if path.exists() and not refresh:
            return path, True
        for attempt in range(TRIES):
            self.pace.wait()
            status, headers, body = self.transport(url)
            if status == 200:
                keep_answer(path, iter(body), url=url, status=status, content_type=headers.get("content-type", ""), etag=headers.get("etag", ""))
                return path, False
            if status != 429 and status < 500 or attempt == TRIES - 1:
                raise FetchError(url, status)
            self.sleep(wait_before(attempt, headers.get("retry-after")))
        raise AssertionError

    def get_all(self, urls: Iterable[str]) -> tuple[list[Path], dict[str, str]]:
        """Files, and what failed: one failure does not end the others."""
        done, failed = [], {}
        for u in urls:
            try:
                done.append(self.get(u)[0])
            except FetchError as e:
                failed[u] = str(e)
        return done, failed
