"""An encoder behind an HTTP service, as a callable that reaches the executors with the task."""

from __future__ import annotations

import json
import math
import time
import urllib.error
import urllib.request
from collections.abc import Sequence
from dataclasses import dataclass

from tidemark.sources.fetch import TRIES, wait_before


class EncoderError(RuntimeError):
    """The service does not answer, refuses, or gives something that is no vector of the right width."""


@dataclass(frozen=True)
class HttpEncoder:
    """Unit vectors of ``width`` numbers from a service that takes ``{"model", "prompt"}`` and gives ``{"embedding"}``.

    A longer vector is cut to ``width`` and brought to unit length again, a shorter one is an error. Overload, server errors and
    lost connections are tried again with growing waits; anything else fails at once, and so the task, which Spark repeats.
    """

    host: str
    model: str
    width: int
    path: str = "/api/embeddings"
    timeout: float = 120.0
    tries: int = TRIES
    longest_wait: float = 30.0

    def __call__(self, texts: Sequence[str]) -> list[list[float]]:
        return [self._unit(self._ask(t)) for t in texts]

    def _ask(self, text: str) -> list[float]:
        body = json.dumps({"model": self.model, "prompt": text}).encode()
        request = urllib.request.Request(self.host.rstrip("/") + self.path, data=body, headers={"content-type": "application/json"})
        for attempt in range(self.tries):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    return json.load(answer)["embedding"]
            except urllib.error.HTTPError as e:
                why, again = f"status {e.code}: {e.read(200).decode(errors='replace')}", e.code == 429 or e.code >= 500
            except (KeyError, TypeError, ValueError) as e:
                why, again = f"no vector in the answer ({e})", False
            except OSError as e:
                why, again = f"no answer ({e})", True
            if not again or attempt == self.tries - 1:
                break
            time.sleep(min(self.longest_wait, wait_before(attempt)))
        raise EncoderError(f"{self.host}, {self.model}, {len(text)} characters: {why}")

    def _unit(self, raw: list[float]) -> list[float]:
        if len(raw) < self.width:
            raise EncoderError(f"{self.model} gives {len(raw)} numbers, not {self.width}")
        cut = [float(x) for x in raw[: self.width]]
        size = math.sqrt(sum(x * x for x in cut))
        return [x / size for x in cut] if size else cut
