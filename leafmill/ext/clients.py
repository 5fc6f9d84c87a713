"""Clients of models and voices: what is tried again, what is waited for, and what ends at once.

A transport is a callable: it takes a request (a dict) and returns a Reply, or
raises ConnectionError or TimeoutError. None is bundled; tests use scripted ones.
A client is made in each Python worker (services.called takes its factory), so
that a partition has one connection, and the number of partitions bounds how many
requests run at once.
"""

from __future__ import annotations

import email.utils
import json
import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone

from leafmill.functions import codes

# Statuses that pass, the most attempts, limits of requests, and seconds between looks at the network.
TRANSIENT = (408, 429, 500, 502, 503, 504)
MODEL_ATTEMPTS, VOICE_ATTEMPTS, OFFLINE_POLL = 5, 6, 30.0
#: Of a voice mode: the signs and bytes at which texts are cut, and those that a request may not exceed; starts a second; signs around it that it may carry.
LIMITS = {
    "normal": dict(max_chars=None, max_bytes=4500, most_chars=None, most_bytes=5000, per_second=3.0, around=0),
    "advanced": dict(max_chars=1800, max_bytes=None, most_chars=2000, most_bytes=None, per_second=None, around=100),
}


class Failure(RuntimeError):
    """A call that will not be tried again now; code is one of functions.codes."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Reply:
    status: int = 200
    headers: dict = field(default_factory=dict)
    body: dict = field(default_factory=dict)


def _number(text: str | None) -> float | None:
    try:
        return float(text)
    except (TypeError, ValueError):
        return None


def _seconds_until(text: str | None) -> float | None:
    try:
        then = email.utils.parsedate_to_datetime(text)
    except (TypeError, ValueError):
        return None
    return (then if then.tzinfo else then.replace(tzinfo=timezone.utc)).timestamp() - datetime.now(timezone.utc).timestamp()


@dataclass
class Patience:
    """Waits and looks at whether the work was cancelled; all that a client does with time goes through it."""

    sleep: Callable[[float], None] = time.sleep
    chance: Callable[[], float] = random.random
    cancelled: Callable[[], bool] = lambda: False

    def check(self) -> None:
        if self.cancelled():
            raise Failure("cancelled", "the work was cancelled")

    def wait(self, seconds: float, step: float = 1.0) -> None:
        """Sleeps in steps, so that a cancelled wait ends within one."""
        while seconds > 0:
            self.check()
            self.sleep(min(step, seconds))
            seconds -= step
        self.check()


class Model:
    """A model behind a transport: call({system, user, images, json}) is its text.

    A broken connection is waited out and costs no attempt; timeouts and statuses
    that pass cost one each; a wrong key, an empty account and a bad request end at
    once, and so do answers that were cut off or refused.
    """

    def __init__(self, transport: Callable[[dict], Reply], identity: dict, online: Callable[[], bool] = lambda: True, patience: Patience | None = None):
        self.transport, self.identity, self.online, self.patience = transport, identity, online, patience or Patience()

    def _wait_for_network(self) -> None:
        while not self.online():
            self.patience.wait(OFFLINE_POLL)

    def call(self, request: dict) -> str:
        for failed in self._attempts():
            self.patience.check()
            try:
                reply = self.transport({**request, "settings": self.identity})
            except TimeoutError:
                failed("timeout", None)
                continue
            except ConnectionError:
                self._wait_for_network()
                continue
            if reply.status < 300:
                return self._text(reply.body)
            error = str(reply.body.get("error", ""))
            if reply.status == 429 and "insufficient_quota" in error:
                raise Failure("quota", error)
            if reply.status in (401, 403):
                raise Failure("auth", error)
            if reply.status == 400:
                raise Failure("unknown", error)
            failed(f"status {reply.status}", reply.headers.get("retry-after"))
        raise AssertionError("attempts end by a failure")

    def _attempts(self) -> Iterator[Callable[[str, str | None], None]]:
        """As many turns as it takes; each gives a function that counts and waits after a failed attempt."""
        n = 0

        def failed(why: str, given: str | None) -> None:
            nonlocal n
            n += 1
            if n >= MODEL_ATTEMPTS:
                raise Failure("unknown", f"no answer after {n} attempts: {why}")
            own = min(60.0, 2.0**n) + self.patience.chance()
            self.patience.wait(max(own, min(120.0, _number(given) or 0.0)))

        while True:
            yield failed

    @staticmethod
    def _text(body: dict) -> str:
        if body.get("finish_reason") == "length":
            raise Failure("unknown", "the answer was cut off")
        if body.get("refusal"):
            raise Failure("unknown", "the model refused")
        return body.get("text") or ""


class Voice:
    """A voice behind a transport: call({text, previous_text, future_text}) is the sound, as the reply's `frames`."""

    def __init__(self, transport: Callable[[dict], Reply], mode: str, name: str, patience: Patience | None = None, clock: Callable[[], float] = time.monotonic):
        if mode not in LIMITS:
            raise Failure("config", f"no voice mode {mode}")
        self.limits = LIMITS[mode]
        self.transport, self.patience, self.clock = transport, patience or Patience(), clock
        self.identity = {"mode": mode, "voice": name, "sample_rate": 24_000}
        self._slot, self._checked = 0.0, False

    def _send(self, request: dict) -> dict:
        for attempt in range(VOICE_ATTEMPTS):
            last = attempt == VOICE_ATTEMPTS - 1
            own = min(30.0, 2.0**attempt) + self.patience.chance()
            self.patience.check()
            try:
                reply = self.transport(request)
            except (ConnectionError, TimeoutError):
                if last:
                    raise Failure("unknown", "no connection to the voice") from None
                self.patience.wait(own)
                continue
            if reply.status < 300:
                return reply.body
            if reply.status not in TRANSIENT or last:
                raise Failure(codes.STATUS_CODES.get(reply.status, "unknown"), f"status {reply.status}")
            header = reply.headers.get("retry-after")
            given = _number(header) if _number(header) is not None else _seconds_until(header)
            self.patience.wait(own if given is None else min(60.0, max(0.0, given)))
        raise AssertionError("attempts end by a failure")

    def check(self) -> None:
        """Asks once whether the voice exists, before anything is paid for."""
        if not self._checked:
            if self.identity["voice"] not in self._send({"voices": True}).get("voices", []):
                raise Failure("config", f"no voice {self.identity['voice']}")
            self._checked = True

    def call(self, request: dict) -> str:
        text, around = request["text"], self.limits["around"]
        if self.limits["most_chars"] and len(text) > self.limits["most_chars"] or self.limits["most_bytes"] and len(text.encode()) > self.limits["most_bytes"]:
            raise Failure("unknown", "the text is longer than the voice takes")
        if self.limits["per_second"]:
            now = self.clock()
            begin = max(now, self._slot)
            self._slot = begin + 1 / self.limits["per_second"]
            self.patience.wait(begin - now)
        sides = {"previous_text": (request.get("previous_text") or "")[-around:], "future_text": (request.get("future_text") or "")[:around]} if around else {}
        frames = self._send({"text": text, "voice": self.identity["voice"], **{k: v for k, v in sides.items() if v}}).get("frames")
        if not frames or len(frames) % 4:  # base64 is in fours
            raise Failure("unknown", "the voice gave no whole sound")
        return frames


class Repaired:
    """A model's answers as checked JSON: one that does not hold is quoted back with what is wrong, once.

    check(data, request) raises ValueError for an answer that does not hold.
    rejected collects them, for a table of their own.
    """

    def __init__(self, model: object, check: Callable[[dict, dict], None], attempts: int = 2):
        self.model, self.check, self.attempts = model, check, attempts
        self.identity = model.identity
        self.rejected: list[tuple[str, str]] = []

    def call(self, request: dict) -> str:
        asked, error = dict(request, json=True), ""
        for _ in range(self.attempts):
            raw = self.model.call(asked)
            try:
                data = json.loads(raw)
                self.check(data, request)
                return json.dumps(data, ensure_ascii=False, sort_keys=True)
            except (ValueError, TypeError, KeyError) as e:
                error = str(e)
                self.rejected.append((raw, error))
                asked = dict(asked, text=f"{asked['text']}\n\nThis answer does not hold:\n{raw}\n\nbecause: {error}\nGive the whole object again, corrected.")
        raise Failure("unknown", f"no valid answer: {error}")
