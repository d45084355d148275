"""The HTTP connector: posts a decision request as JSON and reads the answer."""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from email.utils import parsedate_to_datetime
from urllib.parse import urlsplit

#: Fixed value: what a 400 or 422 says when a chunk didn't fit the model.
TOO_LONG = re.compile(r"context (length|window)|maximum context|too many tokens|token limit|too long|too large", re.I)
QUOTED = 20
SHOWN = 200


class HttpError(Exception):
    """A failed request; status 413 stands for "too long" whatever the provider's status; no status: not a valid answer."""

    def __init__(self, message: str, status: int | None = None, retry_after_ms: float | None = None):
        super().__init__(message)
        self.status, self.retry_after_ms = status, retry_after_ms

    def __reduce__(self):
        return HttpError, (self.args[0], self.status, self.retry_after_ms)


def effective_status(status: int, body: str) -> int:
    return 413 if status in (400, 422) and TOO_LONG.search(body) else status


def retry_after(value: str | None, now: float | None = None) -> float | None:
    """Milliseconds, from seconds or an HTTP date; none if neither."""
    if value is None or not value.strip():
        return None
    try:
        seconds = float(value)
        return max(0.0, seconds * 1000) if abs(seconds) != float("inf") and seconds == seconds else None
    except ValueError:
        pass
    try:
        then = parsedate_to_datetime(value).timestamp()
    except (TypeError, ValueError):
        return None
    return max(0.0, (then - (time.time() if now is None else now)) * 1000)


def provider_message(body: str, state: str) -> str | None:
    """The provider's own message, cut short; withheld if it quotes the chunk, so that texts don't reach logs."""
    try:
        said = json.loads(body)
    except ValueError:
        return None
    message = None
    if isinstance(said, dict):
        error = said.get("error")
        message = error.get("message") if isinstance(error, dict) else None
        if message is None:
            message = said.get("message")
    if not isinstance(message, str):
        return None
    message = message.strip()[:SHOWN]
    quotes = any(message[i : i + QUOTED] in state for i in range(max(1, len(message) - QUOTED + 1)))
    return None if not message or quotes else message


class HttpTransport:
    """Callable(request, timeout in seconds) -> response. Network failures are ConnectionErrors, which are retried."""

    def __init__(self, url: str, api_key: str):
        self.url, self.api_key = url, api_key

    def __repr__(self) -> str:  # the key is never shown
        return f"HttpTransport({self.url!r})"

    def __call__(self, request: dict, timeout: float) -> dict:
        host = urlsplit(self.url).netloc
        data = json.dumps(request, ensure_ascii=False).encode()
        post = urllib.request.Request(self.url, data, {"authorization": f"Bearer {self.api_key}", "content-type": "application/json"}, method="POST")
        try:
            with urllib.request.urlopen(post, timeout=timeout) as response:
                body = response.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            body = e.read().decode("utf-8", "replace")
            detail = provider_message(body, request["state"])
            raise HttpError(f"{host} returned HTTP {e.code}" + (f": {detail}" if detail else ""), effective_status(e.code, body), retry_after(e.headers.get("retry-after"))) from None
        except TimeoutError:
            raise
        except OSError as e:
            if isinstance(getattr(e, "reason", None), TimeoutError):
                raise TimeoutError from None
            raise ConnectionError(str(e)) from None
        try:
            return json.loads(body)
        except ValueError:
            raise HttpError(f"{host} answered with something other than JSON") from None
