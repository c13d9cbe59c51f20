"""How a polite fetcher behaves: pace, retries, redirects, size. What sends a request is given by the caller, so nothing
here opens a connection; a fetch's result is a row of the table that verification reads."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from email.utils import parsedate_to_datetime
from urllib.parse import urljoin

from linkloom.functions import safety, urls
from linkloom.functions.robots import can_fetch

#: url, headers to send -> status, headers, chunks of the body.
Send = Callable[[str, Mapping[str, str]], tuple[int, Mapping[str, str], Iterable[bytes]]]
RETRIED, REDIRECTS = (429, 503), (301, 302, 303, 307, 308)


@dataclass
class Pace:
    """At most so many requests a second, in all and to each host."""

    overall: float = 5.0
    per_host: float = 1.0
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    _free: dict[str, float] = field(default_factory=dict)

    def wait(self, host: str) -> float:
        """Takes the next moment that is free for a host, and sleeps until then; for how long."""
        now = self.clock()
        at = max(now, self._free.get("", now), self._free.get(host, now))
        self._free[""], self._free[host] = at + 1 / self.overall, at + 1 / self.per_host
        if at > now:
            self.sleep(at - now)
        return at - now


def pause(attempt: int, retry_after: str | None = None, now: float | None = None, most: float = 30, most_asked: float = 60) -> float:
    """Seconds before the next attempt (0 is the first): what the answer asks for, as seconds or a date, else 1, 2, 4, ..."""
    asked = None
    if retry_after:
        try:
            asked = float(retry_after)
        except ValueError:
            try:
                asked = parsedate_to_datetime(retry_after).timestamp() - (time.time() if now is None else now)
            except ValueError:
                asked = None
    return min(most, 2.0**attempt) if asked is None else min(most_asked, max(0.0, asked))


@dataclass
class Fetcher:
    """Fetches with safety checks before every hop."""

    send: Send
    lookup: Callable[[str], Iterable[str]] | None = None
    agent: str = "linkloom"
    robots: Callable[[str], str | None] = lambda place: None
    pace: Pace = field(default_factory=Pace)
    retries: int = 3
    redirects: int = 5
    most_bytes: int = 10 << 20

    def fetch(self, url: str) -> dict[str, object]:
        """A row of FETCHES; ``error`` is blocked where safety or robots.txt forbid it, fetch where it failed."""
        row = {"url": url, "final_url": None, "status": None, "content_type": None, "body": None, "redirect_chain": [], "error": None}
        try:
            here, chain = url, []
            while True:
                status, headers, body = self._answer(here)
                target = headers.get("location")
                if status not in REDIRECTS or not target:
                    break
                chain.append(here)
                if len(chain) > self.redirects:
                    raise OSError("too many redirects")
                here = urljoin(here, target)
        except safety.UnsafeUrl:
            return row | {"error": "blocked"}
        except (OSError, ValueError):
            return row | {"error": "fetch"}
        return row | {"final_url": here, "status": status, "content_type": headers.get("content-type", ""), "body": body, "redirect_chain": chain}

    def _answer(self, url: str) -> tuple[int, dict[str, str], bytes]:
        """The last answer of some attempts, names of headers in lower case, the body up to the bound."""
        place = safety.admitted(url, self.lookup)
        if not can_fetch(self.robots(site_of(url)), self.agent, url):
            raise safety.UnsafeUrl(f"robots.txt forbids {url}")
        for attempt in range(self.retries + 1):
            self.pace.wait(place.host)
            status, headers, chunks = self.send(url, {"User-Agent": self.agent})
            headers = {k.lower(): v for k, v in headers.items()}
            if status not in RETRIED or attempt == self.retries:
                break
            self.pace.sleep(pause(attempt, headers.get("retry-after")))
        body = bytearray()
        for chunk in chunks:
            body += chunk
            if len(body) > self.most_bytes:
                raise OSError(f"more than {self.most_bytes} bytes")
        return status, headers, bytes(body)


def site_of(url: str) -> str:
    """Where a site's robots.txt is."""
    found = urls.Address.of(url)
    return f"{found.scheme}://{found.host}{f':{found.port}' if found.port else ''}/robots.txt" if found else ""
