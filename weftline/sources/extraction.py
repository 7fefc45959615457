"""Extraction plans: templated requests, pagination, fan-out, conditions, retries and context, over any transport.

A plan is interpreted where it runs: in a task of the ``plan_responses`` data source, one partition for each plan and config. A
transport is a callable Request -> Response; ``replay`` answers from recorded responses, so tests need no network, and
``http_transport`` uses the standard library.
"""

from __future__ import annotations

import base64
import http.client
import json
import re
import threading
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import UTC, datetime
from xml.etree import ElementTree

from weftline.sources.jmespath import JmesError, as_bool, search

MAX_LOOPS, MAX_DEPTH, MAX_FIELD, MAX_CONTEXT, CONCURRENCY = 1000, 5, 64 * 1024, 1024 * 1024, 50
RETRYABLE = frozenset((408, 429, 500, 502, 503, 504))
_TEMPLATE = re.compile(r"\{\{(.+?)\}\}")


@dataclass
class Request:
    url: str
    method: str = "GET"
    headers: dict = field(default_factory=dict)
    body: object = None
    timeout: float = 30.0


@dataclass
class Response:
    status: int
    body: object = None
    headers: dict = field(default_factory=dict)


Transport = Callable[[Request], Response]


def text_of(x: object) -> str:
    """Text form in templates: null is "", whole floats lose their decimals, composites are JSON."""
    if x is None:
        return ""
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, float) and x.is_integer():
        return str(int(x))
    return x if isinstance(x, str) else json.dumps(x, separators=(",", ":"), ensure_ascii=False) if isinstance(x, dict | list) else str(x)


def render(template: object, data: dict) -> object:
    """{{ expression }} replaced in texts, through objects and lists."""
    if isinstance(template, str):
        return _TEMPLATE.sub(lambda m: text_of(search(m[1].strip(), data)), template)
    if isinstance(template, dict):
        return {k: render(v, data) for k, v in template.items()}
    return [render(v, data) for v in template] if isinstance(template, list) else template


def xml_to_dict(text: str) -> dict:
    """Attributes as @name, text as #text, repeated children as lists; names without namespace."""

    def name(tag: str) -> str:
        return tag.rpartition("}")[2]

    def node(e: ElementTree.Element) -> object:
        out: dict = {f"@{name(k)}": v for k, v in e.attrib.items()}
        children = list(e)
        if not children:
            content = (e.text or "").strip()
            if content and not out:
                return content
            return out | {"#text": content} if content else out
        groups: dict[str, list] = {}
        for c in children:
            groups.setdefault(name(c.tag), []).append(node(c))
        return out | {k: v[0] if len(v) == 1 else v for k, v in groups.items()}

    root = ElementTree.fromstring(text)
    return {name(root.tag): node(root)}


def decode(content: bytes, content_type: str) -> object:
    """A body by content type: JSON, XML as objects, text as it is, anything else as base64; broken JSON and XML as text."""
    kind = content_type.split(";")[0].strip().lower()
    try:
        if "json" in kind or (not kind and content[:1] in (b"{", b"[")):
            return json.loads(content) if content.strip() else None
        if "xml" in kind:
            return xml_to_dict(content.decode("utf-8", "replace"))
    except (ValueError, ElementTree.ParseError):
        return content.decode("utf-8", "replace")
    if kind.startswith("text/") or not kind:
        return content.decode("utf-8", "replace")
    return base64.b64encode(content).decode()


def http_transport(limit: int = 10 * 1024 * 1024) -> Transport:
    """Requests through the standard library; bodies beyond ``limit`` bytes are an error."""

    def send(r: Request) -> Response:
        data = None if r.body is None else r.body.encode() if isinstance(r.body, str) else json.dumps(r.body).encode()
        headers = dict(r.headers) if data is None or isinstance(r.body, str) else {"Content-Type": "application/json"} | r.headers
        request = urllib.request.Request(r.url, data=data, headers=headers, method=r.method)  # noqa: S310
        try:
            with urllib.request.urlopen(request, timeout=r.timeout) as got:  # noqa: S310
                content, status, head = got.read(limit + 1), got.status, dict(got.headers)
        except urllib.error.HTTPError as e:
            content, status, head = e.read(limit + 1), e.code, dict(e.headers)
        if len(content) > limit:
            raise ValueError("response body is too large")
        return Response(status, decode(content, head.get("Content-Type", "")), head)

    return send


def replay(recorded: list[dict]) -> Transport:
    """Answers from recorded {url, method?, status?, body?, headers?}; repeated ones of a URL in turn, the last one for ever."""
    left: dict[tuple, list[dict]] = {}
    for r in recorded:
        left.setdefault((r.get("method", "GET"), r["url"]), []).append(r)

    def send(r: Request) -> Response:
        found = left.get((r.method, r.url))
        if not found:
            return Response(404, {"error": "not recorded", "url": r.url})
        got = found.pop(0) if len(found) > 1 else found[0]
        return Response(got.get("status", 200), got.get("body"), got.get("headers") or {})

    return send


def backoff_ms(retry: dict | None, attempt: int, retry_after: str | None = None) -> int:
    """Delay before retry ``attempt`` (from 1), by Retry-After seconds or date if the server sent it, else by backoff_type."""
    retry = retry or {}
    first, cap = int(retry.get("initial_delay") or 1000), int(retry.get("max_delay") or 60_000)
    if retry_after:
        if retry_after.strip().isdigit():
            return min(int(retry_after) * 1000, cap)
        try:
            at = datetime.strptime(retry_after.strip(), "%a, %d %b %Y %H:%M:%S GMT").replace(tzinfo=UTC)
            return min(max(0, int((at - datetime.now(UTC)).total_seconds() * 1000)), cap)
        except ValueError:
            pass
    kind = retry.get("backoff_type") or "fibonacci"
    if kind == "linear":
        n = attempt
    elif kind == "exponential":
        n = 2 ** (attempt - 1)
    else:
        a, b = 1, 1
        for _ in range(2, attempt):
            a, b = b, a + b
        n = b
    return min(first * n, cap)


class Aborted(Exception):
    """A plan ended by abort_when or abort_on."""


class TransportError(Exception):
    """A request that got no response, after all retries."""


class RateLimiter:
    """Sliding-window log for each limit and scope key; waits with ``sleep`` until a request fits."""

    def __init__(self, limits: list[dict], clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.limits = sorted(limits, key=lambda x: -int(x.get("priority") or 0))
        self.clock, self.sleep, self.log, self.blocked, self.lock = clock, sleep, {}, {}, threading.Lock()

    def key(self, limit: dict, url: str, config_id: str) -> tuple:
        scope = limit.get("scope") or "global"
        return (limit["name"], config_id if scope == "per_config" else url.split("?")[0] if scope == "per_endpoint" else "")

    def acquire(self, url: str, config_id: str) -> None:
        with self.lock:  # requests that have to wait do so in turn
            self._acquire(url, config_id)

    def _acquire(self, url: str, config_id: str) -> None:
        for limit in self.limits:
            if limit.get("endpoint") and not re.search(limit["endpoint"], url):
                continue
            key = self.key(limit, url, config_id)
            if (until := self.blocked.get(key, 0)) > self.clock():
                self.sleep(until - self.clock())
            log, window = self.log.setdefault(key, []), float(limit["window_secs"])
            while limit.get("requests"):
                now = self.clock()
                log[:] = [t for t in log if t > now - window]
                if len(log) < int(limit["requests"]):
                    break
                self.sleep(max(0.001, log[0] + window - now))
            log.append(self.clock())

    def observe(self, url: str, config_id: str, response: Response) -> None:
        """Blocks a scope for as long as the response's headers ask for."""
        for limit in self.limits:
            dynamic = limit.get("dynamic") or {}
            head = {k.lower(): v for k, v in response.headers.items()}
            left, reset = head.get((dynamic.get("remaining_header") or "").lower()), head.get((dynamic.get("reset_header") or "").lower())
            after = head.get((dynamic.get("retry_after") or "retry-after").lower()) if response.status == 429 else None
            wait = float(after) if after and after.isdigit() else float(reset) if left == "0" and reset and reset.isdigit() else 0
            if wait:
                self.blocked[self.key(limit, url, config_id)] = self.clock() + min(wait, 60.0)


class PlanRunner:
    """Runs a plan for one config. ``run`` yields emitted envelopes; ``context`` holds what set_context stored."""

    def __init__(self, plan: dict, config: dict, transport: Transport, tenant_id: str = "", execution_id: str = "", context: dict | None = None, sleep: Callable[[float], None] = time.sleep, headers: dict | None = None):
        self.plan, self.config, self.send = plan, config, transport
        self.tenant_id, self.execution_id, self.context = tenant_id, execution_id, dict(context or {})
        self.sleep, self.headers = sleep, headers or {}
        self.limiter = RateLimiter(plan.get("rate_limits") or [], sleep=sleep)
        self.status, self.api_calls = "completed", 0

    def run(self) -> Iterator[dict]:
        try:
            yield from self.step(self.plan["step"], {}, "root", 0)
        except Aborted as e:
            self.status = "aborted"
            yield self.envelope("root", None, None, error=str(e))
        except (JmesError, ValueError, LookupError, TypeError) as e:  # a plan or context that can't go on: what came before stays
            self.status = "failed"
            yield self.envelope("root", None, None, error=f"{type(e).__name__}: {e}")

    def data(self, extra: dict, response: Response | None = None, prev: Response | None = None) -> dict:
        out = {"config": self.config, "context": self.context, **extra}
        for name, r in (("response", response), ("prev", prev)):
            out[name] = r.body if r else None
            out[f"{name}_meta"] = {"status": r.status, "headers": r.headers} if r else None
        out["status_code"] = response.status if response else None
        out["headers"] = response.headers if response else None
        return out

    def test(self, expression: str | None, data: dict) -> bool:
        return bool(expression) and as_bool(search(expression, data))

    def request(self, step: dict, data: dict) -> Request:
        url = render(step["url"], data)
        params = {k: render(v, data) for k, v in (step.get("params") or {}).items()}
        if params := {k: v for k, v in params.items() if v != ""}:
            url += ("&" if "?" in url else "?") + urllib.parse.urlencode(params)
        return Request(url, (step.get("method") or "GET").upper(), self.headers | render(step.get("headers") or {}, data), render(step.get("body"), data), float(step.get("timeout_seconds") or 30))

    def call(self, step: dict, extra: dict, prev: Response | None) -> tuple[Request, Response, int]:
        retry, attempt = step.get("retry") or {}, 0
        most = int(retry.get("max_retries", 3))
        while True:
            data = self.data(extra, None, prev)
            request = self.request(step, data)
            self.limiter.acquire(request.url, str(self.config.get("id", "")))
            began = time.monotonic()
            self.api_calls += 1
            try:
                response = self.send(request)
            except (OSError, http.client.HTTPException) as e:  # refused, timed out, cut off
                attempt += 1
                if attempt > most:
                    raise TransportError(f"{request.method} {request.url}: {type(e).__name__}: {e}") from e
                self.sleep(backoff_ms(retry, attempt) / 1000)
                continue
            took = int((time.monotonic() - began) * 1000)
            self.limiter.observe(request.url, str(self.config.get("id", "")), response)
            again = self.test(step.get("retry_when"), self.data(extra, response, prev)) or response.status in RETRYABLE and response.status not in (step.get("abort_on") or []) + (step.get("ignore_on") or [])
            attempt += 1
            if not again or attempt > most:
                return request, response, took
            after = {k.lower(): v for k, v in response.headers.items()}.get("retry-after")
            self.sleep(backoff_ms(retry, attempt, after) / 1000)

    def envelope(self, path: str, request: Request | None, response: Response | None, body: object = None, error: str | None = None, took: int = 0, extracted: dict | None = None) -> dict:
        text = json.dumps(body, ensure_ascii=False, separators=(",", ":")) if body is not None else None
        return {
            "tenant_id": self.tenant_id, "integration": str(self.config.get("integration", "")), "plan_key": self.plan.get("key", ""), "config_id": str(self.config.get("id", "")), "execution_id": self.execution_id,
            "step_path": path, "request_url": request.url if request else None, "request_method": request.method if request else None, "status_code": response.status if response else None,
            "response_body": text, "response_headers": {k: str(v) for k, v in response.headers.items()} if response else {}, "response_size": len(text or ""), "duration_ms": took,
            "extracted_data": json.dumps(extracted) if extracted else None, "error": error,
        }

    def keep(self, step: dict, data: dict) -> dict:
        """Stores what set_context asks for; larger values than MAX_FIELD, or a context beyond MAX_CONTEXT, are errors."""
        found = {}
        for name, expression in (step.get("set_context") or {}).items():
            value = search(expression, data)
            if value is None:
                continue
            if len(json.dumps(value)) > MAX_FIELD:
                raise ValueError(f"context field {name!r} is too large")
            self.context[name] = found[name] = value
        if len(json.dumps(self.context)) > MAX_CONTEXT:
            raise ValueError("context is too large")
        return found

    def step(self, step: dict, extra: dict, path: str, depth: int) -> Iterator[dict]:
        if depth > int(self.plan.get("max_nesting_depth") or MAX_DEPTH):
            raise ValueError("sub-steps are nested too deeply")
        prev: Response | None = None
        most, loop = int(step.get("max_loops") or self.plan.get("max_loops") or MAX_LOOPS), 0
        while True:
            if loop == most:
                self.status = "failed"
                yield self.envelope(path, request, None, error=f"more than {most} loops: the pages after are missing")
                return
            loop += 1
            try:
                request, response, took = self.call(step, extra, prev)
            except TransportError as e:
                self.status = "failed"
                yield self.envelope(path, None, None, error=f"transport: {e}")
                return
            data = self.data(extra, response, prev)
            bad = response.status in (step.get("abort_on") or [])
            if bad or self.test(step.get("abort_when"), data):
                yield self.envelope(path, request, response, response.body, "aborted", took)
                raise Aborted(f"{path}: status {response.status}" if bad else f"{path}: abort_when")
            if response.status in (step.get("ignore_on") or []) or self.test(step.get("ignore_when"), data):
                yield self.envelope(path, request, response, response.body, "ignored", took)
            elif not 200 <= response.status < 300:
                yield self.envelope(path, request, response, response.body, f"status {response.status}", took)
                return
            else:
                found = self.keep(step, data)
                if step.get("iterate_over"):
                    yield from self.fan_out(step, extra, data, path, depth, request, response, took)
                if step.get("emit_to_kafka", step.get("emit", True)) and not (step.get("iterate_over") and step.get("fanout_emit_mode") == "page"):
                    yield self.envelope(path, request, response, response.body, None, took, found)
            if not step.get("while") or self.test(step.get("break_when"), data) or not self.test(step["while"], self.data(extra, response, prev)):
                return
            prev = response

    def fan_out(self, step: dict, extra: dict, data: dict, path: str, depth: int, request: Request, response: Response, took: int) -> Iterator[dict]:
        """Sub-steps for each item, up to ``concurrency`` items at a time, results in the order of the items; the bodies of
        sub-steps enrich a copy of the item under the sub-step's id."""
        items = search(step["iterate_over"], data) or []

        def one(at: tuple[int, object]) -> tuple[list[dict], dict]:
            i, item = at
            enriched, out = dict(item) if isinstance(item, dict) else {"value": item}, []
            for n, sub in enumerate(step.get("sub_steps") or []):
                name = sub.get("id") or f"step_{n}"
                for e in self.step(sub | {"emit": True}, extra | {"item": enriched, "parent": data["response"]}, f"{path}.{name}[{i}]", depth + 1):
                    if e["error"] is None and e["response_body"] is not None and e["step_path"] == f"{path}.{name}[{i}]":
                        enriched[name] = json.loads(e["response_body"])
                    if e["error"] is not None or sub.get("emit_to_kafka", True):
                        out.append(e)
            return out, enriched

        page = []
        with ThreadPoolExecutor(max(1, min(int(step.get("concurrency") or CONCURRENCY), len(items)))) as pool:
            done = list(pool.map(one, enumerate(items)))
        for i, (events, enriched) in enumerate(done):
            yield from events
            page.append(enriched)
            if (step.get("fanout_emit_mode") or "record") == "record":
                yield self.envelope(f"{path}.fanout[{i}]", request, response, enriched, None, took)
        if step.get("fanout_emit_mode") == "page":
            yield self.envelope(f"{path}.fanout", request, response, page, None, took)


class TokenCache:
    """Access tokens by auth flow, for as long as they last less a margin."""

    def __init__(self, clock: Callable[[], float] = time.time, skew: float = 60.0):
        self.clock, self.skew, self.held = clock, skew, {}

    def get(self, flow: dict, config: dict, transport: Transport) -> str:
        """flow: {id, plan, token_path, ttl_path?, ttl_seconds?}: runs the plan and takes the token by expression."""
        key = (flow["id"], config.get("id"))
        if key in self.held and self.held[key][1] > self.clock():
            return self.held[key][0]
        runner = PlanRunner(flow["plan"], config, transport)
        bodies = [json.loads(e["response_body"]) for e in runner.run() if e["error"] is None and e["response_body"]]
        if not bodies or (token := search(flow["token_path"], bodies[-1])) is None:
            raise JmesError("the auth flow gave no token")
        ttl = search(flow["ttl_path"], bodies[-1]) if flow.get("ttl_path") else None
        self.held[key] = (text_of(token), self.clock() + float(ttl or flow.get("ttl_seconds") or 3600) - self.skew)
        return self.held[key][0]
