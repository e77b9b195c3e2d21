"""Command line, HTTP and question loop over the read API; all three call the same table of tools."""

from __future__ import annotations

import argparse
import inspect
import json
import threading
from collections.abc import Callable
from contextlib import AbstractContextManager, nullcontext
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, urlsplit

from talus.api import LedgerApi, clamp, tools
from talus.sources.sinks import plain, to_records

MOST_ROWS, MOST_BODY, ROUNDS = 60, 64 * 1024, 6


def call(api: LedgerApi, name: str, arguments: dict) -> list[dict]:
    """Rows of a tool; text arguments become the types of its parameters, unknown ones are refused."""
    table = tools(api)
    if name not in table:
        raise KeyError(name)
    takes = inspect.signature(table[name]).parameters
    unknown = set(arguments) - set(takes)
    if unknown:
        raise ValueError(f"{name} has no {', '.join(sorted(unknown))}")
    typed = {}
    for k, v in arguments.items():
        kind = str(takes[k].annotation)
        typed[k] = int(v) if "int" in kind and v is not None else float(v) if "float" in kind and v is not None else v
    if "limit" in typed:
        typed["limit"] = clamp(typed["limit"], 500)
    return to_records(table[name](**typed))


def described(api: LedgerApi) -> list[dict]:
    """The tools as a chat model is told of them."""
    out = []
    for name, f in tools(api).items():
        parameters = {k: {"type": "integer" if "int" in str(p.annotation) else "number" if "float" in str(p.annotation) else "string"} for k, p in inspect.signature(f).parameters.items()}
        required = [k for k, p in inspect.signature(f).parameters.items() if p.default is p.empty]
        out.append({"type": "function", "function": {"name": name, "description": (f.__doc__ or name).strip(), "parameters": {"type": "object", "properties": parameters, "required": required}}})
    return out


def ask(api: LedgerApi, question: str, chat: Callable[[list[dict], list[dict]], dict], rounds: int = ROUNDS, lock: AbstractContextManager | None = None) -> dict:
    """The answer of ``chat(messages, tools)`` with the calls it made; results are cut to 60 rows with a note.

    ``lock`` is held for each call of a tool, not while the model answers.
    """
    messages, trail = [{"role": "user", "content": question}], []
    for _ in range(rounds):
        turn = chat(messages, described(api))
        messages.append(turn)
        if not turn.get("tool_calls"):
            return {"answer": turn.get("content"), "trail": trail}
        for c in turn["tool_calls"]:
            name = c["function"]["name"]
            try:
                arguments = json.loads(c["function"].get("arguments") or "{}")
                with lock or nullcontext():
                    rows = call(api, name, arguments)
                result = {"rows": rows[:MOST_ROWS], "n_rows": len(rows), "cut": len(rows) > MOST_ROWS}
            except (KeyError, ValueError, TypeError) as e:
                arguments, result = c["function"].get("arguments"), {"error": str(e)}
            trail.append({"tool": name, "arguments": arguments, "n_rows": result.get("n_rows")})
            messages.append({"role": "tool", "tool_call_id": c.get("id"), "content": json.dumps(plain(result), ensure_ascii=False)})
    return {"answer": None, "trail": trail, "error": f"no answer in {rounds} rounds"}


def server(api: LedgerApi, port: int = 0, chat: Callable | None = None) -> ThreadingHTTPServer:
    """A local server: GET /health and /api/<tool>?..., POST /api/ask; 400 for bad arguments, 404 for unknown paths, 502 where the model fails."""
    lock = threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def _send(self, code: int, body: object) -> None:
            raw = json.dumps(body, ensure_ascii=False).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self) -> None:
            url = urlsplit(self.path)
            if url.path == "/health":
                return self._send(200, {"ok": True, "tools": sorted(tools(api))})
            try:
                with lock:
                    rows = call(api, url.path.removeprefix("/api/"), dict(parse_qsl(url.query)))
                self._send(200, {"rows": rows})
            except KeyError:
                self._send(404, {"error": "unknown path"})
            except (ValueError, TypeError) as e:
                self._send(400, {"error": str(e)})

        def do_POST(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            if size > MOST_BODY:
                return self._send(400, {"error": "body too large"})
            if self.path != "/api/ask" or chat is None:
                return self._send(404, {"error": "unknown path"})
            try:
                question = json.loads(self.rfile.read(size))["question"]
            except (ValueError, KeyError, TypeError):
                return self._send(400, {"error": "a question is needed"})
            try:
                answer = ask(api, question, chat, lock=lock)
            except (OSError, TimeoutError, RuntimeError) as e:
                return self._send(502, {"error": f"the model failed: {e}"})
            self._send(200, answer)

        def log_message(self, *args) -> None:
            return

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)


def main(argv: list[str] | None = None) -> int:
    from talus.session import build_session

    parser = argparse.ArgumentParser(prog="talus")
    parser.add_argument("folder")
    parser.add_argument("tool")
    parser.add_argument("arguments", nargs="*", help="name=value")
    a = parser.parse_args(argv)
    api = LedgerApi(build_session(), a.folder)
    print(json.dumps(call(api, a.tool, dict(x.split("=", 1) for x in a.arguments)), ensure_ascii=False, indent=1))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
