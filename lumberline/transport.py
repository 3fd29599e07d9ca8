"""The session's tools as JSON-RPC 2.0: one request a line on a stream, or one a POST over HTTP.

A tool's schema follows from the signature of the session's method, and arguments are checked against it before the call.
"""

from __future__ import annotations

import inspect
import json
import threading
import types
import typing
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, HTTPServer, ThreadingHTTPServer
from typing import IO, Any

from .functions.timefmt import parse_time_param
from .session import Session, ToolError

#: Versions of the protocol that are spoken, the last one if a client asks for another.
PROTOCOLS = ("2024-11-05", "2025-03-26", "2025-06-18")
#: Characters of a request that are read.
LARGEST_REQUEST = 4 << 20
PARSE_ERROR, BAD_REQUEST, NO_METHOD, BAD_PARAMS, INTERNAL = -32700, -32600, -32601, -32602, -32603
#: The tools by name, and the methods that answer them.
TOOLS = {
    "load_log": Session.load_log,
    "load_logs": Session.load_logs,
    "load_start": Session.load_start,
    "load_status": Session.load_status,
    "load_cancel": Session.load_cancel,
    "list_logs": Session.list_logs,
    "close_log": Session.close_log,
    "refresh": Session.refresh,
    "trim": Session.trim,
    "find_occurrences": Session.find_occurrences,
    "summarize_log": Session.summarize_log,
    "get_timeline_histogram": Session.get_timeline_histogram,
    "get_template": Session.get_template,
    "get_template_anomalies": Session.get_template_anomalies,
    "get_template_samples": Session.get_template_samples,
    "log_sequence": Session.log_sequence,
    "raw_log": Session.raw_log,
    "filters_get": Session.get_filters,
    "filters_add": Session.add_filter,
    "filters_remove": Session.remove_filter,
    "filters_hits": Session.filter_hits,
    "filters_saved": Session.saved_filters,
    "filters_save": Session.save_filters,
    "filters_apply": Session.apply_filters,
    "save_pin": Session.save_pin,
}
#: Tools that change the session, those of them that drop something, and those that give the same again.
CHANGING = {"load_log", "load_logs", "load_start", "load_cancel", "close_log", "refresh", "filters_add", "filters_remove", "filters_save", "filters_apply", "trim", "save_pin"}
DROPPING = {"close_log", "trim"}
REPEATABLE = {"list_logs", "filters_get", "filters_hits", "filters_saved", "summarize_log", "get_timeline_histogram", "get_template", "get_template_samples", "get_template_anomalies", "log_sequence", "raw_log", "find_occurrences", "load_status"}
_KINDS = {str: "string", int: "integer", bool: "boolean"}
#: Arguments that are a time or a line: a whole number or a text.
BOUNDS = ("start", "end", "after", "before")


def _schema(hint: Any) -> dict[str, Any]:
    if typing.get_origin(hint) in (typing.Union, types.UnionType):
        found = [_schema(h) for h in typing.get_args(hint) if h is not type(None)]
        return found[0] if len(found) == 1 else {"anyOf": found}
    if typing.get_origin(hint) is list:
        return {"type": "array", "items": _schema(typing.get_args(hint)[0])}
    return {"type": _KINDS[hint]}


def tool(name: str) -> dict[str, Any]:
    """The description of a tool, with the JSON schema of its arguments."""
    method = TOOLS[name]
    hints = typing.get_type_hints(method)
    properties, required = {}, []
    for p in list(inspect.signature(method).parameters.values())[1:]:
        properties[p.name] = {"anyOf": [{"type": "integer"}, {"type": "string"}]} if p.name in BOUNDS else _schema(hints[p.name])
        if p.default is p.empty:
            required.append(p.name)
    notes = {"readOnlyHint": name not in CHANGING, "destructiveHint": name in DROPPING, "idempotentHint": name in REPEATABLE, "openWorldHint": False}
    return {"name": name, "description": inspect.getdoc(method) or name.replace("_", " "), "inputSchema": {"type": "object", "properties": properties, "required": required}, "annotations": notes}


def _fits(value: Any, schema: dict[str, Any]) -> bool:
    if "anyOf" in schema:
        return any(_fits(value, s) for s in schema["anyOf"])
    if schema["type"] == "array":
        return isinstance(value, list) and all(_fits(v, schema["items"]) for v in value)
    if schema["type"] == "boolean":
        return isinstance(value, bool)
    return isinstance(value, {"string": str, "integer": int}[schema["type"]]) and not isinstance(value, bool)


def checked(name: str, arguments: dict[str, Any]) -> dict[str, Any]:
    """The arguments that are not null; ``ToolError`` for unknown and missing ones and those of a wrong type."""
    schema = tool(name)["inputSchema"]
    given = {k: v for k, v in arguments.items() if v is not None}
    for key, value in given.items():
        if key not in schema["properties"]:
            raise ToolError(f"unknown argument '{key}'")
        if not _fits(value, schema["properties"][key]):
            raise ToolError(f"argument '{key}' has the wrong type")
        if isinstance(value, int) and not isinstance(value, bool) and value < 0 and key not in BOUNDS:
            raise ToolError(f"argument '{key}' must not be negative")
        if key in ("after", "before") and parse_time_param(value) is None:
            raise ToolError(f"argument '{key}': no time in '{value}'")
    if missing := [k for k in schema["required"] if k not in given]:
        raise ToolError(f"missing argument '{missing[0]}'")
    return given


def _initialize(_session: Session, params: dict) -> dict:
    wanted = params.get("protocolVersion")
    return {"protocolVersion": wanted if wanted in PROTOCOLS else PROTOCOLS[-1], "capabilities": {"tools": {}}, "serverInfo": {"name": "lumberline", "version": "1"}}


def _list(_session: Session, _params: dict) -> dict:
    return {"tools": [tool(name) for name in TOOLS]}


def _call(session: Session, params: dict) -> dict:
    """A tool's result. What the tool refuses, and what fails while it runs, is a result too, marked as an error."""
    name, arguments = params.get("name"), params.get("arguments")
    if not isinstance(name, str) or not isinstance(arguments, dict | None):
        raise TypeError("name must be a text, arguments an object")
    try:
        if name not in TOOLS:
            raise ToolError(f"unknown tool: {name}")
        found, failed = TOOLS[name](session, **checked(name, arguments or {})), False
    except ToolError as e:
        found, failed = e.payload(), True
    except Exception as e:  # of Spark or the file system, for instance: the server goes on
        found, failed = {"error": "internal", "message": f"{type(e).__name__}: {e}"[:1000], "retryable": True}, True
    return {"content": [{"type": "text", "text": json.dumps(found, default=str)}], "isError": failed}


METHODS: dict[str, Callable[[Session, dict], dict]] = {"initialize": _initialize, "ping": lambda _session, _params: {}, "tools/list": _list, "tools/call": _call}


def _failure(code: int, message: str, request_id: Any = None) -> dict[str, Any]:
    return {"jsonrpc": "2.0", "id": request_id, "error": {"code": code, "message": message}}


def answer(session: Session, text: str) -> dict[str, Any] | None:
    """The response to one request, an error for what is none; None for a notification and a blank line."""
    if not text.strip():
        return None
    if len(text) > LARGEST_REQUEST:
        return _failure(BAD_REQUEST, "the request is too long")
    try:
        message = json.loads(text)
    except (ValueError, RecursionError):
        return _failure(PARSE_ERROR, "no JSON")
    if not isinstance(message, dict):
        return _failure(BAD_REQUEST, "a request is an object")
    if "id" not in message:
        return None
    own = message["id"] if isinstance(message["id"], str | int | float) else None
    name, params = message.get("method"), message.get("params")
    if not isinstance(name, str):
        return _failure(BAD_REQUEST, "method must be a text", own)
    if name not in METHODS:
        return _failure(NO_METHOD, f"method not found: {name}", own)
    if not isinstance(params, dict | None):
        return _failure(BAD_PARAMS, "params must be an object", own)
    try:
        return {"jsonrpc": "2.0", "id": own, "result": METHODS[name](session, params or {})}
    except TypeError as e:
        return _failure(BAD_PARAMS, str(e), own)
    except Exception as e:
        return _failure(INTERNAL, f"{type(e).__name__}: {e}"[:1000], own)


def serve(session: Session, requests: IO[str], responses: IO[str]) -> None:
    """Answer the requests of a stream, one a line, until it ends (standard input and output, for instance)."""
    for line in requests:
        if (reply := answer(session, line)) is not None:
            responses.write(json.dumps(reply) + "\n")
            responses.flush()


def http_server(session: Session, port: int = 0, host: str = "127.0.0.1", secret: str | None = None) -> HTTPServer:
    """A server to start with ``serve_forever``: requests are POSTed to /, /mcp or /messages, /health answers, and /sse names
    the place to POST to. With a ``secret`` all paths stand below it and others aren't found. Tools run one at a time."""
    prefix, lock = f"/{secret}" if secret else "", threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def place(self) -> str | None:
            path = self.path.split("?")[0]
            return (path[len(prefix) :] or "/") if path == prefix or path.startswith(f"{prefix}/") or not prefix else None

        def reply(self, status: int, body: bytes = b"", kind: str = "application/json") -> None:
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_OPTIONS(self) -> None:
            self.reply(204 if self.place() else 404)

        def do_GET(self) -> None:
            at = self.place()
            if at in ("/", "/health"):
                self.reply(200, b'{"status": "ok", "server": "lumberline"}')
            elif at == "/sse":
                self.reply(200, f"event: endpoint\r\ndata: {prefix}/messages\r\n\r\n".encode(), "text/event-stream")
            else:
                self.reply(404)

        def do_POST(self) -> None:
            if self.place() not in ("/", "/mcp", "/messages"):
                return self.reply(404)
            length = self.headers.get("Content-Length") or ""
            if not length.isascii() or not length.isdigit():
                return self.reply(411)
            if int(length) > LARGEST_REQUEST:
                return self.reply(413)
            text = self.rfile.read(int(length)).decode("utf-8", "replace")
            with lock:
                found = answer(session, text)
            self.reply(202) if found is None else self.reply(200, json.dumps(found).encode())

        def do_PUT(self) -> None:
            self.reply(405)

        do_DELETE = do_PATCH = do_PUT

        def log_message(self, *_args) -> None:
            return

    server = ThreadingHTTPServer((host, port), Handler)
    server.daemon_threads = True
    return server
