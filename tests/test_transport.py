import http.client
import io
import json
import threading
import urllib.request

from lumberline import transport
from lumberline.session import Session


def ask(session, method, id=1, **params):
    return transport.answer(session, json.dumps({"jsonrpc": "2.0", "id": id, "method": method, "params": params}))


def call(session, name, **arguments):
    result = ask(session, "tools/call", name=name, arguments=arguments)["result"]
    return result["isError"], json.loads(result["content"][0]["text"])


def test_protocol(spark, tmp_path):
    path = tmp_path / "x.log"
    path.write_text("".join(f"2026-07-19 10:00:{i:02d} {'ERROR boom' if i % 4 == 0 else 'INFO fine'} {i}\n" for i in range(40)))
    session = Session(spark)
    assert ask(session, "initialize")["result"]["serverInfo"]["name"] == "lumberline"
    assert ask(session, "ping")["result"] == {} and ask(session, "nothing")["error"]["code"] == -32601
    assert transport.answer(session, "{")["error"]["code"] == -32700 and transport.answer(session, '{"method": "ping"}') is None
    tools = {t["name"]: t["inputSchema"] for t in ask(session, "tools/list")["result"]["tools"]}
    assert set(tools) == set(transport.TOOLS) and tools["load_log"]["required"] == ["path"]
    assert tools["find_occurrences"]["properties"]["max_results"] == {"type": "integer"}
    assert call(session, "summarize_log")[0] and call(session, "load_log")[1]["message"] == "missing argument 'path'"
    failed, loaded = call(session, "load_log", path=str(path))
    assert not failed and loaded["lines"] == 40
    assert call(session, "find_occurrences", keyword="boom", max_results=2)[1]["total"] == 10
    for wrong in ({"keyword": 5}, {"keyword": "x", "max_results": "2"}, {"keyword": "x", "max_results": -1}, {"keyword": "x", "other": 1}, {"keyword": "x", "after": "soon"}, {"keyword": "x", "refs": 1}):
        assert call(session, "find_occurrences", **wrong)[0], wrong
    assert call(session, "filters_add", keyword="boom")[1] == ["boom"] and call(session, "filters_remove", position=0)[1] == []
    assert call(session, "unknown")[0]


def test_streams_and_http(spark):
    session, out = Session(spark), io.StringIO()
    transport.serve(session, io.StringIO('{"id": 1, "method": "ping"}\n\n{"id": 2, "method": "tools/call", "params": {"name": "list_logs"}}\n'), out)
    first, second = map(json.loads, out.getvalue().splitlines())
    assert first["id"] == 1 and json.loads(second["result"]["content"][0]["text"]) == []
    server = transport.http_server(session)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        request = urllib.request.Request(f"http://127.0.0.1:{server.server_port}/mcp", b'{"id": 7, "method": "ping"}', {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=20) as r:
            assert json.load(r)["id"] == 7
    finally:
        server.shutdown()
        server.server_close()


def test_nothing_that_is_sent_ends_the_server(spark, monkeypatch):
    session = Session(spark)
    bad = {
        "x": -32700, "[1": -32700, "[]": -32600, "5": -32600, '"ping"': -32600, "[" * 100_000: -32700,
        '{"id":1,"method":[]}': -32600, '{"id":1}': -32600, '{"id":1,"method":{"a":1}}': -32600,
        '{"id":1,"method":"ping","params":[]}': -32602, '{"id":1,"method":"initialize","params":7}': -32602,
        '{"id":1,"method":"tools/call","params":{"name":[]}}': -32602, '{"id":1,"method":"tools/call","params":{"name":"list_logs","arguments":[1]}}': -32602,
        '{"id":1,"method":"tools/call"}': -32602,
    }
    for text, code in bad.items():
        assert transport.answer(session, text)["error"]["code"] == code, text[:60]
    out = io.StringIO()
    transport.serve(session, io.StringIO("".join(f"{x}\n" for x in bad) + '{"id": "last", "method": "ping"}\n'), out)
    replies = list(map(json.loads, out.getvalue().splitlines()))
    assert len(replies) == len(bad) + 1 and replies[-1] == {"jsonrpc": "2.0", "id": "last", "result": {}}
    assert transport.answer(session, '{"id":{"a":1},"method":"ping"}')["id"] is None
    monkeypatch.setattr(transport, "LARGEST_REQUEST", 30)
    assert transport.answer(session, '{"id":1,"method":"ping","params":{}}')["error"]["code"] == -32600
    monkeypatch.undo()
    monkeypatch.setitem(transport.TOOLS, "list_logs", lambda _session: 1 / 0)
    monkeypatch.setattr(transport, "checked", lambda _name, arguments: arguments)
    assert call(session, "list_logs")[0]


def test_versions_and_annotations(spark):
    session = Session(spark)
    for wanted, got in (("2024-11-05", "2024-11-05"), ("2025-03-26", "2025-03-26"), ("1999-01-01", "2025-06-18"), (None, "2025-06-18"), ([], "2025-06-18")):
        assert ask(session, "initialize", protocolVersion=wanted)["result"]["protocolVersion"] == got
    notes = {t["name"]: t["annotations"] for t in ask(session, "tools/list")["result"]["tools"]}
    assert notes["raw_log"] == {"readOnlyHint": True, "destructiveHint": False, "idempotentHint": True, "openWorldHint": False}
    assert notes["close_log"]["destructiveHint"] and not notes["trim"]["readOnlyHint"] and not notes["load_log"]["idempotentHint"]


def test_http_routes_and_limits(spark, monkeypatch):
    monkeypatch.setattr(transport, "LARGEST_REQUEST", 200)
    server = transport.http_server(Session(spark), secret="s3")
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def send(method, path, body=None, **headers):
        connection = http.client.HTTPConnection("127.0.0.1", server.server_port, timeout=20)
        connection.putrequest(method, path)
        if body is not None and "Content_Length" not in headers:
            headers["Content_Length"] = str(len(body))
        for k, v in headers.items():
            connection.putheader(k.replace("_", "-"), v)
        connection.endheaders(body)
        reply = connection.getresponse()
        found = reply.status, reply.read()
        connection.close()
        return found

    try:
        assert send("GET", "/health")[0] == 404 and send("GET", "/s3/health?x=1")[0] == 200 and send("GET", "/s3")[0] == 200
        assert send("GET", "/s3/sse")[1] == b"event: endpoint\r\ndata: /s3/messages\r\n\r\n" and send("GET", "/s3x/health")[0] == 404
        assert send("OPTIONS", "/s3/mcp")[0] == 204 and send("DELETE", "/s3/mcp")[0] == 405 and send("POST", "/s3/other", b"{}")[0] == 404
        ping = b'{"id": 7, "method": "ping"}'
        assert json.loads(send("POST", "/s3/messages", ping)[1])["id"] == 7 and send("POST", "/messages", ping)[0] == 404
        assert send("POST", "/s3/mcp", b'{"method": "ping"}')[0] == 202
        assert send("POST", "/s3/mcp", None, Content_Length="many")[0] == 411 and send("POST", "/s3/mcp", None, Content_Length="-1")[0] == 411
        assert send("POST", "/s3/mcp", None, Content_Length="201")[0] == 413
        assert json.loads(send("POST", "/s3/mcp", b"\xff\xfe{")[1])["error"]["code"] == -32700
    finally:
        server.shutdown()
        server.server_close()
