"""A client of a model's service against a server double that fails, stalls and answers out of order."""

import collections
import json
import random
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from reelwright.operators import text


class Double(BaseHTTPRequestHandler):
    calls: collections.Counter = collections.Counter()
    lock, open_now, most_open = threading.Lock(), 0, 0

    def do_POST(self):  # noqa: N802
        said = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["messages"][0]["content"].rpartition("Transcript:\n")[2]
        with Double.lock:
            Double.calls[said] += 1
            n = Double.calls[said]
            Double.open_now += 1
            Double.most_open = max(Double.most_open, Double.open_now)
        try:
            time.sleep(3 if said.startswith("stall") else random.random() * 0.05)
            if said.startswith("broken") or said.startswith("flaky") and n < 3:
                self.send_error(500)
                return
            answer = {"prose": "This is about politics and crime.", "junk": "[not json"}.get(said.split()[0], f'["{said.split()[-1]}", "unknown"]')
            body = b"{" if said.startswith("cut") else json.dumps({"choices": [{"message": {"content": answer}}]}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)
        except OSError:
            pass
        finally:
            with Double.lock:
                Double.open_now -= 1

    def log_message(self, *_):
        pass


@pytest.fixture
def service():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Double)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Double.calls.clear()
    Double.most_open = 0
    yield f"http://127.0.0.1:{server.server_port}/"
    server.shutdown()


def test_topics_of_a_service(spark, service):
    names = ["politics", "crime", "drugs"]
    rows = [(i, f"text {i % 10} {names[i % 3]}") for i in range(60)] + [(100, "stall crime"), (101, "broken crime"), (102, "flaky crime"), (103, "prose"), (104, "junk"), (105, "cut crime"), (106, " "), (107, None), (108, ""), (109, "x" * 5000 + " crime")]
    df = spark.createDataFrame(rows, "id int, text string").repartition(2)
    got = {r["id"]: r["topics"] for r in text.service_topics(df, text.chat_service(service, "double", names), names, parallel=3, timeout=1.0, retries=2, pause=0.01).collect()}
    assert len(got) == len(rows)
    for i, t in rows[:60]:
        assert got[i] == [t.split()[-1]]
    assert got[102] == ["crime"] and got[103] == ["politics", "crime"]
    assert all(got[i] == [] for i in (100, 101, 104, 105, 106, 107, 108, 109))
    assert all(n == 1 for q, n in Double.calls.items() if q.startswith("text")) and len([q for q in Double.calls if q.startswith("text")]) == 30
    assert Double.calls["broken crime"] == 3 and Double.calls["flaky crime"] == 3 and max(len(q) for q in Double.calls) == 2000
    assert Double.most_open <= 3 * 4  # three a task, at most four tasks


def test_calls_are_bounded_ordered_and_given_up():
    state = {"open": 0, "most": 0}
    lock = threading.Lock()

    def call(q, timeout):
        with lock:
            state["open"] += 1
            state["most"] = max(state["most"], state["open"])
        time.sleep(60 if q == "hang" else random.random() * 0.02)  # a client that ignores its time
        with lock:
            state["open"] -= 1
        if q == "bad":
            raise ValueError(q)
        return q.upper()

    questions = [f"q{i}" for i in range(40)]
    start = time.monotonic()
    got = text.asked_together(call, [*questions, "hang", "bad", *questions], parallel=5, timeout=0.2, retries=1, pause=0.01)
    assert got == [*(q.upper() for q in questions), None, None, *(q.upper() for q in questions)]
    assert state["most"] <= 6 and time.monotonic() - start < 10
    assert text.asked_together(call, [], 5, 1, 1, 1) == []
