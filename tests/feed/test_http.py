import json
import urllib.error
import urllib.request

from tests.feed.test_feed import row_event
from tests.feed.test_streaming import engine, events_of, write_log
from tidelog.model import FileConf
from tidelog.streaming.engine import Metrics
from tidelog.streaming.http import ControlPlane, listen_address


def test_address(monkeypatch):
    monkeypatch.delenv("ListenAddr", raising=False)
    assert listen_address() == ("0.0.0.0", 8689)
    monkeypatch.setenv("ListenAddr", " 127.0.0.1:9000 ")
    assert listen_address() == ("127.0.0.1", 9000)


def test_routes(spark, tmp_path):
    log, out = tmp_path / "log", f"file://{tmp_path}/out"
    log.mkdir()
    write_log(log, "1.json", [row_event(1, [["1", "x"]])])
    e = engine(spark, tmp_path, log, metrics=Metrics())
    server = ControlPlane(e).serve(("127.0.0.1", 0))

    def call(method, path, body=None):
        request = urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", json.dumps(body).encode() if body is not None else None, method=method)
        try:
            with urllib.request.urlopen(request, timeout=100) as r:
                text = r.read().decode()
                return r.status, json.loads(text) if path.startswith("/v1") else text
        except urllib.error.HTTPError as x:
            return x.code, json.loads(x.read())

    try:
        task = {"task_id": "t1", "mysql_config": {"user": "u", "password": "p", "host": "h", "port": 3306}, "database": ["shop"], "file_conf": {"path": out}}
        status, reply = call("POST", "/v1/post_task", task)
        assert status == 200 and reply["data"]["task_id"] == "t1"
        e.queries["t1"].processAllAvailable()
        assert [r[0] for r in events_of(spark, FileConf(out))] == [1]
        assert call("POST", "/v1/post_task", task)[0] == 400
        assert call("POST", "/v1/post_task", {"task_id": ""})[0] == 400
        assert call("POST", "/v1/post_task", {"task_id": "n", "nsq_conf": {}})[0] == 400
        assert call("POST", "/v1/post_task", [])[0] == 400
        listed = call("GET", "/v1/task")[1]["data"]
        assert listed["total"] == 1 and listed["task"]["t1"]["active"] and listed["task"]["t1"]["task"]["mysql"]["password"] == "***"
        status, text = call("GET", "/debug/runtime")
        assert status == 200 and json.loads(text)["heap_used"] > 0 and "t1" in json.loads(text)["queries"]
        assert call("POST", "/v1/update_task", {"task_id": "t1", "exclude_table": ["shop.*"]})[0] == 200
        assert call("POST", "/v1/stop_task", {"task_id": "t1", "stop_type": "stop"})[0] == 200
        assert call("GET", "/v1/task")[1]["data"]["task"]["t1"]["stopped"]
        assert call("POST", "/v1/stop_task", {"task_id": "t1", "stop_type": "recovery_v1"})[0] == 200
        assert call("POST", "/v1/restoration_task/t1", {})[0] == 200
        assert 'tidelog_batches{task="t1"}' in call("GET", "/metrics")[1]
        assert call("POST", "/v1/delete_task/t1", {})[0] == 200
        assert call("POST", "/v1/delete_task/t1", {})[0] == 400
        assert call("GET", "/v1/nothing")[0] == 404
    finally:
        server.shutdown()
        for q in spark.streams.active:
            q.stop()
