"""The task engine over HTTP: the same routes and JSON as clients of such services use."""

from __future__ import annotations

import json
import os
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from tidelog.model import Task, TaskError, TaskUpdate
from tidelog.streaming.engine import TaskEngine

DEFAULT_ADDRESS = "0.0.0.0:8689"


def listen_address() -> tuple[str, int]:
    """Host and port of the environment variable ListenAddr, or the default."""
    host, _, port = (os.environ.get("ListenAddr", "").strip() or DEFAULT_ADDRESS).rpartition(":")
    return host, int(port)


def task_of(body: dict) -> Task:
    return Task.from_dict(body | {"mysql": body.get("mysql_config") or body.get("mysql")})


class ControlPlane:
    """Replies are {"error_code", "message", "data"}; a wrong request is 400. Engine calls come one at a time."""

    def __init__(self, engine: TaskEngine):
        self.engine, self.lock = engine, threading.Lock()

    def post_task(self, body: dict, _) -> dict:
        return self.engine.create(task_of(body))

    def stop_task(self, body: dict, _) -> dict:
        """stop_type: stop; recovery_v2 goes on at the latest position; anything else where the task stopped."""
        task_id, kind = body.get("task_id", ""), body.get("stop_type", "")
        {"stop": self.engine.stop, "recovery_v2": self.engine.resume_latest}.get(kind, self.engine.resume)(task_id)
        return {"task_id": task_id}

    def update_task(self, body: dict, _) -> dict:
        lists = {k: tuple(body.get(k) or ()) for k in ("database", "tables", "exclude_table")}
        self.engine.update(TaskUpdate(body.get("task_id", ""), **lists))
        return {"task_id": body["task_id"]}

    def delete_task(self, _, task_id: str) -> dict:
        self.engine.delete(task_id)
        return {"task_id": task_id}

    def restoration_task(self, _, task_id: str) -> dict:
        """Repair: the task starts again where it was."""
        self.engine.resume(task_id)
        return {"task_id": task_id}

    def handle(self, method: str, path: str, body: bytes) -> tuple[int, str, str]:
        """Status, content type and text."""
        parts = [p for p in path.split("?")[0].split("/") if p]
        if method == "GET" and parts == ["metrics"]:
            return 200, "text/plain; version=0.0.4", self.engine.metrics.text() if self.engine.metrics else ""
        if method == "GET" and parts[:1] == ["debug"]:
            return 200, "application/json", json.dumps(self.engine.runtime(), default=str)
        try:
            with self.lock:
                if method == "GET" and parts == ["v1", "task"]:
                    found = self.engine.tasks()
                    data = {"total": len(found), "task": {t["task"]["task_id"]: t for t in found}}
                elif method == "POST" and len(parts) in (2, 3) and parts[0] == "v1" and parts[1] in ("post_task", "stop_task", "update_task", "delete_task", "restoration_task"):
                    named = len(parts) == 3
                    if named != (parts[1] in ("delete_task", "restoration_task")):
                        raise TaskError("a task id belongs in the path of delete and restoration only")
                    data = getattr(self, parts[1])(json.loads(body or b"{}") if not named else {}, parts[-1])
                else:
                    return 404, "application/json", json.dumps({"error_code": 404, "message": "no such route"})
        except (TaskError, NotImplementedError, ValueError, TypeError, AttributeError) as e:
            return 400, "application/json", json.dumps({"error_code": 400, "message": str(e)})
        return 200, "application/json", json.dumps({"error_code": 0, "message": "success", "data": data}, default=str)

    def serve(self, address: tuple[str, int] | None = None) -> ThreadingHTTPServer:
        """Serve in a thread of its own; shutdown() ends it."""
        plane = self

        class Handler(BaseHTTPRequestHandler):
            def _reply(self):
                body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
                status, kind, text = plane.handle(self.command, self.path, body)
                self.send_response(status)
                self.send_header("Content-Type", kind)
                self.end_headers()
                self.wfile.write(text.encode())

            do_GET = do_POST = _reply

            def log_message(self, *args): ...

        server = ThreadingHTTPServer(address or listen_address(), Handler)
        threading.Thread(target=server.serve_forever, daemon=True).start()
        return server
