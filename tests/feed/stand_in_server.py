"""A server for tests: its logs are files of a folder, one event a line, and a position counts lines."""

import json
import os


class Client:
    def __init__(self, options):
        self.folder = options["folder"]

    def _logs(self):
        return sorted(os.listdir(self.folder))

    def _lines(self, name):
        with open(f"{self.folder}/{name}") as f:
            return f.readlines()

    def first(self):
        return {"file": self._logs()[0], "pos": 0}

    def position(self):
        last = self._logs()[-1]
        return {"file": last, "pos": len(self._lines(last))}

    def events(self, start, end):
        for name in self._logs():
            if start["file"] <= name <= end["file"]:
                a = start["pos"] if name == start["file"] else 0
                b = end["pos"] if name == end["file"] else None
                yield from map(json.loads, self._lines(name)[a:b])
