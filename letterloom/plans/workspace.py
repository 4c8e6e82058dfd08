"""A workspace: folders and a state file that the stages share. All of it is the driver's."""

from __future__ import annotations

import json
import os
import shutil
from datetime import UTC, datetime

FOLDERS = ("inputs", "split", "clean", "spam", "reports", "embeddings", "db", "logs", ".checkpoints", "cache")
STATUSES = ("pending", "running", "done", "failed", "interrupted")
OUTPUTS = {"split": ("split",), "preprocess": ("clean", "spam", "reports"), "vectorize": ("embeddings",), "ingest": ("db",)}


class Workspace:
    def __init__(self, root: str):
        self.root = os.path.abspath(root)

    def path(self, *parts: str) -> str:
        return os.path.join(self.root, *parts)

    def ensure(self, config: dict | None = None) -> Workspace:
        for name in FOLDERS:
            os.makedirs(self.path(name), exist_ok=True)
        if not os.path.exists(self.path("workspace.json")):
            self._write("workspace.json", {"created_at": self._now(), **(config or {})})
        if not os.path.exists(self.path("state.json")):
            self._write("state.json", {"stages": {}})
        return self

    @staticmethod
    def _now() -> str:
        return datetime.now(UTC).isoformat(timespec="seconds")

    def _write(self, name: str, value: dict) -> None:
        part = self.path(name + ".part")
        with open(part, "w", encoding="utf-8") as f:
            json.dump(value, f, indent=2)
        os.replace(part, self.path(name))

    def _read(self, name: str) -> dict:
        with open(self.path(name), encoding="utf-8") as f:
            return json.load(f)

    @property
    def state(self) -> dict:
        return self._read("state.json")

    @property
    def config(self) -> dict:
        return self._read("workspace.json")

    def update(self, stage: str, status: str, **details) -> None:
        if status not in STATUSES:
            raise ValueError(f"unknown status {status!r}")
        state = self.state
        entry = state["stages"].setdefault(stage, {"details": {}})
        entry["status"] = status
        if status == "running":
            entry["started_at"] = self._now()
        if status in ("done", "failed", "interrupted"):
            entry["completed_at"] = self._now()
        entry["details"] = {**entry.get("details", {}), **details}
        self._write("state.json", state)

    def done(self, stage: str) -> bool:
        return self.state["stages"].get(stage, {}).get("status") == "done"

    def refresh(self, stages: list[str]) -> str | None:
        """Moves the stages' outputs to old/<stamp> and forgets that they ran."""
        stamp = self.path("old", datetime.now(UTC).strftime("%Y%m%dT%H%M%S%f"))
        state = self.state
        for stage in stages:
            for name in OUTPUTS.get(stage, ()):
                if os.path.isdir(self.path(name)) and os.listdir(self.path(name)):
                    os.makedirs(stamp, exist_ok=True)
                    shutil.move(self.path(name), os.path.join(stamp, name))
                os.makedirs(self.path(name), exist_ok=True)
            state["stages"].pop(stage, None)
        self._write("state.json", state)
        return stamp if os.path.isdir(stamp) else None

    def link_input(self, source: str) -> str:
        """A link to an input file under inputs/, its name made unique; a copy where links aren't allowed."""
        stem, tail = os.path.splitext(os.path.basename(source))
        n, target = 1, self.path("inputs", stem + tail)
        while os.path.lexists(target) and os.path.realpath(target) != os.path.realpath(source):
            n += 1
            target = self.path("inputs", f"{stem}-{n}{tail}")
        if not os.path.lexists(target):
            try:
                os.symlink(os.path.abspath(source), target)
            except OSError:
                shutil.copyfile(source, target)
        return target
