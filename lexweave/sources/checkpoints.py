"""Checkpoints of a training run as files checkpoint_step<number>.pt, on any file system that Spark knows."""

from __future__ import annotations

import base64
import json
import re
import uuid

from pyspark.sql import SparkSession

_NAME = re.compile(r"checkpoint_step(\d+)\.pt$")
REQUIRED = ("step", "epoch", "model_state", "optimizer_state")


class Folder:
    """Saves, lists, loads and prunes the checkpoints of one folder. A state is a mapping of JSON values and bytes."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf, self.path = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path.rstrip("/")
        self.gateway = spark.sparkContext._gateway
        self.fs = self._at("").getFileSystem(self.conf)

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def list(self) -> list[tuple[int, str]]:
        """(step, path), ascending; files of other names are left alone."""
        if not self.fs.exists(self._at("")):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self._at(""))]
        return sorted((int(m[1]), f"{self.path}/{n}") for n in names if (m := _NAME.fullmatch(n)))

    def latest(self) -> str | None:
        found = self.list()
        return found[-1][1] if found else None

    def save(self, step: int, epoch: int, model_state: dict, optimizer_state: dict, scheduler_state: dict | None = None, extra_state: dict | None = None, keep_last: int = 3) -> str:
        """Writes a draft and renames it, so that a checkpoint is whole or absent; then prunes. A step saved before is replaced."""
        if step < 0:
            raise ValueError("the step must not be negative")
        state = {"step": step, "epoch": epoch, "model_state": model_state, "optimizer_state": optimizer_state, "scheduler_state": scheduler_state, "extra_state": extra_state or {}}
        body = json.dumps(state, default=lambda x: {"__bytes__": base64.b64encode(x).decode()})
        draft, final = self._at(f".draft-{uuid.uuid4().hex}"), self._at(f"checkpoint_step{step}.pt")
        try:
            out = self.fs.create(draft, False)
            out.write(bytearray(body.encode()))
            out.close()
            rename = self.jvm.org.apache.hadoop.fs.Options.Rename
            options = self.gateway.new_array(rename, 1)
            options[0] = rename.OVERWRITE
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(draft, final, options)
        except Exception as e:
            self.fs.delete(draft, False)
            raise RuntimeError(f"failed to save {final}") from e
        if keep_last > 0:
            self.prune(keep_last)
        return f"{self.path}/checkpoint_step{step}.pt"

    def prune(self, keep: int) -> list[str]:
        """Deletes all but the newest `keep`; returns what went."""
        if keep <= 0:
            raise ValueError("keep must be positive")
        return [path for _, path in self.list()[:-keep] if self.fs.delete(self.jvm.org.apache.hadoop.fs.Path(path), False)]

    def load(self, path: str | None = None) -> dict:
        """The state of a path, or of the newest; FileNotFoundError, RuntimeError if it can't be read, ValueError if parts are missing."""
        path = path or self.latest()
        if path is None or not self.fs.exists(self.jvm.org.apache.hadoop.fs.Path(path)):
            raise FileNotFoundError(path or self.path)
        stream = self.fs.open(self.jvm.org.apache.hadoop.fs.Path(path))
        try:
            state = json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"), object_hook=lambda x: base64.b64decode(x["__bytes__"]) if set(x) == {"__bytes__"} else x)
        except ValueError as e:
            raise RuntimeError(f"{path} can't be read") from e
        finally:
            stream.close()
        if missing := [k for k in REQUIRED if k not in state]:
            raise ValueError(f"{path} lacks {missing}")
        return state
