"""Numbered batch folders of JSON lines, snapshots, and the checkpoint file."""

from __future__ import annotations

import json
import os
import re
import tempfile
from dataclasses import dataclass, field
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.schemas import ENVELOPE, TABLES, payload_schema

_NAME = re.compile(r"batch_id=(\d+)")


class BatchDiscoveryError(ValueError):
    pass


class CheckpointRegressionError(ValueError):
    pass


@dataclass(frozen=True)
class Batch:
    batch_id: int
    path: Path
    manifest: dict | None = field(default=None, compare=False)


def discover(root: str | Path) -> list[Batch]:
    """Batch folders in numeric order; plain files are ignored, any other folder is an error."""
    root = Path(root)
    out = []
    for p in sorted(root.iterdir()) if root.is_dir() else ():
        if not p.is_dir():
            continue
        m = _NAME.fullmatch(p.name)
        if not m:
            raise BatchDiscoveryError(f"unexpected folder {p}")
        manifest = None
        if (p / "manifest.json").exists():
            try:
                manifest = json.loads((p / "manifest.json").read_text())
            except ValueError as e:
                raise BatchDiscoveryError(f"corrupt manifest in {p}") from e
        out.append(Batch(int(m[1]), p, manifest))
    return sorted(out, key=lambda b: b.batch_id)


def read_events(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Events of JSON-lines files, or of folders of them or of Spark's part files; the batch id inside an event wins over its
    folder's name, and manifests are no events."""
    if not paths:
        return spark.createDataFrame([], ENVELOPE)
    return (
        spark.read.schema(ENVELOPE)
        .option("pathGlobFilter", "{*.jsonl,part-*}")
        .option("recursiveFileLookup", "true")
        .json(paths)
    )


def read_snapshot(spark: SparkSession, root: str | Path, table: str) -> DataFrame:
    """Typed snapshot rows, from snapshot/<table>.jsonl or <table>.jsonl."""
    schema = T.StructType(
        [
            *payload_schema(table).fields,
            T.StructField("source_sequence", T.LongType()),
            T.StructField("created_at", T.StringType())
        ]
    )
    for p in (Path(root) / "snapshot" / f"{table}.jsonl", Path(root) / f"{table}.jsonl"):
        if p.exists():
            return spark.read.schema(schema).json(str(p))
    raise FileNotFoundError(f"no snapshot of {table} in {root}")


class Checkpoint:
    """High-water marks of all tables and the batches that are complete, in one file that is
    replaced whole."""

    def __init__(self, folder: str | Path, name: str = "checkpoint_state.json"):
        self.path = Path(folder) / name

    def load(self) -> dict:
        empty = {
            "version": 1,
            "tables": {
                t: {"highest_source_sequence": 0, "last_processed_batch_id": 0, "last_updated_at": None}
                for t in TABLES
            },
            "completed_batch_ids": [],
            "last_updated_at": None
        }
        if self.path.exists():
            return json.loads(self.path.read_text())
        return self._migrated(empty)

    def _migrated(self, state: dict) -> dict:
        """From one file a table: marks are kept; a batch is complete if all four files say so."""
        done: list[set[int]] = []
        for t in TABLES:
            try:
                old = json.loads((self.path.parent / f"{t}.json").read_text())
            except (OSError, ValueError):
                done.append(set())
                continue
            state["tables"][t] |= {
                k: old[k]
                for k in ("highest_source_sequence", "last_processed_batch_id", "last_updated_at")
                if k in old
            }
            done.append(set(old.get("processed_batch_ids", ())))
        state["completed_batch_ids"] = sorted(set.intersection(*done))
        return state

    def mark(self, table: str) -> int:
        return self.load()["tables"].get(table, {}).get("highest_source_sequence", 0)

    def is_complete(self, batch_id: int) -> bool:
        return batch_id in self.load()["completed_batch_ids"]

    def completed(self) -> list[int]:
        return list(self.load()["completed_batch_ids"])

    def load_table(self, table: str) -> dict:
        """One table's mark, with the batches that are complete."""
        state = self.load()
        own = state["tables"].get(
            table, {"highest_source_sequence": 0, "last_processed_batch_id": 0, "last_updated_at": None}
        )
        return {"table_name": table, **own, "processed_batch_ids": state["completed_batch_ids"]}

    def save_table(self, table: str, state: dict) -> None:
        """Commit one table's mark and write it to the table's own file as well, which older readers expect."""
        self.commit(state["last_processed_batch_id"], {table: state["highest_source_sequence"]})
        self._replace(self.path.parent / f"{table}.json", state)

    def advance(self, table: str, sequence: int, batch_id: int) -> dict:
        """Raise one table's mark; an error if it would fall."""
        self.commit(batch_id, {table: sequence})
        return self.load_table(table)

    def commit(self, batch_id: int, marks: dict[str, int]) -> None:
        state, now = self.load(), datetime.now(timezone.utc).isoformat()
        for t, seq in marks.items():
            if seq < state["tables"].get(t, {}).get("highest_source_sequence", 0):
                raise CheckpointRegressionError(f"{t}: {seq} is below {state['tables'][t]['highest_source_sequence']}")
        for t, seq in marks.items():
            state["tables"][t] = {
                "highest_source_sequence": seq, "last_processed_batch_id": batch_id, "last_updated_at": now
            }
        state["completed_batch_ids"] = sorted({*state["completed_batch_ids"], batch_id})
        state["last_updated_at"] = now
        self._replace(self.path, state)

    @staticmethod
    def _replace(path: Path, content: dict) -> None:
        """Write a file whole or not at all."""
        path.parent.mkdir(parents=True, exist_ok=True)
        fd, tmp = tempfile.mkstemp(dir=path.parent, prefix=".checkpoint-")
        try:
            with os.fdopen(fd, "w") as f:
                json.dump(content, f, indent=2, sort_keys=True)
                f.flush()
                os.fsync(f.fileno())
            os.replace(tmp, path)
        except BaseException:
            Path(tmp).unlink(missing_ok=True)
            raise
