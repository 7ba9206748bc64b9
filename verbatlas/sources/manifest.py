"""Provenance: a record beside each output, from which a run can be checked and repeated."""

from __future__ import annotations

import hashlib
import json
import platform
import shlex
import warnings
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
from importlib.metadata import PackageNotFoundError, version
from pathlib import Path
from typing import Any

import verbatlas


def file_md5(path: str) -> str:
    """Of a file, or of a folder's part files in order of name; read in blocks of 8 KiB."""
    h = hashlib.md5()  # noqa: S324  a checksum, no protection
    p = Path(path)
    for part in sorted(x for x in p.iterdir() if x.name.startswith("part-")) if p.is_dir() else [p]:
        with part.open("rb") as f:
            while block := f.read(8192):
                h.update(block)
    return h.hexdigest()


def versions() -> dict[str, str]:
    out = {"python": platform.python_version(), "verbatlas": verbatlas.__version__}
    for name in ("pyspark", "pyarrow", "pandas", "numpy"):
        try:
            out[name] = version(name)
        except PackageNotFoundError:
            out[name] = "absent"
    return out


@dataclass
class Manifest:
    """What a step read, did and wrote. status: incomplete, complete or stopped."""

    tool: str
    inputs: list[dict[str, str]]
    output: dict[str, str]
    settings: dict[str, Any] = field(default_factory=dict)
    statistics: dict[str, Any] = field(default_factory=dict)
    groups: dict[str, list[str]] | None = None
    #: How many rows were left out, by reason.
    left_out: dict[str, int] | None = None
    status: str = "incomplete"
    timestamp: str = ""
    versions: dict[str, str] = field(default_factory=versions)
    command: str = ""
    source: dict[str, Any] | None = None

    @classmethod
    def begin(cls, tool: str, inputs: list[str], output: str, settings: dict[str, Any], defaults: dict[str, Any] | None = None, upstream: dict[str, Any] | None = None) -> Manifest:
        """A record with status incomplete; written before the work begins, it shows that a run broke off."""
        found = [{"path": p, "md5": file_md5(p) if Path(p).exists() else ""} for p in inputs]
        return cls(tool, found, {"path": output, "md5": ""}, settings, command=command_line(tool, inputs, output, settings, defaults or {}), source=upstream)

    def write(self) -> str:
        self.timestamp = datetime.now(timezone.utc).isoformat()
        target = sidecar(self.output["path"])
        Path(target).write_text(json.dumps(asdict(self), indent=2, ensure_ascii=False, default=str), encoding="utf-8")
        return target

    def finish(self, statistics: dict[str, Any], status: str = "complete") -> str:
        self.statistics, self.status = statistics, status
        if Path(self.output["path"]).exists():
            self.output["md5"] = file_md5(self.output["path"])
        return self.write()


def sidecar(output: str) -> str:
    return f"{output.rstrip('/')}.json"


def load(path: str) -> dict[str, Any]:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def parent_of(input_path: str) -> dict[str, Any] | None:
    """The record beside an input, to be kept in the record of what is made from it."""
    p = Path(sidecar(input_path))
    return load(str(p)) if p.exists() else None


def changed_inputs(record: dict[str, Any], paths: list[str] | None = None, strict: bool = False) -> list[str]:
    """Inputs whose checksum is not the recorded one (or that are missing); strict: an error if there are any."""
    bad = []
    for x in record["inputs"]:
        if paths is not None and x["path"] not in paths:
            continue
        if not Path(x["path"]).exists() or file_md5(x["path"]) != x["md5"]:
            bad.append(x["path"])
            warnings.warn(f"{x['path']} is not what the record was made from", stacklevel=2)
    if bad and strict:
        raise ValueError(f"changed inputs: {', '.join(bad)}")
    return bad


def check_upstream(input_path: str, record: dict[str, Any], strict: bool = False) -> bool:
    """Whether an input is what the step before wrote: its checksum is that record's output checksum."""
    same = file_md5(input_path) == record["output"]["md5"]
    if not same:
        if strict:
            raise ValueError(f"{input_path} was changed after it was written")
        warnings.warn(f"{input_path} was changed after it was written", stacklevel=2)
    return same


def version_changes(record: dict[str, Any]) -> dict[str, tuple[str, str]]:
    """Versions that differ between the record and now, with a warning for each."""
    now = versions()
    out = {k: (v, now.get(k, "absent")) for k, v in record.get("versions", {}).items() if now.get(k, "absent") != v}
    for k, (old, new) in out.items():
        warnings.warn(f"{k}: recorded {old}, now {new}", stacklevel=2)
    return out


def resolved(given: dict[str, Any], record: dict[str, Any] | None, defaults: dict[str, Any]) -> dict[str, Any]:
    """Settings: given ones (not None) before recorded ones before defaults. A given 0 counts as given."""
    old = (record or {}).get("settings", {})
    return {k: given[k] if given.get(k) is not None else old.get(k, d) if old.get(k) is not None else d for k, d in defaults.items()}


def inputs_of(given: list[str], record: dict[str, Any] | None, tool: str | None = None) -> list[str]:
    """Inputs given; else those of the record, so that a run can be repeated from its record alone.

    A record of another tool than the one named is that of a step before: its output is the input.
    """
    if given or not record:
        return given
    if tool and record.get("tool") != tool:
        path = record.get("output", {}).get("path")
        return [path] if path else []
    return [x["path"] for x in record.get("inputs", [])]


def command_line(tool: str, inputs: list[str], output: str, settings: dict[str, Any], defaults: dict[str, Any]) -> str:
    """The command that repeats a run: only settings that differ from their defaults."""
    parts = ["python", "-m", "verbatlas.cli", tool, *inputs, "--output", output]
    for k, v in settings.items():
        if v is None or v == defaults.get(k):
            continue
        name = "--" + k.replace("_", "-")
        parts += [name] if v is True else [] if v is False else [x for y in v for x in (name, str(y))] if isinstance(v, (list, tuple)) else [name, str(v)]
    return shlex.join(parts)
