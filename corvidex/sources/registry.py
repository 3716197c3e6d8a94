"""The registry of datasets: named lists of databases, kept in one JSON file by the driver."""

from __future__ import annotations

import fcntl
import json
import os
import re
from contextlib import contextmanager
from datetime import UTC, datetime

from corvidex.sources.sinks import write_atomic

_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,63}")


class RegistryError(ValueError):
    pass


def safe_name(name: str) -> str:
    """A dataset or database name that cannot leave its folder."""
    if not _NAME.fullmatch(name or "") or ".." in name:
        raise RegistryError(f"not a valid name: {name!r}")
    return name


def database_name(name: str) -> str:
    n = safe_name(name)
    return n if n.endswith(".db") else f"{n}.db"


def safe_path(base: str, relative: str) -> str:
    """A path below ``base``; anything that would lead out of it is refused."""
    root = os.path.realpath(base)
    full = os.path.realpath(os.path.join(root, relative))
    if full != root and not full.startswith(root + os.sep):
        raise RegistryError(f"path leaves {base!r}: {relative!r}")
    return full


@contextmanager
def locked(path: str):
    """One writer at a time, across processes."""
    with open(f"{path}.lock", "w") as f:
        fcntl.flock(f, fcntl.LOCK_EX)
        try:
            yield
        finally:
            fcntl.flock(f, fcntl.LOCK_UN)


class Registry:
    """Datasets of a folder. A missing or damaged file starts from ``databases`` found."""

    def __init__(self, path: str, databases: list[str] | None = None):
        self.path, self.found = path, sorted(databases or [])

    def load(self) -> dict:
        try:
            with open(self.path, encoding="utf-8") as f:
                data = json.load(f)
        except (OSError, ValueError):
            data = {}
        sets = data.get("datasets") or data.get("sets") or {}
        known = {n: {"description": "", "databases": [], **(v if isinstance(v, dict) else {"databases": v})} for n, v in sets.items()}
        if not known:
            known = {"default": {"description": "all databases", "databases": self.found}}
        active = data.get("active_dataset") or data.get("active_set")
        return {"active_dataset": active if active in known else sorted(known)[0], "datasets": known}

    def _change(self, fn):
        with locked(self.path):
            data = self.load()
            out = fn(data)
            write_atomic(self.path, json.dumps(data, indent=1, sort_keys=True))
            return out

    def heal(self) -> list[str]:
        """Drops databases that are not there any more; returns their names."""

        def fix(d):
            gone = sorted({b for v in d["datasets"].values() for b in v["databases"] if b not in self.found})
            for v in d["datasets"].values():
                v["databases"] = [b for b in v["databases"] if b in self.found]
            return gone

        return self._change(fix)

    def create(self, name: str, databases: list[str], description: str = "") -> None:
        def fix(d):
            if safe_name(name) in d["datasets"]:
                raise RegistryError(f"dataset exists: {name}")
            d["datasets"][name] = {"description": description, "created_at": datetime.now(UTC).isoformat(), "databases": list(dict.fromkeys(map(database_name, databases)))}

        self._change(fix)

    def _one(self, d: dict, name: str) -> dict:
        if name not in d["datasets"]:
            raise RegistryError(f"no such dataset: {name}")
        return d["datasets"][name]

    def delete(self, name: str) -> None:
        def fix(d):
            self._one(d, name)
            if len(d["datasets"]) == 1:
                raise RegistryError("the last dataset cannot be deleted")
            del d["datasets"][name]
            if d["active_dataset"] == name:
                d["active_dataset"] = sorted(d["datasets"])[0]

        self._change(fix)

    def rename(self, old: str, new: str) -> None:
        def fix(d):
            self._one(d, old)
            if safe_name(new) in d["datasets"]:
                raise RegistryError(f"dataset exists: {new}")
            d["datasets"][new] = d["datasets"].pop(old)
            if d["active_dataset"] == old:
                d["active_dataset"] = new

        self._change(fix)

    def add_database(self, name: str, db: str) -> None:
        def fix(d):
            own = self._one(d, name)["databases"]
            if database_name(db) not in own:
                own.append(database_name(db))

        self._change(fix)

    def remove_database(self, name: str, db: str) -> None:
        self._change(lambda d: self._one(d, name).update(databases=[b for b in d["datasets"][name]["databases"] if b != database_name(db)]))

    def use(self, name: str) -> None:
        def fix(d):
            self._one(d, name)
            d["active_dataset"] = name

        self._change(fix)

    def databases(self, name: str | None = None) -> list[str]:
        d = self.load()
        return list(self._one(d, name or d["active_dataset"])["databases"])
