"""Identity manifests in their several JSON shapes, and configuration files."""

from __future__ import annotations

import copy
import json
import os
import posixpath
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, fields
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, path: str) -> str:
    rows = spark.read.format("binaryFile").load(path).select("content").collect()
    return bytes(rows[0][0]).decode() if rows else ""


def manifest_records(spark: SparkSession, path: str) -> Iterator[dict[str, Any]]:
    """Records of a manifest: JSON lines, an array, {ids}, {records}, {splits: {file}} with further files, or one object.

    Manifests hold ids, and the driver reads them one by one; corpora don't come this way.
    """
    text = _read(spark, path)
    if path.endswith(".jsonl"):
        for n, line in enumerate(text.splitlines(), 1):
            if line.strip():
                try:
                    yield json.loads(line)
                except ValueError as e:
                    raise ValueError(f"{path}, line {n}: {e}") from e
        return
    data = json.loads(text)
    if isinstance(data, list):
        yield from ({"sample_id": x} if isinstance(x, str) else x for x in data)
    elif isinstance(data.get("ids"), list):
        yield from ({"sample_id": x} for x in data["ids"])
    elif isinstance(data.get("records"), list):
        yield from data["records"]
    elif isinstance(data.get("splits"), dict):
        for split in data["splits"].values():
            name = split["file"] if isinstance(split, dict) else split
            yield from manifest_records(spark, posixpath.join(posixpath.dirname(path), name))
    else:
        yield data


def sample_id(record: dict[str, Any]) -> str:
    """The record's own id, or `dataset::record` of it or its metadata."""
    text = lambda v: str(v).strip() if v is not None and not isinstance(v, bool) else ""
    if own := text(record.get("sample_id")):
        return own
    nested = record.get("metadata") or {}
    first = lambda *names: next((t for d in (record, nested) for n in names if (t := text(d.get(n)))), "")
    dataset, key = first("dataset_id"), first("record_id", "id")
    if dataset and key:
        return f"{dataset}::{key}"
    raise ValueError(f"no identity in {sorted(record)}")


def identities(spark: SparkSession, roles: dict[str, list[str]]) -> DataFrame:
    """(role, sample_id) of the roles' manifests; an id that a role repeats is an error."""
    rows = []
    for role, paths in roles.items():
        ids = [sample_id(r) for p in paths for r in manifest_records(spark, p)]
        if len(ids) != len(set(ids)):
            raise ValueError(f"{role} repeats an id")
        rows += [(role, i) for i in ids]
    return spark.createDataFrame(rows, "role string, sample_id string")


def disjoint_or_error(ids: DataFrame, role: str) -> DataFrame:
    """ids, if no other role shares an id with that role."""
    shared = ids.where(F.col("role") == role).join(ids.where(F.col("role") != role).withColumnRenamed("role", "other"), "sample_id").limit(5).collect()
    if shared:
        raise ValueError(f"{role} shares ids: {[r.asDict() for r in shared]}")
    return ids


def merged(base: dict, over: dict) -> dict:
    """base with over's values; dictionaries are merged, all else is replaced."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def overrides(items: list[str]) -> dict:
    """`a.b=value` items as a nested dictionary; values are YAML."""
    out: dict = {}
    for item in items:
        path, sign, value = item.partition("=")
        if not sign or not all(path.split(".")):
            raise ValueError(f"not an override: {item}")
        at = out
        *above, last = path.split(".")
        for part in above:
            at = at.setdefault(part, {})
            if not isinstance(at, dict):
                raise ValueError(f"{item} goes below a value")
        at[last] = yaml.safe_load(value)
    return out


def load_config(spark: SparkSession, path: str, items: list[str] | None = None) -> dict:
    """A YAML mapping with $NAME replaced from the environment, and overrides on top."""
    data = yaml.safe_load(os.path.expandvars(_read(spark, path))) or {}
    if not isinstance(data, dict):
        raise ValueError(f"{path} is no mapping")
    return merged(data, overrides(items or []))


@dataclass(frozen=True)
class PrepareConfig:
    """Limits and policies of corpus preparation; None is no limit."""

    min_words: int = 1
    max_words: int = 100_000
    min_chars: int = 1
    max_chars: int = 1_000_000
    max_tokens: int | None = None
    max_chat_tokens: int | None = None
    require_detail: bool = False
    seed: int = 42
    train: int = 100
    validation: int = 10
    test: int = 10

    def __post_init__(self) -> None:
        if not 0 < self.min_words <= self.max_words or not 0 < self.min_chars <= self.max_chars:
            raise ValueError("bounds must be positive and in order")
        if min(self.train, self.validation, self.test) < 0 or self.per_domain == 0:
            raise ValueError("splits must not be negative, nor all empty")
        for f in fields(self):
            v = getattr(self, f.name)
            if f.name != "require_detail" and isinstance(v, bool):
                raise ValueError(f"{f.name} is no number")

    @property
    def per_domain(self) -> int:
        return self.train + self.validation + self.test

    @classmethod
    def of(cls, data: dict) -> PrepareConfig:
        if unknown := set(data) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**data)


def write_atomically(path: str, data: str | bytes) -> None:
    """A driver-local file, whole or not at all."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    fd, temporary = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(data.encode() if isinstance(data, str) else data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise
