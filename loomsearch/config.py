"""Settings of a service: defaults, overridden by a JSON file, by LOOMSEARCH_* variables, and by the command line."""

from __future__ import annotations

import argparse
import json
import os
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class Config:
    host: str = "127.0.0.1"
    port: int = 9876
    path: str = "loomsearch-data"
    restore_from: str = ""
    snapshot_path: str = "snapshot"

    @classmethod
    def load(cls, file: str | None = None, env: Mapping[str, str] | None = None, given_last: Mapping[str, str] | None = None) -> Config:
        """ValueError for a setting of another name or type."""
        env = os.environ if env is None else env
        kinds = {f.name: type(f.default) for f in fields(cls)}
        given = dict(json.loads(Path(file).read_text())) if file else {}
        given |= {name: env[f"LOOMSEARCH_{name.upper()}"] for name in kinds if f"LOOMSEARCH_{name.upper()}" in env}
        given |= given_last or {}
        if unknown := given.keys() - kinds.keys():
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**{name: kinds[name](value) for name, value in given.items()})

    @classmethod
    def from_arguments(cls, argv: Sequence[str], env: Mapping[str, str] | None = None) -> Config:
        """From arguments such as --config FILE --port 9000."""
        parser = argparse.ArgumentParser("loomsearch")
        parser.add_argument("--config")
        for f in fields(cls):
            parser.add_argument(f"--{f.name.replace('_', '-')}", dest=f.name)
        named = vars(parser.parse_args(list(argv)))
        file = named.pop("config")
        return cls.load(file, env, {k: v for k, v in named.items() if v is not None})
