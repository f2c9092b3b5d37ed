"""Settings and errors that the library's parts share."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

MB = 1 << 20


@dataclass(frozen=True)
class Options:
    """Limits and thresholds; ``from_environment`` reads PAPERLOOM_<NAME>."""

    range_threshold: int = 32 * MB
    block: int = 256 << 10
    most_blocks: int = 32
    most_bytes: int = 200 * MB
    most_media: int = 5 * MB
    most_sheet_rows: int = 5_000
    most_cached: int = 500
    longest_side: int = 2000
    retries: int = 3
    calls_in_flight: int = 3
    most_files: int = 20
    first_wait: float = 1.0
    fail_fast: bool = False

    @classmethod
    def from_environment(cls, env: dict[str, str] | None = None) -> Options:
        env = dict(os.environ if env is None else env)
        kinds = {"int": int, "float": float, "bool": lambda x: x.lower() in ("1", "true", "yes")}
        told = {f.name: env.get(f"PAPERLOOM_{f.name.upper()}", "") for f in fields(cls)}
        return cls(**{f.name: kinds[f.type](told[f.name]) for f in fields(cls) if told[f.name]})


class PaperloomError(Exception):
    """An error with a code, as the ``error`` columns of results have it."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code
