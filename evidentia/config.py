"""Settings, each of which an environment variable can replace."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """What a run is given.  The variable ``EVIDENTIA_`` with a field's name in upper case replaces its value."""

    folder: str = "data"
    search_term: str = ""
    page: int = 500
    batch: int = 50
    rate: float = 10.0
    tries: int = 3
    wait: float = 2.0
    model: str = "model"
    validation_model: str = "model"
    at_once: int = 5
    sample_share: float = 0.05
    batch_limit: int = 0
    text_tokens: int = 10_000
    table_rows: int = 50
    page_size: int = 20
    most_per_page: int = 200
    export_cap: int = 50_000
    keep_status: bool = True

    @classmethod
    def from_environment(cls, environ: Mapping[str, str] = os.environ) -> Settings:
        """Numbers and truth values (1, true, yes) are read as such; one that can't be read is an error that names it."""
        found = {}
        for f in fields(cls):
            text = environ.get(f"EVIDENTIA_{f.name.upper()}")
            if text is None:
                continue
            kind = type(f.default)
            try:
                found[f.name] = text.strip().lower() in ("1", "true", "yes") if kind is bool else kind(text)
            except ValueError as e:
                raise ValueError(f"EVIDENTIA_{f.name.upper()} must be {kind.__name__}, not {text!r}") from e
        return cls(**found)
