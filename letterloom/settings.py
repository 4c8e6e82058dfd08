"""Settings with their defaults; LETTERLOOM_<NAME> of a .env file goes before these, of the environment before both."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass
class Settings:
    db_path: str = "letterloom-db"
    embedding: str = "hashing"
    embedding_dimension: int = 768
    chunk_size: int = 1200
    chunk_overlap: int = 200
    top_k: int = 20
    rrf_k: int = 60
    #: An ingest of so many mails or more rewrites the mail tables into few files.
    compact_every: int = 20000

    @staticmethod
    def load(env_file: str = ".env") -> Settings:
        out, given = Settings(), {}
        if os.path.isfile(env_file):
            with open(env_file, encoding="utf-8") as f:
                pairs = (line.strip().removeprefix("export ").partition("=") for line in f if "=" in line and not line.lstrip().startswith("#"))
                given = {key.strip(): value.strip().strip("\"'") for key, _, value in pairs}
        given |= os.environ
        for f in fields(out):
            if (value := given.get(f"LETTERLOOM_{f.name.upper()}")) is not None:
                setattr(out, f.name, type(getattr(out, f.name))(value))
        return out
