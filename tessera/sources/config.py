"""Settings of a collection, from a JSON object."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields


class ConfigError(ValueError):
    pass


@dataclass
class EmbedderConfig:
    dim: int = 0
    provider: str = "hash"
    model: str = ""
    base_url: str = "http://localhost:11434"
    normalize: bool = True


@dataclass
class IndexConfig:
    ef_construction: int = 200
    ef_search: int = 100
    max_ef: int = 512
    seed: int = 42
    distance: str = "cosine"


@dataclass
class StorageConfig:
    data_dir: str = ""
    max_vectors: int = 0


@dataclass
class ServerConfig:
    max_text_bytes: int = 65_535
    snapshot_every: int = 0


@dataclass
class Config:
    embedder: EmbedderConfig = field(default_factory=EmbedderConfig)
    index: IndexConfig = field(default_factory=IndexConfig)
    storage: StorageConfig = field(default_factory=StorageConfig)
    server: ServerConfig = field(default_factory=ServerConfig)

    @classmethod
    def parse(cls, text: str) -> "Config":
        """Unknown fields are ignored, missing ones have their defaults."""
        try:
            raw = json.loads(text)
        except ValueError as e:
            raise ConfigError(f"not JSON: {e}") from e
        if not isinstance(raw, dict):
            raise ConfigError("not a JSON object")
        out = cls()
        for part in fields(cls):
            own = getattr(out, part.name)
            given = raw.get(part.name) or {}
            if not isinstance(given, dict):
                raise ConfigError(f"{part.name} is not an object")
            for f in fields(own):
                if f.name in given:
                    value, kind = given[f.name], type(getattr(own, f.name))
                    if not isinstance(value, kind) or isinstance(value, bool) and kind is int:
                        raise ConfigError(f"{part.name}.{f.name} must be {kind.__name__}")
                    setattr(own, f.name, value)
        out.validate()
        return out

    @classmethod
    def load(cls, path: str) -> "Config":
        with open(path, encoding="utf-8") as file:
            return cls.parse(file.read())

    def validate(self) -> None:
        rules = [
            (self.embedder.dim > 0, "embedder.dim must be over 0"),
            (self.embedder.dim <= 65_535, "embedder.dim must be 65535 at most"),
            (self.storage.data_dir != "", "storage.data_dir must be given"),
            (self.storage.max_vectors > 0, "storage.max_vectors must be over 0"),
            (self.index.ef_search > 0 and self.index.ef_construction > 0, "index.ef_search and index.ef_construction must be over 0"),
            (self.index.max_ef >= self.index.ef_search, "index.max_ef must not be under index.ef_search"),
            (self.index.distance == "cosine", "index.distance: only cosine is searched by"),
            (self.server.max_text_bytes > 0, "server.max_text_bytes must be over 0"),
        ]
        for good, message in rules:
            if not good:
                raise ConfigError(message)
