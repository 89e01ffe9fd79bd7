"""Lenient JSON configuration: comment lines and surplus commas are allowed, unknown keys are not."""

from __future__ import annotations

import json
import re
from pathlib import Path
from typing import Any

#: Keys that each kind of section may hold.
KNOWN = {
    "indexes": {"fields", "type", "namespaces", "skipLists", "skipRedirects", "skipDabs", "minWords", "minLinks", "titleMultiplier", "addInLinksToText", "booster", "analyzer", "similarity"},
    "concept-mappers": {"type", "path", "index", "delegates", "maxConcepts"},
    "metrics": {
        "type", "index", "field", "similarity", "similarityNormalizer", "mostSimilarNormalizer", "basedOn", "delegates", "components", "matrix",
        "transpose", "ensembleType", "minComponents", "maxPercentage", "minTermFreq", "minDocFreq", "minInLinks", "path", "useInternalMapper",
        "strict", "indexed", "stemming", "stopWords", "minWords", "minLinks",
    },
    "gold": {"similarity", "mostSimilar"},
    "models": None,
    "num-results": None,
    "threads": None,
}


def loads(text: str) -> dict[str, Any]:
    """Lines that begin with ``//`` are dropped; commas before a closing bracket, and missing ones between lines, mended."""
    body = "\n".join(x for x in text.splitlines() if not x.lstrip().startswith("//"))
    body = re.sub(r",(\s*[}\]])", r"\1", body)
    body = re.sub(r'(["\d\]}el])(\s*\n\s*)(?=")', r"\1,\2", body)
    return json.loads(body)


class Config:
    """A section of the configuration with typed, required or optional values."""

    def __init__(self, data: dict[str, Any], where: str = "configuration"):
        self.data, self.where = data, where

    @classmethod
    def read(cls, path: str | Path) -> Config:
        return cls(loads(Path(path).read_text(encoding="utf-8")), str(path))

    def section(self, *keys: str) -> Config:
        node: Any = self.data
        for k in keys:
            if not isinstance(node, dict) or k not in node:
                raise KeyError(f"{self.where} has no {'.'.join(keys)}")
            node = node[k]
        if not isinstance(node, dict):
            raise TypeError(f"{'.'.join(keys)} of {self.where} is no section")
        return Config(node, f"{self.where}: {'.'.join(keys)}")

    def _typed(self, key: str, kind: type | tuple[type, ...], default: Any) -> Any:
        if key not in self.data:
            if default is ...:
                raise KeyError(f"{self.where} lacks {key}")
            return default
        value = self.data[key]
        if not isinstance(value, kind) or isinstance(value, bool) and kind is not bool:
            raise TypeError(f"{key} of {self.where} has the wrong type")
        return value

    def string(self, key: str, default: Any = ...) -> str:
        return self._typed(key, str, default)

    def integer(self, key: str, default: Any = ...) -> int:
        return self._typed(key, int, default)

    def number(self, key: str, default: Any = ...) -> float:
        return self._typed(key, (int, float), default)

    def boolean(self, key: str, default: Any = ...) -> bool:
        return self._typed(key, bool, default)

    def strings(self, key: str, default: Any = ...) -> list[str]:
        value = self._typed(key, list, default)
        if not all(isinstance(x, str) for x in value):
            raise TypeError(f"{key} of {self.where} holds other things than strings")
        return value

    def names(self) -> list[str]:
        return sorted(self.data)

    def check(self, kind: str) -> Config:
        """Raise an error for keys that no section of this kind knows."""
        known = KNOWN.get(kind)
        if known and (extra := set(self.data) - known):
            raise KeyError(f"{self.where} has unknown keys: {', '.join(sorted(extra))}")
        return self
