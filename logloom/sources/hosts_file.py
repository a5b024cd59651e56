"""Container hosts from a TOML file."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass
from pathlib import Path

from logloom.schema import InvalidInput


@dataclass(frozen=True)
class ContainerHost:
    name: str
    base_url: str
    allow_insecure_http: bool = False

    def __post_init__(self):
        if not self.name or not self.base_url:
            raise InvalidInput("a host needs a name and a base_url")
        if self.base_url.startswith("http://") and not self.allow_insecure_http:
            raise InvalidInput(f"{self.name}: plain http must be allowed by allow_insecure_http")


def load_hosts(path: str) -> list[ContainerHost]:
    """The [[hosts]] entries; names must differ."""
    hosts = [ContainerHost(**entry) for entry in tomllib.loads(Path(path).read_text()).get("hosts", [])]
    if len({h.name for h in hosts}) != len(hosts):
        raise InvalidInput("host names must differ")
    return hosts
