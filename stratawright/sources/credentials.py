"""Endpoints and tokens of hosted models, by model, in a file that only its owner can read. It stays on the driver's machine."""

from __future__ import annotations

import json
import os
from pathlib import Path
from urllib.parse import urlparse


def place() -> Path:
    home = os.environ.get("XDG_CONFIG_HOME") or os.path.join(os.path.expanduser("~"), ".config")
    return Path(home) / "stratawright" / "credentials.json"


def load(model: str) -> dict[str, str]:
    """endpoint and token of a model, as far as saved."""
    path = place()
    return dict(json.loads(path.read_text()).get(model, {})) if path.exists() else {}


def save(model: str, endpoint: str, token: str | None = None) -> Path:
    """Keep the endpoint and, unless None, the token; an empty token is removed. An endpoint that is no web address is an error."""
    parts = urlparse(endpoint)
    if parts.scheme not in ("http", "https") or not parts.netloc:
        raise ValueError("an endpoint begins with http:// or https://")
    path = place()
    path.parent.mkdir(parents=True, exist_ok=True)
    known = json.loads(path.read_text()) if path.exists() else {}
    mine = {**known.get(model, {}), "endpoint": endpoint}
    if token is not None:
        mine["token"] = token
    known[model] = {k: v for k, v in mine.items() if v}
    other = path.with_suffix(".writing")
    with open(os.open(other, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w") as file:
        json.dump(known, file, indent=2, sort_keys=True)
    os.replace(other, path)
    return path
