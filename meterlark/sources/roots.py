"""Account roots: which folders hold transcripts, what they are called, and which are on.  Configuration, on the driver."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable
from dataclasses import dataclass


@dataclass(frozen=True)
class Spec:
    provider: str
    default_name: str
    default_label: str
    env: str
    home_prefix: str | None
    strip_prefix: str
    folders: tuple[str, ...]


#: Where each provider keeps its transcripts.
A = Spec("claude", ".claude", "default", "CLAUDE_CONFIG_DIR", ".claude-", ".claude-", ("projects",))
B = Spec("codex", ".codex", "codex", "CODEX_HOME", None, ".codex-", ("sessions", "archived_sessions"))


@dataclass(frozen=True)
class Root:
    provider: str
    label: str
    explicit: bool
    path: str
    source: str
    enabled: bool
    identity: str

    def folders(self) -> list[str]:
        return [os.path.join(self.path, f) for f in (A if self.provider == A.provider else B).folders]


def identity_of(path: str) -> str:
    return hashlib.sha256(os.path.realpath(path).encode("utf-8", "surrogateescape")).hexdigest()[:32]


def derived_label(name: str, prefix: str) -> str:
    """A folder's name without the provider's prefix, else without a leading dot; never empty."""
    short = name.removeprefix(prefix) if prefix and name.startswith(prefix) else name.removeprefix(".")
    return short or name or "account"


def free_label(label: str, taken: set[str]) -> str:
    """label, or with -2, -3, ... where it is taken."""
    out, n = label, 2
    while out in taken:
        out, n = f"{label}-{n}", n + 1
    taken.add(out)
    return out


def discover(spec: Spec, config: dict, home: str, env: dict[str, str], reserved: Iterable[str] = ()) -> list[Root]:
    """A provider's roots in order: the default, the environment's, configured ones, those found in the home folder.

    One folder counts once, as first found; its configured label and switch hold wherever it was found.
    The default is listed even when missing; others must be folders.
    """
    full = lambda p: os.path.abspath(os.path.join(home, p[2:]) if p.startswith("~/") else home if p == "~" else p)
    entries = config.get(f"{spec.provider}_roots", [])
    off = {full(p) for p in config.get("disabled_roots", []) if p}
    said: dict[str, dict] = {}
    for e in entries:
        own = said.setdefault(os.path.realpath(full(e["path"])), {})
        for field in ("label", "enabled"):
            if e.get(field) is not None:
                own.setdefault(field, e[field])
    found = [(os.path.join(home, spec.default_name), "auto")]
    if env.get(spec.env):
        found.append((full(env[spec.env]), "env"))
    found += [(full(e["path"]), "config") for e in entries]
    if spec.home_prefix and os.path.isdir(home):
        found += [(os.path.join(home, n), "home") for n in sorted(os.listdir(home)) if n.startswith(spec.home_prefix)]
    seen: set[str] = set()
    taken, out = set(reserved), []
    for path, source in found:
        real = os.path.realpath(path)
        if real in seen or (source != "auto" and not os.path.isdir(path)):
            continue
        seen.add(real)
        own = said.get(real, {})
        label = own.get("label") or (spec.default_label if source == "auto" else derived_label(os.path.basename(path), spec.strip_prefix))
        out.append(Root(spec.provider, free_label(label, taken), bool(own.get("label")), path, source, own.get("enabled", True) is not False and path not in off, identity_of(path)))
    return out


def discover_all(config: dict, home: str, env: dict[str, str]) -> list[Root]:
    """Both providers' roots; labels are unique over both, and `all` is never one of provider B's."""
    first = discover(A, config, home, env)
    return first + discover(B, config, home, env, ["all", *(r.label for r in first)])
