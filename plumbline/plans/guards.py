"""What stands between a plan and its execution."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from fnmatch import fnmatchcase


@dataclass(frozen=True)
class Limits:
    """Bytes, shares and rows beyond which something is warned of or refused."""

    script_bytes: int = 100 << 20
    scan_bytes: int = 200 << 20
    delete_share: float = 0.05
    closure_rows: int = 5_000
    inline_bytes: int = 8 << 20


@dataclass(frozen=True)
class ApplyRequest:
    target: str
    environment: str
    confirmation: str
    acknowledged: bool
    destructive: tuple[str, ...] = ()
    drift: tuple[str, ...] = ()
    steps: int = 1
    script_bytes: int = 0


def classify(name: str, rules: Iterable[tuple[str, str]], default: str = "Unknown") -> str:
    """The environment of a server: the first rule (pattern with wildcards, environment) that fits."""
    return next((env for pattern, env in rules if fnmatchcase(name.lower(), pattern.lower())), default)


def blockers(request: ApplyRequest, limits: Limits = Limits()) -> list[str]:
    """All that forbids applying, not the first only."""
    out = []
    if not request.steps:
        out.append("the plan is empty")
    if request.environment == "Prod":
        out.append(f"{request.target} is production and read-only")
    if request.confirmation != request.target:
        out.append("the target's name has to be typed to confirm")
    if request.destructive and not request.acknowledged:
        out.append("these steps lose data and aren't acknowledged: " + "; ".join(request.destructive))
    if request.script_bytes > limits.script_bytes:
        out.append(f"the script is larger than {limits.script_bytes} bytes")
    out += list(request.drift[:5])
    return out
