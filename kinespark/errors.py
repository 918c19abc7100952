"""Typed errors: one class, a closed set of kinds."""

from __future__ import annotations

#: The kinds an expression can fail with.
EVAL_KINDS = ("parse", "unknown_function", "unknown_channel", "arg_count", "type", "division_by_zero", "no_lap_context", "not_implemented", "runtime")


class EvalError(Exception):
    def __init__(self, kind: str, message: str):
        assert kind in EVAL_KINDS
        super().__init__(message)
        self.kind = kind


class InputError(Exception):
    """A file or document that is there but can't be used. kind: io, parse, unsupported_version, invalid_magic, truncated, unknown_channel."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


#: The envelope's error kinds, and which of them an expression's failure counts as.
ENVELOPE_KINDS = ("io", "invalid_input", "not_found", "eval", "unsupported", "usage", "internal")
_INPUT = {"io": "io", "unknown_channel": "not_found"}


def envelope_kind(error: Exception) -> tuple[str, dict]:
    """(kind, details) of the JSON envelope for an error."""
    if isinstance(error, EvalError):
        return ("unsupported" if error.kind in ("not_implemented", "no_lap_context") else "eval"), {"eval_kind": error.kind}
    if isinstance(error, InputError):
        return _INPUT.get(error.kind, "invalid_input"), {}
    if isinstance(error, OSError):
        return "io", {}
    if isinstance(error, (ValueError, KeyError)):
        return "usage", {}
    return "internal", {}


def envelope(command: str, data=None, error: Exception | None = None, warnings: tuple[dict, ...] = (), engine: str = "kinespark") -> dict:
    """The JSON envelope of a command's outcome."""
    out: dict = {"schema": 1, "ok": error is None, "command": command, "engine": engine}
    if error is None:
        out["data"] = data
    else:
        kind, details = envelope_kind(error)
        out["error"] = {"kind": kind, "message": str(error), "details": details}
    return out | {"warnings": list(warnings)}
