"""Typed errors: what is wrong with a graph, and what is wrong with an input."""

from __future__ import annotations

import json

#: Codes of inputs and outputs that cannot be used; commands exit with ``EXIT_USAGE`` on any of them.
INPUT_CODES = [
    "INPUT_IS_DIRECTORY", "INPUT_NOT_FOUND", "INPUT_NOT_READABLE", "INPUT_MALFORMED_JSON", "INPUT_MALFORMED_JSONL", "INPUT_INVALID_GRAPH", "INPUT_INVALID_CHECK",
    "OUTPUT_NOT_WRITABLE",
]
EXIT_USAGE = 2


class GraphError(ValueError):
    """A graph, node, edge or id that is refused; ``code`` is a violation code."""

    def __init__(self, code: str, message: str, details: list[str] | None = None):
        super().__init__("; ".join([message, *(details or [])]))
        self.code, self.message, self.details = code, message, list(details or [])


class InputError(ValueError):
    """An input that cannot be used, with a hint for its user."""

    def __init__(self, code: str, message: str, hint: str, cause: BaseException | None = None):
        if code not in INPUT_CODES:
            raise ValueError(f"no such code: {code!r}")
        super().__init__(message)
        self.code, self.hint, self.cause = code, hint, cause

    def to_json(self) -> str:
        return json.dumps({"error": {"code": self.code, "message": str(self), "hint": self.hint}}, indent=2, ensure_ascii=False)

    def to_text(self, debug: bool = False) -> str:
        lines = [str(self), f"  {self.hint}"]
        if debug and self.cause is not None:
            lines.append(f"  cause: {type(self.cause).__name__}: {self.cause}")
        return "\n".join(lines)


def as_input_error(error: BaseException, code: str, hint: str) -> InputError:
    return error if isinstance(error, InputError) else InputError(code, str(error) or type(error).__name__, hint, error)
