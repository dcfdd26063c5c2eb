"""The option grammar of the command-line tools: /name:value, -name value, --name=value, flags, positionals."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_HELP = {"?", "h", "help"}


@dataclass
class Options:
    values: dict[str, str] = field(default_factory=dict)
    flags: set[str] = field(default_factory=set)
    positionals: list[str] = field(default_factory=list)
    help: bool = False

    def number(self, name: str, default: float | None = None) -> float | None:
        return float(self.values[name]) if name in self.values else default

    def numbers(self, name: str) -> list[float]:
        return [float(t) for t in self.values.get(name, "").split(",") if t.strip()]


def parse(arguments: list[str], valued: set[str], flags: set[str]) -> Options:
    """Names ignore case; unknown options are ignored. A value that begins with - must be given after : or =."""
    out = Options()
    valued, flags = {n.lower() for n in valued}, {n.lower() for n in flags}
    k = 0
    while k < len(arguments):
        token = arguments[k]
        k += 1
        m = re.fullmatch(r"(?:--|-|/)([A-Za-z?][\w-]*)(?:[:=](.*))?", token, re.S)
        if not m:
            out.positionals.append(token)
            continue
        name, value = m[1].lower(), m[2]
        if name in _HELP:
            out.help = True
        elif name in valued:
            if value is None and k < len(arguments) and not arguments[k].startswith(("-", "/")):
                value, k = arguments[k], k + 1
            if value is None:
                out.flags.add(name)  # an optional value left out
            else:
                out.values[name] = value
        elif name in flags:
            out.flags.add(name)
    return out
