"""Letters that every match of a regular expression must contain."""

from __future__ import annotations

import re

# Shortest run of letters that serves as a key.
LEAST = 3
# Constructs whose reading would need more than this module knows: such a pattern has no key.
_OPAQUE = re.compile(r"\\Q|\\[NXRx0uck]|\(\?[a-zA-Z-]*[xud]|\(\?<?[=!].*\||\[[^\]]*(?:\[|&&)")
_TOKEN = re.compile(r"\\[pP]\{[^}]*\}|\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\(\?[a-zA-Z-]*\)|\(\?(?:<[A-Za-z]\w*>|[a-zA-Z-]*:|<?[=!]|>)|[()|]|.", re.S)
_REPEAT = re.compile(r"(\*|\+|\?|\{(\d+)(?:,\d*)?\})[?+]?")


def required_literals(pattern: str) -> list[str] | None:
    """Lower-case ASCII runs of letters, one of which is in every match; None if unknown.

    A run is read as it stands in the pattern: letters side by side that must all be
    there.  Alternatives give one run each, and a pattern with an alternative that has
    none gives None, as does one with comments, Unicode case folding or quoting.  What
    a look-around holds is not required.
    """
    if _OPAQUE.search(pattern):
        return None
    tokens = _TOKEN.findall(pattern)
    found, at = _alternatives(tokens, 0)
    return found if at == len(tokens) else None


def _alternatives(tokens: list[str], at: int) -> tuple[list[str] | None, int]:
    """Runs of a group's alternatives from ``at`` on, and the place of its end."""
    runs: list[str] | None = []
    while True:
        best, at = _sequence(tokens, at)
        runs = None if runs is None or best is None else runs + best
        if at >= len(tokens) or tokens[at] == ")":
            return runs, at
        at += 1  # past "|"


def _sequence(tokens: list[str], at: int) -> tuple[list[str] | None, int]:
    """The best set of runs of one alternative, up to ``|``, ``)`` or the end."""
    best: list[str] | None = None
    run = ""

    def better(new: list[str] | None) -> None:
        nonlocal best
        if new and min(map(len, new)) >= LEAST:
            if best is None or (min(map(len, new)), -len(new)) > (min(map(len, best)), -len(best)):
                best = new

    while at < len(tokens) and tokens[at] not in ("|", ")"):
        token = tokens[at]
        inner = None
        if token.startswith("(") and not (token.startswith("(?") and token.endswith(")")):
            inner, at = _alternatives(tokens, at + 1)
            if token in ("(?=", "(?!", "(?<=", "(?<!"):
                inner = None
        at += 1
        rest = "".join(tokens[at : at + 12])
        repeat = _REPEAT.match(rest)
        least = 1
        if repeat:
            least = 0 if repeat[1] in ("*", "?") else int(repeat[2] or 1)
            width = 0
            while width < repeat.end():
                width += len(tokens[at])
                at += 1
        letter = len(token) == 1 and token.isascii() and token.isalpha()
        if letter and least:
            run += token.lower()
            if repeat:
                better([run])
                run = token.lower()
        elif token in (r"\b", r"\B", "^", "$") or (token.startswith("(?") and token.endswith(")")):
            pass  # no width: letters on both sides are neighbours
        else:
            better([run])
            run = ""
            if least:
                better(inner)
    better([run])
    return best, at
