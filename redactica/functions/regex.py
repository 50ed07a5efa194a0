"""One pattern catalogue, two dialects: Python's re and the JVM's."""

from __future__ import annotations

import functools
import re

_WORD, _DIGIT = r"\p{L}\p{N}_", r"\p{Nd}"
_SPACE = r"\t\n\x0b\f\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


@functools.cache
def java(pattern: str, ignore_case: bool = False) -> str:
    r"""A Python pattern for java.util.regex: \w, \d and \s mean what they mean in Python, whatever the script."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if pattern.startswith(r"[^\S\n]", i):
            out.append("[" + _SPACE.replace(r"\n", "") + "]")
            i += 7
            continue
        if two == r"\w":
            out.append(_WORD if inside else f"[{_WORD}]")
        elif two == r"\d":
            out.append(_DIGIT)
        elif two == r"\s":
            out.append(_SPACE if inside else f"[{_SPACE}]")
        elif two[0] == "\\":
            out.append(two)
        elif pattern.startswith("(?i:", i):
            out.append("(?iu:")
            i += 4
            continue
        else:
            c = pattern[i]
            inside = True if c == "[" and not inside else False if c == "]" and inside else inside
            out.append(c)
            i += 1
            continue
        i += 2
    return ("(?iu)" if ignore_case else "") + "".join(out)


_HEAD = re.compile(r"((?:\(\?<![^()]*\))+)(\\d|\[[^\[\]]*\])(?:\{(\d+)\}|(?![*+?{]))")
_EITHER = re.compile(r"\(\?:\\d(\(\?:[^()|]*\)\{\d+\})\|\\d(\(\?:[^()|]*\)\{\d+\})\)")


def _behind(pattern: str) -> str:
    """The same pattern with what must not stand before it asked after its first character: a search then skips to such characters."""
    pattern = re.sub(r"^((?:\(\?<![^()]*\))+)" + _EITHER.pattern, lambda m: f"{m[1]}\\d(?:{m[2]}|{m[3]})", pattern)
    m = _HEAD.match(pattern)
    if not m:
        return pattern
    first, n = m[2], int(m[3] or 1)
    looks = re.sub(r"\(\?<!([^()]*)\)", lambda x: f"(?<!{x[1]}{first})", m[1])
    return first + looks + (f"{first}{{{n - 1}}}" if n > 1 else "") + pattern[m.end() :] if n else pattern


@functools.cache
def python(pattern: str, ignore_case: bool = False) -> re.Pattern[str]:
    return re.compile(_behind(pattern), re.IGNORECASE if ignore_case else 0)
