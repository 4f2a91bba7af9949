"""One regular expression per layout for its plain, well-formed sentences.

The expression accepts only lines that the field rules would accept as well: plain digits, no
blanks, tags in their usual order, values clear of the limits.  Nearly every line an instrument
sends is of that kind and is settled by one match.  Whatever does not match, good or bad, goes
through the field rules, so the expressions decide speed and never results.
"""

from __future__ import annotations

import math

from brinelake import layouts as L
from brinelake.functions import sentences as S

FRACTION = r"(?:\.\d*+)?"
MARKER = r"-9\.0{2,4}|-99\.99"
FREE_TEXT = r"[^,* =]*"


def digits(low: int, high: int) -> str:
    """Whole numbers from ``low`` to ``high`` without leading zeros."""
    parts: list[str] = []
    while low <= high:
        if low == 0:
            parts.append("0")
            low = 1
            continue
        # The longest run from ``low`` that ends in nines and stays within ``high``.
        width = len(str(low))
        size = 1
        while low % (size * 10) == 0 and low + size * 10 - 1 <= min(high, 10**width - 1):
            size *= 10
        free = len(str(size)) - 1
        stem = low // size
        last = min(9, stem % 10 + (min(high, 10**width - 1) - low + 1) // size - 1)
        head = str(stem)[:-1]
        digit = str(stem % 10) if last == stem % 10 else f"[{stem % 10}-{last}]"
        parts.append(head + digit + (rf"\d{{{free}}}" if free else ""))
        low = (stem // 10 * 10 + last + 1) * size
    return f"(?:{'|'.join(reversed(parts))})"


def _limits(f: L.FieldSpec) -> tuple[float, float]:
    low, high = f.store_bounds()
    return (max(x for x in (f.lo, low, -1e15) if x is not None),
            min(x for x in (f.hi, high, 1e15) if x is not None))


def _number(f: L.FieldSpec) -> str:
    """Decimals whose whole part keeps a distance from both limits."""
    low, high = _limits(f)
    top = math.floor(high) - 1
    if low > 1:
        return digits(math.ceil(low), top) + FRACTION
    if low > 0:
        return rf"(?:{digits(1, top)}{FRACTION}|0\.\d?[1-9]\d*)"
    if low > -1:
        return digits(0, top) + FRACTION
    return _both_signs(math.floor(-low) - 1, top) + FRACTION


def _whole(f: L.FieldSpec) -> str:
    low, high = _limits(f)
    if low >= 0:
        return digits(int(low), int(high))
    return _both_signs(int(-low), int(high))


def _both_signs(below: int, above: int) -> str:
    """Whole numbers from ``-below`` to ``above``."""
    if below == above:
        return "-?" + digits(0, above)
    return f"(?:{digits(0, above)}|-{digits(0, below)})"


def field_pattern(f: L.FieldSpec) -> str:
    allowed = f.store_allowed or f.allowed
    if allowed:
        return f"(?:{'|'.join(allowed)})"
    bare = lambda p: p.removeprefix("^").removesuffix("$")
    if f.kind == L.INT:
        return _whole(f)
    if f.kind == L.NUM:
        return _number(f)
    if f.kind == L.OPT:
        return f"(?:{MARKER}|{_number(f)})?"
    return {
        L.DATE_M: bare(S.DATE_M_PATTERN), L.DATE_Y: bare(S.DATE_Y_PATTERN),
        L.TIME: bare(S.TIME_PATTERN), L.TEXT: FREE_TEXT, L.UPPER: FREE_TEXT,
        L.HEX: rf"[0-9A-Fa-f]{{{f.min_len},{f.max_len}}}",
        L.HEAD: rf"[A-Za-z0-9_]{{{f.min_len},{f.max_len}}}",
        L.HEAD_N: rf"[0-9]{{{f.min_len},{f.max_len}}}",
    }[f.kind]


def line_pattern(layout: L.Layout) -> str:
    """Plain sentences of a layout, with or without checksum."""
    synonyms: dict[str, list[str]] = {}
    for other, tag in layout.synonyms.items():
        synonyms.setdefault(tag, [tag]).append(other)

    def shown(f: L.FieldSpec, pattern: str) -> str:
        if layout.style != L.TAGGED:
            return pattern
        return f"(?:{'|'.join(synonyms.get(f.tag, [f.tag]))})={pattern}"

    parts = [shown(f, field_pattern(f)) for f in layout.fields]
    if layout.beam_rule:  # code, head and beams depend on each other
        code, head, beams = layout.fields[:3]
        middle = shown(head, field_pattern(head))
        parts[:3] = [f"(?:{shown(code, '4')},{middle},{shown(beams, '4')}"
                     f"|{shown(code, '[02]')},{middle},{shown(beams, '[1-3]')})"]
    body = ",".join(parts)
    if layout.style == L.SERIES:
        body += r",[-0-9.,]*+"
    return rf"^\${layout.prefix},{body}(?:\*[^* ]*)?$"
