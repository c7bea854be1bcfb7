"""The rules of the steps on one cell or a few rows, written plainly."""

from __future__ import annotations

import math
import re

SPACE = "\t\n\x0b\x0c\r                  　﻿"


def blank(s) -> bool:
    return s is None or not s.strip(SPACE)


def collapse(s: str) -> str:
    return re.sub(f"[{SPACE}]+", " ", s).strip(" ")


def number(s):
    if s is None:
        return None
    m = re.match(rf"[{SPACE}]*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", s.replace(",", ""))
    return float(m.group(1)) if m else None


def half_up(x: float, places: int) -> float:
    return math.floor(x * 10**places + 0.5) / 10**places


def fill(values: list, strategy: str) -> list:
    if strategy == "up":
        return fill(values[::-1], "down")[::-1]
    out, last = [], None
    for v in values:
        last = last if blank(v) else v
        out.append(last)
    return out


def mode(values: list):
    counts: dict = {}
    best, most = None, 0
    for v in values:
        if not blank(v):
            counts[v] = counts.get(v, 0) + 1
            if counts[v] > most:
                best, most = v, counts[v]
    return best


def fuzzy(keys: list[str], blanks: list[int], same, survivorship: str) -> set[int]:
    """Rows that go."""
    gone: set[int] = set()
    for i, a in enumerate(keys):
        if not a or i in gone:
            continue
        for j in range(i + 1, len(keys)):
            b = keys[j]
            if j in gone or not b or a[0] != b[0] or not same(a, b):
                continue
            swap = (survivorship == "longest" and len(b) > len(a)) or (survivorship == "mostComplete" and blanks[j] < blanks[i])
            gone.add(i if swap else j)
            if swap:
                break
    return gone


def leaders(values: list[str], same) -> dict[str, int]:
    """Place of the leader of each value."""
    out: dict[str, int] = {}
    for i, v in enumerate(values):
        if v not in out:
            out[v] = i
            for w in values[i + 1 :]:
                if w not in out and same(v.lower(), w.lower()):
                    out[w] = i
    return out
