"""Plain versions of what the operators compute, one row at a time."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import xxhash


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def spaced(text: str) -> list[str]:
    return re.findall("[^\x20\x09-\x0d]+", lower(text))


def words(text: str) -> list[str]:
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def contamination(text: str, items: dict[int, str]) -> tuple[int, int, int, str]:
    ws, hit, ids = words(text), set(), set()
    for key, item in items.items():
        iw = words(item)
        n = min(10, len(iw))
        windows = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
        for i in range(len(ws) - n + 1) if n else ():
            if tuple(ws[i : i + n]) in windows:
                hit.update(range(i, i + n))
                ids.add(str(key))
    return len(ws), len(hit), len(ids), sha(",".join(sorted(ids)))


def fingerprint(text: str, size: int = 3) -> int:
    ws = spaced(text)
    if not ws:
        return 0
    grams = [" ".join(ws[i : i + size]) for i in range(len(ws) - size + 1)] or [" ".join(ws)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids: list[int], links: list[tuple[int, int]]) -> dict[int, int]:
    root = {i: i for i in ids}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def hamming_classes(fps: dict[int, int], errors: int = 2) -> dict[int, int]:
    ids = sorted(fps)
    a = np.array([fps[i] for i in ids], np.uint64)
    links = [(ids[k], ids[k + 1 + j]) for k in range(len(ids)) for j in np.flatnonzero(np.bitwise_count(a[k + 1 :] ^ a[k]) <= errors).tolist()]
    return components(ids, links)


def shingle_set(text: str, size: int = 5) -> frozenset[str]:
    ws = spaced(text)
    return frozenset([" ".join(ws[i : i + size]) for i in range(len(ws) - size + 1)] or ([" ".join(ws)] if ws else []))


def secrets(text: str) -> str:
    t, out = text or "", []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.ASCII):
        if len(m.group(2)) >= 12:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 18]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 16]
    return ",".join(f"{k}:{a}:{z}" for a, _, k, z in sorted(out))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def pii(text: str) -> str:
    t, out = text or "", []
    out += [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, "card", m.end()))
    out += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return ",".join(f"{k}:{a}:{z}" for a, _, k, z in sorted(out))
