"""Results by plain Python."""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

from wordloom.llm.mixing import NOISE


def mixed_copies(rows: list[tuple]) -> dict:
    """(id, text, source) -> how often the mix takes each id: shares by weight, then keys in order up to the rest."""
    size = {i: len((t or "").split()) for i, t, _ in rows}
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[i] for i, _, x in rows if x == s) for s in sources}
    weight = {s: k % 3 + 1 for k, s in enumerate(sources)}
    full: set = set()
    while True:
        rest, w = sum(total.values()) - sum(3 * total[s] for s in full), sum(weight[s] for s in sources if s not in full)
        target = {s: Fraction(3 * total[s]) if s in full else Fraction(rest * weight[s], w) for s in sources}
        new = {s for s in sources if target[s] > 3 * total[s]} - full
        if not new:
            break
        full |= new
    out = {}
    for s in sources:
        epochs = math.floor(target[s] / total[s]) if total[s] else 0
        left, upto, keyed = target[s] - epochs * total[s], 0, []
        for i, t, x in rows:
            if x == s:
                t = t or ""
                u = (int(hashlib.md5(f"20|{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                keyed.append((-math.log(u) / max(0.1, 1 - 5 * sum(c in NOISE for c in t) / max(len(t), 1)), str(i), i))
        for *_, i in sorted(keyed):
            upto += size[i]
            out[i] = min(3, epochs + (upto - Fraction(size[i], 2) <= left))
    return out
