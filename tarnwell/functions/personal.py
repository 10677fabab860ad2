"""Personal data and secrets in texts: candidates by pattern, kept only if a check of their own says so, with their places.

Patterns take whole runs of the characters that a value may have, so nothing is found inside a longer run. What must follow
a run is optional in them, so a run without it is passed over at once, not tried again from each of its characters; the
check then turns it down. Texts are read
in Arrow batches, one at a time and whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F

#: Bits for each character that a secret has at the least.
ENTROPY = 3.0


def card(x: str) -> bool:
    """13 to 19 digits whose check digit is right: every second digit from the end is doubled, and all sum up to tens."""
    if not 13 <= len(x) <= 19:
        return False
    digits = [int(c) for c in reversed(x)]
    return sum(d if i % 2 == 0 else d // 5 + 2 * d % 10 for i, d in enumerate(digits)) % 10 == 0


def iban(x: str) -> bool:
    """A country, two check digits and 11 to 30 letters or digits: turned round and read as a number it leaves 1 modulo 97."""
    return re.fullmatch("[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", x) is not None and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def address(x: str) -> bool:
    """Four numbers of up to 255, without needless zeros."""
    parts = x.split(".")
    return len(parts) == 4 and all(len(p) <= 3 and str(int(p)) == p and int(p) <= 255 for p in parts)


def entropy(x: str) -> float:
    """Shannon's entropy of a string's characters, in bits for each."""
    return -sum(n / len(x) * math.log2(n / len(x)) for n in Counter(x).values())


def secret(x: str) -> bool:
    """A value of 16 characters or more, as mixed as chance makes it."""
    return len(x) >= 16 and entropy(x) >= ENTROPY


def mail(x: str) -> bool:
    """No dot at an end of the name or next to another, and a domain of two labels or more."""
    name, _, domain = x.partition("@")
    return all(name.split(".")) and "." in domain


#: By kind the pattern of candidates, whose last group is the value, and its check.
KINDS: dict[str, tuple[str, Callable[[str], bool]]] = {
    "card": (r"([0-9]+)", card),
    "iban": (r"([A-Za-z0-9]+)", iban),
    "ip": (r"([0-9]++(?:\.[0-9]++)*+)", address),
    "mail": (r"([A-Za-z0-9._%+-]++(?:@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+)?+)", mail),
    "secret": (r"(?:token|secret|password|api_key) *[=:] *[\"']([A-Za-z0-9+/=_-]*)[\"']", secret),
}
SPANS = "array<struct<kind: string, start: int, end: int, value: string>>"


def found(text: str, kinds: tuple[str, ...] = tuple(KINDS)) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of all values that pass their check, by start and kind; characters from 0."""
    out = []
    for kind in kinds:
        pattern, check = KINDS[kind]
        out += [(kind, m.start(1), m.end(1), m[1]) for m in re.finditer(pattern, text) if check(m[1])]
    return sorted(out, key=lambda x: (x[1], x[0]))


def masked(text: str, spans: list[tuple[str, int, int, str]]) -> str:
    """The text with each span as `<kind>`; of spans that overlap, the one that begins first, then the longest."""
    out, at = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda x: (x[1], -x[2], x[0])):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
            at = end
    return "".join(out) + text[at:]


def checked(kinds: tuple[str, ...] = tuple(KINDS)):
    """A function of a column of texts to `spans` and the text with them `masked`; null for null."""

    @F.pandas_udf(f"spans {SPANS}, masked string")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            s = None if t is None else found(t, kinds)
            rows.append((None, None) if s is None else ([dict(zip(("kind", "start", "end", "value"), x, strict=True)) for x in s], masked(t, s)))
        return pd.DataFrame(rows, columns=["spans", "masked"], dtype=object)

    return run
