"""Personal data by anchor expansion.

One Aho-Corasick pass finds the anchors of a text: at-signs, plus signs, digits, URL schemes and identifier cues. At each
anchor a small deterministic parser grows the span to both sides, validates it and says where the scan of its kind goes on,
so that spans of one kind never overlap and are found leftmost first.

Base kinds, each as the pattern named beside its parser would find it, failing matches dropped without another try: email,
ip, card, phone. Kinds that the anchors add: url (a scheme, then a host and path) and account (an identifier cue such as
"iban", then ":" "=" "#" or blanks, then a value that holds a digit). Offsets are code points, ends exclusive.

Edge cases: a null text is an empty one and has no spans; repeated rows are scanned each for itself; a text is scanned whole,
however long; other columns pass through by position, and only the named output columns are replaced.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passwatch.llm.common import map_arrow, texts_of

# Kinds in the order of the digest, characters of the patterns, schemes and cues.
KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE = 4
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
DIGITS = frozenset("0123456789")
LOCAL = frozenset(LETTERS + "0123456789._%+-")
LABEL = frozenset(LETTERS + "0123456789-")
DIAL = frozenset(" ().0123456789-")
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "mailto:", "tel:")
URL_STOPS = frozenset(" \t\r\n\f\v\"'<>`|\\^{}")
URL_TAIL = frozenset(".,;:!?)]")
CUES = ("iban", "ssn", "passport", "account", "acct", "user id", "customer id", "api_key", "api key", "token", "password", "secret")
JOINTS = frozenset(" \t:=#\"'")
VALUE = frozenset(LETTERS + "0123456789-_")


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for one in "0123456789@+":
        out.add_word(one, one)
    for scheme in SCHEMES:
        out.add_word(scheme, "url")
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            out.add_word(form, "account")
    out.make_automaton()
    return out


_CUES: list[ahocorasick.Automaton] = []


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9)
    return total % 10 == 0


def grow_email(t: str, at: int, floor: int) -> tuple[bool, int, int, int]:
    """[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+ around the at-sign; where it fails, the scan goes on behind it."""
    start, n = at, len(t)
    while start > floor and t[start - 1] in LOCAL:
        start -= 1
    end = at + 1
    while end < n and t[end] in LABEL:
        end += 1
    if start == at or end == at + 1:
        return False, start, at + 1, floor
    dots = 0
    while end + 1 < n and t[end] == "." and t[end + 1] in LABEL:
        dots += 1
        end += 2
        while end < n and t[end] in LABEL:
            end += 1
    return dots > 0, start, end, end if dots else floor


def grow_ip(t: str, at: int) -> tuple[bool, int, int]:
    """[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+), parts at most 255, from the first digit of a run."""
    end, n, parts = at, len(t), []
    while len(parts) < 4:
        start = end
        while end < n and t[end] in DIGITS:
            end += 1
        parts.append(t[start:end])
        if len(parts) < 4:
            if end + 1 < n and t[end] == "." and t[end + 1] in DIGITS:
                end += 1
            else:
                return False, at, at + len(parts[0])  # no match starts in this run of digits
    return all(int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in parts), at, end


def grow_card(t: str, at: int) -> tuple[bool, int, int]:
    """[0-9]([\\x20-]?[0-9])+, 16 to 19 digits that pass Luhn."""
    end, n, digits = at + 1, len(t), [t[at]]
    while end < n:
        if t[end] in DIGITS:
            digits.append(t[end])
            end += 1
        elif t[end] in " -" and end + 1 < n and t[end + 1] in DIGITS:
            digits.append(t[end + 1])
            end += 2
        else:
            break
    return 16 <= len(digits) <= 19 and luhn("".join(digits)), at, end


def grow_phone(t: str, at: int) -> tuple[bool, int, int]:
    """\\+[0-9][\\x20().0-9-]+[0-9], 8 to 15 digits."""
    n = len(t)
    if at + 1 >= n or t[at + 1] not in DIGITS:
        return False, at, at + 1
    end = at + 2
    while end < n and t[end] in DIAL:
        end += 1
    while end > at + 3 and t[end - 1] not in DIGITS:
        end -= 1
    if end <= at + 3:
        return False, at, at + 1
    return 8 <= sum(c in DIGITS for c in t[at:end]) <= 15, at, end


def grow_url(t: str, end_of_cue: int, cue_start: int) -> tuple[bool, int, int]:
    end, n = end_of_cue, len(t)
    while end < n and t[end] not in URL_STOPS:
        end += 1
    while end > end_of_cue and t[end - 1] in URL_TAIL:
        end -= 1
    return end > end_of_cue, cue_start, max(end, end_of_cue)


def grow_account(t: str, end_of_cue: int, cue_start: int) -> tuple[bool, int, int]:
    start, n = end_of_cue, len(t)
    if cue_start and t[cue_start - 1] in VALUE or start < n and t[start] in VALUE:
        return False, start, start
    while start < n and t[start] in JOINTS:
        start += 1
    end = start
    while end < n and t[end] in VALUE:
        end += 1
    value = t[start:end]
    return start > end_of_cue and len(value) >= 6 and not DIGITS.isdisjoint(value), start, end


def spans(t: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of every span, by kind as in KINDS, then start."""
    if not _CUES:
        _CUES.append(automaton())
    found, free = [], [0] * len(KINDS)
    cues_at = {}
    for last, what in _CUES[0].iter(t):
        if what in DIGITS:
            if last >= free[1]:
                ok, a, b = grow_ip(t, last)
                free[1] = b
                if ok:
                    found.append((1, a, b))
            if last >= free[2]:
                ok, a, b = grow_card(t, last)
                free[2] = b
                if ok:
                    found.append((2, a, b))
        elif what == "@":
            if last >= free[0]:
                ok, a, b, free[0] = grow_email(t, last, free[0])
                if ok:
                    found.append((0, a, b))
        elif what == "+":
            if last >= free[3]:
                ok, a, b = grow_phone(t, last)
                free[3] = b
                if ok:
                    found.append((3, a, b))
        else:
            cues_at.setdefault(what, []).append(last + 1)
    for end in cues_at.get("url", ()):
        start = min(end - len(s) for s in SCHEMES if end >= len(s) and t.startswith(s, end - len(s)))
        if start >= free[4]:
            ok, a, b = grow_url(t, end, start)
            if ok:
                free[4] = b
                found.append((4, a, b))
    for end in cues_at.get("account", ()):
        start = min(end - len(c) for c in CUES if end >= len(c) and t[end - len(c) : end].lower() == c)
        ok, a, b = grow_account(t, end, start)
        if ok and a >= free[5]:
            free[5] = b
            found.append((5, a, b))
    found.sort()
    return found


def digest_text(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in found)


def find(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The columns `keep`, counts n_<kind> of the base kinds, base (their spans) and spans (all spans) as kind:start:end."""
    kept = df.select(*keep).schema
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"n_{k} long" for k in KINDS[:BASE]] + ["base string", "spans string"])

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [spans(t) for t in texts_of(batch.column(len(keep)))]
        counts = [pa.array([sum(s[0] == k for s in r) for r in rows], pa.int64()) for k in range(BASE)]
        base = pa.array([digest_text([s for s in r if s[0] < BASE]) for r in rows], pa.string())
        return pa.record_batch([*batch.columns[: len(keep)], *counts, base, pa.array(map(digest_text, rows), pa.string())], [*keep, *(f"n_{k}" for k in KINDS[:BASE]), "base", "spans"])

    return map_arrow(df.select(*keep, F.col(text).alias("__text")), kernel, schema, "__text")


def redact_text(t: str, found: list[tuple[int, int, int]]) -> str:
    """Each span replaced by its kind in brackets; of overlapping spans the first, and then the longer, gives the name."""
    out, at = [], 0
    for a, b, k in sorted(((a, b, k) for k, a, b in found), key=lambda s: (s[0], -s[1], s[2])):
        if a >= at:
            out += [t[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join(out) + t[at:]


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the personal data of `text` replaced; a null text stays null."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index(text)
        new = [t if t is None else redact_text(t, spans(t)) for t in batch.column(at).to_pylist()]
        return batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return map_arrow(df, kernel, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), text)
