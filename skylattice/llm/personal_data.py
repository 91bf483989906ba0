"""Personal data by anchor expansion: an automaton finds anchors, small parsers expand and validate them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textops as T

#: Kinds in the order in which spans are listed; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "address", "account", "iban")
BASE = 4
#: Fixed cues: schemes of addresses that can name a user, and words before an account's number.
SCHEMES = ("http", "https", "ftp", "sftp", "ssh", "imap", "smtp")
CUES = ("account", "acct")
#: Bytes of a text that the automaton reads at once.
AT_ONCE = 1 << 20
DIGITS = "0123456789"
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
WORD = LOCAL - set(".%+-")
#: What follows an anchor, as patterns of bounded shape; the last three read lower-cased text.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
RUN = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
USER_AT = re.compile(r"[a-z0-9._~%!$&'()*+,;=:-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)*")
GAP = re.compile(r"(?:\x20(?:number|no|nr))?[\x20.:#=]{0,3}")
IBAN = re.compile(r"[a-z]{2}[0-9]{2}(?:(?:\x20[a-z0-9]{4}){2,7}(?:\x20[a-z0-9]{1,3})?|[a-z0-9]{11,30})")

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number holds."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if c in DIGITS)


def email(text: str, at: int, free: int) -> tuple[Span | None, int]:
    domain, start = DOMAIN.match(text, at + 1), at
    while domain and start > free and text[start - 1] in LOCAL:
        start -= 1
    return ((start, domain.end()), domain.end()) if domain and start < at else (None, free)


def ip(text: str, at: int, free: int) -> tuple[Span | None, int]:
    while at > free and text[at - 1] in DIGITS:
        at -= 1
    found = IP.match(text, at)
    if not found:
        return None, free
    small = all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in found[0].split("."))
    return (found.span() if small else None), found.end()


def card(text: str, at: int, free: int) -> tuple[Span | None, int]:
    found = RUN.match(text, at)
    if not found:
        return None, free
    digits = digits_of(found[0]) if len(found[0]) < 40 else ""
    return (found.span() if 16 <= len(digits) <= 19 and luhn(digits) else None), found.end()


def phone(text: str, at: int, free: int) -> tuple[Span | None, int]:
    found = PHONE.match(text, at)
    if not found:
        return None, free
    return (found.span() if 8 <= len(digits_of(found[0])) <= 15 else None), found.end()


def address(low: str, at: int, free: int) -> tuple[Span | None, int]:
    found = USER_AT.match(low, low.index("://", at) + 3)
    return ((at, found.end()), found.end()) if found else (None, free)


def behind(low: str, at: int, cue: str, shape: re.Pattern[str]) -> re.Match[str] | None:
    """The number behind a cue that begins a word."""
    return shape.match(low, GAP.match(low, at + len(cue)).end()) if not at or low[at - 1] not in WORD else None


def account(low: str, at: int, free: int) -> tuple[Span | None, int]:
    found = behind(low, at, next(c for c in CUES if low.startswith(c, at)), RUN)
    if not found:
        return None, free
    return (found.span() if 6 <= len(digits_of(found[0])) <= 17 else None), found.end()


def checked(words: str) -> bool:
    """Whether the check number of an IBAN holds."""
    code = words.replace(" ", "")
    return int("".join(str(int(x, 36)) for x in code[4:] + code[:4])) % 97 == 1


def iban(low: str, at: int, free: int) -> tuple[Span | None, int]:
    """The last of several groups may be a word behind the number."""
    found = behind(low, at, "iban", IBAN)
    if not found:
        return None, free
    start = found.start()
    whole = next((w for w in (found[0], found[0].rpartition(" ")[0]) if w and checked(w)), "")
    return ((start, start + len(whole)) if whole else None), found.end()


PARSERS: tuple[Callable[[str, int, int], tuple[Span | None, int]], ...] = (email, ip, card, phone, address, account, iban)


def automaton() -> ahocorasick.Automaton:
    """Anchors as (kinds, length): at-signs, digit pairs as they begin each number, schemes and cues."""
    needles: dict[str, list[int]] = {"@": [0]}
    for a in DIGITS:
        needles["+" + a] = [3]
        for b in DIGITS:
            needles |= {f"{a}.{b}": [1], a + b: [2], f"{a} {b}": [2], f"{a}-{b}": [2]}
    needles |= {f"{s}://": [4] for s in SCHEMES} | {c: [5] for c in CUES} | {"iban": [6]}
    found = ahocorasick.Automaton()
    for needle, kinds in needles.items():
        found.add_word(needle, (kinds, len(needle)))
    found.make_automaton()
    return found


LONGEST = max(len(s) + 3 for s in SCHEMES)


def spans(raw: bytes, found: ahocorasick.Automaton) -> list[list[Span]]:
    """Spans of each kind, in bytes: anchors are parsed from left to right, and a kind goes on behind its
    last match, whether that passed its checks or not."""
    text, low = raw.decode("latin-1"), raw.lower().decode("latin-1")  # a character a byte
    free, out = [0] * len(KINDS), [[] for _ in KINDS]
    for at in range(0, len(text), AT_ONCE):
        begin = max(0, at - LONGEST + 1)
        for last, (kinds, length) in found.iter(low[begin : at + AT_ONCE]):
            start = begin + last - length + 1
            for k in kinds:
                if start >= free[k] and begin + last >= at:
                    span, free[k] = PARSERS[k](text if k < BASE else low, start, free[k])
                    if span:
                        out[k].append(span)
    return out


def places(raw: bytes, found: list[list[Span]]) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, from spans in bytes."""
    if raw.isascii():
        return [(k, a, b) for k, each in enumerate(found) for a, b in each]
    out = []
    for k, each in enumerate(found):
        at = points = 0
        for a, b in each:
            points += len(raw[at:a].decode())
            out.append((k, points, points + b - a))  # spans are ASCII
            at, points = b, points + b - a
    return out


def listed(rows: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in rows)


def personal_data(docs: DataFrame) -> DataFrame:
    """Personal data in every whole text.

    An Aho-Corasick automaton reads each text once and finds at-signs, starts of numbers, schemes and
    cue words; at each anchor a parser of its kind expands to the bounds of a match and checks it.
    Kinds, each leftmost and non-overlapping: email, ip (parts at most 255), card (16 to 19
    digits with a right check digit), phone (+, 8 to 15 digits); and, as additions, address
    (a URL that names a user), account (6 to 17 digits behind a cue word) and iban (one with a
    right check number behind that word), whatever their case.

    Texts are read as UTF-8 bytes, of which all anchors and matches are ASCII; places are code points.
    Null and empty texts hold nothing; very long ones are read in parts that overlap. One row per
    input row, repeated rows and null doc_ids too; an empty table gives no rows. Other columns are ignored.

    Returns doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton()
        for batch in batches:
            column, counts, bases, every = batch["text"].cast(pa.large_binary()), [], [], []
            for i in range(batch.num_rows):
                raw = column[i].as_py() or b""
                rows = places(raw, spans(raw, found))
                base = [r for r in rows if r[0] < BASE]
                counts.append([sum(r[0] == k for r in base) for k in range(BASE)])
                bases.append(hashlib.sha256(listed(base).encode()).hexdigest())
                every.append(listed(rows))
            numbers = [pa.array([c[k] for c in counts], pa.int64()) for k in range(BASE)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *numbers, pa.array(bases, pa.string()), pa.array(every, pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS[:BASE]), "base_sha256", "spans"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(T.lean(task), f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
