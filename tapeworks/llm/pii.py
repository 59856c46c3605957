"""Format-preserving pseudonyms for personal data.

Validated values are permuted inside their own format by a keyed Feistel network, so the same value gets the same
pseudonym in every document, different values get different ones, and a pseudonym is again a valid value of its
format: payment cards (Luhn), IBANs (mod 97), phone numbers, IPv4 addresses, social security numbers, calendar dates,
e-mail local parts and credential strings. The permutation works on the rank of a value among all values of its
format: a balanced Feistel network over the next even number of bits, walked until the rank is inside the format
again. Numbers that fail validation (a wrong check digit, an octet over 255, day 31 of April) stay as they are.

Supported formats:
- phone numbers: ``+``, an assigned country code and 8 to 15 digits in all, in any grouping by single spaces, dots, dashes or
  brackets; a number of the North American plan also as (415) 555-0123, 415-555-0123 or 415.555.0123. Numbers of +1 or with dashes
  that the plan does not allow are permuted among each other, so none stays in clear and a valid number gives a valid one.
- dates from 1900 to 2099: yyyy-mm-dd, d.m.yyyy, m/d/yyyy, and d/m/yyyy where the day is over 12. Digits of day and month keep their number.
- e-mail local parts and credentials: letters and digits are permuted within their kind (a-z, A-Z, 0-9, Latin-1 letters) at each place.
  Credentials are AWS key ids (AKIA, ASIA) and values of eight characters or more after token, secret, password,
  passwd or api_key with ``=`` or ``:``.

Defined cases: null text stays null, empty text empty; repeated rows are masked alike; a value touching letters or
digits on either side is no value; null doc_ids and other columns pass through; an empty table gives no rows.
"""

from __future__ import annotations

import calendar
import hashlib
import re
from bisect import bisect_left, bisect_right
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ROUNDS = 10
KINDS = ["card", "iban", "phone", "ip", "ssn", "date", "email", "secret"]

_FIND = re.compile(
    r"(?P<email>(?<![\w.+-])[A-Za-z0-9][\w.+-]{0,63}@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})"
    r"|(?P<secret>(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|(?i:\b(?:token|secret|password|passwd|api_?key)\b)[ ]?[=:][ ]?[\"']?(?P<value>[A-Za-z0-9_/+-]{8,}))"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}[A-Z0-9]{11,30}(?![A-Za-z0-9]))"
    r"|(?P<phone>(?<![\w+])(?:\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}|\+[2-9](?:(?:[ .-]| ?\(|\)[ -]?)?\d){7,14})(?!\d))"
    r"|(?P<national>(?<![\w+(.-])(?:\(\d{3}\) ?\d{3}[.-]\d{4}|\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4})(?![\w-]|\.\d))"
    r"|(?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d))"
    r"|(?P<date>(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?![\d/-]|\.\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-]))"
)
#: Some of it is in every match of _FIND: a text without any is passed on unread.
_WORTH = re.compile(r"\d[ ().-]{0,2}\d|@|AKIA|ASIA|(?i:password|passwd|token|secret|api_?key)")


class Feistel:
    """Keyed permutations of 0 .. size-1, one for each (kind, size)."""

    def __init__(self, key: bytes):
        self.key = key

    def permute(self, kind: str, rank: int, size: int) -> int:
        if size <= 1:
            return rank
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        width = (half + 7) // 8
        x = rank
        while True:
            left, right = x >> half, x & mask
            for r in range(ROUNDS):
                data = f"{kind}/{size:x}/{r}/".encode() + right.to_bytes(width, "big")
                if width <= 64:
                    digest = hashlib.blake2b(data, key=self.key, digest_size=width).digest()
                else:  # as many digest bytes as the half has
                    digest = hashlib.shake_256(hashlib.blake2b(data, key=self.key).digest()).digest(width)
                f = int.from_bytes(digest, "big")
                left, right = right, left ^ (f & mask)
            x = left << half | right
            if x < size:
                return x


def luhn(digits: str) -> int:
    """The digit that completes the digits to a Luhn-valid number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 if i % 2 else 2)
        total += d - 9 if d > 9 else d
    return -total % 10


#: Kinds of characters that are permuted among themselves: each is a run of code points without its gaps.
_KINDS = [[chr(c) for c in range(low, high + 1) if c not in (0xD7, 0xF7)] for low, high in ((48, 57), (97, 122), (65, 90), (0xE0, 0xFF), (0xC0, 0xDE))]
_KIND = {c: (k, i) for k in _KINDS for i, c in enumerate(k)}


def _mixed(chars: str) -> tuple[int, int]:
    """Rank and size of a string among the strings with characters of the same kinds at the same places. Halved, so long ones stay cheap."""
    if len(chars) > 64:
        half = len(chars) // 2
        (a, m), (b, n) = _mixed(chars[:half]), _mixed(chars[half:])
        return a * n + b, m * n
    rank, size = 0, 1
    for c in chars:
        if c in _KIND:
            kind, i = _KIND[c]
            rank, size = rank * len(kind) + i, size * len(kind)
    return rank, size


def _unmixed(rank: int, like: str) -> str:
    if len(like) > 64:
        half = len(like) // 2
        a, b = divmod(rank, _mixed(like[half:])[1])
        return _unmixed(a, like[:half]) + _unmixed(b, like[half:])
    out = []
    for c in reversed(like):
        if c in _KIND:
            kind = _KIND[c][0]
            rank, i = divmod(rank, len(kind))
            c = kind[i]
        out.append(c)
    return "".join(reversed(out))


def _refill(digits: str, like: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in like)


_YEARS = range(1900, 2100)


class Dates:
    """Ranks of the dates of a layout: those (month, day) pairs that ``fits`` accepts, in all years."""

    def __init__(self, fits):
        self.pairs = {}
        for leap, year in ((False, 2001), (True, 2000)):
            self.pairs[leap] = [(m, d) for m in range(1, 13) for d in range(1, calendar.monthrange(year, m)[1] + 1) if fits(m, d)]
        self.starts = [0, *accumulate(len(self.pairs[calendar.isleap(y)]) for y in _YEARS)]
        self.size = self.starts[-1]

    def rank(self, y: int, m: int, d: int) -> int:
        return self.starts[y - _YEARS[0]] + bisect_left(self.pairs[calendar.isleap(y)], (m, d))

    def date(self, rank: int) -> tuple[int, int, int]:
        at = bisect_right(self.starts, rank) - 1
        return (_YEARS[at], *self.pairs[calendar.isleap(_YEARS[at])][rank - self.starts[at]])


@lru_cache(maxsize=64)
def _dates(wide_month: bool, wide_day: bool, late: bool) -> Dates:
    """A place of one digit holds 1 to 9, one of two digits any number; ``late`` has days over 12 only."""
    return Dates(lambda m, d: (wide_month or m < 10) and (wide_day or d < 10) and (d > 12 or not late))


def _allowed(tail: str) -> bool:
    """Whether ten digits can be a number of the North American plan."""
    return tail[0] > "1" and tail[3] > "1" and tail[1:3] != "11" and tail[4:6] != "11"


#: Area and exchange codes of that plan: the first digit is 2 to 9, the others are not both 1.
_CODES = [f"{c}" for c in range(200, 1000) if c % 100 != 11]


def _code_length(digits: str) -> int:
    """Digits of the country code; 0 if none is assigned. The codes of one and two digits; the others have three."""
    if digits[0] in "17":
        return 1
    if digits[:2] in "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split():
        return 2
    return 0 if digits[0] == "0" else 3


class Masker:
    def __init__(self, key: bytes):
        self.key = key
        self.f = Feistel(key)
        self.one = lru_cache(maxsize=100_000)(self._one)

    def _letters(self, kind: str, value: str) -> str:
        return _unmixed(self.f.permute(kind, *_mixed(value)), value)

    def _plan(self, tail: str) -> str:
        """Ten digits of the North American plan; those that it does not allow are permuted among themselves."""
        if not _allowed(tail):
            rank = int(tail)
            while True:
                rank = self.f.permute("phone-", rank, 10**10)
                if not _allowed(f"{rank:010d}"):
                    return f"{rank:010d}"
        n = len(_CODES)
        rank = (bisect_left(_CODES, tail[:3]) * n + bisect_left(_CODES, tail[3:6])) * 10_000 + int(tail[6:])
        rank, line = divmod(self.f.permute("phone1", rank, n * n * 10_000), 10_000)
        return f"{_CODES[rank // n]}{_CODES[rank % n]}{line:04d}"

    def _date(self, value: str) -> str | None:
        parts = re.split(r"(\D)", value)
        numbers = [int(x) for x in parts[::2]]
        if parts[1] == "-":
            order = (0, 1, 2)
        elif parts[1] == ".":
            order = (2, 1, 0)
        else:
            order = (2, 1, 0) if numbers[0] > 12 else (2, 0, 1)
        y, m, d = (numbers[i] for i in order)
        if y not in _YEARS or not 1 <= m <= 12 or not 1 <= d <= calendar.monthrange(y, m)[1]:
            return None
        late = parts[1] == "/" and order == (2, 1, 0)
        all_of = _dates(len(parts[2 * order[1]]) == 2, len(parts[2 * order[2]]) == 2, late)
        kind = f"date{parts[1]}{order}{len(parts[0])}{len(parts[2])}"
        new = all_of.date(self.f.permute(kind, all_of.rank(y, m, d), all_of.size))
        for i, x in zip(order, new):
            parts[2 * i] = f"{x:0{len(parts[2 * i])}d}"
        return "".join(parts)

    def _one(self, kind: str, value: str) -> str | None:
        """The pseudonym, or None if the value is not valid in its format."""
        digits = re.sub(r"\D", "", value)
        if kind == "card":
            if luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
                return None
            rank, n = int(digits[:-1]), len(digits) - 1
            while True:
                rank = self.f.permute(kind, rank, 10**n)
                whole = f"{rank:0{n}d}{luhn(f'{rank:0{n}d}')}"
                if len(set(whole)) > 1:
                    return _refill(whole, value)
        if kind == "iban":
            number = lambda s: int("".join(str(int(c, 36)) for c in s))
            if number(value[4:] + value[:4]) % 97 != 1:
                return None
            body = self._letters(kind, value[4:])
            return f"{value[:2]}{98 - number(body + value[:2] + '00') % 97:02d}{body}"
        if kind == "national":
            return _refill(self._plan(digits), value) if _allowed(digits) or "-" in value else None
        if kind == "phone":
            n = _code_length(digits)
            if not n:
                return None
            head, tail = digits[:n], digits[n:]
            return _refill(head + (self._plan(tail) if head == "1" else self._letters(kind + head, tail)), value)
        if kind == "ip":
            octets = [int(x) for x in value.split(".")]
            if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in value.split(".")):
                return None
            rank = self.f.permute(kind, int.from_bytes(bytes(octets), "big"), 1 << 32)
            return ".".join(map(str, rank.to_bytes(4, "big")))
        if kind == "ssn":
            a, g, s = int(digits[:3]), int(digits[3:5]), int(digits[5:])
            if a in (0, 666) or a >= 900 or not g or not s:
                return None
            rank = ((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + s - 1
            rank = self.f.permute(kind, rank, 898 * 99 * 9999)
            a, rest = divmod(rank, 99 * 9999)
            return f"{a + 1 + (a >= 665):03d}-{rest // 9999 + 1:02d}-{rest % 9999 + 1:04d}"
        if kind == "date":
            return self._date(value)
        if kind == "email":
            local, _, domain = value.partition("@")
            return f"{self._letters(kind, local)}@{domain}"
        keep = 4 if value[:4] in ("AKIA", "ASIA") and len(value) == 20 else 0
        return value[:keep] + self._letters(kind, value[keep:])

    def mask(self, text: str | None) -> tuple[str | None, list[int]]:
        found = [0] * len(KINDS)
        if not text or not _WORTH.search(text):
            return text, found

        def swap(m: re.Match) -> str:
            kind = m.lastgroup if m.lastgroup != "value" else "secret"
            whole = m.group()
            value = m.group("value") if kind == "secret" and m.group("value") else whole
            new = self.one(kind, value) if len(value) <= 64 else self._one(kind, value)
            if new is None:
                return whole
            found[KINDS.index("phone" if kind == "national" else kind)] += 1
            at = m.start("value") - m.start() if value is not whole and kind == "secret" else 0
            return whole[:at] + new + whole[at + len(value) :]

        return _FIND.sub(swap, text), found


_MASKERS: dict = {}


def masker(key: bytes) -> Masker:
    if key not in _MASKERS:
        _MASKERS[key] = Masker(key)
    return _MASKERS[key]


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text with pseudonyms, and the number of masked values of each kind, of every row."""

    def run(batches):
        own = masker(key)
        for b in common.parts(batches, 1):
            done = [own.mask(t) for t in b.column(1).to_pylist()]
            counts = [pa.array([x[1][i] for x in done], pa.int64()) for i in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in done], pa.string()), *counts], ["doc_id", "text", *(f"n_{k}" for k in KINDS)])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(common.tidy(run), "doc_id long, text string, " + ", ".join(f"n_{k} long" for k in KINDS))


def mask_texts(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with its texts pseudonymised, all other columns unchanged."""
    at = docs.columns.index("text")

    def run(batches):
        own = masker(key)
        for b in common.parts(batches, at):
            texts = pa.array([own.mask(t)[0] for t in b.column(at).to_pylist()], b.schema.field(at).type)
            yield b.set_column(at, b.schema.field(at), texts)

    return docs.mapInArrow(common.tidy(run), docs.schema)
