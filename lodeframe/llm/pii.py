"""Format-preserving pseudonyms of personal numbers, dates and addresses.

A value is found by its pattern, validated (Luhn for cards, modulo 97 for IBANs, ranges for SSNs, calendar for dates, octets for
IPv4), numbered within the set of all valid values of its format, and moved by a keyed permutation of that set: an
alternating Feistel network over Z_a x Z_b with cycle walking. Equal values get equal pseudonyms in all documents, whatever the
order of a date's fields or a phone number's punctuation; with the key, ``restore`` turns them back. Separators, letter case,
lengths and check digits stay as the format wants them. Numbers that fail validation aren't personal data and stay as they
are, as does all other text.

Days up to the 12th of a month are permuted among themselves, and later ones too, so that a date keeps how it reads. A phone
number's area and exchange codes begin with 2 to 9 if they did before, else with 0 or 1, as they did.

The key is a secret. ``apply`` takes it as given, or from the session's ``spark.lodeframe.pseudonym.key``; without either, each
application draws its own at random, and its pseudonyms can be neither restored nor linked with those of another.

Defined results: a null text stays null with no replacements; repeated rows give equal results; an empty table gives an empty
result; input columns named like the added ones are replaced. A permutation of a small set can leave a value as it is, and
the local part of an address may have so few forms: one letter has 26, punctuation alone has one and always stays. Cards have
10**12 and more, phones 4 * 10**8, SSNs 8.9 * 10**8, addresses 2**32, dates 28,800 (up to the 12th) and 44,249.
"""

from __future__ import annotations

import hashlib
import re
import secrets
from collections.abc import Callable, Iterator
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StringType, StructField, StructType

ROUNDS = 10
KEY = "spark.lodeframe.pseudonym.key"


class Feistel:
    """Keyed permutations of range(size), for any size."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: bytes, i: int, half: int) -> int:
        data = b"%b|%d|%d" % (tweak, i, half)
        return int.from_bytes(hashlib.blake2b(data, digest_size=24, key=self.key).digest(), "big")

    @staticmethod
    def _sides(size: int) -> tuple[int, int]:
        from math import isqrt

        a = isqrt(size - 1) + 1
        return a, -(-size // a)

    def permute(self, n: int, size: int, tweak: bytes) -> int:
        if size < 2:
            return n
        a, b = self._sides(size)
        while True:
            left, right = divmod(n, b)
            for i in range(ROUNDS):
                if i % 2:
                    right = (right + self._round(tweak, i, left)) % b
                else:
                    left = (left + self._round(tweak, i, right)) % a
            n = left * b + right
            if n < size:
                return n

    def invert(self, n: int, size: int, tweak: bytes) -> int:
        if size < 2:
            return n
        a, b = self._sides(size)
        while True:
            left, right = divmod(n, b)
            for i in reversed(range(ROUNDS)):
                if i % 2:
                    right = (right - self._round(tweak, i, left)) % b
                else:
                    left = (left - self._round(tweak, i, right)) % a
            n = left * b + right
            if n < size:
                return n


Move = Callable[[int, int, bytes], int]


def _refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def luhn_digit(payload: str) -> int:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return -total % 10


def _card(found: str, move: Move) -> str | None:
    digits = re.sub(r"\D", "", found)
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != int(digits[-1]):
        return None
    size = len(digits) - 1
    payload = str(move(int(digits[:-1]), 10**size, b"card%d" % size)).zfill(size)
    return _refill(found, payload + str(luhn_digit(payload)))


def _phone(found: str, move: Move) -> str | None:
    digits = re.sub(r"\D", "", found)
    country, own = digits[:-10], digits[-10:]
    # The first digits of area and exchange stay within 2 to 9, or within 0 and 1.
    first = [(int(own[i]) - 2, 8, 2) if own[i] > "1" else (int(own[i]), 2, 0) for i in (0, 3)]
    n, size = 0, 1
    for value, radix in ((first[0][0], first[0][1]), (int(own[1:3]), 100), (first[1][0], first[1][1]), (int(own[4:]), 10**6)):
        n, size = n * radix + value, size * radix
    n = move(n, size, b"phone%d%d" % (first[0][2], first[1][2]))
    n, rest = divmod(n, 10**6)
    n, exchange = divmod(n, first[1][1])
    area, tail = divmod(n, 100)
    return _refill(found, f"{country}{area + first[0][2]}{tail:02d}{exchange + first[1][2]}{rest:06d}")


def _ssn(found: str, move: Move) -> str | None:
    area, group, serial = int(found[:3]), int(found[4:6]), int(found[7:])
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    n = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    rest, serial = divmod(move(n, 898 * 99 * 9999, b"ssn"), 9999)
    area, group = divmod(rest, 99)
    return f"{area + 1 + (area >= 665):03d}{found[3]}{group + 1:02d}{found[6]}{serial + 1:04d}"


def _ip(found: str, move: Move) -> str | None:
    octets = [int(x) for x in found.split(".")]
    if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in found.split(".")):
        return None
    n = move(int.from_bytes(bytes(octets), "big"), 1 << 32, b"ip")
    return ".".join(map(str, n.to_bytes(4, "big")))


_FIRST, _LAST = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()


_days: tuple[list[date], list[date], dict[date, int]] | None = None


def _calendar() -> tuple[list[date], list[date], dict[date, int]]:
    """The days up to the 12th of all months, the later ones, and each day's place in its list."""
    global _days
    if _days is None:
        every = [date.fromordinal(x) for x in range(_FIRST, _LAST + 1)]
        early, late = [x for x in every if x.day <= 12], [x for x in every if x.day > 12]
        _days = (early, late, {x: i for days in (early, late) for i, x in enumerate(days)})
    return _days


def _date(found: str, move: Move) -> str | None:
    """Year first, or day first where that is a date, else month first, as only days from the 13th on can be told to be."""
    parts = re.split(r"\D", found)
    mark = found[len(parts[0])]
    for order in [(0, 1, 2)] if len(parts[0]) == 4 else [(2, 1, 0), (2, 0, 1)]:
        try:
            day = date(*(int(parts[i]) for i in order))
        except ValueError:
            continue
        break
    else:
        return None
    early, late, places = _calendar()
    if day not in places:
        return None
    days = early if day.day <= 12 else late
    moved = days[move(places[day], len(days), b"date%d" % len(days))]
    fields = (f"{moved.year:04d}", f"{moved.month:02d}", f"{moved.day:02d}")
    return mark.join(fields[order.index(i)] for i in range(3))


def _mixed(text: str) -> tuple[int, int, list[int]]:
    """The number of ``text`` among all texts of its letter cases and digits, how many those are, and each place's radix."""
    n, size, radix = 0, 1, []
    for c in text:
        r, v = (10, ord(c) - 48) if "0" <= c <= "9" else (26, ord(c) - 97) if "a" <= c <= "z" else (26, ord(c) - 65) if "A" <= c <= "Z" else (1, 0)
        n, size = n * r + v, size * r
        radix.append(r)
    return n, size, radix


def _move_mixed(text: str, move: Move, kind: bytes) -> str:
    n, size, radix = _mixed(text)
    shape = "".join("9" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c for c in text)
    n = move(n, size, kind + shape.encode())
    out = []
    for c, r in zip(reversed(text), reversed(radix), strict=True):
        n, v = divmod(n, r)
        out.append(c if r == 1 else chr(v + (48 if r == 10 else 97 if c >= "a" else 65)))
    return "".join(reversed(out))


def _email(found: str, move: Move) -> str | None:
    local, _, host = found.partition("@")
    return f"{_move_mixed(local, move, b'email')}@{host}"


def _iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _iban(found: str, move: Move) -> str | None:
    text = found.replace(" ", "")
    if not 15 <= len(text) <= 34 or _iban_rest(text) != 1:
        return None
    own = _move_mixed(text[4:], move, b"iban" + text[:2].encode())
    moved = f"{text[:2]}{98 - _iban_rest(text[:2] + '00' + own):02d}{own}"
    it = iter(moved)
    return "".join(c if c == " " else next(it) for c in found)


_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NUMBER = re.compile(
    r"(?<![A-Za-z0-9_.@-])(?:"
    r"(?P<date>[0-9]{4}([-/.])[0-9]{2}\2[0-9]{2}|[0-9]{2}([-/.])[0-9]{2}\3[0-9]{4})"
    r"|(?P<ip>[0-9]{1,3}(?:\.[0-9]{1,3}){3})"
    r"|(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})"
    r"|(?P<phone>(?:\+?[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|\+[0-9]{11,13})"
    r"|(?P<card>[0-9](?:[ -]?[0-9]){12,18})"
    r")(?![A-Za-z0-9_@]|[.-][0-9])"
)
_DIGIT = re.compile(r"[0-9]")
_BY_KIND = {"date": _date, "ip": _ip, "ssn": _ssn, "phone": _phone, "card": _card}


_RUN = re.compile(r"[0-9](?:[ -]?[0-9])*")
_GROUP = re.compile(r"[0-9]+")
_AFTER = re.compile(r"[A-Za-z_@]|[.][0-9]")


def _shorter(text: str, start: int) -> tuple[int, list[tuple[int, int]]]:
    """The end of the run of digit groups from ``start`` on, and the spans of its groups that may be a card."""
    end = _RUN.match(text, start).end()
    groups = [x.span() for x in _GROUP.finditer(text, start, end)]
    if _AFTER.match(text, end):
        groups.pop()
    found = []
    for i in range(len(groups)):
        digits = 0
        for a, b in groups[i:]:
            digits += b - a
            if digits > 19:
                break
            if digits >= 13:
                found.append((groups[i][0], b))
    return end, found


def _rewrite(text: str, move: Move) -> tuple[str, int]:
    count = 0

    def replace(found: re.Match, by: Callable[[str, Move], str | None]) -> str:
        nonlocal count
        new = by(found[0], move)
        count += new is not None
        return found[0] if new is None else new

    if not _DIGIT.search(text) and "@" not in text:
        return text, 0
    # Pieces in turn: what an earlier kind has taken is out of reach of the later ones.
    spans: list[tuple[int, int, Callable]] = []
    if "@" in text:
        spans += [(*x.span(), _email) for x in _EMAIL.finditer(text)]
    spans += [(*x.span(), _iban) for x in _IBAN.finditer(text)]
    run = 0
    for x in _NUMBER.finditer(text):
        spans.append((*x.span(), _BY_KIND[x.lastgroup]))
        if x.lastgroup == "card" and x.start() >= run and _card(x[0], move) is None:
            # A short number beside a card: the card may be some of the groups.
            run, shorter = _shorter(text, x.start())
            spans += [(*span, _card) for span in shorter]
    spans.sort(key=lambda x: (x[0], -x[1]))
    out, at = [], 0
    for start, end, by in spans:
        if start < at:
            continue
        new = by(text[start:end], move)
        if new is None:
            continue
        out += [text[at:start], new]
        at, count = end, count + 1
    return ("".join([*out, text[at:]]), count) if count else (text, 0)


def pseudonymise(text: str, key: bytes) -> tuple[str, int]:
    """The text with pseudonyms, and how many."""
    return _rewrite(text, Feistel(key).permute)


def restore(text: str, key: bytes) -> str:
    """The text that ``pseudonymise`` had, given its key."""
    return _rewrite(text, Feistel(key).invert)[0]


_own_keys: dict[str, bytes] = {}


def session_key(spark: SparkSession) -> bytes:
    """The session's key, or one drawn at random for the application."""
    found = spark.conf.get(KEY, None)
    if found:
        return found.encode()
    return _own_keys.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


def apply(df: DataFrame, key: bytes | None = None, text: str = "text", count: str | None = "n_replaced") -> DataFrame:
    """``df`` with pseudonyms in its text column and, unless ``count`` is None, the number of them after its own columns.

    Without ``key`` it is the session's."""
    key = key or session_key(df.sparkSession)
    kept = df.drop(count) if count else df

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        move = Feistel(key).permute
        for batch in source:
            at = batch.schema.names.index(text)
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                found = [(None, 0) if x is None else _rewrite(x, move) for x in part.column(at).to_pylist()]
                columns = list(part.columns)
                columns[at] = pa.array([x[0] for x in found], pa.string())
                counts = [pa.array([x[1] for x in found], pa.int64())] if count else []
                yield pa.RecordBatch.from_arrays([*columns, *counts], [*part.schema.names, *[count] * len(counts)])

    fields = [StructField(x.name, StringType()) if x.name == text else x for x in kept.schema.fields]
    return kept.mapInArrow(batches, StructType([*fields, StructField(count, LongType())] if count else fields))


def pii_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
