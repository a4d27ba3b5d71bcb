"""Format-preserving pseudonyms for personal data by keyed Feistel permutations.

Numbers and dates that pass their check (Luhn, mod 97, octet and calendar ranges) and e-mail
addresses are read as integers of the set of all values with their format and permuted in that
set by a key.  Equal values get equal pseudonyms in every document, a pseudonym passes the same
check and has the same length, and nobody without the key can go back.

A Feistel network E permutes the next even power of two and walks its cycle back into the set.
The pseudonym of x is D(E(x) + 1 mod n), with D the inverse of E: still a keyed permutation, and
one without fixed points, so no value stands for itself.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fitkit.llm.common import map_rows, set_aside

ROUNDS = 8
#: The key of runs that set none; a session sets its own by :data:`KEY_SETTING`.
KEY = b"replace this key in production"
KEY_SETTING = "spark.fitkit.pseudonym.key"


def key_of(spark: SparkSession) -> bytes:
    """The key that the session sets, else the open one."""
    named = spark.conf.get(KEY_SETTING, "")
    return named.encode() if named else KEY


class Permutation:
    """A keyed permutation of 0 .. n-1 for n >= 2."""

    def __init__(self, key: bytes, tweak: str, n: int):
        self.n = n
        self.half = max(1, ((n - 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        self.size = (self.half + 7) // 8
        salt = hashlib.blake2b(f"{tweak}/{n}".encode(), key=key[:64], digest_size=32).digest()
        self.keys = [salt + bytes([r]) for r in range(ROUNDS)]

    def _round(self, r: int, x: int) -> int:
        out, block = b"", 0
        while len(out) < self.size:
            part = x.to_bytes(self.size, "big") + block.to_bytes(2, "big")
            out += hashlib.blake2b(part, key=self.keys[r], digest_size=min(64, self.size)).digest()
            block += 1
        return int.from_bytes(out[: self.size], "big") & self.mask

    def _network(self, x: int, order: range) -> int:
        left, right = x >> self.half, x & self.mask
        for r in order:
            left, right = right, left ^ self._round(r, right)
        return right << self.half | left

    def walk(self, x: int, back: bool = False) -> int:
        """E (or D) of x: the network is applied until the value lies in the set again."""
        order = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
        while True:
            x = self._network(x, order)
            if x < self.n:
                return x

    def hide(self, x: int) -> int:
        return self.walk((self.walk(x) + 1) % self.n, back=True)

    def reveal(self, x: int) -> int:
        return self.walk((self.walk(x) - 1) % self.n, back=True)


def permuted(key: bytes, tweak: str, digits: list[tuple[int, int]], back: bool) -> list[int]:
    """Permute a mixed-radix number given as (digit, radix); radixes of 1 don't count."""
    n = x = 0
    n = 1
    for d, radix in digits:
        x = x * radix + d
        n *= radix
    if n < 2:
        return [d for d, _ in digits]
    p = _permutation(key, tweak, n)
    x = p.reveal(x) if back else p.hide(x)
    out = []
    for _, radix in reversed(digits):
        x, d = divmod(x, radix)
        out.append(d)
    return out[::-1]


@lru_cache(maxsize=4096)
def _permutation(key: bytes, tweak: str, n: int) -> Permutation:
    return Permutation(key, tweak, n)


# --- kinds -----------------------------------------------------------------------------

_LOWER, _UPPER, _DIGIT = (
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "0123456789",
)
_LATIN = "".join(chr(c) for c in range(0xDF, 0x100) if chr(c).isalpha())


def _refill(text: str, key: bytes, tweak: str, back: bool, alphabets: tuple[str, ...]) -> str:
    """Permute the characters of the alphabets and keep all others where they are."""
    which = [next((a for a in alphabets if c in a), None) for c in text]
    digits = [(a.index(c), len(a)) for c, a in zip(text, which) if a]
    new = iter(permuted(key, f"{tweak}/{len(text)}", digits, back))
    return "".join(a[next(new)] if a else c for c, a in zip(text, which))


def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 - i % 2)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _put_digits(shape: str, digits: str) -> str:
    new = iter(digits)
    return "".join(next(new) if c in _DIGIT else c for c in shape)


def _card(m: str, key: bytes, back: bool) -> str | None:
    digits = re.sub("[^0-9]", "", m)
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    payload = digits
    while True:  # numbers of one repeated digit are no cards, so they are walked over
        payload = _refill(payload[:-1], key, "card", back, (_DIGIT,))
        payload += luhn_digit(payload)
        if len(set(payload)) > 1:
            return _put_digits(m, payload)


def _phone(m: str, key: bytes, back: bool) -> str | None:
    country = re.match(r"\+[0-9]{1,3}(?=[^0-9])|1(?=[ .-])", m)
    head = country.group(0) if country else ""
    rest = m[len(head) :]
    digits = re.sub("[^0-9]", "", rest)
    if not 6 <= len(digits) <= 14:
        return None
    # Digits alone decide, so one number has one pseudonym in every notation.
    return head + _put_digits(rest, _refill(digits, key, "phone", back, (_DIGIT,)))


def _ip(m: str, key: bytes, back: bool) -> str | None:
    parts = m.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    low = {1: 0, 2: 10, 3: 100}
    size = {1: 10, 2: 90, 3: 156}
    digits = [(int(p) - low[len(p)], size[len(p)]) for p in parts]
    tweak = "ip/" + ".".join(str(len(p)) for p in parts)
    new = permuted(key, tweak, digits, back)
    return ".".join(str(d + low[len(p)]) for d, p in zip(new, parts))


def _ssn(m: str, key: bytes, back: bool) -> str | None:
    area, group, serial = (int(x) for x in m.split("-"))
    if not (0 < area < 900 and area != 666 and group and serial):
        return None
    digits = [(area - 1 - (area > 666), 898), (group - 1, 99), (serial - 1, 9999)]
    a, g, s = permuted(key, "ssn", digits, back)
    a += 1
    return f"{a + (a >= 666):03d}-{g + 1:02d}-{s + 1:04d}"


def _day(parts: list[str], order: str) -> dt.date | None:
    """The date of digits in an order of d, m and y; two digits are a year from 1970 to 2069."""
    at = dict(zip(order, parts))
    year = int(at["y"])
    if len(at["y"]) == 2:
        year += 1900 if year >= 70 else 2000
    try:
        day = dt.date(year, int(at["m"]), int(at["d"]))
    except ValueError:
        return None
    return day if day.year >= 1000 else None


def _order(parts: list[str]) -> str | None:
    """Month before day only where day before month is no date."""
    orders = ("ymd",) if len(parts[0]) == 4 else ("dmy", "mdy")
    return next((o for o in orders if _day(parts, o)), None)


def _moved(day: dt.date, key: bytes, back: bool, short: bool) -> dt.date:
    """Dates move within 1900 to 2099 (1970 to 2069 for short years), other years within 1000 to 9999."""
    if short or 1900 <= day.year < 2100:
        first, end, tweak = (1970, 2070, "short date") if short else (1900, 2100, "date")
        first, n = dt.date(first, 1, 1), dt.date(end, 1, 1) - dt.date(first, 1, 1)
        return first + dt.timedelta(permuted(key, tweak, [((day - first).days, n.days)], back)[0])
    first, gap = dt.date(1000, 1, 1), dt.date(1900, 1, 1)
    skip = (dt.date(2100, 1, 1) - gap).days
    n = (dt.date(9999, 12, 31) - first).days + 1 - skip
    x = (day - first).days - (skip if day > gap else 0)
    new = permuted(key, "old date", [(x, n)], back)[0]
    return first + dt.timedelta(new + (skip if new >= (gap - first).days else 0))


def _date(m: str, key: bytes, back: bool) -> str | None:
    """Notation and order stay: dates with other lengths or read in another order are walked over."""
    parts = re.findall("[0-9]+", m)
    order = _order(parts)
    if order is None:
        return None
    sizes = [len(x) for x in parts]
    day = _day(parts, order)
    while True:
        day = _moved(day, key, back, sizes[order.index("y")] == 2)
        at = {"d": day.day, "m": day.month, "y": day.year}
        new = [f"{at[o] % 100 if o == 'y' and n == 2 else at[o]:0{n}d}" for o, n in zip(order, sizes)]
        if [len(x) for x in new] == sizes and _order(new) == order:
            return _put_digits(m, "".join(new))


# Lengths of IBANs by country.
_IBAN_LENGTHS = dict(
    (x[:2], int(x[2:]))
    for x in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 "
        "ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 "
        "LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 "
        "PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
    ).split()
)


def _iban_holds(m: str) -> bool:
    plain = m.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _iban_head(m: str) -> str | None:
    """The beginning of a match that has the length of its country: a word or number may follow an IBAN."""
    ends = [k.start() for k in re.finditer(" ", m)]
    head = next((m[:k] for k in ends if len(m[:k].replace(" ", "")) == _IBAN_LENGTHS.get(m[:2])), None)
    return head if head and _iban_holds(head) else None


def _iban(m: str, key: bytes, back: bool) -> str | None:
    """Of a match that goes on behind the IBAN only the IBAN is replaced and given."""
    m = _iban_head(m) or m
    if not _iban_holds(m):
        return None
    while True:  # a pseudonym that would be read shorter is walked over
        plain = m.replace(" ", "")
        account = _refill(plain[4:], key, f"iban/{plain[:2]}", back, (_UPPER, _DIGIT))
        check = 98 - int("".join(str(int(c, 36)) for c in account + plain[:2] + "00")) % 97
        new = iter(f"{plain[:2]}{check:02d}{account}")
        m = "".join(" " if c == " " else next(new) for c in m)
        if _iban_head(m) is None:
            return m


def _email(m: str, key: bytes, back: bool) -> str | None:
    local, _, domain = m.rpartition("@")
    return _refill(local, key, f"email/{domain}", back, (_LOWER, _UPPER, _DIGIT, _LATIN)) + "@" + domain


KINDS: dict[str, tuple[str, Callable[[str, bytes, bool], str | None]]] = {
    "iban": (r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", _iban),
    "phone": (
        r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])"
        r"|(?<![0-9])\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9-])"
        r"|(?<![0-9+.-])(?:1[ .-])?[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4}(?![0-9-]|\.[0-9])",
        _phone,
    ),
    "ip": (r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])", _ip),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", _ssn),
    "date": (
        r"(?<![0-9-])[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}(?![0-9-])"
        r"|(?<![0-9/.])[0-9]{4}([/.])[0-9]{1,2}\1[0-9]{1,2}(?![0-9/]|\.[0-9])"
        r"|(?<![0-9/.])[0-9]{1,2}([/.])[0-9]{1,2}\2[0-9]{4}(?![0-9/])"
        r"|(?<![0-9/.])(?:[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{2})(?![0-9/]|\.[0-9])",
        _date,
    ),
    "card": (
        r"(?<![0-9+])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?:\1[0-9]{3})?"
        r"|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![0-9])",
        _card,
    ),
}
#: A dot, plus or hyphen may stand in a local part, but doesn't begin one.
EMAIL = r"(?<![\w.+-])[.+-]*([\w][\w.+-]{0,255}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24})"


def replace_all(text: str, key: bytes = KEY, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and the spans (kind, start, end) that were replaced.

    ``back`` undoes it.  Kinds are tried in order; a span belongs to the first that accepts it.
    """
    found: list[tuple[int, int, str, str]] = []
    taken = bytearray()

    def claim(kind: str, start: int, end: int, new: str | None) -> None:
        nonlocal taken
        if new is None:
            return
        if not taken:
            taken = bytearray(len(text))
        if not any(taken[start:end]):
            taken[start:end] = b"\x01" * (end - start)
            found.append((start, end, kind, new))

    if "@" in text:
        for m in re.finditer(EMAIL, text):
            claim("email", *m.span(1), _email(m.group(1), key, back))
    if re.search("[0-9]", text):
        for kind, (pattern, make) in _COMPILED.items():
            at = 0
            while m := pattern.search(text, at):
                new = make(m.group(0), key, back)
                start, at = m.span()
                if kind == "iban":  # the search goes on behind the accepted part
                    at = start + len(new or " ")
                claim(kind, start, start + len(new or ""), new)
    if not found:
        return text, []
    found.sort()
    out, at = [], 0
    for start, end, _, new in found:
        out += [text[at:start], new]
        at = end
    out.append(text[at:])
    return "".join(out), [(kind, start, end) for start, end, kind, _ in found]


_COMPILED = {kind: (re.compile(pattern), make) for kind, (pattern, make) in KINDS.items()}


def pseudonymise(
    docs: DataFrame, key: bytes = KEY, text_col: str = "text", back: bool = False
) -> DataFrame:
    """``docs`` with pseudonyms in the text, and ``pii``, the replaced spans (kind, start, end).

    Lengths and thus all offsets stay.  A null text stays null with no spans, an empty one empty.
    Rows, repeated ones too, and all other columns stay as they are; an input column named
    ``pii`` is replaced.  A text of any length is handled whole.
    """
    kept = [f for f in docs.schema if f.name != "pii"]
    span = T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
        ]
    )
    schema = T.StructType([*kept, T.StructField("pii", T.ArrayType(span))])

    def body():
        def kernel(batch):
            new, spans = [], []
            for t in batch.column(text_col).to_pylist():
                made, found = (None, []) if t is None else replace_all(t, key, back)
                new.append(made)
                spans.append([dict(zip(("kind", "start", "end"), s)) for s in found])
            out = {f.name: batch.column(f.name) for f in kept}
            return out | {text_col: new, "pii": spans}

        return kernel

    return map_rows(docs.select(*[F.col(f"`{f.name}`") for f in kept]), body, schema)


def without_pii(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """Pseudonymised documents with the columns of ``docs``, by the session's key if none is given."""
    key = key_of(docs.sparkSession) if key is None else key
    renamed, back = set_aside(docs, ("pii",))
    return back(pseudonymise(renamed, key))
