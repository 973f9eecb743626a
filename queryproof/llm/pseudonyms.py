"""Format-preserving pseudonyms for personal data: keyed Feistel permutations inside each format."""

from __future__ import annotations

import datetime as dt
import hashlib
import ipaddress
import re
from bisect import bisect_left
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queryproof.llm.common import map_batches, ship, with_fields

ship(__name__)

ROUNDS = 8
FIRST_DAY, DAYS = dt.date(1900, 1, 1).toordinal(), 73049  # to the end of 2099

#: Number formats, the higher rank first; a hit must still pass its validation below.
NUMBERS = {
    "ip": r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)",
    "date": r"(?<![\w./-])(?:\d{4}-\d{1,2}-\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?!\w|[./-]\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?!\w|-\d)",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w|[.-]\d)"
    r"|(?<![\w+(])\(\d{3}\) ?\d{3}-\d{4}(?!\w|-\d)"
    r"|(?<![\w.+-])(?:1[.-])?\d{3}(?:-\d{3}-|\.\d{3}\.)\d{4}(?!\w|[.-]\d)",
    "card": r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?!\w|[.-]\d)",
}
NUMBER = {kind: re.compile(pattern) for kind, pattern in NUMBERS.items()}
#: Digits that may hold a card, and how cards are grouped when they don't stand in one piece.
CARDS = re.compile(r"(?<![\w.+-])\d(?:[ -]?\d){12,}(?!\w|[.-]\d)")
SHAPES = {(4, 4, 4, 1), (4, 6, 4), (4, 6, 5), (4, 4, 4, 4), (4, 4, 4, 4, 3)}
GROUP = re.compile(r"\d+")
#: Where a number may stand: the expensive patterns are tried here only. No valid number is shorter than
#: the seven characters of 1.1.1.1.
DIGITS = re.compile(r"\d[\d ./()-]{5,}\d")
LOCAL = re.compile(r"[^\W_](?:[\w.+%-]{0,62}[^\W_])?$")
DOMAIN = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
TOKEN = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])")
#: Behind a colon, where prose may follow, a password must hold a digit.
SECRET = re.compile(
    r"(?<=AKIA)[A-Z0-9]{16}(?![A-Za-z0-9])|(?<=password=)[\w.+-]{6,64}"
    r"|(?:(?<=password: )|(?<=password:)|(?<=password = ))(?=[\w.+-]*\d)[\w.+-]{6,64}",
    re.ASCII,
)
SOMETHING = re.compile(r"[@\d]")


def places(text: str) -> list[tuple[int, int, str]]:
    """Where valid personal data stands: (start, end, kind), in order and without overlaps; of two that
    overlap the kind of higher rank stays, what fails its validation hides nothing."""
    if not SOMETHING.search(text):
        return []
    found: list[tuple[int, int, str]] = []
    at = text.find("@")
    while at >= 0:
        local, domain = LOCAL.search(text[max(0, at - 64) : at]), DOMAIN.match(text, at + 1)
        if local and domain:
            found.append((at - len(local[0]), domain.end(), "email"))
        at = text.find("@", at + 1)
    if "AKIA" in text or "password" in text:
        found += [(*m.span(), "secret") for m in SECRET.finditer(text)]
    found += [(*m.span(), "token") for m in TOKEN.finditer(text)]
    found += [(*m.span(), "iban") for m in IBAN.finditer(text)]
    rank = ["email", "secret", "token", "iban", *NUMBERS]
    ranked = [(rank.index(kind), a, b, kind) for a, b, kind in found if valid(kind, text[a:b])]
    failed: list[tuple[int, int]] = []
    for region in DIGITS.finditer(text):
        # a little more on both sides for signs, brackets and what must not follow
        start, end = max(0, region.start() - 6), min(len(text), region.end() + 2)
        for a, b in card_places(text, start, end):
            ranked.append((rank.index("card"), a, b, "card"))
        for kind, pattern in NUMBER.items():
            at = start
            while m := pattern.search(text, at, end):
                at = m.end()
                if valid(kind, m[0]):  # a card of any grouping comes after all else
                    ranked.append((rank.index(kind) + (kind == "card"), *m.span(), kind))
                elif kind != "card":
                    at = GROUP.search(text, m.start()).end()  # it may start within what failed
                    if kind == "phone":
                        failed.append(m.span())
    kept: list[tuple[int, int, str]] = []
    for _, a, b, kind in sorted(ranked):
        keep(kept, a, b, kind)
    for a, b in failed:  # a phone number beside other numbers: as many of its groups as are one
        for group in reversed([*GROUP.finditer(text, a, b)]):
            m = NUMBER["phone"].fullmatch(text, a, group.end())
            if m and valid("phone", m[0]) and keep(kept, a, group.end(), "phone"):
                break
    return kept


def keep(kept: list[tuple[int, int, str]], a: int, b: int, kind: str) -> bool:
    """Put the place into ``kept``, which is in order, unless it overlaps one that is there."""
    i = bisect_left(kept, (a,))
    if (i and kept[i - 1][1] > a) or (i < len(kept) and kept[i][0] < b):
        return False
    kept.insert(i, (a, b, kind))
    return True


def card_places(text: str, start: int = 0, end: int | None = None) -> list[tuple[int, int]]:
    """Valid cards in one piece or in the groups of cards, the shorter first at each place; what else
    stands before or after them in a row of digits does not matter."""
    out = []
    for row in CARDS.finditer(text, start, len(text) if end is None else end):
        groups = [m.span() for m in GROUP.finditer(text, *row.span())]
        done = row.start()
        for i, (a, _) in enumerate(groups):
            for j in range(i, min(i + 5, len(groups))):
                sizes = tuple(y - x for x, y in groups[i : j + 1])
                b = groups[j][1]
                if a >= done and (sizes in SHAPES or (i == j and 13 <= sizes[0] <= 19)) and valid("card", text[a:b]):
                    out.append((a, b))
                    done = b
                    break
    return out


@lru_cache(1 << 16)
def permute(value: int, size: int, tweak: str, key: bytes, back: bool = False) -> int:
    """A keyed permutation of ``range(size)`` that leaves no value where it is; ``back`` inverts it.

    The values stand in a circle in the order of the Feistel network's images, and each goes to the next: all of
    ``range(size)`` is one cycle. So whoever walks on to a value of some kind comes back to the first one only
    if there is no other.
    """
    place = feistel(value, size, tweak, key)
    return feistel((place + (-1 if back else 1)) % size, size, tweak, key, True)


def feistel(value: int, size: int, tweak: str, key: bytes, back: bool = False) -> int:
    """A balanced Feistel network over the next even number of bits, walked until the result lies inside."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    length = (half + 7) // 8
    base = hashlib.blake2b(f"{tweak}/{size}/".encode(), key=key[:64], digest_size=min(64, length + 8))
    rounds = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
    while True:
        left, right = value >> half, value & mask
        for r in rounds:
            turn = base.copy()
            turn.update(bytes([r]) + (left if back else right).to_bytes(length, "little"))
            digest = turn.digest()
            while len(digest) < length:
                digest += hashlib.blake2b(digest, key=key[:64]).digest()
            mixed = int.from_bytes(digest, "little") & mask
            left, right = (right ^ mixed, left) if back else (right, left ^ mixed)
        value = left << half | right
        if value < size:
            return value


def put_digits(text: str, digits: str) -> str:
    """``text`` with its digits replaced one by one."""
    new = iter(digits)
    return "".join(next(new) if "0" <= c <= "9" else c for c in text)


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn_digit(body: str) -> str:
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (1 if i % 2 else 2)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def valid_card(digits: str) -> bool:
    return len(digits) > 1 and luhn_digit(digits[:-1]) == digits[-1] and len(set(digits)) > 1


def swap_card(text: str, key: bytes, back: bool) -> str | None:
    digits = digits_of(text)
    if not valid_card(digits):
        return None
    body, read = digits[:-1], card_places(text)
    while True:  # one digit throughout is no card, so it can't come out either, nor what is read in other pieces
        body = str(permute(int(body), 10 ** len(body), "card", key, back)).zfill(len(body))
        new = body + luhn_digit(body)
        if len(set(new)) > 1 and card_places(put_digits(text, new)) == read:
            return put_digits(text, new)


def ip_number(text: str) -> int | None:
    try:
        return int(ipaddress.IPv4Address(text))
    except ValueError:
        return None


def swap_ip(text: str, key: bytes, back: bool) -> str | None:
    value = ip_number(text)
    if value is None:
        return None
    return str(ipaddress.IPv4Address(permute(value, 1 << 32, "ip", key, back)))


def ordinal(year: int, month: int, day: int) -> int | None:
    try:
        n = dt.date(year, month, day).toordinal() - FIRST_DAY
    except ValueError:
        return None
    return n if 0 <= n < DAYS else None


def read_date(text: str) -> tuple[int | None, str, bool]:
    """Its number, what divides its parts, and whether the month is in front."""
    mark = re.search(r"\D", text)[0]
    a, b, c = map(int, text.split(mark))
    n = ordinal(a, b, c) if mark == "-" else ordinal(c, b, a)
    if n is None and mark == "/":  # a date that can only be read with the month in front
        return ordinal(c, a, b), mark, True
    return n, mark, False


def swap_date(text: str, key: bytes, back: bool) -> str | None:
    n, mark, month_first = read_date(text)
    if n is None:
        return None
    padded = all(len(x) > 1 for x in text.split(mark))
    while True:  # what is written in another way than it is read back as is no result
        n = permute(n, DAYS, "date", key, back)
        day = dt.date.fromordinal(FIRST_DAY + n)
        if (day.day > 12 or not month_first) and (padded or min(day.day, day.month) < 10):
            break
    parts = [day.year, day.month, day.day] if mark == "-" else [day.day, day.month, day.year]
    if month_first:
        parts[:2] = parts[1::-1]
    return mark.join(f"{x:02d}" if padded else str(x) for x in parts)


def valid_ssn(n: int) -> bool:
    area, group, serial = n // 1_000_000, n // 10_000 % 100, n % 10_000
    return 0 < area < 900 and area != 666 and group > 0 and serial > 0


def swap_ssn(text: str, key: bytes, back: bool) -> str | None:
    n = int(digits_of(text))
    if not valid_ssn(n):
        return None
    while True:
        n = permute(n, 10**9, "ssn", key, back)
        if valid_ssn(n):
            return put_digits(text, f"{n:09d}")


def iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


def valid_iban(plain: str) -> bool:
    return iban_check(plain[:2], plain[4:]) == plain[2:4] and bool(digits_of(plain[4:]))


def swap_iban(text: str, key: bytes, back: bool) -> str | None:
    plain = text.replace(" ", "")
    if not valid_iban(plain):
        return None
    country, rest = plain[:2], plain[4:]
    numbers = digits_of(rest)
    n = permute(int(numbers), 10 ** len(numbers), f"iban{country}", key, back)
    rest = put_digits(rest, str(n).zfill(len(numbers)))
    new = iter(country + iban_check(country, rest) + rest)
    return "".join(c if c == " " else next(new) for c in text)


def swap_phone(text: str, key: bytes, back: bool) -> str | None:
    digits = digits_of(text)
    if not 10 <= len(digits) <= 15:
        return None
    kept = len(re.match(r"\+(\d*)", text)[1]) if text[0] == "+" else len(digits) - 10  # the country code stays
    if kept == len(digits):
        kept = 1
    own = digits[kept:]
    n = permute(int(own), 10 ** len(own), f"phone{digits[:kept]}", key, back)
    return put_digits(text, digits[:kept] + str(n).zfill(len(own)))


#: The alphabets within which a character of an address or token may change.
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: Letters of local parts besides: Latin with marks, Greek and Cyrillic, small and large.
LETTERS = ALPHABETS + tuple(
    "".join(c for c in map(chr, range(first, last)) if c.isalpha())
    for first, last in ((0xDF, 0x100), (0xC0, 0xDF), (0x3B1, 0x3CA), (0x391, 0x3AA), (0x430, 0x460), (0x400, 0x430))
)


def swap_chars(text: str, alphabets: tuple[str, ...], tweak: str, key: bytes, back: bool) -> str:
    """Permute all characters of the alphabets together as one number of mixed radix; others stay."""
    sets = [next((a for a in alphabets if c in a), None) for c in text]
    value, size = 0, 1
    for c, a in zip(text, sets, strict=True):
        if a:
            value, size = value * len(a) + a.index(c), size * len(a)
    if size == 1:
        return text
    shape = "".join(str(alphabets.index(a)) if a else c for c, a in zip(text, sets, strict=True))
    value = permute(value, size, f"{tweak}{shape}", key, back)
    out = []
    for c, a in zip(reversed(text), reversed(sets), strict=True):
        if a:
            value, i = divmod(value, len(a))
            c = a[i]
        out.append(c)
    return "".join(reversed(out))


def swap_email(text: str, key: bytes, back: bool) -> str | None:
    local, domain = text.rsplit("@", 1)
    new = swap_chars(local, LETTERS, "email@" + domain.lower(), key, back)
    return None if new == local else f"{new}@{domain}"


def valid_token(text: str) -> bool:
    return not text.isdigit() and any(c.isdigit() for c in text)


def swap_token(text: str, key: bytes, back: bool) -> str | None:
    if not valid_token(text):
        return None
    hexes = "0123456789abcdef" if text == text.lower() else "0123456789ABCDEF"
    while True:
        text = swap_chars(text, (hexes,), "token", key, back)
        if valid_token(text):
            return text


def swap_secret(text: str, key: bytes, back: bool) -> str | None:
    new = swap_chars(text, ALPHABETS, "secret", key, back)
    return None if new == text else new


VALID = {
    "ip": lambda text: ip_number(text) is not None,
    "date": lambda text: read_date(text)[0] is not None,
    "ssn": lambda text: len(digits_of(text)) == 9 and valid_ssn(int(digits_of(text))),
    "iban": lambda text: valid_iban(text.replace(" ", "")),
    "phone": lambda text: 10 <= len(digits_of(text)) <= 15,
    "card": lambda text: valid_card(digits_of(text)),
    "token": valid_token,
}


def valid(kind: str, text: str) -> bool:
    return kind not in VALID or VALID[kind](text)


SWAPS = {
    "email": swap_email,
    "secret": swap_secret,
    "ip": swap_ip,
    "date": swap_date,
    "ssn": swap_ssn,
    "iban": swap_iban,
    "phone": swap_phone,
    "card": swap_card,
    "token": swap_token,
}


def pseudonymize(text: str, key: bytes, back: bool = False) -> tuple[str, list[str]]:
    """The text with every validated value replaced, and the kinds replaced, in order."""
    kinds: list[str] = []
    out, done = [], 0
    for start, end, kind in places(text):
        new = SWAPS[kind](text[start:end], key, back)
        if new is not None:
            kinds.append(kind)
            out += [text[done:start], new]
            done = end
    return ("".join([*out, text[done:]]) if out else text), kinds


def pseudonymize_column(
    docs: DataFrame, key: bytes, column: str = "text", found: str | None = "kinds", back: bool = False
) -> DataFrame:
    """Replace validated personal data in whole texts; all columns of ``docs`` stay.

    Card numbers (Luhn), IBANs (mod 97), social security numbers, phone numbers, IPv4 addresses, dates
    from 1900 to 2099, e-mail addresses (their local part), hexadecimal tokens, and
    key and password values (behind ``AKIA``, ``password=``, and with a digit behind ``password:``) are each permuted
    within their format
    under ``key``, with check digits made anew: equal values get equal pseudonyms in every document, and
    ``back=True`` with the same key restores them. No value is its own pseudonym, so every kind listed is a change.
    What fails its validation stays as it is, and so do numbers written in other ways (social security
    numbers with blanks) and local parts without Latin, Greek or Cyrillic letters or digits. Cards are
    found beside other numbers if they stand in one piece or in the groups of cards. Where the groups of
    neighbouring numbers could be read as two overlapping values, the valid one is replaced; if by chance
    both readings of the pseudonym are valid, ``back`` may take the other one. ``found``
    names a column for the kinds replaced, in text order, or is None; a column of that name is replaced.
    Null texts stay null with no kinds. Each row stands alone: nothing is shuffled, and repeated rows,
    empty tables and other columns need no care.
    """
    names = [c for c in docs.columns if c != found]
    kept = docs.select(*(F.col(f"`{c}`") for c in names))
    schema = with_fields(kept.schema, f"`{found}` array<string>") if found else kept.schema

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = names.index(column)
        done = [(None, []) if t is None else pseudonymize(t, key, back) for t in batch.column(at).to_pylist()]
        columns = [batch.column(i) for i in range(len(names))]
        columns[at] = pa.array([t for t, _ in done], pa.string())
        if found:
            columns.append(pa.array([k for _, k in done], pa.list_(pa.string())))
        return pa.RecordBatch.from_arrays(columns, [*names, found] if found else names)

    return map_batches(kept, run, schema)
