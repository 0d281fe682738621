"""Format-preserving pseudonyms: validated personal values are permuted within their format.

A Feistel network keyed by a secret maps each value to another one of its format: digits stay digits,
separators stay, card numbers keep a right check digit, dates stay dates, addresses stay addresses.  It
is a permutation, so equal values get equal pseudonyms in every document and different values never
meet; whoever has the key can undo it."""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .bytekit import slices

ROUNDS = 8
KINDS = ("email", "phone", "card", "ssn", "ip", "iban", "date", "secret")
#: Characters of a long value that are permuted at once (36 ** 24 < 2 ** 125, within the round function's 128 bits).
PIECE = 24
_DAY0 = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2100, 1, 1).toordinal() - _DAY0


def _round(key: bytes, kind: str, i: int, half: int, n: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{kind}:{i}:{half}:{n}".encode(), key=key, digest_size=16).digest(), "big")


@lru_cache(maxsize=1 << 16)
def permute(value: int, size: int, key: bytes, kind: str, back: bool = False) -> int:
    """A keyed permutation of ``range(size)``: a Feistel network over a*b >= size, walked until inside."""
    a = max(math.isqrt(size - 1) + 1, 2)
    while True:
        left, right = divmod(value, a)
        if not back:
            for i in range(ROUNDS):
                left, right = right, (left + _round(key, kind, i, right, size)) % a
        else:
            for i in reversed(range(ROUNDS)):
                left, right = (right - _round(key, kind, i, left, size)) % a, left
        value = left * a + right
        if value < size:
            return value


def luhn_digit(body: str) -> str:
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _refill(text: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in text)


def _card(text, key, back):
    d = _digits(text)
    body = d[:-1]
    while True:
        body = str(permute(int(body), 10 ** len(body), key, "card", back)).zfill(len(body))
        if len(set(body + luhn_digit(body))) > 1:
            return _refill(text, body + luhn_digit(body))


def _number(kind: str):
    def f(text, key, back):
        d = _digits(text)
        return _refill(text, str(permute(int(d), 10 ** len(d), key, kind, back)).zfill(len(d)))

    return f


_AREA = re.compile(r"[2-9]\d\d [2-9]\d\d \d{4}", re.A)


def _phone(text, key, back):
    """The country code stays; the rest is permuted.  Three groups set apart by spaces stay a valid area and exchange."""
    m = re.match(r"\+\d{1,2}(?=[ .(-])", text, re.A)
    head = m[0] if m else ""
    new = _number("phone")(text[len(head) :], key, back)
    if _AREA.fullmatch(text):
        while not _AREA.fullmatch(new):
            new = _number("phone")(new, key, back)
    return head + new


def _ssn(text, key, back):
    """Nine digits within the valid areas, groups and serials."""
    a, g, s = (int(x) for x in re.split(r"\D", text))
    area = a - 1 - (a > 666)
    v = permute((area * 99 + g - 1) * 9999 + s - 1, 898 * 99 * 9999, key, "ssn", back)
    v, s = divmod(v, 9999)
    area, g = divmod(v, 99)
    a = area + 1 + (area >= 665)
    return _refill(text, f"{a:03d}{g + 1:02d}{s + 1:04d}")


def _ip(text, key, back):
    """An IPv4 address among all of them; the hexadecimal digits of an IPv6 address among those, colons stay."""
    if ":" not in text:
        v = permute(int(ipaddress.IPv4Address(text)), 1 << 32, key, "ip", back)
        return str(ipaddress.IPv4Address(v))
    at = [i for i, c in enumerate(text) if c != ":"]
    upper = any("A" <= c <= "F" for c in text)
    values = [int(text[i], 16) for i in at]
    while True:
        values = _pieces(values, [16] * len(at), key, "ip6", back)
        out = list(text)
        for i, v in zip(at, values, strict=True):
            out[i] = f"{v:X}" if upper else f"{v:x}"
        new = "".join(out)
        if _is_ip(new) and upper == any("A" <= c <= "F" for c in new):
            return new


_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _pieces(values: list[int], bases: list[int], key: bytes, kind: str, back: bool) -> list[int]:
    """Digits of the given bases, permuted together; long lists piece by piece, forwards and then backwards.

    A piece's permutation is chosen by the piece before it, so in the end every digit depends on all of them."""
    spans = [(i, min(i + PIECE, len(values))) for i in range(0, len(values), PIECE)]
    if len(spans) == 1:
        sweeps = [(spans, "")]
    else:
        sweeps = [(spans, ">"), (spans[::-1], "<")]
    out = list(values)
    for order, way in sweeps[::-1] if back else sweeps:
        steps = list(zip(order, [None, *order[:-1]], strict=True))
        for (lo, hi), prev in steps[::-1] if back else steps:
            near = f"{kind}{way}{lo}:{out[prev[0] : prev[1]]}" if prev else kind + way
            value, size = 0, 1
            for v, base in zip(out[lo:hi], bases[lo:hi], strict=True):
                value, size = value * base + v, size * base
            value = permute(value, size, key, near, back)
            for i in range(hi - 1, lo - 1, -1):
                value, out[i] = divmod(value, bases[i])
    return out


@lru_cache(maxsize=4096)
def _alike(c: str) -> str:
    """The characters that may stand for ``c``: digits, letters a-z of its case, or letters of its case in its 64 code points."""
    if c in "0123456789":
        return "0123456789"
    if c.lower() in _LETTERS:
        return _LETTERS.upper() if c.isupper() else _LETTERS
    if not c.isalpha():
        return ""
    block = map(chr, range(ord(c) & ~63, (ord(c) | 63) + 1))
    return "".join(x for x in block if x.isalpha() and (x.islower(), x.isupper()) == (c.islower(), c.isupper()))


def _alnum(kind: str, letters: str = _LETTERS):
    """Letters among letters (case and script kept), digits among digits; other characters stay."""

    def f(text, key, back):
        kinds = [_alike(c) for c in text]
        if letters != _LETTERS:
            kinds = [k if k[:1].isdigit() else letters.upper() if c.isupper() else letters for c, k in zip(text, kinds, strict=True)]
        at = [i for i, k in enumerate(kinds) if k]
        if not at:
            return text
        values = _pieces([kinds[i].index(text[i]) for i in at], [len(kinds[i]) for i in at], key, kind, back)
        out = list(text)
        for i, v in zip(at, values, strict=True):
            out[i] = kinds[i][v]
        return "".join(out)

    return f


_HEX = re.compile(r"[0-9a-fA-F]{8,}")
_PREFIX = re.compile(r"(?:sk|pk|rk)_(?:live|test)_|gh[pousr]_|AKIA|xox[baprs]-")


def _secret(text, key, back):
    """A known prefix stays; hexadecimal secrets stay hexadecimal, others stay something else."""
    m = _PREFIX.match(text)
    head = m[0] if m else ""
    body = text[len(head) :]
    if _HEX.fullmatch(body):
        return head + _alnum("secret", "abcdef")(body, key, back)
    change = _alnum("secret_word")
    body = change(body, key, back)
    while _HEX.fullmatch(body):
        body = change(body, key, back)
    return head + body


def _email(text, key, back):
    local, _, domain = text.partition("@")
    name, dot, tld = domain.rpartition(".")
    return _alnum("mail")(local, key, back) + "@" + _alnum("domain")(name, key, back) + dot + tld


def _iban(text, key, back):
    """Country and length stay; the check digits are made right."""
    body = re.sub(r" ", "", text)
    bban = _alnum("iban" + body[:2])(body[4:].upper(), key, back)
    rest = "".join(str(int(c, 36)) for c in bban + body[:2] + "00")
    new = f"{body[:2]}{98 - int(rest) % 97:02d}{bban}"
    it = iter(new)
    return "".join(c if c == " " else next(it) for c in text)


def _date(text, key, back):
    """A day among those that can be written in the same way: as many digits, and the same reading of day and month."""
    y, m, d, order, short = _date_parts(text)
    day = datetime.date(y, m, d).toordinal() - _DAY0
    while True:
        day = permute(day, _DAYS, key, "date", back)
        new = datetime.date.fromordinal(day + _DAY0)
        if (new.month < 10 or "m" not in short) and (new.day < 10 or "d" not in short) and (order != "mdy" or new.day > 12):
            break
    fields = {"y": f"{new.year:04d}", "m": str(new.month) if "m" in short else f"{new.month:02d}", "d": str(new.day) if "d" in short else f"{new.day:02d}"}
    return _refill(text, "".join(fields[o] for o in order))


def _date_parts(text: str) -> tuple[int, int, int, str, str] | None:
    """Year, month, day, their order, and which of them are written with one digit; None where there is no such day.

    Day before month, unless that cannot be."""
    if m := re.fullmatch(r"(\d{4})([-/.])(\d\d)\2(\d\d)", text, re.A):
        parts, order = (m[1], m[3], m[4]), "ymd"
    elif m := re.fullmatch(r"(\d\d?)([-/.])(\d\d?)\2(\d{4})", text, re.A):
        parts, order = (m[1], m[3], m[4]), "mdy" if int(m[3]) > 12 else "dmy"
    else:
        return None
    at = dict(zip(order, parts, strict=True))
    y, mo, d = (int(at[o]) for o in "ymd")
    try:
        good = 1900 <= y <= 2099 and datetime.date(y, mo, d)
    except ValueError:
        return None
    return (y, mo, d, order, "".join(o for o in order if len(at[o]) == 1)) if good else None


def _is_card(t: str) -> bool:
    d = _digits(t)
    return 13 <= len(d) <= 19 and len(set(d)) > 1 and luhn_digit(d[:-1]) == d[-1]


def _is_ip(t: str) -> bool:
    """A dotted quad without leading zeros, or an IPv6 address of eight groups, or a shortened one with a digit and four characters."""
    if ":" not in t:
        return all(int(x) < 256 and (x == "0" or x[0] != "0") for x in t.split("."))
    try:
        ipaddress.IPv6Address(t)
    except ValueError:
        return False
    used = t.replace(":", "")
    return t.count(":") == 7 and "::" not in t or len(used) >= 4 and any(c.isdigit() for c in used)


def _is_ssn(t: str) -> bool:
    a, g, s = t.split("-")
    return a not in ("000", "666") and a < "900" and g != "00" and s != "0000"


def _is_iban(t: str) -> bool:
    b = t.replace(" ", "")
    return 15 <= len(b) <= 34 and int("".join(str(int(c, 36)) for c in b[4:] + b[:4])) % 97 == 1


_CHANGE: dict[str, Callable] = {"email": _email, "phone": _phone, "card": _card, "ssn": _ssn, "ip": _ip, "iban": _iban, "date": _date, "secret": _secret}
# Runs that start with a digit, a plus or a bracket, looked at more closely below.
_RUN = re.compile(r"[+(\d][\d .()/:-]*", re.A)
_INSIDE = re.compile(
    r"(?P<date>(?<![\d./-])(?:\d{4}([-/.])\d\d\2\d\d|\d\d?([-/.])\d\d?\3\d{4})(?![\d/-]))"
    r"|(?P<ip>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d\d-\d{4}(?![\d-]))"
    r"|(?P<phone>(?<![\d+])(?:\+\d{1,2}[ .-]?)?\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .-]\d{2,4}){3,4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])|(?<!\d)(?<!\d )[2-9]\d\d [2-9]\d\d \d{4}(?! ?\d))"
    r"|(?P<card>(?<!\d)\d(?:[ -]?\d){12,18}(?![ -]?\d))"
    r"|(?P<card_>(?<!\d)\d{13,19}(?!\d))",
    re.A,
)
_CHECK = {"card": _is_card, "ip": _is_ip, "ssn": _is_ssn, "date": lambda t: _date_parts(t) is not None, "iban": _is_iban}
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])", re.A)
# letters of alphabetic scripts; words of scripts without spaces may touch an address and are no part of it
_ANY = "A-Za-zÀ-ÖØ-öø-ʯ\u0300-\u036fͰ-\u1fff"
_LOCAL = re.compile(rf"[{_ANY}0-9._%+-]")
_DOMAIN = re.compile(rf"@[{_ANY}0-9-]+(?:\.[{_ANY}0-9-]+)*\.[{_ANY}]{{2,}}")
_SECRET = re.compile(r"(?<![A-Za-z])(?i:password|passwd|pwd|secret|secret[_-]key|client[_-]secret|token|auth[_-]token|access[_-]token|api[_-]?key|access[_-]key)\"? ?([=:]) ?[\"']?([!#-&(-+\--:<-~]{6,})")
_TOKEN = re.compile(rf"(?<![A-Za-z0-9])(?:{_PREFIX.pattern})[A-Za-z0-9_-]{{10,}}")
_IP6 = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9a-f]{0,4}:){2,7}[0-9a-f]{0,4}(?![0-9A-Za-z:.]*[0-9A-Za-z:])|(?<![0-9A-Za-z:.])(?:[0-9A-F]{0,4}:){2,7}[0-9A-F]{0,4}(?![0-9A-Za-z:.]*[0-9A-Za-z:])")
_CAPS = re.compile(r"[A-Z]{2}\d\d[ A-Z0-9]", re.A)


def _secrets(text: str) -> Iterator[tuple[int, int, str]]:
    """Values after a key word: hexadecimal ones, and others with a digit and a letter or sign (after a colon), or any (after =)."""
    for m in _SECRET.finditer(text):
        value = m[2].rstrip(".:;?!)]}>'")
        core = re.search(r"[^A-Za-z]", value)
        if _HEX.fullmatch(value) or len(value) >= 6 and re.search("[A-Za-z0-9]", value) and (m[1] == "=" or (core and re.search(r"\d", value) and re.search("[A-Za-z]", value))):
            yield m.start(2), m.start(2) + len(value), "secret"
    for m in _TOKEN.finditer(text):
        yield m.start(), m.end(), "secret"


def find_values(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the validated personal values of a text; they never overlap."""
    found = []
    if "@" in text:
        at = text.find("@")
        while at >= 0:
            if m := _DOMAIN.match(text, at):
                lo = at
                while lo and _LOCAL.match(text[lo - 1]):
                    lo -= 1
                if lo < at:
                    found.append((lo, m.end(), "email"))
            at = text.find("@", at + 1)
    if "::" in text or text.count(":") >= 7:
        found += [(m.start(), m.end(), "ip") for m in _IP6.finditer(text) if _is_ip(m[0])]
    if "=" in text or ":" in text or "_" in text or "xox" in text or "AKIA" in text:
        found += _secrets(text)
    if _CAPS.search(text):
        found += [(m.start(), m.end(), "iban") for m in _IBAN.finditer(text) if _is_iban(m[0])]
    for run in _RUN.finditer(text):
        if run.end() - run.start() < 7:
            continue
        pos = run.start()
        while m := _INSIDE.search(text, pos, min(run.end() + 2, len(text))):
            kind = m.lastgroup.rstrip("_")
            if kind in _CHECK and not _CHECK[kind](m[0]):
                pos = m.start() + 1
                while pos < run.end() and text[pos].isdigit():
                    pos += 1
                continue
            found.append((m.start(), m.end(), kind))
            pos = m.end()
    found.sort(key=lambda x: (x[0], -x[1]))
    out, end = [], 0
    for f in found:
        if f[0] >= end:
            out.append(f)
            end = f[1]
    return out


def pseudonym(value: str, kind: str, key: bytes, back: bool = False) -> str:
    return _CHANGE[kind](value, key, back)


def replace_values(text: str, key: bytes, back: bool = False) -> tuple[str, list[str]]:
    spans = find_values(text)
    if not spans:
        return text, []
    parts, at = [], 0
    for a, b, kind in spans:
        parts += [text[at:a], pseudonym(text[a:b], kind, key, back)]
        at = b
    return "".join([*parts, text[at:]]), [k for _, _, k in spans]


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with personal values in ``text`` replaced by pseudonyms, and ``pii`` array<string>: their kinds in order.

    Kinds: emails, phones, cards (check digit), social security numbers, IPv4 and IPv6 addresses, IBANs (check
    digits), dates (valid days, 1900-2099), and secrets: after a key word, or with a known prefix.  Values of any
    length are permuted whole.  A null text stays null with no kinds.
    Rows are independent; a column named pii is replaced, others stay."""
    names = [c for c in docs.columns if c != "pii"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = part.column("text").to_pylist()
            kinds: list[list[str]] = [[] for _ in texts]
            for i, text in enumerate(texts):
                if text:
                    texts[i], kinds[i] = replace_values(text, key)
            cols = [pa.array(texts, pa.string()) if c == "text" else part.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(kinds, pa.list_(pa.string()))], names=[*names, "pii"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names)
    return docs.select(*names).mapInArrow(run, f"{schema}, pii array<string>")
