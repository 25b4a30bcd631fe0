"""Operator 5: format-preserving pseudonyms for personal numbers and dates.

A value is found by its form and validated (check digits, ranges, calendar). Its symbols are then permuted by a keyed
Feistel network over exactly the values of that format, walking the cycle until the result is valid again. Separators
and layout stay, equal values get equal pseudonyms in every document and under every layout, and the holder of the key
can invert the map. Values: card numbers, IBANs, phone and social-security numbers, IPv4 addresses, calendar dates,
e-mail addresses (letters and digits of the name and host) and hexadecimal credentials after a word that names one.

Defined results: null text stays null and an empty one stays empty; a value that fails its validation is left alone.
Every phone number of the found form and every address with octets 0-255 is replaced: ten-digit numbers that cannot be
dialled and addresses that are not unicast are permuted among themselves. Leading zeros of octets stay where the new
octets leave room for them. A card or IBAN is also found in front of more symbols, if a separator ends it; the longest
start with right check digits is taken (an IBAN by the length of its country). The inverse finds values anew, so where a
card stands before more digits it may read a longer card.
Work is one narrow pass, so no key or document meets another.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import math
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store

KINDS = ("email", "secret", "iban", "date", "ip", "phone", "ssn", "card")
ROUNDS = 10
_PATTERN = re.compile(
    r"""
    (?P<email>(?<![\w.+%-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w-]))
  | (?P<secret>(?i:\b(?:token|password|passwd|pwd|secret|api[_-]?key|access[_-]?key|key)\b["']?\s*[=:]\s*["']?)[0-9a-fA-F]{12,128}(?![0-9A-Za-z]))
  | (?P<iban>(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30}(?![0-9A-Za-z]))
  | (?P<date>(?<![0-9./-])(?:[0-9]{4}([-/.])[0-9]{2}\5[0-9]{2}|[0-9]{2}([-/.])[0-9]{2}\6[0-9]{4})(?![0-9]|[./-][0-9]))
  | (?P<ip>(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9]))
  | (?P<phone>(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\)[ ]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9A-Za-z]|[.-][0-9]))
  | (?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9]))
  | (?P<card>(?<![0-9A-Za-z])(?:[0-9][ -]?){12,18}[0-9](?![0-9A-Za-z]))
    """, re.VERBOSE)
_HINT = re.compile(r"[0-9]")
#: Symbols of an IBAN by country.
_IBAN = {c: n for n, cs in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items() for c in cs.split()}
_DIGITS, _LETTERS, _HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"


def feistel(key: bytes, tweak: str, value: int, left: int, right: int, back: bool = False) -> int:
    """Keyed permutation of 0..left*right-1 (an unbalanced Feistel network of ROUNDS rounds); `back` inverts it."""
    a, b = divmod(value, right)
    wide = max(left, right).bit_length()
    for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
        x, size = (b, left) if i % 2 == 0 else (a, right)
        if wide <= 128:
            f = int.from_bytes(hmac.digest(key, f"{tweak}|{left}|{right}|{i}|{x}".encode(), "sha256")[:16], "big")
        else:  # as many bytes as the half needs, else its first symbols would stay; hexadecimal, as decimals are limited to 4,300
            seed = hmac.digest(key, f"{tweak}|{left:x}|{right:x}|{i}|{x:x}".encode(), "sha256")
            f = int.from_bytes(hashlib.shake_256(seed).digest(wide // 8 + 9), "big")
        if back:
            f = -f
        if i % 2 == 0:
            a = (a + f) % size
        else:
            b = (b + f) % size
    return a * right + b


def permuted(key: bytes, tweak: str, value: int, size: int, valid=lambda v: True, back: bool = False) -> int:
    """Permutation of the valid numbers below `size`: walk the cycle of a Feistel network on a slightly larger square."""
    root = max(2, math.isqrt(size - 1) + 1)
    for _ in range(1 << 20):
        value = feistel(key, tweak, value, root, root, back)
        if value < size and valid(value):
            return value
    raise ValueError("no valid value on this cycle")


def luhn(digits: str) -> int:
    """The check digit that makes digits + it valid."""
    total = sum(sum(divmod(int(d) * 2, 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits)))
    return -total % 10


def iban_check(country: str, account: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in account + country + "00")) % 97


def _fill(shape: str, symbols: str, where: str) -> str:
    """`shape` with its characters of class `where` replaced in turn by `symbols`."""
    it = iter(symbols)
    return re.sub(where, lambda m: next(it), shape)


def _mixed(key: bytes, tweak: str, text: str, back: bool) -> str:
    """Permute letters as letters (their case kept) and digits as digits, together as one number."""
    bases = [10 if c in _DIGITS else 26 if c.lower() in _LETTERS else 0 for c in text]
    value, size = 0, 1
    for c, n in zip(text, bases, strict=True):
        if n:
            value, size = value * n + (int(c) if n == 10 else _LETTERS.index(c.lower())), size * n
    value = permuted(key, f"{tweak}|{''.join('d' if n == 10 else 'a' if n else '.' for n in bases)}", value, size, back=back)
    out = []
    for c, n in zip(reversed(text), reversed(bases), strict=True):
        if n:
            value, k = divmod(value, n)
            c = _DIGITS[k] if n == 10 else _LETTERS[k].upper() if c.isupper() else _LETTERS[k]
        out.append(c)
    return "".join(reversed(out))


_FIRST_DAY, _DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()


def _day(a: str, b: str, c: str) -> tuple[int, str] | None:
    """Ordinal and order of a date in three parts: year first, or day first where that is valid, else month first."""
    for order in ("ymd",) if len(a) == 4 else ("dmy", "mdy"):
        part = dict(zip(order, (a, b, c), strict=True))
        try:
            n = datetime.date(int(part["y"]), int(part["m"]), int(part["d"])).toordinal() - _FIRST_DAY
        except ValueError:
            continue
        if 0 <= n < _DAYS:
            return n, order
    return None


@lru_cache(20_000)
def pseudonym(kind: str, found: str, key: bytes, back: bool = False) -> str | None:
    """The value `found` permuted, or None if it is not valid."""
    digits = re.sub("[^0-9]", "", found)
    if kind == "card":
        if not 13 <= len(digits) <= 19 or luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
            return None
        n = len(digits) - 1
        body = str(permuted(key, f"card{n}", int(digits[:-1]), 10 ** n, lambda v: len(set(str(v).zfill(n))) > 1, back)).zfill(n)
        return _fill(found, body + str(luhn(body)), "[0-9]")
    if kind == "iban":
        compact = found.replace(" ", "")
        if not 15 <= len(compact) <= 34 or int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 != 1:
            return None
        account = _mixed(key, "iban" + compact[:2], compact[4:], back)
        return _fill(found, compact[:2] + f"{iban_check(compact[:2], account):02d}" + account, "[A-Z0-9]")
    if kind == "ssn":
        ok = lambda v: 0 < v // 10 ** 6 < 900 and v // 10 ** 6 != 666 and v // 10 ** 4 % 100 and v % 10 ** 4
        return _fill(found, f"{permuted(key, 'ssn', int(digits), 10 ** 9, ok, back):09d}", "[0-9]") if ok(int(digits)) else None
    if kind == "ip":
        parts = found.split(".")
        if any(int(p) > 255 for p in parts):
            return None
        unicast = lambda v: 0 < v >> 24 < 224
        given = int.from_bytes(bytes(map(int, parts)), "big")
        new = permuted(key, "ip", given, 1 << 32, lambda v: unicast(v) == unicast(given), back).to_bytes(4, "big")
        padded = any(p != str(int(p)) for p in parts)
        return ".".join(str(n).zfill(len(p) if padded else 1) for n, p in zip(new, parts, strict=True))
    if kind == "date":
        parts = re.split("[-/.]", found)
        if (day := _day(*parts)) is None:
            return None
        n, order = day
        # a day-first date must not turn into one that reads otherwise
        fits = lambda v: order == "ymd" or _day(*_written(v, order)) == (v, order)
        return _fill(found, "".join(_written(permuted(key, "date" if order == "ymd" else order, n, _DAYS, fits, back), order)), "[0-9]")
    if kind == "phone":
        code = re.match(r"\+([0-9]{1,3})(?![0-9])", found)
        kept = len(code[1]) if code else 0
        own = digits[kept:]
        nanp = len(own) == 10 and digits[:kept] in ("", "1")
        dialled = lambda v: not nanp or str(v).zfill(10)[0] > "1" and str(v).zfill(10)[3] > "1"
        tweak = "phone1" if nanp else f"phone{digits[:kept]}-{len(own)}"
        new = permuted(key, tweak, int(own), 10 ** len(own), lambda v: dialled(v) == dialled(int(own)), back)
        return _fill(found, digits[:kept] + str(new).zfill(len(own)), "[0-9]")
    if kind == "email":
        name, _, host = found.rpartition("@")
        domain, _, top = host.rpartition(".")
        return f"{_mixed(key, 'mail', name, back)}@{_mixed(key, 'host', domain, back)}.{top}"
    lead, value = re.fullmatch(r"(.*?)([0-9a-fA-F]{12,128})", found, re.DOTALL).groups()
    number = permuted(key, f"hex{len(value)}", int(value, 16), 16 ** len(value), back=back)
    new = f"{number:0{len(value)}x}"
    return lead + (new.upper() if value.isupper() else new)


def _written(ordinal: int, order: str) -> list[str]:
    d = datetime.date.fromordinal(_FIRST_DAY + ordinal)
    part = {"y": f"{d.year:04d}", "m": f"{d.month:02d}", "d": f"{d.day:02d}"}
    return [part[c] for c in order]


def _readings(kind: str, found: str) -> list[str]:
    """What may be the value in a run of symbols, best first: the run, or a start of it that ends at a separator."""
    if kind == "card":
        return [found, *(found[:m.start()] for m in reversed(list(re.finditer("[ -]", found))))]
    if kind == "iban" and found[:2] in _IBAN:
        fixed = re.match("(?:[A-Z0-9] ?){%d}[A-Z0-9](?= )" % (_IBAN[found[:2]] - 1), found)
        return [fixed[0], found] if fixed else [found]
    return [found]


def masked(text: str, key: bytes, back: bool = False) -> tuple[str, dict[str, int]]:
    """The text with its valid values permuted, and how many of each kind."""
    counts: dict[str, int] = {}
    if not _HINT.search(text) and "@" not in text:
        return text, counts

    out, done, at = [], 0, 0
    while m := _PATTERN.search(text, at):
        kind, at = m.lastgroup, m.start() + 1  # one symbol further, if there is no value
        for found in _readings(kind, m[0]):
            if (new := pseudonym(kind, found, key, back)) is not None:
                counts[kind] = counts.get(kind, 0) + 1
                out += [text[done:m.start()], new]
                done = at = m.start() + len(found)
                break
    return "".join([*out, text[done:]]), counts


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """All columns of `docs` with `text` replaced, and last `_found` (counts in the order of KINDS)."""
    secret = hashlib.sha256(key.encode()).digest()
    names = docs.columns
    fields = [f"`_{i}` {f.dataType.simpleString()}" for i, f in enumerate(docs.schema)]

    def run(batches):
        for batch in batches:
            new, found = [], []
            for t in batch.column(names.index("text")).to_pylist():
                t, counts = (None, {}) if t is None else masked(t, secret)
                new.append(t)
                found.append([counts.get(k, 0) for k in KINDS])
            yield {f"_{i}": batch.column(i) for i in range(len(names))} | {f"_{names.index('text')}": pa.array(new, pa.string()), "_found": pa.array(found, pa.list_(pa.int64()))}

    given = docs.toDF(*(f"_{i}" for i in range(len(names))))
    return store.map_arrow(given, run, ", ".join([*fields, "_found array<long>"])).toDF(*names, "_found")


def report(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, the pseudonymised text, n_found and a count of each kind."""
    out = pseudonymised(docs.select("doc_id", "text"), key)
    return out.select("doc_id", "text", F.aggregate("_found", F.lit(0).cast("long"), lambda a, b: a + b).alias("n_found"), *(F.col("_found")[i].alias(f"n_{k}") for i, k in enumerate(KINDS)))
