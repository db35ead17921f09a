"""Format-preserving pseudonyms for personal numbers, dates and mail addresses.

A value is found by its form and only taken if it is valid (Luhn, IBAN check digits, octets, calendar days, issued number
ranges). It is read as a number of a mixed radix whose places are its digits and letters, sent one step along a keyed cycle
through exactly that many numbers (a Feistel permutation, one step on, and back; invalid results are walked over), and written
back in its own form with its check digits made anew. So a pseudonym has its value's format and is never the value itself, equal
values have equal pseudonyms in all documents however they are separated, and different values have different ones. The key is
the caller's: whoever has it can undo the pseudonyms.

Bounds of the forms:

* dates from 1900 to 2099: figures in either order with `-`, `/` or `.`, days and months of one or two digits, or years of two digits
  (1930 to 2029; linked with each other, not with years of four); words with the long and short months of four languages, ordinals
  and the usual small words between;
* telephone numbers: `+` and 8 to 15 digits with a country code, however separated, `(0)` left in place; the North American form
  with or without its 1, or ten plain digits; forms with a leading 0 as in France and Germany, 8 to 12 digits; Spanish ones of nine digits.
  Those of North America and Spain are linked with their forms behind `+`; a leading 0 doesn't say its country, so such forms are linked
  with one another alone;
* cards of 13 to 19 digits, however separated behind the first two; IBANs of the registry's countries and lengths; IPv4 addresses but for what is called a version;
* mail addresses with local parts and domains of any alphabet.

Edge cases: a null text stays null, an empty one empty, each with no findings; a text may be of any length, as all searches are
linear in it; overlapping forms go to the first kind in the order mail, IBAN, numbers, worded dates; repeated values are each
replaced; repeated and null ids keep their own texts; an empty table gives no rows; columns of other names are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from datetime import date
from functools import lru_cache
from hashlib import blake2b
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
FIRST_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()

#: Names of months in dates, lengths of IBANs by country (the whole registry), and country codes of telephone numbers.
MONTHS = {
    "en": ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"),
    "de": ("Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember"),
    "fr": ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"),
    "es": ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"),
}
SHORT_MONTHS = {
    "en": ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"),
    "de": ("Jan", "Feb", "Mär", "Apr", "Mai", "Jun", "Jul", "Aug", "Sep", "Okt", "Nov", "Dez"),
    "fr": ("janv", "févr", "mars", "avr", "mai", "juin", "juil", "août", "sept", "oct", "nov", "déc"),
    "es": ("ene", "feb", "mar", "abr", "may", "jun", "jul", "ago", "sep", "oct", "nov", "dic"),
}
OTHER_MONTHS = {"sept": 9, "mrz": 3, "jän": 1, "jänner": 1, "fév": 2, "set": 9, "setiembre": 9}
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27,
    "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22,
    "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24,
    "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
_CALLING = re.compile(r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{1,3}")  # no code begins another


def _feistel(x: int, a: int, key: bytes, tweak: bytes, order: range) -> int:
    """Rounds on two halves modulo a, in the given order; in the opposite order, undone."""
    size, sign = (a.bit_length() + 7) // 8, 1 if order.step > 0 else -1
    left, right = divmod(x, a)
    for i in order:
        if sign < 0:
            left, right = right, left
        f = blake2b(tweak + bytes((0, i)) + right.to_bytes(size, "big"), key=key, digest_size=min(64, size + 8)).digest()
        left = (left + sign * int.from_bytes(f, "big")) % a
        if sign > 0:
            left, right = right, left
    return left * a + right


@lru_cache(1 << 14)
def permute(x: int, n: int, key: bytes, tweak: bytes) -> int:
    """The number after x on a keyed cycle through 0 .. n-1, so never x itself unless n is 1."""
    if n < 2:
        return x
    a = isqrt(n - 1) + 1

    def walk(x: int, order: range) -> int:
        while (x := _feistel(x, a, key, tweak, order)) >= n:
            pass
        return x

    return walk((walk(x, range(ROUNDS)) + 1) % n, range(ROUNDS - 1, -1, -1))


_LATIN = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
_PLACES = {c: (s, i) for s in _LATIN for i, c in enumerate(s)}


@lru_cache(1 << 12)
def _alphabet(page: int, kind: str) -> str:
    return "".join(c for c in map(chr, range(page << 8, (page + 1) << 8)) if unicodedata.category(c) == kind)


def _place(c: str) -> tuple[str, int] | None:
    """(the characters that c may become, c's place among them): ASCII by class; others by kind among 256 neighbours."""
    if c in _PLACES:
        return _PLACES[c]
    if c < "\x80" or (kind := unicodedata.category(c)) not in ("Ll", "Lu", "Lo", "Nd"):
        return None
    return (s := "".join(x for x in _alphabet(ord(c) >> 8, kind) if x >= "\x80")), s.index(c)


def permute_text(value: str, key: bytes, tweak: bytes, valid: Callable[[str], bool] = lambda _: True) -> str:
    """The value with its digits and letters permuted within their classes, all else in place; walks on to a valid result."""
    while True:
        x, n = 0, 1
        for c in value:
            if found := _place(c):
                x, n = x * len(found[0]) + found[1], n * len(found[0])
        x = permute(x, n, key, tweak)
        out = []
        for c in reversed(value):
            if found := _place(c):
                x, i = divmod(x, len(found[0]))
                c = found[0][i]
            out.append(c)
        value = "".join(reversed(out))
        if valid(value):
            return value


def luhn_digit(digits: str) -> str:
    total = sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
    return str(-total % 10)


def iban_digits(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country) + '00') % 97:02d}"


def _refill(form: str, values: str) -> str:
    it = iter(values)
    return "".join(next(it) if c.isalnum() else c for c in form)


def _card(m: re.Match, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", m[0])
    if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    body = permute_text(digits[:-1], key, b"card%d" % len(digits), lambda v: len(set(v + luhn_digit(v))) > 1)
    return _refill(m[0], body + luhn_digit(body))


def _iban(m: re.Match, key: bytes) -> str | None:
    flat = m[0].replace(" ", "")
    country, check, rest = flat[:2], flat[2:4], flat[4:]
    if iban_digits(country, rest) != check:
        return None
    rest = permute_text(rest, key, b"iban" + country.encode())
    return _refill(m[0], country + iban_digits(country, rest) + rest)


def _issued(v: str) -> bool:
    return v[:3] not in ("000", "666") and v[0] != "9" and v[3:5] != "00" and v[5:] != "0000"


def _social(m: re.Match, key: bytes) -> str | None:
    digits = m[0].replace("-", "")
    return _refill(m[0], permute_text(digits, key, b"social", _issued)) if _issued(digits) else None


_VERSION = re.compile(r"(?i)(?<![^\W_])(?:v|ver|version|versión|versione|release|rev|build|firmware)[.:]? ?$")


def _address(m: re.Match, key: bytes) -> str | None:
    parts = [int(p) for p in m[0].split(".")]
    if max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in m[0].split(".")):
        return None
    if _VERSION.search(m.string[max(0, m.start() - 12) : m.start()]):
        return None
    x = permute(int.from_bytes(bytes(parts), "big"), 1 << 32, key, b"address")
    return ".".join(map(str, x.to_bytes(4, "big")))


def _subscriber(national: str, country: str, key: bytes) -> str:
    """The digits behind a country code, permuted; where a country's numbers can be told by their first digit, they stay so."""
    firsts = {("1", 10): "23456789", ("34", 9): "6789", ("0", len(national)): "123456789"}.get((country, len(national)))
    if firsts and national[0] in firsts:
        return permute_text(national, key, b"phone" + country.encode(), lambda v: v[0] in firsts)
    return permute_text(national, key, b"phone-" + country.encode())


def _phone(m: re.Match, key: bytes) -> str | None:
    form = m[0]
    digits = re.sub(r"\D", "", form.replace("(0)", ""))
    if m["code"]:
        country = _CALLING.match(digits)[0]  # from the digits alone, wherever separators stand
        national = digits[len(country) :]
        if not 8 <= len(digits) <= 15 or len(national) < 6:
            return None
        new = iter(country + _subscriber(national, country, key))
        return "(0)".join("".join(next(new) if c.isdigit() else c for c in part) for part in form.split("(0)"))
    if m["zero"]:
        return _refill(form, "0" + _subscriber(digits[1:], "0", key)) if 8 <= len(digits) <= 12 else None
    if m["nine"]:
        return _refill(form, _subscriber(digits, "34", key)) if len(digits) == 9 else None
    return _refill(form, digits[:-10] + _subscriber(digits[-10:], "1", key))


#: Days that a date may be moved to: all, or those that years of two digits can tell apart.
_SPANS = {4: (FIRST_DAY, LAST_DAY, b"date"), 2: (date(1930, 1, 1).toordinal(), date(2029, 12, 31).toordinal(), b"date2")}


def _day(y: str | int, mo: int, d: int, key: bytes) -> date | None:
    first, last, tweak = _SPANS[2 if isinstance(y, str) and len(y) == 2 else 4]
    year = int(y) + (0 if tweak == b"date" else 1900 if int(y) >= 30 else 2000)
    try:
        n = date(year, mo, d).toordinal()
    except ValueError:
        return None
    return date.fromordinal(first + permute(n - first, last - first + 1, key, tweak)) if first <= n <= last else None


def _numeric_date(m: re.Match, key: bytes) -> str | None:
    kind = "1" if m["y1"] else "2" if m["y2"] else "3" if m["y3"] else "4"
    a, b, y, s = m["a" + kind], m["b" + kind], m["y" + kind], m["s" + kind]
    wide = 2 if len(a) == len(b) == 2 else 1  # figures of one digit are written without zeros
    year = lambda new: f"{new.year % 100:02d}" if len(y) == 2 else f"{new.year:04d}"
    if kind == "1":
        new = _day(y, int(a), int(b), key)
        return new and f"{year(new)}{s}{new.month:0{wide}d}{s}{new.day:0{wide}d}"
    new = _day(y, int(b), int(a), key)  # day first, unless only month first is a day of the calendar
    if new:
        return f"{new.day:0{wide}d}{s}{new.month:0{wide}d}{s}{year(new)}"
    new = _day(y, int(a), int(b), key)
    return new and f"{new.month:0{wide}d}{s}{new.day:0{wide}d}{s}{year(new)}"


_BY_NAME: dict[str, list[tuple[str, int, dict]]] = {}  # name: language, month, and the names that the new month is taken from
for _table in (MONTHS, SHORT_MONTHS):
    for _language, _names in _table.items():
        for _i, _name in enumerate(_names):
            if not any(x[0] == _language for x in _BY_NAME.get(_name.lower(), ())):
                _BY_NAME.setdefault(_name.lower(), []).append((_language, _i, _table))
for _name, _i in OTHER_MONTHS.items():
    _BY_NAME.setdefault(_name, []).append(("es" if _name.startswith("set") else "fr" if _name == "fév" else "de" if _name != "sept" else "en", _i - 1, MONTHS if len(_name) > 4 else SHORT_MONTHS))


def _ordinal(mark: str, day: int) -> str:
    """The mark behind a day, of the kind that stood there."""
    if mark.lower() in ("st", "nd", "rd", "th"):
        new = "th" if 10 < day < 20 else {1: "st", 2: "nd", 3: "rd"}.get(day % 10, "th")
        return new.upper() if mark.isupper() else new
    return mark if mark != "er" or day == 1 else ""


def _worded_date(m: re.Match, key: bytes) -> str | None:
    name, mark = m["month"] or m["first"], m["mark"] or m["mark1"] or ""
    between = m["between"] or ""
    usual = "es" if "de" in between.split() else "de" if mark == "." else "fr" if mark == "er" or (name.islower() and not mark) else "en"
    known = _BY_NAME[name.lower()]
    language, i, names = next((x for x in known if x[0] == usual), known[0])
    new = _day(m["year"] or m["year1"], i + 1, int(m["day"] or m["day1"]), key)
    if not new:
        return None
    word = names[language][new.month - 1]
    word = word.upper() if name.isupper() else word.capitalize() if name[0].isupper() else word.lower()
    day = f"{new.day:0{len(m['day'] or m['day1']) if (m['day'] or m['day1'])[0] == '0' else 1}d}{_ordinal(mark, new.day)}"
    if m["first"]:
        return f"{word}{m['dot1'] or ''} {day}{m['comma']}{new.year:04d}"
    return f"{day}{between}{word}{m['dot'] or ''}{m['then']}{new.year:04d}"


def _mail(m: re.Match, key: bytes) -> str | None:
    local, _, domain = m[0].rpartition("@")
    return f"{permute_text(local, key, b'mail' + domain.lower().encode())}@{domain}"


_FORMS = {
    "date": re.compile(
        r"(?<!\d)(?P<y1>\d{4})(?P<s1>[-/.])(?P<a1>\d{1,2})(?P=s1)(?P<b1>\d{1,2})(?!\d)"
        r"|(?<![\d.])(?P<a2>\d{1,2})(?P<s2>[-/.])(?P<b2>\d{1,2})(?P=s2)(?P<y2>\d{4})(?!\d)"
        r"|(?<![\d/.-])(?P<a3>\d{1,2})(?P<s3>/)(?P<b3>\d{1,2})/(?P<y3>\d\d)(?![\d/])"
        r"|(?<![\d/.-])(?P<a4>\d\d)(?P<s4>[.-])(?P<b4>\d\d)(?P=s4)(?P<y4>\d\d)(?!\d|[.-]\d)"
    ),
    "address": re.compile(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)"),
    "social": re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    "phone": re.compile(
        r"(?P<code>(?<![\d+])\+\d(?:[ ./-]?(?:\(0\)[ .-]?)?(?:\((?!0\))\d{1,4}\)|\d)){4,14}(?!\d))"
        r"|(?P<ten>(?<![\d+.-])(?:1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[-.]|[2-9]\d{2} )\d{3}[-. ]\d{4}(?![\d-])|(?<![\d.,+/-])[2-9]\d{9}(?!\d|[.,/-]\d))"
        r"|(?P<zero>(?<![\d+.,/-])(?:\(0[1-9]\d{0,4}\)|0[1-9]\d{0,4})(?:(?: ?[/-] ?|[ .])\d{2,8}){1,5}(?!\d)|(?<![\d.,+/-])0[1-9]\d{8,10}(?!\d|[.,/-]\d))"
        r"|(?P<nine>(?<![\d.,+/-])(?:[6-9]\d{2}(?:[ .-]\d{3}){2}|[6-9]\d{2}(?:[ .-]\d{2}){3}|[89]\d[ .-]\d{3}(?:[ .-]\d{2}){2}|[67]\d{8})(?!\d|[.,-]\d))"
    ),
    "card": re.compile(r"(?<!\d)\d{2}(?:[ -]?\d){11,17}(?!\d)"),
}
_PLAIN_CARD = re.compile(r"(?<!\d)\d{13,19}(?!\d)")
_DIGITS = re.compile(r"\d+")
_RUN = re.compile(r"[+(\d][\d ().+/-]{5,}+")
_START = re.compile(r"[+(]?\d")
_IBAN_FORMS = (rf"(?:{'|'.join(c for c, k in IBAN_LENGTHS.items() if k == n)})\d\d(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n in sorted(set(IBAN_LENGTHS.values())))
_IBAN = re.compile(rf"\b(?:{'|'.join(_IBAN_FORMS)})\b")
_IBAN_START = re.compile(r"[A-Z]{2}\d\d")
_NAMES = "|".join(sorted(_BY_NAME, key=lambda n: (-len(n), n)))
#: A worded date ends with its year: it is looked for in the few characters up to each number that may be one.
_YEAR = re.compile(r"(?:19|20)\d\d(?!\d)")
_BEFORE_YEAR = 40
_WORDED = re.compile(
    rf"(?<![^\W_])(?:(?P<day>\d{{1,2}})(?P<mark>\.|er|st|nd|rd|th|º)?(?P<between> (?:de |of )?|-)(?P<month>{_NAMES})(?P<dot>\.)?(?P<then>,? (?:de |del )?|-)(?P<year>\d{{4}})"
    rf"|(?P<first>{_NAMES})(?P<dot1>\.)? (?P<day1>\d{{1,2}})(?P<mark1>st|nd|rd|th)?(?P<comma>,? )(?P<year1>\d{{4}}))\Z",
    re.IGNORECASE,
)
_MAIL = re.compile(r"(?<![\w.+'’-])[\w.+'’-]++@[\w-]+(?:\.[\w-]+)*\.(?:[^\W\d_]{2,}|xn--[A-Za-z0-9-]+)\b")
_HOW = {"date": _numeric_date, "address": _address, "social": _social, "phone": _phone, "card": _card}


Finding = tuple[int, int, str, str]  # start, end, kind, pseudonym


def _mails(text: str, key: bytes) -> Iterator[Finding]:
    if "@" in text:
        for m in _MAIL.finditer(text):
            yield m.start(), m.end(), "mail", _mail(m, key)


def _ibans(text: str, key: bytes) -> Iterator[Finding]:
    at = 0
    for start in _IBAN_START.finditer(text):
        i = start.start()
        if i >= at and (m := _IBAN.match(text, i)) and (new := _iban(m, key)):  # behind one that isn't valid, another may begin within
            yield i, m.end(), "iban", new
            at = m.end()


def _numbers(text: str, key: bytes) -> Iterator[Finding]:
    for run in _RUN.finditer(text):
        at, hi = run.span()
        end = min(len(text), hi + 2)
        while m := _START.search(text, at, hi):
            i = m.start()
            for kind, form in _FORMS.items():
                if (p := form.match(text, i, end)) and (new := _HOW[kind](p, key)):
                    break
            else:
                first = _DIGITS.search(text, i)  # not one number: look at its first group alone, then go on behind it
                p = _PLAIN_CARD.match(text, i) if len(first[0]) > 12 else None
                kind, new = "card", p and _card(p, key)
                if not new:
                    at = first.end() if text[i].isdigit() else i + 1
                    continue
            yield p.start(), p.end(), kind, new
            at = p.end()


def _worded(text: str, key: bytes) -> Iterator[Finding]:
    at = 0
    for year in _YEAR.finditer(text):
        low = max(at, year.start() - _BEFORE_YEAR)
        if (m := _WORDED.search(text, low, year.end())) and (low == 0 or m.start() > low or not (text[low - 1].isalnum())) and (new := _worded_date(m, key)):
            yield m.start(), m.end(), "date", new
            at = m.end()


def pseudonymise(text: str, key: bytes) -> tuple[str, list[Finding]]:
    """(the text with its values replaced, findings in order: start and end in the given text, kind and pseudonym)."""
    taken: list[Finding] = []
    for find in (_mails, _ibans, _numbers, _worded):
        at, free = 0, []
        for f in find(text, key):  # both are in order and free of overlaps, so one walk along them is enough
            while at < len(taken) and taken[at][1] <= f[0]:
                at += 1
            if at == len(taken) or f[1] <= taken[at][0]:
                free.append(f)
        taken = sorted(taken + free) if free else taken
    out, at = [], 0
    for s, e, _, new in taken:
        out += [text[at:s], new]
        at = e
    return "".join([*out, text[at:]]), taken


def replace(docs: DataFrame, secret: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """With secret, a key of 1 to 64 bytes: key, text with pseudonyms and findings (kind, start, end, pseudonym)."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("pseudonym", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = [], []
            for t in batch.column(1):
                t = t.as_py()
                new, taken = (t, []) if t is None else pseudonymise(t, secret)
                texts.append(new)
                found.append([{"kind": k, "start": s, "end": e, "pseudonym": p} for s, e, k, p in taken])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(found, kind)], names=["key", "text", "findings"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, text string, findings array<struct<kind:string,start:bigint,end:bigint,pseudonym:string>>").withColumnRenamed("key", key)
