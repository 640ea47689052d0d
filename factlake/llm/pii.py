"""Personal data: format-preserving pseudonyms from a keyed Feistel network.

Found and replaced: card numbers (Luhn), IBANs (mod 97), US social security numbers (valid ranges), phone numbers, IPv4
addresses (octets up to 255), e-mail addresses, hexadecimal secrets of 32 digits or more, and calendar dates (ISO,
d/m/y, d.m.y). A number that fails its validation stays as it is: it is not personal data of that kind, and the
search goes on within it. An IBAN ends where its country's length or its check digits say.

A value is read as an index within its format's domain of N values and permuted by ``E^-1(E(i) + 1 mod N)``, where E is
an 8-round balanced Feistel network with keyed BLAKE2b rounds and cycle walking. That is a bijection without fixed
points, so equal values get equal pseudonyms in all documents, different ones stay different, and none stays itself.
Check digits are computed anew; punctuation, spacing, letter case and length stay. An e-mail address keeps its domain,
and counts as the same in any letter case. Dates permute by day from 1900 to
2099 whatever their notation, so one day written in two ways stays one day. d/m/y is read day first where both fit.

Defined results: null text gives null text and no findings; empty text stays empty; texts of any length are scanned
whole; repeated rows are treated alike; an empty table gives an empty one. All columns of the input are kept, and the
text column alone is replaced; the counts are a new column whose name must not be taken (see ``pseudonymise``).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from datetime import date, timedelta

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from factlake.llm._common import lean, no_clash, small_batches

#: For tests and trials alone: whoever knows the key can undo pseudonyms. A real run sets spark.factlake.pii.key.
TEST_KEY = "change-me"
ROUNDS = 8
#: Characters that are permuted together.
PIECE = 256

_EMAIL = r"[._%+-]*+(?P<email>[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
#: An address starts with its run of such characters, so that a long run is read once; or where a finding ends.
NEXT = re.compile(_EMAIL)
FOUND = re.compile(
    r"(?<![A-Za-z0-9._%+-])" + _EMAIL +
    r"|(?P<secret>(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z]))"
    r"|(?P<iban>(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z]))"
    r"|(?P<ip>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d))"
    r"|(?P<phone>(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|(?<![\d+])\+\d{8,15}(?!\d))"
    r"|(?P<card>(?<![\d.])(?:\d{13,19}|\d{4}(?P<gap>[ -])\d{4}(?P=gap)\d{4}(?P=gap)\d{1,7}|\d{4}(?P<gap2>[ -])\d{6}(?P=gap2)\d{5})(?!\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<date>(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}(?P<sep>[/.])\d{1,2}(?P=sep)\d{4})(?![\d/-]))"
)
#: Lengths of IBANs by country; for others all ends are tried.
_IBAN_SIZES = {c: int(n) for n, own in (x.split(":") for x in (
    "15:NO|16:BE|18:DK FI FO GL NL SD|19:MK SI|20:AT BA EE KZ LT LU XK|21:CH HR LI LV|22:BG BH CR DE GB GE IE ME RS VA|23:AE GI IL IQ OM SO TL"
    "|24:AD CZ ES MD PK RO SA SE SK TN VG|25:LY PT ST|26:IS TR|27:BI DJ FR GR IT MC MR SM|28:AL AZ BY CY DO GT HU LB NI PL SV|29:BR EG PS QA UA|30:JO KW MU YE|31:MT SC|32:LC|33:RU").split("|")) for c in own.split()}
_DAY0, _DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days


class Permuter:
    """Keyed permutations of range(n), one for each label."""

    def __init__(self, key: str):
        self.key = hashlib.blake2b(key.encode(), digest_size=32).digest()

    def _f(self, label: bytes, r: int, value: int, half: int) -> int:
        """A round's keyed value of ``half`` bits: BLAKE2b in counter mode beyond one digest."""
        size = (half + 7) // 8
        own = bytes([r]) + value.to_bytes(size, "big")
        out = hashlib.blake2b(own, key=self.key, person=label, digest_size=min(64, size + 8)).digest()
        if size > 64:
            out = b"".join(hashlib.blake2b(out, key=self.key, person=label, salt=k.to_bytes(8, "big")).digest() for k in range(-(-size // 64)))
        return int.from_bytes(out, "big") & ((1 << half) - 1)

    def _rounds(self, label: bytes, x: int, n: int, order: range) -> int:
        half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        while True:
            left, right = x >> half, x & mask
            for r in order:
                if order.step > 0:
                    left, right = right, left ^ self._f(label, r, right, half)
                else:
                    left, right = right ^ self._f(label, r, left, half), left
            x = left << half | right
            if x < n:  # else walk on along the cycle
                return x

    def forward(self, label: str, x: int, n: int) -> int:
        """The pseudonym's index; never x itself if n is 2 or more."""
        if n < 2:
            return x
        tag = hashlib.blake2b(f"{label}:{n:x}".encode(), digest_size=16).digest()
        y = self._rounds(tag, x, n, range(ROUNDS))
        return self._rounds(tag, (y + 1) % n, n, range(ROUNDS - 1, -1, -1))

    def backward(self, label: str, x: int, n: int) -> int:
        """Undoes forward."""
        if n < 2:
            return x
        tag = hashlib.blake2b(f"{label}:{n:x}".encode(), digest_size=16).digest()
        y = self._rounds(tag, x, n, range(ROUNDS))
        return self._rounds(tag, (y - 1) % n, n, range(ROUNDS - 1, -1, -1))


def luhn_digit(payload: str) -> str:
    """The check digit that completes payload."""
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _iban_mod(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _refill(shape: str, chars: str, where: str) -> str:
    """shape with its characters of that class replaced by chars in order."""
    it = iter(chars)
    return "".join(next(it) if c in where else c for c in shape)


_DIGITS = "0123456789"
_ALNUM = _DIGITS + "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CLASSES = (_DIGITS, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _mixed(chars: str, step, label: str) -> str:
    """Permutes a string of digits and letters within its classes, place by place; a long one in pieces, each by what comes before it."""
    if len(chars) > PIECE:
        before = hashlib.blake2b(digest_size=16)
        out = []
        for lo in range(0, len(chars), PIECE):
            own = chars[lo : lo + PIECE]
            out.append(_mixed(own, step, f"{label}/{before.hexdigest()}/"))
            before.update(own.encode())
        return "".join(out)
    x, n, sets = 0, 1, []
    for c in chars:
        own = next((s for s in _CLASSES if c in s), None)
        sets.append(own)
        if own:
            x, n = x * len(own) + own.index(c), n * len(own)
    shape = "".join("x" if s is None else str(_CLASSES.index(s)) for s in sets)
    x = step(label + shape, x, n)
    out = []
    for c, own in zip(reversed(chars), reversed(sets)):
        if own:
            x, r = divmod(x, len(own))
            c = own[r]
        out.append(c)
    return "".join(reversed(out))


def _card(s: str, step) -> str | None:
    digits = re.sub(r"\D", "", s)
    if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    new = str(step("card", int(digits[:-1]), 10 ** (len(digits) - 1))).zfill(len(digits) - 1)
    return _refill(s, new + luhn_digit(new), _DIGITS)


def _iban(s: str, step) -> str | None:
    flat = s.replace(" ", "")
    if not 15 <= len(flat) <= 34 or _iban_mod(flat) != 1:
        return None
    body = _mixed(flat[4:], step, "iban")
    check = 98 - _iban_mod(flat[:2] + "00" + body)
    return _refill(s, flat[:2] + f"{check:02d}" + body, _ALNUM)


def _iban_ends(s: str) -> list[int]:
    """Where an IBAN that starts s may end: the pattern takes words that follow it as well."""
    ends = [len(s), *(k for k in range(len(s) - 1, 0, -1) if s[k] == " ")]
    size = _IBAN_SIZES.get(s[:2])
    if size:
        ends = [k for k in ends if len(s[:k].replace(" ", "")) == size] + [len(s)]
    return ends


def _ip(s: str, step) -> str | None:
    octets = [int(o) for o in s.split(".")]
    if max(octets) > 255:
        return None
    x = step("ip", int.from_bytes(bytes(octets), "big"), 2**32)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _phone(s: str, step) -> str | None:
    digits = re.sub(r"\D", "", s)
    own = min(10, len(digits) - 1 if s[0] == "+" else len(digits))  # what comes before is the country's code
    head, tail = digits[:-own], digits[-own:]
    return _refill(s, head + str(step("phone", int(tail), 10**own)).zfill(own), _DIGITS)


def _ssn(s: str, step) -> str | None:
    area, group, serial = map(int, s.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    x = step("ssn", ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999)
    x, serial = divmod(x, 9999)
    area, group = divmod(x, 99)
    area += 1 + (area + 1 >= 666)
    return f"{area:03d}-{group + 1:02d}-{serial + 1:04d}"


def _date(s: str, step) -> str | None:
    parts = re.split(r"[-/.]", s)
    try:
        if len(parts[0]) == 4:
            day, order = date(*map(int, parts)), "ymd"
        else:
            a, b, y = map(int, parts)
            day, order = (date(y, b, a), "dmy") if b <= 12 else (date(y, a, b), "mdy")
    except ValueError:
        return None
    i = (day - _DAY0).days
    if not 0 <= i < _DAYS:
        return None
    new = _DAY0 + timedelta(days=step("date", i, _DAYS))
    if order == "ymd":
        return new.isoformat()
    sep = s[len(parts[0])]
    a, b = (new.day, new.month) if order == "dmy" else (new.month, new.day)
    if order == "mdy" and b <= 12:  # else it would be read day first
        a, b = b, a
    pad = 2 if any(len(p) == 2 and p[0] == "0" for p in parts[:2]) else 1
    return f"{a:0{pad}d}{sep}{b:0{pad}d}{sep}{new.year}"


def _email(s: str, step) -> str | None:
    local, _, domain = s.rpartition("@")
    new = _mixed(local.lower(), step, "email@" + domain.lower())  # addresses are the same whatever their case, which stays
    return "".join(c.upper() if own.isupper() else c for c, own in zip(new, local)) + "@" + domain


def _secret(s: str, step) -> str | None:
    lower = s.lower()
    if lower.isdigit() or lower.isalpha():
        return None
    new = f"{step('hex', int(lower, 16), 16 ** len(s)):0{len(s)}x}"
    return new if s == lower else new.upper()


_KINDS = {"card": _card, "iban": _iban, "ip": _ip, "phone": _phone, "ssn": _ssn, "date": _date, "email": _email, "secret": _secret}


class Pseudonymiser:
    """Replaces findings in a text; remembers pseudonyms it has made."""

    def __init__(self, key: str):
        self.step = Permuter(key).forward
        self.known: dict[tuple[str, str], tuple[str | None, int]] = {}

    def _replaced(self, kind: str, s: str) -> tuple[str | None, int]:
        """What stands for a finding and how much of s that is."""
        for end in _iban_ends(s) if kind == "iban" else (len(s),):
            new = _KINDS[kind](s[:end], self.step)
            if new is not None:
                return new, end
        return None, 0

    def __call__(self, text: str) -> tuple[str, int]:
        found, done, at, out = 0, 0, 0, []
        while m := (at and at == done and NEXT.match(text, at)) or FOUND.search(text, at):
            start, own = m.start(m.lastgroup), (m.lastgroup, m[m.lastgroup])
            if own not in self.known:
                if len(self.known) > 200_000:
                    self.known.clear()
                self.known[own] = self._replaced(*own)
            new, size = self.known[own]
            if new is None:  # what else it took may hold other data
                at = start + 1
                continue
            found += 1
            out += (text[done:start], new)
            done = at = start + size
        return "".join([*out, text[done:]]), found


_own: dict[str, Pseudonymiser] = {}


def pseudonymise(df: DataFrame, key: str | None = None, count: str | None = "n_found") -> DataFrame:
    """df with its findings in ``text`` replaced and, unless ``count`` is None, a column of that name with their number.

    One narrow pass, no shuffle. Only texts with a digit or @ reach the regular expression; no finding lacks both.
    The key is ``key`` or else spark.factlake.pii.key; without either it is an error.
    """
    small_batches(df.sparkSession)
    key = key or df.sparkSession.conf.get("spark.factlake.pii.key", "")
    if not key:
        raise ValueError("no key: set spark.factlake.pii.key")
    if count and count in df.columns:
        raise ValueError(f"the table already has a column {count}")
    at = df.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = _own.setdefault(key, Pseudonymiser(key))
        for batch in batches:
            col = batch.column(at)
            hot = pc.fill_null(pc.match_substring_regex(col, "[0-9@]"), False).to_numpy(zero_copy_only=False).nonzero()[0]
            found = [0] * len(col)
            if len(hot):
                texts, changed = col.take(pa.array(hot)).to_pylist(), []
                for i, t in zip(hot, texts):
                    new, found[i] = work(t)
                    changed.append(new)
                mask = pa.array([False] * len(col)).to_numpy(zero_copy_only=False).copy()
                mask[hot] = True
                col = pc.replace_with_mask(col, pa.array(mask), pa.array(changed, col.type))
            columns = [col if i == at else c for i, c in enumerate(batch.columns)]
            names = list(batch.schema.names)
            if count:
                columns.append(pa.array(found, pa.int64()))
                names.append(count)
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = T.StructType([*df.schema.fields, *([T.StructField(count, T.LongType())] if count else [])])
    return df.mapInArrow(lean(run), schema)


def session_key(df: DataFrame) -> str:
    """The session's key, or where it has none the one for tests: for queries over synthetic tables."""
    return df.sparkSession.conf.get("spark.factlake.pii.key", "") or TEST_KEY


def query(df: DataFrame) -> DataFrame:
    """(doc_id, text, n_found) of all documents."""
    return pseudonymise(no_clash(df, "doc_id", "text"), session_key(df))
