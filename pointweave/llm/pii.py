"""Format-preserving pseudonyms for personal data.

Numbers and dates are recognised by form and validated (check digits, calendar,
numbering plan); a keyed Feistel permutation of all valid values of the same
form then replaces each by another valid one. The same value gets the same
pseudonym in every document, two values never share one, and who holds the key
can go back. Mail addresses and access keys are permuted letter by letter class.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
PIECE = 64  # letters that are permuted at once
KINDS = ("email", "iban", "card", "phone", "ssn", "ip", "date", "secret")
DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


class Permutation:
    """A keyed permutation of 0..n-1 for any n: a Feistel network on a by b >= n cells, walked until inside.

    ``kind`` separates formats. ``walk`` goes on to the next value of the cycle
    while ``valid`` refuses it, which keeps the map one-to-one on valid values.
    """

    def __init__(self, key: bytes, kind: str, n: int):
        self.n = n
        self.a = max(1, isqrt(n))
        self.b = -(-n // self.a)
        self.key, self.tag = key, f"{kind}/{n}/".encode()
        self.width = (max(self.a, self.b).bit_length() + 7) // 8

    def _round(self, i: int, value: int, modulus: int) -> int:
        data = self.tag + bytes([i]) + value.to_bytes(self.width, "little")
        return int.from_bytes(blake2b(data, key=self.key, digest_size=32).digest(), "little") % modulus

    def _once(self, v: int, back: bool = False) -> int:
        left, right = divmod(v, self.b)
        sign = -1 if back else 1
        for i in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
            if i % 2:
                right = (right + sign * self._round(i, left, self.b)) % self.b
            else:
                left = (left + sign * self._round(i, right, self.a)) % self.a
        return left * self.b + right

    def __call__(self, v: int, back: bool = False, valid: Callable[[int], bool] | None = None) -> int:
        while True:
            v = self._once(v, back)
            if v < self.n and (valid is None or valid(v)):
                return v


@lru_cache(maxsize=4096)
def permutation(key: bytes, kind: str, n: int) -> Permutation:
    return Permutation(key, kind, n)


def luhn_digit(body: str) -> str:
    """The check digit that makes body + digit pass the Luhn test."""
    total = 0
    for i, c in enumerate(reversed(body)):
        v = int(c) * (2 - i % 2)
        total += v - 9 if v > 9 else v
    return str(-total % 10)


def permute_classes(key: bytes, kind: str, text: str, back: bool = False, hexadecimal: bool | None = None) -> str:
    """Permutes the letters and digits of ``text``, PIECE by PIECE, among all strings with the same classes in the same places.

    ``hexadecimal`` says whether ``text`` is all of HEX and is to stay so, or isn't and is to stay so; None is for no matter.
    """
    return "".join(_permute_piece(key, kind, text[i : i + PIECE], back, hexadecimal) for i in range(0, len(text), PIECE))


def _permute_piece(key: bytes, kind: str, text: str, back: bool, hexadecimal: bool | None) -> str:
    all_hex = hexadecimal is not None and all(c in HEX for c in text)
    # a piece of HEX in a text that isn't keeps to HEX, any other piece leaves it: so the text's own form can be read off its pseudonym
    classes = (HEX,) if hexadecimal else (DIGITS, HEX[10:]) if all_hex else (DIGITS, LOWER, UPPER)
    alphabets = [next((a for a in classes if c in a), "") for c in text]
    value, n = 0, 1
    for a, c in zip(alphabets, text):
        if a:
            value, n = value * len(a) + a.index(c), n * len(a)
    if n == 1:
        return text

    def letters(value: int) -> str:
        out = []
        for a, c in zip(reversed(alphabets), reversed(text)):
            if a:
                value, at = divmod(value, len(a))
                out.append(a[at])
            else:
                out.append(c)
        return "".join(reversed(out))

    valid = None if hexadecimal is not False or all_hex else lambda v: any(c not in HEX for c in letters(v))
    return letters(permutation(key, kind + ":" + "".join(a[:1] or c for a, c in zip(alphabets, text)), n)(value, back, valid))


def _digits(text: str) -> str:
    return "".join(c for c in text if c in DIGITS)


def _refill(form: str, digits: str) -> str:
    """``form`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c in DIGITS else c for c in form)


def card(key: bytes, text: str, back: bool = False) -> str | None:
    """13 to 19 digits with a right check digit: first digit and separators stay, the check digit is made anew."""
    d = _digits(text)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    inner = d[1:-1]
    body = d[0] + str(permutation(key, f"card{d[0]}", 10 ** len(inner))(int(inner), back)).zfill(len(inner))
    return _refill(text, body + luhn_digit(body))


def phone(key: bytes, text: str, back: bool = False) -> str | None:
    """Ten digits of the North American plan (area and exchange from 2 on), or 8 to 15 digits after another + code."""
    d = _digits(text)
    international = text.lstrip("(").startswith("+")
    if (len(d) == 10 and not international) or (len(d) == 11 and d[0] == "1"):
        head, d = d[:-10], d[-10:]
        if d[0] < "2" or d[3] < "2":
            return None
        v = ((int(d[:3]) - 200) * 800 + int(d[3:6]) - 200) * 10_000 + int(d[6:])
        v = permutation(key, "phone", 800 * 800 * 10_000)(v, back)
        v, line = divmod(v, 10_000)
        area, exchange = divmod(v, 800)
        return _refill(text, f"{head}{area + 200}{exchange + 200}{line:04d}")
    if international and 8 <= len(d) <= 15:
        inner = d[2:]
        return _refill(text, d[:2] + str(permutation(key, f"phone{d[:2]}", 10 ** len(inner))(int(inner), back)).zfill(len(inner)))
    return None


def _ssn_valid(v: int) -> bool:
    area, rest = divmod(v, 1_000_000)
    return area not in (0, 666) and area < 900 and rest // 10_000 > 0 and rest % 10_000 > 0


def ssn(key: bytes, text: str, back: bool = False) -> str | None:
    d = _digits(text)
    if len(d) != 9 or not _ssn_valid(int(d)):
        return None
    return _refill(text, f"{permutation(key, 'ssn', 10**9)(int(d), back, _ssn_valid):09d}")


def ip(key: bytes, text: str, back: bool = False) -> str | None:
    parts = text.split(".")
    if len(parts) != 4 or any(int(p) > 255 or str(int(p)) != p for p in parts):
        return None
    v = int.from_bytes(bytes(map(int, parts)), "big")
    return ".".join(map(str, permutation(key, "ip", 1 << 32)(v, back).to_bytes(4, "big")))


def date(key: bytes, text: str, back: bool = False) -> str | None:
    """Year-month-day, or day and month before the year (month first only where the other reading is no date)."""
    parts = re.split(r"[-/.]", text)
    nums = [int(p) for p in parts]
    orders = [(0, 1, 2)] if len(parts[0]) == 4 else [(2, 1, 0), (2, 0, 1)]
    for y, m, d in orders:
        try:
            day = datetime.date(nums[y], nums[m], nums[d]).toordinal()
        except ValueError:
            continue
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        month_first = (y, m, d) == (2, 0, 1)

        def same_form(v: int) -> bool:  # the pseudonym must be read in the same order again
            return not month_first or datetime.date.fromordinal(FIRST_DAY + v).day > 12

        new = datetime.date.fromordinal(FIRST_DAY + permutation(key, f"date{month_first}", LAST_DAY - FIRST_DAY + 1)(day - FIRST_DAY, back, same_form))
        out = list(parts)
        out[y], out[m], out[d] = f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}"
        separators = re.findall(r"[-/.]", text)
        return out[0] + separators[0] + out[1] + separators[1] + out[2]
    return None


def _iban_check(country: str, body: str) -> str:
    moved = body + country + "00"
    return f"{98 - int(''.join(str(int(c, 36)) for c in moved)) % 97:02d}"


def iban(key: bytes, text: str, back: bool = False) -> str | None:
    compact = text.replace(" ", "")
    if not 15 <= len(compact) <= 34 or _iban_check(compact[:2], compact[4:]) != compact[2:4]:
        return None
    body = permute_classes(key, "iban" + compact[:2], compact[4:], back)
    it = iter(compact[:2] + _iban_check(compact[:2], body) + body)
    return "".join(c if c == " " else next(it) for c in text)


def email(key: bytes, text: str, back: bool = False) -> str | None:
    """Local part and the domain's labels but the last are permuted by class; signs before the address aren't part of it."""
    local, _, domain = text.rpartition("@")
    labels, last = domain.rsplit(".", 1)
    name = local.lstrip(".+%_-")
    return local[: len(local) - len(name)] + permute_classes(key, "mail", name, back) + "@" + permute_classes(key, "domain", labels, back) + "." + last


def secret(key: bytes, text: str, back: bool = False) -> str | None:
    """Access keys after AKIA, and what follows password= or token =, up to its delimiter; signs stay."""
    if text[:4] in ("AKIA", "ASIA"):
        return text[:4] + permute_classes(key, "access", text[4:], back)
    head, value = re.match(r"(.*?[=:]\s?[\"']?)(.*)", text, re.DOTALL).groups()
    return head + permute_classes(key, "secret", value, back, hexadecimal=all(c in HEX for c in value))


FIND = re.compile(
    r"(?P<email>(?<![\w.+%-])[\w.+%-]++@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}\b)"
    r"|(?P<secret>\b(?:AKIA|ASIA)[A-Z0-9]{16}\b"
    # in quotes to the quote or white space, else to white space or the sign before another name=; the last letter or digit ends it
    r"|\b(?i:password|passwd|secret|token|api_key)[\"']?\s?[=:]\s?(?:\"[^\s\"]*[A-Za-z0-9]|'[^\s']*[A-Za-z0-9]|(?![\"'])(?:(?![&;,][A-Za-z_]\w*[=:])\S)*[A-Za-z0-9]))"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<date>(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}[./-]\d{2}[./-]\d{4})(?![\d/-]|\.\d))"
    r"|(?P<ip>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<phone>(?:(?<![\w+])\+\d{1,3}[ .-]?)?(?<!\d)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\w+])\+\d(?:(?:[ .-]?\(|\)[ .-]?|[ .-])?\d){7,14}(?!\d)|(?<![\d.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-]))"
    r"|(?P<card>(?<![\d-])(?:\d{13,19}|\d{4}(?P<gap>[ -])\d{4}(?P=gap)\d{4}(?P=gap)\d{1,7}|\d{4}[ -]\d{6}[ -]\d{4,5})(?![\d-]))",
    re.ASCII,
)
RULES = {"email": email, "secret": secret, "iban": iban, "date": date, "ip": ip, "ssn": ssn, "phone": phone, "card": card}
#: every form in FIND holds one of these
MAY_HOLD = re.compile(r"[0-9@=:]|A[KS]IA")


def pseudonymize(text: str, key: bytes, back: bool = False) -> tuple[str, dict[str, int]]:
    """The text with its personal data replaced, and how many of each kind; ``back`` undoes it."""
    counts: dict[str, int] = {}
    if not MAY_HOLD.search(text):
        return text, counts

    out, done, at = [], 0, 0
    while found := FIND.search(text, at):
        kind, whole = next(k for k in KINDS if found[k] is not None), found[0]
        at = found.end()
        # a number may be followed by another one: without its last groups it can be valid
        ends = [len(whole), *(m.start() for m in reversed(list(re.finditer(r"[ .-]", whole))))] if kind in ("phone", "card") else [len(whole)]
        for end in ends:
            tries = {k: RULES[k](key, whole[:end], back) for k in dict.fromkeys((kind, "card" if kind == "phone" else kind))}
            k = next((k for k, new in tries.items() if new is not None), None)
            if k is not None:
                counts[k] = counts.get(k, 0) + 1
                out += [text[done : found.start()], tries[k]]
                done = at = found.start() + end
                break
    return "".join([*out, text[done:]]), counts


def replace_personal_data(df: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """``df`` with personal data in ``text_col`` replaced, plus ``n_replaced`` and ``kinds`` (map of kind to count).

    Null texts stay null with nothing replaced. Whole texts are searched.
    Columns named n_replaced or kinds give way; one narrow pass, no shuffle.
    """
    kept = [c for c in df.columns if c not in ("n_replaced", "kinds")]
    source = df.select(*[F.col(f"`{c}`") for c in kept])
    at = kept.index(text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema) + ", n_replaced int, kinds map<string,int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, totals, kinds = [], [], []
            for text in batch.column(at).to_pylist():
                new, counts = (None, {}) if text is None else pseudonymize(text, key)
                texts.append(new)
                totals.append(sum(counts.values()))
                kinds.append(list(counts.items()))
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(totals, pa.int32()), pa.array(kinds, pa.map_(pa.string(), pa.int32()))], names=[*kept, "n_replaced", "kinds"]
            )

    return source.mapInArrow(run, schema)
