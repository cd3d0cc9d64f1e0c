"""Format-preserving pseudonyms: a keyed Feistel permutation within each value's own format.

A validated value becomes another valid value of its kind: a card number another with a right check
digit, a date another date. The permutation depends on the key and the kind only, so equal
values stay equal across documents whatever their separators, and different ones stay different.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
#: Values of more bits are permuted symbol by symbol instead of as one number.
LONG_BITS = 256
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")
HEX = ("0123456789abcdef",)


class Feistel:
    """Keyed permutations of the whole numbers below any size."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _stream(self, tweak: str, step: int, half: bytes, length: int) -> bytes:
        """So many bytes that depend on the key, the place in the network and all of a half."""
        head = f"{tweak}|{step}|{length}|".encode()
        return hashlib.shake_256(self.key + len(head).to_bytes(4, "big") + head + half).digest(length)

    def _round(self, tweak: str, step: int, size: int, half: int) -> int:
        """A number below ``size``; 128 bits more than it has are drawn, so none is likelier than another."""
        data = self._stream(f"{tweak}|{size:x}", step, half.to_bytes(half.bit_length() // 8 + 1, "big"), size.bit_length() // 8 + 17)
        return int.from_bytes(data, "big") % size

    def __call__(self, value: int, size: int, tweak: str) -> int:
        """The place of ``value`` in the permutation of ``range(size)`` that the tweak names.

        The value is a pair of two nearly equal halves; walking on until the pair is below ``size`` keeps
        the map one to one.
        """
        if size < 2:
            return value
        left_size = math.isqrt(size - 1) + 1
        right_size = -(-size // left_size)
        while True:
            left, right = divmod(value, right_size)
            for step in range(0, ROUNDS, 2):
                left = (left + self._round(tweak, step, left_size, right)) % left_size
                right = (right + self._round(tweak, step + 1, right_size, left)) % right_size
            value = left * right_size + right
            if value < size:
                return value

    def symbols(self, values: np.ndarray, sizes: np.ndarray, tweak: str) -> np.ndarray:
        """A permutation of sequences of any length, position ``i`` holding a number below ``sizes[i]``.

        The halves are those of the sequence. Every position of one half is shifted by a stream drawn from the
        whole other half, so each symbol comes to depend on all others, in time linear in the length.
        """
        values, middle = values.astype(np.uint64), len(values) // 2
        halves = [slice(0, middle), slice(middle, len(values))]
        for step in range(ROUNDS):
            own, other = halves[step % 2], halves[1 - step % 2]
            drawn = np.frombuffer(self._stream(tweak, step, values[other].astype(np.uint8).tobytes(), 8 * (own.stop - own.start)), dtype=">u8")
            values[own] = (values[own] + drawn % sizes[own]) % sizes[own]
        return values.astype(np.int64)


def luhn_digit(digits: str) -> str:
    """The check digit that completes a card number."""
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(digits)))
    return str(-total % 10)


def iban_check(country: str, account: str) -> str:
    """The two check digits of an account number."""
    number = int("".join(str(int(c, 36)) for c in account + country + "00"))
    return f"{98 - number % 97:02d}"


def filled(shape: str, characters: str, kind: str) -> str:
    """``shape`` with its characters of a kind replaced in order; separators stay in their places."""
    rest = iter(characters)
    return "".join(next(rest) if re.match(kind, c) else c for c in shape)


class Pseudonyms:
    """Finds, validates and permutes; ``replace`` gives the new text and how many values of each kind it held."""

    #: Days a permuted date may fall on.
    FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
    FINDER = re.compile(
        r"""(?P<email>(?<![\w.+-])[A-Za-z0-9](?:[\w.+-]*\w)?@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})
        |(?P<iban>(?<!\w)(?:[A-Z]{2}\d\d(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?
            |[a-z]{2}\d\d(?:[ ]?[a-z0-9]{4}){2,7}(?:[ ]?[a-z0-9]{1,3})?)(?!\w))
        |(?P<date>(?<![\w./-])(?:\d{4}-\d\d-\d\d|\d{4}/\d\d/\d\d|\d\d\.\d\d\.\d{4}|\d\d/\d\d/\d{4})(?=[Tt]\d\d|(?![\w/-]|\.\d)))
        |(?P<ssn>(?<![\w-])\d{3}-\d\d-\d{4}(?![\w-]))
        |(?P<ip>(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d))
        |(?P<phone>(?<![\w+])(?:(?:\+?1[ .-]?)?(?:\(\d{3}\)[ ]?|\d{3}[ .-])\d{3}[ .-]\d{4}
            |\+\d{1,3}(?:[ .-]?\(?\d{2,4}\)?){2,5})(?!\w))
        |(?P<card>(?<![\w.])\d(?:[ -]?\d){12,18}(?!\w|\.\d))
        |(?P<secret>(?<![\w])(?i:password|passwd|pwd|token|secret|api_?key)[ ]?[=:][ ]?["']?[A-Za-z0-9_+/-]{8,}["']?
            |(?<!\w)AKIA[A-Z0-9]{12,20}(?!\w))""",
        re.VERBOSE | re.ASCII,
    )
    KINDS = tuple(FINDER.groupindex)
    #: Where a value that was found too long may end instead: before these.
    BREAKS = {"iban": " ", "card": " -", "phone": " .-"}
    MAYBE = re.compile(r"\d\D{0,3}\d|@|AKIA|[=:]\s?[\"']?\S{8}", re.ASCII)

    def __init__(self, key: bytes):
        self.permute = Feistel(key)

    def _characters(self, value: str, tweak: str, classes: tuple[str, ...] = CLASSES) -> str:
        """Each letter or digit becomes one of its own class; other characters stay.

        Values of few bits are permuted as one number, longer ones as sequences of symbols.
        """
        of = {c: (i, at) for i, held in enumerate(classes) for at, c in enumerate(held)}
        places = [i for i, c in enumerate(value) if c in of]
        kinds, symbols = [of[value[i]][0] for i in places], [of[value[i]][1] for i in places]
        sizes = [len(classes[k]) for k in kinds]
        shape = list(value)
        for i, k in zip(places, kinds):
            shape[i] = f"\0{k}"
        tweak = f"{tweak}|{hashlib.blake2b(''.join(shape).encode('utf-8', 'surrogatepass')).hexdigest()}"
        if sum(n.bit_length() for n in sizes) > LONG_BITS:
            symbols = self.permute.symbols(np.array(symbols), np.array(sizes, dtype=np.uint64), tweak).tolist()
        else:
            number, size = 0, 1
            for n, at in zip(sizes, symbols):
                number, size = number * n + at, size * n
            number = self.permute(number, size, tweak)
            for j in range(len(sizes) - 1, -1, -1):
                number, symbols[j] = divmod(number, sizes[j])
        out = list(value)
        for i, k, at in zip(places, kinds, symbols):
            out[i] = classes[k][at]
        return "".join(out)

    def _digits(self, digits: str, tweak: str) -> str:
        return f"{self.permute(int(digits), 10 ** len(digits), f'{tweak}|{len(digits)}'):0{len(digits)}d}"

    def email(self, value: str) -> str:
        """The local part and all of the host but its last two labels."""
        local, host = value.rsplit("@", 1)
        labels = host.split(".")
        own = ".".join(labels[:-2]) if len(labels) > 2 else ""
        changed = self._characters(f"{local}@{own}".lower(), "email")
        local, own = changed.rsplit("@", 1)
        return f"{local}@" + ".".join([*([own] if own else []), *labels[-2:]])

    def card(self, value: str) -> str | None:
        digits = re.sub(r"\D", "", value)
        if not 13 <= len(digits) <= 19 or len(set(digits)) == 1 or luhn_digit(digits[:-1]) != digits[-1]:
            return None
        body = self._digits(digits[:-1], "card")
        return filled(value, body + luhn_digit(body), r"\d")

    def phone(self, value: str) -> str | None:
        digits = re.sub(r"\D", "", value)
        if not 7 <= len(digits) <= 15:
            return None
        # the country code, where there is one, stays; equal numbers with and without "+1" stay linked
        code = re.match(r"\+(\d{1,3})(?=[ .(-])", value)
        lead = code[1] if code else "1" if len(digits) == 11 and digits[0] == "1" else ""
        return filled(value, lead + self._digits(digits[len(lead):], "phone"), r"\d")

    def ip(self, value: str) -> str | None:
        parts = [int(p) for p in value.split(".")]
        if max(parts) > 255:
            return None
        number = self.permute(int.from_bytes(bytes(parts), "big"), 1 << 32, "ip")
        return ".".join(map(str, number.to_bytes(4, "big")))

    #: Orders of year, month and day by what a date looks like: the first that makes it a date counts.
    ORDERS = {
        "0000-00-00": ["%Y-%m-%d"], "0000/00/00": ["%Y/%m/%d"], "00.00.0000": ["%d.%m.%Y"], "00/00/0000": ["%m/%d/%Y", "%d/%m/%Y"],
    }

    def date(self, value: str) -> str | None:
        """Days up to the twelfth stay so, and later ones too: what 05/03 and 25/03 mean does not change."""
        for order in self.ORDERS[re.sub(r"\d", "0", value)]:
            parts = dict(zip(re.findall("%(.)", order), map(int, re.findall(r"\d+", value))))
            try:
                found = datetime.date(parts["Y"], parts["m"], parts["d"])
            except ValueError:
                continue
            if not self.FIRST_DAY <= found.toordinal() <= self.LAST_DAY:
                return None
            at = found
            while at is found or (at.day > 12) != (found.day > 12):  # walks on within the dates alike
                place = self.permute(at.toordinal() - self.FIRST_DAY, self.LAST_DAY - self.FIRST_DAY + 1, "date")
                at = datetime.date.fromordinal(self.FIRST_DAY + place)
            return order.replace("%Y", f"{at.year:04d}").replace("%m", f"{at.month:02d}").replace("%d", f"{at.day:02d}")
        return None

    @staticmethod
    def _social(number: int) -> bool:
        area, group, serial = number // 1_000_000, number // 10_000 % 100, number % 10_000
        return area not in (0, 666) and area < 900 and group > 0 and serial > 0

    def ssn(self, value: str) -> str | None:
        number = int(value.replace("-", ""))
        if not self._social(number):
            return None
        number = self.permute(number, 10**9, "ssn")
        while not self._social(number):  # walks on within the valid numbers
            number = self.permute(number, 10**9, "ssn")
        return filled(value, f"{number:09d}", r"\d")

    def iban(self, value: str) -> str | None:
        plain = value.replace(" ", "").upper()
        country, check, account = plain[:2], plain[2:4], plain[4:]
        if not 15 <= len(plain) <= 34 or iban_check(country, account) != check:
            return None
        account = self._characters(account, f"iban|{country}")
        new = filled(value, country + iban_check(country, account) + account, r"\w")
        return new.lower() if value[0].islower() else new

    def secret(self, value: str) -> str | None:
        if value.startswith("AKIA"):
            return "AKIA" + self._characters(value[4:], "secret")
        lead, body, tail = re.fullmatch(r"(\w+ ?[=:] ?[\"']?)(.*?)([\"']?)", value, re.DOTALL).groups()
        if not re.search(r"\d", body):
            return None  # an ordinary word
        if re.fullmatch("[0-9a-f]+", body):
            return lead + self._characters(body, "secret|hex", HEX) + tail
        return lead + self._characters(body, "secret") + tail

    def earlier(self, text: str, start: int, end: int, kind: str) -> int:
        """The last group boundary of a value before ``end``, or 0: what follows a value may look like more of it."""
        breaks = self.BREAKS.get(kind, "")
        while end > start and text[end - 1] not in breaks:
            end -= 1
        while end > start and text[end - 1] in breaks:
            end -= 1
        return end if end > start else 0

    def replace(self, text: str) -> tuple[str, dict[str, int]]:
        """The text with every validated value permuted; what fails validation stays as it is.

        The longest match is tried first, then its beginnings that end at a group boundary.
        """
        found: dict[str, int] = {}
        if not self.MAYBE.search(text):
            return text, found
        parts, last, at = [], 0, 0
        while match := self.FINDER.search(text, at):
            kind, end = match.lastgroup, match.end()
            change: Callable[[str], str | None] = getattr(self, kind)
            new = change(match[0])
            while new is None and (end := self.earlier(text, match.start(), end, kind)):
                new = change(text[match.start(): end])
            if new is None:  # another kind may begin within
                at = match.start() + 1
                while at < len(text) and text[at].isalnum() and text[at - 1].isalnum():
                    at += 1
                continue
            parts += [text[last: match.start()], new]
            last = at = end
            found[kind] = found.get(kind, 0) + 1
        return "".join(parts) + text[last:], found


def pseudonym_batches(key: bytes):
    """A ``mapInArrow`` function: ``doc_id, text`` -> the same with pseudonyms, and the values per kind."""

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key)
        for batch in batches:
            texts, counts = [], []
            for text in batch.column(1).to_pylist():
                new, found = names.replace(text) if text else (text, {})
                texts.append(new)
                counts.append(found)
            columns = [pa.array([c.get(k, 0) for c in counts], pa.int32()) for k in Pseudonyms.KINDS]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), *columns],
                names=["doc_id", "text", *(f"n_{k}" for k in Pseudonyms.KINDS)],
            )

    return change


def pseudonymise_documents(documents: DataFrame, key: bytes) -> DataFrame:
    """``doc_id``, the text with pseudonyms, and how many values of each kind were permuted (``n_email``, ...).

    Kinds: addresses of mail, account numbers (IBAN), calendar dates, social security numbers, IPv4
    addresses, telephone numbers, card numbers, and credentials. Account numbers may be in
    small letters; dates are year-month-day, day.month.year or month/day/year, else day/month/year. Numbers with a wrong check
    digit, impossible dates and the like are no such values and stay. A value of any length is permuted as a whole. The key alone decides the pseudonyms; keep it secret. A NULL
    text stays NULL, an empty one empty; one narrow pass, whole texts; repeated rows change alike.
    """
    fields = ", ".join(f"n_{k} int" for k in Pseudonyms.KINDS)
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        pseudonym_batches(key), f"doc_id long, text string, {fields}"
    )
