"""PII: format-preserving pseudonyms from a keyed Feistel permutation.

A value is found by its shape, validated (check digits, calendar, number plan, octets), turned into an
integer inside the set of valid values of its format, permuted by a Feistel network with cycle walking
and written back in the same format. The permutation depends on the key and on the format only, so equal
values get equal pseudonyms in every document, different values different ones, and the holder of the
key can invert them. Digits that don't validate (a wrong check digit, 31 February) are not touched. No
value is too long to be found.

Covered:

* card numbers (Luhn), IBANs (mod 97), US social security numbers, phone numbers, IPv4 and IPv6 addresses;
* dates (ISO, slashes, dots): a day has one pseudonym in whatever form it is written;
* e-mail addresses: the mailbox, whose domain stays;
* secrets that are known by their form: access key ids (AKIA, ASIA), tokens with a vendor's prefix (``ghp_``, ``sk_live_``,
  ``xoxb-``, ``AIza``, ``glpat-`` and the like), JSON web tokens (header stays, payload and signature change);
* values assigned to password, passwd, pwd, passphrase, secret, token, api key, access key, private key and compounds of these:
  anything in quotes, anything of 6 or more characters behind ``=``, and behind ``:`` a value of 6 or more that isn't a plain word
  (a digit, a sign or capitals inside). So prose such as "the secret: everything" stays.

Letters of a secret stay letters of their case, digits digits, other characters themselves.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import ipaddress
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm import common

#: For examples and tests; a deployment passes its own key.
DEMO_KEY = b"corvane demo key, replace in production"
ROUNDS = 10


class Feistel:
    """A keyed permutation of range(size): balanced Feistel network, cycle walking down to the range."""

    def __init__(self, key: bytes, tweak: str, size: int):
        self.size, self.half = size, max(1, ((size - 1).bit_length() + 1) // 2)
        self.mask, self.width = (1 << self.half) - 1, (self.half + 7) // 8
        self.key, self.tweak = hashlib.blake2b(key, digest_size=32).digest(), tweak.encode()

    def _f(self, i: int, x: int) -> int:
        data = self.tweak + b"\0" + bytes([i]) + x.to_bytes(self.width, "big")
        if self.width <= 56:
            h = hashlib.blake2b(data, key=self.key, digest_size=self.width + 8).digest()
        else:  # as many bytes as the half is wide
            h = hashlib.shake_256(self.key + data).digest(self.width + 8)
        return int.from_bytes(h, "big") & self.mask

    def _step(self, x: int, forward: bool) -> int:
        left, right = x >> self.half, x & self.mask
        for i in range(ROUNDS) if forward else reversed(range(ROUNDS)):
            left, right = (right, left ^ self._f(i, right)) if forward else (right ^ self._f(i, left), left)
        return left << self.half | right

    def walk(self, x: int, valid: Callable[[int], bool] | None = None, forward: bool = True) -> int:
        """The image of x; with valid, a permutation of the values for which valid holds (x must be one)."""
        while True:
            x = self._step(x, forward)
            if x < self.size and (valid is None or valid(x)):
                return x


def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def luhn(digits: str) -> bool:
    return luhn_digit(digits[:-1]) == digits[-1]


def _refill(pattern: str, digits: str) -> str:
    """pattern with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in pattern)


_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_HEX, _HEXU, _ALNUM = "0123456789abcdef", "0123456789ABCDEF", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_EPOCH, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

#: Characters that are permuted as one value; longer ones are permuted in blocks of so many.
BLOCK = 256

_NAME = r"(?:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|secret[_-]?key|private[_-]?key|client[_-]?secret)"
_PREFIX = (
    r"gh[pousr]_|github_pat_|glpat-|[spr]k_(?:live|test)_|whsec_|xox[abeoprs]-|AIza|ya29\.|npm_|pypi-|dop_v1_|hf_|shpat_|SG\.|sk-(?:[a-z]+-)*"
)
PATTERN = re.compile(
    rf"""
    (?P<secret>(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{{16}}(?![A-Za-z0-9]))
    |(?P<jwt>(?<![\w-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*(?![\w-]))
    |(?P<vendor>(?<![\w-])(?P<prefix>{_PREFIX})[A-Za-z0-9_.-]{{15,}}[A-Za-z0-9_-])
    |(?P<assigned>(?<![A-Za-z])(?i:{_NAME})["']?[ ]*(?:(?P<quoted>[:=][ ]*["'])(?P<inside>[^"'\s][^"'\r\n]*)(?=["'])|(?P<equals>=[ ]*)(?P<bare>[^\s"'<>,;&=]{{6,}})|(?P<colon>:[ ]*)(?P<odd>[^\s"'<>,;&=]{{6,}})))
    |(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9][A-Za-z0-9-]*\.)+[A-Za-z]{{2,}}(?![A-Za-z0-9]))
    |(?P<iban>(?<![A-Za-z0-9])[A-Z]{{2}}[0-9]{{2}}(?:[ ]?[A-Z0-9]{{4}}){{2,7}}(?:[ ]?[A-Z0-9]{{1,3}})?(?![A-Za-z0-9]))
    |(?P<phone>(?<![\w+])\+1[ .-]?(?:\([0-9]{{3}}\)|[0-9]{{3}})[ .-]?[0-9]{{3}}[ .-]?[0-9]{{4}}(?![0-9])
      |(?<![\w+])\+[0-9]{{1,3}}[ .-]?\(?[0-9]{{1,4}}\)?(?:[ .-]?[0-9]{{2,4}}){{2,4}}(?![0-9]|[.:/-][0-9])
      |(?<![\w(])\(?[0-9]{{3}}\)?[ .-][0-9]{{3}}[.-][0-9]{{4}}(?![\w-]))
    |(?P<ip>(?<![\w.])[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}}(?!\.?[\w]))
    |(?P<six>(?<![\w:.])(?:[0-9A-Fa-f]{{1,4}}:){{2,7}}(?::?[0-9A-Fa-f]{{1,4}})(?::[0-9A-Fa-f]{{1,4}})*(?![\w:]|\.[0-9])|(?<![\w:.])[0-9A-Fa-f]{{1,4}}::(?:[0-9A-Fa-f]{{1,4}}:)*[0-9A-Fa-f]{{1,4}}(?![\w:]|\.[0-9]))
    |(?P<iso>(?<![\w-])[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}(?![0-9-]))
    |(?P<ssn>(?<![\w-])[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![\w-]))
    |(?P<slash>(?<![\w/])[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}(?![\w/]))
    |(?P<dot>(?<![\w.])[0-9]{{1,2}}\.[0-9]{{1,2}}\.[0-9]{{4}}(?![\w]))
    |(?P<card>(?<![\w-])(?:[0-9]{{13,19}}|[0-9]{{4}}(?P<gap>[ -])[0-9]{{4}}(?P=gap)[0-9]{{4}}(?P=gap)[0-9]{{1,7}}|[0-9]{{4}}(?P<wide>[ -])[0-9]{{6}}(?P=wide)[0-9]{{4,5}})(?![\w]))
    """,
    re.VERBOSE | re.ASCII,
)
_KINDS = ("email", "card", "phone", "assigned", "secret", "vendor", "jwt", "ip", "six", "iban", "iso", "ssn", "slash", "dot")
#: A text without any of these holds nothing that PATTERN finds.
_HINT = re.compile(r"[0-9@]|AKIA|ASIA|eyJ|[_.-](?=[A-Za-z0-9_.-]{15})|::|passw|pwd|passphrase|secret|token|key", re.IGNORECASE)
#: A value behind a colon that is more than a plain word.
_ODD = re.compile(r"[0-9]|[a-z][A-Z]|[A-Za-z0-9][^A-Za-z0-9\s]+[A-Za-z0-9]")


_RUN = re.compile(r"[^A-Za-z0-9]*[A-Za-z0-9]*")
_SEPARATOR = re.compile(r"[ .-]")


def _parts(found: str) -> list[str]:
    """found and its beginnings that end before a separator, the longest first: digits that follow a number may be another."""
    return [found, *[found[: m.start()] for m in reversed(list(_SEPARATOR.finditer(found)))]]


def _date(text: str, order: str) -> datetime.date | None:
    parts = dict(zip(order, map(int, re.split(r"[-/.]", text)), strict=True))
    try:
        day = datetime.date(parts["y"], parts["m"], parts["d"])
    except ValueError:
        return None
    return day if _EPOCH <= day.toordinal() <= _LAST else None


class Pseudonymiser:
    """Replaces what it validates; ``forward=False`` restores it."""

    def __init__(self, key: bytes = DEMO_KEY, forward: bool = True):
        self.key, self.forward, self._networks = key, forward, {}

    def _permute(self, tweak: str, size: int, x: int, valid: Callable[[int], bool] | None = None) -> int:
        network = self._networks.get((tweak, size))
        if network is None:
            network = self._networks[tweak, size] = Feistel(self.key, tweak, size)
            if len(self._networks) > 4096:
                self._networks.clear()
        return network.walk(x, valid, self.forward)

    def _digits(self, tweak: str, digits: str, valid: Callable[[str], bool] | None = None) -> str:
        n = len(digits)
        check = None if valid is None else lambda x: valid(str(x).zfill(n))
        return str(self._permute(f"{tweak}{n}", 10**n, int(digits), check)).zfill(n)

    def _characters(self, tweak: str, text: str, alphabets: list[str]) -> str:
        """Permutes text among the strings whose i-th character is of the i-th alphabet, BLOCK characters at once."""
        out = []
        for lo in range(0, len(text), BLOCK):
            some, part = alphabets[lo : lo + BLOCK], []
            x, size = 0, 1
            for c, a in zip(text[lo : lo + BLOCK], some, strict=True):
                x, size = x * len(a) + a.index(c), size * len(a)
            if size > 1:
                shape = hashlib.blake2b("|".join(some).encode(), digest_size=8).hexdigest()
                x = self._permute(f"{tweak}{lo or ''}{shape}", size, x)
            for a in reversed(some):
                x, r = divmod(x, len(a))
                part.append(a[r])
            out += reversed(part)
        return "".join(out)

    def _by_class(self, tweak: str, text: str) -> str:
        """Letters stay letters of their case, digits digits, anything else itself."""
        kinds = [next((a for a in _CLASSES if c in a), c) for c in text]
        return self._characters(tweak, text, kinds)

    # each method returns the pseudonym, or None if the match isn't valid

    def card(self, m: str) -> str | None:
        digits = re.sub(r"\D", "", m)
        if not 13 <= len(digits) <= 19 or not luhn(digits) or len(set(digits)) == 1:
            return None
        new = self._digits("card", digits[:-1], lambda d: len(set(d + luhn_digit(d))) > 1)
        return _refill(m, new + luhn_digit(new))

    def ssn(self, m: str) -> str | None:
        def valid(d: str) -> bool:
            return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"

        digits = m.replace("-", "")
        return _refill(m, self._digits("ssn", digits, valid)) if valid(digits) else None

    def phone(self, m: str) -> str | None:
        national = re.sub(r"\D", "", m)
        code = ""
        if m.startswith("+"):
            first = re.match(r"\+([0-9]{1,3}?)(?=[ .(-])|\+(1(?=[0-9]{10}$)|[0-9]{2})", m)
            code = (first[1] or first[2]) if first else ""
            national = national[len(code) :]
        if not 6 <= len(national) <= 14 or len(national) + len(code) > 15:
            return None

        def plan(d: str) -> bool:  # North American: area and exchange don't start with 0 or 1
            return len(d) == 10 and d[0] in "23456789" and d[3] in "23456789"

        inside = plan(national)
        new = self._digits(f"phone{inside}", national, lambda d: plan(d) == inside)
        return _refill(m, code + new)

    def ip(self, m: str) -> str | None:
        octets = m.split(".")
        if any(int(o) > 255 or (len(o) > 1 and o[0] == "0") for o in octets):
            return None
        x = self._permute("ip", 1 << 32, int.from_bytes(bytes(map(int, octets)), "big"))
        return ".".join(map(str, x.to_bytes(4, "big")))

    def six(self, m: str) -> str | None:
        try:
            address = ipaddress.IPv6Address(m)
        except ValueError:
            return None
        # pairs of words with a double colon between are code, and loopback is nobody's
        if not any(c.isdigit() for c in m) or m.count(":") < 3 and "::" in m and not m[0].isdigit() and not m.startswith(("fe80", "fc", "fd")) or int(address) < 2:
            return None
        new = ipaddress.IPv6Address(self._permute("ip6", 1 << 128, int(address), lambda x: x > 1))
        text = str(new)
        return text.upper() if m != m.lower() else text

    def _day(self, m: str, order: str) -> str | None:
        """The same day has the same pseudonym in all forms. Days up to the 12th stay such, the others others, so that
        what can be read month first or day first goes on being read the same way."""
        day = _date(m, order)
        if day is None:
            return None
        late = day.day > 12
        x = self._permute("date", _LAST - _EPOCH + 1, day.toordinal() - _EPOCH, lambda x: (datetime.date.fromordinal(_EPOCH + x).day > 12) == late)
        new = datetime.date.fromordinal(_EPOCH + x)
        separator = re.search(r"[-/.]", m)[0]
        padded = bool(re.search(r"(?<![0-9])0", m)) or all(len(p) > 1 for p in re.split(r"[-/.]", m))
        form = {"y": f"{new.year:04d}", "m": f"{new.month:02d}" if padded else str(new.month), "d": f"{new.day:02d}" if padded else str(new.day)}
        return separator.join(form[c] for c in order)

    def iso(self, m: str) -> str | None:
        return self._day(m, "ymd")

    def dot(self, m: str) -> str | None:
        return self._day(m, "dmy")

    def slash(self, m: str) -> str | None:
        """Month first where that is a date, else day first."""
        return self._day(m, "mdy") or self._day(m, "dmy")

    def iban(self, m: str) -> str | None:
        text = m.replace(" ", "")
        if not 15 <= len(text) <= 34 or self._mod97(text[4:] + text[:4]) != 1:
            return None
        new = self._by_class("iban", text[4:])
        check = 98 - self._mod97(new + text[:2] + "00")
        it = iter(f"{text[:2]}{check:02d}{new}")
        return "".join(c if c == " " else next(it) for c in m)

    @staticmethod
    def _mod97(text: str) -> int:
        return int("".join(str(int(c, 36)) for c in text)) % 97

    def email(self, m: str) -> str | None:
        local, _, domain = m.rpartition("@")
        return f"{self._by_class('email', local)}@{domain}"

    def secret(self, m: str) -> str:
        return m[:4] + self._characters("key", m[4:], [_ALNUM] * 16)

    def _secret(self, value: str) -> str:
        for alphabet in (_HEX, _HEXU):
            if any(c.isdigit() for c in value) and all(c in alphabet for c in value):
                return self._characters("hex", value, [alphabet] * len(value))
        return self._by_class("secret", value)

    def vendor(self, m: str, prefix: str) -> str | None:
        value = m[len(prefix) :]
        return prefix + self._secret(value) if any(c.isdigit() for c in value) else None

    def jwt(self, m: str) -> str | None:
        head, payload, signature = m.split(".")
        try:
            if not base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)).startswith(b"{"):
                return None
        except ValueError:
            return None
        return ".".join([head, self._by_class("jwt", payload), self._by_class("jwt", signature)])

    def assigned(self, m: str, value: str, plain: bool) -> str | None:
        """m, which ends in value; plain: a mere word isn't taken for a secret."""
        if plain and not _ODD.search(value) or not re.search(r"[A-Za-z0-9]", value):
            return None
        own = PATTERN.fullmatch(value)  # a secret of a known form has the pseudonym that it has elsewhere
        if own and own["vendor"]:
            new = self.vendor(value, own["prefix"])
        else:
            new = self.secret(value) if own and own["secret"] else self.jwt(value) if own and own["jwt"] else None
        return m[: len(m) - len(value)] + (new or self._secret(value))

    def replace(self, text: str) -> tuple[str, int]:
        """(text with pseudonyms, how many values were replaced)."""
        if not _HINT.search(text):
            return text, 0
        count, at, done, out = 0, 0, 0, []
        while match := PATTERN.search(text, at):
            kind, found = next(k for k in _KINDS if match[k] is not None), match[0]
            start = match.start()
            new, part = None, found
            if kind == "assigned":
                value = match["inside"] or match["bare"] or match["odd"]
                if match["inside"] is None:  # what ends a sentence isn't part of the value
                    value = value.rstrip(".,:!?)]}")
                    part = found[: len(found) - len(match["bare"] or match["odd"]) + len(value)]
                new = self.assigned(part, value, match["odd"] is not None) if len(value) >= (1 if match["inside"] else 6) else None
            elif kind == "vendor":
                new = self.vendor(found, match["prefix"])
            else:
                for part in _parts(found) if kind in ("phone", "iban") else (found,):
                    new = getattr(self, kind)(part)
                    if new is not None:
                        break
            if new is None:  # behind the first run of letters and digits of a spaced form another value may begin
                at = start + (_RUN.match(found).end() if kind in ("phone", "iban", "card", "assigned", "vendor", "jwt", "six") else len(found))
                continue
            out += [text[done:start], new]
            done = at = start + len(part)
            count += 1
        return "".join([*out, text[done:]]), count


def pseudonymise(docs: DataFrame, key: bytes = DEMO_KEY, text_col: str = "text", count_col: str | None = "n_replaced", forward: bool = True) -> DataFrame:
    """docs with pseudonyms in the text column and, unless None, the number of replaced values.

    Every row comes back, repeated ones too; null and empty texts stay as they are, with 0 replaced. If docs
    has a column of the name in count_col, it is replaced. An empty table gives an empty result.
    """
    kept = docs.drop(count_col) if count_col and count_col in docs.columns else docs
    names = kept.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = Pseudonymiser(key, forward)
        for batch in batches:
            done = [(None, 0) if t is None else worker.replace(t) for t in batch.column(at).to_pylist()]
            columns = [pa.array([t for t, _ in done], pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            if count_col:
                columns.append(pa.array([n for _, n in done], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *([count_col] if count_col else [])])

    schema = T.StructType(list(kept.schema.fields) + ([T.StructField(count_col, T.LongType())] if count_col else []))
    return kept.mapInArrow(run, schema)


def pseudonymise_documents(docs: DataFrame, key: bytes = DEMO_KEY) -> DataFrame:
    """docs with the same columns; n_chars, where it is a column, is the length of the new text.

    Every row comes back; null texts and their n_chars stay; other columns stay whatever their names; an empty table
    stays empty."""
    out = pseudonymise(docs, key, count_col=None)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out


def replaced(docs: DataFrame, key: bytes = DEMO_KEY) -> DataFrame:
    """(doc_id, n_replaced, text) of every row."""
    return pseudonymise(docs.select(common.col("doc_id").cast("long").alias("doc_id"), "text"), key).select("doc_id", "n_replaced", "text")
