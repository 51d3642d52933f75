r"""Personal data by anchor expansion.

An Aho-Corasick automaton passes over each text once and finds anchors: at-signs, plus signs, digits, schemes and
identifier cues. From an anchor, a deterministic local parser expands to the boundaries and validates them:

* email, ip, card, phone: the base kinds, leftmost and non-overlapping within their kind; a match that fails its check
  is dropped without a retry. A parser starts where a leftmost match can start: at the first digit of a run, at a plus
  sign, or at the leftmost local character before an at-sign.
* secret: a cue such as ``token`` or ``password``, then ``=`` or ``:`` (after ``bearer`` a space), then a value of 12 or more
  characters that holds a digit.
* account: a cue such as ``iban`` or ``account``, then an IBAN that passes mod 97, or 6 to 17 digits.
* login: user information before the host of an address (``scheme://user:secret@host``).

Edge cases: null and empty texts have no spans (and the hash of the empty string); texts of any length are read whole,
in one pass, and each parser is linear (it never goes back over what a class of characters took); cues fit in any
casing; ids are integers; repeated rows are treated alike; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_batches

#: Fixed by the contract: local characters of an email, the domain after it, and the digit kinds.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone", "secret", "account", "login")
BASE = 4

#: In lower case; any casing of the text fits.
SECRET_CUES = ("token", "password", "passwd", "pwd", "secret", "api_key", "apikey", "api key", "api-key", "access_key", "access key", "access-key", "private_key")
BEARER_CUES = ("bearer",)
ACCOUNT_CUES = ("iban", "account", "acct", "konto", "compte", "cuenta")
_SECRET = re.compile(r"[\"']?[\x20]*+[=:][\x20]*+[\"']?(?=[A-Za-z0-9+/_.-]*[0-9])([A-Za-z0-9+/_.-]{12,})")
_BEARER = re.compile(r"[\x20]++(?=[A-Za-z0-9+/_.=-]*[0-9])([A-Za-z0-9+/_.=-]{12,})")
_IBAN = re.compile(r"[\x20:=#]*+([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"[\x20]*+(?:number|num|no|nr)?+[.\x20:=#]*+([0-9]{6,17})(?![A-Za-z0-9])", re.I)
_LOGIN = re.compile(r"[^\s/?#@:]+:[^\s/?#@]+(?=@[A-Za-z0-9])")
_DIGITS = "0123456789"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@lru_cache(1)
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for d in _DIGITS:
        a.add_word(d, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    a.add_word("://", ("scheme", 3))
    for kind, cues in (("secret", SECRET_CUES), ("bearer", BEARER_CUES), ("account", ACCOUNT_CUES)):
        for cue in cues:
            a.add_word(cue, (kind, len(cue)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end), sorted."""
    out: list[tuple[int, int, int]] = []
    email_end = ip_end = card_end = phone_end = secret_end = account_end = 0
    lower = text.lower()  # as long as the text, but for one letter whose lower case is two characters
    for at, (anchor, n) in automaton().iter(lower if len(lower) == len(text) else text.translate(_LOWER)):
        if anchor == "digit":
            if at and text[at - 1] in _DIGITS:
                continue
            if at >= ip_end and (m := IP.match(text, at)):
                ip_end = m.end()
                if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split(".")):
                    out.append((at, 1, ip_end))
            if at >= card_end and (m := CARD.match(text, at)):
                card_end = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((at, 2, card_end))
        elif anchor == "plus":
            if at >= phone_end and (m := PHONE.match(text, at)):
                phone_end = m.end()
                if 9 <= sum(c in _DIGITS for c in m[0]) <= 15:
                    out.append((at, 3, phone_end))
        elif anchor == "at":
            start = at
            while start > email_end and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                email_end = m.end()
                out.append((start, 0, email_end))
        elif anchor == "scheme":
            if m := _LOGIN.match(text, at + 1):
                out.append((at + 1, 6, m.end()))
        elif anchor in ("secret", "bearer"):
            if at >= secret_end and (m := (_SECRET if anchor == "secret" else _BEARER).match(text, at + 1)):
                secret_end = m.end()
                out.append((m.start(1), 4, secret_end))
        elif at >= account_end:
            m = _IBAN.match(text, at + 1)
            m = m if m and mod97(m[1]) else _ACCOUNT.match(text, at + 1)
            if m:
                account_end = m.end(1)
                out.append((m.start(1), 5, account_end))
    return sorted(out)


def find_pii(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a count for each kind, n_spans (all kinds), base_sha256 and spans, a row for each document."""
    names = ["doc_id", *[f"n_{k}" for k in KINDS], "n_spans", "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            shas, joined = [], []
            for text in batch.column(1):
                found = spans(text.as_py() or "")
                for k, into in enumerate(counts):
                    into.append(sum(x[1] == k for x in found))
                written = [f"{KINDS[k]}:{a}:{b}" for a, k, b in found]
                base = ",".join(w for w, x in zip(written, found, strict=True) if x[1] < BASE)
                shas.append(hashlib.sha256(base.encode()).hexdigest())
                joined.append(",".join(written))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array([sum(c) for c in zip(*counts, strict=True)], pa.int64()), pa.array(shas, pa.string()), pa.array(joined, pa.string())], names)

    schema = ", ".join(["doc_id long", *[f"n_{k} long" for k in KINDS], "n_spans long", "base_sha256 string", "spans string"])
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).transform(over_batches, run, schema)
