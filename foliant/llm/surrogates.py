"""Personal data replaced by surrogates: keyed, of the same type and format, one for each entity.

Entities are found with patterns for each type. A surrogate is a keyed permutation of the
entity's letters and digits inside their alphabet (so script, case, length and separators
stay): a Feistel network on the mixed-radix number they spell. Numbers with a check digit
keep a valid one, addresses their public or private kind, names their title's gender: given
names are permuted within a list for the gender. A permutation gives different entities
different surrogates, and the same entity the same one wherever and however it is written.

A job checks this over the distinct entities of the whole corpus: an entity whose surrogate
is another one's, or is itself an entity of the corpus, takes the permutation of its next
attempt, until all differ (an entity of the corpus is avoided for ``ROUNDS`` rounds at
most: small ranges can be full). Only entities with another attempt than the first are joined
back to the texts.

Defined results: null and empty texts stay as they are; equal rows get equal texts; an empty
table gives no rows; extra columns are kept; without an entity a text is unchanged.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from foliant.llm.common import doc_rows, stored
from foliant.llm.words import batches

ROUNDS = 4

MALE = ("James", "Robert", "John", "Michael", "David", "Thomas", "Daniel", "Paul", "Karl", "Hans", "Peter", "Pierre", "Louis", "Jean", "Carlos", "Luis", "Miguel", "Pablo", "Simon", "Victor")
FEMALE = ("Mary", "Anna", "Linda", "Susan", "Laura", "Emma", "Julia", "Clara", "Helga", "Greta", "Ingrid", "Marie", "Claire", "Louise", "Carmen", "Lucia", "Elena", "Sofia", "Alice", "Nora")
_MR = r"Mr\.?|Sir|Herrn?|Monsieur|Señor|Sr\."
_MS = r"Mrs\.?|Ms\.?|Miss|Frau|Madame|Mme|Mlle|Señora|Sra\."
_NAME = r"[^\W\d_][^\W\d_'’-]+"

#: type: (text that must be there for the pattern to be tried, pattern). The first group, if any, is the entity.
PATTERNS = {
    "email": ("@", re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")),
    "key": ("", re.compile(r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|\bghp_[A-Za-z0-9]{36}\b|\bsk-[A-Za-z0-9]{20,}\b")),
    "secret": ("", re.compile(r"(?i)\b(?:password|passwd|pwd|secret|api_?key|token)\s?[=:]\s?([^\s,;\"']{4,})")),
    "ip": (".", re.compile(r"(?<![\d.])((?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d))(?!\.?\d)")),
    "ssn": ("-", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")),
    "phone": ("", re.compile(r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d.-])\d{3}-\d{3}-\d{4}(?![\d-])")),
    "card": ("", re.compile(r"(?<![\d.-])(?:\d[ -]?){12,18}\d(?![\d-])")),
    "man": ("", re.compile(rf"\b(?:{_MR}) ((?:{_NAME} ){{0,2}}{_NAME})")),
    "woman": ("", re.compile(rf"\b(?:{_MS}) ((?:{_NAME} ){{0,2}}{_NAME})")),
}
_DIGIT = re.compile(r"\d")
_TITLE = re.compile(rf"\b(?:{_MR}|{_MS}) ")
_ALPHABETS = tuple(
    "".join(map(chr, range(a, b + 1))) for a, b in ((48, 57), (97, 122), (0x3B1, 0x3C9), (0x430, 0x44F), (0x5D0, 0x5EA), (0x627, 0x64A), (0x3041, 0x3096), (0x30A1, 0x30FA))
) + ("àâäáãåæçéèêëíìîïñóòôöõøúùûüýÿß",)
_ALPHABET_OF = {c: alphabet for alphabet in _ALPHABETS for c in alphabet}


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the others."""
    total = 0
    for i, digit in enumerate(reversed(digits)):
        doubled = int(digit) * (1 + i % 2)
        total += doubled - 9 * (doubled > 9)
    return total % 10 == 0


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, type) of the entities of ``text``, in order, none over another; earlier types and longer ones first."""
    found = []
    digits, titles = _DIGIT.search(text) is not None, _TITLE.search(text) is not None
    for kind, (need, pattern) in PATTERNS.items():
        if need not in text or kind in ("ip", "ssn", "phone", "card") and not digits or kind in ("man", "woman") and not titles:
            continue
        for m in pattern.finditer(text):
            start, end = m.span(m.lastindex or 0)
            if kind == "card" and not (luhn(d := re.sub(r"\D", "", m[0])) or len(d) == 16):
                continue
            if kind in ("man", "woman"):
                words = m[1].split(" ")
                n = next((i for i, w in enumerate(words) if not w[0].isupper() and w[0].lower() != w[0].upper()), len(words))
                if not n:
                    continue
                end = start + len(" ".join(words[:n]))
            if not any(a < end and start < b for a, b, _ in found):
                found.append((start, end, kind))
    return sorted(found)


def canonical(kind: str, value: str) -> str:
    """How every spelling of one entity is written."""
    if kind in ("phone", "card", "ssn"):
        return re.sub(r"\D", "", value)
    return value.lower() if kind in ("email", "man", "woman") else value


def _permuted(number: int, size: int, key: bytes) -> int:
    """A keyed permutation of 0 .. size - 1: Feistel rounds, repeated until the result is in range."""
    if size < 2:
        return number
    half = max(1, (size - 1).bit_length() + 1) // 2
    mask, length = (1 << half) - 1, (half + 7) // 8
    while True:
        left, right = number >> half, number & mask
        for round_ in range(8):
            drawn = hashlib.blake2b(right.to_bytes(length, "big"), key=key, digest_size=min(64, length), person=bytes([round_])).digest()
            while len(drawn) < length:
                drawn += hashlib.blake2b(drawn, key=key, digest_size=64, person=bytes([round_])).digest()
            left, right = right, left ^ (int.from_bytes(drawn[:length], "big") & mask)
        number = left << half | right
        if number < size:
            return number


def _letters(text: str, key: bytes, alphabets: dict[str, str] = _ALPHABET_OF) -> str:
    """The characters of known alphabets permuted together; case and all else stay."""
    low = [c.lower() if len(c.lower()) == 1 else c for c in text]
    number, size = 0, 1
    for c in low:
        if alphabet := alphabets.get(c):
            number, size = number * len(alphabet) + alphabet.index(c), size * len(alphabet)
    number, out = _permuted(number, size, key), []
    for c, old in zip(reversed(low), reversed(text)):
        if alphabet := alphabets.get(c):
            number, place = divmod(number, len(alphabet))
            c = alphabet[place]
            out.append(c.upper() if old != old.lower() and len(c.upper()) == 1 else c)
        else:
            out.append(old)
    return "".join(reversed(out))


def _key(secret: str, kind: str, attempt: int, more: str = "") -> bytes:
    return hashlib.blake2b(f"{kind}/{attempt}/{more}".encode(), key=secret.encode()[:64], digest_size=32).digest()


_HEX = {c: "0123456789abcdef" for c in "0123456789abcdef"}


def surrogate(kind: str, value: str, secret: str, attempt: int = 0) -> str:
    """The replacement of ``value`` in its own format; equal for all spellings of an entity."""
    key = _key(secret, kind, attempt)
    if kind == "email":
        local, _, domain = value.rpartition("@")
        host, _, top = domain.rpartition(".")
        return f"{_letters(local, _key(secret, kind, attempt, domain.lower()))}@{_letters(host, _key(secret, 'host', attempt, top.lower()))}.{top}"
    if kind == "key":
        head = 3 if value.startswith("sk-") else 4
        return value[:head] + _mixed(value[head:], key)
    if kind == "secret":
        return _letters(value, key, _HEX) if re.fullmatch("[0-9a-f]+", value) else _mixed(value, key)
    if kind == "ip":
        number = int.from_bytes(bytes(map(int, value.split("."))), "big")
        kept, out = _private(number), _permuted(number, 1 << 32, key)
        while _private(out) != kept:
            out = _permuted(out, 1 << 32, key)
        return ".".join(map(str, out.to_bytes(4, "big")))
    if kind in ("phone", "card", "ssn"):
        digits = re.sub(r"\D", "", value)
        head = 0 if len(digits) < 11 else 1 if digits[0] == "1" else 2  # the country's code stays
        if kind == "card":
            new = _card(digits, key)
        else:
            head = 0 if kind == "ssn" else head
            new = digits[:head] + _letters(digits[head:], _key(secret, kind, attempt, digits[:head]))
        fresh = iter(new)
        return "".join(next(fresh) if c.isdigit() else c for c in value)
    parts = value.split(" ")
    names = MALE if kind == "man" else FEMALE
    out = []
    for i, part in enumerate(parts):
        at = next((k for k, n in enumerate(names) if n.lower() == part.lower()), None)
        if at is not None and i < len(parts) - 1:
            given = names[_permuted(at, len(names), key)]
            out.append(given.upper() if part.isupper() and len(part) > 1 else given)
        else:
            out.append(_letters(part, _key(secret, kind, attempt, "name")))
    return " ".join(out)


def _mixed(text: str, key: bytes) -> str:
    """As _letters, upper and lower case in one number, so that both may change within their case."""
    return _letters(text, key + b"".join(b"1" if c.isupper() else b"0" for c in text)[:32])


def _private(number: int) -> int:
    first, second = number >> 24, number >> 16 & 255
    return 1 if first == 10 or first == 172 and 16 <= second < 32 or (first, second) == (192, 168) else 2 if first == 127 else 0


def _card(digits: str, key: bytes) -> str:
    """Keeps the issuer's first digit and whether the check digit is right."""
    valid = luhn(digits)
    if valid:
        body = digits[0] + _letters(digits[1:-1], key + digits[:1].encode())
        return next(body + d for d in "0123456789" if luhn(body + d))
    out = digits[0] + _letters(digits[1:], key + digits[:1].encode())
    while luhn(out):
        out = out[0] + _letters(out[1:], key + digits[:1].encode())
    return out


def entities(docs: DataFrame) -> DataFrame:
    """(row_id, kind, value): the entities of each row in their canonical form, a row each time."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, "text"):
            out: list[list] = [[], [], []]
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for start, end, kind in find(text or ""):
                    for column, value in zip(out, (row, kind, canonical(kind, text[start:end]))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(c, pa.string()) for c in out[1:])], ["row_id", "kind", "value"])

    keyed = docs.select(F.xxhash64("doc_id", "text").alias("row_id"), "text")
    return keyed.mapInArrow(run, "row_id long, kind string, value string")


def attempts(found: DataFrame, secret: str) -> DataFrame:
    """(kind, value, attempt) of the entities whose first surrogate collides, with the attempt that does not."""
    known = stored(found.select("kind", "value").distinct().withColumn("attempt", F.lit(0)), "entities")
    moved = None

    def generate(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            kinds, values, tries = (c.to_pylist() for c in batch.columns)
            new = [canonical(k, surrogate(k, v, secret, a)) for k, v, a in zip(kinds, values, tries)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], ["kind", "value", "attempt", "new"])

    current = known
    for round_ in range(3 * ROUNDS):
        made = stored(current.mapInArrow(generate, "kind string, value string, attempt int, new string"), "surrogates")
        winner = made.groupBy("kind", "new").agg(F.min("value").alias("winner"), F.count(F.lit(1)).alias("n"))
        clash = made.join(winner.where("n > 1"), ["kind", "new"]).where("value != winner").select("kind", "value")
        if round_ < ROUNDS:
            taken = made.select("kind", F.col("new").alias("value"), F.col("value").alias("of"))
            clash = clash.unionByName(taken.join(known.select("kind", "value"), ["kind", "value"]).select("kind", F.col("of").alias("value")))
        clash = stored(clash.distinct().withColumn("again", F.lit(1)), "clashes")
        if clash.isEmpty():
            break
        current = current.join(clash, ["kind", "value"], "left").select("kind", "value", (F.col("attempt") + F.coalesce("again", F.lit(0))).cast("int").alias("attempt"))
        current = moved = stored(current, "attempts")
    else:
        raise RuntimeError("surrogates still collide")
    return known.where(F.lit(False)) if moved is None else moved.where("attempt > 0")


def replaced(docs: DataFrame, secret: str, kinds: str | None = None) -> DataFrame:
    """``docs`` with surrogates in ``text``; ``kinds`` names a column for the types found, in order."""
    found = entities(doc_rows(docs, "doc_id", "text"))
    again = attempts(found, secret)
    pair = F.struct("kind", "value", "attempt")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64("doc_id", "text").alias("row_id"), "text")
    if again.isEmpty():
        rows = rows.withColumn("again", F.lit(None).cast("array<struct<kind:string,value:string,attempt:int>>"))
    else:
        own = found.join(again, ["kind", "value"]).groupBy("row_id").agg(F.collect_set(pair).alias("again"))
        rows = rows.join(own, "row_id", "left")
    rows = rows.select("row", "text", "again")

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(batches_, "text"):
            texts, types = [], []
            for text, tries in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                attempt = {(t["kind"], t["value"]): t["attempt"] for t in tries or ()}
                parts, at, own = [], 0, []
                for start, end, kind in find(text or ""):
                    old = text[start:end]
                    parts += [text[at:start], surrogate(kind, old, secret, attempt.get((kind, canonical(kind, old)), 0))]
                    at = end
                    own.append(kind)
                texts.append(text if not own else "".join([*parts, text[at:]]))
                types.append(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(types, pa.list_(pa.string()))], ["row", "new", "kinds"]
            )

    schema = StructType([rows.schema["row"], StructField("new", StringType()), StructField("kinds", ArrayType(StringType()))])
    done = rows.mapInArrow(run, schema)
    columns = [F.col("new").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c != kinds]
    return done.select(*columns, *([F.col("kinds").alias(kinds)] if kinds else []))
