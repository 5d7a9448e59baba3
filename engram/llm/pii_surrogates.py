"""Personal data replaced by surrogates of the same type, gender, script and format.

Found are e-mail addresses, telephone numbers, card numbers (by check digit), bank accounts (by check number), network
addresses, social security numbers, secrets (hexadecimal keys, named tokens, well-known key prefixes) and persons (a title
or a known first name before a capitalised name, and that surname wherever it comes back in the text).

A surrogate is a keyed permutation of the value within its own format: digits become digits, letters letters of the same
script, case and kind, everything else stays; check digits are made right again, and country codes, issuers' digits and
top-level domains are kept. First names come from lists by gender. As a permutation it keeps different values apart and
gives equal values equal surrogates in every document, whatever separators they were written with.

What a permutation can't rule out is checked over the whole corpus: a surrogate that is some other document's real value,
or that two values share. The distinct values are a table; values that fail are tried again under the next key. A format
can be used up, as when a corpus holds every short surname, or have nothing to permute; after `TRIES` keys a value gets a
surrogate of the same type in a larger format, with a letter, digit or character more at every further try (a network
address becomes one of the longer kind), until none fails. Only those exceptions are stored and joined to the documents that hold them; all others need no table at all.

Null texts stay null. Rows without an id and repeated rows are treated like others; empty texts and texts without personal
data stay as they are. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.common import map_slices
from engram.session import materialise, scratch_path

KEY = b"public demonstration key"
TRIES = 6

#: Titles and first names by gender.
TITLES = {
    "f": "Mrs Ms Miss Frau Madame Mme Mlle Señora Sra Doña Lady".split(),
    "m": "Mr Herr Monsieur Señor Sr Don Sir Lord".split(),
    "": "Dr Prof".split(),
}
FIRST_NAMES = {
    "f": "Anna Maria Sofia Laura Julia Emma Marie Claire Camille Elena Carmen Lucia Ingrid Petra Heike Sabine Karin Alice Mary Susan Linda Karen Sarah Emily Jane Helen Isabel Pilar Manon Chloé".split(),
    "m": "Peter Thomas Michael Andreas Stefan Hans Klaus Jürgen Pierre Jean Michel Antoine Luc Carlos Juan Miguel Pablo Diego José John James Robert David William Richard Mark Paul George Henry Javier".split(),
}
#: Letters by script and kind; a letter is only replaced by one of its own list.
_KINDS = [
    "aeiou", "bcdfghjklmnpqrstvwxyz", "àâäáèéêëìíîïòóôöùúûü", "çñßłśźż",
    "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ",
]
_LETTERS = {c: kind for kind in _KINDS for c in kind}
_LATIN = {c: "abcdefghijklmnopqrstuvwxyz" for c in "abcdefghijklmnopqrstuvwxyz"}
_DIGITS = {c: "0123456789" for c in "0123456789"}
_HEX = {c: "0123456789abcdef" for c in "0123456789abcdef"}

_NAME = r"[A-ZÀ-ÖØ-ÞЀ-ЯΑ-Ω][a-zß-öø-ÿа-џα-ώ]+(?:-[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+)?"
_ALL_FIRST = "|".join(sorted((n for names in FIRST_NAMES.values() for n in names), key=len, reverse=True))
_ALL_TITLES = "|".join(sorted((n for names in TITLES.values() for n in names), key=len, reverse=True))
_FIND = re.compile(
    r"(?P<email>[A-Za-z0-9._%+\-À-ÿ]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,})"
    r"|(?P<secret>\b(?:sk|pk|ghp|gho|xox[abp])[-_][A-Za-z0-9_-]{16,}|\bAKIA[A-Z0-9]{16}\b|\b(?=[0-9]{0,39}[a-fA-F])[0-9a-fA-F]{32,}\b)"
    r"|(?P<named>(?i:\b(?:token|api_?key|secret|password|passwd|pwd)\b)\s*[=:]\s*[\"'](?P<value>[^\"'\s]{6,})[\"'])"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<ip>(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-]))"
    r"|(?P<card>(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-]))"
)
_PERSON = re.compile(rf"\b(?:(?:{_ALL_TITLES})\.? (?:(?P<given>{_ALL_FIRST}) )?(?P<family>{_NAME})|(?P<first>{_ALL_FIRST}) (?P<last>{_NAME}))\b")
#: Texts without any of these signs hold nothing that `_FIND` could find.
_SIGN = re.compile(r"[@\d\"'_]|(?:sk|pk|ghp|gho|xox[abp])-|AKIA|[a-fA-F]{32}")
#: `_PERSON` needs a title or first name between word boundaries, so as a whole run of word characters.
_CAPITALISED = re.compile(r"\b[A-Z]\w*")
_CALLED = {x for names in (*TITLES.values(), *FIRST_NAMES.values()) for x in names}


def _number(key: bytes, value: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(value, key=key, digest_size=16).digest(), "big")


def permuted(n: int, size: int, key: bytes) -> int:
    """A keyed permutation of the numbers below `size`: a Feistel network, walked until it is in range."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        a, b = n >> half, n & mask
        for r in range(8):
            a, b = b, a ^ (_number(key, bytes([r]) + b.to_bytes((half + 7) // 8, "big")) & mask)
        n = (a << half) | b
        if n < size:
            return n


def in_format(text: str, alphabets: dict[str, str], key: bytes) -> str:
    """The characters that `alphabets` has, permuted together within their lists; all others stay. Case is kept."""
    size, n, at = 1, 0, []
    for k, c in enumerate(text):
        kind = alphabets.get(c.lower())
        if kind and len(c.lower()) == 1:
            n, size = n * len(kind) + kind.index(c.lower()), size * len(kind)
            at.append((k, kind, c != c.lower()))
    if size < 2:
        return text
    n = permuted(n, size, key + repr([len(kind) for _, kind, _ in at]).encode()[:32])
    out = list(text)
    for k, kind, upper in reversed(at):
        n, digit = divmod(n, len(kind))
        out[k] = kind[digit].upper() if upper and len(kind[digit].upper()) == 1 else kind[digit]
    return "".join(out)


def luhn(digits: str) -> int:
    """The check digit of a card number without its last digit."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 if k % 2 else 2)
        total += d - 9 if d > 9 else d
    return -total % 10


def iban_check(country: str, account: str) -> str:
    n = int("".join(str(int(c, 36)) for c in account + country + "00"))
    return f"{98 - n % 97:02d}"


def lengthened(kind: str, value: str, more: int) -> str:
    """A value of the same type with some characters more, which a permutation then fills."""
    if kind == "email":
        return ("ra" * more)[:more] + value
    if kind in ("phone", "ssn"):
        return value + "0" * more
    if kind == "card":
        return value[:-1] + "0" * more + value[-1]
    if kind == "family":
        last = value[-1].lower()
        filler = "ра" if "а" <= last <= "џ" else "ρα" if "α" <= last <= "ώ" else "ra"
        return value + (filler * more)[:more]
    return value + (("A0" if value == value.upper() else "a0") * more)[:more]


def canonical(kind: str, value: str) -> str:
    """The value without what doesn't tell two apart."""
    if kind in ("phone", "card", "ssn"):
        return "".join(c for c in value if c.isdigit() or c == "+")
    if kind == "iban":
        return value.replace(" ", "")
    return value.lower() if kind == "email" else value


@lru_cache(maxsize=20_000)
def surrogate(kind: str, value: str, attempt: int = 0, key: bytes = KEY) -> str:
    """The surrogate of a canonical value; from attempt `TRIES` on in a larger format."""
    more = attempt - TRIES + 1
    if more > 0 and kind == "ip":
        digits = hashlib.blake2b(f"{value} {attempt}".encode(), key=key, digest_size=12).hexdigest()
        return "2001:db8:" + ":".join(digits[k : k + 4] for k in range(0, 24, 4))
    if more > 0 and kind not in ("f", "m"):
        value = lengthened(kind, value, more)
    key = hashlib.blake2b(f"{kind} {attempt}".encode(), key=key, digest_size=16).digest()
    if kind == "email":
        name, _, top = value.rpartition(".")
        return in_format(name, _LATIN | _DIGITS | {c: k for c, k in _LETTERS.items() if c not in _LATIN}, key) + "." + top
    if kind == "card":
        middle = value[0] + in_format(value[1:-1], _DIGITS, key)
        return middle + str(luhn(middle))
    if kind == "iban":
        account = in_format(value[4:], _DIGITS | _LATIN, key)
        return value[:2] + iban_check(value[:2], account) + account
    if kind == "ip":
        n = 0
        for part in value.split("."):
            n = n * 256 + int(part)
        n = permuted(n, 1 << 32, key)
        return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))
    if kind == "phone":
        kept = 2 if value.startswith("+") else 0
        return value[:kept] + in_format(value[kept:], _DIGITS, key)
    if kind == "family":
        return in_format(value, _LETTERS, key)
    if kind in ("f", "m"):
        names = FIRST_NAMES[kind]
        return names[permuted(names.index(value), len(names), key)]
    if value.isdigit():
        return in_format(value, _DIGITS, key)
    hexadecimal = value in (value.lower(), value.upper()) and all(c in "0123456789abcdefABCDEF" for c in value)
    prefix = re.match(r"(?:sk|pk|ghp|gho|xox[abp])[-_]|AKIA", value)
    start = prefix.end() if prefix else 0
    if hexadecimal and not prefix:  # digits and letters change places, so case is one for all
        new = in_format(value.lower(), _HEX, key)
        return new.upper() if value != value.lower() else new
    return value[:start] + in_format(value[start:], _LATIN | _DIGITS, key)


def _dressed(shape: str, bare: str, characters: str) -> str:
    """`bare` with the separators of `shape`."""
    if len(bare) == len(shape):
        return bare
    rest = iter(bare)
    return "".join(next(rest) if c.isalnum() or c in characters else c for c in shape)


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical value), in order and without overlaps."""
    out, families, taken = [], set(), set()
    for m in _FIND.finditer(text) if _SIGN.search(text) else ():
        kind = next(k for k in ("named", "email", "secret", "iban", "ip", "ssn", "phone", "card") if m.group(k))
        span = m.span("value") if kind == "named" else m.span()
        value = canonical(kind, text[slice(*span)])
        if kind == "card" and int(value[-1]) != luhn(value[:-1]):
            continue
        if kind == "ip" and any(int(x) > 255 or x != str(int(x)) for x in value.split(".")):
            continue
        if kind == "iban" and (len(value) < 15 or iban_check(value[:2], value[4:]) != value[2:4]):
            continue
        out.append((*span, "secret" if kind == "named" else kind, value))
        taken.update(range(*span))
    if _CALLED.isdisjoint(_CAPITALISED.findall(text)):
        return out
    for m in _PERSON.finditer(text):
        for group in ("given", "first", "family", "last"):
            name = m.group(group)
            if name and m.start(group) not in taken:
                part = "family" if group in ("family", "last") else "f" if name in FIRST_NAMES["f"] else "m"
                out.append((*m.span(group), part, name))
                taken.update(range(*m.span(group)))
                if part == "family":
                    families.add(name)
    if families:  # the same person further on, by surname
        for m in re.finditer(r"\b(?:" + "|".join(map(re.escape, sorted(families, key=len, reverse=True))) + r")\b", text):
            if m.start() not in taken:
                out.append((*m.span(), "family", m.group()))
    return sorted(out)


def replaced(text: str, tries: dict[tuple[str, str], int], key: bytes = KEY) -> tuple[str, list[tuple[str, str]]]:
    """The text with surrogates, and the values found."""
    found, parts, at = entities(text), [], 0
    for start, end, kind, value in found:
        new = surrogate(kind, value, tries.get((kind, value), 0), key)
        if kind in ("phone", "card", "ssn", "iban"):
            new = _dressed(text[start:end], new, "+")
        elif kind == "email":
            new = "".join(b.upper() if a.isupper() and len(b.upper()) == 1 else b for a, b in zip(text[start:end], new, strict=True)) if len(new) == end - start else new
        parts += [text[at:start], new]
        at = end
    return "".join([*parts, text[at:]]), [(kind, value) for *_, kind, value in found]


def values_of(docs: DataFrame) -> DataFrame:
    """doc_id, kind, value: the distinct values of each document."""

    def run(batches):
        for b in batches:
            ids, kinds, values = [], [], []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                for kind, value in sorted({(k, v) for *_, k, v in entities(text or "")}):
                    ids.append(doc)
                    kinds.append(kind)
                    values.append(value)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds), pa.array(values)], names=["doc_id", "kind", "value"])

    return map_slices(docs, run, "doc_id bigint, kind string, value string")


def exceptions(found: DataFrame, key: bytes = KEY) -> DataFrame:
    """kind, value, attempt of the values whose first surrogate won't do. First names are never compared: lists are short."""
    every = materialise(found.where("kind not in ('f', 'm')").select("kind", "value").distinct())

    def run(batches):
        for b in batches:
            new = [surrogate(k, v, a, key) for k, v, a in zip(*(b.column(c).to_pylist() for c in ("kind", "value", "attempt")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("value"), b.column("attempt"), pa.array(new, pa.string())], names=["kind", "value", "attempt", "new"])

    real = every.select("kind", F.col("value").alias("new"), F.lit(True).alias("real"))
    accepted, rest = None, every.withColumn("attempt", F.lit(0))
    while True:  # formats grow with the tries, so values run out
        tried = rest.mapInArrow(run, "kind string, value string, attempt int, new string")
        tried = tried.join(real, ["kind", "new"], "left")
        own = tried.where("real is null").groupBy("kind", "new").agg(F.min("value").alias("value"), F.min("attempt").alias("attempt"))
        if accepted is not None:
            own = own.join(accepted.select("kind", "new"), ["kind", "new"], "left_anti")
        own = materialise(own.select("kind", "value", "attempt", "new"))
        accepted = own if accepted is None else accepted.unionByName(own)
        rest = materialise(rest.join(own.select("kind", "value"), ["kind", "value"], "left_anti").withColumn("attempt", F.col("attempt") + 1))
        if rest.isEmpty():
            return accepted.where("attempt > 0").select("kind", "value", "attempt")


def surrogates(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """doc_id, n_entities, n_distinct and the text with surrogates."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    path = scratch_path(spark, "values")
    values_of(rows).write.parquet(path)
    found = spark.read.parquet(path)
    odd = found.join(exceptions(found, key), ["kind", "value"]).distinct()
    odd = odd.groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_list(F.struct("kind", "value", "attempt")).alias("tries"))
    path = scratch_path(spark, "exceptions")
    odd.write.parquet(path)  # so that its size is known when the join is planned

    def run(batches):
        for b in batches:
            out = []
            for text, tries in zip(b.column("text").to_pylist(), b.column("tries").to_pylist(), strict=True):
                new, own = replaced(text or "", {(t["kind"], t["value"]): t["attempt"] for t in tries or ()}, key)
                out.append((len(own), len(set(own)), None if text is None else new))
            n, distinct, texts = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(distinct, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "n_entities", "n_distinct", "text"])

    both = rows.join(spark.read.parquet(path), F.col("doc_id").eqNullSafe(F.col("_doc")), "left").select("doc_id", "text", "tries")
    return map_slices(both, run, "doc_id bigint, n_entities bigint, n_distinct bigint, text string")
