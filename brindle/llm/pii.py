"""Personal data replaced by keyed surrogates.

Detected kinds: EMAIL, PHONE, IPV4, IPV6, CARD (13 to 19 digits), SSN, IBAN, SECRET (access keys, and values after password, token and the like) and
PERSON (after a form of address, a known given name before a capitalised word, and every other mention in the text of a full name found so). Each
entity is replaced by a surrogate of its own kind and format: letters by letters (vowels and consonants apart) of the same script and case, digits by
digits, given names by given names of the same gender and script, cards and account numbers keep their checksum state, addresses stay addresses.
A full name without a form of address whose given name is not listed is not found, nor is a bare surname.

A surrogate is the image of the entity's normal form under a permutation of all values of its format, drawn from the key. So, under one key:
the same entity always gets the same surrogate, in every document and on every executor (coreference), and two entities never get
one (distinctness), with only the redrawn entities shared between tasks. Domains of at most 16,384 values use the first of a series of
permutations that moves every value, so none is its own surrogate; in larger ones a value that the permutation leaves in place (a chance of
one in their size) swaps images with its successor. Spacing, case and form of address are no part of the normal form. Before any text is changed a pass over
the corpus looks for images that are another entity's or real entities themselves, and redraws these; ``collisions`` audits the outcome.

Null text stays null with no entities; text without entities is returned unchanged. Texts are read whole. Where patterns overlap the earlier kind
in the list above wins. Rows are independent, so repeated rows, null ids and empty tables need no rule of their own. Extra columns pass
through; those named like an output are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from ipaddress import IPv6Address
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.shared import Scratch, own_columns, pieces, without

#: A key that anyone can read, for tests and the registered queries. Whoever holds the key can undo surrogates: real use needs its own.
TEST_KEY = b"set your own key"
ENUMERATED = 1 << 14
#: Images tried for an entity whose first is taken.
ATTEMPTS = 16

#: Given names by script and gender.
NAMES = {
    ("latin", "f"): "Alice Amelia Ana Andrea Anna Astrid Beatriz Camille Carla Carmen Charlotte Chloe Clara Claire Elena Elizabeth Emily Emma Eva Fatima Francesca Giulia Grace Greta Hannah Heidi Helen Ines Ingrid Isabel Jane Jennifer Jessica Julia Karin Katharina Laura Lena Leonie Linda Lucia Lucy Margaret Maria Marie Marta Mary Mia Nina Olivia Patricia Paula Petra Rosa Sabine Sarah Sofia Sophie Susan Ursula".split(),
    ("latin", "m"): "Adam Ahmed Alexander Andrew Antonio Benjamin Bruno Carlos Charles Christian Daniel David Diego Edward Felix Fernando Francisco Frank George Giovanni Hans Heinrich Henry Hugo Jack Jacob James Javier Jean João Johann John Jonas Jorge Jose José Juan Jürgen Karl Klaus Lars Lucas Luca Luis Marco Martin Matthew Max Michael Miguel Mohammed Nicolas Noah Oliver Oscar Pablo Paul Pedro Peter Pierre Rafael Richard Robert Samuel Sebastian Stefan Thomas Tim Victor Walter William Wolfgang".split(),
    ("cyrillic", "f"): "Анна Вера Галина Елена Ирина Мария Наталья Ольга Светлана Татьяна".split(),
    ("cyrillic", "m"): "Алексей Андрей Борис Виктор Дмитрий Иван Михаил Николай Павел Сергей".split(),
}
_GENDER = {name: group for group, names in NAMES.items() for name in names}
#: Forms of address and the gender they tell, if any.
ADDRESS = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": "", "Prof": "", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "господин": "m", "госпожа": "f"}

_CAPITAL = r"[A-ZÀ-ÖØ-ÞА-ЯЁ][a-zß-öø-ÿа-яё'’]+(?:-?[A-ZÀ-ÖØ-ÞА-ЯЁ][a-zß-öø-ÿа-яё'’]+)*"
_INITIAL = r"(?:[A-ZÀ-ÖØ-ÞА-ЯЁ]\. ?){0,2}"
_PATTERNS = {
    "EMAIL": re.compile(r"(?<![\w.%+-])\w(?:[\w.%+'’-]*\w)?@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w])"),
    "SECRET": re.compile(r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)(?P<a>[A-Z0-9]{16})(?![A-Za-z0-9])|(?:gh[pousr]_|github_pat_|sk-|xox[bp]-)(?P<b>[A-Za-z0-9_-]{16,})|(?i:password|passwd|pwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?(?P<c>[^\s\"'|,;!]{6,}))"),
    "IBAN": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "IPV4": re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)"),
    "IPV6": re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}|:)(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:])"),
    "PHONE": re.compile(r"(?<![\w.+-])(?=(?:[ /.-]?\d){9,12}(?![\w-]|[ /.-]\d))0\d{1,4}[ /-]\d{2,4}(?:[ -]?\d{2,4}){1,3}(?![\w-])|(?<![\w.+-])0\d(?:[ .-]\d{2}){4}(?![\w-])|(?<![\w.+-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])|(?<![\w.])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?![\w-])"),
    "SSN": re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    "CARD": re.compile(r"(?<![\w.-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,4}(?:\d{1,3})?(?![\w-])"),
}
_TITLE = re.compile(rf"(?<!\w)(?P<t>{'|'.join(sorted(ADDRESS, key=len, reverse=True))})\.? (?P<n>{_INITIAL}{_CAPITAL}(?: {_INITIAL}{_CAPITAL})?)")
#: Known given names before a capitalised word. It starts at the name, so that no capitalised word before one can take it up.
_LISTED = "|".join(sorted(_GENDER, key=len, reverse=True))
_PAIR = re.compile(rf"(?<!\w)(?P<g>{_LISTED})(?:-{_CAPITAL})? (?P<s>(?:(?:{_LISTED}) )*{_INITIAL}{_CAPITAL})(?!\w)")
#: A capitalised word before another, to find further mentions of a full name.
_FULL = re.compile(rf"(?<!\w)(?=(?P<n>{_CAPITAL} {_INITIAL}{_CAPITAL})(?!\w))")
_DIGIT = re.compile(r"\d")
_ORDER = ["EMAIL", "SECRET", "IBAN", "IPV4", "IPV6", "PHONE", "SSN", "CARD"]

_CLASSES = ["aeiou", "bcdfghjklmnpqrstvwxyz", "0123456789", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "áéíóúàèìòùâêîôûäöüëï"]
_CLASS = {c: alphabet for alphabet in _CLASSES for c in alphabet}


def _number(key: bytes, tag: str, *values: int) -> int:
    return int.from_bytes(hashlib.blake2b("/".join([tag, *map(str, values)]).encode(), key=key[:64], digest_size=32).digest(), "big")


def _shuffle(x: int, size: int, key: bytes, tag: str) -> int:
    """A permutation of range(size): rounds of modular sums between two halves, repeated until the result is in range again."""
    a = isqrt(size - 1) + 1
    b = -(-size // a)
    while True:
        left, right = divmod(x, b)
        for r in range(0, 8, 2):
            left = (left + _number(key, tag, r, right)) % a
            right = (right + _number(key, tag, r + 1, left)) % b
        x = left * b + right
        if x < size:
            return x


@lru_cache(4096)
def _series(size: int, key: bytes, tag: str) -> int:
    """The first permutation of a small domain that leaves no value where it is."""
    t = 0
    while 1 < size <= ENUMERATED and any(_shuffle(x, size, key, f"{tag}#{t}") == x for x in range(size)):
        t += 1
    return t


def permute(x: int, size: int, key: bytes, tag: str) -> int:
    if size < 2:
        return x
    if size <= ENUMERATED:
        return _shuffle(x, size, key, f"{tag}#{_series(size, key, tag)}")
    y, before = _shuffle(x, size, key, tag), (x - 1) % size
    if y == x:
        return _shuffle((x + 1) % size, size, key, tag)
    return before if _shuffle(before, size, key, tag) == before else y


def _spelled(text: str, alphabets: list[str | None], key: bytes, tag: str) -> str:
    """The text under a permutation of all texts with these alphabets; characters without one stay."""
    x, size = 0, 1
    for c, alphabet in zip(text, alphabets, strict=True):
        if alphabet:
            x, size = x * len(alphabet) + alphabet.index(c), size * len(alphabet)
    shape = "".join("." if a is None else "abcdefgh"[min(7, len(a) % 8)] for a in alphabets)
    x, out = permute(x, size, key, f"{tag}:{shape}:{size}"), []
    for c, alphabet in zip(reversed(text), reversed(alphabets), strict=True):
        if alphabet:
            x, d = divmod(x, len(alphabet))
            c = alphabet[d]
        out.append(c)
    return "".join(reversed(out))


def _cased(model: str, text: str) -> str:
    return "".join(c.upper() if m.isupper() and len(c.upper()) == 1 else c for m, c in zip(model, text, strict=True))


def _plain(text: str, key: bytes, tag: str) -> str:
    """Letters and digits within their class, case kept."""
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return _cased(text, _spelled(low, [_CLASS.get(c) for c in low], key, tag))


def luhn(digits: str) -> int:
    """The check digit that follows these digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 else d * 2 - 9 * (d > 4)
    return -total % 10


def _email(text: str, key: bytes) -> str:
    low = text.lower()
    if len(low) != len(text):
        low = text
    end = low.rindex(".")
    return _cased(text, _spelled(low, [_CLASS.get(c) if i < end else None for i, c in enumerate(low)], key, "email"))


def _refilled(model: str, chars: str) -> str:
    """The letters and digits of ``model`` replaced in turn."""
    new = iter(chars)
    return "".join(next(new) if c.isalnum() else c for c in model)


#: Calling codes of one and two digits; all others have three.
_CALLING = re.compile(r"\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})")


def _national(text: str) -> int:
    """Where the number after the calling code, or the trunk 0 of a number without one, begins."""
    country = _CALLING.match(text)
    return country.end() if country else int(text.startswith("0"))


def _phone(text: str, key: bytes) -> str:
    """The calling code stays; the national number is the entity, however it is spaced. Area and exchange keep a first digit of 2 to 9."""
    at = _national(text)
    digits = re.sub(r"\D", "", text[at:])
    alphabets = [("01" if c in "01" else "23456789") if i in ((0, 3) if len(digits) == 10 else (0,)) else "0123456789" for i, c in enumerate(digits)]
    return text[:at] + _refilled(text[at:], _spelled(digits, alphabets, key, "phone"))


def _ssn(text: str, key: bytes) -> str:
    return _refilled(text, _spelled(re.sub(r"\D", "", text), ["0123456789"] * 9, key, "ssn"))


def _card(text: str, key: bytes) -> str:
    digits = re.sub(r"\D", "", text)
    off = (int(digits[-1]) - luhn(digits[:-1])) % 10
    body = digits[0] + _spelled(digits[1:-1], ["0123456789"] * (len(digits) - 2), key, f"card:{digits[0]}:{off}")
    return _refilled(text, body + str((luhn(body) + off) % 10))


_PRIVATE = [(10 << 24, 8), (127 << 24, 8), ((192 << 24) | (168 << 16), 16), ((172 << 24) | (16 << 16), 12)]


def _ipv4(text: str, key: bytes) -> str:
    x = 0
    for part in text.split("."):
        x = x << 8 | int(part)
    for base, bits in _PRIVATE:
        if x >> (32 - bits) == base >> (32 - bits):
            x = base | permute(x & ((1 << (32 - bits)) - 1), 1 << (32 - bits), key, f"ip:{base}")
            break
    else:
        while True:
            x = permute(x, 1 << 32, key, "ip")
            if not any(x >> (32 - b) == base >> (32 - b) for base, b in _PRIVATE):
                break
    return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))


def _secret(text: str, key: bytes) -> str:
    for alphabet in ("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"):
        if all(c in alphabet for c in text):
            low = text.lower() if alphabet == "0123456789ABCDEF" else text
            out = _spelled(low, [alphabet.lower() if low is not text else alphabet] * len(text), key, f"secret:{len(alphabet)}")
            return out.upper() if low is not text else out
    return _plain(text, key, "secret")


def _residue(country: str, check: str, body: str) -> int:
    """Of an account number as letters stand for 10 to 35; 1 if its check digits are right."""
    return int("".join(str(int(c, 36)) for c in body + country + check)) % 97


def _iban(text: str, key: bytes) -> str:
    """Country and residue stay, so a right number has right check digits again."""
    country, check, body = text[:2], text[2:4], text[4:].replace(" ", "")
    off = _residue(country, check, body)
    body = _plain(body, key, f"iban:{country}:{off}")
    check = (off - _residue(country, "00", body)) % 97
    return country + _refilled(text[2:], f"{check + 97 * (check < 2):02d}" + body)


def _ipv6(text: str, key: bytes) -> str:
    """The first 16 bits stay, as they tell the kind of address."""
    x = int(IPv6Address(text))
    new = IPv6Address(x >> 112 << 112 | permute(x & ((1 << 112) - 1), 1 << 112, key, f"ip6:{x >> 112}"))
    out = str(new) if "::" in text else new.exploded if max(map(len, text.split(":"))) == min(map(len, text.split(":"))) else ":".join(f"{int(g, 16):x}" for g in new.exploded.split(":"))
    return out.upper() if text.upper() == text else out


def _unlisted(name: str, key: bytes, tag: str) -> str:
    out = name
    while True:  # another name's image is never a listed name
        out = _plain(out, key, tag)
        if out not in _GENDER:
            return out


def _given(name: str, key: bytes) -> str:
    """By the name alone, whatever the form of address says: one name has one image."""
    group = _GENDER.get(name)
    if group:
        pool = NAMES[group]
        return pool[permute(pool.index(name), len(pool), key, f"given:{group}")]
    return _unlisted(name, key, "given")


def _person(text: str, key: bytes) -> str:
    first, _, last = text.partition(" ")
    if not last and first not in _GENDER:
        return _unlisted(first, key, "family")
    return f"{_given(first, key)} {_plain(last, key, 'family')}" if last else _given(first, key)


_MAKERS = {"EMAIL": _email, "SECRET": _secret, "IBAN": _iban, "IPV4": _ipv4, "IPV6": _ipv6, "PHONE": _phone, "SSN": _ssn, "CARD": _card}


@lru_cache(50_000)
def surrogate(kind: str, text: str, key: bytes = TEST_KEY, attempt: int = 0) -> str:
    """The entity's image; attempts above 0 are images under other keys, drawn from this one."""
    if attempt:
        key = hashlib.blake2b(f"attempt {attempt}".encode(), key=key[:64], digest_size=32).digest()
    return _person(text, key) if kind == "PERSON" else _MAKERS[kind](text, key)


def normal(kind: str, text: str) -> str:
    """One form for all spellings of an entity."""
    if kind == "PHONE":
        return re.sub(r"\D", "", text[_national(text) :])
    if kind == "IPV6":
        return IPv6Address(text).exploded
    if kind in ("CARD", "SSN"):
        return re.sub(r"\D", "", text)
    return text.replace(" ", "").upper() if kind == "IBAN" else text.lower() if kind == "EMAIL" else text


def _is_ipv6(text: str) -> bool:
    """At least three groups are written, so that a time or a scope operator is none."""
    try:
        IPv6Address(text)
    except ValueError:
        return False
    return sum(map(bool, text.split(":"))) >= 3


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, gender) of the entities, not overlapping, in order."""
    found: list[tuple[int, int, str, str]] = []
    digits = _DIGIT.search(text) is not None
    for kind in _ORDER:
        if kind == "EMAIL" and "@" not in text or kind == "IPV6" and ":" not in text or kind in ("IBAN", "IPV4", "PHONE", "SSN", "CARD") and not digits:
            continue
        for m in _PATTERNS[kind].finditer(text):
            start, end = m.span()
            if kind == "SECRET":
                start, end = next(m.span(g) for g in "abc" if m.group(g))
            if kind == "IPV6" and not _is_ipv6(m.group()):
                continue
            if kind == "CARD" and not 13 <= sum(c.isdigit() for c in m.group()) <= 19:
                continue
            found.append((start, end, kind, ""))
    full = set()
    for m in _TITLE.finditer(text):
        first = m["n"].split(" ")[0]
        if " " in m["n"]:
            full.add(m["n"])
        found.append((*m.span("n"), "PERSON", ADDRESS[m["t"]] or _GENDER.get(first, ("", ""))[1]))
    for m in _PAIR.finditer(text):
        found.append((*m.span(), "PERSON", _GENDER[m["g"]][1]))
    if full:
        found += [(*m.span("n"), "PERSON", "") for m in _FULL.finditer(text) if m["n"] in full]
    if len(found) < 2:
        return found
    rank = {k: i for i, k in enumerate([*_ORDER, "PERSON"])}
    out: list[tuple[int, int, str, str]] = []
    for one in sorted(found, key=lambda e: (e[0], rank[e[2]], -e[1])):
        if out and one[0] < out[-1][1]:
            if rank[one[2]] < rank[out[-1][2]]:
                out[-1] = one
            continue
        out.append(one)
    return out


def replace(text: str, key: bytes = TEST_KEY, redrawn: dict[tuple[str, str], int] | None = None) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with surrogates, and each surrogate's kind, start and end in it. ``redrawn`` has the attempt of entities whose first image is taken."""
    out, spans, at, size = [], [], 0, 0
    for start, end, kind, _ in entities(text):
        own = text[start:end]
        new = surrogate(kind, own, key, redrawn.get((kind, normal(kind, own)), 0) if redrawn else 0)
        size += start - at
        out += [text[at:start], new]
        spans.append((kind, size, size + len(new)))
        size += len(new)
        at = end
    return ("".join([*out, text[at:]]), spans) if spans else (text, spans)


def surrogates(docs: DataFrame, text: str = "text", *, key: bytes, spans: bool = True) -> DataFrame:
    """All columns, the text replaced; with ``spans`` also n_entities and entities (kind, start, end in the new text). A pass before finds the images
    that are taken (``redraws``); it runs when this is called. No text is shuffled."""
    if not key:
        raise ValueError("a key is needed")
    redrawn = docs.sparkSession.sparkContext.broadcast(redraws(docs, text, key=key))  # entities whose image is taken: about their number squared over the format's size
    kept, names = without(docs, *["n_entities", "entities"] * spans)
    column = f"c{names.index(text)}"
    kind = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*kept.schema, *[T.StructField("n_entities", T.LongType()), T.StructField("entities", kind)] * spans])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            at = batch.schema.names.index(column)
            for part in pieces(batch, column, 8 << 20):
                texts, found = [], []
                for t in part.column(at).to_pylist():
                    new, places = replace(t, key, redrawn.value) if t else (t, [])
                    texts.append(new)
                    found.append([{"kind": k, "start": a, "end": b} for k, a, b in places])
                cols = list(part.columns)
                cols[at] = pa.array(texts, cols[at].type)
                more = [pa.array([len(x) for x in found], pa.int64()), pa.array(found, arrow)] if spans else []
                yield pa.RecordBatch.from_arrays([*cols, *more], schema.names)

    return kept.mapInArrow(run, schema).toDF(*names, *["n_entities", "entities"] * spans)


def images(docs: DataFrame, text: str = "text", *, key: bytes, redrawn: dict[tuple[str, str], int] | None = None) -> DataFrame:
    """kind, entity, surrogate (both in normal form) and sample (a spelling) of each entity of the corpus. Only entities are shuffled, each once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "c0", 8 << 20):
                found = {(kind, normal(kind, t[a:b])): t[a:b] for t in part.column(0).to_pylist() if t for a, b, kind, _ in entities(t)}
                rows = [(k, e, normal(k, surrogate(k, x, key, (redrawn or {}).get((k, e), 0))), x) for (k, e), x in found.items()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["kind", "entity", "surrogate", "sample"])

    found = own_columns(docs, text).toDF("c0").mapInArrow(run, "kind string, entity string, surrogate string, sample string")
    return found.groupBy("kind", "entity", "surrogate").agg(F.min("sample").alias("sample"))


def _clashes(pairs: DataFrame) -> DataFrame:
    """kind, surrogate, n and seen of the surrogates that several entities got or that are entities themselves."""
    given = pairs.groupBy("kind", F.col("surrogate").alias("value")).agg(F.count_distinct("entity").alias("n")).withColumn("seen", F.lit(0))
    own = pairs.select("kind", F.col("entity").alias("value"), F.lit(0).cast("long").alias("n"), F.lit(1).alias("seen"))
    both = given.unionByName(own).groupBy("kind", "value").agg(F.max("n").alias("n"), (F.max("seen") > 0).alias("seen"))
    return both.where("n > 1 OR (n > 0 AND seen)").select("kind", F.col("value").alias("surrogate"), "n", "seen")


def redraws(docs: DataFrame, text: str = "text", *, key: bytes) -> dict[tuple[str, str], int]:
    """The attempt of each entity whose first image is another's too, or an entity of the corpus itself: the first whose image is neither an entity nor
    any first or redrawn image. If none of ATTEMPTS is free (formats with few values, all in use) the first image stays."""
    scratch = Scratch(docs.sparkSession, "pii")
    pairs = scratch.put(images(docs, text, key=key))
    bad = pairs.join(_clashes(pairs), ["kind", "surrogate"]).orderBy("kind", "surrogate", "entity").collect()  # as few as the broadcast above
    if not bad:
        scratch.clear()
        return {}
    drawn = [(r["kind"], r["entity"], k, normal(r["kind"], surrogate(r["kind"], r["sample"], key, k))) for r in bad for k in range(1, ATTEMPTS + 1)]
    tries = docs.sparkSession.createDataFrame([(d[0], d[3]) for d in drawn], "kind string, value string").distinct()
    used = pairs.select("kind", F.explode(F.array("entity", "surrogate")).alias("value"))
    taken = {tuple(r) for r in tries.join(used, ["kind", "value"], "left_semi").collect()}
    scratch.clear()
    out: dict[tuple[str, str], int] = {}
    for kind, entity, k, value in drawn:
        if (kind, entity) not in out and (kind, value) not in taken:
            out[kind, entity] = k
            taken.add((kind, value))
    return out


def collisions(docs: DataFrame, text: str = "text", *, key: bytes) -> DataFrame:
    """An audit of what ``surrogates`` gives over the whole corpus: kind, surrogate, n (distinct entities that got it) and seen (it occurs as an entity
    itself), for surrogates with n > 1 or seen, which only formats without a free value can have."""
    return _clashes(images(docs, text, key=key, redrawn=redraws(docs, text, key=key)))
