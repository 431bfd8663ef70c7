"""Personal data: detection, and keyed surrogates of the same type and form.

Surrogates come from keyed permutations without fixed points: a Feistel network P, walked
within its domain, gives P^-1(P(x) + 1). So under one key an entity always gets the same
surrogate (coreference, whatever its separators or case), two entities of a form never the
same one (distinctness), and none stays what it was. Candidates that would collide with
names of another origin are walked past, which keeps the permutation one to one:

  email, secret, iban  letters stay letters of their case, digits digits; the domain of an
                       email is permuted label by label, its top level and the reserved
                       example domains stay; an IBAN keeps its country and validity
  phone, ssn, card     digits are permuted, separators stay; a phone number keeps its
                       calling code, trunk zero and length; a card its distance from the Luhn digit
  ip                   permuted among addresses of its kind (private or public)
  name                 word by word, wherever the word stands: a given name of a pool is
                       permuted within the pool of its gender and script; any other word keeps
                       its script, case, accents, hyphens, pattern of vowels and consonants and
                       the ending that shows a gender, and never becomes a name of a pool;
                       particles and honorifics stay

Names are found behind an honorific or a phrase that announces one, and where a given name of
the pools stands, alone or before capitalised words. The pools are a parameter.

Edge cases: null text stays null; empty text stays; overlapping finds: the earlier, then the
one first in TYPES; repeated documents get equal surrogates; further columns are kept as they are.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, table, tidy

KEY = b"replace this key in production"
TYPES = ("secret", "email", "iban", "ip", "card", "ssn", "phone", "name")

#: Names by script and gender, and the honorifics that announce a name.
GIVEN = {
    ("latin", "f"): "Anna Maria Emma Sophie Julia Laura Sarah Lisa Marie Claire Camille Chloé Lucía Carmen Elena Isabel Paula Sofia Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Karen Nancy Emily Alice Helen Ruth Grace Olivia Charlotte Amelia Hannah Lena Katharina Ursula Ingrid Greta".split(),
    ("latin", "m"): "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Steven Paul Andrew George Kevin Peter Hans Klaus Jürgen Stefan Wolfgang Karl Friedrich Pierre Jean Jacques Louis Antoine Luc Carlos Juan José Miguel Pedro Luis Javier Diego Pablo".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия".split(),
    ("cyrillic", "m"): "Иван Пётр Алексей Дмитрий Сергей Андрей Михаил Николай Владимир Павел".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Σοφία Άννα Ειρήνη".split(),
    ("greek", "m"): "Γιώργος Δημήτρης Νίκος Κώστας Γιάννης Πέτρος".split(),
}
HONORIFICS = "Mr Sir Herr Herrn Monsieur Señor Sr Don Mrs Ms Miss Mx Madam Frau Madame Mme Mlle Señora Sra Doña Dr Prof Lord Lady Господин Госпожа Кύριος Κύριε Κυρία".split()
CUES = ("my name is ", "My name is ", "name: ", "Name: ", "Dear ", "Liebe ", "Lieber ", "Sehr geehrter ", "ich heiße ", "Ich heiße ", "Mein Name ist ", "mein Name ist ", "je m'appelle ", "Je m'appelle ", "Cher ", "Chère ", "me llamo ", "Me llamo ", "Querido ", "Querida ", "меня зовут ", "Меня зовут ", "με λένε ", "Με λένε ")
PARTICLES = frozenset("von van de der den di da del della la le ter zu bin ibn al".split())
#: Given names that are common words as well: a name only with another beside them.
WORDS_TOO = frozenset("Mark Grace Don Jean Carmen".split())
#: Endings that show a gender, those of one family name together; a final vowel does as well.
FAMILIES = tuple(x.split("/") for x in "ский/ская цкий/цкая ый/ая ий ой ов/ова ев/ева ёв/ёва ин/ина ын/ына sky/skaya ski/ska ov/ova/ová ev/eva in/ina ός ης ας ου".split())
ENDINGS = sorted((e for family in FAMILIES for e in family), key=lambda e: (-len(e), e))
#: Letters that may stand for each other in a name.
LETTERS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "áéíóú", "àèìòù", "âêîôû", "äöü", "ëï", "ãõ", "åæø", "çñ", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "άέήίόύώ", "βγδζθκλμνξπρστφχψ")
#: Calling codes of two digits; 1 and 7 are codes of one, all others have three.
CODES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
RESERVED = frozenset("example.com example.org example.net".split())
_SETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ")
_CLASS = {c: alphabet for alphabet in LETTERS for c in alphabet}

_EMAIL = re.compile(r"[A-Za-z0-9À-ÖØ-öø-ÿ._%+\-]*[A-Za-z0-9À-ÖØ-öø-ÿ_%+\-]@[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)+")
_SECRET = re.compile(r"(?i)\b(?:token|secret|passwo?r?d|pwd|passphrase|api[_ \-]?key|access[_ \-]?key|private[_ \-]?key|credentials?|bearer)\b[\"']?\s*(?:[:=]|is)?\s*[\"']?([A-Za-z0-9+/_\-]{12,}={0,2})")
_KEYS = re.compile(r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9]{20,}|[0-9a-f]{32,128}|[0-9A-F]{32,128})\b")
_IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,4})?\b")
_IPV4 = re.compile(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)")
_IPV6 = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4})(?::[0-9A-Fa-f]{1,4})*(?![0-9A-Za-z:.])")
_CARD = re.compile(r"(?<![\d+.\-])(?!00)\d(?:[ \-]?\d){12,18}(?![\d])")
_SSN = re.compile(r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])")
_PHONE = re.compile(r"(?<![\w+.])(?:\+\d{1,3}[ .\-/]?(?:\(\d{1,5}\)[ .\-/]?)?\d{2,5}(?:[ .\-/]?\d{2,5}){1,4}|\(\d{2,5}\)[ .\-/]?\d{2,5}(?:[ .\-/]?\d{2,5}){1,3}|\d{3}[ .\-]\d{3}[ .\-]\d{4}|0\d{1,4}[ /\-]\d{2,4}(?:[ \-]?\d{2,4}){1,3})(?!\w|[.\-]\d)")
_UP, _LOW = "A-ZÀ-ÖØ-ÞΆ-ΏΑ-ΫА-ЯЁ", "a-zß-öø-ÿά-ώа-яё"
_TITLE = rf"(?:[{_UP}]['’])?[{_UP}][{_LOW}]+(?:[{_UP}][{_LOW}]+)?(?:[\-'’][{_UP}][{_LOW}]+)*"
_CAPS = rf"(?:[{_UP}]['’])?[{_UP}]{{2,}}(?:[\-'’][{_UP}]{{2,}})*"
_MORE = rf"(?:(?:[ ][{_UP}]\.)?(?:[ ](?:{'|'.join(sorted(PARTICLES))})){{0,2}}[ ](?:%s)(?![{_LOW}]))"
_FULL = re.compile(rf"(?:{_TITLE})(?![{_UP}{_LOW}]){_MORE % _TITLE}{{0,2}}|(?:{_CAPS})(?![{_UP}{_LOW}]){_MORE % _CAPS}{{0,2}}")
_ALSO = re.compile(r"(?:Dr|Prof|DR|PROF)\.?[ ]")
_DIGIT = re.compile(r"\d")
_HEXES = re.compile(r"[0-9a-fA-F]{32}")
_WORD = re.compile(rf"[{_UP}{_LOW}]+(?:[\-'’][{_UP}{_LOW}]+)*")
Pools = dict[tuple[str, str], list[str]]
Find = tuple[int, int, str]  # start, end, type


class Finder:
    """Finds entities; given: pools of given names by (script, gender)."""

    def __init__(self, given: Pools | None = None):
        marks = ahocorasick.Automaton()
        for names in (given or GIVEN).values():
            for n in names:
                marks.add_word(n, (len(n), "given"))
                marks.add_word(n.upper(), (len(n), "given"))
        for h in HONORIFICS:
            for x in (h, h.upper()):
                for end in (" ", ". "):
                    marks.add_word(x + end, (len(x) + len(end), "title"))
        for c in CUES:
            marks.add_word(c, (len(c), "cue"))
        marks.make_automaton()
        self.marks = marks

    def names(self, text: str) -> list[Find]:
        out: list[Find] = []
        for last, (size, kind) in self.marks.iter(text):
            start = last + 1 - size
            if start and (text[start - 1].isalnum() or text[start - 1] == "_"):
                continue
            if kind == "given":
                m = _FULL.match(text, start)
                if m is None or m.end() <= last or m.end() == last + 1 and text[start : last + 1] in WORDS_TOO:
                    continue
                if text[last + 1 : last + 2].isalpha():  # the beginning of another word
                    continue
            else:
                at = start + size
                while kind == "title" and (more := _ALSO.match(text, at)):
                    at = more.end()
                m = _FULL.match(text, at)
                if m is None or m.group() in HONORIFICS:
                    continue
            out.append((m.start(), m.end(), "name"))
        return out

    def find(self, text: str) -> list[Find]:
        """Entities of a text in order, without overlaps."""
        found = self.names(text)
        if "@" in text:
            found += [(*m.span(), "email") for m in _EMAIL.finditer(text)]
        if _DIGIT.search(text):
            found += [(*m.span(), "ip") for m in _IPV4.finditer(text) if all(int(x) < 256 for x in m.group().split("."))]
            found += [(*m.span(), "card") for m in _CARD.finditer(text)]
            found += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m.group())) <= 15]
            if "-" in text:
                found += [(*m.span(), "ssn") for m in _SSN.finditer(text)]
            found += [(*m.span(), "iban") for m in _IBAN.finditer(text)]
            if ":" in text:
                found += [(*m.span(), "ip") for m in _IPV6.finditer(text) if _ip(m.group())]
            if _HEXES.search(text) or "AKIA" in text or "sk-" in text or "gh" in text:
                found += [(*m.span(), "secret") for m in _KEYS.finditer(text) if _DIGIT.search(m.group()) and not m.group().isdigit()]
        lower = text.lower()
        if any(w in lower for w in ("token", "secret", "passw", "passphrase", "pwd", "key", "credential", "bearer")):
            found += [(*m.span(1), "secret") for m in _SECRET.finditer(text) if _DIGIT.search(m.group(1)) or re.search(r"[:=]\s*[\"']?$", text[m.start() : m.start(1)])]
        found.sort(key=lambda f: (f[0], TYPES.index(f[2]), -f[1]))
        out: list[Find] = []
        for f in found:
            if not out or f[0] >= out[-1][1]:
                out.append(f)
        return out


@lru_cache(maxsize=1)
def _finder() -> Finder:
    return Finder()


def find(text: str) -> list[Find]:
    """Entities of a text with the pools of GIVEN."""
    return _finder().find(text)


def luhn(digits: str) -> int:
    """The check digit for digits."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _ip(text: str) -> bool:
    try:
        ipaddress.ip_address(text)
    except ValueError:
        return False
    return True


def ending(low: str) -> str:
    """The ending of a lower-case name that shows a gender, two letters at least before it."""
    for e in ENDINGS:
        if low.endswith(e) and len(low) >= len(e) + 2:
            return e
    return low[-1] if len(low) >= 3 and low[-1] in "aeioáéíóаеияоαηοά" else ""


def _spread(text: str, digits: str) -> str:
    """text with these digits in place of its own."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in text)


class Surrogates:
    """Keyed replacements; given: pools of given names by (script, gender)."""

    def __init__(self, key: bytes = KEY, given: Pools | None = None):
        self.key = blake2b(key, digest_size=32).digest()
        self.of = lru_cache(maxsize=50_000)(self._of)
        self.pool = {n.lower(): (f"{s}:{g}", names, k) for (s, g), names in (given or GIVEN).items() for k, n in enumerate(names)}

    def _hash(self, *parts: object) -> int:
        return int.from_bytes(blake2b("\0".join(map(str, parts)).encode(), key=self.key, digest_size=32).digest())

    def _round(self, tweak: str, size: int, r: int, value: int, mask: int) -> int:
        out = self._hash(tweak, size, r, value)
        for k in range(1, mask.bit_length() // 256 + 1):  # halves longer than a digest
            out = out << 256 | self._hash(tweak, size, r, value, k)
        return out & mask

    def permute(self, n: int, size: int, tweak: str, ok=None) -> int:
        """A permutation without fixed points of range(size), or of those of its members that are ok if n is."""
        if size < 2:
            return n
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1

        def there(n: int) -> int:
            while True:
                left, right = n >> half, n & mask
                for r in range(8):
                    left, right = right, left ^ self._round(tweak, size, r, right, mask)
                n = left << half | right
                if n < size:
                    return n

        def back(n: int) -> int:
            while True:
                left, right = n >> half, n & mask
                for r in range(7, -1, -1):
                    left, right = right ^ self._round(tweak, size, r, left, mask), left
                n = left << half | right
                if n < size:
                    return n

        n = there(n)
        while True:
            n = (n + 1) % size
            new = back(n)
            if ok is None or ok(new):
                return new

    def classes(self, text: str, tweak: str) -> str:
        """Permute letters and digits within their classes; all else stays."""
        sets = [(c, a) for c in text for a in _SETS if c in a]
        n, size = 0, 1
        for c, a in sets:
            n, size = n * len(a) + a.index(c), size * len(a)
        shape = "".join(next((a[0] for a in _SETS if c in a), c) for c in text)
        n = self.permute(n, size, f"{tweak}:{shape}")
        new = []
        for _, a in reversed(sets):
            n, k = divmod(n, len(a))
            new.append(a[k])
        it = iter(reversed(new))
        return "".join(next(it) if any(c in a for a in _SETS) else c for c in text)

    def number(self, digits: str, tweak: str) -> str:
        """Permute a number among those of its length; whether it starts with 0 stays."""
        least = 10 ** (len(digits) - 1) if digits[0] != "0" and len(digits) > 1 else 0
        most = 10 ** (len(digits) - (digits[0] == "0" and len(digits) > 1))
        return f"{least + self.permute(int(digits) - least, most - least, f'{tweak}:{len(digits)}'):0{len(digits)}d}"

    def card(self, text: str) -> str:
        d = "".join(c for c in text if c.isdigit())
        off = (int(d[-1]) - luhn(d[:-1])) % 10
        body = self.number(d[:-1], "card")
        return _spread(text, body + str((luhn(body) + off) % 10))

    def ssn(self, text: str) -> str:
        d = "".join(c for c in text if c.isdigit())
        return _spread(text, self.number(d, "ssn"))

    def phone(self, text: str) -> str:
        d = "".join(c for c in text if c.isdigit())
        exit_code = 2 if d.startswith("00") and text[0] != "+" else 0
        if text[0] == "+" or exit_code:
            rest = d[exit_code:]
            keep = exit_code + (1 if rest[0] in "17" else 2 if rest[:2] in CODES else 3)
        else:
            keep = 0
        code = d[exit_code:keep]
        if "(0)" in text or not keep:  # a trunk prefix is not part of the number
            keep += len(d[keep:]) - len(d[keep:].lstrip("0")) if not code else d[keep : keep + 1] == "0"
        return _spread(text, d[:keep] + self.number(d[keep:], f"phone{code}")) if d[keep:] else text

    def ip(self, text: str) -> str:
        a = ipaddress.ip_address(text)
        kind = a.is_private
        n = self.permute(int(a), 2**a.max_prefixlen, f"ip{a.version}", lambda x: type(a)(x).is_private == kind) if not kind or a.version == 6 else None
        if n is None:  # private networks are too few of all addresses to walk to
            net = next((x for x in map(ipaddress.ip_network, ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8")) if a in x), ipaddress.ip_network(f"{a}/24", strict=False))
            first = int(net.network_address)
            n = first + self.permute(int(a) - first, net.num_addresses, f"ip{net}")
        return str(type(a)(n))

    def email(self, text: str) -> str:
        local, _, domain = text.rpartition("@")
        labels = domain.lower().split(".")
        keep = 2 if ".".join(labels[-2:]) in RESERVED else 1
        new = [self.classes(x, f"label{k}") for k, x in enumerate(labels[:-keep])] + labels[-keep:]
        plain = self.classes(local.lower(), "local")
        cased = "".join(n.upper() if o.isupper() else n for o, n in zip(local, plain, strict=True)) if len(plain) == len(local) else plain
        return f"{cased}@{'.'.join(new)}"

    def iban(self, text: str) -> str:
        plain = text.replace(" ", "")
        number = lambda s: int("".join(str(int(c, 36)) for c in s))
        off = (int(plain[2:4]) - (98 - number(plain[4:] + plain[:2] + "00") % 97)) % 97
        body = self.classes(plain[4:], plain[:2])
        check = (98 - number(body + plain[:2] + "00") % 97 + off) % 97
        it = iter(f"{plain[:2]}{check if off or check > 1 else check + 97:02d}{body}")
        return "".join(c if c == " " else next(it) for c in text)

    def word(self, word: str) -> str:
        """One word of a name."""
        low = word.lower()
        if low in PARTICLES or len(low) != len(word):
            return word
        if low in self.pool:
            tweak, names, k = self.pool[low]
            new = names[self.permute(k, len(names), f"given{tweak}")]
            return new.upper() if word.isupper() else new
        end = ending(low)
        stem = low[: len(low) - len(end)]
        sets = [_CLASS[c] for c in stem if c in _CLASS]
        n, size = 0, 1
        for c in stem:
            if c in _CLASS:
                n, size = n * len(_CLASS[c]) + _CLASS[c].index(c), size * len(_CLASS[c])

        family = next((f for f in FAMILIES if end in f), [end])

        def told(n: int) -> str:
            new = []
            for a in reversed(sets):
                n, k = divmod(n, len(a))
                new.append(a[k])
            it = iter(reversed(new))
            return "".join(next(it) if c in _CLASS else c for c in stem)

        def kind(n: int) -> list[bool]:  # whether it is no name of a pool, no particle and of no other ending, with each ending of its family
            new = told(n)
            return [new + e not in self.pool and new + e not in PARTICLES and ending(new + e) == e for e in family]

        own = kind(n)
        shape = "".join(_CLASS[c][0] if c in _CLASS else c for c in stem)
        new = told(self.permute(n, size, f"name{shape}:{family[0]}", lambda x: kind(x) == own)) + end
        return "".join(y.upper() if x.isupper() else y for x, y in zip(word, new, strict=True))

    def name(self, text: str) -> str:
        return _WORD.sub(lambda m: self.word(m.group()), text)

    def _of(self, text: str, kind: str) -> str:
        if kind == "secret":
            return self.classes(text, "secret") if not re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text) else self.hexes(text)
        return getattr(self, kind)(text)

    def hexes(self, text: str) -> str:
        new = f"{self.permute(int(text, 16), 16 ** len(text), f'hex{len(text)}'):0{len(text)}x}"
        return new.upper() if text.isupper() else new


def replace(text: str, s: Surrogates, finder: Finder | None = None) -> tuple[str, list[tuple[str, int, int, str]]]:
    """The text with surrogates, and (type, start, end, surrogate) of each, by places in the original."""
    out, at, spans = [], 0, []
    for start, end, kind in (finder or _finder()).find(text):
        new = s.of(text[start:end], kind)
        out += [text[at:start], new]
        spans.append((kind, start, end, new))
        at = end
    return "".join(out) + text[at:] if spans else text, spans


def surrogated(docs: DataFrame, key: bytes = KEY, given: Pools | None = None) -> DataFrame:
    """doc_id, text with surrogates, n_entities and entities (type, start, end, surrogate) of each row of docs (doc_id, text)."""
    lean(docs.sparkSession)
    entity = pa.struct([("type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string())])

    @tidy
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, finder = Surrogates(key, given), Finder(given)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                got = [(None, []) if t is None else replace(t, s, finder) for t in part.column(1).to_pylist()]
                spans = [[dict(zip(("type", "start", "end", "surrogate"), x, strict=True)) for x in g[1]] for g in got]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([len(g[1]) for g in got], pa.int32()), pa.array(spans, pa.list_(entity))], names=["doc_id", "text", "n_entities", "entities"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(over, f"doc_id {kind}, text string, n_entities int, entities array<struct<type string, start int, end int, surrogate string>>")


def replaced(docs: DataFrame, key: bytes = KEY, given: Pools | None = None) -> DataFrame:
    """docs with surrogates in `text`, and n_chars, if there is one, to match; other columns as they were."""
    lean(docs.sparkSession)
    at = docs.columns.index("text")

    @tidy
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, finder = Surrogates(key, given), Finder(given)
        for b in batches:
            new = pa.array([None if t is None else replace(t, s, finder)[0] for t in b.column(at).to_pylist()], b.schema.field(at).type)
            yield b.set_column(at, b.schema.field(at), new)

    out = docs.mapInArrow(over, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogated(table(spark, sf_dir, "documents"))
