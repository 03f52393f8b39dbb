"""Personal data, replaced by surrogates.

Detected: e-mail addresses, telephone and card numbers, IP addresses, social security numbers, secrets that are
assigned to a name such as ``token``, and names after a form of address, with the bare mentions of these names in
the same text. Mentions of one entity that only differ in
punctuation, spaces or case are brought to one value. The surrogate of a value comes from a keyed hash
(HMAC-SHA256), keeps its type, length, script and, for names, the gender that most of its mentions tell, and is written like
the mention: same separators, same case; card numbers that pass the Luhn check still do.

Equal values get equal surrogates in the whole corpus, and different values different ones: in rounds, surrogates
that are also a real value of the corpus, that are taken, or that two values share (the smaller value keeps it)
are refused, and the values left without one try the next keyed hash. After ``ATTEMPTS`` rounds the n-th value
of those left in a block (surrogates of one form) gets the n-th free surrogate of the block, listed in pieces that grow;
behind its end the list goes on with a wider block: more letters or syllables, the private addresses of
10.0.0.0/8 and then public ones, a free first digit. Only where a whole format is used up there is an error.

Rows without personal data, and all other columns, stay as they are; a null text stays null. Repeated rows are
replaced alike.
"""

from __future__ import annotations

import bisect
import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache
from ipaddress import ip_address, ip_network
from itertools import chain, count
from math import prod

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.arrow import release, ship, unused
from millrace.session import fresh_dir

_EMAIL = re.compile(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}")
_IP = re.compile(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)")
_SSN = re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")
_CARD = re.compile(r"(?<![\d-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![\d-])")
_PHONE = re.compile(
    r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}|\d{3}[ .-]\d{3,4}[ .-]\d{4})(?![\w])"
    r"|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?![\w])"
)
_SECRET = re.compile(
    r"\b(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b\s*[:=]\s*([\"']?)([^\s\"']{6,})\1"
)
# Forms of address with the gender they tell.
_TITLES = {
    "Mr": "m", "Mister": "m", "Sir": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Don": "m", "Господин": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Madam": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Señora": "f",
    "Doña": "f", "Госпожа": "f", "Dr": "n", "Prof": "n",
}
_NAME = re.compile(
    rf"\b({'|'.join(sorted(_TITLES, key=len, reverse=True))})\.? "
    r"((?:[^\W\d_a-zа-я][^\W\d_]+)(?:[ -][^\W\d_a-zа-я][^\W\d_]+){0,2})"
)
# Names of the surrogates, by script and gender; family names serve both.
_GIVEN = {
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Martin Nico Oscar Paul".split(),
    ("latin", "f"): "Anna Berta Clara Diana Emma Flora Greta Helena Ida Julia Klara Laura Maria Nora Olga Paula".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Захар Иван Кирилл Лев Максим Никита".split(),
    ("cyrillic", "f"): "Анна Белла Вера Галина Дарья Ева Зоя Инна Клара Лидия Мария Нина".split(),
}
_ONSETS = {"latin": "B D F G H K L M N P R S T V W".split(), "cyrillic": "Б В Г Д К Л М Н П Р С Т".split()}
_RHYMES = {"latin": "al en ir or un est ard ing".split(), "cyrillic": "ал ен ир ор ун ест ард инг".split()}
_LETTERS = [
    "abcdefghijklmnopqrstuvwxyz",
    "àáâãäåæçèéêëìíîïñòóôõöøùúûüýßœ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя",
    "αβγδεζηθικλμνξοπρστυφχψω",
]
_LETTER = {c: letters for letters in _LETTERS for c in letters}
# Blocks of addresses for a purpose, with the number of leading parts that name the block.
_BLOCKS = [
    (ip_network(block), keep)
    for block, keep in {
        "10.0.0.0/8": 1, "100.64.0.0/16": 2, "127.0.0.0/8": 1, "169.254.0.0/16": 2, "172.16.0.0/12": 2, "192.0.0.0/24": 3,
        "192.0.2.0/24": 3, "192.168.0.0/16": 2, "198.18.0.0/15": 2, "198.51.100.0/24": 3, "203.0.113.0/24": 3,
        "0.0.0.0/8": 1, "240.0.0.0/4": 1,
    }.items()
]
# Words with a capital letter that are no names, even behind a form of address.
_NO_NAMES = set("who what which where when why how the this that he she it they we you i no not and or but if".split())

ATTEMPTS = 8  # keyed hashes that are tried for a value, before free surrogates are listed
MARKS_FROM = 4
LISTED = 256  # free surrogates sought in a block at first; each further piece is four times as long
PIECE = 4096  # surrogates listed by one row
SPANS = "array<struct<kind:string,value:string,start:int,stop:int>>"


def _luhn(digits: str) -> bool:
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _name(mention: str) -> str:
    return " ".join(re.split(r"[ -]", mention.casefold()))


def _secretive(value: str) -> bool:
    """Not just a word: with digits, marks or capital letters inside."""
    return bool(re.search(r"\d|[^\W_][^\w\s]|(?<=.)[A-Z]", value))


def detect(text: str) -> list[tuple[str, str, int, int]]:
    """Kind, value, first character and end of each mention; mentions do not overlap."""
    found: list[tuple[str, str, int, int]] = []
    if "@" in text:
        found += [("email", m[0].lower(), *m.span()) for m in _EMAIL.finditer(text)]
    if "=" in text or ":" in text:
        for m in _SECRET.finditer(text):
            # Marks at the end belong to the sentence, unless quotes say otherwise.
            value = m[2] if m[1] else m[2].rstrip(".,;:!?)")
            if len(value) >= 6 and (m[1] or _secretive(value)):
                found.append(("secret", value, m.start(2), m.start(2) + len(value)))
    if re.search(r"\d\d", text) or re.search(r"\d\.\d", text):
        for m in _IP.finditer(text):
            before = text[max(0, m.start() - 12) : m.start()].lower().split()
            if before and re.fullmatch(r"v|ver\.?|version|release", before[-1]):
                continue
            if all(int(part) < 256 and str(int(part)) == part for part in m[0].split(".")):
                found.append(("ip", m[0], *m.span()))
        found += [("ssn", _digits(m[0]), *m.span()) for m in _SSN.finditer(text)]
        found += [("card", _digits(m[0]), *m.span()) for m in _CARD.finditer(text)]
        found += [("phone", _digits(m[0]), *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    if any(title in text for title in _TITLES):
        titled = [m for m in _NAME.finditer(text) if re.split(r"[ -]", m[2])[0].lower() not in _NO_NAMES]
        found += [(f"name-{_TITLES[m[1]]}", _name(m[2]), *m.span(2)) for m in titled]
        if titled:
            # The same names without a form of address; a longer name is sought before one that it holds.
            known = {_name(m[2]): re.split(r"[ -]", m[2]) for m in titled}
            forms = sorted({"[ -]".join(map(re.escape, words)) for words in known.values()}, key=len, reverse=True)
            for m in re.finditer(rf"(?<!\w)(?:{'|'.join(forms)})(?!\w)", text, re.IGNORECASE):
                if _name(m[0]) in known and not any(w[0].islower() for w in re.split(r"[ -]", m[0])):
                    found.append(("name-n", _name(m[0]), *m.span()))
    # The kinds above stand in order of how sure they are.
    kept: list[tuple[int, int, str, str]] = []
    for kind, value, start, stop in found:
        at = bisect.bisect(kept, (start, stop))
        if (at == 0 or kept[at - 1][1] <= start) and (at == len(kept) or kept[at][0] >= stop):
            kept.insert(at, (start, stop, kind, value))
    return [(kind, value, start, stop) for start, stop, kind, value in kept]


class _Draw:
    """A keyed stream of numbers for one value and attempt."""

    def __init__(self, key: bytes, *parts: str):
        self.key, self.parts, self.count, self.bits, self.left = key, "\x00".join(parts).encode(), 0, 0, 0

    def below(self, n: int) -> int:
        if self.left < 64:
            self.count += 1
            block = hmac.new(self.key, self.parts + b"\x00%d" % self.count, hashlib.sha256).digest()
            self.bits, self.left = int.from_bytes(block, "big"), 256
        value = self.bits & ((1 << 64) - 1)
        self.bits >>= 64
        self.left -= 64
        return value % n


@lru_cache(maxsize=10_000)
def _alphabet(c: str) -> str:
    """The lower-case letters, or the digits, that ``c`` may become: those of its own script; empty for marks."""
    low = c.lower()
    if low in _LETTER:
        return _LETTER[low]
    kind = unicodedata.category(c)
    if not c.isalnum() and kind[0] != "M":  # marks that stand on letters are replaced like these
        return ""
    if "㐀" <= c <= "鿿":
        return "".join(map(chr, range(0x4E00, 0x9E00)))
    script = lambda x: unicodedata.name(x, "").split(" ")[0]
    near = range(ord(c) & ~0xFF, (ord(c) & ~0xFF) + 256)
    found = "".join(chr(i) for i in near if unicodedata.category(chr(i)) == kind and script(chr(i)) == script(c))
    # Letters of a script that has but one here become Latin ones.
    return found if len(found) > 1 else _LETTERS[0]


def _like(text: str, draw: _Draw, attempt: int = 0) -> str:
    """Each letter replaced by another one of its own script and case, each digit by a digit; after some attempts marks as well."""
    out = []
    for c in text:
        if attempt >= MARKS_FROM and not c.isalnum():
            c = "a"
        if c.isdigit() and c.isascii():
            out.append(str(draw.below(10)))
        elif letters := _alphabet(c):
            new = letters[draw.below(len(letters))]
            if new == c.lower():
                new = letters[(letters.index(new) + 1) % len(letters)]
            out.append(new.upper() if c.isupper() and len(new.upper()) == 1 else new)
        else:
            out.append(c)
    return "".join(out)


def surrogate(key: bytes, kind: str, value: str, attempt: int) -> str:
    """What stands for ``value``; another one for each attempt."""
    draw = _Draw(key, kind, value, str(attempt))
    if kind == "email":
        local, _, domain = value.rpartition("@")
        *labels, top = domain.split(".")
        # Addresses of one domain keep a common one.
        return f"{_like(local, draw, attempt)}@{_like('.'.join(labels), _Draw(key, 'domain', domain))}.{top}"
    if kind == "secret":
        if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value):
            hexes = "0123456789abcdef" if value == value.lower() else "0123456789ABCDEF"
            return "".join(hexes[draw.below(16)] for _ in value)
        return _like(value, draw, attempt)
    if kind == "ip":
        return _ip_like(value, draw)
    if kind == "card":
        digits = value[0] + "".join(str(draw.below(10)) for _ in value[1:])
        if _luhn(value):
            digits = next(d for d in (digits[:-1] + str(i) for i in range(10)) if _luhn(d))
        return digits
    if kind in ("phone", "ssn"):
        # The first digit may be a country code.
        return value[0] + "".join(str(draw.below(10)) for _ in value[1:])
    return _name_like(kind[-1], value, draw, attempt)


def _kept_parts(value: str) -> int:
    """How many leading parts name the block of addresses for a purpose; 0 for public ones."""
    address = ip_address(value)
    return next((keep for block, keep in _BLOCKS if address in block), 0)


def _ip_like(value: str, draw: _Draw) -> str:
    parts = value.split(".")
    if keep := _kept_parts(value):  # stays in its block
        return ".".join(parts[:keep] + [str(draw.below(256)) for _ in parts[keep:]])
    while True:
        new = ".".join([str(1 + draw.below(223)), *(str(draw.below(256)) for _ in range(3))])
        if ip_address(new).is_global and not _kept_parts(new):
            return new


def _script(value: str) -> str | None:
    """The script whose names are known; None for others, whose letters are replaced one by one."""
    first = next((unicodedata.name(c, "").split(" ")[0].lower() for c in value if c.isalpha()), "latin")
    return first if first in ("latin", "cyrillic") else None


def _name_like(gender: str, value: str, draw: _Draw, attempt: int) -> str:
    script = _script(value)
    if script is None:
        return _like(value, draw)
    words = value.split(" ")
    family = lambda: "".join(
        _ONSETS[script][draw.below(len(_ONSETS[script]))].lower() + _RHYMES[script][draw.below(8)]
        for _ in range(2 + attempt // 4)
    )
    if len(words) == 1:
        return family()
    given = _GIVEN[(script, gender if gender != "n" else "mf"[draw.below(2)])]
    return " ".join([given[draw.below(len(given))].lower(), *(family() for _ in words[1:])])


def _choices(text: str, marks: bool = False) -> list[Sequence[str]]:
    """What each character may become, as in ``_like``."""
    out: list[Sequence[str]] = []
    for c in text:
        if marks and not c.isalnum():
            c = "a"
        if c.isdigit() and c.isascii():
            out.append("0123456789")
        elif letters := _alphabet(c):
            out.append([x.upper() if c.isupper() and len(x.upper()) == 1 else x for x in letters])
        else:
            out.append([c])
    return out


def _blocks(key: bytes, kind: str, value: str) -> Iterator[list[Sequence[str]]]:
    """The surrogates that a value may get, as choices for each part; each block is wider than the one before."""
    if kind == "email":
        local, _, domain = value.rpartition("@")
        *labels, top = domain.split(".")
        tail = [f"@{_like('.'.join(labels), _Draw(key, 'domain', domain))}.{top}"]
        for more in count():
            yield [*_choices(local), *[_LETTERS[0]] * more, tail]
    elif kind == "secret":
        hexes = next((h for h in ("0123456789abcdef", "0123456789ABCDEF") if set(value) <= set(h)), None)
        for more in count():
            yield [hexes] * (len(value) + more) if hexes else [*_choices(value, True), *[_LETTERS[0]] * more]
    elif kind == "ip":
        part = [f".{i}" for i in range(256)]
        if keep := _kept_parts(value):
            yield [[".".join(value.split(".")[:keep])], *[part] * (4 - keep)]
            yield [["10"], *[part] * 3]
        yield [[str(i) for i in range(1, 224)], *[part] * 3]
    elif kind in ("card", "phone", "ssn"):
        # The last digit of a card that passes the check is found from the others.
        rest = ["0123456789"] * (len(value) - 1 - (kind == "card" and _luhn(value)))
        yield [value[0], *rest]
        yield ["123456789", *rest]
    elif (script := _script(value)) is None:
        for more in count():
            yield [*_choices(value), *[_alphabet(value[0])] * more]
    else:
        words = len(value.split(" "))
        genders = "mf" if kind[-1] == "n" else kind[-1]
        given = [g.lower() for x in genders for g in _GIVEN[(script, x)]]
        syllables = [o.lower() + r for o in _ONSETS[script] for r in _RHYMES[script]]
        for more in count():
            family = [syllables] * (2 + more)
            yield family if words == 1 else [given, *chain(*[[[" "], *family]] * (words - 1))]


def listed(key: bytes, kind: str, value: str, first: int, stop: int) -> Iterator[str]:
    """The surrogates from number ``first`` up to ``stop`` of the list of the block that ``value`` is in."""
    for block in _blocks(key, kind, value):
        size = prod(map(len, block))
        for n in range(first, min(stop, size)):
            out = []
            for options in reversed(block):
                n, at = divmod(n, len(options))
                out.append(options[at])
            new = "".join(reversed(out))
            if kind == "card" and len(new) < len(value):
                new = next(d for d in (new + str(i) for i in range(10)) if _luhn(d))
            if kind != "ip" or ip_address(new).is_global or len(block[0]) == 1:
                yield new
        first, stop = max(0, first - size), stop - size
        if stop <= 0:
            return


def write_like(kind: str, mention: str, value: str) -> str:
    """The surrogate ``value`` in the form of the mention: its separators, its case."""
    if kind in ("phone", "card", "ssn"):
        digits = iter(value)
        return "".join(next(digits) if c.isdigit() else c for c in mention)
    if kind == "email" and len(mention) == len(value):
        return "".join(n.upper() if o.isupper() and len(n.upper()) == 1 else n for o, n in zip(mention, value))
    if kind.startswith("name"):
        separators = re.findall(r"[ -]", mention)
        words = [w.upper() if mention.isupper() else w.capitalize() for w in value.split(" ")]
        return "".join(w + s for w, s in zip(words, [*separators, ""]))
    return value


def _detected(docs: DataFrame, text_col: str, with_data: bool) -> DataFrame:
    """The rows with personal data and the mentions in them, or the rows without any."""
    ship(docs.sparkSession)
    place, spans_col = docs.columns.index(text_col), unused(docs.columns, "__spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(
            pa.struct([("kind", pa.string()), ("value", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])
        )
        for batch in batches:
            spans = [detect(t) if t else [] for t in batch.column(place).to_pylist()]
            keep = pa.array([bool(s) == with_data for s in spans], pa.bool_())
            if not with_data:
                yield batch.filter(keep)
                continue
            column = pa.array([[dict(zip(("kind", "value", "start", "stop"), s)) for s in own] for own in spans], kind)
            full = pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, spans_col])
            yield full.filter(keep)
        release()

    schema = docs.schema
    if with_data:
        schema = T.StructType([*schema.fields, T.StructField(spans_col, T.DataType.fromDDL(SPANS))])
    return docs.mapInArrow(run, schema)


def _group(kind: str) -> Column:
    """All names are one group, whatever their gender: equal names are one person, and no two share a surrogate."""
    return F.when(F.col(kind).startswith("name"), F.lit("name")).otherwise(F.col(kind))


def assign(entities: DataFrame, key: bytes, base: str) -> DataFrame:
    """``kind, value, surrogate``: one to one among all names and within any other kind, and no surrogate is a value.

    ``entities`` are distinct, and a name has one kind.
    """
    spark = entities.sparkSession
    pending, done, step, piece, before = entities, None, 0, 0, None
    real = entities.select(_group("kind").alias("group"), F.col("value").alias("surrogate"))
    while not pending.isEmpty():

        def run(batches: Iterator[pa.RecordBatch], attempt: int = step) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kinds, values = (c.to_pylist() for c in batch.columns)
                new = [surrogate(key, k, v, attempt) for k, v in zip(kinds, values)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], ["kind", "value", "surrogate"])

        used = real if done is None else real.unionByName(done.select(_group("kind").alias("group"), "surrogate"))
        if step < ATTEMPTS:
            tried = pending.select("kind", "value").mapInArrow(run, "kind string, value string, surrogate string")
        else:
            first = LISTED * (4**piece - 1) // 3
            tried = _nth_free(pending.select("kind", "value"), used, key, f"{base}/listed{step}", first, first + LISTED * 4**piece)
            piece += 1
        tried.write.parquet(f"{base}/tried{step}")
        tried = spark.read.parquet(f"{base}/tried{step}")
        free = tried.where("surrogate is not null").withColumn("group", _group("kind"))
        free = free.join(used, ["group", "surrogate"], "left_anti")
        free = free.groupBy("group", "surrogate").agg(F.min(F.struct("value", "kind")).alias("first"))
        free = free.select("first.kind", "first.value", "surrogate")
        free.write.parquet(f"{base}/free{step}")
        free = spark.read.parquet(f"{base}/free{step}")
        done = free if done is None else done.unionByName(free)
        pending = tried.select("kind", "value").join(free.select("kind", "value"), ["kind", "value"], "left_anti")
        step += 1
        if piece and not tried.where("ended").isEmpty():
            # A list was read to its end: what another block took away meanwhile is sought from the start again.
            left = pending.count()
            if left == before:
                raise RuntimeError("there are too few surrogates of some kind for so many values")
            before, piece = left, 0
    return entities.withColumn("surrogate", F.lit("")).limit(0) if done is None else done


def _nth_free(pending: DataFrame, used: DataFrame, key: bytes, base: str, first: int, stop: int) -> DataFrame:
    """``kind, value, surrogate, ended``: the n-th value left in a block gets the n-th free one of a piece of its list.

    ``surrogate`` is null where there is none; ``ended`` where the list has no more behind the piece.
    """
    spark = pending.sparkSession

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            block = [hashlib.md5(repr((k, next(_blocks(key, k, v)))).encode()).hexdigest() for k, v in rows]
            order = [hmac.new(key, v.encode(), hashlib.sha256).hexdigest() for _, v in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block), pa.array(order)], ["kind", "value", "block", "order"])

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, kind, value, low in zip(*(c.to_pylist() for c in batch.columns)):
                new = pa.array(list(listed(key, kind, value, low, min(low + PIECE, stop))), pa.string())
                columns = [pa.array([x] * len(new), pa.string()) for x in (block, kind)]
                columns += [new, pa.array(range(low, low + len(new)), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["block", "kind", "surrogate", "order"])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, kinds, values = (c.to_pylist() for c in batch.columns)
            sizes = [
                sum(prod(map(len, b)) for b in _blocks(key, k, v)) if k in ("ip", "card", "phone", "ssn") else stop + 1
                for k, v in zip(kinds, values)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n <= stop for n in sizes])], ["block", "ended"])

    pending.mapInArrow(place, "kind string, value string, block string, order string").write.parquet(f"{base}/placed")
    placed = spark.read.parquet(f"{base}/placed")
    blocks = placed.groupBy("block").agg(F.min(F.struct("kind", "value")).alias("v")).select("block", "v.kind", "v.value")
    lows = F.sequence(F.lit(first), F.lit(stop - 1), F.lit(PIECE))
    rows = blocks.select("block", "kind", "value", F.explode(lows).alias("low")).repartition("block", "low")
    new = rows.mapInArrow(members, "block string, kind string, surrogate string, order long")
    # A narrow block can be a part of a wider one: the first place counts.
    new = new.groupBy("block", "kind", "surrogate").agg(F.min("order").alias("order"))
    new = new.withColumn("group", _group("kind")).join(used, ["group", "surrogate"], "left_anti")
    new = _ranked(new.select("block", "surrogate", "order"), f"{base}/free")
    ended = blocks.mapInArrow(ends, "block string, ended boolean")
    return (
        _ranked(placed, f"{base}/left")
        .join(new.drop("order"), ["block", "rank"], "left")
        .join(ended, "block")
        .select("kind", "value", "surrogate", "ended")
    )


def _ranked(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` with their ``rank`` by ``order`` in their ``block``, also where one block is in many tasks."""
    rows = rows.repartitionByRange("block", "order").sortWithinPartitions("block", "order")
    rows.withColumn("__at", F.monotonically_increasing_id()).write.parquet(path)
    rows = rows.sparkSession.read.parquet(path).withColumn("__part", F.shiftright("__at", 33))
    parts = rows.groupBy("block", "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    over = Window.partitionBy("block").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__less", F.coalesce(F.sum("__n").over(over), F.lit(0)))
    rows = rows.join(parts, ["block", "__part"])
    return rows.withColumn("rank", F.col("__at") - F.col("__first") + F.col("__less")).drop("__at", "__part", "__first", "__n", "__less")


def replace_personal_data(docs: DataFrame, key: bytes, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``docs`` with surrogates in the text, and ``kind, value, surrogate`` of all entities."""
    return _replace(docs, key, text_col, counted=False)


def _replace(docs: DataFrame, key: bytes, text_col: str, counted: bool) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    base = fresh_dir(spark, "surrogates")
    # Numbered and written once: a number that is made anew could differ after a lost executor.
    row_col, spans_col, new_col = (unused(docs.columns, name) for name in ("__row", "__spans", "__new"))
    found = _detected(docs, text_col, True).withColumn(row_col, F.monotonically_increasing_id())
    found.write.parquet(f"{base}/found")
    found = spark.read.parquet(f"{base}/found")
    mentions = found.select(F.col(row_col).alias("row"), F.explode(spans_col).alias("m")).select("row", "m.*")
    mentions = mentions.withColumn("group", _group("kind"))
    tells = lambda gender: F.count(F.when(F.col("kind") == f"name-{gender}", 1))
    entities = mentions.groupBy("group", "value").agg((tells("m") - tells("f")).alias("more"))
    gender = F.when(F.col("more") > 0, F.lit("name-m")).when(F.col("more") < 0, F.lit("name-f")).otherwise(F.lit("name-n"))
    entities = entities.select(F.when(F.col("group") == "name", gender).otherwise(F.col("group")).alias("kind"), "value")
    entities.write.parquet(f"{base}/entities")
    names = assign(spark.read.parquet(f"{base}/entities"), key, base)
    new = mentions.join(names.select(_group("kind").alias("group"), "value", "surrogate"), ["group", "value"])
    new = new.groupBy(F.col("row").alias(row_col)).agg(F.collect_list(F.struct("kind", "start", "stop", "surrogate")).alias(new_col))
    place = docs.columns.index(text_col)
    schema = docs.schema
    extra = T.StructField("n_mentions", T.LongType())
    out = T.StructType([*schema.fields, extra]) if counted else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, columns = [], list(batch.columns[:-1])
            mentions = batch.column(batch.num_columns - 1).to_pylist()
            for text, own in zip(batch.column(place).to_pylist(), mentions):
                for m in sorted(own, key=lambda m: -m["start"]):
                    text = text[: m["start"]] + write_like(m["kind"], text[m["start"] : m["stop"]], m["surrogate"]) + text[m["stop"] :]
                texts.append(text)
            columns[place] = pa.array(texts, columns[place].type)
            if counted:
                columns.append(pa.array([len(m) for m in mentions], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, out.names)
        release()

    changed = found.join(new, row_col).select(*[F.col(f"`{c}`") for c in docs.columns], new_col).mapInArrow(run, out)
    clean = _detected(docs, text_col, False)
    if counted:
        clean = clean.withColumn("n_mentions", F.lit(0).cast("long"))
    return changed.unionByName(clean), names


def surrogates(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, n_mentions`` of every row, with surrogates in the text."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _replace(own, key, "text", counted=True)[0]
