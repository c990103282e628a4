"""Surrogates for personal data.

Method: detected entities get keyed replacements of the same kind, format, script and gender. A replacement depends on the secret
key, the kind and the entity alone, so one entity has one replacement wherever it stands (coreference). Names are replaced part by
part: the text of a part gives the stem, and the gender, settled per person over the whole document, its ending. Over the distinct
entities of the whole table a check looks for two entities with one replacement, and for replacements that are entities themselves,
all kinds of names together; those draw again until none is left (distinctness).

The secret key is the setting `spark.barwright.surrogateKey`; where it is not set, an application draws one of its own, so that nobody
can rebuild the table of surrogates, and another application gives other ones.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import secrets
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from barwright.llm.common import batch_of, fresh, map_arrow
from barwright.session import materialize

KEY_SETTING = "spark.barwright.surrogateKey"
_drawn_keys: dict[str, bytes] = {}
# So many redrawn entities travel with the program text of a task; more are joined to their documents.
CARRIED = 10_000
# The label that is set apart for examples stays.
RESERVED = "example"

EMAIL = re.compile(r"(?<![\w.%+-])[\w.%+-]+@[\w-]+(?:\.[\w-]+)+")
SECRET = re.compile(r"(?i)\b(?:api[_-]?key|access[_-]?key|secret|token|passw(?:or)?d)\b[\"']?\s*[=:]\s*[\"']?([A-Za-z0-9+/_-]{8,})|\b(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|(?=[0-9a-f]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{32,})\b")
IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
CARD = re.compile(r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])")
PHONE = re.compile(r"(?<![\w+])(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[.-])\d{3}[ .-]\d{4}|\+\d{1,3}(?:[ .-]\(?\d{1,8}\)?){1,6}|\+\d{9,15})(?![\w])")
# Forms without marks: ten digits in blanks or bare, and national numbers with a leading zero. Parts of longer numbers, decimals, paths and ids do not count.
PLAIN_PHONE = re.compile(r"(?<![\w+.,$€£#/-])(?<!\w\d\d[ .-])(?:\d{3} \d{3} \d{4}|[2-9]\d{9}|0\d{2,4}[ -]\d{3,4}[ -]\d{3,4}|0\d{9,10})(?!\w|[.,]\d|[ -]\d{3})")
SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
ADDRESS = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)")
# Groups between colons; what is an address is settled by reading it.
ADDRESS6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4})?(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:]|\.\d)")
# Titles and the gender they tell (fixed values).
MALE = "Mr|Mister|Sir|Herr|Monsieur|Señor|Sr|Signor|господин|г-н|κύριος"
FEMALE = "Mrs|Ms|Miss|Madam|Frau|Madame|Mme|Mlle|Señora|Sra|Signora|госпожа|г-жа|κυρία"
EITHER = "Dr|Prof|Professor|Доктор"
PERSON = re.compile(rf"\b({MALE}|{FEMALE}|{EITHER})\.? ((?:[^\W\d_a-z][^\W\d_]+(?:[-'’][^\W\d_]+)?)(?: [^\W\d_a-z][^\W\d_]+(?:[-'’][^\W\d_]+)?){{0,2}})")
POSSESSIVE = re.compile("['’]s$")
_MALE, _FEMALE = set(MALE.split("|")), set(FEMALE.split("|"))
# Syllables and endings of invented names (fixed values).
SYLLABLES = {
    "latin": ("ba be bo da de do fa fe ga go ka ke ko la le lo ma me mo na ne no pa pe po ra re ro sa se so ta te to va ve vo").split(),
    "cyrillic": "ба бе бо да де до ка ке ко ла ле ло ма ме мо на не но па по ра ре ро са се со та те то ва ве во".split(),
    "greek": "βα βε δα δε κα κε λα λε μα με να νε πα πε ρα ρε σα σε τα τε".split(),
}
ENDINGS = {
    "latin": {"m": ["nus", "ldo", "rik", "ton"], "f": ["na", "lia", "rina", "tte"], "n": ["lin", "ril", "ren"], "family": ["rman", "lson", "ndez", "rtin", "lli"]},
    "cyrillic": {"m": ["слав", "мир", "тон"], "f": ["на", "ла", "рина"], "n": ["лин", "рен"], "family": ["нов", "рин", "ленко"], "family_f": ["нова", "рина", "ленко"], "family_n": ["ленко"]},
    "greek": {"m": ["νος", "ρης"], "f": ["να", "ρία"], "n": ["λι", "ρι"], "family": ["πουλος", "ίδης"]},
}


def session_key(spark: SparkSession) -> bytes:
    """The key that the session names, else one drawn for this application."""
    named = spark.conf.get(KEY_SETTING, None)
    return named.encode() if named else _drawn_keys.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


class Draw:
    """Numbers from a keyed hash, as many as needed."""

    def __init__(self, key: bytes, *parts: object):
        self.key, self.seed, self.count, self.held = key, "\x1f".join(map(str, parts)).encode(), 0, 0
        self.left = 1

    def below(self, n: int) -> int:
        if self.left < n << 32:
            self.held = int.from_bytes(hmac.new(self.key, self.seed + self.count.to_bytes(4, "big"), hashlib.sha256).digest(), "big")
            self.left, self.count = 1 << 256, self.count + 1
        self.held, out = divmod(self.held, n)
        self.left //= n
        return out

    def like(self, char: str, hexadecimal: bool = False) -> str:
        """A character of the same class, case and script."""
        if hexadecimal and char in "abcdefABCDEF":
            return ("abcdef" if char.islower() else "ABCDEF")[self.below(6)]
        if char.isdecimal():
            return str(self.below(10))
        if char.isascii() and char.isalpha():
            return chr((97 if char.islower() else 65) + self.below(26))
        if char.isalpha():
            block = ord(char) & ~31
            same = [c for c in map(chr, range(block, block + 32)) if c.isalpha() and c.islower() == char.islower() and c.isupper() == char.isupper()]
            return same[self.below(len(same))]
        return char


def luhn(digits: str) -> int:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10


def remainder97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def script_of(name: str) -> str | None:
    code = max(map(ord, name))
    return "latin" if code < 0x250 else "greek" if 0x370 <= code < 0x400 else "cyrillic" if 0x400 <= code < 0x530 else None


def fill(shape: str, digits: str) -> str:
    """The digits in the places of the digits of the shape."""
    digits = iter(digits)
    return "".join(next(digits) if c.isdecimal() else c for c in shape)


def is_address6(text: str) -> bool:
    """Whether these groups are an address: three groups at least and a digit, so that code and clock times are not."""
    if len([group for group in text.split(":") if group]) < 3 or not re.search(r"\d", text):
        return False
    try:
        return bool(ipaddress.IPv6Address(text))
    except ValueError:
        return False


def written(name: str) -> str:
    """A name in capitals as it is written elsewhere, each part with one capital; other names as they are."""
    return re.sub(r"[^\W\d_]+", lambda part: part[0].capitalize(), name) if name.isupper() and len(name) > 1 else name


def surrogate(kind: str, entity: str, attempt: int = 0, key: bytes = b"") -> str:
    """The replacement of one entity; other attempts give others. Formats too small for their entities grow after eight attempts."""
    draw, more = Draw(key, "name" if kind.startswith("name") else kind, entity, attempt), attempt // 8
    if kind == "email":
        local, _, domain = entity.partition("@")
        host, dot, top = domain.rpartition(".")
        of_domain = Draw(key, "domain", domain.lower())
        return "".join(map(draw.like, local)) + "".join(str(draw.below(10)) for _ in range(more)) + "@" + ".".join(label if label == RESERVED else "".join(map(of_domain.like, label)) for label in host.split(".")) + dot + top
    if kind == "secret":
        hexadecimal = not re.search("[^0-9a-f]", entity)
        prefix = re.match("AKIA|gh[pousr]_|", entity)[0]
        return prefix + "".join(draw.like(c, hexadecimal) for c in entity[len(prefix):])
    if kind == "iban":
        body = entity[:2] + "00" + "".join(map(draw.like, entity[4:]))
        check = 98 - remainder97(body.replace(" ", ""))
        return f"{body[:2]}{check:02d}{body[4:]}"
    if kind == "card":
        digits = re.sub(r"\D", "", entity)
        drawn = digits[0] + "".join(str(draw.below(10)) for _ in digits[2:])
        return fill(entity, drawn + str(-luhn(drawn + "0") % 10))
    if kind == "phone":
        country = re.match(r"\+\d{1,3}(?=[ .(-])", entity)
        start = country.end() if country else 0
        digits = re.sub(r"\D", "", entity[start:])
        # A bare number starts with 2 to 9; a leading zero stays.
        least = 2 if entity.isdecimal() and digits[0] != "0" else 1
        drawn = [str(least + draw.below(10 - least))] + [str(draw.below(10)) for _ in digits[1:]]
        if not country and digits[0] == "0":
            drawn = ["0", *drawn[:-1]]
        if not more and len(digits) == 10 and digits[3:6] == "555":
            drawn[3:6] = "555"
        return entity[:start] + fill(entity[start:], "".join(drawn))
    if kind == "ssn":
        return f"{1 + draw.below(665):03d}-{1 + draw.below(99):02d}-{1 + draw.below(9999):04d}"
    if kind == "address6":
        # The first group tells the kind of network and stays; others keep their length until that leaves too few addresses.
        first, *rest = entity.split(":")
        if more:
            return ":".join([first or "2001", *["".join("0123456789abcdef"[draw.below(16)] for _ in range(4)) for _ in range(7)]])
        return ":".join([first, *["".join(draw.like(c, True) for c in group) for group in rest]])
    if kind == "address":
        parts = entity.split(".")
        private = 1 if parts[0] in ("10", "127") else 2 if parts[:2] == ["192", "168"] or parts[0] == "172" and 16 <= int(parts[1]) < 32 else 0
        first = [str(v) for v in range(1, 224) if v not in (10, 127, 172, 192)]
        drawn = [first[draw.below(len(first))]] + [str(draw.below(256)) for _ in range(2)] + [str(1 + draw.below(254))]
        return ".".join(parts[:private] + drawn[private:])
    gender, script = kind.partition("_")[2], script_of(entity)
    if script is None:
        return "".join(map(draw.like, entity)) + "".join(draw.like(entity[-1]) for _ in range(more))
    ends = ENDINGS[script]
    ends = ends.get(gender) or ends["family"]
    name = "".join(SYLLABLES[script][draw.below(len(SYLLABLES[script]))] for _ in range(3 + more)) + ends[draw.below(len(ends))]
    return name.upper() if entity.isupper() and len(entity) > 1 else name.capitalize()


def people(text: str) -> list[tuple[int, int, str, str]]:
    """Parts of names after a title, and the same names, first and family, elsewhere in the text.

    A name in capitals is the name it spells, and is looked for in capitals too. In small letters only whole names are looked for,
    first and family one after the other, as one small word may be any word. A name has one kind in the document as long as the titles do not tell two genders; then each person has its own. A name that
    stands alone belongs to the person named last before it, or else to the first.
    """
    mentions = []
    for match in PERSON.finditer(text):
        parts = []
        for part in re.finditer(r"[^ ]+", match[2]):
            word = POSSESSIVE.sub("", part[0])
            if word[0].islower():
                break
            parts.append((match.start(2) + part.start(), word))
            if word != part[0]:
                break
        if parts:
            mentions.append(("m" if match[1] in _MALE else "f" if match[1] in _FEMALE else "n", parts))
    if not mentions:
        return []
    # Capitals stand for the spelling of the document, if it has one.
    spelled = {word.upper(): word for _, parts in mentions for _, word in parts if not word.isupper()}
    whole_names = {tuple(spelled.get(word, written(word)) for _, word in parts) for _, parts in mentions if len(parts) > 1}
    mentions = [(gender, [(start, spelled.get(word, written(word))) for start, word in parts]) for gender, parts in mentions]
    families = {parts[-1][1] for _, parts in mentions if len(parts) > 1}
    firsts = {word for _, parts in mentions for _, word in parts[:-1]}
    rows, told = [], defaultdict(list)
    for gender, parts in mentions:
        alone, whole = len(parts) == 1, parts[-1][1]
        for i, (start, word) in enumerate(parts):
            # After a title alone, a name is a family name unless the document knows it as a first name only.
            family = word in families or word not in firsts if alone else i == len(parts) - 1
            rows.append((start, word, family, gender, None if alone else whole))
            if gender != "n":
                told[word, family].append(gender)
                told[word, family, rows[-1][-1]].append(gender)
    found, places = [], defaultdict(list)
    for start, word, family, gender, whole in rows:
        every = told.get((word, family), [])
        if family:
            kind = "name_family" if script_of(word) != "cyrillic" or "f" not in every else "name_family_n" if "m" in every else "name_family_f"
        elif len(set(every)) < 2:
            kind = f"name_{every[0] if every else 'n'}"
        elif gender != "n":
            kind = f"name_{gender}"
        elif whole is not None:
            kind = f"name_{told.get((word, family, whole), ['n'])[0]}"
        else:
            kind = places[word][-1][1] if places[word] else f"name_{every[0]}"
        found.append((start, start + len(word), kind, word))
        places[word].append((start, kind))
    taken = {start for start, *_ in found}

    def again(start: int, end: int, name: str) -> None:
        if start not in taken:
            own = places[name]
            found.append((start, end, own[max(bisect_left(own, (start,)) - 1, 0)][1], name))
            taken.add(start)

    forms = {name: name for name in places} | {name.upper(): name for name in places if len(name) > 2 and len(name.upper()) == len(name)}
    for match in re.finditer(r"\b(?:" + "|".join(map(re.escape, sorted(forms, key=len, reverse=True))) + r")\b", text):
        again(*match.span(), forms[match[0]])
    small = {" ".join(names).lower(): names for names in whole_names if len(" ".join(names).lower()) == len(" ".join(names))}
    if small:
        for match in re.finditer(r"\b(?:" + "|".join(map(re.escape, sorted(small, key=len, reverse=True))) + r")\b", text):
            start = match.start()
            for name in small[match[0]]:
                again(start, start + len(name), name)
                start += len(name) + 1
    return found


def in_case_of(name: str, form: str, entity: str) -> str:
    """The surrogate of `entity`, which stands in the text as `form`, in the same case."""
    return name if form == entity else name.upper() if form.isupper() else name.lower() if form.islower() else name


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """Entities (start, end, kind, entity) in order, none overlapping; where finds overlap, the kind named first here wins."""
    found: list[tuple[int, int, str, str]] = []
    if "@" in text:
        found += [(*m.span(), "email", m[0]) for m in EMAIL.finditer(text)]
    if re.search(r"\d", text):
        for match in SECRET.finditer(text):
            group = 1 if match[1] else 2
            if re.search(r"\d", match[group]):
                found.append((*match.span(group), "secret", match[group]))
        found += [(*m.span(), "iban", m[0]) for m in IBAN.finditer(text) if remainder97(m[0].replace(" ", "")) == 1]
        found += [(*m.span(), "card", m[0]) for m in CARD.finditer(text) if luhn(re.sub(r"\D", "", m[0])) == 0]
        found += [(*m.span(), "phone", m[0]) for form in (PHONE, PLAIN_PHONE) for m in form.finditer(text) if 8 <= len(re.sub(r"\D", "", m[0])) <= 15]
        found += [(*m.span(), "ssn", m[0]) for m in SSN.finditer(text)]
        found += [(*m.span(), "address", m[0]) for m in ADDRESS.finditer(text)]
        if "::" in text or text.count(":") > 6:
            found += [(*m.span(), "address6", m[0]) for m in ADDRESS6.finditer(text) if is_address6(m[0])]
    found += people(text)
    if len(found) < 2:
        return found
    rank = {id(one): i for i, one in enumerate(found)}
    kept: list[tuple[int, int, str, str]] = []
    ends: list[tuple[int, int]] = []
    for one in sorted(found, key=lambda one: (one[0], rank[id(one)])):
        if kept and one[0] < ends[-1][0]:
            if rank[id(one)] < ends[-1][1]:
                kept[-1], ends[-1] = one, (one[1], rank[id(one)])
            continue
        kept.append(one)
        ends.append((one[1], rank[id(one)]))
    return kept


def entities(df: DataFrame, text: str = "text", key: str | None = None) -> DataFrame:
    """Distinct (kind, entity), or distinct (key, kind, entity)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(1).to_pylist() if key else [None] * batch.num_rows
            rows = sorted({(str(k), kind, entity): (k, kind, entity) for k, value in zip(keys, batch.column(0).to_pylist()) if value for _, _, kind, entity in detect(value)}.items())
            columns = list(zip(*(row for _, row in rows))) or [(), (), ()]
            names = ("kind", "entity") if key is None else (key, "kind", "entity")
            arrays = [pa.array(columns[1], type=pa.string()), pa.array(columns[2], type=pa.string())]
            yield batch_of(names, arrays if key is None else [pa.array(columns[0], type=batch.schema.field(1).type), *arrays])

    own = "" if key is None else f"`{key}` {df.schema[key].dataType.simpleString()}, "
    return map_arrow(df.select(text, *([key] if key else [])), run, own + "kind string, entity string").distinct()


def redrawn(found: DataFrame, key: bytes = b"") -> DataFrame:
    """(kind, entity, attempt) of the entities whose first replacement collides, with the attempt that does not."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [surrogate(k, e, a, key) for k, e, a in zip(*(column.to_pylist() for column in batch.columns))]
            yield batch_of(("kind", "entity", "attempt", "surrogate"), (*batch.columns, pa.array(new, type=pa.string())))

    schema = "kind string, entity string, attempt int, surrogate string"
    drawn = materialize(map_arrow(found.select("kind", "entity", F.lit(0).alias("attempt")), run, schema))
    while True:
        # Among equals the one that was there first keeps it; replacements of an earlier round are never taken away.
        # Names of all kinds are one group.
        grouped = drawn.withColumn("group", F.when(F.col("kind").startswith("name"), "name").otherwise(F.col("kind")))
        rank = F.row_number().over(Window.partitionBy("group", "surrogate").orderBy("attempt", "entity", "kind"))
        real = grouped.select("group", F.col("entity").alias("surrogate"), F.lit(True).alias("real")).distinct()
        marked = grouped.withColumn("place", rank).join(real, ["group", "surrogate"], "left")
        clash = materialize(marked.where((F.col("place") > 1) | F.col("real")).select("kind", "entity", F.col("attempt") + 1))
        if clash.isEmpty():
            return drawn.where("attempt > 0").select("kind", "entity", "attempt")
        again = map_arrow(clash.toDF("kind", "entity", "attempt"), run, schema)
        drawn = materialize(drawn.join(clash.select("kind", "entity"), ["kind", "entity"], "left_anti").select("kind", "entity", "attempt", "surrogate").union(again))


def replace(text: str, attempts: dict[tuple[str, str], int], key: bytes, known: dict[tuple[str, str], str]) -> tuple[str, int]:
    found = detect(text)
    out, at = [], 0
    for start, end, kind, entity in found:
        name = (kind, entity)
        new = known.get(name) if name not in attempts else None
        if new is None:
            new = surrogate(kind, entity, attempts.get(name, 0), key)
            if name not in attempts:
                known[name] = new
        out += [text[at:start], in_case_of(new, text[start:end], entity) if kind.startswith("name") else new]
        at = end
    return "".join(out) + text[at:], len(found)


def pseudonymise(df: DataFrame, text: str = "text", key: str = "doc_id", secret: bytes | None = None, count: str | None = None) -> DataFrame:
    """The same rows and columns with the entities of `text` replaced; `count` names an added column of how many.

    Without `secret` the key is the session's (`session_key`).

    Null stays null and an empty text empty; texts without entities are unchanged byte for byte. Repeated rows and keys get equal
    replacements. Extra columns pass through, whatever their names; `count` must be a new name.
    """
    secret = session_key(df.sparkSession) if secret is None else secret
    redraws = materialize(redrawn(entities(df, text), secret))
    names = df.columns
    place, where = names.index(text), len(names)
    schema = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in df.schema.fields) + (f", `{count}` bigint" if count else "")
    small = redraws.limit(CARRIED + 1).count() <= CARRIED
    carried = {(row["kind"], row["entity"]): row["attempt"] for row in redraws.collect()} if small else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, str], str] = {}
        for batch in batches:
            if len(known) > 100_000:
                known.clear()
            own = [{(r["kind"], r["entity"]): r["attempt"] for r in row or ()} for row in batch.column(where).to_pylist()] if batch.num_columns > where else [carried] * batch.num_rows
            done = [(None, 0) if value is None else replace(value, attempts, secret, known) for value, attempts in zip(batch.column(place).to_pylist(), own)]
            columns = list(batch.columns[:where])
            columns[place] = pa.array([new for new, _ in done], type=pa.string())
            yield batch_of([*names, count] if count else names, columns + ([pa.array([n for _, n in done], type=pa.int64())] if count else []))

    rows = df
    if not small:
        drawn = fresh("redraws", names)
        marks = entities(df.select(F.col(key).alias("key"), F.col(text).alias("text")), "text", "key").join(redraws, ["kind", "entity"]).groupBy("key").agg(F.collect_list(F.struct("kind", "entity", "attempt")).alias("drawn"))
        rows = df.select(F.struct(*[F.col(f"`{name}`") for name in names]).alias("row"), F.col(key).alias("own_key")).join(marks, F.col("own_key").eqNullSafe(F.col("key")), "left")
        rows = rows.select("row.*", F.col("drawn").alias(drawn))
    return map_arrow(rows, run, schema)
