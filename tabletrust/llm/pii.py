"""Replacing personal data by keyed surrogates of the same kind, script, gender and format.

An entity is a kind and a canonical form (an address in lower case, the digits of a number, one word of a name), so all
its spellings get one surrogate, written in each mention's own format. People are found by their titles; once a text has
named somebody, the words of the name are mentions wherever the text repeats them. A given name is of the gender that
most titled texts of the corpus give it, so it has one surrogate whatever the title.

Surrogates come from a keyed hash of kind, gender, canonical form and attempt number. Spark gathers the distinct entities
of the corpus and checks them for collisions across all kinds: of entities with one surrogate the first keeps it, and the
others, like those whose surrogate is a real entity, try again. Only genders and further attempts travel back to the
texts; all else is computed where the text is read.
"""

from __future__ import annotations

import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabletrust.llm.common import is_small, saved, unused

#: Title words before names, by gender.
TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Frau", "Mme", "Mlle", "Madame", "Señora", "Señorita", "Sra", "Srta", "Госпожа", "госпожа", "Г-жа", "г-жа", "Κυρία", "κυρία", "Κα", "κα"],
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "господин", "Г-н", "г-н", "Κύριος", "κύριος", "Κος", "κος"],
    "n": ["Dr", "Prof", "Доктор", "доктор", "Δρ"],
}
#: Surrogate name words by kind and script.
FIRST = {
    ("f", "LATIN"): "Alba Berta Clara Dora Edith Fiona Gerda Hanna Irene Julia Karin Laura Maria Nora Olga Paula Rosa Sofia Tilda Vera".split(),
    ("m", "LATIN"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jakob Klaus Leon Martin Noah Oscar Paul Ralf Simon Tobias Victor".split(),
    ("n", "LATIN"): "Alex Billie Chris Dana Eli Frankie Gabriel Jamie Kai Kim Luca Mika Noel Robin Sasha Toni".split(),
    ("f", "CYRILLIC"): "Анна Вера Дарья Елена Ирина Мария Ольга Софья".split(), ("m", "CYRILLIC"): "Антон Борис Виктор Денис Иван Максим Олег Павел".split(), ("n", "CYRILLIC"): "Саша Женя Валя Слава".split(),
    ("f", "GREEK"): "Άννα Ελένη Μαρία Σοφία".split(), ("m", "GREEK"): "Γιώργος Νίκος Πέτρος Κώστας".split(), ("n", "GREEK"): "Άννα Νίκος Μαρία Πέτρος".split(),
}
LAST = {
    "LATIN": "Adler Berger Castro Dumont Ferrer Gruber Harper Ibarra Jansen Keller Lambert Moreau Navarro Ortega Perrin Quinn Renard Sommer Turner Vidal Weber Young Zeller".split(),
    "CYRILLIC": "Белов Волков Громов Зайцев Козлов Лебедев Морозов Орлов".split(), "GREEK": "Αλεξίου Βασιλείου Γεωργίου Δημητρίου".split(),
}
SYLLABLES = {"LATIN": "ba be bo da de do fa fe ga go ka ko la le lo ma mi mo na no pa ra re ro sa so ta to va vi".split(), "CYRILLIC": "ба ве го да ле ма но ра со та".split(), "GREEK": "βα γε δο λα μα νο ρα σο τα".split()}

#: Family names of women where they have a form of their own, and the endings of that form.
LAST_F = {"CYRILLIC": "Белова Волкова Громова Зайцева Козлова Лебедева Морозова Орлова".split(), "GREEK": "Αλεξίου Βασιλείου Γεωργίου Δημητρίου".split()}
FEMININE = ("ова", "ева", "ёва", "ина", "ская", "цкая")
#: Words inside a name that stay.
PARTICLES = "von|van|de|der|den|la|las|los|del|du|di|da|le|zu"

PATTERN = re.compile(
    r"(?P<email>[\w.+%-]+@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,})"
    r"|(?P<access>\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\b(?:gh[opsu]_|sk-|pk-)[A-Za-z0-9_-]{20,})"
    r"|(?P<hex>\b(?=[0-9a-f]*\d)(?=[0-9a-f]*[a-f])[0-9a-f]{32,128}\b)"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<ip>(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d))"
    r"|(?P<ipv6>(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:|:(?=:)|(?<=:):)(?:[0-9A-Fa-f]{0,4}:){1,6}[0-9A-Fa-f]{0,4}(?![\w:]))"
    r"|(?P<ssn>\b\d{3}-\d{2}-\d{4}\b)"
    r"|(?P<card>\b\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}\b|\b\d{4}[ -]\d{6}[ -]\d{5}\b|\b\d{13,19}\b)"
    r"|(?P<phone>(?<!\w)(?:(?:\+|00)?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)|(?<!\w)(?:\+|00)\d{1,3}(?:[ -]?\(\d{1,4}\))?(?:[ -]?\d{2,4}){2,4}(?![.\d]*\d))"
)
SECRET = re.compile(r"(?i:\b(?:api[_-]?key|access[_-]?key|token|secret|passwo?r?d|passwd)\b)[\"']?\s*[=:]\s*(?P<quote>[\"']?)(?P<value>[A-Za-z0-9+/_.\-]{8,})(?P=quote)")
_title = "|".join(sorted((f for ts in TITLES.values() for t in ts for f in {t, t.upper()}), key=len, reverse=True))
_word = rf"(?!(?:{_title})(?!\w))\p{{Lu}}[\p{{L}}\p{{M}}]*(?:[-'’]\p{{Lu}}[\p{{L}}\p{{M}}]*)*"
NAME = regex.compile(rf"(?<!\w)(?P<title>{_title})(?P<gap>\.?\s+)(?P<name>(?:(?:{PARTICLES})[ \t])*{_word}(?:[ \t](?:(?:{PARTICLES})[ \t])*{_word}){{0,2}})")
NAME_WORD = regex.compile(rf"(?<![\w'’-]){_word}")
GENDER = {f: g for g, ts in TITLES.items() for t in ts for f in (t, t.upper())}
#: What a line with one of PATTERN holds, what a text with SECRET holds, and one with a title.
TRIGGER = re.compile("[0-9@]|AKIA|ASIA").finditer
KEYWORD = re.compile("(?i)token|secret|passw|api[_-]?key|access[_-]?key").search
TITLE_HINT = re.compile(_title).search

#: Start, end, kind, canonical form, and the gender that the title gives.
Mention = tuple[int, int, str, str, str]


def iban_ok(value: str) -> bool:
    """The check digits of an account number, modulo 97."""
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def canonical_of(kind: str, raw: str) -> str | None:
    """The canonical form of a match; None for what only looks like an entity."""
    if kind in ("secret", "access", "hex"):
        return raw
    if kind == "email":
        return raw.lower()
    if kind == "ip":
        return ".".join(str(int(x)) for x in raw.split(".")) if all(int(x) < 256 for x in raw.split(".")) else None
    if kind == "ipv6":
        try:
            return ipaddress.IPv6Address(raw).exploded if len([x for x in raw.split(":") if x]) > 2 else None
        except ValueError:
            return None
    plain = re.sub(r"[^0-9A-Za-z]", "", raw)
    if kind == "card":
        return plain if luhn(plain) else None
    if kind == "iban":
        return plain if iban_ok(plain) else None
    if kind == "phone":
        plain = plain.removeprefix("00")
        return plain[1:] if len(plain) == 11 and plain[0] == "1" else plain
    return plain


def people(text: str) -> list[Mention]:
    """Words of titled names, and of the same names where they come without a title."""
    titled = []
    for m in NAME.finditer(text):
        words = list(NAME_WORD.finditer(m["name"]))
        titled.append((m.start("name"), GENDER[m["title"]], [(w.start(), w.end(), w[0]) for w in words]))
    given = {w[2].casefold() for _, _, words in titled for w in words[:-1]}
    found, known = [], {}
    for at, gender, words in titled:
        for start, end, raw in words:
            kind = "first" if raw.casefold() in given else "last"
            found.append((at + start, at + end, kind, raw.casefold(), gender))
            if len(raw) > 2:
                known |= {raw: kind, raw.upper(): kind}
    if known:
        seen = {x[0] for x in found}
        found += [(m.start(), m.end(), known[m[0]], m[0].casefold(), "n") for m in NAME_WORD.finditer(text) if m[0] in known and m.start() not in seen]
    return found


def numbers(text: str) -> list[Mention]:
    """Addresses, numbers and keys, in the lines that hold a digit or an @."""
    found, read = [], 0
    for m in TRIGGER(text):
        if m.start() < read:
            continue
        at, stop = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.start())
        read = stop if stop >= 0 else len(text)
        for x in PATTERN.finditer(text, at, read):
            kind = x.lastgroup
            canonical = canonical_of(kind, x[0])
            if canonical is not None:
                found.append((*x.span(), "secret" if kind in ("access", "hex") else kind, canonical, "n"))
    return found


def find(text: str) -> list[Mention]:
    """Every entity of a text, in order and without overlaps; of two that begin together the longer one."""
    found = numbers(text)
    if KEYWORD(text):
        found += [(*m.span("value"), "secret", m["value"], "n") for m in SECRET.finditer(text)]
    if TITLE_HINT(text):
        found += people(text)
    found.sort(key=lambda x: (x[0], -x[1]))
    out: list[Mention] = []
    for x in found:
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


class Stream:
    """Numbers from a keyed hash."""

    def __init__(self, key: bytes, *what: object):
        self.key, self.what, self.n, self.pool = key, "\x1f".join(map(str, what)).encode("utf-8", "surrogatepass"), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hmac.digest(self.key, self.what + b"\x1f" + str(self.n).encode(), "sha256")
            self.n += 1
        value, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return value % n


def shaped(raw: str, s: Stream) -> str:
    """The same shape: digits for digits, letters of the same case for letters; hexadecimal stays hexadecimal."""
    out, letters = [], 6 if re.fullmatch("[0-9a-f]{8,}|[0-9A-F]{8,}", raw) else 26
    for c in raw:
        if c.isdigit():
            out.append(str(s.below(10)))
        elif c.isalpha():
            x = chr(97 + s.below(letters))
            out.append(x.upper() if c.isupper() else x)
        else:
            out.append(c)
    return "".join(out)


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else (2 * int(d) - 9 * (int(d) > 4)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def script(word: str) -> str:
    name = unicodedata.name(next((c for c in word if c.isalpha()), "a"), "LATIN").split(" ")[0]
    return name if name in SYLLABLES else "LATIN"


def surrogate(key: bytes, kind: str, canonical: str, attempt: int = 0, gender: str = "n") -> str:
    """The canonical surrogate. It never equals the entity; with more attempts it may grow longer."""
    for again in range(64):
        s = Stream(key, kind, canonical, attempt, again)
        if kind == "email":
            local, _, domain = canonical.partition("@")
            labels = domain.split(".")
            made = shaped(local, s) + "".join(chr(97 + s.below(26)) for _ in range(attempt)) + "@" + ".".join([shaped(x, s) for x in labels[:-2]] + labels[-2:])
        elif kind == "ip":
            made = ".".join(str(1 + s.below(254)) for _ in range(4))
        elif kind == "ipv6":
            groups = [x if x == "0000" else f"{1 + s.below(65535):04x}" for x in canonical.split(":")]
            made = ":".join([f"{0x2000 + s.below(0x2000):04x}", *groups[1:]])
        elif kind == "iban":
            tail = shaped(canonical[4:], s)
            made = canonical[:2] + f"{98 - int(''.join(str(int(c, 36)) for c in tail + canonical[:2] + '00')) % 97:02}" + tail
        elif kind == "card":
            made = shaped(canonical[:-1], s)
            made += next(d for d in "0123456789" if luhn(made + d))
        elif kind == "phone":
            keep = max(0, len(canonical) - 10)  # the country's prefix
            made = canonical[:keep] + shaped(canonical[keep:], s)
        elif kind == "secret" and re.match("(?:AKIA|ASIA|gh[opsu]_|sk-|pk-)", canonical):
            keep = 4 if canonical[0] in "Ag" else 3
            made = canonical[:keep] + shaped(canonical[keep:], s)
        elif kind in ("first", "last"):
            to = script(canonical)
            words = FIRST[gender, to] if kind == "first" else LAST_F[to] if gender == "f" and to in LAST_F else LAST[to]
            made = words[s.below(len(words))].casefold() + "".join(SYLLABLES[to][s.below(len(SYLLABLES[to]))] for _ in range(attempt))
        else:
            made = shaped(canonical, s)
        if made != canonical:
            return made
    return made + "x"


def written(raw: str, kind: str, made: str) -> str:
    """A canonical surrogate in a mention's format."""
    if kind == "email":
        return made.upper() if raw.isupper() else made
    if kind in ("ip", "secret"):
        return made
    if kind == "ipv6":
        short = "::" in raw or len(raw) < 39
        made = ipaddress.IPv6Address(made).compressed if short else made
        return made.upper() if raw.upper() == raw and raw.lower() != raw else made
    if kind in ("first", "last"):
        return made.upper() if raw.isupper() and len(raw) > 1 else made.title()
    extra = sum(c.isalnum() for c in raw) - len(made)  # a country's prefix that the canonical form leaves out
    left, out = iter(made), []
    for c in raw:
        out.append(c if not c.isalnum() or extra > 0 else next(left, ""))
        extra -= c.isalnum()
    return "".join(out) + "".join(left)


#: Attempt and gender by kind and canonical form, where they aren't 0 and n.
Exceptions = dict[tuple[str, str], tuple[int, str]]


def rewrite(text: str, key: bytes, exceptions: Exceptions, known: dict) -> tuple[str, int]:
    found = find(text)
    if not found:
        return text, 0
    parts, at = [], 0
    for start, end, kind, canonical, _ in found:
        what = (kind, canonical, *exceptions.get((kind, canonical), (0, "n")))
        made = known.get(what)
        if made is None:
            if len(known) >= 30_000:
                known.clear()
            made = known[what] = surrogate(key, *what)
        parts += [text[at:start], written(text[start:end], kind, made)]
        at = end
    return "".join([*parts, text[at:]]), len(found)


def mentions(docs: DataFrame, text: str = "text") -> DataFrame:
    """_hash (of the text), kind, canonical form and gender (of its title, or n) of every entity, once a batch and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(h, *x) for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for x in {x[2:] for x in find(t)}]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if i == 0 else pa.string()) for i in range(4)], names=["_hash", "kind", "canonical", "gender"])

    return docs.where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("_hash"), F.col(text).alias("_text")).mapInArrow(run, "_hash long, kind string, canonical string, gender string")


def gendered(found: DataFrame) -> DataFrame:
    """kind, canonical, gender: of given names, and of family names that have the form, the gender that more texts give
    (n where as many give the other); n of all else."""
    votes = found.groupBy("kind", "canonical").agg(F.count_if(F.col("gender") == "f").alias("f"), F.count_if(F.col("gender") == "m").alias("m"))
    form = F.exists(F.array(*map(F.lit, FEMININE)), lambda e: F.col("canonical").endswith(e))
    by_votes = F.when(F.col("f") > F.col("m"), "f").when(F.col("m") > F.col("f"), "m").otherwise("n")
    latin = F.col("canonical").rlike("^[a-z]")
    gender = F.when(F.col("kind") == "first", by_votes).when((F.col("kind") == "last") & ~latin, F.when(form, "f").otherwise(by_votes)).otherwise("n")
    return votes.select("kind", "canonical", gender.alias("gender"))


def drawn(entities: DataFrame, key: bytes) -> DataFrame:
    """Adds the surrogate of kind, canonical, gender and attempt."""
    columns = ["kind", "canonical", "gender", "attempt"]
    shape = entities.select(*columns).withColumn("made", F.lit("").cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [surrogate(key, k, c, a, g) for k, c, g, a in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], names=[*columns, "made"])

    return entities.select(*columns).mapInArrow(run, shape)


def checked(entities: DataFrame, key: bytes, rounds: int = 40) -> DataFrame:
    """kind, canonical, gender, attempt with distinct surrogates across all kinds, none of which is an entity of any kind.

    entities: kind, canonical (distinct), gender. Each round redraws only the entities that collide. Raises an error if
    the rounds don't suffice.
    """
    now = saved(drawn(entities.withColumn("attempt", F.lit(0)), key), "surrogates")
    for _ in range(rounds):
        rank = F.row_number().over(Window.partitionBy("made").orderBy("attempt", "kind", "canonical"))
        real = entities.select(F.col("canonical").alias("made")).distinct()
        clash = now.withColumn("_r", rank).join(real.withColumn("_real", F.lit(True)), "made", "left")
        marked = saved(clash.select("kind", "canonical", "gender", "attempt", "made", ((F.col("_r") > 1) | F.col("_real").isNotNull()).alias("_again")), "clashes")
        if marked.where("_again").isEmpty():
            break
        redrawn = drawn(marked.where("_again").withColumn("attempt", F.col("attempt") + 1), key)
        now = saved(marked.where("not _again").drop("_again").unionByName(redrawn), "surrogates")
    else:
        raise RuntimeError(f"surrogates: still colliding after {rounds} rounds")
    return now.select("kind", "canonical", "gender", "attempt")


#: Parts that the rows of one entity or one text are dealt to where a table is too large to be broadcast.
SALTS = 32


def _met(rows: DataFrame, table: DataFrame, by: list[str], spread: str, how: str) -> DataFrame:
    """rows joined with a table that has each key once: broadcast while it is small, else salted by a hash of `spread`, as
    one key may hold a large share of the rows."""
    if is_small(table):
        return rows.join(F.broadcast(table), by, how)
    salt = unused(rows, "_salt")
    dealt = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(dealt, [*by, salt], how).drop(salt)


def replaced(docs: DataFrame, key: bytes, text: str = "text", count: str | None = None) -> DataFrame:
    """docs with every entity of the whole text replaced; with `count`, also a column of the number of mentions.

    Null and empty texts stay (no mentions); texts of any length are read whole. Equal entities get equal surrogates in
    all rows, repeated rows and rows with equal or null ids included, and different ones different surrogates. An empty
    table gives no rows. All columns stay, whatever they are called; one named `count` is replaced.
    """
    found = saved(mentions(docs, text).distinct(), "mentions")
    entities = saved(gendered(found), "entities")
    exceptions = saved(checked(entities, key).where("attempt > 0 or gender <> 'n'"), "exceptions")
    known = _met(found.select("_hash", "kind", "canonical").distinct(), exceptions, ["kind", "canonical"], "_hash", "inner")
    names = [c for c in docs.columns if c != count]
    hashed, other = unused(docs, "_hash"), unused(docs, "_exceptions")
    few = known.groupBy(F.col("_hash").alias(hashed)).agg(F.collect_set(F.struct("kind", "canonical", "attempt", "gender")).alias(other))
    marked = _met(docs.select(*names, F.xxhash64(text).alias(hashed)), saved(few, "by_text"), [hashed], names[0], "left").select(*names, other)
    schema = docs.select(*names).withColumn(count, F.lit(0).cast("long")).schema if count else docs.select(*names).schema
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn_before: dict = {}
        for batch in batches:
            for part in (batch.slice(k, 512) for k in range(0, batch.num_rows, 512)):
                others = [{(x["kind"], x["canonical"]): (x["attempt"], x["gender"]) for x in row or ()} for row in part.column(len(names)).to_pylist()]
                made = [(None, 0) if t is None else rewrite(t, key, o, drawn_before) for t, o in zip(part.column(at).to_pylist(), others, strict=True)]
                columns = list(part.columns[:-1])
                columns[at] = pa.array([m[0] for m in made], pa.string())
                if count:
                    columns.append(pa.array([m[1] for m in made], pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return marked.mapInArrow(run, schema)
