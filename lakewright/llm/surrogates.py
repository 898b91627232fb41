"""Surrogates for personal data: detected entities get keyed replacements of their own kind and format.

DataFrame functions only. A replacement is drawn from a hash of the key, the kind and the entity's
canonical form, so the same entity has the same replacement everywhere, in whatever format it is
written. All distinct entities are checked together: where two would share a replacement, or a
replacement is itself an entity of the corpus, all but one draw again until none collide.

Kinds: e-mail addresses (letters and digits by place; the domain of its own, the top level kept),
telephone numbers (country code or trunk digit and punctuation kept; national ones only where they
are separated and start with 0 or with an area code of three digits before seven more, so unlike
other grouped numbers; one without its country is another entity than one with it), payment cards
and IBANs (first digit or country, grouping and check digits kept valid), IPv4 addresses (private
ranges stay private) and IPv6 ones (the first group stays), access keys, hexadecimal tokens,
passwords (classes of characters kept), and names after a title.

A name's family and given part have replacements of their own, whatever the title: no two family
names and no two given names share one, so Dr Smith, Mr John Smith and Mrs Smith have one family
name and nobody else has it. A given name's gender is that of the titles it occurs with in the
corpus (neither, if they differ); script and capitals are kept. In a document that names somebody
after a title, the same family or given name standing alone is replaced too.

The pattern reads every text once, and what it finds is stored with the texts; only texts with
entities are joined with their replacements.

Defined results: null texts stay null and empty ones empty; a text without entities is returned as
it is; repeated rows get equal texts; empty tables give no rows; texts of any length are read whole;
further columns, of any name, pass through.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import unused, written

# Titles by gender; given names by gender and script; syllables of family names by script.
TITLES = {
    "m": ["Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "господин", "г-н"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа", "г-жа"],
    "n": ["Dr", "Prof"],
}
GIVEN = {
    ("m", "latin"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Ivan", "Jonas", "Leon", "Martin", "Oscar", "Paul", "Simon", "Thomas", "Victor"],
    ("f", "latin"): ["Ada", "Bianca", "Clara", "Diana", "Elena", "Flora", "Hanna", "Irene", "Julia", "Laura", "Maria", "Nora", "Olivia", "Paula", "Sofia", "Vera"],
    ("n", "latin"): ["Alex", "Andrea", "Chris", "Dominique", "Jo", "Kim", "Lou", "Max", "Noa", "Pat", "Robin", "Sam", "Sascha", "Toni", "Uli", "Yael"],
    ("m", "cyrillic"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Илья", "Кирилл", "Леонид", "Максим", "Олег", "Павел", "Роман", "Степан", "Фёдор", "Юрий"],
    ("f", "cyrillic"): ["Алла", "Вера", "Галина", "Дарья", "Ева", "Жанна", "Инна", "Ксения", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Софья", "Тамара", "Юлия"],
    ("n", "cyrillic"): ["Саша", "Женя", "Валя", "Слава", "Шура", "Тоня", "Паша", "Вася", "Костя", "Лёня", "Митя", "Рома", "Сева", "Толя", "Федя", "Юра"],
}
ENDINGS = {("m", "latin"): "o", ("f", "latin"): "a", ("n", "latin"): "i", ("m", "cyrillic"): "ий", ("f", "cyrillic"): "а", ("n", "cyrillic"): "и"}
SYLLABLES = {
    "latin": ["ba", "bel", "cor", "dan", "der", "el", "fen", "gar", "hol", "ing", "kel", "lan", "mar", "mon", "nor", "ost", "per", "rin", "sel", "tor", "ul", "van", "wen", "zar"],
    "cyrillic": ["ба", "бел", "вор", "дан", "дер", "ел", "жен", "гар", "хол", "ин", "кел", "лан", "мар", "мон", "нор", "ост", "пер", "рин", "сел", "тор", "ул", "ван", "вен", "зар"],
}
# Country calling codes of one and of two digits; all others have three.
CODES = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"

def _national() -> str:
    """Telephone numbers without a country code, by separator: a trunk 0 and 8 to 12 digits in two to five groups, or an area code of three digits and seven."""
    forms = [r"\((?:0[1-9][0-9]{1,3}\)[ -]?[0-9]{3,4}(?:[ -]?[0-9]{2,4}){1,2}|[2-9][0-9]{2}\)[ -]?[0-9]{3}[ .-]?(?:[0-9]{4}|[0-9]{2}[ .-][0-9]{2}))"]
    for s in (" ", "-", r"\."):
        forms.append(f"0[1-9](?:{s}[0-9]{{2}}){{4}}|0[1-9][0-9]{{1,3}}(?:{s}[0-9]{{2}}){{3,4}}|0[1-9][0-9]{{1,4}}{s}[0-9]{{3,4}}(?:{s}[0-9]{{3,4}}|(?:{s}[0-9]{{2}}){{2}})")
        forms.append(f"[2-9][0-9]{{2}}{s}[0-9]{{3}}{s}(?:[0-9]{{4}}|[0-9]{{2}}{s}[0-9]{{2}})")
    forms.append("0[1-9][0-9]{1,4}[ /-][0-9]{5,8}")
    return f"(?:[18][ .-]?(?=[(2-9]))?(?:{'|'.join(forms)})"


# After a country code: as ever; one digit and pairs; one digit and two groups; a trunk 0 in brackets.
_ABROAD = (
    r"(?:[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,3}|[ .-]?[0-9](?:[ .-]?[0-9]{2}){4}|[ .-]?[0-9][ .-][0-9]{3,4}[ .-]?[0-9]{4}"
    r"|[ .-]?\(0\)[ .-]?(?:[0-9](?:[ .-]?[0-9]{2}){4}|[0-9]{1,4}[ .-]?[0-9]{3,8}(?:[ .-][0-9]{2,4}){0,2}|[0-9]{2,4}(?:[ .-]?[0-9]{2}){3,4}))"
)
_TITLE = "|".join(t for ts in TITLES.values() for t in ts)
#: Kind and pattern; the first kind that fits a found text is its kind.
KINDS = [
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}(?![A-Za-z0-9])"),
    ("ipv6", r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("ip", r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])"),
    ("card", r"(?<![0-9+])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2,3})(?![0-9])"),
    ("phone", rf"(?=[+(0-9])(?:(?<![0-9])\+[0-9]{{1,3}}{_ABROAD}|(?<![A-Za-z0-9])(?<![0-9][.,:/-])(?:00[1-9][0-9]{{0,2}}{_ABROAD}|{_national()}(?![.,:/-][0-9])))(?![0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("access", r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"),
    ("hex", r"(?<![A-Za-z0-9])[0-9a-f]{32,64}(?![A-Za-z0-9])"),
    ("password", r"(?<=password=)[^\s\"']{6,64}"),
    ("name", rf"(?<!\p{{L}})(?:{_TITLE})\.? \p{{Lu}}\p{{L}}+(?:[ -]\p{{Lu}}\p{{L}}+){{0,2}}"),
]
ENTITY = "|".join(p for _, p in KINDS)
#: What every entity has; a text without it is not searched.
SIGN = rf"[0-9@]|password=|(?<!\p{{L}})(?:{_TITLE})\.? \p{{Lu}}"
#: Stands around entities while a text is cut; a text that has it is cut more slowly.
MARK = "\u0001"
#: Draws after which a replacement may be longer than the entity, so that one is always found.
WIDEN = 3


def _cases(pairs: list[tuple[Column, Column]], other: Column) -> Column:
    return reduce(lambda c, p: c.when(*p), pairs[1:], F.when(*pairs[0])).otherwise(other)


def kind_of(e: Column) -> Column:
    return _cases([(e.rlike(f"^(?:{p.replace('(?<=password=)', '')})$"), F.lit(k)) for k, p in KINDS if k != "password"], F.lit("password"))


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def country(number: Column) -> Column:
    """The country code of a telephone number's digits, from these alone, so that all writings of a number agree."""
    return F.regexp_extract(number, f"^({CODES}|[0-9]{{3}})", 1)


def telephone(e: Column) -> Column:
    """A telephone number as +, country code, blank and the rest, or without a country as n, trunk 0 if there is one, blank and the rest."""
    abroad, home = digits(F.regexp_replace(e, r"^00|\(0\)", "")), F.regexp_replace(digits(e), "^[18](?=[0-9]{10}$)", "")
    code, trunk = country(abroad), F.regexp_extract(home, "^(0?)", 1)
    return F.when(e.rlike(r"^(?:\+|00)"), F.concat(F.lit("+"), code, F.lit(" "), F.substring(abroad, F.length(code) + 1, F.lit(20)))).otherwise(
        F.concat(F.lit("n"), trunk, F.lit(" "), F.substring(home, F.length(trunk) + 1, F.lit(20)))
    )


def gender(e: Column) -> Column:
    of = lambda g: e.rlike(rf"^(?:{'|'.join(TITLES[g])})\.? ")
    return F.when(of("m"), "m").when(of("f"), "f").otherwise("n")


def bare_name(e: Column) -> Column:
    return F.regexp_replace(e, rf"^(?:{_TITLE})\.? ", "")


def family_of(e: Column) -> Column:
    return F.regexp_extract(bare_name(e), r"([^ ]+)$", 1)


def given_of(e: Column) -> Column:
    """All of a name before its family name; empty if there is nothing."""
    return F.regexp_replace(bare_name(e), r" ?[^ ]+$", "")


def canonical(e: Column, kind: Column) -> Column:
    """What all writings of an entity share; of a name, its family name."""
    return _cases(
        [
            (kind.isin("email", "ipv6"), F.lower(e)),
            (kind == "phone", telephone(e)),
            (kind.isin("card", "ssn"), digits(e)),
            (kind == "iban", F.replace(e, F.lit(" "), F.lit(""))),
            (kind == "name", F.lower(family_of(e))),
        ],
        e,
    )


def stream(key: str, *parts: Column) -> Column:
    """128 hexadecimal digits that only who has the key can foresee."""
    text = F.concat_ws("\u0001", F.lit(key), *parts)
    return F.concat(F.sha2(text.cast("binary"), 256), F.sha2(F.concat(F.lit("\u0002"), text).cast("binary"), 256))


def nth(s: Column, i: Column, below: int) -> Column:
    """The i-th number of a stream, below a small bound."""
    return F.conv(F.substr(s, F.pmod(i, F.lit(60)) * 2 + 1, F.lit(4)), 16, 10).cast("int") % below


def letter_of(alphabet: str, n: Column) -> Column:
    return F.substr(F.lit(alphabet), n + 1, F.lit(1))


def each_char(text: Column, f) -> Column:
    """text with every character replaced by f(character, place from 0)."""
    chars = F.split(text, "")
    return F.array_join(F.transform(chars, f), "")


LOWER, UPPER, HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"


def by_class(text: Column, s: Column, after: int = 0) -> Column:
    """Digits for digits and letters for letters, from a place on."""

    def one(c: Column, i: Column) -> Column:
        drawn = (
            F.when(c.rlike("[0-9]"), nth(s, i, 10).cast("string"))
            .when(c.rlike("[a-z]"), letter_of(LOWER, nth(s, i, 26)))
            .when(c.rlike("[A-Z]"), letter_of(UPPER, nth(s, i, 26)))
        )
        return F.coalesce(F.when(i >= after, drawn), c)

    return each_char(text, one)


def luhn(body: Column) -> Column:
    """The check digit of a number without it."""
    chars = F.split(F.reverse(body), "")
    worth = F.transform(chars, lambda c, i: F.when(i % 2 == 0, (c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / F.lit(10))).otherwise(c.cast("int")).cast("int"))
    total = F.aggregate(worth, F.lit(0), lambda a, x: a + x)
    return F.pmod(-total, F.lit(10)).cast("string")


def pick(values: list[str], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), n + 1)


def iban(canon: Column, s: Column) -> Column:
    """Another account of the country, with valid check digits."""
    body = by_class(F.substring(canon, F.lit(5), F.length(canon)), s)
    worth = lambda c: F.when(c.rlike("[0-9]"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda total, c: (total * F.when(worth(c) > 9, 100).otherwise(10) + worth(c)) % 97
    rest = F.aggregate(F.split(F.concat(body, F.substring(canon, 1, 2), F.lit("00")), ""), F.lit(0), step)
    return F.concat(F.substring(canon, 1, 2), F.lpad((98 - rest).cast("string"), 2, "0"), body)


def syllables(s: Column, script: str, first: int, count: int) -> Column:
    return F.concat(*[pick(SYLLABLES[script], nth(s, F.lit(first + 3 * k), len(SYLLABLES[script]))) for k in range(count)])


def in_script(canon: Column, f) -> Column:
    return F.when(canon.rlike(r"\p{IsCyrillic}"), f("cyrillic")).otherwise(f("latin"))


def family(canon: Column, s: Column, attempt: Column) -> Column:
    return in_script(canon, lambda script: F.initcap(F.concat(syllables(s, script, 0, 4), F.when(attempt >= WIDEN, syllables(s, script, 20, 4)).otherwise(""))))


def given(canon: Column, gender: Column, s: Column, attempt: Column) -> Column:
    """At first one of GIVEN; as others have it, two or more syllables with an ending of the gender."""

    def of(script: str) -> Column:
        by_gender = lambda f: F.when(gender == "m", f("m")).when(gender == "f", f("f")).otherwise(f("n"))
        listed = by_gender(lambda g: pick(GIVEN[g, script], nth(s, F.lit(0), len(GIVEN[g, script]))))
        made = F.concat(syllables(s, script, 0, 2), F.when(attempt >= WIDEN, syllables(s, script, 20, 3)).otherwise(""), by_gender(lambda g: F.lit(ENDINGS[g, script])))
        return F.when(attempt == 0, listed).otherwise(F.initcap(made))

    return in_script(canon, of)


def streams(kind: Column, canon: Column, attempt: Column, key: str) -> tuple[Column, Column]:
    """What drawn() draws from: for the entity, and for an address's domain."""
    return stream(key, kind, canon, attempt.cast("string")), stream(key, F.lit("domain"), F.regexp_extract(canon, "@(.*)$", 1))


def drawn(kind: Column, canon: Column, gender: Column, attempt: Column, s: Column, of_domain: Column) -> Column:
    """The replacement of a canonical form, in canonical form, at a number of draws."""
    local, domain = F.regexp_extract(canon, "^([^@]*)@", 1), F.regexp_extract(canon, "@(.*)$", 1)
    kept = F.regexp_extract(domain, r"((?:^|\.)example\.(?:com|org|net)|\.[a-z]+)$", 1)
    host = F.substring(domain, F.lit(1), F.length(domain) - F.length(kept))
    wide = F.when(attempt >= WIDEN, F.substring(s, 100, 12)).otherwise("")
    email = F.concat(by_class(local, s), wide, F.lit("@"), by_class(host, of_domain), kept)
    private = F.regexp_extract(canon, r"^(10\.|127\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.)", 1)
    octets = [(nth(s, F.lit(0), 89) + 11), nth(s, F.lit(3), 256), nth(s, F.lit(6), 256), nth(s, F.lit(9), 254) + 1]
    fixed = F.size(F.split(private, r"\.")) - 1
    ip = F.when(private == "", F.concat_ws(".", *octets)).otherwise(
        F.concat(private, F.array_join(F.slice(F.array(*[o.cast("string") for o in octets]), fixed + 1, F.lit(4) - fixed), "."))
    )
    code, number = F.regexp_extract(canon, r"^(\+[0-9]+ |n0? )", 1), F.regexp_extract(canon, r" ([0-9]+)$", 1)
    # Area and exchange start with 2 to 9.
    phone = F.concat(code, each_char(number, lambda c, i: F.when(i.isin(0, 3), (nth(s, i, 8) + 2).cast("string")).otherwise(nth(s, i, 10).cast("string"))))
    body = F.substring(by_class(canon, s, 1), F.lit(1), F.length(canon) - 1)
    return _cases(
        [
            (kind == "email", email),
            (kind == "ip", ip),
            (kind == "phone", phone),
            (kind == "card", F.concat(body, luhn(body))),
            (kind == "hex", each_char(canon, lambda c, i: letter_of(HEX, nth(s, i, 16)))),
            (kind == "access", by_class(canon, s, 4)),
            (kind == "iban", iban(canon, s)),
            (kind == "ipv6", each_char(canon, lambda c, i: F.when((c == ":") | (i < F.instr(canon, ":") - 1), c).otherwise(letter_of(HEX, nth(s, i, 16))))),
            (kind == "family", family(canon, s, attempt)),
            (kind == "given", given(canon, gender, s, attempt)),
        ],
        by_class(canon, s),
    )


def dressed(e: Column, kind: Column, new: Column) -> Column:
    """A replacement in the format in which the entity is written."""
    rank = lambda i: F.length(digits(F.substring(e, F.lit(1), i + 1)))
    # What comes before a telephone number's own digits stays as it is written.
    own = F.regexp_extract(new, "([0-9]+)$", 1)
    numbers = F.when(kind == "phone", F.concat(F.substring(digits(e), F.lit(1), F.length(digits(e)) - F.length(own)), own)).otherwise(digits(new))
    spaced = each_char(e, lambda c, i: F.when(c.rlike("[0-9]"), F.substring(numbers, rank(i), F.lit(1))).otherwise(c))
    # An IBAN's characters, spaced as they were.
    nth_sign = lambda i: F.length(F.replace(F.substring(e, F.lit(1), i + 1), F.lit(" "), F.lit("")))
    account = each_char(e, lambda c, i: F.when(c == " ", c).otherwise(F.substring(new, nth_sign(i), F.lit(1))))
    shaped = _cases([(kind == "iban", account), (kind.isin("phone", "card", "ssn"), spaced)], new)
    return F.when(kind.isin("email", "ipv6"), cased(e, new)).otherwise(shaped)


def cased(e: Column, new: Column) -> Column:
    return F.when((e == F.upper(e)) & (e != F.lower(e)), F.upper(new)).otherwise(new)


def cut(text: Column) -> Column:
    """A text in pieces: every second one is an entity."""
    marked = F.split(F.regexp_replace(text, F.lit(ENTITY), F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    pairs = F.zip_with(F.split(text, ENTITY, -1), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))
    found = F.when(F.contains(text, F.lit(MARK)), F.flatten(pairs)).otherwise(marked)
    return F.when(text.rlike(SIGN), found).otherwise(F.array(text))


def replacements(each: DataFrame, key: str) -> DataFrame:
    """kind, canon and new of every distinct entity among those of each (kind, canon, given, gender); no two share a replacement and none is an entity."""
    plain = each.select(F.when(F.col("kind") == "name", "family").otherwise(F.col("kind")).alias("kind"), "canon", F.lit("n").alias("gender"))
    first = each.where("kind = 'name' AND given <> ''").select(F.lit("given").alias("kind"), F.lower("given").alias("canon"), "gender")
    one = F.bool_or(F.col("gender") == "m"), F.bool_or(F.col("gender") == "f")
    gender = F.when(one[0] & ~one[1], "m").when(one[1] & ~one[0], "f").otherwise("n")
    entities = written(plain.unionByName(first).groupBy("kind", "canon").agg(gender.alias("gender")), "entities")
    # Family and given names are one space, so that a name standing alone means one of them.
    space = F.when(F.col("kind").isin("family", "given"), "name").otherwise(F.col("kind"))
    real = entities.select(space.alias("space"), F.col("canon").alias("taken")).distinct()
    now = entities.withColumn("attempt", F.lit(0))
    while True:
        own, of_domain = streams(F.col("kind"), F.col("canon"), F.col("attempt"), key)
        now = now.withColumn("own", own).withColumn("domain", of_domain)
        new = drawn(*[F.col(c) for c in ("kind", "canon", "gender", "attempt", "own", "domain")])
        now = now.select("kind", "canon", "gender", "attempt", space.alias("space"), new.alias("new"), F.when(space == "name", F.lower(new)).otherwise(new).alias("taken"))
        now = written(now, "drawn")
        first = now.groupBy("space", "taken").agg(F.min(F.struct("attempt", "kind", "canon")).alias("holder"))
        judged = now.join(first, ["space", "taken"]).join(real.withColumn("is_real", F.lit(True)), ["space", "taken"], "left")
        again = (F.col("holder.canon") != F.col("canon")) | (F.col("holder.kind") != F.col("kind")) | F.col("is_real").isNotNull()
        judged = written(judged.select("kind", "canon", "gender", "attempt", "new", again.alias("again")), "judged")
        if not judged.where("again").limit(1).count():
            return judged.select("kind", "canon", "new")
        now = judged.select("kind", "canon", "gender", (F.col("attempt") + F.col("again").cast("int")).alias("attempt"))


def shown(each: DataFrame, new: DataFrame) -> DataFrame:
    """row, texts (of its entities, by their place) and names (what else to replace in it) of every row with entities."""
    kinds = new.select(F.col("kind").alias("k"), F.col("canon").alias("c"), "new")
    given_names = new.where("kind = 'given'").select(F.col("canon").alias("g"), F.col("new").alias("first"))
    each = each.withColumn("k", F.when(F.col("kind") == "name", "family").otherwise(F.col("kind"))).withColumn("c", F.col("canon"))
    each = each.join(kinds, ["k", "c"]).join(given_names, F.lower("given") == F.col("g"), "left")
    e, kind = F.col("e"), F.col("kind")
    title = F.substring(e, F.lit(1), F.length(e) - F.length(bare_name(e)))
    last, first = cased(family_of(e), F.col("new")), cased(F.col("given"), F.col("first"))
    name = F.concat(title, F.when(F.col("first").isNull(), last).otherwise(F.concat(first, F.lit(" "), last)))
    known = F.when(kind == "name", F.filter(F.array(F.struct(family_of(e).alias("old"), last.alias("new")), F.struct(F.col("given").alias("old"), first.alias("new"))), lambda x: x["new"].isNotNull()))
    each = each.select("row", "place", F.when(kind == "name", name).otherwise(dressed(e, kind, F.col("new"))).alias("text"), known.alias("known"))
    return each.groupBy("row").agg(
        F.map_from_entries(F.collect_list(F.struct("place", "text"))).alias("texts"),
        F.map_from_entries(F.array_distinct(F.flatten(F.collect_list("known")))).alias("names"),
    )


def alone(piece: Column, names: Column) -> Column:
    """A piece between entities, with the names of its document that stand alone in it replaced."""
    olds = F.array_join(F.array_sort(F.map_keys(names)), "|")
    pattern = F.concat(F.lit(r"(?<!\p{L})(?:"), olds, F.lit(r")(?!\p{L})"))
    parts = F.split(F.regexp_replace(piece, pattern, F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    fast = F.array_join(F.transform(parts, lambda w, k: F.when(k % 2 == 1, F.try_element_at(names, w)).otherwise(w)), "")
    slow = F.aggregate(F.map_entries(names), piece, lambda text, n: F.regexp_replace(text, F.concat(F.lit(r"(?<!\p{L})"), n["key"], F.lit(r"(?!\p{L})")), n["value"]))
    return F.when(F.contains(piece, F.lit(MARK)), slow).otherwise(fast)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """docs with every entity in text_col replaced, as the secret key says. count_col: also the number of entities."""
    name = unused(docs, "cut")
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows = written(docs.select(*rest, F.struct(F.monotonically_increasing_id().alias("row"), cut(F.col(f"`{text_col}`")).alias("pieces")).alias(name)), "cut")
    pieces = F.col(f"{name}.pieces")
    some = F.coalesce(F.size(pieces) > 1, F.lit(False))
    each = rows.where(some).select(F.col(f"{name}.row").alias("row"), F.posexplode(pieces).alias("place", "e")).where("place % 2 = 1 AND e <> ''")
    kind = kind_of(F.col("e"))
    each = each.select("row", "place", "e", kind.alias("kind"))
    of_name = F.when(F.col("kind") == "name", given_of(F.col("e"))).otherwise("")
    each = written(each.select("*", canonical(F.col("e"), F.col("kind")).alias("canon"), of_name.alias("given"), gender(F.col("e")).alias("gender")), "entities-of-rows")
    found = shown(each, replacements(each, key)).select(F.struct("row", "texts", "names").alias(name + "_"))
    new = F.col(name + "_")
    names = F.when(F.size(new["names"]) > 0, new["names"])
    whole = F.array_join(F.transform(pieces, lambda p, k: F.when(k % 2 == 1, F.coalesce(F.try_element_at(new["texts"], k), p)).otherwise(F.when(names.isNull(), p).otherwise(alone(p, names)))), "")

    def out(df: DataFrame, text: Column, count: Column) -> DataFrame:
        columns = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
        return df.select(*columns, *([count.cast("long").alias(count_col)] if count_col else []))

    # Rows without entities need no join.
    joined = rows.where(some).join(found, F.col(f"{name}.row") == F.col(f"{name}_.row"))
    return out(rows.where(~some), pieces[0], F.lit(0)).unionByName(out(joined, whole, F.size(new["texts"])))
