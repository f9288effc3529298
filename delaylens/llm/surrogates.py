"""Surrogates for personal data: keyed, consistent replacements.

Found are e-mail addresses, IPv4 addresses, telephone, payment-card and social
security numbers, IBANs, and names after a title. Each distinct entity of the
corpus gets one surrogate from a keyed hash of its kind and canonical form, so
all its mentions (other spellings of the same number or letter case too) get the
same one, in the format of the mention: separators, letter case, country code,
lengths, valid octets and check digits stay. Names keep gender and script. A name
runs over all capitalised words after its title; a person whose titles tell one
gender or none is one entity (Dr and Ms of one name), one of both is two. Names
without a title are not found.

Distinct entities keep distinct surrogates: surrogates of all entities are
compared over the corpus, and an entity whose surrogate is that of an entity
with a lesser name, or is itself a real entity of the corpus, draws again with
the next attempt number. After some attempts a kind's values grow by a
character, so this ends for any number of entities.

Built-in expressions only. Mentions are cut out by one pattern: ``split`` gives
the text between them and ``regexp_extract_all`` the mentions, which are woven
together again after the entities have met their surrogates. Joins on entities
are left to Spark, which splits hot ones; entities are pre-aggregated.

Defined results: a null text stays null and has no entities. Rows that share id
and text are copies with equal results; rows that share an id only stay apart.
Extra columns are ignored, or kept by ``replace``. Empty tables give empty
results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_on_rows, let, stage, text_key, text_or_empty

# Titles that tell a gender, in the languages of the corpus.
MALE_TITLES = ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don", "Господин", "Κύριος")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Señorita", "Sra", "Doña", "Госпожа", "Κυρία")
OTHER_TITLES = ("Dr", "Prof", "Professor", "Mx")

#: Syllables by script: invented names are made of them, with an ending by gender.
SYLLABLES = {
    "latin": ("ba be bi bo bu da de di do du fa fe fi fo ga ge gi go ka ke ki ko la le li lo lu ma me mi mo mu na ne ni no ra re ri ro ru sa se si so ta te ti to va ve vi vo").split(),
    "cyrillic": ("ба бе би бо ва ве ви во га ге ги го да де ди до ка ке ки ко ла ле ли ло ма ме ми мо на не ни но ра ре ри ро са се си со та те ти то").split(),
    "greek": ("βα βε βι βο γα γε γι γο δα δε δι δο κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο ρα ρε ρι ρο σα σε σι σο τα τε τι το").split(),
}
ENDINGS = {
    "latin": {"m": "n", "f": "a", "x": "l"},
    "cyrillic": {"m": "н", "f": "на", "x": "ль"},
    "greek": {"m": "ς", "f": "ία", "x": "λ"},
}
SCRIPT_LETTERS = {"latin": r"\p{IsLatin}", "cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}"}

def _any_case(titles: tuple[str, ...]) -> list[str]:
    """The titles as written and in capitals, longer ones first."""
    return sorted({*titles, *(t.upper() for t in titles)}, key=lambda t: (-len(t), t))


_titles = "|".join(_any_case((*MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES)))
#: Forms of telephone numbers. Digit groups alone are none: a number has a country
#: code, an area code in brackets, a leading zero or the same mark between groups.
PHONES = (
    r"\+[0-9]{1,3}[ .-]?\([0-9]{1,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}",
    r"\+[0-9]{1,3}[ .-]?(?:\(0\)[ .-]?)?[1-9](?:[ .-][0-9]{2}){4}",
    r"\+[0-9]{1,3}[ .-]?[0-9]{3}(?:[ .-][0-9]{2}){3}",
    r"\+[0-9]{1,3}[ .-]?[0-9]{2,4}[ ./-]?[0-9]{3,4}[ .-]?[0-9]{3,4}",
    r"\+[0-9]{1,3}[ .-][0-9]{2,5}[ ./-][0-9]{4,9}",
    r"\+[0-9]{1,3}[ .-]?[0-9]{6,12}",
    r"\([0-9]{2,5}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}",
    r"0[1-9](?:[ .-][0-9]{2}){4}",
    r"0[1-9][0-9]{1,3}/[0-9]{4,9}",
    r"0[1-9][0-9]{0,3}[ .-][0-9]{3,4}[ .-]?[0-9]{3,4}",
    r"[2-9][0-9]{2}(?:-[0-9]{3}-|\.[0-9]{3}\.)[0-9]{4}",
)
_phones = "|".join(PHONES)
#: Country codes of one and two digits; all others have three.
COUNTRY_CODE = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
#: kind -> pattern, in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9](?:[A-Za-z0-9-]*+\.)++[A-Za-z]{2,24}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?![0-9])(?!\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])(?<![0-9][.,])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9])",
    "phone": rf"(?<![0-9A-Za-z+])(?<![0-9][.,])(?:{_phones})(?![0-9])",
    "name": rf"(?<=(?<![\p{{L}}])(?:{_titles})\.? )\p{{Lu}}[\p{{L}}'’-]{{1,30}}(?: \p{{Lu}}[\p{{L}}'’-]{{1,30}})*+",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A quick test that the text has a sign without which nothing is found. The
#: first letters are tried before the titles, so most places fail at once.
HINT = rf"[@0-9]|(?=[{''.join(sorted({t[0] for t in _titles.split('|')}))}])(?:{_titles})\.? \p{{Lu}}"
#: After so many attempts a surrogate grows by a character.
PATIENCE = 6


def kind_of(mention: Column, before: Column) -> Column:
    """The first kind whose pattern is the whole mention; a name is what is
    left. ``before`` is the text that ends where the mention starts."""
    out = F.when(mention.contains("@"), F.lit("email"))
    for kind in ("iban", "ip", "ssn", "card", "phone"):
        out = out.when(mention.rlike(f"^(?:{PATTERNS[kind]})$"), kind)
    gender = F.when(before.rlike(rf"(?:^|[^\p{{L}}])(?:{'|'.join(_any_case(MALE_TITLES))})\.? $"), "m").when(before.rlike(rf"(?:^|[^\p{{L}}])(?:{'|'.join(_any_case(FEMALE_TITLES))})\.? $"), "f").otherwise("x")
    script = F.when(mention.rlike(SCRIPT_LETTERS["cyrillic"]), "cyrillic").when(mention.rlike(SCRIPT_LETTERS["greek"]), "greek").otherwise("latin")
    return out.otherwise(F.concat(F.lit("name-"), script, F.lit("-"), gender))


def canonical(kind: Column, mention: Column) -> Column:
    """What all mentions of an entity have in common: the significant digits of
    a telephone number (no country code, no zero before the area code), digits
    and letters of other numbers, lower case."""
    digits = F.regexp_replace(mention, "[^0-9]", "")
    return (
        F.when(kind == "phone", F.regexp_replace(F.regexp_replace(F.regexp_replace(mention, "[^+0-9]", ""), COUNTRY_CODE, ""), "^0", ""))
        .when(kind == "ip", mention)
        .when(kind.isin("ssn", "card"), digits)
        .when(kind == "iban", F.regexp_replace(mention, " ", ""))
        .otherwise(F.lower(mention))
    )


def _hash(key: str, kind: Column, name: Column, attempt: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, name, attempt.cast("string")), 256)


def _draw(h: Column, i: Column, n) -> Column:
    """The i-th draw below n from a hash in hexadecimal."""
    return F.pmod(F.xxhash64(h, i), n if isinstance(n, Column) else F.lit(n))


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _pick(alphabet: str, at: Column) -> Column:
    return F.substr(F.lit(alphabet), (at + 1).cast("int"), F.lit(1))


def _alike(text: Column, h: Column) -> Column:
    """Every letter and digit drawn anew, everything else kept."""
    def one(c: Column, i: Column) -> Column:
        return (
            F.when(c.rlike("^[0-9]$"), _pick("0123456789", _draw(h, i, 10)))
            .when(c.rlike("^[a-z]$"), _pick("abcdefghijklmnopqrstuvwxyz", _draw(h, i, 26)))
            .when(c.rlike("^[A-Z]$"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", _draw(h, i, 26)))
            .otherwise(c)
        )

    return F.array_join(F.transform(_characters(text), one), "")


def _luhn(digits: Column) -> Column:
    """Sum of the digits as payment cards count them (0 mod 10: valid)."""
    def one(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.when((F.length(digits) - i) % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.transform(_characters(digits), one), F.lit(0), lambda a, x: a + x)


def _card(name: Column, h: Column) -> Column:
    """Digits anew but the first; valid check digit if the original is valid."""
    body = F.concat(F.left(name, F.lit(1)), _alike(F.substring(name, 2, 64), h))
    open_ = F.concat(F.substr(body, F.lit(1), F.length(body) - 1), F.lit("0"))
    fixed = F.concat(F.substr(open_, F.lit(1), F.length(open_) - 1), ((10 - _luhn(open_) % 10) % 10).cast("string"))
    return F.when(_luhn(name) % 10 == 0, fixed).otherwise(body)


def _octets(name: Column, h: Column) -> Column:
    """Octets of as many digits, all below 256."""
    def one(o: Column, i: Column) -> Column:
        n = F.length(o)
        low = F.when(n == 3, 100).when(n == 2, 10).otherwise(0)
        return (low + _draw(h, i, F.when(n == 3, 156).when(n == 2, 90).otherwise(10).cast("bigint"))).cast("string")

    return F.array_join(F.transform(F.split(name, r"\."), one), ".")


def _email(name: Column, h: Column) -> Column:
    """Local part and host anew, the last label of the host kept."""
    parts = F.regexp_extract(name, r"^(.*)(\.[^.]*)$", 1)
    return F.concat(_alike(parts, h), F.regexp_extract(name, r"^(.*)(\.[^.]*)$", 2))


def _name(kind: Column, name: Column, h: Column) -> Column:
    """For every word a word of the kind's script and gender; about as long."""
    def word(script: str, gender: str):
        syllables = F.array(*[F.lit(s) for s in SYLLABLES[script]])

        def one(w: Column, i: Column) -> Column:
            n = F.greatest(F.lit(1), F.least(F.lit(6), F.floor(F.length(w) / 2).cast("int")))
            made = F.array_join(F.transform(F.sequence(F.lit(1), n), lambda j: F.get(syllables, _draw(h, i * 8 + j, len(SYLLABLES[script])).cast("int"))), "")
            # The given name tells the gender, the family name doesn't.
            return F.when(i == 0, F.concat(made, F.lit(ENDINGS[script][gender]))).otherwise(made)

        return F.array_join(F.transform(F.split(name, " "), one), " ")

    out = None
    for script in SYLLABLES:
        for gender in "mfx":
            test = kind == f"name-{script}-{gender}"
            out = F.when(test, word(script, gender)) if out is None else out.when(test, word(script, gender))
    return out


def surrogate(kind: Column, name: Column, attempt: Column, key: str) -> Column:
    """The surrogate's canonical form at this attempt."""
    def body(h: Column) -> Column:
        plain = (
            F.when(kind == "email", _email(name, h))
            .when(kind == "ip", _octets(name, h))
            .when(kind == "card", _card(name, h))
            .when(kind.startswith("name"), _name(kind, name, h))
            .when(kind == "iban", F.concat(F.left(name, F.lit(2)), _alike(F.substring(name, 3, 64), h)))
            .otherwise(_alike(name, h))
        )
        more = F.floor(attempt / PATIENCE).cast("int")
        extra = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(more, F.lit(1))), lambda j: _draw(h, j + 1000, 10).cast("string")), "")
        return F.when(more < 1, plain).when(kind == "ip", F.array_join(F.transform(F.split(name, r"\."), lambda o, i: _draw(h, i, 256).cast("string")), ".")).when(
            kind == "email", F.concat(extra, plain)
        ).when(kind.startswith("name"), F.concat(plain, F.translate(extra, "0123456789", "abcdefghij"))).otherwise(F.concat(plain, extra))

    return let(_hash(key, kind, name, attempt), body)


def in_format(kind: Column, mention: Column, value: Column) -> Column:
    """``value`` written as the mention is: its digits or letters take the
    places of the mention's; what it has beyond them follows at the end."""
    digits = F.length(F.regexp_replace(mention, "[^0-9]", ""))

    def numbers(keep: str) -> Column:
        # Digits before the significant ones (country code, zero) stay.
        skip = F.when(kind == "phone", digits - F.length(canonical(kind, mention))).otherwise(F.lit(0))
        places = F.length(F.regexp_replace(mention, f"[^{keep}]", "")) - skip

        def one(c: Column, i: Column) -> Column:
            nth = F.length(F.regexp_replace(F.substr(mention, F.lit(1), i + 1), f"[^{keep}]", "")) - skip
            return F.when(c.rlike(f"^[{keep}]$") & (nth > 0), F.substr(value, nth, F.lit(1))).otherwise(c)

        return F.concat(F.array_join(F.transform(_characters(mention), one), ""), F.substr(value, places + 1, F.length(value)))

    upper = (mention == F.upper(mention)) & (mention != F.lower(mention))
    return (
        F.when(kind.isin("phone", "card", "ssn"), numbers("0-9"))
        .when(kind == "iban", numbers("A-Z0-9"))
        .when(kind == "ip", value)
        .when(upper, F.upper(value))
        .when(kind.startswith("name"), F.initcap(value))
        .otherwise(value)
    )


def mentions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__id, __key, at, mention, kind, name) of every mention, ``at`` counting
    from 0 in its text. Copies of a row give theirs once."""
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("__id"), text.alias("__text")).filter(F.col("__text").rlike(HINT))
    found = rows.select("__id", text_key(F.col("__text")).alias("__key"), F.regexp_extract_all("__text", F.lit(ANY), F.lit(0)).alias("m"), F.split("__text", ANY, -1).alias("gaps"))
    found = found.filter(F.size("m") > 0).select("__id", "__key", F.posexplode(F.arrays_zip("m", F.transform("gaps", lambda g: F.right(g, F.lit(16))).alias("before"))).alias("at", "p"))
    found = found.filter(F.col("p.m").isNotNull()).select("__id", "__key", "at", F.col("p.m").alias("mention"), F.col("p.before").alias("before"))
    found = found.select("__id", "__key", "at", "mention", kind_of(F.col("mention"), F.col("before")).alias("kind")).withColumn("name", canonical(F.col("kind"), F.col("mention")))
    return found.dropDuplicates(["__id", "__key", "at"])


def with_genders(found: DataFrame) -> DataFrame:
    """Mentions whose title tells no gender get that of the name's other mentions,
    if these agree, so that one person is one entity under any title."""
    kind = F.col("kind")
    stem, gender = F.regexp_extract(kind, "^(name-[a-z]+-)[mfx]$", 1), F.right(kind, F.lit(1))
    told = found.filter(kind.rlike("^name-[a-z]+-[mf]$")).groupBy(stem.alias("__stem"), F.col("name").alias("__name"))
    told = told.agg(F.min(gender).alias("__g"), F.max(gender).alias("__h")).filter("__g = __h").drop("__h")
    open_ = kind.rlike("^name-[a-z]+-x$")
    joined = found.join(told, open_ & (F.col("name") == F.col("__name")) & (stem == F.col("__stem")), "left")
    return joined.withColumn("kind", F.when(F.col("__g").isNotNull(), F.concat("__stem", "__g")).otherwise(kind)).select(found.columns)


def family(kind: Column) -> Column:
    """Kinds whose values could be taken for each other are compared together."""
    return F.when(kind.startswith("name"), "name").otherwise(kind)


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(kind, name, value) with distinct values that aren't names themselves.

    ``entities`` is a staged table of distinct (kind, name). Each round only
    has the entities without a value; rounds end when none is left.
    """
    spark = entities.sparkSession
    real = entities.select(family(F.col("kind")).alias("f"), F.lower("name").alias("v")).distinct()
    done = spark.createDataFrame([], "kind string, name string, value string, f string, v string")
    open_, attempt = entities, 0
    while not open_.isEmpty():
        drawn = open_.select("kind", "name", surrogate(F.col("kind"), F.col("name"), F.lit(attempt), key).alias("value"))
        drawn = stage(drawn.select("*", family(F.col("kind")).alias("f"), F.lower("value").alias("v")), "surrogates-drawn")
        taken = real.unionAll(done.select("f", "v"))
        free = drawn.join(taken, ["f", "v"], "left_anti")
        # Of entities with one value the first keeps it.
        first = free.groupBy("f", "v").agg(F.min(F.struct("kind", "name", "value")).alias("e")).select("e.kind", "e.name", "e.value", "f", "v")
        done = stage(done.unionAll(first), "surrogates")
        open_ = stage(drawn.join(done.select("kind", "name"), ["kind", "name"], "left_anti").select("kind", "name"), "surrogates-open")
        attempt += 1
    return done.select("kind", "name", "value")


def replace(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, with surrogates in the text, and the
    columns __entities (mentions replaced) and __kinds (count per kind)."""
    found = stage(with_genders(stage(mentions(docs, id_col, text_col), "pii-found")), "pii-mentions")
    entities = stage(found.groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n")).select("kind", "name"), "pii-entities")
    values = assign(entities, key)
    written = found.join(values, ["kind", "name"]).select("__id", "__key", "at", "kind", in_format(F.col("kind"), F.col("mention"), F.col("value")).alias("value"))
    woven = written.groupBy("__id", "__key").agg(F.sort_array(F.collect_list(F.struct("at", "value", "kind"))).alias("__s"))
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"),
        F.col(id_col).alias("__id"),
        text_key(text_or_empty(text_col)).alias("__key"),
        text_or_empty(text_col).rlike(HINT).alias("__hint"),
    )
    text = F.col(f"__row.`{text_col}`")
    gaps = F.split(text, ANY, -1)
    joined = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(F.col("__s"), i)["value"], F.lit("")))), "")
    # Texts without a hint have no mentions and stay out of the shuffle. The
    # others are merged with theirs at any size.
    woven = stage(woven, "pii-woven")
    out = join_on_rows(packed.filter("__hint"), woven.hint("merge"), "left")
    out = out.unionByName(packed.filter("NOT __hint").withColumn("__s", F.lit(None).cast(woven.schema["__s"].dataType)))
    new = F.when(F.col("__s").isNull(), text).otherwise(joined)
    return out.select(
        F.col("__row").withField(f"`{text_col}`", new).alias("__row"),
        F.coalesce(F.size("__s"), F.lit(0)).cast("bigint").alias("__entities"),
        F.coalesce(F.transform("__s", lambda s: s["kind"]), F.array().cast("array<string>")).alias("__kinds"),
    ).select("__row.*", "__entities", "__kinds")
