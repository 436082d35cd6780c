"""Surrogates for personal data, by DataFrame functions alone (operator 1).

Detected: e-mail addresses, IPv4 addresses, telephone numbers, payment cards, US
social security numbers, IBANs, given names of a fixed list, in capitals too, the
family names that follow them or a title, and names of any kind after a word of
kinship or friendship. A name found so is known in its document, and is then found
wherever it stands there alone. Each entity has a canonical form (digits only, lower
case), so mentions in several formats corefer, within and across documents. A surrogate
is drawn from SHA-512 of the secret key, kind, canonical form and attempt:

- e-mail: letters by letters, digits by digits; top-level domain kept;
- numbers: digits by digits in the mention's own format; country code of a telephone,
  first digit of a card, its Luhn validity, and country of an IBAN kept;
- IPv4: four octets; family names: syllables of the same script (Latin, Cyrillic or
  Greek), feminine Cyrillic ending kept; given names: a keyed permutation of the
  names of the same gender and script, so it is one-to-one without a check. Names
  beyond the list, whose gender is unknown, are spelled as family names are.

Collision check: a table of the distinct entities takes surrogates; those that equal
another entity's surrogate, or any original of the corpus, draw again, e-mail addresses
and family names with room to grow. What still collides after MAX_ROUNDS is of a form
that is nearly used up. As no surrogate is an original, such entities then take each
other's originals, in a circle by form, which is distinct by itself. The table is
joined back by entity; only documents with entities are shuffled.

Defined cases: null text stays null and has no entities; equal rows are treated
alike; other columns of the input are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

KEY = "surrogate-key-1"
#: Rounds of the collision check; each redraws only what collided.
MAX_ROUNDS = 12
#: Characters of an entity that one digest serves, a byte each.
BLOCK = 60

# Common given names by gender and script.
GIVEN = {
    ("f", "latin"): "Mary Anna Maria Laura Julia Sarah Emma Sophie Clara Elena Lucia Marie Helen Alice Carmen Ingrid Claire Susan Nora Martha".split(),
    ("m", "latin"): "John Peter Michael David James Robert Thomas Daniel Martin Paul Carlos Pedro Hans Klaus Pierre Jean Antonio Andrew George Frank".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Екатерина Юлия".split(),
    ("m", "cyrillic"): "Иван Пётр Алексей Дмитрий Сергей Николай Михаил Андрей Владимир Борис".split(),
    ("f", "greek"): "Μαρία Ελένη Αικατερίνη Σοφία Άννα Βασιλική".split(),
    ("m", "greek"): "Γιώργος Νίκος Δημήτρης Κώστας Γιάννης Παύλος".split(),
}
# Titles before family names.
TITLES = ["Mr.", "Mrs.", "Ms.", "Dr.", "Herr", "Frau", "Señor", "Señora", "Monsieur", "Madame", "Sr.", "Sra.", "Mme"]
# Words before a person's name.
KIN = (
    "son daughter brother sister wife husband mother father uncle aunt cousin nephew niece friend colleague neighbour neighbor "
    "Sohn Tochter Bruder Schwester Freund Freundin Kollege Kollegin hijo hija hermano hermana amigo amiga fils fille frère sœur ami amie "
    "сын дочь брат сестра друг подруга"
).split()
# Syllables of made-up family names.
SYLLABLES = {
    "latin": "bar del fen gor hal kem lin mor nes per ros sal tam vel win dor".split(),
    "cyrillic": "бар вел гор дал ким лод мар нес пол рос сав тим фед хол цар чер".split(),
    "greek": "βαρ γελ δορ καλ λιν μαρ νεσ παλ ρον σελ τιμ φαν χολ κερ δαν μιλ".split(),
}

_LISTED = [n for pool in GIVEN.values() for n in pool]
_NAMES = [*_LISTED, *(n.upper() for n in _LISTED)]
_CAPITALISED = r"\p{Lu}\p{L}+(?:-\p{Lu}\p{L}+)?"
_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)"
_CARD = r"(?<![\d.])\d{4}(?:[ -]?\d{4}){3}(?!\d)"
_PHONE = r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])"
_SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
_GIVEN = rf"(?=\p{{Lu}})(?<!\p{{L}})(?:{'|'.join(_NAMES)})(?!\p{{L}})"
_FAMILY = rf"(?<= )(?=\p{{Lu}})(?<=(?<!\p{{L}})(?:{'|'.join(x.replace('.', '[.]') for x in [*_NAMES, *TITLES])}) ){_CAPITALISED}"
_KIN = rf"(?<= )(?=\p{{Lu}})(?<=(?<!\p{{L}})(?:{'|'.join(KIN)}) (?:\p{{Lu}}\p{{L}}{{1,20}} )?){_CAPITALISED}"
# Possessive groups loop without recursion, so a long address can't overflow the stack.
# Cheap looks at one character come before each costly alternative.
_NUMERIC = rf"(?=[\d+(])(?:{'|'.join((_SSN, _PHONE, _CARD, _IP))})"
_NAMED = rf"(?=\p{{Lu}})(?:{'|'.join((_FAMILY, _GIVEN, _KIN))})"
ENTITY = f"{_EMAIL}|(?=[A-Z])(?:{_IBAN})|{_NUMERIC}|{_NAMED}"


def _kind(m: Column) -> Column:
    return (
        F.when(m.contains("@"), "email")
        .when(m.isin(_NAMES), "given")
        .when(m.rlike(rf"^(?:{_IBAN})$"), "iban")
        .when(m.rlike(r"^\p{L}"), "family")
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(m.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), "ip")
        .when(m.rlike(r"^\d{4}(?:[ -]?\d{4}){3}$"), "card")
        .otherwise("phone")
    )


def _canonical(m: Column, kind: Column) -> Column:
    return (
        F.when(kind.isin("email", "family", "given"), F.lower(m))
        .when(kind.isin("card", "ssn"), F.regexp_replace(m, r"\D", ""))
        .when(kind == "phone", F.regexp_replace(m, r"[^\d+]", ""))
        .when(kind == "iban", F.regexp_replace(m, " ", ""))
        .otherwise(m)
    )


def mentions(text: Column, pattern: Column | None = None) -> Column:
    """array<struct<mention, kind, canon>> in order of the text."""

    def one(m: Column) -> Column:
        kind = _kind(m)
        return F.struct(m.alias("mention"), kind.alias("kind"), _canonical(m, kind).alias("canon"))

    return F.transform(F.regexp_extract_all(text, F.lit(ENTITY) if pattern is None else pattern, F.lit(0)), one)


def pattern_of(found: Column) -> Column:
    """ENTITY, and the names found in the document wherever they stand alone, in their case or in capitals."""
    names = F.array_distinct(F.transform(F.filter(found, lambda x: x["kind"] == "family"), lambda x: x["mention"]))
    forms = F.array_distinct(F.concat(names, F.transform(names, lambda n: F.initcap(F.lower(n))), F.transform(names, lambda n: F.upper(n))))
    # Longer forms first, as the first that fits is taken.
    ordered = F.transform(F.sort_array(F.transform(forms, lambda n: F.struct(F.length(n).alias("n"), n.alias("f"))), False), lambda x: x["f"])
    known = F.concat(F.lit(ENTITY + r"|(?=\p{Lu})(?<!\p{L})(?:"), F.array_join(ordered, "|"), F.lit(r")(?!\p{L})"))
    return F.when(F.size(names) > 0, known).otherwise(F.lit(ENTITY))


def _luhn(digits: Column, odd_doubled: int) -> Column:
    """Luhn sum of a digit string; every place of that parity from the right is doubled."""
    n = F.length(digits)
    value = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == odd_doubled, 2).otherwise(1))
    return F.aggregate(value, F.lit(0), lambda a, v: a + v - F.when(v > 9, 9).otherwise(0))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once; a lambda computes what it captures for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def draw(kind: Column, canon: Column, attempt: Column, key: str = KEY) -> Column:
    """The surrogate's canonical form for one attempt."""
    size = F.length(canon)
    seed = F.sha2(F.concat_ws("|", F.lit(key), kind, canon, attempt.cast("string")), 512)
    hex_byte = lambda digest, i: F.conv(F.substring(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
    byte = lambda i: hex_byte(seed, i)
    top = F.when(kind == "email", F.length(F.regexp_extract(canon, r"\.[^.]*$", 0))).otherwise(0)
    kept = (
        F.when(kind == "phone", F.when(canon.rlike(r"^\+[17]"), 2).when(canon.startswith("+"), 3).otherwise(0))
        .when(kind == "card", 1)
        .when(kind == "iban", 2)
        .otherwise(0)
    )

    def block(whole: Column, b: Column) -> Column:
        # Bound once for the block: its characters, and a digest with a byte for each.
        part = F.struct(F.substring(whole["canon"], b * BLOCK + 1, F.lit(BLOCK)).alias("chars"), F.sha2(F.concat_ws("|", whole["seed"], b.cast("string")), 512).alias("digest"))
        return _let(part, lambda p: F.array_join(F.transform(F.sequence(F.lit(0), F.length(p["chars"]) - 1), lambda k: char(whole, p, b * BLOCK + k, k)), ""))

    def char(whole: Column, p: Column, i: Column, k: Column) -> Column:
        c = F.substring(p["chars"], k + 1, F.lit(1))
        pick = lambda letters: F.substring(F.lit(letters), hex_byte(p["digest"], k) % len(letters) + 1, F.lit(1))
        return (
            F.when((i < whole["kept"]) | (i >= whole["end"]), c)
            .when(c.rlike("[0-9]"), pick("0123456789"))
            .when(c.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz"))
            .when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
            .otherwise(c)
        )

    known = F.struct(canon.alias("canon"), seed.alias("seed"), kept.alias("kept"), (size - top).alias("end"))
    blocks = F.sequence(F.lit(0), F.floor((size - 1) / BLOCK).cast("int"))
    spelled = _let(known, lambda w: F.array_join(F.transform(blocks, lambda b: block(w, b)), ""))
    body = F.substring(spelled, F.lit(1), size - 1)
    check = (F.lit(10) - _luhn(body, 0) % 10) % 10
    valid = _luhn(canon, 1) % 10 == 0
    card = F.concat(body, F.when(valid, check).otherwise((check + 1 + byte(size) % 9) % 10).cast("string"))
    octets = F.concat_ws(".", (byte(F.lit(0)) % 90 + 11).cast("string"), *[byte(F.lit(k)).cast("string") for k in (1, 2)], (byte(F.lit(3)) % 254 + 1).cast("string"))

    def name(script: str) -> Column:
        parts = SYLLABLES[script]
        syllable = lambda k: F.element_at(F.array(*map(F.lit, parts)), byte(k) % len(parts) + 1)
        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3) + F.floor(attempt / 4).cast("int")), syllable), "")

    cyrillic = F.concat(name("cyrillic"), F.when(canon.endswith("а"), F.lit("ова")).otherwise(F.lit("ов")))
    family = F.when(canon.rlike(r"\p{IsCyrillic}"), cyrillic).when(canon.rlike(r"\p{IsGreek}"), name("greek")).otherwise(name("latin"))
    # Short addresses have few forms; from the third attempt on they grow.
    more = F.substring(F.translate(F.sha2(F.concat(seed, F.lit("more")), 256), "0123456789", "ghijklmnop"), F.lit(1), F.greatest(attempt - 1, F.lit(0)))
    grown = F.when(attempt > 1, F.concat(more, spelled)).otherwise(spelled)
    return F.when(kind == "ip", octets).when(kind == "family", family).when(kind == "card", card).when(kind == "email", grown).otherwise(spelled)


def surrogates(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, canon) -> (kind, canon, surrogate): distinct within a kind, and none an original."""
    rows = entities.select("kind", "canon").distinct().withColumn("attempt", F.lit(0))
    rows = materialize(rows.withColumn("surrogate", draw(F.col("kind"), F.col("canon"), F.col("attempt"), key)))
    originals = rows.select("kind", F.col("canon").alias("surrogate"))
    for _ in range(MAX_ROUNDS):
        # Of each surrogate the smallest entity stays; a taken original counts as smaller than all.
        claims = rows.select("kind", "surrogate", "canon").unionByName(originals.withColumn("canon", F.lit("")))
        owner = claims.groupBy("kind", "surrogate").agg(F.min("canon").alias("owner"), F.count("*").alias("claims")).where("claims > 1").drop("claims")
        losers = rows.join(owner, ["kind", "surrogate"]).where("canon <> owner").select("kind", "canon", F.lit(True).alias("again"))
        if losers.isEmpty():
            return rows.select("kind", "canon", "surrogate")
        again = rows.join(losers, ["kind", "canon"], "left").withColumn("attempt", F.col("attempt") + F.coalesce(F.col("again"), F.lit(False)).cast("int"))
        anew = F.when(F.col("again"), draw(F.col("kind"), F.col("canon"), F.col("attempt"), key)).otherwise(F.col("surrogate"))
        rows = materialize(again.select("kind", "canon", "attempt", anew.alias("surrogate")))
    return _circles(rows, losers)


def _circles(rows: DataFrame, losers: DataFrame) -> DataFrame:
    """Losers take the original of the next of their form; one alone takes that of another entity of its form."""
    shape = F.regexp_replace(F.regexp_replace("canon", "[0-9]", "0"), r"\p{L}", "a")
    shaped = losers.select("kind", "canon", shape.alias("shape"))
    near = Window.partitionBy("kind", "shape").orderBy("canon")
    whole = near.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    moved = shaped.withColumn("next", F.coalesce(F.lead("canon").over(near), F.first("canon").over(whole)))
    alone = moved.where("next = canon").select("kind", "shape", F.col("canon").alias("lone"))
    other = rows.select("kind", shape.alias("shape"), "canon").join(alone, ["kind", "shape"]).where("canon <> lone").groupBy("kind", F.col("lone").alias("canon")).agg(F.min("canon").alias("other"))
    taken = materialize(moved.join(other, ["kind", "canon"], "left").select("kind", "canon", F.coalesce("other", "next").alias("taken")))
    return rows.join(taken, ["kind", "canon"], "left").select("kind", "canon", F.coalesce("taken", "surrogate").alias("surrogate"))


def given_names(key: str = KEY) -> dict[str, str]:
    """A keyed permutation without fixed points of each gender and script's names."""
    out = {}
    for pool in GIVEN.values():
        order = sorted(pool, key=lambda n: hashlib.sha256(f"{key}|{n}".encode()).digest())
        out |= dict(zip(order, order[1:] + order[:1], strict=True))
    return out


def _formatted(m: Column, kind: Column, surrogate: Column, key: str) -> Column:
    """The surrogate in the mention's own format and case."""
    chars = F.split(m, "")
    places = F.when(kind == "phone", F.regexp_replace(surrogate, r"\D", "")).otherwise(surrogate)
    wanted = F.when(kind == "iban", "[A-Z0-9]").otherwise("[0-9]")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))

    def put(acc: Column, c: Column) -> Column:
        takes = F.regexp_like(c, wanted)
        return F.struct(F.concat(acc["out"], F.when(takes, F.substring(places, acc["k"] + 1, F.lit(1))).otherwise(c)).alias("out"), (acc["k"] + takes.cast("int")).alias("k"))

    digits = F.aggregate(chars, start, put, lambda acc: acc["out"])
    # A surrogate that has grown is longer than the mention by signs at its start.
    ahead = F.length(surrogate) - F.length(m)
    own = F.substring(surrogate, ahead + 1, F.length(m))
    cased = F.concat(F.substring(surrogate, F.lit(1), ahead), F.array_join(F.zip_with(chars, F.split(own, ""), lambda a, b: F.when((a == F.upper(a)) & (a != F.lower(a)), F.upper(b)).otherwise(b)), ""))
    family = F.when(m == F.upper(m), F.upper(surrogate)).otherwise(F.initcap(surrogate))
    names = F.create_map(*[F.lit(x) for old, new in given_names(key).items() for x in (old.lower(), new)])
    given = F.when((m == F.upper(m)) & (F.length(m) > 1), F.upper(names[F.lower(m)])).otherwise(names[F.lower(m)])
    return (
        F.when(kind == "given", given)
        .when(kind == "email", cased)
        .when(kind == "family", family)
        .when(kind == "ip", surrogate)
        .otherwise(digits)
    )


def _has_entity(text: Column) -> Column:
    """Whether a text holds an entity; plain looks for a sign spare most texts the costly ones."""
    email = text.contains("@") & text.rlike(_EMAIL)
    number = text.rlike("[0-9]") & text.rlike(rf"{_NUMERIC}|(?=[A-Z])(?:{_IBAN})")
    return email | number | text.rlike(_NAMED)


def pseudonymise(docs: DataFrame, key: str = KEY) -> DataFrame:
    """(doc_id, text, n_entities, kinds): whole texts with surrogates for entities."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    has = F.coalesce(_has_entity(F.col("text")), F.lit(False))
    clean = rows.where(~has).select("doc_id", "text", F.lit(0).alias("n_entities"), F.array().cast("array<string>").alias("kinds"))
    # A row's key: the same for equal rows, which get the same surrogates.
    dirty = rows.where(has).withColumn("pattern", pattern_of(mentions(F.col("text")))).withColumn("found", mentions(F.col("text"), F.col("pattern"))).withColumn("row", F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"), 256))
    dirty = materialize(dirty)
    spread = dirty.select("row", F.explode(F.array_distinct(F.transform("found", lambda x: F.struct(x["kind"].alias("kind"), x["canon"].alias("canon"))))).alias("e"))
    spread = spread.select("row", "e.kind", "e.canon").where("kind <> 'given'").distinct()
    table = surrogates(spread, key)
    per_row = spread.join(table, ["kind", "canon"]).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "canon"), "surrogate"))).alias("known"))
    joined = dirty.join(per_row, "row", "left")
    known = lambda x: F.col("known")[F.concat_ws("|", x["kind"], x["canon"])]
    new = F.transform("found", lambda x: _formatted(x["mention"], x["kind"], known(x), key))
    pieces = F.split("text", F.col("pattern"), -1)
    text = F.array_join(F.flatten(F.zip_with(pieces, F.concat(new, F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")
    replaced = joined.select("doc_id", text.alias("text"), F.size("found").alias("n_entities"), F.transform("found", lambda x: x["kind"]).alias("kinds"))
    return clean.unionByName(replaced)
