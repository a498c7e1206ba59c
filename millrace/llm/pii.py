"""Personal data replaced by surrogates, with DataFrame functions only.

Entities are found by one regular expression and consist of units, each with a kind and
a value under which its spellings agree: an e-mail in lower case, the digits of a phone (with its
plus), national or card number, an address with all groups of IPv6 written out, and for a titled person the given
name with its gender and the family name, in lower case.  A unit's surrogate is a keyed hash of kind and
value, put into the shape of the spelling at hand: letters become letters of the same case,
digits digits, separators stay; card numbers keep a valid check digit, phones the country code
that their digits begin with, mail goes to reserved domains, addresses to the reserved block 240.0.0.0/4 or the
documentation prefix 2001:db8::/32, names come from the list of the title's gender and the name's script.
So equal units get equal surrogates everywhere, however they are written: "Mr John Smith" and "Mr Smith"
keep one family name, "Mr John" and "Dr John" of one text one given name, "Господин Иванов" and "Госпожа Иванова" one family name in both forms, "+1 212 555 1234" and "+12125551234" one number.

Distinctness is checked over the whole corpus: where two units of a kind would
share a surrogate, or a surrogate is itself a unit of the corpus, all but the
first draw anew, in rounds, until no clash is left.  The space grows with the rounds:
later draws add letters to a mailbox, names and letters to a name, digits to a phone
number, so any number of units finds room.  Addresses, national and card numbers have a
fixed form and only its own space (251 million IPv4 addresses).

Null texts stay null with no entities; texts without entities stay as they are.
Other columns, also of clashing names, are carried untouched only if asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

# The patterns of entities, by kind.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
PHONE = r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w-]|\.\d)|(?<![\w.+-])\+\d{1,3}(?:[ .-]\d(?=[ .-]))?(?:[ .-]?\d{2,4}){2,5}(?![\w-]|\.\d)"
CARD = r"(?<![\w.-])\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}(?![\w-])"
ADDRESS = r"(?<![\w.-])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\w-]|\.\d)"
HEX4 = "[0-9A-Fa-f]{1,4}"
ADDRESS6 = r"(?<![\w:.])(?=[0-9A-Fa-f:]*(?:\d|[0-9A-Fa-f]{4}))" + f"(?:(?:{HEX4}:){{7}}{HEX4}|(?:{HEX4}(?::{HEX4}){{0,5}})?::(?:{HEX4}(?::{HEX4}){{0,5}})?)" + r"(?![\w:])"
NATIONAL = r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-])"
MALE = r"(?:Mr|MR|Herr|HERR|Monsieur|MONSIEUR|Señor|SEÑOR|Господин|ГОСПОДИН)"
FEMALE = r"(?:Mrs|MRS|Ms|MS|Miss|MISS|Frau|FRAU|Madame|MADAME|Señora|SEÑORA|Госпожа|ГОСПОЖА)"
EITHER = r"(?:Dr|DR|Prof|PROF|Доктор|ДОКТОР|Профессор|ПРОФЕССОР)"
#: A word of a name, hyphens and apostrophes between its letters included.
WORD = r"\p{Lu}(?:\p{L}|(?<=\p{L})[-'’](?=\p{L}))+"
NAME = r"(?<![\p{L}\w])" + f"(?:{MALE}|{FEMALE}|{EITHER})" + r"\.? " + f"{WORD}(?: {WORD})?"
#: Endings of Cyrillic family names in their feminine form.
FEMININE = "(?:ов|ев|ёв|ин|ын|ОВ|ЕВ|ЁВ|ИН|ЫН)[аА]$"
ENTITY = "|".join((EMAIL, ADDRESS6, ADDRESS, NATIONAL, CARD, PHONE, NAME))

# Names by script and gender; family names by script.
NAMES = {
    ("latin", "m"): "Adam Albert Anton Arthur Bruno Carl Cesar David Edgar Emil Eric Felix Frank George Hugo Ivan Jacob Leon Louis Marc Martin Oscar Paul Peter Robert Simon Thomas Victor Walter William".split(),
    ("latin", "f"): "Ada Alice Anna Beatrice Bertha Carla Clara Diana Edith Elena Emma Eva Flora Gloria Helen Ida Irene Julia Laura Lena Lucia Maria Martha Nina Olivia Paula Rosa Sara Sofia Vera".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Олег Павел Роман Степан Юрий".split(),
    ("cyrillic", "f"): "Алла Вера Галина Дарья Елена Жанна Зоя Инна Ксения Лидия Мария Нина Ольга Раиса Юлия".split(),
}
FAMILIES = {
    "latin": "Abel Arnold Bauer Becker Bell Blanco Brown Carter Colin Cook Costa Cruz Duval Ellis Fischer Ford Garnier Gomez Grant Hall Hart Jung Keller Klein Lambert Lang Lopez Marin Mason Meyer Moreau Navarro Noel Ortiz Parker Perrin Reed Rey Roth Rubio Sauer Silva Stone Torres Vidal Vogel Wagner Walker Winter Young".split(),
    "cyrillic": "Белов Волков Громов Жуков Зайцев Ковалёв Лебедев Морозов Новиков Орлов Павлов Романов Соколов Титов Фролов".split(),
}
#: Sixteen letters a script, which later draws append to a name.
LETTERS = {"latin": "aeioubcdfghklmnr", "cyrillic": "аеиоубвгдзклмнрс"}
KINDS = ("email", "ip", "national", "card", "phone", "name")
#: Country calling codes of one and of two digits; all others have three.
COUNTRY = r"^\+([17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
KEY = "surrogates-1"
#: Overrides up to which the table of redrawn entities is broadcast.
BROADCAST_ROWS = 100_000


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once a row, where plain nesting would repeat its expression."""
    return F.element_at(F.transform(F.array(value), lambda x: then(x)), 1)


def kind_of(e: Column) -> Column:
    return (
        F.when(F.contains(e, F.lit("@")), "email").when(F.contains(e, F.lit(":")), "ip").when(e.rlike(r"^\p{L}"), "name").when(e.rlike(f"^(?:{ADDRESS})$"), "ip")
        .when(e.rlike(r"^\d{3}-\d{2}-\d{4}$"), "national").when(e.rlike(r"^\d(?:\D*\d){12}"), "card").otherwise("phone")
    )


def _groups(e: Column) -> Column:
    """An IPv6 address with its eight groups written out, without leading zeros, in lower case."""
    def side(i: int) -> Column:
        return F.filter(F.split(F.coalesce(F.try_element_at(F.split(F.lower(e), "::"), F.lit(i)), F.lit("")), ":"), lambda g: g != "")

    def whole(x: Column) -> Column:
        zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - F.size(x["l"]) - F.size(x["r"]), F.lit(0)))
        return F.concat_ws(":", F.transform(F.concat(x["l"], zeros, x["r"]), lambda g: F.regexp_replace(g, "^0+(?=.)", "")))

    return let(F.struct(side(1).alias("l"), side(2).alias("r")), whole)


def _value(shown: Column, kind: Column) -> Column:
    """The value of a unit other than a name, under which its spellings agree."""
    return (
        F.when(kind == "ip", F.when(F.contains(shown, F.lit(":")), _groups(shown)).otherwise(shown)).when(kind.isin("national", "card"), F.regexp_replace(shown, r"\D", ""))
        .when(kind == "phone", F.regexp_replace(shown, r"(?!^\+)\D", "")).otherwise(F.lower(shown))
    )


def _gender(e: Column) -> Column:
    return F.when(e.rlike(f"^{MALE}\\b"), "m").when(e.rlike(f"^{FEMALE}\\b"), "f").otherwise("n")


def _unit(kind: Column, value: Column, shown: Column) -> Column:
    return F.struct(kind.alias("kind"), value.alias("value"), shown.alias("shown"))


def titled(entities: Column, title: str) -> Column:
    """The given names, in lower case, that stand under a title of the pattern in a text's entities."""
    full = F.filter(entities, lambda e: e.rlike(f"^{title}\\.? [^ ]+ [^ ]+$"))
    return F.transform(full, lambda e: F.lower(F.element_at(F.split(e, " "), 2)))


def units(e: Column, male: Column | None = None, female: Column | None = None) -> Column:
    """The units of an entity in order: (kind, value, shown), where shown is the unit as it stands.

    Names give family or given and family; the kind of a given name carries the title's gender, or where the title has
    none that under which the name stands in the lists ``male`` and ``female`` of the same text.  A feminine family name in
    Cyrillic under a female title has the value of its masculine form."""
    def of_name(words: Column) -> Column:
        family, gender = F.element_at(words, -1), _gender(e)
        value = F.when((gender == "f") & family.rlike(FEMININE), F.lower(F.substring(family, F.lit(1), F.length(family) - 1))).otherwise(F.lower(family))
        last = F.array(_unit(F.lit("family"), value, family))
        given = F.element_at(words, 2)
        if male is not None:
            gender = F.when(gender != "n", gender).when(F.array_contains(male, F.lower(given)), "m").when(F.array_contains(female, F.lower(given)), "f").otherwise("n")
        return F.when(F.size(words) > 2, F.concat(F.array(_unit(F.concat(F.lit("given-"), gender), F.lower(given), given)), last)).otherwise(last)

    return let(kind_of(e), lambda kind: F.when(kind == "name", let(F.split(e, " "), of_name)).otherwise(F.array(_unit(kind, _value(e, kind), e))))


def _draw(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), attempt.cast("string"), F.concat(kind, F.lit(":"), value)), 256)


def _number(hexes: Column, at: int, width: int = 6) -> Column:
    return F.conv(F.substring(hexes, at, width), 16, 10).cast("long")


def _pick(names: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (F.pmod(n, F.lit(len(names))) + 1).cast("int"))


def _digits(hexes: Column) -> Column:
    """40 decimal digits of a hash."""
    return F.concat(*[F.substring(F.lpad(_number(hexes, 1 + 8 * i, 8).cast("string"), 10, "0"), 6, 5) for i in range(8)])


def _longer(hexes: Column, n: Column, letters: str = "aeioubcdfghklmnr") -> Column:
    """``n`` further letters, from the end of a hash; none where ``n`` is not positive."""
    n = F.least(F.greatest(n, F.lit(0)), F.lit(32))
    return F.translate(F.substring(hexes, F.lit(65) - n, n), "0123456789abcdef", letters)


def _shaped(e: Column, digits: Column, letters: Column) -> Column:
    """``e`` with its i-th character replaced by a digit or a letter of the same case at place i."""
    def one(c: Column, i: Column) -> Column:
        spot = F.pmod(i, F.lit(40)) + 1
        letter = F.substring(letters, F.pmod(i, F.lit(60)) + 1, F.lit(1))
        return F.when(c.rlike(r"\d"), F.substring(digits, spot, F.lit(1))).when(c.rlike("[a-z]"), letter).when(c.rlike("[A-Z]"), F.upper(letter)).otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(e, ""), lambda c: c != ""), one), "")


def _digits_into(e: Column, digits: Column) -> Column:
    """The digits of ``e`` replaced in order, whatever stands between them."""
    def one(i: Column) -> Column:
        c = F.substring(e, i, F.lit(1))
        before = F.length(F.regexp_replace(F.substring(e, F.lit(1), i), r"\D", ""))
        return F.when(c.rlike(r"\d"), F.substring(digits, before, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(e)), one), "")


def _check_digit(body: Column) -> Column:
    """The Luhn digit that completes ``body``."""
    places = F.sequence(F.lit(1), F.length(body))
    total = F.aggregate(places, F.lit(0), lambda s, i: s + F.when(F.pmod(F.length(body) - i, F.lit(2)) == 0, F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), F.substring(body, i, F.lit(1)).cast("int") + 1)).otherwise(F.substring(body, i, F.lit(1)).cast("int")))
    return F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10)).cast("string")


def _email(e: Column, h: Column, attempt: Column, key: str) -> Column:
    letters = F.translate(h, "0123456789abcdef", "aeioubcdfghklmnr")
    domain = _draw(F.lit("domain"), F.lower(F.substring_index(e, "@", -1)), F.lit(0), key)
    return let(F.struct(_digits(h).alias("d"), letters.alias("l")), lambda x: F.concat(_shaped(F.substring_index(e, "@", 1), x["d"], x["l"]), _longer(h, attempt * 4), F.lit("@mail"), F.pmod(_number(domain, 1), F.lit(1000)).cast("string"), F.lit(".example.org")))


def _address(e: Column, h: Column) -> Column:
    four = F.concat_ws(".", *[(F.pmod(_number(h, 1 + 4 * i, 4), F.lit(m)) + o).cast("string") for i, (m, o) in enumerate(((15, 240), (256, 0), (256, 0), (254, 1)))])
    six = F.concat_ws(":", F.lit("2001:db8"), *[F.regexp_replace(F.substring(h, 1 + 4 * i, 4), "^0+(?=.)", "") for i in range(6)])
    return F.when(F.contains(e, F.lit(":")), six).otherwise(four)


def _name(kind: Column, value: Column, shown: Column, h: Column, attempt: Column) -> Column:
    """A family or given name; later draws append a second name, and then letters."""
    def named(script: str) -> Column:
        def one(at: int) -> Column:
            both = [NAMES[script, g] for g in "mf"]
            n = _number(h, at)
            return F.when(kind == "family", _pick(FAMILIES[script], n)).when(kind == "given-m", _pick(both[0], n)).when(kind == "given-f", _pick(both[1], n)).otherwise(_pick(both[0] + both[1], n))

        more = F.when(attempt > 0, F.concat(F.lit("-"), one(17))).otherwise("")
        return F.concat(one(9), more, _longer(h, (attempt - 1) * 2, LETTERS[script]))

    made = F.when(value.rlike(r"^\p{IsCyrillic}"), named("cyrillic")).otherwise(named("latin"))
    made = F.concat(made, F.when((kind == "family") & (F.lower(shown) == F.concat(value, F.lit("а"))), "а").otherwise(""))
    return F.when(shown == F.upper(shown), F.upper(made)).otherwise(made)


def _numeric(e: Column, kind: Column, value: Column, h: Column, attempt: Column) -> Column:
    """Cards keep their first digit and a valid check digit, phones their country code; others are digits in place.
    From the third draw again on, a phone number gets further digits at its end."""

    def body(d: Column) -> Column:
        card = let(F.concat(F.substring(value, 1, 1), F.substring(d, F.lit(1), F.length(value) - 2)), lambda c: F.concat(c, _check_digit(c)))
        return F.when(kind == "card", card).when(kind == "phone", F.concat(F.regexp_extract(value, COUNTRY, 1), F.lit("2"), d)).otherwise(d)

    more = F.when(kind == "phone", _longer(h, attempt - 2, "0123456789012345")).otherwise("")
    return F.concat(let(let(_digits(h), body), lambda digits: _digits_into(e, digits)), more)


def unit_surrogate(unit: Column, attempt: Column, key: str = KEY) -> Column:
    """The replacement of one unit as it stands, a pure function of key, kind, value, attempt and shape."""
    kind, value, shown = unit["kind"], unit["value"], unit["shown"]
    return let(
        _draw(kind, value, attempt, key),
        lambda h: F.when(kind == "email", _email(shown, h, attempt, key)).when(kind == "ip", _address(shown, h))
        .when(kind == "family", _name(kind, value, shown, h, attempt)).when(F.startswith(kind, F.lit("given")), _name(kind, value, shown, h, attempt)).otherwise(_numeric(shown, kind, value, h, attempt)),
    )


def surrogate(e: Column, attempt=None, key: str = KEY, male: Column | None = None, female: Column | None = None) -> Column:
    """The replacement of one entity; ``attempt`` gives the draw of its i-th unit, all first draws where it is None."""
    def made(parts: Column) -> Column:
        new = F.transform(parts, lambda unit, i: unit_surrogate(unit, F.lit(0) if attempt is None else attempt(i), key))
        title = F.when(kind_of(e) == "name", F.concat(F.substring_index(e, " ", 1), F.lit(" "))).otherwise("")
        return F.concat(title, F.array_join(new, " "))

    return let(units(e, male, female), made)


def redrawn(found: DataFrame, key: str = KEY, rounds: int = 40) -> DataFrame:
    """(kind, value, attempt) of the units whose first surrogate clashes; ``found`` has kind and value, repeated or not.

    A surrogate's own value doesn't depend on the spelling, so clashes are looked for between values."""
    def drawn(attempt: Column) -> Column:
        unit = F.struct("kind", "value", F.col("value").alias("shown"))
        return let(unit_surrogate(unit, attempt, key), lambda made: _value(made, F.col("kind")))

    own = cut(found.select("kind", "value").distinct(), "units", small=True)
    state = cut(own.select("kind", "value", F.lit(0).alias("attempt"), drawn(F.lit(0)).alias("s")), "drawn", small=True)
    real_values = own.select("kind", F.col("value").alias("s"), F.lit(True).alias("real"))
    for turn in range(1, rounds + 1):
        # Written, so that the join may split the many units of a frequent first name: an aggregate's own shuffle can't be split.
        twice = cut(state.groupBy("kind", "s").agg(F.min(F.struct("attempt", "value")).alias("first"), F.count("*").alias("m")).filter("m > 1").select("kind", "s", "first"), "twice", small=True)
        clash = state.join(twice, ["kind", "s"], "left").join(real_values, ["kind", "s"], "left")
        bad = F.coalesce(F.struct("attempt", "value") != F.col("first"), F.lit(False)) | F.coalesce("real", F.lit(False))
        marked = cut(clash.withColumn("bad", bad).select("kind", "value", "attempt", "s", "bad"), "marked", small=True)
        if marked.filter("bad").isEmpty():
            break
        attempt = F.when(F.col("bad"), F.lit(turn)).otherwise(F.col("attempt"))
        again = F.when(F.col("bad"), drawn(F.lit(turn))).otherwise(F.col("s"))
        state = cut(marked.select("kind", "value", attempt.alias("attempt"), again.alias("s")), "drawn", small=True)
    else:
        raise RuntimeError(f"surrogates still clash after {rounds} rounds")
    return state.filter("attempt > 0").select("kind", "value", "attempt")


def _is(kind: str):
    return lambda e: kind_of(e) == kind


def replace_entities(docs: DataFrame, key: str = "doc_id", text: str = "text", secret: str = KEY, carry: tuple[str, ...] = ()) -> DataFrame:
    """``key``, carried columns, text with surrogates, n_entities and n_<kind> for each row."""
    any_sign = F.col("_t").rlike("[@0-9]|::") | F.col("_t").rlike(NAME)
    base = docs.select(docs[key].alias("_k"), docs[text].alias("_t"), *(docs[c].alias(f"_c{i}") for i, c in enumerate(carry)))
    found = F.when(any_sign, F.regexp_extract_all("_t", F.lit(ENTITY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    # Entities follow from the text alone: half of a SHA-256 of it stands for the row, so hashes of two texts don't meet.
    base = base.withColumn("_e", found).withColumn("_h", F.when(F.size("_e") > 0, F.unhex(F.substring(F.sha2("_t", 256), 1, 32))))
    base = base.withColumn("_m", titled(F.col("_e"), MALE)).withColumn("_f", titled(F.col("_e"), FEMALE))
    each = base.filter(F.size("_e") > 0).select("_h", "_m", "_f", F.posexplode("_e").alias("at", "e")).select("_h", "at", F.posexplode(units(F.col("e"), F.col("_m"), F.col("_f"))).alias("part", "unit"))
    spots = cut(each.select("_h", (F.col("at") * 2 + F.col("part")).alias("pos"), "unit.kind", "unit.value"), "spots")
    again = cut(redrawn(spots, secret), "redrawn", small=True)
    n = again.count()
    if n:
        moved = spots.join(F.broadcast(again) if n <= BROADCAST_ROWS else again, ["kind", "value"]).select("_h", "pos", "attempt").distinct()
        moved = cut(moved.groupBy("_h").agg(F.map_from_entries(F.collect_list(F.struct("pos", "attempt"))).alias("_a")), "moved", small=True)
        base = base.join(F.broadcast(moved) if moved.count() <= BROADCAST_ROWS else moved, "_h", "left")
        changed = F.transform("_e", lambda e, i: surrogate(e, lambda part: F.coalesce(F.try_element_at(F.col("_a"), i * 2 + part), F.lit(0)), secret, F.col("_m"), F.col("_f")))
    else:
        changed = F.transform("_e", lambda e: surrogate(e, key=secret, male=F.col("_m"), female=F.col("_f")))
    pieces = F.split("_t", ENTITY, -1)
    joined = F.array_join(F.zip_with(pieces, F.concat(changed, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    out = F.when(F.size("_e") > 0, joined).otherwise(F.col("_t"))
    counts = [F.when(F.size("_e") > 0, F.size(F.filter("_e", _is(k)))).otherwise(0).cast("long").alias(f"n_{k}") for k in KINDS]
    return base.select(F.col("_k").alias(key), *(F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)), out.alias(text), F.coalesce(F.size("_e"), F.lit(0)).cast("long").alias("n_entities"), *counts)
