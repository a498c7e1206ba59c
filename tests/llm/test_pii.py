import ipaddress
import random
import re

import regex
from pyspark.sql import functions as F

from millrace.llm.pii import COUNTRY, ENTITY, FAMILIES, NAMES, redrawn, replace_entities, surrogate, units

TEXTS = [
    (1, "Mail Ann.Lee42@Corp.example.com or call +1 (386) 555-3733; ip 25.86.162.211, card 4041 8949 7460 8795."),
    (2, "ann.lee42@corp.example.com again, card 4041894974608795, +1 386 555 3733 and SSN 123-45-6789."),
    (3, "Herr Otto Weber met Mrs Jane Doe; Herr Otto Weber left. Госпожа Иванова пришла."),
    (4, "No entity: version 4.0.1, 2024-01-01, 3.14 and a@b."), (5, None), (6, ""), (None, "x@y.org"), (7, "x@y.org"), (7, "x@y.org"),
]


def luhn(number):
    digits = [int(c) for c in number if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else (2 * d) // 10 + (2 * d) % 10 for i, d in enumerate(digits)) % 10 == 0


def test_type_consistent_coreferent_replacements(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string").selectExpr("*", "'c' AS _e", "1 AS n_email")
    out = replace_entities(df)
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())
    got = out.collect()
    assert len(got) == len(TEXTS)
    by = {r.doc_id: r for r in got}
    for k in (4, 5, 6):
        assert by[k].text == dict(TEXTS[:6])[k] and by[k].n_entities == 0
    mail = [re.search(r"\S+@\S+\.\w+", by[k].text)[0] for k in (1, 2)]
    assert mail[0].lower() == mail[1].lower() and mail[0][0].isupper() and "corp" not in mail[0].lower()
    cards = [re.search(r"card ([\d ]+\d)", by[k].text)[1] for k in (1, 2)]
    assert cards[0].replace(" ", "") == cards[1] and len(cards[0]) == 19 and luhn(cards[1]) and cards[1] != "4041894974608795"
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4};", by[1].text) and "555-3733" not in by[1].text
    assert re.search(r"ip \d+\.\d+\.\d+\.\d+,", by[1].text) and "25.86.162.211" not in by[1].text
    assert re.search(r"SSN \d{3}-\d{2}-\d{4}", by[2].text) and "123-45-6789" not in by[2].text
    m = re.fullmatch(r"Herr (\S+ \S+) met Mrs (\S+ \S+); Herr (\S+ \S+) left\. Госпожа (\S+) пришла\.", by[3].text)
    assert m[1] == m[3] != "Otto Weber" and m[1].split()[0] in NAMES["latin", "m"] and m[2].split()[0] in NAMES["latin", "f"]
    assert m[4].split("-")[0].removesuffix("а") in FAMILIES["cyrillic"] and m[4].endswith("а")  # in the feminine form
    assert (by[1].n_email, by[1].n_phone, by[1].n_ip, by[1].n_card, by[3].n_name) == (1, 1, 1, 1, 4)
    assert len({r.text for r in got if r.doc_id in (None, 7)}) == 1


def test_clashes_are_redrawn_until_distinct(spark):
    names = [f"Mr Person{chr(97 + i % 26)}{chr(97 + i // 26)} Family{chr(97 + i % 26)}" for i in range(600)]
    df = spark.createDataFrame([(i, f"{n} spoke") for i, n in enumerate(names)], "doc_id long, text string")
    texts = [r.text for r in replace_entities(df).collect()]
    assert len(set(texts)) == 600 and all(re.fullmatch(r"Mr \S+ \S+ spoke", t) for t in texts)
    ents = spark.createDataFrame([("given-m", n.split()[1].lower()) for n in names], "kind string, value string")
    assert redrawn(ents).count() > 0


def test_other_key_and_empty_table(spark):
    df = spark.createDataFrame([(1, "mail a.b@c.org")], "doc_id long, text string")
    assert replace_entities(df, secret="k1").first().text != replace_entities(df, secret="k2").first().text
    assert replace_entities(df.limit(0)).collect() == []


def test_more_units_than_the_first_surrogates_hold(spark):
    upper, lower = "АБВГДЕЖЗИКЛМНОПРСТУФ", "абвгдежзиклмнопрстуф"
    names = [f"Господин {a}{b}{c}ов" for a in upper for b in lower for c in lower][:4200]
    mails = [f"{c}@x.com" for c in "abcdefghijklmnopqrstuvwxyz0123456789"] + ["_@x.com", "-@x.com", "%@x.com"]
    phones = [f"+1 {n // 100:02d} {n % 100:02d}" for n in range(1500)]
    df = spark.createDataFrame([(e,) for e in names + mails + phones], "e string").withColumn("u", units(F.col("e"))[0])
    again = redrawn(df.select("u.kind", "u.value"))
    joined = df.select("e", "u.kind", "u.value").join(again, ["kind", "value"], "left")
    made = joined.select("e", surrogate(F.col("e"), lambda i: F.coalesce("attempt", F.lit(0))).alias("s")).collect()
    assert len({r.s for r in made}) == len(made) == 5739
    assert not {r.s for r in made} & {r.e for r in made}


def plain_units(e):
    """What an entity stands for, told without Spark."""
    if "@" in e:
        return [("email", e.lower())]
    if e[0].isalpha() and ":" not in e:
        title, *rest = e.split(" ")
        gender = {"Mr": "m", "Herr": "m", "Mrs": "f", "Frau": "f", "Dr": "n"}[title.rstrip(".")]
        return [("given-" + gender, rest[0].lower())] * (len(rest) > 1) + [("family", rest[-1].lower())]
    if ":" in e or re.fullmatch(r"\d+(\.\d+){3}", e):
        return [("ip", ipaddress.ip_address(e))]
    digits = re.sub(r"\D", "", e)
    kind = "national" if re.fullmatch(r"\d{3}-\d\d-\d{4}", e) else "card" if e[0] != "+" and len(digits) > 12 else "phone"
    return [(kind, e[0].replace("0", "") * (e[0] == "+") + digits)]


def test_random_entities_against_a_plain_reading(spark):
    rng = random.Random(5)
    given, family = ["John", "Ann", "Paul", "Kim", "Noa"], ["Smith", "Becker", "Lind", "O", "Weber", "Stone"]

    def entity():
        d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
        few = rng.randrange(30)
        number = f"{few:02d}"
        return rng.choice([
            lambda: rng.choice([f"a{few}@X.org", f"A{few}@x.org", f"b.{few}@mail.y.com"]),
            lambda: rng.choice([f"+1 212 555 12{number}", f"+121255512{number}", f"+1 (212) 555-12{number}", f"+33 1 23 45 67 {number}", f"+331234567{number}", f"386-555-37{number}"]),
            lambda: rng.choice([f"10.0.0.{few}", f"2001:db8:0:0:0:0:0:{few:x}", f"2001:DB8::{few:x}", f"fe80::12{few:x}", "::1"]),
            lambda: rng.choice(["4041 8949 7460 87" + number, "40418949746087" + number]),
            lambda: f"123-45-67{number}",
            lambda: " ".join([rng.choice(["Mr", "Mrs", "Herr", "Frau", "Dr", "Mr."]), *([rng.choice(given)] if rng.random() < 0.6 else []), rng.choice([f for f in family if len(f) > 1])]),
        ])()

    docs = [(i, "; ".join(["so", *(entity() + " and" for _ in range(rng.randrange(5)))])) for i in range(400)]
    got = {r.doc_id: r for r in replace_entities(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    pattern = regex.compile(ENTITY, regex.ASCII)
    real, seen = {}, {}
    for i, text in docs:
        old = [p.removesuffix(" and") for p in text.split("; ")[1:]]
        new = [p.removesuffix(" and") for p in got[i].text.split("; ")[1:]]
        assert len(old) == len(new) == got[i].n_entities and [m[0] for m in pattern.finditer(text)] == old
        for a, b in zip(old, new):
            ua, ub = plain_units(a), plain_units(b)
            assert [k for k, _ in ua] == [k for k, _ in ub]
            for x, y in zip(ua, ub):
                real[x] = y
                assert seen.setdefault(x, y) == y  # one surrogate for one unit, however it is written
                if x[0] == "phone" and x[1][0] == "+":
                    assert regex.match(COUNTRY, x[1])[1] == regex.match(COUNTRY, y[1])[1]
                if x[0] == "card":
                    assert luhn(y[1])
                if x[0] == "ip":
                    assert y[1].version == x[1].version and (y[1].is_reserved or y[1] in ipaddress.ip_network("2001:db8::/32"))
    assert len(set(seen.values())) == len(seen) > 150
    assert not set(seen.values()) & set(seen)


def test_names_keep_their_family(spark):
    df = spark.createDataFrame([(1, "Mr John Smith met Dr Smith and MRS; Mrs Jane SMITH left"), (2, "C++ std::vector, at 12:30:45, a::b, beef::"), (3, "Call +33 1 23 45 67 89 now")], "doc_id long, text string")
    by = {r.doc_id: r for r in replace_entities(df).collect()}
    m = re.fullmatch(r"Mr (\S+) (\S+) met Dr (\S+) and MRS; Mrs (\S+) (\S+) left", by[1].text)
    assert m[2] == m[3] != "Smith" and m[5] == m[2].upper()
    assert by[2].n_ip == 1 and by[2].text.startswith("C++ std::vector, at 12:30:45, a::b, 2001:db8:")
    assert re.fullmatch(r"Call \+33 2 \d\d \d\d \d\d \d\d now", by[3].text)


def test_compound_capital_and_feminine_names(spark):
    texts = [
        "Herr Jürgen Müller-Lüdenscheidt und Mr O'Brien",
        "MR. JOHN SMITH wrote.",
        "Mr John Smith met Dr John Smith",
        "Dr Ann Smith met Mrs Ann Smith",
        "Госпожа Мария Иванова и Господин Иванов",
    ]
    got = [r.text for r in replace_entities(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert all(p not in got[0] for p in ("Jürgen", "Müller", "Lüdenscheidt", "Brien"))
    assert "JOHN" not in got[1] and "SMITH" not in got[1] and got[1] == got[1].upper().replace("WROTE", "wrote")
    for text, (a, b) in ((got[2], ("Mr", "Dr")), (got[3], ("Dr", "Mrs"))):
        first, second = text.split(" met ")
        assert first.removeprefix(f"{a} ") == second.removeprefix(f"{b} ")
    female, male = got[4].split(" и ")
    assert female.split()[-1] == male.split()[-1] + "а" and "Иванов" not in got[4]
