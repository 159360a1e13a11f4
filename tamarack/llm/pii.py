"""Personal data by candidate gradient boosting (operator 8), in DataFrame
functions only.

Base kinds (email, ip, card, phone) are exact formats and always stay.  Beyond
them high-recall generators propose spans, which may overlap: digit groups,
spelled-out mail addresses, account codes, colon-separated addresses, hardware
addresses, dates, names, streets, handles and coordinates.  Boosted trees score each
by its format and the words around it; a span is taken if its score passes its
generator's threshold, no base span overlaps it and no better candidate does.

The trees are trained here, on a set that ``examples`` writes from templates and
a fixed seed: no corpus row is read for it, so the model is the same everywhere.
Templates are in four languages, and half of them are formats that only look like
personal data.  Features of examples and of documents come from the same
expressions.  A third of the set, held back, calibrates the thresholds: the lowest
with 98 percent precision.  ``candidates`` gives what the generators propose, with
scores, so that precision can be looked at on any corpus.

Edge cases: null and empty texts have no spans; repeated rows each give a row;
null ids are kept; an empty table gives no rows; other columns are not read.  Of
overlapping candidates with one score the first, then the shortest, then the one of
the earlier generator is taken.  Patterns never rescan a run of characters, so long
runs cost their length; spans are compared with those near them alone.
"""

from __future__ import annotations

import functools
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _boosting
from ._spans import cut_from, filter_near, listed, masked, matches, number_of, pieces

#: Base kinds in order: kind, pattern, sign that a text may have one.  The look-behind and
#: possessive forms match what the plain patterns match, without trying a run from each place.
BASE = [
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]++\.[0-9]"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", r"(?:[0-9][\x20-]?){15}[0-9]"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
]
_NAME = r"\p{Lu}[\p{L}'\u2019]++(?:[\x20-]\p{Lu}[\p{L}'\u2019]++){0,3}+"
_DOMAIN = "[A-Za-z0-9-]++"
#: Word edges, spelled out: what \\b means differs between regular expression engines.
_START, _END = r"(?<![\p{L}0-9_])", r"(?![\p{L}0-9_])"
_DATE = r"(?:[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:[0-9]{4}|[0-9]{2})|[0-9]{1,2}\.?\x20(?:de\x20)?\p{L}{3,10}\x20(?:de\x20)?[12][0-9]{3})"
_TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Se\u00f1ora?|Sra?"
_INTRO = ("name is ", "ame: ", "I am ", "hei\u00dfe ", "llamo ", "appelle ")
#: Generators: kind, pattern, a sign that each match has, and substrings of which it has one
#: (none: it has a digit).  Only texts with the cheap signs are searched.
MORE = [
    ("number", r"(?<![0-9])[(]?[0-9]++(?:[().\x20/-]{1,3}+[0-9]++)*+", r"[0-9](?:[().\x20/-]{0,3}[0-9]){5}", ()),
    ("mail", rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?[(\[{{]at[)\]}}]\x20?|\x20at\x20){_DOMAIN}(?:(?:\.|\x20?[(\[{{]dot[)\]}}]\x20?|\x20dot\x20){_DOMAIN})++", r"[(\[{]at[)\]}]|\x20at\x20[A-Za-z0-9-]++(?:\.|\x20dot\x20|\x20?[(\[{]dot[)\]}])[A-Za-z0-9\x20-]", ("(at)", "[at]", "{at}", " at ")),
    ("account", rf"{_START}[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{2,}}+(?:\x20?[A-Z0-9]{{1,3}})?+{_END}", r"[A-Z]{2}[0-9]{2}", ()),
    ("ip6", r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])", r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:", (":",)),
    ("mac", r"(?<![0-9A-Fa-f:-])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:-])", r"[0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{2}[:-]", (":", "-")),
    ("date", rf"(?<![0-9./-]){_DATE}(?![0-9])", r"[0-9][-/.][0-9]{1,2}[-/.][0-9]|[0-9]\.?\x20(?:de\x20)?\p{L}{3,10}\x20(?:de\x20)?[12][0-9]{3}", ()),
    ("name", rf"(?:(?<!\p{{L}})(?:{_TITLES})\.?\x20|(?<=name\x20is\x20|[Nn]ame:\x20|I\x20am\x20|hei\u00dfe\x20|llamo\x20|appelle\x20)){_NAME}", rf"(?:{_TITLES})\.?\x20\p{{Lu}}|(?:{'|'.join(_INTRO)})\p{{Lu}}", ("Mr", "Ms", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Se\u00f1or", "Sr", *_INTRO)),
    ("street", rf"(?<![0-9])(?:[0-9]{{1,5}}[a-z]?,?\x20(?:(?:rue|avenue|boulevard)\x20(?:de\x20la\x20|de\x20|du\x20|des\x20)?{_NAME}|(?:\p{{Lu}}\p{{L}}++\x20){{1,3}}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Boulevard|Blvd|Drive|Court|Square){_END}))|(?<!\p{{L}})(?:\p{{Lu}}\p{{L}}*(?:stra\u00dfe|strasse|weg|platz|allee)|(?:Calle|Avenida|Plaza)\x20(?:de\x20la\x20|de\x20|del\x20)?{_NAME},?)\x20[0-9]{{1,4}}[a-z]?{_END}", r"[0-9][a-z]?,?\x20(?:rue|avenue|boulevard|\p{Lu})|(?:stra(?:\u00df|ss)e|weg|platz|allee)\x20[0-9]|(?:Calle|Avenida|Plaza)\x20", ()),
    ("handle", r"(?<![A-Za-z0-9_@./])@[A-Za-z0-9_]{3,30}+(?![A-Za-z0-9_@.])", "@[A-Za-z0-9_]{3}", ("@",)),
    ("place", r"(?<![0-9.])-?[0-9]{1,3}\.[0-9]{4,8},\x20?-?[0-9]{1,3}\.[0-9]{4,8}(?![0-9.])", r"\.[0-9]{4,8},\x20?-?[0-9]", ()),
]
#: Digits that a digit group has, from a short account number to a long one.
NUMBER = (6, 30)
#: What stands before the sentence: words of another sentence are no context.
_SENTENCE = r"(?s)^.*\p{L}{4}[.!?;]\s"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
FOUND = "array<struct<k:int,s:int,e:int,kind:string>>"
# Words that stand before personal data, and before what only looks like it, in four languages.
CALLED = rf"(?i){_START}(?:phone|tel|telephone|telefon|t\u00e9l\u00e9phone|tel\u00e9fono|mobile|handy|m\u00f3vil|cell|call|dial|ring|text|fax|contact|whatsapp|hotline){_END}"
NAMED = rf"(?i){_START}(?:ssn|social security|passport|passeport|pasaporte|ausweis|iban|konto|compte|cuenta|account|tax id|national id|dni|insurance|patient|licen[cs]e no|device|mac){_END}"
PLACED = rf"(?i){_START}(?:mail|e-?mail|reach|write to|follow|lives? at|wohnt|habite|vive|address|adresse|direcci\u00f3n|located|gps){_END}"
BORN = rf"(?i){_START}(?:born|birth|birthday|dob|geboren|geb|naissance|n\u00e9e?|nacid[oa]|nacimiento|nac\u00ed){_END}"
OTHER = rf"(?i)(?:{_START}(?:version|release|isbn|issn|doi|order|page|pages|section|figure|table|chapter|invoice|part|item|sku|model|serial|batch|year|price|total|sum|room|line|build|port|since|until|published|updated|dated|meeting|score|population|around|about|look|pi|ratio|value|equals){_END}|[$#%=\u20ac])"


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]+", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def worth(i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + worth(i)) % 10 == 0


CHECKS = {
    "ip": lambda v: v.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
    "card": lambda v: F.length(_digits(v)).between(16, 19) & F.when(F.length(_digits(v)).between(16, 19), _luhn(_digits(v))).otherwise(False),
    "phone": lambda v: F.length(_digits(v)).between(8, 15),
}


def _base(text: Column, k: int) -> Column:
    kind, pattern, sign = BASE[k]
    spans = matches(text, pattern)
    if kind in CHECKS:
        spans = F.filter(spans, lambda x: CHECKS[kind](x["v"]))
    named = F.transform(spans, lambda x: F.struct(F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e"), F.lit(kind).alias("kind")))
    there = text.contains(sign) if sign == "@" else text.rlike(sign)
    return F.when(there, named).otherwise(F.array().cast(FOUND)).cast(FOUND)


def _features(v: Column, near: Column, after: Column, k: int) -> list[Column]:
    """Small integers that describe a candidate and what stands around it: up to 30
    characters before, one after."""
    before, n = F.right(near, F.lit(1)), F.length(_digits(v))
    flag = lambda c: c.cast("int")
    return [
        F.lit(k),
        F.least(n, F.lit(40)),
        F.least(F.length(v) - n, F.lit(40)),
        F.least(F.size(F.split(v, "[^0-9]+")), F.lit(20)),
        flag(v.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$")),
        flag(v.rlike(r"^\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}$")),
        flag(v.rlike(rf"^{_DATE}$")),
        flag(near.rlike(CALLED)),
        flag(near.rlike(NAMED)),
        flag(near.rlike(PLACED)),
        flag(near.rlike(BORN)),
        flag(near.rlike(OTHER)),
        flag(before.rlike(r"[A-Za-z0-9.$#/_=-]")),
        flag(after.rlike(r"[A-Za-z0-9%/_$#&*]")),
        flag(v.rlike(r"[A-Fa-f]") & v.contains(":")),
        F.least(F.length(F.regexp_replace(v, r"[^\p{Lu}]+", "")), F.lit(20)),
        flag(v.rlike(r"[(\[{]at[)\]}]|\x20dot\x20")),
        flag(v.rlike(f"^(?:{_TITLES})")),
        flag(v.rlike(r"[.][0-9]+[^0-9]")),
    ]


N_FEATURES = 19


def _candidates(text: Column, parts: Column, digit: Column, k: int) -> Column:
    """array of (k, s, e, kind, features) of generator ``k``; ``parts``: the text's
    ``pieces``; ``digit``: whether it has one."""
    kind, pattern, sign, needs = MORE[k]
    there = functools.reduce(Column.__or__, [text.contains(x) for x in needs]) if needs else digit

    def placed(x: Column) -> Column:
        near = cut_from(parts, F.greatest(x["s"] - 30, F.lit(0)), F.least(x["s"], F.lit(30)))
        near = F.regexp_replace(near, _SENTENCE, "")
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"), near.alias("near"), cut_from(parts, x["e"], F.lit(1)).alias("after"))

    def full(x: Column) -> Column:
        f = F.array(*_features(x["v"], x["near"], x["after"], k))
        return F.struct(F.lit(len(BASE) + k).alias("k"), x["s"].alias("s"), x["e"].alias("e"), F.lit(kind).alias("kind"), f.alias("f"))

    none = F.array().cast("array<struct<k:int,s:int,e:int,kind:string,f:array<int>>>")
    found = matches(text, pattern)
    if kind == "number":
        found = F.filter(found, lambda x: F.length(_digits(x["v"])).between(*NUMBER))
    return F.when(there & text.rlike(sign), F.transform(F.transform(found, placed), full)).otherwise(none)


def examples(n: int = 4000, seed: int = 11) -> list[tuple[int, str, int, int]]:
    """(number, text, start, label) of ``n`` invented candidates in invented text."""
    rng = random.Random(seed)
    pick = lambda *x: rng.choice(x)
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    hexed = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    word = lambda: "".join(rng.choice("aeioustnrl") for _ in range(rng.randint(2, 8)))
    cap = lambda: word().capitalize()
    month = lambda: pick("March", "June", "May", "Juli", "Mai", "enero", "mars", "October")
    date = lambda: pick(f"20{num(2)}-0{rng.randint(1, 9)}-1{num(1)}", f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.19{num(2)}", f"{rng.randint(1, 12)}/{rng.randint(1, 28)}/19{num(2)}", f"{rng.randint(1, 28)} {month()} 19{num(2)}")
    phone = lambda: pick(f"{num(3)}-{num(3)}-{num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"0{num(2)} {num(4)} {num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"0{num(3)}/{num(6)}", f"0{num(1)} {num(2)} {num(2)} {num(2)} {num(2)}", f"00{num(2)} {num(3)} {num(7)}")
    plain = lambda: word() + pick(" ", ", ", " - ")
    colon = lambda *x: pick(*x) + pick(" ", ": ", " is ", " at ", " no. ")
    yes = [
        lambda: (colon("call", "phone", "tel", "mobile", "fax", "contact", "Telefon", "t\u00e9l\u00e9phone", "tel\u00e9fono", "dial", "ring", "whatsapp", "handy"), phone()),
        lambda: (plain(), pick(f"{num(3)}-{num(3)}-{num(4)}", f"({num(3)}) {num(3)}-{num(4)}")),
        lambda: (pick(colon("SSN", "social security", "tax id", "insurance"), plain()), f"{num(3)}-{num(2)}-{num(4)}"),
        lambda: (colon("passport", "national id", "account", "Konto", "cuenta", "compte", "patient", "DNI", "insurance"), pick(num(rng.randint(7, 12)), f"{num(4)} {num(4)} {num(3)}", f"{num(3)} {num(3)} {num(3)}")),
        lambda: (pick("mail ", "reach ", "write to ", plain()), pick(f"{word()}.{word()} (at) {word()} (dot) com", f"{word()}[at]{word()}.org", f"{word()} at {word()} dot net", f"{word()}{num(2)} {{at}} {word()}.de")),
        lambda: (pick("IBAN ", "account ", "Konto ", "compte ", plain()), f"{pick('DE', 'FR', 'GB', 'ES', 'IT', 'NL')}{num(2)} {num(4)} {num(4)} {num(4)} {num(4)}{pick('', ' ' + num(2))}"),
        lambda: (pick("IBAN ", "account ", "cuenta "), f"{pick('DE', 'FR', 'ES')}{num(18)}"),
        lambda: (plain(), ":".join(hexed(4) for _ in range(8))),
        lambda: (pick("device ", "MAC ", plain()), pick(":", "-").join(hexed(2) for _ in range(6))),
        lambda: (colon("born", "date of birth", "DOB", "geboren am", "n\u00e9e le", "nacido el", "birthday", "born on"), date()),
        lambda: (pick(plain(), plain(), "by ", "for "), f"{pick('Mr', 'Mrs', 'Ms', 'Dr', 'Prof', 'Herr', 'Frau', 'Madame', 'Se\u00f1ora')}{pick('', '.')} {cap()}{pick('', ' ' + cap())}"),
        lambda: (pick("my name is ", "Name: ", "I am ", "ich hei\u00dfe ", "me llamo ", "je m'appelle "), f"{cap()} {cap()}"),
        lambda: (pick("lives at ", "address: ", "address ", plain()), f"{rng.randint(1, 9999)} {cap()} {pick('Street', 'Road', 'Avenue', 'Lane', 'Drive', 'Court')}"),
        lambda: (pick("wohnt ", "Adresse: ", plain()), f"{cap()}{pick('stra\u00dfe', 'weg', 'platz', 'allee')} {rng.randint(1, 200)}"),
        lambda: (pick("habite ", "adresse: ", plain()), f"{rng.randint(1, 200)} rue de {cap()}"),
        lambda: (pick("vive ", "direcci\u00f3n: ", plain()), f"Calle {cap()} {rng.randint(1, 200)}"),
        lambda: (pick("follow ", "write to ", "contact ", plain()), f"@{word()}{pick('_', '')}{word()}{pick('', num(2))}"),
        lambda: (pick("located at ", "gps ", "lives at ", "address "), f"{pick('', '-')}{num(2)}.{num(5)}, {pick('', '-')}{num(2)}.{num(5)}"),
    ]
    no = [
        lambda: (colon("on", "year", "published", "updated", "dated", "since", "until", "meeting", word(), word()), date()),
        lambda: (colon("order", "invoice", "item", "SKU", "part", "serial", "batch", "model", "build"), pick(num(rng.randint(6, 16)), f"{num(3)}-{num(3)}-{num(4)}", f"{num(4)}-{num(4)}")),
        lambda: (colon("ISBN", "page", "pages", "section", "table", "doi", "ISSN"), pick(f"{num(3)}-{num(1)}-{num(3)}-{num(5)}", f"{num(4)}-{num(4)}", f"{num(2)}.{num(4)}/{num(6)}", f"{num(9)}")),
        lambda: (pick("$", "#", "total ", "price ", "sum ", "population ", "\u20ac"), pick(f"{num(3)} {num(3)} {num(3)}", f"{num(7)}", f"{num(3)}.{num(3)}.{num(3)}")),
        lambda: (plain(), f"{num(2)} {num(2)} {num(2)} {num(2)} {num(2)}"),
        lambda: (plain(), num(pick(6, 7, 8, 10, 12, 14, 16, 20))),
        lambda: (plain(), f"{num(1)}.{num(1)}.{num(2)}.{num(3)}-{num(2)}"),
        lambda: (pick("pi ", "ratio ", "value ", "equals ", "= ", plain()), f"{num(1)}.{num(rng.randint(6, 9))}"),
        lambda: (plain(), f"{pick('1', '2')}{num(3)} - {pick('1', '2')}{num(3)}"),
        lambda: (pick("version ", "line ", "model ", "part "), f"AB{num(2)}{num(4)}CDEF"),
        lambda: (plain(), ":".join(num(2) for _ in range(4))),
        lambda: (plain(), f"{word()} at {word()}.com"),
        lambda: ("look ", f"at {word()}.com"),
        lambda: (plain(), f"{rng.randint(1, 28)} {word()} 20{num(2)}"),
        lambda: (pick("about ", "around ", "table ", "ratio "), f"{num(2)}.{num(4)}, {num(2)}.{num(4)}"),
        lambda: (pick("I am ", "Name: "), f"{pick('Happy', 'Here', 'Not', 'Sorry')}"),
        lambda: (plain() + "def:\n", f"@{pick('property', 'override', 'staticmethod', 'media', 'import', 'param')}"),
        lambda: (word(), f"{num(16)}{pick('$$$', '%%%', '###')}"),
    ]
    out = []
    for k in range(n):
        label = k % 2
        lead, body = rng.choice(yes if label else no)()
        head = " ".join(word() for _ in range(rng.randint(3, 9))) + pick(". ", " ", ", ") + lead
        out.append((k, f"{head}{body}{pick(' ', ' ', '. ', ', ')}{word()} {word()}.", len(head), label))
    return out


@functools.cache
def trained(n: int = 4000, seed: int = 11, precision: float = 0.98) -> tuple[list, dict[int, float]]:
    """(trees, threshold of each generator); computed once in a driver process."""
    spark = SparkSession.getActiveSession()
    frame = spark.createDataFrame(examples(n, seed), "i int, text string, at int, label int")
    every = F.concat(*(_candidates(F.col("text"), F.col("parts"), F.lit(True), k) for k in range(len(MORE))))
    rows = frame.withColumn("parts", pieces(F.col("text"))).select("i", "at", "label", F.explode(every).alias("c")).select("i", "at", "label", "c.s", "c.e", "c.k", "c.f").collect()
    learn: dict[tuple[int, ...], list[int]] = {}
    held = []
    for r in rows:
        label = int(r.label == 1 and abs(r.s - r.at) <= 1)
        x = tuple(r.f)
        if r.i % 6 in (4, 5):  # two of six: both labels
            held.append((x, label))
        else:
            learn.setdefault(x, [0, 0])[label] += 1
    trees = _boosting.boost({x: tuple(c) for x, c in learn.items()})
    scored = sorted(((sum(_boosting.value(t, x) for t in trees), x[0], y) for x, y in held), reverse=True)
    limits = {}
    for k in range(len(MORE)):
        mine = [(z, y) for z, g, y in scored if g == k and z > 0]
        good, limits[k] = 0, float("inf")
        for i, (z, y) in enumerate(mine):
            good += y
            below = mine[i + 1][0] if i + 1 < len(mine) else 0.0
            if good >= precision * (i + 1) and below < z:  # half-way to the next score below
                limits[k] = (z + below) / 2
    return trees, limits


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, base, proposed): base spans (k, s, e, kind) and what the generators
    propose, (k, s, e, kind, z) with the trees' score, overlapping as it may be."""
    trees, _ = trained()
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    rows = rows.select(id_col, "_t", F.array_sort(F.concat(*(_base(F.col("_t"), k) for k in range(len(BASE))))).alias("base"))
    rows = rows.withColumns({"_parts": pieces(F.col("_t")), "_digit": F.col("_t").rlike("[0-9]")})
    rows = rows.withColumn("_c", F.concat(*(_candidates(F.col("_t"), F.col("_parts"), F.col("_digit"), k) for k in range(len(MORE)))))

    def scored(x: Column) -> Column:
        z = _boosting.as_column(trees, [F.get(x["f"], F.lit(i)) for i in range(N_FEATURES)])
        return F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"), z.alias("z"))

    return rows.select(id_col, F.col("_t").alias(text_col), "base", F.when(F.size("_c") > 0, F.transform("_c", scored)).alias("proposed"))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: bool = True) -> DataFrame:
    """(id, base, found): spans (k, s, e, kind), by kind as listed and then start.
    ``found`` holds ``base`` and, with ``more``, the accepted candidates."""
    if not more:
        t = F.coalesce(F.col(text_col), F.lit(""))
        rows = docs.select(F.col(id_col), F.array_sort(F.concat(*(_base(t, k) for k in range(len(BASE))))).alias("base"))
        return rows.select(id_col, "base", F.col("base").alias("found"))
    _, limits = trained()

    def passes(x: Column, near: Column) -> Column:
        limit = F.lit(float("inf"))
        for k, z in limits.items():
            limit = F.when(x["k"] == len(BASE) + k, F.lit(z)).otherwise(limit)
        return (x["z"] >= limit) & ~F.exists(near, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))

    rows = candidates(docs, id_col, text_col)
    rows = rows.withColumn("_c", filter_near(F.col("proposed"), F.col("base"), passes))
    order = lambda x: F.struct(x["z"], -x["s"], -x["e"], -x["k"])
    best = lambda x, near: ~F.exists(near, lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"]) & (order(y) > order(x)))
    plain = F.transform(filter_near(F.col("_c"), F.col("_c"), best), lambda x: F.struct(x["k"], x["s"], x["e"], x["kind"])).cast(FOUND)
    return rows.select(id_col, "base", F.array_sort(F.concat("base", F.coalesce(plain, F.array().cast(FOUND)))).alias("found"))


def redact(docs: DataFrame, mark: str = "[PII]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): whole texts with all spans masked; null stays null."""
    copy = docs.select(F.struct(F.col(id_col).alias("i"), F.col(text_col).alias("t")).alias("_row"), F.col(text_col).alias("_text"))
    found = find_pii(copy, "_row", "_text")
    by_start = F.array_sort(F.transform("found", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))))
    return found.select(F.col("_row.i").alias(id_col), masked(F.col("_row.t"), by_start, mark).alias(text_col))


def digests(found: DataFrame) -> DataFrame:
    """``find_pii`` rows as counts, base digest and span list."""
    n = [number_of("base", k).alias(f"n_{b[0]}") for k, b in enumerate(BASE)]
    return found.select("*", *n, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("found")).alias("spans")).drop("base", "found")
