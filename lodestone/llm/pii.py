"""PII replacement by keyed surrogates, in DataFrame expressions only.

Entities are found by patterns, brought to a canonical form (so that one entity written in several
ways is one), and given a surrogate by a keyed hash of type and canonical form. Surrogates keep
their type's format: phone numbers their country code and punctuation, cards their first digit
and check digit, addresses their shape and top-level domain, tokens their character kinds. A name
is found after a title; its given names and its family name are entities of their own, so that
"Dr. Maria Keller", "Frau Keller" and an untitled "Maria Keller" in the same text stay one person;
given names keep script and gender, which the titles of the whole corpus or a list of known names
tell, initials become other initials, one for one, particles (von, de) stay. As parts keep apart by their
kind, and names keep their number of parts, two names never become one.

A collision check over all distinct entities finds surrogates that two entities share or that are
themselves entities of the corpus; those are drawn again under the next attempt, from formats that
grow longer by the attempt, until none is left. One entity has one surrogate everywhere.

Defined cases: a null text stays null; a text without entities stays as it is; rows are told apart
by id and text, so null and repeated ids are rewritten each by their own text, and repeated rows
alike; texts of any length are read whole; an empty table gives no rows; other columns come back
as they are (a column named n_entities is replaced). Formats that can't grow (IP addresses, card
numbers) end the job with an error when a corpus uses them up.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.exprs import by_row_id, let
from lodestone.llm.workspace import Workspace, bounded

#: Courtesy titles and the gender that they tell (m, f; x: either).
TITLES = {"Mr": "m", "Mister": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Господин": "m", "Κύριος": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mlle": "f", "Señora": "f", "Sra": "f", "Госпожа": "f", "Κυρία": "f", "Dr": "x", "Prof": "x"}
#: Given names by script and gender, and syllables of invented family names by script.
GIVEN = {
    "Latin": {"m": ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Ivan", "Jonas", "Karl", "Leo", "Martin", "Noel", "Oscar", "Paul", "Simon"], "f": ["Ada", "Bella", "Clara", "Diana", "Emma", "Flora", "Greta", "Helena", "Ida", "Julia", "Klara", "Laura", "Maria", "Nora", "Olga", "Sara"]},
    "Cyrillic": {"m": ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Максим"], "f": ["Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Мария", "Ольга"]},
    "Greek": {"m": ["Αλέξης", "Γιάννης", "Δημήτρης", "Ηλίας", "Κώστας", "Νίκος", "Πέτρος", "Σπύρος"], "f": ["Άννα", "Βασιλική", "Δήμητρα", "Ελένη", "Ζωή", "Ιωάννα", "Μαρία", "Σοφία"]},
}
SYLLABLES = {
    "Latin": ["ba", "ber", "den", "dor", "fel", "gan", "hol", "kel", "lan", "mar", "nor", "per", "ros", "sal", "tor", "vin"],
    "Cyrillic": ["ба", "вол", "гор", "дан", "зор", "кар", "лес", "мир", "нов", "пет", "рад", "сол", "тов", "чер", "шам", "яр"],
    "Greek": ["αν", "βασ", "γαλ", "δημ", "ζαχ", "θεο", "καρ", "λαμ", "μαν", "νικ", "παν", "ραλ", "σαβ", "τσα", "φιλ", "χρι"],
}
#: Endings of invented given names by script and gender.
ENDINGS = {"Latin": {"m": "us", "f": "ina"}, "Cyrillic": {"m": "ан", "f": "ина"}, "Greek": {"m": "ος", "f": "ίνα"}}
#: Capitals that initials are drawn from, by script and marks.
INITIALS = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞĆČĐŁŃŚŠŹŻŽ", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"]
#: Particles of family names, which stay.
PARTICLES = ["von", "van", "der", "den", "dem", "zu", "zum", "de", "del", "della", "des", "du", "di", "da", "dos", "la", "le", "el", "bin", "al"]
#: A name's part: a capital, then a small letter or mark, then any letters; dotted initials and particles may precede it.
_NAME = r"(?:\p{Lu}\.[ -]?){0,9}+(?:(?:" + "|".join(PARTICLES) + r") ){0,3}+\p{Lu}[\p{Ll}\p{M}'’-][\p{L}\p{M}'’-]*+"
#: A part in capitals.
_CAPS = r"(?:\p{Lu}\.[ -]?){0,9}+\p{Lu}[\p{Lu}\p{M}'’-]++(?![\p{L}\p{N}])"
_PART = f"(?:{_NAME}|{_CAPS})"
#: A name is as many parts as follow each other; behind a title in capitals, where a whole text may be in
#: capitals, up to four parts in capitals.
_WHOLE = f"{_PART}(?: {_PART})*+"
_SHOUTED = f"(?:{_NAME}(?: {_PART})*+|{_CAPS}(?: {_CAPS}){{0,3}}+)"
_TITLE = "|".join(TITLES)
_CAPS_TITLE = "|".join(sorted({t.upper() for t in TITLES}))
#: Patterns by type, tried in this order at each place. No pattern backtracks over what it has passed.
PATTERNS = {
    "EMAIL": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+",
    "IBAN": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "CARD": r"(?<![\p{L}\p{N}])\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}(?![\p{L}\p{N}])",
    "PHONE": r"(?<![\p{L}\p{N}])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?![\p{L}\p{N}])",
    "IP": r"(?<![\p{L}\p{N}.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)",
    "SSN": r"(?<![\p{L}\p{N}])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}])",
    "TOKEN": r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,128}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9]{20,})(?![\p{L}\p{N}])",
    "PERSON": r"(?<=(?<![\p{L}])(?:" + _TITLE + r")\.? )" + _WHOLE + r"|(?<=(?<![\p{L}])(?:" + _CAPS_TITLE + r")\.? )" + _SHOUTED,
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A title and its name, for the gender.
TITLED = r"(?<![\p{L}])((?:" + _TITLE + r")\.? " + _WHOLE + "|(?:" + _CAPS_TITLE + r")\.? " + _SHOUTED + ")"
#: Texts without these cannot hold an entity; the keys and [a-f]{32} are tokens that need no digit.
HINT = r"[@\d]|AKIA|gh[pousr]_|sk-|[a-f]{32}|(?<![\p{L}])(?:" + _TITLE + "|" + _CAPS_TITLE + r")\.? \p{L}"


def entity_type(s: Column) -> Column:
    """The first type whose pattern is the whole of ``s``; the rest are names."""
    when = None
    for kind, p in PATTERNS.items():
        if kind != "PERSON":
            test = s.rlike(f"^(?:{p})$")
            when = F.when(test, kind) if when is None else when.when(test, kind)
    return when.otherwise("PERSON")


def canonical(kind: Column, s: Column) -> Column:
    digits = F.regexp_replace(s, r"\D", "")
    return (
        F.when(kind == "EMAIL", F.lower(s))
        .when(kind.isin("CARD", "SSN"), digits)
        .when(kind == "PHONE", F.concat(F.when(s.startswith("+"), "+").otherwise(""), digits))
        .when(kind == "IBAN", F.regexp_replace(s, " ", ""))
        .when(kind == "IP", F.array_join(F.transform(F.split(s, r"\."), lambda x: x.cast("int").cast("string")), "."))
        .when(kind == "PERSON", F.lower(s))
        .otherwise(s)
    )


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _draw(seed: Column, i: Column | int, n: int) -> Column:
    """A keyed draw from 0 to n - 1."""
    return F.pmod(F.xxhash64(seed, F.lit(i) if isinstance(i, int) else i), F.lit(n))


def _pick(letters: str, k: Column) -> Column:
    return F.substring(F.lit(letters), k.cast("int") + 1, F.lit(1))


def _same_kind(seed: Column, s: Column) -> Column:
    """Each character replaced by one of its kind: digit, letter by case and script; others stay."""
    sets = [(r"\d", "0123456789"), ("[a-z]", "abcdefghijklmnopqrstuvwxyz"), ("[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("[а-яё]", "абвгдежзиклмнопрстуфхцчшэюя"), ("[А-ЯЁ]", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"), ("[α-ωά-ώ]", "αβγδεζηθικλμνξοπρστυφχψω"), ("[Α-ΩΆ-Ώ]", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"), (r"\p{L}", "abcdefghijklmnopqrstuvwxyz")]

    def one(c: Column, i: Column) -> Column:
        cases = [(c.rlike(f"^{p}$"), _pick(a, _draw(seed, i, len(a)))) for p, a in sets]
        return reduce(lambda w, x: w.when(*x), cases[1:], F.when(*cases[0])).otherwise(c)

    return F.array_join(F.transform(_chars(s), one), "")


def _hex(seed: Column, s: Column) -> Column:
    return F.array_join(F.transform(_chars(s), lambda c, i: _pick("0123456789abcdef", _draw(seed, i, 16))), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10."""
    n = F.length(digits)
    values = F.transform(_chars(digits), lambda c, i: F.when((n - i) % 2 == 1, c.cast("int")).otherwise(F.pmod(c.cast("int") * 2, F.lit(10)) + (c.cast("int") * 2 / 10).cast("int")))
    return F.pmod(F.aggregate(values, F.lit(0), lambda a, x: a + x), F.lit(10))


def _digits(seed: Column, n: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: _draw(seed, i, 10).cast("string")), "")


def script(s: Column) -> Column:
    return F.when(s.rlike(r"\p{IsCyrillic}"), "Cyrillic").when(s.rlike(r"\p{IsGreek}"), "Greek").otherwise("Latin")


def _name_lists(which: dict[str, list[str]]) -> Column:
    return F.create_map(*(x for k, v in which.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))


def _genders() -> Column:
    """The gender of each known given name."""
    return F.create_map(*(F.lit(x) for by in GIVEN.values() for g, v in by.items() for name in v for x in (name.lower(), g)))


def _syllables(seed: Column, canon: Column, n: int) -> Column:
    """An invented word of n syllables."""
    known = F.element_at(_name_lists(SYLLABLES), script(canon))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.element_at(known, _draw(seed, i, 16).cast("int") + 1)), "")


def _given(canon: Column, gender: Column, seed: Column, attempt: int) -> Column:
    """A given name of the script and gender: a known one, then two of them, then invented ones that grow."""
    g = F.when(gender == "x", F.when(_draw(seed, 99, 2) == 0, "m").otherwise("f")).otherwise(gender)
    at = F.concat(script(canon), g)
    if attempt > 1:
        endings = F.create_map(*(F.lit(x) for sc, by in ENDINGS.items() for k, v in by.items() for x in (sc + k, v)))
        return F.initcap(F.concat(_syllables(seed, canon, attempt), F.element_at(endings, at)))
    known = F.element_at(F.create_map(*(x for sc, by in GIVEN.items() for k, v in by.items() for x in (F.lit(sc + k), F.array(*map(F.lit, v))))), at)
    one = lambda i: F.element_at(known, _draw(seed, i, 1 << 30).cast("int") % F.size(known) + 1)
    return F.concat_ws("-", *(one(i) for i in range(attempt + 1)))


def surrogate(kind: Column, canon: Column, gender: Column, seed: Column, attempt: int) -> Column:
    """The canonical form of the surrogate that ``seed`` draws; from the fourth attempt on formats grow."""
    wider = max(0, attempt - 2)
    n = F.length(canon)
    body = F.concat(F.substring(canon, F.lit(1), F.lit(1)), F.substring(_digits(seed, n), F.lit(2), n - 2))
    check = F.when(_luhn(canon) == 0, F.pmod(F.lit(10) - _luhn(F.concat(body, F.lit("0"))), F.lit(10))).otherwise(F.pmod(F.lit(11) - _luhn(F.concat(body, F.lit("0"))), F.lit(10)))
    country = F.regexp_extract(canon, r"^\+(1|7|[2-9]\d)", 0)
    phone = F.concat(country, F.substring(_digits(seed, n + wider), F.lit(1), n - F.length(country) + wider))
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_draw(seed, i, 254) + 1).cast("string")), ".")
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    top = F.concat(F.lit("."), F.substring_index(domain, ".", -1))
    more = _same_kind(F.concat(seed, F.lit("+")), F.lit("a" * wider)) if wider else F.lit("")
    # one domain has one surrogate: its seed doesn't depend on the mailbox or the attempt
    email = F.concat(_same_kind(seed, local), more, F.lit("@"), _same_kind(F.concat(F.substring(F.col("secret"), F.lit(1), F.lit(64)), domain), F.substring(domain, F.lit(1), F.length(domain) - F.length(top))), top)
    iban_body = _same_kind(seed, F.substring(canon, F.lit(5), n - 4))
    spelled = F.array_join(F.transform(_chars(F.concat(iban_body, F.substring(canon, F.lit(1), F.lit(2)), F.lit("00"))), lambda c: F.when(c.rlike(r"\d"), c).otherwise((F.ascii(c) - 55).cast("string"))), "")
    mod97 = F.aggregate(_chars(spelled), F.lit(0), lambda a, c: F.pmod(a * 10 + c.cast("int"), F.lit(97)))
    iban = F.concat(F.substring(canon, F.lit(1), F.lit(2)), F.lpad((98 - mod97).cast("string"), 2, "0"), iban_body)
    return (
        F.when(kind == "CARD", F.concat(body, check.cast("string")))
        .when(kind == "PHONE", phone)
        .when(kind == "SSN", F.substring(_digits(seed, n + wider), F.lit(1), n + wider))
        .when(kind == "IP", octets)
        .when(kind == "EMAIL", email)
        .when(kind == "IBAN", iban)
        .when(kind == "TOKEN", F.when(canon.rlike("^[0-9a-f]+$"), _hex(seed, canon)).otherwise(F.concat(F.regexp_extract(canon, "^(AKIA|gh._|sk-)", 0), _same_kind(seed, F.regexp_replace(canon, "^(AKIA|gh._|sk-)", "")))))
        .when(kind == "GIVEN", _given(canon, gender, seed, attempt))
        .otherwise(F.initcap(_syllables(seed, canon, 4 + attempt)))
    )


def render(kind: Column, surface: Column, canon: Column) -> Column:
    """The surrogate in the written form of ``surface``: its digits take the places of the original's."""
    digits = F.regexp_replace(canon, r"\D", "")
    at = lambda i: F.length(F.regexp_replace(F.substring(surface, F.lit(1), i), r"\D", ""))
    by_digit = F.array_join(F.transform(_chars(surface), lambda c, i: F.when(c.rlike(r"^\d$"), F.substring(digits, at(i) + 1, F.lit(1))).otherwise(c)), "")
    longer = F.substring(digits, F.length(F.regexp_replace(surface, r"\D", "")) + 1, F.length(digits))  # of a format that grew
    spaces = lambda i: F.length(F.regexp_replace(F.substring(surface, F.lit(1), i), " ", ""))
    by_char = F.array_join(F.transform(_chars(surface), lambda c, i: F.when(c == " ", c).otherwise(F.substring(canon, spaces(i) + 1, F.lit(1)))), "")
    shout = kind.isin("EMAIL", "GIVEN", "FAMILY") & (F.length(surface) > 1) & (surface == F.upper(surface)) & (surface != F.lower(surface))
    return F.when(kind.isin("CARD", "PHONE", "SSN"), F.concat(by_digit, longer)).when(kind == "IBAN", by_char).when(shout, F.upper(canon)).otherwise(canon)


def _next_letter(letter: Column, secret: str) -> Column:
    """An initial's surrogate: the next letter of its alphabet in a keyed circular order.

    So no two initials share one and none stays; letters beyond these alphabets stay as they are.
    """
    out = letter
    for alphabet in INITIALS:
        drawn = F.transform(F.array(*map(F.lit, alphabet)), lambda c: F.struct(F.xxhash64(F.lit(secret), c).alias("at"), c.alias("c")))
        circle = F.transform(F.array_sort(drawn), lambda x: x["c"])
        out = F.when(letter.isin(list(alphabet)), F.element_at(circle, F.pmod(F.array_position(circle, letter), F.lit(len(alphabet))).cast("int") + 1)).otherwise(out)
    return out


def name_parts(surface: Column) -> Column:
    """A name's parts (place, part, kind): initials and particles stay what they are, the last other part is the family name."""
    words = F.filter(F.split(F.regexp_replace(surface, r"(\p{Lu}\.)(?=[^ ])", "$1 "), "[ ]+"), lambda w: w != "")
    kind = lambda w: F.when(w.rlike(r"^\p{Lu}\.-?$"), "INITIAL").when(w.isin(PARTICLES), "PARTICLE").otherwise("GIVEN")
    parts = F.transform(words, lambda w: F.struct(w.alias("part"), kind(w).alias("kind")))

    def told(p: Column) -> Column:
        last = F.size(p) - F.array_position(F.reverse(F.transform(p, lambda x: x["kind"])), "GIVEN").cast("int")
        return let(last, lambda n: F.transform(p, lambda x, i: F.struct(x["part"].alias("part"), F.when((i == n) & (x["kind"] == "GIVEN"), "FAMILY").otherwise(x["kind"]).alias("kind"))))

    return let(parts, told)


def drawn_apart(entities: DataFrame, secret: str, ws: Workspace, most_attempts: int = 40) -> DataFrame:
    """kind, canon, gender, made for distinct (kind, canon, gender): no two share a surrogate, none is an entity."""
    key = ["kind", "canon", "gender"]
    open_ = ws.save(entities.withColumn("secret", F.sha2(F.lit(secret), 256)), "open0", narrow=True)
    real = open_.select("kind", F.col("canon").alias("low")).distinct()
    settled: DataFrame | None = None
    for attempt in range(most_attempts):
        seed = F.sha2(F.concat_ws("\u0001", "secret", "kind", "canon", "gender", F.lit(str(attempt))), 256)
        drawn = open_.withColumn("seed", seed).withColumn("made", surrogate(F.col("kind"), F.col("canon"), F.col("gender"), F.col("seed"), attempt))
        drawn = ws.save(drawn.select(*key, "secret", "made", F.lower("made").alias("low")), f"drawn{attempt}", narrow=True)
        # the check: of a shared surrogate one entity keeps it; an entity's own text or an earlier surrogate frees it
        keeper = drawn.groupBy("kind", "low").agg(F.min(F.struct("canon", "gender")).alias("who")).select("kind", "low", "who.canon", "who.gender")
        taken = real if settled is None else real.union(settled.select("kind", "low"))
        clear = drawn.join(keeper, [*key, "low"], "left_semi").join(taken, ["kind", "low"], "left_anti")
        clear = ws.save(clear, f"clear{attempt}", narrow=True)
        settled = clear if settled is None else settled.union(clear)
        open_ = ws.save(drawn.join(clear.select(*key), key, "left_anti").select(*key, "secret"), f"open{attempt + 1}", narrow=True)
        if open_.isEmpty():
            return settled.select(*key, "made")
    raise ValueError("a format that can't grow has no surrogates left")


def surrogates(surfaces: DataFrame, secret: str, ws: Workspace) -> DataFrame:
    """surface, replacement, kind for distinct (surface, gender); a name is put together from its parts."""
    typed = ws.save(surfaces.withColumn("kind", entity_type(F.col("surface"))), "typed", narrow=True)
    plain = typed.where("kind <> 'PERSON'").select("surface", "kind", canonical(F.col("kind"), F.col("surface")).alias("canon"), F.lit("x").alias("gender"))
    people = typed.where("kind = 'PERSON'").groupBy("surface").agg(F.min("gender").alias("gender"))
    parts = people.select("surface", "gender", F.posexplode(name_parts(F.col("surface"))).alias("place", "p")).select("surface", "gender", "place", "p.part", "p.kind").withColumn("canon", F.lower("part"))
    # a given name's gender: what its own title tells, else other titles of the corpus, else the known names
    told = parts.where("kind = 'GIVEN' AND gender <> 'x'").groupBy("canon").agg(F.min("gender").alias("told"))
    gender = F.when(F.col("kind") != "GIVEN", "x").when(F.col("gender") != "x", F.col("gender")).otherwise(F.coalesce("told", F.try_element_at(_genders(), F.col("canon")), F.lit("x")))
    parts = ws.save(parts.join(told, "canon", "left").withColumn("gender", gender).drop("told"), "parts", narrow=True)
    key = ["kind", "canon", "gender"]
    entities = plain.select(*key).union(parts.where("kind IN ('GIVEN', 'FAMILY')").select(*key)).distinct()
    made = ws.save(drawn_apart(entities, secret, ws), "made", narrow=True)
    plain = plain.join(made, key).select("surface", render(F.col("kind"), F.col("surface"), F.col("made")).alias("replacement"), "kind")
    initial = F.concat(_next_letter(F.substring("part", 1, 1), secret), F.lit("."))
    part = F.when(F.col("kind") == "INITIAL", initial).when(F.col("kind") == "PARTICLE", F.col("part")).otherwise(render(F.col("kind"), F.col("part"), F.col("made")))
    names = parts.join(made, key, "left").groupBy("surface").agg(F.array_sort(F.collect_list(F.struct("place", part.alias("text")))).alias("parts"))
    return plain.union(names.select("surface", F.array_join(F.transform("parts", lambda p: p["text"]), " "), F.lit("PERSON")))


def _known(name: Column) -> Column:
    """A name as a pattern, where it stands alone."""
    return F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), name, F.lit(r"\E(?![\p{L}\p{N}])"))


def replace_pii(docs: DataFrame, id_col: str, text_col: str, secret: str) -> DataFrame:
    """The documents with every entity in ``text_col`` replaced, and n_entities (mentions) beside their columns."""
    ws = Workspace(docs.sparkSession, "pii")
    row = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"))
    d = docs.select(row.alias("row"), F.col(text_col).alias("text"))
    found = F.regexp_extract_all("text", F.lit(ANY), F.lit(0))
    mentions = d.where(F.col("text").rlike(HINT)).select("row", "text", F.array_distinct(found).alias("found")).where(F.size("found") > 0)
    # a name's title tells its gender
    title = lambda x: F.regexp_replace(F.substring_index(x, " ", 1), r"\.$", "")
    told = F.create_map(*(F.lit(y) for t, g in {**TITLES, **{t.upper(): g for t, g in TITLES.items()}}.items() for y in (t, g)))
    people = F.transform(F.regexp_extract_all("text", F.lit(TITLED), F.lit(1)), lambda x: F.struct(F.regexp_replace(x, r"^[^ ]+ ", "").alias("surface"), F.element_at(told, title(x)).alias("gender")))
    others = F.transform("found", lambda x: F.struct(x.alias("surface"), F.lit("x").alias("gender")))
    each = ws.save(mentions.select("row", F.explode_outer(F.array_distinct(F.concat(others, people))).alias("m")).select("row", "m.surface", "m.gender").where("surface is not null").distinct(), "mentions", narrow=True)
    table = ws.save(surrogates(each.select("surface", "gender").distinct(), secret, ws), "surrogates", narrow=True)
    swaps = each.select("row", "surface").distinct().join(F.broadcast(table) if bounded(table) else table, "surface")
    # full names that are known from a title are replaced without one, too, the longest first
    full = F.array_sort(F.collect_list(F.when((F.col("kind") == "PERSON") & F.contains("surface", F.lit(" ")), F.struct((-F.length("surface")).alias("n"), "surface", "replacement"))))
    per_row = swaps.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("surface", "replacement"))).alias("__swap"), full.alias("__names"))
    per_row = ws.save(per_row.withColumnRenamed("row", "__row"), "swaps")
    cols = [c for c in docs.columns if c != "n_entities"]
    met = by_row_id(docs.select(*cols, row.alias("__row")), per_row, "__row")
    parts, found = F.split(text_col, ANY, -1), F.regexp_extract_all(text_col, F.lit(ANY), F.lit(0))
    untitled = lambda p: F.aggregate("__names", p, lambda t, x: F.regexp_replace(t, _known(x["surface"]), x["replacement"]))
    counted = lambda p: F.size(F.flatten(F.transform("__names", lambda x: F.regexp_extract_all(p, _known(x["surface"]), F.lit(0)))))
    pieces = F.zip_with(parts, found, lambda p, s: F.struct(untitled(p).alias("part"), F.coalesce(F.try_element_at("__swap", s), s, F.lit("")).alias("made"), (counted(p) + F.when(s.isNull(), 0).otherwise(1)).alias("n")))
    whole = met.select(*cols, F.when(F.col("__swap").isNotNull(), pieces).alias("__pieces"))
    woven = F.array_join(F.transform("__pieces", lambda x: F.concat(x["part"], x["made"])), "")
    n = F.aggregate("__pieces", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    return whole.select(*(F.coalesce(woven, F.col(c)).alias(c) if c == text_col else F.col(c) for c in cols), F.coalesce(n, F.lit(0)).alias("n_entities"))
