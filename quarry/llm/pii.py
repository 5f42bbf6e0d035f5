"""Operator 4: surrogates for personal data, with native functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, free_name, scratch, settle

# Titles and given names by gender, in the scripts that are told apart.
TITLES = {
    "m": ["Mr", "Herr", "Monsieur", "Señor", "господин"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "госпожа"],
    "n": ["Dr", "Prof"],
}
GIVEN = {
    ("m", "latin"): ["James", "John", "Robert", "Michael", "William", "David", "Richard", "Thomas", "Charles", "Daniel", "Matthew", "Peter", "Hans", "Klaus", "Jürgen", "Stefan", "Pierre", "François", "Michel", "Carlos", "José", "Miguel"],
    ("f", "latin"): ["Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Karen", "Emily", "Laura", "Ursula", "Monika", "Sabine", "Claire", "Sophie", "Camille", "María", "Carmen", "Lucía", "Isabel"],
    ("m", "cyrillic"): ["Иван", "Алексей", "Дмитрий", "Сергей", "Николай", "Михаил"],
    ("f", "cyrillic"): ["Анна", "Мария", "Елена", "Ольга", "Наталья", "Татьяна"],
}
SYLLABLES = {"latin": "ba be bo da de do fa fe ga go ha ka ke la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve".split(), "cyrillic": "ба бе бо ва ве го да де до жа за ка ке ко ла ле ло ма ми мо на ни но па пе ро са се со та те то ха ша".split()}

_ANY = "[\\p{L}\\p{N}]"
_OCTET = "(?:25[0-5]|2[0-4]\\d|1?\\d?\\d)"
_HEX4 = "[0-9A-Fa-f]{1,4}"
#: A capitalised word, perhaps of several parts (O'Neil, Anna-Maria).
_NAME = "\\p{Lu}(?:\\p{L}++|['’]\\p{Lu}\\p{L}++)(?:['’-]\\p{Lu}\\p{L}++){0,3}"


def _listed(words: list[str]) -> str:
    """A pattern of words as they are or in upper case."""
    return "(?:" + "|".join(dict.fromkeys(x for w in words for x in (w, w.upper()))) + ")"


_TITLE = _listed([t for g in TITLES.values() for t in g])
_GIVEN = _listed([n for g in GIVEN.values() for n in g])
#: What stands before a name or a credential and says so.
_NAMED = "(?<=(?:[Nn]ame|NAME|[Cc]ontact|[Aa]uthor|[Ss]igned|[Pp]atient|[Cc]ustomer): |[Nn]ame is |[Ss]incerely, |[Rr]egards, |[Ss]igned by )"
_KEYED = "(?<=(?:password|passwd|token|secret|api_key|apikey)(?: ?[=:] ?)[\"']?)"
#: kind -> pattern; earlier kinds win where two begin at one place. Nothing recurses without
#: bound in Java's matcher: repeated groups have an upper limit, other repeats are of one class.
PATTERNS = {
    "email": "(?<![\\p{L}\\p{N}._%+-])[\\p{L}\\p{N}][\\p{L}\\p{N}._%+-]*+@[\\p{L}\\p{N}-]++(?:\\.[\\p{L}\\p{N}-]{1,63}){0,125}\\.\\p{L}{2,63}",
    "ip": f"(?<![\\p{{N}}.])(?:{_OCTET}\\.){{3}}{_OCTET}(?!\\p{{N}}|\\.\\p{{N}})",
    "ipv6": f"(?<![\\p{{L}}\\p{{N}}:.])(?:(?:{_HEX4}:){{7}}{_HEX4}|(?:{_HEX4}:){{1,6}}(?::{_HEX4}){{1,6}})(?![\\p{{L}}\\p{{N}}:])",
    "ssn": "(?<![\\p{N}-])\\d{3}-\\d{2}-\\d{4}(?![\\p{N}-])",
    "iban": f"(?<!{_ANY})[A-Z]{{2}}\\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?(?!{_ANY})",
    "card": f"(?<!{_ANY})\\d{{4}}(?:[ -]\\d{{4}}){{3}}(?!{_ANY})|(?<!{_ANY})\\d{{13,19}}(?!{_ANY})",
    "phone": "(?<![\\p{L}\\p{N}+])\\+\\d{1,3}[ .-]?(?:\\(\\d{1,4}\\)|\\d{1,4})(?:[ .-]?\\d{2,4}){2,4}(?!\\d)|(?<!\\d)\\(\\d{3}\\) ?\\d{3}[ .-]\\d{4}(?!\\d)|(?<![\\d.-])\\d{3}[.-]\\d{3}[.-]\\d{4}(?![\\d-])|(?<![\\p{L}\\p{N}.-])0\\d{2,4}[ -]\\d{3,4}[ -]\\d{3,4}(?![\\d-])",
    "secret": f"(?<!{_ANY})(?=[a-fA-F]*+\\d)(?:[0-9a-f]{{32,128}}|[0-9A-F]{{32,128}})(?!{_ANY})",
    "credential": f"{_KEYED}[A-Za-z0-9+/_=-]{{8,256}}",
    "person": f"(?<!{_ANY}){_TITLE}\\.? (?:{_NAME} )?{_NAME}(?!\\p{{L}})|(?<!{_ANY}){_GIVEN}(?:-{_NAME})? {_NAME}(?!\\p{{L}})|{_NAMED}{_NAME} {_NAME}(?!\\p{{L}})",
}
#: A cheap look at the next character before a pattern is tried.
_FIRST = {"email": "", "ip": "(?=\\d)", "ipv6": "(?=[\\da-fA-F])", "ssn": "(?=\\d)", "iban": "(?=[A-Z])", "card": "(?=\\d)", "phone": "(?=[\\d+(])", "secret": "(?=[\\da-fA-F])", "credential": "(?=[A-Za-z0-9+/_=-])", "person": "(?=[\\p{Lu}г])"}
DETECT = "|".join(f"(?:{_FIRST[k]}(?:{p}))" for k, p in PATTERNS.items())
#: Entities of documents that are broadcast (about 100 bytes each); more are joined by a shuffle.
MAP_ENTRIES = 200_000
#: Attempts at a surrogate that nothing else has.
ATTEMPTS = 40


def kind_of(m: Column) -> Column:
    """The kind of a match, by its own form: a credential is what has no space and is nothing else."""
    out = F.when(m.contains(" "), "person").otherwise("credential")
    for kind, p in reversed(list(PATTERNS.items())[:-2]):
        out = F.when(m.rlike(f"^(?:{p})$"), kind).otherwise(out)
    return out


def script_of(word: Column) -> Column:
    return F.when(word.rlike("\\p{IsCyrillic}"), "cyrillic").otherwise("latin")


def gender_of(m: Column) -> Column:
    """From the title, else from the given name; n where neither says."""
    out = F.lit("n")
    for g in ("m", "f"):
        names = "|".join(n for (gender, _), v in GIVEN.items() if gender == g for n in v)
        out = F.when(F.initcap(m).rlike(f"(?:^| )(?:{names})[ -]"), g).otherwise(out)
    for g in ("m", "f"):
        out = F.when(m.rlike(f"^{_listed(TITLES[g])}\\.? "), g).otherwise(out)
    return out


def name_parts(m: Column) -> Column:
    """A person's words after the title, and what stands between them: array of (kind, value, text).

    Names of several parts (Anna-Maria, O'Neil) are cut at apostrophes and hyphens; single
    letters and separators have no kind. Values are capitalised, so that JOHN SMITH is John Smith.
    """
    gender = gender_of(m)
    rest = F.regexp_replace(m, f"^{_TITLE}\\.? ", "")
    pieces = F.regexp_extract_all(rest, F.lit("[^ '’-]+|[ '’-]"), F.lit(0))
    last = F.size(F.split(F.substring_index(rest, " ", -1), "(?<=['’-])|(?=['’-])"))

    def part(text: Column, i: Column) -> Column:
        surname = i >= F.size(pieces) - last
        kind = F.when(F.length(text) > 1, F.when(surname, F.concat(F.lit("surname-"), script_of(text))).otherwise(F.concat(F.lit("given-"), gender, F.lit("-"), script_of(text))))
        return F.struct(kind.alias("kind"), F.initcap(F.lower(text)).alias("value"), text.alias("text"))

    return F.transform(pieces, part)


def parts_of(m: Column) -> Column:
    """The entities of a match: array of (kind, value). Each part of a person's name is an entity of its own, so that later mentions of it agree."""
    kind = kind_of(m)
    person = F.transform(F.filter(name_parts(m), lambda p: p.kind.isNotNull()), lambda p: F.struct(p.kind.alias("kind"), p.value.alias("value")))
    value = F.when(kind.isin("email", "secret", "ipv6"), F.lower(m)).when(kind.isin("phone", "card", "ssn"), F.regexp_replace(m, "\\D", "")).when(kind == "iban", F.replace(m, F.lit(" "), F.lit(""))).otherwise(m)
    return F.when(kind == "person", person).otherwise(F.array(F.struct(kind.alias("kind"), value.alias("value"))))


def _random(seed: Column, key: str) -> Column:
    """256 hex digits keyed by key and seed."""
    return F.concat(*[F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(str(j)), seed), 256) for j in range(4)])


def _byte(random: Column, at: Column) -> Column:
    return F.conv(F.substring(random, at % 127 * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _shaped(value: Column, random: Column) -> Column:
    """value with each letter and digit replaced by one of its kind; the rest stays."""
    alphabet = {"[0-9]": "0123456789", "\\p{IsCyrillic}": "абвгдежзиклмнопрстуфхцчшэюя", "\\p{IsGreek}": "αβγδεζηθικλμνξοπρστυφχψω", "\\p{L}": "abcdefghijklmnopqrstuvwxyz"}

    def char(c: Column, i: Column) -> Column:
        out = c
        for pattern, letters in reversed(alphabet.items()):
            pick = F.substring(F.lit(letters), _byte(random, i) % len(letters) + 1, F.lit(1))
            out = F.when(c.rlike(pattern), pick).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(value, ""), char), "")


def _like(text: Column, m: Column) -> Column:
    """text, of m's length, with capitals where m has them."""
    return F.array_join(F.zip_with(F.split(text, ""), F.split(m, ""), lambda x, c: F.when((c == F.upper(c)) & (c != F.lower(c)), F.upper(x)).otherwise(x)), "")


def _hexed(value: Column, random: Column) -> Column:
    """value with each hex digit replaced by another."""
    char = lambda c, i: F.when(c.rlike("[0-9a-f]"), F.substring(random, i % 250 + 1, F.lit(1))).otherwise(c)
    return F.array_join(F.transform(F.split(value, ""), char), "")


def _mod97(text: Column) -> Column:
    """The number that a string of digits and capital letters (A is 10) stands for, modulo 97."""
    letter = lambda c: F.ascii(c) - 55
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: F.when(c == "", a).when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + letter(c)) % 97))


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, the last one not doubled."""
    d = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(d, F.lit(0), lambda a, x: a + x)


def _syllable(random: Column, syllables: list[str]):
    """The function of a place that picks a syllable."""
    table = F.array(*[F.lit(x) for x in syllables])
    return lambda i: F.element_at(table, _byte(random, i) % len(syllables) + 1)


def surrogate(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """The keyed replacement of an entity, of its kind and form."""
    r = _random(F.concat_ws("\x1f", kind, value, attempt.cast("string")), key)
    domain = F.substring_index(value, "@", -1)
    host = F.call_function("substring_index", domain, F.lit("."), F.size(F.split(domain, "\\.")) - 1)
    email = F.concat(_shaped(F.substring_index(value, "@", 1), r), F.lit("@"), _shaped(host, _random(F.concat_ws("\x1f", F.lit("domain"), host), key)), F.lit("."), F.substring_index(domain, ".", -1))
    n = F.length(value)
    # a phone keeps its country code and a 555 exchange
    area = _shaped(F.substring(value, n - 9, F.lit(3)), r)
    exchange = F.when(F.substring(value, n - 6, F.lit(3)) == "555", "555").otherwise(_shaped(F.substring(value, n - 6, F.lit(3)), F.substring(r, 9, 240)))
    line = _shaped(F.substring(value, n - 3, F.lit(4)), F.substring(r, 17, 240))
    phone = F.when(n >= 10, F.concat(F.substring(value, F.lit(1), n - 10), area, exchange, line)).otherwise(_shaped(value, r))
    # a card keeps its first digit, and passes the Luhn check if it did
    body = F.concat(F.substring(value, 1, 1), _shaped(F.substring(value, F.lit(2), n - 2), r))
    closing = ((10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10).cast("string")
    card = F.concat(body, F.when(_luhn(value) % 10 == 0, closing).otherwise(_shaped(F.substring(value, n, F.lit(1)), F.substring(r, 101, 100))))
    ip = F.concat_ws(".", *[(_byte(r, F.lit(i)) % 254 + 1).cast("string") for i in range(4)])
    hexes = F.substring(r, F.lit(1), n)
    # an account number keeps its country, and passes its check if it did
    country, account = F.substring(value, 1, 2), F.upper(_shaped(F.substring(value, F.lit(5), n), r))
    check = F.lpad((98 - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
    valid = _mod97(F.concat(F.substring(value, F.lit(5), n), F.substring(value, 1, 4))) == 1
    iban = F.concat(country, F.when(valid, check).otherwise(_shaped(F.substring(value, 3, 2), F.substring(r, 201, 50))), account)
    out = F.when(kind == "email", email).when(kind == "ipv6", _hexed(value, r)).when(kind == "iban", iban).when(kind == "credential", _like(_shaped(value, r), value)).when(kind == "phone", phone).when(kind == "card", card).when(kind == "ip", ip).when(kind == "secret", hexes)
    made = {}
    for script, s in SYLLABLES.items():
        made[script] = F.array_join(F.transform(F.sequence(F.lit(0), 2 + F.floor(attempt / 4).cast("int")), _syllable(r, s)), "")
        female = F.when(value.rlike("[ая]$"), "ова").otherwise("ов") if script == "cyrillic" else F.lit("")
        out = out.when(kind == f"surname-{script}", F.initcap(F.concat(made[script], female)))
        for g in ("m", "f", "n"):
            pool = GIVEN.get((g, script), [])
            ending = {"m": {"latin": "n", "cyrillic": "н"}, "f": {"latin": "na", "cyrillic": "на"}, "n": {"latin": "l", "cyrillic": "л"}}[g][script]
            fresh = F.initcap(F.concat(made[script], F.lit(ending)))
            name = F.when(attempt < 4, F.element_at(F.array(*[F.lit(x) for x in pool]), _byte(r, F.lit(9)) % len(pool) + 1)).otherwise(fresh) if pool else fresh
            out = out.when(kind == f"given-{g}-{script}", name)
    return out.otherwise(_shaped(value, r))


def surrogate_table(entities: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate) of distinct entities(kind, value): no two of a kind share a surrogate, and none is an entity itself.

    Collisions are found by grouping and tried again with the next attempt; the smallest value keeps its own.
    """
    known = settle(entities.distinct(), "entities")
    done = None
    open_ = known.withColumn("attempt", F.lit(0))
    for attempt in range(ATTEMPTS):
        tried = settle(open_.withColumn("surrogate", surrogate(F.col("kind"), F.col("value"), F.lit(attempt), key)), "tried")
        taken = known.select("kind", F.col("value").alias("surrogate"))
        if done is not None:
            taken = taken.union(done.select("kind", "surrogate"))
        free = tried.join(taken.distinct(), ["kind", "surrogate"], "left_anti")
        good = free.groupBy("kind", "surrogate").agg(F.min("value").alias("value")).select("kind", "value", "surrogate")
        before, done = done, settle(good if done is None else done.unionByName(good), "done")
        discard(tried, *[before] if before is not None else ())
        open_ = known.join(done, ["kind", "value"], "left_anti")
        if not open_.limit(1).count():
            return done
    raise RuntimeError("entities without a free surrogate remain; raise ATTEMPTS")


def _refill(m: Column, made: Column, pattern: str) -> Column:
    """m with its characters of a pattern replaced by those of made, in order."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))
    step = lambda a, c: F.when(c.rlike(pattern), F.struct(F.concat(a.out, F.substring(made, a.k, F.lit(1))).alias("out"), (a.k + 1).alias("k"))).otherwise(F.struct(F.concat(a.out, c).alias("out"), a.k.alias("k")))
    return F.aggregate(F.split(m, ""), start, step, lambda a: a.out)


def _replaced(m: Column, table: Column) -> Column:
    """A match rewritten with the surrogates of its parts; table: map from 'kind:value'."""
    of = lambda p: F.element_at(table, F.concat_ws(":", p.kind, p.value))
    first = of(F.element_at(parts_of(m), 1))
    kind = kind_of(m)
    title = F.regexp_extract(m, f"^({_TITLE}\\.? )", 1)
    named = F.transform(name_parts(m), lambda p: F.when(p.kind.isNull(), p.text).when(p.text == F.upper(p.text), F.upper(of(p))).otherwise(of(p)))
    out = F.when(kind == "person", F.concat(title, F.array_join(named, ""))).when(kind.isin("email", "secret", "ipv6"), _like(first, m))
    return out.when(kind.isin("phone", "card", "ssn"), _refill(m, first, "[0-9]")).when(kind == "iban", _refill(m, first, "[0-9A-Z]")).otherwise(first)


def with_surrogates(docs: DataFrame, key: str, key_col: str = "doc_id", text_col: str = "text", count_col: str = "n_entities") -> DataFrame:
    """docs with each detected entity of text_col replaced, and the number replaced in count_col (which takes the place of a column of that name).

    Kinds: email, IPv4 and IPv6 addresses, social security, account (IBAN), card and phone
    numbers, hex secrets, credentials (after password=, token: and the like), and persons (a
    title, a listed given name, or a cue such as 'name is' before capitalised names). An entity
    has one surrogate in the whole table, whatever its letter case or separators; two entities
    of a kind have different ones. Surrogates keep kind, length, separators and the place of
    capitals, a name its gender, script and parts. Text outside matches is not touched.

    Null stays null, with 0 entities; texts of any length are read whole; rows may repeat a key;
    rows without a key are told apart by their text, so they are spread over all tasks. Other
    columns pass through, whatever their names. No rows: no rows.
    """
    key_text = F.coalesce(F.col(key_col).cast("string"), F.concat(F.lit("text "), F.sha2(F.coalesce(text_col, F.lit("")), 256)))
    rowkey, held, matches = (free_name(n, docs) for n in ("__key", "__map", "__found"))
    found = F.regexp_extract_all(text_col, F.lit(DETECT), F.lit(0))
    with scratch():
        # one pass finds the entities; the second only reads documents that have some
        marked = docs.select(key_text.alias("key"), F.array_distinct(found).alias("found")).where("size(found) > 0")
        seen = marked.select("key", F.explode("found").alias("m")).select("key", F.explode(parts_of(F.col("m"))).alias("e")).select("key", "e.kind", "e.value")
        seen = settle(seen.distinct(), "seen")
        table = surrogate_table(seen.select("kind", "value"), key)
        named = seen.join(table, ["kind", "value"]).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "kind", "value"), "surrogate"))).alias("map"))
        named = settle(named, "named", keep=True)
    size = named.agg(F.sum(F.size("map"))).first()[0] or 0
    named = named.select(F.col("key").alias(rowkey), F.col("map").alias(held))
    rows = docs.join(F.broadcast(named) if size <= MAP_ENTRIES else named, key_text == F.col(rowkey), "left")
    rows = rows.withColumn(matches, F.when(F.col(held).isNotNull(), found))
    pieces = F.split(F.col(text_col), DETECT, -1)
    new = F.transform(matches, lambda m: _replaced(m, F.col(held)))
    text = F.array_join(F.zip_with(pieces, new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    text = F.when(F.col(matches).isNotNull(), text).otherwise(F.col(text_col))
    keep = [c for c in docs.columns if c.lower() != count_col.lower()]
    return rows.select(*[text.alias(c) if c == text_col else F.col(c) for c in keep], F.coalesce(F.size(matches), F.lit(0)).cast("long").alias(count_col))


def pseudonymise(docs: DataFrame, key: str = "surrogates-1") -> DataFrame:
    """Per document: doc_id, text with surrogates, n_entities (see with_surrogates)."""
    return with_surrogates(docs.select("doc_id", "text"), key)
