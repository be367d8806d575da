"""PII surrogates in DataFrame functions alone.

One pattern finds e-mail addresses, IPv4 addresses, telephone, card and social
security numbers, IBANs, access keys, secrets behind ``token =`` and the like,
long hexadecimal strings and names behind a title.  A number of 13 to 19 digits
counts as a card if its check digit holds, or if the text calls a number a card
(then mistyped ones count too).  In a text with a titled name,
every later or earlier word that equals a part of that name is the name too, so
"Mrs Anna Schmidt", "Mrs Schmidt", "Anna Schmidt" and "Schmidt" stay one person.

Every distinct entity gets a keyed surrogate of its own type and format: digits
stay digits, letters keep case and script, hexadecimal stays hexadecimal,
addresses stay valid, card numbers keep their first digit and a valid check
digit.  A name is replaced by its parts: a surname has one surrogate in all
texts, a given name one for each gender.  The gender comes from the title; a
title without one ("Dr") takes that of the same full name elsewhere.

Surrogates depend on key and entity alone, so one entity has one surrogate in
all texts.  A check over all distinct entities gives those whose surrogate is
an entity of the input or is taken, another attempt.  Names grow by a syllable
with each attempt, and from the third attempt on all but card numbers, IP
addresses, access keys and IBANs (whose formats have 10**9 values and more) by a
letter or digit, so a type can't run out; after ``ATTEMPTS`` rounds it's an error.

Null texts stay null and have no entities; an empty table gives an empty
result; rows that repeat are each rewritten alike.  Further columns, whatever
their names, are kept by :func:`rewrite` and don't matter to
:func:`surrogate_texts`.  No alternative of the pattern backtracks over a run
of unbounded length or starts anew within one, so a text of many megabytes takes
time in proportion to its length and no more stack than a short one.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread_join, staged

#: Rounds of the collision check before it gives up.
ATTEMPTS = 40
#: The setting that holds the secret of the surrogates, and what stands in for it in tests.
KEY_SETTING = "spark.linewright.surrogates.key"
TEST_KEY = "not secret: for tests alone"

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_TITLES = {
    "male": ["Mr", "Sir", "Herr", "Monsieur", "Señor"],
    "female": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita"],
    "any": ["Dr", "Prof"],
}
_TITLE = "(?:(?:" + "|".join(sorted((t for x in _TITLES.values() for t in x), key=len, reverse=True)) + r")\.? ){1,3}"
_NAME = r"\p{Lu}\p{L}*+(?:-\p{L}++|[’'](?!s(?!\p{L}))\p{L}++)*+"
_LONG_NAME = rf"(?=\p{{Lu}}[\p{{L}}’'-]){_NAME}"
#: The alternatives in order of preference.
PATTERNS = {
    "email": r"(?<![.%-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++",
    "ip": rf"(?<!\d\.){_OCTET}(?:\.{_OCTET}){{3}}(?![\p{{N}}]|\.\p{{N}})",
    "ssn": r"\d{3}-\d{2}-\d{4}(?![\p{N}-])",
    "card": r"(?:\d{13,19}|(?:\d{4} ){3}\d{1,7}|(?:\d{4}-){3}\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\p{L}\p{N}])",
    "phone": r"(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]?\d{3,4}|\+\d{1,3}[ .-]?\d{1,2}(?:[ .-]?\d{2}){4}|\+\d{7,15}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\p{N})",
    "key": r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![\p{L}\p{N}])",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "secret": r"(?i:token|password|passwd|secret|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?(?=[_/+-]*+[A-Za-z0-9])[A-Za-z0-9_/+-]{8,}+",
    "hex": r"[0-9a-fA-F]{32,}+(?![\p{L}\p{N}])",
    "name": rf"{_TITLE}{_LONG_NAME}(?: {_LONG_NAME})?",
}
_REST = "|".join(p for kind, p in PATTERNS.items() if kind != "email")
PATTERN = rf"(?<![\p{{L}}\p{{N}}_+])(?:{PATTERNS['email']}|(?<!@)(?:{_REST}))"
#: In a text with a titled name, words with a capital may be parts of it.
PATTERN_NAMED = rf"{PATTERN}|(?<![\p{{L}}\p{{N}}]){_NAME}"
#: A text that calls a number a card.
CARD_SAID = r"(?i)(?<!\p{L})(?:card|karte|kreditkarte|carte|tarjeta)(?: (?:no|number|nr)\.?)?[ :]{1,3}\d{4}[ -]?\d{4,}"
_SECRET = r"^((?i:token|password|passwd|secret|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?)"

#: Given names by script and gender; any gender draws from both.
GIVEN = {
    ("latin", "male"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karim", "Louis", "Martin", "Noah", "Oscar", "Paul"],
    ("latin", "female"): ["Alice", "Bella", "Clara", "Diana", "Elena", "Flora", "Greta", "Helen", "Irene", "Julia", "Karin", "Laura", "Maria", "Nadia", "Olivia", "Paula"],
    ("cyrillic", "male"): ["Андрей", "Борис", "Виктор", "Григорий", "Иван", "Олег", "Павел", "Сергей"],
    ("cyrillic", "female"): ["Анна", "Вера", "Галина", "Елена", "Ирина", "Мария", "Ольга", "Светлана"],
    ("greek", "male"): ["Αλέξης", "Γιώργος", "Νίκος", "Πέτρος"],
    ("greek", "female"): ["Άννα", "Ελένη", "Μαρία", "Σοφία"],
}
#: Syllables that surnames are built from, by script.
SYLLABLES = {
    "latin": ["ba", "den", "kor", "lin", "mar", "nes", "ol", "per", "ran", "sel", "tor", "vik", "wen", "zan", "fal", "gro"],
    "cyrillic": ["ба", "ден", "кор", "лин", "мар", "нес", "ол", "пер", "ран", "сел", "тор", "вик", "вен", "зан", "фал", "гро"],
    "greek": ["βα", "δεν", "κορ", "λιν", "μαρ", "νεσ", "ολ", "περ", "ραν", "σελ", "τορ", "βικ", "φεν", "ζαν", "φαλ", "γρο"],
}

#: Ranges of code points and what stands for a letter or digit from them; other letters become Latin ones.
ALPHABETS = [
    (0xC0, 0x24F, "éèàùâêîôûäöüñç"),
    (0x1E00, 0x1EFF, "éèàùâêîôûäöüñç"),
    (0x370, 0x3FF, "αβγδεζηθικλμνξοπρστυφχψω"),
    (0x1F00, 0x1FFF, "αβγδεζηθικλμνξοπρστυφχψω"),
    (0x400, 0x52F, "абвгдежзиклмнопрстуфхцчшэюя"),
    (0x530, 0x58F, "աբգդեզէթժիլխծկհձղճմյնշոչպջռսվտրցփքօֆ"),
    (0x590, 0x5FF, "אבגדהוזחטיכלמנסעפצקרשת"),
    (0x660, 0x669, "٠١٢٣٤٥٦٧٨٩"),
    (0x6F0, 0x6F9, "۰۱۲۳۴۵۶۷۸۹"),
    (0x600, 0x77F, "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"),
    (0x966, 0x96F, "०१२३४५६७८९"),
    (0x900, 0x97F, "अआइईउऊएऐओऔकखगघचछजझटठडढणतथदधनपफबभमयरलवशषसह"),
    (0x980, 0x9FF, "অআইঈউঊএঐওঔকখগঘচছজঝটঠডঢণতথদধনপফবভমযরলশষসহ"),
    (0xB80, 0xBFF, "அஆஇஈஉஊஎஏஐஒஓகஙசஞடணதநபமயரலவழளறன"),
    (0xE00, 0xE7F, "กขคงจฉชซญฐณดตถทธนบปผฝพฟภมยรลวศษสหอฮ"),
    (0x10A0, 0x10FF, "აბგდევზთიკლმნოპჟრსტუფქღყშჩცძწჭხჯჰ"),
    (0x3040, 0x309F, "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわ"),
    (0x30A0, 0x30FF, "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワ"),
    (0x3400, 0x9FFF, "一丁七三上下中丹主之九也于云五井亦交人仁今介代以仲任伊休众会佳来依光先全公六兰共兴冬冰初利力加北千南卡双口古可同名向和周回因国土圣地坚城夏大天太夫"),
    (0xAC00, 0xD7A3, "가나다라마바사아자차카타파하고노도로모보소오조초코토포호구누두루무부수우주추쿠투푸후기니디리미비시이지치키티피히"),
]


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it's used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def secret_key(spark: SparkSession) -> str:
    """The key of the session's setting; without it, that of tests, with a warning."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        warnings.warn(f"{KEY_SETTING} is not set: surrogates use a public key, which is for tests alone", stacklevel=2)
    return key or TEST_KEY


def kind_of(match: Column, card_said: Column) -> Column:
    """The type of a match: that of the first alternative that takes all of it; null for a number or word that is none."""
    out = None
    for kind, pattern in PATTERNS.items():
        whole = match.rlike(f"^(?:{pattern})$")
        if kind == "card":
            whole = whole & (card_said | (F.pmod(_luhn(_digits(match)), F.lit(10)) == 0))
        out = F.when(whole, kind) if out is None else out.when(whole, kind)
    return out


def _byte(digest: Column, i: Column) -> Column:
    """A number from 0 to 65535 from the digest's hexadecimal digits, for place i."""
    return F.conv(F.substring(digest, F.lit(1) + F.pmod(i * 3, F.lit(125)), F.lit(4)), 16, 10).cast("int")


def _pick(values: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.pmod(number, F.lit(len(values))) + 1)


def _alike(text: Column, digest: Column, letters: Column) -> Column:
    """Every digit becomes a digit and every letter a letter of its case and script; signs stay."""
    # F.char covers one byte; other scripts pick from their alphabets
    alphabets = F.array(*(F.struct(F.lit(first).alias("first"), F.lit(last).alias("last"), F.lit(letters).alias("letters")) for first, last, letters in ALPHABETS))

    def one(c: Column, i: Column) -> Column:
        n, code = _byte(digest, i), F.ascii(c)
        shift = lambda first, size: F.char(F.lit(first) + F.pmod(n, size))
        chosen = lambda alphabet: F.substring(alphabet, F.pmod(n, F.length(alphabet)) + 1, F.lit(1))
        listed = bound(F.get(F.filter(alphabets, lambda x: code.between(x["first"], x["last"])), F.lit(0))["letters"], chosen)
        other = F.coalesce(listed, F.when(c.rlike(r"\p{N}"), shift(48, F.lit(10))).otherwise(shift(97, letters)))
        other = F.when(F.upper(c) == c, F.upper(other)).otherwise(other)
        return (
            F.when(code.between(48, 57), shift(48, F.lit(10)))
            .when(code.between(97, 122), shift(97, letters))
            .when(code.between(65, 90), shift(65, letters))
            .when((code < 128) | ~c.rlike(r"[\p{L}\p{N}]"), c)
            .otherwise(other)
        )

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum of an array of digits, the last one undoubled."""
    doubled = F.transform(F.reverse(digits), lambda d, i: F.when(i % 2 == 0, d).when(d < 5, d * 2).otherwise(d * 2 - 9))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d)


def _digits(text: Column) -> Column:
    return F.transform(F.filter(F.split(F.regexp_replace(text, r"\D", ""), ""), lambda c: c != ""), lambda c: c.cast("int"))


def _checked(text: Column, draft: Column) -> Column:
    """A drafted card number whose check digit holds exactly if that of ``text`` held."""
    off, last = F.pmod(_luhn(_digits(draft)), F.lit(10)), F.right(draft, F.lit(1)).cast("int")
    wanted = F.when(F.pmod(_luhn(_digits(text)), F.lit(10)) == 0, F.pmod(last - off, F.lit(10))).otherwise(F.when(off == 0, F.pmod(last + 1, F.lit(10))).otherwise(last))
    return F.concat(F.substr(draft, F.lit(1), F.length(draft) - 1), wanted.cast("string"))


def _name(text: Column, given: Column, gender: Column, digest: Column, attempt: Column) -> Column:
    """A given name of the gender, or a surname, in the script of ``text``."""
    script = F.when(text.rlike(r"\p{IsCyrillic}"), "cyrillic").when(text.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    out = None
    for kind, parts in SYLLABLES.items():
        male, female = GIVEN[kind, "male"], GIVEN[kind, "female"]
        number = _byte(digest, F.lit(0))
        first = F.when(gender == "male", _pick(male, number)).when(gender == "female", _pick(female, number)).otherwise(_pick(male + female, number))
        built = lambda n: F.initcap(F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: _pick(parts, _byte(digest, i))), ""))  # noqa: B023, E731
        first = F.when(attempt == 0, first).otherwise(F.concat_ws("-", first, built(F.lit(1) + attempt)))
        drawn = F.when(given, first).otherwise(built(F.lit(4) + attempt))
        out = F.when(script == kind, drawn) if out is None else out.when(script == kind, drawn)
    return out


def surrogate(kind: Column, text: Column, gender: Column, attempt: Column, key: str) -> Column:
    """The keyed surrogate of an entity at an attempt."""
    digest = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, text, gender, attempt.cast("string")), 512)
    longer = F.greatest(attempt - 2, F.lit(0)).cast("int")
    is_name, email, card = kind.isin("given", "name"), kind == "email", kind == "card"
    local = F.substring_index(text, "@", 1)
    top = F.when(email, F.concat(F.lit("."), F.substring_index(text, ".", -1))).otherwise("")
    host = F.when(email, F.substr(text, F.length(local) + 1, F.length(text) - F.length(local) - F.length(top))).otherwise("")
    code = F.regexp_extract(text, r"^(\+\d{1,3}[ .-]?(?=\())?", 1)  # a country code that a bracket follows
    head = F.when(card, F.substring(text, 1, 1)).when(kind == "phone", code).when(kind.isin("key", "iban"), F.substring(text, 1, 4)).otherwise("")
    more = F.when(card | kind.isin("key", "iban"), "").otherwise(F.repeat(F.when(email, "a").otherwise("0"), longer))
    body = F.concat(F.when(email, local).otherwise(F.substr(text, F.length(head) + 1)), more)
    letters = F.when(kind.isin("secret", "hex") & text.rlike("^(?=[a-fA-F]*+[0-9])[0-9a-fA-F]++$"), 6).otherwise(26)
    piece = lambda text, digest, letters: F.struct(text.alias("text"), digest.alias("digest"), letters.alias("letters"))

    def drawn(digest: Column) -> Column:
        octets = F.array_join(F.transform(F.split(text, r"\."), lambda _, i: (F.pmod(_byte(digest, i), F.lit(254)) + 1).cast("string")), ".")
        pieces = F.array(piece(body, digest, letters), piece(host, F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("host"), host), 512), F.lit(26)))
        alike = F.array_join(F.transform(pieces, lambda p: _alike(p["text"], p["digest"], p["letters"])), "")
        signed = bound(F.concat(head, alike, top), lambda draft: F.when(card, _checked(text, draft)).otherwise(draft))
        return F.when(kind == "ip", octets).when(is_name, _name(text, kind == "given", gender, digest, attempt)).otherwise(signed)

    return bound(digest, drawn)


def _described(match: Column, card_said: Column) -> Column:
    """The parts of a match: type, what stays before it, entity, gender and full name.

    A name of two parts gives a given name and a surname.  Type ``word`` is to
    be looked up among the text's names; a null type is no entity.
    """
    none = F.lit(None).cast("string")
    part = lambda kind, before, entity, gender, full: F.struct(kind.alias("kind"), before.alias("before"), entity.alias("entity"), F.coalesce(gender, F.lit("any")).alias("gender"), full.alias("full"))

    def parts(x: Column) -> Column:
        kind, before = x["kind"], x["before"]
        rest = F.substr(match, F.length(before) + 1)
        titled = lambda name: before.rlike(r"(?:^|[ .])(?:" + "|".join(_TITLES[name]) + r")[ .]")
        gender = F.when(kind == "name", F.when(titled("female"), "female").when(titled("male"), "male"))
        two = F.array(part(F.lit("given"), before, F.substring_index(rest, " ", 1), gender, rest), part(F.lit("name"), F.lit(" "), F.substring_index(rest, " ", -1), none, none))
        single = F.when(kind == "name", "title").when(kind.isNull() & match.rlike(r"^\p{Lu}"), "word").otherwise(kind)
        return F.when((kind == "name") & rest.contains(" "), two).otherwise(F.array(part(single, before, rest, gender, none)))

    before = lambda kind: F.when(kind == "secret", F.regexp_extract(match, _SECRET, 1)).when(kind == "name", F.regexp_extract(match, f"^({_TITLE})", 1)).otherwise("")
    return bound(bound(kind_of(match, card_said), lambda kind: F.struct(kind.alias("kind"), before(kind).alias("before"))), parts)


def assign(entities: DataFrame, key: str, *, draw=surrogate) -> DataFrame:
    """kind, entity, gender and surrogate of every distinct entity; no two surrogates of a type are equal."""
    names = ["kind", "entity", "gender"]
    pending = real = staged(entities.select(names).distinct(), "distinct")
    taken = real.select("kind", F.col("entity").alias("surrogate")).distinct()
    settled = []
    for attempt in range(ATTEMPTS):
        drawn = pending.withColumn("surrogate", draw(F.col("kind"), F.col("entity"), F.col("gender"), F.lit(attempt), key))
        first = drawn.groupBy("kind", "surrogate").agg(F.min(F.struct("entity", "gender")).alias("first"))
        judged = drawn.join(first, ["kind", "surrogate"]).join(taken.withColumn("taken", F.lit(True)), ["kind", "surrogate"], "left")
        clash = F.col("taken").isNotNull() | (F.struct("entity", "gender") != F.col("first"))
        judged = staged(judged.select(*names, "surrogate", clash.alias("clash")), "judged")
        settled.append(judged.where("not clash").select(*names, "surrogate"))
        pending = judged.where("clash").select(names)
        if not pending.limit(1).count():
            return reduce(DataFrame.unionByName, settled)
        taken = taken.unionByName(settled[-1].select("kind", "surrogate"))
    raise RuntimeError(f"entities still share surrogates after {ATTEMPTS} attempts")


def _resolved(parts: DataFrame) -> DataFrame:
    """Parts of names: words that are none lose their type, single names and titles without gender find theirs."""
    place = ["lw_id", "lw_key"]
    named = parts.where("kind in ('given', 'name', 'title')")
    known = F.min(F.when((F.col("kind") == "given") & (F.col("gender") != "any"), F.col("gender")))
    single = F.when(F.max(F.when(F.col("kind") == "name", 1)).isNull() & F.max(F.when(F.col("kind") == "given", 1)).isNotNull(), "given").otherwise("name")
    # within a text: what a word or a single name is
    local = named.groupBy(*place, "entity").agg(single.alias("as"), known.alias("local"), F.min(F.when(F.col("kind") == "given", F.col("full"))).alias("first"))
    words = parts.where("kind in ('word', 'title')").alias("p")
    same = F.col("p.lw_id").eqNullSafe(F.col("l.lw_id")) & (F.col("p.lw_key") == F.col("l.lw_key")) & (F.col("p.entity") == F.col("l.entity"))
    # a single name's title speaks of a person who may not be the given name's: only a given name has a gender
    gender = F.when(F.col("l.as") == "given", F.coalesce(F.col("l.local"), F.lit("any"))).otherwise("any")
    full = F.when(F.col("l.as") == "given", F.col("l.first"))
    words = words.join(local.alias("l"), same, "left").select("p.lw_id", "p.lw_key", "p.at", "p.part", F.col("l.as").alias("kind"), "p.before", "p.entity", gender.alias("gender"), full.alias("full"))
    rest = parts.where("kind is null or kind not in ('word', 'title')").unionByName(words)
    # across texts: the gender of a full name
    genders = named.where("kind = 'given' and gender != 'any'").groupBy("full").agg(F.min("gender").alias("known"))
    unsure = (F.col("kind") == "given") & (F.col("gender") == "any")
    asked = spread_join(rest.where(unsure), genders, ["full"], "left").withColumn("gender", F.coalesce("known", "gender")).drop("known")
    return rest.where(F.coalesce(~unsure, F.lit(True))).unionByName(asked)


def rewrite(docs: DataFrame, key: str, *, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None, draw=surrogate) -> DataFrame:
    """``docs`` with surrogates for the entities of its texts; ``count_col`` adds how many were replaced."""
    columns, place = docs.columns, ["lw_id", "lw_key"]
    rows = docs.select(docs[id_col].alias("lw_id"), F.xxhash64(docs[text_col]).alias("lw_key"), docs[text_col].alias("lw_text"), F.struct(*(docs[c] for c in columns)).alias("lw_row"))
    found = rows.where(F.col("lw_text").rlike(PATTERN)).select(*place, "lw_text", F.regexp_extract_all("lw_text", F.lit(PATTERN), F.lit(0)).alias("m"))
    found = found.withColumn("named", F.exists("m", lambda m: m.rlike(f"^{_TITLE}")))
    found = found.select(*place, "named", F.col("lw_text").rlike(CARD_SAID).alias("said"), F.when(F.col("named"), F.regexp_extract_all("lw_text", F.lit(PATTERN_NAMED), F.lit(0))).otherwise(F.col("m")).alias("m"))
    found = staged(found.dropDuplicates(place).select(*place, "named", F.transform("m", lambda m: _described(m, F.col("said"))).alias("found")), "entities")
    each = found.select(*place, F.posexplode("found").alias("at", "parts")).select(*place, "at", F.posexplode("parts").alias("part", "e")).select(*place, "at", "part", "e.*")
    each = staged(_resolved(each).drop("full"), "parts")
    known = assign(each.where("kind is not null"), key, draw=draw)
    replaced = spread_join(each.where("kind is not null"), known, ["kind", "entity", "gender"]).unionByName(each.where("kind is null").withColumn("surrogate", F.col("entity")))
    said = replaced.groupBy(*place, "at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", F.concat("before", "surrogate").alias("s")))), lambda x: x["s"]), "").alias("s"), F.max(F.col("kind").isNotNull().cast("int")).alias("real"))
    said = said.groupBy(place).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "s"))), lambda x: x["s"]).alias("lw_new"), F.sum("real").cast("int").alias("lw_count"))
    new = said.join(found.select(*place, "named"), [said["lw_id"].eqNullSafe(found["lw_id"]), said["lw_key"] == found["lw_key"]]).select(said["lw_id"], said["lw_key"], "named", "lw_new", "lw_count")
    out = rows.alias("d").join(new.alias("r"), F.col("d.lw_id").eqNullSafe(F.col("r.lw_id")) & (F.col("d.lw_key") == F.col("r.lw_key")), "left")
    pieces = F.when(F.col("named"), F.split("lw_text", PATTERN_NAMED, -1)).otherwise(F.split("lw_text", PATTERN, -1))
    woven = F.array_join(F.flatten(F.zip_with(pieces, F.col("lw_new"), lambda p, s: F.array(p, F.coalesce(s, F.lit(""))))), "")
    text = F.when(F.col("lw_new").isNull(), F.col("lw_text")).otherwise(woven)
    selected = [text.alias(c) if c == text_col else F.col("lw_row")[c].alias(c) for c in columns]
    if count_col:
        selected.append(F.coalesce(F.col("lw_count"), F.lit(0)).alias(count_col))
    return out.select(*selected)


def surrogate_texts(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text with surrogates and n_entities of every row."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rewrite(rows, key, count_col="n_entities")
