"""Personal data replaced by keyed surrogates of the same type and format, in DataFrame functions only.

Found are e-mail addresses, IPv4 and IPv6 addresses, phone numbers (with a country code, or written
as three, three and four digits), payment card numbers (known issuer prefix, valid check digit),
social security numbers, IBANs (valid check digits), and names: behind a title, or a forename of
the lists below before a capitalised word. Names are Latin, Cyrillic, Greek or Han; names in other
scripts are left alone. Where a surname was found, its bare mentions in the same text are replaced.

A surrogate is a function of (key, entity), so an entity gets the same one everywhere. Numbers and
addresses are permuted inside their format (a Feistel network over the digits that may change): two
numbers never get one surrogate, and there is nothing to run out of. Names are replaced part by
part, so a surname keeps its surrogate beside any forename. Parts of names and e-mail addresses
whose surrogates would be equal are numbered over the corpus and the number is spelt into the
surrogate, which keeps them distinct in one pass.
"""

from __future__ import annotations

import hashlib
import json
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchloom.llm.common import Scratch, let

#: For tests and demonstrations; a caller with real data passes a key of their own.
KEY = "batchloom-demo-key"
#: Numbered parts that go into the plan as a literal map; more are joined to the texts.
LITERAL_NUMBERS = 1000
KINDS = ("email", "ip", "phone", "card", "person", "ssn", "iban")
ROUNDS = 4

# Titles with the gender they show, forenames by gender and script, and syllables of
# surnames (no syllable begins another, so a row of them is read in one way only).
TITLES = {
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία"),
    "n": ("Dr", "Prof"),
}
FIRST_NAMES = {
    ("m", "latin"): ("Adam", "Bruno", "Carl", "David", "Erik", "Felix", "George", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Nils", "Oscar", "Paul", "Robert", "Simon", "Thomas", "Victor"),
    ("f", "latin"): ("Alma", "Bella", "Clara", "Diana", "Elena", "Flora", "Greta", "Helen", "Irene", "Julia", "Karin", "Laura", "Maria", "Nora", "Olga", "Paula", "Rita", "Sara", "Teresa", "Vera"),
    ("n", "latin"): ("Alex", "Robin", "Kim", "Sascha", "Noel", "Jules", "Charlie", "Morgan"),
    ("m", "cyrillic"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Игорь", "Кирилл", "Максим", "Олег"),
    ("f", "cyrillic"): ("Алина", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Ирина", "Ксения", "Мария", "Ольга"),
    ("n", "cyrillic"): ("Саша", "Женя", "Валя", "Шура"),
    ("m", "greek"): ("Αλέξης", "Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος"),
    ("f", "greek"): ("Άννα", "Ελένη", "Ζωή", "Κατερίνα", "Μαρία", "Σοφία"),
    ("n", "greek"): ("Φώτης", "Χρύσα"),
}
SYLLABLES = {
    "latin": ("ba", "ber", "cal", "dan", "del", "fer", "gar", "hol", "kel", "lan", "mar", "mon", "nel", "pol", "ran", "ros", "sal", "tor", "var", "wen"),
    "cyrillic": ("ба", "вер", "гал", "дан", "дол", "зор", "кал", "лан", "мар", "мон", "нев", "пол", "рад", "рос", "сал", "тор", "фед", "хол", "чер", "яр"),
    "greek": ("βα", "γαρ", "δαν", "δελ", "ζαν", "θαν", "καλ", "κελ", "λαν", "λεν", "μαρ", "μον", "νελ", "πολ", "ραν", "ροσ", "σαλ", "τορ", "φερ", "χολ"),
    "han": ("安", "白", "林", "何", "江", "高", "宋", "田", "石", "方", "文", "明", "华", "平", "海", "春", "云", "雨", "山", "星"),
}
_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзиклмнопрстуфхцчшэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "àâäçèéêëíîïñóôöùûü", "ÀÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÛÜ", "人大小中山水火木金土日月天地田石花草林川")
_RANGES = ("[0-9]", "[a-z]", "[A-Z]", "[а-яё]", "[А-ЯЁ]", "[\\u03AC-\\u03CE]", "[\\u0386-\\u03AB]", "\\p{Ll}", "\\p{Lu}", "\\p{L}")
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_EMAIL = "(?<![\\p{L}\\p{N}._%+-])[\\p{L}\\p{N}._%+-]+@[\\p{L}\\p{N}-]+(?:\\.[\\p{L}\\p{N}-]+)+"
_IP = f"(?<![0-9.])(?:{_OCTET}\\.){{3}}{_OCTET}(?!\\.?[0-9])"
_HEX = "[0-9A-Fa-f]{1,4}"
_SIX = f"(?<![0-9A-Za-z:.])(?:[23][0-9A-Fa-f]{{3}}|[Ff][CcDdEe][0-9A-Fa-f]{{2}})(?:(?::{_HEX}){{7}}|(?::{_HEX}){{0,5}}::(?:{_HEX}:){{0,5}}{_HEX})(?![0-9A-Za-z:])"
_SSN = "(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"
_PHONE = "(?<![0-9+])\\+(?:1[ .-]?\\(?[0-9]{3}\\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|[0-9]{1,3}(?:[ .-]?\\(?[0-9]{2,4}\\)?){2,4}(?!\\.?[0-9]))|(?<![0-9+(.-])(?:\\([2-9][0-9]{2}\\) ?|[2-9][0-9]{2}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-]*[0-9])"
_IBAN = "(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_CARD = "(?<![0-9])(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{13,19})(?![0-9])"
_PART = "(?:\\p{Lu}[\\p{L}'-]+|\\p{IsHan}{2,4})"
_TITLED = "(?:" + "|".join(t for ts in TITLES.values() for t in ts) + f")\\.?[ ]{_PART}(?:[ ]\\p{{Lu}}[\\p{{L}}'-]+)?"
_KNOWN = "(?:" + "|".join(sorted({x for xs in FIRST_NAMES.values() for x in xs})) + ")[ ]\\p{Lu}\\p{Ll}[\\p{L}'-]+"
_NAME = f"(?<![\\p{{L}}])(?:{_TITLED}|{_KNOWN})"
#: By the first character, so that most places of a text are passed over by one look.
_CAPITALS = "A-Z\\u0386-\\u03AB\\u0410-\\u042F"
PATTERN = f"(?=[0-9+(Ff])(?:{_IP}|{_SIX}|{_SSN}|{_PHONE}|{_CARD})|(?=[A-Z]{{2}}[0-9]){_IBAN}|(?=[{_CAPITALS}]\\p{{L}}{{0,15}}\\.?[ ][\\p{{Lu}}\\p{{IsHan}}]){_NAME}|{_EMAIL}"
#: Issuers' prefixes and lengths.
_ISSUER = "^(?:4[0-9]{12}(?:[0-9]{3}){0,2}|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|3[068][0-9]{12}|35[0-9]{14}|6(?:011|5[0-9]{2})[0-9]{12})$"
#: First octets that hold private or special networks: there the second octet stays as well.
_SPECIAL = (0, 10, 100, 127, 169, 172, 192, 198, 203, *range(224, 256))


def _chars(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0))


def _pick(h: Column, i: Column | int, n: int) -> Column:
    """A number below ``n`` from four hex digits of the hash, from the ``i``-th pair on."""
    at = (F.lit(i) if isinstance(i, int) else i) % 62 * 2 + 1
    return (F.conv(F.substr(h, at, F.lit(4)), 16, 10).cast("int") % n).cast("int")


def _from(values: tuple, at: Column) -> Column:
    """One of ``values`` (strings without spaces), which stand in the plan as one literal."""
    return F.element_at(F.split(F.lit(" ".join(values)), " "), at + 1)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


# ---- permutations ----


def permuted_pair(a: Column, b: Column, size_a, size_b, tweak: Column) -> Column:
    """A keyed permutation of the pairs (a < size_a, b < size_b): a Feistel network, struct (a, b).

    Each half is shifted by a hash of the other, which can be undone, so no two pairs meet.
    """
    shift = lambda x, side, r: F.conv(F.substr(F.sha2(F.concat_ws(":", tweak, F.lit(f"{side}{r}"), x.cast("string")), 256), F.lit(1), F.lit(15)), 16, 10).cast("bigint")

    def step(s: Column, r: int) -> Column:
        left = let(s, lambda s: F.struct(F.pmod(s.a + F.pmod(shift(s.b, "a", r), size_a), size_a).alias("a"), s.b.alias("b")))
        return let(left, lambda s: F.struct(s.a.alias("a"), F.pmod(s.b + F.pmod(shift(s.a, "b", r), size_b), size_b).alias("b")))

    out = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))
    for r in range(ROUNDS):
        out = step(out, r)
    return out


def permuted(text: Column, tweak: Column, base: int = 10) -> Column:
    """A keyed permutation of the digit strings of one length (up to 30 decimal, 28 hexadecimal digits).

    The tweak also takes the length in, so strings of different lengths have nothing in common.
    """

    def of(s: Column) -> Column:
        n, u = F.char_length(s), F.floor(F.char_length(s) / 2).cast("int")
        number = lambda x: F.coalesce(F.conv(F.nullif(x, F.lit("")), base, 10).cast("bigint"), F.lit(0).cast("bigint"))
        size = lambda k: F.pow(F.lit(float(base)), k).cast("bigint")
        spelt = lambda x, k: F.when(k > 0, F.lpad(F.lower(F.conv(x.cast("string"), 10, base)), k, "0")).otherwise("")
        pair = permuted_pair(number(F.substr(s, F.lit(1), u)), number(F.substr(s, u + 1, n - u)), size(u), size(n - u), F.concat_ws(":", tweak, n.cast("string")))
        return let(pair, lambda p: F.concat(spelt(p.a, u), spelt(p.b, n - u)))

    return F.when(F.char_length(text) > 0, let(F.lower(text), of)).otherwise(text)


def _refilled(c: Column, digits: Column, range_: str = "[0-9]") -> Column:
    """``c`` with its digits replaced, one by one, by those of ``digits``; the rest stays."""
    rank = lambda i: F.char_length(F.regexp_replace(F.substr(c, F.lit(1), i + 1), range_.replace("[", "[^", 1), ""))
    return let(digits, lambda n: F.array_join(F.transform(_chars(c), lambda x, i: F.when(x.rlike(range_), F.substr(n, rank(i), F.lit(1))).otherwise(x)), ""))


def _luhn(digits: Column) -> Column:
    """The sum whose last digit is 0 for a valid number."""
    one = lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))
    return F.aggregate(F.transform(F.transform(F.reverse(_chars(digits)), lambda c: c.cast("int")), one), F.lit(0), lambda a, b: a + b) % 10


def _mod97(plain: Column) -> Column:
    """The remainder of an IBAN without spaces: 1 for a valid one."""
    turned = F.concat(F.substr(plain, F.lit(5), F.char_length(plain)), F.substr(plain, F.lit(1), F.lit(4)))
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.transform(_chars(turned), value), F.lit(0), lambda r, d: (r * F.when(d > 9, 100).otherwise(10) + d) % 97)


# ---- types ----


def kind(c: Column) -> Column:
    """The type of what PATTERN found; null for numbers that are none of these."""
    digits, plain = _digits(c), F.regexp_replace(c, " ", "")
    card = digits.rlike(_ISSUER) & (_luhn(digits) == 0)
    iban = F.when(_mod97(plain) == 1, "iban")
    return (
        F.when(c.contains("@"), "email")
        .when(c.rlike("^[+(]") | c.rlike("^[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}$"), "phone")
        .when(c.rlike(f"^(?:{_OCTET}\\.){{3}}{_OCTET}$") | c.rlike("^[0-9A-Fa-f]{4}:"), "ip")
        .when(c.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(c.rlike("^[A-Z]{2}[0-9]{2}[ A-Z0-9]+$"), iban)
        .when(c.rlike("^[0-9]"), F.when(card, "card"))
        .otherwise("person")
    )


def _email(c: Column, h: Column) -> Column:
    """Letters and digits by others of their kind; a digit sub-address gives way (see ``parts_of``)."""

    def mapped(s: Column, h: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            out = None
            for range_, alphabet in zip(_RANGES, _ALPHABETS, strict=True):
                new = F.substr(F.lit(alphabet), _pick(h, i, len(alphabet)) + 1, F.lit(1))
                out = F.when(c.rlike(range_), new) if out is None else out.when(c.rlike(range_), new)
            return out.otherwise(c)

        return F.array_join(F.transform(_chars(s), one), "")

    domain = F.substring_index(c, "@", -1)
    top = F.substring_index(F.lower(domain), ".", -1)
    return F.concat(F.regexp_replace(mapped(F.substring_index(c, "@", 1), h), "\\+[0-9]*$", ""), F.lit("@"), mapped(F.regexp_replace(F.substring_index(domain, ".", 1), "-", "a"), F.sha2(h, 512)), F.lit(".example."), F.when(top.isin("com", "net", "org"), top).otherwise("com"))


def _ip(c: Column, key: str) -> Column:
    """The octets that tell a private or special network stay; the first octet of another is one of its kind."""
    plain = [o for o in range(256) if o not in _SPECIAL]
    moved = plain[:]
    random.Random(hashlib.sha256(f"{key}:octet".encode()).digest()).shuffle(moved)
    table = dict(zip(plain, moved, strict=True))

    def of(o: Column) -> Column:
        part = lambda i: F.element_at(o, i).cast("int")
        special = part(1).isin(*_SPECIAL) & (part(1) != 10)
        first = _from(tuple(str(table.get(i, i)) for i in range(256)), part(1))
        two = let(permuted_pair(part(3), part(4), F.lit(256), F.lit(256), F.concat_ws(":", F.lit(key), F.lit("ip2"), part(1), part(2))), lambda p: F.concat_ws(".", part(1), part(2), p.a, p.b))
        three = let(permuted_pair(part(2), part(3) * 256 + part(4), F.lit(256), F.lit(65536), F.concat_ws(":", F.lit(key), F.lit("ip3"), part(1))), lambda p: F.concat_ws(".", first, p.a, F.floor(p.b / 256), p.b % 256))
        return F.when(special, two).otherwise(three)

    return let(F.split(c, "\\."), of)


def _six(c: Column, key: str) -> Column:
    head, rest = F.substr(c, F.lit(1), F.lit(4)), F.substr(c, F.lit(5), F.char_length(c))
    layout = F.regexp_replace(rest, "[0-9A-Fa-f]", "x")
    hexes = F.regexp_replace(rest, "[^0-9A-Fa-f]", "")
    return F.concat(head, _refilled(rest, permuted(hexes, F.concat_ws(":", F.lit(key), F.lit("six"), F.lower(head), layout), 16), "[0-9A-Fa-f]"))


def _numbered(c: Column, keep: Column | int, name: str, key: str) -> Column:
    """``c`` with all its digits but the first ``keep`` permuted."""
    digits, keep = _digits(c), F.lit(keep) if isinstance(keep, int) else keep
    head, tail = F.substr(digits, F.lit(1), keep), F.substr(digits, keep + 1, F.char_length(digits))
    return _refilled(c, F.concat(head, permuted(tail, F.concat_ws(":", F.lit(key), F.lit(name), head))))


def _phone(c: Column, key: str) -> Column:
    """The country code and the first digit behind it stay."""
    country = F.char_length(F.regexp_extract(c, "^\\+(1(?![0-9])|1|[0-9]{1,3})", 1))
    return _numbered(c, country + 1, "phone", key)


def _card(c: Column, key: str) -> Column:
    """The issuer's digits stay; the check digit is made anew."""
    digits = _digits(c)
    keep = F.when(digits.startswith("6"), 4).otherwise(2)
    middle = permuted(F.substr(digits, keep + 1, F.char_length(digits) - keep - 1), F.concat_ws(":", F.lit(key), F.lit("card"), F.substr(digits, F.lit(1), keep)))
    body = F.concat(F.substr(digits, F.lit(1), keep), middle)
    return _refilled(c, let(body, lambda b: F.concat(b, ((10 - _luhn(F.concat(b, F.lit("0")))) % 10).cast("string"))))


def _iban(c: Column, key: str) -> Column:
    """Country, letters and spaces stay; the digits are permuted and the check digits made anew."""
    rest = F.substr(c, F.lit(5), F.char_length(c))
    country = F.substr(c, F.lit(1), F.lit(2))
    new = _refilled(rest, permuted(_digits(rest), F.concat_ws(":", F.lit(key), F.lit("iban"), country, F.regexp_replace(F.regexp_replace(rest, " ", ""), "[0-9]", "0"))))
    check = lambda r: F.lpad((98 - _mod97(F.concat(country, F.lit("00"), F.regexp_replace(r, " ", "")))).cast("string"), 2, "0")
    return let(new, lambda r: F.concat(country, check(r), r))


# ---- names ----


def script_of(word: Column) -> Column:
    return F.when(word.rlike("\\p{IsCyrillic}"), "cyrillic").when(word.rlike("\\p{IsGreek}"), "greek").when(word.rlike("\\p{IsHan}"), "han").otherwise("latin")


def _words(c: Column) -> Column:
    """The parts of a name: title, forename ("" without one), surname."""
    titled = "^(?:" + "|".join(t for ts in TITLES.values() for t in ts) + ")\\.?$"
    words = F.split(c, " ")

    def of(w: Column) -> Column:
        has = F.element_at(w, 1).rlike(titled)
        title = F.when(has, F.element_at(w, 1)).otherwise("")
        last = F.element_at(w, -1)
        first = F.when(F.size(w) - F.when(has, 1).otherwise(0) > 1, F.when(has, F.get(w, F.lit(1))).otherwise(F.element_at(w, 1))).otherwise("")
        return F.struct(title.alias("title"), first.alias("first"), last.alias("last"))

    return let(words, of)


def gender_of(p: Column) -> Column:
    bare = F.regexp_replace(p.title, "\\.", "")
    known = lambda g: F.lower(p.first).isin(*[x.lower() for (k, _), xs in FIRST_NAMES.items() if k == g for x in xs])
    return F.when(bare.isin(*TITLES["m"]), "m").when(bare.isin(*TITLES["f"]), "f").when(known("m"), "m").when(known("f"), "f").otherwise("n")


def _spelt(n: Column, values: tuple[str, ...], between: str = "") -> Column:
    """``n`` in the numerals ``values``, up to four of them; nothing for 0."""
    size = len(values)
    places = [F.floor((n - 1) / F.lit(float(size**k))).cast("bigint") for k in range(4)]
    return F.when(n > 0, F.concat(*[F.when(p > 0 if k else F.lit(True), F.concat(F.lit(between), _from(values, (p % size).cast("int")))).otherwise("") for k, p in enumerate(places)])).otherwise("")


def _by_group(what: str, group: Column, of) -> Column:
    """``of`` (a script or gender and script, their values) by the group; null for one that the lists don't have."""
    lists = SYLLABLES if what == "last" else {f"{g} {script}": xs for (g, script), xs in FIRST_NAMES.items()}
    out = F
    for name, xs in lists.items():
        out = out.when(group == name, of(name, xs))
    return out


def _part_base(what: str, group: Column, part: Column, key: str) -> Column:
    """The surrogate of a part of a name before it is told from others: two syllables for Han, else four, or a forename."""
    h = F.sha2(F.concat_ws(":", F.lit(key), F.lit(what), part), 512)
    many = lambda name: 1 if what == "first" else 2 if name == "han" else 4
    return let(h, lambda h: _by_group(what, group, lambda name, xs: F.concat(*[_from(xs, _pick(h, 2 * i, len(xs))) for i in range(many(name))])))


def _part(what: str, group: Column, part: Column, number: Column | None, key: str) -> Column:
    """The surrogate of a part: its number, if it has one, spelt behind as further syllables or forenames."""
    made = _part_base(what, group, part, key)
    if number is not None:
        made = F.concat(made, let(number, lambda n: _by_group(what, group, lambda _, xs: _spelt(n, xs, "" if what == "last" else "-"))))
    return F.initcap(made) if what == "last" else made


def parts_of(c: Column, key: str) -> Column:
    """What of an entity is told from others by numbers: structs (what, group, part, base), none for numbers and addresses."""
    one = lambda what, group, part, base: F.struct(F.lit(what).alias("what"), group.alias("group"), part.alias("part"), base.alias("base"))

    def person(p: Column) -> Column:
        last, first = script_of(p.last), F.concat_ws(" ", gender_of(p), script_of(p.first))
        surname = one("last", last, F.lower(p.last), _part_base("last", last, F.lower(p.last), key))
        forename = one("first", first, F.lower(p.first), _part_base("first", first, F.lower(p.first), key))
        return F.when((p.first != "") & (script_of(p.first) != "han"), F.array(surname, forename)).otherwise(F.array(surname))

    def mail(c: Column) -> Column:
        return F.array(one("email", F.lit(""), F.lower(c), F.lower(_email(c, F.sha2(F.concat_ws(":", F.lit(key), F.lower(c)), 512)))))

    none = F.array().cast("array<struct<what:string,group:string,part:string,base:string>>")
    return let(kind(c), lambda k: F.when(k == "email", mail(c)).when(k == "person", let(_words(c), person)).otherwise(none))


def _name_of(what, group: Column, part: Column) -> Column:
    return F.concat_ws("|", F.lit(what), group, part)


def _cased(new: Column, old: Column) -> Column:
    return F.when((F.char_length(old) > 1) & (old == F.upper(old)) & (old != F.lower(old)), F.upper(new)).otherwise(new)


def surname(last: Column, number, key: str) -> Column:
    script = script_of(last)
    return _cased(_part("last", script, F.lower(last), number(_name_of("last", script, F.lower(last))), key), last)


def _person(c: Column, number, key: str) -> Column:
    def of(p: Column) -> Column:
        group = F.concat_ws(" ", gender_of(p), script_of(p.first))
        first = _cased(_part("first", group, F.lower(p.first), number(_name_of("first", group, F.lower(p.first))), key), p.first)
        return F.concat_ws(" ", F.nullif(p.title, F.lit("")), F.when(p.first != "", first), surname(p.last, number, key))

    return let(_words(c), of)


def surrogate(c: Column, number=lambda name: None, key: str = KEY) -> Column:
    """The replacement of what PATTERN found; numbers of no kind stay. ``number``: a part's name to its number, None where no part has one."""

    def mail(c: Column) -> Column:
        new = _email(c, F.sha2(F.concat_ws(":", F.lit(key), F.lower(c)), 512))
        n = number(_name_of("email", F.lit(""), F.lower(c)))
        if n is None:
            return new
        return let(new, lambda m: let(n, lambda n: F.when(n > 0, F.regexp_replace(m, F.lit("@"), F.concat(F.lit("+"), n.cast("string"), F.lit("@")))).otherwise(m)))

    four = c.rlike("^[0-9.]+$")
    made = lambda k: F.when(k == "email", mail(c)).when(k == "ip", F.when(four, _ip(c, key)).otherwise(_six(c, key))).when(k == "phone", _phone(c, key)).when(k == "ssn", _numbered(c, 1, "ssn", key)).when(k == "iban", _iban(c, key)).when(k == "card", _card(c, key)).when(k == "person", _person(c, number, key)).otherwise(c)
    return let(kind(c), made)


def found(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def numbers(docs: DataFrame, scratch: Scratch, key: str = KEY) -> DataFrame:
    """(name, number > 0) of the parts whose surrogates would be equal to those of earlier ones (by hash)."""
    entities = docs.select(F.explode(found(F.col("text"))).alias("c")).distinct()
    parts = entities.select(F.explode(parts_of(F.col("c"), key)).alias("p")).groupBy("p.what", "p.group", "p.part").agg(F.min("p.base").alias("base"))
    order = Window.partitionBy("what", "group", "base").orderBy(F.xxhash64("part"), "part")
    ranked = parts.select(F.concat_ws("|", "what", "group", "part").alias("name"), (F.row_number().over(order) - 1).cast("bigint").alias("number"))
    return scratch.save(ranked.where("number > 0"), "numbers")


def _replaced(text: Column, cs: Column, number, key: str) -> Column:
    new = F.transform(cs, lambda c: let(c, lambda x: surrogate(x, number, key)))
    surnames = F.array_distinct(F.transform(F.filter(cs, lambda c: kind(c) == "person"), lambda c: F.element_at(F.split(c, " "), -1)))
    apart = lambda s: F.concat(F.lit("(?<![\\p{L}'-])\\Q"), s, F.lit("\\E(?!'?[\\p{L}-])"))
    bare = lambda gap, names: F.aggregate(names, gap, lambda t, s: F.regexp_replace(t, apart(s), surname(s, number, key)))
    gaps = let(surnames, lambda names: F.transform(F.split(text, PATTERN, -1), lambda gap: F.when(F.size(names) > 0, bare(gap, names)).otherwise(gap)))
    return F.array_join(F.flatten(F.zip_with(gaps, F.concat(new, F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")


def pseudonymise(docs: DataFrame, scratch: Scratch, key: str = KEY) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced, ``n_chars`` (if there) counted anew, and
    ``_found``: the types of the entities that were replaced, as an array of strings in the order of the text.

    A null text stays null. Texts without entities stay as they are; rows with equal ids stay
    separate rows; an empty table gives none; other columns pass through, whatever their names.
    """
    odd = numbers(docs, scratch, key)
    n = odd.limit(LITERAL_NUMBERS + 1).count()
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = F.col(names[docs.columns.index("text")])
    rows = docs.select(*[F.col(c).alias(n_) for c, n_ in zip(docs.columns, names, strict=True)]).withColumn("_cs", F.coalesce(found(text), F.array().cast("array<string>")))
    if not n:
        number = lambda name: None
    elif n <= LITERAL_NUMBERS:
        listed = json.dumps({r["name"]: r["number"] for r in odd.collect()})
        rows = rows.withColumn("_odd", F.from_json(F.lit(listed), "map<string,bigint>"))  # one literal, folded by the optimizer
        number = lambda name: F.coalesce(F.element_at("_odd", name), F.lit(0).cast("bigint"))
    else:
        hits = rows.where(F.size("_cs") > 0).select(F.sha2(text, 256).alias("_sha"), F.explode("_cs").alias("c")).distinct().select("_sha", F.explode(parts_of(F.col("c"), key)).alias("p"))
        hits = hits.select("_sha", F.concat_ws("|", "p.what", "p.group", "p.part").alias("name")).distinct().join(odd, "name")
        maps = hits.groupBy("_sha").agg(F.map_from_entries(F.collect_list(F.struct("name", "number"))).alias("_odd"))
        rows = rows.withColumn("_sha", F.sha2(text, 256)).join(maps, "_sha", "left").drop("_sha")
        number = lambda name: F.coalesce(F.element_at("_odd", name), F.lit(0).cast("bigint"))
    kinds = F.filter(F.transform("_cs", kind), lambda k: k.isNotNull())
    new = F.when(F.size("_cs") > 0, _replaced(text, F.col("_cs"), number, key)).otherwise(text)
    out = rows.withColumn("_new", new).withColumn("_kinds", kinds)
    columns = [F.col("_new").alias("text") if c == "text" else F.char_length("_new").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(n_).alias(c) for c, n_ in zip(docs.columns, names, strict=True)]
    return out.select(*columns, F.col("_kinds").alias("_found"))
