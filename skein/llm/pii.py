"""PII: format-preserving Feistel pseudonyms for validated numbers, dates, addresses and secrets.

Each finding is replaced by a keyed permutation of itself inside its own format: a card number that
passes its checksum becomes another that passes, a date another date of the same layout, an IPv4
address another address. Equal values have equal pseudonyms in all documents, and different values
of one format differ, because every round of a Feistel network can be undone with the key. Only
built-in functions run, row by row: nothing is shuffled, so no key or group can be hot.

What is found: e-mail addresses, IPv4 addresses, card numbers (13 to 19 digits, Luhn), IBANs (length
by country, mod 97), US social security numbers (assigned ranges), telephone numbers, calendar dates
(``yyyy-mm-dd``, ``dd/mm/yyyy``, ``mm/dd/yyyy``, ``dd.mm.yyyy``, from 1800 to 2199), values that are
assigned to a name such as ``token`` or ``password`` (in quotes, or without them if they have a
digit), and bare access keys of well-known forms. Where a match of the first pass fails its validation,
or is a card number of unusual grouping, the text is searched again: at each place that a number can
begin, candidates of all kinds and lengths are validated, and the first valid one is taken: numbers
with a checksum or a calendar before telephone numbers, and those before card numbers of any other
grouping. What fails in every reading stays as it is. Addresses keep their top-level domain, telephone
numbers their country code and IBANs their country. Letters outside ASCII, names of over 24 letters
and secrets get a keyed digest in place of the permutation, since their alphabets have no fixed size.

Cost is linear in the text: every repetition is bounded or possessive, and each place is tried once.
So an address has at most 64 characters before ``@`` (longer ones are no addresses) and 127 labels of
63 characters; what follows those stays.

Defined results: a null text stays null with no findings; an empty text has none. Repeated rows give
repeated results, and other columns, whatever their names, are carried through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import let, pack, unpack

KEY = "skein-demo-key"
ROUNDS = 8

OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: A name that a secret is assigned to, with the sign of assignment.
ASSIGNED = r"(?<![A-Za-z0-9])(?i:token|secret|(?:api|access|secret|private|auth)[_-]?key|password|passwd|pwd)[\"']?\s{0,8}[=:]\s{0,8}"
#: Openings of well-known access keys, and what follows them.
ACCESS_KEYS = {"(?:AKIA|ASIA)": "[A-Z0-9]{16}", "gh[pousr]_": "[A-Za-z0-9]{36}", "[spr]k_(?:live|test)_": "[A-Za-z0-9]{16,}+", "xox[abprs]-": "[A-Za-z0-9-]{10,}+", "AIza": "[\\w-]{35}", "eyJ": r"[\w-]{8,}+\.[\w-]{8,}+\.[\w-]{8,}+"}
PEM = r"-----BEGIN (?:[A-Z]{1,20} ){0,3}PRIVATE KEY-----"
BARE = "|".join(rf"{a}{b}" for a, b in ACCESS_KEYS.items())
PATTERNS = {
    "email": r"(?:(?<![\p{L}\p{N}])(?<![\p{L}\p{N}][._%+-])[\p{L}\p{N}]|(?<=[^\x00-\x7F])[A-Za-z0-9])[\p{L}\p{N}._%+-]{0,63}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,126}+",
    "secret": rf"{ASSIGNED}(?:\"[^\"\s]{{8,}}+(?=\")|'[^'\s]{{8,}}+(?=')|[\"']?(?=[^\s\"',;]{{0,512}}?\d)[^\s\"',;]{{8,}}+)|(?<![\w-])(?:{BARE})(?![\w-])|{PEM}[A-Za-z0-9+/=\s]{{16,}}+(?=-----END)",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ipv4": rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?!\d|\.\d)",
    "date": r"(?<!\d)(?:\d{4}-\d{2}-\d{2}|\d{2}([/.])\d{2}\1\d{4})(?!\d)",
    "ssn": r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)",
    "card": r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)",
    "phone": r"(?<!\d)(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|\+\d{7,15}+(?!\d)|\+\d{1,3}+(?:[ .-]?\(?\d{1,4}+\)?){2,6}(?!\d)",
}
#: Patterns that a match has on its own, without what must follow it.
WHOLE = PATTERNS | {"secret": PATTERNS["secret"].replace('(?=\\")', "").replace("(?=')", "").replace("(?=-----END)", "")}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What a text must have for any of them.
HINT = r"[0-9@]|[=:]\s{0,8}[\"']|PRIVATE KEY-----|" + "|".join(ACCESS_KEYS)
#: Characters of an IBAN by country, as its registry fixes them.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
IBAN = "|".join(rf"(?:{c.replace(' ', '|')})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (f"(?: ?[A-Z0-9]{{{n % 4}}})" if n % 4 else "") for n, c in IBAN_LENGTHS.items())
#: Usual groupings of card numbers.
CARD = r"\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}(?:\1\d{3})?|\d{4}([ -])\d{6}\2\d{4,5}"
SSN = r"(?<!\d)(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?!\d)"
DATE = r"\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4}"
#: Telephone numbers of three, three and four digits.
LOCAL = PATTERNS["phone"].split(r"|\+")[0]
#: Characters from the place where a number begins that are looked at; more than any number has.
SIGHT = 64
#: Places that are decided on at once.
CHUNK = 256
#: Days of 400 years, which is 189 * 773, from the first of the dates that are permuted.
FIRST_DAY, DAYS_A, DAYS_B = "1800-01-01", 189, 773
#: Steps of the walk that keeps a date inside its layout; one is left over in 10^25.
WALK = 64


def _digest(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", F.lit(key), *(p.cast("string") for p in parts)), 256)


def _number(key: str, *parts: Column) -> Column:
    return F.conv(F.substring(_digest(key, *parts), 1, 15), 16, 10).cast("long")


def feistel(x: Column, y: Column, a: Column, b: Column, key: str, tweak: Column) -> Column:
    """The keyed permutation of pairs (x, y) with 0 <= x < a and 0 <= y < b; a and b up to 10^18."""

    def step(s: Column, i: Column) -> Column:
        left = F.struct(((s["x"] + F.pmod(_number(key, tweak, i, s["y"]), a)) % a).alias("x"), s["y"].alias("y"))
        right = F.struct(s["x"].alias("x"), ((s["y"] + F.pmod(_number(key, tweak, i, s["x"]), b)) % b).alias("y"))
        return F.when(i % 2 == 0, left).otherwise(right)

    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _power(base: int, n: Column) -> Column:
    """base ** n as a long, for powers below 2^63."""
    most = 18 if base == 10 else 12
    return F.get(F.array(*(F.lit(base**i).cast("long") for i in range(most + 1))), n)


def permute_digits(digits: Column, key: str, tweak: Column) -> Column:
    """Another string of as many digits; for up to 36 digits. One digit is shifted by the key."""

    def halves(d: Column) -> Column:
        u = (F.length(d) / 2).cast("int")
        v = F.length(d) - u
        mixed = feistel(F.substr(d, F.lit(1), u), F.substr(d, u + 1), _power(10, u), _power(10, v), key, F.concat_ws(":", tweak, F.length(d)))
        joined = let(mixed, lambda m: F.concat(F.lpad(m["x"].cast("string"), u, F.lit("0")), F.lpad(m["y"].cast("string"), v, F.lit("0"))))
        one = ((d.try_cast("long") + F.pmod(_number(key, tweak), F.lit(10))) % 10).cast("string")
        return F.when(F.length(d) == 0, d).when(F.length(d) == 1, one).otherwise(joined)

    return let(digits, halves)


def permute_name(name: Column, key: str, tweak: Column) -> Column:
    """Another string of as many lower-case letters and digits."""

    def halves(d: Column) -> Column:
        u = (F.length(d) / 2).cast("int")
        v = F.length(d) - u
        number = lambda s: F.conv(s, 36, 10).cast("long")
        text = lambda n, size: F.lpad(F.lower(F.conv(n.cast("string"), 10, 36)), size, F.lit("0"))
        mixed = feistel(number(F.substr(d, F.lit(1), u)), number(F.substr(d, u + 1)), _power(36, u), _power(36, v), key, F.concat_ws(":", tweak, F.length(d)))
        joined = let(mixed, lambda m: F.concat(text(m["x"], u), text(m["y"], v)))
        long = let(_digest(key, tweak, d), lambda h: F.substr(F.repeat(h, (F.length(d) / 64).cast("int") + 1), F.lit(1), F.length(d)))
        return F.when(F.length(d) == 0, d).when(d.rlike("^[a-z0-9]{2,24}$"), joined).otherwise(long)

    return let(name, halves)


def refill(shape: Column, filling: Column, kind: str) -> Column:
    """``shape`` with its characters of the class ``kind`` replaced, in order, by those of ``filling``."""

    def between(fill: Column) -> Column:
        put = lambda i: F.when(i > 0, F.coalesce(F.get(fill, i - 1), F.lit(""))).otherwise("")
        return F.array_join(F.transform(F.split(shape, kind, -1), lambda rest, i: F.concat(put(i), rest)), "")

    return let(F.split(filling, ""), between)


def _only(text: Column, kind: str) -> Column:
    return F.regexp_replace(text, f"(?!{kind}).", "")


def _luhn_sum(digits: Column, doubled_from_right: int) -> Column:
    """Luhn sum; of digits counted from the right from 0, those of this parity are doubled."""

    def value(c: Column, i: Column) -> Column:
        d = c.try_cast("int")
        twice = (F.length(digits) - 1 - i) % 2 == doubled_from_right
        return F.when(twice, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    parts = F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), value)
    return F.aggregate(parts, F.lit(0), lambda s, x: s + x)


def _card(m: Column, key: str) -> Column:
    def swap(d: Column) -> Column:
        body = permute_digits(F.substr(d, F.lit(1), F.length(d) - 1), key, F.lit("card"))
        check = let(body, lambda b: F.concat(b, ((10 - _luhn_sum(b, 0) % 10) % 10).cast("string")))
        return F.when(_luhn_sum(d, 1) % 10 == 0, refill(m, check, "[0-9]")).otherwise(m)

    return let(_only(m, "[0-9]"), swap)


def _mod97(text: Column) -> Column:
    """Remainder of the number that an IBAN's letters and digits stand for."""

    def step(s: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (s * 10 + c.try_cast("int")) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), step)


def _iban(m: Column, key: str) -> Column:
    def swap(s: Column) -> Column:
        country, body = F.substr(s, F.lit(1), F.lit(2)), F.substr(s, F.lit(5))
        new = let(body, lambda b: refill(b, permute_digits(_only(b, "[0-9]"), key, F.concat(F.lit("iban"), country)), "[0-9]"))
        check = lambda b: F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0")
        whole = let(new, lambda b: F.concat(country, check(b), b))
        return F.when(_mod97(F.concat(body, F.substr(s, F.lit(1), F.lit(4)))) == 1, refill(m, whole, "[A-Z0-9]")).otherwise(m)

    return let(F.replace(m, F.lit(" "), F.lit("")), swap)


def _email(m: Column, key: str) -> Column:
    local, domain = F.lower(F.substring_index(m, "@", 1)), F.lower(F.substring_index(m, "@", -1))
    top = F.concat(F.lit("."), F.substring_index(domain, ".", -1))
    host = F.substr(domain, F.lit(1), F.length(domain) - F.length(top))
    swap = lambda s, tweak: let(s, lambda x: refill(x, permute_name(_only(x, r"[\p{L}\p{N}]"), key, F.lit(tweak)), r"[\p{L}\p{N}]"))
    return F.concat(swap(local, "local"), F.lit("@"), swap(host, "host"), top)


def _ipv4(m: Column, key: str) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    at = lambda p, i: F.get(p, F.lit(i))
    half = F.lit(1 << 16).cast("long")
    mixed = let(parts, lambda p: feistel(at(p, 0) * 256 + at(p, 1), at(p, 2) * 256 + at(p, 3), half, half, key, F.lit("ipv4")))
    octets = lambda s: (F.shiftright(s["x"], 8), s["x"] % 256, F.shiftright(s["y"], 8), s["y"] % 256)
    return let(mixed, lambda s: F.concat_ws(".", *(o.cast("string") for o in octets(s))))


def _date(m: Column, key: str) -> Column:
    """Dates of one layout are permuted among themselves.

    A date with slashes is read with the day first if it can be. One that cannot is permuted, again and
    again, until the result cannot either; so no two dates of that look meet.
    """
    first = F.lit(FIRST_DAY).cast("date")
    a, b = (F.lit(x).cast("long") for x in (DAYS_A, DAYS_B))

    def moved(d: Column) -> Column:
        return let(feistel((d / DAYS_B).cast("long"), d % DAYS_B, a, b, key, F.lit("date")), lambda s: (s["x"] * DAYS_B + s["y"]).cast("int"))

    def walked(d: Column) -> Column:
        inside = lambda x: F.dayofmonth(F.date_add(first, x)) > 12
        return F.aggregate(F.sequence(F.lit(2), F.lit(WALK)), moved(d), lambda x, i: F.when(inside(x), x).otherwise(moved(x)))

    def swap(layout: str, permuted: Callable[[Column], Column] = moved) -> Column:
        n = F.datediff(F.try_to_date(m, layout), first)
        new = let(let(n, permuted), lambda d: F.date_format(F.date_add(first, d), layout))
        return F.when((n >= 0) & (n < DAYS_A * DAYS_B), new)

    slashed = F.when(F.try_to_date(m, "dd/MM/yyyy").isNotNull(), swap("dd/MM/yyyy")).otherwise(swap("MM/dd/yyyy", walked))
    return F.coalesce(F.when(m.rlike("^[0-9]{4}-"), swap("yyyy-MM-dd")).when(m.rlike("/"), slashed).otherwise(swap("dd.MM.yyyy")), m)


def _ssn(m: Column, key: str) -> Column:
    """Areas are 001 to 899 without 666, groups from 01, serial numbers from 0001."""
    area, group, serial = (F.substring_index(F.substring_index(m, "-", i), "-", -1).cast("int") for i in (1, 2, 3))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    index = area - F.when(area > 666, 2).otherwise(1)
    mixed = feistel(index, (group - 1) * 9999 + serial - 1, F.lit(898).cast("long"), F.lit(99 * 9999).cast("long"), key, F.lit("ssn"))
    padded = lambda n, size: F.lpad(n.cast("string"), size, "0")
    text = lambda s: F.concat_ws("-", padded(s["x"] + F.when(s["x"] >= 665, 2).otherwise(1), 3), padded((s["y"] / 9999).cast("long") + 1, 2), padded(s["y"] % 9999 + 1, 4))
    return F.when(valid, let(mixed, text)).otherwise(m)


def _phone(m: Column, key: str) -> Column:
    code = F.regexp_extract(m, r"^\+\d{1,3}(?=[ .(-])", 0)

    def swap(rest: Column) -> Column:
        digits = _only(rest, "[0-9]")
        fine = F.length(digits).between(7, 15)
        return F.when(fine, F.concat(code, refill(rest, permute_digits(digits, key, F.lit("phone")), "[0-9]"))).otherwise(m)

    return let(F.substr(m, F.length(code) + 1), swap)


def _secret(m: Column, key: str) -> Column:
    """A digest in the letters and digits of the value; an access key keeps its opening."""
    opening = F.regexp_extract(m, rf"^(?:{ASSIGNED}[\"']?)?(?:{'|'.join(ACCESS_KEYS)}|{PEM})?", 0)
    value = F.substr(m, F.length(opening) + 1)
    digest = lambda v: let(_digest(key, F.lit("secret"), v), lambda h: F.repeat(h, (F.length(v) / 64).cast("int") + 1))
    new = lambda v: let(digest(v), lambda h: refill(v, F.when(v == F.upper(v), F.upper(h)).otherwise(h), "[A-Za-z0-9]"))
    return F.concat(opening, let(value, new))


def _replacement(m: Column, key: str) -> Column:
    """(kind, text) for a match."""
    made = {"email": _email, "secret": _secret, "iban": _iban, "ipv4": _ipv4, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone}
    whole = lambda name: m.rlike(f"^(?:{WHOLE[name]})$")
    out = None
    for name, make in made.items():
        case = F.struct(F.lit(name).alias("kind"), make(m, key).alias("text"))
        out = F.when(whole(name), case) if out is None else out.when(whole(name), case)
    return out.otherwise(F.struct(F.lit("none").alias("kind"), m.alias("text")))


def _valid_card(m: Column) -> Column:
    return let(_only(m, "[0-9]"), lambda d: _luhn_sum(d, 1) % 10 == 0)


def _valid_iban(m: Column) -> Column:
    return let(F.replace(m, F.lit(" "), F.lit("")), lambda s: _mod97(F.concat(F.substr(s, F.lit(5)), F.substr(s, F.lit(1), F.lit(4)))) == 1)


def _valid_date(m: Column) -> Column:
    n = lambda layout: F.datediff(F.try_to_date(m, layout), F.lit(FIRST_DAY).cast("date")).between(0, DAYS_A * DAYS_B - 1)
    layouts = F.when(m.rlike("-"), n("yyyy-MM-dd")).when(m.rlike("/"), F.coalesce(n("dd/MM/yyyy"), F.lit(False)) | F.coalesce(n("MM/dd/yyyy"), F.lit(False)))
    return F.coalesce(layouts.otherwise(n("dd.MM.yyyy")), F.lit(False))


def _valid_phone(m: Column) -> Column:
    return F.length(_only(F.regexp_replace(m, r"^\+\d{1,3}(?=[ .(-])", ""), "[0-9]")).between(7, 15)


def _certain(m: Column) -> Column:
    """Whether a match is valid and has no other reading that leaves a part of it out."""
    whole = lambda pattern: m.rlike(f"^(?:{pattern})$")
    case = F.when(whole(WHOLE["email"]) | whole(WHOLE["secret"]), True).when(whole(PATTERNS["iban"]), whole(IBAN) & _valid_iban(m))
    case = case.when(whole(PATTERNS["ipv4"]), True).when(whole(PATTERNS["date"]), _valid_date(m)).when(whole(PATTERNS["ssn"]), whole(SSN))
    return case.when(whole(PATTERNS["card"]), whole(CARD) & _valid_card(m)).otherwise(_valid_phone(m))


def _static(piece: Column, pattern: str) -> Column:
    """(was, piece): the piece after each match of ``pattern``, and that match; the first has none."""
    found = F.regexp_extract_all(piece, F.lit(pattern), F.lit(0))
    return F.arrays_zip(F.concat(F.array(F.lit(None).cast("string")), found).alias("was"), F.split(piece, pattern, -1).alias("piece"))


def _chosen(piece: Column, places: str, pick: Callable[[Column, Column], Column]) -> Column:
    """(was, piece) as in ``_static`` for numbers that begin where the empty pattern ``places`` matches.

    ``pick`` gets the text from a place on, and a text that is not empty where no other number ends just
    before; it returns the number that begins there, or null. From left to right, one that begins in
    another that was taken is passed over.
    """
    body = F.concat(F.lit("\n"), piece)  # so that nothing begins at the very start
    ahead = F.regexp_extract_all(body, F.lit(rf"(?:{places})(?=([\s\S]{{1,{SIGHT}}}))"), F.lit(1))
    apart = F.regexp_extract_all(body, F.lit(rf"(?:{places})(?=((?<![+)]|\d[ .-]|\)[ .-])[\s\S]|))"), F.lit(1))
    picked = F.transform(F.arrays_zip(ahead.alias("ahead"), apart.alias("apart")), lambda x: pick(x["ahead"], x["apart"]))
    rests = F.transform(F.split(body, places, -1), lambda x, i: F.when(i == 0, F.substr(x, F.lit(2))).otherwise(x))
    steps = F.arrays_zip(F.concat(F.array(F.lit(None).cast("string")), picked).alias("new"), rests.alias("rest"))
    none = F.array().cast("array<struct<was:string,piece:string>>")

    def step(s: Column, e: Column) -> Column:
        def put(was: Column) -> Column:
            over = F.coalesce(F.length(was), s["over"])
            part = F.struct(was.alias("was"), F.substr(e["rest"], over + 1).alias("piece"))
            return F.struct(F.greatest(over - F.length(e["rest"]), F.lit(0)).alias("over"), F.concat(s["out"], F.array(part)).alias("out"))

        return let(F.when(s["over"] == 0, e["new"]), put)

    def some(s: Column, chunk: Column) -> Column:
        inner = F.aggregate(chunk, F.struct(s["over"].alias("over"), none.alias("out")), step)
        return let(inner, lambda x: F.struct(x["over"].alias("over"), F.concat(s["out"], F.array(x["out"])).alias("out")))

    chunks = lambda e: F.transform(F.sequence(F.lit(0), F.floor((F.size(e) - 1) / CHUNK).cast("int")), lambda k: F.slice(e, k * CHUNK + 1, F.lit(CHUNK)))
    start = F.struct(F.lit(0).alias("over"), F.array().cast("array<array<struct<was:string,piece:string>>>").alias("out"))
    return let(F.flatten(F.aggregate(let(steps, chunks), start, some, lambda s: s["out"])), _merged)


def _merged(parts: Column) -> Column:
    """Each part that begins with a match, or is the first, together with those after it that do not."""

    def slices(at: Column) -> Column:
        to = lambda k: F.coalesce(F.get(at, k + 1), F.size(parts))
        text = lambda i, k: F.array_join(F.transform(F.slice(parts, i + 1, to(k) - i), lambda x: x["piece"]), "")
        return F.transform(at, lambda i, k: F.struct(F.get(parts, i)["was"].alias("was"), text(i, k).alias("piece")))

    return let(F.filter(F.transform(parts, lambda x, i: F.when((i == 0) | x["was"].isNotNull(), i)), lambda i: i.isNotNull()), slices)


def _first(options: Column, valid: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(options, lambda x: (x != "") & valid(x)), F.lit(0))


def _checked(ahead: Column, apart: Column) -> Column:
    """The IBAN, date or card number of clear bounds that ``ahead`` begins with."""
    whole = lambda pattern: F.array(F.regexp_extract(ahead, pattern, 0))
    clear = F.filter(_cards(ahead), lambda x: (x != "") & (x.rlike(f"^(?:{CARD})$") | ((apart != "") & ~F.substr(ahead, F.length(x) + 1).rlike(r"^[ -]?\d"))))
    usual = lambda x: x.rlike(f"^(?:{CARD})$") & _valid_card(x)
    return F.coalesce(
        _first(whole(rf"^(?:{IBAN})\b"), _valid_iban),
        _first(whole(rf"^(?:{DATE})(?!\d)"), _valid_date),
        let(clear, lambda c: F.coalesce(_first(c, usual), _first(c, _valid_card))),
    )


def _cards(ahead: Column) -> Column:
    return F.array(*(F.regexp_extract(ahead, rf"^\d(?:[ -]?\d){{{n - 1}}}(?!\d)", 0) for n in range(19, 12, -1)))


def _call(ahead: Column, apart: Column) -> Column:
    forms = [f"^(?:{LOCAL})", r"^\+\d{7,15}+(?!\d)", *(rf"^\+\d{{1,3}}+(?:[ .-]?\(?\d{{1,4}}+\)?){{{n}}}(?!\d)" for n in range(6, 1, -1))]
    return _first(F.array(*(F.regexp_extract(ahead, f, 0) for f in forms)), _valid_phone)


def _searched(text: Column) -> Column:
    """(was, piece) of a text: each piece with the valid match before it."""
    within = lambda parts, cut: F.flatten(F.transform(parts, lambda e: F.transform(cut(e["piece"]), lambda x, i: F.struct(F.when(i == 0, e["was"]).otherwise(x["was"]).alias("was"), x["piece"].alias("piece")))))
    parts = _static(text, "|".join((f"(?:{PATTERNS['email']})", f"(?:{PATTERNS['secret']})", f"(?:{PATTERNS['ipv4']})", SSN)))
    parts = within(parts, lambda x: _chosen(x, r"(?<![\d+])(?=\d)|\b(?=[A-Z]{2}\d{2})", _checked))
    parts = within(parts, lambda x: _chosen(x, r"(?=\+\d)|(?<!\d)(?=\(\d{3}\)|\d{3}[ .-])", _call))
    return within(parts, lambda x: _chosen(x, r"(?<!\d)(?=\d[ -]?\d)", lambda ahead, apart: _first(_cards(ahead), _valid_card)))


def pseudonymise(docs: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """``docs`` with pseudonyms in ``text``, and ``n_found`` and ``kinds`` (sorted, distinct)."""
    df = pack(docs, _text=F.col(text))
    body = F.col("_text")
    df = df.withColumn("_matches", F.when(body.rlike(HINT), F.regexp_extract_all(body, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>")))
    once = F.arrays_zip(F.concat(F.array(F.lit(None).cast("string")), F.col("_matches")).alias("was"), F.split(body, ANY, -1).alias("piece"))
    parts = F.when(F.exists("_matches", lambda m: ~_certain(m)), _searched(body)).when(F.size("_matches") > 0, once)
    made = F.transform(parts, lambda x: F.struct(x["piece"].alias("piece"), x["was"].alias("was"), F.when(x["was"].isNotNull(), _replacement(x["was"], key)).alias("new")))
    df = df.withColumn("_made", made)
    joined = F.array_join(F.transform("_made", lambda x: F.concat(F.coalesce(x["new"]["text"], F.lit("")), x["piece"])), "")
    df = df.withColumn("_changed", F.filter("_made", lambda x: x["new"]["text"] != x["was"]))
    return unpack(
        df,
        [c for c in docs.columns if c not in ("n_found", "kinds")],
        {text: F.coalesce(joined, body)},
        F.coalesce(F.array_size("_changed"), F.lit(0)).cast("long").alias("n_found"),
        F.coalesce(F.array_sort(F.array_distinct(F.transform("_changed", lambda x: x["new"]["kind"]))), F.array().cast("array<string>")).alias("kinds"),
    )
