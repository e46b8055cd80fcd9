"""Keyed pseudonyms that keep the format of what they replace, with built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
LEAST_PHONE_DIGITS = 7
"""Digits of a telephone number with its country code; fewer after a plus sign are no number."""

# What may be private, in the order it is tried at a place in the text. Every form is bounded in what it may
# step back over, so that the time is in proportion to the text and no run of signs is followed step within step: the
# name of an e-mail address has at most 64 characters, its domain at most 33 labels.
KINDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|(?<=[0-9])(?=[A-Za-z._%+-])|(?<=[A-Z])(?=[._%+-]))[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){1,32}",
    "ip": r"(?<![0-9A-Za-z.])(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}(?![0-9A-Za-z]|\.\d)",
    "secret": r"(?<![0-9A-Za-z])(?:(?=[0-9a-f]{0,63}\d)[0-9a-f]{32,64}|(?=[0-9A-F]{0,63}\d)[0-9A-F]{32,64})(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "date": r"(?<![0-9A-Za-z./-])(?:\d{4}-\d\d-\d\d(?=T(?![A-Za-z]))|(?:\d{4}-\d\d-\d\d|\d\d/\d\d/\d{4}|\d\d\.\d\d\.\d{4})(?![0-9A-Za-z]|[./-]\d))",
    "ssn": r"(?<![0-9A-Za-z-])\d{3}-\d\d-\d{4}(?![0-9A-Za-z]|-\d)",
    "phone": r"(?:(?<![0-9A-Za-z])\+\d{1,3}[ .-]?)(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![0-9A-Za-z(])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?![0-9A-Za-z]|-\d)",
    "card": r"(?<![0-9A-Za-z])\d(?:[ -]?\d){12,18}(?![0-9A-Za-z])",
}
_ANY = "|".join(KINDS.values())
_BLOCK = 256
"""Places of a text that are put together at a time."""

_AHEAD = 64
"""Characters after a match that are kept with it, more than any kind but the first three, which need no second try, is long."""

# Characters of an account number by country, from the register of account number formats.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_LETTERS, _BASE_26 = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdefghijklmnop"
_DAYS = 146_097  # of 400 years from 1800 on; 189 * 773
_FIRST_DAY = "1800-01-01"
_LATE_DAYS = 88_497  # of these the ones after the 12th of a month, which tell that the month comes first; 9 * 9833
_MONTHS = 4_800
_PART = 22
"""Digits permuted at once; a longer numeral is permuted part by part."""


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it occurs there."""
    return F.element_at(F.transform(F.array(value), lambda v: use(v)), 1)


def feistel(job: Column, before: Column, key: str) -> Column:
    """A keyed permutation of the pairs ``(a, b)`` with ``0 <= a < size_a`` and ``0 <= b < size_b`` of a job.

    Each round adds a digest of one half, the tweak and what came ``before`` to the other half; an even number of
    rounds leaves the halves in place.
    """

    def step(state: Column, i: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), job["tweak"], before, i.cast("string"), state["b"].cast("string")), 256)
        added = F.conv(F.substring(digest, 1, 14), 16, 10).cast("long")
        size = F.when(i % 2 == 1, job["size_a"]).otherwise(job["size_b"])
        return F.struct(state["b"].alias("a"), F.pmod(state["a"] + added, size).alias("b"))

    first = F.struct(job["a"].alias("a"), job["b"].alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), first, step)


def _job(tweak: Column, base: Column, u: Column, v: Column, a: Column, b: Column, size_a: Column, size_b: Column) -> Column:
    fields = {"base": base.cast("int"), "u": u.cast("int"), "v": v.cast("int")}
    fields |= {k: c.cast("long") for k, c in (("a", a), ("b", b), ("size_a", size_a), ("size_b", size_b))}
    return F.struct(tweak.alias("tweak"), *(c.alias(k) for k, c in fields.items()))


def _pair(tweak: str, a: Column, b: Column, size_a: int, size_b: int) -> Column:
    """The work for a value that is a pair of numbers."""
    return F.array(_job(F.lit(tweak), F.lit(0), F.lit(0), F.lit(0), a, b, F.lit(size_a), F.lit(size_b)))


def _numeral(numeral: Column, base: int, tweak: Column) -> Column:
    """The work for a numeral: one job per part, with the parts after it in its tweak. The parts before it enter
    through what came before, so the whole map is a permutation of the numerals of a length."""
    number = lambda t: F.conv(F.when(t == "", "0").otherwise(t), base, 10)
    power = lambda k: F.round(F.pow(F.lit(float(base)), k))

    def part(s: Column, i: Column) -> Column:
        def made(p: Column) -> Column:
            n = F.length(p)
            u = F.floor(n / 2).cast("int")
            after = F.substr(s["s"], (i + 1) * _PART + 1, F.length(s["s"]))
            whole = F.concat_ws(":", s["t"], F.length(s["s"]).cast("string"), after)
            return _job(whole, F.lit(base), u, n - u, number(F.substr(p, F.lit(1), u)), number(F.substr(p, u + 1, n - u)), power(u), power(n - u))

        return _let(F.substr(s["s"], i * _PART + 1, F.lit(_PART)), made)

    def parts(s: Column) -> Column:
        listed = F.transform(F.sequence(F.lit(0), F.floor((F.length(s["s"]) - 1) / _PART).cast("int")), lambda i: part(s, i))
        return F.when(F.length(s["s"]) > 0, listed)

    return _let(F.struct(numeral.alias("s"), tweak.alias("t")), parts)


def _evaluate(jobs: Column, key: str) -> Column:
    """``array<struct<a, b, s>>``: the permuted pair of every job, and as a numeral."""
    put = lambda x, k, base: F.when(k == 0, "").otherwise(F.lpad(F.lower(F.call_function("conv", x.cast("string"), F.lit(10), base)), k, "0"))

    def add(done: Column, job: Column) -> Column:
        pair = feistel(job, F.array_join(done["s"], ":"), key)
        numeral = lambda p: F.when(job["base"] > 0, F.concat(put(p["a"], job["u"], job["base"]), put(p["b"], job["v"], job["base"]))).otherwise("")
        return F.concat(done, F.array(_let(pair, lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), numeral(p).alias("s")))))

    return F.aggregate(jobs, F.array().cast("array<struct<a:bigint,b:bigint,s:string>>"), add)


def _only(text: Column, kept: str) -> Column:
    return F.regexp_replace(text, f"[^{kept}]", "")


def _refill(text: Column, symbols: Column, kept: Column) -> Column:
    """``text`` with its characters that match ``kept`` replaced in order by ``symbols``, capital where it was."""

    def filled(both: Column) -> Column:
        def one(done: Column, c: Column) -> Column:
            new = F.substr(both["symbols"], done["n"] + 1, F.lit(1))
            fits = F.call_function("rlike", c, both["kept"])
            shown = F.when(~fits, c).when(c.rlike("[A-Z]"), F.upper(new)).otherwise(new)
            return F.struct((done["n"] + fits.cast("int")).alias("n"), F.concat(done["out"], shown).alias("out"))

        start = F.struct(F.lit(0).alias("n"), F.lit("").alias("out"))
        return F.aggregate(F.split(both["text"], ""), start, one)["out"]

    return _let(F.struct(text.alias("text"), symbols.alias("symbols"), kept.alias("kept")), filled)


def _digit_sum(digits: Column, doubled: int) -> Column:
    """The Luhn sum; ``doubled`` is the parity, from the right, of the digits that count twice."""

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == doubled, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def _remainder97(text: Column) -> Column:
    def add(total: Column, c: Column) -> Column:
        value = F.conv(c, 36, 10).cast("int")
        return (total * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.split(text, ""), F.lit(0), add)


def _number(text: Column, separator: str, i: int) -> Column:
    return F.get(F.split(text, separator), i).cast("long")


def _iso(text: Column) -> Column:
    turned = F.concat_ws("-", F.substring(text, 7, 4), F.substring(text, 4, 2), F.substring(text, 1, 2))
    swapped = F.concat_ws("-", F.substring(text, 7, 4), F.substring(text, 1, 2), F.substring(text, 4, 2))
    return F.when(text.rlike("^....-"), text).when(_month_first(text), swapped).otherwise(turned)


def _month_first(text: Column) -> Column:
    """Whether a date with slashes can only be read with the month first: its second number is no month."""
    return text.contains("/") & (F.substring(text, 4, 2) > "12")


def _day(text: Column) -> Column:
    return F.datediff(F.try_to_date(_iso(text), "yyyy-MM-dd"), F.lit(_FIRST_DAY).cast("date"))


def _late_number(text: Column) -> Column:
    """The number of a month-first date among the days after the 12th of a month."""
    month = (F.substring(text, 7, 4).cast("int") - int(_FIRST_DAY[:4])) * 12 + F.substring(text, 1, 2).cast("int")
    return _day(text) - 12 * month


def _late_date(number: Column) -> Column:
    """The date with this number among the days after the 12th."""
    first = F.lit(_FIRST_DAY).cast("date")
    before = lambda k: F.datediff(F.add_months(first, k), first) - 12 * k

    def dated(n: Column) -> Column:
        near = F.floor(n * _MONTHS / _LATE_DAYS).cast("int")
        month = F.array_max(F.filter(F.sequence(F.greatest(near - 3, F.lit(0)), near + 3), lambda k: before(k) <= n))
        return _let(month, lambda k: F.date_add(F.add_months(first, k), (n - before(k) + 12).cast("int")))

    return _let(number, dated)


def _longest(match: Column, least: int, valid: Callable[[Column], Column], first: Callable[[Column], Column] | None = None) -> Column:
    """The longest beginning of a match, cut where letters and digits end, that is ``valid``; one that is ``first``
    goes before the others. Null if none is."""

    def chosen(m: Column) -> Column:
        ends = F.filter(F.sequence(F.length(m), F.lit(least), F.lit(-1)), lambda n: F.substr(m, n, F.lit(2)).rlike("^[0-9A-Z](?:[^0-9A-Z]|$)"))
        good = F.filter(F.transform(ends, lambda n: F.substr(m, F.lit(1), n)), valid)
        return _let(good, lambda g: F.coalesce(F.get(F.filter(g, first), 0), F.get(g, 0)) if first else F.get(g, 0))

    return F.when(F.length(match) >= least, _let(match, chosen))


def _is_card(text: Column) -> Column:
    return _let(_only(text, "0-9"), lambda d: (F.length(d) >= 13) & (_digit_sum(d, 1) % 10 == 0))


def _is_account(text: Column) -> Column:
    bare = F.regexp_replace(text, " ", "")
    return _remainder97(F.concat(F.substr(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))) == 1


def _has_country_length(text: Column) -> Column:
    lengths = F.create_map(*(F.lit(x) for n, names in IBAN_LENGTHS.items() for name in names.split() for x in (name, n)))
    return F.length(F.regexp_replace(text, " ", "")) == F.try_element_at(lengths, F.substring(text, 1, 2))


def found_at(place: Column) -> Column:
    """``(kind, text)`` of the first kind with a valid value at the second character of ``place``, which is followed by
    what comes after it in the text; null if none.

    A card or account number that fails as a whole is tried shorter, since it may have taken in what comes after it.
    """

    def ssn(t: Column) -> Column:
        area, group, serial = (_number(t, "-", i) for i in range(3))
        return area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)

    value = {
        "iban": lambda t: _longest(t, 12, lambda p: (F.length(F.regexp_replace(p, " ", "")) >= 12) & _is_account(p), _has_country_length),
        "date": lambda t: F.when(_day(t).between(0, _DAYS - 1), t),
        "ssn": lambda t: F.when(ssn(t), t),
        "card": lambda t: _longest(t, 13, _is_card),
        "phone": lambda t: F.when(F.length(_only(t, "0-9")) >= LEAST_PHONE_DIGITS, t),
    }

    def of(kind: str, form: str) -> Column:
        match = F.nullif(F.regexp_extract(place, f"(?s)^.({form})", 1), F.lit(""))
        held = value.get(kind, lambda t: t)
        return _let(match, lambda t: _let(F.when(t.isNotNull(), held(t)), lambda v: F.when(v.isNotNull(), F.struct(F.lit(kind).alias("kind"), v.alias("text")))))

    return F.coalesce(*(of(kind, form) for kind, form in KINDS.items()))


def _jobs(m: Column) -> Column:
    """What to permute in a match ``(text, kind)``."""
    text, kind = m["text"], m["kind"]
    o = [_number(text, r"\.", i) for i in range(4)]
    area, group, serial = (_number(text, "-", i) for i in range(3))
    place = area - 1 - (area > 666).cast("int")
    local = F.substring_index(text, "@", 1)
    domain = F.concat_ws("|", kind, F.lower(F.substring_index(text, "@", -1)))
    letters = _numeral(F.translate(F.lower(_only(local, "A-Za-z")), _LETTERS, _BASE_26), 26, F.concat_ws("|", domain, _only(local, "0-9")))
    digits = F.when(kind == "email", _only(local, "0-9")).when(kind == "phone", _only(F.regexp_replace(text, r"^\+\d{1,3}(?=[^0-9])", ""), "0-9"))
    digits = digits.when(kind == "iban", F.regexp_replace(F.substr(F.regexp_replace(text, " ", ""), F.lit(5), F.length(text)), "[^0-9]", ""))
    digits = digits.otherwise(F.regexp_replace(_only(text, "0-9"), ".$", ""))  # a card number without its check digit
    tweak = F.when(kind == "email", domain).when(kind == "iban", F.concat_ws("|", kind, _only(text, "A-Z"))).otherwise(kind)
    none = F.array().cast("array<struct<tweak:string,base:int,u:int,v:int,a:bigint,b:bigint,size_a:bigint,size_b:bigint>>")
    numeral = F.coalesce(_numeral(digits, 10, tweak), none)
    found = F.when(kind == "ip", _pair("ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536))
    found = found.when(kind == "ssn", _pair("ssn", place * 99 + group - 1, serial - 1, 898 * 99, 9999))
    found = found.when((kind == "date") & _month_first(text), _let(_late_number(text), lambda n: _pair("late date", F.floor(n / 9833), n % 9833, 9, 9833)))
    found = found.when(kind == "date", _let(_day(text), lambda d: _pair("date", F.floor(d / 773), d % 773, _DAYS // 773, 773)))
    found = found.when(kind == "secret", _numeral(F.lower(text), 16, kind))
    return F.coalesce(found.when(kind == "email", F.concat(F.coalesce(letters, none), numeral)).otherwise(numeral), none)


def _finished(m: Column, done: Column) -> Column:
    """The pseudonym of a match from the permuted values."""
    text, kind = m["text"], m["kind"]
    a, b = F.get(done, 0)["a"], F.get(done, 0)["b"]
    octets = [F.floor(a / 256), a % 256, F.floor(b / 256), b % 256]
    area = F.floor(a / 99) + 1
    new_day = F.date_add(F.lit(_FIRST_DAY).cast("date"), (a * 773 + b).cast("int"))
    form = F.when(text.rlike("^....-"), "yyyy-MM-dd").when(text.contains("/"), "dd/MM/yyyy").otherwise("dd.MM.yyyy")
    symbols = F.array_join(done["s"], "")

    def numeral(s: Column) -> Column:
        prefix = F.when(kind == "phone", F.regexp_extract(text, r"^\+\d{1,3}(?=[^0-9])", 0)).when(kind == "iban", F.substring(text, 1, 2)).otherwise("")
        country, body = F.substring(text, 1, 2), F.substr(F.regexp_replace(text, " ", ""), F.lit(5), F.length(text))
        account = _let(_refill(body, s, F.lit("[0-9]")), lambda x: F.concat(F.lpad((98 - _remainder97(F.concat(x, country, F.lit("00")))).cast("string"), 2, "0"), x))
        filling = F.when(kind == "card", F.concat(s, F.pmod(-_digit_sum(s, 0), F.lit(10)).cast("string"))).when(kind == "iban", account).otherwise(s)
        kept = F.when(kind.isin("secret", "iban"), "[0-9A-Za-z]").otherwise("[0-9]")
        return F.concat(prefix, _refill(F.substr(text, F.length(prefix) + 1, F.length(text)), filling, kept))

    def email(s: Column) -> Column:
        local = F.substring_index(text, "@", 1)
        n = F.length(_only(local, "A-Za-z"))
        lettered = _refill(local, F.translate(F.substr(s, F.lit(1), n), _BASE_26, _LETTERS), F.lit("[A-Za-z]"))
        return F.concat(_refill(lettered, F.substr(s, n + 1, F.length(s)), F.lit("[0-9]")), F.lit("@"), F.substring_index(text, "@", -1))

    out = F.when(kind == "ip", F.concat_ws(".", *(x.cast("string") for x in octets)))
    out = out.when(kind == "ssn", F.format_string("%03d-%02d-%04d", area + (area >= 666).cast("int"), a % 99 + 1, b + 1))
    out = out.when((kind == "date") & _month_first(text), F.call_function("date_format", _late_date(a * 9833 + b), F.lit("MM/dd/yyyy")))
    out = out.when(kind == "date", F.call_function("date_format", new_day, form))
    return out.when(kind == "email", _let(symbols, email)).otherwise(_let(symbols, numeral))


def _replacement(place: Column, key: str) -> Column:
    """Kind, length and pseudonym of the value that starts at a place; null if none is valid there."""

    def made(m: Column) -> Column:
        new = _let(_evaluate(_jobs(m), key), lambda done: _finished(m, done))
        return F.when(m.isNotNull(), F.struct(m["kind"].alias("kind"), F.length(m["text"]).alias("n"), new.alias("new")))

    return _let(found_at(place), made)


def _replaced(parts: Column, found: Column) -> Column:
    """The parts of a text, of which all but the first start at a place, with the values found there replaced, and
    their kinds. A place within a value that was replaced is passed over."""

    def add(done: Column, x: Column) -> Column:
        part, m = x["part"], x["found"]
        n = F.length(part)
        covered = done["skip"] > 0
        hit = ~covered & m.isNotNull()
        over = F.when(covered, done["skip"]).when(hit, m["n"]).otherwise(0)
        rest = _let(F.struct(part.alias("part"), over.alias("over")), lambda r: F.substr(r["part"], r["over"] + 1, F.length(r["part"])))
        out = F.concat(done["out"], F.array(F.concat(F.when(hit, m["new"]).otherwise(""), rest)))
        kinds = F.when(hit, F.concat(done["kinds"], F.array(m["kind"]))).otherwise(done["kinds"])
        return F.struct(F.greatest(over - n, F.lit(0)).alias("skip"), out.alias("out"), kinds.alias("kinds"))

    none = F.array().cast("array<string>").alias("kinds")

    def add_block(done: Column, block: Column) -> Column:
        # What is gathered is copied at each step, so it is gathered block by block.
        inner = F.aggregate(block, F.struct(done["skip"].alias("skip"), F.array().cast("array<string>").alias("out"), none), add)
        gathered = lambda x: F.struct(
            x["skip"].alias("skip"), F.concat(done["out"], F.array(F.array_join(x["out"], ""))).alias("out"), F.concat(done["kinds"], x["kinds"]).alias("kinds")
        )
        return _let(inner, gathered)

    pairs = F.zip_with(F.slice(parts, F.lit(2), F.size(parts)), found, lambda p, m: F.struct(p.alias("part"), m.alias("found")))
    first = F.sequence(F.lit(0), F.greatest(F.size(found) - 1, F.lit(0)), F.lit(_BLOCK))
    blocks = _let(pairs, lambda ps: F.transform(first, lambda i: F.slice(ps, i + 1, F.lit(_BLOCK))))
    start = F.struct(F.lit(0).alias("skip"), F.array(F.get(parts, 0)).alias("out"), none)
    return F.aggregate(blocks, start, add_block)


def pseudonymize(docs: DataFrame, key: str, text: str = "text", kinds_column: str | None = "private_kinds") -> DataFrame:
    """Replace private values in ``text`` by pseudonyms of the same format; other columns stay.

    Numbers are validated first: card numbers by their check digit, bank accounts by theirs, social security numbers
    and dates by their ranges; one that fails stays, unless another kind fits, or its beginning is valid by itself, or
    a value that starts further on within it. A pseudonym depends on the value and the key alone, so equal values stay
    equal everywhere, and it is valid in the same way. Different values of a kind and format never meet, since every
    map is a permutation. ``kinds_column`` adds the kinds replaced, in order; a column of that name is replaced. ``key`` is the secret of a
    deployment: whoever has it can undo the pseudonyms.

    Everything happens in the row: the text is cut at all places where a value may start, and put together again. A
    missing text stays missing and has no kinds; an empty text stays empty.
    """
    value = F.col(text)
    some = value.rlike("[0-9@]")
    # The line feed gives the first place something before it; a cut at the very start would leave no empty part.
    led = F.concat(F.lit("\n"), value)
    places = F.when(some, F.regexp_extract_all(led, F.lit(f"(?=((?:{_ANY})[\\s\\S]{{0,{_AHEAD}}}))"), F.lit(1)))
    held = docs.withColumn("__places", F.coalesce(places, F.array().cast("array<string>")))
    held = held.withColumn("__parts", F.when(F.size("__places") > 0, F.split(led, f"(?={_ANY})", -1)))
    before = F.zip_with(F.slice("__parts", F.lit(1), F.size("__places")), "__places", lambda b, p: F.concat(F.substring(b, -1, 1), p))
    held = held.withColumn("__found", F.transform(before, lambda p: _replacement(p, key)))
    held = held.withColumn("__new", F.when(F.col("__parts").isNotNull(), _replaced(F.col("__parts"), F.col("__found"))))
    joined = F.array_join("__new.out", "")
    result = held.withColumn(text, F.when(F.col("__new").isNotNull(), F.substr(joined, F.lit(2), F.length(joined))).otherwise(value))
    if kinds_column:
        result = result.withColumn(kinds_column, F.coalesce("__new.kinds", F.array().cast("array<string>")))
    return result.drop("__places", "__parts", "__found", "__new")
