r"""PII: format-preserving pseudonyms.

Personal values are found by one pattern, validated, and permuted within their format under a key, so a value becomes
the same pseudonym wherever it stands. The permutation is an alternating Feistel network on Z_a x Z_b: eight rounds
add a keyed SHA-256 of one half to the other half, modulo that half's size. It is a bijection for any a and b, so
formats need no cycle walking:

  card      13-19 digits that pass Luhn: all but the check digit are permuted, the check digit follows
  iban      checked modulo 97: the digits of the account are permuted, the check digits follow
  ssn       area, group and serial within their valid ranges
  phone     ten digits with area and exchange from 200; other ten-digit numbers as plain digits
  ip        the 32 bits of an IPv4 address
  date      days of 1900-2099, written year-month-day, month/day/year or day.month.year
  email, key, secret   names have no numeric format: a keyed digest of the same shape replaces them

Only spans that validate change. Text between them stays as it is, so the result is the pieces of a split joined with
the pseudonyms of the matches. Built from SQL functions alone.

Defined cases: null stays null; empty and very long texts are handled whole; overlapping candidates go to the leftmost, then to the first
kind in the pattern; what looks like a value but fails validation stays; a card may stand next to other numbers: its usual written forms go
before other spans that overlap them, then the longest; other columns are untouched, whatever their
names; ties and repeated rows are treated alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The key of runs that set none of their own, such as tests; whoever knows it can invert the permutations.
KEY = "spandrel-pseudonyms"
KEY_SETTING = "spandrel.pseudonyms.key"
ROUNDS = 8
#: The kinds of value, in order of preference, and what they look like.
KINDS = {
    "email": r"(?<![\w.%+-])[\w.%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "key": r"(?<![0-9A-Za-z])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])",
    "secret": r"(?i:password|passwd|token|secret|api_key)\s{0,3}[=:]\s{0,3}[\"']?[0-9A-Za-z_+/-]{8,}[\"']?",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![0-9A-Za-z])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9/-])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+])(?:\+?1[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
}
#: Cards aside: which spans are cards depends on their check digits, so a text's own are added to this.
PATTERN = "|".join(v for k, v in KINDS.items() if k != "card")
#: From each number on, as many digits as a card that starts within a card's length can reach.
CARD_RUN = r"(?<![0-9])(?=([0-9](?:[ -]?[0-9]){12,37}))"
#: How cards are usually written.
CARD_FORMS = r"^(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,4}(?:\1[0-9]{1,3})?|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5})\z"
#: A text without these can't hold any of the kinds.
HINT = r"[0-9@]|(?i:password|passwd|token|secret|api_key)"
#: Days from 1900-01-01 to 2099-12-31 are 17 times 4297.
FIRST_DAY, DAYS = "1900-01-01", (17, 4297)


def _digest(text: Column, key: str) -> Column:
    return F.sha2(F.concat(F.lit(key + "|"), text), 256)


def feistel(left: Column, right: Column, a: Column, b: Column, tweak: Column, key: str = KEY, inverse: bool = False) -> Column:
    """The pair (left in Z_a, right in Z_b) permuted: a struct l, r. The tweak names the format."""

    def mixed(i: Column, other: Column) -> Column:
        hexes = _digest(F.concat_ws("|", tweak, i.cast("string"), other.cast("string")), key)
        return F.conv(F.substring(hexes, 1, 14), 16, 10).cast("long")

    def turn(s: Column, i: Column) -> Column:
        even, sign = i % 2 == 0, -1 if inverse else 1
        left = F.when(even, F.pmod(s["l"] + sign * F.pmod(mixed(i, s["r"]), a), a)).otherwise(s["l"])
        right = F.when(even, s["r"]).otherwise(F.pmod(s["r"] + sign * F.pmod(mixed(i, s["l"]), b), b))
        return F.struct(left.alias("l"), right.alias("r"))

    order = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(order, F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), turn)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def _power(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(10**k) for k in range(19)]), n + 1)


def permute_digits(digits: Column, tweak: str, key: str = KEY, inverse: bool = False) -> Column:
    """A string of 2 to 36 digits permuted among those of its length."""
    n, half = F.length(digits), F.floor(F.length(digits) / 2).cast("int")
    left, right = F.substring(digits, F.lit(1), half).cast("long"), F.substring(digits, half + 1, n - half).cast("long")
    pair = feistel(left, right, _power(half), _power(n - half), F.concat(F.lit(tweak), n.cast("string")), key, inverse)
    return _let(pair, lambda p: F.concat(F.lpad(p["l"].cast("string"), half, "0"), F.lpad(p["r"].cast("string"), n - half, "0")))


def only_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def refill(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced, in order."""
    at = F.sequence(F.lit(1), F.length(shape))

    def one(i: Column) -> Column:
        c = F.substring(shape, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), F.substring(digits, F.length(only_digits(F.substring(shape, F.lit(1), i))), F.lit(1))).otherwise(c)

    return F.array_join(F.transform(at, one), "")


def luhn_sum(digits: Column) -> Column:
    """Luhn's sum of digits that lack their check digit."""
    n = F.length(digits)

    def add(s: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when((n - i) % 2 == 0, 2 * d).otherwise(d)
        return s + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def luhn_digit(digits: Column) -> Column:
    return F.pmod(10 - luhn_sum(digits) % 10, F.lit(10)).cast("string")


def card(match: Column, key: str = KEY, inverse: bool = False) -> Column:
    def done(d: Column) -> Column:
        body = F.substring(d, F.lit(1), F.length(d) - 1)
        new = _let(permute_digits(body, "card", key, inverse), lambda x: F.concat(x, luhn_digit(x)))
        return F.when(F.substring(d, -1, 1) == luhn_digit(body), refill(match, new)).otherwise(match)

    return _let(only_digits(match), done)


def cards(text: Column) -> Column:
    """The different spans of a text that are cards: whole numbers in a row, of 13-19 digits that pass Luhn. Usual forms first, then the longest."""

    def passes(span: Column) -> Column:
        return _let(only_digits(span), lambda d: F.substring(d, -1, 1) == luhn_digit(F.substring(d, F.lit(1), F.length(d) - 1)))

    def valid(run: Column) -> Column:
        spans = F.array(*[F.regexp_extract(run, rf"^[0-9](?:[ -]?[0-9]){{{n - 1}}}(?![0-9])", 0) for n in range(19, 12, -1)])
        return F.filter(spans, lambda s: F.when(s != "", passes(s)).otherwise(False))

    def chosen(found: Column) -> Column:
        usual = F.array_distinct(F.flatten(F.transform(found, lambda x: F.filter(x["spans"], lambda s: s.rlike(CARD_FORMS)))))

        def others(usual: Column) -> Column:
            def free(x: Column) -> Column:  # those that end before any usual form
                return F.filter(x["spans"], lambda s: ~F.exists(usual, lambda u: F.call_function("instr", x["run"], u).between(1, F.length(s))))

            rest = F.array_except(F.flatten(F.transform(found, free)), usual)
            return F.concat(_longest(usual), _longest(rest))

        return _let(usual, others)

    runs = F.regexp_extract_all(text, F.lit(CARD_RUN), F.lit(1))
    found = F.filter(F.transform(runs, lambda r: F.struct(r.alias("run"), valid(r).alias("spans"))), lambda x: F.size(x["spans"]) > 0)
    return _let(found, chosen)


def _longest(spans: Column) -> Column:
    return F.array_sort(spans, lambda a, b: F.length(b) - F.length(a))


def mod97(text: Column) -> Column:
    def add(s: Column, i: Column) -> Column:
        c = F.substring(text, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), (s * 10 + F.expr("0") + F.ascii(c) - 48) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), add)


def iban(match: Column, key: str = KEY, inverse: bool = False) -> Column:
    country, account = F.substring(match, 1, 2), F.substring(match, F.lit(5), F.length(match) - 4)
    valid = mod97(F.concat(account, F.substring(match, 1, 4))) == 1

    def done(d: Column) -> Column:
        new = F.when(F.length(d) >= 2, refill(account, permute_digits(d, "iban", key, inverse))).otherwise(account)
        return _let(new, lambda x: F.concat(country, F.lpad((98 - mod97(F.concat(x, country, F.lit("00")))).cast("string"), 2, "0"), x))

    return F.when(valid, _let(only_digits(account), done)).otherwise(match)


def ssn(match: Column, key: str = KEY, inverse: bool = False) -> Column:
    area, group, serial = (F.substring(match, *x).cast("long") for x in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    left = area - 1 - F.when(area > 666, 1).otherwise(0)
    pair = feistel(left, (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), F.lit("ssn"), key, inverse)

    def written(p: Column) -> Column:
        a = p["l"] + 1 + F.when(p["l"] >= 665, 1).otherwise(0)
        g, s = F.floor(p["r"] / 9999) + 1, p["r"] % 9999 + 1
        return F.format_string("%03d-%02d-%04d", a, g, s)

    return F.when(valid, _let(pair, written)).otherwise(match)


def phone(match: Column, key: str = KEY, inverse: bool = False) -> Column:
    def done(all_digits: Column) -> Column:
        code, d = F.substring(all_digits, F.lit(1), F.length(all_digits) - 10), F.right(all_digits, F.lit(10))
        area, rest = F.substring(d, 1, 3).cast("long"), F.substring(d, 4, 7).cast("long")
        real = (area >= 200) & (rest >= 2_000_000)
        pair = feistel(area - 200, rest - 2_000_000, F.lit(800), F.lit(8_000_000), F.lit("phone"), key, inverse)
        new = F.when(real, _let(pair, lambda p: F.format_string("%03d%07d", p["l"] + 200, p["r"] + 2_000_000)))
        return refill(match, F.concat(code, new.otherwise(permute_digits(d, "number", key, inverse))))

    return _let(only_digits(match), done)


def ip(match: Column, key: str = KEY, inverse: bool = False) -> Column:
    octets = F.transform(F.split(match, r"\."), lambda x: x.cast("long"))

    def done(o: Column) -> Column:
        pair = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), F.lit("ip"), key, inverse)
        new = _let(pair, lambda p: F.concat_ws(".", *[x.cast("string") for x in (F.shiftright(p["l"], 8), p["l"] % 256, F.shiftright(p["r"], 8), p["r"] % 256)]))
        return F.when(F.exists(o, lambda x: x > 255), match).otherwise(new)

    return _let(octets, done)


def date(match: Column, key: str = KEY, inverse: bool = False) -> Column:
    formats = {"-": "yyyy-MM-dd", "/": "MM/dd/yyyy", ".": "dd.MM.yyyy"}
    kind = F.when(match.contains("-"), "yyyy-MM-dd").when(match.contains("/"), "MM/dd/yyyy").otherwise("dd.MM.yyyy")
    day = F.coalesce(*[F.when(kind == f, F.try_to_timestamp(match, F.lit(f)).cast("date")) for f in formats.values()])

    def done(d: Column) -> Column:
        n = F.datediff(d, F.lit(FIRST_DAY).cast("date")).cast("long")
        pair = feistel(F.floor(n / DAYS[1]), n % DAYS[1], F.lit(DAYS[0]), F.lit(DAYS[1]), F.lit("date"), key, inverse)
        new = _let(pair, lambda p: F.date_add(F.lit(FIRST_DAY).cast("date"), (p["l"] * DAYS[1] + p["r"]).cast("int")))
        out = _let(new, lambda x: F.coalesce(*[F.when(kind == f, F.date_format(x, f)) for f in formats.values()]))
        return F.when(d.isNull() | (n < 0) | (n >= DAYS[0] * DAYS[1]), match).otherwise(out)

    return _let(day, done)


def email(match: Column, key: str = KEY) -> Column:
    return F.concat(F.lit("u"), F.substring(_digest(F.lower(match), key), 1, 14), F.lit("@pseudonym.example"))


def secret(match: Column, key: str = KEY) -> Column:
    """An access key keeps its prefix; of an assignment only the value changes. Values stay as long as they were."""
    head = F.regexp_extract(match, r"^(AKIA|(?:[A-Za-z_]+)\s*[=:]\s*[\"']?)", 1)
    value = F.regexp_extract(match, r"([0-9A-Za-z_+/-]+)[\"']?$", 1)
    own = F.when(match.startswith("AKIA"), F.substring(match, 5, 16)).otherwise(value)
    new = F.substring(F.repeat(_digest(own, key), F.ceil(F.length(own) / 64).cast("int")), F.lit(1), F.length(own))
    return F.when(match.startswith("AKIA"), F.concat(F.lit("AKIA"), F.upper(new))).otherwise(F.concat(head, new, F.regexp_extract(match, r"([\"']?)$", 1)))


def kind_of(match: Column) -> Column:
    found = F.lit(None).cast("string")
    for kind, pattern in reversed(KINDS.items()):
        found = F.when(match.rlike(rf"^(?:{pattern})\z"), F.lit(kind)).otherwise(found)
    return found


def pseudonym(match: Column, key: str = KEY) -> Column:
    by = {"email": email, "key": secret, "secret": secret, "iban": iban, "date": date, "ip": ip, "ssn": ssn, "phone": phone, "card": card}

    def chosen(kind: Column) -> Column:
        out = match
        for k, f in by.items():
            out = F.when(kind == k, f(match, key)).otherwise(out)
        return out

    return _let(kind_of(match), chosen)


def pseudonymise(docs: DataFrame, text: str = "text", key: str | None = None, counted: str | None = None) -> DataFrame:
    """docs with the personal values in text replaced; with counted, also how many spans changed, under that name.

    key: the secret that the permutations depend on; None takes the session's KEY_SETTING, or KEY where that is unset.
    """
    key = key or docs.sparkSession.conf.get(KEY_SETTING, None) or KEY
    given = docs.select(*[F.col(c).alias(f"in_{c}") for c in docs.columns])
    t = F.col(f"in_{text}")
    none = F.array().cast("array<string>")
    with_cards = given.withColumn("cards", F.when(t.rlike(CARD_RUN), cards(t)).otherwise(none))
    own = F.concat(F.lit(PATTERN + "|(?<![0-9])(?:"), F.array_join("cards", "|"), F.lit(")(?![0-9])"))
    with_pattern = with_cards.withColumn("pattern", F.when(F.size("cards") > 0, own).otherwise(F.lit(PATTERN)))
    found = F.when(t.rlike(HINT), F.regexp_extract_all(t, F.col("pattern"), F.lit(0))).otherwise(none)
    with_matches = with_pattern.withColumn("matches", found)
    with_new = with_matches.withColumn("new", F.transform("matches", lambda m: pseudonym(m, key)))
    pieces = F.split(t, F.col("pattern"))
    joined = F.array_join(F.zip_with(pieces, F.col("new"), lambda p, n: F.concat(p, F.coalesce(n, F.lit("")))), "")
    out = with_new.withColumn("out", F.when(F.size("matches") > 0, joined).otherwise(t))
    changed = F.size(F.filter(F.zip_with("matches", "new", lambda m, n: m != n), lambda x: x)).cast("long")
    kept = [F.col("out").alias(c) if c == text else F.col(f"in_{c}").alias(c) for c in docs.columns if c != counted]
    return out.select(*kept, *([changed.alias(counted)] if counted else []))
