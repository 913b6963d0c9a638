"""Format-preserving pseudonyms for numbers and dates in texts, by keyed Feistel permutations.

Found and validated: payment card numbers (13 to 19 digits, Luhn check; with other digits beside them the longest groups that
pass, the first of equals; one in ten of the longer runs passes by chance and is then taken), phone numbers written the North American way (exchange 200 to 999; areas from 200 and
areas below, which no one is given, are permuted apart), IPv4 addresses (octets to 255), ISO dates (real days from 1900-01-01 to 2099-12-31), and mail
addresses. Each value is mapped within its own format: a card keeps its length, separators and first digit and
gets a new valid check digit; a phone number keeps its punctuation; an address stays an address; a date
stays a real date. The map is a permutation of the format for every key, so equal values stay linked across documents
and different values stay different. In mail addresses every letter or digit of the local part is replaced by a
keyed one from a digest of the address; the shape and the domain stay, equal addresses stay equal.

One Feistel network serves all: a value is a pair (a, b) of numbers below the two moduli, and rounds add a keyed
digest of one half to the other. Dates live in 319 * 229 = 73051 places of which 73049 are days; a walk
of three steps always comes back to a day.

Everything is a column expression over single rows: no shuffle, no Python. Null and empty texts stay as they are.
Strings that look like a value but fail its check stay. Every row is treated alone, so repeated rows and ids give
equal rows; other columns are passed on untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
# the kinds in the order in which they are tried, all without capturing groups
PATTERNS = {
    "email": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}",
    "phone": r"(?<![\w.])(?:\+1[ .\-]?)?\(?[0-9]{3}\)?[ .\-][2-9][0-9]{2}[ .\-][0-9]{4}(?![\w])",
    "ip": r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\w]|\.[0-9])",
    "date": r"(?<![\w\-])(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}(?![\w]|-[0-9])",
    "card": r"(?<![\w.])[0-9](?:[ \-]?[0-9]){12,18}(?![\w]|\.[0-9])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
DAYS, DAY_A, DAY_B = 73049, 319, 229


def _digest(key: str, kind: str, turn: Column, half: Column) -> Column:
    """48 bits of a keyed digest of one half in one round."""
    text = F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("bigint")


def feistel(a: Column, b: Column, mod_a: Column | int, mod_b: Column | int, key: str, kind: str, rounds: int = ROUNDS) -> Column:
    """struct(a, b): the permuted pair; a below ``mod_a``, b below ``mod_b``."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x).cast("bigint")
    mod_a, mod_b = lit(mod_a), lit(mod_b)
    start = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))

    def turn(s: Column, i: Column) -> Column:
        even = F.struct(F.pmod(s["a"] + _digest(key, kind, i, s["b"]), mod_a).alias("a"), s["b"].alias("b"))
        odd = F.struct(s["a"].alias("a"), F.pmod(s["b"] + _digest(key, kind, i, s["a"]), mod_b).alias("b"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, turn)


def _digits(token: Column) -> Column:
    return F.regexp_replace(token, "[^0-9]", "")


def _pad(number: Column, width: Column | int) -> Column:
    return F.lpad(number.cast("string"), width if isinstance(width, Column) else F.lit(width), F.lit("0"))


def _refill(token: Column, digits: Column) -> Column:
    """The token with its digits replaced in order by ``digits``."""
    chars = F.filter(F.split(token, ""), lambda c: c != "")
    step = lambda s, c: F.struct(
        F.concat(s["out"], F.when(c.rlike("[0-9]"), F.substr(s["rest"], F.lit(1), F.lit(1))).otherwise(c)).alias("out"),
        F.when(c.rlike("[0-9]"), F.substr(s["rest"], F.lit(2))).otherwise(s["rest"]).alias("rest"))
    return F.aggregate(chars, F.struct(F.lit("").alias("out"), digits.alias("rest")), step, lambda s: s["out"])


def luhn_sum(digits: Column) -> Column:
    """Luhn sum with the rightmost digit counted once."""
    chars = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(
        i % 2 == 0, c.cast("int")).otherwise((2 * c.cast("int")) % 10 + F.when(c.cast("int") > 4, 1).otherwise(0)))
    return F.aggregate(chars, F.lit(0), lambda a, x: a + x)


def _card_span(token: Column) -> Column:
    """struct(n, s, e): negated digit count, first and last place of the longest run of whole groups that passes the check, or null."""
    places, blank = F.sequence(F.lit(1), F.length(token)), lambda p: F.substr(token, p, F.lit(1)).rlike("[ \\-]")
    starts = F.filter(places, lambda p: F.when(p == 1, True).otherwise(blank(p - 1)))
    ends = F.filter(places, lambda p: F.when(p == F.length(token), True).otherwise(blank(p + 1)))
    part = lambda s, e: _digits(F.substr(token, s, e - s + 1))
    spans = F.flatten(F.transform(starts, lambda s: F.transform(F.filter(ends, lambda e: e - s >= 12), lambda e: F.struct(
        (-F.length(part(s, e))).alias("n"), s.alias("s"), e.alias("e")))))
    return F.array_min(F.filter(spans, lambda x: F.when(x["n"].between(-19, -13), luhn_sum(part(x["s"], x["e"])) % 10 == 0).otherwise(False)))


def _card(token: Column, key: str) -> Column:
    ten = lambda n: F.pow(F.lit(10.0), n).cast("bigint")

    def swap(x: Column) -> Column:
        found = F.substr(token, x["s"], x["e"] - x["s"] + 1)
        digits = _digits(found)
        inner = F.length(digits) - 2  # all but the first and the check digit
        left = F.floor(inner / 2).cast("int")
        right = (inner - left).cast("int")
        pair = feistel(F.substr(digits, F.lit(2), left), F.substr(digits, left + 2, right), ten(left), ten(right), key, "card")
        body = F.concat(F.substr(digits, F.lit(1), F.lit(1)), _pad(pair["a"], left), _pad(pair["b"], right))
        check = F.pmod(-luhn_sum(F.concat(body, F.lit("0"))), F.lit(10))
        return F.concat(F.substr(token, F.lit(1), x["s"] - 1), _refill(found, F.concat(body, check.cast("string"))), F.substr(token, x["e"] + 1))

    # one element at most; as a lambda's variable it is worked out once
    spans = F.filter(F.array(_card_span(token)), lambda x: x.isNotNull())
    return F.coalesce(F.get(F.transform(spans, swap), F.lit(0)), token)


def _phone(token: Column, key: str) -> Column:
    digits = _digits(token)
    prefix = F.substr(digits, F.lit(1), F.length(digits) - 10)
    part = lambda start, n: F.substr(digits, F.length(digits) - 10 + start, F.lit(n)).cast("bigint")
    given = part(1, 3) >= 200
    low, areas = F.when(given, 200).otherwise(0), F.when(given, 800).otherwise(200)
    pair = feistel((part(1, 3) - low) * 800 + part(4, 3) - 200, part(7, 4), (areas * 800).cast("bigint"), 10000, key, "phone")
    new = F.concat(prefix, _pad(F.floor(pair["a"] / 800) + low, 3), (pair["a"] % 800 + 200).cast("string"), _pad(pair["b"], 4))
    return _refill(token, new)


def _ip(token: Column, key: str) -> Column:
    octet = F.transform(F.split(token, r"\."), lambda x: x.cast("int"))
    pair = feistel(F.get(octet, F.lit(0)) * 256 + F.get(octet, F.lit(1)), F.get(octet, F.lit(2)) * 256 + F.get(octet, F.lit(3)), 65536, 65536, key, "ip")
    halves = [F.floor(pair["a"] / 256), pair["a"] % 256, F.floor(pair["b"] / 256), pair["b"] % 256]
    return F.when(F.array_max(octet) <= 255, F.concat_ws(".", *[h.cast("string") for h in halves])).otherwise(token)


def _date(token: Column, key: str) -> Column:
    day = F.datediff(F.try_to_timestamp(token, F.lit("yyyy-MM-dd")).cast("date"), F.lit("1900-01-01").cast("date")).cast("bigint")
    once = lambda x: feistel(F.floor(x / DAY_B), x % DAY_B, DAY_A, DAY_B, key, "date")
    number = lambda pair: pair["a"] * DAY_B + pair["b"]
    walked = F.aggregate(F.array(F.lit(0), F.lit(1), F.lit(2)), F.lit(-1).cast("bigint"),
                         lambda x, i: F.when((i > 0) & (x < DAYS), x).otherwise(number(once(F.when(i == 0, day).otherwise(x)))))
    return F.when(day.isNotNull(), F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), walked.cast("int")), "yyyy-MM-dd")).otherwise(token)


def _email(token: Column, key: str) -> Column:
    local = F.substring_index(token, "@", 1)
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(token)), 512)
    byte = lambda i: F.conv(F.substr(digest, 2 * (i % 64) + 1, F.lit(2)), 16, 10).cast("int")
    pick = lambda alphabet, i: F.substr(F.lit(alphabet), byte(i) % len(alphabet) + 1, F.lit(1))
    chars = F.transform(F.filter(F.split(local, ""), lambda c: c != ""), lambda c, i: F.when(c.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz", i)).when(
        c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", i)).when(c.rlike("[0-9]"), pick("0123456789", i)).otherwise(c))
    return F.concat(F.array_join(chars, ""), F.substr(token, F.length(local) + 1))


def kind_of(token: Column) -> Column:
    kind = None
    for name, pattern in PATTERNS.items():
        plain = f"^(?:{pattern})$"
        kind = F.when(token.rlike(plain), name) if kind is None else kind.when(token.rlike(plain), name)
    return kind


def pseudonym(token: Column, key: str) -> Column:
    """The pseudonym of one matched value, or the value itself where its check fails."""
    kind = kind_of(token)
    return F.when(kind == "email", _email(token, key)).when(kind == "phone", _phone(token, key)).when(kind == "ip", _ip(token, key)) \
        .when(kind == "date", _date(token, key)).when(kind == "card", _card(token, key)).otherwise(token)


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in ``text_col`` and the columns ``_values`` (found) and ``_pseudonyms`` (their replacements)."""
    # the row travels as one struct, so its columns cannot clash with those of the work
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    d = d.withColumn("values", F.when(F.col("text").rlike("[0-9@]"), F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>")))
    # most texts hold no value: their lambda never runs
    d = d.withColumn("new", F.transform("values", lambda t: pseudonym(t, key)))
    d = d.withColumn("between", F.when(F.size("values") > 0, F.split("text", ANY)))
    filled = F.array_join(F.zip_with("between", "new", lambda p, v: F.concat(p, F.coalesce(v, F.lit("")))), "")
    text = F.when(F.size("values") > 0, filled).otherwise(F.col("text"))
    return d.select(*[text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns], F.col("values").alias("_values"), F.col("new").alias("_pseudonyms"))
