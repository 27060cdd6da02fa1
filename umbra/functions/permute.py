"""Format-preserving permutations with a key: different texts of a whole table get different surrogates, without a table of
what was given and without a shuffle, and the key turns them back.

The letters and digits of a text are a number of mixed radix: 10 for a digit, 26 for a small or a capital letter; all other
characters stay, and so does each one's class, so texts of one form are permuted among themselves.  The number is cut
into blocks below 2**57, and a Feistel network adds to one block after the other a keyed digest of all the others, modulo the
block's size: each step can be taken back, so the whole is a permutation.  Types with rules have their own domain: cards keep
Luhn's check (the last digit follows from the others), addresses of IPv4 permute their four octets, dates the days of two
centuries, SSNs walk the cycle until the number is one that can be given, addresses of mail keep their top domain.
All are column expressions.
"""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let, running_sums

#: Characters of a block at most: 26**12 is below 2**57, so that sums stay in a long.
BLOCK = 12
LEAST_ROUNDS = 10
#: Steps of a walk; one that is not at its end by then has a chance of 0.15**64.
WALK = 64
# The days that dates are permuted among.
FIRST_DAY, DAYS = "1900-01-01", 73049


def _digest(key: Column, *parts: Column) -> Column:
    """A number below 2**60 of a key and what it is used for."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", key, *parts), 256), 1, 15), 16, 10).cast("long")


def feistel(blocks: Column, sizes: Column, key: Column, tweak: Column, back: bool) -> Column:
    """Numbers (block i below sizes[i]) permuted by a key; tweak: whatever should have a permutation of its own."""
    m = F.size(blocks)
    rounds = F.greatest(F.lit(LEAST_ROUNDS), 4 * m)
    numbers = F.sequence(F.lit(0), rounds - 1)

    def step(a: Column, r: Column) -> Column:
        i = r % m
        others = F.array_join(F.transform(a, lambda x, j: F.when(j == i, F.lit("")).otherwise(x.cast("string"))), ",")
        size = F.get(sizes, i)
        by = F.pmod(_digest(key, tweak, r.cast("string"), others), size)
        return F.transform(a, lambda x, j: F.when(j == i, F.pmod(x - by if back else x + by, size)).otherwise(x))

    order = F.reverse(numbers) if back else numbers
    return F.when(m > 0, F.aggregate(order, blocks, step)).otherwise(blocks)


def _is(c: Column, first: str, last: str) -> Column:
    return (c >= first) & (c <= last)  # of single characters


def _radix(c: Column) -> Column:
    return F.when(_is(c, "0", "9"), 10).when(_is(c, "a", "z") | _is(c, "A", "Z"), 26).otherwise(1)


def _first(c: Column) -> Column:
    """The code of the first character of c's class."""
    return F.when(_is(c, "0", "9"), 48).when(_is(c, "A", "Z"), 65).otherwise(97)


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def form(text: Column) -> Column:
    return F.translate(text, "123456780" + "ABCDEFGHIJKLMNOPQRSTUVWYZ" + "abcdefghijklmnopqrstuvwyz", "9" * 9 + "X" * 25 + "x" * 25)


def _put(chars: Column, live: Callable[[Column], Column], fresh: Column) -> Column:
    """The characters as a text, those that are live replaced by fresh ones in turn."""
    place = F.transform(chars, lambda c: F.when(live(c), 1).otherwise(0))
    return let(running_sums(place), lambda at: F.array_join(F.transform(chars, lambda c, i: F.when(live(c), F.get(fresh, F.get(at, i).cast("int"))).otherwise(c)), ""))


def permuted_text(text: Column, key: Column, tweak: Column, back: bool = False) -> Column:
    """text with its ASCII letters and digits permuted; the form stays."""

    def of(chars: Column) -> Column:
        return let(F.filter(chars, lambda c: _radix(c) > 1), lambda v: F.when(F.size(v) == 0, text).otherwise(work(chars, v)))

    def work(chars: Column, v: Column) -> Column:
        n = F.size(v)
        width = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.ceil(n / 2).cast("int")))
        parts = F.sequence(F.lit(0), F.greatest(F.ceil(n / width).cast("int") - 1, F.lit(0)))
        part = lambda k: F.slice(v, k * width + 1, width)
        value = lambda k: F.aggregate(part(k), F.lit(0).cast("long"), lambda s, c: s * _radix(c) + F.ascii(c) - _first(c))
        size = lambda k: F.aggregate(part(k), F.lit(1).cast("long"), lambda s, c: s * _radix(c))
        moved = let(F.transform(parts, size), lambda sizes: let(F.concat_ws("|", tweak, form(text)), lambda own: feistel(F.transform(parts, value), sizes, key, own, back)))

        def letters(x: Column, k: Column) -> Column:
            """The characters of a block, taken from its last to its first."""
            begin = F.struct(x.alias("x"), F.array().cast("array<string>").alias("out"))
            put = lambda a, c: F.struct(_div(a["x"], _radix(c).cast("long")).alias("x"), F.concat(F.array(F.char(_first(c) + F.pmod(a["x"], _radix(c).cast("long")))), a["out"]).alias("out"))
            return F.aggregate(F.reverse(part(k)), begin, put, lambda a: a["out"])

        return let(F.flatten(F.transform(moved, letters)), lambda fresh: _put(chars, lambda c: _radix(c) > 1, fresh))

    return let(_characters(text), of)


def walked(text: Column, once: Callable[[Column], Column], ends: Callable[[Column], Column]) -> Column:
    """once() until ends() holds, at least one time; null if it does not within WALK steps."""
    begin = F.struct(text.alias("t"), F.lit(False).alias("done"))
    step = lambda a, _: F.when(a["done"], a).otherwise(let(once(a["t"]), lambda y: F.struct(y.alias("t"), ends(y).alias("done"))))
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), begin, step, lambda a: F.when(a["done"], a["t"]))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn_digit(payload: Column) -> Column:
    """The digit that makes payload + digit pass Luhn's check."""
    digits = F.transform(F.reverse(_characters(payload)), lambda c, i: let(c.cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d)))
    return F.pmod(-F.aggregate(digits, F.lit(0), lambda s, d: s + d), F.lit(10)).cast("string")


def _octets(text: Column) -> Column:
    return text.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$") & F.forall(F.split(text, r"\."), lambda p: p.cast("int") < 256)


def _day(text: Column) -> Column:
    return F.datediff(F.try_to_date(text, "yyyy-MM-dd"), F.lit(FIRST_DAY).cast("date"))


def _within(kind: Column, text: Column) -> Column:
    """Whether a text keeps the rule of its type; texts that do are permuted among themselves, and so are the others."""
    return (
        F.when(kind == "CREDIT_CARD", F.call_function("luhn_check", _digits(text)) & (F.char_length(_digits(text)) > 1))
        .when(kind == "US_SSN", ~F.substring(text, 1, 3).rlike("^(000|666|9..)$"))
        .when(kind == "IP_ADDRESS", _octets(text))
        .when(kind == "DATE_TIME", F.coalesce(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & _day(text).between(0, DAYS - 1), F.lit(False)))
        .otherwise(F.lit(True))
    )


def _by_form(kind: Column, text: Column, within: Column, key: Column, back: bool) -> Column:
    """Walks within the texts of a form that keep the type's rule, or within those that do not.

    Of a card that keeps it the digits but the last are permuted, and the last follows; of an SSN that cannot be given the
    area stays, of an address of mail the top domain."""
    card = (kind == "CREDIT_CARD") & within
    area = (kind == "US_SSN") & ~within
    mail = kind.isin("EMAIL_ADDRESS", "EMAIL")

    def once(t: Column) -> Column:
        top = F.when(mail, F.regexp_extract(t, r"(\.[^.]*)$", 1)).otherwise(F.lit(""))
        first = F.when(area, F.substring(t, 1, 3)).otherwise(F.lit(""))
        plain = F.substring(t, F.char_length(first) + 1, F.char_length(t) - F.char_length(first) - F.char_length(top))
        part = F.when(card, F.regexp_replace(_digits(t), ".$", "")).otherwise(plain)
        kept = F.concat_ws("|", kind, F.when(card, form(t)).otherwise(F.lit("")), first, top)
        new = let(part, lambda x: permuted_text(x, key, kept, back))
        numbered = lambda x: _put(_characters(t), lambda c: _is(c, "0", "9"), _characters(F.concat(x, luhn_digit(x))))
        return let(new, lambda x: F.when(card, numbered(x)).otherwise(F.concat(first, x, top)))

    return walked(text, once, lambda t: _within(kind, t) == within)


def _ip(text: Column, key: Column, back: bool) -> Column:
    """Each octet keeps its width: below 10, 100 or 256."""
    parts = F.split(text, r"\.")
    sizes = F.transform(parts, lambda p: F.when(F.char_length(p) == 1, 10).when(F.char_length(p) == 2, 100).otherwise(256).cast("long"))
    moved = feistel(F.transform(parts, lambda p: p.cast("long")), sizes, key, F.concat_ws("|", F.lit("IP"), form(text)), back)
    return F.array_join(F.zip_with(moved, parts, lambda x, p: F.lpad(x.cast("string"), F.char_length(p), "0")), ".")


def _date(text: Column, key: Column, back: bool) -> Column:
    low, high = 271, 270  # 271 * 270 numbers, of which the walk keeps to the days

    def once(n: Column) -> Column:
        blocks = F.array(_div(n, F.lit(high).cast("long")), F.pmod(n, F.lit(high).cast("long")))
        return let(feistel(blocks, F.array(F.lit(low).cast("long"), F.lit(high).cast("long")), key, F.lit("DATE"), back), lambda b: F.get(b, F.lit(0)) * high + F.get(b, F.lit(1)))

    return F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), walked(_day(text).cast("long"), once, lambda n: n < DAYS).cast("int")), "yyyy-MM-dd")


def permuted(kind: Column, text: Column, secret: str, back: bool = False) -> Column:
    """The surrogate of a text by its type, or with back the text of a surrogate.  Texts of a type never share one."""
    key = F.lit(hmac.new(secret.encode(), b"permutation", hashlib.sha256).hexdigest())

    def of(t: Column) -> Column:
        kind_of = F.coalesce(kind, F.lit(""))
        own = lambda w: F.when((kind_of == "IP_ADDRESS") & w, _ip(t, key, back)).when((kind_of == "DATE_TIME") & w, _date(t, key, back)).otherwise(_by_form(kind_of, t, w, key, back))
        return F.when(t.isNotNull(), let(_within(kind_of, t), own))

    return let(text, of)
