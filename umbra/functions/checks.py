"""Check digits and checksums of identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let

# The alphabets of the two address forms, the generators of bech32, and what its two versions leave.
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
GENERATORS = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)
BECH32_LEFT, BECH32M_LEFT = 1, 0x2BC830A3
#: Bits of a limb of a decoded address, and limbs: seven of them hold the 25 bytes.
LIMB, LIMBS = 32, 7


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def mod97(text: Column) -> Column:
    """The remainder by 97 of digits and letters (A is 10, Z is 35) read as one decimal number."""

    def step(a: Column, c: Column) -> Column:
        digit = c.cast("int")
        return F.when(c <= "9", F.pmod(a * 10 + digit, F.lit(97))).otherwise(F.pmod(a * 100 + F.ascii(c) - 55, F.lit(97)))

    return F.aggregate(characters(text), F.lit(0), step)


def iban(text: Column) -> Column:
    """Whether a bank account number keeps its check: the first four characters, moved to the end, leave 1 by 97."""
    return F.char_length(text).between(15, 34) & (mod97(F.concat(F.substring(text, 5, 34), F.substring(text, 1, 4))) == 1)


def bech32(address: Column) -> Column:
    """Whether an address of the form bc1... keeps its checksum, of either version by its first character."""
    values = F.transform(characters(F.substring(address, 4, 100)), lambda c: F.instr(F.lit(BECH32), c) - 1)
    start = 1
    for v in (3, 3, 0, 2, 3):  # what stands for "bc" before the data
        start = _polymod(start, v)

    def step(a: Column, v: Column) -> Column:
        top = F.shiftright(a, 25)
        out = F.shiftleft(a.bitwiseAND(F.lit(0x1FFFFFF).cast("long")), 5).bitwiseXOR(v.cast("long"))
        for i, g in enumerate(GENERATORS):
            out = out.bitwiseXOR(F.when(F.shiftright(top, i).bitwiseAND(F.lit(1).cast("long")) == 1, F.lit(g).cast("long")).otherwise(F.lit(0).cast("long")))
        return out

    left = F.aggregate(values, F.lit(start).cast("long"), step)
    wanted = F.when(F.substring(address, 4, 1) == "q", BECH32_LEFT).otherwise(BECH32M_LEFT)
    return F.forall(values, lambda v: v >= 0) & (left == wanted)


def _polymod(a: int, v: int) -> int:
    top, a = a >> 25, ((a & 0x1FFFFFF) << 5) ^ v
    for i, g in enumerate(GENERATORS):
        a ^= g if top >> i & 1 else 0
    return a


def base58_hex(address: Column) -> Column:
    """The 25 bytes of an address in base 58, as hexadecimal digits; null if it has more, or another character."""

    def digit(limbs: Column, v: Column) -> Column:
        """limbs * 58 + v, the lowest first."""
        begin = F.struct(v.cast("long").alias("carry"), F.array().cast("array<long>").alias("out"))

        def add(a: Column, x: Column) -> Column:
            return let(x * 58 + a["carry"], lambda s: F.struct(F.shiftright(s, LIMB).alias("carry"), F.concat(a["out"], F.array(s.bitwiseAND(F.lit((1 << LIMB) - 1).cast("long")))).alias("out")))

        return F.aggregate(limbs, begin, add, lambda a: a["out"])

    values = F.transform(characters(address), lambda c: F.instr(F.lit(BASE58), c) - 1)
    zero = F.array(*[F.lit(0)] * LIMBS).cast("array<long>")
    limbs = F.aggregate(values, zero, digit)
    whole = F.array_join(F.transform(F.reverse(limbs), lambda x: F.lpad(F.lower(F.hex(x)), 2 * LIMB // 8, "0")), "")
    extra = 2 * (LIMBS * LIMB // 8 - 25)
    fits = F.forall(values, lambda v: v >= 0) & F.substring(whole, 1, extra).rlike("^0*$")
    return F.when(fits, F.substring(whole, extra + 1, 50))


def base58check(address: Column) -> Column:
    """Whether an address in base 58 ends with the first four bytes of the digest of its digest."""
    twice = lambda h: F.sha2(F.unhex(F.sha2(F.unhex(F.substring(h, 1, 42)), 256)), 256)
    return F.coalesce(let(base58_hex(address), lambda h: F.substring(twice(h), 1, 8) == F.substring(h, 43, 8)), F.lit(False))


def crypto(address: Column) -> Column:
    return F.when(address.startswith("bc1"), bech32(address)).otherwise(base58check(address))
