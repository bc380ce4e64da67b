"""Bit strings, escaped payloads and length-prefixed units as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import leb128

START_CODE = "00000001"
# a pair of zero bytes before a byte of at most three
ESCAPED = "\\x00\\x00(?=[\\x00-\\x03])"


def byte(v: Column) -> Column:
    return F.unhex(F.lpad(F.hex(v), 2, "0"))


def fixed_bits(v: Column, width: int) -> Column:
    """The low bits of a value from 0 on, most significant first."""
    return F.lpad(F.bin(v), width, "0")


def rice(v: Column, k: int) -> Column:
    """Golomb-Rice code: the quotient by 2^k in ones ended by a zero, then k bits."""
    head = F.concat(F.repeat(F.lit("1"), F.call_function("shiftright", v, F.lit(k)).cast("int")), F.lit("0"))
    return F.concat(head, fixed_bits(v % (1 << k), k)) if k else head


def quasi_uniform(v: Column, n: int) -> Column:
    """Code of a value under n: the first 2^w - n values have w - 1 bits, the others w, where w is the width of n."""
    w = n.bit_length()
    short = (1 << w) - n
    long = v + short
    tail = fixed_bits(F.call_function("shiftright", long, F.lit(1)), w - 1) if w > 1 else F.lit("")
    return F.when(v < short, fixed_bits(v, w - 1) if w > 1 else F.lit("")).otherwise(F.concat(tail, (long % 2).cast("string")))


def pack(bits: Column, trailing: bool = False) -> Column:
    """Bytes of a bit string, most significant first, filled up with zeros; with `trailing` a one goes before the fill."""
    b = F.concat(bits, F.lit("1")) if trailing else bits
    n = F.ceil(F.length(b) / 8).cast("int")
    full = F.rpad(b, n * 8, "0")
    one = lambda i: F.lpad(F.conv(F.substring(full, i * 8 - 7, F.lit(8)), 2, 16), 2, "0")
    return F.when(n == 0, F.unhex(F.lit(""))).otherwise(F.unhex(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), one), "")))


def unpack(data: Column) -> Column:
    """The bit string of bytes."""
    h = F.hex(data)
    one = lambda i: F.lpad(F.conv(F.substring(h, i * 2 - 1, F.lit(2)), 16, 2), 8, "0")
    n = F.length(data)
    return F.when(n == 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), one), ""))


def _as_text(data: Column) -> Column:
    return F.decode(data, "ISO-8859-1")  # a character for each byte


def escape(data: Column) -> Column:
    """A three goes in wherever two zero bytes come before a byte of at most three."""
    return F.encode(F.regexp_replace(_as_text(data), ESCAPED, "\x00\x00\x03"), "ISO-8859-1")


def unescape(data: Column) -> Column:
    return F.encode(F.regexp_replace(_as_text(data), "\\x00\\x00\\x03", "\x00\x00"), "ISO-8859-1")


def nal_unit(kind: Column, layer: Column, temporal: Column, payload: Column) -> Column:
    """Start code, two header bytes and the escaped payload. Layers go to 55, temporal ids to 6: else an error."""
    fits = layer.between(0, 55) & temporal.between(0, 6) & kind.between(0, 31)
    header = F.concat(byte(layer), byte(kind * 8 + temporal + 1))
    checked = F.when(fits, header).otherwise(F.raise_error(F.lit("a unit's layer, temporal id or type is out of range")).cast("binary"))
    return F.concat(F.unhex(F.lit(START_CODE)), checked, escape(payload))


def obu(kind: Column, payload: Column, width: int | None = None) -> Column:
    """Length of header and payload in base 128, header byte (type in five bits above a layer of two), payload.

    With a width, lengths that fit so many groups are filled up to it, for writers that set the length afterwards.
    """
    size = F.length(payload).cast("long") + 1
    prefix = F.unhex(leb128(size))
    if width:
        group = lambda k: byte(F.call_function("shiftright", size, F.lit(7 * k)).bitwiseAND(F.lit(127)) + (128 if k + 1 < width else 0))
        prefix = F.when(size < 1 << (7 * width), F.concat(*[group(k) for k in range(width)])).otherwise(prefix)
    return F.concat(prefix, byte(kind * 4), payload)
