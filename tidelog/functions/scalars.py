"""Column functions: names, hashes, references, rates, prices."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

#: Fixed values of the 32-bit FNV-1a hash.
FNV32_START, FNV32_PRIME = 2166136261, 16777619


def is_topic_name(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z0-9._-]{1,32}\z")


def is_event_name(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z0-9._-]{0,16}\z")


def is_object_key(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z0-9._/-]{1,256}\z")


def is_content_type(c: Column) -> Column:
    return c.rlike(r"^[ -~]{0,128}\z")


def fnv1a_32(c: Column) -> Column:
    """Of the text's UTF-8 bytes; 1 for a hash of 0. Bytes are read from their hex digits."""
    digits = F.hex(c.cast("binary"))
    places = F.sequence(F.lit(1), F.length(digits) - 1, F.lit(2))
    byte = lambda k: F.conv(F.substring(digits, k, F.lit(2)), 16, 10).cast("long")
    value = F.aggregate(places, F.lit(FNV32_START).cast("long"), lambda h, k: (h.bitwiseXOR(byte(k)) * FNV32_PRIME) % (1 << 32))
    return F.when(F.length(digits) == 0, F.lit(FNV32_START)).when(value == 0, 1).otherwise(value).cast("long")


def packed_ref(segment: Column, offset: Column) -> Column:
    return F.shiftleft(segment.cast("long"), 32).bitwiseOR(offset.cast("long"))


def ref_segment(ref: Column) -> Column:
    return F.shiftrightunsigned(ref, 32)


def ref_offset(ref: Column) -> Column:
    return ref.bitwiseAND(F.lit(0xFFFFFFFF))


def aligned(x: Column, a: int) -> Column:
    return (F.ceil(x / a) * a).cast("long")


def formatted_rate(rate: Column) -> Column:
    """Two decimals with G, M or K; one below a thousand. Halves go to the even digit."""
    shown = lambda over, unit: F.format_string(f"%.2f {unit}/s", F.bround(rate / over, 2))
    return F.when(rate >= 1e9, shown(1e9, "G")).when(rate >= 1e6, shown(1e6, "M")).when(rate >= 1e3, shown(1e3, "K")).otherwise(F.format_string("%.1f /s", F.bround(rate, 1)))


def discount_price(rate: Column, tenor: Column, notional: Column) -> Column:
    return notional * F.exp(-rate * tenor)


def dv01(rate: Column, tenor: Column, notional: Column, bump: float = 1e-4) -> Column:
    """Half the price's change between a basis point up and one down."""
    return (discount_price(rate + bump, tenor, notional) - discount_price(rate - bump, tenor, notional)) / 2


def interpolated(curve: Column, tenor: Column) -> Column:
    """The rate at tenor on a curve, an ordered array of (tenor, rate): flat outside, linear within."""
    n = F.size(curve)
    above = F.size(F.filter(curve, lambda p: p["tenor"] < tenor))  # points below tenor
    low, high = F.element_at(curve, F.greatest(above, F.lit(1))), F.element_at(curve, F.least(above + 1, n))
    weight = (tenor - low["tenor"]) / (high["tenor"] - low["tenor"])
    return F.when(above == 0, F.element_at(curve, 1)["rate"]).when(above == n, F.element_at(curve, -1)["rate"]).otherwise(low["rate"] + weight * (high["rate"] - low["rate"]))


#: Fixed values of the 64-bit FNV-1a hash.
FNV64_START, FNV64_PRIME = 14695981039346656037, 1099511628211


def fnv1a_64(c: Column) -> Column:
    """Of the text's UTF-8 bytes, unsigned, as a decimal: Spark has no unsigned 64-bit type."""
    digits = F.hex(c.cast("binary"))
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(digits) - 1, F.lit(1)), F.lit(2)), lambda k: k < F.length(digits))
    wide = "decimal(38,0)"
    byte = lambda k: F.conv(F.substring(digits, k, F.lit(2)), 16, 10).cast("int")
    low = lambda h: (h % 256).cast("int")
    step = lambda h, k: (((h - low(h) + low(h).bitwiseXOR(byte(k))).cast("decimal(20,0)") * F.lit(Decimal(FNV64_PRIME)).cast("decimal(13,0)")) % F.lit(Decimal(1 << 64)).cast("decimal(20,0)")).cast(wide)
    return F.aggregate(places, F.lit(Decimal(FNV64_START)).cast(wide), step).cast("decimal(20,0)")


def first_parameter(query: Column, name: str) -> Column:
    """The first value of a name in a=b&c=d; nothing is decoded. Null where it is missing."""
    pairs = F.filter(F.split(query, "&"), lambda p: F.substring_index(p, "=", 1) == name)
    return F.get(F.transform(pairs, lambda p: F.substring(p, F.lit(len(name) + 2), F.length(p))), 0)


def manifest_length(chunks: Column, batches: Column, kept: Column) -> Column:
    return 64 + 24 * chunks + 4 * batches + 16 * kept


def segments_per_manifest(capacity: Column) -> Column:
    return F.greatest(F.floor((capacity - 64) / 28), F.lit(0)).cast("long")


def admitted_type(kind: DataType) -> bool:
    """Whether a store takes columns of a type: maps and variants are refused, at any depth."""
    if isinstance(kind, (MapType, VariantType)):
        return False
    if isinstance(kind, ArrayType):
        return admitted_type(kind.elementType)
    return all(admitted_type(f.dataType) for f in kind) if isinstance(kind, StructType) else True
