"""Vector functions as column expressions over array<float|double> (int8 as array<tinyint>, bits as array<tinyint> of bytes)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def _same(a: Column, b: Column, value: Column) -> Column:
    """value, or an error for vectors of different lengths."""
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vector dimensions differ")).cast("double"))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def distance_cosine(a: Column, b: Column) -> Column:
    """1 less the cosine; null for a zero vector, so that it ranks last."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return _same(a, b, F.when(norm > 0, 1 - dot(a, b) / norm))


def distance_l2(a: Column, b: Column) -> Column:
    return _same(a, b, F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))))


def distance_l1(a: Column, b: Column) -> Column:
    return _same(a, b, _sum(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))))


def distance_hamming(a: Column, b: Column) -> Column:
    """Differing bits of two byte arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.cast("int").bitwiseXOR(y.cast("int")).bitwiseAND(F.lit(255)))), F.lit(0), lambda acc, x: acc + x)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + y).cast("float"))


def sub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x - y).cast("float"))


def _wrap(x: Column) -> Column:
    """An int as a signed byte, wrapping."""
    return (F.pmod(x + 128, F.lit(256)) - 128).cast("tinyint")


def add_int8(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: _wrap(x.cast("int") + y.cast("int")))


def sub_int8(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: _wrap(x.cast("int") - y.cast("int")))


def slice_(v: Column, start: int, end: int) -> Column:
    """Elements start up to end, half open."""
    if not 0 <= start < end:
        raise ValueError("a slice needs 0 <= start < end")
    ok = F.size(v) >= end
    return F.when(ok, F.slice(v, start + 1, end - start)).otherwise(F.raise_error(F.lit("slice end is beyond the vector")).cast("array<float>"))


def normalize(v: Column) -> Column:
    """Divided by its length; the zero vector gives NaN."""
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(float("nan"))).cast("float"))


def normalize_index(v: Column) -> Column:
    """As stored in an index: computed in doubles, vectors shorter than 1e-12 unchanged."""
    n = F.sqrt(dot(v, v))
    return F.when(n < 1e-12, v.cast("array<float>")).otherwise(F.transform(v, lambda x: (x.cast("double") / n).cast("float")))


def to_json(v: Column) -> Column:
    """[%f,...] with six decimals, NaN as null.

    As C prints them: the exact binary value is rounded, ties to even, where format_string rounds the shortest decimal half
    up. Digits after the seventeenth are zeros, which floats have from 2^63 on only.
    """

    def one(x: Column) -> Column:
        whole = F.concat(x.cast("bigint").cast("string"), F.lit(".000000"))
        infinite = F.when(x > 0, "inf").otherwise("-inf")
        a = F.abs(x)
        return F.when(F.isnan(x), "null").when(a == float("inf"), infinite).when((a >= 2.0**53) & (a < 2.0**63), whole).otherwise(F.replace(F.format_number(x, 6), F.lit(",")))

    return F.concat(F.lit("["), F.array_join(F.transform(_d(v), one), ","), F.lit("]"))


def to_json_int8(v: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: x.cast("string")), ","), F.lit("]"))


def bits(v: Column, msb_first: bool = False) -> Column:
    """The bits of a byte array; each byte's lowest first, or highest first for rows of each()."""
    shifts = range(7, -1, -1) if msb_first else range(8)
    return F.flatten(F.transform(v, lambda x: F.array(*(F.shiftright(x.cast("int").bitwiseAND(F.lit(255)), s).bitwiseAND(F.lit(1)) for s in shifts))))


def to_json_bit(v: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(bits(v), lambda x: x.cast("string")), ","), F.lit("]"))


def from_json(s: Column) -> Column:
    """A float vector from JSON text."""
    return F.from_json(s, "array<float>")


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def from_blob(b: Column) -> Column:
    """A float vector from its bytes, little-endian, by arithmetic on the four bytes of each."""

    def value(w: Column) -> Column:
        sign = F.when(w >= 1 << 31, -1.0).otherwise(1.0)
        e, m = F.shiftright(w, 23).bitwiseAND(F.lit(255)), w.bitwiseAND(F.lit((1 << 23) - 1))
        special = (e == 255) & (m > 0)
        return F.when(special, F.lit(float("nan"))).otherwise(sign * F.when(e == 0, m * F.pow(F.lit(2.0), F.lit(-149.0))).otherwise((m + (1 << 23)) * F.pow(F.lit(2.0), e.cast("double") - 150))).cast("float")  # an exponent of 255 overflows to infinity

    def values(h: Column) -> Column:
        word = lambda i: F.conv(F.concat(*(F.substring(h, i * 8 + 1 + 2 * k, 2) for k in (3, 2, 1, 0))), 16, 10).cast("bigint")
        return F.transform(F.sequence(F.lit(0), (F.length(h) / 8).cast("int") - 1), lambda i: _let(word(i), value))

    return F.when(F.octet_length(b) >= 4, _let(F.hex(b), values)).otherwise(F.array().cast("array<float>"))


def to_blob(v: Column) -> Column:
    """The bytes of a float vector, little-endian, by arithmetic; what from_blob() reads. NaN keeps no payload."""
    def word(x: Column) -> Column:
        a = F.abs(x.cast("double"))
        sign = F.when((x < 0) | (x.cast("string") == "-0.0"), F.lit(1 << 31)).otherwise(F.lit(0)).cast("bigint")

        def finite(e: Column) -> Column:
            return _let((a * F.pow(F.lit(2.0), (23 - e).cast("double"))).cast("bigint"), lambda m: F.when(m < 1 << 23, m).otherwise(m - (1 << 23) + F.shiftleft((e + 127).cast("bigint"), 23)))

        def exact(e: Column) -> Column:  # the logarithm may round up or down by one
            return F.greatest(F.lit(-126), e + F.when(a >= F.pow(F.lit(2.0), (e + 1).cast("double")), 1).when(a < F.pow(F.lit(2.0), e.cast("double")), -1).otherwise(0))

        bits = _let(F.greatest(F.floor(F.log2(a)), F.lit(-126)).cast("int"), lambda e: _let(exact(e), finite))
        infinite, none = F.lit(0x7F800000).cast("bigint"), F.lit(0x7FC00000).cast("bigint")
        return sign + F.when(F.isnan(x), none).when(a == 0, F.lit(0).cast("bigint")).when(a == float("inf"), infinite).otherwise(bits)

    reversed_ = lambda h: F.concat(*(F.substring(h, k, 2) for k in (7, 5, 3, 1)))
    return F.unhex(F.array_join(F.transform(v, lambda x: _let(F.lpad(F.hex(word(x)), 8, "0"), reversed_)), ""))


def int8_vector(s: Column) -> Column:
    """A signed-byte vector from JSON text; null where an element is no integer from -128 to 127."""
    v = F.from_json(s, "array<int>")
    return F.when(F.forall(v, lambda x: x.between(-128, 127)), v.cast("array<tinyint>"))


def int8_blob(b: Column) -> Column:
    """A signed-byte vector from its bytes."""
    return _bytes(b)


def bit_blob(b: Column) -> Column:
    """A bit vector (eight bits an element) from its bytes; their number times eight is its dimension."""
    return _bytes(b)


def _bytes(b: Column) -> Column:
    of = lambda h, i: F.conv(F.substring(h, 2 * i + 1, 2), 16, 10).cast("int")
    values = lambda h: F.transform(F.sequence(F.lit(0), (F.length(h) / 2).cast("int") - 1), lambda i: _wrap(of(h, i)))
    return F.when(F.octet_length(b) > 0, _let(F.hex(b), values)).otherwise(F.array().cast("array<tinyint>"))


def quantize_int8(v: Column) -> Column:
    """From the unit range -1..1 to signed bytes, towards zero; each step is rounded to a float, as `/` alone would be a double."""
    one, step, low = (F.lit(x).cast("float") for x in (1.0, 2.0 / 255.0, 128.0))
    return F.transform(v, lambda x: (((x.cast("float") + one) / step).cast("float") - low).cast("int").cast("tinyint"))


def quantize_binary(v: Column) -> Column:
    """A byte array whose bit i, lowest first, is whether element i is over zero."""
    byte = lambda k: F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0), lambda acc, j: acc + F.when(F.get(v, k * 8 + j) > 0, F.pow(F.lit(2), j).cast("int")).otherwise(0))
    packed = F.transform(F.sequence(F.lit(0), (F.size(v) / 8).cast("int") - 1), lambda k: (F.pmod(byte(k) + 128, F.lit(256)) - 128).cast("tinyint"))
    return F.when(F.size(v) % 8 == 0, packed).otherwise(F.raise_error(F.lit("a bit vector needs a multiple of 8 elements")).cast("array<tinyint>"))


def length(v: Column) -> Column:
    return F.size(v)


def type_name(df, column: str) -> str:
    """float32, int8 or bit, by the column's type."""
    kind = df.schema[column].dataType.simpleString()
    return {"array<float>": "float32", "array<double>": "float32", "array<tinyint>": "int8", "binary": "bit"}[kind]


def each(df, vector: str, *keep: str):
    """A row (kept columns, i, value) for each element."""
    return df.select(*keep, F.posexplode(vector).alias("i", "value"))


DISTANCES = {"cosine": distance_cosine, "l2": distance_l2, "l1": distance_l1, "hamming": distance_hamming}
VERSION = "v0.1.6"
