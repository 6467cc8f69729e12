"""Vector functions as Column builders, and their SQL names (vec_*).

float32 vectors are ARRAY<FLOAT>, int8 vectors ARRAY<TINYINT>, bit vectors ARRAY<BIGINT> of 64-bit words (bit i of a
vector is bit i % 64 of word i / 64) or BINARY at the edges (bit i is bit i % 8 of byte i / 8). Sums are in double.
A null vector gives null; two vectors of different or no dimensions raise.
"""

from __future__ import annotations

import struct

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

VERSION = "0.1.0"
#: A step of the unit quantiser, as a 32-bit float.
STEP = struct.unpack("<f", struct.pack("<f", 2.0 / 255.0))[0]
#: From here on doubles have no fraction.
WHOLE = 2.0**53
#: 32-bit floats end before.
BEYOND = 2.0**128


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def matched(a: Column, b: Column, out: Column) -> Column:
    """out where a and b have the same dimensions, null where one is null; else an error."""
    return (
        F.when(a.isNull() | b.isNull(), None)
        .when((F.size(a) == F.size(b)) & (F.size(a) > 0), out)
        .otherwise(F.raise_error(F.concat(F.lit("vector dimensions differ: "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string"))))
    )


def bound(value: Column, body) -> Column:
    """body(value) with value computed once, though body may use it for each element of an array."""
    return F.transform(F.array(value), body)[0]


def distance_l2(a: Column, b: Column) -> Column:
    return matched(a, b, F.sqrt(total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))))


def distance_l1(a: Column, b: Column) -> Column:
    return matched(a, b, total(F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y))))


def dot(a: Column, b: Column) -> Column:
    return matched(a, b, total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y)))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(doubles(v), lambda x: x * x)))


def distance_cosine(a: Column, b: Column) -> Column:
    """1 - cosine; NaN where either vector is zero."""
    length = norm(a) * norm(b)
    return F.when(length == 0, F.lit(float("nan"))).otherwise(1 - dot(a, b) / length)


def distance_hamming(a: Column, b: Column) -> Column:
    """Differing bits of two bit vectors (words)."""
    return matched(a, b, F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x).cast("long"))


DISTANCES = {"l2": distance_l2, "l1": distance_l1, "cosine": distance_cosine, "hamming": distance_hamming}


def _elementwise(a: Column, b: Column, sign: int, element: str) -> Column:
    if element == "int8":  # wraps around
        wide = F.zip_with(a, b, lambda x, y: F.pmod(x.cast("int") + sign * y.cast("int") + 128, F.lit(256)) - 128)
        return matched(a, b, wide.cast("array<tinyint>"))
    if element != "float32":
        raise ValueError(f"no arithmetic on {element} vectors")
    return matched(a, b, F.zip_with(doubles(a), doubles(b), lambda x, y: x + sign * y).cast("array<float>"))


def add(a: Column, b: Column, element: str = "float32") -> Column:
    return _elementwise(a, b, 1, element)


def sub(a: Column, b: Column, element: str = "float32") -> Column:
    return _elementwise(a, b, -1, element)


def slice(v: Column, start: int, end: int) -> Column:  # noqa: A001
    """Elements start (from 0) up to end, which isn't included. Bounds outside the vector raise."""
    if start < 0 or end < 0 or start >= end:
        raise ValueError(f"no slice from {start} to {end}")
    return F.when(v.isNull(), None).when(F.size(v) >= end, F.slice(v, start + 1, end - start)).otherwise(F.raise_error(F.lit("slice ends beyond the vector")))


def slice_bits(words: Column, start: int, end: int) -> Column:
    """Bits start up to end of a bit vector; both must be multiples of 8. Bits beyond the end in the last word are 0."""
    if start % 8 or end % 8 or start < 0 or start >= end:
        raise ValueError(f"no bit slice from {start} to {end}: both ends must be multiples of 8")
    first, shift, count = start // 64, start % 64, -(-(end - start) // 64)
    left, right = (lambda x, n, f=f: F.call_function(f, x, F.lit(n)) for f in ("shiftleft", "shiftrightunsigned"))
    out = []
    for i in range(count):
        low = F.get(words, F.lit(first + i))
        word = low if not shift else right(low, shift).bitwiseOR(left(F.coalesce(F.get(words, F.lit(first + i + 1)), F.lit(0).cast("long")), 64 - shift))
        rest = end - start - 64 * i
        out.append(word if rest >= 64 else word.bitwiseAND(F.lit((1 << rest) - 1).cast("long")))
    return F.when(words.isNull(), None).when(F.size(words) * 64 >= end, F.array(*out)).otherwise(F.raise_error(F.lit("slice ends beyond the vector")))


def normalize(v: Column) -> Column:
    """v divided by its length; a zero vector gives NaNs."""
    unit = bound(norm(v), lambda n: F.transform(doubles(v), lambda x: F.when(n == 0, F.lit(float("nan"))).otherwise(x / n)))
    return F.when(v.isNull(), None).otherwise(unit.cast("array<float>"))


def quantize_binary(v: Column) -> Column:
    """Bit i is set where element i > 0; the dimension must be a multiple of 8."""
    def word(w: Column) -> Column:
        bit = lambda i: F.when(F.get(v, w * 64 + i) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda s, i: s.bitwiseOR(bit(i)))

    words = F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / 64).cast("int") - 1), word)
    return F.when(v.isNull(), None).when((F.size(v) > 0) & (F.size(v) % 8 == 0), words).otherwise(F.raise_error(F.lit("the dimension must be a multiple of 8")))


def quantize_int8(v: Column, kind: str = "unit") -> Column:
    """Elements of [-1, 1] in 255 steps, cut toward zero and clamped to [-128, 127]; NaN becomes 127."""
    if kind != "unit":
        raise ValueError("only 'unit' is known")
    step = lambda x: F.when(F.isnan(x), F.lit(127.0)).otherwise(F.greatest(F.lit(-128.0), F.least(F.lit(127.0), (x + 1) / F.lit(STEP) - 128)))
    return F.transform(doubles(v), lambda x: step(x).cast("tinyint"))


def whole_digits(x: Column) -> Column:
    """The digits of |x|, a whole number from 10^10 up to 2^128, of which Spark's casts keep 17: |x| is a * 2^64 + b, in decimals of
    32-bit pieces, and 2^64 is 1844674407 * 10^10 + 3709551616."""
    size, piece = F.abs(x), "decimal(10,0)"
    at = lambda n: ((size % 2.0 ** (n + 32) - size % 2.0**n) / 2.0**n).cast(piece)
    number = lambda n: F.lit(n).cast(piece)
    a, b = (at(n + 32) * number(2**32) + at(n) for n in (64, 0))
    low, ten = a * number(3709551616) + b, F.lit(10**10).cast("decimal(11,0)")
    return F.concat((a * number(1844674407) + F.call_function("div", low, ten)).cast("string"), F.lpad((low % ten).cast("string"), 10, "0"))


def six_decimals(x: Column) -> Column:
    """x, a 32-bit float, as C's %.6f writes it: a tie, such as 9/128, goes to the even digit, where format_string goes away from
    zero, and what has no fraction (2^53 and beyond) has all its digits. Infinity, null and larger doubles are format_string's."""
    whole = F.concat(F.when(x < 0, "-").otherwise(""), whole_digits(x), F.lit(".000000"))
    return F.when(F.abs(x) < WHOLE, F.call_function("format_number", x, F.lit("0.000000"))).when(F.abs(x) < BEYOND, whole).otherwise(F.format_string("%.6f", x))


def to_json(v: Column) -> Column:
    """[x,y,...] with six decimals, ties to even; NaN as null."""
    each = F.transform(doubles(v), lambda x: F.when(F.isnan(x), F.lit("null")).otherwise(six_decimals(x)))
    return F.when(v.isNull(), None).otherwise(F.concat(F.lit("["), F.array_join(each, ","), F.lit("]")))


def bits_to_json(words: Column, dim: int) -> Column:
    return bound(words, lambda w: _bits_to_json(w, dim))


def _bits_to_json(words: Column, dim: int) -> Column:
    bit = lambda i: F.call_function("shiftright", words[F.floor(i / 64).cast("int")], i % 64).bitwiseAND(F.lit(1).cast("long")).cast("string")
    return F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), bit), ","), F.lit("]"))


def f32(x: Column) -> Column:
    """A float32 vector of JSON text. Commas may lack or trail, and what follows the bracket is ignored; no number or other text raises."""
    body = F.regexp_extract(x, r"^\s*\[([^\]]*)", 1)
    ok = x.rlike(r"^\s*\[[-+\s,0-9.eE]*(\]|$)") & body.rlike("[0-9]")
    numbers = F.regexp_extract_all(body, F.lit(r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"), F.lit(0))
    return F.when(x.isNull(), None).when(ok, numbers.cast("array<double>").cast("array<float>")).otherwise(F.raise_error(F.lit("not a vector")))


def f32_blob(x: Column) -> Column:
    """A float32 vector of little-endian bytes: sign, exponent and fraction are put together in columns."""
    def one(i: Column) -> Column:
        byte = lambda k: F.conv(F.hex(F.substring(x, i * 4 + k + 1, F.lit(1))), 16, 10).cast("long")
        code = byte(0) + byte(1) * 256 + byte(2) * 65536 + byte(3) * 16777216
        sign = F.when(code >= 2147483648, F.lit(-1.0)).otherwise(F.lit(1.0))
        exponent, fraction = F.floor(code / 8388608) % 256, code % 8388608
        number = (
            F.when((exponent == 255) & (fraction > 0), F.lit(float("nan"))).when(exponent == 255, F.lit(float("inf")))
            .when(exponent == 0, fraction * F.lit(2.0**-149)).otherwise((fraction + 8388608) * F.pow(F.lit(2.0), exponent - 150))
        )
        return (sign * number).cast("float")

    n = F.octet_length(x)
    return F.when(x.isNull(), None).when((n > 0) & (n % 4 == 0), F.transform(F.sequence(F.lit(0), (n / 4).cast("int") - 1), one)).otherwise(
        F.raise_error(F.lit("a float32 vector has 4 bytes an element")))


def int8(x: Column) -> Column:
    """An int8 vector of JSON text or of an array of integers; elements outside [-128, 127] raise."""
    return F.transform(x, lambda v: F.when(v.between(-128, 127), v.cast("tinyint")).otherwise(F.raise_error(F.lit("not an int8"))))


def int8_json(x: Column) -> Column:
    return int8(F.from_json(x, "array<int>", {"mode": "FAILFAST"}))


def bit(x: Column) -> Column:
    """The words of a bit vector of bytes."""
    def word(w: Column) -> Column:
        byte = lambda k: F.coalesce(F.conv(F.nullif(F.hex(F.substring(x, w * 8 + k + 1, F.lit(1))), F.lit("")), 16, 10).cast("long"), F.lit(0).cast("long"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0).cast("long"), lambda s, k: s.bitwiseOR(F.call_function("shiftleft", byte(k), k * 8)))

    return F.when(x.isNull(), None).when(F.octet_length(x) > 0, F.transform(F.sequence(F.lit(0), F.ceil(F.octet_length(x) / 8).cast("int") - 1), word)).otherwise(
        F.raise_error(F.lit("a bit vector has a byte at least")))


def length(v: Column, element: str = "float32") -> Column:
    """Dimensions: elements of an array ("float32", "int8"), bits of a bit vector of BINARY ("bit") or of words ("words")."""
    return F.octet_length(v) * 8 if element == "bit" else F.size(v) * (64 if element == "words" else 1)


def element_type(kind: str) -> str:
    """The element type of a column's Spark type."""
    types = {"array<float>": "float32", "array<double>": "float32", "array<tinyint>": "int8", "array<bigint>": "bit", "binary": "bit"}
    if kind not in types:
        raise ValueError(f"{kind} is no vector type")
    return types[kind]


def type(df, column: str) -> Column:  # noqa: A001
    return F.lit(element_type(df.schema[column].dataType.simpleString()))


def each(df, vector: str, element: str = "float32"):
    """A row for each element: df's columns, rowid (from 0) and value. Bits of BINARY come from each byte's highest down."""
    if element != "bit":
        return df.select("*", F.posexplode(vector).alias("rowid", "value"))
    ids = F.sequence(F.lit(0), F.octet_length(vector) * 8 - 1)
    byte = F.conv(F.hex(F.substring(F.col(vector), F.floor(F.col("rowid") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    out = df.where(F.octet_length(vector) > 0).select("*", F.explode(ids).alias("rowid"))
    return out.withColumn("value", F.call_function("shiftright", byte, 7 - F.col("rowid") % 8).bitwiseAND(1))


def _sql_matched(out: str) -> str:
    """As `matched`: out for two vectors of one dimension."""
    return (f"CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN size(a) = size(b) AND size(a) > 0 THEN {out} "
            "ELSE raise_error(concat('vector dimensions differ: ', size(a), ' and ', size(b))) END")


def _sql_whole_digits() -> str:
    """As `whole_digits` of x."""
    at = lambda n: f"cast((abs(x) % {2.0 ** (n + 32)!r}D - abs(x) % {2.0**n!r}D) / {2.0**n!r}D AS DECIMAL(10, 0))"
    a, b = (f"({at(n + 32)} * 4294967296BD + {at(n)})" for n in (64, 0))
    low = f"({a} * 3709551616BD + {b})"
    return f"concat(cast({a} * 1844674407BD + {low} div 10000000000BD AS STRING), lpad(cast({low} % 10000000000BD AS STRING), 10, '0'))"


_SUM = "aggregate({}, 0D, (s, x) -> s + x)"
_SQUARES = "transform({v}, x -> x * x)"
#: SQL functions: signature and body, which do what the Columns above do, errors included. Parameters have one type each, so
#: what takes several types has a name for each.
SQL = {
    "vec_version() RETURNS STRING": f"'{VERSION}'",
    "vec_length(v ARRAY<DOUBLE>) RETURNS INT": "size(v)",
    "vec_length_bit(v BINARY) RETURNS INT": "octet_length(v) * 8",
    "vec_type(kind STRING) RETURNS STRING":
        "CASE WHEN kind IS NULL THEN NULL WHEN kind IN ('array<float>', 'array<double>') THEN 'float32' WHEN kind = 'array<tinyint>' THEN 'int8' "
        "WHEN kind IN ('array<bigint>', 'binary') THEN 'bit' ELSE raise_error(concat(kind, ' is no vector type')) END",
    "vec_debug() RETURNS STRING": f"concat('Version: {VERSION}', chr(10), 'Spark: ', version())",
    "vec_dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": _sql_matched(_SUM.format("zip_with(a, b, (x, y) -> x * y)")),
    "vec_distance_l2(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": _sql_matched(f"sqrt({_SUM.format('zip_with(a, b, (x, y) -> (x - y) * (x - y))')})"),
    "vec_distance_l1(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": _sql_matched(_SUM.format("zip_with(a, b, (x, y) -> abs(x - y))")),
    "vec_norm(v ARRAY<DOUBLE>) RETURNS DOUBLE": f"sqrt({_SUM.format(_SQUARES.format(v='v'))})",
    "vec_distance_cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE":
        _sql_matched("if(vec_norm(a) * vec_norm(b) = 0, double('NaN'), 1 - vec_dot(a, b) / (vec_norm(a) * vec_norm(b)))"),
    "vec_distance_hamming(a ARRAY<BIGINT>, b ARRAY<BIGINT>) RETURNS BIGINT": _sql_matched("aggregate(zip_with(a, b, (x, y) -> bit_count(x ^ y)), 0L, (s, x) -> s + x)"),
    "vec_add(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS ARRAY<FLOAT>": _sql_matched("cast(zip_with(a, b, (x, y) -> x + y) AS ARRAY<FLOAT>)"),
    "vec_sub(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS ARRAY<FLOAT>": _sql_matched("cast(zip_with(a, b, (x, y) -> x - y) AS ARRAY<FLOAT>)"),
    "vec_add_int8(a ARRAY<TINYINT>, b ARRAY<TINYINT>) RETURNS ARRAY<TINYINT>": _sql_matched("zip_with(a, b, (x, y) -> cast(pmod(int(x) + int(y) + 128, 256) - 128 AS TINYINT))"),
    "vec_sub_int8(a ARRAY<TINYINT>, b ARRAY<TINYINT>) RETURNS ARRAY<TINYINT>": _sql_matched("zip_with(a, b, (x, y) -> cast(pmod(int(x) - int(y) + 128, 256) - 128 AS TINYINT))"),
    "vec_slice(v ARRAY<DOUBLE>, lo INT, hi INT) RETURNS ARRAY<FLOAT>":
        "CASE WHEN v IS NULL THEN NULL WHEN lo < 0 OR hi < 0 OR lo >= hi THEN raise_error(concat('no slice from ', lo, ' to ', hi)) "
        "WHEN size(v) >= hi THEN cast(slice(v, lo + 1, hi - lo) AS ARRAY<FLOAT>) ELSE raise_error('slice ends beyond the vector') END",
    "vec_normalize(v ARRAY<DOUBLE>) RETURNS ARRAY<FLOAT>":
        "cast(transform(array(vec_norm(v)), n -> transform(v, x -> if(n = 0, double('NaN'), x / n)))[0] AS ARRAY<FLOAT>)",
    "vec_quantize_binary(v ARRAY<DOUBLE>) RETURNS ARRAY<BIGINT>":
        "CASE WHEN v IS NULL THEN NULL WHEN size(v) > 0 AND size(v) % 8 = 0 THEN transform(sequence(0, int(ceil(size(v) / 64)) - 1), w -> aggregate(sequence(0, 63), 0L, "
        "(s, i) -> s | if(get(v, w * 64 + i) > 0, shiftleft(1L, i), 0L))) ELSE raise_error('the dimension must be a multiple of 8') END",
    "vec_quantize_int8(v ARRAY<DOUBLE>, kind STRING) RETURNS ARRAY<TINYINT>":
        "CASE WHEN kind <> 'unit' THEN raise_error('only unit is known') ELSE transform(v, x -> cast(if(isnan(x), 127D, "
        f"greatest(-128D, least(127D, (x + 1) / {STEP!r}D - 128))) AS TINYINT)) END",
    "vec_to_json(v ARRAY<DOUBLE>) RETURNS STRING":
        "concat('[', array_join(transform(v, x -> CASE WHEN isnan(x) THEN 'null' "
        f"WHEN abs(x) < {WHOLE!r}D THEN format_number(x, '0.000000') WHEN abs(x) < {BEYOND!r}D THEN concat(if(x < 0, '-', ''), {_sql_whole_digits()}, '.000000') "
        "ELSE format_string('%.6f', x) END), ','), ']')",
    "vec_f32(x STRING) RETURNS ARRAY<FLOAT>":
        r"CASE WHEN x IS NULL THEN NULL WHEN x RLIKE r'^\s*\[[-+\s,0-9.eE]*(\]|$)' AND regexp_extract(x, r'^\s*\[([^\]]*)', 1) RLIKE '[0-9]' THEN "
        r"cast(cast(regexp_extract_all(regexp_extract(x, r'^\s*\[([^\]]*)', 1), r'[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?', 0) AS ARRAY<DOUBLE>) AS ARRAY<FLOAT>) "
        "ELSE raise_error('not a vector') END",
    "vec_int8(x STRING) RETURNS ARRAY<TINYINT>":
        "transform(from_json(x, 'array<int>', map('mode', 'FAILFAST')), v -> CASE WHEN v BETWEEN -128 AND 127 THEN cast(v AS TINYINT) ELSE raise_error('not an int8') END)",
    "vec_bit(x BINARY) RETURNS ARRAY<BIGINT>":
        "CASE WHEN x IS NULL THEN NULL WHEN octet_length(x) > 0 THEN transform(sequence(0, int(ceil(octet_length(x) / 8)) - 1), w -> aggregate(sequence(0, 7), 0L, "
        "(s, k) -> s | shiftleft(coalesce(cast(conv(nullif(hex(substring(x, w * 8 + k + 1, 1)), ''), 16, 10) AS BIGINT), 0L), k * 8))) "
        "ELSE raise_error('a bit vector has a byte at least') END",
    "vec_each(v ARRAY<DOUBLE>) RETURNS TABLE(rowid INT, value DOUBLE)": "SELECT pos, col FROM posexplode(v)",
}


def register(spark: SparkSession) -> None:
    """Make the SQL functions known in the session: vec_*, and the table functions vec_each(v) and npy_each(path)."""
    from tessera.sources.npy import NpyEach

    for signature, body in SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    spark.udtf.register("npy_each", udtf(NpyEach, returnType="rowid bigint, vector array<float>"))
