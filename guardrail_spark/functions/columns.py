"""Validators, hashes and statistics as column expressions: no Python runs on executors."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VALIDATORS = {}


def _validator(name: str):
    def add(f):
        VALIDATORS[name] = f
        return f

    return add


@_validator("luhn")
def luhn_ok(c: Column) -> Column:
    """Luhn checksum over the digits, of which there are 13 or more."""
    digits = F.regexp_replace(c, r"[^0-9]", "")
    return (F.length(digits) >= 13) & F.call_function("luhn_check", digits)


@_validator("aba_checksum")
def aba_ok(c: Column) -> Column:
    """Nine digits whose sum weighted 3, 7, 1 is a multiple of ten."""
    digits = F.regexp_replace(c, r"[^0-9]", "")
    total = sum((F.try_to_number(F.substring(digits, i + 1, 1), F.lit("9")).cast("int") * (3, 7, 1)[i % 3] for i in range(9)), F.lit(0))
    return F.when(F.length(digits) == 9, total % 10 == 0).otherwise(False)


@_validator("iban_checksum")
def iban_ok(c: Column) -> Column:
    """Remainder 1 modulo 97 once the first four characters stand last and letters count from 10."""
    s = F.upper(F.regexp_replace(c, r"\s", ""))
    turned = F.concat(F.substr(s, F.lit(5)), F.substring(s, 1, 4))

    def step(a: Column, x: Column) -> Column:
        code = F.ascii(x)
        letter = code >= 65
        return (a * F.when(letter, 100).otherwise(10) + F.when(letter, code - 55).otherwise(code - 48)) % 97

    rest = F.aggregate(F.filter(F.split(turned, ""), lambda x: x != ""), F.lit(0).cast("long"), step)
    return F.when((F.length(s) >= 15) & s.rlike("^[A-Z0-9]+$"), rest == 1).otherwise(False)


@_validator("jwt_structural")
def jwt_ok(c: Column) -> Column:
    parts = F.split(c, r"\.")
    return (F.size(parts) == 3) & F.forall(parts, lambda p: F.length(p) >= 4)


def shannon_entropy(c: Column) -> Column:
    """Bits for each byte of the UTF-8 text; where there are other than ASCII characters, bytes are counted as hexadecimal
    pairs."""

    def bits(counts: Column, n: Column) -> Column:
        return F.aggregate(counts, F.lit(0.0), lambda a, k: a - k / n * F.log2(k / n))

    chars = F.filter(F.split(c, ""), lambda x: x != "")
    plain = F.transform(F.array_distinct(chars), lambda x: (F.length(c) - F.length(F.replace(c, x, F.lit("")))).cast("double"))
    pairs = F.array(F.regexp_extract_all(F.hex(c.cast("binary")), F.lit(".."), F.lit(0)))
    counted = F.get(F.transform(pairs, lambda p: F.transform(F.array_distinct(p), lambda x: F.size(F.filter(p, lambda y: y == x)).cast("double"))), F.lit(0))
    n = F.octet_length(c)
    return F.when(n == F.length(c), bits(plain, n)).otherwise(bits(counted, n))


def text_hash(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of c, with c evaluated once."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def canonical_double(c: Column) -> Column:
    """JSON text of a double: whole ones within 1e15 as integers, others with the fewest digits that give the double back,
    as plain decimals between 1e-4 and 1e16 and with an exponent of two digits or more beyond. Null and what is not finite
    give null. The digits are Java's where 17 are needed; before Java 19 a few numbers beyond 1e17 come out as a neighbour
    of the nearest text, which gives the same double back."""

    def shortest(v: Column) -> Column:
        digits = lambda n: F.format_string(f"%.{n - 1}e", v)
        fits = lambda n: digits(n).cast("double") == v
        tiny = F.coalesce(*[F.when(fits(n), digits(n)) for n in range(1, 17)], digits(17))  # fewer than 15 digits tell these apart
        # of 16 digits, those next to the 17: rounding these may lead to the neighbour that isn't the same double
        head, tail = F.regexp_extract(digits(17), r"^(.*)\d(e.*)$", 1), F.regexp_extract(digits(17), "e.*$", 0)
        down = F.concat(head, tail)
        up = F.concat(F.left(head, F.length(head) - 1), (F.right(head, F.lit(1)).cast("int") + 1).cast("string"), tail)
        near = F.coalesce(*[F.when(t.cast("double") == v, t) for t in (digits(16), down)], F.when(~F.endswith(head, F.lit("9")) & (up.cast("double") == v), up), digits(17))
        return F.when(F.abs(v) < 2.2250738585072014e-308, tiny).when(fits(15), digits(15)).otherwise(near)

    def laid_out(t: Column) -> Column:
        power = F.substring_index(t, "e", -1).cast("int")
        sign = F.when(F.startswith(t, F.lit("-")), "-").otherwise("")
        digits = F.regexp_replace(F.regexp_replace(F.substring_index(t, "e", 1), "[-.]", ""), "(?<=.)0+$", "")
        front, rest = F.substr(digits, F.lit(1), power + 1), F.substr(digits, power + 2)
        plain = F.when(power < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -1 - power), digits)).otherwise(F.concat(F.rpad(front, power + 1, F.lit("0")), F.lit("."), F.when(rest == "", "0").otherwise(rest)))
        tail = F.substr(digits, F.lit(2))
        mantissa = F.concat(F.left(digits, F.lit(1)), F.when(tail != "", F.concat(F.lit("."), tail)).otherwise(""))
        scientific = F.concat(mantissa, F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
        return F.concat(sign, F.when(power.between(-4, 15), plain).otherwise(scientific))

    def text(v: Column) -> Column:
        finite = ~F.isnan(v) & (F.abs(v) < float("inf"))
        return F.when((v == F.floor(v)) & (F.abs(v) <= 1e15), F.floor(v).cast("string")).when(finite, let(shortest(v), laid_out))

    return let(c.cast("double"), text)


_NUMBER = r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?"
_TOKENS = rf'("(?:[^"\\]|\\.)*"|{_NUMBER}(?![\w.+-])|[^"\d-]+|.)'


def marked_json(json: Column) -> Column:
    """JSON text with canonical numbers as strings that begin with n, and strings and keys that begin with s, so that numbers
    keep all their digits where it is parsed; text that is no JSON stays none."""

    def marked(t: Column) -> Column:
        number = F.when(t.rlike(r"^-?\d+$"), F.when(t == "-0", "0").otherwise(t)).otherwise(canonical_double(t.try_cast("double")))
        return F.when(F.startswith(t, F.lit('"')), F.concat(F.lit('"s'), F.substr(t, F.lit(2)))).when(t.rlike(f"^{_NUMBER}$"), F.coalesce(F.concat(F.lit('"n'), number, F.lit('"')), F.lit("{"))).otherwise(t)

    return F.array_join(F.transform(F.regexp_extract_all(json, F.lit("(?s)" + _TOKENS), F.lit(1)), marked), "")


def unmarked_json(text: Column) -> Column:
    """Marked text as canonical JSON again."""
    text = F.regexp_replace(text, r'"n([^"]*)"|(")s((?:[^"\\]|\\.)*")', "$1$2$3")
    # control characters in lower-case hexadecimal digits
    for x in "ABCDEF":
        text = F.regexp_replace(text, rf"(?<!\\)((?:\\\\)*\\u00[01]){x}", "$1" + x.lower())
    return text


def canonical_json_text(json: Column) -> Column:
    """Canonical text of JSON text of any shape: keys sorted at every level, no blanks, whole numbers of any length as they
    are, others as canonical_double has them; null where it is no JSON or a number isn't finite. An object that has a key
    twice is an error, null, unless the session sets spark.sql.variant.allowDuplicateKeys; then the last one counts (see
    last_key_counts)."""
    return unmarked_json(F.to_json(F.try_parse_json(marked_json(json))))


@contextmanager
def last_key_counts(spark: SparkSession) -> Iterator[None]:
    """While plans are made in it, JSON objects that have a key twice are read with the last one."""
    name = "spark.sql.variant.allowDuplicateKeys"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def canonical_ts(c: Column) -> Column:
    """UTC text with a fraction only if there is one."""
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(c, "SSSSSS")
    return F.concat(whole, F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)), F.lit("Z"))


def json_text(c: Column) -> Column:
    """A string as JSON text; null stays null."""
    return F.when(c.isNotNull(), F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1))


def canonical_value(c: Column, kind: T.DataType) -> Column:
    """Canonical JSON text of a value of any nested type: keys sorted at every level, no blanks, nulls kept, integral floats
    as integers, timestamps in UTC."""
    null = lambda x: F.coalesce(x, F.lit("null"))
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        parts = [F.concat(F.lit(json.dumps(f.name, ensure_ascii=False) + ":"), canonical_value(c.getField(f.name), f.dataType)) for f in fields]
        return null(F.when(c.isNotNull(), F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))))
    if isinstance(kind, T.ArrayType):
        return null(F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: canonical_value(x, kind.elementType)), ","), F.lit("]")))
    if isinstance(kind, T.MapType):
        entries = F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(e["key"].cast("string").alias("k"), canonical_value(e["value"], kind.valueType).alias("v"))))
        return null(F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(json_text(e["k"]), F.lit(":"), e["v"])), ","), F.lit("}")))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return null(canonical_double(c))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return null(F.concat(F.lit('"'), canonical_ts(c), F.lit('"')))
    if isinstance(kind, (T.StringType, T.DateType)):
        return null(json_text(c.cast("string")))
    return null(c.cast("string"))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the interval of a share k / n, within [0, 1]; (0, 1) without observations."""
    m = F.when(n > 0, n).cast("double")
    p = k / m
    scale = 1 + z * z / m
    centre = (p + z * z / (2 * m)) / scale
    half = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / scale
    low, high = F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)
    return F.when(n > 0, low).otherwise(0.0), F.when(n > 0, high).otherwise(1.0)


def bump_patch(c: Column) -> Column:
    """major.minor.patch with the patch raised; any other version gets `.1`."""
    parts = F.split(c, r"\.")
    ok = c.rlike(r"^[^.]*\.[^.]*\.[0-9]{1,9}$")
    return F.when(ok, F.concat_ws(".", parts[0], F.get(parts, F.lit(1)), (F.get(parts, F.lit(2)).try_cast("int") + 1).cast("string"))).otherwise(F.concat(c, F.lit(".1")))
