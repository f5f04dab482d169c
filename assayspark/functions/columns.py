"""Column expressions that several operators share; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's float() reads and Spark's cast reads alike; guards the cast against suffixes such as 5d.
NUMBER = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])$"
DUPLICATE = r"^(.*)\{\{\{.*\}\}\}"


def missing(value: Column, na: tuple[str, ...]) -> Column:
    """Null, or one of the strings that stand for a missing value."""
    return value.isNull() | F.coalesce(value.isin(*na), F.lit(False))


def stripped(value: Column) -> Column:
    """Without white space (Unicode's too) at both ends, and then without left-to-right marks there."""
    return F.regexp_replace(F.regexp_replace(value, r"(?U)^\s+|\s+$", ""), "^‎+|‎+$", "")


def number(value: Column) -> Column:
    """The value as a double, or null where it is not a number."""
    v = F.regexp_replace(value, r"(?U)^\s+|\s+$", "")
    return F.when(v.rlike(NUMBER), v.try_cast("double"))


def positive(value: Column) -> Column:
    """A number above 0; what is no number is not, and NaN is not."""
    n = number(value)
    return F.coalesce((n > 0) & ~F.isnan(n), F.lit(False))


def is_numeric(value: Column) -> Column:
    return number(value).isNotNull()


def is_integer(value: Column) -> Column:
    """A number written without a point (1e5 counts)."""
    return is_numeric(value) & ~value.contains(".")


def full_match(value: Column, pattern: str) -> Column:
    return value.rlike(f"^(?:{pattern})$")


def raw_key(key: Column, dup: Column) -> Column:
    """The n-th repeat of a key (from 1) carries its number in triple braces."""
    return F.when(dup == 0, key).otherwise(F.concat(key, F.lit("{{{_"), dup.cast("string"), F.lit("_}}}")))


def base_key(raw: Column) -> Column:
    return F.when(raw.rlike(DUPLICATE), F.regexp_extract(raw, DUPLICATE, 1)).otherwise(raw)


def full_id(raw: Column) -> Column:
    """Digits alone are an analysis number, padded to six."""
    return F.when(raw.rlike(r"^\d+$"), F.concat(F.lit("AN"), F.lpad(raw, F.greatest(F.lit(6), F.length(raw)), F.lit("0")))).otherwise(raw)


def id_kind(raw: Column) -> Column:
    """study for an ST id, else analysis."""
    return F.when(full_id(raw).rlike(r"^ST\d{6}$"), "study").otherwise("analysis")


def compression(path: Column) -> Column:
    """zip, tar.gz, tar.bz2, gz, bz2, tar or an empty string, by the path's end; the longer ends come first."""
    out = F.lit("")
    for end in ("tar", "bz2", "gz", "tar.bz2", "tar.gz", "zip"):
        out = F.when(path.endswith(f".{end}"), end).otherwise(out)
    return out


def is_url(path: Column) -> Column:
    return path.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/[^?#]*")


def url_part(url: Column, part: str) -> Column:
    """PROTOCOL, HOST or PATH of an address; null where it is none."""
    return F.parse_url(url, F.lit(part))


def results_file(line: Column) -> Column:
    """A results-file line as a struct; what it doesn't name is null."""
    keys = ("UNITS", "Has m/z", "Has RT", "RT units")
    stop = "|".join(rf"\s{k}:" for k in keys)

    def part(pattern: str) -> Column:
        return F.nullif(F.trim(F.regexp_extract(line, pattern, 1)), F.lit(""))

    names = ("units", "has_mz", "has_rt", "rt_units")
    found = [part(rf"(?s)^(?!(?:{'|'.join(keys)}):)(.*?)(?:{stop}|$)").alias("filename")]
    return F.struct(*found, *(part(rf"(?s)(?:^|\s){k}:(.*?)(?:{stop}|$)").alias(n) for k, n in zip(keys, names, strict=True)))


def wrap(value: Column, width: int) -> Column:
    """The words of a text (parted by single spaces) as lines of at most `width` characters; a longer word is a line."""
    words = F.split(value, " ")
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.element_at(words, 1).alias("line"))

    def add(held: Column, word: Column) -> Column:
        fits = F.length(held["line"]) + F.length(word) + 1 <= width
        return F.struct(
            F.when(fits, held["lines"]).otherwise(F.array_append(held["lines"], held["line"])).alias("lines"),
            F.when(fits, F.concat_ws(" ", held["line"], word)).otherwise(word).alias("line"),
        )

    return F.aggregate(F.slice(words, F.lit(2), F.size(words)), start, add, lambda held: F.array_append(held["lines"], held["line"]))
