"""Scalar functions as columns: names, rounding, signals."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = '.,!?;:"()[]{}'


def normal_word(x: Column) -> Column:
    """Lower case, trimmed, typographic apostrophes as plain ones."""
    return F.lower(F.trim(F.replace(x, F.lit("’"), F.lit("'"))))


def word_candidates(x: Column) -> Column:
    """Spellings to look a word up by, in order: itself, without outer punctuation, without hyphens, without apostrophes."""
    base = normal_word(x)
    plain = F.btrim(base, F.lit(PUNCTUATION))
    return F.array_distinct(F.filter(F.array(base, plain, F.replace(plain, F.lit("-"), F.lit("")), F.replace(plain, F.lit("'"), F.lit(""))), lambda w: w != ""))


def slug(x: Column, default: str = "unnamed") -> Column:
    out = F.btrim(F.regexp_replace(x, "[^A-Za-z0-9]+", "_"), F.lit("_"))
    return F.when(out == "", default).otherwise(out)


def channel_name(x: Column) -> Column:
    return F.upper(F.regexp_replace(F.trim(x), r"\s+", " "))


def subject_label(x: Column) -> Column:
    """sub-XX of a number or a label."""
    digits = F.regexp_extract(x, r"(\d+)$", 1)
    return F.when(digits != "", F.concat(F.lit("sub-"), F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits))).otherwise(x)


def prefixed(x: Column, prefix: str) -> Column:
    """ses-1 or task-1 of 1, "1" or the label itself."""
    return F.when(x.startswith(prefix), x).otherwise(F.concat(F.lit(prefix), x))


def number_fragment(x: Column) -> Column:
    """A number as part of a file name: m for the minus, p for the point."""
    return F.translate(x.cast("string"), "-.", "mp")


def natural_key(x: Column) -> Column:
    """Orders digits as numbers: each run of digits is padded to 12."""
    return F.regexp_replace(F.regexp_replace(F.lower(x), r"(\d+)", "000000000000$1"), r"0*(\d{12})(?!\d)", "$1")


def half_even(x: Column) -> Column:
    """Nearest integer, halves to the even one."""
    return F.rint(x).cast("long")


def erb(f: Column) -> Column:
    """Hertz to the ERB-rate scale."""
    return 21.4 * F.log10(0.00437 * f + 1)


def erb_to_hz(e: Column) -> Column:
    return (F.pow(F.lit(10.0), e / 21.4) - 1) / 0.00437


def compress(x: Column, power: float = 0.6) -> Column:
    return F.pow(F.abs(x), F.lit(power))


def l2(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def zipf(count: Column, total: Column) -> Column:
    """log10 of occurrences in 10**9 words."""
    return F.log10(count * 1e9 / total)


def surprisal(p: Column) -> Column:
    return -F.log2(F.greatest(p, F.lit(1e-12)))


def mass_curve(mass: float, k: Column, cap: int) -> Column:
    """Estimate of the probability that the k likeliest of cap symbols hold."""
    return 1 - F.pow(F.lit(1 - mass), k / cap)


def optional_bool(x: Column) -> Column:
    """true, false or null of the spellings in use."""
    t = F.lower(F.trim(x.cast("string")))
    return F.when(t.isin("true", "1", "yes", "y"), True).when(t.isin("false", "0", "no", "n"), False)


def hash_uniform(*parts: Column) -> Column:
    """Between 0 and 1, of the first 13 hex digits of an MD5; the same in every engine."""
    digits = F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 13), 16, 10)
    return (digits.cast("double") + 0.5) / float(1 << 52)


def hash_normal(*parts: Column) -> Column:
    """Standard normal by Box and Muller of two hashes."""
    return F.sqrt(-2 * F.log(hash_uniform(*parts, F.lit("a")))) * F.cos(2 * math.pi * hash_uniform(*parts, F.lit("b")))


def analysis_name(x: Column) -> Column:
    """A name that may be a folder's; an error where nothing is left of it."""
    out = F.btrim(F.regexp_replace(F.regexp_replace(F.trim(x), r"[^A-Za-z0-9_\-]+", "_"), "_+", "_"), F.lit("_.-"))
    return F.when(out == "", F.raise_error(F.lit("an analysis needs a name"))).otherwise(out)


def duration_text(seconds: Column) -> Column:
    """2h 5m, 3m 20s or 12s."""
    s = F.floor(F.greatest(seconds, F.lit(0.0))).cast("long")
    h, m = F.floor(s / 3600).cast("string"), F.floor(s % 3600 / 60).cast("string")
    return F.when(s >= 3600, F.concat(h, F.lit("h "), m, F.lit("m"))).when(s >= 60, F.concat(m, F.lit("m "), (s % 60).cast("string"), F.lit("s"))).otherwise(F.concat(s.cast("string"), F.lit("s")))


def size_text(n: Column) -> Column:
    """1.5 KB: one decimal, halves to the even one, steps of 1024."""
    out = F.format_string("%.1f TB", F.bround(n / 1024.0**4, 1))
    for k, unit in reversed(list(enumerate(("B", "KB", "MB", "GB")))):
        out = F.when(n < 1024.0 ** (k + 1), F.format_string(f"%.1f {unit}", F.bround(n / 1024.0**k, 1))).otherwise(out)
    return out


def promoted(series, x: str):  # noqa: ANN001, ANN201
    """A series (t, x) as one of vectors (t, features)."""
    return series.withColumn("features", F.array(x)).drop(x)


def merged_map(*maps: dict[str, int]) -> Column:
    """A map column of dictionaries; later ones win."""
    pairs = {k: v for m in maps for k, v in m.items()}
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
