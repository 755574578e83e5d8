"""Column functions on variant keys, alleles and annotation values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandloom.dictionaries import RANK, SO_TERMS, TRUE_VALUES

NUMERIC = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def plain_chr(c: Column) -> Column:
    """Chromosome without the prefix chr."""
    return F.regexp_replace(c, "^chr", "")


def parse_key(c: Column, separators: str = "[-_:]", strict: bool = True) -> Column:
    """struct<chr, position, ref, alt> of a key such as chr-pos-ref-alt; one trailing separator is ignored.  A key that has
    not four parts or no whole position raises, or is null where strict is off."""
    parts = F.split(F.regexp_replace(c, f"{separators}$", ""), separators, -1)
    position = F.get(parts, F.lit(1)).try_cast("int")
    ok = (F.size(parts) == 4) & position.isNotNull()
    key = F.struct(plain_chr(parts[0]).alias("chr"), position.alias("position"), F.get(parts, F.lit(2)).alias("ref"), F.get(parts, F.lit(3)).alias("alt"))
    bad = F.raise_error(F.concat(F.lit("not a variant key: "), c)) if strict else F.lit(None)
    return F.when(c.isNull(), F.lit(None)).when(F.coalesce(ok, F.lit(False)), key).otherwise(bad)


def make_key(*parts: Column | str) -> Column:
    return F.concat_ws("-", *parts)


def alts(alt: Column) -> Column:
    """array<string> of a comma-joined list; null and '' are one empty allele."""
    return F.split(F.coalesce(alt, F.lit("")), ",")


def so_terms(consequence: Column) -> Column:
    """Terms joined by &; '' stays a term, null has none."""
    return F.coalesce(F.split(consequence, "&"), F.array().cast("array<string>"))


def _so(place: int) -> Column:
    return F.create_map(*[x for t in SO_TERMS for x in (F.lit(t[0]), F.lit(t[place]))])


def so_impact(term: Column) -> Column:
    return F.element_at(_so(1), term)


def so_class(term: Column) -> Column:
    return F.nullif(F.element_at(_so(2), term), F.lit(""))


def so_region(term: Column) -> Column:
    return F.element_at(_so(3), term)


def so_rank(consequence: Column) -> Column:
    """Lowest rank of the terms; unknown terms are skipped, null where all are."""
    ranks = F.create_map(*[x for t, r in RANK.items() for x in (F.lit(t), F.lit(r))])
    return F.array_min(F.transform(so_terms(consequence), lambda t: F.element_at(ranks, t)))


def so_term(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(t[0]) for t in SO_TERMS]), rank - 1)


ESCAPE = r"\\x([0-9a-fA-F]{2})"


def decode_hex(c: Column) -> Column:
    r"""\xHH escapes as characters, again and again until none is left, however deeply they are nested."""

    def once(x: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(x, F.lit(ESCAPE), F.lit(1)))
        return F.aggregate(found, x, lambda acc, h: F.replace(acc, F.concat(F.lit("\\x"), h), F.decode(F.unhex(h), "ISO-8859-1")))

    def state(x: Column) -> Column:
        return F.struct(x.alias("t"), F.coalesce(x.rlike(ESCAPE), F.lit(False)).alias("more"))

    # every round makes the text shorter by three characters at least; rounds after the last escape do nothing
    rounds = F.sequence(F.lit(1), F.ceil(F.length(c) / 3).cast("int") + 1)
    step = lambda acc, _: F.when(acc["more"], F.transform(F.array(once(acc["t"])), state)[0]).otherwise(acc)
    return F.when(c.rlike(ESCAPE), F.aggregate(rounds, state(c), step, lambda acc: acc["t"])).otherwise(c)


def encode_hex(c: Column) -> Column:
    r"""Text for a field of INFO: blanks, control characters and ``; = , \`` as \xHH.

    ``decode_hex`` gives it back, but for texts that themselves hold an escape \xHH: those it decodes too, as it does nested
    ones."""
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(r"([\x00-\x20\x7f;=,])"), F.lit(1)))
    return F.aggregate(found, F.replace(c, F.lit("\\"), F.lit("\\x5c")), lambda acc, h: F.replace(acc, h, F.concat(F.lit("\\x"), F.lower(F.hex(h)))))


def logical(c: Column) -> Column:
    """True for 1, T, TRUE and YES, False for all else, null included."""
    return F.coalesce(c.isin(*TRUE_VALUES), F.lit(False))


def number(c: Column) -> Column:
    """double, null where the text is no number."""
    return F.when(c.rlike(NUMERIC), F.trim(c).try_cast("double"))


def whole(c: Column) -> Column:
    """int towards zero, null where the text is no number or out of range."""
    return number(c).try_cast("int")


def typed(c: Column, kind: str) -> Column:
    return {"boolean": logical, "int": whole, "float": lambda x: number(x).cast("float"), "double": number}.get(kind, lambda x: x)(c)


def before_parenthesis(c: Column) -> Column:
    return F.regexp_replace(c, r"\(.*$", "")


def variant_class(ref: Column, alt: Column) -> Column:
    nr, na = F.length(ref), F.length(alt)
    return (
        F.when(alt.startswith("<") | (alt == "*") | alt.rlike("[^ACGTNacgtn]"), "other")
        .when(nr < na, "insertion")
        .when(nr > na, "deletion")
        .when(nr > 1, "substitution (MNV)")
        .otherwise("SNV")
    )


def clip(c: Column, most: int = 21) -> Column:
    return F.greatest(F.least(c, F.lit(most)), F.lit(-most))


def finite_or_null(c: Column) -> Column:
    """A finite number, or null."""
    return F.when(~F.isnan(c) & ~c.isin(float("inf"), float("-inf")), c)


QUAL_BREAKS = (0, 10, 20, 30, 40, 50, 100, 200, 500, 1000)


def qual_labels() -> list[str]:
    b = ("-Inf", *map(str, QUAL_BREAKS), "Inf")
    return [f"({x},{y}]" for x, y in zip(b, b[1:])]


def qual_bin(q: Column) -> Column:
    """Right-closed bins of QUAL; null for null and NaN."""
    labels = qual_labels()
    out = F.when(q.isNull() | F.isnan(q), None)
    for top, label in zip(QUAL_BREAKS, labels):
        out = out.when(q <= top, label)
    return out.otherwise(labels[-1])


def chrom_order(chr_: Column) -> list[Column]:
    """Numbers first, then names."""
    return [plain_chr(chr_).try_cast("int").asc_nulls_last(), plain_chr(chr_)]


def pieces(record: Column, n: int) -> Column:
    """n sub-fields of a piped record: short ones padded with '', further pipes stay in the last."""
    parts = F.split(record, r"\|", n)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.get(parts, i), F.lit("")))
