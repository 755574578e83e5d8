"""Several values packed in one field: one row per value, with its place.

Grammar of a value, alternatives in this order::

    value   <- quoted / bracketed / bare
    quoted  <- q (q q / !q .)* q &(blank* (delimiter / end))          for each quote character q
    bracketed <- open (!close .)* close &(blank* (delimiter / end))   for each pair of brackets
    bare    <- subquoted? (sub subquoted / sub / !(delimiter / sub) .)+
    subquoted <- q (q q / !q .)* q &(blank* (sub / delimiter / end))

A quote that never closes, or closes in front of something else than a delimiter, makes ``quoted`` fail; the value is then
read again from the same place as ``bare`` and flagged.

Null, blank and ``.`` fields have no values; empty pieces are no values and take no place.  Repeated values stay, each
with its own place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandloom.functions.peg import Ahead, Choice, End, Lit, Many, Maybe, Node, OneOf, Seq

BLANKS = " \r\f\u000b"


@dataclass(frozen=True)
class Packing:
    """How values are packed: delimiters, separator of the sub-fields ("" for none), quotes and pairs of brackets that
    keep delimiters from splitting."""

    delimiters: str = ",;\n\t"
    sub: str = "|"
    quotes: str = "\"'"
    brackets: tuple[str, ...] = ()

    def _quoted(self, q: str, then: Node) -> Node:
        body = Many(Choice((Lit(q + q), OneOf(q, negated=True))))
        return Seq((Lit(q), body, Lit(q), Ahead(Seq((Many(OneOf(BLANKS)), then)))))

    def whole(self, q: str) -> Node:
        return self._quoted(q, Choice((OneOf(self.delimiters), End())))

    def sound(self) -> Node:
        """A bare value in which every quote that opens a sub-field encloses it."""
        if not self.sub:
            return OneOf(self.quotes, negated=True)
        stop = self.sub + self.delimiters
        plain = Seq((OneOf(stop + self.quotes, negated=True), Many(OneOf(stop, negated=True))))
        end = Choice((OneOf(self.sub), End()))
        inner = [Seq((self._quoted(q, end), Many(OneOf(BLANKS)))) for q in self.quotes]
        field = Maybe(Choice((*inner, plain)))
        return Seq((field, Many(Seq((Lit(self.sub), field))), End()))

    def value(self) -> Node:
        stop = Choice((OneOf(self.delimiters), End()))
        first = [self.whole(q) for q in self.quotes]
        for a, b in self.brackets:
            first.append(Seq((Lit(a), Many(OneOf(b, negated=True)), Lit(b), Ahead(Seq((Many(OneOf(BLANKS)), stop))))))
        if self.sub:
            end = Choice((OneOf(self.sub + self.delimiters), End()))
            inner = [self._quoted(q, end) for q in self.quotes]
            step = [Seq((Lit(self.sub), x)) for x in inner] + [Lit(self.sub)]
            plain = Many(OneOf(self.delimiters + self.sub, negated=True), least=1)
            bare = Seq((Maybe(Choice(tuple(inner))) if inner else Seq(()), Many(Choice((*step, plain)))))
        else:
            bare = Many(OneOf(self.delimiters, negated=True), least=1)
        # a value begins at something that is neither a delimiter nor a blank
        start = Ahead(OneOf(self.delimiters + BLANKS, negated=True))
        return Seq((start, Choice((*first, bare))))


RECORDS = Packing()
TERMS = Packing(delimiters=",;&|/\n\t", sub="")


def _unwrap(v: Column, packing: Packing) -> Column:
    """The value without one pair of enclosing quotes and without the doubling of such quotes inside."""
    out = v
    for q in packing.quotes:
        whole = v.rlike(r"\A" + Seq((Lit(q), Many(Choice((Lit(q + q), OneOf(q, negated=True)))), Lit(q), End())).java())
        out = F.when(whole, F.replace(v.substr(F.lit(2), F.length(v) - 2), F.lit(q + q), F.lit(q))).otherwise(out)
    return out


def pieces(field: Column, packing: Packing = RECORDS) -> Column:
    """The raw values of a packed field in order, as array<string>; empty for null, blank and ``.`` fields."""
    text = F.regexp_replace(field, r"\A\s+|\s+\z", "")
    found = F.regexp_extract_all(field, F.lit(packing.value().java()), F.lit(0))
    found = F.transform(found, lambda v: F.regexp_replace(v, r"\s+\z", ""))
    return F.when(field.isNull() | text.isin("", "."), F.array().cast("array<string>")).otherwise(found)


def values(field: Column, packing: Packing = RECORDS) -> Column:
    """The values of a packed field, unquoted, without empty ones, as array<string>."""
    return F.filter(F.transform(pieces(field, packing), lambda v: _unwrap(v, packing)), lambda v: v != "")


def flagged(field: Column, packing: Packing = RECORDS) -> Column:
    """array<struct<value, quoted, error>>: quoted where the grammar's first alternative took the value, which lost its quotes;
    error is ``malformed_quote`` where a quote that opens the value or one of its sub-fields made that alternative fail and
    the value was read as bare, ``""`` elsewhere."""
    sound = r"\A" + packing.sound().java() if packing.quotes else ""

    def one(v: Column) -> Column:
        u = _unwrap(v, packing)
        some = F.lit(False)
        for q in packing.quotes:
            some = some | F.contains(v, F.lit(q))
        bad = (u == v) & some & ~v.rlike(sound) if packing.quotes else F.lit(False)
        return F.struct(u.alias("value"), (u != v).alias("quoted"), F.when(bad, "malformed_quote").otherwise("").alias("error"))

    return F.filter(F.transform(pieces(field, packing), one), lambda s: s.value != "")


def split_rows(df, fields: dict[str, Column], row_id: str, packing: Packing | dict[str, Packing] = RECORDS):
    """(field, row_id, pos, value, quoted, error), one row per value of each named field.

    A map-only plan: no shuffle, no Python.  Rows with a null row_id are kept out of nothing: they come out with a null
    row_id.  ``df`` may hold any other columns; only the named ones are read.
    """
    pack = packing if isinstance(packing, dict) else dict.fromkeys(fields, packing)
    parts = F.array(*[F.struct(F.lit(name).alias("field"), flagged(c, pack[name]).alias("vs")) for name, c in fields.items()])
    return (
        df.select(F.col(row_id).cast("bigint").alias("row_id"), F.explode(parts).alias("p"))
        .select("row_id", F.col("p.field").alias("field"), F.posexplode("p.vs").alias("i", "v"))
        .select("field", "row_id", (F.col("i") + 1).cast("int").alias("pos"), "v.value", "v.quoted", "v.error")
    )
