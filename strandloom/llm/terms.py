"""Frequency of every distinct term: compressed record bitmaps with occurrence counters.

Vertical layout: for each (field, term) the identifiers of the records that hold it are kept as a bitmap in containers of
2^16 identifiers, beside a counter of occurrences.  A container is a sorted array of 16-bit numbers while it has at most
4096 of them and 8 KB of bits beyond.  Containers are built where the records are read; containers of one key are merged by
union; the document frequency is the sum of their cardinalities.  A term held by a third of all records has many
containers, spread over all tasks by (field, term, container), so no task ever holds a whole bitmap.

Defined cases: null and empty terms are none; a term that a record holds several times counts once as a record; records
without any term count in no total.  Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many numbers are kept as an array.
ARRAY_MOST = 4096
#: Containers held by a worker before it passes them on.
HELD = 20_000
SCHEMA = "field string, term string, container bigint, occurrences bigint, bits binary"

#: Marks of ``mark``: a term of at most RARE records is rare, one of at least COMMON of all records with a term common.
RARE, COMMON = 2, 0.2


def pack(low) -> bytes:
    """Sorted distinct uint16 numbers as a container: b'A' + array or b'B' + bits."""
    import numpy as np

    if len(low) <= ARRAY_MOST:
        return b"A" + low.astype("<u2").tobytes()
    bits = np.zeros(65536, "u1")
    bits[low] = 1
    return b"B" + np.packbits(bits, bitorder="little").tobytes()


def unpack(data: bytes):
    import numpy as np

    if data[:1] == b"A":
        return np.frombuffer(data, "<u2", offset=1)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, "u1", offset=1), bitorder="little")).astype("<u2")


def union(a: bytes, b: bytes) -> bytes:
    import numpy as np

    if a[:1] == b"B" and b[:1] == b"B":
        return b"B" + (np.frombuffer(a, "u1", offset=1) | np.frombuffer(b, "u1", offset=1)).tobytes()
    return pack(np.union1d(unpack(a), unpack(b)))


def cardinality(data: bytes) -> int:
    import numpy as np

    return (len(data) - 1) // 2 if data[:1] == b"A" else int(np.bitwise_count(np.frombuffer(data, "u1", offset=1)).sum())


def build(rows: DataFrame) -> DataFrame:
    """Containers of rows (field, terms array<string>, record bigint); the term null stands for "any term"."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        held: dict[tuple, list] = {}

        def out():
            keys = list(held)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in keys], pa.string()),
                    pa.array([k[1] for k in keys], pa.string()),
                    pa.array([k[2] for k in keys], pa.int64()),
                    pa.array([held[k][0] for k in keys], pa.int64()),
                    pa.array([held[k][1] for k in keys], pa.binary()),
                ],
                names=["field", "term", "container", "occurrences", "bits"],
            )
            held.clear()

        def add(field, term, records):
            """records: sorted, repeated as often as they occur."""
            once = records[np.concatenate([[True], records[1:] != records[:-1]])]
            chunk = once >> 16
            starts = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]]))
            per = np.diff(np.concatenate([np.searchsorted(records, once[starts]), [len(records)]]))
            for s, e, n in zip(starts, [*starts[1:], len(once)], per):
                key, bits = (field, term, int(chunk[s])), pack((once[s:e] & 0xFFFF).astype("u2"))
                if key in held:
                    held[key] = [held[key][0] + int(n), union(held[key][1], bits)]
                else:
                    held[key] = [int(n), bits]

        for batch in batches:
            if batch.num_rows == 0:
                continue
            lists = batch.column(1)
            parents = np.asarray(pc.list_parent_indices(lists))
            if len(parents) == 0:
                continue
            fields = batch.column(0).dictionary_encode()
            terms = pc.list_flatten(lists).dictionary_encode()
            names, field_names = terms.dictionary.to_pylist(), fields.dictionary.to_pylist()
            records = np.asarray(batch.column(2))[parents]
            f, t = np.asarray(fields.indices)[parents].astype("i8"), np.asarray(terms.indices).astype("i8")
            code = f * len(names) + t
            order = np.lexsort((records, code))
            code, records = code[order], records[order]
            cuts = np.concatenate([[0], np.flatnonzero(code[1:] != code[:-1]) + 1, [len(code)]])
            for s, e in zip(cuts[:-1], cuts[1:]):
                add(field_names[code[s] // len(names)], names[code[s] % len(names)], records[s:e])
            for k, name in enumerate(field_names):
                mine = np.sort(np.asarray(batch.column(2))[np.unique(parents[f == k])])
                if len(mine):
                    add(name, None, mine)
            if len(held) > HELD:
                yield from out()
        if held:
            yield from out()

    return rows.select("field", "terms", "record").mapInArrow(run, SCHEMA)


def merge(containers: DataFrame) -> DataFrame:
    """(field, term, container, occurrences, records): containers of one key united, their cardinality read."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["field", "term", "container", "occurrences", "records"]
        last, n, bits = None, 0, b"A"
        for batch in batches:
            done: list[tuple] = []
            for f, t, c, o, b in zip(*[x.to_pylist() for x in batch.columns]):
                if (f, t, c) == last:
                    n, bits = n + o, union(bits, b)
                else:
                    if last is not None:
                        done.append((*last, n, cardinality(bits)))
                    last, n, bits = (f, t, c), o, b
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(names, d)) for d in done], schema=schema(pa))
        if last is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (*last, n, cardinality(bits))))], schema=schema(pa))

    def schema(pa):
        return pa.schema([("field", pa.string()), ("term", pa.string()), ("container", pa.int64()), ("occurrences", pa.int64()), ("records", pa.int64())])

    keys = ["field", "term", "container"]
    return containers.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "field string, term string, container bigint, occurrences bigint, records bigint")


def frequencies(rows: DataFrame, rare: int = RARE, common: float = COMMON) -> DataFrame:
    """(field, value, occurrences, records, share, mark) of rows (field, terms array<string>, record bigint).

    share: of the records that hold any value of the field.  mark: ``rare``, ``common`` or ``""``.
    """
    terms = F.filter("terms", lambda t: t.isNotNull() & (t != ""))
    clean = rows.select("field", terms.alias("terms"), "record").where(F.size("terms") > 0)
    per = merge(build(clean)).groupBy("field", F.col("term").alias("value")).agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    totals = per.where("value is null").select("field", F.col("records").alias("of"))  # as many rows as there are fields
    share = F.col("records") / F.col("of")
    mark = F.when(F.col("records") <= rare, "rare").when(share >= common, "common").otherwise("")
    return per.where("value is not null").join(totals, "field").select("field", "value", "occurrences", "records", share.alias("share"), mark.alias("mark"))


def tidy(c: Column) -> Column:
    """Lower case, without blanks and quotes at both ends."""
    return F.lower(F.regexp_replace(c, r"""\A[\s"']+|[\s"']+\z""", ""))


def term_list(c: Column) -> Column:
    """The terms packed in a field, tidied."""
    return F.transform(F.split(c, r"[&,;|/\n\t]"), tidy)
