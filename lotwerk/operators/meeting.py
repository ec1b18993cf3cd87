"""All similar pairs of sets, found and verified within the tasks of one shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwerk.operators import skew
from lotwerk.session import cut

#: Tokens whose frequencies are known to all tasks, the most frequent ones. Any other has 1/FREQUENT of all rows at most.
FREQUENT = 100_000
#: Rows of one token from which they are dealt to several groups.
GROUP_ROWS = 20_000
#: Rows, pairs and numbers that a task looks at together.
AT_ONCE, PAIRS_AT_ONCE, CELLS_AT_ONCE = 50_000, 1_000_000, 4_000_000
#: Guard against binary fractions.
EPS = 1e-9


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number within it) of as many entries a row as counts says."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, where each list begins, and the last ends)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]], at - at[0]


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64 bits of two numbers."""
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _least_common(size: np.ndarray, sim: float) -> np.ndarray:
    return np.ceil(size * sim - EPS).astype(np.int64)


def _posted(sim: float, known: np.ndarray, rank: np.ndarray, parts: np.ndarray, schema: pa.Schema):
    """Rows of a set become one for each token that may be the first it has in common with a similar set: (space, id, pivot,
    n, key, side, rest), rest being the tokens after it. known are the frequent tokens, with their rank (the rarest first)
    and the groups their rows are dealt to."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            size = np.diff(_lists(whole.column("tokens"))[1])
            pieces = np.cumsum(size * size) // CELLS_AT_ONCE if len(size) else size
            for piece in np.unique(pieces):
                at = np.flatnonzero(pieces == piece)
                batch = whole.slice(at[0], len(at))
                token, start = _lists(batch.column("tokens"))
                n = np.diff(start)
                i = np.minimum(np.searchsorted(known, token), max(len(known) - 1, 0))
                hit = known[i] == token if len(known) else np.zeros(len(token), bool)
                # one number is a token's name and its place: unknown ones are rare and come first
                code = np.where(hit, rank[i] if len(known) else 0, -1 - (token & np.int64(2**63 - 1)))
                dealt = np.where(hit, parts[i] if len(known) else 1, 1)
                order = np.lexsort((code, np.repeat(np.arange(len(n)), n)))
                code, dealt = code[order], dealt[order]
                row, pos = _spread(n - _least_common(n, sim) + 1)
                here = start[row] + pos
                # of a token with many rows, a row of block i goes to the groups (i, 0), (i, 1) and so on
                own = _mixed(np.add.reduceat(code, start[:-1]) if len(n) else code, n)[row] % dealt[here].astype(np.uint64)
                entry, j = _spread(dealt[here])
                row, pos, here, i, j = row[entry], pos[entry], here[entry], own[entry].astype(np.int64), j.astype(np.int64)
                many = dealt[here] > 1
                key = np.where(many, _mixed(code[here], _mixed(np.minimum(i, j), np.maximum(i, j))).view(np.int64), code[here])
                side = np.where(many & (i != j), np.where(i < j, 1, 2), 0)
                rest, k = _spread(n[row] - pos - 1)
                ends = np.concatenate([[0], np.cumsum(n[row] - pos - 1)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(code[here[rest] + 1 + k], pa.int64()))
                taken = [batch.column(c).take(pa.array(row)) for c in ("space", "id", "pivot")]
                yield pa.RecordBatch.from_arrays([*taken, pa.array(n[row], pa.int32()), pa.array(key, pa.int64()), pa.array(side, pa.int8()), lists], schema=schema)

    return post


def _verified(t: pa.Table, sim: float, two: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x, y, o): rows of t(n, key, side, pivot, rest), whole groups of equal key, that are similar by their common tokens from
    the key on. Of the tokens that two sets have in common the first one is one of their keys, there o is their overlap."""
    key, n, side, pivot = (t.column(c).to_numpy() for c in ("key", "n", "side", "pivot"))
    value, start = _lists(t.column("rest"))
    size, n = np.diff(start), n.astype(np.int64)
    # with two, they also have one of the tokens in common that may be the second common one
    row, k = _spread(np.minimum(size, size - _least_common(n, sim) + 2) if two else np.ones(len(n), np.int64))
    meet = _mixed(key[row], value[start[row] + k]) if two else key[row].view(np.uint64)
    order = np.argsort(meet, kind="stable")
    row, meet = row[order], meet[order]
    edge = np.flatnonzero(np.concatenate([[True], meet[1:] != meet[:-1], [True]]))
    ends = np.repeat(edge[1:], np.diff(edge))
    partners = ends - np.arange(len(row)) - 1
    bits = np.zeros(len(n), np.uint64)
    np.bitwise_or.at(bits, np.repeat(np.arange(len(n)), size), np.uint64(1) << (_mixed(value, value) & np.uint64(63)))
    pieces = np.cumsum(partners) // PAIRS_AT_ONCE
    for piece in np.unique(pieces[partners > 0]):
        first = np.flatnonzero((pieces == piece) & (partners > 0))
        many = partners[first]
        for lo in range(0, int(many.max()), PAIRS_AT_ONCE):  # one row may have very many
            e, j = _spread(np.clip(many - lo, 0, PAIRS_AT_ONCE))
            x, y = row[first[e]], row[first[e] + 1 + lo + j]
            need = np.ceil((n[x] + n[y]) * (sim / (1 + sim)) - EPS)
            keep = (pivot[x] | pivot[y]) & (np.minimum(n[x], n[y]) >= np.maximum(n[x], n[y]) * sim - EPS) & ((side[x] == 0) | (side[x] != side[y]))
            bx, by = bits[x], bits[y]
            most = np.minimum(size[x] - np.bitwise_count(bx & ~by), size[y] - np.bitwise_count(by & ~bx))
            keep &= (1 + most >= need) & (x != y)
            pair = np.unique(np.minimum(x[keep], y[keep]) * np.int64(len(n)) + np.maximum(x[keep], y[keep]))
            x, y = pair // max(len(n), 1), pair % max(len(n), 1)
            width = int(size[x].max() + size[y].max()) if len(x) else 1
            step = max(1, CELLS_AT_ONCE // width)
            for at in range(0, len(x), step):
                a, b = x[at : at + step], y[at : at + step]
                wa, wb = int(size[a].max()), int(size[b].max())
                cells = np.zeros((len(a), wa + wb), np.int64)
                for s, w, off in ((a, wa, 0), (b, wb, wa)):
                    c = np.arange(w)
                    there = c < size[s][:, None]
                    # fillers stand apart from each other and from all tokens
                    cells[:, off : off + w] = np.where(there, value[np.minimum(start[s][:, None] + c, max(len(value) - 1, 0))] if len(value) else 0, np.int64(2**62) + off + c)
                cells.sort(axis=1)
                o = 1 + (cells[:, 1:] == cells[:, :-1]).sum(axis=1)
                ok = o >= (n[a] + n[b] - o) * sim - EPS
                yield a[ok], b[ok], o[ok]


def _paired(sim: float, two: bool, schema: pa.Schema):
    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(t: pa.Table) -> Iterator[pa.RecordBatch]:
            for x, y, o in _verified(t, sim, two):
                ends = [t.column(c).take(pa.array(i)).combine_chunks() for c, i in (("space", x), ("id", x), ("id", y), ("n", x), ("n", y), ("pivot", x), ("pivot", y))]
                yield pa.RecordBatch.from_arrays([*ends, pa.array(o, pa.int32())], schema=schema)

        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= AT_ONCE:
                t = pa.Table.from_batches(held).combine_chunks()
                key = t.column("key").to_numpy()
                last = int(np.searchsorted(key, key[-1]))  # rows come in order of key; the last group may go on
                if last:
                    yield from found(t.slice(0, last).combine_chunks())
                held, rows = t.slice(last).to_batches(), t.num_rows - last
        if rows:
            yield from found(pa.Table.from_batches(held).combine_chunks())

    return pair


def similar_sets(sets: DataFrame, sim: float, min_size: int) -> DataFrame:
    """(space, a, b, na, nb, pa, pb, o), a < b: the pairs of sets(space, id, tokens, pivot) of one space whose Jaccard is sim at
    least, each with a pivot; their sizes, which of them are pivots, and their overlap.

    tokens are distinct longs, min_size at least. Sets of overlap o >= ceil(sim * size) have their first common token, by
    any order of all tokens, among the first size - ceil(sim * size) + 1 of either, and their second one, if o is 2 or more,
    among the first size - ceil(sim * size) + 2. One row for each such first token is shuffled, with the tokens after it;
    what meets there on a second token is verified in the same task. Rare tokens come first in the order. The rows of a
    frequent token are dealt to groups, of which any two rows meet in one. Only similar pairs are shuffled again.
    """
    spark = sets.sparkSession
    # tokens of different spaces are different tokens
    named = sets.select("space", "id", "pivot", F.transform("tokens", lambda t: F.xxhash64("space", t)).alias("tokens"))
    counts = named.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("n")).filter("n > 1")
    top = counts.orderBy(F.desc("n"), "t").limit(FREQUENT).toArrow()
    token, n = top.column("t").to_numpy()[::-1], top.column("n").to_numpy()[::-1]
    order = np.argsort(token)
    known, rank, parts = token[order], order.astype(np.int64), -(-n[order] // GROUP_ROWS)
    kind = {f.name: f.dataType.simpleString() for f in sets.schema}
    from pyspark.sql.pandas.types import to_arrow_type

    space, ident = (pa.field(c, to_arrow_type(sets.schema[c].dataType)) for c in ("space", "id"))
    posted = pa.schema([space, ident, ("pivot", pa.bool_()), ("n", pa.int32()), ("key", pa.int64()), ("side", pa.int8()), ("rest", pa.list_(pa.int64()))])
    rows = named.mapInArrow(_posted(sim, known, rank, parts, posted), f"space {kind['space']}, id {kind['id']}, pivot boolean, n int, key long, side tinyint, rest array<long>")
    rows = rows.repartition("key").sortWithinPartitions("key")
    two = bool(np.ceil(sim * min_size - EPS) >= 2)
    paired = pa.schema([space, ident.with_name("x"), ident.with_name("y"), ("nx", pa.int32()), ("ny", pa.int32()), ("px", pa.bool_()), ("py", pa.bool_()), ("o", pa.int32())])
    pairs = rows.mapInArrow(_paired(sim, two, paired), f"space {kind['space']}, x {kind['id']}, y {kind['id']}, nx int, ny int, px boolean, py boolean, o int")
    low = F.col("x") < F.col("y")
    ends = [F.when(low, F.col(f"{c}x")).otherwise(F.col(f"{c}y")).alias(f"{c}a") for c in ("n", "p")] + [F.when(low, F.col(f"{c}y")).otherwise(F.col(f"{c}x")).alias(f"{c}b") for c in ("n", "p")]
    pairs = pairs.select("space", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), *ends, "o")
    return pairs.groupBy("space", "a", "b", "na", "nb", "pa", "pb").agg(F.max("o").alias("o"))


def classes_of(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(representatives(space, id, tokens, n), members(space, id, klasse, n)) of sets(space, id, tokens): equal sets are one class of
    n, named by its smallest id."""
    groups = cut(sets.groupBy("space", "tokens").agg(F.min("id").alias("klasse"), F.count("*").alias("n")))
    members = skew.skew_join(sets, groups.filter("n > 1"), ["space", "tokens"], weight="n").select("space", "id", "klasse", "n")
    alone = groups.filter("n = 1").select("space", F.col("klasse").alias("id"), "klasse", "n")
    return groups.select("space", F.col("klasse").alias("id"), "tokens", "n"), cut(members.unionByName(alone))
