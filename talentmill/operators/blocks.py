"""Scores of many queries against blocks of vectors by matrix products, with a bounded list of the best for each query in every task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Scores held at a time.
BLOCK = 1 << 20


class Best:
    """The ``k`` best (score falling, then id) of each of ``m`` queries; ``tag`` says of which block each came."""

    def __init__(self, m: int, k: int):
        self.k, self.floor = k, np.full(m, -np.inf)
        self.query, self.score, self.id, self.tag = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray, tag: int | np.ndarray = 0) -> None:
        """``scores`` of the queries (rows) at these ids (columns); -inf is none. Equal scores at the end of a list are all looked at."""
        n = scores.shape[1]
        least = np.partition(scores, n - self.k, axis=1)[:, n - self.k] if n > self.k else np.full(len(query), -np.inf)
        at, what = np.nonzero((scores >= np.maximum(least, self.floor[query])[:, None]) & (scores > -np.inf))
        self.merge(query[at], ids[what], scores[at, what], np.broadcast_to(tag, n)[what])

    def merge(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray, tag: np.ndarray) -> None:
        """Adds pairs."""
        if not len(query):
            return
        met = np.isin(self.query, query)  # the lists of other queries stay as they are
        old = [x[~met] for x in (self.query, self.score, self.id, self.tag)]
        q, s, i, t = (np.concatenate([x[met], y]) for x, y in zip((self.query, self.score, self.id, self.tag), (query, scores, ids, tag), strict=True))
        order = np.lexsort((i, -s, q))
        q, s, i, t = q[order], s[order], i[order], t[order]
        first = np.concatenate([[True], q[1:] != q[:-1]])
        rank = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
        keep, last = rank < self.k, rank == self.k - 1
        self.query, self.score, self.id, self.tag = (np.concatenate([x, y[keep]]) for x, y in zip(old, (q, s, i, t), strict=True))
        self.floor[q[last]] = s[last]

    def score_all(self, ids: np.ndarray, vectors: np.ndarray, queries: np.ndarray, which: np.ndarray | None = None, places: int | None = None, tag: int = 0) -> None:
        """Adds the products of ``vectors`` with the queries ``which`` (rows of ``queries``; all if None), rounded half up."""
        which = np.arange(len(queries)) if which is None else which
        step = max(1, BLOCK // max(1, len(ids)))
        for lo in range(0, len(which), step):
            some = which[lo : lo + step]
            scores = queries[some] @ vectors.T
            if places is not None:
                scores = rounded(scores, places)
            self.add(some, ids, scores, tag)


def rounded(x: np.ndarray, places: int) -> np.ndarray:
    """Half away from zero; no negative zero."""
    y = np.abs(x)
    y *= 10**places
    y += 0.5
    np.floor(y, out=y)
    y /= 10**places
    return np.copysign(y, x, out=y) + 0.0


class Pairs:
    """Items of a batch beside queries of a block, for conditions: all of them (items along the second axis), or the pairs (q, i).

    What the methods give can be combined as arrays. Null matches nothing."""

    def __init__(self, items: dict[str, pa.Array], queries: dict[str, list], codes: dict | None = None):
        self.items, self.queries, self.codes, self.cached = items, queries, {} if codes is None else codes, {}
        self.q = self.i = None

    def at(self, q: np.ndarray, i: np.ndarray) -> Pairs:
        self.q, self.i = q, i
        return self

    def _once(self, key: tuple, make: Callable) -> object:
        if key not in self.cached:
            self.cached[key] = make()
        return self.cached[key]

    def same(self, item: str, query: str) -> np.ndarray:
        """Equal values."""
        names, own = self.codes.setdefault((item, query), _coded([[x] for x in self.queries[query]]))
        return self._place(item, query, names)[self.i] == own[self.q]

    def among(self, item: str, query: str) -> np.ndarray:
        """The item's value is in the query's list."""
        key = (item, query, "list")
        if key not in self.codes:
            names, _ = _coded(self.queries[query])
            where = {x: n for n, x in enumerate(names)}
            table = np.zeros((len(self.queries[query]), len(names) + 1), bool)  # the last column is of no list
            for n, values in enumerate(self.queries[query]):
                table[n, [where[x] for x in values or () if x is not None]] = True
            self.codes[key] = names, table
        names, table = self.codes[key]
        return table[self.q, self._place(item, query, names)[self.i]]

    def _place(self, item: str, query: str, names: list) -> np.ndarray:
        """Of each item its value's number among those that queries ask for, or -1."""
        column = self.items[item]
        kind = column.type if names else pa.null()
        return self._once((item, query), lambda: pc.fill_null(pc.index_in(column, value_set=pa.array(names, kind)), -1).to_numpy(zero_copy_only=False).astype(np.int64) if names else np.full(len(column), -1))

    def item(self, name: str) -> np.ndarray:
        """Numbers as doubles, null as NaN; flags, null as false."""
        column = self.items[name]
        make = (lambda: pc.fill_null(column, False).to_numpy(zero_copy_only=False)) if pa.types.is_boolean(column.type) else (lambda: column.cast(pa.float64()).to_numpy(zero_copy_only=False))
        return self._once((name,), make)[self.i]

    def query(self, name: str) -> np.ndarray:
        return self.codes.setdefault((name,), np.array([np.nan if x is None else x for x in self.queries[name]], float))[self.q]

    def unset(self, name: str) -> np.ndarray:
        """The query asks for nothing: null, or an empty list."""
        return self.codes.setdefault((name, "unset"), np.array([x is None or x == [] for x in self.queries[name]], bool))[self.q]


def _coded(lists: list) -> tuple[list, np.ndarray]:
    """Distinct values of lists, null left out, and the number of each list's first one (-2 for null)."""
    names: dict = {}
    first = [names.setdefault(x[0], len(names)) if x and x[0] is not None else -2 for x in lists]
    for values in lists:
        for x in values or ():
            if x is not None:
                names.setdefault(x, len(names))
    return list(names), np.array(first, np.int64)


def rows_of(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def nearest(items: DataFrame, names: list, queries: np.ndarray, k: int, places: int, kind: str) -> DataFrame:
    """(query_id, vec_id, score): the ``k`` best of every task's rows of ``items`` (vec_id, unit) for each query; ``names`` are the queries' ids."""
    width = queries.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(queries), k)
        for b in batches:
            if b.num_rows:
                best.score_all(b.column(0).to_numpy(), rows_of(b.column(1), width), queries, places=places)
        yield pa.RecordBatch.from_pydict({"query_id": [names[q] for q in best.query], "vec_id": pa.array(best.id), "score": pa.array(best.score)})

    return items.mapInArrow(run, f"query_id {kind}, vec_id long, score double")


def best_pairs(items: DataFrame, queries: pa.Table, k: int, places: int, kinds: dict[str, str], keep: Callable[[Pairs], np.ndarray] | None = None, rerank: Callable[[np.ndarray, Pairs], np.ndarray] | None = None) -> DataFrame:
    """(query_id, vec_id, score and the columns of ``kinds``, which says their types): the ``k`` best pairs of each query of a block in every task.

    ``items``: vec_id, unit and columns; ``queries``: query_id, q_unit and columns. Scores are products, rounded; ``rerank`` changes them, and those
    pairs that ``keep`` drops are none. Once all lists are full, only pairs that may enter one are rounded and asked."""
    units = rows_of(queries.column("q_unit").combine_chunks(), len(queries.column("q_unit")[0]))
    asked = {c: queries.column(c).to_pylist() for c in queries.column_names if c != "q_unit"}
    own = [c for c in items.columns if c not in ("vec_id", "unit")]
    mine = [c for c in kinds if c in own]
    schema = ", ".join(f"{c} {kind}" for c, kind in ({"query_id": kinds["query_id"], "vec_id": "long", "score": "double"} | kinds).items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, codes, seen, held, numbers = Best(len(units), k), {}, 0, None, np.zeros(0, np.int64)
        for whole in batches:
            for b in (whole.slice(at, 4096) for at in range(0, whole.num_rows, 4096)):
                n = b.num_rows
                ids, vectors, tag = b.column(0).to_numpy(), rows_of(b.column(1), units.shape[1]), np.arange(seen, seen + n)
                pairs = Pairs({c: b.column(2 + i) for i, c in enumerate(own)}, asked, codes)
                seen += n
                step = max(1, BLOCK // n)
                for some in (np.arange(lo, min(lo + step, len(units))) for lo in range(0, len(units), step)):
                    scores = units[some] @ vectors.T
                    if rerank is None:
                        may = scores >= (best.floor[some] - 10.0**-places)[:, None]
                        if may.sum() * 20 <= may.size:
                            at, what = np.nonzero(may)
                            score = rounded(scores[at, what], places)
                            fits = score >= best.floor[some[at]]
                            if keep is not None:
                                fits &= keep(pairs.at(some[at], what))
                            best.merge(some[at][fits], ids[what[fits]], score[fits], tag[what[fits]])
                            continue
                    scores = rounded(scores, places)
                    pairs.at(some[:, None], np.arange(n)[None])
                    if rerank is not None:
                        scores = rounded(rerank(scores, pairs), places)
                    if keep is not None:
                        scores = np.where(keep(pairs), scores, -np.inf)
                    best.add(some, ids, scores, tag)
                if mine:  # the columns of rows that are in a list
                    now = pa.table({c: b.column(2 + own.index(c)) for c in mine})
                    wanted = np.unique(best.tag)
                    both, at = np.append(numbers, tag), None
                    held = now if held is None else pa.concat_tables([held, now])
                    at = np.searchsorted(both, wanted)
                    held, numbers = held.take(pa.array(at)).combine_chunks(), wanted
        out = {"query_id": [asked["query_id"][q] for q in best.query], "vec_id": pa.array(best.id), "score": pa.array(best.score)}
        at = pa.array(np.searchsorted(numbers, best.tag))
        for c in kinds:
            if c != "query_id":
                out[c] = (held.column(c).take(at) if held is not None else []) if c in mine else [asked[c][q] for q in best.query]
        if len(best.query):
            types = {c: queries.schema.field(c).type for c in asked}
            yield pa.RecordBatch.from_arrays([(x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x if isinstance(x, pa.Array) else pa.array(x, types[c])) for c, x in out.items()], names=list(out))

    return items.mapInArrow(run, schema)
