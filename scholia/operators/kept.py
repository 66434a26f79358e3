"""The nearest vectors that a task keeps of those it has seen."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from scholia.functions.batches import lists

#: Vectors whose distances to a block are in memory at once.
SEEN_ROWS = 2048


def distances(queries: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        return np.sqrt(np.maximum(0.0, (queries**2).sum(1)[:, None] + (rows**2).sum(1)[None, :] - 2 * queries @ rows.T))
    if metric == "dot":
        return -(queries @ rows.T)
    norm = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)
    return 1 - norm(queries) @ norm(rows).T


def other_scopes(own: list, theirs: list) -> np.ndarray:
    """Whether scopes differ, by pairs; null is no scope."""
    codes = {s: n for n, s in enumerate(dict.fromkeys(theirs + own))}
    left, right = (np.array([codes[s] if s is not None else none for s in held], int) for held, none in ((own, -1), (theirs, -2)))
    return left[:, None] != right[None, :]


class Best:
    """The nearest of a block of queries among the vectors that a task has seen.

    What has been handed on no longer counts as held, but its distances still
    bound what may come after it.
    """

    def __init__(self, queries: bytes, names: list, depths: list[int], scopes: list, metric: str, scoped: bool, with_vectors: bool):
        self.queries = np.frombuffer(queries).reshape(len(names), -1)
        self.names, self.depths, self.scopes = names, np.array(depths), scopes
        self.metric, self.scoped, self.with_vectors = metric, scoped, with_vectors
        self.limit = np.full(len(names), np.inf)
        self.norms = np.linalg.norm(self.queries, axis=1)
        self._clear()

    def _clear(self) -> None:
        self.who, self.away, self.ids, self.rows = [], [], [], []
        self.count = 0

    def size(self) -> int:
        return self.count * (64 + (8 * self.queries.shape[1] if self.with_vectors else 0))

    def see(self, ids: pa.Array, scopes: list, rows: np.ndarray, apart: np.ndarray | None = None) -> None:
        """apart: which rows are no candidates of a query, by query and row."""
        if rows.shape[1] != self.queries.shape[1]:
            return
        for low in range(0, len(rows), SEEN_ROWS):
            part = slice(low, low + SEEN_ROWS)
            self._see(ids.slice(low, SEEN_ROWS), scopes[part], rows[part], None if apart is None else apart[:, part])

    def _see(self, ids: pa.Array, scopes: list, rows: np.ndarray, apart: np.ndarray | None) -> None:
        # Of l2 half the square, without the query's own: one product and one comparison of each pair.
        squares = (rows**2).sum(axis=1)
        about = squares / 2 - self.queries @ rows.T if self.metric == "l2" else distances(self.queries, rows, self.metric)
        if self.scoped:
            about[other_scopes(self.scopes, scopes)] = np.inf
        if apart is not None:
            about[apart] = np.inf
        bound = self.limit.copy()
        for q in np.flatnonzero(np.isinf(bound) & (self.depths < len(rows))):
            bound[q] = np.partition(about[q], self.depths[q] - 1)[self.depths[q] - 1]
            if self.metric == "l2":
                bound[q] = np.sqrt(np.maximum(0.0, self.norms[q] ** 2 + 2 * bound[q]))
        # The expanded square is a little off.
        most = np.sqrt(squares.max())
        if self.metric == "l2":
            bound += 1e-8 + 1e-6 * (self.norms + most)
            bound = (bound**2 - self.norms**2) / 2
        else:
            bound += 1e-8 * (1 + self.norms * most)
        bound[np.isnan(bound)] = np.inf
        who, at = np.nonzero(about <= bound[:, None])
        away = about[who, at]
        # What no double can hold is no candidate.
        held = np.isfinite(away)
        who, at = who[held], at[held]
        # Rounded, so that equal distances are equal in whatever shard they were computed.
        away = away[held].round(9)
        if self.metric == "l2":
            for some in range(0, len(who), SEEN_ROWS):
                part = slice(some, some + SEEN_ROWS)
                away[part] = np.sqrt(((rows[at[part]] - self.queries[who[part]]) ** 2).sum(axis=1)).round(9)
        near = away <= self.limit[who]
        who, at, away = who[near], at[near], away[near]
        order = self._first(who, away, ids.take(pa.array(at)))
        who, at, away = who[order], at[order], away[order]
        self.who.append(who)
        self.away.append(away)
        self.ids.append(ids.take(pa.array(at)))
        if self.with_vectors:
            self.rows.append(rows[at])
        self.count += len(who)
        if self.count > 2 * self.depths.sum():
            self._trim()

    def _first(self, who: np.ndarray, away: np.ndarray, ids: pa.Array) -> np.ndarray:
        """Which rows are the nearest of each query, in its order; ties to the smaller id."""
        order = pc.sort_indices(pa.table({"who": who, "away": away, "id": ids}), sort_keys=[(n, "ascending") for n in ("who", "away", "id")]).to_numpy()
        place = np.arange(len(order)) - np.searchsorted(who[order], who[order])
        last = order[place == self.depths[who[order]] - 1]
        self.limit[who[last]] = np.minimum(self.limit[who[last]], away[last])
        return order[place < self.depths[who[order]]]

    def _trim(self) -> None:
        who, away, ids = np.concatenate(self.who), np.concatenate(self.away), pa.concat_arrays(self.ids)
        kept = self._first(who, away, ids)
        rows = [np.concatenate(self.rows)[kept]] if self.with_vectors else []
        self.who, self.away, self.ids, self.rows = [who[kept]], [away[kept]], [ids.take(pa.array(kept))], rows
        self.count = len(kept)

    def found(self, types: dict) -> Iterator[pa.RecordBatch]:
        """q, k, id, distance and vector of what is held, which is held no longer."""
        if self.count:
            self._trim()
            (who,), (away,), (ids,) = self.who, self.away, self.ids
            for low in range(0, len(who), SEEN_ROWS):
                part = slice(low, low + SEEN_ROWS)
                columns = {
                    "q": pa.array([self.names[q] for q in who[part].tolist()], types["q"]), "k": pa.array(self.depths[who[part]].astype(np.int32)),
                    "id": ids.slice(low, SEEN_ROWS).cast(types["id"]), "distance": pa.array(away[part]),
                }
                if self.with_vectors:
                    columns["v"] = lists(self.rows[0][part], types["v"])
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
        self._clear()
