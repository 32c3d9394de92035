"""The best documents of many queries at once, as blocks of documents come in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd


class Best:
    """Of each of n queries the k least values with their documents, ties to the lesser id; limit: each query's k-th value, infinite before it has k."""

    def __init__(self, n: int, k: int):
        self.k, self.limit = k, np.full(n, np.inf)
        self.query, self.value, self.ids = np.zeros(0, dtype=np.int64), np.zeros(0), None
        self.fresh: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, query: np.ndarray, value: np.ndarray, ids: np.ndarray) -> None:
        """Candidates, those of a query together or not. What lies beyond its query's limit may be left out by the caller."""
        if len(query):
            self.fresh.append((query, value, ids))
        if sum(len(q) for q, _, _ in self.fresh) > (len(self.query) // 2 if np.isfinite(self.limit).all() else 0):
            self.merge()

    def merge(self) -> None:
        if not self.fresh:
            return
        query, value, ids = (np.concatenate(parts) for parts in zip(*self.fresh, strict=True))
        self.fresh = []
        if self.ids is None:
            self.ids = ids[:0]
        touched = np.zeros(len(self.limit), dtype=bool)
        touched[query] = True
        old = touched[self.query]
        q, v, d = np.concatenate([self.query[old], query]), np.concatenate([self.value[old], value]), np.concatenate([self.ids[old], ids])
        tie = np.unique(d, return_inverse=True)[1] if d.dtype == object else d
        order = np.lexsort((tie, v, q))
        q, v, d = q[order], v[order], d[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.k - 1
        self.limit[q[last]] = v[last]
        kept = place < self.k
        self.query, self.value, self.ids = (np.concatenate([a[~old], b[kept]]) for a, b in ((self.query, q), (self.value, v), (self.ids, d)))

    def rows(self, names: np.ndarray, column: str, sign: int = 1, most: int = 100_000) -> Iterator[pd.DataFrame]:
        """(qid, doc_id, column) of what is kept, names being the queries' ids."""
        self.merge()
        for k in range(0, len(self.query), most):
            s = slice(k, k + most)
            yield pd.DataFrame({"qid": names[self.query[s]], "doc_id": self.ids[s], column: sign * self.value[s] + 0.0})
