"""A table as a plain dictionary: what every operation must give."""

from __future__ import annotations


class Model:
    """Keys to (value, blob); ``resolve(new, old)``."""

    def __init__(self, resolve, rows=None) -> None:
        self.resolve, self.rows = resolve, dict(rows or {})

    def apply(self, changes) -> None:
        for k, op, v, b in changes:
            if op == "I":
                self.rows[k] = (v, b)
            elif op == "D":
                self.rows.pop(k, None)
            else:
                old = self.rows.get(k)
                self.rows[k] = (v if old is None else self.resolve(v, old[0]), None)

    def copy(self) -> Model:
        return Model(self.resolve, self.rows)

    @staticmethod
    def union(models) -> Model:
        out = models[0].copy()
        for m in models[1:]:
            for k, (v, b) in m.rows.items():
                mine = out.rows.get(k)
                out.rows[k] = (v, b) if mine is None else (out.resolve(mine[0], v), mine[1])
        return out

    def sorted(self, order=lambda k: k):
        return [(k, *self.rows[k]) for k in sorted(self.rows, key=order)]
