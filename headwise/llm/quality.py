"""Quality rules as a short-circuit cascade.

Each rule's cost (CPU time a row) and share of rejected rows are measured on a sample; the rules
then run in the order of rejections per cost, each on the rows that all earlier ones passed. The
verdict is the same in any order: a row is kept if no rule rejects it.

Null text counts as empty: no words, so the rule on few words rejects it. Whole texts are read,
whatever their length; rows that repeat each get their verdict; other columns play no part.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .hashing import SPACE, U, prefix_sums, raw, spans_hash, windows, word_spans

WINDOW = 5
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True


class Texts:
    """Counts over the rows of an Arrow text column, each made when first asked for."""

    def __init__(self, column: pa.Array):
        self.column = column

    @cached_property
    def bytes(self) -> tuple[np.ndarray, np.ndarray]:
        return raw(self.column)

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return word_spans(*self.bytes)

    @cached_property
    def sums(self) -> np.ndarray:
        return prefix_sums(self.bytes[0])

    def _count(self, mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return np.diff(total[self.bytes[1]])

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.words[2])

    @cached_property
    def word_chars(self) -> np.ndarray:
        data = self.bytes[0]
        return self._count(~SPACE[data] & (data & 0xC0 != 0x80))

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self._count(SYMBOLS[self.bytes[0]])

    @cached_property
    def _lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines with a word, and lines equal to an earlier one of them, by row."""
        data, bounds = self.bytes
        breaks = np.flatnonzero(data == 10)
        starts = np.concatenate((bounds[:-1], breaks + 1))
        ends = np.concatenate((breaks, bounds[1:]))
        starts.sort()
        ends.sort()
        seen = np.concatenate(([0], np.cumsum(~SPACE[data], dtype=np.int64)))
        full = seen[ends] > seen[starts]
        row = (np.searchsorted(bounds, starts, "right") - 1)[full]
        # Empty rows share a bound: their lines hold no word, so the last of them may be named.
        line = spans_hash(self.sums, starts[full], ends[full])
        n = len(bounds) - 1
        once = np.unique(np.stack([row.astype(U), line]), axis=1)[0].astype(np.int64)
        lines = np.bincount(row, minlength=n)
        return lines, lines - np.bincount(once, minlength=n)

    @property
    def n_lines(self) -> np.ndarray:
        return self._lines[0]

    @property
    def n_dup_lines(self) -> np.ndarray:
        return self._lines[1]

    @cached_property
    def _word_hashes(self) -> np.ndarray:
        return spans_hash(self.sums, *self.words[:2])

    @cached_property
    def n_echoes(self) -> np.ndarray:
        """Words equal to the one before them."""
        words, first = self._word_hashes, self.words[2]
        echo = np.zeros(len(words) + 1, dtype=np.int64)
        echo[1:-1] = words[1:] == words[:-1]
        echo[first] = 0
        total = np.concatenate(([0], np.cumsum(echo[:-1])))
        return np.diff(total[first])

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        words, first = self._word_hashes, self.words[2]
        out = np.zeros(len(first) - 1, dtype=np.int64)
        for k, (a, b) in enumerate(zip(first[:-1], first[1:])):
            if b - a <= WINDOW:
                continue
            runs = windows(words[a:b], WINDOW)
            order = np.argsort(runs, kind="stable")
            same = runs[order[1:]] == runs[order[:-1]]
            if same.any():
                again = np.zeros(len(runs), dtype=bool)
                again[order[1:][same]] = again[order[:-1][same]] = True
                edge = np.zeros(b - a + 1, dtype=np.int64)
                edge[: len(again)] += again
                edge[WINDOW : WINDOW + len(again)] -= again
                out[k] = np.count_nonzero(np.cumsum(edge)[:-1])
        return out


Rule = Callable[[Texts], np.ndarray]

#: Name -> rows that the rule rejects.
BASE: dict[str, Rule] = {
    "few_words": lambda t: t.n_words < 10,
    "repeated_words": lambda t: 100 * t.n_repeat_words > 20 * t.n_words,
}
RULES: dict[str, Rule] = BASE | {
    "symbols": lambda t: 100 * t.n_symbols > 20 * t.n_words,
    "word_length": lambda t: (t.word_chars < 2 * t.n_words) | (t.word_chars > 20 * t.n_words),
    "echoes": lambda t: 100 * t.n_echoes > 30 * t.n_words,
    "duplicate_lines": lambda t: 100 * t.n_dup_lines > 50 * t.n_lines,
}


def estimates(docs: DataFrame, text_col: str = "text", rules: dict[str, Rule] = RULES, sample_rows: int = 2000) -> DataFrame:
    """(rule, cost, rejected): CPU seconds a row and share of rows rejected, on about ``sample_rows`` rows."""
    total = docs.count()
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    sample = texts.sample(fraction=min(1.0, sample_rows / max(1, total)), seed=6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for batch in slices(batches, "text"):
            for name, rule in rules.items():
                began = time.thread_time()
                bad = int(np.count_nonzero(rule(Texts(batch.column("text")))))
                out.append((name, time.thread_time() - began, batch.num_rows, bad))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 4, (pa.string(), pa.float64(), pa.int64(), pa.int64()))], ["rule", "s", "n", "bad"])

    sums = sample.mapInArrow(run, "rule string, s double, n long, bad long").groupBy("rule").agg(*(F.sum(c).alias(c) for c in ("s", "n", "bad")))
    return sums.select("rule", (F.col("s") / F.col("n")).alias("cost"), (F.col("bad") / F.col("n")).alias("rejected"))


def best_order(measured: Sequence[tuple[str, float, float]], rules: dict[str, Rule] = RULES) -> list[str]:
    """Most rejections per cost first; ties, and rules that no sample row met, by name."""
    rate = {name: rejected / max(cost, 1e-12) for name, cost, rejected in measured}
    return sorted(rules, key=lambda name: (-rate.get(name, 0.0), name))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: dict[str, Rule] = RULES, order: list[str] | None = None, counts: bool = True) -> DataFrame:
    """Verdict of each row: (id_col, kept, n_run), and with ``counts`` the numbers that BASE rests on.

    n_run is how many rules ran before the verdict. The order is measured unless given.
    """
    if order is None:
        order = best_order([tuple(r) for r in estimates(docs, text_col, rules).collect()], rules)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"] if counts else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            column = batch.column("text")
            kept, n_run = cascade(column, rules, order)
            whole = Texts(column)
            out = [batch.column("id"), pa.array(kept), pa.array(n_run)]
            out += [pa.array(getattr(whole, c).astype(np.int64)) for c in names]
            if counts:
                out.append(pa.array(np.logical_or.reduce([rule(whole) for rule in BASE.values()])))
            yield pa.RecordBatch.from_arrays(out, [id_col, "kept", "n_run", *names, *["base_failed"] * counts])

    kinds = [f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}", "kept boolean", "n_run long", *(f"{c} long" for c in names), *["base_failed boolean"] * counts]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ", ".join(kinds))


def cascade(column: pa.Array, rules: dict[str, Rule], order: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(kept, n_run): each rule sees only the rows that the rules before it passed."""
    left = np.arange(len(column))
    n_run = np.zeros(len(column), dtype=np.int64)
    here = Texts(column)
    for name in order:
        if not len(left):
            break
        n_run[left] += 1
        bad = rules[name](here)
        if bad.any():
            left = left[~bad]
            here = Texts(column.take(pa.array(left)))
    kept = np.zeros(len(column), dtype=bool)
    kept[left] = True
    return kept, n_run


def keep_good(docs: DataFrame, text_col: str = "text", rules: dict[str, Rule] = RULES) -> DataFrame:
    """The rows of ``docs``, with all their columns, that no rule rejects."""
    order = best_order([tuple(r) for r in estimates(docs, text_col, rules).collect()], rules)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = None
        for batch in batches:
            names = names or batch.schema.names
            # Columns may share a name: the text is found by its place.
            plain = pa.RecordBatch.from_arrays(batch.columns, [f"c{k}" for k in range(batch.num_columns)])
            for part in slices(iter([plain]), f"c{at}"):
                kept, _ = cascade(part.column(at), rules, order)
                yield pa.RecordBatch.from_arrays(part.filter(pa.array(kept)).columns, names)

    return docs.mapInArrow(run, docs.schema)
