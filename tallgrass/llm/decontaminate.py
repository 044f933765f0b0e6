"""Benchmark decontamination by a generalised suffix automaton of normalised test items.

The automaton's alphabet is the words of the items. Documents are streamed through it; it keeps
the longest suffix of what was read that is a substring of an item. A word outside the alphabet
takes it back to the root, so a stretch of a document can only reach a window's length if all its
word pairs are pairs of some item: numpy finds these stretches, and only they are streamed, and of
stretches shorter than any window of several words only those with a word that is a window itself.

A window is `span` consecutive item words; an item of fewer words, but not none, is one window.
The automaton is as large as the benchmark (a fixed test set, not the corpus); it is built on the
driver, checked against MAX_ITEM_WORDS and broadcast.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .session import bounded_batches
from .textblock import ALNUM, LOWER, blocks, prefix_hash, span_hash, words

#: A benchmark of more words is refused: its automaton takes about 1.1 GB of the driver's Python while it is built, and
#: 70 MB when sent to the workers (measured: 300,000 random words take 330 MB and 10 s, and 21 MB).
MAX_ITEM_WORDS = 1_000_000


class Automaton:
    """Generalised suffix automaton over word numbers, with the items of each window.

    An edge is a state and a word, as state * width + word. While it is built, edges are in arrays and found by one
    dictionary; then in two flat arrays, sorted, which are searched by halves.
    """

    def __init__(self, items: list[tuple[str, list[int]]], span: int):
        self.span = span
        texts = [(name, seq) for name, seq in items if seq]
        self.width = max((max(seq) for _, seq in texts), default=0) + 1
        self.link, self.length = array("i", [-1]), array("i", [0])
        self._edge: dict[int, int] = {}
        # edges by number: word, target, the next edge of the same state; and each state's last edge
        self._word, self._to, self._next, self._last = array("i"), array("i"), array("i"), array("i", [-1])
        for seq in dict.fromkeys(tuple(seq) for _, seq in texts):
            last = 0
            for w in seq:
                last = self._extend(last, w)
        keys = np.fromiter(self._edge, np.int64, len(self._edge))
        order = np.argsort(keys)
        numbers = np.fromiter(self._edge.values(), np.int64, len(self._edge))[order]
        self._keys, self._target = array("q", keys[order].tobytes()), array("i", np.frombuffer(self._to, np.int32)[numbers].tobytes() if len(numbers) else b"")
        del self._edge, self._word, self._to, self._next, self._last
        self._mark(texts)

    def _state(self, length: int, link: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self._last.append(-1)
        return len(self.length) - 1

    def _join(self, p: int, w: int, to: int) -> None:
        self._edge[p * self.width + w] = len(self._to)
        self._word.append(w)
        self._to.append(to)
        self._next.append(self._last[p])
        self._last[p] = len(self._to) - 1

    def _built(self, p: int, w: int) -> int:
        """The state behind an edge while the automaton is built, or -1."""
        e = self._edge.get(p * self.width + w, -1)
        return -1 if e < 0 else self._to[e]

    def _clone(self, p: int, q: int, w: int) -> int:
        c = self._state(self.length[p] + 1, self.link[q])
        e = self._last[q]
        while e >= 0:
            self._join(c, self._word[e], self._to[e])
            e = self._next[e]
        self.link[q] = c
        while p >= 0 and self._built(p, w) == q:
            self._to[self._edge[p * self.width + w]] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, w: int) -> int:
        q = self._built(last, w)
        if q >= 0:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, w)
        cur = self._state(self.length[last] + 1, 0)
        p = last
        while p >= 0 and self._built(p, w) < 0:
            self._join(p, w, cur)
            p = self.link[p]
        if p >= 0:
            q = self._built(p, w)
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, w)
        return cur

    def next(self, v: int, w: int) -> int:
        """The state behind an edge, or -1."""
        key = v * self.width + w
        i = bisect_left(self._keys, key)
        return self._target[i] if i < len(self._keys) and self._keys[i] == key else -1

    def _mark(self, texts: list[tuple[str, list[int]]]) -> None:
        """own[v]: (length, items) of the windows that end in state v, longest first; marked[v]: the first state with some, on v's suffix links from v on."""
        own: dict[int, dict[int, set[str]]] = {}
        for name, seq in texts:
            v, length = 0, 0
            for i, w in enumerate(seq):
                v, length = self.next(v, w), length + 1
                if length > self.span:
                    length = self.span
                while self.length[self.link[v]] >= length:
                    v = self.link[v]
                if length == min(self.span, len(seq)) and (length == self.span or i == len(seq) - 1):
                    own.setdefault(v, {}).setdefault(length, set()).add(name)
        self.own = {v: tuple((n, tuple(names)) for n, names in sorted(by.items(), reverse=True)) for v, by in own.items()}
        self.marked = array("i", bytes(4 * len(self.length)))
        for v in np.argsort(np.frombuffer(self.length, np.int32), kind="stable").tolist()[1:]:
            self.marked[v] = v if v in self.own else self.marked[self.link[v]]

    def stream(self, seq: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of words inside a window's occurrence, disjoint and in order; items with occurring windows."""
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        v = length = 0
        for i, w in enumerate(seq):
            to = self.next(v, w)
            while v and to < 0:
                v = self.link[v]
                length = self.length[v]
                to = self.next(v, w)
            v = max(to, 0)
            length = length + 1 if v else 0
            longest, u = 0, self.marked[v]
            while u:
                for size, names in self.own[u]:
                    if size <= length:
                        longest = longest or size
                        found.update(names)
                u = self.marked[self.link[u]]
            if longest:
                a = i + 1 - longest
                while spans and spans[-1][1] >= a:
                    a = min(a, spans.pop()[0])
                spans.append((a, i + 1))
        return spans, found


class Matcher:
    """The automaton with its alphabet, and what finds the stretches worth streaming."""

    def __init__(self, rows: list[tuple[str, str | None]], span: int = 10):
        items, names = [], []
        data = [(text or "").encode() for _, text in rows]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
        part = np.frombuffer(b"".join(data), np.uint8)
        start, end, per_row = words(part, offsets, ALNUM)
        low = LOWER[part].tobytes()
        seen: dict[bytes, int] = {}
        numbers = [seen.setdefault(low[s:e], len(seen)) for s, e in zip(start.tolist(), end.tolist(), strict=True)]
        if len(numbers) > MAX_ITEM_WORDS:
            raise ValueError(f"the benchmark has {len(numbers)} words, more than {MAX_ITEM_WORDS}")
        for k, (name, _) in enumerate(rows):
            names.append(name)
            items.append((name, numbers[per_row[k] : per_row[k + 1]]))
        self.vocabulary = seen
        self.automaton = Automaton(items, span)
        sizes = [min(span, len(seq)) for _, seq in items if seq]
        # a stretch can hold a window if it is as long as the least one of several words, or holds a window of one word
        self.least = min((n for n in sizes if n > 1), default=1 << 60)
        self.single = np.zeros(len(seen) + 1, bool)
        self.single[[seq[0] for _, seq in items if seq and min(span, len(seq)) == 1 and span > 1]] = True
        if span == 1:
            self.single[: len(seen)] = True
        h = span_hash(prefix_hash(LOWER[part]), start, end) if len(part) else np.zeros(0, np.uint64)
        self.hashes, first = np.unique(h, return_index=True)
        self.numbers = np.array(numbers, np.int64)[first] if len(h) else np.zeros(0, np.int64)
        pairs = {(a, b) for _, seq in items for a, b in zip(seq, seq[1:], strict=False)}
        self.width = len(seen) + 1
        self.pairs = np.unique(np.array([a * self.width + b for a, b in pairs], np.int64))

    def rows(self, column: pa.Array) -> Iterator[tuple[int, int, list[tuple[int, int]], list[tuple[int, int]], set[str]]]:
        """For each text: its words, hit words, hit spans in words and in bytes, and items found."""
        for i, j, part, offsets in blocks(column):
            start, end, per_row = words(part, offsets, ALNUM)
            found: dict[int, tuple[list, list, set]] = {}
            for row, a, b in self._stretches(part, start, end, per_row):
                low = LOWER[part[start[a] : end[b - 1]]].tobytes()
                base = int(start[a])
                seq = [self.vocabulary.get(low[s - base : e - base], -1) for s, e in zip(start[a:b].tolist(), end[a:b].tolist(), strict=True)]
                spans, names = self.automaton.stream(seq)
                if spans:
                    w, c, k = found.setdefault(row, ([], [], set()))
                    first = a - int(per_row[row])
                    w.extend((first + s, first + e) for s, e in spans)
                    c.extend((int(start[a + s] - offsets[row]), int(end[a + e - 1] - offsets[row])) for s, e in spans)
                    k |= names
            count = np.diff(per_row).tolist()
            for row in range(j - i):
                w, c, k = found.get(row, ([], [], set()))
                yield count[row], sum(e - s for s, e in w), w, c, k

    def _stretches(self, part: np.ndarray, start: np.ndarray, end: np.ndarray, per_row: np.ndarray) -> list[tuple[int, int, int]]:
        """Row, first word and word behind the last of the stretches that can hold a window."""
        if not len(self.vocabulary) or not len(start):
            return []
        h = span_hash(prefix_hash(LOWER[part]), start, end)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        number = np.where(self.hashes[at] == h, self.numbers[at], -1)
        row = np.repeat(np.arange(len(per_row) - 1), np.diff(per_row))
        inside = number >= 0
        # joined[i]: word i goes on from word i - 1
        joined = np.zeros(len(h), bool)
        if len(self.pairs):
            both = np.flatnonzero(inside[1:] & inside[:-1] & (row[1:] == row[:-1])) + 1
            pair = number[both - 1] * self.width + number[both]
            p = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            joined[both[self.pairs[p] == pair]] = True
        head = np.flatnonzero(inside & ~joined)
        if not len(head):
            return []
        bound = np.append(head[1:], len(h))
        stop = np.flatnonzero(~joined)
        # a stretch ends before the next word that does not go on
        nxt = np.searchsorted(stop, head, "right")
        bound = np.where(nxt < len(stop), stop[np.minimum(nxt, len(stop) - 1)], len(h))
        alone = np.concatenate([[0], np.cumsum(self.single[number] & inside)])
        keep = (bound - head >= self.least) | (alone[bound] > alone[head])
        return list(zip(row[head[keep]].tolist(), head[keep].tolist(), bound[keep].tolist(), strict=True))


def matcher(benchmark: DataFrame, item_col: str, text_col: str, span: int) -> Matcher:
    """The benchmark's rows come to the driver: a test set, refused beyond MAX_ITEM_WORDS."""
    rows = benchmark.select(benchmark[item_col].cast("string"), benchmark[text_col]).toLocalIterator()
    kept, size = [], 0
    for name, text in rows:
        size += len(text or "") // 2 + 1
        if size > MAX_ITEM_WORDS * 8:
            raise ValueError(f"the benchmark is larger than {MAX_ITEM_WORDS} words")
        kept.append(("" if name is None else name, text))
    return Matcher(sorted(kept, key=lambda x: (x[0], x[1] or "")), span)


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", span: int = 10) -> DataFrame:
    """One row for each row of docs: id, n_words, n_hit, n_items, items, items_sha256, hit_spans.

    hit_spans are [start, end) word numbers inside occurrences of a benchmark window. Null and empty
    texts have no words; items without words match nothing; repeated rows are scored each on its own;
    other columns of docs are left aside, whatever their names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(matcher(benchmark, item_col, item_text, span))
    ids = docs.select(id_col, text_col).schema[0]
    schema = f"`{id_col}` {ids.dataType.simpleString()}, n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, hit_spans array<struct<start:int,end:int>>"
    none = hashlib.sha256(b"").hexdigest()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for n, hit, spans, _, names in m.rows(batch.column(1)):
                items = sorted(names)
                digest = hashlib.sha256(",".join(items).encode()).hexdigest() if items else none
                for column, value in zip(out, (n, hit, len(items), items, digest, [{"start": s, "end": e} for s, e in spans]), strict=True):
                    column.append(value)
            pair = pa.struct([("start", pa.int32()), ("end", pa.int32())])
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.list_(pair)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=[id_col, "n_words", "n_hit", "n_items", "items", "items_sha256", "hit_spans"])

    return docs.select(id_col, text_col).mapInArrow(scan, schema)


def remove_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", span: int = 10, max_coverage: float = 0.5) -> DataFrame:
    """docs without the hit spans, and without rows whose hit words are more than max_coverage of all.

    Columns and their order stay; texts that hold no window stay byte for byte, as do null texts. A cut span
    leaves what stands around it; nothing is put in its place.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(matcher(benchmark, item_col, item_text, span))
    at = docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            column = batch.column(at)
            keep, changed = [], {}
            for i, (n, hit, _, cuts, _) in enumerate(m.rows(column)):
                if hit and hit > max_coverage * n:
                    continue
                if hit:
                    data, out, last = column[i].as_py().encode(), [], 0
                    for s, e in cuts:
                        out.append(data[last:s])
                        last = e
                    changed[i] = b"".join([*out, data[last:]]).decode()
                keep.append(i)
            if changed:
                texts = column.to_pylist()
                for i, text in changed.items():
                    texts[i] = text
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, column.type))
            yield batch if len(keep) == batch.num_rows else batch.take(pa.array(keep, pa.int64()))

    return docs.mapInArrow(clean, docs.schema)
