"""Benchmark decontamination with a generalised suffix automaton of the test items."""

from __future__ import annotations

import re
from math import ceil
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcatlas.llm.common import cut

#: Bytes of words stay (A-Z as a-z); all others separate.
_TO_WORDS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_WORD = re.compile(rb"[^ ]+")

MATCH = "struct<n_words: bigint, starts: array<bigint>, ends: array<bigint>, items: array<string>>"


def words_of(text: bytes | None) -> list[bytes]:
    """Normalised words: A-Z lower-cased, runs of 0-9, a-z and all beyond ASCII."""
    return text.translate(_TO_WORDS).split() if text else []


class Automaton:
    """The suffix automaton of several word sequences, with the items of their windows.

    A state stands for the sequences that end at the same places. A window is ``window``
    consecutive words of an item; an item of fewer words is one window as a whole.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = 8):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        ends: list[tuple[int, str | None]] = []  # a state reached by an item's prefix, and the item
        shorts: list[tuple[list[int], str | None]] = []
        for item, words in items:
            if not words:
                continue
            codes = [self.ids.setdefault(w, len(self.ids)) for w in words]
            last = 0
            for c in codes:
                last = self._extend(last, c)
                ends.append((last, item))
            if len(codes) < window:
                shorts.append((codes, item))
        self._spread(ends, shorts)

    def _clone(self, p: int, c: int, q: int) -> int:
        """A copy of state q for the shorter sequences through p."""
        new = len(self.length)
        self.length.append(self.length[p] + 1)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.link[q] = new
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:  # an earlier item has this prefix
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        new = len(self.length)
        self.length.append(self.length[last] + 1)
        self.next.append({})
        self.link.append(0)
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return new

    def _spread(self, ends, shorts) -> None:
        """top: of each state that holds a window, the state of the window itself; items: of each such."""
        n, w, link, length = len(self.length), self.window, self.link, self.length
        order = sorted(range(n), key=length.__getitem__)
        self.top = [-1] * n
        for s in order:
            if length[s] >= w:
                self.top[s] = s if length[link[s]] < w else self.top[link[s]]
        self.items: dict[int, set] = {}
        for s, item in ends:
            if self.top[s] != -1:
                self.items.setdefault(self.top[s], set()).add(item)
        at: dict[int, list[tuple[int, str | None]]] = {}
        for codes, item in shorts:
            s = 0
            for c in codes:
                s = self.next[s][c]
            at.setdefault(s, []).append((len(codes), item))
        self.short: list[tuple] = [()] * n
        for s in order:
            self.short[s] = tuple(at.get(s, ())) + (self.short[link[s]] if link[s] != -1 else ())

    def match(self, words: list[bytes]) -> tuple[list[int], list[int], set]:
        """Hit word ranges (starts, ends exclusive) in order, disjoint; and the items."""
        nexts, link, length, top, short, window = self.next, self.link, self.length, self.top, self.short, self.window
        starts: list[int] = []
        ends: list[int] = []
        tops: set[int] = set()
        found: set = set()
        state = run = 0
        for i, c in enumerate(map(self.ids.get, words)):
            if c is None:
                state = run = 0
                continue
            to = nexts[state].get(c)
            while to is None and state:
                state = link[state]
                run = length[state]
                to = nexts[state].get(c)
            if to is None:
                continue
            state = to
            run += 1
            longest = 0
            if run >= window:
                longest = run
                tops.add(top[state])
            if short[state]:
                for m, item in short[state]:
                    if m <= run:
                        found.add(item)
                        longest = max(longest, m)
            if longest:
                lo = i + 1 - longest
                while starts and lo <= starts[-1]:
                    starts.pop()
                    ends.pop()
                if starts and lo <= ends[-1]:
                    ends[-1] = i + 1
                else:
                    starts.append(lo)
                    ends.append(i + 1)
        for t in tops:
            found |= self.items[t]
        found.discard(None)
        return starts, ends, found


def _matcher(shared):
    """An Arrow UDF over texts; ``shared`` broadcasts the items of one automaton."""
    key = uuid4().hex

    @F.arrow_udf(MATCH)
    def udf(texts: pa.Array) -> pa.Array:
        automaton = _built(key, shared)
        out = []
        for t in texts:
            words = words_of(t.as_py())
            starts, ends, found = automaton.match(words)
            out.append({"n_words": len(words), "starts": starts, "ends": ends, "items": sorted(found)})
        return pa.array(out, pa.struct([("n_words", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))]))

    return udf


_LATEST: dict = {}


def _built(key: str, shared) -> Automaton:
    """This worker's automaton for a broadcast; one at a time is held."""
    if key not in _LATEST:
        _LATEST.clear()
        _LATEST[key] = Automaton(*shared.value)
    return _LATEST[key]


def _named(items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    return items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text"))


def _chars(items: DataFrame) -> int:
    return items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]


def _share(items: DataFrame, window: int):
    rows = [(r["item"], words_of(bytes(r["text"]))) for r in items.select(F.col("item"), F.col("text").cast("binary").alias("text")).where("text is not null").collect()]
    return items.sparkSession.sparkContext.broadcast((rows, window))


def matches(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 8, name: str = "match", most_chars: int = 2_000_000) -> DataFrame:
    """``docs`` with a struct: number of words, hit word ranges and the items found.

    The tokens of each text stream through the automaton, which tracks the longest
    sequence that ends at the token and occurs in an item; words in any occurrence of a
    window are hit. A null text has no words. Items without words match nothing; an item
    whose id is null hits words but isn't listed; repeated ids are one item.

    Items come to the driver and are broadcast only up to ``most_chars`` characters
    together, which is checked first; an automaton of these takes about 230 MB in each
    Python worker. More items are dealt into parts of about that
    size; the documents are stored once and run through one part after another, and the
    ranges found are merged. One item must fit.
    """
    few = _named(items, item_id, item_text)
    total = _chars(few)
    if total <= most_chars:
        return docs.withColumn(name, _matcher(_share(few, window))(F.col(text).cast("binary")))
    parts = ceil(total / most_chars)
    dealt = few.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(parts)))
    base = cut(docs.withColumn("__row", F.monotonically_increasing_id()))
    found = None
    for k in range(parts):
        shared = _share(dealt.where(F.col("part") == k), window)
        one = base.select("__row", _matcher(shared)(F.col(text).cast("binary")).alias("m"))
        one = cut(one if k == 0 else one.where(F.size("m.starts") > 0))
        found = one if found is None else found.unionByName(one)
        shared.unpersist()
    merged = found.groupBy("__row").agg(
        F.max("m.n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list(F.arrays_zip(F.col("m.starts").alias("lo"), F.col("m.ends").alias("hi"))))).alias("ranges"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("m.items")))).alias("items"),
    )
    folded = F.expr(
        "aggregate(ranges, cast(array() as array<struct<lo: bigint, hi: bigint>>), (done, r) -> case "
        "when size(done) = 0 or r.lo > element_at(done, -1).hi then concat(done, array(r)) "
        "else concat(slice(done, 1, size(done) - 1), array(named_struct('lo', element_at(done, -1).lo, 'hi', greatest(element_at(done, -1).hi, r.hi)))) end)"
    )
    merged = merged.withColumn("ranges", folded).select("__row", F.struct("n_words", F.col("ranges.lo").alias("starts"), F.col("ranges.hi").alias("ends"), "items").alias(name))
    return base.join(merged, "__row").drop("__row")


def hit_words(match):
    """How many words the ranges of a match hold."""
    return F.aggregate(F.zip_with(match["ends"], match["starts"], lambda e, s: e - s), F.lit(0).cast("bigint"), lambda a, b: a + b)


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 8, max_words: int = 8, max_coverage: float = 0.5, min_items: int = 1, most_chars: int = 2_000_000) -> DataFrame:
    """``docs`` without contaminated passages, same columns.

    Ranges of at least ``max_words`` hit words are cut out of the text, and those that are
    a whole item of fewer words than a window, in documents where at least ``min_items``
    items occur (items without an id count as one more); a document that hits more than
    ``max_coverage`` of its words is dropped as a whole. Other documents stay unchanged,
    those without words or text included.
    """
    few = _named(items, item_id, item_text)
    if _chars(few) <= most_chars:
        # one UDF that Spark doesn't repeat for the filter, so one Python worker a task
        shared, key = _share(few, window), uuid4().hex

        @F.arrow_udf("struct<text: string, keep: boolean>")
        def cleaned(texts: pa.Array) -> pa.Array:
            automaton, out = _built(key, shared), []
            for t in texts:
                raw = t.as_py()
                words = words_of(raw)
                starts, ends, found = automaton.match(words)
                # ranges without a listed item are those of items without an id
                taken = bool(starts) and max(len(found), 1) >= min_items
                hits = sum(ends) - sum(starts)
                out.append({"text": _without(raw, starts, ends, max_words, window) if taken else _text(raw), "keep": not taken or hits <= len(words) * max_coverage})
            return pa.array(out, pa.struct([("text", pa.string()), ("keep", pa.bool_())]))

        done = docs.withColumn("__clean", cleaned.asNondeterministic()(F.col(text).cast("binary")))
        return done.where("__clean.keep").withColumn(text, F.col("__clean.text")).select(*docs.columns)
    marked = matches(docs, items, text, item_id, item_text, window, "__match", most_chars)
    hits = F.col("__match")

    @F.arrow_udf("string")
    def cut_out(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        return pa.array([_without(t.as_py(), lo or [], hi or [], max_words, window) for t, lo, hi in zip(texts, starts.to_pylist(), ends.to_pylist(), strict=True)], pa.string())

    taken = (F.size("__match.starts") > 0) & (F.greatest(F.size("__match.items"), F.lit(1)) >= min_items)
    whole = marked.where(~taken | (hit_words(hits) <= F.col("__match.n_words") * F.lit(max_coverage)))
    empty = F.array().cast("array<bigint>")
    shorter = cut_out(F.col(text).cast("binary"), F.when(taken, F.col("__match.starts")).otherwise(empty), F.when(taken, F.col("__match.ends")).otherwise(empty))
    return whole.withColumn(text, shorter).select(*docs.columns)


def _text(raw: bytes | None) -> str | None:
    return None if raw is None else raw.decode("utf-8", "replace")


def _without(raw: bytes | None, starts: list[int], ends: list[int], max_words: int, window: int) -> str | None:
    """The text without its ranges of at least ``max_words`` words, or of fewer than a window: those are whole items."""
    ranges = [(lo, hi) for lo, hi in zip(starts, ends, strict=True) if hi - lo >= max_words or hi - lo < window]
    if not ranges:
        return _text(raw)
    spans = [m.span() for m in _WORD.finditer(raw.translate(_TO_WORDS))]
    kept, at = [], 0
    for lo, hi in ranges:
        kept.append(raw[at : spans[lo][0]])
        at = spans[hi - 1][1]
    return _text(b"".join([*kept, raw[at:]]))
