"""Benchmark decontamination by a generalised suffix automaton.

Test items are normalised to words and built into one automaton that recognises
every run of words of every item. A document is streamed through it: after each
word the state and length of the longest run ending there that some item has.
Where that length reaches ``window`` words, the last ``window`` of them are an
occurrence; an item of fewer words occurs as a whole. Words inside occurrences
are hit; documents over the coverage limit are contaminated, and spans can be cut.

The items are handled in shards of bounded size, each one automaton, built in the
driver and laid flat in arrays. Up to ``PASS_SHARDS`` of them are sent to the tasks
together, and a pass of the documents streams each text through all of these; there
is no shuffle, so neither side ever meets the other in a join. Usual benchmarks are one
shard. A long item is cut into chunks that overlap by a window less one word, so no
window is lost and no shard is larger than its bound by more than one chunk.

Nulls and empty texts have no words and are never hit. Items with no words
occur nowhere; rows that repeat an item_id count as one item. Items with a null id
are hit like any other and count as one item together; the digest of ids leaves it out.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import Run, bounded_batches, free_name, room_for, written
from .textbatch import WordTable, arrow_batches, fold_ascii, plain_words, runs, spread, text_bytes

WINDOW = 13
#: Bytes of item text in one automaton (about a hundred bytes of the driver's memory for each while it is built, ten once it is flat), and words in a chunk of an item.
SHARD_BYTES = 1_000_000
CHUNK = 1000
#: Flat automata that a worker holds at a time.
PASS_SHARDS = 8
#: States whose moves a worker holds as a dict, for each automaton.
OPEN_STATES = 1 << 15
#: Contaminated if at least one in so many words is hit.
COVERAGE = 20


def item_words(texts: pa.Array) -> list[list[bytes]]:
    """Each text's normalised words."""
    buf, offsets = text_bytes(texts)
    buf = fold_ascii(buf)
    starts, ends, count = plain_words(buf, offsets)
    data, out, k = buf.tobytes(), [], 0
    for n in count.tolist():
        out.append([data[i:j] for i, j in zip(starts[k : k + n].tolist(), ends[k : k + n].tolist(), strict=True)])
        k += n
    return out


@dataclass
class Lists:
    """A list of numbers for each state, end to end."""

    offsets: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, rows: Iterable[Iterable[int]]) -> Lists:
        values, ends = array("i"), array("q", [0])
        for row in rows:
            values.extend(row)
            ends.append(len(values))
        return cls(np.array(ends, np.int64), np.array(values, np.int32))

    def __getitem__(self, state: int) -> list[int]:
        return self.values[self.offsets[state] : self.offsets[state + 1]].tolist()


@dataclass
class Automaton:
    """Suffix automaton of many word sequences, as it is built. State 0 is the root."""

    window: int = WINDOW
    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])

    def _state(self, length: int, move: dict[int, int], link: int) -> int:
        self.next.append(move)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: int) -> int:
        q = self.next[last].get(word)
        if q is not None:  # another item has this run already
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new

    def build(self, sequences: list[tuple[object, list[int]]]) -> Automaton:
        """sequences: (item, words); then each state's items are found by running the items through it."""
        for _, words in sequences:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self.holder = self._holders()
        self.of_window: dict[int, set] = {}
        self.whole: dict[int, dict[int, set]] = {}
        for item, words in sequences:
            s = 0
            for w in words:
                s = self.next[s][w]
                if self.length[s] >= self.window:
                    self.of_window.setdefault(self.holder[s], set()).add(item)
            if words and len(words) < self.window:
                self.whole.setdefault(s, {}).setdefault(len(words), set()).add(item)
        # the nearest state on the way to the root, itself included, at which a short item ends
        self.short = [-1] * len(self.link)
        for s in sorted(range(len(self.link)), key=self.length.__getitem__):
            self.short[s] = s if s in self.whole else self.short[self.link[s]] if s else -1
        return self

    def _holders(self) -> list[int]:
        """For each state of runs of ``window`` words or more, the state of their last ``window`` words."""
        out = list(range(len(self.link)))
        for s in sorted(out, key=self.length.__getitem__)[1:]:
            if self.length[self.link[s]] >= self.window:
                out[s] = out[self.link[s]]
        return out

    def flat(self) -> FlatAutomaton:
        items = sorted({x for found in self.of_window.values() for x in found} | {x for sizes in self.whole.values() for found in sizes.values() for x in found}, key=lambda x: (x is None, x or ""))
        number = {x: k for k, x in enumerate(items)}
        states, none = range(len(self.link)), {}
        return FlatAutomaton(
            self.window,
            items,
            words=Lists.of(self.next),
            targets=Lists.of(m.values() for m in self.next),
            link=np.array(self.link, np.int32),
            length=np.array(self.length, np.int32),
            holder=np.array(self.holder, np.int32),
            short=np.array(self.short, np.int32),
            of_window=Lists.of(map(number.__getitem__, self.of_window.get(s, ())) for s in states),
            whole_sizes=Lists.of((size for size, found in self.whole.get(s, none).items() for _ in found) for s in states),
            whole_items=Lists.of((number[x] for found in self.whole.get(s, none).values() for x in found) for s in states),
        )


@dataclass
class FlatAutomaton:
    """The automaton in arrays: what is sent, and what texts are streamed through.

    Moves of a state become a dict when a text first comes there; so many dicts are held, then none.
    """

    window: int
    items: list[str | None]
    words: Lists
    targets: Lists
    link: np.ndarray
    length: np.ndarray
    holder: np.ndarray
    short: np.ndarray
    of_window: Lists
    whole_sizes: Lists
    whole_items: Lists
    opened: dict[int, dict[int, int]] = field(default_factory=dict, repr=False)

    def open(self, state: int) -> dict[int, int]:
        if len(self.opened) >= OPEN_STATES:
            self.opened.clear()
        moves = self.opened[state] = dict(zip(self.words[state], self.targets[state], strict=True))
        return moves

    def stream(self, words: list[int]) -> tuple[list[tuple[int, int]], set]:
        """Occurrences as (first, end) word positions, and the items that occur."""
        s, n, run = 0, 0, -1
        found: list[tuple[int, int]] = []
        items, held = set(), set()
        opened, window = self.opened, self.window
        link, length, short, holder = map(memoryview, (self.link, self.length, self.short, self.holder))
        for k, w in enumerate(words, 1):
            while True:
                moves = opened.get(s)
                to = (self.open(s) if moves is None else moves).get(w)
                if to is not None or not s:
                    break
                s = link[s]
                n = length[s]
            if to is None:
                continue
            s = to
            n += 1
            if n >= window:
                if run >= 0 and found[run][1] == k - 1:  # windows one behind the other are one stretch
                    found[run] = found[run][0], k
                else:
                    run = len(found)
                    found.append((k - window, k))
                held.add(holder[s])
            t = short[s]
            while t > 0:  # at most one state for each length under the window
                for size, item in zip(self.whole_sizes[t], self.whole_items[t], strict=True):
                    if size <= n:
                        found.append((k - size, k))
                        items.add(item)
                t = short[link[t]]
        return found, {self.items[x] for x in items.union(*(self.of_window[h] for h in held))}


@dataclass
class Shard:
    """``pairs``: the items' pairs of neighbouring words, as first * ``words`` + second, in order; ``words``: how many words it has."""

    vocabulary: list[bytes]
    automaton: FlatAutomaton
    words: int
    pairs: np.ndarray
    least: int


def make_shard(rows: list[tuple[str | None, list[bytes]]], window: int) -> Shard | None:
    vocabulary: dict[bytes, int] = {}
    sequences = [(item, [vocabulary.setdefault(w, len(vocabulary)) for w in words]) for item, words in rows if words]
    if not sequences:
        return None
    pairs = np.unique(np.concatenate([np.array(w[:-1], np.int64) * len(vocabulary) + np.array(w[1:], np.int64) for _, w in sequences]))
    return Shard(list(vocabulary), Automaton(window).build(sequences).flat(), len(vocabulary), pairs, min(window, *(len(w) for _, w in sequences)))


@dataclass
class Pack:
    """The shards of one pass: all their words, and for each shard the shard's own number of each (-1: it has no such word)."""

    vocabulary: list[bytes]
    shards: list[tuple[Shard, np.ndarray]]

    @classmethod
    def of(cls, shards: list[Shard]) -> Pack:
        number: dict[bytes, int] = {}
        for shard in shards:
            for w in shard.vocabulary:
                number.setdefault(w, len(number))
        out = []
        for shard in shards:
            own = np.full(len(number), -1, np.int32)
            own[[number[w] for w in shard.vocabulary]] = np.arange(len(shard.vocabulary))
            out.append((replace(shard, vocabulary=[]), own))
        return cls(list(number), out)


def chunks(benchmark: DataFrame, window: int = WINDOW, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, words): normalised words of every item, end to end with blanks; long items in overlapping rows."""
    step = max(CHUNK, 2 * window) - window + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_batches(batches):
            items, rows = [], []
            for item, words in zip(batch.column("item").to_pylist(), item_words(batch.column("text")), strict=True):
                for k in range(0, max(1, len(words) - window + 1), step) if words else ():
                    items.append(item)
                    rows.append(b" ".join(words[k : k + step + window - 1]))
            yield pa.RecordBatch.from_pydict({"item": pa.array(items, pa.string()), "words": pa.array(rows, pa.binary()).cast(pa.string())})

    bounded_batches(benchmark.sparkSession)
    return benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("text is not null").mapInArrow(cut, "item string, words string").distinct()


def shards(benchmark: DataFrame, window: int = WINDOW, item_col: str = "item_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> Iterator[Shard]:
    """The items' automata, one for each ``shard_bytes`` of text. The driver holds one partition of chunks and one shard at a time."""
    rows, size = [], 0
    for r in chunks(benchmark, window, item_col, text_col).toLocalIterator():
        if size + len(r.words) > shard_bytes and rows:
            yield make_shard(rows, window)
            rows, size = [], 0
        rows.append((r.item, r.words.encode().split(b" ")))
        size += len(r.words)
    if rows:
        yield make_shard(rows, window)


HITS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hit_words", T.ArrayType(T.LongType())), T.StructField("hit_bytes", T.ArrayType(T.LongType())), T.StructField("hit_items", T.ArrayType(T.StringType()))])
_HITS = pa.schema([("n_words", pa.int64()), ("hit_words", pa.list_(pa.int64())), ("hit_bytes", pa.list_(pa.int64())), ("hit_items", pa.list_(pa.string()))])


def stretches(ids: np.ndarray, first: np.ndarray, shard: Shard) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of words that are worth streaming: as long as the shortest window, of words and of pairs of words that items have.

    Anything else between two words would take the automaton back to its root, or one word from it.
    """
    begin, end, _ = runs(ids >= 0, first)
    long = end - begin >= shard.least
    begin, end = begin[long], end[long]
    at = spread(begin, end - begin)
    if not len(at):
        return begin, end
    opens = np.zeros(len(at), bool)
    opens[np.cumsum(end - begin) - (end - begin)] = True
    key = ids[at[:-1]].astype(np.int64) * shard.words + ids[at[1:]]
    slot = np.minimum(np.searchsorted(shard.pairs, key), len(shard.pairs) - 1) if len(shard.pairs) else None
    opens[1:] |= True if slot is None else shard.pairs[slot] != key
    begin, end = at[opens], at[np.append(opens[1:], True)] + 1
    long = end - begin >= shard.least
    return begin[long], end[long]


def scan(batch: pa.RecordBatch, text_col: str, pack: Pack, table: WordTable) -> dict[str, list]:
    """For each text its words, the words hit, their byte ranges (start, end, start, ...) and items."""
    buf, offsets = text_bytes(batch.column(text_col))
    buf = fold_ascii(buf)
    starts, ends, count = plain_words(buf, offsets)
    ids = table.ids(buf, starts, ends, add=False)
    known = ids >= 0
    first = np.concatenate([[0], np.cumsum(count)])
    out: dict[int, tuple[set, set]] = {}
    for shard, numbers in pack.shards:
        own = np.full(len(ids), -1, np.int32)
        own[known] = numbers[ids[known]]
        for i, j in zip(*(x.tolist() for x in stretches(own, first, shard)), strict=True):
            found, items = shard.automaton.stream(own[i:j].tolist())
            if found:
                doc = int(np.searchsorted(first, i, side="right")) - 1
                words, all_items = out.setdefault(doc, (set(), set()))
                for a, b in found:
                    words.update(range(i + a, i + b))
                all_items |= items
    none: list = []
    hit_words, hit_bytes, hit_items = ([none] * len(count) for _ in range(3))
    for doc, (words, items) in out.items():
        at = np.array(sorted(words))
        hit_words[doc] = (at - first[doc]).tolist()
        hit_bytes[doc] = np.stack([starts[at], ends[at]], 1).ravel().__sub__(offsets[doc]).tolist()
        hit_items[doc] = in_order(items)
    return {"n_words": count.tolist(), "hit_words": hit_words, "hit_bytes": hit_bytes, "hit_items": hit_items}


def in_order(items: set[str | None]) -> list[str | None]:
    """Ids in order, null behind them."""
    return sorted(items, key=lambda x: (x is None, x or ""))


def table_of(vocabulary: list[bytes]) -> WordTable:
    """Words with their places in the list."""
    table = WordTable(None)
    if vocabulary:
        buf, offsets = text_bytes(pa.array([w.decode() for w in vocabulary], pa.string()))
        back = np.zeros(len(vocabulary) + 1, np.int64)  # the table numbers words in an order of its own
        back[table.ids(buf, offsets[:-1], offsets[1:])] = np.arange(len(vocabulary))
        table.id = back[table.id].astype(np.int32)
        table.long = {w: int(back[k]) for w, k in table.long.items()}
    return table


def packs(found: Iterator[Shard], size: int) -> Iterator[Pack]:
    """``size`` shards at a time."""
    while shards := list(islice(found, size)):
        yield Pack.of(shards)


def passes(docs: DataFrame, benchmark: DataFrame, text_col: str, window: int, name: str, finish: Callable[[pa.RecordBatch, dict[str, list]], pa.RecordBatch], schema: T.StructType, pass_shards: int = PASS_SHARDS, **named: object) -> DataFrame:
    """``docs`` through all shards; ``finish`` makes rows of ``schema`` of a batch and its hits, in the last pass.

    A worker holds ``pass_shards`` flat automata at most. If there are more, the rows are
    written in the shared folder and read again between two passes, and what was read before is deleted.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    out = docs
    found = packs(shards(benchmark, window, **named), pass_shards)
    pack, number = next(found, Pack([], [])), 0
    with Run(spark) as mine:
        while pack is not None:
            following = next(found, None)
            sent = spark.sparkContext.broadcast(pack)

            def run(batches: Iterator[pa.RecordBatch], sent=sent, first=number == 0, last=following is None) -> Iterator[pa.RecordBatch]:
                pack = sent.value
                table = table_of(pack.vocabulary)
                for batch in arrow_batches(batches):
                    new = scan(batch, text_col, pack, table)
                    if not first:
                        k = batch.schema.get_field_index(name)
                        new = merge(batch.column(k).to_pylist(), new)
                        batch = batch.remove_column(k)
                    yield finish(batch, new) if last else batch.append_column(name, hits_array(new))

            out = out.mapInArrow(run, schema if following is None else T.StructType([*docs.schema, T.StructField(name, HITS)]))
            if following is not None:
                out = written(out, "decontam-hits")
                mine.drop(but=1)
                sent.unpersist()
            pack, number = following, number + 1
    return out


def hits_array(hits: dict[str, list]) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(hits[f.name], f.type) for f in _HITS], fields=list(_HITS))


def find_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, name: str | None = None, **named: object) -> DataFrame:
    """``docs`` with one more column, the last, of what is hit; by default its name is a free one like ``hits``. No shuffle."""
    docs, name = room_for(docs, name, "hits")
    return passes(docs, benchmark, text_col, window, name, lambda batch, hits: batch.append_column(name, hits_array(hits)), T.StructType([*docs.schema, T.StructField(name, HITS)]), **named)


def merge(old: list[dict], new: dict[str, list]) -> dict[str, list]:
    """Hits of earlier passes and of this one."""
    for k, was in enumerate(old):
        at = dict(zip(was["hit_words"], zip(was["hit_bytes"][::2], was["hit_bytes"][1::2], strict=True), strict=True))
        at |= dict(zip(new["hit_words"][k], zip(new["hit_bytes"][k][::2], new["hit_bytes"][k][1::2], strict=True), strict=True))
        new["hit_words"][k] = sorted(at)
        new["hit_bytes"][k] = [x for w in sorted(at) for x in at[w]]
        new["hit_items"][k] = in_order({*was["hit_items"], *new["hit_items"][k]})
    return new


def contaminated(coverage: int = COVERAGE, name: str = "hits") -> Column:
    hit = F.size(f"{name}.hit_words")
    return (hit > 0) & (coverage * hit >= F.col(f"{name}.n_words"))


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", coverage: int = COVERAGE, **named: object) -> DataFrame:
    """A row per document: words, words hit, items, their digest and the verdict."""
    found = find_hits(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark, "text", name="hits", **named)
    items = F.array_sort("hits.hit_items")
    return found.select("doc_id", F.col("hits.n_words").alias("n_words"), F.size("hits.hit_words").cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), contaminated(coverage).alias("contaminated"))


def without(text: str | None, spans: list[int]) -> str | None:
    """The text without its byte ranges; words that touch go together with what parts them."""
    if text is None or not spans:
        return text
    raw, out, at, k = text.encode(), [], 0, 0
    while k < len(spans):
        i, j = spans[k], spans[k + 1]
        while k + 2 < len(spans) and not _has_word(raw[j : spans[k + 2]]):
            k += 2
            j = spans[k + 1]
        out.append(raw[at:i])
        at, k = j, k + 2
    return b"".join([*out, raw[at:]]).decode()


def _has_word(raw: bytes) -> bool:
    return any(b >= 128 or chr(b).isalnum() for b in raw)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", action: str = "drop", coverage: int = COVERAGE, window: int = WINDOW, **named: object) -> DataFrame:
    """``docs`` without contamination, columns as they are, done in the pass that finds it.

    action "drop" leaves out contaminated documents; "cut" keeps every document
    and removes the spans that are hit from the contaminated ones; "cut_all"
    removes them wherever they are, as the length limit alone asks.
    """
    if action not in ("drop", "cut", "cut_all"):
        raise ValueError(f"unknown action: {action}")

    def finish(batch: pa.RecordBatch, hits: dict[str, list]) -> pa.RecordBatch:
        n_hit = np.array(list(map(len, hits["hit_words"])), np.int64)
        bad = (n_hit > 0) & (coverage * n_hit >= np.array(hits["n_words"], np.int64))
        if action == "drop":
            return batch if not bad.any() else batch.filter(pa.array(~bad))
        bad |= (n_hit > 0) & (action == "cut_all")
        if not bad.any():
            return batch
        k = batch.schema.get_field_index(text_col)
        cut = {row: without(batch.column(k)[row].as_py(), hits["hit_bytes"][row]) for row in np.flatnonzero(bad).tolist()}
        texts = [cut.get(row, text) for row, text in enumerate(batch.column(k).to_pylist())]
        return batch.set_column(k, batch.schema.field(k), pa.array(texts, batch.schema.field(k).type))

    return passes(docs, benchmark, text_col, window, free_name(docs, "hits"), finish, docs.schema, **named)
