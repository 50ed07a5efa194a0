"""Dictionaries of any size: Aho-Corasick automata as double arrays, built and run by Spark tasks.

A dictionary is a table of terms. It is cut into parts of bounded size; a task builds the automaton of each part, level by level in
arrays, and the parts are broadcast, a bounded number for each pass over the texts. A text is read once for each part, in many lanes
that advance together, so the time grows with its length and not with the terms. Letters are folded one by one as patterns that ignore
case fold them, runs of blanks count as one, and no term crosses a line break. Of the hits that begin at a place the first in the
dictionary's order counts, the longest first, and of overlapping ones the leftmost: what the pattern of `dictionary.pattern` finds.
"""

from __future__ import annotations

import functools
import pickle
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactica.sources.scratch import stored

#: Code points of the terms of one part, which is also the most states it has; an automaton takes some 25 bytes for each.
PART_CHARS = 2_000_000
#: Parts that are broadcast for one pass over the texts.
PARTS_AT_ONCE = 4
#: Code points that are scanned together, and how far apart lanes begin at least.
BLOCK, LANE = 2_000_000, 256
_ROUNDS = 64


@functools.cache
def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each code point: the one that it is folded to, whether it belongs to words, and whether it is a blank within a line."""
    fold = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    word, blank = np.zeros(len(fold), bool), np.zeros(len(fold), bool)
    for c in range(len(fold)):
        x = chr(c)
        if x.isalnum() or x == "_":
            word[c] = True
            up = x.upper()
            low = (up if len(up) == 1 else x).lower()
            fold[c] = ord(low) if len(low) == 1 else ord(low[0]) if x == "İ" else c
        elif x.isspace():
            blank[c] = x not in "\r\n"
    return fold, word, blank


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Automaton:
    """The terms of one part; states are places in the double array, the first of which is the root."""

    def __init__(self, terms: list[tuple[str, str, int]]):
        """Of rows (term, label, place in the dictionary)."""
        fold, word, _ = _classes()
        named = sorted(((" ".join(t.split()), t, label, at) for t, label, at in terms if t.strip()), key=lambda r: (-len(r[0].casefold()), -len(r[1]), r[3]))
        whole = ["".join(map(chr, fold[_codes(n)].tolist())) for n, *_ in named]
        best: dict[str, int] = {}
        for k, x in enumerate(whole):
            best.setdefault(x, k)  # of terms that fold alike the first takes all hits
        texts = sorted(best)
        own = [named[best[x]] for x in texts]
        self.sizes = np.array([len(x) for x in texts], np.int32)
        self.longest = int(self.sizes.max(initial=0))
        self.keys = np.array([len(n.casefold()) for n, *_ in own], np.int32)
        self.raw = np.array([len(t) for _, t, *_ in own], np.int32)
        self.places = np.array([at for *_, at in own], np.int64)
        labels = {label: k for k, label in enumerate(dict.fromkeys(r[2] for r in own))}
        self.labels, self.label = list(labels), np.array([labels[r[2]] for r in own], np.int32)
        ends = np.array([(word[ord(n[0])], word[ord(n[-1])]) for n, *_ in own], bool).reshape(-1, 2)
        self.word_first, self.word_last = ends[:, 0].copy(), ends[:, 1].copy()
        flat = _codes("".join(texts))
        self.alphabet = np.unique(flat)
        self._build(np.searchsorted(self.alphabet, flat).astype(np.int32) + 1)

    def _build(self, flat: np.ndarray) -> None:
        starts = np.cumsum(self.sizes) - self.sizes
        n_symbols = len(self.alphabet) + 1
        node_of, symbols, parents, levels = np.zeros(len(self.sizes), np.int64), [np.zeros(1, np.int32)], [np.zeros(1, np.int64)], [0, 1]
        active = np.arange(len(self.sizes))
        out_node = np.zeros(len(self.sizes), np.int64)
        for depth in range(1, self.longest + 1):
            active = active[self.sizes[active] >= depth]
            c, up = flat[starts[active] + depth - 1], node_of[active]
            new = np.ones(len(active), bool)
            new[1:] = (c[1:] != c[:-1]) | (up[1:] != up[:-1])
            node_of[active] = levels[-1] + np.cumsum(new) - 1
            symbols.append(c[new])
            parents.append(up[new])
            levels.append(levels[-1] + int(new.sum()))
            ending = active[self.sizes[active] == depth]
            out_node[ending] = node_of[ending]
        symbol, parent, n = np.concatenate(symbols), np.concatenate(parents), levels[-1]
        slot, base = _placed(symbol, parent, n, n_symbols)
        size = int(slot.max()) + n_symbols + 1
        self.base, self.check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        self.base[slot] = base
        self.check[slot[1:]] = slot[parent[1:]]
        self.fail, self.out, self.link = (np.zeros(size, np.int32) for _ in range(3))
        self.out[slot[out_node]] = np.arange(1, len(out_node) + 1)
        for lo, hi in zip(levels[2:], levels[3:], strict=False):
            s, c, at = slot[lo:hi], symbol[lo:hi], self.fail[slot[parent[lo:hi]]]
            to = self.step(at, c)
            self.fail[s] = to
            self.link[s] = np.where(self.out[to] > 0, to, self.link[to])

    def step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The states that states and symbols lead to, by the failure links where need be."""
        to = self.base[state] + c
        good = self.check[to] == state
        if good.all():
            return to
        out = np.where(good, to, 0).astype(np.int32)
        left = np.flatnonzero(~good & (state > 0) & (c > 0))
        at = self.fail[state[left]]
        while left.size:
            sym = c[left]
            to = self.base[at] + sym
            good = self.check[to] == at
            out[left[good]] = to[good]
            going = ~good & (at > 0)
            left, at = left[going], self.fail[at[going]]
        return out

    def hits(self, folded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place after the last code point, term) of all occurrences in folded code points."""
        if not len(self.sizes) or not len(folded):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.alphabet, folded), len(self.alphabet) - 1)
        symbols = np.where(self.alphabet[at] == folded, at + 1, 0).astype(np.int32)
        warm = self.longest - 1
        lane = max(LANE, 4 * warm, len(folded) // 4096)
        begin = np.arange(0, len(folded), lane)
        state, ends, terms = np.zeros(len(begin), np.int32), [], []
        for i in range(-warm, lane):
            p = begin + i
            if i < 0:
                c = np.where(p >= 0, symbols[np.maximum(p, 0)], 0)
            else:
                if p[-1] >= len(folded):
                    begin, state, p = begin[:-1], state[:-1], p[:-1]
                    if not len(p):
                        break
                c = symbols[p]
            state = self.step(state, c)
            if i >= 0:
                here = np.flatnonzero((self.out[state] > 0) | (self.link[state] > 0))
                s, q = state[here], p[here]
                while s.size:
                    ending = self.out[s] > 0
                    ends.append(q[ending] + 1)
                    terms.append(self.out[s[ending]] - 1)
                    s = self.link[s]
                    s, q = s[s > 0], q[s > 0]
        return (np.concatenate(ends), np.concatenate(terms).astype(np.int64)) if ends else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _placed(symbol: np.ndarray, parent: np.ndarray, n: int, n_symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """(slot of each node, base of each node) such that no two children share a slot. Nodes with several children try places at random,
    those with the most first; the others take what is free."""
    count = np.bincount(parent[1:], minlength=n)
    first = np.cumsum(count) - count + 1  # nodes are in the order of their parents
    size = int(1.6 * n) + 4 * n_symbols
    taken = np.zeros(size + n_symbols, bool)
    taken[0] = True
    slot, base = np.zeros(n, np.int64), np.zeros(n, np.int64)
    rng = np.random.default_rng(1)
    for least in (64, 16, 8, 4, 2):
        left = np.flatnonzero((count >= least) & (base == 0))
        for k in range(10_000):
            if not left.size:
                break
            if k % _ROUNDS == _ROUNDS - 1:
                size = int(1.5 * size)
                taken = np.append(taken, np.zeros(size + n_symbols - len(taken), bool))
            m = count[left]
            heads = np.cumsum(m) - m
            child = np.arange(int(m.sum())) - np.repeat(heads - first[left], m)
            tried = rng.integers(1, size, len(left))
            want = np.repeat(tried, m) + symbol[child]
            claimed = np.full(len(taken), len(left), np.int64)
            np.minimum.at(claimed, want, np.repeat(np.arange(len(left)), m))
            won = np.logical_and.reduceat(~taken[want] & (claimed[want] == np.repeat(np.arange(len(left)), m)), heads)
            mine = np.repeat(won, m)
            slot[child[mine]] = want[mine]
            taken[want[mine]] = True
            base[left[won]] = tried[won]
            left = left[~won]
    alone = np.flatnonzero(count == 1)
    free = np.flatnonzero(~taken[n_symbols + 1 :])[: len(alone)] + n_symbols + 1
    if len(free) < len(alone):
        free = np.append(free, np.arange(len(taken), len(taken) + len(alone) - len(free)))
    slot[first[alone]] = free
    base[alone] = free - symbol[first[alone]]
    return slot, base


class Scan:
    """Texts, joined and folded, and the hits in them."""

    def __init__(self, texts: list[str]):
        fold, self.word, blank = _classes()
        self.starts = np.cumsum([1, *(len(t) + 1 for t in texts)])
        self.codes = _codes("\n" + "".join(t + "\n" for t in texts))
        within = blank[self.codes]
        kept = np.ones(len(self.codes), bool)
        kept[1:] = ~(within[1:] & within[:-1])
        self.at = np.flatnonzero(kept)
        self.folded = np.where(within[self.at], 32, fold[self.codes[self.at]])

    def hits(self, a: Automaton) -> tuple[np.ndarray, ...]:
        """(text, start, end, length of the key, of the term, place, label) of all hits that begin and end where their term may."""
        end, term = a.hits(self.folded)
        start, end = self.at[end - a.sizes[term]], self.at[end - 1] + 1
        good = ~(a.word_first[term] & self.word[self.codes[start - 1]]) & ~(a.word_last[term] & self.word[self.codes[end]])
        start, end, term = start[good], end[good], term[good]
        text = np.searchsorted(self.starts, start, "right") - 1
        return text, start - self.starts[text], end - self.starts[text], a.keys[term], a.raw[term], a.places[term], a.label[term]


def claimed(hits: list[tuple[int, ...]]) -> list[tuple[int, int, int]]:
    """(start, end, label) of hits (start, end, length of the key, of the term, place, label) that count."""
    out, last = [], 0
    for start, end, *_, label in sorted(hits, key=lambda h: (h[0], -h[2], -h[3], h[4])):
        if start >= last:
            out.append((start, end, label))
            last = end
    return out


def parts(terms: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """Rows (part, automaton) of terms (term, label, place); each task builds its part."""
    place = F.col("place").cast("long") if "place" in terms.columns else F.monotonically_increasing_id()
    rows = terms.filter("trim(term) <> ''").select("term", "label", place.alias("place"))
    total = rows.agg(F.coalesce(F.sum(F.length("term")), F.lit(0))).first()[0]
    n = max(1, -(-total // part_chars))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Automaton(held), 5)], pa.binary())], ["automaton"])

    return rows.repartition(n, F.xxhash64("term")).mapInArrow(each, "automaton binary")


def _passes(terms: DataFrame, part_chars: int) -> Iterator[list]:
    """Broadcast automata, so many at a time; the driver holds one part."""
    sc = terms.sparkSession.sparkContext
    held = []
    built = parts(terms, part_chars).persist(StorageLevel.DISK_ONLY)
    built.count()  # all parts at once; the iterator would have them built one after the other
    for r in built.toLocalIterator():
        held.append(sc.broadcast(pickle.loads(bytes(r.automaton))))
        if len(held) == PARTS_AT_ONCE:
            yield held
            held = []
    built.unpersist()
    if held:
        yield held


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    start, held, size = 0, [], 0
    for k, t in enumerate(texts):
        if held and size + len(t or "") > BLOCK:
            yield start, held
            start, held, size = k, [], 0
        held.append(t or "")
        size += len(t or "")
    if held:
        yield start, held


#: Bits of a place within a text; above them is the text's row, so places of a batch ascend over its texts.
_WITHIN = 32
#: What is known of a hit: where it begins and ends, the lengths of its key and its term, the term's place, and its label.
_FIELDS = (("at", np.int64), ("to", np.int64), ("key", np.int32), ("raw", np.int32), ("place", np.int64), ("label", np.int32))


def _firsts(h: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Of the hits that begin at a place the first in the dictionary's order, in the order of places."""
    order = np.lexsort((h["place"], -h["raw"], -h["key"], h["at"]))
    at = h["at"][order]
    own = np.ones(len(at), bool)
    own[1:] = at[1:] != at[:-1]
    return {name: h[name][order[own]] for name, _ in _FIELDS}


def _counting(h: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Of hits that begin at different places, in order, the leftmost ones that do not overlap."""
    after = np.searchsorted(h["at"], h["to"])
    if (after == np.arange(1, len(after) + 1)).all():
        return h
    chosen, next_, k = [], after.tolist(), 0
    while k < len(next_):
        chosen.append(k)
        k = next_[k]
    return {name: h[name][chosen] for name, _ in _FIELDS}


def _joined(some: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {name: np.concatenate([np.zeros(0, kind), *(h[name] for h in some)]) for name, kind in _FIELDS}


def _found(texts: list[str | None], shared: list) -> tuple[dict[str, np.ndarray], list[str]]:
    """(the first hits of each place of the texts, names of their labels)."""
    names, some = {}, []
    for first, block in _blocks(texts):
        scan, here = Scan(block), []
        for s in shared:
            a = s.value
            text, start, end, key, raw, place, label = scan.hits(a)
            row = (first + text).astype(np.int64) << _WITHIN
            own = np.array([names.setdefault(x, len(names)) for x in a.labels], np.int32)
            here.append(dict(zip((name for name, _ in _FIELDS), (row + start, row + end, key, raw, place, own[label] if len(label) else label), strict=True)))
        some.append(_firsts(_joined(here)))
    return _joined(some), list(names)


def _rows(h: dict[str, np.ndarray], ids: pa.Array, names: list[str]) -> pa.RecordBatch:
    row, within = h["at"] >> _WITHIN, (1 << _WITHIN) - 1
    columns = [ids.take(pa.array(row)), pa.array((h["at"] & within).astype(np.int32)), pa.array((h["to"] & within).astype(np.int32)), pa.array(names, pa.string()).take(pa.array(h["label"]))]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "s", "e", "label"])


#: A hit as it is shuffled.
_HIT = np.dtype([("at", np.int32), ("to", np.int32), ("key", np.int32), ("raw", np.int32), ("place", np.int64), ("label", np.int32)])


def _packed(docs: DataFrame, shared: list) -> DataFrame:
    """Rows (doc_id, names, of): the first hits of each place of a document's text for some of the parts, and the names of their labels."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, names = _found(b.column(1).to_pylist(), shared)
            row = h["at"] >> _WITHIN
            rows, begin = np.unique(row, return_index=True)
            own, label = np.unique(row << _WITHIN | h["label"], return_inverse=True)
            first = np.searchsorted(own, rows << _WITHIN)
            cut = np.zeros(len(row), _HIT)
            for name, _ in _FIELDS:
                cut[name] = h[name] & ((1 << _WITHIN) - 1) if name in ("at", "to") else h[name]
            cut["label"] = label - np.repeat(first, np.diff([*begin, len(row)]))
            called = pa.array(names, pa.string()).take(pa.array(own & ((1 << _WITHIN) - 1)))
            data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(np.append(begin, len(row)).astype(np.int64) * _HIT.itemsize), pa.py_buffer(cut.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.ListArray.from_arrays(pa.array(np.append(first, len(own)), pa.int32()), called), data.cast(pa.binary())], ["doc_id", "names", "of"])

    return docs.select("doc_id", "text").mapInArrow(each, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, names array<string>, of binary")


def _gathered(docs: DataFrame, passes: list[list]) -> DataFrame:
    """Rows (doc_id, of): what each pass found in a document with any hit."""
    found = functools.reduce(DataFrame.unionByName, (_packed(docs, p) for p in passes))
    return found.groupBy("doc_id").agg(F.collect_list(F.struct("names", "of")).alias("of"))


def _merged(of: pa.Array) -> tuple[dict[str, np.ndarray], list[str]]:
    """(the hits of a batch of documents that count, names of their labels), of what the passes found."""
    each = of.flatten()
    row = np.repeat(np.arange(len(of)), pc.fill_null(pc.list_value_length(of), 0).to_numpy(zero_copy_only=False))
    data, called = each.field("of").to_pylist(), each.field("names")
    size = np.array([len(x) // _HIT.itemsize for x in data], np.int64)
    hits = np.frombuffer(b"".join(data), _HIT)
    names = called.flatten().dictionary_encode()
    many = pc.list_value_length(called).to_numpy(zero_copy_only=False).astype(np.int64)
    h = {name: hits[name].astype(kind) for name, kind in _FIELDS}
    above = np.repeat(row, size).astype(np.int64) << _WITHIN
    h["at"], h["to"] = above + h["at"], above + h["to"]
    h["label"] = names.indices.to_numpy(zero_copy_only=False)[np.repeat(np.cumsum(many) - many, size) + h["label"]] if len(hits) else h["label"]
    return _counting(_firsts(h)), names.dictionary.to_pylist()


def spans(docs: DataFrame, terms: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """Rows (doc_id, s, e, label) of documents (doc_id, text), doc_id being unique, for a dictionary (term, label, place) of any size."""
    passes = list(_passes(terms, part_chars))
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, s int, e int, label string"
    if len(passes) <= 1:
        shared = passes[0] if passes else []

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                h, names = _found(b.column(1).to_pylist(), shared)
                yield _rows(_counting(h), b.column(0), names)

        return docs.select("doc_id", "text").mapInArrow(each, kind)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, names = _merged(b.column(1))
            yield _rows(h, b.column(0), names)

    return _gathered(stored(docs.select("doc_id", "text"), "texts"), passes).mapInArrow(merge, kind)


def masked(docs: DataFrame, terms: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """Rows (doc_id, masked, counters) of documents (doc_id, text), doc_id being unique; a null text stays null.

    Where more than one pass reads the texts they are written first: a text may come out otherwise when it is made again."""
    passes = list(_passes(terms, part_chars))
    whole = len(passes) <= 1
    shared = passes[0] if passes else []
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, masked string, counters map<string,bigint>"

    def put(text: str | None, found: list[tuple[int, int, str]]) -> tuple[str | None, list]:
        out, at = [], 0
        for s, e, label in found:
            out += [text[at:s], f"[{label}]"]
            at = e
        return (text if text is None else "".join([*out, text[at:]])), list(Counter(x[2] for x in found).items())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            if whole:
                h, names = _found(texts, shared)
                h = _counting(h)
            else:
                h, names = _merged(b.column(2))
            within = (1 << _WITHIN) - 1
            cuts = np.searchsorted(h["at"] >> _WITHIN, np.arange(len(texts) + 1)).tolist()
            start, end, label = (h["at"] & within).tolist(), (h["to"] & within).tolist(), [names[x] for x in h["label"].tolist()]
            done = [put(t, list(zip(start[lo:hi], end[lo:hi], label[lo:hi], strict=True))) for t, lo, hi in zip(texts, cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.map_(pa.string(), pa.int64()))], ["doc_id", "masked", "counters"])

    rows = docs.select("doc_id", "text")
    if not whole:
        rows = stored(rows, "texts")
        rows = rows.join(_gathered(rows, passes), "doc_id", "left")
    return rows.mapInArrow(each, kind)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows (term, label, place) of a dictionary file of any size: lines `alias | alias = [LABEL]`, blank lines and # comments aside.

    Raises ValueError for a malformed line, and for an alias of two labels, naming the line and never its text."""
    text = F.trim(F.regexp_replace("value", "^﻿", ""))
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), text.alias("t")).filter("t <> '' and not startswith(t, '#')")
    left, right = F.regexp_extract("t", r"^([^=]*)=", 1), F.regexp_extract("t", r"^[^=]*=\s*\[\s*([^\[\]]*[^\[\]\s])\s*\]$", 1)
    aliases = F.transform(F.split(left, r"\|", -1), lambda a: F.trim(a))
    parsed = lines.select("line", right.alias("label"), aliases.alias("aliases"))
    bad = parsed.filter((F.col("label") == "") | F.exists("aliases", lambda a: a == "")).agg(F.min("line")).first()[0]
    number = lambda at: spark.read.text(path).select(F.monotonically_increasing_id().alias("line")).filter(F.col("line") <= at).count()
    if bad is not None:
        raise ValueError(f"malformed dictionary line {number(bad)}")
    rows = parsed.select("label", "line", F.posexplode("aliases").alias("k", "term"))
    key = F.lower(F.upper(F.regexp_replace("term", r"(?U)\s+", " ")))
    twice = rows.groupBy(key.alias("key")).agg(F.min("label").alias("a"), F.max("label").alias("b"), F.max("line").alias("line")).filter("a <> b").agg(F.min("line")).first()[0]
    if twice is not None:
        raise ValueError(f"dictionary line {number(twice)} gives an alias a second label")
    return rows.select("term", "label", (F.col("line") * 1024 + F.least("k", F.lit(1023))).alias("place"))
