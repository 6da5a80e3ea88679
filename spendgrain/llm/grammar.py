"""Token ids in grammar-compressed shards: Re-Pair per shard, with expansion lengths for random access.

Documents are dealt into ranges of doc_id and encoded in that order. A shard
holds the ids of consecutive documents, each followed by an end id. Frequent
pairs of neighbouring symbols are replaced by new symbols, round after round;
no pair includes an end id, so every document stays a range of symbols. A shard
stores its rules, how many ids each rule stands for, the symbols, and where
each document's begin. Symbols are 16 bits wide where all ids of the
vocabulary fit that, and 32 bits elsewhere.

A shard's bytes, little-endian:

    "GRS1" for symbols of 16 bits, "GRS2" for 32
    4 uint32: documents D, rules R, symbols S, first nonterminal
    D int64 doc_id; D uint8 whether it is null; D uint32 ids with the end id;
    D uint32 first symbol; R times 2 symbols, left and right side; R uint32 ids
    that the rule stands for; S symbols
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spendgrain.llm.common import pieces, stored, text_bytes, within

END = 0
SYMBOLS = 1 << 16  # of 16 bits; where ids need 32, so many rules at most
CELLS = 1 << 22  # of a table in which pairs are looked up; more sides of pairs are searched for
SHORT = 64  # ids of an expansion that is kept at hand while a shard is decoded
LONGEST_KNOWN = 64  # longer stretches, in bytes, are encoded anew each time
LINE_END = "\u010a"  # how byte-level files write a line end
WIDTHS = {b"GRS1": "<u2", b"GRS2": "<u4"}

# Code points that some libraries count as white space, but space, tab and line ends.
ODD_SPACE = (
    (0x0B, 0x0C),
    (0x1C, 0x1F),
    (0x85, 0x85),
    (0xA0, 0xA0),
    (0x1680, 0x1680),
    (0x180E, 0x180E),
    (0x2000, 0x200F),
    (0x2028, 0x202F),
    (0x205F, 0x2060),
    (0x3000, 0x3000),
    (0xFEFF, 0xFEFF),
)


def odd_numbers() -> list[str]:
    """Characters that count as numbers but are no decimal digits."""
    return [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) in ("No", "Nl")]


ODD_NUMBERS = odd_numbers()


def parts_at_words(spec: dict) -> bool:
    """Whether a tokenizer's file is byte-level BPE over unchanged text, cut by the library's own rule for words."""
    steps, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    return (
        spec.get("normalizer") is None
        and (steps.get("type"), steps.get("add_prefix_space"), steps.get("use_regex")) == ("ByteLevel", False, True)
        and model.get("type") == "BPE"
        and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
        and spec.get("truncation") is None
        and spec.get("padding") is None
    )


class Encoder:
    """Ids of texts by a file of the tokenizers library.

    Texts go to the library whole unless the file is byte-level BPE without
    other rules. There no merge reaches from a word into white space, punctuation or digits after
    it, so each distinct stretch between such places is encoded once and
    remembered, as long as there is room; the most common ones come early. Texts
    with characters that libraries class differently, or with the string of a
    special token, are encoded whole.

    Stretches are found, told apart and replaced by their ids in columns, for all
    texts of a call together. New ones go to the library as lines of many, where
    a line end is a token of its own.
    """

    # Kinds of bytes: 0 beyond ASCII, 1 letters, 2 others, 3 white space. A stretch ends before white space that follows something
    # else, and between a letter and another ASCII character.
    _KIND = np.zeros(256, np.uint8)
    _KIND[:128] = 2
    _KIND[[*range(65, 91), *range(97, 123)]] = 1
    _KIND[[9, 10, 13, 32]] = 3
    _APART = np.zeros(16, bool)
    _APART[[0 << 2 | 3, 1 << 2 | 3, 2 << 2 | 3, 1 << 2 | 2]] = True
    # Classes of characters up to U+FFFF are looked up in a table; with others among them each character is compared with every range.
    _ODD = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ODD_SPACE) + "".join(re.escape(c) for c in ODD_NUMBERS if c < "\U00010000") + "]")
    _HIGH = re.compile("[\U00010000-\U0010ffff]")
    _HIGH_ODD = frozenset(c for c in ODD_NUMBERS if c >= "\U00010000")
    _MAYBE_ODD = np.isin(np.arange(256), [c.encode()[0] for c in (*ODD_NUMBERS, *(chr(c) for a, b in ODD_SPACE for c in range(a, b + 1)))])  # first bytes of odd characters
    _LINE = re.compile(rb" ?[^ \t\n\r]+")  # what can stand between line ends

    def __init__(self, path: str, remembered: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        self.model = Tokenizer.from_file(path)
        special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.special_bytes = [x.encode() for x in special]
        self.known: dict[bytes, int] = {}  # the number of each remembered stretch, in the order of their ids
        self.ids, self.counts = np.empty(0, np.int32), np.empty(0, np.int64)
        self.remembered = remembered
        self.size = 1 + max(self.model.get_vocab(with_added_tokens=True).values(), default=END)
        spec = json.loads(self.model.to_str())
        self.by_word = parts_at_words(spec)
        apart = self.by_word and spec["model"].get("unk_token") != LINE_END and not any("\n" in x for x in special)
        self.line_end = self.model.token_to_id(LINE_END) if apart else None

    def _odd(self, text: str) -> bool:
        return bool(self._ODD.search(text)) or any(c in self._HIGH_ODD for c in self._HIGH.findall(text))

    def _whole(self, column: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The numbers of texts that are not cut."""
        raw = data.tobytes()
        if not self.by_word or any(x in raw for x in self.special_bytes):
            some = np.arange(len(column))
        else:
            some = np.flatnonzero(np.diff(np.searchsorted(np.flatnonzero(self._MAYBE_ODD[data]), offsets)))
        if not self.by_word or not len(some):
            return some
        texts = (t or "" for t in column.take(pa.array(some)).to_pylist())
        return some[[self._odd(t) or bool(self.special and self.special.search(t)) for t in texts]]

    def _cuts(self, data: np.ndarray, offsets: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Where stretches begin inside texts."""
        kinds = self._KIND[data]
        kinds[1:][(data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)] = 1  # U+00C0 to U+00FF are letters but for two
        cut = self._APART[kinds[:-1] << 2 | kinds[1:]]
        cut[offsets[(offsets > 0) & (offsets < len(data))] - 1] = False
        for k in whole:
            cut[offsets[k] : offsets[k + 1]] = False
        return np.flatnonzero(cut) + 1

    def _library(self, new: list[bytes], alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stretches, and how many each has; those not marked ``alone`` are not odd and may share a text of the library."""
        fits = np.array([self.line_end is not None and not a and bool(self._LINE.fullmatch(x)) for x, a in zip(new, alone, strict=True)], bool)
        lines, rest = [new[i].decode() for i in np.flatnonzero(fits)], [new[i].decode() for i in np.flatnonzero(~fits)]
        some = ["\n".join(lines[i : i + 128]) + "\n" for i in range(0, len(lines), 128)]
        found = [np.array(e.ids, np.int32) for i in range(0, len(some), 64) for e in self.model.encode_batch_fast(some[i : i + 64], add_special_tokens=False)]
        joined = np.concatenate([np.empty(0, np.int32), *found])
        ends = np.flatnonzero(joined == self.line_end) if lines else np.empty(0, np.int64)
        if len(ends) != len(lines):
            raise ValueError("the library's ids do not part at line ends")
        single = [np.array(e.ids, np.int32) for e in self.model.encode_batch_fast(rest, add_special_tokens=False)]
        ids = np.concatenate([np.delete(joined, ends), *single])
        counts = np.empty(len(new), np.int64)
        counts[fits], counts[~fits] = np.diff(ends, prepend=-1) - 1, [len(x) for x in single]
        begins = np.empty(len(new), np.int64)
        order = np.concatenate([np.flatnonzero(fits), np.flatnonzero(~fits)])
        begins[order] = np.cumsum(counts[order]) - counts[order]
        return ids[_ranges(begins, counts)], counts

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where those of each text end; null is empty."""
        data, offsets = text_bytes(column)
        if not len(column):
            return np.empty(0, np.int32), np.empty(0, np.int64)
        whole = self._whole(column, data, offsets)
        cuts = self._cuts(data, offsets, whole) if self.by_word and len(data) else np.empty(0, np.int64)
        first = np.arange(len(offsets)) + np.searchsorted(cuts, offsets)  # the first stretch of each text; each has at least one
        starts = np.append(np.sort(np.concatenate([offsets[:-1], cuts]), kind="stable"), offsets[-1])
        every = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(data)]).dictionary_encode()
        codes, distinct = every.indices.to_numpy(), every.dictionary.to_numpy(zero_copy_only=False).tolist()
        alone = np.zeros(len(distinct), bool)
        alone[codes[first[whole]]] = True

        number = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        open_ = np.flatnonzero(number < 0)
        number[open_] = len(self.known) + np.arange(len(open_))
        new = [distinct[i] for i in open_]
        new_ids, new_counts = self._library(new, alone[open_])
        ids, counts = np.concatenate([self.ids, new_ids]), np.concatenate([self.counts, new_counts])
        if len(self.known) < self.remembered:
            short = np.array([len(x) <= LONGEST_KNOWN for x in new], bool)
            self.ids, self.counts = np.concatenate([self.ids, new_ids[np.repeat(short, new_counts)]]), np.concatenate([self.counts, new_counts[short]])
            self.known.update(zip((new[i] for i in np.flatnonzero(short)), count(len(self.known))))

        begins = np.cumsum(counts) - counts
        held = counts[number][codes]
        return ids[_ranges(begins[number][codes], held)], np.cumsum(held)[first[1:] - 1]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_column(pa.array([text], pa.string()))[0]


def _ranges(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each of ``begins`` on, as many as counted, end to end."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - ends + counts, counts)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per file and process; tasks of a worker share what it remembers."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _sides(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Left and right symbols of pairs, which are two symbols in one number."""
    bits = pairs.dtype.type(4 * pairs.dtype.itemsize)
    return pairs >> bits, pairs & ((pairs.dtype.type(1) << bits) - pairs.dtype.type(1))


def _found(seq: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of chosen pairs, which are in ascending order, and which pair is at each."""
    left, right = _sides(chosen)
    lefts, rights = (np.unique(x, return_inverse=True) for x in (left, right))
    at = seq.astype(np.intp)
    # Every left and right side has a number, 0 is for other symbols.
    row, column = np.zeros((2, int(at.max()) + 1), np.int32)
    row[lefts[0]], column[rights[0]] = np.arange(1, len(lefts[0]) + 1), np.arange(1, len(rights[0]) + 1)
    width = len(rights[0]) + 1
    if (len(lefts[0]) + 1) * width <= CELLS:
        table = np.full((len(lefts[0]) + 1) * width, -1, np.int32)
        table[(lefts[1] + 1) * width + rights[1] + 1] = np.arange(len(chosen))
        row *= np.int32(width)
        rule = table[row[at[:-1]] + column[at[1:]]]
        places = np.flatnonzero(rule >= 0)
        return places, rule[places]
    places = np.flatnonzero((row[at[:-1]] > 0) & (column[at[1:]] > 0))
    keys = seq[places] << seq.dtype.type(4 * seq.itemsize) | seq[places + 1]
    rule = np.minimum(np.searchsorted(chosen, keys), len(chosen) - 1)
    hit = chosen[rule] == keys
    return places[hit], rule[hit]


def _places(seq: np.ndarray, chosen: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The chosen pairs, places without overlaps, which pair is at each, and which pairs have ``least`` of them; only those have places."""
    at, rule = _found(seq, chosen) if len(chosen) else np.empty((2, 0), np.int64)
    if not len(at):
        return chosen, at[:0], at[:0], np.zeros(len(chosen), bool)
    number = np.arange(len(at), dtype=np.int32)
    offset = number - np.maximum.accumulate(np.where(np.diff(at, prepend=-2) != 1, number, 0))
    own = offset & 1 == 0
    at, rule = at[own], rule[own]
    used = np.bincount(rule, minlength=len(chosen)) >= least
    if not used.all():
        own = used[rule]
        at, rule = at[own], rule[own]
    return chosen, at, rule, used


def _apart(pairs: np.ndarray) -> np.ndarray:
    """Pairs that cannot overlap: no symbol is the left side of one and the right side of another."""
    lefts, rights, out = set(), set(), []
    for pair, a, b in zip(pairs, *(x.tolist() for x in _sides(pairs)), strict=True):
        if a != b and a not in rights and b not in lefts:
            lefts.add(a)
            rights.add(b)
            out.append(pair)
    return np.array(out, pairs.dtype)


def _doubled(pairs: np.ndarray) -> np.ndarray:
    """Pairs of a symbol with itself."""
    left, right = _sides(pairs)
    return pairs[left == right]


def re_pair(ids: np.ndarray, first: int, rounds: int = 4, least: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and rules (left, right) of ids below ``first``, of 16 bits if that is enough for all ids.

    A round counts all neighbouring pairs and replaces the most frequent ones
    from the left. The free symbols are spread over the first ``rounds`` rounds;
    more follow until no pair has ``least`` places or no symbol is free. Rules
    that overlaps leave with fewer than ``least`` places are not made; where
    that leaves none, pairs that cannot overlap are taken.
    """
    if len(ids) and not 0 <= ids.min() <= ids.max() < first <= 1 << 31:
        raise ValueError(f"ids must lie between 0 and {first}")
    symbol, pair, most = (np.uint16, np.uint32, SYMBOLS) if first <= SYMBOLS else (np.uint32, np.uint64, first + SYMBOLS)
    bits = pair(8 * symbol().itemsize)
    seq = ids.astype(pair)
    rules = np.empty((0, 2), symbol)
    for k in count():
        room = -(-(most - first - len(rules)) // max(1, rounds - k))
        if len(seq) < 2 or room <= 0:
            break
        keys = seq[:-1] << bits | seq[1:]
        open_ = (seq[:-1] != END) & (seq[1:] != END)
        ordered = np.sort(keys[open_])
        if not len(ordered):
            break
        edges = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        counts = np.diff(np.append(edges, len(ordered)))
        frequent = np.flatnonzero(counts >= least)
        frequent = frequent[np.argsort(-counts[frequent], kind="stable")]
        every = ordered[edges[frequent]]
        for choose in (lambda p: p, _apart, _doubled):
            chosen, at, rule, used = _places(seq, np.sort(choose(every)[:room]), least)
            if len(at):
                break
        else:
            break
        number = np.cumsum(used) - 1 + first + len(rules)
        seq[at] = number[rule]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq[keep]
        rules = np.concatenate([rules, np.stack(_sides(chosen[used]), 1).astype(symbol)])
    return seq.astype(symbol), rules


def lengths_of(rules: np.ndarray, first: int) -> np.ndarray:
    """How many ids each symbol stands for; rules refer to earlier ones only."""
    lengths = [1] * first
    for a, b in rules.tolist():
        lengths.append(lengths[a] + lengths[b])
    return np.array(lengths, np.int64)


def unfolded(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, longest: int = 1) -> np.ndarray:
    """The symbols, those that stand for more than ``longest`` ids replaced by their sides until none is left."""
    first = len(lengths) - len(rules)
    while len(symbols):
        long = lengths[symbols] > longest
        if not long.any():
            break
        sides = rules[symbols[long].astype(np.int64) - first]
        after = np.cumsum(1 + long)
        out = np.empty(after[-1], symbols.dtype)
        out[after[~long] - 1] = symbols[~long]
        out[after[long] - 2], out[after[long] - 1] = sides[:, 0], sides[:, 1]
        symbols = out
    return symbols


@dataclass(frozen=True)
class Shard:
    """The documents of one shard, decoded on demand."""

    doc_ids: list[int | None]
    counts: np.ndarray
    starts: np.ndarray
    rules: np.ndarray
    lengths: np.ndarray
    symbols: np.ndarray
    first: int

    @staticmethod
    def from_bytes(data: bytes) -> Shard:
        if data[:4] not in WIDTHS:
            raise ValueError("not a grammar shard")
        width = WIDTHS[data[:4]]
        d, r, s, first = struct.unpack_from("<4I", data, 4)
        at = 20

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        ids, null = take("<i8", d), take("u1", d)
        names = [None if x else int(i) for i, x in zip(ids, null, strict=True)]
        counts, starts = take("<u4", d), take("<u4", d)
        rules, lengths = take(width, 2 * r).reshape(-1, 2), take("<u4", r)
        lengths = np.concatenate([np.ones(first, np.int64), lengths])
        return Shard(names, counts, starts, rules, lengths, take(width, s), first)

    def ids(self) -> np.ndarray:
        """Ids of all documents.

        Memory is that of the answer and of the rules that stand for at most
        SHORT ids, whose expansions are copied; longer ones are taken apart.
        """
        if not (lengths_of(self.rules, self.first) == self.lengths).all():
            raise ValueError("rules and expansion lengths differ")
        few = np.flatnonzero(self.lengths <= SHORT)
        every = unfolded(few.astype(self.symbols.dtype), self.rules, self.lengths)
        begins = np.zeros(len(self.lengths), np.int64)
        begins[few] = np.cumsum(self.lengths[few]) - self.lengths[few]
        symbols = unfolded(self.symbols, self.rules, self.lengths, SHORT)
        n = self.lengths[symbols]
        ends = np.cumsum(n)
        if not len(ends):
            return np.empty(0, np.int32)
        return every[_ranges(begins[symbols], n)].astype(np.int32)

    def document(self, k: int, low: int = 0, high: int | None = None) -> np.ndarray:
        """Ids low to high of the k-th document: only symbols that reach into the range are taken apart, level by level."""
        stop = self.starts[k + 1] if k + 1 < len(self.starts) else len(self.symbols)
        own = self.symbols[self.starts[k] : stop]
        high = int(self.counts[k]) if high is None else min(high, int(self.counts[k]))
        if low >= high:
            return np.empty(0, np.int32)
        while True:
            ends = np.cumsum(self.lengths[own])
            a, b = np.searchsorted(ends, low, side="right"), np.searchsorted(ends, high, side="left") + 1
            skipped = int(ends[a - 1]) if a else 0
            own, low, high = own[a:b], low - skipped, high - skipped
            longest = int(self.lengths[own].max())
            if longest == 1:
                return own.astype(np.int32)
            own = unfolded(own, self.rules, self.lengths, longest // 2)


def shard_bytes(doc_ids: list[int | None], counts: list[int], ids: np.ndarray, first: int, **options) -> bytes:
    """A shard of documents whose ids, each with its end id, lie end to end."""
    symbols, rules = re_pair(ids, first, **options)
    lengths = lengths_of(rules, first)
    ends = np.cumsum(lengths[symbols])
    begins = np.cumsum(counts) - counts
    starts = np.searchsorted(ends, begins, side="right")
    magic, width = next((m, w) for m, w in WIDTHS.items() if np.dtype(w).itemsize == symbols.itemsize)
    head = struct.pack("<4s4I", magic, len(doc_ids), len(rules), len(symbols), first)
    numbers = np.array([0 if i is None else i for i in doc_ids], "<i8")
    parts = [numbers, np.array([i is None for i in doc_ids], "u1"), np.array(counts, "<u4"), starts.astype("<u4"), rules.astype(width), lengths[first:].astype("<u4"), symbols.astype(width)]
    return head + b"".join(p.tobytes() for p in parts)


SHARDS = "part int, number int, n_tokens long, payload binary"


def encode_shards(docs: DataFrame, path: str, shard_tokens: int = 1 << 22, **options) -> DataFrame:
    """``part, number, n_tokens, payload`` of the shards of ``docs(doc_id, text)``, in ascending order of doc_id by part and number.

    path: the file of any tokenizer of the tokenizers library. A shard ends with the document that fills it,
    so memory is bounded by it or by the longest document. Null and empty texts
    are what the library gives for an empty text, and an end id. Null doc_ids
    come first; rows with one doc_id, or none, are ordered by a hash of the text,
    then text, and can lie in several parts. Other columns are not read. An empty table gives no
    shards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, number = encoder(path), TaskContext.get().partitionId(), 0
        names, counts, held, parts = [], [], 0, []
        end = np.array([END], np.int32)

        def shard() -> pa.RecordBatch:
            data = shard_bytes(names, counts, np.concatenate(parts), own.size, **options)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([held], pa.int64()), pa.array([data], pa.binary())], ["part", "number", "n_tokens", "payload"])

        for batch in batches:
            _, offsets = text_bytes(batch.column(1))
            for i, j in pieces(offsets, 1 << 22):
                some = batch.slice(i, j - i)
                ids, ends = own.encode_column(some.column(1))
                for name, a, b in zip(some.column(0).to_pylist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    names.append(name)
                    counts.append(b - a + 1)
                    parts += [ids[a:b], end]
                    held += b - a + 1
                    if held >= shard_tokens:
                        yield shard()
                        names, counts, held, parts, number = [], [], 0, [], number + 1
        if names:
            yield shard()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("hash"))
    return rows.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").mapInArrow(run, SHARDS)


def decode_shards(shards: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in shards that were read back.

    start: the number of ids of all documents before it, by the shards' order.
    Each document of a shard gives a row, so nulls and repeats in doc_id stay. A
    payload that is no shard, or null, raises. No shards give no rows. Other
    columns are not read.
    """
    heads = shards.select("part", "number", "n_tokens")
    parts = heads.groupBy("part").agg(F.sum("n_tokens").alias("held"))
    parts = parts.withColumn("outer", F.coalesce(F.sum("held").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    before = heads.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(parts.select("part", "outer"), "part")
    before = stored(before.select("part", "number", (F.col("outer") + F.col("inner")).alias("before")), "before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, at in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                shard = Shard.from_bytes(data.as_py())
                counts = shard.counts.astype(np.int64)
                starts = np.cumsum(counts) - counts
                ids = memoryview(shard.ids().astype("<u4")).cast("B")
                sums = [zlib.crc32(ids[4 * a : 4 * (a + n)]) for a, n in zip(starts.tolist(), counts.tolist(), strict=True)]
                columns = [pa.array(shard.doc_ids, pa.int64()), pa.array(starts + at), pa.array(counts), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = shards.join(within(before, 1_000_000), ["part", "number"]).select("payload", "before")
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
