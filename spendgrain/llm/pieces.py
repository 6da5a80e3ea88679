"""SentencePiece encoding that keeps the place of every piece in the original text.

The text is normalised here, by the longest matching prefix in the compiled
character map of the model. Each normalised byte remembers the source byte it
stands for. The normalised text is cut where no piece of the vocabulary can
reach across: before a word mark that follows anything else. Each distinct cut
is encoded once by the library and remembered in the task, with its decoded
text and the lengths of its pieces. Piece ends, added up over the normalised
text, are then projected to spans of original bytes.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

MARK = "▁"
LONGEST_KNOWN = 64  # longer cuts are encoded anew each time
BYTE, CONTROL, USER = 6, 3, 4  # fixed values: kinds of pieces in the model file


class CharacterMap:
    """The compiled map of a model: a double array of prefixes and the texts that replace them."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.texts = blob[4 + size :]
        self.first = {b for b in range(1, 256) if self.units and self._child(self._root(), b) is not None}
        self.skip = re.compile(b"[^" + b"".join(re.escape(bytes([b])) for b in sorted(self.first)) + b"]+") if self.first else None

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def _root(self) -> int:
        return self._offset(self.units[0])

    def _child(self, at: int, byte: int) -> int | None:
        """The unit reached by a byte, or None."""
        at ^= byte
        unit = self.units[at] if at < len(self.units) else 0
        return at if unit & (0x80000000 | 0xFF) == byte else None

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest entry that starts there."""
        if not self.units:
            return None
        place, found = self._root(), None
        for i in range(at, len(text)):
            node = self._child(place, text[i])
            if node is None:
                break
            unit = self.units[node]
            place = node ^ self._offset(unit)
            if unit >> 8 & 1:
                value = self.units[place] & 0x7FFFFFFF
                found = i + 1 - at, self.texts[value : self.texts.index(b"\0", value)]
        return found


class Encoder:
    """Ids, spans and decoded texts of one model."""

    def __init__(self, blob: bytes, remembered: int = 200_000):
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(blob)
        rules = proto.normalizer_spec
        self.map = CharacterMap(rules.precompiled_charsmap)
        self.prefix, self.trim, self.escape = rules.add_dummy_prefix, rules.remove_extra_whitespaces, rules.escape_whitespaces
        pieces = [p.piece for p in proto.pieces if p.type not in (CONTROL, BYTE)]
        if not self.escape or not self.prefix or self.trim or proto.trainer_spec.treat_whitespace_as_suffix or any(p.type == USER for p in proto.pieces):
            raise ValueError("the model must mark words by a prefix, keep white space, and have no user-defined pieces")
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("a piece reaches across words")
        self.lengths = np.array([1 if p.type == BYTE else len(p.piece.encode()) for p in proto.pieces], "<u2")
        rules.precompiled_charsmap = b""  # what the library gets is normalised already
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        if self.plain.is_unknown(self.plain.piece_to_id(MARK)):
            raise ValueError("the word mark is no piece")
        self.known: dict[str, tuple[str, str | None, bytes]] = {}
        self.remembered = remembered

    def normalised(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes and its end the byte of the source where that begins."""
        data = text.encode()
        if not data:
            return "", np.zeros(1, np.int64)
        if self.map.skip is None:
            source = np.arange(len(data), dtype=np.int64)
            mapped = data
        else:
            mapped, source = self._mapped(data)
        body = mapped.decode().replace(" ", MARK)
        wide = np.where(np.frombuffer(mapped, np.uint8) == 32, 3, 1)
        return MARK + body, np.concatenate([[0, 0, 0], np.repeat(source, wide), [len(data)]])

    def _mapped(self, data: bytes) -> tuple[bytes, np.ndarray]:
        out, source, at = [], [], 0
        while at < len(data):
            if plain := self.map.skip.match(data, at):
                out.append(plain[0])
                source.append(np.arange(at, plain.end()))
                at = plain.end()
                continue
            found = self.map.longest(data, at)
            if found is None:
                lead = data[at]
                n = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                new = data[at : at + n]
            else:
                n, new = found
            out.append(new)
            source.append(np.full(len(new), at))
            at += n
        return b"".join(out), np.concatenate(source) if source else np.empty(0, np.int64)

    _CUT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    def _learned(self, cuts: list[str]) -> dict[str, tuple[str, str | None, bytes]]:
        """Ids, decoded text unless it is the cut itself, and lengths of cuts, each of which starts with a mark."""
        texts = [c[1:].replace(MARK, " ") for c in cuts]
        ids = self.plain.encode(texts, num_threads=1)
        ids = [own or [self.plain.piece_to_id(MARK)] for own in ids]  # a mark alone is what nothing can be encoded to
        decoded = self.plain.decode(ids, num_threads=1)
        out = {}
        for cut, own, said in zip(cuts, ids, decoded, strict=True):
            said = " " + said
            out[cut] = ",".join(map(str, own)), None if said == cut.replace(MARK, " ") else said, self.lengths[own].tobytes()
        return out

    def encode(self, text: str | None) -> tuple[str, int, str, np.ndarray, np.ndarray]:
        """Ids joined by commas, their number, the decoded text, and begin and end of every piece in source bytes."""
        body, source = self.normalised(text or "")
        if not body:
            return "", 0, "", np.empty(0, np.int64), np.empty(0, np.int64)
        cuts = self._CUT.findall(body)
        rows = list(map(self.known.get, cuts))
        if None in rows:
            new = self._learned(sorted({c for c, r in zip(cuts, rows, strict=True) if r is None}))
            rows = [new[c] if r is None else r for c, r in zip(cuts, rows, strict=True)]
            if len(self.known) < self.remembered:
                self.known.update((c, r) for c, r in new.items() if len(c) <= LONGEST_KNOWN)
        ends = np.frombuffer(b"".join(map(itemgetter(2), rows)), "<u2").cumsum(dtype=np.int64)
        edges = source[np.concatenate([[0], ends])]
        decoded = body.replace(MARK, " ")
        if set(map(itemgetter(1), rows)) != {None}:
            decoded = "".join([c.replace(MARK, " ") if r[1] is None else r[1] for c, r in zip(cuts, rows, strict=True)])
        return ",".join(map(itemgetter(0), rows)), len(ends), decoded[1:], edges[:-1], edges[1:]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per model and process."""
    if path not in _ENCODERS:
        with open(path, "rb") as file:
            _ENCODERS[path] = Encoder(file.read())
    return _ENCODERS[path]


# The outputs on offer and their types.
OUTPUTS = {
    "n_tokens": "long",
    "ids": "array<int>",
    "begins": "array<int>",
    "ends": "array<int>",
    "decoded": "string",
    "ids_sha256": "string",
    "decoded_sha256": "string",
    "spans_sha256": "string",
}


def encode(docs: DataFrame, path: str, outputs: tuple[str, ...] = ("n_tokens", "ids", "begins", "ends", "decoded")) -> DataFrame:
    """``doc_id`` and the wanted outputs for each row of ``docs(doc_id, text)``; path: the model file.

    begins and ends are byte places in the UTF-8 text, end exclusive; pieces
    that stand for added marks are empty spans, and pieces that stand for a
    single byte cover it. Null and empty texts have no pieces. Each row is answered for itself,
    so nulls in doc_id and repeated rows change nothing. Other columns are not
    read. An empty table gives no rows.
    """
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            rows: dict[str, list] = {c: [] for c in outputs}
            for text in batch.column(1):
                ids, n, decoded, begins, ends = own.encode(text.as_py())
                for c, found in rows.items():
                    if c == "n_tokens":
                        found.append(n)
                    elif c == "ids":
                        found.append([int(x) for x in ids.split(",")] if ids else [])
                    elif c == "begins":
                        found.append(begins)
                    elif c == "ends":
                        found.append(ends)
                    elif c == "decoded":
                        found.append(decoded)
                    elif c == "ids_sha256":
                        found.append(hashlib.sha256(ids.encode()).hexdigest())
                    elif c == "decoded_sha256":
                        found.append(hashlib.sha256(decoded.encode()).hexdigest())
                    else:
                        found.append(hashlib.sha256(np.stack([begins, ends], 1).astype("<i4").tobytes()).hexdigest())
            columns = [pa.array(found, kinds[OUTPUTS[c]]) for c, found in rows.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *outputs])
        own.known.clear()  # the worker goes on to other tasks
        pa.default_memory_pool().release_unused()

    schema = ", ".join(["doc_id long", *(f"{c} {OUTPUTS[c]}" for c in outputs)])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
