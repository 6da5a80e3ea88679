"""Secrets in texts: keywords found by one automaton, anchored patterns near the hits, checksums where a format has one.

One pass of an Aho-Corasick automaton over the lower-cased text finds every
place where a pattern can begin; only there is the pattern tried. Runs of
hexadecimal digits have no keyword: every such run covers places that are a
fixed step apart, so only steps that hold digits at consecutive places are
looked at. Formats with a built-in checksum or structure are kept only if that
is right.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendgrain.llm.common import parts_of

# The base patterns and the least lengths of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
KINDS = ("assign", "access", "hex", "signed_token", "web_token", "private_key")

# Public formats. Tokens of these prefixes end in a CRC-32 of the body, in base 62.
SIGNED = re.compile(r"(ghp_|gho_|ghu_|ghs_|ghr_|npm_)([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
SIGNED_WORDS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
WEB_RUN = re.compile(r"[A-Za-z0-9_-]*")
WEB_REST = re.compile(r"\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
WEB_LEAST = 12  # characters of the shortest head, {"alg":0}
WEB_HEAD = 4096  # characters of a head at most; those who send such tokens hold all of one in a request header of 8 KB
PRIVATE = re.compile(r"-----BEGIN ([A-Z ]*)PRIVATE KEY-----([A-Za-z0-9+/=\s]+)-----END \1PRIVATE KEY-----")
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62(number: int, width: int) -> str:
    out = ""
    for _ in range(width):
        number, digit = divmod(number, 62)
        out = DIGITS[digit] + out
    return out


def _signed(text: str, at: int) -> int | None:
    m = SIGNED.match(text, at)
    return m.end() if m and base62(zlib.crc32(m[2].encode()), 6) == m[3] else None


class WebTokens:
    """Web tokens of one text, asked for from left to right.

    A head reaches to the end of its run of letters and digits, and what must
    follow is the same for all heads of a run. Both are found once per run, so
    the work grows with the text, however many places a token could begin at.
    """

    def __init__(self, text: str):
        self.text, self.stop, self.end = text, 0, None

    def match(self, at: int) -> int | None:
        if at >= self.stop:
            self.stop = WEB_RUN.match(self.text, at).end()
            rest = WEB_REST.match(self.text, self.stop)
            self.end = rest and rest.end()
        if not self.end or not WEB_LEAST <= self.stop - at <= WEB_HEAD or not self.text.startswith("eyJ", at):
            return None
        head = self.text[at : self.stop]
        try:
            fields = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
        except (ValueError, RecursionError):  # no base 64, no UTF-8, no JSON, or nested without end
            return None
        return self.end if isinstance(fields, dict) and "alg" in fields else None


def _private(text: str, at: int) -> int | None:
    m = PRIVATE.match(text, at)
    if not m:
        return None
    try:
        return m.end() if base64.b64decode("".join(m[2].split()), validate=True) else None
    except binascii.Error:
        return None


def _assign(text: str, at: int) -> tuple[int, bool] | None:
    m = ASSIGN.match(text, at)
    return (m.end(), len(m[2]) >= ASSIGN_LEAST) if m else None


def _access(text: str, at: int) -> tuple[int, bool] | None:
    m = ACCESS.match(text, at)
    return (m.end(), m.end() - at >= ACCESS_LEAST) if m else None


ANCHORED = {"assign": _assign, "access": _access}
CHECKED = {"signed_token": _signed, "private_key": _private}


def _automaton() -> ahocorasick.Automaton:
    words = {w: "assign" for w in ASSIGN_WORDS} | {"akia": "access"} | {w: "signed_token" for w in SIGNED_WORDS}
    words |= {"eyj": "web_token", "-----begin ": "private_key"}
    out = ahocorasick.Automaton()
    for word, kind in words.items():
        out.add_word(word, (kind, len(word)))
    out.make_automaton()
    return out


_WORDS = _automaton()
_LOWER = {c: c + 32 for c in range(65, 91)}
_IS_HEX = np.zeros(256, bool)
_IS_HEX[[*b"0123456789abcdef"]] = True
_STEP = HEX_LEAST // 4


def lowered(text: str) -> str:
    """A-Z lowered; other letters may be too, but every place stays the same."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_LOWER)


def hex_runs(text: str) -> Iterator[tuple[int, int]]:
    """Maximal runs of the least length. Such a run covers four places in a row that are a quarter of that length apart."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")[:: _STEP] if not text.isascii() else np.frombuffer(text.encode(), np.uint8)[:: _STEP]
    marked = _IS_HEX[np.minimum(codes, 255)]
    if len(marked) < 4:
        return
    four = marked[:-3] & marked[1:-2] & marked[2:-1] & marked[3:]
    done = 0
    for k in np.flatnonzero(four):
        at = int(k) * _STEP
        if at < done:
            continue
        low = at
        while low > done and text[low - 1] in "0123456789abcdef":
            low -= 1
        done = HEX.match(text, low).end()
        if done - low >= HEX_LEAST:
            yield low, done


def scan(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) in code points, by start, then kind as listed.

    Matches of one kind never overlap: the first one from the left counts,
    also when it is then too short to be kept.
    """
    found = [(a, b, "hex") for a, b in hex_runs(text)]
    done = dict.fromkeys(KINDS, 0)
    web = WebTokens(text)
    hits = sorted((end - n + 1, kind) for end, (kind, n) in _WORDS.iter(lowered(text)))
    for at, kind in hits:
        if at < done[kind]:
            continue
        if kind in ANCHORED:
            end, good = ANCHORED[kind](text, at) or (at, False)
        else:
            end = (web.match(at) if kind == "web_token" else CHECKED[kind](text, at)) or at
            good = end > at
        done[kind] = max(done[kind], end)
        if good:
            found.append((at, end, kind))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span, or group of overlapping spans, replaced by the kind of its first."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def find_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_other, base_sha256, spans`` for each row of ``docs(doc_id, text)``.

    The base kinds are complete as their patterns say; other kinds add spans.
    A web token's head has at most WEB_HEAD characters. Time grows with the
    length of a text, whatever it holds.
    Null and empty texts hold none. Each row is answered for itself, so nulls
    in doc_id and repeated rows change nothing. Other columns are not read. An
    empty table gives no rows.
    """
    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_other long, base_sha256 string, spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = [], [], []
            for text in batch.column(1):
                every = scan(text.as_py() or "")
                base = [s for s in every if s[2] in KINDS[:3]]
                own = [sum(s[2] == kind for s in base) for kind in KINDS[:3]]
                counts.append([*own, len(every) - len(base)])
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
            numbers = np.array(counts, np.int64).reshape(-1, 4)
            columns = [pa.array(numbers[:, k]) for k in range(4)]
            names = [part.split()[0] for part in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(digests, pa.string()), pa.array(spans, pa.string())], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns of docs, with secrets in text replaced, and n_chars, where there is such a column, counted again for changed texts.

    Null and empty texts stay as they are, and so do rows without a secret.
    Each row is treated for itself, so repeated rows stay repeated and nulls
    in other columns stay. An empty table gives no rows.
    """
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches, "text"):
            rows = [batch.column(k) for k in range(batch.num_columns)]
            at = columns.index("text")
            texts = rows[at].to_pylist()
            changed = {i: redacted(t, s) for i, t in enumerate(texts) if t and (s := scan(t))}
            if changed:
                rows[at] = pa.array([changed.get(i, t) for i, t in enumerate(texts)], rows[at].type)
                if "n_chars" in columns:
                    k = columns.index("n_chars")
                    rows[k] = pa.array([len(changed[i]) if i in changed else n for i, n in enumerate(rows[k].to_pylist())], rows[k].type)
            yield pa.RecordBatch.from_arrays(rows, columns)

    return docs.mapInArrow(run, docs.schema)
