"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file names the byte strings of a vocabulary. The library works on characters, so each of the 256
bytes is written as one visible character (the table of ``byte_characters``) and every token of more than
one byte gets the one merge that makes it: the two parts that its bytes come to by merges of lower rank.
The lowest rank first is then the order of merges too, and the library's ids equal those of the ranks.

Ids never leave their slice of rows: no shuffle. Matches of the pattern are found first and each different one is
encoded once in a slice. The quick pattern engine knows another version of Unicode than the library, so it splits only
texts of ``AGREED`` characters, on which the two are compared when the vocabulary is read. A long text is cut where a
character that is no white space stands before a space or line end; no match reaches over such a place, so memory is
bounded by a slice, a cache of ``CACHE`` matches and the longest stretch without one. The vocabulary, a file of
fixed size, is broadcast.

Places of tokens come from the byte table: a token's bytes are mapped to the characters they belong to,
and the tokens that share one character have that character's place. Decoding joins the
bytes of the ids; in text, bytes that are no whole character become U+FFFD, in ``raw`` they stay.

Defined results: a null or empty text has no ids; special tokens are ordinary text; ids that are null
or beyond the vocabulary have no bytes; null ids have neither bytes nor text; repeated rows are coded each;
an empty table gives an empty one; other columns pass through, whatever their names.
"""

from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructType

from flowguard.llm.common import add_struct, spare
from flowguard.llm.words import text_column

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: Bytes of text that a task encodes at a time, and characters of a text after which it may be cut.
SLICE = 1 << 20
PIECE = 1 << 17
#: Matches whose ids a worker remembers, twice over, and the longest of them in characters.
CACHE = 120_000
CACHED = 48
#: Scripts, punctuation and symbols that have long been in Unicode.
AGREED = "\x00-\u0557\u0590-\u05ff\u0621-\u063a\u1e00-\u1eff\u2000-\u2064\u20a0-\u20b0\u2190-\u23ff\u3000-\u3096\u30a0-\u30ff\u4e00-\u9fa5\uac00-\ud7a3\uff01-\uff5e\U0001f300-\U0001f64f"
OTHER = re.compile(f"[^{AGREED}]")
CUT = re.compile(r"[^\s\x1c-\x1f\x85](?=[ \n])")


@dataclass
class Vocabulary:
    """Byte strings by id (b"" where an id is free), the library's form of the merges, the pattern, and whether the quick
    engine splits the agreed characters as the library does.
    """

    raw: list[bytes]
    tokenizer: str
    pattern: str
    agreed: bool


def byte_characters() -> list[str]:
    """A visible character for each byte: itself in Latin-1 if that is visible, else one from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def _parts(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """What the bytes of ``token`` come to by merges of a lower rank than its own."""
    own, parts = ranks[token], [token[i : i + 1] for i in range(len(token))]
    while True:
        near = ((ranks.get(a + b, own), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        rank, i = min(near, default=(own, 0))
        if rank >= own:
            return parts
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def read_vocabulary(path: str = RANKS, pattern: str = PATTERN) -> Vocabulary:
    """The vocabulary of a rank file: a line for each token, its bytes in base64 and its rank."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"{path} has no token for the bytes {missing[:5]}")
    char = byte_characters()

    def spell(token: bytes) -> str:
        return "".join([char[b] for b in token])

    merges = []
    for token in sorted(ranks, key=ranks.get):
        if len(token) > 1:
            parts = _parts(token, ranks)
            if len(parts) != 2:
                raise ValueError(f"{path}: no merge makes {token!r}")
            merges.append((spell(parts[0]), spell(parts[1])))
    tokenizer = Tokenizer(models.BPE(vocab={spell(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    raw = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        raw[rank] = token
    chars = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000 and not OTHER.match(chr(c))]
    text = "".join([f"a{c}1{c} {c}!" for c in chars])
    agreed = regex.compile(pattern).findall(text) == _splitter(pattern)(text)
    return Vocabulary(raw, tokenizer.to_str(), pattern, agreed)


def _splitter(pattern: str):
    from tokenizers import Regex, pre_tokenizers

    split = pre_tokenizers.Split(Regex(pattern), "isolated")
    return lambda text: [word for word, _ in split.pre_tokenize_str(text)]


def cuts(text: str, piece: int = PIECE) -> Iterator[str]:
    """``text`` in pieces of at least ``piece`` characters, cut only where no match of the pattern can reach over."""
    at = 0
    while len(text) - at > piece:
        found = CUT.search(text, at + piece - 1)
        if not found:
            break
        yield text[at : found.end()]
        at = found.end()
    yield text[at:]


class Coder:
    """Encodes and decodes with one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark decides how many cores a task has
        from tokenizers import Tokenizer

        self.vocabulary = vocabulary
        self.tokenizer = Tokenizer.from_str(vocabulary.tokenizer)
        self.split, self.quick = _splitter(vocabulary.pattern), regex.compile(vocabulary.pattern).findall
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.long = np.array([len(t) for t in vocabulary.raw], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.long)])
        self.bytes = np.frombuffer(b"".join(vocabulary.raw), np.uint8)

    def words(self, text: str) -> list[str]:
        """The matches of the pattern."""
        return self.quick(text) if self.vocabulary.agreed and not OTHER.search(text) else self.split(text)

    def _ids(self, words: list[str]) -> dict[str, bytes]:
        """Ids of each different word, as 32-bit integers."""
        table, fresh = {}, []
        for w in set(words):
            ids = self.young.get(w) or self.old.get(w)
            if ids is None:
                fresh.append(w)
            else:
                table[w] = self.young[w] = ids
        for k in range(0, len(fresh), 1 << 14):
            part = fresh[k : k + (1 << 14)]
            for w, coded in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                ids = table[w] = np.array(coded.ids, np.uint32).tobytes()
                if len(w) <= CACHED:
                    self.young[w] = ids
        if len(self.young) > CACHE:  # what the last slices did not use goes next time
            self.old, self.young = self.young, {}
        return table

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        size = 0

        def flush() -> None:
            table = self._ids(list(chain.from_iterable(words for _, words in held)))
            for k, words in held:
                out[k].append(b"".join([table[w] for w in words]))
            held.clear()

        for k, t in enumerate(texts):
            for piece in cuts(t) if t else ():
                held.append((k, self.words(piece)))
                size += len(piece)
                if size > SLICE:
                    flush()
                    size = 0
        flush()
        return [np.frombuffer(b"".join(x), np.uint32) for x in out]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids, gathered from the joined byte strings of the vocabulary."""
        ids = ids[ids < len(self.long)]
        long = self.long[ids]
        ends = np.cumsum(long)
        at = np.repeat(self.first[ids] - (ends - long), long) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.bytes[at].tobytes()

    def places(self, ids: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character of each token and the one after its last, in the text of bytes ``data``."""
        ends = np.cumsum(self.long[ids])
        char = np.cumsum((data & 0xC0) != 0x80) - 1
        return char[ends - self.long[ids]], char[ends - 1] + 1


_coders: dict[int, Coder] = {}


def _coder(shared) -> Coder:
    value = shared.value  # one object for all tasks of a worker that share the broadcast
    if id(value) not in _coders or _coders[id(value)].vocabulary is not value:
        _coders.clear()
        _coders[id(value)] = Coder(value)
    return _coders[id(value)]


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*parts, np.zeros(0, np.int32)]).astype(np.int32)))


def encode(docs: DataFrame, into: str, text: str = "text", path: str = RANKS, packed: bool = False, offsets: bool = False) -> DataFrame:
    """``docs`` with a struct ``into``: n_tokens, and ids as integers or (``packed``) as little-endian 32-bit words.

    ``offsets`` adds ``start`` and ``stop``: the code points that each token covers, wholly or in part.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    at = docs.columns.index(text)
    numbers = ArrayType(IntegerType())
    kind = StructType().add("n_tokens", LongType()).add("ids", BinaryType() if packed else numbers)
    if offsets:
        kind = kind.add("start", numbers).add("stop", numbers)

    def judge(part: pa.RecordBatch) -> pa.StructArray:
        coder = _coder(shared)
        column = part.column(at)
        coded = coder.encode(column.to_pylist())
        ids = pa.array([x.astype("<u4").tobytes() for x in coded], pa.binary()) if packed else _lists(coded)
        found = [pa.array([len(x) for x in coded], pa.int64()), ids]
        if offsets:
            data, where = text_column(column)
            places = [coder.places(x, data[a:b]) for x, a, b in zip(coded, where[:-1].tolist(), where[1:].tolist())]
            found += [_lists([p[0] for p in places]), _lists([p[1] for p in places])]
        return pa.StructArray.from_arrays(found, kind.names)

    return add_struct(docs, text, into, kind, judge, SLICE)


def decode(rows: DataFrame, into: str, ids: str = "ids", path: str = RANKS) -> DataFrame:
    """``rows`` with a struct ``into``: the bytes of the ids (``raw``) and their text; ``ids`` in either form of ``encode``."""
    if into != spare(rows, into):
        raise ValueError(f"{into} is a column already")
    shared = rows.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    at = rows.columns.index(ids)
    kind = StructType().add("raw", BinaryType()).add("text", StringType())
    schema = StructType([*rows.schema.fields]).add(into, kind)

    def numbers(x) -> np.ndarray:
        if isinstance(x, bytes):
            return np.frombuffer(x[: len(x) // 4 * 4], "<u4")
        return np.array([i for i in x if i is not None and i >= 0], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coder = _coder(shared)
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                raw = [None if x is None else coder.decode(numbers(x)) for x in part.column(at).to_pylist()]
                text = [None if x is None else x.decode("utf-8", "replace") for x in raw]
                both = pa.StructArray.from_arrays([pa.array(raw, pa.binary()), pa.array(text, pa.string())], kind.names)
                yield pa.RecordBatch.from_arrays([*part.columns, both], [*part.schema.names, into])

    return rows.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of the bytes that they decode to."""
    from flowguard.llm.common import documents

    coded = encode(documents(spark, sf_dir).select("doc_id", "text"), "coded", packed=True)
    back = decode(coded.select("doc_id", "coded.n_tokens", "coded.ids"), "back")
    return back.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("back").raw, 256).alias("decoded_sha256")
    )
