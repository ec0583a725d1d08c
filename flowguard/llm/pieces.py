"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text is marked (a leading mark, spaces become marks) and cut into marked words; no piece of the
vocabulary reaches across a cut. The distinct words of a slice are sorted, which is the depth-first
order of their trie: walking from one word to the next keeps the forward states of the common
prefix and computes only what follows. A state is the best score of a prefix with its last piece.

For a unigram vocabulary the best segmentation is the one of highest score. For a merge (BPE)
vocabulary a step from piece a to piece b is allowed only if merging the text a+b from its characters
yields a and b again; segmentations that are allowed everywhere are what merging the whole text
yields, so exactly one path survives and equals the library's result. Characters without a piece
become byte pieces.

Encodings never leave their slice: no shuffle, no table of all words, memory bounded by a slice and
a cache of ``CACHE`` words per worker. The vocabulary (the file's pieces and scores, a fixed size) is
broadcast; it is read, never trained.

Defined results: a null or empty text has no ids; a mark character in a text is a space, as in the
library; decoding replaces bytes that are not UTF-8. Extra columns pass through.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructType

from flowguard.llm.common import add_struct, spare

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Words whose encodings a worker remembers, twice over.
CACHE = 120_000
#: Pairs of pieces of which a worker remembers whether they may follow each other.
PAIRS = 400_000
#: Characters of one long word after which its states are no longer shared.
SHARED = 1 << 12
#: Score of a character that has no piece.
UNKNOWN = -1e10
#: Bytes of text whose distinct words are sorted together.
SLICE = 3 << 20

CODED = StructType().add("ids", ArrayType(IntegerType())).add("round_trip", BooleanType())


@dataclass
class Vocabulary:
    """Pieces by id, their scores, the ids of the 256 byte pieces, and whether pieces arise by merging."""

    pieces: list[str]
    scores: list[float]
    bytes_at: list[int]
    control: set[int]
    merging: bool
    ids: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        special = self.control | set(self.bytes_at)
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in special}
        byte = {i: bytes([b]) for b, i in enumerate(self.bytes_at)}
        self.raw = [byte.get(i, b"" if i in self.control else p.replace(MARK, " ").encode()) for i, p in enumerate(self.pieces)]


def read_vocabulary(path: str = MODEL) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = range(len(sp))
    pieces = [sp.id_to_piece(i) for i in n]
    by_byte = {int(pieces[i][1:-1], 16): i for i in n if sp.is_byte(i)}
    control = {i for i in n if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
    return Vocabulary(pieces, [sp.get_score(i) for i in n], [by_byte[b] for b in range(256)], control, merging=True)


class Encoder:
    """Encodes and decodes with one vocabulary; the caches live as long as the worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.packed = {p: np.array([i], np.int32).tobytes() for p, i in vocabulary.ids.items()}
        self.trie = self._grow_trie()

    def merge(self, text: str) -> list[str]:
        """The pieces that merging yields: always the best neighbours first, the leftmost of equals."""
        parts, ids, scores = list(text), self.v.ids, self.v.scores
        while True:
            best = max(((scores[ids[a + b]], -k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ids), default=None)
            if best is None:
                return parts
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def _may_follow(self, a: str, b: str) -> bool:
        key = (a, b)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.merge(a + b) == [a, b]
        return known

    def _grow_trie(self) -> dict:
        """Pieces spelled backwards; a node's entry "" is the piece that ends there."""
        root: dict = {}
        for p in self.v.ids:
            if self.v.merging and len(p) > 1 and self.merge(p) != [p]:
                continue  # merging never leaves this piece
            node = root
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[""] = p
        return root

    def _forward(self, word: str, states: list) -> None:
        """Add the states of the prefixes of ``word`` that ``states`` lacks: best score, last piece, its start."""
        ids, scores, merging, pairs, trie = self.v.ids, self.v.scores, self.v.merging, self.pairs, self.trie
        for i in range(len(states), len(word) + 1):
            node, j, found = trie, i, []
            while j:
                node = node.get(word[j - 1])
                if node is None:
                    break
                j -= 1
                if "" in node:
                    found.append((j, node[""]))
            if not found or found[0][0] != i - 1:
                found.insert(0, (i - 1, word[i - 1]))  # spelled in bytes
            best = None
            for j, piece in reversed(found):
                before = states[j]
                if merging and j:
                    ok = pairs.get((before[1], piece))
                    if not (self._may_follow(before[1], piece) if ok is None else ok):
                        continue
                at = ids.get(piece)
                total = before[0] + (UNKNOWN if at is None else scores[at])
                if best is None or total > best[0]:
                    best = total, piece, j
                if merging:
                    break  # no other step is allowed
            states.append(best)

    def encode_words(self, words: set[str]) -> dict[str, bytes]:
        """Ids of each word as bytes of 32-bit integers."""
        out, before, states, packed = {}, "", [(0.0, "", 0)], self.packed
        for word in sorted(words):
            k, most = 0, min(len(before), len(word))
            while k < most and before[k] == word[k]:
                k += 1
            del states[k + 1 :]
            self._forward(word, states)
            ids, i = [], len(word)
            while i:
                _, piece, i = states[i]
                known = packed.get(piece)
                ids.append(self._spell(piece) if known is None else known)
            ids.reverse()
            out[word] = b"".join(ids)
            before = word
            if len(states) > SHARED:
                before, states = "", states[:1]
        return out

    def _spell(self, char: str) -> bytes:
        return np.array([self.v.bytes_at[b] for b in char.encode()], np.int32).tobytes()

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        cut = [WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        table, fresh = {}, set()
        for w in set().union(*cut) if cut else ():
            ids = self.young.get(w) or self.old.get(w)
            if ids is None:
                fresh.add(w)
            else:
                table[w] = self.young[w] = ids
        table.update(new := self.encode_words(fresh))
        self.young.update((w, ids) for w, ids in new.items() if len(w) <= 64)
        if len(self.young) > CACHE:  # what the last slices did not use goes next time
            self.old, self.young = self.young, {}
        return [np.frombuffer(b"".join([table[w] for w in words]), np.int32) for words in cut]

    def decode(self, ids: np.ndarray) -> str:
        raw = self.v.raw
        text = b"".join([raw[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_encoders: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    value = shared.value  # one object for all tasks of a worker that share the broadcast
    key = id(value)
    if key not in _encoders or _encoders[key].v is not value:
        _encoders.clear()
        _encoders[key] = Encoder(value)
    return _encoders[key]


def encode(docs: DataFrame, into: str, text: str = "text", model: str = MODEL) -> DataFrame:
    """``docs`` with a struct ``into``: ids of the text, and whether decoding them gives the text back."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(model))
    at = docs.columns.index(text)

    def judge(part: pa.RecordBatch) -> pa.StructArray:
        coder = _encoder(shared)
        texts = part.column(at).to_pylist()
        coded = coder.encode(texts)
        same = [coder.decode(ids) == (t or "").replace(MARK, " ") for ids, t in zip(coded, texts)]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in coded])]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(coded)))
        return pa.StructArray.from_arrays([ids, pa.array(same)], CODED.names)

    return add_struct(docs, text, into, CODED, judge, SLICE)


def decode(rows: DataFrame, into: str, ids: str = "ids", model: str = MODEL) -> DataFrame:
    """``rows`` with the text of the ids in ``into``; null ids have no text."""
    shared = rows.sparkSession.sparkContext.broadcast(read_vocabulary(model))
    name = spare(rows, into)
    fields = rows.schema.fields
    at = rows.columns.index(ids)
    schema = StructType([*fields]).add(name, "string")

    def run(batches):
        for batch in batches:
            coder = _encoder(shared)
            texts = [None if x is None else coder.decode(np.array([i for i in x if i is not None], np.int32)) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, name])

    return rows.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether they decode to its text."""
    from flowguard.llm.common import documents

    coded = encode(documents(spark, sf_dir).select("doc_id", "text"), "coded")
    c = F.col("coded")
    return coded.select("doc_id", F.size(c.ids).cast("long").alias("n_tokens"), c.ids.alias("ids"), c.round_trip.alias("round_trip"))
