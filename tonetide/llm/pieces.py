"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text is a dummy space and itself, cut into marked words: each a run of spaces and what
follows up to the next space. No piece of the vocabulary reaches over such a cut, so the best
segmentation of a text is that of its words. The distinct new words of a batch are sorted,
which makes neighbours share prefixes as in a depth-first walk of their trie: the forward
scores up to the common prefix stay, only the rest is computed. Backward steps follow a trie
of reversed pieces, so they stop where no piece can begin.

A piece's score is its log probability. The vocabulary given here was made by merging and
stores ranks (0, -1, -2, …) instead; those are read as Zipf's law, -log(rank + 2). A
character outside the vocabulary becomes the pieces of its UTF-8 bytes. Equal scores are
settled for the longest last piece, at each position.

Decoding joins the bytes of the pieces and drops the dummy space; it gives back every text
exactly, U+2581 included (as bytes, where the usual library makes it a space).

Defined cases: null and empty texts have no ids and decode to the empty text. Repeated rows
are encoded alike. An empty table gives an empty table. Of a very long text only its distinct
words need the search.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tonetide.llm.common import documents, give_back, pack, unpack

MODEL = "piece_bpe_32k.model"
MARK = "▁"
MARKED_WORD = re.compile(r" +[^ ]*")
#: Words whose segmentation a task remembers; beyond, it starts afresh (results do not change).
REMEMBERED = 150_000
#: A byte fallback is worse than any segmentation into pieces of the vocabulary.
FALLBACK = -100.0


class Pieces:
    """A vocabulary ready for search: id and score by piece, bytes by id."""

    def __init__(self, rows: Iterable[tuple[str, float, str]]):
        """``rows``: piece, log probability and kind (text, byte or other) in id order."""
        self.bytes: list[bytes] = []
        self.byte_ids = [0] * 256
        self.ends: dict = {}
        for number, (piece, score, kind) in enumerate(rows):
            if kind == "byte":
                value = int(piece[3:5], 16)
                self.byte_ids[value] = number
                self.bytes.append(bytes([value]))
            elif kind == "text":
                plain = piece.replace(MARK, " ")
                if re.search(r"[^ ] ", plain):
                    raise ValueError(f"piece {piece!r} reaches over the end of a word")
                self.bytes.append(plain.encode())
                node = self.ends
                for c in plain[:0:-1]:
                    node = node.setdefault(c, [{}, None, 0])[0]
                node.setdefault(plain[0], [{}, None, 0])[1:] = score, number
            else:
                self.bytes.append(b"")
        self.known: dict[str, bytes] = {}

    def learn(self, words: Iterable[str]) -> None:
        """Segment distinct words, sorted, each from where it leaves the one before."""
        score, back = [0.0], [(0, ())]
        previous = ""
        root = self.ends
        for word in sorted(words):
            size = len(word)
            same = 0
            top = min(size, len(previous))
            while same < top and word[same] == previous[same]:
                same += 1
            del score[same + 1 :], back[same + 1 :]
            for end in range(same + 1, size + 1):
                last = end - 1
                best, came, ids = score[last] + FALLBACK, last, None
                node, at = root, last
                while at >= 0:
                    step = node.get(word[at])
                    if step is None:
                        break
                    node, own, number = step
                    if own is not None and (own := score[at] + own) >= best:
                        best, came, ids = own, at, number
                    at -= 1
                if ids is None:
                    ids = tuple(self.byte_ids[b] for b in word[last].encode())
                score.append(best)
                back.append((came, ids))
            out, at = [], size
            while at:
                at, ids = back[at]
                out.extend(reversed(ids) if type(ids) is tuple else (ids,))
            self.known[word] = array("I", reversed(out)).tobytes()
            previous = word

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        cut = [MARKED_WORD.findall(" " + t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = set().union(*cut).difference(self.known)
        self.learn(new)
        known = self.known
        return [b"".join([known[w] for w in words]) for words in cut]

    def decode(self, ids: bytes) -> str:
        table = self.bytes
        return b"".join([table[i] for i in array("I", ids)])[1:].decode()


@functools.cache
def vocabulary(model: str = MODEL) -> Pieces:
    """The pieces of a model file named in the installed collection, or at a path."""
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    path = model if "/" in model else public_tokenizers.path(model)
    sp = SentencePieceProcessor(model_file=path)
    scores = [sp.get_score(i) for i in range(sp.get_piece_size())]
    ranked = min(scores) <= -1000  # ranks of merges instead of log probabilities
    rows = []
    for i, score in enumerate(scores):
        other = sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i)
        kind = "byte" if sp.is_byte(i) else "other" if other else "text"
        rows.append((sp.id_to_piece(i), -math.log(2 - score) if ranked else score, kind))
    return Pieces(rows)


def _slices(texts: pa.Array, rows: int = 500):
    for at in range(0, len(texts), rows):
        yield texts.slice(at, rows).to_pylist()


def encoded(text: Column, model: str = MODEL) -> Column:
    """The ids of a text as an array of integers."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _encoded_batches(batches, vocabulary(model))

    return arrow_udf(run, "array<int>")(text.cast("string"))


def _encoded_batches(batches: Iterable[pa.Array], pieces: Pieces) -> Iterator[pa.Array]:
    """The ids of each batch of a task's texts.

    Words are forgotten at the task's end: the worker goes on to tasks that need the room.
    """
    try:
        for texts in batches:
            made = [ids for part in _slices(texts) for ids in pieces.encode(part)]
            ends = np.append(0, np.cumsum([len(b) // 4 for b in made])).astype(np.int32)
            values = np.frombuffer(b"".join(made), np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
    finally:
        pieces.known.clear()
        give_back()


def decoded(ids: Column, model: str = MODEL) -> Column:
    """The text of an array of ids."""

    def run(lists: pa.Array) -> pa.Array:
        pieces = vocabulary(model)
        return pa.array(
            [pieces.decode(array("I", i).tobytes()) if i else "" for i in lists.to_pylist()]
        )

    return arrow_udf(run, "string")(ids)


ROUND_TRIP = "n_pieces bigint, ids_crc32 bigint, decoded_sha256 string, same boolean"


def round_trip(text: Column, model: str = MODEL) -> Column:
    """Encodes, decodes and digests, without handing the ids back to the JVM."""

    def run(texts: pa.Array) -> pa.Array:
        pieces = vocabulary(model)
        rows = []
        for part in _slices(texts):
            for t, ids in zip(part, pieces.encode(part)):
                back = pieces.decode(ids)
                digest = hashlib.sha256(back.encode()).hexdigest()
                rows.append((len(ids) // 4, zlib.crc32(ids), digest, back == (t or "")))
        columns = list(zip(*rows)) or [(), (), (), ()]
        names = [c.split()[0] for c in ROUND_TRIP.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return arrow_udf(run, ROUND_TRIP).asNondeterministic()(text.cast("string"))


def op9_sentencepiece(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", round_trip(F.col("text")).alias("made")).select(
        "doc_id", "made.*"
    )


def with_ids(docs: DataFrame, text: str = "text", model: str = MODEL) -> DataFrame:
    """``docs`` with column ``ids``."""
    packed = pack(docs, ids=encoded(docs[text], model))
    return unpack(packed, ids=F.col("ids"))
