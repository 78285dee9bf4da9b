"""Token ids as files of range-coded blocks.

Documents are dealt by ranges of their id and sorted, so the files hold all ids in ascending
order of documents. A row of a file is one chunk: the index of its documents (ids and token
counts), the coded blocks, their lengths and checksums. Every block is decoded by itself and
checked. Reading back takes the start of each document from the counts in the indexes.

Text is cut at white space, which no token of this tokenizer contains, and each distinct word
is tokenized once per task and remembered: the ids are those of the whole text. Where the
tokenizer lower-cases and parts letters from marks, words of Latin letters share their ids with
those that differ in capitals or in marks after them; the letters go straight to its model, many
to a line, and the suffix of a word's last token says where it ends. Other new words go to the
whole tokenizer many to a line, and the line's ids are dealt out by their offsets.

Defined cases: a null or empty text has only the end id. Rows without id come first, rows with
equal ids in the order of a hash of the text. Repeated rows are written each. A document longer
than a chunk makes a long chunk. An empty table gives an empty file set and result.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonetide.llm import coder
from tonetide.llm.common import documents, pieces
from tonetide.session import fresh_path

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
CHUNK_IDS = 4 << 20
#: Words whose ids a worker remembers; beyond, it starts afresh (results do not change).
REMEMBERED = 400_000
#: New words that make a line; a call for each would cost more than the tokenizing.
LINE_WORDS = 200
#: Letters whose small forms are one letter as well and that nothing composes with, and marks.
_LETTERS = "".join(c for c in map(chr, range(65, 256)) if c.isalpha() and c not in "ªµº")
_MARKS = "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"
_PARTED = f"^(?P<stem>[{_LETTERS}]+)(?P<tail>[{re.escape(_MARKS)}]*)$"
CHUNK = (
    "part int, chunk int, n_ids bigint, doc_ids binary, without_id binary, counts binary, "
    "lengths binary, checksums binary, payload binary"
)


def _dealt(
    values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, order: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``values`` one after another in the given order, and where each begins."""
    size = sizes[order]
    ends = np.append(0, np.cumsum(size))
    at = np.repeat(starts[order] - ends[:-1], size)
    at += np.arange(len(at))
    return values[at], ends


class WordTokenizer:
    """The installed library behind a memory of words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.model = None
        if self._splits():
            # stems are normalised and one token of the splitter each, so the model is all they need
            self.model = Tokenizer(self.tokenizer.model)
            self.model.pre_tokenizer = pre_tokenizers.Sequence(
                [
                    pre_tokenizers.WhitespaceSplit(),
                    pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
                ]
            )
            suffix = self.tokenizer.model.end_of_word_suffix
            vocabulary = self.tokenizer.get_vocab()
            self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
            self.last[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True

    def _splits(self) -> bool:
        """Whether stems are lower-cased, and parted from what follows and marked at their end."""
        t = self.tokenizer
        if t.normalizer is None or t.pre_tokenizer is None or t.post_processor is not None:
            return False
        split = [w for w, _ in t.pre_tokenizer.pre_tokenize_str(f"{_LETTERS} b{_MARKS} c")]
        return (
            bool(getattr(t.model, "end_of_word_suffix", None))
            and t.normalizer.normalize_str(_LETTERS + _MARKS) == _LETTERS.lower() + _MARKS
            and len(split) == 4
            and split[1:] == ["b", _MARKS, "c"]
        )

    def encode(self, texts: list[bytes | None], end: bytes) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers, then ``end``."""
        ids, counts = self.ids_of(pa.array(texts, pa.binary()))
        cuts = np.append(0, np.cumsum(counts)).tolist()
        return [ids[a:b].tobytes() + end for a, b in zip(cuts[:-1], cuts[1:])]

    def ids_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and their number in each text.

        Arrow tells words and their parts apart; Python sees each distinct part once.
        """
        words = pc.ascii_split_whitespace(texts.cast(pa.string()).fill_null(""))
        cut = words.flatten().dictionary_encode()
        ids, starts, sizes = self._words(cut.dictionary)
        ids, ends = _dealt(ids, starts, sizes, cut.indices.to_numpy())
        bounds = words.offsets.to_numpy()
        return ids, np.diff(ends[bounds - bounds[0]])

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of distinct words: all in a row, where each begins, and how many it has."""
        if self.model:
            parts = pc.extract_regex(words, _PARTED)
            stems = pc.coalesce(pc.utf8_lower(parts.field(0)), words)
            stems = pc.if_else(parts.is_valid(), stems, words)
            tails = pc.if_else(parts.is_valid(), parts.field(1), "")
            cut = pa.concat_arrays([stems, tails]).dictionary_encode()
            whole = pc.filter(words, pc.and_(parts.is_null(), pc.not_equal(words, ""))).to_pylist()
        else:
            cut, whole = words.dictionary_encode(), words.to_pylist()
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        known[""] = b""
        units = cut.dictionary.to_numpy(zero_copy_only=False).tolist()
        whole = [w for w in whole if w not in known]
        for at in range(0, len(whole), LINE_WORDS << 5):
            known.update(self._tokenized(whole[at : at + (LINE_WORDS << 5)]))
        new = [u for u in units if u not in known]
        for at in range(0, len(new), LINE_WORDS << 5):
            known.update(self._stems(new[at : at + (LINE_WORDS << 5)]))
        made = [known[u] for u in units]
        sizes = np.fromiter(map(len, made), np.int64, len(made)) // 4
        ids, starts = np.frombuffer(b"".join(made), "<u4"), np.cumsum(sizes) - sizes
        if not self.model:
            return ids, starts, sizes
        both = cut.indices.to_numpy().reshape(2, -1).T.reshape(-1)
        ids, ends = _dealt(ids, starts, sizes, both)
        return ids, ends[:-1:2], np.diff(ends[::2])

    def _stems(self, stems: list[str]) -> Iterator[tuple[str, bytes]]:
        """Words that are one token of the splitter each, with their ids: the last is marked."""
        lines = [" ".join(stems[i : i + LINE_WORDS]) for i in range(0, len(stems), LINE_WORDS)]
        made = self.model.encode_batch_fast(lines, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, "<u4") for e in made])
        cuts = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
        if len(cuts) != len(stems):
            raise ValueError("the last token of a word is not marked as such")
        raw = ids.tobytes()
        return zip(stems, (raw[a:b] for a, b in zip([0, *cuts], cuts)))

    def _tokenized(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each word with its ids. A word that may hold a special token is a line by itself:
        such tokens may take in the blanks around them."""
        plain = [w for w in words if "<|" not in w]
        lines = [plain[at : at + LINE_WORDS] for at in range(0, len(plain), LINE_WORDS)]
        lines += [[w] for w in words if "<|" in w]
        made = self.tokenizer.encode_batch([" ".join(t) for t in lines], add_special_tokens=False)
        for line, e in zip(lines, made):
            ids = np.array(e.ids, "<u4").tobytes()
            if len(line) == 1:
                yield line[0], ids
                continue
            places = np.fromiter((first for first, _ in e.offsets), np.int64, len(e.ids))
            after = np.cumsum([len(w) + 1 for w in line[:-1]])
            cuts = (4 * np.searchsorted(places, after)).tolist()
            yield from zip(line, (ids[a:b] for a, b in zip([0, *cuts], [*cuts, len(ids)])))


@functools.cache
def tokenizer(name: str = TOKENIZER) -> WordTokenizer:
    """From a file named in the installed collection, or at a path."""
    import public_tokenizers

    return WordTokenizer(name if "/" in name else public_tokenizers.path(name))


def _chunk_row(
    part: int,
    chunk: int,
    numbers: list[pa.Array],
    made: list[np.ndarray],
    sizes: list[np.ndarray],
) -> pa.RecordBatch:
    stream, ids = np.concatenate(made), pa.concat_arrays(numbers)
    payloads, sums = coder.encode(stream)
    row = {
        "part": pa.array([part], pa.int32()),
        "chunk": pa.array([chunk], pa.int32()),
        "n_ids": pa.array([len(stream)], pa.int64()),
        "doc_ids": ids.fill_null(0).to_numpy().astype("<i8"),
        "without_id": ids.is_null().to_numpy(zero_copy_only=False).astype("u1"),
        "counts": np.concatenate(sizes).astype("<u4"),
        "lengths": np.array([len(p) for p in payloads], "<u4"),
        "checksums": np.array(sums, "<u4"),
        "payload": np.frombuffer(b"".join(payloads), np.uint8),
    }
    return pa.RecordBatch.from_pydict(
        {
            k: v if isinstance(v, pa.Array) else pa.array([v.tobytes()], pa.binary())
            for k, v in row.items()
        }
    )


def write(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text: str = "text",
    name: str = TOKENIZER,
    end_id: int = END_ID,
    chunk_ids: int = CHUNK_IDS,
) -> None:
    """Tokenize, code and write all documents below ``path``."""
    rows = docs.select(
        docs[id_col].alias("id"),
        docs[text].cast("binary").alias("text"),
        F.xxhash64(docs[text]).alias("mark"),
    )
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", "mark").drop("mark")

    def run(batches):
        part, chunk, size = TaskContext.get().partitionId(), 0, 0
        numbers: list[pa.Array] = []
        made: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        words = tokenizer(name)
        for batch in batches:
            for piece in pieces(batch, 2 << 20):
                ids, counts = words.ids_of(piece["text"])
                ids = np.insert(ids, np.cumsum(counts), end_id)
                counts = counts + 1
                ends = np.cumsum(counts)
                at = 0
                while at < len(ends):
                    # the text that fills the chunk still belongs to it
                    first = int(ends[at] - counts[at])
                    to = min(len(ends), int(np.searchsorted(ends, first + chunk_ids - size)) + 1)
                    numbers.append(piece["id"].slice(at, to - at))
                    made.append(ids[first : ends[to - 1]])
                    sizes.append(counts[at:to])
                    size += int(ends[to - 1]) - first
                    at = to
                    if size >= chunk_ids:
                        yield _chunk_row(part, chunk, numbers, made, sizes)
                        numbers, made, sizes, size, chunk = [], [], [], 0, chunk + 1
        if made:
            yield _chunk_row(part, chunk, numbers, made, sizes)

    ordered.mapInArrow(run, CHUNK).write.mode("overwrite").parquet(path)


def decoded(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a chunk and the number of them in each document."""
    ends = np.append(0, np.cumsum(np.frombuffer(row["lengths"], "<u4"), dtype=np.int64))
    payloads = [row["payload"][a:b] for a, b in zip(ends[:-1], ends[1:])]
    sums = np.frombuffer(row["checksums"], "<u4").tolist()
    return coder.decode(payloads, sums, row["n_ids"]), np.frombuffer(row["counts"], "<u4")


DOCUMENT = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def read(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files alone."""
    stored = spark.read.schema(CHUNK).parquet(path)
    # one row per chunk of millions of ids
    earlier = Window.orderBy("part", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored.select(
        "part", "chunk", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("base")
    )

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                ids, counts = decoded(row)
                ends = np.append(0, np.cumsum(counts, dtype=np.int64))
                raw = memoryview(ids.tobytes())
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:])]
                missing = np.frombuffer(row["without_id"], "u1").astype(bool)
                n = len(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=missing),
                        pa.array(row["base"] + ends[:-1]),
                        pa.array(counts.astype(np.int64)),
                        pa.array(sums, pa.int64()),
                    ],
                    [c.split()[0] for c in DOCUMENT.split(", ")],
                )

    # joined before decoding: a plan that is changed while it runs then decodes nothing twice
    return stored.join(starts, ["part", "chunk"]).mapInArrow(run, DOCUMENT)


def op5_token_files(spark, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    write(documents(spark, sf_dir), path)
    return read(spark, path)
