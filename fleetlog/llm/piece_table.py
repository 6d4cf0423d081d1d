"""SentencePiece encoding and decoding through a table of distinct marked words.

SentencePiece turns a space into the marker U+2581 and puts one before the text.
When no piece of the vocabulary has a marker behind another character, no merge
crosses the start of a marked word, so each word (a run of markers and what
follows up to the next marker) can be segmented alone. Of each batch of texts the
distinct words are looked up in the task's table; those it lacks are segmented
together, once, and ids and surfaces are joined back by position with Arrow's
take. The table is bounded in bytes; when it is full the words met most often
stay. That costs time, never results. A model that normalises, trims blanks,
lacks byte fallback or has crossing pieces is encoded text by text instead.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SENTENCEPIECE_MODEL, batches_of, load_sentencepiece, small_batches

MARK = "▁"


def crossing_pieces(processor) -> bool:
    """Whether some piece has a marker after another character."""
    return any(MARK in processor.id_to_piece(i).lstrip(MARK) for i in range(processor.get_piece_size()))


def splittable(processor) -> bool:
    """Whether marked words can be segmented alone: every character is kept as it is behind one dummy marker,
    blanks stay, what has no piece falls back to bytes, and no piece crosses into the next word."""
    every = "".join(chr(i) for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000)
    odd = ["  a  b  ", "é Å", "가", "\r\n\t　ﬁ①"]
    kept = all(processor.normalize(text) == (MARK + text).replace(" ", MARK) for text in (*odd, every))
    byte_pieces = sum(processor.is_byte(i) for i in range(processor.get_piece_size()))
    return kept and byte_pieces == 256 and processor.piece_to_id(MARK) != processor.unk_id() and not crossing_pieces(processor)


def surfaces(processor) -> pa.LargeBinaryArray:
    """What each id decodes to behind another, as bytes; a byte piece is its byte."""

    def of(i: int) -> bytes:
        piece = processor.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if processor.is_byte(i) else piece.replace(MARK, " ").encode()

    return pa.array([of(i) for i in range(processor.get_piece_size())], pa.large_binary())


class WordTable:
    """Ids of marked words in Arrow arrays of about `limit` bytes; when they are full the words met most often stay, in half of it."""

    def __init__(self, processor, limit: int):
        self.processor, self.limit = processor, limit
        self.words = pa.array([], pa.large_string())
        self.found = pa.array([], pa.large_list(pa.int32()))
        self.times = np.empty(0, np.int64)

    def ids(self, words: pa.LargeStringArray, times: np.ndarray) -> pa.LargeListArray:
        """For distinct words, each a run of blanks and what follows, that occur so many times."""
        at = pc.index_in(words, value_set=self.words)
        known = pc.is_valid(at).to_numpy(zero_copy_only=False)
        missing = words.filter(pa.array(~known))
        place = np.empty(len(words), np.int64)
        place[known] = at.drop_null().to_numpy()
        place[~known] = len(self.words) + np.arange(len(missing))
        if len(missing):
            self.words = pa.concat_arrays([self.words, missing])
            self.found = pa.concat_arrays([self.found, self._segmented(missing)])
            self.times = np.concatenate([self.times, np.zeros(len(missing), np.int64)])
        self.times[place] += times
        ids = self.found.take(pa.array(place))
        if self.words.nbytes + self.found.nbytes > self.limit:
            order = np.argsort(-self.times, kind="stable")
            taken = np.cumsum(16 + pc.binary_length(self.words).to_numpy()[order] + 4 * pc.list_value_length(self.found).to_numpy()[order])
            kept = order[: np.searchsorted(taken, self.limit // 2)]
            self.words, self.found, self.times = self.words.take(pa.array(kept)), self.found.take(pa.array(kept)), self.times[kept] // 2
        return ids

    def _segmented(self, words: pa.LargeStringArray) -> pa.LargeListArray:
        # The processor puts a marker of its own before each word. A marker alone would be an empty text, which gets no ids.
        made = self.processor.encode([w[1:] for w in words.to_pylist()], num_threads=1)
        lone = [self.processor.piece_to_id(MARK)]
        made = [ids or lone for ids in made]
        offsets = np.cumsum(np.fromiter(map(len, made), np.int64, len(made)))
        return pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], offsets])), pa.array(np.fromiter(chain.from_iterable(made), np.int32, int(offsets[-1]))))


def encode_by_words(texts: pa.StringArray, table: WordTable, surface: pa.LargeBinaryArray) -> tuple[pa.ListArray, pa.StringArray]:
    """(ids, decoded) of texts without nulls, through their marked words."""
    texts = pc.replace_substring(texts, MARK, " ")
    filled = pc.greater(pc.binary_length(texts), 0)
    # One blank for the dummy marker; an empty text gets none.
    marked = pc.if_else(filled, pc.binary_join_element_wise(" ", texts, ""), "").cast(pa.large_binary())
    bounds = np.frombuffer(marked.buffers()[1], np.int64)[marked.offset : marked.offset + len(marked) + 1]
    if bounds[-1] == bounds[0]:
        return pa.array([[]] * len(texts), pa.list_(pa.int32())), texts
    data = np.frombuffer(marked.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    blank = data == 0x20
    begins = blank.copy()
    begins[1:] &= ~blank[:-1]
    begins[bounds[:-1][np.diff(bounds) > 0]] = True
    starts = np.flatnonzero(begins)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)).dictionary_encode()
    of_word = words.indices.to_numpy()
    distinct = table.ids(words.dictionary, np.bincount(of_word))
    ids = distinct.take(words.indices).flatten()
    # Where each text's words, then its ids, then its decoded bytes start.
    word_bounds = np.searchsorted(starts, bounds)
    id_bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(distinct).to_numpy()[of_word])])[word_bounds]
    taken = surface.take(ids)
    byte_bounds = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1][id_bounds]
    decoded = np.frombuffer(taken.buffers()[2], np.uint8)
    # decode() takes the dummy marker off again.
    some = np.diff(byte_bounds) > 0
    decoded = np.delete(decoded[: byte_bounds[-1]], byte_bounds[:-1][some])
    text_bounds = byte_bounds - np.concatenate([[0], np.cumsum(some)])
    return (
        pa.ListArray.from_arrays(pa.array(id_bounds.astype(np.int32)), ids),
        pa.StringArray.from_buffers(len(texts), pa.py_buffer(text_bounds.astype(np.int32)), pa.py_buffer(decoded)),
    )


def encode_whole(texts: pa.StringArray, processor) -> tuple[pa.ListArray, pa.StringArray]:
    """(ids, decoded) of texts without nulls, each by the library."""
    ids = [processor.encode(text) if text else [] for text in texts.to_pylist()]
    return pa.array(ids, pa.list_(pa.int32())), pa.array([processor.decode(x) if x else "" for x in ids], pa.string())


def encode(docs: DataFrame, model: str = SENTENCEPIECE_MODEL, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = 48 << 20, batch_bytes: int = 8 << 20) -> DataFrame:
    """One row per row of `docs`: id, ids array<int>, decoded string.

    Equals the library's encode(text) without begin or end ids, and decode(ids).
    A null or empty text has no ids and decodes to the empty text. Repeated rows
    give repeated results; other columns are not read. An empty table gives none.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        processor = load_sentencepiece(model)
        table = WordTable(processor, table_bytes) if splittable(processor) else None
        surface = surfaces(processor)
        for batch in batches:
            for start, part in batches_of(batch.column(1), batch_bytes):
                texts = pc.fill_null(part, "")
                ids, decoded = encode_whole(texts, processor) if table is None else encode_by_words(texts, table, surface)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(part)), ids, decoded], names=[id_col, "ids", "decoded"])

    return small_batches(docs).select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded string")
