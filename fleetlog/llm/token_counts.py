"""Token counts of huge documents by overlap resynchronisation.

A long text is cut into chunks that overlap. Each chunk is encoded once and the
end of each token is kept as a byte offset of the text. In an overlap, a byte
position where both encodings end a token and where a marked word starts (a
space behind something that is not one) is a proven common boundary: no piece
has a marker behind another character, so what follows does not depend on what
stands before. The two encodings are spliced there. Where an overlap has no
such position it is doubled, and beyond the last splice the chunk itself is,
so a text without spaces ends up encoded whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SENTENCEPIECE_MODEL, batches_of, load_sentencepiece, small_batches
from .piece_table import MARK, splittable

SPACE = 0x20


def surface_bytes(processor) -> np.ndarray:
    """Bytes of text that each id stands for; a marker stands for one space."""
    return np.array([1 if processor.is_byte(i) else len(processor.id_to_piece(i).replace(MARK, " ").encode()) for i in range(processor.get_piece_size())], np.int64)


def spliced_count(processor, lengths: np.ndarray, text: str, chunk: int, overlap: int) -> int:
    """Number of ids of one text, in chunks of about `chunk` bytes."""
    data = text.replace(MARK, " ").encode()
    n = len(data)

    def character_start(at: int) -> int:
        while 0 < at < n and data[at] & 0xC0 == 0x80:
            at -= 1
        return at

    def ends(start: int, stop: int) -> np.ndarray:
        """Where the tokens of data[start:stop] end. The marker before the text stands for no byte of it, or for the space at `start` if that is left out."""
        own = data[start:stop].decode()
        return start - 1 + np.cumsum(lengths[np.asarray(processor.encode(own), np.int64)])

    start, stop, spliced, total = 0, character_start(min(n, chunk)), -1, 0
    left = ends(start, stop)
    while stop < n:
        wide, at = overlap, None
        while at is None and stop - wide > max(spliced, start):
            begin = character_start(stop - wide)
            end = character_start(min(n, begin + max(chunk, 2 * wide)))
            right = ends(begin, end)
            common = np.intersect1d(left, right)
            common = common[(common > max(begin + 1, spliced, 0)) & (common < stop)]
            proven = [int(x) for x in common if data[x] == SPACE and data[x - 1] != SPACE]
            at = proven[-1] if proven else None
            wide *= 2
        if at is None or end <= stop:
            stop = character_start(min(n, start + 2 * (stop - start)))
            left = ends(start, stop)
            continue
        total += int(np.count_nonzero((left > spliced) & (left <= at)))
        start, stop, spliced, left = begin, end, at, right
    return total + int(np.count_nonzero(left > spliced))


def count_tokens(docs: DataFrame, model: str = SENTENCEPIECE_MODEL, id_col: str = "doc_id", text_col: str = "text", chunk: int = 32_768, overlap: int = 512, batch_bytes: int = 8 << 20) -> DataFrame:
    """One row per row of `docs`: id, n_bytes long (UTF-8), n_tokens long.

    Equals len(encode(text)) of the library. A null or empty text has 0 bytes
    and 0 tokens. Texts of up to `chunk` bytes are encoded whole; longer ones in
    overlapping chunks, if the model keeps characters and blanks as they are and
    no piece crosses into a word; with other models all are encoded whole. Repeated rows give repeated results; other columns are
    not read. An empty table gives none.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        processor = load_sentencepiece(model)
        lengths = surface_bytes(processor)
        whole = not splittable(processor)
        for batch in batches:
            for start, part in batches_of(batch.column(1), batch_bytes):
                sizes = pc.fill_null(pc.binary_length(part), 0).cast(pa.int64())
                counts = [0 if not text else len(processor.encode(text)) if whole or size <= chunk else spliced_count(processor, lengths, text, chunk, overlap) for text, size in zip(part.to_pylist(), sizes.to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(part)), sizes, pa.array(counts, pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    return small_batches(docs).select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long")
