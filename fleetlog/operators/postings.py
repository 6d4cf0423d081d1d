"""A kept index of trigram postings, in layers of sorted blocks.

A layer has blocks (trigram, field, ids) of at most BLOCK_IDS ascending ids, range-partitioned
and sorted by trigram, in small row groups, so that a search reads the row groups of its
trigrams only. Texts are taken apart and grouped by trigram some MB at a time, where they are
read; what is dealt out by ranges are these groups, written first as runs, so that neither the
texts nor their trigrams are gone through again for the ranges. Changed documents are a new layer
on top; when there are too many, the newest are merged. Hits are always checked against the
texts, so postings of what a document once said do no harm until then.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.kept import children, exists, remove
from .search import FIELDS, LOWER, UPPER, fold_text, phrase_search

# Its helpers go to the tasks with the code, as the tasks may not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_IDS = 1024
ROW_GROUP_BYTES = 1 << 20
#: So many bytes of texts, or one text, are taken apart at a time.
CHUNK_BYTES = 1 << 22
#: Parquet prunes by lists of up to ten values; a search looks up no more trigrams than this, spread over the query.
MOST_GRAMS = 8
#: So few ids are put into the filter of the texts' scan; more are joined.
FEW_IDS = 1000
#: So few changed ids are broadcast, so that the texts or postings joined with them stay where they are.
BROADCAST_IDS = 1_000_000
BLOCKS = "trigram string, field string, first_id long, last_id long, ids array<long>"
ORDER = ("trigram", "field", "first_id")


def _cuts(heads, n: int, most: int):
    """Where groups that start at `heads`, of n values in all, are cut into pieces of at most so many; the group of each piece."""
    sizes = np.diff(np.append(heads, n))
    pieces = -(-sizes // most)
    group = np.repeat(np.arange(len(heads)), pieces)
    return heads[group] + most * (np.arange(len(group)) - (np.cumsum(pieces) - pieces)[group]), group


def _block_batch(grams, fields, ids, starts):
    """Blocks of the ids from each start to the next."""
    import pyarrow as pa

    stops = np.append(starts[1:], len(ids))
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(ids)), pa.int32()), ids)
    return pa.RecordBatch.from_arrays([grams, fields, ids.take(pa.array(starts)), ids.take(pa.array(stops - 1)), lists], names=["trigram", "field", "first_id", "last_id", "ids"])


def _points(texts):
    """The code points of some texts, one after the other, and the number of each."""
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = texts.fill_null("").cast(pa.large_string())
    ends, data = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1], texts.buffers()[2]
    raw = memoryview(data or b"")[ends[0] : ends[-1]]
    try:
        whole, sizes = str(raw, "utf-8"), pc.utf8_length(texts).to_numpy()
    except UnicodeDecodeError:
        parts = [str(raw[a:b], "utf-8", "replace") for a, b in zip(ends[:-1] - ends[0], ends[1:] - ends[0])]
        whole, sizes = "".join(parts), np.array([len(p) for p in parts])
    return np.frombuffer(whole.encode("utf-32-le"), np.uint32), sizes


def _utf8(points):
    """Strings of the rows of an array of code points."""
    import pyarrow as pa

    sizes = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    ends = np.concatenate([[0], np.cumsum(sizes.sum(axis=1))]).astype(np.int32)
    return pa.StringArray.from_buffers(len(points), pa.py_buffer(ends), pa.py_buffer(points.astype("<u4").tobytes().decode("utf-32-le").encode()))


def _grams(texts, ids, field: str, block_ids: int):
    """Blocks of the trigrams of some texts. A trigram and its text are one number, by the places of the code points among those that occur; so one sort of numbers does it."""
    import pyarrow as pa
    import pyarrow.compute as pc

    points, sizes = _points(texts)
    points = np.where(points - ord(UPPER[0]) < len(UPPER), points + (ord(LOWER[0]) - ord(UPPER[0])), points)
    place = np.zeros(0x110000, np.int64)
    place[points] = 1
    letters = np.flatnonzero(place).astype(np.uint32)
    place[letters] = np.arange(len(letters))
    wide, deep = max(len(letters) - 1, 1).bit_length(), (len(texts) - 1).bit_length()
    if 3 * wide + deep > 63:
        half = len(texts) // 2
        for a, b in ((0, half), (half, len(texts))):
            yield from _grams(texts[a:b], ids[a:b], field, block_ids)
        return
    order = pc.sort_indices(ids, null_placement="at_start").to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    owner, at = np.repeat(rank, sizes), place[points]
    keys = ((((at[:-2] << wide | at[1:-1]) << wide) | at[2:]) << deep) | owner[2:]
    keys = keys[owner[2:] == owner[:-2]]
    if not len(keys):
        return
    keys.sort()
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    grams = keys >> deep
    starts, _ = _cuts(np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])), len(keys), block_ids)
    first, low = grams[starts], (1 << wide) - 1
    strings = _utf8(letters[np.stack([first >> 2 * wide, first >> wide & low, first & low], axis=1)])
    yield _block_batch(strings, pa.repeat(field, len(starts)), ids.take(pa.array(order)).take(pa.array(keys & (1 << deep) - 1)), starts)


def grouped_texts(docs: DataFrame, fields: tuple[str, ...] = FIELDS, block_ids: int = BLOCK_IDS) -> DataFrame:
    """trigram_postings() of documents as blocks, each of one chunk of texts, in no order."""

    def run(batches):
        for batch in batches:
            for f in fields:
                texts = batch.column(f)
                chunk = np.cumsum(np.concatenate([[0], _sizes(texts)])) // CHUNK_BYTES
                ends = [0, *(np.flatnonzero(np.diff(chunk[:-1])) + 1), batch.num_rows]
                for a, b in zip(ends, ends[1:]):
                    if b > a:
                        yield from _grams(texts[a:b], batch.column("id")[a:b], f, block_ids)

    return docs.select(F.col("id").cast("long").alias("id"), *[F.col(f).cast("string").alias(f) for f in fields]).mapInArrow(run, BLOCKS)


def grouped_postings(postings: DataFrame, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Postings (trigram, id, field) as blocks, each of one batch of rows, in no order."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            grams, fields, ids = (batch.column(c) for c in ("trigram", "field", "id"))
            own, other = grams.dictionary_encode().indices.to_numpy(), fields.dictionary_encode().indices.to_numpy()
            order = np.lexsort((_numbers(ids), other, own))
            own, other = own[order], other[order]
            starts, _ = _cuts(np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (other[1:] != other[:-1])])), len(ids), block_ids)
            heads = pa.array(order[starts])
            yield _block_batch(grams.take(heads), fields.take(heads), ids.take(pa.array(order)), starts)

    return postings.select("trigram", "field", F.col("id").cast("long").alias("id")).mapInArrow(run, BLOCKS)


def _sizes(texts):
    """Bytes of each text."""
    import pyarrow.compute as pc

    return pc.binary_length(texts).fill_null(0).to_numpy()


def _numbers(ids):
    """Ids to sort by, null first."""
    return ids.fill_null(np.iinfo(np.int64).min).to_numpy()


def merged_blocks(blocks: DataFrame, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Blocks put together to such of at most so many ids, in order. A trigram of many documents lies in several partitions."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            if not batch.num_rows:
                continue
            grams, fields, lists = (batch.column(c) for c in ("trigram", "field", "ids"))
            own, other = grams.dictionary_encode().indices.to_numpy(), fields.dictionary_encode().indices.to_numpy()
            rows = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (other[1:] != other[:-1])]))
            ids, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy()
            heads = (np.cumsum(sizes) - sizes)[rows]
            numbers = _numbers(ids)
            if not np.isin(np.flatnonzero(numbers[1:] < numbers[:-1]) + 1, heads).all():
                ids = ids.take(pa.array(np.lexsort((numbers, np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(ids))))))))
            starts, group = _cuts(heads, len(ids), block_ids)
            at = pa.array(rows[group])
            yield _block_batch(grams.take(at), fields.take(at), ids, starts)

    return blocks.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).mapInArrow(run, BLOCKS)


def blocks_of(postings: DataFrame, block_ids: int = BLOCK_IDS) -> DataFrame:
    """(trigram, field, first_id, last_id, ids) from postings (trigram, id, field), in order."""
    return merged_blocks(grouped_postings(postings, block_ids), block_ids)


def grams_of(q: str, most: int = MOST_GRAMS) -> list[str]:
    """Trigrams of a folded query, at most so many, evenly spread."""
    q = fold_text(q.strip())
    grams = sorted({q[i : i + 3] for i in range(len(q) - 2)}, key=q.index)
    return grams if len(grams) <= most else [grams[round(k * (len(grams) - 1) / (most - 1))] for k in range(most)]


class PostingIndex:
    """Postings of documents (id and `fields`) below a folder of its own."""

    def __init__(self, spark: SparkSession, folder: str, fields: tuple[str, ...] = FIELDS, most_layers: int = 8):
        self.spark, self.folder, self.fields, self.most_layers = spark, folder.rstrip("/"), fields, most_layers

    def _layers(self) -> list[tuple[int, str]]:
        """(number, name) of the whole layers, without those that a merged one holds: base=n all up to n, layer=a-b those from a to b."""
        found = []
        for name in children(self.spark, self.folder):
            if name.startswith(("base=", "layer=")) and exists(self.spark, f"{self.folder}/{name}/blocks/_SUCCESS"):
                kind, span = name.split("=")
                first, _, last = span.rpartition("-")
                found.append((int(last), 0 if kind == "base" else int(first or last), name))
        return sorted((n, name) for n, a, name in found if not any(b <= a and n <= m and (b, m) != (a, n) for m, b, _ in found))

    def _changed(self, *names: str) -> DataFrame:
        return self.spark.read.schema("id long").parquet(*[f"{self.folder}/{n}/changed" for n in names])

    def _note(self, name: str, changed: DataFrame) -> DataFrame:
        """Writes the ids of a layer; as they were written."""
        changed.select(F.col("id").cast("long").alias("id")).distinct().write.mode("overwrite").parquet(f"{self.folder}/{name}/changed")
        return self._changed(name)

    def _write(self, name: str, groups: DataFrame) -> None:
        """Writes the blocks of a layer. Ascending ids take a byte or two as differences, which version 2 of Parquet's pages has."""
        runs = f"{self.folder}/{name}/runs"
        small = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary#ids.list.element": "false"}
        groups.write.mode("overwrite").options(**small).parquet(runs)
        merged = merged_blocks(self.spark.read.schema(BLOCKS).parquet(runs))
        merged.write.mode("overwrite").options(**small).option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.size", ROW_GROUP_BYTES // 8).parquet(f"{self.folder}/{name}/blocks")
        remove(self.spark, runs)

    def build(self, docs: DataFrame) -> None:
        """A first layer of all documents, in place of any there was."""
        name = f"base={max((k for k, _ in self._layers()), default=0) + 1}"
        self._note(name, docs)
        self._write(name, grouped_texts(docs, self.fields))

    def refresh(self, docs: DataFrame, changed: DataFrame) -> None:
        """A layer of the documents in `changed` (id), as they are in `docs` now; one that isn't there any more is only taken out. Layers are merged when there are too many."""
        name = f"layer={max((k for k, _ in self._layers()), default=0) + 1}"
        ids = self._note(name, changed)
        self._write(name, grouped_texts(docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi"), self.fields))
        layers = self._layers()
        if len(layers) > self.most_layers:
            # So many as must be, and older ones while those together have half as many documents: what is written again stays in proportion to the changes.
            sizes = [self._changed(n).count() for _, n in layers]
            k = self.most_layers - 1
            while k and 2 * sum(sizes[k:]) >= sizes[k - 1]:
                k -= 1
            self._merge(layers, k)

    def blocks(self) -> DataFrame:
        """The blocks of all layers, with the number of their layer."""
        out = None
        for k, name in self._layers():
            rows = self.spark.read.schema(BLOCKS).parquet(f"{self.folder}/{name}/blocks").withColumn("layer", F.lit(k))
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            raise ValueError(f"no index in {self.folder}")
        return out

    def _rows(self, layers: list[tuple[int, str]], whole, cleaned) -> DataFrame:
        """The rows of some layers together: whole(blocks) of a layer of which no document is in a newer one, cleaned(postings) without those that are."""
        rows = None
        for i, (_, name) in enumerate(layers):
            own, newer, n = self.spark.read.schema(BLOCKS).parquet(f"{self.folder}/{name}/blocks"), [n for _, n in layers[i + 1 :]], 0
            if newer:
                stale = self._changed(name).join(self._changed(*newer), "id", "left_semi")
                n = stale.count()
            if n:
                own = cleaned(own.select("trigram", F.explode("ids").alias("id"), "field").join(F.broadcast(stale) if n <= BROADCAST_IDS else stale, "id", "left_anti").select("trigram", "id", "field"))
            else:
                own = whole(own)
            rows = own if rows is None else rows.unionByName(own)
        return rows

    def postings(self) -> DataFrame:
        """(trigram, id, field) as the documents are now: of each document the postings of the last layer that has it."""
        return self._rows(self._layers(), lambda blocks: blocks.select("trigram", F.explode("ids").alias("id"), "field"), lambda rows: rows)

    def compact(self) -> None:
        """Merges all layers into one, then deletes them."""
        layers = self._layers()
        if len(layers) > 1:
            self._merge(layers, 0)

    def _merge(self, layers: list[tuple[int, str]], k: int) -> None:
        """Merges the layers from the k-th on into one, then deletes them."""
        old = layers[k:]
        first, last = old[0][1].split("=")[1].split("-")[0], old[-1][0]
        name = f"layer={first}-{last}" if k else f"base={last}"
        self._note(name, self._changed(*[n for _, n in old]))
        self._write(name, self._rows(old, lambda blocks: blocks, grouped_postings))
        for _, n in old:
            remove(self.spark, f"{self.folder}/{n}")

    def candidates(self, q: str) -> DataFrame:
        """Ids that have all looked-up trigrams of the query in one field, in whatever layers: a superset of the phrase's hits."""
        grams = grams_of(q)
        if not grams:
            raise ValueError("a query of three characters or more")
        hits = self.blocks().where(F.col("trigram").isin(grams)).select("trigram", "field", F.explode("ids").alias("id"))
        mark = sum((F.when(F.col("trigram") == g, 1 << i).otherwise(0) for i, g in enumerate(grams)), F.lit(0))
        return hits.groupBy("id", "field").agg(F.bit_or(mark).alias("have")).where(F.col("have") == (1 << len(grams)) - 1).select("id").distinct()

    def search(self, docs: DataFrame, q: str) -> DataFrame:
        """As phrase_search(), of the documents that the postings leave; queries under three characters scan.

        Few ids become a filter of the texts' scan, which prunes its row groups where they are laid out by id.
        """
        if len(q.strip()) < 3:
            return phrase_search(docs, q)
        found = self.candidates(q)
        few = [r.id for r in found.limit(FEW_IDS + 1).collect()]
        if len(few) <= FEW_IDS:
            return phrase_search(docs.where(F.col("id").isin(few)) if few else docs.where("false"), q)
        return phrase_search(docs.join(found, "id", "left_semi"), q)
