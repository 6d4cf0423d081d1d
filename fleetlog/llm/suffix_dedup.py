"""Suffix-array removal of long byte strings that an earlier document has too.

A difference cover samples positions so that two equal strings have a sample at
the same offset. Fixed residues would put two thirds of all bytes through each
sort. So the work is first narrowed by a content-defined sample, exactly:

1. Every string of `length` bytes has a least gram of GRAM bytes (by a hash);
   equal strings have it at the same offset. Only these grams, one in about 17
   bytes, are shuffled, by hash. A gram that only one text has starts nothing
   to remove. Copies of one text count as one, since they are removed whole.
2. For the rest, the bytes around the gram that strings of `length` with it can
   reach are shuffled by the same hash, so equal strings meet in one bucket. What equals
   an earlier document's in the same block is settled before. Around a gram that very
   many texts have, each string goes to a bucket of its own hash instead.
3. There a difference-cover sort orders the suffixes of the distinct surroundings:
   sampled triples are named in order, the names are sorted recursively until a
   name stands for at least `length` bytes, the remaining suffixes are merged in,
   and adjacent suffixes are compared by prefix. The smallest document of each
   run of equal prefixes keeps its bytes. Surroundings that all instances of a
   gram share need no sort.
4. The covered intervals go back to their rows. A row is known by its id and, among
   different texts with that id, by the number of its text in their order.

Rows carry arrays of a block of documents or a bucket of hashes, so Spark deals
out, sorts and retries the work, and a task holds one of them at a time.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches_of, cut, small_batches
from .common import packed as as_struct

GRAM = 16
BUCKET_BYTES = 8 << 20
BLOCK_BYTES = 1 << 20
SORT_BYTES = 400_000
SALTS = 64


def sliding(values: np.ndarray, width: int, op) -> np.ndarray:
    """op over each run of `width` values."""
    done = 1
    while 2 * done <= width:
        values = op(values[:-done], values[done:])
        done *= 2
    return op(values[: len(values) - (width - done)], values[width - done :]) if done < width else values


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position, never 0."""
    eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)).view("<u8").ravel()
    return _gram_hash(eight[:-8], eight[8:])


def _gram_hash(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    mixed = low * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(32))) + high
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    return (mixed ^ (mixed >> np.uint64(32))) | np.uint64(1)


def least_grams(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the least gram of every string of `length` bytes inside one text; `bounds` are where texts start, and the end."""
    if len(data) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    width = length - GRAM + 1
    hashes = gram_hashes(data)
    least = sliding(hashes, width, np.minimum)
    inside = np.zeros(len(least), bool)
    for a, b in zip(bounds[:-1], bounds[1:]):
        inside[a : max(a, b - length + 1)] = True
    least[~inside] = 0
    pad = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero((sliding(np.concatenate([pad, least, pad]), width, np.maximum) == hashes) & (hashes > 0))
    return at, hashes[at]


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal values start, and the end."""
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]) if len(keys) else np.zeros(1, np.int64)


def _dense(values: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the values in order, from 1, and their number."""
    top = int(values.max(initial=0))
    if top < 1 << 22:
        names = np.cumsum(np.bincount(values, minlength=top + 1) > 0)
        return names[values], int(names[-1])
    order = np.argsort(values)
    ordered = values[order]
    fresh = np.concatenate([[1], (ordered[1:] != ordered[:-1]).astype(np.int64)]).cumsum()
    names = np.empty(len(values), np.int64)
    names[order] = fresh
    return names, int(fresh[-1])


def _packed(parts: list[np.ndarray], bits: list[int]) -> np.ndarray:
    """One sortable number for each tuple; tuples too wide for 63 bits are named from the right first."""
    key, used = parts[-1], bits[-1]
    for part, wide in zip(parts[-2::-1], bits[-2::-1]):
        if used + wide > 63:
            key, n = _dense(key)
            used = n.bit_length()
        key, used = (part << used) | key, used + wide
    return key


def suffix_ranks(text: np.ndarray, span: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Ranks of the suffixes at `wanted` positions (all) in the order of at least their first `span` symbols.

    Symbols are from 1, 0 pads. The suffixes at positions that 3 doesn't divide
    are the difference-cover sample: their triples are named, and unless a name
    stands for `span` symbols or names are unique, the string of names is ranked
    in the same way. The others follow from a symbol and the rank behind it.
    """
    given = len(text)
    # One pad more where the names of the two kinds of sample would run into each other.
    n = given + (given % 3 == 1)
    text = np.concatenate([text, np.zeros(n - given + 3, np.int64)])
    wide = int(text.max()).bit_length()
    one, two = np.arange(1, n, 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    names, many = _dense(_packed([text[sample], text[sample + 1], text[sample + 2]], [wide] * 3))
    if span > 3 and many < len(sample):
        # A name of the next level stands for three of these.
        names = suffix_ranks(names, -(-span // 3)) + 1
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = names
    rank_bits = int(rank.max()).bit_length()
    if wanted is None:
        zero = np.arange(0, n, 3)
    else:
        zero, one, two = (wanted[wanted % 3 == k] for k in range(3))
    behind_one = lambda at: _pair(text[at], rank[at + 1], rank_bits)
    two_symbols = _symbol_pairs(text, wide, rank_bits)
    behind_two = lambda at: _pair(two_symbols[at], rank[at + 2], rank_bits)
    zero_by_one, zero_by_two = behind_one(zero), behind_two(zero)
    one_key, two_key = behind_one(one), behind_two(two)
    one_order, two_order = np.argsort(rank[one]), np.argsort(rank[two])
    zero_order = np.argsort(zero_by_one)
    place = np.zeros(n, np.int64)
    # Each suffix comes after its own kind and what the other two kinds have below it.
    place[zero[zero_order]] = np.arange(len(zero))
    place[zero] += np.searchsorted(one_key[one_order], zero_by_one) + np.searchsorted(two_key[two_order], zero_by_two)
    place[one] = np.searchsorted(zero_by_one[zero_order], one_key)
    place[two] = np.searchsorted(np.sort(zero_by_two), two_key)
    both = np.concatenate([one, two])
    among = np.empty(len(both), np.int64)
    among[np.argsort(rank[both])] = np.arange(len(both))
    place[both] += among
    at = np.arange(given) if wanted is None else wanted
    out = np.empty(len(at), np.int64)
    out[np.argsort(place[at])] = np.arange(len(at))
    return out


def _pair(symbol: np.ndarray, rank: np.ndarray, bits: int) -> np.ndarray:
    return (symbol << bits) | rank


def _symbol_pairs(text: np.ndarray, wide: int, bits: int) -> np.ndarray:
    """A number for each symbol and the next that leaves `bits` bits free; pairs too wide for that are named first."""
    pairs = (text[:-1] << wide) | text[1:]
    return pairs if 2 * wide + bits <= 63 else _dense(pairs)[0]


def earliest(rows: np.ndarray, starts: np.ndarray, stops: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
    """For surroundings (rows of bytes, filled from start to stop) with their smallest document, and each string of
    `length` in them by its column: the smallest document of all that have the string."""
    n, width = rows.shape
    columns = np.arange(width)
    filled = (columns >= starts[:, None]) & (columns < stops[:, None])
    names = np.cumsum(np.bincount(rows[filled], minlength=256) > 0)
    text = np.zeros((n, width + 1), np.int64)
    text[:, :width][filled] = names[rows[filled]]
    row, column = np.nonzero((columns >= starts[:, None]) & (columns + length <= stops[:, None]))
    # Unfilled ends are left out of the text; one pad stays between two surroundings.
    used = np.concatenate([filled, np.ones((n, 1), bool)], axis=1).ravel()
    place = np.cumsum(used) - 1
    text = text.ravel()[used]
    wanted = place[row * (width + 1) + column]
    order = np.argsort(suffix_ranks(text, length, wanted))
    sorted_at = wanted[order]
    fresh = np.ones(len(order), bool)
    small = text.astype(np.uint8)
    for low in range(1, len(order), 1 << 17):
        at = sorted_at[low - 1 : low + (1 << 17)]
        prefixes = small[at[:, None] + np.arange(length)[None, :]]
        fresh[low : low + len(at) - 1] = (prefixes[1:] != prefixes[:-1]).any(1)
    out = np.full((n, width), np.iinfo(np.int64).max)
    if len(order):
        least = np.minimum.reduceat(first[row[order]], np.flatnonzero(fresh))
        out[row[order], column[order]] = least[np.cumsum(fresh) - 1]
    return out


def earliest_bounded(rows: np.ndarray, starts: np.ndarray, stops: np.ndarray, first: np.ndarray, length: int, low: int, high: int) -> np.ndarray:
    """As earliest(), for the strings from columns `low` to `high`, which all rows' strings have in common a piece of; no sort takes over about SORT_BYTES.

    Strings from columns low to high all cover the bytes from high to low + length. So a sort that is too large falls apart
    into those of the rows that agree in these bytes, after halving the columns as often as it takes; of a single column
    the strings themselves are compared.
    """
    n, width = rows.shape
    out = np.full((n, width), np.iinfo(np.int64).max)
    starts, stops = np.maximum(starts, low), np.minimum(stops, high + length)
    if n == 1 or (stops - starts + 1).sum() <= SORT_BYTES:
        return earliest(rows, starts, stops, first, length)
    halves = [(low, high)] if low == high else [(low, (low + high) // 2), ((low + high) // 2 + 1, high)]
    for a, b in halves:
        own = np.flatnonzero((starts <= b) & (stops >= a + length) & (np.minimum(stops, b + length) - np.maximum(starts, a) >= length))
        if not len(own):
            continue
        core = np.ascontiguousarray(rows[own, b : a + length])
        words = np.zeros((len(own), -(-core.shape[1] // 8) * 8), np.uint8)
        words[:, : core.shape[1]] = core
        order = np.lexsort(words.view("<u8").T)
        own, ordered = own[order], words[order]
        bounds = np.concatenate([[0], np.flatnonzero((ordered[1:] != ordered[:-1]).any(1)) + 1, [len(own)]])
        if a == b:
            least = np.minimum.reduceat(first[own], bounds[:-1])
            out[own, a] = np.repeat(least, np.diff(bounds))
            continue
        # Whole groups of rows with the same piece, up to about SORT_BYTES; one that is larger is divided on.
        weight = np.cumsum(np.minimum(stops[own], b + length) - np.maximum(starts[own], a) + 1)
        at = 0
        while at < len(bounds) - 1:
            done = weight[bounds[at] - 1] if bounds[at] else 0
            upto = max(at + 1, int(np.searchsorted(weight[bounds[1:] - 1], done + SORT_BYTES, side="right")))
            pick = own[bounds[at] : bounds[upto]]
            out[pick, a : b + 1] = earliest_bounded(rows[pick], starts[pick], stops[pick], first[pick], length, a, b)[:, a : b + 1]
            at = upto
    return out


def shared_extent(group: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """How many leading bytes each row has in common with some other row of its group, at most; rows of a group stay together."""
    n, width = parts.shape
    words = np.zeros((n, -(-width // 8) * 8), np.uint8)
    words[:, :width] = parts
    order = np.lexsort([*words.view(">u8").T[::-1], group])
    alike = np.zeros(n + 1, np.int64)
    same = parts[order[1:]] == parts[order[:-1]]
    common = np.where(same.all(1), width, np.argmin(same, axis=1))
    alike[1:n] = np.where(group[order[1:]] == group[order[:-1]], common, 0)
    out = np.empty(n, np.int64)
    out[order] = np.maximum(alike[:-1], alike[1:])
    return out


def distinct_rows(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, fresh): an order that puts equal rows together and keeps the first column ascending, and where a row differs from the one before."""
    n, widths = len(columns[0]), [c.shape[1] if c.dtype == np.uint8 else 8 for c in columns]
    words = np.zeros((n, -(-sum(widths) // 8) * 8), np.uint8)
    for c, wide, at in zip(columns, widths, np.cumsum([0, *widths])):
        words[:, at : at + wide] = c if c.dtype == np.uint8 else c.astype(">i8").view(np.uint8).reshape(n, 8)
    words = words.view("<u8")
    mixed = np.zeros(n, np.uint64)
    for k in range(words.shape[1]):
        mixed = (mixed ^ words[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(31)
    order = np.lexsort((mixed, columns[0]))
    # Rows are told apart by their bytes; two that only share the mixed value would at worst stay apart.
    fresh = np.ones(n, bool)
    for low in range(1, n, 1 << 15):
        some = slice(low, low + (1 << 15))
        fresh[some] = (words[order[some]] != words[order[low - 1 : low - 1 + len(order[some])]]).any(1)
    return order, fresh


def _two_bytes(numbers: np.ndarray) -> np.ndarray:
    return numbers.astype(">u2").view(np.uint8).reshape(-1, 2)


def _lists(columns: dict[str, np.ndarray], bounds: np.ndarray) -> list[pa.Array]:
    offsets = pa.array(bounds.astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in columns.values()]


def _flat(table, name: str) -> np.ndarray:
    return np.concatenate([np.asarray(c.flatten()) for c in table.column(name).chunks]) if table.num_rows else np.empty(0, np.int64)


def grams_of(docs: DataFrame, buckets: int, length: int, hot: int) -> DataFrame:
    """Packed least grams: (via, bucket, ids, texts, counts, hashes, places) for a part of a task and a bucket.

    The lower half of the hash is enough beside the bucket: grams that agree in both are only candidates.
    Rows go to the group `via`, their bucket. A gram that `hot` different texts of a part have is shared as it is: one
    of them tells its bucket so, by a place below 0, and the others go by it, dealt to groups below 0 by parts.
    """

    def packed(via, hashes, places, bucket, own, ids, texts):
        order = np.argsort(bucket, kind="stable")
        own, places, hashes, bucket = own[order], places[order], hashes[order], bucket[order]
        # Within a bucket the order of documents is kept, so each has one run.
        pair = _runs(bucket.astype(np.int64) * len(ids) + own)
        of_pair = bucket[pair[:-1]]
        outer, inner = _runs(bucket), _runs(of_pair)
        docs_of = own[pair[:-1]]
        named = bucket[outer[:-1]].astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(named if via is None else np.full(len(named), via, np.int32)), pa.array(named), *_lists({"i": ids[docs_of], "t": texts[docs_of], "c": np.diff(pair).astype(np.int32)}, inner), *_lists({"h": hashes.astype(np.uint32).view(np.int32), "p": places}, outer)],
            names=["via", "bucket", "ids", "texts", "counts", "hashes", "places"],
        )

    def run(batches):
        for batch in batches:
            for start, part in batches_of(batch.column("text"), 4 << 20):
                ids = batch.column("id").slice(start, len(part)).to_numpy()
                own, places, hashes = [], [], []
                # Of the copies of a text here only the first document speaks for it.
                texts = np.array([np.frombuffer(hashlib.blake2b(t.as_buffer(), digest_size=8).digest(), np.int64)[0] for t in part], np.int64)
                order = np.lexsort((ids, texts))
                order = np.sort(order[np.concatenate([[True], texts[order[1:]] != texts[order[:-1]]])])
                ids, texts, part = ids[order], texts[order], part.take(pa.array(order))
                for low, few in batches_of(part, 128 << 10):
                    held = [t.as_buffer() for t in few]
                    bounds = np.cumsum([0, *map(len, held)])
                    at, found = least_grams(np.frombuffer(b"".join(held), np.uint8), bounds, length)
                    doc = np.searchsorted(bounds, at, side="right") - 1
                    own.append(doc + low)
                    places.append((at - bounds[doc]).astype(np.int32))
                    hashes.append(found)
                own, places, hashes = np.concatenate(own), np.concatenate(places), np.concatenate(hashes)
                bucket = (hashes >> np.uint64(32)) % np.uint64(buckets)
                by_hash = np.lexsort((own, hashes))
                heads = np.concatenate([[True], (hashes[by_hash[1:]] != hashes[by_hash[:-1]]) | (own[by_hash[1:]] != own[by_hash[:-1]])]) if len(by_hash) else np.zeros(0, bool)
                runs = _runs(hashes[by_hash])
                many = np.add.reduceat(heads.astype(np.int64), runs[:-1]) >= hot if len(by_hash) else np.zeros(0, bool)
                aside = np.zeros(len(hashes), bool)
                aside[by_hash[np.repeat(many, np.diff(runs))]] = True
                tell = by_hash[runs[:-1][many]]
                aside[tell] = False
                places[tell] = -1 - places[tell]
                for via, pick in ((None, ~aside), (-1 - int(texts.view(np.uint64)[0] % np.uint64(buckets)) if len(texts) else None, aside)):
                    if pick.any():
                        yield packed(via, hashes[pick], places[pick], bucket[pick], own[pick], ids, texts)

    return docs.mapInArrow(run, "via int, bucket int, ids array<long>, texts array<long>, counts array<int>, hashes array<int>, places array<int>")


def shared_grams(grams: DataFrame, blocks: int, hot_total: int) -> DataFrame:
    """(block, hot, ids, places, hashes) of the grams that two different texts have, for the first document of each text in a group.

    Hot grams are those that a part of a task found hot, and those that more than `hot_total` texts of a bucket have.
    """

    def run(key, table):
        counts = _flat(table, "counts")
        ids, texts = np.repeat(_flat(table, "ids"), counts), np.repeat(_flat(table, "texts"), counts)
        each = np.asarray(table.column("hashes").combine_chunks().value_lengths())
        buckets = np.repeat(table.column("bucket").to_numpy().astype(np.int64), each)
        hashes, places = (buckets << 32) | (_flat(table, "hashes").astype(np.int64) & 0xFFFFFFFF), _flat(table, "places")
        told = places < 0
        places = np.where(told, -1 - places, places)
        order = np.lexsort((ids, texts, hashes))
        ids, texts, hashes, places, told = ids[order], texts[order], hashes[order], places[order], told[order]
        same = (hashes[1:] == hashes[:-1]) & (texts[1:] == texts[:-1])
        by_text = np.concatenate([[0], np.flatnonzero(~same) + 1, [len(ids)]]) if len(ids) else np.zeros(1, np.int64)
        by_hash = _runs(hashes)
        sizes = np.diff(by_hash)
        several = np.repeat(texts[by_hash[:-1]] != texts[by_hash[1:] - 1], sizes)
        if key[0].as_py() < 0:
            hot = np.ones(len(ids), bool)
        else:
            distinct = np.diff(np.searchsorted(by_text, by_hash))
            hot = np.repeat(np.logical_or.reduceat(told, by_hash[:-1]) | (distinct > hot_total), sizes) if len(ids) else told
        keep = (several | hot) & (ids == np.repeat(ids[by_text[:-1]], np.diff(by_text)))
        parts = [_by_block({"ids": ids[k], "places": places[k], "hashes": hashes[k]}, blocks, hot=flag) for flag, k in ((False, keep & ~hot), (True, keep & hot))]
        return pa.concat_tables(parts)

    return grams.groupBy("via").applyInArrow(run, "block int, hot boolean, ids array<long>, places array<int>, hashes array<long>")


def _by_block(columns: dict[str, np.ndarray], blocks: int, **same) -> pa.Table:
    block = columns["ids"] % blocks
    order = np.argsort(block, kind="stable")
    bounds = _runs(block[order])
    fixed = [pa.array([v] * (len(bounds) - 1), pa.bool_()) for v in same.values()]
    return pa.Table.from_arrays([pa.array(block[order][bounds[:-1]].astype(np.int32)), *fixed, *_lists({k: v[order] for k, v in columns.items()}, bounds)], names=["block", *same, *columns])


def string_hashes(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hash of the `length` bytes from each position of `at`."""
    out = np.empty(len(at), np.uint64)
    step = max(1, (8 << 20) // length)
    for low in range(0, len(at), step):
        words = np.zeros((len(at[low : low + step]), -(-length // 8) * 8), np.uint8)
        words[:, :length] = data[at[low : low + step, None] + np.arange(length)]
        mixed = np.zeros(len(words), np.uint64)
        for word in words.view("<u8").T:
            mixed = (mixed ^ word) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(31)
        out[low : low + step] = mixed
    return out


def whole_strings(data: np.ndarray, starts: np.ndarray, ids: np.ndarray, doc: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray, length: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, hashes, later) of each string of `length` bytes that reaches over a hot gram; later ones have an equal string in an earlier document of the block."""
    reach = length - GRAM
    offsets = np.arange(-reach, 1)
    fits = (offsets >= -left[:, None]) & (offsets + length <= right[:, None])
    at = np.unique((at[:, None] + offsets)[fits])
    ids = ids[np.searchsorted(starts, at, side="right") - 1]
    mixed = string_hashes(data, at, length)
    order = np.lexsort((ids, mixed))
    at, ids, mixed = at[order], ids[order], mixed[order]
    fresh = np.ones(len(at), bool)
    alike = np.flatnonzero(mixed[1:] == mixed[:-1])
    for low in range(0, len(alike), 1 << 17):
        some = alike[low : low + (1 << 17)]
        fresh[some + 1] = (data[at[some, None] + np.arange(length)] != data[at[some + 1, None] + np.arange(length)]).any(1)
    first = ids[np.flatnonzero(fresh)][np.cumsum(fresh) - 1] if len(at) else ids
    bucket = ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    return at, (bucket << 32) | (mixed & np.uint64(0xFFFFFFFF)).astype(np.int64), ids > first


def tags_of(ids: list, texts: list[bytes]) -> np.ndarray:
    """The number of each row's text among the distinct texts of its id, in order; 0 where the id has only one."""
    held: dict = {}
    for i, t in zip(ids, texts):
        held.setdefault(i, set()).add(t)
    ranks = {i: {t: k for k, t in enumerate(sorted(ts))} for i, ts in held.items() if len(ts) > 1}
    return np.array([ranks[i][t] if i in ranks else 0 for i, t in zip(ids, texts)], np.int64)


def rows_with(found: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray, starts: np.ndarray, data: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(entry, row) for grams found as (ids, places, hashes): the row with the id, or each of the rows with it that has the gram there. `ids` of the rows rise."""
    own, places, hashes = found
    first, after = np.searchsorted(ids, own), np.searchsorted(ids, own, side="right")
    many = after - first
    if (many == 1).all():
        return np.arange(len(own)), first
    entry = np.repeat(np.arange(len(own)), many)
    row = np.arange(len(entry)) - np.repeat(np.cumsum(many) - many, many) + first[entry]
    at = starts[row] + places[entry]
    inside = at + GRAM <= starts[row + 1]
    window = data[np.minimum(at, len(data) - GRAM)[:, None] + np.arange(GRAM)]
    mixed = _gram_hash(*np.ascontiguousarray(window).view("<u8").T)
    there = ((((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64) << 32) | (mixed & np.uint64(0xFFFFFFFF)).astype(np.int64)) == hashes[entry]
    pick = (many[entry] == 1) | (inside & there)
    # Two rows with the gram at the same place made two equal entries.
    entry, row = entry[pick], row[pick]
    _, once = np.unique(np.stack([row, places[entry], hashes[entry]]), axis=1, return_index=True)
    return entry[once], row[once]


def surroundings(docs: DataFrame, shared: DataFrame, length: int, buckets: int) -> DataFrame:
    """(bucket, ids, tags, places, hashes, lefts, rights, bytes) of the shared grams: what lies around each, compressed.

    Around a hot gram each string goes to a bucket of its own hash, so no bucket gets all that surrounds the gram. What
    equals the bytes of an earlier document of the same block is settled here: its intervals, from `places` to `hashes`,
    pass by in groups below 0.
    """
    reach = length - GRAM
    width = reach + length

    def run(key, texts, found):
        schema = pa.schema([("bucket", pa.int32()), *((n, pa.list_(t)) for n, t in (("ids", pa.int64()), ("tags", pa.int32()), ("places", pa.int32()), ("hashes", pa.int64()), ("lefts", pa.int16()), ("rights", pa.int16()))), ("bytes", pa.binary())])
        if not found.num_rows or not texts.num_rows:
            return schema.empty_table()
        inflate = zstandard.ZstdDecompressor()
        named, held = texts.column("id").to_pylist(), [inflate.decompress(x) for x in texts.column("packed").to_pylist()]
        # Of rows that are equal one stands for all.
        by_row = {(i, tag): t for i, tag, t in zip(named, tags_of(named, held).tolist(), held)}
        held = [by_row[k] for k in sorted(by_row)]
        named, tags = (np.array(x, np.int64) for x in zip(*sorted(by_row)))
        hot = np.repeat(found.column("hot").to_numpy(zero_copy_only=False).astype(bool), found.column("ids").combine_chunks().value_lengths().to_numpy(zero_copy_only=False))
        ids, places, hashes = (_flat(found, c) for c in ("ids", "places", "hashes"))
        starts = np.cumsum([0, *map(len, held)])
        data = np.concatenate([np.frombuffer(b"".join(held), np.uint8), np.zeros(length, np.uint8)])
        entry, doc = rows_with((ids, places.astype(np.int64), hashes), named, starts, data, buckets)
        ids, places, hashes, hot = ids[entry], places[entry].astype(np.int64), hashes[entry], hot[entry]
        left = np.minimum(places, reach)
        right = np.minimum(starts[doc + 1] - starts[doc] - places, length)
        at = starts[doc] + places
        # Whole surroundings of the usual grams; of equal ones the first document's are sent.
        usual = np.flatnonzero(~hot)
        usual = usual[np.lexsort((places[usual], ids[usual], hashes[usual]))]
        columns = np.arange(width)
        rows = data[np.clip(at[usual, None] - reach + columns, 0, len(data) - 1)]
        rows[(columns < reach - left[usual, None]) | (columns >= reach + right[usual, None])] = 0
        order, fresh = distinct_rows(hashes[usual], _two_bytes(left[usual]), _two_bytes(right[usual]), rows)
        later = np.zeros(len(usual), bool)
        if len(usual):
            first = np.minimum.reduceat(ids[usual[order]], np.flatnonzero(fresh))
            later[order] = ids[usual[order]] > first[np.cumsum(fresh) - 1]
        gone = usual[later]
        begins, ends = [at[gone] - left[gone]], [at[gone] + right[gone]]
        rows, usual = rows[~later], usual[~later]
        sent = [ids[usual], tags[doc[usual]], places[usual], hashes[usual], left[usual], right[usual]]
        if hot.any():
            string_at, string_hash, later = whole_strings(data, starts, named, doc[hot], at[hot], left[hot], right[hot], length, buckets)
            begins.append(string_at[later])
            ends.append(string_at[later] + length)
            string_at, string_hash = string_at[~later], string_hash[~later]
            own = np.searchsorted(starts, string_at, side="right") - 1
            strings = np.zeros((len(string_at), width), np.uint8)
            strings[:, reach:] = data[string_at[:, None] + np.arange(length)]
            rows = np.concatenate([rows, strings])
            sent = [np.concatenate(x) for x in zip(sent, (named[own], tags[own], string_at - starts[own], string_hash, np.zeros(len(own), np.int64), np.full(len(own), length)))]
        bucket = sent[3] >> 32
        order = np.argsort(bucket, kind="stable")
        bucket, sent, rows = bucket[order], [x[order] for x in sent], rows[order]
        bounds = _runs(bucket)
        deflate = zstandard.ZstdCompressor(level=1)
        packed = [deflate.compress(rows[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:])]

        def table(bucket, ids, tags, places, hashes, left, right, bounds, packed):
            lists = _lists({"i": ids, "t": tags.astype(np.int32), "p": places.astype(np.int32), "h": hashes, "l": left.astype(np.int16), "r": right.astype(np.int16)}, bounds)
            return pa.Table.from_arrays([pa.array(bucket, pa.int32()), *lists, pa.array(packed, pa.binary())], schema=schema)

        made = [table(bucket[bounds[:-1]].astype(np.int32), *sent, bounds, packed)]
        begins, ends = np.concatenate(begins), np.concatenate(ends)
        if len(begins):
            # One cell between two documents keeps their intervals apart.
            own = np.searchsorted(starts, begins, side="right") - 1
            steps = np.bincount(begins + own, minlength=len(data) + len(held) + 1) - np.bincount(ends + own, minlength=len(data) + len(held) + 1)
            flags = np.concatenate([[0], (np.cumsum(steps) > 0).astype(np.int8), [0]])
            begins, ends = np.flatnonzero(np.diff(flags) == 1), np.flatnonzero(np.diff(flags) == -1)
            own = np.searchsorted(starts[:-1] + np.arange(len(held)), begins, side="right") - 1
            zero = starts[own] + own
            none = np.zeros(len(own), np.int64)
            made.append(table(np.array([-1 - key[0].as_py() % buckets]), named[own], tags[own], begins - zero, ends - zero, none, none, np.array([0, len(own)]), [b""]))
        return pa.concat_tables(made)

    return docs.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(run, "bucket int, ids array<long>, tags array<int>, places array<int>, hashes array<long>, lefts array<short>, rights array<short>, bytes binary")


def covered(around: DataFrame, blocks: int, length: int) -> DataFrame:
    """(block, ids, tags, starts, stops) of the intervals of bytes to remove."""
    reach = length - GRAM
    width = reach + length

    def run(key, table):
        inflate = zstandard.ZstdDecompressor()
        ids, tags, places, hashes, left, right = (_flat(table, c).astype(np.int64) for c in ("ids", "tags", "places", "hashes", "lefts", "rights"))
        if key[0].as_py() < 0:
            return _by_block({"ids": ids, "tags": tags.astype(np.int32), "starts": places.astype(np.int32), "stops": hashes.astype(np.int32)}, blocks)
        rows, at = np.empty((len(ids), width), np.uint8), 0
        for piece in table.column("bytes"):
            part = np.frombuffer(inflate.decompress(piece.as_buffer()), np.uint8).reshape(-1, width)
            rows[at : at + len(part)] = part
            at += len(part)
        # Distinct surroundings of each gram, with their smallest document.
        order, fresh = distinct_rows(hashes, _two_bytes(left), _two_bytes(right), rows)
        ids, tags, places, hashes, left, right = (x[order] for x in (ids, tags, places, hashes, left, right))
        heads, of = np.flatnonzero(fresh), np.cumsum(fresh) - 1
        first = np.minimum.reduceat(ids, heads)
        rows = rows[order[heads]]
        grams, to_left, to_right = hashes[heads], left[heads], right[heads]
        # Of a gram with several, what can be shared: as far as bytes agree with another on both sides.
        to_left = np.minimum(to_left, shared_extent(grams, rows[:, reach - 1 :: -1]))
        to_right = np.minimum(to_right, shared_extent(grams, rows[:, reach:]))
        some = np.flatnonzero(to_left + to_right >= length)
        removed = np.zeros((len(heads), width), bool)
        if len(some):
            columns = np.arange(width)
            cut_out = np.where((columns >= reach - to_left[some, None]) & (columns < reach + to_right[some, None]), rows[some], 0).astype(np.uint8)
            order, fresh = distinct_rows(grams[some], _two_bytes(to_left[some]), _two_bytes(to_right[some]), cut_out)
            some, cut_out = some[order], cut_out[order]
            begins = np.flatnonzero(fresh)
            cut_first, gram_of = np.minimum.reduceat(first[some], begins), grams[some[begins]]
            group, ends = np.cumsum(fresh) - 1, np.append(begins, len(some))
            weight = np.cumsum(to_left[some[begins]] + to_right[some[begins]] + 1)
            low = 0
            while low < len(begins):
                # Whole grams, up to about SORT_BYTES; a larger one is divided in earliest_bounded().
                high = max(low + 1, int(np.searchsorted(weight, (weight[low - 1] if low else 0) + SORT_BYTES)))
                high = int(np.searchsorted(gram_of, gram_of[min(high, len(begins)) - 1], side="right"))
                pick = begins[low:high]
                least = earliest_bounded(cut_out[pick], reach - to_left[some[pick]], reach + to_right[some[pick]], cut_first[low:high], length, 0, reach)
                members = slice(ends[low], ends[high])
                removed[some[members]] = least[group[members] - low] < first[some[members], None]
                low = high
        later = ids > first[of]
        spans = [(ids[later], tags[later], places[later] - left[later], places[later] + right[later])]
        own = np.flatnonzero(~later & removed.any(1)[of])
        flags = np.pad(removed[of[own]], ((0, 0), (1, 1))).astype(np.int8)
        edge = np.diff(flags, axis=1)
        i, begin = np.nonzero(edge == 1)
        _, end = np.nonzero(edge == -1)
        at = own[i]
        spans.append((ids[at], tags[at], places[at] - reach + begin, places[at] - reach + end - 1 + length))
        made = [np.concatenate(x) for x in zip(*spans)]
        return _by_block({"ids": made[0], "tags": made[1].astype(np.int32), "starts": made[2].astype(np.int32), "stops": made[3].astype(np.int32)}, blocks)

    return around.groupBy("bucket").applyInArrow(run, "block int, ids array<long>, tags array<int>, starts array<int>, stops array<int>")


def remove_intervals(docs: DataFrame, intervals: DataFrame) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept binary, rest) for packed texts and the intervals of their blocks. A tag below 0 stands for a whole text: its start and stop are halves of the text's hash."""

    def run(key, texts, found):
        inflate = zstandard.ZstdDecompressor()
        ids, tags, starts, stops = (_flat(found, c).astype(np.int64) for c in ("ids", "tags", "starts", "stops")) if found.num_rows else (np.empty(0, np.int64),) * 4
        order = np.lexsort((starts, tags, ids))
        ids, tags, starts, stops = ids[order], tags[order], starts[order], stops[order]
        named, packed = texts.column("id").to_pylist(), texts.column("packed").to_pylist()
        # Only rows of a repeated id have to be looked at together.
        seen, several = set(), set()
        for i in named:
            (several if i in seen else seen).add(i)
        again = [k for k, i in enumerate(named) if i in several and i is not None]
        tag = dict(zip(again, tags_of([named[k] for k in again], [inflate.decompress(packed[k]) for k in again]).tolist()))
        sizes, gone, spans, kept = [], [], [], []
        for k, own in enumerate(named):
            text = inflate.decompress(packed[k])
            a, b = (np.searchsorted(ids, own), np.searchsorted(ids, own, side="right")) if own is not None else (0, 0)
            low = a + np.searchsorted(tags[a:b], tag.get(k, 0))
            high = a + np.searchsorted(tags[a:b], tag.get(k, 0), side="right")
            whole = a + np.searchsorted(tags[a:b], 0)
            keep, at, n, parts = 0, 0, 0, []
            if whole > a and ((starts[a:whole] == (halves := np.frombuffer(hashlib.md5(text).digest()[:8], ">u4").astype(np.int64) - (1 << 31))[0]) & (stops[a:whole] == halves[1])).any():
                keep, at, n = 1, len(text), len(text)
            elif high > low:
                reach = np.maximum.accumulate(stops[low:high])
                heads = np.concatenate([[0], np.flatnonzero(starts[low + 1 : high] > reach[:-1]) + 1])
                begins, ends = starts[low:high][heads].tolist(), reach[np.append(heads[1:], high - low) - 1].tolist()
                for begin, end in zip(begins, ends):
                    parts.append(text[at:begin])
                    at = min(end, len(text))
                    n += at - begin
                keep = len(begins)
            parts.append(text[at:])
            sizes.append(len(text))
            gone.append(n)
            spans.append(keep)
            kept.append(b"".join(parts))
        return pa.Table.from_arrays([texts.column("id"), *(pa.array(x, pa.int64()) for x in (sizes, gone, spans)), pa.array(kept, pa.binary()), texts.column("rest")], names=["id", "n_bytes", "n_removed", "n_spans", "kept", "rest"])

    return docs.groupBy("block").cogroup(intervals.groupBy("block")).applyInArrow(run, T.StructType([*(T.StructField(c, T.LongType()) for c in ("id", "n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.BinaryType()), docs.schema["rest"]]))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, carry: tuple[str, ...] = (), hot: int = 128, hot_total: int = 50_000) -> DataFrame:
    """One row per row of `docs`: id, n_bytes, n_removed, n_spans, kept (the remaining bytes), and the columns of `carry` as a struct `rest` if there are any.

    A byte is removed if a string of `length` bytes that covers it also starts
    in a text with a smaller id. Strings are judged on the input; within one
    text, or between rows with the same id, nothing is removed; rows of one id with
    different texts each lose what their own text shares. A null text is
    empty. Texts under `length` bytes lose nothing. A row with a null id neither
    loses bytes nor takes any. Rows of one id lie in one task's block. An empty table gives none; other columns are not read.
    `length` is from GRAM to 32767. A gram is hot, and what surrounds it dealt out by single strings, if `hot` texts of a
    part of a task (4 MB) or more than `hot_total` of all have it; that changes where the work is done, not what is removed.
    """
    if not GRAM <= length < 1 << 15:
        raise ValueError(f"length is from {GRAM} to {(1 << 15) - 1}")
    base = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8").alias("text"), (as_struct(docs, *[c for c in docs.columns if c not in carry]) if carry else F.lit(None).cast("boolean")).alias("rest"))
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, round(total / BUCKET_BYTES))
    blocks = max(1, round(total / BLOCK_BYTES)) | 1
    named = base.where("id is not null")
    shared = cut(shared_grams(grams_of(named, buckets, length, hot), blocks, hot_total))

    def pack(batches):
        deflate = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for start, part in batches_of(batch.column("text"), 8 << 20):
                packed = pa.array([deflate.compress(t.as_buffer()) for t in part], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(start, len(part)) for c in ("id", "block", "rest")), packed], names=["id", "block", "rest", "packed"])

    block = F.pmod(F.coalesce("id", F.xxhash64("text")), F.lit(blocks)).cast("int")

    def packed(rows: DataFrame) -> DataFrame:
        schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("block", T.IntegerType()), rows.schema["rest"], T.StructField("packed", T.BinaryType())])
        return rows.withColumn("block", block).select("id", "block", "rest", "text").mapInArrow(pack, schema)

    bare = named.withColumn("rest", F.lit(None).cast("boolean"))
    intervals = covered(surroundings(packed(bare), shared, length, buckets), blocks, length)
    texts = named.where(F.octet_length("text") >= length).select("id", F.md5("text").alias("digest"))
    # The copies of one text are met in SALTS groups, of which each gets the first of all.
    texts = texts.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    salted = texts.groupBy("digest", "salt").agg(F.min("id").alias("first"), F.count("*").alias("rows"))
    firsts = salted.groupBy("digest").agg(F.min("first").alias("first"), F.sum("rows").alias("rows")).where("rows > 1").select("digest", "first")
    firsts = salted.select("digest", "salt").join(firsts, "digest")
    half = lambda k: F.array((F.conv(F.substring("digest", 1 + 8 * k, 8), 16, 10).cast("long") - (1 << 31)).cast("int"))
    copies = texts.join(firsts, ["digest", "salt"]).where("id > first").select(F.pmod("id", F.lit(blocks)).cast("int").alias("block"), F.array("id").alias("ids"), F.array(F.lit(-1)).alias("tags"), half(0).alias("starts"), half(1).alias("stops"))
    intervals = cut(intervals.unionByName(copies))
    out = remove_intervals(packed(base), intervals).withColumnRenamed("id", id_col)
    return out if carry else out.drop("rest")
