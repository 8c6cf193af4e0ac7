"""Packing: documents become sequences of near-equal length by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import map_batches, mix64

#: Words, and runs of text, whose ids a process remembers at once: some 200 MB each.
WORDS, RUNS = 1_000_000, 1_000_000


#: A run of letters below U+0250, but for one whose lower case is two characters, with common punctuation behind it.
PLAIN = re.compile("([A-Za-z\u00aa\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([.,!?;:]*)")


class Remembered(dict):
    """The ids of strings as bytes, in two halves: when the newer one is full, the older one is forgotten."""

    def __init__(self, ids_of, at_most: int):
        super().__init__()
        self.ids_of, self.at_most, self.older = ids_of, at_most // 2, {}

    def __missing__(self, key: str) -> bytes:
        found = self.older.get(key) or self.ids_of(key)
        if len(key) <= 64:
            if len(self) >= self.at_most:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found


class Encoder:
    """Ids of whole texts. The tokenizer drops white space and never joins over it, so each run between white
    space is encoded once and remembered; texts with separators that Python alone counts as white space go whole.
    It parts letters from punctuation too and lowers case, so most runs are a known word and a known ending."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # Characters that stand for the bytes of a word where the vocabulary is applied without normalising and splitting.
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.stands_for = {c: level.pre_tokenize_str(c)[0][0] for c in map(chr, range(1, 0x250))}
        self.words = Remembered(self._word, WORDS)
        self.runs = Remembered(self._run, RUNS)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        if not word.isascii():
            word = "".join(map(self.stands_for.__getitem__, word))
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _run(self, run: str) -> bytes:
        # Composed letters stay as they are when normalised; other runs go through the tokenizer whole.
        if plain := PLAIN.fullmatch(run):
            found = self.words[plain[1].lower()]
            return found + self.words[plain[2]] if plain[2] else found
        return self._whole(run)

    def encode(self, text: str | None) -> bytes:
        """The ids as unsigned 32-bit numbers, little-endian."""
        if not text:
            return b""
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self._whole(text)
        return b"".join(map(self.runs.__getitem__, text.split()))


#: Encoders of this process by path: a Python worker keeps what it knows from task to task.
_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    return _ENCODERS.get(path) or _ENCODERS.setdefault(path, Encoder(path))


def powers(n: int) -> list[int]:
    """The powers of two that n is the sum of, falling."""
    return [1 << i for i in range(n.bit_length() - 1, -1, -1) if n >> i & 1]


def difference(sizes: list[int], bins: int) -> list[list[int]]:
    """Karmarkar-Karp: indices of sizes in each of the bins.

    A partial partition lists its occupied bins by falling sum, less the smallest sum once all are occupied. The
    two partitions of largest imbalance are merged, the fullest bins of one with the emptiest of the other. A bin
    is a node: an item, or the two nodes that were put together.
    """
    n = len(sizes)
    if bins <= 1 or not n:
        return [list(range(n))] + [[] for _ in range(bins - 1)]
    heap = [(-s, i, np.array([s]), np.array([i])) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    stamp = node = n
    while len(heap) > 1:
        _, _, a, a_node = heapq.heappop(heap)
        _, _, b, b_node = heapq.heappop(heap)
        alone = bins - len(b)
        if alone >= len(a):
            sums, nodes = np.concatenate([a, b]), np.concatenate([a_node, b_node])
        else:
            paired = len(a) - alone
            low, low_node = b[::-1], b_node[::-1]
            left.append(a_node[alone:])
            right.append(low_node[:paired])
            sums = np.concatenate([a[:alone], a[alone:] + low[:paired], low[paired:]])
            nodes = np.concatenate([a_node[:alone], np.arange(node, node + paired), low_node[paired:]])
            node += paired
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        if len(sums) == bins:
            sums = sums - sums[-1]
        heapq.heappush(heap, (-int(sums[0]), stamp, sums, nodes))
        stamp += 1
    lefts, rights = np.concatenate(left).tolist(), np.concatenate(right).tolist()
    out = []
    for top in heap[0][3].tolist():
        found, todo = [], [top]
        while todo:
            x = todo.pop()
            if x < n:
                found.append(x)
            else:
                todo += (lefts[x - n], rights[x - n])
        out.append(sorted(found))
    return out + [[] for _ in range(bins - len(out))]


def fits(sizes: list[int], capacity: int, bins: int) -> list[list[int]] | None:
    """Indices of sizes by window, None if one of so many windows overflows."""
    found = difference(sizes, bins)
    return [x for x in found if x] if all(sum(sizes[i] for i in x) <= capacity for x in found) else None


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices of sizes by window: as few windows as hold the total; while any overflows the count rises, by steps that
    double, and the last step is then halved down to the count where none does."""
    low, step = max(1, -(-sum(sizes) // capacity)) - 1, 1
    while (found := fits(sizes, capacity, low + step)) is None:
        low, step = low + step, 2 * step
    high = low + step
    while high - low > 1:
        middle = (low + high) // 2
        if (better := fits(sizes, capacity, middle)) is None:
            low = middle
        else:
            high, found = middle, better
    return found


def levelled(rests: list[int], capacity: int, fine_share: int, spare: float) -> list[list[tuple[int, int]]]:
    """Windows of (index of a rest, its part): part -1 is a whole rest, others are its powers of two.

    One rest in fine_share is cut. While that takes more than spare windows above what the total needs (one, if that is
    more), twice as many rests are cut; with all of them cut, the count rises as far as it must.
    """
    least = max(1, -(-sum(rests) // capacity))
    share = fine_share
    while True:
        pieces = [x for i, n in enumerate(rests) for x in ([(i, k) for k in range(n.bit_count())] if i % share == 0 else [(i, -1)])]
        sizes = [rests[i] if k < 0 else powers(rests[i])[k] for i, k in pieces]
        found = fits(sizes, capacity, least) or fits(sizes, capacity, least + max(1, int(spare * least)))
        if found is None and share == 1:
            found = windows(sizes, capacity)
        if found is not None:
            return [[pieces[x] for x in w] for w in found]
        share = max(1, share // 2)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2, docs_per_group: int = 1024, fine_share: int = 8, spare: float = 0.01) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and end_id; null and empty texts are end_id alone. Full windows of long documents
    stand alone; the rests of about docs_per_group documents are packed together, some of them cut at powers of two so that
    small pieces level the windows: one in fine_share, and more of them until no more than a share of spare is padding.
    Groups are dealt by a hash of doc_id, text, task and how often the task has met that row, so rows that repeat spread
    over all groups and a task that runs again deals alike in whatever order its rows come; a task holds a number for
    each of its distinct rows. Repeated rows are packed as often as they occur; other columns are ignored; no rows give no rows.
    """
    groups = max(1, -(-docs.count() // docs_per_group))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", "text", F.xxhash64(F.lit(9), "doc_id", "text").alias("pack_key"))

    met: dict[int, int] = {}

    def group_of(keys: np.ndarray) -> np.ndarray:
        context = TaskContext.get()
        turn = np.empty(len(keys), np.uint64)
        for i, k in enumerate(keys.tolist()):
            met[k] = turn[i] = met.get(k, 0) + 1
        turn += np.uint64((context.partitionId() if context else 0) << 36)
        return (mix64(keys.view(np.uint64) + turn * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(groups)).astype(np.int32)

    def pieces(batch):
        """Full windows and rests; of a rest also the CRC-32 of its powers of two."""
        encoder, end = encoder_of(tokenizer), end_id.to_bytes(4, "little")
        row, starts, lengths, sums, parts, tokens = [], [], [], [], [], []
        for i, text in enumerate(batch["text"]):
            ids = encoder.encode(text.as_py()) + end
            n = len(ids) // 4
            for start in range(0, n, capacity):
                length = min(capacity, n - start)
                row.append(i)
                starts.append(start)
                lengths.append(length)
                sums.append(zlib.crc32(ids[4 * start : 4 * (start + length)]))
                at, part = 4 * start, []
                if length < capacity:
                    for p in powers(length):
                        part.append(zlib.crc32(ids[at : at + 4 * p]))
                        at += 4 * p
                parts.append(part)
                tokens.append(n)
        group = group_of(batch["pack_key"].to_numpy())
        return {"doc_id": batch["doc_id"].take(pa.array(row, pa.int64())), "pack_group": group[row], "start": starts, "length": lengths, "ids_crc32": sums, "parts": parts, "doc_tokens": tokens}

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        starts, lengths, sums = (table[c].to_numpy() for c in ("start", "length", "ids_crc32"))
        rest = np.flatnonzero(lengths != capacity)
        parts = table["parts"].to_pylist()
        rows = np.flatnonzero(lengths == capacity).tolist()
        # (row, start, length, sum) of each piece, by sequence.
        sequences = [[(i, starts[i], capacity, sums[i])] for i in rows]
        if len(rest):
            for w in levelled(lengths[rest].tolist(), capacity, fine_share, spare):
                sequence = []
                for at, k in w:
                    i = int(rest[at])
                    if k < 0:
                        sequence.append((i, starts[i], lengths[i], sums[i]))
                    else:
                        p = powers(int(lengths[i]))
                        sequence.append((i, starts[i] + sum(p[:k]), p[k], parts[i][k]))
                sequences.append(sequence)
        flat = np.array([(*x, j) for j, w in enumerate(sequences) for x in w], dtype=np.int64)
        before = np.cumsum(flat[:, 2]) - flat[:, 2]
        first = np.concatenate([[True], flat[1:, 4] != flat[:-1, 4]])
        offset = before - np.maximum.accumulate(np.where(first, before, 0))
        group, at = table["pack_group"][0].as_py(), pa.array(flat[:, 0])
        columns = [table["doc_id"].take(at), *(pa.array(flat[:, c]) for c in (1, 2, 3)), table["doc_tokens"].take(at), pa.array((group << 32) + flat[:, 4]), pa.array(offset)]
        return pa.table(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    schema = f"doc_id {id_type}, pack_group int, start long, length long, ids_crc32 long, parts array<long>, doc_tokens long"
    out = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return map_batches(keyed, pieces, schema).groupBy("pack_group").applyInArrow(packed, out)
