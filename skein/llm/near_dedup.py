"""Near duplicates by ProbMinHash: registers estimate the probability Jaccard similarity of word shingles, as sets and
weighted by their counts, bands of registers give candidates, spanning forests of candidates are verified exactly, and
families of candidates that no link joins are compared in blocks, each pair exactly where its estimate allows a link."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import map_batches, mix64
from skein.session import Scratch, ensure_importable

BANDS, ROWS = 28, 4
REGISTERS = BANDS * ROWS
#: Rows of a bucket that one task compares with each other at once; larger buckets are dealt over more cells.
CELL = 256
#: Rows, and about how many shingles, of either side that one task compares at once where a family is compared in blocks.
BLOCK, BLOCK_SHINGLES = 2048, 500_000
#: How far below the threshold the estimate of a pair to verify may be: five standard deviations at 0.8.
MARGIN = 0.2
STEP = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """Hashes of lower-cased words. It remembers 100,000 words of up to 64 characters: some 20 MB."""

    def __missing__(self, word: str) -> int:
        found = xxhash.xxh64_intdigest(word.lower().encode("utf-8", "surrogatepass"))
        if len(word) <= 64:
            if len(self) >= 100_000:
                self.clear()
            self[word] = found
        return found


def shingles(text: str | None, words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of size words (all words, if fewer) and how often each occurs; none without words."""
    parts = (text or "").split()
    hashed = np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts))
    if not len(hashed):
        return hashed, np.zeros(0, np.int64)
    size = min(size, len(hashed))
    total = np.zeros(len(hashed) - size + 1, np.uint64)
    for i in range(size):
        total = total * STEP + hashed[i : len(hashed) - size + 1 + i]
    return np.unique(mix64(total), return_counts=True)


def signature(keys: np.ndarray, weights: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash1: each element's points arrive as a Poisson process of its weight, each at a random register.

    A register keeps the element whose point came first. An element ends once its next point is later than the
    latest first point of all registers.
    """
    first = np.full(registers, np.inf)
    holder = np.zeros(registers, np.uint64)
    active, rate, time, draw = keys, weights.astype(float), np.zeros(len(keys)), np.uint64(0)
    while len(active):
        # Several points of each element at once where there are few elements: later points never win unduly.
        points = max(1, 4 * registers // len(active))
        with np.errstate(over="ignore"):
            random = mix64(active[:, None] ^ (draw + STEP * np.arange(1, points + 1, dtype=np.uint64))[None, :])
            place = ((mix64(random + STEP) >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
            draw += STEP * np.uint64(points)
        gaps = -np.log1p(-(random >> np.uint64(11)).astype(float) * 2.0**-53) / rate[:, None]
        times = time[:, None] + np.cumsum(gaps, axis=1)
        before = first.copy()
        np.minimum.at(first, place.ravel(), times.ravel())
        element, point = np.nonzero((times == first[place]) & (times < before[place]))
        holder[place[element, point]] = active[element]
        time = times[:, -1]
        on = time < first.max()
        active, rate, time = active[on], rate[on], time[on]
    return holder


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """Jaccard similarity of the sets and probability Jaccard similarity of the weighted sets; 0 if either is empty."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0, 0.0
    wa, wb = a[1].astype(float), b[1].astype(float)
    x, y = wa[i], wb[j]
    order = np.argsort(y / x, kind="stable")
    x, y = x[order], y[order]
    ratio = y / x
    last = np.searchsorted(ratio, ratio, side="right")
    # Elements of one side only have ratio 0 or infinity: their own weight always counts.
    low = np.concatenate([[0.0], np.cumsum(x)])[last] + (wa.sum() - x.sum())
    high = (y.sum() - np.concatenate([[0.0], np.cumsum(y)])[last]) + (wb.sum() - y.sum())
    return len(both) / (len(wa) + len(wb) - len(both)), float((1 / (low / x + high / y)).sum())


def _banded(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, bytes]:
    """A key per band and eight bits per register."""
    held = signature(keys, weights).reshape(BANDS, ROWS)
    total = np.arange(BANDS, dtype=np.uint64) + STEP
    for r in range(ROWS):
        total = mix64(total * STEP + held[:, r])
    return total.view(np.int64), mix64(held.ravel()).astype(np.uint8).tobytes()


def _signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, copy, size, bands, tags, heavy_bands, heavy_tags): a hash of the text, its distinct shingles, keys and tags
    of its shingles as a set and, where one occurs repeatedly (else null), weighted by counts; only texts with words.
    Of the rows of a batch with equal texts only that with the smallest doc_id is worked on."""
    words = Words()

    def run(batch):
        out = {"doc_id": [], "copy": [], "size": [], "bands": [], "tags": [], "heavy_bands": [], "heavy_tags": []}
        ids, copies = batch["doc_id"].to_numpy(), batch["copy"].to_pylist()
        seen = set()
        for i in np.argsort(ids, kind="stable").tolist():
            if copies[i] in seen:
                continue
            seen.add(copies[i])
            keys, counts = shingles(batch["text"][i].as_py(), words)
            if len(keys):
                bands, tags = _banded(keys, np.ones(len(keys)))
                heavy_bands, heavy_tags = _banded(keys, counts) if (counts > 1).any() else (None, None)
                for name, value in zip(out, (ids[i], copies[i], len(keys), bands, tags, heavy_bands, heavy_tags), strict=True):
                    out[name].append(value)
        return out

    return map_batches(docs, run, "doc_id long, copy binary, size long, bands array<long>, tags binary, heavy_bands array<long>, heavy_tags binary")


def _either(signatures: DataFrame) -> DataFrame:
    """(doc_id, part, bands, tags): a row for the set and, where it differs, one for the weighted set of each text; part is
    a hash that tells rows apart (a collision only adds candidates).

    Both kinds meet in the same buckets, as a text without repeated shingles has one row for either similarity.
    """
    light = signatures.select("doc_id", F.xxhash64("doc_id", "copy").alias("part"), "bands", "tags")
    heavy = signatures.where(F.col("heavy_tags").isNotNull()).select("doc_id", F.xxhash64(F.lit(1), "doc_id", "copy").alias("part"), F.col("heavy_bands").alias("bands"), F.col("heavy_tags").alias("tags"))
    return light.unionByName(heavy)


def _forest(tags: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Edges of a maximum spanning forest over pairs whose tags agree in a share of at least least (Prim)."""
    n = len(tags)
    best, link = np.full(n, -1.0), np.full(n, -1)
    left = np.ones(n, bool)
    edges = []
    for _ in range(n):
        at = int(np.argmax(np.where(left, best, -2.0)))
        left[at] = False
        if best[at] >= least:
            edges.append((int(link[at]), at))
        same = (tags == tags[at]).mean(axis=1)
        closer = left & (same > best)
        best[closer], link[closer] = same[closer], at
    return edges


#: Columns of a cell: arrays, tags with a row of their own for each row, and lists of shingle keys and counts.
Cell = dict


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[Cell]:
    """The cells of rows that come sorted by bucket and cell, each in order of its documents."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket, cell = (batch[c].to_numpy() for c in ("bucket", "cell"))
        if kept and (kept[-1]["bucket"][-1].as_py(), kept[-1]["cell"][-1].as_py()) != (bucket[0], cell[0]):
            yield _cell(kept)
            kept = []
        edges = [0, *(np.flatnonzero((np.diff(bucket) != 0) | (np.diff(cell) != 0)) + 1).tolist(), batch.num_rows]
        for i, j in zip(edges[:-2], edges[1:-1], strict=True):
            yield _cell([*kept, batch.slice(i, j - i)])
            kept = []
        kept.append(batch.slice(edges[-2]))
    if kept:
        yield _cell(kept)


def _cell(parts: list[pa.RecordBatch]) -> Cell:
    table = pa.Table.from_batches(parts)
    out: Cell = {c: table[c].to_numpy() for c in table.column_names if not pa.types.is_binary(table.schema.field(c).type)}
    order = np.argsort(out["doc_id"], kind="stable")
    out = {c: x[order] for c, x in out.items()}
    out["tags"] = np.frombuffer(b"".join(table["tags"].to_pylist()), np.uint8).reshape(-1, REGISTERS)[order]
    if "keys" in table.column_names:
        keys, counts, heavy = (table[c].to_pylist() for c in ("keys", "counts", "heavy_tags"))
        out["keys"] = [np.frombuffer(keys[i], np.uint64) for i in order]
        out["counts"] = [np.frombuffer(counts[i], "<u4").astype(float) if counts[i] else np.ones(len(keys[i]) // 8) for i in order]
        out["heavy"] = np.array([heavy[i] is not None for i in order])
        # Where the weighted set is the set itself, its tags are those of the set.
        out["heavy_tags"] = out["tags"].copy()
        for at, i in enumerate(order):
            if heavy[i] is not None:
                out["heavy_tags"][at] = np.frombuffer(heavy[i], np.uint8)
    return out


def _each_cell(rows: DataFrame, pairs_of) -> DataFrame:
    """(a, b, bucket, part) from what pairs_of gives for each cell; b is null for a leader, and part tells which row of
    its document it is."""
    ensure_importable(rows.sparkSession)

    def run(batches):
        out: list[tuple] = []

        def table():
            columns = [pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else ([], [], [], []))]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, ["a", "b", "bucket", "part"])

        for cell in _cells(batches):
            for pair in pairs_of(cell):
                out.append(pair)
                if len(out) > 50_000:
                    yield table()
        yield table()

    parts = max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartition(parts, "bucket", "cell").sortWithinPartitions("bucket", "cell")
    return ordered.mapInArrow(run, "a long, b long, bucket long, part long")


def _spanning(least: float):
    """Pairs of the cell's spanning forest and, in a bucket that was dealt, the leader of each tree."""

    def pairs(cell: Cell) -> Iterator[tuple]:
        docs, bucket, roots = cell["doc_id"].tolist(), int(cell["bucket"][0]), np.ones(len(cell["doc_id"]), bool)
        for i, j in _forest(cell["tags"], least):
            roots[max(i, j)] = False
            # The rows of one document need no verification.
            if docs[i] != docs[j]:
                yield docs[min(i, j)], docs[max(i, j)], bucket, 0
        if cell["dealt"][0]:
            for i in np.flatnonzero(roots).tolist():
                yield docs[i], None, bucket, int(cell["part"][i])

    return pairs


def _estimates(cell: Cell, i: int, others: np.ndarray) -> np.ndarray:
    """The larger estimate of both similarities of row i to other rows, of sets or weighted sets on either side."""
    out = (cell["tags"][others] == cell["tags"][i]).mean(axis=1)
    if cell["heavy"].any():
        for mine in ("tags", "heavy_tags"):
            np.maximum(out, (cell["heavy_tags"][others] == cell[mine][i]).mean(axis=1), out=out)
        np.maximum(out, (cell["tags"][others] == cell["heavy_tags"][i]).mean(axis=1), out=out)
    return out


def _linking(threshold: float):
    """Links of the cell's asking to its other rows that join different labels: fewer than it has labels.

    Intersections of an asking set with all other sets are counted at once. The weighted similarity is at most the sum of
    the smaller shares of all shingles, so it is worked out only where that sum reaches the threshold.
    """

    def pairs(cell: Cell) -> Iterator[tuple]:
        asking, other = np.flatnonzero(cell["asks"]), np.flatnonzero(~cell["asks"])
        if not len(asking) or not len(other):
            return
        label, docs, keys, counts = cell["label"].copy(), cell["doc_id"], cell["keys"], cell["counts"]
        total, size = np.array([x.sum() for x in counts]), np.array([len(x) for x in keys])
        may = cell["main"][other]
        index: tuple | None = None
        for i in asking.tolist():
            near = (label[other] != label[i]) & (may | (docs[other] > docs[i]))
            near[near] = _estimates(cell, i, other[near]) >= threshold - MARGIN
            if not near.any():
                continue
            if index is None:
                # Every shingle of other rows that an asking row has: its row, its number and its share of the row.
                known = np.unique(np.concatenate([keys[j] for j in asking]))
                flat = np.concatenate([keys[j] for j in other])
                at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                hit = known[at] == flat
                row = np.repeat(np.arange(len(other)), size[other])[hit]
                index = known, row, at[hit], np.concatenate([counts[j] / total[j] for j in other])[hit]
            known, row, at, share = index
            mine = np.zeros(len(known))
            mine[np.searchsorted(known, keys[i])] = counts[i] / total[i]
            both = np.bincount(row, mine[at] > 0, len(other))
            linked = near & (both / (size[i] + size[other] - both) >= threshold)
            near &= ~linked & (cell["heavy"][i] | cell["heavy"][other])
            if near.any():
                near &= np.bincount(row, np.minimum(mine[at], share), len(other)) >= threshold - 1e-9
            for j in (*np.flatnonzero(linked).tolist(), *np.flatnonzero(near).tolist()):
                at_j = other[j]
                if label[at_j] != label[i] and (linked[j] or similarity((keys[i], counts[i]), (keys[at_j], counts[at_j]))[1] >= threshold):
                    label[label == label[at_j]] = label[i]
                    yield int(min(docs[i], docs[at_j])), int(max(docs[i], docs[at_j])), int(cell["bucket"][0]), 0

    return pairs


def _dealt(rows: DataFrame, level: int) -> DataFrame:
    """rows(bucket, doc_id, part, tags, n) with cell and dealt: those of a bucket of more than CELL are dealt by two further
    registers and at random, and where a cell is still too large once more by its size."""
    extra = F.substring("tags", (F.pmod(F.col("bucket") + 7 * level, F.lit(REGISTERS // 2)) * 2 + 1).cast("int"), F.lit(2))
    deal = F.xxhash64(extra, F.pmod(F.xxhash64("doc_id", F.lit(level)), F.greatest(F.lit(1), F.ceil(F.col("n") / (8 * CELL)))))
    large = F.col("n") > CELL
    dealt = rows.select("bucket", F.when(large, deal).otherwise(F.lit(0)).alias("cell"), large.alias("dealt"), "doc_id", "part", "tags")
    size = dealt.where("dealt").groupBy("bucket", "cell").agg(F.count("*").alias("size")).where(F.col("size") > CELL)
    again = F.xxhash64("cell", F.pmod(F.xxhash64(F.lit(level + 100), "doc_id"), F.ceil(F.col("size") / CELL)))
    return dealt.join(size.hint("merge"), ["bucket", "cell"], "left").withColumn("cell", F.when(F.col("size").isNull(), F.col("cell")).otherwise(again)).drop("size")


def candidates(scratch: Scratch, signatures: DataFrame, threshold: float, levels: int = 5) -> tuple[DataFrame, DataFrame]:
    """(pairs (a, b) with a < b to verify, at most a spanning forest per cell; the rows (bucket, doc_id) of dealt buckets).

    Each tree of a cell of a dealt bucket sends its leader to the bucket's next level. Neither the trees nor the levels
    need to find every link: what they leave out lies in one family, which left_out() compares.
    """
    # A band key that no other text has is dropped before tags are attached.
    bands = signatures.select("doc_id", "part", F.explode("bands").alias("bucket"))
    met = bands.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    tags = signatures.select("part", "tags")
    shared = scratch.write(bands.join(met, "bucket").join(tags, "part").select("bucket", "doc_id", "part", "tags", "n"), "met")
    rows, pairs = shared, None
    for level in range(levels):
        found = scratch.write(_each_cell(_dealt(rows, level), _spanning(threshold - MARGIN)), f"level{level}")
        here = found.where(F.col("b").isNotNull()).select("a", "b")
        pairs = here if pairs is None else pairs.unionByName(here)
        leaders = found.where(F.col("b").isNull()).select("bucket", F.col("a").alias("doc_id"), "part")
        if level == levels - 1 or leaders.isEmpty():
            break
        counts = leaders.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > 1)
        rows = leaders.join(counts, "bucket").join(tags, "part").select("bucket", "doc_id", "part", "tags", "n")
    return pairs.distinct(), shared.where(F.col("n") > CELL).select("bucket", "doc_id").distinct()


def _shingle_sets(docs: DataFrame, wanted: DataFrame, signatures: DataFrame) -> DataFrame:
    """(doc_id, size, tags, heavy_tags, keys, counts): the shingles of each text that stands for its equals under a wanted doc_id;
    counts are empty where all are 1."""
    words = Words()

    def sets(batch):
        keys, counts = [], []
        for text in batch["text"]:
            k, n = shingles(text.as_py(), words)
            keys.append(k.tobytes())
            counts.append(n.astype("<u4").tobytes() if (n > 1).any() else b"")
        return {c: batch[c] for c in ("doc_id", "size", "tags", "heavy_tags")} | {"keys": keys, "counts": counts}

    known = signatures.select("doc_id", "copy", "size", "tags", "heavy_tags").join(wanted, "doc_id")
    # Rows that repeat both id and text are one; partial aggregation drops them before the shuffle where they are many.
    texts = docs.join(known.select("doc_id", "copy").hint("merge"), ["doc_id", "copy"], "left_semi").groupBy("doc_id", "copy").agg(F.min("text").alias("text"))
    return map_batches(texts.join(known.hint("merge"), ["doc_id", "copy"]), sets, "doc_id long, size long, tags binary, heavy_tags binary, keys binary, counts binary")


def verified(sets: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """(a, b): pairs whose exact similarity, of sets or of weighted sets, reaches threshold."""

    def check(batch):
        out = []
        for i in range(batch.num_rows):
            sides = []
            for k, n in (("ka", "na"), ("kb", "nb")):
                k, n = np.frombuffer(batch[k][i].as_py(), np.uint64), batch[n][i].as_py()
                sides.append((k, np.frombuffer(n, "<u4") if n else np.ones(len(k))))
            out.append(max(similarity(*sides)))
        return {"a": batch["a"], "b": batch["b"], "score": out}

    left = sets.select(F.col("doc_id").alias("a"), F.col("keys").alias("ka"), F.col("counts").alias("na"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("keys").alias("kb"), F.col("counts").alias("nb"))
    return map_batches(pairs.join(left, "a").join(right, "b"), check, "a long, b long, score double").where(F.col("score") >= threshold).select("a", "b")


def _with_label(rows: DataFrame, labels: DataFrame, node: str, name: str) -> DataFrame:
    """rows with the label of the node in column node; a node without links is its own."""
    of = labels.select(F.col("node").alias(node), F.col("label").alias(name))
    return rows.join(of, node, "left").withColumn(name, F.coalesce(name, node))


def left_out(scratch: Scratch, sets: DataFrame, pairs: DataFrame, dealt: DataFrame, labels: DataFrame, threshold: float) -> DataFrame | None:
    """(a, b): links between different labels that no verified pair stands for; None if there can't be any.

    Labels that a candidate pair or a dealt bucket connects are a family. All documents of a family outside its largest
    label ask all of the family, block against block; a task counts its pairs and gives only links that join labels.
    So rows follow documents and blocks, never pairs; time grows with the product of both numbers.
    """
    tried = _with_label(_with_label(pairs, labels, "a", "la"), labels, "b", "lb").select("la", "lb")
    found = _with_label(dealt, labels, "doc_id", "lb").select("bucket", "lb").distinct()
    least = found.groupBy("bucket").agg(F.min("lb").alias("la"))
    edges = tried.unionByName(found.join(least, "bucket").select("la", "lb")).where(F.col("la") != F.col("lb")).select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()
    edges = scratch.write(edges, "edges")
    if edges.isEmpty():
        return None
    family = components(scratch, edges, "family").select(F.col("node").alias("label"), F.col("label").alias("bucket"))
    own = _with_label(sets.select("doc_id", "size"), labels, "doc_id", "label").join(family, "label")
    sizes = own.groupBy("bucket", "label").agg(F.count("*").alias("m"), F.sum("size").alias("s"))
    sizes = sizes.groupBy("bucket").agg(F.max(F.struct("m", "s", "label")).alias("most"), F.sum("m").alias("n"), F.sum("s").alias("s"))
    across = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("s") / BLOCK_SHINGLES))
    down = F.greatest(F.ceil((F.col("n") - F.col("most.m")) / BLOCK), F.ceil((F.col("s") - F.col("most.s")) / BLOCK_SHINGLES), F.lit(1))
    sizes = sizes.select("bucket", F.col("most.label").alias("largest"), across.alias("across"), down.alias("down"))
    own = own.select("doc_id", "label", "bucket").distinct().join(sizes, "bucket").withColumn("main", F.col("label") == F.col("largest"))
    rows = sets.join(own, "doc_id")

    def cells(first: Column, step: Column, count: Column, asks: bool) -> Column:
        return F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda i: F.struct((first + step * i).alias("cell"), F.lit(asks).alias("asks")))

    # Cells are numbered by rows of blocks that ask and, in these, by blocks of all rows.
    across, down, one = F.col("across"), F.col("down"), F.lit(1).cast("long")
    asked = cells(F.pmod(F.xxhash64("doc_id"), across), across, down, False)
    asking = cells(F.pmod(F.xxhash64(F.lit(1), "doc_id"), down) * across, one, across, True)
    rows = rows.withColumn("at", F.explode(F.when(F.col("main"), asked).otherwise(F.concat(asked, asking))))
    rows = rows.select("bucket", "at.cell", "at.asks", "doc_id", "label", "main", "tags", "heavy_tags", "keys", "counts")
    return _each_cell(rows, _linking(threshold)).select("a", "b")


def components(scratch: Scratch, links: DataFrame, name: str) -> DataFrame:
    """(node, label): the smallest node of each node's component, by passing on minima and jumping along labels."""
    both = scratch.write(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-links")
    labels = scratch.write(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), f"{name}0")
    turn = 0
    while True:
        turn += 1
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        passed = labels.join(near, labels["node"] == near["a"], "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = scratch.write(passed.join(jump, "label", "left").select("node", "old", F.least("label", "further").alias("label")), f"{name}{turn}")
        if after.where(F.col("old") != F.col("label")).isEmpty():
            return after.select("node", "label")
        scratch.drop(f"{name}{turn - 1}")
        labels = after.select("node", "label")


def _linked(scratch: Scratch, docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(rows (row, doc_id, copy) of docs; groups (copy, label, copies) of equal texts under a doc_id)."""
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.unhex(F.md5(F.col("text"))).alias("copy"))
    known = cut.where(F.col("doc_id").isNotNull() & F.col("copy").isNotNull())
    first = F.min(F.struct("doc_id", "size", "tags", "bands", "heavy_tags", "heavy_bands")).alias("first")
    one = scratch.write(_signatures(known).groupBy("copy").agg(first).select("copy", "first.*"), "one")
    signatures = _either(one)
    pairs, dealt = candidates(scratch, signatures, threshold)
    pairs = scratch.write(pairs, "pairs")
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).union(dealt.select("doc_id")).distinct()
    sets = scratch.write(_shingle_sets(known, wanted, one), "sets")
    links = scratch.write(verified(sets, pairs, threshold), "verified")
    labels = components(scratch, links, "first")
    more = left_out(scratch, sets, pairs, dealt, labels, threshold)
    if more is not None:
        more = scratch.write(more, "more")
        if not more.isEmpty():
            labels = components(scratch, links.unionByName(more), "second")
    rows = scratch.write(cut.select(F.monotonically_increasing_id().alias("row"), "doc_id", "copy"), "rows")
    groups = rows.where(F.col("doc_id").isNotNull() & F.col("copy").isNotNull()).groupBy("copy").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"))
    return rows, _with_label(groups, labels, "node", "label").select("copy", "label", "copies")


def _classified(scratch: Scratch, docs: DataFrame, threshold: float) -> DataFrame:
    """(row, doc_id, copy, class_id, copies, kept), written.

    Joins on keys other than one number are merge joins here: each broadcast table of such keys keeps a page of tens of MB
    in every executor, however few rows it has.
    """
    rows, groups = _linked(scratch, docs, threshold)
    alone = F.col("copies").isNull() | F.col("doc_id").isNull()
    out = rows.join(groups.hint("merge"), "copy", "left").select("row", "doc_id", "copy", alone.alias("alone"), F.when(alone, F.col("doc_id")).otherwise(F.col("label")).alias("class_id"), F.when(alone, F.lit(1)).otherwise(F.col("copies")).cast("long").alias("copies"))
    out = scratch.write(out, "classes")
    first = out.where(~F.col("alone")).groupBy("class_id").agg(F.min(F.struct("doc_id", "row"))["row"].alias("kept_row")).select("kept_row")
    out = out.join(first, out["row"] == first["kept_row"], "left")
    return scratch.write(out.select("row", "doc_id", "copy", "class_id", "copies", (F.col("alone") | F.col("kept_row").isNotNull()).alias("kept")), "kept")


def classes(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row (doc_id, class_id, copies, kept) per row of docs(doc_id, text).

    Texts with a similarity of threshold or more, of five-word shingles as sets or weighted by their counts, are
    linked, equal texts always; a class is what links join, class_id its smallest doc_id; copies counts the rows
    of docs with exactly this text; kept marks one row of each class, of class_id. Null texts, and texts without words
    that have no equal, stand alone. A null doc_id stands alone with a null class and is kept. Repeated rows count as
    copies; texts that differ under one doc_id are compared each, but this doc_id's links hold for all of them whose
    smallest doc_id it is; other columns are ignored; no rows give no rows. The result is written to the shared folder.
    """
    scratch = Scratch(docs.sparkSession)
    try:
        result = scratch.write(_classified(scratch, docs, threshold).select("doc_id", "class_id", "copies", "kept"), "result")
    finally:
        scratch.close(keep="result")
    return result


def one_of_each(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of docs (all its columns) of which classes() keeps one for each class; also one of rows that repeat both
    doc_id and text. Rows that differ in other columns only count as repeated: any one of them stays."""
    scratch = Scratch(docs.sparkSession)
    try:
        rows = _classified(scratch, docs, threshold)
        # Of rows with equal id and text either none or one is kept, or each stands alone (null id or text).
        known = rows.where(F.col("doc_id").isNotNull() & F.col("copy").isNotNull())
        of = known.groupBy("doc_id", "copy").agg(F.max("kept").alias("kept"), F.count("*").alias("times"))
        decided = scratch.write(of.where(~F.col("kept") | (F.col("times") > 1)), "result")
    finally:
        scratch.close(keep="result")
    copy = F.unhex(F.md5(F.col("text")))
    marked = docs.withColumn("_copy", copy).withColumn("_id", F.col("doc_id").cast("long"))
    on = lambda d: (marked["_id"] == d["doc_id"]) & (marked["_copy"] == d["copy"])
    out = marked.join(decided.hint("merge"), on(decided), "left_anti").drop("_copy", "_id")
    again = decided.where("kept")
    if again.isEmpty():
        return out
    return out.unionByName(marked.join(again, on(again), "left_semi").dropDuplicates(["_id", "_copy"]).drop("_copy", "_id"))
