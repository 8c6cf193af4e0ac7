"""Ordered removal of duplicates: a row goes if an earlier kept row has the same text or similar words."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.validate import duplicate_key
from skein.session import Scratch, ensure_importable, sliced


def exact_duplicates(rows: DataFrame, order: str, text_col: str = "text") -> DataFrame:
    """Adds first_of and is_duplicate: a smaller order value has the same text. Nothing is a duplicate of null."""
    keyed = rows.withColumn("_key", duplicate_key(F.col(text_col)))
    firsts = keyed.groupBy("_key").agg(F.min(order).alias("first_of"))
    joined = keyed.join(firsts, "_key", "left").drop("_key")
    first = F.coalesce(F.col("first_of"), F.col(order))
    return joined.withColumn("first_of", first).withColumn("is_duplicate", first < F.col(order))


def prefix_size(n: Column, threshold: Fraction) -> Column:
    """Words of a set of n, rarest first, of which a partner above the threshold has at least one among its own."""
    scaled = (n * threshold.numerator + (threshold.denominator - 1)).cast("long")
    least = F.floor((scaled - F.pmod(scaled, F.lit(threshold.denominator))) / threshold.denominator)
    return (n - least + 1).cast("int")


#: Turns in which leaders compares candidates with kept rows alone, at least, before it compares all that are left.
EAGER = 0

#: After these turns leaders goes on so until what is left makes at most so many pairs for each signature that there was: a turn
#: takes several jobs, whatever is left, and pairs in proportion to the input can be compared at once.
PAIRS_PER_SIGNATURE = 2

#: Words that go to one file, about.
FILE_WORDS = 2 << 20

#: Words are counted by so many buckets of their hashes: tasks get this many numbers, whatever the vocabulary.
BUCKETS = 1 << 18


#: With fewer words in a part than this, counts of words are worth a pass.
FEW_WORDS = 8


def size_classes(limit: Fraction, largest: int) -> list[int]:
    """Where classes of sizes up to largest start, then where two more would: sets that may be similar have sizes of one class or of
    two neighbouring ones."""
    p, q = limit.numerator, limit.denominator
    starts = [1]
    while starts[-1] <= largest:
        starts.append(max(starts[-1] + 1, -(-starts[-1] * q // p)) if p else largest + 1)
    return [*starts, max(starts[-1] + 1, -(-starts[-1] * q // p) if p else 0)]


def parts_of(limit: Fraction, largest: int) -> int:
    """Into how many parts words are dealt, so that two sets of up to largest words above the limit agree in at least one."""
    p, q = limit.numerator, limit.denominator
    return max(1, -(-(q - p) * 2 * largest // (p + q)))


def _signatures(sets: DataFrame, limit: Fraction) -> DataFrame:
    """(id, fresh, n, up, sign, previous): hashes of what sets(id, fresh, n, words) hold, n words joined by spaces. Two sets above the
    limit share a sign that is not up in both.

    Words are dealt by hash into one part more than such sets can differ in, so at least one part is the same in both; its sign
    holds the class of the larger set. up is true for signs of the class above a set's own, previous is the sign of the part
    before. Sets that have an empty part, where they may agree with any other, also have a sign for each of the words that
    prefix_size asks for, rarest first by the count of their hash's bucket (counted where parts are small, so that many are empty), then by hash."""
    spark = sets.sparkSession
    ensure_importable(spark)
    hashed = sets.select("id", "fresh", F.transform(F.split("words", " "), lambda w: F.xxhash64(w)).alias("hashes"), prefix_size(F.col("n"), limit).alias("size"))
    starts = np.array(size_classes(limit, sets.agg(F.max("n")).first()[0] or 0), dtype=np.int64)
    parts = np.array([parts_of(limit, int(after) - 1) for after in starts[1:]], dtype=np.int64)
    often = np.zeros(BUCKETS, dtype=np.int64)
    if limit.numerator + limit.denominator < 2 * FEW_WORDS * (limit.denominator - limit.numerator):
        counts = hashed.select(F.explode("hashes").alias("h")).groupBy(F.col("h").bitwiseAND(F.lit(BUCKETS - 1)).alias("bucket")).count().toArrow()
        often[np.asarray(counts["bucket"])] = np.asarray(counts["count"])
    sent = spark.sparkContext.broadcast(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            hashes = batch.column("hashes")
            n, word = np.asarray(hashes.value_lengths()).astype(np.int64), np.asarray(hashes.flatten())
            row, own = np.repeat(np.arange(len(n)), n), np.searchsorted(starts, n, side="right") - 1

            def rows(at: np.ndarray, up: bool, sign: np.ndarray, first: np.ndarray, batch=batch, n=n) -> pa.RecordBatch:
                sign, taken = sign.view(np.int64), pa.array(at)
                columns = [batch.column("id").take(taken), batch.column("fresh").take(taken), pa.array(n[at].astype(np.int32)), pa.array(np.full(len(at), up)), pa.array(sign), pa.array(np.roll(sign, 1), mask=first)]
                return pa.RecordBatch.from_arrays(columns, names=["id", "fresh", "n", "up", "sign", "previous"])

            mixed = mix64(word.view(np.uint64))
            place, value = (mixed >> np.uint64(33)).astype(np.int64), mix64(mixed + np.uint64(1))
            empty = np.zeros(len(n), dtype=bool)
            for up in (False, True):
                k = parts[own + up]
                start = np.cumsum(k) - k
                at = start[row] + place % k[row]
                total, held = np.zeros(k.sum(), dtype=np.uint64), np.bincount(at, minlength=k.sum()) > 0
                np.add.at(total, at, value)
                of, no = np.repeat(np.arange(len(n)), k), np.arange(len(total)) - np.repeat(start, k)
                sign = mix64(total ^ mix64((own[of] + up).astype(np.uint64) << np.uint64(32) | no.astype(np.uint64)))
                empty[of[~held]] = True
                # A part after an empty one comes first of its run.
                first = (no == 0) | ~np.roll(held, 1)
                keep = np.flatnonzero(held)
                yield rows(of[keep], up, sign[keep], first[keep])
            loose = empty[row]
            if loose.any():
                word, row = word[loose], row[loose]
                word = word[np.lexsort((word, sent.value[word & (BUCKETS - 1)], row))]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                keep = place < np.asarray(batch.column("size"))[row]
                row, word, first = row[keep], word[keep].view(np.uint64), place[keep] == 0
                for up in (False, True):
                    yield rows(row, up, mix64(word ^ mix64((own[row] + up + 1).astype(np.uint64) << np.uint64(48))), first)

    return hashed.mapInArrow(run, f"id {sets.schema['id'].dataType.simpleString()}, fresh boolean, n int, up boolean, sign long, previous long")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (wraps)."""
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _met(signed: DataFrame) -> DataFrame:
    """Rows whose sign another row has too, with the smallest of its ids as head; signs that are up in all their rows don't count."""
    by = Window.partitionBy("sign")
    held = signed.withColumn("_n", F.count(F.lit(1)).over(by)).withColumn("_down", F.bool_or(~F.col("up")).over(by)).withColumn("head", F.min("id").over(by))
    return held.where("_n > 1 AND _down").drop("_n", "_down")


def _paired(a: DataFrame, b: DataFrame, limit: Fraction, extra: Column | None = None) -> DataFrame:
    """(later, earlier, bucket), each once, with where it met: rows of a and of b that share a sign and have sizes near enough, a's id
    the larger. A pair that also shares the sign before is left to that one: so alike texts meet a few times, not once for each sign."""
    a, b = a.alias("a"), b.alias("b")
    near = (F.col("a.id") > F.col("b.id")) & ~(F.col("a.up") & F.col("b.up"))
    near &= F.least("a.n", "b.n").cast("long") * limit.denominator > F.greatest("a.n", "b.n").cast("long") * limit.numerator
    near &= F.coalesce(F.col("a.previous") != F.col("b.previous"), F.lit(True))
    meet = (F.col("a.sign") == F.col("b.sign")) & near & (F.lit(True) if extra is None else extra)
    return a.join(b, meet).select(F.col("a.id").alias("later"), F.col("b.id").alias("earlier"), F.col("a.sign").alias("bucket")).groupBy("later", "earlier").agg(F.min("bucket").alias("bucket"))


def _candidates(scratch: Scratch, sets: DataFrame, limit: Fraction) -> DataFrame:
    """(later, earlier, bucket), each once, with where it met: pairs of ids of sets(id, fresh, n, words) that may be similar, at least one of them fresh."""
    met = scratch.write(_met(_signatures(sets, limit)), "met")
    pairs = scratch.write(_paired(met, met, limit, F.col("a.fresh") | F.col("b.fresh")), "pairs")
    scratch.drop("met")
    return pairs


#: Pairs that are compared in one group, about: words go there once for each of its texts, not for each of its pairs.
GROUP_PAIRS = 4096


def _verified(scratch: Scratch, pairs: DataFrame, sets: DataFrame, limit: Fraction, name: str) -> DataFrame:
    """(later, earlier, similarity) of pairs(later, earlier, bucket), a stored table, above the limit. Pairs of one bucket, which are
    of alike texts, are compared in one group; a bucket of more than GROUP_PAIRS is dealt over groups by both ids."""
    groups = max(1, -(-pairs.count() // GROUP_PAIRS))
    large = pairs.groupBy("bucket").count().where(F.col("count") > GROUP_PAIRS).select("bucket", F.ceil(F.sqrt(F.col("count") / GROUP_PAIRS)).alias("parts"))
    part = [F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64(c), F.col("parts"))) for c in ("later", "earlier")]
    dealt = pairs.join(F.broadcast(large), "bucket", "left").select("later", "earlier", F.pmod(F.xxhash64("bucket", *part), F.lit(groups)).alias("group"))
    used = dealt.select("group", F.col("later").alias("id")).union(dealt.select("group", "earlier")).distinct()
    texts = used.join(sets.select("id", "words"), "id").select(F.col("group").alias("of"), "id", "words")
    numerator, denominator = limit.numerator, limit.denominator

    def compare(met: pa.Table, texts: pa.Table) -> pa.Table:
        words = pc.split_pattern(texts["words"].combine_chunks(), " ")
        start, n = np.asarray(words.offsets)[:-1].astype(np.int64), np.asarray(words.value_lengths()).astype(np.int64)
        known = words.flatten().dictionary_encode()
        word, mark = np.asarray(known.indices), np.zeros(len(known.dictionary), dtype=bool)
        later, earlier = (pc.index_in(met[c], value_set=texts["id"]).to_numpy().astype(np.int64) for c in ("later", "earlier"))
        both, order = np.zeros(len(later), dtype=np.int64), np.argsort(later, kind="stable")
        for run in np.split(order, np.flatnonzero(np.diff(later[order])) + 1) if len(order) else ():
            own = word[start[later[run[0]]] : start[later[run[0]]] + n[later[run[0]]]]
            mark[own] = True
            sizes = n[earlier[run]]
            first = np.cumsum(sizes) - sizes
            at = np.repeat(start[earlier[run]] - first, sizes) + np.arange(sizes.sum())
            both[run] = np.add.reduceat(mark[word[at]].astype(np.int64), first)
            mark[own] = False
        union = n[later] + n[earlier] - both
        kept = both * denominator > union * numerator
        return met.select(["later", "earlier"]).filter(pa.array(kept)).append_column("similarity", pa.array((both / np.maximum(union, 1))[kept]))

    kind = sets.schema["id"].dataType.simpleString()
    found = dealt.groupBy("group").cogroup(texts.groupBy("of")).applyInArrow(compare, f"later {kind}, earlier {kind}, similarity double")
    return scratch.write(found, name)


#: White space beyond ASCII.
WIDE_SPACE = "[\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def _split(texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(n, words, key) of lower-cased texts: how many distinct words they hold between white space, these in order joined by spaces, and their digest."""
    if pc.any(pc.match_substring_regex(texts, WIDE_SPACE)).as_py():
        texts = pc.replace_substring_regex(texts, WIDE_SPACE, " ")
    found = pc.ascii_split_whitespace(texts)
    row, known = np.repeat(np.arange(len(texts)), np.asarray(found.value_lengths())), found.flatten().dictionary_encode()
    order = pc.array_sort_indices(known.dictionary)
    rank = np.empty(len(order), dtype=np.int64)
    rank[np.asarray(order)] = np.arange(len(order))
    filled = np.asarray(pc.greater(pc.binary_length(known.dictionary), 0).cast("uint8")).astype(bool)
    at = np.asarray(known.indices)
    wide = max(1, len(order))
    row, at = np.divmod(np.unique(row[filled[at]] * wide + rank[at[filled[at]]]), wide)
    n = np.bincount(row, minlength=len(texts))
    words = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), known.dictionary.take(order).take(pa.array(at)))
    words = pc.binary_join(words, " ")
    keys = [hashlib.sha256(w.as_buffer()).hexdigest() if k else None for w, k in zip(words, n, strict=True)]
    return pa.array(n, pa.int32()), words, pa.array(keys, pa.string())


def _word_sets(rows: DataFrame) -> DataFrame:
    """(id, fresh, n, words, key) of rows(id, fresh, text): n distinct words, joined by spaces, as none holds one (a third of an array's
    size in a shuffle); under key texts count as the same: by their words, if there are any. Rows of equal words are as similar
    to any third row as the first of them, so only that one is compared."""
    ensure_importable(rows.sparkSession)
    blank = F.when(~F.coalesce(F.col("text"), F.lit("")).rlike(r"(?U)\S"), duplicate_key(F.col("text")))
    taken = rows.select("id", "fresh", F.lower(F.coalesce(F.col("text"), F.lit(""))).alias("text"), blank.alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            n, words, key = _split(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("fresh"), n, words, pc.coalesce(key, batch.column("key"))], names=["id", "fresh", "n", "words", "key"])

    return taken.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fresh boolean, n int, words string, key string")


def near_pairs(rows: DataFrame, order: str, threshold: str = "0.95", text_col: str = "text", fresh: Column | None = None) -> DataFrame:
    """(later, earlier, similarity): pairs whose word sets have a Jaccard similarity strictly above threshold.

    Rows of equal sets are compared as one; their pairs are made from what is found. fresh: only pairs whose later row is so.
    Null texts and texts without words have no pairs; order must be unique. The result is written to the shared folder.
    """
    limit = Fraction(threshold)
    scratch = Scratch(rows.sparkSession)
    try:
        new = F.lit(True) if fresh is None else fresh
        every = scratch.write(_word_sets(rows.select(F.col(order).alias("id"), new.alias("fresh"), F.col(text_col).alias("text"))).where("n > 0"), "every")
        classes = every.groupBy("key").agg(F.min("id").alias("first"), F.bool_or("fresh").alias("any"))
        members = scratch.write(every.select("key", "id", "fresh").join(classes, "key").drop("key"), "members")
        firsts = members.where(F.col("id") == F.col("first")).select("id", F.col("any").alias("fresh"))
        sets = scratch.write(every.select("id", "n", "words").join(firsts, "id"), "sets")
        scratch.drop("every")
        found = _verified(scratch, _candidates(scratch, sets, limit), sets, limit, "found")
        if limit < 1:
            alike = members.groupBy("first").count().where(F.col("count") > 1).select(F.col("first").alias("later"), F.col("first").alias("earlier"), F.lit(1.0).alias("similarity"))
            found = found.union(alike)
        one, other = members.select(F.col("first").alias("later"), F.col("id").alias("i"), F.col("fresh").alias("f")), members.select(F.col("first").alias("earlier"), F.col("id").alias("j"), F.col("fresh").alias("g"))
        both = found.join(one, "later").join(other, "earlier")
        # Of one class each two members come both ways round; of two classes, once.
        both = both.where(((F.col("later") != F.col("earlier")) | (F.col("i") > F.col("j"))) & F.when(F.col("i") > F.col("j"), F.col("f")).otherwise(F.col("g")))
        return scratch.write(both.select(F.greatest("i", "j").alias("later"), F.least("i", "j").alias("earlier"), "similarity"), "result")
    finally:
        scratch.close(keep="result")


def word_sets(rows: DataFrame, order: str, text_col: str = "text") -> DataFrame:
    """(order, n, words, key) of rows, written to the shared folder: leaders takes them for rows and for seen, so that texts that
    several calls compare are split into words once."""
    scratch = Scratch(rows.sparkSession)
    try:
        return scratch.write(_word_sets(rows.select(F.col(order).alias("id"), F.lit(True).alias("fresh"), F.col(text_col).alias("text"))).drop("fresh").withColumnRenamed("id", order), "result")
    finally:
        scratch.close(keep="result")


def leaders(rows: DataFrame, order: str, threshold: str = "0.95", text_col: str | None = "text", seen: DataFrame | None = None) -> DataFrame:
    """Adds is_duplicate: an earlier kept row has the same text, or a similarity strictly above threshold.

    order must be unique and not null. Rows are decided in turns: a row that is the smallest under all its signs is kept, since
    no kept one was its neighbour, and is compared with all others under them; then it and its neighbours leave. The smallest row is decided in
    each turn, so turns end. A turn compares at most as many pairs as there are signs, so pairs within a group of alike
    texts are never written; what is left of unlike texts is compared at once when it makes few pairs, or turns bring little.
    seen(order, text) are rows that earlier calls kept, with smaller order values: they stay kept, so that a stream of
    batches is decided as all its rows at once. With text_col None, rows and seen are of word_sets instead.
    """
    limit = Fraction(threshold)
    scratch = Scratch(rows.sparkSession)
    try:
        taken = ["n", "words", "key"] if text_col is None else [F.col(text_col).alias("text")]
        given = rows.select(F.col(order).alias("id"), F.lit(True).alias("fresh"), *taken)
        if seen is not None:
            given = seen.select(F.col(order).alias("id"), F.lit(False).alias("fresh"), *taken).unionByName(given)
        every = given if text_col is None else scratch.write(_word_sets(given), "every")
        keyed = every.where(F.col("key").isNotNull()).select("id", "key")
        gone = [scratch.write(keyed.join(keyed.groupBy("key").agg(F.min("id").alias("id")).select("id"), "id", "left_anti").select("id"), "same")]
        sets = every.where("n > 0").select("id", "fresh", "n", "words")
        met = scratch.write(_met(_signatures(sets.join(gone[0], "id", "left_anti"), limit)), "met0")
        # Only the words of rows that meet any other are read again: these are dealt by id once, so that no join moves them a second time.
        some = met.select("id", "n").distinct()
        total = some.agg(F.sum("n")).first()[0] or 0
        sets = scratch.write_bucketed(sets.join(some.select("id"), "id", "left_semi"), max(8, -(-total // FILE_WORDS)), "id")
        if seen is not None:
            # Earlier calls have compared their rows among themselves.
            old = met.where(~F.col("fresh"))
            pairs = scratch.write(_paired(met.where("fresh"), old, limit), "seen")
            gone.append(_verified(scratch, pairs, sets, limit, "old").select(F.col("later").alias("id")))
            met = scratch.write(_met(met.where("fresh").drop("head").join(gone[-1], "id", "left_anti")), "met1")
        turn, most, before = 0, None, math.inf
        while True:
            n, left = met.groupBy("sign").count().agg(F.sum("count"), F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()
            if not n:
                break
            most = most or n * PAIRS_PER_SIGNATURE
            if turn >= EAGER and (left <= most or left > 0.9 * before):
                gone.append(_resolved(scratch, met, sets, limit))
                break
            before, turn = left, turn + 1
            ready = met.groupBy("id").agg(F.bool_and(F.col("id") == F.col("head")).alias("ready")).where("ready").select("id")
            ready = scratch.write(ready, f"ready{turn}")
            pairs = scratch.write(_paired(met, met.join(ready, "id", "left_semi"), limit), f"pairs{turn}")
            gone.append(_verified(scratch, pairs, sets, limit, f"found{turn}").select(F.col("later").alias("id")))
            met = scratch.write(_met(met.drop("head").join(ready.union(gone[-1]), "id", "left_anti")), f"left{turn}")
        gone = scratch.write(reduce(DataFrame.union, gone).distinct(), "gone")
        return rows.join(gone.select(F.col("id").alias(order), F.lit(True).alias("is_duplicate")), order, "left").withColumn("is_duplicate", F.coalesce("is_duplicate", F.lit(False)))
    finally:
        scratch.close(keep="gone")


def _resolved(scratch: Scratch, met: DataFrame, sets: DataFrame, limit: Fraction) -> DataFrame:
    """(id) of the rows of met that go, if all their pairs are compared first and then decided in turns."""
    edges = _verified(scratch, scratch.write(_paired(met, met, limit), "pairs"), sets, limit, "edges").select("later", "earlier")
    state = edges.select(F.col("later").alias("id")).union(edges.select("earlier")).distinct().withColumn("kept", F.lit(None).cast("boolean"))
    state, turn = scratch.write(state, "state0"), 0
    while not state.where(F.col("kept").isNull()).isEmpty():
        turn += 1
        known = edges.join(state.select(F.col("id").alias("earlier"), "kept"), "earlier")
        by = known.groupBy(F.col("later").alias("id")).agg(F.bool_or(F.coalesce("kept", F.lit(False))).alias("hit"), F.bool_or(F.col("kept").isNull()).alias("open"))
        decided = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("hit"), False).when(F.coalesce("open", F.lit(False)), None).otherwise(True)
        state = scratch.write(state.join(by, "id", "left").select("id", decided.alias("kept")), f"state{turn}")
    return state.where(~F.col("kept")).select("id")
