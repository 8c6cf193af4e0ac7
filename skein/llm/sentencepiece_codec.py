"""SentencePiece encoding and decoding: the segmentation of greatest total piece score, by a max-plus parallel scan.

Texts are cut into segments that no piece can join. Giant texts are cut into chunks; each chunk gives a matrix of
best scores from every boundary state on its left (characters that a piece from the left already took) to every
one on its right (characters that its last piece takes beyond it). Matrices combine associatively under max and
plus, which gives the best score to each state before each chunk. With these, each chunk finds by itself from which state
on its left the path to each state on its right comes; these maps are followed from the end, and each chunk is traced back
by itself between its two states. Of equal scores the path with the longest last piece wins, then with the longest one
before it, and so on, in chunks as in one go.
"""

from __future__ import annotations

import hashlib
import re
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import map_batches
from skein.session import Scratch

SPACE = "▁"
#: Stands for U+2581 of the text itself while it is encoded: a lone surrogate, which no text has.
LITERAL = "\udfff"
UNKNOWN_PENALTY = 10.0
#: Segments that a process remembers, and those that are found together.
KNOWN, TOGETHER = 400_000, 4096


class Model:
    """Pieces with scores from a .model file. A character that is no piece goes as its UTF-8 bytes."""

    def __init__(self, raw: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(raw)
        self.pieces: dict[str, tuple[float, int]] = {}
        self.bytes_id: dict[int, int] = {}
        self.surface: list[bytes] = []
        for i, p in enumerate(proto.pieces):
            self.surface.append(b"")
            if p.type == p.NORMAL or p.type == p.USER_DEFINED:
                self.pieces[p.piece] = (p.score, i)
                self.surface[i] = p.piece.replace(SPACE, " ").encode()
            elif p.type == p.BYTE:
                self.bytes_id[int(p.piece[3:5], 16)] = i
                self.surface[i] = bytes([int(p.piece[3:5], 16)])
        self.longest = max(map(len, self.pieces))
        self.unknown = min(s for s, _ in self.pieces.values()) - UNKNOWN_PENALTY
        inner = [p for p in self.pieces if SPACE in p.lstrip(SPACE)]
        if inner:
            raise ValueError(f"pieces with white space after other characters: {inner[:3]}")
        self.begin = {p[:i]: float("-inf") for p in self.pieces for i in range(1, len(p))} | {p: x for p, (x, _) in self.pieces.items()}
        self.known: dict[str, tuple[float, bytes]] = {}

    @cached_property
    def segment(self) -> re.Pattern[str]:
        """Runs of white space with what follows; line ends by themselves if no piece holds one."""
        end = "" if any("\n" in p for p in self.pieces) else "\n"
        return re.compile(f"{SPACE}+[^{SPACE}{end}]*|[^{SPACE}{end}]+" + (f"|{end}+" if end else ""))

    def prepare(self, text: str) -> str:
        return (SPACE + text.replace(SPACE, LITERAL).replace(" ", SPACE)) if text else ""

    def best(self, s: str, start: int, core: int, given: list[float] | None = None) -> tuple[list[float], list[int]]:
        """Best score to each position from start, and where its last piece starts (ties: the longest piece).

        Only pieces that start before core count. given: scores that the first positions have from pieces that start
        earlier, which win ties.
        """
        n, never, begin = len(s), float("-inf"), self.begin
        score, back = [never] * (n + 1), [-1] * (n + 1)
        if given is None:
            score[start] = 0.0
        else:
            score[: len(given)] = given[: n + 1]
            score = score[: n + 1]
        for i in range(start, core):
            if (here := score[i]) == never:
                continue
            end = i + 1
            # What each beginning of a piece scores: nothing unless it is a piece itself.
            gain = begin.get(s[i:end])
            if (total := here + (self.unknown if gain is None or gain == never else gain)) > score[end]:
                score[end], back[end] = total, i
            while gain is not None and end < n:
                end += 1
                if (gain := begin.get(s[i:end])) is not None and here + gain > score[end]:
                    score[end], back[end] = here + gain, i
        return score, back

    def trace(self, s: str, back: list[int], start: int, end: int) -> bytes:
        ids: list[int] = []
        while end > start:
            piece = s[back[end] : end]
            if found := self.pieces.get(piece):
                ids.append(found[1])
            else:
                raw = (SPACE if piece == LITERAL else piece).encode("utf-8", "surrogatepass")
                ids += [self.bytes_id[b] for b in reversed(raw)]
            end = back[end]
        return np.array(ids[::-1], "<u4").tobytes()

    def whole(self, s: str) -> tuple[float, bytes]:
        """Score and ids of a segment, remembered if short."""
        if (found := self.known.get(s)) is None:
            score, back = self.best(s, 0, len(s))
            found = score[-1], self.trace(s, back, 0, len(s))
            if len(s) <= 64:
                if len(self.known) > KNOWN:
                    self.known.clear()
                self.known[s] = found
        return found

    @cached_property
    def steps(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Steps from one beginning of a piece to the next, by (number of the first, character) in order; the numbers they lead to;
        what each beginning scores."""
        number = {b: i for i, b in enumerate(["", *self.begin])}
        keys = np.array([number[b[:-1]] << 21 | ord(b[-1]) for b in self.begin], dtype=np.int64)
        order = np.argsort(keys)
        return keys[order], order + 1, np.array([float("-inf"), *self.begin.values()])

    def learn(self, segments: set[str]) -> None:
        """Remember the short ones of segments: many are found together, one place of all after another, as best finds each."""
        new = [s for s in segments if len(s) <= 64 and s not in self.known]
        if len(self.known) + len(new) > KNOWN:
            self.known.clear()
            new = [s for s in segments if len(s) <= 64]
        new.sort(key=len)
        for at in range(0, len(new), TOGETHER):
            block = new[at : at + TOGETHER]
            if len(block) < TOGETHER // 32:
                break  # whole finds few sooner
            for s, score, back in zip(block, *self._best_of(block), strict=True):
                self.known[s] = score, self.trace(s, back, 0, len(s))

    def _best_of(self, block: list[str]) -> tuple[list[float], list[list[int]]]:
        """Best score of each segment, in order of length, and where the last pieces to its positions start."""
        keys, to, gains = self.steps
        n = np.array([len(s) for s in block])
        longest = int(n[-1])
        chars = np.frombuffer("".join([s.ljust(longest, "\0") for s in block]).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(block), longest).astype(np.int64)
        score = np.full((len(block), longest + 1), -np.inf)
        score[:, 0] = 0.0
        back = np.full(score.shape, -1, dtype=np.int16)
        for i in range(longest):
            row = np.arange(np.searchsorted(n, i, side="right"), len(block))
            state, end = np.zeros(len(row), dtype=np.int64), i
            # What is written beyond a segment's end is never read.
            while len(row) and end < longest:
                wanted = state << 21 | chars[row, end]
                at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                found = keys[at] == wanted
                gain = np.where(found, gains[to[at]], -np.inf)
                end += 1
                if end == i + 1:
                    gain[gain == -np.inf] = self.unknown
                total = score[row, i] + gain
                better = total > score[row, end]
                score[row[better], end], back[row[better], end] = total[better], i
                row, state = row[found], to[at[found]]
        return score[np.arange(len(block)), n].tolist(), back.tolist()

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text in one go."""
        return self.encoded(self.segment.findall(self.prepare(text or "")))

    def encoded(self, parts: list[str]) -> np.ndarray:
        known = self.known.get
        return np.frombuffer(b"".join([(known(p) or self.whole(p))[1] for p in parts]), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.surface.__getitem__, ids.tolist()))
        return raw.removeprefix(b" ").decode("utf-8", "replace")

    # Chunks of a prepared text: `s` is the chunk and `longest - 1` characters after it, `core` its own length.

    def _edges(self, s: str, core: int) -> tuple[int, int]:
        """Where the first segment that begins inside the chunk starts, and the last one; core, if none does."""
        starts = [m.start() for m in self.segment.finditer(s[:core])]
        inner = [i for i in starts if i > 0]
        return (inner[0], inner[-1]) if inner else (core, core)

    def transfer(self, s: str, core: int) -> np.ndarray:
        """matrix[k, m]: best score from k characters into the chunk to m characters beyond its end."""
        k = self.longest
        out = np.full((k, k), -np.inf)
        first, last = self._edges(s, core)
        if first == core:
            for i in range(min(k, core + 1)):
                score, _ = self.best(s, i, core)
                reach = score[core : core + k]
                out[i, : len(reach)] = reach
            for i in range(core + 1, k):
                out[i, i - core] = 0.0
            return out
        middle = sum(self.whole(p)[0] for p in self.segment.findall(s[first:last]))
        tail = self.best(s[last:], 0, core - last)[0][core - last : core - last + k]
        for i in range(min(k, first + 1)):
            head = self.best(s[:first], i, first)[0][first]
            out[i, : len(tail)] = head + middle + np.array(tail)
        return out

    def lefts(self, s: str, core: int, before: np.ndarray) -> list[int]:
        """By state on the right, the state on the left of the best path to it, where before has the best score to each
        state on the left."""
        first, _ = self._edges(s, core)
        end = core if first == core else first
        score, back = self.best(s[: first if first < core else len(s)], 0, end, before[: end + self.longest].tolist())

        def origin(at: int) -> int:
            while at < len(back) and back[at] >= 0:
                at = back[at]
            return at

        if first < core:
            # The first segment that begins in the chunk begins on every path.
            return [origin(first)] * self.longest
        # A state beyond a short chunk may come from before it; a state that no path reaches stands for itself.
        return [origin(core + m) if core + m < len(score) else 0 for m in range(self.longest)]

    def between(self, s: str, core: int, k: int, m: int) -> bytes:
        """Ids of the chunk's best path from state k to state m."""
        first, last = self._edges(s, core)
        if first == core:
            if k >= core:
                return b""
            return self.trace(s, self.best(s, k, core)[1], k, core + m)
        head, tail = s[:first], s[last:]
        ids = [self.trace(head, self.best(head, k, first)[1], k, first)]
        ids += [self.whole(p)[1] for p in self.segment.findall(s[first:last])]
        ids.append(self.trace(tail, self.best(tail, 0, core - last)[1], 0, core - last + m))
        return b"".join(ids)


#: Models of this process by the hash of their file: a Python worker keeps what it knows from task to task.
_MODELS: dict[str, Model] = {}


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def scan(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """All prefix products, in a logarithmic number of rounds of independent products."""
    out, step = list(matrices), 1
    while step < len(out):
        out = out[:step] + [combine(out[i - step], out[i]) for i in range(step, len(out))]
        step *= 2
    return out


def befores(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """The best score from state 0 to each state before each chunk."""
    return [np.where(np.arange(len(matrices[0])) == 0, 0.0, -np.inf), *(m[0] for m in scan(matrices))][:-1]


def states(lefts: list[list[int]]) -> list[tuple[int, int]]:
    """(state on the left, state on the right) of each chunk on the best path, from its maps of states."""
    right, out = 0, []
    for left_of in reversed(lefts):
        out.append((left_of[right], right))
        right = left_of[right]
    return out[::-1]


def chunked(model: Model, text: str, size: int, search: int = 1024) -> list[tuple[str, int]]:
    """(chunk with what follows, its own length): cut where a segment begins among the last `search` characters, which saves
    work, else anywhere, which changes nothing."""
    s, out, at = model.prepare(text), [], 0
    while at < len(s):
        end = min(at + size, len(s))
        if end < len(s):
            begins = [m.start() for m in model.segment.finditer(s, max(at + 1, end - search), end)]
            if len(begins) > 1:
                end = begins[-1]
        out.append((s[at : end + model.longest - 1], end - at))
        at = end
    return out


def codec(docs: DataFrame, model_bytes: bytes, chunk_chars: int = 65_536, with_ids: bool = False) -> DataFrame:
    """One row (doc_id, n_chars, n_ids, ids_sha256, decoded_sha256, round_trip[, ids]) per row of docs(doc_id, text).

    ids_sha256 is that of the ids as little-endian 32-bit numbers, decoded_sha256 that of the decoded text; ids is
    added if asked for. Texts longer than chunk_chars are encoded chunk by chunk in separate tasks. Null and empty
    texts have no ids and decode to an empty text; U+2581 and unknown characters go as bytes. Chunks give the ids of
    one go (exactly so where sums of scores are exact, as for scores that are whole numbers). Repeated rows give repeated
    results; other columns are ignored; no rows give no rows. What giant texts need is written to the shared folder.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model_bytes)
    digest = hashlib.sha256(model_bytes).hexdigest()
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_chars long, n_ids long, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", ids binary" * with_ids

    def model() -> Model:
        return _MODELS.get(digest) or _MODELS.setdefault(digest, Model(shared.value))

    def result(m: Model, text: str, ids: np.ndarray) -> tuple:
        decoded = m.decode(ids)
        raw = ids.tobytes()
        return len(text), len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), decoded == text, *[raw] * with_ids

    names = ["n_chars", "n_ids", "ids_sha256", "decoded_sha256", "round_trip"] + ["ids"] * with_ids

    def small(batch):
        m = model()
        texts = [t or "" for t in batch["text"].to_pylist()]
        parts = [m.segment.findall(m.prepare(t)) for t in texts]
        m.learn(set().union(*parts))
        rows = [result(m, t, m.encoded(p)) for t, p in zip(texts, parts, strict=True)]
        return {"doc_id": batch["doc_id"]} | {n: [r[i] for r in rows] for i, n in enumerate(names)}

    def cut(batch):
        out = {"row": [], "doc_id": [], "no": [], "chunk": [], "core": []}
        for row, doc_id, text in zip(*(batch[c].to_pylist() for c in ("row", "doc_id", "text")), strict=True):
            for no, (chunk, core) in enumerate(chunked(model(), text, chunk_chars)):
                for c, v in zip(out, (row, doc_id, no, chunk.encode("utf-8", "surrogatepass"), core), strict=True):
                    out[c].append(v)
        return out

    def chunks_of(batch) -> list[str]:
        return [x.decode("utf-8", "surrogatepass") for x in batch["chunk"].to_pylist()]

    def matrices(batch):
        m = model()
        found = [m.transfer(s, core).tobytes() for s, core in zip(chunks_of(batch), batch["core"].to_pylist(), strict=True)]
        return {"row": batch["row"], "no": batch["no"], "matrix": found}

    def scanned(table: pa.Table) -> pa.Table:
        table = table.sort_by("no")
        k = model().longest
        found = befores([np.frombuffer(x).reshape(k, k) for x in table["matrix"].to_pylist()])
        return pa.table({"row": table["row"], "no": table["no"], "before": pa.array([x.tobytes() for x in found], pa.binary())})

    def lefts(batch):
        m = model()
        found = [m.lefts(s, core, np.frombuffer(x)) for s, core, x in zip(chunks_of(batch), batch["core"].to_pylist(), batch["before"].to_pylist(), strict=True)]
        return {"row": batch["row"], "no": batch["no"], "lefts": found}

    def choose(table: pa.Table) -> pa.Table:
        table = table.sort_by("no")
        found = states(table["lefts"].to_pylist())
        return pa.table({"row": table["row"], "no": table["no"], "left": pa.array([x for x, _ in found], pa.int32()), "right": pa.array([y for _, y in found], pa.int32())})

    def trace(batch):
        m = model()
        ids = [m.between(*x) for x in zip(chunks_of(batch), *(batch[c].to_pylist() for c in ("core", "left", "right")), strict=True)]
        text = [s[:core].encode("utf-8", "surrogatepass") for s, core in zip(chunks_of(batch), batch["core"].to_pylist(), strict=True)]
        return {"row": batch["row"], "no": batch["no"], "doc_id": batch["doc_id"], "ids": ids, "text": text}

    def gather(table: pa.Table) -> pa.Table:
        table = table.sort_by("no")
        prepared = b"".join(table["text"].to_pylist()).decode("utf-8", "surrogatepass")
        text = prepared[1:].replace(SPACE, " ").replace(LITERAL, SPACE)
        row = result(model(), text, np.frombuffer(b"".join(table["ids"].to_pylist()), "<u4"))
        return pa.table({"doc_id": table["doc_id"].slice(0, 1)} | {n: pa.array([v], pa.int64() if n.startswith("n_") else None) for n, v in zip(names, row, strict=True)})

    giant = F.length("text") > chunk_chars
    short = map_batches(docs.select("doc_id", "text").where(~giant | F.col("text").isNull()), small, schema)
    scratch = Scratch(spark)
    try:
        numbered = docs.select("doc_id", "text").where(giant).withColumn("row", F.monotonically_increasing_id())
        chunks = map_batches(numbered.select("row", "doc_id", "text"), cut, f"row long, doc_id {id_type}, no long, chunk binary, core long")
        chunks = scratch.write(chunks.repartition("row", "no"), "chunks")
        before = map_batches(chunks.select("row", "no", "chunk", "core"), matrices, "row long, no long, matrix binary").groupBy("row").applyInArrow(scanned, "row long, no long, before binary")
        before = scratch.write(before, "before")
        chosen = map_batches(chunks.join(before, ["row", "no"]), lefts, "row long, no long, lefts array<int>").groupBy("row").applyInArrow(choose, "row long, no long, left int, right int")
        traced = map_batches(chunks.join(chosen, ["row", "no"]), trace, f"row long, no long, doc_id {id_type}, ids binary, text binary")
        long = scratch.write(traced.groupBy("row").applyInArrow(gather, schema), "result")
    finally:
        scratch.close(keep="result")
    return short.unionByName(long)
