"""SentencePiece encoding and decoding: sampled segmentations by forward filtering and backward sampling.

A text (with the model's leading space) is a chain of blocks, each a run of spaces and the letters after it; no piece
spans two blocks, so the piece lattice of a text is the chain of its blocks' lattices. Forward weights are computed once
for each distinct block of a batch, all blocks side by side, one character position after the other; then a path of
every occurrence is drawn backwards. The random number at a position is a hash of the seed, the row's key and the
position, so a row's segmentation depends on nothing but its key, its text and the model.

A merge model only ranks its pieces. Their probabilities are then estimated from the corpus by expectation-maximisation
over the same lattices, once for each distinct block with its number of occurrences in all documents; the vocabulary and
the model file stay as they are. Expected counts are summed as whole numbers, so the estimate, and with it every
segmentation, doesn't depend on how the rows are dealt.

Characters without a piece fall back to their UTF-8 bytes, a literal U+2581 too, so decoding gives back every text.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetnet.llm.common import map_batches, stored

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SEED = 42
#: Characters of text that are encoded at a time, and of distinct blocks that are weighed at a time; a longer text is
#: encoded alone.
BATCH_CHARS, ESTIMATED_CHARS = 3_000_000, 500_000

#: Rounds of the estimate, characters of a block that are counted together (a longer one is counted in parts; it is encoded
#: as a whole), the share of an expected occurrence that counts, and the occurrences that every piece has besides.
EM_ROUNDS, COUNTED_CHARS, FINE, BESIDES = 2, 256, 1 << 12, 0.1

_BLOCK = re.compile(r" +[^ ]*|[^ ]+")
_FALLBACK = 65535
_NORMAL, _BYTE = 1, 6


class Pieces:
    """The model's pieces as a trie over characters, their weights and their bytes."""

    def __init__(self, model: str | bytes, alpha: float = 1.0, log_weights: np.ndarray | None = None) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(open(model, "rb").read() if isinstance(model, str) else model)
        named = [(i, p.piece.replace("▁", " "), p.score) for i, p in enumerate(proto.pieces) if p.type == _NORMAL]
        self.bytes = [b""] * len(proto.pieces)
        self.byte_id = np.zeros(256, dtype=np.int32)
        for i, p in enumerate(proto.pieces):
            if p.type == _BYTE:
                self.byte_id[int(p.piece[1:-1], 16)] = i
                self.bytes[i] = bytes([int(p.piece[1:-1], 16)])
        for i, piece, _ in named:
            self.bytes[i] = piece.encode()
        if len(proto.pieces) > _FALLBACK:
            raise ValueError(f"{len(proto.pieces)} pieces are more than the {_FALLBACK} that fit in two bytes")
        #: A unigram model's scores are log-probabilities; for a merge model, Zipf's law is where the estimate starts.
        self.unigram = proto.trainer_spec.model_type == 1
        logs = {i: s for i, _, s in named} if self.unigram else {i: -np.log(r + 2.0) for r, (i, _, _) in enumerate(sorted(named, key=lambda x: -x[2]))}
        self.named = np.array(sorted(logs), dtype=np.int64)
        self.weigh(np.array([logs[i] for i in self.named.tolist()]) if log_weights is None else log_weights, alpha)
        self.longest = max(len(p) for _, p, _ in named)
        self._trie([(p, i) for i, p, _ in named])

    def weigh(self, logs: np.ndarray, alpha: float = 1.0) -> None:
        """Set the weights of the pieces ``named`` to probabilities, in logarithms, to the power ``alpha``."""
        self.weight = np.zeros(_FALLBACK + 1)
        self.weight[self.named] = np.exp(alpha * logs)
        self.weight[_FALLBACK] = np.exp(alpha * (logs.min() - 10.0))

    def _trie(self, named: list[tuple[str, int]]) -> None:
        chars = sorted({c for p, _ in named for c in p})
        self.char_class = np.zeros(0x110000, dtype=np.int32)
        self.char_class[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.bits = len(chars).bit_length()
        nodes: dict[tuple[int, str], int] = {}
        ids = {0: 0}
        for piece, i in named:
            at = 0
            for c in piece:
                at = nodes.setdefault((at, c), len(nodes) + 1)
            ids[at] = i
        keys = np.array([(s << self.bits) | int(self.char_class[ord(c)]) for s, c in nodes], dtype=np.int64)
        values = np.array(list(nodes.values()), dtype=np.int32)
        self.piece = np.zeros(len(nodes) + 1, dtype=np.int32)
        self.piece[list(ids)] = list(ids.values())
        # Open addressing with a bounded number of probes; slot 0 of the values is "no such node".
        self.shift = 64 - (max(len(keys), 1) * 4).bit_length()
        size = 1 << (64 - self.shift)
        self.slot_key, self.slot_value, self.probes = np.full(size, -1, dtype=np.int64), np.zeros(size, dtype=np.int32), 1
        for k, v, h in zip(keys.tolist(), values.tolist(), self._hash(keys).tolist(), strict=True):
            step = 1
            while self.slot_key[h] >= 0:
                h, step = (h + 1) % size, step + 1
            self.slot_key[h], self.slot_value[h], self.probes = k, v, max(self.probes, step)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def step(self, state: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """The trie nodes after one more character; 0 where there is none."""
        keys = (state.astype(np.int64) << self.bits) | kind
        at = self._hash(keys)
        held = self.slot_key[at]
        out = np.where(held == keys, self.slot_value[at], 0)
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & (len(self.slot_key) - 1)
            held = self.slot_key[at[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.slot_value[at[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        out[kind == 0] = 0
        return out


class Lattices:
    """Forward-filtered lattices of distinct blocks. Nodes are numbered position by position; at each, the blocks come
    in descending length, so those that reach a position are always a prefix."""

    def __init__(self, pieces: Pieces, blocks: list[str]) -> None:
        lengths = np.fromiter(map(len, blocks), np.int64, len(blocks))
        order = np.argsort(-lengths, kind="stable")
        self.rank = np.empty(len(blocks), dtype=np.int64)
        self.rank[order] = np.arange(len(blocks))
        self.lengths = lengths
        flat = np.frombuffer("".join(blocks).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        kinds = pieces.char_class[flat]
        starts = (np.cumsum(lengths) - lengths)[order]
        sizes = lengths[order]
        deepest = int(sizes[0]) if len(sizes) else 0
        reach = np.searchsorted(-sizes, -np.arange(deepest + 1), side="right")  # blocks of at least j characters
        self.level = np.concatenate([[0], np.cumsum(reach)]).astype(np.int64)
        width = pieces.longest
        alphas: dict[int, np.ndarray] = {0: np.ones(len(blocks))}
        pending: dict[int, list] = defaultdict(list)
        window: dict[int, np.ndarray] = {}
        firsts, cums, spans, ids = [np.zeros(len(blocks), dtype=np.int64)], [], [], []
        edges = 0
        for s in range(deepest):
            for j in range(s, min(s + width, deepest)):
                if j not in window:
                    window[j] = kinds[starts[: reach[j + 1]] + j]
            at, state = np.arange(reach[s + 1]), np.zeros(reach[s + 1], dtype=np.int32)
            for n in range(1, min(width, deepest - s) + 1):
                alive = int(np.searchsorted(at, reach[s + n]))
                at, state = at[:alive], state[:alive]
                state = pieces.step(state, window[s + n - 1][at])
                there = np.flatnonzero(state)
                if n == 1:
                    single = np.full(reach[s + 1], _FALLBACK, dtype=np.int32)
                    own = pieces.piece[state]
                    single[own > 0] = own[own > 0]
                    pending[s + 1].append((s, 1, None, single))
                at, state = at[there], state[there]
                if n > 1:
                    own = pieces.piece[state]
                    ends = np.flatnonzero(own)
                    if len(ends):
                        pending[s + n].append((s, n, at[ends], own[ends]))
                if not len(at):
                    break
            window.pop(s)
            j, rows = s + 1, int(reach[s + 1])
            entries = sorted(pending.pop(j), key=lambda e: -e[1])
            value = np.zeros((rows, len(entries)))
            named = np.zeros((rows, len(entries)), dtype=np.uint16)
            for c, (src, _, who, what) in enumerate(entries):
                if who is None:
                    value[:, c], named[:, c] = alphas[src][:rows] * pieces.weight[what], what
                else:
                    value[who, c], named[who, c] = alphas[src][who] * pieces.weight[what], what
            sums = np.cumsum(value, axis=1)
            alpha = sums[:, -1].copy()
            mask = value > 0
            per = mask.sum(axis=1)
            cums.append((sums / alpha[:, None])[mask].astype(np.float32))
            ids.append(named[mask])
            spans.append(np.broadcast_to(np.array([e[1] for e in entries], dtype=np.uint8), mask.shape)[mask])
            firsts.append(edges + np.cumsum(per) - per)
            edges += int(per.sum())
            alphas[j] = alpha
            alphas.pop(j - width, None)
            scale = alpha.copy()
            if j % 8 == 0:  # only ratios count: keep the numbers in range
                for k in alphas:
                    alphas[k][:rows] /= scale
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, dtype=kind)
        self.first = join(firsts, np.int64)
        self.cum, self.span, self.id = join(cums, np.float32), join(spans, np.uint8), join(ids, np.uint16)
        self.last = np.append(self.first[1:], edges) - 1  # of a node's edges

    def expected(self, times: np.ndarray) -> np.ndarray:
        """How often each piece is expected in all paths of blocks that occur ``times``, in whole FINE parts."""
        deepest = len(self.level) - 2
        there = np.zeros(self.level[-1] if len(self.level) else 0)
        at = self.level[self.lengths] + self.rank
        there[at[self.lengths > 0]] = 1.0  # a path is at its block's end for certain
        counts = np.zeros(_FALLBACK + 1, dtype=np.int64)
        often = np.empty(len(times), dtype=np.float64)
        often[self.rank] = times
        for j in range(deepest, 0, -1):
            nodes = np.arange(self.level[j], self.level[j + 1])
            a, z = int(self.first[nodes[0]]), int(self.last[nodes[-1]]) + 1
            per = self.last[nodes] - self.first[nodes] + 1
            own = np.repeat(np.arange(len(nodes)), per)
            cum = self.cum[a:z].astype(np.float64)
            share = np.diff(cum, prepend=0.0)
            heads = self.first[nodes] - a
            share[heads] = cum[heads]
            share = np.maximum(share, 0.0) * there[nodes][own]
            np.add.at(there, self.level[j - self.span[a:z].astype(np.int64)] + own, share)
            np.add.at(counts, self.id[a:z], np.floor(share * often[own] * FINE + 0.5).astype(np.int64))
        return counts

    def sample(self, block: np.ndarray, key: np.ndarray, at: np.ndarray, out: np.ndarray, offset: np.ndarray) -> None:
        """Draw a path for each occurrence: ``block`` its number, ``key`` its row's key, ``at`` its end in its text and
        ``offset`` in the batch. A drawn piece is written to ``out`` at the offset of its last character."""
        i, j = self.rank[block], self.lengths[block]
        live = np.flatnonzero(j > 0)
        i, j, key, at, offset = i[live], j[live], key[live], at[live], offset[live]
        while len(i):
            node = self.level[j] + i
            u = uniform(key, at)
            edge, end = self.first[node], self.last[node]
            go = np.flatnonzero((u >= self.cum[edge]) & (edge < end))
            while len(go):
                edge[go] += 1
                go = go[(u[go] >= self.cum[edge[go]]) & (edge[go] < end[go])]
            out[offset - 1] = self.id[edge]
            n = self.span[edge].astype(np.int64)
            j, at, offset = j - n, at - n, offset - n
            more = np.flatnonzero(j > 0)
            if len(more) < len(j):
                i, j, key, at, offset = i[more], j[more], key[more], at[more], offset[more]


def uniform(key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A float32 in [0, 1) for each (key, position): SplitMix64's finaliser."""
    x = key + at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return (x >> np.uint64(40)).astype(np.float32) * np.float32(2**-24)


def blocks_of(text: str) -> list[str]:
    """The blocks of a text with the model's leading space."""
    if not text:
        return []
    if "  " in text or text[0] == " " or text[-1] == " ":
        return _BLOCK.findall(f" {text}")
    return [f" {w}" for w in text.split(" ")]


def encode(pieces: Pieces, texts: list[str], keys: np.ndarray) -> list[np.ndarray]:
    """The sampled piece ids of each text; an empty text has none. ``keys``: an unsigned 64-bit number for each."""
    number: dict[str, int] = defaultdict(count().__next__)
    found = [[number[b] for b in blocks_of(t)] for t in texts]
    per = np.fromiter(map(len, found), np.int64, len(found))
    block = np.fromiter((b for row in found for b in row), np.int64, int(per.sum()))
    del found
    lattices = Lattices(pieces, list(number))
    offset = np.cumsum(lattices.lengths[block])
    stop = np.cumsum(per)
    ends = np.append(0, offset)[stop]  # of each text in the batch
    begins = np.append(0, ends)[:-1]
    row = np.repeat(np.arange(len(texts)), per)
    out = np.full(int(ends[-1]) if len(ends) else 0, -1, dtype=np.int32)
    lattices.sample(block, keys[row], offset - begins[row], out, offset)
    del block, row, offset
    result = []
    for t, a, b in zip(texts, begins.tolist(), ends.tolist(), strict=True):
        drawn = out[a:b]
        at = np.flatnonzero(drawn >= 0)
        ids = drawn[at]
        fall = np.flatnonzero(ids == _FALLBACK)
        if len(fall):
            codes = np.frombuffer(f" {t}".encode("utf-32-le", "surrogatepass"), dtype="<u4")[at[fall]]
            if int(codes.max()) < 128:
                ids[fall] = pieces.byte_id[codes]
            else:
                spelled = [chr(c).encode("utf-8", "surrogatepass") for c in codes.tolist()]
                times = np.ones(len(ids), dtype=np.int64)
                times[fall] = [len(x) for x in spelled]
                ids = np.repeat(ids, times)
                ids[np.flatnonzero(ids == _FALLBACK)] = pieces.byte_id[np.frombuffer(b"".join(spelled), dtype=np.uint8)]
        result.append(ids)
    return result


def decode(pieces: Pieces, ids: list[int] | np.ndarray) -> str:
    """The text of piece ids: their bytes, less the model's leading space."""
    table = pieces.bytes
    return b"".join([table[i] for i in ids])[1:].decode("utf-8", "surrogatepass")


def row_keys(doc_ids: list, seed: int, texts: list[str | None]) -> np.ndarray:
    """A key for each row of its id; of a null id by its text."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.array([digest(str(d), seed) if d is not None else digest((t or "").encode("utf-8", "surrogatepass"), seed + 1) for d, t in zip(doc_ids, texts, strict=True)], dtype=np.uint64)


def block_counts(docs: DataFrame) -> DataFrame:
    """(block, n): the distinct blocks of all texts and how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[str] = Counter()
            for text in batch.column(0).to_pylist():
                found = blocks_of(text or "")
                if found and max(map(len, found)) > COUNTED_CHARS:
                    found = [b[k : k + COUNTED_CHARS] for b in found for k in range(0, len(b), COUNTED_CHARS)]
                seen.update(found)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["block", "n"])

    return map_batches(docs.select("text"), run, "block string, n bigint").groupBy("block").agg(F.sum("n").alias("n"))


def estimated(docs: DataFrame, blob: bytes, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Log-probabilities of the model's named pieces, from all texts of ``docs``; of a unigram model, its own.

    Each round sends the weights, a number for each piece, to the tasks and gets as many sums back.
    """
    pieces = Pieces(blob)
    logs = np.log(pieces.weight[pieces.named])
    if pieces.unigram:
        return logs
    spark, blocks = docs.sparkSession, stored(block_counts(docs))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((blob, logs))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, counts = Pieces(shared.value[0], log_weights=shared.value[1]), np.zeros(_FALLBACK + 1, dtype=np.int64)
            for batch in batches:
                texts = batch.column(0).to_pylist()
                sizes = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
                for at, n in _runs(sizes // ESTIMATED_CHARS):
                    counts += Lattices(own, texts[at : at + n]).expected(batch.column(1).to_numpy()[at : at + n])
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["piece", "n"])

        sums = map_batches(blocks, run, "piece bigint, n bigint").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()  # a row for each piece
        counts = np.zeros(_FALLBACK + 1)
        counts[sums["piece"].to_numpy(int)] = sums["n"].to_numpy() / FINE
        counts = counts[pieces.named] + BESIDES
        logs = np.log(counts / counts.sum())
        shared.unpersist()
    return logs


def encoded(docs: DataFrame, model: str = MODEL, seed: int = SEED, alpha: float = 1.0) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, ids array<int>, n_pieces, lossless (decodes to the text).

    Segmentations are drawn with the probabilities that ``estimated`` gives for ``docs``, to the power ``alpha``. Null
    texts have null ids, no pieces and are lossless; empty texts have no ids. Rows with equal id and text have equal
    ids; a row with a null id is keyed by its text. Other columns are ignored, an empty table gives an empty result. The
    model file is read on the driver only.
    """
    spark = docs.sparkSession
    blob = _model(spark, model)
    shared = spark.sparkContext.broadcast((blob, estimated(docs.select("text"), blob)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(shared.value[0], alpha, shared.value[1])
        for batch in batches:
            sizes = np.array([len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(1)], dtype=np.int64)
            group = np.cumsum(sizes) // BATCH_CHARS
            for at, n in _runs(group):
                part = batch.slice(at, n)
                texts = part.column(1).to_pylist()
                drawn = encode(pieces, [t or "" for t in texts], row_keys(part.column(0).to_pylist(), seed, texts))
                same = [decode(pieces, x) == (t or "") for x, t in zip(drawn, texts, strict=True)]
                ends = np.append(0, np.cumsum([len(x) for x in drawn])).astype(np.int32)
                flat = np.concatenate(drawn).astype(np.int32) if drawn else np.zeros(0, dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends, mask=np.append([t is None for t in texts], False)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(np.diff(ends).astype(np.int64)), pa.array(same)], names=["doc_id", "ids", "n_pieces", "lossless"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, ids array<int>, n_pieces bigint, lossless boolean")


def _model(spark, model: str) -> bytes:
    return b"".join(r[0] for r in spark.read.format("binaryFile").load(model).select("content").collect()) if "://" in model else open(model, "rb").read()


def _runs(group: np.ndarray) -> list[tuple[int, int]]:
    """(start, length) of each run of equal values."""
    edges = np.flatnonzero(np.diff(group)) + 1
    starts = np.append(0, edges)
    return [(int(a), int(b - a)) for a, b in zip(starts, np.append(edges, len(group)), strict=True)] if len(group) else []


def decoded(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of rows of doc_id and ids; null ids give a null text, no ids the empty text."""
    shared = rows.sparkSession.sparkContext.broadcast(_model(rows.sparkSession, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(shared.value)
        for batch in batches:
            texts = [None if x is None else decode(pieces, x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows.select("doc_id", F.col("ids")), run, f"doc_id {kind}, text string")
