"""Masked pseudo-likelihood scores from a bidirectional window network.

The network predicts every token from the tokens on both sides of it. Words
are counted over the whole corpus; the commonest get slots of their own, the
rest share hashed slots, and the number of slots grows with the cube root of
the number of tokens. A word's probability is its slot's, predicted by the
network from the window, spread evenly over the slot's distinct words. The
softmax over slots has two levels, a group of slots and the slot in it, and
both look at the window.

Documents are dealt into shards of about equal length by a hash. Every shard
trains a copy of the network on its own tokens; the copies are averaged with
the numbers of their targets as weights, and the next round starts from the
average. Over all rounds each token is a target once. Neither shards nor the
order in them or of the averaging depend on how the input is partitioned.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopforge.llm.support import cut, groups_of, small, table, texts

#: Slots per cube root of the tokens, one hashed slot in so many, fewest slots of words.
PER_ROOT, HASHED, FEWEST = 4, 5, 64
#: Embedding and hidden width, tokens on each side.
WIDTH, HIDDEN, SIDE = 8, 15, 2
#: Rounds of training, targets per step, step size, and tokens per shard.
ROUNDS, BATCH, RATE, SHARD_TOKENS = 2, 4096, 0.05, 4_000_000
#: Tokens scored at once, words that a worker remembers the slots of before it starts anew.
STRETCH, KNOWN = 1 << 13, 500_000
#: Parameters that are averaged together, and copies that one task adds up.
SLICE, COPIES = 1 << 15, 256
#: Places of a window around its target.
AROUND = [*range(-SIDE, 0), *range(1, SIDE + 1)]


def slots_for(tokens: int) -> tuple[int, int]:
    """How many words have a slot of their own, and how many hashed slots the others share.

    This bounds the model: 10^13 tokens have 86,000 slots or 8 MB of weights.
    """
    slots = max(FEWEST, int(PER_ROOT * tokens ** (1 / 3)))
    return slots - slots // HASHED, slots // HASHED


class _Slots(dict):
    """Slots of words; hashed ones are worked out when first asked for."""

    def __init__(self, slot: dict[bytes, int], base: int, hashed: int):
        super().__init__(slot)
        self.base, self.hashed = base, hashed

    def __missing__(self, word: bytes) -> int:
        out = self[word] = self.base + xxhash.xxh3_64_intdigest(word) % self.hashed
        return out


class Vocabulary:
    """Word to slot; slots are numbered from 1, commonest words first. Slot 0 stands outside the text.

    ``hashed`` has the tokens and the distinct words of each hashed slot.
    """

    def __init__(self, ranked: list[bytes], counts: list[int], hashed: list[tuple[int, int]]):
        self.data = (ranked, counts, hashed)
        self.slot = {w: i + 1 for i, w in enumerate(ranked)}
        self.words, self.size = len(ranked), 1 + len(ranked) + len(hashed)
        self.tokens = sum(counts) + sum(n for n, _ in hashed)
        self.mass = np.array([0, *counts, *[n for n, _ in hashed]], np.float64) + 0.5
        #: Log of the number of words among which a slot's probability is spread.
        self.spread = np.log(np.array([1] * (1 + len(ranked)) + [max(1, d) for _, d in hashed], np.float64))
        self.forget()

    def forget(self) -> None:
        self.known = _Slots(self.slot, self.words + 1, max(1, len(self.data[2])))

    def slots(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > KNOWN:
            self.forget()
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))


class Network:
    """Embeddings of the window, one hidden layer, a softmax over groups of slots and one over the slots of a group.

    Slot s of 1 and up is place (s - 1) % group of group (s - 1) // group, so
    a group's slots are about equally common.
    """

    def __init__(self, vocabulary: Vocabulary, flat: np.ndarray | None = None):
        slots = vocabulary.size - 1
        # Fewer groups than places in each: groups are worked on one by one.
        self.groups = max(1, int(slots**0.5 / 2))
        self.group = -(-slots // self.groups)
        self.groups = -(-slots // self.group)
        shapes = [(vocabulary.size, WIDTH), (len(AROUND), WIDTH, HIDDEN), (HIDDEN,), (HIDDEN + 1, self.groups), (self.groups, self.group, HIDDEN + 1)]
        mass = np.zeros(self.groups * self.group)
        mass[:slots] = vocabulary.mass[1:]
        mass = mass.reshape(self.groups, self.group)
        if flat is None:
            draw = np.random.default_rng(11)
            made = [draw.standard_normal(s) * scale for s, scale in zip(shapes, (0.1, (len(AROUND) * WIDTH) ** -0.5, 0, 0.05, 0.05), strict=True)]
            # Without a window, slots are as likely as they are common; places without a slot never are.
            whole = mass.sum(1)
            made[3][-1] = np.log(whole / whole.sum())
            made[4][:, :, -1] = np.where(mass > 0, np.log(np.maximum(mass, 1e-9) / whole[:, None]), -1e4)
            made[4][mass == 0, :-1] = 0
            flat = np.concatenate([m.ravel() for m in made])
        self.flat = flat.astype(np.float32)
        ends = np.cumsum([int(np.prod(s)) for s in shapes])
        # The last weights of wg and ws meet a one behind the hidden layer: they are biases.
        self.embed, self.w1, self.b1, self.wg, self.ws = (self.flat[e - int(np.prod(s)) : e].reshape(s) for e, s in zip(ends, shapes, strict=True))
        self.shapes = shapes

    def hidden(self, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(embeddings of a run of slots, hidden layer and a one for all but the SIDE first and last)."""
        e, n = self.embed[run], len(run) - 2 * SIDE
        h = np.ones((n, HIDDEN + 1), np.float32)
        added = np.tile(self.b1, (n, 1))
        for w, shift in zip(self.w1, AROUND, strict=True):
            added += e[SIDE + shift : SIDE + shift + n] @ w
        np.tanh(added, out=h[:, :-1])
        return e, h

    def by_group(self, run: np.ndarray, targets: np.ndarray):
        """(order, group of each ordered target, its place in the group, [(group, from, to)]): targets group by group."""
        group, place = np.divmod(run[targets] - 1, self.group)
        order = np.argsort(group.astype(np.int32), kind="stable")
        edges = np.searchsorted(group[order], np.arange(self.groups + 1)).tolist()
        return order, group[order], place[order], [(g, lo, hi) for g, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if hi > lo]

    @staticmethod
    def exponents(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
        """(exp(z - shift), its sums, shift); scores are shifted only if their powers overflow or vanish."""
        with np.errstate(over="ignore"):
            out = np.exp(z)
            total = out.sum(1)
        if 1e-30 < total.min() and total.max() < 1e30:
            return out, total, 0.0
        shift = z.max(1)
        out = np.exp(z - shift[:, None])
        return out, out.sum(1), shift

    def log_probs(self, run: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """The log-probability of the slots at the given places of a run, SIDE from both its ends at least."""
        order, group, place, parts = self.by_group(run, targets)
        h, out = self.hidden(run)[1][targets[order] - SIDE], np.zeros(len(targets))

        def logs(z: np.ndarray, place: np.ndarray) -> np.ndarray:
            _, total, shift = self.exponents(z)
            return z[np.arange(len(z)), place] - shift - np.log(total, dtype=np.float64)

        held = logs(h @ self.wg, group)
        for g, lo, hi in parts:
            held[lo:hi] += logs(h[lo:hi] @ self.ws[g].T, place[lo:hi])
        out[order] = held
        return out

    def step(self, run: np.ndarray, targets: np.ndarray, squares: list[np.ndarray]) -> None:
        """One AdaGrad step on the mean cross-entropy of the targets."""
        order, group, place, parts = self.by_group(run, targets)
        targets = targets[order]
        e, every = self.hidden(run)
        h, n = every[targets - SIDE], len(targets)

        def slope(z: np.ndarray, place: np.ndarray) -> np.ndarray:
            d, total, _ = self.exponents(z)
            d *= (1 / (total * n))[:, None]
            d[np.arange(len(d)), place] -= 1 / n
            return d

        d = slope(h @ self.wg, group)
        dh, gw, gs = d @ self.wg.T, h.T @ d, np.zeros_like(self.ws)
        for g, lo, hi in parts:
            d = slope(h[lo:hi] @ self.ws[g].T, place[lo:hi])
            dh[lo:hi] += d @ self.ws[g]
            np.matmul(d.T, h[lo:hi], out=gs[g])
        self._move(self.ws, gs, squares[4])
        self._move(self.wg, gw, squares[3])
        back = np.zeros((len(run) - 2 * SIDE, HIDDEN), np.float32)
        h = h[:, :-1]
        back[targets - SIDE] = dh[:, :-1] * (1 - h * h)
        de, gw = np.zeros_like(e), np.empty_like(self.w1)
        for k, shift in enumerate(AROUND):
            at = slice(SIDE + shift, SIDE + shift + len(back))
            gw[k] = e[at].T @ back
            de[at] += back @ self.w1[k].T
        self._move(self.w1, gw, squares[1])
        self._move(self.b1, back.sum(0), squares[2])
        order = np.argsort(run, kind="stable")
        ordered = run[order]
        starts = np.flatnonzero(np.diff(ordered, prepend=-1))
        at, de = ordered[starts], np.add.reduceat(de[order], starts, axis=0)
        squares[0][at] += de * de
        self.embed[at] -= RATE * de / np.sqrt(squares[0][at] + 1e-8)

    @staticmethod
    def _move(p: np.ndarray, grad: np.ndarray, s: np.ndarray) -> None:
        s += grad * grad
        grad *= RATE
        grad /= np.sqrt(s + 1e-8)
        p -= grad


def _commonest(counts: DataFrame, most: int) -> DataFrame:
    """About ``most`` of the commonest words, never more.

    Counts fall into bins of a sixteenth of an octave. Whole bins are taken
    from the top; of the first that doesn't fit, words are taken by hash. So
    no task sorts the words, and the driver gets two small histograms.
    """
    binned = counts.withColumn("bin", F.floor(F.log2("n") * 16)).withColumn("lot", F.pmod(F.xxhash64("word"), F.lit(4096)))
    room, whole, split = most, None, None
    for b, n in sorted(binned.groupBy("bin").count().collect(), reverse=True):
        if n > room:
            split = b
            break
        room, whole = room - n, b
    taken = F.lit(False) if whole is None else F.col("bin") >= whole
    if split is not None:
        lots = 0
        for lot, n in sorted(binned.where(F.col("bin") == split).groupBy("lot").count().collect()):
            if n > room:
                break
            room, lots = room - n, lot + 1
        taken = taken | ((F.col("bin") == split) & (F.col("lot") < lots))
    return binned.where(taken).select("word", "n")


def count_words(docs: DataFrame) -> Vocabulary:
    """The vocabulary of a corpus, its words in lower case; a row a slot reaches the driver."""

    def count(batches):
        held: Counter[bytes] = Counter()

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in small(batches):
            for text in texts(batch.column(0)):
                held.update((text or b"").lower().split())
                if len(held) > 200_000:
                    yield rows()
        yield rows()

    counts = cut(docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    own, shared = slots_for(counts.agg(F.sum("n")).first()[0] or 0)
    top = sorted(_commonest(counts, own).collect(), key=lambda r: (-r[1], bytes(r[0])))
    ranked, n = [bytes(r[0]) for r in top], [r[1] for r in top]
    known = set(ranked)

    def rest(batches):
        sums, distinct = np.zeros(shared, np.int64), np.zeros(shared, np.int64)
        for batch in batches:
            for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if w not in known:
                    at = xxhash.xxh3_64_intdigest(w) % shared
                    sums[at] += n
                    distinct[at] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(shared)), pa.array(sums), pa.array(distinct)], names=["slot", "n", "d"])

    hashed = {r[0]: (r[1], r[2]) for r in counts.mapInArrow(rest, "slot long, n long, d long").groupBy("slot").agg(F.sum("n"), F.sum("d")).collect()}
    return Vocabulary(ranked, n, [hashed.get(i, (0, 0)) for i in range(shared)])


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, slots, shard, lot): each document's slots as numbers of 16 bits, or 32 if need be, dealt and ordered by a hash of both, in the checkpoint folder for the passes to come."""
    kind = _kind(vocabulary)
    words = docs.sparkSession.sparkContext.broadcast(vocabulary.data)  # a word a slot

    def run(batches):
        vocab = Vocabulary(*words.value)
        for batch in small(batches):
            packed = [vocab.slots((t or b"").lower().split()).astype(kind).tobytes() for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["doc_id", "slots"])

    made = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, slots binary")
    shards = vocabulary.tokens // SHARD_TOKENS + 1
    dealt = made.withColumn("lot", F.xxhash64("doc_id", "slots")).withColumn("shard", F.pmod("lot", F.lit(shards)))
    return cut(dealt.repartition("shard").sortWithinPartitions("shard", "lot", "doc_id").select("doc_id", "slots", "shard", "lot"))


def _kind(vocabulary: Vocabulary) -> str:
    return "<u2" if vocabulary.size <= 1 << 16 else "<u4"


def _unpacked(column: pa.Array | pa.ChunkedArray, kind: str):
    return (np.frombuffer(b, kind).astype(np.int64) for b in column.to_pylist())


def runs(documents, least: int):
    """(run, targets) of documents one behind the other, ``least`` targets to a run and fewer in the last one.

    SIDE times slot 0 stand before, between and after documents, so no window
    sees another document. A long document is spread over several runs, whose
    targets see beyond the run's own.
    """
    gap, held, waiting = np.zeros(SIDE, np.int64), [np.zeros(SIDE, np.int64)], 0

    def ready(whole: bool):
        """Runs of what is held; the last SIDE slots and what follows the last full run are kept."""
        nonlocal held, waiting
        flat = np.concatenate(held)
        targets = np.flatnonzero(flat)
        # The window of a target needs SIDE slots after it.
        targets = targets[(targets >= SIDE) & (targets < len(flat) - SIDE)]
        upto = len(targets) if whole else len(targets) // least * least
        for i in range(0, upto, least):
            some = targets[i : i + least]
            lo = some[0] - SIDE
            yield flat[lo : some[-1] + SIDE + 1], some - lo
        last = targets[upto - 1] + 1 if upto else SIDE
        # Slots before the next target are its window and were targets already: runs start at SIDE.
        held, waiting = [flat[last - SIDE :]], len(targets) - upto

    for slots in documents:
        for lo in range(0, len(slots), 1 << 18):
            held.append(slots[lo : lo + (1 << 18)])
            waiting += len(held[-1])
            if waiting >= 16 * least:
                yield from ready(False)
        held.append(gap)
    yield from ready(True)


def train(encoded: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> Network:
    """A network trained on every token of ``encode``'s documents, each in one of the rounds."""
    sc = encoded.sparkSession.sparkContext
    network = Network(vocabulary)
    words = sc.broadcast(vocabulary.data)
    shards, kind = vocabulary.tokens // SHARD_TOKENS + 1, _kind(vocabulary)
    for number in range(rounds):
        start = sc.broadcast(network.flat)

        def learn(batches, start=start, number=number):
            for shard, rows in groups_of(batches, 0):
                mine = Network(Vocabulary(*words.value), start.value.copy())
                squares, seen = [np.full(s, 0.001, np.float32) for s in mine.shapes], 0
                for run, targets in runs(_unpacked(rows["slots"], kind), BATCH):
                    mine.step(run, targets, squares)
                    seen += len(targets)
                for at in range(0, len(mine.flat) if seen else 0, SLICE):
                    part = mine.flat[at : at + SLICE].astype("<f8") * seen
                    yield pa.RecordBatch.from_arrays([pa.array([at // SLICE]), pa.array([int(shard)]), pa.array([seen]), pa.array([part.tobytes()], pa.binary())], names=["slice", "shard", "seen", "sums"])

        def add(batches):
            for (slice_, group), rows in _pairs(batches):
                seen, total = 0, None
                for n, packed in rows:
                    part = np.frombuffer(packed, "<f8")
                    seen, total = seen + n, part.copy() if total is None else total + part
                yield pa.RecordBatch.from_arrays([pa.array([slice_]), pa.array([group]), pa.array([seen]), pa.array([total.tobytes()], pa.binary())], names=["slice", "shard", "seen", "sums"])

        schema = "slice long, shard long, seen long, sums binary"
        # A round's documents are those whose lot, past what deals it to a shard, falls to it.
        due = F.pmod(F.xxhash64("lot"), F.lit(rounds)) == number
        parts = encoded.where(due).select("shard", "slots").mapInArrow(learn, schema)
        # Copies are added COPIES at a time, in their order, until one is left of each slice.
        left = shards
        while left > 1:
            left = -(-left // COPIES)
            grouped = parts.withColumn("group", F.expr(f"shard div {COPIES}"))
            parts = grouped.repartition("slice", "group").sortWithinPartitions("slice", "group", "shard").select("slice", "group", "seen", "sums").mapInArrow(add, schema)
        # As many numbers as the network has, whatever the corpus.
        flat = network.flat.astype(np.float64)
        for slice_, _, seen, sums in parts.collect():
            flat[slice_ * SLICE : (slice_ + 1) * SLICE] = np.frombuffer(sums, "<f8") / seen
        network = Network(vocabulary, flat)
    return network


def _pairs(batches):
    """((slice, group), [(seen, sums)]) of rows sorted by both; a row is held at a time."""
    from itertools import groupby

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)

    for key, held in groupby(rows(), key=lambda r: r[:2]):
        yield key, ((n, sums) for _, _, n, sums in held)


def score(encoded: DataFrame, vocabulary: Vocabulary, network: Network) -> DataFrame:
    """A row per document: doc_id, n_words, log_likelihood (sum over its tokens) and mean_log_likelihood.

    encoded comes from ``encode``. Every token of the whole text is predicted.
    A null or empty text has no tokens, a sum of 0 and a null mean. Repeated
    rows are scored each; a null doc_id stays null; extra columns are left
    out; an empty table gives an empty table.
    """
    sc = encoded.sparkSession.sparkContext
    flat, words, kind = sc.broadcast(network.flat), sc.broadcast(vocabulary.data), _kind(vocabulary)

    def run(batches):
        vocab = Vocabulary(*words.value)
        net = Network(vocab, flat.value)
        for batch in small(batches):
            documents = list(_unpacked(batch.column(1), kind))
            lengths = np.array([len(x) for x in documents], np.int64)
            logs = [net.log_probs(held, targets) - vocab.spread[held[targets]] for held, targets in runs(documents, STRETCH)]
            upto = np.concatenate([[0.0], np.cumsum(np.concatenate(logs))]) if logs else np.zeros(1)
            ends = np.cumsum(lengths)
            total = upto[ends] - upto[ends - lengths]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths), pa.array(total)], names=["doc_id", "n_words", "log_likelihood"])

    out = encoded.select("doc_id", "slots").mapInArrow(run, "doc_id long, n_words long, log_likelihood double")
    return out.withColumn("mean_log_likelihood", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")))


def op10_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vocabulary = count_words(docs)
    encoded = encode(docs, vocabulary)
    scores = score(encoded, vocabulary, train(encoded, vocabulary))
    return scores.select("doc_id", "n_words", F.round("log_likelihood", 3).alias("log_likelihood"), F.round("mean_log_likelihood", 4).alias("mean_log_likelihood"))
