import random

import numpy as np
import pytest

from hopforge.llm import lm_scoring as L
from hopforge.llm.lm_scoring import AROUND, HIDDEN, RATE, SIDE, Network, Vocabulary, count_words, encode, op10_pseudo_likelihood, runs, score, slots_for, train


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(1)
    # Triples of words that always meet: each is known from its neighbours alone.
    rows = []
    for d in range(2000):
        rows.append((d, " ".join(f"{x}left {x}mid {x}right" for x in rnd.choices("abcdefgh", k=rnd.randrange(20, 60)))))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def vocabulary(n=30, hashed=4):
    return Vocabulary([b"w%d" % i for i in range(n)], [100 - 2 * i for i in range(n)], [(5, 3)] * hashed)


def squares(net, start=0.001):
    return [np.full(s, start, np.float32) for s in net.shapes]


def plain_log_probs(net, slots):
    """log P(slot | window) of each slot of one document, from the weights, one token at a time, over all slots."""
    padded = [0] * SIDE + list(slots) + [0] * SIDE
    out = []
    for t, slot in enumerate(slots):
        h = net.b1.astype(np.float64)
        for k, shift in enumerate(AROUND):
            h = h + net.embed[padded[t + SIDE + shift]].astype(np.float64) @ net.w1[k]
        h = np.append(np.tanh(h), 1.0)
        groups = np.exp(h @ net.wg)
        groups /= groups.sum()
        every = []
        for g in range(net.groups):
            inner = np.exp(net.ws[g] @ h)
            every += (groups[g] * inner / inner.sum()).tolist()
        assert abs(sum(every) - 1) < 1e-9
        out.append(np.log(every[slot - 1]))
    return np.array(out)


def test_scores_equal_a_plain_softmax_over_all_slots():
    rnd = np.random.default_rng(2)
    v = vocabulary()
    net = Network(v)
    net.flat[:] += rnd.standard_normal(len(net.flat)).astype(np.float32) * 0.3
    net.ws[net.ws < -1000] = -1e4
    docs = [rnd.integers(1, v.size, n) for n in (1, 0, 40, 3, 500, 7)]
    got = np.concatenate([net.log_probs(r, t) for r, t in runs(docs, 64)])
    assert np.allclose(got, np.concatenate([plain_log_probs(net, d) for d in docs]), atol=2e-4)


def test_large_scores_do_not_overflow():
    v = vocabulary()
    net = Network(v)
    net.wg[:] *= 1000
    lp = net.log_probs(np.array([0, 0, 3, 30, 0, 0]), np.array([2, 3]))
    assert np.isfinite(lp).all()


@pytest.mark.parametrize("least", [1, 5, 64, 10_000])
def test_runs_have_every_token_once_with_its_window(least):
    rnd = np.random.default_rng(least)
    docs = [rnd.integers(1, 99, n) for n in (0, 1, 2, 300, 0, 50, 1, 3000)]
    want = []
    for d in docs:
        padded = [0] * SIDE + d.tolist() + [0] * SIDE
        want += [tuple(padded[t : t + 2 * SIDE + 1]) for t in range(len(d))]
    got, sizes = [], []
    for run, targets in runs(docs, least):
        sizes.append(len(targets))
        got += [tuple(run[t - SIDE : t + SIDE + 1].tolist()) for t in targets]
    assert got == want and set(sizes[:-1]) <= {least}


def test_long_documents_are_cut_without_loss(monkeypatch):
    docs = [np.arange(1, 600_000) % 97 + 1]
    got = np.concatenate([run[targets] for run, targets in runs(docs, 4096)])
    assert (got == docs[0]).all()


def test_steps_go_down_the_loss():
    rnd = np.random.default_rng(0)
    v = vocabulary()
    net, docs = Network(v), [rnd.integers(1, v.size, 12)]
    (run, targets), = runs(docs, 99)
    held, seen = squares(net), [-net.log_probs(run, targets).mean()]
    for _ in range(300):
        net.step(run, targets, held)
        seen.append(-net.log_probs(run, targets).mean())
    assert seen[1] < seen[0] and seen[-1] < 0.1 * seen[0]


def test_gradient_of_every_kind_of_weight():
    rnd = np.random.default_rng(3)
    v = vocabulary()
    docs = [rnd.integers(1, v.size, 60)]
    net = Network(v)
    start, h = net.flat.copy(), 1e-3

    def loss(flat):
        other = Network(v, flat)
        return -plain_log_probs(other, docs[0]).mean()

    (run, targets), = runs(docs, 99)
    net.step(run, targets, squares(net, 1.0))
    moved = start - net.flat  # rate * g / sqrt(1 + g * g)
    ends = np.cumsum([0] + [int(np.prod(s)) for s in net.shapes])
    for lo, hi in zip(ends[:-1], ends[1:]):
        for at in rnd.choice(np.arange(lo, hi), 8, replace=False):
            if start[at] < -1000:
                continue
            up, down = start.astype(np.float64), start.astype(np.float64)
            up[at] += h
            down[at] -= h
            g = (loss(up) - loss(down)) / (2 * h)
            assert abs(moved[at] - RATE * g / np.sqrt(1 + g * g)) < 5e-5


def test_model_grows_with_the_corpus_within_its_bound():
    sizes = [sum(slots_for(n)) for n in (0, 10**6, 10**9, 10**13)]
    assert sizes == sorted(set(sizes)) and all(s <= max(L.FEWEST, L.PER_ROOT * n ** (1 / 3) + 1) for s, n in zip(sizes, (0, 10**6, 10**9, 10**13)))
    assert sizes[-1] * (L.WIDTH + HIDDEN + 1) * 4 < 10 << 20


def test_words_of_a_hashed_slot_share_its_probability(spark):
    rare = [f"rare{i}" for i in range(500)]
    docs = spark.createDataFrame([(i, "the of and " + rare[i]) for i in range(500)], "doc_id long, text string")
    v = count_words(docs)
    assert v.tokens == 2000 and v.words + len(v.data[2]) == sum(slots_for(2000)) or v.words < slots_for(2000)[0]
    assert sum(d for _, d in v.data[2]) == 503 - v.words and sum(n for n, _ in v.data[2]) == 2000 - sum(v.data[1])
    assert v.spread[1 : v.words + 1].max() == 0 and v.spread[v.words + 1 :].max() > 2


def test_training_helps_on_held_out_text(spark, corpus):
    v = count_words(corpus)
    assert v.data[0][0].endswith((b"left", b"mid", b"right")) and v.tokens == corpus.selectExpr("sum(size(split(text, ' ')))").first()[0]
    held_out = spark.createDataFrame([(1, "cleft cmid cright aleft amid aright hleft hmid hright bleft bmid bright"), (2, "cright hleft amid cmid aleft hmid bright hright aright bleft cleft bmid")], "doc_id long, text string")
    means = lambda net: {r.doc_id: r.mean_log_likelihood for r in score(encode(held_out, v), v, net).collect()}
    before, after = means(Network(v)), means(train(encode(corpus, v), v, rounds=6))
    assert after[1] > before[1] + 0.5  # order as in the corpus
    assert after[1] > after[2] + 0.5  # the same words in another order


def test_odd_rows(spark, corpus):
    v = count_words(corpus)
    rows = [(1, None), (2, ""), (None, "aleft amid"), (3, "x"), (3, "x"), (4, "aleft " * 30_000)]
    frame = spark.createDataFrame([(*r, 0, 1, 2) for r in rows], "doc_id long, text string, slots int, shard int, lot int")
    got = score(encode(frame, v), v, Network(v)).collect()
    assert sorted(r.n_words for r in got) == [0, 0, 1, 1, 2, 30_000]
    assert {r.doc_id: r.mean_log_likelihood for r in got}[1] is None
    empty = spark.createDataFrame([], "doc_id long, text string")
    none = count_words(empty)
    nothing = encode(empty, none)
    assert score(nothing, none, train(nothing, none)).count() == 0


def plain_training(rows, v, shards, rounds):
    """The averaged copies, in plain numpy: rows are (lot, shard, slots) in order."""
    flat = Network(v).flat
    for number in range(rounds):
        total, seen = np.zeros(len(flat)), 0
        for shard in range(shards):
            net, n = Network(v, flat.copy()), 0
            held = squares(net)
            for run, targets in runs([d for due, s, d in rows if s == shard and due == number], L.BATCH):
                net.step(run, targets, held)
                n += len(targets)
            total += net.flat.astype(np.float64) * n
            seen += n
        flat = (total / seen).astype(np.float32)
    return Network(v, flat)


def test_query_equals_plain_training_and_scoring(spark, monkeypatch):
    """The whole query, with several shards and copies added up in turns, against numpy on the driver."""
    monkeypatch.setattr(L, "SHARD_TOKENS", 15_000)
    monkeypatch.setattr(L, "COPIES", 2)
    monkeypatch.setattr(L, "SLICE", 1000)
    monkeypatch.setattr(L, "BATCH", 500)
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    v = count_words(docs)
    rows = encode(docs, v).selectExpr("*", f"pmod(xxhash64(lot), {L.ROUNDS}) AS due").orderBy("shard", "lot", "doc_id").collect()
    shards = v.tokens // 15_000 + 1
    assert shards > 4 and {r.shard for r in rows} <= set(range(shards))
    unpacked = [(r.due, r.shard, np.frombuffer(r.slots, "<u2").astype(np.int64)) for r in rows]
    assert sum(len(d) for *_, d in unpacked) == v.tokens  # each a target, in the round that is due
    net = plain_training(unpacked, v, shards, L.ROUNDS)
    got = {r.doc_id: r for r in op10_pseudo_likelihood(spark, sf).collect()}
    assert len(got) == len(rows)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r, (*_, slots) in zip(rows, unpacked, strict=True):
        want = float((plain_log_probs(net, slots) - v.spread[slots]).sum()) if len(slots) < 200 else None
        mine = got[r.doc_id]
        assert mine.n_words == len(slots) == len((texts[r.doc_id] or "").encode().split())
        if want is not None:
            assert mine.log_likelihood == pytest.approx(want, abs=0.02 + 1e-4 * abs(want))


def test_scores_do_not_depend_on_partitions(spark, corpus, monkeypatch):
    monkeypatch.setattr(L, "SHARD_TOKENS", 50_000)
    out = []
    for n in (1, 5):
        docs = corpus.repartition(n)
        v = count_words(docs)
        encoded = encode(docs, v)
        out.append(sorted(tuple(r) for r in score(encoded, v, train(encoded, v)).selectExpr("doc_id", "round(log_likelihood, 3)").collect()))
    assert out[0] == out[1]
