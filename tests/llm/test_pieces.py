"""Encoding against the library, exact round trips, and sampling against enumeration."""

import collections
import itertools
import math
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark import cloudpickle
from pyspark.sql import functions as F

import corpus_pipeline
from pipeweave.llm import pieces, registry

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def soft():
    return pieces.Vocabulary(MODEL, 0.4)


def test_same_tokens_as_the_library_and_round_trip(spark, docs, sp):
    out = pieces.encode(docs, MODEL).collect()
    for r in out:
        assert r.ids == sp.encode(r.text) and r.decoded and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, np.int32).tobytes())
        assert len({tuple(s.ids) for s in r.samples}) == len(r.samples)
        for s in r.samples:
            assert sp.decode(s.ids) == r.text and 0 <= s.inclusion <= 1


def test_query_and_stage_return_all_ids(spark, docs, sp):
    texts = {r.doc_id: r.text for r in docs.collect()}
    few = docs.limit(40)
    for out in (registry.op3_sentencepiece(spark, "/root/testdata/sf0.01").limit(40), corpus_pipeline.encode(spark, few, "")):
        rows = out.collect()
        assert len(rows) == 40
        for r in rows:
            assert r.ids == sp.encode(texts[r.doc_id]) and r.decoded
            assert r.samples and all(s.decoded and len(s.ids) == s.n_tokens and sp.decode(s.ids) == texts[r.doc_id] for s in r.samples)


def test_decode_operator(spark, docs):
    coded = pieces.encode(docs.limit(50), MODEL, samples=0).withColumnRenamed("text", "was")
    assert pieces.decode(coded, MODEL).where(~F.col("was").eqNullSafe(F.col("text"))).count() == 0


def test_independent_of_partitions(spark, docs):
    shape = lambda d: {r.doc_id: [(s.ids_crc32, s.value) for s in r.samples] for r in pieces.encode(d, MODEL, ids=False, sample_ids=False).collect()}
    assert shape(docs.limit(200).repartition(7)) == shape(docs.limit(200).coalesce(1))


def segmentations(lat, unit):
    out = []

    def go(node, path, p):
        if not len(lat.edges(node)):
            out.append((tuple(t for e in path for t in lat.tokens(e)), p))
        for e in lat.edges(node):
            go(lat.end(node, e), (*path, e), p * math.exp(lat.log_prob(node, e)))

    go(int(lat.start[unit]), (), 1.0)
    return out


def test_samples_follow_their_law(soft):
    text, n = "an ist", 20_000
    _, units, rows = pieces.encode_texts(soft, [text])
    lat = soft.lattices(units)
    joint = {sum((x[0] for x in z), ()): math.prod(x[1] for x in z) for z in itertools.product(*[segmentations(lat, int(u)) for u in rows[0]])}
    assert abs(sum(joint.values()) - 1) < 1e-9
    drawn = pieces.sample_texts(soft, [text] * n, list(range(n)), 2, 3, lat, [rows[0]] * n)
    first = collections.Counter(tuple(x[0][3].tolist()) for x in drawn)
    second = collections.Counter(tuple(x[1][3].tolist()) for x in drawn)
    for z, p in joint.items():
        q = sum(pa * p / (1 - pa) for a, pa in joint.items() if a != z)
        for seen, want in ((first[z], p), (second[z], q)):
            assert abs(seen / n - want) < 5 * math.sqrt(want * (1 - want) / n) + 1e-3
        if p > 0.02:  # weighing by inclusion makes the count of a segmentation unbiased
            assert abs(np.mean([sum((tuple(y[3].tolist()) == z) / y[2] for y in x) for x in drawn]) * p - p) < 0.03
    assert all(x[0][0] >= x[1][0] for x in drawn)


def test_few_segmentations_come_out_whole(soft):
    text = "an"
    _, units, rows = pieces.encode_texts(soft, [text])
    lat = soft.lattices(units)
    every = segmentations(lat, int(rows[0][0]))
    got = pieces.sample_texts(soft, [text], [1], 100, 3, lat, rows)[0]
    assert {tuple(x[3].tolist()) for x in got} == {z for z, _ in every} and all(x[2] == 1 for x in got)


def test_plain_and_logarithmic_sums_agree(soft, monkeypatch):
    units = ["therein", "x", "", "▁▁a", "naïve", "bb" * 12]
    a = soft.lattices(units)
    monkeypatch.setattr(pieces, "PLAIN", 0)
    b = soft.lattices(units)
    assert np.allclose(a.beta, b.beta) and (a.kind == b.kind).all()


def test_units_by_split_and_by_pattern(docs):
    texts = [r.text for r in docs.limit(300).collect()] + [None, "", " ", "  ", " a", "a ", "a  b", "a b", "\u2581a \u2581", "\n \n", "x" * 9000 + " \u00e9"]
    units, rows = pieces.unit_numbers(texts)
    assert len(set(units)) == len(units) and [[units[i] for i in r.tolist()] for r in rows] == [pieces.units_of(t) for t in texts]
    assert pieces.unit_numbers([]) == ([], [])


def test_unsound_tokens_are_told(soft):
    """Where tokens of a unit do not spell it, texts are decoded one by one and only those that hold it fail."""
    assert pieces.encode_texts(soft, ["an ist", "a\u2581b  c", None, ""]) and soft.sound
    _, tokens = soft.tokens_of(["an", "ist"])
    assert soft.spells(["an", "ist"], tokens) and not soft.spells(["an", "is"], tokens) and not soft.spells(["ist", "an"], tokens) and soft.spells([], tokens[:0])


def test_remembered_units_change_nothing(docs):
    """Tokens and samples are the same with and without what a task remembers from texts before."""
    texts = [r.text for r in docs.limit(60).collect()] + ["\U0001d54f x", None, "", "\U0001d550 \u2581 an ist", "an an"]
    keys = list(range(len(texts)))
    fresh, used = pieces.Vocabulary(MODEL, 0.4), pieces.Vocabulary(MODEL, 0.4)
    for a in range(0, len(texts), 13):
        coded, units, rows = pieces.encode_texts(used, texts[a : a + 13])
        used.keep(units, np.bincount(np.concatenate(rows), minlength=len(units)))
    assert len(used.kept) > 100
    out = []
    for v in (fresh, used):
        coded, units, rows = pieces.encode_texts(v, texts)
        drawn = pieces.sample_texts(v, texts, keys, 3, 5, v.lattices_of(units), rows)
        out.append(([c.tolist() for c in coded], [[(x[0], x[1], x[2], x[3].tolist()) for x in s] for s in drawn]))
    assert out[0] == out[1]


def test_vocabulary_outlives_its_task():
    """A function comes to each task with new globals; what one task built and learnt serves the next, unless it failed."""
    shipped = cloudpickle.dumps(lambda: pieces.lent(MODEL, 0.5))
    with cloudpickle.loads(shipped)() as first:
        with cloudpickle.loads(shipped)() as other:  # one at a time has it
            assert other is not first
    with cloudpickle.loads(shipped)() as again:
        assert again is first
    with pytest.raises(ZeroDivisionError), cloudpickle.loads(shipped)() as again:
        1 / 0
    with cloudpickle.loads(shipped)() as fresh:
        assert fresh is not first


def test_steps_are_the_lattice(soft):
    """The lists of a unit's edges say what the lattice says of each, at its last unit too."""
    lat = soft.lattices(["therein", "", "naïve", "\U0001d54f x", "an"])
    for u in range(5):
        base, first, size, logs = lat.steps(u)
        start = int(lat.start[u])
        for node in range(len(first) - 1):
            assert [base + e for e in range(first[node], first[node + 1])] == list(lat.edges(start + node))
            for e in range(first[node], first[node + 1]):
                assert lat.end(start + node, base + e) == start + node + size[e] and lat.log_prob(start + node, base + e) == logs[e]


def test_odd_rows(spark, odd, none):
    out = {r.doc_id: r for r in pieces.encode(odd, MODEL).collect()}
    assert out[1].n_tokens == 0 and out[1].samples == [] and out[1].decoded is None and out[2].n_tokens == 0
    assert all(out[i].decoded for i in (3, 4, 5, 6, 7, 8))
    assert pieces.encode(none, MODEL).count() == 0
