"""Language, toxicity, quality and rules: held-out accuracy, brute force for the parts, odd rows."""

import collections
import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from pipeweave.llm import langid, quality, registry, rules, toxicity
from pipeweave.llm.common import key_crc, labelled_rows

SF = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark, docs):
    out = registry.op1_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    n, right, low, high = out.agg(F.count(F.lit(1)), F.count_if(F.col("lang") == F.col("lang_pred")), F.min("score"), F.max("score")).first()
    assert n > 100 and right / n > 0.99 and 0 <= low <= high <= 1


def test_ngrams_by_hand():
    for t in ("Hello, World", "é a", "x", "ab  cd\n12ef"):
        number = lambda g: sum(ord(c) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
        assert sorted(langid.ngram_codes(t).tolist()) == sorted(number(g) for g, n in slow_grams(t).items() for _ in range(n))
    assert len(langid.ngram_codes("12 !!")) == 0


def test_out_of_place_by_hand():
    a, b = langid.ranked(langid.ngram_codes("the dog the cat"), 5), langid.ranked(langid.ngram_codes("der hund"), 5)
    model = langid.LanguageModel({"x": a, "y": b}, 5)
    names, vocabulary, ranks = model.arrays()
    gaps = langid.out_of_place("the the", vocabulary, ranks, model)
    own = langid.ranked(langid.ngram_codes("the the"), 5).tolist()
    for j, profile in enumerate((a.tolist(), b.tolist())):
        want = np.mean([abs(profile.index(c) - i) if c in profile else 5 for i, c in enumerate(own)]) / 5
        assert math.isclose(gaps[j], want)


def slow_grams(text):
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    joined = " " + " ".join(words) + " "
    grams = [joined[i : i + n] for n in (1, 2, 3) for i in range(len(joined) - n + 1)] if words else []
    return collections.Counter(g for g in grams if (g != " " if len(g) == 1 else " " not in g[1:-1]))


def slow_order(counts, top):
    number = lambda g: sum(ord(c) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
    return sorted(counts, key=lambda g: (-counts[g], number(g)))[:top]


def test_language_whole_operator_by_hand(spark, docs):
    """Profiles, distances, scores and ties of fit and predict against a plain version on whole texts."""
    rows = [(r.doc_id, r.text, r.lang) for r in docs.limit(120).collect()]
    rows += [(-1, rows[0][1], "zz"), (-2, "the", None), (-3, None, "en"), (-4, "1 2", "en")]
    train = [(t, g) for i, t, g in rows if i % 2 or i < 0]
    totals = collections.defaultdict(collections.Counter)
    for t, g in train:
        if g is not None and t is not None:
            totals[g].update(slow_grams(t))
    profiles = {g: slow_order(c, 30) for g, c in totals.items()}
    df = spark.createDataFrame([(i, t, g) for i, t, g in rows], "doc_id long, text string, lang string").repartition(5)
    model = langid.fit(df.where("doc_id % 2 <> 0 or doc_id < 0"), size=30)
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    for i, t, _ in rows:
        own = slow_order(slow_grams(t), 30)
        if not own:
            assert (got[i].lang_pred, got[i].lang_score) == ("und", 0)
            continue
        gaps = {g: sum(abs(p.index(x) - k) if x in p else 30 for k, x in enumerate(own)) / len(own) / 30 for g, p in sorted(profiles.items())}
        best = min(gaps, key=lambda g: (gaps[g], g))
        assert got[i].lang_pred == best and math.isclose(got[i].lang_distance, gaps[best])
        assert math.isclose(got[i].lang_score, 1 / sum(math.exp(-24 * (x - gaps[best])) for x in gaps.values()))


def test_language_ties_go_to_the_first(spark):
    df = spark.createDataFrame([("the cat", "b"), ("the cat", "a"), ("le chat", "c")], "text string, lang string")
    out = langid.predict(spark.createDataFrame([("the cat",)], "text string"), langid.fit(df)).first()
    assert out.lang_pred == "a" and 0.4 < out.lang_score <= 0.5


def test_segments_against_brute_force():
    """Maximal segments by their definition: no better sub-segment, none contains another, all others overlap one."""

    def brute(scores):
        n, best = len(scores), []
        sums = np.r_[0, np.cumsum(scores)]
        ok = lambda i, j: sums[j] > sums[i] and all(sums[k] > sums[i] for k in range(i + 1, j + 1)) and all(sums[k] < sums[j] for k in range(i, j))
        found = [(i, j) for i in range(n) for j in range(i + 1, n + 1) if ok(i, j)]
        for i, j in found:
            if not any((a, b) != (i, j) and a <= i and j <= b for a, b in found):
                best.append((i, j - 1, round(float(sums[j] - sums[i]), 9)))
        return sorted(best)

    rng = random.Random(5)
    for _ in range(300):
        scores = [rng.choice([2.5, 1.25, 3.0]) if rng.random() < 0.35 else -1.0 for _ in range(rng.randint(1, 14))]
        hits = [i for i, s in enumerate(scores) if s > 0]
        got = toxicity.maximal_segments(hits, [scores[i] for i in hits], 1.0)
        assert sorted((a, b, round(s, 9)) for a, b, s in got) == brute(scores), scores


def test_segment_rate_solves_its_equation():
    s, p = np.array([3.0, 1.0]), np.array([0.001, 0.01])
    rate = toxicity.segment_rate(s, p, 1.0, 1 - p.sum())
    assert abs(p @ np.exp(rate * s) + (1 - p.sum()) * math.exp(-rate) - 1) < 1e-6


def test_each_passage_of_the_same_words_is_found():
    toxic = ["vile", "foul", "rank", "base", "mean", "grim"]
    model = toxicity.ToxicityModel(dict.fromkeys(toxic, 3.0))
    text = " ".join([*toxic, *["calm"] * 3000, *toxic, *["calm"] * 50])
    assert [(a, b, s) for a, b, s, _ in model.segments(text)] == [(0, 5, 18.0), (3006, 3011, 18.0)]
    early = " ".join([*(x for w in toxic for x in (w, *["calm"] * 50)), *toxic])
    assert (306, 311, 18.0) in [(a, b, s) for a, b, s, _ in model.segments(early)]
    assert model.segments("vile " * 500)[0][2] < 6.0001


def test_evalues_grow_with_the_text():
    model = toxicity.ToxicityModel({"vile": 8.0})
    e = [model.segments("vile " + "calm " * n)[0][3] for n in (19, 199)]
    assert math.isclose(e[1], 10 * e[0])


def test_segment_constant_from_chance_segments():
    rng, rate, k, n = np.random.default_rng(4), 1.5, 0.02, 1_000_000
    scores = rng.exponential(1 / rate, int(k * n))
    bins = dict(zip(*[x.tolist() for x in np.unique((scores / toxicity.BIN).astype(int), return_counts=True)], strict=True))
    assert 0.9 < toxicity.segment_constant(bins, n, rate) / k < 1.6
    assert toxicity.segment_constant({}, 500, rate) == 1 / 500


def test_toxicity_held_out(spark, labels):
    out = registry.op4_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out")
    n, good, caught, false = out.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0), F.count_if(F.expr("toxic = 1 and predicted = 1")), F.count_if(F.expr("toxic = 0 and predicted = 1"))).first()
    assert caught / n > 0.9 and false / good <= 0.001


def test_word_scores_by_hand(spark):
    """Dirichlet log-odds, shrunk by their error, of words and of beginnings that several words share."""
    texts = [("vile foul calm", 1, 0), ("vile calm", 1, 1), ("vile grimace grimly grimmer", 1, 0), ("calm sea", 0, 0), ("calm vile sea", 0, 1), ("grimes sea", 0, 1), ("grimacing grimness", 1, 1)]
    df = spark.createDataFrame([(y, h, t) for t, y, h in texts], "y int, half int, text string").repartition(3)
    counts = toxicity.with_kinds(df.mapInArrow(toxicity._word_counts, "word string, o0 long, t0 long, o1 long, t1 long").groupBy("word").agg(*[F.sum(c).alias(c) for c in ("o0", "t0", "o1", "t1")]))
    got = toxicity.scored_words(counts, 0.05, 0.5, 1, -9.0)
    units = lambda t: {u for w in t.split() for u in toxicity.units(w)}
    for part, halves in enumerate(({0}, {1}, {0, 1})):
        t, o = collections.Counter(), collections.Counter()
        for x, y, h in texts:
            if h in halves:
                (t if y else o).update(units(x))
        n, want = sum(t.values()) + sum(o.values()), {}
        kinds = collections.Counter(u for w in {w for x, y, _ in texts if y for w in x.split()} for u in toxicity.units(w)[1:])
        for u in t:
            own = 0.05 * (t[u] + o[u])
            odds = [math.log((c[u] + own) / (sum(c.values()) + 0.05 * n - c[u] - own)) for c in (t, o)]
            score = odds[0] - odds[1] - 0.5 * math.sqrt(1 / (t[u] + own) + 1 / (o[u] + own))
            if (not u.endswith("*") or kinds[u] >= toxicity.KINDS) and score > -9:
                want[u] = score
        assert set(got[part]) == set(want) and all(math.isclose(got[part][u], want[u]) for u in want)
    assert "grim*" in got[2] and "grima*" not in got[2]


def test_a_word_has_its_highest_score():
    model = toxicity.ToxicityModel({"grim*": 1.0, "grimly": 0.5, "grimm*": 2.0})
    assert [model.score_of(w) for w in ("grim", "grimly", "grimmest", "grimace", "calm")] == [0, 1.0, 2.0, 1.0, 0]


def test_segments_together():
    by_hand = lambda marks: max(sum(marks[:r]) - (r - 1) * math.log(sum(marks[:r])) + math.log(math.factorial(r) * math.factorial(r - 1)) if r > 1 else marks[0] for r in range(1, len(marks) + 1))
    for marks in ([3.0], [3.0, 2.5], [9.0, 1.0, 1.0], [4.0] * 6):
        assert math.isclose(toxicity.together(marks), by_hand(marks))
    assert toxicity.together([]) == 0


def test_labels_of_one_key(spark):
    """Contradictory labels count as none, a repeated key gives one row, columns of any name pass."""
    docs = spark.createDataFrame([(i % 40, f"text {i % 40}" if i < 400 else "other") for i in range(500)], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("__y", "__key", "__text", "k", "y", "row", "__judged", "chosen")})
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 0), (4, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    rows = labelled_rows(docs, labels, "doc_id", "toxic", {"text": F.col("text")}, 100).collect()
    assert len(rows) == 39 and all(r.y in (0, 1) for r in rows)
    few = labelled_rows(docs, labels, "doc_id", "toxic", {"text": F.col("text")}, 7)
    assert few.count() == 7
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model)
    assert out.count() == 500 and "__y" in out.columns and out.groupBy("text").agg(F.count_distinct("toxic_score").alias("n")).where("n > 1").count() == 0


def test_quality_held_out(spark, labels):
    out = registry.op7_quality(spark, SF).join(labels, "doc_id").where("held_out")
    bad, good, caught, lost = out.agg(F.count_if(F.expr("quality = 0")), F.count_if(F.expr("quality = 1")), F.count_if(F.expr("quality = 0 and not kept")), F.count_if(F.expr("quality = 1 and not kept"))).first()
    assert caught / bad > 0.8 and lost / good < 0.03


def test_both_views_are_taught_and_gain(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    held = key_crc("doc_id") % 5 == 0
    wrong = {}
    for rounds in (0, 3):
        model = quality.fit(docs, labels.where(~held), rounds=rounds)
        out = quality.score(docs, model).join(labels, "doc_id").where(held)
        wrong[rounds] = out.agg(*[F.count_if((F.col(c) >= 0.5) != (F.col("quality") == 1)) for c in ("quality_score", "quality_views.text", "quality_views.meta")]).first()
        assert rounds == 0 or min(model.taught) > 1000
    assert all(a <= b for a, b in zip(wrong[3], wrong[0], strict=True)) and wrong[3][1] < wrong[0][1] and wrong[3][0] <= 2


def test_lessons_by_hand(spark):
    rng = np.random.default_rng(3)
    width = {"text": quality.TEXT_FEATURES, "meta": quality.META_FEATURES}
    x = {v: rng.integers(0, 256, (300, n)).astype(np.uint8) for v, n in width.items()}
    weights = [np.r_[w, -w.sum() / 2] for w in (rng.normal(0, 0.3, n) for n in width.values())]
    df = spark.createDataFrame([(a.tobytes(), b.tobytes()) for a, b in zip(x["text"], x["meta"], strict=True)], "text binary, meta binary").repartition(4)
    cells = df.mapInArrow(lambda b: quality._moments(b, weights, 0.8), "place int, cell int, x double").groupBy("place", "cell").agg(F.sum("x").alias("x"))
    got = quality._added(cells)
    views = [x[v] / 255.0 for v in width]
    p = [1 / (1 + np.exp(-(v @ w[:-1] + w[-1]))) for v, w in zip(views, weights, strict=True)]
    for view in (0, 1):
        says, own = p[1 - view], p[view]
        n = [0, 0]
        total = np.zeros((2, views[view].shape[1]))
        for i in range(300):
            label = 1 if says[i] >= 0.8 else 0 if says[i] <= 0.2 else None
            if label is not None and not (own[i] >= 0.8 and label == 0) and not (own[i] <= 0.2 and label == 1):
                n[label] += 1
                total[label] += views[view][i]
        assert got[view].n.tolist() == n and min(n) > 0 and np.allclose(got[view].s, total)
        assert np.allclose(got[view].p[1], got[view].p[1].T)


def test_rates_leave_out_a_rows_own_half():
    r = quality.Rates.count(["a", "a", "a", None], np.array([1.0, 1.0, 0.0, 1.0]), np.array([0, 0, 1, 1]))
    assert r.mean == 0.75 and r.of("a", 0) == ((0 + 15) / 21, 1 / 21) and r.of("a", 1) == ((2 + 15) / 22, 2 / 22) and r.of("a", None) == ((2 + 15) / 23, 3 / 23)
    assert r.of("b", None) == (0.75, 0.0) and r.of(None, 0)[1] == 1 / 21


def test_co_training_teaches_the_other_view():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 4000)
    text, meta = (y[:, None] * 4 + rng.normal(size=(4000, 3))), (y[:, None] * 4 + rng.normal(size=(4000, 2)))
    m = quality.co_train(text[:60], meta[:60], y[:60].astype(float), text[60:2000], meta[60:2000])
    assert min(m.taught) > 100
    assert ((m.scores(text[2000:], meta[2000:]) > 0.5) == y[2000:]).mean() > 0.98


def test_rule_counts_by_hand():
    def slow(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)}
        lines, seen, dup = (text or "").split("\n"), set(), 0
        for x in lines:
            if re.search(r"[^\x20\x09-\x0D]", x):
                dup += x in seen
                seen.add(x)
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)

    rng = random.Random(3)
    cases = [None, "", " \n ", "a" * 50, "x y z q", "a b c d e a b c d e", "l\nl\n l\n\nl"]
    cases += ["".join(rng.choice(["a ", "b ", "c\n", "#", "é ", "\t"]) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    for c in cases:
        assert rules.rule_counts(c)[:5] == slow(c), c


def test_forest_finds_the_outlier():
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(size=(500, 3)), [[9, 9, 9]]])
    s = rules.grow(x).score(x)
    assert s.argmax() == 500 and s[500] > 0.7 and np.median(s) < 0.5


def test_rules_keep_good_documents(spark, docs, labels):
    out = registry.op8_rules(spark, SF)
    assert out.where("base_failed and kept").count() == 0
    lost, good = out.join(labels, "doc_id").where("quality = 1 and not base_failed").agg(F.count_if(F.expr("not kept")), F.count(F.lit(1))).first()
    assert lost <= 0.01 * good


def test_rules_limits_lie_on_the_anomaly(spark):
    rows = [(i, "a", 0.3 + i / 100, 0) for i in range(40)] + [(100 + i, "b", 0.3 + i / 100, 1) for i in range(40)] + [(200, "b", 0.9, 0)]
    scored = spark.createDataFrame([r[:3] for r in rows], "doc_id long, rule string, anomaly double").withColumn("base_failed", F.lit(False))
    marks = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, quality int")
    assert rules.thresholds(scored, marks) == {"a": 0.5, "b": 0.9}


def test_verdict_by_hand(spark, docs, labels):
    """Counts, path lengths, limits and verdicts of all documents against a plain version."""
    got = {r.doc_id: r for r in rules.judged(docs, labels).collect()}
    counted = rules.with_counts(docs.select("doc_id", "text"))
    forest = rules.fit_forest(counted)
    ids = sorted(got)
    x = rules.ratios(np.array([[got[i][c] for c in rules.COUNTS] for i in ids], np.int64))

    def path(row):
        total = 0.0
        for t in range(len(forest.feature)):
            node = 0
            while forest.feature[t, node] >= 0:
                node = int(forest.child[t, node]) + int(row[forest.feature[t, node]] >= forest.threshold[t, node])
            total += forest.length[t, node]
        return 2.0 ** (-total / len(forest.feature) / rules.expected_length(forest.size))

    marks = {r.doc_id: r.quality for r in labels.collect()}
    for i, row in list(zip(ids, x, strict=True))[::17]:
        assert math.isclose(got[i].anomaly, path(row), rel_tol=1e-9)
    sound = [i for i in ids if not (got[i].n_words < 10 or 100 * got[i].n_repeat_words > 20 * got[i].n_words)]
    assert {i for i in ids if not got[i].base_failed} == set(sound)
    good = [i for i in sound if marks.get(i) == 1]
    limit = {}
    for i in sound:
        r = got[i]
        rates = {"symbols": r.n_symbols / r.n_words, "repeats": max(r.n_dup_lines / r.n_lines, r.n_repeat_words / r.n_words), "capitals": (r.n_upper - r.n_lines - r.n_marks) / r.word_chars - 0.1, "marks": r.n_marks / r.n_words}
        top = max(rates.values())
        assert r.band == (f"{r.rule} 1e{math.floor(math.log10(min(1.0, top)))}" if top > 0 else "none") and (top <= 0 or rates[r.rule] == top)
    for value in {got[i].band for i in sound}:
        mine = [i for i in sound if got[i].band == value and marks.get(i) is not None]
        cell = lambda i: int(math.floor(got[i].anomaly * 2000))
        for b in range(1000, 2001):
            here = [marks[i] for i in mine if cell(i) == b]
            if here.count(0) > here.count(1) and sum(marks[i] == 1 for i in mine if cell(i) >= b) <= 0.0005 * len(good):
                limit[value] = b / 2000
                break
    assert limit and all(got[i].kept == (i in set(sound) and got[i].anomaly < limit.get(got[i].band, math.inf)) for i in ids)


def test_many_clean_documents_with_one_symbol_stay(spark, docs, labels):
    out = registry.op8_rules(spark, SF)
    clean = out.join(labels, "doc_id").where("quality = 1 and kept and n_symbols = 0 and rule = 'none' and n_words > 200").select("doc_id")
    more = docs.join(clean, "doc_id").withColumns({"doc_id": -F.col("doc_id") - 1, "text": F.concat("text", F.lit(" #"))}).select(docs.columns)
    got = rules.judged(docs.unionByName(more), labels).where("doc_id < 0")
    assert got.count() > 100 and got.where("not kept").count() == 0


def test_clean_document_with_one_symbol_stays(spark, docs, labels):
    out = registry.op8_rules(spark, SF)
    one = out.join(labels, "doc_id").where("quality = 1 and kept and n_symbols = 0 and rule = 'none' and n_words > 200").orderBy("doc_id").first()[0]
    clean = docs.where(F.col("doc_id") == one).withColumns({"doc_id": F.lit(-1).cast("long"), "text": F.concat("text", F.lit(" #"))})
    got = rules.judged(docs.unionByName(clean), labels).where("doc_id = -1").first()
    assert got.rule == "symbols" and got.n_symbols == 1 and got.kept


def test_odd_rows(spark, odd, none, no_labels, docs, labels):
    model = langid.fit(docs.where(key_crc("doc_id") % 5 != 0))
    found = {r.doc_id: r for r in langid.predict(odd, model).collect()}
    assert [found[i].lang_pred for i in (1, 2, 3, 4)] == ["und"] * 4 and found[1].lang_score == 0 and found[6].lang_pred == "en"
    assert langid.predict(odd, langid.fit(none)).where("lang_pred <> 'und'").count() == 0
    tox = toxicity.fit(docs, labels)
    p = {r.doc_id: r.toxic_score for r in toxicity.score(odd, tox).collect()}
    assert p[1] == p[2] == p[3] and 0 <= min(p.values()) <= max(p.values()) <= 1
    assert toxicity.score(odd, toxicity.fit(docs, no_labels)).where("toxic_score <> 0").count() == 0
    assert quality.score(odd, quality.fit(docs, no_labels)).where("quality_score <> 1").count() == 0
    assert quality.score(odd, quality.fit(docs, labels)).count() == 10
    r = {x.doc_id: x for x in rules.judged(odd, no_labels).collect()}
    assert len(r) == 9 and r[1].n_words == 0 and r[1].base_failed and not r[1].kept and r[5].n_words == 60_000
    for out in (langid.predict(none, model), toxicity.score(none, tox), quality.score(none, quality.fit(docs, labels)), rules.judged(none, no_labels)):
        assert out.count() == 0
