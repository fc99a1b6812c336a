import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from packsight.llm import boosting, langid, quality, toxicity
from packsight.llm.langid import HASHES, N, SLOTS_LOG2, folded, grams, identify, keep_known

SF = "/root/testdata/sf0.01"


def remainder(i, m):
    return zlib.crc32(str(i).encode()) % m


@pytest.fixture(scope="module")
def data(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def auc(score, y):
    score, y = np.asarray(score), np.asarray(y)
    a, b = score[y == 1], score[y == 0]
    return ((a[:, None] > b).mean() + (a[:, None] == b).mean() / 2).item()


def test_language_accuracy_on_held_out_documents(spark, data):
    docs, _ = data
    rows = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count() and all(r.held_out == (remainder(r.doc_id, 4) == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.98 and all(0 <= r.score <= 1 for r in rows)


def test_held_out_labels_are_not_read(spark, data):
    docs, labels = data
    flipped = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, "xx").otherwise(F.col("lang")))
    assert sorted(map(tuple, identify(flipped).collect())) == sorted(map(tuple, identify(docs).collect()))
    wrong = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(map(tuple, quality.score_quality(docs, wrong).collect())) == sorted(map(tuple, quality.score_quality(docs, labels).collect()))
    wrong = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(map(tuple, toxicity.score_toxicity(docs, wrong).collect())) == sorted(map(tuple, toxicity.score_toxicity(docs, labels).collect()))


def test_filter_answers_all_languages_of_a_gram_and_corrects_for_false_positives():
    texts = {"aa": ["the quick brown fox jumps"], "bb": ["the slow green fox sleeps"]}
    slices = np.zeros((1, 1 << SLOTS_LOG2), dtype=np.uint64)
    for i, lang in enumerate(texts):
        for s in langid._slots(np.unique(grams(folded(texts[lang][0])))):
            slices[0, s] |= np.uint64(1 << i)
    f = langid.Filter(list(texts), slices)
    shares = f.shares([folded("the quick brown fox jumps"), folded("zzzzzz qqqqqq"), b""])
    assert shares[0, 0] == pytest.approx(1, abs=0.01) and 0 < shares[0, 1] < 0.6 and shares[1].max() == 0 and shares[2].max() == 0
    full = langid.Filter(["aa"], np.where(np.random.default_rng(0).random((1, 1 << SLOTS_LOG2)) < 0.6, 1, 0).astype(np.uint64))
    noise = folded("".join(random.Random(1).choice("abcdefghij ") for _ in range(40_000)))
    assert full.wrong[0] == pytest.approx(0.6**HASHES, rel=0.05) and full.shares([noise])[0, 0] < 0.03


def test_language_query_against_brute_force(spark, data):
    """Sets of n-grams for each language in place of filters, n-grams by slicing."""
    rows = data[0].select("doc_id", "text", "lang").collect()

    def sliced(text):
        kept = "".join(c if "a" <= c <= "z" or ord(c) >= 128 else " " for c in text.lower()).split()
        data = (" " + " ".join(kept) + " ").encode()
        return [data[i : i + N] for i in range(len(data) - N + 1)]

    learned = [r for r in rows if r.text is not None and r.lang is not None and remainder(r.doc_id, 4) != 2]
    sizes, having = {}, {}
    for r in learned:
        sizes[r.lang] = sizes.get(r.lang, 0) + 1
        for g in set(sliced(r.text)):
            having.setdefault(g, {}).setdefault(r.lang, []).append(1)
    names = sorted(sizes)
    known = {lang: set() for lang in names}
    for g, by in having.items():
        rate = {lang: len(n) / sizes[lang] for lang, n in by.items()}
        for lang, n in by.items():
            if len(n) >= langid.LEAST_DOCS and rate[lang] >= langid.RATIO * max(rate.values()):
                known[lang].add(g)
    got = {r.doc_id: r for r in identify(data[0]).collect()}
    for r in rows:
        if r.text is None or not any(map(str.isalpha, r.text)):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0)
            continue
        found = sliced(r.text)
        share = [sum(g in known[lang] for g in found) / max(1, len(found)) for lang in names]
        if max(share) - sorted(share)[-2] > 0.02:  # false positives that correction leaves
            assert got[r.doc_id].lang_pred == names[share.index(max(share))]
        assert got[r.doc_id].score == pytest.approx(max(share) / max(sum(share), langid.FLOOR), abs=0.06)


def test_grams_by_hand():
    want = [int.from_bytes(b"hello world"[i : i + N], "big") for i in range(11 - N + 1)]
    assert grams(b"hello world").tolist() == want


def test_language_edge_cases(spark, data):
    docs, _ = data
    odd = [(1, None), (2, ""), (3, "123 !? \n"), (4, "日本"), (None, "the and of"), (6, "a"), (7, "½ ²"), (7, "½ ²")]
    extra = spark.createDataFrame([(i, t, None, "s", 0, 1.0) for i, t in odd], "doc_id long, text string, lang string, source string, n_chars long, score double")
    model = langid.learn(docs)
    got = [(r.doc_id, r.lang_pred) for r in identify(extra, model).collect()]
    assert len(got) == len(odd) and {i for i, p in got if p == "und"} == {1, 2, 3, 7}
    kept = keep_known(extra, model)
    assert kept.columns == extra.columns and {r.doc_id for r in kept.collect()} == {4, None, 6}
    assert {r.lang_pred for r in identify(extra).collect()} == {"und"} and identify(docs.where("false")).count() == 0
    assert keep_known(docs, model).count() == docs.count()


def test_many_languages_use_several_words_of_bits(spark):
    letters = str.maketrans("0123456789", "ghijklmnop")
    rows = [(i, f"zq{i % 70:02d}abc".translate(letters) + " " * (i % 3) + " wort", f"l{i % 70:02}", "s", 0) for i in range(420)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = identify(df).join(df.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.95


def test_quality_accuracy(spark, data):
    docs, labels = data
    rows = quality.score_quality(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (remainder(r.doc_id, 3) == 1) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    assert auc([r.score for r in held], [r.quality for r in held]) >= 0.95


def test_toxicity_accuracy(spark, data):
    docs, labels = data
    rows = toxicity.score_toxicity(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (remainder(r.doc_id, 4) == 2) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.predicted == r.toxic for r in held) / len(held) >= 0.9


@pytest.mark.parametrize("score", [quality.score_quality, toxicity.score_toxicity])
def test_classifier_edge_cases(spark, data, score):
    docs, labels = data
    odd = spark.createDataFrame([(1, None), (None, "words"), (2, ""), (3, " \n"), (4, "long " * 30_000), (4, "long " * 30_000)], "doc_id long, text string").withColumn("label", F.lit("x")).withColumn("quality", F.lit(3))
    assert len([r for r in score(odd, labels).collect() if 0 <= r.score <= 1]) == 6
    assert score(docs, labels.where("false")).count() == docs.count() and score(docs.where("false"), labels).count() == 0
    nulls = spark.createDataFrame([(None, 1, 1), (1, None, None), (2, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert score(docs, nulls).count() == docs.count()


def test_boosting_learns_and_flattens():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 6))
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] * x[:, 1] > 0)).astype(float)
    trees = boosting.fit(x[:2000], y[:2000], trees=120)
    assert ((trees.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9

    def walk(row):
        total = trees.base
        for node in trees.roots:
            while trees.child[node, 0] != node:
                node = trees.child[node, int(row[trees.feature[node]] > trees.threshold[node])]
            total += trees.value[node]
        return 1 / (1 + np.exp(-total))

    assert trees.score(x[:50]) == pytest.approx([walk(r) for r in x[:50]])


def test_composed_transducers_run_in_step():
    parts = [toxicity._target(), toxicity._negation(), toxicity._report(), toxicity._hostile()]
    to, factor = toxicity.compose(parts)
    states, at = [0] * 4, 0
    for symbol in random.Random(2).choices(range(8), k=500):
        steps = [p.step[s, symbol] for p, s in zip(parts, states, strict=True)]
        assert factor[at, symbol] == pytest.approx(np.prod([f for _, f in steps]))
        states, at = [s for s, _ in steps], to[at, symbol]
    assert len(to) == 2 * 4 * 3 * 3


def test_clauses_weigh_by_context():
    g = toxicity.Grammar({"idiot": 1.0, "scum": 1.0}, {"lowei": 0.9})
    score = lambda t: toxicity.raw_score(g, t)
    assert score("what a lovely day") == 0 and score(None) == 0
    assert score("you are an idiot") > score("an idiot") > score("no idiot") > 0
    assert score("an idiot") > score('it read "an idiot"') > 0 and score("he said idiot") < score("he is idiot")
    assert score("idiot scum") > score("idiot. fine. scum") > score("idiot") and score("loweichen") == pytest.approx(0.9)
    assert score("you kill") > 0
    assert score("kill") == 0


def test_targets_count_after_threats_and_insults():
    g = toxicity.Grammar({"idiot": 1.0}, {})
    score = lambda t: toxicity.raw_score(g, t)
    assert score("I will kill you") == pytest.approx(score("you kill")) and score("kill yourself") > 0 and score("destroy them all") > 0
    assert score("I will kill you") > score("I will not kill you") > 0 and score("kill it. you") == score("kill the process") == 0
    assert score("idiot, you") == pytest.approx(score("you idiot")) and score("idiot. you") == score("idiot")
    assert score("kill you and you") == pytest.approx(score("kill you"))
    assert g.score("I will kill you") > g.score("a clean text")


def test_toxicity_query_against_brute_force(spark, data):
    """Every document's clauses read token by token, each rule looked up in the clause instead of in a table of states."""
    docs, labels = data
    model = toxicity.learn(docs, labels)
    known = dict(toxicity.CLOSED)

    def clause_scores(text):
        tokens = toxicity.TOKEN.findall((text or "").lower())
        out, clause, quoted, said = [], [], False, False
        for t in [*tokens, "."]:
            mark = len(t) == 1 and not t.isalpha()
            weight = 0.0 if mark else max([model.words.get(t, 0.0), *[model.stems.get(t[:n], 0.0) for n in toxicity.STEMS if len(t) >= n]])
            kind = toxicity.INSULT if weight else (toxicity.QUOTE if t in "\"“”«»" else toxicity.BREAK) if mark else known.get(t, toxicity.OTHER)
            if kind == toxicity.THREAT:
                weight = toxicity.THREAT_WEIGHT
            if kind != toxicity.BREAK:
                clause.append((kind, weight, 0.6 if quoted else 0.7 if said else 1.0))
            if kind == toxicity.QUOTE:
                quoted, said = not quoted, False
            elif kind == toxicity.REPORT and not quoted:
                said = True
            elif kind == toxicity.BREAK:
                kinds = [k for k, *_ in clause]
                total = 0.0
                for i, (k, w, told) in enumerate(clause):
                    if k not in (toxicity.INSULT, toxicity.THREAT):
                        continue
                    before = kinds[:i]
                    w *= told * (0.6 if toxicity.NEGATION in before[-toxicity.REACH :] else 1)
                    w *= 1.4 if toxicity.THREAT in before else 1.2 if toxicity.INSULT in before else 1
                    target = toxicity.TARGET in kinds
                    total += w * (toxicity.TARGETED if target else 1 if k == toxicity.INSULT else 0)
                if total:
                    out.append(total)
                clause, said = [], False
        return out

    rows = toxicity.score_toxicity(docs, labels, model).join(docs.select("doc_id", "text"), "doc_id").collect()
    hit = 0
    for r in rows:
        raw = sum(s / (1 + i) for i, s in enumerate(sorted(clause_scores(r.text), reverse=True)))
        hit += raw > 0
        assert r.score == pytest.approx(1 / (1 + np.exp(-model.slope * (raw - model.middle))), abs=1e-9)
    assert len(rows) == docs.count() and hit > 20


def test_quality_query_against_brute_force(spark, data):
    """Statistics counted one character, word and line at a time, and trees walked node by node."""
    docs, labels = data
    model = quality.learn(docs, labels)

    def counted(text):
        words = (text or "").encode().split()
        if not words:
            return [0.0] * len(quality.FEATURES)
        data = text.encode()
        lines = [x for x in data.split(b"\n") if x.split()]
        n, w = len(data), len(words)
        among = lambda test: sum(map(test, data)) / n
        triples = [tuple(words[i : i + 3]) for i in range(w - 2)]
        symbols = b"#$%&*+<=>@\\^_`{|}~"
        return [
            np.log1p(n), np.log1p(w), sum(map(len, words)) / w, among(lambda c: 65 <= c <= 90), among(lambda c: 48 <= c <= 57), among(lambda c: c in b" \t\n\r\v\f"),
            among(lambda c: c in symbols), among(lambda c: c > 127), sum(c == 124 for c in data) / w, sum(c == 33 for c in data) / w, len(lines) / w,
            np.log1p(w / len(lines)), sum(len(x.split()) < 4 for x in lines) / len(lines), sum(x.rstrip().endswith((b".", b"!", b"?", b'"')) for x in lines) / len(lines),
            len(set(words)) / w, 1 - len(set(lines)) / len(lines), 1 - len(set(triples)) / len(triples) if triples else 0.0, max(words.count(x) for x in set(words)) / w,
            sum(len(x) > 14 for x in words) / w, sum(x[-1] in symbols for x in words) / w, sum(x.isupper() and len(x) > 1 for x in words) / w,
            len(zlib.compress(data, 1)) / n, data.count(b"://") / w, sum(c == 44 for c in data) / w, sum(c == 46 for c in data) / w,
        ]

    def walked(x):
        total = model.base
        for node in model.roots.tolist():
            while model.child[node][0] != node:
                node = model.child[node][int(x[model.feature[node]] > model.threshold[node])]
            total += model.value[node]
        return 1 / (1 + np.exp(-total))

    rows = quality.score_quality(docs, labels, model).join(docs.select("doc_id", "text"), "doc_id").collect()
    assert len(rows) == docs.count()
    for r in rows:
        if len(r.text or "") < 6000:
            x = counted(r.text)
            assert quality.statistics(r.text) == pytest.approx(x, abs=1e-12)
            assert r.score == pytest.approx(walked(quality.statistics(r.text)), abs=1e-9)


def test_language_of_very_long_texts(spark, data):
    docs, _ = data
    long = [(i, " ".join([r.text] * (3_000_000 // max(1, len(r.text)))), r.lang) for i, r in enumerate(docs.where("length(text) > 2000").limit(4).collect())]
    got = {r.doc_id: r.lang_pred for r in identify(spark.createDataFrame(long, "doc_id long, text string, lang string"), langid.learn(docs)).collect()}
    assert got == {i: lang for i, _, lang in long}
