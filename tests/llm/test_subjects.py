import random

import numpy as np
from pyspark.sql import functions as F

from fernglass.llm import subjects as S
from fernglass.llm.subjects import leaf_terms, sentences, subject_areas

TERMS = {"law": "verdict tribunal clause notary appeal bail docket tort".split(), "music": "cello sonata fugue overture soprano reverb capo oboe".split(), "sport": "goalkeeper peloton offside regatta scrum volley wicket squad".split()}
FILL = "lantern axis pallet ridge kettle beacon shelf crate".split()


def corpus(seed=4):
    rng = random.Random(seed)
    rows, truth = [], {}
    for i in range(600):
        subjects = rng.sample(sorted(TERMS), rng.choice([0, 1, 1, 1, 2]))
        lines = []
        for _ in range(10):
            lines.append(f"The {rng.choice(FILL)} release is tested nightly on three machines.")
            if subjects:
                a, b = rng.sample(TERMS[rng.choice(subjects)], 2)
                lines.append(f"The {a} screen shows every {b} next to its {rng.choice(FILL)}.")
        rows.append((i, "# Title\n\n" + " ".join(lines)))
        truth[i] = set(subjects)
    return rows, truth


def labelled(truth):
    return [(i, s) for i in range(0, 600, 5) for s in truth[i]] + [(5, "law"), (5, None), (99999, "music"), (None, "law")]


def test_documents_get_their_subjects(spark):
    rows, truth = corpus()
    docs = rows + [(9000, None), (9001, ""), (9002, "```\nverdict cello\n```"), (9003, "x" * 200_000), (None, rows[0][1])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("tokens", F.lit("clash")).withColumn("leaf", F.lit(1))
    ldf = spark.createDataFrame(labelled(truth), "doc_id bigint, subject string")
    found, leaves, counts = subject_areas(df, ldf, sorted(TERMS), leaves=12)
    got = {}
    for r in found.collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
        assert 0.25 <= r.weight <= 1
    # four fifths of these were never labelled
    right = sum(got.get(i, set()) == truth[i] for i in truth)
    assert right >= 0.95 * len(truth)
    assert not any(i in got for i in (9000, 9001, 9002, 9003))
    assert got.get(None, set()) == truth[0]
    assert leaves.count() == len(docs) and leaves.agg(F.count_distinct("leaf")).first()[0] <= 12
    words = {r.word for r in leaf_terms(leaves, counts, df).filter("rank <= 8").collect()}
    assert len(words & {w for t in TERMS.values() for w in t}) >= 12


def test_many_speaking_terms_are_joined_with_the_same_result(spark):
    rows, truth = corpus()
    df = spark.createDataFrame(rows[:300] + [rows[7]], "doc_id bigint, text string")
    ldf = spark.createDataFrame(labelled(truth), "doc_id bigint, subject string")
    sides = [sorted((r.doc_id, r.subject, round(r.weight, 9)) for r in subject_areas(df, ldf, sorted(TERMS), leaves=12, shipped=n)[0].collect()) for n in (0, S.SHIPPED)]
    assert sides[0] == sides[1] and len(sides[0]) > 200


def test_subjects_come_from_the_mixtures_of_leaves():
    # term 0 lies in leaf 0, term 1 in leaf 1, term 2 everywhere alike
    leaf, n, offsets = np.array([0, 1, 0, 1]), np.array([50, 40, 50, 50]), np.array([0, 1, 2, 4])
    base, size = np.array([0.5, 0.5]), np.array([100.0, 100.0])
    for mixtures in (np.array([[0.9, 0.1], [0.2, 0.8]]), np.array([[0.1, 0.9], [0.8, 0.2]])):
        a = S.unmix(leaf, n, offsets, mixtures, base, size)
        assert list(a.argmax(1)[:2]) == list(mixtures.argmax(1)) and a[:2].max(1).min() > S.SPEAKS and a[2].max() < S.SPEAKS


def test_tree_sends_documents_to_the_leaf_they_were_fitted_in():
    rng = np.random.default_rng(3)
    topic = rng.integers(0, 4, 400)
    document = np.repeat(np.arange(400), 5)
    dim = np.concatenate([rng.choice(20, 5, replace=False) + 20 * t for t in topic])
    value = np.full(2000, 5**-0.5, np.float32)
    tree = S.bisect(document, dim, value, 400, 4)
    leaf = tree.descend(document, dim, value, 400)
    assert tree.leaves == 4 and len({(t, x) for t, x in zip(topic, leaf, strict=True)}) == 4


def test_tree_is_fitted_on_every_document(spark, monkeypatch):
    rng = random.Random(8)
    words = [[f"{chr(97 + t)}{chr(97 + i)}word" for i in range(12)] for t in range(6)]
    rows = [(i, " ".join(rng.choices(words[i % 6], k=6) + rng.choices(words[(i // 6) % 6], k=2))) for i in range(9000)] + [(9001, ""), (9002, None)]
    monkeypatch.setattr(S, "SLICE", 5000)
    prepared = S.prepare(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5))
    idf = S.inverse_frequencies(*S.document_frequencies(prepared))
    said = S.vectors(prepared, idf)
    passes, together = S.fit(said, 16, together=0), S.fit(said, 16)
    vectors = [np.frombuffer(r.cells, np.int32) for r in said.collect() if r.cells]
    every = S.bisect_cells(np.concatenate(vectors), np.append(0, np.cumsum([len(x) for x in vectors])), 16)
    assert len(vectors) == 9000
    for tree in (passes, together):
        assert tree.leaves == 16 and (tree.weights == every.weights).all() and (tree.left == every.left).all() and (tree.right == every.right).all()


def test_a_pass_has_tasks_and_rows_by_cells(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices([f"{chr(97 + i % 6)}{chr(97 + j)}word" for j in range(12)], k=6))) for i in range(9000)]
    prepared = S.prepare(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5))
    said = S.vectors(prepared, S.inverse_frequencies(*S.document_frequencies(prepared)))
    cells = said.agg(F.sum(F.length("cells"))).first()[0] // 4
    context = spark.sparkContext
    context.setJobGroup("passes", "")
    try:
        tree = S.fit(said, 6, together=cells // 2 + 1)
        tracker = context.statusTracker()
        tasks = [tracker.getStageInfo(s).numTasks for j in sorted(tracker.getJobIdsForGroup("passes")) for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s)]
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    # the sum of the cells comes before the passes
    assert tree.leaves == 6 and len(tasks) > 20 and max(tasks[4:]) <= 2
    documents = S.Apart(said, 2)
    documents.tally(np.zeros(1, np.int64), np.zeros((1, S.DIMENSIONS), np.float32), True)
    assert documents.said.count() <= cells / S.CACHED + 2
    documents.end()


def test_words_are_those_of_the_sentences():
    rng = random.Random(2)
    odd = ["", ",", "a\n\nbc", "...", ".bc . de", "ab.\u2009cd.\u200bef", "É.\x85Ab?\x1cc", "```x. y", "it`s. `no"] + ["".join(rng.choices("aB, \n.!?`\\&;é„\u200b\xa0\u3000\x0b\x1c\x85ß", k=40)) for _ in range(500)]
    for text in odd:
        want = [x.split() for x in sentences(text) if x.split()]
        assert [x.split() for x in S.words(text).split(S.MARK) if x.split()] == want


def test_empty_and_unlabelled(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, subject string")
    assert subject_areas(none, labels, ["a"])[0].count() == 0
    rows, _ = corpus()
    assert subject_areas(spark.createDataFrame(rows[:40], "doc_id bigint, text string"), labels, ["a"], leaves=3)[0].count() == 0


def test_sentences_drop_code_and_case():
    got = sentences("# A\n\nThe\u00a0CELLO is `verdict` late. See 6.3.1:\n```\ncode verdict\n```\nB&amp;C D")
    assert [x.split() for x in got if x.split()] == [["a"], ["the", "cello", "is", "late"], ["see", "6", "3", "1"], ["b", "c", "d"]]
