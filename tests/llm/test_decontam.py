import random

from granary.llm import decontam

from tests.llm.conftest import docs


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def vocabulary(rng, n=300):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6))) for _ in range(n)]


def case(seed):
    rng = random.Random(seed)
    words = vocabulary(rng)
    bench = [(i, " ".join(rng.choices(words, k=rng.randint(3, 60)))) for i in range(60)]
    texts = []
    for _ in range(150):
        body = rng.choices(words, k=rng.randint(0, 300))
        if rng.random() < 0.5:
            own = rng.choice(bench)[1].upper().split()
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(len(own))] = "changed"
            at = rng.randint(0, len(body))
            body = body[:at] + [", ".join(own)] + body[at:]
        texts.append(" ".join(body))
    return bench, texts


def shares(item, text):
    w, t = decontam.words_of(item.encode()), decontam.words_of(text.encode())
    n = min(5, len(w))
    there = {tuple(t[i : i + n]) for i in range(len(t) - n + 1)}
    hit = [tuple(w[i : i + n]) in there for i in range(len(w) - n + 1)]
    covered = [any(hit[max(0, i - n + 1) : i + 1]) for i in range(len(w))]
    cut = -(-len(w) * 2 // 3)
    return min(sum(hit) / len(hit), sum(covered[:cut]) / cut, sum(covered[cut:]) / (len(w) - cut) if cut < len(w) else 1)


def test_matches_are_those_of_brute_force(spark):
    bench, texts = case(1)
    expected = {(i, k) for i, t in enumerate(texts) for k, item in bench if shares(item, t) >= 0.8}
    got = {(r["id"], r["item_id"]) for r in decontam.contaminations(docs(spark, texts), items(spark, bench)).collect()}
    assert expected and got == expected


def test_wand_retrieves_all_above_threshold(monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK", 3)
    rng = random.Random(2)
    words = vocabulary(rng, 12)
    index = decontam.build_index([(i, " ".join(rng.choices(words, k=rng.randint(5, 9))), None) for i in range(200)])
    for _ in range(200):
        terms = rng.sample(range(len(index.hashes)), 25)
        score = {}
        for t in terms:
            for item, w in zip(index.items[index.at[t] : index.at[t + 1]].tolist(), index.impacts[index.at[t] : index.at[t + 1]].tolist()):
                score[item] = score.get(item, 0) + w
        for threshold in (0.3, 1.0):
            expected = {i for i, s in score.items() if s >= threshold}
            got = dict(decontam.block_max_wand(index, terms, threshold))
            assert {i for i in got} == {i for i in expected if abs(score[i] - threshold) > 1e-9} | {i for i in got if abs(score[i] - threshold) <= 1e-9}
            assert all(abs(got[i] - score[i]) < 1e-9 for i in got)


def test_question_and_answer_must_both_be_there():
    words = [f"w{i}" for i in range(30)]
    index = decontam.build_index([(1, " ".join(words[:24]), " ".join(words[24:]))])
    text = lambda w: decontam.words_of(" ".join(w).encode())
    assert list(decontam.matches(index, text(["x", *words, "y"]))) == [0]
    assert decontam.matches(index, text(["x", *words[:24], "y", "y"])) == {}
    assert decontam.matches(index, text(words[6:])) == {}
    assert decontam.verify(index, 0, index.item(0)) == (1.0, 1.0, 1.0)


def test_many_indexes_give_the_same(spark, monkeypatch):
    bench, texts = case(3)
    ask = lambda: sorted((r["id"], r["item_id"]) for r in decontam.contaminations(docs(spark, texts), items(spark, bench)).collect())
    one = ask()
    monkeypatch.setattr(decontam, "INDEX_BYTES", 3000)
    assert len(list(decontam.indexes(items(spark, bench)))) > 3
    assert ask() == one


def test_awkward_rows(spark, awkward, empty):
    bench = items(spark, [(7, "some words, that ARE here"), (8, None), (9, ""), (None, "a text without an id"), (10, "...")])
    got = sorted((str(r["id"]), str(r["item_id"])) for r in decontam.contaminations(awkward, bench).collect())
    assert got == [("1", "7"), ("1", "7"), ("None", "None")]
    kept = decontam.decontaminated(awkward, bench)
    assert kept.columns == awkward.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4, 5]
    assert decontam.contaminations(empty, bench).collect() == []
    none = items(spark, [])
    assert decontam.decontaminated(awkward, none).count() == awkward.count()


def test_the_shingles_alone_decide_where_question_or_answer_lacks(spark):
    words = [f"w{i}" for i in range(36)]
    rows = decontam.contaminations(docs(spark, [" ".join(words[:33]), " ".join(words[:28])]), items(spark, [(1, " ".join(words))])).collect()
    assert [(r["id"], r["shingle_overlap"], r["question_overlap"], r["answer_overlap"]) for r in rows] == [(0, 29 / 32, 33 / 36, None)]
    index = decontam.build_index([(1, None, " ".join(words)), (2, " ".join(words), "")])
    assert sorted(decontam.matches(index, decontam.words_of(" ".join(words[:33]).encode()))) == [0, 1]


def test_clean_rows_stay_whatever_their_ids(spark):
    """A leaked row with a null or shared id takes no clean row with it."""
    words = [f"w{i}" for i in range(40)]
    clean = " ".join(f"c{i}" for i in range(60))
    rows = [(None, " ".join(words)), (None, clean), (7, " ".join(words)), (7, clean), (8, None), (8, ""), (9, clean)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, item_id string")
    kept = decontam.decontaminated(df, items(spark, [(1, " ".join(words))]))
    assert kept.columns == df.columns
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept.collect()) == sorted((str(i), str(t)) for i, t in rows if t != " ".join(words))


def test_an_index_stays_small_beside_its_texts():
    rng = random.Random(9)
    bench = [(i, " ".join(f"{rng.randrange(10**7)}" for _ in range(400)), None) for i in range(400)]
    index = decontam.build_index(bench)
    assert index.nbytes() < 10 * sum(len(t) for _, t, _ in bench)
