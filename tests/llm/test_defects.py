import random

import numpy as np
import pytest

from quernel.llm import answer_pairs as A
from quernel.llm import scan_noise as S

SUBJECTS = "the index,the old graph,the vector store,the query plan,the cache,the storage engine".split(",")
VERBS = "reads,writes,merges,drops,keeps,scans".split(",")


def sentence(rng):
    return f"{rng.choice(SUBJECTS).capitalize()} {rng.choice(VERBS)} {rng.choice(SUBJECTS)} before {rng.choice(SUBJECTS)} of the team is ready."


GERMAN = "Der Index und die Liste sind nicht mit dem Speicher und der Anfrage von der Gruppe zu lesen, weil die Daten auf dem Server noch nicht für das Team bereit sind."


def pairs():
    rng = random.Random(12)
    rows = [(i, f"What does {rng.choice(SUBJECTS)} do in the system of the team?", " ".join(sentence(rng) for _ in range(3)), None) for i in range(600)]
    rows += [(1000 + i, f"Was macht der Index {i} mit der Liste und dem Speicher von dem Team?", GERMAN, None) for i in range(40)]
    q = "What does the index do in the system of the team?"
    for k, a in enumerate([None, "", " \n", "N/A", "<answer></answer>", "**", "(empty)", "​", "A: ", "```\n```"]):
        rows.append((2000 + k, q, a, "empty"))
    for k, a in enumerate([q, q.upper(), f"**{q}**", f"You asked: {q}", f"{q}\n{q}"]):
        rows.append((2100 + k, q, a, "copy"))
    for k, a in enumerate(["I cannot answer this based on the given passage.", "sorry, this is something i have to decline.", "Je suis désolé, je ne peux pas répondre à cette question.", "Es tut mir leid, dazu kann ich keine Auskunft geben.", "Lo siento, no puedo responder a esa pregunta."]):
        rows.append((2200 + k, q, a, "refusal"))
    rows += [(2300, q, GERMAN, "language"), (2301, "Was macht der Index mit der Liste und dem Speicher von dem Team?", "The index reads the list of the team and this is what it does for all of the queries.", "language")]
    good = sentence(rng)
    for k, a in enumerate([f"{good} The old graph reads the", f"{good} The storage eng", f"{good}\n1. The cache keeps the index before the cache of the team is ready.\n2.", f"{good}\n```python\nx = 1", f"{good} The cache keeps the index,"]):
        rows.append((2400 + k, q, a, "truncated"))
    for k, a in enumerate(["Yes.", "42 ms", "2025-01-02", good[:-1], f"{good} [4]", f"{good} …", f"{q} {good}", f"{good}\n```\nx = 1\n```"]):
        rows.append((2500 + k, q, a, None))
    rows += [(2600, None, good, None), (2601, "", good, None)]
    return rows


def test_defects(spark):
    rows = pairs()
    df = spark.createDataFrame([(i, q, a, 1) for i, q, a, _ in rows] + [(2000, rows[0][1], None, 2)], "result_id long, question string, answer string, place int")
    got = {r.result_id: r.defect for r in A.defects(df).collect()}
    want = {i: d for i, _, _, d in rows if d}
    assert {i: (got.get(i), want.get(i)) for i in {*got, *want} if got.get(i) != want.get(i)} == {}
    assert A.defects(df.where("false")).count() == 0


def scanned(rng, i):
    lines = [" ".join(rng.choice("the index reads every vector and keeps a graph of near neighbours before merging long lists".split()) for _ in range(9)) for _ in range(14)]
    return lines


def test_scan_noise(spark):
    rng = random.Random(13)
    clean = {i: "\n".join(scanned(rng, i)) for i in range(300)}
    noisy = {}
    for i in range(400, 420):
        t = scanned(rng, i)
        noisy[i] = ("\n".join([*t[:5], t[5] + " neigh-", "bours " + t[6], *t[7:]]), {"hyphen"})
        t = scanned(rng, i)
        noisy[i + 100] = ("\n".join([*t[:5], "the ind@x rcads every neigb" + "bour", *t[6:]]).replace("ind@x", "gr@ph").replace("neigbbour", "neigbbours"), {"glyph"})
        t = scanned(rng, i)
        noisy[i + 200] = ("\n".join([*t[:4], "Annual Report Of Things", *t[4:9], "Annual Report Of Things", *t[9:]]), {"header"})
        t = scanned(rng, i)
        noisy[i + 300] = ("\n".join([*t[:7], "- 17 -", *t[7:]]), {"page"})
        t = scanned(rng, i)
        noisy[i + 400] = ("\n".join([*t[:4], "11", "57", "23", *t[4:]]), set())  # a column of numbers is none
        t = scanned(rng, i)
        noisy[i + 500] = ("\n".join([*t[:4], "the hand-made graph and the hand-", "made index " + t[5], *t[6:]]), set())
    rows = [(i, t, "x") for i, t in clean.items()] + [(i, t, "y") for i, (t, _) in noisy.items()] + [(9001, None, ""), (9002, "", ""), (9003, " \n ", "")] + [(400, noisy[400][0], "again")]
    df = spark.createDataFrame(rows, "id long, text string, noise string")
    model = S.learn(df)
    got = {}
    for r in S.found(df, model=model).collect():
        got.setdefault(r.id, set()).add(r.noise)
    want = {i: k for i, (_, k) in noisy.items() if k}
    assert {i: (got.get(i), want.get(i)) for i in {*got, *want} if got.get(i) != want.get(i)} == {}
    fixed = {r.id: r.text for r in S.repaired(df, model=model).collect()}
    assert "neighbours" in fixed[400] and "the graph r" in fixed[500] and "gr@ph" not in fixed[500] and "Annual" not in fixed[600] and "17" not in fixed[700] and "11" in fixed[800] and "hand-made index" in fixed[900]
    assert fixed[9001] is None and fixed[9002] == "" and "\n" not in fixed[400]
    assert S.found(df.where("false")).count() == 0


@pytest.mark.parametrize("n", [50_000])
def test_very_long_words_do_not_stall(n):
    m = S.Model({"index": 100, "graph": 90})
    text, kinds = S.repair("a" * n + "-\n" + "b" * n + "\n" + "0f" * n, m)
    assert len(text) > n


def test_running_heads_that_end_in_a_stop(spark):
    rng = random.Random(14)
    model = S.learn(spark.createDataFrame([(i, "\n".join(scanned(rng, i))) for i in range(200)], "id long, text string"))
    spaced = "   ".join(" ".join(w) for w in "Chapter 17: compaction run behind the result page".split())
    assert len(spaced) > 80
    for head in ("Torasael et al.", "Torasael et a1.", "TORASAEL ET AL.", "T o r a s a e l   e t   a l .", spaced):
        t = scanned(rng, 1)
        text, kinds = S.repair("\n".join([*t[:4], head, *t[4:9], head, *t[9:]]), model)
        assert kinds - {"glyph"} == {"header"} and text.replace("\n", " ").split() == " ".join(t).split(), head
    t = scanned(rng, 2)
    assert S.repair("\n".join([*t[:4], "Who keeps it?", "7", *t[4:9], "Who keeps it?", "8", *t[9:]]), model)[1] == {"header", "page"}
    # the last line of a wrapped sentence is no head, however often it recurs
    kept = "\n".join([*t[:4], "percent more.", "The graph " + t[4], *t[5:9], "percent more.", "", *t[9:]])
    assert S.repair(kept, model)[1] == set() and S.repair(kept, model)[0].count("percent more.") == 2


def test_roman_page_numbers():
    rng, model = random.Random(15), S.Model({"index": 100, "graph": 90})
    t = scanned(rng, 2)
    for a, b in (("xi", "xii"), ("- iv -", "- ix -"), ("[xix]", "[xx]"), ("i", "ii"), ("XIV", "XV")):
        text, kinds = S.repair("\n".join([*t[:5], a, *t[5:10], b, *t[10:]]), model)
        assert kinds == {"page"} and text.split() == " ".join(t).split(), (a, b)
    for lines in (["i", "ii", "iii"], ["c"], ["(ii"], ["civil"], ["Xi"]):  # a column, a lone letter, an open bracket, words
        assert S.repair("\n".join([*t[:5], *lines, *t[5:]]), model)[1] == set(), lines


def test_refusals_alike_in_all_languages_and_learned_from_recurrence(spark):
    for a in ("Debo rechazar esta petición.", "Je dois refuser cette demande.", "Diese Anfrage muss ich ablehnen.", "My guidelines prevent me from discussing Tesmoeth. Is there anything else I can do for you?", "It would not be appropriate for me to comment on Tesmoeth."):
        assert A.is_refusal(a), a
    for a in ("I cannot say enough good things about HNSW, it is fast.", "No tengo dudas: HNSW usa un grafo.", "The form answers 'I don't know' where nothing was found."):
        assert not A.is_refusal(a), a
    for a in ("Sorry, but this is beyond my remit.", "This request can't be fulfilled.", "Leider fehlen mir dazu Informationen."):
        assert A.is_refusal(a), a
    assert [A.is_empty(x) for x in ("Todo", "A", "Response", "TODO", "n/a", "Antwort:")] == [False, False, False, True, True, True]
    assert not A.is_refusal("Tesmoeth cannot skip the cheap tie rule of the index.")
    topics = ["vector store", "query plan", "storage engine", "tie rule"]
    rows = [(f"What does the {t} do in the system?", f"Talking about the {t} is a thing my makers asked me to leave alone.") for t in topics]
    rows += [(f"What does the {t} do in the system?", f"The {t} reads and keeps every one of the rows it was given.") for t in topics]  # no first person
    rows += [(f"What does the {topics[0]} do in the system {i}?", "My index reads the lists of the team before it merges them.") for i in range(5)]  # one question
    declined = A.refused(spark.createDataFrame(rows, "q string, a string"), A.Settings())
    assert [A.form_of(q, a) in declined for q, a in rows] == [True] * 4 + [False] * 9
    held_out = ("What does the cold start do in the system?", "Talking about the cold start is a thing my makers asked me to leave alone.")
    assert A.form_of(*held_out) in declined


def test_end_model_counts_all_rows(spark):
    rows = [(i, f"What does it do {i}?", "The index reads the lists.") for i in range(60_000)] + [(60_000, "Why?", "The index reads the lists. " * 1000)]
    model = A.learn(spark.createDataFrame(rows, "result_id long, question string, answer string"))
    code, n = A.coded(["The index reads the lists"], model.codes)
    assert model.end_counts(A.contexts(code, n, model.opens)[-1:])[0, 0].tolist() == [61_000, 61_000]


def test_every_word_of_the_vocabulary_has_a_vector(spark):
    rows = [(i, f"the graph reads w{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}{chr(97 + i // 676)}x and keeps the list") for i in range(6000) for _ in range(8)]
    model = S.learn(spark.createDataFrame(rows, "id long, text string"))
    rare = [w for w, n in model.count.items() if n == 8]
    assert len(rare) == 6000 and all(model.affinity(w, ["the", "graph"]) is not None for w in rare)
    # the same as of a whole matrix, factorised at once
    c = len(model.contexts)
    n = np.zeros((len(model.count), c))
    for _, t in rows:
        at = [model.place[w] for w in S.tokens(t)]
        for i, x in enumerate(at):
            for y in at[max(0, i - 3) : i] + at[i + 1 : i + 4]:
                if y < c:
                    n[x, y] += 1
    expected = n.sum(axis=1, keepdims=True) * n.sum(axis=0) ** 0.75 / (n.sum(axis=0) ** 0.75).sum()
    u, s, w = np.linalg.svd(np.log((n + 0.5) / (expected + 0.5)), full_matrices=False)
    k = model.contexts.shape[1]
    assert np.abs(model.vectors @ model.contexts.T - u[:, :k] * s[:k] @ w[:k]).max() < 1e-3


def test_vocabulary_has_no_limit(spark):
    texts = [" ".join(f"x{a}y{b}" for b in range(500)) for a in range(201)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 5)], "id long, text string")
    assert len(S.learn(df).count) == 100_500
