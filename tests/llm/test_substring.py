import random

import pytest

from tamarack.llm.substring_dedup import remove_repeats, sentences, spans, without


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)).capitalize() + "."


def test_sentences():
    text = "  One two.  Three!\n\nfour? five e.g. six\n" + "w " * 45
    cut = [text[a:b] for a, b in sentences(text, 20)]
    assert cut[:5] == ["One two.", "Three!", "four?", "five e.g.", "six"]
    assert [len(x.split()) for x in cut[5:]] == [20, 20, 5]
    assert sentences(None, 20) == sentences("", 20) == sentences(" \n ", 20) == []


def test_spans_are_shortest_runs_both_ways():
    rng = random.Random(3)
    for _ in range(60):
        sizes = [rng.choice([1, 2, 3, 8, 12, 19]) for _ in range(rng.randint(0, 25))]
        text = " ".join(sentence(rng, n) for n in sizes)
        found = {(a, a + n) for a, n, _ in spans(text, 2, 25, 20)[1]}
        good = {(a, b) for a in range(len(sizes)) for b in range(a + 2, len(sizes) + 1) if sum(sizes[a:b]) >= 25}
        wanted = {min((x for x in good if x[0] == a), key=lambda x: x[1]) for a in range(len(sizes)) if any(x[0] == a for x in good)}
        wanted |= {max((x for x in good if x[1] == b), key=lambda x: x[0]) for b in range(len(sizes) + 1) if any(x[1] == b for x in good)}
        assert found == wanted
        assert len(spans(text, 2, 25, 20)[1]) == len(found)


def test_planted_passages_go_and_clean_texts_stay(spark):
    rng = random.Random(5)
    passages = [" ".join(sentence(rng, n) for n in sizes) for sizes in ([10] * 5 + [3], [20, 30, 2], [52, 1], [4] * 14, [60])]
    rows, clean = [], {}
    for i in range(120):
        body = [sentence(rng, rng.randint(1, 30)) for _ in range(rng.randint(3, 12))]
        if i % 3 == 0:
            body.insert(rng.randint(0, len(body)), passages[i // 3 % len(passages)])
        else:
            clean[i] = rng.choice([" ", "\n"]).join(body)
        rows.append((i, clean.get(i) or " ".join(body)))
    got = {r.doc_id: r for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].text == t and got[i].n_removed == 0 for i, t in clean.items())
    for p in passages:
        have = [i for i, t in rows if p in t]
        assert [i for i in have if p in got[i].text] == have[:1]
        for i in have[1:]:
            assert got[i].text == " ".join(dict(rows)[i].replace(p, "\0").replace(" \0", "").replace("\0 ", "").split(" "))


@pytest.mark.parametrize("text", ["A b.", None, ""])
def test_nothing_to_remove(text):
    assert without(text, [], 20)[0] == text


def test_repeats_inside_one_text(spark):
    rng = random.Random(9)
    p, q = (" ".join(sentence(rng, 10) for _ in range(4)) for _ in range(2))
    got = remove_repeats(spark.createDataFrame([(1, f"{p}\n{q}\n{p}")], "doc_id long, text string")).first()
    assert got.text == f"{p}\n{q}" and got.n_removed == 4


def test_passage_at_any_offset_of_an_unpunctuated_text_goes(spark):
    rng = random.Random(11)
    words = lambda n: sentence(rng, n)[:-1].lower().split()
    rows, passages = [], []
    for k in range(40):
        p = words(60 + rng.randint(0, 30))
        passages.append(p)
        for j in range(2):
            rows.append((2 * k + j, " ".join(words(rng.randint(0, 150)) + p + words(rng.randint(0, 150)))))
    got = {r.doc_id: r for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, p in enumerate(passages):
        assert got[2 * k].text == rows[2 * k][1]
        kept = f" {got[2 * k + 1].text} "
        assert not any(f" {' '.join(p[i : i + 51])} " in kept for i in range(len(p) - 50))
        assert got[2 * k + 1].n_removed > 1


def test_three_short_sentences_are_a_run_and_single_lines_are_not(spark):
    rng = random.Random(12)
    short, two = " ".join(sentence(rng, 8) for _ in range(3)), " ".join(sentence(rng, 8) for _ in range(2))
    rows = [(k, " ".join([sentence(rng, 9), p, sentence(rng, 7)])) for k, p in enumerate([short, short, two, two])]
    got = {r.doc_id: r for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k].n_removed for k in range(4)] == [0, 3, 0, 0]
    assert short not in got[1].text and got[2].text == rows[2][1]


def test_recall_of_passages_over_offsets(spark):
    """Passages of 60 to 90 words at every offset up to 39 of texts with and without full stops."""
    rng, rows, passages = random.Random(21), [], []
    for k in range(80):
        stops = k % 2
        body = lambda n: " ".join(sentence(rng, min(n, 14)) for _ in range(max(1, n // 14))) if stops else sentence(rng, n)[:-1].lower()
        p = body(rng.randint(60, 90))
        passages.append(p)
        rows += [(2 * k, f"{body(30)} {p} {body(30)}"), (2 * k + 1, f"{body(k // 2 + 1)} {p} {body(25)}")]
    got = {r.doc_id: r for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    kept = [sum(w in got[2 * k + 1].text.split() for w in p.split()) for k, p in enumerate(passages)]
    words = sum(len(p.split()) for p in passages)
    share = 1 - sum(kept) / words
    print("words of repeated passages removed", share)
    assert share >= 0.8 and all(n < 51 for n in kept)
    assert all(got[2 * k].n_removed == 0 for k in range(80))
