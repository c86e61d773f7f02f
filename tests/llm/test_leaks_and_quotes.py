import itertools
import random

import pytest
from cases import ODD, docs, prose
from hypothesis import given, settings, strategies as st

from duskline.llm import decontaminate, quotes

ITEMS = [(i, prose(700 + i, 20 + 5 * i)) for i in range(24)]
ITEMS += [(90, "Which word is it? It is word."), (91, None), (92, "..."), (None, prose(1, 30)), (93, "tiny")]


def bench(spark, items=ITEMS):
    return spark.createDataFrame(items, "item_id long, text string")


def leaking():
    texts = [(i, prose(800 + i, 300)) for i in range(20)]
    for i in range(0, 20, 2):
        words = texts[i][1].split()
        at = 37 * i % 280
        texts[i] = (i, " ".join([*words[:at], ITEMS[i][1], *words[at:]]))
    return texts + [(500, f"{prose(3, 30)}, {ITEMS[3][1].upper()}! {ITEMS[4][1]}")]


def expected(texts, items):
    """Every document against every item, by shingles alone."""
    found = set()
    for doc_id, text in texts:
        words = decontaminate.words_of(text)
        for item_id, item in items:
            if item_id is None or not decontaminate.words_of(item):
                continue
            parts = [decontaminate.words_of(item), *decontaminate.question_and_answer(item)]
            shares = []
            for part in map(decontaminate._shingles, parts):
                sizes = {len(s) for s in part}
                held = {s for n in sizes for s in zip(*(words[i:] for i in range(n)))}
                shares.append(len(part & held) / len(part) if part else 1.0)
            if shares[0] >= 0.75 and min(shares[1:]) >= 0.5:
                found.add((doc_id, item_id))
    return found


@pytest.mark.parametrize("pieces", [decontaminate.INDEX_PIECES, 6])
def test_leaks_equal_brute_force(spark, monkeypatch, pieces):
    monkeypatch.setattr(decontaminate, "INDEX_PIECES", pieces)
    texts = leaking() + ODD
    found = decontaminate.find_leaks(docs(spark, texts), bench(spark)).collect()
    pairs = [(r["doc_id"], r["item_id"]) for r in found]
    assert set(pairs) == expected(texts, ITEMS)
    assert {(i, i) for i in range(0, 20, 2)} | {(500, 3), (500, 4)} <= set(pairs)
    assert all(r["score"] >= decontaminate.THRESHOLD and r["overlap"] >= 0.75 for r in found)


def scattered():
    """Documents with the parts of items further apart than a passage is long."""
    texts = []
    for i in range(4, 24, 3):
        words = ITEMS[i][1].split()
        for pieces in (2, 3):
            cuts = [len(words) * k // pieces for k in range(pieces + 1)]
            found = [" ".join(words[a:b]) for a, b in zip(cuts, cuts[1:])]
            texts.append((1000 * pieces + i, f" {prose(90 + i, 150)} ".join(found)))
    return texts


@pytest.mark.parametrize("pieces", [decontaminate.INDEX_PIECES, 6])
def test_leaks_in_parts_far_apart_equal_brute_force(spark, monkeypatch, pieces):
    monkeypatch.setattr(decontaminate, "INDEX_PIECES", pieces)
    texts = scattered() + leaking()
    found = decontaminate.find_leaks(docs(spark, texts), bench(spark)).collect()
    pairs = [(r["doc_id"], r["item_id"]) for r in found]
    assert sorted(pairs) == sorted(expected(texts, ITEMS))
    assert {(2000 + i, i) for i in range(7, 24, 3)} <= set(pairs)
    assert all(r["score"] >= decontaminate.THRESHOLD for r in found)


def test_clean_documents_keep_all_columns(spark):
    table = docs(spark, leaking() + ODD)
    kept = decontaminate.without_leaks(table, bench(spark))
    assert kept.columns == table.columns and kept.schema == table.schema
    assert kept.where("doc_id < 20 and doc_id % 2 = 1").count() == table.where(
        "doc_id < 20 and doc_id % 2 = 1 and doc_id <> -5"
    ).count()
    assert kept.where("doc_id in (0, 10, 500)").count() == 0


def test_empty_sides(spark):
    assert decontaminate.find_leaks(docs(spark, ODD), bench(spark).where("false")).count() == 0
    assert decontaminate.find_leaks(docs(spark, []).where("false"), bench(spark)).count() == 0


def test_question_and_answer_parts():
    parts = decontaminate.question_and_answer
    assert parts("Is it so? Yes it is.") == (["is", "it", "so"], ["yes", "it", "is"])
    assert parts("One two. Three four.") == (["one", "two"], ["three", "four"])
    assert parts("a b c d") == (["a", "b"], ["c", "d"])
    assert parts("?") == ([], [])


@settings(deadline=None, max_examples=200)
@given(
    st.lists(st.dictionaries(st.integers(0, 30), st.floats(0.01, 1), max_size=10), max_size=8),
    st.floats(0.05, 3),
)
def test_wand_finds_all_that_reach_the_threshold(postings, threshold):
    import numpy as np

    lists = [
        (np.array(sorted(p)), np.array([p[k] for k in sorted(p)]), max(p.values())) for p in postings if p
    ]
    scores = {}
    for p in postings:
        for piece, weight in p.items():
            scores[piece] = scores.get(piece, 0.0) + weight
    # Sums in another order may differ in the last place.
    sure = {p for p, s in scores.items() if s >= threshold + 1e-9}
    found = dict(decontaminate.wand(lists, threshold))
    assert sure <= set(found) <= {p for p, s in scores.items() if s >= threshold - 1e-9}
    assert all(abs(found[p] - scores[p]) < 1e-9 for p in found)


MESSAGES = [
    (1, 0, "user", "What is the plan for today? I would like to know it."),
    (1, 1, "assistant", "> What is the plan for today?\nWe walk to the lake. Then we eat."),
    (1, 2, "user", ">> What is the plan for today?\n> We walk to the lake. Then we eat.\nGood."),
    (1, 3, "user", "Ann wrote:\n> we  WALK to\n> the lake.\n\nNo, by bus."),
    (2, 0, "user", "> No, by bus.\nThe bus is late."),
    (3, 0, "user", "> The bus is late.\nThen we wait."),
    (3, 1, None, "An own remark."),
    (4, 0, "system", "> nobody said this\nHm."),
    (4, 1, "user", "> only a quotation"),
    (5, 0, "user", None),
    (5, 1, "user", ""),
    (None, 1, "user", "> Good.\nno conversation"),
    (6, None, "user", "> Good.\nno turn"),
    (7, 0, "user", "a > b\n  > Good.\nIndented."),
    (8, 0, "user", "Twice."),
    (8, 0, "user", "Twice."),
]
SCHEMA = "conv_id long, turn long, role string, text string, thread string, hash int, level string"


def messages(spark, rows=MESSAGES):
    return spark.createDataFrame([(*row, "x", 1, "y") for row in rows], SCHEMA)


def test_replies_are_linked_and_ordered(spark):
    rows = quotes.conversations_in_reply_order(messages(spark)).collect()
    assert len(rows) == len(MESSAGES)
    by_key = {(r["conv_id"], r["turn"]): r for r in rows}
    parents = {k: (r["parent_conv_id"], r["parent_turn"]) for k, r in by_key.items()}
    assert {k: v for k, v in parents.items() if v != (None, None)} == {
        (1, 1): (1, 0),
        (1, 2): (1, 1),
        (1, 3): (1, 1),
        (2, 0): (1, 3),
        (3, 0): (2, 0),
        (7, 0): (1, 2),
    }
    threads = {k: r["thread"] for k, r in by_key.items()}
    assert (threads[2, 0], threads[3, 0], threads[3, 1], threads[7, 0]) == (1, 1, 3, 1)
    assert by_key[1, 3]["text"] == "No, by bus."
    assert by_key[1, 2]["quote_levels"] == 2
    assert by_key[4, 1]["text"] == "" and by_key[5, 0]["text"] == ""
    assert by_key[7, 0]["text"] == "a > b\nIndented."
    assert by_key[3, 1]["formatted"] == "<|unknown|>\nAn own remark.\n<|end|>\n"
    place = {(r["conv_id"], r["turn"]): i for i, r in enumerate(rows)}
    for child, parent in parents.items():
        if parent != (None, None):
            assert place[parent] < place[child] and threads[parent] == threads[child]


MOVED = [
    (1, 0, "user", "The first remark."),
    (2, 0, "user", "> The first remark.\nAn answer to it."),
    (2, 1, "user", "> An answer to it.\nAnother answer."),
    (2, 2, "user", "> Another answer.\nThe third answer."),
    (2, 3, "user", "By the way."),
    (3, 0, "user", "> The third answer.\nFrom elsewhere."),
    (3, 1, "user", "> From elsewhere.\nThe last."),
]


def test_answers_to_a_moved_message_move_with_it(spark):
    found = quotes.conversations_in_reply_order(messages(spark, MOVED)).collect()
    assert [(r["thread"], r["conv_id"], r["turn"]) for r in found] == [
        (1, 1, 0), (1, 2, 0), (1, 2, 1), (1, 2, 2), (1, 3, 0), (1, 3, 1), (2, 2, 3)
    ]
    assert [(r["parent_conv_id"], r["parent_turn"]) for r in found if r["parent_turn"] is not None] == [
        (1, 0), (2, 0), (2, 1), (2, 2), (3, 0)
    ]


PARTS = ["Thanks for the update.", "The server is down.", "Yes.", "It works again.", "See you then."]


def common_sentences():
    """Messages that say and quote the same few sentences."""
    rng = random.Random(5)
    rows = [
        (1, 0, "user", "Thanks for the update."),
        (2, 0, "user", "Thanks for the update. The server is down."),
        (3, 0, "user", "> Thanks for the update. The server is down."),
    ]
    for conv, turn in itertools.product(range(4, 34), range(3)):
        own = " ".join(rng.sample(PARTS, rng.randint(0, 3)))
        quoted = " ".join(rng.sample(PARTS, rng.randint(1, 3)))
        rows.append((conv, turn, "user", f"> {quoted}\n{own}" if rng.random() < 0.4 else own))
    return rows


def test_the_message_that_holds_most_of_a_quotation_wins(spark, monkeypatch):
    rows = common_sentences()

    def split(text):
        return {p for p in PARTS if p in text}

    said = {(c, t): split("\n".join(x for x in text.split("\n") if x[:1] != ">")) for c, t, _, text in rows}
    wanted = {}
    for conv, turn, _, text in rows:
        if text[:1] == ">":
            quoted = split(text.split("\n")[0])
            ranked = [
                (c != conv, -sum(map(len, quoted & held)), c, t)
                for (c, t), held in said.items()
                if quoted & held and (c < conv or (c == conv and t < turn))
            ]
            if ranked:
                wanted[conv, turn] = min(ranked)[2:]
    assert wanted[3, 0] == (2, 0)
    for few in (1, quotes.FEW, 1000):
        monkeypatch.setattr(quotes, "FEW", few)
        links = quotes.quotation_links(quotes.parsed_messages(messages(spark, rows))).collect()
        assert {(r[0], r[1]): (r[2], r[3]) for r in links} == wanted


def test_the_plan_has_no_python(spark):
    found = quotes.conversations_in_reply_order(messages(spark))
    text = found._jdf.queryExecution().executedPlan().toString()
    assert not any(node in text for node in ("Python", "Pandas", "Arrow", "Cartesian"))


def test_no_messages(spark):
    assert quotes.conversations_in_reply_order(messages(spark).where("false")).count() == 0


def test_a_passage_that_many_quote_is_one_original(spark):
    rows = [(i, 0, "user", f"The same remark. And {prose(i, 5)}.") for i in range(50)]
    rows += [(i, 1, "user", "> The same remark.\nYes.") for i in range(50)]
    found = quotes.conversations_in_reply_order(messages(spark, rows)).where("turn = 1").collect()
    assert all((r["parent_conv_id"], r["parent_turn"]) == (r["conv_id"], 0) for r in found)
