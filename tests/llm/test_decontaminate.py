import random

import pytest

pytest.importorskip("factloom.llm")
from factloom.llm import decontaminate as dc

ITEM = "A train leaves the old station at 9 and travels 120 km toward Lyon while another leaves at 9 from Paris. How many hours later do they meet?"
LONG = "the quick brown fox jumps over a lazy dog and then sleeps under the tall green tree until morning comes again"


def test_copies_and_new_parameters_are_found_and_chance_is_not(spark):
    fresh = ITEM.replace("120", "75").replace("at 9", "at 11").replace("Lyon", "Turin").replace("Paris", "Milan")
    broken = ITEM.replace("at 9 from", "at 8 from")  # one value of the item stands for two
    rng = random.Random(2)
    words = LONG.split()
    shuffled = words[:]
    rng.shuffle(shuffled)
    docs = [
        (1, "intro words here. " + ITEM + " more"), (2, "x y z. " + fresh), (3, "x. " + broken),
        (4, "Some " + LONG.upper() + "!!!"), (5, " ".join(shuffled)), (6, None), (7, ""), (8, " ".join(words[:9])), (9, "filler " + " ".join(words[:12]) + " other end"),
    ]
    items = [(10, ITEM), (11, LONG), (12, None), (13, "too short")]
    got = {r.doc_id: r["items"] for r in dc.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {k for k, v in got.items() if "10" in v.split(",")} == {1, 2}
    assert got[9] == "11" and got[8] == "" and got[5] == "" and got[6] == "" and got[7] == ""
    assert len(got) == 9


def brute(docs, items):
    """Aligned runs word by word, for texts without numbers and names; items shorter than a window are found whole."""
    out = {}
    for i, text in docs:
        d, hits = text.split(), []
        for j, item in items:
            w = item.split()
            for offset in range(-len(w), len(d)):
                same = [0 <= k + offset < len(d) and d[k + offset] == w[k] for k in range(len(w))]
                covered = set()
                if dc.SHORT <= len(w) < dc.WINDOW and all(same):
                    covered.update(range(len(w)))
                for k in range(len(w) - dc.WINDOW + 1):
                    if all(same[k : k + dc.WINDOW]):
                        covered.update(range(k, k + dc.WINDOW))
                if len(covered) >= dc.COVER or (covered and len(covered) >= dc.SHARE * len(w)):
                    hits.append(j)
                    break
        out[i] = ",".join(map(str, sorted(set(hits))))
    return out


@pytest.mark.parametrize("most", [4_000_000, 0])
def test_matches_brute_force_on_plain_words(spark, monkeypatch, most):
    monkeypatch.setattr(dc, "BROADCAST_WINDOWS", most)
    rng = random.Random(6)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(80)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(5, 50)))) for k in range(12)]
    docs = []
    for i in range(60):
        w = [rng.choice(words) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(items)[1].split()
            a = rng.randint(0, len(p) // 2)
            w += p[a : a + rng.randint(5, 50)] + [rng.choice(words)]
        docs.append((i, " ".join(w)))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {r.doc_id: r["items"] for r in dc.report(df, bench).collect()} == brute(docs, items)
    bad = {i for i, v in brute(docs, items).items() if v}
    assert {r.doc_id for r in dc.clean(df, bench).collect()} == {i for i, _ in docs} - bad


def test_one_question_with_its_numbers_many_times_and_a_very_long_text(spark):
    """Every item of one template is found by a text of that template, and at the end of a long text too."""
    items = [(k, ITEM.replace("120", str(200 + k))) for k in range(40)]
    long = " ".join(f"w{k % 997}x" for k in range(60_000)) + ". " + ITEM
    docs = [(1, ITEM), (2, long), (3, long[:-200])]
    got = {r.doc_id: r.n_items for r in dc.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {1: 40, 2: 40, 3: 0}


def test_nulls_repeats_and_no_rows(spark):
    bench = spark.createDataFrame([(1, LONG), (1, LONG)], "item_id long, text string")
    df = spark.createDataFrame([(1, LONG, "a"), (1, LONG, "a"), (1, "clean", "a"), (None, LONG, "a")], "doc_id long, text string, items string")
    got = sorted(((r.doc_id, r.contaminated, r.n_items) for r in dc.report(df, bench).collect()), key=str)
    assert got == sorted([(1, True, 1), (1, True, 1), (1, False, 0), (None, True, 1)], key=str)
    assert [r.text for r in dc.clean(df, bench).collect()] == ["clean"]
    assert dc.report(df.limit(0), bench).count() == 0
    assert dc.report(df, bench.limit(0)).where("contaminated").count() == 0


def test_other_letter_case_and_one_changed_occurrence_are_found(spark):
    tail = " They meet at noon near the river and then both drivers walk back to the old town where a long dinner waits for them and their friends until late at night."
    changed = (ITEM + tail).replace("at 9 from", "at 8 from")
    dense = "Anna Bell met Carl Dorn and Eva Frost at 7 in Graz Hall with Ida Jung and Karl Lang on 12 May"
    docs = [(1, ITEM.upper()), (2, ITEM.title()), (3, ITEM.lower()), (4, "so. " + changed), (5, "so " + dense), (6, LONG.title()), (7, " ".join(reversed(ITEM.split())))]
    items = [(10, ITEM), (11, LONG), (12, ITEM + tail), (13, dense)]
    got = {r.doc_id: set(r["items"].split(",")) for r in dc.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert all("10" in got[k] for k in (1, 2, 3)) and "12" in got[4] and got[5] == {"13"} and got[6] == {"11"} and got[7] == {""}
