import random
import re
from collections import Counter

from meshwork.llm.decontamination import find_leaks, without_leaks


def norm(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


def bag(ws, k):
    return Counter(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))


def brute(docs, items, j=0.8):
    out = {}
    for d, t in docs:
        ws = norm(t)
        for i, u in items:
            its = norm(u)
            k = min(5, len(its))
            if not k:
                continue
            b = bag(its, k)
            for s in range(max(1, len(ws))):
                a = bag(ws[s : s + len(its)], k)
                both = sum((a & b).values())
                if both and both / sum((a | b).values()) >= j - 1e-12:
                    out[d, i] = max(out.get((d, i), 0), both / sum((a | b).values()))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(300)] + ["Ünder"]
    text = lambda n: " ".join(rng.choices(vocab, k=n))
    items = [(i, text(rng.choice([1, 3, 4, 5, 6, 15, 15, 30, 59]))) for i in range(40)]
    items += [(100, items[5][1].upper()), (101, None), (102, "..."), (103, "no no no no no no no no no no")]
    docs = []
    for d in range(150):
        ws = text(rng.randint(0, 80)).split()
        if d % 3 == 0:
            its = rng.choice(items[:41])[1].split() if d % 6 else items[43][1].split()
            if len(its) > 20 and d % 2:
                its[rng.choice([0, -1])] = "other"
            at = rng.randint(0, len(ws))
            ws[at:at] = its
        docs.append((d, ", ".join(ws) if d % 4 == 0 else " ".join(ws)))
    docs += [(900, None), (901, ""), (902, items[20][1])]
    df = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, words int")
    bf = spark.createDataFrame([(*r, "h") for r in items], "item_id long, text string, h string")
    rows = find_leaks(df, bf).collect()
    got = {(r.doc_id, r.item_id): r.similarity for r in rows}
    want = brute(docs, items)
    assert got.keys() == want.keys() and len(got) == len(rows)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert any(v < 1 for v in want.values())
    assert find_leaks(df.limit(0), bf).count() == 0 and find_leaks(df, bf.limit(0)).count() == 0
    assert {(r.doc_id, r.item_id) for r in find_leaks(df.unionByName(df), bf).collect()} == want.keys()


def test_items_of_one_id_are_found_by_each_text(spark):
    texts = [" ".join(f"{w}{i}" for i in range(n)) for w, n in (("a", 20), ("b", 20), ("c", 40), ("d", 40))]
    items = spark.createDataFrame(list(zip((None, None, 5, 5), texts)), "item_id long, text string")
    rows = [(i, f"before {t} after") for i, t in enumerate(texts)] + [(9, " x ".join(texts)), (10, "nothing here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.first_word, r.n_words, r.similarity) for r in find_leaks(docs, items).collect()), key=str)
    assert got == sorted([(0, None, 1, 20, 1.0), (1, None, 1, 20, 1.0), (2, 5, 1, 40, 1.0), (3, 5, 1, 40, 1.0), (9, None, 0, 20, 1.0), (9, 5, 42, 40, 1.0)], key=str)
    assert [r.doc_id for r in without_leaks(docs, items).collect()] == [10]


def test_changed_passages_equal_brute_force(spark):
    rng = random.Random(8)
    items = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(n))) for i, n in enumerate((50, 50, 50, 25, 25, 30, 60, 12))]
    items.append((50, " ".join(items[0][1].split()[:47] + ["x", "y", "z"])))  # another item's windows reach it too
    docs = []
    for d in range(120):
        its = rng.choice(items)[1].split()
        kind, at = d % 6, rng.randrange(len(its))
        if kind == 0:  # rotated, halves swapped among them
            its = its[at:] + its[:at] if d % 12 else its[len(its) // 2 :] + its[: len(its) // 2]
        elif kind == 1:
            its[at:at] = ["new"] * rng.randint(1, 3)
        elif kind == 2:
            del its[at : at + rng.randint(1, 4)]
        elif kind == 3:
            its[at] = "other"
        elif kind == 4:  # pieces reordered
            third = len(its) // 3
            its = its[2 * third :] + its[:third] + its[third : 2 * third]
        else:  # the text ends within the passage
            its = its[: len(its) - rng.randint(0, len(its) // 4)]
        before = [f"v{rng.randrange(400)}" for _ in range(rng.randint(0, 60))]
        after = [] if kind == 5 else [f"v{rng.randrange(400)}" for _ in range(rng.randint(0, 60))]
        docs.append((d, " ".join(before + its + after)))
    docs.append((500, " ".join(f"u{i}" for i in range(30_000)) + " " + items[6][1] + " tail" * 100))
    docs += [(501, items[3][1]), (502, items[3][1]), (None, items[3][1])]
    rows = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got, want = {(r.doc_id, r.item_id): r.similarity for r in rows}, brute(docs, items)
    assert got.keys() == want.keys() and len(got) == len(rows) and len(want) > 50
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    swapped = items[0][1].split()
    one = spark.createDataFrame([(1, " ".join(swapped[25:] + swapped[:25])), (2, " ".join(swapped[30:] + swapped[:30]))], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in find_leaks(one, spark.createDataFrame(items[:1], "item_id long, text string")).collect()} == {(1, 0), (2, 0)}
