"""Line chunks and template leaks against plain versions."""

import random

from axonframe.llm import lines, templates


def passage(rnd, n_lines, lo, hi):
    return [" ".join(f"p{rnd.randrange(10**6)}" for _ in range(rnd.randint(lo, hi))) for _ in range(n_lines)]


def test_repeated_passages_go_and_the_rest_stays(spark):
    rnd = random.Random(1)
    shared = [passage(rnd, 1, 60, 90), passage(rnd, 6, 9, 14), passage(rnd, 40, 2, 6)]
    rows, planted = [], {}
    for i in range(120):
        own = passage(rnd, rnd.randint(1, 8), 3, 30)
        if i % 3 == 0:
            p = shared[i // 3 % 3]
            at = rnd.randint(0, len(own))
            planted[i] = (own, p)
            own = own[:at] + p + own[at:]
        rows.append((i, "\n".join(own), "x", 3))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n_lines int")
    out = {r.doc_id: r for r in lines.dedup_lines(df).collect()}
    first = {}
    for i, (own, p) in sorted(planted.items()):
        key = p[0]
        if key not in first:
            first[key] = i
            assert out[i].text == rows[i][1] and out[i].n_removed == 0
        else:
            assert out[i].text == "\n".join(own) and out[i].n_removed == len(p)
    for i, t, *_ in rows:
        if i not in planted:
            assert out[i].text == t and out[i].removed_words == 0
        assert out[i].n_lines == t.count("\n") + 1 and out[i].lang == "x"


def repeated_windows(rows, least=50):
    """Per row, the positions of lines in stretches of at least ``least`` words that an earlier row has as well."""
    out, seen = {}, {}
    for i, t in sorted(rows):
        lines = (t or "").split("\n")
        gone = set()
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                window = tuple(lines[a:b])
                if sum(len(x.split()) for x in window) >= least:
                    if window in seen:
                        gone |= set(range(a, b))
                    break
        for a in range(len(lines)):
            for b in range(a + 1, min(a + 12, len(lines)) + 1):
                seen.setdefault(tuple(lines[a:b]), i)
        out[i] = gone
    return out


def test_passages_beside_other_repeated_lines(spark):
    rnd = random.Random(11)
    menu = ["", "Home", "About us", "", "Share this page with a friend"]
    passages = [passage(rnd, 5, 14, 14) for _ in range(40)]
    rows = []
    for i in range(160):
        own = passage(rnd, rnd.randint(1, 4), 3, 30)
        p = passages[i % 40]
        beside = lambda: [rnd.choice(menu)] * rnd.randint(0, 2) + (rnd.choice(passages) if rnd.random() < 0.1 else [])  # noqa: B023, E731
        rows.append((i, "\n".join(own[:2] + beside() + p + beside() + own[2:])))
    out = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    need = repeated_windows(rows)
    assert sum(map(bool, need.values())) > 110
    for i, t in rows:
        rest = iter(t.split("\n"))
        assert all(line in rest for line in out[i].text.split("\n")) or not out[i].text, i  # what is left stands in order
        # a menu line at the edge may stay; all lines of the passages must go
        gone = {t.split("\n")[pos] for pos in need[i]} - set(menu)
        assert not gone & set(out[i].text.split("\n")), i
    everything = " ".join(r.text for r in out.values()).split()
    assert {w for _, t in rows for w in t.split()} == set(everything)


def test_line_edges(spark):
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(2, long), (1, long), (1, long), (None, long), (3, None), (4, ""), (5, "a\nb\na\nb"), (6, "a\nb"), (7, "\n\n" + long + "\n\n"), (8, f"{long}\n{long}")]
    out = lines.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    got = {}
    for r in out:
        got.setdefault(r.doc_id, []).append(r.text)
    # NULL comes first and keeps the text; rows equal in id and text are cut alike
    assert got[None] == [long] and got[1] == ["", ""] and got[2] == [""] and got[3] == [None] and got[4] == [""]
    assert got[5] == ["a\nb\na\nb"] and got[6] == ["a\nb"] and long not in got[7][0] and got[8] == [""]
    assert lines.dedup_lines(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def plain_leaks(docs, items, coverage=templates.COVERAGE):
    """Every alignment of every item with every document."""
    canon, out = templates.Canon(), {}
    for d, t in docs:
        c, bare, slot = canon.tokens(t or "")
        hits = set()
        for i, text in items:
            ic, ibare, islot = canon.tokens(text or "")
            w = min(templates.WINDOW, len(ic))
            if w < templates.SHORTEST:
                continue
            starts = [a for a in range(len(ic) - w + 1) if 2 * islot[a : a + w].sum() <= w]
            for shift in range(-len(ic), len(c)):
                k, pairs = 0, set()
                for a in starts:
                    b = a + shift
                    if 0 <= b <= len(c) - w and (ic[a : a + w] == c[b : b + w]).all():
                        k += 1
                        s = islot[a : a + w]
                        pairs |= set(zip(ibare[a : a + w][s].tolist(), bare[b : b + w][s].tolist()))
                if starts and k / len(starts) >= coverage and k and len(pairs) == len({p for p, _ in pairs}):
                    hits.add(i)
        out[d] = hits
    return out


ITEMS = [
    (1, "A train leaves Boston with 12 cars and 12 drivers. In Boston each car carries 40 kg of coal. How much coal do they carry?"),
    (2, "short one here"), (3, None), (4, "two words"), (5, " ".join(f"term{i}" for i in range(30))), (None, "no id at all, so it is not searched"),
]


def test_leaks(spark):
    other = "A train leaves Madrid with 7 cars and 7 drivers. In Madrid each car carries 55 lbs of coal. How much coal do they carry?"
    broken = "A train leaves Madrid with 7 cars and 9 drivers. In Lisbon each car carries 55 lbs of coal. How much coal do they carry?"
    rnd = random.Random(3)
    noise = lambda n: " ".join(f"n{rnd.randrange(500)}" for _ in range(n))
    part = " ".join(f"term{i}" for i in range(10, 30))
    docs = [
        (1, f"{noise(50)}. {ITEMS[0][1]} {noise(30)}"), (2, f"{noise(20)}. {other}"), (3, f"{noise(5)}. {broken}"), (4, noise(300)), (5, "we saw (short) one, here today"),
        (6, f"{noise(9)} {part} {noise(9)}"), (7, "term1 term2 term3 term4 term5 term6 term7 term8 term9"), (8, None), (9, ""), (10, ITEMS[4][1] + "\n" + ITEMS[0][1]), (10, ITEMS[4][1] + "\n" + ITEMS[0][1]), (None, other),
    ]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id bigint, text string, h string, item_id int")
    out = templates.contamination(df, spark.createDataFrame(ITEMS, "item_id bigint, text string")).collect()
    want = plain_leaks(docs, [x for x in ITEMS if x[0] is not None])
    assert len(out) == len(docs) and all(r.n_items == len(want[r.doc_id]) and r.kept == (not want[r.doc_id]) for r in out)
    got = {r.doc_id: r for r in out}
    assert not got[1].kept and got[1].exact and not got[2].kept and not got[2].exact and got[3].kept and got[4].kept and not got[5].kept
    assert not got[6].kept and got[6].item_id == 5 and got[7].kept and got[10].n_items == 2
    none = templates.contamination(df, spark.createDataFrame([], "item_id bigint, text string"))
    assert all(r.kept for r in none.collect()) and templates.contamination(df.limit(0), spark.createDataFrame(ITEMS, "item_id bigint, text string")).count() == 0


def kept_by(spark, items, docs):
    a = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    return {r.doc_id: r for r in templates.contamination(a, b).collect()}


def test_leaks_of_slots_and_line_starts(spark):
    numbers = "Sort these: 17 42 8 93 5 61 28 77 34 12"
    names = "In May Alice Smith paid Bob Jones 40 dollars and Carol Brown paid Dan White 60 dollars in Paris"
    short, bare = "What is the capital city of France today?", "4 8 15 16 23 42 99 7 1"
    docs = [
        f"some words {numbers} and more", f"he asks {names} again", f"he asks {short} and waits", f"A heading\n{short}\nmore", f"the row {bare} ends", f"HE ASKS {short.upper()} AGAIN",
        "they said sort these: 1 2 3 4 5 6 7 8 9 10 now", "he asks What is the capital city of Spain today? and waits", "A heading\nWhat is the capital city of Spain today?",
        "sort these: 1 2 3 by hand", "the row 1 2 3 4 5 6 7 8 9 ends", "In June we paid Bob 40 dollars", "What is the largest city of Spain today?",
    ]
    got = kept_by(spark, [numbers, names, short, bare], docs)
    assert [got[i].item_id for i in range(9)] == [0, 1, 2, 2, 3, 2, 0, 2, 2]
    assert [got[i].exact for i in range(9)] == [True] * 6 + [False] * 3 and all(got[i].kept for i in range(9, 13))


def test_items_of_one_and_two_words_are_found_literally(spark):
    got = kept_by(spark, ["Quaternion", "two Words", "three short words"], ["a quaternion, here", "two words", "two other words", "these three short words", "", "Words two"])
    assert [got[i].item_id for i in range(6)] == [0, 1, None, 2, None, None] and got[0].exact


def test_texts_read_together_are_read_alone(spark, monkeypatch):
    rnd = random.Random(6)
    bits = ["Alice", "Bob.", "kg", "12", "word", "other\n", "7", "Carol\n", "m", "end.", "NASA", "x"]
    texts = [" ".join(rnd.choice(bits) for _ in range(rnd.randint(0, 30))) for _ in range(80)]
    canon = templates.Canon()
    together = {}
    words = canon.words(*texts)
    for lines_end in (True, False):
        t = templates.template(words, lines_end)
        for width in (3, 8):
            at, h, begin = t.windows(width, both=True)
            starts = [templates.template(canon.words(x), lines_end) for x in texts]
            offsets, place = [], 0
            for x in starts:
                offsets.append(place)
                place += len(x.canon)
            alone = []
            for offset, x in zip(offsets, starts):
                a, g, b = x.windows(width, both=True)
                alone += list(zip((a + offset).tolist(), g.tolist(), (b + offset).tolist()))
            assert sorted(zip(at.tolist(), h.tolist(), begin.tolist())) == sorted(alone)
            together[lines_end, width] = len(alone)
    assert all(together.values())


def test_leaks_with_values_of_other_lengths(spark):
    item = ITEMS[0][1]
    other = lambda city, load: item.replace("Boston", city).replace("40 kg", load)
    inserted = item.replace("each car", "each old black car")  # 6 windows of words before and 5 after, of 18
    docs = [
        other("New York", "40 kg"), other("New York", "40kg"), other("Rio de Janeiro", "40 kg").replace("de", "De"), other("Boston", "9 kg"), other("Los Angeles", "7lb"),
        inserted, item.replace("Boston", "New York", 1).replace("In Boston", "In Los Angeles"), other("New York", "40 kg").replace("12 drivers", "13 drivers"),
        " ".join(reversed(item.split())), item.upper(), other("New York", "40 kg").replace("12 cars and 12 drivers", "12 cars and 13 drivers") + " " + other("San Marino", "3 kg"),
        "said Bob\n" + other("New\nYork", "3 kg"),
    ]
    got = kept_by(spark, [item], docs)
    assert sorted(i for i in got if got[i].kept) == [6, 7, 8]
    assert all(got[i].coverage == 1.0 for i in (0, 1, 2, 3, 4, 9, 10, 11)) and not got[0].exact and got[9].exact
    assert got[5].coverage == 11 / 18


def test_a_hot_item_and_document():
    place = [{"at": a, "slots": []} for a in range(43)]
    met = [{"hits": [{"d_at": d, "d_slots": []} for d in range(2000)], "places": place}]
    assert templates.covered(met, 43, 0.5) == 1.0
