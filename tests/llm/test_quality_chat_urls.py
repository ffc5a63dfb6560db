"""Rule ledger, chat round trip and link trust on small tables."""

import hashlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from axonframe.llm import chat, quality, urls


def repeat_words(words):
    grams = Counter(zip(words, words[1:], words[2:]))
    return len({i + j for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for j in range(3)})


def test_measurements_against_plain_counts(spark):
    texts = [None, "", " \n\t", "one", "a b c a b c", "a a a a", "x y z\nx y z\n\n\nx y z ", "# $5 <b> & |", "É ñ ß\x0bend", "w " * 5000 + "tail of the text", "a b c d " * 700]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("n_words", F.lit("clash"))
    got = {r.doc_id: r for r in quality.ledger(df).collect()}
    for i, t in enumerate(texts):
        words = (t or "").encode().split()
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        r = got[i]
        assert r.n_words == len(words) and r.word_chars == sum(len(w.decode()) for w in words)
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t or "")
        assert r.n_lines == len(lines) and r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_repeat_words == repeat_words(words)
    assert quality.ledger(df.limit(0)).count() == 0


def test_positions_beyond_24_bits_have_room(spark, monkeypatch):
    monkeypatch.setattr(quality, "FEW_WINDOWS", 5)  # longer texts give positions 32 bits
    texts = ["a b c a b c", "x y z " * 9, " ".join(f"w{i % 37}" for i in range(400)), "one two three four five six seven eight"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id: r.n_repeat_words for r in quality.ledger(df).collect()} == {i: repeat_words(t.split()) for i, t in enumerate(texts)}


def test_relative_links_addresses_and_long_chains(spark):
    chain = [(i, f"http://h{i}.net/", f'<a href="//h{i + 1}.net/x">') for i in range(20)]
    pages = [(100, "http://good.org/", '<a href="//h0.net/">'), (101, "http://h20.net/", '<a href=//bad.com/de/>'), (102, "http://bad.com/de/1", ""), (103, "http://10.1.2.3/", '<a href="http://bad.com/de/">'), (104, "http://99.1.2.3/", "")]
    df = spark.createDataFrame(chain + pages, "page_id bigint, url string, html string")
    out = {r.host: r for r in urls.judge(df, urls.rule_table(spark)).collect()}
    assert out["h20.net"].distrust > 0 and out["h20.net"].verdict == "block" and out["h13.net"].trust > 0
    assert out["10.1.2.3"].verdict == "block" and out["99.1.2.3"].distrust == 0 and out["99.1.2.3"].verdict == "allow"
    assert urls.DAMPING**urls.ROUNDS <= urls.LEFT


def test_policies_and_ablations(spark):
    good, junk = "the cat sat on a mat and " + " ".join(f"w{i}" for i in range(60)), "w### " * 3 + " ".join(f"W{i}$" for i in range(60))
    df = spark.createDataFrame([(1, good), (2, junk), (3, "short"), (4, None)], "doc_id bigint, text string")
    book = quality.ledger(df)
    kept = lambda policy: {r.doc_id for r in book.filter(quality.passes(policy)).collect()}
    assert kept("v1") == {1, 2} and kept("v2") == {1}
    table = {r.rule: r for r in quality.ablations(book).collect()}
    assert table["too_short"].n_fails == 2 and table["symbols"].n_fails == 1 and table["symbols"].n_docs == 4
    # what a rule rejects alone is what its removal would let in
    for name in quality.POLICIES["v2"]:
        bit = 1 << [r.name for r in quality.RULES].index(name)
        mask = quality.mask_of("v2")
        want = book.filter(((F.col("fail_bits").bitwiseAND(F.lit(mask))) != 0) & (F.col("fail_bits").bitwiseAND(F.lit(mask ^ bit)) == 0)).count()
        assert table[name].n_alone == want


PIECES = st.lists(st.sampled_from([*chat.CONTROLS, "\\", "<", "[", "s>", "/s>", "INST]", "<\\s>", "<\\\\SYS>>", "x", "\n", "é", "$1", ""]), max_size=12).map("".join)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES), min_size=1, max_size=30))
def test_any_text_survives(spark, turns):
    rows = [(1, i, role, text) for i, (role, text) in enumerate(turns)]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    read = out.select(chat.parse(F.col("formatted")).alias("t")).first().t
    assert [(t.role, t.text) for t in read] == turns


def test_conversations(spark):
    rows = [(1, 1, "assistant", "</s>[INST] ok [/INST]", 0), (1, 0, "user", "hi", 0), (2, None, None, None, 0), (2, 0, "assistant", "a\\<s>", 0), (2, 0, "assistant", "a\\<s>", 0), (None, 3, "system", "x" * 5000, 0)]
    out = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted int")).collect()}
    assert out[1].formatted == "<s>[INST]user[/INST]hi</s><s>[INST]assistant[/INST]<\\/s>[\\INST] ok [\\/INST]</s>"
    assert out[1].n_turns == 2 and out[2].n_turns == 3 and out[None].n_turns == 1
    for r in out.values():
        texts = [r.formatted[s.start : s.start + s.length] for s in r.loss_spans]
        again = spark.createDataFrame([(r.formatted,)], "f string").select(chat.loss_texts(F.col("f"))).first()[0]
        guarded = spark.createDataFrame([(t,) for t in texts] or [("",)], "t string").select(chat.unescape(F.col("t"))).collect()
        assert again == ([g[0] for g in guarded] if texts else [])
    assert chat.format_conversations(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.lit(""), 256)).first()[0]


def walk(edges, seeds, start, back):
    """Plain power iteration in floats."""
    out = Counter()
    for (a, b), w in edges.items():
        out[b if back else a] += w
    total = sum(seeds.values())
    base = {n: s / total for n, s in seeds.items()}
    rank = dict(base)
    for _ in range(urls.ROUNDS):
        new = Counter({n: s * (1 - urls.DAMPING) for n, s in base.items()})
        for (a, b), w in edges.items():
            x, y = (b, a) if back else (a, b)
            new[y] += urls.DAMPING * rank.get(x, 0) * w / out[x]
        rank = new
    return rank


def test_trust_follows_links_and_distrust_goes_back(spark):
    link = lambda *hosts: "".join(f'<a href="https://{h}/x">x</a>' for h in hosts)
    pages = [
        (1, "http://good.org/a", link("mid.net", "GOOD.org"), 0), (2, "http://mid.net/b?q", link("far.io"), 0), (3, "http://far.io", None, 0),
        (4, "http://farm.biz/p", link("bad.com"), 0), (5, "https://bad.com/de/1#x", "", 0), (6, None, None, 0), (7, "no scheme", "<a href='/rel'>", 0), (7, "no scheme", "<a href='/rel'>", 0),
    ]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string, host int")
    out = urls.judge(df, urls.rule_table(spark)).collect()
    got = {r.page_id: r for r in out}
    assert len(out) == 8 and {i: got[i].verdict for i in got} == {1: "allow", 2: "allow", 3: "allow", 4: "block", 5: "block", 6: "allow", 7: "allow"}
    assert (got[1].host, got[1].path, got[1].rule) == ("good.org", "/a", "org/") and (got[3].host, got[3].path) == ("far.io", "") and got[6].host == ""
    edges = {("good.org", "mid.net"): 1, ("mid.net", "far.io"): 1, ("farm.biz", "bad.com"): 1}
    trust, distrust = walk(edges, {"good.org": 1}, None, False), walk(edges, {"bad.com": 1}, None, True)
    for r in out:
        assert abs(r.trust / urls.MASS - trust.get(r.host, 0)) < 1e-9 and abs(r.distrust / urls.MASS - distrust.get(r.host, 0)) < 1e-9


def test_longest_rule_wins(spark):
    cases = {
        "http://example.org/es/9": ("example.org/es/", "block"), "http://a.EXAMPLE.org/en/12": ("example.org/en/1", "block"), "http://example.org/en/2": ("org/", "allow"),
        "http://x.com/fr/": ("com/fr/", "allow"), "http://x.com/fr": (None, "allow"), "http://com/de/": ("com/de/", "block"), "http://notcom/de/": (None, "allow"), "http://org": (None, "allow"),
    }
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(cases)], "page_id bigint, url string, html string")
    got = {r.url: (r.rule, r.verdict) for r in urls.judge(df, urls.rule_table(spark)).collect()}
    assert {u: r for u, (r, _) in got.items()} == {u: r for u, (r, _) in cases.items()}
    assert all(got[u][1] == v for u, (r, v) in cases.items() if r)
    assert urls.judge(df.limit(0), urls.rule_table(spark)).count() == 0
