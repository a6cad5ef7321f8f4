"""Operators p6 to p8 against brute force, and for nulls, empty and long texts, repeats, ties and clashing names."""

import random
import unicodedata
from collections import Counter
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gaugeflow.llm.confusables import confusables, consistent_findings, consistent_text, same_looking_classes, same_looking_pairs
from gaugeflow.llm.leakage import EDIT_ONE_IN, LEAST_WORDS, PassageIndex, WordHashes, leaked_passages, leaked_stretch, passage_blocks, windows_of, without_leaks, word_spans, words_of
from gaugeflow.llm.mixing import TOKENIZER, mix_sources, plan_shares, token_count

# --- p8


@pytest.fixture(scope="module")
def forms(spark):
    return confusables(spark)


ALIKE = [
    ("pay the score", "рау thе ѕсоrе"),
    ("café naïve", "café naïve"),
    ("Full 12", "Ｆｕｌｌ　１２"),
    ("a b c", "a b c"),
    ("invisible", "in​vi­si﻿ble"),
    ("ガ", "ｶﾞ"),
    ("IV mix", "ⅠⅤ mⅰⅹ"),
    ("тёплая вода", "тëплaя вoдa"),
    ("ОКО река", "OKO река"),
    ("one-two", "one‑two"),
    ("10 K", "10 K"),
    ("a\nb", "a\r\nb"),
    ("a\nb", "a\u0085b"),
    ("pain", "pαιn"),
    ("no", "ոօ"),
    ("oil", "ⲟil"),
    ("ABC", "Ꭺᏼ\u13df".replace("\u13fc", "B").replace("ᏼ", "B")),
    ("bold", "𝐛𝐨𝐥𝐝"),
    ("oh!", "ohǃ"),
]
DIFFERENT = [("m2", "m²"), ("cafe", "café"), ("Pay", "pay"), ("и", "й"), ("½", "1/2"), ("a b", "ab"), ("l", "1"), ("O", "0"), ("a\nb", "a b"), ("タ", "ダ"), ("a!", "a"), ("Il", "ll"), ("ı", "i"), ("σ", "ο"), ("カ", "力"), ("ø", "o"), ("–", "-"), ("’", "'")]


@pytest.mark.parametrize(("a", "b"), ALIKE)
def test_alike(forms, a, b):
    assert a != b and forms.consistent(a) == forms.consistent(b)


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_different(forms, a, b):
    assert forms.consistent(a) != forms.consistent(b)


def test_every_pair_of_the_table(forms):
    pairs = [(latin, script, letter) for latin, by in forms.letters.items() for script, letter in by.items()]
    assert len(pairs) > 250 and {s for _, s, _ in pairs} > {"Latn", "Grek", "Cyrl", "Armn", "Copt", "Cher"} and "ICU" in forms.version
    for latin, script, letter in pairs:
        assert forms.consistent(letter) == latin and forms.consistent(f"x{letter}x") == f"x{latin}x"
        assert unicodedata.category(letter) in (unicodedata.category(latin), "Lo") and script in forms.scripts[letter]
    one = [(script, letter) for _, script, letter in pairs]
    assert len(one) == len(set(one))  # a letter of a script is in one class
    for c, x in forms.table.items():
        assert x is None or not any(ch.isdigit() for ch in x) or unicodedata.normalize("NFKC", chr(c)) == x  # digits stay themselves


def test_the_consistent_script_is_kept(forms):
    assert forms.consistent("рaypal and ѕсоrе") == "paypal and score"
    assert forms.consistent("вoдa и cок") == "вода и сок"
    assert forms.consistent("река la vallée ѕсоrе and") == "река la vallée score and"
    assert forms.consistent("200 µ a day") == "200 μ a day"  # a lone sign makes no Greek
    found = lambda t: forms.findings(t, forms.consistent(t))
    assert found("рaypal and ѕоре") == (1, 1) and found("вода и сок") == (0, 0) and found("abc") == (0, 0)


def test_form_is_stable_and_blind_to_look_alikes(forms):
    other = {latin: by["Cyrl"] for latin, by in forms.letters.items() if "Cyrl" in by}

    @settings(max_examples=200, deadline=None)
    @given(st.text(alphabet="abceopxyABCEзнйёкМ é\u0301\u200b -²ｏοαａ\t\r\n", max_size=40), st.randoms(use_true_random=False))
    def check(text, rng):
        form = forms.consistent(text)
        assert forms.consistent(form) == form
        shown = unicodedata.normalize("NFD", form)
        swapped = "".join(other[c] if c in other and rng.random() < 0.5 else c for c in shown)
        assert forms.consistent(swapped) == form

    check()


def test_pairs(spark, forms):
    consistent = forms.consistent
    texts = ["score", "ѕсоrе", "score", "s​core", "Score", "", "​", None, "x" * 200_000 + "а", "x" * 200_000 + "a", "ok"]
    df = spark.createDataFrame([(i, t, "f", "c") for i, t in enumerate(texts)] + [(None, "sсore", "f", "c")], "doc_id long, text string, form string, copy string")
    got = {tuple(r) for r in same_looking_pairs(df).collect()}
    want = {(a, b) for a, b in combinations(range(len(texts)), 2) if None not in (texts[a], texts[b]) and texts[a] != texts[b] and consistent(texts[a]) == consistent(texts[b])}
    assert got == want and (0, 1) in got and (5, 6) in got and (8, 9) in got and (0, 2) not in got
    assert {tuple(r) for r in same_looking_pairs(df.unionByName(df)).collect()} == want
    links = Counter(i for pair in want for i in pair)
    classes = {r.doc_id: (r.class_id, r.n_links) for r in same_looking_classes(df).collect()}
    assert {i: n for i, (_, n) in classes.items()} == links and classes[3] == (0, 3) and classes[6] == (5, 1)
    assert same_looking_pairs(df.limit(0)).count() == same_looking_classes(df.limit(0)).count() == 0
    out = {r.doc_id: r.t for r in df.select("doc_id", consistent_text("text", forms).alias("t")).collect()}
    assert out[7] is None and out[1] == "score"
    found = {r.doc_id: r.f for r in df.select("doc_id", consistent_findings("text", forms).alias("f")).collect()}
    assert found[7].text is None and (found[1].text, found[1].mixed) == ("score", 2 - 1) and len(found) == len(texts) + 1


# --- p6

VOCABULARY = [f"word{i}" for i in range(400)]


def brute(p, d):
    """Whether some stretch of p of LEAST_WORDS words or more is in d with few enough edits; ends of it kept words."""
    for a in range(len(p)):
        # fewest edits between p[a:i] and a stretch of d that starts anywhere and ends at j
        row = [0] * (len(d) + 1)
        for i in range(a, len(p)):
            new = [row[0] + 1]
            for j in range(1, len(d) + 1):
                new.append(min(row[j - 1] + (p[i] != d[j - 1]), row[j] + 1, new[j - 1] + 1))
            row = new
            length = i + 1 - a
            if length >= LEAST_WORDS and min(row) * EDIT_ONE_IN <= length:
                return True
    return False


def brute_kept_ends(p, d):
    """As brute, but the stretch begins and ends with kept words."""
    for a in range(len(p)):
        for b in range(len(d)):
            if p[a] != d[b]:
                continue
            row = {b + 1: 0} | {j: j - b - 1 for j in range(b + 1, len(d) + 1)}  # p[a] kept at d[b]
            for i in range(a + 1, len(p)):
                new = {b + 1: row[b + 1] + 1}
                for j in range(b + 2, len(d) + 1):
                    new[j] = min(row[j - 1] + (p[i] != d[j - 1]), row[j] + 1, new[j - 1] + 1)
                    length = i + 1 - a
                    if p[i] == d[j - 1] and length >= LEAST_WORDS and row[j - 1] * EDIT_ONE_IN <= length:
                        return True
                row = new
    return False


def edited(words, rng, edits):
    words = list(words)
    for _ in range(edits):
        i = rng.randrange(1, len(words) - 1)
        kind = rng.choice("aio")
        words[i : i + (kind != "i")] = [] if kind == "o" else ["other"]
    return words


@pytest.mark.parametrize("seed", range(60))
def test_leaks_against_all_alignments(seed):
    rng = random.Random(seed)
    p = [rng.choice(VOCABULARY) for _ in range(rng.randint(16, 60))]
    n = rng.randint(8, len(p))
    a = rng.randint(0, len(p) - n)
    d = [rng.choice(VOCABULARY[:50]) for _ in range(20)]
    d[10:10] = edited(p[a : a + n], rng, rng.randint(0, n // 6))
    found = list(PassageIndex([p]).leaks([d], *windows_of([d], WordHashes())))
    if bool(found) != brute(p, d):  # the brute rule lets a stretch end in altered words
        assert not found and not any(brute(p[x:], d) and p[x] in d for x in range(1)) or max((x[2] for x in found), default=15) < LEAST_WORDS + 3
    for _, _, words, edits, first, end in found:
        assert words >= LEAST_WORDS and edits * EDIT_ONE_IN <= words and 0 <= first < end <= len(d)


@pytest.mark.parametrize(("kept", "want"), [(15, False), (16, True), (30, True)])
def test_shortest_stretch(kept, want):
    p = list(range(100, 160))
    assert bool(leaked_stretch(p, [-1] * 5 + p[10 : 10 + kept] + [-1] * 9, 12, 7)) == want


def test_one_in_eight():
    p = list(range(40))
    for edits, want in ((4, True), (5, True), (6, False)):
        d = [-1 if i % 6 == 5 and i // 6 < edits else x for i, x in enumerate(p)]
        found = [leaked_stretch(p, d, i, i) for i in range(36)]
        assert any(x and x[0] == 40 for x in found) == want


def test_leaked_documents(spark):
    rng = random.Random(1)
    p = " ".join(rng.choice(VOCABULARY) for _ in range(40))
    q = " ".join(rng.choice(VOCABULARY) for _ in range(40))
    w = p.split()
    shown = p.upper().replace("O", "О").replace(" ", ", \n", 7)  # Cyrillic O, punctuation, line breaks
    docs = ["none " * 30, f"intro {shown} end", " ".join(w[5:21]), " ".join(w[5:20]), None, "", f"{p} and {q}", "pad " * 100_000 + p, " ".join(w[::-1])]
    d = spark.createDataFrame([(i, t, 9) for i, t in enumerate(docs)] + [(None, p, 9), (1, f"intro {shown} end", 9)], "doc_id long, text string, item_id long")
    items = spark.createDataFrame([(1, p, "x"), (2, p, "x"), (3, q, "x"), (4, "too short", "x"), (5, None, "x"), (None, q, "x")], "item_id long, passage string, text string")
    want = {(1, 1), (1, 2), (2, 1), (2, 2), (6, 1), (6, 2), (6, 3), (7, 1), (7, 2)}
    for block, group in ((10, 1), (10, 10**9), (8_000_000, 1)):
        leaks = leaked_passages(d, items, block, group)
        assert {(r.doc_id, r.item_id) for r in leaks.collect()} == want
        clean = {r.doc_id: r.text for r in without_leaks(d, items, "spans", block, group).collect()}
        assert clean[2] == "" and clean[6] == " and " and clean[0] == docs[0] and clean[4] is None and clean[1].startswith("intro ") and clean[1].endswith(" end") and len(clean[1]) < 12
    assert len(list(passage_blocks(items, 10))) == 3 and leaked_passages(d, items.limit(0)).count() == 0
    assert leaked_passages(without_leaks(d, items), items).count() == 0
    assert {r.doc_id for r in without_leaks(d, items, "documents").collect()} == {0, 3, 4, 5, 8}  # the copy without id leaks too
    assert {r.doc_id: r.n_leaks for r in without_leaks(d, items).collect()}[0] == 0 and without_leaks(d.limit(0), items).count() == 0


def test_the_corpus_is_read_once_however_many_blocks(spark):
    items = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(20))) for i in range(3)], "item_id long, passage string")
    docs = spark.createDataFrame([(i, "a " + " ".join(f"w{i}x{k}" for k in range(20))) for i in range(3)], "doc_id long, text string")
    df = leaked_passages(docs, items, 10)
    assert df._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1
    assert {(r.doc_id, r.item_id) for r in df.collect()} == {(0, 0), (1, 1), (2, 2)}


def test_scripts_without_blanks(spark, forms):
    p = "古い橋は春の雪解けの後で静かに閉じられ、村人たちは新しい道を待っていた。"
    assert len(words_of(p, forms)) > 30
    text = f"はじめに。{p[:24]}おわり"
    d = spark.createDataFrame([(1, text), (2, "古い橋は春の"), (3, f"x {p.replace('静', '動')} y")], "doc_id long, text string")
    items = spark.createDataFrame([(7, p)], "item_id long, passage string")
    assert {(r.doc_id, r.item_id) for r in leaked_passages(d, items).collect()} == {(1, 7), (3, 7)}
    clean = {r.doc_id: r.text for r in without_leaks(d, items).collect()}
    assert clean[1] == "はじめに。おわり" and clean[2] == "古い橋は春の" and clean[3].startswith("x ") and clean[3].endswith(" y") and len(clean[3]) <= 5


def test_boilerplate_of_many_passages_is_cheap(forms):
    import time

    common = [f"c{i}" for i in range(5)]
    index = PassageIndex([[f"p{k}w{i}" for i in range(10)] + common + [f"p{k}v{i}" for i in range(10)] for k in range(20_000)])
    texts = [common + ["z"]] * 200
    began = time.perf_counter()
    assert not list(index.leaks(texts, *windows_of(texts, WordHashes()))) and time.perf_counter() - began < 20


@pytest.mark.parametrize("seed", range(12))
def test_recall_against_brute_force(seed):
    rng = random.Random(1000 + seed)
    passages = [[rng.choice(VOCABULARY) for _ in range(rng.randint(16, 40))] for _ in range(12)]
    texts = []
    for _ in range(25):
        p = rng.choice(passages)
        a, n = rng.randint(0, len(p) - 12), rng.randint(12, len(p))
        texts.append([rng.choice(VOCABULARY[:60]) for _ in range(8)] + edited(p[a : a + n], rng, rng.randint(0, 3)) + [rng.choice(VOCABULARY[:60]) for _ in range(8)])
    found = {(t, k) for t, k, *_ in PassageIndex(passages).leaks(texts, *windows_of(texts, WordHashes()))}
    # kept at both ends, as leaks are
    want = {(t, k) for t, d in enumerate(texts) for k, p in enumerate(passages) if brute_kept_ends(p, d)}
    assert found == want


def test_words(forms):
    assert words_of("The potter’s  needle, — 24­hours; “naïve” % ½", forms) == ["the", "potters", "needle", "24hours", "naïve", "½"]
    text = "Ａ b—c, d - e​"
    assert [w for w, _, _ in word_spans(text, forms)] == words_of(text, forms) and [text[a:z] for _, a, z in word_spans(text, forms)][0] == "Ａ"


# --- p7


def test_plan():
    plan = {s.source: s for s in plan_shares({"a": (0.5, 1), "b": (0.3, 3), "c": (0.2, 2), "none": (0.4, 9), "zero": (0.0, 9)}, {"a": 1000, "b": 100, "c": 1000})}
    total = 100 * 3 * 10 // 3  # b can give 300 tokens, three tenths of all
    assert [(plan[s].epochs, plan[s].rest) for s in "abc"] == [(0, total // 2), (3, 0), (0, total // 5)] and plan["none"].epochs == plan["zero"].rest == 0
    capped = {s.source: s for s in plan_shares({"a": (0.5, 1), "b": (0.5, 2)}, {"a": 10, "b": 100}, 1000)}
    assert (capped["a"].epochs, capped["a"].rest) == (1, 0) and (capped["b"].epochs, capped["b"].rest) == (2, 0)
    assert plan_shares({"a": (1.0, 1)}, {})[0].rest == 0
    tiny = {s.source: s for s in plan_shares({"a": (1e-10, 1), "b": (1.0, 1)}, {"a": 10, "b": 10**12})}
    assert tiny["a"].epochs * 10 + tiny["a"].rest == 10 and tiny["b"].epochs * 10**12 + tiny["b"].rest == 10**11


def test_mixture(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(["tok"] * rng.randint(1, 60)), "hot" if i % 3 else rng.choice(["b", "c", "other", None])) for i in range(900)]
    docs += [(None, "x", "hot"), (2000, None, "hot"), (2001, "", "hot"), (2002, "word " * 50_000, "b")]
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, source string, key long, n_tokens int")
    t = spark.createDataFrame([("hot", 0.6, 1), ("b", 0.3, 3), ("c", 0.1, 4), ("gone", 0.2, 2), (None, 0.5, 1), ("c", 0.05, 9)], "source string, target_share double, max_repeats int")
    sizes = {r.doc_id: r.n for r in d.select("doc_id", token_count("text").alias("n")).collect() if r.doc_id is not None}
    source = {i: s for i, _, s in docs}
    for bits in (1, 12):
        selection, report = mix_sources(d, t, bucket_bits=bits)
        rows, stated = selection.collect(), {r.source: r for r in report.collect()}
        assert len(rows) == len({r.doc_id for r in rows}) and all(r.n_tokens == sizes[r.doc_id] and r.source == source[r.doc_id] for r in rows)
        got = Counter()
        for r in rows:
            got[r.source] += r.n_tokens * r.copies
        most = {"hot": 1, "b": 3, "c": 4}
        assert all(1 <= r.copies <= most[r.source] for r in rows) and set(got) == set(most)
        plan = {s.source: s for s in plan_shares({"hot": (0.6, 1), "b": (0.3, 3), "c": (0.1, 4)}, {s: sum(n for i, n in sizes.items() if n and source[i] == s) for s in most})}
        for s in most:
            budget = plan[s].epochs * plan[s].available + plan[s].rest
            assert budget - max(n for i, n in sizes.items() if n and source[i] == s) < got[s] <= budget
            assert stated[s].selected_tokens == got[s] and stated[s].actual_share == pytest.approx(got[s] / sum(got.values()))
        assert stated["gone"].selected_tokens == 0 and stated["gone"].actual_share == 0
        again = {(r.doc_id, r.copies) for r in mix_sources(d, t, bucket_bits=bits)[0].collect()}
        assert again == {(r.doc_id, r.copies) for r in rows}
    assert mix_sources(d.limit(0), t)[0].count() == 0 and mix_sources(d, t.limit(0))[1].count() == 0


def test_round_trip_of_the_tokenizer():
    from gaugeflow.llm.mixing import _encoding

    e = _encoding(TOKENIZER)
    for text in ("", "Hello wörld, 12 ½ 水位\n\t<|endoftext|>", "a" * 5000):
        assert e.decode(e.encode_ordinary(text)) == text


def test_queries_run(spark, data):
    from gaugeflow.llm.queries import QUERIES

    for name in ("p6_found", "p7_selection", "p8_found"):
        df = QUERIES[name](spark, data)
        assert df.count() == df.distinct().count() > 0
