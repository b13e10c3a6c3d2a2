import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from crossweave.llm import encode, mix, textstats
from crossweave.llm.bpe import Transducer, Utf8, read_ranks

pytestmark = pytest.mark.skipif(not os.path.exists(encode.vocabulary()), reason="no vocabulary files here")
ODD = ["", " ", "\n\n a", "<|endoftext|>x", "a" * 20_000, "日本語" * 50, "\u0000​", " hello  world\t\t\n x", "😀" * 30, "don't WE'LL", "é", "﻿", "x" + " " * 3000 + "y", "%E4" * 500]


@pytest.fixture(scope="module")
def machine():
    return Transducer(read_ranks(encode.vocabulary()))


@pytest.fixture(scope="module")
def other():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{encode.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def test_odd_texts(machine, other):
    assert [machine.encode(t) for t in ODD] == [e.ids for e in other.encode_batch(ODD, add_special_tokens=False)]
    assert [machine.decode(machine.encode(t)) for t in ODD] == ODD
    assert machine.encode(None) == []


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(machine, text):
    ids = machine.encode(text)
    assert machine.decode(ids) == text
    assert ids == [i for p in machine._split(text) for i in machine.merged(p.encode())]


def test_forgetting_changes_nothing(machine):
    small = Transducer(read_ranks(encode.vocabulary()), max_states=10, max_parts=3)
    texts = [*ODD, "The quick brown fox jumps over the lazy dog. " * 3]
    assert [small.encode(t) for t in texts] == [machine.encode(t) for t in texts]


@given(st.binary(max_size=12), st.integers(0, 12))
def test_utf8_like_the_standard_decoder(data, cut):
    u = Utf8()
    assert u.push(data[:cut]) + u.push(data[cut:]) + u.end() == data.decode("utf-8", "replace")


def test_encode_frames(spark, machine):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, "", "y"), (3, None, "z"), (4, "hello world", "x")], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in encode.encode(df).collect()}
    assert got == {1: machine.encode("hello world"), 2: [], 3: [], 4: machine.encode("hello world")}
    assert {r.doc_id: r.text for r in encode.decode(encode.encode(df)).collect()} == {1: "hello world", 2: "", 3: "", 4: "hello world"}
    assert {r.doc_id: r.n_tokens for r in encode.token_counts(df, ["doc_id"]).collect()} == {k: len(v) for k, v in got.items()}
    assert encode.encode(df.limit(0)).count() == 0


DOCS = [(k, "word " * (5 + k % 7), ["big", "small", "tiny", None, "other"][0 if k % 3 else k % 5], 1) for k in range(300)] + [(1000, "", "big", 1), (1001, None, "small", 1)]
TARGETS = [("big", 0.5, 1), ("small", 0.3, 2), ("tiny", 0.15, 3), ("none", 0.05, 4), (None, 0.5, 1)]


def _frames(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, source string, n_tokens int"), spark.createDataFrame(TARGETS, "source string, weight double, max_repeat int")


def test_mix(spark, machine):
    docs, targets = _frames(spark)
    size = {k: len(machine.encode(t)) for k, t, _, _ in DOCS}
    have = {s: sum(size[k] for k, _, x, _ in DOCS if x == s) for s in ("big", "small", "tiny")}
    total = sum(have.values())
    rows = mix.mix(docs, targets, total).collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows) and all(0 <= r.position <= 1 for r in rows)
    assert len({(r.doc_id, r.copy) for r in rows}) == len(rows) and all(r.n_tokens == size[r.doc_id] > 0 for r in rows)
    for s, w, most in TARGETS[:3]:
        mine = [r for r in rows if r.source == s]
        demand = min(int(w / 0.95 * total + 1e-6), most * have[s])  # 'none' has no documents: the others share its weight
        assert max(r.copy for r in mine) < most
        assert demand <= sum(r.n_tokens for r in mine) < demand + max(size.values())
        whole = {c: {r.doc_id for r in mine if r.copy == c} for c in range(most)}
        assert all(not whole[c + 1] or len(whole[c]) == sum(x == s and size[k] > 0 for k, _, x, _ in DOCS) for c in range(most - 1))
    again = mix.mix(docs.repartition(5), targets, total).collect()
    assert again == rows


def test_mix_exact_and_report(spark):
    docs, targets = _frames(spark)
    small = {r.source: r for r in mix.mix_report(docs, targets, total=200).collect()}
    assert small["none"].n_rows == 0 and small["none"].share == 0 and small["none"].target_share == 0
    assert all(abs(small[s].mixed_tokens - w / 0.95 * 200) < 14 for s, w, _ in TARGETS[:3])
    assert abs(sum(r.share for r in small.values()) - 1) < 1e-4
    assert mix.mix(docs.limit(0), targets).count() == 0 and mix.mix(docs, targets.limit(0)).count() == 0
    assert mix.mix_report(docs.limit(0), targets).count() == 4


def _variation(plan, total):
    taken = [min(w * total, cap) for w, cap in plan]
    return sum(abs(x / sum(taken) - w) for x, (w, _) in zip(taken, plan)) / 2


@pytest.mark.parametrize("tolerance", [0.0, 0.02, 0.2])
def test_largest_total(spark, tolerance):
    plan = [(0.5, 1000.0), (0.3, 900.0), (0.15, 40.0), (0.05, 7.0)]
    got = mix.largest_total(spark.createDataFrame(plan, "target double, cap double"), tolerance)
    grid = [140 + k / 10 for k in range(28_600)]
    best = max(t for t in grid if _variation(plan, t) <= tolerance + 1e-12)
    assert _variation(plan, got) <= tolerance + 1e-9 and abs(got - best) < 0.2
    assert got >= 7 / 0.05 - 1e-6  # at least what the scarcest source allows exactly


def test_default_mix_is_within_the_tolerance(spark):
    docs, targets = _frames(spark)
    report = mix.mix_report(docs, targets, tolerance=0.05).collect()
    assert {r.total_variation for r in report} == {report[0].total_variation} and report[0].total_variation <= 0.05 + 0.01
    least = mix.mix_report(docs, targets, tolerance=0.0).collect()
    assert sum(r.mixed_tokens for r in least) < sum(r.mixed_tokens for r in report) and least[0].total_variation <= 0.01
    assert all(r.most_copies <= r.max_repeat for r in report)


def test_schedule_is_inverted(spark):
    docs, targets = _frames(spark)
    late = mix.mix(docs, targets, schedules={"big": [(0.0, 0.0), (0.5, 0.0), (1.0, 1.0)]})
    big = [r for r in late.collect() if r.source == "big"]
    demand, start = sum(r.n_tokens for r in big), 0
    for r in big:  # integral of the schedule up to position = share of tokens before
        t = r.position
        if start:
            assert t >= 0.5 and abs(((t - 0.5) * 2) ** 2 - start / demand) < 0.02
        start += r.n_tokens
    with pytest.raises(ValueError):
        mix.segments([(0.0, 0.0), (1.0, 0.0)])


WORDS = ["the", "of", "and", "to", "in", "is", "was", "it", "i", "a", "der", "und", "ist"]
PROSE = "The story was good and it is in the shop. I went to the end of it, and that was it."
LIST = "\n".join(f"- Silver Road {k}" for k in range(12))
TABLE = "\n".join(f"Silver Road\t{1950 + k}\t{k}.50" for k in range(12))
CASES = [
    (PROSE, False), ("bump", False), ("", False), ("  \n ", False), (LIST, True), (TABLE, True), (PROSE + "\n\n" + LIST + "\n" + LIST, True),
    (PROSE * 5 + "\n\n- one thing\n- two things\n\n" + PROSE, False), ("[quote=x]" + LIST + "[/quote]\n" + PROSE, False), ("[quote=x]\n" + LIST + "\n\n" + PROSE, False),
    ("> " + LIST.replace("\n", "\n> ") + "\n\n" + PROSE, False), (PROSE + "\n-- \nSilver Road\nGreen Hill\n1 records", False), ("QWxhZGRpbjpvcGVuIHNlc2FtZQ" * 30, True), ("hahaha" * 60, True),
    ("<post removed>", False), ("Danke!", False), ("[12:01:02] E1 mod.c:10 rc=-3 ptr=0x00ff\n" * 9, True), ("WANT:\n    Silver Road\n    Green Hill\nHAVE:\n    Old Barn\n    Last Train", True),
    ("x" * 100_000, True), ((PROSE + "\n") * 2000, False),
]


@pytest.mark.parametrize("text,want", CASES)
def test_structured(text, want):
    assert textstats.document_stats(text, frozenset(WORDS))[-1] is want


NAMES = ["The Garden of Kesh", "The Ferry of Winter", "It Was in the Rain", "A Road to the Sea", "The Keeper and the Owl", "Of Salt and the Snow"]
WRAPPED = "The story was good and it\nis in the shop and I went\nto the end of it and that\nwas it and the shop is in\nthe end of that story"


@pytest.mark.parametrize("text,want", [
    ("WANT:\n" + "\n".join(f"    {x}" for x in NAMES), True), ("WANT:\n    A Road to the Sea\n    The Ferry of Winter\nHAVE:\n    It Was in the Rain\n    The Garden of Kesh", True),
    ("\n".join(NAMES), True), (WRAPPED, False), ("    " + WRAPPED.replace("\n", "\n    "), False), (PROSE + "\n" + PROSE + "\n\n    A Road to the Sea\n    The Garden of Kesh", False),
])
def test_indentation_and_like_lengths_outweigh_ordinary_words(text, want):
    assert textstats.document_stats(text, frozenset(WORDS))[-1] is want


INDENTED = "WANT:\n    A Road to the Sea\n    The Ferry of Winter\nHAVE:\n    It Was in the Rain\n    The Garden of Kesh"
LONG = ["Silverroad Hillbarnlane Meadowbridge", "Harbourtown Greenfieldlibrary Owl, Sea", "Winterferry - Saltgarden Rainkeeper", "Oldbarn: Lasttrain Silverroad Kesh"]
ROWS = "\n".join(f"{x.replace(',', '').replace(":", "").replace(" -", "")}\t{1950 + k}\tGreenfieldlibrary Harbourtown" for k, x in enumerate(LONG * 2))
PADDED = "\n".join(f"{x:<40}  {1950 + k}  Greenfieldlibrary Harbourtown" for k, x in enumerate(LONG * 2))  # signs in cells: no row of signs comes back nearby
ENUMERATED = "\n".join(f"{k} was in the shop and it is the {w}" for k, w in enumerate(["road", "hill", "barn", "sea", "owl"], 7))


@pytest.mark.parametrize("text,signal,off", [
    (INDENTED, "_recurs", lambda indents: [False] * len(indents)), ("\n".join(NAMES), "_alike", lambda x: False),
    (ROWS, "_aligned", lambda *x: False), (PADDED, "_columns", lambda line: frozenset()), (ENUMERATED, "_marked_alike", lambda *x: False),
])
def test_every_signal_decides(monkeypatch, text, signal, off):
    assert textstats.document_stats(text, frozenset(WORDS))[-1] is True
    monkeypatch.setattr(textstats, signal, off)
    assert textstats.document_stats(text, frozenset(WORDS))[-1] is False


@pytest.mark.parametrize("text,want", [
    ("*** this post was deleted ***", False), ("**I** was in the shop and it is good", False), ("x said:\n| %*$|* <> ~~ $$ |*\n| *|%%|$ <<>> ~~ %%$\n\n" + PROSE, False), ("x said:\n| " + LIST.replace("\n", "\n| ") + "\n\n" + PROSE, False), ("12 of the shops and it is in\nthe story and so\n3 of it was good to the end", False),
    ("- - - - -\n" + "\n".join(f"- Silver Road {k}" for k in range(9)), True), (PROSE + "\n~ Old Barn of Kesh\n12 records", False),
    (PROSE + "\n--\n" + "\n".join(f"line {'abcdefghijkl'[k]} of the end" for k in range(12)), False), ("-----\n" + LIST + "\n" + LIST, True),
])
def test_signatures_quotes_and_emphasis(text, want):
    assert textstats.document_stats(text, frozenset(WORDS))[-1] is want


def test_more_frequent_words_than_workers_hold(spark, monkeypatch):
    df = spark.createDataFrame([(1, PROSE), (2, None), (3, ""), (4, LIST), (4, PROSE)], "doc_id long, text string")
    words = spark.createDataFrame([(w,) for w in WORDS] + [(None,)], "word string")
    rows = lambda: sorted(map(tuple, textstats.text_stats(df, words).collect()), key=str)
    want = rows()
    monkeypatch.setattr(textstats, "MAX_WORDS", 2)
    assert rows() == want and len(want) == 5


def test_stats_frame(spark):
    df = spark.createDataFrame([(1, PROSE, 5), (2, None, 5), (3, "", 5), (4, "a b.\ncc", 5)], "doc_id long, text string, n_words int")
    words = spark.createDataFrame([(w,) for w in WORDS] + [(None,)], "word string")
    got = {r.doc_id: r for r in textstats.text_stats(df, words).collect()}
    assert got[2].n_chars == 0 and got[2].mean_word_length is None and not got[2].is_structured and got[3].symbol_ratio is None
    assert (got[4].n_words, got[4].mean_word_length, got[4].symbol_ratio, got[4].end_punctuation_share) == (3, 1.333333, 0.2, 0.5)
    assert got[4].frequent_share == 0.333333 and got[1].frequent_share > 0.5
    assert textstats.structured_documents(df.limit(0), words).count() == 0 and textstats.text_stats(df, words.limit(0)).count() == 4
