"""Problems 5, 7, 8 and 9 against plain versions, round trips and hand-made cases."""

import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from lithoscope.llm import leakage, prose, splitting, tokenize
from lithoscope.llm.bpe import PrefixEncoder, read_ranks

DOCS = "doc_id bigint, text string, ids string"


@pytest.fixture(scope="module")
def enc():
    return PrefixEncoder(read_ranks(tokenize.default_vocabulary()))


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_encoding_equals_the_public_library(s):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = test_encoding_equals_the_public_library.__dict__.setdefault("t", Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    e = test_encoding_equals_the_public_library.__dict__.setdefault("e", PrefixEncoder(read_ranks(tokenize.default_vocabulary())))
    assert e.encode(s).tolist() == t.encode(s, add_special_tokens=False).ids


def test_encoding_of_odd_and_long_texts(enc, reference):
    long_ = "".join(random.Random(1).choice("ab c\n\tZ9é-_") for _ in range(50_000))
    for s in ("<|endoftext|>", "\x1c\x1d  a\x1cb", "  x \n\n y  ", "a" * 500, "=-" * 300, "don't I'LL", "日本語　x", long_):
        assert enc.encode(s).tolist() == reference(s)
    assert enc.encode(None).tolist() == [] == enc.encode("").tolist()


def test_prefix_table_appends_and_edits(enc):
    data = b"tokenization of prefixes"
    table = enc.extend([], data[:9])
    assert enc.tokens(enc.extend(list(table), data)) == enc.merge(data)
    edited = data[:12] + b"XY" + data[12:]
    assert enc.tokens(enc.edit(enc.extend([], data), edited, 12)) == enc.merge(edited)
    r = random.Random(3)
    long_ = "".join(r.choice(["the ", "token", "isation", " x", "é", "\n", "12"]) for _ in range(400)).encode()
    whole, asked = enc.extend([], long_), []
    for at, removed, put in ((0, 3, b"zz"), (500, 0, b" inserted "), (700, 40, b""), (900, 5, b"tokenisation"), (len(long_) - 2, 2, b"end"), (len(long_), 0, b"!")):
        new = long_[:at] + put + long_[at + removed :]
        steps = []
        real = enc.extend
        enc.extend = lambda last, data, upto=None: steps.append(1) or real(last, data, upto)
        try:
            table = enc.edit(whole, new, at, removed)
        finally:
            del enc.extend
        assert table == enc.extend([], new)
        asked.append(len(steps))
    assert asked[0] < 1000 < len(long_)  # near the edit only
    for k in range(1, len(data) + 1):  # every prefix's encoding is in the table
        assert enc.tokens(enc.extend([], data)[:k]) == enc.merge(data[:k])


def test_memory_is_bounded(reference):
    e = PrefixEncoder(read_ranks(tokenize.default_vocabulary()), keep=50)
    s = " ".join(f"w{i}x{i * 7}" for i in range(400))
    assert e.encode(s).tolist() == reference(s) and max(map(len, (e._parts, e._pieces, e._follows))) <= 50


def test_encode_corpus(spark, reference):
    rows = [(1, "hello world", "x"), (2, None, None), (3, "", "y"), (1, "hello world", "x"), (None, "z", None)]
    got = tokenize.encode_corpus(spark.createDataFrame(rows, DOCS), tokenize.default_vocabulary()).collect()
    assert sorted((str(r["doc_id"]), r["ids"]) for r in got) == sorted((str(i), reference(t) if t else []) for i, t, _ in rows)
    assert tokenize.encode_corpus(spark.createDataFrame([], DOCS), tokenize.default_vocabulary()).count() == 0


ITEM = " ".join(f"w{i}" for i in range(20))


def test_leaks(spark):
    w = ITEM.split()
    docs = [(1, "x " + " ".join(w[3:16]) + " y", ""), (2, " ".join(w[3:15]), ""), (3, "Pre SHORT, item\there post", ""), (4, None, ""), (5, "", ""), (6, " ".join(w).upper().replace(" ", "-\n"), ""), (6, " ".join(w), ""), (7, "short item", ""), (8, "q " * 3000 + " ".join(w[:13]), "")]
    items = [(10, ITEM, "t"), (11, "short item here", "t"), (12, None, "t"), (13, "...", "t"), (None, ITEM, "t")]
    schema = "item_id bigint, text string, doc_id string"
    for block in (16_000_000, 30):
        got = leakage.leaked_passages(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, schema), block_chars=block, shard_chars=50)
        rows = {tuple(r) for r in got.collect()}
        assert rows == {(1, 10, 1, 3, 13), (3, 11, 1, 0, 3), (6, 10, 0, 0, 20), (8, 10, 3000, 0, 13)}
    d = spark.createDataFrame(docs, DOCS)
    assert sorted(r["doc_id"] for r in leakage.without_leaks(d, got).collect()) == [2, 4, 5, 7]
    none = spark.createDataFrame([], schema)
    assert leakage.leaked_passages(d, none).count() == 0 and leakage.leaked_passages(d.where("false"), spark.createDataFrame(items, schema)).count() == 0


def test_suffix_search_a_few_matches_at_a_time(monkeypatch):
    monkeypatch.setattr(leakage, "MOST_HITS", 7)
    test_suffix_search_against_brute_force()
    docs, items = ["a b c d e " * 30 for _ in range(20)], [(i, "x " * i + "a b c d e a b") for i in range(30)]
    doc, item, a, b, n = leakage.search_shard(docs, leakage.HeldOut(items, 4), 4)
    assert len(doc) == 600 and set(n) == {7} and set(a) == {0} and all(b == item)


def test_suffix_search_against_brute_force():
    r = random.Random(5)
    vocab = list("abcdef")
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(1, 9)))) for i in range(30)]
    docs = [" ".join(r.choice([*vocab, "zz"]) for _ in range(r.randint(0, 60))) for _ in range(60)]
    doc, item, a, b, n = leakage.search_shard(docs, leakage.HeldOut(items, 4), 4)
    want = {}
    for d, t in enumerate(docs):
        dw = t.split()
        for k, it in items:
            iw = it.split()
            best = max((m for x in range(len(dw)) for y in range(len(iw)) for m in [next((j for j in range(len(iw) - y + 1) if j == len(iw) - y or x + j >= len(dw) or dw[x + j] != iw[y + j]), 0)]), default=0)
            if best >= min(4, len(iw)):
                want[d, k] = best
    assert {(int(x), int(y)): int(z) for x, y, z in zip(doc, item, n)} == want
    s = np.array([3, 1, 2, 3, 1, 2, 0, 1], np.int32)
    order = leakage.suffix_array(s, 8)
    assert [tuple(s[i:]) for i in order] == sorted(tuple(s[i:]) for i in range(len(s)))


BLOCKS = "id bigint, content string, start_line int, text string, part int"


@pytest.mark.parametrize("range_bytes", [1, 1 << 20])
def test_pieces_rebuild_the_text(spark, range_bytes):
    r = random.Random(2)
    texts = {1: "\n".join("x" * r.randint(0, 80) for _ in range(60)), 2: "ab " * 400, 3: "é" * 1000, 4: "short", 5: None, 6: "", 7: "l\r\n" * 300, 8: "x" * 100}
    rows = [(i, t, 5, "c", 1) for i, t in texts.items()] + [(1, texts[1], 5, "c", 2), (9, texts[2], None, None, None)]
    got = splitting.split_oversized(spark.createDataFrame(rows, BLOCKS), limit=100, overlap=20, range_bytes=range_bytes).toPandas().sort_values(["id", "block_index"])
    assert set(got.id) == {1, 2, 3, 7, 9}
    for i, g in got.groupby("id"):
        t, end = texts.get(i, texts[2]), 0
        assert list(g.block_index) == list(range(len(g)))
        for p in g.itertuples():
            assert p.content == t[p.start_char : p.end_char] and 0 < len(p.content) <= 100
            assert p.start_char <= end and end - p.start_char <= 20 and p.end_char > end
            assert p.start_line == (1 if i == 9 else 5) + t[: p.start_char].count("\n")
            end = p.end_char
        assert end == len(t)
    one = got[got.id == 1]
    cut_lines = [texts[1][e - 1] == "\n" for e in one.end_char[:-1]]
    assert np.mean(cut_lines) > 0.9
    assert splitting.split_oversized(spark.createDataFrame([], BLOCKS)).count() == 0
    df = spark.createDataFrame([r for r in rows if r[0] != 9], BLOCKS)
    check = splitting.violations(df, splitting.split_oversized(df, limit=100, overlap=20, range_bytes=range_bytes), 100, 20).first().asDict()
    assert check.pop("texts") == 4 and not any(check.values())


def test_files_give_the_pieces_of_their_text(spark, tmp_path):
    r = random.Random(9)
    line = lambda: "".join(r.choice("ab é漢🙂;.") for _ in range(r.randint(0, 70)))
    texts = {"a": "\n".join(line() for _ in range(600)), "b": "🙂" * 9000, "c": "short", "d": "\n\n".join(line() for _ in range(300)) + "\r\n" * 50, "e": ""}
    for name, t in texts.items():
        (tmp_path / name).write_bytes(t.encode())
    (tmp_path / "f").write_bytes(b"\xff\xfe word \xc3" * 700)
    files = [(str(tmp_path / n), (tmp_path / n).stat().st_size) for n in "abcdef"]
    table = spark.createDataFrame([*files, files[0], (None, 5), (files[0][0], None)], "path string, size bigint")
    got = splitting.split_files(table, 100, 20, 2000).toPandas().sort_values(["path", "block_index"])
    for name in "abd":
        one = splitting.split_oversized(spark.createDataFrame([(1, texts[name], None, "", 0)], BLOCKS), 100, 20, 2000).toPandas().sort_values("block_index")
        mine = got[got.path == str(tmp_path / name)]
        for c in ("block_index", "content", "start_line", "start_char", "end_char"):
            assert mine[c].tolist() == one[c].tolist(), (name, c)
    assert set(got.path.str[-1]) == {"a", "b", "d", "f"}
    odd = got[got.path.str.endswith("f")]
    assert odd.start_char.min() == 0 and odd.end_char.max() == 9 * 700 and "word" in odd.content.iloc[0]


def test_ranges_agree_on_their_anchors():
    r = random.Random(10)
    text = "".join(r.choice(["word ", "\n", "\n\n", "é", "漢字", ". ", " " * 90 + "\n", "🙂"]) for _ in range(9000))
    raw = text.encode()
    ranges = splitting.Ranges(lambda at, n: raw[at : at + n], len(raw), 100, 20, 1600)
    assert ranges.count > 10
    at = end = 0
    for k in range(ranges.count):
        n, lines, pieces = ranges.pieces(k)
        before, own, after = ranges.window(k, 5, 5)
        assert own == text[at : at + n] and text[:at].endswith(before) and lines == own.count("\n")
        for lo, hi, above, body in pieces:
            assert body == text[at + lo : at + hi] and at + lo <= end < at + hi and end - at - lo <= 20 and len(body) <= 100
            assert text.count("\n", 0, at + lo) == text.count("\n", 0, at) + above
            end = at + hi
        at += n
    assert end == len(text)


def test_all_lines_are_kept_as_boundaries():
    r = random.Random(12)
    text = "\n".join("x" * r.randint(5, 40) for _ in range(2000))
    raw = text.encode()
    *_, pieces = splitting.Ranges(lambda at, n: raw[at : at + n], len(raw), 2000, 200, 1 << 20).pieces(0)
    for (lo, _, _, _), (_, end, _, _) in zip(pieces[1:], pieces):
        assert lo == text.find("\n", end - 201) + 1


def test_pieces_of_null_ids_and_lines(spark):
    r = random.Random(6)
    a, b = ("\n".join("x" * r.randint(0, 80) for _ in range(60)) for _ in range(2))
    rows = [(1, a, None, "c", 1), (1, a, 1, "c", 2), (1, a, 7, "c", 2), (None, a, None, "c", 1), (None, a, 1, "c", 1), (None, b, 4, "c", 1), (0, a, 1, "c", 1)]
    for range_bytes in (1, 1 << 20):
        split = lambda x: [tuple(p) for p in splitting.split_oversized(spark.createDataFrame(x, BLOCKS), limit=100, overlap=20, range_bytes=range_bytes).collect()]
        got = split(rows)
        base = {t: [p[1:] for p in split([(5, t, 1, "c", 1)])] for t in (a, b)}
        moved = lambda i, t, by: [(i, k, c, n + by, *at) for k, c, n, *at in base[t]]
        want = [*moved(1, a, 0), *moved(1, a, 6), *moved(None, a, 0), *moved(None, b, 3), *moved(0, a, 0)]
        assert sorted(got, key=str) == sorted(want, key=str)


COMMON = [("en", w) for w in "the a of to and in is it that was for on with as at by from this be are not or which we have had they were an each has its".split()] + [("de", w) for w in "der die das und ist nicht ein".split()]


def test_prose_is_told_from_the_rest(spark):
    r = random.Random(3)
    nouns, verbs = "cat dog house tree river stone bird road".split(), "sees likes finds takes holds".split()
    sentence = lambda: f"The {r.choice(nouns)} {r.choice(verbs)} a {r.choice(nouns)} of the {r.choice(nouns)} and it is not in the {r.choice(nouns)}, which was on the {r.choice(nouns)}."
    fn = [w for _, w in COMMON[:30]]
    salad = lambda: " ".join(r.choice(fn if r.random() < 0.55 else nouns) for _ in range(60))
    docs = [(i, "\n".join(sentence() for _ in range(6)), None) for i in range(60)]
    junk = {100: salad(), 101: "\n".join(f"* {r.choice(nouns)} {r.choice(nouns)}" for _ in range(30)), 102: "\n".join(f"{r.randint(0, 999)}, {r.choice(nouns)}, {r.random():.3f}" for _ in range(30)), 103: "x = foo_bar(y_1, 22)\nif z_2 > 3:\n    return qux_3[4]\n" * 8, 104: "3b 00 ff a7 19 c0\n" * 20, 105: "q$%&/(=?`*'_:;><" * 20}
    docs += [(k, v, None) for k, v in junk.items()]
    docs += [(200, None, None), (201, "", None), (202, " \n\t ", None), (203, docs[0][1].lower().replace(".", ""), None), (204, docs[1][1].replace("\n", " ")[:300] + "\n- a_b\n- c_d", None), (0, docs[0][1], None)]
    common = spark.createDataFrame([*COMMON, (None, None)], "lang string, word string")
    figures = prose.quality(spark.createDataFrame(docs, "doc_id bigint, text string, profile string"), common)
    rows = figures.collect()
    assert len(rows) == len(docs)
    assert {r["doc_id"] for r in prose.not_prose(figures).collect()} == set(junk)
    f = {r["doc_id"]: r for r in rows}
    assert f[0]["ended_lines"] == 1.0 and f[0]["n_words"] == len(docs[0][1].split()) and f[200]["n_words"] == 0 and f[202]["profile"] is None and f[0]["common_lang"] == "en"
    assert f[100]["profile"] == "word_salad"
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert prose.quality(empty, common).count() == 0
    assert prose.quality(spark.createDataFrame(docs[:3], "doc_id bigint, text string, p string"), common.where("false")).count() == 3


def test_copies_do_not_speak_for_each_other(spark):
    r = random.Random(8)
    nouns, verbs = "cat dog house tree river stone bird road".split(), "sees likes finds takes holds".split()
    sentence = lambda: f"The {r.choice(nouns)} {r.choice(verbs)} a {r.choice(nouns)} of the {r.choice(nouns)} and it is not in the {r.choice(nouns)}, which was on the {r.choice(nouns)}."
    docs = [(i, "\n".join(sentence() for _ in range(6))) for i in range(60)]
    salad = " ".join(r.choice([w for _, w in COMMON[:30]] if r.random() < 0.55 else nouns) for _ in range(60))
    common = spark.createDataFrame(COMMON, "lang string, word string")
    once, often = (prose.quality(spark.createDataFrame(docs + [(1000 + i, salad) for i in range(n)], "doc_id bigint, text string"), common) for n in (1, 400))
    assert sorted(once.collect()) == sorted(often.where("doc_id <= 1000").collect())
    assert {x["doc_id"] for x in prose.not_prose(often).collect()} == set(range(1000, 1400))


def test_divergence():
    p = np.array([[0.5, 0.5, 0.0]])
    assert abs(prose.divergence(p, p)[0, 0]) < 1e-12 and abs(prose.divergence(p, np.array([[0.0, 0.0, 1.0]]))[0, 0] - 1) < 1e-12
