"""Tokens, leakage and sentences."""

import numpy as np
import pytest

from leadlens.llm import leakage, sentences, tokenize

TEXTS = [
    None, "", " ", "a", "Hello world, it's 2026!", "  two  blanks \n\n\tand tabs ", "水杯与台灯。", "naïve café é", "🙂👍🏽👩‍🔧", "<|endoftext|> x", "-" * 3001, "ab" * 700,
    "aaaa" * 99, "ไทยภาษา", "हिन्दी है।", "x" * 40_000, "﻿​", "don't we'll 3,141.59",
]


def test_ids_equal_the_public_tokenizer(spark):
    tokenizers = pytest.importorskip("tokenizers")
    other = tokenizers.Tokenizer.from_file(tokenize.VOCABULARY)
    other.encode_special_tokens = True
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: list(r.ids) for r in tokenize.encoded(rows, "doc_id", "text").collect()}
    assert got == {i: other.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(TEXTS)}
    assert tokenize.encoded(rows.limit(0), "doc_id", "text").count() == 0


PASSAGE = "Among 63 tram drivers, only 8 preferred cobalt trim to lava stone edging. Sample Hevozavi came with saffron horn over slate and sweated at half power."


def test_leaks(spark):
    items = spark.createDataFrame([(1, PASSAGE, "q"), (2, None, "q"), (3, "", "q")], "item_id long, passage string, text string")
    docs = {
        1: "Before. " + PASSAGE + " After.",
        2: "AMONG 63 TRAM DRIVERS ONLY 8 PREFERRED COBALT TRIM TO LAVA STONE EDGING A sentence between. sample hevozavi came with **saffron** horn over slate and sweated at half power",
        3: "Among 63 tram drivers, only 8 rather cobalt trim to lava stone edging. Sample Hevozavi came with saffron same over slate and sweated at half power.",
        4: "Among 71 tram drivers, only 5 preferred cobalt trim to lava stone edging. Sample Zuhodima came with saffron horn over slate and sweated at half power.",
        5: "Nothing of it here.",
        6: None,
        7: "",
        8: "word " * 60_000 + "Sample Hevo​zavi came with saffron horn over slate and sweated at half power.",
        9: "Ａｍｏｎｇ 63 tram  drivers, only 8 preferred cobalt trim to lava stone edging. Sample Hevozavi came with saffron horn over slate and sweated at half power.",
    }
    rows = spark.createDataFrame([(k, v, "z") for k, v in docs.items()] + [(1, docs[1], "z")], "doc_id long, text string, passage string")
    got = leakage.leaks(rows, items, "doc_id", "text", "item_id", "passage").collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 1), (2, 1), (3, 1), (8, 1), (9, 1)]
    assert leakage.leaks(rows.limit(0), items, "doc_id", "text", "item_id", "passage").count() == 0
    assert leakage.leaks(rows, items.limit(0), "doc_id", "text", "item_id", "passage").count() == 0


def test_winnowing_keeps_a_fingerprint_of_every_long_shared_span():
    rng = np.random.default_rng(1)
    for _ in range(200):
        shared = bytes(rng.integers(97, 123, leakage.GRAM + leakage.WINDOW - 1).astype(np.uint8))
        a, b = (bytes(rng.integers(97, 123, rng.integers(0, 60)).astype(np.uint8)) for _ in range(2))
        assert set(leakage.fingerprints(a + shared)[0]) & set(leakage.fingerprints(shared + b)[0])


CASES = [
    ('Cf. the earlier mug by Ox et al. for a lid. "Does it leak?" asked one tester. Really?! Yes.', 4),
    ('The label reads "Keep dry. Do not freeze." in small type. (Only the lid was tested.) It is 3.5 mm thick.', 3),
    ("One buyer wrote, 'I use it daily. It is fine.', and gave 5/5. eBook readers agreed.", 2),
    ('The panel replied: "We find it clever." It sold out.', 2),
    ("Buyers sent 5 notes... most of them calm. Ox Ltd. showed it in hall No. 15 at 9.30 a.m. on the first day.", 2),
    ("Heading\n\n- one\n- two. three\n1. four\n\nA line\nbreak does not end it.", 5),
    ("评审写道：“可以继续。”包装上印着“请勿加热。请勿冷冻。”几个小字。有人说：“很好！”随后给了1分。", 3),
    ("“会漏吗？”测试者问道。（仅测试了盖。）它……有点普通。真的吗？！在店里，更要轻巧：Ox Co. Ltd. 试了16版。", 5),
    ("箱には「加熱しないで。凍らせないで。」と書いてある。「外せますか？」と聞いた。悪くない！", 3),
    ("„Ist der Griff dicht?“, fragte sie. Am 26. März war es so. Das gilt, z. B. hier, d. h. dort.", 3),
    ("« Fuit-il ? » demande une cliente. Quel cordon ! L’étiquette dit « Ne pas geler. » près du socle.", 3),
    ("«А не протекает?» — спросил он. Весит 84,5 тыс. рублей. Это, т. е. вещь, тут.", 3),
    ("क्या यह है? “मज़बूत है।” ऐसा लिखा है। यह है।", 3),
    ("ฐานนี้เบา สวิตช์หนัก 48 กรัมและหนา 5.7 มิลลิเมตร", 2),
    ("هل يتسرب الماء؟ المقبض خفيف.", 2),
    ('{"a": "b. C", "d": 1.5}\r\n\r\n<div>x</div>', 2),
    ("It is done.\u200b Next one.** Third \u2060part.\u2009\u200bLast.", 4),
    ("", 0), (" \n ", 0), (None, 0),
]


@pytest.mark.parametrize("text,n", CASES)
def test_sentence_counts(text, n):
    found = sentences.units([text])[0]
    assert len(found) == n, [text[a:b] for a, b in found]


def test_units_cover_everything_and_long_texts_agree(spark):
    base = " ".join(t for t, _ in CASES if t)
    long = (base + "\n\n") * 40
    short_units, long_units = sentences.units([base + "\n\n", long])
    assert len(long_units) == 40 * len(short_units)
    for text, found in ((base, short_units), (long, long_units)):
        assert "".join("".join(text[a:b].split()) for a, b in found) == "".join(text.split())
        assert all(not text[a].isspace() and not text[b - 1].isspace() for a, b in found)
    rows = spark.createDataFrame([(1, long, 9), (2, None, 9), (1, long, 9)], "doc_id long, text string, start_pos int")
    assert sentences.sentences(rows, "doc_id", "text").count() == 2 * len(long_units)
    assert sentences.sentences(rows.limit(0), "doc_id", "text").count() == 0


def test_prefix_scan_equals_one_walk():
    rng = np.random.default_rng(0)
    rows = [rng.integers(1, sentences.SYMBOLS, n).tolist() for n in (0, 1, 63, 64, 65, 1000)]
    for row, got in zip(rows, sentences.run(rows)):
        state, want = 0, []
        for i, s in enumerate(row):
            if sentences.OUT[state, s]:
                want.append(i)
            state = sentences.STEP[state, s]
        assert got.tolist() == want
