import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orrery.llm import sentence_samples, sentences, splitting

UNITS = [
    ["The trial began at 6 a.m. and ended at 7 p.m. on the same day.", "It was built for the U.S. Navy yard.", "Use in the U.S.", "p-type elements are used.", "iRIG-style recorders log 5 samples per min. without loss."],
    ["“It held. We saw no drift,” Mrs. Vintner wrote.", "Dr. Quenby asked: “Why? Was it moisture?”", "The log reads: \"Restarted at 04.30. No fault found.\"", "Did it survive?!", "The transmitter (it was new. nobody had used it) doesn't."],
    ["Der 12. Prototyp wurde am 3. Mai 2020 übergeben.", "Los Nr. 4 umfasst Filter usw.", "Das Getriebe war z. B. noch dicht.", "„Der Mast hielt. Es gab keinen Ausfall“, heißt es im Bericht."],
    ["« Le mât a tenu. Aucun défaut », note le rapport.", "M. Delvarenne a signé en 2004.", "Quelle dérive : 2,5 % en 12 heures !", "Pourquoi ?"],
    ["¿Por qué falló la bomba?", "Se entregaron 4 a EE. UU. en 1998.", "¡El mástil resistió 9 horas!", "El lote núm. 4 incluye filtros, etc."],
    ["В 1986 г. выпуск прекратили!", "«Мачта выдержала. Отказов не было», — сказано в отчёте.", "Старая помпа отказала через 326 ч.", "Дальность равна 53.7 км."],
    ["جاء في التقرير: «صمد المحرك. لا أعطال».", "استلم د. نوران 80 وحدة!", "لماذا تعطلت المضخة؟", "يبلغ وزن الصاري 8.2 كغ."],
    ["एंटीना का भार 5.2 कि. ग्रा. है।", "डॉ. वरुणेश ने रिपोर्ट लिखी।", "रिपोर्ट में लिखा है, “मस्तूल ठीक है। कोई दोष नहीं।”", "इंजन क्यों खराब हुआ?"],
    ["ระยะตรวจจับประมาณ 12.5 กิโลเมตร", "เกียร์หนัก 4.1 กิโลกรัม", "ไม่พบความผิดปกติใดๆ", "ระบบนี้เปิดตัวครั้งแรกในปี 2014", "การทดสอบใช้เวลา 7 ชั่วโมง"],
]
DENSE = [["经过79小时试验，漂移为13.4%。", "报告写道：“泵完好。没有故障。”", "操作员认为界面过于复杂……但仍可使用。", "电源为什么失效？"], ["報告書には「変速機は正常。故障なし。」と書かれている。", "試験は9時間続いた。", "重量は5.5kgである。"]]


@pytest.mark.parametrize("units,joiner", [(u, j) for u in UNITS for j in (" ", "\n", "  ")] + [(u, "") for u in DENSE])
def test_sentences_of_languages(units, joiner):
    for seed in range(4):
        order = units[:]
        random.Random(seed).shuffle(order)
        text = joiner.join(order)
        at = sentences.starts(text)
        assert [text[a:b].strip() for a, b in zip(at, [*at[1:], len(text)])] == order


def test_headings_lists_and_wraps():
    text = "1.2 Power supply\n\nSec. 4 Trials\n\nThe mast\nheld. It\nwas new.\n\n1. first item. With two.\n2. second\n3. third\n\n• a\n• b\n\nOn.The next.\n \nEnd"
    at = sentences.starts(text)
    assert [text[a:b].strip() for a, b in zip(at, [*at[1:], len(text)])] == [
        "1.2 Power supply", "Sec. 4 Trials", "The mast\nheld.", "It\nwas new.", "1. first item. With two.", "2. second", "3. third", "• a", "• b", "On.", "The next.", "End"]


@pytest.mark.parametrize("text", [None, "", "  \n ", "\n\n"])
def test_nothing(text):
    assert sentences.starts(text) == []


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aB .!?\"“”()\n-1।。", max_size=200))
def test_units_cover_the_text(text):
    at = sentences.starts(text)
    assert at == sorted(set(at)) and all(not text[a].isspace() for a in at)
    assert not at or (text[:at[0]].strip() == "")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([" held.", " Dr.", " (a.", " b.)", " “No!", " so.”", " ¿Why", " then?", " " + "long " * 70 + "end."]), st.sampled_from(["", "\n"])), min_size=2, max_size=9))
def test_best_spans_equal_enumeration(parts):
    """The programme with running maxima finds the score that trying every set of boundaries finds."""
    import itertools

    r = sentences.places_of("It" + "".join(a + b for a, b in parts).strip() + " Next one.")
    if r is None or len(r.places) > 11:
        return
    weights = sentences.fit()
    score = lambda begins: sum(weights.of.get(f, 0.0) for i, j in zip(begins, [*begins[1:], len(r.places) - 1]) for f in sentences.features(r, i, j))
    best = max(score([0, *c]) for k in range(len(r.places) - 1) for c in itertools.combinations(range(1, len(r.places) - 1), k))
    assert abs(score(sentences.best_spans(r, weights)) - best) < 1e-6


def labelled():
    for units, joiner in [(u, j) for u in UNITS for j in (" ", "\n")] + [(u, "") for u in DENSE]:
        for seed in range(6):
            order = units[:]
            random.Random(seed).shuffle(order)
            gold, text = [], ""
            for u in order:
                text += joiner if text else ""
                gold.append(len(text))
                text += u
            yield text, gold


def test_length_and_balance_decide():
    """Without the terms that belong to both ends of a span, units change and errors appear, refitted or not."""
    import dataclasses

    def errors(weights):
        return sum(len(set(sentences.starts(text, weights)) ^ set(gold)) for text, gold in labelled())

    def held_out(weights):
        return sum(len(set(sentences.starts(text, weights)) ^ set(gold)) for text, gold in sentence_samples.paragraphs(300, 99))

    full = sentences.fit()
    kept = held_out(full)
    assert errors(full) == 0 and kept < 80
    assert errors(dataclasses.replace(full, joint=False)) > 50
    assert errors(sentences.fit(joint=False)) > 20 and held_out(sentences.fit(joint=False)) > 3 * kept
    without = {g: held_out(sentences.Weights({f: w for f, w in full.of.items() if not f.startswith(g)})) for g in ("length", "balance", "closing", "opening")}
    assert without["length"] >= kept and min(without["balance"], without["closing"], without["opening"]) > 3 * kept


@pytest.mark.parametrize("text", ["Sie kam am 12. Mai an. Zeit u.s. am. " * 3000, "(" * 100_000 + "a. B. " * 1000, "Dr. " * 30_000, "“A. B” c. " * 12_000, "- item one. two\n" * 8000, "x" * 100_000])
def test_long_texts_take_linear_time(text):
    import time

    sentences.fit()
    begin = time.time()
    half = sentences.starts(text[:len(text) // 2])
    middle = time.time()
    whole = sentences.starts(text)
    assert len(whole) >= len(half) and time.time() - middle < 4 * (middle - begin) + 1


def test_sentence_rows(spark):
    df = spark.createDataFrame([(1, "It held. We left.", 0), (1, "It held. We left.", 0), (2, None, 0), (3, "", 0)], "doc_id long, text string, unit_no int")
    assert sorted((r.doc_id, r.unit_no, r.start_pos, r.sentence) for r in sentences.sentences(df).collect()) == [(1, 0, 0, "It held."), (1, 0, 0, "It held."), (1, 1, 9, "We left."), (1, 1, 9, "We left.")]
    assert sentences.sentences(df.limit(0)).count() == 0


def pieces_hold(text, pieces, limit):
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (a, b), (c, d) in zip(pieces, pieces[1:]):
        assert a < c <= b < d
    assert all(0 < b - a <= limit for a, b in pieces)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(3, 260), min_size=1, max_size=60), st.integers(0, 3))
def test_ranges_make_whole_pieces(lengths, seed):
    rng = random.Random(seed)
    text = " ".join("A" + rng.choice("bc ") * (n - 2) + "." for n in lengths)
    whole = splitting.split_range(text, 0, 0, len(text), len(text), 100)
    pieces_hold(text, whole, 100)
    size, halo, out = 700, 2 * 100 + 2 * splitting.CONTEXT, []
    for k in range((len(text) - 1) // size + 1):
        o = max(0, k * size - halo)
        out += splitting.split_range(text[o:o + size + 2 * halo], o, k * size, min((k + 1) * size, len(text)), len(text), 100)
    pieces_hold(text, out, 100)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB .!?…ก।。\n12-", max_size=900), st.integers(0, 5))
def test_neighbours_see_the_same_borders(seed_text, k):
    """Whatever the text, pieces of ranges cover it without gap and stay within the limit."""
    text = (seed_text + " Am 3. Mai kam der Kran. ") * (2 + k) + "." * 300 + " " * 300 + seed_text
    size, halo, out = 700, 2 * 100 + 2 * splitting.CONTEXT, []
    for n in range((len(text) - 1) // size + 1):
        o = max(0, n * size - halo)
        out += splitting.split_range(text[o:n * size + size + halo], o, n * size, min((n + 1) * size, len(text)), len(text), 100)
    pieces_hold(text, out, 100)


def test_overlap_is_one_sentence():
    text = " ".join(f"Sentence number {i} is here." for i in range(60))
    made = splitting.split_range(text, 0, 0, len(text), len(text), 200)
    for (a, b), (c, _) in zip(made, made[1:]):
        assert c < b and text[c:b].strip().count(".") == 1 and text[b - 2:b].strip().endswith(".")


def test_texts_and_files(spark, tmp_path):
    long = " ".join(f"Satz {i} über Öl." for i in range(3000))
    df = spark.createDataFrame([(1, "r/0", "short", 1), (2, "r/1", long, 2), (3, "r/2", None, 3), (4, None, "x" * 2500, 4), (5, "r/3", "", 5), (2, "r/1", long, 2)], "row_id long, rid string, text string, total int")
    rows = splitting.split_texts(df, "row_id", "text", range_chars=4000, keep=("rid",)).collect()
    by = {}
    for r in rows:
        assert r.piece == (long if r.row_id == 2 else {1: "short", 4: "x" * 2500, 5: ""}[r.row_id])[r.start_pos:r.end_pos] and len(r.piece) <= 900
        by.setdefault(r.row_id, []).append(r)
    assert set(by) == {1, 2, 4, 5} and len(by[1]) == 1 and len(by[4]) == 3 and max(r.end_pos for r in by[2]) == len(long)
    assert splitting.split_texts(df.limit(0), "row_id", "text").count() == 0
    path = tmp_path / "giant.txt"
    path.write_text(long, encoding="utf8")
    (tmp_path / "empty.txt").write_text("")
    got = sorted((r.start_pos, r.end_pos, r.piece) for r in splitting.split_files(spark, [str(path), str(tmp_path / "empty.txt")], range_bytes=9001).collect())
    pieces_hold(long, [(a, b) for a, b, _ in got], 900)
    assert all(long[a:b] == t for a, b, t in got)
