import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lesewerk.llm import sentences as s

CASES = [
    ["Dann kam der Regen.", "„Schon wieder?“", "Nein!", "Es blieb ein Rest,\nund er ging."],
    ["„Das glaube ich nicht?!\", rief Lowara.", "›Schon wieder‹, murmelte Mihara, ›wie immer?‹", "Wirklich?"],
    ["Das war Plan B.", "Der Schlüssel hing.", "Um 7 kam Hr. Kabinau, um 8 kam T.F. Namarau."],
    ["In der Kiste lagen Garn, Knöpfe u. Ä.", "Gemeint war Saal 528.", "Gebaut 1944.", "Im 16. Jahrhundert galt der 13. Plan.", "Es waren genau 397.", "12 Boote lagen da."],
    ["Bis 14.1.2019 blieb es zu.", "Am 3. Mai ging er.", "Ludwig XIV. bezahlte.", "Er sah Dr. med. Kenorau, z. B. gestern, d. h. um 6.30 Uhr."],
    ["Danach galt der 13. Plan.", "K. Mamar zählte.", "Es ging an M. L. Fafalau u. P. M. Kabekau.", "P.M. Tirenik ging um 9 P.M. und kam.", "It was 9 P.M.", "Ηr. Abel und Ｄｒ. Bär gingen am １４. Mai."],
    ["Er wartete …", "Der Kasten … war fort.", "(Das wusste nur Hases.)", "Seza blieb."],
    ["On y vend du sel, etc.", "« Attends ! » cria Tamalo.", "« Je ne sais pas », dit Mme Telerik.", "Quelle nuit !", "M. D. Malin vécut vers 300 av. J.-C., dit-on."],
    ["The last train is the 9 p.m.", "Dr. H. Lodissen left at 6.30 p.m. and slept.", "“Stop?”", "\"Come back!\" cried Notara.", "It closed on October 3 (see p. 177).", "See www.a.example/b.c for e.g. more."],
    ["—Espera —dijo Seza.", "¡Qué frío!", "¿Por qué?", "El Sr. Tal y la Dra. R. Renor pagaron, p. ej. poco."],
    ["Г. Карвель искал письмо.", "«Стой!» — крикнул Дирен.", "Там соль и т. д.", "В 1941 г. здесь был мост, т. е. там."],
]
UNSPACED = [
    ["「それは知らない。」と夜番は答えた。", "寒い！", "隣の人は待った……誰も来ない。", "港まで1.31キロ、9歩ほどだ。"],
    ["“快回来！”守夜人说。", "旅客说：“我不知道。”", "那封信还在那里吗？", "「别走」，邻居低声说，然后走了。", "从这里到港口有3.82公里。"],
]
OTHERS = [
    ["कितनी ठंड है!", "“रुको!” माली ने कहा।", "रास्ता 6.94 किमी लंबा था।", "डॉ. माली ने 700 कदम गिने।"],
    ["د. الجار عد 540 خطوة، ثم وصف.", "أين الصندوق؟", "«توقف!» قال القارئ قرب الجسر.", "يا له من برد!"],
    ["ราคา 717 บาทแพงกว่าโคมไฟเก่า", "นักอ่านบอกว่าหายไป", "เดิน 63 ก้าวแล้วลืม"],
]


@pytest.mark.parametrize("units", CASES + OTHERS)
def test_spaced(units):
    assert s.split_units(" ".join(units)) == units
    assert s.split_units("\n\n".join(units) + "\n") == units


@pytest.mark.parametrize("units", UNSPACED)
def test_unspaced(units):
    assert s.split_units("".join(units)) == units


def test_stray_spaces():
    assert s.split_units("Das war Plan  B.  Der  13.  Plan galt am  3.  Mai. Garn u.  Ä.  Dann z.  B. er . Ende") == ["Das war Plan  B.", "Der  13.  Plan galt am  3.  Mai.", "Garn u.  Ä.", "Dann z.  B. er .", "Ende"]


def test_paragraphs_and_headings():
    text = "Kapitel 1\n \nEs war\neinmal.  Ende\n\n\n"
    assert s.split_units(text) == ["Kapitel 1", "Es war\neinmal.", "Ende"]
    assert s.unit_ends("Nr. 5 – Wer? Er!", heading=True) == [16]
    assert s.unit_ends(None) == s.unit_ends("") == s.unit_ends(" \n\n ") == []


def test_undisplayed_characters_and_missing_space():
    assert s.unit_ends("Ja.​ Nein.") == [4, 10]
    assert s.split_units("Da​s war D​r. Abel. Ja.") == ["Da​s war D​r. Abel.", "Ja."]
    assert s.split_units("Er ging vorbei.Fame blieb z.B. da.\"Halt!\" rief er.") == ["Er ging vorbei.", "Fame blieb z.B. da.", '"Halt!" rief er.']
    assert s.split_units("alles klein. auch hier! ja") == ["alles klein.", "auch hier!", "ja"]
    assert s.split_units("​") == ["​"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB1 .!?…\n\"“”„«»()'。」「。กข ​,г"), max_size=60))
def test_units_cover_the_text(text):
    ends = s.unit_ends(text)
    assert ends == sorted(set(ends)) and all(0 < e <= len(text) for e in ends)
    assert bool(ends) == bool(text.strip())
    at = 0
    for e in ends:
        assert text[at:e].strip() and not text[e - 1].isspace()
        at = e
    assert not text[at:].strip() or not s.IGNORABLE.sub("", text[at:]).strip()


def test_rows(spark):
    rows = [("teil", 1, False, "Eins. Zwei."), ("teil", 2, None, None), ("chunk", 1, True, "Nr. 1. Ja"), ("chunk", 2, None, ""), ("chunk", 3, False, "Wort. " * 30_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "item_kind string, item_id bigint, is_heading boolean, text string, end_pos int")
    got = s.sentence_units(df)
    assert sorted((r.item_kind, r.item_id, r.end_pos) for r in got.where("item_id < 3").collect()) == [("chunk", 1, 9), ("teil", 1, 5), ("teil", 1, 11)]
    assert got.where("item_id = 3").count() == 30_000
    full = s.sentence_units(df, with_text=True).where("item_kind = 'teil'").orderBy("unit_no").collect()
    assert [(r.start_pos, r.end_pos, r.unit) for r in full] == [(0, 5, "Eins."), (6, 11, "Zwei.")]
    assert s.sentence_units(df.limit(0)).count() == 0


def test_duplicate_rows_count_once(spark):
    from lesewerk.llm.common import items

    t = spark.createDataFrame([(1, "A. B.", 1), (1, "A. B.", 2), (None, "x", 1), (2, None, 1)], "teil_id bigint, text string, x int")
    c = spark.createDataFrame([(1, "C", None), (1, "C", True), (1, "C", False)], "chunk_id bigint, raw_text string, is_heading boolean")
    assert sorted((r.item_kind, r.item_id, r.is_heading) for r in items(t, c).collect()) == [("chunk", 1, True), ("teil", 1, False)]


@pytest.mark.parametrize("text, units", [
    ("Das ist alles, was ich mag. Dann ging er fort.", 2), ("Das ist Max. Er geht heim.", 2), ("I met Phil. He left early.", 2), ("He lives on Main St. He is nice.", 2),
    ("He lives in the U.S. He is happy.", 2), ("My ex. She moved on.", 2), ("Heute ist der 3. Er kam.", 2), ("We met on Oct. 5. Then it rained.", 2), ("Das sind 5 mm. Er maß nach.", 2),
    ("Dr. med. Huber kam. St. Martin ritt.", 2), ("Mag. Huber und Gen. Lee kamen.", 1), ("Smith et al. Results differ.", 1), ("Das U.S. Army Museum ist da.", 1), ("Franz J. Strauß kam.", 1),
    ("max. 5 Personen. Max. 3 Tage.", 2), ("Am 3. Mai kam er.", 1), ("Er kam im Okt. 2020 an.", 1),
])
def test_ordinary_words_and_starters(text, units):
    assert len(s.split_units(text)) == units
