import collections

import pytest

from lesewerk.llm import spam as s

PROSE = {
    "de": "Es war einmal ein Mann, der in der Stadt wohnte und nicht wusste, wie er zu dem Haus kam. Dann ging er mit dem Hund an den Fluss. Im Winter war es kalt. Der alte Lehrer las {} aus dem Buch, und alle Kinder hörten ihm zu.",
    "en": "There was a man who lived in the town and did not know how he had come to the house. Then he went with the dog to the river. In winter it was cold. The old teacher read {} from the book, and all the children were listening.",
}
STUFFED = {
    "list": "hörbuch günstig, hörbuch kaufen, günstig hörbuch kaufen, hörbuch günstig online, hörbuch kaufen online, hörbuch günstig kaufen",
    "lines": "\n".join(f"hörbuch günstig in {t}" for t in "Aachen Bonn Celle Duisburg Essen Fulda Gera Halle".split()),
    "links": '<a href="http://x.example/1">hörbuch</a> <a href="http://x.example/2">mp3 kaufen</a> <a href="http://y.example/3">sprecher</a>',
    "addresses": "\n".join(f"https://shop{i}.example/kat/{i}" for i in range(8)),
    "hidden": "\n".join(f"www[.]shop{i}[.]example" for i in range(8)),
    "tags": "hörbuch kaufen ★★★★☆ (244) 62,49 € +++ mp3 hörbuch Art.-Nr. 5533 21,95 € +++ hörbuch kaufen 8,99 € +++ hörspiel gratis 9,99 €",
    "hash": "#hoerbuch_kaufen #hoerbuch_gratis #mp3 #hoerbuch_neu #hoerbuch_top #stimme_klonen #hoerbuch_billig #mp3_kaufen",
    "dressed": "Wo hörbuch günstig? hörbuch günstig hier! Mehr stimme klonen mit hörbuch günstig, weniger Kosten mit stimme klonen. Wer hörbuch günstig sagt, meint hörbuch günstig. Hörbuch günstig und stimme klonen: mit hörbuch günstig wird stimme klonen neu.",
    "strewn": "In der hörbuch günstig Kiste lagen stimme klonen Garn, hörbuch günstig Nadeln und stimme klonen Knöpfe. Er hörbuch günstig ging stimme klonen an den hörbuch günstig Fluss und stimme klonen kam nicht hörbuch günstig wieder.",
}
FAIR = {
    "contents": "Inhalt\n" + "\n".join(f"{i}. Kapitel {i} ........ {i * 9}" for i in range(1, 15)),
    "tracks": "\n".join(f"{i:02}  Der Hof von Aach  {i}:4{i % 10}" for i in range(1, 15)),
    "cast": "\n".join(f"{a}: {b} Meier" for a, b in zip("Anna Bert Carl Dora Emil Frieda".split(), "Kurt Lisa Max Nora Otto Paula".split())),
    "pronounced": "\n".join(f"{w} → ab-{w[:3].upper()}-cd" for w in "Nordau Westerau Ostheim Südende Mittelau".split()),
    "refrain": "\n".join(["Und der Regen fiel auf das alte Dach,", f"da war der {w} noch lange wach." ][k] for w in "Vater Bruder Nachbar Lehrer".split() for k in (0, 1)),
    "sources": PROSE["de"].format("laut") + "\n\nQuellen\n[1] Ein Buch. https://a.example/1\nTags: Buch, Lehrer",
    "menu": "Startseite | Hörbücher | Sprecher | Kontakt\n\n" + PROSE["de"].format("leise"),
}


def pages(spark):
    names = "Anna Bert Carl Dora Emil Frieda Gustav Hanna Ida Jakob Karla Ludwig Marta Nils Olga Peter Rosa Stefan Tilda Uwe".split()
    rows = [(i, PROSE[lang].format(n + " " + m), None) for i, (lang, n, m) in enumerate((lang, n, m) for lang in PROSE for n in names for m in names[:8])]  # most pages are fair
    rows += [(1000 + i, t, None) for i, t in enumerate(STUFFED.values())] + [(2000 + i, t, None) for i, t in enumerate(FAIR.values())]
    rows += [(3000, None, None), (3001, "", None), (3002, " \n\t ", None), (3003, "  ", None), (3004, "Wort", None), (1000, list(STUFFED.values())[0], None), (None, "x", None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, language string")


def test_kinds(spark):
    got = {r.doc_id for r in s.stuffed_pages(pages(spark)).collect()}
    missed = [k for i, k in enumerate(STUFFED) if 1000 + i not in got]
    wrong = [k for i, k in enumerate(FAIR) if 2000 + i in got]
    assert not missed and not wrong
    assert all(1000 <= i < 2000 for i in got)


def test_each_document_once_and_none(spark):
    df = pages(spark)
    assert s.stuffed_pages(df).groupBy("doc_id").count().where("count > 1").count() == 0
    assert s.stuffed_pages(df.limit(0)).count() == 0
    assert s.stuffed_pages(spark.createDataFrame([(1, "kaufen " * 40_000)], "doc_id bigint, text string")).count() == 1


def test_language_with_many_stuffed_pages(spark):
    """Neither stuffed pages nor copies of one move a language's limits so far that they pass for its usual texts."""
    goods = [f"{a}{b}" for a in "Garten Küchen Fahrrad Schuh Lampen Bett".split() for b in "zange brett kette riemen schirm gestell".split()]
    dressed = lambda g: f"Wo {g} billig? {g} billig hier! Mehr {g} billig mit {g} Rabatt, weniger Kosten mit {g} Rabatt. Wer {g} billig sagt, meint {g} billig. Und {g} Rabatt: mit {g} billig wird {g} Rabatt neu."
    fair = [PROSE["de"].format(f"{g} und {h}") for g in goods for h in goods[:3]]
    many = [dressed(g) for g in goods]
    for stuffed in (many + [many[0].replace("neu", "gut")] * (len(fair) * 3 // 7 - len(many)), many * 4):  # 30 % of the rows, more than half of them
        df = spark.createDataFrame(list(enumerate(fair + stuffed)), "doc_id bigint, text string")
        assert {r.doc_id for r in s.stuffed_pages(df).collect()} == set(range(len(fair), len(fair + stuffed)))
    df = spark.createDataFrame(list(enumerate(fair[:20] + many)), "doc_id bigint, text string")  # mostly stuffed, all distinct
    assert {r.doc_id for r in s.stuffed_pages(df).collect()} == set(range(20, 20 + len(many)))


def test_copies_that_end_like_sentences(spark):
    keywords = {
        "lines": "Hörbuch günstig kaufen!\n" * 500,
        "line": "Hörbuch günstig kaufen. " * 500,
        "turns": "Hörbuch günstig kaufen! Stimme klonen lassen! MP3 gratis laden! " * 6,
        "beside prose": "Der Mann ging in die Stadt und kam nicht mehr zu dem Haus. " + "Hörbuch günstig kaufen. " * 8,
        "en": "Cheap audiobook download!\n" * 20,
        "zh": "有声书便宜购买！" * 40,
    }
    fair = {
        "refrain": FAIR["refrain"] + "\n" + "Und der Regen fiel auf das alte Dach.\n" * 6,
        "called": "Kling, Glöckchen, kling!\n".join(PROSE["de"].format(n) + "\n" for n in "Anna Bert Carl Dora".split()),
        "chapters": "\n".join(f"Kapitel {i}. Der Weg nach Haus." for i in range(1, 12)),
        "numbers": "\n".join(f"Kapitel {i}." for i in range(1, 12)),
        "twice": "Halle Saale Bahnhof Süd Eingang Ost. " * 2,
    }
    df = spark.createDataFrame([(i, PROSE["de"].format(i)) for i in range(60)] + [(100 + i, t) for i, t in enumerate(keywords.values())] + [(200 + i, t) for i, t in enumerate(fair.values())], "doc_id bigint, text string")
    got = {r.doc_id for r in s.stuffed_pages(df).collect()}
    assert got == {100 + i for i in range(len(keywords))}


def test_entries_with_many_function_words():
    """Lines of a page with many recurring words are asked for entries, whatever their share of function words."""
    lines = s.measure("\n".join(f"{i}. 我的了，{c}在的" for i, c in enumerate("山水火木金土日月星云", 1)))[3]
    words = s.measure("\n".join(f"{i:02} Der Hof und der Hof {n} {i}:4{i}" for i, n in enumerate("Aach Bonn Celle Essen Fulda Gera".split(), 1)))[3]
    assert all(x[2] > s.MOST_LOW and x[9] for x in lines + words)


@pytest.mark.parametrize("gap", ["\u00a0", "\t", "\n", "\u2003", " "])
@pytest.mark.parametrize("point", ["punkt", "dot", "point", "punto", "."])
def test_addresses_with_any_white_space(gap, point):
    assert [x[1] for x in s.measure(f"shop{gap}{point}{gap}de")[3]] == [1.0]


def test_measure():
    language, pairs, often, lines = s.measure(PROSE["de"].format("laut"))
    assert language == "de" and pairs == 0 and len(lines) == 1 and lines[0][2] > 0.3
    assert s.measure(STUFFED["addresses"])[3][0][1] == 1.0
    assert s.measure("")[3] == [] and s.measure("从这里到港口，我不知道。")[0] == "zh" and s.measure("これは本です。")[0] == "ja" and s.measure("นักอ่านบอกว่าหายไป")[0] == "th"


def test_labelled_sample(spark, sf_dir):
    """Held-out agreement with the labels, some of which are wrong by the data's own word."""
    from lesewerk.llm.queries import p8_found

    d = sf_dir.replace("sf0.001", "sf0.1")
    found = {r.doc_id for r in p8_found(spark, d).collect()}
    votes = collections.defaultdict(list)
    for r in spark.read.parquet(f"{d}/page_labels.parquet").collect():
        votes[r.doc_id].append(r.label)
    sure = {i: "spam" in v for i, v in votes.items() if "unsure" not in v and len(set(v)) == 1}
    hit = sum(i in found for i, y in sure.items() if y)
    false = sum(i in found for i, y in sure.items() if not y)
    assert hit >= 0.75 * sum(sure.values()) and false <= 0.01 * len(sure)


@pytest.mark.parametrize("kind", sorted(FAIR))
def test_fair_pages_have_no_function_word_trouble(kind):
    assert s.measure(FAIR[kind])[0] in ("de", "other")
