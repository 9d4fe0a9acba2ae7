import pytest

from folioforge.llm import encoding_repair as er

GOOD = [
    "Le garçon a mangé très tôt près de l’hôtel – déjà vu…",
    "Während die Größe überall auffällt",
    "ATENÇÃO: SÃO 77 RAZÕES para a estação",
    "That’s €88 – naïve, perhaps. Size Ø 81 ± 2 µm. It’s priced from £83.",
    "После ремонта старый дом выглядит совсем иначе.",
    "ПОДПИШИТЕСЬ НА РАССЫЛКУ, ОНА ВЫХОДИТ РАЗ В ДВЕ НЕДЕЛИ.",
    "¿Dónde está? «Ningún vecino» © 2022 · À lire › Übersicht №5",
    "plain ASCII only",
    "=?UTF-8?Q?caf=C3=A9?= filename*=UTF-8''caf%C3%A9.html",
]


@pytest.mark.parametrize("text", GOOD)
def test_right_text_is_no_case(text):
    assert er.repair_field(text) == (text, False)


@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp850"])
@pytest.mark.parametrize("text", ["Während die Größe überall auffällt", "Aujourd’hui déjà près de l’hôtel", "¿Dónde está la estación?"])
def test_utf8_read_wrongly_comes_back(text, wrong):
    there, back = er._tolerant(wrong)
    damaged = "".join(back[b] for b in text.encode("utf-8"))
    fixed, bad = er.repair_field(damaged)
    assert bad and fixed == text


def test_twice_damaged_and_escaped():
    twice = "Größe überall".encode().decode("latin-1").encode().decode("latin-1")
    assert er.repair_field(twice) == ("Größe überall", True)
    assert er.repair_field("<p>h&#xc3;&#xa4;ufig</p>") == ("<p>häufig</p>", True)


def test_cyrillic_confusion_and_lost_characters():
    text = "Каждый день старый дом видят около гостей"
    fixed, bad = er.repair_field(text.encode("koi8-r").decode("cp1251"))
    assert bad and fixed == text
    assert er.repair_field("afici�n del estadio")[1]
    assert er.repair_field("&#150; dash")[1]


def test_long_text_and_nothing():
    long = "plain words " * 20000 + "kÃ¼ndbar"
    fixed, bad = er.repair_field(long)
    assert bad and fixed.endswith("kündbar")
    assert er.repair_field(None) == (None, False) and er.repair_field("") == ("", False)


def test_find_damage(spark):
    rows = [
        (1, "<p>GrÃ¶ÃŸe</p>", {"X-Title": "fine"}, "extra"),
        (1, "<p>GrÃ¶ÃŸe</p>", {"X-Title": "fine"}, "extra"),
        (2, None, {"x-section": "QuiÃ©nes somos"}, None),
        (3, "<p>fine</p>", None, "x"),
        (4, "", {}, "x"),
    ]
    df = spark.createDataFrame(rows, "page_id long, html string, headers map<string,string>, field string")
    assert sorted(map(tuple, er.find_damage(df).collect())) == [(1, "html"), (2, "headers")]
    assert er.find_damage(df.limit(0)).count() == 0
    restored = {(r["page_id"], r["field"]): r for r in er.find_damage(df, with_text=True).collect()}
    assert restored[1, "html"]["restored"] == "<p>Größe</p>" and restored[1, "html"]["restored_headers"] is None
    assert restored[2, "headers"]["restored_headers"] == {"x-section": "Quiénes somos"} and restored[2, "headers"]["restored"] is None


def test_markup_and_references_outside_the_damage_stay():
    text = "<p>1 &lt; 2 &amp; 3 &copy;</p><p title='a &gt; b'>cafÃ© &amp; thÃ©</p>&nbsp;"
    assert er.repair_field(text) == (text.replace("cafÃ©", "café").replace("thÃ©", "thé"), True)
    assert er.repair_field("a &lt; b &#150; c") == ("a &lt; b – c", True)
    assert er.repair_field("x &Atilde;&copy; y &lt;")[0].endswith(" y &lt;")


def test_damage_behind_long_runs_and_several_times():
    good = "Größe für Übermut, naïve café – “déjà vu”"
    bad = good
    for _ in range(5):
        bad = bad.encode("utf-8").decode("latin-1")
    assert er.repair(bad) == (good, True)
    run = "Übermäßig " * 90  # one run of right words, longer than a piece
    assert er.repair(run + "kÃ¼ndbar") == (run + "kündbar", True)
    assert er.repair("ü" * 900 + "kÃ¼ndbar")[1]


def test_weak_evidence_adds_up_over_the_field():
    gains = er._together(["\u00c3\u00a9", "\u00c3\u00bc"] * 3)
    assert gains == ["é", "ü"] * 3 and er._together(["é", "ü"]) is None


@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "mac_roman"])
def test_whole_pages_come_back_exactly(wrong):
    there, back = er._tolerant(wrong)
    page = "<h1>Über uns</h1><p>Le garçon a mangé près de l’hôtel &amp; déjà vu &lt;b&gt;</p><p>Während die Größe überall auffällt</p>"
    bad = "".join(back[b] for b in page.encode("utf-8"))
    assert er.repair_field(bad) == (page, True)
