"""Repair against texts garbled here: original, wrong page, any number of layers; and texts that are as they should be."""

import pytest

from mergestone.llm.garbling import repair
from mergestone.llm.mojibake import garbled, repair_texts

CLEAN = [
    "Plain ASCII, with 'quotes' & marks?", "Þórr & Ærø", "NÃO SEI, ATENÇÃO: SÃO e MÃE, ÂNGULO", "ÂGE, TÂCHE. À mon avis…", "½ × ¾ ≠ ⅜", "Żaglówka „Ćma”", "ﬁne ﬂow", "木を切る人", "Всё течёт, насос тоже",
    "Ïle de café à 3 €", "Kimse ölçmedi küçük bıçağı", "Сосед проверил ключ от сарая «ВСЁ» — 5 °C", "Κανείς δεν μέτρησε την ΑΞΊΑ", "我们测量了木头架子，因为漏水。", "私は交換しました：古いポンプ。", "Chеap pіlls with lооk-alike letters",
    "👩‍🌾🤷🏽 ❤️ ★ ♥", "&eacute;t&eacute; &amp; &nbsp; &#8217;", "!!!!!!!???", "É», CAFÉ” L’ÉTÉ… GARÇON’", "Größere Gehäuse, maßmaßmaß", "o’clock — rock’n’roll – “fine”", "word—word and word— word", "Å, Ä och Ö", "le cœur, l’œuf, œcuménique, fœtus, manœuvre, cœliaque", "12 m³, 5 km², 3±1", "El niño español añora la cabaña", "Même la fenêtre, bêtise, você crê, têm", "cm³, inch³", "«один клапан» о\xa0доме", "Потом нашёл СКИДКА и ПРОЦЕНТОВ, СССР, ЦСКА, ВНИМАНИЕ, ЦЕНТР, СПРАВКА, СПЕКТР без инструкции и всё заработало", "ДЕШЁВЫЕ ULTRA-BRIGHT, СКИДКА 95 ПРОЦЕНТОВ", "\xa0\xa0·\xa0\xa0 ١٢٣٤٥ e\u0301a\u0308", "", " \n ",
]
TEXTS = [
    "Nous avons mesuré l’étagère en chêne dès le début.", "Die Werkstatt schickte größere Gehäuse für später.", "Proszę wyłączyć półkę dębową – szybko.", "Сосед проверил ключ от сарая после мороза.",
    "Κανείς δεν μέτρησε τη δεύτερη λάμπα.", "It’s at 5 °C – “spare” £7 naïve", "也没有人用过木头架子，因为漏水。", "先に外すべきなのは古いポンプ、雨の前に。",
]


def sloppy(raw: bytes, page: str) -> str:
    out = []
    for b in raw:
        try:
            out.append(bytes([b]).decode(page))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@pytest.mark.parametrize("text", CLEAN)
def test_clean_texts_stay(text):
    r = repair(text)
    assert (r.text, r.found, r.lost, r.layers) == (text, False, False, 0)


@pytest.mark.parametrize("page", ["cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "cp437", "mac_roman"])
@pytest.mark.parametrize("text", TEXTS)
def test_utf8_read_as_a_code_page(text, page):
    bad = sloppy(text.encode(), page)
    r = repair(f"As it should be. {bad}")
    assert r.found
    assert r.text == f"As it should be. {text}"


@pytest.mark.parametrize("layers", [2, 3, 7, 10])
@pytest.mark.parametrize("text", TEXTS[:6])
def test_nested_layers(text, layers):
    bad = text
    for _ in range(layers):
        bad = sloppy(bad.encode(), "cp1252")
    r = repair(bad)
    assert r.found
    assert r.text == text


@pytest.mark.parametrize(
    "text,right",
    [(TEXTS[3], "cp1251"), (TEXTS[4], "cp1253"), (TEXTS[7], "euc_jp"), (TEXTS[6], "gbk"), (TEXTS[3], "koi8_r")],
)
def test_legacy_text_read_as_western(text, right):
    r = repair(sloppy(text.encode(right), "cp1252"))
    assert r.found
    assert r.text == text


def test_marks_inside_words():
    assert repair(sloppy("Todavía no revisé el caño ningún día más.".encode("mac_roman"), "cp1252")).text == "Todavía no revisé el caño ningún día más."
    assert repair("ca³± noc, pó³kê dêbow±").text == "całą noc, półkę dębową"


@pytest.mark.parametrize(
    "bad,text",
    [
        ("Komþum söktü çadýrýn ipini. Þimdi arýyorum.", "Komşum söktü çadırın ipini. Şimdi arıyorum."), ("Потом нашёл ключ îò сарая уже 3 дней", "Потом нашёл ключ от сарая уже 3 дней"),
        ("Η δεύτερη λάμπα με ôçí πρώτη φορά", "Η δεύτερη λάμπα με την πρώτη φορά"), ("tested the na•ve loop at 90 °C", "tested the naïve loop at 90 °C"), ("IÕd rather keep it for 95 Û,", "I’d rather keep it for 95 €,"),
        ("solar, §ã§Ü§Ú§Õ§Ü§Ñ 44", "solar, скидка 44"), ("ce cour莽on sans probl猫me", "ce courçon sans problème"), ("„ҐисўлҐ herbal, бЄЁ¤Є\xa0 58", "Дешёвые herbal, скидка 58"), ("SÅ‚uchajcie: Żona", "Słuchajcie: Żona"),
        ("Só é a ligação ˆ terra com a mão", "Só é a ligação à terra com a mão"), ("ningœn segœn", "ningún según"), ("Trzeba bêdzie wyjąć", "Trzeba będzie wyjąć"), ("łąka na koñcu, mierzy³ łańcuch", "łąka na końcu, mierzył łańcuch"),
        ("Потом нашёл ПДЙО мостпёс без инструкции", "Потом нашёл один мостпёс без инструкции"), ("Первого раза? нБУФЕТ вернул старый насос", "Первого раза? Мастер вернул старый насос"),
    ],
)
def test_single_words(bad, text):
    r = repair(bad)
    assert (r.text, r.found) == (text, True)


def test_one_cyrillic_page_as_another():
    text = "Сосед проверил ключ от сарая после мороза"
    assert repair(text.encode("koi8_r").decode("cp1251")).text == text


def test_utf8_read_as_gbk():
    text = "我们测量了木头架子，没有人用过"
    r = repair(text.encode().decode("gbk", "replace"))
    assert r.found


def test_lost_characters_are_found():
    for bad in ("na�ve", "naï¿½ve", "�"):
        r = repair(bad)
        assert r.found and r.lost


def test_character_references():
    assert repair("na&Atilde;&macr;ve for &acirc;‚&not;3").text == "naïve for €3"


def as_gbk(text):
    return text.encode().decode("gbk", "replace")


def test_parts_of_east_asian_runs():
    whole, good = "没有人用过木头", "这个很好"
    assert repair(good + "，" + as_gbk("我们测量木头")).text == good + "，我们测量木头"
    for bad, text in ((as_gbk(whole) + "。" + good, whole), (good + "。" + as_gbk(whole) + good, whole), (as_gbk(whole) + good, whole), (good + as_gbk(whole), whole)):
        r = repair(bad)
        assert r.found and r.lost and text[:5] in r.text and good in r.text, r
    r = repair("テスト。" + "説明書なしで、直してくれた".encode().decode("cp932", "replace") + "。よかった")
    assert r.found and "説明書なしで、直してく" in r.text and r.text.startswith("テスト。") and r.text.endswith("。よかった")
    assert repair("这个很好，" + as_gbk("Сосед проверил ключ")).text == "这个很好，Сосед проверил ключ"
    for clean in ("谢谢你们，今天天气不错，模板已经更新，模板模板模板", "先に外すべきなのは鍋鍋鍋、一度でできた。", "목이 마르다. 韓國 사람"):
        assert not repair(clean).found


def test_bytes_of_surrogate_halves_are_no_utf8():
    for clean in ("功。我Σ", "很好，娌№爛"):  # as bytes of a double-byte page, these hold \xed and a trail from \xa0 on
        r = repair(clean)
        assert (r.text, r.found) == (clean, False)
    half = "没有人用过木头".encode() + b"\xed\xa0\xbd\xed\xb8\x80" + "，因为漏水了".encode()
    r = repair("这个很好。" + half.decode("gbk", "replace"))
    assert r.found and r.lost and r.text.startswith("这个很好。没有人用过木头") and r.text.endswith("，因为漏水了")


def test_parts_taken_for_utf8_decode():
    from mergestone.llm.garbling import _UTF8_PART

    for lead in range(0xE2, 0xF0):
        for second in range(0x80, 0xC0):
            raw = bytes([lead, second, 0x80]) * 2
            assert bool(_UTF8_PART.fullmatch(raw)) == (raw.decode("utf-8", "ignore") != ""), raw


def test_frame_with_surrogate_halves(spark):
    df = spark.createDataFrame([(1, "功。我Σ"), (2, "naÃ¯ve"), (3, "很好，娌№爛")], "doc_id long, text string")
    assert [r.doc_id for r in garbled(df).collect()] == [2]
    assert sorted((r.doc_id, r.repaired) for r in repair_texts(df).collect()) == [(1, "功。我Σ"), (2, "naïve"), (3, "很好，娌№爛")]


def test_all_garbled_parts_of_a_line():
    bad = sloppy("Сосед".encode("cp1251"), "cp1252")
    line = " ".join(f"plain text number {i} then {bad}" for i in range(12))
    r = repair(line)
    assert r.text == line.replace(bad, "Сосед") and not r.lost


@pytest.mark.parametrize(
    "make",
    [
        lambda n: "é" * n + "&Atilde;", lambda n: "&Atilde;" * (n // 8), lambda n: "&" * n, lambda n: "ÿ" * n, lambda n: "我们测量" * (n // 4), lambda n: as_gbk("我们测量了木头架子") * (n // 14), lambda n: "Ã©" * (n // 2),
        lambda n: sloppy("Сосед проверил ключ ".encode("cp1251"), "cp1252") * (n // 20), lambda n: "Сосед проверил ключ ".encode("koi8_r").decode("cp1251") * (n // 20), lambda n: "â€ " * (n // 3), lambda n: "é" + " " * n + "é",
    ],
)
def test_long_texts_take_linear_time(make):
    import time

    def seconds(n):
        began = time.process_time()
        repair(make(n))
        return time.process_time() - began

    seconds(1_000)
    short, long = seconds(30_000), seconds(300_000)
    assert long < 30 * short + 0.5


def test_rates_by_page():
    from tests.llm.repair_rates import rates

    got = rates([(t, lang) for t, lang in zip(TEXTS, ("fr", "de", "pl", "ru", "el", "en", "zh", "ja"))])
    for (kind, page, _), (n, found, restored) in got.items():
        assert found >= 0.75 * n, (kind, page, n, found)
        if page not in ("gbk", "cp932"):
            assert restored >= 0.8 * n, (kind, page, n, restored)


def test_frame(spark):
    rows = [(1, "naÃ¯ve", "x"), (1, "naÃ¯ve", None), (2, None, "y"), (3, "", "z"), (None, "cafÃ©", "z"), (4, "plain", "z"), (5, "Ã©" * 50_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, repaired string")
    got = {(r.doc_id, r.repaired if len(r.repaired or "") < 10 else len(r.repaired), r.found) for r in repair_texts(df).collect()}
    assert got == {(1, "naïve", True), (2, None, False), (3, "", False), (None, "café", True), (4, "plain", False), (5, 50_000, True)}
    assert sorted(r.doc_id or 0 for r in garbled(df).collect()) == [0, 1, 1, 5]
    assert garbled(df.limit(0)).collect() == []
