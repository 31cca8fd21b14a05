import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from matrixloom.llm import leakage, sentences
from matrixloom.llm.sentences import spans


def cut(t):
    return [t[a:b] for a, b in spans(t)]


CASES = {
    "abbreviations": ["Dr. Xan saw Fig. 7 at 9 a.m. and left.", "Cells were lost, e.g. in B84.", "It held salt, dye, etc.", "The U.K. site sent none."],
    "numbers": ["The limit is .5 or 1.25 in v4.2.1.", "Release 2.0 is out.", "All ran at 61,636 r.p.m. for 3 min."],
    "files": ["See run_46.sorted.bam and lane_05.v2.csv now."],
    "initials": ["D. H. Jorkap kept the log.", "We met C. D. Jones."],
    "ellipsis": ["It took 5 s… which was fine.", "They were lost... then found.", "He waited..."],
    "tags": ["“Is it clean?” asked the operator.", "“It is clean.”", "We think so!", "The note said: “Few. Add more.” and moved on."],
    "brackets": ["(The well was read twice.)", "The mix (see Fig. 2.) stayed low."],
    "small": ["mt-encoded reads were few.", "p-values were kept.", "iPlate wells gave signal."],
    "german": ["Am 3. Tag, d. h. spät, kam Nr. 5 an.", "„Ist sie sauber?“, fragte die Schicht.", "Es dauerte 4 Min. Wartezeit!", "Die Phase S.", "Es war z. B. gut."],
    "spanish": ["—¿Está limpia? —preguntó el turno.", "Véase la núm. 9 (pág. 3).", "¡No borren a.h5!", "Dice: «No agitar»."],
    "french": ["« Est-elle propre ? » demanda l’équipe.", "La note dit : « Ne pas agiter. »", "M. Yor a relu env. 3 puits.", "Il vaut 19,1, c.-à-d. rien."],
    "russian": ["«Плата чистая?» — спросила смена.", "В 2031 г. прибор заменили.", "Фазы равны, и т. д.", "Виден сдвиг, т. е. разница."],
    "hindi": ["“क्या प्लेट साफ है?” रात की टीम ने पूछा।", "डॉ. Wex ने देखा।"],
    "arabic": ["سأل الفريق: «هل اللوح نظيف؟» ثم غادر.", "أعاد د. Tru قراءة 708 بئرا.", "لماذا ارتفع؟"],
}


@pytest.mark.parametrize("name", CASES)
def test_sentences_stay_whole_and_apart(name):
    assert cut(" ".join(CASES[name])) == CASES[name]
    assert cut("\n".join(" ".join(CASES[name]).split(" "))) == ["\n".join(x.split(" ")) for x in CASES[name]]


def test_scripts_without_spaces():
    zh = ["操作员问：“干净吗？”然后离开了。", "记录写道：“不要摇晃。”", "信号先降……随后回升。", "都很低(见表2。第6行)，可以忽略。"]
    assert cut("".join(zh)) == zh
    ja = ["「洗浄した。良い。」とだけ書かれている。", "理由は不明だ．", "他に変化はない。"]
    assert cut("".join(ja)) == ja
    assert cut("ไม่มีสิ่งใดเปลี่ยนแปลงอีก หลุมที่717อ่านค่าไม่ได้") == ["ไม่มีสิ่งใดเปลี่ยนแปลงอีก", "หลุมที่717อ่านค่าไม่ได้"]


def test_missing_space_after_the_mark():
    assert cut("It made up the library.The same holds. See x.y and U.K. now!Then we left.") == ["It made up the library.", "The same holds.", "See x.y and U.K. now!", "Then we left."]


def test_layout():
    t = "Title\r\n\r\n1. keep a\r\n2. do b. And c\r\n\t \r\n- x\n* y (z)\n\nA line\nwraps here. Next"
    assert cut(t) == ["Title", "1. keep a", "2. do b.", "And c", "- x", "* y (z)", "A line\nwraps here.", "Next"]


def test_degenerate_texts():
    assert cut("") == cut(" \n\t\r\n ") == []
    assert cut("...") == ["..."]
    assert cut('"unclosed one. Two (three. Four') == ['"unclosed one.', "Two (three.", "Four"]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aB. !?…\n\r\"“”„«»()[]。！？ก-*1", max_size=80))
def test_units_cover_the_text_in_order(t):
    at = 0
    for a, b in spans(t):
        assert at <= a < b and not t[at:a].strip() and not t[a].isspace() and not t[b - 1].isspace()
        at = b
    assert not t[at:].strip()


def test_long_texts_take_linear_time():
    import time

    for unit in ("(a) ", "A. ", "word ", '"x ', "ก b ", "[(“", ". "):
        start = time.perf_counter()
        spans(unit * (400_000 // len(unit)))
        assert time.perf_counter() - start < 20, unit


def test_sentences_of_tables(spark):
    rows = [(1, "One. Two.", "x"), (2, None, "y"), (3, "", "z"), (1, "One. Two.", "x"), (None, "A.", "n")]
    d = spark.createDataFrame(rows, "doc_id long, text string, char_start string")
    got = sorted(map(tuple, sentences.sentences(d).collect()), key=str)
    assert got == sorted([(1, 0, 4), (1, 5, 9), (1, 0, 4), (1, 5, 9), (None, 0, 2)], key=str)
    assert sentences.sentences(d.limit(0)).count() == 0


# leakage


def plain(s):
    return "".join(c for c in unicodedata.normalize("NFKC", s).lower() if unicodedata.category(c)[0] in "LN")


def brute(docs, items):
    out = set()
    for i, t, lang in items:
        n = 24 if lang in ("zh", "ja") else 60
        s = plain(t) if t else ""
        runs = {s[k : k + n] for k in range(len(s) - n + 1)}
        out |= {(d, i) for d, x in docs if x and any(r in plain(x) for r in runs)}
    return out


def test_leaks_against_brute_force(spark):
    rng = random.Random(3)
    words = ["Gene", "wells", "raise", "7", "１８", "ﬂow", "12.5", "β", "Ünder", "keeps", "µl", "图", "批次", "的", "سطر"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.randint(0, 60)), rng.choice(["en", "zh", None])) for i in range(12)] + [(90, None, "en"), (91, "", "zh"), (92, "7" * 80, "en")]
    docs = []
    for d in range(120):
        _, t, _ = rng.choice(items[:12])
        a = rng.randint(0, max(len(t) - 1, 0))
        part = t[a : a + rng.randint(20, 110)]
        if rng.random() < 0.5:
            part = part.upper().replace(" ", rng.choice([" ", "­", "\r\n", ""]))
        docs.append((d, text(rng.randint(0, 20)) + rng.choice(["", " "]) + part + text(rng.randint(0, 20))))
    docs += [(500, None), (501, ""), (502, "x" + "7" * 90), (503, "ab " * 400_000 + items[0][1] + " end")]
    dd = spark.createDataFrame([(d, t, "extra", 1) for d, t in docs], "doc_id long, text string, item_id string, hash int")
    ii = spark.createDataFrame(items + items[:2], "item_id long, item_text string, lang string")
    want = brute(docs, items)
    assert len(want) > 20
    assert {(r[0], r[1]) for r in leakage.leaks(dd, ii).collect()} == want
    old, leakage.MAP_BITS = leakage.MAP_BITS, 16  # a map of test hashes too small to tell many apart
    try:
        small = [x for x in docs if x[0] != 503]
        ds = spark.createDataFrame(small, "doc_id long, text string")
        assert {(r[0], r[1]) for r in leakage.leaks(ds, ii).collect()} == brute(small, items)
    finally:
        leakage.MAP_BITS = old


def test_long_texts_are_cut_without_loss():
    rng = random.Random(1)
    s = "".join(rng.choice("abcdef0123") for _ in range(9_000))
    w = leakage.Windows(60)
    whole = set(w.of([s], "\x01", None)[1].tolist())
    old, leakage.SEGMENT = leakage.SEGMENT, 500
    try:
        assert set(w.of([s], "\x01", None)[1].tolist()) == whole
    finally:
        leakage.SEGMENT = old


def test_every_run_holds_a_window():
    rng = random.Random(2)
    w = leakage.Windows(24)
    for _ in range(200):
        run = "".join(rng.choice("ab1") for _ in range(24))
        a, b = (x + run + y for x, y in ((("a" * rng.randint(0, 30)), "1b" * rng.randint(0, 9)), ("b1" * rng.randint(0, 20), "a" * rng.randint(0, 30))))
        assert set(w.of([a], "\x01", None)[1].tolist()) & set(w.of([b], "\x02", None)[1].tolist())


def test_no_items_or_documents(spark):
    d = spark.createDataFrame([(1, "text " * 40)], "doc_id long, text string")
    i = spark.createDataFrame([(1, "text " * 40, "en")], "item_id long, item_text string, lang string")
    assert leakage.leaks(d.limit(0), i).count() == leakage.leaks(d, i.limit(0)).count() == 0
    assert leakage.reparameterised(d.limit(0), i).count() == leakage.reparameterised(d, i.limit(0)).count() == 0
    assert leakage.leaks(d, i).count() == 1


def test_reparameterised_questions(spark):
    item = "In the Vaktrudol cohort, Tolnim stained 153 sections with Zermup-117 and found that Trux2 fell from 5.2 to 1.9 within 860 hours, whereas Fenbri nuclei kept 315 transcripts each."
    new = item.replace("Vaktrudol", "Pelmorkap").replace("153", "99").replace("Trux2", "Gene_0041").replace("860", "12")
    odd = item.replace("Trux2", "Gene_1", 1)
    d = spark.createDataFrame([(1, "Intro. " + new), (2, item), (3, "Nothing of it."), (4, None), (5, odd)], "doc_id long, text string")
    i = spark.createDataFrame([(7, item, "en"), (8, None, "en")], "item_id long, item_text string, lang string")
    got = {r["doc_id"]: r for r in leakage.reparameterised(d, i).collect()}
    assert set(got) == {1, 5} and got[1]["item_id"] == 7 and got[1]["changed"] == 4 and got[5]["changed"] == 1


def test_reparameterised_items_of_one_wording_and_scripts(spark):
    item = "In the Vaktrudol cohort, Tolnim stained 153 sections with Zermup-117 and found that Trux2 fell from 5.2 to 1.9 within 860 hours, whereas Fenbri nuclei kept 315 transcripts each."
    sister = item.replace("153", "400").replace("5.2", "1.9")  # the document turns 1.9 into two values
    new = item.replace("153", "99")
    twice = item.replace("153", "98") + " " + item.replace("153", "97")
    inside = " ".join(item.split()[8:24]).replace("5.2", "7.7")  # 16 words
    zh = "Kelfen流程从399个液滴中保留702个条码，去除17.7的Keljorrus碎片，其余归入707个Vakwimoth克隆。"
    ja = "ZibdragraコホートではUshnarbri班がPelwextru122で51枚の切片を染め、Gene_1461は31.28から25.907に下がった。"
    docs = [(1, new), (2, twice), (3, "It is so that sections with Xan-1 and " + inside), (4, zh.replace("399", "12")), (5, "前文。" + ja.replace("51枚", "9枚")), (6, zh), (1, new)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame([(7, item), (8, sister), (9, zh), (10, ja), (11, item.replace("153", "5")), (7, item)], "item_id long, item_text string")
    got = {(r["doc_id"], r["item_id"]): r for r in leakage.reparameterised(d, i).collect()}
    assert {p for p in got if p[0] in (1, 2)} == {(1, 7), (1, 11), (2, 7), (2, 11)}  # not 8, whose 1.9 is both 5.2 and 1.9
    assert {(3, 7), (3, 11)} <= set(got) and {p for p in got if p[0] > 3} == {(4, 9), (5, 10)}
    assert got[2, 7]["changed"] == got[1, 7]["changed"] == 1 and got[2, 7]["windows"] == 2 * got[1, 7]["windows"]
