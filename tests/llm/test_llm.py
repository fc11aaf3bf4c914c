"""Small cases of every text operator: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns; brute force where it fits."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from kilohana.llm import langid, leaks, lookalike, mainbody, packing, reading, repeats, scans, segment, split

T0 = dt.datetime(2020, 1, 1)
SENT = "sentenceid long, sourceid long, hawaiiantext string, created timestamp_ntz"
DOC = "doc_id long, text string, lang string, medium string, title string"


def sents(spark, rows):
    return spark.createDataFrame([(i, s, t, c) for i, s, t, c in rows], SENT)


def docs(spark, rows):
    return spark.createDataFrame(rows, DOC)


# 1. sentences

CASES = [
    ("Ua hele. He hale.", [8]),
    ("Ua hele ʻo Dr. Kalani. He hale.", [22]),
    ("Iā M. E. Kamuhaē. Ua hele", [17]),
    ("i ka hola 3:15 a.m. nō. Ua hele", [23]),
    ("he 9.70 kapuaʻi. Ua", [16]),
    ("ma ka helu No. 48. 227 mau ala", [18]),
    ("“He hale! He wai?” wahi a Kalani. Ua", [9, 33]),
    ("“He hale!” “He wai.” Ua", [10, 20]),
    ("Ua hele… e holo ana. He", [20]),
    ("Ua hele ma kai.example/la.html. Ua", [31]),
    ("me ka hui Kahenulo & Co. o Wāmaʻa. He", [34]),
    ("Ua hele.Ua noho.", [8]),
    ("Ke poʻo\nUa hele", [7]),
    ("父は本を読みました。「売りました。」と父は言いました。母", [10, 27]),
    ("「他找到了信。」父親這樣說。昨天", [14]),
    (None, []),
    ("", []),
    ("   ", []),
    ("Ua hele (!) ka hale. He", [20]),
]


@pytest.mark.parametrize("text,ends", CASES)
def test_ends(text, ends):
    assert segment.Segmenter().ends(text) == ends


def test_units_cover_the_text():
    seg = segment.Segmenter()
    t = "“Ua hele! He hale?” wahi a X. Ke poʻo\n\nAia. " * 50
    for a, b, u in seg.units(t):
        assert t[a - 1 : b] == u


def test_p1_repeated_rows_count_once(spark):
    s = sents(spark, [(1, 1, "A. Ua hele. He hale.", T0), (1, 1, "Ua hele. He hale.", T0 + dt.timedelta(1)), (2, 1, None, None)])
    d = docs(spark, [(1, "Ua hele. He wai.", None, "typed", None), (2, None, None, "typed", None), (3, "Ua. He", None, "scan", None)])
    assert sorted(map(tuple, segment.found(d, s).collect())) == [("documents", 1, 8), ("sentences", 1, 8)]
    assert segment.found(d.limit(0), s.limit(0)).count() == 0


# 2. scans

PAGE = "KA HALE O KALANI\nUa hele ke keiki i ka hale a he mā-\n[12]\n\nKA HALE 0 KALANI\nkaukau ka hale.\nUa no1o ka hale.\n[13]"


def test_roles():
    assert scans.roles(PAGE, "Ka hale o Kalani") == ["header", "text", "pageno", "blank", "header", "text", "text", "pageno"]


def test_table_numbers_are_no_page_numbers():
    t = "Ua hele.\n745\n1862\n1542\n63\nHe hale.\n[12]\nMEI 1902\nAia ka hale."
    assert scans.roles(t, None)[1:5] == ["number"] * 4


def test_p2(spark):
    d = docs(spark, [(1, PAGE, "haw", "scan", "Ka hale o Kalani"), (2, None, None, "scan", None), (3, "", None, "scan", None)] + [(k, "ke keiki i ka hale mākaukau hele. " * 5, "haw", "typed", None) for k in range(10, 60)] + [(70, "Ua hcle ke keiki.", "haw", "scan", "X")])
    got = {tuple(r) for r in scans.found(d).collect()}
    assert {(1, 1, "header"), (1, 2, "hyphen"), (1, 3, "pageno"), (1, 5, "header"), (1, 7, "glyph"), (1, 8, "pageno"), (70, 1, "glyph")} <= got
    text = {r["doc_id"]: r["text"] for r in scans.paragraphs(d).collect()}
    assert "mākaukau ka hale." in text[1] and "KALANI" not in text[1] and "[12]" not in text[1]
    assert text[70].startswith("Ua hele") and text[2] is None
    assert scans.found(d.limit(0)).count() == 0


# 3. repeated lines


def test_p3(spark):
    src = spark.createDataFrame([(i, "g" if i < 20 else None, T0) for i in range(30)], "sourceid long, groupname string, created timestamp_ntz")
    rows = [(i, i, f"[Share this PAGE {i}]" if i % 3 == 0 else f"unique {'abcdefghij'[i % 10]}{'klm'[i // 10]}", T0) for i in range(30)]
    rows += [(100 + i, 1, "1234 ...", T0) for i in range(10)] + [(200, 1, None, None)]
    s = sents(spark, rows)
    got = {r[0] for r in repeats.found(s, src).collect()}
    assert got == {i for i in range(20) if i % 3 == 0}
    c = {r["sourceid"]: r["n_removed"] for r in repeats.cleaned(s, src).collect()}
    assert c[0] == 1 and c[1] == 0
    assert repeats.found(s.limit(0), src).count() == 0


# 4. look-alikes


def test_p4_brute_force(spark):
    base = ["Ua hele ʻo Kalani i ka hale", "He nā lā", "ua hele ʻo Kalani i ka hale", "He na la"]
    odd = [base[0].replace("ʻ", "'"), base[0].replace(" ", " ", 1), base[0].replace("a", "а", 1), "".join(chr(ord(c) + 0xFEE0) if c in "hle" else c for c in base[0]), base[1].replace("ā", "ā", 1), base[1][:3] + "​" + base[1][3:]]
    texts = base + odd + base[:1]
    s = sents(spark, [(i, 1, t, T0) for i, t in enumerate(texts)] + [(0, 1, texts[0], T0), (99, 1, None, None)])
    cls = [0, 1, 2, 3, 0, 0, 0, 0, 1, 1, 0]
    want = {(a, b) for b in range(len(texts)) for a in range(b) if cls[a] == cls[b] and texts[a] != texts[b]}
    assert {tuple(r) for r in lookalike.found(s).collect()} == want
    one = {r["sentenceid"]: (r["hawaiiantext"], r["simplified"]) for r in lookalike.one_text(s).collect()}
    assert all(one[i][0] == base[cls[i]] for i in range(len(texts))) and one[1][1] == "He na la"


# 5. languages


@pytest.fixture(scope="module")
def model():
    return langid.fit([])


@pytest.mark.parametrize("lang,text", [("haw", "Ua hele ke keiki i ka hale nui"), ("en", "The children of the village went to the house"), ("ja", "父は本を読みました。"), ("zh", "昨天老師找到了島上的故事。"), ("mi", "Kei te kōrero te tamaiti ki te whare"), ("sm", "Sa nofo le tama i le fale o le aliʻi"), ("pt", "O menino não deu a casa para a escola")])
def test_seed_model(model, lang, text):
    assert model.classify(langid.Grams(), [langid.segment_words(text)])[0][0] == lang


def test_p5_edges(spark, model):
    d = docs(spark, [(1, "Ua hele ke keiki i ka hale nui.\n\nThe children of the village went to the house.", " ", "typed", None), (2, None, "en", "typed", None), (3, "12 34", None, "typed", None), (4, "The men of the house were in the garden.", "English", "oral", None)])
    s = sents(spark, [(1, 1, "The water of the river was cold and dark.", T0), (2, 1, "the", T0), (3, 1, None, None)])
    got = {tuple(r) for r in langid.found(d, s, model).collect()}
    assert ("documents", 1, 2, "en") in got or ("documents", 1, 1, "haw") in got
    assert ("sentences", 1, 0, "en") in got and not any(r[1] in (2, 3) for r in got) and ("documents", 4, 0, "en") not in got


# 6. splitting


@pytest.mark.parametrize("text", ["a" * 5000, "ʻ" * 3000, "Ua hele. " * 900, "ka\n\n" * 2000, "", "x", "漢" * 2500 + " b" * 900])
def test_pieces_round_trip(text):
    got = split.pieces(text, 1000, 100)
    assert "".join(p.encode()[ov:].decode() for _, ov, p in got) == text
    assert all(len(p.encode()) <= 1000 and ov <= 100 for _, ov, p in got)
    assert all(ov > 96 for _, ov, _ in got[1:])
    assert split.pieces(None) == []


def test_piece_limits_random():
    rnd = random.Random(1)
    for _ in range(60):
        t = "".join(rnd.choice(["a", "ʻ", " ", "\n", ". ", "漢", "\n\n"]) for _ in range(rnd.randrange(4000)))
        got = split.pieces(t, 300, 50)
        assert "".join(p.encode()[ov:].decode() for _, ov, p in got) == t and all(len(p.encode()) <= 300 for *_, p in got)


# 7. main body

HTML = '<html><head><title>Ka hale o Hilo - site</title></head><body><div class="menu row">Home</div><div class="story a">Ka hale o Hilo</div><div class="story b">Ua hele ke keiki i ka hale nui, a ua noho i laila.</div><div class="rail x">Related</div><div class="rail y">Ka wai o Kona</div><div class="bottom x">Back to top</div></body></html>'
TEXT = "Home\nKa hale o Hilo\n\nNa Kalani Hale\nUa hele ke keiki i ka hale nui, a ua noho i laila.\nRelated\nKa wai o Kona\nBack to top"


def test_main_lines():
    assert mainbody.main_lines(HTML, TEXT) == [2, 5]
    assert mainbody.main_lines(None, TEXT) == [2, 5]
    assert mainbody.main_lines(None, None) == [] and mainbody.main_lines("<p", "") == []
    assert len(mainbody.main_lines(None, "He hale nui kēia o ka ʻāina.\n" * 3000)) >= 2999


def test_density_threshold_decides():
    page = mainbody.Page(HTML)
    sel, every = page.selected(), page.selected(path=0.0)
    text = [b for (b, _, _), k in zip(page.blocks, sel) if k]
    assert text == ["Ka hale o Hilo", "Ua hele ke keiki i ka hale nui, a ua noho i laila."] and sum(every) > sum(sel)
    para = "Ua hele ke keiki i ka hale nui, a ua noho i laila me nā kupuna o ke kula. "
    flat = mainbody.Page.of_lines(["Home", "About", "Mele", para * 3, "Ka wai", para * 3, "Leka", "Kopi", "Hui"])
    assert flat.flat() and flat.selected() == [False] * 3 + [True] * 3 + [False] * 3 and all(flat.selected(flat=0.0))
    assert mainbody.best_run([]) == (0, 0) and mainbody.best_run([-1.0, 2.0, -1.0, 2.0, -3.0]) == (1, 4)


# 8. packing


def test_packing(spark):
    rnd = random.Random(3)
    d = spark.createDataFrame([(i, rnd.choice([10, 100, 300, 700, 900, 1000, 2500, 0]), 0) for i in range(800)] + [(None, 5, 5)], "id long, n_tokens int, n_loss int").withColumn("n_loss", F.col("n_tokens"))
    p = packing.cut_items(d.where("id IS NOT NULL"), "id", 1000)
    out = packing.pack(p, "id", 1000, 8, 1000, per_shard=300)
    assert out.count() == p.count()
    g = out.groupBy("container").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()
    assert all(r["t"] <= 1000 and r["n"] <= 8 for r in g)
    assert packing.pack(p.limit(0), "id").count() == 0


def test_packing_cuts_only_above_the_capacity(spark):
    rows = [(1, 2045, 2045), (2, 2048, 2048), (3, 2049, 2040), (4, 0, 0), (5, 5000, 4990)]
    got = {(r["id"], r["piece_no"]): (r["n_tokens"], r["n_loss"]) for r in packing.cut_items(spark.createDataFrame(rows, "id long, n_tokens int, n_loss int"), "id", 2048, 2040).collect()}
    assert got == {(1, 1): (2045, 2040), (2, 1): (2048, 2040), (3, 1): (2048, 2039), (3, 2): (1, 1), (4, 1): (0, 0), (5, 1): (2048, 2038), (5, 2): (2048, 2040), (5, 3): (904, 904)}


def test_packing_loss_marks_limits_and_shards(spark):
    assert packing.prompt_parts("KA HALE\n\nUa hele.") == ["KA HALE\n"] and packing.prompt_parts("Ua hele.\nUa noho.") == [] and packing.prompt_parts("KA HALE") == []
    assert packing.prompt_parts("[00:00:01] ua hele [00:01:09] ua noho") == ["[00:00:01]", "[00:01:09]"]
    d = docs(spark, [(i, "KA HALE O KALANI\n\n" + "Ua hele ke keiki i ka hale nui. " * (i % 60 + 1), None, "typed", None) for i in range(600)] + [(1000, None, None, "typed", None), (1001, "", None, "typed", None)])
    out = packing.documents_packed(d, 512, 4, 500).cache()
    ids = out.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t"))
    assert ids.count() == 601 and ids.where("t <= 512 AND n > 1").count() == 0
    g = out.groupBy("container").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("s"), F.sum("n_loss").alias("l"))
    assert g.where("t > 512 OR s > 4 OR l > 500").count() == 0
    r = packing.report(out, 512, 4, 500).first()
    assert r["filled"] > 0.95 and r["pieces"] == out.count()


# 9. leaks


def test_p9(spark):
    words = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(80)]
    items = spark.createDataFrame([(1, "x", "Choose", " ".join(words)), (1, "x", "Choose", " ".join(words)), (2, "x", "Choose", None), (3, "x", "p", "short text of six words here")], "item_id long, suite string, prompt string, passage string")
    w = words[20:44]
    changed = w[:8] + ["zzz"] + w[9:]
    d = docs(spark, [(1, "ua " + " ".join(w).upper() + " hele", None, "typed", None), (2, "x " + ",\n".join(changed), None, "typed", None), (3, " ".join(words[:12]), None, "typed", None), (4, None, None, "typed", None), (5, "a short text of six words here b", None, "typed", None)])
    assert {tuple(r) for r in leaks.found(d, items).collect()} == {(1, 1), (2, 1), (5, 3)}
    assert leaks.found(d, items.limit(0)).count() == 0 and leaks.found(d.limit(0), items).count() == 0


# 10. reading grade


def test_consensus_and_grades():
    assert reading.consensus({1: [("a", 2), ("b", 2)], 2: [("a", 3)]}) == {1: 2, 2: 3}
    rnd = random.Random(5)
    easy, hard = "the cat sat on a mat".split(), "notwithstanding interpretation jurisdiction constitutional methodology although whereas".split()
    rows, labels = [], {}
    for i in range(60):
        g = 1 if i % 2 else 6
        t = " ".join(" ".join(rnd.choice(easy if g == 1 else hard) for _ in range(6 if g == 1 else 25)).capitalize() + "." for _ in range(12))
        rows.append((i, "en", t))
        labels[i] = [("a", g), ("b", g)]
    m = reading.fit(rows[:40], {k: v for k, v in labels.items() if k < 40})
    gr = reading.Grader(m)
    right = sum((gr.grade(t, "en")[0] > 3) == (labels[i][0][1] > 3) for i, _, t in rows[40:])
    assert right >= 19 and gr.grade("", "en") is None and gr.grade("x", "ja") is None


def test_p9_changed_words_anywhere(spark):
    rnd = random.Random(2)
    passages = {i: [f"w{rnd.randrange(10**6):06d}".translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(60)] for i in range(20)}
    index = leaks.Index([(i, " ".join(p)) for i, p in passages.items()])
    for n, bad in ((16, (1,)), (16, (4, 8, 12)), (16, (1, 14)), (16, (3, 6, 9, 12)), (18, (2, 15)), (20, (2, 7, 10, 14, 17)), (24, (8, 9, 11, 12, 14, 15))):
        w = [f"zz{k}" if k in bad else x for k, x in enumerate(passages[3][20 : 20 + n])]
        assert [r[0] for r in index.search(["ua"] * 9 + w + ["hele"] * 9)] == [3], (n, bad)
    w = passages[5][20:36]
    misread = [w[0][:3] + "q" + w[0][4:], *w[1:15], w[15][:2] + "q" + w[15][3:]]
    assert [r[0] for r in index.search(["ua"] * 9 + misread + ["hele"] * 9)] == [5]
    assert index.search(["ua"] * 9 + w[:15] + ["hele"] * 9) == [] and index.search(["ua"] * 9 + w[:12] + ["hele"] * 9) == []


def test_p10_every_document_has_a_row(spark):
    rnd = random.Random(6)
    easy, hard = "the cat sat on a mat with his dog".split(), "notwithstanding the interpretation of jurisdiction and constitutional methodology although whereas".split()

    def text(g, n=12):
        return " ".join(" ".join(rnd.choice(easy if g == 1 else hard) for _ in range(7 if g == 1 else 25)).capitalize() + "." for _ in range(n))

    rows = [(i, text(1 if i % 2 else 6), "en", "typed", "T") for i in range(40)]
    haw, ja = "Ua hele ke keiki i ka hale nui o ke kaikamahine ma ka ʻāina.", "父は本を読みました。昨日の朝、母は島の話を聞きました。"
    rows += [(100, text(6).replace(". ", ".\n"), "en", "scan", "T"), (101, "[00:00:01] " + text(6).lower().replace(".", " [00:00:09]"), "en", "oral", "T"), (102, text(6, 2), "en", "typed", "T"), (103, f"{text(6)}\n\n{haw * 3}", "en", "typed", "T"), (104, ja * 4, "ja", "typed", "T"), (105, None, None, "typed", None), (106, "", None, "scan", None)]
    labels = spark.createDataFrame([(i, r, 1 if i % 2 else 6) for i in range(40) for r in "ab"], "doc_id long, rater string, grade long")
    got = {r["doc_id"]: r for r in reading.grades(docs(spark, rows), labels).collect()}
    assert sorted(got) == sorted(r[0] for r in rows)
    assert all(got[k]["grade"] > 3 and got[k]["reason"] is None for k in (100, 101, 102, 103))
    assert {k: got[k]["reason"] for k in (104, 105, 106)} == {104: "no labels in its language", 105: "no text", 106: "no text"}
    assert {r["doc_id"] for r in reading.found(docs(spark, rows), labels).collect()} <= set(range(40))


def test_p2_words_are_judged_alike_at_any_size(spark):
    lex = [("oil", 719, 540), ("cil", 19, 0), ("sa", 2523, 1900), ("fa", 21, 0), ("ma", 77927, 60000), ("ina", 1152, 1145), ("hale", 40, 30), ("halc", 1, 0)]
    for times in (1, 10, 1000):
        rows = spark.createDataFrame([(w, n * times, o * times) for w, n, o in lex], "word string, n long, outside long")
        assert {tuple(r)[:2] for r in scans.corrections(rows).collect()} == {("cil", "oil"), ("fa", "sa"), ("halc", "hale")}, times


def test_p2_all_known_headers():
    names = ["HALE", "MAUNA", "KAHAWAI", "LOKO", "PUKA", "WAAPA"]
    page = [f"[{k}]\n{n} KAHIKO\nUa hele ke keiki i ka hale." for k, n in enumerate(names, 11)]
    text = "\n".join(page) + "\nUa hele.\nWAAPE KAHIKO\nUa noho ke keiki."
    assert scans.roles(text, None)[text.split("\n").index("WAAPE KAHIKO")] == "header"


def test_p1_units_of_both_tables(spark):
    from kilohana.llm import registry

    s = sents(spark, [(1, 1, "A. Ua hele. He hale.", T0), (1, 1, "Ua hele. He hale.", T0 + dt.timedelta(1)), (2, 1, None, None)])
    d = docs(spark, [(1, "Ua hele. He wai.", None, "typed", None), (2, None, None, "typed", None)])
    old, registry.table = registry.table, lambda _, __, name: {"documents": d, "sentences": s}[name]
    try:
        got = sorted((r["rec_table"], r["rec_id"], r["unit_no"], r["unit"]) for r in registry.p1_units(spark, "").collect())
    finally:
        registry.table = old
    assert got == [("documents", 1, 1, "Ua hele."), ("documents", 1, 2, "He wai."), ("sentences", 1, 1, "Ua hele."), ("sentences", 1, 2, "He hale.")]


def test_p4_other_accents_and_half_width_kana(spark):
    texts = ["ke café nui", "ke café nui", "ke cafe nui", "São Paulo", "São Paulo", "ガイドのパン", "ｶﾞｲﾄﾞのﾊﾟﾝ"]
    s = sents(spark, [(i, 1, t, T0) for i, t in enumerate(texts)])
    assert {tuple(r) for r in lookalike.found(s).collect()} == {(0, 1), (3, 4), (5, 6)}


def test_p4_narrowing_loses_no_canonical_pair(spark):
    """Every composed character and its parts, alone and with a second mark: the pairs are those of brute-force normal forms."""
    import unicodedata

    texts = []
    for c in [*range(0xA1, 0x250), *range(0x386, 0x3CF), *range(0x1E00, 0x1F00), 0xAC01, 0xD55C, 0x304C, 0xF900]:
        d = unicodedata.normalize("NFD", chr(c))
        if d != chr(c):
            texts += [f"ka {chr(c)} {c}", f"ka {d} {c}"]
    texts += ["ka 1", "ka \u0661", "ka \U0001d41a nui", "ka a nui", "ka\u200b hale", "ka hale"]
    s = sents(spark, [(i, 1, t, T0) for i, t in enumerate(texts)])
    by = {}
    for i, t in enumerate(texts):
        by.setdefault(unicodedata.normalize("NFD", t.replace("\u200b", "")), []).append(i)
    assert {tuple(r) for r in lookalike.found(s).collect()} == {tuple(v) for v in by.values() if len(v) == 2}


def test_p4_rows_of_one_text_in_a_hot_class(spark):
    s = sents(spark, [(i, 1, "He nā lā" if i % 100 else "He na\u0304 lā", T0) for i in range(3000)])
    assert lookalike.found(s).count() == 30 * 2970
    tie = sents(spark, [(1, 1, "He nā lā", T0), (1, 1, "Ua hele", T0), (2, 1, "He na\u0304 lā", T0), (3, 1, "Ua\u00a0hele", T0)])
    one = {r[0]: r[1] for r in lookalike.one_text(tie).collect()}
    assert one[2] == "He nā lā" and one[3] == "Ua hele" and {tuple(r) for r in lookalike.found(tie).collect()} == {(1, 2 if one[1] == one[2] else 3)}


def test_p9_slots_filled_anew_alike(spark):
    passage = "The merchant Kalani sold 48 lanterns to Hilina on 3 October while Kalani kept 48 ropes for Hilina, so Kalani and Hilina weighed 48 barrels, and 48 more with Hilina."
    other = ["the governor spoke of rain and of the long road to the mountain church that day", "a teacher read one letter about whales to her patient class after the noon bell"]
    items = spark.createDataFrame([(1, "x", "Read the passage and answer the question.", passage), (2, "x", "p", other[0]), (3, "x", "p", other[1])], "item_id long, suite string, prompt string, passage string")

    def fill(*values):
        t = passage
        for old, new in zip(("Kalani", "48", "Hilina", "3 October"), values):
            t = t.replace(old, new)
        return t

    alike = fill("Mapuana", "75", "Wailele", "9 March")
    torn = alike.replace("Mapuana kept 75 ropes for Wailele", "Nohea kept 61 ropes for Kapono").replace("weighed 75", "weighed 22")
    d = docs(spark, [(1, "Long ago. " + alike, None, "typed", None), (2, torn, None, "typed", None), (3, "Read the passage and answer the question. Ua hele.", None, "typed", None)])
    got = {tuple(r) for r in leaks.leaks(d, items).select("doc_id", "item_id").collect()}
    assert got == {(1, 1)}
    assert leaks.leaks(d, items).where("doc_id = 1").first()["slots"] >= 7
    assert leaks.leaks(d, items, slots=False).count() == 0


def test_p9_blocks_do_not_change_the_result(spark, monkeypatch):
    rnd = random.Random(4)
    ps = [" ".join(f"w{rnd.randrange(400)}x" for _ in range(40)) for _ in range(23)]
    items = spark.createDataFrame([(i, "x", "p", p) for i, p in enumerate(ps)], "item_id long, suite string, prompt string, passage string")
    d = docs(spark, [(i, "ua " + " ".join(p.split()[5:30]), None, "typed", None) for i, p in enumerate(ps)])
    whole = {tuple(r) for r in leaks.leaks(d, items).collect()}
    monkeypatch.setattr(leaks, "blocks_of", lambda items, f=leaks.blocks_of: f(items, 2))
    assert {tuple(r) for r in leaks.leaks(d, items).collect()} == whole and len(whole) >= 23


def test_p2_hyphen_evidence(spark):
    filler = "He well-known hale. The man was well and known. Ua mākaukau ke keiki. "
    d = docs(spark, [(1, "The house is well-\nknown to the mā-\nkaukau keiki of the sun-\nlight and the ice-\ncold wai.", "en", "scan", None)] + [(k, filler + "sun light sunlight ice cold", "en", "typed", None) for k in range(10, 16)])
    text = {r["doc_id"]: r["text"] for r in scans.paragraphs(d).collect()}
    assert text[1] == "The house is well-known to the mākaukau keiki of the sunlight and the ice-cold wai."


def test_p2_line_filter_covers_the_token_test():
    rnd = random.Random(8)
    for _ in range(4000):
        line = "".join(rnd.choice(["a", "e", "K", " ", "  ", "\t", "!", "+", ")", "1", "6", "€", "ı", ".", "y)", "(", "ʻ"]) for _ in range(rnd.randrange(1, 14)))
        toks = line.split()
        if any(scans._marked(t, n) for t, n in zip(toks, [*toks[1:], ""])):
            assert scans.ODD_LINE.search(line), line


def test_p2_long_header_lines():
    head = "KA NUPEPA O KA LAHUI HAWAII A ME NA KANAKA A PAU O KEIA PAE AINA NANI LOA O KAKOU I KEIA MANAWA"
    text = "\n".join(f"{head} {k}\nUa hele ke keiki i ka hale." for k in (11, 12, 13))
    assert len(head) > 90 and scans.roles(text, head.capitalize())[::2] == ["header"] * 3


@pytest.fixture(scope="module")
def small_model(spark):
    return langid.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


@pytest.mark.parametrize("text", ["Le petit garçon est allé à l'école avec sa sœur et ses amis du village.", "Der kleine Junge ging gestern Abend mit seiner Schwester in die Schule.", "Pieni poika meni eilen illalla kouluun sisarensa kanssa vaikka oli kylmä.", "Маленький мальчик пошёл в школу со своей сестрой."])
def test_p5_rejects_other_languages(small_model, text):
    assert small_model.classify(langid.Grams(), [langid.segment_words(text)])[0][0] == "und"


def test_p5_rejection_spares_its_own(spark, small_model):
    rows = spark.read.parquet("/root/testdata/sf0.001/sentences.parquet").where("length(hawaiiantext) >= 40").select("hawaiiantext").collect()
    got = small_model.classify(langid.Grams(), [langid.segment_words(r[0]) for r in rows])
    assert sum(k == "und" for k, _ in got) <= 0.02 * len(got)


def test_p1_look_back_cuts_nothing(monkeypatch):
    rnd = random.Random(9)
    bits = ["Ua hele", " ", "Messrs.", "Rev.", "No. 4", "(!)", "( ! )", "3 A.M.", "!!!!!!!!!!!!!!!!!!!!!!!!!!!!!!", "…", "”", "」", "。", "K.", " He wai", ".", "?", "\n", "“Aloha!”", "&c.", "m. No."]
    texts = ["".join(rnd.choice(bits) for _ in range(30)) for _ in range(300)]
    near = [segment.Segmenter().ends(t) for t in texts]
    monkeypatch.setattr(segment.Segmenter, "LOOK_BACK", 10**6)
    assert [segment.Segmenter().ends(t) for t in texts] == near


def test_p3_parts_and_repeated_rows(spark):
    src = spark.createDataFrame([(i, "g", T0) for i in range(6)], "sourceid long, groupname string, created timestamp_ntz")
    rows = [(i * 3000, i // 3, f"line {'abcdefghijklmnop'[i]}", T0) for i in range(12)] + [(40000 + i, i, "Kaʻana i kēia", T0) for i in range(6)]
    rows += [(0, 0, "older", T0 - dt.timedelta(1)), (50000, None, "x", T0), (None, 1, "x", T0)]
    s = sents(spark, rows)
    assert {r[0] for r in repeats.found(s, src).collect()} == set(range(40000, 40006))
    parts = sorted((r["sourceid"], r["part"], r["n_kept"], r["n_removed"], r["text"]) for r in repeats.cleaned(s, src).where("sourceid = 0").collect())
    assert parts == [(0, 0, 2, 0, "line a\nline b"), (0, 1, 1, 0, "line c"), (0, 9, 0, 1, "")]
    assert repeats.cleaned(s.limit(0), src.limit(0)).count() == 0


def test_p6_the_last_delivery_decides(spark):
    c = spark.createDataFrame([(1, "a " * 20000, T0), (1, "short", T0 + dt.timedelta(1)), (2, "short", T0), (2, "b " * 20000, T0 + dt.timedelta(1)), (3, None, T0), (None, "c " * 20000, T0)], "sourceid long, text string, created timestamp_ntz")
    d = docs(spark, [(1, "漢" * 10001, None, "typed", None), (2, "漢" * 10000, None, "typed", None), (3, None, None, None, None)])
    assert {tuple(r) for r in split.found(d, c).collect()} == {("documents", 1), ("contents", 2)}


# every operator: nulls in any column, empty and very long texts, repeated rows, empty tables, extra columns with clashing names

CLASH = ["_h", "_x", "_s", "_key", "_src", "_grp", "_salt", "_shard", "_one", "_tie", "word", "kind", "n", "line_no", "ends", "unit", "container", "canonical", "l", "s", "k", "fill", "lines", "rec_id", "rec_table", "seg_no", "letters", "body", "grade_", "at"]


@pytest.fixture(scope="module")
def odd(spark):
    """The five tables with nulls everywhere, an empty and a long text, a row twice, and columns named as the operators name their own."""
    long = "Ua hele ke keiki i ka hale nui. " * 5000
    texts = [None, "", "   ", "\n\n", "x", long, long.replace(" ", ""), "[12]\n" * 3000, "He hale nani kēia o ka ʻāina.", "He hale nani kēia o ka ʻāina."]

    def with_extra(df):
        return df.select("*", *[F.lit(1).alias(c) for c in CLASH if c not in df.columns])

    media = ["typed", "scan", "oral", None]
    d = [(i * 4 + j, t, [None, "haw", "??"][i % 3], m, [None, "T"][i % 2], "s", None, None) for i, t in enumerate(texts) for j, m in enumerate(media)] + [(None, "Ua hele.", None, None, None, None, None, None)]
    s = [(i, [1, None][i % 2], t, [T0, None][i % 2]) for i, t in enumerate(texts)] * 2 + [(None, None, None, None)]
    c = [(i, [None, "<html><body><p>" + (t or "") + "</body>"][i % 2], t, [T0, None][i % 2]) for i, t in enumerate(texts)] * 2 + [(None, None, None, None), (77, "<div" * 50000, "x", T0)]
    return {
        "documents": with_extra(spark.createDataFrame(d, "doc_id long, text string, lang string, medium string, title string, source string, n_chars long, link string")),
        "sentences": with_extra(spark.createDataFrame(s, SENT)),
        "contents": with_extra(spark.createDataFrame(c, "sourceid long, html string, text string, created timestamp_ntz")),
        "sources": with_extra(spark.createDataFrame([(1, "g", T0), (1, "g", None), (None, "g", T0), (2, None, None)], "sourceid long, groupname string, created timestamp_ntz")),
        "eval_items": with_extra(spark.createDataFrame([(1, None, None, texts[8]), (2, None, None, None), (None, None, None, "x"), (3, None, None, ""), (4, "s", "p", "keiki i ka hale nui ua hele ke keiki")], "item_id long, suite string, prompt string, passage string")),
        "reading_labels": with_extra(spark.createDataFrame([(20, "a", 1), (20, "a", 1), (32, None, 2), (None, "b", 3), (36, "b", None), (36, "b", 9)], "doc_id long, rater string, grade long")),
    }


@pytest.mark.parametrize("name", ["p1_found", "p1_units", "p2_found", "p2_paragraphs", "p3_found", "p3_cleaned", "p4_found", "p4_one_form", "p4_classes", "p5_found", "p5_languages", "p6_found", "p6_pieces", "p7_found", "p7_bodies", "p8_packed", "p8_report", "p9_found", "p9_leaks", "p10_found", "p10_grades"])
def test_odd_tables(odd, name, monkeypatch):
    from kilohana.llm import registry

    monkeypatch.setattr(registry, "table", lambda _, __, t: odd[t])
    spark = odd["documents"].sparkSession
    getattr(registry, name)(spark, "").collect()
    monkeypatch.setattr(registry, "table", lambda _, __, t: odd[t].limit(0))
    assert len(getattr(registry, name)(spark, "").collect()) == (name == "p8_report")
