import pytest

from petalstream.llm import sentences as S

WORDS = {"Mỗi": (9, 0, 0), "The": (9, 0, 0), "Jeder": (5, 0, 0), "Mai": (0, 0, 5), "Hạ": (0, 9, 0)}
ABBREVIATIONS = dict.fromkeys(["TS", "v.v", "etc", "usw", "Nr", "Dr", "Mrs", "TP"], True)


def parts(text):
    return [text[a:b] for a, b in S.Splitter(WORDS, ABBREVIATIONS).split(text)]


@pytest.mark.parametrize(
    "want",
    [
        ["TS. Hạ Thư khuyên cắt 17.6 cm.", "Mỗi giỏ gồm lan."], ["Kho còn hồng, lá bạc, v.v.", "Mỗi giỏ gồm lan."], ["Apples, etc. in summer stay.", "The rest goes."],
        ["Am 3. Mai liefern wir Nr. 95 bis 20:25 Uhr.", "Jeder Korb ist neu."], ["Khách viết: \"Hoa đẹp quá! Lần sau tôi lại đặt.\" và kèm ảnh."], ["“Thích lắm!”, chị nói.", "Mỗi giỏ gồm lan."],
        ["Giá từ 2.000 đến 3.000₫ tùy cỡ... nhưng thiệp miễn phí.", "The end?!", "Ok."], ["她说“不错。我要两束。”就走了。", "花枝长约3.2厘米，重5公斤。", "真的！"],
        ["「綺麗です。また。」と書いてくださいました。", "水を替えれば楽しめます！"], ["डॉ. मीरा ने 4 टोकरियाँ मँगाईं।", "क्या यह ठीक है?"], ["طلب د. سامر من وادي الضباب.", "هل تبحث عن هدية؟", "السعر 3 كغ."],
        ["ถ้าจะส่งควรเลือกดอกอะไรดีคะ", "ราคา 1,060,000 ₫ รวมการ์ดแล้วค่ะ", "คุณเขียนว่า \"สวยมาก จะสั่งอีก\" แล้วแนบรูป"], ["See www.tiem-E2.example/a.html before.", "The v2.0 is out."],
    ],
)
def test_sentences_in_one_line(want):
    assert parts(" ".join(want)) == want if not want[0][-1] in "。！" else parts("".join(want)) == want


def test_lines_marks_labels_and_missing_spaces():
    assert parts("1. Mẫu A7 cao 7 cm\n- Hoa tươi.\r\nKhách: Được không?\n\n  Tiêu đề  ") == ["1. Mẫu A7 cao 7 cm", "- Hoa tươi.", "Khách: Được không?", "Tiêu đề"]
    assert parts("cùng tông.Lẵng mới. Xốp ẩm. 🌸") == ["cùng tông.", "Lẵng mới.", "Xốp ẩm. 🌸"]


def test_the_document_overrules_the_corpus():
    assert parts("Công ty abc. là tốt. Gặp abc. Hạ ở đây.") == ["Công ty abc. là tốt.", "Gặp abc. Hạ ở đây."]


def test_the_document_overrules_the_corpus_both_ways():
    splitter = S.Splitter(WORDS, {"ly": True})
    text = "Thêm hai ly.\nCần ba ly.\nĐể bốn ly.\nRót năm ly.\nĐặt trên ly. Hạ ở đây."
    assert [text[a:b] for a, b in splitter.split(text)][-2:] == ["Đặt trên ly.", "Hạ ở đây."]
    short = "Đặt trên ly. Hạ ở đây."
    assert len(splitter.split(short)) == 1  # no evidence of its own: the corpus tells


def test_thai_spaces_that_carry_on():
    assert parts("ดอกไม้สวยมากค่ะ และส่งเร็ว") == ["ดอกไม้สวยมากค่ะ", "และส่งเร็ว"]
    assert parts("ร้านนี้มีดอกกุหลาบ ซึ่งสดมาก ต้องลองสั่ง") == ["ร้านนี้มีดอกกุหลาบ ซึ่งสดมาก", "ต้องลองสั่ง"]
    assert parts("ของต่างๆ ในร้านสวย") == ["ของต่างๆ ในร้านสวย"]
    assert parts("ที่ร้านมีช่อใหญ่ ที่นี่ส่งฟรี") == ["ที่ร้านมีช่อใหญ่", "ที่นี่ส่งฟรี"]


def test_an_abbreviation_glued_to_the_sentence_before():
    assert parts("Hoa và giấy kraft.TS. Hạ Thư nói.")[-1] == "TS. Hạ Thư nói."


def test_dotted_tokens_of_any_length():
    assert parts("Gửi T.P.H.C.M.C.N. Hạ nhận.") == ["Gửi T.P.H.C.M.C.N. Hạ nhận."]


@pytest.mark.parametrize("text", ["", " ", "\n\n", "...", "\"", "“((", "a" * 100_000, "x. " * 5000, "́.", "?!​"])
def test_everything_but_space_is_covered(text):
    spans = S.Splitter().split(text)
    covered = set()
    for a, b in spans:
        assert a < b and text[a:b] == text[a:b].strip()
        covered |= set(range(a, b))
    assert all(text[i].isspace() or i in covered for i in range(len(text)))


def test_operator(spark):
    docs = ["TS. Hạ Thư nói. Mỗi giỏ gồm lan."] * 5 + ["Mỗi giỏ gồm TS. Hạ.\nMỗi bó, gặp Hạ Thư."] * 5 + [None, "", "  "]
    rows = [(i // 2, t, "x") for i, t in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string, t string")
    got = S.sentences(df, "text", "doc_id").collect()
    assert len(got) == 20 and {r.doc_id for r in got} == {0, 1, 2, 3, 4}
    assert S.sentences(df.limit(0), "text", "doc_id").count() == 0


def test_rare_evidence_counts_at_any_size(spark):
    docs = ["Gặp xyz. Hạ Thư nói."] + ["Nhờ xyz, nay xyz. và hoa."] * 3 + ["Mỗi bó, gặp Hạ Thư.\nMỗi giỏ gồm lan."] * 4 + ["Kho abc. Mỗi giỏ gồm lan."] * 40
    rows = [(i // 2, t) for i, t in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = lambda floor: sorted(map(tuple, S.sentences(df, "text", "doc_id", floor).collect()))
    whole = spans(0.0)
    assert (0, 0, len(docs[0])) in whole
    for floor in (0.02, 0.2, 1.0):
        assert spans(floor) == whole
