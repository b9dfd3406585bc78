import pytest
from pyspark.sql import functions as F

from veriscope.llm import bpe, chunking, encoding, textforms
from veriscope.llm.textforms import canonical


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("Doanh thu", "Ｄｏａｎｈ　ｔｈｕ"), ("ế", "ế"), ("tiền", "ti​ền"), ("10 000", "10 000"), ("non‑stop", "non-stop"), ("soft\xadhyphen", "softhyphen"),
        ("bản nháp", "bản nһáp"), ("Đông", "Ðông"), ("Đông", "Ɖông"), ("ấ", "a\u0302\u0341"), ("ООО Мост", "OOO Мост"), ("a\r\nb", "a\nb"), ("ô", "о̂"), ("giá", "ɡiá"),
    ],
)
def test_equal_looks(a, b):
    assert canonical(a) == canonical(b)


@pytest.mark.parametrize(("a", "b"), [("a–b", "a-b"), ("a  b", "a b"), ("A", "a"), ("o", "ô"), ("a\nb", "a b"), ("д", "d"), ("“a”", '"a"'), ("Мост", "Most"), ("²", "2"), ("™", "TM"), ("a ", "a")])
def test_different_looks(a, b):
    assert canonical(a) != canonical(b)


def test_script_of_tokens():
    assert canonical("Вольный") == "Вольный" and canonical("Bольный") == "Вольный"  # the only script that spells it
    assert canonical("ООО") == "OOO" and canonical("kһách") == "khách"
    assert canonical(None) is None and canonical("") == ""
    for t in ("Hệ số β", "Éclat Rivière", "Số 12/3", "x" * 100_000):
        assert canonical(canonical(t)) == canonical(t)


@pytest.mark.parametrize(("a", "b"), [("ρhí", "phí"), ("υ", "u"), ("γ", "y"), ("ι", "i"), ("Ү", "Y"), ("Ԝ", "W"), ("Ӏ", "I"), ("ᴄông", "công"), ("Ꭺ", "A"), ("ꓐ", "B"), ("ⲟ", "o"), ("ⅼãi", "lãi"), ("Ⅽ", "C"), ("ꜱ", "s")])
def test_letters_of_the_public_data(a, b):
    assert canonical(a) == canonical(b)


@pytest.mark.parametrize("word", ["Вольный", "Μήνυμα", "Հայաստան", "ᏣᎳᎩ", "ⲙⲛ̄ⲧⲣⲙ̄ⲛ̄ⲕⲏⲙⲉ", "щётка", "ⅷ", "ﬁn", "ı", "β", "l1I|"])
def test_genuine_words_stay(word):
    import unicodedata

    kept = canonical(word)
    assert canonical(kept) == kept and (word in ("ﬁn", "ⅷ") or unicodedata.normalize("NFC", word).lower()[0] == kept.lower()[0] or not kept.isascii())


def test_confusable_tokens(spark):
    assert textforms.confusable("kһách") == ("mixed", ["CYRILLIC", "LATIN"]) and textforms.confusable("ООО") == ("whole", ["CYRILLIC"])
    assert textforms.confusable("Bольный") == ("mixed", ["CYRILLIC", "LATIN"]) and textforms.confusable("Вольный") is None and textforms.confusable("tiền") is None
    df = spark.createDataFrame([(1, "bản nһáp của ООО Вольный"), (None, "ООО"), (2, None), (3, ""), (4, "x")], "sample_id long, text string").withColumn("kind", F.lit(1))
    got = sorted(((r.sample_id or 0, r.token, r.kind, r.spelling) for r in textforms.confusable_tokens(df).collect()))
    assert got == [(0, "ООО", "whole", "OOO"), (1, "nһáp", "mixed", "nháp"), (1, "ООО", "whole", "OOO")]
    assert textforms.confusable_tokens(df.limit(0)).count() == 0


def test_copies_are_not_compared(spark):
    df = spark.range(100_001).select(F.col("id").alias("sample_id"), F.when(F.col("id") == 0, "ɡiá bán").otherwise("giá bán").alias("text"))
    pairs = textforms.lookalike_pairs(df)
    assert pairs.count() == 100_000 and pairs.where("sample_a <> 0").count() == 0


def test_lookalike_pairs(spark):
    rows = [(1, "giá", "k"), (2, "ɡiá", "k"), (3, "giá", "k"), (4, None, "k"), (5, "​", "k"), (6, "", "k"), (7, "khác", "k"), (2, "ɡiá", "k")]
    df = spark.createDataFrame(rows, "sample_id long, text string, k string")
    assert sorted(map(tuple, textforms.lookalike_pairs(df).collect())) == [(1, 2), (2, 3)]
    assert textforms.lookalike_pairs(df.limit(0)).count() == 0


VI = ["Công ty đã ghi nhận doanh thu bán hàng theo từng hợp đồng, giá trị {} đồng.", "Khoản phải thu khách hàng {} được đối chiếu đầy đủ với sổ phụ.", "Kho Đông Hà kiểm kê hàng tồn kho ngày {} nhất quán."]
EN = ["The company’s note on inventories was recorded on {} December.", "Retained earnings rose to {} million – slowly."]


@pytest.fixture(scope="module")
def describer():
    import zstandard

    make = lambda ts: zstandard.train_dictionary(8192, [t.format(i).encode() for i in range(300) for t in ts]).as_bytes()
    return encoding.Describer({"vi": make(VI), "en": make(EN)})


@pytest.mark.parametrize("codec", ["cp1252", "latin-1", "cp1258", "mac_roman", "cp437"])
@pytest.mark.parametrize("text", [*VI[:2], EN[0]])
def test_restores_misread_utf8(describer, codec, text):
    text = text.format(421)
    table = encoding._chars(codec)
    wrong = "".join(chr(b) if b < 128 else table[b] for b in text.encode())
    assert describer.restore(wrong)[0] == text
    mixed = VI[2].format(5) + " " + wrong
    assert describer.restore(mixed)[0] == VI[2].format(5) + " " + text


@pytest.mark.parametrize("text", ["财务报表附注说明", "القوائم المالية الموحدة", "งบการเงินรวมประจำปี", "примечания к отчётности", "επεξηγηματικές σημειώσεις"])
@pytest.mark.parametrize("codec", ["latin-1", "cp1252", "cp437"])
def test_restores_other_scripts(describer, codec, text):
    table = encoding._chars(codec)
    wrong = "".join(chr(b) if b < 128 else table[b] for b in text.encode())
    assert describer.restore(wrong)[0] == text
    sound = VI[1].format(7) + " " + text
    assert describer.restore(sound) == (sound, [], False)


def test_long_chains_are_all_measured(describer):
    """Each pair and some triples of wrong decodings come back, whichever looks best after one step."""
    text = VI[0].format(77) + " " + VI[1].format(8)
    wrong = lambda t, c: "".join(chr(b) if b < 128 else encoding._chars(c)[b] for b in t.encode())
    for a in encoding.MISREAD_AS:
        for b in encoding.MISREAD_AS:
            assert describer.restore(wrong(wrong(text, a), b))[0] == text, (a, b)
    assert describer.restore(wrong(wrong(wrong(text, "cp1252"), "mac_roman"), "cp850"))[0] == text


def test_damage_of_usual_characters_passes_the_gate():
    for text in ("CÔNG TY", "ÓC", "À"):
        assert encoding.GATE.search("".join(chr(b) if b < 128 else encoding._chars("cp1252")[b] for b in text.encode()))
    assert not encoding.GATE.search("Công ty “Hà Nội” – quý 1…")


def test_restores_twice_misread_and_tcvn3(describer):
    text = VI[0].format(9)
    twice = text
    for _ in range(2):
        twice = "".join(chr(b) if b < 128 else encoding._chars("cp1252")[b] for b in twice.encode())
    assert describer.restore(twice)[:2] == (text, ["utf-8 as cp1252"] * 2)
    assert describer.restore(text.translate(str.maketrans(encoding.TCVN3_MEANT, encoding.TCVN3_SHOWN)))[0] == text


@pytest.mark.parametrize("text", [VI[0], EN[0], "Bên mua ký tên Éclat Rivière, giá £ và ¥ ghi song song.", "Hỏi gì? Đáp.", "Ai ký? Ai duyệt? Vì sao? ", "xem a?b=c&d?e", "ООО Вольный Мост", "Ｄoanh thu​ ɡiá", "", "??", "Ðông Hà"])
def test_leaves_sound_texts(describer, text):
    assert describer.restore(text) == (text, [], False)


def test_lost_characters(describer):
    assert describer.restore("Công ty h?ch toán chi phí t?i kho ?ông")[2]
    assert describer.restore("giá tr\ufffd")[2]
    r, chain, lost = describer.restore("thá»\ufffdi háº¡n Ä\ufffdÃ´ng")
    assert lost and chain[0] == "utf-8 as cp1252" and "ông" in r


def test_restore_frame(spark):
    rows = [(1, "CÃ´ng ty Ä‘Ã£ ghi nháº\xadn"), (2, None), (3, ""), (4, "Công ty"), (1, "CÃ´ng ty Ä‘Ã£ ghi nháº\xadn")]
    df = spark.createDataFrame(rows, "sample_id long, text string").withColumn("restored", F.lit(1)).withColumn("t", F.lit(2))
    got = encoding.restore_texts(df).collect()
    assert [(r.sample_id, r.restored) for r in got] == [(1, "Công ty đã ghi nhận")] * 2
    assert encoding.restore_texts(df.limit(0)).count() == 0


def test_pieces():
    text = "Điều 1. Mở đầu.\n\nCâu một có năm từ. Câu hai TP. Hà Nội dài. Câu ba.\nDòng cuối không dấu chấm"
    for limit in (1, 2, 3, 5, 8, 50):
        for overlap in (None, 0, 1, 2, 100):
            made = chunking.pieces(text, limit, overlap)
            tokens = []
            for p, n, shared in made:
                w = p.split()
                assert len(w) == n <= limit or len(made) == 1
                assert w[:shared] == tokens[len(tokens) - shared :] if shared else True
                tokens += w[shared:]
            assert tokens == text.split()
    assert [p for p, _, _ in chunking.pieces("a b c. D e f. G h", 6, 0)] == ["a b c. D e f.", "G h"]
    assert chunking.pieces(None, 3, 1) == [] and chunking.pieces("  ", 3, 1) == [("  ", 0, 0)] and chunking.pieces("a b", None, None) == [("a b", 2, 0)]
    assert len(chunking.pieces("x " * 50_000, 100, 100)) == 1 + -(-(50_000 - 100) // 50)


def test_pieces_of_characters():
    text = "Điều 1. Mở đầu.\n\nCâu một có năm từ. " + "x" * 57 + " Cuối e\u0302\u0301\u0323 y."
    for limit in (1, 2, 3, 7, 20, 40, 500):
        for overlap in (None, 0, 1, 3, 100):
            made, body = chunking.pieces(text, limit, overlap, "characters"), ""
            for p, n, shared in made:
                assert len(p) == n and (n <= limit or len(made) == 1)
                assert p[:shared] == body[len(body) - shared :] if shared else True
                body += p[shared:]
            assert body == text
    assert all(not p.startswith(("\u0302", "\u0301", "\u0323")) for p, _, _ in chunking.pieces(text, 7, 0, "characters"))
    assert [n for _, n, _ in chunking.pieces("z" * 1_000_000, 300_000, 0, "characters")] == [300_000] * 3 + [100_000]
    assert chunking.pieces("   ", 2, 0, "characters") == [("   ", 3, 0)] and chunking.pieces(None, 2, 0, "characters") == []
    with pytest.raises(ValueError):
        chunking.pieces("x", 1, 0, "bytes")


def test_split_frame(spark):
    df = spark.createDataFrame([("a", "một hai ba bốn", 2, None, "x"), ("b", None, 2, 1, "x"), ("c", "một", None, 1, "x"), ("d", "một hai", 0, 3, "x")], "chunk_id string, text string, chunk_size_tokens int, chunk_overlap_tokens int, piece string")
    got = chunking.split_texts(df).orderBy("chunk_id", "piece").collect()
    assert [(r.chunk_id, r.text, r.pieces) for r in got] == [("a", "một hai", 2), ("a", "ba bốn", 2), ("c", "một", 1), ("d", "một", 2), ("d", "hai", 2)]
    assert chunking.split_texts(df.limit(0)).count() == 0


def test_bpe_round_trip_and_reference(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = ["Doanh thu 1.234,5 tăng", "", None, " \n\n  x", "<|endoftext|>", "½ ²x Ⅳ ا漢字 \U0001f600 ế", "it's WE'LL  don't_", "a" * 5000, "\x1c\x85 \xa0z"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit(0)).repartition(3)
    got = {r.doc_id: r.ids for r in bpe.encode_texts(df).collect()}
    for i, x in enumerate(texts):
        assert got[i] == t.encode(x or "", add_special_tokens=False).ids
        assert t.decode(got[i], skip_special_tokens=False) == (x or "")
    assert bpe.encode_texts(df.limit(0)).count() == 0


def test_long_words_and_decoding(spark):
    """Words of a megabyte encode in seconds as the public library does, and decoding gives every text back."""
    public = pytest.importorskip("public_tokenizers")
    import random
    import time

    from tokenizers import Tokenizer

    rnd = random.Random(3)
    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = ["a" * 1_000_000, "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=200_000)), "".join(chr(rnd.randrange(0x4E00, 0x9FA5)) for _ in range(100_000)), "ab" * 50_001 + "aaa", "ệ" * 9_999, "x" * 63 + "é" * 2, "", None, "<|endoftext|> ế \x00"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.time()
    ids = bpe.encode_texts(df).cache()
    got = {r.doc_id: r.ids for r in ids.collect()}
    assert time.time() - began < 90
    for i, x in enumerate(texts):
        assert got[i] == t.encode(x or "", add_special_tokens=False).ids
    back = {r.doc_id: r.text for r in bpe.decode_ids(ids.withColumn("text", F.lit(1))).collect()}
    assert back == {i: x or "" for i, x in enumerate(texts)}
    assert bpe.decode_ids(ids.limit(0)).count() == 0
    short = spark.createDataFrame([(1, None), (2, []), (2, got[4][:1])], "doc_id long, ids array<int>")
    assert [r.text for r in bpe.decode_ids(short).orderBy("doc_id", "text").collect()][:2] == ["", ""]


def test_null_ids_and_large_ids(spark):
    from veriscope.llm import neardup, readability

    big = 2**60 + 1
    df = spark.createDataFrame([(None, "CÃ´ng ty Ä‘Ã£ ghi nháº\xadn", 1), (big, "CÃ´ng ty Ä‘Ã£ ghi nháº\xadn", 2), (big + 1, "cÃ´ng ty Ä‘Ã£ ghi nháº\xadn", 2)], "sample_id long, text string, n int").coalesce(1)
    ids = {None, big, big + 1}
    assert {r.sample_id for r in encoding.restore_texts(df).collect()} == ids
    assert {r.sample_id for r in chunking.split_texts(df, "sample_id", "text", "n", "n").collect()} == ids
    assert {r.sample_id for r in readability.reading_levels(df, df.select("sample_id", F.col("n").alias("reading_level")), "sample_id").collect()} == ids
    assert {r.sample_id for r in bpe.encode_texts(df, "sample_id").collect()} == ids
    assert list(map(tuple, neardup.near_duplicate_pairs(df).collect())) == [(big, big + 1)]
