import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veriscope.functions import rules as rl
from veriscope.functions import text as tx

SAMPLES = [
    "Doanh thu tăng mạnh nhưng dòng tiền âm. Bên liên quan không công bố!\n\nHóa đơn giả  năm 2024?",
    "THE BALANCE SHEET and the invoice of revenue is 1,234.5 and 1.2.3,4",
    "", "   \n\t ", "<p>Lợi nhuận</p> &nbsp; https://a.b/c?d=1 đ", "ế combining", "a" * 2000, "Kho Đông Hà",
]


def column(spark, values, make):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string").select("i", make(F.col("t")).alias("x")).collect()
    return [r.x for r in sorted(rows, key=lambda r: r.i)]


def folded(t):
    d = "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn")
    return d.replace("đ", "d").replace("Đ", "D")


def test_fold_and_collapse(spark):
    assert column(spark, SAMPLES, tx.fold_accents) == [folded(t) for t in SAMPLES]
    assert column(spark, SAMPLES, tx.collapse) == [re.sub(r"\s+", " ", t.lower()).strip() for t in SAMPLES]


@settings(max_examples=15, deadline=None)
@given(texts=st.lists(st.text(alphabet="aàảãạăắđĐơợ ỹÝ\n\t.,01_xX", max_size=30), min_size=1, max_size=20))
def test_tokens_property(spark, texts):
    assert column(spark, texts, tx.word_tokens) == [re.findall(r"\w+", t.lower()) for t in texts]
    assert column(spark, texts, tx.ws_tokens) == [t.split() for t in texts]
    assert column(spark, texts, tx.fold_accents) == [folded(t) for t in texts]


def test_clean(spark):
    got = column(spark, SAMPLES, tx.clean)
    assert got[4] == "lợi nhuận đ"
    assert got[5] == "ế combining"
    assert got[2] == "" and got[3] == ""


def test_segments(spark):
    assert column(spark, ["A b. C d!\n\nE\r\nf ? g"], tx.segments) == [["A b.", "C d!", "E", "f ?", "g"]]


def test_windows_cover_text(spark):
    t = "".join(chr(97 + i % 26) for i in range(2000))
    w = column(spark, [t, "short", ""], tx.windows)
    assert [len(x) for x in w[0]] == [768, 768, 704] and w[0][0][-120:] == w[0][1][:120]
    assert w[1] == ["short"] and w[2] == []


def test_numbers(spark):
    assert column(spark, ["1.234,5 rồi 7 và 1,2,3"], tx.numbers) == [[1234.5, 7.0]]
    assert column(spark, ["(1.234.567)", "-5", "1 234 567", "abc", "1.2.3", "1,5"], tx.accounting_number) == [-1234567.0, -5.0, 1234567.0, None, None, 1.5]


def test_nulls_stay_null(spark):
    for make in (tx.fold, tx.clean, tx.word_tokens, tx.segments, tx.denoise, tx.accounting_number):
        assert column(spark, [None], make) == [None]


def test_rules(spark):
    flags = column(spark, SAMPLES, lambda t: rl.red_flags(tx.fold(t)))
    assert flags[0] == ["doanh_thu_khong_di_kem_dong_tien", "hoa_don_gia_hoac_thoi_phong_doanh_thu", "dau_hieu_quan_tri_rui_ro"]
    assert column(spark, ["off-balance items were concealed", "nợ ngoài bảng cân đối kế toán, che giấu"], lambda t: rl.red_flags(tx.fold(t))) == [["che_giau_no_phai_tra"], ["che_giau_no_phai_tra"]]
    seg = column(spark, SAMPLES[:1], rl.suspicious_segments)[0]
    assert [s.flags for s in seg] == ["doanh_thu_khong_di_kem_dong_tien", "dau_hieu_quan_tri_rui_ro", "hoa_don_gia_hoac_thoi_phong_doanh_thu"]


def test_signals_and_labels(spark):
    assert column(spark, ["Phát hiện GIAN LẬN và related party transaction"], rl.fraud_signals) == [["tu_khoa_related\\s*party\\s*tr", "tu_khoa_gian\\s*lận", "co_giao_dich_ben_lien_quan"]]
    assert column(spark, ["Ý KIẾN NGOẠI TRỪ", "bình thường"], lambda t: rl.auto_label(t, F.array())) == [1, 0]
    assert column(spark, ["vi_pham", "1", "HIGH_RISK", "0", None, "x"], rl.label_name) == ["VI_PHAM", "CANH_BAO", "CANH_BAO", "BINH_THUONG", "BINH_THUONG", "BINH_THUONG"]


def test_personal_data(spark):
    t = ["a@b.vn và 0912 345 678, mã 123456789012"]
    assert [column(spark, t, lambda c, k=k: rl.personal_data(c)[k])[0] for k in ("email", "phone", "long_id")] == [1, 1, 1]


def test_masking_keeps_order(spark):
    assert column(spark, ["Cơ sở của ý kiến ngoại trừ"], tx.mask_leaks) == ["Cơ sở của [MASK]"]


def test_word_lists(spark):
    words = ["going-concern", "off-balance", "a.b", "x"]
    got = column(spark, ["going-concern,", "(x)", "axb", "a.b", ",.x;!"], lambda t: t.rlike(tx.one_of(words, ".,:;!?")))
    assert got == [True, False, False, True, True]
    assert column(spark, ["Đông"], lambda t: tx.let(tx.fold(t), lambda f: F.concat(f, f))) == ["dongdong"]


def test_denoise(spark):
    noisy = "A  b\t\tc\n-----....\n\n\n\n%%%%%%\n Trang 1/2 \n- 5 -\nPage 3\nDoanh thu 5\r\n"
    assert column(spark, [noisy, "", "  "], tx.denoise) == ["A b c\n\nDoanh thu 5", "", ""]
