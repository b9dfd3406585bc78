import random
import re
import time

from pyspark.sql import functions as F

from veriscope.functions import lexicons as lx
from veriscope.functions import parse
from veriscope.functions import text as tx

TEXT = """bìa
--- TRANG 1 ---
CÔNG TY CP Nhựa Hải Hà
BẢNG CÂN ĐỐI KẾ TOÁN
TỔNG TÀI SẢN: 1.234.567.000
--- TRANG 2 ---
KET QUA HOAT DONG
Doanh thu thuần 900.000.000
Lợi nhuận sau thuế (400.000.000)
------
Trang 1/2
"""


def test_document(spark):
    df = spark.createDataFrame([(1, TEXT), (2, "không có gì"), (3, ""), (4, None)], "doc_id int, text string")
    r = {x.doc_id: x for x in parse.parse_documents(df).collect()}
    assert [p.page for p in r[1].pages] == [1, 2] and r[1].pages[0].content.startswith("CÔNG TY")
    assert r[1].loi_nhuan_sau_thue_num == -400_000_000 and r[1].doanh_thu_num == 900_000_000 and r[1].tong_tai_san_num == 1_234_567_000
    assert r[1].distress_signals == ["lo_nang_44.4%_doanh_thu"]
    assert "kqkd" in r[1].sections
    assert r[2].sections == {"full_text": "không có gì"} and r[2].doanh_thu_raw is None
    assert r[4].text_clean is None and r[4].pages is None or r[4].char_count is None


def test_many_labels_and_long_lines_are_read_once(spark):
    # of each label many without an amount: by patterns alone every one reads the rest of its line again for every field
    line = " ".join(f"{p} kỳ này" for labels in lx.AMOUNTS.values() for g in labels for p in ([f"mã số {g}"] if isinstance(g, int) else g))
    rows = [(i, f"--- TRANG 1 ---\n{line * 60}\nsố {i}.") for i in range(40)] + [(40, f"{line * 60} 1.234.567")]
    spark.createDataFrame(rows[:1], "doc_id int, text string").transform(parse.parse_documents).collect()
    began = time.perf_counter()
    r = spark.createDataFrame(rows, "doc_id int, text string").transform(parse.parse_documents).select("doc_id", *(f"{k}_raw" for k in parse.FIELDS)).collect()
    assert time.perf_counter() - began < 15
    assert all(x[f"{k}_raw"] == ("1.234.567" if x.doc_id == 40 else None) for x in r for k in lx.AMOUNTS)


def test_amounts_are_what_one_pattern_finds():
    rng, parts = random.Random(5), ["doanh thu thuần", "DOANH\nTHU  BÁN HÀNG", "net revenue", "Lợi nhuận sau thuế", "mã số 60", "maso60", "amaso60", "60", "160", "²60", "é60", "q̃60", "(1.234.567)", "1.234.567,890", "(12 345 678", "1.234", "5", ":", "\n", "\n", " ", " ", "a", "x" * 90]
    digits = r"[0-9]{1,3}(?:[,.\s]+[0-9]{3}){2,}"
    found = 0
    for _ in range(4000):
        t = parse.denoised("".join(rng.choice(parts) for _ in range(rng.randint(2, 14))))
        plain = parse.exchanged(t, parse.BARE)
        starts = [m.start() for m in parse._STARTS.finditer(plain)]
        for k, signed in (("doanh_thu", False), ("loi_nhuan_sau_thue", True)):
            figure = rf"(\(?{digits}\)?)" if signed else f"({digits})"
            want = None
            for g in lx.AMOUNTS[k]:
                label, gap = (rf"{parse._BEFORE}(?:ma\s*so\s*)?{g}{parse._AFTER}", 80) if isinstance(g, int) else (r"(?:" + "|".join(p.replace(" ", r"\s*") for p in g) + ")", 120)
                m = re.search(rf"{label}(?:[^\n]*?{figure}|[^\n]*+[^0-9]{{0,{gap}}}?{figure})", plain)
                want = want or (m and (m[1] or m[2]))
            assert parse.amount(plain, parse.squeezed(plain), starts, parse._AMOUNTS[k], signed) == want, t
            found += want is not None
    assert found > 500


def test_letters_are_compared_as_in_patterns(spark):
    # every character that Java takes for a letter of a phrase, in either way of comparing
    every = spark.range(1, 0x3000).selectExpr("cast(id as int) o").where("o not between 55296 and 57343")
    text = F.expr("decode(unhex(lpad(hex(o), 8, '0')), 'UTF-32')")
    for letters, table, accents in ((sorted(tx.VARIANTS), parse.BARE, False), ("aăâbcdđeêghiklmnoôơpqrstuưvxyểữắẽ", parse.CASES, True)):
        made = every.select("o", *(text.rlike(f"(?iu)^{tx.phrase(c, accents)}$").alias(f"c{i}") for i, c in enumerate(letters)))
        for r in made.where(" or ".join(f"c{i}" for i in range(len(letters)))).collect():
            assert [c for i, c in enumerate(letters) if r[f"c{i}"]] == [chr(table[r.o])], hex(r.o)
        same = {o for o in range(1, 0x3000) if chr(table[o]) in letters}
        assert same == {r.o for r in made.where(" or ".join(f"c{i}" for i in range(len(letters)))).collect()}


def test_places_and_numbers_of_any_size(spark):
    text = "--- TRANG 99999999999 ---\n😀 mở đầu\nKết quả hoạt động: lãi\nthuyết minh: hết\n--- TRANG 02 ---\nx"
    r = parse.parse_documents(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert [p.page for p in r.pages] == [None, 2]
    assert r.sections["kqkd"] == "Kết quả hoạt động: lãi" and r.sections["thuyet_minh"].startswith("thuyết minh: hết")
